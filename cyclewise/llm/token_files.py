"""Token-id files: one zstandard frame per document, a trailing seek table.

A file is a plain concatenation of zstandard frames, so any decoder reads it
from front to back as the ids of its documents (little-endian, 16 bits where
the vocabulary fits, else 32). Two skippable frames end it:

* the document index: ids, null flags and token counts of the documents;
* the seek table in the public seekable layout: compressed size, size and
  checksum (low 32 bits of xxh64) of each frame, then frame count, descriptor
  and magic number.

A reader takes the tail, looks a document up and decompresses its frames
alone. A document of more than FRAME_TOKENS tokens takes several frames.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cyclewise.llm.common import BatchMemo, documents, shared_folder, slices

# Fixed values of the seekable zstandard layout.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

INDEX_MAGIC = 0x58444957
FRAME_TOKENS = 1 << 20
FILE_BYTES = 256 << 20
#: chunks whose ids a worker keeps, some 200 bytes each
MEMO_CHUNKS = 1_000_000
#: blanks other than space and line feed; looking for each is faster than a character class
OTHER_BLANKS = ("\t\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
                "\u200a\u2028\u2029\u202f\u205f\u3000")


# -- encoding -----------------------------------------------------------------

class TextEncoder:
    """ids of texts as the tokenizers library gives them.

    The byte-level split always ends a piece before a single space between two
    non-space characters, so a text is cut there and each chunk (mostly a
    word) goes to the library once per worker. New chunks of a batch go to it
    as one text: a token that starts with a space starts a chunk. Texts with
    other blanks around a space, and chunks that hold the string of an added
    token, go to the library on their own."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.size = self.tok.get_vocab_size(with_added_tokens=True)
        space = self.tok.pre_tokenizer.pre_tokenize_str(" ")[0][0]
        self.opens = np.zeros(self.size, bool)
        for token, i in self.tok.get_vocab(with_added_tokens=False).items():
            self.opens[i] = token.startswith(space)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.chunks = BatchMemo(self._ids_of_chunks, MEMO_CHUNKS)

    def _ids(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _ids_of_chunks(self, chunks: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(chunks)
        whole = " ".join(chunks)
        if any(a in whole for a in self.added):
            out = [self._ids(" " + c) if any(a in c for a in self.added) else None for c in chunks]
        joint = [k for k, x in enumerate(out) if x is None]
        for at in range(0, len(joint), 2000):
            part = joint[at:at + 2000]
            text = " " + " ".join([chunks[k] for k in part])
            ids = np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) != len(part):
                raise ValueError("the vocabulary does not mark the space before a word")
            raw = ids.tobytes()
            bounds = [*(4 * starts).tolist(), len(raw)]
            for k, a, b in zip(part, bounds, bounds[1:]):
                out[k] = raw[a:b]
        return out

    @staticmethod
    def separable(text: str) -> bool:
        """Whether every space stands alone between two non-blanks."""
        return bool(text) and not (text[0] in " \n" or text[-1] in " \n" or "  " in text or " \n" in text
                                   or "\n " in text or any(b in text for b in OTHER_BLANKS))

    def encode_many(self, texts: list[str]) -> list[bytes]:
        cut = [t.split(" ") if self.separable(t) else None for t in texts]
        values = iter(self.chunks.values_of([c[1:] for c in cut if c]))
        firsts = iter(self.tok.encode_batch_fast([c[0] for c in cut if c], add_special_tokens=False))
        return [self._ids(t) if c is None else np.array(next(firsts).ids, "<u4").tobytes() + b"".join(next(values))
                for t, c in zip(texts, cut)]


@lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    return TextEncoder(path)


# -- one file -------------------------------------------------------------------

def filesystem(uri: str):
    """(file system, path) of a URI, for the shared folder's own store."""
    from pyarrow import fs
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


class FileWriter:
    """Writes one file under a name of its own and moves it into place, so a
    repeated task attempt replaces the same content and leaves no half file."""

    def __init__(self, folder: str, name: str, width: int, frame_tokens: int):
        self.fs, base = filesystem(folder)
        self.fs.create_dir(base, recursive=True)
        self.final, self.temp = f"{base}/{name}", f"{base}/.{name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temp)
        self.dtype, self.frame_tokens = np.dtype(f"<u{width}"), frame_tokens
        self.frames: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []
        self.counts: list[int] = []
        self.bytes = 0

    def add(self, doc_id: int | None, ids: np.ndarray, compressor: zstandard.ZstdCompressor) -> None:
        for at in range(0, len(ids), self.frame_tokens):
            raw = ids[at:at + self.frame_tokens].astype(self.dtype).tobytes()
            packed = compressor.compress(raw)
            self.out.write(packed)
            self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.bytes += len(packed)
        self.ids.append(doc_id)
        self.counts.append(len(ids))

    def close(self) -> dict:
        n = len(self.ids)
        index = struct.pack("<IBIQ", INDEX_MAGIC, self.dtype.itemsize, self.frame_tokens, n) + zstandard.compress(
            np.array([x or 0 for x in self.ids], "<i8").tobytes()
            + np.array([x is None for x in self.ids], "u1").tobytes() + np.array(self.counts, "<u8").tobytes())
        table = b"".join(struct.pack("<III", *f) for f in self.frames)
        table += struct.pack("<IBI", len(self.frames), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        tail = struct.pack("<II", SKIPPABLE_INDEX, len(index) + 4) + index + struct.pack("<I", len(index))
        tail += struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table
        self.out.write(tail)
        self.out.close()
        self.fs.move(self.temp, self.final)
        return {"n_docs": n, "n_tokens": sum(self.counts), "n_bytes": self.bytes + len(tail)}


class FileReader:
    """Random access to the documents of one file."""

    def __init__(self, path: str):
        fs, p = filesystem(path)
        self.path, self.file = path, fs.open_input_file(p)
        size = self.file.size()
        count, flag, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC or flag != CHECKSUM_FLAG:
            raise ValueError(f"{path}: no seek table with checksums at its end")
        seek = size - 9 - 12 * count
        self.frames = np.frombuffer(self._at(seek, 12 * count), "<u4").reshape(-1, 3)
        self.offsets = np.concatenate([[0], np.cumsum(self.frames[:, 0], dtype=np.int64)])
        n, = struct.unpack("<I", self._at(seek - 12, 4))
        index = self._at(seek - 12 - n, n)
        magic, width, self.frame_tokens, docs = struct.unpack_from("<IBIQ", index)
        if magic != INDEX_MAGIC:
            raise ValueError(f"{path}: no document index before the seek table")
        body = zstandard.decompress(index[struct.calcsize("<IBIQ"):]) if docs else b""
        self.dtype = np.dtype(f"<u{width}")
        self.ids = np.frombuffer(body, "<i8", docs)
        self.missing = np.frombuffer(body, "u1", docs, 8 * docs).astype(bool)
        self.counts = np.frombuffer(body, "<u8", docs, 9 * docs).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(-(-self.counts // self.frame_tokens))])

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def document(self, i: int) -> Iterator[np.ndarray]:
        """The i-th document's ids, frame by frame, each checked."""
        for k in range(self.first[i], self.first[i + 1]):
            packed, size, checksum = (int(x) for x in self.frames[k])
            raw = zstandard.ZstdDecompressor().decompress(self._at(int(self.offsets[k]), packed), max_output_size=size)
            if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != checksum:
                raise ValueError(f"{self.path}: frame {k} is damaged")
            yield np.frombuffer(raw, self.dtype)


# -- tables ---------------------------------------------------------------------

MANIFEST = "part int, seq int, path string, n_docs long, n_tokens long, n_bytes long, min_id long, max_id long"
MANIFEST_ARROW = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()),
                            ("n_tokens", pa.int64()), ("n_bytes", pa.int64()), ("min_id", pa.int64()),
                            ("max_id", pa.int64())])


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id",
                      text_col: str = "text", frame_tokens: int = FRAME_TOKENS,
                      file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode every document, append ``end_id`` and write the ids in ascending
    id order. Returns the manifest, one row per file, also stored beside the
    files. A null text is empty, a null id comes after all others, rows that
    share an id are ordered by a hash of their text. An empty table gives no
    file."""
    rows = documents(docs, id_col, text_col).withColumn("tie", F.monotonically_increasing_id())
    ordered = (rows.repartitionByRange("sid", "h", "tie").sortWithinPartitions("sid", "h", "tie")
               .select("doc_id", "text"))

    def write(batches):
        part, seq, writer, enc = TaskContext.get().partitionId(), 0, None, encoder(tokenizer_path)
        compressor = zstandard.ZstdCompressor(level=3)
        end = np.array([end_id], "<u4")

        def done():
            ids = [x for x in writer.ids if x is not None]
            meta = writer.close() | {"part": part, "seq": seq, "path": f"{folder}/{name(seq)}",
                                     "min_id": min(ids, default=None), "max_id": max(ids, default=None)}
            return pa.RecordBatch.from_pylist([meta], MANIFEST_ARROW)

        def name(k):
            return f"tokens-{part:06d}-{k:06d}.zst"

        for batch in slices(batches, 64):
            encoded = enc.encode_many([t or "" for t in batch.column(1).to_pylist()])
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded):
                if writer is None:
                    writer = FileWriter(folder, name(seq), 2 if enc.size <= 1 << 16 else 4, frame_tokens)
                writer.add(doc_id, np.concatenate([np.frombuffer(ids, "<u4"), end]), compressor)
                if writer.bytes >= file_bytes:
                    yield done()
                    writer, seq = None, seq + 1
        if writer is not None:
            yield done()

    manifest = ordered.mapInArrow(write, MANIFEST)
    manifest.write.parquet(f"{folder}/_manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long, path string, position long"
DIGEST_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
                          ("ids_crc32", pa.int64()), ("path", pa.string()), ("position", pa.int64())])
IDS_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int32()))])


def _located(manifest: DataFrame) -> DataFrame:
    """Manifest rows with the number of ids in the files before each (one row per file)."""
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.select("path", "min_id", "max_id",
                           F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))


def _files(manifest: DataFrame) -> DataFrame:
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _located(manifest).repartition(n)


def document_digests(manifest: DataFrame) -> DataFrame:
    """Read every file back: per document its id, the number of ids before it
    in the whole set, its token count and the crc32 of its ids."""

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                f = FileReader(row["path"])
                start = row["base"]
                out = {k: [] for k in DIGEST_ARROW.names}
                for i in range(len(f.ids)):
                    crc = 0
                    for ids in f.document(i):
                        crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                    values = (None if f.missing[i] else int(f.ids[i]), start, int(f.counts[i]), crc, row["path"], i)
                    for k, v in zip(out, values):
                        out[k].append(v)
                    start += int(f.counts[i])
                yield pa.RecordBatch.from_pydict(out, DIGEST_ARROW)

    return _files(manifest).mapInArrow(read, DIGEST)


def read_documents(manifest: DataFrame, doc_ids: list[int]) -> DataFrame:
    """ids of the requested documents: files that cannot hold one are skipped,
    and of the others only the requested documents' frames are decompressed."""
    wanted = np.array(sorted(set(doc_ids)), dtype=np.int64)

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                if row["min_id"] is None or not ((wanted >= row["min_id"]) & (wanted <= row["max_id"])).any():
                    continue
                f = FileReader(row["path"])
                starts = row["base"] + np.concatenate([[0], np.cumsum(f.counts)])
                for i in np.flatnonzero(np.isin(f.ids, wanted) & ~f.missing):
                    ids = np.concatenate([*f.document(i), np.zeros(0, f.dtype)]).astype(np.int32)
                    yield pa.RecordBatch.from_pylist(
                        [{"doc_id": int(f.ids[i]), "start": int(starts[i]), "ids": ids}], IDS_ARROW)

    return _files(manifest).mapInArrow(read, "doc_id long, start long, ids array<int>")


def token_file_digests(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 0,
                       **options) -> DataFrame:
    """Write ``docs`` to token files in the shared folder and read them back."""
    folder = shared_folder(spark, "token-files")
    return document_digests(write_token_files(docs, folder, tokenizer_path, end_id, **options))
