"""Word pieces against the whole piece list of the model file."""

from public_tokenizers import path as vocabulary

from cyclewise.llm import token_counts

PATH = vocabulary("piece_bpe_32k.model")
SAMPLES = ["1234", "ñción", "ß", "日本語の文章", "Ελληνικά", "naïve", "The", "zzzzzzz", "a▁b", "▁", "▁▁x", "x y", "\U00013000", "a\U00013000b",
           "͸͹", "🏳️‍🌈", "<0x41>", "don't", "<s>", "!!"]


def greedy(word, listed):
    """The longest piece of the list each time; where none begins, one piece a byte."""
    text, at, out = "▁" + word, 0, []
    while at < len(text):
        end = next((e for e in range(len(text), at, -1) if text[at:e] in listed), None)
        out += [text[at:end]] if end else [f"<0x{b:02X}>" for b in text[at].encode()]
        at = end or at + 1
    return out


def full_list():
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    return {sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}


def test_counts_are_those_of_the_whole_piece_list(spark):
    listed, match = full_list(), token_counts.automaton(PATH)
    words = SAMPLES + sorted({w for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
                              for w in (r.text or "").replace("\v", " ").split()})
    assert {w: match.count(w) for w in words} == {w: len(greedy(w, listed)) for w in words}
    assert greedy("ñción", listed) == ["▁", "ñ", "ción"]


def test_query_splits_every_word(spark):
    listed = full_list()
    docs = spark.createDataFrame([(i, f"{w} {w}") for i, w in enumerate(SAMPLES)], "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.n_unknown) for r in token_counts.token_counts(docs, PATH).collect()}
    assert got == {i: (sum(len(greedy(x, listed)) for x in f"{w} {w}".split(" ")), 0) for i, w in enumerate(SAMPLES)}


def test_links_without_byte_pieces():
    match = token_counts.LongestMatch(["", "ab"], ["a", "b", "cdx"])
    assert [match.count(w) for w in ("ab", "ba", "cdx", "cd", "aa", "é")] == [1, 3, 2, None, 3, None]
    spelled = token_counts.LongestMatch(["", "ab"], ["a", "b", "cdx"], True)
    assert [spelled.count(w) for w in ("cd", "cdxx", "éa", "aé")] == [3, 3, 4, 4]
