"""Document fingerprints: threshold-scaled sketches of shingle hashes.

A fingerprint keeps every 5-word shingle hash below a fixed fraction of the
hash range. Its size follows the document's, the sketch of a union is the
union of sketches, and the share of one sketch found in another estimates how
much of the first text the second holds, however unequal the two are.
DataFrame expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cyclewise.functions.exprs import count_le_sorted
from cyclewise.llm.common import NO_ID, documents, words_of

SHINGLE = 5
#: one hash in so many is kept
SCALE = 4


def sketch(text: Column, k: int = SHINGLE, scale: int = SCALE) -> Column:
    """Sorted distinct shingle hashes below 1/scale of the hash range. A text
    of fewer than ``k`` words is one shingle; without words there is none."""
    words = F.transform(words_of(text), lambda w: F.xxhash64(w))
    low, width = -(1 << 63), (1 << 64) // scale

    def kept(h: Column) -> Column:
        n = F.size(h)
        runs = F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))),
                           lambda i: F.xxhash64(*[F.get(h, i + (j - 1)) for j in range(k)]))
        return F.when(n > 0, F.filter(runs, lambda x: x <= F.lit(low + width - 1))).otherwise(
            F.array().cast("array<long>"))

    # one pass over the words, kept for the several uses of the array
    return F.array_sort(F.array_distinct(F.element_at(F.transform(F.array(words), kept), 1)))


def fingerprint(text: Column, hashes: Column) -> Column:
    """The sketch as text: a hash of the whole text, then the kept hashes."""
    return F.concat_ws(":", F.lpad(F.hex(F.xxhash64(F.coalesce(text, F.lit("")))), 16, "0"),
                       F.array_join(F.transform(hashes, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def merge(a: Column, b: Column) -> Column:
    """Sketch of two texts together."""
    return F.array_sort(F.array_union(a, b))


def likeness(a: Column, b: Column, same: Column) -> Column:
    """Estimated Jaccard likeness; where neither sketch kept a hash, whether the texts are the ``same``."""
    common, n = F.size(F.array_intersect(a, b)), F.size(a) + F.size(b)
    return F.when(n == 0, F.when(same, 1.0).otherwise(0.0)).otherwise(common / (n - common))


def containment(a: Column, b: Column, same: Column) -> Column:
    """Estimated share of the first text's shingles that the second has."""
    n = F.size(a)
    return F.when(n == 0, F.when(same, 1.0).otherwise(0.0)).otherwise(F.size(F.array_intersect(a, b)) / n)


def with_next(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``next``: a struct of ``columns`` of the row that follows in the
    order of (sid, h); the last row is followed by the first.

    Rows are dealt into ranges of sid by approximate quantiles (as many as
    shuffle partitions), rows without an id into ranges of their hash, and each
    range is ordered on its own. A range's last row takes the first row of the
    next range, of which there is one for each range."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = rows.filter(F.col("sid") < NO_ID).agg(F.percentile_approx("sid", [i / n for i in range(1, n)] or [0.5], 20 * n)).first()[0] or []
    bounds = sorted(set(bounds))
    edges = F.array(*[F.lit(b).cast("long") for b in bounds]).cast("array<long>")
    by_hash = F.shiftright((F.shiftright("h", 32) + (1 << 31)) * n, 32) + (len(bounds) + 1)
    placed = rows.withColumn("range", F.when(F.col("sid") == NO_ID, by_hash).otherwise(
        count_le_sorted(edges, "sid", len(bounds) + 1).cast("long")))
    w = Window.partitionBy("range").orderBy("sid", "h")
    row = F.struct(*columns)
    firsts = placed.groupBy("range").agg(F.min(F.struct("sid", "h", *[c for c in columns if c not in ("sid", "h")]))
                                         .alias("f"))
    order = Window.orderBy("range")  # one row for each range
    heads = firsts.select("range", F.struct(*[F.col(f"f.{c}").alias(c) for c in columns]).alias("f"))
    after = heads.select("range", F.coalesce(F.lead("f").over(order), F.first("f").over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    return (placed.withColumn("next", F.lead(row).over(w)).join(after, "range")
            .withColumn("next", F.coalesce("next", "after")).drop("range", "after"))


def fingerprint_edits(docs: DataFrame, k: int = SHINGLE, scale: int = SCALE, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """Every document's fingerprint, that of an edited text, and likenesses.

    The edited text has the last half (rounded down) of the code points
    replaced by as many of the next document's first ones, or all it has. Next
    is by ascending id, null ids last, equal ids by a hash of the text; after
    the last comes the first, so a sole document is its own next. A null text
    is empty. Every row gives one row; an empty table gives none."""
    rows = documents(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.select("doc_id", "sid", "h", "text", sketch(F.col("text"), k, scale).alias("hashes"))
    rows = with_next(rows, ["text", "hashes"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next.text", F.lit(1), half))
    rows = rows.select("doc_id", "sid", "h", "text", "hashes", n.cast("long").alias("n_chars"),
                       edited.alias("edited"), F.col("next.hashes").alias("next_hashes"),
                       (F.col("text") == F.col("next.text")).alias("same_next"))
    rows = rows.withColumn("edited_hashes", sketch(F.col("edited"), k, scale))
    same = F.col("text") == F.col("edited")
    a, e, x = F.col("hashes"), F.col("edited_hashes"), F.col("next_hashes")
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        fingerprint(F.col("text"), a).alias("fingerprint"), fingerprint(F.col("edited"), e).alias("edited_fingerprint"),
        likeness(a, e, same).alias("near_edited"), likeness(a, x, F.col("same_next")).alias("near_next"),
        containment(a, e, same).alias("held_by_edited"), containment(a, x, F.col("same_next")).alias("held_by_next"))
