"""Quality classifier: a sparse rule ensemble over text statistics.

Shallow trees are grown on labelled documents; every path from a root to a
node is a rule, a conjunction of threshold tests. A lasso logistic regression
weighs the rules and drops most, and the rest are compiled into one Spark
column expression, so scoring is a projection.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cyclewise.llm.common import documents, staged, words_of

#: labelled rows used for fitting, at most about so many (a hash decides which)
FIT_ROWS = 20_000
#: a rule is (feature, test, threshold) conditions; test is "<=" or ">"
Condition = tuple[str, str, float]


def text_statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text, JVM-side; all are 0 for an empty text."""
    t = F.coalesce(text, F.lit(""))
    words, lines = words_of(text), F.split(t, "\n")
    chars, n_words, n_lines = F.length(t), F.size(words), F.size(lines)

    def share(pattern: str) -> Column:
        return F.regexp_count(t, F.lit(pattern)) / F.greatest(chars, F.lit(1))

    def per_word(pattern: str) -> Column:
        return F.regexp_count(t, F.lit(pattern)) / F.greatest(n_words, F.lit(1))

    return {
        "log_words": F.log1p(n_words.cast("double")),
        "word_length": chars / F.greatest(n_words, F.lit(1)),
        "upper": share(r"\p{Lu}"),
        "digits": share(r"\p{Nd}"),
        "symbols": share(r"[^\p{L}\p{Nd}\s.,;:!?'\"()-]"),
        "sentence_ends": per_word(r"[.!?]"),
        "commas": per_word(r"[,;:]"),
        "exclaims": per_word(r"!"),
        "bars": per_word(r"[|<>{}\[\]=_~^\\/]"),
        "doubled": per_word(r"([^\p{L}\p{Nd}\s])\1"),
        "distinct_words": F.size(F.array_distinct(words)) / F.greatest(n_words, F.lit(1)),
        "distinct_lines": F.size(F.array_distinct(lines)) / n_lines,
        "line_length": chars / n_lines,
    }


@dataclass(frozen=True)
class RuleModel:
    rules: tuple[tuple[tuple[Condition, ...], float], ...]
    intercept: float

    def score(self) -> Column:
        """Probability of label 1 as a column expression over the statistics."""
        z = F.lit(self.intercept)
        for conditions, weight in self.rules:
            z = z + F.when(holds(conditions), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def holds(conditions: tuple[Condition, ...]) -> Column:
    out = F.lit(True)
    for feature, test, threshold in conditions:
        c = F.col(feature)
        out = out & (c <= threshold if test == "<=" else c > threshold)
    return out


def tree_rules(model, features: list[str]) -> list[tuple[Condition, ...]]:
    """The conditions on the way to every node of every tree, without repeats."""
    found: dict[tuple[Condition, ...], None] = {}

    def descend(node, path: tuple[Condition, ...]) -> None:
        if path:
            found.setdefault(path)
        if node.numDescendants() == 0:
            return
        feature, threshold = features[node.split().featureIndex()], node.split().threshold()
        descend(node.leftChild(), simplified(path, (feature, "<=", threshold)))
        descend(node.rightChild(), simplified(path, (feature, ">", threshold)))

    for tree in model.trees:
        descend(tree._call_java("rootNode"), ())
    return list(found)


def simplified(path: tuple[Condition, ...], new: Condition) -> tuple[Condition, ...]:
    """``path`` and ``new``, the looser of two tests of one side of a feature left out."""
    return tuple(sorted([c for c in path if c[:2] != new[:2]] + [new]))


def fit_rules(rows: DataFrame, features: list[str], label: str = "label", trees: int = 8, depth: int = 3,
              penalty: float = 0.002, seed: int = 7) -> RuleModel:
    """Fit on ``rows`` (statistics and a 0/1 label). With no rows, or one label
    alone, the model is a constant: 0.5, or the label's smoothed share."""
    n, ones = rows.agg(F.count(F.lit(1)), F.sum(label)).first()
    if not n or ones in (0, n):
        p = ((ones or 0) + 0.5) / ((n or 0) + 1)
        import math
        return RuleModel((), math.log(p / (1 - p)))
    data = VectorAssembler(inputCols=features, outputCol="x").transform(rows)
    forest = RandomForestClassifier(featuresCol="x", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed,
                                    featureSubsetStrategy="sqrt", minInstancesPerNode=2, maxBins=32)
    rules = tree_rules(forest.fit(data), features)
    if not rules:
        return RuleModel((), 0.0)
    marked = rows.select(label, *[holds(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    marked = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="x").transform(marked)
    fit = LogisticRegression(featuresCol="x", labelCol=label, elasticNetParam=1.0, regParam=penalty,
                             maxIter=60).fit(marked.select("x", label))
    weights = fit.coefficients.toArray()
    return RuleModel(tuple((r, float(w)) for r, w in zip(rules, weights) if w), float(fit.intercept))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Documents no label is learned from: crc32 of the id as text, modulo ``folds``, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, fit_rows: int = FIT_ROWS,
                     id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Labels are learned from documents that are not held out. A null text is
    empty and scored; a null id has no label and is never held out; labels of
    an id that disagree are averaged and rounded up; an empty table gives no
    rows. Only statistics of the text enter a score."""
    base = documents(docs, id_col, text_col)
    stats = text_statistics(F.col("text"))
    table = staged(base.select("doc_id", "sid", "h", *[c.cast("double").alias(k) for k, c in stats.items()]),
                   "quality")
    known = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y"))
             .dropna().filter(~held_out(F.col("doc_id"))).groupBy("doc_id")
             .agg((F.avg("y") >= 0.5).cast("double").alias("label")))
    n = known.count()
    share = int(min(1.0, fit_rows / max(n, 1)) * (1 << 20))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share)
    train = staged(table.dropDuplicates(["sid", "h"]).join(chosen, "doc_id").select("label", *stats), "quality-fit")
    model = fit_rules(train, list(stats))
    return (table.select("doc_id", "sid", "h", held_out(F.col("doc_id")).alias("held_out"),
                         model.score().alias("score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))
