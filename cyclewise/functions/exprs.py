"""Column expressions shared by the operators (all JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def paired(a: str | Column, b: str | Column) -> tuple[Column, Column]:
    """Keep only rows where both sides are present (pandas pairwise-complete)."""
    a, b = col(a), col(b)
    return F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)


def guarded_corr(a: str | Column, b: str | Column) -> Column:
    """Pearson correlation that is NULL (not an ANSI error) on zero variance."""
    x, y = paired(a, b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def guarded_abs_corr(a: str | Column, b: str | Column) -> Column:
    """|corr| with NaN/undefined mapped to 0, as the reference does."""
    return F.coalesce(F.abs(guarded_corr(a, b)), F.lit(0.0))


def nasa_term(y: str | Column, p: str | Column) -> Column:
    """Per-row asymmetric score: late predictions cost more than early ones."""
    d = col(p) - col(y)
    return F.when(d < 0, F.exp(-d / 13.0) - 1).otherwise(F.exp(d / 10.0) - 1)


def r6(c: str | Column) -> Column:
    return F.round(col(c), 6)


def one_hot(regime: str | Column, width: int) -> Column:
    """Fixed-width one-hot array; out-of-range regimes give all zeros."""
    r = col(regime)
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)),
                       lambda k: F.when(k == r, F.lit(1.0)).otherwise(F.lit(0.0)))


def count_le_sorted(edges: str | Column, v: str | Column, max_len: int | None = 64) -> Column:
    """Number of elements <= v in an ascending array, by binary search
    (log2(max_len) steps of ``aggregate``, no per-element scan; without
    ``max_len`` as many steps as each array needs)."""
    e, x = col(edges), col(v)
    steps = F.length(F.bin(F.size(e))) if max_len is None else F.lit(max(1, max_len.bit_length() + 1))
    init = F.struct(F.lit(0).alias("lo"), F.size(e).alias("hi"))

    def step(acc, _i):
        lo, hi = acc["lo"], acc["hi"]
        mid = F.floor((lo + hi) / 2).cast("int")
        go_right = F.element_at(e, mid + 1) <= x
        return F.when(lo >= hi, acc).otherwise(
            F.when(go_right, F.struct((mid + 1).alias("lo"), hi.alias("hi")))
            .otherwise(F.struct(lo.alias("lo"), mid.alias("hi"))))

    return F.aggregate(F.sequence(F.lit(1), steps), init, step)["lo"]


def count_le_small(edges: str | Column, v: str | Column, max_len: int) -> Column:
    """Number of elements <= v in an array of at most ``max_len`` elements,
    unrolled into plain comparisons so it stays inside whole-stage codegen
    (PSI bins: at most 9 inner edges)."""
    e, x = col(edges), col(v)
    terms = [F.when(F.try_element_at(e, F.lit(i + 1)) <= x, F.lit(1)).otherwise(F.lit(0)) for i in range(max_len)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out
