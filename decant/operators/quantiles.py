"""Exact quantiles and ranks per group, safe for a group that holds most of the rows.

Equal values are counted before they move. A value histogram then tells which bucket holds each wanted
rank, and only those buckets are sorted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decant.session import attach, materialise

#: Edges between histogram buckets, at even steps of the approximate distribution of the distinct values; one less than a
#: power of two, so that they can be bisected.
EDGES = 127


def value_counts(df: DataFrame, group: Sequence[str], value: str, **extra: Column) -> DataFrame:
    """Rows per distinct value (plus extra aggregates), with the value's histogram bucket in ``_b``.

    The input is read once: the counts are written, and whatever is asked of them reads that table.
    """
    g = list(group)
    c = df.filter(F.col(value).isNotNull()).groupBy(*g, F.col(value).alias("_v")).agg(
        F.count(F.lit(1)).alias("_c"), *[e.alias(n) for n, e in extra.items()])
    c = materialise(c, "counts")
    steps = [(i + 1) / (EDGES + 1) for i in range(EDGES)]
    lim = c.groupBy(*g).agg(F.percentile_approx("_v", steps, 4 * EDGES).alias("_e"), F.sum("_c").alias("_n"))
    c = c.join(lim, g) if g else attach(c, lim)
    # equal edges leave buckets empty; outliers and infinities take one bucket; the number of edges below is bisected
    halves = ", ".join(str(1 << i) for i in reversed(range(EDGES.bit_length())))
    below = F.expr(f"aggregate(array({halves}), 0, (b, s) -> b + if(_e[b + s - 1] < _v, s, 0))")
    return c.withColumn("_b", below).drop("_e")


def quantiles(
    df: DataFrame, group: Sequence[str], value: str,
    linear: Mapping[str, float] | None = None, index: Mapping[str, float] | None = None,
) -> DataFrame:
    """One row per group: linearly interpolated quantiles and index-based ones (element ⌊q·n⌋, clipped)."""
    linear, index = dict(linear or {}), dict(index or {})
    g = list(group)
    counts = value_counts(df, g, value)
    n = F.col("_n")
    ranks: dict[str, Column] = {}
    for name, q in linear.items():
        h = F.lit(q) * (n - 1)
        ranks[f"{name}__lo"], ranks[f"{name}__hi"] = F.floor(h), F.ceil(h)
    for name, q in index.items():
        ranks[name] = F.least(n - 1, F.floor(F.lit(q) * n))
    wanted = F.array(*[r.cast("bigint") for r in ranks.values()])

    hist = counts.groupBy(*g, "_b").agg(F.sum("_c").alias("_cb"), F.max("_n").alias("_n"))
    earlier = Window.partitionBy(*g).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumn("_before", F.coalesce(F.sum("_cb").over(earlier), F.lit(0)))
    hit = F.exists(wanted, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_cb")))
    hist = hist.filter(hit).select(*g, "_b", "_before")

    w = Window.partitionBy(*g, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    rows = counts.join(hist, [*g, "_b"]).withColumn("_end", F.col("_before") + F.sum("_c").over(w))
    inside = lambda r: (r >= F.col("_end") - F.col("_c")) & (r < F.col("_end"))
    got = rows.groupBy(*g).agg(F.max("_n").alias("_n"), *[F.max(F.when(inside(r), F.col("_v"))).alias(k) for k, r in ranks.items()])
    out = []
    for name, q in linear.items():
        lo, hi, h = F.col(f"{name}__lo"), F.col(f"{name}__hi"), F.lit(q) * (n - 1)
        out.append((lo + (hi - lo) * (h - F.floor(h))).alias(name))
    return got.select(*g, *out, *index)


def median(df: DataFrame, group: Sequence[str], value: str, name: str) -> DataFrame:
    return quantiles(df, group, value, {name: 0.5})


def medians(df: DataFrame, group: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Medians of several columns in one pass over the data; null for a group without values."""
    g = list(group)
    long = df.select(*g, F.explode(F.array(*[F.struct(F.lit(v).alias("_kind"), F.col(v).cast("double").alias("_value")) for v in values])).alias("x")).select(*g, "x.*")
    m = quantiles(long, [*g, "_kind"], "_value", {"_m": 0.5})
    m = m.groupBy(*g).agg(*[F.max(F.when(F.col("_kind") == v, F.col("_m"))).alias(v) for v in values])
    return df.select(*g).distinct().join(m, g, "left")


def auc(df: DataFrame, score: str, positive: str, group: Sequence[str] = ()) -> DataFrame:
    """P(score of a positive > score of a negative), ties one half; null when a side is empty."""
    g = list(group)
    c = value_counts(df, g, score, _p=F.count_if(F.col(positive))).withColumn("_q", F.col("_c") - F.col("_p"))
    return _auc(c, g)


def auc_from_counts(counts: DataFrame) -> DataFrame:
    """Same from rows (v, pos, neg): how often each value occurs on either side."""
    c = value_counts(counts, [], "v", _p=F.sum("pos"), _q=F.sum("neg"))
    return _auc(c, [])


def _auc(c: DataFrame, g: list[str]) -> DataFrame:
    hist = c.groupBy(*g, "_b").agg(F.sum("_q").alias("_qb"))
    earlier = Window.partitionBy(*g).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.select(*g, "_b", F.coalesce(F.sum("_qb").over(earlier), F.lit(0)).alias("_before"))
    w = Window.partitionBy(*g, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("_before") + F.coalesce(F.sum("_q").over(w), F.lit(0))
    c = c.join(hist, [*g, "_b"]).withColumn("_u", F.col("_p") * (below + F.col("_q") / 2))
    p, q = F.sum("_p"), F.sum("_q")
    return c.groupBy(*g).agg(p.alias("n_pos"), q.alias("n_neg"), (F.sum("_u") / F.nullif(p * q, F.lit(0))).alias("auc"))


def average_ranks(df: DataFrame, value: str, name: str = "avg_rank", group: Sequence[str] = ()) -> DataFrame:
    """1-based ranks by value; equal values share their mean rank."""
    g = list(group)
    c = value_counts(df, g, value)
    hist = c.groupBy(*g, "_b").agg(F.sum("_c").alias("_cb"))
    earlier = Window.partitionBy(*g).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.select(*g, "_b", F.coalesce(F.sum("_cb").over(earlier), F.lit(0)).alias("_before"))
    w = Window.partitionBy(*g, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    c = c.join(hist, [*g, "_b"])
    below = F.col("_before") + F.coalesce(F.sum("_c").over(w), F.lit(0))
    c = c.select(*g, F.col("_v").alias(value), (below + (F.col("_c") + 1) / 2.0).alias(name))
    return df.join(c, [*g, value])
