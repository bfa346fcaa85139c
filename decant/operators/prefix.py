"""Row numbers and running totals over a global (or hot) order, without a one-task window.

The order is cut into buckets by a deterministic expression that rises with it. Bucket totals are
aggregated on the map side, their running sum is taken over the (few) buckets, and only then are rows
numbered inside their bucket. A group holding a third of all rows is spread over all its buckets, and a
recomputed task lands in the same bucket, because nothing is sampled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decant.functions.hashing import hex_int
from decant.session import attach


def hash_bucket(key: str | Column, digits: int = 3) -> Column:
    """Bucket of a sha1 sort key: its leading hex digits (16 ** digits buckets of even size)."""
    return hex_int(F.col(key) if isinstance(key, str) else key, digits)


def id_bucket(ident: str | Column, width: int = 1 << 20) -> Column:
    """Bucket of a dense numeric order: ``width`` consecutive ids share one."""
    c = F.col(ident) if isinstance(ident, str) else ident
    return F.floor(c / F.lit(width)).cast("bigint")


def edge_buckets(df: DataFrame, value: str, name: str = "_bucket", buckets: int = 1024) -> DataFrame:
    """Add the bucket of a number in its own distribution: even pieces of the order, however sparse or clustered it is.

    Edges are approximate quantiles, one bounded array; the bucket rises with the value, and equal values share one.
    ``df`` is read twice, so it should be a written table. Nulls come first, in bucket 0.
    """
    if buckets & (buckets - 1):
        raise ValueError("buckets must be a power of two")
    steps = [i / buckets for i in range(1, buckets)]
    edges = df.agg(F.percentile_approx(value, steps, 10 * buckets).alias("_edges"))
    halves = ", ".join(str(1 << i) for i in reversed(range(buckets.bit_length() - 1)))
    below = F.expr(f"aggregate(array({halves}), 0, (b, s) -> b + if(_edges[b + s - 1] < `{value}`, s, 0))")
    return attach(df, edges).withColumn(name, below).drop("_edges")


def prefix(
    df: DataFrame,
    order: Sequence[Column | str],
    bucket: Column,
    group: Sequence[str] = (),
    rank: str | None = "rn",
    sums: Mapping[str, Column | str] | None = None,
    keep_below: tuple[str, Column | int] | None = None,
) -> DataFrame:
    """Add ``rank`` (1-based) and, per entry of ``sums``, the total of all earlier rows.

    ``keep_below=(name, limit)`` keeps rows whose rank is at most / prior total is below ``limit``; whole
    buckets beyond the limit are dropped before any sorting. ``limit`` may be a column of ``df`` that is
    constant within a group.
    """
    sums = dict(sums or {})
    g = list(group)
    d = df.withColumn("_b", bucket)
    lim = None
    if keep_below:
        lim = keep_below[1] if isinstance(keep_below[1], Column) else F.lit(keep_below[1])
    totals = d.groupBy(*g, "_b").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(v).alias(f"_t_{n}") for n, v in sums.items()],
        *([F.max(lim).alias("_lim")] if keep_below else []),
    )
    earlier = Window.partitionBy(*g).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = totals.select(
        *g, "_b", *(["_lim"] if keep_below else []),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in sums],
    )
    if keep_below:
        start = "_before" if keep_below[0] == rank else f"_before_{keep_below[0]}"
        offs = offs.filter(F.col(start) < F.col("_lim"))
    j = d.join(offs, [*g, "_b"])
    w = Window.partitionBy(*g, "_b").orderBy(*order)
    cols = {}
    if rank:
        cols[rank] = F.col("_before") + F.row_number().over(w)
    for n, v in sums.items():
        local = F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, -1))
        cols[n] = F.col(f"_before_{n}") + F.coalesce(local, F.lit(0))
    j = j.withColumns(cols)
    if keep_below:
        c = F.col(keep_below[0])
        j = j.filter(c <= F.col("_lim") if keep_below[0] == rank else c < F.col("_lim"))
    drop = ["_b", "_before", *[f"_before_{n}" for n in sums], *(["_lim"] if keep_below else [])]
    return j.drop(*drop)


def neighbours(
    df: DataFrame, group: Sequence[str], order: Sequence[str], bucket: Column,
    lag: Mapping[str, str] | None = None, fill: Mapping[str, str] | None = None, fill_next: Mapping[str, str] | None = None,
) -> DataFrame:
    """Values of neighbouring rows along an order that is cut into buckets.

    ``lag[new] = col``: value of the previous row. ``fill[new] = col``: last non-null value up to and
    including this row. ``fill_next[new] = col``: first non-null value from this row on. What crosses a
    bucket edge is carried over by a window over one row per bucket.
    """
    lag, fill, fill_next = dict(lag or {}), dict(fill or {}), dict(fill_next or {})
    g = list(group)
    d = df.withColumn("_b", bucket)
    key = F.struct(*order)
    edge = d.groupBy(*g, "_b").agg(
        *[F.max_by(F.struct(F.col(c)), key).alias(f"_e_{n}") for n, c in lag.items()],
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), key)).alias(f"_e_{n}") for n, c in fill.items()],
        *[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), key)).alias(f"_e_{n}") for n, c in fill_next.items()],
    )
    wb = Window.partitionBy(*g).orderBy("_b")
    back = wb.rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*g).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.select(
        *g, "_b",
        *[F.lag(f"_e_{n}").over(wb)[c].alias(f"_c_{n}") for n, c in lag.items()],
        *[F.last(f"_e_{n}", ignorenulls=True).over(back).alias(f"_c_{n}") for n in fill],
        *[F.last(f"_e_{n}", ignorenulls=True).over(ahead).alias(f"_c_{n}") for n in fill_next],
    )
    j = d.join(edge, [*g, "_b"])
    w = Window.partitionBy(*g, "_b").orderBy(*order)
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    # looking forward is looking back in the reversed order: a growing frame costs one pass, a shrinking one is quadratic
    down = Window.partitionBy(*g, "_b").orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    cols = {n: F.when(F.row_number().over(w) == 1, F.col(f"_c_{n}")).otherwise(F.lag(c).over(w)) for n, c in lag.items()}
    cols |= {n: F.coalesce(F.last(c, ignorenulls=True).over(up), F.col(f"_c_{n}")) for n, c in fill.items()}
    cols |= {n: F.coalesce(F.last(c, ignorenulls=True).over(down), F.col(f"_c_{n}")) for n, c in fill_next.items()}
    return j.withColumns(cols).drop("_b", *[f"_c_{n}" for n in (*lag, *fill, *fill_next)])


def running_min(df: DataFrame, group: Sequence[str], order: Sequence[str], bucket: Column, value: str, payload: str, name: str) -> DataFrame:
    """Smallest non-null value so far (struct of value and payload), carried across buckets like ``neighbours``."""
    g = list(group)
    d = df.withColumns({"_b": bucket, "_x": F.when(F.col(value).isNotNull(), F.struct(value, payload))})
    edge = d.groupBy(*g, "_b").agg(F.min("_x").alias("_m"))
    before = Window.partitionBy(*g).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.select(*g, "_b", F.min("_m").over(before).alias("_c"))
    w = Window.partitionBy(*g, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return d.join(edge, [*g, "_b"]).withColumn(name, F.least(F.min("_x").over(w), F.col("_c"))).drop("_b", "_x", "_c")


def report_windows(df: DataFrame, rank: str, size: int, every: int) -> DataFrame:
    """One row per (report, member): report number r covers the ``size`` rows up to row ``r * every``.

    A row belongs to at most ``size / every`` (rounded up) reports, so this is a bounded copy followed by an
    ordinary aggregate; the rows after the last full step report at the next multiple.
    """
    first = F.ceil(F.col(rank) / every).cast("bigint")
    last = F.ceil((F.col(rank) + size) / every).cast("bigint") - 1
    return df.withColumn("report", F.explode(F.sequence(first, last)))
