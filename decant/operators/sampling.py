"""Samplers whose choice depends only on content hashes, never on arrival order or partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decant.functions import hashing as H
from decant.operators.config import caps_table
from decant.operators.prefix import hash_bucket, prefix
from decant.session import attach


def cap_per_source(df: DataFrame, caps: dict[str, int], ident: str, only: str | None = None, source: str = "source") -> DataFrame:
    """Keep the ``caps[source]`` rows with the smallest hash; uncapped sources and rows outside ``only`` all stay.

    Capped rows are ranked over hash buckets, so a source holding most rows is spread over the cluster and
    buckets past the cap are never sorted.
    """
    capped = F.col(source).isin(*caps)
    if only:
        capped = capped & F.expr(only)
    d = df.withColumns({"_capped": F.coalesce(capped, F.lit(False)), "_h": H.rank_key(F.col(source), F.col(ident))})
    lim = caps_table(df.sparkSession, caps).withColumnRenamed("source", source)
    part = d.filter("_capped").join(F.broadcast(lim), source)
    part = prefix(part, ["_h"], hash_bucket("_h"), [source], keep_below=("rn", F.col("cap")))
    return d.filter("not _capped").select(*df.columns).unionByName(part.select(*df.columns))


def equal_cap(df: DataFrame, cap: int, ident: str, source: str = "source") -> DataFrame:
    d = df.withColumn("_h", H.rank_key(F.col(source), F.col(ident)))
    return prefix(d, ["_h"], hash_bucket("_h"), [source], keep_below=("rn", cap)).select(*df.columns)


def dense_ids(pool: DataFrame, ident: str, group: Sequence[str] = ()) -> DataFrame:
    """Add ``dense``, 0 to n - 1 in hash order inside ``group``, and ``n``: numbered once, whatever the number of epochs.

    Repeated ids keep a number each. The groups' sizes are one row per group.
    """
    d = pool.withColumn("_h", H.rank_key("dense", F.col(ident)))
    d = prefix(d, ["_h", ident], hash_bucket("_h"), list(group), rank="dense").drop("_h")
    sizes = pool.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    d = d.join(sizes, list(group)) if group else attach(d, sizes)
    return d.withColumn("dense", F.col("dense") - 1)


def epoch_position(dense: str, n: str, *key: str) -> Column:
    """Position of a dense id in the epoch that ``key`` (SQL expressions) names: a keyed permutation, no sort."""
    return F.expr(H.permuted_text(dense, n, f"concat_ws(':', '{H.SEED}', {', '.join(key)})"))


def stratified_batches(pool: DataFrame, ident: str, quota: dict[str, int], first: int = 0, past: int | None = None, source: str = "source") -> DataFrame:
    """Rows of the batches from step ``first`` to before ``past``: ``quota[s]`` per source, each on its own endless walk.

    The draw at (step, j) is position ``step * q + j`` of its source's walk, hence an epoch and a place there, and a
    keyed permutation says which dense id stands at that place. Any range of steps costs what it returns; without
    ``past`` every source is walked through once at least. Sources without a quota, and quotas without rows, give none.
    """
    spark = pool.sparkSession
    q = spark.createDataFrame([(s, n) for s, n in quota.items() if n > 0], f"{source} string, q int")
    numbered = dense_ids(pool.join(F.broadcast(q.select(source)), source, "left_semi").select(source, ident), ident, [source])
    sizes = q.join(numbered.groupBy(source).agg(F.count(F.lit(1)).alias("n")), source)
    steps = F.lit(past) if past is not None else sizes.agg(F.max(F.ceil(F.col("n") / F.col("q")))).scalar()
    plan = sizes.withColumn("past", steps.cast("bigint")).filter(f"past > {first}").selectExpr(source, "n", "q", f"explode(sequence({first}L, past - 1)) as step")
    plan = plan.selectExpr(source, "n", "step", "q", "explode(sequence(0, q - 1)) as j").selectExpr(source, "n", "step", "j", "step * q + j as at")
    plan = plan.withColumn("dense", epoch_position("at % n", "n", source, "at div n"))
    return plan.drop("n", "at").join(numbered.drop("n"), [source, "dense"]).drop("dense")


def learning_rate(step: Column, peak: float, floor: float, warmup: int, total: int) -> Column:
    """Linear warm-up, then a cosine down to ``floor``."""
    share = F.least(F.lit(1.0), (step - warmup) / float(total - warmup))
    return F.when(step < warmup, F.lit(peak) * (step + 1) / float(warmup)).otherwise(
        F.lit(floor) + 0.5 * (peak - floor) * (1 + F.cos(F.pi() * share)))
