"""Training-run logs: status, summaries, comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decant.functions.dist import ratio
from decant.operators.prefix import prefix
from decant.session import attach


def add_steps(log: DataFrame, bucket: Column, order: Sequence[str] = ("at_us", "okey")) -> DataFrame:
    return prefix(log, list(order), bucket, ["run"], rank="step")


def status(log: DataFrame, cols: Sequence[str], order: Sequence[str] = ("at_us", "okey")) -> DataFrame:
    """Last row and last non-null value per column and run: aggregates only, nothing is sorted."""
    key = F.struct(*order)
    return log.groupBy("run").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max(key).alias("_last"),
        *[F.max_by(c, F.when(F.col(c).isNotNull(), key)).alias(f"last_{c}") for c in cols]).drop("_last")


def first_last(log: DataFrame, col: str, order: Sequence[str] = ("at_us", "okey")) -> DataFrame:
    key = F.when(F.col(col).isNotNull(), F.struct(*order))
    return log.groupBy("run").agg(F.min_by(col, key).alias(f"{col}_first"), F.max_by(col, key).alias(f"{col}_last"))


def train_log(log: DataFrame, every: int) -> DataFrame:
    """One row per logging interval: sample-weighted losses, gold-weighted cross-entropy, rates."""
    d = log.groupBy("run", F.floor((F.col("step") - 1) / every).cast("bigint").alias("interval")).agg(
        F.count(F.lit(1)).alias("steps"), F.sum("n").alias("samples"), F.sum(F.col("loss") * F.col("n")).alias("l"),
        F.sum(F.col("ce") * F.col("n_gold")).alias("c"), F.sum("n_gold").alias("g"), F.sum("dt").alias("t"))
    r = lambda c, n: F.round(c, 6).alias(n)
    return d.select("run", "interval", "steps", "samples", r(F.col("l") / F.col("samples"), "train_loss"), r(F.col("c") / F.greatest(F.lit(1), F.col("g")), "ce"),
                    r(F.col("samples") / F.col("t"), "samples_per_s"), r(F.col("t") / F.col("steps") * 1000, "step_ms"))


def compare(metrics: DataFrame, target: int, base_runs: str, cols: Sequence[str], n_col: str) -> DataFrame:
    """Target run against the mean and sample deviation of baseline runs, with a binomial standard error."""
    base = metrics.filter(base_runs).agg(*[f(c).alias(f"{c}_{n}") for c in cols for n, f in (("mean", F.avg), ("sd", F.stddev_samp))])
    t = attach(metrics.filter(F.col("run") == target), base)
    r = lambda c, n: F.round(c, 6).alias(n)
    rows = [F.struct(F.lit(c).alias("metric"), r(F.col(c), "value"), r(F.col(f"{c}_mean"), "base_mean"), r(F.col(f"{c}_sd"), "base_sd"), r(F.col(c) - F.col(f"{c}_mean"), "delta"),
                     r(F.sqrt(F.when(F.col(c).between(0, 1), F.col(c) * (1 - F.col(c)) / F.col(n_col))), "se")) for c in cols]
    return t.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def energy_per_sample(energy: DataFrame, work: DataFrame, key: str) -> DataFrame:
    """Mean power over the recorded time, times active wall time, per sample; null where power was never read."""
    d = work.join(energy, key, "left")
    power = ratio(F.col("joules"), F.col("seconds"))
    return d.select(key, power.alias("power_mean_w"), (power * F.col("active_s")).alias("energy_j"), (power * ratio(F.col("active_s"), F.col("samples"))).alias("energy_per_sample_j"))
