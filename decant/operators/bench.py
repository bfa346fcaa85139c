"""Benchmark reports over request logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decant.functions.dist import ratio
from decant.operators.quantiles import median, medians
from decant.session import attach


def reference_hashes(results: DataFrame, reference: str) -> DataFrame:
    """Per prompt: the reference configuration's output hash at its lowest repetition."""
    ok = results.filter((F.col("config") == reference) & F.col("ok") & F.col("sha").isNotNull())
    return ok.groupBy("prompt_id").agg(F.min(F.struct("rep", "req", "sha")).alias("m")).select("prompt_id", F.col("m.rep").alias("ref_rep"), F.col("m.req").alias("ref_req"), F.col("m.sha").alias("ref_sha"))


def match_rates(results: DataFrame, reference: str) -> DataFrame:
    """Share of outputs equal to the reference's, leaving out the reference's own base rows."""
    j = results.filter("ok and sha is not null").join(reference_hashes(results, reference), "prompt_id")
    own = (F.col("config") == reference) & (F.col("rep") == F.col("ref_rep")) & (F.col("req") == F.col("ref_req"))
    d = j.filter(~own).groupBy("config").agg(F.count_if(F.col("sha") == F.col("ref_sha")).alias("match_n"), F.count(F.lit(1)).alias("match_total"))
    return d.withColumn("match_rate", F.round(ratio(F.col("match_n"), F.col("match_total")), 6))


def config_report(results: DataFrame, reference: str, draft_max: int = 3) -> DataFrame:
    """Rates, speedup against the reference, draft acceptance and energy per token, one row per configuration."""
    ok = results.filter("ok")
    ok = ok.withColumn("wall_rate", F.col("tokens_predicted") / F.nullif(F.col("wall_s"), F.lit(0.0)))
    with_e = F.col("energy_j").isNotNull() & (F.col("tokens_predicted") > 0)
    base = results.groupBy("config").agg(
        F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_fail"),
        F.sum("draft_n").alias("draft_n"), F.sum("draft_ok").alias("draft_ok"),
        F.sum(F.when(with_e, F.col("energy_j"))).alias("e"), F.sum(F.when(with_e, F.col("tokens_predicted"))).alias("tok"))
    med = medians(ok.select("config", "gen_rate", "wall_rate"), ["config"], ["gen_rate", "wall_rate"])
    d = base.join(med, "config", "left")
    ref = d.filter(F.col("config") == reference).select(F.col("gen_rate").alias("ref_gen"), F.col("wall_rate").alias("ref_wall"))
    d = attach(d, ref)
    r = lambda c, n: F.round(c, 6).alias(n)
    accept = ratio(F.col("draft_ok"), F.col("draft_n"))
    return d.select(
        "config", "n_ok", "n_fail", F.when(F.col("n_ok") > 0, "ok").otherwise("not_run").alias("status"), r("gen_rate", "gen_rate"), r("wall_rate", "wall_rate"),
        r(ratio(F.col("gen_rate"), F.col("ref_gen")), "speedup"), r(ratio(F.col("wall_rate"), F.col("ref_wall")), "speedup_wall"),
        "draft_n", "draft_ok", r(accept, "accept_rate"), r(accept * draft_max, "accept_len"), r(ratio(F.col("e"), F.col("tok")), "j_per_token"))


def category_table(results: DataFrame, categories: Sequence[str]) -> DataFrame:
    """Median rate, configurations down and categories across."""
    m = median(results.filter("ok"), ["config", "category"], "gen_rate", "rate")
    return m.groupBy("config").pivot("category", list(categories)).agg(F.round(F.max("rate"), 6))
