"""Invariants of the generator, distillation, and streams against their batch twins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from decant.operators import synth
from decant.operators.config import largest_remainder
from decant.plans import fixtures, streams
from decant.streaming import jobs


@pytest.fixture(scope="module")
def plan(spark):
    return synth.plan(spark.range(1200).withColumnRenamed("id", "idx"))


def test_quotas_are_exact(plan):
    got = {r.category: r["count"] for r in plan.groupBy("category").count().collect()}
    assert got == largest_remainder(1200, {k: float(v) for k, v in synth.CATEGORY_SHARES.items()})


def test_items_hold_the_contract(spark, plan):
    d = synth.generate(plan.withColumn("key", F.concat_ws(":", F.lit("t"), "idx"))).cache()
    assert d.filter("size(candidates) not between 2 and 5 or gold < 0 or gold >= size(candidates)").count() == 0
    assert d.filter("size(array_distinct(candidates)) <> size(candidates)").count() == 0
    assert d.filter("category = 'ambiguous' and gold is not null").count() == 0
    assert d.filter("category in ('nli', 'intent', 'ranking', 'sentiment') and gold is null").count() == 0
    again = synth.generate(plan.repartition(3).withColumn("key", F.concat_ws(":", F.lit("t"), "idx")))
    cols = ["idx", "context", "question", "candidates", "gold"]
    assert d.select(*cols).exceptAll(again.select(*cols)).count() == 0
    best = d.filter("category = 'ranking'").selectExpr("roles[gold] as r", "filter(roles, (x, i) -> i <> gold) as rest")
    assert best.filter("not (r like '%cheap%' or r like '%fast%' or r like '%great%')").count() == 0


def test_unique_and_append_never_repeat(spark, plan):
    a = synth.unique(plan, "train")
    b = synth.unique(plan.withColumn("idx", F.col("idx") + 5000), "train", existing=a.select("h"))
    u = a.select("h").unionByName(b.select("h"))
    assert u.count() == 2400 and u.distinct().count() == 2400


def test_unique_plans_stay_short_over_many_rounds(spark, monkeypatch):
    """A small phrase space: most draws clash, so it takes many rounds."""
    seen = []

    def draw(rows):
        seen.append(len(rows._jdf.queryExecution().optimizedPlan().toString().splitlines()))
        return rows.select("*", F.pmod(F.xxhash64("key"), F.lit(44)).cast("string").alias("context"), F.lit("q").alias("question"), F.array(F.lit("c")).alias("candidates"))

    monkeypatch.setattr(synth, "generate", draw)
    got = synth.unique(spark.range(40).withColumnRenamed("id", "idx"), "t")
    assert got.count() == 40 and got.select("context").distinct().count() == 40
    assert len(seen) > 8 and max(seen[1:]) == min(seen[1:])


def test_tiers_do_not_overlap(spark, plan):
    d = synth.scenarios(plan.withColumn("key", F.col("idx").cast("string")))
    tiers = [d.selectExpr(f"explode({synth.render(t)}) as c").distinct() for t in ("train", "unseen")]
    assert tiers[0].intersect(tiers[1]).count() == 0


def test_variants_never_keep_the_order(spark, sf):
    items = fixtures.dec_items(spark, sf)
    v = synth.variants(items)
    assert v.count() == 6 * items.count()
    j = v.filter("variant = 'perm'").join(items.selectExpr("item_id as variant_of", "candidates as base", "gold as g"), "variant_of")
    assert j.filter("candidates = base").count() == 0
    assert j.filter("g is not null and candidates[gold] <> base[g]").count() == 0


def test_distillation_lowers_the_loss(spark, sf):
    h = streams.ud_distill(spark, sf).orderBy("step").collect()
    assert h[-1].kl < h[0].kl * 0.5


def test_gradient_is_the_slope_of_the_loss():
    """Items of 1 to 5 candidates, with and without gold, against finite differences of the summed loss."""
    from decant.operators import distill

    rng = np.random.default_rng(4)
    size = np.array([3, 1, 5, 2, 4])
    x, z, gold = rng.normal(size=(15, 6)), rng.normal(size=15) * 2, np.array([2, -1, 0, -1, 3])
    w = rng.normal(size=6)
    out = distill.gradient_of(w, x, z, size, gold)
    assert out[0] == 5
    # the divergence alone, item by item
    softmax = lambda a: np.exp(a) / np.exp(a).sum()
    parts = [(softmax(a / 2), softmax(b / 2)) for a, b in zip(np.split(z, np.cumsum(size)[:-1]), np.split(x @ w, np.cumsum(size)[:-1]))]
    assert out[2] == pytest.approx(sum((p * np.log(p / q)).sum() for p, q in parts))
    for i in range(6):
        step = np.eye(6)[i] * 1e-6
        slope = (distill.gradient_of(w + step, x, z, size, gold)[1] - distill.gradient_of(w - step, x, z, size, gold)[1]) / 2e-6
        assert out[3 + i] == pytest.approx(slope, abs=1e-5)


def energy_run(spark, folder, schema, out, ck):
    with streams.rocksdb(spark):
        jobs.per_batch(jobs.energy_pieces(jobs.read(spark, folder, schema)), out, ck)


def test_energy_stream_resumes_where_it_stopped(spark, sf):
    d = fixtures.tel(spark, sf).select("card", "ts_us", "event_id", "power_w")
    half = d.approxQuantile("ts_us", [0.5], 0.01)[0]
    folder = jobs.scratch(spark, "resume")
    out, ck = jobs.new_paths(spark, "resume-energy")
    d.filter(F.col("ts_us") <= half).write.mode("append").parquet(folder)
    energy_run(spark, folder, d.schema, out, ck)
    d.filter(F.col("ts_us") > half).write.mode("append").parquet(folder)
    energy_run(spark, folder, d.schema, out, ck)
    from decant.operators import telemetry

    got = {r.card: r for r in jobs.stitch(jobs.latest(spark, out, ["card", "hour"])).collect()}
    for r in telemetry.trapezoid(telemetry.segments(d), ["card"]).collect():
        assert got[r.card].joules == pytest.approx(r.joules) and got[r.card].n == r.n


def test_hashes_and_winners_are_not_sent_to_every_task(spark, tmp_path, monkeypatch):
    """They grow with the items, however small their files are."""
    from decant.plans import synthetic

    plans, write = [], synth.materialise

    def noted(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().sparkPlan().toString())
        return write(df, name)

    monkeypatch.setattr(synth, "materialise", noted)
    spark.range(60).selectExpr("id as c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    out = synthetic.syn_append(spark, str(tmp_path))
    plans.append(out._jdf.queryExecution().sparkPlan().toString())
    joins = [line for p in plans for line in p.split("\n") if "Join" in line and ("[h#" in line or "[idx#" in line)]
    assert joins and not [line for line in joins if "Broadcast" in line]
    assert out.count() == 20 and out.filter("clash").count() == 0
