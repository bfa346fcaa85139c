"""Confidence cascades: small students answer first, unsure items go on, the teacher takes the rest."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decant.session import attach, materialise

# Assumed board power in watts for the energy estimate.
BOARD_WATTS = {"S": 49.0, "M": 19.0, "L": 30.0, "teacher": 53.0}


def fill_latency(df: DataFrame, keys: Sequence[str], latency: str = "latency_ms") -> DataFrame:
    """Missing latencies take the mean of the known ones in their key group; ``known`` says whether there were any."""
    mean = df.groupBy(*keys).agg(F.avg(latency).alias("_mean"))
    d = df.join(mean, list(keys))
    return d.withColumns({latency: F.coalesce(latency, "_mean"), "known": F.col("_mean").isNotNull()}).drop("_mean")


def align(stages: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per item with a struct per stage (c = confidence, a = agrees, g = gold hit, l = latency).

    ``stages`` has (run, split, item_id, k, conf, agree, gold_ok, has_gold, tgold_ok, latency_ms).
    """
    one = F.struct(F.round("conf", 6).alias("c"), F.col("agree").cast("int").alias("a"), F.coalesce(F.col("gold_ok").cast("int"), F.lit(0)).alias("g"), F.col("latency_ms").alias("l"))
    return stages.groupBy("split", "item_id").agg(
        F.count(F.lit(1)).alias("n_stages"), F.min("k").alias("k_min"), F.max("k").alias("k_max"),
        F.bool_or("has_gold").alias("has_gold"), F.coalesce(F.max(F.col("tgold_ok").cast("int")), F.lit(0)).alias("tg"),
        *[F.max(F.when(F.col("run") == n, one)).alias(f"st{i}") for i, n in enumerate(names)])


def misaligned(aligned: DataFrame, names: Sequence[str]) -> DataFrame:
    """Items some stage lacks, or on which stages disagree about the number of candidates."""
    gap = reduce(lambda a, b: a | b, [F.col(f"st{i}").isNull() for i in range(len(names))])
    return aligned.filter(gap | (F.col("k_min") != F.col("k_max"))).select(
        "split", "item_id", F.when(gap, "missing stage").otherwise("candidate count").alias("problem"))


def evaluate(aligned: DataFrame, names: Sequence[str], taus: Sequence[float | None], watts: dict[str, float] | None = None) -> DataFrame:
    """Metrics per split for one threshold per stage; ``None`` leaves the stage out.

    ``aligned`` also has the teacher's latency in ``t_lat``. Every item's way through the stages is one
    expression, so this is a single aggregate.
    """
    watts = {**BOARD_WATTS, **(watts or {})}
    used = [i for i, t in enumerate(taus) if t is not None]
    d = aligned
    open_ = F.lit(True)
    for i in used:
        d = d.withColumns({f"r{i}": open_, f"x{i}": open_ & (F.col(f"st{i}.c") >= F.lit(float(taus[i])))})
        open_ = F.col(f"r{i}") & ~F.col(f"x{i}")
    d = d.withColumn("esc", open_)
    z = F.lit(0.0)
    pick = lambda f, last: reduce(lambda acc, i: F.when(F.col(f"x{i}"), F.col(f"st{i}.{f}")).otherwise(acc), reversed(used), last)
    lat = reduce(lambda a, b: a + b, [F.when(F.col(f"r{i}"), F.col(f"st{i}.l")).otherwise(z) for i in used], z)
    energy = reduce(lambda a, b: a + b, [F.when(F.col(f"r{i}"), F.col(f"st{i}.l") * watts[names[i]] / 1e3).otherwise(z) for i in used], z)
    t_lat = F.when(F.col("esc"), F.col("t_lat")).otherwise(z)
    d = d.withColumns({"fa": pick("a", F.lit(1)), "fg": pick("g", F.col("tg")), "slat": lat, "lat": lat + t_lat, "en": energy + t_lat * watts["teacher"] / 1e3})
    r = lambda c, n: F.round(c, 6).alias(n)
    rate = lambda c: F.avg(F.col(c).cast("double"))
    stage: list[Column] = []
    for i, n in enumerate(names):
        if i in used:
            stage += [r(rate(f"r{i}"), f"reach_{n}"), r(rate(f"x{i}"), f"accept_{n}"),
                      r(1 - F.count_if(f"x{i}") / F.greatest(F.lit(1), F.count_if(f"r{i}")), f"escalation_{n}"),
                      r(F.avg(F.when(F.col(f"x{i}"), F.col(f"st{i}.a"))), f"agreement_{n}")]
    return d.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("has_gold").alias("n_gold"), r(F.avg(F.when(F.col("has_gold"), F.col("fg"))), "accuracy_gold"),
        r(F.avg("fa"), "agreement"), r(F.avg("lat"), "mean_latency_ms"), r(F.avg("slat"), "mean_student_latency_ms"),
        r(rate("esc"), "teacher_escalation"), r(F.avg("en"), "energy_j_estimate"), *stage)


def singles(aligned: DataFrame, names: Sequence[str], watts: dict[str, float] | None = None) -> DataFrame:
    """Every stage alone, and the teacher alone, in one pass."""
    watts = {**BOARD_WATTS, **(watts or {})}
    rows = [F.struct(F.lit(n).alias("stage"), F.col(f"st{i}.a").alias("a"), F.col(f"st{i}.g").alias("g"), F.col(f"st{i}.l").alias("l"), F.lit(watts[n]).alias("w")) for i, n in enumerate(names)]
    rows.append(F.struct(F.lit("teacher").alias("stage"), F.lit(1).alias("a"), F.col("tg").alias("g"), F.col("t_lat").alias("l"), F.lit(watts["teacher"]).alias("w")))
    d = aligned.select("split", "has_gold", F.explode(F.array(*rows)).alias("x")).select("split", "has_gold", "x.*")
    r = lambda c, n: F.round(c, 6).alias(n)
    return d.groupBy("split", "stage").agg(
        r(F.avg(F.when(F.col("has_gold"), F.col("g"))), "accuracy_gold"), r(F.avg("a"), "agreement"), r(F.avg("l"), "mean_latency_ms"),
        r(F.avg(F.col("w") * F.col("l") / 1e3), "energy_j_estimate"))


def search_thresholds(aligned: DataFrame, names: Sequence[str], grid: Sequence[float], max_drop: float, max_combos: int = 3_000_000) -> DataFrame:
    """Best threshold per stage on the given items: agreement >= 1 - max_drop, then least escalation, latency, largest thresholds.

    Items are read once, into a cube keyed by how many grid values each confidence reaches. Stages are then
    unrolled one after the other over the cube, accepted cells leave as sums, so work depends on the grid only.
    """
    g, n_st = len(grid), len(names)
    if (g + 1) ** n_st > max_combos:
        raise ValueError(f"{(g + 1) ** n_st} combinations; use a coarser grid")
    steps = F.array(*[F.lit(float(x)) for x in grid])
    reached = lambda i: F.size(F.filter(steps, lambda x: F.col(f"st{i}.c") >= x))
    cell = [c for i in range(n_st) for c in (reached(i).alias(f"b{i}"), F.col(f"st{i}.a").alias(f"a{i}"))]
    cube = aligned.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("n"), F.sum("t_lat").alias("tl"), *[F.sum(f"st{i}.l").alias(f"l{i}") for i in range(n_st)])
    rem = cube = materialise(cube, "cascade-cube")
    acc = None
    for i in range(n_st):
        taus = [f"t{j}" for j in range(i)]
        x = rem.withColumn(f"t{i}", F.explode(F.sequence(F.lit(0), F.lit(g))))
        on = F.col(f"t{i}") < g
        taken = on & (F.col(f"b{i}") > F.col(f"t{i}"))
        add = x.groupBy(*taus, f"t{i}").agg(
            F.sum(F.when(taken, F.col(f"a{i}") * F.col("n")).otherwise(0)).alias("agree"), F.sum(F.when(on, F.col(f"l{i}")).otherwise(0.0)).alias("lat"))
        if acc is None:
            acc = add
        else:
            prev = acc.withColumnsRenamed({"agree": "agree0", "lat": "lat0"})
            # combinations whose items are all taken already have no rows left in ``rem``; they still go on
            spread = prev.withColumn(f"t{i}", F.explode(F.sequence(F.lit(0), F.lit(g))))
            acc = spread.join(add, [*taus, f"t{i}"], "left").select(
                *taus, f"t{i}", (F.col("agree0") + F.coalesce("agree", F.lit(0))).alias("agree"), (F.col("lat0") + F.coalesce("lat", F.lit(0.0))).alias("lat"))
        later = [c for j in range(i + 1, n_st) for c in (f"b{j}", f"a{j}")]
        rem = x.filter(~taken).groupBy(*taus, f"t{i}", *later).agg(
            F.sum("n").alias("n"), F.sum("tl").alias("tl"), *[F.sum(f"l{j}").alias(f"l{j}") for j in range(i + 1, n_st)])
    keys = [f"t{j}" for j in range(n_st)]
    d = attach(acc.join(rem.select(*keys, "n", "tl"), keys, "left"), cube.agg(F.sum("n").alias("total")))
    left = F.coalesce("n", F.lit(0))
    value = F.array(*[F.lit(float(x)) for x in grid], F.lit(1e6))
    d = d.select(
        *[F.when(F.col(k) < g, F.get(value, F.col(k))).alias(f"tau_{n}") for k, n in zip(keys, names)],
        ((F.col("agree") + left) / F.col("total")).alias("agreement"), (left / F.col("total")).alias("escalation"),
        F.round((F.col("lat") + F.coalesce("tl", F.lit(0.0))) / F.col("total"), 6).alias("mean_latency_ms"),
        F.round(sum((F.get(value, F.col(k)) for k in keys[1:]), F.get(value, F.col(keys[0]))), 6).alias("tau_sum"))
    return d.filter(F.col("agreement") + 1e-12 >= 1.0 - max_drop).orderBy("escalation", "mean_latency_ms", F.desc("tau_sum"), *[f"tau_{n}" for n in names]).limit(1)
