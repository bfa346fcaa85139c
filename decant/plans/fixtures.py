"""Decision tables derived from the driver's tables, in Spark and in SQL.

Both sides follow the same written rule; the SQL works on one row per candidate, the Spark side on one
row per item holding short arrays, so the two are independent computations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decant.functions import dist as D
from decant.functions import hashing as H
from decant.plans.registry import cte, table
from decant.session import attach

DIMS = 64
CUTS = (16, 32, 48, 64)
SCALE = 60.0
SCORE_NAMES = ("s16", "s32", "s48", "t")


# ---- Spark side ----------------------------------------------------------------------------

def centroids(spark: SparkSession, sf: str) -> DataFrame:
    """One row per label: the mean vector. One map-side-combined aggregate of 64 averages."""
    e = table(spark, sf, "embeddings")
    means = ", ".join(f"avg(double(embedding[{i}]))" for i in range(DIMS))
    return e.groupBy("label").agg(F.expr(f"array({means})").alias("c"))


def score_arrays(spark: SparkSession, sf: str, labels: str) -> DataFrame:
    """Item rows with ``labs`` and aligned score arrays s16, s32, s48, t.

    The centroid table has one row per label and 64 numbers per row, so it is one small value.
    """
    e = table(spark, sf, "embeddings").withColumn("labs", F.expr(labels))
    c = centroids(spark, sf).groupBy().agg(F.expr("map_from_entries(collect_list(struct(label, c)))").alias("cents"))
    parts = ", ".join(
        D.dot(f"slice(embedding, {lo + 1}, {hi - lo})", f"slice(element_at(cents, lab), {lo + 1}, {hi - lo})")
        for lo, hi in zip((0, *CUTS[:-1]), CUTS))
    d = attach(e, c).withColumn("parts", F.expr(f"transform(labs, lab -> array({parts}))"))
    prefix = [
        f"transform(parts, p -> round({' + '.join(f'p[{j}]' for j in range(i + 1))}, 6)) as {n}" for i, n in enumerate(SCORE_NAMES)]
    return d.selectExpr("vec_id as item_id", "label as gold_label", "labs", *prefix)


def dec_scores(spark: SparkSession, sf: str) -> DataFrame:
    """One row per item x label: t, s16, s32, s48."""
    d = score_arrays(spark, sf, "sequence(0, 9)")
    return d.selectExpr("item_id", "gold_label", "inline(arrays_zip(labs, t, s16, s32, s48))").withColumnRenamed("labs", "cand")


ITEM_LABELS = f"""transform(array_sort(transform(
    transform(sequence(0, cast(2 + vec_id % 8 as int)), j -> (label + j) % 10),
    x -> struct({H.rank_text("vec_id", "x")} as h, x as lab))), s -> s.lab)"""
SEED_BUCKET = f"cast(conv(substr({H.rank_text(repr('dec'), 'item_id')}, 1, 8), 16, 10) as bigint) % 2147483648"
SPLIT = f"case when {SEED_BUCKET} % 100 < 60 then 'train' when {SEED_BUCKET} % 100 < 80 then 'val' else 'test' end as split"
GOLD = "if(item_id % 7 <> 0, cast(array_position(labs, gold_label) - 1 as int), null) as gold"
SOURCE = "element_at(array('synth', 'a', 'b', 'c'), cast(item_id % 4 + 1 as int)) as source"
CATEGORY = "element_at(array('intent', 'nli', 'ranking'), cast(item_id % 3 + 1 as int)) as category"
LANG = "if(gold_label % 2 = 0, 'en', 'ja') as lang"


def item_base(spark: SparkSession, sf: str) -> DataFrame:
    """Items with their score arrays in candidate order (t, s16, s32, s48)."""
    d = score_arrays(spark, sf, ITEM_LABELS)
    return d.selectExpr("item_id", "gold_label", "labs", "size(labs) as k", GOLD, SPLIT, SOURCE, CATEGORY, LANG, *SCORE_NAMES)


def dec_items(spark: SparkSession, sf: str) -> DataFrame:
    """Items in the store's column layout; candidates as array<string>. Needs no scores."""
    d = table(spark, sf, "embeddings").selectExpr("vec_id as item_id", "label as gold_label", f"{ITEM_LABELS} as labs")
    return d.selectExpr(
        "item_id", SPLIT, CATEGORY, LANG, "concat('context ', item_id % 97) as context", "concat('question ', gold_label) as question",
        "transform(labs, x -> concat('topic ', x)) as candidates", GOLD, "cast(null as bigint) as variant_of", "cast(null as string) as variant",
        f"{SEED_BUCKET} as gen_seed", SOURCE, "to_json(struct(gold_label as label)) as extra")


def dec_teacher(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("item_id")
    d = item_base(spark, sf).filter(i % 9 != 0)
    d = d.withColumn("logits", F.expr(f"transform(t, x -> x * {SCALE}D)"))
    return d.select(
        "item_id", F.lit("teacher-a").alias("teacher_model"), F.lit("label-logprob").alias("method"),
        "logits", F.expr(D.softmax("logits")).alias("probs"), F.lit(None).cast("string").alias("raw"),
        F.when(i % 11 != 0, (F.lit(800) + i % 7).cast("double")).alias("latency_ms"),
        F.timestamp_seconds(F.lit(1790000000) + i).alias("created_at"),
    )


def dec_teacher_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Key side of the teacher table, for operators that only ask whether a row exists."""
    i = F.col("item_id")
    d = table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id")).filter(i % 9 != 0)
    return d.withColumn("latency_ms", F.when(i % 11 != 0, (F.lit(800) + i % 7).cast("double")))


def dec_errors(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("item_id")
    d = table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"))
    return d.filter((i % 9 == 0) & (i % 2 == 0)).select(
        "item_id", (F.lit(1) + i % 3).cast("int").alias("attempts"),
        F.concat(F.lit("timeout "), i.cast("string")).alias("error"),
        F.timestamp_seconds(F.lit(1790000000) + i).alias("updated_at"),
    )


RUNS = (("S", "s16", 4), ("M", "s32", 8), ("L", "s48", 12))


def dec_preds(spark: SparkSession, sf: str) -> DataFrame:
    """One row per run x item; score arrays s (student) and t (teacher), already scaled."""
    runs = ", ".join(
        f"struct('{r}' as run, transform({c}, x -> x * {SCALE}D) as s, double({base} + item_id % 5) as latency_ms)" for r, c, base in RUNS)
    d = item_base(spark, sf).selectExpr(
        "split", "source", "item_id", "k", "gold", "labs", f"transform(t, x -> x * {SCALE}D) as t", f"explode(array({runs})) as r")
    return d.select("r.run", "split", "source", "item_id", "k", "gold", "labs", "r.s", "t", "r.latency_ms")


def dec_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Three perturbations of each test item, per run: reversed, flattened and position-shifted scores."""
    d = dec_preds(spark, sf).filter("split = 'test'")
    kinds = """array(
        struct('perm' as variant, reverse(s) as s, reverse(t) as t, reverse(labs) as labs, k - 1 - gold as gold, 1 as n),
        struct('ambiguous' as variant, transform(s, x -> x * 0.2D) as s, transform(t, x -> x * 0.2D) as t, labs, cast(null as int) as gold, 2 as n),
        struct('irrelevant_ctx' as variant, transform(s, (x, p) -> x + (p % 3) * 0.6D) as s, t, labs, gold, 3 as n))"""
    d = d.selectExpr("run", "item_id as variant_of", "k", f"explode({kinds}) as v")
    return d.selectExpr("run", "variant_of * 10 + v.n as item_id", "v.variant", "variant_of", "k", "v.gold", "v.labs", "v.s", "v.t")


def dec_perm_logprobs(spark: SparkSession, sf: str) -> DataFrame:
    """Long label log-probabilities for the identity and the reversed candidate order."""
    d = item_base(spark, sf).selectExpr("item_id", "k", f"transform(t, x -> x * {SCALE}D) as lg")
    d = d.selectExpr("item_id", "k", f"{D.logsumexp('lg')} as lse", "posexplode(lg) as (cand_pos, x)")
    d = d.selectExpr("*", "explode(array('identity', 'reverse')) as perm")
    d = d.withColumn("display_pos", F.expr("if(perm = 'identity', cand_pos, k - 1 - cand_pos)"))
    return d.selectExpr(
        "item_id", "k", "perm", "display_pos", "cand_pos",
        "if((item_id + display_pos) % 17 <> 0, round(x - lse + if(display_pos = 0, 0.3D, 0D), 6), null) as logprob")


def emb_roles(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings with retrieval roles; the student space is the first 32 dimensions."""
    v = F.col("vec_id")
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("uid"), F.concat(F.lit("i"), F.col("label").cast("string")).alias("intent"),
        F.when(F.col("label") % 2 == 0, "en").otherwise("ja").alias("lang"),
        (v % 5 == 0).alias("unseen"), (v % 10).alias("grp"),
        F.expr("cast(embedding as array<double>)").alias("vec"), F.expr("cast(slice(embedding, 1, 32) as array<double>)").alias("svec"),
    )


def tel(spark: SparkSession, sf: str) -> DataFrame:
    """Telemetry samples read from the events table; ts_us is the time in integer microseconds."""
    i = F.col("event_id")
    return table(spark, sf, "events").select(
        "event_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        F.when(F.col("user_id") % 2 == 0, "rx").otherwise("wx").alias("card"),
        F.col("event_type").alias("config"),
        F.when(i % 13 != 0, F.col("value")).alias("power_w"),
        F.round(F.lit(60.0) + F.col("value") % 35, 2).alias("temp_c"),
        F.when(i % 3 != 0, F.round(F.col("value") * 10, 1)).alias("vram_mb"),
    )


def tel_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Every tenth event opens a 30 minute request window on its card."""
    d = table(spark, sf, "events").filter("event_id % 10 = 0")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return d.select(
        F.col("event_id").alias("req_id"), F.when(F.col("user_id") % 2 == 0, "rx").otherwise("wx").alias("card"),
        us.alias("t0"), (us + 1800000000).alias("t1"),
    )


def bench_results(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark request log read from lineitem; category is the part's size class."""
    li = table(spark, sf, "lineitem")
    ok = F.col("l_orderkey") % 20 != 0
    return li.select(
        F.concat("l_returnflag", F.lit("|"), "l_linestatus").alias("config"),
        F.col("l_linenumber").alias("rep"), F.col("l_orderkey").alias("req"),
        (F.col("l_partkey") % 8).alias("prompt_id"),
        F.concat(F.lit("cat"), (F.col("l_partkey") % 3).cast("string")).alias("category"),
        ok.alias("ok"),
        F.when(ok, F.col("l_quantity").cast("int")).alias("tokens_predicted"),
        F.when(ok, F.round(F.col("l_extendedprice") / 10007, 4)).alias("wall_s"),
        F.when(ok, F.round(F.col("l_extendedprice") / (F.col("l_quantity") + 0.37), 4)).alias("gen_rate"),
        F.when(ok, F.sha1(F.year("l_shipdate").cast("string"))).alias("sha"),
        F.when(ok, F.col("l_suppkey") % 50).alias("draft_n"),
        F.when(ok, F.col("l_suppkey") % 50 - F.col("l_suppkey") % 7 % (F.col("l_suppkey") % 50 + 1)).alias("draft_ok"),
        F.when(ok & (F.col("l_suppkey") % 5 != 0), F.round(F.col("l_tax") * 100, 2)).alias("energy_j"),
    )


def run_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Training log read from orders: run = custkey % 12, ordered by (orderdate, orderkey)."""
    o = table(spark, sf, "orders")
    has = F.col("o_orderstatus") == "F"
    return o.select(
        (F.col("o_custkey") % 12).alias("run"),
        F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("at_us"), F.col("o_orderkey").alias("okey"),
        F.when(has, F.round(F.col("o_totalprice") / 100003, 4)).alias("val_kl"),
        F.round(F.lit(60.0) + F.col("o_totalprice") % 35, 2).alias("temp_c"),
        F.when(F.col("o_orderkey") % 4 != 0, F.round(F.col("o_totalprice") / 1009, 2)).alias("samples_per_s"),
        (F.col("o_orderkey") % 64 + 1).cast("int").alias("n"),
        (F.col("o_orderkey") % 17).cast("int").alias("n_gold"),
        (F.col("o_totalprice") / 30011).alias("loss"),
        (F.col("o_totalprice") % 7 / 1.0007).alias("ce"),
        (F.lit(0.5) + F.col("o_custkey") % 10 / 1.0007).alias("dt"),
    )


# ---- SQL side ------------------------------------------------------------------------------

SEED_SQL = "('0x' || substr(sha1('20261006:{0}:' || {1}), 1, 8))::BIGINT % 2147483648"


def seed_sql(source: str, key: str) -> str:
    return SEED_SQL.format(source, key)


def rank_sql(*parts: str) -> str:
    """sha1 sort key over SQL expressions."""
    return "sha1('20261006:' || " + " || ':' || ".join(parts) + ")"


def unif_sql(*parts: str) -> str:
    return f"(('0x' || substr({rank_sql(*parts)}, 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


cte("dims", "SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS d FROM embeddings")
cte("cent", "SELECT label, d, avg(v) AS c FROM dims GROUP BY label, d", "dims")
cte("dec_scores", """
SELECT e.vec_id AS item_id, c.label AS cand, any_value(e.label) AS gold_label,
       round(sum(e.v * c.c), 6) AS t,
       round(sum(e.v * c.c) FILTER (e.d <= 16), 6) AS s16,
       round(sum(e.v * c.c) FILTER (e.d <= 32), 6) AS s32,
       round(sum(e.v * c.c) FILTER (e.d <= 48), 6) AS s48
FROM dims e JOIN cent c ON e.d = c.d GROUP BY e.vec_id, c.label""", "dims", "cent")
cte("item_pos", f"""
SELECT vec_id AS item_id, lab, label AS gold_label, 3 + vec_id % 8 AS k,
       row_number() OVER (PARTITION BY vec_id ORDER BY {rank_sql('vec_id', 'lab')}) - 1 AS pos
FROM (SELECT vec_id, label, (label + unnest(range(0, 3 + vec_id % 8))) % 10 AS lab FROM embeddings)""")
cte("item_attr", f"""
SELECT item_id, any_value(k)::INTEGER AS k, any_value(gold_label) AS gold_label,
       CASE WHEN item_id % 7 <> 0 THEN max(CASE WHEN lab = gold_label THEN pos END) END::INTEGER AS gold,
       CASE WHEN any_value(sd) < 60 THEN 'train' WHEN any_value(sd) < 80 THEN 'val' ELSE 'test' END AS split,
       ['synth', 'a', 'b', 'c'][item_id % 4 + 1] AS source,
       ['intent', 'nli', 'ranking'][item_id % 3 + 1] AS category,
       CASE WHEN any_value(gold_label) % 2 = 0 THEN 'en' ELSE 'ja' END AS lang,
       list('topic ' || lab ORDER BY pos) AS candidates,
       'context ' || (item_id % 97) AS context, 'question ' || any_value(gold_label) AS question,
       any_value(gs) AS gen_seed
FROM (SELECT *, {seed_sql('dec', 'item_id')} AS gs, ({seed_sql('dec', 'item_id')}) % 100 AS sd FROM item_pos)
GROUP BY item_id""", "item_pos")
cte("dec_long", """
SELECT p.item_id, p.pos, p.lab, a.k, a.gold, a.split, a.source, a.category, a.lang, s.t, s.s16, s.s32, s.s48
FROM item_pos p JOIN item_attr a USING (item_id) JOIN dec_scores s ON s.item_id = p.item_id AND s.cand = p.lab""",
    "item_pos", "item_attr", "dec_scores")
cte("teacher_keys", """
SELECT vec_id AS item_id, CASE WHEN vec_id % 11 <> 0 THEN (800 + vec_id % 7)::DOUBLE END AS latency_ms,
       1790000000 + vec_id AS created_s
FROM embeddings WHERE vec_id % 9 <> 0""")
cte("teacher_long", """
SELECT *, 60.0 * t AS logit, exp(60.0 * t - mx) / sum(exp(60.0 * t - mx)) OVER (PARTITION BY item_id) AS p
FROM (SELECT *, max(60.0 * t) OVER (PARTITION BY item_id) AS mx FROM dec_long) WHERE item_id % 9 <> 0""", "dec_long")
cte("errors", """
SELECT vec_id AS item_id, (1 + vec_id % 3)::INTEGER AS attempts, 'timeout ' || vec_id AS error
FROM embeddings WHERE vec_id % 9 = 0 AND vec_id % 2 = 0""")
cte("pred_raw", """
SELECT r.run, d.item_id, d.pos, d.lab, d.k, d.gold, d.split, d.source, 60.0 * d.t AS t,
       60.0 * CASE r.run WHEN 'S' THEN d.s16 WHEN 'M' THEN d.s32 ELSE d.s48 END AS s,
       (r.base + d.item_id % 5)::DOUBLE AS latency_ms
FROM dec_long d, (VALUES ('S', 4), ('M', 8), ('L', 12)) r(run, base)""", "dec_long")


def soften_sql(src: str) -> str:
    """Per-candidate softmax columns (temperature 1 and 2) over any table with run, item_id, pos, s, t."""
    return f"""
SELECT *, exp(s - ms) / sum(exp(s - ms)) OVER w AS ps, exp(t - mt) / sum(exp(t - mt)) OVER w AS pt,
       exp((s - ms) / 2) / sum(exp((s - ms) / 2)) OVER w AS ps2, exp((t - mt) / 2) / sum(exp((t - mt) / 2)) OVER w AS pt2
FROM (SELECT *, max(s) OVER (PARTITION BY run, item_id) AS ms, max(t) OVER (PARTITION BY run, item_id) AS mt FROM {src})
WINDOW w AS (PARTITION BY run, item_id)"""


def per_item_sql(src: str, extra: str = "") -> str:
    """Per-item evaluation columns over the output of ``soften_sql``."""
    return f"""
SELECT run, item_id, any_value(k) AS k, any_value(gold) AS gold, {extra}
       arg_min(pos, (-s, pos)) AS pred, arg_min(pos, (-t, pos)) AS tpred,
       max(ps) AS smax, max(pt) AS tmax,
       sum(CASE WHEN pt > 0 THEN pt * (ln(pt) - ln(greatest(ps, 1e-300))) ELSE 0 END) AS kl,
       4 * sum(CASE WHEN pt2 > 0 THEN pt2 * (ln(pt2) - ln(greatest(ps2, 1e-300))) ELSE 0 END) AS kd,
       -sum(CASE WHEN ps > 0 THEN ps * ln(ps) ELSE 0 END) AS hs,
       -sum(CASE WHEN pt > 0 THEN pt * ln(pt) ELSE 0 END) AS ht,
       sum((ps - pt) * (ps - pt)) AS bt,
       -ln(greatest(max(CASE WHEN pos = gold THEN ps END), 1e-300)) AS ce,
       -ln(greatest(max(CASE WHEN pos = gold THEN pt END), 1e-300)) AS tce,
       sum((ps - CASE WHEN pos = gold THEN 1 ELSE 0 END) ** 2) AS bs,
       sum((pt - CASE WHEN pos = gold THEN 1 ELSE 0 END) ** 2) AS tbs
FROM {src} GROUP BY run, item_id"""


cte("pred_long", soften_sql("pred_raw"), "pred_raw")
cte("per_item", per_item_sql("pred_long", "any_value(split) AS split, any_value(source) AS source, any_value(latency_ms) AS latency_ms,"), "pred_long")
cte("var_raw", """
SELECT p.run, p.item_id * 10 + v.n AS item_id, v.variant, p.item_id AS variant_of, p.k,
       CASE v.n WHEN 1 THEN p.k - 1 - p.pos ELSE p.pos END AS pos, p.lab,
       CASE v.n WHEN 1 THEN p.k - 1 - p.gold WHEN 3 THEN p.gold END AS gold,
       CASE v.n WHEN 2 THEN p.s * 0.2 WHEN 3 THEN p.s + (p.pos % 3) * 0.6 ELSE p.s END AS s,
       CASE v.n WHEN 2 THEN p.t * 0.2 ELSE p.t END AS t
FROM pred_raw p, (VALUES ('perm', 1), ('ambiguous', 2), ('irrelevant_ctx', 3)) v(variant, n) WHERE p.split = 'test'""", "pred_raw")
cte("var_long", soften_sql("var_raw"), "var_raw")
cte("var_item", per_item_sql("var_long", "any_value(variant) AS variant, any_value(variant_of) AS variant_of,"), "var_long")
cte("perm_lp", """
SELECT item_id, k, perm, display_pos, pos AS cand_pos,
       CASE WHEN (item_id + display_pos) % 17 <> 0 THEN
         round(60.0 * t - lse + CASE WHEN display_pos = 0 THEN 0.3 ELSE 0.0 END, 6) END AS logprob
FROM (SELECT d.*, o.perm, CASE o.perm WHEN 'identity' THEN d.pos ELSE d.k - 1 - d.pos END AS display_pos
      FROM (SELECT *, mx + ln(sum(exp(60.0 * t - mx)) OVER (PARTITION BY item_id)) AS lse
            FROM (SELECT *, max(60.0 * t) OVER (PARTITION BY item_id) AS mx FROM dec_long)) d,
           (VALUES ('identity'), ('reverse')) o(perm))""", "dec_long")
cte("roles", """
SELECT vec_id AS uid, 'i' || label AS intent, CASE WHEN label % 2 = 0 THEN 'en' ELSE 'ja' END AS lang,
       vec_id % 5 = 0 AS unseen, vec_id % 10 AS grp, embedding::DOUBLE[] AS vec, embedding[1:32]::DOUBLE[] AS svec
FROM embeddings""")
cte("tel", """
SELECT event_id, ts, epoch_us(ts) AS ts_us, CASE WHEN user_id % 2 = 0 THEN 'rx' ELSE 'wx' END AS card, event_type AS config,
       CASE WHEN event_id % 13 <> 0 THEN value END AS power_w, round(60.0 + value % 35, 2) AS temp_c,
       CASE WHEN event_id % 3 <> 0 THEN round(value * 10, 1) END AS vram_mb
FROM events""")
cte("tel_requests", """
SELECT event_id AS req_id, CASE WHEN user_id % 2 = 0 THEN 'rx' ELSE 'wx' END AS card,
       epoch_us(ts) AS t0, epoch_us(ts) + 1800000000 AS t1
FROM events WHERE event_id % 10 = 0""")
cte("bench", """
SELECT l_returnflag || '|' || l_linestatus AS config, l_linenumber AS rep, l_orderkey AS req, l_partkey % 8 AS prompt_id,
       'cat' || (l_partkey % 3) AS category, l_orderkey % 20 <> 0 AS ok,
       CASE WHEN l_orderkey % 20 <> 0 THEN l_quantity::INTEGER END AS tokens_predicted,
       CASE WHEN l_orderkey % 20 <> 0 THEN round(l_extendedprice / 10007, 4) END AS wall_s,
       CASE WHEN l_orderkey % 20 <> 0 THEN round(l_extendedprice / (l_quantity + 0.37), 4) END AS gen_rate,
       CASE WHEN l_orderkey % 20 <> 0 THEN sha1(year(l_shipdate)::VARCHAR) END AS sha,
       CASE WHEN l_orderkey % 20 <> 0 THEN l_suppkey % 50 END AS draft_n,
       CASE WHEN l_orderkey % 20 <> 0 THEN l_suppkey % 50 - l_suppkey % 7 % (l_suppkey % 50 + 1) END AS draft_ok,
       CASE WHEN l_orderkey % 20 <> 0 AND l_suppkey % 5 <> 0 THEN round(l_tax * 100, 2) END AS energy_j
FROM lineitem""")
cte("runlog", """
SELECT o_custkey % 12 AS run, epoch_us(o_orderdate) AS at_us, o_orderkey AS okey,
       CASE WHEN o_orderstatus = 'F' THEN round(o_totalprice / 100003, 4) END AS val_kl,
       round(60.0 + o_totalprice % 35, 2) AS temp_c,
       CASE WHEN o_orderkey % 4 <> 0 THEN round(o_totalprice / 1009, 2) END AS samples_per_s,
       (o_orderkey % 64 + 1)::INTEGER AS n, (o_orderkey % 17)::INTEGER AS n_gold,
       o_totalprice / 30011 AS loss, o_totalprice % 7 / 1.0007::DOUBLE AS ce, 0.5::DOUBLE + (o_custkey % 10) / 1.0007::DOUBLE AS dt,
       row_number() OVER (PARTITION BY o_custkey % 12 ORDER BY o_orderdate, o_orderkey) AS step
FROM orders""")
