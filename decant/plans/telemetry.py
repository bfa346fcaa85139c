"""Telemetry, benchmark and run-log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from decant.functions.dist import ratio
from decant.operators import bench as B
from decant.operators import runs as U
from decant.operators import telemetry as T
from decant.operators.prefix import neighbours, prefix, report_windows, running_min
from decant.operators.quantiles import auc, average_ranks, median
from decant.plans import fixtures as X
from decant.plans.registry import cte, query, table, with_
from decant.session import attach, scratch
from decant.sources import readers as R

GAP = 2 * T.HOUR
r6 = lambda c, n: F.round(c, 6).alias(n)
r3 = lambda c, n: F.round(c, 3).alias(n)

cte("seg", """
SELECT *, lag(ts_us) OVER w AS pt, lag(power_w) OVER w AS pp FROM tel WHERE power_w IS NOT NULL WINDOW w AS (PARTITION BY card ORDER BY ts_us, event_id)""", "tel")
cte("guard", """
SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY card ORDER BY ts_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS paused
FROM (SELECT *, CASE WHEN temp_c >= 88 THEN 1 WHEN temp_c <= 78 THEN 0 END AS mark FROM tel)""", "tel")


@query("wn_trapezoid", with_("seg") + """
SELECT card, count(*) AS n, round(sum(CASE WHEN ts_us > pt THEN (ts_us - pt) / 1e6 * (power_w + pp) / 2 END), 3) AS joules, round(sum((ts_us - pt) / 1e6), 3) AS seconds FROM seg GROUP BY card""")
def wn_trapezoid(spark, sf):
    d = T.trapezoid(T.segments(X.tel(spark, sf)), ["card"])
    return d.select("card", "n", r3("joules", "joules"), r3("seconds", "seconds"))


@query("jn_interval_energy", with_("seg", "tel_requests") + """
, j AS (SELECT q.req_id, q.t0, q.t1, s.ts_us, s.power_w, CASE WHEN s.pt >= q.t0 - 7200000000 THEN s.pt END AS pt, s.pp, greatest(s.pt, q.t0) AS lo, least(s.ts_us, q.t1) AS hi
   FROM tel_requests q JOIN seg s ON s.card = q.card AND s.ts_us BETWEEN q.t0 - 7200000000 AND q.t1 + 7200000000),
 a AS (SELECT req_id, sum(CASE WHEN pt IS NOT NULL AND hi > lo THEN (hi - lo) / 1e6 * ((pp + (power_w - pp) * (lo - pt) / (ts_us - pt)) + (pp + (power_w - pp) * (hi - pt) / (ts_us - pt))) / 2 ELSE 0 END) AS inner_j,
   min(ts_us) AS ft, arg_min(power_w, ts_us) AS fp, max(ts_us) AS lt, arg_max(power_w, ts_us) AS lp FROM j GROUP BY req_id)
SELECT q.req_id, q.card, round(CASE WHEN ft - t0 <= 7200000000 AND t1 - lt <= 7200000000 THEN inner_j + greatest(least(ft, t1) - t0, 0) / 1e6 * fp + greatest(t1 - greatest(lt, t0), 0) / 1e6 * lp END, 3) AS joules
FROM tel_requests q LEFT JOIN a USING (req_id)""")
def jn_interval_energy(spark, sf):
    d = T.interval_energy(X.tel_requests(spark, sf), T.segments(X.tel(spark, sf)), GAP)
    return d.select("req_id", "card", r3("joules", "joules"))


@query("jn_asof_edge", with_("tel", "tel_requests") + """
, s AS (SELECT card, ts_us, event_id, power_w FROM tel WHERE power_w IS NOT NULL),
 e AS (SELECT req_id, card, t0 AS t FROM tel_requests),
 b AS (SELECT e.*, s.ts_us AS ta, s.power_w AS pa FROM e ASOF LEFT JOIN s ON e.card = s.card AND e.t >= s.ts_us),
 c AS (SELECT b.*, s.ts_us AS tb, s.power_w AS pb FROM b ASOF LEFT JOIN s ON b.card = s.card AND b.t <= s.ts_us)
SELECT req_id AS edge_id, card, round(CASE WHEN ta IS NOT NULL AND tb IS NOT NULL THEN CASE WHEN ta = tb THEN pa ELSE pa + (pb - pa) * (t - ta) / (tb - ta) END
  WHEN tb - t <= 7200000000 THEN pb WHEN t - ta <= 7200000000 THEN pa END, 6) AS power_w FROM c""")
def jn_asof_edge(spark, sf):
    e = X.tel_requests(spark, sf).select(F.col("req_id").alias("edge_id"), "card", F.col("t0").alias("t"))
    return T.edge_power(e, X.tel(spark, sf), GAP).select("edge_id", "card", r6("power_w", "power_w"))


@query("sg_temp_guard", with_("guard") + """
SELECT card, count(*) AS n, sum(paused)::BIGINT AS n_paused, round(sum(CASE WHEN pp = 1 THEN (ts_us - pt) / 1e6 ELSE 0 END), 3) AS paused_s FROM (
  SELECT *, lag(paused) OVER w AS pp, lag(ts_us) OVER w AS pt FROM guard WINDOW w AS (PARTITION BY card ORDER BY ts_us, event_id)) GROUP BY card""")
def sg_temp_guard(spark, sf):
    d = T.guard_states(X.tel(spark, sf).drop("ts"))
    d = neighbours(d, ["card"], ["ts_us", "event_id"], T.time_bucket(), lag={"was": "paused", "at": "ts_us"})
    return d.groupBy("card").agg(F.count(F.lit(1)).alias("n"), F.sum("paused").cast("bigint").alias("n_paused"),
                                 r3(F.sum(F.when(F.col("was") == 1, (F.col("ts_us") - F.col("at")) / 1e6).otherwise(0.0)), "paused_s"))


cte("pauses", """
SELECT card, since AS start_us, ts_us AS end_us FROM (
  SELECT *, lag(ts_us) OVER (PARTITION BY card ORDER BY ts_us, event_id) AS since FROM (
    SELECT *, coalesce(lag(paused) OVER (PARTITION BY card ORDER BY ts_us, event_id), 0) AS was FROM guard) WHERE paused <> was) WHERE paused = 0 AND since IS NOT NULL""", "guard")


@query("sg_session_pauses", with_("pauses") + "SELECT card, start_us, end_us, round((end_us - start_us) / 1e6, 3) AS seconds FROM pauses")
def sg_session_pauses(spark, sf):
    d = T.pauses(T.guard_states(X.tel(spark, sf).drop("ts")))
    return d.select("card", "start_us", "end_us", r3("seconds", "seconds"))


@query("ag_telemetry_peaks", with_("tel") + """
SELECT config, max(CASE card WHEN 'rx' THEN vram_mb END) AS rx_vram_mb, max(CASE card WHEN 'rx' THEN temp_c END) AS rx_temp_c, max(CASE card WHEN 'rx' THEN power_w END) AS rx_power_w,
  max(CASE card WHEN 'wx' THEN vram_mb END) AS wx_vram_mb, max(CASE card WHEN 'wx' THEN temp_c END) AS wx_temp_c, max(CASE card WHEN 'wx' THEN power_w END) AS wx_power_w FROM tel GROUP BY config""")
def ag_telemetry_peaks(spark, sf):
    d = X.tel(spark, sf)
    return d.groupBy("config").pivot("card", ["rx", "wx"]).agg(*[F.max(c).alias(c) for c in ("vram_mb", "temp_c", "power_w")])


@query("sg_telemetry_windows_batch", with_("tel") + """
SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS start_us, config, card, count(*) AS n, round(avg(power_w), 6) AS power_mean, max(temp_c) AS temp_max FROM tel GROUP BY ALL""")
def sg_telemetry_windows_batch(spark, sf):
    d = X.tel(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    d = d.groupBy(F.window("ts", "1 hour").alias("w"), "config", "card").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("power_w"), "power_mean"), F.max("temp_c").alias("temp_max"))
    return d.select(F.unix_micros("w.start").alias("start_us"), "config", "card", "n", "power_mean", "temp_max")


@query("ag_energy_per_sample", with_("seg", "pauses") + """
, e AS (SELECT card, sum((ts_us - pt) / 1e6 * (power_w + pp) / 2) AS j, sum((ts_us - pt) / 1e6) AS s FROM seg GROUP BY card),
 w AS (SELECT card, count(*) AS samples, (max(ts_us) - min(ts_us)) / 1e6 AS wall FROM tel GROUP BY card),
 p AS (SELECT card, sum((end_us - start_us) / 1e6) AS paused FROM pauses GROUP BY card)
SELECT card, round(j / s, 6) AS power_mean_w, round(j / s * (wall - coalesce(paused, 0)), 3) AS energy_j, round(j / s * (wall - coalesce(paused, 0)) / samples, 6) AS energy_per_sample_j
FROM w LEFT JOIN e USING (card) LEFT JOIN p USING (card)""")
def ag_energy_per_sample(spark, sf):
    t = X.tel(spark, sf).drop("ts")
    e = T.trapezoid(T.segments(t), ["card"]).drop("n")
    p = T.pauses(T.guard_states(t)).groupBy("card").agg(F.sum("seconds").alias("paused"))
    w = t.groupBy("card").agg(F.count(F.lit(1)).alias("samples"), ((F.max("ts_us") - F.min("ts_us")) / 1e6).alias("wall"))
    w = w.join(p, "card", "left").withColumn("active_s", F.col("wall") - F.coalesce("paused", F.lit(0.0)))
    return U.energy_per_sample(e, w, "card").select("card", r6("power_mean_w", "power_mean_w"), r3("energy_j", "energy_j"), r6("energy_per_sample_j", "energy_per_sample_j"))


# ---- benchmark -----------------------------------------------------------------------------

REF = "N|O"


@query("jn_ref_hash", with_("bench") + f"""
, m AS (SELECT prompt_id, min((rep, req, sha)) AS m FROM (SELECT prompt_id, rep, req, sha FROM bench WHERE config = '{REF}' AND ok) GROUP BY prompt_id)
SELECT config, count(*) FILTER (sha = m[3]) AS match_n, count(*) AS match_total, round(count(*) FILTER (sha = m[3]) / count(*), 6) AS match_rate
FROM bench JOIN m USING (prompt_id) WHERE ok AND NOT (config = '{REF}' AND rep = m[1] AND req = m[2]) GROUP BY config""")
def jn_ref_hash(spark, sf):
    return B.match_rates(X.bench_results(spark, sf), REF)


@query("ag_bench_config", with_("bench") + f"""
, c AS (SELECT config, count(*) FILTER (ok) AS n_ok, count(*) FILTER (NOT ok) AS n_fail, median(gen_rate) AS g, median(tokens_predicted / nullif(wall_s, 0)) AS w,
   sum(draft_n)::BIGINT AS draft_n, sum(draft_ok)::BIGINT AS draft_ok, sum(energy_j) AS e, sum(CASE WHEN energy_j IS NOT NULL THEN tokens_predicted END) AS tok FROM bench GROUP BY config)
SELECT config, n_ok, n_fail, CASE WHEN n_ok > 0 THEN 'ok' ELSE 'not_run' END AS status, round(g, 6) AS gen_rate, round(w, 6) AS wall_rate, round(g / (SELECT g FROM c WHERE config = '{REF}'), 6) AS speedup,
  round(w / (SELECT w FROM c WHERE config = '{REF}'), 6) AS speedup_wall, draft_n, draft_ok, round(draft_ok / draft_n, 6) AS accept_rate, round(draft_ok / draft_n * 3, 6) AS accept_len, round(e / tok, 6) AS j_per_token FROM c""")
def ag_bench_config(spark, sf):
    return B.config_report(X.bench_results(spark, sf), REF)


@query("ag_category_pivot", with_("bench") + """
SELECT config, round(median(gen_rate) FILTER (category = 'cat0'), 6) AS cat0, round(median(gen_rate) FILTER (category = 'cat1'), 6) AS cat1, round(median(gen_rate) FILTER (category = 'cat2'), 6) AS cat2
FROM bench WHERE ok GROUP BY config""")
def ag_category_pivot(spark, sf):
    return B.category_table(X.bench_results(spark, sf), ["cat0", "cat1", "cat2"])


# ---- run logs ------------------------------------------------------------------------------

MONTH = 30 * 24 * T.HOUR
ORD = ["at_us", "okey"]
COLS = ("val_kl", "temp_c", "samples_per_s")


def log_bucket():
    return T.time_bucket("at_us", MONTH)


@query("wn_last_nonnull", with_("runlog") + """
SELECT run, okey, last_value(val_kl IGNORE NULLS) OVER w AS val_kl, last_value(samples_per_s IGNORE NULLS) OVER w AS rate FROM runlog
WINDOW w AS (PARTITION BY run ORDER BY at_us, okey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def wn_last_nonnull(spark, sf):
    d = neighbours(X.run_metrics(spark, sf), ["run"], ORD, log_bucket(), fill={"kl": "val_kl", "rate": "samples_per_s"})
    return d.select("run", "okey", F.col("kl").alias("val_kl"), "rate")


@query("wn_first_last", with_("runlog") + "SELECT run, arg_min(val_kl, step) AS val_kl_first, arg_max(val_kl, step) AS val_kl_last FROM runlog WHERE val_kl IS NOT NULL GROUP BY run")
def wn_first_last(spark, sf):
    return U.first_last(X.run_metrics(spark, sf), "val_kl")


@query("ag_status", with_("runlog") + """
SELECT run, count(*) AS n_rows, arg_max(val_kl, step) FILTER (val_kl IS NOT NULL) AS last_val_kl, arg_max(temp_c, step) AS last_temp_c,
  arg_max(samples_per_s, step) FILTER (samples_per_s IS NOT NULL) AS last_samples_per_s FROM runlog GROUP BY run""")
def ag_status(spark, sf):
    return U.status(X.run_metrics(spark, sf), COLS)


@query("ag_best_checkpoint", with_("runlog") + "SELECT run, arg_min(okey, (val_kl, step)) AS best_key, min(val_kl) AS best_kl FROM runlog WHERE val_kl IS NOT NULL GROUP BY run")
def ag_best_checkpoint(spark, sf):
    d = X.run_metrics(spark, sf).filter("val_kl is not null")
    return d.groupBy("run").agg(F.min(F.struct("val_kl", *ORD)).alias("m")).select("run", F.col("m.okey").alias("best_key"), F.col("m.val_kl").alias("best_kl"))


@query("sg_best_so_far", with_("runlog") + """
SELECT run, okey, min(val_kl) OVER (PARTITION BY run ORDER BY at_us, okey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_kl FROM runlog""")
def sg_best_so_far(spark, sf):
    d = running_min(X.run_metrics(spark, sf), ["run"], ORD, log_bucket(), "val_kl", "okey", "best")
    return d.select("run", "okey", F.col("best.val_kl").alias("best_kl"))


@query("ag_train_log", with_("runlog") + """
SELECT run, (step - 1) // 50 AS interval, count(*) AS steps, sum(n)::BIGINT AS samples, round(sum(loss * n) / sum(n), 6) AS train_loss, round(sum(ce * n_gold) / greatest(1, sum(n_gold)), 6) AS ce,
  round(sum(n) / sum(dt), 6) AS samples_per_s, round(sum(dt) / count(*) * 1000, 6) AS step_ms FROM runlog GROUP BY run, 2""")
def ag_train_log(spark, sf):
    return U.train_log(U.add_steps(X.run_metrics(spark, sf), log_bucket()), 50)


EVALS_SQL = """SELECT c_custkey % 12 AS run, CASE WHEN c_custkey % 12 % 3 <> 0 AND c_custkey % 5 < 2 THEN 'test' ELSE 'val' END AS split, count(*) AS n,
  avg(CASE WHEN c_nationkey < 12 THEN 1.0 ELSE 0.0 END) AS agreement, avg(c_acctbal / 10000) AS kl FROM customer GROUP BY ALL"""
cte("evals", EVALS_SQL)


def evals(spark, sf):
    c = table(spark, sf, "customer").select((F.col("c_custkey") % 12).alias("run"), "c_custkey", "c_nationkey", "c_acctbal")
    split = F.when((F.col("run") % 3 != 0) & (F.col("c_custkey") % 5 < 2), "test").otherwise("val")
    return c.groupBy("run", split.alias("split")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("c_nationkey") < 12, 1.0).otherwise(0.0)).alias("agreement"), F.avg(F.col("c_acctbal") / 10000).alias("kl"))


@query("ag_run_summary", with_("runlog", "evals") + """
, s AS (SELECT run, count(*) AS steps_done, median(samples_per_s) AS rate, max(temp_c) AS tmax, arg_min(val_kl, step) FILTER (val_kl IS NOT NULL) AS k0, arg_max(val_kl, step) FILTER (val_kl IS NOT NULL) AS k1 FROM runlog GROUP BY run),
 e AS (SELECT run, arg_max(split, split = 'test') AS split FROM evals GROUP BY run)
SELECT s.run, 'run' || s.run AS label, e.split AS eval_split, v.n AS eval_n, round(v.agreement, 6) AS agreement, steps_done, round(rate, 6) AS samples_per_s,
  CASE WHEN s.run % 2 = 0 THEN 99.5 ELSE tmax END AS temp_max_c, k0 AS val_kl_first, k1 AS val_kl_last FROM s JOIN e USING (run) JOIN evals v ON v.run = e.run AND v.split = e.split""")
def ag_run_summary(spark, sf):
    log = X.run_metrics(spark, sf)
    m = median(log, ["run"], "samples_per_s", "rate")
    a = log.groupBy("run").agg(F.count(F.lit(1)).alias("steps_done"), F.max("temp_c").alias("tmax"))
    # the document's own summary wins over the log; only even runs carry one
    doc = a.filter("run % 2 = 0").select("run", F.lit(99.5).alias("doc_temp"))
    ev = evals(spark, sf).withColumn("rank", F.when(F.col("split") == "test", 1).otherwise(0))
    ev = ev.groupBy("run").agg(F.max_by(F.struct("split", "n", "agreement"), "rank").alias("e"))
    d = a.join(m, "run").join(U.first_last(log, "val_kl"), "run").join(ev, "run").join(doc, "run", "left")
    return d.select("run", F.concat(F.lit("run"), F.col("run").cast("string")).alias("label"), F.col("e.split").alias("eval_split"), F.col("e.n").alias("eval_n"), r6("e.agreement", "agreement"),
                    "steps_done", r6("rate", "samples_per_s"), F.coalesce("doc_temp", "tmax").alias("temp_max_c"), "val_kl_first", "val_kl_last")


@query("ag_run_compare", with_("evals") + """
, m AS (SELECT run, sum(n) AS n, sum(agreement * n) / sum(n) AS agreement, sum(kl * n) / sum(n) AS kl FROM evals GROUP BY run),
 b AS (SELECT avg(agreement) AS am, stddev_samp(agreement) AS asd, avg(kl) AS km, stddev_samp(kl) AS ksd FROM m WHERE run >= 4)
SELECT 'agreement' AS metric, round(agreement, 6) AS value, round(am, 6) AS base_mean, round(asd, 6) AS base_sd, round(agreement - am, 6) AS delta, round(sqrt(agreement * (1 - agreement) / n), 6) AS se FROM m, b WHERE run = 1
UNION ALL SELECT 'kl', round(kl, 6), round(km, 6), round(ksd, 6), round(kl - km, 6), round(sqrt(kl * (1 - kl) / n), 6) FROM m, b WHERE run = 1""")
def ag_run_compare(spark, sf):
    w = lambda c: (F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c)
    m = evals(spark, sf).groupBy("run").agg(w("agreement"), w("kl"), F.sum("n").alias("total")).withColumnRenamed("total", "n")
    return U.compare(m, 1, "run >= 4", ["agreement", "kl"], "n")


@query("ag_collect_runs", """
SELECT plan, run, max((kind = 'metrics')::INT) = 1 AS has_metrics, max((kind = 'eval')::INT) = 1 AS has_eval FROM (
  SELECT CASE WHEN o_custkey % 12 < 6 THEN 'common' ELSE 'optimized' END AS plan, o_custkey % 12 AS run, 'metrics' AS kind FROM orders WHERE o_custkey % 12 <> 11
  UNION ALL SELECT CASE WHEN c_custkey % 12 < 6 THEN 'common' ELSE 'optimized' END, c_custkey % 12, 'eval' FROM customer WHERE c_custkey % 4 = 3) GROUP BY plan, run""")
def ag_collect_runs(spark, sf):
    root = scratch(spark, "runs")
    plan = lambda d: d.withColumn("plan", F.when(F.col("run") < 6, "common").otherwise("optimized"))
    m = plan(X.run_metrics(spark, sf).filter("run <> 11").select("run", "okey", "val_kl")).withColumn("kind", F.lit("metrics"))
    e = plan(table(spark, sf, "customer").filter("c_custkey % 4 = 3").select((F.col("c_custkey") % 12).alias("run"), F.col("c_custkey").alias("okey"), F.col("c_acctbal").alias("val_kl"))).withColumn("kind", F.lit("eval"))
    m.unionByName(e).repartition("plan", "run", "kind").write.partitionBy("plan", "run", "kind").json(root)
    # only names are needed: file contents are not read
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    part = lambda n: F.regexp_extract("path", f"{n}=([^/]+)/", 1)
    d = files.select(part("plan").alias("plan"), part("run").cast("bigint").alias("run"), part("kind").alias("kind"))
    return d.groupBy("plan", "run").agg(F.bool_or(F.col("kind") == "metrics").alias("has_metrics"), F.bool_or(F.col("kind") == "eval").alias("has_eval"))


# A screened run is named condition@card#checkpoint; a reference has no checkpoint.
SCREEN = """concat(lower(replace(p_type, ' ', '-')), '@card', p_size, case when p_partkey % 11 = 0 then '' when p_partkey % 5 = 0 then '#step50' when p_partkey % 7 = 0 then '#last' else '#best' end)"""
SCREEN_SQL = """lower(replace(p_type, ' ', '-')) || '@card' || p_size || CASE WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 5 = 0 THEN '#step50' WHEN p_partkey % 7 = 0 THEN '#last' ELSE '#best' END"""


@query("ag_screen_table", rf"""
SELECT p_partkey, split_part(s, '@', 1) AS cond, split_part(split_part(s, '@', 2), '#', 1) AS card, NOT contains(s, '#') AS reference, round(p_retailprice / 2000, 6) AS acc
FROM (SELECT *, {SCREEN_SQL} AS s FROM part) WHERE split_part(s, '#', 2) IN ('', 'best')""")
def ag_screen_table(spark, sf):
    """Best checkpoint of every screened run, and all references, by accuracy."""
    d = table(spark, sf, "part").selectExpr("p_partkey", f"{SCREEN} as s", """to_json(named_struct('head', named_struct('paraphrase', named_struct('acc', round(p_retailprice / 2000, 6))))) as doc""")
    part = lambda c, mark, i: F.split_part(c, F.lit(mark), F.lit(i))
    d = d.select("p_partkey", part("s", "@", 1).alias("cond"), part(part("s", "@", 2), "#", 1).alias("card"), (~F.contains("s", F.lit("#"))).alias("reference"), part("s", "#", 2).alias("ck"), R.nested("doc", "head.paraphrase.acc").alias("acc"))
    return d.filter("reference or ck = 'best'").drop("ck").orderBy(F.desc("acc"), "p_partkey")


@query("ag_prod_table", with_("evals") + """
SELECT t.run, round(t.agreement, 6) AS test_agree, round(v.kl, 6) AS val_kl, d.acc AS diag_acc FROM (SELECT * FROM evals WHERE split = 'test') t LEFT JOIN (SELECT * FROM evals WHERE split = 'val') v USING (run)
LEFT JOIN (SELECT n_nationkey AS run, round(n_regionkey / 10.0, 6) AS acc FROM nation WHERE n_nationkey % 2 = 0) d ON d.run = t.run""")
def ag_prod_table(spark, sf):
    m = evals(spark, sf).groupBy("run").agg(F.max(F.when(F.col("split") == "test", F.col("agreement"))).alias("t"), F.max(F.when(F.col("split") == "val", F.col("kl"))).alias("v"))
    diag = table(spark, sf, "nation").filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("bigint").alias("run"), r6(F.col("n_regionkey") / 10.0, "diag_acc"))
    return m.filter("t is not null").join(diag, "run", "left").select("run", r6("t", "test_agree"), r6("v", "val_kl"), "diag_acc")


@query("wn_rate200", """
WITH o AS (SELECT value / 1.0007 AS v, epoch_us(ts) AS t, row_number() OVER (ORDER BY ts, event_id) AS rn FROM events),
 r AS (SELECT DISTINCT ceil(rn / 50)::BIGINT AS report FROM o),
 w AS (SELECT report, count(*) AS n, min(t) AS t0, max(t) AS t1, avg(v) AS m, list_sort(list(v)) AS l FROM r JOIN o ON rn <= report * 50 AND rn > report * 50 - 200 GROUP BY report)
SELECT report, n, round((n - 1) / nullif((t1 - t0) / 1e6, 0), 9) AS rate, round(m, 6) AS mean, round(l[least(n - 1, floor(0.5 * n)::BIGINT) + 1], 6) AS p50, round(l[least(n - 1, floor(0.95 * n)::BIGINT) + 1], 6) AS p95 FROM w""")
def wn_rate200(spark, sf):
    d = table(spark, sf, "events").select("event_id", (F.col("value") / 1.0007).alias("v"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    d = prefix(d, ["t", "event_id"], T.time_bucket("t", 24 * T.HOUR), rank="rn")
    last = d.agg(F.ceil(F.max("rn") / 50).cast("bigint").alias("last"))
    w = attach(report_windows(d, "rn", 200, 50), last).filter("report <= last")
    # at most 200 values per report
    w = w.groupBy("report").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.avg("v").alias("m"), F.array_sort(F.collect_list("v")).alias("l"))
    at = lambda q, n: F.round(F.get("l", F.least(F.col("n") - 1, F.floor(F.col("n") * q)).cast("int")), 6).alias(n)
    return w.select("report", "n", F.round(ratio(F.col("n") - 1, (F.col("t1") - F.col("t0")) / 1e6), 9).alias("rate"), r6("m", "mean"), at(0.5, "p50"), at(0.95, "p95"))


# ---- ranks ---------------------------------------------------------------------------------

@query("wn_avg_rank", "SELECT event_id, value, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0::DOUBLE AS avg_rank FROM events")
def wn_avg_rank(spark, sf):
    return average_ranks(table(spark, sf, "events").select("event_id", "value"), "value")


@query("ag_auc", """
WITH r AS (SELECT event_type = 'error' AS pos, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS rk FROM events)
SELECT count(*) FILTER (pos) AS n_pos, count(*) FILTER (NOT pos) AS n_neg, round((sum(rk) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2.0) / (count(*) FILTER (pos) * count(*) FILTER (NOT pos)), 6) AS auc FROM r""")
def ag_auc(spark, sf):
    d = table(spark, sf, "events").select("value", (F.col("event_type") == "error").alias("pos"))
    return auc(d, "value", "pos").select("n_pos", "n_neg", r6("auc", "auc"))
