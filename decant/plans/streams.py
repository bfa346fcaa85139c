"""Streaming and provider queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from decant.functions import dist as D
from decant.functions import providers as V
from decant.operators import distill as L
from decant.operators import embed as E
from decant.operators import metrics as M
from decant.operators import scoring as P
from decant.plans import fixtures as X
from decant.plans.registry import query, table, with_
from decant.plans.texts import txt_items
from decant.session import arrow_rows, attach, materialise, scratch
from decant.streaming import guard as G
from decant.streaming import jobs as J

r6 = lambda c, n: F.round(c, 6).alias(n)
r3 = lambda c, n: F.round(c, 3).alias(n)


def tel_stream(spark, sf, files=4):
    """The events table as a stream of telemetry samples: files in time order, one to a batch."""
    d = X.tel(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    folder = J.arrivals(d, "ts_us", files, scratch(spark, "tel-files"))
    return J.read(spark, folder, d.schema, per_trigger=1)


@query("sg_telemetry_windows", with_("tel") + """
, w AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS start, config, card, power_w, temp_c FROM tel), m AS (SELECT max(ts) - INTERVAL '2 seconds' AS mark FROM tel)
SELECT epoch_us(start) AS start_us, config, card, count(*) AS n, round(avg(power_w), 6) AS power_mean, max(temp_c) AS temp_max FROM w, m WHERE start + INTERVAL '1 hour' <= mark GROUP BY start, config, card""")
def sg_telemetry_windows(spark, sf):
    out, ck = J.new_paths(spark, "tel-windows")
    J.to_table(J.telemetry_windows(tel_stream(spark, sf)), out, ck)
    d = spark.read.parquet(out)
    return d.select(F.unix_micros("w.start").alias("start_us"), "config", "card", "n", r6("power_mean", "power_mean"), "temp_max")


@query("sg_progress", """
WITH d AS (SELECT event_type AS stage, time_bucket(INTERVAL '6 hours', ts) AS start, value AS v FROM events), m AS (SELECT max(ts) - INTERVAL '30 seconds' AS mark FROM events),
 t AS (SELECT event_type AS stage, count(*) + 100 AS total FROM events GROUP BY 1),
 w AS (SELECT stage, start, count(*) AS n, sum((v::DECIMAL(18,6) * 1000000)::BIGINT) AS micro, max(v) AS top, list_sort(list(v)) AS l FROM d, m WHERE start + INTERVAL '6 hours' <= mark GROUP BY stage, start),
 r AS (SELECT *, (sum(n) OVER (PARTITION BY stage ORDER BY start))::BIGINT AS done FROM w)
SELECT stage, epoch_us(start) AS start_us, n, done, round(n / 21600.0, 9) AS per_second, ((2 * micro + n) // (2 * n))::DOUBLE / 1000000 AS latency_mean, l[ceil(0.5 * n)::BIGINT] AS latency_p50, l[ceil(0.95 * n)::BIGINT] AS latency_p95,
  top AS latency_max, round((total - done) / (n / 21600.0) / 60, 6) AS eta_min FROM r JOIN t USING (stage)""")
def sg_progress(spark, sf):
    """Completions of every stage in three batches; each stage has a hundred items more than it completes.

    Latencies are decimals, so a mean is that of the exact sum, rounded half up, in whatever order rows come.
    """
    e = table(spark, sf, "events")
    d = e.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("stage"), F.col("value").cast("decimal(18,6)").alias("latency_ms"))
    totals = e.groupBy(F.col("event_type").alias("stage")).agg((F.count(F.lit(1)) + 100).alias("total"))
    folder = J.arrivals(d, "ts", 3, scratch(spark, "done-files"))
    out, ck = J.new_paths(spark, "progress")
    J.to_table(J.progress(J.read(spark, folder, d.schema, per_trigger=1), totals, "30 seconds", "6 hours", "stage"), out, ck)
    p = J.progress_report(spark.read.parquet(out), "stage")
    return p.select("stage", F.unix_micros("start").alias("start_us"), "n", "done", F.round("per_second", 9).alias("per_second"), F.round("latency_mean", 6).cast("double").alias("latency_mean"),
                    *[F.col(c).cast("double").alias(c) for c in ("latency_p50", "latency_p95", "latency_max")], r6("eta_min", "eta_min"))


#: What a request may lie from its samples, and how long it is at most.
NEAR, LONGEST = 60_000_000, 1_800_000_000


@query("sg_late_policy", with_("seg", "tel_requests") + f"""
, j AS (SELECT q.req_id, q.t0, q.t1, s.ts_us, s.power_w, CASE WHEN s.pt >= q.t0 - {NEAR} THEN s.pt END AS pt, s.pp, greatest(s.pt, q.t0) AS lo, least(s.ts_us, q.t1) AS hi
   FROM tel_requests q JOIN seg s ON s.card = q.card AND s.ts_us BETWEEN q.t0 - {NEAR} AND q.t1 + {NEAR}),
 a AS (SELECT req_id, sum(CASE WHEN pt IS NOT NULL AND hi > lo THEN (hi - lo) / 1e6 * ((pp + (power_w - pp) * (lo - pt) / (ts_us - pt)) + (pp + (power_w - pp) * (hi - pt) / (ts_us - pt))) / 2 ELSE 0 END) AS inner_j,
   min(ts_us) AS ft, arg_min(power_w, ts_us) AS fp, max(ts_us) AS lt, arg_max(power_w, ts_us) AS lp FROM j GROUP BY req_id)
SELECT q.req_id, q.card, round(CASE WHEN ft - t0 <= {NEAR} AND t1 - lt <= {NEAR} THEN inner_j + greatest(least(ft, t1) - t0, 0) / 1e6 * fp + greatest(t1 - greatest(lt, t0), 0) / 1e6 * lp END, 3) AS joules
FROM tel_requests q LEFT JOIN a USING (req_id)""")
def sg_late_policy(spark, sf):
    """Requests and samples as two streams. A last row of each, far ahead, moves the watermarks past everything before."""
    s = X.tel(spark, sf).select("card", "ts_us", "event_id", "power_w")
    q = X.tel_requests(spark, sf)
    end = s.agg((F.max("ts_us") + 10 * LONGEST).alias("t"))
    s = s.unionByName(end.select(F.lit("end").alias("card"), F.col("t").alias("ts_us"), F.lit(None).cast("bigint").alias("event_id"), F.lit(0.0).alias("power_w")))
    q = q.unionByName(end.select(F.lit(None).cast("bigint").alias("req_id"), F.lit("end").alias("card"), F.col("t").alias("t0"), F.col("t").alias("t1")))
    requests = J.read(spark, J.arrivals(q, "t0", 3, scratch(spark, "request-files")), q.schema, per_trigger=1)
    samples = J.read(spark, J.arrivals(s, "ts_us", 3, scratch(spark, "sample-files")), s.schema, per_trigger=1)
    out, ck = J.new_paths(spark, "late")
    with arrow_rows(spark, 1):  # a row holds a whole stretch
        J.to_table(J.stretch_energy(J.request_stretches(requests, samples, NEAR, LONGEST), NEAR), out, ck)
    return spark.read.parquet(out).filter("req_id is not null").select("req_id", "card", r3("joules", "joules"))


#: A guard gives up after this long (microseconds).
MAX_WAIT = 1_800_000_000


@query("sg_temp_guard_stream", with_("tel").replace("WITH", "WITH RECURSIVE", 1) + f"""
, c AS MATERIALIZED (SELECT card, ts_us, (SELECT min(ts_us) FROM tel b WHERE b.card = a.card AND b.temp_c < 78 AND b.ts_us > a.ts_us) AS cool FROM tel a WHERE temp_c >= 88),
 h AS MATERIALIZED (SELECT card, ts_us AS start_us, cool IS NULL OR cool > ts_us + {MAX_WAIT} AS gave_up, least(coalesce(cool, ts_us + {MAX_WAIT}), ts_us + {MAX_WAIT}) AS end_us FROM c),
 p AS (SELECT h.* FROM h JOIN (SELECT card, min(start_us) AS start_us FROM h GROUP BY card) USING (card, start_us)
   UNION ALL SELECT h.* FROM (SELECT p.card, (SELECT min(start_us) FROM h n WHERE n.card = p.card AND n.start_us > p.end_us) AS start_us FROM p) x JOIN h USING (card, start_us))
SELECT card, start_us, end_us, gave_up FROM p WHERE NOT gave_up OR end_us < (SELECT max(ts_us) - 2000000 FROM tel)""")
def sg_temp_guard_stream(spark, sf):
    out, ck = J.new_paths(spark, "guard")
    with rocksdb(spark):
        J.to_table(G.guard(tel_stream(spark, sf), strict=True, max_wait_us=MAX_WAIT), out, ck)
    return spark.read.parquet(out)


def in_two_runs(spark, d, time, job, name):
    """Result table of a job that is stopped after half of the rows and started again from its checkpoint, two batches each."""
    half = d.agg(((F.min(time) + F.max(time)) / 2).alias("t"))
    folder = scratch(spark, f"{name}-files")
    out, ck = J.new_paths(spark, name)
    with rocksdb(spark):
        for part in (F.col(time) <= F.col("t"), F.col(time) > F.col("t")):
            J.arrivals(attach(d, half).filter(part).drop("t"), time, 2, folder)
            J.to_table(job(J.read(spark, folder, d.schema, per_trigger=1)), out, ck)
    return spark.read.parquet(out)


@query("sg_session_pauses_stream", with_("pauses") + """
, o AS (SELECT *, max(end_us) OVER (ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM pauses),
 s AS (SELECT *, sum((past IS NULL OR past < start_us)::INT) OVER (ORDER BY start_us, end_us) AS session FROM o)
SELECT min(start_us) AS start_us, max(end_us) AS end_us, count(*) AS n FROM s GROUP BY session""")
def sg_session_pauses_stream(spark, sf):
    """Times in which any card paused: session windows over the pauses that a guard stream has found."""
    d = X.tel(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")).select("ts", "card", "ts_us", "event_id", "temp_c")
    p = in_two_runs(spark, d, "ts_us", lambda samples: G.guard(samples, in_order=True), "pauses").select("card", "start_us", "end_us")
    # one more pause, far ahead, closes all sessions before it
    end = p.agg((F.max("end_us") + 1_000_000_000_000).alias("start_us")).select(F.lit("end").alias("card"), "start_us", (F.col("start_us") + 1).alias("end_us"))
    p = p.unionByName(end.filter("start_us is not null")).withColumn("host", F.lit("host"))
    folder = J.arrivals(p, "start_us", 3, scratch(spark, "pause-files"))
    out, ck = J.new_paths(spark, "sessions")
    J.to_table(G.sessions(J.read(spark, folder, p.schema, per_trigger=1), part_us=G.PART), out, ck)
    return G.join_parts(spark.read.parquet(out)).select("start_us", "end_us", "n")


@query("sg_best_so_far_stream", with_("runlog") + """
SELECT run, okey, min(val_kl) OVER (PARTITION BY run ORDER BY at_us, okey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_kl FROM runlog""")
def sg_best_so_far_stream(spark, sf):
    d = X.run_metrics(spark, sf).select("run", "at_us", "okey", "val_kl")
    out = in_two_runs(spark, d, "at_us", lambda log: G.best_so_far(log, "val_kl"), "best")
    return out.select("run", "okey", F.col("best").alias("best_kl"))


@query("sg_retry_state", """
SELECT user_id AS item_id, count(*)::INTEGER AS attempts, count(*) >= 3 AS given_up FROM events WHERE event_type = 'error' GROUP BY user_id""")
def sg_retry_state(spark, sf):
    d = table(spark, sf, "events").filter("event_type = 'error'").select(F.col("user_id").alias("item_id"), "event_id")
    folder = J.split_files(d, "event_id", 3, scratch(spark, "failure-files"))
    out, ck = J.new_paths(spark, "retry")
    J.per_batch(J.retry_attempts(J.read(spark, folder, d.schema, per_trigger=1), 3), out, ck)
    return J.latest(spark, out, ["item_id"]).select("item_id", "attempts", "given_up")


class rocksdb:  # noqa: N801
    """Keyed processors need a state store with column families; the session's own choice comes back afterwards."""

    KEY = "spark.sql.streaming.stateStore.providerClass"

    def __init__(self, spark):
        self.spark = spark

    def __enter__(self):
        self.old = self.spark.conf.get(self.KEY, None)
        self.spark.conf.set(self.KEY, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def __exit__(self, *_):
        if self.old is None:
            self.spark.conf.unset(self.KEY)
        else:
            self.spark.conf.set(self.KEY, self.old)


@query("sg_energy_state", with_("seg") + "SELECT card, count(*) AS n, round(sum((ts_us - pt) / 1e6 * (power_w + pp) / 2), 3) AS joules, round(sum((ts_us - pt) / 1e6), 3) AS seconds FROM seg GROUP BY card")
def sg_energy_state(spark, sf):
    d = X.tel(spark, sf).select("card", "ts_us", "event_id", "power_w")
    folder = J.arrivals(d, "ts_us", 3, scratch(spark, "power-files"))
    out, ck = J.new_paths(spark, "energy")
    with rocksdb(spark):
        # files arrive in time order, one per batch; state carries the last sample over
        J.per_batch(J.energy_pieces(J.read(spark, folder, d.schema, per_trigger=1)), out, ck)
    e = J.stitch(J.latest(spark, out, ["card", "hour"]))
    return e.select("card", "n", r3("joules", "joules"), r3("seconds", "seconds"))


#: Attempts before an item is given up in the loop's query.
TRIES = 3


@query("sg_score_loop", with_("perm_fill") + f"""
, m AS (SELECT item_id, any_value(k) AS k, cand_pos, avg(lp) AS lp FROM perm_fill GROUP BY item_id, cand_pos),
 z AS (SELECT *, lp - max(lp) OVER (PARTITION BY item_id) AS x FROM m),
 p AS (SELECT item_id, k, cand_pos, x - ln(sum(exp(x)) OVER (PARTITION BY item_id)) AS logit FROM z)
SELECT item_id, any_value(k)::INTEGER AS k, (item_id % 4)::INTEGER AS attempts, item_id % 4 < {TRIES} AS scored, CASE WHEN item_id % 4 >= {TRIES} THEN 'attempt ' || {TRIES - 1} || ' refused' END AS error,
  CASE WHEN item_id % 4 < {TRIES} THEN round(arg_min(logit, cand_pos), 6) END AS first_logit, CASE WHEN item_id % 4 < {TRIES} THEN round(max(exp(logit)), 6) END AS p_max FROM p GROUP BY item_id""")
def sg_score_loop(spark, sf):
    """Recorded label scores answer the loop, after refusing an item as often as its id says (0 to 3 times)."""
    d = X.dec_items(spark, sf).select("item_id", "context", "question", "candidates")
    # a third of the items arrive twice: the loop must score them once
    again = d.unionByName(d.filter("item_id % 3 = 0"))
    folder = J.arrivals(again, "item_id", 3, scratch(spark, "item-files"))
    recorded = X.dec_perm_logprobs(spark, sf)

    def score(todo):
        got = P.aggregate(P.per_order(recorded.join(todo.select("item_id"), "item_id", "left_semi")))
        refused = F.when(F.col("attempts") < F.col("item_id") % 4, F.concat(F.lit("attempt "), F.col("attempts").cast("string"), F.lit(" refused")))
        return got.join(todo.select("item_id", "attempts"), "item_id").withColumn("error", F.coalesce(refused, F.when(F.col("failed"), F.lit("no label found"))))

    loop = J.ScoringLoop(spark, score, scratch(spark, "teacher"), TRIES)
    loop.run(J.read(spark, folder, d.schema, per_trigger=1), scratch(spark, "teacher-checkpoint"))
    tried = spark.read.parquet(f"{loop.store}/errors").groupBy("item_id").agg(F.max("attempts").alias("attempts"))
    scored = loop.teacher().selectExpr("item_id", "round(logits[0], 6) as first_logit", "round(array_max(probs), 6) as p_max", "true as scored")
    k = d.select("item_id", F.size("candidates").alias("k"))
    out = k.join(tried, "item_id", "left").join(scored, "item_id", "left").join(loop.errors().select("item_id", "error"), "item_id", "left")
    return out.select("item_id", "k", F.coalesce("attempts", F.lit(0)).alias("attempts"), F.coalesce("scored", F.lit(False)).alias("scored"), "error", "first_logit", "p_max")


@query("sg_resume_chunks", with_("dict") + "SELECT uid, uid // 64 AS chunk, uid // 64 < 2 AS was_stored FROM dict", )
def sg_resume_chunks(spark, sf):
    from decant.sources.writers import guard_strings

    s = E.slots(txt_items(spark, sf).filter("split = 'train'"))
    strings = materialise(E.dictionary(s).selectExpr("uid", "text", "uid div 64 as chunk"), "strings")
    store = scratch(spark, "chunks")
    guard_strings(strings, store + "-mark")
    first = V.embed(strings.filter("chunk < 2"), "ngram64")
    first.join(strings.select("uid", "chunk"), "uid").write.partitionBy("chunk").parquet(store)
    guard_strings(strings, store + "-mark")  # what a resumed run does first
    have = spark.read.parquet(store).select("chunk").distinct()
    rest = strings.join(have, "chunk", "left_anti")
    V.embed(rest, "ngram64").join(strings.select("uid", "chunk"), "uid").write.mode("append").partitionBy("chunk").parquet(store)
    done = spark.read.parquet(store)
    return done.select("uid", F.col("chunk").cast("bigint").alias("chunk"), (F.col("chunk") < 2).alias("was_stored"))


# ---- providers -----------------------------------------------------------------------------

@query("ud_embed")
def ud_embed(spark, sf):
    c = table(spark, sf, "conversations")
    uniq = c.groupBy(F.sha1("text").alias("h")).agg(F.min("text").alias("text"))
    v = V.embed(uniq, "ngram64", "h")
    return v.selectExpr("h", f"round({D.norm('vec')}, 6) as norm", "round(vec[0], 6) as v0")


@query("ud_score")
def ud_score(spark, sf):
    d = P.aggregate(P.per_order(V.label_table(txt_items(spark, sf), V.OverlapScorer()))).filter("not failed")
    d = d.selectExpr("item_id", "n_filled", "posexplode(probs) as (cand_pos, p)")
    return d.select("item_id", "cand_pos", r6("p", "p"), "n_filled")


DIMS = 16


def student_rows(spark, sf):
    """Per-candidate features: products of item vector and label centroid, summed into cells by dimension modulo."""
    base = X.item_base(spark, sf).select("item_id", "split", "k", "gold", "labs", F.expr(f"transform(t, x -> x * {X.SCALE}D)").alias("t"))
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    c = X.centroids(spark, sf).groupBy().agg(F.expr("map_from_entries(collect_list(struct(label, c)))").alias("cents"))
    cells = ", ".join("(" + " + ".join(f"embedding[{i}] * c[{i}]" for i in range(b, X.DIMS, DIMS)) + ") * 60D" for b in range(DIMS))
    d = attach(base.join(e, "item_id"), c)
    return d.withColumn("feats", F.expr(f"transform(labs, l -> element_at(transform(array(element_at(cents, l)), c -> array({cells})), 1))")).select("item_id", "split", "k", "gold", "t", "feats")


@query("ud_distill")
def ud_distill(spark, sf):
    data = materialise(student_rows(spark, sf).filter("split = 'train'"), "student")
    _, history = L.fit(data, DIMS, 12, 0.2)
    return spark.createDataFrame([(s, round(a, 6), round(b, 6)) for s, a, b in history], "step int, loss double, kl double")


@query("ud_predict")
def ud_predict(spark, sf):
    data = materialise(student_rows(spark, sf), "student")
    w, _ = L.fit(data.filter("split = 'train'"), DIMS, 12, 0.2)
    d = M.score_items(L.predict(data, w))
    return d.groupBy("split").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.col("agree").cast("double")), "agreement"), r6(F.avg("kl"), "kl"))
