"""Streams against plain loops: failures, restarts, late rows, timers."""

import random

import numpy as np
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from decant.plans.streams import rocksdb
from decant.streaming import guard, jobs

ITEMS = "item_id long, context string, question string, candidates array<string>"


def items(ids):
    return [(i, f"c{i}", "q", ["a", "b"]) for i in ids]


def scorer(fails):
    """Fails ``fails[item_id]`` times; other kinds of failure by id."""
    def score(todo):
        times = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in fails.items() for x in (k, v)]), F.col("item_id")), F.lit(0))
        probs = F.when(F.col("item_id") == 900, F.array(F.lit(0.7), F.lit(0.7))).otherwise(F.array(F.lit(0.25), F.lit(0.75)))
        out = todo.filter("item_id <> 901").select("item_id", F.size("candidates").alias("k"), F.array(F.lit(0.0), F.lit(1.0)).alias("logits"), probs.alias("probs"),
                                                    F.when(F.col("attempts") < times, F.concat(F.lit("try "), F.col("attempts").cast("string"), F.lit(" " + "x" * 600))).alias("error"))
        return out
    return score


def run(spark, folder, loop, checkpoint, batches):
    for ids in batches:
        spark.createDataFrame(items(ids), ITEMS).coalesce(1).write.mode("append").parquet(folder)
        loop.run(jobs.read(spark, folder, spark.createDataFrame([], ITEMS).schema, per_trigger=1), checkpoint)


def state(loop):
    return (sorted((r.item_id, list(r.probs)) for r in loop.teacher().collect()), sorted((r.item_id, r.attempts, r.error) for r in loop.errors().collect()))


def test_failed_items_are_tried_again_and_given_up(spark):
    folder = jobs.scratch(spark, "loop")
    store, ck = jobs.new_paths(spark, "loop-store")
    loop = jobs.ScoringLoop(spark, scorer({3: 1, 4: 2, 5: 9}), store, max_attempts=3)
    run(spark, folder, loop, ck, [[1, 2, 3, 4, 3, 900], [2, 5, 6, 901, 4]])
    teacher, errors = state(loop)
    assert [i for i, _ in teacher] == [1, 2, 3, 4, 6]
    assert [(i, n) for i, n, _ in errors] == [(5, 3), (900, 3), (901, 3)]
    assert errors[0][2].startswith("try 2 xxx") and len(errors[0][2]) == 500
    assert errors[1][2] == "not a distribution" and errors[2][2] == "no answer"
    tried = spark.read.parquet(f"{store}/errors")
    assert sorted((r.item_id, r.attempts) for r in tried.filter("item_id in (3, 4)").collect()) == [(3, 1), (4, 1), (4, 2)]


def test_a_batch_that_breaks_off_is_replayed(spark, monkeypatch):
    """The second batch dies after its scores are written and before its queue is; the restart counts no attempt twice."""
    want = None
    for broken in (False, True):
        folder = jobs.scratch(spark, "loop")
        store, ck = jobs.new_paths(spark, "loop-store")
        loop = jobs.ScoringLoop(spark, scorer({3: 1, 4: 2, 5: 9}), store, max_attempts=3)
        run(spark, folder, loop, ck, [[1, 3, 4]])
        if broken:
            write = jobs.ScoringLoop._write

            def dies(self, d, table, step):
                if table == "errors":
                    raise RuntimeError("executor lost")
                write(self, d, table, step)

            monkeypatch.setattr(jobs.ScoringLoop, "_write", dies)
            with pytest.raises(StreamingQueryException):
                run(spark, folder, loop, ck, [[2, 5]])
            monkeypatch.setattr(jobs.ScoringLoop, "_write", write)
            loop.run(jobs.read(spark, folder, spark.createDataFrame([], ITEMS).schema, per_trigger=1), ck)
        else:
            run(spark, folder, loop, ck, [[2, 5]])
        if want is None:
            want = state(loop)
    assert state(loop) == want and len(want[0]) == 4


def plain_guard(samples, strict, max_wait):
    """One sample after the other; a wait that is over shows when time has passed it."""
    out, since = [], None
    for t, temp in samples:
        if since is not None and max_wait is not None and t > since + max_wait:
            out.append((since, since + max_wait, True))
            since = None
        if since is not None and (temp < 78 if strict else temp <= 78):
            out.append((since, t, False))
            since = None
        elif since is None and temp >= 88:
            since = t
    return out, since


@pytest.mark.parametrize("max_wait", [None, 5, 40])
@pytest.mark.parametrize("strict", [False, True])
def test_pauses_in_pieces(strict, max_wait):
    rng = random.Random(7)
    samples, t = [], 0
    for _ in range(3000):
        t += rng.choice([1, 1, 2, 30])
        samples.append((t, rng.choice([60, 78, 80, 85, 88, 95])))
    want, open_ = plain_guard(samples, strict, max_wait)
    for size in (1, 7, 3000):
        got, since = [], None
        for i in range(0, len(samples), size):
            ts, temp = (np.array(x) for x in zip(*samples[i : i + size]))
            closed, since = guard.pauses_of(ts, temp >= 88, temp < 78 if strict else temp <= 78, since, max_wait)
            got += closed
        assert (got, since) == (want, open_)


def test_guard_gives_up_without_a_new_row(spark):
    """Card a is silent after it got hot; what card b sends moves the watermark past its wait. A late cool row changes nothing."""
    second = 1_000_000
    schema = "card string, ts_us long, event_id long, temp_c double"
    batches = [
        [("a", 10 * second, 1, 90.0), ("b", 12 * second, 2, 70.0)],
        [("b", 200 * second, 3, 89.0), ("b", 300 * second, 4, 78.0), ("b", 310 * second, 5, 77.0)],
        [("a", 11 * second, 6, 60.0), ("b", 320 * second, 7, 70.0)],
        [("a", 400 * second, 8, 92.0), ("a", 405 * second, 9, 60.0)],
    ]
    folder = jobs.scratch(spark, "guard")
    out, ck = jobs.new_paths(spark, "guard-out")
    with rocksdb(spark):
        for rows in batches:
            d = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_micros("ts_us"))
            d.coalesce(1).write.mode("append").parquet(folder)
            jobs.to_table(guard.guard(jobs.read(spark, folder, d.schema, per_trigger=1), strict=True, max_wait_us=150 * second), out, ck)
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    assert got == [("a", 10 * second, 160 * second, True), ("a", 400 * second, 405 * second, False), ("b", 200 * second, 310 * second, False)]


def test_latency_sketch_stays_within_its_error(spark):
    rng = np.random.default_rng(2)
    v = rng.lognormal(3, 1, 20_000)
    d = spark.createDataFrame([(float(x),) for x in v], "v double").repartition(7)
    s = d.agg(F.kll_sketch_agg_double("v", jobs.SKETCH).alias("s"))
    for q in (0.5, 0.95):
        got = s.select(F.kll_sketch_get_quantile_double("s", F.lit(q))).first()[0]
        assert abs((v <= got).mean() - q) <= 0.02


def test_late_samples_and_requests_without_samples(spark):
    second = 1_000_000
    q_schema, s_schema = "req_id long, card string, t0 long, t1 long", "card string, ts_us long, power_w double"
    q_folder, s_folder = jobs.scratch(spark, "q"), jobs.scratch(spark, "s")
    out, ck = jobs.new_paths(spark, "pairs")
    steps = [
        ([(1, "a", 10 * second, 20 * second), (2, "b", 10 * second, 20 * second)], [("a", 9 * second, 4.0), ("a", 21 * second, 4.0)]),
        ([(3, "a", 900 * second, 910 * second)], [("a", 905 * second, 2.0)]),
        ([(4, "b", 905 * second, 911 * second)], [("b", 15 * second, 99.0), ("a", 906 * second, 2.0)]),
        ([(None, "end", 9000 * second, 9000 * second)], [("end", 9000 * second, 0.0)]),
    ]
    for q, s in steps:
        spark.createDataFrame(q, q_schema).coalesce(1).write.mode("append").parquet(q_folder)
        spark.createDataFrame(s, s_schema).coalesce(1).write.mode("append").parquet(s_folder)
        requests = jobs.read(spark, q_folder, spark.createDataFrame([], q_schema).schema)
        samples = jobs.read(spark, s_folder, spark.createDataFrame([], s_schema).schema)
        jobs.to_table(jobs.request_samples(requests, samples, 5 * second, 60 * second), out, ck)
    got = {r.req_id: r.joules for r in jobs.request_energy(spark.read.parquet(out).filter("req_id is not null"), 5 * second).collect()}
    assert got == {1: pytest.approx(40.0), 2: None, 3: pytest.approx(20.0), 4: None}


def test_pauses_of_a_host_join_into_sessions(spark):
    schema = "host string, card string, start_us long, end_us long"
    rows = [("h", "a", 10, 20), ("h", "b", 15, 30), ("h", "a", 28, 29), ("h", "a", 40, 50), ("g", "a", 12, 22), ("h", "z", 10**15, 10**15 + 1), ("g", "z", 10**15, 10**15 + 1)]
    rows = [(h, c, s * 1_000_000, e * 1_000_000) if s < 10**9 else (h, c, s, e) for h, c, s, e in rows]
    folder = jobs.scratch(spark, "pauses")
    out, ck = jobs.new_paths(spark, "sessions")
    d = spark.createDataFrame(rows, schema)
    d.coalesce(1).write.parquet(folder)
    jobs.to_table(guard.sessions(jobs.read(spark, folder, d.schema)), out, ck)
    got = sorted((r.host, r.start_us // 1_000_000, r.end_us // 1_000_000, r.n) for r in spark.read.parquet(out).collect())
    assert got == [("g", 12, 22, 1), ("h", 10, 30, 3), ("h", 40, 50, 1)]


def test_sessions_of_parts_are_whole_sessions(spark):
    """Pauses over many parts, in three batches: a key of the stream holds one part, and what reaches over parts is one session."""
    rng = random.Random(11)
    rows = [("gh"[i % 2], t, t + rng.choice([0, 1, 3, 3, 40])) for i in range(400) for t in [rng.randrange(4000)]] + [("g", 100, 155), ("g", 155, 155)]
    want = []
    for host in "gh":
        at = None
        for _, a, b in sorted(r for r in rows if r[0] == host):
            if at is None or a > at[2]:
                at = [host, a, b, 0]
                want.append(at)
            at[2:] = max(at[2], b), at[3] + 1
    folder = jobs.scratch(spark, "pauses")
    out, ck = jobs.new_paths(spark, "sessions")
    far = [(h, 10**12, 10**12 + 1) for h in "gh"]
    d = spark.createDataFrame(rows + far, "host string, start_us long, end_us long")
    jobs.to_table(guard.sessions(jobs.read(spark, jobs.arrivals(d, "start_us", 3, folder), d.schema, per_trigger=1), part_us=10), out, ck)
    pieces = spark.read.parquet(out)
    assert pieces.filter("part <> start_us div 10").count() == 0 and pieces.count() > len(want)
    got = sorted((r.host, r.start_us, r.end_us, r.n) for r in guard.join_parts(pieces).collect())
    assert got == sorted(tuple(w) for w in want)


def test_samples_reach_the_guard_as_arrays(spark):
    d = spark.createDataFrame([("ab"[i % 2], i, i, None if i == 7 else float(i)) for i in range(1000)], "card string, ts_us long, event_id long, temp_c double")
    got = {r.card: r for r in guard.packed(d.withColumn("ts", F.timestamp_micros("ts_us")).coalesce(1)).withColumn("us", F.unix_micros("ts")).collect()}
    assert sorted(got) == ["a", "b"] and (got["a"].us, got["b"].us) == (998, 999)
    assert sorted(got["b"].ts_us) == [i for i in range(1, 1000, 2) if i != 7] and [int(t) for t in got["b"].temp_c] == got["b"].event_id == got["b"].ts_us


def test_requests_join_by_stretches_of_time(spark):
    """The join is keyed by card and stretch of time, and every request meets all its samples once, whatever edge they lie on."""
    q_schema, s_schema = "req_id long, card string, t0 long, t1 long", "card string, ts_us long, power_w double"
    second, pad, longest = 1_000_000, 5_000_000, 60_000_000
    rng = random.Random(3)
    q = [(i, "ab"[i % 2], t, t + rng.choice([0, 1, 60]) * second) for i, t in enumerate(rng.choice([930, 1000, 1065, 1070, 1135, 1140, 1141]) * second for _ in range(40))]
    s = [("ab"[i % 2], t * second, float(i)) for i, t in enumerate(range(840, 1300))]
    folders = [jobs.scratch(spark, n) for n in "qs"]
    for rows, schema, folder in ((q + [(None, "end", 9000 * second, 9000 * second)], q_schema, folders[0]), (s + [("end", 9000 * second, 0.0)], s_schema, folders[1])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(folder)
    requests, samples = (jobs.read(spark, f, spark.createDataFrame([], c).schema) for f, c in zip(folders, (q_schema, s_schema)))
    out, ck = jobs.new_paths(spark, "pairs")
    joined = jobs.request_samples(requests, samples, pad, longest)
    jobs.to_table(joined, out, ck)
    got = sorted((r.req_id, r.ts_us) for r in spark.read.parquet(out).filter("req_id is not null").collect())
    assert got == sorted((i, t) for i, card, t0, t1 in q for c, t, _ in s if c == card and t0 - pad <= t <= t1 + pad)
    plan = joined._jdf.queryExecution().analyzed().toString()
    assert "q_part" in plan and "part" in plan


def test_requests_meet_gathered_samples(spark):
    """A row per card and stretch instead of one per request and sample; joules are those of the pairs, late rows and expiry as well."""
    q_schema, s_schema = "req_id long, card string, t0 long, t1 long", "card string, ts_us long, event_id long, power_w double"
    second, pad, longest = 1_000_000, 5_000_000, 60_000_000
    rng = random.Random(5)
    q = [(i, "ab"[i % 2], t, t + rng.choice([0, 1, 30, 60]) * second) for i, t in enumerate(rng.randrange(900, 2400) * second for _ in range(80))]
    s = [("ab"[i % 2], rng.randrange(950, 2300) * second, i, float(rng.randrange(50))) for i in range(1500)]
    s = [r for r in s if not 1500 * second < r[1] < 1600 * second and not 279 < r[2] < 290] + [("a", 1000 * second, 280, None)]
    s = list({r[:2]: r for r in s}.values())
    far = 9000 * second
    steps = [(q, s), ([(None, "end", far, far)], [("end", far, 0, 0.0)]), ([(99, "a", 1000 * second, 1001 * second)], [("a", 1000 * second, 9999, 1e6)]), ([(None, "end", 2 * far, 2 * far)], [("end", 2 * far, 0, 0.0)])]
    got = {}
    for name in ("pairs", "stretches"):
        folders = [jobs.scratch(spark, n) for n in "qs"]
        out, ck = jobs.new_paths(spark, name)
        for rows in steps:
            for r, schema, folder in zip(rows, (q_schema, s_schema), folders):
                spark.createDataFrame(r, schema).coalesce(1).write.mode("append").parquet(folder)
            requests, samples = (jobs.read(spark, f, spark.createDataFrame([], c).schema) for f, c in zip(folders, (q_schema, s_schema)))
            job = jobs.request_samples if name == "pairs" else jobs.request_stretches
            jobs.to_table(job(requests, samples.drop("event_id") if name == "pairs" else samples, pad, longest), out, ck)
        d = spark.read.parquet(out)
        if name == "stretches":
            width = jobs.STRETCH * (longest + 2 * pad)
            assert d.count() == len({(c, t1 // width) for _, c, _, t1 in q}) + 1  # and the first row far ahead
            d = jobs.stretch_energy(d, pad)
        else:
            d = jobs.request_energy(d, pad)
        got[name] = {r.req_id: r.joules for r in d.collect() if r.req_id is not None}
    assert any(v is None for v in got["pairs"].values()) and sum(v is not None for v in got["pairs"].values()) > 40
    assert got["stretches"] == {i: None if v is None else pytest.approx(v) for i, v in got["pairs"].items()}


def test_attempts_are_counted_over_batches_without_python(spark):
    folder = jobs.scratch(spark, "failures")
    out, ck = jobs.new_paths(spark, "retry")
    for ids in ([1, 1, 2], [2, 3, None], [1, 2]):
        d = spark.createDataFrame([(i,) for i in ids], "item_id long")
        d.coalesce(1).write.mode("append").parquet(folder)
    counted = jobs.retry_attempts(jobs.read(spark, folder, d.schema, per_trigger=1), 3)
    assert "Python" not in counted._jdf.queryExecution().analyzed().toString() and "Pandas" not in counted._jdf.queryExecution().analyzed().toString()
    jobs.per_batch(counted, out, ck)
    got = {r.item_id: (r.attempts, r.given_up) for r in jobs.latest(spark, out, ["item_id"]).collect()}
    assert got == {1: (3, True), 2: (3, True), 3: (1, False), None: (1, False)}
