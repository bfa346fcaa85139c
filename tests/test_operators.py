"""Golden numbers, brute-force comparisons and order independence."""

import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from decant.functions import dist as D
from decant.functions import hashing as H
from decant.functions import text as T
from decant.operators import bench, cascade, config, embed, metrics, prefix, quantiles, sampling, scoring, store, telemetry, tokens
from decant.sources import readers, writers


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# ---- config grammars -----------------------------------------------------------------------

def test_config_grammars():
    assert config.parse_caps("a=3, b=5") == {"a": 3, "b": 5}
    assert config.parse_stages("train:10@a+public,val") == [("train", 10, ["a", "public"]), ("val", None, None)]
    assert config.parse_loss_weights("a:kd=.5,ce=.5") == {"a": (0.5, 0.5)}
    assert config.parse_grid("0.5:0.9:0.1") == [0.5, 0.6, 0.7, 0.8, 0.9]
    assert config.parse_mix("equal", ["a", "b"]) == {"a": 1.0, "b": 1.0}
    assert config.largest_remainder(10, {"a": 1, "b": 1, "c": 1}) == {"a": 4, "b": 3, "c": 3}
    for bad in ("news=-4", "news=many", "=7", "news", "news=2, wiki=5, news=3"):
        with pytest.raises(ValueError):
            config.parse_caps(bad)
    with pytest.raises(ValueError):
        config.parse_stages("nowhere:3")
    with pytest.raises(ValueError):
        config.parse_mix("z:1", ["a"])


# ---- ranks and running sums ----------------------------------------------------------------

def test_prefix_matches_plain_running_sum_with_a_hot_group(spark):
    rng = random.Random(1)
    data = [(("hot" if rng.random() < 0.6 else rng.choice("abc")), i, rng.randrange(9)) for i in range(3000)]
    d = spark.createDataFrame(data, "g string, i long, v long").repartition(7).withColumn("h", H.rank_key("t", F.col("i")))
    got = prefix.prefix(d, ["h"], prefix.hash_bucket("h"), ["g"], sums={"before": "v"}).select("g", "i", "rn", "before", "h").collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.g, r.h)):
        n, s = by.get(r.g, (0, 0))
        assert (r.rn, r.before) == (n + 1, s)
        by[r.g] = (n + 1, s + data[r.i][2])
    assert sum(n for n, _ in by.values()) == 3000


def test_keep_below_equals_filtering(spark):
    d = spark.range(5000).withColumn("g", F.col("id") % 3).withColumn("h", H.rank_key("k", F.col("id")))
    full = prefix.prefix(d, ["h"], prefix.hash_bucket("h"), ["g"]).filter("rn <= 77").select("g", "id", "rn")
    cut = prefix.prefix(d, ["h"], prefix.hash_bucket("h"), ["g"], keep_below=("rn", 77)).select("g", "id", "rn")
    assert rows(full) == rows(cut) and len(rows(cut)) == 231


def test_neighbours_cross_empty_buckets(spark):
    data = [("x", t, v) for t, v in [(0, 1.0), (5, None), (40, None), (41, 2.0), (99, None), (120, 3.0)]]
    d = spark.createDataFrame(data, "g string, t long, v double")
    out = prefix.neighbours(d, ["g"], ["t"], F.floor(F.col("t") / 10), lag={"p": "t"}, fill={"b": "v"}, fill_next={"a": "v"}).orderBy("t").collect()
    assert [r.p for r in out] == [None, 0, 5, 40, 41, 99]
    assert [r.b for r in out] == [1.0, 1.0, 1.0, 2.0, 2.0, 3.0]
    assert [r.a for r in out] == [1.0, 2.0, 2.0, 2.0, 3.0, 3.0]


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", "c"], 4000, p=[0.8, 0.15, 0.05]), "v": np.where(rng.random(4000) < 0.3, 7.0, rng.normal(size=4000))})
    got = {r.g: r for r in quantiles.quantiles(spark.createDataFrame(pdf), ["g"], "v", {"m": 0.5, "p": 0.95}).collect()}
    for g, s in pdf.groupby("g")["v"]:
        assert got[g].m == pytest.approx(np.quantile(s, 0.5)) and got[g].p == pytest.approx(np.quantile(s, 0.95))


def test_auc_golden(spark):
    def value(pos, neg):
        d = spark.createDataFrame([(float(x), True) for x in pos] + [(float(x), False) for x in neg], "v double, p boolean")
        r = quantiles.auc(d, "v", "p").collect()
        return r[0].auc if r else None

    assert value([3, 4], [1, 2, 3.5]) == pytest.approx(5 / 6)
    assert value([1, 1], [1, 1]) == 0.5
    assert value([1], []) is None


def test_medians_of_several_columns(spark):
    d = spark.createDataFrame([("a", float(i), float(i * i)) for i in range(7)] + [("b", 1.0, None)], "g string, x double, y double")
    assert rows(quantiles.medians(d, ["g"], ["x", "y"])) == [("a", 3.0, 9.0), ("b", 1.0, None)]


# ---- sampling ------------------------------------------------------------------------------

def test_cap_is_stable_under_order_and_growth(spark):
    d = spark.range(230).select(F.col("id").alias("item_id"), F.when(F.col("id") < 200, "synth").otherwise("pairs").alias("source"))
    keep = lambda x: {r.item_id for r in sampling.cap_per_source(x, {"synth": 50}, "item_id").collect()}
    a = keep(d)
    assert len(a) == 80 and sum(i < 200 for i in a) == 50
    assert a == keep(d.orderBy(F.desc("item_id")).repartition(5))
    more = d.unionByName(spark.createDataFrame([(10_000, "synth")], "item_id long, source string"))
    assert len(a - keep(more)) <= 1


def test_stratified_batches_cycle_each_source(spark):
    pool = spark.createDataFrame([(i, "a" if i < 10 else "b") for i in range(15)], "item_id long, source string")
    out = sampling.stratified_batches(pool, "item_id", {"a": 2, "b": 1}, 10).toPandas()
    assert out.groupby("step").size().eq(3).all()
    assert out[out.source == "a"].groupby("item_id").size().eq(2).all()
    assert out[out.source == "b"].groupby("item_id").size().eq(2).all()


def test_crc_buckets_match_zlib(spark):
    d = spark.createDataFrame([(s,) for s in ("7", "abc", "記事")], "id string")
    got = {r.id: (r.b, r.m) for r in d.select("id", (F.crc32("id") % 100).alias("b"), (H.numeric_or_crc(F.col("id")) % 4).alias("m")).collect()}
    for s, (b, m) in got.items():
        assert b == zlib.crc32(s.encode()) % 100
        assert m == (int(s) if s.isdigit() else zlib.crc32(s.encode())) % 4


# ---- text ----------------------------------------------------------------------------------

def one(spark, sql, **cols):
    d = spark.createDataFrame([tuple(cols.values())], list(cols))
    return d.selectExpr(f"{sql} as x").first().x


def test_text_functions(spark):
    assert one(spark, T.sanitize("t"), t=" a<|x|>\r\nb\t　 c \r") == "a< |x| >\nb c"
    assert one(spark, T.clip("t", 5), t="abcdefgh") == "abcd…"
    assert one(spark, T.clip("t", 6, 2), t="abcdefgh") == "abc…gh"
    assert one(spark, T.clip("t", 8), t="abcdefgh") == "abcdefgh"
    assert one(spark, T.language("t"), t="これ") == "ja" and one(spark, T.language("t"), t="this") == "en"
    assert one(spark, T.cut_at_newline("t", 6), t="ab\ncdefgh") == "ab" and one(spark, T.cut_at_newline("t", 3), t="abcdef") == "abc"
    assert one(spark, T.sentences("t"), t="One. Two?  Three\nfour") == ["One.", "Two?", "Three", "four"]
    assert one(spark, T.toolcall("t"), t=' {"a": 1} ') == '<TOOLCALL>[{"a": 1}]</TOOLCALL>'
    assert one(spark, T.toolcall("t"), t="[1]") == "<TOOLCALL>[1]</TOOLCALL>"
    tool = '{"name":"f","description":"does  it","parameters":{"properties":{"a":{},"b":{}},"required":["b"]}}'
    assert one(spark, T.tool_line("t"), t=tool) == "- f(a, b*): does it"
    assert one(spark, T.tool_line("t"), t="{oops") == "- {oops"
    assert one(spark, T.response_type("t"), t="I am unable") == "cannot_answer"
    text = "京都（）は、古い都市であり多くの寺院や神社が残されている町である。\n見出し\n\nReferences and other English lines without much script at all。"
    assert one(spark, T.paragraphs("t"), t=text) == ["京都は、古い都市であり多くの寺院や神社が残されている町である。"]


def test_paragraph_budget(spark):
    b = lambda n, m: tuple(one(spark, tokens.paragraph_budget("n", m), n=n))
    assert b([10, 10, 10], 25) == (20, 2, True)
    assert b([30, 10], 25) == (25, 1, True)
    assert b([5, 5], 25) == (10, 2, False)


# ---- distributions and metrics -------------------------------------------------------------

def test_distribution_functions(spark):
    s, t = [0.3, 1.7, -0.4], [2.0, 0.1, 0.5]
    p, q = (np.exp(x) / np.exp(x).sum() for x in (np.array(s), np.array(t)))
    assert one(spark, D.softmax("s"), s=s) == pytest.approx(list(p))
    assert one(spark, D.kl(D.softmax("t"), D.softmax("s")), s=s, t=t) == pytest.approx(float((q * np.log(q / p)).sum()))
    assert one(spark, D.entropy("p"), p=[0.5, 0.5, 0.0]) == pytest.approx(np.log(2))
    assert one(spark, D.argmax("s"), s=[1.0, 3.0, 3.0]) == 1
    assert one(spark, D.brier("p", "1"), p=[0.2, 0.8]) == pytest.approx(0.08)
    assert one(spark, metrics.spearman("a", "b"), a=[1.0, 2.0, 2.0, 4.0], b=[4.0, 3.0, 3.0, 1.0]) == pytest.approx(-1.0)


def test_missing_labels_take_the_floor(spark):
    long = spark.createDataFrame([(1, 2, "a", 0, -0.5), (1, 2, "a", 1, None), (1, 2, "b", 0, -1.0), (1, 2, "b", 1, -2.0), (2, 2, "a", 0, None), (2, 2, "a", 1, None)],
                                 "item_id long, k int, perm string, cand_pos int, logprob double")
    r = {x.item_id: x for x in scoring.aggregate(scoring.per_order(long)).collect()}
    assert r[1].mean_lp == pytest.approx([-0.75, -1.75]) and sum(r[1].probs) == pytest.approx(1) and r[1].n_filled == 1
    assert r[2].failed and not r[1].failed


def test_store_contracts(spark):
    items = spark.createDataFrame([(1, "val", "a"), (2, "train", "synth"), (3, "train", "a"), (4, "test", "b")], "item_id long, split string, source string")
    teacher = spark.createDataFrame([(3,)], "item_id long")
    errors = spark.createDataFrame([(4, 2), (1, 1)], "item_id long, attempts int")
    assert [r.item_id for r in store.next_batch(store.pending(items, teacher, errors), 10).collect()] == [2, 1]
    assert rows(store.pending(items, teacher, errors, sources=["public"]).select("item_id")) == [(1,)]
    bad = spark.createDataFrame([(["a"], 0), ([], None), (["a", ""], None), (["a"], 3), ([str(i) for i in range(17)], None)], "candidates array<string>, gold int")
    assert [r.p for r in bad.select(store.item_problem().alias("p")).collect()] == [None, "candidate count", "empty candidate", "gold out of range", "candidate count"]


def test_insert_refuses_collisions(spark, tmp_path):
    d = spark.createDataFrame([(1, "train", "a", ["x"], 0)], "item_id long, split string, source string, candidates array<string>, gold int")
    path = str(tmp_path / "items")
    assert writers.insert_items(d, d.limit(0), path) == 1
    with pytest.raises(ValueError):
        writers.insert_items(d, spark.read.parquet(path), path)
    assert spark.read.parquet(path).count() == 1


def test_tolerant_reader(spark, tmp_path):
    p = tmp_path / "log.jsonl"
    p.write_text('{"a": 1}\n\n{"a": 2}\n{"a": ')
    assert rows(readers.jsonl_tolerant(spark, str(p), "a bigint")) == [(1,), (2,)]
    assert readers.jsonl_tolerant(spark, str(tmp_path / "none"), "a bigint").count() == 0


def test_tsv_with_byte_order_mark(spark, tmp_path):
    p = tmp_path / "t.tsv"
    p.write_bytes("﻿a\tb\n1\tx\n2\ty\n".encode())
    assert rows(readers.tsv(spark, str(p), "a int, b string")) == [(1, "x", 0), (2, "y", 1)]


def test_tsv_over_a_folder_of_files(spark, tmp_path):
    for f, (first, n) in {"a": (0, 3), "b": (3, 1), "c": (4, 0), "d": (4, 5)}.items():
        (tmp_path / f"{f}.tsv").write_text("a\tb\n" + "".join(f"{i}\tx{i}\n" for i in range(first, first + n)))
    assert rows(readers.tsv(spark, str(tmp_path), "a int, b string")) == [(i, f"x{i}", i) for i in range(9)]


def test_scores_are_checked_and_end_errors(spark):
    schema = "item_id long, probs array<double>, created_at long, teacher_model string"
    old = spark.createDataFrame([(i, [0.5, 0.5], 10, "old") for i in range(5)], schema)
    new = spark.createDataFrame([(0, [0.9, 0.1], 10, "new"), (1, [0.9, 0.2], 20, "new"), (2, None, 20, "new"), (3, [float("nan"), 1.0], 20, "new"), (7, [1.0], 5, "new")], schema)
    errors = spark.createDataFrame([(i, 1) for i in (0, 1, 7, 8)], "item_id long, attempts int")
    scores, left, refused = store.record_scores(old, new, errors)
    assert {r.item_id: r.teacher_model for r in scores.collect()} == {0: "new", 1: "old", 2: "old", 3: "old", 4: "old", 7: "new"}
    assert rows(left) == [(1, 1), (8, 1)] and sorted(r.item_id for r in refused.collect()) == [1, 2, 3]


def test_a_changed_string_is_refused(spark, tmp_path):
    d = spark.createDataFrame([(0, "a"), (1, "b")], "uid long, text string")
    writers.guard_strings(d, str(tmp_path / "mark"))
    writers.guard_strings(d.orderBy(F.desc("uid")), str(tmp_path / "mark"))
    with pytest.raises(ValueError):
        writers.guard_strings(d.withColumn("text", F.upper("text")), str(tmp_path / "mark"))


def test_quantile_buckets_follow_the_data(spark):
    """One outlier and infinities leave the rest spread out; a group of nulls keeps its row."""
    data = [("a", float(i)) for i in range(2000)] + [("a", 1e12), ("a", float("inf")), ("a", float("-inf"))] + [("b", None)] * 3
    d = spark.createDataFrame(data, "g string, v double")
    assert rows(quantiles.medians(d, ["g"], ["v"])) == [("a", 1000.0), ("b", None)]
    counts = quantiles.value_counts(d, ["g"], "v").groupBy("_b").count().collect()
    assert len(counts) > 100 and max(r["count"] for r in counts) < 60


def test_late_samples_do_not_count_twice():
    from decant.streaming.jobs import EnergyState

    class Held:
        value = None
        exists = lambda self: self.value is not None
        get = lambda self: self.value

        def update(self, v):
            self.value = v

    class Timers:
        registerTimer = lambda self, at: None  # noqa: E731,N815

    s = EnergyState()
    s.state, s.handle = Held(), Timers()
    batch = lambda *r: iter([pd.DataFrame(r, columns=["ts_us", "event_id", "power_w"])])
    list(s.handleInputRows(("c", 0), batch((0, 0, 10.0), (4_000_000, 1, 10.0)), None))
    out = list(s.handleInputRows(("c", 0), batch((1_000_000, 2, 99.0), (6_000_000, 3, 10.0)), None))[0]
    assert (out.joules[0], out.seconds[0], out.n[0]) == (60.0, 6.0, 3)


# ---- cascade -------------------------------------------------------------------------------

def test_threshold_search_on_two_stages(spark):
    """Sure and right, sure and wrong, unsure: the first stage's threshold must lie between the wrong and the right."""
    kinds = [(0.97, True), (0.72, False), (0.41, False)]
    first = [("A", "val", i, 4, *kinds[i % 3], kinds[i % 3][1], True, True, 2.0) for i in range(240)]
    second = [("B", "val", i, 4, 0.88, True, True, True, True, 30.0) for i in range(240)]
    d = spark.createDataFrame(first + second, "run string, split string, item_id long, k int, conf double, agree boolean, gold_ok boolean, has_gold boolean, tgold_ok boolean, latency_ms double")
    a = cascade.align(d, ("A", "B")).withColumn("t_lat", F.lit(900.0))
    assert cascade.misaligned(a, ("A", "B")).count() == 0
    best = cascade.search_thresholds(a, ("A", "B"), config.parse_grid("0.3:0.9:0.1"), 0.0).first()
    assert 0.72 < best.tau_A <= 0.97 and best.agreement == 1.0
    # two thirds go on to the second stage, none to the teacher
    assert best.escalation == pytest.approx(0.0) and best.mean_latency_ms == pytest.approx(2.0 + 30.0 * 2 / 3)
    m = cascade.evaluate(a, ("A", "B"), (best.tau_A, None), {"A": 4.0, "B": 9.0, "teacher": 70.0}).first()
    assert m.agreement == 1.0 and m.escalation_A == pytest.approx(2 / 3, abs=1e-6)
    s = {r.stage: r for r in cascade.singles(a, ("A", "B"), {"A": 4.0, "B": 9.0}).collect()}
    assert s["A"].agreement == pytest.approx(1 / 3, abs=1e-6) and s["B"].agreement == 1.0 and s["teacher"].mean_latency_ms == 900.0


# ---- telemetry -----------------------------------------------------------------------------

def energy(spark, samples, t0, t1, pad=2.0):
    us = lambda t: int(t * 1e6)
    s = spark.createDataFrame([("c", us(t), i, p) for i, (t, p) in enumerate(samples)], "card string, ts_us long, event_id long, power_w double")
    r = spark.createDataFrame([(1, "c", us(t0), us(t1))], "req_id long, card string, t0 long, t1 long")
    return telemetry.interval_energy(r, telemetry.segments(s), us(pad)).first().joules


def test_interval_energy_is_the_integral(spark):
    """Against the integral of a piecewise linear curve, computed on a fine grid."""
    curve = [(0.0, 4.0), (1.5, 9.0), (2.0, None), (3.5, 1.0), (6.0, 12.0), (7.25, 3.0)]
    known = [(t, p) for t, p in curve if p is not None]
    for t0, t1 in [(0.0, 7.25), (0.75, 1.25), (1.0, 5.5), (3.5, 6.0), (2.0, 2.5)]:
        grid = np.linspace(t0, t1, 20001)
        area = np.trapezoid(np.interp(grid, *zip(*known)), grid)
        assert energy(spark, curve, t0, t1, pad=4.0) == pytest.approx(area, abs=1e-4)
    assert energy(spark, curve, 4.0, 4.0, pad=4.0) == 0.0
    assert energy(spark, [(1.0, None)], 0.5, 2) is None
    assert energy(spark, [(3.0, 8.0), (4.0, 8.0)], 9, 11) is None


def test_interval_energy_against_every_sample(spark):
    """Many samples, cards and windows, with gaps, unread samples and windows beyond all samples."""
    rng = random.Random(11)
    us = lambda t: int(t * 1e6)
    samples, t = [], {"a": 0.0, "b": 500.0}
    for i in range(900):
        card = rng.choice("aab")
        t[card] += rng.choice([0.3, 1.0, 2.5, 400.0])
        samples.append((card, us(t[card]), i, None if rng.random() < 0.1 else round(rng.uniform(1, 90), 3)))
    requests = []
    for i in range(300):
        start = rng.uniform(-5, max(t.values()) + 5)
        requests.append((i, rng.choice("abc"), us(start), us(start + rng.choice([0, 0.5, 7, 900, -1]))))
    pad = us(3)

    def brute(card, t0, t1):
        pts = sorted((x, p) for c, x, _, p in samples if c == card and p is not None and t0 - pad <= x <= t1 + pad)
        if not pts or t1 < t0:
            return None
        if t0 == t1:
            return 0.0
        if pts[0][0] - t0 > pad or t1 - pts[-1][0] > pad:
            return None
        knots = sorted({t0, t1} | {x for x, _ in pts if t0 < x < t1})
        p = np.interp(knots, *zip(*pts))
        return float(np.trapezoid(p, np.array(knots) / 1e6))

    s = spark.createDataFrame(samples, "card string, ts_us long, event_id long, power_w double")
    r = spark.createDataFrame(requests, "req_id long, card string, t0 long, t1 long")
    got = {x.req_id: x.joules for x in telemetry.interval_energy(r, telemetry.segments(s), pad).collect()}
    assert len(got) == len(requests)
    for i, card, t0, t1 in requests:
        assert got[i] == pytest.approx(brute(card, t0, t1), abs=1e-6), (card, t0, t1)


def test_hysteresis_and_pauses(spark):
    temps = [70, 88, 85, 79, 78, 87, 90, 80, 77]
    d = spark.createDataFrame([("c", t * 1_000_000, t, float(x)) for t, x in enumerate(temps)], "card string, ts_us long, event_id long, temp_c double")
    st = telemetry.guard_states(d)
    assert [r.paused for r in st.orderBy("ts_us").collect()] == [0, 1, 1, 1, 0, 0, 1, 1, 0]
    assert rows(telemetry.pauses(st).select("start_us", "end_us")) == [(1_000_000, 4_000_000), (6_000_000, 8_000_000)]


def test_bench_report_golden(spark):
    schema = "config string, rep int, req long, prompt_id long, category string, ok boolean, tokens_predicted int, wall_s double, gen_rate double, sha string, draft_n int, draft_ok int, energy_j double"
    d = spark.createDataFrame([
        ("ref", 0, 1, 1, "a", True, 100, 1.0, 40.0, "h1", 0, 0, 12.0), ("ref", 1, 2, 1, "a", True, 100, 1.0, 40.0, "h1", 0, 0, None),
        ("fast", 0, 3, 1, "a", True, 100, 0.5, 100.0, "h1", 8, 5, 10.0), ("fast", 0, 4, 2, "b", True, 100, 0.5, 100.0, "x", 8, 5, None), ("fast", 0, 5, 2, "b", False, None, None, None, None, None, None, None),
        ("ref", 0, 6, 2, "b", True, 100, 1.0, 40.0, "h2", 0, 0, None)], schema)
    r = {x.config: x for x in bench.config_report(d, "ref", draft_max=4).collect()}
    assert r["fast"].speedup == 2.5 and r["fast"].wall_rate == 200 and r["ref"].wall_rate == 100
    assert r["fast"].accept_rate == 0.625 and r["fast"].accept_len == 2.5 and r["fast"].j_per_token == 0.1 and r["ref"].j_per_token == 0.12 and r["fast"].n_fail == 1
    m = {x.config: (x.match_n, x.match_total) for x in bench.match_rates(d, "ref").collect()}
    assert m == {"fast": (1, 2), "ref": (1, 1)}


# ---- embeddings ----------------------------------------------------------------------------

def vectors(spark, n=60, d=6, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows_ = [(i, [float(a) for a in x[i]], ("en", "ja")[i % 2]) for i in range(n)]
    return x, spark.createDataFrame(rows_, "id long, vec array<double>, lang string")


def test_nearest_block_and_small_paths_agree(spark, monkeypatch):
    x, d = vectors(spark)
    q = d.filter("id < 20")
    small = rows(embed.nearest(q, d, 3, require=("lang",)).select("qid", "pid", "rank"))
    auc = embed.pair_auc(q, d, label="lang", require=()).first().auc
    monkeypatch.setattr(embed, "SMALL_BYTES", 0)
    assert auc == pytest.approx(embed.pair_auc(q, d, label="lang", require=(), block=7).first().auc)
    assert small == rows(embed.nearest(q, d, 3, require=("lang",), block=7).select("qid", "pid", "rank"))
    for i in range(20):
        sim = np.round(x @ x[i], 6)
        want = sorted((j for j in range(60) if j != i and j % 2 == i % 2), key=lambda j: (-sim[j], j))[:3]
        assert [p for qid, p, _ in sorted(small, key=lambda r: r[2]) if qid == i] == want


def test_principal_axes(spark):
    x, d = vectors(spark, 90, 5)
    p = embed.principal_axes(d, "vec", 4)
    assert p.rows.shape == (4, 5) and np.allclose(p.rows @ p.rows.T, np.eye(4), atol=1e-9) and (p.rows.sum(axis=1) > 0).all()
    shown = np.stack([r.y for r in embed.project(d, "vec", p.mean, p.rows.T, "y").orderBy("id").collect()])
    # the coordinates are uncorrelated, and have the variances given, in falling order
    assert np.allclose(np.cov(shown.T), np.diag(p.variance), atol=1e-9) and (p.variance[:-1] >= p.variance[1:]).all()
    assert np.isclose(p.total, np.trace(np.cov(x.T))) and p.n == 90


def test_ridge_is_judged_on_groups_it_has_not_seen(spark):
    rng = np.random.default_rng(31)
    x, w = rng.normal(size=(240, 7)), rng.normal(size=(7, 3))
    random_ = rng.normal(size=(240, 3))
    data = [(i, i % 24, i % 6 != 2, x[i].tolist(), random_[i].tolist(), (x[i] @ w + 1).tolist()) for i in range(240)]
    d = spark.createDataFrame(data, "uid long, grp long, seen boolean, x array<double>, noise array<double>, lin array<double>")
    fit, _, scores = embed.ridge_by_groups(d, "x", "noise", "grp", parts=4)
    assert max(scores.values()) < 0.35
    assert fit.filter("seen").groupBy("grp").agg(F.countDistinct("part").alias("n")).filter("n <> 1").isEmpty()
    assert {r.part for r in fit.filter("not seen").select("part").distinct().collect()} == {-1}
    got, penalty, scores = embed.ridge_by_groups(d, "x", "lin", "grp", parts=4)
    assert max(scores.values()) > 0.98 and penalty == min(embed.PENALTIES)
    # an unseen row's prediction is the direct solution on all seen rows
    seen = np.array([i % 6 != 2 for i in range(240)])
    xc, yc = x[seen] - x[seen].mean(0), (x @ w + 1)[seen] - (x @ w + 1)[seen].mean(0)
    direct = np.linalg.solve(xc.T @ xc + penalty * np.trace(xc.T @ xc) / 7 * np.eye(7), xc.T @ yc)
    for r in got.filter("not seen").limit(5).collect():
        assert np.allclose(r.pred, (np.array(r.x) - x[seen].mean(0)) @ direct + (x @ w + 1)[seen].mean(0))


# ---- tokens --------------------------------------------------------------------------------

def test_packing_keeps_order_and_drops_the_rest(spark):
    rng = random.Random(5)
    docs = [(i, [rng.randrange(100) for _ in range(rng.randrange(0, 30))]) for i in range(50)]
    d = spark.createDataFrame(docs, "id long, toks array<int>").repartition(6)
    out = tokens.pack(d, 8, ["id"], prefix.id_bucket("id", 7)).orderBy("row_no").collect()
    flat = [t for _, ts in docs for t in ts]
    assert [t for r in out for t in r.tokens] == flat[:len(flat) // 8 * 8]


def test_encoder_is_greedy_and_falls_back_to_bytes(spark):
    lines = spark.createDataFrame([("aaab aaab aab",), ("ab ba",)] * 50 + [("é",)], "line string")
    vocab = tokens.learn_vocab(lines, tokens.PIECES_FROM + 12)
    pieces = {r.piece: r.id for r in vocab.collect()}
    assert len(set(pieces.values())) == len(pieces) and min(pieces.values()) == tokens.PIECES_FROM
    d = spark.createDataFrame([("aaab ab",), ("z",), ("",)], "t string")
    got = [r.ids for r in d.withColumn("ids", tokens.encoder(d, vocab)("t")).collect()]

    def brute(text):
        out = []
        for w in text.split():
            w = tokens.SPACE + w
            while w:
                n = next((n for n in range(min(6, len(w)), 0, -1) if w[:n] in pieces), 0)
                out += [pieces[w[:n]]] if n else [tokens.BYTES_FROM + b for b in w[0].encode()]
                w = w[max(n, 1):]
        return out or [tokens.UNK]

    assert got == [brute(t) for t in ("aaab ab", "z", "")]


def test_prefix_cut(spark):
    cut = lambda q, c, w: one(spark, tokens.cut_prefix("q", "c", w), q=q, c=c)
    assert cut([7, 8], [1, 2, 3], 10) == [7, 8, 4, 1, 2, 3]
    assert cut([7, 8], [1, 2, 3], 5) == [7, 8, 4, 2, 3]
    assert cut([7, 8, 9], [1], 3) == [7, 8, 4]


@pytest.mark.parametrize("small_bytes", [0, embed.SMALL_BYTES])
def test_products_stay_small_whatever_the_pool(spark, monkeypatch, small_bytes):
    """No product meets more than a block of the pool at once, and lists of several blocks merge into the best of all."""
    x, d = vectors(spark)
    whole = embed._best

    def checked(q, p, pm, *rest):
        assert len(pm) == len(p) <= 7
        return whole(q, p, pm, *rest)

    monkeypatch.setattr(embed, "SMALL_BYTES", small_bytes)
    monkeypatch.setattr(embed, "_best", checked)
    got = rows(embed.nearest(d, d, 4, block=7).select("qid", "pid", "rank"))
    sim = np.round(x @ x.T, 6)
    for i in range(60):
        want = sorted((j for j in range(60) if j != i), key=lambda j: (-sim[i, j], j))[:4]
        assert [p for qid, p, _ in sorted(got, key=lambda r: r[2]) if qid == i] == want


def test_encoder_keeps_ids_in_arrow_buffers(spark):
    """A batch's ids are no Python lists; null, blank and unknown texts keep their ids."""
    from pyspark.util import PythonEvalType

    from decant.operators import tokens

    vocab = spark.createDataFrame([("▁a", 300), ("b", 301), ("▁", 302)], "piece string, id int")
    rows = spark.createDataFrame([(1, "ab a"), (2, None), (3, " \n"), (4, "é"), (5, "")], "k int, text string").coalesce(1)
    enc = tokens.encoder(rows, vocab)
    got = {r.k: r.ids for r in rows.withColumn("ids", enc("text")).collect()}
    assert got == {1: [300, 301, 300], 2: [tokens.UNK], 3: [tokens.UNK], 4: [302, *[tokens.BYTES_FROM + b for b in "é".encode()]], 5: [tokens.UNK]}
    assert enc.evalType == PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF
