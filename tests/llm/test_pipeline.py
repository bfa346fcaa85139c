import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from decant.llm import packing


@pytest.fixture(scope="module")
def docs(make, prose):
    rows = [(i, prose(i, 40 + i % 70), "en" if i % 2 else "fr", f"s{i % 4}") for i in range(120)]
    rows += [(200 + i, rows[i][1] + " tail", "en", "s0") for i in range(0, 40, 4)]
    rows += [(300, None, "en", "s1"), (301, "123 !!!", "fr", None), (302, "", None, "s2"), (303, "write to a.b@c.org or 4539578763621486 now please", "en", None), (304, "mail d@e.fr", None, "s3"), (1, rows[1][1], "en", "s1")]
    return make(rows, clash=False).withColumnRenamed("n_chars", "_n").selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as bigint) as n_chars")


def test_stages(spark, docs):
    steps, frame = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, "unused")
        steps[name] = [r.asDict() for r in frame.collect()]
        if name != "pack":
            assert frame.columns == docs.columns
            frame = spark.createDataFrame([tuple(r.values()) for r in steps[name]], docs.schema)
    whole = [r.asDict() for r in docs.collect()]
    key = lambda r: str(sorted(r.items(), key=str))
    kept = [r for r in whole if any(c.isalpha() for c in r["text"] or "")]
    assert sorted(steps["language"], key=key) == sorted(kept, key=key)
    # ten copies differ by one word at the end and one row is repeated: their first documents stay
    gone = {200 + i for i in range(0, 40, 4)}
    assert sorted(r["doc_id"] for r in steps["near_dedup"]) == sorted({r["doc_id"] for r in kept} - gone)
    clean = {r["doc_id"]: r for r in steps["personal_data"]}
    assert clean[303]["text"] == "write to <EMAIL> or <CARD> now please" and clean[304]["text"] == "mail <EMAIL>"
    assert all(r["n_chars"] == len(r["text"]) for r in clean.values())
    assert all(clean[r["doc_id"]] == r for r in steps["near_dedup"] if r["doc_id"] not in (303, 304))
    times = {}
    for r in steps["mix"]:
        assert clean[r["doc_id"]] == r
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert set(times.values()) <= {1, 2}
    words = lambda rows: sum(len(r["text"].split()) for r in rows)
    assert abs(words(steps["mix"]) - 1.5 * words(clean.values())) < 0.15 * words(clean.values())
    encode = packing.Encoder(packing.default_path())
    tokens = sum(len(encode(r["text"])) // 4 + 1 for r in steps["mix"])
    assert sum(r["length"] for r in steps["pack"]) == tokens
    fill = {}
    for r in steps["pack"]:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
        ids = np.append(np.frombuffer(encode(clean[r["doc_id"]]["text"]), dtype="<u4"), 0)
        assert (np.frombuffer(r["ids"], dtype="<u2") == ids[r["start"] : r["start"] + r["length"]]).all()
    assert max(fill.values()) <= 2048 and len(fill) <= -(-tokens // 2048) + 1


def test_registered_queries_run(spark, sf):
    q = entry.queries()
    assert [n for n in range(1, 11) if not any(k.startswith(f"op{n}_") for k in q)] == [] and "pipeline" in q
    out = q["pipeline"](spark, sf)
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset", "ids"} <= set(out.columns)


def test_empty(spark, docs):
    frame = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, "unused")
    assert frame.collect() == []


def test_the_language_decides(spark, make):
    rng = np.random.default_rng(3)
    pools = {"xa": "ka lo mi ne ru".split(), "xb": "stra schi ung keit en".split(), "xc": "wy qo fjo vux zig".split()}
    text = lambda pool: " ".join("".join(rng.choice(pool, 3)) for _ in range(40))
    rows = [(i, text(pools[k]), k) for i in range(300) for k in [list(pools)[i % 3]]]
    new = [(1000 + i, text(pools[k]), None) for i, k in enumerate(pools)]
    none = [(2000, text("привет да нет мир я".split()), None), (2001, text("αβγ δεζ ηθι κλμ".split()), "xa"), (2002, text("привет да нет мир я".split()), "zz")]
    docs = make(rows + new + none, clash=False)
    got = {r.doc_id: r for r in corpus_pipeline.language(spark, docs, "unused").collect()}
    assert all(got[i].lang == k for i, _, k in rows)
    assert [got[1000 + i].lang for i in range(3)] == list(pools)
    assert 2000 not in got and got[2002].lang == "zz"
    # without a label there is no model: only documents without a letter go
    bare = make([(1, "some words", None), (2, "12 !", None), (3, None, None)], clash=False)
    assert [(r.doc_id, r.lang) for r in corpus_pipeline.language(spark, bare, "unused").collect()] == [(1, None)]


def test_whole_texts_reach_python_in_small_batches(spark, docs, tmp_path, monkeypatch):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen = spark.conf.get(name), {}

    def noted(write):
        def run(df, step):
            seen[step] = int(spark.conf.get(name))
            return write(df, step)
        return run

    for module in (corpus_pipeline, packing):
        monkeypatch.setattr(module, "materialise", noted(module.materialise))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {"language", "near_dedup", "personal_data", "mix", "pieces"} <= set(seen) and max(seen.values()) <= 256
    assert spark.conf.get(name) == before and out.count() > 0
