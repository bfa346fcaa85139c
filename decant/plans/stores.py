"""Sources, sinks and store queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decant.functions import dist as D
from decant.functions import hashing as H
from decant.operators import store as S
from decant.operators.prefix import id_bucket, prefix
from decant.plans import fixtures as X
from decant.plans.registry import query, table, with_
from decant.session import scratch
from decant.sources import readers as R
from decant.sources import writers as W

CAND = "array_join(candidates, '|') as candidates"
CANDQ = "array_to_string(candidates, '|') AS candidates"


# ---- sources -------------------------------------------------------------------------------

@query("src_items", with_("item_attr") + f"SELECT item_id, split, source, {CANDQ}, gold FROM item_attr")
def src_items(spark, sf):
    stored = X.dec_items(spark, sf).withColumn("candidates", F.to_json("candidates"))
    return R.decode_items(stored).selectExpr("item_id", "split", "source", CAND, "gold")


@query("src_jsonl", "SELECT role, count(*) AS n, sum(length(text))::BIGINT AS chars, max(turn) AS last_turn FROM conversations GROUP BY role")
def src_jsonl(spark, sf):
    path = scratch(spark, "jsonl")
    table(spark, sf, "conversations").write.json(path)
    d = R.jsonl(spark, path, "conv_id bigint, turn bigint, role string, text string")
    return d.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), F.max("turn").alias("last_turn"))


@query("src_jsonl_tolerant", """
SELECT role, count(*) AS n, sum(length(text))::BIGINT AS chars FROM conversations WHERE (conv_id + turn) % 7 <> 0 GROUP BY role""")
def src_jsonl_tolerant(spark, sf):
    path = scratch(spark, "jsonl-damaged")
    line = F.to_json(F.struct("conv_id", "turn", "role", "text"))
    cut = F.when((F.col("conv_id") + F.col("turn")) % 7 == 0, F.substring(line, 1, 25)).otherwise(line)
    table(spark, sf, "conversations").select(cut.alias("value")).write.text(path)
    d = R.jsonl_tolerant(spark, path, "conv_id bigint, turn bigint, role string, text string")
    return d.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


NAMES = ("alarm_set", "alarm_query", "music_play", "news_query", "cooking_recipe", "play_radio", "weather_query", "email_send", "lists_add", "qa_maths")


@query("src_parquet_labels", f"SELECT vec_id, {list(NAMES)!r}[label + 1] AS intent, coalesce(CASE WHEN vec_id % 3 <> 0 THEN 'en-US' END, 'ja-JP') AS locale FROM embeddings")
def src_parquet_labels(spark, sf):
    d = table(spark, sf, "embeddings").select("vec_id", "label").withColumn("locale", F.when(F.col("vec_id") % 3 != 0, "en-US"))
    names = F.array(*map(F.lit, NAMES))
    return d.select("vec_id", F.get(names, F.col("label")).alias("intent"), F.coalesce("locale", F.lit("ja-JP")).alias("locale"))


@query("src_label_check", """
WITH o AS (SELECT DISTINCT p_brand FROM part), e AS (SELECT 'Brand#' || unnest(range(0, 20)) AS p_brand)
SELECT p_brand, 'data' AS only_in FROM o WHERE p_brand NOT IN (SELECT p_brand FROM e)
UNION ALL SELECT p_brand, 'table' FROM e WHERE p_brand NOT IN (SELECT p_brand FROM o)""")
def src_label_check(spark, sf):
    expected = spark.createDataFrame([(f"Brand#{i}",) for i in range(20)], "p_brand string")
    return R.label_mismatch(table(spark, sf, "part"), expected, "p_brand")


@query("src_tsv", """
SELECT count(*) AS n, count(DISTINCT c_custkey) AS keys, 0::BIGINT AS first_idx, count(*) - 1 AS last_idx, round(sum(c_acctbal), 2) AS balance FROM customer""")
def src_tsv(spark, sf):
    path = scratch(spark, "tsv")
    table(spark, sf, "customer").repartition(3).write.option("sep", "\t").option("header", True).csv(path)
    d = R.tsv(spark, path, "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")
    return d.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("c_custkey").alias("keys"), F.min("_idx").alias("first_idx"),
                 F.max("_idx").alias("last_idx"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("src_articles", "SELECT doc_id, length(text) AS chars FROM documents")
def src_articles(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.length("text").cast("bigint").alias("chars"))


@query("src_metrics_csv", with_("tel") + """
SELECT card, count(*) AS n, count(power_w) AS n_power, round(sum(power_w), 2) AS power, count(vram_mb) AS n_vram FROM tel GROUP BY card""")
def src_metrics_csv(spark, sf):
    path = scratch(spark, "metrics-csv")
    d = X.tel(spark, sf).select("event_id", "card", F.when(F.col("power_w").isNull(), F.lit("NaN")).otherwise(F.col("power_w").cast("string")).alias("power_w"), "vram_mb")
    d.write.option("header", True).csv(path)
    d = R.csv_nullable(spark, path, "event_id bigint, card string, power_w double, vram_mb double")
    return d.groupBy("card").agg(F.count(F.lit(1)).alias("n"), F.count("power_w").alias("n_power"), F.round(F.sum("power_w"), 2).alias("power"), F.count("vram_mb").alias("n_vram"))


@query("src_telemetry", with_("tel") + """
SELECT config, card, count(*) AS n, count(CASE WHEN event_id % 2 = 0 THEN vram_mb END) AS n_gtt,
  round(max(CASE WHEN event_id % 2 = 0 THEN vram_mb END), 1) AS gtt_peak FROM tel GROUP BY config, card""")
def src_telemetry(spark, sf):
    d = X.tel(spark, sf).select("event_id", "config", "card", "vram_mb")
    new, old = scratch(spark, "tel-new"), scratch(spark, "tel-old")
    d.filter("event_id % 2 = 0").withColumn("gtt_mb", F.col("vram_mb")).write.option("header", True).csv(new)
    d.filter("event_id % 2 = 1").write.option("header", True).csv(old)
    s = "event_id bigint, config string, card string, vram_mb double"
    u = R.with_defaults([R.csv_nullable(spark, new, s + ", gtt_mb double"), R.csv_nullable(spark, old, s)], {})
    return u.groupBy("config", "card").agg(F.count(F.lit(1)).alias("n"), F.count("gtt_mb").alias("n_gtt"), F.round(F.max("gtt_mb"), 1).alias("gtt_peak"))


@query("src_nested_doc", "SELECT event_id, coalesce(try_cast(props->>'$.k' AS DOUBLE), -1.0) AS k, (props->>'$.missing.path') IS NULL AS absent FROM events")
def src_nested_doc(spark, sf):
    d = table(spark, sf, "events")
    return d.select("event_id", R.nested("props", "k", "double", -1.0).alias("k"), R.nested("props", "missing.path").isNull().alias("absent"))


FILES = ("benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem", "nation", "orders", "pages", "part", "region", "supplier")


def table_rows(spark, sf):
    """Rows of every given table; a table may be a file or a folder of files."""
    each = [table(spark, sf, t).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(f"{t}.parquet").alias("file"), "rows") for t in FILES]
    return reduce(DataFrame.unionByName, each)


@query("src_file_manifest")
def src_file_manifest(spark, sf):
    return R.file_manifest(spark, sf, "*.parquet").join(table_rows(spark, sf), "file")


@query("src_file_rows", " UNION ALL ".join(f"SELECT '{t}' AS file, 'parquet' AS kind, count(*) AS rows FROM {t}" for t in FILES)
       + " UNION ALL SELECT 'nation', 'jsonl', count(*) FROM nation UNION ALL SELECT 'nation', 'tsv', count(*) FROM nation UNION ALL SELECT 'events', 'jsonl', count(*) FROM events UNION ALL SELECT 'events', 'tsv', count(*) FROM events")
def src_file_rows(spark, sf):
    """Rows by format: all given tables, and two of them written again as JSON lines and tab-separated text in several files."""
    parts = [table_rows(spark, sf).select(F.regexp_replace("file", r"\.parquet$", "").alias("file"), F.lit("parquet").alias("kind"), "rows")]
    for t in ("nation", "events"):
        d = table(spark, sf, t).repartition(3)
        text = d.select([F.col(c).cast("string").alias(c) for c in d.columns])
        for kind, writer in (("jsonl", d.write.json), ("tsv", text.write.option("sep", "\t").option("header", True).csv)):
            folder = scratch(spark, f"{t}-{kind}")
            writer(folder)
            parts.append(R.file_rows(spark, [folder], kind).agg(F.sum("rows").alias("rows")).select(F.lit(t).alias("file"), F.lit(kind).alias("kind"), "rows"))
    return reduce(DataFrame.unionByName, parts)


@query("src_schema_evolve", with_("item_attr") + """
SELECT CASE WHEN item_id % 2 = 0 THEN 'synth' ELSE source END AS source, count(*) AS n, count(CASE WHEN item_id % 2 = 1 THEN 1 END) AS n_extra
FROM item_attr GROUP BY 1""")
def src_schema_evolve(spark, sf):
    d = X.dec_items(spark, sf)
    old = d.filter("item_id % 2 = 0").drop("source", "extra")
    return R.with_defaults([d.filter("item_id % 2 = 1"), old], {"source": "synth"}).groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count("extra").alias("n_extra"))


# ---- sinks ---------------------------------------------------------------------------------

@query("sink_items", with_("item_attr") + "SELECT split, source, count(*) AS n, min(item_id) AS first_id, max(item_id) AS last_id FROM item_attr GROUP BY split, source")
def sink_items(spark, sf):
    d = X.dec_items(spark, sf)
    path = scratch(spark, "items")
    old = d.filter("item_id % 3 = 0")
    old.write.partitionBy("split", "source").parquet(path)
    W.insert_items(d.filter("item_id % 3 <> 0"), old, path)
    return spark.read.parquet(path).groupBy("split", "source").agg(
        F.count(F.lit(1)).alias("n"), F.min("item_id").alias("first_id"), F.max("item_id").alias("last_id"))


@query("sink_teacher_upsert", with_("teacher_keys") + """
, t AS (SELECT *, item_id % 4 = 0 AND item_id % 20 <> 0 AS replaced FROM teacher_keys)
SELECT item_id, CASE WHEN replaced THEN 'teacher-b' ELSE 'teacher-a' END AS teacher_model,
  round(CASE WHEN replaced THEN coalesce(latency_ms, 0) + 5 ELSE latency_ms END, 3) AS latency_ms, CASE WHEN item_id % 6 = 0 AND NOT replaced THEN 2 END::INTEGER AS attempts FROM t""")
def sink_teacher_upsert(spark, sf):
    """A fourth of the items are scored again, some of them without a proper distribution; a sixth had errors before."""
    i = F.col("item_id")
    old = X.dec_teacher_keys(spark, sf).select(i, F.lit("teacher-a").alias("teacher_model"), "latency_ms", F.array(F.lit(0.5), F.lit(0.5)).alias("probs"), F.timestamp_seconds(F.lit(1790000000) + i).alias("created_at"))
    half = F.when(i % 20 == 0, F.lit(0.25)).otherwise(F.lit(0.5))
    new = old.filter(i % 4 == 0).select(i, F.lit("teacher-b").alias("teacher_model"), (F.coalesce("latency_ms", F.lit(0.0)) + 5).alias("latency_ms"),
                                        F.array(half, half).alias("probs"), "created_at")
    errors = old.filter(i % 6 == 0).select(i, F.lit(2).alias("attempts"))
    scores, left, _ = S.record_scores(old, new, errors)
    return scores.join(left, "item_id", "left").select("item_id", "teacher_model", F.round("latency_ms", 3).alias("latency_ms"), "attempts")


@query("sink_error_upsert", """
SELECT user_id AS item_id, (count(*) + (user_id % 2))::INTEGER AS attempts, substr('event ' || max(event_id) || repeat('x', 600), 1, 500) AS error
FROM events WHERE event_type = 'error' GROUP BY user_id""")
def sink_error_upsert(spark, sf):
    e = table(spark, sf, "events").filter("event_type = 'error'")
    ts = F.timestamp_seconds(F.col("event_id"))
    fail = e.select(F.col("user_id").alias("item_id"), F.concat(F.lit("event "), F.col("event_id").cast("string"), F.repeat(F.lit("x"), 600)).alias("error"), ts.alias("updated_at"))
    old = fail.filter("item_id % 2 = 1").select("item_id").distinct().select(
        "item_id", F.lit(1).alias("attempts"), F.lit("earlier").alias("error"), F.timestamp_seconds(F.lit(-1)).alias("updated_at"))
    return S.upsert_errors(old, fail).select("item_id", "attempts", "error")


@query("sink_preview", with_("item_attr") + f"""
SELECT source, split, item_id, {CANDQ} FROM (SELECT *, row_number() OVER (PARTITION BY source, split ORDER BY item_id) AS rn FROM item_attr) WHERE rn <= 3""")
def sink_preview(spark, sf):
    first = prefix(X.dec_items(spark, sf), ["item_id"], id_bucket("item_id"), ["source", "split"], keep_below=("rn", 3))
    path = scratch(spark, "preview")
    first.select("source", "split", "item_id", "candidates").write.json(path)
    d = R.jsonl(spark, path, "source string, split string, item_id bigint, candidates array<string>")
    return d.selectExpr("source", "split", "item_id", CAND)


@query("sink_manifest_merge", with_("item_attr") + """
SELECT CASE WHEN source IN ('a', 'b') THEN 'ab' ELSE source END AS dataset,
  string_agg(source || '.' || split || '=' || n, ',' ORDER BY source, split) AS imported,
  any_value(CASE WHEN source = 'synth' THEN 'generated' ELSE 'converted' END) AS conversion
FROM (SELECT source, split, count(*) AS n FROM item_attr GROUP BY source, split) GROUP BY 1""")
def sink_manifest_merge(spark, sf):
    counts = X.dec_items(spark, sf).groupBy("source", "split").agg(F.count(F.lit(1)).alias("n"))
    notes = spark.createDataFrame([("synth", "synth", "generated"), ("a", "ab", "converted"), ("b", "ab", "converted"), ("c", "c", "converted")],
                                  "source string, dataset string, note string")
    line = F.concat_ws("", "source", F.lit("."), "split", F.lit("="), "n")
    return counts.join(F.broadcast(notes), "source").groupBy("dataset").agg(
        F.array_join(F.array_sort(F.collect_list(line)), ",").alias("imported"), F.max("note").alias("conversion"))


@query("sink_snapshot", "SELECT count(*) AS n_source, count(*) AS n_copy, true AS same FROM orders")
def sink_snapshot(spark, sf):
    both = W.snapshot(table(spark, sf, "orders"), scratch(spark, "snapshot"))
    pick = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    return both.agg(pick("source", "n").alias("n_source"), pick("copy", "n").alias("n_copy"), ((F.count_distinct("bits") == 1) & (F.count_distinct("total") == 1)).alias("same"))


@query("sink_report", with_("per_item") + """
SELECT '| ' || run || ' | ' || count(*) || ' | ' || printf('%.6f', round(avg((pred = tpred)::INT), 6)) || ' | ' || printf('%.6f', round(avg(kl), 6)) || ' |' AS line
FROM per_item GROUP BY run""")
def sink_report(spark, sf):
    from decant.operators import metrics as M

    m = M.core_metrics(M.score_items(X.dec_preds(spark, sf)), ["run"])
    path = scratch(spark, "report")
    W.report_lines(m, ["run", "n", "agreement", "kl"], 6).coalesce(1).write.text(path)
    return spark.read.text(path).withColumnRenamed("value", "line")


# ---- filters and store joins ---------------------------------------------------------------

@query("flt_source", with_("item_attr") + """
SELECT item_id, source IN ('a') OR source <> 'synth' AS in_public, source IN ('a', 'c') AS in_exact, true AS in_all FROM item_attr""")
def flt_source(spark, sf):
    return X.dec_items(spark, sf).select("item_id", S.source_filter(["a", "public"]).alias("in_public"), S.source_filter(["a", "c"]).alias("in_exact"), S.source_filter(None).alias("in_all"))


BROKEN_SQL = """CASE item_id % 10 WHEN 1 THEN [] WHEN 2 THEN list_append(candidates, '') ELSE candidates END"""


@query("flt_item_valid", with_("item_attr") + f"""
SELECT coalesce(problem, 'ok') AS problem, count(*) AS n FROM (SELECT CASE WHEN NOT len(c) BETWEEN 1 AND 16 THEN 'candidate count'
  WHEN list_contains(c, '') THEN 'empty candidate' WHEN g IS NOT NULL AND NOT (g >= 0 AND g < len(c)) THEN 'gold out of range' END AS problem
  FROM (SELECT {BROKEN_SQL} AS c, CASE WHEN item_id % 10 = 3 THEN 99 ELSE gold END AS g FROM item_attr)) GROUP BY 1""")
def flt_item_valid(spark, sf):
    d = X.dec_items(spark, sf).selectExpr(
        "case item_id % 10 when 1 then array() when 2 then array_append(candidates, '') else candidates end as candidates",
        "if(item_id % 10 = 3, 99, gold) as gold")
    return d.groupBy(F.coalesce(S.item_problem(), F.lit("ok")).alias("problem")).agg(F.count(F.lit(1)).alias("n"))


@query("flt_dist_valid", with_("teacher_long") + """
SELECT problem, count(*) AS n FROM (SELECT item_id, CASE item_id % 10 WHEN 1 THEN 'length' WHEN 2 THEN 'not finite' WHEN 3 THEN 'sum' ELSE 'ok' END AS problem
FROM teacher_long GROUP BY item_id) GROUP BY problem""")
def flt_dist_valid(spark, sf):
    d = X.dec_teacher(spark, sf).selectExpr(
        "logits", "case item_id % 10 when 1 then slice(probs, 2, 20) when 2 then transform(probs, p -> double('NaN')) when 3 then transform(probs, p -> p * 1.01D) else probs end as probs")
    return d.groupBy(F.coalesce(S.distribution_problem(), F.lit("ok")).alias("problem")).agg(F.count(F.lit(1)).alias("n"))


@query("flt_kmax", with_("item_attr") + "SELECT item_id, k FROM item_attr WHERE k <= 6")
def flt_kmax(spark, sf):
    return X.dec_items(spark, sf).select("item_id", F.size("candidates").alias("k")).filter("k <= 6")


@query("fn_json_roundtrip", """
SELECT conv_id, turn, length(text) AS chars, role || ':' || turn AS tag FROM conversations""")
def fn_json_roundtrip(spark, sf):
    d = table(spark, sf, "conversations")
    j = d.select("conv_id", "turn", F.to_json(F.struct("role", "text", "turn")).alias("obj"), F.to_json(F.array("role", F.col("turn").cast("string"))).alias("arr"))
    o = j.select("conv_id", "turn", F.from_json("obj", "role string, text string, turn bigint").alias("o"), F.from_json("arr", "array<string>").alias("a"))
    return o.select("conv_id", "turn", F.length("o.text").cast("bigint").alias("chars"), F.array_join("a", ":").alias("tag"))


@query("fn_tier", with_("item_attr") + "SELECT split, CASE WHEN split = 'train' THEN 0 ELSE 1 END::INTEGER AS tier, count(*) AS n FROM item_attr GROUP BY split")
def fn_tier(spark, sf):
    from decant.operators.build import tier

    return X.dec_items(spark, sf).groupBy("split", tier().alias("tier")).agg(F.count(F.lit(1)).alias("n"))


PENDING_SQL = with_("item_attr", "teacher_keys", "errors") + """
, pend AS (SELECT i.* FROM item_attr i LEFT JOIN teacher_keys t USING (item_id) LEFT JOIN errors e USING (item_id)
  WHERE t.item_id IS NULL AND coalesce(e.attempts, 0) < 2 {0})
"""


def _pend(spark, sf, **kw):
    return S.pending(X.dec_items(spark, sf), X.dec_teacher_keys(spark, sf), X.dec_errors(spark, sf), **kw)


@query("jn_pending", PENDING_SQL.format("AND i.split IN ('val', 'test') AND i.source <> 'synth' AND i.item_id % 25 <> 0") + "SELECT item_id, split, source FROM pend")
def jn_pending(spark, sf):
    skip = X.dec_items(spark, sf).select("item_id").filter("item_id % 25 = 0")
    return _pend(spark, sf, splits=["val", "test"], sources=["public"], exclude=skip).select("item_id", "split", "source")


@query("tk_priority", PENDING_SQL.format("") + """
SELECT item_id, split FROM pend ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 WHEN 'test' THEN 2 ELSE 4 END, item_id LIMIT 15""")
def tk_priority(spark, sf):
    return S.next_batch(_pend(spark, sf), 15).select("item_id", "split")


@query("jn_scored", with_("item_attr", "teacher_long") + """
SELECT i.item_id, i.split, i.source, count(*)::INTEGER AS k, round(sum(t.p), 6) AS mass, round(max(t.p), 6) AS top
FROM item_attr i JOIN teacher_long t ON i.item_id = t.item_id GROUP BY ALL""")
def jn_scored(spark, sf):
    d = X.dec_items(spark, sf).select("item_id", "split", "source").join(X.dec_teacher(spark, sf).select("item_id", "probs"), "item_id")
    return d.selectExpr("item_id", "split", "source", "size(probs) as k", f"round({D.total('probs')}, 6) as mass", "round(array_max(probs), 6) as top")


@query("jn_get_items", with_("item_attr") + f"SELECT item_id, split, {CANDQ} FROM item_attr WHERE item_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def jn_get_items(spark, sf):
    ids = table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("item_id"))
    return X.dec_items(spark, sf).join(ids, "item_id", "left_semi").selectExpr("item_id", "split", CAND)


@query("tk_keyset_page", with_("item_attr", "teacher_keys") + "SELECT item_id, split FROM item_attr JOIN teacher_keys USING (item_id) WHERE item_id > 200 ORDER BY item_id LIMIT 50")
def tk_keyset_page(spark, sf):
    d = X.dec_items(spark, sf).filter("item_id > 200").join(X.dec_teacher_keys(spark, sf).select("item_id"), "item_id", "left_semi")
    return d.orderBy("item_id").limit(50).select("item_id", "split")


@query("ag_counts", with_("item_attr", "teacher_keys", "errors") + """
SELECT split, count(*) AS total, count(t.item_id) AS scored, count(*) FILTER (t.item_id IS NULL AND e.item_id IS NOT NULL) AS errors
FROM item_attr i LEFT JOIN teacher_keys t USING (item_id) LEFT JOIN errors e USING (item_id) GROUP BY split""")
def ag_counts(spark, sf):
    i = X.dec_items(spark, sf).select("item_id", "split")
    t = X.dec_teacher_keys(spark, sf).select("item_id", F.lit(True).alias("has_t"))
    e = X.dec_errors(spark, sf).select("item_id", F.lit(True).alias("has_e"))
    d = i.join(t, "item_id", "left").join(e, "item_id", "left")
    return d.groupBy("split").agg(F.count(F.lit(1)).alias("total"), F.count("has_t").alias("scored"), F.count_if(F.col("has_t").isNull() & F.col("has_e")).alias("errors"))


@query("ag_counts_by_source", with_("item_attr", "teacher_keys") + """
SELECT coalesce(source, 'all') AS source, coalesce(split, 'all') AS split, count(*) AS total, count(t.item_id) AS scored
FROM item_attr i LEFT JOIN teacher_keys t USING (item_id) GROUP BY CUBE (source, split)""")
def ag_counts_by_source(spark, sf):
    i = X.dec_items(spark, sf).select("item_id", "split", "source")
    d = i.join(X.dec_teacher_keys(spark, sf).select("item_id", F.lit(True).alias("has_t")), "item_id", "left")
    # counted once per (source, split); the totals are rolled up from those few rows
    c = d.groupBy("source", "split").agg(F.count(F.lit(1)).alias("t"), F.count("has_t").alias("s"))
    c = c.cube("source", "split").agg(F.sum("t").alias("total"), F.sum("s").alias("scored"))
    return c.select(F.coalesce("source", F.lit("all")).alias("source"), F.coalesce("split", F.lit("all")).alias("split"), "total", "scored")


@query("ag_scored_count", with_("item_attr", "teacher_keys") + """
SELECT count(*) AS all_scored, count(*) FILTER (split = 'val') AS val_scored, count(*) FILTER (source <> 'synth') AS public_scored FROM item_attr JOIN teacher_keys USING (item_id)""")
def ag_scored_count(spark, sf):
    d = X.dec_items(spark, sf).select("item_id", "split", "source").join(X.dec_teacher_keys(spark, sf).select("item_id"), "item_id", "left_semi")
    return d.agg(F.count(F.lit(1)).alias("all_scored"), F.count_if(F.col("split") == "val").alias("val_scored"), F.count_if(S.source_filter(["public"])).alias("public_scored"))


@query("ag_summary", with_("item_attr") + """
SELECT source, split, kind, value, count(*) AS n FROM (
  SELECT source, split, unnest(['n', 'k', 'gold', 'lang', 'cat']) AS kind,
         unnest(['all', k::VARCHAR, (gold IS NOT NULL)::VARCHAR, lang, category]) AS value FROM item_attr) GROUP BY ALL""")
def ag_summary(spark, sf):
    d = X.dec_items(spark, sf).selectExpr(
        "source", "split", "inline(array(named_struct('kind', 'n', 'value', 'all'), named_struct('kind', 'k', 'value', string(size(candidates))), named_struct('kind', 'gold', 'value', string(gold is not null)), named_struct('kind', 'lang', 'value', lang), named_struct('kind', 'cat', 'value', category)))")
    return d.groupBy("source", "split", "kind", "value").agg(F.count(F.lit(1)).alias("n"))


@query("ag_teacher_stats", with_("teacher_long") + """
, i AS (SELECT item_id, any_value(source) AS source, any_value(split) AS split, any_value(gold) AS gold, count(*) AS k, max(p) AS mx, arg_min(pos, (-t, pos)) AS top FROM teacher_long GROUP BY item_id)
SELECT source, split, count(*) AS scored, count(gold) AS with_gold, round(avg(CASE WHEN gold IS NOT NULL THEN (top = gold)::INT END), 4) AS teacher_gold_acc,
  round(avg(CASE WHEN gold IS NOT NULL THEN 1.0 / k END), 4) AS random_gold_acc, round(avg(mx), 4) AS mean_max_prob FROM i GROUP BY source, split""")
def ag_teacher_stats(spark, sf):
    i = X.dec_items(spark, sf).select("item_id", "source", "split", "gold")
    d = i.join(X.dec_teacher(spark, sf).select("item_id", "logits", "probs"), "item_id")
    d = d.selectExpr("source", "split", "gold", f"double({D.argmax('logits')} = gold) as hit", "if(gold is null, null, 1D / size(probs)) as rnd", "array_max(probs) as mx")
    return d.groupBy("source", "split").agg(
        F.count(F.lit(1)).alias("scored"), F.count("gold").alias("with_gold"), F.round(F.avg("hit"), 4).alias("teacher_gold_acc"),
        F.round(F.avg("rnd"), 4).alias("random_gold_acc"), F.round(F.avg("mx"), 4).alias("mean_max_prob"))


@query("jn_done_resume", with_("bench") + """
, want AS (SELECT DISTINCT config, rep, prompt_id FROM bench), done AS (SELECT DISTINCT config, rep, prompt_id FROM bench WHERE ok AND req % 3 = 0 AND rep > 2)
SELECT config, rep, prompt_id FROM want ANTI JOIN done USING (config, rep, prompt_id)""")
def jn_done_resume(spark, sf):
    b = X.bench_results(spark, sf)
    keys = ["config", "rep", "prompt_id"]
    return b.select(*keys).distinct().join(b.filter("ok and req % 3 = 0 and rep > 2").select(*keys).distinct(), keys, "left_anti")


# ---- sets ----------------------------------------------------------------------------------

@query("st_existing_keys", with_("item_attr") + """
SELECT n.item_id FROM item_attr n WHERE NOT EXISTS (SELECT 1 FROM item_attr o WHERE o.item_id % 2 = 0
  AND o.context = n.context AND o.question = n.question AND o.candidates = n.candidates)""")
def st_existing_keys(spark, sf):
    d = X.dec_items(spark, sf).select("item_id", S.item_key().alias("key"))
    return d.join(d.filter("item_id % 2 = 0").select("key"), "key", "left_anti").select("item_id")


STRINGS_SQL = "SELECT DISTINCT text AS s FROM conversations WHERE {0}"


@query("st_distinct_strings", "SELECT count(*) AS n, count(DISTINCT text) AS n_unique FROM conversations")
def st_distinct_strings(spark, sf):
    c = table(spark, sf, "conversations").groupBy(F.sha2("text", 256).alias("h")).agg(F.count(F.lit(1)).alias("c"))
    return c.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_unique"))


@query("st_unseen", f"{STRINGS_SQL.format('conv_id % 5 = 0')} EXCEPT {STRINGS_SQL.format('conv_id % 5 <> 0')}")
def st_unseen(spark, sf):
    d = table(spark, sf, "conversations")
    return d.filter("conv_id % 5 = 0").selectExpr("text as s").subtract(d.filter("conv_id % 5 <> 0").selectExpr("text as s"))


@query("st_overlap", """
SELECT count(*) FILTER (a) AS n_val, count(*) FILTER (b) AS n_test, count(*) FILTER (a AND b) AS n_both
FROM (SELECT sha1(text) AS h, bool_or(doc_id % 2 = 0) AS a, bool_or(doc_id % 2 = 1) AS b FROM documents GROUP BY 1)""")
def st_overlap(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha1("text").alias("h"))
    val, test = (d.filter(F.col("doc_id") % 2 == r).select("h") for r in (0, 1))
    both = val.intersect(test).withColumn("w", F.lit("n_both"))
    u = val.distinct().withColumn("w", F.lit("n_val")).unionByName(test.distinct().withColumn("w", F.lit("n_test"))).unionByName(both)
    return u.agg(*[F.count_if(F.col("w") == w).alias(w) for w in ("n_val", "n_test", "n_both")])


@query("st_roles", with_("item_attr") + """
SELECT s, string_agg(DISTINCT role, ',' ORDER BY role) AS roles, bool_or(split = 'train') AS in_train
FROM (SELECT unnest(candidates) AS s, source || '_' || split AS role, split FROM item_attr) GROUP BY s""")
def st_roles(spark, sf):
    d = X.dec_items(spark, sf).selectExpr("explode(candidates) as s", "concat(source, '_', split) as role", "split = 'train' as tr")
    # one row per (string, role) before anything is collected: the set is at most sources x splits long
    d = d.groupBy("s", "role").agg(F.bool_or("tr").alias("tr"))
    return d.groupBy("s").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"), F.bool_or("tr").alias("in_train"))


@query("st_split_disjoint", """
SELECT sha1(text) AS key, count(DISTINCT doc_id % 3) AS n_splits, count(*) AS n FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id % 3) > 1""")
def st_split_disjoint(spark, sf):
    d = table(spark, sf, "documents").select(F.sha1("text").alias("key"), (F.col("doc_id") % 3).alias("sp"))
    d = d.groupBy("key", "sp").agg(F.count(F.lit(1)).alias("c"))
    return d.groupBy("key").agg(F.count(F.lit(1)).alias("n_splits"), F.sum("c").alias("n")).filter("n_splits > 1")


@query("sg_quota_stages", PENDING_SQL.format("") + """
, sc AS (SELECT split, source FROM item_attr JOIN teacher_keys USING (item_id)),
 s0 AS (SELECT item_id, row_number() OVER (ORDER BY item_id) AS rn FROM pend WHERE split = 'val' AND source <> 'synth'),
 s1 AS (SELECT item_id, row_number() OVER (ORDER BY item_id) AS rn FROM pend WHERE split = 'train')
SELECT item_id, min(stage)::INTEGER AS stage FROM (
  SELECT item_id, 0 AS stage FROM s0 WHERE rn <= (SELECT (SELECT count(*) FROM item_attr WHERE split = 'val') * 0 + 75 - count(*) FROM sc WHERE split = 'val' AND source <> 'synth')
  UNION ALL SELECT item_id, 1 FROM s1 WHERE rn <= (SELECT 270 - count(*) FROM sc WHERE split = 'train')
  UNION ALL SELECT item_id, 2 FROM pend WHERE split = 'test' AND source IN ('a', 'b')) GROUP BY item_id""")
def sg_quota_stages(spark, sf):
    from decant.operators.config import parse_stages

    items = X.dec_items(spark, sf).select("item_id", "split", "source")
    scored = items.join(X.dec_teacher_keys(spark, sf).select("item_id"), "item_id", "left_semi")
    stages = parse_stages("val:75@public,train:270,test@a+b", ("synth", "a", "b", "c"))
    return S.quota_stages(items, scored, stages, _pend(spark, sf).select("item_id", "split", "source"), id_bucket("item_id"))


@query("ag_content_hash", with_("item_attr") + """
, r AS (SELECT item_id, sha256(item_id || '|' || context || '|' || question || '|' || array_to_string(candidates, '|')) AS h FROM item_attr),
 p AS (SELECT item_id // 64 AS b, sha256(string_agg(h, '' ORDER BY item_id)) AS h FROM r GROUP BY 1),
 p2 AS (SELECT b // 64 AS b, sha256(string_agg(h, '' ORDER BY b)) AS h FROM p GROUP BY 1)
SELECT (SELECT count(*) FROM r) AS n, (SELECT bit_xor(('0x' || substr(h, 1, 15))::BIGINT) FROM r) AS bits, (SELECT sha256(string_agg(h, '' ORDER BY b)) FROM p2) AS ordered""")
def ag_content_hash(spark, sf):
    h = F.sha2(F.concat_ws("|", "item_id", "context", "question", F.array_join("candidates", "|")), 256)
    d = X.dec_items(spark, sf).select("item_id", h.alias("h"))
    return W.content_hash(d, "item_id", "h", fan=64, levels=2)


@query("fn_stable_seed", f"SELECT doc_id, {X.seed_sql('doc', 'doc_id')} AS seed FROM documents")
def fn_stable_seed(spark, sf):
    return table(spark, sf, "documents").select("doc_id", H.stable_seed("doc", F.col("doc_id")).alias("seed"))


@query("fn_rank_key", f"SELECT doc_id, {X.rank_sql('source', 'doc_id')} AS rank_key FROM documents")
def fn_rank_key(spark, sf):
    return table(spark, sf, "documents").select("doc_id", H.rank_key(F.col("source"), F.col("doc_id")).alias("rank_key"))
