"""Item builder queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from decant.functions import hashing as H
from decant.functions import text as T
from decant.operators import build as B
from decant.plans import fixtures as X
from decant.plans.registry import cte, query, table, with_
from decant.plans.texts import CLIP, SAN
from decant.session import even, spread


def int_sql(*parts):
    return f"('0x' || substr({X.rank_sql(*parts)}, 1, 8))::BIGINT"


def pick_sql(items, *parts):
    return f"([{', '.join(repr(i) for i in items)}])[{int_sql(*parts)} % {len(items)} + 1]"


SPLIT_SQL = "CASE WHEN {0} < 0.7 THEN 'train' WHEN {0} < 0.85 THEN 'val' ELSE 'test' END"


def split_text(source, key):
    u = H.uniform_text(T.q(source), key)
    return f"case when {u} < 0.7D then 'train' when {u} < 0.85D then 'val' else 'test' end as split"


def split_sql(source, key):
    return SPLIT_SQL.format(X.unif_sql(f"'{source}'", key)) + " AS split"


def phrases(labels):
    """Phrase table made by rule: two wordings per tier, tiers disjoint."""
    return {x: ([f"about {x}", f"it concerns {x}"], [f"the theme is {x}", f"this deals with {x}"]) for x in labels}


def shown_sql(src, key, extra=""):
    """Shuffled, phrased candidates of a base table (key, split, labels, gold_label)."""
    word = ("CASE WHEN split = 'train' THEN CASE WHEN i = 0 THEN 'about ' ELSE 'it concerns ' END ELSE CASE WHEN i = 0 THEN 'the theme is ' ELSE 'this deals with ' END END || lab")
    return f"""SELECT {key} AS key, split, {extra} string_agg({word}, '|' ORDER BY h) AS candidates, max(CASE WHEN lab = gold_label THEN pos END)::INTEGER AS gold
FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY h) - 1 AS pos FROM (
  SELECT *, {X.rank_sql("'ord'", key, 'lab')} AS h, {int_sql("'ph'", key, 'lab')} % 2 AS i FROM (SELECT * EXCLUDE (labels), unnest(labels) AS lab FROM {src}))) GROUP BY ALL"""


CAND = "array_join(candidates, '|') as candidates"
TOPICS = [f"topic {i}" for i in range(10)]


@query("mk_item", f"""
SELECT doc_id::VARCHAR AS key, {split_sql('doc', 'doc_id')}, {X.seed_sql('doc', 'doc_id')} AS gen_seed, 'doc' AS source, sha1({SAN.format('text')}) AS h FROM documents""")
def mk_item(spark, sf):
    d = spread(table(spark, sf, "documents")).selectExpr("doc_id", split_text("doc", "doc_id"), f"{T.sanitize('text')} as context", "'q' as question", "array('a', 'b') as candidates", "0 as gold")
    return B.item(d, "doc", "doc_id", "intent").selectExpr("key", "split", "gen_seed", "source", "sha1(context) as h")


cte("ph_base", f"""
SELECT p.item_id AS k, {split_sql('emb', 'p.item_id')}, list('topic ' || lab ORDER BY pos) AS labels, CASE WHEN p.item_id % 7 <> 0 THEN 'topic ' || any_value(gold_label) END AS gold_label
FROM item_pos p GROUP BY p.item_id""", "item_pos")


@query("mk_phrase_candidates", with_("ph_base") + shown_sql("ph_base", "k"))
def mk_phrase_candidates(spark, sf):
    d = table(spark, sf, "embeddings").selectExpr("vec_id as key", "label", split_text("emb", "vec_id"), f"transform({X.ITEM_LABELS}, x -> concat('topic ', x)) as labels")
    d = d.withColumn("gold_label", F.expr("if(key % 7 <> 0, concat('topic ', label), null)"))
    return B.with_phrases(d, "labels", "gold_label", phrases(TOPICS), "key").selectExpr("key", "split", CAND, "gold")


Q3 = ("pick the best", "choose one", "which is right")


@query("mk_choice5", f"""
SELECT p_partkey::VARCHAR AS key, {split_sql('choice', 'p_partkey')}, array_to_string(c, '|') AS candidates, (p_size % 6)::INTEGER AS gold, {pick_sql(Q3, "'q'", 'p_partkey')} AS question
FROM (SELECT *, [p_name, p_type, p_brand, 'size ' || p_size, CASE WHEN p_size % 7 = 0 THEN p_type ELSE 'no ' || p_partkey END] AS c FROM part) WHERE len(list_distinct(c)) = 5 AND p_size % 6 < 5""")
def mk_choice5(spark, sf):
    d = table(spark, sf, "part").selectExpr(
        "p_partkey", split_text("choice", "p_partkey"), "p_name as choice0", "concat(' ', p_type) as choice1", "concat(p_brand, ' ') as choice2", "concat('size ', p_size) as choice3",
        "if(p_size % 7 = 0, p_type, concat('no ', p_partkey)) as choice4", "p_name as question_text", "p_size % 6 as label")
    return B.choice5(d, "p_partkey", Q3).selectExpr("key", "split", CAND, "gold", "question")


RELATIONS = ("entailment", "contradiction", "neutral")
QREL = ("does it follow: {h}", "relation to {h}?")
cte("rel_base", f"""
SELECT doc_id AS k, {split_sql('rel', 'doc_id')}, label AS gold_label, hyp, CASE WHEN {X.unif_sql("'coin'", 'doc_id')} < 0.5 THEN list_concat([label], others)
  ELSE [label, others[{int_sql("'other'", 'doc_id')} % 2 + 1]] END AS labels
FROM (SELECT *, list_filter({list(RELATIONS)!r}, lambda x: x <> label) AS others FROM (
  SELECT d.doc_id, d.source || ' ' || d.lang AS hyp, CASE WHEN toxic = 1 THEN 'contradiction' WHEN quality = 1 THEN 'entailment' ELSE 'neutral' END AS label FROM documents d JOIN labels USING (doc_id)))""")


@query("mk_relation", with_("rel_base") + f"SELECT key::VARCHAR AS key, * EXCLUDE (key, hyp), replace({pick_sql(QREL, repr('q'), 'key')}, '{{h}}', hyp) AS question FROM ({shown_sql('rel_base', 'k', 'hyp,')})")
def mk_relation(spark, sf):
    l = table(spark, sf, "labels").selectExpr("doc_id", "case when toxic = 1 then 'contradiction' when quality = 1 then 'entailment' else 'neutral' end as label")
    d = table(spark, sf, "documents").join(l, "doc_id").selectExpr("doc_id", split_text("rel", "doc_id"), "text as premise", "concat(source, ' ', lang) as hypothesis", "label")
    return B.relation(d, "doc_id", phrases(RELATIONS), QREL).selectExpr("key", "split", CAND, "gold", "question")


cte("hard", f"""
SELECT s_suppkey AS key, k, gold_name, list_concat([gold_name], near, far[1:k - 1 - len(near)]) AS labels FROM (
 SELECT s.*, near0[1:1 + {int_sql("'n'", 's.s_suppkey')} % (k - 1)] AS near FROM (
  SELECT s_suppkey, g.n_name AS gold_name, CASE WHEN {X.unif_sql("'k'", 's_suppkey')} < 0.35 THEN 3 WHEN {X.unif_sql("'k'", 's_suppkey')} < 0.7 THEN 4 ELSE 5 END AS k,
    coalesce(list(o.n_name ORDER BY {X.rank_sql("'same'", 's_suppkey', 'o.n_name')}) FILTER (o.n_regionkey = g.n_regionkey AND o.n_name <> g.n_name), []) AS near0,
    list(o.n_name ORDER BY {X.rank_sql("'rest'", 's_suppkey', 'o.n_name')}) FILTER (o.n_regionkey <> g.n_regionkey) AS far
  FROM supplier JOIN nation g ON s_nationkey = g.n_nationkey, nation o GROUP BY ALL) s)""")


@query("mk_hard_negatives", with_("hard") + "SELECT key, k::INTEGER AS k, gold_name, array_to_string(labels, '|') AS labels FROM hard")
def mk_hard_negatives(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("gold_name"), F.col("n_regionkey").alias("grp"))
    d = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), "s_nationkey").join(n, "s_nationkey")
    dim = n.select(F.col("gold_name").alias("name"), "grp")
    return B.hard_negatives(d, dim, "key").selectExpr("key", "k", "gold_name", "array_join(labels, '|') as labels")


W = "least(floor(abs(embedding[{0}]::DOUBLE) * 10), 3)"
EMO = list(B.EMOTIONS)
cte("votes", f"""
SELECT vec_id AS key, CASE WHEN vec_id % 2 = 0 THEN [{', '.join(W.format(i) for i in range(1, 9))}] ELSE [{', '.join(f"({W.format(i)} + {W.format(i + 8)} + {W.format(i + 16)}) / 3.0" for i in range(1, 9))}] END::DOUBLE[] AS v FROM embeddings""")
cte("emo", f"""
SELECT key, k, top, CASE WHEN top < 1 THEN 'none' WHEN len(tied) >= 2 THEN NULL ELSE r[1] END AS gold_label, list_concat(base, list_filter(r, lambda e: NOT list_contains(base, e))[1:greatest(k - len(base), 0)]) AS labels, v FROM (
 SELECT *, CASE WHEN len(b0) < k AND NOT list_contains(b0, 'none') AND top >= 1 AND {X.unif_sql("'none'", 'key')} < 0.3 THEN list_append(b0, 'none') ELSE b0 END AS base FROM (
 SELECT *, CASE WHEN top < 1 THEN ['none'] WHEN len(tied) >= 2 THEN tied[1:k] ELSE [r[1], (['sadness', 'joy', 'surprise', 'anticipation', 'fear', 'anger', 'trust', 'disgust'])[list_position({EMO!r}, r[1])]] END AS b0 FROM (
 SELECT *, CASE WHEN top - second < 0.34 THEN r[1:n_top] ELSE [] END AS tied FROM (
 SELECT key, any_value(v) AS v, CASE WHEN {X.unif_sql("'k'", 'key')} < 0.35 THEN 3 WHEN {X.unif_sql("'k'", 'key')} < 0.7 THEN 4 ELSE 5 END AS k,
   list(e ORDER BY x DESC, h) AS r, max(x) AS top, (list(x ORDER BY x DESC))[2] AS second, count(*) FILTER (x >= mx - 1e-9) AS n_top FROM (
  SELECT key, v, x, e, h, max(x) OVER (PARTITION BY key) AS mx FROM (SELECT key, v, v[i] AS x, ({EMO!r})[i] AS e, {X.rank_sql("'tie'", 'key', '(i - 1)')} AS h FROM (SELECT *, unnest(range(1, 9)) AS i FROM votes))) GROUP BY key))))""", "votes")


@query("mk_emotion", with_("emo") + """
SELECT key, k::INTEGER AS k, gold_label, array_to_string(labels, '|') AS labels, round(CASE WHEN list_sum(v) > 0 THEN v[1] / list_sum(v) ELSE 0.125 END, 4) AS soft_first FROM emo""")
def mk_emotion(spark, sf):
    w = lambda i: f"least(floor(abs(double(embedding[{i}])) * 10), 3)"
    writer = f"array({', '.join(w(i) for i in range(8))})"
    reader = f"array({', '.join(f'({w(i)} + {w(i + 8)} + {w(i + 16)}) / 3D' for i in range(8))})"
    d = table(spark, sf, "embeddings").selectExpr("vec_id as key", f"cast(if(vec_id % 2 = 0, cast({writer} as array<double>), {reader}) as array<double>) as votes")
    return B.emotion_labels(d, "key").selectExpr("key", "k", "gold_label", "array_join(labels, '|') as labels", "soft[0] as soft_first")


cte("pref", f"""
SELECT *, {CLIP.format('sc', 240, 0)} AS c, {CLIP.format('sr', 240, 0)} AS r FROM (
 SELECT conv_id, {SAN.format("arg_max(text, turn) FILTER (role = 'user')")} AS ctx, {SAN.format("arg_max(text, turn) FILTER (role = 'assistant')")} AS sc, {SAN.format("arg_min(text, turn) FILTER (role = 'assistant')")} AS sr FROM conversations GROUP BY conv_id)""")


@query("mk_pair_pref", with_("pref") + f"""
SELECT conv_id::VARCHAR AS key, {split_sql('pref', 'conv_id')}, sha1(CASE WHEN {X.unif_sql("'order'", 'conv_id')} < 0.5 THEN c || '|' || r ELSE r || '|' || c END) AS h, CASE WHEN {X.unif_sql("'order'", 'conv_id')} < 0.5 THEN 0 ELSE 1 END::INTEGER AS gold, sha1(ctx) AS hc
FROM pref WHERE c <> r AND c <> '' AND r <> '' AND ctx <> ''""")
def mk_pair_pref(spark, sf):
    at = lambda role: F.when(F.col("role") == role, F.col("turn"))
    # last question, last and first answer: three aggregates, no conversation is collected
    d = table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.max_by("text", at("user")).alias("request"), F.max_by("text", at("assistant")).alias("chosen"), F.min_by("text", at("assistant")).alias("rejected"))
    d = d.selectExpr("*", split_text("pref", "conv_id"))
    return B.pair_preference(d, "conv_id", Q3).selectExpr("key", "split", "sha1(array_join(candidates, '|')) as h", "gold", "sha1(context) as hc")


cte("mcq", f"""
SELECT *, CASE WHEN {X.unif_sql("'drop'", 'p_partkey')} < 0.3 THEN list_filter(ks, lambda x: x <> wrong) ELSE ks END AS kept FROM (
 SELECT *, (list_filter(ks, lambda x: x <> correct))[{int_sql("'which'", 'p_partkey')} % 3 + 1] AS wrong FROM (
 SELECT *, ['direct', 'tool_call', 'request_for_info', 'cannot_answer'] AS ks, (['direct', 'tool_call', 'request_for_info', 'cannot_answer', 'nothing'])[p_size % 5 + 1] AS correct FROM part)) WHERE correct <> 'nothing'""")
ANSWER_SQL = """CASE a WHEN 'direct' THEN p_name WHEN 'tool_call' THEN '<TOOLCALL>[{"name":"' || p_type || '"}]</TOOLCALL>' WHEN 'request_for_info' THEN p_brand || '?' ELSE CASE WHEN p_partkey % 13 = 0 THEN p_name ELSE 'cannot ' || p_type END END"""


def answer_rows(spark, sf):
    # narrow rows with much work each: millions of them are one row group, whatever the pieces of the file
    return even(table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")).selectExpr(
        "p_partkey", split_text("mcq", "p_partkey"), "get(array('direct', 'tool_call', 'request_for_info', 'cannot_answer', 'nothing'), p_size % 5) as correct", "p_name as direct",
        """concat('{"name":"', p_type, '"}') as tool_call""", "concat(p_brand, '?') as request_for_info", "if(p_partkey % 13 = 0, p_name, concat('cannot ', p_type)) as cannot_answer", "p_name as request")


@query("mk_mcq", with_("mcq") + f"""
SELECT p_partkey::VARCHAR AS key, {split_sql('mcq', 'p_partkey')}, string_agg(t, '|' ORDER BY h) AS candidates, (list_position(list(a ORDER BY h), any_value(correct)) - 1)::INTEGER AS gold FROM (
 SELECT *, {ANSWER_SQL} AS t, {X.rank_sql("'ord'", 'p_partkey', 'a')} AS h FROM (SELECT *, unnest(kept) AS a FROM mcq)) GROUP BY p_partkey HAVING count(DISTINCT t) = count(*)""")
def mk_mcq(spark, sf):
    return B.keyed_choice(answer_rows(spark, sf), "p_partkey", Q3).selectExpr("key", "split", CAND, "gold")


ROUTES = ("local", "large")
cte("route_base", f"""
SELECT doc_id AS k, {split_sql('route', 'doc_id')}, ['local', 'large'] AS labels, CASE WHEN quality * 3 + 1 + doc_id % 2 >= 4 THEN 'local' ELSE 'large' END AS gold_label, sha1({CLIP.format('s', 700, 200)}) AS hc
FROM (SELECT doc_id, quality, {SAN.format('text')} AS s FROM documents JOIN labels USING (doc_id)) WHERE length(s) >= 3""")


def route_rows(spark, sf):
    l = table(spark, sf, "labels").select("doc_id", "quality")
    return spread(table(spark, sf, "documents").select("doc_id", "text")).join(l, "doc_id").selectExpr("doc_id", split_text("route", "doc_id"), "text as prompt", "quality * 3 + 1 + doc_id % 2 as score")


@query("mk_route", with_("route_base") + f"SELECT key::VARCHAR AS key, * EXCLUDE (key) FROM ({shown_sql('route_base', 'k', 'hc,')})")
def mk_route(spark, sf):
    return B.route(route_rows(spark, sf), "doc_id", phrases(ROUTES), Q3).selectExpr("key", "split", "sha1(context) as hc", CAND, "gold")


@query("mk_sample_refill", f"""
SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY {X.rank_sql("'refill'", 'doc_id')}) AS rn FROM documents WHERE length({SAN.format('text')}) >= 300) WHERE rn <= 20""")
def mk_sample_refill(spark, sf):
    d = spread(table(spark, sf, "documents").select("source", "doc_id", "text")).selectExpr("source", "doc_id", f"{T.sanitize('text')} as context").filter("length(context) >= 300").select("source", "doc_id")
    return B.sample_refill(d, "doc_id", 20, "refill", ["source"])


@query("mk_stratified", f"""
SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY {X.rank_sql("'strat'", 'doc_id')}) AS rn FROM documents) WHERE rn <= CASE lang WHEN 'en' THEN 60 WHEN 'fr' THEN 30 END""")
def mk_stratified(spark, sf):
    cap = 90
    return B.stratified(table(spark, sf, "documents").select("lang", "doc_id"), "doc_id", "lang", {"en": cap * 2 // 3, "fr": cap - cap * 2 // 3}, "strat")


@query("mk_group_split", f"""
WITH s AS (SELECT l_suppkey, count(*) AS size, {X.rank_sql("'group'", 'l_suppkey')} AS h FROM lineitem GROUP BY l_suppkey),
 r AS (SELECT *, coalesce(sum(size) OVER (ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s),
 v AS (SELECT coalesce(sum(size), 0) AS v FROM r WHERE before < 2000)
SELECT split, count(*) AS n, count(DISTINCT l_suppkey) AS n_groups FROM lineitem JOIN (SELECT l_suppkey, CASE WHEN before < 2000 THEN 'val' WHEN before - v < 3000 THEN 'test' ELSE 'train' END AS split FROM r, v) USING (l_suppkey) GROUP BY split""")
def mk_group_split(spark, sf):
    d = B.group_split(table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey"), "l_suppkey", 2000, 3000)
    d = d.groupBy("split", "l_suppkey").agg(F.count(F.lit(1)).alias("c"))
    return d.groupBy("split").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_groups"))


@query("wn_running_split", f"""
WITH s AS (SELECT source, count(*) AS size, {X.rank_sql("'group'", 'source')} AS h FROM documents GROUP BY source),
 r AS (SELECT *, coalesce(sum(size) OVER (ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM s)
SELECT source, size, before, CASE WHEN before < 150 THEN 'val' WHEN before - (SELECT coalesce(sum(size), 0) FROM r WHERE before < 150) < 150 THEN 'test' ELSE 'train' END AS split FROM r""")
def wn_running_split(spark, sf):
    return B.group_table(table(spark, sf, "documents").select("source"), "source", 150, 150).select("source", "size", "before", "split")


def quotas(cap):
    large = int(round(cap * B.LARGE_SHARE))
    return cap - large, large


@query("mk_balanced_split", f"""
WITH d AS (SELECT doc_id, doc_id % 3 % 2 AS file, 1 - quality AS cls, text FROM documents JOIN labels USING (doc_id)),
 f AS (SELECT min((file, doc_id))[2] AS doc_id FROM d GROUP BY text),
 r AS (SELECT doc_id, file, cls, row_number() OVER (PARTITION BY file, cls ORDER BY {X.rank_sql("'balance'", 'file', 'doc_id')}) AS rn FROM d JOIN f USING (doc_id))
SELECT doc_id, cls, split FROM (SELECT doc_id, cls, CASE WHEN file = 0 THEN CASE WHEN rn <= CASE cls WHEN 0 THEN 44 ELSE 36 END THEN 'train' END
  WHEN rn <= CASE cls WHEN 0 THEN 16 ELSE 14 END THEN 'val' WHEN rn <= CASE cls WHEN 0 THEN 32 ELSE 28 END THEN 'test' END AS split FROM r) WHERE split IS NOT NULL""")
def mk_balanced_split(spark, sf):
    l = table(spark, sf, "labels").select("doc_id", (1 - F.col("quality")).alias("cls"))
    d = table(spark, sf, "documents").join(l, "doc_id").select("doc_id", (F.col("doc_id") % 3 % 2).alias("file"), "cls", "text")
    d = B.balanced_split(d, "doc_id", "text", "cls", "file", {0: [("train", *quotas(80))], 1: [("val", *quotas(30)), ("test", *quotas(30))]})
    return d.select("doc_id", "cls", "split")


IDS_SQL = f"""
, i AS (SELECT 'doc' AS source, doc_id AS key, {split_sql('ids', 'doc_id')}, text AS context FROM documents),
 d AS (SELECT min((source, key))[2] AS key FROM i WHERE context NOT IN (SELECT text FROM documents WHERE doc_id % 10 = 0) GROUP BY context),
 r AS (SELECT i.key, i.split, CASE i.split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END AS s FROM i JOIN d USING (key))
SELECT key, split, row_number() OVER (ORDER BY s, {X.rank_sql("'order'", 'split', "'doc'", 'key')}) + 999 AS item_id FROM r"""


def doc_items(spark, sf):
    return table(spark, sf, "documents").selectExpr("'doc' as source", "doc_id as key", split_text("ids", "doc_id"), "text as context", "'q' as question", "array('a', 'b') as candidates")


@query("mk_assign_ids", "WITH z AS (SELECT 1 AS one)" + IDS_SQL)
def mk_assign_ids(spark, sf):
    d = doc_items(spark, sf)
    return B.assign_ids(d, d.filter("key % 10 = 0"), 1000).select("key", "split", "item_id")


@query("mk_build_all", with_("rel_base", "route_base", "mcq") + f"""
SELECT 'relation' AS source, split, count(*) AS n FROM rel_base GROUP BY split UNION ALL SELECT 'route', split, count(*) FROM route_base GROUP BY split
UNION ALL SELECT 'mcq', split, count(*) FROM (SELECT p_partkey, {split_sql('mcq', 'p_partkey')} FROM (SELECT *, {ANSWER_SQL} AS t FROM (SELECT *, unnest(kept) AS a FROM mcq)) GROUP BY p_partkey HAVING count(DISTINCT t) = count(*)) GROUP BY split""")
def mk_build_all(spark, sf):
    l = table(spark, sf, "labels").selectExpr("doc_id", "case when toxic = 1 then 'contradiction' when quality = 1 then 'entailment' else 'neutral' end as label")
    rel = table(spark, sf, "documents").join(l, "doc_id").selectExpr("doc_id", split_text("rel", "doc_id"), "text as premise", "concat(source, ' ', lang) as hypothesis", "label")
    parts = [B.relation(rel, "doc_id", phrases(RELATIONS), QREL), B.route(route_rows(spark, sf), "doc_id", phrases(ROUTES), Q3), B.keyed_choice(answer_rows(spark, sf), "p_partkey", Q3)]
    return reduce(lambda a, b: a.unionByName(b), parts).groupBy("source", "split").agg(F.count(F.lit(1)).alias("n"))
