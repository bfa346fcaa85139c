"""Tokenisation, vocabulary and packing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from decant.functions import hashing as H
from decant.operators import tokens as K
from decant.operators.prefix import hash_bucket
from decant.plans import fixtures as X
from decant.plans.registry import cte, query, table, with_
from decant.plans.texts import PARAS
from decant.session import scratch, spread

r6 = lambda c, n: F.round(c, 6).alias(n)
# a cheap word hash both engines can compute
WORD = "(31 * if(w = '', 0, ascii(w)) + 17 * if(w = '', 0, ascii(right(w, 1))) + 7 * length(w)) % 8192"
WORD_SQL = "((31 * CASE WHEN w = '' THEN 0 ELSE unicode(w) END + 17 * CASE WHEN w = '' THEN 0 ELSE unicode(right(w, 1)) END + 7 * length(w)) % 8192)::BIGINT"
TOK = f"transform(split(text, ' '), w -> bigint({WORD}))"
TOK_SQL = f"list_transform(string_split(text, ' '), lambda w: {WORD_SQL})"
VAL = f"{H.uniform_text(repr('art'), 'doc_id')} < 0.1D"
ART_SPLIT = f"if({VAL}, 'val', 'train') as split"
ART_SPLIT_SQL = f"CASE WHEN {X.unif_sql(repr('art'), 'doc_id')} < 0.1 THEN 'val' ELSE 'train' END AS split"

cte("docs_tok", f"SELECT doc_id, source, lang, {ART_SPLIT_SQL}, {X.rank_sql(repr('pack'), 'doc_id')} AS h, {TOK_SQL} AS toks FROM documents")


def docs(spark, sf):
    return spread(table(spark, sf, "documents"))


def docs_tok(spark, sf):
    return docs(spark, sf).selectExpr("doc_id", "source", "lang", ART_SPLIT, f"{H.rank_text(repr('pack'), 'doc_id')} as h", f"{TOK} as toks")


QTOK = "transform(sequence(1, cast(1 + doc_id % 80 as int)), i -> bigint(5 + i))"


@query("tk_cut_token", with_("docs_tok") + """
SELECT doc_id, len(p)::INTEGER AS n, sha1(array_to_string(p, ',')) AS h FROM (SELECT doc_id, CASE WHEN len(q) + 1 >= 64 THEN list_append(q[1:63], 4) ELSE list_concat(q, [4], toks[greatest(len(toks) - (63 - len(q)), 0) + 1:len(toks)]) END AS p
FROM (SELECT *, list_transform(range(1, 2 + doc_id % 80), lambda i: 5 + i) AS q FROM docs_tok))""")
def tk_cut_token(spark, sf):
    d = docs_tok(spark, sf).selectExpr("doc_id", "toks", f"{QTOK} as q")
    return d.selectExpr("doc_id", f"{K.cut_prefix('q', 'toks', 64)} as p").selectExpr("doc_id", "size(p) as n", "sha1(array_join(p, ',')) as h")


@query("wn_paragraph_budget", with_("paras") + """
, p AS (SELECT doc_id, n, i, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM (SELECT doc_id, unnest(list_transform(ps, lambda x: len(string_split(x, ' ')))) AS n, generate_subscripts(ps, 1) AS i FROM paras WHERE len(ps) > 0)),
 s AS (SELECT doc_id, count(*) AS np, max(c) AS total, min(i) FILTER (c >= 60) AS s FROM p GROUP BY doc_id)
SELECT s.doc_id, CASE WHEN s IS NULL THEN total WHEN s = 1 OR c = 60 THEN 60 ELSE c - n END::INTEGER AS tokens, CASE WHEN s IS NULL THEN np WHEN s = 1 OR c = 60 THEN s ELSE s - 1 END::INTEGER AS used,
  CASE WHEN s IS NULL THEN false WHEN s = 1 THEN c > 60 OR np > 1 WHEN c = 60 THEN s < np ELSE true END AS truncated FROM s LEFT JOIN p ON p.doc_id = s.doc_id AND p.i = s.s""")
def wn_paragraph_budget(spark, sf):
    d = docs(spark, sf).selectExpr("doc_id", f"transform({PARAS}, p -> size(split(p, ' '))) as n").filter("size(n) > 0")
    return d.selectExpr("doc_id", f"{K.paragraph_budget('n', 60)} as b").select("doc_id", "b.tokens", "b.used", "b.truncated")


PACKED_SQL = """
, o AS (SELECT split, h, doc_id, list_concat([2], toks, [3]) AS t, coalesce(sum(len(toks) + 2) OVER (PARTITION BY split ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM docs_tok),
 x AS (SELECT split, unnest(t) AS tok, off + generate_subscripts(t, 1) - 1 AS pos FROM o),
 packed AS (SELECT split, (pos // 128)::BIGINT AS row_no, list(tok ORDER BY pos) AS tokens FROM x GROUP BY split, 2 HAVING count(*) = 128)
"""


def packed(spark, sf):
    d = docs_tok(spark, sf).selectExpr("doc_id", "split", "h", f"concat(array({K.BOS}L), toks, array({K.EOS}L)) as toks")
    return K.pack(d, 128, ["h"], hash_bucket("h"), ["split"])


@query("wn_pack_offsets", with_("docs_tok") + PACKED_SQL + "SELECT split, row_no, sha1(array_to_string(tokens, ',')) AS h FROM packed")
def wn_pack_offsets(spark, sf):
    return packed(spark, sf).selectExpr("split", "row_no", "sha1(array_join(tokens, ',')) as h")


@query("sink_packed", with_("docs_tok") + PACKED_SQL + "SELECT split, count(*) AS n, true AS within_limit, min(row_no) AS first_row, max(row_no) AS last_row FROM packed GROUP BY split")
def sink_packed(spark, sf):
    from decant.sources.writers import write_rows_per_file

    path = scratch(spark, "packed")
    rows = packed(spark, sf).repartitionByRange("split", "row_no").sortWithinPartitions("split", "row_no")
    write_rows_per_file(rows, path, 500, ["split"])
    d = spark.read.parquet(path).select("split", "row_no", F.input_file_name().alias("f"))
    d = d.groupBy("split", "f").agg(F.count(F.lit(1)).alias("c"), F.min("row_no").alias("lo"), F.max("row_no").alias("hi"))
    return d.groupBy("split").agg(F.sum("c").alias("n"), (F.max("c") <= 500).alias("within_limit"), F.min("lo").alias("first_row"), F.max("hi").alias("last_row"))


@query("wn_stop_at_target", with_("docs_tok") + """
SELECT split, doc_id FROM (SELECT split, doc_id, coalesce(sum(len(toks) + 2) OVER (PARTITION BY split ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM docs_tok) WHERE before < CASE split WHEN 'train' THEN 40000 ELSE 10000 END""")
def wn_stop_at_target(spark, sf):
    d = table(spark, sf, "documents").selectExpr("doc_id", ART_SPLIT, f"{H.rank_text(repr('pack'), 'doc_id')} as h", "size(split(text, ' ')) + 2 as n")
    d = d.withColumn("target", F.expr("if(split = 'train', 40000, 10000)"))
    return K.stop_at_target(d, "n", F.col("target"), ["h"], hash_bucket("h"), ["split"]).select("split", "doc_id")


@query("ag_lm_stats", with_("paras") + f"""
, d AS (SELECT doc_id, {ART_SPLIT_SQL}, len(ps) AS np, list_sum(list_transform(ps, lambda p: length(p))) AS chars, list_sum(list_transform(ps, lambda p: len(string_split(p, ' ')))) AS tokens FROM paras)
SELECT split, count(*) AS articles_read, count(*) FILTER (np = 0) AS dropped_empty, count(*) FILTER (np > 0 AND chars < 200) AS dropped_short, count(*) FILTER (chars >= 200) AS articles_used,
  count(*) FILTER (chars >= 200 AND tokens > 400) AS over_budget, (sum(np) FILTER (chars >= 200))::BIGINT AS paragraphs, (sum(chars) FILTER (chars >= 200))::BIGINT AS chars, round(sum(tokens) FILTER (chars >= 200) / sum(chars) FILTER (chars >= 200), 6) AS tokens_per_char FROM d GROUP BY split""")
def ag_lm_stats(spark, sf):
    d = docs(spark, sf).selectExpr("doc_id", ART_SPLIT, f"{PARAS} as ps")
    d = d.selectExpr("split", "size(ps) as np", "aggregate(ps, 0L, (a, p) -> a + length(p)) as chars", "aggregate(ps, 0L, (a, p) -> a + size(split(p, ' '))) as tokens")
    d = d.withColumn("used", F.col("chars") >= 200)
    u = lambda c: F.sum(F.when(F.col("used"), F.col(c)))
    return d.groupBy("split").agg(
        F.count(F.lit(1)).alias("articles_read"), F.count_if(F.col("np") == 0).alias("dropped_empty"), F.count_if((F.col("np") > 0) & ~F.col("used")).alias("dropped_short"),
        F.count_if("used").alias("articles_used"), F.count_if(F.col("used") & (F.col("tokens") > 400)).alias("over_budget"), u("np").alias("paragraphs"), u("chars").alias("chars"), r6(u("tokens") / u("chars"), "tokens_per_char"))


cte("shard", """
SELECT doc_id, source, 2 + doc_id % 4 AS k, doc_id % 7 <> 0 AS has_gold, 1 + doc_id % 80 + 1 + c > 256 AS cut, least(256, 1 + doc_id % 80 + 1 + c) AS prefix_len, doc_id % 80 > 70 AS cand_cut,
  strlen(text) - length(text) AS n_bytes, length(text) AS n_tokens FROM (SELECT *, len(string_split(text, ' ')) AS c FROM documents)""")


def shard(spark, sf):
    d = table(spark, sf, "documents").selectExpr("*", "size(split(text, ' ')) as c")
    return d.selectExpr("doc_id", "source", "2 + doc_id % 4 as k", "doc_id % 7 <> 0 as has_gold", "2 + doc_id % 80 + c > 256 as cut", "least(256, 2 + doc_id % 80 + c) as prefix_len", "doc_id % 80 > 70 as cand_cut",
                        "octet_length(text) - length(text) as n_bytes", "length(text) as n_tokens")


@query("ag_shard_stats", with_("shard") + """
SELECT coalesce(source, 'all') AS source, count(*) AS n, round(avg(cut::INT), 6) AS prefix_truncated_frac, round(avg(cand_cut::INT), 6) AS cand_truncated_frac, round(avg(prefix_len), 6) AS mean_prefix_len, round(avg(has_gold::INT), 6) AS gold_frac,
  round(sum(n_bytes) / sum(n_tokens), 6) AS byte_frac, count(*) FILTER (k = 2) AS k2, count(*) FILTER (k = 3) AS k3, count(*) FILTER (k = 4) AS k4, count(*) FILTER (k = 5) AS k5 FROM shard GROUP BY ROLLUP (source)""")
def ag_shard_stats(spark, sf):
    return K.shard_stats(shard(spark, sf), 256, 5)


@query("sink_shard", with_("docs_tok") + "SELECT split, count(*) AS n, sum(len(toks))::BIGINT AS tokens FROM docs_tok GROUP BY split")
def sink_shard(spark, sf):
    path = scratch(spark, "shard")
    docs_tok(spark, sf).select("doc_id", "split", "toks").write.partitionBy("split").parquet(path)
    return spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("toks")).alias("tokens"))


# ---- learned vocabulary --------------------------------------------------------------------

VOCAB = 2048
cte("words", r"SELECT '▁' || w AS w, count(*) AS c FROM (SELECT unnest(regexp_split_to_array(text, '\s+')) AS w FROM documents) WHERE w <> '' GROUP BY w")
cte("chars", "SELECT ch, sum(c) AS n FROM (SELECT unnest(string_split(w, '')) AS ch, c FROM words) WHERE ch <> '' GROUP BY ch", "words")
cte("covered", "SELECT ch, n FROM (SELECT *, coalesce(sum(n) OVER (ORDER BY n DESC, ch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER () AS total FROM chars) WHERE before < total * 0.9995", "chars")
cte("pieces_ok", """
SELECT piece, score FROM (SELECT substr(w, i, l) AS piece, sum(c) * l AS score FROM (SELECT w, c, unnest(range(1, length(w) + 1)) AS i FROM words), (SELECT unnest(range(2, 7)) AS l) WHERE i + l - 1 <= length(w) GROUP BY 1, l) p
WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT ch FROM chars WHERE ch NOT IN (SELECT ch FROM covered)) u WHERE contains(p.piece, u.ch))""", "words", "covered")


@query("ud_vocab", with_("pieces_ok") + f"""
, v AS (SELECT ch AS piece, n AS score, 0 AS kind FROM covered UNION ALL SELECT piece, score, 1 FROM pieces_ok)
SELECT piece, score::BIGINT AS score, id::INTEGER AS id FROM (SELECT *, row_number() OVER (ORDER BY kind, score DESC, piece) + {K.PIECES_FROM - 1} AS id FROM v) WHERE id < {VOCAB}""")
def ud_vocab(spark, sf):
    return K.learn_vocab(docs(spark, sf), VOCAB, "text")


def encoded(spark, sf, rows):
    enc = K.encoder(rows, K.learn_vocab(docs(spark, sf), VOCAB, "text"))
    return rows.withColumn("ids", enc("text"))


@query("ud_encode")
def ud_encode(spark, sf):
    d = encoded(spark, sf, docs(spark, sf).select("doc_id", "lang", "text"))
    nb = f"size(filter(ids, i -> i >= {K.BYTES_FROM} and i < {K.PIECES_FROM}))"
    return d.selectExpr("doc_id", "lang", "size(ids) as n_tokens", f"{nb} as n_bytes", "sha1(array_join(ids, ',')) as h")


@query("ud_prefix")
def ud_prefix(spark, sf):
    d = encoded(spark, sf, docs(spark, sf).select("doc_id", "text"))
    d = d.selectExpr("doc_id", "ids", "transform(sequence(1, cast(1 + doc_id % 80 as int)), i -> 300 + i) as q")
    return d.selectExpr("doc_id", f"{K.cut_prefix('q', 'ids', 128)} as p").selectExpr("doc_id", "size(p) as n", "sha1(array_join(p, ',')) as h")
