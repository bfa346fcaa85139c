"""Text functions, small scalar functions, and samplers keyed by hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from decant.functions import dist as D
from decant.functions import hashing as H
from decant.functions import text as T
from decant.operators.prefix import hash_bucket, prefix
from decant.plans import fixtures as X
from decant.plans.registry import crc32_sql, cte, query, table, with_
from decant.session import attach, spread
from decant.sources import readers as R

DOCS = "documents"


def docs(spark, sf):
    return spread(table(spark, sf, DOCS))


STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
SAN = STRIP.format(r"regexp_replace(replace(replace(replace(replace({0}, '<|', '< |'), '|>', '| >'), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \t　]+', ' ', 'g')")


@query("fn_sanitize", f"SELECT doc_id, sha1({SAN.format('text')}) AS h, length({SAN.format('text')}) AS n FROM documents")
def fn_sanitize(spark, sf):
    d = docs(spark, sf).selectExpr("doc_id", f"{T.sanitize('text')} as x")
    return d.selectExpr("doc_id", "sha1(x) as h", "bigint(length(x)) as n")


CLIP = "CASE WHEN length({0}) <= {1} THEN {0} ELSE left({0}, {1} - {2} - 1) || '…' || right({0}, {2}) END"


@query("fn_clip", f"SELECT doc_id, {CLIP.format('text', 240, 0)} AS head, {CLIP.format('text', 700, 200)} AS both FROM documents")
def fn_clip(spark, sf):
    return docs(spark, sf).selectExpr("doc_id", f"{T.clip('text', 240)} as head", f"{T.clip('text', 700, 200)} as both")


LANG_RULES = (("[\\\\u3040-\\\\u30ff]", "ja"), ("[äöüß]", "de"), ("[éèêçà]", "fr"))


@query("fn_lang", """
SELECT doc_id, CASE WHEN regexp_matches(text, '[぀-ヿ]') THEN 'ja' WHEN regexp_matches(text, '[äöüß]') THEN 'de'
  WHEN regexp_matches(text, '[éèêçà]') THEN 'fr' ELSE 'en' END AS guess FROM documents""")
def fn_lang(spark, sf):
    return docs(spark, sf).selectExpr("doc_id", f"{T.language('text', LANG_RULES)} as guess")


cte("paras", r"""
SELECT doc_id, source, list_filter(list_transform(string_split(replace(text, chr(13), chr(10)), chr(10)),
   lambda l: regexp_replace(regexp_replace(regexp_replace(l, '[（(][\s、,，・;；:：]*[）)]', '', 'g'), '[ \t　]+', ' ', 'g'), '^\s+|\s+$', '', 'g')),
   lambda s: s <> '' AND (contains(s, '.') OR length(s) >= 40) AND length(regexp_replace(s, '[^A-Za-z]', '', 'g')) >= 0.3 * length(s)) AS ps
FROM documents""")
PARAS = T.paragraphs("text", ".", "[A-Za-z]")


@query("fn_clean_paragraphs", with_("paras") + "SELECT doc_id, len(ps)::BIGINT AS n, sha1(array_to_string(ps, chr(10))) AS h FROM paras")
def fn_clean_paragraphs(spark, sf):
    d = docs(spark, sf).selectExpr("doc_id", f"{PARAS} as ps")
    return d.selectExpr("doc_id", "bigint(size(ps)) as n", r"sha1(array_join(ps, '\n')) as h")


@query("fn_cut_at_newline", """
SELECT doc_id, sha1(CASE WHEN length(text) <= 1000 THEN text WHEN p > 0 AND p < 1000 THEN left(text, p) ELSE left(text, 1000) END) AS h
FROM (SELECT *, 1000 - instr(reverse(left(text, 1000)), chr(10)) AS p FROM documents)""")
def fn_cut_at_newline(spark, sf):
    return docs(spark, sf).selectExpr("doc_id", f"sha1({T.cut_at_newline('text', 1000)}) as h")


SENT = r"""list_filter(list_transform(string_split(regexp_replace({0}, '([。.!?！？\n])\s*', '\1' || chr(1), 'g'), chr(1)),
  lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"""


@query("fn_sentences", f"SELECT doc_id, len({SENT.format('text')})::BIGINT AS n, sha1(array_to_string({SENT.format('text')}, '|')) AS h FROM documents")
def fn_sentences(spark, sf):
    d = docs(spark, sf).selectExpr("doc_id", f"{T.sentences('text')} as s")
    return d.selectExpr("doc_id", "bigint(size(s)) as n", "sha1(array_join(s, '|')) as h")


# tools described from the part table; every eleventh description is damaged
TOOL_JSON = """if(p_partkey % 11 = 0, concat('{broken ', p_name), to_json(named_struct('name', replace(p_name, ' ', '_'), 'description', concat(repeat(concat(p_type, '  '), 1 + p_size % 30), p_brand),
 'parameters', named_struct('properties', named_struct('a', 1, 'b', 2, 'c', 3, 'd', 4, 'e', 5, 'f', 6, 'g', 7), 'required', array('a', 'c')))))"""
TOOL_SQL = """CASE WHEN p_partkey % 11 = 0 THEN '- {broken ' || p_name ELSE '- ' || replace(p_name, ' ', '_') || '(a*, b, c*, d, e, f…): ' ||
 CASE WHEN length(d) <= 110 THEN d ELSE left(d, 109) || '…' END END"""
cte("tools", f"SELECT *, {TOOL_SQL} AS line FROM (SELECT *, repeat(p_type || ' ', 1 + p_size % 30) || p_brand AS d FROM part)")


@query("fn_tool_line", with_("tools") + "SELECT p_partkey, line FROM tools")
def fn_tool_line(spark, sf):
    return table(spark, sf, "part").selectExpr("p_partkey", f"{TOOL_JSON} as tool").selectExpr("p_partkey", f"{T.tool_line('tool')} as line")


CTX_SQL = SAN.format("'Available tools:' || chr(10) || CASE WHEN length(b) <= 550 THEN b ELSE left(b, 549) || '…' END || chr(10) || 'User request: ' || r")


@query("fn_tool_context", with_("tools") + f"""
SELECT p_partkey, sha1({CTX_SQL}) AS h FROM (SELECT p_partkey, line || chr(10) || line || chr(10) || line AS b, p_name || ' of ' || p_brand AS r FROM tools)""")
def fn_tool_context(spark, sf):
    d = table(spark, sf, "part").selectExpr("p_partkey", f"array_repeat({TOOL_JSON}, 3) as tools", r"concat(p_name, '  of\n', p_brand) as req")
    return d.selectExpr("p_partkey", f"sha1({T.tool_context('tools', 'req')}) as h")


@query("fn_toolcall_norm", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN '<TOOLCALL>[' || props || ']</TOOLCALL>' WHEN 1 THEN '<TOOLCALL>[' || props || ']</TOOLCALL>'
  WHEN 2 THEN '<TOOLCALL>[' || props || ']</TOOLCALL>' ELSE '<TOOLCALL>[call ' || event_type || ']</TOOLCALL>' END AS call FROM events""")
def fn_toolcall_norm(spark, sf):
    raw = """case event_id % 4 when 0 then props when 1 then concat(' [', props, '] ') when 2 then concat('<TOOLCALL>[', props, ']</TOOLCALL>') else concat('call ', event_type) end"""
    return table(spark, sf, "events").selectExpr("event_id", f"{raw} as raw").selectExpr("event_id", f"{T.toolcall('raw')} as call")


@query("fn_response_type", r"""
SELECT conv_id, turn, CASE WHEN starts_with(ltrim(text), '<TOOLCALL>') THEN 'tool_call' WHEN regexp_matches(left(text, 240), '(?i)unable|cannot|can''t|can not|apolog|sorry|not able|don''t have')
  THEN 'cannot_answer' WHEN contains(text, '?') THEN 'request_for_info' ELSE 'direct' END AS kind FROM conversations""")
def fn_response_type(spark, sf):
    return table(spark, sf, "conversations").selectExpr("conv_id", "turn", f"{T.response_type('text')} as kind")


@query("fn_prefix_key", "SELECT p_partkey, split_part(replace(p_name, ' ', '_'), '_', 1) AS grp FROM part")
def fn_prefix_key(spark, sf):
    return table(spark, sf, "part").selectExpr("p_partkey", "substring_index(replace(p_name, ' ', '_'), '_', 1) as grp")


@query("fn_hash_bucket", f"""
SELECT doc_id, {crc32_sql('key')} % 100 < 2 AS held_out, (CASE WHEN doc_id % 10 = 0 THEN {crc32_sql('key')} ELSE doc_id END) % 4 = 1 AS picked
FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'd' ELSE '' END || doc_id AS key FROM documents)""")
def fn_hash_bucket(spark, sf):
    d = docs(spark, sf)
    key = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("d"), F.col("doc_id").cast("string"))).otherwise(F.col("doc_id").cast("string"))
    return d.select("doc_id", (F.crc32(key) % 100 < 2).alias("held_out"), (H.numeric_or_crc(key) % 4 == 1).alias("picked"))


@query("fn_hash_bucket_sha1", "SELECT doc_id, ('0x' || substr(sha1(doc_id::VARCHAR), 1, 8))::BIGINT % 100 < 2 AS held_out, doc_id % 4 = 1 AS picked FROM documents")
def fn_hash_bucket_sha1(spark, sf):
    return docs(spark, sf).select("doc_id", (H.hex_int(F.sha1(F.col("doc_id").cast("string"))) % 100 < 2).alias("held_out"), (F.col("doc_id") % 4 == 1).alias("picked"))


@query("fn_order_key", f"""
SELECT doc_id, key, row_number() OVER (ORDER BY key, doc_id) AS position FROM (SELECT doc_id, {crc32_sql('s')} AS key FROM (SELECT doc_id, '{H.SEED}:' || doc_id AS s FROM documents))""")
def fn_order_key(spark, sf):
    d = docs(spark, sf).select("doc_id", F.crc32(H.joined(H.SEED, F.col("doc_id"))).alias("key"))
    return prefix(d, ["key", "doc_id"], F.floor(F.col("key") / (1 << 20)), rank="position")


NUM = """case event_id % 5 when 0 then '' when 1 then 'NaN' when 2 then concat(value, 'x') when 3 then concat(' ', value) else get_json_object(props, '$.k') end"""


@query("fn_fnum", """
SELECT event_id, CASE event_id % 5 WHEN 3 THEN value WHEN 4 THEN (props->>'$.k')::DOUBLE END AS v FROM events""")
def fn_fnum(spark, sf):
    return table(spark, sf, "events").selectExpr("event_id", f"{NUM} as t").select("event_id", R.fnum("t").alias("v"))


@query("fn_hw_lookup", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'v' || (props->>'$.k') END AS driver, CASE WHEN event_id % 3 = 0 THEN 'x16 8 GT/s' END AS link FROM events""")
def fn_hw_lookup(spark, sf):
    doc = """concat('{"gpus":[{"lspci_name":"card 100","driver":{"version":"v0"}},{"lspci_name":"card ', if(event_id % 3 = 0, '6400', '2100'),
      '","driver":{"version":"v', get_json_object(props, '$.k'), '"},"link":{"current_width":16,"current_speed":"8 GT/s"}}]}')"""
    schema = "gpus array<struct<lspci_name string, driver struct<version string>, link struct<current_width int, current_speed string>>>".replace(" string", ": string").replace(" int", ": int")
    schema = "gpus array<struct<lspci_name: string, driver: struct<version: string>, link: struct<current_width: int, current_speed: string>>>"
    d = table(spark, sf, "events").selectExpr("event_id", f"from_json({doc}, '{schema}') as h")
    d = d.selectExpr("event_id", "get(filter(h.gpus, g -> contains(g.lspci_name, '6400')), 0) as g")
    return d.selectExpr("event_id", "g.driver.version as driver", "concat('x', g.link.current_width, ' ', g.link.current_speed) as link")


@query("fn_ratio", "SELECT l_orderkey, l_linenumber, round(sum(l_tax), 2) AS tax, round(sum(l_tax) / nullif(sum(l_discount), 0), 6) AS ratio FROM lineitem GROUP BY l_orderkey, l_linenumber")
def fn_ratio(spark, sf):
    d = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_tax").alias("t"), F.sum("l_discount").alias("d"))
    return d.select("l_orderkey", "l_linenumber", F.round("t", 2).alias("tax"), F.round(D.ratio(F.col("t"), F.col("d")), 6).alias("ratio"))


WRAPPERS = ("%s", "%s please", "I want: %s")
cte("grid", """SELECT replace(w, '%s', p_name) AS text, p_brand AS label, p_partkey % 2 AS tier, p_partkey AS phrase, i AS wrapper
 FROM part, (VALUES (0, '%s'), (1, '%s please'), (2, 'I want: %s')) v(i, w)""")


def phrase_grid(spark, sf):
    ws = ", ".join(f"'{w}'" for w in WRAPPERS)
    d = table(spark, sf, "part").selectExpr("p_name", "p_brand as label", "p_partkey % 2 as tier", "p_partkey as phrase", f"posexplode(array({ws})) as (wrapper, w)")
    return d.selectExpr("replace(w, '%s', p_name) as text", "label", "tier", "phrase", "wrapper")


@query("fn_phrase_grid", with_("grid") + "SELECT text, count(*) AS n, count(DISTINCT label) AS n_labels, count(DISTINCT label) > 1 AS ambiguous FROM grid GROUP BY text")
def fn_phrase_grid(spark, sf):
    d = phrase_grid(spark, sf).groupBy("text", "label").agg(F.count(F.lit(1)).alias("c"))
    return d.groupBy("text").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_labels")).withColumn("ambiguous", F.col("n_labels") > 1)


@query("jn_table_verify", with_("grid") + """
, g AS (SELECT text, count(DISTINCT label) AS n_labels, any_value(label) AS label, min(tier) AS lo, max(tier) AS hi FROM grid GROUP BY text)
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN g.text IS NULL THEN 'string not in table' WHEN n_labels > 1 THEN 'ambiguous'
  WHEN o.tier NOT BETWEEN lo AND hi THEN 'tier mismatch' WHEN g.label <> o.label THEN 'gold mismatch' ELSE 'ok' END AS reason
 FROM (SELECT CASE WHEN l_partkey % 9 = 0 THEN 'nothing ' || p_name ELSE p_name || ' please' END AS text, l_linenumber % 2 AS tier,
       CASE WHEN l_suppkey % 8 = 0 THEN 'Brand#0' ELSE p_brand END AS label FROM lineitem JOIN part ON l_partkey = p_partkey) o LEFT JOIN g USING (text)) GROUP BY reason""")
def jn_table_verify(spark, sf):
    from decant.operators.embed import verify_strings

    li = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber")
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand")
    o = li.join(p, "l_partkey").selectExpr(
        "if(l_partkey % 9 = 0, concat('nothing ', p_name), concat(p_name, ' please')) as text", "l_linenumber % 2 as tier", "if(l_suppkey % 8 = 0, 'Brand#0', p_brand) as label")
    return verify_strings(o, phrase_grid(spark, sf)).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


# ---- items made of conversation text -------------------------------------------------------

ASK = "which reply fits?"
cte("replies", f"""
SELECT u.conv_id * 1000 + u.turn AS item_id, u.conv_id, u.text AS context, a.text AS reply, {X.rank_sql("'reply'", 'a.conv_id', 'a.turn')} AS h
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'""")
cte("reply_rank", "SELECT *, row_number() OVER (ORDER BY h, item_id) - 1 AS r, count(*) OVER () AS total FROM replies", "replies")
cte("txt_long", f"""
SELECT i.item_id, i.conv_id, i.context, c.j, c.text, {X.rank_sql("'show'", 'i.item_id', 'c.j')} AS hs FROM reply_rank i JOIN (
  SELECT item_id, 0 AS j, reply AS text FROM reply_rank UNION ALL
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY d) AS j, text FROM (
    SELECT i.item_id, d.d, o.reply AS text, o.conv_id AS oc, i.conv_id FROM reply_rank i, (SELECT unnest(range(1, 7)) AS d) d
    JOIN reply_rank o ON o.r = (i.r + d.d) % i.total) WHERE oc <> conv_id) c ON c.item_id = i.item_id WHERE c.j <= 3""", "reply_rank")
cte("txt_cand", "SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY hs) - 1 AS pos FROM txt_long", "txt_long")
cte("txt_split", f"SELECT item_id, CASE WHEN ({X.seed_sql('txt', 'conv_id')}) % 10 < 7 THEN 'train' ELSE 'test' END AS split FROM replies", "replies")


def txt_items(spark, sf):
    """Which reply fits: the real answer and three answers of other conversations, picked along a hash order."""
    c = table(spark, sf, "conversations")
    u = c.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("context"))
    a = c.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("reply"))
    d = u.join(a, ["conv_id", "turn"]).withColumns({"item_id": F.col("conv_id") * 1000 + F.col("turn") - 1, "h": H.rank_key("reply", F.col("conv_id"), F.col("turn"))})
    d = prefix(d, ["h", "item_id"], hash_bucket("h"), rank="r").withColumn("r", F.col("r") - 1)
    d = attach(d, d.agg(F.count(F.lit(1)).alias("total")))
    want = d.selectExpr("item_id", "conv_id", "explode(sequence(1, 6)) as d", "r", "total").selectExpr("item_id", "conv_id", "d", "(r + d) % total as r")
    other = want.join(d.selectExpr("r", "conv_id as oc", "reply as text"), "r").filter("oc <> conv_id")
    # at most six rows per item reach this group
    other = other.groupBy("item_id").agg(F.expr("slice(transform(array_sort(collect_list(struct(d, text))), x -> x.text), 1, 3)").alias("wrong"))
    d = d.join(other, "item_id", "left").selectExpr("item_id", "conv_id", "context", "concat(array(reply), coalesce(wrong, cast(array() as array<string>))) as texts")
    order = f"array_sort(transform(texts, (t, j) -> struct({H.rank_text(repr('show'), 'item_id', 'j')} as h, j as j, t as t)))"
    d = d.withColumn("o", F.expr(order))
    return d.select(
        "item_id", F.when(H.stable_seed("txt", F.col("conv_id")) % 10 < 7, "train").otherwise("test").alias("split"),
        F.lit("chat").alias("source"), "context", F.lit(ASK).alias("question"), F.expr("transform(o, x -> x.t)").alias("candidates"),
        F.expr("cast(array_position(transform(o, x -> x.j), 0) - 1 as int)").alias("gold"))


@query("txt_items", with_("txt_cand", "txt_split") + """
SELECT c.item_id, any_value(s.split) AS split, count(*)::INTEGER AS k, sha1(string_agg(c.text, '|' ORDER BY pos)) AS h, max(CASE WHEN j = 0 THEN pos END)::INTEGER AS gold
FROM txt_cand c JOIN txt_split s USING (item_id) GROUP BY c.item_id""")
def txt_items_query(spark, sf):
    return txt_items(spark, sf).selectExpr("item_id", "split", "size(candidates) as k", "sha1(array_join(candidates, '|')) as h", "gold")


@query("fm_corpus_lines", with_("txt_cand", "txt_split") + f"""
, l AS (SELECT DISTINCT item_id, 'which reply fits?' AS line, -1 AS o FROM txt_cand UNION ALL SELECT item_id, text, 1000000 + pos FROM txt_cand
  UNION ALL SELECT item_id, unnest(s), generate_subscripts(s, 1) FROM (SELECT item_id, {SENT.format('any_value(context)')} AS s FROM txt_cand GROUP BY item_id))
SELECT item_id, count(*) AS n, sha1(string_agg(line, chr(10) ORDER BY o)) AS h FROM l JOIN txt_split USING (item_id) WHERE split = 'train' GROUP BY item_id""")
def fm_corpus_lines(spark, sf):
    from decant.operators.tokens import corpus_lines

    d = corpus_lines(txt_items(spark, sf).filter("split = 'train'"), ["item_id"])
    return d.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.expr(r"sha1(array_join(transform(array_sort(collect_list(struct(pos, line))), x -> x.line), '\n'))").alias("h"))


# ---- samplers ------------------------------------------------------------------------------

@query("wn_cap_per_source", with_("item_attr") + f"""
SELECT item_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {X.rank_sql('source', 'item_id')}) AS rn FROM item_attr WHERE split = 'train')
WHERE rn <= CASE source WHEN 'synth' THEN 30 WHEN 'a' THEN 20 ELSE 1000000000 END UNION ALL SELECT item_id, source FROM item_attr WHERE split <> 'train'""")
def wn_cap_per_source(spark, sf):
    from decant.operators.sampling import cap_per_source

    d = X.dec_items(spark, sf).select("item_id", "source", "split")
    return cap_per_source(d, {"synth": 30, "a": 20}, "item_id", only="split = 'train'").select("item_id", "source")


@query("wn_corpus_sample", f"""
SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {X.rank_sql('source', 'doc_id')}) AS rn FROM documents) WHERE rn <= 25""")
def wn_corpus_sample(spark, sf):
    from decant.operators.sampling import equal_cap

    return equal_cap(table(spark, sf, DOCS).select("doc_id", "source"), 25, "doc_id").select("doc_id", "source")


@query("wn_first_seen", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY sha1(text)")
def wn_first_seen(spark, sf):
    return docs(spark, sf).groupBy(F.sha1("text").alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).drop("h")


@query("wn_epoch_order", f"""
WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY {X.rank_sql("'dense'", 'doc_id')}, doc_id) - 1 AS dense, count(*) OVER () AS n FROM documents),
 p AS (SELECT doc_id, e AS epoch, {H.permuted_sql('dense', 'n', f"('{H.SEED}:' || e)")} AS position FROM d, (SELECT unnest(range(0, 2))::INTEGER AS e))
SELECT doc_id, epoch, position, position // 32 AS step FROM p""")
def wn_epoch_order(spark, sf):
    from decant.operators.sampling import dense_ids, epoch_position

    d = dense_ids(table(spark, sf, DOCS).select("doc_id"), "doc_id").selectExpr("*", "explode(sequence(0, 1)) as epoch")
    d = d.withColumn("position", epoch_position("dense", "n", "epoch"))
    return d.select("doc_id", "epoch", "position", F.floor(F.col("position") / 32).cast("bigint").alias("step"))


@query("wn_lr_schedule", """
SELECT o_orderkey AS step, round(CASE WHEN o_orderkey < 100 THEN 0.001 * (o_orderkey + 1) / 100.0
  ELSE 0.0001 + 0.5 * (0.001 - 0.0001) * (1 + cos(pi() * least(1.0, (o_orderkey - 100) / 9900.0))) END, 9) AS lr FROM orders""")
def wn_lr_schedule(spark, sf):
    from decant.operators.sampling import learning_rate

    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("step"), F.round(learning_rate(F.col("o_orderkey"), 1e-3, 1e-4, 100, 10000), 9).alias("lr"))


BATCH_QUOTA = {"a": 3, "b": 3, "c": 2}


@query("wn_strat_batches", with_("item_attr") + f"""
, d AS (SELECT item_id, source, row_number() OVER (PARTITION BY source ORDER BY {X.rank_sql("'dense'", 'item_id')}, item_id) - 1 AS dense, count(*) OVER (PARTITION BY source) AS n FROM item_attr WHERE source <> 'synth'),
 q AS (SELECT DISTINCT source, n, v.q FROM d JOIN (VALUES ('a', 3), ('b', 3), ('c', 2)) v(source, q) USING (source)),
 t AS (SELECT unnest(range(0, (SELECT max(ceil(n / q))::BIGINT FROM q))) AS step),
 p AS (SELECT step, source, j, n, step * q + j AS at_ FROM q, t, (SELECT unnest(range(0, 3)) AS j) WHERE j < q),
 k AS (SELECT step, source, j, {H.permuted_sql('at_ % n', 'n', f"('{H.SEED}:' || source || ':' || (at_ // n))")} AS dense FROM p)
SELECT step, source, j::INTEGER AS j, item_id FROM k JOIN d USING (source, dense)""")
def wn_strat_batches(spark, sf):
    """Every step until each source has been walked through once."""
    from decant.operators.config import largest_remainder
    from decant.operators.sampling import stratified_batches

    pool = X.dec_items(spark, sf).filter("source <> 'synth'").select("item_id", "source")
    quota = largest_remainder(8, {"a": 1.0, "b": 1.0, "c": 1.0})
    assert quota == BATCH_QUOTA
    return stratified_batches(pool, "item_id", quota).select("step", "source", "j", "item_id")
