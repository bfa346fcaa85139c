"""String dictionary, embedding diagnostics, losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from decant.functions import dist as D
from decant.functions import hashing as H
from decant.operators import embed as E
from decant.operators.prefix import hash_bucket, prefix
from decant.plans import fixtures as X
from decant.plans.registry import cte, query, table, with_
from decant.plans.texts import txt_items
from decant.session import attach, materialise

r6 = lambda c, n: F.round(c, 6).alias(n)

# ---- strings and slots ---------------------------------------------------------------------

cte("slot", """SELECT c.item_id, c.pos, s.split, c.text, sha1(c.text) AS h FROM txt_cand c JOIN txt_split s USING (item_id)""", "txt_cand", "txt_split")
cte("dict", """
SELECT h, text, item_id, pos, row_number() OVER (ORDER BY item_id, pos) - 1 AS uid, len(string_split(text, ' '))::INTEGER AS n_tokens
FROM (SELECT h, any_value(text) AS text, min((item_id, pos))[1] AS item_id, min((item_id, pos))[2] AS pos FROM slot WHERE split = 'train' GROUP BY h)""", "slot")


def slots(spark, sf):
    """Written once: every check below reads the slots several times."""
    return materialise(E.slots(txt_items(spark, sf)), "slots")


def strings(slot):
    return E.dictionary(slot.filter("split = 'train'"))


@query("jn_dictionary", with_("dict") + "SELECT s.item_id, s.pos::INTEGER AS pos, d.uid FROM slot s JOIN dict d USING (h) WHERE s.split = 'train'")
def jn_dictionary(spark, sf):
    s = slots(spark, sf).filter("split = 'train'")
    return E.slot_ids(s, E.dictionary(s)).select("item_id", "pos", "uid")


@query("jn_leak_guard", with_("slot") + """
, emb AS (SELECT DISTINCT h FROM slot WHERE split = 'train' OR pos = 0)
SELECT 'slot of split ' || split AS problem, count(*) AS n FROM slot WHERE split <> 'train' GROUP BY split
UNION ALL SELECT 'string without a train slot', count(*) FROM emb WHERE h NOT IN (SELECT h FROM slot WHERE split = 'train') HAVING count(*) > 0""")
def jn_leak_guard(spark, sf):
    s = slots(spark, sf)
    return E.leaks(s, s.filter("split = 'train' or pos = 0").select("h").distinct())


@query("jn_pack_len", with_("dict") + "SELECT uid, n_tokens, length(text) AS n_chars FROM dict")
def jn_pack_len(spark, sf):
    d = strings(slots(spark, sf))
    return d.select("uid", F.size(F.split("text", " ")).alias("n_tokens"), F.length("text").cast("bigint").alias("n_chars"))


def lengths(d):
    return d.select("uid", F.size(F.split("text", " ")).alias("n_tokens"))


LC = 40


@query("jn_mask_slots", with_("dict") + f"""
SELECT 'chat' AS source, count(*) AS slots, count(*) FILTER (n_tokens > {LC}) AS masked, count(DISTINCT uid) AS strings, count(DISTINCT CASE WHEN n_tokens > {LC} THEN uid END) AS masked_strings
FROM slot s JOIN dict d USING (h) WHERE split = 'train'""")
def jn_mask_slots(spark, sf):
    s = slots(spark, sf).filter("split = 'train'")
    d = E.dictionary(s)
    m = E.mask_long(E.slot_ids(s, d), lengths(d), LC)
    # one row per (source, string) first: distinct counts then need no second expansion
    u = m.groupBy("source", "uid").agg(F.count(F.lit(1)).alias("c"), F.bool_or("long").alias("long"))
    return u.groupBy("source").agg(F.sum("c").alias("slots"), F.sum(F.when(F.col("long"), F.col("c")).otherwise(0)).alias("masked"),
                                   F.count(F.lit(1)).alias("strings"), F.count_if("long").alias("masked_strings"))


@query("jn_string_pool", with_("dict") + f"""
SELECT uid, item_id, pos::INTEGER AS pos, n_tokens FROM dict WHERE n_tokens <= {LC} AND n_tokens > 0""")
def jn_string_pool(spark, sf):
    s = slots(spark, sf).filter("split = 'train'")
    d = E.dictionary(s)
    m = E.mask_long(E.slot_ids(s, d), lengths(d), LC).drop("uid").withColumnRenamed("masked_uid", "uid")
    tok = d.select("uid", F.split("text", " ").alias("tokens"))
    return E.string_pool(m, tok).select("uid", "item_id", "pos", F.size("tokens").alias("n_tokens"))


@query("jn_slots_check", with_("slot") + """
SELECT item_id, pos::INTEGER AS pos, CASE WHEN item_id % 5 = 0 THEN 'missing' END AS problem FROM slot WHERE item_id % 5 = 0 AND pos = 1
UNION ALL SELECT DISTINCT item_id, 99, 'extra' FROM slot WHERE item_id % 4 = 0""")
def jn_slots_check(spark, sf):
    s = slots(spark, sf).select("item_id", "pos")
    extra = s.filter("item_id % 4 = 0").select("item_id", F.lit(99).alias("pos")).distinct()
    return E.slots_problems(s, s.filter("not (item_id % 5 = 0 and pos = 1)").unionByName(extra))


# ---- retrieval -----------------------------------------------------------------------------

def spaces(spark, sf):
    """Unit vectors of both spaces with their roles."""
    return X.emb_roles(spark, sf).selectExpr("uid as id", "intent", "lang", "unseen", "grp", f"{D.unit('vec')} as vec", f"{D.unit('svec')} as svec")


cte("u", """
SELECT uid AS id, intent, lang, unseen, grp, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) AS vec,
  list_transform(svec, lambda x: x / sqrt(list_dot_product(svec, svec))) AS svec FROM roles""", "roles")
cte("cross_us", """
SELECT a.id AS qid, b.id AS pid, a.intent AS qi, b.intent AS pi, a.lang AS ql, b.lang AS pl, a.grp AS qg, b.grp AS pg,
  list_dot_product(a.vec, b.vec) AS c FROM u a, u b WHERE a.unseen AND NOT b.unseen""", "u")


@query("tk_neighbors", with_("u") + """
SELECT qid, pid, rank, cos FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cos DESC, pid) AS rank FROM (
  SELECT a.id AS qid, b.id AS pid, round(list_dot_product(a.vec, b.vec), 6) AS cos FROM u a, u b WHERE a.unseen AND a.id <> b.id)) WHERE rank <= 10""")
def tk_neighbors(spark, sf):
    d = spaces(spark, sf)
    return E.nearest(d.filter("unseen"), d, 10).withColumn("rank", F.col("rank").cast("bigint"))


@query("ag_recall_at_k", with_("u") + """
, p AS (SELECT a.id AS q, b.id AS p, round(list_dot_product(a.vec, b.vec), 6) AS t, round(list_dot_product(a.svec, b.svec), 6) AS s FROM u a, u b WHERE a.unseen AND a.id <> b.id),
 r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY t DESC, p) AS rt, row_number() OVER (PARTITION BY q ORDER BY s DESC, p) AS rs FROM p)
SELECT k::INTEGER AS k, round(count(*) FILTER (rt <= k AND rs <= k) / ((SELECT count(*) FROM u WHERE unseen) * k), 6) AS recall, round(k / ((SELECT count(*) FROM u) - 1), 6) AS chance
FROM r, (SELECT unnest([1, 5, 10]) AS k) GROUP BY k""")
def ag_recall_at_k(spark, sf):
    d = spaces(spark, sf)
    return E.recall_at_k(d.filter("unseen"), d)


@query("jn_cross_cosine", with_("cross_us") + """
SELECT qid, round(avg(c), 6) AS mean_cos, round(avg(CASE WHEN ql = pl THEN c END), 6) AS mean_cos_samelang, round(max(c), 6) AS max_cos FROM cross_us GROUP BY qid""")
def jn_cross_cosine(spark, sf):
    d = spaces(spark, sf)
    q, seen = d.filter("unseen"), d.filter("not unseen")
    per_lang = E.group_sums(seen, ["lang"], "vec", X.DIMS)
    both = per_lang.agg(F.sum("n").alias("n_all"), E.vector_sum("s", X.DIMS).alias("s_all"))
    j = attach(q, both).join(per_lang, "lang", "left")
    m = j.select(F.col("id").alias("qid"), D.r6(f"{D.dot('vec', 's_all')} / n_all", "mean_cos"), D.r6(f"{D.dot('vec', 's')} / n", "mean_cos_samelang"))
    top = E.nearest(q, seen, 1).select("qid", F.col("cos").alias("max_cos"))
    return m.join(top, "qid")


@query("jn_sibling_exclude", with_("u") + """
, p AS (SELECT a.id AS qid, a.intent AS qi, b.id AS pid, b.intent AS pi, round(list_dot_product(a.vec, b.vec), 6) AS c FROM u a, u b
  WHERE NOT a.unseen AND NOT b.unseen AND a.intent || a.lang || a.grp <> b.intent || b.lang || b.grp),
 t AS (SELECT qid, qi, arg_min(pi, (-c, pid)) AS best, avg((qi = pi)::INT) AS chance FROM p GROUP BY qid, qi)
SELECT count(*) AS n, round(avg((qi = best)::INT), 6) AS intent_acc, round(avg(chance), 6) AS intent_chance FROM t""")
def jn_sibling_exclude(spark, sf):
    d = spaces(spark, sf).filter("not unseen").withColumn("sib", F.concat("intent", "lang", "grp"))
    top = E.nearest(d, d, 1, exclude=("sib",)).select(F.col("qid").alias("id"), "pid")
    lab = d.select("id", "intent", "sib")
    hit = lab.join(top, "id").join(lab.select(F.col("id").alias("pid"), F.col("intent").alias("found")), "pid")
    by_sib = lab.groupBy("intent", "sib").agg(F.count(F.lit(1)).alias("n_sib"))
    by_int = by_sib.groupBy("intent").agg(F.sum("n_sib").alias("n_int"))
    n = by_sib.groupBy().agg(F.sum("n_sib").alias("n_all"))
    ch = attach(by_sib.join(by_int, "intent"), n)
    ch = ch.select("sib", ((F.col("n_int") - F.col("n_sib")) / (F.col("n_all") - F.col("n_sib"))).alias("chance"))
    return hit.join(ch, "sib").agg(F.count(F.lit(1)).alias("n"), r6(F.avg((F.col("intent") == F.col("found")).cast("double")), "intent_acc"), r6(F.avg("chance"), "intent_chance"))


def paraphrase(d):
    """Nearest-seen accuracy and same/other-label cosine means of the unseen rows (columns id, vec, intent, lang, unseen)."""
    q, seen = d.filter("unseen"), d.filter("not unseen")
    labels = seen.select(F.col("id").alias("pid"), F.col("intent").alias("found"))
    own = q.select(F.col("id").alias("qid"), "intent")
    acc = lambda require, name: E.nearest(q, seen, 1, require=require).join(labels, "pid").join(own, "qid").agg(
        F.avg((F.col("found") == F.col("intent")).cast("double")).alias(name))
    # sums per (side, label, language): every pair mean below is a dot product of two of these few rows
    g = E.group_sums(d, ["unseen", "intent", "lang"], "vec", X.DIMS)
    keep = lambda side, keys: g.filter("unseen" if side else "not unseen").groupBy(*keys).agg(F.sum("n").alias(f"n{side}"), E.vector_sum("s", X.DIMS).alias(f"s{side}"))

    def total(keys, name):
        a, b = (keep(s, keys) for s in (1, 0))
        j = a.join(b, keys) if keys else attach(a, b)
        return j.agg(F.sum(F.expr(D.dot("s1", "s0"))).alias(f"c_{name}"), F.sum(F.col("n1") * F.col("n0")).alias(f"n_{name}"))

    n = g.agg(F.sum(F.when(F.col("unseen"), F.col("n"))).alias("n_unseen"), F.sum(F.when(~F.col("unseen"), F.col("n"))).alias("n_seen"))
    lang_seen = g.filter("not unseen").groupBy("lang").agg(F.sum("n").alias("nl"))
    cl = g.filter("unseen").select("intent", "lang", F.col("n").alias("nu")).join(lang_seen, "lang", "left").join(
        g.filter("not unseen").select("intent", "lang", F.col("n").alias("ns")), ["intent", "lang"], "left")
    cl = cl.agg((F.sum(F.col("nu") * F.coalesce("ns", F.lit(0)) / F.greatest(F.coalesce("nl", F.lit(0)), F.lit(1))) / F.sum("nu")).alias("chance_l"))
    auc = E.pair_auc(q, seen).select("auc")
    out = attach(n, acc((), "acc"), acc(("lang",), "acc_l"), cl, auc, total([], "all"), total(["intent"], "same"), total(["lang"], "lang"), total(["intent", "lang"], "same_l"))
    div = lambda a, b: a / F.nullif(b, F.lit(0))
    c = F.col
    same, diff = div(c("c_same"), c("n_same")), div(c("c_all") - c("c_same"), c("n_all") - c("n_same"))
    same_l, diff_l = div(c("c_same_l"), c("n_same_l")), div(c("c_lang") - c("c_same_l"), c("n_lang") - c("n_same_l"))
    return out.select(
        "n_unseen", "n_seen", r6("acc", "intent_acc"), r6(c("n_same") / c("n_all"), "intent_chance"), r6("acc_l", "intent_acc_samelang"), r6("chance_l", "intent_chance_samelang"),
        r6(same, "cos_same"), r6(diff, "cos_diff"), r6(same - diff, "margin"), r6(same_l, "cos_same_lang"), r6(diff_l, "cos_diff_lang"), r6(same_l - diff_l, "margin_lang"), F.round("auc", 4).alias("auc_samelang"))


PARA_SQL = """
, t AS (SELECT qid, any_value(qi) AS qi, arg_min(pi, (-round(c, 6), pid)) AS best, arg_min(pi, (-round(c, 6), pid)) FILTER (ql = pl) AS best_l,
    avg((qi = pi AND ql = pl)::INT) / greatest(avg((ql = pl)::INT), 1e-300) AS ch_l FROM cross_us GROUP BY qid),
 v AS (SELECT round(c, 4) AS v, count(*) FILTER (qi = pi) AS p, count(*) FILTER (qi <> pi) AS n FROM cross_us WHERE ql = pl GROUP BY 1),
 auc AS (SELECT sum(p * (below + n / 2.0)) / (sum(p) * sum(n)) AS auc FROM (SELECT *, coalesce(sum(n) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM v))
SELECT (SELECT count(*) FROM u WHERE unseen) AS n_unseen, (SELECT count(*) FROM u WHERE NOT unseen) AS n_seen, round((SELECT avg((qi = best)::INT) FROM t), 6) AS intent_acc,
  round(avg((qi = pi)::INT), 6) AS intent_chance, round((SELECT avg((qi = best_l)::INT) FROM t), 6) AS intent_acc_samelang, round((SELECT avg(ch_l) FROM t), 6) AS intent_chance_samelang,
  round(avg(c) FILTER (qi = pi), 6) AS cos_same, round(avg(c) FILTER (qi <> pi), 6) AS cos_diff, round(avg(c) FILTER (qi = pi) - avg(c) FILTER (qi <> pi), 6) AS margin,
  round(avg(c) FILTER (qi = pi AND ql = pl), 6) AS cos_same_lang, round(avg(c) FILTER (qi <> pi AND ql = pl), 6) AS cos_diff_lang,
  round(avg(c) FILTER (qi = pi AND ql = pl) - avg(c) FILTER (qi <> pi AND ql = pl), 6) AS margin_lang, round((SELECT auc FROM auc), 4) AS auc_samelang FROM cross_us"""


@query("ag_paraphrase", with_("cross_us") + PARA_SQL)
def ag_paraphrase(spark, sf):
    return paraphrase(spaces(spark, sf))


def teacher_cosine(d, keys):
    """Own cosine of student (x) and teacher (t) rows, chance level, and same-language other-label level, per key group."""
    sums = d.groupBy(*keys, "lang", "intent").agg(F.count(F.lit(1)).alias("n"), E.vector_sum("x", X.DIMS).alias("sx"), E.vector_sum("t", X.DIMS).alias("st"), F.sum("own").alias("own"))
    lang = sums.groupBy(*keys, "lang").agg(F.sum("n").alias("nl"), E.vector_sum("st", X.DIMS).alias("sl"))
    tot = sums.groupBy(*keys).agg(F.sum("n").alias("n_all"), E.vector_sum("sx", X.DIMS).alias("ax"), E.vector_sum("st", X.DIMS).alias("at"), F.sum("own").alias("own_all"))
    # rows of one (language, label) share the same comparison sum, so its mean needs only their summed x
    oth = sums.join(lang, [*keys, "lang"]).withColumn("m", F.expr(f"({D.dot('sx', 'sl')} - {D.dot('sx', 'st')}) / greatest(nl - n, 1)"))
    oth = oth.groupBy(*keys).agg(F.sum("m").alias("m"))
    j = tot.join(oth, list(keys))
    own, other = F.col("own_all") / F.col("n_all"), F.col("m") / F.col("n_all")
    chance = (F.expr(D.dot("ax", "at")) - F.col("own_all")) / F.greatest(F.lit(1), F.col("n_all") * (F.col("n_all") - 1))
    return j.select(*keys, F.col("n_all").alias("n"), r6(own, "cos"), r6(chance, "chance"), r6(other, "cos_other_samelang"), r6(own - other, "specificity"))


def student_rows(spark, sf):
    d = X.emb_roles(spark, sf).withColumn("x", F.expr("transform(vec, (v, i) -> if(i < 40, v, 0D))"))
    d = d.selectExpr("uid", "intent", "lang", "unseen", "uid % 3 = 0 as truncated", f"{D.unit('x')} as x", f"{D.unit('vec')} as t")
    return d.withColumn("own", F.expr(D.dot("x", "t")))


cte("xt", """
SELECT uid, intent, lang, unseen, uid % 3 = 0 AS truncated, list_transform(x, lambda v: v / sqrt(list_dot_product(x, x))) AS x, list_transform(vec, lambda v: v / sqrt(list_dot_product(vec, vec))) AS t
FROM (SELECT *, list_concat(vec[1:40], list_transform(range(0, 24), lambda z: 0.0::DOUBLE)) AS x FROM roles)""", "roles")


@query("ag_teacher_cosine", with_("xt") + """
, p AS (SELECT a.unseen, a.truncated, a.uid AS i, b.uid AS j, a.lang = b.lang AND a.intent <> b.intent AS oth, list_dot_product(a.x, b.t) AS c FROM xt a JOIN xt b ON a.unseen = b.unseen AND a.truncated = b.truncated),
 r AS (SELECT unseen, truncated, i, max(CASE WHEN i = j THEN c END) AS own, sum(CASE WHEN i <> j THEN c END) AS off, count(*) AS n, coalesce(sum(CASE WHEN oth THEN c END), 0) / greatest(count(CASE WHEN oth THEN 1 END), 1) AS o FROM p GROUP BY ALL)
SELECT unseen, truncated, count(*) AS n, round(avg(own), 6) AS cos, round(sum(off) / (count(*) * (count(*) - 1)), 6) AS chance, round(avg(o), 6) AS cos_other_samelang, round(avg(own) - avg(o), 6) AS specificity FROM r GROUP BY ALL""")
def ag_teacher_cosine(spark, sf):
    return teacher_cosine(student_rows(spark, sf), ["unseen", "truncated"])


@query("ag_verdict", with_("u", "xt") + """
, ps AS (SELECT a.id AS qid, any_value(a.intent) AS qi, arg_min(b.intent, (-round(list_dot_product(a.vec, b.vec), 6), b.id)) AS bt, arg_min(b.intent, (-round(list_dot_product(a.svec, b.svec), 6), b.id)) AS bs,
    avg((a.intent = b.intent)::INT) AS ch FROM u a, u b WHERE a.unseen AND NOT b.unseen GROUP BY a.id),
 m AS (SELECT avg((qi = bs)::INT) AS acc, avg((qi = bt)::INT) AS tacc, avg(ch) AS chance FROM ps),
 c AS (SELECT avg(list_dot_product(x, t)) FILTER (unseen) AS cu, avg(list_dot_product(x, t)) FILTER (NOT unseen) AS cs FROM xt)
SELECT round(acc, 4) AS intent_acc, round(tacc, 4) AS teacher_acc, round(chance, 4) AS chance, round(cu, 4) AS cos_unseen, round(cs, 4) AS cos_seen,
  round(acc, 4) >= 0.7 * round(tacc, 4) AS near_teacher, round(acc, 4) >= 5 * round(chance, 4) AS above_chance, round(cu, 4) >= 0.8 * round(cs, 4) AS cos_close,
  round(acc, 4) >= 0.7 * round(tacc, 4) AND round(acc, 4) >= 5 * round(chance, 4) AND round(cu, 4) >= 0.8 * round(cs, 4) AS close_enough FROM m, c""")
def ag_verdict(spark, sf):
    d = spaces(spark, sf)
    lab = d.filter("not unseen").select(F.col("id").alias("pid"), F.col("intent").alias("found"))
    own = d.filter("unseen").select(F.col("id").alias("qid"), "intent")
    acc = lambda x, n: E.nearest(x.filter("unseen"), x.filter("not unseen"), 1).join(lab, "pid").join(own, "qid").agg(
        F.round(F.avg((F.col("found") == F.col("intent")).cast("double")), 4).alias(n))
    cnt = d.groupBy("intent").agg(F.count_if("unseen").alias("a"), F.count_if(~F.col("unseen")).alias("b"))
    ch = cnt.agg(F.round(F.sum(F.col("a") * F.col("b")) / (F.sum("a") * F.sum("b")), 4).alias("chance"))
    cs = student_rows(spark, sf).agg(F.round(F.avg(F.when(F.col("unseen"), F.col("own"))), 4).alias("cos_unseen"), F.round(F.avg(F.when(~F.col("unseen"), F.col("own"))), 4).alias("cos_seen"))
    j = attach(acc(d.drop("vec").withColumnRenamed("svec", "vec"), "intent_acc"), acc(d, "teacher_acc"), ch, cs)
    j = j.withColumns({"near_teacher": F.col("intent_acc") >= E.TEACHER_RATIO * F.col("teacher_acc"), "above_chance": F.col("intent_acc") >= E.CHANCE_FACTOR * F.col("chance"),
                       "cos_close": F.col("cos_unseen") >= E.SEEN_RATIO * F.col("cos_seen")})
    return j.withColumn("close_enough", F.col("near_teacher") & F.col("above_chance") & F.col("cos_close"))


@query("tk_paraphrase_examples", with_("cross_us") + f"""
, pick AS (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY lang ORDER BY {X.rank_sql("'example'", 'id')}) AS rn FROM u WHERE unseen) WHERE rn <= 2),
 r AS (SELECT *, round(c, 6) AS cos, row_number() OVER (PARTITION BY qid ORDER BY round(c, 6) DESC, pid) AS rank FROM cross_us WHERE ql = pl AND qid IN (SELECT id FROM pick))
SELECT qid, pid, rank, cos, pi AS intent FROM r WHERE rank <= 3""")
def tk_paraphrase_examples(spark, sf):
    d = spaces(spark, sf)
    q = d.filter("unseen").withColumn("h", H.rank_key("example", F.col("id")))
    q = prefix(q, ["h"], hash_bucket("h"), ["lang"], keep_below=("rn", 2))
    seen = d.filter("not unseen")
    top = E.nearest(q, seen, 3, require=("lang",))
    return top.join(seen.select(F.col("id").alias("pid"), "intent"), "pid").select("qid", "pid", F.col("rank").cast("bigint").alias("rank"), "cos", "intent")


@query("ag_embed_consistency", with_("roles") + """
SELECT count(*) AS n, round(avg(c), 6) AS mean_cos, round(min(c), 6) AS min_cos FROM (SELECT list_cosine_similarity(vec, list_transform(vec, lambda x: round(x * 16) / 16)) AS c FROM roles)""")
def ag_embed_consistency(spark, sf):
    a = X.emb_roles(spark, sf).select("uid", "vec")
    b = a.selectExpr("uid", "transform(vec, x -> round(x * 16) / 16) as again")
    return a.join(b, "uid").select(F.expr(D.cosine("vec", "again")).alias("c")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("c"), "mean_cos"), r6(F.min("c"), "min_cos"))


# ---- judgement against representation ------------------------------------------------------

cte("zc", "SELECT label, d, avg(v) AS z FROM dims WHERE vec_id % 5 = 0 GROUP BY label, d", "dims")
cte("simtab", """
SELECT a.label AS la, b.label AS lb, sum(a.z * b.c) / sqrt(sum(a.z * a.z) * sum(b.c * b.c)) AS sim FROM zc a JOIN cent b ON a.d = b.d GROUP BY a.label, b.label""", "zc", "cent")
cte("repr", """
SELECT p.run, p.item_id, p.pos, p.lab, p.ps, round(s.sim, 6) AS sim, i.tpred, i.pred FROM pred_long p JOIN per_item i ON i.run = p.run AND i.item_id = p.item_id
JOIN pred_long t ON t.run = p.run AND t.item_id = p.item_id AND t.pos = i.tpred JOIN simtab s ON s.la = p.lab AND s.lb = t.lab WHERE p.split = 'test'""", "per_item", "simtab")


def pred_repr(spark, sf):
    """Test items at candidate grain: student probability and similarity to the teacher's choice."""
    from decant.operators import metrics as M

    e = table(spark, sf, "embeddings")
    means = ", ".join(f"avg(double(embedding[{i}]))" for i in range(X.DIMS))
    z = e.filter("vec_id % 5 = 0").groupBy("label").agg(F.expr(f"array({means})").alias("z"))
    c = X.centroids(spark, sf)
    d = M.score_items(X.dec_preds(spark, sf).filter("split = 'test'"))
    d = d.selectExpr("run", "item_id", "pred", "tpred", "get(labs, tpred) as target", "posexplode(arrays_zip(labs, ps)) as (pos, x)")
    d = d.selectExpr("run", "item_id", "pred", "tpred", "target", "pos", "x.labs as lab", "x.ps as p")
    # vectors per label: as many rows as there are labels
    d = d.join(z, d.lab == z.label).drop("label").join(c.withColumnRenamed("label", "target"), "target")
    return d.select("run", "item_id", "pred", "tpred", "pos", "lab", "p", D.r6(D.cosine("z", "c"), "sim"))


@query("jn_pred_repr", with_("repr") + "SELECT run, item_id, pos::INTEGER AS pos, lab, round(ps, 6) AS p, sim FROM repr")
def jn_pred_repr(spark, sf):
    return pred_repr(spark, sf).select("run", "item_id", "pos", "lab", r6("p", "p"), "sim")


@query("ag_contingency", with_("repr") + """
, i AS (SELECT run, item_id, arg_min(pos, (-sim, pos)) = any_value(tpred) AS rep, any_value(pred) = any_value(tpred) AS jud FROM repr GROUP BY run, item_id),
 a AS (SELECT run, count(*) AS n, count(*) FILTER (rep AND jud) AS both_ok, count(*) FILTER (rep AND NOT jud) AS rep_only, count(*) FILTER (NOT rep AND jud) AS judge_only, count(*) FILTER (NOT rep AND NOT jud) AS neither,
   avg(rep::INT) AS r, avg(jud::INT) AS j, avg((rep AND jud)::INT) AS rj FROM i GROUP BY run)
SELECT run, n, both_ok, rep_only, judge_only, neither, round(both_ok / nullif(both_ok + rep_only, 0), 6) AS judge_given_rep_ok, round(judge_only / nullif(judge_only + neither, 0), 6) AS judge_given_rep_ng,
  round(CASE WHEN r * (1 - r) * j * (1 - j) > 0 THEN (rj - r * j) / sqrt(r * (1 - r) * j * (1 - j)) END, 6) AS phi FROM a""")
def ag_contingency(spark, sf):
    d = pred_repr(spark, sf)
    i = d.groupBy("run", "item_id").agg(F.min(F.struct(-F.col("sim"), "pos")).alias("b"), F.max("tpred").alias("t"), F.max("pred").alias("p"))
    i = i.select("run", (F.col("b.pos") == F.col("t")).alias("rep"), (F.col("p") == F.col("t")).alias("jud"))
    c = lambda e: F.count_if(F.expr(e))
    a = i.groupBy("run").agg(F.count(F.lit(1)).alias("n"), c("rep and jud").alias("both_ok"), c("rep and not jud").alias("rep_only"), c("not rep and jud").alias("judge_only"), c("not rep and not jud").alias("neither"))
    a = a.withColumns({"r": F.expr("(both_ok + rep_only) / n"), "j": F.expr("(both_ok + judge_only) / n")}).withColumn("v", F.expr("r * (1 - r) * j * (1 - j)"))
    return a.select("run", "n", "both_ok", "rep_only", "judge_only", "neither", D.r6("both_ok / nullif(both_ok + rep_only, 0)", "judge_given_rep_ok"),
                    D.r6("judge_only / nullif(judge_only + neither, 0)", "judge_given_rep_ng"), D.r6("if(v > 0, (both_ok / n - r * j) / sqrt(v), null)", "phi"))


@query("wn_spearman", with_("pred_raw") + """
, r AS (SELECT run, item_id, rank() OVER (PARTITION BY run, item_id ORDER BY s) + (count(*) OVER (PARTITION BY run, item_id, s) - 1) / 2.0 AS a,
   rank() OVER (PARTITION BY run, item_id ORDER BY t) + (count(*) OVER (PARTITION BY run, item_id, t) - 1) / 2.0 AS b FROM pred_raw WHERE k >= 3)
SELECT run, count(*) AS n, round(avg(c), 6) AS spearman FROM (SELECT run, item_id, corr(a, b) AS c FROM r GROUP BY run, item_id) GROUP BY run""")
def wn_spearman(spark, sf):
    from decant.operators.metrics import spearman

    d = X.dec_preds(spark, sf).filter("k >= 3").selectExpr("run", f"{spearman('s', 't')} as c")
    return d.groupBy("run").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("c"), "spearman"))


# ---- projections and losses ----------------------------------------------------------------

@query("ml_pca_fit")
def ml_pca_fit(spark, sf):
    p = E.principal_axes(X.emb_roles(spark, sf).filter("not unseen"), "vec", 16)
    rows = [(i, float(v), float(r), p.n) for i, (v, r) in enumerate(zip(p.variance, p.share))]
    return spark.createDataFrame(rows, "component int, explained_variance double, ratio double, n bigint")


@query("ml_pca_apply")
def ml_pca_apply(spark, sf):
    d = X.emb_roles(spark, sf)
    p = E.principal_axes(d.filter("not unseen"), "vec", 16)
    d = E.project(d.select("uid", "unseen", "vec"), "vec", p.mean, p.rows.T, "pc")
    return d.selectExpr("uid", "unseen", "round(pc[0], 6) as pc1", "round(pc[1], 6) as pc2", f"round({D.norm('pc')}, 6) as length")


@query("ml_ridge_cv")
def ml_ridge_cv(spark, sf):
    d = X.emb_roles(spark, sf).selectExpr("uid", "grp", "not unseen as seen", "svec", "vec")
    fit, alpha, _ = E.ridge_by_groups(d, "svec", "vec", "grp")
    return fit.select("seen", F.expr(D.cosine("pred", "vec")).alias("c")).groupBy("seen").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("c"), "cos")).withColumn("alpha", F.lit(float(alpha)))


cte("mu", """
SELECT list(m ORDER BY d) AS m FROM (SELECT d, avg(x) AS m FROM (SELECT unnest(vec) AS x, generate_subscripts(vec, 1) AS d FROM u) GROUP BY d)""", "u")


def centred(spark, sf):
    d = spaces(spark, sf)
    m = E.group_sums(d, [], "vec", X.DIMS).selectExpr("transform(s, x -> x / n) as m")
    return attach(d, m).withColumn("e", F.expr(D.unit("zip_with(vec, m, (a, b) -> a - b)"))).drop("m")


@query("ml_center_unit", with_("u", "mu") + """
SELECT id, round(e[1] / n, 6) AS e1, round(e[64] / n, 6) AS e64 FROM (SELECT id, e, sqrt(list_dot_product(e, e)) AS n FROM (SELECT id, list_transform(range(1, 65), lambda i: vec[i] - m[i]) AS e FROM u, mu))""")
def ml_center_unit(spark, sf):
    return centred(spark, sf).select("id", D.r6("e[0]", "e1"), D.r6("e[63]", "e64"))


RP_COLS = 8
RP = "(('0x' || substr(sha1('20261006:rproj:' || i || ':' || j || ':' || {0}), 1, 8))::BIGINT + 1) / 4294967297.0::DOUBLE"


@query("ml_random_project", with_("u") + f"""
, r AS (SELECT i, j, sqrt(-2 * ln({RP.format(1)})) * cos(2 * pi() * {RP.format(2)}) / sqrt({RP_COLS}) AS g FROM (SELECT unnest(range(0, 64)) AS i), (SELECT unnest(range(0, {RP_COLS})) AS j)),
 v AS (SELECT id, unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS i FROM u)
SELECT id, j::INTEGER AS dim, round(sum(x * g), 6) AS y FROM v JOIN r USING (i) GROUP BY id, j""")
def ml_random_project(spark, sf):
    import numpy as np

    d = E.project(spaces(spark, sf).select("id", "vec"), "vec", np.zeros(X.DIMS), E.gaussian_matrix(X.DIMS, RP_COLS, "rproj"), "y")
    return d.selectExpr("id", "posexplode(y) as (dim, y)").select("id", "dim", r6("y", "y"))


BATCH = 32


def pairs(spark, sf):
    """Aligned student and teacher vectors in fixed-size batches; every fourth row repeats a string."""
    d = centred(spark, sf)
    return d.selectExpr("id", f"id div {BATCH} as batch", "if(id % 4 = 1, id - 1, id) as uid", "slice(vec, 1, 32) as z", "slice(vec, 17, 32) as t", "e")


cte("pz", "SELECT id, id // 32 AS batch, CASE WHEN id % 4 = 1 THEN id - 1 ELSE id END AS uid, vec[1:32] AS z, vec[17:48] AS t FROM u", "u")
cte("pzn", """SELECT id, batch, uid, list_transform(z, lambda x: x / sqrt(list_dot_product(z, z) + 1e-12)) AS z, list_transform(t, lambda x: x / sqrt(list_dot_product(t, t) + 1e-12)) AS t FROM pz""", "pz")
cte("ce", """SELECT id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM (SELECT id, list_transform(range(1, 65), lambda i: vec[i] - m[i]) AS e FROM u, mu)""", "u", "mu")
cte("rkd", """
SELECT batch, any_value(n) AS n_rows, coalesce(avg(kl), 0) AS rkd FROM (SELECT batch, count(*) AS n FROM pzn GROUP BY batch) LEFT JOIN (SELECT batch, i, sum(pt * (ln(pt) - ln(ps))) AS kl FROM (
  SELECT batch, i, exp(st) / sum(exp(st)) OVER w AS pt, exp(ss) / sum(exp(ss)) OVER w AS ps FROM (
    SELECT a.batch, a.id AS i, list_dot_product(x.e, y.e) / 0.1 AS st, list_dot_product(a.z, b.z) / 0.1 AS ss FROM pzn a JOIN pzn b ON a.batch = b.batch AND a.uid <> b.uid JOIN ce x ON x.id = a.id JOIN ce y ON y.id = b.id)
  WINDOW w AS (PARTITION BY batch, i)) GROUP BY batch, i) USING (batch) GROUP BY batch""", "pzn", "ce")
cte("nce", """
SELECT batch, 0.5 * (avg(CASE WHEN i = j THEN -lr END) + avg(CASE WHEN i = j THEN -lc END)) AS nce FROM (
  SELECT batch, i, j, s - ln(sum(exp(s)) OVER (PARTITION BY batch, i)) AS lr, s - ln(sum(exp(s)) OVER (PARTITION BY batch, j)) AS lc FROM (
    SELECT a.batch, a.id AS i, b.id AS j, list_dot_product(a.z, b.t) / 0.07 AS s FROM pzn a JOIN pzn b ON a.batch = b.batch AND (a.id = b.id OR a.uid <> b.uid))) GROUP BY batch""", "pzn")
cte("lcos", "SELECT batch, count(*) AS n, avg(1 - list_dot_product(z, t)) AS cos, avg(list_dot_product(z, z) + list_dot_product(t, t) - 2 * list_dot_product(z, t)) AS mse FROM pzn GROUP BY batch", "pzn")


def cos_losses(d):
    z, t = D.unit("z", "1e-6D"), D.unit("t", "1e-6D")
    d = d.selectExpr("batch", f"{z} as z", f"{t} as t")
    return d.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.avg(1 - F.expr(D.dot("z", "t"))).alias("cos"), F.avg(F.expr(D.squared_distance("z", "t"))).alias("mse"))


@query("ls_cos", with_("lcos") + "SELECT batch, n, round(cos, 6) AS cos FROM lcos")
def ls_cos(spark, sf):
    return cos_losses(pairs(spark, sf)).select("batch", "n", r6("cos", "cos"))


@query("ls_mse", with_("lcos") + "SELECT batch, n, round(mse, 6) AS mse, round(2 * cos, 6) AS twice_cos FROM lcos")
def ls_mse(spark, sf):
    return cos_losses(pairs(spark, sf)).select("batch", "n", r6("mse", "mse"), r6(2 * F.col("cos"), "twice_cos"))


@query("ls_rkd", with_("rkd") + "SELECT batch, round(rkd, 6) AS rkd FROM rkd")
def ls_rkd(spark, sf):
    """One row per batch; a batch whose rows all have one uid has no relation and a loss of 0."""
    return E.pair_losses(pairs(spark, sf), "batch").select("batch", r6("rkd", "rkd"))


@query("ls_infonce", with_("nce") + "SELECT batch, round(nce, 6) AS infonce FROM nce")
def ls_infonce(spark, sf):
    return E.pair_losses(pairs(spark, sf), "batch").select("batch", r6("infonce", "infonce"))


@query("ls_combined", with_("lcos", "rkd", "nce") + "SELECT batch, round(1.0 * cos + 0.5 * rkd + 0.25 * nce, 6) AS total FROM lcos JOIN rkd USING (batch) JOIN nce USING (batch)")
def ls_combined(spark, sf):
    p = pairs(spark, sf)
    j = cos_losses(p).join(E.pair_losses(p, "batch").drop("n"), "batch")
    return j.select("batch", r6(F.col("cos") + 0.5 * F.col("rkd") + 0.25 * F.col("infonce"), "total"))
