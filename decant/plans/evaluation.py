"""Evaluation queries: distribution functions, metric aggregates, robustness."""

from __future__ import annotations

from pyspark.sql import functions as F

from decant.functions import dist as D
from decant.functions import hashing as H
from decant.operators import metrics as M
from decant.operators.config import loss_weights
from decant.plans import fixtures as X
from decant.plans.registry import query, table, with_

R = lambda c, n: F.round(c, 6).alias(n)


def scored(spark, sf):
    return M.score_items(X.dec_preds(spark, sf))


# ---- distribution functions ----------------------------------------------------------------

@query("dec_scores", with_("dec_scores") + "SELECT item_id, cand, gold_label, t, s16, s32, s48 FROM dec_scores")
def dec_scores(spark, sf):
    return X.dec_scores(spark, sf)


@query("fn_softmax_masked", with_("pred_long") + """
SELECT run, item_id, pos, round(ps, 6) AS p, round(ps2, 6) AS p_t2 FROM pred_long""")
def fn_softmax_masked(spark, sf):
    d = X.dec_preds(spark, sf)
    d = d.selectExpr("run", "item_id", f"{D.softmax('s')} as p", f"{D.softmax('s', 2.0)} as q")
    d = d.selectExpr("run", "item_id", "posexplode(arrays_zip(p, q)) as (pos, z)")
    return d.selectExpr("run", "item_id", "bigint(pos) as pos", "round(z.p, 6) as p", "round(z.q, 6) as p_t2")


@query("fn_logsumexp", with_("dec_long") + """
SELECT item_id, round(any_value(mx) + ln(sum(exp(60.0 * t - mx))), 6) AS lse
FROM (SELECT *, max(60.0 * t) OVER (PARTITION BY item_id) AS mx FROM dec_long) GROUP BY item_id""")
def fn_logsumexp(spark, sf):
    d = X.item_base(spark, sf)
    return d.selectExpr("item_id", f"transform(t, x -> x * {X.SCALE}D) as lg").select("item_id", D.r6(D.logsumexp("lg"), "lse"))


@query("fn_entropy", with_("per_item") + """
SELECT run, item_id, round(hs, 6) AS h, round(hs / ln(greatest(k, 2)), 6) AS h_norm FROM per_item""")
def fn_entropy(spark, sf):
    return scored(spark, sf).select("run", "item_id", R("hs", "h"), R("nhs", "h_norm"))


@query("fn_kl", with_("per_item") + "SELECT run, item_id, round(kl, 6) AS kl FROM per_item")
def fn_kl(spark, sf):
    return scored(spark, sf).select("run", "item_id", R("kl", "kl"))


LOSS_SQL = "CASE WHEN gold IS NOT NULL THEN {0} * kd + {1} * ce ELSE kd END"


@query("fn_composite_loss", with_("per_item") + f"""
SELECT run, item_id, round(kd, 6) AS kd, round(CASE WHEN gold IS NOT NULL THEN ce END, 6) AS ce,
       round({LOSS_SQL.format(0.8, 0.2)}, 6) AS loss FROM per_item""")
def fn_composite_loss(spark, sf):
    return scored(spark, sf).select("run", "item_id", R("kd", "kd"), R("ce", "ce"), R("loss", "loss"))


@query("fn_source_weights", with_("per_item") + f"""
SELECT run, source, count(*) AS n, round(avg({LOSS_SQL.format('coalesce(w.kd_w, 0.8)', 'coalesce(w.ce_w, 0.2)')}), 6) AS loss
FROM per_item LEFT JOIN (VALUES ('a', 0.5, 0.5), ('synth', 1.0, 0.0)) w(src, kd_w, ce_w) ON source = w.src GROUP BY run, source""")
def fn_source_weights(spark, sf):
    w = loss_weights(spark, "a:kd=0.5,ce=0.5;synth:kd=1.0,ce=0.0")
    d = X.dec_preds(spark, sf).join(F.broadcast(w), "source", "left")
    d = M.score_items(d, f"coalesce(w_kd, {D.W_KD_GOLD}D)", f"coalesce(w_ce, {D.W_CE_GOLD}D)")
    return d.groupBy("run", "source").agg(F.count(F.lit(1)).alias("n"), R(F.avg("loss"), "loss"))


@query("fn_argmax", with_("per_item") + "SELECT run, item_id, pred::BIGINT AS pred, tpred::BIGINT AS tpred FROM per_item")
def fn_argmax(spark, sf):
    return X.dec_preds(spark, sf).selectExpr("run", "item_id", f"bigint({D.argmax('s')}) as pred", f"bigint({D.argmax('t')}) as tpred")


@query("fn_permute", with_("item_attr", "item_pos", "dec_scores") + f"""
SELECT p.item_id, string_agg('topic ' || p.lab, '|' ORDER BY {X.rank_sql("'perm'", 'p.item_id', 'p.lab')}) AS candidates,
       string_agg(printf('%.6f', s.t + 0.0), '|' ORDER BY {X.rank_sql("'perm'", 'p.item_id', 'p.lab')}) AS scores,
       (any_value(CASE WHEN a.gold IS NOT NULL THEN g.rk END))::INTEGER AS gold
FROM item_pos p JOIN item_attr a USING (item_id) JOIN dec_scores s ON s.item_id = p.item_id AND s.cand = p.lab
LEFT JOIN (SELECT item_id, rk FROM (SELECT item_id, lab, gold_label,
             row_number() OVER (PARTITION BY item_id ORDER BY {X.rank_sql("'perm'", 'item_id', 'lab')}) - 1 AS rk FROM item_pos)
           WHERE lab = gold_label) g ON g.item_id = p.item_id
GROUP BY p.item_id""")
def fn_permute(spark, sf):
    """Scores as text with six digits; one that rounds to zero has no sign."""
    from decant.operators.items import permute

    d = X.item_base(spark, sf)
    keyed = permute(d, f"transform(labs, x -> {H.rank_text(repr('perm'), 'item_id', 'x')})", ("labs", "t"))
    return keyed.selectExpr(
        "item_id", "array_join(transform(labs, x -> concat('topic ', x)), '|') as candidates",
        "array_join(transform(t, x -> printf('%.6f', x)), '|') as scores", "gold")


@query("fn_make_perms", with_("item_pos") + f"""
SELECT item_id, 0 AS perm, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS ord FROM item_pos GROUP BY item_id
UNION ALL SELECT item_id, 1, string_agg(pos::VARCHAR, ',' ORDER BY pos DESC) FROM item_pos GROUP BY item_id
UNION ALL SELECT item_id, 2, string_agg(pos::VARCHAR, ',' ORDER BY {X.rank_sql("'order'", 'item_id', '2', 'pos')}) FROM item_pos GROUP BY item_id
HAVING string_agg(pos::VARCHAR, ',' ORDER BY {X.rank_sql("'order'", 'item_id', '2', 'pos')}) NOT IN
  (string_agg(pos::VARCHAR, ',' ORDER BY pos), string_agg(pos::VARCHAR, ',' ORDER BY pos DESC))""")
def fn_make_perms(spark, sf):
    from decant.operators.items import make_orders

    d = X.dec_items(spark, sf)
    d = d.selectExpr("item_id", f"posexplode({make_orders('size(candidates)', 3, 'item_id')}) as (perm, o)")
    return d.selectExpr("item_id", "perm", "array_join(o, ',') as ord")


@query("fn_vec_ops", with_("roles") + """
SELECT uid, round(sqrt(list_dot_product(vec, vec)), 6) AS norm,
       round(vec[1] / greatest(sqrt(list_dot_product(vec, vec)), 1e-12), 6) AS unit_first,
       round(list_cosine_similarity(vec[1:32], vec[33:64]), 6) AS cos_halves FROM roles""")
def fn_vec_ops(spark, sf):
    d = X.emb_roles(spark, sf)
    return d.select("uid", D.r6(D.norm("vec"), "norm"), D.r6(f"get({D.unit('vec')}, 0)", "unit_first"),
                    D.r6(D.cosine("slice(vec, 1, 32)", "slice(vec, 33, 32)"), "cos_halves"))


@query("fn_vec_mean_soft", """
SELECT vec_id, i - 1 AS dim, round((v[i] + v[i + 8] + v[i + 16]) / 3.0, 6) AS reader_avg,
       round(CASE WHEN s > 0 THEN greatest(v[i], 0) / s ELSE 0.125 END, 4) AS soft
FROM (SELECT vec_id, embedding::DOUBLE[] AS v, unnest(range(1, 9)) AS i,
             (SELECT sum(greatest(x, 0)) FROM (SELECT unnest(embedding[1:8]::DOUBLE[]) AS x)) AS s FROM embeddings)""")
def fn_vec_mean_soft(spark, sf):
    from decant.operators.items import mean_vectors, soft

    d = table(spark, sf, "embeddings").selectExpr("vec_id", "cast(embedding as array<double>) as v")
    parts = [f"slice(v, {1 + 8 * j}, 8)" for j in range(3)]
    d = d.selectExpr("vec_id", f"{mean_vectors(parts)} as m", f"{soft(f'transform({parts[0]}, x -> greatest(x, 0D))')} as s")
    d = d.selectExpr("vec_id", "posexplode(arrays_zip(m, s)) as (dim, z)")
    return d.selectExpr("vec_id", "bigint(dim) as dim", "round(z.m, 6) as reader_avg", "round(z.s, 4) as soft")


# ---- metric aggregates ---------------------------------------------------------------------

CORE_SQL = f"""count(*) AS n, count(gold) AS n_gold, round(avg(k), 6) AS mean_k,
  round(avg(1.0 / k), 6) AS random_baseline, round(avg(CASE WHEN gold IS NOT NULL THEN 1.0 / k END), 6) AS random_baseline_gold,
  round(avg((pred = tpred)::INT), 6) AS agreement, round(avg((pred = tpred)::INT) - avg(1.0 / k), 6) AS agreement_minus_random,
  round(avg(kl), 6) AS kl, round(avg({LOSS_SQL.format(0.8, 0.2)}), 6) AS val_loss, round(avg(kd), 6) AS kd_loss,
  round(avg(CASE WHEN gold IS NOT NULL THEN ce END), 6) AS ce_loss, round(avg(bt), 6) AS brier_vs_teacher,
  round(avg(CASE WHEN gold IS NOT NULL THEN (pred = gold)::INT END), 6) AS gold_acc,
  round(avg(CASE WHEN gold IS NOT NULL THEN (tpred = gold)::INT END), 6) AS teacher_gold_acc,
  round(avg(CASE WHEN gold IS NOT NULL THEN ce END), 6) AS nll_gold, round(avg(CASE WHEN gold IS NOT NULL THEN tce END), 6) AS teacher_nll_gold,
  round(avg(CASE WHEN gold IS NOT NULL THEN bs END), 6) AS brier, round(avg(CASE WHEN gold IS NOT NULL THEN tbs END), 6) AS teacher_brier"""


@query("ag_core_metrics", with_("per_item") + f"SELECT run, split, {CORE_SQL} FROM per_item GROUP BY run, split")
def ag_core_metrics(spark, sf):
    return M.core_metrics(scored(spark, sf), ["run", "split"])


@query("ag_by_source", with_("per_item") + f"SELECT run, split, source, {CORE_SQL} FROM per_item GROUP BY run, split, source")
def ag_by_source(spark, sf):
    return M.by_source(scored(spark, sf), ["run", "split"])


@query("ag_key_metric", with_("per_item") + """
SELECT run, round(avg(CASE WHEN split = 'test' AND source = 'a' THEN (pred = tpred)::INT END), 6) AS test_agreement,
       nullif(count(CASE WHEN split = 'test' AND source = 'a' THEN 1 END), 0) AS test_n,
       round(avg(CASE WHEN split = 'test' AND source = 'a' THEN 1.0 / k END), 6) AS test_random_baseline
FROM per_item GROUP BY run""")
def ag_key_metric(spark, sf):
    cell = (F.col("split") == "test") & (F.col("source") == "a")
    m = M.by_source(scored(spark, sf), ["run", "split"])
    pick = lambda c, n: F.max(F.when(cell, F.col(c))).alias(n)
    return m.groupBy("run").agg(pick("agreement", "test_agreement"), pick("n", "test_n"), pick("random_baseline", "test_random_baseline"))


BINS_SQL = """SELECT run, split, least(floor(round(smax, 9) * 15), 14)::INTEGER AS bin, count(*) AS n, sum(smax) AS cs,
  sum((pred = {0})::INT) AS os FROM per_item {1} GROUP BY ALL"""


@query("ag_ece", with_("per_item") + f"""
SELECT g.run, g.split, g.n, g.ece, t.ece AS ece_vs_teacher FROM
 (SELECT run, split, sum(n)::BIGINT AS n, round(sum(abs(os - cs)) / sum(n), 6) AS ece FROM ({BINS_SQL.format('gold', 'WHERE gold IS NOT NULL')}) GROUP BY run, split) g
 JOIN (SELECT run, split, round(sum(abs(os - cs)) / sum(n), 6) AS ece FROM ({BINS_SQL.format('tpred', '')}) GROUP BY run, split) t
 ON g.run = t.run AND g.split = t.split""")
def ag_ece(spark, sf):
    # both labels are binned in one pass: one exploded pair per item, combined on the map side
    d = scored(spark, sf).select("run", "split", "smax", F.explode(F.array(
        F.struct(F.lit("gold").alias("kind"), F.col("gold_ok").alias("ok")),
        F.struct(F.lit("teacher").alias("kind"), F.col("agree").alias("ok")))).alias("x")).select("run", "split", "smax", "x.*")
    e = M.ece(d, ["run", "split", "kind"], "smax", "ok")
    pick = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c)))
    return e.groupBy("run", "split").agg(pick("gold", "n").alias("n"), pick("gold", "ece").alias("ece"), pick("teacher", "ece").alias("ece_vs_teacher"))


@query("ag_reliability", with_("per_item") + f"""
, b AS ({BINS_SQL.format('gold', 'WHERE gold IS NOT NULL')})
SELECT g.run, g.split, g.bin, coalesce(b.n, 0) AS n, round(cs / n, 6) AS conf, round(os / n, 6) AS acc
FROM (SELECT run, split, unnest(range(0, 15))::INTEGER AS bin FROM (SELECT DISTINCT run, split FROM b)) g LEFT JOIN b USING (run, split, bin)""")
def ag_reliability(spark, sf):
    return M.reliability(scored(spark, sf), ["run", "split"], "smax", "gold_ok")


@query("ag_entropy_block", with_("per_item") + """
, e AS (SELECT *, hs / ln(greatest(k, 2)) AS nhs, ht / ln(greatest(k, 2)) AS nht FROM per_item)
SELECT run, split, round(avg(hs), 6) AS student_entropy, round(avg(ht), 6) AS teacher_entropy,
  round(avg(nhs), 6) AS student_norm_entropy, round(avg(nht), 6) AS teacher_norm_entropy,
  round(avg(smax), 6) AS student_maxprob, round(avg(tmax), 6) AS teacher_maxprob, round(corr(hs, ht), 6) AS entropy_pearson,
  count(*) FILTER (round(nht, 9) >= 0.6) AS teacher_uncertain_n,
  count(*) FILTER (round(nht, 9) >= 0.6 AND round(smax, 9) >= 0.85) AS uncertain_confident_n,
  round(count(*) FILTER (round(nht, 9) >= 0.6 AND round(smax, 9) >= 0.85) / greatest(1, count(*) FILTER (round(nht, 9) >= 0.6)), 6) AS uncertain_confident_frac,
  count(*) FILTER (round(nht, 9) < 0.4 AND round(nhs, 9) >= 0.6) AS confident_uncertain_n
FROM e GROUP BY run, split""")
def ag_entropy_block(spark, sf):
    return M.entropy_block(scored(spark, sf), ["run", "split"])


@query("tk_examples", with_("per_item") + """
SELECT run, item_id, k::INTEGER AS k, round(smax - tmax, 6) AS gap, pred = tpred AS agree
FROM per_item WHERE round(ht / ln(greatest(k, 2)), 9) >= 0.6 AND round(smax, 9) >= 0.45
ORDER BY gap DESC, item_id, run LIMIT 20""")
def tk_examples(spark, sf):
    d = scored(spark, sf)
    hit = F.col("multi") & (F.round("nht", 9) >= M.UNCERTAIN) & (F.round("smax", 9) >= 0.45)
    d = d.filter(hit).withColumn("gap", R(F.col("smax") - F.col("tmax"), "gap"))
    return d.orderBy(F.desc("gap"), "item_id", "run").limit(20).select("run", "item_id", "k", "gap", "agree")


@query("ag_position_bias", with_("per_item") + """
, h AS (SELECT run, split, pos, sum((who = 's')::INT) AS s, sum((who = 't')::INT) AS t, sum((who = 'g')::INT) AS g FROM (
   SELECT run, split, 's' AS who, pred AS pos FROM per_item UNION ALL SELECT run, split, 't', tpred FROM per_item
   UNION ALL SELECT run, split, 'g', gold FROM per_item WHERE gold IS NOT NULL) GROUP BY run, split, pos),
 f AS (SELECT run, split, pos, s / sum(s) OVER w AS s, t / sum(t) OVER w AS t, g / sum(g) OVER w AS g FROM h WINDOW w AS (PARTITION BY run, split))
SELECT run, split, pos::INTEGER AS pos, round(s, 6) AS student, round(t, 6) AS teacher, round(g, 6) AS gold,
  round(sum(abs(s - t)) OVER (PARTITION BY run, split) / 2, 6) AS tv_student_teacher FROM f""")
def ag_position_bias(spark, sf):
    return M.position_bias(scored(spark, sf), ["run", "split"])


def _perm_scores(spark, sf, n):
    """Re-score each item in ``n`` hashed orders; the stand-in scorer has a small first-position bias."""
    d = X.dec_preds(spark, sf)
    order = f"transform(array_sort(transform(sequence(0, k - 1), p -> struct({H.rank_text(repr('ps'), 'perm', 'item_id', 'p')} as h, p as p))), z -> z.p)"
    p = d.selectExpr("run", "item_id", "k", "s", f"explode(sequence(0, {n - 1})) as perm").withColumn("order", F.expr(order))
    return d, p.selectExpr("run", "item_id", "perm", "order", "transform(order, (c, j) -> get(s, c) + if(j = 0, 0.05D, 0D)) as s")


@query("ag_perm_stability", with_("pred_raw") + f"""
, o AS (SELECT p.*, r.perm, row_number() OVER (PARTITION BY run, item_id, r.perm ORDER BY
          {X.rank_sql("'ps'", 'r.perm', 'item_id', 'pos')}) AS j FROM pred_raw p, (VALUES (0), (1), (2), (3)) r(perm)),
 q AS (SELECT *, s + CASE WHEN j = 1 THEN 0.05 ELSE 0 END AS sb FROM o),
 z AS (SELECT *, exp(s) / sum(exp(s)) OVER w AS p0, exp(sb) / sum(exp(sb)) OVER w AS p1 FROM q WINDOW w AS (PARTITION BY run, item_id, perm)),
 i AS (SELECT run, perm, item_id, max(abs(s - sb)) AS ds, max(abs(p0 - p1)) AS dp, sum(p0 * (ln(p0) - ln(p1))) AS klp,
        (arg_min(pos, (-s, pos)) <> arg_min(pos, (-sb, pos)))::INT AS flip, (arg_min(pos, (-sb, pos)) = arg_min(pos, (-t, pos)))::INT AS ag
       FROM z GROUP BY run, perm, item_id),
 r AS (SELECT run, perm, max(ds) AS ds, max(dp) AS dp, avg(klp) AS klp, avg(flip) AS flip, avg(ag) AS ag FROM i GROUP BY run, perm)
SELECT run, count(*) AS n_perm, round(max(ds), 6) AS max_score_diff, round(max(dp), 6) AS max_prob_diff, round(max(klp), 6) AS max_mean_kl,
  round(max(flip), 6) AS max_flip_rate, round(min(ag), 6) AS agree_min, round(max(ag), 6) AS agree_max FROM r GROUP BY run""")
def ag_perm_stability(spark, sf):
    return M.permutation_stability(*_perm_scores(spark, sf, 4))


ROBUST_SQL = with_("per_item", "var_item", "pred_raw") + """
, vset AS (SELECT run, item_id, list_sort(list(lab)) AS ls FROM var_raw GROUP BY run, item_id),
 oset AS (SELECT run, item_id, list_sort(list(lab)) AS ls FROM pred_raw GROUP BY run, item_id),
 vlab AS (SELECT v.run, v.item_id, r.lab FROM var_item v JOIN var_raw r ON r.run = v.run AND r.item_id = v.item_id AND r.pos = v.pred),
 olab AS (SELECT p.run, p.item_id, r.lab FROM per_item p JOIN pred_raw r ON r.run = p.run AND r.item_id = p.item_id AND r.pos = p.pred),
 j AS (SELECT v.run, v.variant, v.item_id, v.variant_of, (v.pred = v.tpred)::INT AS va, v.kl AS vk, (v.pred = v.gold)::INT AS vg,
        (p.pred = p.tpred)::INT AS oa, p.kl AS ok, vs.ls = os.ls AS same, (vl.lab = ol.lab)::INT AS pick
   FROM var_item v JOIN vset vs ON vs.run = v.run AND vs.item_id = v.item_id JOIN vlab vl ON vl.run = v.run AND vl.item_id = v.item_id
   LEFT JOIN per_item p ON p.run = v.run AND p.item_id = v.variant_of
   LEFT JOIN oset os ON os.run = v.run AND os.item_id = v.variant_of LEFT JOIN olab ol ON ol.run = v.run AND ol.item_id = v.variant_of)
"""


@query("ag_robust", ROBUST_SQL + """
SELECT run, variant, count(*) AS n, round(avg(va), 6) AS agreement, round(avg(vk), 6) AS kl, round(avg(vg), 6) AS gold_acc,
  count(oa) AS n_paired, round(avg(CASE WHEN oa IS NOT NULL THEN va END) - avg(oa), 6) AS delta_agreement,
  round(avg(CASE WHEN oa IS NOT NULL THEN vk END) - avg(ok), 6) AS delta_kl,
  round(avg(CASE WHEN same THEN pick END), 6) AS consistency, count(*) FILTER (same) AS n_consistency FROM j GROUP BY run, variant""")
def ag_robust(spark, sf):
    return M.robust_report(M.score_items(X.dec_variants(spark, sf)), scored(spark, sf))


@query("jn_variant_pair", ROBUST_SQL + """
SELECT run, variant, item_id, variant_of, va::INTEGER AS agree, oa::INTEGER AS base_agree, round(vk - ok, 6) AS delta_kl FROM j""")
def jn_variant_pair(spark, sf):
    v = M.score_items(X.dec_variants(spark, sf)).select(
        "run", "variant", "item_id", "variant_of", F.col("agree").cast("int").alias("agree"), F.col("kl").alias("vk"))
    o = scored(spark, sf).select("run", F.col("item_id").alias("variant_of"), F.col("agree").cast("int").alias("base_agree"), F.col("kl").alias("ok"))
    return v.join(o, ["run", "variant_of"], "left").select(
        "run", "variant", "item_id", "variant_of", "agree", "base_agree", R(F.col("vk") - F.col("ok"), "delta_kl"))


@query("st_same_candidates", ROBUST_SQL + """
SELECT variant, count(*) AS n, count(*) FILTER (same) AS n_same FROM j WHERE run = 'S' GROUP BY variant""")
def st_same_candidates(spark, sf):
    v = X.dec_variants(spark, sf).filter("run = 'S'").select("variant", "variant_of", F.array_sort(F.array_distinct("labs")).alias("a"))
    o = X.dec_preds(spark, sf).filter("run = 'S'").select(F.col("item_id").alias("variant_of"), F.array_sort(F.array_distinct("labs")).alias("b"))
    return v.join(o, "variant_of", "left").groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") == F.col("b")).alias("n_same"))


@query("jn_variant_meta", with_("item_attr") + """
SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'perm' WHEN 1 THEN 'ambiguous' ELSE 'irrelevant_ctx' END AS variant,
  CASE WHEN item_id % 2 = 0 THEN item_id - 1 WHEN item_id % 5 = 0 THEN item_id - 2 ELSE item_id - 3 END AS variant_of,
  CASE WHEN item_id % 2 = 0 THEN 'shard' WHEN item_id % 5 = 0 THEN 'store' ELSE 'document' END AS origin FROM item_attr""")
def jn_variant_meta(spark, sf):
    from decant.operators.store import variant_meta

    i = F.col("item_id")
    d = X.dec_items(spark, sf).select("item_id")
    kind = F.element_at(F.array(*map(F.lit, ("perm", "ambiguous", "irrelevant_ctx"))), (i % 3 + 1).cast("int"))
    meta = lambda cond, back: d.filter(cond).select("item_id", kind.alias("variant"), (i - back).alias("variant_of"))
    return variant_meta(d, [("shard", meta(i % 2 == 0, 1)), ("store", meta(i % 5 == 0, 2)), ("document", meta(i >= 0, 3))])


@query("ag_throughput", with_("runlog") + """
SELECT run, round(sum(n) / sum(dt), 6) AS items_per_s, round(sum(n * 16) / sum(dt), 6) AS tokens_per_s,
  round(sum(dt) / count(*) * 1000, 6) AS ms_per_batch FROM runlog WHERE step > 1 GROUP BY run""")
def ag_throughput(spark, sf):
    d = X.run_metrics(spark, sf)
    # the warm-up batch is the first per run: found by an aggregate, not by a per-run sort
    first = d.groupBy("run").agg(F.min(F.struct("at_us", "okey")).alias("w"))
    d = d.join(first, "run").filter(F.struct("at_us", "okey") > F.col("w"))
    return d.groupBy("run").agg(
        R(F.sum("n") / F.sum("dt"), "items_per_s"), R(F.sum(F.col("n") * 16) / F.sum("dt"), "tokens_per_s"),
        R(F.sum("dt") / F.count(F.lit(1)) * 1000, "ms_per_batch"))


@query("src_preds", with_("per_item") + """
SELECT run, split, count(*) AS n, round(avg(smax), 6) AS conf, round(avg(latency_ms), 6) AS latency FROM per_item GROUP BY run, split""")
def src_preds(spark, sf):
    from decant.session import scratch

    d = scored(spark, sf).select("run", "split", "item_id", "k", "ps", "pt", "gold", "latency_ms")
    path = scratch(spark, "preds")
    d.write.partitionBy("run", "split").parquet(path)
    return spark.read.parquet(path).groupBy("run", "split").agg(
        F.count(F.lit(1)).alias("n"), R(F.avg(F.array_max("ps")), "conf"), R(F.avg("latency_ms"), "latency"))


@query("ag_percentiles", with_("per_item") + """
SELECT run, count(*) AS n, round(avg(smax), 6) AS mean, round(quantile_cont(round(smax, 6), 0.5), 6) AS p50,
  round(quantile_cont(round(smax, 6), 0.95), 6) AS p95,
  list_sort(list(round(smax, 6)))[least(count(*) - 1, floor(0.95 * count(*))::BIGINT) + 1] AS p95_index
FROM per_item GROUP BY run""")
def ag_percentiles(spark, sf):
    from decant.operators.quantiles import quantiles

    d = scored(spark, sf).select("run", F.round("smax", 6).alias("v"), "smax")
    q = quantiles(d, ["run"], "v", {"p50": 0.5, "p95": 0.95}, {"p95_index": 0.95})
    m = d.groupBy("run").agg(F.count(F.lit(1)).alias("n"), R(F.avg("smax"), "mean"))
    return m.join(q, "run").select("run", "n", "mean", R("p50", "p50"), R("p95", "p95"), "p95_index")
