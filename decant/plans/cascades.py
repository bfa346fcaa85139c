"""Score aggregation and cascade queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from decant.operators import cascade as C
from decant.operators import metrics as M
from decant.operators import scoring as P
from decant.operators.config import parse_grid
from decant.plans import fixtures as X
from decant.plans.registry import cte, query, with_

NAMES = ("S", "M", "L")

cte("perm_fill", """
SELECT item_id, k, perm, cand_pos, coalesce(logprob, min(logprob) OVER (PARTITION BY item_id, perm) - 1.0) AS lp, logprob IS NULL AS filled
FROM perm_lp""", "perm_lp")


@query("ag_score_perms", with_("perm_fill") + """
, m AS (SELECT item_id, cand_pos, avg(lp) AS lp, sum(filled::INT) AS filled FROM perm_fill GROUP BY item_id, cand_pos),
 z AS (SELECT *, max(lp) OVER (PARTITION BY item_id) AS mx FROM m)
SELECT item_id, cand_pos::INTEGER AS cand_pos, round(lp - mx - ln(sum(exp(lp - mx)) OVER (PARTITION BY item_id)), 6) AS logit,
  round(exp(lp - mx) / sum(exp(lp - mx)) OVER (PARTITION BY item_id), 6) AS p, (sum(filled) OVER (PARTITION BY item_id))::INTEGER AS n_filled FROM z""")
def ag_score_perms(spark, sf):
    d = P.aggregate(P.per_order(X.dec_perm_logprobs(spark, sf))).filter("not failed")
    d = d.selectExpr("item_id", "n_filled", "posexplode(arrays_zip(logits, probs)) as (cand_pos, z)")
    return d.selectExpr("item_id", "cand_pos", "round(z.logits, 6) as logit", "round(z.probs, 6) as p", "n_filled")


@query("ag_order_consistency", with_("perm_fill") + """
, b AS (SELECT item_id, perm, arg_min(cand_pos, (-lp, cand_pos)) AS best FROM perm_fill GROUP BY item_id, perm)
SELECT count(*) AS n, round(avg(same), 6) AS consistency FROM (SELECT (count(DISTINCT best) = 1)::INT AS same FROM b GROUP BY item_id)""")
def ag_order_consistency(spark, sf):
    return P.order_consistency(P.per_order(X.dec_perm_logprobs(spark, sf)))


# ---- cascade -------------------------------------------------------------------------------

def stages(spark, sf):
    d = M.score_items(X.dec_preds(spark, sf))
    return d.select("run", "split", "item_id", "k", F.col("smax").alias("conf"), "agree", "gold_ok", "has_gold", "tgold_ok", "latency_ms")


def aligned(spark, sf):
    a = C.align(stages(spark, sf), NAMES)
    t = X.dec_teacher_keys(spark, sf).select("item_id", F.col("latency_ms").alias("t_lat"))
    return C.fill_latency(a.join(t, "item_id", "left"), ["split"], "t_lat")


cte("al", """
SELECT p.split, p.item_id, bool_or(gold IS NOT NULL) AS has_gold, coalesce(max((tpred = gold)::INT), 0) AS tg,
  max(CASE run WHEN 'S' THEN round(smax, 6) END) AS cs, max(CASE run WHEN 'M' THEN round(smax, 6) END) AS cm, max(CASE run WHEN 'L' THEN round(smax, 6) END) AS cl,
  max(CASE run WHEN 'S' THEN (pred = tpred)::INT END) AS a_s, max(CASE run WHEN 'M' THEN (pred = tpred)::INT END) AS a_m, max(CASE run WHEN 'L' THEN (pred = tpred)::INT END) AS a_l,
  coalesce(max(CASE run WHEN 'S' THEN (pred = gold)::INT END), 0) AS g_s, coalesce(max(CASE run WHEN 'M' THEN (pred = gold)::INT END), 0) AS g_m, coalesce(max(CASE run WHEN 'L' THEN (pred = gold)::INT END), 0) AS g_l,
  max(CASE run WHEN 'S' THEN latency_ms END) AS l_s, max(CASE run WHEN 'M' THEN latency_ms END) AS l_m, max(CASE run WHEN 'L' THEN latency_ms END) AS l_l
FROM per_item p GROUP BY p.split, p.item_id""", "per_item")
cte("al_t", """
SELECT al.*, coalesce(t.latency_ms, avg(t.latency_ms) OVER (PARTITION BY al.split)) AS t_lat FROM al LEFT JOIN (SELECT item_id, latency_ms FROM teacher_keys) t USING (item_id)""",
    "al", "teacher_keys")


@query("jn_stage_align", with_("per_item") + """
, p AS (SELECT * FROM per_item WHERE NOT (run = 'M' AND item_id % 50 = 3))
SELECT split, item_id, CASE WHEN count(DISTINCT run) < 3 THEN 'missing stage' ELSE 'candidate count' END AS problem
FROM (SELECT run, split, item_id, CASE WHEN run = 'L' AND item_id % 50 = 4 THEN k + 1 ELSE k END AS k FROM p) GROUP BY split, item_id HAVING count(DISTINCT run) < 3 OR min(k) <> max(k)""")
def jn_stage_align(spark, sf):
    s = stages(spark, sf).filter("not (run = 'M' and item_id % 50 = 3)")
    s = s.withColumn("k", F.expr("if(run = 'L' and item_id % 50 = 4, k + 1, k)"))
    return C.misaligned(C.align(s, NAMES), NAMES)


@query("jn_latency_fill", with_("item_attr", "teacher_keys") + """
SELECT i.item_id, i.split, round(coalesce(latency_ms, avg(latency_ms) OVER (PARTITION BY split)), 6) AS latency_ms, true AS known FROM item_attr i LEFT JOIN teacher_keys USING (item_id)""")
def jn_latency_fill(spark, sf):
    i = X.dec_items(spark, sf).select("item_id", "split")
    d = C.fill_latency(i.join(X.dec_teacher_keys(spark, sf), "item_id", "left"), ["split"])
    return d.select("item_id", "split", F.round("latency_ms", 6).alias("latency_ms"), "known")


@query("cs_evaluate", with_("al_t") + """
, w AS (SELECT *, cs >= 0.5 AS xs, NOT cs >= 0.5 AS rm, NOT cs >= 0.5 AND cm >= 0.45 AS xm, NOT cs >= 0.5 AND NOT cm >= 0.45 AS rl,
   NOT cs >= 0.5 AND NOT cm >= 0.45 AND cl >= 0.4 AS xl, NOT cs >= 0.5 AND NOT cm >= 0.45 AND NOT cl >= 0.4 AS esc FROM al_t),
 v AS (SELECT *, CASE WHEN xs THEN a_s WHEN xm THEN a_m WHEN xl THEN a_l ELSE 1 END AS fa, CASE WHEN xs THEN g_s WHEN xm THEN g_m WHEN xl THEN g_l ELSE tg END AS fg,
   l_s + CASE WHEN rm THEN l_m ELSE 0 END + CASE WHEN rl THEN l_l ELSE 0 END AS sl,
   (l_s * 49.0 + CASE WHEN rm THEN l_m * 19.0 ELSE 0 END + CASE WHEN rl THEN l_l * 30.0 ELSE 0 END + CASE WHEN esc THEN t_lat * 53.0 ELSE 0 END) / 1000.0 AS en FROM w)
SELECT split, count(*) AS n, count(*) FILTER (has_gold) AS n_gold, round(avg(CASE WHEN has_gold THEN fg END), 6) AS accuracy_gold, round(avg(fa), 6) AS agreement,
  round(avg(sl + CASE WHEN esc THEN t_lat ELSE 0 END), 6) AS mean_latency_ms, round(avg(sl), 6) AS mean_student_latency_ms, round(avg(esc::INT), 6) AS teacher_escalation,
  round(avg(en), 6) AS energy_j_estimate, 1.0::DOUBLE AS "reach_S", round(avg(xs::INT), 6) AS "accept_S", round(1 - count(*) FILTER (xs) / count(*), 6) AS "escalation_S", round(avg(CASE WHEN xs THEN a_s END), 6) AS "agreement_S",
  round(avg(rm::INT), 6) AS "reach_M", round(avg(xm::INT), 6) AS "accept_M", round(1 - count(*) FILTER (xm) / greatest(1, count(*) FILTER (rm)), 6) AS "escalation_M", round(avg(CASE WHEN xm THEN a_m END), 6) AS "agreement_M",
  round(avg(rl::INT), 6) AS "reach_L", round(avg(xl::INT), 6) AS "accept_L", round(1 - count(*) FILTER (xl) / greatest(1, count(*) FILTER (rl)), 6) AS "escalation_L", round(avg(CASE WHEN xl THEN a_l END), 6) AS "agreement_L"
FROM v GROUP BY split""")
def cs_evaluate(spark, sf):
    return C.evaluate(aligned(spark, sf), NAMES, (0.5, 0.45, 0.4))


@query("cs_single", with_("al_t") + """
SELECT split, stage, round(avg(CASE WHEN has_gold THEN g END), 6) AS accuracy_gold, round(avg(a), 6) AS agreement, round(avg(l), 6) AS mean_latency_ms, round(avg(w * l / 1000.0), 6) AS energy_j_estimate
FROM (SELECT split, has_gold, 'S' AS stage, g_s AS g, a_s AS a, l_s AS l, 49.0 AS w FROM al_t UNION ALL SELECT split, has_gold, 'M', g_m, a_m, l_m, 19.0 FROM al_t
  UNION ALL SELECT split, has_gold, 'L', g_l, a_l, l_l, 30.0 FROM al_t UNION ALL SELECT split, has_gold, 'teacher', tg, 1, t_lat, 53.0 FROM al_t) GROUP BY split, stage""")
def cs_single(spark, sf):
    return C.singles(aligned(spark, sf), NAMES)


@query("tk_tau_search", with_("al_t") + """
, g AS (SELECT unnest([0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1e6]::DOUBLE[]) AS t),
 d AS (SELECT * FROM al_t WHERE split = 'val'),
 c AS (SELECT s.t AS ts, m.t AS tm, l.t AS tl FROM g s, g m, g l),
 x AS (SELECT ts, tm, tl, ts < 1e6 AND cs >= ts AS xs, tm < 1e6 AND cm >= tm AS xm, tl < 1e6 AND cl >= tl AS xl, d.* FROM c, d),
 y AS (SELECT ts, tm, tl, CASE WHEN xs THEN a_s WHEN xm THEN a_m WHEN xl THEN a_l ELSE 1 END AS fa, (NOT xs AND NOT xm AND NOT xl) AS esc,
   CASE WHEN ts < 1e6 THEN l_s ELSE 0 END + CASE WHEN NOT xs AND tm < 1e6 THEN l_m ELSE 0 END + CASE WHEN NOT xs AND NOT xm AND tl < 1e6 THEN l_l ELSE 0 END
   + CASE WHEN NOT xs AND NOT xm AND NOT xl THEN t_lat ELSE 0 END AS lat FROM x)
SELECT nullif(ts, 1e6) AS "tau_S", nullif(tm, 1e6) AS "tau_M", nullif(tl, 1e6) AS "tau_L", round(avg(fa), 6) AS agreement, round(avg(esc::INT), 6) AS escalation,
  round(avg(lat), 6) AS mean_latency_ms, round(ts + tm + tl, 6) AS tau_sum FROM y GROUP BY ts, tm, tl HAVING avg(fa) + 1e-12 >= 0.9
ORDER BY avg(esc::INT), round(avg(lat), 6), tau_sum DESC, ts, tm, tl LIMIT 1""")
def tk_tau_search(spark, sf):
    a = aligned(spark, sf).filter("split = 'val'")
    d = C.search_thresholds(a, NAMES, parse_grid("0.2:0.9:0.1"), 0.1)
    return d.withColumns({"agreement": F.round("agreement", 6), "escalation": F.round("escalation", 6)})
