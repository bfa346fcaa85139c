"""Synthetic generator queries; item numbers come from the customer table, so work grows with it."""

from __future__ import annotations

from pyspark.sql import functions as F

from decant.functions import hashing as H
from decant.operators import synth as Y
from decant.plans import fixtures as X
from decant.plans.registry import query, table, with_

CAND = "array_join(candidates, '|') as candidates"


def ids(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("idx"))


def keyed(d, split="train"):
    return d.withColumn("key", F.concat_ws(":", F.lit(split), F.col("idx").cast("string"), F.lit("0")))


QUOTA_SQL = "(VALUES " + ", ".join(f"('{c}', {i}, {s})" for i, (c, s) in enumerate(Y.CATEGORY_SHARES.items())) + ") c(category, ord, share)"


@query("syn_plan", f"""
WITH n AS (SELECT count(*) AS n FROM customer),
 qt AS (SELECT category, ord, n * share // 100 AS base, n * share % 100 AS rest, n FROM n, {QUOTA_SQL}),
 r AS (SELECT *, n - sum(base) OVER () AS spare, row_number() OVER (ORDER BY rest DESC, category) AS rk FROM qt),
 e AS (SELECT category, sum(base + CASE WHEN rk <= spare THEN 1 ELSE 0 END) OVER (ORDER BY ord) AS hi, sum(base + CASE WHEN rk <= spare THEN 1 ELSE 0 END) OVER (ORDER BY ord) - base - CASE WHEN rk <= spare THEN 1 ELSE 0 END AS lo FROM r),
 p AS (SELECT c_custkey AS idx, row_number() OVER (ORDER BY {X.rank_sql("'plan'", 'c_custkey')}) AS rn FROM customer)
SELECT idx, category, CASE WHEN {X.unif_sql("'lang'", 'idx')} < 0.6 THEN 'ja' ELSE 'en' END AS lang FROM p JOIN e ON rn > lo AND rn <= hi""")
def syn_plan(spark, sf):
    return Y.plan(ids(spark, sf))


def one_category(cat):
    def build(spark, sf):
        d = keyed(ids(spark, sf)).withColumns({"category": F.lit(cat), "lang": F.expr(f"if({H.uniform_text(repr('lang'), 'idx')} < 0.6D, 'ja', 'en')")})
        d = Y.scenarios(d, only=cat)
        return d.selectExpr("idx", "lang", "size(roles) as k", "gold", r"array_join(core, ' ') as core", "question", "array_join(roles, '|') as roles")
    return build


# ---- SQL twins of the category builders ----------------------------------------------------

def qs(x):
    return "'" + x.replace("'", "''") + "'"


def ls(xs):
    return "[" + ", ".join(qs(x) for x in xs) + "]"


def i_sql(*salt):
    return f"('0x' || substr({X.rank_sql(*[qs(x) for x in salt], 'key')}, 1, 8))::BIGINT"


def u_sql(*salt):
    return X.unif_sql(*[qs(x) for x in salt], "key")


def pick_sql(xs, *salt):
    return f"({xs})[{i_sql(*salt)} % len({xs}) + 1]"


def shuf_sql(xs, *salt):
    return f"list_transform(list_sort(list_transform({xs}, lambda e: {{'h': {X.rank_sql(*[qs(x) for x in salt], 'key', 'e')}, 'e': e}})), lambda s: s.e)"


def lang_sql(pair):
    return f"replace(CASE WHEN lang = 'en' THEN {qs(pair[0])} ELSE {qs(pair[1])} END, '{{n}}', (2 + {i_sql('n')} % 97)::VARCHAR)"


def case_sql(on, entries):
    return f"CASE {on} " + " ".join(f"WHEN {qs(k)} THEN {lang_sql(v)}" for k, v in entries.items()) + " END"


def filler_sql(salt):
    return f"CASE WHEN lang = 'en' THEN {pick_sql(ls(Y.FILLERS['en']), salt)} ELSE {pick_sql(ls(Y.FILLERS['ja']), salt)} END"


def ask_sql(kind):
    return f"CASE WHEN lang = 'en' THEN {qs(Y.QUESTIONS[kind][0])} ELSE {qs(Y.QUESTIONS[kind][1])} END"


K_SQL = f"CASE WHEN {u_sql('k')} < 0.1 THEN 2 WHEN {u_sql('k')} < 0.45 THEN 3 WHEN {u_sql('k')} < 0.75 THEN 4 ELSE 5 END"
BASE_SQL = f"WITH b AS (SELECT c_custkey AS idx, 'train:' || c_custkey || ':0' AS key, CASE WHEN {X.unif_sql(repr('lang'), 'c_custkey')} < 0.6 THEN 'ja' ELSE 'en' END AS lang FROM customer)"


def shown_sql(body):
    """Shuffle the roles of ``d(idx, key, lang, core, question, roles, gold)`` and move gold along."""
    return f"""{BASE_SQL}, {body},
 o AS (SELECT *, list_transform(list_sort(list_transform(range(0, len(roles)), lambda i: {{'h': {X.rank_sql("'show'", 'key', 'i')}, 'i': i}})), lambda s: s.i) AS ord FROM d)
SELECT idx, lang, len(roles)::INTEGER AS k, (list_position(ord, gold) - 1)::INTEGER AS gold, array_to_string(core, ' ') AS core, question, array_to_string(list_transform(ord, lambda i: roles[i + 1]), '|') AS roles FROM o"""


def tool_sql(src):
    return f"""t0 AS (SELECT *, {pick_sql(ls([*Y.TOOLS, 'none', 'none']), 'need')} AS need, 2 + {i_sql('ntools')} % 3 AS nt FROM {src}),
 t1 AS (SELECT *, {shuf_sql(f"list_filter({ls(Y.TOOLS)}, lambda t: t <> need)", 'tools')} AS others FROM t0),
 tool AS (SELECT idx, key, lang, [{case_sql('need', Y.TOOL_TEXT)}] AS core, {ask_sql('state')} AS question, list_append(list_transform(CASE WHEN need = 'none' THEN others[1:nt] ELSE list_concat([need], others[1:nt - 1]) END, lambda t: 'tool ' || t), 'no tool') AS roles,
   CASE WHEN need = 'none' THEN nt ELSE 0 END AS gold FROM t1)"""

INTENT_SQL = shown_sql(f"""w AS (SELECT *, {pick_sql(ls(Y.INTENTS), 'want')} AS want, {K_SQL} AS k FROM b),
 x AS (SELECT *, CASE WHEN lang = 'en' THEN 'User: ' || want || ' request ' || (2 + {i_sql('n')} % 97) || ', please' ELSE '利用者: ' || want || 'の依頼' || (2 + {i_sql('n')} % 97) || 'をお願い' END AS said FROM w),
 d AS (SELECT *, CASE WHEN {u_sql('fill')} < 0.3 THEN [{filler_sql('fill')}, said] ELSE [said] END AS core, {ask_sql('intent')} AS question,
   list_concat([want], ({shuf_sql(f"list_filter({ls(Y.INTENTS)}, lambda x: x <> want)", 'others')})[1:k - 1]) AS roles, 0 AS gold FROM x)""")

SENTIMENT_SQL = shown_sql(f"""r AS (SELECT *, CASE WHEN {u_sql('pol')} < 0.72 THEN {ls(Y.POLARITY)} ELSE {ls(Y.PRIORITY)} END AS rs FROM b),
 x AS (SELECT *, rs[{i_sql('kind')} % 3 + 1] AS kind FROM r), y AS (SELECT *, list_filter(rs, lambda e: e <> kind) AS wrong FROM x),
 z AS (SELECT *, CASE WHEN {u_sql('cut')} < 0.15 THEN list_filter(rs, lambda e: e <> wrong[{i_sql('drop')} % 2 + 1]) ELSE rs END AS roles FROM y),
 d AS (SELECT *, [{case_sql('kind', Y.SENTIMENT_TEXT)}] AS core, CASE WHEN {u_sql('pol')} < 0.72 THEN {ask_sql('sent')} ELSE {ask_sql('prio')} END AS question, list_position(roles, kind) - 1 AS gold FROM z)""")


def nli_part(i):
    return case_sql("frame", {f: (t[0][i], t[1][i]) for f, t in Y.NLI_TEXT.items()})


NLI_SQL = shown_sql(f"""f AS (SELECT *, {pick_sql(ls(list(Y.NLI_TEXT)), 'frame')} AS frame, {u_sql('two')} < 0.2 AS two FROM b),
 l AS (SELECT *, CASE WHEN two THEN {i_sql('lab')} % 2 ELSE {i_sql('lab')} % 3 END AS gold FROM f),
 d AS (SELECT *, CASE WHEN {u_sql('back')} < 0.4 THEN [{nli_part(0)}, {filler_sql('back')}] ELSE [{nli_part(0)}] END AS core,
   replace({ask_sql('nli')}, '{{h}}', CASE gold WHEN 0 THEN {nli_part(1)} WHEN 1 THEN {nli_part(2)} ELSE {nli_part(3)} END) AS question, CASE WHEN two THEN {ls(Y.RELATIONS[:2])} ELSE {ls(Y.RELATIONS)} END AS roles FROM l)""")

AXIS_CASE = "CASE axis " + " ".join(f"WHEN {qs(a)} THEN {ls(r)}" for a, r in Y.AXES.items()) + " END"
AXIS_SAID = case_sql("(axis || side)", {f"{a}{i}": t[i] for a, t in Y.AXIS_TEXT.items() for i in (0, 1)})
GATE_AXIS = f"CASE WHEN {u_sql('axis')} < 0.375 THEN 'gate' WHEN {u_sql('axis')} < 0.625 THEN 'model_route' WHEN {u_sql('axis')} < 0.75 THEN 'safe_defer' WHEN {u_sql('axis')} < 0.875 THEN 'ask_act' ELSE 'continue_stop' END"
SIDE = f"CASE WHEN {u_sql('side')} < 0.5 THEN 0 ELSE 1 END"


def axis_sql(axis, pool, more, most, ask, no_gold):
    """Items of one axis: two roles, sometimes more roles and then no gold."""
    return f"""ax AS (SELECT *, {axis} AS axis, {SIDE} AS side, {u_sql('more')} < {more} AS more FROM b), ay AS (SELECT *, {AXIS_CASE} AS two FROM ax),
 az AS (SELECT *, CASE WHEN more THEN list_concat(two, ({shuf_sql(f"list_filter({ls(pool)}, lambda r: NOT list_contains(two, r))", 'extra')})[1:1 + {i_sql('nextra')} % {most}]) ELSE two END AS roles FROM ay),
 axis_d AS (SELECT idx, key, lang, [{AXIS_SAID}] AS core, {ask_sql(ask)} AS question, roles, CASE WHEN more OR {no_gold} THEN NULL ELSE side END AS gold FROM az)"""


GATE_SQL = shown_sql(axis_sql(GATE_AXIS, Y.GATE_EXTRAS, 0.25, 2, "gate", f"{u_sql('keep')} >= 0.7") + ", d AS (SELECT * FROM axis_d)")
ACTION_POOL = [r for rs in Y.AXES.values() for r in rs if r not in ("speak", "silent")]
ACTION_SQL = shown_sql(tool_sql("b") + ", " + axis_sql(pick_sql(ls(list(Y.AXES)), "axis"), ACTION_POOL, 0.3, 3, "state", f"{u_sql('nogold')} < 0.12")
                       + f", d AS (SELECT * FROM tool WHERE {u_sql('tool')} < 0.18 UNION ALL SELECT * FROM axis_d WHERE NOT {u_sql('tool')} < 0.18)")


def level_sql(attr, words):
    draw = f"('0x' || substr({X.rank_sql(qs(attr), 'key', 'j')}, 1, 8))::BIGINT"
    return f"({ls(words)})[CASE WHEN crit <> {qs(attr)} THEN {draw} % 3 WHEN j = gold THEN 0 ELSE 1 + {draw} % 2 END + 1]"


CRIT_TEXT = {"price": ("The user wants the cheapest, request {n}.", "利用者は最安を望む。依頼{n}。"), "time": ("The user wants the fastest, request {n}.", "利用者は最速を望む。依頼{n}。"), "rating": ("The user wants the best rated, request {n}.", "利用者は高評価を望む。依頼{n}。")}
RANK_SQL = shown_sql(f"""n AS (SELECT *, {pick_sql(ls(list(Y.LEVELS)), 'crit')} AS crit, ({shuf_sql(ls(Y.NOUNS), 'nouns')})[1:{K_SQL}] AS nouns FROM b),
 g AS (SELECT *, {i_sql('best')} % len(nouns) AS gold FROM n),
 d AS (SELECT *, [{case_sql('crit', CRIT_TEXT)}] AS core, {ask_sql('rank')} AS question, list_transform(range(0, len(nouns)), lambda j: nouns[j + 1] || ': ' || {level_sql('price', Y.LEVELS['price'])} || ', ' || {level_sql('time', Y.LEVELS['time'])} || ', ' || {level_sql('rating', Y.LEVELS['rating'])}) AS roles FROM g)""")

QUIET_POOL = Y.QUIET_ROLES


def mixed_level(attr, first, second):
    words = Y.LEVELS[attr]
    draw = f"('0x' || substr({X.rank_sql(qs(attr), 'key', 'j')}, 1, 8))::BIGINT"
    if attr == "rating":
        return f"({ls(words)})[{draw} % 3 + 1]"
    return f"CASE j WHEN 0 THEN {qs(words[first])} WHEN 1 THEN {qs(words[second])} ELSE ({ls(words)})[1 + {draw} % 2 + 1] END"


AMB_U = u_sql("amb")
AMBIGUOUS_SQL = shown_sql(f"""ax AS (SELECT *, {pick_sql(ls(list(Y.AXES)), 'axis')} AS axis, ({shuf_sql(ls(Y.NOUNS), 'nouns')})[1:greatest({K_SQL}, 3)] AS nouns FROM b),
 s0 AS (SELECT *, 0 AS side FROM ax), s1 AS (SELECT key, {AXIS_SAID} AS one FROM (SELECT *, 1 AS side FROM ax)), s AS (SELECT s0.*, {AXIS_SAID} AS zero, s1.one FROM s0 JOIN s1 USING (key)),
 d AS (SELECT idx, key, lang, NULL::BIGINT AS gold,
  CASE WHEN {AMB_U} < 0.25 THEN [{lang_sql(('Two jobs are open: export {n} and import.', '作業は書き出し{n}と取り込みの二つ。'))}, {lang_sql(('User: do that one', '利用者: それをやって'))}]
   WHEN {AMB_U} < 0.6 THEN CASE WHEN {u_sql('first')} < 0.5 THEN [zero, one] ELSE [one, zero] END WHEN {AMB_U} < 0.7 THEN [{lang_sql(('Nothing has changed for {n} minutes.', '{n}分間なにも変わらない。'))}]
   WHEN {AMB_U} < 0.85 THEN [{case_sql("'positive'", Y.SENTIMENT_TEXT)}, {case_sql("'negative'", Y.SENTIMENT_TEXT)}] ELSE [{lang_sql(('The user wants it cheap and fast, request {n}.', '利用者は安さと早さの両方を望む。依頼{n}。'))}] END AS core,
  CASE WHEN {AMB_U} < 0.6 THEN {ask_sql('state')} WHEN {AMB_U} < 0.7 THEN {ask_sql('gate')} WHEN {AMB_U} < 0.85 THEN {ask_sql('sent')} ELSE {ask_sql('rank')} END AS question,
  CASE WHEN {AMB_U} < 0.25 THEN CASE WHEN {u_sql('defer')} < 0.5 THEN ['ask', 'do export', 'do import', 'defer'] ELSE ['ask', 'do export', 'do import'] END WHEN {AMB_U} < 0.6 THEN {AXIS_CASE}
   WHEN {AMB_U} < 0.7 THEN ({shuf_sql(ls(QUIET_POOL), 'pool')})[1:3 + {i_sql('npool')} % 3] WHEN {AMB_U} < 0.85 THEN {ls(Y.POLARITY)}
   ELSE list_transform(range(0, len(nouns)), lambda j: nouns[j + 1] || ': ' || {mixed_level('price', 0, 2)} || ', ' || {mixed_level('time', 2, 0)} || ', ' || {mixed_level('rating', 0, 0)}) END AS roles FROM s)""")

TWINS = {"state_action": ACTION_SQL, "agent_gate": GATE_SQL, "nli": NLI_SQL, "intent": INTENT_SQL, "ranking": RANK_SQL, "sentiment": SENTIMENT_SQL, "ambiguous": AMBIGUOUS_SQL}
for _c, _sql in TWINS.items():
    query(f"syn_{_c}", _sql)(one_category(_c))


@query("syn_tool_choice", "WITH e AS (SELECT c_custkey AS idx, 'train:' || c_custkey || ':0' AS key, 'en' AS lang FROM customer), " + tool_sql("e") + " SELECT idx, core[1] AS core, array_to_string(roles, '|') AS roles, gold::INTEGER AS gold FROM tool")
def syn_tool_choice(spark, sf):
    d = keyed(ids(spark, sf)).withColumn("lang", F.lit("en")).withColumn("s", F.expr(Y.tool_choice()))
    return d.selectExpr("idx", "s.core[0] as core", "array_join(s.roles, '|') as roles", "s.gold")


@query("syn_scenario")
def syn_scenario(spark, sf):
    d = Y.generate(keyed(Y.plan(ids(spark, sf))))
    return d.selectExpr("idx", "category", "lang", "context", "question", CAND, "gold")


@query("syn_render_cands")
def syn_render_cands(spark, sf):
    d = Y.scenarios(keyed(Y.plan(ids(spark, sf))))
    return d.selectExpr("idx", "category", *[f"array_join({Y.render(t)}, '|') as {t}" for t in ("train", "para", "unseen")])


@query("syn_fill_context")
def syn_fill_context(spark, sf):
    d = Y.fill_context(Y.scenarios(keyed(Y.plan(ids(spark, sf)))))
    return d.selectExpr("idx", "category", "lang", "size(fill) as n_fill", "size(sents) as n_sents", "context")


@query("syn_unique")
def syn_unique(spark, sf):
    d = Y.unique(Y.plan(ids(spark, sf)), "train")
    return d.selectExpr("idx", "category", "lang", "h", "gold")


@query("syn_append")
def syn_append(spark, sf):
    plan = Y.plan(ids(spark, sf))
    have = Y.unique(plan.filter("idx % 3 <> 0"), "train")
    more = Y.unique(plan.filter("idx % 3 = 0").withColumn("idx", F.col("idx") + 1000000000), "train", existing=have.select("h"))
    old = have.select("h", F.lit(True).alias("old")).hint("merge")
    return more.select("idx", "category", "h").join(old, "h", "left").select("idx", "category", "h", F.col("old").isNotNull().alias("clash"))


VAR_SQL = f"""
, o AS (SELECT item_id, pos, gold, k, candidates, context, question, split, row_number() OVER (PARTITION BY item_id ORDER BY {X.rank_sql("'var'", 'item_id', 'pos')}) - 1 AS np FROM item_pos JOIN item_attr USING (item_id, k)),
 idn AS (SELECT item_id, bool_and(pos = np) AS same FROM o GROUP BY item_id),
 pr AS (SELECT o.item_id, list(candidates[pos + 1] ORDER BY CASE WHEN same THEN (pos - 1 + o.k) % o.k ELSE np END) AS cp, max(CASE WHEN pos = gold THEN CASE WHEN same THEN (pos - 1 + o.k) % o.k ELSE np END END)::INTEGER AS gp FROM o JOIN idn USING (item_id) GROUP BY o.item_id),
 v AS (SELECT i.item_id AS variant_of, w.n AS variant_no, w.variant, i.split AS base_split,
   CASE w.n WHEN 2 THEN 'Note: ' || i.context WHEN 3 THEN i.context || ' ' || ({list(Y.FILLERS['en'])!r})[('0x' || substr({X.rank_sql("'noise'", 'i.item_id')}, 1, 8))::BIGINT % 12 + 1] ELSE i.context END AS context,
   CASE w.n WHEN 4 THEN 'And so?' ELSE i.question END AS question,
   array_to_string(CASE w.n WHEN 0 THEN pr.cp WHEN 1 THEN list_transform(i.candidates, lambda r: 'about ' || r) WHEN 5 THEN list_transform(i.candidates, lambda r: 'the theme is ' || r) ELSE i.candidates END, '|') AS candidates,
   CASE w.n WHEN 0 THEN pr.gp ELSE i.gold END AS gold
  FROM (SELECT * FROM item_attr) i JOIN pr USING (item_id), (VALUES {', '.join(f"({n}, '{v}')" for n, v in enumerate(Y.VARIANTS))}) w(n, variant))
"""


@query("syn_variants", with_("item_pos", "item_attr") + VAR_SQL + "SELECT variant_of, variant, context, question, candidates, gold FROM v")
def syn_variants(spark, sf):
    return Y.variants(X.dec_items(spark, sf)).selectExpr("variant_of", "variant", "context", "question", CAND, "gold")


@query("syn_robust_pick", with_("item_pos", "item_attr") + VAR_SQL + f"""
, b AS (SELECT item_id, row_number() OVER (ORDER BY item_id) AS b FROM (SELECT item_id, row_number() OVER (ORDER BY {X.rank_sql("'robust'", 'item_id')}) AS rn FROM item_attr WHERE split = 'test') WHERE rn <= 40)
SELECT 100000 + (b - 1) * 6 + variant_no AS item_id, variant_of, variant, candidates FROM v JOIN b ON b.item_id = v.variant_of""")
def syn_robust_pick(spark, sf):
    return Y.robust_pick(X.dec_items(spark, sf), 40, 100000).selectExpr("item_id", "variant_of", "variant", CAND)


def matrix_sql(name):
    from decant.operators.embed import gaussian_matrix

    m = gaussian_matrix(Y.ACTIVE, Y.FEATURES, name) * Y.FEATURES ** 0.5
    return "[" + ", ".join("[" + ", ".join(f"{float(x)!r}" for x in r) + "]" for r in m) + "]::DOUBLE[][]"


def tok_sql(*parts):
    return f"('0x' || substr({X.rank_sql(*parts)}, 1, 8))::BIGINT % {Y.ACTIVE}"


@query("syn_fake_scores", f"""
WITH b AS (SELECT c_custkey AS idx, c_custkey::VARCHAR AS key FROM customer), m AS (SELECT {matrix_sql('W')} AS w, {matrix_sql('U')} AS u),
 p AS (SELECT *, 2 + {i_sql('k')} % 4 AS k, 11 + {i_sql('len')} % 30 AS n, ([{', '.join(map(str, Y.TEMPERATURES))}]::DOUBLE[])[{i_sql('temp')} % 5 + 1] AS temp FROM b),
 t AS (SELECT p.*, f, (SELECT sum(m.w[x + 1][f]) FROM (SELECT unnest(list_transform(range(1, n + 1), lambda i: {tok_sql("'p'", 'key', 'i')})) AS x)) / sqrt(n) AS pv FROM p, m, (SELECT unnest([1, 2, 3]) AS f)),
 c AS (SELECT idx, key, k, n, temp, c, 1 + ('0x' || substr({X.rank_sql("'cl'", 'key', 'c')}, 1, 8))::BIGINT % 8 AS cl FROM (SELECT *, unnest(range(1, k + 1)) AS c FROM p)),
 v AS (SELECT c.*, f, (SELECT sum(m.u[x + 1][f]) FROM (SELECT unnest(list_transform(range(1, cl + 1), lambda i: {tok_sql("'c'", 'key', 'c', 'i')})) AS x)) / sqrt(cl) AS cv FROM c, m, (SELECT unnest([1, 2, 3]) AS f)),
 l AS (SELECT v.idx, v.key, v.c, any_value(v.k) AS k, any_value(v.n) AS n, any_value(v.temp) AS temp, 3.0 * any_value(v.temp) * sum(pv * cv) / sqrt(3) AS z FROM v JOIN t ON t.idx = v.idx AND t.f = v.f GROUP BY v.idx, v.key, v.c),
 q AS (SELECT *, exp(z - max(z) OVER w) AS e FROM l WINDOW w AS (PARTITION BY idx)),
 r AS (SELECT *, sum(e) OVER (PARTITION BY idx ORDER BY c) / sum(e) OVER (PARTITION BY idx) AS cum FROM q)
SELECT idx, any_value(k)::INTEGER AS k, any_value(temp) AS temp, any_value(n)::INTEGER AS prefix_len, round(max(z), 6) AS top_logit, round(min(z), 6) AS low_logit,
  CASE WHEN {u_sql('has')} < 0.7 THEN count(*) FILTER (c < k AND cum <= {u_sql('gold')}) END::INTEGER AS gold FROM r GROUP BY idx, key""")
def syn_fake_scores(spark, sf):
    d = Y.fake_scores(ids(spark, sf))
    return d.selectExpr("idx", "k", "temp", "size(prefix) as prefix_len", "round(array_max(t_logits), 6) as top_logit", "round(array_min(t_logits), 6) as low_logit", "gold")
