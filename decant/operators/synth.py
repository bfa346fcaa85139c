"""Template generator for decision items.

Every choice is a hash of (seed, salt, key), so an item is a projection of its key: a million items or a
hundred are the same narrow plan, any item can be rebuilt alone, and ``attempt`` in the key redraws it.
Phrase tables are small and built by rule from role words; callers may pass their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decant.functions import hashing as H
from decant.functions.text import q
from decant.operators.build import strings, weighted
from decant.operators.config import largest_remainder
from decant.operators.items import permute
from decant.operators.prefix import hash_bucket, id_bucket, prefix
from decant.session import materialise

# Category and language shares, candidate count weights, context length ranges, variant kinds.
CATEGORY_SHARES = {"nli": 20, "intent": 20, "state_action": 20, "ranking": 15, "sentiment": 10, "ambiguous": 10, "agent_gate": 5}
LANG_SHARES = {"ja": 60, "en": 40}
K_WEIGHTS = ((2, 0.10), (3, 0.35), (4, 0.30), (5, 0.25))
CONTEXT_RANGE = {"ja": (30, 200), "en": (25, 120)}
VARIANTS = ("perm", "cand_paraphrase", "ctx_paraphrase", "irrelevant_ctx", "ambiguous", "unseen_cand")

# Axes and their two opposed roles.
AXES = {
    "continue_stop": ("continue", "stop"), "answer_search": ("answer", "search"), "ask_act": ("ask", "act"), "remember_discard": ("remember", "discard"),
    "retrieve_skip": ("retrieve", "skip"), "safe_defer": ("safe_action", "defer"), "model_route": ("local", "larger"), "gate": ("speak", "silent"),
}
GATE_WEIGHTS = (("gate", 0.375), ("model_route", 0.25), ("safe_defer", 0.125), ("ask_act", 0.125), ("continue_stop", 0.125))
GATE_EXTRAS = ("speak", "silent", "larger", "local", "defer", "ask", "act")
TOOLS = ("calc", "calendar", "weather", "files", "translate", "websearch")
INTENTS = ("calendar", "reminder", "memo", "weather", "chat", "files", "settings", "translate")
POLARITY = ("positive", "negative", "neutral")
PRIORITY = ("urgent", "normal", "low")
RELATIONS = ("entailed", "contradicted", "undetermined")

# Own wording, one sentence per axis side: (en, ja) for side 0 and side 1.
AXIS_TEXT = {
    "continue_stop": (("Step {n} of the export finished without errors.", "書き出しの第{n}段階は問題なく終わった。"), ("The export broke {n} times on the same line.", "書き出しは同じ行で{n}回失敗した。")),
    "answer_search": (("The manual on page {n} holds the figure.", "説明書の{n}頁に数値が載っている。"), ("Nothing newer than {n} days is at hand.", "手元の資料は{n}日より古い。")),
    "ask_act": (("Two of {n} fields in the order are empty.", "注文の{n}項目のうち2つが空欄だ。"), ("All {n} fields in the order are filled in.", "注文の{n}項目はすべて埋まっている。")),
    "remember_discard": (("The user moves house in {n} weeks.", "利用者は{n}週間後に引っ越す。"), ("The user coughed {n} times during the call.", "利用者は通話中に{n}回せきをした。")),
    "retrieve_skip": (("They mean the plan from {n} weeks ago.", "{n}週間前の計画のことを言っている。"), ("They only said hello {n} seconds ago.", "{n}秒前に挨拶しただけだ。")),
    "safe_defer": (("A copy of all {n} files exists.", "{n}件すべての控えがある。"), ("None of the {n} files has a copy.", "{n}件のどれにも控えがない。")),
    "model_route": (("The note has {n} short words.", "メモは{n}語だけだ。"), ("The proof needs {n} linked lemmas.", "証明には{n}個の補題が要る。")),
    "gate": (("The alarm rings in {n} minutes.", "{n}分後に警報が鳴る。"), ("The user has been on a call for {n} minutes.", "利用者は{n}分間通話中だ。")),
}
TOOL_TEXT = {
    "calc": ("User: what is {n} times 7?", "利用者: {n}かける7は？"), "calendar": ("User: am I free in {n} days?", "利用者: {n}日後は空いている？"),
    "weather": ("User: will it rain in {n} hours?", "利用者: {n}時間後に雨は降る？"), "files": ("User: open report {n}", "利用者: 報告書{n}を開いて"),
    "translate": ("User: say page {n} in French", "利用者: {n}頁をフランス語にして"), "websearch": ("User: any news since {n} o'clock?", "利用者: {n}時以降の新着は？"),
    "none": ("User: thanks, that was number {n}", "利用者: ありがとう、{n}回目だね"),
}
NLI_TEXT = {
    # frame: premise, entailed, contradicted, undetermined
    "buy": (("Mika bought {n} red cups on Monday.", "Mika bought cups.", "Mika bought nothing.", "Mika paid by card."), ("美香は月曜に赤い茶わんを{n}個買った。", "美香は茶わんを買った。", "美香は何も買わなかった。", "美香はカードで払った。")),
    "visit": (("Ken spent {n} hours at the museum.", "Ken was at the museum.", "Ken never left home.", "Ken met a friend there."), ("健は博物館で{n}時間過ごした。", "健は博物館にいた。", "健は家を出なかった。", "健はそこで友人に会った。")),
    "send": (("Aya sent {n} letters to the bank.", "Aya wrote to the bank.", "Aya wrote to nobody.", "The bank replied."), ("彩は銀行へ手紙を{n}通送った。", "彩は銀行に手紙を書いた。", "彩は誰にも書かなかった。", "銀行は返事をした。")),
}
SENTIMENT_TEXT = {
    "positive": ("Order {n} came early and works well.", "注文{n}は早く届き、よく動く。"), "negative": ("Order {n} came late and is broken.", "注文{n}は遅れたうえ壊れていた。"), "neutral": ("Order {n} was logged at noon.", "注文{n}は正午に記録された。"),
    "urgent": ("Line {n} is down, act now.", "回線{n}が停止、今すぐ対応を。"), "normal": ("Please check line {n} this week.", "今週中に回線{n}を確認してください。"), "low": ("Look at line {n} whenever it suits you.", "手が空いたら回線{n}を見てください。"),
}
FILLERS = {
    "en": ("The desk lamp is on.", "A train passes outside.", "The kettle has just boiled.", "Two mugs stand by the sink.", "The calendar shows a new month.", "A window is half open.", "The printer hums quietly.",
           "Somebody waters the plants.", "The hallway light flickers.", "A coat hangs by the door.", "The clock ticks on the wall.", "Fresh paper lies on the shelf."),
    "ja": ("机の明かりがついている。", "外を電車が通る。", "湯が沸いたところだ。", "流しに湯飲みが二つある。", "暦は新しい月になった。", "窓が半分開いている。", "印刷機が静かに鳴る。", "誰かが鉢に水をやる。", "廊下の灯がちらつく。", "扉に上着がかかる。", "壁の時計が鳴る。", "棚に新しい紙がある。"),
}
NOUNS = ("Aster", "Birch", "Cedar", "Dahlia", "Elm", "Fern")
LEVELS = {"price": ("cheap", "fair", "dear"), "time": ("fast", "steady", "slow"), "rating": ("great", "decent", "poor")}
QUESTIONS = {
    "nli": ("Does this follow: {h}", "これは言えるか: {h}"), "intent": ("What is wanted?", "何を求めているか。"), "state": ("What should happen next?", "次に何をすべきか。"), "rank": ("Which one fits best?", "どれが最もよいか。"),
    "sent": ("How does it sound?", "どんな調子か。"), "prio": ("How pressing is it?", "どれほど急ぐか。"), "gate": ("Should the assistant speak up?", "声をかけるべきか。"), "vague": ("And so?", "それで？"),
}
# Wording by rule: tier -> wrappers around a role's words.
WRAPPERS = {"train": ("{r}", "choose: {r}"), "para": ("go for {r}", "best is {r}"), "unseen": ("the pick would be {r}", "leaning to {r}")}


def S(*salt: str) -> list[str]:
    return [*[q(s) for s in salt], "key"]


def U(*salt: str) -> str:
    return H.uniform_text(*S(*salt))


def I(*salt: str) -> str:  # noqa: E743
    return H.int_text(*S(*salt))


def by_lang(pair: Sequence[str]) -> str:
    """English or Japanese text with its number slot filled."""
    text = f"if(lang = 'en', {q(pair[0])}, {q(pair[1])})"
    return f"replace({text}, '{{n}}', cast(2 + {I('n')} % 97 as string))"


def table(entries: dict[str, Sequence[str]], pick: str) -> str:
    arms = " ".join(f"when {q(k)} then {by_lang(v)}" for k, v in entries.items())
    return f"case {pick} {arms} end"


def filler(*salt: str) -> str:
    return f"if(lang = 'en', {H.pick_text(strings(FILLERS['en']), *S(*salt))}, {H.pick_text(strings(FILLERS['ja']), *S(*salt))})"


def question(kind: str) -> str:
    return f"if(lang = 'en', {q(QUESTIONS[kind][0])}, {q(QUESTIONS[kind][1])})"


def spec(core: str, ask: str, roles: str, gold: str) -> str:
    return f"named_struct('core', {core}, 'question', {ask}, 'roles', {roles}, 'gold', cast({gold} as int))"


def tool_choice() -> str:
    """One of six tools is needed, or none; two to four tools are shown beside 'no tool'."""
    need = H.pick_text(strings([*TOOLS, "none", "none"]), *S("need"))
    n = f"cast(2 + {I('ntools')} % 3 as int)"
    others = H.shuffled_text(f"filter({strings(TOOLS)}, t -> t <> need)", *S("tools"))
    kinds = f"if(need = 'none', slice({others}, 1, {n}), concat(array(need), slice({others}, 1, {n} - 1)))"
    body = spec(f"array({table(TOOL_TEXT, 'need')})", question("state"), f"concat(transform({kinds}, t -> concat('tool ', t)), array('no tool'))", f"if(need = 'none', {n}, 0)")
    return f"element_at(transform(array({need}), need -> {body}), 1)"


def axis_text(side: str) -> str:
    flat = {f"{a}{i}": t[i] for a, t in AXIS_TEXT.items() for i in (0, 1)}
    return table(flat, f"concat(axis, {side})")


def axis_roles() -> str:
    return f"element_at(map({', '.join(f'{q(a)}, {strings(r)}' for a, r in AXES.items())}), axis)"


def state_action() -> str:
    """Two opposed roles with the axis side as gold; extra plausible roles, or a plain coin, remove the gold."""
    pool = strings([r for a in AXES.values() for r in a if r not in ("speak", "silent")])
    side = f"if({U('side')} < 0.5D, 0, 1)"
    extra = f"slice({H.shuffled_text(f'array_except({pool}, {axis_roles()})', *S('extra'))}, 1, cast(1 + {I('nextra')} % 3 as int))"
    more = f"{U('more')} < 0.3D"
    body = spec(f"array({axis_text(side)})", question("state"), f"if({more}, concat({axis_roles()}, {extra}), {axis_roles()})", f"if({more} or {U('nogold')} < 0.12D, null, {side})")
    normal = f"element_at(transform(array({H.pick_text(strings(list(AXES)), *S('axis'))}), axis -> {body}), 1)"
    return f"if({U('tool')} < 0.18D, {tool_choice()}, {normal})"


def agent_gate() -> str:
    """Weighted axes; gold kept for 70 %; a quarter gets one or two more roles and no gold."""
    side = f"if({U('side')} < 0.5D, 0, 1)"
    extra = f"slice({H.shuffled_text(f'array_except({strings(GATE_EXTRAS)}, {axis_roles()})', *S('extra'))}, 1, cast(1 + {I('nextra')} % 2 as int))"
    more = f"{U('more')} < 0.25D"
    body = spec(f"array({axis_text(side)})", question("gate"), f"if({more}, concat({axis_roles()}, {extra}), {axis_roles()})", f"if({more} or {U('keep')} >= 0.7D, null, {side})")
    return f"element_at(transform(array({weighted(U('axis'), GATE_WEIGHTS)}), axis -> {body}), 1)"


def nli() -> str:
    """Premise and hypothesis of a frame; a fifth are two-way and then never undetermined."""
    two = f"{U('two')} < 0.2D"
    label = f"if({two}, cast({I('lab')} % 2 as int), cast({I('lab')} % 3 as int))"
    frames = list(NLI_TEXT)
    frame = H.pick_text(strings(frames), *S("frame"))

    def part(i):
        return table({f: (NLI_TEXT[f][0][i], NLI_TEXT[f][1][i]) for f in frames}, frame)

    hyp = f"case lab when 0 then {part(1)} when 1 then {part(2)} else {part(3)} end"
    roles = f"if({two}, {strings(RELATIONS[:2])}, {strings(RELATIONS)})"
    core = f"if({U('back')} < 0.4D, array({part(0)}, {filler('back')}), array({part(0)}))"
    ask = f"replace({question('nli')}, '{{h}}', {hyp})"
    return f"element_at(transform(array({label}), lab -> {spec(core, ask, roles, 'lab')}), 1)"


def intent() -> str:
    """One utterance; other intents are distractors; three in ten start with a filler sentence."""
    want = H.pick_text(strings(INTENTS), *S("want"))
    k = weighted(U("k"), K_WEIGHTS)
    text = {i: (f"User: {i} request {{n}}, please", f"利用者: {i}の依頼{{n}}をお願い") for i in INTENTS}
    others = H.shuffled_text(f"filter({strings(INTENTS)}, x -> x <> want)", *S("others"))
    core = f"if({U('fill')} < 0.3D, array({filler('fill')}, {table(text, 'want')}), array({table(text, 'want')}))"
    body = spec(core, question("intent"), f"concat(array(want), slice({others}, 1, {k} - 1))", "0")
    return f"element_at(transform(array({want}), want -> {body}), 1)"


def _option(crit: str, gold: str) -> str:
    """Option text of noun number j: three attribute levels, the winner alone best on the asked one."""
    parts = []
    for a, words in LEVELS.items():
        draw = H.int_text(q(a), "key", "j")
        level = f"case when {crit} <> {q(a)} then {draw} % 3 when j = {gold} then 0 else 1 + {draw} % 2 end"
        parts.append(f"get({strings(words)}, cast({level} as int))")
    return f"concat(nouns[j], ': ', {', '.join(parts[:1])}, ', ', {parts[1]}, ', ', {parts[2]})"


def ranking(mixed: bool = False) -> str:
    """K options with three attributes. ``mixed`` asks for two conflicting criteria and has no gold."""
    k = f"greatest({weighted(U('k'), K_WEIGHTS)}, {3 if mixed else 2})"
    nouns = f"slice({H.shuffled_text(strings(NOUNS), *S('nouns'))}, 1, {k})"
    if mixed:
        p, t = LEVELS["price"], LEVELS["time"]
        lv = lambda w, a: f"case j when 0 then {q(w[0 if a == 'price' else 2])} when 1 then {q(w[2 if a == 'price' else 0])} else get({strings(w)}, cast(1 + {H.int_text(q(a), 'key', 'j')} % 2 as int)) end"
        opt = f"concat(nouns[j], ': ', {lv(p, 'price')}, ', ', {lv(t, 'time')}, ', ', {H.pick_text(strings(LEVELS['rating']), q('rating'), 'key', 'j')})"
        core, gold = by_lang(("The user wants it cheap and fast, request {n}.", "利用者は安さと早さの両方を望む。依頼{n}。")), "null"
    else:
        opt = _option("crit", "best")
        core = table({"price": ("The user wants the cheapest, request {n}.", "利用者は最安を望む。依頼{n}。"), "time": ("The user wants the fastest, request {n}.", "利用者は最速を望む。依頼{n}。"), "rating": ("The user wants the best rated, request {n}.", "利用者は高評価を望む。依頼{n}。")}, "crit")
        gold = "best"
    body = spec(f"array({core})", question("rank"), f"transform(sequence(0, size(nouns) - 1), j -> {opt})", gold)
    body = f"element_at(transform(array({nouns}), nouns -> element_at(transform(array(cast({I('best')} % size(nouns) as int)), best -> {body}), 1)), 1)"
    return body if mixed else f"element_at(transform(array({H.pick_text(strings(list(LEVELS)), *S('crit'))}), crit -> {body}), 1)"


def sentiment() -> str:
    """Polarity or priority; sometimes a role that is not gold is left out, but two always remain."""
    pol = f"{U('pol')} < 0.72D"
    roles = f"if({pol}, {strings(POLARITY)}, {strings(PRIORITY)})"
    kind = f"get({roles}, cast({I('kind')} % 3 as int))"
    dropped = H.pick_text(f"filter({roles}, r -> r <> kind)", *S("drop"))
    shown = f"if({U('cut')} < 0.15D, array_remove({roles}, {dropped}), {roles})"
    body = spec(f"array({table(SENTIMENT_TEXT, 'kind')})", f"if({pol}, {question('sent')}, {question('prio')})", shown, f"array_position({shown}, kind) - 1")
    return f"element_at(transform(array({kind}), kind -> {body}), 1)"


# Roles offered where nothing was observed.
QUIET_ROLES = ("wait", "look around", "ask back", "report", "hand over", "note it", "stay quiet", "check the log")


def ambiguous() -> str:
    """No gold: unclear reference, conflicting evidence, nothing observed, mixed feeling, mixed ranking."""
    u = U("amb")
    two = by_lang(("Two jobs are open: export {n} and import.", "作業は書き出し{n}と取り込みの二つ。"))
    vague = by_lang(("User: do that one", "利用者: それをやって"))
    refer = spec(f"array({two}, {vague})", question("state"), f"if({U('defer')} < 0.5D, array('ask', 'do export', 'do import', 'defer'), array('ask', 'do export', 'do import'))", "null")
    both = f"if({U('first')} < 0.5D, array({axis_text('0')}, {axis_text('1')}), array({axis_text('1')}, {axis_text('0')}))"
    conflict = f"element_at(transform(array({H.pick_text(strings(list(AXES)), *S('axis'))}), axis -> {spec(both, question('state'), axis_roles(), 'null')}), 1)"
    quiet = spec(f"array({by_lang(('Nothing has changed for {n} minutes.', '{n}分間なにも変わらない。'))})", question("gate"), f"slice({H.shuffled_text(strings(QUIET_ROLES), *S('pool'))}, 1, cast(3 + {I('npool')} % 3 as int))", "null")
    mixed = spec(f"array({table(SENTIMENT_TEXT, q('positive'))}, {table(SENTIMENT_TEXT, q('negative'))})", question("sent"), strings(POLARITY), "null")
    return f"case when {u} < 0.25D then {refer} when {u} < 0.6D then {conflict} when {u} < 0.7D then {quiet} when {u} < 0.85D then {mixed} else {ranking(mixed=True)} end"


BUILDERS = {"nli": nli, "intent": intent, "state_action": state_action, "ranking": ranking, "sentiment": sentiment, "ambiguous": ambiguous, "agent_gate": agent_gate}


# ---- plan, scenario, context, rendering ----------------------------------------------------

def plan(ids: DataFrame, ident: str = "idx", shares: dict[str, int] = CATEGORY_SHARES) -> DataFrame:
    """Exact category quotas (largest remainder) over rows in hash order; language by coin."""
    quota = largest_remainder(ids.count(), {k: float(v) for k, v in shares.items()})
    d = ids.withColumn("_h", H.rank_key("plan", F.col(ident)))
    d = prefix(d, ["_h"], hash_bucket("_h"))
    arms, edge = [], 0
    for c, n in quota.items():
        edge += n
        arms.append(f"when rn <= {edge} then '{c}'")
    lang = f"if({H.uniform_text(q('lang'), ident)} < {LANG_SHARES['ja'] / 100}D, 'ja', 'en')"
    d = d.selectExpr(*[c for c in ids.columns], f"case {' '.join(arms)} end as category", f"{lang} as lang")
    # rows are bare keys here, the projection that follows is heavy: spread the keys evenly before it
    return d.repartition(int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")), ident)


def scenarios(rows: DataFrame, only: str | None = None) -> DataFrame:
    """Rows (key, lang, category) to core sentences, question, roles and gold, with candidates shuffled."""
    if only:
        body = BUILDERS[only]()
    else:
        body = "case category " + " ".join(f"when '{c}' then {f()}" for c, f in BUILDERS.items()) + " end"
    d = rows.withColumn("s", F.expr(body)).selectExpr("* except (s)", "s.core", "s.question", "s.roles", "s.gold")
    return permute(d, f"transform(roles, (r, i) -> {H.rank_text(q('show'), 'key', 'i')})", ("roles",))


def fill_context(d: DataFrame) -> DataFrame:
    """Pad the core with fillers up to a log-uniform target length, in one of three layouts."""

    def per_lang(lang: str) -> tuple[str, str]:
        lo, hi = CONTEXT_RANGE[lang]
        target = f"cast(exp(ln({lo}) + {U('target')} * (ln({hi}) - ln({lo}))) as int)"
        return H.shuffled_text(strings(FILLERS[lang]), *S("fillers")), target

    (en, t_en), (ja, t_ja) = per_lang("en"), per_lang("ja")
    size = lambda x: f"if(lang = 'en', size(split({x}, ' ')), length({x}))"
    d = d.selectExpr("*", f"if(lang = 'en', {en}, {ja}) as pool", f"if(lang = 'en', {t_en}, {t_ja}) as target", f"aggregate(core, 0, (a, x) -> a + {size('x')}) as have", f"{U('layout')} as lay")
    step = f"if(a.n < target, named_struct('n', a.n + {size('f')}, 'l', array_append(a.l, f)), a)"
    d = d.withColumn("fill", F.expr(f"aggregate(pool, named_struct('n', have, 'l', cast(array() as array<string>)), (a, f) -> {step}, a -> a.l)"))
    mixed = (f"transform(array_sort(concat(transform(core, (c, i) -> struct((i + 1D) / (size(core) + 1) as p, c as t)), "
             f"transform(fill, f -> struct({H.uniform_text(q('at'), 'key', 'f')} as p, f as t)))), x -> x.t)")
    # options carry long texts, so ranking keeps its core at the end
    d = d.withColumn("sents", F.expr(f"case when category = 'ranking' or lay < 0.55D then concat(fill, core) when lay < 0.8D then concat(core, fill) else {mixed} end"))
    sep = rf"if({U('sep')} < 0.2D, '\n', if(lang = 'ja', '', ' '))"
    return d.selectExpr("* except (pool, target, have, lay)", f"array_join(sents, {sep}) as context")


def render(tier: str = "train", roles: str = "roles") -> str:
    """Candidate texts: role words in one of the tier's wrappings. Roles of an item differ, so texts do too."""
    wraps = strings(WRAPPERS[tier])
    return f"transform({roles}, r -> replace({H.pick_text(wraps, q('cand'), q(tier), 'key', 'r')}, '{{r}}', r))"


def generate(rows: DataFrame) -> DataFrame:
    d = fill_context(scenarios(rows))
    return d.selectExpr("* except (core, fill, sents)", f"{render()} as candidates")


def unique(ids: DataFrame, split: str, existing: DataFrame | None = None, ident: str = "idx", rounds: int = 200) -> DataFrame:
    """Items with no repeated (context, question, candidates): losers of a clash are drawn again.

    Only rows still without an item go into the next round. What a round won and left over is written, and the next
    round reads it back, so that its plan is as long as the first one's. ``existing`` holds hashes (column h) that
    are already taken. Hashes and winners grow with the items, so they are shuffled however small their files look: a table
    that is sent to every task passes through the driver.
    """
    spark, todo, won = ids.sparkSession, ids, []
    for attempt in range(rounds):
        d = generate(todo.withColumn("key", F.concat_ws(":", F.lit(split), F.col(ident).cast("string"), F.lit(str(attempt)))))
        d = materialise(d.withColumn("h", F.sha1(F.to_json(F.struct("context", "question", "candidates")))), "synth-round")
        first = d.groupBy("h").agg(F.min(ident).alias(ident))
        if existing is not None:
            first = first.join(existing.select("h").hint("merge"), "h", "left_anti")
        if won:
            first = first.join(spark.read.schema(won[0].schema).parquet(*[p for w in won for p in w.inputFiles()]).select("h").hint("merge"), "h", "left_anti")
        winners = materialise(first, "synth-winners")
        won.append(materialise(d.join(winners.select(ident).hint("merge"), ident, "left_semi"), "synth-won"))
        todo = materialise(todo.join(winners.select(ident).hint("merge"), ident, "left_anti"), "synth-todo")
        if todo.isEmpty():
            return spark.read.schema(won[0].schema).parquet(*[p for w in won for p in w.inputFiles()])
    raise RuntimeError("could not make every item unique")


# ---- perturbations -------------------------------------------------------------------------

def variants(items: DataFrame, paraphrase: tuple[str, str, str] = ("about {r}", "the theme is {r}", "And so?")) -> DataFrame:
    """Six perturbed copies of each item; ``perm`` is never the identity and gold follows it."""
    para, unseen, vague = paraphrase
    order = f"transform(array_sort(transform(sequence(0, size(candidates) - 1), p -> struct({H.rank_text(q('var'), 'item_id', 'p')} as h, p as p))), x -> x.p)"
    d = items.withColumn("o", F.expr(order)).withColumn(
        "o", F.expr("if(o = sequence(0, size(o) - 1), concat(sequence(1, size(o) - 1), array(0)), o)"))
    d = d.selectExpr("*", f"posexplode({strings(VARIANTS)}) as (variant_no, kind)")
    wrap = lambda t: f"transform(candidates, r -> replace({q(t)}, '{{r}}', r))"
    noise = H.pick_text(strings(FILLERS["en"]), q("noise"), "item_id")
    cands = f"case kind when 'perm' then transform(o, i -> candidates[i]) when 'cand_paraphrase' then {wrap(para)} when 'unseen_cand' then {wrap(unseen)} else candidates end"
    ctx = f"case kind when 'ctx_paraphrase' then concat('Note: ', context) when 'irrelevant_ctx' then concat(context, ' ', {noise}) else context end"
    return d.selectExpr(
        "item_id as variant_of", "variant_no", "kind as variant", "'robust' as split", f"{ctx} as context", f"if(kind = 'ambiguous', {q(vague)}, question) as question",
        f"{cands} as candidates", "cast(if(kind = 'perm' and gold is not null, array_position(o, gold) - 1, gold) as int) as gold")


def robust_pick(items: DataFrame, n: int, first_id: int) -> DataFrame:
    """``n`` hashed test items with their six variants; new ids follow on in (item, variant) order."""
    d = items.filter("split = 'test'").withColumn("_h", H.rank_key("robust", F.col("item_id")))
    base = prefix(d, ["_h"], hash_bucket("_h"), keep_below=("rn", n)).drop("_h", "rn")
    base = prefix(base, ["item_id"], id_bucket("item_id"), rank="b")
    v = variants(base.drop("b"))
    return v.join(base.select(F.col("item_id").alias("variant_of"), "b"), "variant_of").withColumn("item_id", F.lit(first_id) + (F.col("b") - 1) * len(VARIANTS) + F.col("variant_no")).drop("b", "variant_no")


# ---- token-feature teacher -----------------------------------------------------------------

ACTIVE, FEATURES, FIRST_TOKEN, SCALE = 60, 3, 5, 3.0
TEMPERATURES = (0.25, 0.6, 1.0, 1.0, 1.4)


def feature_table(name: str) -> str:
    from decant.operators.embed import gaussian_matrix

    m = gaussian_matrix(ACTIVE, FEATURES, name) * FEATURES ** 0.5
    return "array(" + ", ".join("array(" + ", ".join(f"{x!r}D" for x in map(float, r)) + ")" for r in m) + ")"


def fake_scores(ids: DataFrame, kmax: int = 5, gold_share: float = 0.7) -> DataFrame:
    """Items whose teacher is bilinear in token features: prefix vector times candidate vector, hashed temperature.

    Gold is drawn from the teacher's own softmax by a hash-uniform number against cumulative probabilities.
    """
    from decant.functions import dist as D

    tok = lambda *salt: f"cast({H.int_text(*salt)} % {ACTIVE} as int)"
    d = ids.withColumn("key", F.col("idx").cast("string")).selectExpr(
        "*", f"cast(2 + {I('k')} % {kmax - 1} as int) as k", f"cast(11 + {I('len')} % 30 as int) as n_prefix", f"get(array({', '.join(f'{t}D' for t in TEMPERATURES)}), cast({I('temp')} % {len(TEMPERATURES)} as int)) as temp")
    d = d.selectExpr("*", f"transform(sequence(1, n_prefix), i -> {tok(q('p'), 'key', 'i')}) as prefix",
                     f"transform(sequence(1, k), c -> transform(sequence(1, cast(1 + {H.int_text(q('cl'), 'key', 'c')} % 8 as int)), i -> {tok(q('c'), 'key', 'c', 'i')})) as cands")
    total = lambda arr, m, f: f"aggregate({arr}, 0D, (a, t) -> a + {m}[t][{f}]) / sqrt(size({arr}))"
    d = d.selectExpr("*", f"{feature_table('W')} as mw", f"{feature_table('U')} as mu")
    d = d.selectExpr("*", f"array({', '.join(total('prefix', 'mw', f) for f in range(FEATURES))}) as pv")
    dot = " + ".join(f"pv[{f}] * ({total('c', 'mu', f)})" for f in range(FEATURES))
    d = d.selectExpr("* except (mw, mu, pv)", f"transform(cands, c -> {SCALE}D * temp * ({dot}) / sqrt({FEATURES})) as t_logits")
    d = d.selectExpr("*", f"{D.softmax('t_logits')} as t_probs")
    below = "size(filter(sequence(1, k - 1), i -> aggregate(slice(t_probs, 1, i), 0D, (a, x) -> a + x) <= u))"
    d = d.selectExpr("*", f"{U('gold')} as u").selectExpr("* except (u)", f"if({U('has')} < {gold_share}D, {below}, null) as gold")
    return d.selectExpr("idx", "k", "temp", f"transform(prefix, t -> t + {FIRST_TOKEN}) as prefix", f"transform(cands, c -> transform(c, t -> t + {FIRST_TOKEN})) as cands", "t_logits", "t_probs", "gold")
