"""Item builders: raw rows to decision items, one projection per source; rows that do not convert are dropped.

Labels and phrases are small tables typed by the caller; they travel inside the expression, so a builder
never shuffles. Every random-looking choice is a hash of (seed, salt, key).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decant.functions import hashing as H
from decant.functions import text as T
from decant.functions.dist import let
from decant.operators.items import soft
from decant.operators.prefix import hash_bucket, prefix
from decant.session import attach

Phrases = Mapping[str, tuple[Sequence[str], Sequence[str]]]

# Pairs of opposite emotions and the thresholds of the vote rule.
EMOTIONS = ("joy", "sadness", "anticipation", "surprise", "anger", "fear", "disgust", "trust")
OPPOSITE = {"joy": "sadness", "sadness": "joy", "anticipation": "surprise", "surprise": "anticipation", "anger": "fear", "fear": "anger", "disgust": "trust", "trust": "disgust"}
WEAK_BELOW, TIE_GAP = 1.0, 0.34
# Candidate count weights, local threshold, share of large-model items.
K_WEIGHTS = ((3, 0.35), (4, 0.35), (5, 0.30))
LOCAL_MIN, LARGE_SHARE = 4, 0.45


def tier(split: str = "split") -> Column:
    """Phrase tier: 0 for training, 1 for every evaluation split."""
    return F.when(F.col(split) == "train", 0).otherwise(1)


def strings(values: Sequence[str]) -> str:
    return f"array({', '.join(T.q(v) for v in values)})"


def phrase_map(table: Phrases) -> str:
    return f"map({', '.join(f'{T.q(k)}, array({strings(a)}, {strings(b)})' for k, (a, b) in table.items())})"


def weighted(u: str, weights: Sequence[tuple[int | str, float]]) -> str:
    """Value picked by cumulative weight."""
    arms, edge = "", 0.0
    for v, w in weights[:-1]:
        edge = round(edge + w, 9)
        arms += f" when {u} < {edge}D then {T.q(v) if isinstance(v, str) else v}"
    last = weights[-1][0]
    return f"case{arms} else {T.q(last) if isinstance(last, str) else last} end"


def with_phrases(df: DataFrame, labels: str, gold: str, table: Phrases, key: str, wrapper: str | None = None) -> DataFrame:
    """Shuffle the labels, give each a phrase of the split's tier, and locate the gold label."""
    t = "if(split = 'train', 0, 1)"
    d = df.selectExpr("*", f"{H.shuffled_text(labels, repr('ord'), key)} as shown", f"{phrase_map(table)} as _ph")
    phrase = H.pick_text(f"get(element_at(_ph, l), {t})", "'ph'", key, "l")
    text = f"replace({wrapper}, '{{d}}', {phrase})" if wrapper else phrase
    return d.selectExpr("* except (_ph)", f"transform(shown, l -> {text}) as candidates", f"cast(nullif(array_position(shown, {gold}) - 1, -1) as int) as gold")


def item(df: DataFrame, source: str, key: str, category: str, lang: str = "'en'") -> DataFrame:
    """The common item record; ``df`` already has split, context, question, candidates, gold."""
    return df.selectExpr(
        f"cast({key} as string) as key", "split", f"'{category}' as category", f"{lang} as lang", "context", "question", "candidates", "gold",
        "cast(null as bigint) as variant_of", "cast(null as string) as variant", f"{H.int_text(T.q(source), key)} % 2147483648 as gen_seed", f"'{source}' as source")


def choice5(df: DataFrame, key: str, questions: Sequence[str]) -> DataFrame:
    """Five given choices, all present and different."""
    d = df.selectExpr("*", f"array({', '.join(T.strip(f'choice{i}') for i in range(5))}) as candidates")
    ok = "trim(question_text) <> '' and size(array_distinct(candidates)) = 5 and forall(candidates, c -> c <> '') and label between 0 and 4"
    d = d.filter(ok).selectExpr("*", f"{T.sanitize('question_text')} as context", f"{H.pick_text(strings(questions), repr('q'), key)} as question", "label as gold")
    return item(d, "choice", key, "commonsense")


def relation(df: DataFrame, key: str, table: Phrases, questions: Sequence[str]) -> DataFrame:
    """Two or three relation labels by coin; the question quotes the hypothesis as {h}."""
    names = strings(list(table))
    others = f"filter({names}, x -> x <> label)"
    labels = f"if({H.uniform_text(repr('coin'), key)} < 0.5D, concat(array(label), {others}), array(label, {H.pick_text(others, repr('other'), key)}))"
    d = df.filter(f"premise <> '' and hypothesis <> '' and array_contains({names}, label)")
    d = with_phrases(d.selectExpr("*", f"{labels} as labels"), "labels", "label", table, key)
    d = d.selectExpr("*", f"{T.sanitize('premise')} as context", f"replace({H.pick_text(strings(questions), repr('q'), key)}, '{{h}}', hypothesis) as question")
    return item(d, "relation", key, "nli")


def hard_negatives(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Gold label plus negatives: at least one of the same group when there is one, the rest from other groups.

    ``dim`` is the label table (name, grp): one row per label the task has, so it travels as one array.
    """
    one = dim.groupBy().agg(F.sort_array(F.collect_list(F.struct("name", "grp"))).alias("dim"))
    d = attach(df, one).selectExpr("*", f"{weighted(H.uniform_text(repr('k'), key), K_WEIGHTS)} as k")
    same = "transform(filter(dim, x -> x.grp = grp and x.name <> gold_name), x -> x.name)"
    rest = "transform(filter(dim, x -> x.grp <> grp), x -> x.name)"
    d = d.selectExpr("*", f"slice({H.shuffled_text(same, repr('same'), key)}, 1, cast(1 + {H.int_text(repr('n'), key)} % (k - 1) as int)) as near")
    d = d.selectExpr("*", f"slice({H.shuffled_text(rest, repr('rest'), key)}, 1, k - 1 - size(near)) as far")
    return d.selectExpr("* except (dim, near, far)", "concat(array(gold_name), near, far) as labels")


def emotion_labels(df: DataFrame, key: str, votes: str = "votes") -> DataFrame:
    """Gold emotion and shown labels from eight intensities.

    Weak votes make 'none' the gold label; a tie at the top leaves gold null and shows the tied labels; else
    the opposite emotion is the hard negative. ``soft`` keeps the votes as a distribution.
    """
    names, opp = strings(EMOTIONS), f"map({', '.join(f'{T.q(a)}, {T.q(b)}' for a, b in OPPOSITE.items())})"
    ranked = (f"transform(array_sort(transform({votes}, (v, i) -> struct(-v as nv, {H.rank_text(repr('tie'), key, 'i')} as h, {names}[i] as e, v as v))), s -> struct(s.e as e, s.v as v))")
    d = df.selectExpr("*", f"{ranked} as r", f"{weighted(H.uniform_text(repr('k'), key), K_WEIGHTS)} as k", f"{soft(votes)} as soft")
    d = d.selectExpr("*", "r[0].v as top", f"if(r[0].v - r[1].v < {TIE_GAP}D, transform(filter(r, x -> x.v >= r[0].v - 1e-9D), x -> x.e), cast(array() as array<string>)) as tied")
    d = d.selectExpr("*", f"case when top < {WEAK_BELOW}D then 'none' when size(tied) >= 2 then null else r[0].e end as gold_label")
    start = f"case when top < {WEAK_BELOW}D then array('none') when size(tied) >= 2 then slice(tied, 1, k) else array(r[0].e, element_at({opp}, r[0].e)) end"
    d = d.selectExpr("*", f"{start} as base")
    d = d.selectExpr("* except (base)", f"if(size(base) < k and not array_contains(base, 'none') and top >= {WEAK_BELOW}D and {H.uniform_text(repr('none'), key)} < 0.3D, array_append(base, 'none'), base) as base")
    fill = "slice(filter(transform(r, x -> x.e), e -> not array_contains(base, e)), 1, greatest(k - size(base), 0))"
    return d.selectExpr("* except (base, r, tied)", f"concat(base, {fill}) as labels")


def pair_preference(df: DataFrame, key: str, questions: Sequence[str]) -> DataFrame:
    """Chosen against rejected answer in hashed order; equal answers are dropped."""
    d = df.selectExpr("*", f"{T.clip(T.sanitize('chosen'), 240)} as c", f"{T.clip(T.sanitize('rejected'), 240)} as r").filter("c <> r and c <> '' and r <> '' and request <> ''")
    d = d.selectExpr("*", f"{H.uniform_text(repr('order'), key)} < 0.5D as first")
    d = d.selectExpr("*", "if(first, array(c, r), array(r, c)) as candidates", "if(first, 0, 1) as gold", f"{T.sanitize('request')} as context",
                     f"{H.pick_text(strings(questions), repr('q'), key)} as question")
    return item(d, "pref", key, "agent_gate")


ANSWER_KEYS = ("direct", "tool_call", "request_for_info", "cannot_answer")


def keyed_choice(df: DataFrame, key: str, questions: Sequence[str]) -> DataFrame:
    """Four keyed answers; sometimes one wrong answer is dropped; shuffled and required to differ."""
    d = df.filter(f"correct in ({', '.join(map(T.q, ANSWER_KEYS))}) and " + " and ".join(f"{k} <> ''" for k in ANSWER_KEYS))
    wrong = f"filter({strings(ANSWER_KEYS)}, x -> not x <=> correct)"
    gone = f"if({H.uniform_text(repr('drop'), key)} < 0.3D, {H.pick_text(wrong, repr('which'), key)}, '')"
    text = {k: T.clip(T.sanitize(T.toolcall(k) if k == "tool_call" else k), 240) for k in ANSWER_KEYS}
    answers = f"array({', '.join(f'struct({T.q(k)} as k, {v} as t)' for k, v in text.items())})"
    d = d.selectExpr("*", f"{let(gone, lambda g: f'filter({answers}, a -> a.k <> {g})')} as _kept")
    # whether answers differ does not hang on their order; bound, as a filter is pushed below and repeats what it names
    d = d.filter(let("transform(_kept, a -> a.t)", lambda t: f"size(array_distinct({t})) = size({t})"))
    d = d.selectExpr("* except (_kept)", f"transform(array_sort(transform(_kept, a -> struct({H.rank_text(repr('ord'), key, 'a.k')} as h, a.k as k, a.t as t))), s -> struct(s.k as k, s.t as t)) as _shown")
    d = d.selectExpr("* except (_shown)", "_shown.t as candidates", "cast(array_position(_shown.k, correct) - 1 as int) as gold", f"{T.sanitize('request')} as context",
                     f"{H.pick_text(strings(questions), repr('q'), key)} as question")
    return item(d, "mcq", key, "agent_gate")


def route(df: DataFrame, key: str, table: Phrases, questions: Sequence[str]) -> DataFrame:
    """Small model or large model, from a score threshold."""
    d = df.selectExpr("*", f"{T.clip(T.sanitize('prompt'), 700, 200)} as context", f"if(score >= {LOCAL_MIN}, 'local', 'large') as label").filter("length(context) >= 3")
    d = with_phrases(d, "array('local', 'large')", "label", table, key)
    return item(d.selectExpr("*", f"{H.pick_text(strings(questions), repr('q'), key)} as question"), "route", key, "routing")


# ---- sampling and splits -------------------------------------------------------------------

def sample_refill(converted: DataFrame, key: str, cap: int, tag: str, group: Sequence[str] = ()) -> DataFrame:
    """The first ``cap`` converted rows in hash order. Rows that did not convert are gone already, so nothing needs refilling."""
    d = converted.withColumn("_h", F.expr(H.rank_text(T.q(tag), key)))
    return prefix(d, ["_h"], hash_bucket("_h"), group, keep_below=("rn", cap)).drop("_h", "rn")


def stratified(df: DataFrame, key: str, stratum: str, caps: Mapping[str, int], tag: str) -> DataFrame:
    """A cap per stratum; strata without a cap take no part."""
    lim = df.sparkSession.createDataFrame(list(caps.items()), f"{stratum} string, cap long")
    d = df.join(F.broadcast(lim), stratum).withColumn("_h", F.expr(H.rank_text(T.q(tag), key)))
    return prefix(d, ["_h"], hash_bucket("_h"), [stratum], keep_below=("rn", F.col("cap"))).drop("_h", "rn", "cap")


def group_table(df: DataFrame, group: str, need_val: int, need_test: int) -> DataFrame:
    """One row per group: size, rows of the groups before it in hash order, and the split that follows from them."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    sizes = sizes.withColumn("_h", H.rank_key("group", F.col(group)))
    sizes = prefix(sizes, ["_h"], hash_bucket("_h"), rank=None, sums={"before": "size"})
    val_total = sizes.filter(F.col("before") < need_val).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("v"))
    s = attach(sizes, val_total)
    split = F.when(F.col("before") < need_val, "val").when(F.col("before") - F.col("v") < need_test, "test").otherwise("train")
    return s.withColumn("split", split).drop("v", "_h")


def group_split(df: DataFrame, group: str, need_val: int, need_test: int) -> DataFrame:
    """Whole groups go to val until it is full, then to test, the rest to train, in hash order of the groups."""
    return df.join(group_table(df, group, need_val, need_test).select(group, "split"), group)


def balanced_split(df: DataFrame, key: str, dedupe: str, cls: str, file: str, quota: Mapping[str, Sequence[tuple[str, int, int]]]) -> DataFrame:
    """Drop repeated prompts (lowest file and key first), then give each split its share of either class.

    ``quota[file]`` lists (split, rows of class 0, rows of class 1); splits of one file never overlap.
    """
    cols = df.columns
    first = df.groupBy(F.sha2(dedupe, 256).alias("_d")).agg(F.min_by(F.struct(*cols), F.struct(file, key)).alias("r")).select("r.*")
    d = first.withColumn("_h", H.rank_key("balance", F.col(file), F.col(key)))
    d = prefix(d, ["_h"], hash_bucket("_h"), [file, cls])
    split = F.lit(None).cast("string")
    for f, parts in quota.items():
        edge = [0, 0]
        for name, *sizes in parts:
            hit = [(F.col(cls) == c) & (F.col("rn") > edge[c]) & (F.col("rn") <= edge[c] + sizes[c]) for c in (0, 1)]
            split = F.when((F.col(file) == f) & (hit[0] | hit[1]), name).otherwise(split)
            edge = [edge[c] + sizes[c] for c in (0, 1)]
    return d.withColumn("split", split).filter("split is not null").select(*cols, "split")


def assign_ids(items: DataFrame, existing: DataFrame, first_id: int, order: Sequence[str] = ("source", "key")) -> DataFrame:
    """Drop duplicates of stored or earlier items, then number train, val, test without gaps, sources mixed by hash."""
    ident = F.sha1(F.to_json(F.struct("context", "question", "candidates")))
    cols = items.columns
    d = items.withColumn("_k", ident).groupBy("_k").agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("r"))
    d = d.join(existing.select(ident.alias("_k")), "_k", "left_anti").select("r.*")
    rank = reduce(lambda acc, s: F.when(F.col("split") == s[1], s[0]).otherwise(acc), [(2, "test"), (1, "val"), (0, "train")], F.lit(3))
    d = d.withColumns({"_s": rank, "_h": H.rank_key("order", F.col("split"), *[F.col(c) for c in order])})
    d = prefix(d, ["_s", "_h"], F.col("_s") * 4096 + hash_bucket("_h"), rank="item_id")
    return d.withColumn("item_id", F.col("item_id") + (first_id - 1)).drop("_s", "_h")
