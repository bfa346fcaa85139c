"""Evaluation of a student's scores against the teacher's, item by item and aggregated."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decant.functions import dist as D

UNCERTAIN = 0.6
CONFIDENT = 0.85


def score_items(preds: DataFrame, w_kd: str | float = D.W_KD_GOLD, w_ce: str | float = D.W_CE_GOLD) -> DataFrame:
    """Add the per-item evaluation columns to rows holding score arrays ``s`` and ``t``.

    One projection chain, no shuffle: every aggregate below reads these columns.
    """
    d = preds.selectExpr("*", f"{D.softmax('s')} as ps", f"{D.softmax('t')} as pt")
    d = d.selectExpr(
        "*", f"{D.argmax('s')} as pred", f"{D.argmax('t')} as tpred", "gold is not null as has_gold",
        f"{D.kl('pt', 'ps')} as kl", f"{D.kd_term('s', 't')} as kd", f"{D.nll('ps', 'gold')} as ce", f"{D.nll('pt', 'gold')} as tce",
        f"{D.squared_distance('ps', 'pt')} as bt", f"{D.brier('ps', 'gold')} as bs", f"{D.brier('pt', 'gold')} as tbs",
        f"{D.entropy('ps')} as hs", f"{D.entropy('pt')} as ht", "array_max(ps) as smax", "array_max(pt) as tmax")
    return d.selectExpr(
        "*", "pred = tpred as agree", "pred = gold as gold_ok", "tpred = gold as tgold_ok",
        f"{D.composite('kd', 'ce', 'has_gold', w_kd, w_ce)} as loss",
        "hs / ln(greatest(k, 2)) as nhs", "ht / ln(greatest(k, 2)) as nht", "k >= 2 as multi")


def _b(c: str) -> Column:
    return F.col(c).cast("double")


def core_aggregates(digits: int = 6) -> list[Column]:
    """Aggregate columns of the core metric block, one pass over ``score_items`` output."""
    inv_k = F.lit(1.0) / F.col("k")
    cols = {
        "mean_k": F.avg("k"), "random_baseline": F.avg(inv_k),
        "random_baseline_gold": F.avg(F.when(F.col("has_gold"), inv_k)),
        "agreement": F.avg(_b("agree")), "agreement_minus_random": F.avg(_b("agree")) - F.avg(inv_k),
        "kl": F.avg("kl"), "val_loss": F.avg("loss"), "kd_loss": F.avg("kd"), "ce_loss": F.avg("ce"),
        "brier_vs_teacher": F.avg("bt"), "gold_acc": F.avg(_b("gold_ok")), "teacher_gold_acc": F.avg(_b("tgold_ok")),
        "nll_gold": F.avg("ce"), "teacher_nll_gold": F.avg("tce"), "brier": F.avg("bs"), "teacher_brier": F.avg("tbs"),
    }
    return [
        F.count(F.lit(1)).alias("n"), F.count_if("has_gold").alias("n_gold"),
        *[F.round(c, digits).alias(n) for n, c in cols.items()],
    ]


def core_metrics(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    return items.groupBy(*keys).agg(*core_aggregates())


def by_source(items: DataFrame, keys: Sequence[str], source: str = "source") -> DataFrame:
    """Core metrics per source below ``keys``; key groups with a single source are left out."""
    per = items.groupBy(*keys, source).agg(*core_aggregates())
    many = per.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_sources")).filter("n_sources >= 2").drop("n_sources")
    return per.join(many, list(keys), "left_semi")


def calibration_bins(items: DataFrame, keys: Sequence[str], conf: str, correct: str, bins: int = D.ECE_BINS) -> DataFrame:
    """Bin counts: at most ``bins`` rows per key group leave the map side."""
    return (
        items.filter(F.col(correct).isNotNull())
        .groupBy(*keys, F.expr(D.ece_bin(f"round({conf}, 9)", bins)).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(conf)).alias("conf_sum"), F.sum(_b(correct)).alias("ok_sum"))
    )


def ece(items: DataFrame, keys: Sequence[str], conf: str, correct: str, bins: int = D.ECE_BINS) -> DataFrame:
    b = calibration_bins(items, keys, conf, correct, bins)
    gap = F.abs(F.col("ok_sum") - F.col("conf_sum"))
    return b.groupBy(*keys).agg(F.sum("n").alias("n"), F.round(F.sum(gap) / F.sum("n"), 6).alias("ece"))


def reliability(items: DataFrame, keys: Sequence[str], conf: str, correct: str, bins: int = D.ECE_BINS) -> DataFrame:
    """Reliability table with every bin present; empty bins have n = 0 and null means."""
    b = calibration_bins(items, keys, conf, correct, bins)
    grid = b.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(b, [*keys, "bin"], "left").select(
        *keys, "bin", F.coalesce("n", F.lit(0)).alias("n"),
        F.round(F.col("conf_sum") / F.col("n"), 6).alias("conf"), F.round(F.col("ok_sum") / F.col("n"), 6).alias("acc"),
    )


def entropy_block(items: DataFrame, keys: Sequence[str], uncertain: float = UNCERTAIN, confident: float = CONFIDENT) -> DataFrame:
    nht, nhs, smax = (F.round(F.col(c), 9) for c in ("nht", "nhs", "smax"))
    unc = F.col("multi") & (nht >= uncertain)
    both = unc & (smax >= confident)
    conf_unc = F.col("multi") & (nht < 1 - uncertain) & (nhs >= uncertain)
    m = lambda c: F.when(F.col("multi"), F.col(c))
    r = lambda c, n: F.round(c, 6).alias(n)
    return items.groupBy(*keys).agg(
        r(F.avg("hs"), "student_entropy"), r(F.avg("ht"), "teacher_entropy"),
        r(F.avg(m("nhs")), "student_norm_entropy"), r(F.avg(m("nht")), "teacher_norm_entropy"),
        r(F.avg("smax"), "student_maxprob"), r(F.avg("tmax"), "teacher_maxprob"),
        r(F.corr(m("hs"), m("ht")), "entropy_pearson"),
        F.count_if(unc).alias("teacher_uncertain_n"), F.count_if(both).alias("uncertain_confident_n"),
        r(F.count_if(both) / F.greatest(F.lit(1), F.count_if(unc)), "uncertain_confident_frac"),
        F.count_if(conf_unc).alias("confident_uncertain_n"),
    )


def position_bias(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of predictions, teacher choices and gold labels at each position, and their distance."""
    long = items.select(
        *keys,
        F.explode(F.array(
            F.struct(F.lit("s").alias("who"), F.col("pred").alias("pos")),
            F.struct(F.lit("t").alias("who"), F.col("tpred").alias("pos")),
            F.struct(F.lit("g").alias("who"), F.col("gold").alias("pos")),
        )).alias("x"),
    ).filter("x.pos is not null")
    cnt = long.groupBy(*keys, F.col("x.pos").alias("pos")).agg(
        *[F.count_if(F.col("x.who") == w).alias(w) for w in ("s", "t", "g")]
    )
    tot = cnt.groupBy(*keys).agg(*[F.sum(w).alias(f"n_{w}") for w in ("s", "t", "g")])
    d = cnt.join(tot, list(keys)).select(*keys, "pos", *[(F.col(w) / F.col(f"n_{w}")).alias(w) for w in ("s", "t", "g")])
    tv = d.groupBy(*keys).agg(F.round(F.sum(F.abs(F.col("s") - F.col("t"))) / 2, 6).alias("tv_student_teacher"))
    return d.join(tv, list(keys)).select(
        *keys, "pos", F.round("s", 6).alias("student"), F.round("t", 6).alias("teacher"), F.round("g", 6).alias("gold"),
        "tv_student_teacher",
    )


def permutation_stability(base: DataFrame, permuted: DataFrame) -> DataFrame:
    """Compare re-scored permutations with the identity order.

    ``permuted`` holds (run, item_id, perm, order, s): ``order[j]`` is the candidate shown at position j.
    Scores are mapped back to candidate order before anything is compared.
    """
    back = "transform(sequence(0, size(order) - 1), c -> get(s, cast(array_position(order, c) - 1 as int))) as sb"
    j = base.select("run", "item_id", "s", "t").join(permuted.selectExpr("run", "item_id", "perm", back), ["run", "item_id"])
    j = j.selectExpr("*", f"{D.softmax('s')} as p0", f"{D.softmax('sb')} as p1")
    diff = lambda a, b: f"array_max({D.zipped(a, b, lambda x, y: f'abs({x} - {y})')})"
    j = j.selectExpr(
        "run", "perm", f"{diff('s', 'sb')} as ds", f"{diff('p0', 'p1')} as dp", f"{D.kl('p0', 'p1')} as klp",
        f"double({D.argmax('s')} <> {D.argmax('sb')}) as flip", f"double({D.argmax('sb')} = {D.argmax('t')}) as ag")
    per = j.groupBy("run", "perm").agg(
        F.max("ds").alias("ds"), F.max("dp").alias("dp"), F.avg("klp").alias("klp"), F.avg("flip").alias("flip"), F.avg("ag").alias("ag"),
    )
    r = lambda c, n: F.round(c, 6).alias(n)
    return per.groupBy("run").agg(
        F.count(F.lit(1)).alias("n_perm"), r(F.max("ds"), "max_score_diff"), r(F.max("dp"), "max_prob_diff"),
        r(F.max("klp"), "max_mean_kl"), r(F.max("flip"), "max_flip_rate"), r(F.min("ag"), "agree_min"), r(F.max("ag"), "agree_max"),
    )


def robust_report(variants: DataFrame, originals: DataFrame) -> DataFrame:
    """Perturbed items next to their originals. Items without an original still count in ``n``.

    Both inputs are ``score_items`` output with candidate labels in ``labs``.
    """
    v = variants.select(
        "run", "variant", F.col("variant_of").alias("oid"), _b("agree").alias("va"), F.col("kl").alias("vk"), _b("gold_ok").alias("vg"),
        F.array_sort("labs").alias("vset"), F.get("labs", F.col("pred")).alias("vpick"),
    )
    o = originals.select(
        "run", F.col("item_id").alias("oid"), _b("agree").alias("oa"), F.col("kl").alias("ok"),
        F.array_sort("labs").alias("oset"), F.get("labs", F.col("pred")).alias("opick"),
    )
    j = v.join(o, ["run", "oid"], "left")
    paired = F.col("oa").isNotNull()
    same = paired & (F.col("vset") == F.col("oset"))
    r = lambda c, n: F.round(c, 6).alias(n)
    pair = lambda c: F.avg(F.when(paired, F.col(c)))
    return j.groupBy("run", "variant").agg(
        F.count(F.lit(1)).alias("n"), r(F.avg("va"), "agreement"), r(F.avg("vk"), "kl"), r(F.avg("vg"), "gold_acc"),
        F.count_if(paired).alias("n_paired"), r(pair("va") - F.avg("oa"), "delta_agreement"), r(pair("vk") - F.avg("ok"), "delta_kl"),
        r(F.avg(F.when(same, (F.col("vpick") == F.col("opick")).cast("double"))), "consistency"), F.count_if(same).alias("n_consistency"),
    )


def spearman(a: str, b: str) -> str:
    """Rank correlation of two aligned short arrays; ties share their mean rank."""

    def ranks(v: str) -> str:
        return D.mapped(v, lambda x: f"size(filter({v}, y -> y < {x})) + (size(filter({v}, y -> y = {x})) + 1) / 2D")

    mid = f"(size({a}) + 1) / 2D"
    cov = lambda p, q: D.total(D.zipped(p, q, lambda x, y: f"({x} - {mid}) * ({y} - {mid})"))
    return D.let(ranks(a), lambda ra: D.let(ranks(b), lambda rb: f"{cov(ra, rb)} / nullif(sqrt({cov(ra, ra)} * {cov(rb, rb)}), 0D)"))
