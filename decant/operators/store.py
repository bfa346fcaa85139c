"""The item / teacher / error tables: filters, joins, validation and upserts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decant.operators.config import PUBLIC, SPLITS
from decant.session import attach


def source_filter(sources: Sequence[str] | None, col: str = "source") -> Column:
    """Named sources OR-ed together; ``public`` means everything that is not synthetic; none means no filter."""
    if not sources:
        return F.lit(True)
    terms = [F.col(col) != "synth"] if PUBLIC in sources else []
    exact = [s for s in sources if s != PUBLIC]
    if exact:
        terms.append(F.col(col).isin(*exact))
    return reduce(lambda a, b: a | b, terms)


def split_rank(splits: Sequence[str] = SPLITS, col: str = "split") -> Column:
    c = F.lit(len(splits))
    for i, s in reversed(list(enumerate(splits))):
        c = F.when(F.col(col) == s, i).otherwise(c)
    return c


def item_problem(candidates: str = "candidates", gold: str = "gold") -> Column:
    """Reason an item is rejected, or null."""
    c, g = F.col(candidates), F.col(gold)
    return (
        F.when(c.isNull() | ~F.size(c).between(1, 16), "candidate count")
        .when(~F.forall(c, lambda x: F.coalesce(F.length(x) > 0, F.lit(False))), "empty candidate")
        .when(g.isNotNull() & ~((g >= 0) & (g < F.size(c))), "gold out of range")
    )


def distribution_problem(logits: str = "logits", probs: str = "probs") -> Column:
    """Reason a teacher row is rejected, or null."""
    finite = lambda a: F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    z, p = F.col(logits), F.col(probs)
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    return (
        F.when(z.isNull() | p.isNull() | (F.size(z) != F.size(p)) | (F.size(z) == 0), "length")
        .when(~(finite(z) & finite(p)), "not finite")
        .when(F.abs(total - 1.0) > 1e-4, "sum")
    )


def item_key(context="context", question="question", candidates="candidates") -> Column:
    """Duplicate key of an item."""
    return F.sha1(F.to_json(F.struct(context, question, candidates)))


def pending(
    items: DataFrame, teacher: DataFrame, errors: DataFrame, splits: Sequence[str] = SPLITS, max_attempts: int = 2,
    sources: Sequence[str] | None = None, exclude: DataFrame | None = None,
) -> DataFrame:
    """Items still to be scored; add ``orderBy(split_rank(...), 'item_id').limit(n)`` for the next batch."""
    d = items.filter(F.col("split").isin(*splits) & source_filter(sources))
    d = d.join(teacher.select("item_id"), "item_id", "left_anti")
    spent = errors.filter(F.col("attempts") >= max_attempts).select("item_id")
    d = d.join(spent, "item_id", "left_anti")
    return d.join(exclude.select("item_id"), "item_id", "left_anti") if exclude is not None else d


def next_batch(pend: DataFrame, n: int, splits: Sequence[str] = SPLITS) -> DataFrame:
    return pend.orderBy(split_rank(splits), "item_id").limit(n)


def upsert(old: DataFrame, new: DataFrame, key: str = "item_id", version: str = "created_at") -> DataFrame:
    """Newest row per key; of equally new rows the one from ``new``. Equal keys combine before the shuffle."""
    cols = old.columns
    both = old.select(*cols, F.lit(0).alias("_side")).unionByName(new.select(*cols, F.lit(1).alias("_side")))
    return both.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(version, "_side")).alias("r")).select("r.*")


def bad_distribution(probs: str = "probs") -> Column:
    """True where an array is no distribution: null, empty, negative or non-finite entries, or a sum off 1 by over 1e-4."""
    p = F.col(probs)
    entries = F.exists(p, lambda x: x.isNull() | F.isnan(x) | (x < 0) | (x == float("inf")))
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return F.coalesce((F.size(p) == 0) | entries | (F.abs(total - 1) > 1e-4), F.lit(True))


def record_scores(old: DataFrame, new: DataFrame, errors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scores after an update, errors that remain, and the new rows that were refused.

    A new row replaces its item's row and ends its item's error; a row without a proper distribution does neither.
    """
    judged = new.withColumn("_bad", bad_distribution())
    good = judged.filter(~F.col("_bad")).drop("_bad")
    return upsert(old, good), errors.join(good.select("item_id"), "item_id", "left_anti"), judged.filter("_bad").drop("_bad")


def upsert_errors(old: DataFrame, failures: DataFrame, clip: int = 500) -> DataFrame:
    """Add one attempt per failure row and keep the newest message."""
    f = failures.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("more"), F.max_by("error", "updated_at").alias("new_error"), F.max("updated_at").alias("at"))
    return old.join(f, "item_id", "full_outer").select(
        "item_id", (F.coalesce("attempts", F.lit(0)) + F.coalesce("more", F.lit(0))).cast("int").alias("attempts"),
        F.substring(F.coalesce("new_error", "error"), 1, clip).alias("error"), F.coalesce("at", "updated_at").alias("updated_at"))


def variant_meta(items: DataFrame, origins: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """(variant, variant_of) from the first origin that knows the item."""
    d = items
    for i, (name, meta) in enumerate(origins):
        d = d.join(meta.select("item_id", F.struct(F.lit(name).alias("origin"), "variant", "variant_of").alias(f"_m{i}")), "item_id", "left")
    d = d.withColumn("_m", F.coalesce(*[F.col(f"_m{i}") for i in range(len(origins))]))
    return d.filter("_m is not null").select("item_id", "_m.variant", "_m.variant_of", "_m.origin")


def quota_stages(items: DataFrame, scored: DataFrame, stages, pend: DataFrame, bucket: Column) -> DataFrame:
    """Rows each (split, cap, sources) stage may still take, first stage first."""
    from decant.operators.prefix import prefix

    out = None
    for n, (split, cap, sources) in enumerate(stages):
        cond = (F.col("split") == split) & source_filter(sources)
        d = pend.filter(cond).withColumn("stage", F.lit(n))
        if cap is not None:
            have = scored.filter(cond).agg((F.lit(cap) - F.count(F.lit(1))).alias("left"))
            d = attach(d, have)
            d = prefix(d, ["item_id"], bucket, keep_below=("rn", F.col("left"))).drop("rn", "left")
        out = d if out is None else out.unionByName(d)
    first = out.groupBy("item_id").agg(F.min("stage").alias("stage"))
    return first
