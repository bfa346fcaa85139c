"""Mixing sources to target weights by repetition rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decant.functions.hashing import hex_int
from decant.llm.common import join_checked, word_count
from decant.session import materialise

#: Hex digits of the draw: 52 bits, exact in a double.
DIGITS = 13


def targets(sizes: DataFrame, source: str = "source", size: str = "size", weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source: its size and its target.

    Sources in code-point order, null last, get ``weights`` in turn and share ``share`` times all sizes. No target
    exceeds ``most`` times its source; the excess goes to the others by weight. In the order of ``cap / weight`` the
    capped sources come first, so that one running sum finds the level at which the rest is served. The windows run
    over one row per source. Sources of size 0 have target 0.
    """
    if most < share:
        raise ValueError("the sources can't hold their share")
    one = Window.partitionBy()
    by_name = one.orderBy(F.col("source").asc_nulls_last())
    per = sizes.groupBy(F.col(source).alias("source")).agg(F.sum(size).cast("bigint").alias("source_size"))
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", pick).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    filling = one.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(one) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    heads = F.sum("weight").over(one) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    per = per.withColumn("level", left / heads)
    # the first source whose cap lies above the level at its turn, and all behind it, are served at that level
    free = F.col("cap") / F.col("weight") > F.col("level")
    per = per.withColumn("at", F.min(F.when(free, F.struct((F.col("cap") / F.col("weight")).alias("r"), F.col("level").alias("level")))).over(one)["level"])
    target = F.when(F.col("at").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("at") * F.col("weight")))
    return per.select("source", "source_size", target.alias("target"))


def draw(key: Column, text: Column, seed: int) -> Column:
    """Number in [0, 1) from the document's key; documents without a key draw by their text."""
    name = F.coalesce(key.cast("string"), F.concat(F.lit("t"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    return hex_int(F.md5(F.concat_ws(":", F.lit(str(seed)), name).cast("binary")), DIGITS) / F.lit(float(16**DIGITS))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 6, keep_docs: bool = False, **rules) -> DataFrame:
    """Each document with the copies that the mix takes of it: ``floor(rate)``, and one more with the fraction's probability.

    Adds ``size`` (words), ``source_size``, ``target``, ``copies`` and ``taken`` (words times copies). With
    ``keep_docs`` all columns of ``docs`` are in the struct ``doc``. Null sources are a source; null and empty texts
    have size 0 and are taken as often as their source's rate says; repeated rows draw alike. Empty input gives no
    rows.
    """
    whole = [F.struct(*[docs[c] for c in docs.columns]).alias("doc")] if keep_docs else []
    d = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), draw(F.col(key), F.col(text), seed).alias("u"), *whole)
    per = materialise(targets(d.select("source", "size"), **rules), "mix")
    per = per.withColumnRenamed("source", "_source")
    d = join_checked(d, per, d["source"].eqNullSafe(per["_source"])).drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rate) + F.when(F.col("u") < rate - F.floor(rate), F.lit(1)).otherwise(F.lit(0))
    d = d.withColumn("copies", copies.cast("bigint")).withColumn("taken", F.col("size") * F.col("copies"))
    return d.select(F.col("key").alias(key), *(["doc"] if keep_docs else []), "size", "source_size", "target", "copies", "taken")


def repeat(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus itself: every document as many times as the mix takes it, with the columns of ``docs``."""
    m = mix(docs, keep_docs=True, **how).filter(F.col("copies") > 0)
    return m.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")


#: The same on DuckDB, for ``mix`` with its default arguments.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || md5('6:' || coalesce(doc_id::VARCHAR, 't' || md5(coalesce(text, ''))))[1:13])::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT] AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
f AS (SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
      FROM w WINDOW b AS (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a AS (SELECT arg_min(level, cap / weight) AS lv FROM f WHERE cap / weight > level),
t AS (SELECT source, source_size, CASE WHEN lv IS NULL THEN cap ELSE least(cap, lv * weight) END AS target FROM f, a),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t),
c AS (SELECT d.doc_id, d.size, r.source_size, r.target, (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, size * copies AS taken FROM c
"""
