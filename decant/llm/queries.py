"""Registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from decant.llm import bytebpe, crosstok, langid, licenses, merkle, minhash, mixing, packing, pii, rules, sharding, substrings, vectors
from decant.plans.registry import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


@query("op3_sharding")
def op3(spark, sf):
    return sharding.shard(table(spark, sf, "documents"), shards=40)


@query("op5_packing")
def op5(spark, sf):
    return packing.pack(table(spark, sf, "documents"), capacity=2048)


@query("op6_mixing", mixing.SQL)
def op6(spark, sf):
    return mixing.mix(table(spark, sf, "documents")).drop("copies")


@query("op9_pii", pii.SQL)
def op9(spark, sf):
    return pii.report(table(spark, sf, "documents"))


@query("op4_rules")
def op4(spark, sf):
    return rules.judge(table(spark, sf, "documents"))


@query("op1_near_dedup")
def op1(spark, sf):
    return minhash.near_duplicates(table(spark, sf, "documents"), width=4)


@query("op10_substrings")
def op10(spark, sf):
    return substrings.strip(table(spark, sf, "documents")).drop("kept")


@query("op7_language")
def op7(spark, sf):
    return langid.identify(table(spark, sf, "documents"))


@query("op8_vectors")
def op8(spark, sf):
    return vectors.near_duplicates(table(spark, sf, "embeddings"))


@query("op2_licenses")
def op2(spark, sf):
    return licenses.scan(table(spark, sf, "documents"))


@query("op13_byte_bpe")
def op13(spark, sf):
    return bytebpe.digest(table(spark, sf, "documents"))


@query("op11_alignment")
def op11(spark, sf):
    return crosstok.score(table(spark, sf, "documents"))


@query("op12_manifest", merkle.SQL)
def op12(spark, sf):
    return merkle.manifest(table(spark, sf, "documents"))
