"""Sinks: append with collision check, versioned upserts, snapshots, shards and report text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decant.operators.store import item_problem
from decant.session import materialise


def insert_items(new: DataFrame, existing: DataFrame, path: str) -> int:
    """Append items when all are valid and no id exists yet; otherwise nothing is written. Returns how many were added."""
    new = materialise(new, "incoming")
    per_id = new.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.count(item_problem()).alias("bad"))
    seen = per_id.join(existing.select("item_id", F.lit(1).alias("old")), "item_id", "left")
    found = seen.agg(F.sum("n").alias("n"), F.sum("bad").alias("invalid"), F.count_if(F.col("n") > 1).alias("repeated"), F.count("old").alias("existing")).first()
    if found.invalid or found.repeated or found.existing:
        raise ValueError(f"rejected: invalid={bool(found.invalid)} existing id={bool(found.existing)} repeated id={bool(found.repeated)}")
    new.write.mode("append").partitionBy("split", "source").parquet(path)
    return found.n or 0


def fingerprint(df: DataFrame, keys: Sequence[str] | None = None) -> Column:
    """Order-free content fingerprint: one aggregate, combined on the map side."""
    cols = list(keys or df.columns)
    h = F.xxhash64(*[F.to_json(F.struct(c)) for c in cols])
    return F.struct(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("bits"), F.sum(h.cast("decimal(38,0)")).alias("total"))


def content_hash(rows: DataFrame, ident: str, h: str, fan: int = 4096, levels: int = 3) -> DataFrame:
    """Row count, order-free xor, and an ordered fingerprint built as a tree.

    Each level hashes the hashes of ``fan`` neighbouring ids, so no group is larger than ``fan``; the root holds
    1 / fan ** levels of the rows' hashes.
    """

    def joined(key: str) -> Column:
        return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, "h"))), lambda x: x["h"]), ""), 256)

    bits = F.conv(F.substring(h, 1, 15), 16, 10).cast("bigint")
    d = rows.select(F.col(ident).alias("k"), F.col(h).alias("h"), F.lit(1).alias("n"), bits.alias("bits"))
    for _ in range(levels):
        d = d.groupBy(F.floor(F.col("k") / fan).cast("bigint").alias("up")).agg(joined("k").alias("h"), F.sum("n").alias("n"), F.bit_xor("bits").alias("bits"))
        d = d.withColumnRenamed("up", "k")
    return d.agg(F.sum("n").alias("n"), F.bit_xor("bits").alias("bits"), joined("k").alias("ordered"))


def snapshot(df: DataFrame, path: str) -> DataFrame:
    """Copy that refuses to overwrite, then compares both sides' counts and fingerprints."""
    df.write.mode("errorifexists").parquet(path)
    copy = df.sparkSession.read.parquet(path)
    a = df.agg(fingerprint(df).alias("f")).select(F.lit("source").alias("side"), "f.*")
    return a.unionByName(copy.agg(fingerprint(copy, df.columns).alias("f")).select(F.lit("copy").alias("side"), "f.*"))


def write_rows_per_file(df: DataFrame, path: str, rows: int, by: Sequence[str] = ()) -> None:
    """Files of at most ``rows`` rows, ordered by nothing but the rows' own keys."""
    w = df.write.option("maxRecordsPerFile", rows)
    (w.partitionBy(*by) if by else w).parquet(path)


def report_lines(df: DataFrame, columns: Sequence[str], digits: int = 3) -> DataFrame:
    """Markdown table rows for a small aggregated table; missing numbers print as a dash."""
    types = dict(df.dtypes)

    def cell(c: str) -> Column:
        text = F.format_string(f"%.{digits}f", c) if types[c] == "double" else F.col(c).cast("string")
        return F.coalesce(F.when(F.col(c).isNotNull(), text), F.lit("-"))

    row = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |"))
    return df.select(row.alias("line"))


def guard_strings(strings: DataFrame, path: str) -> None:
    """Remember the fingerprint of a string set (uid, text) at ``path``, or refuse a set that differs from the one there."""
    spark = strings.sparkSession
    mark = strings.agg(fingerprint(strings, ["uid", "text"]).alias("f"))
    try:
        before = spark.read.parquet(path).first()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        mark.write.parquet(path)
        return
    if before != mark.first():
        raise ValueError("string set differs from the stored one")
