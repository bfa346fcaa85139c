"""Queries and their SQL follow one rule where it is easy to miss: small tables made for it."""

import duckdb
import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry


def problems(spark, folder, name, table):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    return oracle.compare(name, entry.queries()[name](spark, str(folder)), con, entry.oracle_sql()[name])[0]


def embeddings(spark, folder, vectors, labels):
    rows = [(i, [float(x) for x in v], int(k)) for i, (v, k) in enumerate(zip(vectors, labels))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")


@pytest.mark.parametrize("name", ["ls_rkd", "ls_combined"])
@pytest.mark.parametrize("left", [1, 2])
def test_a_last_batch_without_pairs(spark, tmp_path, name, left):
    """One row, or two of one string, have no relation: the batch counts with a loss of 0."""
    n = 32 + left
    embeddings(spark, tmp_path, np.random.default_rng(1).normal(size=(n, 64)), np.arange(n) % 10)
    assert not problems(spark, tmp_path, name, "embeddings")


def test_scores_that_round_to_zero_have_no_sign(spark, tmp_path):
    vectors = np.eye(10, 64)
    vectors[1, 0] = -2e-7
    embeddings(spark, tmp_path, vectors, np.arange(10))
    assert not problems(spark, tmp_path, "fn_permute", "embeddings")


def test_percentiles_of_full_windows_are_exact(spark, tmp_path):
    """Windows with more latencies than a sketch keeps apart."""
    rng = np.random.default_rng(5)
    d = spark.createDataFrame([(i, int(t), float(v)) for i, (t, v) in enumerate(zip(rng.integers(0, 100_000, 6000), rng.lognormal(3, 1, 6000).round(2)))], "event_id long, s long, value double")
    d = d.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s")).cast("timestamp_ntz")).withColumn("event_type", F.lit("view"))
    d.drop("s").write.parquet(f"{tmp_path}/events.parquet")
    assert not problems(spark, tmp_path, "sg_progress", "events")


def test_pauses_of_samples_that_share_an_instant(spark, tmp_path):
    """Samples of one instant follow each other by id, so a pause may take no time and another may start where one ends."""
    rng = np.random.default_rng(6)
    rows = [(i, int(s), int(u), float(v)) for i, (s, u, v) in enumerate(zip(rng.integers(0, 400, 3000), rng.integers(0, 2, 3000), rng.choice([5.0, 20.0, 30.0], 3000)))]
    d = spark.createDataFrame(rows, "event_id long, s long, user_id long, value double")
    d = d.withColumn("ts", F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("s") * 50).cast("timestamp_ntz")).withColumn("event_type", F.lit("view"))
    d.drop("s").write.parquet(f"{tmp_path}/events.parquet")
    assert not problems(spark, tmp_path, "sg_session_pauses_stream", "events")
