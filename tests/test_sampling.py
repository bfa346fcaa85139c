"""Keyed permutations and endless walks."""

import hashlib
from collections import Counter

import pytest

from decant.functions import hashing as H
from decant.operators import sampling


def plain(x, n, key):
    for r in range(H.ROUNDS):
        k = int(hashlib.sha1(f"{key}:{r}".encode()).hexdigest()[:8], 16)
        y = (k - x) % n
        if hashlib.sha1(f"{key}:{r}:{max(x, y)}".encode()).hexdigest()[0] >= "8":
            x = y
    return x


@pytest.mark.parametrize("n", [1, 2, 3, 97, 1000])
def test_every_epoch_is_a_permutation(spark, n):
    d = spark.range(n).selectExpr("id", f"{n}L as n", "explode(sequence(0, 2)) as epoch")
    got = d.withColumn("at", sampling.epoch_position("id", "n", "epoch")).collect()
    for e in range(3):
        own = {r.id: r["at"] for r in got if r.epoch == e}
        assert sorted(own.values()) == list(range(n))
        assert own == {x: plain(x, n, f"{H.SEED}:{e}") for x in range(n)}
    if n > 90:
        assert sum(r["at"] == r.id for r in got) < 15
        assert len({r["at"] for r in got if r.id == 5}) > 1


def test_walks_meet_every_row_of_every_epoch_once(spark):
    pool = spark.createDataFrame([(i, "a") for i in range(10)] + [(100 + i, "b") for i in range(7)] + [(900, "none")], "item_id long, source string")
    quota = {"a": 4, "b": 1, "gone": 3}
    rows = sampling.stratified_batches(pool, "item_id", quota, 0, 35).collect()
    assert Counter(r.source for r in rows) == {"a": 140, "b": 35}
    for source, q, n in (("a", 4, 10), ("b", 1, 7)):
        walk = [r.item_id for r in sorted((r for r in rows if r.source == source), key=lambda r: (r.step, r.j))]
        for e in range(len(walk) // n):
            assert len(set(walk[e * n : e * n + n])) == n
        assert walk[:n] != walk[n : 2 * n]
    # any range of steps is the same part of the walk, in whatever order the rows come
    part = sampling.stratified_batches(pool.repartition(5), "item_id", quota, 20, 23).collect()
    assert sorted(map(tuple, part)) == sorted(tuple(r) for r in rows if 20 <= r.step < 23)
    assert max(r.step for r in sampling.stratified_batches(pool, "item_id", quota).collect()) == 6
    assert sampling.stratified_batches(pool.limit(0), "item_id", quota).collect() == []


def test_buckets_follow_the_distribution(spark):
    from pyspark.sql import functions as F

    from decant.operators.prefix import edge_buckets

    values = [None, None, *range(1000), *[10**12 + 7 * i for i in range(1000)], *[5] * 500]
    d = spark.createDataFrame([(v,) for v in values], "v long")
    got = edge_buckets(d, "v", buckets=16).collect()
    pairs = sorted(((-1 if r.v is None else r.v), r._bucket) for r in got)
    assert [b for _, b in pairs] == sorted(b for _, b in pairs) and len(got) == len(values)
    assert max(sum(b == k for v, b in pairs if v != 5) for k in range(16)) < 400
    assert edge_buckets(d.limit(0), "v").collect() == []
    assert edge_buckets(d.filter(F.col("v").isNull()), "v").count() == 2
