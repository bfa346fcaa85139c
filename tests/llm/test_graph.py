import random

from decant.llm.graph import by_group, components


def test_components_of_paths_stars_and_noise(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(300)] + [(1000, 1001 + i) for i in range(200)] + [(5000 + rng.randrange(400), 5000 + rng.randrange(400)) for _ in range(250)] + [(None, 3), (9, 9), (1, 0), (1, 0)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            root[find(a)] = find(b)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint"), "a", "b").collect()}
    assert set(got) == set(root)
    for x in root:
        assert (got[x] == got[find(x)]) and got[x] in root
    assert len(set(got.values())) == len({find(x) for x in root})
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").collect() == []


def test_groups_are_whole_across_batches(spark):
    import pyarrow as pa

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        d = spark.range(500).selectExpr("id % 13 as a", "cast(id % 3 as int) as b", "id")
        got = by_group(d, ["a", "b"], lambda t: pa.RecordBatch.from_arrays([pa.array([t.num_rows]), t["a"][:1].combine_chunks(), pa.array([t["b"][0].as_py()])], names=["n", "a", "b"]), "n bigint, a bigint, b bigint").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for i in range(500):
        want[i % 13, i % 3] = want.get((i % 13, i % 3), 0) + 1
    assert {(r.a, r.b): r.n for r in got} == want and len(got) == len(want)
