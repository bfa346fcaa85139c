"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within cells, one vector kept per group.

Equal vectors form a class and classes are compared. A class lies in the cell of its nearest centre and also visits
every cell whose centre is at most ``SLACK`` (in cosine) farther, so that close vectors on both sides of a border meet.
The centres are fitted on a bounded sample; their number grows with the root of the number of vectors, so cells stay
small against the table. A cell's own classes and all that lie in it or visit it are cut into blocks, each by their own
number, and a task holds one pair of such blocks whatever a cell's size: most of what a cell holds are visitors, which meet
the few blocks of its own classes only. A task returns the number of links of each of its vectors and a spanning forest of the links it found, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decant.llm.graph import Forest, components
from decant.session import materialise

#: Bytes of the sample that the centres are fitted on, and vectors in it for each centre.
SAMPLE_BYTES, PER_CENTRE = 24 << 20, 12
ROUNDS = 8
SLACK = 0.15
#: Vectors on each side of a block product.
BLOCK = 2048


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def classes_of(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """key, cls (16-byte id of the vector's values; null if it can't be compared), vec (its values as 8-byte floats)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cls, vec = [], []
            for v in b.column(1):
                x = np.array(v.values.to_numpy(zero_copy_only=False), dtype=np.float64) + 0.0 if v.is_valid else np.zeros(0)
                with np.errstate(over="ignore"):
                    ok = len(x) and np.isfinite(x).all() and x.any()
                if ok:
                    x = x / np.abs(x).max() if not np.isfinite(x @ x) or x @ x < 1e-200 else x
                raw = x.tobytes() if ok else None
                cls.append(xxhash.xxh128_digest(raw) if ok else None)
                vec.append(raw)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cls, pa.binary()), pa.array(vec, pa.binary())], names=["key", "cls", "vec"])

    d = vectors.select(F.col(key).cast("bigint").alias("key"), F.col(vector).cast("array<double>").alias("vec"))
    return d.mapInArrow(run, "key bigint, cls binary, vec binary")


def centres(classes: DataFrame) -> dict[int, np.ndarray]:
    """Unit centres for each vector length (normally one), from a sample by hash of bounded size."""
    out = {}
    for r in classes.groupBy(F.octet_length("vec").alias("size")).agg(F.count("*").alias("n")).collect():
        size, n = r["size"], r["n"]
        share = min(1.0, SAMPLE_BYTES / size / n)
        u = F.shiftrightunsigned(F.xxhash64(F.lit(3), "cls"), 11) / F.lit(float(1 << 53))
        got = classes.filter((F.octet_length("vec") == size) & (u < share)).select("cls", "vec").collect()
        x = _unit(np.array([np.frombuffer(v["vec"], dtype=np.float64) for v in sorted(got, key=lambda v: v["cls"])]).reshape(-1, size // 8))
        k = int(max(1, min(round(n**0.5), len(x) // PER_CENTRE)))
        c = x[:k] if len(x) else np.eye(1, size // 8)
        for _ in range(ROUNDS if len(x) else 0):
            near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(x), 4096)])
            total = np.zeros_like(c)
            np.add.at(total, near, x)
            length = np.linalg.norm(total, axis=1, keepdims=True)
            c = np.where(length > 1e-12, total / np.maximum(length, 1e-12), c)
        out[size] = c
    return out


def _members(classes: DataFrame, cells: dict[int, np.ndarray], slack: float) -> DataFrame:
    """A row for each cell that a class lies in or visits."""
    shared = classes.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            homes, lists = [], []
            for v in b.column(1):
                x = np.frombuffer(v.as_buffer(), dtype=np.float64)
                s = shared.value[len(x) * 8] @ (x / np.linalg.norm(x))
                homes.append(int(s.argmax()))
                lists.append(np.flatnonzero(s >= s.max() - slack).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(homes, pa.int32()), pa.array(lists, pa.list_(pa.int32()))], names=["cls", "vec", "n", "home", "cells"])

    m = classes.select("cls", "vec", "n").mapInArrow(run, "cls binary, vec binary, n bigint, home int, cells array<int>")
    return m.withColumn("size", F.octet_length("vec"))


def _compare(least: float):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        x = _unit(np.frombuffer(b"".join(block["vec"]), dtype=np.float64).reshape(len(block), -1))
        home, n, cell = block["home"].to_numpy(), block["n"].to_numpy(), int(block["cell"].iloc[0])
        here, meet = np.flatnonzero(block["here"].to_numpy()), np.flatnonzero(block["meet"].to_numpy())
        lists = block["cells"].iloc[here].to_list()
        top = 1 + int(max(home.max(), *(max(c) for c in lists))) if lists else 1
        visited = np.unique(np.concatenate([i * top + np.asarray(c, dtype=np.int64) for i, c in zip(here, lists, strict=True)])) if lists else np.zeros(0, np.int64)
        links, forest = np.zeros(len(block), dtype=np.int64), Forest(len(block))
        for i in range(0, len(here), 512):
            own = here[i : i + 512]
            a, b = np.nonzero(x[own] @ x[meet].T >= least)
            a, b = own[a], meet[b]
            a, b = a[a != b], b[a != b]
            np.add.at(links, a, n[b])
            # a visitor whose own cell does not see this vector is credited here
            blind = (home[b] != cell) & ~np.isin(a * top + home[b], visited)
            np.add.at(links, b[blind], n[a[blind]])
            forest.link(a, b)
        cls = block["cls"].to_numpy()
        some, (tied, root) = np.flatnonzero(links), forest.edges()
        return pd.DataFrame({"a": np.append(cls[some], cls[tied]), "b": np.append(np.full(len(some), None), cls[root]), "n": np.append(links[some], np.zeros(len(tied), np.int64))})

    return run


def _pairs_of_blocks(members: DataFrame) -> DataFrame:
    """Rows of each pair of blocks (size, cell, i, j): the cell's own classes of block i are ``here``, all classes of block j ``meet`` them.

    Only rows that are ``here`` bring their cells along.
    """
    at = members.withColumn("cell", F.explode("cells")).withColumn("own", F.col("home") == F.col("cell"))
    sizes = at.groupBy("size", "cell").agg(F.ceil(F.count_if("own") / BLOCK).cast("int").alias("homes"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    d = at.join(sizes.filter(F.col("homes") > 0), ["size", "cell"])
    block = lambda count: F.pmod(F.xxhash64("cls"), count).cast("int")
    d = d.withColumn("at_i", F.when(F.col("own"), block("homes"))).withColumn("at_j", block("blocks"))
    across = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.col("at_i").alias("i"), j.alias("j")))
    down = F.transform(F.sequence(F.lit(0), F.col("homes") - 1), lambda i: F.struct(i.alias("i"), F.col("at_j").alias("j")))
    d = d.withColumn("p", F.explode(F.when(F.col("own"), F.array_union(across, down)).otherwise(down)))
    here = F.col("own") & (F.col("at_i") == F.col("p.i"))
    return d.select("size", "cell", "p.i", "p.j", "cls", "vec", "n", "home", F.when(here, F.col("cells")).alias("cells"),
                    F.coalesce(here, F.lit(False)).alias("here"), (F.col("at_j") == F.col("p.j")).alias("meet"))


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.9, slack: float = SLACK) -> DataFrame:
    """One row per vector: ``n_links``, ``component_id`` (least key reachable by links) and ``kept``.

    Vectors are linked when their cosine, in double precision, is at least ``least``. Vectors that are null, empty,
    zero or hold null or non-finite values are linked with nothing; vectors of different lengths are not compared.
    Repeated rows are linked with each other. A null key never names a component that has another key. Other columns
    are not read; empty input gives no rows.
    """
    rows = materialise(classes_of(vectors, key, vector), "vectors")
    classes = rows.filter(F.col("cls").isNotNull()).groupBy("cls").agg(F.min("key").alias("key"), F.count("*").alias("n"), F.first("vec").alias("vec"))
    classes = materialise(classes, "classes")
    members = materialise(_members(classes, centres(classes), slack), "members")
    d = _pairs_of_blocks(members)
    found = materialise(d.groupBy("size", "cell", "i", "j").applyInPandas(_compare(least), "a binary, b binary, n bigint"), "found")
    labels = components(found.filter(F.col("b").isNotNull()), "a", "b").withColumnRenamed("node", "cls")
    links = found.groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("links"))
    named = classes.select("cls", "key", "n").join(links, "cls", "left").join(labels, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    named = materialise(named.withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("n") - 1).drop("links"), "named")
    ids = named.groupBy("component").agg(F.min("key").alias("component_id"))
    of = named.join(ids, "component").select("cls", "n_links", "component_id")
    out = rows.select("key", "cls").join(of, "cls", "left")
    lone = F.col("cls").isNull()
    return out.select(
        F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.when(lone, F.col("key")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
