"""Connected components of links, by contraction."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decant.session import materialise


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node`` and ``component`` for every node of ``links``; the component is one of its nodes.

    Each round every node joins its least neighbour in a hashed order, and links between joined nodes become links
    between what they joined. Hashed order makes the number of rounds logarithmic whatever the shape of the links.
    Every round is written, so a lost executor repeats one round at most. Minima are combined before the shuffle,
    and joins are plain joins, so the centre of a star may hold a third of all links. Links with a null end and loops
    are ignored.
    """
    # a plain second column keeps the hashed order without nesting the id
    edges = links.select(F.struct(F.xxhash64(a).alias("h"), F.col(a).alias("id")).alias("u"), F.struct(F.xxhash64(b).alias("h"), F.col(b).alias("id")).alias("v"))
    edges = materialise(edges.filter(F.col("u.id").isNotNull() & F.col("v.id").isNotNull() & (F.col("u") != F.col("v"))), "links")
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.union(edges.select("v", "u"))
        joined = materialise(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("to")), "joined")
        rounds.append(joined)
        left, right = joined.select("u", F.col("to").alias("p")), joined.select(F.col("u").alias("v"), F.col("to").alias("q"))
        moved = edges.join(left, "u").join(right, "v").filter(F.col("p") != F.col("q"))
        edges = materialise(moved.select(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v")).distinct(), "links")
    if not rounds:
        return edges.select(F.col("u.id").alias("node"), F.col("v.id").alias("component"))
    out = rounds.pop()
    while rounds:
        nearer = rounds.pop()
        out = nearer.join(out.select(F.col("u").alias("to"), F.col("to").alias("end")), "to", "left").select("u", F.coalesce("end", "to").alias("to"))
    return out.select(F.col("u.id").alias("node"), F.col("to.id").alias("component"))


class Forest:
    """Components of ``size`` nodes from links that come in pieces; what is kept does not grow with the links."""

    def __init__(self, size: int):
        self.root = np.arange(size)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while len(a):
            low = np.minimum(root[a], root[b])
            np.minimum.at(root, root[a], low)
            np.minimum.at(root, root[b], low)
            while (root != root[root]).any():
                root[:] = root[root]
            apart = root[a] != root[b]
            a, b = a[apart], b[apart]

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        a = np.flatnonzero(self.root != np.arange(len(self.root)))
        return a, self.root[a]


def by_group(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """``fn`` over the rows of each group, as an Arrow table. For many small groups, which grouped pandas calls are slow at.

    Groups must be of bounded size.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            ids = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(len(keys))])
            cuts = np.append(0, np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1)
            if held and tuple(ids[:, 0]) != last:
                yield fn(pa.Table.from_batches(held))
                held = []
            for i, j in zip(cuts, np.append(cuts[1:], b.num_rows), strict=True):
                if held and i:
                    yield fn(pa.Table.from_batches(held))
                    held = []
                held.append(b.slice(i, j - i))
            last = tuple(ids[:, -1])
        if held:
            yield fn(pa.Table.from_batches(held))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
