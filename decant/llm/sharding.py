"""Shards by a hierarchical weighted hash tree: region, rack, shard.

At every level the children of the chosen node draw ``-ln(u) / weight`` from a hash of the key and their own
name, and the smallest draw wins, so a child is chosen in proportion to its weight. A draw depends on nothing but
the key, the child and the child's weight: when a weight grows, rows only move towards that child, and subtrees
whose weights are unchanged keep every row between them. A shard added inside an old rack raises the weights of
its rack and region as well, so some rows also move into its siblings there. A shard that opens a rack and a region
of its own changes no other weight, and takes rows only into itself; that is how ``grown_shard`` grows the tree.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decant.llm.common import let
from decant.operators.prefix import prefix

Level = list[tuple[int, int, float]]


def tree(shards: int, racks: int = 4, regions: int = 8, weights: Mapping[int, float] | None = None) -> Sequence[Level]:
    """Levels of (parent, node, weight) for shards dealt in order: ``racks`` shards to a rack, ``regions`` to a region.

    ``regions`` must be a multiple of ``racks``. ``weights`` overrides single shards (1 otherwise); a weight of 0
    takes a shard out. Inner nodes weigh what their shards weigh together.
    """
    if regions % racks:
        raise ValueError("a region holds whole racks")
    leaf = {s: float((weights or {}).get(s, 1.0)) for s in range(shards)}
    if min(leaf.values(), default=0) < 0 or not sum(leaf.values()):
        raise ValueError("weights must not be negative and not all zero")

    def level(size: int, up: int | None) -> Level:
        total: dict[int, float] = {}
        for s, w in leaf.items():
            total[s // size] = total.get(s // size, 0.0) + w
        return [(n * size // up if up else 0, n, w) for n, w in total.items() if w > 0]

    return level(regions, None), level(racks, regions), level(1, racks)


def descend(key: Column, levels: Sequence[Level]) -> Column:
    """Shard of a key: one weighted draw among the children at each level. A null key is a key like any other."""
    at = F.lit(0)
    for depth, nodes in enumerate(levels):
        at = _choose(key, at, depth, nodes)
    return at


def _choose(key: Column, parent: Column, depth: int, nodes: Level) -> Column:
    table = F.array(*[F.struct(F.lit(p).alias("up"), F.lit(n).alias("id"), F.lit(w).alias("w")) for p, n, w in nodes])

    def draw(n: Column) -> Column:
        # 52 hash bits, never 0 or 1
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(depth), n["id"]), 12) + F.lit(0.5)) / F.lit(float(1 << 52))
        return F.struct((-F.ln(u) / n["w"]).alias("draw"), n["id"].alias("id"))

    return let(parent, lambda at: F.array_min(F.transform(F.filter(table, lambda n: n["up"] == at), draw))["id"])


def shard(
    docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text", overhead: int = 16,
    racks: int = 4, regions: int = 8, weights: Mapping[int, float] | None = None, slices: int = 256,
) -> DataFrame:
    """One row per document: its size, checksum, shard, slot (gapless from 0 within the shard) and shard after growth.

    ``grown_shard`` is the shard with one more shard in a region of its own. Slots follow (hash slice, key, checksum):
    ``slices`` sorted runs per shard, so that no task sorts a whole shard. Null texts have the bytes and checksum of
    the empty text; null keys all meet in one shard; repeated rows get slots of their own. Other columns of ``docs``
    are not read. Empty input gives no rows.
    """
    k, t = F.col("_key"), F.coalesce(F.col("_text"), F.lit(""))
    d = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    now = tree(shards, racks, regions, weights)
    grown = [[*old, *new] for old, new in zip(now, _one_more(shards, racks, regions), strict=True)]
    d = d.select(
        k.alias("key"), (F.octet_length(t) + F.lit(overhead)).cast("bigint").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"),
        descend(k, now).alias("shard"), descend(k, grown).alias("grown_shard"),
    )
    d = prefix(d, ["key", "text_crc32", "size"], F.pmod(F.xxhash64("key"), F.lit(slices)), ["shard"], rank="_rank")
    return d.select(
        F.col("key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("_rank") - 1).cast("bigint").alias("slot"), "grown_shard",
    )


def _one_more(shards: int, racks: int, regions: int) -> Sequence[Level]:
    """The new shard with a rack and a region of its own, numbered behind all others."""
    region, rack = -(-shards // regions), -(-shards // racks)
    return [(0, region, 1.0)], [(region, rack, 1.0)], [(rack, shards, 1.0)]
