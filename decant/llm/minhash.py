"""Near-duplicates by b-bit MinHash.

1. A document is the set of hashes of its word shingles. Equal sets form a class; only classes are compared.
2. ``BANDS`` bands of ``ROWS`` minima give bucket keys. Two sets with similarity 0.8 miss every bucket once in 2e7.
3. The low ``BITS`` bits of all minima are packed. Equal slots, found by bit counts and corrected for chance, estimate
   a similarity; pairs more than 4.5 standard deviations below the threshold are not looked at again.
4. What is left is confirmed on the full sets.

Connected groups are wanted, not pairs. Each class first meets the least class of its buckets. Links found so far make
components, and only pairs across components are looked at again. Within a bucket, the members of its largest
component lie in blocks, and the others visit every block; what is likely there is returned as a spanning forest.
Classes that likely pairs connect make a cluster, and the full sets of a cluster meet once, in blocks: every likely
pair is confirmed whose ends are not connected yet. No step returns more rows than it has nodes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decant.llm.graph import Forest, by_group, components
from decant.session import materialise

BANDS, ROWS, BITS = 32, 4, 4
HASHES = BANDS * ROWS
#: Words whose hashes a task keeps at a time; the memo only saves work.
MEMO = 200_000
#: Members of a bucket, and sets of a cluster, in one block.
BLOCK, SETS = 4096, 512

_rng = np.random.default_rng(20240601)
_MUL = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)[:, None]
_MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that every bit depends on all bits (splitmix finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


class Words(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def word_hashes(texts: pa.Array) -> list[np.ndarray]:
    """Hashes of the words of each text (bytes; null has none), lower-cased; a word is hashed once however often a batch has it."""
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, b"").view(pa.string())))
    words = pc.ascii_split_whitespace(trimmed)
    codes = words.flatten().dictionary_encode()
    known = codes.dictionary.view(pa.binary()).to_numpy(zero_copy_only=False)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, known), dtype=np.uint64, count=len(known))[codes.indices.to_numpy()]
    ends = np.cumsum(pc.list_value_length(words).to_numpy())
    # splitting a text without words gives one empty word
    first = np.where(pc.binary_length(trimmed).to_numpy() > 0, np.append(0, ends)[:-1], ends)
    return [hashes[i:j] for i, j in zip(first, ends, strict=True)]


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes; a shorter sequence is one shingle, an empty one none."""
    n = min(width, len(words))
    if not n:
        return words
    h = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - n + 1 + i])
    h.sort()
    return h[np.append(True, h[1:] != h[:-1])]


def minima(s: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(s), 1024):
        h = _MUL * s[i : i + 1024]
        h += _ADD
        np.minimum(out, h.min(axis=1), out=out)
    return out


def packed(m: np.ndarray) -> np.ndarray:
    """Low bits of the minima (last axis), ``64 / BITS`` to a number. Minima keep their order bits on top, so low bits are mixed first."""
    low = (mix(m) & np.uint64((1 << BITS) - 1)).reshape(*m.shape[:-1], -1, 64 // BITS)
    return np.bitwise_or.reduce(low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)), axis=-1)


def bands_of(m: np.ndarray) -> np.ndarray:
    """Bucket keys of the minima (last axis), one for each band."""
    h = np.arange(BANDS, dtype=np.uint64)
    for r in np.moveaxis(m.reshape(*m.shape[:-1], BANDS, ROWS), -1, 0):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + r)
    return h


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of packed signatures (last axis) from the count of equal slots, less those equal by chance."""
    x = a ^ b
    for shift in (1, 2) if BITS == 4 else range(1, BITS):
        x = x | (x >> np.uint64(shift))
    ones = np.uint64(sum(1 << i for i in range(0, 64, BITS)))
    equal = np.bitwise_count(~x & ones).sum(axis=-1, dtype=np.int64) / HASHES
    chance = 0.5**BITS
    return (equal - chance) / (1 - chance)


def margin(threshold: float) -> float:
    """Estimates below this are given up: 4.5 standard deviations under the threshold."""
    chance = 0.5**BITS
    p = chance + (1 - chance) * threshold
    return threshold - 4.5 * (p * (1 - p) / HASHES) ** 0.5 / (1 - chance)


def _set_id(s: np.ndarray) -> bytes | None:
    return xxhash.xxh128_digest(s.tobytes()) if len(s) else None


def signatures(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """key, cls (16-byte id of the set, null if empty), n (its size), bands, sig."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(words, width) for words in word_hashes(b.column(1))]
            cls, n = [_set_id(s) for s in sets], [len(s) for s in sets]
            m = np.array([minima(s) for s in sets]).reshape(-1, HASHES)
            bands = [h if k else None for h, k in zip(bands_of(m).view(np.int64), n, strict=True)]
            sig = [p.tobytes() if k else None for p, k in zip(packed(m), n, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(cls, pa.binary()), pa.array(n, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary())],
                names=["key", "cls", "n", "bands", "sig"])

    d = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("binary").alias("text"))
    return d.mapInArrow(run, "key bigint, cls binary, n bigint, bands array<bigint>, sig binary")


def _full_sets(docs: DataFrame, wanted: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """The shingle set of each wanted class (cls, key of one of its documents), from that document's text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cls, sets = [], []
            for c, words in zip(b.column(0).to_pylist(), word_hashes(b.column(1)), strict=True):
                s = shingles(words, width)
                if _set_id(s) == c:  # another text may have the same key
                    cls.append(c)
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.binary()), pa.array(sets, pa.binary())], names=["cls", "items"])

    d = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("binary").alias("text")).filter(F.col("text").isNotNull())
    j = wanted.select("cls", F.col("key").alias("_k")).join(d, F.col("_k").eqNullSafe(F.col("key")))
    return j.select("cls", "text").mapInArrow(run, "cls binary, items binary").dropDuplicates(["cls"])


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough: 100 * intersection >= percent * union."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                s, t = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                keep.append(_similar(s, t, percent))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    a, b = sets.select(F.col("cls").alias("a"), F.col("items").alias("x")), sets.select(F.col("cls").alias("b"), F.col("items").alias("y"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def _signatures(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(len(column), -1)


def _likely_pairs(sig: np.ndarray, n: np.ndarray, group: np.ndarray, a: np.ndarray, b: np.ndarray, least: float, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of ``a`` with ``b`` in different groups that may be similar enough, with their estimates, in pieces."""
    step = max(1, 200_000 // max(1, len(b)))
    for i in range(0, len(a), step):
        v = a[i : i + step]
        e = estimate(sig[v][:, None, :], sig[b][None, :, :])
        low, high = np.minimum(n[v][:, None], n[b]), np.maximum(n[v][:, None], n[b])
        x, y = np.nonzero((e >= least) & (group[v][:, None] != group[b]) & (100 * low >= percent * high))
        yield v[x], b[y], e[x, y]


def _across(least: float, percent: int):
    """Spanning forest of the likely pairs across components in one block of a bucket."""

    def run(block: pa.Table) -> pa.RecordBatch:
        sig, n, cls = _signatures(block["sig"]), block["n"].to_numpy(), block["cls"].to_pylist()
        group = pc.dictionary_encode(block["component"].combine_chunks()).indices.to_numpy()
        here, visits = np.flatnonzero(block["here"].to_numpy(zero_copy_only=False)), np.flatnonzero(block["visits"].to_numpy(zero_copy_only=False))
        forest = Forest(len(cls))
        for a, b, _ in _likely_pairs(sig, n, group, visits, here, least, percent):
            forest.link(a, b)
        a, b = forest.edges()
        return pa.RecordBatch.from_arrays([pa.array([cls[i] for i in a], pa.binary()), pa.array([cls[i] for i in b], pa.binary())], names=["a", "b"])

    return run


def _similar(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(s, t, assume_unique=True))
    return 100 * both >= percent * (len(s) + len(t) - both)


def _settle(least: float, percent: int):
    """Links that connect components within two blocks of a cluster, confirmed on the full sets, likeliest first."""

    def run(block: pa.Table) -> pa.RecordBatch:
        sig, n, cls = _signatures(block["sig"]), block["n"].to_numpy(), block["cls"].to_pylist()
        sets = [np.frombuffer(x, dtype=np.uint64) for x in block["items"].to_pylist()]
        group = pc.dictionary_encode(block["component"].combine_chunks()).indices.to_numpy()
        left, right = np.flatnonzero(block["left"].to_numpy(zero_copy_only=False)), np.flatnonzero(block["right"].to_numpy(zero_copy_only=False))
        found = list(_likely_pairs(sig, n, group, left, right, least, percent))
        a, b, e = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, int) for k in range(3))
        forest = Forest(int(group.max()) + 1)
        links = []
        for k in np.argsort(-e, kind="stable"):
            i, j = a[k], b[k]
            if forest.root[group[i]] != forest.root[group[j]] and _similar(sets[i], sets[j], percent):
                forest.link(group[i : i + 1], group[j : j + 1])
                links.append((cls[i], cls[j]))
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.binary()) for k in (0, 1)], names=["a", "b"])

    return run


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """Rows (key, cls, n) of the documents, and classes (cls, component, component_id); both are written tables."""
    least = margin(percent / 100)
    rows = materialise(signatures(docs, key, text, width), "signatures")
    classes = rows.filter(F.col("cls").isNotNull()).groupBy("cls").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    classes = materialise(classes, "classes")
    bands = classes.select("cls", F.posexplode("bands").alias("band", "bucket"))
    centres = bands.groupBy("bucket").agg(F.min("cls").alias("a"), F.max("cls").alias("z")).filter(F.col("a") != F.col("z")).drop("z")
    shared = materialise(bands.join(centres, "bucket").select("bucket", "cls", "a"), "buckets")
    sets = materialise(_full_sets(docs, classes.join(shared.select("cls").distinct(), "cls", "left_semi"), key, text, width), "sets")

    facts = classes.select("cls", "n", "sig")
    pairs = shared.filter(F.col("cls") != F.col("a")).select("a", F.col("cls").alias("b")).distinct()
    pairs = pairs.join(facts.toDF("a", "na", "siga"), "a").join(facts.toDF("b", "nb", "sigb"), "b")
    pairs = pairs.filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).filter(_likely("siga", "sigb", least)).select("a", "b")
    links = materialise(_confirm(pairs, sets, percent), "links")
    labels = materialise(components(links, "a", "b"), "labels")
    labels = labels.withColumnRenamed("node", "cls")
    likely = materialise(_meet(shared, facts, labels, least, percent), "likely")
    more = materialise(_confirm_clusters(likely, facts, sets, labels, least, percent), "links")
    if not more.isEmpty():
        labels = materialise(components(links.union(more), "a", "b"), "labels").withColumnRenamed("node", "cls")
    named = classes.select("cls", "key").join(labels, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    named = materialise(named, "named")
    ids = named.groupBy("component").agg(F.min("key").alias("component_id"))
    return rows.select("key", "cls", "n"), materialise(named.join(ids, "component").select("cls", "component", "component_id"), "groups")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: ``n_shingles``, ``component_id`` (least key reachable by links) and ``kept``.

    Words are lower-cased (A to Z only). Two documents are linked when their sets of ``width``-word shingles have at
    least ``percent`` hundredths of their union in common. Texts that are null or have no word are linked with
    nothing. Repeated rows share their component. A null key never names a component that has another key.
    Other columns are not read; empty input gives no rows.
    """
    rows, of = groups(docs, key, text, width, percent)
    out = rows.join(of, "cls", "left")
    return out.select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"),
        F.when(F.col("cls").isNull(), F.col("key")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group: the one with the least key, a null key last.

    Documents without a word are in no group and stay. Of rows that repeat both key and set one stays. A key that
    stands on one row only decides by itself, so no document is hashed again and none leaves the JVM; only rows whose
    key is null or repeats are told apart by their sets.
    """
    rows, of = groups(docs, key, text, width, percent)
    members = rows.join(of, "cls")
    first = members.groupBy("component").agg(F.min(F.struct(F.col("key").isNull().alias("last"), "key", "cls")).alias("m"))
    first = materialise(first.select(F.col("m.key").alias("_key"), F.col("m.cls").alias("_cls")), "first")
    keys = materialise(rows.filter(F.col("key").isNotNull()).groupBy("key").agg(F.count("*").alias("n"), F.first("cls").alias("cls")), "keys")
    stays = first.filter(F.col("_key").isNotNull()).select(F.col("_key").alias("key"), F.col("_cls").alias("cls"))
    unique = keys.filter((F.col("n") == 1) & F.col("cls").isNotNull()).select("key", "cls")
    several = keys.filter(F.col("n") > 1).select(F.col("key").alias("_k"))
    away = materialise(unique.join(stays, ["key", "cls"], "left_anti").select(F.col("key").alias("_k")).union(several), "away")
    own = docs[key].cast("bigint")
    kept = docs.filter(docs[key].isNotNull()).join(away, own == F.col("_k"), "left_anti")
    if several.isEmpty() and rows.filter(F.col("key").isNull()).isEmpty():
        return kept

    @F.arrow_udf("binary")
    def set_of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([_set_id(shingles(words, width)) for words in word_hashes(batch)], pa.binary())

    odd = docs.join(several, own == F.col("_k"), "left_semi").unionByName(docs.filter(docs[key].isNull()))
    odd = odd.select(F.struct(*[F.col(c) for c in docs.columns]).alias("doc"), F.col(key).cast("bigint").alias("k"), set_of.asNondeterministic()(F.col(text).cast("binary")).alias("cls"))
    j = odd.join(first, F.col("cls") == F.col("_cls"), "left")
    odd = j.filter(F.col("cls").isNull() | (F.col("_cls").isNotNull() & F.col("k").eqNullSafe(F.col("_key")))).select("doc", "cls")
    odd = odd.filter(F.col("cls").isNull()).unionByName(odd.filter(F.col("cls").isNotNull()).dropDuplicates(["cls"]))
    return kept.unionByName(odd.select("doc.*"))


def _likely(a: str, b: str, least: float):
    @F.pandas_udf("boolean")
    def likely(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=bool)
        u, v = (np.frombuffer(b"".join(s), dtype=np.uint64).reshape(len(s), -1) for s in (x, y))
        return pd.Series(estimate(u, v) >= least)

    return likely(a, b)


def _meet(shared: DataFrame, facts: DataFrame, labels: DataFrame, least: float, percent: int) -> DataFrame:
    """Forest (a, b) of likely pairs of classes that share a bucket and lie in different components."""
    at = shared.select("bucket", "cls").join(labels, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    at = materialise(at, "members")
    sizes = at.groupBy("bucket", "component").agg(F.count("*").alias("m"))
    mixed = sizes.groupBy("bucket").agg(F.max(F.struct("m", "component"))["component"].alias("base"), F.sum("m").alias("m"), F.count("*").alias("parts")).filter(F.col("parts") > 1)
    d = at.join(mixed, "bucket").join(facts, "cls")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("cls"), blocks).cast("int")
    d = d.withColumn("visits", F.col("component") != F.col("base")).withColumn("own", own)
    d = d.withColumn("block", F.explode(F.when(F.col("visits"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array("own"))))
    d = d.select("bucket", "block", "cls", "n", "sig", "component", "visits", (F.col("own") == F.col("block")).alias("here"))
    return by_group(d, ["bucket", "block"], _across(least, percent), "a binary, b binary")


def _confirm_clusters(likely: DataFrame, facts: DataFrame, sets: DataFrame, labels: DataFrame, least: float, percent: int) -> DataFrame:
    """Confirmed links (a, b) between the components of each cluster of likely pairs."""
    clusters = materialise(components(likely, "a", "b").select(F.col("node").alias("cls"), F.xxhash64("component").alias("cluster")), "clusters")
    blocks = clusters.groupBy("cluster").agg(F.ceil(F.count("*") / SETS).cast("int").alias("blocks"))
    d = clusters.join(blocks, "cluster").join(labels, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    d = d.withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    d = d.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    d = d.join(facts, "cls").join(sets, "cls")
    d = d.select("cluster", "i", "j", "cls", "n", "sig", "items", "component", (F.col("own") == F.col("i")).alias("left"), (F.col("own") == F.col("j")).alias("right"))
    return by_group(d, ["cluster", "i", "j"], _settle(least, percent), "a binary, b binary")
