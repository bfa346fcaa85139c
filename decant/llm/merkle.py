"""Merkle manifest of a dataset: leaf digests, subroots per source, one root, and a proof for every row.

The tree is computed by time-forward processing. Nodes are labelled so that children come before parents; a node sends
its digest, labelled with the receiver, into a priority queue, and whoever is next takes its messages from the front.
The queue is external: ``LEVELS`` levels of nodes form a block, messages between blocks lie in written tables, and
Spark's shuffle sort brings each block its messages in order of label. Inside a block a heap of at most
``ARITY ** LEVELS`` messages is the front of the queue.

The way back is the same sweep with labels reversed: the root sends an empty proof suffix, every node puts the siblings
of a child in front of what it got and sends that on, and leaves receive their whole proof. Blocks are recomputed there
rather than stored, so no table holds more than a digest per node or a suffix per block.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decant.llm.graph import by_group
from decant.operators.prefix import prefix
from decant.plans.registry import crc32_sql
from decant.session import materialise

ARITY, LEVELS = 3, 6
#: Fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Bytes of digests are hex text throughout.
HEX = 64


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(fields: Sequence[Column]) -> Column:
    """Digest of values, each as its length in bytes, a colon and the value; ``-`` stands for null."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*parts), 256)


def forward(digests: list[str], whole: bool, height: int = LEVELS) -> list[list[list[str]]]:
    """Children of every node of a block, by level from below: ``whole`` trees end at one node, others climb all levels.

    Labels are (level, index); the heap holds (label of the receiver, slot, digest).
    """
    levels, n = 0, len(digests)
    while n > 1 if whole else levels < height:
        levels, n = levels + 1, -(-n // ARITY)
    runs: list[list[list[str]]] = []
    queue = [(1, i // ARITY, i % ARITY, d) for i, d in enumerate(digests)] if levels else []
    while queue:
        level, index = queue[0][:2]
        run = []
        while queue and queue[0][:2] == (level, index):
            run.append(heapq.heappop(queue)[3])
        if len(runs) < level:
            runs.append([])
        runs[level - 1].append(run)
        if level < levels:
            heapq.heappush(queue, (level + 1, index // ARITY, index % ARITY, digest("".join(run))))
    return runs


def top(digests: list[str], whole: bool, height: int = LEVELS) -> str:
    runs = forward(digests, whole, height)
    return digest("".join(runs[-1][0])) if runs else digests[0]


def backward(runs: list[list[list[str]]], suffix: str) -> list[str]:
    """Path of every leaf of a block: siblings left and right of it (``left:right;``), level by level, and the suffix."""
    out: list[str] = []
    queue = [(-len(runs), 0, suffix)]
    while queue:
        level, index, path = heapq.heappop(queue)
        if not level:
            out.append(path)
            continue
        run = runs[-level - 1][index]
        for slot in range(len(run)):
            step = f"{''.join(run[:slot])}:{''.join(run[slot + 1 :])};"
            heapq.heappush(queue, (level + 1, index * ARITY + slot, step + path))
    return out


def proof(path: str) -> str:
    """Digest of all siblings on a path."""
    return digest(path.replace(":", "").replace(";", ""))


def fold(start: str, path: str) -> str:
    """Root that a leaf and its path lead to."""
    for step in path.split(";")[:-1]:
        left, _, right = step.partition(":")
        start = digest(left + start + right)
    return start


def _is_whole(block: int, n: int, height: int) -> bool:
    """A first block that is not full is the whole tree. A full one has one top after all levels in either case."""
    return block == 0 and n < ARITY**height


def numbered(df: DataFrame, order: Sequence[str], group: str) -> DataFrame:
    """Add ``pos``, the place of a row in its group, from 0; rows are sorted over all tasks, so a group may be of any size.

    Whole equal rows are dealt out by a drawn number; the sorted table is written before it is counted.
    """
    spread = df.sort(group, *order, F.rand(1)).withColumn("part", F.spark_partition_id())
    ranked = prefix(materialise(spread, "sorted"), list(order), F.col("part"), [group], rank="pos")
    return ranked.withColumn("pos", F.col("pos") - 1).drop("part")


def _blocks(nodes: DataFrame, height: int) -> DataFrame:
    """The block of each node, behind its tree."""
    return nodes.select("tree", F.expr(f"pos div {ARITY**height}").alias("block"), *[c for c in nodes.columns if c != "tree"])


def climb(nodes: DataFrame, height: int) -> list[DataFrame]:
    """Tables (tree, pos, digest) of nodes, every ``height`` levels from the leaves up to the roots, all written."""

    def run(t: pa.Table) -> pa.RecordBatch:
        t = t.sort_by("pos")
        block = t["block"][0].as_py()
        d = top(t["digest"].to_pylist(), _is_whole(block, t.num_rows, height), height)
        return pa.RecordBatch.from_arrays([pa.array([t["tree"][0].as_py()]), pa.array([block], pa.int64()), pa.array([d])], names=["tree", "pos", "digest"])

    out = [nodes]
    while not out[-1].filter("pos > 0").isEmpty():
        b = _blocks(out[-1].select("tree", "pos", "digest"), height)
        out.append(materialise(by_group(b, ["tree", "block"], run, "tree string, pos bigint, digest string"), "nodes"))
    return out


def _receive(nodes: DataFrame, suffixes: DataFrame, height: int) -> DataFrame:
    """Rows of each block with the suffix of its top, which comes first in order of ``pos``."""
    more = suffixes.select("tree", F.col("pos").alias("block"), F.lit(-1).cast("bigint").alias("pos"), F.col("path").alias("suffix"), "subroot")
    return _blocks(nodes, height).unionByName(more, allowMissingColumns=True)


def _paths(t: pa.Table, height: int) -> tuple[pa.Table, list[str], pa.Array]:
    """Nodes of a received block, in order, their paths, and the subroot that came with the suffix."""
    t = t.sort_by("pos")
    suffix, subroot, t = t["suffix"][0].as_py(), t["subroot"][0].as_py(), t.slice(1)
    paths = backward(forward(t["digest"].to_pylist(), _is_whole(t["block"][0].as_py(), t.num_rows, height), height), suffix)
    return t, paths, pa.array([subroot] * len(paths), pa.string())


def descend(tables: list[DataFrame], suffixes: DataFrame, height: int) -> DataFrame:
    """``suffixes`` (tree, path, subroot) of the roots, brought down to the tops of the lowest blocks, with their ``pos``."""

    def run(t: pa.Table) -> pa.RecordBatch:
        t, paths, subroot = _paths(t, height)
        return pa.RecordBatch.from_arrays([t["tree"].combine_chunks(), t["pos"].combine_chunks(), pa.array(paths, pa.string()), subroot], names=["tree", "pos", "path", "subroot"])

    at = suffixes.withColumn("pos", F.lit(0).cast("bigint"))
    for nodes in tables[-2:0:-1]:
        at = materialise(by_group(_receive(nodes, at, height), ["tree", "block"], run, "tree string, pos bigint, path string, subroot string"), "paths")
    return at


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "source", text: str = "text", fields: Sequence[str] = FIELDS, with_path: bool = False, height: int = LEVELS) -> DataFrame:
    """One row per document: its leaf, subroot and root, a digest of its proof, and what a tampered leaf folds to.

    A leaf is the digest of ``fields``. Leaves of a group ascend by key (null first, equal keys by leaf); subroots ascend
    by group (null first, by bytes). Every ``ARITY`` consecutive nodes become the digest of their digests until one is
    left; a lone leaf is its subroot, a lone subroot the root. Documents with an even crc32 of their key have the line
    ends of their text taken out before folding; a null key is not tampered with. Nulls in any field are ``-``. Repeated
    rows are leaves of their own with paths of their own; empty input gives no rows; other columns are not read.
    ``with_path`` adds the proof itself: ``left:right;`` by level. A block is ``height`` levels high.
    """
    changed = F.when(F.col("key").isNotNull() & (F.crc32(F.col("key").cast("string").cast("binary")) % 2 == 0) & F.contains("text", F.lit("\n")), F.replace("text", F.lit("\n"), F.lit("")))
    d = docs.select(docs[key].cast("bigint").alias("key"), docs[group].alias("group"), docs[text].alias("text"), *[docs[f].alias(f"f{i}") for i, f in enumerate(fields)])
    own = [F.col(f"f{i}") for i in range(len(fields))]
    d = d.withColumn("changed", changed)
    leaves = d.select(
        "key", F.when(F.col("group").isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), F.col("group"))).alias("tree"), leaf(own).alias("digest"),
        F.when(F.col("changed").isNotNull(), leaf([F.col("changed") if f == text else c for f, c in zip(fields, own, strict=True)])).alias("tampered"))
    leaves = materialise(numbered(leaves, ["key", "digest"], "tree"), "leaves")
    trees = climb(leaves, height)

    # the subroots are the leaves of one tree, in order of their names
    named = trees[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    over = materialise(numbered(named, ["name"], "tree"), "subroots")
    tops = climb(over, height)
    root = tops[-1].first()
    at = descend(tops, tops[-1].select("tree", F.lit("").alias("path"), F.lit(None).cast("string").alias("subroot")), height)

    def subroot_paths(t: pa.Table) -> pa.RecordBatch:
        t, paths, _ = _paths(t, height)
        return pa.RecordBatch.from_arrays([t["name"].combine_chunks(), pa.array(paths, pa.string()), t["digest"].combine_chunks()], names=["tree", "path", "subroot"])

    first = materialise(by_group(_receive(over, at, height), ["tree", "block"], subroot_paths, "tree string, path string, subroot string"), "paths")
    at = descend(trees, first, height)

    kinds = "key bigint, leaf string, subroot string, proof_sha256 string, folded_root string" + (", path string" if with_path else "")

    def leaf_rows(t: pa.Table) -> pa.RecordBatch:
        t, paths, subroot = _paths(t, height)
        own, tampered = t["digest"].to_pylist(), t["tampered"].to_pylist()
        folded = [fold(x or o, p) for o, x, p in zip(own, tampered, paths, strict=True)]
        cols = [t["key"].combine_chunks(), pa.array(own, pa.string()), subroot, pa.array(list(map(proof, paths)), pa.string()), pa.array(folded, pa.string())]
        cols += [pa.array(paths, pa.string())] if with_path else []
        return pa.RecordBatch.from_arrays(cols, names=[k.split()[0] for k in kinds.split(", ")])

    rows = by_group(_receive(leaves, at, height), ["tree", "block"], leaf_rows, kinds)
    out = rows.withColumn("root", F.lit(root["digest"] if root else None).cast("string"))
    return out.select(F.col("key").alias(key), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), *(["path"] if with_path else []))


def _sql(tree_levels: int = 25, over_levels: int = 12) -> str:
    """The manifest of ``documents`` for the checking engine: the levels of both trees, one named block each."""
    blocks: list[str] = []

    def value(x: str, text: bool = True) -> str:
        return f"coalesce({f'strlen({x})' if text else f'length({x}::VARCHAR)'} || ':' || {x}, '-')"

    def leaf_sql(text: str) -> str:
        return "sha256(" + " || ".join([value("doc_id", False), value("source"), value("lang"), value("n_chars", False), value(text)]) + ")"

    def levels(first: str, count: int, name: str) -> None:
        # r: digests of the whole run in order; s: the place in the run; a finished tree stands still
        blocks.append(f"{name}0 AS MATERIALIZED ({first})")
        for i in range(count):
            runs = f"SELECT tree, pos, digest, count(*) OVER (PARTITION BY tree) AS n, string_agg(digest, '') OVER (PARTITION BY tree, pos // {ARITY} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS r, pos % {ARITY} AS s FROM {name}{i}"
            blocks.append(f"{name}{i}r AS MATERIALIZED ({runs})")
            blocks.append(f"{name}{i + 1} AS MATERIALIZED (SELECT DISTINCT tree, pos // {ARITY} AS pos, CASE WHEN n = 1 THEN digest ELSE sha256(r) END AS digest FROM {name}{i}r)")

    def follow(name: str, count: int) -> str:
        """Expression list that extends proof p and folded value x of a node at pos through all levels of its tree."""
        source = f"{name}p"
        for i in range(count):
            left, right = f"substr(r.r, 1, {HEX} * r.s)", f"substr(r.r, {HEX} * (r.s + 1) + 1)"
            blocks.append(
                f"{name}p{i} AS MATERIALIZED (SELECT p.* EXCLUDE (place, p, x), p.place // {ARITY} AS place, CASE WHEN r.n = 1 THEN p.p ELSE p.p || {left} || {right} END AS p, "
                f"CASE WHEN r.n = 1 THEN p.x ELSE sha256({left} || p.x || {right}) END AS x FROM {source} p JOIN {name}{i}r r ON r.tree = p.tree AND r.pos = p.place)")
            source = f"{name}p{i}"
        return source

    blocks.append(f"d AS MATERIALIZED (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '+' || source END AS tree, {leaf_sql('text')} AS leaf, "
                  f"CASE WHEN {crc32_sql('doc_id::VARCHAR')} % 2 = 0 THEN {leaf_sql(chr(34) + 'changed' + chr(34))} ELSE {leaf_sql('text')} END AS x FROM (SELECT *, replace(text, chr(10), '') AS changed FROM documents))")
    blocks.append("n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d)")
    levels("SELECT tree, pos, leaf AS digest FROM n", tree_levels, "t")
    blocks.append(f"s AS MATERIALIZED (SELECT tree AS name, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos FROM t{tree_levels})")
    levels("SELECT '' AS tree, pos, subroot AS digest FROM s", over_levels, "o")
    blocks.append("tp AS MATERIALIZED (SELECT doc_id, tree, leaf, pos AS place, '' AS p, x FROM n)")
    below = follow("t", tree_levels)
    blocks.append(f"op AS MATERIALIZED (SELECT b.doc_id, b.leaf, s.subroot, '' AS tree, s.pos AS place, b.p, b.x FROM {below} b JOIN s ON s.name = b.tree)")
    above = follow("o", over_levels)
    return "WITH " + ",\n".join(blocks) + f"\nSELECT a.doc_id, a.leaf, a.subroot, o.digest AS root, sha256(a.p) AS proof_sha256, a.x AS folded_root, a.x = o.digest AS verified FROM {above} a JOIN o{over_levels} o ON true"


SQL = _sql()
