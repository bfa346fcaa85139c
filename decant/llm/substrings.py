"""Removal of repeated passages by winnowed blocks and window hashes, in place of a relative Lempel-Ziv parse.

No factor is extended to its longest match. A document is cut into blocks that are found in documents with smaller ids. A passage of ``WINDOW`` words is
long enough to count. In each such window the anchor, the ``SEED`` words with the least hash, is chosen by content
alone, so equal windows have equal anchors, wherever they stand. Neighbouring windows with one anchor make a block:
all words of these windows.

* Index: the first document (least id) of every distinct block. A block whose first holder is an earlier document is a
  factor, and all its words are covered: every window in it starts in that earlier document. Adjoining factors join.
* Factor boundaries: where the surroundings of an anchor differ between documents, blocks differ although some of
  their windows are equal. The windows of those blocks, in the first holder of each, are looked up one by one.

Together that finds every window that also starts in an earlier document. No step sees more than sums per block and a
document at a time, so a passage may stand in a third of all documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decant.llm.minhash import Words, mix
from decant.session import materialise

WINDOW, SEED = 50, 12
#: Odd multipliers of the two rolling hashes, and what separates their word values.
_BASE = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F]
_LANE = np.uint64(0x165667B19E3779F9)


class Rolling:
    """128-bit hashes of any run of words: sums of word hashes times powers, brought to a common power."""

    def __init__(self) -> None:
        self.words, self.size = Words(), 0

    def _grow(self, n: int) -> None:
        if n > self.size:
            self.size = max(n, 2 * self.size, 4096)
            ones = np.ones(self.size, dtype=np.uint64)
            ones[0] = 1
            self.up, self.down = [], []
            for b in _BASE:
                for out, factor in ((self.up, b), (self.down, pow(b, -1, 1 << 64))):
                    powers = np.full(self.size, factor, dtype=np.uint64)
                    powers[0] = 1
                    out.append(np.multiply.accumulate(powers))

    def load(self, words: list[bytes]) -> int:
        self._grow(len(words) + 1)
        w = self.words.of(words)
        self.sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(v * up[: len(v)], dtype=np.uint64)]) for v, up in zip((w, mix(w ^ _LANE)), self.up, strict=True)]
        return len(words)

    def of(self, start: np.ndarray, end: np.ndarray, lane: int) -> np.ndarray:
        s = self.sums[lane]
        return mix((s[end] - s[start]) * self.down[lane][start])

    def blocks(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchor hash, start and end (in words) of every block of the loaded text of ``n`` words."""
        if n < WINDOW:
            none = np.zeros(0, np.int64)
            return none.astype(np.uint64), none, none
        at = np.arange(n - SEED + 1)
        seeds = self.of(at, at + SEED, 0)
        reach = WINDOW - SEED + 1
        view = np.lib.stride_tricks.sliding_window_view(seeds, reach)
        # argmin copies what it looks at, so a long text is looked at in parts
        chosen = np.concatenate([view[i : i + 8192].argmin(axis=1) for i in range(0, len(view), 8192)]) + at[: n - WINDOW + 1]
        first = np.flatnonzero(np.diff(chosen, prepend=-1))
        last = np.append(first[1:], len(chosen)) - 1
        return seeds[chosen[first]], first, last + WINDOW


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of few documents: what a task holds follows the longest of them."""
    for b in batches:
        for i in range(0, b.num_rows, 256):
            yield b.slice(i, 256)


def _blocks(docs: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Rolling()
        for b in _parts(batches):
            out: list[list[np.ndarray]] = [[] for _ in range(6)]
            for k, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                anchor, start, end = r.blocks(r.load(t.as_py().split()))
                cols = (anchor.view(np.int64), r.of(start, end, 0).view(np.int64), r.of(start, end, 1).view(np.int64), np.full(len(start), k), start, end)
                for o, c in zip(out, cols, strict=True):
                    o.append(c)
            full = [np.concatenate(o) if o else np.zeros(0, np.int64) for o in out]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32 if i > 3 else np.int64)) for i, c in enumerate(full)], names=["anchor", "x", "y", "key", "start", "end"])

    return docs.mapInArrow(run, "anchor bigint, x bigint, y bigint, key bigint, start int, end int")


def _windows(docs: DataFrame) -> DataFrame:
    """Every window of the given blocks of each document, wherever they recur in it: its hash, the key, its start."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Rolling()
        for b in _parts(batches):
            out: list[list[np.ndarray]] = [[] for _ in range(4)]
            for k, t, blocks in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                _, start, end = r.blocks(r.load(t.as_py().split()))
                wanted = np.isin(r.of(start, end, 0).view(np.int64), np.asarray(blocks.values))
                start, n = start[wanted], end[wanted] - start[wanted] - WINDOW + 1
                at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
                for o, c in zip(out, (r.of(at, at + WINDOW, 0).view(np.int64), r.of(at, at + WINDOW, 1).view(np.int64), np.full(len(at), k), at), strict=True):
                    o.append(c)
            full = [np.concatenate(o) if o else np.zeros(0, np.int64) for o in out]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32 if i > 2 else np.int64)) for i, c in enumerate(full)], names=["x", "y", "key", "start"])

    return docs.mapInArrow(run, "x bigint, y bigint, key bigint, start int")


def duplicate_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``spans``: the words [start, end) covered by windows that also start under a smaller key.

    Spans may overlap. Texts that are null or shorter than a window have none; a null key is neither smaller nor
    larger than any; rows with one key are one document. Only documents with spans have a row.
    """
    d = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("binary").alias("text")).filter(F.col("key").isNotNull() & F.col("text").isNotNull())
    blocks = materialise(_blocks(d), "blocks")
    index = materialise(blocks.groupBy("anchor", "x", "y").agg(F.min("key").alias("_first"), F.max("key").alias("_last")), "index")
    copied = index.filter(F.col("_last") > F.col("_first")).drop("_last")
    factors = blocks.join(copied, ["anchor", "x", "y"]).filter(F.col("key") > F.col("_first")).select("key", "start", "end")

    several = index.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    edges = index.join(several, "anchor").groupBy(F.col("_first").alias("key")).agg(F.collect_list("x").alias("blocks"))
    windows = materialise(_windows(d.join(edges, "key").select("key", "text", "blocks")), "windows")
    found = windows.groupBy("x", "y").agg(F.min("key").alias("_first"), F.max("key").alias("_last")).filter(F.col("_first") < F.col("_last")).drop("_last")
    singles = windows.join(found, ["x", "y"]).filter(F.col("key") > F.col("_first")).select("key", "start", (F.col("start") + WINDOW).alias("end"))
    return factors.union(singles).groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans")).withColumnRenamed("key", key)


def _cut(words: list, spans) -> list:
    """Words outside the spans."""
    mark = np.zeros(len(words) + 1, dtype=np.int64)
    f = spans.values.flatten()
    ok = np.asarray(f[0]) < len(words)  # rows with one key and different texts
    np.add.at(mark, np.asarray(f[0])[ok], 1)
    np.add.at(mark, np.minimum(np.asarray(f[1])[ok], len(words)), -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(mark[:-1]) == 0)]


def strip(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``n_words``, ``n_removed``, the ``kept`` words joined by one space and their checksum.

    See ``duplicate_spans``; null texts have no words. Other columns are not read. Empty input gives no rows.
    """
    spans = duplicate_spans(docs, key, text).select(F.col(key).alias("_key"), "spans")
    d = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("binary").alias("text"))
    j = d.join(spans, F.col("key") == F.col("_key"), "left").select("key", "text", "spans")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            n, removed, kept, sha = [], [], [], []
            for t, s in zip(b.column(1), b.column(2), strict=True):
                words = (t.as_py() or b"").split()
                left = _cut(words, s) if s.is_valid else words
                whole = b" ".join(left)
                n.append(len(words))
                removed.append(len(words) - len(left))
                kept.append(whole.decode("utf-8", "replace"))
                sha.append(hashlib.sha256(whole).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(sha, pa.string())], names=["key", "n_words", "n_removed", "kept", "kept_sha256"])

    return j.mapInArrow(run, "key bigint, n_words bigint, n_removed bigint, kept string, kept_sha256 string").withColumnRenamed("key", key)
