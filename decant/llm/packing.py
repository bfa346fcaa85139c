"""Best-fit packing of token sequences by exact complements.

Only lengths decide which pieces share a sequence, and there are at most ``capacity`` lengths, so the plan is made
from a histogram of that bounded size. A plan is a list of patterns with multiplicities. Pieces find their place by
their rank among the pieces of the same length.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decant.llm.common import few
from decant.operators.prefix import prefix
from decant.session import arrow_rows, materialise

#: Word parts whose ids a task keeps at a time; the memo only saves work.
MEMO = 250_000

PIECES = "key bigint, piece int, start bigint, length bigint, ids_crc32 bigint"

#: How the vocabulary cuts lower-case text, for the characters below; others take the tokenizer's own way.
PLAIN = re.compile(r"[^\t\n\r -~À-ÖØ-öø-ÿ]|<\|")
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")


class Encoder(dict):
    """Token ids of whole texts as little-endian unsigned 32-bit numbers.

    White space always ends a token here and merges never cross the parts of a word, so parts are encoded once and
    looked up. Words with characters beyond Latin-1, or with special tokens, go through the whole tokenizer.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.short = self.tokenizer.get_vocab_size() <= 1 << 16
        # the byte alphabet of the vocabulary: printable bytes stand for themselves, the rest follow from 256 on
        odd = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
        self.alphabet = {b: 256 + i for i, b in enumerate(odd)}

    def __missing__(self, part: str) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        # parts have no blanks or controls here, so ASCII stands for itself
        shown = part if part.isascii() else part.encode().decode("latin-1").translate(self.alphabet)
        ids = self[part] = np.array([t.id for t in self.model.tokenize(shown)], dtype="<u4").tobytes()
        return ids

    def __call__(self, text: str) -> bytes:
        if not PLAIN.search(text):
            return b"".join(map(self.__getitem__, PARTS.findall(text.lower())))
        return b"".join([self._whole(w) if PLAIN.search(w) else self(w) for w in text.split(" ")])

    def _whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()


def _narrow(ids: bytes, short: bool) -> bytes:
    return np.frombuffer(ids, dtype="<u4").astype("<u2").tobytes() if short else ids


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenise(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 2048, end: int = 0, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece of each document: ids of the whole text, the id ``end``, cut every ``capacity`` ids.

    Null and empty texts give one piece with ``end`` alone. ``with_ids`` adds the ids themselves, little endian: 16
    bits each if the vocabulary has no more, else 32. ``path`` must be readable on every executor.
    """
    where = path or default_path()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tail = Encoder(where), np.array([end], dtype="<u4").tobytes()
        step = 4 * capacity
        for b in few(batches):
            rows: list[tuple] = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = encode(t.as_py() or "") + tail
                for p, at in enumerate(range(0, len(ids), step)):
                    own = ids[at : at + step]
                    rows.append((k, p, at // 4, len(own) // 4, zlib.crc32(own), _narrow(own, encode.short) if with_ids else None))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            names = ["key", "piece", "start", "length", "ids_crc32", "ids"]
            n = 6 if with_ids else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols[:n], kinds[:n], strict=True)], names=names[:n])

    return docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).mapInArrow(run, PIECES + (", ids binary" if with_ids else ""))


def plan(histogram: Mapping[int, int], capacity: int = 2048) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how often each is used; together they use up the histogram.

    Longest first, a length takes the one, two or three lengths that fill its gap exactly, as often as all of them
    are available; an index of the sums of available pairs finds pairs and triples. What has no exact complement is
    packed best fit: the longest available length that fits goes in until none does.
    """
    have = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        have[length] = n
    out: list[tuple[tuple[int, ...], int]] = []

    def use(parts: list[int]) -> None:
        lengths, need = np.unique(parts, return_counts=True)
        n = int((have[lengths] // need).min())
        have[lengths] -= n * need
        out.append((tuple(sorted(parts, reverse=True)), n))

    for length in range(capacity, 0, -1):
        while have[length] and (more := _complement(have, length, capacity - length)) is not None:
            use([length, *more])
    for length in range(capacity, 0, -1):
        while have[length]:
            parts, left = [length], have.copy()
            left[length] -= 1
            gap = capacity - length
            while gap and (fits := np.flatnonzero(left[1 : gap + 1])).size:
                best = int(fits[-1]) + 1
                n = int(min(left[best], gap // best))
                parts += [best] * n
                left[best] -= n
                gap -= n * best
            use(parts)
    return out


def _complement(have: np.ndarray, length: int, gap: int) -> list[int] | None:
    """Up to three available lengths that fill ``gap`` exactly beside one ``length``; fewest first, longest first."""
    if gap == 0:
        return []
    left = have[: gap + 1].copy()
    left[0] = 0
    if length <= gap:
        left[length] -= 1
    if left[gap] > 0:
        return [gap]
    some = np.flatnonzero(left > 0)
    twice = np.flatnonzero(left > 1)
    pair = _pair(left, some, gap)
    if pair:
        return pair
    # sums of two available lengths, by the longer one; sums of a length with itself need two of it
    index = np.zeros(gap + 1, dtype=bool)
    for a in some[::-1]:
        rest = some[(some < a) & (some <= gap - a)]
        index[a + rest] = True
    index[2 * twice[twice <= gap // 2]] = True
    for a in some[::-1]:
        if index[gap - a]:
            left[a] -= 1
            pair = _pair(left, np.flatnonzero(left > 0), int(gap - a))
            left[a] += 1
            if pair:
                return [int(a), *pair]
    return None


def _pair(left: np.ndarray, some: np.ndarray, total: int) -> list[int] | None:
    a = some[(some < total) & (some >= total - some)]
    b = total - a
    ok = a[(left[b] > 0) & ((a != b) | (left[a] > 1))]
    return [int(ok[-1]), int(total - ok[-1])] if ok.size else None


def place(pieces: DataFrame, capacity: int = 2048, slices: int = 256) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (a written table: it is read twice).

    Ranks follow (hash slice of the key, key, piece, checksum), so a length that a third of all pieces have is
    numbered by many tasks. The table of places has a row per part of a pattern. Every use of a pattern exhausts the
    supply of a length, so it has a few rows per length at most, whatever the number of pieces.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places, used, base = [], dict.fromkeys(histogram, 0), 0
    for parts, n in plan(histogram, capacity):
        offset = 0
        for length in parts:
            places.append((length, used[length], used[length] + n, base, offset))
            used[length] += n
            offset += length
        base += n
    table = spark.createDataFrame(places, "length bigint, first bigint, past bigint, base bigint, offset bigint")
    ranked = prefix(pieces, ["key", "piece", "ids_crc32"], F.pmod(F.xxhash64("key"), F.lit(slices)), ["length"], rank="rank")
    at = F.col("rank") - 1
    placed = ranked.withColumnRenamed("length", "_l").join(F.broadcast(table), (F.col("_l") == F.col("length")) & (at >= F.col("first")) & (at < F.col("past")))
    return placed.select(*pieces.columns, (F.col("base") + at - F.col("first")).alias("sequence_id"), "offset")


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 2048, with_ids: bool = False, **how) -> DataFrame:
    """One row per piece of every document with its sequence and its offset there.

    Null and empty texts are one token long; repeated rows are packed each; null keys are kept. Only texts longer
    than ``capacity`` are cut. Other columns are not read. Empty input gives no rows.
    """
    with arrow_rows(docs.sparkSession):
        pieces = materialise(tokenise(docs, key, text, capacity, with_ids=with_ids, **how), "pieces")
    return place(pieces, capacity).withColumnRenamed("key", key)


def sequences(packed: DataFrame, key: str = "doc_id") -> DataFrame:
    """The packed sequences: their token ids and the documents in them. A sequence has ``capacity`` tokens at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", F.col(key).alias("doc_id"), "length", "ids")))
    s = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts"))
    ids = F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"]))
    return s.select("sequence_id", "n_tokens", F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"), F.transform("parts", lambda p: p["offset"]).alias("offsets"), ids.alias("ids"))
