"""Alignment of two tokenizers over a corpus: which tokens of A and B end at the same bytes, and how often.

A is a byte-level BPE that encodes a space and the text, B a piece BPE that adds the space itself. Byte offsets where
both end cut their tokens into groups. A link joins the last token of A and the last token of B in a group: no others
end together.

* A-ids with the same bytes as a B-id are mapped once. A group of one A-token and its mapped B-token, the usual case, is
  counted in a vector as long as A's vocabulary, and looked up in that vector again.
* Only the links of other groups are pairs that cross the network. The ``HEAVY`` most frequent of those pairs go to every
  task as a table of that size, so no key of the join that is left holds many rows.

Texts with characters that A's Unicode tables may class otherwise than the faster encoder's go through A's own.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decant.llm.bytebpe import alphabet
from decant.llm.common import few
from decant.session import materialise

#: Pairs that are looked up in every task; all others are joined by shuffle.
HEAVY = 1 << 16
#: Fixed value: how pieces show a space.
SPACE = "\u2581"
#: Texts with characters outside these blocks are encoded by the tokenizer itself, as Unicode versions differ there.
ODD = re.compile("[^\u0000-\u0557\u0590-\u086f\u0900-\u0c5b\u0e00-\u208e\u20a0-\ua7cd\uac00-\uffff\U0001f000-\U0001faff]")

#: n_a, n_b, n_groups, groups as text, A-ids of mapped groups, other links (A-id in the high half)
Aligned = tuple[int, int, int, str, np.ndarray, np.ndarray]


class Side:
    """Bytes of a vocabulary's tokens and their lengths."""

    def __init__(self, tokens: list[bytes]):
        self.tokens, self.sizes = tokens, np.array([len(x) for x in tokens], dtype=np.int64)

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Aligner:
    """Both tokenizers, and the alignment of a text's tokens."""

    def __init__(self, path_a: str, path_b: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        back = {c: b for b, c in alphabet().items()}
        vocab = self.a.get_vocab()
        tokens = [b""] * self.a.get_vocab_size()
        for token, i in vocab.items():
            tokens[i] = bytes(back[ord(c)] for c in token) if all(ord(c) in back for c in token) else token.encode()
        self.side_a = Side(tokens)
        self.fast = self._ranked(path_a, tokens, pattern)

        self.b = SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.side_b = Side([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)])

        # the least of several B-ids with the same bytes; the others are pairs like any other
        ids = {x: i for i, x in reversed(list(enumerate(self.side_b.tokens))) if not (self.b.is_control(i) or self.b.is_unknown(i))}
        self.same = np.array([ids.get(x, -1) for x in tokens], dtype=np.int64)
        self.size = max(len(tokens), len(pieces))
        self.shown = [f"{i}{mark}" for mark in ",|;" for i in range(self.size)]

    def _ranked(self, path: str, tokens: list[bytes], pattern: str):
        """The same encoder from ranks, which is faster, if A's merges are its ids in order and lead to every token."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        whole = all(len(self.a.model.tokenize(t)) == 1 for t in model["vocab"])
        if made != sorted(made) or len(made) + 256 != len(model["vocab"]) or not whole:
            return None
        return tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks={tokens[i]: i for i in model["vocab"].values()}, special_tokens={})

    def texts(self, texts: list[str]) -> list[Aligned | None]:
        """Alignment of whole texts; None for those without tokens."""
        out = []
        for text, b in zip(texts, self.b.encode(texts, num_threads=1), strict=True):
            if not text:
                out.append(None)
                continue
            whole = " " + text
            raw = whole.encode()
            if self.fast is not None and (text.isascii() or not ODD.search(text)):
                a, same = self.fast.encode_ordinary(whole), True  # merging bytes loses none
            else:
                a = self.a.encode(whole, add_special_tokens=False).ids
                same = self.side_a.joined(a) == raw
            same = same and self.side_b.joined(b) == raw
            out.append(self.align(np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)) if same else None)
        return out

    def align(self, a: np.ndarray, b: np.ndarray) -> Aligned:
        """Groups between the offsets where tokens of both end; both join to the same bytes."""
        ends_a, ends_b = np.cumsum(self.side_a.sizes[a]), np.cumsum(self.side_b.sizes[b])
        at = np.searchsorted(ends_b, ends_a)
        last_a = np.flatnonzero(ends_b[at] == ends_a)
        last_b = at[last_a]
        n_a, n_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        link_a, link_b = a[last_a], b[last_b]
        mapped = (n_a == 1) & (n_b == 1) & (self.same[link_a] == link_b)
        # a group's A-ids stand behind the B-ids of the groups before it, its B-ids behind its own A-ids
        codes = np.empty(len(a) + len(b), dtype=np.int64)
        codes[np.arange(len(a)) + np.repeat(last_b + 1 - n_b, n_a)] = a
        codes[np.arange(len(b)) + np.repeat(last_a + 1, n_b)] = b
        codes[last_a + last_b + 1 - n_b] += self.size
        codes[last_a + last_b + 1] += 2 * self.size
        text = "".join(map(self.shown.__getitem__, codes.tolist()))[:-1]
        return len(a), len(b), len(last_a), text, link_a[mapped], (link_a << 32 | link_b)[~mapped]


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str, pattern: str) -> Aligner:
    """One aligner per worker process."""
    return Aligner(path_a, path_b, pattern)


def defaults(path_a: str | None, path_b: str | None, pattern: str | None) -> tuple[str, str, str]:
    import public_tokenizers as p

    return path_a or p.path("byte_bpe_50k.json"), path_b or p.path("piece_bpe_32k.model"), pattern or p.PATTERN


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), type=kind))


def align(docs: DataFrame, key: str = "doc_id", text: str = "text", with_groups: bool = False, **where) -> DataFrame:
    """Groups and links of each document, as a table still to be written (``row`` numbers the rows of that table).

    Columns: key, row, n_a, n_b, n_groups, groups_sha256, ``same`` and ``same_n`` (A-ids of mapped links and how often),
    ``pairs`` and ``pairs_n`` (other links, A-id in the high half). ``with_groups`` adds the groups as text. Null and
    empty texts, and texts whose tokens do not join to a space and the text, have no tokens: zeros and an empty string.
    """
    paths = defaults(where.get("path_a"), where.get("path_b"), where.get("pattern"))
    none = (0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(*paths)
        row = TaskContext.get().partitionId() << 33
        for b in few(batches, 64):
            found = [f or none for f in tool.texts([(t.as_py() or b"").decode("utf-8", "replace") for t in b.column(1)])]
            mapped, other = ([np.unique(f[i], return_counts=True) for f in found] for i in (4, 5))
            cols = [b.column(0), pa.array(np.arange(row, row + len(found)))]
            cols += [pa.array([f[i] for f in found], pa.int64()) for i in range(3)]
            cols.append(pa.array([hashlib.sha256(f[3].encode()).hexdigest() if f[2] else "" for f in found], pa.string()))
            cols += [_lists([m[0] for m in mapped], pa.int32()), _lists([m[1] for m in mapped], pa.int32())]
            cols += [_lists([m[0] for m in other], pa.int64()), _lists([m[1] for m in other], pa.int32())]
            if with_groups:
                cols.append(pa.array([f[3] for f in found], pa.string()))
            row += len(found)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    kinds = "key bigint, row bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, same array<int>, same_n array<int>, pairs array<bigint>, pairs_n array<int>"
    kinds += ", groups string" if with_groups else ""
    names = [k.split()[0] for k in kinds.split(", ")]
    return docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("binary").alias("text")).mapInArrow(run, kinds)


def same_counts(aligned: DataFrame, size: int) -> np.ndarray:
    """How many links hold each A-id with its mapped B-id: one vector per task, of which the entries above 0 are summed."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for b in batches:
            np.add.at(total, b.column(0).flatten().to_numpy(), b.column(1).flatten().to_numpy())
        a = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(total[a])], names=["a", "n"])

    out = np.zeros(size, dtype=np.int64)
    for r in aligned.select("same", "same_n").mapInArrow(run, "a bigint, n bigint").groupBy("a").agg(F.sum("n").alias("n")).collect():
        out[r["a"]] = r["n"]
    return out


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair`` and ``n``: how many links hold each other pair, summed in the tasks before the shuffle."""
    each = aligned.select(F.explode(F.arrays_zip("pairs", "pairs_n")).alias("p"))
    return each.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.pairs_n").alias("n"))


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", heavy: int = HEAVY, **where) -> DataFrame:
    """One row per document: tokens, groups and links, how many links are the best of their B-id, and the sum of counts.

    The count of an id pair is the number of links of all documents that hold it; a link is best if no other pair with its
    B-id counts more. See ``align`` for texts without tokens: they have zeros. Repeated rows count each and have a row
    each; null keys are kept; other columns are not read; empty input gives no rows.
    """
    paths = defaults(where.get("path_a"), where.get("path_b"), where.get("pattern"))
    tool = aligner(*paths)
    spark = docs.sparkSession
    aligned = materialise(align(docs, key, text, **where), "aligned")
    same = same_counts(aligned, len(tool.same))
    pairs = materialise(pair_counts(aligned), "pairs")

    # the best count of each B-id: as many numbers as B has ids
    best = np.zeros(len(tool.side_b.tokens), dtype=np.int64)
    mapped = np.flatnonzero(same)
    np.maximum.at(best, tool.same[mapped], same[mapped])
    of_b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    for r in pairs.groupBy(of_b.alias("b")).agg(F.max("n").alias("n")).collect():
        best[r["b"]] = max(best[r["b"]], r["n"])

    top = pairs.orderBy(F.desc("n"), "pair").limit(heavy).collect()
    known = np.array(sorted((r["pair"], r["n"]) for r in top), dtype=np.int64).reshape(-1, 2)
    shared = spark.sparkContext.broadcast((same, np.append(tool.same, -1), best, known[:, 0].copy(), known[:, 1].copy()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same, to_b, best, pair, count = shared.value
        for b in few(batches):
            sums, bests, rest, rest_n = [], [], [], []
            for a, a_n, p, p_n in zip(*(b.column(i) for i in range(1, 5)), strict=True):
                a, a_n, p, p_n = (x.values.to_numpy() for x in (a, a_n, p, p_n))
                at = np.searchsorted(pair, p)
                hit = at < len(pair)
                hit[hit] = pair[at[hit]] == p[hit]
                n, m = same[a], count[at[hit]]
                sums.append(int(n @ a_n.astype(np.int64) + m @ p_n[hit].astype(np.int64)))
                bests.append(int(a_n[n == best[to_b[a]]].sum() + p_n[hit][m == best[p[hit] & 0xFFFFFFFF]].sum()))
                rest.append(p[~hit])
                rest_n.append(p_n[~hit])
            cols = [b.column(0), pa.array(sums, pa.int64()), pa.array(bests, pa.int64()), _lists(rest, pa.int64()), _lists(rest_n, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=["row", "s", "m", "rest", "rest_n"])

    looked = aligned.select("row", "same", "same_n", "pairs", "pairs_n").mapInArrow(run, "row bigint, s bigint, m bigint, rest array<bigint>, rest_n array<int>")
    looked = materialise(looked, "looked")

    light = pairs if not len(known) else pairs.filter((F.col("n") < top[-1]["n"]) | ((F.col("n") == top[-1]["n"]) & (F.col("pair") > top[-1]["pair"])))
    table = spark.createDataFrame([(i, n) for i, n in enumerate(best.tolist()) if n], "b bigint, most bigint")
    light = light.withColumn("b", of_b).join(F.broadcast(table), "b").select("pair", F.col("n").alias("count"), (F.col("n") == F.col("most")).alias("is_best"))
    left = looked.select("row", F.explode(F.arrays_zip("rest", "rest_n")).alias("p")).select("row", F.col("p.rest").alias("pair"), F.col("p.rest_n").alias("times"))
    more = left.join(light, "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("count")).alias("s"), F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("m"))
    sums = looked.select("row", "s", "m").union(more).groupBy("row").agg(F.sum("s").alias("s"), F.sum("m").alias("m"))
    out = aligned.select("row", F.col("key").alias(key), "n_a", "n_b", "n_groups", "groups_sha256").join(sums, "row")
    return out.select(key, "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), F.col("m").alias("n_best"), F.col("s").alias("count_sum"), "groups_sha256")
