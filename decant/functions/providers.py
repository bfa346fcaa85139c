"""Extension points for models: embedding and scoring providers that work on a batch of rows.

A provider is a small picklable object; Spark decides where and on which rows it runs. The built-in ones
need no network and no weights, and treat every text on its own, whatever else is in the batch.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class EmbeddingProvider(Protocol):
    dims: int

    def embed(self, texts: Sequence[str]) -> np.ndarray: ...


class LabelScorer(Protocol):
    def label_logprobs(self, context: str, question: str, shown: Sequence[str]) -> list[float | None]: ...


class NgramEmbedding:
    """Signed counts of hashed character n-grams, unit length."""

    def __init__(self, dims: int = 64, sizes: Sequence[int] = (2, 3)):
        self.dims, self.sizes = dims, tuple(sizes)

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims))
        for row, text in zip(out, texts):
            data = f" {text} ".encode()
            for n in self.sizes:
                for i in range(len(data) - n + 1):
                    h = zlib.crc32(data[i:i + n])
                    row[h % self.dims] += 1.0 if h & (1 << 20) else -1.0
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


class OverlapScorer:
    """Log-probability of a label from shared words, with a small preference for the first position."""

    def label_logprobs(self, context: str, question: str, shown: Sequence[str]) -> list[float | None]:
        asked = set(f"{context} {question}".lower().split())
        raw = np.array([4.0 * len(asked & set(c.lower().split())) / max(1, len(set(c.lower().split()))) for c in shown])
        raw[0] += 0.3
        lp = raw - raw.max() - np.log(np.exp(raw - raw.max()).sum())
        return [None if len(c) % 11 == 0 else float(x) for c, x in zip(shown, lp)]


PROVIDERS: dict[str, Callable[[], EmbeddingProvider]] = {
    "ngram64": lambda: NgramEmbedding(64), "ngram32-long": lambda: NgramEmbedding(32, (3, 4)),
}


def embed(strings: DataFrame, provider: str | EmbeddingProvider, ident: str = "uid", text: str = "text") -> DataFrame:
    """(id, vec) for unique strings; a provider that returns the wrong shape or a non-finite number fails the task."""
    model = PROVIDERS[provider]() if isinstance(provider, str) else provider
    kind = dict(strings.dtypes)[ident]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            v = np.asarray(model.embed(b[text].tolist()), float)
            if v.shape != (len(b), model.dims) or not np.isfinite(v).all():
                raise ValueError(f"provider returned {v.shape} for {len(b)} texts")
            yield pd.DataFrame({ident: b[ident].to_numpy(), "vec": list(v)})

    return strings.select(ident, text).mapInPandas(run, f"{ident} {kind}, vec array<double>")


def label_table(items: DataFrame, scorer: LabelScorer, orders: int = 2) -> DataFrame:
    """Long table (item_id, k, perm, cand_pos, logprob): every item scored in its display orders, context read once per item."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for item_id, ctx, ask, cands in zip(b["item_id"], b["context"], b["question"], b["candidates"]):
                ident = list(range(len(cands)))
                for perm, order in enumerate((ident, ident[::-1])[:orders]):
                    lps = scorer.label_logprobs(ctx, ask, [cands[i] for i in order])
                    rows += [(item_id, len(cands), perm, c, lp) for c, lp in zip(order, lps)]
            yield pd.DataFrame(rows, columns=["item_id", "k", "perm", "cand_pos", "logprob"]).astype({"logprob": "float64"})

    return items.select("item_id", "context", "question", "candidates").mapInPandas(run, "item_id bigint, k int, perm int, cand_pos int, logprob double")
