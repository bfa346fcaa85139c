"""Language identification with a string kernel.

Two texts are as similar as their sets of character n-grams (1 to 3, the blended spectrum): common n-grams over the
root of the product of the set sizes. A bounded sample of labelled texts gives landmarks; the kernel with them
(Nystroem features) enters one ridge regression against the rest per language. The kernel with all landmarks is linear
in the presence of n-grams, so the landmark products and the regression fold into one matrix, and texts are scored by
a product of their presence matrix, a batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decant.llm.common import join_checked
from decant.session import materialise

#: Bounds of the fit: labelled texts in the sample and landmarks among them, but ``EACH`` texts and ``MARKS`` landmarks of
#: every labelled language at least, however many there are.
SAMPLE, LANDMARKS, EACH, MARKS = 1600, 128, 6, 2
RIDGE = 1e-3
#: Sharpness of the soft maximum that turns regression values into a score.
SHARP = 4.0
#: Texts scored by one product.
BATCH = 128
UNKNOWN = "und"
#: Share of held-out labelled texts that a model must get right to decide anything, and the share of those that its least score admits.
RELIABLE, ADMIT = 0.9, 0.999
#: Steps of a score in which the least one is found.
STEPS = 10_000

#: Symbols: 32 is whatever is not a letter, 97 to 122 are the letters a to z, 0 to 31 share all other characters.
_SYMBOLS = 128
_TABLE = ((np.arange(1 << 16, dtype=np.uint64) * np.uint64(2654435761)) >> np.uint64(7)).astype(np.uint8) & np.uint8(31)
_TABLE[:128] = [c if chr(c).isalpha() else 32 for c in range(128)]
CODES = _SYMBOLS + _SYMBOLS**2 + _SYMBOLS**3


class Grams:
    """Distinct n-gram codes of whole texts."""

    def __init__(self) -> None:
        self.last = np.zeros(CODES, dtype=np.int32)

    def of(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        s = _TABLE[points & np.uint32(0xFFFF)].astype(np.int32)
        gap = s == 32
        s = s[~(gap & np.append(False, gap[:-1]))]
        pairs = s[:-1] * _SYMBOLS + s[1:]
        threes = pairs[:-1] * _SYMBOLS + s[2:] if len(s) > 2 else pairs[:0]
        codes = np.concatenate([s, pairs + _SYMBOLS, threes + (_SYMBOLS + _SYMBOLS**2)])
        # the last writer of each code marks one occurrence of it
        order = np.arange(len(codes), dtype=np.int32)
        self.last[codes] = order
        return codes[self.last[codes] == order]


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # n-grams of the landmarks, ascending
    weights: np.ndarray  # one row per n-gram, one column per language
    bias: np.ndarray


def fold(key: Column) -> Column:
    """crc32 of the key as text, modulo 3; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 3


def sample(docs: DataFrame, key: str, text: str, lang: str) -> list[tuple[str, np.ndarray]]:
    """Language and n-grams of ``SAMPLE`` labelled texts or ``EACH`` per language, equally many of all, least hash first.

    The hash takes in the text, so rows without a key are drawn one by one.
    """
    d = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(F.lit(7), F.col(key), F.col(text)).alias("h")).filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = materialise(d.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    languages = counts.count()
    if not languages:
        return []
    each = max(EACH, SAMPLE // languages)
    # three times as many as needed by hash, so that the window below sorts a bounded number of rows
    limits = counts.select("lang", F.least(F.lit(1.0), F.lit(3.0 * max(each, 30)) / F.col("n")).alias("limit"))
    few = join_checked(d, limits, "lang").filter(F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53)) < F.col("limit"))
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).filter(F.col("r") <= each)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Grams()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([g.of(t.as_py()).tobytes() for t in b.column(2)], pa.binary())], names=["lang", "r", "grams"])

    got = few.select("lang", "r", "text").mapInArrow(run, "lang string, r int, grams binary").collect()
    return [(x["lang"], np.sort(np.frombuffer(x["grams"], dtype=np.int32))) for x in sorted(got, key=lambda x: (x["r"], x["lang"]))]


def fit(texts: list[tuple[str, np.ndarray]]) -> Model:
    """Kernel ridge regression, one language against the rest, on landmark features. ``texts`` come in sampling order."""
    languages = sorted({k for k, _ in texts})
    marks = [g for _, g in texts[: max(LANDMARKS, MARKS * len(languages))]]
    codes = np.unique(np.concatenate(marks))
    presence = np.zeros((len(marks), len(codes)), dtype=np.float64)
    for i, g in enumerate(marks):
        presence[i, np.searchsorted(codes, g)] = 1 / np.sqrt(len(g))
    kernel = np.stack([presence[:, _rows(codes, g)].sum(axis=1) / np.sqrt(len(g)) for _, g in texts])
    values, vectors = np.linalg.eigh(presence @ presence.T)
    good = values > 1e-8 * values[-1]
    project = vectors[:, good] / np.sqrt(values[good])
    x = kernel @ project
    y = np.array([[1.0 if k == language else -1.0 for language in languages] for k, _ in texts])
    # every language weighs the same
    weight = np.array([1 / sum(k == j for j, _ in texts) for k, _ in texts])
    weight /= weight.mean()
    mean_x, mean_y = np.average(x, axis=0, weights=weight), np.average(y, axis=0, weights=weight)
    c = (x - mean_x) * weight[:, None]
    beta = np.linalg.solve(c.T @ (x - mean_x) + RIDGE * len(texts) * np.eye(x.shape[1]), c.T @ (y - mean_y))
    return Model(languages, codes, (presence.T @ (project @ beta)).astype(np.float32), mean_y - mean_x @ beta)


def _rows(codes: np.ndarray, grams: np.ndarray) -> np.ndarray:
    at = np.searchsorted(codes, grams)
    return at[(at < len(codes)) & (codes[np.minimum(at, len(codes) - 1)] == grams)]


def predict(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", keep_docs: bool = False) -> DataFrame:
    """Add ``lang_pred`` and ``score`` to each document; only its text counts, and only its text leaves the JVM.

    Texts that are null or have no letter are ``und`` with score 0, and so is everything under an empty model. With
    ``keep_docs`` all columns of ``docs`` stay. Repeated rows are predicted alike; empty input gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def classify(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m, g = shared.value, Grams()
        rows = np.full(CODES, -1, dtype=np.int32)
        if m is not None:
            rows[m.codes] = np.arange(len(m.codes), dtype=np.int32)
        for batch in texts:
            names, scores = [UNKNOWN] * len(batch), np.zeros(len(batch))
            for i in range(0, len(batch) if m is not None else 0, BATCH):
                part = batch.slice(i, BATCH)
                seen, size = np.zeros((len(part), len(m.codes)), dtype=np.float32), np.ones(len(part))
                some = [j for j, t in enumerate(part) if t.is_valid]
                for j in some:
                    grams = g.of(part[j].as_py())
                    at = rows[grams]
                    seen[j, at[at >= 0]] = 1
                    size[j] = len(grams)
                value = (seen @ m.weights) / np.sqrt(size)[:, None] + m.bias
                soft = np.exp(SHARP * (value - value.max(axis=1, keepdims=True)))
                best = value.argmax(axis=1)
                for j in some:
                    names[i + j], scores[i + j] = m.languages[best[j]], 1 / soft[j].sum()
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    d = docs if keep_docs else docs.select(key, text)
    letters = F.when(F.col(text).rlike(r"\p{L}"), F.col(text))
    # a filter on the result must not run the model a second time
    out = d.withColumn("_said", classify.asNondeterministic()(letters))
    return out.select(*(d.columns if keep_docs else [key]), F.col("_said.lang_pred").alias("lang_pred"), F.col("_said.score").alias("score"))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """Model of the documents outside the held-out fold; None if none of them has a language and a letter."""
    texts = sample(docs.filter(fold(F.col(key)) != 1), key, text, lang)
    return fit(texts) if texts else None


def least_score(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", lang: str = "lang") -> float | None:
    """Score from which a prediction counts: ``ADMIT`` of the held-out labelled texts that are predicted right reach it.

    All of the held-out fold whose language is learned is predicted and counted by score, in steps of 1 / ``STEPS``; only
    counts reach the driver. None where the model cannot decide: it has fewer than two languages, or the held-out labels
    are not known or not ``RELIABLE``.
    """
    if model is None or len(model.languages) < 2:
        return None
    held = docs.filter((fold(F.col(key)) == 1) & F.col(lang).isin(model.languages) & F.col(text).rlike(r"\p{L}"))
    said = predict(held.select(F.col(text).alias("text"), F.col(lang).alias("lang")), model, text="text", keep_docs=True)
    # sums in another order differ by less than the addend
    step = F.floor((F.col("score") + 1e-6) * STEPS).cast("int")
    counts = {r["step"]: r["n"] for r in said.groupBy(F.when(F.col("lang_pred") == F.col("lang"), step).alias("step")).agg(F.count("*").alias("n")).collect()}
    wrong = counts.pop(None, 0)
    right = sum(counts.values())
    if not right or right < RELIABLE * (right + wrong):
        return None
    below = int((1 - ADMIT) * (right - 1) + 1e-9)
    for step in sorted(counts):
        below -= counts[step]
        if below < 0:
            return step / STEPS - 1e-6


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Train on the documents outside the held-out fold and predict all of them."""
    out = predict(docs, train(docs, key, text, lang), key, text)
    return out.select(key, (fold(F.col(key)) == 1).alias("held_out"), "lang_pred", "score")
