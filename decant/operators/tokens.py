"""Corpus lines, vocabulary, encoding, prefix cutting, packing."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decant.functions import text as T
from decant.operators.prefix import prefix
from decant.session import attach, materialise, spread

# Special ids, then one id per byte, then learned pieces.
PAD, UNK, BOS, EOS, SEP = range(5)
BYTES_FROM = 5
PIECES_FROM = BYTES_FROM + 256
# Longest piece, share of characters that must be covered.
MAX_PIECE, COVERAGE = 6, 0.9995
SPACE = "▁"


def corpus_lines(items: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Tokeniser corpus of an item: question, context sentences, each candidate."""
    lines = f"concat(array(question), {T.sentences('context')}, candidates)"
    return items.selectExpr(*keep, f"posexplode({lines}) as (pos, line)")


# ---- vocabulary ----------------------------------------------------------------------------

def word_counts(lines: DataFrame, col: str = "line") -> DataFrame:
    """Distinct words with their counts, each led by the word-start mark; counted before they move."""
    w = lines.select(F.explode(F.split(col, r"\s+")).alias("w")).filter("w <> ''")
    return w.groupBy(F.concat(F.lit(SPACE), F.col("w")).alias("w")).agg(F.count(F.lit(1)).alias("c"))


def char_counts(words: DataFrame) -> DataFrame:
    ch = words.select(F.explode(F.split("w", "")).alias("ch"), "c").filter("ch <> ''")
    return ch.groupBy("ch").agg(F.sum("c").alias("n"))


def covered_chars(chars: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """Most frequent characters until the coverage is reached; as many rows as the script has characters."""
    w = Window.orderBy(F.desc("n"), "ch")
    d = chars.withColumn("before", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = chars.agg(F.sum("n").alias("total"))
    d = attach(d, total)
    return d.filter(F.col("before") < F.col("total") * coverage).select("ch", "n")


def mask_rare(words: DataFrame, rare: DataFrame) -> DataFrame:
    """Words with every rare character replaced by a blank; few words have one."""
    hit = words.select("w", F.explode(F.array_distinct(F.split("w", ""))).alias("ch")).filter("ch <> ''").join(F.broadcast(rare), "ch")
    hit = hit.groupBy("w").agg(F.array_join(F.collect_list("ch"), "").alias("bad"))  # at most one word's characters
    return words.join(hit, "w", "left").select(F.expr("if(bad is null, w, translate(w, bad, repeat(' ', length(bad))))").alias("w"), "c")


def piece_scores(words: DataFrame, max_len: int = MAX_PIECE) -> DataFrame:
    """Substrings of two to ``max_len`` characters without blanks, scored by count times length; built from distinct words."""
    subs = f"flatten(transform(sequence(1, length(w) - 1), i -> transform(sequence(2, least({max_len}, length(w) - i + 1)), l -> substr(w, i, l))))"
    p = words.filter("length(w) >= 2").selectExpr(f"explode({subs}) as piece", "c").filter("not contains(piece, ' ')")
    return p.groupBy("piece").agg(F.sum("c").alias("c")).withColumn("score", F.col("c") * F.length("piece"))


def learn_vocab(lines: DataFrame, size: int, col: str = "line") -> DataFrame:
    """(piece, score, id): covered characters first, then the best pieces made of covered characters only.

    The corpus is read once into a table of distinct words; everything after works on that table.
    """
    words = materialise(word_counts(lines, col), "words")
    chars = materialise(char_counts(words), "chars")
    cover = covered_chars(chars)
    rare = chars.join(cover.select("ch"), "ch", "left_anti").select("ch")
    best = piece_scores(spread(mask_rare(words, rare))).orderBy(F.desc("score"), "piece").limit(size)
    both = cover.select(F.col("ch").alias("piece"), F.col("n").alias("score"), F.lit(0).alias("kind")).unionByName(best.select("piece", "score", F.lit(1).alias("kind")))
    # at most ``size`` pieces and one row per character reach this numbering
    d = both.withColumn("id", F.row_number().over(Window.orderBy("kind", F.desc("score"), "piece")) + (PIECES_FROM - 1))
    return d.filter(F.col("id") < size).select("piece", "score", "id")


def encoder(df: DataFrame, vocab: DataFrame):
    """Arrow UDF text -> ids: greedy longest match per word, bytes for characters without a piece.

    The vocabulary has a size the caller set, so it is shipped to the tasks; words repeat, so each task
    remembers the words it has seen.
    """
    table = {r["piece"]: r["id"] for r in vocab.toLocalIterator()}
    shared = df.sparkSession.sparkContext.broadcast(table)
    limit = 200_000

    def word_ids(word: str, pieces: dict) -> list[int]:
        out, i = [], 0
        while i < len(word):
            for n in range(min(MAX_PIECE, len(word) - i), 0, -1):
                p = pieces.get(word[i:i + n])
                if p is not None:
                    out.append(p)
                    i += n
                    break
            else:
                out.extend(BYTES_FROM + b for b in word[i].encode())
                i += 1
        return out

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces, memo, unknown = shared.value, {}, np.array([UNK], dtype=np.int32).tobytes()
        for texts in batches:
            # ids of a batch stand in one buffer, four bytes each
            ids, ends = bytearray(), np.zeros(len(texts) + 1, dtype=np.int32)
            for i, t in enumerate(texts):
                start = len(ids)
                for w in (t.as_py() or "").split():
                    got = memo.get(w)
                    if got is None:
                        got = np.array(word_ids(SPACE + w, pieces), dtype=np.int32).tobytes()
                        if len(memo) < limit:
                            memo[w] = got
                    ids += got
                if len(ids) == start:
                    ids += unknown
                ends[i + 1] = len(ids) // 4
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(ids, dtype=np.int32)))

    return encode


# ---- token arrays --------------------------------------------------------------------------

def cut_prefix(question: str, context: str, width: int) -> str:
    """Question, separator, then the tail of the context; an overlong question is cut instead."""
    room = f"({width} - size({question}) - 1)"
    return (f"if(size({question}) + 1 >= {width}, array_append(slice({question}, 1, {width - 1}), {SEP}), "
            f"concat({question}, array({SEP}), slice({context}, greatest(size({context}) - {room}, 0) + 1, {room})))")


def paragraph_budget(lengths: str, limit: int) -> str:
    """Struct (tokens, used, truncated): paragraphs are taken whole until the limit; only a first one is ever cut."""
    start = "named_struct('s', 0, 'u', 0, 'stop', false)"
    step = (f"case when a.stop then a when a.u > 0 and a.s + int(n) > {limit} then named_struct('s', a.s, 'u', a.u, 'stop', true) "
            f"else named_struct('s', a.s + int(n), 'u', a.u + 1, 'stop', a.s + int(n) >= {limit}) end")
    done = f"named_struct('tokens', least(a.s, {limit}), 'used', a.u, 'truncated', a.s > {limit} or a.u < size({lengths}))"
    return f"aggregate({lengths}, {start}, (a, n) -> {step}, a -> {done})"


def pack(docs: DataFrame, width: int, order: Sequence[str], bucket: Column, group: Sequence[str] = ()) -> DataFrame:
    """Concatenate token arrays (``toks``) in order and cut the stream into rows of ``width``; the remainder is dropped.

    Each document learns its stream offset from a two-pass prefix sum and emits one slice per row it touches;
    a row gathers its slices, at most ``width`` tokens of them.
    """
    g = list(group)
    d = docs.withColumn("n", F.size("toks"))
    totals = d.groupBy(*g).agg(F.sum("n").alias("total"))
    d = prefix(d, list(order), bucket, g, rank=None, sums={"off": "n"})
    row = F.explode(F.sequence(F.floor(F.col("off") / width), F.floor((F.col("off") + F.col("n") - 1) / width)))
    d = d.filter("n > 0").withColumn("row_no", row)
    lo = F.greatest(F.col("row_no") * width, F.col("off"))
    hi = F.least((F.col("row_no") + 1) * width, F.col("off") + F.col("n"))
    part = d.select(*g, "row_no", lo.alias("lo"), F.slice("toks", (lo - F.col("off") + 1).cast("int"), (hi - lo).cast("int")).alias("t"))
    rows = part.groupBy(*g, "row_no").agg(F.expr("flatten(transform(array_sort(collect_list(struct(lo, t))), x -> x.t))").alias("tokens"))
    return rows.filter(F.size("tokens") == width)


def stop_at_target(docs: DataFrame, n_tokens: str, target: int, order: Sequence[str], bucket: Column, group: Sequence[str]) -> DataFrame:
    """Documents in order while the tokens before them stay below the target."""
    return prefix(docs, list(order), bucket, group, rank=None, sums={"before": n_tokens}, keep_below=("before", target))


def shard_stats(rows: DataFrame, width: int, kmax: int) -> DataFrame:
    """Shard statistics overall and per source: counted per source once, then rolled up."""
    hist = [F.count_if(F.col("k") == i).alias(f"k{i}") for i in range(2, kmax + 1)]
    c = rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("cut").alias("cut"), F.sum("prefix_len").alias("len"), F.count_if("has_gold").alias("gold"),
        F.count_if("cand_cut").alias("cand_cut"), F.sum("n_bytes").alias("b"), F.sum("n_tokens").alias("t"), *hist)
    s = c.rollup("source").agg(*[F.sum(x).alias(x) for x in c.columns if x != "source"])
    r = lambda a, b, n: F.round(F.col(a) / F.greatest(F.col(b), F.lit(1)), 6).alias(n)
    return s.select(F.coalesce("source", F.lit("all")).alias("source"), "n", r("cut", "n", "prefix_truncated_frac"), r("cand_cut", "n", "cand_truncated_frac"), r("len", "n", "mean_prefix_len"),
                    r("gold", "n", "gold_frac"), r("b", "t", "byte_frac"), *[f"k{i}" for i in range(2, kmax + 1)])
