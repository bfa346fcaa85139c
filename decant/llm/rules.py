"""Quality rules: base counts, and the distance of a document's histograms from its language's.

Built-in expressions only. Two histograms of a document are compared with a reference by Jensen-Shannon distance
(base 2, so 0 to 1): its characters by class, and its words over the language's most common words and a rest. The
references are the sums over all documents of a language. Distances of short texts are noise, so each comparison has
a least length below which it passes. A document whose language has no reference is held against all documents, by
classes in which scripts do not differ (digits, symbols and all else) and not by words. A text with hardly any of
its language's common words is not far by this distance, so their number has a limit of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decant.llm.common import join_checked, word_list
from decant.session import attach, materialise

#: Words in a window of the repetition rule.
SPAN = 5
#: Common words of a language.
COMMON = 32
#: Least characters and words for the two comparisons, and how many times as many a language needs for its references.
LEAST_CHARS, LEAST_WORDS, ENOUGH = 200, 50, 20
#: Distances beyond which a document fails.
FAR_CHARS, FAR_WORDS = 0.3, 0.5
#: A document also fails with less than this share of the common words to expect at its length, if those are enough.
#: On sf0.1, 310 of 8,861 documents lie below, 43 more below half, all others around 1.
FEW, EXPECTED = 0.1, 20

CLASSES = ("lower", "upper", "digit", "space", "symbol", "other")


def _repeated() -> tuple[str, str, str, str]:
    """SQL of four steps over words ``w`` and their hashes ``h``: a hash per window, sorted window codes, positions of
    repeated windows, words they cover.

    Every word is hashed once, a window is the hash of its words' hashes. If all windows differ, as in most texts, the
    other steps see nothing. Else a code is a window's hash with its position in the low bits (as many as the text
    needs): windows that occur twice are neighbours after sorting, and equal hashes are confirmed on the words. Two
    different windows between two equal ones, with one hash in the bits that are left (64 less those of the position),
    would hide a repeat: in texts below a million words, each one with a chance below 1 in 10^7.
    """
    n, words = f"(size(h) - {SPAN} + 1)", ", ".join(f"h[i + {k}]" for k in range(SPAN))
    windows = f"if({n} < 2, cast(array() as array<bigint>), transform(sequence(0, greatest({n}, 2) - 1), i -> xxhash64({words})))"
    codes = """if(size(array_distinct(g)) = size(g), cast(array() as array<bigint>),
        sort_array(transform(g, (x, i) -> shiftleft(shiftrightunsigned(x, length(bin(size(w)))), length(bin(size(w)))) | cast(i as bigint))))"""
    same = f"slice(w, cast(p & bits as int) + 1, {SPAN}) = slice(w, cast(q & bits as int) + 1, {SPAN})"
    near = " or ".join(f"exists(array(get(codes, j {d})), q -> q is not null and ((p ^ q) & ~bits) = 0 and {same})" for d in ("- 1", "+ 1"))
    positions = f"""array_sort(transform(filter(codes, (p, j) -> exists(array(shiftleft(1L, length(bin(size(w)))) - 1), bits -> {near})),
        p -> p & (shiftleft(1L, length(bin(size(w)))) - 1)))"""
    covered = f"aggregate(positions, named_struct('past', 0L, 'n', 0L), (a, p) -> named_struct('past', p + {SPAN}, 'n', a.n + p + {SPAN} - greatest(p, a.past)), a -> a.n)"
    return windows, codes, positions, covered


def measure(docs: DataFrame, text: str = "text", common: str | None = None) -> DataFrame:
    """Add the base counts, ``chars`` (characters by class) and, given the column of common words, ``words`` (their counts, then the rest).

    Null texts count as empty: all zero.
    """
    windows, codes, positions, covered = _repeated()
    d = docs.withColumn("t", F.coalesce(F.col(text), F.lit(""))).withColumn("w", word_list(F.col(text)))
    d = d.withColumn("h", F.expr("transform(w, x -> xxhash64(x))"))
    d = d.withColumn("g", F.expr(windows))
    d = d.withColumn("codes", F.expr(codes))
    # a common word with a space on either side stands in the joined words as often as in the text
    joined = "concat(' ', array_join(w, '  '), ' ')" if common else "''"

    def size_of(rx: str) -> Column:
        return F.length(F.regexp_replace("t", rx, "")).cast("bigint")

    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select(
        *docs.columns, F.expr(positions).alias("positions"), F.expr(joined).alias("joined"), lines.alias("lines"),
        F.size("w").cast("bigint").alias("n_words"), F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        size_of(r"[^#*$%&|<>]+").alias("n_symbols"), F.length("t").cast("bigint").alias("n_chars"),
        size_of(r"\P{Ll}+").alias("lower"), size_of(r"\P{Lu}+").alias("upper"), size_of(r"[^0-9]+").alias("digit"),
    )
    space = F.col("n_chars") - F.col("word_chars")
    chars = [F.col("lower"), F.col("upper"), F.col("digit"), space, F.col("n_symbols")]
    counts = f"transform({common}, x -> cast((octet_length(joined) - octet_length(replace(joined, concat(' ', x, ' '), ''))) div (octet_length(x) + 2) as bigint))"
    rest = f"concat(c, array_repeat(0L, {COMMON} - size(c)), array(n_words - aggregate(c, 0L, (a, x) -> a + x)))"
    return d.select(
        *docs.columns, "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"), F.expr(covered).alias("n_repeat_words"),
        F.array(*chars, F.col("n_chars") - sum(chars[1:], chars[0])).alias("chars"),
        *([] if common is None else [F.expr(f"get(transform(array({counts}), c -> {rest}), 0)").alias("words")]),
    )


def common_words(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """Every language with its ``COMMON`` most frequent words (``common``), most frequent first."""
    words = docs.filter(F.col(lang) != "").select(F.col(lang).alias("lang"), F.explode(word_list(F.col(text))).alias("w"))
    counts = words.groupBy("lang", "w").agg(F.count("*").alias("n"))
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))).filter(F.col("r") <= COMMON)
    lists = top.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "w"))), lambda x: x["w"]).alias("common"))
    return materialise(lists, "common")


def _shares(c: str, n: int, least: int) -> Column:
    sums = [F.sum(F.col(c)[i]) for i in range(n)]
    total = sum(sums[1:], sums[0])
    return F.when(total >= ENOUGH * least, F.array(*[x / total for x in sums])).alias(f"ref_{c}")


def references(measures: DataFrame) -> DataFrame:
    """Every language with the shares of its characters (``ref_chars``) and words (``ref_words``); null where it has too few."""
    refs = measures.filter(F.col("lang") != "").groupBy("lang").agg(_shares("chars", len(CLASSES), LEAST_CHARS), _shares("words", COMMON + 1, LEAST_WORDS))
    return materialise(refs, "references")


def script_free(p: str) -> Column:
    """Digits, symbols and all else of the shares of character classes."""
    return F.array(F.col(p)[2], F.col(p)[4], F.col(p)[0] + F.col(p)[1] + F.col(p)[3] + F.col(p)[5])


def distance(p: str, q: str) -> Column:
    """Jensen-Shannon distance of two histograms of equal length that sum to 1, as SQL names of their arrays."""
    half = "if(x = 0, 0D, x * log2(2 * x / (x + y))) + if(y = 0, 0D, y * log2(2 * y / (x + y)))"
    return F.sqrt(F.greatest(F.lit(0.0), F.expr(f"aggregate(zip_with({p}, {q}, (x, y) -> {half}), 0D, (a, v) -> a + v) / 2")))


def judge(docs: DataFrame, key: str = "doc_id", lang: str = "lang", text: str = "text") -> DataFrame:
    """Base counts, ``base_failed``, both distances and ``kept`` of every document.

    A distance is null where its guard applies, and passes. Null texts are empty and fail the base rule; documents
    without a language, or whose language has too little text, have only the distance of script-free classes from all
    documents; repeated rows are judged alike and count in the references each. Other columns are not read. Empty input gives no rows.
    """
    d = docs.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    m = materialise(measure(join_checked(d, common_words(d), "lang", "left"), "text", "common").drop("text", "common"), "measures")
    m = attach(join_checked(m, references(m), "lang", "left"), m.agg(_shares("chars", len(CLASSES), LEAST_CHARS).alias("all_chars")))
    n_chars = F.aggregate("chars", F.lit(0).cast("bigint"), lambda a, x: a + x)
    m = m.withColumn("p_chars", F.transform("chars", lambda x: x / F.greatest(n_chars, F.lit(1)))).withColumn("p_words", F.transform("words", lambda x: x / F.greatest("n_words", F.lit(1))))
    m = m.withColumn("p_free", script_free("p_chars")).withColumn("all_free", script_free("all_chars"))
    m = m.withColumn("chars_js", F.when(n_chars >= LEAST_CHARS, F.when(F.col("ref_chars").isNotNull(), distance("p_chars", "ref_chars")).when(F.col("all_chars").isNotNull(), distance("p_free", "all_free"))))
    m = m.withColumn("words_js", F.when(F.col("ref_words").isNotNull() & (F.col("n_words") >= LEAST_WORDS), distance("p_words", "ref_words")))
    expected = F.col("n_words") * (1 - F.col("ref_words")[COMMON])
    few = F.coalesce((expected >= EXPECTED) & (F.col("n_words") - F.col("words")[COMMON] < FEW * expected), F.lit(False))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    far = (F.coalesce("chars_js", F.lit(0.0)) > FAR_CHARS) | (F.coalesce("words_js", F.lit(0.0)) > FAR_WORDS) | few
    return m.select(
        F.col("key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~far).alias("kept"), "chars_js", "words_js",
    )
