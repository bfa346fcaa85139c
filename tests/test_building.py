"""Item builders: what a row costs, and where it is paid."""

import random
import re

from pyspark.sql import functions as F

from decant.functions import text as T
from decant.operators import build as B
from decant.plans import building as P
from decant.session import even

COLUMNS = "k bigint, split string, correct string, direct string, tool_call string, request_for_info string, cannot_answer string, request string"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_answers_are_cleaned_once(spark, sf):
    for d in (P.mk_mcq(spark, sf).groupBy().count(), P.mk_build_all(spark, sf).filter("source = 'mcq'")):
        assert optimized(d).count("regexp_replace(") == len(B.ANSWER_KEYS)


def test_heavy_filters_stay_above_even_partitions(spark, sf):
    plan = optimized(P.mk_build_all(spark, sf).filter("source = 'mcq'"))
    assert plan.rindex("regexp_replace(") < plan.index("Repartition")
    d = even(spark.range(100).coalesce(1)).filter("id % 2 = 0")
    cores = spark.sparkContext.defaultParallelism
    assert d.columns == ["id"] and d.count() == 50 and d.rdd.getNumPartitions() == 2 * cores
    assert optimized(d).index("% 2") < optimized(d).index("Repartition")


def test_keyed_choice_keeps_what_differs(spark):
    r = random.Random(2)
    some = ["a", "a  b", "a\tb", " a b ", "a　b", "<|x|>", "[1]", "<TOOLCALL>[1]</TOOLCALL>", "x" * 241, " ", ""]
    rows = [(i, "val", r.choice([*B.ANSWER_KEYS, "nothing", None]), *(r.choice(some) for _ in range(4)), "q") for i in range(400)]
    d = spark.createDataFrame(rows, COLUMNS)
    clean = {k: T.clip(T.sanitize(T.toolcall(k) if k == "tool_call" else k), 240) for k in B.ANSWER_KEYS}
    texts = {x.k: x for x in d.selectExpr("k", "correct", "'' as nothing", *[f"{v} as {k}" for k, v in clean.items()]).collect()}
    got = {int(x.key): x for x in B.keyed_choice(d, "k", ["q"]).collect()}
    for i, _, correct, *given, _ in rows:
        fit = correct in B.ANSWER_KEYS and "" not in given
        every = sorted(texts[i][k] for k in B.ANSWER_KEYS)
        if i in got:
            shown = got[i].candidates
            assert fit and len(set(shown)) == len(shown) >= 3 and set(shown) <= set(every) and shown[got[i].gold] == texts[i][correct]
        else:
            assert not fit or len(set(every)) < 4
    assert {len(x.candidates) for x in got.values()} == {3, 4}


def test_squeeze_equals_its_pattern(spark):
    r = random.Random(4)
    given = ["".join(r.choice(" \t　ab\n") for _ in range(r.randrange(9))) for _ in range(3000)] + [None]
    d = spark.createDataFrame([(x,) for x in given], "x string")
    want = [x and re.sub("[ \t　]{2,}|[\t　]", " ", x) for x in given]
    for expr in (T.squeeze("x"), T.squeeze("concat(x, '')"), f"transform(array(x), v -> {T.squeeze('v')})[0]"):
        assert [x.y for x in d.select("x", F.expr(expr).alias("y")).collect()] == want
