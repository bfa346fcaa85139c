"""Distribution arithmetic over short arrays (one array per decision item).

The functions take SQL expressions and return SQL text for ``F.expr`` / ``selectExpr``: everything stays
inside the row (no explode, no shuffle) and a whole formula is parsed at once, which keeps planning cheap.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the distillation objective.
KD_TEMPERATURE = 2.0
W_KD_GOLD = 0.8
W_CE_GOLD = 0.2
# Probability floor and number of calibration bins.
P_FLOOR = "1e-300D"
ECE_BINS = 15

_ids = count()


def _names(n: int) -> list[str]:
    """Fresh lambda variable names, so nested formulas never capture each other's variables."""
    return [f"v{next(_ids)}" for _ in range(n)]


def let(value: str, body: Callable[[str], str]) -> str:
    """Bind ``value`` once inside an expression."""
    (v,) = _names(1)
    return f"element_at(transform(array({value}), {v} -> {body(v)}), 1)"


def mapped(a: str, body: Callable[[str], str]) -> str:
    (x,) = _names(1)
    return f"transform({a}, {x} -> {body(x)})"


def folded(a: str, body: Callable[[str], str]) -> str:
    """Sum of ``body(x)`` over the array."""
    acc, x = _names(2)
    return f"aggregate({a}, 0D, ({acc}, {x}) -> {acc} + {body(x)})"


def zipped(a: str, b: str, body: Callable[[str, str], str]) -> str:
    x, y = _names(2)
    return f"zip_with({a}, {b}, ({x}, {y}) -> {body(x, y)})"


def total(a: str) -> str:
    return folded(a, lambda x: x)


def softmax(a: str, temperature: float = 1.0) -> str:
    return let(f"array_max({a})", lambda m: let(
        mapped(a, lambda x: f"exp(({x} - {m}) / {float(temperature)}D)"),
        lambda e: let(total(e), lambda s: mapped(e, lambda v: f"{v} / {s}"))))


def logsumexp(a: str) -> str:
    return let(f"array_max({a})", lambda m: f"{m} + ln({folded(a, lambda x: f'exp({x} - {m})')})")


def entropy(p: str) -> str:
    return folded(p, lambda x: f"if({x} > 0, -{x} * ln({x}), 0D)")


def kl(pt: str, ps: str) -> str:
    """KL(pt || ps) with both sides floored."""
    return total(zipped(pt, ps, lambda a, b: f"if({a} > 0, {a} * (ln(greatest({a}, {P_FLOOR})) - ln(greatest({b}, {P_FLOOR}))), 0D)"))


def squared_distance(a: str, b: str) -> str:
    return total(zipped(a, b, lambda x, y: f"({x} - {y}) * ({x} - {y})"))


def argmax(a: str) -> str:
    """Lowest index of the maximum, from 0."""
    return f"cast(array_position({a}, array_max({a})) - 1 as int)"


def nll(p: str, index: str) -> str:
    """Negative log of the element at a 0-based index, null when the index is null."""
    return f"if({index} is null, null, -ln(greatest(get({p}, {index}), {P_FLOOR})))"


def brier(p: str, index: str) -> str:
    """Squared distance between ``p`` and the one-hot vector of ``index``; null when the index is null."""
    x, i = _names(2)
    hot = f"transform({p}, ({x}, {i}) -> pow({x} - if({i} = {index}, 1D, 0D), 2))"
    return f"if({index} is null, null, {total(hot)})"


def kd_term(student: str, teacher: str, temperature: float = KD_TEMPERATURE) -> str:
    return f"{temperature * temperature}D * {kl(softmax(teacher, temperature), softmax(student, temperature))}"


def composite(kd: str, ce: str, has_gold: str, w_kd: str | float = W_KD_GOLD, w_ce: str | float = W_CE_GOLD) -> str:
    return f"if({has_gold}, ({w_kd}) * {kd} + ({w_ce}) * {ce}, {kd})"


def ece_bin(conf: str, bins: int = ECE_BINS) -> str:
    return f"cast(least(floor(({conf}) * {bins}), {bins - 1}) as int)"


# ---- vectors -------------------------------------------------------------------------------

def dot(a: str, b: str) -> str:
    return total(zipped(a, b, lambda x, y: f"double({x}) * double({y})"))


def norm(a: str) -> str:
    return f"sqrt({folded(a, lambda x: f'double({x}) * double({x})')})"


def unit(a: str, floor: str = "1e-12D") -> str:
    return let(f"greatest({norm(a)}, {floor})", lambda n: mapped(a, lambda x: f"double({x}) / {n}"))


def cosine(a: str, b: str, floor: str = "1e-12D") -> str:
    return f"{dot(a, b)} / (greatest({norm(a)}, {floor}) * greatest({norm(b)}, {floor}))"


def ratio(num: Column, den: Column) -> Column:
    """Null-safe division: null operand or zero denominator gives null."""
    return num / F.nullif(den, F.lit(0))


def r6(sql: str, name: str) -> Column:
    """An expression rounded for comparison across engines."""
    return F.expr(f"round({sql}, 6)").alias(name)
