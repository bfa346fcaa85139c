"""Building decision items from raw rows: candidates, negatives, votes, orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from decant.functions import dist as D
from decant.functions import hashing as H


def permute(df: DataFrame, keys: str, arrays: Sequence[str], gold: str | None = "gold") -> DataFrame:
    """Reorder aligned arrays by per-candidate keys (SQL text); the gold position moves along."""
    order = f"transform(array_sort(transform({keys}, (h, i) -> struct(h, i))), s -> s.i) as _ord"
    moved = {a: f"transform(_ord, i -> get({a}, i)) as {a}" for a in arrays}
    if gold:
        moved[gold] = f"cast(array_position(_ord, {gold}) - 1 as int) as {gold}"
    return df.selectExpr("*", order).selectExpr(*[moved.get(c, f"`{c}`") for c in df.columns])


def hashed_order(k: str, *salt: str) -> str:
    """A shuffle of 0..k-1 fixed by the salt."""
    keyed = f"transform(sequence(0, {k} - 1), p -> struct({H.rank_text(*salt, 'p')} as h, p as p))"
    return f"transform(array_sort({keyed}), s -> s.p)"


def make_orders(k: str, n: int, item: str) -> str:
    """Up to ``n`` distinct display orders: identity, reverse, then hashed shuffles."""
    orders = [f"sequence(0, {k} - 1)", f"reverse(sequence(0, {k} - 1))"]
    orders += [hashed_order(k, "'order'", item, f"'{r}'") for r in range(2, n)]
    return f"array_distinct(array({', '.join(orders[:n])}))"


def mean_vectors(parts: Sequence[str]) -> str:
    acc = parts[0]
    for p in parts[1:]:
        acc = D.zipped(acc, p, lambda a, b: f"{a} + {b}")
    return D.mapped(acc, lambda x: f"{x} / {len(parts)}D")


def soft(v: str, digits: int = 4) -> str:
    """Votes as a distribution; uniform when nobody voted."""
    return D.let(D.total(v), lambda s: D.mapped(v, lambda x: f"round(if({s} > 0, {x} / {s}, 1D / size({v})), {digits})"))
