"""From repeated label log-probabilities to one teacher distribution per item."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decant.functions import dist as D

# Fixed value: how far below the smallest observed log-probability a missing label is placed.
FLOOR_MARGIN = 1.0


def per_order(long: DataFrame, margin: float = FLOOR_MARGIN) -> DataFrame:
    """One row per item: ``orders`` holds, per display order, the log-probabilities in candidate order.

    ``long`` has (item_id, k, perm, cand_pos, logprob); a label token seen twice keeps its maximum and a
    missing label takes the floor. A group is one item: at most (orders x k) rows.
    """
    g = long.groupBy("item_id", "k").agg(F.collect_list(F.struct("perm", "cand_pos", "logprob")).alias("l"))
    found = "filter(l, x -> x.perm = p and x.logprob is not null)"
    fill = D.let(found, lambda f: (
        f"struct(p as perm, size({f}) as n_found, transform(sequence(0, k - 1), c -> coalesce("
        f"array_max(transform(filter({f}, y -> y.cand_pos = c), y -> y.logprob)), array_min(transform({f}, y -> y.logprob)) - {margin}D)) as lp, "
        f"{D.logsumexp(f'transform({f}, y -> y.logprob)')} as mass)"))
    return g.selectExpr("item_id", "k", f"transform(array_sort(array_distinct(transform(l, x -> x.perm))), p -> {fill}) as orders")


def aggregate(orders: DataFrame) -> DataFrame:
    """Mean over orders, renormalised. ``failed`` marks items where some order showed no label at all."""
    mean = "transform(sequence(0, k - 1), c -> aggregate(orders, 0D, (a, o) -> a + o.lp[c]) / size(orders))"
    d = orders.selectExpr("item_id", "k", "orders", "exists(orders, o -> o.n_found = 0) as failed", f"{mean} as mean_lp")
    d = d.selectExpr("*", f"{D.let(D.logsumexp('mean_lp'), lambda z: D.mapped('mean_lp', lambda x: f'{x} - {z}'))} as logits")
    return d.selectExpr("*", f"{D.softmax('logits')} as probs", "aggregate(orders, 0, (a, o) -> a + k - o.n_found) as n_filled")


def order_consistency(orders: DataFrame) -> DataFrame:
    """Share of items whose best candidate is the same in every display order."""
    same = f"size(array_distinct(transform(orders, o -> {D.argmax('o.lp')}))) = 1"
    return orders.selectExpr(f"{same} as same").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("same").cast("double")), 6).alias("consistency"))
