"""Power, temperature and interval analysis of sampled telemetry.

A card may own most samples, so every ordered pass works on (card, time bucket) pieces and carries only the
edge of a piece over to the next one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decant.operators.prefix import neighbours, prefix

HOUR = 3_600_000_000
# Pause at or above, resume at or below (degrees).
TEMP_PAUSE, TEMP_RESUME = 88.0, 78.0


def time_bucket(ts: str = "ts_us", width_us: int = 24 * HOUR) -> Column:
    return F.floor(F.col(ts) / width_us).cast("bigint")


def segments(samples: DataFrame, keys: Sequence[str] = ("card",), order: Sequence[str] = ("ts_us", "event_id")) -> DataFrame:
    """Readable power samples with the readable sample before them as ``prev`` (null for the first)."""
    d = samples.filter("power_w is not null").withColumn("pt", F.struct("ts_us", "power_w"))
    return neighbours(d, keys, order, time_bucket(), lag={"prev": "pt"}).drop("pt")


def trapezoid(seg: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Energy, covered seconds and time-weighted mean power."""
    dt = (F.col("ts_us") - F.col("prev.ts_us")) / 1e6
    d = seg.withColumn("dt", F.when(dt > 0, dt))
    return d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("dt") * (F.col("power_w") + F.col("prev.power_w")) / 2).alias("joules"), F.sum("dt").alias("seconds"))


def running_joules(seg: DataFrame, keys: Sequence[str] = ("card",), order: Sequence[str] = ("ts_us", "event_id")) -> DataFrame:
    """Add ``joules``: energy of a card from its first sample up to each one.

    Pieces are decimals, so the sums are exact: a difference of two of them loses nothing, however long the log is, and
    does not depend on the order of summing.
    """
    dt = (F.col("ts_us") - F.col("prev.ts_us")) / 1e6
    piece = F.coalesce(F.when(dt > 0, dt * (F.col("power_w") + F.col("prev.power_w")) / 2), F.lit(0.0)).cast("decimal(28,9)")
    d = prefix(seg.withColumn("_piece", piece), list(order), time_bucket(), list(keys), rank=None, sums={"_earlier": "_piece"})
    return d.withColumn("joules", F.col("_earlier") + F.col("_piece")).drop("_piece", "_earlier")


def interval_energy(requests: DataFrame, seg: DataFrame, pad_us: int, keys: Sequence[str] = ("card",), order: Sequence[str] = ("ts_us", "event_id")) -> DataFrame:
    """Energy used during [t0, t1] per request, from samples within ``pad_us`` of the window.

    Window ends are interpolated; an end beyond the samples takes the nearest reading when that is within ``pad_us``,
    otherwise the request has no answer. A request never meets the samples inside its window: four as-of lookups (both
    ends, and both ends of the padded window) find its outermost samples and the running joules at its ends, and their
    difference is the answer. The work is linear in samples plus requests.
    """
    point = ("ts_us", "power_w", "joules")
    s = running_joules(seg, keys, order).select(*keys, F.col("ts_us").alias("t"), F.struct(*point).alias("pt"))
    ends = {"pad0": F.col("t0") - pad_us, "end0": F.col("t0"), "end1": F.col("t1"), "pad1": F.col("t1") + pad_us}
    e = requests.select(*keys, F.struct(*requests.columns).alias("req"), F.explode(F.array(*[F.struct(F.lit(n).alias("end"), t.alias("t")) for n, t in ends.items()])).alias("e"))
    e = e.select(*keys, "e.t", "req", "e.end")
    u = s.unionByName(e, allowMissingColumns=True).withColumn("side", F.when(F.col("end").isNull(), 0).otherwise(1))
    d = neighbours(u, keys, ["t", "side"], time_bucket("t"), fill={"a": "pt"}, fill_next={"b": "pt"}).filter("end is not null")
    look = F.struct("a", F.when(F.col("a.ts_us") == F.col("t"), F.col("a")).otherwise(F.col("b")).alias("b"))
    d = d.groupBy("req.req_id").agg(F.first("req").alias("req"), *[F.max_by(look, F.col("end") == n).alias(n) for n in ends])
    t0, t1, first, last = F.col("req.t0"), F.col("req.t1"), "pad0.b", "pad1.a"
    first_t, first_p, last_t, last_p = F.col(f"{first}.ts_us"), F.col(f"{first}.power_w"), F.col(f"{last}.ts_us"), F.col(f"{last}.power_w")

    def joules_at(end: str, t: Column) -> tuple[Column, Column]:
        """Running joules of the sample at or before ``t``, and the rest of the way to ``t``."""
        a, b = f"{end}.a", f"{end}.b"
        ta, pa, tb, pb = F.col(f"{a}.ts_us"), F.col(f"{a}.power_w"), F.col(f"{b}.ts_us"), F.col(f"{b}.power_w")
        at = F.when(tb == ta, pa).otherwise(pa + (pb - pa) * (t - ta) / (tb - ta))
        return F.col(f"{a}.joules"), (t - ta) / 1e6 * (pa + at) / 2

    (e0, r0), (e1, r1) = joules_at("end0", t0), joules_at("end1", t1)
    # an end outside the samples of the padded window starts (stops) at the outermost of them
    e0, r0 = F.when(t0 <= first_t, F.col(f"{first}.joules")).otherwise(e0), F.when(t0 <= first_t, 0.0).otherwise(r0)
    e1, r1 = F.when(t1 >= last_t, F.col(f"{last}.joules")).otherwise(e1), F.when(t1 >= last_t, 0.0).otherwise(r1)
    inner = F.when(F.least(t1, last_t) > F.greatest(t0, first_t), (e1 - e0).cast("double") + r1 - r0).otherwise(0.0)
    left = F.greatest(F.least(first_t, t1) - t0, F.lit(0)) / 1e6 * first_p
    right = F.greatest(t1 - F.greatest(last_t, t0), F.lit(0)) / 1e6 * last_p
    none = (t1 < t0) | first_t.isNull() | last_t.isNull() | (first_t > t1 + pad_us) | (last_t < t0 - pad_us)
    near = (first_t - t0 <= pad_us) & (t1 - last_t <= pad_us)
    joules = F.when(F.coalesce(none, F.lit(True)), None).when(t1 == t0, 0.0).when(near, inner + left + right)
    return d.select("req.*", joules.alias("joules"))


def edge_power(edges: DataFrame, samples: DataFrame, max_gap_us: int, keys: Sequence[str] = ("card",)) -> DataFrame:
    """Power at each edge (edge_id, card, t): interpolated, or the nearest reading within ``max_gap_us``."""
    s = samples.filter("power_w is not null").select(*keys, F.col("ts_us").alias("t"), F.struct("ts_us", "power_w").alias("pt"), F.lit(None).cast("bigint").alias("edge_id"))
    e = edges.select(*keys, "t", F.lit(None).cast(dict(s.dtypes)["pt"]).alias("pt"), "edge_id")
    u = s.unionByName(e).withColumn("side", F.when(F.col("edge_id").isNull(), 0).otherwise(1))
    d = neighbours(u, keys, ["t", "side"], time_bucket("t"), fill={"a": "pt"}, fill_next={"b": "pt"}).filter("edge_id is not null")
    t, ta, pa, tb, pb = F.col("t"), F.col("a.ts_us"), F.col("a.power_w"), F.col("b.ts_us"), F.col("b.power_w")
    value = (F.when(ta.isNotNull() & tb.isNotNull(), F.when(tb == ta, pa).otherwise(pa + (pb - pa) * (t - ta) / (tb - ta)))
             .when(tb.isNotNull() & (tb - t <= max_gap_us), pb).when(ta.isNotNull() & (t - ta <= max_gap_us), pa))
    return d.select("edge_id", *keys, "t", value.alias("power_w"))


def guard_states(samples: DataFrame, keys: Sequence[str] = ("card",), hi: float = TEMP_PAUSE, lo: float = TEMP_RESUME, order: Sequence[str] = ("ts_us", "event_id")) -> DataFrame:
    """Hysteresis: ``paused`` turns on at ``hi`` and off at ``lo``; between the two it keeps its last state."""
    mark = F.when(F.col("temp_c") >= hi, 1).when(F.col("temp_c") <= lo, 0)
    d = neighbours(samples.withColumn("mark", mark), keys, order, time_bucket(), fill={"paused": "mark"})
    return d.withColumn("paused", F.coalesce("paused", F.lit(0))).drop("mark")


def pauses(states: DataFrame, keys: Sequence[str] = ("card",), order: Sequence[str] = ("ts_us", "event_id")) -> DataFrame:
    """Closed pause intervals: the changes of state are few, and each end is paired with the change before it."""
    d = neighbours(states, keys, order, time_bucket(), lag={"was": "paused"})
    change = d.filter(F.col("paused") != F.coalesce("was", F.lit(0)))
    pairs = neighbours(change, keys, order, time_bucket(), lag={"since": "ts_us"})
    return pairs.filter("paused = 0 and since is not null").select(*keys, F.col("since").alias("start_us"), F.col("ts_us").alias("end_us"), ((F.col("ts_us") - F.col("since")) / 1e6).alias("seconds"))
