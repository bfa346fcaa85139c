"""State machines over telemetry and training logs that arrive as streams.

Rows of one batch come in any order and are sorted per key; a row older than what an earlier batch has processed for its
key is late and changes nothing, nor does one behind the guard's watermark. Loops run once per pause, not per sample.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from decant.operators.telemetry import TEMP_PAUSE, TEMP_RESUME

PAUSES = "card string, start_us bigint, end_us bigint, gave_up boolean"
NEVER = np.iinfo(np.int64).max


def pauses_of(ts: np.ndarray, hot: np.ndarray, cool: np.ndarray, since: int | None, max_wait: int | None, in_order: bool = False) -> tuple[list[tuple[int, int, bool]], int | None]:
    """Closed pauses (start, end, given up) of sorted samples, and the start of the one left open.

    ``since`` is the start of a pause that is open already. A pause ends at the first cool sample, or ``max_wait`` after
    its start if that comes first; whether a given-up pause starts anew is for the next hot sample behind its end to say.
    Samples of one instant follow each other if ``in_order``, and a pause may then take no time; else an instant neither
    ends a pause that starts in it nor starts one that ends in it.
    """
    hot_at, cool_at = np.flatnonzero(hot), np.flatnonzero(cool)
    out: list[tuple[int, int, bool]] = []
    at = 0 if since is None or in_order else int(np.searchsorted(ts, since, "right"))
    while True:
        if since is None:
            i = np.searchsorted(hot_at, at)
            if i >= len(hot_at):
                return out, None
            at = int(hot_at[i])
            since = int(ts[at])
            at = at + 1 if in_order else int(np.searchsorted(ts, since, "right"))
        j = np.searchsorted(cool_at, at)
        end = int(ts[cool_at[j]]) if j < len(cool_at) else NEVER
        limit = NEVER if max_wait is None else since + max_wait
        # without a cool sample the wait is over once any later sample shows that its time has passed
        if end == NEVER and (limit == NEVER or not len(ts) or int(ts[-1]) <= limit):
            return out, since
        gave_up = limit < end
        out.append((since, min(end, limit), gave_up))
        at = int(cool_at[j]) + 1 if in_order and not gave_up else int(np.searchsorted(ts, min(end, limit), "right"))
        since = None


class Guard(StatefulProcessor):
    """Pauses of a card: from ``hi`` on until it is at (``strict``: below) ``lo``, at most ``max_wait`` microseconds.

    The wait is a timer in event time, so a card that sends nothing any more is given up as well, as soon as the
    watermark says so.
    """

    def __init__(self, hi: float, lo: float, strict: bool, max_wait: int | None, in_order: bool = False):
        self.hi, self.lo, self.strict, self.max_wait, self.in_order = hi, lo, strict, max_wait, in_order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("guard", "since long, reached long")

    def _since(self) -> tuple[int | None, int | None]:
        return tuple(self.state.get()) if self.state.exists() else (None, None)

    def _timer(self, since: int | None) -> int | None:
        return None if since is None or self.max_wait is None else -(-(since + self.max_wait) // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        since, reached = self._since()
        old = self._timer(since)
        packs = pd.concat(list(rows))
        ts, ids, temp = (np.concatenate(packs[c].to_list()) for c in ("ts_us", "event_id", "temp_c"))
        fresh = np.flatnonzero(ts >= max(1000 * timerValues.getCurrentWatermarkInMs(), 0 if reached is None else reached))
        fresh = fresh[np.lexsort((ids[fresh], ts[fresh]))]
        ts, temp = ts[fresh], temp[fresh]
        if len(ts):
            cool = temp < self.lo if self.strict else temp <= self.lo
            closed, since = pauses_of(ts, temp >= self.hi, cool, since, self.max_wait, self.in_order)
            self.state.update((since, int(ts[-1])))
            new = self._timer(since)
            if new != old:
                if old is not None:
                    self.handle.deleteTimer(old)
                if new is not None:
                    self.handle.registerTimer(new)
            if closed:
                yield self._rows(key, closed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        since, reached = self._since()
        # a timer that was set for an older pause says nothing about this one
        if since is not None and self._timer(since) <= expiredTimerInfo.getExpiryTimeInMs():
            end = since + self.max_wait
            self.state.update((None, max(end, reached)))
            yield self._rows(key, [(since, end, True)])

    @staticmethod
    def _rows(key, closed: list[tuple[int, int, bool]]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *c) for c in closed], columns=["card", "start_us", "end_us", "gave_up"])

    def close(self) -> None:
        pass


def packed(samples: DataFrame) -> DataFrame:
    """Samples with a time and a temperature, as a row of arrays per card and Arrow batch: a keyed processor is handed its rows one by one."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packs = pa.table(b).group_by("card").aggregate([("ts", "max"), *((c, "list") for c in ("ts_us", "event_id", "temp_c"))])
            yield from packs.rename_columns(["card", "ts", "ts_us", "event_id", "temp_c"]).to_batches()

    d = samples.filter(F.col("ts_us").isNotNull() & F.col("temp_c").isNotNull()).select("card", "ts", "ts_us", "event_id", F.col("temp_c").cast("double"))
    return d.mapInArrow(run, "card string, ts timestamp, ts_us array<bigint>, event_id array<bigint>, temp_c array<double>")


def guard(samples: DataFrame, hi: float = TEMP_PAUSE, lo: float = TEMP_RESUME, strict: bool = False, max_wait_us: int | None = None, delay: str = "2 seconds", in_order: bool = False) -> DataFrame:
    """Closed pauses per card of a stream with ts, card, ts_us, event_id and temp_c. State is two numbers per card."""
    d = packed(samples).withWatermark("ts", delay)
    return d.groupBy("card").transformWithStateInPandas(Guard(hi, lo, strict, max_wait_us, in_order), PAUSES, "Append", "EventTime")


#: Stretch of starts whose pauses are joined by one key of the stream, in microseconds.
PART = 3_600_000_000


def sessions(pauses: DataFrame, by: str = "host", delay: str = "0 seconds", part_us: int | None = None) -> DataFrame:
    """Times in which any card of a host paused: pauses that overlap or touch are one session, as each one's gap is its length.

    A gap of no length opens no window, so the windows' clock runs at double speed and gaps are one tick longer: a pause of no
    time counts, and one that starts a microsecond behind another's end still does not touch it.

    All open sessions of a key are compared with one another in every batch. With ``part_us`` the pauses that start in one
    stretch of that length have a key of their own; ``join_parts`` makes whole sessions of what comes out.
    """
    twice = f"{round(2 * pd.Timedelta(delay) / pd.Timedelta(microseconds=1))} microseconds"
    gap = F.concat((2 * (F.col("end_us") - F.col("start_us")) + 1).cast("string"), F.lit(" microseconds"))
    d = pauses.withColumn("at", F.timestamp_micros(2 * F.col("start_us"))).withColumn("gap", gap).withWatermark("at", twice)
    keys = [by]
    if part_us is not None:
        d, keys = d.withColumn("part", F.floor(F.col("start_us") / F.lit(part_us)).cast("bigint")), [by, "part"]
    g = d.groupBy(F.session_window("at", F.col("gap")).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    half = lambda c: F.shiftright(F.unix_micros(c), 1)
    return g.select(*keys, half("w.start").alias("start_us"), half("w.end").alias("end_us"), "n")


def join_parts(pieces: DataFrame, by: str = "host") -> DataFrame:
    """Whole sessions from those of parts. Within a part they lie apart, so only what earlier parts reach into is joined.

    ``pieces`` is read three times, so it should be a written table; windows run over one row per part.
    """
    earlier = Window.partitionBy(by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    reach = pieces.groupBy(by, "part").agg(F.max("end_us").alias("top")).select(by, "part", F.max("top").over(earlier).alias("reach"))
    d = pieces.join(reach, [by, "part"]).withColumn("opens", F.col("reach").isNull() | (F.col("start_us") > F.col("reach")))
    opened = d.groupBy(by, "part").agg(F.max(F.when(F.col("opens"), F.col("start_us"))).alias("last")).select(by, "part", F.max("last").over(earlier).alias("opened"))
    d = d.join(opened, [by, "part"]).withColumn("session", F.when(F.col("opens"), F.col("start_us")).otherwise(F.col("opened")))
    return d.groupBy(by, F.col("session").alias("start_us")).agg(F.max("end_us").alias("end_us"), F.sum("n").alias("n"))


class Best(StatefulProcessor):
    """Least value so far of each key, for every row in order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("best", "value double, reached long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best, reached = tuple(self.state.get()) if self.state.exists() else (None, None)
        d = pd.concat(list(rows)).sort_values(["at_us", "okey"])
        if reached is not None:
            d = d[d["at_us"] >= reached]
        if len(d):
            value = d["value"].to_numpy(float)
            least = np.fmin.accumulate(np.fmin(value, np.inf if best is None else best))
            last = None if np.isnan(least[-1]) or np.isinf(least[-1]) else float(least[-1])
            self.state.update((last, int(d["at_us"].iloc[-1])))
            shown = pd.Series(least, dtype="object").where(np.isfinite(least), None)
            yield pd.DataFrame({"run": key[0], "okey": d["okey"].to_numpy(), "best": shown.astype("float64")})

    def close(self) -> None:
        pass


def best_so_far(log: DataFrame, value: str) -> DataFrame:
    """Stream of (run, okey, best) from rows with run, at_us, okey and ``value``. State is two numbers per run."""
    d = log.select("run", "at_us", "okey", F.col(value).alias("value")).groupBy("run")
    return d.transformWithStateInPandas(Best(), "run bigint, okey bigint, best double", "Update", "None")
