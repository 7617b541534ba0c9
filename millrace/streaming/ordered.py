"""Stateful streams over rows in the order of event time, whatever order they come in.

Rows wait in a map state by time bucket and part (a frame's rows, so nothing that waits is written again) until the watermark has passed the bucket; a timer at its end hands them on in
order. What comes after the watermark is dropped by the engine (`ingest.set_aside` finds it again). A task holds one
bucket of one key at a time, and the state of its key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from millrace.model import SYMBOLS
from millrace.operators.screen import BOOK
from millrace.streaming.screening import fold

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state(spark: SparkSession) -> None:
    """Streams that start from now on keep their state in RocksDB, which typed and map states need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class Ordered(StatefulProcessor):
    """Calls released(rows, until) with the rows of all times before until that weren't handed on yet, in order of
    (t_us, seq). row: the fields of a row as DDL, among them t_us and seq (bigint); width: of a bucket in microseconds,
    a multiple of 1,000."""

    def __init__(self, row: str, width: int):
        if width % 1000:
            raise ValueError("timers are in milliseconds")
        self.row, self.width = row, width
        self.names = [field.split()[0] for field in row.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        inner = ", ".join(f"{n}: {k}" for n, k in (field.split() for field in self.row.split(", ")))
        self.held = handle.getMapState("held", "bucket bigint, part bigint", f"rows array<struct<{inner}>>")
        self.parts = handle.getMapState("parts", "bucket bigint", "n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for frame in rows:
            plain = frame[self.names].astype(object).where(frame[self.names].notna(), None)
            for bucket, part in plain.groupby(frame["t_us"] // self.width):
                place = (int(bucket),)
                n = self.parts.getValue(place)[0] if self.parts.containsKey(place) else 0
                self.held.updateValue((*place, n), ([tuple(r) for r in part.itertuples(index=False)],))
                self.parts.updateValue(place, (n + 1,))
                self.handle.registerTimer((place[0] + 1) * self.width // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        until = timerValues.getCurrentWatermarkInMs() * 1000
        due = sorted(b for (b,) in self.parts.keys() if (b + 1) * self.width <= until)
        t_us, seq = self.names.index("t_us"), self.names.index("seq")
        for bucket in due:
            rows = sorted(self.rows_of(bucket), key=lambda r: (r[t_us], r[seq]))
            for part in range(self.parts.getValue((bucket,))[0]):
                self.held.removeKey((bucket, part))
            self.parts.removeKey((bucket,))
            yield self.released(key, rows, (bucket + 1) * self.width)
        yield self.passed(key, until)

    def rows_of(self, bucket: int) -> Iterator[tuple]:
        """A bucket's rows that wait; each part holds what one frame brought."""
        for part in range(self.parts.getValue((bucket,))[0]):
            yield from (tuple(r) for r in self.held.getValue((bucket, part))[0])

    def released(self, key, rows: list[tuple], until: int) -> pd.DataFrame:
        raise NotImplementedError

    def passed(self, key, until: int) -> pd.DataFrame:
        """What a timer gives besides: nothing, unless told otherwise."""
        return pd.DataFrame()

    def first_held(self) -> int | None:
        """The earliest time that still waits."""
        buckets = [b for (b,) in self.parts.keys()]
        at = self.names.index("t_us")
        return min(r[at] for r in self.rows_of(min(buckets))) if buckets else None


# ---- episodes ----

EPISODE = "recording string, start_us bigint, end_us bigint, opened_by string, closed_by string, peak double, cycle_id int, capacity double"
SILENCE = "(silence)"


class Episodes(Ordered):
    """Net-positive episodes of one recording. A run that no update closes ends at the last update before a silence."""

    def __init__(self, fee_bps: float, width: int, silence: int | None):
        super().__init__("t_us bigint, seq bigint, symbol string, " + ", ".join(f"{c} double" for c in BOOK), width)
        self.fee_bps, self.silence, self.symbols = fee_bps, silence, list(SYMBOLS)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.book = handle.getValueState("book", "book array<double>, last_us bigint")
        self.run = handle.getValueState("run", "start_us bigint, opened_seq bigint, opened_by string, peak double, cycle_id int, capacity double")

    def _state(self):
        book, last = self.book.get() if self.book.exists() else ([None] * len(self.symbols) * len(BOOK), None)
        book = np.array([np.nan if x is None else x for x in book]).reshape(len(self.symbols), len(BOOK))
        return book, list(self.run.get()) if self.run.exists() else None, last

    def _out(self, key, done: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *x) for x in done], columns=[c.split()[0] for c in EPISODE.split(", ")])

    def _set_run(self, run) -> None:
        if run is None:
            self.run.clear()
        else:
            self.run.update(tuple(run))

    def released(self, key, rows, until):
        book, run, last = self._state()
        rows = [r for r in rows if r[2] in SYMBOLS and r[3] is not None]
        if not rows:
            return self._out(key, [])
        values = np.array([[np.nan if x is None else x for x in r[3:]] for r in rows], float)
        times, seqs, codes = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), np.array([self.symbols.index(r[2]) for r in rows])
        book, run, done = fold(book, run, times, seqs, codes, values, self.fee_bps, self.silence, last)
        last = int(times[-1])
        self.book.update(([None if np.isnan(x) else float(x) for x in book.ravel()], last))
        self._set_run(run)
        if run is not None and self.silence is not None:
            self.handle.registerTimer((last + self.silence) // 1000 + 1)
        return self._out(key, done)

    def passed(self, key, until):
        _, run, last = self._state()
        if self.silence is None or run is None or last + self.silence >= until:
            return self._out(key, [])
        waiting = self.first_held()
        if waiting is not None and waiting - last <= self.silence:
            return self._out(key, [])
        self._set_run(None)
        return self._out(key, [(run[0], last, run[2], SILENCE, *run[3:])])


def episodes(quotes: DataFrame, fee_bps: float, delay: str, width: int, silence: int | None = None) -> DataFrame:
    """EPISODE of a stream of quotes (recording, t_us, seq, symbol and BOOK), which may be out of order by delay. Rows
    without a symbol only move the time on. silence: microseconds without an update after which an open run ends."""
    rows = quotes.withColumn("ts", F.timestamp_micros("t_us")).withWatermark("ts", delay)
    return rows.groupBy("recording").transformWithStateInPandas(Episodes(fee_bps, width, silence), EPISODE, "Append", "EventTime")


# ---- markouts ----


class Markouts(Ordered):
    """Trades of one symbol with its mids at offsets around them. A trade waits until a quote at or after its last
    offset has come; quotes go once no trade that waits or may still come can look at them."""

    def __init__(self, offsets: tuple[int, ...], width: int):
        super().__init__("t_us bigint, seq bigint, mid double, trade string", width)
        self.offsets = np.array(offsets, np.int64)
        self.out = ["symbol", "t_us", "seq", "trade", *(f"at_{i}" for i in range(len(offsets)))]

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.mids = handle.getValueState("mids", "t array<bigint>, v array<double>")
        self.waiting = handle.getValueState("waiting", "rows array<struct<t_us: bigint, seq: bigint, trade: string>>")

    def released(self, key, rows, until):
        t, v = map(list, self.mids.get()) if self.mids.exists() else ([], [])
        waiting = [tuple(r) for r in self.waiting.get()[0]] if self.waiting.exists() else []
        t += [r[0] for r in rows if r[2] is not None]
        v += [r[2] for r in rows if r[2] is not None]
        waiting += [(r[0], r[1], r[3]) for r in rows if r[3] is not None]
        times, values = np.array(t, np.int64), np.array(v, float)
        known = min(until - 1, t[-1]) if t else -1
        ready = [r for r in waiting if r[0] + self.offsets[-1] <= known]
        waiting = [r for r in waiting if r[0] + self.offsets[-1] > known]
        probes = np.array([r[0] for r in ready], np.int64)[:, None] + self.offsets
        at = np.searchsorted(times, probes, "right") - 1
        found = np.where(at >= 0, values[at] if len(values) else np.nan, np.nan)
        some = [i for i in range(len(ready)) if at[i, 0] >= 0]
        oldest = min([until, *(r[0] for r in waiting)]) + min(0, int(self.offsets[0]))
        first = max(0, int(np.searchsorted(times, oldest, "right")) - 1)
        self.mids.update((t[first:], v[first:]))
        self.waiting.update((waiting,))
        return pd.DataFrame([(key[0], *ready[i], *found[i]) for i in some], columns=self.out)


def markouts(quotes: DataFrame, trades: DataFrame, offsets: tuple[int, ...], delay: str, width: int) -> DataFrame:
    """The trades (symbol, t_us, seq and columns of their own) of a stream, with at_0, at_1, ...: their symbol's mid at
    t_us + offsets[i] (in rising order), of trades that have one at the first offset and a quote at or after the last.
    quotes: symbol, t_us, seq, bid, ask. Rows without a price only move the time on."""
    own = [c for c in trades.columns if c not in ("symbol", "t_us", "seq")]
    kind = trades.select(*own).schema
    packed = F.to_json(F.struct(*own))
    both = quotes.select("symbol", "t_us", "seq", ((F.col("bid") + F.col("ask")) / 2).alias("mid"), F.lit(None).cast("string").alias("trade")).unionByName(
        trades.select("symbol", "t_us", "seq", F.lit(None).cast("double").alias("mid"), packed.alias("trade"))
    )
    at = ", ".join(f"at_{i} double" for i in range(len(offsets)))
    found = (
        both.withColumn("ts", F.timestamp_micros("t_us"))
        .withWatermark("ts", delay)
        .groupBy("symbol")
        .transformWithStateInPandas(Markouts(offsets, width), f"symbol string, t_us bigint, seq bigint, trade string, {at}", "Append", "EventTime")
    )
    return found.withColumn("trade", F.from_json("trade", kind)).select("symbol", "t_us", "seq", "trade.*", *(f"at_{i}" for i in range(len(offsets))))
