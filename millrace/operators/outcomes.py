"""Sized cycles followed through the books that stand after each delay, in one fold over depth levels.

A segment of event time has the levels of its own updates and of as long after its end as the longest delay takes. A task
sizes its cycles where they lie, holds them until their delays have passed and scores them against the books that it
carries along anyway. So neither cycles nor books are sent through a shuffle to be looked up, and what leaves a task is a
narrow row for each sized cycle. A task holds one book of all symbols and the sized cycles of the longest delay.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.model import ASSETS, HOUR, SYMBOLS
from millrace.operators import graph
from millrace.operators.depth_fold import Books, Carried, Sized, carried, dealt, sized
from millrace.operators.shadow import FULL, SLACK

_CYCLES = len(graph.cycles())


def fills(sell: np.ndarray, base: np.ndarray, limit: np.ndarray, px: np.ndarray, qty: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What immediate-or-cancel orders get, in base units, and the quote units that change hands; px, qty: (..., levels)."""
    got, quote = np.zeros(base.shape), np.zeros(base.shape)
    for k in range(px.shape[-1]):
        inside = np.where(sell, px[..., k] >= limit * (1 - SLACK), px[..., k] <= limit * (1 + SLACK)) & (qty[..., k] > 0)
        part = np.where(inside, np.minimum(qty[..., k], base - got), 0.0)
        got, quote = got + part, quote + np.where(inside, part * px[..., k], 0.0)
    return got, quote


class _Waiting:
    """Sized cycles of equally many legs in order of time, and how many of them each delay has scored."""

    def __init__(self, f: Sized, kept: np.ndarray, t_us: np.ndarray, prices: np.ndarray, keep: np.ndarray, rows: dict[str, np.ndarray], delays: int):
        self.number, self.sell, self.base, self.limit = (x[kept] for x in (f.number, f.sell, f.base_qty, f.limit))
        worth = prices[f.row[kept]]
        self.src = np.take_along_axis(worth, f.src[kept], axis=1)
        self.dst = np.take_along_axis(worth, np.roll(f.src[kept], -1, axis=1), axis=1)
        self.keep, self.t_us, self.rows = keep[self.number], t_us, rows
        self.filled, self.pnl, self.done = np.zeros((delays, len(kept)), bool), np.zeros((delays, len(kept))), [0] * delays

    def score(self, d: int, upto: int, of: np.ndarray, px: np.ndarray, qty: np.ndarray) -> None:
        """Scores those up to a place that a delay hasn't scored yet, in the books of (cycles, symbols) places."""
        own = slice(self.done[d], upto)
        at = np.take_along_axis(of, self.number[own], axis=1)
        sell, base, side = self.sell[own], self.base[own], np.where(self.sell[own], 0, 1)
        got, quote = fills(sell, base, self.limit[own], px[at, side], qty[at, side])
        gives = np.where(sell, got, quote) * self.src[own]
        gets = np.where(sell, quote, got) * self.keep[own] * self.dst[own]
        each = gets - gives
        known = ~np.isnan(each)  # a leg whose asset has no price has no part in the sum
        self.filled[d, own] = (got / base >= 1 - FULL).all(axis=1)
        self.pnl[d, own] = np.where(known.any(axis=1), np.where(known, each, 0.0).sum(axis=1), np.nan)
        self.done[d] = upto


class _Segment:
    """One segment's runs of survivors, and the sized cycles that wait for their delays."""

    def __init__(self, number: int, length: int, fees: dict[str, float], packet: float, delays: Sequence[int]):
        self.number, self.length, self.fees, self.packet, self.delays = number, length, fees, packet, delays
        self.hurdles = np.array([graph.hurdle_of(c, fees) for c in graph.cycles()])
        self.keep = 1.0 - np.array([fees[s] for s in SYMBOLS])
        self.waiting: list[_Waiting] = []
        self.last: tuple[np.ndarray, np.ndarray] | None = None
        self.since: np.ndarray | None = None  # by cycle, of the last update
        self.alive, self.opened = np.zeros(_CYCLES, bool), np.ones(_CYCLES, bool)

    def take(self, run: Carried, low: int, high: int) -> Iterator[pa.RecordBatch]:
        """Updates low to high of a run: what has been scored by their end."""
        rows = run.live()
        rows = rows[(rows >= low) & (rows < high)]
        rows = rows[run.t_us[rows] // self.length == self.number]  # the others are looked up alone
        for some, books in run.pieces(rows):
            self._decide(run, some, books)
        times, symbols = run.t_us[low:high], len(SYMBOLS)
        of = np.concatenate([np.arange(symbols)[None], run.of[low:high]])  # first what stood before the run
        for waiting in self.waiting:
            for d, delay in enumerate(self.delays):
                due = waiting.t_us[waiting.done[d] :] + delay
                upto = int(np.searchsorted(due, times[-1]))  # rows of the last time may follow
                if upto:
                    place = np.searchsorted(times, due[:upto], side="right")
                    waiting.score(d, waiting.done[d] + upto, of[place], run.px, run.qty)
        self.last = run.px[run.of[high - 1]], run.qty[run.of[high - 1]]
        yield from self._scored()

    def end(self) -> Iterator[pa.RecordBatch]:
        """What still waits, scored against the last books; and, without a seq, each cycle's run at the segment's end."""
        px, qty = self.last
        for waiting in self.waiting:
            for d in range(len(self.delays)):
                if waiting.done[d] < len(waiting.t_us):
                    of = np.broadcast_to(np.arange(len(SYMBOLS)), (len(waiting.t_us) - waiting.done[d], len(SYMBOLS)))
                    waiting.score(d, len(waiting.t_us), of, px, qty)
        yield from self._scored()
        if self.since is not None:
            since = pa.array(self.since, mask=~self.alive)
            yield self._batch(_CYCLES, {"cycle_id": pa.array(np.arange(_CYCLES, dtype=np.int32)), "since_us": since, "opened": pa.array(self.opened & self.alive)})

    def _decide(self, run: Carried, rows: np.ndarray, books: Books) -> None:
        edges, prices, time = books.edges(), books.prices(), run.t_us[rows]
        above = edges > self.hurdles
        # A run of survivors starts after the last update without the cycle; one that the segment starts with may be older.
        out = np.maximum.accumulate(np.where(above, -1, np.arange(len(rows))[:, None]), axis=0)
        entered = np.where(self.alive, self.since, time[0]) if self.since is not None else np.full(_CYCLES, time[0])
        since = np.where(out >= 0, time[np.minimum(out + 1, len(rows) - 1)], entered)
        opened = (out < 0) & self.opened
        for f in sized(books, edges, prices, self.fees, self.packet):
            kept = np.flatnonzero(f.start_in > 0)
            if not len(kept):
                continue
            row, cycle = f.row[kept], f.cycle[kept]
            oldest = np.take_along_axis(run.book_us[books.of[row]], f.number[kept], axis=1).min(axis=1)
            profit = (f.start_out - f.start_in)[kept]
            known = {
                "seq": books.seq[row], "t_us": time[row], "cycle_id": cycle.astype(np.int32), "since_us": since[row, cycle], "opened": opened[row, cycle],
                "stale_us": time[row] - oldest, "profit_usdt": profit * f.start_px[kept], "margin": profit / f.start_in[kept] * 1e4,
            }
            self.waiting.append(_Waiting(f, kept, time[row], prices, self.keep, known, len(self.delays)))
        self.since, self.alive, self.opened = since[-1].copy(), above[-1].copy(), opened[-1] & above[-1]

    def _scored(self) -> Iterator[pa.RecordBatch]:
        waiting, self.waiting = self.waiting, []
        for w in waiting:
            if min(w.done) < len(w.t_us):
                self.waiting.append(w)
                continue
            columns = {k: pa.array(v, from_pandas=True) for k, v in w.rows.items()}
            for d in range(len(self.delays)):
                columns |= {f"filled_{d}": pa.array(w.filled[d]), f"pnl_{d}": pa.array(w.pnl[d], from_pandas=True)}
            yield self._batch(len(w.t_us), columns)

    def _batch(self, n: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
        kinds = _kinds(len(self.delays))
        columns = {"_seg": pa.array(np.full(n, self.number)), **columns}
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, kind) for c, kind in kinds.items()], list(kinds))


def _kinds(delays: int) -> dict[str, pa.DataType]:
    whole = {"_seg": pa.int64(), "seq": pa.int64(), "t_us": pa.int64(), "cycle_id": pa.int32(), "since_us": pa.int64(), "opened": pa.bool_(), "stale_us": pa.int64()}
    parts = {"profit_usdt": pa.float64(), "margin": pa.float64()}
    return whole | parts | {k: v for d in range(delays) for k, v in ((f"filled_{d}", pa.bool_()), (f"pnl_{d}", pa.float64()))}


_NAMES = {pa.int64(): "bigint", pa.int32(): "int", pa.bool_(): "boolean", pa.float64(): "double"}


def followed(levels: DataFrame, fees: dict[str, float], packet: float, delays: Sequence[int], segment: int | None = None) -> DataFrame:
    """For every cycle above its hurdle that sizes to something: _seg, seq, t_us, cycle_id, since_us (since when it has been
    above its hurdle without a break), opened (whether that goes back to the segment's first update), stale_us (age of its
    legs' oldest book), profit_usdt, margin (bps); for each delay filled_<i> (every leg in full) and pnl_<i> (as
    shadow.scores() has them; null where the delay ends after the last book). Rows without a seq say how each cycle stands
    at a segment's end. Segments are twice as long as the longest delay (an hour at least), unless segment says otherwise.
    Levels without a time or a seq have no place among the updates."""
    length = segment or max(HOUR, 2 * max(delays))
    levels = levels.where(F.col("t_us").isNotNull() & F.col("seq").isNotNull())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Segment | None = None
        for run in carried(batches):
            cuts = [0, *(np.flatnonzero(np.diff(run.segments)) + 1).tolist(), len(run.segments)]
            for low, high in pairwise(cuts):
                if now is None or run.segments[low] != now.number:
                    if now is not None:
                        yield from now.end()
                    now = _Segment(int(run.segments[low]), length, fees, packet, delays)
                yield from now.take(run, low, high)
        if now is not None:
            yield from now.end()

    schema = ", ".join(f"{name} {_NAMES[kind]}" for name, kind in _kinds(len(delays)).items())
    rows = dealt(levels, length, max(delays)).mapInArrow(task, schema)
    rows = rows.crossJoin(F.broadcast(levels.agg(F.max("t_us").alias("_end"))))
    inside = {f"{c}_{d}": F.when(F.col("t_us") + delay <= F.col("_end"), F.col(f"{c}_{d}")) for d, delay in enumerate(delays) for c in ("filled", "pnl")}
    return rows.withColumns(inside).drop("_end")


def entries(found: DataFrame) -> DataFrame:
    """_seg, cycle_id, entry_us: since when the cycles that followed() found above their hurdle at the end of the segment
    before have been so; 74 rows for each segment are worked on."""
    ends = found.where(F.col("seq").isNull()).select("_seg", "cycle_id", "since_us", "opened")
    by = Window.partitionBy("cycle_id").orderBy("_seg")
    begins = F.col("since_us").isNotNull() & (~F.col("opened") | F.col("_before").isNull())
    rows = ends.withColumn("_before", F.lag("since_us").over(by))
    rows = rows.withColumn("_start", F.last(F.when(begins, F.col("since_us")), True).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("entry_us", F.lag(F.when(F.col("since_us").isNotNull(), F.col("_start"))).over(by))
    return rows.where(F.col("entry_us").isNotNull()).select("_seg", "cycle_id", "entry_us")


def scored(found: DataFrame, entered: DataFrame, delays: Sequence[int]) -> DataFrame:
    """seq, t_us, cycle_id, age_us, stale_us, n_legs, profit_usdt, margin, delay, filled, pnl_usdt: a row for each delay that
    followed() scored. entered: what entries() gives, a row for each segment and cycle above its hurdle at its start."""
    own = found.where(F.col("seq").isNotNull()).join(F.broadcast(entered), ["_seg", "cycle_id"], "left")
    since = F.when(F.col("opened"), F.coalesce("entry_us", "since_us")).otherwise(F.col("since_us"))
    legs = F.array(*(F.lit(len(c)) for c in graph.cycles()))
    each = F.array(*(
        F.struct(F.lit(delay).cast("bigint").alias("delay"), F.col(f"filled_{d}").alias("filled"), F.col(f"pnl_{d}").alias("pnl_usdt")) for d, delay in enumerate(delays)
    ))
    rows = own.select(
        "seq", "t_us", "cycle_id", (F.col("t_us") - since).alias("age_us"), "stale_us", F.element_at(legs, F.col("cycle_id") + 1).alias("n_legs"),
        "profit_usdt", "margin", F.explode(F.filter(each, lambda x: x["filled"].isNotNull())).alias("s"),
    )
    return rows.select(*(c for c in rows.columns if c != "s"), "s.*")
