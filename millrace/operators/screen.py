"""Scoring every book update: all cycles' edges and capacities with the whole book carried along.

Updates are dealt by segments of event time and sorted there; each segment is led by one row for each symbol, its last
update before the segment. A task streams its segments in Arrow batches and holds one book (10 symbols by 4 numbers).
Per batch, the edges of all cycles are sums of the legs' log rates in the order of each cycle's legs: the same prices
give the same edge to the last digit, wherever a row lies in its batch, so rows that tie do so everywhere.

Prices that aren't positive give no edge (NaN, never above a threshold). Edges within 1e-12 of each other tie; of
tied cycles the one with the highest number counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.model import DAY, HOUR, SYMBOLS
from millrace.operators import graph
from millrace.operators.timeseries import balanced, segment_of

BOOK = ("bid", "ask", "bid_qty", "ask_qty")
LENGTHS = (3, 4, 5)


@lru_cache(maxsize=1)
def _cycles() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Legs by number (symbol's number, 10 more for BUY): (cycles, 20) how often each occurs; (cycles, 5) the legs in
    order, the first one repeated at the end of short cycles; number of legs."""
    number = {s: i for i, s in enumerate(SYMBOLS)}
    legs = [[number[leg.symbol] + 10 * (leg.side == "BUY") for leg in c] for c in graph.cycles()]
    uses = np.zeros((len(legs), 2 * len(number)))
    for i, c in enumerate(legs):
        uses[i, c] = 1
    return uses, np.array([(c + c[:1] * 5)[:5] for c in legs]), np.array([len(c) for c in legs])


def _ordered() -> np.ndarray:
    """(cycles, 5): each cycle's legs in order by number; short cycles end with the number after the last leg's."""
    uses, legs, n = _cycles()
    return np.where(np.arange(legs.shape[1]) < n[:, None], legs, uses.shape[1])


ORDERED = _ordered()


def dealt(quotes: DataFrame, segment: int = DAY, most: int | None = None) -> DataFrame:
    """_seg, _seed, t_us, seq, symbol, *BOOK: the updates of each segment in order behind their seeds. With most, segments
    of more rows are cut."""
    known = quotes.where(F.col("bid").isNotNull() & F.col("symbol").isin(*SYMBOLS))
    known = balanced(known, most, "t_us", segment) if most else known.withColumn("_seg", segment_of(F.col("t_us"), segment))
    rows = known.select("_seg", F.lit(False).alias("_seed"), "t_us", "seq", "symbol", *BOOK)
    own = lambda s: F.when(F.col("symbol") == s, F.struct("t_us", "seq"))
    ends = rows.groupBy("_seg").agg(*(F.max_by(F.struct("t_us", "symbol", *BOOK), own(s)).alias(s) for s in SYMBOLS))
    # A segment starts with each symbol's last row of the segments before it; there is one row for each segment.
    before = Window.partitionBy().orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    seeds = ends.select("_seg", *(F.last(s, True).over(before).alias(s) for s in SYMBOLS))
    seeds = seeds.select("_seg", F.explode(F.array(*SYMBOLS)).alias("end")).where("end is not null")
    seeds = seeds.select("_seg", F.lit(True).alias("_seed"), "end.t_us", F.lit(-1).cast("bigint").alias("seq"), "end.symbol", *(f"end.{c}" for c in BOOK))
    return rows.unionByName(seeds).repartition("_seg").sortWithinPartitions("_seg", F.desc("_seed"), "t_us", "seq")


class Scores:
    """What a run of complete books says: log edges (rows, cycles), and capacities in USDT."""

    def __init__(self, books: np.ndarray):
        bid, ask, bid_qty, ask_qty = (books[:, :, k] for k in range(4))
        prices = np.concatenate([bid, ask], axis=1)
        quoted = prices > 0
        rates = np.where(quoted, prices, 1e0)
        rates[:, bid.shape[1] :] = 1e0 / rates[:, bid.shape[1] :]
        logs = np.concatenate([np.log(rates), np.zeros((len(rates), 1))], axis=1)
        self.edges = logs[:, ORDERED[:, 0]]
        for k in range(1, ORDERED.shape[1]):
            self.edges += logs[:, ORDERED[:, k]]
        if not quoted.all():  # only cycles over such a side have no edge
            self.edges[(~quoted).astype(float) @ _cycles()[0].T > 0] = np.nan
        mid = (bid + ask) / 2
        names = list(SYMBOLS)
        price = {a: mid[:, names.index(a + "USDT")] for a in {x for pair in SYMBOLS.values() for x in pair} - {"USDT"}}
        price["USDT"] = np.ones(len(books))
        base = np.stack([price[b] for b, _ in SYMBOLS.values()], axis=1)
        quote = np.stack([price[q] for _, q in SYMBOLS.values()], axis=1)
        self.sizes = np.concatenate([bid_qty * base, ask * ask_qty * quote], axis=1)

    def capacities(self, cycle: np.ndarray) -> np.ndarray:
        """Capacity of one cycle for each row: the smallest size at the touch over its legs."""
        return np.take_along_axis(self.sizes, _cycles()[1][cycle], axis=1).min(axis=1)

    def best(self, n_legs: int) -> tuple[np.ndarray, np.ndarray]:
        """Number of the best cycle with so many legs for each row, and its edge."""
        own = np.flatnonzero(_cycles()[2] == n_legs)[::-1]  # the highest number first: argmax takes the first of equals
        edges = np.where(np.isnan(self.edges[:, own]), -np.inf, self.edges[:, own])
        at = np.round(edges, 12).argmax(axis=1)
        return own[at], edges[np.arange(len(edges)), at]


def rounded(values: np.ndarray, digits: int) -> np.ndarray:
    """values to so many digits after the point, halves away from zero; what is too large to have such digits stays."""
    scale, half = 10.0**digits, np.nextafter(0.5, 0)
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = values * scale
        return np.where(np.abs(scaled) < 2.0**52, np.trunc(scaled + np.copysign(half, scaled)) / scale + 0.0, values)


def books_after(book: np.ndarray, code: np.ndarray, values: np.ndarray) -> np.ndarray:
    """(rows, symbols, 4): the whole book after each update (symbol's number, its values) of a book."""
    out = np.empty((len(code), *book.shape))
    for s in range(len(book)):
        at = np.maximum.accumulate(np.where(code == s, np.arange(len(code)), -1))
        out[:, s] = np.where((at >= 0)[:, None], values[at], book[s])
    return out


def folded(
    source: DataFrame, schema: str, emit: Callable[[pa.RecordBatch, np.ndarray, Scores, np.ndarray | None], pa.RecordBatch]
) -> DataFrame:
    """Rows that emit(rows, their times, their scores, the time and edges before each) gives for runs of updates with a
    complete book; source: what dealt() gives."""
    names = list(SYMBOLS)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, book, since = None, None, -1
        for batch in batches:
            segments = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(segments)) + 1).tolist(), batch.num_rows]
            for low, high in zip(cuts, cuts[1:]):
                if low == high:
                    continue
                if segments[low] != segment:
                    segment, book, since = segments[low], np.full((len(names), len(BOOK)), np.nan), -1
                part = batch.slice(low, high - low)
                seed = part.column(1).to_numpy(zero_copy_only=False)
                time = part.column(2).to_numpy()
                code = np.array([names.index(s) for s in part.column(4).to_pylist()])
                values = np.stack([part.column(5 + k).to_numpy(zero_copy_only=False) for k in range(len(BOOK))], axis=1)
                books = books_after(book, code, values)
                entry, book, held = book, books[-1].copy(), since
                since = max(held, int(time.max()))
                live = ~np.isnan(books[:, :, 0]).any(axis=1) & ~seed
                rows = np.flatnonzero(live)
                if not len(rows):
                    continue
                first = rows[0]  # the book before it is known if it is complete
                prior = books[first - 1] if first else entry
                scores = Scores(np.concatenate([prior[None], books[rows]]))
                prior_time = max(held, int(time[:first].max(initial=-1)))
                known = not np.isnan(prior[:, 0]).any()
                before = np.concatenate([[prior_time], time[rows[:-1]]]) if known else np.concatenate([[time[first]], time[rows[:-1]]])
                yield emit(part.take(pa.array(rows)), time[rows], scores, time[rows] - before)

    return source.mapInArrow(task, schema)


def scored(quotes: DataFrame, segment: int = DAY, most: int | None = None) -> DataFrame:
    """_seg, t_us, seq, symbol of every update with a complete book; for n of LENGTHS: e_<n>, c_<n>, k_<n>, the best
    cycle's gross log edge, number and capacity."""
    columns = [f"{c}_{n}" for n in LENGTHS for c in "eck"]

    def emit(rows: pa.RecordBatch, time: np.ndarray, scores: Scores, since: np.ndarray) -> pa.RecordBatch:
        out = []
        for n in LENGTHS:
            cycle, edge = scores.best(n)
            none = np.isneginf(edge[1:])
            found = edge[1:], cycle[1:].astype(np.int32), scores.capacities(cycle)[1:]
            out += [pa.array(x, mask=none) for x in found]
        return pa.RecordBatch.from_arrays([rows.column(k) for k in (0, 2, 3, 4)] + out, ["_seg", "t_us", "seq", "symbol", *columns])

    kinds = ", ".join(f"e_{n} double, c_{n} int, k_{n} double" for n in LENGTHS)
    return folded(dealt(quotes, segment, most), f"_seg bigint, t_us bigint, seq bigint, symbol string, {kinds}", emit)


def every_cycle(quotes: DataFrame, what: str = "edges", digits: int | None = None, segment: int = HOUR, most: int | None = None) -> DataFrame:
    """seq, t_us, symbol and an array by cycle number of every update with a complete book: all cycles' gross log
    edges, or their capacities, rounded to digits if there are any."""

    def emit(rows: pa.RecordBatch, time: np.ndarray, scores: Scores, since: np.ndarray) -> pa.RecordBatch:
        if what == "edges":
            values = scores.edges[1:]
        else:
            legs = _cycles()[1]
            values = scores.sizes[1:, legs[:, 0]]
            for k in range(1, legs.shape[1]):
                values = np.minimum(values, scores.sizes[1:, legs[:, k]])
        if digits is not None:
            values = rounded(values, digits)
        offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(values).ravel(), from_pandas=True))
        return pa.RecordBatch.from_arrays([rows.column(3), rows.column(2), rows.column(4), lists], ["seq", "t_us", "symbol", what])

    return folded(dealt(quotes, segment, most), f"seq bigint, t_us bigint, symbol string, {what} array<double>", emit)


def time_shares(quotes: DataFrame, hurdles: list[float], near: float, segment: int = DAY, most: int | None = None) -> DataFrame:
    """cycle_id, above_us, near_us, max_edge, max_net: how long each cycle's gross edge was above 0, and its net edge
    above -near; the state before each update counts for the time up to it."""
    costs = np.array(hurdles)

    def emit(rows: pa.RecordBatch, time: np.ndarray, scores: Scores, since: np.ndarray) -> pa.RecordBatch:
        was, now = scores.edges[:-1], scores.edges[1:]
        with np.errstate(invalid="ignore"):
            above, close = since @ (was > 0), since @ (was - costs > -near)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(costs), dtype=np.int32)), pa.array(above), pa.array(close), pa.array(np.fmax.reduce(now, axis=0), from_pandas=True)],
            ["cycle_id", "above_us", "near_us", "max_edge"],
        )

    parts = folded(dealt(quotes, segment, most), "cycle_id int, above_us bigint, near_us bigint, max_edge double", emit)
    cost = F.element_at(F.array(*map(F.lit, hurdles)), F.col("cycle_id") + 1)
    return (
        parts.groupBy("cycle_id")
        .agg(F.sum("above_us").alias("above_us"), F.sum("near_us").alias("near_us"), F.max("max_edge").alias("max_edge"))
        .withColumn("max_net", F.col("max_edge") - cost)
    )
