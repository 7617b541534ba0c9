"""Several cycles at once: the best one takes its depth, the others are scored on what is left, and so on."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.model import ASSETS, SYMBOLS
from millrace.operators import graph
from millrace.operators.sizing import walk

_NUMBER = {s: i for i, s in enumerate(SYMBOLS)}


def by_legs() -> list[tuple[np.ndarray, np.ndarray]]:
    """By number of legs: cycle ids, and their legs as 2 * symbol + (0 to sell, 1 to buy)."""
    cycles = graph.cycles()
    legs = [[2 * _NUMBER[leg.symbol] + (leg.side == "BUY") for leg in c] for c in cycles]
    ids = lambda n: [i for i, of in enumerate(legs) if len(of) == n]
    return [(np.array(ids(n)), np.array([legs[i] for i in ids(n)])) for n in sorted({len(of) for of in legs})]


@dataclass
class Allocated:
    """Allocations of snapshots: row, place, cycle_id, start_in, profit_usdt, and by leg (five, of which n_legs count)
    base_qty and limit_px."""

    row: np.ndarray
    place: np.ndarray
    cycle_id: np.ndarray
    start_in: np.ndarray
    profit_usdt: np.ndarray
    n_legs: np.ndarray
    base_qty: np.ndarray
    limit_px: np.ndarray

    def batch(self, keys: dict[str, pa.Array]) -> pa.RecordBatch:
        """The allocations, with their snapshots' keys."""
        row, inside = pa.array(self.row), np.arange(self.base_qty.shape[1]) < self.n_legs[:, None]
        ends = pa.array(np.concatenate([[0], np.cumsum(self.n_legs)]).astype(np.int32))
        own = {"place": self.place.astype(np.int32), "cycle_id": self.cycle_id.astype(np.int32), "start_in": self.start_in, "profit_usdt": self.profit_usdt}
        lists = {c: pa.ListArray.from_arrays(ends, pa.array(getattr(self, c)[inside])) for c in ("base_qty", "limit_px")}
        return pa.RecordBatch.from_pydict({**{k: c.take(row) for k, c in keys.items()}, **{k: pa.array(c) for k, c in own.items()}, **lists})


def _of_all(found: list[tuple[np.ndarray, ...]], most: int) -> list[np.ndarray]:
    """Arrays joined one by one, those by leg filled up to the most legs."""
    wide = lambda x: np.pad(x, ((0, 0), (0, most - x.shape[1]))) if x.ndim == 2 else x
    return [np.concatenate([wide(x) for x in column]) for column in zip(*found)]


def greedy(px: np.ndarray, qty: np.ndarray, n: np.ndarray, fees: np.ndarray, prices: np.ndarray, least: float) -> Allocated:
    """Allocations of many snapshots at once.

    px, qty: (rows, 2 * symbols, levels), bids at even places and asks at odd ones, filled up at the end; n: levels there
    are; fees: by symbol; prices: (rows, assets) USDT. In each round every open row's cycles over 1 at the touch are sized
    on what is left of its books, the one that earns most is taken (ties: the first), and its levels are used up. A cycle
    that was taken isn't over 1 any more, so rounds end after as many as there are cycles.
    """
    buys = np.arange(px.shape[1]) % 2 == 1
    keeps = (1.0 - np.repeat(fees, 2))[:, None]
    cap = np.where(buys[:, None], px * qty, qty)
    rate = np.where(buys[:, None], keeps / px, px * keeps)
    px, n, kinds = px.copy(), n.copy(), by_legs()
    starts = np.array([ASSETS.index(c[0].src) for c in graph.cycles()])
    most = max(legs.shape[1] for _, legs in kinds)
    none = np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0), np.zeros(0, int), *(np.zeros((0, most)) for _ in range(4))
    rows, out, place, levels = np.arange(len(px)), [(np.zeros(0, int), *none)], 0, np.arange(px.shape[2])
    while len(rows):
        place, found = place + 1, [none]
        touch = np.where(n[rows] > 0, rate[rows, :, 0], 0.0)
        for ids, legs in kinds:
            at, cycle = np.nonzero(np.prod(touch[:, legs], axis=2) > 1.0)
            if not len(at):
                continue
            of = rows[at][:, None], legs[cycle]
            start_in, start_out, leg_in, base, limit = walk(
                cap[of], rate[of], px[of], n[of], ~buys[legs[cycle]], np.full(len(at), np.inf), 0.0
            )
            profit = (start_out - start_in) * prices[rows[at], starts[ids[cycle]]]
            earns = profit > least
            found.append(tuple(x[earns] for x in (rows[at], ids[cycle], start_in, profit, np.full(len(at), legs.shape[1]), base, limit, leg_in, legs[cycle])))
        joined = _of_all(found, most)
        order = np.lexsort([joined[1], -joined[3], joined[0]])
        first = order[np.diff(joined[0][order], prepend=-1) != 0]
        row, cycle, start, profit, n_legs, base, limit, spent, legs = (x[first] for x in joined)
        out.append((row, np.full(len(row), place), cycle, start, profit, n_legs, base, limit, spent, legs))
        taken = np.arange(most) < n_legs[:, None]
        r, leg, spent = np.repeat(row, n_legs), legs[taken].astype(int), spent[taken]
        before = np.cumsum(cap[r, leg], axis=1) - cap[r, leg]
        left = cap[r, leg] - np.clip(spent[:, None] - before, 0.0, cap[r, leg])
        left = np.where(left <= cap[r, leg] * 1e-12, 0.0, left)
        gone = ((left == 0) & (levels < n[r, leg][:, None])).sum(axis=1)
        moved = np.minimum(levels + gone[:, None], len(levels) - 1)
        there = levels + gone[:, None] < len(levels)
        for side, have, empty in ((cap, left, 0.0), (rate, rate[r, leg], 1.0), (px, px[r, leg], 1.0)):
            side[r, leg] = np.where(there, np.take_along_axis(have, moved, axis=1), empty)
        n[r, leg] -= gone
        rows = row
    return Allocated(*_of_all(out, most)[:8])


def _levels(book: Column) -> Column:
    return F.filter(book, lambda x: (x["qty"] > 0) & (x["px"] > 0))


def allocated(state: DataFrame, keys: list[str], fees: dict[str, float], least: float = 0.0) -> DataFrame:
    """keys, place (from 1), cycle_id, start_in, profit_usdt, base_qty, limit_px (by leg): what each snapshot's depth gives
    if cycles are taken one after the other, the best first. Cycles that earn no more than least (USDT) aren't taken.

    state: keys, books (array by symbol number of struct(bids, asks), best first), prices (USDT by asset number).
    Snapshots are independent, so they are worked on in Arrow batches where they lie; those without a cycle over 1 at
    the touch give no rows. Levels without quantity or price are left out, a missing price earns nothing.
    """
    sides = F.flatten(F.transform("books", lambda b: F.array(_levels(b["bids"]), _levels(b["asks"]))))
    source = state.select(*keys, sides.alias("_sides"), F.transform("prices", lambda p: F.coalesce(p, F.lit(0e0))).alias("_prices"))
    fee = np.array([fees[s] for s in SYMBOLS])
    legs = 2 * len(SYMBOLS)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            books = batch.column(len(keys)).flatten()
            first = books.offsets.to_numpy().astype(np.int64)
            n = np.diff(first)
            place = first[:-1, None] + np.arange(max(1, int(n.max(initial=1))))
            inside = place < first[1:, None]
            padded = []
            for name, empty in (("px", 1.0), ("qty", 0.0)):
                flat = np.append(books.values.field(name).to_numpy(zero_copy_only=False), empty)
                padded.append(np.where(inside, flat[np.where(inside, place, len(flat) - 1)], empty).reshape(batch.num_rows, legs, -1))
            prices = batch.column(len(keys) + 1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            found = greedy(*padded, n.reshape(batch.num_rows, legs), fee, prices, least)
            yield found.batch(dict(zip(keys, batch.columns)))

    schema = ", ".join(f"`{k}` {source.schema[k].dataType.simpleString()}" for k in keys)
    own = "place int, cycle_id int, start_in double, profit_usdt double, base_qty array<double>, limit_px array<double>"
    return source.mapInArrow(task, f"{schema}, {own}")


def netted(found: DataFrame, keys: list[str], of: Column) -> DataFrame:
    """keys, symbol, sold, bought, net (base units; over 0: to sell): a snapshot's orders with opposite legs set off.
    of: array of struct(symbol, side, ...) of the row's legs."""
    legs = found.select(*keys, F.explode(F.arrays_zip(of.alias("leg"), F.col("base_qty").alias("qty"))).alias("l"))
    one = lambda side: F.sum(F.when(F.col("l.leg.side") == side, F.col("l.qty")).otherwise(0e0))
    sums = legs.groupBy(*keys, F.col("l.leg.symbol").alias("symbol")).agg(one("SELL").alias("sold"), one("BUY").alias("bought"))
    return sums.withColumn("net", F.col("sold") - F.col("bought"))
