"""Walking order-book depth: the profitable size of a cycle, filling a path, and the best route for an amount."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def leg_levels(side: Column, bids: Column, asks: Column, fee: Column) -> Column:
    """Levels of a leg, best first, of arrays of struct(px, qty): struct(cap: input units, rate: output for one unit
    after the fee, px); levels without quantity are left out."""
    sell = F.transform(
        F.filter(bids, lambda x: x["qty"] > 0),
        lambda x: F.struct(x["qty"].alias("cap"), (x["px"] * (1e0 - fee)).alias("rate"), x["px"].alias("px")),
    )
    buy = F.transform(
        F.filter(asks, lambda x: x["qty"] > 0),
        lambda x: F.struct((x["px"] * x["qty"]).alias("cap"), ((1e0 - fee) / x["px"]).alias("rate"), x["px"].alias("px")),
    )
    return F.when(side == "SELL", sell).otherwise(buy)


def walk(cap: np.ndarray, rate: np.ndarray, px: np.ndarray, n: np.ndarray, sell: np.ndarray, most: np.ndarray, edge: float):
    """Sizes many cycles of the same number of legs at once.

    cap, rate, px: (cycles, legs, levels), filled up at the end; n: (cycles, legs) levels; sell: (cycles, legs);
    most: largest input. In each step every open cycle advances until its first leg's level is used up, as long as
    the product of its current rates is over 1 + edge.
    Returns start_in, start_out, leg_in, leg_base_qty, limit_px.
    """
    count, legs, _ = cap.shape
    start_in, start_out = np.zeros(count), np.zeros(count)
    leg_in, base_qty, limit = np.zeros((count, legs)), np.zeros((count, legs)), np.full((count, legs), np.nan)
    level, every = np.zeros((count, legs), int), np.arange(legs)
    left = cap[:, :, 0].copy()
    live = (n > 0).all(axis=1)
    while True:
        live = live & (start_in < most)
        rows = np.flatnonzero(live)
        if not len(rows):
            break
        at = level[rows]
        now = rate[rows[:, None], every, at]
        before = np.concatenate([np.ones((len(rows), 1)), np.cumprod(now, axis=1)], axis=1)
        into, total = before[:, :-1], before[:, -1]
        goes = total > 1.0 + edge
        live[rows[~goes]] = False
        rows, at, into, total = rows[goes], at[goes], into[goes], total[goes]
        step = np.minimum((left[rows] / into).min(axis=1), most[rows] - start_in[rows])
        start_in[rows] += step
        start_out[rows] += step * total
        spent = step[:, None] * into
        price = px[rows[:, None], every, at]
        leg_in[rows] += spent
        base_qty[rows] += np.where(sell[rows], spent, spent / price)
        limit[rows] = price
        left[rows] -= spent
        used = left[rows] <= cap[rows[:, None], every, at] * 1e-12
        level[rows] += used
        ended = level[rows] >= n[rows]
        level[rows] = np.minimum(level[rows], n[rows] - 1)
        left[rows] = np.where(used & ~ended, cap[rows[:, None], every, level[rows]], left[rows])
        live[rows[ended.any(axis=1)]] = False
    return start_in, start_out, leg_in, base_qty, limit


def size_cycles(df: DataFrame, keys: list[str], legs: str = "legs", most: str | None = None, edge: float = 0.0) -> DataFrame:
    """keys, start_in, start_out, profit, leg_in, leg_base_qty, limit_px.

    legs: array of struct(side, levels: array of struct(cap, rate, px)); most: column with the largest input (none: no
    bound). Rows are worked on in Arrow batches, those with equally many legs together. Null or no legs size to zero.
    """
    arrays = ["leg_in", "leg_base_qty", "limit_px"]
    source = df.select(
        *keys, F.coalesce(F.col(legs), F.array().cast(df.schema[legs].dataType)).alias("legs"),
        (F.col(most) if most else F.lit(float("inf"))).alias("most"),
    )
    schema = ", ".join(f"`{k}` {source.schema[k].dataType.simpleString()}" for k in keys)

    def sized(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(len(keys))
        ends = column.offsets.to_numpy().astype(np.int64)
        sell = pc.equal(column.values.field("side"), "SELL").to_numpy(zero_copy_only=False)
        levels = column.values.field("levels")
        first = levels.offsets.to_numpy().astype(np.int64)
        n = np.diff(first)
        place = first[:-1, None] + np.arange(max(1, int(n.max(initial=1))))
        inside = place < first[1:, None]
        padded = []
        for name, empty in (("cap", 0.0), ("rate", 1.0), ("px", 1.0)):
            flat = np.append(levels.values.field(name).to_numpy(zero_copy_only=False), empty)
            padded.append(np.where(inside, flat[np.where(inside, place, len(flat) - 1)], empty))
        most_in = batch.column(len(keys) + 1).to_numpy(zero_copy_only=False)
        start = np.zeros((2, batch.num_rows))
        per_leg = [np.zeros(len(n)), np.zeros(len(n)), np.full(len(n), np.nan)]
        numbers = np.diff(ends)
        for n_legs in np.unique(numbers[numbers > 0]):
            rows = np.flatnonzero(numbers == n_legs)
            at = ends[rows][:, None] + np.arange(n_legs)
            start_in, start_out, *more = walk(*(p[at] for p in padded), n[at], sell[at], most_in[rows], edge)
            start[0, rows], start[1, rows] = start_in, start_out
            for out, values in zip(per_leg, more):
                out[at] = values
        offsets = pa.array(ends.astype(np.int32))
        columns = [*map(pa.array, (start[0], start[1], start[1] - start[0])), *(pa.ListArray.from_arrays(offsets, pa.array(x)) for x in per_leg)]
        return pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *columns], [*keys, "start_in", "start_out", "profit", *arrays])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield sized(batch)

    more = ", ".join(f"{c} array<double>" for c in arrays)
    return source.mapInArrow(task, f"{schema}, start_in double, start_out double, profit double, {more}")


def filled(legs: Column, amount: Column) -> Column:
    """struct(out, leg_in, base_qty, limit_px) of an amount of the first leg's source pushed through a path's legs
    (array of struct(side, levels)); out is null where the depth doesn't suffice. Two nested folds in one expression:
    over the legs, and over a leg's levels, each of which takes what the ones before leave."""
    none = F.array().cast("array<double>")

    def through(state: Column, leg: Column) -> Column:
        start = F.struct(
            state["out"].alias("left"), F.lit(0e0).alias("got"), F.lit(0e0).alias("base"), F.lit(None).cast("double").alias("px")
        )

        def take(s: Column, level: Column) -> Column:
            part = F.when(s["left"] > level["cap"], level["cap"]).otherwise(s["left"])
            base = F.when(leg["side"] == "SELL", part).otherwise(part / level["px"])
            more = F.struct(
                (s["left"] - part).alias("left"), (s["got"] + part * level["rate"]).alias("got"),
                (s["base"] + base).alias("base"), level["px"].alias("px"),
            )
            return F.when((s["left"] > 0) | s["px"].isNull(), more).otherwise(s)

        def joined(done: Column) -> Column:
            return F.struct(
                done["got"].alias("out"),
                (state["enough"] & (done["left"] <= 0)).alias("enough"),
                F.concat(state["leg_in"], F.array(state["out"])).alias("leg_in"),
                F.concat(state["base_qty"], F.array(done["base"])).alias("base_qty"),
                F.concat(state["limit_px"], F.array(done["px"])).alias("limit_px"),
            )

        return F.transform(F.array(F.aggregate(leg["levels"], start, take)), joined)[0]

    # A fold takes its state's nullability from the first one, so what is missing is a flag, not a null.
    begin = F.struct(
        amount.alias("out"), F.lit(True).alias("enough"), none.alias("leg_in"), none.alias("base_qty"), none.alias("limit_px")
    )
    ended = lambda s: F.struct(F.when(s["enough"], s["out"]).alias("out"), *(s[c].alias(c) for c in ("leg_in", "base_qty", "limit_px")))
    return F.transform(F.array(F.aggregate(legs, begin, through)), ended)[0]


def best_route(routes: Column, amount: Column) -> Column:
    """struct(out, place, path) of the route that delivers most of an amount; of equal ones the first. routes: array of
    struct(path, legs) in order; null if no route has the depth."""
    tried = F.transform(
        routes,
        lambda r, i: F.struct(filled(r["legs"], amount)["out"].alias("out"), (-i).alias("place"), r["path"].alias("path")),
    )
    return F.array_max(F.filter(tried, lambda t: t["out"].isNotNull()))
