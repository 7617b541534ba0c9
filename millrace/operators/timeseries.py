"""As-of joins, carried-forward state, runs of a condition, grids and rolling sums over event time.

Ordered work is cut into segments of event time. What holds at a segment's start comes from the last values of the
segments before it, which are found by a small aggregate (one row for each key and segment). So no task sees more
than a segment of one key, whatever the length of a recording.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.model import DAY


def segment_of(time: Column, segment: int = DAY) -> Column:
    return F.floor(time / segment).cast("bigint") if segment > 1 else time


#: Sub-segments of a base segment at most.
CUTS = 1 << 20


def balanced(df: DataFrame, most: int, time: str = "t_us", segment: int = DAY, slice_us: int | None = None) -> DataFrame:
    """Adds _seg: segments in order of time, of which those with more than about `most` rows are cut.

    Rows are counted by slices of a segment (a 4,096th, unless slice_us says otherwise); a cut is at a slice's start, so
    rows of one time stay together. Only segments that are cut have a row in the table that is joined, with their cuts:
    its size is the number of rows divided by `most`. A row finds its place among a segment's cuts by halving.
    """
    slice_us = slice_us or max(1, segment // 4096)
    seg = segment_of(F.col(time), segment)
    counts = df.groupBy(seg.alias("_of"), F.floor(F.col(time) / slice_us).cast("bigint").alias("_slice")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_of").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_part", F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / most))
    cuts = counts.where("_part > 0").groupBy("_of", "_part").agg((F.min("_slice") * slice_us).alias("_cut"))
    cuts = cuts.groupBy("_of").agg(F.sort_array(F.collect_list("_cut")).alias("_cuts"))
    rows = df.withColumn("_of", seg).join(F.broadcast(cuts), "_of", "left")
    return rows.withColumn("_seg", F.col("_of") * CUTS + F.when(F.col("_cuts").isNotNull(), _up_to("_cuts", F.col(time))).otherwise(0)).drop("_of", "_cuts")


def _up_to(ascending: str, value: Column) -> Column:
    """How many elements of an ascending array, which isn't empty, are at most value, by halving."""
    steps = F.transform(F.sequence(F.floor(F.log2(F.size(ascending))).cast("int"), F.lit(0), F.lit(-1)), lambda b: F.pow(F.lit(2), b).cast("int"))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(ascending, at + step - 1) <= value, at + step).otherwise(at))


def carry(
    df: DataFrame,
    values: dict[str, Column],
    order: Sequence[str],
    keys: Sequence[str] = (),
    time: str = "t_us",
    segment: int = DAY,
    before: bool = False,
    most: int | None = None,
) -> DataFrame:
    """Adds, for each name in values, the last value that isn't null up to each row (before=True: excluding it). With
    most, segments of more rows are cut."""
    cut = balanced(df, most, time, segment) if most else df.withColumn("_seg", segment_of(F.col(time), segment))
    rows = cut.withColumns({f"_v_{n}": c for n, c in values.items()})
    at = F.struct(*order)
    ends = rows.groupBy(*keys, "_seg").agg(
        *(F.max_by(F.col(f"_v_{n}"), F.when(F.col(f"_v_{n}").isNotNull(), at)).alias(f"_e_{n}") for n in values)
    )
    earlier = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    seeds = ends.select(*keys, "_seg", *(F.last(f"_e_{n}", True).over(earlier).alias(f"_s_{n}") for n in values))
    inside = Window.partitionBy(*keys, "_seg").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    rows = rows.withColumns({f"_l_{n}": F.last(f"_v_{n}", True).over(inside) for n in values})
    rows = rows.join(seeds, [*keys, "_seg"], "left")
    out = rows.withColumns({n: F.coalesce(f"_l_{n}", f"_s_{n}") for n in values})
    return out.drop("_seg", *(f"{p}{n}" for p in ("_v_", "_l_", "_s_") for n in values))


def asof(
    probes: DataFrame,
    series: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    time: str = "t_us",
    seq: str = "seq",
    strict: bool = False,
    segment: int = DAY,
    most: int | None = None,
) -> DataFrame:
    """The probes, with the series' values of the last row at or before (strict: before) each probe's time.

    Of rows at the same time the one with the largest seq counts; without any row the values are null. The union of
    both sides is ordered within (keys, segment), so neither side is replicated.
    """
    payload = [c for c in probes.columns if c not in keys and c != time]
    side = 0 if strict else 1
    left = probes.select(
        *keys, time, F.lit(None).cast("bigint").alias("_seq"), F.lit(side).alias("_side"), F.struct(*payload).alias("_p"),
        F.lit(None).cast(_struct_of(series, values)).alias("_v"), F.lit(True).alias("_probe"),
    )
    right = series.select(
        *keys, time, F.col(seq).cast("bigint").alias("_seq"), F.lit(1 - side).alias("_side"),
        F.lit(None).cast(_struct_of(probes, payload)).alias("_p"), F.struct(*values).alias("_v"), F.lit(False).alias("_probe"),
    )
    both = left.unionByName(right)
    found = carry(both, {"_last": F.col("_v")}, [time, "_side", "_seq"], keys, time, segment, most=most)
    return found.where("_probe").select(*keys, time, "_p.*", *(F.col(f"_last.{v}").alias(v) for v in values))


def _struct_of(df: DataFrame, names: Sequence[str]) -> str:
    return "struct<" + ",".join(f"`{n}`:{df.schema[n].dataType.simpleString()}" for n in names) + ">"


def probes_at(events: DataFrame, offsets: Sequence[int], time: str = "t_us") -> DataFrame:
    """Each event once for each offset: columns event_time and offset, the time moved by the offset."""
    return (
        events.withColumn("offset", F.explode(F.array(*(F.lit(o).cast("bigint") for o in offsets))))
        .withColumn("event_time", F.col(time))
        .withColumn(time, F.col(time) + F.col("offset"))
    )


#: Steps that one row of a grid's first level stands for, and one task makes.
STEPS = 65_536


def grid(bounds: DataFrame, step: int, start: str = "t0", end: str = "t1", time: str = "t_us") -> DataFrame:
    """A row for each step from start to end (included) of every row of bounds. Runs of STEPS steps are dealt out before
    they are made."""
    own, stride = [c for c in bounds.columns if c not in (start, end)], F.lit(step * STEPS).cast("bigint")
    runs = bounds.select(*own, F.col(end).alias("_end"), F.explode(F.sequence(F.col(start), F.col(end), stride)).alias("_from"))
    last = F.least(F.col("_from") + step * (STEPS - 1), F.col("_end"))
    return runs.repartition(F.col("_from")).select(*own, F.explode(F.sequence(F.col("_from"), last, F.lit(step).cast("bigint"))).alias(time))


def book_state(quotes: DataFrame, symbols: Sequence[str], columns: Sequence[str] = ("bid", "ask"), segment: int = DAY, most: int | None = None) -> DataFrame:
    """Every quote with all symbols' latest columns after it (<column>_<symbol>), once all symbols have been seen."""
    values = {f"{c}_{s}": F.when(F.col("symbol") == s, F.col(c)) for s in symbols for c in columns}
    rows = carry(quotes.select("seq", "t_us", "symbol", *columns), values, ["t_us", "seq"], segment=segment, most=most)
    complete = F.lit(True)
    for s in symbols:
        complete = complete & F.col(f"{columns[0]}_{s}").isNotNull()
    return rows.where(complete).select("seq", "t_us", "symbol", *values)


def trade_mids(trades: DataFrame, fresh: int, keys: Sequence[str], segment: int = DAY) -> DataFrame:
    """keys, t_us, seq, mid: after each trade, midway between the last seller's and the last buyer's price, if both
    are known and the older is at most `fresh` old."""
    quote = lambda side: F.when(side, F.struct("price", "t_us"))
    maker = F.col("buyer_maker")
    rows = carry(trades, {"_bid": quote(maker), "_ask": quote(~maker)}, ["t_us", "seq"], keys, segment=segment)
    bid, ask = F.col("_bid.price"), F.col("_ask.price")
    known = bid.isNotNull() & ask.isNotNull() & (bid != 0) & (ask != 0)
    old = F.col("t_us") - F.least("_bid.t_us", "_ask.t_us")
    return rows.where(known & (old <= fresh)).select(*keys, "t_us", "seq", ((bid + ask) / 2).alias("mid"))


def rolling_sum(df: DataFrame, value: str, span: int, keys: Sequence[str], time: str) -> Column:
    """Sum over (time - span, time] of integer times within keys."""
    return F.sum(value).over(Window.partitionBy(*keys).orderBy(time).rangeBetween(-(span - 1), 0))


def requotes(series: DataFrame, bps: float, keys: Sequence[str], segment: int = DAY) -> DataFrame:
    """keys, n, per_minute: how often a value drifts by bps or more from the level of the last re-quote.

    Each level depends on the one before, yet segments are folded at the same time: whatever level a segment is entered
    with, the first re-quote in it is at a new highest or lowest value, and from there on only values of the segment
    count. So a segment gives its new highs and lows with the re-quotes that follow each, and a pass over a row for each
    segment picks those that come to pass. A task holds a segment's values.
    """
    if bps <= 0:
        raise ValueError("a drift has to be above 0 bps")
    source = series.select(*keys, segment_of(F.col("t_us"), segment).alias("_seg"), "t_us", "seq", "v").where(F.col("v").isNotNull())
    dealt = source.repartition(*keys, "_seg").sortWithinPartitions(*keys, "_seg", "t_us", "seq").drop("seq")
    fields = ", ".join(f"`{k}` {source.schema[k].dataType.simpleString()}" for k in keys)
    k = len(keys)

    kinds = [pa.struct([("n", pa.int64()), ("end", pa.float64())]), *(pa.list_(x) for x in (pa.float64(), pa.int64(), pa.float64()))]

    def by_segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, rows in _groups(batches, k + 1):
            time, value = rows.column(k + 1).to_numpy(), rows.column(k + 2).to_numpy()
            columns = [*place, pa.array([int(time[0])]), pa.array([int(time[-1])]), *(pa.array([x], kind) for x, kind in zip(jumps(value, bps), kinds))]
            yield pa.RecordBatch.from_arrays(columns, [*keys, "_seg", "first", "last", "start", "value", "n", "end"])

    shape = "_seg bigint, first bigint, last bigint, start struct<n: bigint, end: double>, value array<double>, n array<bigint>, end array<double>"
    segments = dealt.mapInArrow(by_segment, f"{fields}, {shape}").repartition(*keys).sortWithinPartitions(*keys, "_seg")

    def by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, place, level, n, first, last = None, None, 0.0, 0, 0, 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*place, pa.array([n], pa.int64()), pa.array([(last - first) / 6e7])], [*keys, "n", "minutes"])

        for batch in batches:
            for i, row in enumerate(batch.to_pylist()):
                at = [row[c] for c in keys]
                if at != held:
                    if held is not None:
                        yield out()
                    held, place, first = at, [batch.column(j).slice(i, 1) for j in range(k)], row["first"]
                    n, level = row["start"]["n"], row["start"]["end"]
                else:
                    drift = np.abs(np.array(row["value"]) / level - 1) * 1e4 >= bps
                    if drift.any():
                        jump = int(drift.argmax())
                        n, level = n + row["n"][jump], row["end"][jump]
                last = row["last"]
        if held is not None:
            yield out()

    found = segments.mapInArrow(by_key, f"{fields}, n bigint, minutes double")
    return found.select(*keys, "n", F.try_divide(F.col("n"), "minutes").alias("per_minute"))


def jumps(value: np.ndarray, bps: float) -> tuple[dict, list[float], list[int], list[float]]:
    """What a run of values does to a level: n and end (re-quotes and the last level) if it starts from the first value;
    and the run's new highest and lowest values in order, with the re-quotes from each on (itself one) and their end."""
    known: dict[int, tuple[int, float]] = {}

    def after(i: int) -> tuple[int, float]:
        """Re-quotes after one at i, and the last level."""
        path = []
        while i not in known:
            at, size, found = i + 1, 64, -1
            while found < 0 and at < len(value):
                hits = np.abs(value[at : at + size] / value[i] - 1) * 1e4 >= bps
                found = at + int(hits.argmax()) if hits.any() else -1
                at, size = at + size, size * 2
            path.append(i)
            if found < 0:
                known[i] = (0, float(value[i]))
                path.pop()
                break
            i = found
        for j in reversed(path):
            n, end = known[i]
            known[j] = (n + 1, end)
            i = j
        return known[i]

    n, end = after(0)
    high, low = np.maximum.accumulate(value), np.minimum.accumulate(value)
    new = np.flatnonzero(np.concatenate([[True], (value[1:] > high[:-1]) | (value[1:] < low[:-1])])).tolist()
    then = [after(i) for i in new]
    return {"n": n, "end": end}, value[new].tolist(), [1 + x for x, _ in then], [x for _, x in then]


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[list[pa.Array], pa.RecordBatch]]:
    """The rows of each run of equal values of the first columns, as one batch, with those values."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        change = np.zeros(batch.num_rows, bool)
        for column in batch.columns[:keys]:
            codes = column.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            change[1:] |= codes[1:] != codes[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:]):
            if low == high:
                continue
            part = batch.slice(low, high - low)
            if held and any(held[-1].column(c)[0].as_py() != part.column(c)[0].as_py() for c in range(keys)):
                yield [held[0].column(c).slice(0, 1) for c in range(keys)], pa.concat_batches(held)
                held = []
            held.append(part)
    if held:
        yield [held[0].column(c).slice(0, 1) for c in range(keys)], pa.concat_batches(held)
