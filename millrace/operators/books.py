"""Books rebuilt from snapshots and diffs of price levels, with gaps in the update ids.

A message carries the ids first_id to last_id and levels with their new quantities (0 deletes a level); a snapshot
carries all levels as of last_id. Messages count in the order of last_id, a diff before the snapshot of the same id; of
repeated ones that came first. A diff goes on with the book if first_id is at most one above the id before it; else ids
are missing, and the book is unknown up to the next snapshot. What lies between a snapshot and the next reset is an
epoch of the book.

Messages are cut into segments of ids. What a segment starts with is found without the segments before it being
folded: each level's last quantity of every segment, handed on to the segments up to the level's next change or the end
of its epoch. So a symbol's history takes many tasks, and each holds one book.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators.timeseries import carry, segment_of

#: Update ids in a segment.
IDS = 1 << 20
LEVELS = "array<struct<bid: boolean, px: double, qty: double>>"
_SIDE = pa.list_(pa.struct([("px", pa.float64()), ("qty", pa.float64())]))


def sequenced(messages: DataFrame, segment: int = IDS) -> DataFrame:
    """messages (symbol, seq, t_us, snapshot boolean, first_id, last_id, levels: LEVELS), each once, with gap (ids are
    missing before it), missing (how many; null where nothing was known), known (there is a book after it) and epoch
    (the last_id of the book's snapshot)."""
    first = Window.partitionBy("symbol", "last_id", "snapshot").orderBy("t_us", "seq")
    once = messages.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")
    order = ["last_id", "snapshot"]
    rows = carry(once, {"_before": F.col("last_id")}, order, ["symbol"], "last_id", segment, before=True)
    gap = ~F.col("snapshot") & (F.col("_before").isNull() | (F.col("first_id") > F.col("_before") + 1))
    rows = rows.withColumns({"gap": gap, "missing": F.when(gap, F.col("first_id") - F.col("_before") - 1)}).drop("_before")
    kind = "struct<epoch: bigint>"
    reset = F.when(F.col("snapshot"), F.struct(F.col("last_id").alias("epoch"))).when(F.col("gap"), F.struct(F.lit(None).cast("bigint").alias("epoch")).cast(kind))
    rows = carry(rows, {"_state": reset}, order, ["symbol"], "last_id", segment)
    return rows.withColumns({"epoch": F.col("_state.epoch"), "known": F.col("_state.epoch").isNotNull()}).drop("_state")


def _seeds(rows: DataFrame, segment: int) -> DataFrame:
    """The levels that each segment's first message finds: symbol, _seg, epoch, level."""
    known = rows.where("known").withColumn("_seg", segment_of(F.col("last_id"), segment))
    levels = known.select("symbol", "epoch", "_seg", "last_id", "snapshot", F.explode("levels").alias("l"))
    last = F.max_by("l.qty", F.struct("last_id", "snapshot")).alias("qty")
    ends = levels.groupBy("symbol", "epoch", "l.bid", "l.px", "_seg").agg(last)
    next_seg = F.lead("_seg").over(Window.partitionBy("symbol", "epoch", "bid", "px").orderBy("_seg"))
    # An epoch may end within a segment: what starts there is still handed on to that segment.
    until = known.groupBy("symbol", "epoch").agg(F.max("_seg").alias("_until"))
    ends = ends.withColumn("_next", next_seg).join(until, ["symbol", "epoch"])
    ends = ends.withColumn("_next", F.coalesce("_next", "_until")).where((F.col("qty") > 0) & (F.col("_next") > F.col("_seg")))
    return ends.select(
        "symbol", F.explode(F.sequence(F.col("_seg") + 1, "_next")).alias("_seg"), "epoch", F.struct("bid", "px", "qty").alias("level")
    )


class _Side:
    """One side's levels: prices in rising order, and quantities by price."""

    def __init__(self) -> None:
        self.prices: list[float] = []
        self.quantity: dict[float, float] = {}

    def put(self, price: float, quantity: float) -> None:
        if quantity > 0:
            if price not in self.quantity:
                insort(self.prices, price)
            self.quantity[price] = quantity
        elif self.quantity.pop(price, None) is not None:
            del self.prices[bisect_left(self.prices, price)]

    def best(self, depth: int, bid: bool) -> list[dict[str, float]]:
        top = self.prices[: -depth - 1 : -1] if bid else self.prices[:depth]
        return [{"px": p, "qty": self.quantity[p]} for p in top]


def books(messages: DataFrame, depth: int = 5, segment: int = IDS) -> DataFrame:
    """symbol, seq, t_us, last_id, snapshot, known, bids, asks (arrays of struct(px, qty), the best `depth` levels, best
    first; null while the book is unknown) after every message."""
    rows = sequenced(messages, segment)
    own = ["symbol", "_seg", "_seed", "last_id", "snapshot", "known", "epoch", "seq", "t_us"]
    here = rows.withColumns({"_seg": segment_of(F.col("last_id"), segment), "_seed": F.lit(False)}).select(*own, F.col("levels").cast(LEVELS).alias("levels"))
    none = lambda kind: F.lit(None).cast(kind)
    seeds = _seeds(rows, segment).select(
        "symbol", "_seg", F.lit(True).alias("_seed"), none("bigint").alias("last_id"), F.lit(True).alias("snapshot"), F.lit(True).alias("known"),
        "epoch", none("bigint").alias("seq"), none("bigint").alias("t_us"), F.array("level").cast(LEVELS).alias("levels"),
    )
    dealt = here.unionByName(seeds).repartition("symbol", "_seg").sortWithinPartitions("symbol", "_seg", F.desc("_seed"), "last_id", "snapshot")
    side = "array<struct<px: double, qty: double>>"
    schema = f"symbol string, seq bigint, t_us bigint, last_id bigint, snapshot boolean, known boolean, bids {side}, asks {side}"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, epoch, bids, asks = None, None, _Side(), _Side()
        for batch in batches:
            symbols, segments, seeds, _, snapshots, known, epochs = (batch.column(k).to_pylist() for k in range(7))
            lists = batch.column(9)
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])
            flat = lists.flatten()
            is_bid, price, quantity = (x.to_pylist() for x in flat.flatten())
            out: tuple[list, list] = ([], [])
            for i, place in enumerate(zip(symbols, segments)):
                if place != at:
                    at, epoch, bids, asks = place, None, _Side(), _Side()
                if epochs[i] != epoch or (snapshots[i] and not seeds[i]):
                    # Of seeds, and of the messages after them, those of another epoch start from nothing.
                    epoch, bids, asks = epochs[i], _Side(), _Side()
                if known[i]:
                    for k in range(ends[i], ends[i + 1]):
                        (bids if is_bid[k] else asks).put(price[k], quantity[k])
                if not seeds[i]:
                    out[0].append(bids.best(depth, True) if known[i] else None)
                    out[1].append(asks.best(depth, False) if known[i] else None)
            real = batch.filter(pa.array([not x for x in seeds]))
            columns = [real.column(k) for k in (0, 7, 8, 3, 4, 5)] + [pa.array(x, _SIDE) for x in out]
            yield pa.RecordBatch.from_arrays(columns, ["symbol", "seq", "t_us", "last_id", "snapshot", "known", "bids", "asks"])

    return dealt.mapInArrow(task, schema)


def gaps(rows: DataFrame, segment: int = IDS) -> DataFrame:
    """Times without a book, of what sequenced() gives: symbol, from_id, from_us (the first message after missing ids),
    missing (ids; null at a recording's start), n (messages without a book), until_id, until_us (the snapshot that
    ends it; null if none does)."""
    order = ["last_id", "snapshot"]
    starts = F.when(F.col("gap") & ~F.coalesce("_was_lost", F.lit(False)), F.struct("last_id", "t_us", "missing"))
    rows = carry(rows, {"_was_lost": ~F.col("known")}, order, ["symbol"], "last_id", segment, before=True)
    rows = carry(rows.withColumn("_start", starts), {"_gap": F.col("_start")}, order, ["symbol"], "last_id", segment)
    ends = F.col("known") & F.coalesce("_was_lost", F.lit(False))
    lost = rows.where(~F.col("known") | ends)
    return lost.groupBy("symbol", F.col("_gap.last_id").alias("from_id"), F.col("_gap.t_us").alias("from_us")).agg(
        F.max("_gap.missing").alias("missing"), F.count_if(~F.col("known")).alias("n"),
        F.max(F.when(ends, F.col("last_id"))).alias("until_id"), F.max(F.when(ends, F.col("t_us"))).alias("until_us"),
    )
