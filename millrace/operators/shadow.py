"""Shadow scoring: would a cycle's legs have filled in the books that stood a little later?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.model import DAY
from millrace.operators import timeseries as ts

#: Part of a limit by which a level's price may miss it.
SLACK = 1e-12
#: Part of a quantity that may lack where a leg counts as filled.
FULL = 1e-9


def leg_fill(leg: Column, bids: Column, asks: Column) -> Column:
    """struct(filled, quote): what an immediate-or-cancel order of leg (struct(side, base_qty, limit_px)) gets in a book, in
    base units, and the quote units that change hands. Without a book nothing fills."""
    sell = leg["side"] == "SELL"
    inside = lambda px: F.when(sell, px >= leg["limit_px"] * (1 - SLACK)).otherwise(px <= leg["limit_px"] * (1 + SLACK))

    def take(s: Column, level: Column) -> Column:
        part = F.when(inside(level["px"]) & (level["qty"] > 0), F.least(level["qty"], leg["base_qty"] - s["filled"])).otherwise(0e0)
        return F.struct((s["filled"] + part).alias("filled"), (s["quote"] + part * level["px"]).alias("quote"))

    nothing = F.struct(F.lit(0e0).alias("filled"), F.lit(0e0).alias("quote"))
    return F.coalesce(F.aggregate(F.when(sell, bids).otherwise(asks), nothing, take), nothing)


def scores(found: DataFrame, keys: list[str], books: DataFrame, delays: Sequence[int], segment: int = DAY, most: int | None = None) -> DataFrame:
    """keys, delay, filled (every leg in full), fill_share (mean over legs), pnl_usdt: each sized cycle against the books
    that stand after each delay.

    found: keys, t_us, legs: array of struct(symbol, side, fee, src_px, dst_px, base_qty, limit_px), prices in USDT at the
    time of the decision. pnl_usdt: what the legs get less what they give, partial fills included, at those prices.
    Delays that end after the last book aren't scored. Each leg looks up its own symbol's book alone, so a row carries
    one book, and lookups are cut by time like other as-of lookups.
    """
    each = found.select(*keys, "t_us", F.explode("legs").alias("leg")).withColumn("symbol", F.col("leg.symbol"))
    probes = ts.probes_at(each, delays).join(F.broadcast(books.agg(F.max("t_us").alias("_end"))), F.col("t_us") <= F.col("_end")).drop("_end")
    seen = ts.asof(probes, books, ["symbol"], ["bids", "asks"], segment=segment, most=most)
    leg, got = F.col("leg"), F.col("got")
    sell = leg["side"] == "SELL"
    gives = F.when(sell, got["filled"]).otherwise(got["quote"]) * leg["src_px"]
    gets = F.when(sell, got["quote"]).otherwise(got["filled"]) * (1e0 - leg["fee"]) * leg["dst_px"]
    share = got["filled"] / leg["base_qty"]
    return (
        seen.withColumn("got", leg_fill(leg, F.col("bids"), F.col("asks")))
        .groupBy(*keys, F.col("offset").alias("delay"))
        .agg(F.bool_and(share >= 1 - FULL).alias("filled"), F.avg(share).alias("fill_share"), F.sum(gets - gives).alias("pnl_usdt"))
    )
