"""Markouts: what the passive side of each trade gains against a price before and after it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.timeseries import asof, probes_at


def side() -> Column:
    """+1 if the passive side bought (the buyer is the maker), else -1."""
    return F.when(F.col("buyer_maker"), 1e0).otherwise(-1e0)


def gain_bps(value: Column) -> Column:
    return side() * (value / F.col("price") - 1) * 1e4


def lookups(
    trades: DataFrame, series: DataFrame, keys: Sequence[str], values: Sequence[str], offsets: Sequence[int]
) -> DataFrame:
    """The trades with at_<i>: struct of the series' values at t + offsets[i]."""
    columns = trades.columns
    found = asof(probes_at(trades, offsets), series, keys, values)
    name = {o: f"at_{i}" for i, o in enumerate(offsets)}
    own = [c for c in columns if c not in ("seq", "t_us")]
    return found.groupBy("seq", F.col("event_time").alias("t_us"), *own).agg(
        *(F.max(F.when(F.col("offset") == o, F.struct(*values))).alias(n) for o, n in name.items())
    )


def marked(trades: DataFrame, quotes: DataFrame, pre: int, horizons: Sequence[int]) -> DataFrame:
    """Trades with a mid of their own symbol before them and quotes up to the last horizon: w, m_0 (at fill), m_1, ..."""
    mids = quotes.select("symbol", "t_us", "seq", ((F.col("bid") + F.col("ask")) / 2).alias("v"))
    last = mids.groupBy("symbol").agg(F.max("t_us").alias("last_us"))
    found = lookups(trades, mids, ["symbol"], ["v"], [-pre, *horizons])
    found = found.join(F.broadcast(last), "symbol").where(
        F.col("at_0.v").isNotNull() & (F.col("t_us") + horizons[-1] <= F.col("last_us"))
    )
    return found.withColumns(
        {"w": F.col("price") * F.col("qty"), **{f"m_{i}": gain_bps(F.col(f"at_{i}.v")) for i in range(len(horizons) + 1)}}
    )


def weighted(columns: Sequence[str], weight: str = "w") -> list[Column]:
    """Weighted means of columns."""
    return [F.try_divide(F.sum(F.col(c) * F.col(weight)), F.sum(weight)).alias(c) for c in columns]


def kept(edge: Column, thresholds: Sequence[float], gain: Column, weight: Column) -> list[Column]:
    """For each threshold N: kept_<N>, the weight of trades with an edge of N or more, and pnl_<N>, their weighted gain."""
    out = []
    for n in thresholds:
        there = edge >= n
        out.append(F.sum(F.when(there, weight).otherwise(0e0)).alias(f"kept_{n:g}"))
        out.append(F.sum(F.when(there, gain * weight).otherwise(0e0)).alias(f"pnl_{n:g}"))
    return out


def kept_report(thresholds: Sequence[float], weight: str = "w") -> list[Column]:
    """For each threshold: share_<N> of the weight that kept() keeps, and its gain pnl_<N> (null if nothing is kept)."""
    out = []
    for n in thresholds:
        out.append(F.round(F.col(f"kept_{n:g}") / F.col(weight), 6).alias(f"share_{n:g}"))
        gain = F.when(F.col(f"kept_{n:g}") > 0, F.try_divide(F.col(f"pnl_{n:g}"), F.col(f"kept_{n:g}")))
        out.append(F.round(gain, 6).alias(f"pnl_{n:g}"))
    return out
