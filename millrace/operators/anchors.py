"""Perpetual prices as anchors of spot prices: basis, implied price, lead, beta, markouts. Everything is keyed by coin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.stats import median
from millrace.operators import timeseries as ts


def market_mids(trades: DataFrame, fresh: int) -> tuple[DataFrame, DataFrame]:
    """coin, t_us, seq, mid of the spot and of the perpetual market, from trades (coin, market, t_us, seq, price, ...)."""
    found = ts.trade_mids(trades.select("coin", "market", "t_us", "seq", "price", "buyer_maker"), fresh, ["coin", "market"])
    return tuple(found.where(F.col("market") == m).select("coin", "t_us", "seq", "mid") for m in ("spot", "perp"))


def bucket_of(time: Column, width: int) -> Column:
    return F.floor(time / width).cast("bigint")


def basis(spot: DataFrame, perp: DataFrame, width: int, buckets: int) -> DataFrame:
    """coin, bucket, basis: the median of the buckets' medians of ln(spot mid / perp mid) over the `buckets` before it."""
    pairs = ts.asof(spot, perp.withColumnRenamed("mid", "perp_mid"), ["coin"], ["perp_mid"])
    pairs = pairs.where(F.col("perp_mid").isNotNull() & (F.col("perp_mid") != 0))
    each = pairs.groupBy("coin", bucket_of(F.col("t_us"), width).alias("of")).agg(median(F.ln(F.col("mid") / F.col("perp_mid"))).alias("m"))
    ahead = each.withColumn("bucket", F.explode(F.sequence(F.col("of") + 1, F.col("of") + buckets)))
    return ahead.groupBy("coin", "bucket").agg(median("m").alias("basis"))


def with_fair(probes: DataFrame, perp: DataFrame, bases: DataFrame, width: int, name: str = "fair") -> DataFrame:
    """The probes (coin, t_us, ...) with the perpetual's mid at their time, moved by the basis; null without one."""
    found = ts.asof(probes, perp.withColumnRenamed("mid", "_perp"), ["coin"], ["_perp"])
    found = found.withColumn("bucket", bucket_of(F.col("t_us"), width)).join(bases, ["coin", "bucket"], "left")
    value = F.when(F.col("_perp") != 0, F.col("_perp") * F.exp("basis"))
    return found.withColumn(name, value).drop("_perp", "basis", "bucket")


def at_offsets(rows: DataFrame, spot: DataFrame, perp: DataFrame, bases: DataFrame, offsets: list[int], width: int) -> DataFrame:
    """The rows (coin, t_us, seq, ...) with at_<i>: struct(fair, spot, perp) at t + offsets[i]."""
    probes = ts.probes_at(rows, offsets)
    probes = ts.asof(probes, spot.withColumnRenamed("mid", "_spot"), ["coin"], ["_spot"])
    probes = ts.asof(probes, perp.withColumnRenamed("mid", "_own"), ["coin"], ["_own"])
    probes = with_fair(probes, perp, bases, width)
    keep = [c for c in rows.columns if c != "t_us"]
    value = F.struct("fair", F.col("_spot").alias("spot"), F.col("_own").alias("perp"))
    return probes.groupBy(*keep, F.col("event_time").alias("t_us")).agg(
        *(F.max(F.when(F.col("offset") == o, value)).alias(f"at_{i}") for i, o in enumerate(offsets))
    )
