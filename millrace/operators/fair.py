"""Fair-value estimators over the wide book state, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.stats import medians
from millrace.model import ASSETS, LEGS, SYMBOLS

ESTIMATORS = ("own", "routes", "usdt", "routes_vw", "all_vw")


def mid(symbol: str) -> Column:
    return (F.col(f"bid_{symbol}") + F.col(f"ask_{symbol}")) / 2


def _rate(src: str, dst: str) -> Column:
    leg = LEGS[src, dst]
    return mid(leg.symbol) if leg.side == "SELL" else 1e0 / mid(leg.symbol)


def between(symbol: str) -> list[str]:
    """The assets over which a two-leg route of the symbol can go."""
    return [a for a in ASSETS if a not in SYMBOLS[symbol]]


def route_rates(symbol: str) -> list[Column]:
    base, quote = SYMBOLS[symbol]
    return [_rate(base, x) * _rate(x, quote) for x in between(symbol)]


def routes(symbol: str) -> Column:
    """Median of the three two-leg routes at mids."""
    return F.array_sort(F.array(*route_rates(symbol)))[1]


def usdt(symbol: str) -> Column:
    """The ratio of base and quote in USDT."""
    price = lambda a: F.lit(1e0) if a == "USDT" else mid(a + "USDT")
    base, quote = SYMBOLS[symbol]
    return price(base) / price(quote)


def weights(symbol: str) -> list[Column]:
    """Of each route: the smaller traded volume (vol_<symbol>) of its two legs."""
    base, quote = SYMBOLS[symbol]
    volume = lambda a, b: F.col(f"vol_{LEGS[a, b].symbol}")
    return [F.least(volume(base, x), volume(x, quote)) for x in between(symbol)]


def _weighted(symbol: str) -> tuple[Column, Column]:
    pairs = list(zip(weights(symbol), route_rates(symbol)))
    return reduce(lambda a, p: a + p[0] * p[1], pairs, F.lit(0e0)), reduce(lambda a, p: a + p[0], pairs, F.lit(0e0))


def routes_vw(symbol: str) -> Column:
    num, den = _weighted(symbol)
    return F.when(den != 0, F.try_divide(num, den)).otherwise(routes(symbol))


def all_vw(symbol: str) -> Column:
    num, den = _weighted(symbol)
    own = F.col(f"vol_{symbol}")
    return F.when(den + own != 0, F.try_divide(num + own * mid(symbol), den + own)).otherwise(mid(symbol))


BY_NAME = {"own": mid, "routes": routes, "usdt": usdt, "routes_vw": routes_vw, "all_vw": all_vw}


def usdt_medians(trades: DataFrame) -> DataFrame:
    """One row: px_BTC, px_ETH, the median prices of their USDT trades."""
    each = medians(trades.where(F.col("symbol").isin("BTCUSDT", "ETHUSDT")), ["symbol"], "price")
    return each.agg(*(F.max(F.when(F.col("symbol") == q + "USDT", F.col("median"))).alias(f"px_{q}") for q in ("BTC", "ETH")))


def traded_volume(trades: DataFrame) -> DataFrame:
    """symbol, n, volume: traded notional in USDT of the whole recording; quotes in BTC and ETH count at the median
    price of their USDT trades."""
    px = usdt_medians(trades)
    rate = F.when(F.col("quote") == "BTC", F.col("px_BTC")).when(F.col("quote") == "ETH", F.col("px_ETH")).otherwise(1e0)
    return (
        trades.crossJoin(F.broadcast(px))  # one row
        .groupBy("symbol")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("price") * F.col("qty") * rate).alias("volume"))
    )


def with_volumes(state: DataFrame, volumes: DataFrame) -> DataFrame:
    """Adds vol_<symbol> to every row; a symbol without trades has none (0)."""
    wide = volumes.agg(
        *(F.coalesce(F.sum(F.when(F.col("symbol") == s, F.col("volume"))), F.lit(0e0)).alias(f"vol_{s}") for s in SYMBOLS)
    )
    return state.crossJoin(F.broadcast(wide))  # one row
