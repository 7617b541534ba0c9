"""Queries over captured inputs: archive rows, time units, symbols, dates, pool prices, latencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.stats import MIDDLE, order_statistics, ratio_pick, share_above, share_pick
from millrace.model import QUOTES
from millrace.operators import timeseries as ts
from millrace.plans.quotes import mids
from millrace.sources.captures import archive_trades as parsed
from millrace.sources.captures import hex_double, normalised_ms, unzipped, zipped
from millrace.sources.captures import split_symbol as split
from millrace.sources.market import duck_ctes, market

QUERIES, ORACLE = {}, {}
#: Taker fee on the exchange in bps, gas of a swap, its size in USD.
TAKER_BPS, SWAP_GAS, SIZE_USD = 7.5, 150_000, 1_000.0


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def normalise_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = market(spark, sf_dir, "fx_capture")
    return rows.select("seq", normalised_ms(F.col("event_time").cast("bigint")).alias("t_ms"))


ORACLE["normalise_time"] = f"""with {duck_ctes("fx_capture")}
select seq, case when event_time>1e14 then event_time::bigint//1000 else event_time::bigint end as t_ms from fx_capture"""


@query
def archive_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = market(spark, sf_dir, "fx_capture").select("seq", F.array(
        F.col("seq").cast("string"), "price_text", "qty_text", F.lit("0"), F.lit("0"), F.col("event_time").cast("bigint").cast("string"), "maker_text"
    ).alias("cells"))
    return parsed(rows, "cells").select("seq", "t_ms", "price", "qty", "buyer_maker")


ORACLE["archive_trades"] = f"""with {duck_ctes("fx_capture")}
select seq, case when event_time>1e14 then event_time::bigint//1000 else event_time::bigint end as t_ms, price_text::double as price, qty_text::double as qty,
 lower(maker_text)='true' as buyer_maker from fx_capture"""


@query
def scan_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades zipped into a CSV for each day and coin, and read back."""
    cells = ("seq", "price_text", "qty_text", "coin", "event_type", "event_time", "maker_text")
    day = F.to_date(F.timestamp_micros("t_us")).cast("string").alias("day")
    text = F.concat_ws(",", *(F.col(c).cast("bigint" if c == "event_time" else "string").cast("string") for c in cells)).alias("line")
    zips = zipped(market(spark, sf_dir, "fx_capture").select(day, "coin", "seq", text), ["day", "coin"], "line", "seq", "id,p,q,f,l,T,m")
    found = parsed(unzipped(zips))
    return found.select("file", "nth", F.get("cells", F.lit(0)).cast("bigint").alias("seq"), "t_ms", "price", "qty", "buyer_maker")


ORACLE["scan_archive"] = f"""with {duck_ctes("fx_capture")}
select make_timestamp(t_us)::date::varchar||'-'||coin||'.zip' as file, row_number() over (partition by make_timestamp(t_us)::date, coin order by seq)-1 as nth, seq,
 case when event_time>1e14 then event_time::bigint//1000 else event_time::bigint end as t_ms, price_text::double as price, qty_text::double as qty,
 lower(maker_text)='true' as buyer_maker from fx_capture"""


@query
def split_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = spark.createDataFrame([("USDT",), ("ABCXYZ",), ("FDUSDUSDT",), ("BTCFDUSD",), ("ETHBTC",), ("USDCBNB",)], "symbol string")
    rows = market(spark, sf_dir, "fx_listing").select("symbol").union(odd)
    return rows.withColumn("pair", split(F.col("symbol"))).select("symbol", "pair.base", "pair.quote")


_ENDS = " ".join(f"when symbol like '%_{q}' then '{q}'" for q in QUOTES)
ORACLE["split_symbol"] = f"""with {duck_ctes("fx_listing")},
s as (select symbol from fx_listing union all select unnest(['USDT','ABCXYZ','FDUSDUSDT','BTCFDUSD','ETHBTC','USDCBNB'])),
q as (select symbol, case {_ENDS} end as quote from s)
select symbol, left(symbol, len(symbol)-len(quote)) as base, quote from q"""


@query
def date_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each day of the events: the three months before its month, the three days before it, its first millisecond."""
    day = F.to_date(F.timestamp_micros("t_us"))
    rows = market(spark, sf_dir, "fx_tick").select(day.alias("day")).distinct()
    month = F.trunc("day", "month")
    return rows.select(
        F.col("day").cast("string").alias("day"),
        F.array_join(F.transform(F.sequence(F.lit(-3), F.lit(-1)), lambda i: F.date_format(F.add_months(month, i), "yyyy-MM")), ",").alias("months"),
        F.array_join(F.transform(F.sequence(F.lit(-3), F.lit(-1)), lambda i: F.date_add("day", i).cast("string")), ",").alias("days"),
        F.unix_millis(F.col("day").cast("timestamp")).alias("start_ms"),
    )


ORACLE["date_ranges"] = f"""with {duck_ctes("fx_tick")},
d as (select distinct make_timestamp(t_us)::date as day from fx_tick)
select day::varchar as day, array_to_string(list_transform([3,2,1], lambda i: strftime(date_trunc('month', day) - to_months(i::int), '%Y-%m')), ',') as months,
 array_to_string(list_transform([3,2,1], lambda i: (day - i::int)::varchar), ',') as days, epoch_ms(day::timestamp) as start_ms from d"""


@query
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lags in ms from event to receipt, with the event time's unit found by its size, by type of event."""
    event_us = F.when(F.col("event_time") > 1e14, F.col("event_time")).otherwise(F.col("event_time") * 1000)
    rows = market(spark, sf_dir, "fx_capture").select("event_type", ((F.col("now_us") - event_us) / 1e3).alias("ms"))
    picks = {f"p{round(q * 100)}": share_pick(q) for q in (0.5, 0.9, 0.99)}
    ranks = order_statistics(rows, ["event_type"], "ms", picks)
    ends = rows.groupBy("event_type").agg(F.min("ms").alias("least"), F.max("ms").alias("most"))
    return ends.join(F.broadcast(ranks), "event_type").select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("least", *picks, "most")))


ORACLE["latency_summary"] = f"""with {duck_ctes("fx_capture")},
l as (select event_type, (now_us - case when event_time>1e14 then event_time else event_time*1000 end)/1e3 as ms from fx_capture)
select event_type, count(*) as n, round(min(ms),6) as least, {", ".join(f"round(list_sort(list(ms))[least(count(*)-1, floor(count(*)*{q}::double)::bigint)+1],6) as p{round(q * 100)}" for q in (0.5, 0.9, 0.99))},
 round(max(ms),6) as most from l group by event_type"""


def pool_rate(slot0: Column, base: Column, quote: Column) -> Column:
    """Quote for one unit of base from a pool's square-root price (hexadecimal, 96 binary places); token 0 is the one
    with the smaller address."""
    rate = F.pow(hex_double(F.substring(slot0, 3, 64)) / float(1 << 96), F.lit(2.0))
    return F.when(F.lower(base) < F.lower(quote), rate).otherwise(F.try_divide(F.lit(1.0), rate))


@query
def pool_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = pool_rate(F.col("slot0"), F.col("base_address"), F.col("quote_address"))
    return market(spark, sf_dir, "fx_capture").select("seq", F.round(F.ln(rate), 9).alias("ln_price"))


ORACLE["pool_price"] = f"""with {duck_ctes("fx_capture")},
v as (select seq, lower(base_address)<lower(quote_address) as straight,
 list_sum(list_transform(range(8), lambda i: ('0x'||slot0[3+8*i:10+8*i])::bigint::double * power(2e0, 32*(7-i)))) / power(2e0,96) as root from fx_capture)
select seq, round(case when straight then 2 else -2 end*ln(root),9) as ln_price from v"""


@query
def dex_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    gas_price = (1 + F.col("seq") % 5) * 1e9
    return gap_report(spark, sf_dir, market(spark, sf_dir, "fx_pool").withColumn("gas_price", gas_price))


def gap_report(spark: SparkSession, sf_dir: str, pools: DataFrame) -> DataFrame:
    """Pools against the exchange's book: distance to its mid, and the better direction's edge after fees and gas."""
    bnb = mids(market(spark, sf_dir, "fx_quote").where("symbol = 'BNBUSDT'")).select("t_us", "seq", F.col("mid").alias("bnb"))
    rows = ts.asof(pools, bnb, [], ["bnb"]).where("bnb is not null")
    gas = SWAP_GAS * F.col("gas_price") / 1e18 * F.col("bnb") / SIZE_USD * 1e4
    share = F.when(F.col("symbol") == "USDCUSDT", 0e0).when(F.col("quote") == "USDC", 0.95).otherwise(1e0)
    kept = (1 - share * TAKER_BPS / 1e4) * (1 - F.col("pool_fee"))
    sell, buy = F.col("bid") * kept / F.col("pool_price") - 1, F.col("pool_price") * kept / F.col("ask") - 1
    rows = rows.select(
        "symbol", "pool_fee", F.abs((F.col("pool_price") / ((F.col("bid") + F.col("ask")) / 2) - 1) * 1e4).alias("gap"),
        (F.greatest(sell, buy) * 1e4 - gas).alias("edge"), gas.alias("gas"),
    )
    keys, each = ["symbol", "pool_fee"], F.array(*(F.struct(F.lit(c).alias("what"), F.col(c).alias("value")) for c in ("gas", "gap", "edge")))
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.max("gap").alias("max_gap"), F.max("edge").alias("max_edge"), share_above(F.col("edge"), 0.0).alias("positive")
    )
    long = rows.select(*keys, F.explode(each).alias("e")).select(*keys, "e.*")
    ranks = order_statistics(long, [*keys, "what"], "value", {"p95": ratio_pick(19, 20), **MIDDLE})
    of = lambda what, c: F.max(F.when(F.col("what") == what, c))
    middle = (F.col("low") + F.col("high")) / 2
    wide = ranks.groupBy(*keys).agg(
        of("gas", middle).alias("gas_bps"), of("gap", middle).alias("median_gap"), of("gap", F.col("p95")).alias("p95_gap"), of("edge", middle).alias("median_edge")
    )
    found = sums.join(F.broadcast(wide), keys)  # a row for each pool
    return found.select(*keys, "n", *(F.round(c, 6).alias(c) for c in ("gas_bps", "median_gap", "p95_gap", "max_gap", "median_edge", "max_edge", "positive")))


ORACLE["dex_gap"] = f"""with {duck_ctes("fx_pool", "fx_quote")},
bnb as (select t_us, (bid+ask)/2 as bnb from fx_quote where symbol='BNBUSDT'),
r as (select p.*, bnb, case when symbol='USDCUSDT' then 0e0 when quote='USDC' then 0.95::double else 1e0 end as share from fx_pool p asof join bnb on p.t_us>=bnb.t_us),
x as (select symbol, pool_fee, abs((pool_price/((bid+ask)/2)-1)*1e4) as gap, {SWAP_GAS}*(1+seq%5)*1e9/1e18*bnb/{SIZE_USD}::double*1e4 as gas,
 greatest(bid*((1-share*{TAKER_BPS}::double/1e4)*(1-pool_fee))/pool_price-1, pool_price*((1-share*{TAKER_BPS}::double/1e4)*(1-pool_fee))/ask-1)*1e4 as raw from r),
e as (select *, raw-gas as edge from x)
select symbol, pool_fee, count(*) as n, round(median(gas),6) as gas_bps, round(median(gap),6) as median_gap, round(list_sort(list(gap))[count(*)*19//20+1],6) as p95_gap,
 round(max(gap),6) as max_gap, round(median(edge),6) as median_edge, round(max(edge),6) as max_edge, round(avg(case when edge>0 then 1e0 else 0e0 end)*100,6) as positive from e group by 1,2"""
