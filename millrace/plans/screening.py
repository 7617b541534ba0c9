"""Queries that look for pairs with wide spreads: candidates with and without a USDT anchor, symbols to record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.stats import medians
from millrace.model import QUOTES
from millrace.plans.common import MAKER_BPS
from millrace.session import stored
from millrace.sources.market import duck_ctes, market

QUERIES, ORACLE = {}, {}
#: Bounds of a candidate's daily volume in USD, candidates of each list, and what an anchor has to have.
LEAST_USD, MOST_USD, TOP = 2e5, 2e7, 15
ANCHOR_VOLUME, ANCHOR_SPREAD = 10.0, 3.0
#: USD for a unit of each quote asset of the test data.
USD = {"USDT": 1.0, "USDC": 1.0, "FDUSD": 1.0, "BTC": 8e4, "ETH": 2.5e3, "BNB": 8e2}


def query(f):
    QUERIES[f.__name__] = f
    return f


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pairs_of() the tables, worked out once: its users read it several times."""
    return stored(pairs_of(*(market(spark, sf_dir, view) for view in ("fx_listing", "fx_touch", "fx_day"))), "pairs")


def pairs_of(listing: DataFrame, touches: DataFrame, days: DataFrame) -> DataFrame:
    """symbol, base, quote, n, spread (median, bps), usd (daily volume) of trading pairs with valid quotes."""
    listed = stored(listing.where((F.col("status") == "TRADING") & F.col("quote").isin(*QUOTES)), "listed")
    touch = touches.where((F.col("bid") > 0) & (F.col("ask") > F.col("bid")))
    bps = (F.col("ask") - F.col("bid")) / ((F.col("ask") + F.col("bid")) / 2) * 1e4
    spreads = touch.join(listed, "symbol", "left_semi").select("symbol", bps.alias("bps"))
    spreads = medians(stored(spreads, "spreads"), ["symbol"], "bps", "spread")
    usd = F.element_at(F.create_map(*(F.lit(x) for kv in USD.items() for x in kv)), F.col("quote"))
    day = days.join(listed, "symbol").withColumn("usd", F.col("quote_volume") * usd)
    return spreads.join(day.select("symbol", "base", "quote", "usd"), "symbol")


def ceiling() -> Column:
    """USD a day for 1 % of the volume, each fill earning half the spread less a maker fee."""
    return (F.col("spread") / 2 - MAKER_BPS) / 1e4 * F.col("usd") * 0.01


def wide(found: DataFrame) -> DataFrame:
    return found.where(F.col("usd").between(LEAST_USD, MOST_USD) & (F.col("spread") > 2 * MAKER_BPS)).withColumn("ceiling", ceiling())


def anchored(found: DataFrame) -> DataFrame:
    """Wide pairs with their base's USDT pair, where that trades far more and closer: anchor, anchor_spread, anchor_usd."""
    usdt = found.where("quote = 'USDT'").select("base", F.col("symbol").alias("anchor"), F.col("spread").alias("anchor_spread"), F.col("usd").alias("anchor_usd"))
    good = (F.col("anchor_usd") >= ANCHOR_VOLUME * F.col("usd")) & (F.col("anchor_spread") <= F.col("spread") / ANCHOR_SPREAD)
    return wide(found).where("quote <> 'USDT'").join(usdt, "base").where(good)


def without_anchor(found: DataFrame) -> DataFrame:
    return wide(found).join(anchored(found), "symbol", "left_anti")


def _top(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("ceiling"), "symbol").limit(TOP)


_PAIRS = f"""{duck_ctes("fx_listing", "fx_touch", "fx_day")},
listed as (select * from fx_listing where status='TRADING' and quote in {QUOTES}),
sp as (select symbol, count(*) as n, median((ask-bid)/((ask+bid)/2)*1e4) as spread from fx_touch where bid>0 and ask>bid and symbol in (select symbol from listed) group by symbol),
pairs as (select sp.*, l.base, l.quote, quote_volume*case l.quote {" ".join(f"when '{k}' then {v!r}::double" for k, v in USD.items())} end as usd from sp join listed l using (symbol) join fx_day using (symbol)),
wide as (select *, (spread/2-{MAKER_BPS}e0)/1e4*usd*0.01::double as ceiling from pairs where usd between {LEAST_USD} and {MOST_USD} and spread>{2 * MAKER_BPS}),
anchored as (select w.*, a.symbol as anchor, a.spread as anchor_spread, a.usd as anchor_usd from wide w join pairs a on a.base=w.base and a.quote='USDT'
 where w.quote<>'USDT' and a.usd>={ANCHOR_VOLUME}*w.usd and a.spread<=w.spread/{ANCHOR_SPREAD}::double),
own as (select * from wide where symbol not in (select symbol from anchored)),
top_a as (from anchored order by ceiling desc, symbol limit {TOP}), top_o as (from own order by ceiling desc, symbol limit {TOP})"""


@query
def spread_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(pairs(spark, sf_dir))


def scanned(found: DataFrame) -> DataFrame:
    """All wide pairs, and whether they have an anchor."""
    has = anchored(found).select("symbol", F.lit(True).alias("has"))
    rows = wide(found).join(has, "symbol", "left")
    return rows.select(
        "symbol", "n", F.round("spread", 6).alias("spread"), F.round("usd", 2).alias("usd"), F.round("ceiling", 4).alias("ceiling"),
        F.coalesce("has", F.lit(False)).alias("anchored"),
    )


ORACLE["spread_scan"] = f"""with {_PAIRS}
select symbol, n, round(spread,6) as spread, round(usd,2) as usd, round(ceiling,4) as ceiling, symbol in (select symbol from anchored) as anchored from wide"""


@query
def spread_scan_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _top(anchored(pairs(spark, sf_dir)))
    return rows.select(
        "symbol", F.round("spread", 6).alias("spread"), F.round("usd", 2).alias("usd"), "anchor", F.round("anchor_spread", 6).alias("anchor_spread"),
        F.round("anchor_usd", 2).alias("anchor_usd"), F.round("ceiling", 4).alias("ceiling"),
    )


ORACLE["spread_scan_anchor"] = f"""with {_PAIRS}
select symbol, round(spread,6) as spread, round(usd,2) as usd, anchor, round(anchor_spread,6) as anchor_spread, round(anchor_usd,2) as anchor_usd, round(ceiling,4) as ceiling from top_a"""


@query
def spread_scan_own(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _top(without_anchor(pairs(spark, sf_dir)))
    return rows.select(
        "symbol", F.round("spread", 6).alias("spread"), F.round("usd", 2).alias("usd"), F.round(F.col("spread") - 2 * MAKER_BPS, 6).alias("left_bps"),
        F.round("ceiling", 4).alias("ceiling"),
    )


ORACLE["spread_scan_own"] = f"""with {_PAIRS}
select symbol, round(spread,6) as spread, round(usd,2) as usd, round(spread-{2 * MAKER_BPS}e0,6) as left_bps, round(ceiling,4) as ceiling from top_o"""


@query
def record_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates' symbols (trades), and these with the listed USDT pairs of their assets (books)."""
    found = pairs(spark, sf_dir)
    makes = _top(anchored(found)).select("symbol", "base", "quote").union(_top(without_anchor(found)).select("symbol", "base", "quote"))
    listed = market(spark, sf_dir, "fx_listing").where("status = 'TRADING'").select(F.col("symbol").alias("listed"))
    priced = makes.where("quote <> 'USDT'").select(F.explode(F.array("base", "quote")).alias("asset"))
    priced = priced.join(listed, F.col("listed") == F.concat("asset", F.lit("USDT")), "left_semi").select(F.concat("asset", F.lit("USDT")).alias("symbol"))
    books = makes.select("symbol").union(priced).distinct().withColumn("kind", F.lit("books"))
    rows = books.union(makes.select("symbol", F.lit("trades").alias("kind")))
    return rows.groupBy("kind").agg(F.array_join(F.array_sort(F.collect_list("symbol")), ",").alias("symbols"))  # 4 * TOP at most


ORACLE["record_symbols"] = f"""with {_PAIRS},
makes as (select symbol, base, quote from top_a union all select symbol, base, quote from top_o),
books as (select symbol from makes union select symbol from listed_all where symbol in (select unnest([base||'USDT', quote||'USDT']) from makes where quote<>'USDT'))
select 'trades' as kind, string_agg(symbol, ',' order by symbol) as symbols from makes union all select 'books', string_agg(symbol, ',' order by symbol) from books""".replace(
    "makes as (", "listed_all as (select * from fx_listing where status='TRADING'),\nmakes as (", 1
)
