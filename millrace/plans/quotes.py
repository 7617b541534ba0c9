"""Queries over quotes and trades: spreads, rates, as-of lookups, markouts against the own mid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.stats import MIDDLE, median, order_statistics, ratio_pick
from millrace.model import STABLES, SYMBOLS
from millrace.operators import markout as mk
from millrace.operators import timeseries as ts
from millrace.plans.common import FRESH, GRID, HORIZONS, MAKER_BPS, PRE, ROWS
from millrace.sources.market import duck_ctes, market

QUERIES, ORACLE = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def mids(quotes: DataFrame) -> DataFrame:
    return quotes.select("symbol", "t_us", "seq", ((F.col("bid") + F.col("ask")) / 2).alias("mid"))


@query
def quote_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    bid, ask = F.col("bid"), F.col("ask")
    rows = market(spark, sf_dir, "fx_quote").withColumn("bps", (ask - bid) / ((ask + bid) / 2) * 1e4)
    sums = rows.groupBy("symbol").agg(F.min("bps").alias("min_bps"), F.max("bps").alias("max_bps"), F.avg((bid + ask) / 2).alias("mean_mid"))
    ranks = order_statistics(rows, ["symbol"], "bps", {"p95_bps": ratio_pick(19, 20), **MIDDLE})
    return ranks.join(sums, "symbol").select(
        "symbol", "n", F.round((F.col("low") + F.col("high")) / 2, 6).alias("median_bps"),
        *(F.round(c, 6).alias(c) for c in ("p95_bps", "min_bps", "max_bps", "mean_mid")),
    )


ORACLE["quote_spread"] = f"""with {duck_ctes("fx_quote")},
b as (select symbol, (ask-bid)/((ask+bid)/2)*1e4 as bps, (bid+ask)/2 as mid from fx_quote)
select symbol, count(*) as n, round(median(bps),6) as median_bps,
 round(list_sort(list(bps))[count(*)*19//20+1],6) as p95_bps, round(min(bps),6) as min_bps,
 round(max(bps),6) as max_bps, round(avg(mid),6) as mean_mid from b group by symbol"""


@query
def update_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = market(spark, sf_dir, "fx_quote").select("symbol", "t_us")
    seconds = quotes.groupBy("symbol", F.expr("t_us div 1000000").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    by_symbol = seconds.groupBy("symbol").agg(F.sum("n").alias("n"), F.max("n").alias("busiest_second"))
    first = quotes.groupBy("symbol").agg(F.min("t_us").alias("first"), F.max("t_us").alias("last"))
    span = first.agg(((F.max("last") - F.max("first")) / 1e6).alias("span_s"))
    return by_symbol.crossJoin(F.broadcast(span)).select(
        "symbol", "n", "busiest_second", F.round(F.try_divide(F.col("n"), "span_s"), 9).alias("per_second")
    )


ORACLE["update_rates"] = f"""with {duck_ctes("fx_quote")},
s as (select symbol, t_us//1000000 as s, count(*) as n from fx_quote group by all),
f as (select symbol, min(t_us) as f, max(t_us) as l from fx_quote group by symbol)
select symbol, sum(n)::bigint as n, max(n) as busiest_second,
 round(sum(n)/nullif((select (max(l)-max(f))/1e6 from f),0),9) as per_second from s group by symbol"""


@query
def asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    trades = market(spark, sf_dir, "fx_trade").select("seq", "symbol", "t_us", "price")
    found = ts.asof(trades, mids(market(spark, sf_dir, "fx_quote")), ["symbol"], ["mid"])
    return found.select("seq", "symbol", "t_us", "price", "mid")


ORACLE["asof_backward"] = f"""with {duck_ctes("fx_quote", "fx_trade")}
select t.seq, t.symbol, t.t_us, t.price, (q.bid+q.ask)/2 as mid
from fx_trade t asof left join fx_quote q on t.symbol=q.symbol and t.t_us>=q.t_us"""


@query
def asof_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = mids(market(spark, sf_dir, "fx_quote"))
    bounds = quotes.groupBy("symbol").agg(F.min("t_us").alias("t0"), F.max("t_us").alias("t1"))
    found = ts.asof(ts.grid(bounds, GRID), quotes, ["symbol"], ["mid"], strict=True, most=ROWS)
    return found.select("symbol", "t_us", "mid")


ORACLE["asof_strict"] = f"""with {duck_ctes("fx_quote")},
g as (select symbol, unnest(range(min(t_us), max(t_us)+1, {GRID})) as t_us from fx_quote group by symbol)
select g.symbol, g.t_us, (q.bid+q.ask)/2 as mid
from g asof left join fx_quote q on g.symbol=q.symbol and g.t_us>q.t_us"""


@query
def grid_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly samples of every symbol's spread, with the whole book known, as it stood before each grid point."""
    quotes = market(spark, sf_dir, "fx_quote")
    state = ts.book_state(quotes, list(SYMBOLS))
    bounds = state.agg(F.min("t_us").alias("t0"), F.max("t_us").alias("t1"))
    columns = [f"{c}_{s}" for s in SYMBOLS for c in ("bid", "ask")]
    found = ts.asof(ts.grid(bounds, GRID), state, [], columns, strict=True).where(F.col("bid_BTCUSDT").isNotNull())
    spread = lambda s: (F.col(f"ask_{s}") - F.col(f"bid_{s}")) / ((F.col(f"ask_{s}") + F.col(f"bid_{s}")) / 2) * 1e4
    rows = found.select(
        "t_us", F.explode(F.array(*(F.struct(F.lit(s).alias("symbol"), spread(s).alias("bps")) for s in SYMBOLS))).alias("x")
    )
    return rows.groupBy("x.symbol").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("x.bps"), 6).alias("mean_bps"), F.round(median("x.bps"), 6).alias("median_bps")
    )


ORACLE["grid_sample"] = f"""with {duck_ctes("fx_quote")},
st as (select max(f) as t0, (select max(t_us) from fx_quote) as t1 from (select symbol, min(t_us) as f from fx_quote group by symbol)),
g as (select unnest(range(t0, t1+1, {GRID})) as t_us from st),
p as (select g.t_us, s.symbol from g cross join (select distinct symbol from fx_quote) s),
b as (select p.symbol, (q.ask-q.bid)/((q.ask+q.bid)/2)*1e4 as bps
 from p asof join fx_quote q on p.symbol=q.symbol and p.t_us>q.t_us where p.t_us>(select t0 from st))
select symbol, count(*) as n, round(avg(bps),6) as mean_bps, round(median(bps),6) as median_bps from b group by symbol"""


def marked_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    trades = market(spark, sf_dir, "fx_trade").drop("base")
    return mk.marked(trades, market(spark, sf_dir, "fx_quote"), PRE, HORIZONS)


def with_rate(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """Adds rate: USDT for a unit of the quote asset at the trade; null if unknown."""
    quotes = mids(market(spark, sf_dir, "fx_quote"))
    books = quotes.where(F.col("symbol").endswith("USDT")).select(
        F.expr("substring(symbol, 1, length(symbol) - 4)").alias("quote"), "t_us", "seq", F.col("mid").alias("_rate")
    )
    found = ts.asof(rows, books, ["quote"], ["_rate"])
    has_book = F.broadcast(books.select(F.col("quote").alias("_asset")).distinct())
    found = found.join(has_book, F.col("quote") == F.col("_asset"), "left")
    stable = F.col("_asset").isNull() & F.col("quote").isin(*STABLES)
    return found.withColumn("rate", F.when(stable, 1e0).otherwise(F.col("_rate"))).drop("_rate", "_asset")


_MARKED = f"""{duck_ctes("fx_quote", "fx_trade")},
lastq as (select symbol, max(t_us) as last_us from fx_quote group by symbol),
pr as (select t.*, o, t.t_us + o as p_us from fx_trade t cross join (values (-{PRE}),({HORIZONS[0]}),({HORIZONS[1]}),({HORIZONS[2]})) v(o)),
lk as (select pr.*, (q.bid+q.ask)/2 as v from pr asof left join fx_quote q on pr.symbol=q.symbol and pr.p_us>=q.t_us),
wide as (select seq, symbol, quote, t_us, price, qty, buyer_maker, {", ".join(f"max(v) filter (o={o}) as v{i}" for i, o in enumerate((-PRE, *HORIZONS)))}
 from lk group by all),
sided as (select w.*, case when buyer_maker then 1e0 else -1e0 end as side, price*qty as w
 from wide w join lastq using (symbol) where v0 is not null and t_us + {HORIZONS[2]} <= last_us),
marked as (select *, {", ".join(f"side*(v{i}/price-1)*1e4 as m_{i}" for i in range(4))} from sided),
bookrate as (select symbol[1:len(symbol)-4] as quote, t_us, (bid+ask)/2 as r from fx_quote where symbol like '%USDT'),
rated as (select m.*, case when b.r is null and m.quote in ('USDT','USDC','FDUSD') and m.quote not in (select quote from bookrate) then 1e0 else b.r end as rate
 from marked m asof left join bookrate b on m.quote=b.quote and m.t_us>=b.t_us)"""


def _own(rows: DataFrame) -> DataFrame:
    return rows.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("w").alias("w"),
        F.when(F.bool_and(F.col("rate").isNotNull()), F.sum(F.col("w") * F.col("rate"))).alias("usdt"),
        *mk.weighted([f"m_{i}" for i in range(4)]),
    )


@query
def markout_own(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _own(with_rate(spark, sf_dir, marked_trades(spark, sf_dir)))
    return rows.select(
        "symbol", "n", F.round("w", 2).alias("notional"), F.round("usdt", 2).alias("usdt"),
        *(F.round(f"m_{i}", 6).alias(f"m_{i}") for i in range(4)),
        F.round(F.col("m_3") - MAKER_BPS, 6).alias("after_fee"),
    ).orderBy(F.desc("m_3"), "symbol")


_OWN = """own as (select symbol, count(*) as n, sum(w) as w, case when bool_and(rate is not null) then sum(w*rate) end as usdt,
 sum(m_0*w)/sum(w) as m_0, sum(m_1*w)/sum(w) as m_1, sum(m_2*w)/sum(w) as m_2, sum(m_3*w)/sum(w) as m_3 from rated group by symbol)"""
ORACLE["markout_own"] = f"""with {_MARKED}, {_OWN}
select symbol, n, round(w,2) as notional, round(usdt,2) as usdt, round(m_0,6) as m_0, round(m_1,6) as m_1, round(m_2,6) as m_2,
 round(m_3,6) as m_3, round(m_3-{MAKER_BPS}e0,6) as after_fee from own"""


@query
def markout_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs together, each by its USDT notional; pairs without one are left out."""
    own = _own(with_rate(spark, sf_dir, marked_trades(spark, sf_dir))).where(F.col("usdt").isNotNull())
    total = own.agg(F.sum("n").alias("n"), F.sum("usdt").alias("usdt"), *mk.weighted([f"m_{i}" for i in range(4)], "usdt"))
    return total.select(
        "n", F.round("usdt", 2).alias("usdt"), *(F.round(f"m_{i}", 6).alias(f"m_{i}") for i in range(4)),
        F.round(F.col("m_3") - MAKER_BPS, 6).alias("after_fee"),
    )


ORACLE["markout_rollup"] = f"""with {_MARKED}, {_OWN}
select sum(n)::bigint as n, round(sum(usdt),2) as usdt, {", ".join(f"round(sum(m_{i}*usdt)/sum(usdt),6) as m_{i}" for i in range(4))},
 round(sum(m_3*usdt)/sum(usdt)-{MAKER_BPS}e0,6) as after_fee from own where usdt is not null"""

KEPT = (0.0, 1.0, 2.0)


@query
def markout_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notional kept, and its P&L at the second horizon, if only fills with an edge of N or more are taken."""
    rows = marked_trades(spark, sf_dir).groupBy("symbol").agg(
        F.sum("w").alias("w"), *mk.kept(F.col("m_0"), KEPT, F.col("m_2"), F.col("w"))
    )
    return rows.select("symbol", *mk.kept_report(KEPT))


ORACLE["markout_kept"] = f"""with {_MARKED}
select symbol, {", ".join(f"round(sum(case when m_0>={n} then w else 0 end)/sum(w),6) as share_{n:g}, round(sum(m_2*w) filter (m_0>={n})/nullif(sum(w) filter (m_0>={n}),0),6) as pnl_{n:g}" for n in KEPT)}
from marked group by symbol"""


@query
def trade_mids(spark: SparkSession, sf_dir: str) -> DataFrame:
    trades = market(spark, sf_dir, "fx_trade").select("seq", "symbol", "t_us", "price", "buyer_maker")
    return ts.trade_mids(trades, FRESH, ["symbol"])


ORACLE["trade_mids"] = f"""with {duck_ctes("fx_trade")},
w as (select symbol, t_us, seq,
 last_value(case when buyer_maker then price end ignore nulls) over x as bid, last_value(case when buyer_maker then t_us end ignore nulls) over x as bt,
 last_value(case when not buyer_maker then price end ignore nulls) over x as ask, last_value(case when not buyer_maker then t_us end ignore nulls) over x as att
 from fx_trade window x as (partition by symbol order by t_us, seq rows unbounded preceding))
select symbol, t_us, seq, (bid+ask)/2 as mid from w where bid is not null and ask is not null and t_us-least(bt,att)<={FRESH}"""


@query
def requotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mids(market(spark, sf_dir, "fx_quote")).withColumnRenamed("mid", "v")
    return ts.requotes(rows, 5.0, ["symbol"]).select("symbol", "n", F.round("per_minute", 9).alias("per_minute"))


ORACLE["requotes"] = f"""with {duck_ctes("fx_quote")},
l as (select symbol, list((bid+ask)/2 order by t_us, seq) as v, (max(t_us)-min(t_us))/6e7 as minutes from fx_quote group by symbol),
f as (select symbol, minutes, list_reduce(list_prepend({{'level': v[1], 'n': 0::bigint}}, list_transform(v, lambda x: {{'level': x, 'n': 0::bigint}})),
 lambda a, b: case when abs(b.level/a.level-1)*1e4>=5e0 then {{'level': b.level, 'n': a.n+1}} else a end).n as n from l)
select symbol, n, round(n/nullif(minutes,0),9) as per_minute from f"""


@query
def queue_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills by the maker side's share of the touch's size before them, in quarters; gain at the last horizon."""
    quotes = market(spark, sf_dir, "fx_quote")
    rows = marked_trades(spark, sf_dir).select("seq", "symbol", "t_us", "w", "buyer_maker", "m_3")
    found = ts.asof(rows.withColumn("t_us", F.col("t_us") - PRE), quotes.select("symbol", "t_us", "seq", "bid_qty", "ask_qty"), ["symbol"], ["bid_qty", "ask_qty"])
    own = F.when(F.col("buyer_maker"), F.col("bid_qty")).otherwise(F.col("ask_qty"))
    share = own / (F.col("bid_qty") + F.col("ask_qty"))
    return found.groupBy(F.least(F.floor(share * 4), F.lit(3)).cast("int").alias("quarter")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("w"), 2).alias("notional"), F.round(F.sum(F.col("m_3") * F.col("w")) / F.sum("w"), 6).alias("m_3")
    )


ORACLE["queue_share"] = f"""with {_MARKED},
p as (select *, t_us-{PRE} as p_us from marked),
j as (select p.*, case when buyer_maker then q.bid_qty else q.ask_qty end/(q.bid_qty+q.ask_qty) as share
 from p asof join fx_quote q on p.symbol=q.symbol and p.p_us>=q.t_us)
select least(floor(share*4),3)::int as quarter, count(*) as n, round(sum(w),2) as notional, round(sum(m_3*w)/sum(w),6) as m_3 from j group by 1"""


@query
def dedup_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflation: of every symbol's quotes in an hour the last one."""
    hour = F.expr(f"t_us - t_us % {GRID}")
    w = Window.partitionBy("symbol", "hour_us").orderBy(F.desc("t_us"), F.desc("seq"))
    rows = market(spark, sf_dir, "fx_quote").withColumn("hour_us", hour).withColumn("r", F.row_number().over(w))
    return rows.where("r = 1").select("symbol", "hour_us", "seq", "bid", "ask")


ORACLE["dedup_quotes"] = f"""with {duck_ctes("fx_quote")}
select symbol, t_us-t_us%{GRID} as hour_us, max(seq) as seq, max_by(bid, seq) as bid, max_by(ask, seq) as ask from fx_quote group by 1,2"""
