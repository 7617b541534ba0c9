"""Market-shaped views of the test tables, in SQL that Spark and DuckDB both read.

{US} stands for the event time in microseconds; other names in braces are the tables and views that a view reads.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "fx_symbol": """
select * from (values (0,'BTCUSDT','BTC','USDT',8e4),(1,'ETHUSDT','ETH','USDT',2.5e3),(2,'BNBUSDT','BNB','USDT',8e2),
 (3,'USDCUSDT','USDC','USDT',1e0),(4,'BTCUSDC','BTC','USDC',8e4),(5,'ETHUSDC','ETH','USDC',2.5e3),(6,'BNBUSDC','BNB','USDC',8e2),
 (7,'ETHBTC','ETH','BTC',3.125e-2),(8,'BNBBTC','BNB','BTC',1e-2),(9,'BNBETH','BNB','ETH',3.2e-1)) as v(idx,symbol,base,quote,px)""",
    "fx_tick": """
select e.event_id as seq, e.t_us, e.event_type, e.k, s.idx, s.symbol, s.base, s.quote,
 s.px*(1e0+cast((e.event_id*7+e.k*3)%41-20 as double)*5e-5)*(1e0-cast(1+e.event_id%3 as double)*5e-6) as bid,
 s.px*(1e0+cast((e.event_id*7+e.k*3)%41-20 as double)*5e-5)*(1e0+cast(1+e.event_id%3 as double)*5e-6) as ask
from (select event_id, {US} as t_us, event_type, user_id%10 as idx,
             cast(substring(props,7,length(props)-7) as bigint) as k from {events}) e
join {fx_symbol} s on s.idx=e.idx""",
    "fx_quote": """
select seq, t_us, symbol, base, quote, bid, cast(1+k as double) as bid_qty, ask, cast(100-k as double) as ask_qty
from {fx_tick} where event_type<>'purchase'""",
    "fx_trade": """
select seq, t_us, symbol, base, quote, case when seq%2=0 then bid else ask end as price,
 cast(1+k as double) as qty, (seq%2=0) as buyer_maker
from {fx_tick} where event_type='purchase'""",
    "fx_depth": """
select q.seq, q.t_us, q.symbol, l.lvl, q.bid*(1e0-cast(l.lvl as double)*1e-4) as bid_px, q.bid_qty*cast(1+l.lvl as double) as bid_qty,
 q.ask*(1e0+cast(l.lvl as double)*1e-4) as ask_px, q.ask_qty*cast(1+l.lvl as double) as ask_qty
from {fx_quote} q cross join (values (0),(1),(2),(3),(4)) as l(lvl)""",
    "fx_alt_trade": """
select seq, t_us, concat('C',cast(idx as string)) as coin,
 case when event_type in ('view','signup') then 'perp' else 'spot' end as market,
 cast(100+10*idx as double)*(1e0+cast((seq*7+k*3)%41-20 as double)*5e-5)
   *(case when event_type in ('view','signup') then 1.0005e0 else 1e0 end) as price,
 cast(1+k as double) as qty, (seq%2=0) as buyer_maker
from {fx_tick}""",
    "fx_close": """
select market, coin, t_us - t_us%21600000000 as bucket_us, max_by(price, seq) as close
from {fx_alt_trade} group by market, coin, t_us - t_us%21600000000""",
    "fx_funding": """
select o_orderpriority as perp, o_orderdate as ts, cast(min(o_orderkey)%61-20 as double)*1e-5 as rate, 24 as interval_h
from {orders} group by o_orderpriority, o_orderdate""",
    "fx_snapshot": """
select concat('K',cast(p.p_partkey - p.p_partkey%3 as string)) as base,
 case when p.p_partkey%3=0 then 'USDT' when p.p_partkey%3=1 then 'USDC' else 'BTC' end as quote,
 p.p_partkey as pair_id, p.p_retailprice as bid, p.p_retailprice*(1e0+(1e0+l.l_quantity)*1e-4) as ask
from {part} p join {lineitem} l on l.l_partkey=p.p_partkey""",
    "fx_pool": """
select seq, t_us, symbol, quote, bid, ask, (bid+ask)*5e-1*(1e0+cast((seq%101)-50 as double)*1e-5) as pool_price,
 case when seq%2=0 then 1e-4 else 5e-4 end as pool_fee
from {fx_tick} where event_type='view'""",
    "fx_perp": """
select distinct concat(case when idx%5=0 then '' when idx%5 in (1,2) then '1000' else '1000000' end, 'C', cast(idx as string), 'USDT') as perp
from {fx_tick} where idx%5<>4
union select distinct concat('1000000C', cast(idx as string), 'USDT') from {fx_tick} where idx%4=1""",
    "fx_listing": """
select distinct concat(base,quote) as symbol, base, quote, case when pair_id%10=7 then 'BREAK' else 'TRADING' end as status from {fx_snapshot}""",
    "fx_touch": """
select concat(base,quote) as symbol, bid, bid+(ask-bid)*(case when pair_id%6=0 then 2e-1 else 1e0 end)*(case when pair_id%17=5 then -1e0 else 1e0 end) as ask
from {fx_snapshot}""",
    "fx_day": """
select concat(base,quote) as symbol, sum(bid)*(case when pair_id%3=0 then 1.5e2 when pair_id%3=1 then 1e1 else 1.25e-4 end) as quote_volume
from {fx_snapshot} group by base, quote, pair_id""",
    "fx_capture": """
select seq, t_us, event_type, t_us + seq*7919%50000 as now_us, case when seq%2=0 then t_us else (t_us-t_us%1000)/1000 end as event_time,
 concat('C',cast(idx as string)) as coin, cast(seq%1000 as string) as price_text, cast(1+k as string) as qty_text,
 case when seq%3=0 then 'True' when seq%3=1 then 'true' else 'false' end as maker_text,
 concat('0x000000000000000000000000', substring(concat(md5(cast(seq as string)), md5(cast(seq+1 as string))), 1, 40)) as slot0,
 concat('0x', md5(concat('base',cast(idx as string)))) as base_address, concat('0x', md5(concat('quote',cast(seq%7 as string)))) as quote_address
from {fx_tick}""",
    "fx_diff": """
select seq, t_us, symbol, px, k, n%31=0 as snapshot, case when n%31=0 then null else 3*n+1-n%2 end as first_id, 3*n+3 as last_id, n
from (select seq, t_us, symbol, k, base, quote, row_number() over (partition by symbol order by seq) - 1 as n from {fx_tick} where event_type<>'purchase') t
join (select symbol as of, px from {fx_symbol}) s on s.of=t.symbol
where n%23<>11""",
    "fx_diff_level": """
select seq, s.bid, d.px*(1e0+(case when s.bid then -1e0 else 1e0 end)*cast(1+l.lvl as double)*1e-4) as px,
 case when d.snapshot then cast(1+(d.n+l.lvl)%10 as double) when (d.n+l.lvl*3+d.k)%4=0 then 0e0 else cast(1+(d.k+l.lvl*7)%50 as double) end as qty
from {fx_diff} d cross join (values (0),(1),(2),(3),(4),(5),(6),(7),(8),(9),(10)) as l(lvl) cross join (values (true),(false)) as s(bid)
where (d.snapshot and l.lvl<8) or (not d.snapshot and (l.lvl=(d.k+case when s.bid then 0 else 5 end)%11 or l.lvl=(d.n*5+d.k)%11))""",
}
SPARK_US = "unix_micros(cast(ts as timestamp))"
DUCK_US = "epoch_us(ts)"


def reads(view: str) -> list[str]:
    return [n for n in re.findall(r"{(\w+)}", VIEWS[view]) if n != "US"]


def market(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """A view over the tables of sf_dir; the session's time zone has to be UTC."""
    frames = {
        n: market(spark, sf_dir, n) if n in VIEWS else spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in reads(view)
    }
    return spark.sql(VIEWS[view].replace("{US}", SPARK_US), **frames)


def duck_ctes(*views: str) -> str:
    """The views and those they read, as the beginning of a WITH clause for DuckDB."""

    def needed(view: str) -> list[str]:
        return reduce(lambda out, n: out + [x for x in needed(n) if x not in out], filter(VIEWS.get, reads(view)), []) + [view]

    names = list(dict.fromkeys(n for v in views for n in needed(v)))
    body = lambda n: re.sub(r"{(\w+)}", r"\1", VIEWS[n].replace("{US}", DUCK_US))
    return ",\n".join(f"{n} as ({body(n)})" for n in names)
