"""Queries over conversion cycles: enumeration, hurdles, edges, episodes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.stats import medians
from millrace.model import ASSETS, FEES_BPS, NEAR_BPS, SCHEDULE, SYMBOLS, fee_table, parse_fees
from millrace.operators import episodes as ep
from millrace.operators import graph, screen
from millrace.operators import timeseries as ts
from millrace.plans.common import FLAT
from millrace.session import stored
from millrace.sources.market import VIEWS, duck_ctes, market

QUERIES, ORACLE = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


_DIMS = f"""fx_symbol as ({VIEWS["fx_symbol"]}),
asset(i, asset) as (values {", ".join(f"({i},'{a}')" for i, a in enumerate(ASSETS))}),
leg as (select l.*, s.i as si, d.i as di from (select symbol, 'SELL' as side, base as src, quote as dst from fx_symbol
 union all select symbol, 'BUY', quote, base from fx_symbol) l join asset s on s.asset=l.src join asset d on d.asset=l.dst),
walk(nodes, symbols, sides) as (select [si, di], [symbol], [side] from leg
 union all select list_append(nodes, di), list_append(symbols, symbol), list_append(sides, side) from walk join leg on nodes[-1]=si
 where not list_contains(nodes, di) and len(nodes) < 5),
cyc as (select row_number() over (order by len(nodes), list_sort(nodes), nodes) - 1 as cycle_id, len(nodes) as n_legs,
 list_append(nodes, nodes[1]) as nodes, list_append(symbols, l.symbol) as symbols, list_append(sides, l.side) as sides
 from walk join leg l on nodes[-1]=l.si and nodes[1]=l.di where len(nodes)>=3 and nodes[1]=list_min(nodes)),
named as (select *, array_to_string(list_transform(nodes, lambda n: {list(ASSETS)}[n+1]), '->') as path from cyc),
cyc_leg as (select cycle_id, n_legs, path, unnest(symbols) as symbol, unnest(sides) as side from named)"""


@query
def legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.leg_table(spark).select("symbol", "side", "src", "dst")


ORACLE["legs"] = f"with recursive {_DIMS} select symbol, side, src, dst from leg"


@query
def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graph.cycle_table(spark)
    return rows.select("cycle_id", "n_legs", "path", F.array_join("symbols", ",").alias("symbols"), F.array_join("sides", ",").alias("sides"))


ORACLE["cycles"] = f"""with recursive {_DIMS} select cycle_id::int as cycle_id, n_legs::int as n_legs, path,
 array_to_string(symbols, ',') as symbols, array_to_string(sides, ',') as sides from named"""


@query
def cycle_rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graph.rotate(graph.cycle_table(spark), "ETH")
    return rows.select("cycle_id", "path", F.array_join("symbols", ",").alias("symbols"))


ORACLE["cycle_rotate"] = f"""with recursive {_DIMS},
r as (select *, list_position(nodes[1:n_legs], {ASSETS.index("ETH")}) as p from named where list_contains(nodes, {ASSETS.index("ETH")}))
select cycle_id::int as cycle_id, array_to_string(list_transform(nodes[p:n_legs] || nodes[1:p], lambda n: {list(ASSETS)}[n+1]), '->') as path,
 array_to_string(symbols[p:] || symbols[1:p-1], ',') as symbols from r"""


@query
def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graph.open_paths(graph.leg_table(spark), 4)
    return rows.select(F.size("symbols").alias("n_legs"), graph.names_of(F.col("nodes")).alias("path"), F.array_join("symbols", ",").alias("symbols"))


ORACLE["paths"] = f"""with recursive {_DIMS} select len(symbols)::int as n_legs,
 array_to_string(list_transform(nodes, lambda n: {list(ASSETS)}[n+1]), '->') as path, array_to_string(symbols, ',') as symbols from walk"""


@query
def fee_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fee_table(spark, parse_fees(SCHEDULE)).select("symbol", F.round("fee", 9).alias("fee"))


_FEES = f"""fees as (select s.symbol, coalesce(o.bps, split_part('{SCHEDULE}', ',', 1)::double)/1e4 as fee from fx_symbol s left join
 (select split_part(p, '=', 1) as symbol, split_part(p, '=', 2)::double as bps from (select unnest(string_split('{SCHEDULE}', ',')[2:]) as p)) o using (symbol))"""
ORACLE["fee_schedule"] = f"with fx_symbol as ({VIEWS['fx_symbol']}), {_FEES} select symbol, round(fee, 9) as fee from fees"


@query
def cycle_hurdles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.hurdles(graph.cycle_table(spark), fee_table(spark, parse_fees(SCHEDULE)))
    return found.select("cycle_id", "n_legs", "path", F.round(F.col("hurdle") * 1e4, 6).alias("hurdle_bps"))


_HURDLES = "hurdle as (select cycle_id, n_legs, path, -sum(ln(1e0-fee)) as h from cyc_leg join fees using (symbol) group by all)"
ORACLE["cycle_hurdles"] = f"""with recursive {_DIMS}, {_FEES}, {_HURDLES}
select cycle_id::int as cycle_id, n_legs::int as n_legs, path, round(h*1e4,6) as hurdle_bps from hurdle"""


@query
def hurdle_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.hurdles(graph.cycle_table(spark), fee_table(spark, parse_fees(SCHEDULE)))
    families = found.groupBy(F.round(F.col("hurdle") * 1e4, 2).alias("hurdle_bps")).agg(
        F.count(F.lit(1)).alias("n"), F.min_by("path", "cycle_id").alias("example")
    )
    return families.orderBy("hurdle_bps").limit(8)


ORACLE["hurdle_families"] = f"""with recursive {_DIMS}, {_FEES}, {_HURDLES}
select round(h*1e4,2) as hurdle_bps, count(*) as n, min_by(path, cycle_id) as example from hurdle group by 1 order by 1 limit 8"""

_QUOTES = duck_ctes("fx_quote").removeprefix(f"fx_symbol as ({VIEWS['fx_symbol']}),\n")
_STATE = f"""{_QUOTES},
st as (select * from (select seq, t_us, symbol, {", ".join(f"last_value(case when symbol='{s}' then {c} end ignore nulls) over w as {c}_{s}" for s in SYMBOLS for c in screen.BOOK)}
 from fx_quote window w as (order by t_us, seq rows unbounded preceding)) where {" and ".join(f"bid_{s} is not null" for s in SYMBOLS)})"""


@query
def book_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.book_state(market(spark, sf_dir, "fx_quote"), list(SYMBOLS))


ORACLE["book_state"] = f"""with fx_symbol as ({VIEWS["fx_symbol"]}), {_STATE} select seq, t_us, symbol, {", ".join(f"{c}_{s}" for s in SYMBOLS for c in ("bid", "ask"))} from st"""

_RATES = ", ".join(f"('{s}','SELL',ln(bid_{s})),('{s}','BUY',ln(1e0/ask_{s}))" for s in SYMBOLS)
_EDGES = f"""{_STATE},
rate as (select seq, t_us, st.symbol as by_symbol, v.symbol, v.side, v.lr from st, lateral (values {_RATES}) v(symbol, side, lr)),
edge as (select seq, t_us, by_symbol, cycle_id, n_legs, path, sum(lr) as e from rate join cyc_leg using (symbol, side) group by all)"""
_WITH = f"with recursive {_DIMS}, {_EDGES}"


def _wide(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    return rows.select("seq", *(F.col(column)[i].alias(f"{prefix}{i}") for i in range(len(graph.cycles()))))


@query
def cycle_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's gross log edge of each cycle."""
    return _wide(screen.every_cycle(market(spark, sf_dir, "fx_quote"), digits=9), "edges", "edge_")


ORACLE["cycle_edges"] = f"""{_WITH} select seq, {", ".join(f"round(max(e) filter (cycle_id={i}),9) as edge_{i}" for i in range(74))}
 from edge group by seq"""


def _net(fee: float) -> str:
    return f"e + n_legs*({math.log1p(-fee / 1e4)!r})"


@query
def best_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ep.scenarios(screen.scored(market(spark, sf_dir, "fx_quote")), (FLAT,))
    return rows.select("seq", F.round("net", 9).alias("net"), "cycle_id", "n_legs", F.round("capacity", 6).alias("capacity"))


_PX = {"USDT": "1e0", **{a: f"(bid_{a}USDT+ask_{a}USDT)/2" for a in ASSETS[1:]}}


def _cap(side: str) -> str:
    whens = " ".join(
        f"when l.symbol='{s}' then " + (f"bid_qty_{s}*({_PX[b]})" if side == "SELL" else f"ask_{s}*ask_qty_{s}*({_PX[q]})")
        for s, (b, q) in SYMBOLS.items()
    )
    return f"case {whens} end"


@query
def touch_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's capacity of each cycle at the touch, in USDT."""
    return _wide(screen.every_cycle(market(spark, sf_dir, "fx_quote"), "capacities", 6), "capacities", "usdt_")


_CAPS = f"""caps as (select seq, cycle_id, min(case when l.side='SELL' then {_cap("SELL")} else {_cap("BUY")} end) as cap
 from st cross join cyc_leg l group by all)"""
ORACLE["touch_capacity"] = f"""with recursive {_DIMS}, {_STATE}, {_CAPS}
select seq, {", ".join(f"round(max(cap) filter (cycle_id={i}),6) as usdt_{i}" for i in range(74))} from caps group by seq"""

_BEST_OF = lambda fee: f"""best as (select seq, t_us, by_symbol, net, cycle_id, n_legs, cap from (
 select *, {_net(fee)} as net, row_number() over (partition by seq order by round({_net(fee)},12) desc, cycle_id desc) as r
 from edge join caps using (seq, cycle_id)) where r=1)"""  # noqa: E731
ORACLE["best_cycle"] = f"""{_WITH}, {_CAPS}, {_BEST_OF(FLAT)}
select seq, round(net,9) as net, cycle_id::int as cycle_id, n_legs::int as n_legs, round(cap,6) as capacity from best"""

_RUNS = """flagged as (select *, net>0 as f, coalesce(lag(net>0) over (order by t_us, seq), false) as was from best),
opened as (select *, last_value(case when f and not was then seq end ignore nulls) over (order by t_us, seq rows unbounded preceding) as run from flagged),
ended as (select (select max(t_us) from best) as last_us, (select min(t_us) from best) as first_us),
eps as (select run, min(t_us) filter (f) as start_us, coalesce(max(t_us) filter (not f), last_us) as end_us, arg_min(by_symbol, seq) filter (f) as opened_by,
 coalesce(max(by_symbol) filter (not f), '(end of recording)') as closed_by, max(net) filter (f) as peak,
 arg_min({'c': cycle_id, 'n': n_legs, 'k': cap}, {'n': -net, 't': t_us, 's': seq}) filter (f) as top, first_us, last_us
 from opened, ended where f or was group by run, first_us, last_us)"""


def _found(spark: SparkSession, sf_dir: str, fees: tuple[float, ...]) -> DataFrame:
    found = ep.episodes(ep.scenarios(screen.scored(market(spark, sf_dir, "fx_quote")), fees), ["scenario"])
    return found.withColumn("fee", F.element_at(F.array(*map(F.lit, fees)), F.col("scenario") + 1))


@query
def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _found(spark, sf_dir, (FLAT,))
    return found.select(
        "run", "start_us", "end_us", "ms", "opened_by", "closed_by", F.round("peak", 9).alias("peak"), "cycle_id", "n_legs",
        F.round("capacity", 6).alias("capacity"),
    )


ORACLE["episodes"] = f"""{_WITH}, {_CAPS}, {_BEST_OF(FLAT)}, {_RUNS}
select run, start_us, end_us, (end_us-start_us)/1e3 as ms, opened_by, closed_by, round(peak,9) as peak, top.c::int as cycle_id,
 top.n::int as n_legs, round(top.k,6) as capacity from eps"""


@query
def episode_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes at every flat fee."""
    found = stored(_found(spark, sf_dir, FEES_BPS), "episodes")
    fee = F.element_at(F.array(*map(F.lit, FEES_BPS)), F.col("scenario") + 1)
    stats = ep.episode_stats(found, ["scenario"]).withColumn("fee", fee)
    rounded = {"per_hour": 6, "percent_of_time": 6, "median_peak_bps": 6, "median_capacity": 6}
    return stats.select(
        "fee", "n", *(F.round(c, d).alias(c) for c, d in rounded.items()), "p50_ms", "p90_ms", "max_ms", "legs_3", "legs_4", "legs_5"
    )


def _stats_sql(fee: float) -> str:
    return f"""(with {_BEST_OF(fee)}, {_RUNS}
 select {fee}::double as fee, count(*) as n, round(count(*)/((max(last_us)-max(first_us))/3.6e9),6) as per_hour,
 round(sum((end_us-start_us)/1e3)/36e3/((max(last_us)-max(first_us))/3.6e9),6) as percent_of_time, round(median(peak)*1e4,6) as median_peak_bps,
 round(median(top.k),6) as median_capacity,
 list_sort(list((end_us-start_us)/1e3))[least(count(*)-1, floor(count(*)*5e-1)::bigint)+1] as p50_ms,
 list_sort(list((end_us-start_us)/1e3))[least(count(*)-1, floor(count(*)*9e-1)::bigint)+1] as p90_ms, max((end_us-start_us)/1e3) as max_ms,
 count_if(top.n=3)::bigint as legs_3, count_if(top.n=4)::bigint as legs_4, count_if(top.n=5)::bigint as legs_5 from eps having count(*)>0)"""


ORACLE["episode_stats"] = f"{_WITH}, {_CAPS} " + " union all ".join(_stats_sql(f) for f in FEES_BPS)


@query
def episode_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six most frequent pairs of symbols that open and close episodes; of equal ones the first seen."""
    found = stored(_found(spark, sf_dir, (FLAT,)).select("opened_by", "closed_by", "ms", "run"), "episodes")
    pair = ["opened_by", "closed_by"]
    top = found.groupBy(*pair).agg(F.count(F.lit(1)).alias("n"), F.min("run").alias("first_seq")).orderBy(F.desc("n"), "first_seq").limit(6)
    lasting = medians(found.join(F.broadcast(top.select(*pair)), pair), pair, "ms", "median_ms").drop("n")
    return top.join(F.broadcast(lasting), pair).select(*pair, "n", "median_ms", "first_seq").orderBy(F.desc("n"), "first_seq")


ORACLE["episode_attribution"] = f"""{_WITH}, {_CAPS}, {_BEST_OF(FLAT)}, {_RUNS}
select opened_by, closed_by, count(*) as n, median((end_us-start_us)/1e3) as median_ms, min(run) as first_seq from eps
group by 1,2 order by n desc, first_seq limit 6"""


def _shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    fees = parse_fees(SCHEDULE)
    costs = [graph.hurdle_of(legs, fees) for legs in graph.cycles()]
    return screen.time_shares(market(spark, sf_dir, "fx_quote"), costs, NEAR_BPS / 1e4)


@query
def cycle_time_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shares(spark, sf_dir).select("cycle_id", "above_us", "near_us")


_SHARE = f"""{_WITH}, {_FEES}, {_HURDLES},
held as (select cycle_id, path, e, e - h as net, lead(t_us) over (partition by cycle_id order by t_us, seq) - t_us as dt from edge join hurdle using (cycle_id, path))"""
ORACLE["cycle_time_share"] = f"""{_SHARE} select cycle_id::int as cycle_id, coalesce(sum(dt) filter (e>0),0)::bigint as above_us,
 coalesce(sum(dt) filter (net>-{NEAR_BPS / 1e4!r}),0)::bigint as near_us from held group by 1"""


def _with_path(spark: SparkSession, rows: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(graph.cycle_table(spark).select("cycle_id", "path")), "cycle_id")


@query
def closest_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _shares(spark, sf_dir).select("cycle_id", F.round("max_edge", 9).alias("max_edge"))
    return _with_path(spark, rows.orderBy(F.desc("max_edge"), "cycle_id").limit(12))


ORACLE["closest_cycles"] = f"{_SHARE} select cycle_id::int as cycle_id, path, round(max(e),9) as max_edge from held group by 1,2 order by 3 desc, 1 limit 12"


@query
def closest_cycles_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _shares(spark, sf_dir).select("cycle_id", F.round("max_net", 9).alias("max_net"))
    return _with_path(spark, rows.orderBy(F.desc("max_net"), "cycle_id").limit(10))


ORACLE["closest_cycles_net"] = f"{_SHARE} select cycle_id::int as cycle_id, path, round(max(net),9) as max_net from held group by 1,2 order by 3 desc, 1 limit 10"


@query
def dirty_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many cycles each update touches, and how many re-scores that makes, by symbol."""
    touched = graph.cycle_table(spark).select("cycle_id", F.explode("symbols").alias("symbol"))
    updates = market(spark, sf_dir, "fx_quote").groupBy("symbol").agg(F.count(F.lit(1)).alias("updates"))
    return updates.join(F.broadcast(touched), "symbol").groupBy("symbol", "updates").agg(
        F.count(F.lit(1)).alias("cycles"), F.sum("updates").alias("rescores")
    )


ORACLE["dirty_cycles"] = f"""with recursive {_DIMS}, {_QUOTES},
u as (select symbol, count(*) as updates from fx_quote group by 1)
select symbol, updates, count(*) as cycles, sum(updates)::bigint as rescores from u join cyc_leg using (symbol) group by 1,2"""
