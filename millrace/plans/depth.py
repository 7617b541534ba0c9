"""Queries over depth books: sizing cycles, filling paths, routing amounts, depth hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.stats import order_statistics, share_pick
from millrace.model import ASSETS, SCHEDULE, SYMBOLS, flat_fees, parse_fees
from millrace.operators import depth, depth_fold, sizing
from millrace.plans.common import FLAT, GRID
from millrace.plans.cycles import _DIMS, _EDGES, _FEES, _PX, _STATE
from millrace.session import stored
from millrace.sources.market import market

QUERIES, ORACLE = {}, {}

#: Fee scenarios of the depth queries, and the largest input of a sized cycle in USDT.
SCENARIOS = {"5": flat_fees(5.0), "7.5": flat_fees(7.5), "10": flat_fees(10.0), "schedule": parse_fees(SCHEDULE)}
PACKET = 1_000.0
#: (src, dst, amount) that paths are filled with, and how many legs they have at most.
FILLS = (("USDT", "BTC", 1e4), ("USDT", "BTC", 2e6), ("ETH", "USDC", 50.0))
ROUTES = (("USDT", "ETH", 5e4), ("USDT", "ETH", 5e6), ("BNB", "BTC", 1e2))
FILL_LEGS, ROUTE_LEGS = 3, 4


def query(f):
    QUERIES[f.__name__] = f
    return f


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return depth.depth_state(depth.snapshots(market(spark, sf_dir, "fx_depth")))


def _sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t_us, books: the depth books at each grid point, as they stood before it."""
    return depth.sampled(depth.snapshots(market(spark, sf_dir, "fx_depth")), GRID)


_LEVELS = """list_transform(range(5), lambda l: case when side='SELL'
  then {'cap': bid_qty*(1+l), 'rate': bid*(1e0-l*1e-4)*(1e0-fee), 'px': bid*(1e0-l*1e-4)}
  else {'cap': ask*(1e0+l*1e-4)*(ask_qty*(1+l)), 'rate': (1e0-fee)/(ask*(1e0+l*1e-4)), 'px': ask*(1e0+l*1e-4)} end)"""
_LONG = ", ".join(f"('{s}',bid_{s},bid_qty_{s},ask_{s},ask_qty_{s})" for s in SYMBOLS)
_START = "case split_part(path,'->',1) " + " ".join(f"when '{a}' then {p}" for a, p in _PX.items()) + " end"


def _survivors_sql(scenarios: dict[str, dict[str, float]], packet: float | None, held: str | None = None) -> str:
    """held: what there is of a leg's source, by which its levels are cut."""
    before = "coalesce(list_sum(list_transform(l0[1:k-1], lambda x: x.cap)), 0)"
    cut = f"""list_filter(list_transform(range(1,6), lambda k: {{'cap': least(l0[k].cap, {held} - {before}), 'rate': l0[k].rate, 'px': l0[k].px}}),
  lambda x: x.cap > 0)""" if held else "l0"
    fees = ", ".join(f"('{name}','{s}',{f!r}::double)" for name, by in scenarios.items() for s, f in by.items())
    most = f"{packet!r}::double/start_px" if packet else "'inf'::double"
    return f"""with recursive {_DIMS}, {_EDGES},
scen(scenario, symbol, fee) as (values {fees}),
hurdle as (select scenario, cycle_id, -sum(ln(1e0-fee)) as h from cyc_leg join scen using (symbol) group by all),
surv as (select seq, scenario, cycle_id, path from edge join hurdle using (cycle_id) where e > h),
starts as (select seq, scenario, cycle_id, path, {_START} as start_px from surv join st using (seq)),
bk as (select seq, v.symbol, v.bid, v.bid_qty, v.ask, v.ask_qty from st, lateral (values {_LONG}) v(symbol, bid, bid_qty, ask, ask_qty)),
leg_of as (select cycle_id, unnest(range(1, n_legs+1)) as i, unnest(symbols) as symbol, unnest(sides) as side from cyc),
sz as (select seq, scenario, cycle_id, path, start_px, {most} as most, count(*) as n, list(side order by i) as sides,
  list({cut} order by i) as lv
 from (select *, {_LEVELS} as l0 from starts join leg_of using (cycle_id) join bk using (seq, symbol) join scen using (scenario, symbol)) group by seq, scenario, cycle_id, path, start_px),
walked(seq, scenario, cycle_id, j, rem, sin, sout, base, lim, go) as (
 select seq, scenario, cycle_id, list_transform(lv, lambda l: 1::bigint), list_transform(lv, lambda l: l[1].cap), 0e0, 0e0,
  list_transform(lv, lambda l: 0e0), list_transform(lv, lambda l: null::double), true from sz
 union all
 select seq, scenario, cycle_id,
  case when goes then list_transform(range(1,n+1), lambda i: j[i] + used[i]::bigint) else j end,
  case when goes then list_transform(range(1,n+1), lambda i: case when used[i] and j[i] < len(lv[i]) then lv[i][j[i]+1].cap else left_[i] end) else rem end,
  case when goes then sin + step else sin end, case when goes then sout + step*m else sout end,
  case when goes then list_transform(range(1,n+1), lambda i: base[i] + case when sides[i]='SELL' then step*mult[i] else step*mult[i]/lv[i][j[i]].px end) else base end,
  case when goes then list_transform(range(1,n+1), lambda i: lv[i][j[i]].px) else lim end,
  goes and not list_bool_or(list_transform(range(1,n+1), lambda i: used[i] and j[i] = len(lv[i])))
 from (select *, list_transform(range(1,n+1), lambda i: left_[i] <= lv[i][j[i]].cap*1e-12) as used
  from (select *, list_transform(range(1,n+1), lambda i: rem[i] - step*mult[i]) as left_
   from (select *, m > 1e0 and sin < most as goes, least(list_min(list_transform(range(1,n+1), lambda i: rem[i]/mult[i])), most - sin) as step
    from (select *, list_product(r) as m, list_transform(range(1,n+1), lambda i: coalesce(list_product(r[1:i-1]), 1e0)) as mult
     from (select w.*, z.lv, z.n, z.most, z.sides, list_transform(range(1,z.n+1), lambda i: z.lv[i][w.j[i]].rate) as r
      from walked w join sz z using (seq, scenario, cycle_id) where w.go)))))),
sized as (select z.*, w.sin, w.sout, w.base, w.lim, (w.sout-w.sin)*z.start_px as profit_usdt, w.sin*z.start_px as size_usdt
 from walked w join sz z using (seq, scenario, cycle_id) where not w.go)"""


@query
def size_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cycle above its hurdle under the fee schedule, sized by depth up to a packet."""
    return depth_fold.size_cycles(market(spark, sf_dir, "fx_depth"), SCENARIOS["schedule"], PACKET)


ORACLE["size_cycles"] = f"""{_survivors_sql({"schedule": SCENARIOS["schedule"]}, PACKET)}
select seq, cycle_id::int as cycle_id, round(sin,6) as start_in, round(sout,6) as start_out, round(profit_usdt,6) as profit_usdt, round(size_usdt,6) as size_usdt,
 {", ".join(f"round(base[{i}],6) as base_qty_{i}, round(lim[{i}],6) as limit_px_{i}" for i in range(1, 6))} from sized"""


@query
def depth_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each fee scenario: snapshots with a profitable cycle, and the best one's size and profit."""
    per = stored(depth_fold.hits(market(spark, sf_dir, "fx_depth"), SCENARIOS), "hits")
    best, measures, picks = F.col("best"), ("size", "profit"), {"p50": share_pick(0.5), "p90": share_pick(0.9)}
    row = per.groupBy("scenario").agg(
        F.count("best").alias("hits"),
        (F.count("best") / F.count(F.lit(1)) * 100).alias("percent"),
        *(F.max(best[f"{c}_usdt"]).alias(f"max_{c}") for c in measures),
        F.max("best.path").alias("last_path"),
    )
    each = F.array(*(F.struct(F.lit(c).alias("what"), best[f"{c}_usdt"].alias("value")) for c in measures))
    long = per.where(best.isNotNull()).select("scenario", F.explode(each).alias("e")).select("scenario", "e.*")
    ranks = order_statistics(long, ["scenario", "what"], "value", picks)
    of = lambda what, c: F.max(F.when(F.col("what") == what, F.col(c))).alias(f"{c}_{what}")
    row = row.join(F.broadcast(ranks.groupBy("scenario").agg(*(of(c, n) for c in measures for n in picks))), "scenario", "left")  # a row for each scenario
    return row.where("hits > 0").select("scenario", "hits", *(F.round(c, 6).alias(c) for c in row.columns if c not in ("scenario", "hits", "last_path")), "last_path")


_PICKED = lambda c, q: f"round(list_sort(list({c}))[least(count(*)-1, floor(count(*)*{q})::bigint)+1],6)"
ORACLE["depth_hits"] = f"""{_survivors_sql(SCENARIOS, None)},
best as (select seq, scenario, arg_max({{'p': profit_usdt, 's': size_usdt, 'w': path}}, {{'p': profit_usdt, 's': size_usdt, 'w': path}}) as b from sized group by 1,2),
total as (select count(*) as n from st)
select scenario, count(*) as hits, round(count(*)/max(n)*100,6) as percent, {_PICKED("b.s", "5e-1")} as p50_size, {_PICKED("b.s", "9e-1")} as p90_size,
 {_PICKED("b.p", "5e-1")} as p50_profit, {_PICKED("b.p", "9e-1")} as p90_profit, round(max(b.s),6) as max_size, round(max(b.p),6) as max_profit, max(b.w) as last_path
 from best, total group by scenario"""


def _tasks(wanted: tuple, max_legs: int) -> Column:
    """array of struct(src, dst, amount, routes) over `books`, at the flat fee."""
    fees = depth.fee_array(flat_fees(FLAT))
    return F.array(
        *(
            F.struct(
                F.concat_ws("->", F.lit(src), F.lit(dst)).alias("pair"), F.lit(amount).alias("amount"),
                depth.routes(src, dst, max_legs, F.col("books"), fees).alias("routes"),
            )
            for src, dst, amount in wanted
        )
    )


@query
def fill_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At each grid point, fixed amounts pushed through every path of up to three legs."""
    rows = _sampled(spark, sf_dir).select("t_us", F.explode(_tasks(FILLS, FILL_LEGS)).alias("t"))
    rows = rows.select("t_us", "t.amount", F.explode("t.routes").alias("r"))
    found = rows.select("t_us", "amount", "r.path", sizing.filled(F.col("r.legs"), F.col("amount")).alias("f"))
    last = F.element_at("f.limit_px", -1)
    return found.select(
        "t_us", "amount", "path", F.round("f.out", 6).alias("out"), F.round(F.when(F.col("f.out").isNotNull(), last), 6).alias("limit_px"),
        F.round(F.when(F.col("f.out").isNotNull(), F.element_at("f.base_qty", -1)), 6).alias("base_qty"),
    )


def _fills_sql(wanted: tuple, max_legs: int) -> str:
    tasks = ", ".join(f"('{s}','{d}',{a!r}::double)" for s, d, a in wanted)
    return f"""with recursive {_DIMS}, {_STATE},
first_full as (select min(t_us) as t0, max(t_us) as t1 from st),
g as (select unnest(range(t0, t1+1, {GRID})) as t_us from first_full),
p as (select g.t_us, s.symbol from g cross join fx_symbol s where g.t_us > (select t0 from first_full)),
bk as (select p.t_us, p.symbol, q.bid, q.bid_qty, q.ask, q.ask_qty, {FLAT / 1e4!r}::double as fee from p asof join fx_quote q on p.symbol=q.symbol and p.t_us>q.t_us),
lv as (select t_us, symbol, side, {_LEVELS} as lv from bk, (values ('SELL'),('BUY')) x(side)),
task(src, dst, amount) as (values {tasks}),
route as (select src||'->'||dst as pair, amount, nodes, symbols, sides, array_to_string(list_transform(nodes, lambda n: {list(ASSETS)}[n+1]), '->') as path
 from task join walk on {list(ASSETS)}[nodes[1]+1]=src and {list(ASSETS)}[nodes[-1]+1]=dst where len(symbols)<={max_legs}),
f(t_us, pair, amount, path, i, x, lim, base) as (
 select distinct t_us, pair, amount, path, 0, amount, null::double, null::double from route, p
 union all
 select t_us, pair, amount, path, i+1,
  case when x <= list_sum(list_transform(lv, lambda l: l.cap)) then list_sum(list_transform(range(1,6), lambda k: take[k]*lv[k].rate)) end,
  list_last(list_filter(list_transform(range(1,6), lambda k: case when k=1 or coalesce(list_sum(list_transform(lv[1:k-1], lambda l: l.cap)),0) < x then lv[k].px end), lambda z: z is not null)),
  list_sum(list_transform(range(1,6), lambda k: case when side='SELL' then take[k] else take[k]/lv[k].px end))
 from (select f.*, l.lv, l.side, list_transform(range(1,6), lambda k: greatest(0e0, least(l.lv[k].cap, f.x - coalesce(list_sum(list_transform(l.lv[1:k-1], lambda y: y.cap)),0)))) as take
  from f join route r using (pair, amount, path) join lv l on l.t_us=f.t_us and l.symbol=r.symbols[f.i+1] and l.side=r.sides[f.i+1] where f.i < len(r.symbols) and f.x is not null)),
done as (select r.pair, r.amount, r.path, r.nodes, p.t_us, f.x, f.lim, f.base from route r cross join (select distinct t_us from p) p
 left join f on f.t_us=p.t_us and f.pair=r.pair and f.amount=r.amount and f.path=r.path and f.i=len(r.symbols) and f.x is not null)"""


ORACLE["fill_path"] = f"""{_fills_sql(FILLS, FILL_LEGS)}
select t_us, amount, path, round(x,6) as "out", round(lim,6) as limit_px, round(base,6) as base_qty from done"""


@query
def best_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At each grid point, the path of up to four legs that delivers most of an amount."""
    rows = _sampled(spark, sf_dir).select("t_us", F.explode(_tasks(ROUTES, ROUTE_LEGS)).alias("t"))
    found = rows.select("t_us", "t.pair", "t.amount", sizing.best_route(F.col("t.routes"), F.col("t.amount")).alias("b"))
    return found.select("t_us", "pair", "amount", "b.path", F.round("b.out", 6).alias("out"))


ORACLE["best_route"] = f"""{_fills_sql(ROUTES, ROUTE_LEGS)}
select t_us, pair, amount, arg_min(path, {{'x': -x, 'n': len(nodes), 'o': nodes}}) filter (x is not null) as path, round(max(x),6) as "out"
 from done group by 1,2,3"""
