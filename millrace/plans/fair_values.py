"""Queries over fair-value estimators: their series, how gaps to them close, filtered fills, quote and hedge edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.stats import at_ratio, gap_closure, median, share_above
from millrace.model import ASSETS, LEGS, SCHEDULE, SYMBOLS, parse_fees
from millrace.operators import fair, graph
from millrace.operators import markout as mk
from millrace.operators import timeseries as ts
from millrace.plans.common import GRID, HORIZONS, MAKER_BPS, PRE
from millrace.plans.cycles import _DIMS, _FEES, _STATE
from millrace.sources.market import VIEWS, duck_ctes, market

QUERIES, ORACLE = {}, {}

#: Maker fees that quote edges are compared with, thresholds of filtered fills, and the horizon they are marked at.
MAKERS = {"6": 6.0, "0": 0.0, "rebate": -0.8}
KEPT, ANCHOR_KEPT = (0.0, 1.0, 2.0), (0.0, 5.0, 10.0)
MARK = HORIZONS[1]
CROSS = ("ETHBTC", "BNBBTC", "BNBETH")
FAIR = "usdt"


def query(f):
    QUERIES[f.__name__] = f
    return f


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.book_state(market(spark, sf_dir, "fx_quote"), list(SYMBOLS))


_WIDE = [f"{c}_{s}" for s in SYMBOLS for c in ("bid", "ask")]


def _sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t_us and the wide book at each grid point, as it stood before it."""
    state = _state(spark, sf_dir)
    bounds = state.agg(F.min("t_us").alias("t0"), F.max("t_us").alias("t1"))
    return ts.asof(ts.grid(bounds, GRID), state, [], _WIDE, strict=True).where(F.col("bid_BTCUSDT").isNotNull())


def _volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fair.traded_volume(market(spark, sf_dir, "fx_trade"))


def _by_symbol(names: tuple[str, ...]) -> Column:
    """array of struct(symbol, <estimators>) over the wide book (and volumes)."""
    return F.array(*(F.struct(F.lit(s).alias("symbol"), *(fair.BY_NAME[n](s).alias(n) for n in names)) for s in SYMBOLS))


def _estimated(rows: DataFrame, names: tuple[str, ...], keep: list[str]) -> DataFrame:
    return rows.select(*keep, F.explode(_by_symbol(names)).alias("f")).select(*keep, "f.*")


# ---- SQL of the estimators over the wide book ----

_mid = lambda s: f"((bid_{s}+ask_{s})/2)"


def _hop(src: str, dst: str) -> str:
    leg = LEGS[src, dst]
    return _mid(leg.symbol) if leg.side == "SELL" else f"(1e0/{_mid(leg.symbol)})"


def _estimator_sql(s: str) -> dict[str, str]:
    base, quote = SYMBOLS[s]
    between = [a for a in ASSETS if a not in (base, quote)]
    routes = [f"({_hop(base, x)}*{_hop(x, quote)})" for x in between]
    weights = [f"least(vol_{LEGS[base, x].symbol}, vol_{LEGS[x, quote].symbol})" for x in between]
    px = lambda a: "1e0" if a == "USDT" else _mid(a + "USDT")
    num, den = "+".join(f"{w}*{r}" for w, r in zip(weights, routes)), "+".join(weights)
    mid3 = f"list_sort([{','.join(routes)}])[2]"
    return {
        "own": _mid(s), "routes": mid3, "usdt": f"{px(base)}/{px(quote)}",
        "routes_vw": f"case when {den}<>0 then ({num})/({den}) else {mid3} end",
        "all_vw": f"case when {den}+vol_{s}<>0 then ({num}+vol_{s}*{_mid(s)})/({den}+vol_{s}) else {_mid(s)} end",
    }


def _values(names: tuple[str, ...]) -> str:
    return ", ".join(f"('{s}'," + ",".join(_estimator_sql(s)[n] for n in names) + ")" for s in SYMBOLS)


_BASE = f"fx_symbol as ({VIEWS['fx_symbol']}), {_STATE}"
_TRADES = duck_ctes("fx_trade").split("fx_trade as (", 1)[1]
_TRADES = f"fx_trade as ({_TRADES}"
_VOLS = f"""{_TRADES},
medians as (select median(price) filter (symbol='BTCUSDT') as px_btc, median(price) filter (symbol='ETHUSDT') as px_eth from fx_trade),
in_usdt as (select t.*, price*qty*case quote when 'BTC' then px_btc when 'ETH' then px_eth else 1e0 end as usdt,
 case quote when 'BTC' then px_btc when 'ETH' then px_eth else 1e0 end as px from fx_trade t, medians),
vols as (select {", ".join(f"coalesce(sum(usdt) filter (symbol='{s}'),0) as vol_{s}" for s in SYMBOLS)} from in_usdt)"""
_GRID_SQL = f"""bounds as (select min(t_us) as t0, max(t_us) as t1 from st),
g as (select unnest(range(t0, t1+1, {GRID})) as t_us from bounds),
gs as (select g.t_us as g_us, st.* exclude (t_us, seq, symbol) from g asof join st on g.t_us > st.t_us)"""


@query
def trade_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _volumes(spark, sf_dir).select("symbol", "n", F.round("volume", 2).alias("volume"))


ORACLE["trade_volume"] = f"""with {duck_ctes("fx_trade")}, {_VOLS.split(",", 0)[0].split(_TRADES + ",", 1)[1]}
select symbol, count(*) as n, round(sum(usdt),2) as volume from in_usdt group by symbol"""


@query
def fv_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At each grid point, every symbol's median of its three two-leg routes."""
    return _estimated(_sampled(spark, sf_dir), ("routes",), ["t_us"]).select("t_us", "symbol", F.round("routes", 6).alias("fair"))


@query
def fv_usdt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At each grid point, every symbol's price by its assets' USDT books."""
    return _estimated(_sampled(spark, sf_dir), ("usdt",), ["t_us"]).select("t_us", "symbol", F.round("usdt", 6).alias("fair"))


for _name in ("routes", "usdt"):
    ORACLE[f"fv_{_name}"] = f"""with {_BASE}, {_GRID_SQL}
select g_us as t_us, v.symbol, round(v.x,6) as fair from gs, lateral (values {_values((_name,))}) v(symbol, x)"""


@query
def fv_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At each grid point, every symbol's five estimates."""
    rows = fair.with_volumes(_sampled(spark, sf_dir), _volumes(spark, sf_dir))
    found = _estimated(rows, fair.ESTIMATORS, ["t_us"])
    return found.select("t_us", "symbol", *(F.round(n, 6).alias(n) for n in fair.ESTIMATORS))


ORACLE["fv_all"] = f"""with {_BASE}, {_VOLS}, {_GRID_SQL}
select g_us as t_us, v.symbol, {", ".join(f"round(v.{n},6) as {n}" for n in fair.ESTIMATORS)}
from gs, vols, lateral (values {_values(fair.ESTIMATORS)}) v(symbol, {", ".join(fair.ESTIMATORS)})"""


@query
def fair_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every symbol's fair value after every update."""
    return _estimated(_state(spark, sf_dir), (FAIR,), ["seq"]).select("seq", "symbol", F.round(FAIR, 6).alias("fair"))


ORACLE["fair_series"] = f"""with {_BASE}
select seq, v.symbol, round(v.x,6) as fair from st, lateral (values {_values((FAIR,))}) v(symbol, x)"""


def _looked_up(spark: SparkSession, sf_dir: str, trades: DataFrame, names: tuple[str, ...], offsets: list[int]) -> DataFrame:
    """The trades with at_<i>: struct of the estimates of their own symbol with the whole book at t + offsets[i]."""
    state = fair.with_volumes(_state(spark, sf_dir), _volumes(spark, sf_dir))
    series = state.select("t_us", "seq", *(fair.BY_NAME[n](s).alias(f"{n}_{s}") for n in names for s in SYMBOLS))
    every = [f"{n}_{s}" for n in names for s in SYMBOLS]
    probes = ts.asof(ts.probes_at(trades, offsets), series, [], every)
    own = lambda n: reduce(lambda out, s: F.when(F.col("symbol") == s, F.col(f"{n}_{s}")).otherwise(out), SYMBOLS, F.lit(None).cast("double"))
    probes = probes.select("event_time", "offset", *[c for c in trades.columns if c != "t_us"], F.struct(*(own(n).alias(n) for n in names)).alias("v"))
    keep = [c for c in trades.columns if c != "t_us"]
    return probes.groupBy(*keep, F.col("event_time").alias("t_us")).agg(
        *(F.max(F.when(F.col("offset") == o, F.col("v"))).alias(f"at_{i}") for i, o in enumerate(offsets))
    )


def _last_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market(spark, sf_dir, "fx_quote").agg(F.max("t_us").alias("last_us"))


@query
def markout_fair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passive fills against the fair value before them and at three horizons; fills kept by their edge at fill."""
    trades = market(spark, sf_dir, "fx_trade").drop("base", "quote")
    found = _looked_up(spark, sf_dir, trades, (FAIR,), [-PRE, *HORIZONS]).crossJoin(F.broadcast(_last_update(spark, sf_dir)))
    rows = found.where(F.col(f"at_0.{FAIR}").isNotNull() & (F.col("t_us") + HORIZONS[-1] <= F.col("last_us"))).withColumns(
        {"w": F.col("price") * F.col("qty"), **{f"m_{i}": mk.gain_bps(F.col(f"at_{i}.{FAIR}")) for i in range(4)}}
    )
    marks = rows.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), *mk.weighted([f"m_{i}" for i in range(4)]),
        *mk.kept(F.col("m_0"), KEPT, F.col("m_2"), F.col("w")),
    )
    return marks.select(
        "symbol", "n", F.round("w", 2).alias("notional"), *(F.round(f"m_{i}", 6).alias(f"m_{i}") for i in range(4)), *mk.kept_report(KEPT)
    )


_VALUE_OF = lambda n: "case p.symbol " + " ".join(f"when '{s}' then {_estimator_sql(s)[n]}" for s in SYMBOLS) + " end"
_MARKS = ", ".join(f"max(v) filter (o={o}) as v{i}" for i, o in enumerate((-PRE, *HORIZONS)))
_KEPT_SQL = lambda edge, gain, w, ns: ", ".join(
    f"round(sum(case when {edge}>={n} then {w} else 0 end)/sum({w}),6) as share_{n:g}, "
    f"round(sum({gain}*{w}) filter ({edge}>={n})/nullif(sum({w}) filter ({edge}>={n}),0),6) as pnl_{n:g}"
    for n in ns
)
ORACLE["markout_fair"] = f"""with {_BASE}, {_TRADES},
p as (select t.*, o, t.t_us + o as p_us from fx_trade t cross join (values (-{PRE}),({HORIZONS[0]}),({HORIZONS[1]}),({HORIZONS[2]})) v(o)),
lk as (select p.seq, p.symbol, p.t_us, p.price, p.qty, p.buyer_maker, o, {_VALUE_OF(FAIR)} as v from p asof left join st on p.p_us >= st.t_us),
w as (select seq, symbol, t_us, price, price*qty as w, case when buyer_maker then 1e0 else -1e0 end as side, {_MARKS} from lk group by all),
m as (select *, {", ".join(f"side*(v{i}/price-1)*1e4 as m_{i}" for i in range(4))} from w where v0 is not null and t_us+{HORIZONS[-1]} <= (select max(t_us) from fx_quote))
select symbol, count(*) as n, round(sum(w),2) as notional, {", ".join(f"round(sum(m_{i}*w)/sum(w),6) as m_{i}" for i in range(4))},
 {_KEPT_SQL("m_0", "m_2", "w", KEPT)} from m group by symbol"""


@query
def fv_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the gap between an estimate and the own mid the own mid closes until the next mark."""
    trades = market(spark, sf_dir, "fx_trade")
    span = trades.agg((F.min("t_us") + GRID).alias("t0"), (F.max("t_us") - MARK - 1).alias("t1")).where("t1 >= t0")
    state = fair.with_volumes(_state(spark, sf_dir), _volumes(spark, sf_dir))
    last = state.agg(F.max("t_us").alias("last_us"))
    probes = ts.probes_at(ts.grid(span, GRID).withColumn("seq", F.col("t_us")), [0, MARK])
    volumes = [f"vol_{s}" for s in SYMBOLS]
    found = ts.asof(probes, state, [], [*_WIDE, *volumes]).crossJoin(F.broadcast(last))
    found = found.where((F.col("t_us") < F.col("last_us")) & F.col("bid_BTCUSDT").isNotNull())
    rows = _estimated(found, fair.ESTIMATORS, ["seq", "offset"]).groupBy("seq", "symbol").agg(
        F.max(F.when(F.col("offset") == 0, F.struct(*fair.ESTIMATORS))).alias("now"),
        F.max(F.when(F.col("offset") == MARK, F.col("own"))).alias("later"),
    )
    rows = rows.where(F.col("now").isNotNull() & F.col("later").isNotNull()).withColumn("move", F.col("later") / F.col("now.own") - 1)
    graph_ones = [n for n in fair.ESTIMATORS if n != "own"]
    rows = rows.withColumns({f"gap_{n}": F.col(f"now.{n}") / F.col("now.own") - 1 for n in graph_ones})
    cells = {n: gap_closure(f"gap_{n}", "move") for n in graph_ones}
    return rows.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"),
        *(F.round(c[k], 6).alias(f"{what}_{n}") for n, c in cells.items() for k, what in enumerate(("slope", "corr"))),
    )


_GAPS = [n for n in fair.ESTIMATORS if n != "own"]
ORACLE["fv_gap"] = f"""with {_BASE}, {_VOLS},
span as (select min(t_us)+{GRID} as t0, max(t_us)-{MARK} as t1 from fx_trade),
g as (select unnest(range(t0, t1, {GRID})) as g_us from span),
p as (select g_us, o, g_us+o as p_us from g, (values (0),({MARK})) v(o) where g_us+o < (select max(t_us) from st)),
lk as (select p.g_us, p.o, v.* from p asof join st on p.p_us >= st.t_us, vols, lateral (values {_values(fair.ESTIMATORS)}) v(symbol, {", ".join(fair.ESTIMATORS)})),
r as (select a.symbol, b.own/a.own-1 as move, {", ".join(f"a.{n}/a.own-1 as gap_{n}" for n in _GAPS)} from lk a join lk b using (g_us, symbol) where a.o=0 and b.o={MARK})
select symbol, count(*) as n, {", ".join(f"round(case when var_pop(gap_{n})>=1e-18 then covar_pop(gap_{n},move)/var_pop(gap_{n}) end,6) as slope_{n}, round(case when var_pop(gap_{n})>=1e-18 then corr(gap_{n},move) end,6) as corr_{n}" for n in _GAPS)}
from r group by symbol"""


@query
def fv_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills kept where the quote was N bps better than an estimate, marked to two estimates later; by symbol and for
    the cross pairs and all pairs together."""
    trades = market(spark, sf_dir, "fx_trade").drop("base")
    medians = fair.usdt_medians(trades)
    found = _looked_up(spark, sf_dir, trades, fair.ESTIMATORS, [-PRE, MARK]).crossJoin(F.broadcast(medians)).crossJoin(F.broadcast(_last_update(spark, sf_dir)))
    found = found.where((F.col("t_us") + MARK < F.col("last_us")) & F.col("at_0.own").isNotNull() & F.col("at_1.own").isNotNull())
    px = F.when(F.col("quote") == "BTC", F.col("px_BTC")).when(F.col("quote") == "ETH", F.col("px_ETH")).otherwise(1e0)
    rows = found.withColumn("w", F.col("price") * F.col("qty") * px)
    marks = F.array(*(F.struct(F.lit(m).alias("mark_by"), mk.gain_bps(F.col(f"at_1.{m}")).alias("gain")) for m in ("usdt", "own")))
    classes = F.array_compact(F.array(F.col("symbol"), F.when(F.col("symbol").isin(*CROSS), F.lit("cross pairs")), F.lit("all pairs")))
    rows = rows.withColumn("m", F.explode(marks)).withColumn("pairs", F.explode(classes))
    sums = {"all": (F.sum("w"), F.sum(F.col("m.gain") * F.col("w")))}
    for e in fair.ESTIMATORS:
        for n in KEPT:
            there = mk.gain_bps(F.col(f"at_0.{e}")) >= n
            sums[e, n] = tuple(F.sum(F.when(there, x).otherwise(0e0)) for x in (F.col("w"), F.col("m.gain") * F.col("w")))
    cells = [
        F.struct(F.lit(k if k == "all" else k[0]).alias("estimator"), F.lit(None if k == "all" else k[1]).cast("double").alias("threshold"),
                 kept.alias("kept"), pnl.alias("pnl"))
        for k, (kept, pnl) in sums.items()
    ]
    per = rows.groupBy("pairs", "m.mark_by").agg(F.array(*cells).alias("c"), F.sum("w").alias("w"))
    return per.select("pairs", "mark_by", "w", F.explode("c").alias("c")).select(
        "pairs", "mark_by", "c.estimator", "c.threshold", F.round(F.col("c.kept") / F.col("w"), 6).alias("share"),
        F.round(F.when(F.col("c.kept") > 0, F.try_divide("c.pnl", "c.kept")), 6).alias("bps"), F.round(F.col("c.pnl") / 1e4, 4).alias("usdt"),
    )


_FILTERED = " union all ".join(
    f"select symbol, mark_by, '{e}' as estimator, {n}::double as threshold, case when side*(a_{e}/price-1)*1e4>={n} then w else 0 end as kept, w, gain from m"
    for e in fair.ESTIMATORS
    for n in KEPT
)
ORACLE["fv_filter"] = f"""with {_BASE}, {_VOLS},
p as (select t.*, o, t.t_us + o as p_us from in_usdt t cross join (values (-{PRE}),({MARK})) v(o) where t.t_us+{MARK} < (select max(t_us) from fx_quote)),
lk as (select p.seq, p.symbol, p.price, p.usdt as w, case when buyer_maker then 1e0 else -1e0 end as side, o, {", ".join(f"{_VALUE_OF(n)} as {n}" for n in fair.ESTIMATORS)}
 from p asof join st on p.p_us >= st.t_us, vols),
two as (select a.seq, a.symbol, a.price, a.w, a.side, {", ".join(f"a.{n} as a_{n}" for n in fair.ESTIMATORS)}, b.usdt as later_usdt, b.own as later_own
 from lk a join lk b using (seq) where a.o=-{PRE} and b.o={MARK}),
m as (select two.*, mark_by, side*(later/price-1)*1e4 as gain from two, lateral (values ('usdt', later_usdt), ('own', later_own)) v(mark_by, later)),
f as (select symbol, mark_by, 'all' as estimator, null::double as threshold, w as kept, w, gain from m union all {_FILTERED}),
c as (select f.*, unnest(list_filter([symbol, case when symbol in {CROSS} then 'cross pairs' end, 'all pairs'], lambda x: x is not null)) as pairs from f)
select pairs, mark_by, estimator, threshold, round(sum(kept)/sum(w),6) as share, round(sum(gain*kept)/nullif(sum(kept),0),6) as bps, round(sum(gain*kept)/1e4,4) as usdt
 from c group by 1,2,3,4"""


@query
def markout_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passive fills of pairs without USDT against the ratio of their assets' USDT mids, by pair and all together."""
    trades = market(spark, sf_dir, "fx_trade")
    marked = mk.marked(trades, market(spark, sf_dir, "fx_quote"), PRE, HORIZONS).where(F.col("quote") != "USDT")
    quotes = market(spark, sf_dir, "fx_quote").where(F.col("symbol").endswith("USDT"))
    books = quotes.select(F.expr("substring(symbol, 1, length(symbol) - 4)").alias("asset"), "t_us", "seq", ((F.col("bid") + F.col("ask")) / 2).alias("px"))
    rows = marked.select("seq", "t_us", "symbol", "base", "quote", "price", "buyer_maker", "w")
    probes = ts.probes_at(rows.withColumn("asset", F.explode(F.array("base", "quote"))), [-PRE, HORIZONS[-1]])
    found = ts.asof(probes, books, ["asset"], ["px"])
    at = lambda side, o: F.max(F.when((F.col("asset") == F.col(side)) & (F.col("offset") == o), F.col("px")))
    wide = found.groupBy("seq", "symbol", "price", "buyer_maker", "w").agg(
        (at("base", -PRE) / at("quote", -PRE)).alias("before"), (at("base", HORIZONS[-1]) / at("quote", HORIZONS[-1])).alias("after"),
        at("quote", -PRE).alias("rate"),
    ).where("before is not null and after is not null")
    wide = wide.withColumns({"usdt": F.col("w") * F.col("rate"), "edge": mk.gain_bps(F.col("before")), "gain": mk.gain_bps(F.col("after"))})
    per = wide.withColumn("pair", F.explode(F.array(F.col("symbol"), F.lit("all pairs")))).groupBy("pair").agg(
        F.count(F.lit(1)).alias("n"), F.sum("usdt").alias("w"), *mk.weighted(["gain"], "usdt"), *mk.kept(F.col("edge"), ANCHOR_KEPT, F.col("gain"), F.col("usdt"))
    )
    return per.select(
        "pair", "n", F.round("w", 2).alias("notional"), F.round("gain", 6).alias("bps"), F.round(F.col("gain") - MAKER_BPS, 6).alias("after_fee"),
        *mk.kept_report(ANCHOR_KEPT),
    ).orderBy(F.desc("notional"), "pair")


ORACLE["markout_anchor"] = f"""with {duck_ctes("fx_quote", "fx_trade")},
own as (select t.*, (q.bid+q.ask)/2 as v0 from (select *, t_us-{PRE} as p_us from fx_trade) t asof join fx_quote q on t.symbol=q.symbol and t.p_us>=q.t_us),
lastq as (select symbol, max(t_us) as last_us from fx_quote group by 1),
kept as (select own.* from own join lastq using (symbol) where t_us+{HORIZONS[-1]} <= last_us and quote<>'USDT'),
bk as (select symbol[1:len(symbol)-4] as asset, t_us, (bid+ask)/2 as px from fx_quote where symbol like '%USDT'),
p as (select seq, symbol, price, price*qty as w, case when buyer_maker then 1e0 else -1e0 end as side, k, asset, o, t_us+o as p_us
 from kept, lateral (values ('b', base), ('q', quote)) a(k, asset), (values (-{PRE}),({HORIZONS[-1]})) v(o)),
lk as (select p.*, bk.px from p asof join bk on p.asset=bk.asset and p.p_us>=bk.t_us),
wide as (select seq, symbol, price, w, side, max(px) filter (k='b' and o=-{PRE})/max(px) filter (k='q' and o=-{PRE}) as before,
 max(px) filter (k='b' and o={HORIZONS[-1]})/max(px) filter (k='q' and o={HORIZONS[-1]}) as after_, max(px) filter (k='q' and o=-{PRE}) as rate from lk group by all),
m as (select *, w*rate as u, side*(before/price-1)*1e4 as edge, side*(after_/price-1)*1e4 as gain from wide where before is not null and after_ is not null),
c as (select *, unnest([symbol, 'all pairs']) as pair from m)
select pair, count(*) as n, round(sum(u),2) as notional, round(sum(gain*u)/sum(u),6) as bps, round(sum(gain*u)/sum(u)-{MAKER_BPS}e0,6) as after_fee,
 {_KEPT_SQL("edge", "gain", "u", ANCHOR_KEPT)} from c group by pair"""


# ---- quoting at the touch ----


def _sides(names_of: dict[str, tuple[Column, Column]]) -> Column:
    return F.array(
        *(
            F.struct(F.lit(s).alias("symbol"), F.lit(side).alias("side"), edge.alias("edge"))
            for s, edges in names_of.items()
            for side, edge in zip(("bid", "ask"), edges)
        )
    )


def _edge_report(rows: DataFrame) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n"), F.round(median("edge"), 6).alias("median_bps"), F.round(at_ratio("edge", 19, 20), 6).alias("p95_bps"),
        F.round(F.max("edge"), 6).alias("max_bps"),
        *(F.round(share_above(F.col("edge"), bps), 6).alias(f"above_{name}") for name, bps in MAKERS.items()),
    ]


_EDGE_SQL = f"""count(*) as n, round(median(edge),6) as median_bps, round(list_sort(list(edge))[count(*)*19//20+1],6) as p95_bps, round(max(edge),6) as max_bps,
 {", ".join(f"round(avg(case when edge>{b} then 1e0 else 0e0 end)*100,6) as above_{n}" for n, b in MAKERS.items())}"""


@query
def quote_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unhedged quotes at the touch against the fair value, by symbol and side."""
    def edges(s: str) -> tuple[Column, Column]:
        value = fair.BY_NAME[FAIR](s)
        return (value / F.col(f"bid_{s}") - 1) * 1e4, (F.col(f"ask_{s}") / value - 1) * 1e4

    rows = _sampled(spark, sf_dir).select(F.explode(_sides({s: edges(s) for s in SYMBOLS})).alias("x")).select("x.*")
    return rows.groupBy("symbol", "side").agg(*_edge_report(rows)).orderBy(F.desc("median_bps"), "symbol", "side")


ORACLE["quote_edges"] = f"""with {_BASE}, {_GRID_SQL},
x as (select v.* from gs, lateral (values {", ".join(f"('{s}','bid',({_estimator_sql(s)[FAIR]}/bid_{s}-1)*1e4),('{s}','ask',(ask_{s}/({_estimator_sql(s)[FAIR]})-1)*1e4)" for s in SYMBOLS)}) v(symbol, side, edge))
select symbol, side, {_EDGE_SQL} from x group by 1,2"""


def _hedges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t_us, symbol, side, rate, path, edge: what a fill at the touch is worth if it is flattened over other symbols."""
    fees = parse_fees(SCHEDULE)
    each = []
    for s, (base, quote) in SYMBOLS.items():
        for side, src, dst in (("bid", base, quote), ("ask", quote, base)):
            each.append(F.struct(
                F.lit(s).alias("symbol"), F.lit(side).alias("side"), F.col(f"{side}_{s}").alias("px"),
                graph.best_path(src, dst, fees, exclude=s).alias("b"),
            ))
    rows = _sampled(spark, sf_dir).select("t_us", F.explode(F.array(*each)).alias("x"))
    edge = F.when(F.col("x.side") == "bid", F.col("x.b.rate") / F.col("x.px") - 1).otherwise(F.col("x.px") * F.col("x.b.rate") - 1) * 1e4
    return rows.select("t_us", "x.symbol", "x.side", "x.b.rate", "x.b.path", edge.alias("edge"))


@query
def best_path_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At each grid point, the best path around every symbol, both ways, after taker fees."""
    return _hedges(spark, sf_dir).select("t_us", "symbol", "side", F.round("rate", 9).alias("rate"), "path")


_HEDGE_SQL = f"""with recursive {_DIMS}, {_FEES}, {_STATE}, {_GRID_SQL},
rt as (select g_us as t_us, v.* from gs, lateral (values {", ".join(f"('{s}','SELL',bid_{s}),('{s}','BUY',1e0/ask_{s})" for s in SYMBOLS)}) v(symbol, side, r)),
net as (select t_us, symbol, side, r*(1e0-fee) as r from rt join fees using (symbol)),
way as (select row_number() over () as id, nodes, symbols, sides, {list(ASSETS)}[nodes[1]+1] as src, {list(ASSETS)}[nodes[-1]+1] as dst,
 array_to_string(list_transform(nodes, lambda n: {list(ASSETS)}[n+1]), '->') as path from walk where len(symbols)<=3),
way_leg as (select id, unnest(symbols) as symbol, unnest(sides) as side from way),
val as (select t_us, id, product(r) as rate from net join way_leg using (symbol, side) group by all),
want as (select symbol, 'bid' as side, base as src, quote as dst from fx_symbol union all select symbol, 'ask', quote, base from fx_symbol),
cand as (select t_us, want.symbol, want.side, rate, path, len(symbols) as n, nodes, max(rate) over (partition by t_us, want.symbol, want.side) as top
 from val join way using (id) join want using (src, dst) where not list_contains(way.symbols, want.symbol)),
best as (select t_us, symbol, side, max(rate) as rate, arg_min(path, {{'n': n, 'o': nodes}}) filter (rate >= top*(1-1e-12)) as path from cand group by 1,2,3)"""
ORACLE["best_path_rate"] = f"{_HEDGE_SQL} select t_us, symbol, side, round(rate,9) as rate, path from best"


@query
def hedged_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes at the touch whose fills are flattened at once over the graph, by symbol and side, with the usual path."""
    rows = _hedges(spark, sf_dir)
    usual = rows.groupBy("symbol", "side", "path").agg(F.count(F.lit(1)).alias("times"), F.min("t_us").alias("first"))
    first = Window.partitionBy("symbol", "side").orderBy(F.desc("times"), "first")
    usual = usual.withColumn("r", F.row_number().over(first)).where("r = 1").select("symbol", "side", "path")
    return rows.groupBy("symbol", "side").agg(*_edge_report(rows)).join(usual, ["symbol", "side"]).orderBy(F.desc("median_bps"), "symbol", "side")


ORACLE["hedged_edges"] = f"""{_HEDGE_SQL},
e as (select best.*, case side {"".join(f" when '{x}' then case symbol " + " ".join(f"when '{s}' then {x}_{s}" for s in SYMBOLS) + " end" for x in ("bid", "ask"))} end as px from best join gs on gs.g_us=best.t_us),
x as (select *, case side when 'bid' then rate/px-1 else px*rate-1 end*1e4 as edge from e),
u as (select symbol, side, path, row_number() over (partition by symbol, side order by count(*) desc, min(t_us)) as r from x group by 1,2,3),
s as (select symbol, side, {_EDGE_SQL} from x group by 1,2)
select s.*, u.path from s join u using (symbol, side) where u.r=1"""
