"""Sized cycles as orders: within balances and in whole lots, and scored against the books that stood later."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.model import SYMBOLS
from millrace.operators import allocation, depth, depth_fold, fill_model, lots, outcomes, shadow
from millrace.plans.common import HORIZONS, ROWS
from millrace.plans.cycles import _PX
from millrace.plans.depth import PACKET, SCENARIOS, _state, _survivors_sql
from millrace.session import stored
from millrace.sources.market import market

QUERIES, ORACLE = {}, {}

SCHEDULED = {"schedule": SCENARIOS["schedule"]}
#: What is held of each asset, the step of a base quantity and the least notional in a quote.
HELD = {"USDT": 600.0, "USDC": 900.0, "BTC": 1e-2, "ETH": 0.25, "BNB": 1.0}
STEPS = {"BTC": 1e-4, "ETH": 1e-3, "BNB": 1e-2, "USDC": 1.0}
LEAST = {"USDT": 100.0, "USDC": 100.0, "BTC": 1.25e-3, "ETH": 4e-2}
LOTS = {s: lots.Lot(STEPS[base], LEAST[quote]) for s, (base, quote) in SYMBOLS.items()}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = {"t_us": F.col("t_us"), "prices": depth.asset_prices()}
    return _numbered(depth.survivors(_state(spark, sf_dir), SCHEDULED, more))


def _numbered(rows: DataFrame) -> DataFrame:
    """Survivors with the largest input and their legs' symbols and assets."""
    rows = rows.where(F.col("cycle_id").isNotNull())
    return rows.withColumn("most", PACKET / F.col("start_px")).withColumn("of", F.element_at(depth.leg_assets(), F.col("cycle_id") + 1))


@query
def size_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cycle above its hurdle, sized within a packet and the balances, then rounded to whole lots leg by leg: what
    it spends and gets, what stays on the way, and whether it is still an order. Balances bound each leg's input."""
    return depth_fold.size_lots(market(spark, sf_dir, "fx_depth"), SCENARIOS["schedule"], PACKET, HELD, LOTS)


def _by(values: dict[str, object], column: str) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then {v!r}::double" for k, v in values.items()) + " end"


_SOURCE = "case when side='SELL' then b.base else b.quote end"
_TARGET = "case when side='SELL' then b.quote else b.base end"
_PRICE = lambda asset: f"case {asset} " + " ".join(f"when '{a}' then {p}" for a, p in _PX.items()) + " end"
_HELD = "case when side='SELL' then {} else {} end".format(
    *(_by({s: HELD[pair[i]] for s, pair in SYMBOLS.items()}, "symbol") for i in (0, 1))
)
_UNIT = "case when side='SELL' then 1e0 else 1e0/lv[k].px end"
ORACLE["size_lots"] = f"""{_survivors_sql(SCHEDULED, PACKET, _HELD)},
lot as (select cycle_id, i, l.symbol, side, {_by({s: x.step for s, x in LOTS.items()}, "l.symbol")} as step,
 {_by({s: x.least for s, x in LOTS.items()}, "l.symbol")} as least_, {_SOURCE} as src from leg_of l join fx_symbol b using (symbol)),
f(seq, cycle_id, i, x, used, whole, rest_usdt, base) as (
 select seq, cycle_id, 0::bigint, sin, 0e0, true, 0e0, []::double[] from sized
 union all
 select seq, cycle_id, i, list_sum(list_transform(range(1,n+1), lambda k: take[k]*case when side='SELL' then lv[k].rate else lv[k].px*lv[k].rate end)),
  case when i=1 then spent else used end, whole and qty>0 and quote>=least_, rest_usdt + case when i=1 then 0e0 else (x - spent)*src_px end, list_append(base, qty)
 from (select *, case when side='SELL' then qty else quote end as spent
 from (select *, list_sum(list_transform(range(1,n+1), lambda k: take[k]*lv[k].px)) as quote
 from (select *, list_transform(range(1,n+1), lambda k: greatest(0e0, least(lv[k].cap*{_UNIT},
   qty - coalesce(list_sum(list_transform(range(1,k), lambda j: lv[j].cap*{_UNIT.replace("[k]", "[j]")})),0)))) as take
 from (select *, floor(list_sum(list_transform(range(1,n+1), lambda k: greatest(0e0, least(lv[k].cap,
   x - coalesce(list_sum(list_transform(lv[1:k-1], lambda y: y.cap)),0)))*{_UNIT}))/step + 1e-9)*step as qty
 from (select f.seq, f.cycle_id, lot.i, f.x, f.used, f.whole, f.rest_usdt, f.base, lot.side, lot.step, lot.least_, z.lv[lot.i] as lv, len(z.lv[lot.i]) as n, {_PRICE("lot.src")} as src_px
  from f join lot on lot.cycle_id=f.cycle_id and lot.i=f.i+1 join sz z on z.seq=f.seq and z.cycle_id=f.cycle_id join st on st.seq=f.seq)))))),
o as (select s.seq, s.cycle_id, s.sin as planned, f.used, f.x as "out", f.rest_usdt, (f.x-f.used)*s.start_px+f.rest_usdt as profit_usdt, f.whole, f.base
 from sized s join f using (seq, cycle_id) where f.i=s.n)
select seq, cycle_id::int as cycle_id, case when not whole then 'lot' when round(profit_usdt,6)<=0 then 'edge' else 'order' end as verdict,
 {", ".join(f'round({c},6) as {c}' for c in ("planned", "used", '"out"', "rest_usdt", "profit_usdt"))}, {", ".join(f"round(base[{i}],6) as base_qty_{i}" for i in range(1, 6))} from o"""


def _shadow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shadow scores of sized survivors."""
    keys, rows = ["seq", "cycle_id"], _survivors(spark, sf_dir)
    found = depth.sizing.size_cycles(rows, [*keys, "t_us", "prices", "of", "start_px"], most="most").where("start_in > 0")
    fees = depth.fee_array(SCHEDULED["schedule"])
    price = lambda at: F.element_at(F.col("prices"), at + 1)
    legs = F.transform("of", lambda leg, i: F.struct(
        leg["symbol"].alias("symbol"), leg["side"].alias("side"), F.element_at(fees, leg["number"] + 1).alias("fee"), price(leg["src"]).alias("src_px"),
        price(leg["dst"]).alias("dst_px"), F.get("leg_base_qty", i).alias("base_qty"), F.get("limit_px", i).alias("limit_px"),
    ))
    # Lookups read both sides several times.
    books = stored(depth.snapshots(market(spark, sf_dir, "fx_depth")), "books")
    found = stored(found.select(*keys, "t_us", legs.alias("legs")), "sized")
    return shadow.scores(found, keys, books, HORIZONS, most=ROWS)


@query
def shadow_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sized cycle against the books that stand after each delay: whether all legs fill at their limits, which part
    of the quantities does, and what it earns with partial fills."""
    return _shadow(spark, sf_dir).select("seq", "cycle_id", "delay", "filled", F.round("fill_share", 6).alias("fill_share"), F.round("pnl_usdt", 6).alias("pnl_usdt"))


_WORTH = f"""case when side='SELL' then quote*(1e0-fee)*dst_px - got*src_px else got*(1e0-fee)*dst_px - quote*src_px end"""
_SHADOW = f"""{_survivors_sql(SCHEDULED, PACKET)},
probe as (select s.seq, s.cycle_id, d.delay, st.t_us + d.delay as t_us, l.symbol, l.side, s.base[l.i] as base_qty, s.lim[l.i] as lim, scen.fee,
  {_PRICE(_SOURCE)} as src_px, {_PRICE(_TARGET)} as dst_px
 from sized s join st using (seq) join leg_of l using (cycle_id) join scen on scen.symbol=l.symbol and scen.scenario=s.scenario join fx_symbol b on b.symbol=l.symbol
 cross join (values {", ".join(f"({h}::bigint)" for h in HORIZONS)}) d(delay) where s.sin > 0 and st.t_us + d.delay <= (select max(t_us) from fx_quote)),
seen as (select p.*, list_filter(list_transform(range(5), lambda l: case when side='SELL' then {{'px': q.bid*(1e0-l*1e-4), 'qty': q.bid_qty*(1+l)}}
   else {{'px': q.ask*(1e0+l*1e-4), 'qty': q.ask_qty*(1+l)}} end), lambda y: case when side='SELL' then y.px>=lim*(1e0-1e-12) else y.px<=lim*(1e0+1e-12) end) as lv
 from probe p asof join fx_quote q on p.symbol=q.symbol and p.t_us>=q.t_us),
took as (select *, list_transform(range(1,len(lv)+1), lambda k: greatest(0e0, least(lv[k].qty, base_qty - coalesce(list_sum(list_transform(lv[1:k-1], lambda y: y.qty)),0)))) as take from seen),
filled as (select *, coalesce(list_sum(take),0e0) as got, coalesce(list_sum(list_transform(range(1,len(lv)+1), lambda k: take[k]*lv[k].px)),0e0) as quote from took),
score as (select seq, cycle_id, delay, bool_and(got/base_qty>=1e0-1e-9) as filled, avg(got/base_qty) as fill_share, sum({_WORTH}) as pnl_usdt from filled group by all)"""
ORACLE["shadow_fills"] = f"""{_SHADOW}
select seq, cycle_id::int as cycle_id, delay, filled, round(fill_share,6) as fill_share, round(pnl_usdt,6) as pnl_usdt from score"""


@query
def shadow_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By delay: scored cycles, the share of them whose legs all fill, the mean part filled, P&L of all and of those."""
    rows = stored(_shadow(spark, sf_dir), "shadow")
    whole = F.sum(F.when(F.col("filled"), F.col("pnl_usdt")).otherwise(0e0))
    return rows.groupBy("delay").agg(
        F.count(F.lit(1)).alias("scored"), F.round(F.avg(F.col("filled").cast("double")) * 100, 6).alias("percent_filled"),
        F.round(F.avg("fill_share"), 6).alias("fill_share"), F.round(F.sum("pnl_usdt"), 4).alias("pnl_usdt"), F.round(whole, 4).alias("pnl_filled_usdt"),
    )


ORACLE["shadow_report"] = f"""{_SHADOW}
select delay, count(*) as scored, round(avg(filled::int::double)*100,6) as percent_filled, round(avg(fill_share),6) as fill_share, round(sum(pnl_usdt),4) as pnl_usdt,
 round(sum(case when filled then pnl_usdt else 0e0 end),4) as pnl_filled_usdt from score group by delay"""


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shadow scores with what was known at the decision: age of the run, the oldest leg's book, legs, margin in bps."""
    found = stored(outcomes.followed(market(spark, sf_dir, "fx_depth"), SCHEDULED["schedule"], PACKET, HORIZONS), "outcomes")
    rows = outcomes.scored(found, stored(outcomes.entries(found), "entries"), HORIZONS)
    return fill_model.described(rows.withColumn("held_out", fill_model.held_out(F.col("t_us"))))


def _valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _outcomes(spark, sf_dir)
    learned = rows.where(~F.col("held_out"))
    model = fill_model.fitted(learned)
    share = 0.0 if model else learned.agg(F.avg(F.col("filled").cast("double"))).first()[0] or 0.0
    return fill_model.expected(fill_model.probability(rows, model, share), learned)


@query
def fill_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of filling against what filled, by delay and tenth, on days that the model hasn't seen."""
    found = fill_model.calibration(_valued(spark, sf_dir).where("held_out"))
    return found.select("delay", "bin", "n", F.round("p_mean", 6).alias("p_mean"), F.round("filled_share", 6).alias("filled_share"))


@query
def expected_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sized cycle by delay: its probability to fill, its profit if it does, and the value to expect of it."""
    return _valued(spark, sf_dir).select(
        "seq", "cycle_id", "delay", "held_out", *(F.round(c, 4).alias(c) for c in ("p_fill", "profit_usdt", "ev_usdt"))
    )


def _allocated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return depth_fold.allocated(market(spark, sf_dir, "fx_depth"), SCHEDULED["schedule"])


@query
def allocate_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every snapshot's depth dealt out to its cycles, the one that earns most first, the others on what is left."""
    found = _allocated(spark, sf_dir)
    return found.select("seq", "place", "cycle_id", F.round("start_in", 6).alias("start_in"), F.round("profit_usdt", 6).alias("profit_usdt"))


@query
def allocate_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of those cycles by snapshot and symbol, opposite legs set off against each other."""
    rows = allocation.netted(_allocated(spark, sf_dir), ["seq"], F.element_at(depth.leg_assets(), F.col("cycle_id") + 1))
    return rows.select("seq", "symbol", *(F.round(c, 6).alias(c) for c in ("sold", "bought", "net")))
