"""Queries over spot and perpetual trades of the same coins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.stats import ols_r2, ols_slope, r2_two
from millrace.operators import anchors as an
from millrace.operators import markout as mk
from millrace.operators import timeseries as ts
from millrace.plans.common import FRESH, GRID, HORIZONS, PRE
from millrace.sources.market import duck_ctes, market

QUERIES, ORACLE = {}, {}
#: Width of a basis bucket and how many before count; lead of the regressions; rows they need at least; BTC's stand-in.
WIDTH, BUCKETS = 6 * GRID, 5
LEAD, HORIZON = HORIZONS[1], HORIZONS[2]
LEAST_ROWS, LEAST_MINUTES, LEADER = 60, 30, "C0"
KEPT = (0.0, 5.0, 10.0)
PREFIXES = ("", "1000", "1000000")


def query(f):
    QUERIES[f.__name__] = f
    return f


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    trades = market(spark, sf_dir, "fx_alt_trade")
    spot, perp = an.market_mids(trades, FRESH)
    return trades, spot, perp, an.basis(spot, perp, WIDTH, BUCKETS)


def _leader_closes(trades: DataFrame) -> DataFrame:
    """k, btc: the leader's last spot price of each grid step."""
    rows = trades.where((F.col("market") == "spot") & (F.col("coin") == LEADER))
    return rows.groupBy(an.bucket_of(F.col("t_us"), GRID).alias("k")).agg(F.max_by("price", F.struct("t_us", "seq")).alias("btc"))


def _span(trades: DataFrame) -> DataFrame:
    """day0, end_us of the whole recording."""
    return trades.agg((F.min("t_us") - F.min("t_us") % WIDTH).alias("day0"), F.max("t_us").alias("end_us"))


_T = f"""{duck_ctes("fx_alt_trade")},
sided as (select coin, market, t_us, seq, last_value(case when buyer_maker then price end ignore nulls) over x as bid, last_value(case when buyer_maker then t_us end ignore nulls) over x as bt,
 last_value(case when not buyer_maker then price end ignore nulls) over x as ask, last_value(case when not buyer_maker then t_us end ignore nulls) over x as att
 from fx_alt_trade window x as (partition by coin, market order by t_us, seq rows unbounded preceding)),
mid as (select coin, market, t_us, (bid+ask)/2 as mid from sided where bid is not null and ask is not null and t_us-least(bt,att)<={FRESH}),
spot as (select coin, t_us, mid from mid where market='spot'), perp as (select coin, t_us, mid from mid where market='perp'),
med as (select s.coin, s.t_us//{WIDTH} as k, median(ln(s.mid/p.mid)) as m from spot s asof join perp p on s.coin=p.coin and s.t_us>=p.t_us group by 1,2),
basis as (select coin, k+j as bucket, median(m) as basis from med, (select unnest(range(1,{BUCKETS + 1})) as j) group by 1,2),
span as (select min(t_us)-min(t_us)%{WIDTH} as day0, max(t_us) as end_us from fx_alt_trade),
btc as (select t_us//{GRID} as k, arg_max(price, {{'t': t_us, 's': seq}}) as btc from fx_alt_trade where market='spot' and coin='{LEADER}' group by 1)"""


@query
def anchor_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir)[3].select("coin", "bucket", F.round("basis", 9).alias("basis"))


ORACLE["anchor_basis"] = f"with {_T} select coin, bucket::bigint as bucket, round(basis,9) as basis from basis"


def _grid(trades: DataFrame, start: int, end: int) -> DataFrame:
    """coin, t_us, seq: each coin at each grid step from day0 + start to the end less `end`."""
    span = _span(trades).select((F.col("day0") + start).alias("t0"), (F.col("end_us") - end - 1).alias("t1")).where("t1 >= t0")
    return ts.grid(trades.select("coin").distinct().crossJoin(F.broadcast(span)), GRID).withColumn("seq", F.col("t_us"))


_G = lambda start, end: f"""g as (select coin, unnest(range(day0+{start}, end_us-{end}, {GRID})) as t_us from span, (select distinct coin from fx_alt_trade))"""
_FAIR = """lk as (select pr.*, s.mid as spot from pr asof left join spot s on pr.coin=s.coin and pr.p_us>=s.t_us),
lk2 as (select lk.*, p.mid as perp from lk asof left join perp p on lk.coin=p.coin and lk.p_us>=p.t_us),
at as (select lk2.*, perp*exp(basis) as fair from lk2 left join basis b on b.coin=lk2.coin and b.bucket=lk2.p_us//WIDTH)""".replace("WIDTH", str(WIDTH)).replace("at as", "at_ as")


@query
def anchor_fair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The perpetual-implied price of each coin at each grid step."""
    trades, _, perp, bases = _parts(spark, sf_dir)
    found = an.with_fair(_grid(trades, 0, 0), perp, bases, WIDTH).where(F.col("fair").isNotNull())
    return found.select("coin", "t_us", F.round("fair", 6).alias("fair"))


ORACLE["anchor_fair"] = f"""with {_T}, {_G(0, 0)}, pr as (select *, t_us as p_us from g), {_FAIR}
select coin, t_us, round(fair,6) as fair from at_ where fair is not null"""


def _moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """coin, gap, spot_move, perp_move, btc_last at the grid steps where all prices are known."""
    trades, spot, perp, bases = _parts(spark, sf_dir)
    rows = an.at_offsets(_grid(trades, (BUCKETS + 1) * WIDTH, LEAD), spot, perp, bases, [0, LEAD], WIDTH)
    closes = _leader_closes(trades)
    for name, back in (("b0", LEAD), ("b1", 0)):
        rows = rows.withColumn("k", an.bucket_of(F.col("t_us") - back, GRID)).join(closes.withColumnRenamed("btc", name), "k").drop("k")
    return rows.select(
        "coin", F.ln(F.col("at_0.fair") / F.col("at_0.spot")).alias("gap"), F.ln(F.col("at_1.spot") / F.col("at_0.spot")).alias("spot_move"),
        (-F.ln(F.col("at_1.perp") / F.col("at_0.perp"))).alias("perp_move"), F.ln(F.col("b1") / F.col("b0")).alias("btc_last"),
    ).dropna()


_MOVES = f"""{_T}, {_G((BUCKETS + 1) * WIDTH, LEAD)}, pr as (select coin, t_us, o, t_us+o as p_us from g, (values (0),({LEAD})) v(o)), {_FAIR},
two as (select a.coin, a.t_us, a.fair, a.spot as o0, b.spot as o1, a.perp as p0, b.perp as p1 from at_ a join at_ b using (coin, t_us) where a.o=0 and b.o={LEAD}),
mv as (select coin, ln(fair/o0) as gap, ln(o1/o0) as spot_move, -ln(p1/p0) as perp_move, ln(y.btc/x.btc) as btc_last
 from two join btc x on x.k=(two.t_us-{LEAD})//{GRID} join btc y on y.k=two.t_us//{GRID} where fair is not null and o0 is not null and o1 is not null and p0 is not null and p1 is not null)"""


@query
def anchor_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the gap to the implied price the spot and the perpetual close, and what predicts the spot."""
    rows = _moves(spark, sf_dir).groupBy("coin").agg(
        F.count(F.lit(1)).alias("n"), ols_slope("spot_move", "gap").alias("spot_closes"), ols_slope("perp_move", "gap").alias("perp_closes"),
        ols_r2("spot_move", "gap").alias("r2_gap"), ols_r2("spot_move", "btc_last").alias("r2_btc"),
    )
    return rows.where(F.col("n") >= LEAST_ROWS).select("coin", "n", *(F.round(c, 6).alias(c) for c in rows.columns[2:]))


_SLOPE = lambda y, x: f"round(case when var_pop({x})>0 then regr_slope({y},{x}) end,6)"
_R2 = lambda y, x: f"round(case when var_pop({x})>0 and var_pop({y})>0 then regr_r2({y},{x}) end,6)"
ORACLE["anchor_lead"] = f"""with {_MOVES}
select coin, count(*) as n, {_SLOPE("spot_move", "gap")} as spot_closes, {_SLOPE("perp_move", "gap")} as perp_closes, {_R2("spot_move", "gap")} as r2_gap,
 {_R2("spot_move", "btc_last")} as r2_btc from mv group by coin having count(*)>={LEAST_ROWS}"""


@query
def anchor_r2_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the gap and the leader's last move together say about the spot's next one."""
    rows = _moves(spark, sf_dir).groupBy("coin").agg(F.count(F.lit(1)).alias("n"), F.round(r2_two("gap", "btc_last", "spot_move"), 6).alias("r2_both"))
    return rows.where(F.col("n") >= LEAST_ROWS)


ORACLE["anchor_r2_two"] = f"""with {_MOVES},
c as (select coin, count(*) as n, var_pop(gap) as s11, var_pop(btc_last) as s22, covar_pop(gap,btc_last) as s12, covar_pop(gap,spot_move) as s1y,
 covar_pop(btc_last,spot_move) as s2y, var_pop(spot_move) as syy from mv group by coin)
select coin, n, round(case when s11*s22-s12*s12>0 and syy>0 then ((s22*s1y-s12*s2y)*s1y+(s11*s2y-s12*s1y)*s2y)/(s11*s22-s12*s12)/syy end,6) as r2_both from c where n>={LEAST_ROWS}"""


@query
def anchor_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beta of each coin's perpetual to the leader, on returns of one grid step."""
    trades, _, perp, _ = _parts(spark, sf_dir)
    probes = ts.probes_at(_grid(trades, GRID, 0), [-GRID, 0])
    found = ts.asof(probes, perp, ["coin"], ["mid"]).join(_leader_closes(trades).withColumn("t_us", F.col("k") * GRID), "t_us")
    pick = lambda c, o: F.max(F.when(F.col("offset") == o, F.col(c)))
    rows = found.groupBy("coin", "seq").agg(
        F.ln(pick("btc", 0) / pick("btc", -GRID)).alias("x"), F.ln(pick("mid", 0) / pick("mid", -GRID)).alias("y")
    ).dropna()
    enough = F.count(F.lit(1)) > LEAST_MINUTES
    return rows.groupBy("coin").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.when(enough, ols_slope("y", "x")), 6).alias("beta"), F.round(F.when(enough, ols_r2("y", "x")), 6).alias("r2")
    )


ORACLE["anchor_beta"] = f"""with {_T}, {_G(GRID, 0)}, p as (select coin, t_us, o, t_us+o as p_us from g, (values (-{GRID}),(0)) v(o)),
lk as (select p.coin, p.t_us, p.o, q.mid, b.btc from p asof join perp q on p.coin=q.coin and p.p_us>=q.t_us join btc b on b.k=p.p_us//{GRID}),
r as (select a.coin, ln(b.btc/a.btc) as x, ln(b.mid/a.mid) as y from lk a join lk b using (coin, t_us) where a.o=-{GRID} and b.o=0)
select coin, count(*) as n, case when count(*)>{LEAST_MINUTES} then {_SLOPE("y", "x")} end as beta, case when count(*)>{LEAST_MINUTES} then {_R2("y", "x")} end as r2 from r group by coin"""


@query
def anchor_markout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passive spot fills against the spot's own mid and the perpetual-implied price, by coin and all together."""
    trades, spot, perp, bases = _parts(spark, sf_dir)
    fills = trades.where("market = 'spot'").select("coin", "t_us", "seq", "price", "qty", "buyer_maker").crossJoin(F.broadcast(_span(trades)))
    fills = fills.where(F.col("t_us") + HORIZON <= F.col("end_us")).drop("day0", "end_us")
    found = an.at_offsets(fills, spot, perp, bases, [-PRE, HORIZON], WIDTH)
    known = F.lit(True)
    for i in (0, 1):
        for c in ("fair", "spot"):
            known = known & F.coalesce(F.col(f"at_{i}.{c}") != 0, F.lit(False))
    # exp and ln aren't exact to the last bit, so edges are compared with the thresholds at nine digits.
    rows = found.where(known).withColumns({
        "w": F.col("price") * F.col("qty"), "edge": F.round(mk.gain_bps(F.col("at_0.fair")), 9), "fill": mk.gain_bps(F.col("at_0.spot")),
        "own": mk.gain_bps(F.col("at_1.spot")), "anchor": mk.gain_bps(F.col("at_1.fair")),
    })
    per = rows.withColumn("of", F.explode(F.array(F.col("coin"), F.lit("all")))).groupBy("of").agg(
        F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), *mk.weighted(["fill", "own", "anchor"]), *mk.kept(F.col("edge"), KEPT, F.col("anchor"), F.col("w"))
    )
    return per.select("of", "n", F.round("w", 5).alias("notional"), *(F.round(c, 6).alias(c) for c in ("fill", "own", "anchor")), *mk.kept_report(KEPT))


ORACLE["anchor_markout"] = f"""with {_T}, pr as (select coin, t_us, seq, price, qty, buyer_maker, o, t_us+o as p_us from fx_alt_trade, (values (-{PRE}),({HORIZON})) v(o), span
 where market='spot' and t_us+{HORIZON}<=end_us), {_FAIR},
m as (select a.coin, a.price*a.qty as w, round(s*(a.fair/a.price-1)*1e4,9) as edge, s*(a.spot/a.price-1)*1e4 as fill, s*(b.spot/a.price-1)*1e4 as own, s*(b.fair/a.price-1)*1e4 as anchor
 from (select *, case when buyer_maker then 1e0 else -1e0 end as s from at_) a join at_ b using (seq) where a.o=-{PRE} and b.o={HORIZON}
 and a.fair is not null and b.fair is not null and a.spot is not null and b.spot is not null),
c as (select *, unnest([coin, 'all']) as of from m)
select of, count(*) as n, round(sum(w),5) as notional, {", ".join(f"round(sum({c}*w)/sum(w),6) as {c}" for c in ("fill", "own", "anchor"))},
 {", ".join(f"round(sum(case when edge>={n} then w else 0 end)/sum(w),6) as share_{n:g}, round(sum(anchor*w) filter (edge>={n})/nullif(sum(w) filter (edge>={n}),0),6) as pnl_{n:g}" for n in KEPT)}
 from c group by of"""


@query
def anchor_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    trades, usd = market(spark, sf_dir, "fx_alt_trade"), F.col("price") * F.col("qty")
    rows = trades.groupBy("coin").agg(
        F.count_if(F.col("market") == "spot").alias("fills"), *(F.sum(F.when(F.col("market") == m, usd)).alias(m) for m in ("spot", "perp"))
    )
    return rows.select("coin", "fills", F.round("spot", 5).alias("spot"), F.round("perp", 5).alias("perp"), F.round(F.try_divide("perp", "spot"), 6).alias("ratio"))


ORACLE["anchor_volume"] = f"""with {duck_ctes("fx_alt_trade")},
v as (select coin, count(*) filter (market='spot') as fills, sum(price*qty) filter (market='spot') as spot, sum(price*qty) filter (market='perp') as perp from fx_alt_trade group by 1)
select coin, fills, round(spot,5) as spot, round(perp,5) as perp, round(perp/spot,6) as ratio from v"""


@query
def perp_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each coin's perpetual: of the symbols it may be listed under the first that is."""
    coins = market(spark, sf_dir, "fx_alt_trade").select("coin").distinct()
    listed = market(spark, sf_dir, "fx_perp")
    names = coins.select("coin", F.posexplode(F.array(*map(F.lit, PREFIXES))).alias("place", "prefix"))
    found = names.withColumn("perp", F.concat("prefix", "coin", F.lit("USDT"))).join(listed, "perp", "left_semi")
    first = F.row_number().over(Window.partitionBy("coin").orderBy("place"))
    return coins.join(found.withColumn("r", first).where("r = 1").select("coin", "perp"), "coin", "left")


ORACLE["perp_lookup"] = f"""with {duck_ctes("fx_alt_trade", "fx_perp")},
c as (select distinct coin from fx_alt_trade),
f as (select coin, p||coin||'USDT' as perp, i from c, (values (0,''),(1,'1000'),(2,'1000000')) v(i, p) where p||coin||'USDT' in (select perp from fx_perp))
select c.coin, f.perp from c left join (select coin, arg_min(perp, i) as perp from f group by 1) f using (coin)"""
