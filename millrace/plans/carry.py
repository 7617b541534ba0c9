"""Queries over funding payments and the basis between perpetual and spot prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.stats import MIDDLE, median, order_statistics, ratio_pick
from millrace.operators.timeseries import rolling_sum
from millrace.sources.market import duck_ctes, market

QUERIES, ORACLE = {}, {}
WEEK_MS, DAY_MS = 604_800_000, 86_400_000
#: Distance of the compared basis values: a bucket of the test data's closes.
SWING_US = 21_600_000_000


def query(f):
    QUERIES[f.__name__] = f
    return f


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """perp, t_ms, rate, interval_h, week (the sum over the seven days up to each payment)."""
    rows = market(spark, sf_dir, "fx_funding").select("perp", F.unix_millis(F.col("ts").cast("timestamp")).alias("t_ms"), "rate", "interval_h")
    return with_weeks(rows)


def with_weeks(rows: DataFrame) -> DataFrame:
    return rows.withColumn("week", rolling_sum(rows, "rate", WEEK_MS, ["perp"], "t_ms"))


@query
def funding_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payments(spark, sf_dir).select("perp", "t_ms", "rate", F.round("week", 9).alias("week"))


_PAID = f"""{duck_ctes("fx_funding")},
paid as (select perp, epoch_ms(ts) as t_ms, rate, interval_h, sum(rate) over (partition by perp order by epoch_ms(ts) range between {WEEK_MS - 1} preceding and current row) as week from fx_funding)"""
ORACLE["funding_rolling"] = f"with {_PAID} select perp, t_ms, rate, round(week,9) as week from paid"


@query
def funding_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carried(payments(spark, sf_dir))


def carried(rows: DataFrame) -> DataFrame:
    """Each perpetual's funding per day and year, share of positive payments, worst and best seven days."""
    days = (F.max("t_ms") - F.min("t_ms")) / float(DAY_MS) + F.max_by("interval_h", "t_ms") / 24
    found = rows.groupBy("perp").agg(
        F.count(F.lit(1)).alias("payments"), (F.sum("rate") / days).alias("per_day"),
        (F.avg(F.when(F.col("rate") > 0, 1e0).otherwise(0e0)) * 100).alias("positive"), F.min("week").alias("worst"), F.max("week").alias("best"),
    )
    return found.select(
        "perp", "payments", F.round(F.col("per_day") * 1e4, 6).alias("per_day_bps"), F.round(F.col("per_day") * 36500, 6).alias("per_year_percent"),
        F.round("positive", 6).alias("positive_percent"), F.round(F.col("worst") * 1e4, 6).alias("worst_week_bps"),
        F.round(F.col("best") * 1e4, 6).alias("best_week_bps"),
    )


ORACLE["funding_carry"] = f"""with {_PAID},
f as (select perp, count(*) as payments, sum(rate)/((max(t_ms)-min(t_ms))/{DAY_MS}e0+max_by(interval_h,t_ms)/24e0) as per_day,
 avg(case when rate>0 then 1e0 else 0e0 end)*100 as positive, min(week) as worst, max(week) as best from paid group by perp)
select perp, payments, round(per_day*1e4,6) as per_day_bps, round(per_day*36500,6) as per_year_percent, round(positive,6) as positive_percent,
 round(worst*1e4,6) as worst_week_bps, round(best*1e4,6) as best_week_bps from f"""


def basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """coin, bucket_us, b: the perpetual's close over the spot's, in bps, of buckets that both have."""
    return basis_of(market(spark, sf_dir, "fx_close"))


def basis_of(closes: DataFrame) -> DataFrame:
    of = lambda m: closes.where(F.col("market") == m).select("coin", "bucket_us", "close")
    return basis_between(of("spot"), of("perp"))


def basis_between(spot: DataFrame, perp: DataFrame) -> DataFrame:
    """coin, bucket_us, b of closes (coin, bucket_us, close) of both markets."""
    both = spot.withColumnRenamed("close", "spot").join(perp.withColumnRenamed("close", "perp"), ["coin", "bucket_us"])
    return both.select("coin", "bucket_us", ((F.col("perp") / F.col("spot") - 1) * 1e4).alias("b"))


_BASIS = f"""{duck_ctes("fx_close")},
b as (select s.coin, s.bucket_us, (p.close/s.close-1)*1e4 as b from fx_close s join fx_close p using (coin, bucket_us) where s.market='spot' and p.market='perp')"""


@query
def basis_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return basis_report(basis(spark, sf_dir))


def basis_report(rows: DataFrame) -> DataFrame:
    """rows is read three times."""
    sums = rows.groupBy("coin").agg(F.count(F.lit(1)).alias("n"), F.avg("b").alias("mean"), F.min("b").alias("min"), F.max("b").alias("max"))
    ranks = order_statistics(rows, ["coin"], "b", {"p5": ratio_pick(1, 20), "p95": ratio_pick(19, 20), **MIDDLE}).drop("n")
    found = sums.join(F.broadcast(ranks), "coin").withColumn("median", (F.col("low") + F.col("high")) / 2)  # a row for each coin
    return found.select("coin", "n", *(F.round(c, 6).alias(c) for c in ("mean", "p5", "median", "p95", "min", "max")))


ORACLE["basis_stats"] = f"""with {_BASIS}
select coin, count(*) as n, round(avg(b),6) as mean, round(list_sort(list(b))[count(*)//20+1],6) as p5, round(median(b),6) as median,
 round(list_sort(list(b))[count(*)*19//20+1],6) as p95, round(min(b),6) as min, round(max(b),6) as max from b group by coin"""


@query
def basis_swing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usual change of the basis against the bucket exactly one distance before."""
    now = basis(spark, sf_dir)
    was = now.select("coin", (F.col("bucket_us") + SWING_US).alias("bucket_us"), F.col("b").alias("was"))
    return now.join(was, ["coin", "bucket_us"]).groupBy("coin").agg(
        F.count(F.lit(1)).alias("n"), F.round(median(F.abs(F.col("b") - F.col("was"))), 6).alias("median_swing")
    )


ORACLE["basis_swing"] = f"""with {_BASIS}
select x.coin, count(*) as n, round(median(abs(x.b-y.b)),6) as median_swing from b x join b y on x.coin=y.coin and y.bucket_us=x.bucket_us-{SWING_US} group by x.coin"""
