"""Order statistics and regressions with the index and guard rules of the engine's reports."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def median(x: Column | str) -> Column:
    """The middle value, or the mean of the two middle ones."""
    return F.percentile(x, F.lit(0.5))


@dataclass(frozen=True)
class Pick:
    """A value by its place (from 0) among n ascending ones: about the share q, exactly place(n)."""

    q: float
    place: Callable[[Column], Column]


def share_pick(q: float) -> Pick:
    """Place min(n - 1, floor(q * n))."""
    return Pick(q, lambda n: F.least(n - 1, F.floor(n * F.lit(q)).cast("bigint")))


def ratio_pick(numerator: int, denominator: int) -> Pick:
    """Place n * numerator div denominator."""
    return Pick(numerator / denominator, lambda n: F.floor(n * numerator / denominator).cast("bigint"))


#: The two places whose mean is the median.
MIDDLE = {"low": Pick(0.5, lambda n: F.floor((n - 1) / 2).cast("bigint")), "high": Pick(0.5, lambda n: F.floor(n / 2).cast("bigint"))}

#: Half the width of the range of ranks that is looked at for a pick, and accuracy of the quantiles that bound it.
REACH, ACCURACY = 3e-4, 10_000


def order_statistics(rows: DataFrame, keys: Sequence[str], value: str, picks: dict[str, Pick]) -> DataFrame:
    """keys, n and each pick of the values that aren't null, exactly, whatever the number of a key's values.

    Approximate quantiles bound each pick by two values. Values below are only counted, values in between are counted
    one by one and ranked; equal ones are one row. No task holds a key's values. rows is read twice.
    """
    rows = rows.select(*keys, F.col(value).alias("_v")).where(F.col("_v").isNotNull())
    bounds = [p for pick in picks.values() for p in (max(0.0, pick.q - REACH), min(1.0, pick.q + REACH))]
    ends = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("_v", F.array(*map(F.lit, bounds)), ACCURACY).alias("_c"))
    few, none = F.col("n") * REACH < 3, F.lit(float("inf"))  # of few values all are ranked
    asked = F.array(
        *(
            F.struct(
                F.lit(name).alias("name"), pick.place(F.col("n")).alias("place"),
                F.when(few, -none).otherwise(F.col("_c")[2 * i]).alias("low"), F.when(few, none).otherwise(F.col("_c")[2 * i + 1]).alias("high"),
            )
            for i, (name, pick) in enumerate(picks.items())
        )
    )
    looked = rows.join(ends.select(*keys, "n", asked.alias("_t")), list(keys)).select(
        *keys, "n", "_v", F.explode(F.filter("_t", lambda t: F.col("_v") <= t["high"])).alias("t")
    )
    ranked = F.when(F.col("_v") >= F.col("t.low"), F.col("_v")).alias("_r")
    counts = looked.groupBy(*keys, "t.name", ranked).agg(F.count(F.lit(1)).alias("_k"), F.max("t.place").alias("_place"), F.max("n").alias("n"))
    up_to = F.sum("_k").over(Window.partitionBy(*keys, "name").orderBy(F.asc_nulls_first("_r")).rowsBetween(Window.unboundedPreceding, 0))
    reached = counts.withColumn("_reached", up_to > F.col("_place"))
    return reached.groupBy(*keys).agg(
        F.max("n").alias("n"), *(F.min(F.when((F.col("name") == name) & F.col("_reached"), F.col("_r"))).alias(name) for name in picks)
    )


def medians(rows: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """keys, n and the median of each key's values that aren't null, whatever their number."""
    found = order_statistics(rows, keys, value, MIDDLE)
    return found.select(*keys, "n", ((F.col("low") + F.col("high")) / 2).alias(name))


def at_share(x: Column | str, q: float) -> Column:
    """The value at place min(n - 1, floor(q * n)) of the ascending values of a group that one task can hold."""
    s = F.sort_array(F.collect_list(x))
    return F.get(s, F.least(F.size(s) - 1, F.floor(F.size(s) * F.lit(q)).cast("int")))


def at_ratio(x: Column | str, numerator: int, denominator: int) -> Column:
    """The value at place n * numerator div denominator of the ascending values of a group that one task can hold."""
    s = F.sort_array(F.collect_list(x))
    return F.get(s, F.floor(F.size(s) * numerator / denominator).cast("int"))


def share_above(x: Column, threshold: float) -> Column:
    """Percentage of values strictly above a threshold."""
    return F.avg(F.when(x > threshold, 1e0).otherwise(0e0)) * 100


def ols_slope(y: Column | str, x: Column | str) -> Column:
    return F.when(F.var_pop(x) > 0, F.regr_slope(y, x))


def ols_r2(y: Column | str, x: Column | str) -> Column:
    return F.when((F.var_pop(x) > 0) & (F.var_pop(y) > 0), F.regr_r2(y, x))


def r2_two(x1: str, x2: str, y: str) -> Column:
    """R squared of y on x1 and x2 with an intercept, from population moments; null if they are collinear."""
    s11, s22, s12 = F.var_pop(x1), F.var_pop(x2), F.covar_pop(x1, x2)
    s1y, s2y, syy = F.covar_pop(x1, y), F.covar_pop(x2, y), F.var_pop(y)
    det = s11 * s22 - s12 * s12
    b1, b2 = (s22 * s1y - s12 * s2y), (s11 * s2y - s12 * s1y)
    return F.when((det > 0) & (syy > 0), (b1 * s1y + b2 * s2y) / det / syy)


def gap_closure(gap: str, move: str) -> tuple[Column, Column]:
    """Slope and correlation of move on gap; null where the gap hardly varies."""
    varies = F.var_pop(gap) >= 1e-18
    cov = F.covar_pop(gap, move)
    both = F.sqrt(F.var_pop(gap) * F.var_pop(move))
    return F.when(varies, F.try_divide(cov, F.var_pop(gap))), F.when(varies, F.try_divide(cov, both))
