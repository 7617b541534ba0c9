"""The probability that a cycle fills, by what is known when it is decided on, and the value to expect of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.model import DAY, SECOND
from millrace.operators import timeseries as ts

#: A day in three is held out of what the model learns from.
PARTS = 3
#: Bins of the calibration table.
BINS = 10


def previous(state: DataFrame, segment: int = DAY, most: int | None = None) -> DataFrame:
    """state with prev_seq: the seq of the snapshot before."""
    return ts.carry(state, {"prev_seq": F.col("seq")}, ["t_us", "seq"], segment=segment, before=True, most=most)


def aged(found: DataFrame, key: str = "cycle_id", segment: int = DAY, most: int | None = None) -> DataFrame:
    """Survivors (seq, prev_seq, t_us, key) with age_us: for how long the key has been among the survivors of every
    snapshot without a break. Runs go on over the ends of segments."""
    rows = ts.carry(found, {"_last": F.col("seq")}, ["t_us", "seq"], [key], segment=segment, before=True, most=most)
    opened = F.when(F.col("_last").eqNullSafe(F.col("prev_seq")) & F.col("_last").isNotNull(), None).otherwise(F.col("t_us"))
    rows = ts.carry(rows, {"_start": opened}, ["t_us", "seq"], [key], segment=segment, most=most)
    return rows.withColumn("age_us", F.col("t_us") - F.col("_start")).drop("_last", "_start")


def held_out(time: Column) -> Column:
    """Whether a day is one that the model is tested on."""
    return F.crc32(F.floor(time / DAY).cast("string").cast("binary")) % PARTS == 1


def described(rows: DataFrame) -> DataFrame:
    """rows (age_us, stale_us, n_legs, margin, delay) with the model's features f_*: logarithms of times, a square for what
    doesn't go one way."""
    log = lambda c: F.log1p(F.greatest(F.col(c), F.lit(0)) / SECOND)
    return rows.withColumns({
        "f_age": log("age_us"), "f_stale": log("stale_us"), "f_legs": F.col("n_legs").cast("double"),
        "f_margin": F.col("margin").cast("double"), "f_delay": log("delay"), "f_delay_2": log("delay") * log("delay"),
    })


FEATURES = ("f_age", "f_stale", "f_legs", "f_margin", "f_delay", "f_delay_2")


def fitted(rows: DataFrame, features: Sequence[str] = FEATURES) -> PipelineModel | None:
    """A logistic model of `filled` on described rows; None if they don't hold both outcomes."""
    seen = rows.agg(F.count_distinct("filled")).first()[0]
    if seen < 2:
        return None
    stages = [
        VectorAssembler(inputCols=list(features), outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_features", withMean=True),
        LogisticRegression(featuresCol="_features", labelCol="_label", regParam=1e-4, maxIter=50),
    ]
    return Pipeline(stages=stages).fit(rows.withColumn("_label", F.col("filled").cast("double")))


def probability(rows: DataFrame, model: PipelineModel | None, otherwise: float = 0.0) -> DataFrame:
    """rows with p_fill; without a model the one outcome that was seen."""
    if model is None:
        return rows.withColumn("p_fill", F.lit(float(otherwise)))
    found = model.transform(rows).withColumn("p_fill", vector_to_array("probability")[1])
    return found.drop("_raw", "_features", "rawPrediction", "probability", "prediction")


def expected(rows: DataFrame, learned: DataFrame) -> DataFrame:
    """rows (delay, p_fill, profit_usdt) with ev_usdt: p * profit + (1 - p) * what cycles of learned (delay, filled,
    pnl_usdt) that didn't fill in full brought on average after the same delay, partial fills marked; 0 if there are none."""
    miss = learned.where(~F.col("filled")).groupBy("delay").agg(F.avg("pnl_usdt").alias("_miss"))
    found = rows.join(F.broadcast(miss), "delay", "left")  # a row for each delay
    value = F.col("p_fill") * F.col("profit_usdt") + (1 - F.col("p_fill")) * F.coalesce("_miss", F.lit(0e0))
    return found.withColumn("ev_usdt", value).drop("_miss")


def calibration(rows: DataFrame, by: Sequence[str] = ("delay",), bins: int = BINS) -> DataFrame:
    """by, bin (from 0), n, p_mean, filled_share of rows (p_fill, filled): equal where the model is calibrated."""
    place = F.least(F.floor(F.col("p_fill") * bins), F.lit(bins - 1)).cast("int").alias("bin")
    return rows.groupBy(*by, place).agg(
        F.count(F.lit(1)).alias("n"), F.avg("p_fill").alias("p_mean"), F.avg(F.col("filled").cast("double")).alias("filled_share")
    )
