"""Ages of runs, the fill model's calibration on days it hasn't seen, and expected values."""

import pytest
from pyspark.sql import functions as F

from millrace.model import DAY, SECOND
from millrace.operators import fill_model


def test_ages_of_runs_go_over_segments_and_end_at_gaps(spark):
    state = spark.createDataFrame([(s, 10 * s) for s in (1, 3, 4, 7, 8, 9)], "seq long, t_us long")
    found = [(1, 1), (3, 1), (4, 1), (8, 1), (9, 1), (4, 2), (9, 2)]
    rows = spark.createDataFrame(found, "seq long, cycle_id int")
    want = {(1, 1): 0, (3, 1): 20, (4, 1): 30, (8, 1): 0, (9, 1): 10, (4, 2): 0, (9, 2): 0}
    for segment, most in ((15, None), (1000, None), (1000, 2)):
        both = rows.join(fill_model.previous(state, segment, most), "seq")
        got = fill_model.aged(both, segment=segment, most=most).collect()
        assert {(r.seq, r.cycle_id): r.age_us for r in got} == want, (segment, most)


def cases(spark, n=6000):
    """Independent draws whose chance falls with age and delay, over 60 days."""
    uniform = lambda seed: (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_003)) + 0.5) / 1_000_003
    rows = spark.range(n).select(
        (F.col("id") % 60 * DAY).alias("t_us"), (uniform(1) * 3600 * SECOND).cast("long").alias("age_us"), F.lit(0).alias("stale_us"),
        F.lit(3).alias("n_legs"), uniform(2).alias("margin"), F.when(F.col("id") % 2 == 0, SECOND).otherwise(60 * SECOND).alias("delay"), uniform(3).alias("u"),
    )
    chance = 1 / (1 + F.exp(F.log1p(F.col("age_us") / SECOND) + F.log1p(F.col("delay") / SECOND) / 2 - 7))
    return fill_model.described(rows).withColumns({"chance": chance, "filled": F.col("u") < chance})


def test_probabilities_hold_on_days_not_seen(spark):
    rows = cases(spark).withColumn("held_out", fill_model.held_out(F.col("t_us")))
    learned = rows.where(~F.col("held_out"))
    found = fill_model.probability(rows.where("held_out"), fill_model.fitted(learned))
    off = found.agg(F.avg(F.abs(F.col("p_fill") - F.col("chance")))).first()[0]
    assert off < 0.03
    table = fill_model.calibration(found).collect()
    assert sum(r.n for r in table) == rows.where("held_out").count() > 1000
    for r in table:
        assert 0 <= r.bin < fill_model.BINS and abs(r.p_mean - r.filled_share) < 4 * (0.25 / r.n) ** 0.5
    assert rows.groupBy(F.floor(F.col("t_us") / DAY)).agg(F.count_distinct("held_out").alias("n")).where("n > 1").count() == 0


def test_one_outcome_gives_no_model(spark):
    rows = cases(spark, 20).withColumn("filled", F.lit(True))
    assert fill_model.fitted(rows) is None and fill_model.fitted(rows.limit(0)) is None
    assert {r.p_fill for r in fill_model.probability(rows, None, 1.0).collect()} == {1.0}


def test_expected_values_of_literal_rows(spark):
    learned = spark.createDataFrame([(1, False, -2.0), (1, False, -4.0), (1, True, 9.0), (2, True, 1.0)], "delay int, filled boolean, pnl_usdt double")
    rows = spark.createDataFrame([(1, 0.75, 8.0), (2, 0.5, 8.0), (3, 1.0, 8.0)], "delay int, p_fill double, profit_usdt double")
    got = {r.delay: r.ev_usdt for r in fill_model.expected(rows, learned).collect()}
    assert got == pytest.approx({1: 6.0 - 0.75, 2: 4.0, 3: 8.0})
