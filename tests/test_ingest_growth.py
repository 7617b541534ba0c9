"""Recordings and their ingest as they grow: lines parsed once, days of several files, few files in the table."""

import gzip
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.plans import streams
from millrace.streaming import ingest

HOUR = 3_600_000_000
QUOTE = "t_us long, seq long, symbol string, bid double, ask double, bid_qty double, ask_qty double"


@pytest.fixture
def conf(spark):
    """Sets entries of the session's configuration for one test."""
    before = {}

    def put(name, value):
        before.setdefault(name, spark.conf.get(name, None))
        spark.conf.set(name, value)

    yield put
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def quotes(spark, n, step):
    rows = spark.range(n).select(((F.col("id") + 1) * step).alias("t_us"), F.col("id").alias("seq"), F.lit("BTCUSDT").alias("symbol"), *(F.lit(x).alias(c) for x, c in ((1.0, "bid"), (2.0, "ask"), (3.0, "bid_qty"), (4.0, "ask_qty"))))
    return rows.select(*(field.split()[0] for field in QUOTE.split(", ")))


def files_of(path):
    """Update ids of each file, by day and name."""
    found = {}
    for file in sorted(path.glob("day=*/*.gz")):
        with gzip.open(file, "rt") as lines:
            found[file.parent.name, file.name] = [int(line.split('"u":')[1].split(",")[0]) for line in lines]
    return found


def test_a_line_is_parsed_once(spark):
    lines = spark.createDataFrame([("x",)], "value string")
    for rows in (ingest.updates(lines), ingest.updates(lines).where("update_id is not null and symbol is not null")):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("parseJson") == 1 and plan.count("$.m.data") == 1


def test_odd_lines(spark):
    odd = [
        "junk", "", None, '{"t":5,"m":{"data":{"s":"A"', '{"t":5}', '{"t":5,"m":3}', '{"t":5,"m":{"data":[1]}}',
        '{"t":"7","m":{"data":{"s":"A","u":"12","b":1.50,"B":null,"a":"2","S":"Z","x":{"y":[1]}}}}', '{"t":1.7e18,"m":{"data":{"u":3,"A":1e3}}}',
    ]
    got = ingest.updates(spark.createDataFrame([(x,) for x in odd], "value string").coalesce(1))
    empty = (5, None, None, None, None, None, None, "1970-01-01")
    assert [tuple(r) for r in got.select("t", *ingest.UPDATE, "day").collect()] == [
        empty, empty, empty, (7, "A", 12, 1.5, None, 2.0, None, "1970-01-01"), (1_700_000_000_000_000_000, None, 3, None, None, None, 1000.0, "2023-11-14"),
    ]


def test_a_day_of_many_lines_is_several_files_in_order(spark, tmp_path, conf):
    conf("spark.sql.adaptive.coalescePartitions.enabled", "false")
    streams.record(quotes(spark, 4000, 20_000_000), str(tmp_path / "r"))
    found = files_of(tmp_path / "r")
    assert max(map(len, found.values())) <= 2000
    assert [u for ids in found.values() for u in ids] == list(range(4000))


def test_copies_of_a_line_follow_each_other(spark, tmp_path):
    streams.record(quotes(spark, 300, HOUR), str(tmp_path / "r"), "seq", F.when(F.col("seq") % 3 == 0, 1).otherwise(2))
    found = files_of(tmp_path / "r")
    assert Counter(u for ids in found.values() for u in ids) == {i: 1 if i % 3 == 0 else 2 for i in range(300)}
    assert all(ids == sorted(ids) for ids in found.values())


def test_files_of_the_table_do_not_grow_with_partitions(spark, tmp_path, conf):
    conf("spark.sql.shuffle.partitions", "24")
    path = str(tmp_path / "r")
    streams.record(quotes(spark, 2000, 60_000_000), path)
    ingest.ingest_once(spark, f"{path}/*", f"{path}-table", f"{path}-checkpoint", "1 day").awaitTermination()
    by_day = Counter(f.parent.name for f in (tmp_path / "r-table").glob("day=*/*.parquet"))
    assert len(by_day) == 2 and max(by_day.values()) <= 8
    assert spark.read.parquet(f"{path}-table").select("update_id").distinct().count() == 2000


def test_gzipped_files_are_dealt_in_more_shares_than_cores(spark, tmp_path):
    for i in range(16):
        with gzip.open(tmp_path / f"{i}.gz", "wt") as file:
            file.write("x\n")
    shares = lambda: spark.read.text(str(tmp_path)).rdd.getNumPartitions()
    before = shares()
    with ingest.small_shares(spark):
        assert before <= spark.sparkContext.defaultParallelism < shares()
    assert shares() == before
