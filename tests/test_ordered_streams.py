"""Streams in the order of event time: silence, late rows, restarts, repeated lines."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from millrace.model import SYMBOLS
from millrace.streaming import ingest, ordered

PRICE = {"BTC": 100.0, "ETH": 5.0, "BNB": 1.0, "USDC": 1.0, "USDT": 1.0}
QUOTE = "recording string, t_us long, seq long, symbol string, bid double, ask double, bid_qty double, ask_qty double"
SECOND = 1_000_000


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    ordered.keep_state(spark)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def ran(spark, folder, waves, schema, start):
    """Rows that the stream gives, restarted after each wave."""
    for wave in waves:
        spark.createDataFrame(wave, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        out = start(spark.readStream.schema(schema).parquet(f"{folder}/in")).writeStream.format("parquet")
        out.option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return sorted(map(tuple, spark.read.parquet(f"{folder}/out").collect()), key=str)


def quote(t, seq, symbol, up=1.0, name="r"):
    base, other = SYMBOLS[symbol]
    mid = PRICE[base] / PRICE[other] * up
    return (name, t, seq, symbol, mid * 0.9999, mid * 1.0001, 1.0, 1.0)


def test_runs_end_by_updates_or_silence_and_late_rows_go(spark, tmp_path):
    start = [quote(i * 1000, i, s, name=name) for name in "ab" for i, s in enumerate(SYMBOLS)]
    up = lambda t, seq, name: quote(t * SECOND, seq, "BTCUSDT", 1.02, name)
    down = lambda t, seq, name: quote(t * SECOND, seq, "BTCUSDT", 1.0, name)
    beat = lambda t: ("a", t * SECOND, -1, *[None] * 5)
    waves = [
        [down(7, 21, "a"), *start, up(5, 20, "a"), up(6, 30, "b")],  # out of order within a wave
        [up(12, 31, "b"), down(9, 22, "b"), up(11, 23, "a")],  # b goes down at 9, before what came at 12
        [beat(200)],
        [up(50, 40, "a"), beat(400)],  # 50 is behind the watermark by far
    ]
    got = ran(spark, tmp_path, waves, QUOTE, lambda rows: ordered.episodes(rows, 1.0, "60 seconds", SECOND, 20 * SECOND))
    runs = [(r[0], r[1] / SECOND, r[2] / SECOND, r[4]) for r in got]
    assert runs == [
        ("a", 11.0, 11.0, ordered.SILENCE),
        ("a", 5.0, 7.0, "BTCUSDT"),
        ("b", 12.0, 12.0, ordered.SILENCE),
        ("b", 6.0, 9.0, "BTCUSDT"),
    ]


def test_silence_between_updates_of_one_bucket(spark, tmp_path):
    start = [quote(i * 1000, i, s) for i, s in enumerate(SYMBOLS)]
    rows = [quote(1 * SECOND, 20, "BTCUSDT", 1.02), quote(40 * SECOND, 21, "ETHUSDT"), quote(41 * SECOND, 22, "BTCUSDT")]
    got = ran(spark, tmp_path, [start + rows, [("r", 999 * SECOND, -1, *[None] * 5)]], QUOTE, lambda x: ordered.episodes(x, 1.0, "5 seconds", 100 * SECOND, 20 * SECOND))
    assert [(r[1] / SECOND, r[2] / SECOND, r[4]) for r in got] == [(1.0, 1.0, ordered.SILENCE), (40.0, 41.0, "BTCUSDT")]


def test_markouts_of_shuffled_waves_equal_a_plain_lookup(spark, tmp_path):
    draw = random.Random(4)
    schema = "symbol string, t_us long, seq long, bid double, ask double, price double"
    rows = [(draw.choice("XY"), draw.randrange(200) * SECOND, i, *((9.0 + i % 7, 11.0 + i % 5, None) if draw.random() < 0.6 else (None, None, 10.0))) for i in range(400)]
    rows += [("Z", 5 * SECOND, 900, None, None, 10.0), ("Y", 199 * SECOND, 901, None, None, 10.0)]
    late = lambda r: r[1] + draw.randrange(25) * SECOND
    arrival = sorted(rows, key=late)
    waves = [arrival[i : i + 140] for i in range(0, len(arrival), 140)] + [[("", 900 * SECOND, -1, None, None, None)]]
    offsets = (-2 * SECOND, 3 * SECOND, 20 * SECOND)
    start = lambda x: ordered.markouts(x.where("price is null"), x.where("price is not null").select("symbol", "t_us", "seq", "price"), offsets, "30 seconds", 7 * SECOND)
    got = ran(spark, tmp_path, waves, schema, start)
    want = []
    for symbol, t, seq, _, _, price in rows:
        quotes = sorted((r[1], r[2], (r[3] + r[4]) / 2) for r in rows if r[0] == symbol and r[3] is not None)
        at = [next((v for u, _, v in reversed(quotes) if u <= t + o), None) for o in offsets]
        if price is not None and at[0] is not None and t + offsets[-1] <= quotes[-1][0]:
            want.append((symbol, t, seq, price, *at))
    assert len(want) > 80 and got == sorted(want, key=str)


def test_each_update_once_and_late_ones_set_aside(spark, tmp_path):
    line = '{{"t":{t},"m":{{"data":{{"s":"{s}","u":{u},"b":"1","B":"2","a":"3","A":"4"}}}}}}'
    text = lambda t, s, u: line.format(t=t * 1_000_000_000, s=s, u=u)
    waves = [
        [text(100, "A", 1), text(100, "A", 1), text(101, "A", 2), text(100, "B", 1), "junk", '{"t":5}'],
        [text(300, "A", 3), text(101, "A", 2), text(100, "B", 1)],
        [text(150, "A", 9), text(150, "A", 9), text(299, "A", 4), text(100, "A", 1)],
    ]
    for i, wave in enumerate(waves):
        spark.createDataFrame([(x,) for x in wave], "value string").coalesce(1).write.mode("append").text(f"{tmp_path}/in")
        ingest.ingest_once(spark, f"{tmp_path}/in", f"{tmp_path}/table", f"{tmp_path}/cp", "60 seconds", 1).awaitTermination()
    table = spark.read.parquet(f"{tmp_path}/table").withColumn("day", F.col("day").cast("string"))
    assert sorted((r.symbol, r.update_id) for r in table.collect()) == [("A", 1), ("A", 2), ("A", 3), ("A", 4), ("B", 1)]
    late = ingest.set_aside(spark.read.text(f"{tmp_path}/in"), table).collect()
    assert [(r.symbol, r.update_id, r.copies, r.ask) for r in late] == [("A", 9, 2, 3.0)]


def test_timers_need_whole_milliseconds():
    with pytest.raises(ValueError):
        ordered.Ordered("t_us bigint, seq bigint", 1500)
