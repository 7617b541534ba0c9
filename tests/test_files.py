"""Data sources: pruned archives, streams of archives, recordings that count when they are committed."""

from __future__ import annotations

import gzip
import zipfile

import pytest
from pyspark.sql import functions as F

from millrace.sources import captures, files


@pytest.fixture
def folder(spark, tmp_path):
    files.register(spark)
    for symbol in ("AAA", "BBB"):
        for day in range(1, 8):
            put(tmp_path, symbol, f"2024-01-0{day}", [[str(i), "1.5", "2", "0", "0", str(1_700_000_000_000 + i), "True"] for i in range(day)], header=day % 2)
    (tmp_path / "notes.txt").write_text("not an archive")
    return tmp_path


def put(path, symbol, period, rows, header=False):
    text = "\n".join([*(["id,p,q,f,l,T,m"] if header else []), *map(",".join, rows)])
    with zipfile.ZipFile(path / f"{symbol}-aggTrades-{period}.zip", "w") as out:
        out.writestr("x.csv", text)


def load(spark, folder):
    return spark.read.format("archives").option("path", str(folder)).load()


def test_rows_headers_and_order(spark, folder):
    rows = captures.archive_trades(load(spark, folder)).collect()
    assert len(rows) == 2 * 28
    day3 = sorted((r.nth, r.t_ms, r.price, r.buyer_maker) for r in rows if r.symbol == "AAA" and r.period == "2024-01-03")
    assert day3 == [(i, 1_700_000_000_000 + i, 1.5, True) for i in range(3)]


@pytest.mark.parametrize(
    ("where", "symbols", "days"),
    [
        ("symbol = 'AAA'", ["AAA"], range(1, 8)),
        ("period >= '2024-01-05' and symbol in ('BBB', 'CCC')", ["BBB"], range(5, 8)),
        ("period < '2024-01-03' and period > '2024-01-01' and nth >= 1", ["AAA", "BBB"], [2]),
        ("symbol like 'A%' and kind = 'aggTrades'", ["AAA"], range(1, 8)),
        ("symbol = 'ZZZ'", [], []),
    ],
)
def test_filters_choose_files(spark, folder, monkeypatch, where, symbols, days):
    monkeypatch.setattr(files, "TASK_BYTES", 1)  # a task for each file
    found = load(spark, folder).where(where)
    got = {(r.symbol, r.period) for r in found.collect()}
    assert got == {(s, f"2024-01-0{d}") for s in symbols for d in days}
    if "like" not in where and "nth" not in where:
        assert len(files.archives(str(folder))) == 14


def test_unopened_files_may_be_broken(spark, folder):
    (folder / "AAA-aggTrades-2024-02-01.zip").write_bytes(b"broken")
    assert load(spark, folder).where("period < '2024-02-01'").count() == 56
    with pytest.raises(Exception, match="zip"):
        load(spark, folder).count()


def test_stream_reads_each_archive_once_over_restarts(spark, folder, tmp_path_factory):
    out = tmp_path_factory.mktemp("out")

    def run():
        rows = spark.readStream.format("archives").option("path", str(folder)).load()
        query = rows.writeStream.format("parquet").option("checkpointLocation", f"{out}/cp").trigger(once=True).start(f"{out}/table")
        query.awaitTermination()
        return spark.read.parquet(f"{out}/table").count()

    assert run() == 56
    put(folder, "CCC", "2024-01-09", [["1", "1", "1", "0", "0", "1", "false"]])
    run()
    assert run() == 57


def test_shares_hold_whole_files_of_about_a_size():
    some = [files.Archive(f"{i}", size, 0, "S", "k", "p") for i, size in enumerate([3 << 20, 3 << 20, 1 << 20, 9 << 20, 1])]
    assert [[a.path for a in s.files] for s in files.shares(some)] == [["0"], ["1", "2"], ["3"], ["4"]]
    assert files.shares([]) == []


def test_lines_by_day_and_nothing_of_a_failed_write(spark, tmp_path):
    files.register(spark)
    day = 86_400_000_000_000
    rows = spark.createDataFrame([(i * day // 2, f'{{"stream":"x","data":{{"s":"A","b":"{i}"}}}}') for i in range(6)], "t long, m string")
    rows.repartition(2).write.format("recordings").option("path", str(tmp_path / "a")).mode("append").save()
    names = sorted(tmp_path.glob("a/*/*.gz"))
    assert {p.parent.name for p in names} == {"day=1970-01-01", "day=1970-01-02", "day=1970-01-03"}
    lines = [line for p in names for line in gzip.open(p, "rt")]
    assert sorted(lines)[0] == '{"t":0,"m":{"stream":"x","data":{"s":"A","b":"0"}}}\n' and len(lines) == 6
    got = captures.quotes_of(captures.read_recording(spark, f"{tmp_path}/a/*"))
    assert sorted(r.bid for r in got.collect()) == [0, 1, 2, 3, 4, 5]
    failing = rows.withColumn("m", F.when(F.col("t") < 2 * day, F.col("m")).otherwise(F.raise_error(F.lit("no"))))
    with pytest.raises(Exception, match="no"):
        failing.coalesce(1).write.format("recordings").option("path", str(tmp_path / "b")).mode("append").save()
    assert not list(tmp_path.glob("b/*/[!_]*"))


def test_captured_json(spark):
    lines = lambda *texts: spark.createDataFrame([(t,) for t in texts], "value string")
    info = captures.exchange_info(lines('{"symbols":[{"symbol":"AB","status":"TRADING","baseAsset":"A","quoteAsset":"B","x":1}]}', "junk"))
    assert [tuple(r) for r in info.collect()] == [("AB", "TRADING", "A", "B")]
    assert [tuple(r) for r in captures.book_tickers(lines('[{"symbol":"AB","bidPrice":"1.5","askPrice":"2"}]')).collect()] == [("AB", 1.5, 2.0)]
    assert [tuple(r) for r in captures.day_tickers(lines('[{"symbol":"AB","quoteVolume":"3"}]')).collect()] == [("AB", 3.0)]
    sample = '{"seq":1,"t_us":2,"symbol":"AB","pool_fee":0.1,"base_address":"0xB","quote_address":"0xa","rpc":[{"id":1,"result":"0x10"},{"id":0,"result":"0xff"}],"book":{"bidPrice":"1","askPrice":"2"}}'
    row = captures.pool_samples(lines(sample)).head()
    assert (row.slot0, row.gas_price, row.bid, row.ask) == ("0xff", 16.0, 1.0, 2.0)
