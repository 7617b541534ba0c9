"""Operators on small literal books and files, at the rules' edges, and against plain Python."""

import gzip
import math
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import stats
from millrace.model import LEGS, SYMBOLS, flat_fees, parse_fees
from millrace.operators import depth, episodes, fair, graph, markout, screen, sizing
from millrace.operators import timeseries as ts
from millrace.sources import captures
from millrace.streaming import ingest, screening

BOOKS = {
    "BTCUSDT": ([(99.0, 5.0)], [(100.0, 1.0), (101.0, 1.0)]),
    "ETHBTC": ([(0.049, 10.0)], [(0.05, 10.0)]),
    "ETHUSDT": ([(5.1, 100.0)], [(5.2, 100.0)]),
}
LEVELS = "array<struct<px:double,qty:double>>"


def test_enumeration_and_legs():
    by_length = [sum(len(c) == n for c in graph.cycles()) for n in (3, 4, 5)]
    assert by_length == [20, 30, 24]
    assert len({frozenset((leg.src, leg.dst) for leg in c) for c in graph.cycles()}) == 74
    assert (LEGS["USDT", "BTC"].side, LEGS["BTC", "USDT"].side, LEGS["BNB", "ETH"].symbol) == ("BUY", "SELL", "BNBETH")
    assert len(graph.paths("USDT", "BNB")) == 16 and [len(p) for p in graph.paths("USDT", "BNB")] == sorted(len(p) for p in graph.paths("USDT", "BNB"))
    with pytest.raises(ValueError):
        parse_fees("7.5,XYZ=1")
    assert parse_fees(" 7.5 , usdcusdt = 0")["USDCUSDT"] == 0.0


def book_rows(spark, books, legs, fee, amount=None):
    """One row with the levels of a cycle's or path's legs."""
    levels = []
    for leg in legs:
        bids, asks = books[leg.symbol]
        levels.append((leg.side, bids, asks))
    frame = spark.createDataFrame([(1, levels, amount)], f"k int, l array<struct<side:string,bids:{LEVELS},asks:{LEVELS}>>, amount double")
    legs_of = F.transform("l", lambda x: F.struct(x["side"].alias("side"), sizing.leg_levels(x["side"], x["bids"], x["asks"], F.lit(fee)).alias("levels")))
    return frame.select("k", "amount", legs_of.alias("legs"))


def chain(*assets):
    return tuple(LEGS[a, b] for a, b in zip(assets, assets[1:]))


def size(spark, books=BOOKS, fee=0.0, most=None):
    rows = book_rows(spark, books, chain("USDT", "BTC", "ETH", "USDT"), fee, most)
    return sizing.size_cycles(rows, ["k"], most="amount" if most else None).first()


def test_sizing_of_literal_books(spark):
    r = size(spark)
    assert np.allclose([r.start_in, r.start_out, *r.leg_base_qty, *r.limit_px], [50, 51, 0.5, 10, 10, 100, 0.05, 5.1])
    deeper = BOOKS | {"ETHBTC": ([(0.049, 10.0)], [(0.05, 10.0), (0.052, 10.0)])}
    assert math.isclose(size(spark, deeper).start_in, 50)
    r = size(spark, most=20.0)
    assert math.isclose(r.start_in, 20) and math.isclose(r.profit, 0.4)
    assert size(spark, fee=0.01).start_in == 0
    empty = BOOKS | {"ETHBTC": ([], [(0.05, 0.0)])}
    r = size(spark, empty)
    assert r.start_in == 0 and all(map(math.isnan, r.limit_px))


def plain_walk(legs, most):
    """Marginal walk of legs [(side, [(cap, rate, px)])] in plain Python."""
    if any(not lv for _, lv in legs):
        return 0.0, 0.0
    at, left, into, out = [0] * len(legs), [lv[0][0] for _, lv in legs], 0.0, 0.0
    while into < most:
        rates = [lv[i][1] for (_, lv), i in zip(legs, at)]
        before = np.concatenate([[1], np.cumprod(rates)])
        if before[-1] <= 1:
            break
        step = min(min(r / b for r, b in zip(left, before)), most - into)
        into, out = into + step, out + step * before[-1]
        for i, (_, lv) in enumerate(legs):
            left[i] -= step * before[i]
            if left[i] <= lv[at[i]][0] * 1e-12:
                at[i] += 1
                if at[i] == len(lv):
                    return into, out
                left[i] = lv[at[i]][0]
    return into, out


def test_sizing_of_random_books_equals_a_plain_walk(spark):
    rng = random.Random(3)
    rows, want = [], []
    for k in range(300):
        n = rng.choice([3, 4, 5])
        legs = [(rng.choice(["SELL", "BUY"]), sorted(((rng.uniform(0.1, 9), rng.uniform(0.97, 1.06), 1.0) for _ in range(rng.randint(0 if k % 9 == 0 else 1, 6))), key=lambda x: -x[1])) for _ in range(n)]
        most = rng.choice([1.5, math.inf])
        rows.append((k, legs, most))
        want.append(plain_walk(legs, most))
    frame = spark.createDataFrame(rows, "k int, legs array<struct<side:string,levels:array<struct<cap:double,rate:double,px:double>>>>, most double")
    got = {r.k: r for r in sizing.size_cycles(frame, ["k"], most="most").collect()}
    assert len(got) == 300 and sum(w[0] > 0 for w in want) > 50
    for k, (into, out) in enumerate(want):
        assert math.isclose(got[k].start_in, into, rel_tol=1e-9, abs_tol=1e-12) and math.isclose(got[k].start_out, out, rel_tol=1e-9, abs_tol=1e-12)


def test_fills_and_routes_of_literal_books(spark):
    fill = lambda amount, *assets: book_rows(spark, BOOKS, chain(*assets), 0.0, amount).select(sizing.filled(F.col("legs"), F.col("amount")).alias("f")).first().f
    f = fill(150.0, "USDT", "BTC")
    assert math.isclose(f.out, 1 + 50 / 101) and f.limit_px == [101] and f.leg_in == [150]
    assert fill(500.0, "USDT", "BTC").out is None and fill(500.0, "USDT", "BTC", "ETH").out is None
    routes = []
    for assets in (("USDT", "ETH"), ("USDT", "BTC", "ETH")):
        row = book_rows(spark, BOOKS, chain(*assets), 0.0, 50.0).first()
        routes.append((">".join(assets), row.legs))
    frame = spark.createDataFrame([(routes,)], "r array<struct<path:string,legs:array<struct<side:string,levels:array<struct<cap:double,rate:double,px:double>>>>>>")
    best = frame.select(sizing.best_route(F.col("r"), F.lit(50.0)).alias("b")).first().b
    assert best.path == "USDT>BTC>ETH" and math.isclose(best.out, 10)


def flat_market(spark, **changed):
    price = {"USDT": 1.0, "USDC": 1.0, "BTC": 100.0, "ETH": 5.0, "BNB": 1.0}
    mids = {s: price[b] / price[q] for s, (b, q) in SYMBOLS.items()} | changed
    row = {f"{c}_{s}": m for s, m in mids.items() for c in ("bid", "ask")}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} double" for c in row)), mids


def test_best_path_and_fair_values_of_a_flat_market(spark):
    market, mids = flat_market(spark)
    names = ("own", "routes", "usdt")
    values = market.select(*(fair.BY_NAME[n](s).alias(f"{n}_{s}") for n in names for s in SYMBOLS)).first()
    assert all(math.isclose(values[f"{n}_{s}"], m) for n in names for s, m in mids.items())
    shocked, _ = flat_market(spark, BTCUSDC=101.0)
    fees = flat_fees(0)
    r = shocked.select(graph.best_path("BTC", "USDT", fees, "BTCUSDT").alias("a"), graph.best_path("BTC", "USDT", fees, "BTCUSDC").alias("b"),
                       fair.routes("BTCUSDT").alias("c"), fair.usdt("BTCUSDC").alias("d")).first()
    assert math.isclose(r.a.rate, 101) and r.a.path == "BTC->USDC->USDT" and math.isclose(r.b.rate, 100)
    assert math.isclose(r.c, 100) and math.isclose(r.d, 100)


def quotes_table(spark, n=4000, seed=1, span=5 * 86_400_000_000):
    rng = np.random.default_rng(seed)
    price = {"USDT": 1.0, "USDC": 1.0, "BTC": 100.0, "ETH": 5.0, "BNB": 1.0}
    times = np.sort(rng.integers(0, span, n))
    rows = []
    for i, t in enumerate(times.tolist()):
        s = list(SYMBOLS)[rng.integers(10)]
        b, q = SYMBOLS[s]
        mid = price[b] / price[q] * (1 + rng.normal() * 6e-4)
        rows.append((i, t // 7 * 7, s, mid * 0.9999, mid * 1.0001, float(rng.integers(1, 9)), float(rng.integers(1, 9))))
    return rows, spark.createDataFrame(rows, "seq long, t_us long, symbol string, bid double, ask double, bid_qty double, ask_qty double")


def plain_episodes(rows, fee_bps):
    """Runs of net > 0 by a plain loop: start, end, opened by, closed by, peak."""
    tob, run, out, cost = {}, None, [], math.log1p(-fee_bps / 1e4)
    for seq, t, s, bid, ask, *_ in sorted(rows, key=lambda r: (r[1], r[0])):
        tob[s] = (bid, ask)
        if len(tob) < 10:
            continue
        net = max(sum(math.log(tob[leg.symbol][0]) if leg.side == "SELL" else -math.log(tob[leg.symbol][1]) for leg in c) + len(c) * cost for c in graph.cycles())
        if net > 0:
            run = run or [t, s, net]
            run[2] = max(run[2], net)
        elif run:
            out.append((run[0], t, run[1], s, run[2]))
            run = None
    return out + ([(run[0], t, run[1], "(end of recording)", run[2])] if run else [])


@pytest.mark.parametrize("segment", [86_400_000_000, 3_000_000_000, 10**15])
def test_episodes_equal_a_plain_loop_whatever_the_segments(spark, segment):
    rows, quotes = quotes_table(spark, 1200)
    found = episodes.episodes(episodes.scenarios(screen.scored(quotes, segment), (2.0, 60.0)), ["scenario"]).collect()
    for place, fee in enumerate((2.0, 60.0)):
        want = plain_episodes(rows, fee)
        got = sorted((r.start_us, r.end_us, r.opened_by, r.closed_by, r.peak) for r in found if r.scenario == place)
        assert [g[:4] for g in got] == [w[:4] for w in want] and np.allclose([g[4] for g in got], [w[4] for w in want])
    assert any(r.scenario == 0 for r in found)


def test_time_shares_do_not_depend_on_segments(spark):
    rows, quotes = quotes_table(spark, 800)
    hurdles = [graph.hurdle_of(c, flat_fees(2.0)) for c in graph.cycles()]
    a, b = ({r.cycle_id: r for r in screen.time_shares(quotes, hurdles, 5e-4, s).collect()} for s in (86_400_000_000, 2_000_000_000))
    assert a.keys() == b.keys() == set(range(74))
    assert all((a[i].above_us, a[i].near_us) == (b[i].above_us, b[i].near_us) and math.isclose(a[i].max_edge, b[i].max_edge) for i in a)
    first = max(min(r[1] for r in rows if r[2] == s) for s in SYMBOLS)
    assert max(r.above_us for r in a.values()) <= max(r[1] for r in rows) - first


def test_streamed_episodes_equal_batch_ones_over_several_batches(spark, tmp_path):
    _, quotes = quotes_table(spark, 900, seed=4)
    parts = sorted(quotes.select("t_us").rdd.map(lambda r: r[0]).collect())
    cuts = [parts[0], parts[300], parts[600], parts[-1] + 1]
    (tmp_path / "in").mkdir()
    kinds = quotes.withColumn("recording", F.lit("x"))
    source = spark.readStream.schema(kinds.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = screening.episodes(source, 2.0).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check"))
    for low, high in zip(cuts, cuts[1:]):  # each part is a run of the stream of its own: the state outlives it
        kinds.where((F.col("t_us") >= low) & (F.col("t_us") < high)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    found = episodes.episodes(episodes.scenarios(screen.scored(quotes), (2.0,)), ["scenario"]).where("closed_by <> '(end of recording)'")
    columns = ["start_us", "end_us", "opened_by", "closed_by", "cycle_id"]
    got = spark.read.schema(screening.EPISODE).parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, found.select(columns).collect())) != []


def test_asof_ties_and_strictness(spark):
    series = spark.createDataFrame([("a", 5, 1, 1.0), ("a", 5, 2, 2.0), ("a", 9, 3, 3.0), ("b", 1, 4, 4.0)], "k string, t_us long, seq long, v double")
    probes = spark.createDataFrame([("a", 4, 1), ("a", 5, 2), ("a", 9, 3), ("a", 10**15, 4), ("b", 0, 5), ("c", 7, 6)], "k string, t_us long, id int")
    get = lambda strict: {r.id: r.v for r in ts.asof(probes, series, ["k"], ["v"], strict=strict).collect()}
    assert get(False) == {1: None, 2: 2.0, 3: 3.0, 4: 3.0, 5: None, 6: None}
    assert get(True) == {1: None, 2: None, 3: 2.0, 4: 3.0, 5: None, 6: None}


def test_trade_mids_and_times_of_archives(spark):
    trades = spark.createDataFrame([("x", 0, 1, 9.0, True), ("x", 100, 2, 11.0, False), ("x", 200, 3, 10.0, True), ("y", 0, 4, 9.0, True), ("y", 40000, 5, 11.0, False)],
                                   "k string, t_us long, seq long, price double, buyer_maker boolean")
    got = {(r.k, r.t_us): r.mid for r in ts.trade_mids(trades, 30_000, ["k"]).collect()}
    assert got == {("x", 100): 10.0, ("x", 200): 10.5}
    rows = spark.createDataFrame([(["1", "2", "3", "0", "0", t, b],) for t, b in (("1700000000000000", "True"), ("1700000000000", "false"))], "cells array<string>")
    assert [(r.t_ms, r.price, r.qty, r.buyer_maker) for r in captures.archive_trades(rows).collect()] == [(1700000000000, 2.0, 3.0, True), (1700000000000, 2.0, 3.0, False)]


def test_markouts_at_seconds(spark):
    """The horizons of real recordings: 20 ms before, 1, 10 and 60 s after."""
    quotes = spark.createDataFrame([("S", s * 500_000, s, 100.0 + s - 0.5, 100.0 + s + 0.5) for s in range(200)], "symbol string, t_us long, seq long, bid double, ask double")
    trades = spark.createDataFrame([("S", 1_010_000, 1, 100.0, 2.0, True), ("S", 45_000_000, 2, 100.0, 1.0, False), ("S", 10_000, 3, 1.0, 1.0, True)],
                                   "symbol string, t_us long, seq long, price double, qty double, buyer_maker boolean")
    got = markout.marked(trades, quotes, 20_000, (1_000_000, 10_000_000, 60_000_000)).collect()
    (r,) = got  # the second one's last horizon lies beyond the quotes, the third has no quote before it
    assert r.seq == 1 and np.allclose([r.m_0, r.m_1, r.m_2, r.m_3], [(m / 100 - 1) * 1e4 for m in (101, 104, 122, 222)])


def test_requotes_and_ranks_equal_plain_python(spark):
    rng = np.random.default_rng(2)
    rows = [(k, i * 20_000_000_000, i, float(100 * math.exp(rng.normal() * 4e-4))) for k in "ab" for i in range(400)]
    frame = spark.createDataFrame(rows, "k string, t_us long, seq long, v double")
    for r in ts.requotes(frame, 5.0, ["k"]).collect():
        values = [v for k, _, _, v in rows if k == r.k]
        level, n = values[0], 0
        for v in values:
            if abs(v / level - 1) * 1e4 >= 5:
                level, n = v, n + 1
        assert r.n == n and math.isclose(r.per_minute, n / (399 * 20_000_000_000 / 6e7))
    x = F.col("v")
    for r in frame.groupBy("k").agg(stats.at_share(x, 0.9).alias("a"), stats.at_ratio(x, 19, 20).alias("b"), stats.at_share(x, 1.0).alias("c")).collect():
        s = sorted(v for k, _, _, v in rows if k == r.k)
        assert (r.a, r.b, r.c) == (s[int(0.9 * 400)], s[400 * 19 // 20], s[-1])


def test_order_statistics_are_exact_for_many_values_and_ties(spark):
    rng = np.random.default_rng(6)
    values = {"many": rng.normal(size=60_000), "ties": np.concatenate([np.full(30_000, 1.0), rng.normal(1, 1e-3, 31_000)]), "few": rng.normal(size=7), "one": np.array([2.0])}
    frame = spark.createDataFrame([(k, float(v)) for k, x in values.items() for v in x] + [("many", None), ("none", None)], "k string, v double")
    picks = {"a": stats.share_pick(0.5), "b": stats.share_pick(0.999), "c": stats.ratio_pick(1, 20), "d": stats.share_pick(1.0), **stats.MIDDLE}
    got = {r.k: r for r in stats.order_statistics(frame, ["k"], "v", picks).collect()}
    assert got.keys() == values.keys()
    for k, x in values.items():
        s, n = np.sort(x), len(x)
        r = got[k]
        assert (r.n, r.a, r.b, r.c, r.d) == (n, s[n // 2], s[min(n - 1, int(0.999 * n))], s[n // 20], s[-1])
        assert (r.low + r.high) / 2 == np.median(x)


def test_recordings_stop_at_their_first_bad_line(spark, tmp_path):
    line = lambda t: '{"t":%d,"m":{"stream":"btcusdt@bookTicker","data":{"s":"BTCUSDT","b":"1.5","B":"2","a":"1.6","A":"3"}}}' % t
    whole = tmp_path / "a.jsonl.gz"
    whole.write_bytes(gzip.compress((line(1) + "\n").encode()) + gzip.compress((line(2) + "\n").encode()))  # two members
    (tmp_path / "b.jsonl").write_text("\n".join([line(3), line(4), '{"t":5,"m"', line(6)]))
    data = gzip.compress("".join(line(10 + i) + "\n" for i in range(20_000)).encode(), mtime=0)
    (tmp_path / "c.jsonl.gz").write_bytes(data[: len(data) // 2])
    got = captures.quotes_of(captures.read_recording(spark, str(tmp_path)))
    times = sorted(r.t for r in got.collect())
    assert times[:4] == [1, 2, 3, 4] and 6 not in times and 5 < times[4] and 4 < len(times) < 20_004
    r = got.where("t = 1").first()
    assert (r.symbol, r.bid, r.bid_qty, r.ask, r.ask_qty) == ("BTCUSDT", 1.5, 2.0, 1.6, 3.0)


def test_archives_lose_their_header_and_nothing_else(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(captures, "ROWS", 2)
    for name, lines in (("x", ["id,price", "1,2.5", "2,2.6", "3,2.7"]), ("y", ["7,1.0"]), ("z", [])):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr(f"{name}.csv", "\n".join(lines))
    got = {(r.file[-5:-4], r.nth): r.cells for r in captures.read_archive(spark, str(tmp_path)).collect()}
    assert got == {("x", 0): ["1", "2.5"], ("x", 1): ["2", "2.6"], ("x", 2): ["3", "2.7"], ("y", 0): ["7", "1.0"]}
    rows = spark.createDataFrame([("f", 0, ["1700000000000000", "", "", "", "5"]), ("f", 1, ["1700000000000", "", "", "", "6"])], "file string, nth long, cells array<string>")
    assert [(r.t_ms, r.close) for r in captures.archive_closes(rows).collect()] == [(1700000000000, 6.0)]


def test_ingest_goes_on_where_it_was(spark, tmp_path):
    line = lambda t: '{"t":%d,"m":{"stream":"x","data":{"s":"BTCUSDT","b":"1","B":"2","a":"3","A":"4"}}}' % t
    source, day = tmp_path / "in", 86_400 * 10**9
    source.mkdir()
    for part in range(3):
        (source / f"{part}.jsonl").write_text("\n".join([line(part * day + i) for i in range(5)] + ["cut off"]))
        ingest.ingest(spark, str(source), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    table = spark.read.parquet(str(tmp_path / "out"))
    assert table.count() == 15 and table.select("day").distinct().count() == 3


def test_depth_state_takes_the_first_level_whatever_its_quantity(spark):
    rows = [(i, i, s, 0, 10.0, 0.0, 11.0, 1.0) for i, s in enumerate(SYMBOLS)] + [(i, i, s, 1, 9.0, 2.0, 12.0, 1.0) for i, s in enumerate(SYMBOLS)]
    levels = spark.createDataFrame(rows, "seq long, t_us long, symbol string, lvl int, bid_px double, bid_qty double, ask_px double, ask_qty double")
    (r,) = depth.depth_state(depth.snapshots(levels)).collect()
    assert r.bid_BTCUSDT == 10.0 and [x.px for x in r.books[0].bids] == [10.0, 9.0]
