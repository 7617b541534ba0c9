"""Depth dealt out to cycles, against a plain loop over books of levels."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.model import ASSETS, LEGS, SYMBOLS, flat_fees
from millrace.operators import allocation, depth, graph
from millrace.plans import orders

BOOK = "array<struct<px:double,qty:double>>"
PRICES = (1.0, 1.0, 100.0, 5.0, 2.0)


def plain(books, fees, prices, least=0.0):
    """books: symbol -> (bids, asks) as lists of [px, qty], changed in place."""
    out = []
    while True:
        best = None
        for cycle_id, legs in enumerate(graph.cycles()):
            size = plain_size(books, legs, fees)
            profit = (size[1] - size[0]) * prices[ASSETS.index(legs[0].src)]
            if profit > (best[0] if best else least):
                best = (profit, cycle_id, *size)
        if best is None:
            return out
        profit, cycle_id, start_in, _, takes = best
        out.append((cycle_id, start_in, profit, [sum(q for _, q in take) for take in takes]))
        for leg, take in zip(graph.cycles()[cycle_id], takes):
            side = books[leg.symbol][leg.side == "BUY"]
            for level, (_, q) in zip(list(side), take):
                level[1] -= q
                if level[1] <= 1e-11:
                    side.remove(level)


def plain_size(books, legs, fees):
    """start_in, start_out, and for each leg the (px, base quantity) taken of each of its levels."""
    sides = [[list(x) for x in books[leg.symbol][leg.side == "BUY"]] for leg in legs]
    at, takes = [0] * len(legs), [[] for _ in legs]
    start_in = start_out = 0.0
    while all(i < len(side) for i, side in zip(at, sides)):
        into, step = 1.0, float("inf")
        entering = []
        for leg, i, side in zip(legs, at, sides):
            px, qty = side[i]
            entering.append(into)
            step = min(step, (qty if leg.side == "SELL" else px * qty) / into)
            into *= (px if leg.side == "SELL" else 1 / px) * (1 - fees[leg.symbol])
        if into <= 1:
            break
        start_in, start_out = start_in + step, start_out + step * into
        for k, (leg, before) in enumerate(zip(legs, entering)):
            px, qty = sides[k][at[k]]
            base = step * before / (1 if leg.side == "SELL" else px)
            if len(takes[k]) == at[k]:
                takes[k].append((px, 0.0))
            takes[k][at[k]] = (px, takes[k][at[k]][1] + base)
            sides[k][at[k]][1] = qty - base
            if sides[k][at[k]][1] <= qty * 1e-12:
                at[k] += 1
    return start_in, start_out, takes


def frame(spark, snapshots):
    rows = [(i, [tuple([tuple(x) for x in side] for side in books[s]) for s in SYMBOLS], list(PRICES)) for i, books in enumerate(snapshots)]
    return spark.createDataFrame(rows, f"seq int, books array<struct<bids:{BOOK},asks:{BOOK}>>, prices array<double>")


def random_books(rng):
    out = {}
    for symbol, (base, quote) in SYMBOLS.items():
        mid = PRICES[ASSETS.index(base)] / PRICES[ASSETS.index(quote)] * (1 + rng.uniform(-4e-3, 4e-3))
        side = lambda sign: [[mid * (1 + sign * 1e-3 * (i + rng.random())), rng.uniform(1, 50)] for i in range(rng.randint(0 if rng.random() < 0.1 else 1, 5))]  # noqa: E731, B023
        out[symbol] = (side(-1), side(1))
    return out


def test_equals_a_plain_loop(spark):
    rng = random.Random(11)
    snapshots = [random_books(rng) for _ in range(60)]
    fees = flat_fees(2.0)
    got = {}
    for r in allocation.allocated(frame(spark, snapshots).repartition(3), ["seq"], fees).orderBy("seq", "place").collect():
        got.setdefault(r.seq, []).append((r.place, r.cycle_id, r.start_in, r.profit_usdt, r.base_qty))
    several = 0
    for i, books in enumerate(snapshots):
        want = plain(books, fees, PRICES)
        mine = got.get(i, [])
        assert [(m[0], m[1]) for m in mine] == [(k, w[0]) for k, w in enumerate(want, 1)]
        for m, w in zip(mine, want):
            assert m[2:4] == pytest.approx(w[1:3], rel=1e-7) and m[4] == pytest.approx(w[3], rel=1e-7)
        several += len(want) > 2
    assert several > 20


def test_no_depth_no_price_no_rows(spark):
    empty = {s: ([], []) for s in SYMBOLS}
    bad = {s: ([[0.0, 5.0], [1.0, 0.0]], [[0.0, 1.0]]) for s in SYMBOLS}
    rich = random_books(random.Random(11))
    fees = flat_fees(0.0)
    rows = frame(spark, [empty, bad])
    assert allocation.allocated(rows, ["seq"], fees).count() == 0
    assert allocation.allocated(rows.limit(0), ["seq"], fees).count() == 0
    unpriced = frame(spark, [rich]).withColumn("prices", F.expr("transform(prices, p -> cast(null as double))"))
    assert allocation.allocated(unpriced, ["seq"], fees).count() == 0
    assert allocation.allocated(frame(spark, [rich]), ["seq"], fees, least=1e9).count() == 0


def test_opposite_legs_are_set_off(spark):
    found = spark.createDataFrame([(1, [2.0, 3.0]), (1, [5.0, 1.0]), (2, [4.0, 4.0])], "seq int, base_qty array<double>")
    legs = [LEGS["USDT", "BTC"], LEGS["BTC", "ETH"]], [LEGS["BTC", "USDT"], LEGS["USDT", "ETH"]]
    struct = lambda leg: F.struct(F.lit(leg.symbol).alias("symbol"), F.lit(leg.side).alias("side"))
    of = F.when(F.element_at("base_qty", 1) == 5.0, F.array(*map(struct, legs[1]))).otherwise(F.array(*map(struct, legs[0])))
    got = {(r.seq, r.symbol): (r.sold, r.bought, r.net) for r in allocation.netted(found, ["seq"], of).collect()}
    assert got[1, "BTCUSDT"] == (5.0, 2.0, 3.0) and got[1, "ETHBTC"] == (0.0, 3.0, -3.0) and got[1, "ETHUSDT"] == (0.0, 1.0, -1.0)
    assert got[2, "BTCUSDT"] == (0.0, 4.0, -4.0)


def test_query_equals_a_plain_loop(spark):
    """The registered query over the smallest tables: depth comes from them, allocations from the plain loop."""
    sf = "/root/testdata/sf0.001"
    state = orders._state(spark, sf).select("seq", "books", depth.asset_prices().alias("prices")).orderBy("seq").limit(400).collect()
    got = {}
    for r in orders.allocate_cycles(spark, sf).where(F.col("seq") <= state[-1].seq).orderBy("seq", "place").collect():
        got.setdefault(r.seq, []).append((r.cycle_id, r.start_in, r.profit_usdt))
    assert got
    for r in state:
        books = {s: ([[x.px, x.qty] for x in b.bids], [[x.px, x.qty] for x in b.asks]) for s, b in zip(SYMBOLS, r.books)}
        want = [w[1:3] for w in plain(books, orders.SCHEDULED["schedule"], r.prices, 0.0)]
        mine = [m[1:] for m in got.get(r.seq, [])]
        assert sum(m[1] for m in mine) == pytest.approx(sum(w[1] for w in want), rel=1e-6, abs=1e-5)
