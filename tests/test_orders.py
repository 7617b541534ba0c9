"""Whole lots and balances on literal and random legs, and shadow fills on literal books."""

import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import lots, shadow

LEGS = (
    "array<struct<side:string,levels:array<struct<cap:double,rate:double,px:double>>,"
    "lot:struct<step:double,least:double,most:double>>>"
)
BOOK = "array<struct<px:double,qty:double>>"


def sell(fee, *levels):
    return [(qty, px * (1 - fee), px) for px, qty in levels]


def buy(fee, *levels):
    return [(px * qty, (1 - fee) / px, px) for px, qty in levels]


def sized(spark, cases):
    frame = spark.createDataFrame(cases, f"k int, legs {LEGS}, amount double")
    return {r.k: r.o for r in frame.select("k", lots.whole_lots(F.col("legs"), F.col("amount")).alias("o")).collect()}


def test_lots_of_literal_legs(spark):
    def legs(step=0.3, least=0.0, most=math.inf):
        return [
            ("BUY", buy(0, (100.0, 1.0), (101.0, 1.0)), (step, least, most)),
            ("BUY", buy(0, (0.05, 10.0)), (4.0, 0.0, math.inf)),
            ("SELL", sell(0, (5.1, 100.0)), (1.0, 0.0, math.inf)),
        ]

    got = sized(spark, [
        (1, legs(), 50.0), (2, legs(least=31.0), 50.0), (3, legs(step=1.0), 50.0), (4, legs(most=0.2), 50.0),
        (5, legs(step=0.5), 50.0), (6, legs(), 0.0), (7, legs(step=0.75), 1000.0),
    ])
    assert got[1].whole and got[1].used == pytest.approx([30.0, 0.2, 4.0]) and got[1].rest == pytest.approx([20.0, 0.1, 0.0])
    assert got[1].base_qty == pytest.approx([0.3, 4.0, 4.0]) and got[1].limit_px == pytest.approx([100.0, 0.05, 5.1])
    assert got[1].out == pytest.approx(20.4)
    assert [got[k].whole for k in (2, 3, 4, 6)] == [False] * 4
    assert got[5].base_qty[0] == 0.5 and got[5].rest[0] == 0.0  # 0.5 is a whole step although 50 / 100 is cut off
    # beyond the depth: two levels give 2, so 1.5 in steps, spent over both; the second leg takes what its level has
    assert got[7].used[0] == pytest.approx(100 + 0.5 * 101) and got[7].rest[0] == pytest.approx(1000 - 150.5)
    assert got[7].base_qty[1] == pytest.approx(8.0) and got[7].rest[1] == pytest.approx(1.5 - 0.4) and got[7].limit_px[0] == 101.0


def plain(legs, amount):
    """Order by order, level by level."""
    whole, used_all, base_all, rest_all = True, [], [], []
    for side, levels, (step, least, most) in legs:
        left, power = amount, 0.0
        for cap, _, px in levels:
            part = min(cap, left)
            left -= part
            power += part if side == "SELL" else part / px
        base = math.floor(power / step + 1e-9) * step
        left, quote, out = base, 0.0, 0.0
        for cap, rate, px in levels:
            part = min(cap if side == "SELL" else cap / px, left)
            left -= part
            quote += part * px
            out += part * (rate if side == "SELL" else rate * px)
        used = base if side == "SELL" else quote
        whole = whole and base > 0 and least <= quote and base <= most
        used_all.append(used), base_all.append(base), rest_all.append(amount - used)
        amount = out
    return amount, whole, used_all, base_all, rest_all


def test_lots_of_random_legs(spark):
    rng = random.Random(5)
    cases = []
    for k in range(300):
        legs = []
        for _ in range(rng.randint(3, 5)):
            side, px, fee = rng.choice(["SELL", "BUY"]), rng.uniform(0.5, 2.0), rng.choice([0.0, 1e-3])
            quotes = [(px * (1 + (-1 if side == "SELL" else 1) * i * 1e-2), float(rng.randint(1, 20))) for i in range(rng.randint(0, 6))]
            legs.append((side, (sell if side == "SELL" else buy)(fee, *quotes), (rng.choice([0.1, 0.37, 1.0, 3.0]), rng.choice([0.0, 2.0]), rng.choice([math.inf, 15.0]))))
        cases.append((k, legs, rng.uniform(0, 40)))
    got, verdicts = sized(spark, cases), set()
    for k, legs, amount in cases:
        out, whole, used, base, rest = plain(legs, amount)
        verdicts.add(whole)
        assert got[k].whole == whole and got[k].out == pytest.approx(out)
        assert got[k].used == pytest.approx(used) and got[k].base_qty == pytest.approx(base) and got[k].rest == pytest.approx(rest)
        for spent, stays, step_of in zip(got[k].used, got[k].rest, legs):
            assert stays >= -1e-7 and spent >= 0
    assert verdicts == {True, False}


def test_balances_cut_levels(spark):
    levels = "array<struct<cap:double,rate:double,px:double>>"
    rows = [(1, [(5.0, 2.0, 2.0), (7.0, 1.5, 1.5), (1.0, 1.0, 1.0)], h) for h in (20.0, 12.5, 12.0, 5.0, 2.0, 0.0)] + [(2, [], 3.0)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, k int, l {levels}, held double")
    got = [[x.cap for x in r.w] for r in frame.select("i", lots.within(F.col("l"), F.col("held")).alias("w")).orderBy("i").collect()]
    assert got == [[5.0, 7.0, 1.0], [5.0, 7.0, 0.5], [5.0, 7.0], [5.0], [2.0], [], []]


def test_leg_fills_at_its_limit(spark):
    bids, asks = [(10.0, 1.0), (9.9, 2.0), (9.8, 4.0)], [(10.1, 1.0), (10.2, 0.0), (10.3, 3.0)]
    rows = [
        (1, "SELL", 2.0, 9.9, bids, asks), (2, "SELL", 5.0, 9.9, bids, asks), (3, "SELL", 1.0, 10.5, bids, asks),
        (4, "BUY", 2.0, 10.3, bids, asks), (5, "BUY", 2.0, 10.2, bids, asks), (6, "BUY", 2.0, 10.0, bids, asks), (7, "BUY", 2.0, 10.3, None, None),
    ]
    frame = spark.createDataFrame(rows, f"k int, side string, base_qty double, limit_px double, bids {BOOK}, asks {BOOK}")
    fill = shadow.leg_fill(F.struct("side", "base_qty", "limit_px"), F.col("bids"), F.col("asks"))
    got = {r.k: (r.f.filled, r.f.quote) for r in frame.select("k", fill.alias("f")).collect()}
    want = {1: (2.0, 19.9), 2: (3.0, 29.8), 3: (0.0, 0.0), 4: (2.0, 20.4), 5: (1.0, 10.1), 6: (0.0, 0.0), 7: (0.0, 0.0)}
    assert {k: pytest.approx(v) for k, v in want.items()} == got


def test_scores_look_later_books_up(spark):
    """Two legs sell and buy back one unit; books change at 20 and 50, and the recording ends at 60."""
    leg = "struct<symbol:string,side:string,fee:double,src_px:double,dst_px:double,base_qty:double,limit_px:double>"
    legs = [("A", "SELL", 0.0, 10.0, 1.0, 2.0, 10.0), ("B", "BUY", 0.0, 1.0, 10.0, 2.0, 9.0)]
    found = spark.createDataFrame([(1, 10, legs)], f"seq int, t_us long, legs array<{leg}>")
    books = spark.createDataFrame(
        [
            (1, 5, "A", [(10.0, 2.0)], []), (2, 5, "B", [], [(9.0, 2.0)]), (3, 20, "A", [(10.0, 1.0)], []),
            (4, 50, "B", [], [(9.5, 9.0)]), (5, 60, "C", [], []),
        ],
        f"seq long, t_us long, symbol string, bids {BOOK}, asks {BOOK}",
    )
    want = {1: (True, 1.0, 2.0), 10: (False, 0.75, 2.0), 39: (False, 0.75, 2.0), 40: (False, 0.25, 0.0), 50: (False, 0.25, 0.0)}
    for segment, most in ((7, None), (1000, None), (30, 2)):
        rows = shadow.scores(found, ["seq"], books, [1, 10, 39, 40, 50, 51], segment, most).collect()
        assert {r.delay: pytest.approx((r.filled, r.fill_share, r.pnl_usdt)) for r in rows} == want, (segment, most)
