"""Depth books carried along in Arrow batches, against the column operators over whole books."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.model import ASSETS, HOUR, SYMBOLS, flat_fees
from millrace.operators import allocation, depth, depth_fold, graph, lots, sizing
from millrace.plans import depth as depth_plans
from millrace.plans import orders

SF = "/root/testdata/sf0.001"
PRICES = {"USDT": 1.0, "USDC": 1.0, "BTC": 100.0, "ETH": 5.0, "BNB": 2.0}
FEES = flat_fees(2.0)


@pytest.fixture(scope="module")
def levels(spark):
    """Books of one to five levels, some without a quantity, three to an hour, out of order and over several days."""
    draw, rows, names = random.Random(3), [], list(SYMBOLS)
    for seq in range(400):
        symbol = draw.choice(names) if seq >= 10 else names[seq]
        base, quote = SYMBOLS[symbol]
        mid = PRICES[base] / PRICES[quote] * (1 + draw.uniform(-4e-3, 4e-3))
        for lvl in range(draw.randrange(1, 6)):
            side = [x for sign in (-1, 1) for x in (mid * (1 + sign * 1e-3 * (lvl + draw.random())), draw.choice((0.0, *[draw.uniform(1, 50)] * 6)))]
            rows.append((seq, seq // 2 * HOUR * 2 // 3, symbol, lvl, *side))
    draw.shuffle(rows)
    return spark.createDataFrame(rows, "seq long, t_us long, symbol string, lvl int, bid_px double, bid_qty double, ask_px double, ask_qty double").repartition(3).cache()


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def bag(df):
    plain = lambda v: tuple(map(plain, v)) if isinstance(v, (list, tuple)) else None if v is None or v != v else float(f"{v:.7g}") if isinstance(v, float) else v
    return sorted((plain(r) for r in df.collect()), key=repr)


def test_sizes_equal_those_of_whole_books(spark, levels, small_batches):
    state = depth.depth_state(depth.snapshots(levels))
    scenarios = {"a": FEES, "b": flat_fees(8.0)}
    found = depth.sized(depth.survivors(state, {"a": FEES}).where("cycle_id is not null"), 300.0)
    leg = lambda c, i: F.round(F.get(c, F.lit(i)), 6)
    want = found.select(
        "seq", "cycle_id", *(F.round(c, 6) for c in ("start_in", "start_out", "profit_usdt", "size_usdt")),
        *(leg(c, i) for c in ("leg_base_qty", "limit_px") for i in range(5)),
    )
    got = bag(depth_fold.size_cycles(levels, FEES, 300.0))
    assert got == bag(want) and len(got) > 500
    whole = depth.hits(depth.sized(depth.survivors(state, scenarios)), graph.cycle_table(spark).select("cycle_id", "path"))
    got = bag(depth_fold.hits(levels, scenarios))
    assert got == bag(whole) and any(r[2] is None for r in got) and sum(r[2] is not None for r in got) > 200


def test_allocations_equal_those_of_whole_books(spark, levels, small_batches):
    state = depth.depth_state(depth.snapshots(levels)).select("seq", "books", depth.asset_prices().alias("prices"))
    got = bag(depth_fold.allocated(levels, FEES))
    assert got == bag(allocation.allocated(state, ["seq"], FEES)) and len(got) > 300


def test_lots_equal_those_of_column_folds(spark, levels, small_batches):
    held = {"USDT": 60.0, "USDC": 90.0, "BTC": 0.5, "ETH": 9.0, "BNB": 20.0}
    by = {s: lots.Lot({"BTC": 1e-2, "ETH": 0.1, "BNB": 0.1, "USDC": 1.0}[b], {"USDT": 9.0, "USDC": 9.0, "BTC": 0.1, "ETH": 2.0}[q]) for s, (b, q) in SYMBOLS.items()}
    state = depth.depth_state(depth.snapshots(levels))
    rows = depth.survivors(state, {"a": FEES}, {"prices": depth.asset_prices()}).where("cycle_id is not null")
    rows = rows.withColumn("of", F.element_at(depth.leg_assets(), F.col("cycle_id") + 1)).withColumn("most", 300.0 / F.col("start_px"))
    have = F.array(*(F.lit(held[a]) for a in ASSETS))
    whole = F.zip_with("legs", "of", lambda leg, of: F.struct(
        leg["side"].alias("side"), lots.within(leg["levels"], F.element_at(have, of["src"] + 1)).alias("levels"),
        F.element_at(lots.lot_array(by, list(SYMBOLS)), of["number"] + 1).alias("lot"),
    ))
    found = sizing.size_cycles(rows.withColumn("whole", whole), ["seq", "cycle_id", "whole"], "whole", "most")
    found = found.withColumn("o", lots.whole_lots(F.col("whole"), F.col("start_in")))
    want = found.select("seq", "cycle_id", *(F.round(c, 6) for c in (F.col("start_in"), F.col("o.used")[0], F.col("o.out"))), *(F.round(F.get("o.base_qty", F.lit(i)), 6) for i in range(5)))
    mine = depth_fold.size_lots(levels, FEES, 300.0, held, by)
    assert bag(mine.select("seq", "cycle_id", "planned", "used", "out", *(f"base_qty_{i + 1}" for i in range(5)))) == bag(want)
    verdicts = {(r.seq, r.cycle_id): r.verdict != "lot" for r in mine.collect()}
    assert verdicts == {(r.seq, r.cycle_id): r.w for r in found.select("seq", "cycle_id", F.col("o.whole").alias("w")).collect()} and len(set(verdicts.values())) == 2


def test_many_allocations_at_once_take_the_first_of_equals():
    px, qty = np.ones((3, 20, 2)), np.full((3, 20, 2), 1e3)
    px[1:, 0::2] = 1.01
    found = allocation.greedy(px, qty, np.full((3, 20), 2), np.zeros(10), np.ones((3, 5)), 0.0)
    assert 0 not in found.row and set(found.row) == {1, 2}
    assert (found.cycle_id[found.row == 1] == found.cycle_id[found.row == 2]).all()


@pytest.mark.parametrize("name", ["size_lots", "size_cycles", "allocate_cycles", "allocate_orders"])
def test_no_row_carries_books(spark, name):
    """Ten books went with each update, and each cycle's legs twice, through shuffles, windows and into Python."""
    queries = orders.QUERIES if name in orders.QUERIES else depth_plans.QUERIES
    plan = queries[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "book_BTCUSDT" not in plan and "collect_list" not in plan and "levels" not in plan


def test_hits_carry_no_books(spark, monkeypatch):
    plans = []
    keep = depth_plans.stored
    monkeypatch.setattr(depth_plans, "stored", lambda df, what: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df, what))
    assert depth_plans.depth_hits(spark, SF).count()
    assert plans and not any("book_BTCUSDT" in p or "collect_list" in p for p in plans)
