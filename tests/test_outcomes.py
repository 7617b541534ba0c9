"""Sized cycles followed through later books in one fold, against lookups of whole books."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.model import HOUR, SYMBOLS, flat_fees
from millrace.operators import depth, fill_model, outcomes, shadow, sizing
from millrace.plans import orders

SF = "/root/testdata/sf0.001"
PRICES = {"USDT": 1.0, "USDC": 1.0, "BTC": 100.0, "ETH": 5.0, "BNB": 2.0}
FEES, PACKET = flat_fees(2.0), 300.0
#: The first ends at the time of another update, the last is as long as a segment may be.
DELAYS = (HOUR * 2 // 3, HOUR + 1, 5 * HOUR)
COLUMNS = ("seq", "cycle_id", "delay", "age_us", "stale_us", "n_legs", "profit_usdt", "margin", "filled", "pnl_usdt")


@pytest.fixture(scope="module")
def levels(spark):
    """Books of one to five levels, some without a quantity, three to an hour and two at a time, quiet for two days, out of order."""
    draw, rows, names = random.Random(4), [], list(SYMBOLS)
    for seq in range(300):
        symbol = draw.choice(names) if seq >= 10 else names[seq]
        base, quote = SYMBOLS[symbol]
        mid = PRICES[base] / PRICES[quote] * (1 + draw.uniform(-4e-3, 4e-3))
        for lvl in range(draw.randrange(1, 6)):
            side = [x for sign in (-1, 1) for x in (mid * (1 + sign * 1e-3 * (lvl + draw.random())), draw.choice((0.0, *[draw.uniform(1, 50)] * 6)))]
            rows.append((seq, seq // 2 * HOUR * 2 // 3 + (seq > 200) * 48 * HOUR, symbol, lvl, *side))
    draw.shuffle(rows)
    return spark.createDataFrame(rows, "seq long, t_us long, symbol string, lvl int, bid_px double, bid_qty double, ask_px double, ask_qty double").repartition(3).cache()


def bag(df):
    plain = lambda v: None if v is None or v != v else float(f"{v:.7g}") if isinstance(v, float) else v
    return sorted((tuple(map(plain, r)) for r in df.select(*COLUMNS).collect()), key=repr)


def looked_up(levels):
    """The same by the operators over whole books."""
    books = depth.snapshots(levels).cache()
    state = depth.depth_state(books, stamped=True)
    more = {"t_us": F.col("t_us"), "prices": depth.asset_prices(), "book_us": F.transform("books", lambda b: b["t_us"])}
    rows = depth.survivors(state, {"a": FEES}, more).where("cycle_id is not null")
    of = F.element_at(depth.leg_assets(), F.col("cycle_id") + 1)
    rows = rows.withColumns({"most": PACKET / F.col("start_px"), "of": of, "n_legs": F.size(of)}).cache()
    oldest = F.array_min(F.transform("of", lambda leg: F.element_at(F.col("book_us"), leg["number"] + 1)))
    before = fill_model.previous(levels.select("seq", "t_us").distinct()).select("seq", "prev_seq")
    ages = fill_model.aged(rows.select("seq", "t_us", "cycle_id").join(before, "seq")).select("seq", "cycle_id", "age_us")
    rows = rows.withColumn("stale_us", F.col("t_us") - oldest).join(ages, ["seq", "cycle_id"])
    keys = ["seq", "cycle_id", "age_us", "stale_us", "n_legs"]
    found = sizing.size_cycles(rows, [*keys, "t_us", "prices", "of", "start_px"], most="most").where("start_in > 0")
    found = found.withColumns({"profit_usdt": F.col("profit") * F.col("start_px"), "margin": F.col("profit") / F.col("start_in") * 1e4})
    price = lambda at: F.element_at(F.col("prices"), at + 1)
    legs = F.transform("of", lambda leg, i: F.struct(
        leg["symbol"].alias("symbol"), leg["side"].alias("side"), F.element_at(depth.fee_array(FEES), leg["number"] + 1).alias("fee"), price(leg["src"]).alias("src_px"),
        price(leg["dst"]).alias("dst_px"), F.get("leg_base_qty", i).alias("base_qty"), F.get("limit_px", i).alias("limit_px"),
    ))
    keys += ["profit_usdt", "margin"]
    return shadow.scores(found.select(*keys, "t_us", legs.alias("legs")), keys, books, DELAYS)


def test_outcomes_equal_lookups_of_whole_books(spark, levels):
    want = bag(looked_up(levels))
    assert len(want) > 1000 and {r[8] for r in want} == {True, False} and max(r[3] for r in want) > 10 * HOUR
    for segment, batch in ((None, 10_000), (5 * HOUR, 7), (1000 * HOUR, 20)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
        found = outcomes.followed(levels, FEES, PACKET, DELAYS, segment).cache()
        assert bag(outcomes.scored(found, outcomes.entries(found), DELAYS)) == want, (segment, batch)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_runs_go_over_segments(spark):
    """Cycle 1 goes on over two ends, 2 starts again after a gap, 3 isn't above its hurdle at the end of a segment."""
    ends = [
        (0, 1, 5, False), (1, 1, 10, True), (2, 1, 20, True), (3, 1, None, False), (4, 1, 40, True),
        (0, 2, 0, True), (1, 2, 15, False), (2, 2, 20, True), (3, 2, 31, False), (4, 2, 40, True),
        (0, 3, None, False), (1, 3, 10, True), (2, 3, 20, True), (3, 3, 30, True), (4, 3, None, False),
    ]
    rows = spark.createDataFrame(ends, "_seg long, cycle_id int, since_us long, opened boolean").withColumn("seq", F.lit(None).cast("long"))
    got = {(r["_seg"], r.cycle_id): r.entry_us for r in outcomes.entries(rows).collect()}
    assert got == {(1, 1): 5, (2, 1): 5, (3, 1): 5, (1, 2): 0, (2, 2): 15, (3, 2): 15, (4, 2): 31, (2, 3): 10, (3, 3): 10, (4, 3): 10}


def test_fills_of_literal_orders():
    sell, base, limit = np.array([True, True, False, False]), np.array([2.0, 5.0, 2.0, 2.0]), np.array([9.9, 9.9, 10.3, 10.2])
    bids, asks = ([10.0, 9.9, 9.8], [1.0, 2.0, 4.0]), ([10.1, 10.2, 10.3], [1.0, 0.0, 3.0])
    px, qty = (np.array([bids[k], bids[k], asks[k], asks[k]]) for k in (0, 1))
    got, quote = outcomes.fills(sell, base, limit, px, qty)
    assert got == pytest.approx([2.0, 3.0, 2.0, 1.0]) and quote == pytest.approx([19.9, 29.8, 20.4, 10.1])


def test_levels_without_a_place_and_none_at_all(spark, levels):
    odd = levels.limit(2).withColumn("t_us", F.lit(None).cast("long")).unionByName(levels.limit(2).withColumn("seq", F.lit(None).cast("long")))
    rows = lambda df: bag(outcomes.scored(found := outcomes.followed(df, FEES, PACKET, DELAYS), outcomes.entries(found), DELAYS))
    assert rows(levels.unionByName(odd)) == rows(levels) and rows(levels.limit(0)) == []
    with pytest.raises(ValueError):
        outcomes.followed(levels, FEES, PACKET, DELAYS, HOUR)


@pytest.mark.parametrize("name", ["expected_values", "fill_calibration"])
def test_no_row_carries_books(spark, monkeypatch, name):
    """Ten books went with each update, and each cycle's legs and levels through joins and twice into the shared folder."""
    plans, keep = [], orders.stored
    monkeypatch.setattr(orders, "stored", lambda df, what: plans.append((what, df)) or keep(df, what))
    assert orders.QUERIES[name](spark, SF).count()
    for what, df in plans:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "book_BTCUSDT" not in plan and "collect_list" not in plan and "levels" not in plan, what
        assert not any("array" in kind or "struct" in kind for _, kind in df.dtypes), what
    assert plans
