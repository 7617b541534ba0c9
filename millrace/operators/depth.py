"""Depth books carried along: screening cycles at the touch, sizing the survivors, routing amounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.model import ASSETS, DAY, SYMBOLS, Leg
from millrace.operators import graph, sizing
from millrace.operators.timeseries import asof, book_state, grid

_NUMBER = {s: i for i, s in enumerate(SYMBOLS)}


def snapshots(levels: DataFrame) -> DataFrame:
    """seq, t_us, symbol, bids, asks (arrays of struct(px, qty), best first) of rows with one level each: lvl, bid_px,
    bid_qty, ask_px, ask_qty. A snapshot has a few tens of levels."""
    side = lambda s: F.struct("lvl", F.col(f"{s}_px").alias("px"), F.col(f"{s}_qty").alias("qty"))
    rows = levels.groupBy("seq", "t_us", "symbol").agg(F.array_sort(F.collect_list(F.struct(side("bid"), side("ask")))).alias("l"))
    pick = lambda k: F.transform("l", lambda x: F.struct(x[k]["px"].alias("px"), x[k]["qty"].alias("qty")))
    return rows.select("seq", "t_us", "symbol", pick("col1").alias("bids"), pick("col2").alias("asks"))


def depth_state(books: DataFrame, segment: int = DAY, stamped: bool = False) -> DataFrame:
    """Every snapshot once all symbols have been seen: seq, t_us, symbol, books (array by symbol number of struct(bids,
    asks), stamped: with the book's own t_us) and the wide touch (bid_<symbol>, ask_<symbol>: the first level's prices,
    whatever its quantity)."""
    rows = books.select("seq", "t_us", "symbol", F.struct("bids", "asks", *(["t_us"] if stamped else [])).alias("book"))
    state = book_state(rows, list(SYMBOLS), ("book",), segment)
    touch = {f"{c[:3]}_{s}": F.col(f"book_{s}")[c][0]["px"] for s in SYMBOLS for c in ("bids", "asks")}
    return state.select("seq", "t_us", "symbol", F.array(*(f"book_{s}" for s in SYMBOLS)).alias("books"), *(c.alias(n) for n, c in touch.items()))


def sampled(books: DataFrame, step: int) -> DataFrame:
    """t_us, books (array by symbol number of struct(bids, asks)): all symbols' books before each point of a grid that
    starts where the last symbol is first seen; that point itself has no row. Of each symbol only the last book of each
    step is looked up, and no row but a point's holds more than one book."""
    known = books.where(F.col("symbol").isin(*SYMBOLS))
    seen = known.groupBy("symbol").agg(F.min("t_us").alias("first"), F.max("t_us").alias("last"))
    bounds = seen.agg(F.max("first").alias("t0"), F.max("last").alias("t1"), F.count(F.lit(1)).alias("n")).where(F.col("n") == len(SYMBOLS)).drop("n")
    # What a point sees is the last book of a step: steps begin at points, so one book for each step is sent along.
    slot = F.when(F.col("t_us") < F.col("t0"), F.lit(-1)).otherwise(F.expr(f"(t_us - t0) div {step}")).alias("_slot")
    last = known.crossJoin(F.broadcast(bounds)).groupBy("symbol", slot).agg(
        F.max_by(F.struct("t_us", "seq", F.struct("bids", "asks").alias("book")), F.struct("t_us", "seq")).alias("l")
    ).select("symbol", "l.*")
    points = grid(bounds, step).where(F.col("t_us").isNotNull()).withColumn("symbol", F.explode(F.array(*map(F.lit, SYMBOLS))))
    found = asof(points.withColumn("point", F.col("t_us")), last, ["symbol"], ["book"], strict=True).where(F.col("book").isNotNull())
    rows = found.groupBy(F.col("point").alias("t_us")).agg(*(F.first(F.when(F.col("symbol") == s, F.col("book")), True).alias(f"_{s}") for s in SYMBOLS))
    complete = rows.where(" and ".join(f"_{s} is not null" for s in SYMBOLS))
    return complete.select("t_us", F.array(*(f"_{s}" for s in SYMBOLS)).alias("books"))


def _literal(legs: tuple[Leg, ...]) -> Column:
    return F.array(*(F.struct(F.lit(_NUMBER[leg.symbol]).alias("number"), F.lit(leg.side).alias("side")) for leg in legs))


def with_levels(legs: Column, books: Column, fees: Column) -> Column:
    """array of struct(side, levels) of legs (array of struct(number, side)) in books (by symbol number), after fees."""

    def one(leg: Column) -> Column:
        book = F.element_at(books, leg["number"] + 1)
        return F.struct(
            leg["side"].alias("side"),
            sizing.leg_levels(leg["side"], book["bids"], book["asks"], F.element_at(fees, leg["number"] + 1)).alias("levels"),
        )

    return F.transform(legs, one)


def fee_array(fees: dict[str, float]) -> Column:
    return F.array(*(F.lit(fees[s]) for s in SYMBOLS))


def asset_prices() -> Column:
    """USDT for a unit of each asset, by its number, over a wide book state."""
    return F.array(*map(graph.usdt_price, ASSETS))


def leg_assets() -> Column:
    """By cycle: array of struct(symbol, number, side, src, dst) of its legs; src and dst are numbers of assets."""
    one = lambda leg: F.struct(
        F.lit(leg.symbol).alias("symbol"), F.lit(_NUMBER[leg.symbol]).alias("number"), F.lit(leg.side).alias("side"),
        F.lit(ASSETS.index(leg.src)).alias("src"), F.lit(ASSETS.index(leg.dst)).alias("dst"),
    )
    return F.array(*(F.array(*map(one, c)) for c in graph.cycles()))


def survivors(state: DataFrame, scenarios: dict[str, dict[str, float]], more: dict[str, Column] | None = None) -> DataFrame:
    """seq, scenario, cycle_id, legs, start_px (USDT for a unit of the start asset) of the cycles whose gross edge is
    above their hurdle; a row with a null cycle_id for snapshots without any. more: further columns over the state."""
    cycles = graph.cycles()
    hurdle = lambda fees: F.array(*(F.lit(graph.hurdle_of(c, fees)) for c in cycles))
    each = F.array(
        *(
            F.struct(F.lit(name).alias("scenario"), hurdle(fees).alias("hurdles"), fee_array(fees).alias("fees"))
            for name, fees in scenarios.items()
        )
    )
    also = {f"_{n}": c for n, c in (more or {}).items()}
    touch = [f"{c}_{s}" for s in SYMBOLS for c in ("bid", "ask")]
    scored = graph.edges(state.withColumns(also) if also else state, ["seq", "books", *touch, *also])
    rows = scored.withColumn("s", F.explode(each))
    above = F.filter(
        F.sequence(F.lit(1), F.lit(len(cycles))),
        lambda i: F.element_at("edges", i) > F.element_at(F.col("s.hurdles"), i),
    )
    rows = rows.withColumn("place", F.explode_outer(above))
    legs = F.element_at(F.array(*map(_literal, cycles)), F.col("place"))
    starts = F.array(*(graph.usdt_price(c[0].src) for c in cycles))
    return rows.select(
        "seq", "s.scenario", (F.col("place") - 1).alias("cycle_id"),
        F.when(F.col("place").isNotNull(), with_levels(legs, F.col("books"), F.col("s.fees"))).alias("legs"),
        F.element_at(starts, F.col("place")).alias("start_px"), *(F.col(n).alias(n[1:]) for n in also),
    )


def sized(rows: DataFrame, packet_usdt: float | None = None) -> DataFrame:
    """Survivors with start_in, start_out, profit, leg_in, leg_base_qty, limit_px, and profit_usdt, size_usdt."""
    rows = rows.withColumn("most", F.lit(packet_usdt) / F.col("start_px") if packet_usdt else F.lit(float("inf")))
    keys = ["seq", "scenario", "cycle_id", "start_px"]
    found = sizing.size_cycles(rows.withColumn("most", F.coalesce("most", F.lit(0e0))), keys, most="most")
    return found.withColumns(
        {"profit_usdt": F.col("profit") * F.col("start_px"), "size_usdt": F.col("start_in") * F.col("start_px")}
    )


def hits(found: DataFrame, paths: DataFrame) -> DataFrame:
    """seq, scenario, best: struct(profit_usdt, size_usdt, path) of each snapshot's best cycle (null without one);
    ties go to the larger size, then to the later path. paths: cycle_id, path of the 74 cycles."""
    named = found.join(F.broadcast(paths), "cycle_id", "left")
    best = F.max(F.when(F.col("cycle_id").isNotNull(), F.struct("profit_usdt", "size_usdt", "path"))).alias("best")
    return named.groupBy("seq", "scenario").agg(best)


def routes(src: str, dst: str, max_legs: int, books: Column, fees: Column) -> Column:
    """array of struct(path, legs with levels) of all paths from src to dst, shortest first."""
    return F.array(
        *(
            F.struct(F.lit(graph.path_name(p)).alias("path"), with_levels(_literal(p), books, fees).alias("legs"))
            for p in graph.paths(src, dst, max_legs)
        )
    )
