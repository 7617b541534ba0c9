"""Sizes that an exchange would take: no more than is held of an asset, whole steps, least notionals."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Part of a step by which an amount may lie under a whole number of steps and still count as one.
SLACK = 1e-9


@dataclass(frozen=True)
class Lot:
    """What a symbol's orders have to keep to: steps of the base quantity, least notional in quote units, largest quantity."""

    step: float
    least: float
    most: float = float("inf")


def lot_array(lots: dict[str, Lot], symbols: list[str]) -> Column:
    """array of struct(step, least, most) by symbol number."""
    of = lambda lot: F.struct(*(F.lit(float(getattr(lot, n))).alias(n) for n in ("step", "least", "most")))
    return F.array(*(of(lots[s]) for s in symbols))


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), where value is worked out once."""
    return F.transform(F.array(value), f)[0]


def within(levels: Column, held: Column) -> Column:
    """Levels (array of struct(cap, rate, px)) cut where their inputs add up to what is held of the input asset."""

    def cut(state: Column, level: Column) -> Column:
        part = F.least(level["cap"], held - state["before"])
        kept = F.array(F.struct(part.alias("cap"), level["rate"].alias("rate"), level["px"].alias("px")))
        return F.struct(
            (state["before"] + level["cap"]).alias("before"),
            F.when(part > 0, F.concat(state["kept"], kept)).otherwise(state["kept"]).alias("kept"),
        )

    return F.aggregate(levels, F.struct(F.lit(0e0).alias("before"), F.slice(levels, 1, 0).alias("kept")), cut)["kept"]


def whole_lots(legs: Column, amount: Column) -> Column:
    """struct(out, whole, used, base_qty, rest, limit_px) of an amount of the first leg's source pushed through a cycle's
    legs (array of struct(side, levels, lot)), each rounded down to whole steps before its output goes to the next.

    used, rest: by leg, what is spent of its input and what stays. whole is false as soon as a leg comes to no step at
    all, lies under its least notional or over its largest quantity. Input beyond a leg's depth stays as rest. Prices of
    books are on ticks already, so limits need no rounding.
    """
    none = F.array().cast("array<double>")

    def through(state: Column, leg: Column) -> Column:
        sell, lot = leg["side"] == "SELL", leg["lot"]
        unit = lambda level: F.when(sell, 1e0).otherwise(1e0 / level["px"])

        def buy_power(s: Column, level: Column) -> Column:
            part = F.least(level["cap"], s["left"])
            return F.struct((s["left"] - part).alias("left"), (s["base"] + part * unit(level)).alias("base"))

        def spend(s: Column, level: Column) -> Column:
            part = F.least(level["cap"] * unit(level), s["left"])
            return F.struct(
                (s["left"] - part).alias("left"),
                (s["quote"] + part * level["px"]).alias("quote"),
                (s["out"] + part * F.when(sell, level["rate"]).otherwise(level["px"] * level["rate"])).alias("out"),
                F.when(part > 0, level["px"]).otherwise(s["px"]).alias("px"),
            )

        def joined(x: Column) -> Column:
            used = F.when(sell, x["base"]).otherwise(x["done"]["quote"])
            fits = (x["base"] > 0) & (x["done"]["quote"] >= lot["least"]) & (x["base"] <= lot["most"])
            more = lambda name, value: F.concat(state[name], F.array(value)).alias(name)
            return F.struct(
                x["done"]["out"].alias("out"), (state["whole"] & fits).alias("whole"), more("used", used),
                more("base_qty", x["base"]), more("rest", state["out"] - used), more("limit_px", x["done"]["px"]),
            )

        zero = F.lit(0e0)
        power = F.aggregate(leg["levels"], F.struct(state["out"].alias("left"), zero.alias("base")), buy_power)["base"]
        steps = F.floor(power / lot["step"] + SLACK).cast("double") * lot["step"]
        start = lambda base: F.struct(base.alias("left"), zero.alias("quote"), zero.alias("out"), zero.alias("px"))
        done = lambda base: F.struct(base.alias("base"), F.aggregate(leg["levels"], start(base), spend).alias("done"))
        return _bound(_bound(steps, done), joined)

    begin = F.struct(
        amount.alias("out"), F.lit(True).alias("whole"), *(none.alias(n) for n in ("used", "base_qty", "rest", "limit_px"))
    )
    return F.aggregate(legs, begin, through)


def cut(cap: np.ndarray, rate: np.ndarray, px: np.ndarray, n: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, ...]:
    """within() for many legs at once: cap, rate, px (cycles, legs, levels), n and held (cycles, legs)."""
    before = np.zeros(cap.shape)
    before[:, :, 1:] = np.cumsum(cap, axis=2)[:, :, :-1]
    part = np.minimum(cap, held[:, :, None] - before)
    keep = (part > 0) & (np.arange(cap.shape[2]) < n[:, :, None])
    left = keep.sum(axis=2)
    order = np.argsort(~keep, axis=2, kind="stable")
    inside = np.arange(cap.shape[2]) < left[:, :, None]
    moved = ((part, 0.0), (rate, 1.0), (px, 1.0))
    return *(np.where(inside, np.take_along_axis(x, order, axis=2), empty) for x, empty in moved), left


@dataclass
class Filled:
    """out, whole (cycles) and used, base_qty, rest (cycles, legs) of whole_lots()."""

    out: np.ndarray
    whole: np.ndarray
    used: np.ndarray
    base_qty: np.ndarray
    rest: np.ndarray


def in_lots(
    cap: np.ndarray, rate: np.ndarray, px: np.ndarray, sell: np.ndarray, amount: np.ndarray, step: np.ndarray, least: np.ndarray, most: np.ndarray
) -> Filled:
    """whole_lots() for many cycles at once: cap, rate, px (cycles, legs, levels, filled up with no cap), sell and the
    lots' step, least and most (cycles, legs)."""
    out, whole, shape = amount.copy(), np.ones(len(amount), bool), sell.shape
    used, base_qty, rest = np.zeros(shape), np.zeros(shape), np.zeros(shape)
    for i in range(shape[1]):
        left, base = out.copy(), np.zeros(len(out))
        unit = np.where(sell[:, i, None], 1.0, 1.0 / px[:, i])
        for k in range(cap.shape[2]):
            part = np.minimum(cap[:, i, k], left)
            left, base = left - part, base + part * unit[:, k]
        base = np.floor(base / step[:, i] + SLACK) * step[:, i]
        left, quote, got = base.copy(), np.zeros(len(out)), np.zeros(len(out))
        for k in range(cap.shape[2]):
            part = np.minimum(cap[:, i, k] * unit[:, k], left)
            left, quote = left - part, quote + part * px[:, i, k]
            got = got + part * np.where(sell[:, i], rate[:, i, k], px[:, i, k] * rate[:, i, k])
        whole &= (base > 0) & (quote >= least[:, i]) & (base <= most[:, i])
        used[:, i], base_qty[:, i] = np.where(sell[:, i], base, quote), base
        rest[:, i], out = out - used[:, i], got
    return Filled(out, whole, used, base_qty, rest)
