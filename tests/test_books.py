"""Books from diffs against a plain loop, on literal and random messages."""

from __future__ import annotations

import random

import pytest

from millrace.operators import books

SCHEMA = f"symbol string, seq long, t_us long, snapshot boolean, first_id long, last_id long, levels {books.LEVELS}"


def plain(rows, depth):
    """symbol, seq, known, bids, asks; and the gaps."""
    out, gaps = [], []
    for symbol in sorted({r[0] for r in rows}):
        own, seen = [], set()
        for r in sorted((r for r in rows if r[0] == symbol), key=lambda r: (r[5], r[3], r[2], r[1])):
            if (r[5], r[3]) not in seen:
                seen.add((r[5], r[3]))
                own.append(r)
        book, last, gap = None, None, None
        for _, seq, t, snapshot, first, now, levels in own:
            if snapshot:
                if gap:
                    gaps.append((symbol, *gap, now, t))
                book, gap = {}, None
            elif last is None or first > last + 1:
                gap = gap or [now, t, None if last is None else first - last - 1, 0]
                book = None
            last = now
            if book is None:
                gap[3] += 1
                out.append((symbol, seq, False, None, None))
                continue
            for bid, px, qty in levels:
                book[bid, px] = qty
            side = lambda bid: sorted(((p, q) for (b, p), q in book.items() if b == bid and q > 0), reverse=bid)[:depth]
            out.append((symbol, seq, True, side(True), side(False)))
        if gap:
            gaps.append((symbol, *gap, None, None))
    return sorted(out, key=str), sorted(gaps, key=str)


def found(spark, rows, depth, segment):
    messages = spark.createDataFrame(rows, SCHEMA).repartition(3)
    pairs = lambda side: None if side is None else [tuple(x) for x in side]
    got = [(r.symbol, r.seq, r.known, pairs(r.bids), pairs(r.asks)) for r in books.books(messages, depth, segment).collect()]
    lost = [tuple(r) for r in books.gaps(books.sequenced(messages, segment), segment).collect()]
    return sorted(got, key=str), sorted(lost, key=str)


def messages(seed, n=120):
    draw, rows, seq = random.Random(seed), [], 0
    for symbol in ("AAA", "BBB"):
        last = draw.randint(0, 5)
        for i in range(n):
            seq += 1
            snapshot = draw.random() < 0.08
            if snapshot:
                last += draw.choice([0, 0, 3])
                levels = [(b, 100.0 - k if b else 101.0 + k, float(draw.randint(1, 9))) for b in (True, False) for k in range(draw.randint(0, 7))]
                rows.append((symbol, seq, seq, True, None, last, levels))
                continue
            size, skip, back = draw.randint(1, 3), 2 if draw.random() < 0.06 else 0, draw.choice([0, 0, 1])
            first, last = last + 1 + skip - back * (not skip), last + skip + size
            levels = [(b, 100.0 - k if b else 101.0 + k, float(draw.choice([0, 0, 1, 2, 3]))) for b in (True, False) for k in draw.sample(range(9), 2)]
            rows.append((symbol, seq, seq, False, first, last, levels))
    rows += [(r[0], r[1] + 10_000, r[2] + 10_000, *r[3:6], []) for r in rows[5::9]]  # a slower connection's copies, which don't count
    return rows


def test_diffs_snapshots_deletes_and_a_gap(spark):
    rows = [
        ("A", 1, 1, False, 1, 2, [(True, 9.0, 1.0)]),  # before any snapshot
        ("A", 2, 2, True, None, 2, [(True, 10.0, 1.0), (True, 9.0, 2.0), (False, 11.0, 3.0)]),
        ("A", 3, 3, False, 2, 4, [(True, 10.0, 0.0), (False, 12.0, 1.0), (False, 13.0, 0.0)]),
        ("A", 4, 4, False, 6, 7, [(True, 8.0, 5.0)]),  # id 5 is missing
        ("A", 5, 5, False, 8, 8, []),
        ("A", 6, 6, True, None, 8, [(False, 20.0, 1.0)]),
        ("A", 7, 7, False, 9, 9, None),
    ]
    got, gaps = found(spark, rows, 5, 3)
    assert got == [
        ("A", 1, False, None, None),
        ("A", 2, True, [(10.0, 1.0), (9.0, 2.0)], [(11.0, 3.0)]),
        ("A", 3, True, [(9.0, 2.0)], [(11.0, 3.0), (12.0, 1.0)]),
        ("A", 4, False, None, None),
        ("A", 5, False, None, None),
        ("A", 6, True, [], [(20.0, 1.0)]),
        ("A", 7, True, [], [(20.0, 1.0)]),
    ]
    assert gaps == [("A", 2, 1, None, 1, 2, 2), ("A", 7, 4, 1, 2, 8, 6)]


@pytest.mark.parametrize(("seed", "segment"), [(1, 1_000_000), (1, 20), (1, 1), (2, 7), (3, 50)])
def test_random_books_equal_a_plain_loop_whatever_the_segment(spark, seed, segment):
    rows = messages(seed)
    want = plain(rows, 3)
    assert sum(not r[2] for r in want[0]) > 5 and len(want[1]) > 3
    assert found(spark, rows, 3, segment) == want


def test_no_messages(spark):
    assert found(spark, [], 5, 10) == ([], [])
