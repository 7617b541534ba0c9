"""Steps that grow with the input: cuts, sampled books, suffixes, captured answers, rows that wait in a stream."""

import bisect
import random
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import functions as F

from millrace.llm import url_filter as uf
from millrace.model import SYMBOLS
from millrace.operators import depth
from millrace.operators import timeseries as ts
from millrace.plans import screening, stored_files
from millrace.streaming import ordered

SF = "/root/testdata/sf0.001"


def test_places_among_cuts_are_found_by_halving(spark):
    draw = random.Random(5)
    rows = [(i, sorted(draw.sample(range(5000), draw.randrange(1, 700))), draw.randrange(-2, 5002)) for i in range(300)]
    rows += [(300 + i, [10, 20, 30], v) for i, v in enumerate((9, 10, 19, 30, 31))]
    got = spark.createDataFrame(rows, "i int, cuts array<long>, v long").select("i", ts._up_to("cuts", F.col("v")).alias("n")).collect()
    want = {i: bisect.bisect_right(cuts, v) for i, cuts, v in rows}
    assert {r.i: r.n for r in got} == want
    plan = ts.balanced(spark.range(10).withColumn("t_us", F.col("id")), 2, segment=100)._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(" not in plan  # a walk over all cuts for each row


def test_sampled_books_equal_a_plain_lookup(spark):
    draw, names = random.Random(6), list(SYMBOLS)
    rows = [(i, draw.randrange(1000) // 5 * 5, draw.choice(names)) for i in range(400)] + [(900 + i, 40, s) for i, s in enumerate(names)]
    books = spark.createDataFrame([(i, t, s, [(float(i), 1.0)], [(i + 0.5, 1.0)]) for i, t, s in rows], "seq long, t_us long, symbol string, bids array<struct<px:double,qty:double>>, asks array<struct<px:double,qty:double>>")
    first, last = max(min(t for _, t, s in rows if s == name) for name in names), max(t for _, t, _ in rows)
    want = {p: [max((t, i) for i, t, s in rows if s == name and t < p)[1] for name in names] for p in range(first + 25, last + 1, 25)}
    found = depth.sampled(books, 25)
    got = {r.t_us: [int(b.bids[0].px) for b in r.books] for r in found.collect()}
    assert got == want and len(want) > 20
    assert depth.sampled(books.where("symbol <> 'BNBETH'"), 25).count() == 0


def test_every_suffix_has_its_own_frequency(spark):
    n = 12_000
    urls = spark.range(2 * n).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a.s"), F.least("id", F.lit(n)), F.lit("/")).alias("url"))
    urls = uf.parts(urls.unionByName(urls.where(f"page_id < {n} and page_id % 7 = 0")))
    table = uf.suffix_table(urls)
    assert table.count() == n + 1
    rows = uf.features(urls, table).groupBy("suffix").agg(F.max("suffix_rarity").alias("r"), F.count(F.lit(1)).alias("n")).collect()
    total = sum(r.n for r in rows)
    assert total == urls.count()
    assert all(2.0 ** -(r.r + 1) < r.n / total <= 2.0**-r.r for r in rows)


def test_answers_do_not_grow_with_the_tables(spark, monkeypatch):
    monkeypatch.setattr(stored_files, "ANSWER", 20)
    lengths = []
    monkeypatch.setattr(stored_files.captures, "book_tickers", lambda lines, read=stored_files.captures.book_tickers: lengths.extend(
        r.n for r in lines.select(F.size(F.from_json("value", "array<string>")).alias("n")).collect()) or read(lines))
    stored_files.files_pairs(spark, SF).count()
    assert lengths and max(lengths) <= 20


def test_pairs_are_worked_out_once(spark):
    plan = screening.record_symbols(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "lineitem" not in plan and "l_partkey" not in screening.anchored(screening.pairs(spark, SF))._jdf.queryExecution().optimizedPlan().toString()


class State:
    """A map state that counts what is written to it."""

    def __init__(self):
        self.rows, self.written = {}, 0
        self.containsKey, self.getValue, self.removeKey, self.keys = self.rows.__contains__, self.rows.__getitem__, self.rows.pop, lambda: list(self.rows)

    def updateValue(self, key, value):  # noqa: N802
        self.rows[key] = value
        self.written += len(value[0]) if isinstance(value[0], list) else 0


def test_what_waits_is_written_once():
    states, out = {}, []
    handle = SimpleNamespace(getMapState=lambda name, *_: states.setdefault(name, State()), registerTimer=lambda at: None)
    waiting = ordered.Ordered("t_us bigint, seq bigint", 1000)
    waiting.init(handle)
    waiting.released = lambda key, rows, until: out.extend(rows)
    frames = [pd.DataFrame({"t_us": [i % 3 * 1000 + j for j in (9, 5, i)], "seq": [i, i, i]}) for i in range(40)]
    for frame in frames:
        list(waiting.handleInputRows(("k",), iter([frame]), None))
    assert waiting.first_held() == 0 and states["held"].written == 120
    list(waiting.handleExpiredTimer(("k",), SimpleNamespace(getCurrentWatermarkInMs=lambda: 3), None))
    assert out == sorted((t, s) for f in frames for t, s in f.itertuples(index=False)) and not states["held"].rows
