"""Queries over diffs of price levels: books after every message, and the times without one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import books
from millrace.sources.market import duck_ctes, market

QUERIES, ORACLE = {}, {}
DEPTH = 5
#: Update ids in a segment, scaled to the test tables.
SEGMENT = 300


def query(f):
    QUERIES[f.__name__] = f
    return f


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recording of diffs and snapshots; a message's levels are a few tens at most."""
    levels = market(spark, sf_dir, "fx_diff_level").groupBy("seq").agg(F.collect_list(F.struct("bid", "px", "qty")).alias("levels"))
    rows = market(spark, sf_dir, "fx_diff").select("symbol", "seq", "t_us", "snapshot", "first_id", "last_id")
    return rows.join(levels, "seq", "left").withColumn("levels", F.coalesce("levels", F.array().cast(books.LEVELS)))


@query
def diff_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best five levels of a side after every message; nulls where a side has fewer or the book is unknown."""
    rows = books.books(messages(spark, sf_dir), DEPTH, SEGMENT)
    level = lambda side, i, c: F.round(F.get(F.col(side), F.lit(i))[c], 9).alias(f"{side[:3]}_{c}_{i}")
    return rows.select("symbol", "seq", "last_id", "known", *(level(s, i, c) for s in ("bids", "asks") for i in range(DEPTH) for c in ("px", "qty")))


_STATE = f"""with {duck_ctes("fx_diff", "fx_diff_level")},
o as (select *, row_number() over (partition by symbol order by last_id, snapshot) as r,
 lag(last_id) over (partition by symbol order by last_id, snapshot) as prev from fx_diff),
g as (select *, not snapshot and (prev is null or first_id>prev+1) as gap from o),
e as (select *, last_value(case when snapshot then r when gap then 0 end ignore nulls) over (partition by symbol order by r) as epoch from g)"""
ORACLE["diff_books"] = f"""{_STATE},
v as (select e.symbol, e.epoch, e.r, l.bid, l.px, l.qty, lead(e.r, 1, 1000000000) over (partition by e.symbol, e.epoch, l.bid, l.px order by e.r) as gone
 from e join fx_diff_level l using (seq) where e.epoch>0),
b as (select e.seq, v.bid, v.px, v.qty, row_number() over (partition by e.seq, v.bid order by case when v.bid then -v.px else v.px end) - 1 as i
 from e join v on e.symbol=v.symbol and e.epoch=v.epoch and e.r>=v.r and e.r<v.gone where v.qty>0),
w as (select seq, {", ".join(f"max({c}) filter (bid={str(s == 'bid').lower()} and i={i}) as {s}_{c}_{i}" for s in ("bid", "ask") for i in range(DEPTH) for c in ("px", "qty"))}
 from b where i<{DEPTH} group by seq)
select e.symbol, e.seq, e.last_id, coalesce(e.epoch,0)>0 as known, {", ".join(f"round({s}_{c}_{i},9) as {s}_{c}_{i}" for s in ("bid", "ask") for i in range(DEPTH) for c in ("px", "qty"))}
from e left join w using (seq)"""


@query
def diff_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times without a book: from the first message after missing ids to the snapshot that ends it."""
    return books.gaps(books.sequenced(messages(spark, sf_dir), SEGMENT), SEGMENT)


ORACLE["diff_gaps"] = f"""{_STATE},
k as (select *, coalesce(epoch,0)>0 as known from e),
l as (select *, lag(known) over (partition by symbol order by r) as was from k),
s as (select *, sum(case when not known and coalesce(was,true) then 1 else 0 end) over (partition by symbol order by r) as nth from l),
x as (select * from s where not known or was=false)
select symbol, min(last_id) filter (not known) as from_id, min_by(t_us, r) filter (not known) as from_us, min_by(first_id-prev-1, r) filter (not known)::bigint as missing,
 count(*) filter (not known) as n, max(last_id) filter (known) as until_id, max(t_us) filter (known) as until_us from x group by symbol, nth"""
