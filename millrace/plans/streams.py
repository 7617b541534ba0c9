"""Queries over recordings: written as gzipped JSON lines, read back as a batch and as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import markout as mk
from millrace.plans.common import FLAT, HORIZONS, MAKER_BPS, PRE
from millrace.plans.cycles import _BEST_OF, _CAPS, _RUNS, _WITH
from millrace.plans.quotes import _MARKED, _OWN, _own, with_rate
from millrace.session import shared_dir, stored
from millrace.sources import captures
from millrace.sources.market import duck_ctes, market
from millrace.streaming import ingest, ordered, screening

QUERIES, ORACLE = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def record(quotes: DataFrame, path: str, order: str = "t_us", copies: Column | None = None) -> None:
    """Quotes as a recording, more lines where there is one already: {"t":ns,"m":{"stream":...,"data":...}} lines, gzipped, a folder for each UTC day.

    Tasks get ranges of days and order, so a day of many lines is several files, one after the other in that order.
    Quotes are dealt as columns and written out where they lie; copies says how often a line is repeated.
    """
    text = lambda c: F.concat(F.lit('"'), F.col(c).cast("string"), F.lit('"'))
    line = F.concat(
        F.lit('{"t":'), (F.col("t_us") * 1000).cast("string"), F.lit(',"m":{"stream":"'), F.lower("symbol"), F.lit('@bookTicker","data":{"s":'), text("symbol"),
        F.lit(',"u":'), F.col("seq").cast("string"), F.lit(',"b":'), text("bid"), F.lit(',"B":'), text("bid_qty"), F.lit(',"a":'), text("ask"), F.lit(',"A":'), text("ask_qty"), F.lit("}}}"),
    )
    if copies is not None:
        line = F.concat(F.repeat(F.concat(line, F.lit("\n")), copies - 1), line)
    day = F.to_date(F.timestamp_micros("t_us"))
    rows = quotes.withColumns({"day": day, "_at": F.col(order)}).repartitionByRange("day", "_at").sortWithinPartitions("day", "_at")
    rows.select("day", line.alias("value")).write.mode("append").partitionBy("day").option("compression", "gzip").text(path)


def _recorded(spark: SparkSession, sf_dir: str) -> str:
    path = f"{shared_dir(spark)}/recording-{uuid.uuid4().hex}"
    record(market(spark, sf_dir, "fx_quote"), path)
    return path


_COLUMNS = ["t", "symbol", "bid", "bid_qty", "ask", "ask_qty"]


@query
def scan_recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recording of all quotes, read as a batch."""
    return captures.quotes_of(captures.read_recording(spark, f"{_recorded(spark, sf_dir)}/*")).select(*_COLUMNS)


ORACLE["scan_recording"] = f"with {duck_ctes('fx_quote')} select t_us*1000 as t, symbol, bid, bid_qty, ask, ask_qty from fx_quote"


@query
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recording streamed into a table by day, and what the table holds."""
    path = _recorded(spark, sf_dir)
    ingest.ingest(spark, f"{path}/*", f"{path}-table", f"{path}-checkpoint").awaitTermination()
    kinds = "t bigint, symbol string, bid double, bid_qty double, ask double, ask_qty double, day string"
    return spark.read.schema(kinds).option("basePath", f"{path}-table").parquet(f"{path}-table").select(*_COLUMNS, "day")


ORACLE["stream_ingest"] = f"""with {duck_ctes("fx_quote")}
select t_us*1000 as t, symbol, bid, bid_qty, ask, ask_qty, make_timestamp(t_us)::date::varchar as day from fx_quote"""


@query
def stream_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes of the recording found by a stateful stream: those that are closed within it."""
    path = _recorded(spark, sf_dir)
    rows = ingest.updates(spark.readStream.text(f"{path}/*")).select(
        F.lit("all").alias("recording"), F.expr("t div 1000").alias("t_us"), F.col("update_id").alias("seq"), "symbol", "bid", "ask", "bid_qty", "ask_qty"
    )
    out = screening.episodes(rows, FLAT).writeStream.format("parquet").option("checkpointLocation", f"{path}-checkpoint")
    out.trigger(availableNow=True).start(f"{path}-episodes").awaitTermination()
    found = spark.read.schema(screening.EPISODE).parquet(f"{path}-episodes")
    return found.select("start_us", "end_us", "opened_by", "closed_by", F.round("peak", 9).alias("peak"), "cycle_id", F.round("capacity", 6).alias("capacity"))


ORACLE["stream_episodes"] = f"""{_WITH}, {_CAPS}, {_BEST_OF(FLAT)}, {_RUNS}
select start_us, end_us, opened_by, closed_by, round(peak,9) as peak, top.c::int as cycle_id, round(top.k,6) as capacity from eps where closed_by<>'(end of recording)'"""


#: How late lines may be, and the reorder buffer's bucket, scaled to the test tables.
DELAY = "1 day"
WIDTH = 6 * 3_600_000_000
#: Files of a batch: however many there are. The files of a delivery aren't in the order of time, so a second batch of them would come late.
ONE_BATCH = 2**31 - 1


def _parts(rows: DataFrame) -> DataFrame:
    """Adds part, of which the recording is delivered in turn: 0 and 1 are the halves of its time, with some of the first
    half's last 12 hours in the second; 2 is some of the first quarter, which comes far too late."""
    ends = rows.agg(F.min("t_us").alias("_a"), F.max("t_us").alias("_z"))
    middle, quarter = F.expr("_a + (_z - _a) div 2"), F.expr("_a + (_z - _a) div 4")
    slow = (F.col("seq") % 5 == 0) & (F.col("t_us") >= middle - 43_200_000_000)
    part = F.when((F.col("seq") % 13 == 5) & (F.col("t_us") < quarter), 2).when((F.col("t_us") >= middle) | slow, 1).otherwise(0)
    return rows.crossJoin(F.broadcast(ends)).withColumn("part", part).drop("_a", "_z")


@query
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two connections' recordings, out of order, with lines repeated and late, streamed into one table over restarts;
    late lines are found again."""
    path = f"{shared_dir(spark)}/recording-{uuid.uuid4().hex}"
    rows = _parts(market(spark, sf_dir, "fx_quote")).withColumn("shuffled", F.xxhash64("seq"))
    with ingest.small_shares(spark):
        for part in range(3):
            copies = F.when(F.col("part") == part, F.when(F.col("seq") % 3 == 0, 1).otherwise(2))
            if part == 1:
                copies = copies.when((F.col("part") == 0) & (F.col("seq") % 11 == 0), 1)
            record(rows.where(copies.isNotNull()), path, "shuffled", copies)
            ingest.ingest_once(spark, f"{path}/*", f"{path}-table", f"{path}-checkpoint", DELAY, ONE_BATCH).awaitTermination()
        kinds = "t bigint, symbol string, update_id bigint, bid double, bid_qty double, ask double, ask_qty double, day string"
        table = spark.read.schema(kinds).option("basePath", f"{path}-table").parquet(f"{path}-table")
        late = stored(ingest.set_aside(spark.read.text(f"{path}/*"), table), "late")
    columns = ["update_id", "t", "symbol", "bid", "bid_qty", "ask", "ask_qty", "day", "copies"]
    return table.withColumn("copies", F.lit(None).cast("bigint")).select(*columns).unionByName(late.select(*columns))


ORACLE["stream_dedupe"] = f"""with {duck_ctes("fx_quote")}, ends as (select min(t_us) as a, max(t_us) as z from fx_quote)
select seq as update_id, t_us*1000 as t, symbol, bid, bid_qty, ask, ask_qty, make_timestamp(t_us)::date::varchar as day,
 case when seq%13=5 and t_us<a+(z-a)//4 then 1+case when seq%3<>0 then 1 else 0 end end::bigint as copies from fx_quote, ends"""


def _delivered(spark: SparkSession, parts: list[DataFrame], start) -> str:
    """Writes parts to a folder one after the other and runs the stream that start(rows, its own folder) begins after
    each; the folder of its results."""
    path = f"{shared_dir(spark)}/delivered-{uuid.uuid4().hex}"
    ordered.keep_state(spark)
    for part in parts:
        part.write.mode("append").parquet(f"{path}/in")
        rows = spark.readStream.schema(part.schema).parquet(f"{path}/in")
        out = start(rows).writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint")
        out.trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    return f"{path}/out"


@query
def stream_episodes_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes of two recordings at once, whose updates come out of order and over restarts: those of the batch."""
    own = ["recording", "t_us", "seq", "symbol", "bid", "ask", "bid_qty", "ask_qty"]
    ends = market(spark, sf_dir, "fx_quote").agg(F.max("t_us").alias("z"))
    rows = _parts(market(spark, sf_dir, "fx_quote")).withColumn("recording", F.explode(F.array(F.lit("a"), F.lit("b"))))
    beat = ends.select(F.lit("a").alias("recording"), F.expr("z + 3 * 86400000000L").alias("t_us"), F.lit(-1).cast("bigint").alias("seq"))
    parts = [rows.where("part in (0, 2)").orderBy(F.xxhash64("seq")), rows.where("part = 1").orderBy(F.xxhash64("seq", "recording"))]
    parts = [p.select(*own) for p in parts] + [rows.select(*own).limit(0).unionByName(beat, True)]
    out = _delivered(spark, parts, lambda rows: ordered.episodes(rows, FLAT, DELAY, WIDTH))
    found = spark.read.schema(ordered.EPISODE).parquet(out)
    return found.select("recording", "start_us", "end_us", "opened_by", "closed_by", F.round("peak", 9).alias("peak"), "cycle_id", F.round("capacity", 6).alias("capacity"))


ORACLE["stream_episodes_ordered"] = f"""select n.recording, x.* from ({ORACLE["stream_episodes"]}) x cross join (values ('a'),('b')) n(recording)"""


@query
def stream_markouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """markout_own of a stream of quotes and trades, which come out of order and over restarts."""
    kinds = {"price": "double", "qty": "double", "buyer_maker": "boolean", "quote": "string"}
    own = ["symbol", "t_us", "seq", "bid", "ask", *kinds]
    quotes = market(spark, sf_dir, "fx_quote").drop("quote")
    both = quotes.unionByName(market(spark, sf_dir, "fx_trade").drop("base"), True)
    rows = _parts(both).orderBy(F.xxhash64("seq"))
    beat = both.agg((F.max("t_us") + 3 * 86_400_000_000).alias("t_us")).select("t_us", F.lit(-1).cast("bigint").alias("seq"), F.lit("").alias("symbol"))
    parts = [rows.where("part in (0, 2)").select(*own), rows.where("part = 1").select(*own), both.select(*own).limit(0).unionByName(beat, True)]
    start = lambda rows: ordered.markouts(
        rows.where("price is null"), rows.where("price is not null").select("symbol", "t_us", "seq", *kinds), (-PRE, *HORIZONS), DELAY, WIDTH
    )
    at = ", ".join(f"at_{i} double" for i in range(len(HORIZONS) + 1))
    schema = "symbol string, t_us bigint, seq bigint, " + ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", " + at
    found = spark.read.schema(schema).parquet(_delivered(spark, parts, start))
    marked = found.withColumns({"w": F.col("price") * F.col("qty"), **{f"m_{i}": mk.gain_bps(F.col(f"at_{i}")) for i in range(len(HORIZONS) + 1)}})
    return _own(with_rate(spark, sf_dir, marked)).select(
        "symbol", "n", F.round("w", 2).alias("notional"), F.round("usdt", 2).alias("usdt"), *(F.round(f"m_{i}", 6).alias(f"m_{i}") for i in range(4))
    )


ORACLE["stream_markouts"] = f"""with {_MARKED}, {_OWN}
select symbol, n, round(w,2) as notional, round(usdt,2) as usdt, {", ".join(f"round(m_{i},6) as m_{i}" for i in range(4))} from own"""
