"""Queries that read files: archives of trades, closes and funding, captured JSON, recordings by day. The files are
written from the given tables into the shared folder first."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans import archives as arc
from millrace.plans import carry, screening, streams
from millrace.session import shared_dir, stored
from millrace.sources import captures, files
from millrace.sources.market import duck_ctes, market

QUERIES, ORACLE = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


def archived(rows: DataFrame, line: Column, order: str, header: str) -> str:
    """Zips the lines of each symbol, kind and period into an archive of a new folder; an archive holds a day of one
    symbol, or a month of its sparse rows."""
    folder = _folder(rows.sparkSession)
    zips = captures.zipped(rows.withColumn("line", line), ["symbol", "kind", "period"], "line", order, header)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = files.opened(folder)
        system.create_dir(root, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                waiting = f"{root}/_{uuid.uuid4().hex}"
                with system.open_output_stream(waiting) as out:
                    out.write(content)
                system.move(waiting, f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["path"])

    zips.mapInArrow(put, "path string").write.format("noop").mode("overwrite").save()
    return folder


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """To be called for each use: Spark keeps the filters of one load() together, whichever branch of a plan they are of."""
    files.register(spark)
    return spark.read.format("archives").option("path", folder).load()


def _day(c: str) -> Column:
    return F.to_date(F.timestamp_micros(c)).cast("string")


FROM_DAY, COINS = "2024-01-10", ("C1", "C4", "C7")


@query
def files_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of some coins from a day on, read from archives of a coin and a day each; others aren't opened."""
    rows = market(spark, sf_dir, "fx_capture").withColumns({"symbol": F.col("coin"), "kind": F.lit("aggTrades"), "period": _day("t_us")})
    cells = [F.col(c).cast("string") for c in ("seq", "price_text", "qty_text", "coin", "event_type")]
    line = F.concat_ws(",", *cells, F.col("event_time").cast("bigint").cast("string"), "maker_text")
    found = read_archives(spark, archived(rows, line, "seq", "id,p,q,f,l,T,m")).where((F.col("period") >= FROM_DAY) & F.col("symbol").isin(*COINS))
    return captures.archive_trades(found).select("symbol", "period", "nth", F.get("cells", F.lit(0)).cast("bigint").alias("seq"), "t_ms", "price", "qty", "buyer_maker")


ORACLE["files_trades"] = f"""with {duck_ctes("fx_capture")}, d as (select *, make_timestamp(t_us)::date::varchar as period from fx_capture)
select coin as symbol, period, row_number() over (partition by period, coin order by seq)-1 as nth, seq,
 case when event_time>1e14 then event_time::bigint//1000 else event_time::bigint end as t_ms, price_text::double as price, qty_text::double as qty,
 lower(maker_text)='true' as buyer_maker from d where period>='{FROM_DAY}' and coin in {COINS}"""


@query
def files_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """basis_stats of closes that are read from monthly archives, where a corrected row follows some of the times."""
    rows = market(spark, sf_dir, "fx_close").withColumn("ms", F.expr("bucket_us div 1000"))
    both = F.when(F.col("ms") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))
    rows = rows.withColumn("right", F.explode(both)).withColumns({
        "symbol": F.col("coin"), "kind": F.col("market"), "period": F.date_format(F.timestamp_micros("bucket_us"), "yyyyMM"), "place": F.col("ms") * 2 + F.col("right")
    })
    time = F.when(F.col("market") == "spot", F.col("bucket_us")).otherwise(F.col("ms"))
    close = F.when(F.col("right") == 1, F.col("close")).otherwise(F.lit(1e0))
    line = F.concat_ws(",", time.cast("string"), F.lit("0"), F.lit("0"), F.lit("0"), close.cast("string"))
    folder = archived(rows, line, "place", "open_time,open,high,low,close")

    def closes(kind: str) -> DataFrame:
        found = read_archives(spark, folder).where(F.col("kind") == kind)
        closes = captures.archive_closes(found, by=("symbol",), order=("period", "nth"))
        return closes.select(F.col("symbol").alias("coin"), F.col("t_ms").alias("bucket_us"), "close")

    basis = carry.basis_between(closes("spot"), closes("perp"))
    return carry.basis_report(stored(basis, "basis"))


ORACLE["files_basis"] = carry.ORACLE["basis_stats"]


@query
def files_funding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """funding_carry of payments that are read from monthly archives."""
    rows = market(spark, sf_dir, "fx_funding").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    rows = rows.withColumns({"symbol": F.replace("perp", F.lit("-"), F.lit("_")), "kind": F.lit("fundingRate"), "period": F.date_format("ts", "yyyyMM")})
    line = F.concat_ws(",", F.col("ms").cast("string"), F.col("interval_h").cast("string"), F.col("rate").cast("string"))
    found = read_archives(spark, archived(rows, line, "ms", "calc_time,funding_interval_hours,last_funding_rate"))
    paid = captures.archive_funding(found, by=("symbol",)).withColumn("perp", F.replace("symbol", F.lit("_"), F.lit("-")))
    return carry.carried(carry.with_weeks(paid.select("perp", "t_ms", "rate", "interval_h")))


ORACLE["files_funding"] = carry.ORACLE["funding_carry"]


@query
def files_dex_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dex_gap of captured samples: square-root prices and gas in hexadecimal, token order by address, prices as texts."""
    pools, folder = market(spark, sf_dir, "fx_pool"), _folder(spark)
    turned = F.col("seq") % 3 == 0
    root = F.floor(F.sqrt(F.when(turned, 1e0 / F.col("pool_price")).otherwise(F.col("pool_price"))) * float(1 << 40)).cast("bigint")
    text = lambda c: F.col(c).cast("string")
    sample = F.struct(
        "seq", "t_us", "symbol", "pool_fee", F.when(turned, "0xB0").otherwise("0xa0").alias("base_address"), F.when(turned, "0xa0").otherwise("0xB0").alias("quote_address"),
        F.array(
            F.struct(F.lit(1).alias("id"), F.concat(F.lit("0x"), F.hex(((1 + F.col("seq") % 5) * 1_000_000_000).cast("bigint"))).alias("result")),
            F.struct(F.lit(0).alias("id"), F.concat(F.lit("0x"), F.lpad(F.concat(F.hex(root), F.lit("0" * 14)), 64, "0")).alias("result")),
        ).alias("rpc"),
        F.struct(text("bid").alias("bidPrice"), text("ask").alias("askPrice")).alias("book"),
    )
    pools.select(F.to_json(sample).alias("value")).write.option("compression", "gzip").text(folder)
    rows = captures.pool_samples(spark.read.text(folder)).withColumn("pool_price", arc.pool_rate(F.col("slot0"), F.col("base_address"), F.col("quote_address")))
    return arc.gap_report(spark, sf_dir, rows.withColumn("quote", captures.split_symbol(F.col("symbol"))["quote"]))


_HEX = "case when seq%3=0 then 1e0/power(floor(sqrt(1e0/pool_price)*1099511627776e0)/1099511627776e0,2) else power(floor(sqrt(pool_price)*1099511627776e0)/1099511627776e0,2) end"
ORACLE["files_dex_gap"] = arc.ORACLE["dex_gap"].replace("from fx_pool p", f"from (select * replace ({_HEX} as pool_price) from fx_pool) p")


#: Rows of a captured answer at most: there are more answers where there is more to tell, not longer ones.
ANSWER = 500


@query
def files_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """spread_scan of captured listings, best prices and daily figures in JSON."""
    folder = _folder(spark)
    listing, touch, day = (market(spark, sf_dir, v) for v in ("fx_listing", "fx_touch", "fx_day"))
    text = lambda c, name: F.col(c).cast("string").alias(name)
    documents = {
        "info": (listing, F.struct("symbol", "status", text("base", "baseAsset"), text("quote", "quoteAsset")), lambda rows: F.struct(rows.alias("symbols"))),
        "book": (touch, F.struct("symbol", text("bid", "bidPrice"), text("ask", "askPrice")), lambda rows: rows),
        "day": (day, F.struct("symbol", text("quote_volume", "quoteVolume")), lambda rows: rows),
    }
    for name, (rows, item, whole) in documents.items():
        numbered = rows.select(item.alias("item"), F.expr(f"monotonically_increasing_id() div {ANSWER}").alias("answer"))
        answers = numbered.groupBy("answer").agg(F.collect_list("item").alias("items"))
        answers.select(F.to_json(whole(F.col("items"))).alias("value")).write.option("compression", "gzip").text(f"{folder}/{name}")
    read = lambda name: spark.read.text(f"{folder}/{name}")
    found = screening.pairs_of(captures.exchange_info(read("info")), captures.book_tickers(read("book")), captures.day_tickers(read("day")))
    return screening.scanned(stored(found, "pairs"))


ORACLE["files_pairs"] = screening.ORACLE["spread_scan"]


@query
def stream_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recording streamed line by line into folders by UTC day, and read again as a batch."""
    path, folder = streams._recorded(spark, sf_dir), _folder(spark)
    files.register(spark)
    lines = spark.readStream.option("maxFilesPerTrigger", 7).text(f"{path}/*")
    raw = lines.select(F.get_json_object("value", "$.t").cast("bigint").alias("t"), F.get_json_object("value", "$.m").alias("m")).where("t is not null and m is not null")
    out = raw.writeStream.format("recordings").option("path", folder).option("checkpointLocation", f"{folder}-checkpoint")
    out.trigger(availableNow=True).start().awaitTermination()
    found = captures.read_recording(spark, f"{folder}/*")
    return captures.quotes_of(found).select(F.regexp_extract("file", r"day=([\d-]+)/", 1).alias("day"), *streams._COLUMNS)


ORACLE["stream_lines"] = f"""with {duck_ctes("fx_quote")}
select make_timestamp(t_us)::date::varchar as day, t_us*1000 as t, symbol, bid, bid_qty, ask, ask_qty from fx_quote"""
