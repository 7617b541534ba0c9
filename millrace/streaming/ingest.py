"""Ingest of recorded JSON lines into a table by UTC day.

The sink never appends to a file: each batch writes files of its own, and the checkpoint keeps track of what is done, so
a stopped stream goes on where it was. Lines that can't be parsed are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Columns of an update, and their keys in the payload, which are told apart by case.
UPDATE = {"symbol": "s", "update_id": "u", "bid": "b", "bid_qty": "B", "ask": "a", "ask_qty": "A"}


#: Shares of files for each core; files of a day that a batch of updates, each once, gives.
SHARES, FILES = 4, 8


@contextmanager
def small_shares(spark: SparkSession) -> Iterator[None]:
    """Files that are read within, streamed ones too, are dealt in SHARES shares for each core. Gzipped files aren't
    split, and of as many shares as cores the largest keeps the others waiting."""
    name = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(SHARES * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def updates(lines: DataFrame) -> DataFrame:
    """t (ns), day and the columns of UPDATE of streamed or static lines (column value).

    A line is parsed once and its payload walked once: Spark would put filters on what is found below a projection, and
    parse again for each, but not below an explode.
    """
    line = lines.select(F.explode(F.array(F.try_parse_json("value"))).alias("line")).where("line is not null")
    found = F.struct(F.try_variant_get("line", "$.t", "bigint").alias("t"), F.try_variant_get("line", "$.m.data", "map<string,string>").alias("data"))
    get = lambda c: F.col("found.data")[UPDATE[c]]
    rows = line.select(F.explode(F.array(found)).alias("found")).select(
        "found.t", get("symbol").alias("symbol"), get("update_id").cast("bigint").alias("update_id"),
        *(get(c).cast("double").alias(c) for c in UPDATE if c not in ("symbol", "update_id")),
    )
    return rows.withColumn("day", F.to_date(F.timestamp_micros(F.expr("t div 1000"))).cast("string"))


def ingest(spark: SparkSession, source: str, sink: str, checkpoint: str, files_a_batch: int = 1000) -> StreamingQuery:
    """Streams a folder of (gzipped) recordings into Parquet by day, until all that is there has been read."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_a_batch).text(source)
    out = updates(lines).writeStream.format("parquet").partitionBy("day").option("checkpointLocation", checkpoint)
    return out.trigger(availableNow=True).start(sink)


def deduplicated(rows: DataFrame, delay: str) -> DataFrame:
    """Updates of several connections to the same streams, each once by symbol and update id. What is behind the latest
    time by more than delay is dropped, and with it what the stream has to remember."""
    numbered = rows.where(F.col("update_id").isNotNull()).withColumn("ts", F.timestamp_micros(F.expr("t div 1000")))
    return numbered.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["symbol", "update_id"]).drop("ts")


def ingest_once(spark: SparkSession, source: str, sink: str, checkpoint: str, delay: str, files_a_batch: int = 1000) -> StreamingQuery:
    """Like ingest(), of recordings of several connections; the table gets each update once. A batch writes FILES files
    for a day at most: tasks hold updates of all days, and would each write a file for every one."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_a_batch).text(source)
    kept = deduplicated(updates(lines), delay).repartition("day", F.pmod(F.hash("update_id"), F.lit(FILES)))
    out = kept.writeStream.format("parquet").partitionBy("day").option("checkpointLocation", checkpoint)
    return out.trigger(availableNow=True).start(sink)


def set_aside(lines: DataFrame, table: DataFrame) -> DataFrame:
    """Of recorded lines the updates that a table (day, symbol, update_id) doesn't have, each once, with copies (how
    often it was recorded): what came too late. A join by day, symbol and id, to be run over the days that are due."""
    found = updates(lines).where(F.col("update_id").isNotNull()).join(table.select("day", "symbol", "update_id"), ["day", "symbol", "update_id"], "left_anti")
    rest = [c for c in found.columns if c not in ("day", "symbol", "update_id")]
    return found.groupBy("day", "symbol", "update_id").agg(F.min(F.struct(*rest)).alias("first"), F.count(F.lit(1)).alias("copies")).select(
        "day", "symbol", "update_id", "first.*", "copies"
    )
