"""Readers of captured files: recordings of JSON lines, archives of CSV in zip files; and the parsing of their cells."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.model import QUOTES

#: Rows of an unzipped archive that are passed on at once.
ROWS = 10_000


def normalised_ms(t: Column) -> Column:
    """Milliseconds of a time in micro- or milliseconds."""
    return F.when(t > 100_000_000_000_000, F.floor(t / 1000).cast("bigint")).otherwise(t)


def hex_double(digits: Column) -> Column:
    """A hexadecimal number of up to 64 digits (without 0x) as a double: eight pieces of 32 bits, the highest first."""
    padded = F.lpad(digits, 64, "0")
    pieces = [F.conv(F.substring(padded, 1 + 8 * i, 8), 16, 10).cast("double") * float(1 << (32 * (7 - i))) for i in range(8)]
    return sum(pieces[1:], pieces[0])


def split_symbol(symbol: Column) -> Column:
    """struct(base, quote): by the first quote asset, in their order, that the symbol ends with and isn't alone."""
    out = F.lit(None).cast("struct<base:string,quote:string>")
    for quote in reversed(QUOTES):
        base = F.substring(symbol, F.lit(1), F.length(symbol) - len(quote))
        fits = symbol.endswith(quote) & (F.length(symbol) > len(quote))
        out = F.when(fits, F.struct(base.alias("base"), F.lit(quote).alias("quote"))).otherwise(out)
    return out


def read_recording(spark: SparkSession, *paths: str) -> DataFrame:
    """t (ns), stream, data (variant) of recordings in JSON lines, gzipped or not, of one or more members each.

    A file counts up to its first line that can't be parsed, and a truncated one up to where it ends. Lines keep their
    order by file, block and place.
    """
    lines = spark.read.option("ignoreCorruptFiles", "true").text(list(paths)).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"), F.try_parse_json("value").alias("line"),
    )
    at = F.struct("block", "place")
    bad = lines.where("line is null").groupBy("file").agg(F.min(at).alias("bad"))
    good = lines.join(bad, "file", "left").where(F.col("bad").isNull() | (at < F.col("bad")))
    get = lambda path, kind: F.try_variant_get("line", path, kind)
    return good.select(
        "file", "block", "place", get("$.t", "bigint").alias("t"), get("$.m.stream", "string").alias("stream"),
        get("$.m.data", "variant").alias("data"),
    )


def quotes_of(recording: DataFrame) -> DataFrame:
    """t, symbol, bid, bid_qty, ask, ask_qty of book updates; keys are told apart by case."""
    get = lambda key: F.try_variant_get("data", f"$.{key}", "string")
    return recording.select(
        "file", "block", "place", "t", get("s").alias("symbol"), get("b").cast("double").alias("bid"), get("B").cast("double").alias("bid_qty"),
        get("a").cast("double").alias("ask"), get("A").cast("double").alias("ask_qty"),
    )


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """file, nth, cells of the CSV in each zip file under a path, as unzipped() gives them."""
    return unzipped(spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path))


def unzipped(zips: DataFrame) -> DataFrame:
    """file, nth, cells (array of texts) of the CSV in each zip file (path, content); a first line that doesn't begin
    with a digit is a header and left out. Each zip file is one row, unzipped as a stream by the task that reads it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                with zipfile.ZipFile(pa.BufferReader(content.as_buffer())) as archive:
                    with archive.open(archive.namelist()[0]) as member:
                        held, nth = [], 0
                        for k, row in enumerate(csv.reader(io.TextIOWrapper(member, "utf-8", newline=""))):
                            if not row or (k == 0 and not row[0][:1].isdigit()):
                                continue
                            held.append(row)
                            if len(held) == ROWS:
                                yield _cells(file, nth, held)
                                nth, held = nth + len(held), []
                        yield _cells(file, nth, held)

    return zips.select("path", "content").mapInArrow(task, "file string, nth bigint, cells array<string>")


def zipped(rows: DataFrame, keys: list[str], line: str, order: str, header: str) -> DataFrame:
    """path, content: a zip file with a CSV of the lines of each key, in order, behind a header."""

    def task(group: pa.Table) -> pa.Table:
        group = group.sort_by(order)
        text, out = "\n".join([header, *group.column(line).to_pylist()]), io.BytesIO()
        name = "-".join(str(group.column(k)[0].as_py()) for k in keys)
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr(f"{name}.csv", text)
        return pa.table({"path": [f"{name}.zip"], "content": pa.array([out.getvalue()], pa.binary())})

    return rows.select(*keys, line, order).groupBy(*keys).applyInArrow(task, "path string, content binary")


def _cells(file: str, nth: int, rows: list[list[str]]) -> pa.RecordBatch:
    columns = [pa.array([file] * len(rows), pa.string()), pa.array(range(nth, nth + len(rows)), pa.int64()), pa.array(rows, pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(columns, ["file", "nth", "cells"])


def archive_trades(rows: DataFrame, cells: str = "cells") -> DataFrame:
    """Adds t_ms, price, qty, buyer_maker of aggregated-trade rows to rows with their cells."""
    cell = lambda i: F.get(cells, F.lit(i))
    return rows.withColumns(
        {
            "t_ms": normalised_ms(cell(5).cast("bigint")),
            "price": cell(1).cast("double"),
            "qty": cell(2).cast("double"),
            "buyer_maker": F.lower(cell(6)) == "true",
        }
    )


def archive_closes(rows: DataFrame, cells: str = "cells", by: tuple[str, ...] = ("file",), order: tuple[str, ...] = ("nth",)) -> DataFrame:
    """by, t_ms, close of kline rows; of rows with one time the last one of the last file counts."""
    cell = lambda i: F.get(cells, F.lit(i))
    return rows.groupBy(*by, normalised_ms(cell(0).cast("bigint")).alias("t_ms")).agg(
        F.max_by(cell(4).cast("double"), F.struct(*order)).alias("close")
    )


def archive_funding(rows: DataFrame, cells: str = "cells", by: tuple[str, ...] = ("file",)) -> DataFrame:
    """by, t_ms, rate, interval_h of funding rows."""
    cell = lambda i: F.get(cells, F.lit(i)).cast("double")
    return rows.select(*by, cell(0).cast("bigint").alias("t_ms"), cell(2).alias("rate"), cell(1).alias("interval_h"))


# ---- captured JSON ----


def _parsed(lines: DataFrame, kind: str) -> DataFrame:
    return lines.select(F.from_json("value", kind).alias("j"))


def exchange_info(lines: DataFrame) -> DataFrame:
    """symbol, status, base, quote of captured listings, a document in each line (column value)."""
    rows = _parsed(lines, "symbols array<struct<symbol: string, status: string, baseAsset: string, quoteAsset: string>>")
    return rows.select(F.explode("j.symbols").alias("s")).select("s.symbol", "s.status", F.col("s.baseAsset").alias("base"), F.col("s.quoteAsset").alias("quote"))


def book_tickers(lines: DataFrame) -> DataFrame:
    """symbol, bid, ask of captured best prices, an array in each line."""
    rows = _parsed(lines, "array<struct<symbol: string, bidPrice: string, askPrice: string>>").select(F.explode("j").alias("s"))
    return rows.select("s.symbol", F.col("s.bidPrice").cast("double").alias("bid"), F.col("s.askPrice").cast("double").alias("ask"))


def day_tickers(lines: DataFrame) -> DataFrame:
    """symbol, quote_volume of captured daily figures, an array in each line."""
    rows = _parsed(lines, "array<struct<symbol: string, quoteVolume: string>>").select(F.explode("j").alias("s"))
    return rows.select("s.symbol", F.col("s.quoteVolume").cast("double").alias("quote_volume"))


def pool_samples(lines: DataFrame) -> DataFrame:
    """The columns of each captured sample (seq, t_us, symbol, pool_fee, base_address, quote_address), bid and ask of its
    book, slot0 and gas_price as the two answers of the batched call give them (in order of their ids)."""
    kind = (
        "seq bigint, t_us bigint, symbol string, pool_fee double, base_address string, quote_address string, "
        "rpc array<struct<id: int, result: string>>, book struct<bidPrice: string, askPrice: string>"
    )
    answer = lambda i: F.filter("j.rpc", lambda x: x["id"] == i)[0]["result"]
    return _parsed(lines, kind).select(
        *(f"j.{c}" for c in ("seq", "t_us", "symbol", "pool_fee", "base_address", "quote_address")),
        F.col("j.book.bidPrice").cast("double").alias("bid"), F.col("j.book.askPrice").cast("double").alias("ask"),
        answer(0).alias("slot0"), hex_double(F.substring(answer(1), 3, 64)).alias("gas_price"),
    )
