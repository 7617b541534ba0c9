"""Token counts from an exact histogram of encoded lengths.

Documents are counted by their exact number of tokens; that histogram, with sums over shorter and longer
documents, answers totals, quantiles and truncated totals for every context limit. The histogram has a row for
each length that occurs, so its size is bounded by the longest document, not by the number of documents.
Sums run in two levels (within blocks of lengths, then over blocks), so no task sorts the whole histogram.

Defined cases: a null or empty text has 0 tokens; repeated rows count each; an empty table gives no rows; other
columns of the input are ignored; texts are counted whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.byte_bpe import public_vocabulary
from millrace.llm.common import small_batches, stored
from millrace.operators.timeseries import asof

#: Lengths in a block of the two-level sums.
BLOCK = 512
#: Context limits and shares of documents that the query reports beside every length that occurs.
LIMITS = (128, 512, 1024, 2048, 4096, 8192, 16384, 32768, 65536, 131072)
QUANTILES = (0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0)
ROWS = 256


@lru_cache(maxsize=2)
def encoding(ranks_path: str, pattern: str):
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("documents", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def lengths(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """n_tokens of each document."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoding(ranks_path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                texts = batch.column(0).slice(at, ROWS).to_pylist()
                counts = [len(model.encode_ordinary(text)) for text in texts]
                yield pa.RecordBatch.from_arrays([pa.array(counts, pa.int64())], ["n_tokens"])

    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInArrow(task, "n_tokens bigint")


def histogram(counted: DataFrame) -> DataFrame:
    """n_tokens, docs: documents of exactly that length."""
    return counted.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("docs"))


def suffix_sums(hist: DataFrame, block: int = BLOCK) -> DataFrame:
    """For every length L that occurs, as a context limit:

    docs, tokens: of exactly that length; docs_longer, tokens_longer: of documents over L;
    docs_total, tokens_total: of all; truncated_total: tokens if each document is cut at L;
    rank_share: share of documents of at most L tokens (the least L with a share >= q is the quantile q).
    """
    h = hist.select(
        "n_tokens", "docs", (F.col("n_tokens") * F.col("docs")).alias("tokens"), F.expr(f"n_tokens div {block}").alias("block")
    )
    blocks = h.groupBy("block").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    offsets = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(above), F.lit(0)).alias("d_above"),
        F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t_above"),
        F.sum("d").over(every).alias("docs_total"),
        F.sum("t").over(every).alias("tokens_total"),
    )
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    longer = h.join(offsets, "block").select(
        "n_tokens",
        "docs",
        "tokens",
        (F.coalesce(F.sum("docs").over(within), F.lit(0)) + F.col("d_above")).alias("docs_longer"),
        (F.coalesce(F.sum("tokens").over(within), F.lit(0)) + F.col("t_above")).alias("tokens_longer"),
        "docs_total",
        "tokens_total",
    )
    return longer.withColumns(
        {
            "truncated_total": F.col("tokens_total")
            - F.col("tokens_longer")
            + F.col("n_tokens") * F.col("docs_longer"),
            "rank_share": 1 - F.col("docs_longer") / F.col("docs_total"),
        }
    )


def quantiles(sums: DataFrame, shares: Sequence[float]) -> DataFrame:
    """q, n_tokens: for each share q the least length that at least this share of the documents don't exceed."""
    up_to = F.col("docs_total") - F.col("docs_longer")
    found = sums.agg(
        F.array(
            *(
                F.struct(F.lit(q).alias("q"), F.min(F.when(up_to >= F.ceil(F.col("docs_total") * F.lit(q)), F.col("n_tokens"))).alias("n_tokens"))
                for q in shares
            )
        ).alias("found")
    )
    return found.select(F.explode("found").alias("f")).select("f.*").where("n_tokens is not null")


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """The least length that at least a share q of the documents don't exceed."""
    return quantiles(sums, [q]).select("n_tokens")


def totals_at(sums: DataFrame, limits: DataFrame, block: int = BLOCK) -> DataFrame:
    """limit, docs_cut, truncated_total for any context limits (a column `limit`), also between lengths: each limit
    takes the sums of the last length that isn't over it, by an as-of lookup within blocks of lengths."""
    ends = sums.select(F.col("n_tokens").alias("at"), F.lit(0).cast("bigint").alias("seq"), "docs_longer", "tokens_longer")
    probes = limits.select(F.col("limit").cast("bigint").alias("at"), F.col("limit").alias("_limit"))
    last = asof(probes, ends, [], ["docs_longer", "tokens_longer"], time="at", segment=block)
    whole = sums.agg(F.max("docs_total").alias("docs_total"), F.max("tokens_total").alias("tokens_total"))
    docs_cut = F.coalesce("docs_longer", "docs_total")
    return last.crossJoin(F.broadcast(whole)).select(  # one row
        F.col("_limit").alias("limit"),
        docs_cut.alias("docs_cut"),
        (F.col("tokens_total") - F.coalesce("tokens_longer", "tokens_total") + F.col("_limit") * docs_cut).alias(
            "truncated_total"
        ),
    )


def report(sums: DataFrame, limits: Sequence[int] = LIMITS, shares: Sequence[float] = QUANTILES) -> DataFrame:
    """Rows of suffix_sums() (kind `length`), one for each limit (docs_longer and truncated_total there) and one for
    each quantile (q and its length)."""
    asked = sums.sparkSession.createDataFrame([(int(x),) for x in limits], "limit bigint")
    at = totals_at(sums, asked).select(
        F.lit("limit").alias("kind"), F.col("limit").alias("n_tokens"), F.col("docs_cut").alias("docs_longer"), "truncated_total"
    )
    by_share = quantiles(sums, shares).select(F.lit("quantile").alias("kind"), "n_tokens", "q")
    rows = sums.withColumn("kind", F.lit("length")).unionByName(at.where("docs_longer is not null"), allowMissingColumns=True)
    return rows.unionByName(by_share, allowMissingColumns=True)


# ---- query ----


def op6_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram of documents' lengths with its sums, for every length as a context limit; totals at LIMITS, also
    where no document has that length; lengths at QUANTILES."""
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counted = stored(histogram(lengths(docs, *public_vocabulary())), "length-histogram")  # texts are encoded once
    return report(stored(suffix_sums(counted), "length-sums"))
