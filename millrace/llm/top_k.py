"""Exact top-k search by inner product with pivot-table elimination.

Every vector's distances to a fixed number of pivots are worked out once. For a query q and a candidate v the triangle
inequality bounds their distance from below by the largest |d(q, p) - d(v, p)| over the pivots p, and with it their
inner product from above: <q, v> <= (|q|^2 + |v|^2 - bound^2) / 2. Candidates are evaluated in falling order of that
bound until no remaining bound reaches the k-th best score, so the result is exact.

Queries and candidates are dealt by hash into blocks of bounded size and each pair of blocks is one group; each group
gives its own best k for each query, and those are merged. No candidate is skipped but by its bound.

Defined cases: vectors that are null or hold a null or non-finite component, and rows without id, take no part; every
row is a candidate of its own, also where rows repeat an id, and a query leaves out its own row alone; vectors of
different lengths are compared as if the shorter one went on with zeros; equal scores rank by the smaller id; queries
with fewer than k candidates get all of them; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import stored

PIVOTS = 32
#: Rows that the pivots are chosen among.
PIVOT_SAMPLE = 512
#: Rows of a block, about.
BLOCK = 4096
#: Candidates evaluated at once.
STEP = 256


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return vector.isNotNull() & finite


def integers(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """row (a number for each row), vec_id, vector: each component x as floor(256 * x). Written once to the shared
    folder, so that a row keeps its number wherever the table is read."""
    vector = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * 256).cast("bigint"))
    rows = embeddings.where(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
    number = F.monotonically_increasing_id().alias("row")
    return stored(rows.select(number, F.col(id_col).cast("bigint").alias("vec_id"), vector.alias("vector")), "vectors")


def _matrix(column: pa.ChunkedArray | pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of integers, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(lengths.max(initial=0)) if width is None else width
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), width), np.float64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    inside = place < width
    out[row[inside], place[inside]] = flat[inside]
    return out


def choose_pivots(vectors: DataFrame, count: int = PIVOTS) -> np.ndarray:
    """Vectors far from each other among PIVOT_SAMPLE rows with the least hash of their id."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(PIVOT_SAMPLE).select("vector").toArrow()
    sample = _matrix(rows.column(0)) if rows.num_rows else np.zeros((0, 0))
    chosen: list[int] = []
    if len(sample):
        nearest = np.linalg.norm(sample, axis=1)
        while len(chosen) < min(count, len(sample)):
            chosen.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


def pivot_distances(matrix: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows to the pivots; both filled up with zeros to the same length."""
    width = max(matrix.shape[1], pivots.shape[1])
    matrix, pivots = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (matrix, pivots))
    squares = (matrix**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1) - 2 * matrix @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def pivot_table(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """row, vec_id, vector, distances."""

    def task(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                far = pivot_distances(_matrix(part.column(2)), pivots)
                table = pa.array(list(far), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*part.columns, table], ["row", "vec_id", "vector", "distances"])

    rows = vectors.select("row", "vec_id", "vector")
    return rows.mapInArrow(task, "row bigint, vec_id bigint, vector array<bigint>, distances array<double>")


def best_in_block(
    query_rows: np.ndarray, queries: np.ndarray, query_far: np.ndarray,
    rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, far: np.ndarray, k: int,
) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """For each query: ids and scores of its best k in the block, and how many candidates were evaluated."""
    norms, query_norms = (vectors**2).sum(axis=1), (queries**2).sum(axis=1)
    exact = vectors.astype(np.int64)
    whole = math.sqrt(norms.max(initial=0) * query_norms.max(initial=0)) < 2.0**52

    def scores(q: int, at: np.ndarray) -> np.ndarray:
        if whole:  # every partial sum is an exact integer in a double
            return (vectors[at] @ queries[q]).astype(np.int64)
        return exact[at] @ queries[q].astype(np.int64)

    out = []
    for first in range(0, len(queries), 64):
        part = slice(first, min(first + 64, len(queries)))
        low = np.zeros((part.stop - first, len(ids)))
        for p in range(far.shape[1]):
            np.maximum(low, np.abs(query_far[part, p][:, None] - far[:, p]), out=low)
        reach = query_norms[part][:, None] + norms
        top = (reach - low**2) / 2 + 1e-9 * reach + 1e-3
        for q in range(first, part.stop):
            bound = top[q - first].copy()
            bound[rows == query_rows[q]] = -np.inf
            there = int((bound > -np.inf).sum())
            seeds = min(max(k, STEP // 4), there)
            best_ids, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
            if seeds:
                head = np.argpartition(-bound, seeds - 1)[:seeds]
                found = scores(q, head)
                order = np.lexsort([ids[head], -found])[:k]
                best_ids, best = ids[head][order], found[order]
            seen = seeds
            if there > seeds:
                bound[head] = -np.inf
                rest = np.flatnonzero(bound >= best[-1])  # those under the k-th best score can't enter
                rest = rest[np.argsort(-bound[rest], kind="stable")]
                for at in range(0, len(rest), STEP):
                    step = rest[at : at + STEP]
                    if bound[step[0]] < best[-1]:
                        break
                    found, seen = scores(q, step), seen + len(step)
                    all_ids, every = np.concatenate([best_ids, ids[step]]), np.concatenate([best, found])
                    order = np.lexsort([all_ids, -every])[:k]
                    best_ids, best = all_ids[order], every[order]
            out.append((best_ids, best, seen))
    return out


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of `vectors` for each row of `queries` (both row, vec_id, vector), but the
    row itself; queries that repeat an id have their ranks each."""
    pivot_vectors = choose_pivots(vectors, pivots)
    count, n_queries = vectors.count(), queries.count()
    of_query, of_vector = max(1, -(-n_queries // block)), max(1, -(-count // block))

    def blocked(rows: DataFrame, own: str, blocks: int, other: str, others: int, is_query: bool) -> DataFrame:
        return pivot_table(rows, pivot_vectors).select(
            F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other),
            F.lit(is_query).alias("is_query"),
            "row",
            "vec_id",
            "vector",
            "distances",
        )

    both = blocked(vectors, "c", of_vector, "q", of_query, False).unionByName(
        blocked(queries, "q", of_query, "c", of_vector, True)
    )

    def task(group: pa.Table) -> pa.Table:
        asks = np.array(group.column("is_query").to_pylist(), bool)
        rows, ids = group.column("row").to_numpy(), group.column("vec_id").to_numpy()
        matrix, far = _matrix(group.column("vector")), _matrix(group.column("distances"))
        found = best_in_block(rows[asks], matrix[asks], far[asks], rows[~asks], ids[~asks], matrix[~asks], far[~asks], k)
        sizes = [len(f[0]) for f in found]
        return pa.table(
            {
                "query_row": pa.array(np.repeat(rows[asks], sizes).astype(np.int64)),
                "query_id": pa.array(np.repeat(ids[asks], sizes).astype(np.int64)),
                "vec_id": pa.array(np.concatenate([f[0] for f in found] or [[]]).astype(np.int64)),
                "score": pa.array(np.concatenate([f[1] for f in found] or [[]]).astype(np.int64)),
            }
        )

    partial = both.groupBy("q", "c").applyInArrow(task, "query_row bigint, query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return partial.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


# ---- query ----


def op1_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integers(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return search(vectors, vectors.where(F.col("vec_id") % 50 == 0))


ORACLE = """
with v as (
  select row_number() over () as n, vec_id, list_transform(embedding, lambda x: floor(256e0 * x::double)) as e
  from embeddings where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (
  select q.n, q.vec_id as query_id, c.vec_id, list_dot_product(q.e, c.e)::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and q.n <> c.n)
select query_id, r::int as rank, vec_id, score
from (select *, row_number() over (partition by n order by score desc, vec_id) as r from s) where r <= 5
"""
