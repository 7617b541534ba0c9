"""Detection of periodic runs of words by bit-parallel lags.

A document's words get numbers; bit k of all numbers is plane k, one big integer. For a lag q, a plane XOR itself
shifted by q shows where bit k differs between words q apart; the OR over the planes shows all mismatches. ANDs of the
matches with themselves, shifted by doubled steps, leave the places from which enough matches follow. Each stretch of
such places is a run of period q, unless a smaller lag has given the same stretch.

In long documents a lag is only worked out if words at four successive multiples of it are equal, outside of runs that
are known already; a run of period q holds at least four such multiples, and a run that holds them all together with
a run of a smaller period has that smaller period itself (Fine and Wilf), so no run is missed.

Defined cases: a null text, and one without words, has no runs; repeated rows give repeated results; a null id stays
null; an empty table gives no rows; other columns are ignored, whatever their names; texts are worked on whole.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import small_batches, table

#: A run has at least so many words, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: From so many words on, lags are looked at by their multiples first.
LONG = 4096


def numbered(words: list[bytes]) -> np.ndarray:
    """The words' numbers, by first appearance."""
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def _bits(x: int, n: int) -> list[int]:
    return np.flatnonzero(np.unpackbits(np.frombuffer(x.to_bytes(-(-n // 8), "little"), np.uint8), bitorder="little")).tolist()


def _lags(words: np.ndarray, known: list[tuple[int, int, int]]) -> Iterator[int]:
    """The lags that can be the period of a run which isn't known yet, in rising order."""
    n, seen = len(words), 0
    starts = reach = np.zeros(0, np.int64)
    for lag in range(1, n // LEAST_PERIODS + 1):
        some = words[::lag]
        same = some[1:] == some[:-1]
        first = np.flatnonzero(same[2:] & same[1:-1] & same[:-2]) * lag
        if not len(first):
            continue
        if len(known) > seen:
            seen = len(known)
            by_start = np.array(sorted((s, s + length) for s, length, _ in known))
            starts, reach = by_start[:, 0], np.maximum.accumulate(by_start[:, 1])
        if seen:
            at = np.searchsorted(starts, first, "right") - 1
            if np.all((at >= 0) & (reach[at] > first + 3 * lag)):
                continue
        yield lag


def runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """start, length, period of every run of numbered words, in order of start and period."""
    n = len(words)
    bits = int(words.max()).bit_length() if n else 0
    planes = [int.from_bytes(np.packbits((words >> k) & 1, bitorder="little").tobytes(), "little") for k in range(bits)]
    found: list[tuple[int, int, int]] = []
    taken: set[tuple[int, int]] = set()
    for lag in _lags(words, found) if n >= LONG else range(1, n // LEAST_PERIODS + 1):
        need = max(LEAST_WORDS, LEAST_PERIODS * lag) - lag
        if n - lag < need:
            break
        differ = 0
        for plane in planes:
            differ |= plane ^ (plane >> lag)
        every = (1 << (n - lag)) - 1
        long = every & ~differ
        have = 1
        while long and have < need:
            step = min(have, need - have)
            long &= long >> step
            have += step
        if not long:
            continue
        for first, last in zip(_bits(long & ~(long << 1), n), _bits(long & ~(long >> 1), n)):
            length = last - first + need + lag
            if (first, length) not in taken:
                taken.add((first, length))
                found.append((first, length, lag))
    return sorted(found, key=lambda run: (run[0], run[2]))


def kept(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay where each run is collapsed to its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edit: Callable[[object, list[bytes]], list[bytes]] | None = None
) -> DataFrame:
    """doc_id, n_words, runs (array of struct(start, length, period)), collapsed (the text's words, each run's first
    period once, joined by spaces) of each row. edit changes the words of an id before the search."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    run = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, lists, texts = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                words = (text.as_py() or b"").split()
                if edit:
                    words = edit(doc_id, words)
                found = runs(numbered(words))
                counts.append(len(words))
                lists.append([dict(zip(("start", "length", "period"), x)) for x in found])
                stay = kept(len(words), found)
                texts.append(b" ".join(words if stay.all() else [words[i] for i in np.flatnonzero(stay).tolist()]))
            columns = [pa.array(counts, pa.int64()), pa.array(lists, pa.list_(run)), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_words", "runs", "collapsed"])

    shape = "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return source.mapInArrow(task, f"doc_id {id_type}, n_words bigint, {shape}")


# ---- query ----


def repeating(doc_id: object, words: list[bytes]) -> list[bytes]:
    """The words of a document, a tenth of which (by checksum of the id) end in a repetition; without id none does."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not words or doc_id is None:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*words[:a], *(words[a + i % p] for i in range(n - a))]


def op13_bit_parallel_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = periodic_runs(table(spark, sf_dir, "documents"), edit=repeating)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    return found.select("doc_id", "n_words", "runs", "collapsed", longest.alias("top")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.start")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.period")).alias("period"),
        F.expr("1000 * top.length div -top.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
