"""Document fingerprints from statistically improbable byte windows.

Every 64-byte window of a text's UTF-8 bytes has an entropy, in one of 1,000 classes. A class's rarity over all
documents ranks it (rarest first). Among each 64 successive windows the first one of the rarest rank gets a point;
windows with POINTS or more are the text's features. Features go, in order, into a chain of 2,048-bit Bloom filters
of at most 160 features, 5 bits each. Two digests are compared by the overlap of their filters' bits, scaled between
what chance gives (0) and the largest possible overlap (1); the smaller chain's filters count with their best match.

Windows of a class at the ends of the range (nearly constant or as varied as random bytes) are no features unless
the text has no others. A text under 64 bytes has one feature, itself.

Defined cases: a null text is an empty one; an empty text's digest has no filter, and its likeness to anything but
another empty digest is 0; equal texts have equal digests in one run; rows that repeat an id are ordered by their
text, null ids last; a table of one row has itself as the next; an empty table gives no rows; other columns of the
input are ignored. Texts are fingerprinted whole.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import small_batches

WINDOW = 64
CLASSES = 1000
POINTS = 16
FILTER_BITS = 2048
FILTER_FEATURES = 160
HASHES = 5
#: Classes of at most LOW or over HIGH are weak.
LOW, HIGH = 100, 990
#: Share of the range between the least and the largest overlap that chance may reach.
CHANCE = 0.1
#: Bytes worked on at once.
CHUNK = 1 << 18
#: Documents in a range of ids, and ranges at most.
RANGE_ROWS, RANGES = 2048, 20_000

_SCALE = 1 << 20
_NLOGN = np.array([0] + [round(k * math.log2(k) * _SCALE) for k in range(1, WINDOW + 1)], np.int64)
_WEAK = 1 << 20
_NONE = 1 << 21


def entropy_classes(data: np.ndarray) -> np.ndarray:
    """Entropy class (0 to CLASSES) of the 64-byte window that starts at each byte; len(data) - 63 of them."""
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int32)
    after = np.zeros(n, np.uint8)  # equal bytes among the next 63
    before = np.zeros(n, np.uint8)  # equal bytes among the previous 63
    for gap in range(1, WINDOW):
        same = (data[gap:] == data[:-gap]).view(np.uint8)
        after[:-gap] += same
        before[gap:] += same
    first = _NLOGN[np.bincount(data[:WINDOW], minlength=256)].sum()
    # Going on by one: the first byte of the old window leaves, then the new one's last byte comes in.
    gone, come = after[: n - WINDOW], before[WINDOW:]
    step = (_NLOGN[gone] - _NLOGN[gone + 1]) + (_NLOGN[come + 1] - _NLOGN[come])
    sums = np.cumsum(np.concatenate([[first], step]))
    entropy = 6 * WINDOW * _SCALE - sums  # WINDOW times the entropy in bits, scaled
    return (entropy * CLASSES // (6 * WINDOW * _SCALE)).astype(np.int32)


def _joined(texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts of about CHUNK bytes: first text, one after the last, their bytes, their lengths."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK):
            size += len(texts[end])
            end += 1
        part = texts[at:end]
        yield at, end, np.frombuffer(b"".join(part), np.uint8), np.array([len(t) for t in part], np.int64)
        at = end


def _inside(lengths: np.ndarray, reach: int) -> np.ndarray:
    """Places (of the joined bytes) from which `reach` bytes lie in the same text."""
    total, ends = int(lengths.sum()), np.cumsum(lengths)
    left = np.repeat(ends, lengths) - np.arange(total)
    return (left >= reach)[: max(0, total - WINDOW + 1)]


def class_counts(texts: list[bytes]) -> np.ndarray:
    """How many windows have each entropy class."""
    out = np.zeros(CLASSES + 1, np.int64)
    for _, _, data, lengths in _joined(texts):
        classes = entropy_classes(data)
        if len(classes):
            out += np.bincount(classes[_inside(lengths, WINDOW)], minlength=CLASSES + 1)
    return out


def ranks(counts: np.ndarray) -> np.ndarray:
    """Rank of each class, the rarest first, the lower class first of equals; weak classes after all others."""
    out = np.empty(CLASSES + 1, np.int64)
    out[np.lexsort([np.arange(CLASSES + 1), counts])] = np.arange(CLASSES + 1)
    out[: LOW + 1] += _WEAK
    out[HIGH + 1 :] += _WEAK
    return out


def _mixed(words: np.ndarray) -> np.ndarray:
    """64-bit hashes of rows of 64-bit words."""
    with np.errstate(over="ignore"):
        h = np.full(len(words), 0x243F6A8885A308D3, np.uint64)
        for k in range(words.shape[1]):
            h = (h ^ words[:, k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


def features(data: np.ndarray, lengths: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and place of each feature, in order."""
    classes = entropy_classes(data)
    if not len(classes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.where(_inside(lengths, WINDOW), rank[classes], _NONE)
    least = (order << 40) | np.arange(len(order))
    for gap in (1, 2, 4, 8, 16, 32):  # the least of 64 in a row, the first of equals
        if len(least) <= gap:
            break
        least = np.minimum(least[gap:], least[:-gap])
    whole = _inside(lengths, 2 * WINDOW - 1)[: len(least)]
    chosen = least[: len(whole)][whole]
    points = np.bincount(chosen & ((1 << 40) - 1), minlength=len(order))
    owner = np.repeat(np.arange(len(lengths)), lengths)[: len(order)]
    taken = (points >= POINTS) & (order < _WEAK)
    # Texts without such a window (short or monotonous ones): their first window of the least rank.
    bare = np.setdiff1d(np.flatnonzero(lengths >= WINDOW), owner[taken])
    starts = np.cumsum(lengths) - lengths
    for text in bare:
        at = starts[text]
        taken[at + np.argmin(order[at : at + lengths[text] - WINDOW + 1])] = True
    place = np.flatnonzero(taken)
    return owner[place], place


def digests(texts: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """Each text's filters: an array of (filters, FILTER_BITS / 8) bytes."""
    out: list[np.ndarray] = []
    for first, end, data, lengths in _joined(texts):
        owner, place = features(data, lengths, rank)
        words = np.ascontiguousarray(data[place[:, None] + np.arange(WINDOW)]).view("<u8") if len(place) else None
        hashes = _mixed(words) if words is not None else np.zeros(0, np.uint64)
        short = np.flatnonzero((lengths < WINDOW) & (lengths > 0))
        if len(short):
            own = [int.from_bytes(hashlib.sha1(texts[first + i]).digest()[:8], "little") for i in short]
            owner, hashes = np.concatenate([owner, short]), np.concatenate([hashes, np.array(own, np.uint64)])
            by_text = np.argsort(owner, kind="stable")
            owner, hashes = owner[by_text], hashes[by_text]
        per_text = np.bincount(owner, minlength=end - first)
        filters = -(-per_text // FILTER_FEATURES)
        base = np.cumsum(filters) - filters
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        at = (base[owner] + nth // FILTER_FEATURES) * FILTER_BITS
        bits = np.zeros(int(filters.sum()) * FILTER_BITS, np.uint8)
        for k in range(HASHES):
            bits[at + ((hashes >> np.uint64(11 * k)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = 1
        packed = np.packbits(bits).reshape(-1, FILTER_BITS // 8)
        out += np.split(packed, np.cumsum(filters)[:-1]) if len(filters) else []
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: how much two digests' filters overlap beyond chance."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if a.shape == b.shape and (a == b).all():
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    ones_a, ones_b = (np.bitwise_count(x).sum(axis=1, dtype=np.int64) for x in (a, b))
    best = np.zeros(len(a))
    for at in range(0, len(b), 64):  # bounded memory for the longest chains
        part, ones = b[at : at + 64], ones_b[at : at + 64]
        for i in range(len(a)):
            overlap = np.bitwise_count(a[i] & part).sum(axis=1, dtype=np.int64)
            most = np.minimum(ones_a[i], ones)
            least = ones_a[i] * ones / FILTER_BITS
            cut = least + CHANCE * (most - least)
            score = np.where(most > cut, (overlap - cut) / np.maximum(most - cut, 1e-9), overlap >= most)
            best[i] = max(best[i], float(score.max()))
    return float(np.clip(best, 0, 1).mean())


def as_text(digest: np.ndarray) -> str:
    """Number of filters and their bits in base 64."""
    return f"{len(digest)}:" + base64.b64encode(digest.tobytes()).decode()


def from_text(digest: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(digest.partition(":")[2]), np.uint8).reshape(-1, FILTER_BITS // 8)


def rarity(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Ranks of the entropy classes by their counts over all documents."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES + 1, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                total += class_counts([t.encode() for t in batch.column(0).slice(at, 256).to_pylist()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES + 1)), pa.array(total)], ["class", "n"])

    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counted = texts.mapInArrow(task, "class bigint, n bigint").groupBy("class").agg(F.sum("n").alias("n"))
    counts = np.zeros(CLASSES + 1, np.int64)
    for r in counted.collect():
        counts[r["class"]] = r["n"]
    return ranks(counts)


def fingerprint(docs: DataFrame, rank: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint of each document."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = digests([t.encode() for t in part.column(1).to_pylist()], rank)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([as_text(d) for d in found], pa.string())], ["doc_id", "fingerprint"]
                )

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(task, f"doc_id {kind}, fingerprint string")


# ---- query: likeness to the edited text and to the next document ----


def with_next(docs: DataFrame) -> DataFrame:
    """Rows in ranges of falling doc_id, each range followed by the first row of the next one.

    Columns doc_id, text, range, ahead: ahead rows belong to the next range and only serve as a next document. Rows
    of a range lie in one task, in order, and are streamed through it; what the driver holds are the ranges' ends.
    """
    ids = docs.select("doc_id")
    n = ids.count()
    ranges = min(RANGES, max(1, n // RANGE_ROWS))
    shares = [k / ranges for k in range(1, ranges)]
    cuts = ids.where(F.col("doc_id").isNotNull()).approxQuantile("doc_id", shares, 0.1 / ranges) if shares else []
    splits = [-math.inf, *sorted(set(cuts) or {0.0}), math.inf]
    key = F.coalesce(F.col("doc_id").cast("double"), F.lit(-math.inf))
    keyed = docs.select("doc_id", "text").withColumn("key", key)
    ranged = Bucketizer(splits=splits, inputCol="key", outputCol="range").transform(keyed).drop("key")
    # In falling order of ids range 0 is the last; its last row is followed by the first row of all.
    tops = (
        Bucketizer(splits=splits, inputCol="key", outputCol="range")
        .transform(ids.select("doc_id", key.alias("key")))
        .groupBy("range")
        .agg(F.max("doc_id").alias("top"))
        .collect()
    )
    found = sorted(int(r["range"]) for r in tops)
    top = {int(r["range"]): r["top"] for r in tops}
    above = {r: found[(i + 1) % len(found)] for i, r in enumerate(found)}  # the lowest is followed by the highest
    ahead = [(top[r], float(above[r])) for r in found]
    heads = docs.sparkSession.createDataFrame(ahead, "top bigint, range double")
    first = docs.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("top")))
    rows = ranged.select("doc_id", "text", "range", F.lit(False).alias("ahead")).union(
        first.select("doc_id", "text", "range", F.lit(True).alias("ahead"))
    )
    return rows.repartition(max(1, len(found)), "range").sortWithinPartitions(
        F.desc("range"), "ahead", F.desc_nulls_last("doc_id"), "text"
    )


def edited(text: str, following: str) -> str:
    """The text whose last half is replaced by as much of the following text's beginning."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_with_next(docs: DataFrame, rank: np.ndarray) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        """Rows in lists of about CHUNK bytes of text."""
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for row in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns)):
                    held.append(row)
                    size += len(row[1])
                    if size > CHUNK:
                        yield held
                        held, size = [], 0
        if held:
            yield held

    def compared(rows: list[tuple]) -> pa.RecordBatch | None:
        """Rows but the last with their followers; a row that leads a range has no row of it before."""
        data = [r[1].encode() for r in rows]
        own = digests(data, rank)
        pairs = [i for i in range(len(rows) - 1) if not rows[i][3] and rows[i][2] == rows[i + 1][2]]
        changed = [edited(rows[i][1], rows[i + 1][1]).encode() for i in pairs]
        theirs = digests(changed, rank)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][0] for i in pairs], pa.int64()),
                pa.array([len(rows[i][1]) for i in pairs], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in changed], pa.string()),
                pa.array([as_text(own[i]) for i in pairs], pa.string()),
                pa.array([as_text(d) for d in theirs], pa.string()),
                pa.array([likeness(own[i], d) for i, d in zip(pairs, theirs)], pa.float64()),
                pa.array([likeness(own[i], own[i + 1]) for i in pairs], pa.float64()),
            ],
            names,
        )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[tuple] = []
        for held in rows_of(batches):
            yield compared(last + held)
            last = held[-1:]

    source = with_next(docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text")))
    return source.mapInArrow(
        task,
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )


def op4_improbable_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return compare_with_next(docs, rarity(docs))
