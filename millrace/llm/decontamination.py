"""Benchmark decontamination by Wu-Manber search for every window of every benchmark item.

Texts become words of lower-cased letters, digits and characters beyond ASCII, each after one space. Windows of the
items are the search strings, in classes of similar length. A class has a table of shifts by the hash of the block that
ends at the place looked at: a block that no string holds lets the search go on by nearly the shortest string's length.
Where the shift is 0, the bucket of the block's hash names the strings whose first part ends so; their first bytes and
then all bytes are compared. A batch of documents is one buffer, and thousands of places in it move at once.

Compiled strings are broadcast in blocks of a bounded size. A benchmark that is larger is dealt into blocks, and every
document is held against one block after the other, with its finds so far in a table between two blocks.

Defined cases: null texts and texts without words have no words and no hits; an item without words has no window; an
item without id marks words, but is neither counted nor listed; rows that repeat an item's id are one item with the
windows of all; documents that repeat an id or a text give a row each; empty tables give no rows, an empty benchmark
no hits; other columns are ignored, whatever their names; texts are searched whole, long items are cut with overlap.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import small_batches, stored, table

#: Words in a window.
WINDOW = 10
#: Bytes of items whose windows are compiled and broadcast at once (about; the items are dealt by hash).
BLOCK_BYTES = 8 << 20
#: Bytes after which a long item is cut.
PIECE_BYTES = 1 << 16
#: Places of a buffer that move at once.
LANES = 4096
#: Pairs of a place and a string that are compared at once.
PAIRS = 1 << 20

_SPACED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    """The words of a text in UTF-8."""
    return text.translate(_SPACED).split()


def spaced(words: list[bytes]) -> bytes:
    """The words, each between spaces."""
    return b" " + b" ".join(words) + b" " if words else b""


class StringClass:
    """Wu-Manber tables of strings whose lengths are at most twice the shortest's, or at least 32 bytes."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.lengths = np.array([len(x) for x in strings], np.int64)
        self.m = m = int(self.lengths.min())
        self.b = b = 2 if m < 8 else 4 if m < 16 else 8
        self.mask = np.uint64((1 << 8 * b) - 1)
        self.bits = np.uint64(64 - min(24, max(12, (8 * m * len(strings)).bit_length())))
        first = np.zeros((len(strings), m + 8), np.uint8)
        first[:, :m] = np.frombuffer(b"".join(x[:m] for x in strings), np.uint8).reshape(-1, m)
        self.shift = np.full(1 << (64 - int(self.bits)), min(m - b + 1, 255), np.uint8)
        for end in range(b, m + 1):
            hashed = self.hash(np.ascontiguousarray(first[:, end - b : end - b + 8]).view("<u8")[:, 0])
            self.shift[hashed] = np.minimum(self.shift[hashed], min(m - end, 255))
        self.head_mask = np.uint64((1 << 8 * min(8, m)) - 1)
        self.head = np.ascontiguousarray(first[:, :8]).view("<u8")[:, 0] & self.head_mask
        self.order = np.argsort(hashed, kind="stable")
        self.buckets = np.searchsorted(hashed[self.order], np.arange(len(self.shift) + 1))

    def hash(self, blocks: np.ndarray) -> np.ndarray:
        return ((blocks & self.mask) * _MIX >> self.bits).astype(np.int64)

    def find(self, buffer: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and numbers of the strings that occur in the buffer's first size bytes; 8 bytes more are there."""
        if size < self.m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at8 = np.ndarray(len(buffer) - 7, "<u8", buffer, strides=(1,))
        lanes = np.linspace(self.m, size + 1, min(LANES, size + 1 - self.m) + 1).astype(np.int64)
        at, end, ends, slots = lanes[:-1], lanes[1:], [], []
        while len(at):
            slot = self.hash(at8[at - self.b])
            step = self.shift[slot].astype(np.int64)
            stop = np.flatnonzero(step == 0)
            if len(stop):
                ends.append(at[stop])
                slots.append(slot[stop])
                step[stop] = 1
            at = at + step
            going = at < end
            if not going.all():
                at, end = at[going], end[going]
        if not ends:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return self._confirmed(buffer, at8, size, np.concatenate(ends) - self.m, np.concatenate(slots))

    def _confirmed(self, buffer, at8, size, starts, slots):
        lo, hi = self.buckets[slots], self.buckets[slots + 1]
        upto = np.cumsum(hi - lo)
        cuts = np.searchsorted(upto, np.arange(PAIRS, upto[-1], PAIRS)) if len(upto) else []
        found: list[tuple[int, int]] = []
        view = memoryview(buffer)
        for part in np.split(np.arange(len(starts)), cuts):
            n = hi[part] - lo[part]
            start = np.repeat(starts[part], n)
            string = self.order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[part], n)]
            near = ((at8[start] & self.head_mask) == self.head[string]) & (start + self.lengths[string] <= size)
            for s, k in zip(start[near].tolist(), string[near].tolist()):
                if view[s : s + len(self.strings[k])] == self.strings[k]:
                    found.append((s, k))
        both = np.array(found, np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]


class Windows:
    """The windows of items (id or None, words in one string), compiled."""

    def __init__(self, items: list[tuple[str | None, bytes]]):
        of: dict[bytes, set[str]] = defaultdict(set)
        for item, text in items:
            words = text.split()
            for i in range(max(1, len(words) - WINDOW + 1)):
                of[spaced(words[i : i + WINDOW])] |= {item} - {None}
        classes: dict[int, list[bytes]] = defaultdict(list)
        for string in of:
            classes[min(5, len(string).bit_length() - 1)].append(string)
        self.classes = [(StringClass(x), [tuple(of[s]) for s in x], np.array([s.count(b" ") - 1 for s in x])) for x in classes.values()]

    def hits(self, docs: list[bytes]) -> dict[int, tuple[list[tuple[int, int]], set[str]]]:
        """For each document (words between spaces) that has hits: its hit stretches of words and the items."""
        joined = b"\0".join(docs)
        buffer = np.frombuffer(joined + bytes(8), np.uint8)
        ends = np.cumsum([len(x) + 1 for x in docs])
        spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
        items: dict[int, set[str]] = defaultdict(set)
        for strings, names, words in self.classes:
            start, string = strings.find(buffer, len(joined))
            doc = np.searchsorted(ends, start, "right")
            for i in np.unique(doc).tolist():
                mine = doc == i if len(docs) > 1 else slice(None)
                first = int(ends[i]) - len(docs[i]) - 1
                spaces = np.flatnonzero(buffer[first : int(ends[i]) - 1] == 32)
                word = np.searchsorted(spaces, start[mine] - first)
                spans[i] += zip(word.tolist(), (word + words[string[mine]]).tolist())
                for k in np.unique(string[mine]).tolist():
                    items[i].update(names[k])
        return {i: (merged(x), items[i]) for i, x in spans.items()}


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches that neither meet nor overlap, in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def pieces(items: DataFrame) -> DataFrame:
    """item, words (binary, one string) of items (item string, text): long ones are cut, WINDOW - 1 words overlapping."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, parts = [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                words = words_of(text or b"")
                start, size = 0, 0
                for i, word in enumerate(words):
                    size += len(word) + 1
                    if (size >= PIECE_BYTES and i - start >= WINDOW) or i + 1 == len(words):
                        names.append(name)
                        parts.append(b" ".join(words[start : i + 1]))
                        start, size = i + 2 - WINDOW, 0
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(parts, pa.binary())], ["item", "words"])

    return items.select("item", "text").mapInArrow(task, "item string, words binary")


_FOUND = "n_words bigint, hits array<struct<start: int, end: int>>, items array<string>"


def _searched(docs: DataFrame, items: list[tuple[str | None, bytes]], id_type: str, last: bool) -> DataFrame:
    """docs (doc_id, text and finds so far) with the finds of one more block of items; the last pass drops the text."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    compiled: list[Windows] = []

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not compiled:
            compiled.append(Windows(shared.value))
        for batch in batches:
            words = [words_of(text or b"") for text in batch.column(1).cast(pa.binary()).to_pylist()]
            new = compiled[0].hits([spaced(x) for x in words])
            if batch.num_columns > 2:
                spans = [[(x["start"], x["end"]) for x in row] for row in batch.column(3).to_pylist()]
                names = batch.column(4).to_pylist()
            else:
                spans, names = [[]] * len(words), [[]] * len(words)
            for i, (found, of) in new.items():
                spans[i], names[i] = merged([*spans[i], *found]), sorted({*names[i], *of})
            hits = pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            counts = pa.array([len(x) for x in words], pa.int64())
            keep = [batch.column(0)] if last else [batch.column(0), batch.column(1)]
            yield pa.RecordBatch.from_arrays([*keep, counts, hits, pa.array(names, pa.list_(pa.string()))], ["doc_id", *["text"][last:], "n_words", "hits", "items"])

    return docs.mapInArrow(task, f"doc_id {id_type}, {'' if last else 'text string, '}{_FOUND}")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, hits (stretches of words inside occurrences of windows), items (sorted ids of items with
    windows that occur) of each row of docs."""
    found = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = found.schema["doc_id"].dataType.simpleString()
    cut = stored(pieces(items.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))), "items")
    blocks = -(-(cut.agg(F.sum(F.length("words"))).head()[0] or 0) // BLOCK_BYTES) or 1
    for k in range(blocks):
        mine = cut.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == k).toArrow()
        block = list(zip(mine.column("item").to_pylist(), mine.column("words").to_pylist()))
        found = _searched(found, block, id_type, last=k == blocks - 1)
        if k < blocks - 1:
            found = stored(found, "searched")
    return found


# ---- query ----


def op12_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + (x["end"] - x["start"]))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


ORACLE = r"""
with words as (
  select row_number() over () as r, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
items as (
  select item_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark where text is not null),
windows as (
  select distinct item_id, least(len(w), 10) as size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as s
  from (select item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) as i from items where len(w) > 0)),
places as (
  select r, i, size, array_to_string(w[i:i + size - 1], ' ') as s
  from (select r, w, size, unnest(range(1, len(w) - size + 2)) as i from words, (select distinct size from windows) where w is not null and len(w) >= size)),
found as (select p.r, p.i, p.size, v.item_id from places p join windows v on v.s = p.s and v.size = p.size),
hit as (select r, count(distinct k) as n from (select r, unnest(range(i, i + size)) as k from (select distinct r, i, size from found)) group by r),
named as (
  select r, count(*) as n, string_agg(id, ',' order by id) as ids
  from (select distinct r, cast(item_id as varchar) as id from found where item_id is not null) group by r)
select doc_id, cast(coalesce(len(w), 0) as bigint) as n_words, cast(coalesce(hit.n, 0) as bigint) as n_hit,
  cast(coalesce(named.n, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(hit.n, 0) > 0 as contaminated
from words left join hit using (r) left join named using (r)
"""
