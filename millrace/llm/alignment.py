"""Alignment of two tokenizers' tokens over the same texts, as relations.

Tokens are exploded with their positions, a window adds up their byte lengths to ends, an equi-join on text and end
finds where tokens of both vocabularies end together (cuts), a running count of cuts numbers the groups, and each cut
links the two tokens that end there. Corpus-wide counts of linked pairs are joined back to the links.

Both tokenizers cut at a space between two visible characters, whatever stands around it, so a text's alignment is the
sequence of its units' alignments. A corpus is aligned by its distinct units: chunks of documents are written as
numbers of their units, and each chunk gets its units' alignments and puts its documents together from them.

Defined cases: null and empty texts, and texts whose tokens' bytes aren't the space and the text (those that hold
U+2581, which the second vocabulary writes for a space), have no tokens: zeros and ''; links of such texts count
nowhere. Rows that repeat an id or a text each give a row and count each; a null id stays null; an empty table gives
no rows; other columns of the input are ignored, whatever their names; texts are worked on whole. A text without
units' spaces (one very long word) is one unit, whose tokens are rows like others.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import dropped, released, small_batches, stored

#: Visible characters in any version of Unicode, and not U+2581: next to such a space both tokenizers cut.
_VISIBLE = r"[!-~\u00A1-\u1679\u1681-\u180D\u180F-\u1FFF\u2C00-\u2FFF\u3001-\uD7FF]"
#: The space between two units. Each unit stands for the space before it and itself.
BETWEEN = rf" (?<={_VISIBLE} )(?={_VISIBLE})"
#: Characters after which a chunk of documents ends; a task holds a chunk's units.
CHUNK_CHARS = 16 << 20
#: Linked pairs are broadcast to the links up to so many rows of 17 bytes, and joined by shuffles beyond.
PAIRS_BROADCAST = 1_000_000
#: Units at most whose alignments are broadcast; of each 40 bytes at most, so that their rows have a few hundred bytes.
FREQUENT = 1 << 18


# ---- the two vocabularies ----


class Vocabularies:
    """A: a byte-level BPE file of the tokenizers library; B: a sentencepiece model with byte fallback."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals the work
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        from millrace.llm.byte_bpe import byte_alphabet

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        byte_of = {letter: bytes([b]) for b, letter in enumerate(byte_alphabet())}
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            if all(c in byte_of for c in token):
                self.a_bytes[i] = b"".join(map(byte_of.__getitem__, token))
        self.b_bytes = [
            bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()
            for i, piece in enumerate(map(self.b.id_to_piece, range(self.b.vocab_size())))
        ]

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]], list[bool]]:
        """Both vocabularies' ids of each text, and whether the bytes of both are the space and the text."""
        spaced = [" " + text for text in texts]
        a = [e.ids for e in self.a.encode_batch_fast(spaced, add_special_tokens=False)]
        b = self.b.encode(texts, num_threads=1)
        get_a, get_b = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        whole = [b"".join(map(get_a, x)) == (t := s.encode()) == b"".join(map(get_b, y)) for s, x, y in zip(spaced, a, b)]
        return a, b, whole


@lru_cache(maxsize=1)
def vocabularies(a_path: str, b_path: str) -> Vocabularies:
    return Vocabularies(a_path, b_path)


def public_vocabularies() -> tuple[str, str]:
    """Paths of the two vocabularies that the box offers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def lengths(spark: SparkSession, a_path: str, b_path: str) -> tuple[DataFrame, DataFrame]:
    """id and bytes of every token of A and of B: as many rows as the vocabularies have."""
    both = vocabularies(a_path, b_path)
    frame = lambda tokens: spark.createDataFrame(
        pa.table({"id": pa.array(range(len(tokens)), pa.int32()), "bytes": pa.array(map(len, tokens), pa.int32())})
    )
    return frame(both.a_bytes), frame(both.b_bytes)


# ---- alignment of texts as relations ----


def tokenized(texts: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """key, n (a weight), whole, a, b (arrays of ids; empty where the text isn't whole) of texts: key, text, n."""
    key = texts.schema["key"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = vocabularies(a_path, b_path)
        for batch in batches:
            a, b, whole = both.encode(batch.column(1).to_pylist())
            if not all(whole):
                a, b = ([x if w else [] for x, w in zip(ids, whole)] for ids in (a, b))
            ids = [pa.array(x, pa.list_(pa.int32())) for x in (a, b)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(whole, pa.bool_()), *ids], ["key", "n", "whole", "a", "b"])

    return texts.select("key", "text", F.col("n").cast("long")).mapInArrow(task, f"key {key}, n bigint, whole boolean, a array<int>, b array<int>")


def _ends(tokens: DataFrame, ids: str, lengths: DataFrame, *more: str) -> DataFrame:
    """key, id, end (bytes up to the token's end) of each token."""
    rows = tokens.select("key", *more, F.posexplode(ids).alias("pos", "id")).join(F.broadcast(lengths), "id")
    so_far = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("key", *more, F.col("id").alias(f"{ids}_id"), F.sum("bytes").over(so_far).cast("int").alias("end"))


def groups(tokens: DataFrame, a_lengths: DataFrame, b_lengths: DataFrame, width: int) -> DataFrame:
    """A row for each text that has tokens: key, n (its weight), links (array of struct(a, b): the tokens that end at
    each cut), ids (the groups' tokens, as packed_ids() writes them). tokens: of tokenized(), keys distinct."""
    by_text = tokens.repartition("key")
    a, b = _ends(by_text, "a", a_lengths, "n"), _ends(by_text, "b", b_lengths)
    both = a.join(b, ["key", "end"], "full_outer").withColumn("cut", F.col("a_id").isNotNull() & F.col("b_id").isNotNull())
    so_far = Window.partitionBy("key").orderBy("end").rowsBetween(Window.unboundedPreceding, 0)
    numbered = both.withColumn("group", F.sum(F.col("cut").cast("int")).over(so_far) - F.col("cut").cast("int"))
    rows = numbered.select("key", "n", "a_id", "b_id", "cut", "group").sortWithinPartitions("key", "end")
    key = tokens.schema["key"].dataType.simpleString()
    return rows.mapInArrow(lambda batches: _by_text(batches, width), f"key {key}, n bigint, links array<struct<a: int, b: int>>, ids binary")


def _by_text(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """A row for each text from its ends, which lie next to each other in order; a text may reach over batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(0)
        if not batch.num_rows:
            continue
        if held and held[-1].column(0)[-1] == keys[0] == keys[-1]:
            held.append(batch)
            continue
        whole = pa.concat_batches([*held, batch]) if held else batch
        last = pc.index(whole.column(0), keys[-1]).as_py()
        if last:
            yield _texts(whole.slice(0, last), width)
        held = [whole.slice(last)]
    if held:
        yield _texts(pa.concat_batches(held), width)


def _texts(rows: pa.RecordBatch, width: int) -> pa.RecordBatch:
    key, n, a, b, cut, group = rows.columns
    total = rows.num_rows
    starts = np.concatenate([[0], 1 + np.flatnonzero(pc.not_equal(key.slice(1), key.slice(0, total - 1)).to_numpy(zero_copy_only=False))])
    ends = np.append(starts[1:], total)
    cut = cut.to_numpy(zero_copy_only=False)
    has = [x.is_valid().to_numpy(zero_copy_only=False) for x in (a, b)]
    before = [np.concatenate([[0], np.cumsum(x)]) for x in (*has, cut)]
    spans = [x[ends] - x[starts] for x in before]
    # In a text's groups each one's tokens of A come before those of B; the last ones of both end at its cut.
    at = [np.flatnonzero(x) for x in has]
    of = np.repeat(np.arange(len(starts)), ends - starts)
    where = np.concatenate(at)
    order = np.lexsort((where, np.repeat([0, 1], [len(x) for x in at]), group.to_numpy()[where], of[where]))
    tokens = np.concatenate([x.drop_null().to_numpy() for x in (a, b)])[order]
    ids = packed_ids(tokens, cut[where][order], spans[0] + spans[1], width)
    linked = np.flatnonzero(cut)
    pairs = pa.StructArray.from_arrays([x.take(pa.array(linked)) for x in (a, b)], ["a", "b"])
    links = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(spans[2])]).astype(np.int32)), pairs)
    weight = pa.array(np.maximum.reduceat(n.fill_null(0).to_numpy(), starts))
    return pa.RecordBatch.from_arrays([key.take(pa.array(starts)), weight, links, ids], ["key", "n", "links", "ids"])


def id_width(a_path: str, b_path: str) -> int:
    """Bytes of a token's id."""
    both = vocabularies(a_path, b_path)
    return 2 if max(len(both.a_bytes), len(both.b_bytes)) <= 1 << 16 else 4


def packed_ids(tokens: np.ndarray, last: np.ndarray, sizes: np.ndarray, width: int) -> pa.Array:
    """Each text's tokens (sizes of them) as their ids, and a bit for each: whether it is its group's last of its side."""
    offsets = np.concatenate([[0], np.cumsum(sizes * width + -(-sizes // 8))])
    nth = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    start = np.repeat(offsets[:-1], sizes)
    out = np.zeros(offsets[-1], np.uint8)
    out[((start + nth * width)[:, None] + np.arange(width)).ravel()] = tokens.astype(f"<u{width}").view(np.uint8)
    bits = start + np.repeat(sizes * width, sizes) + nth // 8
    np.bitwise_or.at(out, bits, (last.astype(np.uint8) << (nth % 8).astype(np.uint8)))
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])


def unpacked_ids(ids: pa.Array, width: int) -> tuple[np.ndarray, list[str]]:
    """(texts, 3): tokens of A, of B, and groups of each; and the groups' text ('' without tokens)."""
    data = b"".join(x for x in ids.to_pylist() if x)
    size = pc.binary_length(ids).fill_null(0).to_numpy().astype(np.int64)
    n = 8 * size // (8 * width + 1)
    row = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = (np.cumsum(size) - size)[row]
    raw = np.frombuffer(data, np.uint8)
    tokens = raw[((start + nth * width)[:, None] + np.arange(width)).ravel()].view(f"<u{width}")
    last = (raw[start + n[row] * width + nth // 8] >> (nth % 8).astype(np.uint8)) & 1
    # Every part has its last token, and parts of A and of B take turns.
    in_b = (np.cumsum(last) - last) % 2
    counts = np.stack([np.bincount(row, w, len(n)) for w in (1 - in_b, in_b, in_b * last)], axis=1).astype(np.int64)
    after = pa.array(np.where(last == 1, np.where(in_b == 1, ";", "|"), ","))
    parts = pc.binary_join_element_wise(pa.array(tokens).cast(pa.string()), after, "")
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), parts)
    return counts, pc.utf8_slice_codeunits(pc.binary_join(lists, ""), 0, -1).to_pylist()


def pair_counts(grouped: DataFrame) -> DataFrame:
    """a, b, pair_n (links of the pair, weighted), best (no other pair of this b has more) of all linked pairs."""
    pairs = grouped.where("n > 0").select("n", F.explode("links").alias("l")).groupBy("l.a", "l.b").agg(F.sum("n").alias("pair_n"))
    return pairs.withColumn("best", F.col("pair_n") == F.max("pair_n").over(Window.partitionBy("b")))


def summed(grouped: DataFrame, pairs: DataFrame) -> DataFrame:
    """key, n, n_best, count_sum, ids of each text; all but key are null where it has no tokens."""
    own = ["key", "n", "ids"]
    links = grouped.select(*own, "links").repartition("key").select(*own, F.explode_outer("links").alias("l")).select(*own, "l.*")
    return links.join(pairs, ["a", "b"], "left").groupBy(*own).agg(
        F.sum(F.col("best").cast("int")).cast("int").alias("n_best"), F.sum("pair_n").alias("count_sum")
    )


# ---- a corpus by its distinct units ----


def units(text: Column) -> Column:
    """The parts of a text whose alignments follow each other in the text's: it is cut at spaces between visible
    characters, and each part stands for the space before it and itself."""
    return F.split(text, BETWEEN, -1)


def key_of(unit: Column) -> Column:
    """The unit, or a digest where it is long, so that rows of its tokens stay short."""
    return F.when(F.octet_length(unit) <= 40, unit).otherwise(F.sha2(unit, 256))


def packed(codes: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, first bytes first, compressed."""
    return zstandard.compress(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked(codes: bytes) -> np.ndarray:
    data = np.frombuffer(zstandard.decompress(codes), np.uint8)
    return np.ascontiguousarray(data.reshape(4, -1).T).view("<u4")[:, 0]


def coded(docs: DataFrame) -> DataFrame:
    """Chunks of documents (doc_id, text, not null or empty) as numbers of their units: rows of documents have chunk,
    doc_id and codes (the packed numbers of its units), rows of units have chunk, code, unit and n."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, cut = TaskContext.get().partitionId() << 32, re.compile(BETWEEN)
        code: defaultdict[str, int] = defaultdict()
        code.default_factory = code.__len__
        seen, size = np.zeros(0, np.int64), 0

        def rows(doc_id: pa.Array | None, codes: list | None, units: list, counts: np.ndarray) -> pa.RecordBatch:
            n = len(units) if codes is None else len(codes)
            none = lambda kind: pa.nulls(n, kind)
            columns = [pa.array(np.full(n, chunk, np.int64))]
            if codes is None:
                columns += [none(out["doc_id"]), none(pa.binary()), pa.array(range(n), pa.int32()), pa.array(units, pa.string()), pa.array(counts)]
            else:
                columns += [doc_id, pa.array(codes, pa.binary()), none(pa.int32()), none(pa.string()), none(pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["chunk", "doc_id", "codes", "code", "unit", "n"])

        out: dict[str, pa.DataType] = {}
        for batch in batches:
            out["doc_id"], codes = batch.column(0).type, []
            for text in batch.column(1).to_pylist():
                parts = cut.split(text)
                codes.append(np.fromiter(map(code.__getitem__, parts), np.uint32, len(parts)))
                size += len(text)
            found = np.bincount(np.concatenate(codes), minlength=len(code)) if codes else np.zeros(0, np.int64)
            found[: len(seen)] += seen
            seen = found
            yield rows(batch.column(0), [packed(x) for x in codes], [], seen)
            if size >= CHUNK_CHARS:
                yield rows(None, None, list(code), seen)
                chunk, seen, size = chunk + 1, np.zeros(0, np.int64), 0
                code.clear()
        if code:
            yield rows(None, None, list(code), seen)

    return docs.select("doc_id", "text").mapInArrow(task, f"chunk bigint, doc_id {id_type}, codes binary, code int, unit string, n bigint")


def key_of(unit: Column) -> Column:
    """The unit, or a digest where it is long, so that rows of its tokens stay short."""
    return F.when(F.octet_length(unit) <= 40, unit).otherwise(F.sha2(unit, 256))


def _lost(docs: DataFrame, units: DataFrame, bad: DataFrame) -> DataFrame:
    """key, lost: how often units occur in documents that have one of the bad units."""
    named = units.select(F.col("chunk").alias("of"), "code", key_of(F.col("unit")).alias("key"))
    marks = named.join(bad, "key", "left_semi").select("of", "code")

    def count(docs: pa.Table, marks: pa.Table) -> pa.Table:
        wrong = np.unique(marks.column("code").to_numpy())
        hit = [x for x in (unpacked(c.as_py()) for c in docs.column("codes")) if np.isin(x, wrong).any()]
        code, n = np.unique(np.concatenate(hit), return_counts=True)
        return pa.table({"of": pa.array(np.full(len(code), marks.column("of")[0].as_py())), "code": pa.array(code.astype(np.int32)), "lost": pa.array(n)})

    touched = docs.join(marks.select(F.col("of").alias("chunk")).distinct(), "chunk", "left_semi")
    lost = touched.select("chunk", "codes").groupBy("chunk").cogroup(marks.groupBy("of")).applyInArrow(count, "of bigint, code int, lost bigint")
    return lost.join(named, ["of", "code"]).groupBy("key").agg(F.sum("lost").alias("lost"))


def aligned_units(docs: DataFrame, units: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The alignment of every distinct unit of coded documents, with counts over all of them: columns of summed()."""
    spark = docs.sparkSession

    def encoded() -> DataFrame:
        found = units.groupBy("unit").agg(F.sum("n").alias("n"))
        return stored(tokenized(found.select(key_of(F.col("unit")).alias("key"), F.col("unit").alias("text"), "n"), a_path, b_path), "tokens", True, "zstd")

    def by_text(tokens: DataFrame) -> DataFrame:
        bad, weighted = tokens.where("not whole").select("key"), tokens.where("whole")
        if not bad.isEmpty():
            left = weighted.join(_lost(docs, units, bad), "key", "left")
            weighted = left.select("key", (F.col("n") - F.coalesce("lost", F.lit(0))).alias("n"), "a", "b")
        good = groups(weighted.select("key", "n", "a", "b"), *lengths(spark, a_path, b_path), id_width(a_path, b_path))
        return stored(good.unionByName(bad, True), "groups", codec="zstd")

    tokens = encoded()
    grouped = by_text(tokens)
    dropped(spark, tokens)
    pairs = stored(pair_counts(grouped), "pairs")
    released(spark)
    known = stored(summed(grouped, F.broadcast(pairs) if pairs.count() <= PAIRS_BROADCAST else pairs), "known", codec="zstd")
    for df in (grouped, pairs):
        dropped(spark, df)
    return known


def frequent(known: DataFrame) -> DataFrame:
    """The rows of the most frequent short units, FREQUENT at most: all that occur a certain number of times."""
    short = known.where((F.octet_length("key") <= 40) & (F.col("n") > 0))
    step = F.floor(F.log2("n") * 16).cast("int")
    sizes = sorted(short.groupBy(step.alias("step")).count().collect(), reverse=True)  # a few hundred rows
    limit, total = None, 0
    for row in sizes:
        total += row["count"]
        if total > FREQUENT:
            break
        limit = row["step"]
    return short.where(step >= limit) if limit is not None else short.limit(0)


_KNOWN = ("n_best", "count_sum", "ids")
#: Units whose tokens are written out at once.
UNITS = 1 << 16
_NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def _put_together(docs: pa.Table, known: pa.Table, hot: pa.Table, width: int) -> pa.Table:
    """The documents of a chunk from its units' alignments; a frequent unit's is the row of hot with its place."""
    at_hot = known.column("place")
    common, rare = known.filter(at_hot.is_valid()), known.filter(at_hot.is_null())
    known = pa.concat_tables(
        [t.select(["code", *_KNOWN]) for t in (rare, hot.take(common.column("place")).append_column("code", common.column("code")))],
        promote_options="permissive",
    )
    place = np.empty(known.num_rows, np.int64)
    place[known.column("code").to_numpy()] = np.arange(known.num_rows)
    take = lambda c: known.column(c).combine_chunks().take(pa.array(place))
    number = lambda column: column.cast(pa.int64()).fill_null(0).to_numpy()
    packed = take("ids")
    whole, counts, ids = packed.is_valid().to_numpy(zero_copy_only=False), [np.zeros((0, 3), np.int64)], []
    for low in range(0, len(packed), UNITS):
        some, texts = unpacked_ids(packed.slice(low, UNITS), width)
        counts.append(some)
        ids += texts
    n_a, n_b, n_groups = np.concatenate(counts).T
    numbers = np.stack([n_a, n_b, n_groups, n_groups, number(take("n_best")), number(take("count_sum"))], axis=1)
    sums, digests = np.zeros((docs.num_rows, len(_NUMBERS)), np.int64), []
    for i, codes in enumerate(docs.column("codes")):
        at = unpacked(codes.as_py())
        if not whole[at].all():
            digests.append("")
            continue
        sums[i] = numbers[at].sum(axis=0)
        digests.append(hashlib.sha256(";".join(map(ids.__getitem__, at.tolist())).encode()).hexdigest())
    columns = {"doc_id": docs.column("doc_id")} | {c: pa.array(sums[:, k]) for k, c in enumerate(_NUMBERS)}
    return pa.table(columns | {"groups_sha256": pa.array(digests, pa.string())})


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of docs."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    both = stored(coded(source.where("text <> ''")), "coded", codec="zstd")
    texts = both.where("codes is not null").select("chunk", "doc_id", "codes")
    units = both.where("codes is null").select("chunk", "code", "unit", "n")
    released(docs.sparkSession)
    known = aligned_units(texts, units, a_path, b_path)
    released(docs.sparkSession)
    hot = frequent(known).select("key", *_KNOWN).toArrow()
    places = pa.table({"key": hot.column("key"), "place": pa.array(range(hot.num_rows), pa.int32())})
    width = id_width(a_path, b_path)
    shared = docs.sparkSession.sparkContext.broadcast(hot.drop_columns(["key"]))
    named = units.select(F.col("chunk").alias("of"), "code", key_of(F.col("unit")).alias("key"))
    named = named.join(F.broadcast(docs.sparkSession.createDataFrame(places)), "key", "left")
    rare = named.where("place is null").join(known.select("key", *_KNOWN), "key").drop("key")
    wanted = rare.unionByName(named.where("place is not null").drop("key"), True)
    result = f"doc_id {id_type}, " + "".join(f"{c} bigint, " for c in _NUMBERS) + "groups_sha256 string"
    full = texts.groupBy("chunk").cogroup(wanted.groupBy("of")).applyInArrow(lambda texts, known: _put_together(texts, known, shared.value, width), result)
    zeros = [F.lit(0).cast("long").alias(c) for c in _NUMBERS]
    return full.unionByName(source.where("text is null or text = ''").select("doc_id", *zeros, F.lit("").alias("groups_sha256")))


# ---- query ----


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document aligned; hashes are of the groups' ids ('' without tokens)."""
    small_batches(spark)
    # A relation that is dealt by text isn't dealt again by text and end.
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return aligned(spark.read.parquet(f"{sf_dir}/documents.parquet"), *public_vocabularies())
