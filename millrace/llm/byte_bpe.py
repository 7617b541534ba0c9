"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

Texts are cut by the pattern of the vocabulary; each piece's UTF-8 bytes are written as the byte-level alphabet's
characters and merged by the library. Pieces that a task meets again come from a bounded table of encoded pieces,
kept in two generations: those met since the last turn stay, the others go.
Offsets come from the tokens' byte lengths and the map from bytes to characters, so a token that holds part of a
character gets that character's place. Decoding puts each id's bytes back by the reversed table; bytes of a
character that two tokens share meet again as the document's bytes are joined.

Defined cases: a null text is an empty one (no ids); repeated rows give repeated results; an empty table gives none;
other columns of the input are ignored; texts are encoded whole, whatever their length.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import small_batches

#: Encoded pieces in a generation of the table that a task remembers; there are two.
PIECES = 150_000
#: Documents that are held as Python strings at once.
ROWS = 64


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next one from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Codec:
    """The vocabulary of one ranks file as a tokenizers model, and the pattern that cuts texts."""

    def __init__(self, ranks_path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals the work; threads of a task only cost more CPU
        from tokenizers import Tokenizer, models, pre_tokenizers

        ranks = read_ranks(ranks_path)
        letters = byte_alphabet()
        written = {token: "".join(letters[b] for b in token) for token in ranks}
        merges = [
            (rank, ranks[token[:i]], written[token[:i]], written[token[i:]])
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        ]
        merges.sort(key=lambda m: m[:2])
        self.tokenizer = Tokenizer(
            models.BPE(
                vocab={written[token]: rank for token, rank in ranks.items()},
                merges=[m[2:] for m in merges],
                ignore_merges=True,
            )
        )
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.pattern = regex.compile(pattern)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        cut = [self.pattern.findall(text) for text in texts]
        if len(self.known) > PIECES:
            self.known, self.older = {}, self.known
        new = []
        for piece in set().union(*cut).difference(self.known):
            ids = self.older.get(piece)
            if ids is None:
                new.append(piece)
            else:
                self.known[piece] = ids
        found = [got.ids for got in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
        data = np.fromiter(chain.from_iterable(found), "<u4").tobytes()
        at = 0
        for piece, ids in zip(new, found):
            self.known[piece] = data[at : at + 4 * len(ids)]
            at += 4 * len(ids)
        return [b"".join(map(self.known.__getitem__, pieces)) for pieces in cut]


class Table:
    """The bytes of each id: what decoding and offsets need."""

    def __init__(self, ranks_path: str):
        ranks = read_ranks(ranks_path)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.lengths = np.array([len(token) for token in self.tokens], np.int64)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def offsets(self, text: str, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First character of each token, and the one after its last."""
        data = np.frombuffer(text.encode(), np.uint8)
        char = np.cumsum((data & 0xC0) != 0x80) - 1
        ends = np.cumsum(self.lengths[np.frombuffer(ids, "<u4")])
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
        return char[starts], char[ends - 1] + 1


@lru_cache(maxsize=2)
def codec(ranks_path: str, pattern: str) -> Codec:
    """One codec for each Python worker."""
    return Codec(ranks_path, pattern)


@lru_cache(maxsize=2)
def table(ranks_path: str) -> Table:
    return Table(ranks_path)


def public_vocabulary() -> tuple[str, str]:
    """The multilingual byte-level vocabulary that the box offers: path of its ranks and its pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate([*arrays, np.zeros(0, np.int32)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def encode(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    offsets: bool = False,
) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit), and with offsets: starts, ends (arrays of the
    first character of each token and of the one after its last)."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(ranks_path, pattern)
        for batch in _slices(batches):
            texts = batch.column(1).to_pylist()
            ids = model.encode(texts)
            columns = [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            names = ["doc_id", "n_tokens", "ids"]
            if offsets:
                spans = [table(ranks_path).offsets(text, x) for text, x in zip(texts, ids)]
                columns += [_lists([s[k] for s in spans]) for k in (0, 1)]
                names += ["starts", "ends"]
            yield pa.RecordBatch.from_arrays(columns, names)

    more = ", starts array<int>, ends array<int>" if offsets else ""
    return source.mapInArrow(task, f"doc_id {id_type}, n_tokens bigint, ids binary{more}")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """The columns of encoded and the decoded bytes; F.decode(bytes, 'UTF-8') gives the text."""
    at, names = encoded.columns.index("ids"), [*encoded.columns, "bytes"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = table(ranks_path)
        for batch in _slices(batches):
            data = pa.array([model.decode(x) for x in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, data], names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(task, f"{kinds}, bytes binary")


# ---- query ----


def round_trip(docs: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, offsets_hash (of starts and ends) of each document, and with_ids
    ids (binary, little-endian unsigned 32-bit)."""
    ranks_path, pattern = public_vocabulary()
    encoded = encode(docs, ranks_path, pattern, offsets=True)
    offsets = F.xxhash64("starts", "ends").alias("offsets_hash")
    return decode(encoded.select("doc_id", "n_tokens", "ids", offsets), ranks_path).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
        "offsets_hash",
        *(["ids"] if with_ids else []),
    )


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
