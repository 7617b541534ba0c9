import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from millrace.llm import byte_bpe

TEXTS = [
    "Plain words, don't they've 12345  three   spaces\n\n\tEnd. ",
    "Été größer ñandú — “quotes” … naïve café",
    "日本語のテキスト 한국어 العربية हिन्दी",
    "\U0001f468‍\U0001f469‍\U0001f467 \U00020000 é́   \u0085x",
    "a" * 3000 + " " * 500 + "x" + "\n" * 100,
    "'s 't 'RE <|endoftext|> \x00\x01",
    "",
    None,
]


@pytest.fixture(scope="module")
def reference():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equals_tiktoken_and_round_trips(spark, reference):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = byte_bpe.round_trip(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        text = TEXTS[r.doc_id] or ""
        ids = reference.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_offsets_cover_the_text(spark, reference):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in byte_bpe.encode(docs, *byte_bpe.public_vocabulary(), offsets=True).collect():
        text = TEXTS[r.doc_id] or ""
        ids = np.frombuffer(r.ids, "<u4").tolist()
        _, starts = reference.decode_with_offsets(ids)
        assert list(r.starts) == starts
        assert not text or (r.starts[0] == 0 and r.ends[-1] == len(text))
        assert all(a < b for a, b in zip(r.starts, r.ends))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.round_trip(docs).count() == 0


def test_small_table_of_pieces(monkeypatch, reference):
    monkeypatch.setattr(byte_bpe, "PIECES", 10)
    model = byte_bpe.Codec(*byte_bpe.public_vocabulary())
    for text in TEXTS[:6] * 2:
        assert np.frombuffer(model.encode([text])[0], "<u4").tolist() == reference.encode_ordinary(text)
