import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from millrace.llm import fingerprints as fp

RNG = np.random.default_rng(5)
WORDS = ["".join(RNG.choice(list("abcdefghijklmnopqrstuvwxyzé"), RNG.integers(2, 9))) for _ in range(500)]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def brute_class(window: bytes) -> int:
    total = sum(fp._NLOGN[k] for k in Counter(window).values())
    return int((6 * 64 * fp._SCALE - int(total)) * 1000 // (6 * 64 * fp._SCALE))


def test_entropy_classes_equal_brute_force():
    for data in (prose(60, 1).encode(), b"a" * 200, bytes(range(256)), b"ab" * 40, b"x" * 64):
        got = fp.entropy_classes(np.frombuffer(data, np.uint8))
        assert got.tolist() == [brute_class(data[i : i + 64]) for i in range(len(data) - 63)]


def brute_features(data: bytes, rank) -> list[int]:
    if len(data) < 64:
        return []
    order = [int(rank[brute_class(data[i : i + 64])]) for i in range(len(data) - 63)]
    points = Counter(min(range(i, i + 64), key=lambda j: (order[j], j)) for i in range(len(order) - 63))
    out = [i for i in sorted(points) if points[i] >= fp.POINTS and order[i] < fp._WEAK]
    return out or [min(range(len(order)), key=lambda j: (order[j], j))]


def test_features_equal_brute_force_in_any_company():
    texts = [prose(n, n).encode() for n in (1, 12, 30, 80, 200)] + [b"", b"z" * 500, b"q" * 64, b"short"]
    rank = fp.ranks(fp.class_counts(texts))
    counts = Counter(brute_class(t[i : i + 64]) for t in texts for i in range(len(t) - 63))
    assert fp.class_counts(texts).tolist() == [counts[c] for c in range(1001)]
    owner, place = fp.features(np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts]), rank)
    starts = np.cumsum([0] + [len(t) for t in texts])
    for i, text in enumerate(texts):
        assert (place[owner == i] - starts[i]).tolist() == brute_features(text, rank)
    alone = [fp.digests([t], rank)[0] for t in texts]
    for a, b in zip(alone, fp.digests(texts, rank)):
        assert np.array_equal(a, b)
        assert np.array_equal(fp.from_text(fp.as_text(a)), a)


def test_likeness():
    a, b = prose(900, 1), prose(900, 2)
    rank = fp.ranks(fp.class_counts([a.encode(), b.encode()]))
    da, db, half = fp.digests([a.encode(), b.encode(), fp.edited(a, b).encode()], rank)
    assert fp.likeness(da, da) == 1
    assert fp.likeness(da, db) < 0.1 < 0.25 < fp.likeness(da, half) < 1
    none = fp.digests([b""], rank)[0]
    assert fp.likeness(none, none) == 1 and fp.likeness(none, da) == 0


@pytest.mark.parametrize("rows", [1, 2, 3, 300])
def test_query_pairs_every_document_with_the_next(spark, rows, monkeypatch):
    monkeypatch.setattr(fp, "RANGE_ROWS", 16)
    texts = {i * 7 % 1009 * 10**15: prose(i % 40, i) if i % 9 else None for i in range(rows)}
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, range string")
    rank = fp.ranks(np.arange(1001))
    got = {r.doc_id: r for r in fp.compare_with_next(docs, rank).collect()}
    order = sorted(texts, reverse=True)
    assert sorted(got) == sorted(texts)
    for i, doc in enumerate(order):
        own, nxt = texts[doc] or "", texts[order[(i + 1) % len(order)]] or ""
        changed = fp.edited(own, nxt)
        r = got[doc]
        assert r.n_chars == len(own)
        assert r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        a, b, c = (fp.digests([t.encode()], rank)[0] for t in (own, nxt, changed))
        assert r.fingerprint == fp.as_text(a) and r.edited_fingerprint == fp.as_text(c)
        assert math.isclose(r.near_edited, fp.likeness(a, c)) and math.isclose(r.near_next, fp.likeness(a, b))


def test_repeated_null_and_missing_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (2, None)], "doc_id long, text string")
    got = fp.compare_with_next(docs, fp.ranks(np.arange(1001))).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "2", "None"]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fp.compare_with_next(empty, fp.rarity(empty)).count() == 0
