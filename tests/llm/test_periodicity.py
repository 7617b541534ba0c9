"""Periodic runs against a plain search by definition."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from millrace.llm import periodicity
from millrace.llm.common import table


def smallest_period(words):
    """By the failure function of the prefix match."""
    fail, k = [0] * len(words), 0
    for i in range(1, len(words)):
        while k and words[i] != words[k]:
            k = fail[k - 1]
        k += words[i] == words[k]
        fail[i] = k
    return len(words) - fail[-1]


def plain(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q) and smallest_period(words[i : i + length]) == q:
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def texts(draw):
    for _ in range(150):
        letters = "ab" if draw.random() < 0.4 else "abcdefgh"
        unit = [draw.choice(letters) for _ in range(draw.randint(1, 9))]
        words = [draw.choice(letters) for _ in range(draw.randint(0, 20))] + unit * draw.randint(0, 9)
        words += unit[: draw.randint(0, len(unit))] + [draw.choice(letters) for _ in range(draw.randint(0, 20))]
        yield words * draw.choice([1, 1, 1, 4, 5])


@pytest.mark.parametrize("long", [4096, 1])
def test_equals_plain_search(monkeypatch, long):
    monkeypatch.setattr(periodicity, "LONG", long)
    for words in [[], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 100, ["a", "b"] * 4, ["a", "b"] * 3 + ["a"], *texts(random.Random(long))]:
        assert periodicity.runs(periodicity.numbered([w.encode() for w in words])) == plain(words), words


def test_long_documents():
    draw = random.Random(2)
    words = [draw.choice("abcdefghijklmnop") for _ in range(9000)]
    words[1000:1800] = words[1000:1100] * 8
    words[5000:6000] = ["x", "y"] * 500
    got = periodicity.runs(periodicity.numbered([w.encode() for w in words]))
    assert got == plain(words)
    assert {q for *_, q in got} >= {2, 100}
    assert periodicity.runs(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    found = plain(words)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    top = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    return doc_id, len(found), *best, sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in dropped))


def test_query_equals_plain_version_on_every_short_document(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    got = {r.doc_id: tuple(r) for r in periodicity.op13_bit_parallel_lags(spark, sf_dir).collect()}
    assert got.keys() == docs.keys()
    for doc_id, text in docs.items():
        if len(text or "") < 8000:
            assert got[doc_id] == expected(doc_id, text)
    assert sum(r[1] > 0 for r in got.values()) > 10


def test_nulls_repeats_odd_spaces_and_clashing_columns(spark):
    rows = [(1, "a b " * 6, 1), (1, "a b " * 6, 2), (None, "x y " * 8, 3), (2, None, 4), (3, " \t\n", 5), (4, "\x1fa " * 7 + "é é " * 9, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = periodicity.periodic_runs(docs)
    by = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got.collect()), key=str)
    want = [(d, len(w := re.findall(r"[^\x20\x09-\x0D]+", t or "")), plain(w)) for d, t, _ in rows]
    assert [x[:3] for x in by] == sorted(want, key=str)
    assert {x[0]: x[3] for x in by}[1] == "a b"
    assert periodicity.periodic_runs(docs.limit(0)).collect() == []
