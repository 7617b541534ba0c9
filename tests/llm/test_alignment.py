"""Token alignment against a plain version that encodes each whole text."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from millrace.llm import alignment
from millrace.llm.common import table

pytest.importorskip("public_tokenizers")


def plain(texts, both):
    rows, linked = [], Counter()
    for text in texts:
        a = both.a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = both.b.encode(text) if text else []
        a_bytes, b_bytes = [both.a_bytes[i] for i in a], [both.b_bytes[i] for i in b]
        if not text or not b"".join(a_bytes) == (" " + text).encode() == b"".join(b_bytes):
            rows.append(None)
            continue
        ends = []
        for ids, tokens in ((a, a_bytes), (b, b_bytes)):
            at, found = 0, {}
            for i, token in zip(ids, tokens):
                at += len(token)
                found[at] = i
            ends.append(found)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        parts = []
        left = [sorted(side.items(), reverse=True) for side in ends]
        for cut in cuts:
            now = [[], []]
            for k in (0, 1):
                while left[k] and left[k][-1][0] <= cut:
                    now[k].append(str(left[k].pop()[1]))
            parts.append("|".join(map(",".join, now)))
        links = [(ends[0][c], ends[1][c]) for c in cuts]
        linked.update(links)
        rows.append((len(a), len(b), links, ";".join(parts)))
    best = Counter()
    for (_, b), n in linked.items():
        best[b] = max(best[b], n)
    for row in rows:
        if row is None:
            yield 0, 0, 0, 0, 0, 0, ""
        else:
            n_a, n_b, links, parts = row
            good = sum(linked[x] == best[x[1]] for x in links)
            yield n_a, n_b, len(links), len(links), good, sum(map(linked.__getitem__, links)), hashlib.sha256(parts.encode()).hexdigest()


def check(spark, docs):
    """docs: with doc_id and text first."""
    paths = alignment.public_vocabularies()
    rows = docs.collect()
    got = sorted((tuple(r) for r in alignment.aligned(docs, *paths).collect()), key=str)
    want = sorted(((r[0], *x) for r, x in zip(rows, plain([r[1] for r in rows], alignment.vocabularies(*paths)))), key=str)
    assert got == want
    return got


def test_odd_texts_nulls_repeats_and_clashing_columns(spark):
    draw = random.Random(7)
    letters = [*"ab cé ñ'.,!?  \t\n12▁ 　中文😀́ \x00​", "<|endoftext|>", "<s>", " the", " of", "  "]
    texts = [None, "", " ", "  ", "a", "▁", "x ▁ the of", "the of the", "the of the"]
    texts += ["".join(draw.choice(letters) for _ in range(draw.randint(1, 60))) for _ in range(300)]
    texts += ["x" * 5000, "aé" * 3000, " ".join(["of the"] * 4000)]
    rows = [(i // 2 if i % 7 else None, text, 1, 2, "x") for i, text in enumerate(texts)]
    got = check(spark, spark.createDataFrame(rows, "doc_id long, text string, chunk int, key int, unit string").repartition(3))
    assert sum(row[1] == 0 for row in got) > 20


def test_only_empty_texts_and_no_rows(spark):
    docs = spark.createDataFrame([(1, ""), (None, None)], "doc_id long, text string")
    assert {tuple(r)[1:] for r in check(spark, docs)} == {(0, 0, 0, 0, 0, 0, "")}
    assert check(spark, docs.limit(0)) == []


def test_chunks_and_batches_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"{'le petit of ' * (i % 5)}mot{i % 9} the{i}") for i in range(200)], "doc_id long, text string")
    one = check(spark, docs.repartition(4))
    monkeypatch.setattr(alignment, "CHUNK_CHARS", 100)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert check(spark, docs.repartition(2)) == one
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_pairs_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(alignment, "PAIRS_BROADCAST", 0)
    check(spark, spark.createDataFrame([(i, "the cat sat on the mat, the end") for i in range(5)], "doc_id long, text string"))


def test_query_equals_the_plain_version(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in alignment.op11_token_alignment(spark, sf_dir).collect())
    want = plain([r.text for r in docs], alignment.vocabularies(*alignment.public_vocabularies()))
    assert got == sorted((r.doc_id, *x) for r, x in zip(docs, want))


def test_without_frequent_units_and_with_them_alone(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"the same words {i % 3} ▁"[: 16 + i % 4]) for i in range(50)], "doc_id long, text string")
    one = check(spark, docs)
    monkeypatch.setattr(alignment, "FREQUENT", 0)
    assert check(spark, docs) == one


@pytest.mark.parametrize("width", [2, 4])
def test_packed_ids(width):
    import numpy as np

    draw = random.Random(width)
    texts = [[(draw.randint(1, 12), draw.randint(1, 12)) for _ in range(draw.randint(1, 9))] for _ in range(200)]
    tokens, last, sizes, want = [], [], [], []
    for groups in texts:
        parts = [[draw.randrange(60_000) for _ in range(k)] for group in groups for k in group]
        tokens += sum(parts, [])
        last += [k + 1 == len(p) for p in parts for k in range(len(p))]
        sizes.append(sum(map(len, parts)))
        sides = [",".join(map(str, p)) for p in parts]
        want.append(";".join(f"{a}|{b}" for a, b in zip(sides[::2], sides[1::2])))
    packed = alignment.packed_ids(np.array(tokens), np.array(last), np.array(sizes), width)
    counts, got = alignment.unpacked_ids(packed, width)
    assert got == want
    assert counts.tolist() == [[sum(a for a, _ in g), sum(b for _, b in g), len(g)] for g in texts]
