import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest

from millrace.llm import near_dup as nd

RNG = np.random.default_rng(11)
WORDS = ["".join(RNG.choice(list("abcdefghijklmnopqrstuvwxyzéß"), RNG.integers(2, 9))) for _ in range(800)]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def changed(text, n, seed):
    words = text.split(" ")
    rng = np.random.default_rng(seed)
    for i in rng.choice(len(words), n, replace=False):
        words[i] = f"new{seed}x{i}"
    return " ".join(words)


def bag(text):
    w = re.findall(r"\w+", text.lower())
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def similarity(a, b):
    if {*a.values(), *b.values()} == {1}:  # the sum below is the plain Jaccard similarity then
        return len(a.keys() & b.keys()) / len(a.keys() | b.keys())
    return sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in a.keys() | b.keys()) for i in a.keys() & b.keys())


@lru_cache(maxsize=2)
def _brute(rows):
    parent = {i: i for i, _ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bags = {i: bag(t) if t is not None else None for i, t in rows}
    texts = dict(rows)
    ids = list(parent)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if bags[a] is None or bags[b] is None:
                continue
            same = texts[a] == texts[b] if not bags[a] or not bags[b] else similarity(bags[a], bags[b]) >= 0.8 - 1e-9
            if same:
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {i: top(i) for i in ids}


def brute_classes(rows):
    return _brute(tuple(rows))


def test_words_and_shingles_equal_plain_python():
    texts = [prose(40, 1), "One, two; three", "", "ÀÉ_9 x\ny" * 30, "a b c d e a b c d e a b c d e", "... !!"]
    owner, word = nd.words(texts)
    assert np.bincount(owner, minlength=len(texts)).tolist() == [len(re.findall(r"\w+", t.lower())) for t in texts]
    of, _, times = nd.shingles(len(texts), owner, word)
    for i, t in enumerate(texts):
        assert sorted(times[of == i].tolist()) == sorted(bag(t).values())
    long = [prose(3000, 2)]
    whole = nd.words(long)
    nd_chunk, nd.CHUNK = nd.CHUNK, 1000
    try:
        assert np.array_equal(nd.words(long)[1], whole[1])
    finally:
        nd.CHUNK = nd_chunk


def test_probability_jaccard_equals_its_definition():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 20, 12)) for _ in range(2))
        x, y = (rng.integers(1, 5, len(k)) for k in (a, b))
        want = similarity(Counter(dict(zip(a.tolist(), x.tolist()))), Counter(dict(zip(b.tolist(), y.tolist()))))
        assert abs(nd.probability_jaccard(a, x, b, y) - want) < 1e-12


def test_registers_estimate_probability_jaccard():
    a = prose(400, 5)
    texts = [a, changed(a, 20, 6), a + " " + a[: len(a) // 2], prose(400, 7)]
    owner, word = nd.words(texts)
    first = nd.prob_min_hash(len(texts), *nd.shingles(len(texts), owner, word))
    for i in range(1, len(texts)):
        assert abs((first[0] == first[i]).mean() - similarity(bag(a), bag(texts[i]))) < 0.11


@pytest.fixture(scope="module")
def rows():
    out = []
    for k in range(12):  # groups around one text, the further ones only linked over others
        base = prose(150, 100 + k)
        out += [base, base, changed(base, 1, k), changed(base, 2, k + 50), changed(changed(base, 2, k + 60), 2, k + 70)]
    hub = prose(120, 999)
    out += [changed(hub, 1 + i % 7, 2000 + i) for i in range(150)] + [hub] * 40
    out += ["", "", None, None, "two words", "two  WORDS!", "...", "...", "?!", "x " * 4000, "x " * 4000 + "y"]
    return list(enumerate(out))


@pytest.mark.parametrize("block", [512, 16])
def test_classes_equal_brute_force(spark, rows, block, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", block)
    table = spark.createDataFrame([(i, t, i, "n") for i, t in rows], "doc_id long, text string, class_id long, node string")
    got = {r.doc_id: r.class_id for r in nd.classes(table).collect()}
    assert got == brute_classes(rows)


def test_deduplicated_keeps_one_of_each_class(spark, rows):
    more = [*rows, (3, rows[3][1]), (None, "no id"), (None, "no id")]
    table = spark.createDataFrame([(t, i, 1) for i, t in more], "text string, doc_id long, band int")
    kept = nd.deduplicated(table)
    assert kept.columns == table.columns
    got = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in got if x is not None) == sorted(set(brute_classes(rows).values()))
    assert got.count(None) == 1  # one document of each group stays, with an id or without


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert nd.classes(empty).count() == 0 and nd.deduplicated(empty).count() == 0


def test_an_id_of_several_texts_counts_for_each(spark):
    a, b, c = prose(60, 1), prose(60, 2), prose(60, 3)
    rows = [(3, a), (5, a), (5, b), (6, b), (7, c), (7, prose(60, 4)), (8, None), (8, prose(60, 5)), (8, None)]
    rows += [(7, c), (None, changed(a, 1, 9)), (None, prose(60, 6)), (9, c)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in nd.deduplicated(table).collect()), key=str)
    want = [(3, a), (5, b), (7, c), (7, prose(60, 4)), (8, None), (8, prose(60, 5)), (None, prose(60, 6))]
    assert got == sorted(want, key=str)


def test_unrelated_rows_of_one_id_and_links_over_nameless_rows(spark):
    a, other = prose(150, 70), prose(150, 71)
    b = changed(a, 1, 5)
    c = changed(b, 1, 6)
    table = spark.createDataFrame([(1, a), (None, b), (3, c), (9, other), (9, prose(150, 72))], "doc_id long, text string")
    got = {(r.doc_id, r.text): r.class_id for r in nd.classes(table).join(table, "doc_id").collect()}
    assert got[1, a] == got[3, c] == 1
    assert sorted(r.doc_id for r in nd.deduplicated(table).collect()) == [1, 9, 9]


def test_rows_without_an_id_are_linked(spark):
    base = prose(150, 40)
    rows = [(None, base), (None, changed(base, 1, 1)), (4, changed(base, 2, 2))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.class_id for r in nd.classes(table).collect()] == [4, 4, 4]


def test_clashing_columns_are_kept(spark):
    rows = [(1, "one two three four five six", "a", 1, 2), (2, "one two three four five six", "b", 3, 4), (None, None, "c", 5, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept_id string, kept_key int, _kept int")
    got = nd.deduplicated(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[0], rows[2]], key=str)
