"""Wu-Manber decontamination against a plain search over word lists."""

from __future__ import annotations

import random
import re

import pytest

from millrace.llm import decontamination as dec

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(docs, items):
    lower = lambda text: WORD.findall(re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))
    windows = {}
    for item, text in items:
        words = lower(text)
        for i in range(max(1, len(words) - 9) if words else 0):
            windows.setdefault(tuple(words[i : i + 10]), set()).update({str(item)} - {"None"})
    sizes = {len(w) for w in windows}
    for doc, text in docs:
        words, hit, of = lower(text), set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                if (w := tuple(words[i : i + size])) in windows:
                    hit |= set(range(i, i + size))
                    of |= windows[w]
        yield doc, len(words), sorted(hit), sorted(of)


def found(spark, docs, items):
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} string, text string").repartition(3)
    out = dec.contamination(frame(docs, "doc_id"), frame(items, "item_id")).collect()
    return sorted(
        ((r.doc_id, r.n_words, [k for x in r.hits for k in range(x.start, x.end)], list(r.items)) for r in out), key=str
    )


def random_case(seed):
    draw = random.Random(seed)
    words = ["a", "b", "cc", "the", "été", "中文", "x1", "longerword" * 3, "0"]
    text = lambda n: "".join(draw.choice(words).upper() + draw.choice([" ", ", ", "\n", "-", "__"]) for _ in range(n))
    items = [(str(i), text(draw.choice([0, 1, 2, 5, 9, 10, 11, 14, 40]))) for i in range(30)]
    items += [(None, items[3][1]), ("7", items[8][1]), ("copy", items[9][1]), ("void", None)]
    docs = [(str(i), text(draw.randint(0, 60)) + " " + draw.choice(items)[1 if draw.random() < 0.5 else 0].__str__() + " " + text(3)) for i in range(80)]
    docs += [("n", None), ("e", ""), ("s", ".,;"), (None, items[5][1]), (None, items[5][1]), ("long", text(3000) + items[6][1] + text(2000) + items[8][1])]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_plain_search(spark, seed):
    docs, items = random_case(seed)
    assert found(spark, docs, items) == sorted(plain(docs, items), key=str)


def test_blocks_of_items_and_cut_items_give_the_same(spark, monkeypatch):
    docs, items = random_case(4)
    want = sorted(plain(docs, items), key=str)
    monkeypatch.setattr(dec, "BLOCK_BYTES", 500)
    monkeypatch.setattr(dec, "PIECE_BYTES", 60)
    monkeypatch.setattr(dec, "PAIRS", 3)
    assert found(spark, docs, items) == want


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "One two", 5, "q"), (2, None, 6, "r")], "doc_id long, text string, item long, hits string")
    items = spark.createDataFrame([(9, "TWO", 1)], "item_id long, text string, words long")
    got = {r.doc_id: (r.n_words, [tuple(x) for x in r.hits], r["items"]) for r in dec.contamination(docs, items).collect()}
    assert got == {1: (2, [(1, 2)], ["9"]), 2: (0, [], [])}
    assert dec.contamination(docs.limit(0), items).collect() == []
    assert {r.doc_id: len(r.hits) for r in dec.contamination(docs, items.limit(0)).collect()} == {1: 0, 2: 0}


def test_shifts_never_skip_an_occurrence():
    draw = random.Random(3)
    for m in (3, 5, 9, 20, 40):
        strings = list({bytes(draw.choice(b"ab ") for _ in range(draw.randint(m, 2 * m - 1))) for _ in range(50)})
        text = bytes(draw.choice(b"ab ") for _ in range(5000)) + strings[0] * 3
        import numpy as np

        start, which = dec.StringClass(strings).find(np.frombuffer(text + bytes(8), np.uint8), len(text))
        want = {(i, k) for k, s in enumerate(strings) for i in range(len(text)) if text.startswith(s, i)}
        assert set(zip(start.tolist(), which.tolist())) == want
