import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import language_id as li

SYLLABLES = {
    "aa": ["ba", "ko", "lu", "mi", "sta"],
    "bb": ["th", "er", "ing", "on", "ee"],
    "cc": ["sch", "ü", "en", "ge", "ßt"],
}


def prose(lang, n, seed):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(SYLLABLES[lang], rng.integers(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, prose(lang, 5 + i % 60, i), lang, 1.0) for i in range(900) for lang in [list(SYLLABLES)[i % 3]]]
    rows += [(901, None, "aa", 1.0), (902, "12 -- !!", "aa", 1.0), (903, "", None, 1.0), (904, prose("aa", 9, 1), None, 1.0)]
    rows += [(905, "漢字かな交じり文" * 40, None, 1.0), (4, rows[4][1], rows[4][2], 1.0), (None, prose("bb", 50, 3), "bb", 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double").cache()


@pytest.fixture(scope="module")
def model(docs):
    return li.learn(docs.where(li.learnable()), per_language=120)


def test_held_out_accuracy(docs, model):
    got = li.identify(docs, model).join(docs.select("doc_id", "lang", li.held_out().alias("h")).distinct(), "doc_id").collect()
    held = [r for r in got if r.h and r.lang and r.doc_id < 900]
    assert len(held) > 200
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.99
    assert all(r.accepted and 0 <= r.score <= 1 for r in held)


def test_defined_cases(docs, model):
    got = {r.doc_id: r for r in li.identify(docs, model).collect()}
    for i in (901, 902, 903):
        assert (got[i].lang_pred, got[i].score, got[i].accepted) == ("und", 0.0, False)
    assert got[904].lang_pred == "aa"
    assert not got[905].accepted and got[905].lang_pred in SYLLABLES
    kept = {r.doc_id for r in li.accepted(docs, model).collect()}
    assert kept == {i for i, r in got.items() if r.accepted}
    assert li.accepted(docs, model).columns == docs.columns


def test_without_labels_or_rows(spark, docs, model):
    none = li.learn(docs.where("lang = 'zz'"))
    assert {(r.lang_pred, r.score) for r in li.identify(docs, none).collect()} == {("und", 0.0)}
    assert li.identify(docs.limit(0), model).count() == 0


def test_probabilities_sum_to_one_and_equal_plain_kneser_ney():
    texts = [prose("aa", 30, i) for i in range(8)]
    code, _, scored = li.symbols(texts)
    at = np.flatnonzero(scored)
    hashes = li.gram_hashes(code)
    grams = defaultdict(Counter)
    for i in at:
        for n in range(1, li.ORDER + 1):
            grams[n][tuple(code[i - n + 1 : i + 1])] += 1
    where = {}
    rows = []
    for n in grams:
        for g, c in grams[n].items():
            i = next(i for i in at if tuple(code[i - n + 1 : i + 1]) == g)
            where[g] = i
            h = [hashes[n - 1][i], hashes[n - 2][i - 1] if n > 1 else 0, hashes[n - 2][i] if n > 1 else 0]
            rows.append(("aa", n, *(int(np.uint64(x).astype(np.int64)) for x in h), c))
    names = ["lang", "n", "gram", "context", "lower", "count"]
    model = li.build(pa.table({k: [r[i] for r in rows] for i, k in enumerate(names)}))

    size = len(grams[1]) + 1

    def plain(gram, n):
        if n == 0:
            return 1 / size
        count = lambda g: grams[n][g] if n == li.ORDER else sum(1 for x in grams[n + 1] if x[1:] == g)
        counts = {g: count(g) for g in grams[n]}
        once, twice = (sum(1 for c in counts.values() if c == k) for k in (1, 2))
        d = once / (once + 2 * twice) if once and twice else 0.5
        of = [g for g in counts if g[:-1] == gram[:-1]]
        total = sum(counts[g] for g in of)
        if not total:
            return plain(gram[1:], n - 1)
        kinds = sum(1 for g in of if counts[g] > 0)
        return max(counts.get(gram, 0) - d, 0) / total + d * kinds / total * plain(gram[1:], n - 1)

    got = model.log_probabilities(hashes, at[:40])[:, 0]
    for i, g in zip(at[:40], got):
        assert math.isclose(math.exp(g), plain(tuple(code[i - li.ORDER + 1 : i + 1]), li.ORDER), rel_tol=1e-4)


def test_long_texts_are_scored_in_pieces(model, monkeypatch):
    text = prose("bb", 4000, 77)
    whole = model.cross_entropies([text])
    monkeypatch.setattr(li, "PIECE", 3000)
    parts = model.cross_entropies([text, "", "short bb"])
    assert abs(parts[0][0] - whole[0][0]) <= 10 and np.allclose(parts[1][0], whole[1][0], atol=0.02)


@pytest.mark.parametrize("piece", [1, 7, 64, 1000])
def test_pieces_change_nothing(model, monkeypatch, piece):
    texts = [prose("bb", 400, 7), "A" + " -!" * 300 + "b" + "?" * 700 + prose("aa", 60, 3), "", "x\0y \0\0 ÜBER", "9" * 500 + "ab"]
    whole = model.cross_entropies(texts)
    counts = pa.Table.from_batches(li._gram_batches(texts, np.array(["aa"] * 5, object))).group_by("gram").aggregate([("count", "sum")])
    monkeypatch.setattr(li, "PIECE", piece)
    parts = model.cross_entropies(texts)
    assert np.array_equal(whole[0], parts[0]) and np.allclose(whole[1], parts[1], rtol=1e-6)
    again = pa.Table.from_batches(li._gram_batches(texts, np.array(["aa"] * 5, object))).group_by("gram").aggregate([("count", "sum")])
    key = lambda t: sorted(zip(t.column("gram").to_pylist(), t.column("count_sum").to_pylist()))
    assert key(counts) == key(again)


def test_junk_is_rejected_also_beside_an_odd_calibration_document(spark):
    rows = [(i, prose(lang, 60 + i % 40, i), lang) for i in range(600) for lang in [list(SYLLABLES)[i % 3]]]
    rows += [(900 + i, "zq xv wj kp " * 120, "aa") for i in range(3)]  # a few labelled documents that are junk
    model = li.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    clean = [prose(lang, 80, 5000 + i) for i in range(30) for lang in SYLLABLES]
    rng = np.random.default_rng(5)
    shuffled = ["".join(rng.permutation(list(t))) for t in clean]
    foreign = ["огонь вода земля ветер снова и снова " * 8, "qwxz jvk pfg zzxq wvv kjh " * 12, "漢字かな交じり文" * 40]
    assert model.judge(clean)[2].all()
    assert not model.judge(foreign)[2].any()
    assert model.judge(shuffled)[2].mean() < 0.02


@pytest.mark.parametrize("labelled", [1, 2, 4])
def test_long_documents_of_a_rare_language_stay(spark, labelled):
    rng = np.random.default_rng(8)
    stems = ["".join(rng.choice(list("abdefghiklmnoprstuvz"), rng.integers(2, 9))) for _ in range(1500)]
    wide = lambda n, seed: " ".join(np.random.default_rng(seed).choice(stems, n))
    rows = [(i, prose(lang, 60, i), lang) for i in range(120) for lang in [["aa", "bb"][i % 2]]]
    rows += [(1000 + i, wide(150, i), "rare") for i in range(labelled)]
    model = li.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    names, _, good = model.judge([wide(400 + 20 * i, 500 + i) for i in range(12)])
    assert set(names) == {"rare"} and good.all()
    assert not model.judge(["漢字かな交じり文" * 200])[2].any()


def test_one_id_for_a_whole_language_neither_loses_nor_gathers_it(spark):
    rows = [(7, f"english words number {i}", "en") for i in range(400)] + [(i, f"mots et phrases {i}", "fr") for i in range(400)]
    rows += [(8, "same row", "de")] * 300 + [(9, "another", "de")]
    got = li.sample_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 100).collect()
    count = lambda lang: sum(r.lang == lang for r in got)
    assert 60 <= count("en") <= 100 and 60 <= count("fr") <= 100 and count("de") == 2
