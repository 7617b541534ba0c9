import numpy as np
import pytest

from millrace.llm import mixing


def test_rake_meets_the_marginals():
    rng = np.random.default_rng(2)
    amount = rng.uniform(1, 50, 24)
    places = [np.repeat(np.arange(4), 6), np.tile(np.repeat(np.arange(3), 2), 4), np.tile(np.arange(2), 12)]
    targets = [np.array([0.4, 0.3, 0.2, 0.1]), np.array([0.5, 0.25, 0.25]), np.array([0.7, 0.3])]
    share = mixing.rake(amount, places, targets, 60)
    for place, target in zip(places, targets):
        assert np.allclose(np.bincount(place, share), target)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (i, "word " * (i % 50) + ("a@b " if i % 3 else "") + "end", ["en", "fr", None][i % 3 if i % 7 else 0],
         "hot" if i % 4 else f"s{i % 5}", i, 1.0)
        for i in range(6000)
    ]
    rows += [(None, None, None, None, 1, 1.0), (5, "", "en", "hot", 2, 1.0)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_tokens long, probability double"
    ).cache()


def test_sample_meets_the_targets(docs):
    targets = {"source": {"hot": 0.4, "s0": 0.6}, "lang": mixing.Power(0.5), "topic": mixing.Power(1.0)}
    rows = mixing.calibrated(docs, targets).collect()
    assert len(rows) == docs.count()
    kept = [r for r in rows if r.kept]
    total = sum(r.n_tokens for r in kept)
    hot = sum(r.n_tokens for r in kept if r.source == "hot") / total
    assert abs(hot - 0.4) < 0.05
    assert {r.source for r in kept} == {"hot", "s0"}
    assert max(r.probability for r in rows) == 1.0


def test_sampled_keeps_own_columns(docs):
    targets = mixing.TARGETS
    kept = mixing.sampled(docs, targets)
    assert kept.columns == docs.columns
    flags = [r for r in mixing.calibrated(docs, targets).collect() if r.kept]
    got = kept.collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in flags)
    assert all(r.n_tokens < 6000 and r.probability == 1.0 for r in got)
    assert any(r.lang is None for r in got)


def test_empty_and_untargeted(spark, docs):
    assert mixing.calibrated(docs.limit(0), mixing.TARGETS).count() == 0
    assert mixing.sampled(docs, {"source": {"none": 1.0}}).count() == 0


def test_scale_meets_the_share():
    rng = np.random.default_rng(5)
    amount, ratio = rng.uniform(1, 1e6, 300), rng.lognormal(0, 4, 300)
    ratio[:20] = 0
    for share in (0.0, 0.1, 0.5, 0.8):
        p = np.minimum(1, mixing.scale(amount, ratio, share) * ratio)
        plain = (amount * ratio).sum() / ratio.max() / amount.sum()
        assert np.isclose((p * amount).sum() / amount.sum(), max(share, plain))
    assert np.minimum(1, mixing.scale(amount, ratio, 1.0) * ratio)[20:].min() == 1
    assert mixing.scale(amount, ratio * 0, 0.5) == 0


@pytest.mark.parametrize("rare", ["word " * 99 + "end", "x"])
def test_a_rare_source_and_a_hot_one_leave_the_share(spark, rare):
    rows = [(i, "word " * (50 + i % 90) + "end", ["en", "fr"][i % 2], "hot" if i % 3 == 0 else f"s{i % 20}") for i in range(6000)]
    rows += [(7000, rare, "en", "new" if len(rare) > 1 else None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.calibrated(table, mixing.TARGETS).collect()
    total = sum(r.n_tokens for r in got)
    assert abs(sum(r.n_tokens * r.probability for r in got) / total - mixing.SHARE) < 1e-6
    assert abs(sum(r.n_tokens for r in got if r.kept) / total - mixing.SHARE) < 0.02
    assert next(r for r in got if r.doc_id == 7000).kept
    hot, cold = ([r.probability for r in got if (r.source == "hot") == is_hot] for is_hot in (True, False))
    assert max(hot) < min(cold)
    assert mixing.sampled(table, mixing.TARGETS).count() == sum(r.kept for r in got)


@pytest.mark.parametrize("targets", [mixing.TARGETS, {"source": {"hot": 0.4, "s0": 0.6}, "lang": mixing.Power(0.5), "topic": mixing.Power(1.0)}])
def test_many_cells_are_raked_by_spark_alike(docs, targets, monkeypatch):
    frame = mixing.described(docs.select("doc_id", "text", "lang", "source")).drop("text")
    names = list(targets)
    few = {tuple(r[n] for n in names): r.probability for r in mixing.probabilities(frame, targets, 4)[0].collect()}
    monkeypatch.setattr(mixing, "CELLS", 3)
    cells, is_few = mixing.probabilities(frame, targets, 4)
    many = {tuple(r[n] for n in names): r.probability for r in cells.collect()}
    assert not is_few and few.keys() == many.keys() and len(few) > 10
    assert all(abs(few[k] - many[k]) < 1e-9 for k in few)


def test_bounded_raking_takes_no_more_than_there_is():
    rng = np.random.default_rng(4)
    amount = rng.lognormal(0, 3, 60)
    places = [rng.integers(0, 5, 60), rng.integers(0, 4, 60)]
    targets = [np.full(5, 0.2), np.full(4, 0.25)]
    part = mixing.rake(amount, places, targets, 60, share=0.3)
    assert (part <= amount / amount.sum() + 1e-12).all() and 0 < part.sum() <= 0.3 + 1e-9
    even = mixing.rake(np.ones(60), places, targets, 60, share=0.3)
    for place, target in zip(places, targets):
        assert np.allclose(np.bincount(place, even), target * 0.3)


def test_very_long_text_and_clashing_columns(spark):
    rows = [(1, "w " * 400_000, "en", "a", 1, "x"), (2, "", None, None, 2, "y"), (2, "", None, None, 2, "y")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, whole long, topic string")
    got = mixing.calibrated(table, mixing.TARGETS).collect()
    assert sorted(r.n_tokens for r in got) == [1, 1, 400_001]
    assert mixing.sampled(table, mixing.TARGETS).columns == table.columns


def test_documents_without_id_are_drawn_each(spark):
    docs = spark.createDataFrame([(None, f"text number {i}", "en", "web") for i in range(2000)], "doc_id long, text string, lang string, source string")
    assert 800 < mixing.sampled(docs, mixing.TARGETS).count() < 1200
