import numpy as np
import pytest

from millrace.llm import top_k


def brute(vectors, queries, k):
    out = {}
    for q in queries:
        scores = sorted(
            (-int(np.dot(vectors[q].astype(object), v.astype(object))), i) for i, v in vectors.items() if i != q
        )
        out[q] = [(i, -s) for s, i in scores[:k]]
    return out


@pytest.mark.parametrize("kind", ["clustered", "equal", "large"])
def test_equals_brute_force(spark, kind, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.integers(-250, 250, (6, 12))
    rows = {i: centres[i % 6] + rng.integers(-9, 9, 12) for i in range(700)}
    if kind == "equal":
        rows = {i: centres[0] if i % 3 else v for i, v in rows.items()}
    if kind == "large":
        rows = {i: v * 10**6 for i, v in rows.items()}
    vectors = spark.createDataFrame([(i, i, v.tolist()) for i, v in rows.items()], "row long, vec_id long, vector array<long>")
    queries = vectors.where("vec_id % 50 = 0")
    got = {}
    for r in top_k.search(vectors, queries, k=5, pivots=8, block=128).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    want = brute(rows, [i for i in rows if i % 50 == 0], 5)
    assert {q: [v[i] for i in range(1, 6)] for q, v in got.items()} == want


def test_bounds_save_work():
    rng = np.random.default_rng(1)
    centres = rng.integers(-2000, 2000, (40, 16)).astype(float)
    vectors = np.repeat(centres, 50, axis=0) + rng.integers(-5, 5, (2000, 16))
    far = top_k.pivot_distances(vectors, centres[:20])
    ids = np.arange(2000)
    found = top_k.best_in_block(ids[:40], vectors[:40], far[:40], ids, ids, vectors, far, 5)
    assert sum(f[2] for f in found) < 0.5 * 40 * 2000


def test_left_out_and_repeated_rows(spark):
    rows = [
        (0, [1.0, 0.5], "a"), (50, [0.25, None], "a"), (100, None, "a"), (1, [float("nan"), 1.0], "a"),
        (2, [float("inf"), 1.0], "a"), (3, [0.5], "a"), (4, [], "a"), (5, [-0.001, 1.0], "a"), (5, [-0.001, 1.0], "a"),
        (None, [1.0, 1.0], "a"),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    vectors = top_k.integers(table)
    got = top_k.search(vectors, vectors.where("vec_id % 50 = 0")).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in got] == [(0, 3, 256 * 128), (0, 5, 128 * 256 - 256), (0, 5, 128 * 256 - 256), (0, 4, 0)]


def test_empty_table(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>")
    vectors = top_k.integers(table)
    assert top_k.search(vectors, vectors).count() == 0


def test_rows_that_repeat_an_id(spark):
    rows = [(50, [1.0]), (50, [2.0]), (50, [2.0]), (1, [3.0]), (1, [4.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    vectors = top_k.integers(table)
    got = top_k.search(vectors, vectors.where("vec_id % 50 = 0"), k=4).collect()
    one = 256 * 256
    want = [
        (50, rank, vec_id, score * one)
        for own in ([(1, 4), (1, 3), (50, 2), (50, 2)], *2 * [[(1, 8), (1, 6), (50, 4), (50, 2)]])
        for rank, (vec_id, score) in enumerate(own, 1)
    ]
    assert sorted(map(tuple, got)) == sorted(want)
