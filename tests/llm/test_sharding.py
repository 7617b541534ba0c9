import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm import sharding


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "wörter " * (i % 17), i) for i in range(600)] + [(7, "again", 0), (7, "again", 0), (None, None, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, shard int").cache()


def test_positions_and_sizes(docs):
    got = sharding.shard_documents(docs, shards=5, slots=256).collect()
    assert len(got) == docs.count()
    places = defaultdict(list)
    for r in got:
        places[r.shard].append(r.slot)
    assert set(places) == set(range(5))
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    texts = {(r.doc_id, r.size): r for r in got}
    for row in docs.collect():
        data = (row.text or "").encode()
        r = texts[row.doc_id, len(data) + 16]
        assert r.text_crc32 == zlib.crc32(data)
    load = Counter()
    for r in got:
        load[r.shard] += r.size
    assert max(load.values()) <= 1.02 * min(load.values())


def test_new_version_moves_only_into_the_new_shard(spark, docs, tmp_path):
    recs = sharding.records(docs, slots=256)
    sizes = sharding.slot_sizes(recs, 256).cache()
    first = sharding.slot_map(sizes, 5).cache()
    path = str(tmp_path / "map")
    sharding.save_edits(first, path)
    sharding.save_edits(sharding.with_one_more_shard(first, sizes, 5), path)
    before = {r.virtual_slot: r.shard for r in sharding.load_map(spark, path, 1).collect()}
    after = {r.virtual_slot: r.shard for r in sharding.load_map(spark, path).collect()}
    moved = {s for s in before if before[s] != after[s]}
    assert before.keys() == after.keys() and len(before) == 256
    assert moved and all(after[s] == 5 for s in moved)
    load = Counter()
    for r in sizes.collect():
        load[after[r.virtual_slot]] += r.n_bytes
    assert max(load.values()) <= 1.25 * min(load.values())


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.shard_documents(docs, shards=3, slots=16).count() == 0
    assert sharding.slot_map(sharding.slot_sizes(sharding.records(docs, slots=16), 16), 3).select(
        F.count_distinct("shard")
    ).first()[0] == 3


def test_hot_ids_repeated_rows_and_a_long_text(spark):
    rows = [(5, f"text {i}") for i in range(300)] + [(None, f"n{i}") for i in range(300)] + [(9, "same")] * 400 + [(1, "ü" * 600_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard_documents(docs, shards=4, slots=64).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len(t.encode()) + 16) for i, t in rows)
    for shard in {r.shard for r in got}:
        own = [r.slot for r in got if r.shard == shard]
        assert sorted(own) == list(range(len(own)))
    assert len({r.virtual_slot for r in got if r.doc_id == 5}) > 30 and len({r.virtual_slot for r in got if r.doc_id is None}) > 30
    assert len({r.virtual_slot for r in got if r.doc_id == 9}) == 1
    assert all(r.next_shard in (r.shard, 4) for r in got)
