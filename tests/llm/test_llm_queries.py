"""The corpus queries with SQL against it, the pipeline's stages against what they promise."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from oracle import assert_same  # noqa: E402

import corpus_pipeline  # noqa: E402
from millrace.llm import language_id, mixing, near_dup, queries  # noqa: E402
from millrace.llm.common import shared_dir, small_batches  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SF), queries.ORACLE[name], SF)


def test_pipeline_keeps_what_its_stages_keep(spark):
    small_batches(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.learn(docs.where(language_id.learnable()))
    known = {r.doc_id for r in language_id.identify(docs, model).where("accepted").collect()}
    judged = docs.where(docs.doc_id.isin(list(known)))
    classes = {r.doc_id: r.class_id for r in near_dup.classes(judged).collect()}
    one = judged.where(judged.doc_id.isin(sorted(set(classes.values()))))
    sampled = {r.doc_id for r in mixing.calibrated(one, mixing.TARGETS).where("kept").collect()}
    got = [r.doc_id for r in corpus_pipeline.run(spark, SF).collect()]
    assert sorted(got) == sorted(sampled) and 0 < len(got) <= len(set(classes.values())) <= len(known)


def test_pipeline_on_odd_rows_leaves_only_its_result(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = docs.where("lang is not null").orderBy("doc_id").limit(60).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, "own") for r in some]
    rows += [(None, some[0].text, None, None, None, None), (900, None, "en", "s", 0, "x"), (901, "", None, "s", 0, "x"), (902, "12 34", "en", None, 5, "x")]
    rows += [(903, some[1].text * 400, "en", "s", 1, "x"), (903, some[1].text * 400, "en", "s", 1, "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node string")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    before = {p.name for p in Path(shared_dir(spark)).iterdir()}
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in got.collect()} <= {r.doc_id for r in some} | {903, None}
    left = {p.name.rpartition("-")[0] for p in Path(shared_dir(spark)).iterdir() if p.name not in before}
    assert left == {"encode"}
    empty = tmp_path / "empty"
    table.limit(0).write.parquet(str(empty / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
