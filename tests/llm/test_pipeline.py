"""The stages one by one against what they are to do, and the whole run."""

import re

import pytest

import corpus_pipeline as pipeline
from pathloom.llm import decontam, jaccard, quality, secrets
from pathloom.llm.common import table, written


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    out = [table(spark, sf_dir, "documents")]
    for _, stage in pipeline.STAGES:
        out.append(written(stage(spark, out[-1], sf_dir)))
    return out


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_stages(spark, sf_dir, stages):
    docs, good, single, clean, safe, packed = stages
    assert [s.columns for s in stages[:5]] == [docs.columns] * 5
    model = quality.fit(quality.labelled_sample(docs, table(spark, sf_dir, "labels")))
    assert ids(good) == ids(quality.assess(docs, model).where("kept"))
    found = jaccard.jaccard_join(good).collect()
    assert ids(single) == {r["component_id"] for r in found} and single.count() == len(ids(single))
    leaks = ids(decontam.decontaminate(single, table(spark, sf_dir, "benchmark")))
    assert leaks and ids(clean) == ids(single) - leaks
    assert ids(safe) == ids(clean)
    before, after = ({r["doc_id"]: r for r in x.collect()} for x in (clean, safe))
    spans = {r["doc_id"] for r in secrets.secret_scan(clean).where("spans != ''").collect()}
    assert spans == {k for k in before if before[k]["text"] != after[k]["text"]}
    assert not any(re.search(r"AKIA[A-Z0-9]{12}|[0-9a-f]{32}", r["text"]) for r in after.values()) and all(r["n_chars"] == len(r["text"]) for r in after.values())
    assert ids(packed) == ids(safe) and packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0


def test_run_equals_the_stages(spark, sf_dir, stages):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, pipeline.run(spark, sf_dir).select(columns).collect())) == sorted(map(tuple, stages[-1].select(columns).collect()))


def test_odd_rows(spark, sf_dir, docs, empty):
    """Every stage takes nulls, empty and long texts, repeated rows, and further columns."""
    for _, stage in pipeline.STAGES[:-1]:
        got = stage(spark, docs.withColumnRenamed("n", "n_chars"), sf_dir)
        assert got.columns == docs.withColumnRenamed("n", "n_chars").columns and got.count() > 0
        assert stage(spark, empty.withColumnRenamed("n", "n_chars"), sf_dir).count() == 0
    near = pipeline.near_duplicate_stage(spark, docs, sf_dir)
    assert near.where("doc_id = 1000008").count() == 1 and near.where("doc_id is null").count() == 1
    assert {r[0] for r in near.where("doc_id between 1000003 and 1000007").select("doc_id").collect()} == {1000003, 1000005}


def test_rows_of_one_id_and_rows_without_id(spark, sf_dir):
    a, b, c = (" ".join(f"{x}{k}" for k in range(20)) for x in "abc")
    rows = [(None, a), (None, b), (None, c), (3, a), (5, a), (5, b), (7, c), (7, c.upper()), (8, ""), (8, ""), (8, None), (8, " "), (9, None)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, other string")
    got = [(r["doc_id"], (r["text"] or "").lower(), r["other"]) for r in pipeline.near_duplicate_stage(spark, docs, sf_dir).collect()]
    expected = [(None, a), (None, b), (None, c), (3, a), (5, b), (7, c), (8, ""), (8, " "), (9, "")]
    assert sorted(got, key=str) == sorted([(i, t, "x") for i, t in expected], key=str)
    item = table(spark, sf_dir, "benchmark").where("item_id is not null").orderBy("item_id").first()["text"]
    docs = spark.createDataFrame([(1, item), (1, a), (2, b), (None, item)], "doc_id long, text string")
    got = [tuple(r) for r in pipeline.decontamination_stage(spark, docs, sf_dir).collect()]
    assert sorted(got, key=str) == sorted([(1, a), (2, b), (None, item)], key=str)
