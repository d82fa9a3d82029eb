"""The pipeline as a whole against plain versions of its stages."""

from __future__ import annotations

import corpus_pipeline
import pytest

from alertmill.llm import quality
from tests.llm import brute

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF_DIR}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        nxt = stage(spark, docs, SF_DIR)
        out.append((docs, nxt))
        docs = nxt
    return out


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_rules_stage(stages):
    before, after = stages[0]
    assert after.columns == before.columns
    kept = {r["doc_id"] for r in quality.quality_rules(before).filter("kept").collect()}
    assert {r["doc_id"] for r in rows(after)} == kept
    for r in rows(after):
        base = brute.quality_base(r["text"])
        assert base[0] >= 50 and 100 * base[4] <= 50 * base[0]


def test_join_stage(stages):
    before, after = stages[1]
    assert after.columns == before.columns
    docs = sorted(rows(before), key=lambda r: r["doc_id"])
    of = brute.components([brute.shingle_set(r["text"]) for r in docs])
    assert sorted(r["doc_id"] for r in rows(after)) == sorted(docs[k]["doc_id"] for k in set(of))


def test_decontamination_stage(stages, spark):
    before, after = stages[2]
    items = {str(r["item_id"]): r["text"] for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()}
    want = []
    for r in rows(before):
        n, hit, _ = brute.windows_hit(r["text"], items)
        if not (hit and 20 * len(hit) >= n):
            want.append(r["doc_id"])
    assert sorted(r["doc_id"] for r in rows(after)) == sorted(want)


def test_mixture_stage(stages):
    before, after = stages[3]
    ids = {r["doc_id"]: len(brute.words(r["text"])) for r in rows(before)}
    taken = [r["doc_id"] for r in rows(after)]
    assert set(taken) <= set(ids) and max(map(taken.count, taken)) <= 2
    total = sum(ids[i] for i in taken)
    assert 1.5 * sum(ids.values()) - max(ids.values()) <= total <= 1.5 * sum(ids.values())


def test_shard_stage_and_run(stages, spark):
    before, after = stages[4]
    got = rows(after)
    assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in rows(before))
    assert sorted(map(repr, got)) == sorted(map(repr, rows(corpus_pipeline.run(spark, SF_DIR))))
