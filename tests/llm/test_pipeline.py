"""The pipeline's stages on a small fixture, each against what its operator says of its own input."""

import corpus_pipeline
import pytest

from granary.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    out, docs = [], spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, SF).cache()
        out.append((name, docs, result))
        docs = result
    return out


def test_columns_and_order(stages):
    assert [n for n, _, _ in stages] == ["quality", "line_dedup", "near_dedup", "mixing", "packing"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns and after.count()


def test_quality_keeps_the_good(spark, stages):
    _, before, after = stages[0]
    kept = {r.doc_id for r in after.collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    good = [r.doc_id for r in labels if r.quality == 1]
    assert sum(i in kept for i in good) >= 0.97 * len(good)
    assert before.count() >= len(kept)


def test_lines_and_copies_go(stages):
    _, before, after = stages[1]
    lines = [x for r in after.collect() for x in r.text.split("\n") if len(x) >= 16]
    assert len(lines) == len(set(lines))
    assert {x for r in before.collect() for x in r.text.split("\n") if len(x) >= 16} >= set(lines)
    _, before, after = stages[2]
    assert after.count() == len({r.doc_id for r in after.collect()}) <= before.count()


def test_short_repeats_go(stages):
    _, _, after = stages[1]
    lines = [x for r in after.collect() for x in r.text.split("\n") if x.strip()]
    assert len(lines) == len(set(lines))


def test_packing_takes_all_of_the_mix(stages):
    _, mixed, packed = stages[4]
    starts = packed.where("start = 0").count()
    assert starts == mixed.count()


def test_every_operator_has_its_query():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
