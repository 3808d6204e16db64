"""The pipeline: each stage's promise on planted cases, and the whole on the smoke tables."""

from collections import Counter

import pytest

import corpus_pipeline
from reprolith.llm.common import table, written

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), f"t-{name}")
        out[name] = docs
    return out


def test_order_and_columns(spark, stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "mixing", "packing"]
    columns = table(spark, SF, "documents").columns
    assert all(stages[n].columns == columns for n in ("quality", "exact", "near", "mixing"))


def test_each_stage_takes_effect(spark, stages):
    from reprolith.llm.quality import classify

    docs = table(spark, SF, "documents")
    good = {r.doc_id for r in classify(docs, table(spark, SF, "labels")).filter("predicted = 1").collect()}
    assert {r.doc_id for r in stages["quality"].collect()} == good
    texts = {}
    for r in stages["quality"].collect():
        key = "".join(c.lower() if c.isascii() else c for c in r.text)
        texts[key] = max(r.doc_id, texts.get(key, -1))
    assert {r.doc_id for r in stages["exact"].collect()} == set(texts.values())
    near = {r.doc_id for r in stages["near"].collect()}
    assert near <= set(texts.values())
    copies = Counter(r.doc_id for r in stages["mixing"].collect())
    assert set(copies) <= near and max(copies.values()) <= 3
    pieces = Counter((r.doc_id, r.piece) for r in stages["packing"].collect())
    assert {d: n for (d, p), n in pieces.items() if p == 0} == copies


def test_run_is_the_stages(spark, stages):
    assert Counter(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "piece", "length", "ids_crc32").collect())) == Counter(map(tuple, stages["packing"].select("doc_id", "piece", "length", "ids_crc32").collect()))


def test_run_on_awkward_and_empty_tables(spark, tmp_path):
    """Nulls, empty texts, repeated rows, ids alike; no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    prose = "The river was wide and slow, and the boats went down to the sea every morning with the tide. " * 4
    rows = [(1, prose, "en", "a", 1), (1, prose, "en", "a", 1), (1, prose, "de", "b", 2), (2, None, None, None, None), (3, "", "en", "a", 0), (None, prose + "more", "en", None, 5), (4, prose.upper(), "en", "a", 7), (5, "x" * 30_000, "en", "b", 9)]
    for name, data in (("some", rows), ("none", [])):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    some = corpus_pipeline.run(spark, f"{tmp_path}/some")
    assert some.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and some.count() > 0
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
