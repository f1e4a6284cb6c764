"""The pipeline: stages in order, each on its input, decisions in effect."""

import pytest
from llm_cases import frame, odd_documents, table

import corpus_pipeline
from pyspark.sql import functions as F
from forecourt.workspace import stored

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_and_registration():
    import __spark_entry__

    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality rules", "line dedup", "SimHash near-dedup", "suffix-array dedup", "best-fit packing"
    ]
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


@pytest.fixture(scope="module")
def outputs(spark):
    docs, found = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), "stage")
        found.append(docs)
    return found


def test_columns_and_shrinking_rows(outputs):
    counts = [len(table("documents")), *[df.count() for df in outputs[:-1]]]
    assert all(df.columns == COLUMNS for df in outputs[:-1])
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    for df in outputs[:-1]:
        assert all(r["n_chars"] == len(r["text"]) for r in df.collect())


def test_exact_copies_end_up_once(outputs):
    first = {}
    for r in outputs[0].orderBy("doc_id").collect():
        first.setdefault(r["text"], r["doc_id"])
    left = {r["doc_id"] for r in outputs[3].collect()}
    copies = {r["doc_id"] for r in outputs[0].collect()} - set(first.values())
    assert not left & copies


def test_no_long_passage_is_left_twice(outputs):
    seen = set()
    for r in outputs[3].collect():
        words = r["text"].split()
        mine = {tuple(words[i : i + 50]) for i in range(len(words) - 49)}
        assert not mine & seen
        seen |= mine


def test_packed_rows_cover_what_is_left(outputs):
    packed = outputs[4].collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in outputs[3].collect()}
    assert outputs[4].columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_run_gives_the_last_stage(spark, outputs):
    key = lambda r: (r["doc_id"], r["piece"], r["length"], r["ids_crc32"])
    assert sorted(map(key, corpus_pipeline.run(spark, SF).collect())) == sorted(map(key, outputs[4].collect()))


def test_odd_rows_pass_every_stage(spark):
    docs = frame(spark, odd_documents())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stored(stage(spark, docs, SF), "stage")
        assert after.columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0
        docs = after
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= docs.count()


def test_columns_of_any_name_are_kept(spark):
    from forecourt.llm import line_dedup, quality, suffix_dedup

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumns({"a.b": F.lit(1), "_host_key": F.lit(2)})
    for stage in (quality.filtered, line_dedup.deduplicated, suffix_dedup.without_copies):
        made = stage(docs)
        assert made.columns == docs.columns
        assert made.select("`a.b`", "_host_key").distinct().collect() == [(1, 2)]
        assert stage(docs.limit(0)).count() == 0
