import os

import pytest

import corpus_pipeline
from tickloom.llm.queries import TOKENIZER
from tickloom.session import written_once

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def test_stages_keep_columns_and_documents(spark):
    docs = corpus_pipeline.table(spark, DATA, "documents")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line dedup", "near duplicates", "decontamination", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = written_once(stage(spark, docs, DATA))
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in docs.select("doc_id").collect()} and ids
        docs = after
    rows = corpus_pipeline.pack_documents(spark, docs, DATA).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.collect())


def test_edges(spark, tmp_path):
    passage = " ".join(f"passage{i}" for i in range(20))
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(
        str(tmp_path / "benchmark.parquet"))
    line = "this line stands in more than one of the documents"
    rows = [
        (None, None, "en", None, None, "x"), (None, "", None, "s", 0, "x"),
        (1, f"{line}\nand a word", "en", "s", 1, "x"), (2, line, "en", "s", 1, "x"),
        (3, "some words before. " * 9 + passage, "en", "s", 1, "x"), (4, passage, "en", "s", 1, "x"),
        (5, "a b c d e f g h i j", "en", "s", 1, "x"), (6, "A b c d e f g h i j", "en", "s", 1, "x"),
        (8, "some words before. " * 3 + passage, "en", "s", 1, "x"),
        (7, "long " * 50_000, "en", "s", 1, "x"), (5, "a b c d e f g h i j", "en", "s", 1, "x")]
    schema = ("doc_id bigint, text string, lang string, source string, n_chars bigint, "
              "component_id string")
    docs = spark.createDataFrame(rows, schema).coalesce(1)
    lines = corpus_pipeline.drop_repeated_lines(spark, docs, DATA)
    assert lines.columns == docs.columns
    assert sorted(str(r.doc_id) for r in lines.collect()) == [
        "1", "3", "4", "5", "5", "6", "7", "8", "None", "None"]
    near = corpus_pipeline.drop_near_duplicates(spark, docs, DATA).collect()
    # 5 and 6 share all their shingles; 3, 4 and 8 also share a passage, 4 and 8 nearly all.
    assert sorted(str(r.doc_id) for r in near if r.doc_id not in (3, 4, 8)) == [
        "1", "2", "5", "7", "None", "None"]
    clean = {r.doc_id: r for r in corpus_pipeline.drop_benchmark_passages(
        spark, docs, str(tmp_path)).collect()}
    # 20 of 47 words are the passage's in 3, 20 of 29 in 8.
    assert not {4, 8} & set(clean) and clean[3].text == "some words before. " * 9
    assert clean[3].n_chars == len(clean[3].text) and clean[7].n_chars == 1
    assert corpus_pipeline.drop_toxic(spark, docs, DATA).columns == docs.columns
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, DATA).count() == 0
    assert TOKENIZER


def test_documents_that_the_query_calls_toxic_go(spark, monkeypatch):
    monkeypatch.setattr(corpus_pipeline.toxicity, "fit", lambda docs, labels: None)
    monkeypatch.setattr(corpus_pipeline.toxicity, "score", lambda model, text: text.cast("double"))
    docs = spark.createDataFrame([(1, "0.29"), (2, "0.3"), (3, "0.4"), (4, "0.6")], "doc_id bigint, text string")
    assert [r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, DATA).collect()] == [1]
