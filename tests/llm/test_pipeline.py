"""The pipeline stage by stage against its parts and brute force."""

import corpus_pipeline
from storegrain.llm import stages
from tests.llm.test_queries import base_spans

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [f for _, f in corpus_pipeline.STAGES] == [stages.quality_stage, stages.near_dedup_stage, stages.decontaminate_stage,
                                                      stages.secrets_stage, stages.sentencepiece_stage]
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, folder).persist()
        rows = docs.collect()
        assert docs.columns == COLUMNS and {r.doc_id for r in rows} <= ids and rows
        if stage is stages.secrets_stage:
            assert len(rows) == len(before) and all(r.n_chars == len(r.text) for r in rows)
            assert all(not base_spans(r.text) for r in rows)
            assert all(r.text == before[r.doc_id] for r in rows if "[secret]" not in r.text)
        ids = {r.doc_id for r in rows}
    out = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in out} == ids and all(r.round_trip for r in out)


def test_near_dedup_stage_keeps_one_of_each_group(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [r.text for r in stages.near_dedup_stage(spark, docs, folder).collect()]
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (t.lower().split() for t in kept) if len(w) >= 5]
    for i, x in enumerate(sets):
        for y in sets[:i]:
            both = len(x & y)
            assert 100 * both < 80 * (len(x) + len(y) - both)


def test_near_dedup_stage_keeps_one_row_where_ids_repeat(spark, folder):
    one, other = "a b c d e f g h i j", "k l m n o p q r s t"
    rows = [(1, one), (1, one), (2, one), (2, other), (3, other), (None, one), (None, "u v w x y z"), (4, None), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(map(tuple, stages.near_dedup_stage(spark, docs, folder).collect()), key=repr)
    assert kept == sorted([(1, one), (2, other), (None, "u v w x y z"), (4, None), (5, None)], key=repr)


CLASHING = "doc_id long, text string, selected string, grade string, items string, n_words string, hit_spans string, secret_spans string, __row string, " \
           "__cut string, cut string, row string, number string, id string, n_chars long"


def test_stages_keep_all_columns_of_odd_rows(spark, folder):
    words = " ".join(f"word{i}" for i in range(40))
    texts = [(1, words), (1, words), (2, None), (None, None), (3, ""), (4, "password: hunter2hunter2 " + words[::-1]), (5, "a" * 100_000), (None, words)]
    rows = [(i, t, *"abcdefghijkl", len(t or "")) for i, t in texts]
    docs = spark.createDataFrame(rows, CLASHING)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        found = out.collect()
        assert out.dtypes == docs.dtypes
        for r in found:
            assert tuple(r)[2:14] == tuple("abcdefghijkl")
            assert stage is stages.secrets_stage or tuple(r) in rows
        if stage is stages.near_dedup_stage:
            assert sorted((r.doc_id is None, r.doc_id or 0, r.text is None) for r in found) == [
                (False, 1, False), (False, 2, True), (False, 3, False), (False, 4, False), (False, 5, False), (True, 0, True)]
        elif stage in (stages.decontaminate_stage, stages.secrets_stage):
            assert len(found) == len(rows)
        if stage is stages.secrets_stage:
            text, = [r.text for r in found if r.doc_id == 4]
            assert "hunter2" not in text and "[secret]" in text


def test_stages_of_an_empty_table(spark, folder):
    docs = spark.createDataFrame([], CLASHING)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.dtypes == docs.dtypes and out.collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect() == []
