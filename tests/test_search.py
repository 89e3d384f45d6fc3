import numpy as np
import pytest
from pyspark.sql import functions as F

from storegrain.functions.vectors import cosine_distance, unit
from storegrain.operators import search


def vectors(spark, n, seed, name):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(n)]
    return spark.createDataFrame(rows, f"{name} bigint, embedding array<float>")


def brute(docs, queries, k):
    d = {r[0]: np.asarray(r[1], dtype=float) for r in docs.collect()}
    out = {}
    for q, v in ((r[0], np.asarray(r[1], dtype=float)) for r in queries.collect()):
        s = sorted((-round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 9), i) for i, w in d.items())
        out[q] = [i for _, i in s[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.id)
    return out


@pytest.mark.parametrize("block, chunk", [(2_000, 20_000), (7, 30)])
def test_both_ways_match_brute_force(spark, block, chunk):
    docs, queries = vectors(spark, 150, 1, "id"), vectors(spark, 20, 2, "query_id")
    # Copies of one vector: ties go to the smaller id.
    docs = docs.unionByName(docs.filter("id = 3").withColumn("id", F.explode(F.sequence(F.lit(200), F.lit(260))))).repartition(5)
    got = found(search.nearest(docs, queries, 4, block=block, chunk=chunk))
    assert got == brute(docs, queries, 4)


def test_zero_and_missing_vectors(spark):
    docs = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [1.0, 0.0])], "id bigint, embedding array<float>")
    queries = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 0.0])], "query_id bigint, embedding array<float>")
    assert found(search.nearest(docs, queries, 5)) == {1: [3]}
    assert search.nearest(docs.filter("id < 3"), queries, 5).isEmpty()
    assert search.nearest(docs, queries.limit(0), 5).isEmpty()


def test_grid_search_of_a_table_in_itself(spark):
    """Queries that are rows of the searched table share its columns."""
    docs = spark.range(60).select("id", F.array(*[F.cos(F.col("id") * (i + 1)).cast("float") for i in range(4)]).alias("embedding"))
    asked = docs.filter("id % 5 = 0").withColumnRenamed("id", "query_id")
    grid, whole = (sorted((r.query_id, r.id, r["rank"]) for r in search.nearest(docs, asked, 3, **sizes).collect()) for sizes in ({"block": 2, "chunk": 7}, {}))
    assert grid == whole and len(grid) == 36


def test_column_cosine(spark):
    row = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>").select(
        cosine_distance("a", "b").alias("d"), cosine_distance("a", "z").alias("none"), unit("a").alias("u")).first()
    assert row.d == pytest.approx(1 - 24 / 25) and row.none is None and row.u == pytest.approx([0.6, 0.8])


def test_approximate_search_finds_itself(spark):
    docs = vectors(spark, 100, 3, "id")
    index = search.fit_index(docs)
    got = search.nearest_approx(index, docs, docs.withColumnRenamed("id", "query_id"), 1)
    assert got.filter("id <> query_id").isEmpty() and got.count() == 100
    assert got.filter("abs(similarity - 1) > 1e-6").isEmpty()


@pytest.mark.parametrize("block, chunk", [(2_000, 20_000), (3, 11)])
def test_approximate_search_of_all_cells_is_exact(spark, block, chunk):
    docs, queries = vectors(spark, 300, 4, "id"), vectors(spark, 20, 5, "query_id")
    # a third of the rows is one vector
    docs = docs.unionByName(docs.filter("id = 3").withColumn("id", F.explode(F.sequence(F.lit(400), F.lit(549))))).repartition(5)
    index = search.fit_index(docs, cells=12)
    got = search.nearest_approx(index, docs, queries, 4, probes=12, block=block, chunk=chunk)
    assert found(got) == brute(docs, queries, 4)


def test_recall_on_clustered_vectors(spark):
    rng = np.random.default_rng(6)
    middle = rng.normal(size=(60, 16))
    points = middle[rng.integers(0, 60, 6_000)] + 0.3 * rng.normal(size=(6_000, 16))
    docs = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "id bigint, embedding array<float>")
    asked = docs.filter("id % 50 = 0").withColumnRenamed("id", "query_id")
    index = search.fit_index(docs, fit_rows=2_000)
    row = search.recall(search.nearest_approx(index, docs, asked, 5), search.nearest(docs, asked, 5)).first()
    assert row.n_exact == 600 and row.recall >= 0.9


def test_short_cells_fall_back_to_exact_search(spark):
    docs, queries = vectors(spark, 40, 7, "id"), vectors(spark, 6, 8, "query_id")
    index = search.fit_index(docs, cells=20)
    got = found(search.nearest_approx(index, docs, queries, 30, probes=1))
    assert got == brute(docs, queries, 30)
    assert all(len(x) == 40 for x in found(search.nearest_approx(index, docs, queries, 50)).values())


def test_unusable_vectors_and_widths(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [nan, 1.0]), (3, [None, 1.0]), (4, [inf, 0.0]), (5, None), (6, []), (7, [0.0, 0.0]), (8, [1.0, 1.0])]
    docs = spark.createDataFrame(rows, "id bigint, embedding array<float>")
    asked = spark.createDataFrame([(1, [2.0, 0.0]), (2, [nan, 0.0])], "query_id bigint, embedding array<float>")
    assert found(search.nearest(docs, asked, 5)) == {1: [1, 8]}
    assert found(search.nearest_approx(search.fit_index(docs), docs, asked, 2)) == {1: [1, 8]}
    none = docs.filter("id in (5, 6, 7)")
    assert search.fit_index(none) is None and search.nearest_approx(None, none, asked, 5).isEmpty()
    wide = docs.unionByName(spark.createDataFrame([(9, [1.0, 2.0, 3.0])], docs.schema))
    for run in (lambda: search.nearest(wide, asked, 5), lambda: search.nearest_approx(search.fit_index(docs), wide, asked, 5)):
        with pytest.raises(Exception, match="different widths"):
            run().collect()


def test_documents_skip_empty_parts(spark):
    rows = [("1", None, "food", None, "A-dong", None, "", "01"), ("2", "N", "", "cafe", None, "G", "nan", "09")]
    df = spark.createDataFrame(rows, "biz_id string, store_name string, category_large string, category_mid string, adong_name string, "
                                     "sgg_name string, road_address string, biz_status_cd string")
    out = {r.id: r for r in search.store_documents(df).collect()}
    assert out["store_1"].text == "상호 미상 | 업종: food | 위치: A-dong | 상태: 영업중"
    assert out["store_1"].metadata == {"category": "food", "district": "A-dong", "status": "영업중"}
    assert out["store_2"].text == "N | 세부: cafe" and out["store_2"].metadata == {"sub_category": "cafe", "sgg": "G"}


def test_failed_batches_are_left_out(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(10)], "id int, text string").coalesce(1)

    def embedder(texts):
        if "t3" in texts:
            raise RuntimeError("down")
        return [[] if t == "t9" else [1.0, 2.0] for t in texts]

    out = search.embed_with(docs, embedder, batch_size=2)
    assert sorted(r.id for r in out.collect()) == [0, 1, 4, 5, 6, 7]


def test_text_search_prefers_shared_words(spark):
    docs = spark.createDataFrame([("a", "coffee shop in A-dong"), ("b", "hair salon in B-dong"), ("c", "coffee roaster")], "id string, text string")
    model = search.fit_text_embedder(docs)
    asked = search.embed_with_model(spark.createDataFrame([("q", "coffee A-dong")], "query_id string, text string"), model)
    got = search.nearest(search.embed_with_model(docs, model), asked, 2)
    assert found(got) == {"q": ["a", "c"]}
    text = search.search_context(got, docs).first().context
    assert text.startswith("Case 1 (similarity ") and "Case 2" in text and "coffee roaster" in text


def test_ann_topk_answers_every_fiftieth_vector(spark, folder):
    from storegrain.catalog import load_all

    asked = {r.vec_id for r in spark.read.parquet(f"{folder}/embeddings.parquet").filter("vec_id % 50 = 0 AND embedding IS NOT NULL").collect()}
    rows = load_all()["ann_topk"].run(spark, folder).collect()
    assert {r.query_id for r in rows} == asked and len(rows) == 5 * len(asked)


def test_stored_index_lasts_grows_and_prunes(spark, tmp_path):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 6)) * 4
    rows = [(i, (centres[i % 8] + rng.normal(size=6)).tolist()) for i in range(400)] + [(900, None), (901, [0.0] * 6)]
    docs = spark.createDataFrame(rows, "id long, embedding array<double>")
    path = str(tmp_path / "index")
    first = search.StoredIndex(spark, path).reset(docs.filter("id < 200"), cells=8)
    assert first.count().first()[0] == 200
    for _ in range(2):  # a batch that is written again replaces itself
        first.add(docs.filter("id >= 200"), "later")
    again = search.StoredIndex(spark, path)
    assert again.count().first()[0] == 400
    asked = docs.filter("id % 50 = 0").withColumnRenamed("id", "query_id").filter("query_id < 400")
    exact = search.nearest(docs.filter("id < 400"), asked, 5)
    assert search.recall(again.search(asked, 5, probes=3), exact).first().recall >= 0.9
    one = again.documents().filter(F.col("_cell").isin([2]))
    assert "PartitionFilters: [isnotnull(_cell" in one._jdf.queryExecution().toString() or "PartitionFilters: [(_cell" in one._jdf.queryExecution().toString()
    assert {r.id for r in again.search(asked, 500, probes=1).select("id").collect()} == {r[0] for r in rows[:400]}  # too few in a cell: all are searched
    with pytest.raises(ValueError):
        again.add(docs, "reset")
    with pytest.raises(Exception, match="different widths"):
        again.add(spark.createDataFrame([(1, [1.0])], "id long, embedding array<double>"), "wrong")
    assert search.StoredIndex(spark, path).reset(docs.filter("id < 50"), cells=4).count().first()[0] == 50


def test_failed_texts_stay_with_their_error(spark):
    docs = spark.createDataFrame([(i, "bad" if i in (3, 40) else f"t{i}") for i in range(60)], "id long, text string").coalesce(1)

    def embedder(texts):
        if "bad" in texts:
            raise ValueError("no")
        return [[1.0, float(len(t))] for t in texts]

    out = search.embed_or_explain(docs, embedder, batch_size=10)
    assert search.embed_counts(out).first().asDict() == {"n_embedded": 58, "n_failed": 2, "n_retried": 20}
    assert {r.id: r.error for r in out.filter("error is not null").collect()} == {3: "ValueError: no", 40: "ValueError: no"}
    assert search.embed_with(docs, embedder, batch_size=10).count() == 40
