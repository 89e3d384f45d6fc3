import datetime

from pyspark.sql import functions as F, types as T

from storegrain import schemas
from storegrain.operators import joins, runs, upsert
from storegrain.session import staging_path
from storegrain.sources import tables

TARGET = T.StructType.fromJson(T.StructType([
    T.StructField("biz_id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("road", T.StringType()),
    T.StructField("collected_at", T.TimestampType()), T.StructField("updated_at", T.TimestampType())]).jsonValue())
OLD, NOW = datetime.datetime(2024, 1, 1), datetime.datetime(2024, 2, 1)


def merged(spark, batch):
    target = spark.createDataFrame([("1", "old", "r1", OLD, OLD), ("2", "old", "r2", OLD, OLD), (None, "nokey", "r0", OLD, OLD)], TARGET)
    out = upsert.upsert(target, batch, "biz_id", [F.desc("seq")], F.lit(NOW))
    return {(r.biz_id, r.name): (r.road, r.collected_at, r.updated_at) for r in out.collect()}


def test_upsert_rules(spark):
    batch = spark.createDataFrame(
        [("2", "first", 1), ("2", None, 2), ("3", "new", 1), (None, "nokey2", 1)], "biz_id string, name string, seq int")
    assert merged(spark, batch) == {
        ("1", "old"): ("r1", OLD, OLD),           # not in the batch
        ("2", None): ("r2", OLD, NOW),            # last write, null overwrites, absent column survives
        ("3", "new"): (None, NOW, NOW),           # inserted
        (None, "nokey"): ("r0", OLD, OLD),        # a null key never collides
        (None, "nokey2"): (None, NOW, NOW),
    }


def test_upsert_twice_changes_nothing(spark):
    target = spark.createDataFrame([("1", "a", "r", OLD, OLD)], TARGET)
    batch = spark.createDataFrame([("1", "b", 1), ("4", "c", 1)], "biz_id string, name string, seq int")
    once = upsert.upsert(target, batch, "biz_id", [F.desc("seq")], F.lit(NOW))
    twice = upsert.upsert(once, batch, "biz_id", [F.desc("seq")], F.lit(NOW))
    assert once.exceptAll(twice).isEmpty() and twice.count() == 2


def test_upserts_of_names_from_two_sources(spark, tmp_path):
    root = str(tmp_path / "stores")
    table = tables.KeyedTable(spark, root, schemas.STORES, "biz_id")
    assert table.read().count() == 0
    rows = spark.createDataFrame([("1", "a"), ("2", "b")], "bizesId string, bizesNm string")
    tables.upsert_stores(spark, root, rows, [F.desc("store_name")])
    out = tables.upsert_stores(spark, root, spark.createDataFrame([("2", "c")], "biz_id string, store_name string"), [F.desc("store_name")])
    assert sorted((r.biz_id, r.store_name) for r in out.collect()) == [("1", "a"), ("2", "c")]


def files_of(root):
    return {str(p) for p in root.rglob("*.parquet")}


def test_upsert_writes_only_touched_buckets(spark, tmp_path):
    folder = tmp_path / "stores"
    table = tables.KeyedTable(spark, str(folder), schemas.STORES, "biz_id", buckets=8)
    names = spark.range(200).selectExpr("cast(id as string) as biz_id", "concat('s', id) as store_name")
    table.upsert(names.unionByName(names.limit(2).withColumn("biz_id", F.lit(None).cast("string"))), [F.desc("store_name")])
    before = files_of(folder)
    one = spark.createDataFrame([("7", "new"), ("7", "old")], "biz_id string, store_name string")
    out = table.upsert(one, [F.asc("store_name")])
    after = files_of(folder)
    changed = {p.split("_bucket=")[1].split("/")[0] for p in before ^ after}
    assert len(changed) == 1 and changed != {"-1"}
    assert out.count() == 202 and out.filter("biz_id is null").count() == 2
    assert out.filter("biz_id = '7'").first().store_name == "new"
    # rows without a key are appended, nothing else is touched
    out = table.upsert(one.limit(1).withColumn("biz_id", F.lit(None).cast("string")), [F.asc("store_name")])
    assert after < files_of(folder) and out.filter("biz_id is null").count() == 3
    # another number of buckets does not matter once the table exists, the same batch again changes no row
    again = tables.KeyedTable(spark, str(folder), schemas.STORES, "biz_id", buckets=3)
    assert again.upsert(one, [F.asc("store_name")]).count() == 203
    assert again.upsert(one.limit(0), [F.asc("store_name")]).count() == 203
    plan = again._stored().filter(F.col("_bucket").isin(1, 2))._jdf.queryExecution().toString()
    assert "PartitionFilters: [_bucket" in plan or "PartitionFilters: [isnotnull(_bucket" in plan


def test_table_of_keyless_rows_only(spark, tmp_path):
    table = tables.KeyedTable(spark, str(tmp_path / "t"), schemas.STORES, "biz_id")
    rows = spark.createDataFrame([(None, "a")], "biz_id string, store_name string")
    assert table.upsert(rows, [F.asc("store_name")]).count() == 1 and table.upsert(rows, [F.asc("store_name")]).count() == 2


def test_runs_are_replaced_and_dropped(spark, tmp_path):
    path = str(tmp_path / "cleaned")
    df = spark.createDataFrame([("1", 10.4), ("2", 11.6)], "biz_id string, initial_investment double")
    for run in ("a", "b", "b"):
        tables.append_cleaned(df.withColumn("extra", F.lit(1)), path, run)
    assert tables.read_runs(spark, path).count() == 4
    assert sorted(r.initial_investment for r in tables.read_runs(spark, path, "a").collect()) == [10, 12]
    assert "extra" not in tables.read_runs(spark, path).columns
    assert tables.drop_old_runs(spark, path, 1, "cleaned_at") == ["a"]
    assert {r[0] for r in tables.read_runs(spark, path).select("pipeline_run_id").distinct().collect()} == {"b"}


def test_run_filter_prunes_folders(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.append_cleaned(spark.createDataFrame([("1",)], "biz_id string"), path, "a")
    plan = tables.read_runs(spark, path, "a")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(pipeline_run_id" in plan


def test_retention(spark, stamp):
    df = spark.createDataFrame([("a", stamp(1)), ("a", stamp(9)), ("b", stamp(5)), ("c", stamp(3))], "pipeline_run_id string, created_at timestamp")
    assert runs.latest_run(df).first()[0] == "a"
    assert {r.pipeline_run_id for r in runs.retain_runs(df, 2).collect()} == {"a", "b"}
    assert runs.retain_runs(df, 0).count() == 0
    assert runs.dropped_rows(df, 1).first()[0] == 2
    assert runs.scan_run(df).count() == 2 and runs.scan_run(df, "c").count() == 1
    assert runs.scan_run(df.limit(0)).count() == 0


def test_run_life_cycle(spark, stamp):
    rows = [("r1", "trees", "started", None, None, stamp(1)), ("r1", "trees", "training", None, None, stamp(2)),
            ("r1", "trees", "completed", {"acc": 0.8}, "m1", stamp(3)), ("r2", "trees", "started", None, None, stamp(4)),
            ("r2", "trees", "failed", None, None, stamp(5)), ("r3", "linear", "completed", {"acc": 0.7}, "m3", stamp(2)),
            ("r3", "linear", "completed", None, None, stamp(6))]
    events = spark.createDataFrame(rows, "run_id string, model_type string, status string, metrics map<string,double>, "
                                         "model_path string, event_ts timestamp")
    state = {r.run_id: r for r in runs.run_state(events).collect()}
    assert (state["r1"].status, state["r1"].metrics, state["r1"].completed_at) == ("completed", {"acc": 0.8}, stamp(3))
    assert (state["r2"].status, state["r2"].metrics) == ("failed", None)
    assert (state["r3"].model_path, state["r3"].metrics, state["r3"].completed_at) == ("m3", {"acc": 0.7}, stamp(6))
    best = {r.model_type: r.run_id for r in runs.latest_completed(runs.run_state(events)).collect()}
    assert best == {"trees": "r1", "linear": "r3"}


def test_join_with_hot_and_null_keys(spark):
    left = spark.range(3_000).selectExpr("id", "case when id % 3 = 0 then 'hot' when id % 7 = 0 then null else concat('k', id % 500) end as k")
    right = spark.range(600).selectExpr("case when id = 0 then 'hot' else concat('k', id) end as k", "id * 2 as v")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    small = sorted(map(tuple, joins.attach(left, right, "k").select("id", "k", "v").collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = joins.attach(left, right, "k").select("id", "k", "v")
        assert "SortMergeJoin" in large._jdf.queryExecution().toString()
        assert sorted(map(tuple, large.collect())) == small and len(small) == 3_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert {v for _, k, v in small if k is None} == {None} and {v for _, k, v in small if k == "hot"} == {0}


def test_last_write_limits_each_task(spark):
    df = spark.range(1_000).selectExpr("case when id = 7 then 'cold' else 'hot' end as k", "id")
    out = joins.last_write(df, "k", [F.desc("id")])
    assert sorted(r.id for r in out.collect()) == [7, 999]
    assert "WindowGroupLimit" in out._jdf.queryExecution().toString()


def test_union_fills_missing_columns(spark):
    out = upsert.union_batches(spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2,)], "b int"))
    assert sorted(map(tuple, out.collect()), key=str) == [(1, None), (None, 2)]


def test_run_ids_stay_text(spark):
    path = staging_path(spark, "ids")
    rows = spark.createDataFrame([("1", 5)], "biz_id string, age bigint")
    for run_id in ("007", "008", "a:b"):
        tables.append_cleaned(rows, path, run_id)
    assert {r.pipeline_run_id for r in tables.read_runs(spark, path).collect()} == {"007", "008", "a:b"}
    assert tables.read_runs(spark, path, "007").count() == 1
    schema = tables.read_runs(spark, path).schema
    assert len(tables.drop_old_runs(spark, path, 1, "cleaned_at")) == 2 and tables.read_runs(spark, path).count() == 1
    assert len(tables.drop_old_runs(spark, path, 0, "cleaned_at")) == 1
    assert tables.read_runs(spark, path, schema=schema).collect() == []


def test_values_stay_whole(spark):
    from pyspark.sql import functions as F

    from storegrain.functions.columns import clip
    from storegrain.operators import cleaning

    clipped = spark.createDataFrame([(None,), (7.0,)], "x double").select(clip(F.col("x"), 1, 5)).collect()
    assert {r[0] for r in clipped} == {None, 5.0}
    big = cleaning.cast_types(spark.createDataFrame([("1e30",), ("12.7",)], "employee_count string"))
    assert {r[0] for r in big.collect()} == {0, 12}


def test_broken_and_long_pages(spark, tmp_path):
    from storegrain.sources import files

    good = '{"page": 1, "body": {"items": [{}, {}]}}'
    (tmp_path / "lines.json").write_text(good + "\n" + good[:-9] + "\n")
    (tmp_path / "long").mkdir()
    (tmp_path / "long" / "page.json").write_text(good.replace(", ", ",\n"))
    lines, long = str(tmp_path / "lines.json"), str(tmp_path / "long")
    assert files.read_store_pages(spark, lines).count() >= 2
    assert files.rejected_pages(spark, lines, schemas.STORE_PAGE).count() == 1
    assert files.read_store_pages(spark, long, multi_line=True).count() == 2
    assert files.rejected_pages(spark, long, schemas.STORE_PAGE, multi_line=True).count() == 0


def test_unusable_vectors():
    import numpy as np

    from storegrain.operators.search import _unit_rows

    rows, usable = _unit_rows([[3.0, 4.0], [float("nan"), 1.0], [0.0, 0.0], [1.0, None], None])
    assert usable.tolist() == [True, False, False, False, False] and np.allclose(rows, [[0.6, 0.8]])
