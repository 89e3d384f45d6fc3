import math
import random

import pytest
from pyspark.sql import functions as F

from storegrain import schemas
from storegrain.operators import nearby, regions
from storegrain.sources import files


def metres(a, b):
    (lat1, lon1), (lat2, lon2) = a, b
    p, q = math.radians(lat1), math.radians(lat2)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371000 * math.asin(math.sqrt(h))


def brute(centres, points, radius):
    return {c: sum(metres(c, p) <= radius for p in points) for c in set(centres)}


@pytest.mark.parametrize("limit", [nearby.PAIR_LIMIT, 10])
@pytest.mark.parametrize("lat", [37.5, -0.001, 59.0])
def test_counts_match_brute_force(spark, lat, limit):
    rng = random.Random(5)
    # A third of the points in one small spot, copies included.
    points = [(lat + rng.gauss(0, 1e-4), 127 + rng.gauss(0, 1e-4)) for _ in range(100)]
    points += [(lat, 127.0)] * 50 + [(lat + rng.uniform(-.02, .02), 127 + rng.uniform(-.02, .02)) for _ in range(200)]
    df = spark.createDataFrame(points, "latitude double, longitude double")
    got = {(r.latitude, r.longitude): r.n_within for r in nearby.counts_in_radius(df, df, 700.0, pair_limit=limit).collect()}
    assert got == brute(points, points, 700.0)


def test_other_centres_and_groups(spark):
    points = spark.createDataFrame([("a", 37.5, 127.0), ("b", 37.5, 127.0), ("a", 37.501, 127.0)], "g string, latitude double, longitude double")
    centres = spark.createDataFrame([("a", 37.5005, 127.0), ("a", 10.0, 10.0), ("c", 37.5, 127.0)], "g string, latitude double, longitude double")
    got = {(r.g, r.latitude): r.n_within for r in nearby.counts_in_radius(centres, points, 500.0, ["g"]).collect()}
    assert got == {("a", 37.5005): 2, ("a", 10.0): 0, ("c", 37.5): 0}


@pytest.mark.parametrize("radius", [800.0, 40_000.0, 3e6, 3e7])
def test_poles_and_the_180th_meridian_are_no_border(spark, radius):
    rng = random.Random(8)
    points = [(90 - rng.random() * 0.02, rng.uniform(-180, 180)) for _ in range(60)] + [(90.0, 0.0), (-90.0, 5.0)]
    points += [(rng.uniform(-.01, .01), s * (180 - rng.random() * .01)) for s in (1, -1) for _ in range(60)] + [(0.0, 180.0), (0.0, -180.0)]
    df = spark.createDataFrame(points + [(None, 1.0), (1.0, float("nan"))], "latitude double, longitude double")
    got = {(r.latitude, r.longitude): r.n_within for r in nearby.counts_in_radius(df, df, radius, pair_limit=50).collect()}
    assert got == brute(points, points, radius)


def test_half_of_all_positions_in_one_block(spark):
    rng = random.Random(9)
    points = [(37.5 + rng.random() * 1e-3, 127 + rng.random() * 1e-3) for _ in range(700)]
    points += [(37.5 + rng.uniform(-.05, .05), 127 + rng.uniform(-.05, .05)) for _ in range(700)]
    df = spark.createDataFrame(points, "latitude double, longitude double")
    got = {(r.latitude, r.longitude): r.n_within for r in nearby.counts_in_radius(df, df, 60.0).collect()}
    assert got == brute(points, points, 60.0)


def test_radius_filter_is_pushed_down(spark, tmp_path):
    rng = random.Random(6)
    points = [(37.5 + rng.uniform(-.02, .02), 127 + rng.uniform(-.02, .02)) for _ in range(300)]
    spark.createDataFrame(points, "latitude double, longitude double").write.parquet(str(tmp_path / "p"))
    df = nearby.stores_in_radius(spark.read.parquet(str(tmp_path / "p")), 37.5, 127.0, 900.0)
    assert df.count() == sum(metres((37.5, 127.0), p) <= 900 for p in points)
    assert "GreaterThanOrEqual(latitude" in df._jdf.queryExecution().toString()


def test_region_levels(spark):
    rows = [("1100000000", "S"), ("1168000000", "S G"), ("1168010100", "S G Y"), ("1168010101", "S G Y R"), ("2600000000", "B")]
    register = spark.createDataFrame(rows, "region_cd string, locatadd_nm string")
    assert {r.sido_cd for r in regions.provinces(register).collect()} == {"11", "26"}
    assert [tuple(r) for r in regions.districts(register, "11").collect()] == [("1168000000", "11", "680", "G", "S G")]
    assert [tuple(r) for r in regions.neighbourhoods(register, "11", "680").collect()] == [
        ("1168010100", "11", "680", "101", "Y", "S G Y", "Y")]


def test_null_codes_are_not_aggregates(spark):
    df = spark.createDataFrame([("11680000",), ("11680101",), (None,)], "region_cd_8 string")
    assert {r[0] for r in regions.dong_codes(df).collect()} == {"11680101", None}


def test_targets_keep_null_names(spark):
    df = spark.createDataFrame([("11680101", "소계"), ("11680102", None), ("11680103", "x")], "region_cd_8 string, dong_nm string")
    assert {r.code for r in regions.region_targets(df).collect()} == {"11680102", "11680103"}


def test_province_prefers_the_exact_name(spark):
    df = spark.createDataFrame([("경기도",), ("새경기도",)], "sido_nm string")
    assert tuple(regions.resolve_province(df, "경기도").first()) == ("경기도", "41")
    assert tuple(regions.resolve_province(df, "새").first()) == ("새경기도", "00")
    assert regions.resolve_province(df, "없음").isEmpty()


def test_pages_are_complete_or_not(spark):
    rows = [("a", 1, 100, 150, 100), ("a", 2, 100, 150, 50), ("b", 1, 100, 300, 100), ("c", 1, 100, 300, 40)]
    pages = spark.createDataFrame(rows, "request string, page bigint, page_size bigint, total bigint, n_rows bigint")
    assert {r.request: r.complete for r in regions.page_completeness(pages).collect()} == {"a": True, "b": False, "c": True}


def test_log_has_a_row_for_empty_requests(spark):
    targets = spark.createDataFrame([("1", "x"), ("2", "y")], "dong_code string, dong_name string")
    rows = spark.createDataFrame([("1",), ("1",)], "dong_code string")
    out = {r.dong_cd: (r.store_count, r.status) for r in regions.collection_log(targets, rows).collect()}
    assert out == {"1": (2, "success"), "2": (0, "no_data")}
    answered = spark.createDataFrame([("1",)], "dong_code string")
    assert tuple(regions.response_rate(targets, answered, "dong_code").first()) == (2, 1, 50.0)
    assert regions.response_rate(targets.limit(0), answered, "dong_code").withColumn("z", F.lit(1)).first().pct == 0.0


def test_log_says_what_failed(spark, tmp_path):
    page = '{"page":1,"body":{"items":[{"bizesId":"9","adongNm":"x"}]}}'
    land = {"ok": [page], "cut": [page[:-3], page[:-4], page], "shape": ['{"page":2,"body":7}'], "null": ['{"page":2}'],
            "empty": ['{"page":0,"body":{"items":[]}}']}
    for code, lines in land.items():
        folder = tmp_path / f"dong_code={code}"
        folder.mkdir()
        (folder / "a.json").write_text("\n".join(lines))
    attempts = files.landed_attempts(spark, str(tmp_path), schemas.STORE_PAGE, "dong_code")
    targets = spark.createDataFrame([(c, c) for c in [*land, "never"]], "dong_code string, dong_name string")
    rows = spark.createDataFrame([("ok",), ("cut",)], "dong_code string")
    out = {r.dong_cd: (r.store_count, r.status, r.error_msg) for r in regions.collection_log(targets, rows, attempts=attempts).collect()}
    assert out == {
        "ok": (1, "success", None), "cut": (1, "fail", "page is no JSON document x2"),
        "shape": (0, "fail", "page does not fit its schema: body"), "null": (0, "fail", "answer without body"),
        "empty": (0, "no_data", None), "never": (0, "fail", "no answer landed")}


def test_pages_over_several_lines_can_fail_too(spark, tmp_path):
    for code, text in {"a": '{"page":1,\n "body":{"items":[]}}', "b": '{"page":1,\n "body":{"items":['}.items():
        (tmp_path / f"dong_code={code}").mkdir()
        (tmp_path / f"dong_code={code}" / "p.json").write_text(text)
    found = files.landed_attempts(spark, str(tmp_path), schemas.STORE_PAGE, "dong_code", multi_line=True)
    assert {r.dong_code: r.error for r in found.collect()} == {"a": None, "b": "page is no JSON document"}
