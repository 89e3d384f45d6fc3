import datetime
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from storegrain.session import build_session, drop_staged  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g",
        "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    drop_staged(session)
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return FOLDER


@pytest.fixture(scope="session")
def applicants(spark):
    """Five raw applicants."""
    rows = [
        ("1", 35, "M", "bachelor", 5, 1, 0, 50_000_000, "food", "cafe", "A", 33.0, 50_000_000, 2_000_000, 2, 0, 8, "medium"),
        ("2", 28, "F", "master", 2, 0, 0, 30_000_000, "retail", "beauty", "B", 20.0, 30_000_000, 1_500_000, 1, 1, 15, "high"),
        ("3", 45, "M", "high_school", 15, 1, 1, 100_000_000, "food", "chicken", "C", 66.0, 80_000_000, 3_000_000, 4, 0, 5, "low"),
        ("4", 23, "F", "bachelor", 1, 0, 0, 15_000_000, "service", "academy", "D", 25.0, 20_000_000, 1_000_000, 0, 0, 20, "medium"),
        ("5", 62, "M", "bachelor", 20, 1, 1, 200_000_000, "food", "cafe", "E", 99.0, 150_000_000, 5_000_000, 5, 1, 3, "high"),
    ]
    names = ("biz_id string, age bigint, gender string, education_level string, experience_years bigint, "
             "has_related_experience bigint, has_startup_experience bigint, initial_capital bigint, business_category string, "
             "business_sub_category string, district string, store_size_sqm double, initial_investment bigint, "
             "monthly_rent bigint, employee_count bigint, is_franchise bigint, nearby_competitor_count bigint, "
             "floating_population_level string")
    return spark.createDataFrame(rows, names)


@pytest.fixture
def stamp():
    return lambda day: datetime.datetime(2024, 1, day)
