import pytest

from storegrain.plans.stages import clean_stage
from storegrain.session import stage, staging_root


def test_staged_rows(spark):
    df = spark.range(1_000).selectExpr("id", "id % 10 as k")
    out = stage(df, "t")
    assert out.dtypes == df.dtypes and out.exceptAll(df).isEmpty() and out.count() == 1_000


def test_staging_needs_a_shared_folder_on_a_cluster():
    class Conf:
        def get(self, key, default):
            return default

    class Session:
        conf = Conf()

        class sparkContext:
            applicationId, master = "app-1", "yarn"

    with pytest.raises(RuntimeError):
        staging_root(Session())


def test_empty_input_stays_empty(applicants):
    assert clean_stage(applicants.limit(0)).isEmpty()
