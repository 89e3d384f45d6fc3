"""Spark session defaults and staged tables."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_LOCAL_BASE: dict[str, str] = {}
_SHIPPED: set[str] = set()
_SHIPPING = threading.Lock()


def build_session(app: str = "storegrain", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings this library is tuned for."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # Some joins turn few bytes into much work; 1 MB partitions would leave cores idle there.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def staging_root(spark: SparkSession) -> str:
    """The shared folder for staged tables: ``spark.checkpoint.dir`` of the session.

    Only a local session may run without that setting; it then gets a fresh
    temporary folder. On a cluster a machine-local folder would be lost with
    its executor, so a missing setting is an error there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if base:
        return f"{base.rstrip('/')}/storegrain-{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    if app not in _LOCAL_BASE:
        _LOCAL_BASE[app] = tempfile.mkdtemp(prefix="storegrain-")
    return _LOCAL_BASE[app]


def staging_path(spark: SparkSession, label: str) -> str:
    """A path nobody has used yet."""
    return f"{staging_root(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back.

    Used where a stage is read several times: the file is columnar, so the
    later passes read only their columns, and it outlives lost executors.
    """
    path = staging_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> None:
    """Remove everything this session has staged."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(staging_root(spark))
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, for functions that run in Python there."""
    with _SHIPPING:  # heads are fitted side by side
        _ship(spark)


def _ship(spark: SparkSession) -> None:
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="storegrain-"), "storegrain.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(root):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                out.write(path, os.path.relpath(path, os.path.dirname(root)))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)
