"""Intermediate tables in the folder that all executors share, and the package for their Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parents[1]
SHARED_DIR_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names; a local session without one gets a temporary folder."""
    named = spark.conf.get(SHARED_DIR_KEY, None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError(f"set {SHARED_DIR_KEY} to a folder all executors share")
    return _local_dir(context.applicationId)


@lru_cache(maxsize=None)
def _local_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"tenderloom-{application}-")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tenderloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@lru_cache(maxsize=None)
def _package_zip() -> str:
    """The library as one archive, for Spark to send to the executors."""
    target = os.path.join(tempfile.mkdtemp(prefix="tenderloom-ship-"), f"tenderloom-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted((ROOT / "tenderloom").rglob("*.py")):
            archive.write(file, str(file.relative_to(ROOT)))
    return target


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers, unless the path already does."""
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(":"):
        return
    application = spark.sparkContext.applicationId
    if application not in _SHIPPED:
        spark.sparkContext.addPyFile(_package_zip())
        _SHIPPED.add(application)
