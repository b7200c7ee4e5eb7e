from __future__ import annotations

import pytest
from pyspark.sql import DataFrame, functions as F

from tenderloom.schema import TENDER_COLUMNS, TENDER_SCHEMA
from tests.compare import session


@pytest.fixture(scope="session")
def spark():
    own = session(cores=4)
    yield own
    own.stop()


@pytest.fixture
def make_tenders(spark):
    def make(*rows: dict, ids: bool = True) -> DataFrame:
        data = [tuple(r.get(c) for c in TENDER_COLUMNS) for r in rows]
        df = spark.createDataFrame(data, TENDER_SCHEMA)
        blank = df.select(*[F.coalesce(c, F.lit("")).alias(c) for c in TENDER_COLUMNS])
        if not ids:
            return blank
        numbers = spark.createDataFrame(
            [(i + 1, *row) for i, row in enumerate(blank.collect())],
            "id long, " + ", ".join(f"{c} string" for c in TENDER_COLUMNS),
        )
        return numbers

    return make


@pytest.fixture
def values(spark):
    """Evaluate a column function over a list of strings, in order."""

    def run(function, texts):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
        rows = df.select("i", function(F.col("s")).alias("out")).orderBy("i").collect()
        return [r["out"] for r in rows]

    return run
