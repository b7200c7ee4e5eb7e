"""Every registered query equals its SQL twin on the smallest driver tables."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry
from tenderloom.catalog.oracles import all_oracles
from tenderloom.catalog.queries import all_queries
from tests.compare import differences, duck

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"  # has runs of pages without a match

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables not here")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


OWN = sorted(all_queries())


def test_contract(spark):
    assert set(all_oracles()) == set(OWN)
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["total", "software_broad", "software_strict", "near_miss"]


@pytest.mark.parametrize("name", OWN)
def test_query(spark, con, name):
    result = entry.queries()[name](spark, SF).toPandas()
    assert differences(result, con.execute(entry.oracle_sql()[name]).df()) == ""


@pytest.mark.parametrize("name", ["streaming_upsert", "streaming_resume"])
def test_streams_read_tables_of_several_files(spark, tmp_path, name):
    """A larger table is a folder of part files."""
    spark.read.parquet(f"{SF}/documents.parquet").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    own = duck(SF)
    own.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    result = entry.queries()[name](spark, str(tmp_path)).toPandas()
    assert len(result) > 0
    assert differences(result, own.execute(entry.oracle_sql()[name]).df()) == ""


@pytest.mark.skipif(not Path(LARGER).exists(), reason="driver tables not here")
def test_daily_ingest_takes_tenders_of_every_page(spark):
    """Tenders published since the mark are stored from pages behind a long run of pages without any."""
    stored = entry.queries()["daily_ingest"](spark, LARGER).toPandas()
    whole = duck(LARGER).execute(entry.oracle_sql()["streaming_daily"]).df()
    assert differences(stored, whole) == ""
