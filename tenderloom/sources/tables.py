"""Sources (S1, S2, S6, S10, S11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tenderloom.schema import CODE, KIND, PAGE_SCHEMA, TITLE, canonical

# Quotes are doubled inside quoted fields and blanks at the ends of fields are data.
CSV_OPTIONS = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def read_tenders_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, with or without a BOM; other columns dropped, missing ones blank."""
    raw = spark.read.options(**CSV_OPTIONS, multiLine=True, inferSchema=False).csv(path)
    return canonical(raw)


def read_tenders(spark: SparkSession, path: str) -> DataFrame:
    """Stored tenders; columns outside the canonical set stay in front."""
    table = spark.read.parquet(path)
    own = [c for c in ("id", "source_hash", "first_seen_at", "last_seen_at") if c in table.columns]
    return canonical(table, *own)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """S11."""
    return spark.read.schema(PAGE_SCHEMA).parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Named classifier inputs from a JSON list."""
    record = T.StructType([T.StructField(c, T.StringType()) for c in (TITLE, CODE, KIND)])
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("record", record)])
    vectors = spark.read.schema(schema).option("multiLine", True).json(path)
    fields = [F.coalesce(F.col("record." + c), F.lit("")).alias(c) for c in (TITLE, CODE, KIND)]
    return vectors.select("name", *fields)
