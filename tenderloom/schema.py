"""Record layouts: the canonical tender columns and the tables built around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# The canonical column order of a tender record.
TENDER_COLUMNS = (
    "objekti_procedurave",
    "autoriteti_kontraktues",
    "burimi_financimit",
    "fondi_limit_raw",
    "fondi_limit_lek",
    "data_publikimit",
    "ora_publikimit",
    "data_iso",
    "viti",
    "koha_zhvillimit",
    "kodi_cpv_raw",
    "cpv_spans",
    "tipi_procedures",
    "anulluar",
    "page_fetched",
    "row_index_on_page",
)

# The fields a record's fingerprint is taken over, in order.
FINGERPRINT_COLUMNS = (
    "objekti_procedurave",
    "autoriteti_kontraktues",
    "data_publikimit",
    "ora_publikimit",
    "fondi_limit_raw",
    "kodi_cpv_raw",
)

# Label vocabulary, tiers and search modes.
LABEL_VALUES = ("relevant", "not_relevant", "maybe")
CONFIDENCE_TIERS = ("high", "medium", "low")
SOFTWARE_MODES = ("broad", "strict", "near_miss")

TITLE, CODE, KIND = "objekti_procedurave", "kodi_cpv_raw", "tipi_procedures"

TENDER_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in TENDER_COLUMNS])

PAGE_SCHEMA = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)

LABEL_REQUEST_SCHEMA = T.StructType(
    [
        T.StructField("tender_id", T.LongType()),
        T.StructField("label", T.StringType()),
        T.StructField("reviewer", T.StringType()),
        T.StructField("note", T.StringType()),
    ]
)

SNAPSHOT_TYPE = T.StructType(
    [
        T.StructField("score", T.IntegerType()),
        T.StructField("confidence", T.StringType()),
        T.StructField("top_signals", T.ArrayType(T.StringType())),
        T.StructField("broad_ok", T.BooleanType()),
        T.StructField("strict_ok", T.BooleanType()),
        T.StructField("near_miss_ok", T.BooleanType()),
        T.StructField("reasons", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
    ]
)

RUN_SCHEMA = T.StructType(
    [
        T.StructField("batch_id", T.LongType(), False),
        T.StructField("started_at", T.TimestampNTZType()),
        T.StructField("finished_at", T.TimestampNTZType()),
        T.StructField("mode", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("target_year", T.StringType()),
        T.StructField("pages_visited", T.LongType()),
        T.StructField("rows_parsed", T.LongType()),
        T.StructField("rows_inserted", T.LongType()),
        T.StructField("duplicates_skipped", T.LongType()),
        T.StructField("failures_retries", T.LongType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("summary_json", T.StringType()),
        T.StructField("max_id", T.LongType()),
        T.StructField("replay_key", T.StringType()),
    ]
)


def blank_nulls(column: str) -> Column:
    """a missing field is the empty string everywhere past the source boundary."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).alias(column)


def canonical(df: DataFrame, *keep: str) -> DataFrame:
    """``keep`` plus the canonical columns; absent columns become blank, others are dropped."""
    present = set(df.columns)
    fields = [blank_nulls(c) if c in present else F.lit("").alias(c) for c in TENDER_COLUMNS]
    return df.select(*keep, *fields)
