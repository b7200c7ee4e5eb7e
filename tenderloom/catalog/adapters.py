"""The driver tables seen as tenders, analyst labels and result pages.

Every attribute is an expression over the driver's rows, so the views grow with
the tables. Attributes that enter the fingerprint come from the text alone, so
copies of a document are copies of a tender.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tenderloom.functions.numbers import amount_text, parse_amount
from tenderloom.operators.classify import classify, snapshot
from tenderloom.rules import DEFAULT_RULES, RuleSet
from tenderloom.schema import TENDER_COLUMNS
from tenderloom.shared import written

ROWS_PER_PAGE = 20

# Rules whose vocabulary occurs in the driver's invented texts, so that every class is filled.
CURRENT_RULES = replace(
    DEFAULT_RULES,
    include_keyword_patterns=(r"\bthe\s+and\b", r"\bder\b", r"\bque\b", r"\bplatform\w*\b"),
    include_cpv_prefixes=("48", "72", "50"),
    exclude_keyword_patterns=(r"\bhe\b", r"\bwith\b"),
    exclude_cpv_prefixes=("503", "7"),
    near_miss_keyword_patterns=(r"\bion\w*\b", r"\bles\b"),
    near_miss_cpv_prefixes=("3",),
)

# The rules in force when the labels were given.
FORMER_RULES = replace(
    CURRENT_RULES,
    include_keyword_patterns=(r"\bder\b", r"\bque\b", r"\bund\b"),
    exclude_cpv_prefixes=("503",),
)

# Rules proposed for calibration.
CANDIDATE_RULES: RuleSet = replace(
    CURRENT_RULES,
    include_keyword_patterns=(r"\bthe\s+and\b", r"\bder\b", r"\bund\b", r"\bplatform\w*\b"),
    exclude_keyword_patterns=(r"\bhe\b",),
    weights={**CURRENT_RULES.weights, "include_keyword_hit": 20, "mixed_bundle_bonus": 6},
    high_threshold=60,
)


# Rules of which some are covered by others, in their own list or another one.
OVERLAPPING_RULES = replace(
    CURRENT_RULES,
    include_keyword_patterns=(r"\bthe\s+and\b", r"\bder\b", r"\bque\w*\b", r"\bque\s+de\b"),
    exclude_keyword_patterns=(r"\band\b", r"\bder\b"),
    near_miss_keyword_patterns=(r"\bquel\w*\b", r"\bles\b"),
    include_cpv_prefixes=("48", "7", "72", "503"),
    exclude_cpv_prefixes=("503", "5031"),
    near_miss_cpv_prefixes=("480", "3"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The files of a table as a stream, whether the table is one file or a folder of them.

    A stream takes a plain path as a folder; a pattern may stand for a file as well.
    """
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{{{name}.parquet}}")


def tenders_of(documents: DataFrame) -> DataFrame:
    doc, n = F.col("doc_id"), F.col("n_chars")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (n % 365).cast("int"))
    amount = (
        F.when(n % 4 == 0, F.concat(n, F.lit(",50 Lekë")))
        .when(n % 4 == 1, F.concat(n, F.lit(".00 Lek")))
        .when(n % 4 == 2, F.concat(n, F.lit(" lek")))
        .otherwise(F.lit("pa fond"))
    )
    hour, minute = n % 24, F.lpad((n % 60).cast("string"), 2, "0")
    time = (
        F.when(n % 3 == 0, F.concat(F.lit("Ora "), hour, F.lit(":"), minute))
        .when(n % 3 == 1, F.concat(hour, F.lit("."), minute))
        .otherwise(F.lit(""))
    )
    code = F.concat(
        F.lpad(((n * 7368787 + 31415926) % 100000000).cast("string"), 8, "0"), F.lit("-"), n % 10
    )
    rows = documents.select(
        (doc + 1).alias("id"),
        F.col("text").alias("objekti_procedurave"),
        F.concat(F.lit("Autoriteti "), F.col("lang")).alias("autoriteti_kontraktues"),
        F.when(n % 2 == 0, "Buxheti").otherwise("Te ardhurat").alias("burimi_financimit"),
        amount.alias("fondi_limit_raw"),
        F.concat_ws("-", F.day(day), F.month(day), F.year(day)).alias("data_publikimit"),
        time.alias("ora_publikimit"),
        day.cast("string").alias("data_iso"),
        (doc % 3 + 2024).cast("string").alias("viti"),
        F.concat(F.lit("Muaji "), n % 12 + 1).alias("koha_zhvillimit"),
        code.alias("kodi_cpv_raw"),
        code.alias("cpv_spans"),
        F.col("source").alias("tipi_procedures"),
        F.lit("").alias("anulluar"),
        F.floor(doc / ROWS_PER_PAGE + 1).cast("string").alias("page_fetched"),
        (doc % ROWS_PER_PAGE).cast("string").alias("row_index_on_page"),
    )
    return rows.withColumn("fondi_limit_lek", amount_text(parse_amount(F.col("fondi_limit_raw")))).select(
        "id", *TENDER_COLUMNS
    )


def tenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tenders_of(table(spark, sf_dir, "documents"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One to three labels per labelled document; the second and third share a time."""
    doc, v = F.col("doc_id"), F.col("version")
    versions = table(spark, sf_dir, "labels").select("*", F.explode(F.sequence(F.lit(0), doc % 3)).alias("version"))
    label = (
        F.when((v == 1) & (F.col("toxic") == 1), "maybe")
        .when(F.col("quality") == 1, "relevant")
        .when(F.col("toxic") == 1, "maybe")
        .otherwise("not_relevant")
    )
    days = F.when(v == 0, 0).otherwise(1)
    created = F.lit("2024-06-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(days, (doc % 50).cast("int"))
    return versions.select(
        (doc * 3 + v + 1).alias("id"),
        (doc + 1).alias("tender_id"),
        label.alias("label"),
        F.when(doc % 11 != 0, F.concat(F.lit("Analyst "), doc % 7)).alias("reviewer"),
        F.when(v == 2, F.concat(F.lit("note "), doc)).alias("note"),
        created.alias("created_at"),
    )


def snapshot_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with the classification under the former rules frozen in, as a stored table."""
    given = labels(spark, sf_dir)
    ids = given.select(F.col("tender_id").alias("id")).distinct()
    frozen = classify(tenders(spark, sf_dir).join(ids, "id", "left_semi"), FORMER_RULES)
    frozen = frozen.select(F.col("id").alias("tender_id"), snapshot().alias("snapshot"))
    return written(given.join(frozen, "tender_id"), "labels")


def _escaped(col: Column) -> Column:
    for raw, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        col = F.replace(col, F.lit(raw), F.lit(reference))
    return col


def result_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tenders rendered as result pages of at most ``ROWS_PER_PAGE`` record blocks.

    Every third record has elements nested in its title and values, and every page a block after the container.
    """
    nested = F.col("row_index_on_page").cast("long") % 3 == 1

    def within(name: str) -> Column:
        return F.when(nested, F.lit(f"<{name}><{name}></{name}></{name}>")).otherwise(F.lit(""))

    def field(label: str, value: Column) -> list[Column]:
        opening = f'<li><b>{label}:</b> <span style="color:#607D8B">'
        return [F.lit(opening), within("span"), _escaped(value), F.lit("</span></li>")]

    c = F.col
    block = F.concat(
        F.lit('<div class="list-group-item list-group-item-result"><div class="list-group-item-header">'),
        F.lit('<div class="col-lg-12"><b>Objekti i procedurës së prokurimit:</b> '),
        within("div"),
        _escaped(c("objekti_procedurave")),
        F.lit('</div></div><ul class="list-inline">'),
        *field("Autoriteti Kontraktues", c("autoriteti_kontraktues")),
        *field("Burimi i financimit", c("burimi_financimit")),
        *field("Fondi limit", c("fondi_limit_raw")),
        F.lit('<li><b>Data e publikimit:</b> <span style="color:#607D8B">'),
        c("data_publikimit"),
        F.lit("</span> <small>"),
        c("ora_publikimit"),
        F.lit('</small></li></ul><ul class="list-inline">'),
        *field("Viti", c("viti")),
        *field("Koha e zhvillimit", c("koha_zhvillimit")),
        F.lit('<li><b>Kodi CPV:</b> <span style="color:#607D8B"><span>'),
        c("kodi_cpv_raw"),
        F.lit("</span></span></li>"),
        *field("Tipi i procedurës", c("tipi_procedures")),
        F.lit("</ul></div>"),
    )
    rows = tenders(spark, sf_dir).select(
        F.col("page_fetched").cast("long").alias("page_id"),
        F.col("row_index_on_page").cast("int").alias("at"),
        block.alias("block"),
    )
    # a page holds at most ROWS_PER_PAGE blocks by construction
    listed = rows.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("at", "block"))).alias("found"))
    html = F.concat(
        F.lit("<html><body><p>Faqe <b>"),
        F.col("page_id"),
        F.lit('</b> nga 900</p><div class="search-result-container" id="simple-search">'),
        F.array_join("found.block", ""),
        F.lit('</div><div class="list-group-item list-group-item-result">after the list</div></body></html>'),
    )
    return listed.select("page_id", F.lit("").alias("url"), html.alias("html"))


def stored_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result pages as a page corpus on disk, the form ingest reads."""
    return written(result_pages(spark, sf_dir), "pages")
