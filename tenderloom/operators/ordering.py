"""Orders over whole tables without a whole-table window: numbering, running totals, paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tenderloom.shared import written

# Keys per block of a running total: no window holds more rows, whatever the keys' range.
BLOCK = 4096


def placed_rows(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` written in the given order, with ``_part`` and ``_pos``: its range partition and its place there.

    Rows are range-partitioned on the whole order, so a repeated leading key is
    split over tasks. Range partitions are found by a sample of the input, so that is written first and
    not evaluated twice.
    """
    rows = written(df, "unordered")
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    in_part = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return written(ranged.select(*rows.columns, F.spark_partition_id().alias("_part"), in_part.alias("_pos")), name)


def number_rows(df: DataFrame, order: list[Column], name: str, start: Column | int = 0) -> DataFrame:
    """Add ``name`` = start + 1, 2, ... in the given order, which must be total.

    The ordered rows are written once, which fixes the partition of
    every row, and the offsets come from one count per partition.
    """
    placed = placed_rows(df, order, "numbered")
    # one row per partition: bounded by spark.sql.shuffle.partitions
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.count("*").alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    )
    position = F.col("_before") + F.col("_pos") + 1
    first = start if isinstance(start, Column) else F.lit(start)
    return placed.join(F.broadcast(offsets), "_part").select(*df.columns, (first + position).cast("long").alias(name))


def running_totals(df: DataFrame, key: str, totals: dict[str, Column]) -> DataFrame:
    """Inclusive running sums in the order of ``key``, a unique non-negative integer of up to 62 bits.

    A prefix scan over blocks of keys: rows are summed per block, blocks per block of blocks, and so on until
    one block is left, so the number of levels grows with the keys' range (six for 62 bits). Every window is partitioned
    or over that last block, and holds at most ``BLOCK`` rows. The keys and values are written once, because
    all levels read them.
    """
    names = list(totals)
    rows = written(
        df.withColumns({f"_{n}": c.cast("long") for n, c in totals.items()}).withColumn("_at", F.col(key).cast("long")), "totals"
    )
    largest = rows.agg(F.max("_at").alias("m")).first()["m"] or 0

    def above(at: str) -> Column:
        return F.shiftright(F.col(at), BLOCK.bit_length() - 1)

    def before(level: DataFrame, bound: int) -> DataFrame:
        """(_at, _before_n): exclusive running sums of a level whose ``_at`` is at most ``bound``."""
        window = Window.orderBy("_at") if bound < BLOCK else Window.partitionBy("_up").orderBy("_at")
        window = window.rowsBetween(Window.unboundedPreceding, -1)
        inside = level.withColumn("_up", above("_at")).select(
            "_at", "_up", *[F.coalesce(F.sum(f"_{n}").over(window), F.lit(0)).alias(f"_in_{n}") for n in names]
        )
        if bound < BLOCK:
            return inside.select("_at", *[F.col(f"_in_{n}").alias(f"_before_{n}") for n in names])
        sums = level.groupBy(above("_at").alias("_at")).agg(*[F.sum(f"_{n}").alias(f"_{n}") for n in names])
        offsets = before(sums, bound >> BLOCK.bit_length() - 1).withColumnRenamed("_at", "_up")
        return inside.join(offsets, "_up").select("_at", *[(F.col(f"_in_{n}") + F.col(f"_before_{n}")).alias(f"_before_{n}") for n in names])

    own = rows.select(*df.columns, "_at", *[f"_{n}" for n in names])
    kept = [c for c in df.columns if c not in names]
    done = own.join(before(rows.select("_at", *[f"_{n}" for n in names]), largest), "_at")
    return done.select(*kept, *[(F.col(f"_before_{n}") + F.col(f"_{n}")).alias(n) for n in names])


class SortedPages:
    """An ordered table whose pages are found by a range index.

    The rows lie in files that are sorted and follow each other; the index has per file the first row number and how
    many there are. A page asks the index for the one or two files that hold its row numbers and reads those places
    of them, whatever its depth; no task sorts or skips the rows before it.
    """

    def __init__(self, df: DataFrame, order: list[Column]) -> None:
        self.fields = df.columns
        self.rows = placed_rows(df, order, "pages")
        # a range partition is one file; one row per partition: bounded by spark.sql.shuffle.partitions
        earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        files = self.rows.groupBy("_part").agg(F.count("*").alias("_rows"), F.min(F.col("_metadata.file_path")).alias("file"))
        self.index = written(files.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))), "page-index")

    def total(self) -> int:
        return self.index.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]

    def files(self, first: int, last: int) -> list:
        """Index entries of the files that hold row numbers ``first`` to ``last``, counted from 0: at most one per row."""
        return self.index.filter((F.col("_before") <= last) & (F.col("_before") + F.col("_rows") > first)).orderBy("_part").collect()

    def page(self, page: int, page_size: int) -> DataFrame:
        """One page with ``_row``, the number of the row from 1; empty beyond the last page."""
        first = (page - 1) * page_size
        last = first + page_size - 1
        found = self.files(first, last)
        spark = self.rows.sparkSession
        if not found:
            return spark.createDataFrame([], self.rows.select(*self.fields).schema.add("_row", "long"))
        held = spark.read.schema(self.rows.schema).parquet(*[r["file"] for r in found])
        parts = [
            held.filter(
                (F.col("_part") == r["_part"]) & F.col("_pos").between(first - r["_before"], last - r["_before"])
            ).select(*self.fields, (F.col("_pos") + r["_before"] + 1).cast("long").alias("_row"))
            for r in found
        ]
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more)
        return out


def page_slice(df: DataFrame, order: list[Column], page: int, page_size: int) -> DataFrame:
    """One page of the ordered rows by a sort with offset and limit.

    Spark keeps the best offset + limit rows of every task and merges them in one, which is right for the first
    pages of a result that is asked once. ``SortedPages`` serves pages at any depth.
    """
    return df.orderBy(*order).offset((page - 1) * page_size).limit(page_size)
