"""Registry statistics kept up to date by signed deltas instead of recounts.

A delta is one small row of counts, written under a key of its own: a batch counts its new rows only, and a
change of rules counts the rows that a changed pattern or prefix matches, under the old rules with a minus and under the new
ones with a plus. The statistics are the sum of all deltas. Writing a key again replaces it, so a repeated batch
does not count twice.

A row keeps its flags under new rules unless a pattern or prefix that only one of both rule sets has matches
it, because the flags only depend on which lists have a hit. If a list becomes empty or stops being so, all rows count
again, since an empty list has a meaning of its own.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tenderloom.operators.classify import classify, classify_many
from tenderloom.rules import RuleSet

COUNTS = {"total": None, "software_broad": "broad_ok", "software_strict": "strict_ok", "near_miss": "near_miss_ok"}
SCHEMA = ", ".join(f"{n} long" for n in COUNTS)
KEYWORDS = ("include_keyword_patterns", "exclude_keyword_patterns", "near_miss_keyword_patterns")
PREFIXES = ("include_cpv_prefixes", "exclude_cpv_prefixes", "near_miss_cpv_prefixes")
NEVER = r"(?!)"


def _counted(flag: str | None, prefix: str = "") -> Column:
    return F.count("*") if flag is None else F.count_if(F.col(prefix + flag))


def changed_rules(old: RuleSet, new: RuleSet) -> RuleSet | None:
    """The patterns and prefixes that one of both has, as inclusion rules; None if no row can be left out."""
    found = {}
    for kind, lists in (("include_keyword_patterns", KEYWORDS), ("include_cpv_prefixes", PREFIXES)):
        changed: set[str] = set()
        for name in lists:
            a, b = getattr(old, name), getattr(new, name)
            if bool(a) != bool(b):
                return None
            changed |= {*a} ^ {*b}
        found[kind] = tuple(sorted(changed))
    empty = {n: (NEVER,) if n in KEYWORDS else () for n in (*KEYWORDS, *PREFIXES)}
    return replace(old, **{**empty, "include_keyword_patterns": found["include_keyword_patterns"] or (NEVER,), "include_cpv_prefixes": found["include_cpv_prefixes"]})


class RegistryCounts:
    """The deltas under a path."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _keep(self, delta: DataFrame, key: str) -> None:
        delta.write.mode("overwrite").parquet(f"{self.path}/delta={key}")

    def add(self, rows: DataFrame, rules: RuleSet, key: str) -> None:
        """Count rows that are new to the registry."""
        counted = classify(rows, rules).agg(*[_counted(flag).alias(n) for n, flag in COUNTS.items()])
        self._keep(counted, key)

    def change_rules(self, rows: DataFrame, old: RuleSet, new: RuleSet, key: str) -> None:
        """Move the counts of the whole registry ``rows`` from one rule set to another."""
        changed = changed_rules(old, new)
        touched = rows if changed is None else classify(rows, changed).filter("broad_ok").select(*rows.columns)
        both = classify_many(touched, {"old_": old, "new_": new})
        moved = [
            (F.lit(0).cast("long") if flag is None else _counted(flag, "new_") - _counted(flag, "old_")).alias(n) for n, flag in COUNTS.items()
        ]
        self._keep(both.agg(*moved), key)

    def current(self) -> DataFrame:
        """One row: total, software_broad, software_strict, near_miss."""
        try:
            deltas = self.spark.read.schema(SCHEMA).parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            deltas = self.spark.createDataFrame([], SCHEMA)
        return deltas.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in COUNTS])
