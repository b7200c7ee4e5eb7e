"""Reason lists, signals and their JSON form."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tenderloom.schema import LABEL_VALUES

# Fixed value: separator of joined lists in text outputs.
LIST_SEPARATOR = " | "
REASONS_TYPE = "map<string,array<string>>"


def joined(items: Column) -> Column:
    """F19."""
    return F.array_join(items, LIST_SEPARATOR)


def signal_label(name: Column, weight: Column) -> Column:
    """``name(+14)``."""
    return F.format_string("%s(%+d)", name, weight)


def prefixed(items: Column, prefix: str) -> Column:
    """F21."""
    return F.transform(items, lambda item: F.concat(F.lit(prefix), item))


def label_is_valid(label: Column) -> Column:
    """F23."""
    return F.coalesce(label.isin(*LABEL_VALUES), F.lit(False))


def list_from_json(text: Column) -> Column:
    """a JSON string array, empty when absent."""
    return F.from_json(F.coalesce(F.nullif(text, F.lit("")), F.lit("[]")), "array<string>")


def reasons_from_json(text: Column) -> Column:
    """a JSON object of string arrays, empty when absent."""
    return F.from_json(F.coalesce(F.nullif(text, F.lit("")), F.lit("{}")), REASONS_TYPE)


def normalized_reasons(items: Column) -> Column:
    """trimmed, without blanks, distinct, sorted."""
    trimmed = F.transform(items, lambda item: F.trim(item))
    return F.array_sort(F.array_distinct(F.filter(trimmed, lambda item: F.length(item) > 0)))


def flag(value: Column) -> Column:
    """boolean -> 0/1."""
    return value.cast("int")


def from_flag(value: Column) -> Column:
    """0/1 -> boolean."""
    return F.coalesce(value == 1, F.lit(False))
