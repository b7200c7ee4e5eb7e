"""Dates, times and windows."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, functions as F

from tenderloom.functions.text import squeeze, strip_space

# The registry's date and time spellings.
LOCAL_DATE_PATTERN = r"^\d{1,2}-\d{1,2}-\d{4}$"
ISO_DATE_PATTERN = r"^\d{4}-\d{2}-\d{2}$"
TIME_PATTERN = r"(\d{1,2})\s*[:.]\s*(\d{2})"


def parse_local_date(col: Column) -> Column:
    """d-m-yyyy -> DATE, null if it is no calendar day."""
    text = squeeze(col)
    return F.when(F.rlike(text, F.lit(LOCAL_DATE_PATTERN)), F.try_to_date(text, "d-M-yyyy"))


def iso_text(day: Column) -> Column:
    return F.coalesce(day.cast("string"), F.lit(""))


def iso_date(col: Column) -> Column:
    text = strip_space(col)
    return F.when(F.rlike(text, F.lit(ISO_DATE_PATTERN)), F.try_to_date(text, "yyyy-MM-dd"))


def publication_date(iso: str = "data_iso", raw: str = "data_publikimit") -> Column:
    """the ISO column, else the raw date parsed again."""
    return F.coalesce(iso_date(F.col(iso)), parse_local_date(F.col(raw)))


def publication_time(raw: Column) -> Column:
    """minutes after midnight of the first time in the text, null if out of range."""
    text = F.coalesce(raw, F.lit(""))
    hour = F.nullif(F.regexp_extract(text, TIME_PATTERN, 1), F.lit("")).cast("int")
    minute = F.nullif(F.regexp_extract(text, TIME_PATTERN, 2), F.lit("")).cast("int")
    return F.when((hour <= 23) & (minute <= 59), hour * 60 + minute)


def at_time(day: Column, time: Column) -> Column:
    """Local timestamp of a day and a time text, midnight without a time."""
    minutes = F.coalesce(publication_time(time), F.lit(0))
    return day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), minutes, F.lit(0))


def publication_ts(iso: str = "data_iso", raw: str = "data_publikimit", time: str = "ora_publikimit") -> Column:
    """F8: local timestamp; midnight without a time, null without a date."""
    return at_time(publication_date(iso, raw), F.col(time))


def in_window(ts: Column, lower: Column, upper: Column) -> Column:
    """inclusive at both ends; rows without a timestamp are outside."""
    return F.coalesce(ts.between(lower, upper), F.lit(False))


def whole_second(ts: Column) -> Column:
    """F28."""
    return F.date_trunc("second", ts)


def utc_text(ts: Column) -> Column:
    """ISO text of a UTC instant."""
    return F.date_format(F.to_utc_timestamp(whole_second(ts), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def utc_now() -> datetime:
    """naive UTC time of audit columns, to whole seconds."""
    return datetime.now(timezone.utc).replace(tzinfo=None, microsecond=0)
