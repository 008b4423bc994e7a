"""Column expressions over dates and instants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from opswell.functions.text import col, extract

# Bounds between which a number of milliseconds is taken for a plausible instant. Fixed values.
EARLIEST_MILLIS = 1_000_000_000_000
LATEST_MILLIS = 4_102_444_800_000


def first_date(c: Column | str, formats: Sequence[str]) -> Column:
    """Date by the first format that fits."""
    return F.coalesce(*[F.try_to_timestamp(col(c), F.lit(f)).cast("date") for f in formats])


def date_of_parts(year: Column, month: Column, day: Column) -> Column:
    """Date of three numbers, null when there is no such day."""
    text = F.format_string("%04d-%02d-%02d", year.cast("int"), month.cast("int"), day.cast("int"))
    return text.try_cast("date")


def month_ordinal(d: Column | str) -> Column:
    return F.year(col(d)) * 12 + F.month(col(d))


def instant_of_millis(c: Column | str) -> Column:
    return F.timestamp_millis(col(c))


def nanos_of_millis(c: Column | str) -> Column:
    return col(c) * F.lit(1_000_000)


def iso_utc(c: Column | str) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd'T'HH:mm:ss'.000Z'")


def millis_in_id(c: Column | str) -> Column:
    """Milliseconds carried inside an id as _<digits>V2, when they are a plausible instant."""
    ms = extract(c, "_(\\d{10,})V2").try_cast("long")
    return F.when((ms > EARLIEST_MILLIS) & (ms < LATEST_MILLIS), ms)


def bucket(c: Column | str, seconds: int) -> Column:
    """Start of the fixed bucket an instant falls in, as an instant."""
    s = F.unix_seconds(col(c))
    return F.timestamp_seconds(F.floor(s / seconds) * seconds)
