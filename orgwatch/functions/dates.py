"""Dates and times, which the data model keeps as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FOUND = r"(20[0-9]{2})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})"


def event_date_from(text: Column, url: Column) -> Column:
    """The first ``20yy-m-d`` of a text or else of a URL; months and days beyond their range roll over; ``unknown`` without one."""
    both = F.concat_ws(" ", text, url)
    y, m, d = (F.regexp_extract(both, FOUND, g).try_cast("int") for g in (1, 2, 3))
    first = F.make_date(y, F.lit(1), F.lit(1))
    return F.coalesce(F.date_format(F.date_add(F.add_months(first, m - 1), d - 1), "yyyy-MM-dd"), F.lit("unknown"))


def valid_event_date(c: Column) -> Column:
    """The text if it begins with a real date from the year 1000 on, else null."""
    t = F.trim(c)
    real = F.try_to_timestamp(F.substring(t, 1, 10), F.lit("yyyy-MM-dd")).isNotNull()
    return F.when(t.rlike(r"^[1-9][0-9]{3}-[0-9]{2}-[0-9]{2}($|[T\s])") & real, t)


def parse_time(c: Column) -> Column:
    """Both forms in which the tables keep a time."""
    return F.coalesce(F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(c))


def display_date(c: Column, with_time: bool = True) -> Column:
    """A date or time as it is shown, to the minute or to the day; ``近期`` for none, a placeholder or what is no time."""
    blank = F.trim(c).rlike("(?i)^(unknown|null|undefined|nan|invalid)$")
    shown = F.date_format(parse_time(F.trim(c)), "yyyy-MM-dd HH:mm" if with_time else "yyyy-MM-dd")
    return F.coalesce(F.when(~blank, shown), F.lit("近期"))


def time_bucket(days: Column) -> Column:
    return F.when(days <= 1, "day").when(days <= 7, "week").when(days <= 31, "month").otherwise("year")
