"""Dates and times as Column expressions; the session runs in UTC."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_moment(c: Column) -> Column:
    """Timestamp of an ISO 8601 or RFC 822 text, naive ones in UTC; null where neither fits."""
    mail = F.regexp_replace(c, r"^\s*[A-Za-z]{3},\s*", "")
    return F.coalesce(F.try_to_timestamp(c), F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss z")))


def clock(c: Column) -> Column:
    """``H:MM[:SS]`` as ``HH:MM``, seconds only if they are not zero; other texts stay."""
    hour, minute, second = (F.regexp_extract(c, r"^(\d{1,2}):(\d{2})(?::(\d{2}))?$", i) for i in (1, 2, 3))
    full = F.concat(F.lpad(hour, 2, "0"), F.lit(":"), minute)
    return F.when(hour == "", c).when(second.isin("", "00"), full).otherwise(F.concat(full, F.lit(":"), second))


def clock_pair(c: Column) -> tuple[Column, Column]:
    """The first two clock values of a text, with ``:`` or ``.``, as ``HH:MM``; null where there are fewer."""
    found = F.regexp_extract_all(c, F.lit(r"\d{1,2}[:.][0-5]\d"), F.lit(0))
    one, two = (F.regexp_replace(F.lpad(F.get(found, F.lit(i)), 5, "0"), r"\.", ":") for i in (0, 1))
    return one, two


def strict_iso_date(c: Column) -> Column:
    """Date of a text of exactly the form yyyy-MM-dd; null otherwise."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


def local_day(ts: Column, zone: str = "Europe/Paris") -> Column:
    """The zone's calendar day at a UTC timestamp."""
    return F.to_date(F.from_utc_timestamp(ts, zone))


def local_midnight_utc(ts: Column, zone: str = "Europe/Paris") -> Column:
    """UTC timestamp of the zone's midnight before a UTC timestamp."""
    return F.to_utc_timestamp(F.date_trunc("day", F.from_utc_timestamp(ts, zone)), zone)


def year_month(c: Column) -> Column:
    return F.substring(c.cast("string"), 1, 7)


def season_start(c: Column) -> Column:
    """1 September on or before a date."""
    return F.make_date(F.year(c) - F.when(F.month(c) >= 9, F.lit(0)).otherwise(F.lit(1)), F.lit(9), F.lit(1))


def season_months(first: Column) -> Column:
    """First days of a season's twelve months."""
    return F.sequence(first, F.add_months(first, 11), F.expr("INTERVAL 1 MONTH"))


#: Names of the months.
MONTHS = {
    "es": ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"),
    "en": ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"),
}


def availability(c: Column, season: Column) -> Column:
    """Sorted dates (yyyy-MM-dd) of a text such as ``3, 5 octubre; january 7, 9``: in every part between
    semicolons the days before its first month, and those after each month, belong to the month.
    Months from September on lie in the year ``season``, others in the next; days run from 1 to 31."""
    number = F.create_map(*[F.lit(x) for names in MONTHS.values() for i, m in enumerate(names) for x in (m, i + 1)])
    any_month = "|".join(m for names in MONTHS.values() for m in names)
    tokens = lambda part: F.regexp_extract_all(part, F.lit(rf"\b(?:{any_month})\b|\b[0-3]?\d\b"), F.lit(0))

    def days(part: Column) -> Column:
        found = tokens(part)
        first = F.get(F.filter(found, lambda t: number[t].isNotNull()), F.lit(0))
        state = F.struct(first.alias("month"), F.array().cast("array<struct<month:string,day:string>>").alias("out"))
        step = lambda s, t: F.when(number[t].isNotNull(), F.struct(t.alias("month"), s["out"].alias("out"))).otherwise(F.struct(s["month"].alias("month"), F.concat(s["out"], F.array(F.struct(s["month"].alias("month"), t.alias("day")))).alias("out")))
        return F.aggregate(found, state, step)["out"]

    every = F.filter(F.flatten(F.transform(F.split(F.lower(c), ";"), days)), lambda x: x["month"].isNotNull() & x["day"].cast("int").between(1, 31))
    date_of = lambda x: F.format_string("%04d-%02d-%02d", season + F.when(number[x["month"]] >= 9, F.lit(0)).otherwise(F.lit(1)), number[x["month"]], x["day"].cast("int"))
    return F.array_sort(F.array_distinct(F.transform(every, date_of)))


def season_bounds(season: str, start: str | None = None, end: str | None = None) -> tuple[date, date]:
    """First and last day of a season ``YYYY-YY``: 1 September to 31 August unless overridden."""
    m = re.fullmatch(r"(\d{4})-(\d{2})", season)
    if not m or (int(m[1]) + 1) % 100 != int(m[2]):
        raise ValueError(f"not a season: {season!r}")
    first, last = int(m[1]), int(m[1]) + 1
    begin, finish = date.fromisoformat(start or f"{first}-09-01"), date.fromisoformat(end or f"{last}-08-31")
    if begin > finish or begin.year != first or finish.year != last:
        raise ValueError(f"bounds {begin} to {finish} do not fit season {season}")
    return begin, finish
