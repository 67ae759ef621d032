"""Dates, times and durations as strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.text import SPACES, bound, narrow, text, trimmed

# First years of the eras.
ERAS = {"明治": 1868, "大正": 1912, "昭和": 1926, "平成": 1989, "令和": 2019, "M": 1868, "T": 1912, "S": 1926, "H": 1989, "R": 2019}
ERA_DATE = r"^(明治|大正|昭和|平成|令和|[MTSHR])([0-9]{1,2})[年./\-]([0-9]{1,2})[月./\-]([0-9]{1,2})日?\z"
PLAIN_DATE = r"^([0-9]{4})[./\-]([0-9]{1,2})[./\-]([0-9]{1,2})\z"
COMPACT_DATE = r"^([0-9]{4})([0-9]{2})([0-9]{2})\z"


def date(c: Column) -> Column:
    """Era dates, yyyy[./-]m[./-]d and yyyymmdd as YYYY-MM-DD; anything else as it was, trimmed."""
    part = lambda v, pattern, i: F.regexp_extract(v, pattern, i)
    two = lambda x: F.lpad(x, 2, "0")
    era = F.create_map(*[F.lit(x) for pair in ERAS.items() for x in pair])

    def spelt(v: Column, kept: Column) -> Column:
        year = (F.element_at(era, part(v, ERA_DATE, 1)) + part(v, ERA_DATE, 2).cast("int") - 1).cast("string")
        return (
            F.when(v.rlike(ERA_DATE), F.concat_ws("-", year, two(part(v, ERA_DATE, 3)), two(part(v, ERA_DATE, 4))))
            .when(v.rlike(PLAIN_DATE), F.concat_ws("-", part(v, PLAIN_DATE, 1), two(part(v, PLAIN_DATE, 2)), two(part(v, PLAIN_DATE, 3))))
            .when(v.rlike(COMPACT_DATE), F.concat_ws("-", part(v, COMPACT_DATE, 1), part(v, COMPACT_DATE, 2), part(v, COMPACT_DATE, 3)))
            .otherwise(kept)
        )

    return bound(trimmed(c), lambda t: bound(F.regexp_replace(narrow(t), f"[{SPACES}]+", ""), lambda v: spelt(v, t)))


def date_fault(c: Column) -> Column:
    """Why a normalised date is not one, or null. Days up to 31 pass in any month."""

    def fault(c: Column) -> Column:
        year, month, day = (F.substring(c, a, n).try_cast("int") for a, n in ((1, 4), (6, 2), (9, 2)))
        return (
            F.when(c == "", F.lit(None).cast("string"))
            .when(~c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.lit("not in YYYY-MM-DD format"))
            .when(~month.between(1, 12) | ~day.between(1, 31), F.lit("invalid date"))
            .when(~year.between(1900, 2100), F.concat(F.lit("year "), year.cast("string"), F.lit(" out of range")))
        )

    return bound(text(c), fault)


def excel_date(c: Column) -> Column:
    """A spreadsheet's day number as YYYY-MM-DD."""
    return F.date_format(F.date_add(F.lit("1899-12-30").cast("date"), F.floor(c).cast("int")), "yyyy-MM-dd")


def excel_time(c: Column) -> Column:
    """A fraction of a day as HH:MM:SS."""
    seconds = F.round((c - F.floor(c)) * 86400).cast("long") % 86400
    two = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    return F.concat_ws(":", two(seconds / 3600), two(seconds % 3600 / 60), two(seconds % 60))


DURATION = r"^(?:([0-9]+)時間)? *(?:([0-9]+)分)? *(?:([0-9]+)秒)?\z"


def duration(c: Column) -> Column:
    """N時間 N分 N秒 as HH:MM:SS; anything else as it was."""
    two = lambda i: F.lpad(F.coalesce(F.nullif(F.regexp_extract(c, DURATION, i), F.lit("")), F.lit("0")), 2, "0")
    return F.when((c != "") & c.rlike(DURATION), F.concat_ws(":", two(1), two(2), two(3))).otherwise(c)
