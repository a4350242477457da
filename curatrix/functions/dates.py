"""Partial dates: known exactly as precisely as stated, never a SQL DATE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curatrix.functions.text import blank_if_null, let, strip

_SHAPE = r"^([0-9]{4})(?:-([0-9]{2})(?:-([0-9]{2})(?: ([0-9]{2}):([0-9]{2})(?::([0-9]{2}))?)?)?)?$"
#: Month names, nominative and genitive.
MONTHS = {
    "январь": 1, "января": 1, "февраль": 2, "февраля": 2, "март": 3, "марта": 3, "апрель": 4, "апреля": 4,
    "май": 5, "мая": 5, "июнь": 6, "июня": 6, "июль": 7, "июля": 7, "август": 8, "августа": 8,
    "сентябрь": 9, "сентября": 9, "октябрь": 10, "октября": 10, "ноябрь": 11, "ноября": 11, "декабрь": 12, "декабря": 12,
}
#: Property names.
XMP_DATE, XMP_PRECISION, XMP_SYNTHETIC = "XMP-archive:ArchiveDate", "XMP-archive:ArchiveDatePrecision", "XMP-archive:CompatibilityDateSynthetic"


def parse_archive_date(c: Column) -> Column:
    """``YYYY[-MM[-DD[ HH:MM[:SS]]]]`` to struct<year, month, day, hour, minute, second,
    precision>; null for anything else, and for dates or times that don't exist."""
    or_ = lambda x, d: F.coalesce(x, F.lit(d))

    def parts(text: Column) -> Column:
        # the shape has fixed places; casting '' to null would cost an exception in each row
        size = F.length(text)
        part = lambda start, n: F.when(size >= start, F.substring(text, start, n).try_cast("int"))
        precision = F.when(size > 10, "DATETIME").when(size > 7, "DAY").when(size > 4, "MONTH").otherwise("YEAR")
        second = F.when(size > 10, or_(part(18, 2), 0))
        made = F.struct(
            part(1, 4).alias("year"), part(6, 2).alias("month"), part(9, 2).alias("day"), part(12, 2).alias("hour"), part(15, 2).alias("minute"), second.alias("second"), precision.alias("precision")
        )
        return F.when(text.rlike(_SHAPE), let(made, real))

    def real(d: Column) -> Column:
        exists = F.try_make_timestamp_ntz(d["year"], or_(d["month"], 1), or_(d["day"], 1), or_(d["hour"], 0), or_(d["minute"], 0), or_(d["second"], 0).cast("decimal(16,6)")).isNotNull()
        return F.when((d["year"] >= 1) & exists & (or_(d["second"], 0) <= 59), d)

    return let(strip(blank_if_null(c)), parts)


def _pad(c: Column, n: int) -> Column:
    return F.lpad(c.cast("string"), n, "0")


def _day_text(d: Column) -> Column:
    return F.concat_ws("-", _pad(d["year"], 4), _pad(d["month"], 2), _pad(d["day"], 2))


def _time_text(d: Column) -> Column:
    return F.concat_ws(":", _pad(d["hour"], 2), _pad(d["minute"], 2), _pad(d["second"], 2))


def _text(d: Column, between: str) -> Column:
    return (
        F.when(d["precision"] == "DATETIME", F.concat(_day_text(d), F.lit(between), _time_text(d)))
        .when(d["precision"] == "DAY", _day_text(d))
        .when(d["precision"] == "MONTH", F.concat_ws("-", _pad(d["year"], 4), _pad(d["month"], 2)))
        .otherwise(_pad(d["year"], 4))
    )


def archive_date_text(d: Column) -> Column:
    """Canonical text; a season or unknown precision shows the year."""
    return let(d, lambda d: F.when(d.isNotNull(), _text(d, " ")))


def xmp_date_text(d: Column) -> Column:
    return let(d, lambda d: F.when(d.isNotNull(), _text(d, "T")))


def compat_timestamp(d: Column) -> Column:
    """struct<value timestamp_ntz, synthetic>: noon of the day, of the 15th, of July 1st for
    a day, month, year; null for other precisions."""
    return let(d, _stamp)


def _stamp(d: Column) -> Column:
    make = lambda m, dd, h, mi, s: F.try_make_timestamp_ntz(d["year"], m, dd, h, mi, s)
    p, noon, none = d["precision"], F.lit(12), F.lit(0)
    value = (
        F.when(p == "DATETIME", make(d["month"], d["day"], d["hour"], d["minute"], d["second"].cast("decimal(16,6)")))
        .when(p == "DAY", make(d["month"], d["day"], noon, none, none.cast("decimal(16,6)")))
        .when(p == "MONTH", make(d["month"], F.lit(15), noon, none, none.cast("decimal(16,6)")))
        .when(p == "YEAR", make(F.lit(7), F.lit(1), noon, none, none.cast("decimal(16,6)")))
    )
    return let(value, lambda v: F.when(v.isNotNull(), F.struct(v.alias("value"), (p != "DATETIME").alias("synthetic"))))


def compat_timestamp_strict(d: Column) -> Column:
    refused = lambda d: F.raise_error(F.concat(F.lit("no timestamp policy for precision "), d["precision"]))
    return let(d, lambda d: F.coalesce(_stamp(d), refused(d)))


def exif_text(stamp: Column) -> Column:
    return F.date_format(stamp["value"], "yyyy:MM:dd HH:mm:ss")


def xmp_fields(d: Column) -> Column:
    """Map of two properties, or three where a timestamp can be derived."""

    def fields(d: Column) -> Column:
        told = lambda stamp: F.when(stamp.isNotNull(), F.struct(F.lit(XMP_SYNTHETIC).alias("k"), F.when(stamp["synthetic"], "True").otherwise("False").alias("v")))
        entries = F.array(
            F.struct(F.lit(XMP_DATE).alias("k"), _text(d, " ").alias("v")),
            F.struct(F.lit(XMP_PRECISION).alias("k"), d["precision"].alias("v")),
            let(_stamp(d), told),
        )
        return F.when(d.isNotNull(), F.map_from_entries(F.filter(entries, lambda e: e.isNotNull())))

    return let(d, fields)


def standard_date_created(d: Column) -> Column:
    return let(d, lambda d: F.when(~d["precision"].isin("SEASON", "UNKNOWN"), xmp_date_text(d)))


def suggest_date(c: Column) -> Column:
    """Year, then the month if the first Cyrillic word of the next 24 characters names one,
    then the day if a number of one or two digits stands in the 6 after it. No calendar check."""
    year_at, month_at, day_at = r"(?U)\b(?:18|19|20)[0-9]{2}\b", r"(?U)\b[А-Яа-яЁё]+\b", r"(?U)\b[0-3]?[0-9]\b"
    months = F.create_map(*[x for k, v in MONTHS.items() for x in (F.lit(k), F.lit(v))])

    def after_year(at: Column, text: Column) -> Column:
        year = F.substring(text, at, F.lit(4))
        return F.when(at == 0, "").otherwise(let(F.substring(text, at + 4, F.lit(24)), lambda tail: let(F.regexp_extract(tail, month_at, 0), lambda word: with_month(year, tail, word))))

    def with_month(year: Column, tail: Column, word: Column) -> Column:
        month = F.when(word != "", F.try_element_at(months, F.lower(word)))
        rest = F.substring(tail, F.regexp_instr(tail, F.lit(month_at)) + F.length(word), F.lit(6))
        day = F.nullif(F.regexp_extract(rest, day_at, 0), F.lit("")).try_cast("int")
        dated = lambda m: F.concat_ws("-", year, _pad(m, 2), let(day, lambda n: F.when(n.between(1, 31), _pad(n, 2))))
        return let(month, lambda m: F.when(m.isNull(), year).otherwise(dated(m)))

    return let(blank_if_null(c), lambda text: let(F.regexp_instr(text, F.lit(year_at)), lambda at: after_year(at, text)))
