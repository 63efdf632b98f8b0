"""Dates in Indonesian and English text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lontar.functions import let
from lontar.functions.numbers import plain_number_words

# Month spellings.
MONTHS = {
    "januari": 1, "jan": 1, "january": 1, "februari": 2, "pebruari": 2, "feb": 2, "february": 2, "maret": 3, "mar": 3, "march": 3,
    "april": 4, "apr": 4, "mei": 5, "may": 5, "juni": 6, "jun": 6, "june": 6, "juli": 7, "jul": 7, "july": 7,
    "agustus": 8, "agu": 8, "agt": 8, "aug": 8, "august": 8, "september": 9, "sep": 9, "sept": 9, "oktober": 10, "okt": 10, "oct": 10, "october": 10,
    "november": 11, "nov": 11, "nopember": 11, "desember": 12, "des": 12, "dec": 12, "december": 12,
}
FULL_MONTHS = ("januari", "februari", "maret", "april", "mei", "juni", "juli", "agustus", "september", "oktober", "november", "desember")
# Dates written out, ISO dates, and day first.
_WRITTEN = r"\b(\d{1,2})\s+([A-Za-z]{3,10})\.?\s+(\d{4})\b"
_ISO = r"\b(\d{4})-(\d{1,2})-(\d{1,2})\b"
_DMY = r"\b(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4})\b"
_ANY = rf"{_WRITTEN}|{_ISO}|{_DMY}"


def safe_date(year: Column, month: Column, day: Column) -> Column:
    """A date, or null where there is no such day."""
    return F.concat_ws("-", year.cast("string"), F.coalesce(month.cast("string"), F.lit("0")), day.cast("string")).try_cast("date")


def _one(found: Column) -> Column:
    """The date that one matched piece of text writes: its three parts tell the notation."""
    months = F.create_map(*[x for k, v in MONTHS.items() for x in (F.lit(k), F.lit(v))])

    def read(p: Column) -> Column:
        a, b, c = (F.get(p, F.lit(k)) for k in range(3))
        return F.when(F.length(a) == 4, safe_date(a, b, c)).when(b >= "A", safe_date(c, F.try_element_at(months, F.lower(b)), a)).otherwise(safe_date(c, b, a))

    return let(F.split(found, r"[^0-9A-Za-z]+"), read)


def find_dates(text: Column) -> Column:
    """All valid dates of a text in order of appearance: written out, ISO, or day first with / . or -."""
    return F.filter(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_ANY), F.lit(0)), _one), lambda d: d.isNotNull())


def parse_date(text: Column) -> Column:
    """The first date of a text."""
    return F.get(find_dates(text), 0)


def date_range_in_order(text: Column) -> Column:
    """False only where a text's second date lies before its first."""
    found = find_dates(text)
    return F.coalesce(F.get(found, 1) >= F.get(found, 0), F.lit(True))


def parse_date_by_priority(text: Column) -> Column:
    """Another reading: the first ISO date decides, else the first day/month/year with / or -, else day, full month name and year, else a date all in words."""
    t = F.lower(F.trim(text))
    iso, dmy, named = r"\b(\d{4})-(\d{1,2})-(\d{1,2})\b", r"\b(\d{1,2})[/-](\d{1,2})[/-](\d{4})\b", r"\b(\d{1,2})\s+([a-z]+)\s+(\d{4})\b"
    spelled = r"tanggal\s+([a-z\s]+?)\s+bulan\s+([a-z]+)\s+tahun\s+([a-z\s]+)"
    part = lambda pattern, k: F.regexp_extract(t, pattern, k)
    month = lambda name: F.nullif(F.array_position(F.array(*[F.lit(m) for m in FULL_MONTHS]), name), F.lit(0).cast("long"))
    day, year = plain_number_words(part(spelled, 1)), plain_number_words(part(spelled, 3))
    in_words = F.when(month(part(spelled, 2)).isNotNull() & day.between(1, 31) & year.between(2000, 2099), safe_date(year, month(part(spelled, 2)), day))
    return (
        F.when(t.rlike(iso), safe_date(part(iso, 1), part(iso, 2), part(iso, 3)))
        .when(t.rlike(dmy), safe_date(part(dmy, 3), part(dmy, 2), part(dmy, 1)))
        .when(month(part(named, 2)).isNotNull(), safe_date(part(named, 3), month(part(named, 2)), part(named, 1)))
        .when(t.rlike(spelled), in_words)
    )


def write_date(day: Column) -> Column:
    """A date in Indonesian, such as 2 Juni 2026."""
    names = F.array(*[F.lit(m.capitalize()) for m in FULL_MONTHS])
    return F.concat_ws(" ", F.dayofmonth(day).cast("string"), F.element_at(names, F.month(day)), F.year(day).cast("string"))
