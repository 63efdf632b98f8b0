"""Predicates on extracted values and table columns, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lontar.functions.text import is_empty

# Phrases that refuse a value, header words by alignment.
REFUSALS = ("informasi tidak", "tidak tersedia", "tidak disebutkan", "tidak disediakan", "tidak ada", "tidak ditemukan", "tidak diketahui", "belum tersedia", "information not", "not available", "not found", "n/a")
RIGHT_HEADERS = ("harga", "jumlah", "total", "subtotal", "sub total", "vol", "volume", "nilai", "tarif", "rp", "ppn", "biaya")
CENTER_HEADERS = ("no", "no.", "nomor", "sat", "satuan", "unit", "kode", "status")


def _any_of(text: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for part in parts:
        out = out | text.contains(part)
    return out


def is_placeholder(text: Column) -> Column:
    """No value, or words that only say so."""
    return is_empty(text) | F.coalesce(_any_of(F.lower(text), REFUSALS), F.lit(False))


def is_missing(text: Column, number: Column | None = None) -> Column:
    """A placeholder; with a number, zero counts as missing too."""
    return is_placeholder(text) if number is None else F.coalesce(number == 0, F.lit(True))


def is_numeric_text(text: Column) -> Column:
    return F.coalesce(F.trim(text).rlike(r"(?i)^(?:Rp\.?\s*)?\d[\d.,\s]*(?:,-)?$"), F.lit(False))


def is_numeric_cell(text: Column) -> Column:
    """An optional currency, digits with dots or commas between, and trailing percent signs or dashes."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"(?i)^(?:Rp\.?|IDR|\$)\s*", ""), "[%\u2013\u2014-]+$", "")
    return F.coalesce(F.trim(bare).rlike(r"^-?\d+(?:[.,]\d+)*$"), F.lit(False))


def stored(path: Column, denied: tuple[str, ...] = ("NPWP",)) -> Column:
    """The last part of a field's path may be kept."""
    return ~F.element_at(F.split(path, r"\."), -1).isin(*denied)


def charge_type(text: Column) -> Column:
    """One-time, monthly, or both; null for anything else."""
    t = F.upper(F.coalesce(text, F.lit("")))
    once, monthly = t.rlike(r"\bOTC\b"), t.rlike(r"\bMRC\b|\bBULANAN\b")
    return F.when(once & monthly, "OTC dan MRC").when(once, "OTC").when(monthly, "MRC")


def is_our_company(name: Column, patterns: tuple[str, ...]) -> Column:
    return F.coalesce(name.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def alignment(header: Column, column: Column) -> Column:
    """right, center or left for a table column, by its header's words, then by its cells (an array)."""
    h = F.lower(F.trim(header))
    filled = F.filter(column, lambda c: F.trim(c) != "")
    n = F.size(filled)
    numeric = F.size(F.filter(filled, is_numeric_cell)) / n
    mean = F.aggregate(filled, F.lit(0), lambda s, c: s + F.length(c)) / n
    short = (mean <= 4) & F.forall(filled, lambda c: F.length(c) <= 6)
    return F.when(n == 0, "left").when(_any_of(h, RIGHT_HEADERS), "right").when(_any_of(h, CENTER_HEADERS), "center").when(numeric >= 0.7, "right").when(short, "center").otherwise("left")


def prompt_text(text: Column, most: int = 32_000, head: int = 60, tail: int = 40, middle: int = 40, keywords: tuple[str, ...] = ("pasal", "pembayaran", "rekening", "bank", "jangka waktu", "denda", "sanksi", "total", "ppn", "garansi", "lampiran", "serah terima")) -> Column:
    """A long text for a model with a limited window: its first and last lines, lines with key words between, and every table line."""
    lines = F.split(text, "\n")
    table = lambda x: F.trim(x).rlike(r"^\|.*\|$")
    plain, rows = F.filter(lines, lambda x: ~table(x)), F.filter(lines, table)
    n = F.size(plain)
    between = F.when(n > head + tail, F.slice(plain, F.lit(head + 1), F.greatest(n - head - tail, F.lit(0)))).otherwise(F.slice(plain, 1, 0))
    keyed = F.slice(F.filter(between, lambda x: _any_of(F.lower(x), keywords)), 1, middle)
    ending = F.when(n > tail, F.slice(plain, F.greatest(n - tail + 1, F.lit(1)), F.lit(tail))).otherwise(F.slice(plain, 1, 0))
    parts = F.concat(F.slice(plain, 1, head), keyed, rows, ending)
    return F.when(F.length(text) <= most, text).otherwise(F.array_join(parts, "\n"))
