"""Numbers, money and spelled-out amounts in Indonesian (and English) notation, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lontar.functions import let

_PLAIN = r"^\d*\.?\d*$"
TOKEN = r"\d[\d.,]*\d|\d"
_GROUPED_MONEY = r"(?<![\d.,/\-])(\d{1,3}(?:\.\d{3}){2,})(?:,(?:00|-))?(?!\d|[.,/\-]\d)"

# Number words.
UNITS = {"nol": 0, "satu": 1, "dua": 2, "tiga": 3, "empat": 4, "lima": 5, "enam": 6, "tujuh": 7, "delapan": 8, "sembilan": 9}
SCALES = {"ribu": 10**3, "juta": 10**6, "miliar": 10**9, "milyar": 10**9, "triliun": 10**12}
WITH_SE = {"sepuluh": "puluh", "sebelas": "belas", "seratus": "ratus", "seribu": "ribu", "sejuta": "juta"}
# VAT rates that amounts may be matched with.
VAT_RATES = (0.10, 0.11, 0.12)


def _value(text: Column) -> Column:
    """The number that a cleaned run of digits, dots and commas stands for; null if it reads as none or as two."""
    dots, commas = F.regexp_count(text, F.lit(r"\.")), F.regexp_count(text, F.lit(","))
    last_comma = F.length(F.substring_index(text, ",", -1)) < F.length(F.substring_index(text, ".", -1))
    no_dots, no_commas = F.replace(text, F.lit("."), F.lit("")), F.replace(text, F.lit(","), F.lit(""))
    with_cents = F.concat(F.regexp_replace(F.regexp_extract(text, r"^(.*)\.\d{2}$", 1), r"\.", ""), F.regexp_extract(text, r"(\.\d{2})$", 1))
    chosen = (
        F.when((dots > 0) & (commas > 0), F.when(last_comma, F.replace(no_dots, F.lit(","), F.lit("."))).otherwise(no_commas))
        .when((dots > 0) & text.rlike(r"^\d{1,3}(?:\.\d{3})+\.\d{2}$"), with_cents)
        .when((dots > 0) & text.rlike(r"^\d{1,3}(?:\.\d{3})+$"), no_dots)
        .when(dots > 1, F.lit(None))
        .when((commas > 1) & text.rlike(r"^\d{1,3}(?:,\d{3})+$"), no_commas)
        .when(commas > 0, F.replace(text, F.lit(","), F.lit(".")))
        .otherwise(text)
    )
    return let(chosen, lambda c: F.when(c.rlike(_PLAIN) & c.rlike(r"\d"), c.cast("double")))


def parse_number(text: Column) -> Column:
    """A double from text such as "Rp. 166.500.000,-", "1,5" or "1,234,567.89"; null if there is no readable number.

    Dots group thousands. Two glued amounts ("5.000.00050.000.000") give null, never a huge number.
    """
    t = F.trim(F.regexp_replace(text.cast("string"), r"(?i)^\s*(?:Rp\.?|IDR)\s*", ""))
    t = F.regexp_replace(t, r",\s*(?:-+|0{2})\s*$", "")
    t = F.regexp_replace(t, r"(?<=\.\d{3})\s(?=\d{3}(?![\d.]))", ".")
    t = F.regexp_replace(t, r"[^\d.,\-]", "")

    def signed(t: Column) -> Column:
        plain = F.regexp_replace(F.regexp_replace(t, r"^-+|-+$", ""), r"\.+$", "")
        number = let(plain, lambda p: F.when(p.rlike(r"\d"), _value(p)))
        return number * F.when(t.startswith("-"), -1.0).otherwise(1.0)

    return let(t, signed)


def parse_number_or_zero(text: Column) -> Column:
    return F.coalesce(parse_number(text), F.lit(0.0))


def numbers_in_text(text: Column) -> Column:
    """All readable numeric tokens of a text, in order."""
    return F.filter(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), parse_number), lambda x: x.isNotNull())


def normalize_money(text: Column) -> Column:
    """Amounts of at least two dotted groups without their dots; tax ids, account and document numbers stay."""
    pieces = F.regexp_extract_all(text, F.lit(_GROUPED_MONEY), F.lit(1))
    gaps = F.split(text, _GROUPED_MONEY, -1)
    values = F.concat(F.transform(pieces, lambda x: F.replace(x, F.lit("."), F.lit(""))), F.array(F.lit("")))
    return F.array_join(F.zip_with(gaps, values, lambda a, b: F.concat(a, b)), "")


def format_for_matching(number: Column) -> Column:
    """Whole doubles without a fraction, other numbers as they print."""
    return F.when(number == F.floor(number), F.floor(number).cast("string")).otherwise(number.cast("string"))


def amounts_equal(a: Column, b: Column, tolerance: float = 1.0) -> Column:
    return F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))


def nonzero(number: Column) -> Column:
    """Zero counts as not written."""
    return F.when(number != 0, number)


def percent(text: Column) -> Column:
    """The first "n%" as a fraction."""
    return parse_number(F.nullif(F.regexp_extract(text, r"(\d+(?:[.,]\d+)?)\s*%", 1), F.lit(""))) / 100


def spelled_amount(text: Column) -> Column:
    """The whole number that Indonesian number words spell, up to the trillions; null without any number word.

    A fold over the words: a unit waits in ``digit`` until a rank (belas, puluh, ratus) moves it to ``group`` or a scale
    word moves the group to ``total``. Other words are passed over; "koma" and "sen" end the reading.
    """
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))
    table = F.create_map(*[x for k, v in UNITS.items() for x in (F.lit(k), F.lit(v).cast("long"))])
    scales = F.create_map(*[x for k, v in SCALES.items() for x in (F.lit(k), F.lit(v).cast("long"))])
    ranks = F.create_map(F.lit("puluh"), F.lit(10).cast("long"), F.lit("ratus"), F.lit(100).cast("long"))
    split = F.create_map(*[x for k, v in WITH_SE.items() for x in (F.lit(k), F.array(F.lit("satu"), F.lit(v)))])
    parts = F.flatten(F.transform(words, lambda w: F.coalesce(F.try_element_at(split, w), F.array(w))))

    def step(a: Column, w: Column) -> Column:
        def state(total, group, digit, seen=None, done=None):
            return F.struct(total.alias("total"), group.alias("group"), digit.alias("digit"), (a["seen"] if seen is None else seen).alias("seen"), (a["done"] if done is None else done).alias("done"))

        zero, yes = F.lit(0).cast("long"), F.lit(True)
        unit, scale, rank = F.try_element_at(table, w), F.try_element_at(scales, w), F.try_element_at(ranks, w)
        group = a["group"] + a["digit"]
        return (
            F.when(a["done"], a)
            .when(unit.isNotNull(), state(a["total"], a["group"], a["digit"] + unit, yes))
            .when(w == "belas", state(a["total"], a["group"] + a["digit"] + 10, zero))
            .when(rank.isNotNull(), state(a["total"], a["group"] + a["digit"] * rank, zero))
            .when(scale.isNotNull(), state(a["total"] + F.when(group == 0, 1).otherwise(group) * scale, zero, zero, yes))
            .when(w.isin("koma", "sen"), state(a["total"], a["group"], a["digit"], None, yes))
            .otherwise(a)
        )

    start = F.struct(*[F.lit(0).cast("long").alias(k) for k in ("total", "group", "digit")], F.lit(False).alias("seen"), F.lit(False).alias("done"))
    return F.aggregate(parts, start, step, lambda a: F.when(a["seen"], a["total"] + a["group"] + a["digit"]))


def spell(number: Column) -> Column:
    """Indonesian words for a whole number below 10**15 (nol for zero): the inverse of spelled_amount."""
    digits = F.array(*[F.lit(w) for w in ("", "satu", "dua", "tiga", "empat", "lima", "enam", "tujuh", "delapan", "sembilan")])

    def group(n: Column) -> Column:
        hundreds, rest = F.floor(n / 100), n % 100
        tens, ones = F.floor(rest / 10), rest % 10
        word = lambda k: F.element_at(digits, (k + 1).cast("int"))
        return F.concat_ws(
            " ",
            F.when(hundreds == 1, "seratus").when(hundreds > 1, F.concat(word(hundreds), F.lit(" ratus"))),
            F.when(rest == 10, "sepuluh").when(rest == 11, "sebelas").when((tens == 1), F.concat(word(ones), F.lit(" belas"))).when(tens > 1, F.concat(word(tens), F.lit(" puluh"))),
            F.when((tens != 1) & (ones > 0), word(ones)),
        )

    parts = []
    for scale, name in ((10**12, "triliun"), (10**9, "miliar"), (10**6, "juta"), (10**3, "ribu"), (1, "")):
        n = F.floor(number / scale) % 1000
        parts.append(F.when(n > 0, F.when((n == 1) & (F.lit(name) == "ribu"), "seribu").otherwise(F.rtrim(F.concat(group(n), F.lit(f" {name}"))))))
    return F.when(number == 0, "nol").otherwise(F.concat_ws(" ", *parts))


def clean_quantity(cell: Column) -> Column:
    """A quantity only if the cell holds exactly one number and no odd symbol."""
    found = F.regexp_extract_all(cell, F.lit(r"\d+(?:[.,]\d+)*"), F.lit(0))
    return F.when((F.size(found) == 1) & ~cell.rlike(r"[^\p{L}\p{N}_\s.,/()\-]"), parse_number(F.get(found, F.lit(0))))


def plain_number_words(text: Column) -> Column:
    """A whole number below a million that consists of number words alone, as dates are spelled; null for any other word, and for zero.

    A unit waits for a rank (belas, puluh, ratus); ribu closes what is before it.
    """
    split = F.create_map(*[x for k, v in {**WITH_SE, "seribu": "ribu"}.items() if v in ("puluh", "belas", "ratus", "ribu") for x in (F.lit(k), F.array(F.lit("satu"), F.lit(v)))])
    words = F.filter(F.split(F.lower(F.trim(text)), r"[\s-]+"), lambda w: w != "")
    parts = F.flatten(F.transform(words, lambda w: F.coalesce(F.try_element_at(split, w), F.array(F.when(w == "se", "satu").otherwise(w)))))
    units = F.create_map(*[x for k, v in UNITS.items() for x in (F.lit(k), F.lit(v).cast("long"))])
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("total"), zero.alias("group"), zero.alias("digit"))

    def step(a: Column, w: Column) -> Column:
        unit = F.try_element_at(units, w)
        put = lambda total, group, digit: F.struct(total.alias("total"), group.alias("group"), digit.alias("digit"))
        one = F.greatest(a["digit"], F.lit(1).cast("long"))
        return (
            F.when(unit.isNotNull(), put(a["total"], a["group"], unit))
            .when(w == "belas", put(a["total"], a["group"] + 10 + a["digit"], zero))
            .when(w == "puluh", put(a["total"], a["group"] + one * 10, zero))
            .when(w == "ratus", put(a["total"], a["group"] + one * 100, zero))
            .when(w == "ribu", put(a["total"] + F.greatest(a["group"] + a["digit"], F.lit(1).cast("long")) * 1000, zero, zero))
        )

    known = F.forall(parts, lambda w: w.isin(*UNITS, "belas", "puluh", "ratus", "ribu"))
    total = F.aggregate(parts, start, step, lambda a: a["total"] + a["group"] + a["digit"])
    return F.when((F.size(parts) > 0) & known, F.nullif(total, F.lit(0).cast("long")))


def strip_runaway_digits(text: Column) -> Column:
    """Runs of twenty digits or more are generation accidents and go."""
    return F.regexp_replace(text, r"\d{20,}", "")


_WITH_WORDS = r"(?i)Rp[\s.:]*(\d[\d.,]*\d)\s*,?-*\s*\(([^()]{5,250}?)\)"


def confirmed_amounts(text: Column) -> Column:
    """Amounts that a text states twice, in digits and in words, and that agree; distinct, in order of appearance."""
    digits = F.regexp_extract_all(text, F.lit(_WITH_WORDS), F.lit(1))
    words = F.regexp_extract_all(text, F.lit(_WITH_WORDS), F.lit(2))
    pairs = F.zip_with(digits, words, lambda d, w: F.struct(parse_number(d).alias("n"), spelled_amount(w).alias("w")))
    return F.array_distinct(F.transform(F.filter(pairs, lambda p: amounts_equal(p["n"], p["w"].cast("double"))), lambda p: p["n"]))


def is_written(number: Column, text: Column) -> Column:
    """The amount occurs in the text as digits (within one) or in words."""
    return F.exists(numbers_in_text(text), lambda x: F.abs(x - number) <= 1) | F.exists(confirmed_amounts(text), lambda x: F.abs(x - number) <= 1)
