"""Reconciliation of competing sources. A value is replaced only by one that the document states, and never computed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lontar.functions import let
from lontar.functions.dates import find_dates
from lontar.functions.identifiers import company_words, segments
from lontar.functions.numbers import VAT_RATES, amounts_equal, confirmed_amounts, is_written, numbers_in_text, spelled_amount
from lontar.functions.text import canon
from lontar.operators.tables import SUMMARY, markdown_tables

TOLERANCE = 1000.0
_VAT = r"(?:ppn|pajak\s+pertambahan\s+nilai(?:\s*\(\s*ppn\s*\))?)(?:\s*\d{1,2}(?:[.,]\d{1,2})?\s*%)?"
EXCLUDED = rf"(?i)(?:(?:belum|tidak)\s+termasuk|sebelum|exclude|excl\.?)\s+{_VAT}"
INCLUDED = rf"(?i)(?<!belum )(?<!tidak )(?:sudah\s+termasuk|termasuk|include|incl\.?|setelah)\s+{_VAT}"


def item_sum(items: Column) -> Column:
    """The line totals of an array of items (structs with total)."""
    return F.aggregate(items, F.lit(0.0), lambda s, x: s + F.coalesce(x["total"], F.lit(0.0)))


def _fits(amount: Column, references: Column) -> Column:
    return F.coalesce(F.exists(references, lambda r: amounts_equal(amount, r, TOLERANCE)), F.lit(False))


def written_references(amounts: Column, text: Column) -> Column:
    """The amounts that the document states, and each of them less VAT at a known rate."""
    stated = F.filter(amounts, lambda r: r.isNotNull() & (r != 0) & is_written(r, text))
    less = [F.transform(stated, _without(rate)) for rate in VAT_RATES]
    return F.concat(stated, *less)


def _without(rate: float):
    return lambda r: r / (1 + rate)


def collapsed(items: Column) -> Column:
    """Consecutive items of one number and price (structs with number, description, price, total) as one, with the first total."""
    start = F.slice(items, 1, 0)

    def step(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        same = last["number"].eqNullSafe(x["number"]) & last["price"].eqNullSafe(x["price"]) & x["price"].isNotNull()
        return F.when((F.size(done) > 0) & F.coalesce(same, F.lit(False)), done).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(items, start, step)


def choose_items(df: DataFrame, tables: str, model: str, references: str, text: str) -> DataFrame:
    """df with ``chosen`` (an array of items) and ``source`` (table or model).

    tables is an array of tables, each an array of items; model the other source's items; references the header amounts. If
    all tables together fit no reference but the document states one, single tables (longest first), collapsed rows, and
    single collapsed tables are tried for a stated one. Then the table wins if only it fits, or if both or neither do and it
    has no fewer rows or the other list holds a summary row.
    """
    longest = lambda groups: F.array_sort(groups, lambda a, b: F.size(b) - F.size(a))
    groups = F.filter(F.col(tables), lambda g: F.size(g) > 0)
    narrow = F.transform(groups, collapsed)
    staged = df.withColumn("__written", written_references(F.col(references), F.col(text))).withColumn("__all", F.flatten(groups))
    any_reference = F.concat("__written", F.filter(F.col(references), lambda r: r.isNotNull() & (r != 0)))
    tries = F.concat(F.when(F.size(groups) > 1, longest(groups)).otherwise(F.slice(groups, 1, 0)), F.array(F.flatten(narrow)), F.when(F.size(groups) > 1, longest(narrow)).otherwise(F.slice(groups, 1, 0)))
    better = F.get(F.filter(tries, lambda g: _fits(item_sum(g), F.col("__written"))), 0)
    staged = staged.withColumn("__table", F.when((F.size("__written") > 0) & ~_fits(item_sum(F.col("__all")), any_reference), F.coalesce(better, F.col("__all"))).otherwise(F.col("__all")))
    table_fits, model_fits = _fits(item_sum(F.col("__table")), any_reference), _fits(item_sum(F.col(model)), any_reference)
    summary = F.exists(F.col(model), lambda x: F.trim(x["description"]).rlike(SUMMARY))
    wins = (table_fits & ~model_fits) | ((table_fits == model_fits) & ((F.size("__table") >= F.size(model)) | summary))
    use = (F.size("__table") > 0) & wins
    return staged.withColumn("chosen", F.when(use, F.col("__table")).otherwise(F.col(model))).withColumn("source", F.when(use, "table").otherwise("model")).drop("__written", "__all", "__table")


def prefer_confirmed(amount: Column, text: Column) -> Column:
    """An amount that isn't written gives way to the only one that the text confirms in words."""
    sure = confirmed_amounts(text)
    return F.when(~F.coalesce(is_written(amount, text), F.lit(False)) & (F.size(sure) == 1), F.get(sure, 0)).otherwise(amount)


def drop_unwritten(amount: Column, text: Column) -> Column:
    return F.when(is_written(amount, text), amount)


def drop_absurd_vat(vat: Column, subtotal: Column) -> Column:
    """A VAT above its subtotal is a misread cell."""
    return F.when(~F.coalesce(vat > subtotal, F.lit(False)), vat)


def vat_mention(text: Column) -> Column:
    """The phrase that says whether prices include VAT, if the text says only one of the two."""
    flat = F.regexp_replace(text, r"\s+", " ")
    out, inside = F.trim(F.regexp_extract(flat, EXCLUDED, 0)), F.trim(F.regexp_extract(flat, INCLUDED, 0))
    return F.when((out != "") & (inside == ""), out).when((inside != "") & (out == ""), inside)


def vat_rate(text: Column, rate: Column) -> Column:
    """The rate, or where it is empty the first one that a phrase on VAT names."""
    flat = F.regexp_replace(text, r"\s+", " ")
    phrases = F.regexp_extract_all(flat, F.lit(f"{EXCLUDED}|{INCLUDED}"), F.lit(0))
    named = F.get(F.filter(F.transform(phrases, lambda p: F.regexp_extract(p, r"(\d{1,2}(?:[.,]\d{1,2})?)\s*%", 1)), lambda r: r != ""), F.lit(0))
    return F.coalesce(F.nullif(F.trim(rate), F.lit("")), F.when(vat_mention(text).isNotNull() & named.isNotNull(), F.concat(named, F.lit("%"))))


def written_words(text: Column, amount: Column) -> Column:
    """The first phrase in brackets that spells the amount ("... Rupiah"); null if the text has none."""
    said = F.transform(F.regexp_extract_all(text, F.lit(r"\(\s*([A-Za-z][A-Za-z\s]{10,200}?(?:Rupiah|rupiah))\s*\)"), F.lit(1)), lambda w: F.trim(F.regexp_replace(w, r"\s+", " ")))
    return F.get(F.filter(said, lambda w: spelled_amount(w) == F.round(amount).cast("long")), F.lit(0))


def fill_words(words: Column, text: Column, amounts: list[Column]) -> Column:
    """Words that spell one of the amounts stay; else what the text itself spells, the first amount first; nothing is composed."""
    fits = None
    for a in amounts:
        same = F.coalesce((spelled_amount(words) == F.round(a).cast("long")) & (a != 0), F.lit(False))
        fits = same if fits is None else fits | same
    return F.when(~fits, F.coalesce(*[F.when(a != 0, written_words(text, a)) for a in amounts], words)).otherwise(words)


def corrected_subtotals(df: DataFrame, key: str, subtotal: str, item_totals: str, text: str) -> DataFrame:
    """df with a subtotal that was read from another column of a summary row replaced by that row's other number, if that
    equals the sum of all item totals; both numbers are written there."""
    tables = markdown_tables(df.select(key, text), key, text).select(key, F.explode("rows").alias("row"))
    filled = F.filter("row", lambda c: c != "")
    summary = tables.filter(F.get(filled, F.lit(0)).rlike(SUMMARY)).select(key, F.concat_ws(" | ", "row").alias("line"))
    lines = summary.groupBy(key).agg(F.collect_list("line").alias("lines"))
    whole = F.forall(item_totals, lambda t: t.isNotNull()) & (F.size(item_totals) > 0)
    total = F.when(whole, F.aggregate(item_totals, F.lit(0.0), lambda s, t: s + F.coalesce(t, F.lit(0.0))))
    has = lambda line, n: F.exists(numbers_in_text(line), lambda x: amounts_equal(x, n))
    wrong = (F.col(subtotal) != 0) & total.isNotNull() & ~amounts_equal(F.col(subtotal), total) & F.exists("lines", lambda x: has(x, F.col(subtotal)) & has(x, total))
    return df.join(lines, key, "left").withColumn(subtotal, F.when(F.coalesce(wrong, F.lit(False)), total).otherwise(F.col(subtotal))).drop("lines")


def handover_items(model: Column, table: Column) -> Column:
    """Hand-over lists have no prices to check: the table's items win unless they are fewer than the model's."""
    return F.when((F.size(table) > 0) & ((F.size(model) == 0) | (F.size(table) >= F.size(model))), table).otherwise(model)


def plain_phrase(text: Column) -> Column:
    """Lower case, single blanks, no marks around: two spellings of one entry."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " ")), "^[ .,;]+|[ .,;]+$", "")


def tidy_supporting(papers: Column, attachments: Column, negotiated: Column) -> Column:
    """A struct (papers, attachments, negotiated): a date copied into a paper's number goes, attachments that are papers go,
    and an empty negotiation date comes from a paper on a negotiation. papers are structs (name, number, date)."""
    only_date = lambda n: n.rlike(r"^\s*\d{1,2}\s+[A-Za-z]+\s+\d{4}\s*$") & (F.size(find_dates(n)) > 0)
    known = F.transform(papers, lambda p: plain_phrase(p["name"]))
    left = F.filter(attachments, lambda x: ~F.array_contains(known, plain_phrase(x)))
    dated = F.get(F.filter(papers, lambda p: p["name"].rlike("(?i)negosiasi") & (F.coalesce(p["date"], F.lit("")) != "")), F.lit(0))["date"]
    cleaned = F.transform(papers, lambda p: p.withField("number", F.when(~F.coalesce(only_date(p["number"]), F.lit(False)), p["number"])))
    return F.struct(cleaned.alias("papers"), F.when(F.size(left) > 0, left).alias("attachments"), F.coalesce(F.nullif(negotiated, F.lit("")), dated).alias("negotiated"))


def party_marks(name: Column) -> Column:
    """The initials of a company's telling words (three letters at least) and the first three and four letters of each."""
    w = company_words(name)
    initials = F.upper(F.array_join(F.transform(w, lambda x: F.substring(x, 1, 1)), ""))
    heads = F.concat(F.transform(w, lambda x: F.upper(F.substring(x, 1, 3))), F.transform(w, lambda x: F.upper(F.substring(x, 1, 4))))
    return F.array_distinct(F.filter(F.concat(F.array(initials), heads), lambda x: F.length(x) >= 3))


def number_owner(number: Column, first: Column, second: Column) -> Column:
    """1 or 2 for the party whose mark stands in a document number; null if neither's or both's does."""
    parts = segments(number)
    a, b = F.arrays_overlap(parts, party_marks(first)), F.arrays_overlap(parts, party_marks(second))
    return F.when(a & ~b, 1).when(b & ~a, 2)


def contract_numbers(number: Column, internal: Column, first: Column, second: Column) -> Column:
    """A struct (number, internal): the two are swapped only if both owners are clear and the wrong way round."""
    swapped = (number_owner(number, first, second) == 2) & (number_owner(internal, first, second) == 1)
    yes = F.coalesce(swapped, F.lit(False))
    return F.struct(F.when(yes, internal).otherwise(number).alias("number"), F.when(yes, number).otherwise(internal).alias("internal"))


def fill_empty(original: Column, retry: Column, empty: Column) -> Column:
    """A second answer fills only what the first left empty."""
    return F.when(empty, F.coalesce(retry, original)).otherwise(original)


def drop_prompt_echo(value: Column, text: Column, prompt: Column) -> Column:
    """Four words or more that the prompt has, as whole words, and the document hasn't were copied from the example."""
    padded = lambda c: F.concat(F.lit(" "), canon(c), F.lit(" "))
    echo = (F.size(F.split(canon(value), " ")) >= 4) & F.contains(padded(prompt), padded(value)) & ~F.contains(padded(text), padded(value))
    return F.when(~F.coalesce(echo, F.lit(False)), value)


def number_items(items: Column) -> Column:
    """Items (structs with number and description) without summary rows, numbers taken from the descriptions, missing ones and
    a number that all share replaced by the place."""
    from lontar.operators.tables import split_number

    kept = F.filter(items, lambda x: ~F.coalesce(F.trim(x["description"]).rlike(SUMMARY), F.lit(False)))

    def cleaned(x: Column) -> Column:
        return let(split_number(F.coalesce(x["description"], F.lit(""))), lambda p: x.withField("description", p["text"]).withField("number", F.coalesce(p["number"], x["number"])))

    def placed(done: Column) -> Column:
        blank = lambda n: F.coalesce(F.trim(n).isin("", "0", "None", "null", "-"), F.lit(True))
        filled = F.transform(done, lambda x, i: x.withField("number", F.when(blank(x["number"]), (i + 1).cast("string")).otherwise(x["number"])))
        same = (F.size(filled) > 1) & (F.size(F.array_distinct(F.transform(filled, lambda x: x["number"]))) == 1)
        return F.transform(filled, lambda x, i: x.withField("number", F.when(same, (i + 1).cast("string")).otherwise(x["number"])))

    return let(F.transform(kept, cleaned), placed)
