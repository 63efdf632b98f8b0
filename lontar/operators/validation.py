"""Business rules over extracted documents, as one issues relation (key, rule, severity, fields, expected, actual).

Headers are a DataFrame keyed by document with subtotal, vat, total, rate_text and words_text; items have quantity, unit_price,
period_factor and line_total. A zero header amount counts as not written; a zero line total is a free item.
"""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lontar.functions.dates import find_dates
from lontar.functions.numbers import VAT_RATES, amounts_equal, nonzero, parse_number, percent, spelled_amount
from lontar.operators.tables import is_separator, table_rows

TOLERANCE = 1000.0
MOST_FACTOR = 10_000


def close(a: Column, b: Column) -> Column:
    return amounts_equal(a, b, TOLERANCE)


def _issues(df: DataFrame, key: str, rule: str, severity: str, bad: Column, expected: Column, actual: Column, fields: list[Column] | Column = ()) -> DataFrame:
    named = fields if isinstance(fields, Column) else F.array(*fields).cast("array<string>")
    return df.filter(bad).select(key, F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), named.alias("fields"), expected.cast("double").alias("expected"), actual.cast("double").alias("actual"))


def total_issues(headers: DataFrame, key: str) -> DataFrame:
    """subtotal + VAT = total, total not below subtotal, VAT fits its rate (or 11/12 of it)."""
    h = headers.withColumns({c: nonzero(F.col(c)) for c in ("subtotal", "vat", "total")}).withColumn("rate", nonzero(percent(F.col("rate_text"))))
    both, summed = F.col("subtotal").isNotNull() & F.col("total").isNotNull(), F.col("subtotal") + F.coalesce("vat", F.lit(0.0))
    rated = F.col("subtotal").isNotNull() & F.col("vat").isNotNull() & F.col("rate").isNotNull()
    first, second = F.col("subtotal") * F.col("rate"), F.col("subtotal") * F.col("rate") * 11 / 12
    return (
        _issues(h, key, "total_equals_subtotal_plus_vat", "error", both & ~close(summed, F.col("total")), summed, F.col("total"), _lits("subtotal", "vat", "total"))
        .unionByName(_issues(h, key, "total_not_below_subtotal", "error", both & (F.col("total") < F.col("subtotal")), F.col("subtotal"), F.col("total"), _lits("subtotal", "total")))
        .unionByName(_issues(h, key, "vat_matches_rate", "warning", rated & ~close(F.col("vat"), first) & ~close(F.col("vat"), second), F.round(first, 2), F.col("vat"), _lits("vat", "rate_text")))
    )


def words_issues(headers: DataFrame, key: str) -> DataFrame:
    """The amount in words equals the total or the subtotal, within one."""
    h = headers.withColumns({c: nonzero(F.col(c)) for c in ("subtotal", "total")}).withColumn("spelled", spelled_amount(F.col("words_text")).cast("double"))
    bad = F.col("spelled").isNotNull() & F.coalesce("total", "subtotal").isNotNull() & ~amounts_equal(F.col("spelled"), F.col("total")) & ~amounts_equal(F.col("spelled"), F.col("subtotal"))
    return _issues(h, key, "words_match_amount", "error", bad, F.coalesce("total", "subtotal"), F.col("spelled"), _lits("words_text"))


def line_issues(items: DataFrame, key: str) -> DataFrame:
    """quantity x unit price = line total, also times the period or a small number among the line's extra values, where all are written.

    items: quantity, unit_price, line_total, and if there are such columns line_no, period_factor and extra (a map of texts).
    """
    qty, price, total = nonzero(F.col("quantity")), nonzero(F.col("unit_price")), F.col("line_total")
    period = nonzero(F.col("period_factor")) if "period_factor" in items.columns else F.lit(None).cast("double")
    fits = close(total, qty * price) | F.coalesce(close(total, qty * price * period), F.lit(False))
    if "extra" in items.columns:
        factors = F.filter(F.transform(F.map_values(F.coalesce("extra", F.create_map().cast("map<string,string>"))), parse_number), lambda m: (m != 0) & (m < MOST_FACTOR))
        fits = fits | F.exists(factors, lambda m: close(total, qty * price * m))
    bad = qty.isNotNull() & price.isNotNull() & total.isNotNull() & ~fits
    line = F.concat(F.lit("items["), (F.col("line_no") - 1).cast("string"), F.lit("].")) if "line_no" in items.columns else F.lit("items.")
    return _issues(items, key, "item_line_total", "warning", bad, F.round(qty * price, 2), total, [F.concat(line, F.lit(f)) for f in ("quantity", "unit_price", "line_total")])


def item_sums(items: DataFrame, key: str) -> DataFrame:
    return items.groupBy(key).agg(F.sum("line_total").alias("line_sum"), F.bool_and(F.col("line_total").isNotNull()).alias("complete"), F.count("*").alias("lines"))


def _every_line(lines: Column) -> Column:
    """The list, each line's price and total by name, and the subtotal: evidence is matched by a field's exact name."""
    each = F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(lines, F.lit(1).cast("long")) - 1), lambda i: F.array(*[F.concat(F.lit("items["), i.cast("string"), F.lit(f"].{f}")) for f in ("unit_price", "line_total")])))
    return F.concat(F.array(F.lit("items")), each, F.array(F.lit("subtotal")))


def _lits(*names: str) -> list[Column]:
    return [F.lit(n) for n in names]


def sum_issues(headers: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """All lines together give the subtotal, the total, or (without a subtotal) the total less VAT at a known rate."""
    h = headers.withColumns({c: nonzero(F.col(c)) for c in ("subtotal", "total")}).join(item_sums(items, key), key)
    with_vat = F.col("subtotal").isNull() & reduce(lambda x, y: x | y, [close(F.col("line_sum") * (1 + r), F.col("total")) for r in VAT_RATES])
    fits = close(F.col("line_sum"), F.col("subtotal")) | close(F.col("line_sum"), F.col("total")) | with_vat
    bad = F.col("complete") & (F.col("line_sum") != 0) & F.coalesce("subtotal", "total").isNotNull() & ~fits
    return _issues(h, key, "items_sum_matches_subtotal", "warning", bad, F.col("subtotal"), F.col("line_sum"), _every_line(F.col("lines")))


def required_issues(headers: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A warning for each required column that is null or blank."""
    blank = F.filter(F.array(*[F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), F.lit(c)) for c in columns]), lambda x: x.isNotNull())
    none = F.lit(None).cast("double")
    each = headers.select(key, F.explode(blank).alias("field"))
    return each.select(key, F.concat(F.lit("required_fields:"), "field").alias("rule"), F.lit("warning").alias("severity"), F.array("field").alias("fields"), none.alias("expected"), none.alias("actual"))


def _day(day: Column) -> Column:
    return F.datediff(day, F.lit("1970-01-01").cast("date"))


def date_order_issues(headers: DataFrame, key: str, earlier: str, later: str) -> DataFrame:
    """A date that lies before the one that must not follow it."""
    return _issues(headers, key, f"{later}_after_{earlier}", "error", F.col(later) < F.col(earlier), _day(F.col(earlier)), _day(F.col(later)), _lits(earlier, later))


def date_range_issues(headers: DataFrame, key: str, column: str) -> DataFrame:
    """A text whose second date lies before its first."""
    h = headers.withColumn("days", find_dates(F.col(column)))
    first, second = F.get("days", F.lit(0)), F.get("days", F.lit(1))
    return _issues(h, key, "date_range_order", "error", second < first, _day(first), _day(second), _lits(column))


@F.pandas_udf(T.DoubleType())
def _alike(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's ratio of two short words."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def same_person(a: Column, b: Column) -> Column:
    """Names whose first words are much alike, or one of which holds the other."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    word = lambda n: F.get(F.split(n, r"\s+"), F.lit(0))
    return F.contains(x, y) | F.contains(y, x) | (_alike(word(x), word(y)) >= 0.8)


def party_issues(parties: DataFrame, key: str) -> DataFrame:
    """Both parties with one name or one address (errors); what seems one person of one title signing for both (a warning).

    parties: first_ and second_ name and address, and if there are such columns signer and title.
    """
    same = lambda f: F.coalesce((F.lower(F.trim(f"first_{f}")) == F.lower(F.trim(f"second_{f}"))) & (F.trim(f"first_{f}") != ""), F.lit(False))
    none = F.lit(None)
    named = lambda *fs: _lits(*[f"{s}_{f}" for f in fs for s in ("first", "second")])
    out = None
    for f in ("name", "address"):
        found = _issues(parties, key, "parties_distinct", "error", same(f), none, none, named(f))
        out = found if out is None else out.unionByName(found)
    if "first_signer" in parties.columns:
        some = parties.filter(same("title") & (F.trim("first_signer") != "") & (F.trim("second_signer") != "")).withColumn("one", same_person(F.col("first_signer"), F.col("second_signer")))
        out = out.unionByName(_issues(some, key, "parties_distinct", "warning", F.col("one"), none, none, named("signer", "title")))
    return out


def contract_issues(headers: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """All rules of contracts. headers: number, title, first_name, second_name, first_address, second_address (and signers and titles), subtotal, vat, total, rate_text, words_text, term."""
    parts = [required_issues(headers, key, ["number", "title", "first_name", "second_name"]), total_issues(headers, key), line_issues(items, key), sum_issues(headers, items, key), words_issues(headers, key), date_range_issues(headers, key, "term"), party_issues(headers, key)]
    return reduce(DataFrame.unionByName, parts)


def offer_issues(headers: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """All rules of offers. headers: number, vendor, subtotal, vat, total, rate_text."""
    return reduce(DataFrame.unionByName, [required_issues(headers, key, ["number", "vendor"]), total_issues(headers, key), line_issues(items, key), sum_issues(headers, items, key)])


def handover_issues(headers: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """All rules of hand-overs. headers: first_ and second_ name and address, basis_number, title, basis_date, handover_date."""
    none = F.lit(None)
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    unlinked = _issues(headers, key, "references_source_document", "warning", blank("basis_number") & blank("title"), none, none, _lits("basis_number", "title"))
    empty = headers.join(items.select(key).distinct(), key, "left_anti")
    parts = [required_issues(headers, key, ["first_name", "second_name"]), party_issues(headers, key), date_order_issues(headers, key, "basis_date", "handover_date"), unlinked, _issues(empty, key, "has_items", "warning", F.lit(True), none, none, _lits("items"))]
    return reduce(DataFrame.unionByName, parts)


# The amounts that must be found in the document, by kind, and header words of priced tables.
AMOUNTS = {"contract": ("subtotal", "vat", "total"), "sph": ("subtotal", "vat", "total"), "bast": ("basis_value",)}
DETAIL_HEADER = r"(?i)harga|jumlah|qty|volume|\bvol\b|satuan|uraian|deskripsi|layanan|barang|item"


def ungrounded_amounts(evidence: DataFrame, key: str, kind: str) -> DataFrame:
    """Amounts that the document doesn't state must not pass, however well they add up. evidence: key, field, value, status."""
    none = F.lit(None)
    return _issues(evidence, key, "amounts_grounded", "warning", F.col("field").isin(*AMOUNTS[kind]) & (F.col("status") == "UNSUPPORTED"), none, parse_number(F.col("value").cast("string")), F.array("field"))


def duplicate_page_notes(kept: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """key, rule, severity and message for files whose pages after ``kept`` repeat earlier ones and weren't read. pages: key and the number of pages."""
    both = kept.join(pages, key).filter("pages > kept")
    span = F.concat((F.col("kept") + 1).cast("string"), F.lit("-"), F.col("pages").cast("string"))
    return both.select(key, F.lit("duplicate_copy").alias("rule"), F.lit("warning").alias("severity"), F.concat(F.lit("pages "), span, F.lit(" repeat earlier ones and were not read; please check that they are the same")).alias("message"))


def empty_table_notes(docs: DataFrame, key: str, text: str, separator: str = "<!-- PAGE BREAK -->") -> DataFrame:
    """key, rule, severity and message for tables of which only the header was read, one note a header with its pages."""
    paged = docs.select(key, F.posexplode(F.split(F.col(text), F.lit(separator), -1)).alias("page", "part"))
    tables = table_rows(paged.select(F.struct(key, "page").alias("at"), "part"), "at", "part")
    header = F.filter(F.get("rows", F.lit(0)), lambda c: c != "")
    body = F.slice("rows", 3, F.size("rows"))
    empty = is_separator(F.get("rows", F.lit(1))) & ~F.exists(body, lambda r: F.exists(r, lambda c: c != "")) & (F.size(F.filter(header, lambda c: c.rlike(DETAIL_HEADER))) >= 2)
    found = tables.filter(empty).select(F.col(f"at.{key}").alias(key), (F.col("at.page") + 1).alias("page"), F.array_join(header, " | ").alias("header"))
    noted = found.groupBy(key, "header").agg(F.array_join(F.transform(F.array_sort(F.collect_list("page")), lambda p: p.cast("string")), ", ").alias("pages"))
    return noted.select(key, F.lit("empty_table").alias("rule"), F.lit("warning").alias("severity"), F.concat(F.lit("table on page "), "pages", F.lit(": only its header was read ("), "header", F.lit("); please check it in the file")).alias("message"))


def hidden_text_notes(hidden: DataFrame, key: str, most: int = 160) -> DataFrame:
    """key, rule, severity and message for files with text that pages don't show. hidden: key, page, ordinal, text, removed (whether it wasn't read)."""
    listed = hidden.groupBy(key).agg(F.array_sort(F.collect_set("page")).alias("pages"), F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("page", "ordinal", "text"))), lambda x: x["text"])).alias("texts"), F.bool_and("removed").alias("removed"))
    sample = F.array_join("texts", "; ")
    short = F.when(F.length(sample) > most, F.concat(F.substring(sample, 1, most - 3), F.lit("..."))).otherwise(sample)
    after = F.when(F.col("removed"), "; it was not read").otherwise("; it overlaps visible text and was read")
    return listed.select(key, F.lit("hidden_text").alias("rule"), F.lit("warning").alias("severity"), F.concat(F.lit("hidden text on page "), F.array_join(F.transform("pages", lambda p: p.cast("string")), ", "), F.lit(': "'), short, F.lit('"'), after).alias("message"))


def signer_notes(signers: DataFrame, key: str) -> DataFrame:
    """key, rule, severity, fields and message for every signer that was filled, replaced or left uncertain."""
    said = (
        F.when(F.col("change") == "uncertain", F.concat(F.lit("both companies' names were read as one block, so it is unclear for whom '"), "former", F.lit("' signs")))
        .when(F.col("change") == "replaced", F.concat(F.lit("'"), "former", F.lit("' stands in the other party's column; '"), "name", F.lit("' stands in this one's")))
        .otherwise(F.concat(F.lit("'"), "name", F.lit("' was filled in from the signature column")))
    )
    fields = F.array(F.concat("side", F.lit("_signer")), F.concat("side", F.lit("_title")))
    return signers.filter("change is not null").select(key, F.lit("signers_by_column").alias("rule"), F.lit("warning").alias("severity"), fields.alias("fields"), said.alias("message"))


def report(documents: DataFrame, issues: DataFrame, key: str) -> DataFrame:
    """fail with any error, warn with any issue, else pass, for every document."""
    counts = issues.groupBy(key).agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count("*").alias("issues"))
    joined = documents.select(key).join(counts, key, "left").fillna(0, ["errors", "issues"])
    return joined.withColumn("status", F.when(F.col("errors") > 0, "fail").when(F.col("issues") > 0, "warn").otherwise("pass"))
