"""Field-level evaluation of extracted values against ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lontar.functions.dates import parse_date
from lontar.functions.numbers import parse_number, spelled_amount
from lontar.functions.text import canon, token_f1, words

ACCEPTED = ("AUTO_VERIFIED", "AUTO_ACCEPTED")


def _blank(text: Column) -> Column:
    return text.isNull() | (F.trim(text) == "")


def verdict(expected: Column, predicted: Column, number: Column | None = None) -> Column:
    """A struct (verdict, method) for an expected text (or number) and a predicted text."""
    number = F.lit(None).cast("double") if number is None else number
    dated = F.trim(expected).rlike(r"^(?:\d{4}-\d{2}-\d{2}|\d{1,2} \w+ \d{4})$") & parse_date(expected).isNotNull()
    spelled = expected.rlike(r"(?i)\b(?:ribu|juta|miliar|milyar|rupiah)\b")
    a, b = canon(expected), canon(predicted)
    near = (token_f1(expected, predicted) >= 0.85) | (b.contains(a) & (F.size(words(b)) - F.size(words(a)) <= 4))
    answer = lambda v, m: F.struct(F.lit(v).alias("verdict"), F.lit(m).alias("method"))
    right = lambda ok, m: F.when(F.coalesce(ok, F.lit(False)), answer("exact", m)).otherwise(answer("wrong", m))
    return (
        F.when(number.isNull() & _blank(expected), F.when(_blank(predicted), answer("correct_null", "null")).otherwise(answer("spurious", "null")))
        .when(_blank(predicted), answer("missing", "-"))
        .when(number.isNotNull(), right(F.abs(parse_number(predicted) - number) <= 1, "number"))
        .when(dated, right(parse_date(predicted) == parse_date(expected), "date"))
        .when(spelled, right(spelled_amount(expected) == spelled_amount(predicted), "terbilang"))
        .when(a == b, answer("exact", "canon"))
        .when(near, answer("lenient", "token_f1"))
        .otherwise(answer("wrong", "token_f1"))
    )


def evaluate(golden: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """golden (keys, expected, critical) with predictions (keys, predicted, status): verdict, method and false acceptance of every field."""
    joined = golden.join(predicted, keys, "left").withColumn("v", verdict(F.col("expected"), F.col("predicted")))
    false = F.col("v.verdict").isin("wrong", "spurious") & F.coalesce(F.col("status").isin(*ACCEPTED), F.lit(False))
    return joined.select(*keys, "expected", "predicted", "critical", F.col("v.verdict").alias("verdict"), F.col("v.method").alias("method"), false.alias("false_acceptance"))


def accuracy(results: DataFrame, key: str) -> DataFrame:
    """Per document: fields, share right (exact, lenient or correctly null), share of critical ones, false acceptances."""
    right = F.col("verdict").isin("exact", "lenient", "correct_null").cast("double")
    return results.groupBy(key).agg(
        F.count("*").alias("fields"), F.avg(right).alias("accuracy"), F.avg(F.when(F.col("critical"), right)).alias("critical_accuracy"), F.count_if("false_acceptance").alias("false_acceptances")
    )


def summarize(per_document: DataFrame) -> DataFrame:
    return per_document.agg(F.count("*").alias("documents"), F.avg("accuracy").alias("accuracy"), F.avg("critical_accuracy").alias("critical_accuracy"), F.sum("false_acceptances").alias("false_acceptances"))


def compare_runs(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Fields that are in both runs, with what changed: regression, improvement, new_false_acceptance or same."""
    good = lambda c: F.col(c).isin("exact", "lenient", "correct_null")
    o = old.select(*keys, F.col("verdict").alias("old_verdict"), F.col("false_acceptance").alias("old_false"))
    n = new.select(*keys, F.col("verdict").alias("new_verdict"), F.col("false_acceptance").alias("new_false"))
    change = (
        F.when(F.col("new_false") & ~F.col("old_false"), "new_false_acceptance").when(good("old_verdict") & ~good("new_verdict"), "regression").when(~good("old_verdict") & good("new_verdict"), "improvement").otherwise("same")
    )
    return o.join(n, keys).withColumn("change", change).select(*keys, "old_verdict", "new_verdict", "change")


def only_in_one(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Documents that only one of two runs has."""
    a, b = old.select(key).distinct(), new.select(key).distinct()
    return a.subtract(b).withColumn("side", F.lit("old")).unionByName(b.subtract(a).withColumn("side", F.lit("new")))


# Parts of the names of fields whose wording is a matter of convention, and the critical fields by document kind.
CONVENTIONS = ("Jangka Waktu", "Catatan Khusus", "Lokasi", "Persentase Sanksi", "Mekanisme", "Syarat", "Garansi", "Masa Berlaku", "Jabatan", "Keterangan", "Spesifikasi", "Tujuan Surat")
CRITICAL = {
    "contract": ("Nomor Kontrak Kerja", "Nama Pekerjaan", "Pihak Pertama.Nama Perusahaan", "Pihak Kedua.Nama Perusahaan", "sub total", "Total PPN", "Total Harga Pekerjaan"),
    "sph": ("Nomor SPH", "Tanggal SPH", "Vendor.Nama Vendor", "Subtotal", "Nilai PPN", "Grand Total"),
}
LEAST_KNOWN = 0.5


def field_kind(field: Column) -> Column:
    """Whether a field's wording is a convention or lies in the document itself."""
    found = F.lit(False)
    for part in CONVENTIONS:
        found = found | field.contains(part)
    return F.when(found, "convention").otherwise("intrinsic")


def compare_systems(golden: DataFrame, systems: dict[str, DataFrame], key: str) -> tuple[DataFrame, DataFrame]:
    """(system, kind, right, fields) over all fair documents, and the documents left out with the reason.

    golden: key, field, expected, critical, uncorrected (a skeleton or made from a system's own output); a system's table:
    key, field, predicted, status. A document counts if every system has it and knows at least half of its fields.
    """
    fields = golden.groupBy(key).agg(F.count("*").alias("n"), F.max("uncorrected").alias("uncorrected"))
    state = fields
    for name, rows in systems.items():
        known = rows.join(golden.select(key, "field"), [key, "field"], "left_semi").groupBy(key).agg(F.count("*").alias(f"known_{name}"))
        state = state.join(rows.select(key).distinct().withColumn(f"has_{name}", F.lit(True)), key, "left").join(known, key, "left")
    missing, foreign = F.lit(False), F.lit(False)
    for name in systems:
        missing = missing | F.col(f"has_{name}").isNull()
        foreign = foreign | (F.coalesce(F.col(f"known_{name}"), F.lit(0)) / F.col("n") < LEAST_KNOWN)
    reason = F.when(F.col("uncorrected"), "golden is no fair judge").when(missing, "incomplete output").when(foreign, "other schema")
    judged = state.select(key, reason.alias("reason"))
    fair = golden.join(judged.filter("reason is null"), key, "left_semi")
    out = None
    for name, rows in systems.items():
        results = evaluate(fair.select(key, "field", "expected", "critical"), rows, [key, "field"])
        good = F.col("verdict").isin("exact", "lenient", "correct_null")
        sums = results.groupBy(field_kind(F.col("field")).alias("kind")).agg(F.count_if(good).alias("right"), F.count("*").alias("fields")).select(F.lit(name).alias("system"), "kind", "right", "fields")
        out = sums if out is None else out.unionByName(sums)
    return out, judged.filter("reason is not null")
