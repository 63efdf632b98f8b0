"""Contract wording: payment terms, periods, sections, parties and handover, nested lists, hand-over drafts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lontar.functions.numbers import parse_number

# How sections of a contract start.
SECTIONS = {
    "scope": r"LINGKUP\s+PEKERJAAN", "price": r"(?:NILAI\s+KONTRAK|HARGA)", "duration": r"(?:WAKTU\s+PELAKSANAAN|JANGKA\s+WAKTU)", "payment": r"(?:CARA|SYARAT|TATA\s+CARA)\s+PEMBAYARAN",
    "guarantee": "GARANSI", "penalty": "(?:SANKSI|DENDA)", "handover": r"(?:SERAH\s+TERIMA|BERITA\s+ACARA)", "closing": r"LAIN[- ]?LAIN",
}


def section_of(line: Column) -> Column:
    """The section that a line opens; null for other lines."""
    out = None
    for name, words in SECTIONS.items():
        opens = line.rlike(rf"(?i)^\s*(?:pasal\s+)?\d+\.?\s*{words}")
        out = F.when(opens, name) if out is None else out.when(opens, name)
    return (
        out.when(line.rlike(r"(?i)^\s*Lampiran\s*:"), "attachment")
        .when(line.rlike(r"(?i)^\s*[#*\s]*SURAT\s+(?:PERINTAH\s+KERJA|PENAWARAN)"), "preamble")
        .when(line.rlike(r"(?i)^\s*Demikian\s+Surat"), "closing")
    )


def section_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, section, first and last line of every section of a text."""
    from pyspark.sql import Window

    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line", "raw")).withColumn("opens", section_of(F.col("raw")))
    number = F.count("opens").over(Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    marked = lines.withColumn("n", number).filter("n > 0")
    return marked.groupBy(key, "n").agg(F.first("opens", ignorenulls=True).alias("section"), F.min("line").alias("first_line"), F.max("line").alias("last_line")).drop("n")


# How instalments are named, and words that speak of several.
TERM = r"(?i)\btermin\s+(?:ke[-\s]*)?(?:[IVX]+|\d+|pertama|kedua|ketiga|keempat|kelima|terakhir)\b|\buang\s+muka\b|\bdown\s+payment\b|\bpelunasan\b|\bretensi\b"
SEVERAL = r"(?i)masing[-\s]*masing|\bsetiap\b|\btiap\b|per\s*bulan"


def payment_term(text: Column) -> Column:
    """A struct (label, amount, percentage): a term and its amount only where the sentence speaks of one; nothing is computed."""
    terms = F.regexp_extract_all(text, F.lit(TERM), F.lit(0))
    numbered = F.array_distinct(F.filter(F.transform(terms, lambda t: F.lower(t)), lambda t: t.startswith("termin")))
    one = (F.size(terms) > 0) & (F.size(numbered) <= 1) & ~text.rlike(SEVERAL)
    amounts = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"(?i)Rp\.*\s*(\d[\d.,]*\d)"), F.lit(1)), lambda a: parse_number(a)), lambda a: a.isNotNull()))
    shares = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\b\d{1,3}(?:[.,]\d+)?\s*%"), F.lit(0)), lambda p: F.replace(p, F.lit(" "), F.lit(""))))
    return F.struct(F.when(one, F.get(terms, 0)).alias("label"), F.when(one & (F.size(amounts) == 1), F.get(amounts, 0)).alias("amount"), F.when(F.size(shares) == 1, F.get(shares, 0)).alias("percentage"))


def period(text: Column) -> Column:
    """The first two dates of a text as they are written; null with fewer."""
    found = F.regexp_extract_all(text, F.lit(r"\b\d{1,2}[-/ ]\d{1,2}[-/ ]\d{4}\b|\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}\s+[A-Za-z]+\s+\d{4}\b"), F.lit(0))
    return F.when(F.size(found) >= 2, F.struct(F.get(found, 0).alias("starts"), F.get(found, 1).alias("ends")))


def handing_over(text: Column, most_chars: int = 6000) -> Column:
    """Which party hands over, by the sentence that says so in the first ``most_chars`` characters (where hand-over documents say it): first, second or null."""
    flat = F.regexp_replace(F.substring(text, 1, most_chars), r"\s+", " ")
    said = F.lower(F.regexp_extract(flat, r"(?i)pihak\s+(pertama|kedua)\s+menyerahkan\s+kepada", 1))
    headed = F.when(flat.rlike(r"(?i)##\s*MENYERAHKAN"), F.lower(F.regexp_extract(flat, r"(?i)selanjutnya\s+pihak\s+(pertama|kedua)", 1)))
    side = F.coalesce(F.nullif(said, F.lit("")), F.nullif(headed, F.lit("")))
    return F.when(side == "pertama", "first").when(side == "kedua", "second")


def direction(first: Column, second: Column, text: Column, ours: str) -> Column:
    """customer if our company hands over, vendor if it takes over, else unknown: by role, not by which party it is."""
    side = handing_over(text)
    mine = F.when(F.coalesce(first.rlike(ours), F.lit(False)), "first").when(F.coalesce(second.rlike(ours), F.lit(False)), "second")
    return F.coalesce(F.when(mine == side, "customer").when(mine != side, "vendor"), F.lit("unknown"))


def handover_drafts(contracts: DataFrame, items: DataFrame, verified: DataFrame, required: list[str], key: str) -> DataFrame:
    """key, ready, problems and items of a hand-over draft: only from confirmed values, else the list of what is missing.

    contracts has the required columns; verified (key, path) the confirmed ones; items (key, line_no, delivered).
    """
    have = verified.groupBy(key).agg(F.collect_set("path").alias("have"))
    lines = items.groupBy(key).agg(F.count_if(F.col("delivered") > 0).cast("long").alias("items"))
    missing = F.array_sort(F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(f"{c}: empty")).when(~F.coalesce(F.array_contains("have", c), F.lit(False)), F.lit(f"{c}: not confirmed")) for c in required]), lambda p: p.isNotNull()))
    joined = contracts.join(have, key, "left").join(lines, key, "left").withColumn("items", F.coalesce("items", F.lit(0).cast("long")))
    problems = F.concat(missing, F.when(F.col("items") == 0, F.array(F.lit("no delivered item"))).otherwise(F.array().cast("array<string>")))
    return joined.select(key, (F.size(problems) == 0).alias("ready"), problems.alias("problems"), "items")
