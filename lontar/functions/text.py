"""Text normalisation and similarity, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lontar.functions import let

_WORD_CHARS = r"[^\p{L}\p{N}_/%]+"


def canon(text: Column) -> Column:
    """The canonical form for matching: lower case, "ji." read as "jl.", punctuation to single spaces."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\bji\.", "jl.")
    return F.trim(F.regexp_replace(t, _WORD_CHARS, " "))


def squeeze(text: Column) -> Column:
    """Lower case with every run of white space as one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def words(text: Column) -> Column:
    """A text's words by single spaces; none for an empty text."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def words_f1(a: Column, b: Column) -> Column:
    """F1 of two arrays of words as sets; 0 if either is empty."""
    common, size_a, size_b = (F.size(x).cast("double") for x in (F.array_intersect(a, b), F.array_distinct(a), F.array_distinct(b)))
    precision, recall = common / F.nullif(size_b, F.lit(0.0)), common / F.nullif(size_a, F.lit(0.0))
    return F.coalesce(2 * precision * recall / F.nullif(precision + recall, F.lit(0.0)), F.lit(0.0))


def token_f1(a: Column, b: Column) -> Column:
    """F1 of the canonical forms' word sets; 0 if either is empty."""
    return let(F.struct(words(canon(a)).alias("a"), words(canon(b)).alias("b")), lambda p: words_f1(p["a"], p["b"]))


def long_words(text: Column) -> Column:
    """Distinct lower-case ASCII words of at least three letters or digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]{3,}"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common members of two arrays as sets; 0 if both are empty."""
    return F.coalesce(F.size(F.array_intersect(a, b)).cast("double") / F.nullif(F.size(F.array_union(a, b)).cast("double"), F.lit(0.0)), F.lit(0.0))


def strip_invisible(text: Column) -> Column:
    """Without zero-width marks, soft hyphens and control characters other than tab and line breaks."""
    return F.regexp_replace(text, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F\\u00AD\\u200B-\\u200D\\u2060\\uFEFF]", "")


# Words that readers misread, as they stand between other signs than letters and digits.
MISREAD = {
    "Nom0r": "Nomor", "nom0r": "nomor", "N0mor": "Nomor", "n0mor": "nomor", "0racle": "Oracle", "0racie": "Oracle", "Oracie": "Oracle", "oracie": "oracle", "TELK0M": "TELKOM", "Telk0m": "Telkom", "TELkoM": "TELKOM",
    "TELKOMREGIONALI": "TELKOM REGIONAL I", "TELKOMREGIONAL": "TELKOM REGIONAL", "REGIONALI": "REGIONAL I", "PlHAK": "PIHAK", "PiHAK": "PIHAK", "Plhak": "Pihak", "UNIvERsITAs": "UNIVERSITAS", "TELkOM": "TELKOM",
    "BHAKTi": "BHAKTI", "TEKNOvASI": "TEKNOVASI", "Isiam": "Islam", "isiam": "islam", "BuT": "BUT", "ATs": "ATS", "&OPERATION": "& OPERATION", "&operation": "& operation", "Yangdalam": "Yang dalam",
    "sebaik-baiknya.Berdasarkan": "sebaik-baiknya. Berdasarkan", "danSustainability": "dan Sustainability", "perbuatanhukum": "perbuatan hukum", "yangberwenang": "yang berwenang", "LampiranII": "Lampiran II", "LampiranI": "Lampiran I",
}
# Small letters that look like their capitals.
LOOK_ALIKE = "cksovwxz"
# Blanks that a reader lost, as pattern and replacement; later rules build on earlier ones.
LOST_BLANKS = (
    (r"(\d)([A-Z][a-z])", "$1 $2"),
    (r"(?i)\b(Nomor|Tahun|tanggal|Pasal|No\.|Lampiran)(\d+)", "$1 $2"),
    (r"(?m)^(\d+)([A-Z]{2,})", "$1. $2"),
    (r"\bNo\.(\d+)", "No. $1"),
    (r"(\d{3}\.\d{3})([a-zA-Z])", "$1 $2"),
    (r"(?<![A-Za-z])([A-Z]?[a-z]{5,})([A-Z][a-z]{2,})", "$1 $2"),
    (r"([a-z])(Rp[.\s])", "$1 $2"),
    (r"(Rp\.?)(\d)", "$1 $2"),
    (r"\.([A-Z])", ". $1"),
    (r"(?<!\d),(?=[^\s,])", ", "),
    (r"(\d),([A-Za-z])", "$1, $2"),
    (r"\bJI\.(?=\s*[A-Z0-9])", "Jl."),
    (r":([A-Za-z\d])", ": $1"),
    (r"\)([A-Za-z])", ") $1"),
    (r"([a-zA-Z])\(", "$1 ("),
    (r'disebut\s*"?([A-Z]{2,})"?', 'disebut "$1"'),
    (r'"Para Pihak dan', '"Para Pihak" dan'),
)
# Capitals written together, in any case.
GLUED = {
    r"\bTELEKOMUNIKASIINDONESIA\b": "TELEKOMUNIKASI INDONESIA", r"\bPENYEDIAANFIREWALL\b": "PENYEDIAAN FIREWALL", r"\bCPEUNTUK\b": "CPE UNTUK", r"\bPIHAKPERTAMA\b": "PIHAK PERTAMA", r"\bPIHAKKEDUA\b": "PIHAK KEDUA",
    r"\bPIHAKKESATU\b": "PIHAK KESATU", r"\bPERTAMAmemberi\b": "PERTAMA memberi", r"\bKONTRAKLAYANAN\b": "KONTRAK LAYANAN", r"\bLINGKUPPEKERJAAN\b": "LINGKUP PEKERJAAN", r"\bSYARAT-SYARATPELAKSANAAN\b": "SYARAT-SYARAT PELAKSANAAN",
    r"\bUNIVERSITASISLAMNEGERI\b": "UNIVERSITAS ISLAM NEGERI", r"\bSURATPERINTAHKERJA\b": "SURAT PERINTAH KERJA", r"\bBERITAACARA\b": "BERITA ACARA", r"\bIslamNegeri\b": "Islam Negeri", r"\bPutihKec\.\b": "Putih Kec.",
    r"\bAgamSumatera\b": "Agam Sumatera", r"\bKotaBandung\b": "Kota Bandung", r"\bJawaBarat\b": "Jawa Barat", r"\bCoblongKota\b": "Coblong Kota", r"\bSiliwangi-Coblong\b": "Siliwangi - Coblong",
}
# Phrases that are written in capitals, lines that stamps and signatures leave, and footers.
CAPITALS = (r"universitas\s+telkom", r"pt\.\s*bhakti\s+unggul\s+teknovasi", r"pihak\s+pertama", r"pihak\s+kedua", r"pihak\s+kesatu", r"surat\s+perintah\s+kerja", r"berita\s+acara\s+serah\s+terima")
STAMPS = ("mmeto", "fer", "ttd", "materai", "ttd.", "cap", "stempel", "xmohamad", "xindah", "x", "xx", "xxx", "v", "vv")
FOOTERS = (r"Main\s+Campus\s+Bangkit\s+Building.*?(?:www\.\S+|\.ac\.id)", r"^www\.\S+\.\S+$", r"^[t\s:]*[+]?\d[\d\s\-/()]{15,}$")


def _replaced(text: Column, rules) -> Column:
    """All rules one after the other; a text that none fits at first is left alone where no rule makes work for another."""
    for pattern, put in rules:
        text = F.regexp_replace(text, pattern, put)
    return text


def _where(text: Column, marks: list[tuple[str, str, str]], held: Column | None = None) -> Column:
    """Each (literal, pattern, replacement) in turn where the text (or what is held for it) contains the literal, which is cheaper to see than the pattern."""
    rules = F.array(*[F.struct(F.lit(a).alias("l"), F.lit(b).alias("p"), F.lit(c).alias("r")) for a, b, c in marks])
    return F.aggregate(rules, text, lambda t, r: F.when(F.contains(t if held is None else held, r["l"]), F.regexp_replace(t, r["p"], r["r"])).otherwise(t))


def fix_misread(text: Column) -> Column:
    """Whole words by a table, then look-alike small letters inside capitals (KERJAsAMA)."""
    escaped = lambda w: re.sub(r"([^A-Za-z0-9])", r"\\\1", w)
    text = _where(text, [(w, (r"(?<![A-Za-z0-9])" if w[0].isalnum() else "") + escaped(w) + r"(?![A-Za-z0-9])", right) for w, right in MISREAD.items()])
    small = [(rf"(?<=\b[A-Z]{{2,60}}){c}(?=[A-Z]{{2,}}\b)", c.upper()) for c in LOOK_ALIKE]
    return let(text, lambda t: F.when(t.rlike(rf"\b[A-Z]{{2,}}[{LOOK_ALIKE}][A-Z]{{2,}}\b"), _replaced(t, small)).otherwise(t))


def fix_missing_spaces(text: Column) -> Column:
    """Blanks that a reader lost between digits, words, amounts, marks and brackets, and quotes around a defined name."""
    return _replaced(text, LOST_BLANKS)


def fix_phrases(text: Column) -> Column:
    """Glued capitals apart."""
    plain = lambda p: re.sub(r"\\b|\\", "", p).lower()
    return let(F.struct(text.alias("t"), F.lower(text).alias("low")), lambda x: _where(x["t"], [(plain(p), f"(?i){p}", put) for p, put in GLUED.items()], x["low"]))


def fix_capitals(text: Column) -> Column:
    """Set phrases in capitals, their blanks as they are."""

    rules = F.array(*[F.struct(F.lit(re.split(r"\\", p)[0]).alias("l"), F.lit(f"(?i){p}").alias("p")) for p in CAPITALS])

    def upper(t: Column, pattern: Column) -> Column:
        found = F.concat(F.transform(F.regexp_extract_all(t, pattern, F.lit(0)), lambda x: F.upper(x)), F.array(F.lit("")))
        return F.array_join(F.zip_with(F.split(t, pattern, -1), found, lambda a, b: F.concat(a, b)), "")

    return let(F.struct(text.alias("t"), F.lower(text).alias("low")), lambda x: F.aggregate(rules, x["t"], lambda t, r: F.when(F.contains(x["low"], r["l"]), upper(t, r["p"])).otherwise(t)))


_ENDS = r"(?U)^\s+|\s+$"


def clean_signature(text: Column) -> Column:
    """Without the lines that stamps and signatures leave (words of a list, up to four signs without vowel or digit); a name's glued leading X is cut off."""

    def noise(line: Column) -> Column:
        plain = F.regexp_replace(line, _ENDS, "")
        return F.lower(plain).isin(*STAMPS) | ((F.length(plain) <= 4) & (plain != "") & plain.rlike(r"^(?:[A-Za-z]|[^\p{L}\p{N}])*$") & ~F.lower(plain).rlike("[aeiou]"))

    kept = F.filter(F.split(text, "\n", -1), lambda x: ~noise(x))
    return F.regexp_replace(F.array_join(kept, "\n"), r"\b[xX]([A-Z][a-z]+(?:[^\S\n]+[A-Z][a-z]+)+)\b", "$1")


def clean_footer(text: Column) -> Column:
    """Without running addresses, and lines that are a web address or a long telephone number alone."""
    return _replaced(text, [(f"(?dmsi){p}", "") for p in FOOTERS])


def fix_number_dash(text: Column) -> Column:
    """Grouped amounts without a trailing dash, as in 1.500.000-."""
    return F.regexp_replace(text, "(\\d{1,3}(?:\\.\\d{3})+)\\s*[-\u2013\u2014](?!\\d)", "$1")


def normalize_spaces(text: Column) -> Column:
    """Single blanks inside lines, none at their ends, and one blank line at most; list items keep their indent."""

    def line(x: Column) -> Column:
        plain = F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), _ENDS, "")
        return F.concat(F.regexp_extract(x, r"^( +)(?:[-*] |\d{1,3}[.)] )", 1), plain)

    t = F.array_join(F.transform(F.split(text, "\n", -1), line), "\n")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), _ENDS, "")


STEPS = (strip_invisible, fix_misread, fix_missing_spaces, fix_phrases, fix_capitals, clean_signature, clean_footer, fix_number_dash, normalize_spaces)


def clean_ocr(text: Column) -> Column:
    """The cleaning steps in their fixed order, each worked out once for a row; the last lines Markdown tables up again."""
    from lontar.operators.tables import realigned

    for step in (*STEPS, realigned):
        text = let(text, step)
    return text


def clean_ocr_line(text: Column) -> Column:
    """The steps for a single line, with single blanks."""
    for step in STEPS[:4]:
        text = let(text, step)
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), _ENDS, "")


def longest_short_run(text: Column) -> Column:
    """The longest run of words of one or two letters, passing over tokens with a dot or digit."""
    plain = F.filter(F.split(F.lower(text), r"\s+"), lambda w: (w != "") & ~w.rlike(r"[.\d]"))
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(a: Column, w: Column) -> Column:
        run = F.when(w.rlike(r"^[a-z]{1,2}$"), a["run"] + 1).otherwise(0)
        return F.struct(run.alias("run"), F.greatest(a["best"], run).alias("best"))

    return F.aggregate(plain, start, step, lambda a: a["best"])


def is_corrupted(text: Column, run: int = 5) -> Column:
    """Text that a reader broke into letters."""
    return longest_short_run(text) >= run


# What stands for no value.
EMPTY_WORDS = ("", "null", "none", "n/a", "-")


def is_empty(text: Column) -> Column:
    return text.isNull() | F.lower(F.trim(text)).isin(*EMPTY_WORDS)


def text_or_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))
