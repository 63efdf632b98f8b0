"""Document types by weighted keywords."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and weights by type, and the layers' sizes and factors.
RULES = {
    "contract": (
        (r"\bSURAT\s+PERINTAH\s+(?:MULAI\s+)?KERJA\b", 3.0), (r"\bSPM?K\b", 2.0), (r"\bPERJANJIAN\s+KERJA\s*SAMA\b", 3.0), (r"\bPERJANJIAN\b", 2.0), (r"\bPKS\b", 2.0),
        (r"\bKONTRAK\s+LAYANAN\b", 2.5), (r"\bKONTRAK\s+PENGADAAN\b", 2.5), (r"\bKONTRAK\b", 0.75), (r"\bNOTA\s+PESANAN\b", 3.0), (r"\bSURAT\s+PESANAN\b", 3.0),
        (r"\bPURCHASE\s+ORDER\b", 1.5), (r"\bBERITA\s+ACARA\s+KLARIFIKASI\b", 3.0), (r"\bBERITA\s+ACARA\s+NEGO(?:SIASI)?\b", 3.0), (r"\bKLARIFIKASI\s+DAN\s+NEGOSIASI\b", 3.0), (r"\bHASIL\s+NEGOSIASI\b", 1.5),
    ),
    "sph": ((r"\bSURAT\s+PENAWARAN\s+HARGA\b", 3.0), (r"\bSPH\b", 2.0), (r"\bPENAWARAN\s+HARGA\b", 2.5), (r"\bPRICE\s+QUOTATION\b", 3.0), (r"\bQUOTATION\b", 2.0), (r"\bPENAWARAN\s+BIAYA\b", 2.5)),
    "bast": (
        (r"\bBERITA\s+ACARA\s+SERAH\s+TERIMA\b", 3.5), (r"\bBAST\b", 2.5), (r"\bSERAH\s+TERIMA\s+PEKERJAAN\b", 2.5),
        (r"\bBERITA\s+ACARA\s+PENYELESAIAN\b", 2.5), (r"\bBERITA\s+ACARA\s+PENERIMAAN\s+PEKERJAAN\b", 3.0), (r"\bBERITA\s+ACARA\s+UJI\s+TERIMA\b", 2.0),
    ),
}
TITLE_CHARS, WINDOW_CHARS, TITLE_FACTOR, REST_FACTOR, LEAST, LEAD = 600, 3000, 1.5, 0.5, 2.0, 1.5


def score(text: Column, doc_type: str, rules: dict = RULES) -> Column:
    """Each pattern counts once, by the best layer it occurs in: title, first window, rest."""
    upper = F.upper(F.coalesce(text, F.lit("")))
    title, window = F.substring(upper, 1, TITLE_CHARS), F.substring(upper, 1, WINDOW_CHARS)
    rest = F.substr(upper, F.lit(WINDOW_CHARS + 1))
    total = F.lit(0.0)
    for pattern, weight in rules[doc_type]:
        total = total + F.when(title.rlike(pattern), weight * TITLE_FACTOR).when(window.rlike(pattern), weight).when(rest.rlike(pattern), weight * REST_FACTOR).otherwise(0.0)
    return total


def classify(text: Column, rules: dict = RULES) -> Column:
    """A struct (doc_type, confidence): the best score from 2 on, surer with a lead of half; else the first type at 0.7."""
    ranked = F.sort_array(F.array(*[F.struct(score(text, k, rules).alias("s"), (-F.lit(i)).alias("order"), F.lit(k).alias("k")) for i, k in enumerate(rules)]), asc=False)
    best, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    clear = best["s"] >= second["s"] * LEAD
    return F.struct(
        F.when(best["s"] >= LEAST, best["k"]).otherwise(next(iter(rules))).alias("doc_type"),
        F.when((best["s"] >= LEAST) & clear, 0.98).when(best["s"] >= LEAST, 0.80).otherwise(0.70).alias("confidence"),
    )
