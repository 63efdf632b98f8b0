"""Scalar functions against small vectors and against plain Python."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from lontar.functions import dates, identifiers, numbers, text


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").orderBy("i").select(column(F.col("x"))).collect()]


@pytest.mark.parametrize(
    ("raw", "value"),
    [("Rp. 166.500.000,-", 166500000.0), ("1,5", 1.5), ("12.500", 12500.0), ("1,234,567.89", 1234567.89), ("3.200.000.00", 3200000.0), ("7.350 000,00", 7350000.0), ("abc", None), ("", None), (None, None), ("5.000.00050.000.000", None), ("-1.000", -1000.0)],
)
def test_parse_number(spark, raw, value):
    assert one(spark, numbers.parse_number, raw) == [value]


def test_spelled_amounts(spark):
    words = ["Seratus Enam Puluh Enam Juta Lima Ratus Ribu Rupiah", "nol", "seribu sebelas", "dua koma lima", "kata lain", None]
    assert one(spark, numbers.spelled_amount, *words) == [166500000, 0, 1011, 2, None, None]


def test_spell_is_the_inverse(spark):
    values = [0, 1, 10, 11, 12, 19, 20, 21, 100, 101, 111, 999, 1000, 1001, 2000, 11000, 100000, 1000000, 1001001, 987654321012345]
    got = spark.createDataFrame([(v,) for v in values], "x long").select("x", numbers.spelled_amount(numbers.spell(F.col("x"))).alias("y")).collect()
    assert all(r.x == r.y for r in got)


def test_money_and_quantities(spark):
    assert one(spark, numbers.normalize_money, "Rp 166.500.000,- NPWP 01.234.567.8-901.000") == ["Rp 166500000 NPWP 01.234.567.8-901.000"]
    assert one(spark, numbers.clean_quantity, "12", "1 2", "1. id:)", "") == [12.0, None, None, None]
    assert one(spark, numbers.confirmed_amounts, "Rp 2.000,- (dua ribu rupiah) lalu Rp 3.000 (dua ribu rupiah)") == [[2000.0]]


def test_dates(spark):
    d = datetime.date
    got = one(spark, dates.find_dates, "2 Juni 2026 lalu 2026-06-03, 04/06/2026 dan 31 Februari 2026", "tidak ada", None)
    assert got == [[d(2026, 6, 2), d(2026, 6, 3), d(2026, 6, 4)], [], []]
    assert one(spark, dates.date_range_in_order, "2026-06-03 s/d 2026-06-01", "2026-06-01") == [False, True]


def test_identifiers(spark):
    assert one(spark, identifiers.normalize_document_number, "K. TEL.05/HK .810/T1R- 0D/2026", "Nomor 45 tahun 2026", "kalimat panjang yang bukan nomor dokumen sama sekali 1") == [
        "K.TEL.05/HK.810/T1R-0D/2026",
        "Nomor 45 tahun 2026",
        "kalimat panjang yang bukan nomor dokumen sama sekali 1",
    ]
    assert one(spark, identifiers.clean_title, "Surat Perintah Kerja untuk Pengadaan Server", "Perihal: ") == ["Pengadaan Server", None]


def test_text(spark):
    assert one(spark, text.canon, "JI. Merdeka,  No. 1/2", None) == ["jl merdeka no 1/2", ""]
    assert one(spark, text.longest_short_run, "a b c d panjang e f", "kata kata", "") == [4, 0, 0]
    assert one(spark, text.is_empty, "N/A", " - ", "nilai", None) == [True, True, False, True]
