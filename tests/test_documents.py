"""Cleaning, drawing, grouping, evidence, signatures, entities and records on small vectors."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lontar.functions import dates, identifiers, numbers, predicates, text
from lontar.operators import blocks, contracts, entities, evidence, layout, reconcile, signatures, tables, validation
from lontar.sources import readers, schemas


def each(spark, column, *values):
    return [r[0] for r in spark.createDataFrame(list(enumerate(values)), "i int, x string").orderBy("i").select(column(F.col("x"))).collect()]


# Cleaning


def test_misread_words(spark):
    vectors = {
        "Nom0r 0racle, Oracie": "Nomor Oracle, Oracle", "PERJANJIAN KERJAsAMA": "PERJANJIAN KERJASAMA", "JAMINAN KEwAJIBAN": "JAMINAN KEWAJIBAN", "model LLaMA dan PPh": "model LLaMA dan PPh", "REGIONALISASI": "REGIONALISASI",
        "TELKOM REGIONALI": "TELKOM REGIONAL I", "LampiranII": "Lampiran II", "_SM REGIONALI_": "_SM REGIONAL I_", "sebesar Rp. 1.500": "sebesar Rp. 1.500", "A&OPERATION": "A& OPERATION", "Standart Acess diatas": "Standart Acess diatas",
    }
    assert each(spark, text.fix_misread, *vectors) == list(vectors.values())


def test_lost_blanks(spark):
    vectors = {
        "29Mei 11Kedaung": "29 Mei 11 Kedaung", "Nomor2 pasal3 No.12": "Nomor 2 pasal 3 No. 12", "1TELKOM": "1. TELKOM", "456.000sebuah": "456.000 sebuah", "InformasiUniversitas FortiGate PowerPoint": "Informasi Universitas FortiGate PowerPoint", "sebesarRp.174": "sebesar Rp. 174",
        "terlampir.Berdasarkan": "terlampir. Berdasarkan", "Bandung,40257 2024,yang 166.500.000,00": "Bandung, 40257 2024, yang 166.500.000,00", "JI.Merdeka": "Jl. Merdeka", "Alamat:Jl Nomor:687": "Alamat: Jl Nomor: 687", ")PIHAK sah(x": ") PIHAK sah (x", "disebutBUT": 'disebut "BUT"', '"Para Pihak dan': '"Para Pihak" dan',
    }
    assert each(spark, text.fix_missing_spaces, *vectors) == list(vectors.values())


def test_other_cleaning_steps(spark):
    assert each(spark, text.strip_invisible, "a\u200bb\u00adc\x07\td", None) == ["abc\td", None]
    assert each(spark, text.fix_phrases, "pihakpertama BeritaAcara kotabandung") == ["PIHAK PERTAMA BERITA ACARA Kota Bandung"]
    assert each(spark, text.fix_capitals, "Pihak  Pertama dan universitas telkom", "lain") == ["PIHAK  PERTAMA dan UNIVERSITAS TELKOM", "lain"]
    assert each(spark, text.clean_signature, "XBudi Santoso Wijaya\nttd\nbcd\n12\n--\nYa\n\nXerox\nakhir") == ["Budi Santoso Wijaya\n12\nYa\n\nXerox\nakhir"]
    assert each(spark, text.clean_footer, "a\nwww.contoh.ac.id\nb", "x\nt: +62 812 3456 7890 1234\ny\n0812", "Main Campus\nBangkit  Building jalan\nx www.b.id\nz") == ["a\n\nb", "x\n\ny\n0812", "\nz"]
    assert each(spark, text.fix_number_dash, "166.500.000- dan 1.500 – lalu 1.500—x", "2026-2027 1.500-2") == ["166.500.000 dan 1.500 lalu 1.500x", "2026-2027 1.500-2"]
    assert each(spark, text.normalize_spaces, "  a \t b  \n\n\n\n  - c   d\n   1. e\n    f\n") == ["a b\n\n  - c d\n   1. e\nf"]
    assert each(spark, text.clean_ocr_line, " Nom0r  :x ") == ["Nomor : x"]


def test_whole_cleaning_with_a_table(spark):
    raw = "Nom0r:12\n|No|Harga|\n|---|---|\n|1|1.500-|\n\nsebesarRp.166.500.000-"
    assert each(spark, text.clean_ocr, raw, None, "") == ["Nomor: 12\n\n|  No  | Harga |\n|:----:|------:|\n|  1   | 1.500 |\n\nsebesar Rp. 166.500.000", None, ""]


def test_drawn_tables(spark):
    rows = [["No", "Uraian", "Harga"], ["1Satu", "Kabel | panjang", "Rp 1.500"], ["2", "Paket12"], ["", " ", ""]]
    drawn = spark.createDataFrame([(rows,), ([["a"], ["b"]],), ([],)], "r array<array<string>>").select(tables.to_markdown(F.col("r")))
    assert [x[0] for x in drawn.collect()] == [
        "|   No    | Uraian           |    Harga |\n|:-------:|:-----------------|---------:|\n| 1. Satu | Kabel \\| panjang | Rp 1.500 |\n|    2    | Paket 12         |          |",
        "",
        "",
    ]
    assert each(spark, tables.html_to_markdown, "<table><tr><td>a</td><td>b</td></tr></table>", "<p>x</p>") == ["", ""]
    assert each(spark, predicates.is_numeric_cell, "Rp. 1.500", "11%", "1.500-", "a1", "") == [True, True, True, False, False]


# Tables


def read(spark, markdown, **more):
    return tables.items(spark.createDataFrame([(1, markdown)], "doc_id int, text string"), **more).orderBy("line_no").collect()


def test_glued_amounts_and_numbers(spark):
    got = read(spark, "| No | Uraian | Qty | Harga Satuan | Jumlah Harga |\n|---|---|---|---|---|\n| 1 | Lisensi | 10 | | 5.000.00050.000.000 |\n| 2 | | 1 | 100 | 100 |\n| 3 | 5 Acess Point Subtotal (x) | 1. id:) | 1.000 | 2 |\n| | GRAND TOTAL | | | 9 |")
    assert [(r.item_no, r.description, r.quantity, r.unit_price, r.line_total) for r in got] == [("1", "Lisensi", 10.0, 5e6, 5e7), ("2", "", 1.0, 100.0, 100.0), ("5", "Acess Point", None, 1000.0, 2.0)]
    assert got[2].extra == {"Qty": "1. id:)"}


def test_tables_without_prices_and_without_a_rule(spark):
    plain = "| No | Nama Barang | Volume |\n|---|---|---|\n| 1 | Server | 2 |\n| 2 | Kabel | 3 |"
    assert read(spark, plain) == [] and [(r.description, r.quantity) for r in read(spark, plain, priced=False)] == [("Server", 2.0), ("Kabel", 3.0)]
    assert read(spark, "| a | b |\n| c | d |") == [] and [r.description for r in read(spark, "| a | b |\n| c | d |", priced=False)] == ["b", "d"]


def test_columns_by_header(spark):
    heads = [["No", "Uraian Pekerjaan/ Layanan. No", "Vol", "Sat", "HargaSatuan", "JmlHarga"], ["Part Number", "Product Name", "Qty Kampus A", "Total Qty", "Unit Price", "Amount"], ["Uraian", "Qty", "Jumlah"]]
    c = spark.createDataFrame([(i, h) for i, h in enumerate(heads)], "i int, h array<string>").orderBy("i").select(tables.item_columns(F.col("h")).alias("c")).collect()
    assert [(x.c.desc, x.c.qty, x.c.price, x.c.total) for x in c] == [(1, 2, [4], [5]), (1, 3, [4], [5]), (0, 1, [], [2])]


# Pages


def page(spark, rows):
    made = [(1, 1, i, kind, t, *(box or (None,) * 4), 0.9) for i, (kind, t, box) in enumerate(rows)]
    return spark.createDataFrame(made, "doc int, page int, ordinal int, type string, text string, x0 double, y0 double, x1 double, y1 double, confidence double")


def grouped(spark, rows, *steps):
    return [(r.type, r.text) for r in blocks.page_blocks(page(spark, rows), ["doc", "page"], steps or blocks.STEPS).orderBy("ordinal").collect()]


def test_broken_figures_are_put_together_by_row(spark):
    rows = [("paragraph", "PPN 11%", (0.1, 0.10, 0.3, 0.11)), ("paragraph", "52,43", (0.6, 0.101, 0.65, 0.111)), ("paragraph", "Total", (0.1, 0.12, 0.3, 0.13)), ("paragraph", "7", (0.651, 0.10, 0.66, 0.11)), ("paragraph", ",916", (0.662, 0.10, 0.7, 0.11)), ("paragraph", "533,218", (0.6, 0.12, 0.7, 0.13))]
    assert grouped(spark, rows, blocks.merged) == [("paragraph", "PPN 11% 52,437,916\nTotal 533,218")]


def test_lists_out_of_order_and_far_blocks(spark):
    rows = [("list_item", "b. dua", (0.1, 0.12, 0.5, 0.13)), ("list_item", "a. satu", (0.1, 0.10, 0.5, 0.11)), ("list_item", "c. tiga", (0.1, 0.14, 0.5, 0.15)), ("list_item", "jauh", (0.1, 0.5, 0.5, 0.51)), ("paragraph", "tanpa kotak", None)]
    assert grouped(spark, rows, blocks.merged) == [("list_item", "a. satu\nb. dua\nc. tiga"), ("list_item", "jauh"), ("paragraph", "tanpa kotak")]


def test_signature_columns_stay_together(spark):
    rows = [("paragraph", "Bandung", (0.1, 0.4, 0.3, 0.42)), ("paragraph", "PIHAK KEDUA", (0.6, 0.50, 0.8, 0.52)), ("paragraph", "PIHAK PERTAMA", (0.1, 0.505, 0.3, 0.525)), ("image", "", (0.1, 0.55, 0.3, 0.6)), ("paragraph", "Budi Direktur", (0.6, 0.62, 0.8, 0.64)), ("paragraph", "penutup", (0.1, 0.9, 0.5, 0.92))]
    got = grouped(spark, rows)
    assert [t for _, t in got] == ["Bandung", "PIHAK PERTAMA", "", "PIHAK KEDUA", "Budi Direktur", "penutup"] and ("attestation", "Budi Direktur") in got


def test_headings_and_blocks_as_markdown(spark):
    heads = {"BERITA ACARA SERAH TERIMA": "# ", "BAB I KETENTUAN": "# ", "PASAL 1 LINGKUP": "## ", "1. WAKTU": "## ", "1.1 Pekerjaan": "### ", "1.1.1 Rincian": "#### ", "### Judul": ""}
    assert each(spark, lambda x: blocks.block_markdown(F.lit("section_header"), x), *heads) == [v + k for k, v in heads.items()]
    kinds = [("title", "apa saja", "# apa saja"), ("key_value", "Nama : S", "- **Nama** : S"), ("key_value", "tanpa", "- tanpa"), ("caption", "T", "_T_"), ("image", "", "<!-- IMAGE -->"), ("logo", "L", "<!-- LOGO: L -->"), ("paragraph", "p", "p")]
    got = spark.createDataFrame([(i, *k) for i, k in enumerate(kinds)], "i int, k string, t string, w string").orderBy("i").select(blocks.block_markdown(F.col("k"), F.col("t"))).collect()
    assert [r[0] for r in got] == [w for *_, w in kinds]


@pytest.mark.parametrize(
    ("lines", "levels"),
    [
        (["A. a", "1) b", "a) c", "b) d", "2) e", "B. f"], [0, 1, 2, 2, 1, 0]),
        (["A.", "a.", "b.", "B."], [0, 1, 1, 0]),
        (["h. x", "i. y", "j. z"], [0, 0, 0]),
        (["a. x", "i. y", "ii. z", "b. w"], [0, 1, 1, 0]),
        (["b. x", "C. y", "d. z"], [0, 0, 0]),
        (["1. x", "3. y", "lim. z", "Jl. Merdeka", "(IV) w"], [0, 0, 1, None, 2]),
        (["iiii. x", "vx) y", "m. z"], [0, 1, 0]),
    ],
)
def test_list_levels(lines, levels):
    walk = blocks.Levels()
    assert [walk.level(x) for x in lines] == levels
    assert blocks.roman("XIV") == 14 and blocks.roman("ab") is None


def test_text_lines_join_neighbours(spark):
    boxes = [("b", 0.3, 0.1005, 0.4, 0.112), ("a", 0.1, 0.1, 0.2, 0.11), ("jauh", 0.7, 0.1, 0.8, 0.11), ("straddles", 0.1, 0.2174, 0.2, 0.2274), ("too:x", 0.25, 0.2176, 0.3, 0.2276)]
    got = layout.text_lines(spark.createDataFrame([(1, t, *b, 0.8) for t, *b in boxes], "p int, text string, x0 double, y0 double, x1 double, y1 double, confidence double"), ["p"])
    assert sorted(r.text for r in got.collect()) == ["a b", "jauh", "straddles too : x"]


# Evidence


def test_identifier_forms(spark):
    assert each(spark, identifiers.skeleton, "K. TEL.05/HK-1", "a_b é9") == ["KTEL05HK1", "ABÉ9"]
    assert each(spark, identifiers.folded, "T1R-OD0", "T1R-0D0", "sbL", "lIoSB") == ["T1R0D0", "T1R0D0", "SBL", "11058"]
    assert each(spark, identifiers.looks_like_identifier, "045/SPK/LOG-02/2031", "123-00-4567890-1", "tanpa angka", "a b c d e f g 1", "12") == [True, True, False, False, False]


def locate(spark, value, *texts, least=0.65, pages=None):
    v = spark.createDataFrame([(1, "f", value)], "doc int, field string, value string")
    b = spark.createDataFrame([(1, f"b{i}", (pages or [1] * 9)[i], i, t, 0.9) for i, t in enumerate(texts)], "doc int, block_id string, page int, ordinal int, text string, confidence double")
    r = evidence.located(v, b, "doc", least).first()
    return r and (r.match_type, ",".join(r.block_ids), r.evidence_score)


def test_located_values(spark):
    assert locate(spark, "K.TEL.05/HK.810", "Nomor K. TEL.05/HK.810 tanggal itu") == ("identifier_match", "b0", 0.873)
    assert locate(spark, "HKT81O", "No, HKT810") == ("identifier_match_ocr_tolerant", "b0", 0.828)
    assert locate(spark, "AB12.34CD", "a", "No, AB1234CD") == ("identifier_match", "b1", 0.873)
    assert locate(spark, "1,499.4", "senilai 1499.6 saja") == ("number_match", "b0", 0.891) and locate(spark, "1", "Jalan No. 1 Kota") is None and locate(spark, "1", "Jalan No. 1 Kota", "1") == ("number_match", "b1", 0.81)
    assert locate(spark, "2026-06-29", "tanggal 29 Juni 2026") == ("date_match", "b0", 0.855) and locate(spark, "2026-06-28", "tanggal 29 Juni 2026") is None
    assert locate(spark, "Server Rak", "panjang sekali: server rak", "Server, RAK") == ("exact_match", "b1", 0.891)
    assert locate(spark, "30 hari kalender", "30 (tiga puluh) hari kalender") == ("exact_match", "b0", 0.891)
    assert locate(spark, "jaringan komputer gedung pusat lama", "jaringan komputer gedung utama lama")[0] == "semantic_token_match"
    assert locate(spark, "apa saja", "lain", None) is None and locate(spark, "x", "x") is None


def test_values_over_several_blocks(spark):
    assert locate(spark, "Jalan Merdeka Nomor Lima Bandung Jawa", "Alamat Jalan Merdeka Nomor", "Lima Bandung Jawa Barat")[:2] == ("phrase_containment+multiblock", "b0,b1")
    assert locate(spark, "Jalan Merdeka Nomor Lima Bandung Jawa", "Alamat Jalan Merdeka Nomor", "Lima Bandung Jawa Barat", pages=[1, 2]) is None or "+" not in locate(spark, "Jalan Merdeka Nomor Lima Bandung Jawa", "Alamat Jalan Merdeka Nomor", "Lima Bandung Jawa Barat", pages=[1, 2])[0]


def test_second_reading_sends_back(spark):
    e = spark.createDataFrame([(1, "Nomor", "A-O1", "AUTO_VERIFIED", 0.9, ["x"]), (1, "NPWP", "7", "AUTO_ACCEPTED", 0.5, [])], "doc int, field string, value string, status string, confidence double, rules array<string>")
    got = {r.field: (r.status, r.confidence, r.rules) for r in evidence.verify_second_reading(e, spark.createDataFrame([(1, "Nomor", "a - 0I lain"), (1, "NPWP", "8")], "doc int, field string, reading string"), "doc").collect()}
    assert got == {"Nomor": ("AUTO_VERIFIED", 0.9, ["x"]), "NPWP": ("REVIEW_REQUIRED", 0.5, ["ocr_kedua_berbeda"])}


# Signatures

PP, PK = "PT PEMBERI KERJA NUSANTARA TBK", "PT PENYEDIA JAYA ABADI"


def columns(page=2, left="ANDI WIJAYA SENIOR MANAGER OPERASI", right="BUDI SANTOSO DIREKTUR"):
    line = lambda t, *box: signatures.Line(page, t, box)
    return [line(PP, 0.14, 0.6, 0.46, 0.62), line(PK, 0.58, 0.6, 0.84, 0.62), line("METERAI TEMPEL 5F2AOX0862", 0.2, 0.66, 0.36, 0.7), line(left, 0.15, 0.74, 0.45, 0.78), line(right, 0.6, 0.74, 0.8, 0.77)]


def sign(lines, first=(None, None), second=(None, None)):
    out = signatures.resolved(lines, {"first": {"company": PP, "name": first[0], "title": first[1]}, "second": {"company": PK, "name": second[0], "title": second[1]}})
    return [(out[s]["name"], out[s]["title"], out[s]["change"]) for s in signatures.SIDES]


def test_signers_follow_their_columns():
    andi, budi = ("ANDI WIJAYA", "SENIOR MANAGER OPERASI"), ("BUDI SANTOSO", "DIREKTUR")
    assert sign(columns()) == [(*andi, "filled"), (*budi, "filled")]
    assert sign(columns(), budi, andi) == [(*andi, "replaced"), (*budi, "replaced")]
    assert sign(columns(), ("Andi Wijaya", None), ("Orang Lain", "Staf")) == [("Andi Wijaya", andi[1], None), ("Orang Lain", "Staf", None)]
    copies = columns(2, right="BeuTeloMn BUDA DIREKTUR") + columns(3, right="Be Tel - U BUDI SANTOSO DIREKTUR")
    assert sign(copies)[1] == (*budi, "filled")
    assert signatures.best_spelling("ANDI WIJ'AYA", ["ANDI WIJ'AYA", "ANDI WJAYA"]) == "ANDI WIJAYA"


def test_uncertain_and_single_signers():
    both = [signatures.Line(1, f"{PP} {PK}", (0.14, 0.6, 0.84, 0.62)), signatures.Line(1, "ANDI WIJAYA", (0.1, 0.7, 0.3, 0.72))]
    assert sign(both, second=("ANDI WIJAYA", "X"))[1][2] == "uncertain" and sign(both)[0] == (None, None, None)
    letter = [signatures.Line(1, f"Hormat Kami,\na.n {PP}\nDirektur Utama", (0.1, 0.6, 0.4, 0.66)), signatures.Line(1, "Be Tel Andi Wijaya", (0.1, 0.75, 0.4, 0.77)), signatures.Line(2, "diwakili Andi Wijaya", None)]
    assert sign(letter)[0] == ("Andi Wijaya", "Direktur Utama", "filled")


def test_signers_of_documents(spark):
    rows = [(d, x.page, i, x.text, *x.box) for d in (1, 2) for i, x in enumerate(columns())]
    b = spark.createDataFrame(rows, "doc int, page int, ordinal int, text string, x0 double, y0 double, x1 double, y1 double")
    p = spark.createDataFrame([(1, "first", PP, None, None), (1, "second", PK, None, None), (3, "first", PP, "A", None)], "doc int, side string, company string, name string, title string")
    got = {(r.doc, r.side): (r.name, r.change) for r in signatures.signers(b, p, "doc").collect()}
    assert got == {(1, "first"): ("ANDI WIJAYA", "filled"), (1, "second"): ("BUDI SANTOSO", "filled"), (3, "first"): ("A", None), (3, "second"): (None, None)}


# Entities, numbers, dates


def test_contract_numbers_and_marks(spark):
    t = "Nomor Rekening: 12345678\nNomor: 12/AB / 2026\nNomor SPK : SPK/1"
    assert each(spark, entities.contract_numbers, t, "kosong", None)[:2] == [["SPK/1", "12/AB/2026"], []]
    docs = spark.createDataFrame([(1, "Pasal 1 HARGA\nNomor SPK : SPK/1\nselesai"), (2, "kosong"), (3, None)], "doc_id int, text string")
    assert {r.doc_id: r.text for r in entities.enriched(docs).collect()} == {1: "[SECTION: PRICE]\nPasal 1 HARGA\n[KEY: Nomor Kontrak Kerja = SPK/1]\nNomor SPK : SPK/1\nselesai", 2: "kosong", 3: None}


def test_number_words_and_worded_dates(spark):
    assert each(spark, numbers.plain_number_words, "dua puluh dua", "dua ribu dua puluh enam", "sebelas", "tiga belas", "seribu", "seratus satu", "se puluh", "nol", "dua kata", "") == [22, 2026, 11, 13, 1000, 101, 10, None, None, None]
    got = each(spark, dates.parse_date_by_priority, "tanggal Dua Puluh Dua bulan Juni tahun Dua Ribu Dua Puluh Enam", "11/08/2026", "2026-13-01 lalu 1 Mei 2026", "11 Agustus 2026", "3 Mac 2026", None)
    assert [str(x) if x else None for x in got] == ["2026-06-22", "2026-08-11", None, "2026-08-11", None, None]


def test_payment_terms(spark):
    got = each(spark, contracts.payment_term, "Termin I sebesar Rp 1.000,-", "setiap termin 1 Rp 5.000", "Uang muka 20% Rp. 3.000 dan Rp 4.000", "retensi 5 %, 5%")
    assert [(x["label"], x["amount"], x["percentage"]) for x in got] == [("Termin I", 1000.0, None), (None, None, None), ("Uang muka", None, "20%"), ("retensi", None, "5%")]


# Reconciliation, validation, schemas


def test_words_papers_and_lists(spark):
    t = "senilai (Dua Ribu Rupiah) dan (Tiga Ribu Lima Ratus Rupiah)"
    df = spark.createDataFrame([(t, None, 3500.0, 2000.0), (t, "dua ribu", 3500.0, 2000.0), (t, "salah", 7.0, 8.0)], "t string, w string, a double, b double")
    assert [r[0] for r in df.select(reconcile.fill_words(F.col("w"), F.col("t"), [F.col("a"), F.col("b")])).collect()] == ["Tiga Ribu Lima Ratus Rupiah", "dua ribu", "salah"]
    papers = spark.createDataFrame([([("Berita Acara Negosiasi Harga", "24 Januari 2025", "24 Januari 2025"), ("Surat A.", "1/A", None)], ["surat a", "Foto"], None)], "p array<struct<name:string,number:string,date:string>>, l array<string>, n string")
    r = papers.select(reconcile.tidy_supporting(F.col("p"), F.col("l"), F.col("n")).alias("r")).first().r
    assert ([p.number for p in r.papers], r.attachments, r.negotiated) == ([None, "1/A"], ["Foto"], "24 Januari 2025")
    items = spark.createDataFrame([([("1", "2 Kabel"), ("1", "Total"), (None, "Alat")],), ([("1", "a"), ("1", "b")],)], "i array<struct<number:string,description:string>>")
    assert [[tuple(x) for x in r[0]] for r in items.select(reconcile.number_items(F.col("i"))).collect()] == [[("1", "Kabel"), ("2", "Alat")], [("1", "a"), ("2", "b")]]


def test_line_totals_with_extra_values(spark):
    items = spark.createDataFrame([(1, 1, 2.0, 1e6, None, {"Bulan": "12"}, 24e6), (1, 2, 2.0, 1e6, None, {"Kode": "99999"}, 24e6), (1, 3, 2.0, 1e6, 3.0, None, 6e6), (1, 4, 2.0, 1e6, None, None, None)], "k int, line_no int, quantity double, unit_price double, period_factor double, extra map<string,string>, line_total double")
    assert [(r.rule, r.fields[0]) for r in validation.line_issues(items, "k").collect()] == [("item_line_total", "items[1].quantity")]


def test_parties_that_seem_one(spark):
    p = [(1, "A", "B", "x", "y", "BUDI SANTOSO", "BUDIA", "Direktur", "direktur"), (2, "A", "a ", "", "", "Ani", "Budi", "x", "x"), (3, "A", "B", None, None, None, "Budi", None, None)]
    df = spark.createDataFrame(p, "k int, first_name string, second_name string, first_address string, second_address string, first_signer string, second_signer string, first_title string, second_title string")
    assert sorted((r.k, r.severity) for r in validation.party_issues(df, "k").collect()) == [(1, "warning"), (2, "error")]


def test_notes(spark):
    assert [r.message for r in validation.duplicate_page_notes(spark.createDataFrame([(1, 4), (2, 3)], "k int, kept int"), spark.createDataFrame([(1, 8), (2, 3)], "k int, pages int"), "k").collect()] == ["pages 5-8 repeat earlier ones and were not read; please check that they are the same"]
    hidden = spark.createDataFrame([(1, 2, 0, "PPN 1.000", True), (1, 3, 0, "x" * 200, True)], "k int, page int, ordinal int, text string, removed boolean")
    note = validation.hidden_text_notes(hidden, "k").first().message
    assert note.startswith('hidden text on page 2, 3: "PPN 1.000; xxx') and note.endswith('..."; it was not read') and len(note) < 230
    e = spark.createDataFrame([(1, "total", "5.000", "UNSUPPORTED"), (1, "title", "x", "UNSUPPORTED"), (1, "vat", "1", "AUTO_VERIFIED")], "k int, field string, value string, status string")
    assert [(r.rule, r.actual) for r in validation.ungrounded_amounts(e, "k", "contract").collect()] == [("amounts_grounded", 5000.0)]


def test_schema_tools():
    schema = {"properties": {"a": {"type": "string"}, "Keterangan": {"anyOf": [{"type": "string"}, {"type": "null"}]}, "n": {"type": "number"}, "p": {"$ref": "#/$defs/P"}}, "required": ["a", "n", "p"], "$defs": {"P": {"type": "object", "properties": {"q": {"type": "array"}}, "required": ["q"]}}}
    bounded = schemas.bounded_texts(schema)
    assert bounded["properties"]["a"]["maxLength"] == 600 and bounded["properties"]["Keterangan"]["anyOf"][0]["maxLength"] == 2500 and "maxLength" not in schema["properties"]["a"]
    assert schemas.without_fields(schema, ("a",))["required"] == ["n", "p"] and schemas.empty_result(schema) == {"a": "", "n": 0, "p": {"q": []}}
    assert schemas.without_zeros({"a": "", "n": 0}, schema) == {"a": "", "n": None} and schemas.asked_again({"a": 1, "b": {"c": 2}, "d": 3}, ["b.c", "d"]) == {"b": {"c": 2}, "d": 3}


def test_reading_quality(spark):
    df = spark.createDataFrame([(("GOOD", "x", 0.12345, float("nan"), None),), ((None, "?", 1.0, 1.0, 1.0),)], "r struct<mean_grade:string,low_grade:string,layout_score:double,ocr_score:double,parse_score:double>")
    got = [r[0] for r in df.select(readers.reading_quality(F.col("r"))).collect()]
    assert tuple(got[0]) == ("good", None, 0.123, None, None) and got[1] is None


# Regions, guards, jobs


def test_types_by_label_and_by_words(spark):
    from lontar.operators import regions

    got = spark.createDataFrame([("text", "Nama"), ("text", "Nomor: 1"), ("text", "kalimat " * 20 + ":"), ("page_footer", "x"), ("chart", ""), ("odd", "x")], "l string, t string").select(regions.label_type(F.col("l"), F.col("t"))).collect()
    assert [r[0] for r in got] == ["key_value", "key_value", "paragraph", "footer", "image", "paragraph"]
    assert each(spark, regions.line_type, "Surat Perintah Kerja", "3. WAKTU", "Nama : x", "| a |", "Harga Satuan", "meterai tempel", "kalimat biasa") == ["header", "header", "key_value", "table", "table", "signature", "paragraph"]
    assert each(spark, regions.is_footer_noise, "1 / 9", "www.contoh.co.id/", "", "hal 1") == [True, True, True, False]
    assert regions.capital_heading("SURAT PERINTAH KERJA") and not regions.capital_heading("PT MAJU JAYA") and not regions.capital_heading("SATU")


def test_boxes_and_covered_text(spark):
    spans = spark.createDataFrame([(1, 5, "a", 0.1, 0.1, 0.2, 0.2), (1, 9, "b", 0.1, 0.1, 0.2, 0.2), (2, 5, "c", 0.1, 0.1, 0.2, 0.2)], "page int, seqno int, text string, x0 double, y0 double, x1 double, y1 double")
    fills = spark.createDataFrame([(1, 7, 0.0, 0.0, 0.5, 0.5), (2, 7, 0.15, 0.0, 0.5, 0.5)], "page int, seqno int, x0 double, y0 double, x1 double, y1 double")
    assert [r.text for r in layout.covered_spans(spans, fills, ["page"]).collect()] == ["a"]
    boxes = spark.createDataFrame([(1, "in", 0.1, 0.1, 0.2, 0.2), (1, "out", 0.6, 0.6, 0.7, 0.7), (3, "other", 0.1, 0.1, 0.2, 0.2)], "page int, text string, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r.text for r in layout.uncovered(boxes, fills, ["page"]).collect()) == ["other", "out"]
    box = spark.createDataFrame([((0.9, 1.2, 0.123456789, -0.1),), (None,)], "b struct<x0:double,y0:double,x1:double,y1:double>").select(layout.visual_box(F.col("b"))).collect()
    assert tuple(box[0][0]) == (0.12346, 0.0, 0.9, 1.0) and box[1][0] is None


def test_guards_before_a_delete(spark):
    from lontar.operators import mapping
    from lontar.streaming import jobs

    gone = spark.createDataFrame([(1,), (2,)], "id int")
    found = mapping.still_referenced(gone, {"review": (spark.createDataFrame([(2,), (2,), (3,)], "item int"), "item"), "note": (spark.createDataFrame([], "i int"), "i")}, "id")
    assert [tuple(r) for r in found.collect()] == [(2, "review")]
    assert jobs.summaries(spark.createDataFrame([(1, "done", "x" * 100)], "job_id int, status string, result string")).columns == ["job_id", "status"]
