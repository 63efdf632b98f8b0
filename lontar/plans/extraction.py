"""Registered queries on evidence, entities, signatures, records and notes.

Documents are rendered from the columns of orders, line items and customers, over whole tables; the SQL takes what the
operators must find from those columns directly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lontar.functions import numbers
from lontar.functions.dates import write_date
from lontar.operators import blocks, entities, evaluation, evidence, reconcile, records, regions, signatures, tables, validation
from lontar.plans.registry import grouped, parsed, query, said, spread
from lontar.plans.registry import table as _t
from lontar.sources import readers

OURS = (r"\bkita\b",)


def _column(x) -> Column:
    return F.lit(x) if isinstance(x, str) else x


def _rows(*parts: dict) -> Column:
    """An array of structs; a part that is null is left out."""
    made = F.array(*[F.struct(*[(_column(v) if isinstance(v, (str, Column)) else F.lit(v)).alias(k) for k, v in p.items()]) for p in parts])
    return F.explode(made)


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return spread(_t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"), "o_orderkey")


# Evidence


_PEOPLE = "orders as (select c_custkey o_orderkey, c_nationkey + 1 o_custkey, date '2026-01-01' + (c_custkey % 300)::int o_orderdate from customer)"


def _people(spark: SparkSession, d: str) -> DataFrame:
    """A document for each customer."""
    c = spread(_t(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    return c.select(F.col("c_custkey").alias("o_orderkey"), (F.col("c_nationkey") + 1).alias("o_custkey"), F.date_add(F.lit("2026-01-01").cast("date"), (F.col("c_custkey") % 300).cast("int")).alias("o_orderdate"))


def _page(spark: SparkSession, d: str) -> DataFrame:
    k, c, n = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_custkey") * 1000 + 100
    texts = (
        said("Kontrak, K.TEL. ", k, "/HK.810/", c), said("Nilai pekerjaan Rp ", grouped(n), ",-"), said("Ditetapkan pada tanggal ", write_date(F.to_date("o_orderdate")), " oleh panitia"),
        said("Alamat kantor di Jalan Merdeka Nomor ", c, " Kota Bandung Provinsi"), "Jawa Barat Kode Pos empat puluh ribu", "Pengadaan perangkat jaringan tahap akhir", said("rapat koordinasi teknis ", k),
        said("selama 30 (tiga puluh) hari kalender sejak surat ", k),
    )
    block = _rows(*[{"ordinal": i, "block_id": f"b{i}", "page": 1 + i // 6, "text": t, "confidence": 0.9} for i, t in enumerate(texts)])
    return _people(spark, d).select("o_orderkey", block.alias("b")).select("o_orderkey", "b.*")


def _values(spark: SparkSession, d: str) -> DataFrame:
    k, c, n = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_custkey") * 1000 + 100
    wanted = {
        "number": said("K.TEL.", k, " / HK.810/", c), "misread": said("K.TEL.", k, "/HK.81O/", c), "value": n.cast("string"), "date": F.date_format("o_orderdate", "yyyy-MM-dd"), "title": "pengadaan perangkat jaringan tahap akhir",
        "street": "Jalan Merdeka Nomor", "city": "Kota Bandung Provinsi Jawa Barat Kode Pos", "meeting": said("rapat koordinasi teknis ", k, " lanjutan"), "term": "30 hari kalender", "absent": said("tidak tertulis di mana pun ", k),
    }
    return _people(spark, d).select("o_orderkey", _rows(*[{"field": f, "value": v} for f, v in wanted.items()]).alias("v")).select("o_orderkey", "v.*")


_STREET = "length('jalan merdeka nomor')", "length('alamat kantor di jalan merdeka nomor ' || o_custkey || ' kota bandung provinsi')"
_CITY = "length('kota bandung provinsi jawa barat kode pos')", "length('alamat kantor di jalan merdeka nomor ' || o_custkey || ' kota bandung provinsi jawa barat kode pos empat puluh ribu')"
_TERM = "length('30 hari kalender')", "length('selama 30 hari kalender sejak surat ' || o_orderkey)"
_PHRASE = "round(least(0.98, (0.72 + 0.26 * pow({}::double / {}, 0.3)) * 0.9), 3)"
_FOUND = f"""select o_orderkey, 'number' field, 'identifier_match' match_type, 'b0' block, 0.873 score from orders union all select o_orderkey, 'misread', 'identifier_match_ocr_tolerant', 'b0', 0.828 from orders
    union all select o_orderkey, 'value', 'number_match', 'b1', 0.891 from orders union all select o_orderkey, 'date', 'date_match', 'b2', 0.855 from orders union all select o_orderkey, 'title', 'exact_match', 'b5', 0.891 from orders
    union all select o_orderkey, 'street', 'phrase_containment', 'b3', {_PHRASE.format(*_STREET)} from orders
    union all select o_orderkey, 'city', 'phrase_containment+multiblock', 'b3,b4', round({_PHRASE.format(*_CITY)} - 0.03, 3) from orders
    union all select o_orderkey, 'meeting', 'reverse_containment', 'b6', round((0.72 + 0.18 * length('rapat koordinasi teknis ' || o_orderkey)::double / length('rapat koordinasi teknis ' || o_orderkey || ' lanjutan')) * 0.9, 3) from orders
    union all select o_orderkey, 'term', 'phrase_containment', 'b7', {_PHRASE.format(*_TERM)} from orders"""


@query(f"with {_PEOPLE} {_FOUND}")
def evidence_located(spark: SparkSession, d: str) -> DataFrame:
    """Values of every kind of match but the fuzzy one, on two pages of an order's document."""
    found = evidence.located(_values(spark, d), _page(spark, d), "o_orderkey")
    return found.select("o_orderkey", "field", "match_type", F.array_join("block_ids", ",").alias("block"), F.col("evidence_score").alias("score"))


@query(
    f"""with {_PEOPLE}, f as ({_FOUND}), v as (select o_orderkey, unnest(['number', 'misread', 'value', 'date', 'title', 'street', 'city', 'meeting', 'term', 'absent']) field from orders),
    j as (select v.*, match_type t, score s, v.field = 'value' and o_orderkey % 3 = 0 err, v.field = 'street' and o_orderkey % 2 = 0 warn from v left join f using (o_orderkey, field))
    select o_orderkey, field, coalesce(s, 0) evidence_score, round(0.6 * coalesce(s, 0) + 0.15 * case when s is null then 0 else 0.9 end + 0.25 * case when err then 0 when warn then 0.5 else 1 end, 3) confidence,
      case when err then 'CONFLICT' when s is null then 'UNSUPPORTED' when warn then 'REVIEW_REQUIRED' when s >= 0.85 and t in ('exact_match', 'number_match', 'phrase_containment', 'identifier_match') then 'AUTO_VERIFIED' when s >= 0.8 then 'AUTO_ACCEPTED' else 'REVIEW_REQUIRED' end status from j"""
)
def field_evidence(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    issue = lambda when, rule, severity, field: F.when(when, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.array(F.lit(field)).alias("fields")))
    both = F.filter(F.array(issue(k % 3 == 0, "total", "error", "value"), issue(k % 2 == 0, "address", "warning", "street")), lambda x: x.isNotNull())
    issues = _people(spark, d).select("o_orderkey", F.explode(both).alias("i")).select("o_orderkey", "i.*")
    return evidence.field_evidence(_values(spark, d), _page(spark, d), issues, "o_orderkey").select("o_orderkey", "field", "evidence_score", "confidence", "status")


# Texts


@query(
    """with v as (select *, strftime(o_orderdate, '%d') || ' ' || list_extract(['Januari', 'Februari', 'Maret', 'April', 'Mei', 'Juni', 'Juli', 'Agustus', 'September', 'Oktober', 'November', 'Desember'], month(o_orderdate)) || ' ' || year(o_orderdate) tgl from orders)
    select o_orderkey, e.f as field, e.v as value, e.n::int as line from v, lateral (select unnest([
      {'f': 'Nomor Kontrak Kerja', 'v': 'SPK.' || o_orderkey || '/KT/2026', 'n': 0}, {'f': 'Nomor Kontrak Internal', 'v': 'INT-' || o_orderkey || '/9', 'n': 0}, {'f': 'Nama Pekerjaan', 'v': 'Pengadaan jaringan gedung ' || o_custkey, 'n': 3},
      {'f': 'Tanggal Negosiasi', 'v': tgl, 'n': 4}, {'f': 'Nama Bank', 'v': 'Bank Mandiri', 'n': 5}, {'f': 'Lokasi Cabang Bank', 'v': 'Asia Afrika', 'n': 5}, {'f': 'Nomor Rekening Bank', 'v': '130-00-' || (1000000 + o_orderkey), 'n': 5},
      {'f': 'Nama Rekening Bank', 'v': 'PT Kita Jaya', 'n': 5}, {'f': 'Durasi Kerja', 'v': (30 + o_orderkey % 60) || ' hari kalender', 'n': 6}, {'f': 'Persentase Sanksi/Penalti', 'v': '1/1000 (satu per mil)', 'n': 7},
      {'f': 'Lokasi', 'v': 'Bandung', 'n': 8}, {'f': 'Tanggal Pembuatan Dokumen', 'v': tgl, 'n': 9}]) e)"""
)
def entity_hints(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    day = F.date_format("o_orderdate", "dd")
    written = F.concat(day, F.regexp_replace(write_date(F.to_date("o_orderdate")), r"^\d+", ""))
    text = said(
        "SURAT PERINTAH KERJA\n| No | Nama Pekerjaan | Qty |\nNomor SPK : SPK.", k, "/KT/2026 dan Nomor PKS: INT-", k, "/9\nNama Pekerjaan : Pengadaan jaringan gedung ", c, "\nBerita Acara Negosiasi Harga pada tanggal ", written,
        "\nDibayar ke rekening Bank Mandiri cabang Asia Afrika no rekening 130-00-", k + 1000000, " a.n PT Kita Jaya, sebesar itu\nLama pekerjaan ", 30 + k % 60, " hari kalender\nDenda keterlambatan sebesar 1/1000 (satu per mil) sehari\nDibuat di : Bandung\nPada tanggal ", written, "\n",
    )
    return entities.entities(_orders(spark, d).select("o_orderkey", text.alias("text")), "o_orderkey").select("o_orderkey", "field", "value", "line")


@query(
    """select o_orderkey, 'PT Mitra ' || o_custkey first_company, 'Budi Santoso' first_name, 'Direktur' first_title, 'Jl. Merdeka No. ' || o_custkey || ' Kota Bandung' first_address, 'CV Kita' second_company, 'Ani Lestari' second_name, 'Manager' second_title, 'Jl. Asia No. 2' second_address from orders"""
)
def preamble_parties(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("o_custkey")
    text = said(
        "Kami yang bertanda tangan di bawah ini:\nNama : Budi Santoso\nJabatan : Direktur\nAlamat : Jl. Merdeka No. ", c, "\nKota Bandung\nYang dalam hal ini mewakili secara sah : PT Mitra ", c, ", selanjutnya disebut \"PIHAK PERTAMA\"\n",
        "Nama : Ani Lestari\nJabatan : Manager\nAlamat : Jl. Asia No. 2\nmewakili CV Kita, selanjutnya disebut PIHAK KEDUA\nPara pihak sepakat.",
    )
    p = entities.parties(text)
    return _orders(spark, d).select("o_orderkey", *[p[s][f].alias(f"{s}_{f}") for s in ("first", "second") for f in ("company", "name", "title", "address")])


@query(
    """select o_orderkey, 'PT Mitra ' || o_custkey company, 'Direktur Utama' title, case when o_orderkey % 2 = 0 then 'Ani Lestari' end as name, 'Jl. Merdeka ' || o_custkey address, '027/PL/' || o_orderkey || '/2026' as number, '31 Juli 2026' as date, case when o_orderkey % 3 = 0 then 'Permintaan Penawaran ' || o_custkey end subject from orders"""
)
def letter_heads(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = said("Kepada Yth, ", F.when(k % 2 == 0, "Ibu Ani Lestari, ").otherwise(""), "Direktur Utama PT Mitra ", c, " Jl. Merdeka ", c, "\nDengan hormat,\nMenunjuk Surat Nomor: 027/PL/", k, " /2026 tanggal 31 Juli 2026", F.when(k % 3 == 0, said(" perihal Permintaan Penawaran ", c, ". Kami sampaikan")).otherwise(", kami"), " penawaran.")
    a, r = entities.addressee(text), entities.request_reference(text)
    return _orders(spark, d).select("o_orderkey", a["company"].alias("company"), a["title"].alias("title"), a["name"].alias("name"), a["address"].alias("address"), r["number"].alias("number"), r["date"].alias("date"), r["subject"].alias("subject"))


@query(
    """with w as (select p_partkey, p_name n, p_size::varchar z, greatest(4, length(p_name)) w, greatest(5, length(p_size::varchar)) v from part)
    select p_partkey, 'Awal' || chr(10) || chr(10) || '| ' || rpad('Nama', w::int, ' ') || ' | ' || lpad('Harga', v::int, ' ') || ' |' || chr(10) || '|:' || repeat('-', (w + 1)::int) || '|' || repeat('-', (v + 1)::int) || ':|' || chr(10) || '| ' || rpad(n, w::int, ' ') || ' | ' || lpad(z, v::int, ' ') || ' |' || chr(10) || 'Akhir' as text from w"""
)
def aligned_tables(spark: SparkSession, d: str) -> DataFrame:
    text = said("Awal\n|Nama|Harga|\n|---|---|\n|", F.col("p_name"), "|  ", F.col("p_size"), " |\nAkhir")
    return _t(spark, d, "part").select("p_partkey", tables.realigned(text).alias("text"))


@query(
    """select o_orderkey, '# SURAT PERINTAH KERJA' || chr(10) || chr(10) || '## PASAL 1' || chr(10) || chr(10) || '1. butir ' || o_custkey || chr(10) || '   - a. anak' || chr(10) || chr(10) || '2. lanjut' || chr(10) || chr(10) || '### 1.1 Rincian' || chr(10) || chr(10) || '- **Nama** : Budi ' || o_custkey || chr(10) || chr(10) || '<!-- FOOTER: hal 1 -->' || chr(10) || chr(10) || 'isi' as markdown from orders"""
)
def document_markdown(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("o_custkey")
    parts = (("section_header", "SURAT PERINTAH KERJA"), ("section_header", "PASAL 1"), ("list_item", said("1. butir ", c, "\na. anak")), ("list_item", "2. lanjut"), ("section_header", "1.1 Rincian"), ("key_value", said("Nama: Budi ", c)), ("footer", "hal 1"), ("paragraph", "isi"))
    made = _rows(*[{"page": 1 + i // 4, "ordinal": i, "type": kind, "text": t} for i, (kind, t) in enumerate(parts)])
    return blocks.document_markdown(_orders(spark, d).select("o_orderkey", made.alias("b")).select("o_orderkey", "b.*"), "o_orderkey")


# Signatures


@query(
    """select o_orderkey, 'first' side, case when o_orderkey % 3 = 1 then 'ANDI WIJAYA' else 'ANDI WIJAYA' end as name, 'DIREKTUR UTAMA' as title, case o_orderkey % 3 when 0 then null when 1 then 'replaced' else 'filled' end as change from orders
    union all select o_orderkey, 'second', case when o_orderkey % 3 = 0 then 'SITI RAHAYU' when o_orderkey % 3 = 1 then 'SITI RAHAYU' else 'Orang Lain' end, case when o_orderkey % 3 = 2 then 'Staf' else 'MANAGER' end, case o_orderkey % 3 when 1 then 'replaced' end from orders"""
)
def column_signers(spark: SparkSession, d: str) -> DataFrame:
    """Two copies of a signature page, one with a stamp and a lost letter; right, swapped, and missing or foreign names."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    lines = []
    for page, first in ((1, "ANDI WIJAYA"), (2, "ANDI WJAYA")):
        lines += [(page, said("PT Mitra Sejahtera ", c), 0.1, 0.60, 0.4), (page, "CV Karya Kita", 0.6, 0.61, 0.9), (page, "METERAI TEMPEL 10000", 0.1, 0.66, 0.4), (page, first, 0.1, 0.72, 0.4), (page, "DIREKTUR UTAMA", 0.1, 0.74, 0.4), (page, "SITI RAHAYU", 0.6, 0.72, 0.9), (page, "MANAGER", 0.6, 0.74, 0.9), (page, "Tembusan: DIREKTUR BUDI", 0.1, 0.85, 0.4)]
    page = _rows(*[{"page": p, "ordinal": i, "text": t, "x0": x0, "y0": y0, "x1": x1, "y1": y0 + 0.015} for i, (p, t, x0, y0, x1) in enumerate(lines)])
    seen = _orders(spark, d).select("o_orderkey", page.alias("b")).select("o_orderkey", "b.*")
    pick = lambda *options: F.when(k % 3 == 0, options[0]).when(k % 3 == 1, options[1]).otherwise(options[2])
    none = F.lit(None).cast("string")
    sides = _rows(
        {"side": "first", "company": said("PT. Mitra Sejahtera ", c, " Tbk"), "name": pick(F.lit("Andi Wijaya"), F.lit("Siti Rahayu"), none), "title": pick(F.lit("DIREKTUR UTAMA"), F.lit("Manager"), none)},
        {"side": "second", "company": "CV Karya Kita", "name": pick(F.lit("Siti Rahayu"), F.lit("Andi Wijaya"), F.lit("Orang Lain")), "title": pick(F.lit("MANAGER"), F.lit("Direktur"), F.lit("Staf"))},
    )
    found = signatures.signers(seen, _orders(spark, d).select("o_orderkey", sides.alias("p")).select("o_orderkey", "p.*"), "o_orderkey")
    return found.select("o_orderkey", "side", F.when(F.col("change").isNull() & (k % 3 == 0), F.upper("name")).otherwise(F.col("name")).alias("name"), "title", "change")


# Records


def _results(spark: SparkSession, d: str) -> DataFrame:
    """A contract's result for each order, as parsed from JSON."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    line = F.struct(
        F.col("l_linenumber").alias("n"), F.lit("A").alias("Kategori/Kelompok"), F.when(F.col("l_linenumber") % 4 == 0, " ").otherwise(said("Barang ", F.col("l_partkey"))).alias("Deskripsi Item/Barang/Pekerjaan"), F.col("l_quantity").cast("string").alias("volume"), F.lit("Unit").alias("unit"),
        said("Rp ", grouped(F.col("l_suppkey") * 1000), ",-").alias("Harga Satuan"), F.when(F.col("l_returnflag") == "R", "OTC").when(F.col("l_returnflag") == "A", "lain").alias("Jenis Biaya"),
    )
    items = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", line.alias("row")))).alias("rows"))
    party = lambda org, who: F.struct(org.alias("Nama Perusahaan"), F.lit(who).alias("Nama Representative"))
    data = F.struct(
        said("K-", k).alias("Nomor Kontrak Kerja"), said(" Pengadaan ", c, " ").alias("Nama Pekerjaan"), write_date(F.to_date("o_orderdate")).alias("Tanggal Pembuatan Dokumen"), said("1 Januari 2026 s/d ", F.date_format("o_orderdate", "dd-MM-yyyy")).alias("Jangka Waktu"),
        said("Rp ", grouped(c * 1000), ",-").alias("Total Harga Pekerjaan"), F.array(F.lit("Foto"), F.lit(""), F.lit("Laporan")).alias("Syarat Lampiran Wajib BAST"), F.array(said("Termin 1 sebesar Rp ", grouped(c * 100), ",-"), F.lit("setiap termin 30%")).alias("Ketentuan Pembayaran"),
        party(F.when(k % 3 == 0, "PT Kita Jaya").otherwise(said("PT Mitra ", c)), "Andi").alias("Pihak Pertama"), party(F.when(k % 3 == 1, "PT Kita Jaya").when(k % 3 == 2, F.lit(None)).otherwise("CV Lain"), "Budi").alias("Pihak Kedua"), F.transform("rows", lambda x: x["row"]).alias("List Item/Barang"),
    )
    found = lambda field, value, page, state: F.struct(F.lit(field).alias("field"), value.cast("string").alias("value"), F.lit(page).alias("page"), F.lit("kutipan").alias("evidence_text"), F.lit(0.9).alias("evidence_score"), F.lit(0.8).alias("confidence"), F.lit(state).alias("status"))
    seen = F.array(found("Nomor Kontrak Kerja", said("K-", k), 1, "AUTO_VERIFIED"), found("Pihak Pertama.NPWP", k, 1, "AUTO_VERIFIED"), found("Total Harga Pekerjaan", c, 2, "UNSUPPORTED"), found("Syarat Lampiran Wajib BAST[2]", F.lit("Laporan"), 3, "AUTO_ACCEPTED"))
    issue = F.struct(F.lit("total").alias("rule"), F.lit("error").alias("severity"), F.array(F.lit("Total Harga Pekerjaan")).alias("fields"), F.lit("tidak sama").alias("message"))
    result = F.struct(F.lit("a.pdf").alias("document_name"), F.lit("contract").alias("document_type"), F.lit("teks").alias("markdown"), data.alias("data"), seen.alias("evidence"), F.struct(F.lit("fail").alias("status"), F.array(issue).alias("issues")).alias("validation"), F.struct(said("doc-", k).alias("document_id"), F.lit(3).alias("page_count"), F.struct(F.lit("good").alias("rata_rata")).alias("parse_quality")).alias("run_info"))
    raw = _orders(spark, d).join(items, "o_orderkey", "left").select(F.to_json(result).alias("json"))
    return parsed(raw, F.col("json"), records.result_schema(records.CONTRACT))


@query(
    """select 'doc-' || o_orderkey as _document_ref, 'K-' || o_orderkey as contract_number, 'Pengadaan ' || o_custkey as work_title, o_orderdate::date::varchar as contract_date, '2026-01-01' as start_date, o_orderdate::date::varchar as end_date, '1 Januari 2026 s/d ' || strftime(o_orderdate, '%d-%m-%Y') as duration_text, (o_custkey * 1000)::double as contract_value, '- Foto' || chr(10) || '- Laporan' as bast_terms from orders"""
)
def contract_records(spark: SparkSession, d: str) -> DataFrame:
    return records.contract_tables(_results(spark, d), OURS)["contract"].select("_document_ref", "contract_number", "work_title", "contract_date", "start_date", "end_date", "duration_text", "contract_value", "bast_terms")


@query(
    """select 'doc-' || l_orderkey as _contract_ref, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity)::int line_no, l_linenumber n, l_partkey p, l_quantity quantity, (l_suppkey * 1000)::double unit_price, case when l_returnflag = 'R' then 'otc' end charge_type from lineitem qualify l_linenumber % 4 <> 0""".replace(
        "select 'doc-'", "select _contract_ref, line_no, 'Barang ' || p as description, quantity, unit_price, charge_type from (select 'doc-'", 1
    ).replace(" qualify l_linenumber % 4 <> 0", ") where n % 4 <> 0")
)
def contract_item_records(spark: SparkSession, d: str) -> DataFrame:
    return records.contract_tables(_results(spark, d), OURS)["contract_item"].select("_contract_ref", "line_no", "description", "quantity", "unit_price", "charge_type")


@query(
    """select 'doc-' || o_orderkey as _contract_ref, case when o_orderkey % 3 = 0 then 'pelaksana' else 'pemberi_kerja' end as role, 'PIHAK PERTAMA' as party_label_text, case when o_orderkey % 3 = 0 then 'PT Kita Jaya' else 'PT Mitra ' || o_custkey end as org_name_text from orders
    union all select 'doc-' || o_orderkey, case when o_orderkey % 3 = 0 then 'pemberi_kerja' else 'pelaksana' end, 'PIHAK KEDUA', case when o_orderkey % 3 = 0 then 'CV Lain' else 'PT Kita Jaya' end from orders where o_orderkey % 3 <> 2"""
)
def contract_party_records(spark: SparkSession, d: str) -> DataFrame:
    return records.contract_tables(_results(spark, d), OURS)["contract_party"].select("_contract_ref", "role", "party_label_text", "org_name_text")


@query(
    """select 'doc-' || o_orderkey as _contract_ref, 1 as line_no, 'Termin 1' as term_label_text, (o_custkey * 100)::double as amount, null::varchar as percentage_text from orders where o_custkey > 0
    union all select 'doc-' || o_orderkey, 1, 'Termin 1', null, null from orders where o_custkey = 0 union all select 'doc-' || o_orderkey, 2, null, null, '30%' from orders"""
)
def payment_term_records(spark: SparkSession, d: str) -> DataFrame:
    return records.contract_tables(_results(spark, d), OURS)["contract_payment_term"].select("_contract_ref", "line_no", "term_label_text", "amount", "percentage_text")


@query(
    """select 'doc-' || o_orderkey as _contract_ref, 1 as line_no, 'Foto' as requirement_text, null::int as evidence_page from orders union all select 'doc-' || o_orderkey, 3, 'Laporan', null from orders where false union all select 'doc-' || o_orderkey, 3, 'Laporan', 3 from orders"""
)
def requirement_records(spark: SparkSession, d: str) -> DataFrame:
    return records.contract_tables(_results(spark, d), OURS)["contract_requirement"].select("_contract_ref", "line_no", "requirement_text", "evidence_page")


@query(
    """select 'doc-' || o_orderkey as _document_ref, 'Nomor Kontrak Kerja' as field_path, 'K-' || o_orderkey as ai_value_text, 'bukti_kuat' as system_status, null::varchar as status_reason from orders
    union all select 'doc-' || o_orderkey, 'Total Harga Pekerjaan', o_custkey::varchar, 'tidak_ada_di_dokumen', 'tidak sama' from orders union all select 'doc-' || o_orderkey, 'Syarat Lampiran Wajib BAST[2]', 'Laporan', 'bukti_cukup', null from orders"""
)
def field_records(spark: SparkSession, d: str) -> DataFrame:
    return records.extracted_fields(records.keyed(_results(spark, d))).select("_document_ref", "field_path", "ai_value_text", "system_status", "status_reason")


@query(
    """select 'doc-' || o_orderkey as content_hash, 'kontrak' as doc_type, 3 as page_count, 'baik' as parse_quality, '[error] tidak sama' || case when o_orderkey % 3 = 2 then chr(10) || '[warning] roles of the parties are uncertain (our company is neither party); the first party counts as the client, please check.' else '' end as validation_notes from orders"""
)
def document_records(spark: SparkSession, d: str) -> DataFrame:
    return records.contract_tables(_results(spark, d), OURS)["document"].select("content_hash", "doc_type", "page_count", "parse_quality", "validation_notes")


def _handovers(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    side = F.when(k % 3 == 0, "PIHAK PERTAMA menyerahkan kepada PIHAK KEDUA").when(k % 3 == 1, "PIHAK KEDUA menyerahkan kepada PIHAK PERTAMA").otherwise("tanpa kalimat")
    text = said("Berdasarkan Nota Pesanan, ", side, " progress pekerjaan ", k % 100, "% senilai (", numbers.spell(c * 1000 + 1000000), " rupiah) belum termasuk PPN")
    party = lambda name: F.struct(name.alias("Nama Perusahaan"))
    data = F.struct(said("B-", k).alias("Nomor BAST"), F.lit("tanggal dua puluh dua bulan Juni tahun dua ribu dua puluh enam").alias("Tanggal Serah Terima"), F.array(F.lit("Surat Jalan"), F.lit(" ")).alias("Dokumen Pendukung"), party(F.lit("PT Kita Jaya")).alias("Pihak Pertama"), party(said("PT Mitra ", c)).alias("Pihak Kedua"))
    result = F.struct(F.lit("b.pdf").alias("document_name"), F.lit("bast").alias("document_type"), text.alias("markdown"), data.alias("data"), F.struct(said("doc-", k).alias("document_id")).alias("run_info"))
    return parsed(_orders(spark, d), F.to_json(result), records.result_schema(records.HANDOVER))


@query(
    """select 'doc-' || o_orderkey as _document_ref, case o_orderkey % 3 when 0 then 'customer' when 1 then 'vendor' else 'unknown' end as direction, 'B-' || o_orderkey as bast_number_customer, '2026-06-22' as handover_date, 'order_note' as basis_doc_type, 'excluded' as basis_doc_value_vat from orders"""
)
def handover_records(spark: SparkSession, d: str) -> DataFrame:
    return records.handover_tables(_handovers(spark, d), OURS)["bast"].select("_document_ref", "direction", "bast_number_customer", "handover_date", "basis_doc_type", "basis_doc_value_vat")


@query(
    """select 'doc-' || o_orderkey as _bast_ref, 'supporting_document' as condition_type, 'Surat Jalan' as value_text, null::double as value_number from orders union all select 'doc-' || o_orderkey, 'progress_percent', 'progress pekerjaan ' || (o_orderkey % 100) || '%', (o_orderkey % 100)::double from orders"""
)
def handover_conditions(spark: SparkSession, d: str) -> DataFrame:
    found = records.handover_tables(_handovers(spark, d), OURS)["bast_condition"]
    return found.filter("condition_type <> 'amount_in_words'").select("_bast_ref", "condition_type", "value_text", "value_number")


@query(
    """select 'doc-' || l_orderkey as _sph_ref, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity)::int line_no, 'Barang ' || l_partkey as description, 'M' || l_suppkey as brand, l_quantity::double as quantity, (l_suppkey * 500)::double as line_total from lineitem"""
)
def offer_item_records(spark: SparkSession, d: str) -> DataFrame:
    row = F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_quantity").alias("q"), said("Barang ", F.col("l_partkey")).alias("Nama Barang/Jasa"), said("M", F.col("l_suppkey")).alias("Brand/Merek"), F.col("l_quantity").cast("string").alias("Volume / Qty"), grouped(F.col("l_suppkey") * 500).alias("Total Harga"))
    items = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    result = F.struct(F.lit("c.pdf").alias("document_name"), F.lit("sph").alias("document_type"), F.struct(F.col("rows").alias("Daftar Penawaran Harga")).alias("data"), F.struct(said("doc-", F.col("l_orderkey")).alias("document_id")).alias("run_info"))
    offers = parsed(items, F.to_json(result), records.result_schema(records.OFFER))
    return records.offer_tables(offers)["sph_item"].select("_sph_ref", "line_no", "description", "brand", "quantity", "line_total")


# Validation and reconciliation


@query(
    """with i as (select l_orderkey k, sum(l_extendedprice) s from lineitem group by 1), h as (select o_orderkey k, o_custkey c, o_totalprice t, coalesce(s, 0) s from orders left join i on k = o_orderkey),
    x as (select k, 'required_fields:number' rule, 'warning' severity from h where k % 7 = 0 union all select k, 'parties_distinct', 'error' from h where k % 5 = 0 union all select k, 'date_range_order', 'error' from h where k % 4 = 0
      union all select k, 'total_equals_subtotal_plus_vat', 'error' from h where t <> 0 and abs(t * 2 - t) > 1000 and k % 3 = 0 union all select k, 'total_not_below_subtotal', 'error' from h where k % 3 = 0 and t > 0)
    select k o_orderkey, rule, severity from x"""
)
def contract_rules(spark: SparkSession, d: str) -> DataFrame:
    """All rules of a contract together; the items' own rules are registered apart."""
    k, t = F.col("o_orderkey"), F.col("o_totalprice")
    h = _orders(spark, d).select(
        "o_orderkey", F.when(k % 7 == 0, " ").otherwise("K-1").alias("number"), F.lit("judul").alias("title"), F.lit("PT Satu").alias("first_name"), F.when(k % 5 == 0, "pt satu ").otherwise("PT Dua").alias("second_name"), F.lit("a").alias("first_address"), F.lit("b").alias("second_address"),
        F.when(k % 3 == 0, t * 2).alias("subtotal"), F.lit(None).cast("double").alias("vat"), t.alias("total"), F.lit(None).cast("string").alias("rate_text"), F.lit(None).cast("string").alias("words_text"), F.when(k % 4 == 0, "2 Mei 2026 s/d 1 Mei 2026").otherwise("1 Mei 2026 s/d 2 Mei 2026").alias("term"),
    )
    items = _t(spark, d, "lineitem").limit(0).select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("unit_price"), F.col("l_extendedprice").alias("line_total"))
    return validation.contract_issues(h, items, "o_orderkey").select("o_orderkey", "rule", "severity")


@query("select o_orderkey, 'table on page ' || case when o_orderkey % 2 = 0 then '1, 2' else '1' end || ': only its header was read (No | Uraian | Harga); please check it in the file' as message from orders where o_orderkey % 3 <> 0")
def empty_tables(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    head = "| No | Uraian | Harga |\n|---|---|---|\n"
    text = said("a\n", head, F.when(k % 3 == 0, "| 1 | x | 2 |\n").otherwise("|  |  |  |\n"), "b\n<!-- PAGE BREAK -->\n", F.when((k % 2 == 0) & (k % 3 != 0), head + "\n").otherwise(""), "| Nama | Tanda tangan |\n|---|---|\n")
    return validation.empty_table_notes(_orders(spark, d).select("o_orderkey", text.alias("text")), "o_orderkey", "text").select("o_orderkey", "message")


@query("select o_orderkey, case when o_orderkey % 2 = 0 then (o_custkey * 12000)::double else (o_custkey * 1000 + 7)::double end as subtotal from orders where o_custkey > 0")
def corrected_subtotals(spark: SparkSession, d: str) -> DataFrame:
    c, even = F.col("o_custkey"), F.col("o_orderkey") % 2 == 0
    text = said("| Uraian | Harga Bulanan | Jumlah Harga |\n|---|---|---|\n| a | 1 | 2 |\n| Subtotal (Sebelum PPN) | ", grouped(c * 1000), " | ", grouped(c * 12000), " |\n")
    df = _orders(spark, d).filter("o_custkey > 0").select("o_orderkey", F.when(even, c * 1000).otherwise(c * 1000 + 7).cast("double").alias("subtotal"), F.array((c * 5000).cast("double"), (c * 7000).cast("double")).alias("totals"), text.alias("text"))
    return reconcile.corrected_subtotals(df, "o_orderkey", "subtotal", "totals", "text").select("o_orderkey", "subtotal")


@query("select o_orderkey, b.page::int page, b.ordinal::int ordinal, b.type as type, b.text as text from orders, lateral (select unnest([{'page': 1, 'ordinal': 0, 'type': 'section_header', 'text': 'Judul ' || o_orderkey}, {'page': 2, 'ordinal': 1, 'type': 'paragraph', 'text': 'isi'}]) b)")
def parsed_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of a parsed response: one with its text, one read from its range of the Markdown, one empty."""
    k = F.col("o_orderkey")
    head = said("Judul ", k)
    json = said(
        '{"document_id":"', k, '","file_name":"x/a.pdf","markdown":"', head, '\\nisi","structure":{"children":[{"grounding":{"page":1},"children":[{"type":"heading","text":" ', head, ' ","grounding":{"box":{"xmin":0.5,"ymin":0.1,"xmax":0.1,"ymax":0.2}}},{"type":"text","text":" "}]},',
        '{"children":[{"type":"text","grounding":{"range":{"start":', F.length(head) + 1, ',"end":', F.length(head) + 4, "}}}]}]}}",
    )
    responses = parsed(_orders(spark, d), json, f"document_id string, file_name string, {readers.PARSED}")
    return readers.parsed_blocks(responses).select(F.col("document_id").cast("long").alias("o_orderkey"), "page", "ordinal", "type", "text")


@query(
    """select o_orderkey, b.n::int ordinal, b.t as type, b.x as text from orders, lateral (select unnest([
      {'n': 0, 't': 'section_header', 'x': 'SURAT PERINTAH KERJA'}, {'n': 1, 't': 'key_value', 'x': 'Nomor : 687/' || o_orderkey}, {'n': 2, 't': 'paragraph', 'x': 'kalimat yang terpotong di dua region.'},
      {'n': 3, 't': 'key_value', 'x': 'Alamat : Kampus Utama, Jl. Merdeka ' || o_custkey}, {'n': 4, 't': 'list_item', 'x': 'a. satu sambungan'}, {'n': 5, 't': 'list_item', 'x': 'b. dua'}, {'n': 6, 't': 'paragraph', 'x': 'Garansi terlampir dalam SLA'}, {'n': 7, 't': 'footer', 'x': 'hal ' || o_custkey}]) b)"""
)
def region_blocks(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    parts = (
        ("header", "SURAT PERINTAH KERJA", 0.05), ("text", said("Nomor : 687/", k), 0.2), ("text", "kalimat yang terpotong", 0.25), ("text", "di dua region.", 0.27), ("text", said("Alamat Kampus Utama\nJl. Merdeka ", c), 0.3),
        ("list", "a. satu\nsambungan\nb. dua", 0.4), ("list", "b. dua", 0.41), ("title", "Garansi terlampir dalam SLA", 0.5), ("footer", said("hal ", c), 0.9), ("text", " ", 0.95),
    )
    made = _rows(*[{"ordinal": i, "type": kind, "text": t, "html": "", "y0": y, "y1": y + 0.02} for i, (kind, t, y) in enumerate(parts)])
    return regions.region_blocks(_orders(spark, d).select("o_orderkey", made.alias("r")).select("o_orderkey", "r.*"), ["o_orderkey"])


@query(
    """with g as (select o_orderkey // 10 as doc, 'f' || (o_orderkey % 10) || case when o_orderkey % 10 < 3 then ' Lokasi' else '' end f, o_orderkey k from orders), d as (select doc, count(*) n, count(*) filter (k % 10 < 4) less from g group by 1),
    ok as (select doc from d where doc % 7 <> 0 and doc % 5 <> 0 and (doc % 3 <> 0 or less * 2 >= n)), r as (select g.* from g join ok using (doc))
    select 'first' as system, case when k % 10 < 3 then 'convention' else 'intrinsic' end as kind, count(*) filter (k % 2 = 0) as "right", count(*) fields from r group by 2
    union all select 'second', case when k % 10 < 3 then 'convention' else 'intrinsic' end, count(*) filter (doc % 3 <> 0 or k % 10 < 4), count(*) from r group by 2"""
)
def system_comparison(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    g = _orders(spark, d).select(k, F.floor(k / 10).alias("doc"), said("f", k % 10, F.when(k % 10 < 3, " Lokasi").otherwise("")).alias("field"))
    value = said("nilai ", k)
    golden = g.select("doc", "field", value.alias("expected"), F.lit(False).alias("critical"), (F.col("doc") % 7 == 0).alias("uncorrected"))
    first = g.select("doc", "field", F.when(k % 2 == 0, value).otherwise("salah").alias("predicted"), F.lit("AUTO_ACCEPTED").alias("status"))
    second = g.filter("doc % 5 <> 0 and (doc % 3 <> 0 or o_orderkey % 10 < 4)").select("doc", "field", value.alias("predicted"), F.lit("AUTO_ACCEPTED").alias("status"))
    return evaluation.compare_systems(golden, {"first": first, "second": second}, "doc")[0]
