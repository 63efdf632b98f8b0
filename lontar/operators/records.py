"""Extraction results as relational rows: documents, contracts, offers, hand-overs, their parties, items, terms and fields.

A result is one row (see RESULT): the extracted data as a struct, the evidence of its fields, the issues of its validation
and the run's figures. Mappers give a table's name and its DataFrame; raw texts are kept beside parsed values, a value that
can't be read is null, and nothing is computed. Lists are exploded with their reading order as line_no.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lontar.functions.dates import parse_date_by_priority
from lontar.functions.numbers import parse_number
from lontar.functions.predicates import is_our_company, stored
from lontar.functions.text import text_or_null
from lontar.operators.contracts import handing_over, payment_term, period

# States of evidence and of reading quality, charge types, document kinds and what the target tables hold.
STATES = {"AUTO_VERIFIED": "bukti_kuat", "AUTO_ACCEPTED": "bukti_cukup", "REVIEW_REQUIRED": "perlu_dicek", "UNSUPPORTED": "tidak_ada_di_dokumen", "CONFLICT": "bertentangan", "MISSING": "kosong"}
QUALITY = {"poor": "buruk", "fair": "cukup", "good": "baik", "excellent": "sangat_baik"}
CHARGES = {"OTC": "otc", "MRC": "mrc", "OTC dan MRC": "otc_dan_mrc"}
SUPPORTED, DEFERRED = ("contract", "sph"), ("bast",)
BASIS = ((r"nota\s+pesanan", "order_note"), (r"surat\s+pesanan|inaproc", "order_note"), (r"\bpks\b|perjanjian\s+kerja", "pks"), (r"surat\s+perintah\s+kerja|\bspk\b", "spk"), (r"purchase\s+order|\bpo\b\s*/", "purchase_order"), ("kontrak", "contract"))
HEAD_CHARS = 4000

PARTY = "struct<`Nama Perusahaan`:string,`Nama Representative`:string,Jabatan:string,Alamat:string>"
ITEM = "struct<`Kategori/Kelompok`:string,`Deskripsi Item/Barang/Pekerjaan`:string,Deskripsi:string,Spesifikasi:string,volume:string,unit:string,`Periode/Durasi`:string,`Harga Satuan`:string,`Jumlah Harga`:string,`Jenis Biaya`:string,Keterangan:string>"
CONTRACT = (
    "struct<`Nomor Kontrak Kerja`:string,`Nomor Kontrak Internal`:string,`Nama Pekerjaan`:string,Lokasi:string,`Tanggal Pembuatan Dokumen`:string,`Jangka Waktu`:string,`Durasi Kerja`:string,`Total Harga Pekerjaan`:string,"
    "`sub total`:string,`Total PPN`:string,`persentase ppn`:string,`Mekanisme Skema Pembayaran`:string,`Persentase Sanksi/Penalti`:string,`Nama Bank`:string,`Nomor Rekening Bank`:string,`Nama Rekening Bank`:string,"
    f"`Syarat Lampiran Wajib BAST`:array<string>,`Ketentuan Pembayaran`:array<string>,`Pihak Pertama`:{PARTY},`Pihak Kedua`:{PARTY},`List Item/Barang`:array<{ITEM}>>"
)
OFFER_ITEM = "struct<`Kategori/Kelompok`:string,`Nama Barang/Jasa`:string,Spesifikasi:string,`Brand/Merek`:string,`Part Number`:string,`Volume / Qty`:string,Satuan:string,`Periode/Durasi`:string,`Harga Satuan`:string,`Total Harga`:string,`Jenis Biaya`:string,Keterangan:string>"
OFFER = f"struct<`Nomor SPH`:string,`Tanggal SPH`:string,`Perihal / Nama Pekerjaan`:string,`Tujuan Surat / Klien`:string,Vendor:struct<`Nama Vendor`:string>,Subtotal:string,`Persentase PPN`:string,`Nilai PPN`:string,`Grand Total`:string,`Masa Berlaku Penawaran`:string,`Mekanisme Skema Pembayaran`:string,`Daftar Penawaran Harga`:array<{OFFER_ITEM}>>"
HANDOVER_ITEM = "struct<Deskripsi:string,Volume:string,Satuan:string,`Hasil Uji Terima`:string,Keterangan:string>"
HANDOVER = (
    "struct<`Nomor BAST`:string,`Tanggal Serah Terima`:string,`Nama Pekerjaan`:string,`Nomor PO / Kontrak`:string,`Tanggal PO / Kontrak`:string,`Nilai Pengadaan`:string,`Pernyataan Penerimaan`:string,`Hasil Uji Terima Keseluruhan`:string,"
    f"`Tanggal Aktivasi Layanan`:string,`Tanggal Uji Terima`:string,`Dokumen Pendukung`:array<string>,`Pihak Pertama`:{PARTY},`Pihak Kedua`:{PARTY},`Daftar Barang/Pekerjaan Diserahkan`:array<{HANDOVER_ITEM}>>"
)
EVIDENCE = "array<struct<field:string,value:string,page:int,evidence_text:string,evidence_score:double,confidence:double,status:string>>"
ISSUES = "struct<status:string,issues:array<struct<rule:string,severity:string,fields:array<string>,message:string>>>"
RUN = "struct<document_id:string,page_count:int,parser_engine:string,model:string,prompt_version:string,llm_calls:int,timestamp:string,timings:struct<parse_s:double,extract_s:double>,parse_quality:struct<rata_rata:string>>"


def result_schema(data: str) -> str:
    """The DDL of results whose data is one of CONTRACT, OFFER and HANDOVER."""
    return f"document_name string, document_type string, markdown string, data {data}, evidence {EVIDENCE}, validation {ISSUES}, run_info {RUN}"


def _named(table: dict[str, str], value: Column, other: str | None = None) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))]), value), F.lit(other).cast("string"))


def _date(text: Column) -> Column:
    return parse_date_by_priority(text).cast("string")


def keyed(results: DataFrame) -> DataFrame:
    """results with ``doc``, the key from the file's bytes; rows without one stop the job, since a made-up key would double rows."""
    known = F.col("run_info.document_id")
    return results.withColumn("doc", F.when(known.isNotNull() & (known != ""), known).otherwise(F.raise_error(F.concat(F.coalesce("document_name", F.lit("?")), F.lit(": no document_id in run_info")))))


def payload_note(document_type: Column) -> Column:
    """Why a kind of document gives no payload; null for those that do."""
    kind = F.lower(F.coalesce(document_type, F.lit("")))
    return F.when(kind.isin(*SUPPORTED), None).when(kind.isin(*DEFERRED), "tables of hand-over documents are a proposal; the result stays in its file").otherwise(F.concat(F.lit("no mapper for documents of kind '"), kind, F.lit("'")))


def documents(results: DataFrame, kind: str, notes: Column | None = None) -> DataFrame:
    """The document row of every keyed result; validation messages line by line, then further notes."""
    said = F.filter(F.coalesce("validation.issues", F.from_json(F.lit("[]"), "array<struct<rule:string,severity:string,fields:array<string>,message:string>>")), lambda i: F.coalesce(i["message"], F.lit("")) != "")
    lines = F.transform(said, lambda i: F.concat(F.lit("["), F.coalesce(i["severity"], F.lit("None")), F.lit("] "), i["message"]))
    every = F.filter(F.concat(lines, F.array(notes if notes is not None else F.lit(None).cast("string"))), lambda x: x.isNotNull())
    return results.select(
        F.col("doc").alias("content_hash"), F.lit(kind).alias("doc_type"), F.coalesce(F.nullif("document_name", F.lit("")), F.lit("(tanpa nama)")).alias("source_filename"), F.nullif("run_info.page_count", F.lit(0)).alias("page_count"), F.nullif("markdown", F.lit("")).alias("markdown"),
        F.nullif(F.array_join(every, "\n"), F.lit("")).alias("validation_notes"), _named(QUALITY, F.lower("run_info.parse_quality.rata_rata")).alias("parse_quality"),
    )


def reasons(results: DataFrame) -> DataFrame:
    """doc, field_path and the distinct messages that name it, line by line in their order."""
    each = results.select("doc", F.posexplode("validation.issues").alias("n", "i")).filter("coalesce(i.message, '') <> ''").select("doc", "n", "i.message", F.explode("i.fields").alias("field_path"))
    listed = F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("n", "message"))), lambda x: x["message"]))
    return each.groupBy("doc", "field_path").agg(F.array_join(listed, "\n").alias("status_reason"))


def extracted_fields(results: DataFrame) -> DataFrame:
    """A row for each field with evidence that may be kept."""
    e = results.select("doc", F.explode("evidence").alias("e")).filter("coalesce(e.field, '') <> ''").filter(stored(F.col("e.field")))
    rows = e.select(
        "doc", F.col("e.field").alias("field_path"), text_or_null(F.col("e.value")).alias("ai_value_text"), F.col("e.page").alias("evidence_page"), text_or_null(F.col("e.evidence_text")).alias("evidence_quote"), "e.evidence_score", "e.confidence",
        _named(STATES, F.upper(F.coalesce("e.status", F.lit("MISSING"))), "perlu_dicek").alias("system_status"),
    )
    return rows.join(reasons(results), ["doc", "field_path"], "left").withColumnRenamed("doc", "_document_ref")


def runs(results: DataFrame, version: str) -> DataFrame:
    r = "run_info."
    return results.select(F.col("doc").alias("_document_ref"), F.col(r + "parser_engine").alias("ocr_engine"), F.col(r + "model").alias("llm_model"), F.col(r + "prompt_version").alias("prompt_version"), F.lit(version).alias("schema_version"), F.col(r + "llm_calls").alias("llm_call_count"), F.col(r + "timings.parse_s").alias("parse_seconds"), F.col(r + "timings.extract_s").alias("extract_seconds"), F.col("validation.status").alias("validation_status"), F.col(r + "timestamp").alias("started_at"))


def _texts(names: dict[str, str], path: str = "data") -> list[Column]:
    return [text_or_null(F.col(f"{path}.`{source}`")).alias(name) for name, source in names.items()]


def _numbers(names: dict[str, str], path: str = "data") -> list[Column]:
    return [parse_number(F.col(f"{path}.`{source}`")).alias(name) for name, source in names.items()]


def _lines(results: DataFrame, path: str) -> DataFrame:
    """doc, line_no and entry of a list of texts, blanks left out but counted, with the evidence of that list's place."""
    name = path.split(".")[-1].strip("`")
    each = results.select("doc", F.posexplode(F.col(path)).alias("i", "raw"), "evidence").withColumn("entry", text_or_null(F.col("raw"))).filter("entry is not null")
    own = F.get(F.filter("evidence", lambda e: e["field"] == F.concat(F.lit(name + "["), F.col("i").cast("string"), F.lit("]"))), F.lit(0))
    return each.withColumn("own", own).select("doc", (F.col("i") + 1).alias("line_no"), "entry", F.col("own.page").alias("evidence_page"), text_or_null(F.col("own.evidence_text")).alias("evidence_quote"))


def _parties(results: DataFrame, ref: str, roles: tuple[Column, Column], labels: bool) -> DataFrame:
    """Both parties with a company's name, each with its role."""
    out = None
    for side, role in zip(("Pihak Pertama", "Pihak Kedua"), roles, strict=True):
        names = {"org_name_text": "Nama Perusahaan", "signer_name": "Nama Representative", "signer_title": "Jabatan", "org_address_text": "Alamat"}
        rows = results.select(F.col("doc").alias(ref), role.alias("role"), *([F.lit(side.upper()).alias("party_label_text")] if labels else []), *_texts(names, f"data.`{side}`")).filter("org_name_text is not null")
        out = rows if out is None else out.unionByName(rows)
    return out


def _roles(ours: tuple[str, ...]) -> tuple[Column, Column, Column]:
    """Both parties' roles, and a note where they aren't certain: our company performs, by its name and not by its place."""
    first, second = (is_our_company(text_or_null(F.col(f"data.`{side}`.`Nama Perusahaan`")), ours) for side in ("Pihak Pertama", "Pihak Kedua"))
    swapped = first & ~second
    why = F.when(first & second, "both parties look like our company").otherwise("our company is neither party")
    note = F.when(first == second, F.concat(F.lit("[warning] roles of the parties are uncertain ("), why, F.lit("); the first party counts as the client, please check.")))
    return F.when(swapped, "pelaksana").otherwise("pemberi_kerja"), F.when(swapped, "pemberi_kerja").otherwise("pelaksana"), note


def _common(results: DataFrame, kind: str, version: str, notes: Column | None = None) -> dict[str, DataFrame]:
    return {"document": documents(results, kind, notes), "extracted_field": extracted_fields(results), "extraction_run": runs(results, version)}


def contract_tables(results: DataFrame, ours: tuple[str, ...], version: str = "1") -> dict[str, DataFrame]:
    """Tables of contracts: document, contract, parties, items, requirements, payment terms, fields and runs."""
    r = keyed(results)
    data = lambda name: text_or_null(F.col(f"data.`{name}`"))
    span = period(data("Jangka Waktu"))
    attachments = F.filter(F.transform("data.`Syarat Lampiran Wajib BAST`", lambda x: text_or_null(x)), lambda x: x.isNotNull())
    first, second, note = _roles(ours)
    contract = r.select(
        F.col("doc").alias("_document_ref"), *_texts({"contract_number": "Nomor Kontrak Kerja", "contract_number_internal": "Nomor Kontrak Internal", "work_title": "Nama Pekerjaan", "location_text": "Lokasi", "contract_date_text": "Tanggal Pembuatan Dokumen"}),
        _date(data("Tanggal Pembuatan Dokumen")).alias("contract_date"), span["starts"].alias("start_date_text"), _date(span["starts"]).alias("start_date"), span["ends"].alias("end_date_text"), _date(span["ends"]).alias("end_date"),
        F.coalesce(data("Durasi Kerja"), data("Jangka Waktu")).alias("duration_text"), *_numbers({"contract_value": "Total Harga Pekerjaan", "subtotal_value": "sub total", "vat_value": "Total PPN"}), data("persentase ppn").alias("vat_percentage"), F.lit("IDR").alias("currency"),
        *_texts({"payment_mechanism": "Mekanisme Skema Pembayaran", "penalty_terms": "Persentase Sanksi/Penalti"}), F.nullif(F.array_join(F.transform(attachments, lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit("")).alias("bast_terms"),
        *_texts({"bank_name": "Nama Bank", "bank_account_number": "Nomor Rekening Bank", "bank_account_name": "Nama Rekening Bank"}),
    )
    rows = r.select("doc", F.posexplode("data.`List Item/Barang`").alias("i", "row")).withColumn("description", F.coalesce(text_or_null(F.col("row.`Deskripsi Item/Barang/Pekerjaan`")), text_or_null(F.col("row.Deskripsi")))).filter("description is not null")
    items = rows.select(
        F.col("doc").alias("_contract_ref"), (F.col("i") + 1).alias("line_no"), *_texts({"category": "Kategori/Kelompok"}, "row"), "description", *_texts({"specification": "Spesifikasi"}, "row"), *_numbers({"quantity": "volume"}, "row"), *_texts({"unit": "unit", "period": "Periode/Durasi"}, "row"),
        *_numbers({"unit_price": "Harga Satuan", "line_total": "Jumlah Harga"}, "row"), _named(CHARGES, text_or_null(F.col("row.`Jenis Biaya`"))).alias("charge_type"), *_texts({"remarks": "Keterangan"}, "row"),
    )
    needs, terms = _lines(r, "data.`Syarat Lampiran Wajib BAST`"), _lines(r, "data.`Ketentuan Pembayaran`")
    term = payment_term(F.col("entry"))
    return _common(r, "kontrak", version, note) | {
        "contract": contract,
        "contract_party": _parties(r, "_contract_ref", (first, second), True),
        "contract_item": items,
        "contract_requirement": needs.select(F.col("doc").alias("_contract_ref"), "line_no", F.lit("lampiran_wajib").alias("requirement_type"), F.col("entry").alias("requirement_text"), "evidence_page", "evidence_quote"),
        "contract_payment_term": terms.select(F.col("doc").alias("_contract_ref"), "line_no", F.col("entry").alias("term_text"), term["label"].alias("term_label_text"), term["amount"].alias("amount"), term["percentage"].alias("percentage_text"), "evidence_page", "evidence_quote"),
    }


def offer_tables(results: DataFrame, version: str = "1") -> dict[str, DataFrame]:
    """Tables of offers: the vendor is who offers, the client who is addressed."""
    r = keyed(results)
    dated = text_or_null(F.col("data.`Tanggal SPH`"))
    offer = r.select(
        F.col("doc").alias("_document_ref"), *_texts({"sph_number": "Nomor SPH", "sph_date_text": "Tanggal SPH"}), _date(dated).alias("sph_date"), *_texts({"project_name": "Perihal / Nama Pekerjaan", "client_name": "Tujuan Surat / Klien"}), *_texts({"vendor_name": "Nama Vendor"}, "data.Vendor"),
        *_numbers({"subtotal_value": "Subtotal"}), *_texts({"vat_percentage": "Persentase PPN"}), *_numbers({"vat_value": "Nilai PPN", "total_price": "Grand Total"}), *_texts({"validity_text": "Masa Berlaku Penawaran", "payment_mechanism": "Mekanisme Skema Pembayaran"}), F.lit("IDR").alias("currency"),
    )
    rows = r.select("doc", F.posexplode("data.`Daftar Penawaran Harga`").alias("i", "row")).withColumn("description", text_or_null(F.col("row.`Nama Barang/Jasa`"))).filter("description is not null")
    items = rows.select(
        F.col("doc").alias("_sph_ref"), (F.col("i") + 1).alias("line_no"), *_texts({"category": "Kategori/Kelompok"}, "row"), "description", *_texts({"specification": "Spesifikasi", "brand": "Brand/Merek", "part_number": "Part Number"}, "row"), *_numbers({"quantity": "Volume / Qty"}, "row"),
        *_texts({"unit": "Satuan", "period": "Periode/Durasi"}, "row"), *_numbers({"unit_price": "Harga Satuan", "line_total": "Total Harga"}, "row"), _named(CHARGES, text_or_null(F.col("row.`Jenis Biaya`"))).alias("charge_type"), *_texts({"remarks": "Keterangan"}, "row"),
    )
    return _common(r, "sph", version) | {"sph": offer, "sph_item": items}


def basis_type(number: Column, text: Column) -> Column:
    """What kind of document a hand-over rests on, by its number and the text's first characters."""
    hay = F.lower(F.concat_ws(" ", F.coalesce(number, F.lit("")), F.substring(text, 1, HEAD_CHARS)))
    return F.coalesce(*[F.when(hay.rlike(pattern), value) for pattern, value in BASIS])


def vat_mode(text: Column) -> Column:
    """Whether the basis' value excludes or includes VAT, as the text's first characters say."""
    head = F.lower(F.substring(text, 1, HEAD_CHARS))
    return F.when(head.rlike(r"belum\s+termasuk\s+ppn"), "excluded").when(head.rlike(r"(sudah|termasuk)\s+(termasuk\s+)?ppn|sesudah\s+ppn"), "included").otherwise("unstated")


def handover_roles(first: Column, second: Column, text: Column, ours: tuple[str, ...]) -> Column:
    """A struct (first_role, second_role, direction): roles from the sentence that says who hands over, the direction from our company's role."""
    side = handing_over(text)
    one = F.when(side == "second", "receiver").otherwise("handover")
    two = F.when(side == "second", "handover").otherwise("receiver")
    mine = F.when(is_our_company(first, ours), one).when(is_our_company(second, ours), two)
    direction = F.when(side.isNull() | mine.isNull(), "unknown").when(mine == "handover", "customer").otherwise("vendor")
    return F.struct(one.alias("first_role"), two.alias("second_role"), direction.alias("direction"))


def handover_tables(results: DataFrame, ours: tuple[str, ...], version: str = "1") -> dict[str, DataFrame]:
    """Tables of hand-overs, a proposal: see ``payload_note``. Reviews are never written here; they belong to people."""
    r = keyed(results).withColumn("markdown", F.coalesce("markdown", F.lit("")))
    data = lambda name: text_or_null(F.col(f"data.`{name}`"))
    names = [text_or_null(F.col(f"data.`{side}`.`Nama Perusahaan`")) for side in ("Pihak Pertama", "Pihak Kedua")]
    r = r.withColumn("roles", handover_roles(*names, F.col("markdown"), ours))
    number, dated = data("Nomor PO / Kontrak"), data("Tanggal PO / Kontrak")
    bast = r.select(
        F.col("doc").alias("_document_ref"), "roles.direction", *_texts({"bast_number_customer": "Nomor BAST", "handover_date_text": "Tanggal Serah Terima"}), _date(data("Tanggal Serah Terima")).alias("handover_date"), *_texts({"work_title": "Nama Pekerjaan"}), basis_type(number, F.col("markdown")).alias("basis_doc_type"),
        number.alias("basis_doc_number"), dated.alias("basis_doc_date_text"), _date(dated).alias("basis_doc_date"), *_numbers({"basis_doc_value": "Nilai Pengadaan"}), vat_mode(F.col("markdown")).alias("basis_doc_value_vat"), F.lit("IDR").alias("currency"),
        F.coalesce(data("Pernyataan Penerimaan"), data("Hasil Uji Terima Keseluruhan")).alias("acceptance_statement"),
    )
    rows = r.select("doc", F.posexplode("data.`Daftar Barang/Pekerjaan Diserahkan`").alias("i", "row")).withColumn("description", text_or_null(F.col("row.Deskripsi"))).filter("description is not null")
    items = rows.select(F.col("doc").alias("_bast_ref"), (F.col("i") + 1).alias("line_no"), "description", *_numbers({"quantity": "Volume"}, "row"), *_texts({"unit": "Satuan", "test_result": "Hasil Uji Terima", "remarks": "Keterangan"}, "row"))
    progress, worded = r"(?i)progress[^\n]{0,40}?(\d{1,3})\s*%", r"(?i)\(\s*([A-Za-z][A-Za-z\s]{10,200}?rupiah)\s*\)"
    found = lambda pattern, k: F.nullif(F.regexp_extract("markdown", pattern, k), F.lit(""))
    said = lambda kind, text, number=None, day=None: F.array(F.struct(F.lit(kind).alias("condition_type"), text.alias("value_text"), (F.lit(None) if number is None else number).cast("double").alias("value_number"), (F.lit(None) if day is None else day).cast("string").alias("value_date")))
    papers = F.transform(F.coalesce("data.`Dokumen Pendukung`", F.array().cast("array<string>")), lambda x: said("supporting_document", text_or_null(x))[0])
    active, tested = data("Tanggal Aktivasi Layanan"), data("Tanggal Uji Terima")
    every = F.concat(
        said("service_active_since", active, None, _date(active)), said("acceptance_test_ref", tested, None, _date(tested)), papers, said("progress_percent", F.trim(found(progress, 0)), found(progress, 1)), said("amount_in_words", F.trim(F.regexp_replace(found(worded, 1), r"\s+", " ")))
    )
    listed = r.select("doc", every.alias("every")).withColumn("every", F.transform("every", lambda c: c))  # else the optimizer loses doc
    conditions = listed.select("doc", F.posexplode("every").alias("i", "c")).filter("c.value_text is not null").select(F.col("doc").alias("_bast_ref"), "c.*")
    return _common(r, "bast", version) | {"bast": bast, "bast_party": _parties(r, "_bast_ref", (F.col("roles.first_role"), F.col("roles.second_role")), False), "bast_item": items, "bast_condition": conditions}
