"""All registered queries of the document engine, with the SQL that must give the same rows.

The driver's tables hold no procurement documents, so texts are rendered from their columns inside the queries: what an
operator reads back must equal the columns that the SQL takes directly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lontar.functions import dates, identifiers, numbers, predicates, text
from lontar.operators import blocks, classify, contracts, evaluation, evidence, layout, mapping, pages, reconcile, tables, validation
from lontar.plans.registry import FLAGSHIP, ORACLE_SQL, QUERIES, grouped, query, said
from lontar.plans.registry import table as _t
from lontar.sources import readers
from lontar.streaming import jobs

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]

# Business rules


def _order_headers(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders")
    none = F.lit(None)
    return o.select("o_orderkey", none.cast("double").alias("subtotal"), none.cast("double").alias("vat"), F.col("o_totalprice").alias("total"), none.cast("string").alias("rate_text"), none.cast("string").alias("words_text"))


def _order_items(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").alias("line_total"))


@query(
    """
    with s as (select l_orderkey k, sum(l_extendedprice) s from lineitem group by 1),
    i as (select o_orderkey, s, o_totalprice t from orders join s on k = o_orderkey
      where o_totalprice <> 0 and s <> 0 and not (abs(s - o_totalprice) <= 1000 or abs(s * 1.1 - o_totalprice) <= 1000 or abs(s * 1.11 - o_totalprice) <= 1000 or abs(s * 1.12 - o_totalprice) <= 1000))
    select o.o_orderkey, 0::bigint errors, (case when i.o_orderkey is null then 0 else 1 end)::bigint issues, case when i.o_orderkey is null then 'pass' else 'warn' end status
    from orders o left join i using (o_orderkey)"""
)
def validation_report(spark: SparkSession, d: str) -> DataFrame:
    headers, items = _order_headers(spark, d), _order_items(spark, d)
    return validation.report(headers, validation.sum_issues(headers, items, "o_orderkey"), "o_orderkey")


@query(
    """select l_orderkey, l_linenumber, 'item_line_total' rule, 'warning' severity, round(l_quantity * p_retailprice, 2) expected, l_extendedprice actual
    from lineitem join part on p_partkey = l_partkey where l_quantity <> 0 and p_retailprice <> 0 and abs(l_extendedprice - l_quantity * p_retailprice) > 1000"""
)
def item_line_total(spark: SparkSession, d: str) -> DataFrame:
    li, p = _t(spark, d, "lineitem"), _t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_retailprice").alias("unit_price"))
    items = li.join(p, "l_partkey").select(F.struct("l_orderkey", "l_linenumber").alias("k"), F.col("l_quantity").alias("quantity"), "unit_price", F.lit(None).cast("double").alias("period_factor"), F.col("l_extendedprice").alias("line_total"))
    return validation.line_issues(items, "k").select("k.l_orderkey", "k.l_linenumber", "rule", "severity", "expected", "actual")


@query(
    """with h as (select o_orderkey, o_totalprice s, case when o_orderkey % 3 = 0 then o_totalprice * 0.11 when o_orderkey % 3 = 1 then o_totalprice * 0.05 end v,
      case when o_orderkey % 5 = 0 then o_totalprice * 0.5 when o_orderkey % 3 = 0 then o_totalprice * 1.11 else o_totalprice end t from orders)
    select o_orderkey, 'total_equals_subtotal_plus_vat' rule, 'error' severity, floor(s + coalesce(v, 0)) expected, t actual from h where s <> 0 and t <> 0 and abs(s + coalesce(v, 0) - t) > 1000
    union all select o_orderkey, 'total_not_below_subtotal', 'error', floor(s), t from h where s <> 0 and t <> 0 and t < s
    union all select o_orderkey, 'vat_matches_rate', 'warning', floor(round(s * 0.11, 2)), v from h where s <> 0 and v <> 0 and abs(v - s * 0.11) > 1000 and abs(v - s * 0.11 * 11 / 12) > 1000"""
)
def total_rules(spark: SparkSession, d: str) -> DataFrame:
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    h = _t(spark, d, "orders").select(
        "o_orderkey", p.alias("subtotal"), F.when(k % 3 == 0, p * 0.11).when(k % 3 == 1, p * 0.05).alias("vat"), F.when(k % 5 == 0, p * 0.5).when(k % 3 == 0, p * 1.11).otherwise(p).alias("total"), F.lit("PPN 11%").alias("rate_text")
    )
    return validation.total_issues(h, "o_orderkey").drop("fields").withColumn("expected", F.floor("expected").cast("double"))


@query("select o_orderkey, 'words_match_amount' rule, 'error' severity, (o_custkey * 1000)::double expected, (o_custkey * 1000 + 5000)::double actual from orders where o_orderkey % 4 = 0 and o_custkey > 0")
def words_rule(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("o_custkey") * 1000
    h = _t(spark, d, "orders").select("o_orderkey", F.lit(None).cast("double").alias("subtotal"), n.cast("double").alias("total"), F.concat(numbers.spell(F.when(F.col("o_orderkey") % 4 == 0, n + 5000).otherwise(n)), F.lit(" rupiah")).alias("words_text"))
    return validation.words_issues(h, "o_orderkey").drop("fields")


@query(
    """select c_custkey, 'required_fields:' || f rule, 'warning' severity, null::double expected, null::double actual from (
    select c_custkey, 'segment' f from customer where c_mktsegment = 'BUILDING' union all select c_custkey, 'name' f from customer where c_custkey % 10 = 0)"""
)
def required_rule(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer").select("c_custkey", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("segment"), F.when(F.col("c_custkey") % 10 == 0, " ").otherwise(F.col("c_name")).alias("name"))
    return validation.required_issues(c, "c_custkey", ["segment", "name"]).drop("fields")


@query(
    """select l_orderkey, l_linenumber, 'shipped_after_ordered' rule, 'error' severity, (l_shipdate::date - date '1970-01-01')::double actual, (o_orderdate::date - date '1970-01-01')::double expected
    from lineitem join orders on o_orderkey = l_orderkey where l_shipdate::date < o_orderdate::date"""
)
def date_order_rule(spark: SparkSession, d: str) -> DataFrame:
    li, o = _t(spark, d, "lineitem"), _t(spark, d, "orders")
    h = li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(F.struct("l_orderkey", "l_linenumber").alias("k"), F.col("o_orderdate").cast("date").alias("ordered"), F.col("l_shipdate").cast("date").alias("shipped"))
    return validation.date_order_issues(h, "k", "ordered", "shipped").select("k.l_orderkey", "k.l_linenumber", "rule", "severity", "expected", "actual")


# Numbers, words, dates, identifiers


@query("select o_orderkey, round(o_totalprice)::double full_form, round(o_totalprice)::double plain, round(o_totalprice)::double dashed, round(o_totalprice)::double english, null::double glued, -round(o_totalprice)::double negative from orders")
def number_round_trip(spark: SparkSession, d: str) -> DataFrame:
    n = F.round("o_totalprice")
    g = grouped(n)
    forms = {"full_form": F.concat(F.lit("Rp. "), g, F.lit(",00")), "plain": g, "dashed": F.concat(F.lit("IDR "), g, F.lit(",-")), "english": F.concat(F.translate(g, ".", ","), F.lit(".00")), "glued": F.concat(g, F.lit("50.000.000")), "negative": F.concat(F.lit("-"), g)}
    return _t(spark, d, "orders").select("o_orderkey", *[numbers.parse_number(x).alias(k) for k, x in forms.items()])


_NUMBERS = (("Rp. 166.500.000,-", 166500000.0), ("166.500.000,00", 166500000.0), ("1,5", 1.5), ("12.500", 12500.0), ("1,234,567.89", 1234567.89), ("150000000.0", 150000000.0), ("3.200.000.00", 3200000.0), ("7.350 000,00", 7350000.0), ("abc", None), ("", None), ("5.000.00050.000.000", None), ("-1.000", -1000.0))


@query("select * from (values " + ", ".join(f"('{a}', {'null::double' if b is None else repr(b)}::double)" for a, b in _NUMBERS) + ") t(raw, value)")
def number_vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = F.array(*[F.lit(a) for a, _ in _NUMBERS])
    return spark.range(1).select(F.explode(rows).alias("raw")).select("raw", numbers.parse_number(F.col("raw")).alias("value"))


@query("select o_orderkey, (o_orderkey * 104729 + o_custkey)::bigint n from orders")
def spelled_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "orders").select("o_orderkey", numbers.spelled_amount(F.concat(numbers.spell(F.col("o_orderkey") * 104729 + F.col("o_custkey")), F.lit(" rupiah"))).alias("n"))


@query("select o_orderkey, case when o_orderkey % 2 = 0 and o_custkey > 0 then [(o_custkey * 1000)::double] else []::double[] end amounts from orders")
def confirmed_amounts(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("o_custkey") * 1000
    words = numbers.spell(F.when(F.col("o_orderkey") % 2 == 0, n).otherwise(n + 7))
    t = F.concat(F.lit("Nilai Rp "), grouped(n), F.lit(",- ("), words, F.lit(" Rupiah) termasuk pajak"))
    return _t(spark, d, "orders").select("o_orderkey", numbers.confirmed_amounts(t).alias("amounts"))


@query("select o_orderkey, 'NPWP 01.234.567.8-901.000 senilai Rp ' || (round(o_totalprice)::bigint + 1000000) || ' lunas' as text from orders")
def money_in_text(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.lit("NPWP 01.234.567.8-901.000 senilai Rp "), grouped(F.round("o_totalprice") + 1000000), F.lit(",- lunas"))
    return _t(spark, d, "orders").select("o_orderkey", numbers.normalize_money(t).alias("text"))


@query("select o_orderkey, o_orderdate::date written, o_orderdate::date iso, o_orderdate::date numeric, null::date bad, 2::bigint found from orders")
def date_round_trip(spark: SparkSession, d: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    iso, dmy = F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "dd/MM/yyyy")
    return _t(spark, d, "orders").select(
        "o_orderkey",
        dates.parse_date(F.concat(F.lit("Jakarta, "), dates.write_date(day))).alias("written"),
        dates.parse_date(F.concat(F.lit("per "), iso)).alias("iso"),
        dates.parse_date_by_priority(F.concat(dmy, F.lit(" s/d"))).alias("numeric"),
        dates.parse_date(F.lit("31 Februari 2026 dan 2026-13-01")).alias("bad"),
        F.size(dates.find_dates(F.concat(dmy, F.lit(" sampai "), iso))).cast("long").alias("found"),
    )


@query("select o_orderkey, 'K.TEL.' || o_orderkey || '/HK.810/T1R-0D/' || o_custkey number, true as is_number, 'Nomor ' || o_orderkey || ' tahun 2026' kept, true as same, o_orderkey % 2 = 0 as other from orders")
def document_numbers(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    raw = F.concat(F.lit("K. TEL."), k, F.lit("/HK .810/T1R- 0D/"), c)
    clean = identifiers.normalize_document_number(raw)
    other = F.when(F.col("o_orderkey") % 2 == 0, F.translate(clean, "01", "OI")).otherwise(F.concat(clean, F.lit("7")))
    return _t(spark, d, "orders").select("o_orderkey", clean.alias("number"), identifiers.is_document_number(raw).alias("is_number"), identifiers.normalize_document_number(F.concat(F.lit("Nomor "), k, F.lit(" tahun 2026"))).alias("kept"), identifiers.same_identifier(raw, clean).alias("same"), identifiers.same_identifier(other, clean, True).alias("other"))


@query(
    """with w as (select s_suppkey, list_distinct(list_filter(string_split(trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')) ws from supplier)
    select a.s_suppkey, b.s_suppkey other, len(list_intersect(a.ws, b.ws)) / least(len(a.ws), len(b.ws)) >= 0.5 as same from w a join w b on b.s_suppkey = a.s_suppkey + 1"""
)
def company_names(spark: SparkSession, d: str) -> DataFrame:
    s = _t(spark, d, "supplier").select("s_suppkey", "s_name")
    o = s.select(F.col("s_suppkey").alias("other"), F.col("s_name").alias("other_name"))
    return s.join(o, F.col("other") == F.col("s_suppkey") + 1).select("s_suppkey", "other", identifiers.same_company(F.concat(F.lit("PT "), F.col("s_name"), F.lit(" Tbk")), F.col("other_name")).alias("same"))


# Text


@query(r"select doc_id, md5(trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '\bji\.', 'jl.', 'g'), '[^\p{L}\p{N}_/%]+', ' ', 'g'))) as canon from documents")
def canonical_text(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", F.md5(text.canon(F.col("text"))).alias("canon"))


@query(
    r"""with w as (select doc_id, list_distinct(list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}_/%]+', ' ', 'g')), ' '), lambda x: x <> '')) ws from documents),
    p as (select a.doc_id, len(list_intersect(a.ws, b.ws))::double c, len(a.ws) x, len(b.ws) y, a.ws aw, b.ws bw from w a join w b on b.doc_id = a.doc_id + 1)
    select doc_id, round(case when c = 0 then 0 else 2 * (c / x) * (c / y) / (c / x + c / y) end, 9) f1 from p"""
)
def token_overlap(spark: SparkSession, d: str) -> DataFrame:
    a = _t(spark, d, "documents").select("doc_id", F.array_distinct(text.words(text.canon(F.col("text")))).alias("w"))
    b = a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("other"))
    return a.join(b, "doc_id").select("doc_id", F.round(text.words_f1(F.col("w"), F.col("other")), 9).alias("f1"))


@query(
    """with t as (select doc_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '' and not regexp_matches(x, '[.\\d]')) ws from documents),
    u as (select doc_id, unnest(ws) w, generate_subscripts(ws, 1) i from t), f as (select *, regexp_matches(w, '^[a-z]{1,2}$') s from u),
    g as (select doc_id, s, i - row_number() over (partition by doc_id, s order by i) r from f), n as (select doc_id, count(*) n from g where s group by doc_id, r)
    select d.doc_id, coalesce(max(n), 0)::int run, coalesce(max(n), 0) >= 5 as corrupted from documents d left join n using (doc_id) group by 1"""
)
def corruption(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", text.longest_short_run(F.col("text")).alias("run"), text.is_corrupted(F.col("text")).alias("corrupted"))


@query()
def cleaned_text(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", text.clean_ocr(F.col("text")).alias("text"))


@query(
    """select o_orderkey, case o_orderkey % 4 when 0 then 'contract' when 1 then 'sph' when 2 then 'bast' else 'contract' end doc_type,
    (case o_orderkey % 4 when 0 then 0.98 when 1 then 0.98 when 2 then 0.98 else 0.7 end)::double confidence from orders"""
)
def document_types(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    title = F.when(k == 0, "Surat Perintah Kerja nomor ").when(k == 1, "SURAT PENAWARAN HARGA ").when(k == 2, "Berita acara serah terima ").otherwise("Catatan ")
    c = classify.classify(F.concat(title, F.col("o_orderkey").cast("string")))
    return _t(spark, d, "orders").select("o_orderkey", c["doc_type"].alias("doc_type"), c["confidence"].cast("double").alias("confidence"))


_VALUES = (("Tidak ada informasi", True, False, None), ("N/A", True, False, None), ("Rp 1.500.000,-", False, True, None), ("12.5", False, True, None), ("Biaya OTC dan MRC", False, False, "OTC dan MRC"), ("otc", False, False, "OTC"), ("Bulanan", False, False, "MRC"), ("", True, False, None))


@query("select * from (values " + ", ".join(f"('{a}', {b}, {c}, {'null::varchar' if d is None else repr(d)})" for a, b, c, d in _VALUES) + ") t(raw, placeholder, numeric, charge)")
def value_predicates(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("raw")
    return spark.range(1).select(F.explode(F.array(*[F.lit(v[0]) for v in _VALUES])).alias("raw")).select("raw", predicates.is_placeholder(x).alias("placeholder"), predicates.is_numeric_text(x).alias("numeric"), predicates.charge_type(x).alias("charge"))


@query("select p_partkey, 'right' as price, 'center' as unit, 'right' as digits, case when length(p_size::varchar) <= 4 then 'center' end as short, 'left' as words from part")
def column_alignment(spark: SparkSession, d: str) -> DataFrame:
    a = predicates.alignment
    c = lambda *x: F.array(*[F.lit(v) if isinstance(v, str) else v for v in x])
    return _t(spark, d, "part").select(
        "p_partkey", a(F.lit("Harga (Rp)"), c("x")).alias("price"), a(F.lit("Satuan"), c("paket lengkap")).alias("unit"), a(F.lit("a"), c("1.000", "2.500,00", "", F.col("p_partkey").cast("string"))).alias("digits"),
        a(F.lit("b"), c("ab", F.concat(F.lit("s"), F.col("p_size").cast("string")))).alias("short"), a(F.lit("c"), c(F.concat(F.col("p_name"), F.lit(" panjang")))).alias("words"),
    )


@query(r"""select doc_id, length(text) <= 2000 as whole, case when length(text) <= 2000 then md5(text) else md5(array_to_string(list_concat(list_filter(string_split(text, chr(10)), lambda x: not regexp_matches(trim(x), '^\|.*\|$'))[1:3], list_filter(string_split(text, chr(10)), lambda x: regexp_matches(trim(x), '^\|.*\|$'))), chr(10))) end as text
    from documents""")
def prompt_texts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return _t(spark, d, "documents").select("doc_id", (F.length(t) <= 2000).alias("whole"), F.md5(predicates.prompt_text(t, 2000, 3, 0, 0)).alias("text"))


# Pages


@query(
    """with p as (select conv_id, turn + 1 page, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]{3,}')) w from conversations union all
      select conv_id, turn + 1 + (select max(turn) + 1 from conversations c where c.conv_id = o.conv_id), list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]{3,}')) from conversations o where conv_id % 2 = 0),
    n as (select conv_id, max(page) pages from p group by 1),
    k as (select a.conv_id, b.page, b.page - a.page k, len(b.w) > 0 and len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) >= 0.6 ok from p a join p b on a.conv_id = b.conv_id and b.page > a.page),
    t as (select k.conv_id, k, bool_and(ok) ok from k join n on n.conv_id = k.conv_id where page > k and pages - k >= 2 and pages - k <= k group by 1, 2)
    select conv_id, min(k)::int kept from t where ok group by 1"""
)
def duplicate_pages(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "conversations").select("conv_id", (F.col("turn") + 1).alias("page"), "text")
    n = c.groupBy("conv_id").agg(F.max("page").alias("pages"))
    copy = c.filter("conv_id % 2 = 0").join(n, "conv_id").select("conv_id", (F.col("page") + F.col("pages")).alias("page"), "text")
    return pages.duplicate_tail(c.unionByName(copy), "conv_id")


_LOST = """with s as (select source, w, count(*) n from (select source, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]{3,}')) w from documents) group by 1, 2),
    r as (select source, w, count(*) n from (select source, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]{3,}')) w from documents where doc_id % 7 <> 0) group by 1, 2),
    l as (select s.source, s.w, s.n have, greatest(s.n - coalesce(r.n, 0), 0) lost from s left join r on r.source = s.source and r.w = s.w)"""


@query(_LOST + " select source, sum(have)::bigint words, sum(lost)::bigint missing, 1 - sum(lost)::double / sum(have)::double coverage from l group by 1")
def text_coverage(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents")
    return pages.coverage(docs, docs.filter("doc_id % 7 <> 0"), ["source"])


@query(_LOST + ", k as (select source, w word, lost::bigint lost, row_number() over (partition by source order by lost desc, w) rank from l where lost > 0) select source, word, lost, rank::int rank from k where rank <= 10")
def lost_words(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents")
    return pages.missing_words(docs, docs.filter("doc_id % 7 <> 0"), ["source"])


@query(
    """with s as (select conv_id, turn, sum((role = 'user')::int) over (partition by conv_id order by turn) section from conversations)
    select conv_id, section::bigint section, min(turn) begins, max(turn) ends, count(*) lines from s where section > 0 group by 1, 2"""
)
def sections(spark: SparkSession, d: str) -> DataFrame:
    return pages.sections(_t(spark, d, "conversations"), "conv_id", "turn", F.col("role") == "user")


# Tables and items


def _order_documents(spark: SparkSession, d: str) -> DataFrame:
    """A Markdown document for each order: a priced table of its lines, with a category row and a summary row."""
    li = _t(spark, d, "lineitem")
    line = F.concat(F.lit("| "), F.col("l_linenumber").cast("string"), F.lit(" | Barang "), F.col("l_partkey").cast("string"), F.lit(" | "), F.col("l_quantity").cast("int").cast("string"), F.lit(" | Unit | Rp "), grouped(F.col("l_suppkey") * 1000), F.lit(" | "), grouped(F.floor("l_extendedprice")), F.lit(",00 |"))
    lines = li.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", line.alias("line")))), lambda x: x["line"]).alias("l"))
    head = "# Rincian\n\n| No | Uraian Pekerjaan | Volume | Satuan | Harga Satuan | Jumlah Harga |\n|---|---|---:|:---|---|---|\n|  | A. Perangkat |  |  |  |  |\n"
    return lines.select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit(head), F.array_join("l", "\n"), F.lit("\n|  | Total |  |  |  | 999.999.999 |\n\nPenutup.")).alias("text"))


@query(
    """select l_orderkey doc_id, 1 as "table", row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_quantity::int::varchar)::int line_no, l_linenumber::varchar item_no, 'A. Perangkat' category, 'Barang ' || l_partkey description,
    l_quantity::int::double quantity, 'Unit' unit, null::varchar period, (l_suppkey * 1000)::double unit_price, floor(l_extendedprice)::double line_total, null::varchar charge_type, null::varchar remarks, 0::int extras from lineitem"""
)
def markdown_items(spark: SparkSession, d: str) -> DataFrame:
    found = tables.items(_order_documents(spark, d))
    return found.withColumn("extras", F.size("extra")).drop("extra")


@query(
    """with v as (select l_orderkey k, l_linenumber n, min(l_suppkey) + 1 s, min(l_quantity::int) q from lineitem group by 1, 2)
    select k doc_id, n::int line_no, n::varchar item_no, 'A. Layanan' category, 'Layanan ' || s description, case when n % 5 = 0 then null else q::double end quantity, case when n % 3 = 0 then 0 when n % 3 = 1 then (s * 1000)::double end unit_price,
      case when n % 3 = 0 then 0 when n % 3 = 1 then (s * 1000 * q)::double else (s * 2000)::double end line_total, case when n % 3 = 1 then 'MRC' when n % 3 = 2 then 'OTC' end charge_type, case when n % 3 = 0 then 'Free' end remarks,
      case when n % 5 = 0 then q::varchar || ' 2' end odd_quantity, 'L' || s site from v where n % 4 <> 1"""
)
def service_items(spark: SparkSession, d: str) -> DataFrame:
    """Stacked headers, charge types, free items, split quantities and extra columns."""
    li = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n")).agg((F.min("l_suppkey") + 1).alias("s"), F.min(F.col("l_quantity").cast("int")).alias("q")).filter("n % 4 <> 1")
    n, s, q = F.col("n"), F.col("s"), F.col("q")
    price, total = F.when(n % 3 == 1, grouped(s * 1000)).otherwise(""), F.when(n % 3 == 1, grouped(s * 1000 * q)).when(n % 3 == 0, "Free").otherwise("")
    once = F.when(n % 3 == 2, grouped(s * 2000)).otherwise("")
    line = said("| ", n, " | Layanan ", s, " | L", s, " | ", F.when(n % 5 == 0, said(q, " 2")).otherwise(q.cast("string")), " | Paket | ", price, " | ", total, " | ", once, " |")
    body = li.groupBy("k").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"]), "\n").alias("body"))
    head = "| No | Uraian | Lokasi | Volume | Satuan | Harga Bulanan | Jumlah Harga | Total |\n|---|---|---|---|---|---|---|---|\n|  | Layanan |  |  |  | MRC | MRC | OTC |\n|  | A. Layanan |  |  |  |  |  |  |\n"
    docs = body.select(F.col("k").alias("doc_id"), said("Lampiran\n", head, F.col("body"), "\n").alias("text"))
    found = tables.items(docs)
    return found.select("doc_id", F.col("item_no").cast("int").alias("line_no"), "item_no", "category", "description", "quantity", "unit_price", "line_total", "charge_type", "remarks", F.col("extra")["Volume"].alias("odd_quantity"), F.col("extra")["Lokasi"].alias("site"))


@query("select l_orderkey doc_id, 1 as \"table\", 6::int columns, (count(*) + 2)::int rows from lineitem group by 1")
def markdown_tables(spark: SparkSession, d: str) -> DataFrame:
    return tables.markdown_tables(_order_documents(spark, d)).select("doc_id", "table", F.size("headers").alias("columns"), F.size("rows").alias("rows"))


@query(
    """with i as (select l_orderkey k, l_linenumber n, min(l_partkey) p, min(l_extendedprice) t from lineitem group by 1, 2),
    j as (select *, (n + 1) // 2 g, lag(p) over (partition by k, (n + 1) // 2 order by n) before from i)
    select k doc_id, g::varchar item_no, min(n)::int line_no, string_agg(p::varchar, '; ' order by n) filter (before is null or before <> p) description, 5.0::double unit_price, arg_min(t, n) line_total from j group by 1, 2"""
)
def merged_rows(spark: SparkSession, d: str) -> DataFrame:
    li = _t(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_extendedprice").alias("t"))
    found = li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line_no"), F.floor((F.col("l_linenumber") + 1) / 2).cast("string").alias("item_no"), F.col("p").cast("string").alias("description"), F.lit(5.0).alias("unit_price"), F.col("t").alias("line_total"))
    return tables.merge_split_rows(found)


@query("select p_partkey, [['Nama', 'Harga', ''], [p_name, p_brand || ' ' || p_size, 'x']] as rows from part")
def html_tables(spark: SparkSession, d: str) -> DataFrame:
    html = F.concat(F.lit("<p>x</p><table><tr><th>Nama</th><th colspan=2>Harga</th></tr><tr><td></td><td> </td></tr><tr><td><b>"), F.col("p_name"), F.lit("</b></td><td>"), F.col("p_brand"), F.lit("<br/>"), F.col("p_size").cast("string"), F.lit("</td><td>x</td></tr></table>"))
    return _t(spark, d, "part").select("p_partkey", tables.html_rows(html).alias("rows"))


# Reconciliation


@query(
    """select o_orderkey, case o_orderkey % 4 when 3 then 'model' else 'table' end as source, case o_orderkey % 4 when 0 then 2 when 1 then 2 when 2 then 1 else 3 end::int as items from orders where o_custkey > 0"""
)
def chosen_items(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("o_orderkey") % 4, (F.col("o_custkey") * 100000).cast("double")

    def item(number: str, total: Column, price: Column = None) -> Column:
        return F.struct(F.lit(number).alias("number"), F.lit("barang").alias("description"), (total if price is None else price).alias("price"), total.alias("total"))

    one = F.array(item("1", n), item("2", n * 2))
    copies, merged = F.array(one, one), F.array(F.array(item("1", n * 3), item("1", n * 3)))
    found = F.when(k == 1, copies).when(k == 2, merged).otherwise(F.array(one))
    model = F.when(k == 3, F.array(item("1", n), item("2", n), item("3", n * 3))).otherwise(F.array(item("1", n)))
    stated = F.when(k == 3, n * 5).otherwise(n * 3)
    o = _t(spark, d, "orders").filter("o_custkey > 0").select("o_orderkey", found.alias("tables"), model.alias("model"), F.array(stated).alias("references"), F.concat(F.lit("Total Rp "), grouped(stated)).alias("text"))
    return reconcile.choose_items(o, "tables", "model", "references", "text").select("o_orderkey", "source", F.size("chosen").alias("items"))


@query("select o_orderkey, case o_orderkey % 4 when 0 then 'belum termasuk PPN 11%' when 1 then 'sudah termasuk PPN' end as mention from orders")
def vat_mentions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    t = F.when(k == 0, "Harga  belum termasuk\nPPN 11%.").when(k == 1, "Harga sudah termasuk PPN").when(k == 2, "sebelum PPN dan setelah PPN").otherwise("termasuk pajak-pajak")
    return _t(spark, d, "orders").select("o_orderkey", reconcile.vat_mention(t).alias("mention"))


@query("select o_orderkey, case when o_orderkey % 2 = 0 then 'A/ANG/' else 'A/XYZ/' end || o_orderkey as number, case when o_orderkey % 2 = 0 then 'B/MAJ/' else 'B/MAJ/' end || o_orderkey as internal from orders")
def contract_numbers(spark: SparkSession, d: str) -> DataFrame:
    k, even = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 2 == 0
    a, b = F.concat(F.when(even, "A/ANG/").otherwise("A/XYZ/"), k), F.concat(F.lit("B/MAJ/"), k)
    c = reconcile.contract_numbers(F.when(even, b).otherwise(a), F.when(even, a).otherwise(b), F.lit("PT Angkasa Raya"), F.lit("CV Maju Terus"))
    return _t(spark, d, "orders").select("o_orderkey", c["number"].alias("number"), c["internal"].alias("internal"))


@query("select o_orderkey, case when o_orderkey % 2 = 0 then (o_custkey * 1000)::double else 7.0::double end as preferred, case when o_orderkey % 2 = 0 then null else 7.0::double end as kept from orders where o_custkey > 0")
def confirmed_first(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("o_custkey") * 1000
    t = F.concat(F.lit("Rp "), grouped(n), F.lit(",- ("), numbers.spell(n), F.lit(" rupiah)"), F.when(F.col("o_orderkey") % 2 == 1, " dan 7").otherwise(""))
    return _t(spark, d, "orders").filter("o_custkey > 0").select("o_orderkey", reconcile.prefer_confirmed(F.lit(7.0), t).alias("preferred"), reconcile.drop_unwritten(F.lit(7.0), t).alias("kept"))


# Contract wording


@query("select o_orderkey, case when o_orderkey % 3 < 2 then 'Termin 1' end as label, case when o_orderkey % 3 = 0 then (o_custkey * 1000)::double end as amount, case when o_orderkey % 3 = 1 then '30%' end as percentage from orders where o_custkey > 0")
def payment_terms(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("o_orderkey") % 3, grouped(F.col("o_custkey") * 1000)
    t = F.when(k == 0, F.concat(F.lit("Termin 1 sebesar Rp "), n, F.lit(",- setelah BAST"))).when(k == 1, "Termin 1 sebesar 30 % dari nilai, 30% itu").otherwise("Termin 1 50% dan Termin 2 50 persen, 40%")
    p = contracts.payment_term(t)
    return _t(spark, d, "orders").filter("o_custkey > 0").select("o_orderkey", p["label"].alias("label"), p["amount"].alias("amount"), p["percentage"].alias("percentage"))


@query("select o_orderkey, case o_orderkey % 4 when 0 then 'customer' when 1 then 'vendor' when 2 then 'customer' else 'unknown' end as direction from orders")
def handover_direction(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    t = F.when(k == 0, "PIHAK KEDUA menyerahkan  kepada PIHAK PERTAMA").when(k == 1, "PIHAK PERTAMA menyerahkan kepada PIHAK KEDUA").when(k == 2, "selanjutnya Pihak Kedua\n## MENYERAHKAN").otherwise("kosong")
    return _t(spark, d, "orders").select("o_orderkey", contracts.direction(F.lit("CV Lain"), F.lit("PT Kita Jaya"), t, r"(?i)\bkita\b").alias("direction"))


@query(
    """select o_orderkey doc_id, s as section, a::int first_line, b::int last_line from orders, (values ('preamble', 0, 1), ('scope', 2, 3), ('price', 4, 4), ('closing', 5, 6)) t(s, a, b)"""
)
def contract_sections(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.lit("# SURAT PERINTAH KERJA\nNomor "), F.col("o_orderkey").cast("string"), F.lit("\n1. Lingkup Pekerjaan\nisi\nPasal 2 HARGA\nDemikian surat ini\nttd"))
    return contracts.section_rows(_t(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), t.alias("text")))


_LISTS = (
    (("1. satu", "a. dua", "b. tiga", "i. empat", "ii. lima", "c. enam", "2. tujuh", "teks", "# Judul", "A) delapan", "B) sembilan"), (0, 1, 1, 2, 2, 1, 0, None, None, 0, 0)),
    (("A. satu", "a. dua", "b. tiga", "B. empat", "lim. lima", "(1) enam", "(2) tujuh", "C. delapan"), (0, 1, 1, 0, 1, 2, 2, 0)),
    (("g. satu", "h. dua", "i. tiga", "J. empat", "k. lima", "1) enam", "i. tujuh", "ii. delapan", "2) sembilan"), (0, 0, 0, 0, 0, 1, 2, 2, 1)),
)


@query(
    "select o_orderkey doc_id, n::int as line, l::int as level from orders join (values "
    + ", ".join(f"({k}, {i}, {v})" for k, (_, levels) in enumerate(_LISTS) for i, v in enumerate(levels) if v is not None)
    + ") t(k, n, l) on k = o_orderkey % 3"
)
def nested_lists(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 3
    lists = [F.array(*[F.lit(x) for x in lines]) for lines, _ in _LISTS]
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.posexplode(F.when(k == 0, lists[0]).when(k == 1, lists[1]).otherwise(lists[2])).alias("line", "text"))
    return blocks.list_levels(o.withColumn("heading", F.col("text").startswith("#")), "doc_id", "line", "text", "heading")


@query(
    """with l as (select l_orderkey k, count(*) filter (l_quantity > 25) n from lineitem group by 1)
    select o_orderkey, coalesce(n, 0) > 0 and o_orderkey % 2 = 0 and o_orderkey % 5 <> 0 as ready,
    list_concat(case when o_orderkey % 2 = 1 then ['o_clerk: not confirmed'] else [] end, list_concat(case when o_orderkey % 5 = 0 then ['o_status: empty'] else [] end, case when coalesce(n, 0) = 0 then ['no delivered item'] else [] end)) as problems, coalesce(n, 0) as items
    from orders left join l on k = o_orderkey"""
)
def handover_drafts(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).alias("o_status"), F.lit("x").alias("o_clerk"))
    sure = o.select("o_orderkey", F.explode(F.array(F.lit("o_status"), F.when(F.col("o_orderkey") % 2 == 0, F.lit("o_clerk")).otherwise("none"))).alias("path"))
    li = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("line_no"), F.when(F.col("l_quantity") > 25, 1).otherwise(0).alias("delivered"))
    return contracts.handover_drafts(o, li, sure, ["o_status", "o_clerk"], "o_orderkey")


# Mapping


def _customers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = _t(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    return c.filter("c_custkey % 3 <> 0"), c.filter("c_custkey % 2 = 0").withColumn("c_name", F.upper("c_name"))


@query("select c_custkey, case when c_custkey % 2 = 0 then upper(c_name) else c_name end c_name, c_nationkey from customer where c_custkey % 3 <> 0 or c_custkey % 2 = 0")
def upserted(spark: SparkSession, d: str) -> DataFrame:
    return mapping.upsert(*_customers(spark, d), ["c_custkey"])


@query("select c_custkey, case when c_custkey % 3 <> 0 then 'update' else 'insert' end as action from customer where c_custkey % 2 = 0")
def upsert_plan(spark: SparkSession, d: str) -> DataFrame:
    return mapping.plan_upsert(*_customers(spark, d), ["c_custkey"])


@query("select l_orderkey, l_linenumber from lineitem where l_orderkey % 2 = 0 and l_linenumber > 3")
def stale_rows(spark: SparkSession, d: str) -> DataFrame:
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    new = li.filter("l_orderkey % 2 = 0 and l_linenumber <= 3").unionByName(li.filter("l_orderkey % 2 = 0").select("l_orderkey", F.lit(0).cast("int").alias("l_linenumber")))
    return mapping.stale(li, new, ["l_orderkey"], ["l_orderkey", "l_linenumber"])


@query("select s_suppkey, s_nationkey from supplier where s_nationkey not in (select n_nationkey from nation where n_regionkey = 1)")
def orphan_rows(spark: SparkSession, d: str) -> DataFrame:
    n = _t(spark, d, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"))
    return mapping.orphans(_t(spark, d, "supplier").select("s_suppkey", "s_nationkey"), n, ["s_nationkey"])


@query(
    """with f as (select o_orderkey, o_orderstatus v from orders), r as (select o_orderkey, l_linenumber n, case l_linenumber % 3 when 0 then 'benar' when 1 then 'dikoreksi' else 'salah' end dec, 'fix' || l_linenumber fin,
      case when l_linenumber = 4 then 'old' else l_linestatus end seen from lineitem join orders on o_orderkey = l_orderkey),
    j as (select r.*, v from r join f using (o_orderkey) where dec in ('benar', 'dikoreksi') and seen is not distinct from v),
    x as (select *, row_number() over (partition by o_orderkey order by n desc) k from j)
    select o_orderkey, case when dec = 'dikoreksi' then fin else v end as value, dec decision from x where k = 1"""
)
def verified_values(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("value"))
    n = F.col("l_linenumber")
    r = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), n.alias("ordinal"), F.when(n % 3 == 0, "benar").when(n % 3 == 1, "dikoreksi").otherwise("salah").alias("decision"), F.concat(F.lit("fix"), n.cast("string")).alias("final_value"), F.when(n == 4, "old").otherwise(F.col("l_linestatus")).alias("seen_value"))
    return mapping.verified(o, r, ["o_orderkey"])


@query(
    """select l_orderkey, count(*) fields, count(*) filter (l_returnflag = 'R') decided, round(100.0 * count(*) filter (l_returnflag = 'R') / count(*), 1)::double progress
    from (select distinct l_orderkey, l_linenumber, max(l_returnflag) over (partition by l_orderkey, l_linenumber) l_returnflag from lineitem) group by 1"""
)
def review_progress(spark: SparkSession, d: str) -> DataFrame:
    li = _t(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("flag"))
    return mapping.review_progress(li, li.select("l_orderkey", "l_linenumber", F.when(F.col("flag") == "R", "benar").alias("decision")), "l_orderkey", "l_linenumber")


@query(
    """select l_orderkey, l_linenumber, case when round(l_quantity * p_retailprice) = round(l_extendedprice) then 'cocok' else 'cek hitungan' end as state from lineitem join part on p_partkey = l_partkey"""
)
def arithmetic_view(spark: SparkSession, d: str) -> DataFrame:
    li, p = _t(spark, d, "lineitem"), _t(spark, d, "part")
    return li.join(p, li["l_partkey"] == p["p_partkey"]).select("l_orderkey", "l_linenumber", mapping.arithmetic_check(F.col("l_quantity"), F.col("p_retailprice"), F.lit(None).cast("double"), F.col("l_extendedprice")).alias("state"))


@query("select o_orderkey, case o_orderstatus when 'F' then 1 when 'O' then 3 when 'P' then 5 else 6 end as risk from orders")
def risk_view(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return _t(spark, d, "orders").select("o_orderkey", mapping.risk_order(F.when(s == "F", "bertentangan").when(s == "O", "perlu_dicek").when(s == "P", "bukti_kuat").otherwise("baru")).alias("risk"))


@query("select c_custkey, case when c_custkey % 3 = 0 then 'pelaksana' else 'pemberi' end first_role, case when c_custkey % 3 = 0 then 'pemberi' else 'pelaksana' end second_role, c_custkey % 3 = 2 as uncertain from customer")
def party_roles(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey") % 3
    p = _t(spark, d, "customer").select("c_custkey", F.when(k == 0, "PT Kita Jaya").otherwise(F.col("c_name")).alias("first_name"), F.when(k == 1, "PT Kita Jaya").otherwise(F.lit("CV Lain")).alias("second_name"))
    return mapping.company_roles(p, "c_custkey", r"(?i)\bkita\b")


@query("select n_nationkey, case when n_nationkey % 4 = 0 then 'missing' when n_nationkey % 4 = 1 then 'unexpected' else 'different' end as state from nation where n_nationkey % 4 in (0, 1) or n_nationkey % 4 = 2")
def schema_differences(spark: SparkSession, d: str) -> DataFrame:
    n = _t(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("kind"))
    return mapping.compare_schemas(n.filter("n_nationkey % 4 <> 1"), n.filter("n_nationkey % 4 <> 0").withColumn("kind", F.when(F.col("n_nationkey") % 4 == 2, "x").otherwise(F.col("kind"))), ["n_nationkey"], "kind")


# Evidence and evaluation

_GOLD = "select o_orderkey, o_orderkey % 6 m, o_totalprice, o_orderdate::date dt, o_orderpriority pr from orders"


def _evaluated(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").withColumn("m", F.col("o_orderkey") % 6)
    day, m = F.to_date("o_orderdate"), F.col("m")
    golden = o.select("o_orderkey", F.when(m == 0, F.date_format(day, "yyyy-MM-dd")).when(m == 1, F.lit("dua ratus ribu rupiah")).when(m == 2, F.lit("PT. Maju Jaya, Jakarta")).when(m == 3, None).when(m == 4, F.lit("alpha beta")).otherwise(F.lit("nilai")).alias("expected"), (m < 3).alias("critical"))
    predicted = o.select("o_orderkey", F.when(m == 0, dates.write_date(day)).when(m == 1, F.lit("Dua Ratus Satu Ribu")).when(m == 2, F.lit("pt maju jaya jakarta")).when(m == 3, F.lit("x")).when(m == 4, F.lit("alpha beta gamma")).alias("predicted"), F.when(F.col("o_orderkey") % 2 == 1, "AUTO_VERIFIED").otherwise("UNSUPPORTED").alias("status"))
    return evaluation.evaluate(golden, predicted, ["o_orderkey"])


_VERDICT = "case m when 0 then 'exact' when 1 then 'wrong' when 2 then 'exact' when 3 then 'spurious' when 4 then 'lenient' else 'missing' end"


@query(
    f"""select o_orderkey, case m when 0 then strftime(dt, '%Y-%m-%d') when 1 then 'dua ratus ribu rupiah' when 2 then 'PT. Maju Jaya, Jakarta' when 4 then 'alpha beta' when 5 then 'nilai' end as expected, m < 3 as critical, {_VERDICT} as verdict,
    case m when 0 then 'date' when 1 then 'terbilang' when 2 then 'canon' when 3 then 'null' when 4 then 'token_f1' else '-' end as method, m in (1, 3) and o_orderkey % 2 = 1 as false_acceptance from ({_GOLD})"""
)
def field_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return _evaluated(spark, d).drop("predicted")


@query(
    f"""with v as (select o_orderkey // 10 as doc, {_VERDICT} v, m < 3 crit, m in (1, 3) and o_orderkey % 2 = 1 fa from ({_GOLD})),
    p as (select doc, avg((v in ('exact', 'lenient', 'correct_null'))::int) a, avg((v in ('exact', 'lenient', 'correct_null'))::int) filter (crit) c, count(*) filter (fa) f from v group by 1)
    select count(*) documents, round(avg(a), 9) accuracy, round(avg(c), 9) critical_accuracy, sum(f)::bigint false_acceptances from p"""
)
def accuracy_summary(spark: SparkSession, d: str) -> DataFrame:
    per = evaluation.accuracy(_evaluated(spark, d).withColumn("doc", F.floor(F.col("o_orderkey") / 10)), "doc")
    return evaluation.summarize(per).withColumns({c: F.round(c, 9) for c in ("accuracy", "critical_accuracy")})


@query(
    """select doc_id, case when quality = 1 then 'exact' else 'wrong' end old_verdict, case when doc_id % 2 = 0 then 'exact' else 'wrong' end new_verdict,
    case when toxic = 1 and doc_id % 2 = 1 then 'new_false_acceptance' when quality = 1 and doc_id % 2 = 1 then 'regression' when quality = 0 and doc_id % 2 = 0 then 'improvement' else 'same' end change from labels"""
)
def run_differences(spark: SparkSession, d: str) -> DataFrame:
    lab = _t(spark, d, "labels")
    old = lab.select("doc_id", F.when(F.col("quality") == 1, "exact").otherwise("wrong").alias("verdict"), F.lit(False).alias("false_acceptance"))
    new = lab.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "exact").otherwise("wrong").alias("verdict"), ((F.col("toxic") == 1) & (F.col("doc_id") % 2 == 1)).alias("false_acceptance"))
    return evaluation.compare_runs(old, new, ["doc_id"])


@query(
    """with e as (select l_orderkey, case when l_returnflag = 'N' then null else l_discount * 10 end s, l_linenumber = 7 missing, l_quantity > 45 err, l_quantity < 5 warn, list_extract(['exact_match', 'number_match', 'phrase_containment', 'identifier_match', 'date_match', 'reverse_containment', 'exact_match+multiblock'], (1 + l_partkey % 7)::int) k from lineitem),
    t as (select *, case when missing then 'MISSING' when err then 'CONFLICT' when s is null then 'UNSUPPORTED' when warn then 'REVIEW_REQUIRED' when s >= 0.85 and k in ('exact_match', 'number_match', 'phrase_containment', 'identifier_match') then 'AUTO_VERIFIED' when s >= 0.8 then 'AUTO_ACCEPTED' else 'REVIEW_REQUIRED' end st from e)
    select l_orderkey, count(*) fields, count(*) filter (st <> 'MISSING') filled, count(*) filter (s >= 0.65) grounded, round(count(*) filter (st <> 'MISSING') / count(*), 3)::double fill_rate,
    round(count(*) filter (s >= 0.65) / greatest(count(*) filter (st <> 'MISSING'), 1), 3)::double grounding_rate, count(*) filter (st = 'AUTO_VERIFIED') auto_verified, count(*) filter (st = 'AUTO_ACCEPTED') auto_accepted,
    count(*) filter (st = 'REVIEW_REQUIRED') review_required, count(*) filter (st = 'UNSUPPORTED') unsupported, count(*) filter (st = 'CONFLICT') as conflict, count(*) filter (st = 'MISSING') missing from t group by 1"""
)
def quality_report(spark: SparkSession, d: str) -> DataFrame:
    score = F.when(F.col("l_returnflag") != "N", F.col("l_discount") * 10)
    kinds = F.array(*[F.lit(k) for k in ("exact_match", "number_match", "phrase_containment", "identifier_match", "date_match", "reverse_containment", "exact_match+multiblock")])
    kind = F.get(kinds, (F.col("l_partkey") % 7).cast("int"))
    e = _t(spark, d, "lineitem").select("l_orderkey", score.alias("evidence_score"), evidence.status(F.when(F.col("l_linenumber") != 7, F.lit("x")), score, kind, F.col("l_quantity") > 45, F.col("l_quantity") < 5).alias("status"))
    return evidence.quality_report(e, "l_orderkey")


@query("""select conv_id, turn, 2 as blocks, text || ' ' || nxt as text from (select *, lead(text) over (partition by conv_id order by turn) nxt from conversations) where nxt is not null""")
def block_windows(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "conversations").select("conv_id", F.lit(1).alias("page"), F.col("turn").alias("ordinal"), F.col("turn").cast("string").alias("block_id"), "text", F.lit(0.9).alias("confidence"))
    return evidence.block_windows(c, "conv_id", (2,)).select("conv_id", F.col("start").alias("turn"), F.col("size").alias("blocks"), "text")


# Layout


@query(
    """with b as (select l_orderkey, l_linenumber n, ((l_linenumber - 1) // 3) r, ((l_linenumber - 1) % 3) * 0.3 x0, case when l_quantity > 25 then 0.25 else 0.1 end w, l_returnflag t from (select distinct on (l_orderkey, l_linenumber) * from lineitem order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity)),
    g as (select *, case when x0 - lag(x0 + w) over (partition by l_orderkey, r order by x0) > 0.15 then 1 else 0 end f from b), s as (select *, sum(f) over (partition by l_orderkey, r order by x0) k from g)
    select l_orderkey, string_agg(n::varchar, ' ' order by x0) as text, count(*) boxes from s group by l_orderkey, r, k"""
)
def text_lines(spark: SparkSession, d: str) -> DataFrame:
    n, first = F.col("l_linenumber"), F.min(F.struct("l_partkey", "l_suppkey", "l_quantity"))
    li = _t(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(first.alias("f"))
    x0, y0 = ((n - 1) % 3) * 0.3, F.floor((n - 1) / 3) * 0.1
    boxes = li.select("l_orderkey", n.cast("string").alias("text"), x0.alias("x0"), (x0 + F.when(F.col("f.l_quantity") > 25, 0.25).otherwise(0.1)).alias("x1"), y0.alias("y0"), (y0 + 0.01).alias("y1"), F.lit(0.9).alias("confidence"))
    return layout.text_lines(boxes, ["l_orderkey"]).select("l_orderkey", "text", F.size(F.split("text", " ")).cast("long").alias("boxes"))


@query(
    """with c as (select *, role is distinct from lag(role) over (partition by conv_id order by turn) f from conversations), g as (select *, sum(f::int) over (partition by conv_id order by turn) k from c)
    select conv_id, min(turn) ordinal, count(*) members, string_agg(text, chr(10) order by turn) as text from g group by conv_id, k"""
)
def merged_blocks(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("role") == "user", "paragraph").when(F.col("role") == "assistant", "title").otherwise("key_value")
    c = _t(spark, d, "conversations").select("conv_id", F.col("turn").alias("ordinal"), kind.alias("type"), "text", *[F.lit(0.0).alias(k) for k in ("x0", "y0", "x1", "y1")], F.lit(1.0).alias("confidence"))
    out = blocks.page_blocks(c, ["conv_id"], (blocks.merged,))
    return out.select("conv_id", F.array_min("members").cast("long").alias("ordinal"), F.size("members").cast("long").alias("members"), "text")


@query(
    """select o_orderkey, n::int ordinal, t as type, case n when 0 then 'Nama : Budi ' || o_custkey when 1 then 'Jabatan : Direktur' when 2 then 'Alamat : Jl. Merdeka ' || o_custkey || ' Bandung 40257' when 3 then 'paragraf yang panjang dan bukan label sama sekali' end as text
    from orders, (values (0, 'key_value'), (1, 'key_value'), (2, 'key_value'), (3, 'paragraph')) v(n, t)"""
)
def label_values(spark: SparkSession, d: str) -> DataFrame:
    """Columns of bare labels and of values, read in any order, with an address that goes on."""
    c = F.col("o_custkey")
    rows = (
        ("Nama", 0.1, 0.10, "paragraph"), ("Jabatan", 0.1, 0.13, "paragraph"), ("Alamat", 0.1, 0.16, "paragraph"), (said(": Jl. Merdeka ", c), 0.4, 0.161, "key_value"), (": Direktur", 0.4, 0.131, "key_value"),
        (said(": Budi ", c), 0.4, 0.102, "key_value"), ("Bandung 40257", 0.41, 0.18, "paragraph"), ("paragraf yang panjang dan bukan label sama sekali", 0.1, 0.5, "paragraph"),
    )
    made = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(kind).alias("type"), (F.lit(t) if isinstance(t, str) else t).alias("text"), F.lit(x).alias("x0"), F.lit(y).alias("y0"), F.lit(x + 0.2).alias("x1"), F.lit(y + 0.012).alias("y1"), F.lit(0.9).alias("confidence")) for i, (t, x, y, kind) in enumerate(rows)])
    o = _t(spark, d, "orders").select("o_orderkey", F.explode(made).alias("b")).select("o_orderkey", "b.*")
    return blocks.page_blocks(o, ["o_orderkey"], (blocks.paired,)).select("o_orderkey", "ordinal", "type", "text")


@query("select l_orderkey, l_linenumber, greatest(0, least(1, round(l_discount * 5, 5))) x0, greatest(0, least(1, round(l_tax * 20, 5))) y1 from lineitem")
def normalized_boxes(spark: SparkSession, d: str) -> DataFrame:
    b = layout.normalize_box(F.col("l_discount") * 500, F.lit(0.0), F.lit(1000.0), F.col("l_tax") * 2000, F.lit(100.0), F.lit(100.0))
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", b["x0"].alias("x0"), b["y1"].alias("y1"))


# Sources


@query(
    """select o_orderkey, 'header.status' as path, o_orderstatus as value_text from orders union all select o_orderkey, 'header.customer', o_custkey::varchar from orders
    union all select o_orderkey, 'tags[0].name', o_orderpriority from orders union all select o_orderkey, 'tags[1].name', 'x' from orders"""
)
def nested_leaves(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders")
    nested = o.select("o_orderkey", F.struct(F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("customer")).alias("header"), F.array(F.struct(F.col("o_orderpriority").alias("name")), F.struct(F.lit("x").alias("name"))).alias("tags"))
    return readers.leaves(nested, "o_orderkey")


@query("select doc_id, 'doc-' || substr(sha256(text), 1, 16) document_id from documents where text is not null")
def content_ids(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").filter("text is not null").select("doc_id", readers.document_id(F.col("text")).alias("document_id"))


# Jobs


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 5
    return _t(spark, d, "events").select(F.col("event_id").alias("job_id"), (F.col("user_id") % 16).alias("worker"), F.col("ts").alias("created_at"), F.when(k == 0, "queued").when(k == 1, "running").when(k == 2, "failed").otherwise("done").alias("status"))


_JOBS = "(select event_id job_id, user_id % 16 worker, ts created_at, case event_id % 5 when 0 then 'queued' when 1 then 'running' when 2 then 'failed' else 'done' end status from events)"


@query(f"select status, count(*) jobs from {_JOBS} group by 1")
def job_states(spark: SparkSession, d: str) -> DataFrame:
    return jobs.state_counts(_jobs(spark, d))


@query(f"select worker, job_id, row_number() over (partition by worker order by created_at, job_id)::int as position from {_JOBS} where status = 'queued'")
def queue_positions(spark: SparkSession, d: str) -> DataFrame:
    return jobs.queue_positions(_jobs(spark, d), "worker")


@query(
    f"""with r as (select *, count(*) over (partition by worker) n, row_number() over (partition by worker order by case when status in ('done', 'failed') then 0 else 1 end, created_at, job_id) k from {_JOBS})
    select job_id, worker, status from r where status not in ('done', 'failed') or k > n - 20"""
)
def evicted_history(spark: SparkSession, d: str) -> DataFrame:
    return jobs.evict(_jobs(spark, d), 20, "worker").select("job_id", "worker", "status")


@query(f"with r as (select *, row_number() over (partition by worker order by created_at desc, job_id desc) n from {_JOBS}) select job_id, worker, status from r where n <= 5")
def newest_jobs(spark: SparkSession, d: str) -> DataFrame:
    return jobs.newest(_jobs(spark, d), 5, "worker").select("job_id", "worker", "status")


from lontar.plans import extraction  # noqa: E402, F401  registers its queries
