"""Operators on small fixtures, and registered queries against their SQL."""

from __future__ import annotations

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from lontar.operators import mapping, pages, tables
from lontar.plans import catalog
from lontar.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_items_with_categories(spark):
    text = "| No | Uraian | Qty | Satuan | Harga Satuan | Jumlah Harga |\n|---|---|---|---|---|---|\n| | A. Alat | | | | |\n| 1 | Server | 2 | Unit | 1.000.000 | 2.000.000 |\n| 2 | Lisensi | 1 2 | Unit | Free | |\n| | Total | | | | 2.000.000 |"
    got = tables.items(spark.createDataFrame([(1, text), (2, None), (3, "tanpa tabel")], "doc_id int, text string")).collect()
    assert [(r.item_no, r.category, r.description, r.quantity, r.unit_price, r.line_total) for r in got] == [("1", "A. Alat", "Server", 2.0, 1e6, 2e6), ("2", "A. Alat", "Lisensi", None, 0.0, 0.0)]


def test_html_rows(spark):
    html = "<table><tr><th colspan='2'>A</th><th>B</th></tr><tr><td>x<br>y</td><td></td><td>z</td></tr><tr><td> </td></tr></table>"
    rows = spark.createDataFrame([(html,)], "h string").select(tables.html_rows(F.col("h")).alias("r")).first()["r"]
    assert rows == [["A", "", "B"], ["x y", "", "z"]]


def test_duplicate_tail(spark):
    p = [(1, i + 1, t) for i, t in enumerate(["alpha beta gamma", "delta epsilon", "alpha beta gamma", "delta epsilon"])] + [(2, 1, "alpha beta"), (2, 2, "alpha beta")]
    got = pages.duplicate_tail(spark.createDataFrame(p, "doc_id int, page int, text string")).collect()
    assert [(r.doc_id, r.kept) for r in got] == [(1, 2)]


def test_verified_values_follow_the_last_valid_review(spark):
    fields = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id int, value string")
    reviews = spark.createDataFrame([(1, 1, "benar", "a", None), (1, 2, "salah", "a", None), (2, 1, "dikoreksi", None, "b"), (3, 1, "benar", "old", None)], "id int, ordinal int, decision string, seen_value string, final_value string")
    assert sorted((r.id, r.value) for r in mapping.verified(fields, reviews, ["id"]).collect()) == [(1, "a"), (2, "b")]


def test_job_stream_runs_each_document_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.json").write_text('{"document_id": "d1"}\n{"document_id": "d%d"}\n' % (k + 2))
        stream = jobs.submitted(spark, str(tmp_path / "in"), "document_id string")
        jobs.run_queue(stream, str(tmp_path / "ck"), lambda df: df.withColumn("status", F.lit("done")), str(tmp_path / "store")).awaitTermination()
    assert sorted(r.document_id for r in spark.read.parquet(str(tmp_path / "store")).collect()) == ["d1", "d2", "d3"]


def test_an_interrupted_batch_runs_nothing_twice(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.json").write_text('{"document_id": "d1"}\n{"document_id": "d2"}\n')
    ran = []

    def runner(df):
        ran.append(sorted(r.document_id for r in df.collect()))
        if len(ran) == 1:
            raise RuntimeError("stopped after its side effect")
        return df.withColumn("status", F.lit("done"))

    for _ in range(2):
        query = jobs.run_queue(jobs.submitted(spark, str(tmp_path / "in"), "document_id string"), str(tmp_path / "ck"), runner, str(tmp_path / "store"))
        try:
            query.awaitTermination()
        except Exception as e:
            assert "stopped" in str(e)
    assert ran == [["d1", "d2"], []] and {(r.document_id, r.status, r.error) for r in spark.read.parquet(str(tmp_path / "store")).collect()} == {("d1", "failed", "interrupted"), ("d2", "failed", "interrupted")}


@pytest.mark.parametrize("name", ["validation_report", "number_vectors", "markdown_items", "service_items", "verified_values", "evicted_history", "field_verdicts", "evidence_located", "field_evidence", "entity_hints", "column_signers", "contract_item_records", "nested_lists", "label_values", "document_markdown"])
def test_queries_match_sql(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("the test tables aren't here")
    con = duckdb.connect()
    for t in "nation customer supplier part orders lineitem events documents conversations labels".split():
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = con.execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    key = lambda row: repr([round(x, 6) if isinstance(x, float) else x for x in row])
    got = sorted(key([r[c] for c in columns]) for r in catalog.QUERIES[name](spark, SF).collect())
    assert got == sorted(key(r) for r in want.fetchall())


def test_every_query_has_a_name_and_the_flagship_is_one():
    assert catalog.FLAGSHIP in catalog.QUERIES and set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)


def test_item_choice_prefers_the_copy_whose_sum_is_written(spark):
    from lontar.operators import reconcile

    item = "struct<number:string,description:string,price:double,total:double>"
    one = [("1", "a", 100000.0, 100000.0), ("2", "b", 200000.0, 200000.0)]
    rows = [(1, [one, one], [("1", "a", 5.0, 5.0)], [300000.0], "Total Rp 300.000"), (2, [], [("1", "a", 5.0, 5.0)], [300000.0], "Total Rp 300.000"), (3, [one], [("1", "a", 300000.0, 300000.0)] * 1, [None], None)]
    df = spark.createDataFrame(rows, f"id int, tables array<array<{item}>>, model array<{item}>, refs array<double>, text string")
    got = {r.id: (r.source, len(r.chosen)) for r in reconcile.choose_items(df, "tables", "model", "refs", "text").collect()}
    assert got == {1: ("table", 2), 2: ("model", 1), 3: ("table", 2)}


def test_list_levels_and_sections(spark):
    from lontar.operators import blocks, contracts

    lines = [(1, i, t, t.startswith("#")) for i, t in enumerate(["1. a", "a. b", "b. c", "i. d", "ii. e", "2. f", "# h", "(1) g", "kosong"])]
    got = blocks.list_levels(spark.createDataFrame(lines, "doc int, line int, text string, heading boolean"), "doc", "line", "text", "heading")
    assert [r.level for r in got.orderBy("line").collect()] == [0, 1, 1, 2, 2, 0, 0]
    s = contracts.section_rows(spark.createDataFrame([(1, "1. GARANSI\nx\nPasal 2 DENDA\ny"), (2, None)], "doc_id int, text string")).orderBy("first_line").collect()
    assert [(r.section, r.first_line, r.last_line) for r in s] == [("guarantee", 0, 1), ("penalty", 2, 3)]


def test_nested_leaves_and_block_types(spark):
    from lontar.sources import readers

    df = spark.createDataFrame([(1, ("x", [(1,), (2,)]))], "id int, a struct<b:string,c:array<struct<d:int>>>")
    assert [(r.path, r.value_text) for r in readers.leaves(df, "id").collect()] == [("a.b", "x"), ("a.c[0].d", "1"), ("a.c[1].d", "2")]
    assert spark.range(1).select(readers.block_type(F.lit("List_Item")), readers.block_type(F.lit("?"))).first()[:] == ("list", "unknown")
