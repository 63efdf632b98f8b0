"""What decides how queries grow: tasks, plans and repeated work."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import functions as F

from lontar.operators import entities, evidence, groups, signatures
from lontar.plans import extraction
from lontar.plans.registry import spread

SF = "/root/testdata/sf0.001"


def test_documents_of_a_small_file_are_dealt_over_tasks(spark):
    rows = spark.range(0, 6000, 1, 1).select(F.when(F.col("id") % 7 > 0, F.col("id")).alias("k"), "id")
    dealt = spread(rows, "k")
    assert dealt.rdd.getNumPartitions() == 12 and sorted(r.id for r in dealt.collect()) == list(range(6000))
    assert spread(rows, "k", most=300).rdd.getNumPartitions() == 20 and spread(rows.limit(0), "k").count() == 0
    assert extraction.entity_hints(spark, SF).rdd.getNumPartitions() == 3


def test_entities_work_numbers_and_windows_out_once(spark):
    docs = spark.createDataFrame([(1, "Nomor SPK : AB-123/9\nrekening Bank Mandiri no rekening 12-34-567890 a.n PT Kita Jaya, itu"), (2, None), (3, "")], "doc_id int, text string")
    found = entities.entities(docs)
    assert sorted((r.doc_id, r.field, r.value, r.line) for r in found.collect()) == [(1, "Nama Bank", "Bank Mandiri", 1), (1, "Nama Rekening Bank", "PT Kita Jaya", 1), (1, "Nomor Kontrak Kerja", "AB-123/9", 0), (1, "Nomor Rekening Bank", "12-34-567890", 1)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("{0,160}") == 1


def test_a_name_is_compared_once_for_its_copies():
    box = (0.1, 0.7, 0.4, 0.72)
    heads = [signatures.Line(1, "PT Satu Dua", (0.1, 0.6, 0.4, 0.62)), signatures.Line(1, "CV Tiga Empat", (0.6, 0.6, 0.9, 0.62))]
    lines = [*heads, signatures.Line(1, "ANDI WIJAYA", box), signatures.Line(1, "SITI RAHAYU", (0.6, 0.7, 0.9, 0.72))]
    sides = {"first": {"company": "PT Satu Dua", "name": None, "title": None}, "second": {"company": "CV Tiga Empat", "name": "Siti Rahayu", "title": "Staf"}}
    first = signatures.resolved(lines, sides)
    before = signatures.read_line.cache_info().misses, signatures.same_name.cache_info().misses
    assert signatures.resolved(lines, sides) == first and first["first"]["name"] == "ANDI WIJAYA" and first["first"]["change"] == "filled"
    assert (signatures.read_line.cache_info().misses, signatures.same_name.cache_info().misses) == before


def test_grouped_values_read_by_field():
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.list_(pa.struct([("c", pa.string())])))]))
    for rows in ([], [None], [[{"a": 1, "b": [{"c": "x"}, {"c": None}]}, None], None, [], [{"a": None, "b": None}]]):
        column = pa.array(rows, kind)
        assert groups.values(column) == column.to_pylist() == rows and groups.values(column.slice(1)) == rows[1:]


def test_a_handover_is_parsed_once(spark):
    plan = extraction.handover_conditions(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") <= 1


def test_evidence_is_planned_in_steps(spark):
    """A driver of 1,500 MB has room for each step's plan, not for one of all."""
    plan = extraction.evidence_located(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "parse" not in plan and plan.count("regexp") == 0 and len(plan) < 20_000


def test_evidence_broadcasts_no_table(spark, monkeypatch):
    """Documents made of a small file's rows look small to the planner; the driver would gather all of them."""
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    cut = evidence.cut
    monkeypatch.setattr(evidence, "cut", seen)
    for query in (extraction.evidence_located, extraction.field_evidence):
        plans.append(query(spark, SF)._jdf.queryExecution().executedPlan().toString())
    assert sum("Join" in p for p in plans) >= 4 and not any("Broadcast" in p for p in plans)
    assert max(len(p) for p in plans) < 30_000


def test_identifiers_and_runs_of_blocks(spark):
    """Skeletons and folds as they come of each piece by itself, and runs with a null text, a missing confidence and a page's end."""
    texts = ["K. TEL.05/HK-810, No 1 2345678", "a_b \u00e9\u00df9 x12 S0lB 77", "", " / ", "satu dua tiga", None]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", evidence._identifiers(F.coalesce("t", F.lit(""))).alias("i")).collect()
    for t, i in found:
        parts = re.split(r"\s{2,}|[,;()\[\]]", t or "") + [t or ""]
        split = [w for w in re.split(r"\s+", t or "") if w]
        parts += ["".join(split[a : a + n]) for n in (2, 3, 4) for a in range(len(split) - n + 1)]
        plain = ["".join(c for c in p if c.isalnum()) for p in parts]
        long = [p for p in plain if len(p.upper()) >= 6 and any(c.isdigit() or c in "OoIlSB" for c in p)]
        assert i.skeletons == list(dict.fromkeys(p.upper() for p in long)) and i.folds == list(dict.fromkeys(p.translate(str.maketrans("OoIlSB", "001158")).upper() for p in long))
    rows = [(1, "a", 1, 0, "x", 0.9), (1, "b", 1, 1, None, None), (1, "c", 1, 2, "z", 0.7), (1, "d", 2, 3, "w", 0.0)]
    runs = evidence.block_windows(spark.createDataFrame(rows, "doc int, block_id string, page int, ordinal int, text string, confidence double"), "doc", (1, 2, 3))
    assert sorted((r.start, r.size, ",".join(r.block_ids), r.text or "", r.confidence or 0, r.first_text or "") for r in runs.collect()) == [
        (0, 1, "a", "x", 0.9, "x"), (0, 2, "a,b", "x", 0.9, "x"), (0, 3, "a,b,c", "x z", 0.7, "x"), (1, 1, "b", "", 0, ""), (1, 2, "b,c", "z", 0.7, ""), (2, 1, "c", "z", 0.7, "z"), (3, 1, "d", "w", 0.0, "w")
    ]
