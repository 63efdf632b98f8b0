"""The corpus pipeline: every stage and the whole on planted, awkward and empty tables."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from lontar.llm import mixing
from tests.llm import fixtures

pipeline = pytest.importorskip("corpus_pipeline")
P = pytest.importorskip("public_tokenizers")

PARTS = {"en": ("the", "and", "thing", "tion"), "de": ("der", "und", "sch", "keit"), "fr": ("les", "eau", "ment", "oi")}


def words(r, lang, n):
    return ["".join(r.choice(PARTS[lang]) for _ in range(r.randint(2, 5))) for _ in range(n)]


def planted():
    """Documents, benchmark items, and what becomes of each document: kept, or the stage that drops it."""
    r = random.Random(11)
    rows, fate = [], {}
    item = " ".join(words(r, "en", 20))

    def add(text, lang, what):
        rows.append((len(rows), text, lang, "abc"[len(rows) % 3] if len(rows) % 10 else None))
        fate[len(rows) - 1] = what

    for i in range(90):
        add(" ".join(words(r, list(PARTS)[i % 3], r.choice((30, 80, 200)))), list(PARTS)[i % 3], "kept")
    for i in range(0, 40, 4):
        add(rows[i][1], rows[i][2], "near_dedup")
        near = rows[i][1].split(" ")
        near[len(near) // 2] = "theandthing"
        add(" ".join(near), rows[i][2], "near_dedup" if len(near) > 60 else None)
    for i in range(5):
        add(" ".join([*words(r, "de", 20), item, *words(r, "de", 20)]), "de", "decontamination")
    for text in (None, "", " \n\t", "12 34 !?", "0"):
        add(text, "en", "language_id")
    add("漢字 " * 3, None, None)
    return rows, [(1, item), (2, None), (3, "kurz")], fate


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows, items, fate = planted()
    where = tmp_path_factory.mktemp("sf")
    fixtures.documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return str(where), rows, fate


def test_stages_in_order(spark, tables):
    where, rows, fate = tables
    assert [name for name, _ in pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "mixing", "token_ids"] and pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{where}/documents.parquet")
    left = {d for d, *_ in rows}
    for name, stage in pipeline.STAGES[:3]:
        out = stage(spark, docs, where)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        kept = [x.doc_id for x in out.collect()]
        assert len(kept) == len(set(kept))
        gone = left - set(kept)
        assert {d for d in gone if fate[d] not in (name, None)} == set() and {d for d in left if fate[d] == name} <= gone
        left = set(kept)
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert {d for d, what in fate.items() if what == "kept"} <= left
    plan = {x.doc_id: x.taken // x.size for x in mixing.schedule(docs).collect() if x.taken}
    mixed = pipeline.mix_sources(spark, docs, where)
    assert mixed.columns == docs.columns and Counter(x.doc_id for x in mixed.collect()) == Counter(plan)


def test_whole_run(spark, tables):
    from tokenizers import Tokenizer

    where, rows, fate = tables
    library, texts = Tokenizer.from_file(P.path("byte_bpe_50k.json")), {d: t for d, t, *_ in rows}
    got = sorted(pipeline.run(spark, where).collect(), key=lambda x: x.start)
    assert [x.doc_id for x in got] == sorted(x.doc_id for x in got) and [x.start for x in got] == [sum(y.n_tokens for y in got[:k]) for k in range(len(got))]
    assert {x.doc_id for x in got} <= {d for d, what in fate.items() if what in ("kept", None)} and max(Counter(x.doc_id for x in got).values()) <= 2
    for x in got:
        ids = [*library.encode(texts[x.doc_id], add_special_tokens=False).ids, 0]
        assert (x.n_tokens, x.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert sorted(map(tuple, pipeline.run(spark, where).collect())) == sorted(map(tuple, got))


def test_awkward_and_empty_tables(spark, tables, tmp_path):
    where, *_ = tables
    wide = fixtures.documents(spark)  # clashing columns, nulls, repeated rows
    for docs in (wide, wide.limit(0)):
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, where)
            assert out.columns == (docs.columns if name != "token_ids" else ["doc_id", "start", "n_tokens", "ids_crc32"])
            assert out.count() <= 2 * wide.count() and (docs is wide or out.count() == 0)
    fixtures.documents(spark, []).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
