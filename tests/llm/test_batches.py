"""Sizes of what Python workers hold at once."""

from __future__ import annotations

import glob

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from lontar.llm import lm_score, scratch
from tests.llm import fixtures


def test_a_batch_of_large_rows_is_bounded_by_bytes(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], names=["n"])

    rows = spark.range(0, 12, 1, 1).select(F.repeat(F.lit("x"), 1_000_000).alias("t"))
    with scratch.batch_bytes(spark, 3_000_000):
        assert [r.n for r in rows.mapInArrow(sizes, "n long").collect()] == [3, 3, 3, 3]


def test_scores_are_made_in_bounded_batches(spark):
    """No caller's batch size holds for chunks of some MB: the returned plan runs no Python any more."""
    some = fixtures.documents(spark, [(k, f"satu dua {k}", "id", "a") for k in range(20)])
    got = lm_score.score(some, lm_score.Rules(filter_bits=20, head=64, slice_docs=4, bits_an_entry=40))
    assert "MapInArrow" not in got._jdf.queryExecution().toString() and got.count() == 20


def test_row_groups_of_large_rows_are_bounded_by_bytes(spark):
    """A reader holds a whole row group; by default none ends before 100 rows, also of some MB each."""
    rows = spark.range(0, 12, 1, 1).select("id", F.expr("encode(array_join(transform(sequence(1, 20000), i -> md5(cast(id * 20000 + i as string))), ''), 'utf-8')").alias("b"))
    groups = lambda df: [pq.ParquetFile(f).num_row_groups for f in sorted(glob.glob(f"{df.lontar_path}/*.parquet".removeprefix("file:")))]
    small, whole = scratch.table(rows, "test", 500_000), scratch.table(rows, "test")
    assert groups(whole) == [1] and groups(small)[0] >= 6 and small.exceptAll(rows).count() == 0 == rows.exceptAll(small).count()
    scratch.drop(small, whole)


def test_one_chunk_fills_a_batch_of_scores():
    """Chunks are of up to 4 MB of text; several in one batch, with the answers to them, are held in the JVM and in Python at once."""
    assert lm_score.BATCH_BYTES <= lm_score.CHUNK_BYTES and lm_score.GROUP_BYTES <= lm_score.CHUNK_BYTES
