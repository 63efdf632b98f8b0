"""The registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "validation_report"


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def put(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str, least: int = 500, most: int = 20_000) -> DataFrame:
    """df dealt out by a key, as rows that are small in their file give long documents, and few bytes make few tasks.

    Four tasks a core of ``least`` rows or more, and more tasks rather than more than ``most`` rows in one.
    """
    rows = df.count()
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, min(4 * cores, -(-rows // least)), -(-rows // most)), key)


def parsed(df: DataFrame, json: Column, schema: str) -> DataFrame:
    """The columns of JSON texts, parsed once a row: as a generator's output they aren't put in the place of each use, as the optimizer does with a projection's."""
    return df.select(F.explode(F.array(F.from_json(json, schema))).alias("r")).select("r.*")


def grouped(number: Column) -> Column:
    """A whole number with dots between its thousands."""
    return F.translate(F.format_number(number.cast("decimal(20,0)"), 0), ",", ".")


def said(*parts) -> Column:
    """Texts and columns put together."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
