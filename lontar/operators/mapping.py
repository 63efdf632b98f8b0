"""Relational mapping: upserts by natural key, stale rows, human-verified values, review views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RISK = {"bertentangan": 1, "tidak_ada_di_dokumen": 2, "perlu_dicek": 3, "bukti_cukup": 4, "bukti_kuat": 5}


def upsert(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """target after writing rows: those with a known natural key replace it, the others are added; repeated keys keep the last by ordinal."""
    ordinal = "_ordinal" in rows.columns
    if ordinal:
        newest = Window.partitionBy(*keys).orderBy(F.desc("_ordinal"))
        rows = rows.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n", "_ordinal")
    return target.join(rows.select(*keys), keys, "left_anti").unionByName(rows)


def plan_upsert(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and action (insert or update) for every row to write."""
    known = target.select(*keys).distinct().withColumn("_known", F.lit(True))
    return rows.select(*keys).distinct().join(known, keys, "left").select(*keys, F.when(F.col("_known"), "update").otherwise("insert").alias("action"))


def stale(target: DataFrame, rows: DataFrame, parent: list[str], keys: list[str]) -> DataFrame:
    """Child rows of written parents that the new rows don't have any more."""
    return target.join(rows.select(*parent).distinct(), parent, "left_semi").join(rows.select(*keys), keys, "left_anti")


def orphans(children: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """Children whose reference has no parent; must be empty before a write."""
    return children.join(parents.select(*keys), keys, "left_anti")


def still_referenced(gone: DataFrame, references: dict[str, tuple[DataFrame, str]], key: str) -> DataFrame:
    """Rows about to be deleted that another table still refers to, with that table's name; must be empty before a delete."""
    out = None
    for name, (rows, column) in references.items():
        held = gone.select(key).join(rows.select(F.col(column).alias(key)), key, "left_semi").select(key, F.lit(name).alias("referenced_by"))
        out = held if out is None else out.unionByName(held)
    return out


def guarded(payload: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """Documents of a payload that already carry human decisions; must be empty before a write."""
    return payload.join(reviews.filter("decision is not null"), key, "left_semi").select(key).distinct()


def verified(fields: DataFrame, reviews: DataFrame, keys: list[str]) -> DataFrame:
    """The values that people confirmed: a decision counts if it saw the present value (null equals null); the last valid one wins.

    "benar" confirms the system's value, "dikoreksi" gives its final text; a later rejection doesn't cancel an earlier acceptance.
    """
    valid = reviews.join(fields.select(*keys, "value"), keys).filter(F.col("decision").isin("benar", "dikoreksi") & F.col("seen_value").eqNullSafe(F.col("value")))
    last = valid.groupBy(*keys).agg(F.max_by(F.struct("decision", "final_value", "value"), "ordinal").alias("r"))
    return last.select(*keys, F.when(F.col("r.decision") == "dikoreksi", F.col("r.final_value")).otherwise(F.col("r.value")).alias("value"), F.col("r.decision").alias("decision"))


def rows_unchanged(snapshot: Column, quantity: Column, unit: Column, price: Column, total: Column) -> Column:
    """A row snapshot "q unit x price = total" still says what the row says; an unreadable one doesn't."""
    part = lambda k: F.nullif(F.regexp_extract(snapshot, r"^\s*([\d.]+)\s+(.*?)\s+x\s+([\d.]+)\s*=\s*([\d.]+)\s*$", k), F.lit(""))
    number = lambda k: part(k).cast("double")
    return F.coalesce(snapshot.rlike(r"^\s*[\d.]+\s+.*?\s+x\s+[\d.]+\s*=\s*[\d.]+\s*$"), F.lit(False)) & number(1).eqNullSafe(quantity) & part(2).eqNullSafe(unit) & number(3).eqNullSafe(price) & number(4).eqNullSafe(total)


def risk_order(status: Column) -> Column:
    whens = None
    for name, n in RISK.items():
        whens = F.when(status == name, n) if whens is None else whens.when(status == name, n)
    return whens.otherwise(6)


def arithmetic_check(quantity: Column, price: Column, period: Column, total: Column) -> Column:
    """cocok where quantity x price (x period) rounds to the total, else "cek hitungan"; empty where something isn't written."""
    same = (F.round(quantity * price) == F.round(total)) | F.coalesce(F.round(quantity * price * period) == F.round(total), F.lit(False))
    return F.when(quantity.isNull() | price.isNull() | total.isNull(), "").when(same, "cocok").otherwise("cek hitungan")


def review_progress(fields: DataFrame, reviews: DataFrame, key: str, path: str) -> DataFrame:
    """Per document: fields, decided ones and progress in percent."""
    decided = reviews.filter("decision is not null").select(key, path).distinct().withColumn("_d", F.lit(1))
    return fields.join(decided, [key, path], "left").groupBy(key).agg(F.count("*").alias("fields"), F.count("_d").alias("decided"), F.round(100 * F.count("_d") / F.count("*"), 1).alias("progress"))


def compare_schemas(expected: DataFrame, actual: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Full outer comparison: missing, unexpected or different."""
    e, a = expected.select(*keys, F.col(column).alias("_e")), actual.select(*keys, F.col(column).alias("_a"))
    state = F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").when(F.col("_e") != F.col("_a"), "different")
    return e.join(a, keys, "full").withColumn("state", state).filter("state is not null").select(*keys, "state")


def company_roles(parties: DataFrame, key: str, ours: str) -> DataFrame:
    """The party whose name fits our pattern performs, the other one orders; without a match the second performs."""
    mine = lambda c: F.coalesce(F.col(c).rlike(ours), F.lit(False))
    first = mine("first_name") & ~mine("second_name")
    return parties.select(key, F.when(first, "pelaksana").otherwise("pemberi").alias("first_role"), F.when(first, "pemberi").otherwise("pelaksana").alias("second_role"), (mine("first_name") == mine("second_name")).alias("uncertain"))
