"""Pages of a document: repeated tails, coverage of rendered text, sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lontar.functions.text import jaccard, long_words

PAGE_BREAK = "<!-- PAGE BREAK -->"


def pages(docs: DataFrame, key: str = "doc_id", text: str = "text", separator: str = PAGE_BREAK) -> DataFrame:
    """key, page (from 1) and text of every page."""
    return docs.select(key, F.posexplode(F.split(F.col(text), F.lit(separator.replace("|", r"\|")), -1)).alias("page", "text")).withColumn("page", F.col("page") + 1)


def duplicate_tail(paged: DataFrame, key: str = "doc_id", similarity: float = 0.6) -> DataFrame:
    """key and kept: the number of pages before a tail that repeats the first pages.

    The smallest k such that every page after k is like the page k before it (Jaccard of its words), the tail has two
    pages at least and is no longer than what it repeats. One self-join on page pairs of a document; k is their distance.
    """
    p = paged.select(key, "page", long_words(F.col("text")).alias("w"))
    count = p.groupBy(key).agg(F.max("page").alias("pages")).withColumnRenamed(key, "k_doc")
    a, b = p.alias("a"), p.alias("b")
    k = F.col("b.page") - F.col("a.page")
    near = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("b.page") > F.col("a.page"))).join(count, F.col(f"a.{key}") == F.col("k_doc"))
    near = near.filter((F.col("pages") - k >= 2) & (F.col("pages") - k <= k) & (F.col("b.page") > k))  # before any words are compared
    tails = near.select(F.col(f"a.{key}").alias(key), k.alias("k"), ((F.size("b.w") > 0) & (jaccard(F.col("a.w"), F.col("b.w")) >= similarity)).alias("like"))
    return tails.groupBy(key, "k").agg(F.bool_and("like").alias("ok")).filter("ok").groupBy(key).agg(F.min("k").cast("int").alias("kept"))


def word_counts(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, word and n: the multiset of words of three letters or digits at least."""
    return df.select(*keys, F.explode(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("[a-z0-9]{3,}"), F.lit(0))).alias("word")).groupBy(*keys, "word").agg(F.count("*").alias("n"))


def coverage(source: DataFrame, rendered: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, words, missing and coverage: the share of the source's word multiset that the rendered text has."""
    left = word_counts(source, keys, text).withColumnRenamed("n", "have")
    right = word_counts(rendered, keys, text).withColumnRenamed("n", "got")
    lost = left.join(right, [*keys, "word"], "left").withColumn("lost", F.greatest(F.col("have") - F.coalesce("got", F.lit(0)), F.lit(0)))
    return lost.groupBy(*keys).agg(F.sum("have").alias("words"), F.sum("lost").alias("missing")).withColumn("coverage", 1 - F.col("missing") / F.col("words"))


def missing_words(source: DataFrame, rendered: DataFrame, keys: list[str], text: str = "text", top: int = 10) -> DataFrame:
    """The most frequent missing words of each key."""
    left = word_counts(source, keys, text).withColumnRenamed("n", "have")
    right = word_counts(rendered, keys, text).withColumnRenamed("n", "got")
    lost = left.join(right, [*keys, "word"], "left").withColumn("lost", F.greatest(F.col("have") - F.coalesce("got", F.lit(0)), F.lit(0))).filter("lost > 0")
    order = Window.partitionBy(*keys).orderBy(F.desc("lost"), "word")
    return lost.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select(*keys, "word", "lost", "rank")


def sections(lines: DataFrame, key: str, order: str, starts: Column) -> DataFrame:
    """Each row's section number and the next section's first place: a section runs from its start to the next start."""
    flow = Window.partitionBy(key).orderBy(order)
    marked = lines.withColumn("section", F.sum(starts.cast("int")).over(flow.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.filter("section > 0").groupBy(key, "section").agg(F.min(order).alias("begins"), F.max(order).alias("ends"), F.count("*").alias("lines"))


def repeated_half(paged: DataFrame, key: str = "doc_id", least: int = 80) -> DataFrame:
    """Documents whose second half repeats the first page by page (pages of ``least`` characters at least), with the pages of one copy."""
    p = paged.select(key, "page", F.md5("text").alias("h"), F.length("text").alias("n"))
    half = p.groupBy(key).agg(F.max("page").alias("pages")).filter("pages > 1 and pages % 2 = 0").select(key, (F.col("pages") / 2).cast("int").alias("half"))
    a, b = p.join(half, key).filter("page <= half"), p.select(key, (F.col("page")).alias("other"), F.col("h").alias("h2"))
    both = a.join(b, key).filter(F.col("other") == F.col("page") + F.col("half"))
    return both.groupBy(key, "half").agg(F.bool_and((F.col("h") == F.col("h2")) & (F.col("n") >= least)).alias("same")).filter("same").select(key, F.col("half").alias("original_pages"))


def page_needs_ocr(chars: Column, coverage: Column) -> Column:
    """A page with little text of its own, or some text under a large image."""
    return (chars < 80) | ((coverage > 0.6) & (chars < 240))


def without_copies(paged: DataFrame, key: str = "doc_id") -> DataFrame:
    """The pages of every document without a tail that repeats its first pages."""
    kept = duplicate_tail(paged, key)
    return paged.join(kept, key, "left").filter(F.col("kept").isNull() | (F.col("page") <= F.col("kept"))).drop("kept")
