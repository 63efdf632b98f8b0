"""Layout geometry on pages: boxes normalised 0..1 from the top left, as columns x0, y0, x1, y1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lontar.functions.text import clean_ocr_line


def normalize_box(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, bottom_left: bool = False) -> Column:
    """A box in page shares: corners sorted, clamped to 0..1, rounded to five digits."""
    flip = lambda y: (height - y) if bottom_left else y
    clamp = lambda v: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)), 5)
    a, b, c, d = x0 / width, flip(y0) / height, x1 / width, flip(y1) / height
    return F.struct(clamp(F.least(a, c)).alias("x0"), clamp(F.least(b, d)).alias("y0"), clamp(F.greatest(a, c)).alias("x1"), clamp(F.greatest(b, d)).alias("y1"))


def overlap_share(a: Column, b: Column) -> Column:
    """The common area of two boxes as a share of the smaller one."""
    width = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    height = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    area = lambda r: (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
    return F.coalesce(width * height / F.nullif(F.least(area(a), area(b)), F.lit(0.0)), F.lit(0.0))


def same_row(a: Column, b: Column) -> Column:
    """Vertical overlap of more than half of the lower box's height."""
    shared = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    lower = F.least(a["y1"] - a["y0"], b["y1"] - b["y0"])
    return (lower > 0) & (shared > lower / 2)


def text_lines(boxes: DataFrame, keys: list[str], y_tolerance: float = 0.015, x_gap: float = 0.15) -> DataFrame:
    """Boxes put together to lines: neighbours in reading order whose centres are near or of which one reaches no further
    than the other, and that have no gap to the right beyond x_gap. Cleaned texts from left to right, mean confidence."""
    flow = Window.partitionBy(*keys).orderBy(F.bround(F.col("y0") / y_tolerance), "x0", "x1", "text")
    before = lambda c: F.lag(c).over(flow)
    centre = (F.col("y0") + F.col("y1")) / 2
    near = F.abs(centre - before(centre)) <= y_tolerance
    within = (F.col("y0") >= before("y0") - y_tolerance) & (F.col("y1") <= before("y1") + y_tolerance)
    joined = (near | within) & (F.col("x0") - before("x1") <= x_gap)
    lines = boxes.withColumn("line", F.sum((~F.coalesce(joined, F.lit(False))).cast("int")).over(flow.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "x1", "text"))), lambda x: x["text"]), " ")
    out = lines.groupBy(*keys, "line").agg(text.alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.avg("confidence").alias("confidence"))
    return out.withColumn("text", clean_ocr_line(F.regexp_replace("text", r"\s*:\s*", " : ")))


def reading_order(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """blocks with ``reading``: rank by vertical centre, then left edge, then the order they came in."""
    order = Window.partitionBy(*keys).orderBy((F.col("y0") + F.col("y1")) / 2, "x0", "ordinal")
    return blocks.withColumn("reading", F.row_number().over(order))


def inside(box: Column, region: Column, least: float = 0.6) -> Column:
    """At least that share of a box lies in a region."""
    width = F.greatest(F.lit(0.0), F.least(box["x1"], region["x1"]) - F.greatest(box["x0"], region["x0"]))
    height = F.greatest(F.lit(0.0), F.least(box["y1"], region["y1"]) - F.greatest(box["y0"], region["y0"]))
    area = (box["x1"] - box["x0"]) * (box["y1"] - box["y0"])
    return F.coalesce(width * height / F.nullif(area, F.lit(0.0)) >= least, F.lit(False))


def uncovered(boxes: DataFrame, regions: DataFrame, keys: list[str], least: float = 0.6) -> DataFrame:
    """Read boxes of a page that lie in none of its regions, and so were lost by the layout engine."""
    r = regions.select(*[F.col(k).alias(f"r_{k}") for k in keys], F.struct("x0", "y0", "x1", "y1").alias("region"))
    same = [F.col(k) == F.col(f"r_{k}") for k in keys]
    box = F.struct("x0", "y0", "x1", "y1")
    condition = inside(box, F.col("region"), least)
    for s in same:
        condition = s & condition
    return boxes.join(r, condition, "left_anti")


def covered_spans(spans: DataFrame, fills: DataFrame, keys: list[str], least: float = 0.9) -> DataFrame:
    """Text spans of a page (with seqno) that an opaque rectangle drawn later covers."""
    f = fills.select(*[F.col(k).alias(f"f_{k}") for k in keys], F.struct("x0", "y0", "x1", "y1").alias("fill"), F.col("seqno").alias("f_seqno"))
    condition = (F.col("f_seqno") > F.col("seqno")) & inside(F.struct("x0", "y0", "x1", "y1"), F.col("fill"), least)
    for k in keys:
        condition = (F.col(k) == F.col(f"f_{k}")) & condition
    return spans.join(f, condition, "left_semi")


def visual_box(box: Column) -> Column:
    """A box with sorted corners, clamped to the page and rounded to five digits; null without one."""
    clamp = lambda v: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)), 5)
    a, b, c, d = (clamp(box[k]) for k in ("x0", "y0", "x1", "y1"))
    return F.when(box.isNotNull(), F.struct(F.least(a, c).alias("x0"), F.least(b, d).alias("y0"), F.greatest(a, c).alias("x1"), F.greatest(b, d).alias("y1")))
