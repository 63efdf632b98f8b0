"""Readers and sinks: binary documents, parsed JSON, Markdown files, partitioned results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Block types by the names that layout engines give.
BLOCK_TYPES = {
    "title": "title", "document_title": "title", "section_header": "section_header", "heading": "section_header", "paragraph": "paragraph", "text": "paragraph", "list": "list", "list_item": "list",
    "table": "table", "table_cell": "table_cell", "page_header": "header", "header": "header", "page_footer": "footer", "footer": "footer", "footnote": "footer", "caption": "caption",
    "picture": "image", "image": "image", "figure": "image", "signature": "signature", "attestation": "signature", "key_value": "key_value", "form": "key_value",
}


def binary_documents(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".pdf",), most_bytes: int = 50_000_000) -> DataFrame:
    """document_id (from the content's digest), path, length and content of every allowed file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    allowed = F.lower(F.col("path")).rlike("(?:" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$")
    return files.filter(allowed & (F.col("length") <= most_bytes)).select(document_id(F.col("content")).alias("document_id"), "path", "length", "content")


def document_id(content: Column) -> Column:
    """An id that depends on the bytes only."""
    return F.concat(F.lit("doc-"), F.substring(F.sha2(content, 256), 1, 16))


def fallback_id(name: Column, text: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws(":", name, F.length(text).cast("string"), F.substring(text, 1, 500))), 1, 12)


def block_type(raw: Column) -> Column:
    table = F.create_map(*[x for k, v in BLOCK_TYPES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(table, F.lower(raw)), F.lit("unknown"))


#: A parsed response: pages with blocks, each with its box, confidence and range of the Markdown.
PARSED = (
    "markdown string, metadata struct<parser_engine:string,model_version:string,is_scanned:boolean>, structure struct<children:array<struct<grounding:struct<page:int>,"
    "children:array<struct<id:string,type:string,text:string,confidence:double,grounding:struct<page:int,confidence:double,box:struct<xmin:double,ymin:double,xmax:double,ymax:double>,range:struct<start:int,end:int>>>>>>>"
)


def parsed_blocks(parsed: DataFrame, name: str = "file_name") -> DataFrame:
    """document_id, block_id, page, ordinal, type, raw_type, text, box, engine, confidence and range of every block with text.

    parsed: PARSED's columns, the file's name, and its document_id if known (else one from the name and the text). A range
    must be a part of the Markdown; where a block has no text, it is read from there.
    """
    own = F.col("document_id") if "document_id" in parsed.columns else F.lit(None).cast("string")
    md = F.coalesce("markdown", F.lit(""))
    file = F.regexp_extract(F.col(name), r"([^/]*)$", 1)
    engine = F.coalesce("metadata.parser_engine", "metadata.model_version", F.lit("external"))
    pages = parsed.select(F.coalesce(own, F.concat(F.lit("doc-"), fallback_id(file, md))).alias("document_id"), md.alias("md"), engine.alias("engine"), F.posexplode("structure.children").alias("p", "page"))
    blocks = pages.select("document_id", "md", "engine", "p", F.coalesce("page.grounding.page", F.col("p") + 1).alias("page"), F.posexplode("page.children").alias("b", "x"))
    r = F.col("x.grounding.range")
    part = (r["start"] >= 0) & (r["start"] < r["end"]) & (r["end"] <= F.length("md")) & (r["end"] - r["start"] < F.length("md"))
    text = F.trim(F.coalesce("x.text", F.lit("")))
    read = F.when(text != "", text).when(part, F.trim(F.substr(F.col("md"), r["start"] + 1, r["end"] - r["start"]))).otherwise("")
    box = F.col("x.grounding.box")
    found = blocks.withColumn("read", read).filter("read <> ''")
    sides = F.struct(F.least(box["xmin"], box["xmax"]).alias("x0"), F.least(box["ymin"], box["ymax"]).alias("y0"), F.greatest(box["xmin"], box["xmax"]).alias("x1"), F.greatest(box["ymin"], box["ymax"]).alias("y1"))
    order = F.row_number().over(Window.partitionBy("document_id").orderBy("p", "b")) - 1
    return found.select(
        "document_id", F.coalesce("x.id", F.concat(F.lit("p"), F.col("page").cast("string"), F.lit("-b"), F.col("b").cast("string"))).alias("block_id"), "page", order.alias("ordinal"), block_type(F.col("x.type")).alias("type"), F.col("x.type").alias("raw_type"),
        F.col("read").alias("text"), F.when(box.isNotNull(), sides).alias("box"), "engine", F.coalesce(F.nullif("x.grounding.confidence", F.lit(0.0)), F.col("x.confidence")).alias("confidence"), F.when(part, r).alias("range"),
    )


def reading_quality(report: Column) -> Column:
    """A struct (mean, low, layout, ocr, text) of a reader's report: grades it knows, scores to three digits, NaN as null; null without a grade."""
    grade = lambda c: F.when(F.lower(c).isin("poor", "fair", "good", "excellent"), F.lower(c))
    points = lambda c: F.when(~F.isnan(c), F.round(c, 3))
    mean, low = grade(report["mean_grade"]), grade(report["low_grade"])
    return F.when(mean.isNotNull() | low.isNotNull(), F.struct(mean.alias("mean"), low.alias("low"), points(report["layout_score"]).alias("layout"), points(report["ocr_score"]).alias("ocr"), points(report["parse_score"]).alias("text")))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files, one a row."""
    return spark.read.option("wholetext", "true").text(path).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def json_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def write_results(df: DataFrame, path: str, partition: str | None = None, form: str = "parquet") -> None:
    """Results by document type (or another column), replacing what the path held."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).format(form).save(path)


def leaves(df: DataFrame, key: str) -> DataFrame:
    """key, path, value_text of every leaf of nested columns, paths as a.b and a[i].b; the schema names them, no row is looked at."""
    from pyspark.sql import types as T

    parts = []

    def visit(kind, column: Column, path: Column) -> Column:
        if isinstance(kind, T.StructType):
            return F.concat(*[visit(f.dataType, column[f.name], F.concat(path, F.lit("." + f.name))) for f in kind.fields])
        if isinstance(kind, T.ArrayType):
            return F.coalesce(F.flatten(F.transform(column, lambda x, i: visit(kind.elementType, x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))), F.array().cast("array<struct<path:string,value:string>>"))
        return F.array(F.struct(path.alias("path"), column.cast("string").alias("value")))

    for f in df.schema.fields:
        if f.name != key:
            parts.append(visit(f.dataType, F.col(f.name), F.lit(f.name)))
    return df.select(key, F.explode(F.concat(*parts)).alias("leaf")).select(key, "leaf.path", F.col("leaf.value").alias("value_text"))
