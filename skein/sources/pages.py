"""Pages as an OCR service delivers them: JSON with blocks, lines, tables and pictures, read with a fixed schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BOX = "boundingBox struct<vertices: array<struct<x: string, y: string>>>"
#: Numbers come as strings or numbers, so they are read as strings and cast.
PAGE = f"""result struct<textAnnotation: struct<width: string, height: string,
  blocks: array<struct<{_BOX.replace(' ', ': ', 1)}, layoutType: string, lines: array<struct<{_BOX.replace(' ', ': ', 1)}, text: string>>>>,
  tables: array<struct<{_BOX.replace(' ', ': ', 1)}, cells: array<struct<rowIndex: string, columnIndex: string, rowSpan: string, columnSpan: string, text: string>>>>,
  pictures: array<struct<{_BOX.replace(' ', ': ', 1)}, score: string, confidence: string>>>>"""
# Captions of tables and their continuations, headings.
CAPTION = r"(?iu)^\s*(?:табл(?:ица|\.)|(?:продолжение|окончание)\s+табл)"
CONTINUATION = r"(?iu)^\s*(?:продолжение|окончание)\s+табл"
HEADING = r"^(\d+(?:\.\d+)*)\.?(?:\s+|$)(.*)$"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Files of one page a line, each with doc and page beside the service's result: doc, page, content."""
    rows = spark.read.schema(f"doc string, page int, {PAGE}").json(path)
    return rows.select("doc", "page", F.struct("result").alias("content"))


def parse_pages(pages: DataFrame) -> DataFrame:
    """doc, page and the content parsed from a string; what is no JSON is null."""
    return pages.select("doc", "page", F.from_json("content", PAGE).alias("content"))


def box(vertices: Column) -> Column:
    """The rectangle around vertices; zeros without any."""
    side = lambda pick, name: F.coalesce(pick(F.transform(vertices, lambda v: F.coalesce(v[name].try_cast("double"), F.lit(0.0)))), F.lit(0.0))
    return F.struct(side(F.array_min, "x").alias("x0"), side(F.array_min, "y").alias("y0"), side(F.array_max, "x").alias("x1"), side(F.array_max, "y").alias("y1"))


def _around(boxes: Column) -> Column:
    side = lambda pick, name: pick(F.transform(boxes, lambda b: b[name]))
    return F.struct(side(F.array_min, "x0").alias("x0"), side(F.array_min, "y0").alias("y0"), side(F.array_max, "x1").alias("x1"), side(F.array_max, "y1").alias("y1"))


def block_text(lines: Column) -> Column:
    """The lines' texts with one blank between; blank lines fall away."""
    return F.array_join(F.filter(F.transform(lines, lambda x: F.regexp_replace(F.coalesce(x["text"], F.lit("")), r"^\s+|\s+$", "")), lambda t: t != ""), " ")


def page_tables(pages: DataFrame) -> DataFrame:
    """doc, page, table_index, bbox, cells (row, col, rowspan, colspan, text) of parsed pages."""
    rows = pages.select("doc", "page", F.posexplode("content.result.textAnnotation.tables").alias("table_index", "t"))
    number = lambda x, default: F.coalesce(x.try_cast("int"), F.lit(default))
    cells = F.transform(
        "t.cells",
        lambda c: F.struct(
            number(c["rowIndex"], 0).alias("row"), number(c["columnIndex"], 0).alias("col"), number(c["rowSpan"], 1).alias("rowspan"), number(c["columnSpan"], 1).alias("colspan"),
            F.trim(F.replace(F.coalesce(c["text"], F.lit("")), F.lit("\n"), F.lit(" "))).alias("text"),
        ),
    )
    return rows.select("doc", "page", "table_index", box(F.col("t.boundingBox.vertices")).alias("bbox"), cells.alias("cells"))


def page_blocks(pages: DataFrame) -> DataFrame:
    """doc, page, pos, y, layout_type, text, bbox, heading_level, heading_number, is_table_caption, is_continuation_caption.

    Blocks that lie within the height of a table of their page are left out. A section header is a numbered
    heading if it starts in the left half, has under 100 characters and 10 words, and no other block begins
    within 15 pixels of its height. A page's blocks are compared within the page's row.
    """
    annotation = "content.result.textAnnotation"
    drawn = F.transform(f"{annotation}.blocks", lambda b: F.struct(b.alias("raw"), F.when(F.size(b["lines"]) > 0, _around(F.transform(b["lines"], lambda x: box(x["boundingBox"]["vertices"])))).otherwise(box(b["boundingBox"]["vertices"])).alias("bbox")))
    boxes = F.coalesce(F.transform(f"{annotation}.tables", lambda t: box(t["boundingBox"]["vertices"])), F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>"))
    rows = pages.select("doc", "page", F.col(f"{annotation}.width").try_cast("double").alias("width"), drawn.alias("drawn"), boxes.alias("boxes"))
    rows = rows.withColumn("ys", F.transform("drawn", lambda d: d["bbox"]["y0"])).select("doc", "page", "width", "boxes", "ys", F.posexplode("drawn").alias("pos", "d"))
    b = F.col("d.bbox")
    rows = rows.where(~F.exists("boxes", lambda t: (b["y0"] >= t["y0"]) & (b["y1"] <= t["y1"]) & (b["y1"] > b["y0"])))
    rows = rows.select("doc", "page", "pos", "width", "ys", b.alias("bbox"), F.coalesce("d.raw.layoutType", F.lit("")).alias("layout"), block_text(F.col("d.raw.lines")).alias("text"))
    near = F.exists("ys", lambda y: (y != F.col("bbox.y0")) & (F.abs(y - F.col("bbox.y0")) <= 15))
    title = F.trim(F.regexp_extract("text", HEADING, 2))
    heading = F.col("layout").endswith("SECTION_HEADER") & (title != "") & (F.length("text") < 100) & (F.size(F.split("text", r"\s+")) < 10) & (F.col("bbox.x0") < 0.5 * F.col("width")) & ~near
    number = F.when(F.coalesce(heading, F.lit(False)), F.regexp_extract("text", HEADING, 1))
    continuation = F.col("text").rlike(CONTINUATION)
    return rows.select(
        "doc", "page", "pos", F.col("bbox.y0").alias("y"), F.regexp_replace("layout", "^LAYOUT_TYPE_", "").alias("layout_type"), "text", "bbox",
        F.size(F.split(number, r"\.")).alias("heading_level"), number.alias("heading_number"),
        (F.col("text").rlike(CAPTION) | F.col("layout").endswith("CAPTION")).alias("is_table_caption"), continuation.alias("is_continuation_caption"),
    )
