"""Pages as a scan delivers them: headings, tables, captions, reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pages of the scans, in pixels.
PAGE_WIDTH, PAGE_HEIGHT = 1654.0, 2339.0
_CAPTION = r"^\s*(?:Табл(?:ица|\.)|Продолжение\s+табл|Окончание\s+табл)"
_NUMBER = r"((?:[А-Я]\.)?\d+(?:\.\d+)*)"


def column_count(cells: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(cells, lambda c: c["col"] + F.coalesce(c["colspan"], F.lit(1)))), F.lit(0))


def headings(blocks: DataFrame) -> DataFrame:
    """Numbered headings: block_id, doc_key, page, number, title.

    A heading begins with a number and a letter after it, has under 100 characters and under 10 words,
    starts in the left half, is on a line end to end and stands alone within 15 pixels of height.
    """
    near = Window.partitionBy("doc_key", "page").orderBy(F.col("y").cast("double")).rangeBetween(-15, 15)
    line = F.trim("text")
    pattern = r"^((?:[А-Я]\.)?\d+(?:\.\d+)*)\.\s+(\p{L}[^\n]*)$"
    distinct = blocks.dropDuplicates(["doc_key", "page", "pos"])
    found = distinct.select("block_id", "doc_key", "page", "y", "bbox", "layout_type", line.alias("line"), F.count(F.lit(1)).over(near).alias("on_line"))
    good = (F.length("line") < 100) & (F.size(F.split("line", r"\s+")) < 10) & (F.col("bbox.x0") < PAGE_WIDTH / 2) & (F.col("on_line") == 1) & F.col("line").rlike(pattern)
    return found.where(good).select("block_id", "doc_key", "page", F.regexp_extract("line", pattern, 1).alias("number"), F.regexp_extract("line", pattern, 2).alias("title"))


def outside_tables(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """Blocks that do not lie wholly within the height of a table of their page."""
    spans = tables.select("doc_key", "page", F.col("bbox.y0").alias("t0"), F.col("bbox.y1").alias("t1")).distinct()
    inside = (blocks["doc_key"] == spans["doc_key"]) & (blocks["page"] == spans["page"]) & (blocks["bbox.y0"] >= spans["t0"]) & (blocks["bbox.y1"] <= spans["t1"])
    return blocks.join(spans, inside, "left_anti")


def captions_above(tables: DataFrame, blocks: DataFrame) -> DataFrame:
    """The nearest caption block that begins above each table of its page: table_id, caption_block.

    A caption with the top of another table between it and the table belongs to that one.
    """
    some = blocks.where(F.coalesce("is_table_caption", F.lit(False)) | F.coalesce("is_continuation_caption", F.lit(False)) | (F.col("layout_type") == "CAPTION") | F.col("text").rlike(_CAPTION))
    some = some.select("doc_key", "page", "block_id", F.col("bbox.y0").alias("begins"))
    place = ["doc_key", "page", "top"]
    rows = tables.select("table_id", "doc_key", "page", F.col("bbox.y0").alias("top"))
    tops = rows.select(*place).distinct().withColumn("other", F.lag("top").over(Window.partitionBy("doc_key", "page").orderBy("top")))
    both = rows.join(tops, place, "left").join(some, ["doc_key", "page"], "left")
    above = (F.col("begins") < F.col("top")) & F.coalesce(F.col("begins") >= F.col("other"), F.lit(True))
    return both.groupBy("table_id").agg(F.max_by(F.when(above, F.col("block_id")), F.when(above, F.struct("begins", -F.col("block_id")))).alias("caption_block"))


def stitch_groups(tables: DataFrame) -> DataFrame:
    """Parts of one table over several pages: table_id, group (from 1 within its document), part.

    In order of page and index a continuation with the number of the group's first table joins the group;
    so does a table without caption that lies under the one before it: on the next page, with as many
    columns, over half of the wider one's width, where the one before reached the last quarter. A caption
    that is no continuation, and anything else, opens a group.
    """
    order = Window.partitionBy("doc_key").orderBy("page", "table_index", "table_id")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    captioned = F.coalesce(F.col("caption") != "", F.lit(False))
    rows = tables.select("table_id", "doc_key", "page", "table_index", "caption", "table_num", "bbox", F.coalesce("is_continuation", F.lit(False)).alias("goes_on"), column_count(F.col("cells")).alias("columns"))
    rows = rows.withColumn("before", F.lag(F.struct("page", "bbox", "columns")).over(order))
    b, p = F.col("bbox"), F.col("before.bbox")
    overlap = F.least(b["x1"], p["x1"]) - F.greatest(b["x0"], p["x0"])
    same = (F.col("page") == F.col("before.page") + 1) & (F.col("columns") == F.col("before.columns")) & (p["y1"] >= 0.75 * PAGE_HEIGHT)
    span = F.greatest(b["x1"] - b["x0"], p["x1"] - p["x0"])
    same = same & (overlap > 0) & (overlap >= 0.5 * span)
    rows = rows.withColumn("under", ~captioned & F.coalesce(same, F.lit(False)))
    # Whatever is not just put under the table before leaves its own number as the group's, joined or not.
    head = F.last(F.when(~F.col("under"), F.struct("table_num")), ignorenulls=True).over(past)
    goes_on = F.col("goes_on") & head.isNotNull() & F.col("table_num").eqNullSafe(head["table_num"])
    rows = rows.withColumn("opens", F.when(F.col("under") | goes_on, 0).otherwise(1))
    rows = rows.withColumn("group", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    part = F.row_number().over(Window.partitionBy("doc_key", "group").orderBy("page", "table_index", "table_id"))
    return rows.select("table_id", "doc_key", "group", part.alias("part"))


def table_rows(tables: DataFrame) -> DataFrame:
    """The rows of each table's matrix: table_id, row, cells (array of texts by column). Spans repeat their text; the first of two texts in one place wins."""
    cells = tables.select("table_id", F.posexplode("cells").alias("pos", "c"))
    down = F.sequence(F.col("c.row"), F.col("c.row") + F.greatest(F.coalesce("c.rowspan", F.lit(1)), F.lit(1)) - 1)
    right = F.sequence(F.col("c.col"), F.col("c.col") + F.greatest(F.coalesce("c.colspan", F.lit(1)), F.lit(1)) - 1)
    spread = cells.select("table_id", "pos", "c.text", F.explode(down).alias("row"), right.alias("cols")).select("*", F.explode("cols").alias("col"))
    text = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce("text", F.lit(""))), r"\s*\n\s*", " "), r"\|", r"\\|")
    matrix = spread.groupBy("table_id", "row", "col").agg(F.min_by(text, F.struct((text == "").cast("int"), "pos")).alias("text"))
    lines = matrix.groupBy("table_id", "row").agg(F.sort_array(F.collect_list(F.struct("col", "text"))).alias("cells"))
    return lines.select("table_id", "row", F.transform("cells", lambda c: c["text"]).alias("cells"))


def _pipe_line(first: Column) -> Column:
    line = F.concat(F.lit("| "), F.array_join("cells", " | "), F.lit(" |"))
    return F.when(first, F.concat(line, F.lit("\n|"), F.repeat(F.lit("---|"), F.size("cells")))).otherwise(line)


def table_markdown(tables: DataFrame) -> DataFrame:
    """Each table's cells as a pipe table: table_id, markdown."""
    made = table_rows(tables).select("table_id", "row", _pipe_line(F.col("row") == 0).alias("line"))
    return made.groupBy("table_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n").alias("markdown"))


def stitched_tables(tables: DataFrame) -> DataFrame:
    """Tables over several pages as one pipe table each: doc_key, group, caption, n_parts, markdown.

    Parts follow each other as in stitch_groups; of a later part, the leading rows that repeat those of the
    first (without regard to case) fall away, other equal rows stay. The caption is the first part's.
    """
    groups = stitch_groups(tables)
    rows = table_rows(tables).join(groups, "table_id").withColumn("sign", F.lower(F.array_join("cells", "|")))
    heads = rows.where("part = 1").select("doc_key", "group", "row", F.col("sign").alias("head_sign"))
    rows = rows.join(heads, ["doc_key", "group", "row"], "left")
    so_far = Window.partitionBy("doc_key", "group", "part").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.max((~F.col("sign").eqNullSafe(F.col("head_sign"))).cast("int")).over(so_far)
    kept = rows.withColumn("own", own).where("part = 1 OR own = 1")
    lines = F.sort_array(F.collect_list(F.struct("part", "row", _pipe_line((F.col("part") == 1) & (F.col("row") == 0)).alias("line"))))
    made = kept.groupBy("doc_key", "group").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("markdown"))
    about = groups.join(tables.select("table_id", "caption"), "table_id").groupBy("doc_key", "group").agg(F.min_by("caption", "part").alias("caption"), F.count(F.lit(1)).alias("n_parts"))
    return about.join(made, ["doc_key", "group"], "left").select("doc_key", "group", "caption", "n_parts", "markdown")


NOTE = r"(?iu)^(?:П\s*р\s*и\s*м\s*е\s*ч\s*а\s*н\s*и\s*[ея]|Примечани[ея])"


def table_notes(tables: DataFrame) -> DataFrame:
    """The note that a table's last row is: table_id, note; tables without one are left out.

    A row is a note if its first cell says so, or if all its cells with text, two at least, say the same.
    Tables of one row have none.
    """
    last = table_rows(tables).groupBy("table_id").agg(F.max_by("cells", "row").alias("cells"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = F.get("cells", F.lit(0))
    extra = F.filter(F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(0))), lambda c: (c != "") & (c != first))
    full = F.filter("cells", lambda c: c != "")
    alike = (F.size(full) >= 2) & (F.size(F.array_distinct(full)) == 1)
    note = F.when(first.rlike(NOTE), F.array_join(F.concat(F.array(first), extra), " ")).when(alike, F.get(full, F.lit(0)))
    return last.select("table_id", note.alias("note")).where("note IS NOT NULL")


def merged_headers(tables: DataFrame) -> DataFrame:
    """Headers of two rows as one: table_id, header (array of texts), merged.

    Where the first columns of the first two rows are equal, as under a span, and later ones differ, the texts
    from there on are put together; otherwise the first row is the header.
    """
    two = table_rows(tables).where("row <= 1").groupBy("table_id").agg(F.max(F.when(F.col("row") == 0, F.col("cells"))).alias("a"), F.max(F.when(F.col("row") == 1, F.col("cells"))).alias("b"))
    width = F.greatest(F.size("a"), F.coalesce(F.size("b"), F.lit(0)))
    at = lambda c, i: F.coalesce(F.get(c, i), F.lit(""))
    columns = F.sequence(F.lit(0), width - 1)
    split = F.array_min(F.filter(columns, lambda i: at("a", i) != at("b", i)))
    merges = F.coalesce(F.col("b").isNotNull() & (split > 0), F.lit(False))
    joined = F.transform(columns, lambda i: F.when(i < split, at("a", i)).otherwise(F.concat_ws(" ", F.nullif(at("a", i), F.lit("")), F.nullif(at("b", i), F.lit("")))))
    return two.where("a IS NOT NULL").select("table_id", F.when(merges, joined).otherwise(F.col("a")).alias("header"), merges.alias("merged"))


def page_markdown(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """Each page in reading order: doc_key, page, markdown. Section headers become headings; repeated blocks count once."""
    kept = outside_tables(blocks.dropDuplicates(["doc_key", "page", "pos"]), tables).where("text IS NOT NULL AND text <> ''")
    shown = F.when(F.col("layout_type") == "SECTION_HEADER", F.concat(F.lit("## "), F.col("text"))).when(F.col("layout_type") == "LIST", F.concat(F.lit("- "), F.col("text"))).otherwise(F.col("text"))
    parts = kept.select("doc_key", "page", "y", F.lit(0).alias("kind"), F.col("pos").cast("bigint").alias("at"), shown.alias("part"))
    drawn = tables.dropDuplicates(["doc_key", "page", "table_index"]).select("table_id", "doc_key", "page", F.col("bbox.y0").alias("y"), "table_index").join(table_markdown(tables), "table_id")
    parts = parts.unionByName(drawn.select("doc_key", "page", "y", F.lit(1).alias("kind"), F.col("table_index").cast("bigint").alias("at"), F.col("markdown").alias("part")))
    ordered = F.sort_array(F.collect_list(F.struct("y", "kind", "at", "part")))
    return parts.groupBy("doc_key", "page").agg(F.array_join(F.transform(ordered, lambda x: x["part"]), "\n\n").alias("markdown"))


def document_pages(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """Pages as Markdown documents: doc, doc_key, page, text.

    Section headers become headings one sign deeper than their level (without one, of two signs); tables
    come with their marker and caption above. Repeated blocks and tables count once.
    """
    kept = outside_tables(blocks.dropDuplicates(["doc_key", "page", "pos"]), tables).where("text IS NOT NULL AND text <> ''")
    signs = F.least(F.greatest(F.coalesce("heading_level", F.lit(1)), F.lit(1)), F.lit(4)) + 1
    heading = F.concat(F.repeat(F.lit("#"), signs), F.lit(" "), F.regexp_replace(F.trim("text"), r"\s*\n\s*", " "))
    shown = F.when(F.col("layout_type") == "SECTION_HEADER", heading).when(F.col("layout_type") == "LIST", F.concat(F.lit("- "), F.col("text"))).otherwise(F.col("text"))
    rows = kept.select("doc_key", "page", "y", F.lit(0).alias("kind"), F.col("pos").cast("bigint").alias("at"), shown.alias("part"))
    drawn = tables.dropDuplicates(["doc_key", "page", "table_index"]).select("table_id", "doc_key", "page", F.col("bbox.y0").alias("y"), "table_index", "caption").join(table_markdown(tables), "table_id")
    marker = F.concat(F.lit("<!-- t_p"), F.col("page").cast("string"), F.lit("_"), F.col("table_index").cast("string"), F.lit(" -->"))
    part = F.concat_ws("\n\n", marker, F.nullif("caption", F.lit("")), "markdown")
    rows = rows.unionByName(drawn.select("doc_key", "page", "y", F.lit(1).alias("kind"), F.col("table_index").cast("bigint").alias("at"), part.alias("part")))
    ordered = F.sort_array(F.collect_list(F.struct("y", "kind", "at", "part")))
    pages = rows.groupBy("doc_key", "page").agg(F.array_join(F.transform(ordered, lambda x: x["part"]), "\n\n").alias("text"))
    return pages.select(F.concat_ws("#", "doc_key", F.col("page").cast("string")).alias("doc"), "doc_key", "page", "text")


def completeness(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Which of a document's heading numbers its scan shows: doc_key, n_expected, n_missing, verdict."""
    want = expected.where("number IS NOT NULL AND doc_key IS NOT NULL").select("doc_key", "number").distinct()
    have = found.select("doc_key", "number", F.lit(1).alias("there")).distinct()
    scanned = found.select("doc_key").distinct()
    counts = want.join(scanned, "doc_key", "left_semi").join(have, ["doc_key", "number"], "left").groupBy("doc_key")
    counts = counts.agg(F.count(F.lit(1)).alias("n_expected"), F.sum(F.when(F.col("there").isNull(), 1).otherwise(0)).alias("n_missing"))
    return counts.withColumn("verdict", F.when(F.col("n_missing") > 3, "critical").when(F.col("n_missing") > 0, "incomplete").otherwise("complete"))
