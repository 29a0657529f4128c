"""Document structure: headings with their ancestors, chunk ids, packing of text blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ARROW = " → "


def with_ancestors(headings: DataFrame, document: str, order: list[str]) -> DataFrame:
    """Adds chapter, section, clause (numbers) and chapter_text, section_text, clause_text.

    The chapter of a heading is the nearest level 2 at or before it; its section the nearest level 3 since
    then; its clause, from level 4 on, its own number and text or, without a number, those of the level 4
    or deeper before it in the chapter. Levels below a heading's own are null. A null number of the
    nearest heading counts: it is not skipped for an earlier one.
    """
    so_far = Window.partitionBy(document).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = headings.withColumn("__chapter", F.sum(F.when(F.col("level") == 2, 1).otherwise(0)).over(so_far))
    in_chapter = Window.partitionBy(document, "__chapter").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.struct(F.col("number").alias("number"), F.col("heading_text").alias("text"))

    def nearest(found: Column) -> Column:
        return F.last(F.when(found, own), ignorenulls=True).over(in_chapter)

    rows = rows.withColumn("__c", nearest(F.col("level") == 2)).withColumn("__s", nearest(F.col("level") == 3))
    last_clause = F.last(F.when(F.col("level") >= 4, own), ignorenulls=True).over(in_chapter.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__k", F.when(F.col("number").isNotNull(), own).otherwise(last_clause))
    section, clause = F.when(F.col("level") >= 3, F.col("__s")), F.when(F.col("level") >= 4, F.col("__k"))
    for name, part in (("chapter", F.col("__c")), ("section", section), ("clause", clause)):
        rows = rows.withColumn(name, part["number"]).withColumn(f"{name}_text", part["text"])
    return rows.drop("__chapter", "__c", "__s", "__k")


def section_path() -> Column:
    """The non-empty numbers of a heading's ancestors, joined; null if there are none."""
    return F.nullif(F.array_join(F.filter(F.array("chapter", "section", "clause"), lambda x: x != ""), ARROW), F.lit(""))


def without_ignored(headings: DataFrame, document: str, order: list[str], ignore: Column) -> DataFrame:
    """Drops headings that contain an ignored name, and what lies under them.

    An ignored heading covers all deeper ones until the next of its own or a higher rank. Each run of
    headings is told by the nearest ignored heading of every rank before it.
    """
    so_far = Window.partitionBy(document).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ignored = F.exists(ignore, lambda name: F.contains(F.lower("heading_text"), F.lower(name)))
    rows = headings.withColumn("__ignored", F.coalesce(ignored, F.lit(False)))
    covered = F.lit(False)
    place = F.row_number().over(Window.partitionBy(document).orderBy(*order))
    rows = rows.withColumn("__place", place)
    for level in (2, 3, 4, 5):
        last_here = F.max(F.when(F.col("__ignored") & (F.col("level") == level), F.col("__place"))).over(so_far)
        # An unignored heading of this or a higher rank ends what an ignored one of this rank began.
        last_end = F.max(F.when(~F.col("__ignored") & (F.col("level") <= level), F.col("__place"))).over(so_far)
        covered = covered | (F.coalesce(last_here, F.lit(0)) > F.coalesce(last_end, F.lit(0)))
    return rows.withColumn("__covered", covered).where("NOT __covered").drop("__ignored", "__covered", "__place")


def chunk_ids(headings: DataFrame, document: str, order: list[str], counted: Column | None = None) -> DataFrame:
    """Adds chunk_id: slug/number, or slug/_hN for the N-th heading after its parent; repeats get /occurrence_N.

    Where ``counted`` is given, only the headings for which it holds count as occurrences.
    """
    ordered = Window.partitionBy(document).orderBy(*order)
    rows = headings.withColumn("__at", F.row_number().over(ordered) - 1)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    parent = F.lit(-1)
    for level in (3, 4, 5):
        lower = F.max(F.when(F.col("level") < level, F.col("__at"))).over(before)
        parent = F.when(F.col("level") == level, F.coalesce(lower, F.lit(-1))).otherwise(parent)
    raw = F.concat_ws("/", document, F.coalesce("number", F.concat(F.lit("_h"), (F.col("__at") - F.col("__parent")).cast("string"))))
    rows = rows.withColumn("__parent", parent).withColumn("__raw", raw)
    so_far = Window.partitionBy(document, "__raw").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turn = F.sum(F.when(F.coalesce(counted, F.lit(False)), 1).otherwise(0) if counted is not None else F.lit(1)).over(so_far)
    return rows.withColumn("chunk_id", F.when(turn <= 1, F.col("__raw")).otherwise(F.concat(F.col("__raw"), F.lit("/occurrence_"), turn.cast("string")))).drop("__at", "__parent", "__raw")


def token_count(text: Column) -> Column:
    """Tokens when no tokenizer is at hand: length over 3.5, at least 1."""
    return F.greatest(F.lit(1), (F.length(text) / 3.5).cast("int"))
