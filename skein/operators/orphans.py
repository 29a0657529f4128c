"""References to records that do not exist: a merge of references and validity intervals.

References and parent keys are brought into one stream, partitioned by key and sorted by key and
time. One pass over each sorted key keeps the number of parents that are valid at the moment; a
reference that meets the number zero is an orphan. What the key's parents did elsewhere on the time
line tells the kind: never there (``missing``), there before (``deleted``), only later (``late``).

A key that holds very many references is cut into slices of bounded size before anything is joined or
shuffled by key; the parents of that key, and of no other, are repeated for each slice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.folding import reference_key

#: References of one key that one task merges at most.
SLICE_ROWS = 250_000
#: Keys that are sliced at most, the ones with the most references; they go to every task. A key beyond
#: them has less than one in so many of all references.
MOST_SLICED = 10_000

# The labels of references, in capital Cyrillic letters.
_NUMBERED = r"^(ПУНКТ|П|РАЗДЕЛ|РАЗД|ГЛАВА|ГЛ|ТАБЛИЦА|ТАБЛ)\.?([А-Я](?:\.?\d+)?(?:\.\d+)*|\d+(?:\.\d+)*)\.?$"


def find_orphans(references: DataFrame, parents: DataFrame, slice_rows: int = SLICE_ROWS, most_sliced: int = MOST_SLICED) -> DataFrame:
    """References without a valid parent at their time, with the kind of absence.

    ``references``: src_table, src_key, ref_value, parent_table, parent_key, at (timestamp).
    ``parents``: parent_table, parent_key, loaded_at, removed_at (null: still there).
    Returns the references' src_table, src_key, ref_value, at and status (missing, deleted, late).

    A parent is there from loaded_at on and no longer at removed_at. References with a null key or
    time cannot be judged and are left out, as are parents with a null key or loaded_at, or removed
    no later than loaded. Repeated references stay repeated; empty inputs give no rows.
    """
    keys = ["parent_table", "parent_key"]
    refs = references.where(F.col("parent_key").isNotNull() & F.col("at").isNotNull())
    known = parents.where(
        F.col("parent_key").isNotNull()
        & F.col("loaded_at").isNotNull()
        & (F.col("removed_at").isNull() | (F.col("removed_at") > F.col("loaded_at")))
    )
    hot = refs.groupBy(*keys).count().where(F.col("count") > slice_rows).orderBy(F.desc("count"), *keys).limit(most_sliced)
    hot = F.broadcast(hot.select(*keys, F.ceil(F.col("count") / slice_rows).cast("int").alias("slices")))
    refs = refs.join(hot, keys, "left").select(
        *keys,
        F.when(F.col("slices").isNotNull(), F.expr("pmod(xxhash64(src_key, ref_value), slices)")).otherwise(F.lit(0)).cast("int").alias("slice"),
        F.col("at").alias("time"),
        F.lit(0).alias("change"),
        F.lit(1).alias("turn"),
        "src_table",
        "src_key",
        "ref_value",
    )
    edges = F.array(
        F.struct(F.col("loaded_at").alias("time"), F.lit(1).alias("change")),
        F.struct(F.col("removed_at").alias("time"), F.lit(-1).alias("change")),
    )
    known = (
        known.join(hot, keys, "left")
        .withColumn("slice", F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1)))
        .select(*keys, "slice", F.inline(F.filter(edges, lambda e: e["time"].isNotNull())))
        .groupBy(*keys, "slice", "time")
        .agg(F.sum("change").cast("int").alias("change"), F.max("change").alias("loads"))
    )
    stream = refs.withColumn("loads", F.lit(0)).unionByName(known.withColumn("turn", F.lit(0)), allowMissingColumns=True)
    merged = Window.partitionBy(*keys, "slice").orderBy("time", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys, "slice")
    seen = stream.select(
        "*",
        F.sum("change").over(merged).alias("valid"),
        F.max("loads").over(merged).alias("loaded_before"),
        F.max("loads").over(whole).alias("ever"),
    )
    status = F.when(F.col("ever") <= 0, "missing").when(F.col("loaded_before") > 0, "deleted").otherwise("late")
    return seen.where((F.col("turn") == 1) & (F.col("valid") == 0)).select("src_table", "src_key", "ref_value", F.col("time").alias("at"), status.alias("status"))


def document_references(search_results: DataFrame, registry: DataFrame) -> DataFrame:
    """The references of both tables in one form, for find_orphans.

    Rows without document_id and entries without a label and a number name nothing and are left out;
    null entries and null lists likewise.
    """
    entries = search_results.where(F.col("document_id").isNotNull()).select(
        F.col("result_id").alias("src_key"),
        "document_id",
        F.col("retrieved_at").alias("at"),
        F.explode(F.array_distinct("references")).alias("ref_value"),
    )
    entries = entries.withColumn("folded", reference_key(F.col("ref_value")))
    entries = entries.select(
        "*",
        F.regexp_extract("folded", _NUMBERED, 1).alias("label"),
        F.regexp_extract("folded", _NUMBERED, 2).alias("number"),
    ).where("number <> ''")
    inner = entries.select(
        F.lit("search_results").alias("src_table"),
        "src_key",
        "ref_value",
        F.when(F.col("label").startswith("ТАБЛ"), "assets").otherwise("md_headings").alias("parent_table"),
        F.concat_ws("|", reference_key(F.col("document_id")), "number").alias("parent_key"),
        "at",
    )
    successors = registry.select(
        F.lit("registry").alias("src_table"),
        F.col("rec_id").alias("src_key"),
        F.col("replaced_by_document_id").alias("ref_value"),
        F.lit("registry").alias("parent_table"),
        reference_key(F.col("replaced_by_document_id")).alias("parent_key"),
        F.col("loaded_at").alias("at"),
    )
    return inner.unionByName(successors)


def document_parents(md_headings: DataFrame, assets: DataFrame, registry: DataFrame) -> DataFrame:
    """The keys that references may name, with the time each was there."""

    def numbered(df: DataFrame, name: str, number: str) -> DataFrame:
        clean = F.regexp_replace(reference_key(F.col(number)), r"\.$", "")
        return df.where(F.col("document_id").isNotNull() & clean.isNotNull()).select(
            F.lit(name).alias("parent_table"),
            F.concat_ws("|", reference_key(F.col("document_id")), clean).alias("parent_key"),
            "loaded_at",
            "removed_at",
        )

    names = registry.select(F.explode(F.array("document_id", "document_id_alt")).alias("name"), "loaded_at", "removed_at").select(
        F.lit("registry").alias("parent_table"), reference_key(F.col("name")).alias("parent_key"), "loaded_at", "removed_at"
    )
    return numbered(md_headings, "md_headings", "number").unionByName(numbered(assets, "assets", "table_num")).unionByName(names)


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphan references per table, month of the referring row and status."""
    return orphans.groupBy("src_table", F.date_format("at", "yyyy-MM").alias("month"), "status").agg(F.count(F.lit(1)).alias("n_references"))
