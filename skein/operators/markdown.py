"""Markdown documents: headings, clauses, atomic blocks, parts, chunk rows, tables and images.

A document is a row with its Markdown in one column; its lines are taken apart and put together with
array functions where the row is, so only what joins or counts across documents is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators.structure import chunk_ids, section_path, token_count, with_ancestors, without_ignored
from skein.session import cut_lineage

MOST_TOKENS, OVERHEAD = 7000, 200
#: Lines with text above a table among which its caption and marker are looked for.
LOOK_BACK = 12
#: Least share of common cells that makes two tables the same.
CONTENT_MATCH = 0.10

# Headings, captions and markers in Markdown, patterns of references with their labels.
HEADING = r"^(#{2,5})\s+(.+)$"
HEADING_NUMBER = r"^(\d+(?:\.\d+)*)\.\s"
CAPTION_LINE = r"(?iu)^(?:\*\s*)?(?:Т\s*а\s*б\s*л\s*и\s*ц\s*а|Таблиц[аы])\s*(?:(?:[А-ЯA-Z]\.)?\d+(?:\.\d+)*|[IVXLCDM]+)"
MARKER = r"^<!--\s*(t_p\d+_\d+)\s*-->"
SERVICE_MARKERS = r"<!--\s*(?:t_p\d+_\d+|WARN_[0-9A-Za-zА-Яа-я.]+)\s*-->"
RULE_LINE = r"^\|[\s\-:|]+\|$"
IMAGE = r"!\[([^\]\n]*)\]\((image/[^)\n]*)\)"
REFERENCE_PATTERNS = [
    ("п.", r"см\.\s*(?:п\.|пункт)\s*(\d+(?:\.\d+)*)"),
    ("п.", r"(?:согласно|по)\s+(?:п\.|пункту)\s*(\d+(?:\.\d+)*)"),
    ("табл.", r"(?:табл\.|таблица)\s*(\d+(?:\.\d+)*)"),
    ("разд.", r"разд\.\s*(\d+(?:\.\d+)*)"),
    ("гл.", r"(?:гл\.|глава)\s*(\d+(?:\.\d+)*)"),
]
HEADING_LABELS = [("chapter_text", "Заголовок главы"), ("section_text", "Заголовок раздела"), ("clause_text", "Заголовок пункта")]


def lines(text: Column) -> Column:
    return F.split(text, r"\r\n|\n|\r")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def headings(documents: DataFrame, document: str, text: str) -> DataFrame:
    """Headings of two to five signs: document, place (from 0), level, number, heading_text, line_num, next_line_num (from 0), clause_body.

    clause_body is what stands between a heading and the next, without blanks around. Null texts have no headings.
    """
    rows = documents.select(F.col(document), lines(F.col(text)).alias("__lines"))
    marked = F.transform(
        "__lines",
        lambda line, i: F.struct(F.length(F.regexp_extract(line, HEADING, 1)).alias("level"), stripped(F.regexp_extract(line, HEADING, 2)).alias("heading_text"), i.alias("line_num")),
    )
    rows = rows.withColumn("__marked", F.filter(marked, lambda h: h["level"] > 0))
    rows = rows.select(document, "__lines", "__marked", F.posexplode("__marked").alias("place", "h"))
    after = F.coalesce(F.try_element_at("__marked", F.col("place") + 2)["line_num"], F.size("__lines"))
    body = F.slice("__lines", F.col("h.line_num") + 2, F.greatest(after - F.col("h.line_num") - 1, F.lit(0)))
    return rows.select(
        document,
        "place",
        "h.level",
        F.nullif(F.regexp_extract("h.heading_text", HEADING_NUMBER, 1), F.lit("")).alias("number"),
        "h.heading_text",
        "h.line_num",
        after.alias("next_line_num"),
        stripped(F.array_join(body, "\n")).alias("clause_body"),
    )


def atomic_blocks(text: Column) -> Column:
    """Blocks of a text that must not be cut: fenced code, runs of pipe rows, paragraphs. array<string>; null stays null."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit("none").alias("kind"))

    def put(done: Column, opened: Column, kind: Column) -> Column:
        return F.struct(done.alias("done"), opened.alias("open"), kind.alias("kind"))

    def step(s: Column, line: Column) -> Column:
        bare = F.regexp_replace(line, r"^\s+", "")
        fence, pipe, blank = bare.startswith("```"), bare.startswith("|"), bare == ""
        kind = F.when(fence, "code").when(pipe, "table").when(blank, "none").otherwise("text")
        longer = F.concat(s["open"], F.lit("\n"), line)
        closed = F.when(s["kind"] != "none", F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"])
        in_code = s["kind"] == "code"
        ended = put(F.concat(s["done"], F.array(longer)), F.lit(""), F.lit("none"))
        new = put(closed, F.when(blank, "").otherwise(line), kind)
        return F.when(in_code & fence, ended).when(in_code | (~fence & ~blank & (kind == s["kind"])), put(s["done"], longer, s["kind"])).otherwise(new)

    return F.aggregate(lines(text), start, step, lambda s: F.filter(F.when(s["kind"] != "none", F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]), lambda b: b != ""))


def parts(text: Column, limit: int, measure: Callable[[Column], Column] = token_count, between: int = 1) -> Column:
    """A text's atomic blocks put together in order into parts of at most ``limit`` by ``measure``.

    A text within the limit stays as it is; a block beyond it is a part of its own; a part's blank line
    counts ``between``. array<string>; null stays null.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))

    def put(done: Column, opened: Column, n: Column) -> Column:
        return F.struct(done.alias("done"), opened.alias("open"), n.cast("int").alias("n"))

    def step(s: Column, block: Column) -> Column:
        size = measure(block)
        closed = F.when(s["n"] > 0, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"])
        fits = (s["n"] > 0) & (s["n"] + between + size <= limit)
        return (
            F.when(size > limit, put(F.concat(closed, F.array(block)), F.lit(""), F.lit(0)))
            .when(fits, put(s["done"], F.concat(s["open"], F.lit("\n\n"), block), s["n"] + between + size))
            .otherwise(put(closed, block, size))
        )

    made = F.aggregate(atomic_blocks(text), start, step, lambda s: F.when(s["n"] > 0, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]))
    return F.when(text.isNull(), F.lit(None)).when(measure(text) <= limit, F.array(text)).when(F.size(made) > 0, made).otherwise(F.array(text))


def configured_references(text: Column) -> Column:
    """Distinct references of a clause in the form label and number, sorted as strings."""

    def found(label: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda n: F.concat(F.lit(f"{label} "), n))

    return F.array_sort(F.array_distinct(F.concat(*[found(label, p) for label, p in REFERENCE_PATTERNS])))


def embedding_text(text: Column) -> Column:
    """The labelled texts of chapter, section and clause over a chunk's text; without any the text alone."""
    labels = F.filter(F.array(*[F.when(F.col(c) != "", F.concat(F.lit(f"{label}: "), F.col(c))) for c, label in HEADING_LABELS]), lambda x: x.isNotNull())
    return F.when(F.size(labels) > 0, F.concat(F.array_join(labels, "\n"), F.lit("\n\n"), text)).otherwise(text)


def chunk_rows(documents: DataFrame, document: str, text: str, ignore: Column | None = None, most_tokens: int = MOST_TOKENS, overhead: int = OVERHEAD) -> DataFrame:
    """Chunk rows of Markdown documents, one per clause or, where that is longer than ``most_tokens``, per part.

    Columns: the document, place, part (0 for a whole clause), chunk_id, level, chapter, section, clause,
    section_path, chapter_text, section_text, clause_text, text, embedding_text, embedding_tokens,
    references, chunk_tokens. Markers of tables and warnings are no text. Sections whose heading holds a
    name of ``ignore`` (array<string>) are left out with all below them, clauses without text too; ids
    number repeated clauses by occurrence. Null texts give no rows.
    """
    clean = documents.select(F.col(document).alias("doc"), F.regexp_replace(text, SERVICE_MARKERS, "").alias("text"), *([ignore.alias("__ignore")] if ignore is not None else []))
    found = headings(clean, "doc", "text")
    if ignore is not None:
        names = clean.select("doc", "__ignore")
        found = without_ignored(found.join(names, "doc"), "doc", ["place"], F.col("__ignore")).drop("__ignore")
    rows = with_ancestors(found, "doc", ["place"])
    # Ids are given after clauses without text have fallen away, but headings without text are parents too.
    rows = chunk_ids(rows, "doc", ["place"], counted=F.col("clause_body") != "").where("clause_body <> ''")
    whole = token_count(F.col("clause_body"))
    limit = most_tokens - overhead if most_tokens > overhead else most_tokens
    pieces = F.when(whole <= most_tokens, F.array("clause_body")).otherwise(parts(F.col("clause_body"), limit))
    rows = rows.withColumn("__cut", whole > most_tokens).select("*", F.posexplode(pieces).alias("__at", "__piece"))
    part = F.when(F.col("__cut"), F.col("__at") + 1).otherwise(0)
    number = part.cast("string")
    return rows.select(
        F.col("doc").alias(document),
        "place",
        part.alias("part"),
        F.when(part > 0, F.concat("chunk_id", F.lit("/part_"), number)).otherwise(F.col("chunk_id")).alias("chunk_id"),
        "level",
        "chapter",
        "section",
        F.when((part > 0) & (F.col("clause") != ""), F.concat("clause", F.lit(" (ч. "), number, F.lit(")"))).otherwise(F.col("clause")).alias("clause"),
        section_path().alias("section_path"),
        "chapter_text",
        "section_text",
        "clause_text",
        F.col("__piece").alias("text"),
        embedding_text(F.col("__piece")).alias("embedding_text"),
        token_count(embedding_text(F.col("__piece"))).alias("embedding_tokens"),
        configured_references(F.col("clause_body")).alias("references"),
        token_count(F.col("__piece")).alias("chunk_tokens"),
    )


def _table_starts(rows: Column) -> Column:
    """Line numbers (from 0) where a pipe table with its rule in the second line begins."""
    bare = F.transform(rows, stripped)
    start = F.struct(F.array().cast("array<int>").alias("found"), F.lit(False).alias("inside"), F.lit(0).alias("i"))

    def step(s: Column, line: Column) -> Column:
        pipe = line.startswith("|")
        opens = pipe & ~s["inside"] & F.coalesce(F.get(bare, s["i"] + 1).rlike(RULE_LINE), F.lit(False))
        return F.struct(F.when(opens, F.concat(s["found"], F.array(s["i"]))).otherwise(s["found"]).alias("found"), (pipe & (s["inside"] | opens)).alias("inside"), (s["i"] + 1).alias("i"))

    return F.aggregate(bare, start, step, lambda s: s["found"])


def tables(documents: DataFrame, document: str, text: str) -> DataFrame:
    """Pipe tables of Markdown documents: document, n (from 1), first_line, end_line (from 0, exclusive), row_count, marker, caption, block.

    A table begins at a pipe row followed by a rule. Its caption is the nearest caption line among the 12
    lines with text above it, else the line under it if nothing stands between; a caption line serves the
    first table that finds it. Its marker is the uppermost among those lines.
    """
    rows = documents.select(F.col(document).alias("doc"), lines(F.col(text)).alias("__lines"))
    rows = rows.withColumn("__starts", _table_starts(F.col("__lines"))).select("*", F.posexplode("__starts").alias("__n", "first_line"))
    numbered = F.transform("__lines", lambda x, i: F.struct(stripped(x).alias("line"), i.alias("i")))
    after = F.filter(numbered, lambda x: (x["i"] >= F.col("first_line")) & ~x["line"].startswith("|"))
    rows = rows.withColumn("end_line", F.coalesce(F.get(after, F.lit(0))["i"], F.size("__lines")))
    above = F.filter(numbered, lambda x: (x["i"] < F.col("first_line")) & (x["line"] != ""))
    rows = rows.withColumn("__above", F.reverse(F.slice(F.reverse(above), 1, LOOK_BACK)))
    under = F.filter(numbered, lambda x: (x["i"] >= F.col("end_line")) & (x["line"] != ""))
    is_caption = lambda x: F.regexp_replace(x["line"], r"^\*+|\*+$", "").rlike(CAPTION_LINE)
    rows = rows.withColumn("__up", F.reverse(F.transform(F.filter("__above", is_caption), lambda x: x["i"])))
    rows = rows.withColumn("__down", F.get(F.transform(F.filter(F.slice(under, 1, 1), is_caption), lambda x: x["i"]), F.lit(0)))
    # In order of the tables, each takes its nearest caption line that none before it has taken.
    choices = F.array_sort(F.collect_list(F.struct("__n", F.concat("__up", F.when(F.col("__down").isNotNull(), F.array("__down")).otherwise(F.array().cast("array<int>"))).alias("ways"))))

    def take(used: Column, choice: Column) -> Column:
        free = F.get(F.filter(choice["ways"], lambda w: ~F.array_contains(used, F.coalesce(w, F.lit(-2)))), F.lit(0))
        return F.concat(used, F.array(F.coalesce(free, F.lit(-1))))

    taken = rows.groupBy("doc").agg(choices.alias("choices")).select("doc", F.posexplode(F.aggregate("choices", F.array().cast("array<int>"), take)).alias("__n", "__caption_line"))
    rows = rows.join(taken, ["doc", "__n"])
    marker = F.filter(F.transform("__above", lambda x: F.regexp_extract(x["line"], MARKER, 1)), lambda m: m != "")
    caption = F.regexp_replace(F.regexp_replace(stripped(F.get("__lines", F.col("__caption_line"))), r"^\*+|\*+$", ""), r"\s+", " ")
    return rows.select(
        F.col("doc").alias(document),
        (F.col("__n") + 1).alias("n"),
        "first_line",
        "end_line",
        F.greatest(F.col("end_line") - F.col("first_line") - 2, F.lit(0)).alias("row_count"),
        F.get(marker, F.lit(0)).alias("marker"),
        F.when(F.col("__caption_line") >= 0, caption).otherwise("").alias("caption"),
        F.array_join(F.slice("__lines", F.col("first_line") + 1, F.col("end_line") - F.col("first_line")), "\n").alias("block"),
    )


def images(documents: DataFrame, document: str, text: str) -> DataFrame:
    """Images of Markdown documents: document, n (from 1), caption, image_path, md_line (from 0)."""
    rows = documents.select(F.col(document), F.posexplode(lines(F.col(text))).alias("md_line", "__line"))
    found = rows.select(document, "md_line", F.posexplode(F.regexp_extract_all("__line", F.lit(IMAGE), F.lit(0))).alias("__at", "__image"))
    turn = F.row_number().over(Window.partitionBy(document).orderBy("md_line", "__at"))
    return found.select(document, turn.alias("n"), F.regexp_extract("__image", IMAGE, 1).alias("caption"), F.regexp_extract("__image", IMAGE, 2).alias("image_path"), "md_line")


def content_candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of tables of one document with common cells: doc, left_id, right_id, similarity (Jaccard of the cells).

    Inputs: doc, id, cells (array<string> without repeats). Only pairs with a common cell are made.
    """
    one = left.select("doc", F.col("id").alias("left_id"), F.size("cells").alias("left_size"), F.explode("cells").alias("cell"))
    other = right.select("doc", F.col("id").alias("right_id"), F.size("cells").alias("right_size"), F.explode("cells").alias("cell"))
    common = one.join(other, ["doc", "cell"]).groupBy("doc", "left_id", "right_id").agg(F.count(F.lit(1)).alias("n"), F.max("left_size").alias("a"), F.max("right_size").alias("b"))
    return common.select("doc", "left_id", "right_id", (F.col("n") / (F.col("a") + F.col("b") - F.col("n"))).alias("similarity"))


def content_match(candidates: DataFrame, least: float = CONTENT_MATCH) -> DataFrame:
    """The best counterpart of each table: doc, left_id, right_id (null under ``least``), best, second. Ties go to the smaller id."""
    turn = F.row_number().over(Window.partitionBy("doc", "left_id").orderBy(F.desc("similarity"), "right_id"))
    two = candidates.withColumn("turn", turn).where("turn <= 2").groupBy("doc", "left_id")
    two = two.agg(F.max(F.when(F.col("turn") == 1, F.col("right_id"))).alias("right_id"), F.max("similarity").alias("best"), F.coalesce(F.max(F.when(F.col("turn") == 2, F.col("similarity"))), F.lit(0.0)).alias("second"))
    return two.select("doc", "left_id", F.when(F.col("best") >= least, F.col("right_id")).alias("right_id"), "best", "second")


def content_binding(candidates: DataFrame, least: float = CONTENT_MATCH) -> DataFrame:
    """One-to-one counterparts: doc, left_id, right_id, similarity. In order of left_id each table takes its best one still free.

    Rounds settle, at the same time in all documents, every table whose best free counterpart no earlier
    open table could take; the first open table of a document always is one of them.
    """
    open_pairs = cut_lineage(candidates.where(F.col("similarity") >= least))
    done: list[DataFrame] = []
    while open_pairs.limit(1).count():
        best = F.row_number().over(Window.partitionBy("doc", "left_id").orderBy(F.desc("similarity"), "right_id"))
        first = F.min("left_id").over(Window.partitionBy("doc", "right_id"))
        settled = cut_lineage(open_pairs.withColumn("best", best).withColumn("first", first).where("best = 1 AND first = left_id").drop("best", "first"))
        done.append(settled)
        open_pairs = open_pairs.join(settled.select("doc", "left_id"), ["doc", "left_id"], "left_anti").join(settled.select("doc", "right_id"), ["doc", "right_id"], "left_anti")
        open_pairs = cut_lineage(open_pairs)
    out = candidates.limit(0)
    for settled in done:
        out = out.unionByName(settled)
    return out.select("doc", "left_id", "right_id", "similarity")


def mentions(assets: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks whose text holds an asset's caption or image path: asset_id, chunk_id.

    ``assets``: asset_id, doc, caption, image_path. ``chunks``: chunk_id, doc, text. Both of one document.
    A caption is looked for where the text names a number that begins with the caption's, so captions
    without a label and number link nothing; a path where the text names an image file.
    """
    known = assets.select("asset_id", "doc", "caption", "image_path").where("doc IS NOT NULL")
    texts = chunks.where("chunk_id IS NOT NULL AND doc IS NOT NULL AND text IS NOT NULL").select("chunk_id", "doc", "text")
    named = F.flatten(F.array(*[F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in (T.TABLE_CAPTION, T.IMAGE_CAPTION)]))
    starts = F.flatten(F.transform(named, lambda n: F.transform(F.sequence(F.lit(1), F.length(n)), lambda i: F.substring(F.lower(n), F.lit(1), i))))
    asked = texts.select("chunk_id", "doc", "text", F.explode(F.array_distinct(starts)).alias("number"))
    number = F.lower(F.coalesce(*[F.nullif(F.regexp_extract("caption", p, 1), F.lit("")) for p in (T.TABLE_CAPTION, T.IMAGE_CAPTION)]))
    captioned = known.where("caption <> ''").select("asset_id", "doc", "caption", number.alias("number")).where("number IS NOT NULL")
    by_caption = asked.join(captioned, ["doc", "number"]).where(F.contains("text", "caption")).select("asset_id", "chunk_id")
    files = texts.select("chunk_id", "doc", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"image/[\p{L}\p{N}_.-]+\.[A-Za-z0-9]+"), F.lit(0)))).alias("image_path"))
    by_path = files.join(known.where("image_path <> ''"), ["doc", "image_path"]).select("asset_id", "chunk_id")
    return by_caption.unionByName(by_path).distinct()
