"""Answers and questions as text: citations, lists of documents asked for, JSON in prose, targeted search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.folding import reference_key
from skein.functions.text import asset_references, caption_number

# Citations in square brackets; citations with or without; requests for the list of documents; designations.
_CITED = r"А-ЯЁа-яёA-Za-z0-9\s.,/\-—–"
BRACKETED = rf"\[[{_CITED}]+?\s*[,;]\s*(?:п\.|пп\.|табл\.|таблица|ст\.|разд\.|прил\.)\s*[\d.]+\]"
CITATION = rf"\[?([{_CITED}]{{3,}}?)\s*[,;]\s*(п\.|пп\.|табл\.|таблица|таблицей|ст\.|разд\.|прил\.)\s*([А-ЯA-Z]?\.?\d+(?:\.\d+)*)\]?"
_BEGIN, _WORD, _END = r"(?:^|[^\p{L}\p{N}_])", r"[\p{L}\p{N}_]*", r"(?:[^\p{L}\p{N}_]|$)"
LIST_REQUESTS = [
    rf"{_BEGIN}(?:перечисли|перечислите)\s+документ",
    rf"{_BEGIN}(?:перечень|список)\s+документ",
    rf"{_BEGIN}документ{_WORD}\s+в\s+базе{_END}",
    rf"{_BEGIN}что\s+(?:есть\s+)?в\s+базе{_END}",
    rf"{_BEGIN}что\s+загружено{_END}",
    rf"{_BEGIN}какие\s+(?:гост|сп)\s*/\s*(?:гост|сп)\s+есть\s+в\s+базе{_END}",
]
#: Which standards there are, unless a verb says that their content is asked for.
WHICH = rf"{_BEGIN}какие\s+норматив{_WORD}"
WHICH_CONTENT = rf"{WHICH}\s+(?:[\p{{L}}\p{{N}}_]+\s+){{0,2}}(?:регламентир|содерж|треб|описыв|устанавл|определ|применя)"
DESIGNATION = r"(?:гост\s*р\s*|гост\s*|сп\s*|снип\s*|санпин\s*|со\s*|ту\s*)[0-9][0-9.\-—–]*"


def has_citations(text: Column) -> Column:
    return F.coalesce(text.rlike(BRACKETED), F.lit(False))


def citations(text: Column) -> Column:
    """The citations of a text in order: array<struct<document, kind, number>>; null stays null."""
    part = lambda i: F.regexp_extract_all(text, F.lit(CITATION), F.lit(i))
    return F.transform(F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("c")), lambda x: F.struct(F.trim(x["a"]).alias("document"), x["b"].alias("kind"), x["c"].alias("number")))


def asks_for_documents(text: Column) -> Column:
    """Whether a question asks which documents the base holds."""
    plain = F.lit(False)
    for pattern in LIST_REQUESTS:
        plain = plain | text.rlike(f"(?iu){pattern}")
    which = F.size(F.regexp_extract_all(text, F.lit(f"(?iu){WHICH}"), F.lit(0))) > F.size(F.regexp_extract_all(text, F.lit(f"(?iu){WHICH_CONTENT}"), F.lit(0)))
    return F.coalesce(plain | which, F.lit(False))


def json_object(text: Column) -> Column:
    """The JSON object of a text: of the whole text, of what a fence holds, or the first one in it; else null.

    The string that comes out begins with the object; JSON functions pass over what follows it.
    """
    whole = F.trim(text)
    fenced = F.trim(F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1))
    parts = F.split(text, r"\{")
    ends = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda _, i: F.concat(F.lit("{"), F.array_join(F.slice(parts, i + 2, F.size(parts)), "{")))
    valid = lambda x: F.json_object_keys(x).isNotNull()
    return F.coalesce(F.when(valid(whole), whole), F.when(valid(fenced), fenced), F.get(F.filter(ends, valid), F.lit(0)))


def matched_citations(cited: DataFrame, results: DataFrame, assets: DataFrame) -> DataFrame:
    """Chunks that an answer's citations mean: query_id, chunk_id, once each.

    ``cited``: query_id, document, kind, number. A clause means the first result by rank of its query whose
    document is named (one designation holds the other, whatever the dashes) and whose path ends in the
    number. A table means the chunks of the first asset of that document with the caption Таблица and the
    number. Null and empty documents and numbers mean nothing.
    """
    key = reference_key(F.col("document"))
    asked = cited.select("query_id", key.alias("named"), F.col("kind").startswith("табл").alias("is_table"), "number").where("named IS NOT NULL AND number <> ''").distinct()
    found = results.where("document_id IS NOT NULL").select("query_id", "chunk_id", "rank", "result_id", reference_key(F.col("document_id")).alias("held"), "section_path")
    pairs = asked.where("NOT is_table").join(found, "query_id")
    same = F.contains("held", "named") | F.contains("named", "held")
    path = F.rtrim(F.col("section_path"))
    first = pairs.where(same & path.endswith(F.col("number"))).groupBy("query_id", "named", "number").agg(F.min_by("chunk_id", F.struct("rank", "result_id")).alias("chunk_id"))
    tables = assets.where("asset_type = 'table'").select("asset_id", reference_key(F.col("document_id")).alias("named"), "caption", "chunk_ids")
    tables = tables.groupBy("named", "caption").agg(F.min_by("chunk_ids", "asset_id").alias("chunk_ids"))
    of_tables = asked.where("is_table").withColumn("caption", F.concat(F.lit("Таблица "), F.col("number"))).join(tables, ["named", "caption"]).select("query_id", F.explode("chunk_ids").alias("chunk_id"))
    return first.select("query_id", "chunk_id").unionByName(of_tables).where("chunk_id IS NOT NULL").distinct()


def _beginnings(key: Column) -> Column:
    """A designation's key and what remains of it when its last parts are left off: СП1.2.3, СП1.2, СП1."""
    cuts = F.transform(F.regexp_extract_all(F.regexp_replace(key, r"^[^0-9]*[0-9]+", ""), F.lit(r"[.\-][0-9]+"), F.lit(0)), lambda x: F.length(x))
    lengths = F.aggregate(F.reverse(cuts), F.array(F.length(key)), lambda done, n: F.concat(done, F.array(F.element_at(done, -1) - n)))
    return F.transform(lengths, lambda n: F.substring(key, F.lit(1), n))


def named_documents(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents that a question names in full or by the beginning of their designation: id, document. Inputs: id, text; document (key)."""
    asked = questions.select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(f"(?iu){DESIGNATION}"), F.lit(0)))).alias("name"))
    asked = asked.select("id", F.regexp_replace(reference_key(F.col("name")), r"[.\-]+$", "").alias("name")).distinct()
    known = documents.where("document IS NOT NULL").distinct().select("document", F.explode(F.array_distinct(_beginnings(F.col("document")))).alias("name"))
    return asked.join(known, "name").select("id", "document").distinct()


def targeted_chunks(questions: DataFrame, assets: DataFrame) -> DataFrame:
    """Chunks of the table or image that a question names first: id, asset_type, number, document, chunk_id.

    ``questions``: id, text. Where several documents have the number, those that the question names
    count; if not exactly one is left, nothing is found. Assets come in only after the document is known,
    so a number that every document has costs no more than any other.
    """
    asked = questions.where("text IS NOT NULL").select("id", F.explode(F.slice(asset_references(F.col("text")), 1, 1)).alias("x")).select("id", "x.asset_type", "x.number")
    numbered = assets.select(reference_key(F.col("document_id")).alias("document"), "asset_type", caption_number(F.col("asset_type"), F.col("caption")).alias("number"), "chunk_ids")
    numbered = numbered.where("number IS NOT NULL AND document IS NOT NULL")
    holders = numbered.select("document", "asset_type", "number").distinct()
    spread = holders.groupBy("asset_type", "number").agg(F.count(F.lit(1)).alias("n"), F.min("document").alias("only"))
    named = named_documents(questions.where("text IS NOT NULL"), holders.select("document"))
    own = asked.join(named, "id").join(holders, ["document", "asset_type", "number"]).groupBy("id").agg(F.count(F.lit(1)).alias("n_named"), F.min("document").alias("named"))
    both = asked.join(spread, ["asset_type", "number"]).join(own, "id", "left")
    document = F.when(F.col("n") == 1, F.col("only")).when(F.col("n_named") == 1, F.col("named"))
    sure = both.select("id", "asset_type", "number", document.alias("document")).where("document IS NOT NULL")
    return sure.join(numbered, ["document", "asset_type", "number"]).select("id", "asset_type", "number", "document", F.explode("chunk_ids").alias("chunk_id")).distinct()


def formatted(results: DataFrame, query: str, rank: str) -> DataFrame:
    """Each query's results as the text of a prompt: query, prompt. Missing fields are passed over."""
    doc = F.coalesce(F.nullif("document_id", F.lit("")), F.lit("—"))
    h = "heading_texts"
    path = F.array_join(F.filter(F.array(f"{h}.chapter", f"{h}.section", f"{h}.clause"), lambda x: F.trim(x) != ""), " → ")
    header = F.concat(F.lit("["), F.col(rank).cast("string"), F.lit("] "), doc, F.when(F.col("section_path") != "", F.concat(F.lit(" | "), F.col("section_path"))).otherwise(""), F.lit(" | score: "), F.format_string("%.4f", F.coalesce("score", F.lit(0.0))))
    indented = lambda x: F.when(x != "", F.concat(F.lit("   "), x))
    source = F.concat(F.lit("   (источник: "), F.coalesce(F.nullif("title", F.lit("")), doc), F.lit(")"))
    block = F.array_join(F.array_compact(F.array(header, indented(F.coalesce(path, F.lit(""))), indented(F.trim(F.coalesce("text", F.lit("")))), source)), "\n")
    ordered = F.sort_array(F.collect_list(F.struct(rank, block.alias("block"))))
    return results.groupBy(query).agg(F.array_join(F.transform(ordered, lambda x: x["block"]), "\n\n").alias("prompt"))
