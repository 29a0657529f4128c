"""Queries on problems 1, 2, 3, 4, 6, 7 and 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.folding import BLANKS, CYRILLIC, FULL_WIDTH, GREEK, GREEK_AS_CYRILLIC, GREEK_AS_LATIN, INVISIBLE, LATIN, ORDINARY, UNUSUAL
from skein.llm.abuse import THRESHOLD, abuse_rates, abuse_scores, fit
from skein.llm.consistent import consistent_form, inconsistent_values
from skein.llm.leakage import leaks, without_leaks
from skein.llm.mixing import mix, mix_report, token_counts
from skein.llm.near_duplicates import near_duplicate_groups, near_duplicate_links, pairs_within_groups
from skein.llm.scans import repaired
from skein.llm.splitting import split_oversized
from skein.session import cut_lineage, table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    results = table(spark, folder, "search_results").select("result_id", "text", "title")
    return inconsistent_values(results, "result_id", ["text", "title"])


def p1_consistent(spark: SparkSession, folder: str) -> DataFrame:
    results = table(spark, folder, "search_results").select("result_id", "text", "title")
    return consistent_form(results, ["text", "title"]).select("result_id", F.col("text_consistent").alias("text"), F.col("title_consistent").alias("title"))


def _groups(spark: SparkSession, folder: str) -> DataFrame:
    # This project's statement of the problem: runs of three words, 0.7 of the union.
    return near_duplicate_groups(table(spark, folder, "search_results"), "result_id", "text", threshold=0.7, run=3)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return pairs_within_groups(_groups(spark, folder), "result_id")


def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    return _groups(spark, folder)


def p2_links(spark: SparkSession, folder: str) -> DataFrame:
    """All links between different texts, each text named by the first row that holds it."""
    return near_duplicate_links(table(spark, folder, "search_results"), "result_id", "text", threshold=0.7, run=3)


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split_oversized(table(spark, folder, "search_results"), "result_id", "text", ["section_path"])


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder).where("n_parts > 1").select("result_id").distinct()


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder)


def _repaired(spark: SparkSession, folder: str) -> DataFrame:
    return repaired(table(spark, folder, "ocr_blocks"), table(spark, folder, "ocr_tables"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _repaired(spark, folder).where("damaged").select("src_table", "row_id").distinct()


def p4_repaired(spark: SparkSession, folder: str) -> DataFrame:
    return _repaired(spark, folder)


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).select("doc_id", "item_id").distinct()


def p6_items(spark: SparkSession, folder: str) -> DataFrame:
    """Which test items leaked, and into how many documents."""
    return p6_found(spark, folder).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"))


def p6_clean(spark: SparkSession, folder: str) -> DataFrame:
    return without_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mix(cut_lineage(token_counts(table(spark, folder, "documents"))), table(spark, folder, "mix_targets"))


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    tokens, targets = cut_lineage(token_counts(table(spark, folder, "documents"))), table(spark, folder, "mix_targets")
    return mix_report(mix(tokens, targets), tokens, targets)


def p7_whole_report(spark: SparkSession, folder: str) -> DataFrame:
    """The shares reached where the mix is to be as large as the whole corpus: scarce sources run into their limit of repeats."""
    tokens, targets = cut_lineage(token_counts(table(spark, folder, "documents"))), table(spark, folder, "mix_targets")
    whole = tokens.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).head()[0]
    return mix_report(mix(tokens, targets, whole), tokens, targets)


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return abuse_scores(documents, fit(documents, table(spark, folder, "labels")))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _scores(spark, folder).where(F.col("score") >= THRESHOLD).select("doc_id").distinct()


def p8_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _scores(spark, folder)


def p8_rates(spark: SparkSession, folder: str) -> DataFrame:
    return abuse_rates(_scores(spark, folder))


QUERIES = {f.__name__: f for f in (p1_found, p1_consistent, p2_found, p2_groups, p2_links, p3_found, p3_pieces, p4_found, p4_repaired, p6_found, p6_items, p6_clean, p7_mix, p7_report, p7_whole_report, p8_found, p8_scores, p8_rates)}

def _words() -> str:
    """A text's words as the operators see them, in the oracle's SQL."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    chars = f"translate(text, {quote(FULL_WIDTH + BLANKS + INVISIBLE)}, {quote(ORDINARY + ' ' * len(BLANKS))})"
    return rf"regexp_extract_all(lower(translate(nfc_normalize({chars}), {quote(LATIN + GREEK)}, {quote(CYRILLIC + GREEK_AS_CYRILLIC)})), '[\p{{L}}\p{{N}}]+')"


def _grams(table_name: str, key: str) -> str:
    return f"""SELECT DISTINCT {key}, array_to_string(list_slice(words, i, i + 12), ' ') AS gram
  FROM (SELECT {key}, words, unnest(range(1, len(words) - 11)) AS i FROM (SELECT {key}, {_words()} AS words FROM {table_name} WHERE text IS NOT NULL))"""


_LEAKS = f"""WITH d AS ({_grams('documents', 'doc_id')}), b AS ({_grams('benchmark', 'item_id')}),
found AS (SELECT DISTINCT doc_id, item_id FROM d JOIN b USING (gram))"""

def _quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


# Problem 1: words in question by class of look-alikes, the class's most used spelling in one alphabet.
_ONE_ALPHABET = " + ".join(f"regexp_matches(member, '{x}')::INT" for x in (r"\p{Cyrillic}", r"\p{Latin}", r"\p{Greek}"))
_ALPHABETS = " + ".join(f"regexp_matches(word, '{x}')::INT" for x in ("[Ѐ-ԯ]", "[A-Za-zÀ-ɏ]", "[Ͱ-Ͽ]"))
_CONSISTENT = rf"""WITH v AS (SELECT result_id, 'text' AS field_name, text AS value FROM search_results UNION ALL SELECT result_id, 'title', title FROM search_results),
f AS (SELECT *, CASE WHEN regexp_matches(value, {_quote(UNUSUAL)}) THEN nfc_normalize(translate(value, {_quote(FULL_WIDTH + BLANKS + INVISIBLE)}, {_quote(ORDINARY + ' ' * len(BLANKS))})) ELSE value END AS folded FROM v WHERE value IS NOT NULL),
w AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(folded, '[\p{{L}}\p{{N}}]+')) AS word FROM f) GROUP BY word),
q AS (SELECT word, n, translate(word, {_quote(LATIN + GREEK)}, {_quote(CYRILLIC + GREEK_AS_CYRILLIC)}) AS cyr, translate(word, {_quote(CYRILLIC + GREEK)}, {_quote(LATIN + GREEK_AS_LATIN)}) AS lat FROM w
  WHERE {_ALPHABETS} > 1 OR ({_ALPHABETS} = 1 AND NOT regexp_matches(word, '[^0-9{CYRILLIC}{LATIN}{GREEK}]'))),
m AS (SELECT cyr AS class, member, sum(CASE WHEN member = word THEN n ELSE 0 END) AS n FROM (SELECT word, n, cyr, unnest(list_distinct([word, cyr, lat])) AS member FROM q) WHERE {_ONE_ALPHABET} <= 1 GROUP BY ALL),
changes AS (SELECT q.word, c.canonical FROM q JOIN (SELECT class, first(member ORDER BY n DESC, member) AS canonical FROM m GROUP BY class) c ON c.class = q.cyr WHERE q.word <> c.canonical)"""
# Problem 2: all links by common runs, groups by reachability.
_LINKS = f"""WITH RECURSIVE t AS (SELECT result_id, {_words()} AS words FROM search_results WHERE text IS NOT NULL),
r AS (SELECT DISTINCT result_id, array_to_string(list_slice(words, i, i + 2), ' ') AS run FROM (SELECT result_id, words, unnest(range(1, len(words) - 1)) AS i FROM t)),
k AS (SELECT result_id, count(*) AS n, md5(string_agg(run, '|' ORDER BY run)) AS print FROM r GROUP BY result_id), reps AS (SELECT print, min(result_id) AS rep, any_value(n) AS n FROM k GROUP BY print),
o AS (SELECT rep, n, run FROM reps JOIN r ON r.result_id = rep),
links AS (SELECT x.rep AS a, y.rep AS b, count(*) / (any_value(x.n) + any_value(y.n) - count(*))::DOUBLE AS similarity FROM o x JOIN o y ON x.run = y.run AND x.rep < y.rep GROUP BY ALL HAVING count(*) >= 0.7 * (any_value(x.n) + any_value(y.n) - count(*)) - 1e-9),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT reach.a, s.b FROM reach JOIN both_ways s ON s.a = reach.b),
g AS (SELECT rep, least(rep, coalesce((SELECT min(b) FROM reach WHERE reach.a = rep), rep)) AS group_id, print FROM reps),
members AS (SELECT k.result_id, g.rep AS representative, g.group_id FROM k JOIN g USING (print))"""

ORACLE: dict[str, str] = {
    "p1_found": rf"""{_CONSISTENT} SELECT result_id, field_name FROM f WHERE folded <> value UNION SELECT result_id, field_name FROM (SELECT result_id, field_name, unnest(regexp_extract_all(folded, '[\p{{L}}\p{{N}}]+')) AS word FROM f) JOIN changes USING (word)""",
    "p1_consistent": rf"""{_CONSISTENT}, one AS (SELECT map(list(word), list(canonical)) AS m FROM changes),
c AS (SELECT result_id, field_name, array_to_string(list_transform(regexp_extract_all(folded, '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+'), lambda x: coalesce(m[x], x)), '') AS made FROM f, one)
SELECT s.result_id, x.made AS text, y.made AS title FROM search_results s LEFT JOIN c x ON x.result_id = s.result_id AND x.field_name = 'text' LEFT JOIN c y ON y.result_id = s.result_id AND y.field_name = 'title'""",
    "p2_found": f"{_LINKS} SELECT x.result_id AS result_id_a, y.result_id AS result_id_b FROM members x JOIN members y ON x.group_id = y.group_id AND x.result_id < y.result_id",
    "p2_groups": f"{_LINKS} SELECT * FROM members",
    "p2_links": f"{_LINKS} SELECT * FROM links",
    "p3_found": "SELECT result_id FROM search_results WHERE length(text) > 1500",
    "p6_found": f"{_LEAKS} SELECT doc_id, item_id FROM found",
    "p6_clean": rf"""WITH b AS ({_grams('benchmark', 'item_id')}), d AS (SELECT row_number() OVER () AS rid, doc_id, text, CASE WHEN regexp_matches(text, {_quote(UNUSUAL)}) THEN nfc_normalize(translate(text, {_quote(FULL_WIDTH + BLANKS + INVISIBLE)}, {_quote(ORDINARY + ' ' * len(BLANKS))})) ELSE text END AS folded FROM documents),
k AS (SELECT rid, unnest(x) AS token, unnest(range(1, len(x) + 1)) AS t FROM (SELECT rid, regexp_extract_all(folded, '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+') AS x FROM d WHERE text IS NOT NULL)),
w AS (SELECT *, sum(is_word) OVER (PARTITION BY rid ORDER BY t) AS word_no FROM (SELECT *, regexp_matches(token, '^[\p{{L}}\p{{N}}]')::INT AS is_word FROM k)),
l AS (SELECT rid, list(lower(translate(token, {_quote(LATIN + GREEK)}, {_quote(CYRILLIC + GREEK_AS_CYRILLIC)})) ORDER BY t) AS words FROM w WHERE is_word = 1 GROUP BY rid),
h AS (SELECT rid, i FROM (SELECT rid, i, array_to_string(list_slice(words, i, i + 12), ' ') AS gram FROM (SELECT rid, words, unnest(range(1, len(words) - 11)) AS i FROM l)) WHERE gram IN (SELECT gram FROM b)),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 13)) AS word_no FROM h),
m AS (SELECT w.*, a.rid IS NOT NULL AND (is_word = 1 OR z.rid IS NOT NULL) AS cut FROM w LEFT JOIN gone a ON a.rid = w.rid AND a.word_no = w.word_no LEFT JOIN gone z ON z.rid = w.rid AND z.word_no = w.word_no + 1),
made AS (SELECT rid, sum(is_word)::INT AS n_words, coalesce(sum(CASE WHEN cut AND is_word = 1 THEN 1 END), 0)::INT AS n_removed, coalesce(string_agg(CASE WHEN NOT cut THEN token END, '' ORDER BY t), '') AS kept FROM m GROUP BY rid)
SELECT doc_id, CASE WHEN n_removed > 0 THEN kept ELSE text END AS text, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed FROM d LEFT JOIN made USING (rid) WHERE coalesce(n_removed, 0) <= 0.5 * coalesce(n_words, 0)""",
    "p6_items": f"{_LEAKS} SELECT item_id, count(*) AS n_documents FROM found GROUP BY item_id",
}
