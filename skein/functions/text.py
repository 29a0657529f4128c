"""Column functions on text: references, captions, tables, dates, designations, clean-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.folding import BLANKS

_NUMBER = r"(?:[A-Za-zА-Яа-яЁё]\.)?[0-9]+(?:\.[0-9]+)*"
#: Any blanks, in words that both Java and RE2 know.
ANY_BLANKS = r"[\s" + BLANKS + "]*"
# Labels of references in running text, and what is read as each.
REFERENCES = {
    label: r"(?iu)(?<![\p{L}])" + word + ANY_BLANKS + f"({_NUMBER})"
    for label, word in {"п.": r"п(?:ункт[а-яё]*|\.)", "разд.": r"разд(?:ел[а-яё]*|\.)", "табл.": r"табл(?:иц[а-яё]*|\.)"}.items()
}
TABLE_CAPTION = r"(?iu)(?:таблиц[\p{L}\p{N}_]*|табл\.?|table)" + ANY_BLANKS + f"({_NUMBER})"
IMAGE_CAPTION = r"(?iu)(?:рисун[\p{L}\p{N}_]*|рис\.?|fig(?:ure)?\.?|изображени[\p{L}\p{N}_]*)" + ANY_BLANKS + f"({_NUMBER})"
# Labels in captions of stored tables and images.
STORED_TABLE = r"(?iu)^\s*(?:таблиц[\p{L}\p{N}_]*|табл\.?|table)\s+" + f"({_NUMBER})"
STORED_IMAGE = r"(?iu)(?:fig|рис|рисун[\p{L}\p{N}_]*)[_\s]+" + f"({_NUMBER})"
# Cyrillic letters and their Latin spelling in slugs; capitals likewise.
SLUG_ONE, SLUG_AS = "абвгдеёзийклмнопрстуфхцыэ", "abvgdeeziyklmnoprstufhcye"
SLUG_MORE = {"ж": "zh", "ч": "ch", "ш": "sh", "щ": "sch", "ю": "yu", "я": "ya", "ъ": "", "ь": ""}
# What stands for a table that is shown as an image.
TABLE_SIGN = "см. прикреплённое изображение"


def references(text: Column) -> Column:
    """Distinct references of a text as label and number, sorted as strings."""

    def found(label: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda n: F.concat(F.lit(label + " "), n))

    return F.array_sort(F.array_distinct(F.concat(*[found(k, p) for k, p in REFERENCES.items()])))


def reference_number(number: Column) -> Column:
    return F.lower(F.regexp_replace(number, r"\s+", ""))


def caption_number(asset_type: Column, caption: Column) -> Column:
    """The number in a stored caption: of a table at its beginning, of an image anywhere (fig_1 as well); null without one."""
    number = F.when(asset_type == "table", F.regexp_extract(caption, STORED_TABLE, 1)).otherwise(F.regexp_extract(caption, STORED_IMAGE, 1))
    return F.nullif(reference_number(number), F.lit(""))


def asset_references(text: Column) -> Column:
    """Distinct (asset_type, number) that a text names: tables in order, then images."""

    def found(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda n: F.struct(F.lit(kind).alias("asset_type"), reference_number(n).alias("number")))

    return F.array_distinct(F.concat(found("table", TABLE_CAPTION), found("image", IMAGE_CAPTION)))


def normal_date(value: Column) -> Column:
    """The first ISO, DD.MM.YYYY or DD.MM.YY date in a value as yyyy-MM-dd; impossible dates are null."""
    iso = F.regexp_extract(value, r"(\d{4})-(\d{2})-(\d{2})", 0)
    long = F.regexp_extract(value, r"(\d{2})\.(\d{2})\.(\d{4})", 0)
    short = F.regexp_extract(value, r"(\d{2})\.(\d{2})\.(\d{2})(?!\d)", 0)
    year = F.substring(short, 7, 2).cast("int")
    full = F.concat(F.substring(short, 1, 6), F.when(year < 50, "20").otherwise("19"), F.substring(short, 7, 2))
    text = F.when(iso != "", iso).when(long != "", F.concat_ws("-", F.substring(long, 7, 4), F.substring(long, 4, 2), F.substring(long, 1, 2)))
    text = text.when(short != "", F.concat_ws("-", F.substring(full, 7, 4), F.substring(full, 4, 2), F.substring(full, 1, 2)))
    return F.date_format(F.try_to_date(text, "yyyy-MM-dd"), "yyyy-MM-dd")


def document_type(document_id: Column) -> Column:
    return F.nullif(F.regexp_extract(document_id, r"^(ГОСТ|СП|СО|СНиП|ПУЭ)", 1), F.lit(""))


def edition(document_id: Column) -> Column:
    """The year at the end of a designation: four digits as they are, two digits with 50 as the turn."""
    last = F.try_element_at(F.regexp_extract_all(document_id, F.lit(r"\d+"), F.lit(0)), F.lit(-1))
    century = F.when(last.cast("int") < 50, "20").otherwise("19")
    return F.when(F.length(last) == 4, last).when(F.length(last) == 2, F.concat(century, last))


def slug(text: Column) -> Column:
    """Latin letters in the case of the text, digits and single underscores; DOC where nothing is left."""
    out = F.translate(F.coalesce(text, F.lit("")), SLUG_ONE + SLUG_ONE.upper(), SLUG_AS + SLUG_AS.upper())
    for letter, latin in SLUG_MORE.items():
        out = F.replace(F.replace(out, F.lit(letter), F.lit(latin)), F.lit(letter.upper()), F.lit(latin.capitalize()))
    out = F.regexp_replace(F.regexp_replace(out, r"[^A-Za-z0-9]+", "_"), r"^_+|_+$", "")
    return F.when(out != "", out).otherwise("DOC")


def cell_set(markdown: Column) -> Column:
    """Distinct cells of the pipe tables in a text: marks and separators dropped, lower case, longer than one."""
    rows = F.filter(F.split(markdown, "\n"), lambda row: F.ltrim(row).startswith("|"))
    cells = F.flatten(F.transform(rows, lambda row: F.split(row, r"\|")))
    clean = F.transform(cells, lambda c: F.lower(F.trim(F.regexp_replace(F.translate(c, BLANKS + "*_$\\", " " * len(BLANKS)), r"\s+", " "))))
    return F.array_distinct(F.filter(clean, lambda c: (F.length(c) > 1) & ~c.rlike(r"^[-: ]+$")))


def table_spans(text: Column) -> Column:
    """(first_line, last_line, n_rows) of each run of lines that start with a pipe, from line 1, at least 3 long."""
    marked = F.transform(F.split(text, "\n"), lambda row: F.ltrim(row).startswith("|"))
    span = "struct<first_line:int,last_line:int,n_rows:int>"
    start = F.struct(F.array().cast(f"array<{span}>").alias("done"), F.lit(0).alias("n"), F.lit(0).alias("begin"))

    def closed(s: Column) -> Column:
        one = F.struct(s["begin"].alias("first_line"), s["n"].alias("last_line"), (s["n"] - s["begin"] - 1).alias("n_rows"))
        return F.when((s["begin"] > 0) & (s["n"] - s["begin"] >= 2), F.concat(s["done"], F.array(one))).otherwise(s["done"])

    def step(s: Column, pipe: Column) -> Column:
        inside = F.when(s["begin"] > 0, s["begin"]).otherwise(s["n"] + 1)
        return F.when(pipe, F.struct(s["done"].alias("done"), (s["n"] + 1).alias("n"), inside.alias("begin"))).otherwise(
            F.struct(closed(s).alias("done"), (s["n"] + 1).alias("n"), F.lit(0).alias("begin"))
        )

    return F.aggregate(marked, start, step, closed)


_ROW, _RULE = r"[ \t]*\|[^\n]*\|[ \t]*", r"[ \t]*\|(?:[ \t]*:?-{3,}:?[ \t]*\|)+[ \t]*"
#: A pipe table with a separator row; and one right under its caption.
PIPE_TABLE = rf"^(?:{_ROW}\n)*?{_RULE}(?:\n{_ROW})*$"
CAPTIONED_TABLE = r"^[ \t]*(?:таблиц[\p{L}\p{N}_]*|табл\.?)[ \t]+" + f"({_NUMBER})" + r"(?:[ \t]*[—–-][^\n]*)?[ \t]*\n" + PIPE_TABLE[1:]


def without_tables(text: Column) -> Column:
    """Each pipe table with a separator row as one line that points to its image, with the number of a caption right above it."""
    named = F.regexp_replace(text, "(?ium)" + CAPTIONED_TABLE, f"Таблица $1 — {TABLE_SIGN}")
    return F.regexp_replace(named, "(?m)" + PIPE_TABLE, f"(таблица — {TABLE_SIGN})")


def point_id(chunk_id: Column, row: Column) -> Column:
    """The name-based UUID (version 5, URL namespace) of chunk_id::row."""
    name = F.concat(chunk_id, F.lit("::"), row.cast("string"))
    digest = F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), F.encode(name, "utf-8")))
    part = lambda a, n: F.substring(digest, a, n)
    variant = F.lower(F.hex(F.conv(part(17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def embedding_text(document_id: Column, title: Column, domain: Column, path: Column, text: Column, captions: Column) -> Column:
    """What a row is embedded by: document line, heading path, text, captions; blank parts fall away."""
    about = F.concat(F.coalesce(document_id, F.lit("")), F.lit(". "), F.coalesce(title, F.lit("")), F.when(domain != "", F.concat(F.lit(" ("), domain, F.lit(")"))).otherwise(""))
    held = F.when(F.size(captions) > 0, F.concat(F.lit("Содержит: "), F.array_join(captions, "; ")))
    parts = F.array(about, F.coalesce(path, F.lit("")), F.coalesce(text, F.lit("")), F.coalesce(held, F.lit("")))
    return F.array_join(F.filter(parts, lambda p: F.trim(p) != ""), "\n\n")


def join_spaced_labels(text: Column) -> Column:
    """Таблица, Примечание and Рисунок written letter by letter."""
    for word in ("Таблица", "Примечание", "Рисунок"):
        text = F.regexp_replace(text, "(?iu)" + r"\s".join(word), word)
    return text
