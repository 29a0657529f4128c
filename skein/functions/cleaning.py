"""Column functions that clean recognised Markdown: labels, captions, formulas, refusals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of figures and tables, refusals of a recognition service, marks of doubtful tables, commands for letters.
LABEL = r"(?:#+[ \t]*)?((?:Р\s*и\s*с\s*у\s*н\s*о\s*к|Р\s*и\s*с[ \t]*\.?|Т\s*а\s*б\s*л\s*и\s*ц\s*а|Таблиц[аы])[ \t]*\d[^\n]*?)[ \t]*"
REFUSALS = [
    r"не\s+(?:смо?г(?:ла)?|могу|удалось|удаётся|получилось)\s+(?:распознать|прочитать|обработать)", r"не\s+распознал(?:а)?", r"не\s+является\s+таблицей", r"нет\s+таблицы",
    r"извините[^\n]*не\s+(?:могу|смог(?:ла)?)", r"(?:cannot|could\s*not|can't|unable\s+to)\s+(?:recognize|recognise|read|process|identify|parse)", r"i['\s]?m\s+(?:sorry|unable)",
    r"i\s+am\s+(?:sorry|unable)", r"(?:no\s+table|not\s+a\s+table)",
]
DOUBTFUL = r"<!--\s*WARN_([0-9A-Za-zА-Яа-я.]+)\s*-->"
_LETTERS = r"\\(?:pmb|mathbf|mathsf|boldsymbol|mathfrak)\s*\{\s*([^}]+?)\s*\}"


def refused(content: Column) -> Column:
    """Whether a recognition gave nothing, or says that it could not read."""
    return F.coalesce((F.trim(content) == "") | content.rlike("(?iu)" + "|".join(f"(?:{p})" for p in REFUSALS)), F.lit(True))


def doubtful_tables(text: Column) -> Column:
    """Numbers of tables marked as doubtful, in order, each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(DOUBTFUL), F.lit(1)))


#: Share of a text that what was made of it must have.
LEAST_SHARE = 0.85


def made_or_original(made: Column, original: Column, least: float = LEAST_SHARE) -> Column:
    """What was made of a text, or the text itself where that is null, empty, much shorter or without one of its table markers."""
    marker = r"<!--\s*(t_p\d+_\d+)\s*-->"
    ids = lambda c: F.regexp_extract_all(c, F.lit(marker), F.lit(1))
    whole = (made != "") & (F.length(made) >= least * F.length(original)) & (F.size(F.array_except(ids(original), ids(made))) == 0)
    return F.when(F.coalesce(whole, F.lit(False)), made).otherwise(original)


def italic_labels(text: Column) -> Column:
    """Lines that label a table or a figure in italics, no headings, with a blank line before."""
    apart = F.regexp_replace(text, rf"(?iu)(?<=[^\n])\n[ \t]*{LABEL}(?=\n|$)", "\n\n$1")
    return F.regexp_replace(apart, rf"(?iu)(?<=^|\n)[ \t]*{LABEL}(?=\n|$)", "*$1*")


def italic_image_captions(text: Column) -> Column:
    """A line that begins with Рис. right under an image in italics."""
    return F.regexp_replace(text, r"(?iu)(!\[[^\n]*)\n[ \t]*(Рис\.?\s[^\n]*?)[ \t]*(?=\n|$)", "$1\n*$2*")


def joined_digits(text: Column) -> Column:
    """Numbers without blanks inside: 0 , 4 2 9 becomes 0,429."""
    return F.regexp_replace(F.regexp_replace(text, r"(\d)\s*,\s*(?=\d)", "$1,"), r"(\d)\s+(?=\d)", "$1")


def plain_formula(formula: Column) -> Column:
    """A formula without blanks in numbers, commands for letter shapes and artefacts of recognition."""
    out = F.regexp_replace(joined_digits(formula), _LETTERS, "$1")
    out = F.regexp_replace(F.regexp_replace(out, r"\\mathrm\s*\{\s*_?([^}]+?)\s*\}", r"\\text{$1}"), r"\\(?:tt|sf)\s*|\\f(?![a-zA-Z])\s*|\\,\s*", "")
    out = F.replace(out, F.lit("\\ldots"), F.lit("..."))
    return F.regexp_replace(F.regexp_replace(out, r"(\S)(\\\^)\{", "$1 $2 {"), r"(\d)\\(')", r"$1 $2")


def plain_formulas(text: Column) -> Column:
    """Formulas between double and single dollar signs cleaned; a sign without its partner changes nothing."""

    def inside(part: Column, sign: str, wrap: str, outside: Column | None = None) -> Column:
        pieces = F.split(part, sign.replace("$", r"\$"))
        paired = lambda i: (i % 2 == 1) & (i < F.size(pieces) - 1)
        made = F.transform(pieces, lambda x, i: F.when(paired(i), F.concat(F.lit(wrap), plain_formula(x), F.lit(wrap))).otherwise(outside(x) if outside is not None else x))
        return F.array_join(made, sign)

    return inside(text, "$$", "\n", lambda x: inside(x, "$", ""))
