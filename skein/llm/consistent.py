"""One consistent form for text that looks the same but is stored with different characters.

The words of all values that could be stored in another way (letters of two alphabets or look-alikes
only, full-width forms, separate accents, invisible characters) are counted over the whole table and
grouped in SQL by their look-alike-mapped spelling under the accent-sensitive UNICODE collation; each
class has one canonical member, which is joined back to the words that differ from it. What stands
between words (other blanks, full-width marks) has one ordinary twin each, whatever the table.

The most frequent words of the classes, a bounded number, go to every task, so values that hold only
such words are respelled where they are read. A value with a rarer word is completed by a join on its
digest; such a word is in few values, so no key of that join is hot.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.folding import CYRILLIC, FULL_WIDTH, GREEK, INVISIBLE, LATIN, ORDINARY, UNUSUAL, WORD, as_cyrillic, as_latin, fold_text
from skein.session import cut_lineage

#: Words with their canonical spelling that every task holds.
MOST_WORDS = 50_000
_ALPHABETS = [re.compile(x) for x in ("[Ѐ-ԯ]", "[A-Za-zÀ-ɏ]", "[Ͱ-Ͽ]")]
_NOT_TWIN = re.compile(f"[^0-9{CYRILLIC}{LATIN}{GREEK}]")
#: A word as it is stored, with what belongs to it unseen.
_STORED = re.compile(rf"(?:[^\W_]|[{INVISIBLE}̀-ͯ])+")


_UNUSUAL = re.compile(UNUSUAL)


class _Folded(dict):
    """A stored word's folded form if its spelling is in question, else None; held for so many words at most."""

    def __missing__(self, word: str) -> str | None:
        if len(self) > 500_000:
            self.clear()
        folded = fold_text(word)
        alphabets = sum(bool(x.search(folded)) for x in _ALPHABETS)
        asked = folded != word or alphabets > 1 or alphabets == 1 and not _NOT_TWIN.search(folded)
        self[word] = out = folded if asked else None
        return out


def _words(text: str) -> list[str]:
    """A text's words as they are stored; the plainer pattern finds the same where nothing is unusual."""
    return (_STORED if _UNUSUAL.search(text) else WORD).findall(text)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words in question with their counts, added up before they leave the task."""
    asked, found = _Folded(), Counter()

    def out() -> pa.RecordBatch:
        words = list(found)
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([asked[w] for w in words], pa.string()), pa.array(found.values(), pa.int64())], ["word", "folded", "n"])

    for batch in batches:
        for text in batch.column("value").to_pylist():
            found.update(w for w in _words(text) if asked[w] is not None)
        if len(found) > 200_000:
            yield out()
            found.clear()
    yield out()


def canonical_words(words: DataFrame) -> DataFrame:
    """``words``: word, n (how often), folded (as folding characters makes it; the word itself if absent).
    Returns word, canonical for the words that must change.

    Classes are the words with equal look-alike-mapped spelling under the UNICODE collation (accents and
    case count, composed and separate accents are equal). The canonical member is the one of a single
    alphabet that the table uses most; ties go to the spelling first in code point order. A class
    without such a member takes the spelling that look-alikes turn into one alphabet; where there is
    none (letters of both alphabets without twins) the words stay as folded.
    """
    if "folded" not in words.columns:
        words = words.withColumn("folded", F.col("word"))
    ordinary = F.translate("word", FULL_WIDTH + INVISIBLE, ORDINARY)
    words = words.select("word", "folded", "n", as_cyrillic(ordinary).alias("mapped"))
    spellings = F.array_distinct(F.array("folded", as_cyrillic(F.col("folded")), as_latin(F.col("folded"))))
    members = words.select("mapped", "folded", F.explode(spellings).alias("member"), "n")
    alphabets = [F.col("member").rlike(x).cast("int") for x in (r"\p{IsCyrillic}", r"\p{IsLatin}", r"\p{IsGreek}")]
    members = members.where(alphabets[0] + alphabets[1] + alphabets[2] <= 1)
    members = members.select("mapped", "member", F.when(F.col("member") == F.col("folded"), F.col("n")).otherwise(0).alias("n"))
    return words.sparkSession.sql(
        """
        WITH uses AS (
          SELECT mapped COLLATE UNICODE AS class, member, sum(n) AS n FROM {members} GROUP BY mapped COLLATE UNICODE, member),
        canon AS (
          SELECT class, min_by(member, struct(-n, member)) AS canonical FROM uses GROUP BY class)
        SELECT w.word, coalesce(c.canonical, w.folded) AS canonical
        FROM {words} w LEFT JOIN canon c ON w.mapped COLLATE UNICODE = c.class
        WHERE w.word <> coalesce(c.canonical, w.folded)
        """,
        members=members,
        words=words,
    )


def _spellings(df: DataFrame, columns: list[str], most_words: int) -> tuple[Broadcast, DataFrame | None]:
    """The most frequent words in question with their canonical spelling (their own if right), and the changes of all others; None if there are no others."""
    values = df.select(F.explode(F.array(*columns)).alias("value")).where(F.col("value").isNotNull())
    words = values.mapInArrow(_count, "word string, folded string, n bigint").groupBy("word", "folded").agg(F.sum("n").alias("n"))
    words = cut_lineage(words)
    changes = cut_lineage(canonical_words(words))
    known = words.join(changes, "word", "left").select("word", F.coalesce("canonical", "word").alias("canonical"), "n")
    head = known.orderBy(F.desc("n"), "word").limit(most_words).select("word", "canonical")
    held = {r["word"]: r["canonical"] for r in head.collect()}
    rest = changes.join(head.select("word"), "word", "left_anti") if len(held) == most_words else None
    return df.sparkSession.sparkContext.broadcast(held), rest


def _inspect(batches: Iterator[pa.RecordBatch], columns: list[str], spellings: Broadcast, texts: bool) -> Iterator[pa.RecordBatch]:
    """Each value's form by the words that the task holds (or whether it has changed), and its words in question that the task does not hold."""
    asked, held = _Folded(), spellings.value
    for batch in batches:
        made = []
        for c in columns:
            forms, opened = [], []
            for text in batch.column(c).to_pylist():
                if text is None:
                    forms.append(None)
                    opened.append([])
                    continue
                words = {w for w in _words(text) if asked[w] is not None}
                respelled = {w: held[w] for w in words if held.get(w, w) != w}
                rare = sorted(w for w in words if w not in held)
                if texts:
                    form = _STORED.sub(lambda m: respelled.get(m[0], m[0]), text) if respelled else text
                    # Words that wait keep their characters; everything between words is ordinary at once.
                    forms.append(_between(form) if rare else fold_text(form))
                else:
                    forms.append(bool(respelled) or fold_text(text) != text)
                opened.append(rare)
            made += [pa.array(forms, pa.string() if texts else pa.bool_()), pa.array(opened, pa.list_(pa.string()))]
        names = [n for i in range(len(columns)) for n in (f"__form_{i}", f"__open_{i}")]
        kept = [n for n in batch.schema.names if texts or n not in columns]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *made], [*kept, *names])


def _between(text: str) -> str:
    out, at = [], 0
    for m in _STORED.finditer(text):
        out += [fold_text(text[at : m.start()]), m[0]]
        at = m.end()
    return "".join([*out, fold_text(text[at:])])


def consistent_form(df: DataFrame, columns: list[str], suffix: str = "_consistent", most_words: int = MOST_WORDS) -> DataFrame:
    """``df`` with a column ``<name><suffix>`` for each of ``columns``.

    Values already in the consistent form come out unchanged; null stays null, empty stays empty. All
    rows are kept, repeated rows and extra columns too; a column that already has a new name is replaced.
    Look-alikes are decided over the given columns of the whole table. Names of columns must be distinct.
    """
    spellings, rest = _spellings(df, columns, most_words)
    schema = ", ".join([f"`{n}` {t}" for n, t in df.dtypes] + [f"__form_{i} string, __open_{i} array<string>" for i in range(len(columns))])
    out = df.mapInArrow(partial(_inspect, columns=columns, spellings=spellings, texts=True), schema)
    if rest is not None:
        waiting = F.lit(False)
        for i in range(len(columns)):
            waiting = waiting | (F.size(f"__open_{i}") > 0)
        done = out.where(waiting)
        for i in range(len(columns)):
            form, words = F.col(f"__form_{i}"), F.col(f"__open_{i}")
            changes = done.where(F.size(words) > 0).select(F.md5(form).alias("__of"), F.explode(words).alias("word")).distinct().join(rest, "word")
            changes = changes.groupBy("__of").agg(F.sort_array(F.collect_list(F.struct("word", "canonical"))).alias("__changes"))
            respelled = F.when(F.col("__changes").isNull(), form).otherwise(_respell(form, F.col("__changes")))
            done = done.withColumn("__of", F.md5(form)).join(changes, "__of", "left").withColumn(f"__form_{i}", respelled).select(*out.columns)
        out = out.where(~waiting).unionByName(done)
    kept = [n for n in df.columns if n not in [c + suffix for c in columns]]
    return out.select(*kept, *[F.col(f"__form_{i}").alias(c + suffix) for i, c in enumerate(columns)])


def _respell(text: Column, changes: Column) -> Column:
    inside = rf"[\p{{L}}\p{{N}}{INVISIBLE}̀-ͯ]"

    def one(done: Column, change: Column) -> Column:
        whole = F.concat(F.lit(f"(?<!{inside})"), change["word"], F.lit(f"(?!{inside})"))
        return F.regexp_replace(done, whole, change["canonical"])

    return F.aggregate(changes, text, one)


def inconsistent_values(df: DataFrame, key: str, columns: list[str], most_words: int = MOST_WORDS) -> DataFrame:
    """Which values of which rows hold a character that the consistent form replaces or drops: the key and field_name, once for each row."""
    spellings, rest = _spellings(df, columns, most_words)
    rows = df.select(F.col(key).alias("__key"), *columns)
    kind = dict(rows.dtypes)["__key"]
    schema = f"__key {kind}, " + ", ".join(f"__form_{i} boolean, __open_{i} array<string>" for i in range(len(columns)))
    seen = rows.mapInArrow(partial(_inspect, columns=columns, spellings=spellings, texts=False), schema)
    fields = F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(f"__form_{i}").alias("changed"), F.col(f"__open_{i}").alias("words")) for i, c in enumerate(columns)])
    seen = seen.select("__key", F.monotonically_increasing_id().alias("__row"), F.inline(fields))
    sure = seen.where("changed").select("__key", "field_name")
    if rest is None:
        return sure.withColumnRenamed("__key", key)
    waiting = seen.where("NOT changed").select("__key", "__row", "field_name", F.explode("words").alias("word"))
    late = waiting.join(rest, "word").select("__key", "__row", "field_name").distinct().drop("__row")
    return sure.unionByName(late).withColumnRenamed("__key", key)
