"""Repair of text from scanned pages.

1. Furniture: page numbers (one more than the page, counted from 0) and running headers (the title
   page's designation and title, given phrases, and lines found by repetition at the edges of pages of
   several documents) are cut out, whether blocks of their own or inside text.
2. Words broken at a hyphen are joined, also over block and page borders; letters set apart too.
3. Misread words: a symmetric-delete index over the frequent words of the whole corpus gives correction
   candidates for malformed and rare words; weighted edit distance with confusion pairs, frequency and
   the bigrams with both neighbours choose the repair.

All word statistics are tables joined by word: nothing grows on the driver or in one task.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Set
from functools import partial
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.marks import SLOTS, marks
from skein.session import cut_lineage

# What a scan makes of a letter (right, as read), and of a digit.
LETTER_CONFUSIONS = {
    "о": "0cс", "з": "3", "б": "6", "ч": "4", "в": "8", "и": "unн", "т": "mг", "п": "nл", "г": "rт", "н": "и", "с": "е", "е": "с",
    "л": "п", "ц": "упи", "ш": "щ", "щ": "ш", "у": "ц", "к": "x", "а": "о", "ь": "b", "ы": "ьi", "д": "л", "ж": "х", "й": "и", "р": "p",
}
SEQUENCE_CONFUSIONS = {"JI": "л", "jI": "л", "bI": "ы", "ьI": "ы", "lll": "ш", "IIl": "ш", "III": "ш", "IO": "ю", "lO": "ю", "I0": "ю", "rn": "т", "}K": "ж"}
SINGLE_AS_CYRILLIC = dict(zip("03648umnrbaceopxyABEKMHOPCTXYik", "озбчвитпгьасеорхуАВЕКМНОРСТХУік"))
DIGIT_CONFUSIONS = {"О": "0", "о": "0", "O": "0", "З": "3", "з": "3", "б": "6", "S": "5", "s": "5", "l": "1", "I": "1", "i": "1", "ч": "4", "Ч": "4", "В": "8", "B": "8", "Б": "6"}
#: Running headers known beforehand, beside each document's title and designation and what repetition finds.
PHRASES = ("издание официальное",)
#: A header by repetition: its characters at least, and on how many pages of how many documents it stands at an edge.
HEADER_CHARS, HEADER_PAGES, HEADER_DOCUMENTS = 10, 5, 2
#: Headers by repetition that every task holds, the most frequent ones; rows that may hold a rarer one get it by a join.
MOST_HEADERS = 50_000
#: Characters of the longest word that is repaired or proposed as a repair.
LONGEST = 40
#: Copies of each title page for the join with its document's blocks, so that no task gets all blocks of a large document.
TITLE_COPIES = 32

_HYPHEN = "-‐‑–¬­"
_SPLIT = re.compile(rf"([^\W\d_][^\W_]*)[{_HYPHEN}][ \t]*(?:\n|[ \t])[ \t]*([^\W_]+)")
_BREAK = re.compile(rf"[{_HYPHEN}]\s")
_SOFT = re.compile(r"([^\W_]+)[¬­]\s*([^\W_]+)")
_ENDS = set(_HYPHEN)
_OPEN_END = re.compile(rf"([^\W\d_]+)[{_HYPHEN}]\s*$")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W_][   ]{1,2}){3,}[^\W_](?![^\W_])")
_TOKEN = re.compile(r"[^\W_]+(?:-[^\W_]+)*")
_NUMBER = re.compile(r"(?<![^\W_])(?:\[(\w{1,5})\]|[—–-] (\w{1,5}) [—–-]|[СC]\. (\w{1,5})|[сc]тр\. (\w{1,5})|(\w{1,5}) [иu][з3] \w{1,5})(?![^\W_])")
_AS_DIGITS = str.maketrans(DIGIT_CONFUSIONS)


class _Flat(dict):
    """Each character's class, or nothing for blanks and hyphens."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        low = SINGLE_AS_CYRILLIC.get(c, c).lower()
        self[code] = out = "" if c.isspace() or c in _HYPHEN + "—" else _CLASS.get(low, low)
        return out


_FLAT = _Flat()
_SEQUENCE = re.compile("|".join(map(re.escape, SEQUENCE_CONFUSIONS)))


def _flat(text: str) -> str:
    """A text with confusable characters made equal, without blanks."""
    out, at = [], 0
    for m in _SEQUENCE.finditer(text):
        good = SEQUENCE_CONFUSIONS[m[0]]
        out += [text[at : m.start()].translate(_FLAT), _CLASS.get(good, good)]
        at = m.end()
    return "".join([*out, text[at:].translate(_FLAT)])


def _places(text: str) -> list[int]:
    """The place in the text that each character of its flat form comes from."""
    out, at = [], 0
    for m in _SEQUENCE.finditer(text):
        out += [i for i in range(at, m.start()) if _FLAT[ord(text[i])]]
        out.append(m.start())
        at = m.end()
    return out + [i for i in range(at, len(text)) if _FLAT[ord(text[i])]]


class _Keys(dict):
    """Titles and designations in flat form, for so many at most."""

    def __missing__(self, text: str) -> str:
        if len(self) > 10_000:
            self.clear()
        self[text] = out = _flat(text)
        return out


_KEYS = _Keys()

# One member for each set of letters that scans mix up.
_CLASS = {"и": "н", "т": "г", "п": "л", "ц": "л", "у": "л", "с": "е", "щ": "ш", "з": "з", "й": "н", "о": "о"} | {d: c for d, c in zip("123456789", "12з4б6789")} | {"б": "6", "з": "3", "ч": "4", "в": "8", "о": "0", "s": "5", "l": "1", "i": "1"}
_CLASS["5"] = "5"
_CLASS["6"] = "6"
_CLASS["3"] = "3"


def _line_runs(text: str) -> Iterator[tuple[str, int, int]]:
    """Runs of whole lines as long as a header can be: flat form (a character has two there at most), begin and end in the text."""
    lines, at = [], 0
    for line in text.split("\n"):
        flat = _flat(line)
        if flat:
            blank = next(i for i, c in enumerate(line) if _FLAT[ord(c)])
            lines.append((flat, at + blank, line[:blank]))
        at += len(line) + 1
    for i, (_, begin, before) in enumerate(lines):
        if before.strip(" \t") or before and begin == len(before):
            continue
        run = ""
        for j in range(i, len(lines)):
            run += lines[j][0]
            if len(run) > 8 * HEADER_CHARS:
                break
            end = lines[j + 1][1] if j + 1 < len(lines) else len(text)
            if len(run) >= HEADER_CHARS and (end == len(text) or not lines[j + 1][2].strip()):
                yield run, begin, begin + len(text[begin:end].rstrip())


def furniture(text: str, page: int | None, designation: str | None, title: str | None, front: bool = False, repeated: Set[str] = frozenset()) -> tuple[str, bool, bool]:
    """A text without page numbers and running headers; whether there was a header; whether there was a number.

    ``front``: the text is the title page's designation or title itself. ``repeated``: headers found by
    repetition, in flat form; they count where they are whole lines.
    """
    if page is None or front:
        return text, False, False
    cut: list[tuple[int, int]] = []
    numbered = False
    for m in _NUMBER.finditer(text):
        read = next(g for g in m.groups() if g)
        if read.translate(_AS_DIGITS) == str(page + 1):
            cut.append(m.span())
            numbered = True
    flat, places = _flat(text), []
    header = False
    for known in [*PHRASES, title, designation]:
        key = _KEYS[known or ""]
        if len(key) < 6:
            continue
        at = flat.find(key)
        while at >= 0:
            places = places or _places(text)
            begin, end = places[at], places[at + len(key)] if at + len(key) < len(places) else len(text)
            if (not text[begin - 1 : begin].isalnum() or begin == 0) and not (known == title and begin and text[begin].islower()):
                end = end if end == len(text) else max(begin + 1, len(text[:end].rstrip()))
                draft = re.compile(r"\s*\(пр[о0]ект\)|\.(?=\s)").match(text, end)
                cut.append((begin, draft.end() if draft else end))
                header = True
            at = flat.find(key, at + len(key))
    if repeated:
        done: dict[str, int] = {}
        for key, begin, end in _line_runs(text):
            if key in repeated and begin >= done.get(key, 0):
                cut.append((begin, end))
                done[key], header = end, True
    # Title lines that wrapped at the block's border are the start or the end of the title.
    key = _KEYS[title or ""]
    if flat and len(flat) >= 10 and len(flat) < len(key) and (key.startswith(flat) or key.endswith(flat)):
        return "", True, numbered
    if not cut:
        if text.strip().translate(_AS_DIGITS) == str(page + 1):
            return "", False, True
        bare = [m for m in re.finditer(r"(?m)^[ \t]*(\d{1,4})[ \t]*$", text) if m[1] == str(page + 1)]
        if bare and "\n" in text:
            return (text[: bare[0].start()] + text[bare[0].end() :]).strip("\n"), False, True
        return text, False, False
    out, at, seams = [], 0, []
    for begin, end in sorted(cut):
        if begin > at:
            out.append(text[at:begin])
        at = max(at, end)
        seams.append(at)
    out.append(text[at:])
    kept = [x.strip() for x in out if x.strip()]
    if header:
        # A bare number beside a header is the page's.
        for i, x in enumerate(kept):
            plain = re.sub(rf"^{page + 1}(?=\s|$)|(?<=\s){page + 1}$", "", x).strip()
            if plain != x:
                numbered, kept[i] = True, plain
    return "\n".join(x for x in kept if x), header, numbered


def _join_splits(text: str) -> tuple[str, list[dict]]:
    splits: list[dict] = []

    def join(m: re.Match) -> str:
        upper = m[2][0].isalpha() and not m[2][0].islower() and not m[2].startswith(tuple(SEQUENCE_CONFUSIONS))
        if upper or m[2] in ("и", "или") or m[2].isdigit() and len(m[2]) > 1 or m[1][-1].isdigit() and sum(map(str.isalpha, m[1])) < 2:
            return m[0]
        splits.append({"first": m[1], "second": m[2]})
        return m[1] + m[2]

    for _ in range(2):  # a word can be broken twice
        if _BREAK.search(text):
            text = _SPLIT.sub(join, text)
        if "¬" in text or "­" in text:
            text = _SOFT.sub(join, text)
    return text, splits


_SCANNED = (
    "src_table string, row_id bigint, doc_key string, page int, pos int, layout_type string, plain string, header boolean, numbered boolean, "
    "open_end string, splits array<struct<first:string,second:string>>, spaced array<string>"
)


def _open_runs(r: dict, held: Set[str], asked: _Asked) -> list[str]:
    """A row's runs of lines that may be headers which the task does not hold."""
    if r["page"] is None or r["front"]:
        return []
    return [key for key, _, _ in _line_runs(r["text"] or "") if key not in held and asked[key]]


def _waiting(batches: Iterator[pa.RecordBatch], headers: Broadcast, table: Broadcast) -> Iterator[pa.RecordBatch]:
    """Rows with open runs, and these runs."""
    asked = _Asked(table.value)
    for batch in batches:
        runs = [_open_runs(r, headers.value, asked) for r in batch.to_pylist()]
        rows = [i for i, x in enumerate(runs) if x]
        taken = [c.take(pa.array(rows, pa.int64())) for c in batch.columns]
        yield pa.RecordBatch.from_arrays([*taken, pa.array([runs[i] for i in rows], pa.list_(pa.string()))], [*batch.schema.names, "runs"])


def _scan(batches: Iterator[pa.RecordBatch], headers: Broadcast, table: Broadcast | None = None) -> Iterator[pa.RecordBatch]:
    """The furniture is cut and words are joined. With a table, rows with open runs are left out; a column ``rare`` has further headers."""
    held = headers.value
    asked = _Asked(table.value) if table else None
    for batch in batches:
        rows = []
        repeated = held.union(*(x for x in batch.column("rare").to_pylist() if x)) if "rare" in batch.schema.names else held
        for r in batch.to_pylist():
            if asked is not None and _open_runs(r, held, asked):
                continue
            plain, header, numbered = furniture(r["text"] or "", r["page"], r["designation"], r["title"], r["front"], repeated)
            plain, splits = _join_splits(plain)
            spaced = [re.sub(r"\s", "", m[0]) for m in _SPACED.finditer(plain)]
            plain = _SPACED.sub(lambda m: re.sub(r"\s", "", m[0]), plain)
            end = _OPEN_END.search(plain) if plain.rstrip()[-1:] in _ENDS else None
            rows.append({k: r[k] for k in ("src_table", "row_id", "doc_key", "page", "pos", "layout_type")} | {"plain": plain, "header": header, "numbered": numbered, "open_end": end[1] if end else None, "splits": splits, "spaced": spaced})
        yield pa.RecordBatch.from_pylist(rows, schema=_SCANNED_ARROW)


_SCANNED_ARROW = pa.schema(
    [("src_table", pa.string()), ("row_id", pa.int64()), ("doc_key", pa.string()), ("page", pa.int32()), ("pos", pa.int32()), ("layout_type", pa.string()), ("plain", pa.string()), ("header", pa.bool_()), ("numbered", pa.bool_()), ("open_end", pa.string()), ("splits", pa.list_(pa.struct([("first", pa.string()), ("second", pa.string())]))), ("spaced", pa.list_(pa.string()))]
)


def _flat_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat = [_flat(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_key", "page", "pos")), pa.array(flat, pa.string())], ["doc_key", "page", "pos", "flat"])


def header_lines(blocks: DataFrame) -> DataFrame:
    """flat, edges: flat forms of short blocks without digits that stand first or last on pages of several documents, and
    hardly elsewhere, and on how many pages they do.

    Titles stand on the pages of one document and are none of them, nor are the given phrases. A page counts once, whatever
    the copies of it in other documents: in copies of a document every heading at an edge is repeated.
    """
    places = blocks.where("doc_key IS NOT NULL AND page > 0 AND pos IS NOT NULL")
    edges = places.groupBy("doc_key", "page").agg(F.min("pos").alias("top"), F.max("pos").alias("bottom"), F.sum(F.xxhash64("text").bitwiseAND(F.lit(0xFFFFFFFF))).alias("digest"))
    short = places.where(F.length("text").between(HEADER_CHARS, 4 * HEADER_CHARS) & ~F.col("text").rlike("[0-9]{2}|\n")).select("doc_key", "page", "pos", "text")
    lines = short.mapInArrow(_flat_lines, "doc_key string, page int, pos int, flat string").where(F.length("flat") >= HEADER_CHARS)
    edge = (F.col("pos") == F.col("top")) | (F.col("pos") == F.col("bottom"))
    pages = lines.join(edges, ["doc_key", "page"]).groupBy("flat", "page", "digest").agg(F.min("doc_key").alias("doc_key"), F.max(edge.cast("int")).alias("edge"))
    documents = pages.groupBy("flat", "doc_key").agg(F.count(F.lit(1)).alias("pages"), F.sum("edge").alias("edges"))
    found = documents.groupBy("flat").agg(F.sum("pages").alias("pages"), F.sum("edges").alias("edges"), F.count(F.lit(1)).alias("documents"))
    found = found.where((F.col("edges") >= HEADER_PAGES) & (F.col("documents") >= HEADER_DOCUMENTS) & (F.col("edges") >= 0.95 * F.col("pages")))
    return found.where(~F.col("flat").isin([_flat(p) for p in PHRASES])).select("flat", "edges")


def repeated_headers(blocks: DataFrame, most: int = MOST_HEADERS) -> list[str]:
    """The ``most`` most frequent ones of ``header_lines``, which come to the driver; ``rarer_headers`` are all others."""
    return [r["flat"] for r in header_lines(blocks).orderBy(F.desc("edges"), "flat").limit(most).collect()]


def rarer_headers(blocks: DataFrame, held: list[str]) -> DataFrame:
    """flat: all ``header_lines`` but those of ``held``, the most frequent ones in their order."""
    found = cut_lineage(header_lines(blocks))
    least = found.where(F.col("flat") == held[-1]).first()["edges"]
    return found.where((F.col("edges") < least) | (F.col("edges") == least) & (F.col("flat") > held[-1])).select("flat")


def scanned_rows(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """Both tables' texts in one form: src_table, row_id, doc_key, page, pos, text, front, designation, title."""
    is_front = F.coalesce(F.expr("page = 0 AND pos IN (0, 1) AND layout_type = 'SECTION_HEADER'"), F.lit(False))
    front = blocks.where(is_front).groupBy("doc_key").agg(F.min(F.when(F.col("pos") == 0, F.col("text"))).alias("designation"), F.min(F.when(F.col("pos") == 1, F.col("text"))).alias("title"))
    left = blocks.select(F.lit("ocr_blocks").alias("src_table"), F.col("block_id").alias("row_id"), "doc_key", "page", "pos", "layout_type", "text", is_front.alias("front"))
    right = tables.select(F.lit("ocr_tables").alias("src_table"), F.col("table_id").alias("row_id"), "doc_key", "page", F.lit(None).cast("int").alias("pos"), F.lit("").alias("layout_type"), F.col("caption").alias("text"), F.lit(False).alias("front"))
    rows = left.unionByName(right).withColumn("copy", F.pmod(F.xxhash64("row_id"), F.lit(TITLE_COPIES)))
    copies = front.withColumn("copy", F.explode(F.expr(f"sequence(0L, {TITLE_COPIES - 1}L)")))
    return rows.join(copies, ["doc_key", "copy"], "left").drop("copy")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and bigrams of a batch of distinct texts with their counts over all rows, and with each text counted once; first is null for words."""
    for batch in batches:
        found: Counter = Counter()
        once: Counter = Counter()
        for text, copies in zip(batch.column("plain").to_pylist(), batch.column("copies").to_pylist()):
            words = _TOKEN.findall(text)
            low = [w.lower() for w in words]
            for entry in [*((None, w) for w in words), *zip(low, low[1:])]:
                found[entry] += copies
                once[entry] += 1
        keys = list(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array([a for a, _ in keys], pa.string()), pa.array([b for _, b in keys], pa.string()), pa.array([found[x] for x in keys], pa.int64()), pa.array([once[x] for x in keys], pa.int64())],
            ["first", "word", "n", "n_once"],
        )


_PLAIN_WORD = re.compile(r"[А-ЯЁ]?[а-яё]+|[А-ЯЁ]+|[A-Z]+|[A-Z]?[a-z]+")
_CODE = re.compile(r"[А-НП-Я]\d+|IP\d\d|k\d|[A-HJ-NP-RT-Z]\d+|[а-яё]+[²³]|\d+|[²³\d]+")


def malformed(word: str) -> bool:
    """A word that mixes alphabets or holds digits among letters, as no word or code does."""
    parts = word.split("-")
    return any(not (_PLAIN_WORD.fullmatch(p) or _CODE.fullmatch(p)) or re.match(r"З\d", p) for p in parts)


def as_number(word: str) -> str | None:
    """The number that a token of digits and misread digits stands for."""
    if re.search(r"\d", word) and all(c.isdigit() or c in DIGIT_CONFUSIONS for c in word) and not word.isdigit() and "²" not in word:
        return None if re.fullmatch(r"[А-НП-Я]\d+", word) and not word.startswith("З") else word.translate(_AS_DIGITS)
    return None


def misread(word: str) -> bool:
    """A malformed word that holds letters of two alphabets in one part, or a number misread; units and words run together are none."""
    parts = word.split("-")
    return malformed(word) and any(re.search("[A-Za-z]", p) and re.search("[А-ЯЁа-яё]", p) or as_number(p) is not None for p in parts)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column("word").to_pylist()
        made = [pa.array(map(malformed, words), pa.bool_()), pa.array(map(as_number, words), pa.string()), pa.array(map(misread, words), pa.bool_())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "malformed", "number", "misread"])


def _normal(word: str) -> str:
    """A word with everything that is no Cyrillic letter read as the Cyrillic letter it resembles."""
    for bad, good in SEQUENCE_CONFUSIONS.items():
        word = word.replace(bad, good.upper() if word[:1].isupper() and word.isupper() else good)
    return "".join(SINGLE_AS_CYRILLIC.get(c, c) for c in word)


def _deletes(word: str) -> list[str]:
    """The word, and the word without any one letter; long words also without any two next to each other."""
    low = word.lower()
    out = {low} | {low[:i] + low[i + 1 :] for i in range(len(low))}
    if len(low) > 5:
        out |= {low[:i] + low[i + 1 : j] + low[j + 1 :] for i in range(len(low)) for j in range(i + 1, len(low))}
    return sorted(out)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column("word").to_pylist()
        keys = [_deletes(_normal(w)) for w in words]
        counts = [len(k) for k in keys]
        rows = pa.array([i for i, n in enumerate(counts) for _ in range(n)], pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in ("word", "n", "n_once")), pa.array([x for k in keys for x in k], pa.string())], ["word", "n", "n_once", "key"])


def distance(read: str, right: str) -> float:
    """Weighted edit distance, whatever the case: confusion pairs cost 0.3, other substitutions 1.2, insertions and deletions 1."""
    a, b = read, right
    rows = [[float(j) for j in range(len(b) + 1)]]
    for i in range(1, len(a) + 1):
        row = [float(i)]
        for j in range(1, len(b) + 1):
            x, y = a[i - 1], b[j - 1]
            y_low = y.lower()
            if x.lower() == y_low:
                cost = 0.0
            elif x.lower() in LETTER_CONFUSIONS.get(y_low, "") or SINGLE_AS_CYRILLIC.get(x, x).lower() == y_low:
                cost = 0.3
            else:
                cost = 1.2
            best = min(rows[i - 1][j - 1] + cost, rows[i - 1][j] + 1, row[j - 1] + 1)
            for bad, good in SEQUENCE_CONFUSIONS.items():
                if good == y_low and i >= len(bad) and a[i - len(bad) : i] == bad:
                    best = min(best, rows[i - len(bad)][j - 1] + 0.3)
            row.append(best)
        rows.append(row)
    return rows[-1][-1]


def _in_case_of(word: str, candidate: str) -> str:
    """A lower-case candidate in the case of the word it replaces."""
    letters = [c for c in word if c in _CYRILLIC_CASE]
    if len(letters) > 1 and all(map(str.isupper, letters)):
        return candidate.upper()
    first = SINGLE_AS_CYRILLIC.get(word[:1], word[:1])
    return candidate[:1].upper() + candidate[1:] if first.isupper() and not word.startswith(tuple(SEQUENCE_CONFUSIONS)) else candidate


_CYRILLIC_CASE = set("абвгдеёжзийклмнопрстуфхцчшщъыьэюяАБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ")


def _weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        d = [distance(a, b) for a, b in zip(batch.column("word").to_pylist(), batch.column("candidate").to_pylist())]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d)], [*batch.schema.names, "distance"])


_JUDGED = "word string, n bigint, n_once bigint, malformed boolean, number string, misread boolean"
#: What a rare well-formed word pays for staying as it is: as much as a word ten times as frequent, one confusion pair away, where no context speaks.
UNCHANGED = 0.201


def correction_candidates(words: DataFrame, least: int = 4, ratio: int = 10, most_distance: float = 0.95) -> DataFrame:
    """``words``: word, n, and n_once (n, each distinct text counted once) where texts are repeated. Returns
    word, candidate, n_candidate (copies counted once), distance for malformed and rare words.

    Candidates are well-formed words seen at least ``least`` times and ``ratio`` times as often as the
    word, which share a form with it from which one letter (of long words, two) is left out. Copies of a
    text speak neither for a misreading in it nor against a word that two different texts hold. Words of
    more than ``LONGEST`` characters have no candidates and are none.
    """
    counts = words.select("word", "n", F.col("n_once") if "n_once" in words.columns else F.col("n").alias("n_once"))
    judged = cut_lineage(counts.mapInArrow(_judge, _JUDGED))
    known = judged.where(~F.col("malformed") & F.col("word").rlike("^[А-ЯЁа-яё-]{2,}$") & (F.length("word") <= LONGEST))
    known = known.groupBy(F.lower("word").alias("word")).agg(F.sum("n").alias("n"), F.sum("n_once").alias("n_once")).where(F.col("n") >= least)
    asked = judged.where(F.col("number").isNull() & F.length("word").between(2, LONGEST) & F.col("word").rlike(r"[\p{L}]") & (F.col("malformed") | F.col("word").rlike("^[А-ЯЁа-яё-]{4,}$")))
    schema = "word string, n bigint, n_once bigint, key string"
    index = known.select("word", "n", "n_once").mapInArrow(_index, schema).toDF("candidate", "n_rows", "n_candidate", "key")
    asked = asked.select("word", "n", F.when(F.col("malformed"), 0).otherwise(F.col("n_once")).alias("n_once"))
    keys = asked.mapInArrow(_index, schema).drop("n")
    often = (F.col("n_candidate") >= ratio * F.col("n_once")) | (F.col("n_once") <= 1) & (F.col("n_rows") >= ratio * F.col("n_once"))
    pairs = keys.join(index, "key").where((F.lower("word") != F.col("candidate")) & often)
    pairs = pairs.select("word", "candidate", "n_candidate").distinct()
    weighed = pairs.mapInArrow(_weigh, "word string, candidate string, n_candidate bigint, distance double").where(F.col("distance") <= most_distance)
    numbers = judged.where("number IS NOT NULL").select("word", F.col("number").alias("candidate"), F.lit(1).cast("bigint").alias("n_candidate"), F.lit(0.3).alias("distance"))
    return weighed.unionByName(numbers)


def _word_slots(words: pa.Array) -> np.ndarray:
    return np.array([crc32(w.encode()) % SLOTS for w in words.to_pylist()], np.int64)


class _Asked(dict):
    """Whether a word may be in question, for so many words at most."""

    def __init__(self, table: np.ndarray) -> None:
        super().__init__()
        self.table = table

    def __missing__(self, word: str) -> bool:
        if len(self) > 500_000:
            self.clear()
        slot = crc32(word.encode()) % SLOTS
        self[word] = out = bool(self.table[slot >> 3] >> (slot & 7) & 1)
        return out


def _contexts(batches: Iterator[pa.RecordBatch], table: Broadcast) -> Iterator[pa.RecordBatch]:
    """Words that may be in question, with their neighbours."""
    asked = _Asked(table.value)
    for batch in batches:
        rows, before, word, after = [], [], [], []
        for i, text in enumerate(batch.column("plain").to_pylist()):
            words = ["", *_TOKEN.findall(text), ""]
            for j in range(1, len(words) - 1):
                if asked[words[j]]:
                    rows.append(i)
                    before.append(words[j - 1])
                    word.append(words[j])
                    after.append(words[j + 1])
        take = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("src_table").take(take), batch.column("row_id").take(take), *(pa.array(x, pa.string()) for x in (before, word, after))], ["src_table", "row_id", "before", "word", "after"])


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, fixes, compounds, spaced, rest, gone in zip(*(batch.column(c).to_pylist() for c in ("plain", "fixes", "compounds", "apart", "rest", "first_gone"))):
            chosen = {(f["before"], f["word"], f["after"]): f["candidate"] for f in fixes or []}
            if chosen:
                found = list(_TOKEN.finditer(text))
                words = ("", *(m[0] for m in found), "")
                pieces, at = [], 0
                for i, m in enumerate(found):
                    pieces += [text[at : m.start()], _in_case_of(m[0], chosen[words[i : i + 3]]) if words[i : i + 3] in chosen else m[0]]
                    at = m.end()
                text = "".join([*pieces, text[at:]])
            for c in compounds or []:
                text = text.replace(c["first"] + c["second"], f"{c['first']}-{c['second']}")
            for s in spaced or []:
                text = text.replace(s["run"], s["words"])
            if rest:
                text = _OPEN_END.sub(lambda m: m[1] + rest, text)
            if gone:
                text = re.sub(r"^\s*[^\W_]+\s*", "", text)
            text = re.sub(r"[ \t]*\n[ \t]*(?=[^\s|])", " ", text)
            out.append(re.sub(r"[ \t]{2,}", " ", text).strip())
        yield pa.RecordBatch.from_arrays([batch.column("src_table"), batch.column("row_id"), pa.array(out, pa.string()), batch.column("damaged")], ["src_table", "row_id", "text", "damaged"])


def _neighbours(rows: DataFrame) -> DataFrame:
    """Blocks that a word runs into or out of, by place: doc_key, page, pos, rest (of its own last word), first_gone.

    Blocks follow each other on a page, and the last one of a page is followed by the first one of the
    next page; furniture, headings and lone values or designations are passed over. A page is small, whatever its document's size.
    """
    running = "layout_type <> 'SECTION_HEADER' AND (length(plain) > 25 OR plain RLIKE '^[а-яё]')"
    places = rows.where(running).where("src_table = 'ocr_blocks' AND plain <> '' AND pos IS NOT NULL AND page IS NOT NULL AND doc_key IS NOT NULL")
    first_word = F.regexp_extract("plain", r"^\s*([а-яё][\p{L}\p{N}]*)", 1)
    places = places.groupBy("doc_key", "page", "pos").agg(F.max("open_end").alias("open_end"), F.min(first_word).alias("starts"))
    on_page = Window.partitionBy("doc_key", "page").orderBy("pos")
    ordered = places.select("*", F.lead("pos").over(on_page).alias("next_pos"), F.lead("starts").over(on_page).alias("next_starts"), F.lag("pos").over(on_page).alias("last_pos"))
    ordered = cut_lineage(ordered)
    tops = ordered.where("last_pos IS NULL").select("doc_key", (F.col("page") - 1).alias("page"), F.col("pos").alias("top_pos"), F.col("starts").alias("top_starts"))
    open_ends = ordered.where("open_end IS NOT NULL").join(tops, ["doc_key", "page"], "left")
    runs = open_ends.select(
        "doc_key",
        "page",
        "pos",
        F.when(F.col("next_pos").isNotNull(), F.col("page")).otherwise(F.col("page") + 1).alias("to_page"),
        F.coalesce("next_pos", "top_pos").alias("to_pos"),
        F.when(F.col("next_pos").isNotNull(), F.col("next_starts")).otherwise(F.col("top_starts")).alias("rest"),
    ).where("rest <> ''")
    gave = runs.select("doc_key", "page", "pos", "rest", F.lit(False).alias("first_gone"))
    took = runs.select("doc_key", F.col("to_page").alias("page"), F.col("to_pos").alias("pos"), F.lit(None).cast("string").alias("rest"), F.lit(True).alias("first_gone"))
    return gave.unionByName(took).groupBy("doc_key", "page", "pos").agg(F.max("rest").alias("rest"), F.max("first_gone").alias("first_gone"))


def _scanned(blocks: DataFrame, tables: DataFrame, most_headers: int) -> DataFrame:
    """Both tables' texts without furniture, as ``_SCANNED``, whatever the number of headers."""
    rows = scanned_rows(blocks, tables)
    held = repeated_headers(blocks, most_headers)
    headers = blocks.sparkSession.sparkContext.broadcast(frozenset(held))
    if len(held) < most_headers:
        return rows.mapInArrow(partial(_scan, headers=headers), _SCANNED)
    rarer = rarer_headers(blocks, held)
    table = marks(rarer, _word_slots)
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", runs array<string>"
    # Rows are told apart by a digest; were two alike, each would only get the other's headers too, which are headers.
    row = F.xxhash64("src_table", "row_id", "doc_key", "page", "pos")
    waiting = cut_lineage(rows.mapInArrow(partial(_waiting, headers=headers, table=table), schema).withColumn("row", row))
    rare = waiting.select("row", F.explode("runs").alias("flat")).distinct().join(rarer, "flat").groupBy("row").agg(F.collect_set("flat").alias("rare"))
    completed = waiting.drop("runs").join(rare, "row", "left").mapInArrow(partial(_scan, headers=headers), _SCANNED)
    return rows.mapInArrow(partial(_scan, headers=headers, table=table), _SCANNED).unionByName(completed)


def repaired(blocks: DataFrame, tables: DataFrame, most_headers: int = MOST_HEADERS) -> DataFrame:
    """src_table, row_id, text (repaired, one paragraph), damaged: whether anything had to be repaired.

    ``blocks``: block_id, doc_key, page, pos, layout_type, text. ``tables``: table_id, doc_key, page,
    caption. Blocks of furniture come out with an empty text; null texts likewise. Repeated rows are
    repaired alike. The designation and title on page 0 are no furniture; without a title page only numbers and fixed phrases.
    A word that runs into the next block is put whole at the end of the first. ``most_headers``: how many headers
    found by repetition (one at least) every task holds; all are cut, however many there are.
    """
    rows = cut_lineage(_scanned(blocks, tables, most_headers))
    texts = rows.groupBy("plain").agg(F.count(F.lit(1)).alias("copies"))
    counts = texts.mapInArrow(_counts, "first string, word string, n bigint, n_once bigint").groupBy("first", "word").agg(F.sum("n").alias("n"), F.sum("n_once").alias("n_once"))
    counts = cut_lineage(counts)
    words = counts.where("first IS NULL").select("word", "n", "n_once")
    bigrams = counts.where("first IS NOT NULL").select("first", "word", F.col("n_once").alias("n"))
    candidates = cut_lineage(correction_candidates(words))
    asked = candidates.select("word").distinct()
    # A well-formed word may be right: it is a candidate for itself, its own text left out.
    judged = words.mapInArrow(_judge, _JUDGED)
    itself = judged.where("NOT malformed AND number IS NULL").join(asked, "word", "left_semi")
    itself = itself.select("word", F.lower("word").alias("candidate"), (F.col("n_once") - 1).alias("n_candidate"), F.lit(UNCHANGED).alias("distance"))
    unread = cut_lineage(judged.where("misread").join(asked, "word", "left_anti").select("word", F.lit(True).alias("unread")))
    candidates = candidates.withColumn("own", F.lit(0)).unionByName(itself.withColumn("own", F.lit(1)))

    asked = asked.withColumn("unread", F.lit(False)).unionByName(unread)
    # Only words that may be in question leave their task.
    look = partial(_contexts, table=marks(asked.select("word"), _word_slots))
    contexts = rows.select("src_table", "row_id", "plain").mapInArrow(look, "src_table string, row_id bigint, before string, word string, after string")
    contexts = cut_lineage(contexts.join(asked, "word"))
    left = contexts.where("unread").select("src_table", "row_id", "unread").distinct()
    contexts = contexts.where("NOT unread").drop("unread")
    places = contexts.select("before", "word", "after").distinct().join(candidates, "word").withColumn("before_low", F.lower("before")).withColumn("after_low", F.lower("after"))
    places = places.join(bigrams.select(F.col("first").alias("before_low"), F.col("word").alias("candidate"), F.col("n").alias("n_before")), ["before_low", "candidate"], "left")
    places = places.join(bigrams.select(F.col("first").alias("candidate"), F.col("word").alias("after_low"), F.col("n").alias("n_after")), ["candidate", "after_low"], "left")

    def seen(count: Column) -> Column:
        return F.log1p(F.greatest(F.coalesce(count, F.lit(0)), F.lit(0)))

    score = seen(F.col("n_candidate")) / 4 + seen(F.col("n_before") - F.col("own")) + seen(F.col("n_after") - F.col("own")) - 6 * F.col("distance")
    best = places.groupBy("before", "word", "after").agg(F.max_by(F.struct("candidate", "own"), F.struct(score, "candidate")).alias("best"))
    best = best.where("best.own = 0").select("before", "word", "after", "best.candidate")
    fixes = contexts.join(best, ["before", "word", "after"]).groupBy("src_table", "row_id").agg(F.collect_set(F.struct("before", "word", "after", "candidate")).alias("fixes"))

    splits = rows.select("src_table", "row_id", F.inline("splits"))
    whole = words.select(F.col("word").alias("compound"), F.col("n").alias("n_compound"))
    pairs = splits.select("first", "second").distinct().withColumn("compound", F.concat_ws("-", "first", "second")).withColumn("joined", F.concat("first", "second"))
    pairs = pairs.join(whole, "compound", "left").join(words.select(F.col("word").alias("joined"), "n"), "joined", "left")
    pairs = pairs.select("first", "second", (F.coalesce("n_compound", F.lit(0)) > F.coalesce("n", F.lit(0))).alias("is_compound"))
    joins = splits.join(pairs, ["first", "second"]).groupBy("src_table", "row_id")
    joins = joins.agg(F.max(~F.col("is_compound")).alias("broken"), F.collect_set(F.when(F.col("is_compound"), F.struct("first", "second"))).alias("compounds"))

    runs = rows.select("src_table", "row_id", F.explode("spaced").alias("run"))
    ways = F.array(
        F.struct(F.col("run").alias("key"), F.col("run").alias("words")),
        F.struct(F.expr("substring(run, 2)").alias("key"), F.expr("concat(substring(run, 1, 1), ' ', substring(run, 2))").alias("words")),
        F.struct(F.expr("substring(run, 1, length(run) - 1)").alias("key"), F.expr("concat(substring(run, 1, length(run) - 1), ' ', right(run, 1))").alias("words")),
    )
    read = runs.select("run").distinct().select("run", F.inline(ways)).join(words.select(F.col("word").alias("key"), "n"), "key", "left")
    read = read.groupBy("run").agg(F.max_by("words", F.struct(F.coalesce("n", F.lit(0)), F.length("key"))).alias("words"))
    apart = runs.join(read, "run").groupBy("src_table", "row_id").agg(F.collect_set(F.struct("run", "words")).alias("apart"))

    keys = ["src_table", "row_id"]
    out = rows.select(*keys, "doc_key", "page", "pos", "plain", "header", "numbered", "open_end").join(fixes, keys, "left").join(joins, keys, "left").join(apart, keys, "left").join(left, keys, "left")
    out = out.join(_neighbours(rows).withColumn("src_table", F.lit("ocr_blocks")), ["src_table", "doc_key", "page", "pos"], "left")
    damaged = F.col("header") | F.col("numbered") | F.col("fixes").isNotNull() | F.coalesce("broken", F.lit(False)) | F.col("apart").isNotNull() | F.col("first_gone").isNotNull() | F.col("open_end").isNotNull() | F.col("unread").isNotNull()
    out = out.select(*keys, "plain", "fixes", "compounds", "apart", "rest", "first_gone", damaged.alias("damaged"))
    return out.mapInArrow(_repair, "src_table string, row_id bigint, text string, damaged boolean")
