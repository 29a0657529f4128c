"""Characters that look alike or are not seen at all, and column expressions that fold them."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of three alphabets that look the same on screen, position by position.
CYRILLIC = "АВЕКМНОРСТХУІЈЅЁаеорсухіјѕё"
LATIN = "ABEKMHOPCTXYIJSËaeopcyxijsë"
GREEK = "ΑΒΕΚΜΗΟΡΤΧΥΙοΖΝ"
GREEK_AS_CYRILLIC = "АВЕКМНОРТХУІоZN"
GREEK_AS_LATIN = "ABEKMHOPTXYIoZN"

# Blanks other than the ordinary one, characters without width, kinds of dash.
BLANKS = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
INVISIBLE = (
    "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c"
    "\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff"
)
DASHES = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212\ufe58\ufe63\uff0d"

FULL_WIDTH = "".join(map(chr, range(0xFF01, 0xFF5F)))
ORDINARY = "".join(map(chr, range(0x21, 0x7F)))

_CHAR_FROM = FULL_WIDTH + BLANKS + INVISIBLE
_CHAR_TO = ORDINARY + " " * len(BLANKS)
#: Any character that folding replaces or drops.
UNUSUAL = "[\uff01-\uff5e" + BLANKS + INVISIBLE + "\u0300-\u036f]"


def as_cyrillic(text: Column) -> Column:
    """Every look-alike letter as its Cyrillic twin."""
    return F.translate(text, LATIN + GREEK, CYRILLIC + GREEK_AS_CYRILLIC)


def as_latin(text: Column) -> Column:
    """Every look-alike letter as its Latin twin."""
    return F.translate(text, CYRILLIC + GREEK, LATIN + GREEK_AS_LATIN)


def reference_key(text: Column) -> Column:
    """Equal for numbers and designations that differ only in blanks, dashes, width, look-alikes or case."""
    upper = F.upper(F.translate(text, _CHAR_FROM, _CHAR_TO))
    one = F.translate(upper, LATIN + GREEK + DASHES + " \t\n\r", CYRILLIC + GREEK_AS_CYRILLIC + "-" * len(DASHES))
    return F.when(F.length(one) > 0, one)


# The same folding for Python workers ---------------------------------------------------------

_PY_CHARS = str.maketrans(dict(zip(FULL_WIDTH + BLANKS, _CHAR_TO)) | {c: None for c in INVISIBLE})
_PY_CYRILLIC = str.maketrans(LATIN + GREEK, CYRILLIC + GREEK_AS_CYRILLIC)
_PY_UNUSUAL = re.compile(UNUSUAL)
#: Runs of letters or digits.
WORD = re.compile(r"[^\W_]+")


def fold_text(text: str) -> str:
    """What fold_chars does, for one string."""
    if _PY_UNUSUAL.search(text):
        text = unicodedata.normalize("NFC", text.translate(_PY_CHARS))
    return text


def word_skeleton(word: str) -> str:
    """A word in Cyrillic look-alikes and lower case: equal for words that look the same."""
    return word.translate(_PY_CYRILLIC).lower()
