"""Cleaning of item texts. All steps are native expressions but Unicode folding, which Spark lacks."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Patterns of what is removed, read alike by Java and RE2.
URL = r"(?i)(?:https?://|ftp://|www\.)[^\s<>]+"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
PHONE = r"\+?\(?[0-9]{2,4}\)?(?:[ .-][0-9]{2,4}){2,4}"
EMOJI = r"[\x{1F1E6}-\x{1F1FF}\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}\x{200D}]"
TAG = r"<.*?>"
SOURCE = r"(?i)\([\s+]?source.*?\)+"
CREDIT = r"\[Writ.*?by.*?\]"

# Java's engine goes back where RE2 does not, so the functions below use patterns of the same matches that read a text once. A
# start that leads nowhere is taken with what it has read, as the group that is put back: no later start in it does better.
_LINE = r"\n\r\x{85}\x{2028}\x{2029}"  # where . ends
_LOCAL = "[A-Za-z0-9._%+-]"
_EMAIL_ONCE = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++" + EMAIL.removeprefix(f"{_LOCAL}+")
_TAG_ONCE = rf"<[^>{_LINE}]*+>|(<[^>{_LINE}]*+)"
_SOURCE_ONCE = rf"(?i)\([\s+]?source[^){_LINE}]*+\)++|(\([\s+]?source[^){_LINE}]*+)"
_CREDIT_ONCE = rf"\[Writ(?:(?!by)[^{_LINE}])*+by[^\]{_LINE}]*+\]|(\[Writ[^{_LINE}]*+)"
_BLANK = r"\t\n\x0B\f\r\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

#: Letters and marks that have no decomposition, and their plain spellings.
PLAIN = str.maketrans({
    "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "Th",
    "ł": "l", "Ł": "L", "ı": "i", "‘": "'", "’": "'", "‚": "'", "“": '"', "”": '"', "„": '"', "«": "<<", "»": ">>", "–": "-", "—": "-", "−": "-",
    "…": "...", "•": "*", "×": "x", "©": "(c)", "®": "(r)", "™": "(tm)",
})


@F.pandas_udf(StringType())
def repair(texts: pd.Series) -> pd.Series:
    return texts.map(repaired)


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


#: The byte that a character was if text of bytes was read in the western code page; the five bytes it leaves open count as themselves.
BYTES = {(bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b)): b for b in range(0x80, 0x100)}
#: What may follow in well-formed UTF-8: for each state the ranges of the next byte with the state after it. State 0 is between characters.
UTF8 = {
    0: ((0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5), (0xEE, 0xEF, 2), (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7)),
    1: ((0x80, 0xBF, 0),), 2: ((0x80, 0xBF, 1),), 3: ((0x80, 0xBF, 2),), 4: ((0xA0, 0xBF, 1),), 5: ((0x80, 0x9F, 1),), 6: ((0x90, 0xBF, 2),), 7: ((0x80, 0x8F, 2),),
}
STEP = {(state, b): to for state, ranges in UTF8.items() for lo, hi, to in ranges for b in range(lo, hi + 1)}


def _undone(line: str) -> str | None:
    """line with all its characters beyond ASCII read as the bytes they were; None if they are not all part of such characters."""
    state, out = 0, bytearray()
    for c in line:
        if c < "\x80":
            if state:
                return None
            out.append(ord(c))
        else:
            b = BYTES.get(c)
            state = None if b is None else STEP.get((state, b))
            if state is None:
                return None
            out.append(b)
    return None if state else out.decode()


def repaired(text: str | None) -> str | None:
    """text with bytes undone that were read in a wrong code page, up to three times over, line by line.

    A line is changed only if every one of its characters beyond ASCII is part of what such a reading makes; one of which
    that is not sure stays as it is.
    """
    if text is None or text.isascii():
        return text
    out = []
    for line in text.split("\n"):
        for _ in range(3):
            if line.isascii() or (better := _undone(line)) is None:
                break
            line = better
        out.append(line)
    return "\n".join(out)


def folded(text: str | None) -> str | None:
    """Repair, NFKC (which would break up what is to be repaired), then ASCII spellings: marks are dropped from letters, known signs are spelt out, other scripts stay."""
    if text is None or text.isascii():
        return text
    text = unicodedata.normalize("NFKC", repaired(text)).translate(PLAIN)
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


@F.pandas_udf(StringType())
def to_ascii(texts: pd.Series) -> pd.Series:
    return texts.map(folded)


def strip_newlines(c: Column) -> Column:
    return F.replace(c, F.lit("\n"), F.lit(" "))


def replace_urls(c: Column, by: str = "<URL>") -> Column:
    return F.regexp_replace(c, URL, by)


def replace_emails(c: Column, by: str = "<EMAIL>") -> Column:
    return F.when(c.contains("@"), F.regexp_replace(c, _EMAIL_ONCE, by)).otherwise(c)


def replace_phones(c: Column, by: str = "<PHONE>") -> Column:
    return F.regexp_replace(c, PHONE, by)


def strip_emoji(c: Column) -> Column:
    return F.regexp_replace(c, EMOJI, "")


def strip_tags(c: Column) -> Column:
    return F.when(c.contains("<"), F.regexp_replace(c, _TAG_ONCE, "$1")).otherwise(c)


def strip_source(c: Column) -> Column:
    return F.when(c.contains("("), F.regexp_replace(c, _SOURCE_ONCE, "$1")).otherwise(c)


def strip_credit(c: Column) -> Column:
    return F.when(c.contains("[Writ"), F.regexp_replace(c, _CREDIT_ONCE, "$1")).otherwise(c)


def collapse_space(c: Column) -> Column:
    """Runs of any Unicode white space become one space, and none stands at the ends."""
    return F.btrim(F.regexp_replace(c, rf"[ {_BLANK}]{{2,}}|[{_BLANK}]", " "))  # single spaces are left as they are


def clean_text(c: Column, fold: bool = True) -> Column:
    """The whole of it, in order: Unicode forms and repair, line breaks, addresses and numbers, emoji, tags, citations, credits, blanks.

    Addresses become placeholders in angle brackets, which go with the tags. fold=False leaves out the one step that is
    not native, for texts that are normalised already.
    """
    if fold:
        c = to_ascii(c)
    c = collapse_space(strip_newlines(c))
    c = strip_emoji(replace_phones(replace_emails(replace_urls(c))))
    return collapse_space(strip_credit(strip_source(strip_tags(c))))
