"""Text cleaning mappers and filter ratios as Column expressions.

Patterns are written so that Java and RE2 read them alike. Fixed choices where
public descriptions leave room: white space is mapped one to one and trimmed,
not collapsed; special characters are those that are neither letters, digits nor
white space; normalisation is NFC.
"""

from __future__ import annotations

import unicodedata
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType

HTML = r"(?is)<(?:script|style)\b[^>]*>.*?</(?:script|style)[ ]*>|<!--.*?-->|</?[a-z][^<>]*>"
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}
LINKS = r"(?i)(?:https?|ftp)://[^ \t\r\n<>\"]+|www\.[^ \t\r\n<>\"]+"
EMAILS = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
SPACES = r"[\t\n\x{0b}\x{0c}\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_ALNUM = r"[^\p{L}\p{N}]"
ORDINARY = r"[\p{L}\p{N}\s\p{Z}]"


def clean_html(c: Column) -> Column:
    out = F.regexp_replace(c, HTML, "")
    for entity, text in ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(text))
    return out


def clean_links(c: Column) -> Column:
    return F.regexp_replace(c, LINKS, "")


def clean_email(c: Column) -> Column:
    return F.regexp_replace(c, EMAILS, "")


def normalize_whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACES, " "))


@pandas_udf(StringType())
def fix_unicode(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def repaired(x: str) -> str:
    """Text that was UTF-8 but read as Windows-1252, put right if that is certain:
    the bytes must form valid UTF-8 and the text must become shorter."""
    if x.isascii():
        return x
    try:
        back = x.encode("cp1252").decode("utf-8")
    except (UnicodeEncodeError, UnicodeDecodeError):
        return x
    return back if len(back) < len(x) else x


@pandas_udf(StringType())
def fix_mojibake(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", repaired(x)))


def length_between(c: Column, low: int = 50, high: int = 10_000) -> Column:
    return F.length(c).between(low, high)


def alnum_ratio(c: Column) -> Column:
    """Letters and digits per character, null for an empty text."""
    return F.try_divide(F.length(F.regexp_replace(c, NOT_ALNUM, "")), F.length(c))


def special_ratio(c: Column) -> Column:
    return F.try_divide(F.length(F.regexp_replace(c, ORDINARY, "")), F.length(c))


def window_hashes(text: str, window: int) -> np.ndarray:
    """Hashes of all character windows of the text (of the whole text where it is
    shorter), by a polynomial over code points, mixed."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    width = min(window, len(points))
    acc = np.zeros(len(points) - width + 1, np.uint64)
    for k in range(width):
        acc = acc * np.uint64(0x100000001B3) + points[k : k + len(acc)] + np.uint64(1)
    acc = (acc ^ (acc >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return acc ^ (acc >> np.uint64(32))


def repetition(text: str | None, n: int) -> float | None:
    """Share of the most frequent character n-grams among all: the sqrt(#distinct)
    most frequent, but no more than occur twice. n-grams are told apart by a 64-bit
    hash."""
    if text is None:
        return None
    if len(text) < n:
        return 0.0
    counts = np.unique(window_hashes(text, n), return_counts=True)[1]
    take = min(isqrt(len(counts)), int((counts > 1).sum()))
    return float(np.sort(counts)[::-1][:take].sum() / (len(text) - n + 1))


def char_repetition(c: Column, n: int = 10) -> Column:
    @pandas_udf(DoubleType())
    def ratio(s: pd.Series) -> pd.Series:
        return s.map(lambda x: repetition(x, n))

    return ratio(c)
