"""Per-document text statistics, and prose told from lists, tables and junk.

`document_stats` gives for each document, over its whole text: word count, mean
word length, share of symbols, share of lines ending in punctuation, share of
common words, repetition (shares of characters in duplicate lines and
paragraphs, and of the word characters that the most frequent n-gram of 2 to 5
words covers, each character once), the shares of item, cell and form lines, and
the share of characters in running sentences. `prose_rule` combines them.

Sentences are told by the common words of the given list (its languages), in
Japanese by hiragana, in Chinese and Korean by their function characters and
endings, in other alphabets than the Latin by the shape of their words. A text in a
Latin-script language that the list doesn't cover, or in a script written without
spaces other than these, has no evidence and comes out as other.

Null, empty and blank texts have zero counts and null shares and are neither
prose nor junk. Statistics are computed in Arrow batches; nothing is sampled.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import bounded, small

WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
TAG = re.compile(r"</?[a-zA-Z][^<>\n]*>|<\|[a-z_]+\|>|&[a-z]{2,6};")
#: Start of a list item, check box, table row, log line, contents line or stack frame.
ITEM = re.compile(r"^\s*(?:[-*•‣◦·▪+»o]\s|\(?\d{1,3}[.)]\s|\d{1,3}(?:\.\d{1,3})+\s|\(?[a-z][.)]\s|\[(?:[ xX]?|\d{1,3})\]|[☐☑☒✓✔]|\||\[?\d\d:\d\d:\d\d|\d{4}-\d\d-\d\d|at\s\S+\()")
PIPE = re.compile(r"\s\|\s")
#: A blank to fill in or a dotted leader at the end of a line (digits and white space taken off).
BLANKS = ("___", "....", "……")
BOX = re.compile(r"\[\s*\]$")
#: The end of a label with room for an answer.
ANSWER = re.compile(r"(?:[:=]\s*\S{0,12}|[?]\s*\S{0,4}|[?:=]\s*\S+ / \S+)$")
PARAGRAPH = re.compile(r"\n\s*\n")
VISIBLE = regex.compile(r"[^\s\p{Z}\p{Cc}\p{Cf}]")
ENDS, CLOSERS = frozenset(".!?…。！？:;"), "\"'”’»)]"
STOP = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*(?=\s|$)|(?<=[。！？])[」』]*")
CELL = re.compile(r"\t|\s\|\s|;|,(?! )| {2,}")
KANA = re.compile(r"[\u3041-\u309f]")
HANGUL = re.compile(r"[\uac00-\ud7a3]")
#: Letters of alphabets other than the Latin.
ALPHABETS = re.compile(r"[\u0370-\u058f\u05d0-\u06ff\u0904-\u0ddf\u10a0-\u10ff]")
#: Frequent function characters of Chinese, and endings of Korean words (fixed values).
CHINESE = frozenset("的了是在和有不我他她它这那也就都与为之以而到把被着过从对说")
KOREAN = ("은", "는", "이", "가", "을", "를", "의", "에", "서", "로", "와", "과", "도", "다", "고", "며", "면", "지", "게", "한")
CJK = re.compile(r"[\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff]")
DIGIT, OTHER = re.compile(r"\d"), re.compile(r"[\W\d_]+")


def foreign(unit: str, words: list[str], stopped: bool) -> bool | None:
    """`running` for scripts that the word list doesn't cover, None for others."""
    size = len(unit)
    if (cjk := len(CJK.findall(unit))) > 0.5 * size:
        if cjk < (6 if stopped else 12):
            return False
        if kana := len(KANA.findall(unit)):
            return kana >= 0.25 * cjk
        return stopped and sum(map(CHINESE.__contains__, unit)) >= 0.06 * cjk
    n = len(words)
    if len(HANGUL.findall(unit)) > 0.4 * size:
        return stopped and n >= 3 and sum(w.endswith(KOREAN) for w in words) >= 0.4 * n
    if len(ALPHABETS.findall(unit)) > 0.5 * size:
        return stopped and n >= 4 and sum(len(w) <= 3 for w in words) >= 0.15 * n and n >= 0.6 * len(unit.split())
    return None


def running(unit: str, words: list[str], common: int, chars: int, stopped: bool, least: int = 4) -> bool:
    """Whether a stretch of text (with its lower-cased words, how many of them are
    common and how many characters they have) reads as a sentence: enough words, mostly
    letters, and common words among them; more of these where no full stop ends it."""
    n = len(words)
    if not unit.isascii() and (told := foreign(unit, words, stopped)) is not None:
        return told
    if n < (least if stopped else 8) or not stopped and (least > 4 or n < WORDS_PER_CELL * separators(unit)):
        return False
    if common < (0.12 if stopped else UNSTOPPED) * n or unit.count("=") >= 0.15 * n:
        return False
    parts = unit.split()
    return n >= 0.6 * len(parts) and chars >= 0.6 * sum(map(len, parts))


UNSTOPPED = 0.24
#: With fewer words per cell separator a stretch without full stop is a row.
WORDS_PER_CELL = 5
#: Shorter lines are not joined with the next.
WRAPPED = 34


def is_item(line: str) -> bool:
    return ITEM.match(line) is not None or "|" in line and PIPE.search(line) is not None


def is_form(line: str) -> bool:
    """Whether a line (stripped) is a label with room for an answer, or ends in a
    blank or a dotted leader, whatever its length."""
    if not (":" in line or "=" in line or "?" in line or "___" in line or "...." in line or "]" in line or "……" in line):
        return False
    if line.rstrip("0123456789").rstrip().endswith(BLANKS) or line[-1] == "]" and BOX.search(line, line.rfind("[")):
        return True
    at = max(line.rfind(":"), line.rfind("="), line.rfind("?"))
    if at < 0 or len(line) - at > 14 and " / " not in line[at:]:
        return False
    m = ANSWER.match(line, at) or (at := max(line.rfind(":", 0, at), line.rfind("=", 0, at), line.rfind("?", 0, at))) >= 0 and ANSWER.match(line, at)
    return bool(m) and at >= 3 and "." not in line[:at] and "!" not in line[:at]


def separators(text: str) -> int:
    """Number of cell separators; the pattern is needed only where bars or wide gaps are."""
    if "|" in text or "  " in text:
        return len(CELL.findall(text))
    return text.count("\t") + text.count(";") + text.count(",") - text.count(", ")


def units(lines: list[str], alone: list[bool]) -> Iterator[tuple[str, bool, int]]:
    """Stretches of the text, whether each ends with a full stop, and the words it
    needs to count as running. Wrapped lines are joined; items stand alone, and a
    blank line ends a paragraph."""
    block: list[str] = []
    for line, item in zip(lines, alone, strict=True):
        if block and (item or not line or len(block[-1]) < WRAPPED):
            yield from sentences(" ".join(block), 4)
            block = []
        if item:
            yield from sentences(line, 8)
        elif line:
            block.append(line)
    if block:
        yield from sentences(" ".join(block), 4)


def sentences(text: str, least: int) -> Iterator[tuple[str, bool, int]]:
    at = 0
    for m in STOP.finditer(text):
        if m.end() > at:
            yield text[at : m.end()].strip(), True, least
            at = m.end()
    if text[at:].strip():
        yield text[at:].strip(), False, least


FIELDS = [
    "words", "mean_word_length", "symbol_ratio", "lines", "punctuated_lines", "common_words", "item_lines", "digit_ratio", "running_share", "duplicate_lines", "duplicate_paragraphs", "cell_lines", "form_lines", "sentence_words", "top_ngram",
]
COUNTS = {"words", "lines"}


def text_stats(raw: str | None, common: frozenset[str]) -> tuple[list, list[str]]:
    """All statistics of a text but the last, and its words."""
    if not raw or not VISIBLE.search(raw):
        return [0 if f in COUNTS else None for f in FIELDS[:-1]], []
    text = raw if raw.isascii() else unicodedata.normalize("NFC", raw).replace("\u2028", "\n").replace("\u2029", "\n")
    text = TAG.sub(" ", text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text)
    every = [x.strip() for x in text.split("\n")]
    item = [bool(x) and is_item(x) for x in every]
    form = [bool(x) and not i and is_form(x) for x, i in zip(every, item, strict=True)]
    words: list[str] = []
    in_sentences = sentence_count = sentence_words = known = word_chars = 0
    for unit, stopped, least in units(every, [i or f for i, f in zip(item, form, strict=True)]):
        own = WORD.findall(unit.lower())
        words += own
        known_here, chars = sum(map(common.__contains__, own)), sum(map(len, own))
        known += known_here
        word_chars += chars
        if running(unit, own, known_here, chars, stopped, least):
            in_sentences += len(unit)
            sentence_count += 1
            sentence_words += len(own)
    lines = [x for x in every if x] or [text]
    dense = "".join(text.split())
    n, letters, digits = max(1, len(dense)), len(OTHER.sub("", dense)), sum(map(dense.count, "0123456789"))
    total, k_words = sum(map(len, lines)), max(1, len(words))
    seen = Counter(lines)
    celled = "|" in text or ";" in text or "\t" in text or "  " in text or text.count(",") != text.count(", ")
    paras = Counter(p.strip() for p in PARAGRAPH.split(text) if p.strip()) if "\n" in text else {}
    size = sum(len(p) * k for p, k in paras.items()) or 1
    return [
        len(words), word_chars / k_words, (n - letters - digits) / n, len(lines), sum(x[-1] in ENDS or x[-1] in CLOSERS and x.rstrip(CLOSERS)[-1:] in ENDS for x in lines) / len(lines), known / k_words, sum(len(x) for x, i in zip(every, item, strict=True) if i) / total, digits / n,
        min(1.0, in_sentences / max(1, len(text.strip()))), sum(len(x) * (k - 1) for x, k in seen.items()) / total, sum(len(p) * (k - 1) for p, k in paras.items()) / size,
        sum(separators(x) >= 2 for x in lines) / len(lines) if celled else 0.0, sum(form) / len(lines), sentence_words / max(1, sentence_count),
    ], words


NGRAMS = (2, 3, 4, 5)


def ngram_coverage(words: list[list[str]]) -> np.ndarray:
    """For each list the largest share of its characters that one repeated n-gram
    covers; characters under several occurrences count once."""
    size = np.array([len(w) for w in words], np.int64)
    flat = [x for w in words for x in w]
    out, chars = np.zeros(len(words)), np.fromiter(map(len, flat), np.int64, len(flat))
    code = np.fromiter(map(hash, flat), np.int64, len(flat)).astype(np.uint64)
    row, upto = np.repeat(np.arange(len(words)), size), np.r_[0, np.cumsum(chars)]
    total = np.maximum(1, np.bincount(row, weights=chars, minlength=len(words)))
    inside, acc = np.arange(len(flat)), code
    for k in range(2, max(NGRAMS) + 1):
        going = inside + k <= len(flat)  # a longer n-gram is repeated only where the shorter one is
        inside, acc = inside[going], acc[going]
        same = row[inside] == row[inside + k - 1]
        inside, acc = inside[same], acc[same]
        if len(inside) < 2:
            break
        acc = (acc ^ (acc >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + code[inside + k - 1]
        key = acc + row[inside].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        sorting = np.argsort(key)
        order, key = inside[sorting], key[sorting]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        count = np.diff(np.r_[first, len(order)])
        again = np.sort(sorting[np.repeat(count > 1, count)])
        inside, acc = inside[again], acc[again]
        at = np.minimum.reduceat(order, first)[count > 1]  # repeated n-grams only; of equal ones the earliest
        first, count = first[count > 1], count[count > 1]
        best = np.lexsort((-at, count * (upto[at + k] - upto[at]), row[at]))
        best = best[np.r_[row[at][best][1:] != row[at][best][:-1], np.ones(min(1, len(best)), bool)]]  # one of each row
        n = count[best]
        if not len(best):
            break
        hit = order[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[best], n)]
        edges = np.bincount(hit, minlength=len(flat) + 1) - np.bincount(hit + k, minlength=len(flat) + 1)
        covered = np.cumsum(edges[:-1]) > 0
        out = np.maximum(out, np.bincount(row[covered], weights=chars[covered], minlength=len(words)) / total)
    return out


SCHEMA = ", ".join(f"{f} {'bigint' if f in COUNTS else 'double'}" for f in FIELDS)
TYPES = [pa.int64() if f in COUNTS else pa.float64() for f in FIELDS]
#: Share of characters in running sentences from which a text is prose.
PROSE_SHARE = 0.4
#: Repetition from which it is not, whatever it repeats: the part of the words one n-gram covers, and of lines or paragraphs seen before.
LOOP_SHARE, COPY_SHARE = 0.6, 0.8
#: Share of symbols or digits that no prose has.
SYMBOL_SHARE, DIGIT_SHARE = 0.35, 0.35
#: Where lists, rows and forms make up this share, sentences must make up more than STRUCTURED_PROSE.
STRUCTURE_SHARE, STRUCTURED_PROSE = 0.6, 0.6


#: Words of a list of frequent words.
MOST_WORDS = 200_000


def document_stats(df: DataFrame, key: str, text: str, common: DataFrame) -> DataFrame:
    """`key` and the statistics of each row; `common` is a word list (column word)
    of bounded size, all of whose languages count."""
    words = frozenset(r[0] for r in small(common.select(F.lower("word").alias("word")).where("word is not null").distinct(), MOST_WORDS))
    rows = df.select(F.col(key), F.col(text).cast("string").alias("_text"))
    kind = rows.schema[0].dataType.simpleString()

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1):
            stats = [text_stats(t, words) for t in batch.column(1).to_pylist()]
            top = ngram_coverage([w for _, w in stats])
            known = np.array([x[8] is not None for x, _ in stats], bool)
            columns = [pa.array([x[i] for x, _ in stats], t) for i, t in enumerate(TYPES[:-1])] + [pa.array(top, mask=~known)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, *FIELDS])

    return rows.mapInArrow(local, f"`{key}` {kind}, {SCHEMA}")


def rules() -> dict[str, Column]:
    """What tells a text from prose, in the order in which the rules decide; each is
    a condition of its own on the statistics."""
    structured = F.greatest("item_lines", F.col("cell_lines") + F.col("form_lines"))
    return {
        "loop": F.col("top_ngram") >= LOOP_SHARE,
        "copies": (F.col("lines") > 3) & (F.greatest("duplicate_lines", "duplicate_paragraphs") >= COPY_SHARE),
        "symbols": (F.col("symbol_ratio") >= SYMBOL_SHARE) | (F.col("digit_ratio") >= DIGIT_SHARE),
        "structure": (structured >= STRUCTURE_SHARE) & (F.col("running_share") < STRUCTURED_PROSE),
        "sentences": F.col("running_share") < PROSE_SHARE,
    }


def deciding_rule() -> Column:
    """The name of the first rule that holds, "prose" if none does, null for texts
    without content."""
    out = F.when(F.col("running_share").isNull(), F.lit(None).cast("string"))
    for name, rule in rules().items():
        out = out.when(rule, F.lit(name))
    return out.otherwise(F.lit("prose"))


def prose_rule() -> Column:
    """True for prose, false for lists, tables, forms, logs, navigation and junk, null
    for texts without content: no rule may hold."""
    return deciding_rule() == "prose"
