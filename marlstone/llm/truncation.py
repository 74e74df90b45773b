"""Texts cut off by field limits or mid-transfer, and the share per source.

1. `features` reads each distinct text once, however many rows carry it, and
   counts, for every context of one to six words, how often a full stop, an
   ellipsis, the bare end of a text or more text follows it (summed per task,
   then per context): the terminality of closing words. It also keeps which
   beginnings of words can follow a word, so a fragment ("the end of a long
   corri") is told.
2. It reduces each text to its closing contexts, its outermost trailing marker,
   its length, and the buckets of its possible cuts: three min-hash bands of the
   five-word shingles before the cut, as running minima, so a text has a few spans
   of places per band. A mask of 128 bits stands for its shingles.
3. `near_copies` takes every text that ends without a full stop to all texts of its
   buckets (band key and place). Pairs whose masks prove that they share less than
   0.8 of the shorter text's shingles, or not its last one, end there, as a stream
   inside the join; all others are read and verified, aligned along the last whole
   shingle, and tell whether the longer text goes on within the clause or word. A
   text that lost more than half of its shingles is no near-copy of it.
4. `cut_rows` flags a text whose alignment ends early, whose reply is not closed,
   whose quotation is open, that ends in a fragment or in closing words that
   hardly ever close, that carries a marker which mostly stands for lost text,
   or that ends without a full stop at a length where its source's certain cuts
   and its bare ends pile up (a field limit, in characters or bytes). Markers
   and limits too are learned from distinct texts (limits: of each source), so
   copies of one text add nothing there; all its rows get its verdict.

Texts ending in a full stop, null and blank texts are no cases. Words of other
scripts count as in Latin script; ideographs and kana count one by one.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import bounded
from marlstone.session import stored

WIDTHS = (1, 2, 3, 4, 5, 6)
SHINGLE, BANDS, ROWS, SIMILARITY = 5, 3, 2, 0.8
#: A near-copy keeps at least this share of the shingles of the longer text.
KEPT = 0.5
#: A context with more than this share of ends is a place where texts end.
TERMINAL_SHARE = 0.03
#: With more than this share of ends a near-copy that goes on there proves no cut.
END_SHARE = 0.1
#: Least count of a context, by its width in words.
SUPPORT = {1: 5, 2: 8, 3: 10, 4: 20, 5: 20, 6: 20}
#: Tells a text's first words from the same words elsewhere.
OPENING = np.uint64(0x5851F42D4C957F2D)
#: Kana and ideographs count as words of their own.
TOKEN = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]|[^\W\u3040-\u30ff\u3400-\u9fff]+(?:['’\-][^\W\u3040-\u30ff\u3400-\u9fff]+)*|[.!?…。！？]+|\S")
STOPS, DOTS = regex.compile(r"[.!?。！？]{1,2}$|[!?]+$"), regex.compile(r"[.…。]*(?:…|\.\.)[.…]*$")
WORDLIKE = re.compile(r"\w")
CLOSERS = frozenset("\"'’”»)]}」』*_`")
SYMBOL = regex.compile(r"[\p{So}\ufe0f\u200d]")
BRACKETS = {"]": "[", ")": "(", ">": "<"}
STOP_SIGNS = frozenset(".!?。！？")
AFTER_STOP = "\"'’”»)]」』*_`"
WORD, STOP, ELLIPSIS, LIGHT, CLOSER = 0, 1, 2, 3, 4
MID, STOPPED, ENDED, DOTTED = 0, 1, 2, 3


def peel(text: str) -> tuple[str, str, bool, bool]:
    """(text without wrapper and trailing markers, outermost marker, whether a
    raw reply is left open, whether the text ends with a full stop)."""
    t, marker = text.strip(), ""
    if t[:1] in "`{" and t:
        t, marker = strip_markers(t)
        body = t
        if t.startswith("```"):
            if not t.endswith("```") or t.count("```") < 2:
                return t, marker, True, False
            body = t[3:-3].strip().removeprefix("json").strip()
        if body.startswith("{"):
            if not body.endswith("}"):
                return t, marker, True, False
            try:
                inner = json.loads(body)
                inner = next((inner[k] for k in ("description", "text", "caption") if isinstance(inner.get(k), str)), "") if isinstance(inner, dict) else ""
            except ValueError:
                inner = ""
            if not inner.strip():
                return "", marker, False, True
            t, marker = inner.strip(), ""
        else:
            t = body
    if len(t) > 1 and t[-1] in ".。" and t[-2] not in ".…":
        return t, marker, False, True
    t, own = strip_markers(t)
    return t, marker or own, False, own not in ("...", "…") and t.rstrip(AFTER_STOP)[-1:] in STOP_SIGNS


def marker_start(t: str) -> int:
    """Where the marker at the end of `t` begins: a bracketed remark without a
    bracket or line end inside, dots of an ellipsis, replacement characters or
    symbols; len(t) if there is none."""
    last = t[-1:]
    if last in BRACKETS:
        at = t.rfind(BRACKETS[last])
        inner = t[at + 1 : -1]
        return at if at >= 0 and inner and not any(c in inner for c in (last, "\n")) else len(t)
    if last in ".…":
        at = len(t.rstrip("." if last == "." else "…"))
        return at if last == "…" or len(t) - at >= 3 else len(t)
    if last == "\ufffd":
        return len(t.rstrip("\ufffd"))
    at = len(t)
    while at and not t[at - 1].isascii() and SYMBOL.match(t[at - 1]):
        at -= 1
    return at


def strip_markers(t: str) -> tuple[str, str]:
    """(text without its trailing markers, the outermost one), whatever their length."""
    t, marker = t.rstrip(), ""
    while len(t) > 1 and (at := marker_start(t)) < len(t):
        own = t[at:]
        marker = marker or ("..." if own.strip(".…") == "" else own[:1] if own[0] == "\ufffd" else own.lower())
        t = t[:at].rstrip()
    return t, marker


class Codes:
    """Tokens of a worker as numbers, with their hash and kind."""

    def __init__(self) -> None:
        self.code: dict[str, int] = {}
        self.hashes, self.kinds, self.words = [], [], []

    def of(self, token: str) -> int:
        c = self.code.get(token)
        if c is None:
            c = self.code[token] = len(self.words)
            self.words.append(token)
            self.hashes.append(xxhash.xxh64_intdigest(token))
            self.kinds.append(WORD if WORDLIKE.search(token) else ELLIPSIS if DOTS.fullmatch(token) else STOP if STOPS.fullmatch(token) else CLOSER if token in CLOSERS else LIGHT)
        return c

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array(self.hashes, np.uint64), np.array(self.kinds, np.int8)


def tokenized(bases: list[str], codes: Codes) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts one after the other, and the row of each."""
    out, size, of = [], np.empty(len(bases), np.int64), codes.of
    for i, b in enumerate(bases):
        tokens = TOKEN.findall(b.lower())
        size[i] = len(tokens)
        out += [of(x) for x in tokens]
    return np.array(out, np.int64), np.repeat(np.arange(len(bases)), size)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def delayed(h: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(len(h), h.dtype)
    if k < len(h):
        out[k:] = h[: len(h) - k]
    return out


def context_hashes(h: np.ndarray, row: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each width: hash of the `width` tokens that end at each place, and
    whether so many are in the row."""
    out, acc = {}, np.zeros(len(h), np.uint64)
    for k in range(1, max(WIDTHS) + 1):
        acc = mix(acc + delayed(h, k - 1) * np.uint64(2 * k + 1))
        valid = (np.arange(len(h)) >= k - 1) & (row == delayed(row, k - 1))
        if k in WIDTHS:
            out[k] = (acc ^ np.uint64(k)), valid
    return out


def body_tokens(bases: list[str], codes: Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words and full stops of the texts: code, row, hash, and what follows each
    word (commas, quotes and brackets are no context, but a comma is more text)."""
    code, row = tokenized(bases, codes)
    hashes, kinds = codes.arrays()
    kind = kinds[code] if len(code) else np.zeros(0, np.int8)
    solid = np.flatnonzero(kind != CLOSER)  # closing quotes are looked through
    after = np.full(len(code), ENDED, np.int8)
    nxt = np.searchsorted(solid, np.arange(len(code)), "right")
    has = nxt < len(solid)
    to = solid[np.minimum(nxt, len(solid) - 1)] if len(solid) else np.zeros(len(code), np.int64)
    has &= row[to] == row if len(code) else False
    table = np.array([MID, STOPPED, DOTTED, MID, MID], np.int8)
    after[has] = table[kind[to[has]]]
    keep = (kind == WORD) | (kind == STOP)
    return code[keep], row[keep], hashes[code[keep]] if len(code) else np.zeros(0, np.uint64), np.where(kind[keep] == WORD, after[keep], -1)


def pair_hash(a: np.ndarray | int, b: np.ndarray) -> np.ndarray:
    return mix(np.atleast_1d(np.asarray(a, np.uint64)) * np.uint64(31) + b)


def beginnings(word: str) -> list[int]:
    """Hashes of all beginnings of a word, in one pass however long it is."""
    out, x = [], xxhash.xxh64()
    for c in word[:-1]:
        x.update(c)
        out.append(x.intdigest())
    return out


class EndCounts:
    """What follows each context, and which beginnings of words can follow a
    word, summed over a task. A key is a context hash whose two low bits say
    what follows; the beginnings are given out with a count of 0."""

    def __init__(self) -> None:
        self.keys, self.counts = [], []
        self.ones, self.twos = np.zeros((2, 0), np.uint64), np.zeros((2, 0), np.uint64)

    def add(self, ctx: dict[int, tuple[np.ndarray, np.ndarray]], code: np.ndarray, row: np.ndarray, after: np.ndarray, place: np.ndarray) -> None:
        word = after >= 0
        kept = [(c[use] & ~np.uint64(3)) | after[use].astype(np.uint64) for c, valid in ctx.values() for use in (valid & word,)]
        kept += [(mix(ctx[k][0][use] ^ OPENING) & ~np.uint64(3)) | after[use].astype(np.uint64) for k in (1, 2) for use in (word & (place == k - 1),)]
        keys, counts = np.unique(np.concatenate(kept), return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts)
        if len(self.keys) > 16:
            self.merge()
        went_on = (after == MID) | (after == STOPPED)
        for name, k in (("ones", 1), ("twos", 2)):
            c, valid = ctx[k]
            at = np.flatnonzero(went_on[1:] & valid[:-1] & (row[1:] == row[:-1])) + 1
            both = np.concatenate([getattr(self, name), np.stack([c[at - 1], code[at].astype(np.uint64)])], axis=1)
            _, first = np.unique(mix(both[0] * np.uint64(31) + both[1]), return_index=True)
            setattr(self, name, both[:, first])

    def merge(self) -> None:
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        self.keys, self.counts = [keys[start]], [np.add.reduceat(counts, start)]

    def size(self) -> int:
        return max(len(self.keys[0]) if self.keys else 0, self.twos.shape[1])

    def rows(self, codes: Codes) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.merge()
        pairs = np.concatenate([self.ones, self.twos], axis=1)
        words, which = np.unique(pairs[1], return_inverse=True)
        begins = [beginnings(codes.words[w]) for w in words.tolist()]
        size = np.array([len(x) for x in begins], np.int64)
        flat, start = np.array([h for x in begins for h in x], np.uint64), np.cumsum(size) - size
        n = size[which]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[which], n)
        more = np.unique(pair_hash(np.repeat(pairs[0], n), flat[at])) if len(at) else np.zeros(0, np.uint64)
        return np.concatenate([self.keys[0], more]).view(np.int64), np.concatenate([self.counts[0], np.zeros(len(more), np.int64)])


ROWS_OUT = "text_hash bigint, copies bigint, chars int, bytes int, marker string, state int, ctx array<bigint>, fragments array<bigint>, asks array<bigint>, at int, tokens binary, word string, ask_low bigint, ask_high bigint, tail int, slack int, spans array<struct<band:bigint,first:int,last:int>>, low bigint, high bigint, key bigint, n bigint"
NAMES = [f.split(" ")[0] for f in ROWS_OUT.split(", ")]
SPANS = pa.list_(pa.struct([("band", pa.int64()), ("first", pa.int32()), ("last", pa.int32())]))
ARROW = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), SPANS, pa.int64(), pa.int64(), pa.int64(), pa.int64()]
OPEN_REPLY, COMPLETE, BARE, OPEN_END = 3, 0, 1, 2
#: Words and contexts a task holds before it gives out its counts.
HELD = 1_000_000
#: Texts that ask in one bucket are met in blocks of so many.
ASKING = 1_000
#: After these more text must come.
GOES_ON = frozenset(",;:([{-–—/&+、，：；（「『")


def end_state(base: str, open_reply: bool, closed: bool) -> int:
    if open_reply:
        return OPEN_REPLY
    if closed or not base:
        return COMPLETE
    quotes = base.count('"') % 2 or base.count("“") > base.count("”") or base.count("「") > base.count("」")
    return OPEN_END if quotes or base[-1] in GOES_ON else BARE


def shingle_hashes(h: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of five words (of all words of a shorter text), by row."""
    n = np.bincount(row, minlength=rows)
    acc, valid = np.zeros(len(h), np.uint64), np.zeros(len(h), bool)
    start = np.cumsum(n) - n
    place = np.arange(len(h)) - start[row] if len(h) else np.zeros(0, np.int64)
    for k in range(SHINGLE):
        acc = mix(acc + np.where(place >= k, delayed(h, k), 0).astype(np.uint64) * np.uint64(2 * k + 1))
    valid = (place >= SHINGLE - 1) | ((n[row] < SHINGLE) & (place == n[row] - 1)) if len(h) else valid
    return acc[valid], row[valid]


_MULTIPLIERS = np.random.default_rng(20240101).integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def running_bands(shingles: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For each band and shingle the min-hash key of its text's shingles up to it:
    running minima of ROWS hash functions. Later rows get smaller high halves, so
    one accumulation starts anew with each text."""
    out = np.zeros((BANDS, len(shingles)), np.uint64)
    back = (np.uint64(row[-1]) - row.astype(np.uint64)) << np.uint64(32) if len(row) else out[0]
    for b in range(BANDS):
        key = np.full(len(shingles), b + 1, np.uint64)
        for multiplier in _MULTIPLIERS[b]:
            low = np.minimum.accumulate(back | mix(shingles * multiplier) >> np.uint64(32)) & np.uint64(0xFFFFFFFF)
            key = mix(key * np.uint64(31) + low)
        out[b] = key
    return out


def spans_of(bands: np.ndarray, where: np.ndarray, row: np.ndarray, place: np.ndarray, rows: int) -> pa.Array:
    """Where the text of each row could be cut: (band key, first and last place it holds
    for). `bands` at the positions `where`, which are in order of row and place. A band
    changes only where a minimum does, so a text has a few spans per band, not one per
    place."""
    row, place = row[where], place[where]
    found = []
    for keys in bands[:, where]:
        new = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])]) if len(keys) else np.zeros(0, np.int64)
        end = np.r_[new[1:], len(keys)] - 1
        found.append((row[new], keys[new], place[new], place[end] if len(new) else place[new]))
    own, keys, first, last = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(own, kind="stable")
    offsets = np.r_[0, np.cumsum(np.bincount(own, minlength=rows))].astype(np.int32)
    parts = [pa.array(keys[order].view(np.int64)), pa.array(first[order].astype(np.int32)), pa.array(last[order].astype(np.int32))]
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(parts, names=["band", "first", "last"]))


def masks(shingles: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Low and high half of each row's mask of 128 bits, a bit for each shingle, the
    same of all shingles but the last, the number of shingles, and the bit of each."""
    bit = (mix(shingles * OPENING) >> np.uint64(57)).astype(np.int64)
    value = np.uint64(1) << (bit & 63).astype(np.uint64)
    size = np.bincount(row, minlength=rows)
    some = np.flatnonzero(size)
    start, final = (np.cumsum(size) - size)[some], np.zeros(len(bit), bool)
    final[(np.cumsum(size) - 1)[some]] = True
    out = np.zeros((4, rows), np.uint64)
    for i, use in enumerate((bit < 64, bit >= 64, (bit < 64) & ~final, (bit >= 64) & ~final)):
        if len(some):
            out[i, some] = np.bitwise_or.reduceat(np.where(use, value, np.uint64(0)), start)
    return out[:2], out[2:], size, bit


def lists_of(values: np.ndarray, chosen: np.ndarray) -> pa.Array:
    """List column with the rows of `values` where chosen, else empty lists."""
    offsets = np.r_[0, np.cumsum(np.where(chosen, values.shape[1], 0))].astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(values[chosen].reshape(-1).view(np.int64)))


def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per text that is not blank, and the task's end counts (key, n); takes
    each text once, as (hash, text, rows that carry it).

    Every place where a cut would leave at least half of a text's shingles is
    in the buckets of the min-hash bands of the shingles before it (`spans`). A text
    without closing full stop asks in the buckets of its own last word, with the mask
    of the shingles before it, the bit of the last of these (`tail`) and the number
    that a near-copy may lack (`slack`)."""
    codes, ends = Codes(), EndCounts()

    def given(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
        size = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(size, t) for c, t in zip(NAMES, ARROW, strict=True)], names=NAMES)

    def counts() -> pa.RecordBatch:
        return given(dict(zip(("key", "n"), ends.rows(codes), strict=True)))

    for batch in bounded(batches, 1):
        texts = batch.column(1).to_pylist()
        use = [i for i, t in enumerate(texts) if t and t.strip()]
        if not use:
            continue
        peeled = [peel(texts[i]) for i in use]
        bases, n = [p[0] for p in peeled], len(use)
        if len(codes.code) > HELD or ends.size() > HELD:
            yield counts()
            codes, ends = Codes(), EndCounts()
        code, row, h, after = body_tokens(bases, codes)
        ctx = context_hashes(h, row)
        state = np.array([end_state(p[0], p[2], p[3]) for p in peeled], np.int32)
        size = np.bincount(row, minlength=n)
        start = (np.cumsum(size) - size)[row]
        place = np.arange(len(row)) - start
        if len(code):
            ends.add(ctx, code, row, np.where(state[row] == OPEN_REPLY, -1, after), place)
        last = np.maximum(np.cumsum(size) - 1, 0)
        any_word = size > 0
        blank = np.zeros(n, np.uint64)
        pick = lambda a, ok, at: np.where(ok, a[at], 0).astype(np.uint64) if len(a) else blank
        closing = [pick(c & ~np.uint64(3), any_word & (valid[last] if len(valid) else False), last) for c, valid in ctx.values()]
        opening = sum(pick(mix(ctx[k][0] ^ OPENING) & ~np.uint64(3), size == k, last) for k in (1, 2))
        closing = np.stack([*closing, opening], axis=1)
        left = [pick(c, size > k, last - 1) for k, (c, _) in ((1, ctx[1]), (2, ctx[2]))]
        fragments = np.stack([np.where(size > k, pair_hash(x, pick(h, any_word, last)), 0) for k, x in zip((1, 2), left, strict=True)], axis=1).astype(np.uint64) & ~np.uint64(3)
        sh, sh_row = shingle_hashes(h, row, n)
        shingles = np.bincount(sh_row, minlength=n)
        raw = [texts[i] for i in use]
        bare, take = state == BARE, pa.array(use)
        # where a text of half of its shingles could end, and its own last word
        before = (np.cumsum(shingles) - shingles)[row] + place - SHINGLE  # shingle that ends with the word before
        full = place >= SHINGLE
        spot = np.flatnonzero(full & (place + 2 - SHINGLE >= KEPT * shingles[row]) & (place < size[row] - 1))
        bands = running_bands(sh, sh_row)
        bands = bands[:, np.where(full, before, 0)] if len(sh) else np.zeros((BANDS, len(row)), np.uint64)
        held, asked, many, bit = masks(sh, sh_row, n)
        tail = bit[np.maximum(np.cumsum(many) - 2, 0)] if len(bit) else np.zeros(n, np.int64)
        slack = np.floor((many - 1) * (1 - SIMILARITY) + 1e-6)
        asks, short = bare & (size > SHINGLE), h.astype(np.uint32)
        own = bands[:, last].T if len(row) else np.zeros((n, BANDS), np.uint64)
        columns = [
            batch.column(0).take(take), batch.column(2).take(take), pa.array([len(t) for t in raw], pa.int32()), pa.array([len(t.encode()) for t in raw], pa.int32()), pa.array([p[1] for p in peeled], pa.string()), pa.array(state), lists_of(closing, bare), lists_of(fragments, bare), lists_of(own, asks),
            pa.array((size - 1).astype(np.int32), mask=~asks), pa.array([short[a:b].tobytes() if x else None for a, b, x in zip(last - size + 1, last, asks.tolist(), strict=True)], pa.binary()),
            pa.array([codes.words[c] if x else None for c, x in zip(code[last].tolist(), asks.tolist(), strict=True)] if len(code) else [None] * n, pa.string()), 
            *(pa.array(x.view(np.int64), mask=~asks) for x in asked), *(pa.array(x.astype(np.int32), mask=~asks) for x in (tail, slack)),
            spans_of(bands, spot, row, place, n), *(pa.array(x.view(np.int64)) for x in held), *(pa.nulls(n, t) for t in ARROW[-2:]),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=NAMES)
    yield counts()


def aligned_ends(pairs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs (text_hash, tokens, word, other): whether the text of these words and
    this last word is a near-copy of a beginning of `other` that ends at a word
    (`at_word`) or inside one (`in_word`) where `other` goes on; pairs that are no
    near-copies are left out.

    Near-copies share at least 0.8 of the distinct shingles of `tokens`, and are
    aligned along the last of these, so that the text ends inside the other
    whatever was edited before; of several places the one nearest to the own length
    counts."""
    for batch in bounded(pairs, 3, 8_000_000):
        codes, others, own = Codes(), batch.column(3).dictionary_encode(), batch.column(1).dictionary_encode()
        code, row, h, after = body_tokens([peel(t)[0] for t in others.dictionary.to_pylist()], codes)
        n, count = batch.num_rows, len(others.dictionary)
        size = np.bincount(row, minlength=count)
        sh, of = shingle_hashes(h & np.uint64(0xFFFFFFFF), row, count)
        kept = size[of] >= SHINGLE
        j = np.arange(len(sh)) - (np.cumsum(np.bincount(of, minlength=count)) - np.bincount(of, minlength=count))[of]
        keys, place = pair_hash(sh, of.astype(np.uint64))[kept], j[kept] + SHINGLE  # place of the word behind each shingle
        order = np.lexsort((place, keys))
        keys, place = keys[order], place[order]
        raw = own.dictionary.to_pylist()
        length = np.array([len(x) // 4 for x in raw], np.int64)
        mine, mrow = shingle_hashes(np.frombuffer(b"".join(raw), np.uint32).astype(np.uint64), np.repeat(np.arange(len(raw)), length), len(raw))
        tail = mine[np.cumsum(np.bincount(mrow, minlength=len(raw))) - 1] if len(mine) else np.zeros(len(raw), np.uint64)
        once = np.unique(pair_hash(mine, mrow.astype(np.uint64)), return_index=True)[1]
        once.sort()
        mine, mrow = mine[once], mrow[once]
        many = np.bincount(mrow, minlength=len(raw))
        which, text = own.indices.to_numpy(), others.indices.to_numpy()
        ask = pair_hash(tail[which], text.astype(np.uint64)) if n else np.zeros(0, np.uint64)
        left, right = np.searchsorted(keys, ask), np.searchsorted(keys, ask, "right")
        pair = np.flatnonzero((right > left) & (length[which] >= SHINGLE))
        # share of the shingles that are in the other text
        m = many[which[pair]]
        at = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m) + np.repeat((np.cumsum(many) - many)[which[pair]], m)
        asked = pair_hash(mine[at], np.repeat(text[pair], m).astype(np.uint64)) if len(at) else np.zeros(0, np.uint64)
        found = np.searchsorted(keys, asked, "right") > np.searchsorted(keys, asked)
        shared = np.bincount(np.repeat(np.arange(len(pair)), m), weights=found, minlength=len(pair))
        pair = pair[shared >= SIMILARITY * m]
        # the aligned place nearest to the own length
        k = (right - left)[pair]
        spot = place[np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k) + np.repeat(left[pair], k)]
        far, who = np.abs(spot - np.repeat(length[which[pair]], k)), np.repeat(np.arange(len(pair)), k)
        near = np.lexsort((spot, far, who))
        spot = spot[near][np.unique(who[near], return_index=True)[1]]
        inside = spot < size[text[pair]]
        pair, spot = pair[inside], spot[inside]
        at = (np.cumsum(size) - size)[text[pair]] + spot
        full, ends = [codes.words[c] for c in code[at].tolist()], batch.column(2).take(pa.array(pair)).to_pylist()
        same = np.array([a == b for a, b in zip(ends, full, strict=True)], bool)
        within = np.array([len(b) > len(a) and b.startswith(a) for a, b in zip(ends, full, strict=True)], bool)
        goes_on = (after[at] == MID) & (spot < size[text[pair]] - 1)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(pair)), pa.array(same & goes_on), pa.array(within)], names=["text_hash", "at_word", "in_word"])


def near_copies(feats: DataFrame, texts: DataFrame) -> DataFrame:
    """`text_hash, at_word, in_word` of texts without a closing full stop that are
    near-copies of a longer text's beginning: whether one of them goes on where they
    end, at a word or inside one.

    A bucket is a band key and a place, and every text that asks there meets every text
    with a span there. A pair is let go only where the masks prove it no near-copy: a
    bit that the asking text has and the other lacks is at least one shingle that the
    other lacks, and without the last shingle it can't be aligned. Texts that ask in
    one bucket are met in blocks, so texts of a band that hold no asked place are not
    compared one by one. `texts` are (text_hash, text)."""
    block = F.floor((F.row_number().over(Window.partitionBy("band", "at").orderBy("text_hash")) - 1) / ASKING)
    short = feats.where("at is not null").select("text_hash", F.explode("asks").alias("band"), "at", "ask_low", "ask_high", "tail", "slack").withColumn("block", block)
    asking = short.groupBy("band", "at", "block").agg(F.collect_list(F.struct("text_hash", "ask_low", "ask_high", "tail", "slack")).alias("asking"))
    spans = feats.where("size(spans) > 0").select(F.inline("spans"), F.col("text_hash").alias("rep"), "low", "high")
    met = spans.join(asking, "band").where("at between first and last").select("rep", "low", "high", F.inline("asking"))
    lacks = F.expr("bit_count(ask_low & ~low) + bit_count(ask_high & ~high)")
    aligns = F.expr("(shiftrightunsigned(if(tail < 64, low, high), tail & 63) & 1) = 1")
    links = stored(met.where(aligns & (lacks <= F.col("slack"))).select("text_hash", "rep").distinct(), "links")
    other = links.select("rep").distinct().join(texts.select(F.col("text_hash").alias("rep"), F.col("text").alias("other")), "rep").distinct()
    own = feats.where("at is not null").select("text_hash", "tokens", "word")
    pairs = links.join(own, "text_hash").join(other, "rep").select("text_hash", "tokens", "word", "other")
    return pairs.mapInArrow(aligned_ends, "text_hash bigint, at_word boolean, in_word boolean").groupBy("text_hash").agg(F.max("at_word").alias("at_word"), F.max("in_word").alias("in_word"))


def terminality(endings: DataFrame, stats: DataFrame, bare: DataFrame) -> DataFrame:
    """`ending, share` of the other texts' ends after the closing words (a text's own
    end is no evidence for it): the least over the contexts of three words and more
    that are common enough, else that of the widest. A text of one or two words that
    no other text begins with and goes on is a reply of its own: share 1.

    `stats` has each distinct text once. Short complete texts recur by chance where
    long ones hardly do, so bare ends count by their rows, but for no more than
    thrice what the median text with that end would give: a group of copies adds
    little, and the only text with an end nothing."""
    ends = endings.select("ending", F.posexplode("ctx").alias("_i", "ctx")).where("ctx <> 0")
    carried = bare.select(F.explode("ctx").alias("ctx"), "copies").where("ctx <> 0").groupBy("ctx").agg(F.count(F.lit(1)).alias("k"), F.sum("copies").alias("carried"), F.percentile_approx("copies", 0.5, 100).alias("median"))
    others = carried.select("ctx", "k", (F.least("carried", 3 * F.col("k") * F.col("median")) * (F.col("k") - 1) / F.col("k")).alias("others"))
    total = F.col("mid") + F.col("stopped") + F.col("ended") + F.col("dotted")
    need = F.element_at(F.array(*[F.lit(SUPPORT[w]) for w in WIDTHS], F.lit(1)), F.col("_i") + 1)
    hit = ends.join(stats.withColumn("total", total), "ctx").where(F.col("total") >= need).join(others, "ctx")
    context = F.col("_i") < len(WIDTHS)
    closed = F.col("total") - F.col("mid") - F.col("k") + F.col("others")
    share = F.when(context & (F.col("mid") + closed > 0), closed / (F.col("mid") + closed))
    alone = F.max(F.when(~context & (F.col("mid") == 0), F.lit(1.0)))
    wide = F.min(F.when(F.col("_i") >= 2, share))
    return hit.groupBy("ending").agg(F.coalesce(alone, wide, F.max_by(share, F.when(context, F.col("_i")))).alias("share"))


def at_limit(judged: DataFrame, length: str) -> DataFrame:
    """`source, marker, length`: field limits of a source, lengths where at least a tenth
    of its certain cuts lie, if there are also more ends that look complete (but
    have no full stop) than at the lengths around: twice their mean and three
    deviations more."""
    hist = judged.groupBy(F.coalesce("source", F.lit("")).alias("source"), "marker", F.col(length).alias("length")).agg(F.count_if(~F.col("cut")).alias("n"), F.count_if("cut").alias("cuts"))
    own = Window.partitionBy("source")
    around = Window.partitionBy("source", "marker").orderBy("length")
    near = hist.withColumn("_all", F.sum("cuts").over(own)).withColumn("_near", (F.coalesce(F.sum("n").over(around.rangeBetween(-10, -2)), F.lit(0)) + F.coalesce(F.sum("n").over(around.rangeBetween(2, 10)), F.lit(0))) / 18)
    return near.where((F.col("cuts") >= 5) & (F.col("cuts") * 10 >= F.col("_all")) & (F.col("n") > 2 * F.col("_near") + 3 * F.sqrt("_near"))).select("source", "marker", "length")


def cut_rows(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """`id, source, cut` (boolean) of every row with a key and a text that is not
    blank; keys should be unique."""
    body, text_hash = F.col(text).cast("string").alias("text"), F.xxhash64("text").alias("text_hash")
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(source).cast("string").alias("source"), body).where("text is not null").select("id", "source", text_hash)
    texts = df.select(body).where("text is not null").groupBy("text").agg(F.count(F.lit(1)).alias("copies")).select(text_hash, "text", "copies")
    read = stored(texts.mapInArrow(features, ROWS_OUT), "features")
    low = F.col("key").bitwiseAND(3)
    after = {name: F.sum(F.when(low == i, F.col("n")).otherwise(0)).alias(name) for name, i in (("mid", MID), ("stopped", STOPPED), ("ended", ENDED), ("dotted", DOTTED))}
    ctx = F.col("key").bitwiseAND(F.lit(-4)).alias("ctx")
    stats = stored(read.where("key is not null and n > 0").groupBy(ctx).agg(*after.values()), "ends")
    begun = read.where("n = 0").select(ctx.alias("fragment")).distinct()
    feats = read.where("text_hash is not null")
    bare = feats.where(F.col("state") == BARE).select("text_hash", "copies", "chars", "bytes", "marker", F.xxhash64("ctx", "fragments").alias("ending"), "ctx", "fragments")
    endings = stored(bare.groupBy("ending").agg(F.any_value("ctx").alias("ctx"), F.any_value("fragments").alias("fragments")), "endings")  # judged once each
    done = stats.where("mid + stopped > 0").select(F.col("ctx").alias("whole"), F.lit(True).alias("done"))
    # a last word that never went on after these words, where longer words begin so
    tails = endings.select("ending", F.inline(F.array(*[F.struct(F.get("fragments", F.lit(i)).alias("fragment"), F.get("ctx", F.lit(i + 1)).alias("whole")) for i in (0, 1)]))).where("fragment <> 0 and whole <> 0")
    broken = tails.join(begun, "fragment").join(done, "whole", "left").where("done is null").select("ending").distinct().withColumn("broken", F.lit(True))
    early = near_copies(read, df.select(body).where("text is not null").select(text_hash, "text"))
    judged = bare.drop("ctx", "fragments").join(terminality(endings, stats, bare), "ending", "left").join(broken, "ending", "left").join(early, "text_hash", "left")
    below = lambda most, unknown: F.coalesce(F.col("share") < most, F.lit(unknown))  # noqa: E731 - without a share the alignment decides
    cut_end = F.col("broken").isNotNull() | below(TERMINAL_SHARE, False) | F.coalesce("in_word", F.lit(False)) | F.coalesce("at_word", F.lit(False)) & below(END_SHARE, True)
    judged = stored(judged.select("text_hash", "chars", "bytes", "marker", cut_end.alias("cut")), "judged")
    marks = judged.where("marker not in ('', '...')").groupBy("marker").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("cut").cast("int")).alias("share")).where("n >= 5 and share >= 0.5").select(F.col("marker").alias("lossy"))
    rest = feats.where(F.col("state") != BARE).select("text_hash", (F.col("state") != COMPLETE).alias("cut"))
    verdicts = judged.withColumn("bare", F.lit(True)).unionByName(rest.withColumn("bare", F.lit(False)), allowMissingColumns=True)
    told = stored(rows.join(verdicts, "text_hash"), "told")
    ended = told.where("bare")
    once = ended.drop("id").dropDuplicates(["source", "text_hash"])
    out = ended.withColumn("_s", F.coalesce("source", F.lit(""))).join(marks, ended["marker"] == marks["lossy"], "left")
    for measure in ("chars", "bytes"):
        limits = at_limit(once, measure).select(F.col("source").alias("_s"), "marker", F.col("length").alias(measure), F.lit(True).alias(f"_{measure}"))
        out = out.join(limits, ["_s", "marker", measure], "left")
    out = out.select("id", "source", (F.col("cut") | F.col("lossy").isNotNull() | F.col("_chars").isNotNull() | F.col("_bytes").isNotNull()).alias("cut"))
    return out.unionByName(told.where("not bare").select("id", "source", "cut"))
