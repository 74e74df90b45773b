"""Encoding of a text column with a public byte-level BPE tokenizer.

Every partition encodes its own texts: they are cut into words by the
tokenizer's pattern, and a recursive DuckDB query over the words not yet known
takes token-position rows, joins each pair of neighbours with the merge table,
and contracts each word's pairs of least rank, leftmost first, until no pair of
any word has a merge. The recursion is keyed by word, so only its newest tokens
are held. An ordered aggregation gives each word's ids, which NumPy lays out by
document. `decode` is the inverse, by ordered aggregation.

All occurrences of a word's least pair are contracted in one step (in a run such
as aaaa every second one, from the left): the same result as one at a time.

Null and empty texts give an empty list; names of special tokens in a text are
plain text; texts are taken whole. The merge table (one row per vocabulary
entry) is read on the driver from a path and broadcast.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import bounded

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: The published word pattern of this family of tokenizers (fixed value).
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: DuckDB inside a task: one thread, and never a file of the machine.
IN_MEMORY = {"threads": 1, "memory_limit": "600MB", "temp_directory": ""}
WORDS_PER_QUERY, CACHED_WORDS = 20_000, 500_000

STEP = """
SELECT w, list(CASE WHEN taken THEN merged ELSE id END ORDER BY pos) AS ids
FROM (
  SELECT *, coalesce(lag(taken) OVER (PARTITION BY w ORDER BY pos), false) AS eaten
  FROM (
    SELECT *, hit AND (first <> second OR (pos - max(CASE WHEN hit THEN NULL ELSE pos END) OVER (PARTITION BY w ORDER BY pos ROWS UNBOUNDED PRECEDING)) % 2 = 1 OR
      (max(CASE WHEN hit THEN NULL ELSE pos END) OVER (PARTITION BY w ORDER BY pos ROWS UNBOUNDED PRECEDING) IS NULL AND pos % 2 = 1)) AS taken
    FROM (
      SELECT *, coalesce(rank = min(rank) OVER (PARTITION BY w), false) AS hit, min(rank) OVER (PARTITION BY w) AS best
      FROM (
        SELECT w, pos, id, merged, rank, m.first, m.second
        FROM (SELECT w, pos, id, lead(id) OVER (PARTITION BY w ORDER BY pos) AS next
              FROM (SELECT w, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM words_now)) p
        LEFT JOIN merges m ON p.id = m.first AND p.next = m.second))
    WHERE best IS NOT NULL))
WHERE NOT eaten GROUP BY w"""
ENCODE = "WITH RECURSIVE words_now(w, ids) USING KEY (w) AS (SELECT w, ids FROM fresh UNION " + STEP + ") SELECT w, ids FROM words_now ORDER BY w"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: printable Latin-1
    bytes stand for themselves, the others for code points from 256 upwards."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


class Vocabulary:
    """Byte ids and merge table of a tokenizer file."""

    def __init__(self, path: str = DEFAULT_TOKENIZER) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        letters = byte_letters()
        self.byte_ids = np.array([ids[c] for c in letters], np.int32)
        self.first = np.array([ids[a] for a, _ in pairs], np.int32)
        self.second = np.array([ids[b] for _, b in pairs], np.int32)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int32)
        self.pieces = {i: word for word, i in ids.items() if set(word) <= set(letters)}  # without special tokens


class WordEncoder:
    """Ids of words, by a recursive query over those not seen before."""

    def __init__(self, vocab: Vocabulary) -> None:
        import duckdb

        self.vocab, self.db = vocab, duckdb.connect(":memory:", config=IN_MEMORY)
        table = pa.table({"first": vocab.first, "second": vocab.second, "merged": vocab.merged, "rank": np.arange(len(vocab.first), dtype=np.int32)})
        self.db.register("merge_rows", table)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merge_rows")
        self.reset()

    def reset(self) -> None:
        self.code: dict[str, int] = {}
        self.lengths, self.flat, self.known = np.zeros(0, np.int64), np.zeros(0, np.int32), 0

    def learn(self, words: list[str]) -> None:
        for start in range(0, len(words), WORDS_PER_QUERY):
            part = words[start : start + WORDS_PER_QUERY]
            raw = [w.encode() for w in part]
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int32)
            ids = self.vocab.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
            fresh = pa.table({"w": np.arange(len(part), dtype=np.int32), "ids": pa.ListArray.from_arrays(offsets, ids)})
            self.db.register("fresh", fresh)
            out = self.db.sql(ENCODE).to_arrow_table().combine_chunks()
            lists = out.column("ids").chunk(0)
            self.lengths = np.concatenate([self.lengths, np.diff(np.asarray(lists.offsets))])
            self.flat = np.concatenate([self.flat, lists.flatten().to_numpy()])
            self.code.update((w, self.known + i) for i, w in enumerate(part))
            self.known += len(part)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has."""
        import regex

        if self.known > CACHED_WORDS:
            self.reset()
        pattern = _compiled.setdefault("p", regex.compile(WORD_PATTERN))
        split = [pattern.findall(t) if t else [] for t in texts]
        self.learn(list(dict.fromkeys(w for s in split for w in s if w not in self.code)))
        count = np.array([len(s) for s in split], np.int64)
        codes = np.fromiter((self.code[w] for s in split for w in s), np.int64, int(count.sum()))
        starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        size = self.lengths[codes]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        where = np.repeat(starts[codes] - (ends - size), size) + np.arange(total) if total else np.zeros(0, np.int64)
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(count)])]
        return self.flat[where], np.diff(upto)


_compiled: dict = {}
_encoders: dict = {}


def _encoder(vocab: Vocabulary) -> WordEncoder:
    """One encoder per Python worker, kept from task to task."""
    key = (len(vocab.merged), int(vocab.merged.astype(np.int64).sum()), int((vocab.first.astype(np.int64) * np.arange(1, len(vocab.first) + 1)).sum()))
    if key not in _encoders:
        _encoders[key] = WordEncoder(vocab)
    return _encoders[key]


def encode(df: DataFrame, key: str, text: str, tokenizer: str = DEFAULT_TOKENIZER, counts_only: bool = False) -> DataFrame:
    """`key`, ids (array<int>) of each row; with `counts_only` key, tokens."""
    vocab = df.sparkSession.sparkContext.broadcast(Vocabulary(tokenizer))
    rows = df.select(F.col(key), F.col(text).cast("string").alias("_text"))
    kind = rows.schema[0].dataType.simpleString()

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in bounded(batches, 1):
            encoder = encoder or _encoder(vocab.value)
            ids, count = encoder.encode(batch.column(1).to_pylist())
            second = pa.array(count) if counts_only else pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(count)]).astype(np.int32), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), second], names=[key, "tokens" if counts_only else "ids"])

    return rows.mapInArrow(local, f"`{key}` {kind}, " + ("tokens bigint" if counts_only else "ids array<int>"))


DECODE = """
SELECT d, string_agg(piece, '' ORDER BY pos) AS letters
FROM (SELECT d, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM coded) JOIN pieces USING (id) GROUP BY d ORDER BY d"""
IDS_PER_QUERY = 500_000


def decode(df: DataFrame, key: str, ids: Column, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """`key`, text: the pieces of the ids joined in order, by an ordered aggregation
    in DuckDB over the id-position rows of each slice of a partition. A null or
    empty list gives an empty text; ids without a piece (special tokens) give
    nothing; bytes that are no UTF-8 become the replacement character."""
    vocab = df.sparkSession.sparkContext.broadcast(Vocabulary(tokenizer).pieces)
    rows = df.select(F.col(key), ids.cast("array<int>").alias("_ids"))
    kind = rows.schema[0].dataType.simpleString()

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        db = duckdb.connect(":memory:", config=IN_MEMORY)
        db.register("rows", pa.table({"id": pa.array(vocab.value.keys(), pa.int32()), "piece": pa.array(vocab.value.values(), pa.string())}))
        db.execute("CREATE TABLE pieces AS SELECT * FROM rows")
        to_bytes = {ord(c): chr(b) for b, c in enumerate(byte_letters())}
        for batch in batches:
            lists = batch.column(1)
            size = np.diff(np.asarray(lists.offsets)) * np.asarray(lists.is_valid())
            cut = np.flatnonzero(np.diff(np.cumsum(size) // IDS_PER_QUERY)) + 1
            for start, end in zip([0, *cut], [*cut, len(lists)], strict=True):
                start, end = int(start), int(end)
                part = lists.slice(start, end - start)
                filled = np.flatnonzero(size[start:end])
                db.register("coded", pa.table({"d": pa.array(filled), "ids": part.take(pa.array(filled))}))
                out = [""] * (end - start)
                found = db.sql(DECODE).to_arrow_table()
                for d, letters in zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True):
                    out[d] = letters.translate(to_bytes).encode("latin-1").decode("utf-8", "replace")
                if end > start:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), pa.array(out, pa.string())], names=[key, "text"])

    return rows.mapInArrow(local, f"`{key}` {kind}, text string")
