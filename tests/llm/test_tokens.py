import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.llm.tokens import DEFAULT_TOKENIZER, Vocabulary, WordEncoder, decode, encode

pytestmark = pytest.mark.skipif(not os.path.exists(DEFAULT_TOKENIZER), reason="no tokenizer file")
TEXTS = [None, "", " ", "Hello  world", "<|endoftext|>", "don't WE'LL 's", "\r\n\n\t x", "ééé é", "👍🏽👩‍👩‍👧", "日本語のテキスト", "�​\x00\x1c\x85　", "a" * 30_001, "ab" * 9_000, "- " * 5_000, "z1!" * 20]


@pytest.fixture(scope="module")
def library_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(DEFAULT_TOKENIZER)
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoder():
    return WordEncoder(Vocabulary())


def test_ids_and_round_trip(spark, library_ids):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(99, "Hello  world", "")], "doc_id long, text string, ids string")
    ids = encode(df, "doc_id", "text")
    got = {r["doc_id"]: r["ids"] for r in ids.collect()}
    assert got == {i: library_ids(t) for i, t in enumerate(TEXTS)} | {99: library_ids("Hello  world")}
    counts = {r["doc_id"]: r["tokens"] for r in encode(df, "doc_id", "text", counts_only=True).collect()}
    assert counts == {k: len(v) for k, v in got.items()}
    back = {r["doc_id"]: r["text"] for r in decode(ids, "doc_id", F.col("ids")).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)} | {99: "Hello  world"}


def test_empty_table(spark):
    assert encode(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_any_text(encoder, library_ids, text):
    ids, count = encoder.encode([text])
    assert ids.tolist() == library_ids(text) and count.tolist() == [len(ids)]


def test_decoding_of_odd_lists(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [50256]), (4, [464, 50256, 464]), (5, [447]), (6, [999999])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in decode(df, "doc_id", F.col("ids")).collect()} == {1: "", 2: "", 3: "", 4: "TheThe", 5: "\ufffd", 6: ""}
