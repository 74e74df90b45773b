import random

import pytest

from pyspark.sql import functions as F

from marlstone.llm.truncation import ROWS_OUT, cut_rows, end_state, features, near_copies, peel

SUBJECT = ["A potter with muddy hands", "The narrator", "Two cyclists with helmets", "A crowd of spectators", "An older man"]
VERB = ["repairs a bent wheel", "carries crates of apples", "plays a slow melody", "kneads a piece of dough", "waits for the signal"]
PLACE = ["in a narrow workshop", "at the end of a long corridor", "behind a glass counter", "on the roof of a garage"]
CLAUSE = ["while a tram passes on the left", "with the sun low on the horizon", "as rain begins to fall"]
MORE = ["The camera rises above the rooftops.", "In the background, a choir rehearses quietly.", "The light is dim and bluish."]


def sentence(rng):
    s = f"{rng.choice(SUBJECT)} {rng.choice(VERB)} {rng.choice(PLACE)}"
    s += f", {rng.choice(CLAUSE)}." if rng.random() < 0.5 else "."
    return " ".join([s, *[rng.choice(MORE) for _ in range(rng.randint(0, 3))]])


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    rows, truth = [], {}
    for i in range(4000):
        text, source, cut = sentence(rng), rng.choice(["plain", "limit", "wire", None]), False
        kind = rng.random()
        if source == "limit" and len(text) > 90:
            text, cut = text[:90], True
            cut = text[-1] != "."
        elif source == "wire" and kind < 0.2:
            at = rng.randint(10, len(text) - 3)
            text, cut = text[:at].rstrip() + rng.choice(["", "…", " [cut]"]), True
            cut = None if text[at - 1 : at] in ".," or text.rstrip("…").endswith(".") else True
        elif kind > 0.9:
            text = text[:-1] + rng.choice(["", " [end of scene]", " ✔"])
        rows.append((i, source, text))
        truth[i] = cut
    extra = [None, "", "  ", '{"description": "The narrator wai', '```json\n{"description": "All is well."}\n```', '{"description": "The narrator waits for the"}', "A sign reading \"Do not", "Behind a glass counter,", "word " * 3000 + "end."]
    rows += [(10_000 + i, "plain", t) for i, t in enumerate(extra)]
    return rows, truth


def test_cut_texts_are_found(spark, corpus):
    rows, truth = corpus
    df = spark.createDataFrame([(*r, "own", 3) for r in rows], "clip_row long, source string, vlm_description string, marker string, cut int")
    got = {r["id"]: r["cut"] for r in cut_rows(df, "clip_row", "vlm_description", "source").collect()}
    known = {i: c for i, c in truth.items() if c is not None}
    found, cases = {i for i in known if got[i]}, {i for i, c in known.items() if c}
    assert len(found & cases) / len(cases) > 0.97
    assert len(found & cases) / len(found) > 0.97
    assert got[10_003] and not got[10_004] and got[10_005] and got[10_006] and got[10_007] and not got[10_008]
    assert not {10_000, 10_001, 10_002} & set(got)


def test_repeated_rows_are_judged_alike(spark, corpus):
    rows, _ = corpus
    one = spark.createDataFrame(rows, "clip_row long, source string, vlm_description string")
    twice = one.unionByName(one.selectExpr("clip_row + 100000 as clip_row", "source", "vlm_description"))
    got = {r["id"]: r["cut"] for r in cut_rows(twice, "clip_row", "vlm_description", "source").collect()}
    assert all(got[i] == got[i + 100_000] for i in got if i < 100_000)


def test_copies_of_a_cut_text_do_not_teach_its_end(spark):
    rng = random.Random(5)
    rows = [(i, "plain", sentence(rng)) for i in range(2000)]
    cut, end = "A potter with muddy hands repairs a bent wheel in a narrow", "A potter with muddy hands repairs a bent wheel in a narrow workshop"
    rows += [(10_000 + i, "plain", cut) for i in range(1000)] + [(20_000, "plain", end)]
    got = {r["id"]: r["cut"] for r in cut_rows(spark.createDataFrame(rows, "clip_row long, source string, vlm_description string").repartition(6), "clip_row", "vlm_description", "source").collect()}
    assert len(got) == len(rows)
    assert {i for i, c in got.items() if c} == {10_000 + i for i in range(1000)}


def test_near_copy_tells_where_the_end_is_rare(spark):
    whole = "Seven herons circle above an old lighthouse near the harbour wall and two fishermen mend their torn nets beside crimson tarpaulins flapping wildly."
    rows = [(1, "plain", whole), (2, "plain", whole.removesuffix(" flapping wildly."))]
    got = {r["id"]: r["cut"] for r in cut_rows(spark.createDataFrame(rows, "clip_row long, source string, vlm_description string"), "clip_row", "vlm_description", "source").collect()}
    assert got == {1: False, 2: True}


def test_long_words_cut_late_are_fragments(spark):
    word = "donaudampfschifffahrtsgesellschaftskapitän"
    rows = [(i, "plain", f"Picture {'abcdefghij'[i]} shows a sleepy {word} near the door.") for i in range(10)]
    rows.append((100, "plain", f"In the evening we met a sleepy {word[:30]}"))
    got = {r["id"]: r["cut"] for r in cut_rows(spark.createDataFrame(rows, "clip_row long, source string, vlm_description string"), "clip_row", "vlm_description", "source").collect()}
    assert {i for i, c in got.items() if c} == {100}


@pytest.mark.parametrize("kind", ["90 %", "60 %", "first word edited", "one word edited", "inside a word", "other text", "complete"])
def test_planted_pairs_are_aligned(spark, kind):
    rng = random.Random(kind)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(4, 8)))
    rows = []
    for i in range(300):
        words = [word() for _ in range(rng.randint(35, 60))]
        short = words[: int(len(words) * (0.6 if kind == "60 %" else 0.9))]
        if kind in ("first word edited", "one word edited"):
            short[0 if kind[0] == "f" else rng.randrange(len(short) - 10)] = word()
        if kind == "inside a word":
            short[-1] = short[-1][:-2]
        if kind == "other text":
            short = [word() for _ in short]
        if kind == "complete":
            short, words = words, words[:-5]
        rows += [(2 * i, " ".join(words) + "."), (2 * i + 1, " ".join(short))]
    texts = spark.createDataFrame(rows, "text_hash long, text string").repartition(3)
    read = texts.select("text_hash", "text", F.lit(1).cast("long").alias("copies")).mapInArrow(features, ROWS_OUT)
    got = near_copies(read, texts).collect()
    flagged = {r["text_hash"] for r in got if (r["in_word"] if kind == "inside a word" else r["at_word"])}
    assert all(i % 2 for i in flagged)
    assert len(flagged) >= 270 if kind not in ("other text", "complete") else not flagged


def test_a_third_of_all_rows_in_one_bucket(spark):
    whole = "Seven herons circle above an old lighthouse near the harbour wall and two fishermen mend their torn nets beside crimson tarpaulins number"
    rows = [(i, f"{whole} {i} flapping wildly.") for i in range(3000)] + [(10_000, whole.removesuffix(" tarpaulins number"))]
    texts = spark.createDataFrame(rows, "text_hash long, text string").repartition(3)
    read = texts.select("text_hash", "text", F.lit(1).cast("long").alias("copies")).mapInArrow(features, ROWS_OUT)
    assert {r["text_hash"] for r in near_copies(read, texts).collect() if r["at_word"]} == {10_000}


def test_long_markers_and_closers(spark):
    remark = "[" + "the transfer was broken off here " * 20 + "]"
    assert peel("All is we " + remark)[:2] == ("All is we", remark.lower())
    assert peel("All is well." + "\"" * 30)[3]


def test_empty_table(spark):
    assert cut_rows(spark.createDataFrame([], "clip_row long, source string, vlm_description string"), "clip_row", "vlm_description", "source").count() == 0


@pytest.mark.parametrize(
    ("text", "base", "marker", "state"),
    [("All is well.", "All is well.", "", 0), ("All is we…", "All is we", "...", 1), ("All is we [cut]", "All is we", "[cut]", 1), ("All is well. ✔", "All is well.", "✔", 0), ("A list,", "A list,", "", 2), ('He said "no', 'He said "no', "", 2), ('{"description": "All is', '{"description": "All is', "", 3)],
)
def test_peel(text, base, marker, state):
    p = peel(text)
    assert p[:2] == (base, marker) and end_state(p[0], p[2], p[3]) == state


def test_every_text_of_a_bucket_is_compared(spark):
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    begin = " ".join(words[:30])
    stopped = [(i, f"{begin}. And {words[40 + i % 5]} stands alone" + " as ever" * (i > 4000) + ".") for i in [*range(40), *range(5000, 5040)]]
    asking = [(i, begin) for i in range(1000, 2100)]
    inside = [(3000, begin + "en" + " " + " ".join(words[30:36]) + ".")]
    for more, flag in (([(3001, begin + " " + " ".join(words[30:38]) + ".")], "at_word"), (inside, "in_word")):
        texts = spark.createDataFrame(stopped + asking + more, "text_hash long, text string").repartition(3)
        read = texts.select("text_hash", "text", F.lit(1).cast("long").alias("copies")).mapInArrow(features, ROWS_OUT)
        assert {r["text_hash"] for r in near_copies(read, texts).collect() if r[flag]} == {i for i, _ in asking}
