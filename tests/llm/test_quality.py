import pytest

from marlstone.llm.quality import deciding_rule, document_stats, is_form, ngram_coverage, prose_rule

WORDS = "the a an of to and in is it that was for on with as at by this but not are be from we der die und nicht von".split()
PROSE = [
    "Once the list was repaired, the queue drained within an hour. It was not clear who did that, but we were glad.",
    '"Just do it again," said the visitor, "and come back for it later." That was all of it.',
    "once the list was repaired the queue drained within the hour and nobody of us knew why it was that the lamp on the table was on",
    "The lamp of the house was on when we came, and it\nwas on when we left the house in the night. That\nis all that we know of it.",
    "夕日が沈むころ、三人の子どもたちが屋上で合図を待っている。カメラは低い位置から追いかける。",
    "Here is the table that we promised of the runs in the lab, as it was.\n\n| a | b |\n|---|---|\n| 1 | 2 |",
]
OTHER = [
    "1. oscuras vieja\n2. cocina detección\n3. reserva caché\n4. contacto", "| a | b |\n|---|---|\n| 1.0 | 2.0 |\n| 3.1 | of the |", "2025-03-01T14:02:52 DEBUG worker-27 embedding shard=338 took=737.3ms\n2025-03-13T20:32:08 ERROR worker-38 resize",
    "[10:28:16] error: refused new work on the shard of a 35\n[01:38:02] warn: ran out of memory on the shard", "a=1 b=2 the=that of=5 we=7.\na=2 b=3 the=this of=8 we=9.", "Home | Clips | Runs | Sign in\nBack to top\nAccept all | Settings",
    "---------------------------------", "f8,f8,f8,f8,f8,f8,f8,f8,f8,f8,f8,f8", "scheduler videos twice overlap model export contained replayed started visible spoon several spare showed intern short",
    "Name of the file: ____\nDate of the run? yes / no\nTo whom is it: ........", "[ ] rebuild the index\n[x] write the manifest\n☐ sort the screws", "x" * 50_000,
]


@pytest.fixture(scope="module")
def common(spark):
    return spark.createDataFrame([(w,) for w in WORDS], "word string")


def judged(spark, common, texts):
    df = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "doc_id int, text string, words double")
    return {r["doc_id"]: r for r in document_stats(df, "doc_id", "text", common).withColumn("prose", prose_rule()).withColumn("rule", deciding_rule()).collect()}


def test_prose_and_other_forms(spark, common):
    got = judged(spark, common, PROSE + OTHER)
    assert [i for i in range(len(PROSE)) if not got[i]["prose"]] == []
    assert [OTHER[i - len(PROSE)] for i in range(len(PROSE), len(got)) if got[i]["prose"]] == []


FOREIGN = [
    "Вчера вечером мы долго шли по берегу реки и говорили о том, что было летом. На другом берегу горел огонь, но людей не было видно.",
    "昨天晚上我们沿着河边走了很久，说起了夏天的事情。对岸有一堆火在燃烧，但是看不到人。后来他们把船推到了水里。",
    "어제 저녁에 우리는 강가를 오래 걸으면서 여름에 있었던 일을 이야기했다. 건너편에는 불이 타고 있었지만 사람은 보이지 않았다.",
    "Χθες το βράδυ περπατήσαμε για πολλή ώρα στην όχθη του ποταμού. Στην άλλη πλευρά έκαιγε μια φωτιά, αλλά δεν είδαμε κανέναν.",
]
FOREIGN_LISTS = ["1. хлеб\n2. молоко\n3. сахар\n4. соль", "目录\n产品\n联系方式\n登录", "홈 | 제품 | 연락처 | 로그인"]


def test_prose_of_other_languages(spark, common):
    got = judged(spark, common, FOREIGN + FOREIGN_LISTS)
    assert [got[i]["prose"] for i in range(len(FOREIGN))] == [True] * len(FOREIGN)
    assert [got[i]["prose"] for i in range(len(FOREIGN), len(got))] == [False] * len(FOREIGN_LISTS)


def test_each_rule_decides(spark, common):
    para = "It was the lamp of the house that we saw when we came. "
    cases = {
        "loop": "and it was the same " * 40 + ".", "copies": "\n".join([para + "That is it."] * 3 + [para.replace("lamp", "lamp of the hall and door") * 2] * 9), "symbols": "=====----- of the ##### $$$$ %%%% in it", "structure": "- of the\n- in it\n- to be\n- as is",
        "sentences": "scheduler videos twice overlap model export contained replayed started visible",
    }
    got = judged(spark, common, list(cases.values()))
    assert [got[i]["rule"] for i in range(len(cases) - 4)] == ["loop"] and [got[i]["rule"] for i in (2, 3, 4)] == ["symbols", "structure", "sentences"]
    assert not got[1]["prose"]


def test_long_lines_and_tags(spark, common):
    label = "Name of the place where the parcel was left by the driver on that day " * 75
    assert len(label) > 5000 and is_form(label + ":") and is_form(label + "____") and is_form("Of the date = 12") and is_form(label + "[ ]")
    assert not is_form("We left: it was late and the lamp of the house was off when we came") and not is_form("It is. So: yes")
    tag = '<a href="' + "x" * 3000 + '">'
    assert judged(spark, common, [tag + PROSE[0] + tag])[0]["prose"]


def test_coverage_counts_characters_once():
    assert ngram_coverage([["a", "b"] * 10, ["a", "b", "c"], [], ["aa"] * 4, ["x", "yy", "q", "x", "yy", "r"]]).tolist() == pytest.approx([1.0, 0.0, 0.0, 1.0, 6 / 8])


def test_blank_texts_are_no_cases(spark, common):
    got = judged(spark, common, [None, "", " \n\t", "　﻿​"])
    assert all(r["prose"] is None and r["words"] == 0 and r["mean_word_length"] is None for r in got.values())


def test_values_of_a_small_text(spark, common):
    r = judged(spark, common, ["Ab cde.\nAb cde.\n\nThe 12 fg"])[0]
    assert r["words"] == 6 and r["lines"] == 3 and r["mean_word_length"] == pytest.approx(15 / 6)
    assert r["punctuated_lines"] == pytest.approx(2 / 3) and r["common_words"] == pytest.approx(1 / 6)
    assert r["symbol_ratio"] == pytest.approx(2 / 19) and r["digit_ratio"] == pytest.approx(2 / 19)
    assert r["duplicate_lines"] == pytest.approx(7 / 23)


def test_empty_table(spark, common):
    assert judged(spark, common, []) == {}


def test_a_list_of_words_must_be_small(spark, common, monkeypatch):
    monkeypatch.setattr("marlstone.llm.quality.MOST_WORDS", 3)
    with pytest.raises(ValueError, match="at most 3"):
        judged(spark, common, ["x"])
