from __future__ import annotations

import pytest
from hypothesis import given
from hypothesis import strategies as st

from quire.llm.p1 import sentence_units
from quire.llm.sentences import segment
from quire.llm.words import words


def cut(t):
    return [t[a:b] for a, b in segment(t)]


@pytest.mark.parametrize(
    "units",
    [
        ["Mr. Wrenmoor met Dr. J. R. Oskin at No. 57, St. Orla's Row.", "He had read p. 222 and pp. 9 f. twice over."],
        ["She came back at 12 p.m.", "The light turned grey."],
        ["The meeting of 1918. 3. 14. was held here."],
        ["“Hush!” answered Varnholt.", "There were 951 people."],
        ["“How long have you been standing there?", "I saw you at the yard,” said Quenby.", "Snow fell."],
        ["Ettrickson said, “It is no affair of mine.”", "He left."],
        ["“Three times I rang, and three times—” cried Dunnock.", "“But if you think—”", "Mrs. Umberly found it."],
        ["The sign (what a sign!) hung above the meadow.", "(It was late.)", "Marrable knew—who did not?—that it was false."],
        ["Lorimond waited... and waited beside the glove."],
        ["“그 질문에는 대답할 수 없습니다.” 오딜 양이 중얼거렸다.", "“확실한가?”", "렌무어는 오딜에게 사다리에 관해 물었다."],
        ["“내가 알 바 아닐세.”", "케스트럴비는 말했다, “나는 종을 울렸다.”"],
        ["이벗스워스는 ‘멈춰!’ 하고 외치며 달아났다.", "간판이(얼마나 대단한 간판인지!) 걸려 있었다.", "손퀼은 p. 8와 pp. 9 f.를 읽었다."],
    ],
)
def test_spaced(units):
    assert cut(" ".join(units)) == units


@pytest.mark.parametrize(
    "units",
    [
        ["「確かか？", "本当に絨毯だったのですか？」とケストレルビー嬢が答えた。", "雪が降った。"],
        ["ブラムリングは言った、「座ったほうがいい。」", "ひどく改まって、ダノックは笑った。"],
        ["看板は(なんという看板か!)門の上に掛かっていた。", "（ロリモンドは笑った。）", "「なんと滑稽な傘だ！」", "ところがダノックは泣いた。"],
        ["イボッツワースは『止まれ！』と叫んで傘を落とした。"],
    ],
)
def test_without_spaces(units):
    assert cut("".join(units)) == units


def test_paragraphs_and_verse():
    assert cut("IV. Blue envelope\n\nDear J. R. Taverley,\n\nA line\nanother line.\nThird\n\n* * *\n\nYours ever, Dunnock") == ["IV. Blue envelope", "Dear J. R. Taverley,", "A line\nanother line.", "Third", "Yours ever, Dunnock"]
    assert cut("번역: <em>우산</em>이 커 보였다. 끝") == ["번역: <em>우산</em>이 커 보였다.", "끝"]
    assert cut("<em></em>") == cut(" \n") == cut("") == segment(None) == []


def test_offsets_are_of_the_stored_text():
    t = "“낡은 하숙집 쪽을​ 보게!” 그가 외쳤다. 끝이다​."
    assert [t[a:b] for a, b in segment(t)] == ["“낡은 하숙집 쪽을​ 보게!” 그가 외쳤다.", "끝이다​."]


@given(st.text(alphabet="가나다. ?!“”‘’「」。！ABc\n\n()<em>ー漢か…—0가́​", max_size=80))
def test_units_are_ordered_trimmed_and_cover_all_letters(t):
    spans = segment(t)
    assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
    assert all(not t[a].isspace() and not t[b - 1].isspace() for a, b in spans)


def test_lattice():
    assert [w for w, _ in words("とにかくセジリー")][0] == "とにかく"
    assert words("とセジリー")[0] == ("と", "continuing")


def test_operator(spark):
    df = spark.createDataFrame([("units", 1, "It fell. We saw. D", "x"), ("units", 1, "It fell. We saw. D", "y"), ("units", 2, None, None), ("units", 3, "", "z")], "src_table string, row_id bigint, text string, start_pos string")
    rows = sentence_units(df).collect()
    assert sorted((r.row_id, r.start_pos, r.end_pos) for r in rows) == [(1, 0, 8), (1, 0, 8), (1, 9, 16), (1, 9, 16), (1, 17, 18), (1, 17, 18)]
    assert sentence_units(df.limit(0)).count() == 0


@pytest.mark.parametrize("t", ["(", "()", " ", "\n", "“", ". ", "a", "가.", "。", "-", "<em>", "́", "ᄀ", "A. ", "Mr. X ", "「あ」", "... ", '"a" ', "그는 말했다, “가.” "])
def test_very_long_texts_take_linear_time(t):
    import time

    def took(n):
        began = time.process_time()
        segment(t * (n // len(t)))
        return time.process_time() - began

    took(1000)
    assert took(120_000) < 2.0


def test_gap_in_a_later_paragraph():
    from quire.llm.sentences import segment

    t = "前の段落。\n\n猫が来た　犬が行った。"
    assert [t[a:b] for a, b in segment(t)] == ["前の段落。", "猫が来た", "犬が行った。"]
