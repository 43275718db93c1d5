from __future__ import annotations

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from quire.functions import arrow as A
from quire.functions import quotes as Q
from quire.functions import speech as S
from quire.functions import text as T


def one(spark, column, *values):
    return [r.v for r in spark.createDataFrame([(v,) for v in values], "x string").select(column.alias("v")).collect()]


def test_initials_and_search(spark):
    df = spark.createDataFrame([("위대한 개츠비", "The Great One"), (None, "Other")], "ko string, en string")
    assert [r[0] for r in df.select(T.initials("ko")).collect()] == ["ㅇㄷㅎ ㄱㅊㅂ", None]
    hits = df.where(T.matches("ㅇㄷㅎ great", F.lower("en"), T.initials(F.coalesce("ko", F.lit(""))))).count()
    assert hits == 1


def test_fuzzy_score(spark):
    assert one(spark, T.fuzzy_score("abc", F.col("x")), "abc", "xaxbxc", "ab", "") == [2 + 6 + 4 + 6, 6, -1, -1]


def test_roman(spark):
    assert one(spark, T.roman_to_int("x"), "XIV", "mcmvi", "", "AB", None) == [14, 1906, None, None, None]


def test_headings(spark):
    rows = one(spark, T.heading("x"), "CHAPTER IV. Title", "X. Y. Z.", "_BOOK THE SECOND_", "IV", "12.", "§ 3", "He went away and came back.", "", "Prologue", "Chapter Twenty-one")
    got = [None if r is None else (r.type, r.num, r.title) for r in rows]
    assert got == [("chapter", 4, "Title"), None, ("book", 2, ""), ("numeric", 4, ""), ("numeric", 12, ""), ("sectsign", 3, ""), None, None, ("named", None, "Prologue"), ("chapter", 21, "")]


def test_toc_rows(spark):
    rows = one(spark, T.toc_row("x"), "IV. The Door .... 17", "I AND MY CHIMNEY 5", "CHAPTER PAGE", "it was late, and he went,", "XII")
    assert [r and (r.label, r.title) for r in rows] == [("IV", "The Door"), ("", "I AND MY CHIMNEY"), None, None, None]


def test_punctuation_and_tidy(spark):
    assert one(spark, T.punctuation("x"), "a . . . b", "x -- y", "x----y", "a , b") == ["a … b", "x—y", "x——y", "a, b"]
    assert one(spark, T.tidy("x"), "a — b", "so......", ", x  y", "a, , b,.") == ["a, b", "so…", "x y", "a, b."]


def test_html(spark):
    s = "<style>p{}</style><script>if(a)b('</p>')</script><h1>T</h1><p>a<br>b &amp;lt; c</p><!-- no -->"
    assert one(spark, T.html_to_text("x"), s, "", None) == ["T\n\na\nb &lt; c", "", None]


def test_fnv(spark):
    assert one(spark, T.fnv1a("x"), "abc", "", None) == [440920331, 2166136261, None]


def test_labels(spark):
    df = spark.createDataFrame([(0, 59), (59, 60), (60, 3600), (135, 90000), (None, None)], "m int, s int")
    assert [r[0] for r in df.select(T.minutes_label("m")).collect()] == ["1분 미만", "59분", "1시간", "2시간 15분", None]
    assert [r[0] for r in df.select(T.ago_label("s")).collect()][:4] == ["방금", "1분 전", "1시간 전", "어제"]


def test_split_title(spark):
    rows = one(spark, T.split_title("x"), "Moby; or, The Whale", "A: B", "Plain", "One (Two)")
    assert [tuple(r) for r in rows] == [("Moby", "The Whale"), ("A", "B"), ("Plain", ""), ("One", "Two")]


@pytest.mark.parametrize(
    ("f", "given_", "want"),
    [
        (S.english, 1906, "one thousand nine hundred and six"),
        (S.english_year, 1906, "nineteen oh six"),
        (S.english_year, 1900, "nineteen hundred"),
        (S.english_ordinal, 21, "twenty-first"),
        (S.sino, 10000, "만"),
        (S.sino, 21504, "이만천오백사"),
        (S.native, 20, "스무"),
        (S.native, 34, "서른네"),
    ],
)
def test_numbers(f, given_, want):
    assert f(given_) == want


def test_spoken():
    assert S.spoken_en("Mr. X paid £5 on May 3, 1906 (CHAPTER IV).") == "Mister X paid five pounds on May third, nineteen oh six (CHAPTER four)."
    assert S.spoken_ko("3:20에 사과 5개, 제1장, 1906년") == "세 시 이십 분에 사과 다섯 개, 제일장, 천구백육년"
    assert S.spoken_ja("それは――〔注〕そう") == "それは、注そう"


def test_fragments():
    t = "Mr. Smith came home late that evening. “Who is it?” she asked him quietly. 3.5 pounds."
    assert [t[a:b] for a, b in S.fragments(t)] == ["Mr. Smith came home late that evening.", "“Who is it?” she asked him quietly.", "3.5 pounds."]
    long = "word, " * 100
    assert all(b - a <= 260 for a, b in S.fragments(long))
    assert S.fragments("") == []


def test_quote_spans():
    assert (Q.quotations("“a” b “c", "“"), Q.left_open("“a” b “c", "“")) == ([(0, 3, False), (6, 8, False)], "“")
    assert (Q.quotations("“d” e", "“", "“"), Q.left_open("“d” e", "“")) == ([(0, 3, True)], None)
    assert (Q.quotations("続き」と言った", "「『", "「"), Q.left_open("続き」と言った", "「『")) == ([(0, 3, True)], None)
    assert (Q.quotations("「外『内』外」", "「『"), Q.left_open("「外『内』外」", "「『")) == ([(0, 7, False)], None)
    assert (Q.quotations("don’t ‘go’", "‘"), Q.left_open("don’t ‘go’", "‘")) == ([(6, 10, False)], None)


def test_marks():
    assert A._curly("\"I can't,\" he said, 'tis late") == "“I can’t,” he said, ’tis late"
    assert A._emphasis("_Di_sy and __x__ _open") == "<em>Di</em>sy and <em>x</em> <em>open</em>"
    assert A._small_caps("THE GREAT HALL was dark") == '<span class="smallcaps">THE GREAT HALL</span> was dark'


def test_ruby():
    assert A._annotated("｜私《わたし》と漢字《かんじ》※［＃「丸」、U+3042、1-2］") == "<ruby>私<rt>わたし</rt></ruby>と<ruby>漢字<rt>かんじ</rt></ruby>あ"
    assert A._annotated("強い言葉［＃「言葉」に傍点］だ") == "強い<em>言葉</em>だ"
    assert A.ruby_spans("x<ruby>漢<rt>かん</rt></ruby>y") == ("x漢y", [(1, 1, "かん")])


@given(st.text())
def test_arrow_functions_take_any_text(s):
    for f in (A._alnum, A._nfc, A._curly, A._emphasis, A._wrap, S.spoken_en, S.spoken_ko, S.spoken_ja, A._annotated, S.speech_key, S.model_input, A._small_caps):
        assert isinstance(f(s), str)
    spans = S.fragments(s)
    assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(None,), ("",)], "x string")
    for f in (T.initials, T.slug, T.heading_key, T.visible, T.strip_tags, T.escape, T.tidy, T.punctuation, T.middle_out, T.display_width, T.hiragana, T.natural_key, A.alnum, A.nfc, A.curly, A.wrap):
        rows = df.select(f("x").alias("v")).collect()
        assert rows[0] == Row(v=None) and rows[1].v is not None


def test_levenshtein_counts_characters(spark):
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    pairs = [("", "abc"), ("가나다", "가라다마"), ("é€𝒳", "e€𝒳"), ("kitten sitting", "sitting kitten"), ("같다", "같다")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [r[0] for r in df.select(F.levenshtein("a", "b")).collect()] == [plain(a, b) for a, b in pairs]


def test_noise_is_the_same_for_the_same_text():
    assert A._noise("a") == A._noise("a") != A._noise("b") and len(A._noise("x", 5)) == 5
    x = A._noise("sentence", 4000)
    assert abs(sum(x) / 4000) < 0.06 and abs(sum(v * v for v in x) / 4000 - 1) < 0.08
    assert A.uniforms(0, 1) == A.uniforms(1, 1) == [270369 / 4294967295]  # 1 ^ 1 << 13, then >> 17, then << 5
    assert A.fnv_units("abc") == 440920331


def test_word_codes():
    a, b = A.word_codes("the cat sat", "the dog sat on").split("\n")
    assert (len(a), len(b)) == (3, 4) and a[0] == b[0] and a[2] == b[2] and a[1] != b[1]
    assert A.word_codes("", None) == "\n"


def test_emphasis_is_carried():
    assert A._emphasis("a_ b", True) == "<em>a</em> b" and A._emphasis("plain 6_s._") == "plain 6_s."
