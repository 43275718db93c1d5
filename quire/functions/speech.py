"""Text as it is spoken: numbers in words, one-pass readers of English, Korean and Japanese text, fragments for speech.

A reader is a table of forms. Each form is a pattern and what to say for it; at every place the first form of the
table that fits there is read, and what was read is not looked at again.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import cache

# ---- numbers

#: Number words of the languages.
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "ten twenty thirty forty fifty sixty seventy eighty ninety".split()
ORDINAL = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}
SINO_ONES = "영일이삼사오육칠팔구"
NATIVE_ONES = "한 두 세 네 다섯 여섯 일곱 여덟 아홉".split()
NATIVE_TENS = "열 스물 서른 마흔 쉰 예순 일흔 여든 아흔".split()
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}

#: Place values of a language, largest first: value, name, what joins the multiple to the name, what joins the rest, and whether a multiple of one is said.
EN_PLACES = ((10**9, "billion", " ", " ", True), (10**6, "million", " ", " ", True), (1000, "thousand", " ", " ", True), (100, "hundred", " ", " and ", True))
KO_PLACES = ((10**12, "조", "", "", True), (10**8, "억", "", "", True), (10**4, "만", "", "", False), (1000, "천", "", "", False), (100, "백", "", "", False), (10, "십", "", "", False))


def _read(n: int, places: tuple, small: Callable[[int], str]) -> str:
    for value, name, join, then, one in places:
        if n >= value:
            times, rest = divmod(n, value)
            head = name if times == 1 and not one else _read(times, places, small) + join + name
            return head + (then + _read(rest, places, small) if rest else "")
    return small(n)


def _small_english(n: int) -> str:
    return ONES[n] if n < 20 else TENS[n // 10 - 1] + ("-" + ONES[n % 10] if n % 10 else "")


@cache
def english(n: int) -> str:
    """A number from nought in English words."""
    return _read(n, EN_PLACES, _small_english)


def english_year(n: int) -> str:
    """A year as it is said: in hundreds, but for the first ten of a millennium from 2000 on."""
    century, year = divmod(n, 100)
    if 2000 <= n < 2010:
        return english(n)
    return english(century) + " " + ("hundred" if not year else "oh " + ONES[year] if year < 10 else english(year))


def english_ordinal(n: int) -> str:
    *head, last = re.split(r"\b(?=\w+$)", english(n))
    return "".join(head) + ORDINAL.get(last, re.sub("y$", "ie", last) + "th")


@cache
def sino(n: int) -> str:
    """A number in Sino-Korean words."""
    return _read(n, KO_PLACES, lambda d: SINO_ONES[d])


@cache
def native(n: int) -> str:
    """A number as it stands before a counter: native words up to ninety-nine, Sino-Korean ones beyond."""
    if n == 20:
        return "스무"
    return "".join(names[d - 1] for names, d in ((NATIVE_TENS, n // 10), (NATIVE_ONES, n % 10)) if d) if 0 < n < 100 else sino(n)


def roman(numeral: str) -> int:
    """Value of a Roman numeral: a letter before a larger one counts against it."""
    total = most = 0
    for v in (ROMAN[c] for c in reversed(numeral)):
        total += v if v >= most else -v
        most = max(most, v)
    return total


# ---- readers


class Reader:
    """One pass over a text by a table of (pattern, what to say for its match)."""

    def __init__(self, *forms: tuple[str, Callable[[re.Match], str] | str]) -> None:
        self.forms = [(re.compile(p), say) for p, say in forms]
        self.any = re.compile("|".join(f"(?P<f{i}>{re.sub(r'[(](?![?])', '(?:', p)})" for i, (p, _) in enumerate(forms)))

    def __call__(self, text: str) -> str:
        def say(m: re.Match) -> str:
            pattern, what = self.forms[int(m.lastgroup[1:])]
            own = pattern.match(m.string, m.start())
            return own.expand(what) if isinstance(what, str) else what(own)

        return self.any.sub(say, text)


def pauses(text: str) -> str:
    """Dashes read as commas, runs of dots as one ellipsis; single spaces, no comma twice or before an end mark, none at the start."""
    for pattern, what in (
        (r"\s*—+\s*", ", "),
        (r"…+|\.{3,}", "…"),
        (r"\s+", " "),
        (r"([,、])\s*[,、]+", r"\1"),
        (r",\s*([.!?…])", r"\1"),
        (r"\A[,\s]+|\s+\Z", ""),
    ):
        text = re.sub(pattern, what, text)
    return text


#: Abbreviations and how they are read, and the months.
SPOKEN = {"Mr.": "Mister", "Mrs.": "Missus", "Messrs.": "Messieurs", "Dr.": "Doctor", "Capt.": "Captain", "Col.": "Colonel", "Gen.": "General", "Prof.": "Professor", "Rev.": "Reverend", "Lt.": "Lieutenant", "Sgt.": "Sergeant", "&c.": "et cetera", "etc.": "et cetera", "i.e.": "that is", "e.g.": "for example", "vs.": "versus"}
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
#: Counters that take native Korean numbers, words that begin like one and take none, and the letters' names.
COUNTERS = "시간|시|개|명|살|마리|권|잔|사람|달|척|채|군데|가지|벌|켤레|송이|그루|자루|통|쌍|줄|걸음|바퀴|판|모금|방울|발짝|발|차례|배|끼|해|곳|분들|놈|병|접시|숟가락|번째|번|장|대|살배기"
NO_COUNTERS = "번[가지호]|시[대절]|장면"
LETTERS_KO = dict(zip("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "에이 비 시 디 이 에프 지 에이치 아이 제이 케이 엘 엠 엔 오 피 큐 아르 에스 티 유 브이 더블유 엑스 와이 제트".split(), strict=True))
UNSEEN = re.compile("[​­]")
WHOLE = r"\d{1,3}(?:,\d{3})+(?!\d)|\d{1,12}"


def _whole(digits: str) -> int:
    return int(digits.replace(",", ""))


def _decimals(digits: str, names) -> str:
    return " ".join(names[int(d)] for d in digits)


def _money(one: str) -> Callable[[re.Match], str]:
    return lambda m: f"{english(_whole(m[1]))} {one}" + ("" if m[1] == "1" else "s")


ENGLISH = Reader(
    *((rf"(?<!\w){re.escape(a)}", b) for a, b in SPOKEN.items()),
    (r"\b([A-Z][a-z]+) St\.(?=\s+[A-Z])", r"\1 Street."),
    (r"\b([A-Z][a-z]+) St\.", r"\1 Street"),
    (r"\bSt\.(?=\s[A-Z])", "Saint"),
    (r"\bNo\.(?=\s?\d)", "number"),
    ("&", " and "),
    (r"£\s?(\d+)", _money("pound")),
    (r"\$\s?(\d+)", _money("dollar")),
    (rf"\b({MONTHS}) (\d{{1,2}})\b", lambda m: f"{m[1]} {english_ordinal(int(m[2]))}"),
    (r"\b(\d+)(?:st|nd|rd|th)\b", lambda m: english_ordinal(int(m[1]))),
    (r"\b(1\d{3})\b(?!,\d)", lambda m: english_year(int(m[1]))),
    (rf"\b({WHOLE})(?:\.(\d+))?\b", lambda m: english(_whole(m[1])) + (f" point {_decimals(m[2], ONES)}" if m[2] else "")),
    (r"\b(CHAPTER|Chapter|BOOK|Book|PART|Part|Section|SECTION)\s+([IVXLC]+)\b", lambda m: f"{m[1]} {english(roman(m[2]))}"),
    (r"\A([IVXLC]+)\.(?=\s|\Z)", lambda m: english(roman(m[1])) + "."),
)


def _counted(m: re.Match) -> str:
    n = _whole(m[1])
    if m[3] == "번째":
        return ("첫" if n == 1 else native(n)) + m[2] + m[3]
    return native(n) + " " + m[3] if n < 100 else sino(n) + m[2] + m[3]


def _numeral_ko(m: re.Match) -> str:
    return sino(roman(m[1])) if roman(m[1]) <= 20 else m[0]


KOREAN = Reader(
    (r"(\d{1,12})(?=\s?[천백십만억조])", lambda m: "" if m[1] == "1" else sino(int(m[1]))),
    (r"(\d{1,12})\s?%", lambda m: sino(int(m[1])) + " 퍼센트"),
    (r"(\d{1,2}):(\d{2})", lambda m: f"{native(int(m[1]))} 시 " + (f"{sino(int(m[2]))} 분" if int(m[2]) else "")),
    (rf"제\s?({WHOLE})(\s?)", lambda m: "제" + sino(_whole(m[1])) + m[2]),
    (rf"({WHOLE})\.(\d+)", lambda m: sino(_whole(m[1])) + " 점 " + "".join(SINO_ONES[int(d)] for d in m[2])),
    (rf"({WHOLE})(\s?)(?!{NO_COUNTERS})({COUNTERS})", _counted),
    (rf"({WHOLE})", lambda m: sino(_whole(m[1]))),
    (r"\b([A-Z])\.(?=\s?[A-Z가-힣\d])", lambda m: LETTERS_KO[m[1]] + " "),
    (r"\b([IVX]{2,5})\b(?=[.\s])", _numeral_ko),
    (r"\b([A-Z])\b", lambda m: LETTERS_KO[m[1]]),
    ("&", " 앤드 "),
)
JAPANESE = Reader(("―+|─+", "、"), ("[〔〕［］]", ""))


def spoken_en(text: str) -> str:
    """English text as it is read: abbreviations, money, dates, years, numbers and numerals in words."""
    return pauses(ENGLISH(UNSEEN.sub("", text)))


def spoken_ko(text: str) -> str:
    """Korean text as it is read: numbers with their counters, times, per cent, letters."""
    return pauses(KOREAN(UNSEEN.sub("", text)))


def spoken_ja(text: str) -> str:
    """Japanese text as it is read: doubled dashes to commas, editors' brackets gone."""
    return pauses(JAPANESE(UNSEEN.sub("", text)))


# ---- fragments

#: Marks that end a sentence, closing marks that stay with it, abbreviations that end in a full stop, and by language the longest and shortest fragment.
ENDS = {"ja": "。！？!?", "": ".!?…。！？"}
CLOSERS = "”’\"'」』）)]"
SHORT_FORMS = "Mr Mrs Ms Dr St Mt Messrs Capt Col Gen Prof Rev Lt Sgt No vs etc Jr Sr Co".split()
SIZES = {"en": (260, 18), "": (110, 8)}
BREAKS = ",，、;:—"
END_RUN = {k: re.compile(f"[{v}][{v}{re.escape(CLOSERS)}]*" + ("" if k == "ja" else r"(?=\s|\Z)")) for k, v in ENDS.items()}
ABBREVIATED = {"en": re.compile(rf"\b(?:{'|'.join(SHORT_FORMS)}|[A-Z])\.\Z"), "": re.compile(r"\b[A-Z]\.\Z")}
LETTERED = re.compile(r"\w")


@cache
def _cutter(most: int) -> re.Pattern:
    """The longest stretch of over 45 % of most characters that ends at a break, else at a space."""
    size = f".{{{int(most * 0.45) + 1},{most}}}"
    return re.compile(rf"(?s){size}(?<=[{BREAKS}])(?!\w)|{size}(?=\s)")


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    return a + len(text[a:b]) - len(text[a:b].lstrip()), b


def _joined(spans: list[tuple[int, int]], onto: Callable[[tuple[int, int], tuple[int, int]], bool]) -> list[tuple[int, int]]:
    """Neighbours put together where onto(what there is so far, the next) holds."""
    out: list[tuple[int, int]] = []
    for s in spans:
        if out and onto(out[-1], s):
            out[-1] = (out[-1][0], s[1])
        else:
            out.append(s)
    return out


def fragments(text: str, lang: str | None = "en") -> list[tuple[int, int]]:
    """Fragments for speech as (start, end): sentences with their closing marks, short ones joined to the next, those without a letter to the one before, long ones divided."""
    own = "ja" if lang == "ja" else ""
    most, least = SIZES["en" if lang == "en" else ""]
    short = ABBREVIATED["en" if lang == "en" else ""]
    # the first mark of a run may belong to an abbreviation; a further mark ends the sentence all the same
    ends = [m.end() for m in END_RUN[own].finditer(text) if sum(c in ENDS[own] for c in m[0]) > 1 or not short.search(text[max(0, m.start() - 8) : m.start() + 1])]
    borders = [0, *ends, *([len(text)] if not ends or ends[-1] < len(text) else [])]
    spans = [s for s in (_trimmed(text, a, b) for a, b in zip(borders, borders[1:], strict=False)) if s[0] < s[1]]
    spans = _joined(spans, lambda x, y: x[1] - x[0] < least and y[1] - x[0] <= most)
    spans = _joined(spans, lambda _, y: not LETTERED.search(text, *y))
    out = []
    for a, b in spans:
        while b - a > most and (m := _cutter(most).match(text, a)):
            out.append((a, m.end()))
            a, b = _trimmed(text, m.end(), b)
        out.append((a, b))
    return out


# ---- transcripts and models


def speech_key(text: str, lang: str | None = "en") -> str:
    """Text as transcripts are compared: compatibility forms, lower case, no marks; spaces stay in English, katakana reads as hiragana."""
    t = unicodedata.normalize("NFKC", text).lower()
    if lang == "en":
        return " ".join(re.sub(r"[^\w\s]|_", "", t).split())
    t = re.sub(r"[\W_]+", "", t)
    return re.sub("[ァ-ヶ]", lambda m: chr(ord(m[0]) - 0x60), t) if lang == "ja" else t


#: Marks that a speech model doesn't know, and those that may end its input.
MODEL_MARKS = str.maketrans({"“": '"', "”": '"', "‘": "'", "’": "'", "–": "-", "—": "-", "…": "..."})
MODEL_ENDS = ".!?,;:。！？」』)\"'"


def model_input(text: str, lang: str | None = "en") -> str:
    """Text for a speech model: decomposed, marks mapped, a full stop at the end, the language before and after."""
    t = " ".join(unicodedata.normalize("NFKD", text).translate(MODEL_MARKS).split())
    if t and t[-1] not in MODEL_ENDS:
        t += "."
    return f"<{lang}>{t}</{lang}>"
