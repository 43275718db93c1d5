"""Sentence units of English, Korean, Japanese and stray other texts (problem 1).

``segment(text)`` gives code point offsets into the stored text. Spaced scripts: the terminators
of a paragraph are the nodes of a lattice; the marks around them, abbreviations, the word before
and the word after decide each arc, and quotations and brackets are tracked on a stack. Scripts
without spaces: the words beside a gap come from a word lattice (:mod:`.words`) and the gap is
classified by final particles on its left and opening or continuing words on its right.

Null and blank texts, and texts without a letter or digit outside tags, have no unit.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from .words import continues, ends

OPEN, CLOSE = "“‘«「『（([【《〈„‚", "”’»」』）)]】》〉”’"
PAIR = dict(zip(OPEN, CLOSE, strict=True))
QUOTES = set("”’»」』》〉\"")
C = r"[”’»」』）)\]】》〉\"']|</\w+>"
#: What stands before a token is run over first, with those marks that begin none: dashes that close nothing, apostrophes, points of numbers, kana
#: without a gap. Every other mark begins a token, so nothing is read twice.
BETWEEN = (
    r"(?:[^.!?…。！？｡‥—―–\-“‘«「『（(\[【《〈„”»」』）)\]】》〉’\"ぁ-ヿ]++|[—―–-]++(?![”’」』])|’(?=\w)|\.(?=[0-9A-Za-z])|[ぁ-ヿ](?![　 ]+[ぁ-ヿ一-鿿]))*+"
)
TOKEN = re.compile(
    BETWEEN + r"(?:"
    rf"(?P<term>(?:[!?…。！？｡‥]|\.(?![0-9A-Za-z]))[.!?…。！？｡‥]*(?P<close>(?:(?:{C})[!?…。！？]*)*))"
    r"|(?P<dash>[—―–-]+(?P<dclose>[”’」』]))"
    r"|(?P<open>[“‘«「『（(\[【《〈„])"
    r"|(?P<shut>[”»」』）)\]】》〉]|’(?!\w))"
    r"|(?P<straight>\")|(?P<gap>[ぁ-ヿ][　 ]+(?=[ぁ-ヿ一-鿿]))|\Z)"
)
PARAGRAPH = re.compile(r"\n[^\S\n]*\n\s*")
TAG = re.compile(r"</?[A-Za-z][^<>]*>")
ANY = re.compile(r"[^\W_]")
#: Abbreviations that stand before a name or number, and those that may also end a sentence.
BEFORE = set("mr mrs ms dr capt st messrs prof rev col gen lt sgt hon sr jr no nos vol vols p pp ch fig vs cf ca al esp i.e e.g s.s viz mme mlle".split())
MAY_END = set("etc ltd co inc lb lbs oz ft in f ff a.m p.m b.c a.d u.s".split())
TITLES = {" St", " Mr", " Dr", "Mrs"}
OPENER = set(
    "the a an in on at he she it they we you i there this that these those when while after before as for from to with without but and then "
    "so if no not nobody every all what who where why how one two his her their my our its long half much toward once by of".split()
)
REPORT_EN = "said asked cried answered murmured replied whispered exclaimed shouted remarked muttered added returned observed inquired continued called".split()
SAID_EN = re.compile(
    r"(?:(?:Mrs?|Ms|Dr|Capt|St|Prof|Rev|[^\W\d_])\.\s+|Miss\s+)*(?:[^\W\d_][\w’'-]*\s+){1,3}(?:" + "|".join(REPORT_EN) + r")\b(?=\s*(?:[.;:!?]|,(?!\s*[“‘\"])|$|\w+ly\b))",
    re.IGNORECASE,
)
FIRST_SAID = re.compile(r"(?:" + "|".join(REPORT_EN) + r")\b", re.IGNORECASE)
SAID_KO = re.compile(
    r"(?:[^\s.!?。“”‘’,]+\s+|(?:[A-Za-z]{1,3}\.\s*)){0,6}?[^\s.!?“”‘’]*(?:이|가|은|는|도|께서)\s+(?:[^\s.!?“”‘’를을]+(?:게|로|며|고|서|히|이)\s+)?"
    r"(?:말했|물었|외쳤|중얼거렸|대답했|소리쳤|속삭였|덧붙였|되물었|답했|투덜거렸|내뱉었|말하였|외치|말하|묻)[^\s.!?,]{0,6}(?=[.!?]|,(?!\s*[“‘「\"])|$)"
)
OBJECT_KO = re.compile(r"(?:에게|에게서|한테|관해|대해|까지|에서|부터|을|를)\s")
GOES_ON_KO = re.compile(r"(?:하고|라고|이라고|라며|하며|하는|라는|이라는|하면서|라면서|고)(?:\s|$)")
FINAL_KO = set("다요까네지라게군소오자세데냐니나야어아해여걸죠든만")
LINK = set("and or but nor yet")
WORD_BEFORE = re.compile(r"([^\s“”‘’«»「」『』（）()\[\]<>\"—―–,;:]+)$")
_NUMBER_WORD = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty first second third fourth fifth sixth seventh eighth ninth tenth last".replace(" ", "|")
NUMBER_WORDS = frozenset(_NUMBER_WORD.split("|"))
HEADING_NUMBER = re.compile(
    rf"(?:(?:chapter|book|part|volume|section|scene|act|letter|canto)\s+(?:the\s+)?(?:[ivxlcdm]+|\d{{1,4}}|{_NUMBER_WORD})|제\s?\d+\s?[장화부권]|第[0-9一二三四五六七八九十百]+[章話回部]|(?-i:[IVXLCDM]+|[A-Z])|\d{{1,4}})",
    re.IGNORECASE,
)
HEADING_START = {"chap", "book", "part", "volu", "sect", "scen", "act ", "lett", "cant"}
ODD = re.compile("[ᄀ-ᇿ̀-゙゚ͯﬀ-ﬆ​-‏⁠-⁤﻿­︎️᠎０-９Ａ-Ｚａ-ｚ．]")
#: An added label before a text.
LABEL = re.compile(r"[^\s:.]{1,12}(?: [^\s:.]{1,12})?:")
HANGUL = re.compile(r"[가-힣]")
IS_CJK = re.compile(r"[ぁ-ヿ㐀-鿿]")


def plain(text: str) -> tuple[str, list[int] | None]:
    """The text with composed letters and without invisible characters, and for each of its characters the stored offset (None: the same)."""
    if not ODD.search(text):
        return text, None
    out, at, i, n = [], [], 0, len(text)
    while i < n:
        j = i + 1
        while j < n and (unicodedata.combining(text[j]) or "\u1160" <= text[j] <= "\u11ff"):
            j += 1
        s = unicodedata.normalize("NFC", text[i:j])
        if j == i + 1 and ("\uff10" <= s <= "\uff5a" or s == "\uff0e" or "\ufb00" <= s <= "\ufb06"):
            s = unicodedata.normalize("NFKC", s)
        if not (len(s) == 1 and unicodedata.category(s) == "Cf"):
            out.append(s)
            at.extend([i] * len(s))
        i = j
    at.append(n)
    return "".join(out), at


def _cut_dot(p: str, s: int, nxt: str, start: int, loud: bool) -> bool:
    """Whether the full stop at s, followed by white space and nxt, ends a sentence of a spaced script."""
    m = WORD_BEFORE.search(p, max(start, s - 24), s)
    w = m.group(1) if m else ""
    low, c = w.lower(), nxt[:1]
    if not w:
        return True
    if s - start < 28 and HEADING_NUMBER.fullmatch(p[start:s].strip(" \n([")):
        return False
    if w[-1].isdigit():
        return not (c.isdigit() or c.islower() or HANGUL.match(c)) and not (loud and low in BEFORE)
    if (len(w) == 1 and w.isalpha() and w.isascii()) or low in BEFORE:
        return low in ("i",) and nxt.split(" ", 1)[0].lower() in OPENER and not HEADING_NUMBER.fullmatch(p[start:s].strip())
    if low in MAY_END:
        first = re.match(r"[“‘(]*([^\W\d_]+)", nxt)
        if c.islower() or not first:
            return not c.islower() and not c.isdigit() and low in ("p.m", "a.m", "etc")
        if loud:
            return first.group(1).lower() in OPENER and low in ("p.m", "a.m") and first.group(1).lower() not in ("in", "on", "and", "to", "by", "of")
        return low in ("p.m", "a.m", "etc") or first.group(1).lower() in OPENER
    return not c.islower()


#: What the five characters before a full stop tell: that _cut_dot() has to say, a small word that is no abbreviation, a title or initial that ends no sentence.
ASK, PLAIN, TITLE = range(3)


@lru_cache(maxsize=1 << 14)
def _before_dot(tail: str) -> int:
    """PLAIN: its last four characters end in a small word that is no abbreviation, and one of two or three letters is no number of a heading either."""
    _, space, w = tail.rpartition(" ")
    if space and w.isascii() and w.isalpha() and w not in "iI" and (len(w) == 1 or w.lower() in BEFORE):
        return TITLE
    tail = tail[-4:]
    if not tail.islower():
        return ASK
    if tail.isalpha():
        return ASK if tail == "ssrs" else PLAIN
    w = tail.rpartition(" ")[2]
    return PLAIN if 2 <= len(w) <= 3 and w.isascii() and w.isalpha() and w not in BEFORE and w not in MAY_END and w not in NUMBER_WORDS and bool(w.strip("ivxlcdm")) else ASK


def _paragraph(p: str, base: int, out: list[tuple[int, int]]) -> None:
    """Units of one paragraph, appended with base added. Positions are of p."""
    n, start, stack = len(p), 0, []
    loud = None
    unclosed: set[str] = set()
    for m in TOKEN.finditer(p):
        e = m.end()
        if e == n:
            break  # what comes last ends the paragraph whatever it is
        kind = m.lastgroup
        s = m.start(kind)
        if kind == "term" and e == s + 1:
            mark, c = p[s], p[e]
            if mark == ".":
                if c == " ":
                    before = _before_dot(p[s - 5 : s] if s > 4 else " " + p[:s])
                    if before == TITLE:
                        continue
                    if not stack and s > 3:
                        # the plain case: a full stop after a Korean word or a longer lower-case one, then white space and no small letter
                        c = p[e + 1 : e + 2]
                        if c and (before == PLAIN or "가" <= p[s - 1] <= "힣") and (start or p[:4].lower() not in HEADING_START) and ("가" <= c <= "힣" or "A" <= c <= "Z" or c == "“"):
                            out.append((base + start, base + e))
                            start = e
                            continue
                if not stack and s > 3 and p[s - 3 : s] in TITLES:
                    continue
            elif mark in "。！？｡" and not stack and not c.isspace() and c not in "<—―–-,;:、，)）]」』”’":
                # a mark of scripts without spaces, and the next sentence right behind it
                out.append((base + start, base + e))
                start = e
                continue
        elif kind == "term" and e == s + 2 and p[e - 1] == "”" and stack and stack[-1][0] == "”" and p[e : e + 1] == " " and p[e + 1 : e + 2].islower():
            # a quotation followed by the clause that reports it
            del stack[-1]
            continue
        if kind == "open":
            c = p[s]
            shut = PAIR[c]
            head = p[start:s].strip() if s - start < 400 else "far"
            if c not in "“‘「『«" and shut not in unclosed and p.find(shut, e) < 0:
                unclosed.add(shut)
            if shut not in unclosed and len(stack) < 64:
                stack.append((shut, not head or not (head[0].isalnum() or ANY.search(TAG.sub("", head))) or bool(LABEL.fullmatch(head)), s))
            continue
        if kind == "straight":
            if stack and any(x[0] == '"' for x in stack):
                kind = "shut"
            else:
                head = p[start:s].strip() if s - start < 400 else "far"
                stack.append(('"', not head, s))
                continue
        if kind == "gap":
            if not stack and ends(p[max(start, s - 11) : s + 1]) and not continues(p[e : e + 12]):
                out.append((base + start, base + s + 1))
                start = e
            continue
        popped = None
        if kind == "shut":
            closers = p[s]
        else:
            closers = m.group("close") if kind in ("term", "close") else m.group("dclose")
        for c in closers or "":
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == c:
                    popped = stack[k]
                    del stack[k:]
                    break
        rest = p[e : e + 80]
        nxt = rest.lstrip()
        if not nxt:
            continue
        spaced = len(nxt) != len(rest)
        c = nxt[0]
        if c == "<":
            t = TAG.match(nxt)
            if t:
                nxt = nxt[t.end() :].lstrip()
                c = nxt[:1]
                if not nxt:
                    continue
        # an open bracket, or a quotation that began inside a sentence and holds but one sentence, keeps the unit open
        if stack and any(x[0] in "）)]】" and not x[1] for x in stack):
            continue
        cjk = not spaced and ("ぁ" <= c <= "ヿ" or "㐀" <= c <= "鿿")
        if popped:
            bracket = popped[0] in "）)]】"
            if bracket:
                if not popped[1] or kind == "shut":
                    continue
                if not spaced and p[e - 1] not in "）】" and not IS_CJK.match(c):
                    continue
            elif kind == "shut":
                # a quotation closed without a terminator: only in scripts without spaces can a unit end here
                before = p[s - 1 : s]
                if popped[0] not in "」』" or spaced or before in "、,":
                    continue
                if not popped[1] and not p[popped[2] - 1 : popped[2]] in "、,":
                    continue
                if continues(nxt) or not ends(p[max(start, s - 12) : s]) or c in "、。,.！？」』":
                    continue
            elif popped[0] in "」』":
                if c in "、，,。)）」』" or continues(nxt):
                    continue
            else:
                if not spaced and c not in OPEN:
                    continue
                if c.islower() or c in ",;:—–":
                    continue
                if kind == "dash" and not spaced:
                    continue
                if "가" <= c <= "힣" or (c.isupper() and HANGUL.search(nxt)):
                    if GOES_ON_KO.match(nxt):
                        continue
                    r = SAID_KO.match(nxt) if popped[1] else None
                    if r and not OBJECT_KO.search(r.group()):
                        continue
                if popped[1] and c.isalpha() and (FIRST_SAID.match(nxt) or SAID_EN.match(nxt)):
                    continue
        elif kind != "term" or m.group("close").strip("<>/abcdefghijklmnopqrstuvwxyz"):
            if kind != "term":
                continue
            if not spaced and not cjk:
                continue
            if c.islower():
                continue
        else:
            last = p[e - 1]
            if last == ">":
                last = m.group("term")[0]
            if c in "—―–-,;:、，)）]」』”’":
                continue
            if last == ".":
                dots = m.group("term").count(".")
                if dots == 1:
                    if not spaced:
                        if not (HANGUL.match(c) and HANGUL.match(p[s - 1 : s])) and c not in "“‘「『（" and not IS_CJK.match(c):
                            continue
                        if IS_CJK.match(c) and not IS_CJK.match(p[s - 1 : s]):
                            continue
                    if loud is None:
                        loud = p.isupper()
                    if not _cut_dot(p, s, nxt, start, loud):
                        continue
                else:
                    if c.islower() or not spaced or (HANGUL.match(p[s - 1 : s]) and p[s - 1] not in FINAL_KO):
                        continue
                    if loud is None:
                        loud = p.isupper()
                    if loud and nxt.split(" ", 1)[0].lower() in LINK:
                        continue
            elif last in "…‥":
                if c.islower():
                    continue
                b = p[s - 1 : s]
                if HANGUL.match(b):
                    if b not in FINAL_KO:
                        continue
                elif IS_CJK.match(b):
                    if not ends(p[max(start, s - 12) : s]) or continues(nxt):
                        continue
            elif last in "!?":
                if not spaced and not cjk and c not in OPEN and not HANGUL.match(c):
                    continue
                if c.islower():
                    continue
                if not stack and nxt[:2] in ("하고", "라고"):
                    continue
        out.append((base + start, base + e))
        start = e
    out.append((base + start, base + n))


def segment(text: str | None, composed: bool = False) -> list[tuple[int, int]]:
    """The sentence units of a text as (start, end) offsets of its code points, end exclusive, without surrounding white space.

    composed: the text has gone through plain() already.
    """
    if not text:
        return []
    p, at = (text, None) if composed else plain(text)
    raw: list[tuple[int, int]] = []
    last = 0
    if "\n" in p:
        for m in PARAGRAPH.finditer(p):
            if m.start() > last:
                _paragraph(p[last : m.start()], last, raw)
            last = m.end()
    _paragraph(p[last:] if last else p, last, raw)
    out = []
    tags = "<" in p
    for s, e in raw:
        if not tags and e - s > 2 and not p[e - 1].isspace():
            a = s + 1 if p[s] == " " else s
            c = p[a]
            if c.isalnum() or (p[a + 1].isalnum() and not c.isspace()):
                out.append((a, e))
                continue
        piece = p[s:e]
        t = piece.strip()
        if not t:
            continue
        if (tags or not (t[0].isalnum() or t[1:2].isalnum())) and not ANY.search(TAG.sub("", t) if tags else t):
            continue
        s += len(piece) - len(piece.lstrip())
        out.append((s, s + len(t)))
    if at is None:
        return out
    fixed = []
    for s, e in out:
        a, b = at[s], at[e]
        while b > a and text[b - 1].isspace():
            b -= 1
        while a < b and text[a].isspace():
            a += 1
        fixed.append((a, b))
    return fixed
