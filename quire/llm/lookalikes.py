"""Look-alike classes of strings and code points, and the rewriting of text to one form (problem 6).

Classes are the transitive closure (union-find) of pairs that look the same: wide and narrow forms,
ligatures, composed letters and their decomposed strings, spaces, invisible characters (with the empty
string) and the letters that Latin, Greek and Cyrillic share, as well as kanji that look like katakana.
The member most frequent in the corpus stands for its class. Rewriting walks the text with a
multi-pattern automaton, leftmost and longest first; letters of shared shape change only inside words
of another script, and marks that Japanese and Chinese print wide stay in such text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

import ahocorasick

#: Letters of the same shape, Latin | Greek | Cyrillic, "." where there is none.
SHAPES = (
    "AΑА BΒВ C.С EΕЕ HΗН IΙІ J.Ј KΚК MΜМ NΝ. OΟО PΡР S.Ѕ TΤТ XΧХ YΥУ ZΖ. a.а c.с e.е i.і j.ј oοо p.р s.ѕ vν. x.х y.у d.ԁ h.һ q.ԛ w.ԝ"
).split()
#: Katakana and the kanji of the same shape.
KANA = "ロ口 ト卜 エ工 ニ二 ミ三 ハ八 カ力 タ夕 チ千 オ才 ー一".split()
INVISIBLE = "­᠎​‌‍‎‏⁠⁡⁢⁣⁤﻿؜"
LATIN, GREEK, CYRILLIC = "Latin", "Greek", "Cyrillic"
WORD = re.compile(r"[A-Za-zÀ-ɏͰ-Ͽἀ-῿Ѐ-ԯ]+")
KATA = re.compile(r"[ァ-ヺー]")
HAN = re.compile(r"[一-鿿々]")
HEAD = re.compile(r"(?:第\s*[0-9一二三四五六七八九十百]+\s*[章話回節部巻編]|[0-9一二三四五六七八九十百]+[、.]?)$")
SENTENCE_SIDE = re.compile(r"[。.!?！？．\n]")


def script_of(c: str) -> str:
    o = ord(c)
    return GREEK if 0x370 <= o <= 0x3FF or 0x1F00 <= o <= 0x1FFF else CYRILLIC if 0x400 <= o <= 0x52F else LATIN


class Classes:
    """Union-find over strings with a count for each; find() gives the root, members() the classes."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def union(self, a: str, b: str) -> None:
        ra, rb = self.find(a), self.find(b)
        if ra != rb:
            self.parent[max(ra, rb)] = min(ra, rb)

    def members(self) -> list[list[str]]:
        by: dict[str, list[str]] = {}
        for x in self.parent:
            by.setdefault(self.find(x), []).append(x)
        return [sorted(v) for v in by.values()]


def same_looking(c: str) -> str | None:
    """The string of plain characters that a single character looks like, or None."""
    if c in INVISIBLE:
        return ""
    if c != " " and unicodedata.category(c) == "Zs":
        return " "
    how = unicodedata.decomposition(c)
    if not how:
        return None
    kind, nfkc = how.split(" ", 1)[0], unicodedata.normalize("NFKC", c)
    if kind in ("<wide>", "<narrow>", "<font>", "<noBreak>") or (kind == "<compat>" and ("LIGATURE" in unicodedata.name(c, "") or 0x2160 <= ord(c) <= 0x217F)):
        return nfkc
    return None


def build(counts: dict[str, int]) -> dict[str, list[str]]:
    """Classes of the strings counted in the corpus: representative -> other members. Ties go to the lower string."""
    u = Classes()
    for x in counts:
        if len(x) == 1:
            y = same_looking(x)
            if y is not None:
                u.union(x, y)
            nfd = unicodedata.normalize("NFD", x)
            if nfd != x and len(nfd) > 1 and x.isalpha():
                u.union(x, nfd)
        else:
            u.union(x, unicodedata.normalize("NFC", x))
    for s in SHAPES:
        for x in s[1:]:
            if x != ".":
                u.union(s[0], x)
    for k, h in KANA:
        u.union(k, h)
    out = {}
    for m in u.members():
        if len(m) > 1:
            plain = [x for x in m if x == "" or unicodedata.normalize("NFKC", x) == x and not unicodedata.category(x[0]).startswith("M")]
            best = "" if "" in m else max(sorted(plain or m), key=lambda x: (counts.get(x, 0), x.isascii()))
            out[best] = [x for x in m if x != best]
    return out


class Rewriter:
    """Rewrites texts by the classes. ``rewrite`` returns the text itself if nothing changes."""

    def __init__(self, classes: dict[str, list[str]]) -> None:
        self.to: dict[str, str] = {}
        self.latin: dict[str, str] = {}
        self.by_script: dict[tuple[str, str], str] = {}
        shared = {x for s in SHAPES for x in s if x != "."}
        kanji = {k[1]: k[0] for k in KANA}
        for rep, others in classes.items():
            every = [rep, *others]
            letters = [x for x in every if x in shared]
            for a in letters:
                for b in letters:
                    self.by_script[a, script_of(b)] = b
            base = next((x for x in letters if script_of(x) == LATIN), rep)
            for x in every:
                if x in shared or x in kanji or x in kanji.values() or not x:
                    continue
                if x != rep or letters:
                    self.to[x] = base if letters else rep
        self.kanji = kanji
        for x in (INVISIBLE + "　"):
            self.to.setdefault(x, "" if x in INVISIBLE else " ")
        self.to = {a: b for a, b in self.to.items() if a != b}
        self.auto = ahocorasick.Automaton()
        for a, b in self.to.items():
            self.auto.add_word(a, (a, b))
        self.auto.make_automaton()
        first = {a[0] if len(a) == 1 else a[1] for a in self.to}
        odd = "".join(re.escape(x) for x in sorted(first))
        self.any = re.compile(f"[{odd}Ͱ-ԯ̀-゙゚ͯᄀ-ᇿ" + "".join(kanji) + "]")

    def rewrite(self, text: str) -> str:
        if not text or not self.any.search(text):
            return text
        # combining marks and jamo of any combination that the corpus counts did not hold
        edits: list[tuple[int, int, str]] = []
        end = -1
        best: tuple[int, int, str] | None = None
        for e, (a, b) in self.auto.iter(text):
            s = e - len(a) + 1
            if best and s >= best[1]:
                edits.append(best)
                end, best = best[1], None
            if s < end:
                continue
            if best is None or s < best[0] or (s == best[0] and e + 1 > best[1]):
                best = (s, e + 1, b)
        if best:
            edits.append(best)
        edits = [x for x in edits if self._stands(text, *x)]
        edits += self._letters(text)
        edits += self._kana(text)
        if edits:
            edits.sort()
            out, last = [], 0
            for s, e, b in edits:
                if s >= last:
                    out.append(text[last:s])
                    out.append(b)
                    last = e
            out.append(text[last:])
            text = "".join(out)
        return unicodedata.normalize("NFC", text) if COMBINING.search(text) else text

    def _stands(self, text: str, s: int, e: int, b: str) -> bool:
        """Does the match stand for another character here, or is it the text's own wide mark or space?"""
        c = text[s]
        if c in "　" and e == s + 1:
            line = text[text.rfind("\n", 0, s) + 1 : s]
            nxt = text[e : e + 1]
            asian = _asian(text, s, e)
            return not (asian and (not line.strip("　 ") or HEAD.search(line.strip()))) and bool(text.strip()) and (nxt != "" or not asian)
        if unicodedata.east_asian_width(c) == "F" and not c.isalnum():
            return not _asian(text, s, e)
        return True

    def _letters(self, text: str) -> list[tuple[int, int, str]]:
        out = []
        for m in WORD.finditer(text):
            w = m.group()
            if w.isascii():
                continue
            scripts = [script_of(c) for c in w]
            kinds = set(scripts)
            if len(kinds) == 1:
                own = scripts[0]
                if own == LATIN or len(w) > 1 or not self._alone(text, m.start(), m.end(), own):
                    continue
                main = LATIN
            else:
                main = max((LATIN, CYRILLIC, GREEK), key=lambda k: sum(x == k and (c, LATIN if k != LATIN else GREEK) not in self.by_script for c, x in zip(w, scripts)) * 100 + scripts.count(k))
            for i, (c, x) in enumerate(zip(w, scripts, strict=True)):
                if x != main:
                    b = self.by_script.get((c, main))
                    if b:
                        out.append((m.start() + i, m.start() + i + 1, b))
        return out

    def _alone(self, text: str, s: int, e: int, own: str) -> bool:
        """A single letter that looks Latin among words of other scripts."""
        if (text[s], LATIN) not in self.by_script:
            return False
        around = WORD.findall(text[max(0, s - 16) : s]) + WORD.findall(text[e : e + 16])
        return not any(script_of(w[0]) == own and (len(w) > 1 or (w[0], LATIN) not in self.by_script) for w in around) and (text[s].isupper() or text[e : e + 1] == ".")

    def _kana(self, text: str) -> list[tuple[int, int, str]]:
        out = []
        for i, c in enumerate(text):
            k = self.kanji.get(c)
            if k:
                a, b = text[i - 1 : i], text[i + 1 : i + 2]
                left, right = bool(KATA.match(a)), bool(KATA.match(b))
                if left and right or (c in "口卜工" and (right and not (HAN.match(a) or "ぁ" <= a <= "ん" and a in "のがお") or left and b and not HAN.match(b) and not "ぁ" <= b <= "ん")):
                    out.append((i, i + 1, k))
        return out


COMBINING = re.compile("[̀-゙゚ͯᄀ-ᇿ]")


def _asian(text: str, s: int, e: int) -> bool:
    """Is the sentence around these offsets Japanese or Chinese? Judged by the letters nearest to them."""
    left = text[max(0, s - 40) : s]
    right = text[e : e + 40]
    for piece in (reversed(left), right):
        latin = 0
        for c in piece:
            if "가" <= c <= "힣" or "ᄀ" <= c <= "ᇿ":
                return False
            if "ぁ" <= c <= "ヿ" or "一" <= c <= "鿿" or c in "々":
                return True
            if c.isalpha():
                latin += 1
                if latin > 24:
                    break
    return False


def counted(texts: Iterable[str], at_once: int = 1_000_000) -> dict[str, int]:
    """Counts of the code points of texts, and of their base letters with combining marks or joined jamo; about at_once characters are held at a time."""
    out: dict[str, int] = {}
    held: list[str] = []
    size = 0
    for t in texts:
        held.append(t)
        size += len(t) + 1
        if size >= at_once:
            _count_into(out, "\n".join(held))
            held, size = [], 0
    _count_into(out, "\n".join(held))
    return out


def _count_into(out: dict[str, int], joined: str) -> None:
    import numpy as np

    if not joined:
        return
    codes, n = np.unique(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)
    for c, k in zip(codes, n, strict=True):
        if not 0xD800 <= c <= 0xDFFF:
            out[chr(c)] = out.get(chr(c), 0) + int(k)
    for m in SEQUENCE.finditer(joined):
        out[m.group()] = out.get(m.group(), 0) + 1


#: What is counted besides single code points; a letter with more than three marks is composed without a count, which bounds the counts by the character set.
SEQUENCE = re.compile("[ᄀ-ᄒ][ᅡ-ᅵ][ᆨ-ᇂ]?|[^\\W\\d_][̀-゙゚ͯ]{1,3}")
