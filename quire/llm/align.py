"""Sentence alignment of a unit with its Korean text (problem 2).

Length-based dynamic programming: the cheapest path over beads, namely one to one, omissions on either side,
merges and splits, and two neighbours that change places. A bead costs the negative log of how likely the
lengths of its sides are (a normal deviate of the languages' ratio, after Gale and Church, or a
stray) and of how rare its kind is; shared numbers and words that a lexicon pairs lower it. All paths are
searched, of every row and whatever its length: rows of like size go through the table together, a row of it
at a time in numpy; of a table larger than CELLS only every so many rows are kept and the others are made
again on the way back. The lexicon and the length ratios are learned from all pairs whose sides have equally
many sentences. What no path of neighbours can express, sentences moved far or merged by the dozen, is looked
up afterwards: a sentence left over joins the one that holds most of its words.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Callable, Iterable
from itertools import chain, compress

import numpy as np

from .langs import HANGUL, mostly_korean, refuses
from .sentences import ODD, plain, segment
from .subjects import JOSA, TAGS

#: Words of scripts without spaces; those of other scripts are what stands between spaces and dashes, without the marks around it.
RUN = re.compile(r"[A-Za-zÀ-ɏ]+|[一-鿿々]+|[ァ-ヺー]+|[ぁ-ん]{2,}|\d+(?:[.,]\d+)*")
SPACELESS = re.compile("[ぁ-ヿ一-鿿]")
AROUND = "“”‘’\"'«»「」『』()（）[]<>.,;:!?…。！？、*_-–―·"
NUMBER = re.compile(r"\d+(?:[.,]\d+)*")
DIGIT = re.compile(r"\d")
#: What a unit must hold for its tags, digits, script or odd characters to be looked at.
SIGNS = re.compile(r"[<\dぁ-ヿ一-鿿" + ODD.pattern[1:])
#: Text of one sentence at sight, whatever the rules: no mark before its last.
SINGLE = re.compile(r"[^\s.!?…。！？“”‘’\"「」『』()（）<>\[\]—―–\-:][^.!?…。！？“”‘’\"「」『』()（）<>\[\]—―–:\n -‏]*[.!?。！？]")
PLAIN = frozenset("the a an and of to in on at by for from with was were is had has have that this it he she they as i you his her no not be been there".split())
#: Beads (source sentences, Korean sentences) and the cost of their kind; SWAP is that of two neighbours that change places.
BEADS = ((0, 1, 3.6), (1, 0, 3.2), (1, 1, 0.0), (1, 2, 1.8), (1, 3, 3.4), (2, 1, 1.6), (2, 2, 4.5), (3, 1, 2.6), (4, 1, 3.2))
ONE_TO_ONE = 2
SWAP, SWAP_FROM = 2.0, 0.6
#: Weight of the length term, and the negative log likelihood of a stray, the most that lengths can cost.
LENGTH, STRAY = 1.0, 5.0
#: Weight of the lexical likeness in a bead, and the likeness at which it counts neither for nor against.
LEXICAL, EVEN = 7.0, 0.25
#: Likeness that a pair of one, and of a larger bead, needs at least, and that a pair off the path needs.
LEAST, LEAST_MERGED, FAR = 0.10, 0.3, 0.5
#: Begins the keys of length sums; no word holds it.
LENGTHS = "="
#: Cells of a table that are held at once, and pairs of words.
CELLS, PRODUCTS = 2_000_000, 3_000_000
#: Words and characters that are looked up at once.
HELD = 200_000


def kind(sentence: str) -> str:
    return "j" if not sentence.isascii() and SPACELESS.search(sentence) else "e"


def words(sentence: str, spaceless: bool) -> list[str]:
    """Words with the marks around them, which bare() takes off."""
    if spaceless:
        return RUN.findall(sentence)
    return (sentence.replace("—", " ") if "—" in sentence else sentence).split()


def bare(word: str) -> str:
    return word.strip(AROUND)


class Known(dict):
    """Words and what find() says of each, which also keeps it here."""

    def __init__(self, find: Callable[[str], int]) -> None:
        self.find = find

    def __missing__(self, word: str) -> int:
        return self.find(word)


class Flat:
    """Words of many sentences one after the other, as numbers: those below nought are no words. A word's number is looked up when HELD words have come together."""

    def __init__(self) -> None:
        self.held: list[str] = []
        self.sizes: list[int] = []
        self.numbers: list[np.ndarray] = []

    def turn(self, known: Known) -> None:
        self.numbers.append(np.fromiter(map(known.__getitem__, self.held), np.int64, len(self.held)))
        self.held = []

    def distinct(self, known: Known) -> tuple[np.ndarray, np.ndarray]:
        """Sentence and number of every word, in order, each once a sentence."""
        self.turn(known)
        number = np.concatenate(self.numbers)
        sentence = np.repeat(np.arange(len(self.sizes)), self.sizes)
        return once(sentence[number >= 0], number[number >= 0])


def once(sentence: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair of sentence and number once, in order."""
    code = np.sort(sentence << 32 | number)
    code = code[np.flatnonzero(np.diff(code, prepend=-1))]
    return code >> 32, code & 0xFFFFFFFF


class Trie:
    """Finds words in sentences whose white space is left out, at all places of many sentences at once: one step of the trie an array."""

    #: Classes of characters that are in no word, and of white space.
    OTHER, SPACE = -1, -2

    def __init__(self, words: list[str]) -> None:
        chars = sorted(set("".join(words)))
        self.of = np.full(0x110000, self.OTHER, np.int32)
        self.of[list(map(ord, chars))] = np.arange(len(chars))
        self.of[[c for c in range(0x3001) if chr(c).isspace()]] = self.SPACE  # none is above
        self.chars = max(1, len(chars))
        place = {c: i for i, c in enumerate(chars)}
        steps: dict[tuple[int, int], int] = {}
        ends = [-1]
        for i, w in enumerate(words):
            at = 0
            for c in w:
                to = steps.setdefault((at, place[c]), len(ends))
                if to == len(ends):
                    ends.append(-1)
                at = to
            ends[at] = i
        self.ends = np.array(ends, np.int64)
        self.first = np.zeros(self.chars + 1, np.int64)  # the last is that of other characters
        for (at, c), to in steps.items():
            if not at:
                self.first[c] = to
        inner = sorted((at * self.chars + c, to) for (at, c), to in steps.items() if at)
        self.steps = np.array([k for k, _ in inner] or [-1], np.int64)
        self.to = np.array([to for _, to in inner] or [0], np.int64)

    def found(self, sentences: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Place of the sentence and of the word, for every occurrence."""
        # each sentence with a mark behind it, which is in no word
        kind = self.of[np.frombuffer("\n".join([*sentences, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)]
        sizes = np.fromiter(map(len, sentences), np.int64, len(sentences)) + 1
        kind[np.cumsum(sizes) - 1] = self.OTHER
        dense = kind != self.SPACE
        sentence = np.repeat(np.arange(len(sentences), dtype=np.int32), sizes)[dense]
        kind = kind[dense]
        state = self.first[kind]
        at = np.flatnonzero(state)
        state = state[at]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        behind = 0
        while len(at):
            word = self.ends[state]
            whole = np.flatnonzero(word >= 0)
            found.append((sentence[at[whole]], word[whole]))
            behind += 1
            c = kind[at + behind]  # a sentence's mark ends every word before the next one
            on = np.flatnonzero(c >= 0)
            want = state[on] * self.chars + c[on]
            step = np.minimum(np.searchsorted(self.steps, want), len(self.steps) - 1)
            hit = np.flatnonzero(self.steps[step] == want)
            at, state = at[on[hit]], self.to[step[hit]]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([x for x, _ in found]).astype(np.int64), np.concatenate([w for _, w in found])


# ---- lexicon


class Tally:
    """Counts what the lexicon needs of (source sentence, Korean sentence) pairs; out() gives (v, w, n) and empties it.

    (v, w) are pairs of words, (v, "") and ("", w) words of a side, (LENGTHS + kind, n, a, b or q) pairs, letters of either side and thousandths of the squares of b over a.
    """

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.id: dict[str, int] = {}
        self.names: list[str] = []
        self.raw = Known(self.number)
        self.left, self.right = Flat(), Flat()
        self.spaceless: list[bool] = []
        self.la: list[int] = []
        self.lb: list[int] = []
        self.size = 0

    def number(self, word: str) -> int:
        w = bare(word)
        c = w[:1]
        if "가" <= c <= "힣":
            w = JOSA.sub("", w) or w if len(w) > 1 else w
        elif not c.isdigit():
            w = w.lower()
        i = -1
        if w and w not in PLAIN:
            i = self.id.get(w, len(self.names))
            if i == len(self.names):
                self.id[w] = i
                self.names.append(w)
        self.raw[word] = i
        return i

    def add(self, a: str, b: str) -> None:
        spaceless = not a.isascii() and SPACELESS.search(a) is not None
        x, y = words(a, spaceless), words(b, SPACELESS.search(b) is not None)
        left, right = self.left, self.right
        left.held += x
        left.sizes.append(len(x))
        right.held += y
        right.sizes.append(len(y))
        if len(left.held) > HELD or len(right.held) > HELD:
            left.turn(self.raw)
            right.turn(self.raw)
        self.size += len(x) * len(y)
        self.spaceless.append(spaceless)
        self.la.append(len(a) or 1)
        self.lb.append(len(b) or 1)

    def full(self) -> bool:
        return self.size > PRODUCTS or len(self.raw) > PRODUCTS // 4

    def out(self) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, list[tuple[str, str, int]]]:
        """Names, then places in them of v and w (the last name is empty) with their counts, and the length sums as they are."""
        xs, x = self.left.distinct(self.raw)
        ys, y = self.right.distinct(self.raw)
        none = len(self.names)
        ny = np.bincount(ys, minlength=len(self.la))
        digit = np.array([w[0].isdigit() for w in self.names] or [False], bool)
        own = ~digit[x] if len(x) else np.zeros(0, bool)
        px, ps = x[own], xs[own]
        each = ny[ps]
        total = int(each.sum())
        # every source word with all words of the Korean sentence
        to = np.repeat((np.cumsum(ny) - ny)[ps] - (np.cumsum(each) - each), each) + np.arange(total)
        codes = np.repeat(px << 32, each) | y[to]
        pair, c = np.unique(codes, return_counts=True)
        one = np.bincount(x, minlength=none) if none else np.zeros(0, np.int64)
        two = np.bincount(y, minlength=none) if none else np.zeros(0, np.int64)
        i, j = np.flatnonzero(one), np.flatnonzero(two)
        v = np.concatenate([pair >> 32, i, np.full(len(j), none)])
        w = np.concatenate([pair & 0xFFFFFFFF, np.full(len(i), none), j])
        n = np.concatenate([c, one[i], two[j]])
        lengths: dict[tuple[str, str], int] = {}
        spaceless, la, lb = np.array(self.spaceless, bool), np.array(self.la, np.int64), np.array(self.lb, np.int64)
        for own, j in (("e", False), ("j", True)):
            a, b = la[spaceless == j], lb[spaceless == j]
            if not len(a):
                continue
            for name, x in (("n", np.ones_like(a)), ("a", a), ("b", b), ("q", b * b * 1000 // a)):
                lengths[LENGTHS + own, name] = int(x.sum())
        got = ([*self.names, ""], v, w, n, [(k, s, t) for (k, s), t in sorted(lengths.items())])
        self.clear()
        return got


class Lexicon:
    """partners: source word -> Korean words with strength; weight: source word -> how much it says; ratio and spread of lengths by script of the source.

    Words and partners are numbered; a number in digits, its own partner, has the numbers after the last.
    """

    def __init__(self, partners: dict[str, list[tuple[str, float]]], weight: dict[str, float], ratio: dict[str, tuple[float, float]]) -> None:
        self.partners, self.weight, self.ratio = partners, weight, ratio
        self.id = {w: i for i, w in enumerate(partners)}
        korean: dict[str, int] = {}
        self.of = np.array([korean.setdefault(k, len(korean)) for p in partners.values() for k, _ in p], np.int64)
        self.first = np.concatenate([[0], np.cumsum([len(p) for p in partners.values()], dtype=np.int64)]).astype(np.int64)
        self.says = np.array([weight.get(w, 1.0) for w in partners], np.float64)
        self.part = np.array([weight.get(w, 1.0) * s for w, p in partners.items() for _, s in p], np.float64)
        self.words, self.korean = len(partners), len(korean)
        #: words as they stand in texts, with the number of the word or -1; kept at hand
        self.seen = Known(self._see)
        self.trie = Trie(list(korean))

    def sources(self, rows: list[Row]) -> tuple[np.ndarray, np.ndarray]:
        """The known words of the source sentences of rows and the numbers in them: place of the sentence among all of the rows, and word, in order."""
        flat = Flat()
        sizes = flat.sizes
        for r in rows:
            held = flat.held
            for x in r.left:
                found = words(x, r.spaceless)
                held += found
                sizes.append(len(found))
            if len(held) > HELD:
                flat.turn(self.seen)
        return _with(flat.distinct(self.seen), [r.left_numbers for r in rows], [len(r.left) for r in rows], self.words)

    def founds(self, rows: list[Row]) -> tuple[np.ndarray, np.ndarray]:
        """The partners that the Korean sentences of rows hold, their spaces left out, and their numbers, each whole: as sources()."""
        sentences, numbers, held, size, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [], 0, 0
        for k, r in enumerate(rows, 1):
            held += r.right
            size += sum(r.lb)
            if size > HELD or k == len(rows):
                at, number = once(*self.trie.found(held))
                sentences.append(n + at)
                numbers.append(number)
                n, held, size = n + len(held), [], 0
        return _with((np.concatenate(sentences), np.concatenate(numbers)), [r.right_numbers for r in rows], [len(r.right) for r in rows], self.korean)

    def _see(self, word: str) -> int:
        if len(self.seen) > PRODUCTS // 8:
            self.seen.clear()
        i = self.seen[word] = self.id.get(bare(word.lower()), -1)
        return i


def _with(found: tuple[np.ndarray, np.ndarray], digits: list[list[tuple[int, int]]], sizes: list[int], after: int) -> tuple[np.ndarray, np.ndarray]:
    """With the numbers in digits of each row, (sentence, number), which come after the words."""
    if not any(digits):
        return found
    first = (np.cumsum(sizes) - sizes).tolist()
    more = np.array([(f + i, after + k) for f, d in zip(first, digits, strict=True) for i, k in d], np.int64)
    return once(np.concatenate([found[0], more[:, 0]]), np.concatenate([found[1], more[:, 1]]))


def lengths_of(counts: Iterable[tuple[str, str, int]]) -> tuple[int, dict[str, tuple[float, float]]]:
    """Pairs in all, and ratio and spread by kind, from the (LENGTHS + kind, name, sum) of a tally."""
    by: dict[str, dict[str, int]] = defaultdict(dict)
    for k, name, c in counts:
        by[k[len(LENGTHS) :]][name] = c
    ratio = {}
    for k, t in by.items():
        c = t["b"] / t["a"]
        ratio[k] = (c, max(0.5, (t["q"] / 1000 - 2 * c * t["b"] + c * c * t["a"]) / t["n"]))
    return sum(t["n"] for t in by.values()), ratio


def lexicon(both: Iterable[tuple[str, str, int, int, int]], n: int, ratio: dict[str, tuple[float, float]], most: int = 4) -> Lexicon:
    """From (word, Korean word, times together, times of the one, of the other) that pass related(), of n sentence pairs."""
    by: dict[str, list[tuple[float, str]]] = defaultdict(list)
    left = {}
    for v, w, c, x, y in both:
        by[v].append((c * c / (x * y), w))
        left[v] = x
    partners, weight = {}, {}
    for v, c in by.items():
        c.sort(reverse=True)
        top = c[0][0]
        partners[v] = [(w, min(1.0, 0.4 + 0.6 * s / top)) for s, w in c[:most] if s > 0.2 * top]
        weight[v] = min(1.0, 0.3 + top) * min(2.0, math.log1p(n / left[v]) / 3)
    return Lexicon(partners, weight, ratio)


def related(c, x, y, n):
    """Whether words seen x and y times, c of them together, may be partners among n sentence pairs; of numbers or of columns."""
    return (c >= 2) & (c * 1.0 * c / (x * 1.0 * y) > 0.03) & (c * 1.0 / x > 0.08) & (c * 1.0 * n > x * 3.0 * y)


def learn(pairs: Iterable[tuple[str, str]]) -> Lexicon:
    """From (source sentence, Korean sentence) pairs."""
    tally = Tally()
    for a, b in pairs:
        tally.add(a, b)
    names, v, w, c, lengths = tally.out()
    counts = {(names[i], names[j]): int(k) for i, j, k in zip(v, w, c, strict=True)}
    n, ratio = lengths_of(lengths)
    full = ((v, w, c, counts[v, ""], counts["", w]) for (v, w), c in counts.items() if v and w)
    return lexicon((r for r in full if related(*r[2:], n)), n, ratio)


# ---- one row


class Row:
    """The sentences of a row that can have partners, their starts and lengths on either side, and the numbers in digits that they hold."""

    __slots__ = ("c", "la", "lb", "left", "left_numbers", "right", "right_numbers", "spaceless", "src", "tgt", "var")

    def __init__(self, unit: str, text: str, left: list[tuple[int, int]], right: list[tuple[int, int]], lex: Lexicon, numbers: dict[str, int]) -> None:
        src, tgt = [unit[s:e] for s, e in left], [text[s:e] for s, e in right]
        at, to = [s for s, _ in left], [s for s, _ in right]
        signs = SIGNS.search(unit)
        odd = signs and ODD.search(unit) or ODD.search(text)
        if "<" in unit or "<" in text:
            src, tgt = [TAGS.sub("", x) for x in src], [TAGS.sub("", y) for y in tgt]
        if not set(src).isdisjoint(tgt):
            same = set(src).intersection(tgt)
            at, src = _kept(at, src, [x not in same for x in src])
            to, tgt = _kept(to, tgt, [y not in same for y in tgt])
        if odd:
            src, tgt = [plain(x)[0] for x in src], [plain(y)[0] for y in tgt]
        if not all(map(HANGUL.search, tgt)):
            to, tgt = _kept(to, tgt, [HANGUL.search(y) is not None for y in tgt])
        self.src, self.tgt, self.left, self.right = at, to, src, tgt
        self.la, self.lb = [len(x) or 1 for x in src], list(map(len, tgt))
        own = kind(unit) if signs else "e"
        self.spaceless = own == "j"
        self.c, self.var = lex.ratio.get(own, (0.5, 3.0))
        self.left_numbers, self.right_numbers = (), ()
        if signs and src and tgt and DIGIT.search(unit):
            self.left_numbers = [(i, numbers.setdefault(w, len(numbers))) for i, x in enumerate(src) if DIGIT.search(x) for w in NUMBER.findall(x)]
            self.right_numbers = [(j, numbers.setdefault(w, len(numbers))) for j, y in enumerate(tgt) if DIGIT.search(y) for w in NUMBER.findall("".join(y.split()))]


def _kept(starts: list[int], sentences: list[str], which: list[bool]) -> tuple[list[int], list[str]]:
    return list(compress(starts, which)), list(compress(sentences, which))


class Words:
    """The words of the source sentences of rows and the partners that their Korean sentences hold, looked up at once for all of them."""

    def __init__(self, rows: list[Row], lex: Lexicon) -> None:
        self.rows, self.lex = len(rows), lex
        self.cols = max(len(r.right) for r in rows)
        at, self.word = lex.sources(rows)
        self.row, self.sentence = _places(at, [len(r.left) for r in rows])
        to, held = lex.founds(rows)
        row, where = _places(to, [len(r.right) for r in rows])
        self.many = 1 + max(lex.korean, int(held.max(initial=0)), lex.korean + int(self.word.max(initial=0)) - lex.words)
        key = row * self.many + held
        order = np.argsort(key, kind="stable")
        key, self.where = key[order], where[order]
        self.first = np.flatnonzero(np.diff(key, prepend=-1))
        self.key, self.times = key[self.first], np.diff(self.first, append=len(key))

    def likeness(self, r0: int, r1: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """How alike the source sentences r0..r1 of rows are to their Korean sentences: the share of the source words' weight that these hold.

        Row, source sentence, Korean sentence and value where it isn't nought, and which source sentences (r0..r1 x rows) have a known word.
        Of a word's partners the strongest that a sentence holds counts.
        """
        lex, cols, wide = self.lex, self.cols, r1 - r0
        some = (self.sentence >= r0) & (self.sentence < r1)
        word = self.word[some]
        at = self.row[some] * wide + self.sentence[some] - r0
        number = word >= lex.words
        safe = np.where(number, 0, word)
        says = np.where(number, 1.5, lex.says[safe] if lex.words else 1.5)
        total = np.bincount(at, says, self.rows * wide)
        # every word with each of its partners, then with each sentence that holds the partner
        n = np.where(number, 1, lex.first[safe + 1] - lex.first[safe] if lex.words else 1)
        up = np.repeat(np.arange(len(word)), n)
        inner = np.arange(len(up)) - np.repeat(np.cumsum(n) - n, n)
        digits = number[up]
        place = np.where(digits, 0, lex.first[safe[up]] + inner)
        partner = np.where(digits, lex.korean + word[up] - lex.words, lex.of[place] if len(lex.of) else 0)
        part = np.where(digits, 1.5, lex.part[place] if len(lex.of) else 1.5)
        want = at[up] // wide * self.many + partner
        lo = np.searchsorted(self.key, want)
        held = np.flatnonzero(self.key[np.minimum(lo, len(self.key) - 1)] == want) if len(self.key) else np.zeros(0, np.int64)
        lo = lo[held]
        hits = self.times[lo]
        up2 = np.repeat(held, hits)
        j = self.where[np.repeat(self.first[lo] - (np.cumsum(hits) - hits), hits) + np.arange(len(up2))]
        # by cell, word and partner: of a word's partners, which come with the strongest first, the first in a cell counts
        most = 1 + int(inner.max(initial=0))
        code = np.sort(((at[up[up2]] * cols + j) * (len(word) + 1) + up[up2]) * most + inner[up2])
        code = code[np.flatnonzero(np.diff(code // most, prepend=-1))]
        which, rank = code // most, code % most
        cell, which = which // (len(word) + 1), which % (len(word) + 1)
        new = np.diff(cell, prepend=-1) != 0
        cells = cell[new]
        value = np.bincount(np.cumsum(new) - 1, part[(np.cumsum(n) - n)[which] + rank], len(cells))
        g = cells // cols
        return g // wide, r0 + g % wide, cells % cols, value / total[g], (total > 0).reshape(self.rows, wide).T


def _places(at: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Row and place in it of the sentences that are numbered over all rows."""
    ends = np.cumsum(sizes)
    row = np.repeat(np.arange(len(sizes)), sizes)[at]
    return row, at - (ends - sizes)[row]


# ---- the table


def _sums(sizes: list[list[int]], n: int) -> np.ndarray:
    """Sums of the sizes up to each sentence, sentences x rows."""
    each = np.array([len(x) for x in sizes], np.int64)
    row = np.repeat(np.arange(len(sizes)), each)
    out = np.zeros((n + 1, len(sizes)), np.float32)
    out[1 + np.arange(len(row)) - (np.cumsum(each) - each)[row], row] = np.fromiter(chain.from_iterable(sizes), np.float32, len(row))
    return out.cumsum(0)


class Table:
    """The cheapest paths through the sentences of rows of about one size, and the pairs on them. In all arrays the rows come last, so that numpy's loops are long."""

    def __init__(self, rows: list[Row], lex: Lexicon) -> None:
        self.rows, self.words = rows, Words(rows, lex)
        self.n, self.m = max(len(r.src) for r in rows), max(len(r.tgt) for r in rows)
        self.ca, self.cb = _sums([r.la for r in rows], self.n), _sums([r.lb for r in rows], self.m)
        self.c = np.array([r.c for r in rows], np.float32)
        self.var = np.array([r.var for r in rows], np.float32)
        self.wide = {b: self.cb[b:] - self.cb[:-b] for b in (1, 2, 3) if b <= self.m}

    def _length(self, x: int, a: int, b: int) -> np.ndarray:
        """Cost of the lengths of a source sentences from x with b Korean ones, by the first of those."""
        la = np.maximum(self.ca[x + a] - self.ca[x], 1.0)
        d = self.wide[b] - la * self.c
        return np.minimum(d * d * (np.float32(0.5 * LENGTH) / (la * self.var)), np.float32(LENGTH * STRAY))

    def alike(self, r0: int, r1: int) -> tuple[np.ndarray, np.ndarray]:
        """Likeness of the source sentences r0..r1 (nought beyond the last) with all Korean ones, sentences x sentences x rows, and which of them have a known word."""
        at = np.zeros((r1 - r0, self.m, len(self.rows)), np.float32)
        d, i, j, v, known = self.words.likeness(r0, r1)
        at[i - r0, j, d] = v
        for k, q in zip(*(x.tolist() for x in np.nonzero(~known)), strict=True):
            if r0 + k < len(self.rows[q].src):
                at[k, : len(self.rows[q].tgt), q] = EVEN
        return at, known

    def rows_from(self, r0: int, r1: int, before: np.ndarray, at: np.ndarray, x0: int) -> tuple[np.ndarray, np.ndarray]:
        """Costs of table rows r0-3..r1, given those of r0-3..r0 and the likeness from source sentence x0 on, and the beads by which rows r0+1..r1 are reached (places in BEADS, len(BEADS) a swap)."""
        m = self.m
        best = np.full((r1 - r0 + 4, m + 1, len(self.rows)), np.inf, np.float32)
        best[:4] = before
        back = np.zeros((r1 - r0, m + 1, len(self.rows)), np.int8)
        step = (np.arange(m + 1, dtype=np.float32) * np.float32(BEADS[0][2]))[:, None]
        for r in range(r0 + 1, r1 + 1):
            here = np.full((m + 1, len(self.rows)), np.inf, np.float32)
            how = np.zeros((m + 1, len(self.rows)), np.int8)

            def offer(cost: np.ndarray, b: int, code: int, here=here, how=how) -> None:
                part = here[b:]
                less = cost < part
                np.copyto(part, cost, where=less)
                np.copyto(how[b:], np.int8(code), where=less)

            for code, (a, b, price) in enumerate(BEADS):
                if not a or a > r or b > m:
                    continue
                x = r - a
                old = best[r - a - r0 + 3, : m + 1 - b]
                if not b:
                    offer(old + np.float32(price), 0, code)
                    continue
                some = at[x - x0 : r - x0]
                if b == 1:
                    likes = some.mean(0) if a > 1 else some[0]
                elif a == 1:
                    shifted = [some[0, q : m + 1 - b + q] for q in range(b)]
                    likes = np.minimum(np.maximum.reduce(shifted), sum(shifted) * np.float32(1.6 / b))
                else:
                    likes = np.maximum(some[:, :-1], some[:, 1:]).mean(0)
                    top = some.max(0)
                    likes = np.minimum(likes, (top[:-1] + top[1:]) * np.float32(0.8))
                offer(old + self._length(x, a, b) + np.float32(price) - np.float32(LEXICAL * max(a, b)) * (likes - np.float32(EVEN)), b, code)
            if r >= 2 and m >= 2:
                x = r - 2
                crossed = at[x - x0, 1:] + at[x + 1 - x0, :-1]
                sides = self._length(x, 1, 1)[1:] + self._length(x + 1, 1, 1)[:-1]
                cost = best[r - 2 - r0 + 3, : m - 1] + np.float32(SWAP) + sides - np.float32(LEXICAL) * (crossed - np.float32(2 * EVEN))
                offer(np.where(crossed > SWAP_FROM, cost, np.inf).astype(np.float32), 2, len(BEADS))
            # additions run along the row
            run = np.minimum.accumulate(here - step, 0) + step
            less = run < here - 1e-4
            np.copyto(how, np.int8(0), where=less)
            best[r - r0 + 3] = np.where(less, run, here)
            back[r - r0 - 1] = how
        return best, back

    def pairs(self) -> list[list[tuple[int, int]]]:
        """Pairs (source sentence, Korean sentence) of each row: those of its cheapest path, then those off it."""
        n, m = self.n, self.m
        start = np.full((4, m + 1, len(self.rows)), np.inf, np.float32)
        start[3] = (np.arange(m + 1) * BEADS[0][2])[:, None]
        block = n if len(self.rows) * n * m <= CELLS else max(4, min(n, CELLS // max(1, len(self.rows) * m)))
        edges = list(range(0, n, block))
        kept = [start]
        for r in edges[:-1]:
            x0 = max(0, r - 4)
            kept.append(self.rows_from(r, r + block, kept[-1], self.alike(x0, r + block)[0], x0)[0][-4:].copy())
        at = [(len(r.src), len(r.tgt)) for r in self.rows]
        out: list[set[tuple[int, int]]] = [set() for _ in self.rows]
        best_x, most_x = np.zeros((n, len(self.rows)), np.int64), np.zeros((n, len(self.rows)), np.float32)
        best_y, most_y = np.zeros((m, len(self.rows)), np.int64), np.full((m, len(self.rows)), -1, np.float32)
        for r0, before in zip(reversed(edges), reversed(kept), strict=True):
            x0, r1 = max(0, r0 - 4), min(n, r0 + block)
            like, known = self.alike(x0, r1)
            _, back = self.rows_from(r0, r1, before, like, x0)
            if n == m == 1:
                # one sentence on either side, as most rows have: on the path, or left over by it
                one, v = back[0, 1] == ONE_TO_ONE, like[0, 0]
                return [[(0, 0)] if x else [] for x in (one & (v >= LEAST) | known[0] & (v >= FAR)).tolist()]
            for d, pairs in enumerate(out):
                at[d] = self._back(pairs, *at[d], r0, x0, back[:, :, d], like[:, :, d], known[:, d])
            own = np.where(known[r0 - x0 :, None], like[r0 - x0 :], 0)
            best_x[r0:r1], most_x[r0:r1] = own.argmax(1), own.max(1)
            top = own.max(0)
            more = top >= most_y
            best_y[more], most_y[more] = (r0 + own.argmax(0))[more], top[more]
        for d, (r, pairs) in enumerate(zip(self.rows, out, strict=True)):
            left, right = {x for x, _ in pairs}, {y for _, y in pairs}
            if len(left) < len(r.src) or len(right) < len(r.tgt):
                # what the path leaves over: sentences merged by the dozen, or moved far; the first of the most alike
                for x in range(len(r.src)):
                    if x not in left and most_x[x, d] >= FAR:
                        pairs.add((x, int(best_x[x, d])))
                        right.add(int(best_x[x, d]))
                pairs |= {(int(best_y[y, d]), y) for y in range(len(r.tgt)) if y not in right and most_y[y, d] >= FAR}
        return [sorted(x) for x in out]

    @staticmethod
    def _back(pairs: set[tuple[int, int]], r: int, k: int, r0: int, x0: int, back: np.ndarray, like: np.ndarray, known: np.ndarray) -> tuple[int, int]:
        """Walks the path back from (r, k) to r0 or before, adds its pairs and returns where it has come to."""
        while r > r0:
            code = int(back[r - r0 - 1, k])
            a, b = (2, 2) if code == len(BEADS) else BEADS[code][:2]
            r, k = r - a, k - b
            i = r - x0
            if code == len(BEADS):
                pairs |= {(r, k + 1), (r + 1, k)}
            elif a == b == 1:
                if like[i, k] >= LEAST:
                    pairs.add((r, k))
            elif a == b == 2:
                pairs |= {(r + x, k + int(like[i + x, k + 1] > like[i + x, k])) for x in (0, 1)}
            elif a and b:
                pairs |= {(r + x, k + y) for x in range(a) for y in range(b) if not known[i + x] or like[i + x, k + y] >= LEAST_MERGED}
        return r, k


def size_class(n: int) -> int:
    """Rows up to a tenth apart in size go through one table, of up to eight sentences those of one size."""
    return n if n <= 8 else 8 + math.ceil(math.log(n / 8) / math.log(1.25))


Item = tuple[str, str, list[tuple[int, int]], list[tuple[int, int]]]


def align_all(items: list[Item], lex: Lexicon) -> list[list[tuple[int, int]]]:
    """(start of the unit's sentence, start of the Korean sentence) of the pairs of each (unit, text, spans of the unit, spans of the text)."""
    numbers: dict[str, int] = {}
    # what is delivered again has the pairs that it had before
    place: dict[tuple[str, str], int] = {}
    places = [place.setdefault((u, t), len(place)) for u, t, _, _ in items]
    rows: list[Row] = []
    for x, d in zip(items, places, strict=True):
        if d == len(rows):
            rows.append(Row(*x, lex, numbers))
    out: list[list[tuple[int, int]]] = [[] for _ in rows]
    by: dict[tuple[int, int], list[int]] = defaultdict(list)
    for d, r in enumerate(rows):
        if r.src and r.tgt:
            n, m = len(r.src), len(r.tgt)
            by[(size_class(n), size_class(m)) if max(n, m) <= 8 else (size_class(max(n, m)), 0)].append(d)
    for few in by.values():
        n, m = max(len(rows[d].src) for d in few), max(len(rows[d].tgt) for d in few)
        most = max(1, CELLS // ((n + 5) * (m + 1)))
        for i in range(0, len(few), most):
            part = few[i : i + most]
            for d, pairs in zip(part, Table([rows[d] for d in part], lex).pairs(), strict=True):
                src, tgt = rows[d].src, rows[d].tgt
                out[d] = [(src[x], tgt[y]) for x, y in pairs]  # in order, as the starts are
    return out if len(rows) == len(items) else [out[d] for d in places]


def spans(unit: str, text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Start and end of the sentences of either side."""
    if SINGLE.fullmatch(unit) and SINGLE.fullmatch(text) and not HANGUL.search(unit):
        return [(0, len(unit))], [(0, len(text))]
    return segment(unit), segment(text)


def align(unit: str, text: str, lex: Lexicon, at: tuple[list[tuple[int, int]], list[tuple[int, int]]] | None = None) -> list[tuple[int, int]]:
    """(start of the unit's sentence, start of the Korean sentence) of the pairs; at: the spans, where they are known."""
    return align_all([(unit, text, *(at or spans(unit, text)))], lex)[0]


def alignable(unit: str | None, text: str | None, copied) -> bool:
    """Not so blank sides, texts that aren't Korean, refusals and copies; a mostly Korean text is no copy of an English or Japanese unit."""
    return bool(unit and text and HANGUL.search(text) and not refuses(text) and (mostly_korean(text) or not copied(unit, text)))


def training_pairs(unit: str, text: str, left: list[tuple[int, int]], right: list[tuple[int, int]]) -> list[tuple[str, str]]:
    """Sentence pairs of a row whose sides have equally many sentences, of others none."""
    if len(left) != len(right):
        return []
    if "<" in unit or "<" in text or (not unit.isascii() and ODD.search(unit)) or ODD.search(text):
        return [(plain(TAGS.sub("", unit[s:e]))[0], plain(TAGS.sub("", text[x:y]))[0]) for (s, e), (x, y) in zip(left, right, strict=True)]
    return [(unit[s:e], text[x:y]) for (s, e), (x, y) in zip(left, right, strict=True)]
