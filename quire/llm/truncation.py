"""Values cut on their way, by hashed logistic regression over how they close (problem 5).

Training data is made from the corpus: values that close with a final mark and the ends of their inner
paragraphs and sentences, with and without that mark, are whole; the same values stopped inside a
sentence, with whatever mark a cutter leaves, are cut. In a second round stored values without a final
mark that the first model takes for whole join the whole ones, which teaches it signatures, headings
and verse. Features: the closing characters and words, the words of the last unit, marks left open,
verse lines, script, and the length against usual limits.
"""

from __future__ import annotations

import random
import re
import unicodedata
import zlib

import numpy as np

from .sentences import ANY, BEFORE, MAY_END, segment

BITS = 18
MASK = (1 << BITS) - 1
ENDED = re.compile(r"[.!?。！？．｡]+(?:[”’」』)）\]\"'»*]|</\w+>)*$|(?:…|—|―|-|\.\.\.)+[”」』’]+(?:[)）])*$")
LEFT = re.compile(r"(?:\s|…|\.{3,}|\[(?:\.\.\.|…)\]|-|�|\\|/|\|)+$")
MARKS = ("", "", "", "", "", "", "…", "...", "-", "[...]", "�", " ")
LIMITS = (100, 120, 128, 140, 160, 200, 240, 250, 255, 256, 280, 300, 400, 500, 512, 600, 800, 900, 1000, 1024, 1200, 1500, 2000, 2048, 3000, 4000, 4096)
WORDS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]")
RUNS = re.compile(r"[ァ-ヺー・]+|[一-鿿々]+|[ぁ-ん]|[A-Za-z]+|\d+|[^\w\s]")
TAGS = re.compile(r"</?[A-Za-z][^<>]*>")


#: Characters that the patterns of a text's end are made of, besides tags.
TRAILING = "".join(dict.fromkeys(".!?。！？．｡”’」』)）]\"'»*…—―-\\/|� \t\n\r\f\v\u3000\xa0["))
TAG_AT_END = re.compile(r"</?\w+>\Z")


def at_end(pattern: re.Pattern, text: str) -> re.Match | None:
    """Match of one of the patterns that are anchored at the end; only the closing marks are searched, however many there are."""
    n = len(text)
    while True:
        n = len(text[:n].rstrip(TRAILING)) if n else 0
        tag = TAG_AT_END.search(text, max(0, n - 40), n) if n and text[n - 1] == ">" else None
        if not tag:
            return pattern.search(text, n)
        n = tag.start()


def tail(text: str) -> str:
    """The last paragraph, without white space behind it."""
    t = text.rstrip()
    return t[t.rfind("\n\n") + 2 :] if "\n\n" in t else t


def last_unit(paragraph: str) -> str:
    """The paragraph's last sentence unit; the whole of it is segmented, so that open quotations and short forms are known."""
    u = segment(paragraph)
    return paragraph[u[-1][0] :] if u else paragraph


def features(text: str, heading: bool = False) -> list[int]:
    """Hashed features of one value."""
    out: list[str] = ["bias"]
    t = text.rstrip()
    if len(t) != len(text):
        out.append("space")
    p = tail(t)
    if heading:
        return hashed(["heading", *out, "heading" + ("left" if at_end(LEFT, p) else "")])
    short = len(p) < min(60, len(t))
    if "<" in p:
        p = TAGS.sub("", p)
    p = unicodedata.normalize("NFC", p)
    m = at_end(LEFT, p)
    core = p[: m.start()] if m else p
    mark = m.group().strip() if m else ""
    ended = at_end(ENDED, p)
    kind = ("…" if "…" in mark or "..." in mark else mark[-1:]) if mark else ""
    lines = core.split("\n")
    verse = not ended and len(lines) > 1 and sum(not at_end(ENDED, x) for x in lines[:-1]) * 2 > len(lines) - 1 and all(not x[:1].islower() for x in lines)
    unit = lines[-1] if verse else last_unit(core).replace("\n", " ")
    s = "k" if "가" <= max(unit[-12:] or " ") <= "힣" or re.search("[가-힣]", unit[-30:]) else "j" if re.search("[ぁ-ヿ]", unit[-30:]) else "e" if re.search("[A-Za-z]", unit[-30:]) else "o"
    end = "E" if ended else kind if kind else "," if core.endswith(",") else "n"
    out.append(s + "end" + end + ("v" if verse else ""))
    if mark and not ended:
        out.append("left" + end)
        return hashed(out)
    if short and end == "n":
        out.append(s + "short" + " ".join(WORDS.findall(p)[:2]).lower())
        out.append(s + "shorts" + p[-2:])
    if ended and m is None:
        out.append("whole" + p[-1])
        inner = p[: ended.start()][-3:]
        last = re.search(r"[^\s“‘(]*$", p[: ended.start()]).group().lower()
        short_form = last in BEFORE or last in MAY_END or len(last) == 1 and last.isascii() or last[-1:].isdigit()
        out.append(s + ("endShort" if short_form else "endWord") + p[ended.start()])
        out.append("whole3" + s + inner)
        core = p[: ended.start()]
        unit = unit[: max(0, len(unit) - (len(p) - ended.start()))]
        if not short_form:
            s += "E"  # closing words before an end mark say nothing about those without
    lost = sum(unit.count(a) > unit.count(b) for a, b in ("“”", "「」", "()", "（）", "«»", "『』"))
    if lost:
        out.append(s + "open" + end)
    words = (RUNS if s[0] == "j" else WORDS).findall(unit.rstrip(",、 "))
    low = [w if s[0] != "e" else w.lower() for w in words]
    c = core.rstrip(",、 ")
    for k in (1, 2, 3, 4, 5, 7):
        out.append(f"{s}s{k}{c[-k:]}")
    if low:
        out.append(s + "w" + low[-1])
        out.append(s + "ww" + " ".join(low[-2:]))
        out.append(s + "www" + " ".join(low[-3:]))
        out.append(s + "first" + " ".join(low[:2]))
        if s[0] == "e" and words[-1][:1].isupper():
            out.append("eCap" + end)
            out.append("eCap2" + " ".join(w.lower() for w in words[-3:-1]))
    seen = set(low)
    out.extend(s + "b" + w for w in seen)
    out.extend(s + "c" + a + " " + b for a, b in set(zip(low, low[1:], strict=False)))
    out.append(f"{s}n{min(len(low), 12)}")
    n = len(text)
    if n in LIMITS or n + 1 in LIMITS:  # a blank at the limit may have been trimmed
        out.append("limit" + end)
    out.append("len" + str(min(10, n.bit_length())) + end)
    return hashed(out)


def hashed(names: list[str]) -> list[int]:
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) & MASK for x in set(names)]


def closings(text: str) -> list[str]:
    """How a short last paragraph without a final mark opens and closes; [] for other values."""
    t = text.rstrip()
    p = tail(t)
    if not 0 < len(p) < min(60, len(t)) or at_end(ENDED, p) or at_end(LEFT, p) or "\n" in p:
        return []
    return ["first " + " ".join(WORDS.findall(p)[:2]).lower(), "last " + p[-2:]]


#: Short forms inside a text after which a cut leaves a full stop that ends nothing.
INNER_STOP = re.compile(rf"(?<![\w.])(?i:{'|'.join(sorted(w for w in BEFORE if w.isalpha()))}|(?-i:[A-HJ-Z]))\.(?=\s+\S)|(?<=\d)\.(?=\d)")


def cut(text: str, rng: random.Random) -> str | None:
    """The value stopped inside one of its units, or None if it has none to stop in."""
    units = [u for u in segment(text) if u[1] - u[0] > 6]
    if not units:
        return None
    s, e = rng.choice(units)
    closing = len(text[s:e]) - len(text[s:e].rstrip(".!?…。！？”’」』)）—―,"))
    last = e - closing - 1
    if last <= s + 1:
        return None
    i = rng.randint(s + 2, last)
    if rng.random() < 0.35:
        j = text.rfind(" ", s + 1, i)
        i = j if j > s else i
    piece = text[:i]
    if rng.random() < 0.9:
        piece = piece.rstrip()
    if at_end(ENDED, piece):
        return None
    mark = rng.choice(MARKS)
    return piece + mark if ANY.search(piece) else None


def examples(texts: list[str], rng: random.Random) -> tuple[list[str], list[int]]:
    """Values made of the texts and whether they are cut. What is made of a text depends on the text and the generator's state alone, not on the other texts."""
    xs, ys = [], []
    seed = rng.getrandbits(31)
    for t in texts:
        rng = random.Random(zlib.crc32(t.encode("utf-8", "surrogatepass")) + seed)
        whole = t.rstrip()
        if not ANY.search(whole) or at_end(LEFT, whole):
            continue
        ended = at_end(ENDED, whole)
        if ended:
            xs.append(whole)
            ys.append(0)
            bare = whole[: ended.start()].rstrip()
            if rng.random() < 0.5 and ended.group() in (".", "。"):
                xs.append(bare)
                ys.append(0)
        parts = whole.split("\n\n")
        for k in range(min(2, len(parts) - 1)):
            i = rng.randint(1, len(parts) - 1) if k else 1
            piece = "\n\n".join(parts[:i])
            if ANY.search(parts[i - 1]):
                xs.append(piece)
                ys.append(0)
        last = parts[-1].split("\n")
        if len(last) > 1 and all(not at_end(ENDED, x) for x in last[:-1]) and all(not x[:1].islower() for x in last):
            i = rng.randint(1, len(last) - 1)
            xs.append("\n\n".join([*parts[:-1], "\n".join(last[:i])]))
            ys.append(0)
        for _ in range(2):
            c = cut(whole, rng)
            if c:
                xs.append(c)
                ys.append(1)
        # cut by the length of a field, and behind a short form
        fits = [n for n in LIMITS if n < len(whole) - 1 and ANY.search(whole[:n])]
        if fits:
            piece = whole[: rng.choice(fits)]
            if not at_end(ENDED, piece.rstrip()) and "\n\n" not in piece[-2:]:
                xs.append(piece if rng.random() < 0.3 else piece.rstrip())
                ys.append(1)
        stops = [m.end() for m in INNER_STOP.finditer(whole)]
        if stops and rng.random() < 0.3:
            xs.append(whole[: rng.choice(stops)])
            ys.append(1)
        if rng.random() < 0.15:
            # lines of verse: whole sentences without their full stops, one under the other
            lines = [whole[a:b].rstrip(".。") for a, b in segment(whole) if 12 < b - a < 90 and not re.search(r"[\n“”「」!?！？…()（）]", whole[a:b])]
            if len(lines) >= 2:
                k = rng.randint(2, min(5, len(lines)))
                lines = rng.sample(lines, k)
                end = rng.choice(("", "", ","))
                verse = (end + "\n").join(lines)
                xs.append(verse + end)
                ys.append(0)
                at = rng.randint(max(3, len(lines[-1]) // 5), len(lines[-1]) - 1)
                xs.append((verse[: len(verse) - at]).rstrip() + rng.choice(MARKS))
                ys.append(1)
        if ended and rng.random() < 0.1 and re.search("[가-힣]", whole):
            dense = re.sub(r"[\W_]+", "", whole)
            xs.append(dense)
            ys.append(0)
            if len(dense) > 12:
                i = rng.randint(max(4, len(dense) - 90), len(dense) - 3)
                xs.append(dense[:i])
                ys.append(int(dense[i - 1] != "다"))
    return xs, ys


def solve(flat: np.ndarray, sizes: np.ndarray, ys: np.ndarray, weights: np.ndarray | None = None, rounds: int = 60, l2: float = 2e-6) -> np.ndarray:
    """Logistic regression by full-batch adaptive gradient steps over sparse binary rows: the features of all rows one after the other, and how many each has."""
    used, idx = np.unique(flat, return_inverse=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    y = np.asarray(ys, np.float64)
    w = np.zeros(len(used)) if weights is None else weights[used].astype(np.float64)
    g2 = np.full(len(used), 1e-8)
    balance = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)) / len(y)
    for _ in range(rounds):
        z = np.bincount(row, w[idx], len(sizes))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        g = np.bincount(idx, ((p - y) * balance)[row], len(used)) + l2 * w
        g2 += g * g
        w -= 0.6 * g / np.sqrt(g2)
    out = np.zeros(1 << BITS)
    out[used] = w
    return out


#: Kinds of rows that learning needs besides 0 (whole) and 1 (cut): a stored value without a final mark.
UNMARKED = 2


def rows_of(text: str | None, heading: bool, seed: int = 7) -> list[tuple[int, list[int], list[str]]]:
    """(kind, features, closings) of what learning takes from one stored value."""
    if not text or not ANY.search(text):
        return []
    if heading:
        return [(0, features(text, True), [])]
    out = [(y, features(x), []) for x, y in zip(*examples([text], random.Random(seed)), strict=True)]
    if ANY.search(tail(text)) and not at_end(ENDED, text.rstrip()) and not at_end(LEFT, text):
        out.append((UNMARKED, features(text), closings(text)))
    return out


def learn(kinds: np.ndarray, flat: np.ndarray, sizes: np.ndarray, closing: list[list[str]]) -> np.ndarray:
    """Weights from rows_of() a sample. Without whole and cut rows the weights are zero, for which nothing counts as cut."""
    made = kinds != UNMARKED
    if len(set(kinds[made].tolist())) < 2:
        return np.zeros(1 << BITS, np.float32)
    of = np.repeat(np.arange(len(sizes)), sizes)
    w = solve(flat[made[of]], sizes[made], kinds[made])
    # stored values without a final mark: those that the first model takes for whole, and those that close as many others do
    usual: dict[str, int] = {}
    for c in closing:
        for x in c:
            usual[x] = usual.get(x, 0) + 1
    least = max(8, 0.01 * int((~made).sum()))
    z = np.bincount(of, w[flat], len(sizes))
    more = ~made & ((z < 0) | np.array([any(usual[x] >= least for x in c) for c in closing], bool))
    taken = made | more
    return solve(flat[taken[of]], sizes[taken], np.where(more, 0, kinds)[taken]).astype(np.float32)


def fit(texts: list[str], headings: list[bool] | None = None, seed: int = 7) -> np.ndarray:
    """Weights from a sample of stored values, in one place."""
    rows = [r for t, h in zip(texts, headings or [False] * len(texts), strict=True) for r in rows_of(t, h, seed)]
    return learn(np.array([k for k, _, _ in rows], np.int64), np.array([i for _, f, _ in rows for i in f], np.int64), np.array([len(f) for _, f, _ in rows], np.int64), [c for _, _, c in rows])


def score(w: np.ndarray, text: str | None, heading: bool = False) -> float:
    """Log odds that the value was cut; minus infinity where its last paragraph holds no letter or digit."""
    if not text:
        return float("-inf")
    p = tail(text)
    if not ANY.search(TAGS.sub("", p) if "<" in p else p):
        return float("-inf")
    return float(w[features(text, heading)].sum())
