"""Word lattice for scripts written without spaces.

A small dictionary of closed-class words (particles, endings, connectives) and open
classes by script run form the arcs of a lattice; the cheapest path gives the words.
Closed-class words are listed; nouns, names and stems need no list because a script
run (katakana, kanji, Latin, digits) is an arc of its own.
"""

from __future__ import annotations

from functools import lru_cache

#: Particles and quotatives that continue the sentence they follow.
CONTINUING = (
    "と", "って", "という", "といった", "といって", "との", "とは", "とも", "とか", "など", "なんて", "は", "が", "を",
    "に", "の", "で", "も", "へ", "から", "まで", "より", "や", "だの", "だと", "ので", "のに", "ながら", "けれど",
)
#: Words and endings that can close a sentence.
FINAL = (
    "た", "だ", "る", "ない", "ます", "ました", "です", "でした", "ません", "よ", "ね", "か", "な", "ぞ", "わ", "さ", "だろう", "でしょう",
    "う", "い", "く", "す", "つ", "ぬ", "む", "ろ", "れ", "え", "まい", "たい", "である", "であった", "のだ", "のか", "かった", "って",
)
#: Words that open a sentence.
OPENING = (
    "そして", "しかし", "だが", "ところが", "ところで", "とにかく", "とうとう", "ときどき", "とても", "もっとも", "でも", "では", "それから", "それで",
    "それでも", "すると", "さて", "また", "やがて", "まもなく", "しばらくして", "もし", "まるで", "なんと", "なぜ", "どうして", "いったい", "いま",
    "もちろん", "たとえ", "たしかに", "つまり", "ただし", "ある", "この", "その", "あの", "これ", "それ", "あれ", "ここ", "そこ", "すべて",
    "みんな", "だれ", "どこ", "わたし", "ぼく", "きみ", "かれ", "ひどく", "ゆっくり", "にもかかわらず", "はじめ", "やはり", "もう", "まだ",
)
COST = {w: 6.0 + 1.0 / len(w) for w in FINAL} | {w: 4.0 + 2.0 / len(w) for w in CONTINUING} | {w: 4.0 + 1.0 / len(w) for w in OPENING}
KIND = {w: "final" for w in FINAL} | {w: "continuing" for w in CONTINUING} | {w: "opening" for w in OPENING}
LONGEST = max(map(len, COST))
#: Cost of an open-class word by script, for the word and for each further character of it.
RUN = {"kata": (5.0, 0.1), "kanji": (5.0, 1.5), "latin": (5.0, 0.1), "digit": (4.0, 0.1), "hira": (9.0, 4.0), "other": (5.0, 5.0)}


def script(c: str) -> str:
    o = ord(c)
    if 0x3041 <= o <= 0x309F:
        return "hira"
    if 0x30A0 <= o <= 0x30FF or 0x31F0 <= o <= 0x31FF or 0xFF66 <= o <= 0xFF9F:
        return "kata"
    if 0x3400 <= o <= 0x9FFF or o in (0x3005, 0x3007) or 0xF900 <= o <= 0xFAFF or 0x20000 <= o <= 0x3FFFF:
        return "kanji"
    if c.isdigit():
        return "digit"
    return "latin" if c.isalpha() else "other"


@lru_cache(maxsize=1 << 14)
def words(text: str) -> tuple[tuple[str, str], ...]:
    """(word, kind) along the cheapest path; kind is final, continuing, opening or the script of an unlisted word."""
    n = len(text)
    best: list[tuple[float, int, str]] = [(0.0, -1, "")] + [(1e9, -1, "")] * n
    scripts = [script(c) for c in text]
    for i in range(n):
        here = best[i][0]
        for j in range(i + 1, min(n, i + LONGEST) + 1):
            c = COST.get(text[i:j])
            if c is not None and here + c < best[j][0]:
                best[j] = (here + c, i, KIND[text[i:j]])
        first, each = RUN[scripts[i]]
        j = i + 1
        while True:
            c = here + first + each * (j - i - 1)
            if c < best[j][0]:
                best[j] = (c, i, scripts[i])
            if j >= n or scripts[j] != scripts[i] or j - i > 24:
                break
            j += 1
    out, j = [], n
    while j > 0:
        _, i, kind = best[j]
        out.append((text[i:j], kind))
        j = i
    return tuple(reversed(out))


def ends(left: str) -> bool:
    """Can the sentence that runs up to here be over? Judged by its last word."""
    path = words(left[-12:])
    return bool(path) and path[-1][1] == "final"


def continues(right: str) -> bool:
    """Does what follows a closing quotation mark carry the sentence on? Judged by its first word."""
    path = words(right[:12])
    return bool(path) and path[0][1] == "continuing"
