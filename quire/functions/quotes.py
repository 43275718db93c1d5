"""Quotations of a paragraph.

A quotation is the stretch from an opening mark to where its extent ends: at its closing mark (corner brackets
nest), before the next opening mark of its kind (double and single marks don't nest in themselves), or at the
end of the paragraph, where it is left open. What a paragraph leaves open depends on that paragraph alone: a
mark left open before it is either opened again at its start, or closed before any other opens, or given up,
and in each case the rest reads as if nothing had been open. So the carry needs no fold over paragraphs: it is
the value of the row before.
"""

from __future__ import annotations

import re
from itertools import accumulate

#: Opening marks and their closing ones.
CLOSING = {"“": "”", "‘": "’", "「": "」", "『": "』"}
#: How each opening and closing mark looks in a text; a single mark within or before a word is an apostrophe.
OPENS = {"“": "“", "‘": r"(?<!\w)‘", "「": "「", "『": "『"}
CLOSES = {"“": "”", "‘": r"’(?!\w)", "「": "」", "『": "』"}
NESTING = "「『"
EITHER = {m: re.compile(f"(?P<open>{OPENS[m]})|{CLOSES[m]}") for m in CLOSING}
CLOSER = {m: re.compile(CLOSES[m]) for m in CLOSING}


def opener(marks: str) -> re.Pattern:
    return re.compile("|".join(OPENS[m] for m in marks))


OPENER = {marks: opener(marks) for marks in ("“", "‘", "「『")}


def extent(text: str, start: int) -> tuple[int, bool]:
    """Where the quotation that opens at start ends, and whether it is left open there."""
    mark = text[start]
    steps = list(EITHER[mark].finditer(text, start + 1))
    if mark in NESTING:
        depth = accumulate((1 if s["open"] else -1 for s in steps), initial=1)
        shut = next((s.end() for s, d in zip(steps, list(depth)[1:], strict=True) if d == 0), None)
        return (len(text), True) if shut is None else (shut, False)
    if not steps:
        return len(text), True
    return (steps[0].start() if steps[0]["open"] else steps[0].end()), False


def quotations(text: str, marks: str, carry: str | None = None) -> list[tuple[int, int, bool]]:
    """(start, end, continued) of the quotations that open with one of marks; carry is the mark that the paragraph before left open."""
    find = OPENER.get(marks) or opener(marks)
    out: list[tuple[int, int, bool]] = []
    first = find.search(text)
    again = bool(carry) and text.lstrip().startswith(carry)
    if carry and not again:
        shut = CLOSER[carry].search(text)
        if shut and (first is None or shut.start() < first.start()):
            out.append((0, shut.end(), True))
            first = find.search(text, shut.end())
    while first:
        end, _ = extent(text, first.start())
        out.append((first.start(), end, again))
        again, first = False, find.search(text, end)
    return out


def left_open(text: str, marks: str) -> str | None:
    """The mark that the paragraph leaves open."""
    spans = quotations(text, marks)
    if spans and spans[-1][1] == len(text) and extent(text, spans[-1][0])[1]:
        return text[spans[-1][0]]
    return None


def marks_of(lang: str | None) -> str:
    """The marks that open quotations in a language."""
    return "「『" if lang == "ja" else "“"
