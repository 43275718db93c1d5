"""Subjects of sentences by complement naive Bayes, refined by expectation-maximization (problem 9).

A sentence (in verse and monologues a clause) gives stems: English words, Korean words without their
particle, Japanese runs of kanji and katakana, and their neighbours in pairs. Names, and what a
passing comparison compares with, give none. A stem's weight for a
subject is the log odds of the subject in documents that hold the stem, against its odds in all: the
stem's probability in the subject over that in the subject's complement. Labelled samples start the
weights, with unlabelled documents as complement; then each unlabelled document counts for a subject
by how many of its sentences speak for it (expectation), and the weights are taken anew from these
counts (maximization), so terms that no sample holds are learned from the company they keep, while words
used with every subject keep none. The subjects don't compete: a rising curve turns each subject's
evidence into a posterior of its own. It is fitted on labelled sentences whose evidence comes from weights
that leave their own sample out, by isotonic regression, which bounds nothing but that more evidence speaks no less; which of a sample's sentences deal with its subject is not known, so each
counts by how far its evidence is more common among them than among sentences of other subjects.

Learning, calibration and scoring read one form of documents, the numbered stems of a :class:`Block`.
"""

from __future__ import annotations

import math
import re
from functools import cached_property
from hashlib import blake2b

import numpy as np

from .sentences import ANY, plain, segment

TAGS = re.compile(r"</?[A-Za-z][^<>]*>")
#: Passing comparisons as the languages make them; the compared thing is masked. English: what one does to a thing, what a thing is like or a kind of;
#: Korean: nouns with 처럼, 같이, 마냥, 인 양, and objects of verbs in -듯; Japanese: nouns before のよう, みたい, and でも with a verb in ように.
COMPARED = re.compile(
    r"\bas (?:if |though )?(?:one|you|people|men|(?:a|any) (?:man|woman|person)) [^,;.!?—]*"
    r"|\b(?:kind|sort|species|manner) of\s+(?:an? )?[\w'’-]+(?:\s+[\w'’-]+)?"
    r"|\b(?:un)?like (?:an?|the|some)\s+[\w'’-]+(?:\s+[\w'’-]+)?"
    r"|[가-힣]+(?:\s[가-힣]+)?(?:을|를)\s*[가-힣]+(?:는 )?듯|일종의\s*[가-힣]+(?:\s[가-힣]+)*?\s*같|마치\s+[가-힣]+(?:\s[가-힣]+)?(?:처럼|같이|인 양|마냥|듯)"
    r"|[^、。「」はがにを]{1,14}でも[^、。「」はがにを]{1,6}ように|一種の[^、。「」]{1,14}のよう|まるで[^、。「」]{1,14}(?:の?よう|みたい)"
)
EN = re.compile(r"[A-Za-zÀ-ɏ]+(?:['’-][A-Za-zÀ-ɏ]+)*")
STOP = frozenset(
    "the a an and or but of to in on at by for from with without into upon over under as if that this these those it its he she they them his her their we you i me my our your was were is are be been being had has have "
    "did do does not no nor never so than then there here what who whom which when where why how all any each every more most much such only very said asked cried answered murmured one two three four five".split()
)
KO = re.compile(r"[가-힣]+")
JOSA = re.compile(r"(?:으로부터|에게서|에서는|에게는|으로는|이라는|라는|에서|에게|께서|까지|부터|보다|처럼|마다|조차|으로|이나|이며|하고|와의|과의|에는|을|를|이|가|은|는|에|의|와|과|로|도|만|께)$")
JA = re.compile(r"[ぁ-ん]{0,3}[一-鿿々]+|[ァ-ヺー]{2,}")
JA_STRIP = re.compile(r"^[ぁ-ん]+")
HANGUL, ASIAN = re.compile("[가-힣]"), re.compile("[ぁ-ヿ一-鿿]")
#: Words whose stems are kept at hand.
CACHED = 100_000
CLAUSE_EN = re.compile(r"(?:,|;)\s+(?:and|while|but)\s+|;\s+")
CLAUSE_KO = re.compile(r"(?<=[고데만며나니])\s*,\s*")
CLAUSE_JA = re.compile(r"(?<=[てでがし])、")
DEALS = re.compile(r"[はがをに]")


def sentences(text: str, form: str | None) -> list[str]:
    """The sentences of a document; of verse its lines and of monologues its clauses."""
    t = plain(TAGS.sub("", text) if "<" in text else text)[0]
    if form == "verse":
        return [x for x in t.split("\n") if ANY.search(x)]
    out = []
    for s, e in segment(t, True):
        u = t[s:e]
        if form == "monologue":
            if re.search("[ぁ-ヿ]", u):
                held = ""
                for c in CLAUSE_JA.split(u):
                    held += c
                    if DEALS.search(c):
                        out.append(held)
                        held = ""
                if held and out:
                    out[-1] += held
            else:
                out.extend(c for c in (CLAUSE_KO if re.search("[가-힣]", u) else CLAUSE_EN).split(u) if ANY.search(c))
        else:
            out.append(u)
    return out


#: Strings of which a passing comparison holds at least one, by script.
MARKS = {"e": (" as ", "kind of", "sort of", "species of", "like "), "k": ("듯", "일종의", "마치"), "j": ("でも", "一種の", "まるで")}


def script(sentence: str) -> str:
    return "k" if HANGUL.search(sentence) else "j" if ASIAN.search(sentence) else "e"


def uncompared(sentence: str, key: str) -> str:
    s = sentence.replace("\n", " ") if "\n" in sentence else sentence
    for m in MARKS[key]:
        if m in s:
            return COMPARED.sub(" | ", s)
    return s


_KOREAN: dict[str, tuple[str, tuple[str, ...]]] = {}
_JAPANESE: dict[str, tuple[str, tuple[str, ...]]] = {}


def _korean(word: str) -> tuple[str, tuple[str, ...]]:
    """A word without its particle and the stems it gives; kept at hand."""
    if len(_KOREAN) >= CACHED:
        _KOREAN.clear()
    b = (JOSA.sub("", word) or word) if len(word) > 1 else word
    e = _KOREAN[word] = (b, ("k" + b, "k" + b[:2] + "*") if len(b) > 2 else ("k" + b,))
    return e


def _japanese(word: str) -> tuple[str, tuple[str, ...]]:
    if len(_JAPANESE) >= CACHED:
        _JAPANESE.clear()
    b = JA_STRIP.sub("", word) or word
    e = _JAPANESE[word] = (b, ("j" + b, "j" + word[-(len(b) + 2) :]) if word != b else ("j" + b,))
    return e


def stems(sentence: str) -> list[str]:
    key = script(sentence)
    s = uncompared(sentence, key)
    out: list[str] = []
    last = ""
    if key == "k":
        for w in KO.findall(s):
            b, own = _KOREAN.get(w) or _korean(w)
            out += own
            if last:
                out.append(f"k{last} {b}")
            last = b
    elif key == "j":
        for w in JA.findall(s):
            b, own = _JAPANESE.get(w) or _japanese(w)
            out += own
            if last and len(b) + len(last) < 14:
                out.append(f"j{last} {b}")
            last = b
    else:
        for i, w in enumerate(EN.findall(s)):
            # names are passed over and part their neighbours, and so do words of no use
            low = w.lower()
            if i and low[0] != w[0] or low in STOP:
                last = ""
                continue
            out.append("e" + low)
            if last:
                out.append(f"e{last} {low}")
            last = low
    return list(dict.fromkeys(out))


SCRIPTS = "ekj"


def number(stem: str) -> int:
    """61 bits of a hash and the script in the last two."""
    return int.from_bytes(blake2b(stem.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") >> 3 << 2 | SCRIPTS.index(stem[0])


#: Weight of the labelled samples of a script against its unlabelled documents at first, the share of it that stays in each later round,
#: the least weight that counts, the evidence that makes a sentence deal with a subject, the subjects that a document is taken to have at most while learning.
ANCHOR, LATER, LEAST_WEIGHT, DEALS_FROM, MOST, NEEDED = 0.3, 0.6, 1.3, 2.0, 2.5, 1.8
ALPHA = 0.6
#: Shares of documents are whole multiples of this, so that their sums don't depend on the order.
GRAIN = 2.0**20
#: Borders of the evidence by which the calibration tells dealing sentences from others.
STEPS = np.array([1e-9, 1.0, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 6.5, 8.0])


class Model:
    """Numbers of the stems that weigh something (in order), their weights by subject; the posterior by step of the evidence."""

    def __init__(self, names: list[str], keys: np.ndarray, w: np.ndarray, levels: np.ndarray) -> None:
        self.names, self.keys, self.w, self.levels = names, keys, w, np.asarray(levels, float)

    @cached_property
    def weights(self) -> dict[int, list[tuple[int, float]]]:
        return {int(k): [(int(j), float(x[j])) for j in np.flatnonzero(x)] for k, x in zip(self.keys, self.w, strict=True)}


class Weights:
    """Numbers of the stems that weigh something (in order), and for each its subjects, of which complement() leaves two at most (-1: none), with their weights."""

    def __init__(self, n: int, keys, j0, j1, w0, w1) -> None:
        self.n, self.keys = n, np.asarray(keys, np.int64)
        self.j0, self.j1 = np.asarray(j0, np.int8 if n < 128 else np.int32), np.asarray(j1, np.int8 if n < 128 else np.int32)
        self.w0, self.w1 = np.asarray(w0, np.float64), np.asarray(w1, np.float64)

    @staticmethod
    def pack(keys: np.ndarray, w: np.ndarray) -> Weights:
        rows = np.arange(len(keys))
        some = w != 0
        j0 = some.argmax(1) if w.shape[1] else np.zeros(len(keys), np.int64)
        j1 = w.shape[1] - 1 - some[:, ::-1].argmax(1) if w.shape[1] else j0
        if w.shape[1] and (some.sum(1) > 2).any():
            raise ValueError("a stem weighs for two subjects at most")
        j0, j1 = np.where(some.any(1), j0, -1), np.where(some.sum(1) > 1, j1, -1)
        return Weights(w.shape[1], keys, j0, j1, np.where(j0 >= 0, w[rows, j0], 0.0), np.where(j1 >= 0, w[rows, j1], 0.0))

    def of(self, stem: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys and weights, stems x subjects, of those of some stems (in order) that weigh something."""
        if not len(self.keys) or not len(stem):
            return np.zeros(0, np.int64), np.zeros((0, self.n))
        place = np.minimum(np.searchsorted(self.keys, stem), len(self.keys) - 1)
        place = place[self.keys[place] == stem]
        w = np.zeros((len(place), self.n))
        for j, x in ((self.j0, self.w0), (self.j1, self.w1)):
            rows = np.flatnonzero(j[place] >= 0)
            w[rows, j[place[rows]]] = x[place[rows]]
        return self.keys[place], w


def no_model(names: list[str]) -> Model:
    return Model(names, np.zeros(0, np.int64), np.zeros((0, len(names))), np.zeros(len(STEPS) + 1))


class Block:
    """Some documents by their stems: label and script of each, the distinct stems (in order), then sentence after sentence the place of each stem among them, the stems of each sentence,
    the sentences of each document, and document and place of each distinct stem of each document."""

    FIELDS = ("ids", "label", "script", "stem", "at", "per", "sents", "doc", "place")

    def __init__(self, ids, label, script, stem, at, per, sents, doc=None, place=None) -> None:
        self.ids, self.stem = np.asarray(ids, np.int64), np.asarray(stem, np.int64)
        self.label, self.script, self.at, self.per, self.sents = (np.asarray(x, np.int64) for x in (label, script, at, per, sents))
        self.sent_of = np.repeat(np.arange(len(self.per)), self.per)
        self.doc_of = np.repeat(np.arange(len(self.sents)), self.sents)
        if doc is None:
            v = np.int64(max(1, len(self.stem)))
            p = np.unique(self.doc_of[self.sent_of] * v + self.at) if len(self.at) else np.zeros(0, np.int64)
            doc, place = p // v, p % v
        self.doc, self.place = np.asarray(doc, np.int64), np.asarray(place, np.int64)

    @staticmethod
    def of(docs: list[tuple[int, int, list[list[int]]]]) -> Block:
        """Of (id, label, numbers of each sentence) documents."""
        flat = np.array([i for _, _, d in docs for u in d for i in u], np.int64)
        stem, at = np.unique(flat, return_inverse=True)
        per, sents = [len(u) for _, _, d in docs for u in d], [len(d) for _, _, d in docs]
        b = Block([i for i, _, _ in docs], [k for _, k, _ in docs], [0] * len(docs), stem, at, per, sents)
        # the script of most of a document's distinct stems
        lean = np.zeros((len(docs), len(SCRIPTS)))
        np.add.at(lean, (b.doc, stem[b.place] & 3), 1.0)
        b.script = lean.argmax(1)
        return b

    def to_bytes(self) -> bytes:
        """The lengths of the fields, then the fields; ids and stems take 8 bytes each, the rest 4."""
        fields = [getattr(self, f).astype(np.int64 if f in ("ids", "stem") else np.int32) for f in self.FIELDS]
        return b"".join([np.array([len(x) for x in fields], np.int64).tobytes(), *(x.tobytes() for x in fields)])

    @staticmethod
    def from_bytes(data) -> Block:
        lengths = np.frombuffer(data, np.int64, len(Block.FIELDS))
        fields, at = [], lengths.nbytes
        for f, k in zip(Block.FIELDS, lengths.tolist(), strict=True):
            fields.append(np.frombuffer(data, np.int64 if f in ("ids", "stem") else np.int32, k, at))
            at += fields[-1].nbytes
        return Block(*fields)

    def evidence(self, keys: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Weights of each sentence's stems by subject: sentences x subjects."""
        z = np.zeros((len(self.per), w.shape[1]))
        if len(keys) and len(self.at):
            place = np.minimum(np.searchsorted(keys, self.stem), len(keys) - 1)
            own = np.where((keys[place] == self.stem)[:, None], w[place], 0.0)
            hit = np.flatnonzero(own.any(1)[self.at])
            s, a = self.sent_of[hit], self.at[hit]
            for j in range(w.shape[1]):
                z[:, j] = np.bincount(s, own[a, j], len(self.per))
        return z

    def by_document(self, x: np.ndarray) -> np.ndarray:
        """Sums over the sentences of each document: documents x columns of x."""
        return np.stack([np.bincount(self.doc_of, x[:, j], len(self.sents)) for j in range(x.shape[1])], 1) if x.shape[1] else np.zeros((len(self.sents), 0))


def complement(held: np.ndarray, total: np.ndarray, docs: np.ndarray, all_docs: np.ndarray, alpha: float = ALPHA) -> np.ndarray:
    """Weight of each stem (row) for each subject (column): log odds of the subject where the stem is, less its log odds anywhere. A stem of more than two subjects tells none of them."""
    w = np.log(held + alpha) - np.log(np.maximum(total[:, None] - held, 0) + alpha) - np.log(docs) + np.log(np.maximum(all_docs - docs, 1.0))
    w = np.where((w >= LEAST_WEIGHT) & (w >= w.max(1, keepdims=True) - 1.0), np.minimum(w, 4.0), 0.0)
    return np.where((w > 0).sum(1, keepdims=True) > 2, 0.0, w)


def expected(speak: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How far documents (rows) of size sentences, speak of which speak for a subject (column), count for it."""
    gamma = 1 / (1 + np.exp(-1.6 * (speak - np.maximum(NEEDED, 0.14 * size)[:, None])))
    return gamma / np.maximum(1.0, gamma.sum(1, keepdims=True) / MOST)


def sums(b: Block, n: int, keys: np.ndarray, w: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Columns id, seen, total, one a subject: sums over the documents of a block by stem, and by script under the ids -1 and below. first: weight of a sample by script."""
    sample = b.label >= 0
    gamma = np.zeros((len(b.ids), n))
    if len(keys):
        gamma = expected(b.by_document((b.evidence(keys, w) >= DEALS_FROM).astype(float)), b.sents.astype(float))
    gamma[sample] = 0.0
    mine = np.flatnonzero(sample & (b.label < n))
    gamma[mine, b.label[mine]] = 1.0
    weight = np.round(np.where(sample, first[b.script], 1.0) * GRAIN) / GRAIN
    part = np.round(gamma * weight[:, None] * GRAIN) / GRAIN
    d, p = b.doc, b.place
    seen = np.bincount(p, minlength=len(b.stem))
    # scripts share no stems, so each has its own documents and odds
    own = b.script[d] == (b.stem & 3)[p]
    d, p = d[own], p[own]
    groups = np.arange(len(SCRIPTS))
    out = [np.concatenate([b.stem, -1 - groups]), np.concatenate([seen, np.bincount(b.script, minlength=len(groups))])]
    for x in (weight, *part.T):
        out.append(np.concatenate([np.bincount(p, x[d], len(b.stem)), np.bincount(b.script, x, len(groups))]))
    return out


def merged(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Columns of sums() added up by id."""
    ids, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    rest = [np.bincount(at, np.concatenate([p[c] for p in parts]), len(ids)) for c in range(1, len(parts[0]))]
    return [ids, rest[0].astype(np.int64), *rest[1:]]


def start_weights(documents: dict[int, int], samples: dict[int, int]) -> np.ndarray:
    """Weight of a sample by script, from how many documents and samples there are of each."""
    return np.clip([ANCHOR * documents.get(s, 0) / max(samples.get(s, 0), 1) for s in range(len(SCRIPTS))], 1.0, 10.0)


def calibrated(labelled: Block, n: int, known: np.ndarray, columns: list[np.ndarray], whole: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The posterior by step of the evidence (STEPS) from labelled documents, each scored by weights that leave it out.

    known and columns are the ids and sums of the labelled documents' stems, whole the sums by script, first the weight that each sample had in them.
    """
    seen, total, held = columns[0], columns[1], np.stack(columns[2:], 1)
    zs, ys = [], []
    begin = np.concatenate([[0], np.cumsum(labelled.per)])
    s0 = 0
    for d, k in enumerate(labelled.label):
        s1 = s0 + labelled.sents[d]
        flat = labelled.stem[labelled.at[begin[s0] : begin[s1]]]
        script, weight = labelled.script[d], np.round(first[labelled.script[d]] * GRAIN) / GRAIN
        own = np.unique(flat)
        at = np.searchsorted(known, own)
        mine = (own & 3) == script
        h, t = held[at].copy(), total[at] - np.where(mine, weight, 0.0)
        docs, everything = whole[own & 3, 1:].copy(), whole[own & 3, 0].copy()
        everything[mine] -= weight
        if k < n:
            h[mine, k] -= weight
            docs[mine, k] -= weight
        w = complement(np.maximum(h, 0), t, np.maximum(docs, 0) + 1e-3, everything[:, None])
        w[seen[at] < 3] = 0  # two besides itself
        z = np.stack([np.bincount(np.repeat(np.arange(s1 - s0), labelled.per[s0:s1]), w[np.searchsorted(own, flat), j], s1 - s0) for j in range(n)], 1) if s1 > s0 else np.zeros((0, n))
        zs.append(z)
        ys.append(np.full(len(z), k))
        s0 = s1
    z, k = np.concatenate(zs), np.concatenate(ys)
    own = np.zeros(z.shape, bool)
    rows = np.flatnonzero(k < n)
    own[rows, k[rows]] = True
    step = np.digitize(z, STEPS)
    size = len(STEPS) + 1
    others = (np.bincount(step[~own], minlength=size) + 0.5) / ((~own).sum() + 1)
    mine = (np.bincount(step[own], minlength=size) + 0.5) / (own.sum() + 1)
    idle = min(1.0, mine[0] / others[0])  # share of a sample's sentences that deal with nothing
    dealing = np.clip(1 - idle * others / mine, 0.0, 1.0)
    n_all, n_own = np.bincount(step.ravel(), minlength=size), np.bincount(step[own], minlength=size)
    # a step of few sentences is held near the share of all, as if two more of such had been seen
    deals = dealing * n_own
    return rising((deals + 2 * deals.sum() / n_all.sum()) / (n_all + 2), n_all)


def rising(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing steps nearest to value (isotonic regression by pooling neighbours); steps without weight take that of the step before."""
    pools: list[list[float]] = []
    for v, w in zip(value, weight, strict=True):
        pools.append([float(v) * w, float(w), 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            v0, w0, n0 = pools.pop()
            pools[-1] = [pools[-1][0] + v0, pools[-1][1] + w0, pools[-1][2] + n0]
    return np.repeat([v / w if w else 0.0 for v, w, _ in pools], [n for _, _, n in pools])


def labelled_rows(labelled: list[tuple[str, str]], names: list[str]) -> list[tuple[str, int]]:
    """(text, place of its subject in names, behind them for none) of the (subject, text) rows that count."""
    k = {s: i for i, s in enumerate(names)}
    return [(t, k.get(s, len(names))) for s, t in labelled if t and (s in k or s == "none")]


def numbered(text: str, form: str | None) -> list[list[int]]:
    return [[number(x) for x in stems(u)] for u in sentences(text, form)]


def fit(labelled: list[tuple[str, str]], unlabelled: list[tuple[str, str | None]], names: list[str], rounds: int = 8) -> Model:
    """From (subject, text) rows, subject 'none' for no subject, and (text, form) documents, in one place; maximized.maximize() does the same over a table. Without rows the model finds nothing."""
    n = len(names)
    known = labelled_rows(labelled, names)
    if not any(k < n for _, k in known):
        return no_model(names)
    samples = Block.of([(0, k, numbered(t, None)) for t, k in known])
    docs = Block.of([(0, -1, numbered(t, f)) for t, f in unlabelled if t])
    count = lambda b: dict(zip(*(x.tolist() for x in np.unique(b.script, return_counts=True)), strict=True))
    start = start_weights(count(docs), count(samples))
    keys, w = np.zeros(0, np.int64), np.zeros((0, n))
    for turn in range(rounds):
        first = np.maximum(1.0, start * LATER**turn)
        got = merged([sums(b, n, keys, w, first) for b in (samples, docs)])
        here = got[0] >= 0
        whole = np.stack(got[2:], 1)[~here][::-1]
        ids, columns = got[0][here], [c[here] for c in got[1:]]
        w = weighed(ids, columns, whole)
        kept = np.flatnonzero(w.any(1))
        keys, w = ids[kept], w[kept]
    return Model(names, keys, w, calibrated(samples, n, ids, columns, whole, first))


def weighed(ids: np.ndarray, columns: list[np.ndarray], whole: np.ndarray) -> np.ndarray:
    """Weights of stems (rows) from their columns seen, total, one a subject, and the sums by script; a stem seen once has none."""
    w = complement(np.stack(columns[2:], 1), columns[1], whole[ids & 3, 1:] + 1e-3, whole[ids & 3, :1])
    w[columns[0] < 2] = 0
    return w


def dealing(model: Model, b: Block, over: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Sentences of each document that deal with each subject, and each subject's mean posterior: documents x subjects."""
    z = b.evidence(model.keys, model.w)
    p = model.levels[np.digitize(z, STEPS)]
    return b.by_document((p > over).astype(float)).astype(np.int64), b.by_document(p) / np.maximum(b.sents, 1)[:, None]


def dealt_with(model: Model, text: str | None, form: str | None) -> tuple[int, np.ndarray, np.ndarray]:
    """Sentences of one document, those that deal with each subject, and each subject's mean posterior."""
    b = Block.of([(0, -1, numbered(text, form) if text else [])])
    hits, mean = dealing(model, b)
    return int(b.sents[0]), hits[0], mean[0]


def least(total: int) -> int:
    """Sentences that a subject needs: two, and a fifth of all."""
    return max(2, math.ceil(total / 5))
