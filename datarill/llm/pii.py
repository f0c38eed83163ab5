"""Personal data by a linear-chain conditional random field over word shapes.

Base spans come from the four fixed patterns with their checks. On top, a
conditional random field tags the tokens around digits, ``@`` and spelled-out
separators as e-mail address, IP address, card number, phone number or other.
Its features are the shapes of a token and of two neighbours on each side, and
whether blanks stand between them. It is trained on the driver from the labelled
table in pii_examples (about 60 sentences) by gradient ascent on the
regularised conditional likelihood; the weights are broadcast. All segments of an
Arrow batch are padded and decoded together by Viterbi in numpy. Tagged spans
that fail their kind's check or overlap a base span are dropped; base spans always
stay. Tokens away from digits, ``@`` and spelled-out separators are other.

Rows don't move and every text is searched whole; all steps take time linear in
its length.

Defined results: null texts are empty and have no spans; repeated rows stay
repeated; offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .pii_examples import EXAMPLES

KINDS = ["email", "ip", "card", "phone"]
_RANK = {k: i for i, k in enumerate(KINDS)}

# Base patterns. Possessive runs and the look-behinds change no match, as a match that
# could begin inside a run of digits begins at its start, and keep long runs linear.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def valid_card(text: str) -> bool:
    d = _digits(text)
    return 12 <= len(d) <= 19 and luhn(d)


def valid_ip(text: str) -> bool:
    parts = [p.lstrip("0") for p in text.split(".")]
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in parts)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, by start and then kind."""
    out = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            last = m.end()
            out.append((start, last, "email"))
        at = text.find("@", max(at + 1, last))
    if _DIGIT.search(text):
        out += [(*m.span(), "ip") for m in _IP.finditer(text) if valid_ip(m.group())]
        out += [(*m.span(), "card") for m in _CARD.finditer(text) if valid_card(m.group())]
        if "+" in text:
            out += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[0], _RANK[s[2]], s[1]))


# ---- tokens and features

_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\s]")
_TRIGGER = re.compile(r"[@0-9][@0-9.,:-]*|\bdot\b|[\[(](?:at|dot)[\])]")
#: Characters on each side of a trigger that are tagged with it, and then up to the second blank from there.
AROUND = 40
_BLANK = re.compile(r"\s")
_CUES = frozenset("at dot mail email phone tel fax call ring mobile number card visa paid ip host server from version section the".split())  # fixed values
_OFFSETS = (-2, -1, 0, 1, 2)


def shape(token: str) -> str:
    """A cue word or punctuation mark itself; else its letter case or its number of digits."""
    low = token.lower()
    if low in _CUES:
        return low
    c = token[0]
    if "0" <= c <= "9":
        return f"d{len(token)}" if len(token) < 6 else "d6" if len(token) < 12 else "d12" if len(token) <= 19 else "d20"
    if c.isalpha():
        return "Xx" if c.isupper() and not token[1:].isupper() else "X" if c.isupper() else "x"
    return token


def tokens(text: str, start: int = 0, end: int | None = None) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text, start, len(text) if end is None else end)]


def features(text: str, spans: list[tuple[int, int]]) -> list[list[str]]:
    shapes = [shape(text[a:b]) for a, b in spans]
    tight = ["t" if i and spans[i - 1][1] == a else "s" for i, (a, _) in enumerate(spans)] + ["s"]
    n = len(spans)
    at = lambda i: shapes[i] if 0 <= i < n else "|"
    return [
        [f"{o}={at(i + o)}" for o in _OFFSETS]
        + [f"{at(i - 1)}{tight[i]}{shapes[i]}", f"{shapes[i]}{tight[i + 1]}{at(i + 1)}", f"{tight[i]}{tight[i + 1]}{shapes[i]}", f"{at(i - 1)}{tight[i]}{shapes[i]}{tight[i + 1]}{at(i + 1)}"]
        for i in range(n)
    ]


class Tagger:
    """Linear-chain CRF: emission weights by feature, transition weights, start weights."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.index, self.emit, self.move = index, emit, move
        self.memo: dict[tuple, np.ndarray] = {}

    def emissions(self, feats: list[list[str]]) -> np.ndarray:
        get, last = self.index.get, len(self.index)
        return self.emit[np.array([[get(f, last) for f in fs] for fs in feats])].sum(axis=1)

    def viterbi(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        """The best states of each row of emissions; rows of like length are decoded together."""
        out: list[np.ndarray] = [np.empty(0, int)] * len(rows)
        order = sorted((i for i in range(len(rows)) if len(rows[i])), key=lambda i: len(rows[i]))
        at = 0
        while at < len(order):
            part, cells = [], 0
            while at < len(order) and (not part or len(rows[order[at]]) * (len(part) + 1) <= 200_000):
                part.append(order[at])
                at += 1
            lengths = np.array([len(rows[i]) for i in part])
            width, k = lengths.max(), len(self.move)
            x = np.zeros((width, len(part), k))
            for j, i in enumerate(part):
                x[: lengths[j], j] = rows[i]
            back = np.zeros((width, len(part), k), dtype=np.int8)
            score = x[0].copy()
            final = score.copy()
            for t in range(1, width):
                paths = score[:, :, None] + self.move[None]
                back[t] = paths.argmax(axis=1)
                score = paths.max(axis=1) + x[t]
                live = lengths > t
                final[live] = score[live]
            states = np.zeros((width, len(part)), dtype=np.int8)
            now = final.argmax(axis=1)
            lanes = np.arange(len(part))
            for t in range(width - 1, -1, -1):
                ends = lengths - 1 == t
                now = np.where(ends, final.argmax(axis=1), now)
                states[t] = now
                now = np.where(lengths > t, back[t, lanes, now], now)
            for j, i in enumerate(part):
                out[i] = states[: lengths[j], j]
        return out


def read_examples(lines: list[str]) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Texts and their marked spans."""
    out = []
    mark = re.compile(r"\[(email|ip|card|phone):((?:[^\[\]]|\[(?:at|dot|\.)\])*)\]")
    for line in lines:
        text, spans, last = "", [], 0
        for m in mark.finditer(line):
            text += line[last : m.start()]
            spans.append((len(text), len(text) + len(m[2]), m[1]))
            text += m[2]
            last = m.end()
        out.append((text + line[last:], spans))
    return out


def train(lines: list[str] = EXAMPLES, epochs: int = 150, ridge: float = 0.02) -> Tagger:
    """Maximises the conditional log-likelihood minus the ridge by Adam; all sentences at once, deterministic."""
    k = len(KINDS) + 1
    feats, gold, index = [], [], {}
    for text, spans in read_examples(lines):
        toks = tokens(text)
        fs = features(text, toks)
        for f in (x for row in fs for x in row):
            index.setdefault(f, len(index))
        feats.append(fs)
        gold.append([next((_RANK[kind] + 1 for a, b, kind in spans if a <= s and e <= b), 0) for s, e in toks])
    n, width, per = len(feats), max(map(len, feats)), len(feats[0][0])
    ids = np.full((n, width, per), len(index))
    y, mask = np.zeros((n, width), int), np.zeros((n, width), bool)
    for i, fs in enumerate(feats):
        ids[i, : len(fs)] = [[index[f] for f in row] for row in fs]
        y[i, : len(fs)], mask[i, : len(fs)] = gold[i], True
    emit, move = np.zeros((len(index) + 1, k)), np.zeros((k, k))
    one = np.eye(k)[y] * mask[..., None]
    seen_move = np.einsum("nta,ntb->ab", one[:, :-1], one[:, 1:])
    moments = [np.zeros_like(emit), np.zeros_like(move), np.zeros_like(emit), np.zeros_like(move)]
    lse = lambda v, axis: (m := v.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(v - m).sum(axis=axis))
    for epoch in range(1, epochs + 1):
        x = emit[ids].sum(axis=2)
        fwd, bwd = np.zeros((n, width, k)), np.zeros((n, width, k))
        fwd[:, 0] = x[:, 0]
        for t in range(1, width):
            step = lse(fwd[:, t - 1][:, :, None] + move[None], 1) + x[:, t]
            fwd[:, t] = np.where(mask[:, t, None], step, fwd[:, t - 1])
        for t in range(width - 2, -1, -1):
            step = lse(move[None] + (x[:, t + 1] + bwd[:, t + 1])[:, None, :], 2)
            bwd[:, t] = np.where(mask[:, t + 1, None], step, 0.0)
        z = lse(fwd[:, -1], 1)
        node = np.exp(fwd + bwd - z[:, None, None]) * mask[..., None]
        pair = np.exp(fwd[:, :-1, :, None] + move + (x[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
        g_emit, g_move = np.zeros_like(emit), seen_move - pair.sum(axis=(0, 1)) - ridge * move
        np.add.at(g_emit, ids, np.repeat((one - node)[:, :, None, :], per, axis=2))
        g_emit -= ridge * emit
        g_emit[-1] = 0
        for w, g, m1, m2 in ((emit, g_emit, 0, 2), (move, g_move, 1, 3)):
            moments[m1] = 0.9 * moments[m1] + 0.1 * g
            moments[m2] = 0.99 * moments[m2] + 0.01 * g * g
            w += 0.1 * (moments[m1] / (1 - 0.9**epoch)) / (np.sqrt(moments[m2] / (1 - 0.99**epoch)) + 1e-8)
    return Tagger(index, emit, move)


def segments(text: str) -> list[tuple[int, int]]:
    """The parts of a text around its triggers, widened to blanks, apart from each other; no token is cut."""
    out: list[tuple[int, int]] = []
    last = 0  # where the part before ends; nothing before it is looked at again
    for m in _TRIGGER.finditer(text):
        a, b = max(last, m.start() - AROUND), m.end() + AROUND
        if b > last or not out:
            for _ in range(2):  # to the end of the word, and then the next word
                blank = _BLANK.search(text, b + 1) if b + 1 < len(text) else None
                b = blank.start() if blank else len(text)
        else:
            b = last
        for _ in range(2):
            if a > last:
                a = max(last, *(text.rfind(c, last, a - 1) + 1 for c in " \n\t\r"))
        if out and a <= last:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
        last = b
    return out


#: Four numbers with dots that may be spelled out or bracketed.
_ADDRESS = re.compile(r"[0-9]+(?:\s*(?:\.|[\[(]\.[\])]|[\[(]dot[\])]|\bdot\b)\s*[0-9]+){3}")


def _plausible(kind: str, text: str) -> bool:
    d = _digits(text)
    if kind == "email":
        spelled = re.search(r"\bat\b", text) and re.search(r"\bdot\b", text)
        return bool("@" in text and "." in text or spelled) and text[0].isalnum() and text[-1].isalnum()
    if kind == "ip":
        return _ADDRESS.fullmatch(text) is not None and valid_ip(".".join(re.findall("[0-9]+", text)))
    if kind == "card":
        return valid_card(text) and re.fullmatch(r"[0-9][0-9 -]+[0-9]", text) is not None
    return 9 <= len(d) <= 15 and re.fullmatch(r"[+(]?[0-9][0-9 ().-]*[0-9]", text) is not None and not d.isspace() and bool(re.search(r"[ ().+-]", text)) and max(map(len, re.findall("[0-9]+", text))) <= 8


def tag(texts: list[str], tagger: Tagger) -> list[list[tuple[int, int, str]]]:
    """The tagger's own plausible spans of each text."""
    where, rows = [], []
    for i, text in enumerate(texts):
        for a, b in segments(text):
            toks = tokens(text, a, b)
            if toks:
                where.append((i, toks))
                rows.append(tagger.emissions(features(text, toks)))
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for (i, toks), states in zip(where, tagger.viterbi(rows)):
        hot = np.flatnonzero(states)
        cuts = np.flatnonzero((np.diff(hot) > 1) | (np.diff(states[hot]) != 0)) + 1
        for run in np.split(hot, cuts) if len(hot) else []:
            a, b, kind = toks[run[0]][0], toks[run[-1]][1], KINDS[states[run[0]] - 1]
            if _plausible(kind, texts[i][a:b]):
                out[i].append((a, b, kind))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def spans_of(texts: list[str], tagger: Tagger) -> list[tuple[list, list]]:
    """Base spans and all spans of each text."""
    out = []
    for text, more in zip(texts, tag(texts, tagger)):
        base = base_spans(text)
        extra = [s for s in more if not any(s[0] < b and a < s[1] for a, b, _ in base)] if base else more
        out.append((base, sorted(base + extra, key=lambda s: (s[0], _RANK[s[2]], s[1]))))
    return out


_TAGGERS: dict[str, Tagger] = {}


def find_pii(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """doc_id, counts of base spans, base_sha256 and spans of every row of docs(doc_id, text, ...)."""
    tagger = tagger or train()
    state = (tagger.index, tagger.emit, tagger.move)
    digest = hashlib.sha256(repr(tagger.index).encode() + tagger.emit.tobytes() + tagger.move.tobytes()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast((digest, state))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, state = shared.value
        if digest not in _TAGGERS:
            _TAGGERS.clear()
            _TAGGERS[digest] = Tagger(*state)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                found = spans_of([t or "" for t in part.column(1).to_pylist()], _TAGGERS[digest])
                counts = [pa.array([sum(s[2] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
                digests = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, pa.array(digests, pa.string()), pa.array([joined(s) for _, s in found], pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
