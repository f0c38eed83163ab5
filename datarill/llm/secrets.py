"""Secret scan: fixed patterns, and values in credential context that are hard to guess.

Base spans come from the three fixed patterns. On top, the value behind a
credential word (``pwd: ...``, ``passphrase is ...``, ``Bearer ...``) is judged by
its guess cost: the least total of log10 guesses over all ways to cut it into
dictionary words, dates, keyboard walks, sequences, repeats and brute-force
characters, found by dynamic programming over its positions. Values of at least
GUESSES are secrets; placeholders such as ``changeme`` or ``12345678``, and plain
words, cost little and aren't. The program stops early once no later position can
end below the bound, so a value takes time linear in its length.

The dictionary has the common passwords first and then the whole words of the
public tokenizers' vocabularies in the order of their ranks, which follows their
frequency: about 38,000 words of several languages. It is read by the driver,
checked against MAX_WORDS, and broadcast. Rows don't move and every text is
searched whole.

Defined results: null texts are empty and have no spans; repeated rows stay
repeated; offsets are code points, ends exclusive; added spans have the kind
``guess``, leave out closing punctuation, and never overlap a base span.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

KINDS = ["assign", "access", "hex", "guess"]
_RANK = {k: i for i, k in enumerate(KINDS)}
#: log10 guesses from which on a value is a secret, and its least length.
GUESSES, LEAST = 9.0, 8
#: Longest piece that the segmentation takes at once.
PIECE = 40
#: Words of the dictionary at most, and the shortest and longest that it takes.
MAX_WORDS, SHORTEST, LONGEST = 500_000, 3, 24
#: Rank files of public tokenizers that the dictionary is read from.
VOCABULARIES = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_CUES = ("pass", "pwd", "secret", "token", "api", "cred", "bearer")
_CONTEXT = re.compile(
    r"""(?<![A-Za-z])(?:pass(?:word|phrase|code|wd)?|pwd|(?:client[_-]?)?secret|(?:auth[_-]?)?token|api[_-]?key|credentials?|(bearer))["']?(?(1)\x20+|(?:\x20*[:=]\x20*|\x20+is\x20+))["']?([^\s"'<>,;]+)""",
    re.I | re.A,
)

#: Common passwords and words in falling frequency (fixed values).
WORDS = (
    "password 123456 qwerty admin welcome login letmein secret monkey dragon master hello freedom whatever shadow sunshine princess "
    "football baseball superman batman trustno access changeme default example sample test user guest root pass love iloveyou money "
    "summer winter spring autumn monday friday january june july december the and for you with that this have from they will would "
    "there their what about which when make like time just know take people into year your good some could them other than then look "
    "only come over think also back after work first well even want because these give most token key value string here none null "
    "true false placeholder insert enter required optional hidden redacted your my new old temp dummy foo bar baz abc xyz"
).split()
_LEET = str.maketrans("0134578@$!", "oleastbasi")
_ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
#: What ends a sentence or bracket and not a value.
_CLOSING = ".!?)]}:"
_PLACE = {c: (r, i + r * 0.5) for r, row in enumerate(_ROWS) for i, c in enumerate(row)}
_DATES = re.compile(r"(?:(?:19|20)\d\d[-/.]?(?:0?[1-9]|1[0-2])[-/.]?(?:[0-2]?\d|3[01])|(?:[0-2]?\d|3[01])[-/.]?(?:0?[1-9]|1[0-2])[-/.]?(?:19|20)\d\d)(?!\d)|(?:19|20)\d\d")


def _brute(c: str) -> float:
    if c.isdigit():
        return 1.0
    if c.isascii():
        return math.log10(26) if c.isalpha() else math.log10(33)
    return 2.0


def _near(a: str, b: str) -> bool:
    p, q = _PLACE.get(a), _PLACE.get(b)
    return p is not None and q is not None and a != b and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1


class Dictionary(dict):
    """Words and their log10 guesses."""

    def __init__(self, words: list[str]):
        super().__init__((w, math.log10(2 + i)) for i, w in reversed(list(enumerate(words))))
        self.longest = max(map(len, words), default=0)


def read_words(paths: list[str] | None = None) -> list[str]:
    """The dictionary's words by falling frequency: WORDS, then those of rank files, one of each in turn."""
    lists = []
    for path in paths if paths is not None else [public_tokenizers.path(v) for v in VOCABULARIES]:
        with open(path, "rb") as file:
            tokens = [base64.b64decode(line.split()[0]) for line in file]
        texts = [t[1:].decode("utf-8", "replace").lower() for t in tokens if t[:1] == b" "]
        lists.append([t for t in texts if t.isalpha() and SHORTEST <= len(t) <= LONGEST])
    turns = [w for i in range(max(map(len, lists), default=0)) for x in lists for w in x[i : i + 1]]
    words = list(dict.fromkeys([*WORDS, *turns]))
    if len(words) > MAX_WORDS:
        raise ValueError(f"{len(words)} words; {MAX_WORDS} at most are broadcast")
    return words


def guess_cost(value: str, words: Dictionary, enough: float = math.inf) -> float:
    """The least log10 guesses of a value; may stop at any figure of at least ``enough`` once the least can't be below it."""
    low = value.lower()
    plain = low.translate(_LEET)
    n = len(value)
    dates: dict[int, set[int]] = {}
    for m in _DATES.finditer(value):
        dates.setdefault(m.end(), set()).add(m.start())
    cost = [0.0] + [math.inf] * n
    walk = run = 1
    step = 0
    same = [0] * 9  # same[p]: how far back every character equals the one p before it
    for j in range(1, n + 1):
        c = low[j - 1]
        best = cost[j - 1] + _brute(value[j - 1])
        if j > 1:
            before = low[j - 2]
            walk = walk + 1 if _near(before, c) else 1
            d = ord(c) - ord(before)
            run = run + 1 if d in (-1, 1) and d == step else 2 if d in (-1, 1) else 1
            step = d
        for length in range(3, min(walk, PIECE) + 1):
            best = min(best, cost[j - length] + 1.7 + 0.35 * (length - 1))
        for length in range(3, min(run, PIECE) + 1):
            best = min(best, cost[j - length] + 1.4 + math.log10(length))
        for p in range(1, 9):
            same[p] = same[p] + 1 if j > p and low[j - 1 - p] == c else 0
            for length in range(max(2 * p, 3), min(same[p] + p, PIECE) + 1):
                # The block that is repeated costs what it adds where it stands first.
                i = j - length
                block = sum(map(_brute, value[i : i + p]))
                best = min(best, cost[i] + min(block, max(0.0, cost[i + p] - cost[i])) + math.log10(length / p) + 0.3)
        for length in range(2, min(words.longest, j) + 1):
            i = j - length
            rank = words.get(low[i:j])
            turned = 0.0
            if rank is None and (rank := words.get(plain[i:j])) is not None:
                turned = 0.6
            if rank is not None:
                best = min(best, cost[i] + rank + turned + 0.3 * (value[i:j] != low[i:j]) + 0.3)
        for i in dates.get(j, ()):
            best = min(best, cost[i] + (2.1 if j - i == 4 else 4.6))
        cost[j] = best
        if j >= PIECE and best >= enough and min(cost[j - PIECE : j + 1]) >= enough:
            return best
    return cost[n]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, by start and then kind."""
    out = []
    if "=" in text or ":" in text:
        out += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], _RANK[s[2]], s[1]))


def guessed_spans(text: str, words: Dictionary) -> list[tuple[int, int, str]]:
    """Values behind credential words whose guess cost is at least GUESSES."""
    low = text.lower()
    if not any(c in low for c in _CUES):
        return []
    out = []
    for m in _CONTEXT.finditer(text):
        value = m[2].rstrip(_CLOSING)
        if len(value) >= LEAST and guess_cost(value, words, GUESSES) >= GUESSES:
            out.append((m.start(2), m.start(2) + len(value), "guess"))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def spans_of(text: str, words: Dictionary) -> tuple[list, list]:
    """Base spans and all spans of a text."""
    base, more = base_spans(text), guessed_spans(text, words)
    extra = [s for s in more if not any(s[0] < b and a < s[1] for a, b, _ in base)]
    return base, sorted(base + extra, key=lambda s: (s[0], _RANK[s[2]], s[1]))


_DICTIONARIES: dict[str, Dictionary] = {}


def find_secrets(docs: DataFrame, words: list[str] | None = None) -> DataFrame:
    """doc_id, counts of base spans, base_sha256 and spans of every row of docs(doc_id, text, ...); words has the dictionary by falling frequency."""
    words = read_words() if words is None else words
    shared = docs.sparkSession.sparkContext.broadcast((hashlib.sha256(" ".join(words).encode()).hexdigest(), words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, words = shared.value
        if digest not in _DICTIONARIES:
            _DICTIONARIES.clear()
            _DICTIONARIES[digest] = Dictionary(words)
        known = _DICTIONARIES[digest]
        for b in batches:
            found = [spans_of(t or "", known) for t in b.column(1).to_pylist()]
            counts = [pa.array([sum(s[2] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS[:3]]
            digests = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array(digests, pa.string()), pa.array([joined(s) for _, s in found], pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
