"""Benchmark decontamination by template canonicalisation.

Documents and benchmark items become token sequences in which numbers, names
and units are typed placeholders: a name is a capitalised word that doesn't
begin a sentence or line. Windows of WINDOW tokens are matched by a 64-bit hash
and then token by token. For each pair of a document and an item the slots'
values must be consistent: over all matched windows one value of the item stands
for one value in the document; windows against the majority don't count. So an
item whose numbers were replaced throughout is found, and a text that merely
shares a phrase with other numbers in each place isn't.

The benchmark is broadcast while it has at most MAX_WINDOWS windows and
MAX_CHARS times as many characters; the probe is then a hash join inside each
Python worker and no document moves. Beyond that bound the hashes of the
documents' windows are joined to the benchmark's by a shuffle, which gives
candidate pairs of a document and an item, and each pair is judged by the same
code on its two texts. Each document is searched whole.

Defined results: null texts are empty and match nothing; items of fewer tokens
than WINDOW match as one window; windows with fewer than MIN_LITERAL literal
tokens are left out on both sides; an item that has no other windows and at least
MIN_EXACT tokens matches where all its tokens stand as they are, and one with
fewer tokens matches nothing; null item texts are skipped, items repeated with the
same id and text count once; an empty benchmark matches nothing; repeated rows
are judged alike and stay repeated, at any size of the benchmark.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import materialize, table

WINDOW = 8
MIN_LITERAL = 4
#: Consistent windows of one item that make a document contaminated; all of them where the item has fewer.
MIN_WINDOWS = 2
#: Tokens of an item that is matched as it stands, at least.
MIN_EXACT = 5
#: Windows of the benchmark that are broadcast at most, and its characters as a multiple of that.
MAX_WINDOWS, MAX_CHARS = 2_000_000, 64
#: Tokens remembered per worker.
MEMO = 400_000

#: Words that count as units after lower-casing (fixed values).
UNITS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms tonne tonnes ounce ounces pound pounds "
    "ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years "
    "percent dollar dollars cent cents euro euros mph kph degree degrees celsius fahrenheit watt watts volt volts".split()
)

_TOKENS = re.compile(r"[^\W\d_]+|\d+(?:[.,:]\d+)*|[.!?\n]|[%$€£]").findall
_BASE = np.uint64(0x9E3779B97F4A7C15)
_NUMBER, _NAME, _UNIT, _END = 1, 2, 3, 4
_LITERAL, _CAPITAL = 5, 6


class Kinds(dict):
    """Token to (hash of its lower-cased form with the lowest three bits replaced by its kind)."""

    def __missing__(self, token: str) -> int:
        first, low = token[0], token.lower()
        if first in ".!?\n":
            kind = _END
        elif first.isdigit():
            kind = _NUMBER
        elif first in "%$€£" or low in UNITS:
            kind = _UNIT
        else:
            kind = _CAPITAL if first.isupper() else _LITERAL
        if len(self) >= MEMO:
            self.clear()
        found = self[token] = xxhash.xxh64_intdigest(low) >> 1 & ~7 | kind
        return found


_KINDS = Kinds()


def canonical(text: str) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Keys of the canonical tokens (1 to 3: a placeholder's kind), whether each is a placeholder, the tokens, and their keys as they stand."""
    tokens = _TOKENS(text)
    coded = np.fromiter(map(_KINDS.__getitem__, tokens), dtype=np.int64, count=len(tokens))
    kind = coded & 7
    ends = kind == _END
    after_end = np.ones(len(tokens), dtype=bool)
    after_end[1:] = ends[:-1]
    name = (kind == _CAPITAL) & ~after_end
    slot = name | (kind == _NUMBER) | (kind == _UNIT)
    plain = coded | 7
    keys = np.where(name, _NAME, np.where(slot, kind, plain))
    if ends.any():
        at = np.flatnonzero(~ends)
        return keys[at], slot[at], [tokens[i] for i in at.tolist()], plain[at]
    return keys, slot, tokens, plain


def window_hashes(keys: np.ndarray, slot: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the windows with enough literal tokens."""
    n = len(keys) - size + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    k = keys.view(np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        h = (h ^ k[j : j + n]) * _BASE
        h ^= h >> np.uint64(29)
    literal = np.concatenate([[0], np.cumsum(~slot)])
    at = np.flatnonzero(literal[size:] - literal[:-size] >= min(MIN_LITERAL, size))
    return at, h[at]


def item_windows(text: str) -> tuple[int, bool, np.ndarray, np.ndarray, tuple]:
    """Size of an item's windows, whether it is matched as it stands, their positions and hashes, and its canonical form.

    An item that is matched as it stands has one window, its first tokens.
    """
    form = keys, slot, _, plain = canonical(text)
    size = min(WINDOW, len(keys))
    none = np.empty(0, np.int64), np.empty(0, np.uint64)
    if not size:
        return 0, False, *none, form
    at, hashes = window_hashes(keys, slot, size)
    if len(at) or len(keys) < MIN_EXACT:
        return size, False, at, hashes, form
    return size, True, *window_hashes(plain[:size], np.zeros(size, dtype=bool), size), form


def text_windows(form: tuple, sizes: Iterable[tuple[int, bool]]) -> Iterator[tuple[tuple[int, bool], np.ndarray, np.ndarray]]:
    """Positions and hashes of a text's windows of each size, canonical or as they stand."""
    keys, slot, _, plain = form
    for size, exact in sizes:
        yield (size, exact), *(window_hashes(plain, np.zeros(len(plain), dtype=bool), size) if exact else window_hashes(keys, slot, size))


class Items:
    """The benchmark's windows by length and hash."""

    def __init__(self, rows: list[tuple]):
        self.items = []
        by_size: dict[tuple[int, bool], list[tuple[int, int, int]]] = defaultdict(list)
        for item_id, text in rows:
            size, exact, at, hashes, form = item_windows(text or "")
            if len(at):
                self.items.append((item_id, *form, size, len(at)))
                by_size[size, exact] += [(h, len(self.items) - 1, o) for o, h in zip(at.tolist(), hashes.tolist())]
        self.windows = {s: (np.array([x[0] for x in sorted(w)], dtype=np.uint64), sorted(w)) for s, w in by_size.items()}
        parts = [x[4] if exact else x[1] for (_, exact), (_, w) in self.windows.items() for x in (self.items[i] for i in {i for _, i, _ in w})]
        self.vocabulary = np.unique(np.concatenate(parts)) if parts else np.empty(0, np.int64)

    def matches(self, text: str) -> list[tuple]:
        """(item id, consistent windows, item's windows, whether slots differ) of each item that contaminates the text."""
        if not self.items or not text:
            return []
        form = keys, slot, tokens, plain = canonical(text)
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        whole: set[int] = set()
        known = self._known(keys)
        known_plain = self._known(plain) if any(exact for _, exact in self.windows) else known
        wanted = [(n, exact) for n, exact in self.windows if len(keys) >= n and ((known_plain if exact else known)[n:] - (known_plain if exact else known)[:-n] == n).any()]
        for (size, exact), at, h in text_windows(form, wanted):
            hashes, windows = self.windows[size, exact]
            low = np.searchsorted(hashes, h)
            hit = low < len(hashes)
            hit[hit] = hashes[low[hit]] == h[hit]
            for p, x, i in zip(at[hit].tolist(), h[hit].tolist(), low[hit].tolist()):
                while i < len(windows) and windows[i][0] == x:
                    _, item, offset = windows[i]
                    _, item_keys, _, _, item_plain, *_ = self.items[item]
                    if exact and np.array_equal(item_plain, plain[p : p + len(item_plain)]):
                        whole.add(item)
                    elif not exact and np.array_equal(item_keys[offset : offset + size], keys[p : p + size]):
                        found[item].append((offset, p))
                    i += 1
        out = [(self.items[item][0], 1, 1, False) for item in whole]
        for item, pairs in found.items():
            item_id, _, item_slot, item_tokens, _, size, n = self.items[item]
            binds = [[(item_tokens[o + j], tokens[p + j]) for j in range(size) if item_slot[o + j]] for o, p in pairs] if item_slot.any() else [[]] * len(pairs)
            row = judged(item_id, n, [o for o, _ in pairs], binds)
            if row:
                out.append(row)
        return sorted(out, key=lambda r: str(r[0]))

    def _known(self, keys: np.ndarray) -> np.ndarray:
        """How many of the first i tokens some item has, for each i."""
        spot = np.searchsorted(self.vocabulary, keys)
        spot[spot == len(self.vocabulary)] = 0
        return np.concatenate([[0], np.cumsum(self.vocabulary[spot] == keys)])


def judged(item_id, n: int, offsets: list[int], binds: list[list[tuple[str, str]]]) -> tuple | None:
    """The slot check over all matched windows of one document and item."""
    votes: dict[str, Counter] = defaultdict(Counter)
    for window in binds:
        for ours, theirs in window:
            votes[ours.lower()][theirs.lower()] += 1
    bound = {k: max(v.items(), key=lambda x: (x[1], x[0] == k, x[0]))[0] for k, v in votes.items()}
    good = {o for o, window in zip(offsets, binds) if all(bound[a.lower()] == b.lower() for a, b in window)}
    if len(good) < min(MIN_WINDOWS, n):
        return None
    return item_id, len(good), n, any(k != v for k, v in bound.items())


_LOADED: dict[str, Items] = {}


def _items(shared) -> Items:
    digest, rows = shared.value
    if digest not in _LOADED:
        _LOADED.clear()
        _LOADED[digest] = Items(rows)
    return _LOADED[digest]


def _items_of(benchmark: DataFrame) -> DataFrame:
    return benchmark.select("item_id", "text").where(F.col("text").isNotNull()).distinct()


def _share(benchmark: DataFrame, max_windows: int):
    """The benchmark's rows as a broadcast, or None beyond the bound."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([len(canonical(t)[0]) for t in texts], pa.int64()), pa.array(list(map(len, texts)), pa.int64())], names=["n", "chars"])

    rows = _items_of(benchmark)
    n, chars = rows.select("text").mapInArrow(sizes, "n long, chars long").agg(F.sum("n"), F.sum("chars")).first()
    if (n or 0) > max_windows or (chars or 0) > MAX_CHARS * max_windows:
        return None
    found = sorted(map(tuple, rows.collect()), key=str)
    return benchmark.sparkSession.sparkContext.broadcast((xxhash.xxh64_hexdigest(repr(found)), found))


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _schema(docs: DataFrame, benchmark: DataFrame, row: str = "doc_id") -> tuple[str, pa.DataType]:
    kind = _kind(docs, "doc_id") if row == "doc_id" else "long"
    return f"`{row}` {kind}, item_id {_kind(benchmark, 'item_id')}, n_windows long, item_windows long, reparameterised boolean", to_arrow_type(benchmark.schema["item_id"].dataType)


def _batch(ids: pa.Array, rows: list[tuple[int, tuple]], kind: pa.DataType, row: str = "doc_id") -> pa.RecordBatch:
    """Found (place in ids, match) as a batch."""
    part = list(zip(*(m for _, m in rows))) or [(), (), (), ()]
    at = ids.take(pa.array([i for i, _ in rows], pa.int64()))
    return pa.RecordBatch.from_arrays([at, pa.array(part[0], kind), pa.array(part[1], pa.int64()), pa.array(part[2], pa.int64()), pa.array(part[3], pa.bool_())], names=[row, "item_id", "n_windows", "item_windows", "reparameterised"])


def find_leaks(docs: DataFrame, benchmark: DataFrame, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """doc_id, item_id, n_windows, item_windows, reparameterised of each contaminated row of docs(doc_id, text, ...) and item of benchmark(item_id, text)."""
    shared = _share(benchmark, max_windows)
    if shared is None:
        rows, found = _joined(docs.select("doc_id", "text"), benchmark)
        return rows.select("_row", "doc_id").join(found, "_row").select("doc_id", "item_id", "n_windows", "item_windows", "reparameterised")
    schema, kind = _schema(docs, benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _items(shared)
        for b in batches:
            yield _batch(b.column(0), [(i, m) for i, t in enumerate(b.column(1).to_pylist()) for m in items.matches(t or "")], kind)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _signed(h: np.ndarray, size: int, exact: bool) -> np.ndarray:
    """Window hashes as signed integers that differ by size and manner of matching."""
    return h.view(np.int64) ^ (size * 2 + exact)


def _joined(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs with a number for each row as _row, and what each row's matches are, by a shuffle of window hashes; for a benchmark of any size."""
    rows = materialize(docs.select("*", F.monotonically_increasing_id().alias("_row")), "rows")
    items = materialize(_items_of(benchmark).select("item_id", "text", F.monotonically_increasing_id().alias("_item")), "items")
    schema, kind = _schema(docs, benchmark, "_row")

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, size, exact, np.unique(_signed(h, size, exact))) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for size, exact, _, h, _ in [item_windows(t)]]
            flat = [(i, size, exact, x) for i, size, exact, hs in found for x in hs.tolist()]
            part = list(zip(*flat)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int64()), pa.array(part[1], pa.int64()), pa.array(part[2], pa.bool_()), pa.array(part[3], pa.int64())], names=["_item", "size", "exact", "h"])

    windows = materialize(items.select("_item", "text").mapInArrow(of_items, "_item long, size long, exact boolean, h long"), "windows")
    sizes = sorted((r["size"], r["exact"]) for r in windows.select("size", "exact").distinct().collect())  # 2 * WINDOW at most

    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for t in b.column(1).to_pylist():
                parts = [_signed(h, *size) for size, _, h in text_windows(canonical(t or ""), sizes)]
                found.append(np.unique(np.concatenate(parts)) if parts else np.empty(0, np.int64))
            at = np.repeat(np.arange(len(found)), list(map(len, found)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(np.concatenate(found) if found else np.empty(0, np.int64))], names=["_row", "h"])

    # Neither side is aggregated in the join's stage, so Spark may split a window that many texts share.
    pairs = rows.select("_row", "text").mapInArrow(of_rows, "_row long, h long").join(windows.select("_item", "h"), "h").select("_row", "_item").distinct()
    texts = pairs.join(rows.select("_row", "text"), "_row").join(items.select("_item", "item_id", F.col("text").alias("item_text")), "_item")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = lru_cache(maxsize=1000)(lambda item_id, text: Items([(item_id, text)]))
        for b in batches:
            triples = zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist())
            yield _batch(b.column(0), [(i, m) for i, (t, item_id, text) in enumerate(triples) for m in one(item_id, text).matches(t or "")], kind, "_row")

    return rows, texts.select("_row", "text", "item_id", "item_text").mapInArrow(judge, schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """The rows of docs that no benchmark item contaminates, with the columns of docs."""
    shared = _share(benchmark, max_windows)
    at = [c.lower() for c in docs.columns].index("text")
    if shared is None:
        whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col("text"), F.col("doc_id"))
        rows, found = _joined(whole, benchmark)
        return rows.join(found.select("_row").distinct(), "_row", "left_anti").select("_doc.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _items(shared)
        for b in batches:
            yield b.filter(pa.array([not items.matches(t or "") for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
