"""SimHash near duplicates by covering locality-sensitive hashing.

Each text gets a 64-bit fingerprint: per bit, whether more than half of its
3-word shingles' XXH64 hashes set it. Fingerprints link at RADIUS = 3 or fewer
differing bits. A covering family finds every such pair: each bit i gets a
vector phi(i) of RADIUS + 1 bits, and table v (v not 0) compares just the bits
with <phi(i), v> = 1. Up to RADIUS differing bits give RADIUS equations in
RADIUS + 1 unknowns, so some v not 0 sets them all to 0: that table has
both fingerprints in one bucket. There are 15 tables of 32 compared bits each.

Only distinct fingerprints are compared, so exact copies cost nothing. A bucket
with more than CAP distinct fingerprints is dealt anew by a second and a third
covering family on top of the first, which keeps the guarantee and leaves at
most 14 bits in which the members of a bucket differ. Inside a bucket all
pairs are compared in numpy, and just the links that join two parts are
returned: at most one fewer than the bucket's members. Components then come
from alternating large-star and small-star rounds on tables; nothing but counts
reaches the driver.

Defined results: null texts are empty; a text without words has fingerprint
zero; fewer than three words make one shingle; a null doc_id doesn't name a
component unless all of its members' are null; repeated rows stay repeated.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, remove, table

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Distinct fingerprints that one bucket compares directly.
CAP = 2048
#: Bits whose hashes are summed at a time, which bounds the memory of a long text.
CHUNK = 1 << 14

_WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower_ascii(text: str) -> str:
    """A-Z lower-cased, nothing else."""
    if text.isascii():
        return text.lower()
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # bytes.lower touches A-Z only


def fingerprint(text: str) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    words = _WORDS(lower_ascii(text))
    n = len(words)
    if not n:
        return 0
    shingles = map(" ".join, zip(*(words[i:] for i in range(SHINGLE)))) if n >= SHINGLE else iter([" ".join(words)])
    total = max(1, n - SHINGLE + 1)
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(s, SEED) for s in shingles), dtype="<u8", count=total))


def majority(hashes: np.ndarray) -> int:
    """Per bit, whether more than half of the hashes set it."""
    total = len(hashes)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, total, CHUNK):
        part = hashes[at : at + CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > total, bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = np.fromiter((fingerprint(t or "") for t in b.column(1).to_pylist()), dtype=np.uint64, count=b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])


def masks(phi: list[int]) -> list[int]:
    """The compared bits of each table v = 1 .. 2^(RADIUS+1) - 1, as signed 64-bit integers."""
    out = []
    for v in range(1, 1 << (RADIUS + 1)):
        m = sum(1 << i for i, p in enumerate(phi) if (p & v).bit_count() % 2)
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def families(levels: int = 3, seed: int = 0) -> list[list[int]]:
    """phi of each level; all use each vector for four bits. With seed 0 two levels fix 42 bits or more, three levels 50."""
    deal, out = random.Random(seed), []
    for level in range(levels):
        phi = [i % 16 for i in range(64)]
        if level:
            deal.shuffle(phi)
        out.append(phi)
    return out


FAMILIES = families()


def _united(run: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within RADIUS that join two parts of their run; run is sorted."""
    parent: dict[int, int] = {}

    def root(i: int) -> int:
        while (p := parent.get(i, i)) != i:
            parent[i] = parent.get(p, p)
            i = p
        return i

    left, right = [], []
    at = np.flatnonzero(run[:-1] == run[1:]) if len(run) > 1 else np.empty(0, int)
    lag = 1
    while len(at):
        for i in at[np.bitwise_count(x[at] ^ x[at + lag]) <= RADIUS].tolist():
            a, b = root(i), root(i + lag)
            if a != b:
                parent[max(a, b)] = min(a, b)
                left.append(i)
                right.append(i + lag)
        lag += 1
        at = at[at + lag < len(run)]
        at = at[run[at] == run[at + lag]]
    return x[left].view(np.int64) if left else np.empty(0, np.int64), x[right].view(np.int64) if right else np.empty(0, np.int64)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (bucket columns..., fp), sorted by bucket; the last bucket of a batch waits for the next."""
    held: list[np.ndarray] | None = None

    def linked(cols: list[np.ndarray]) -> pa.RecordBatch:
        n = len(cols[0])
        new = np.zeros(n, dtype=np.int64)
        for c in cols[:-1]:
            new[1:] |= c[1:] != c[:-1]
        a, b = _united(np.cumsum(new), cols[-1].view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["u", "v"])

    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
        if held is not None:
            cols = [np.concatenate(p) for p in zip(held, cols)]
        n = len(cols[0])
        if not n:
            continue
        differs = np.zeros(n, dtype=bool)
        for c in cols[:-1]:
            differs |= c != c[-1]
        cut = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
        if cut:
            yield linked([c[:cut] for c in cols])
        held = [c[cut:] for c in cols]
    if held is not None:
        yield linked(held)


def shared(distinct: DataFrame, cap: int = CAP) -> Iterator[tuple[list[str], DataFrame]]:
    """For each level its key columns and distinct(fp) by bucket, buckets of two or more; all pairs within RADIUS meet in some bucket."""
    rows, keys = distinct.select("fp"), []
    for level, phi in enumerate(FAMILIES):
        tables = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(m).alias("m")) for t, m in enumerate(masks(phi))])
        t, k = f"t{level}", f"k{level}"
        rows = rows.select("*", F.explode(tables).alias("_m")).select(*keys, F.col("_m.t").alias(t), F.col("fp").bitwiseAND(F.col("_m.m")).alias(k), "fp")
        keys = [*keys, t, k]
        sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
        sizes = materialize(sizes.select(*keys, (F.col("n") > cap).alias("over")), "buckets")
        last = level == len(FAMILIES) - 1
        some = sizes if last else sizes.where(~F.col("over"))
        yield keys, rows.join(some.select(*keys), keys, "left_semi")
        if last or sizes.where("over").isEmpty():
            break
        rows = rows.join(sizes.where("over").select(*keys), keys, "left_semi")


def links(distinct: DataFrame, cap: int = CAP) -> DataFrame:
    """Links u > v among distinct(fp) that connect all pairs within RADIUS."""
    out = None
    for keys, rows in shared(distinct, cap):
        found = rows.repartition(*keys).sortWithinPartitions(*keys, "fp").select(*keys, "fp").mapInArrow(_links, "u long, v long")
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node reachable) of every node in edges(u, v), u > v."""

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = materialize(edges, "links")
    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Tables of their own, so that the joins may be split where one node has many neighbours.
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")), "least")
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = materialize(large, "links")
        remove(least)
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        for gone in (large, edges, least):
            remove(gone)
        edges, after = small, state(small)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, cap: int = CAP) -> DataFrame:
    """doc_id, fp and component_id of every row of docs(doc_id, text, ...)."""
    fps = materialize(docs.select("doc_id", "text").mapInArrow(_fingerprints, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long"), "fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    stars = components(links(distinct, cap))
    member = distinct.join(stars, distinct["fp"] == stars["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # Only fingerprints with links need a look at the rest of their component.
    lone = member.join(stars.select("root").distinct(), "root", "left_anti").where(F.col("root") == F.col("fp")).select("fp", F.col("least").alias("component_id"))
    joined = member.join(stars.select("root").distinct(), "root", "left_semi")
    smallest = materialize(joined.groupBy("root").agg(F.min("least").alias("component_id")), "smallest")
    named = joined.join(smallest, "root").select("fp", "component_id")
    return fps.join(lone.unionByName(named), "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of docs per component, with the columns of docs: that of its smallest doc_id, nulls last, then text hash.

    Rows are told apart by a number of their own, as components may share ids.
    """
    # Whatever docs' columns are named, they stay inside a struct.
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    rows = materialize(docs.select(whole, "doc_id", "text", F.monotonically_increasing_id().alias("_row")), "rows")
    marked = rows.select(F.struct("doc_id", F.xxhash64("text").alias("body"), "_row").alias("doc_id"), "text")
    kind = marked.schema["doc_id"].dataType.simpleString()
    fps = materialize(marked.mapInArrow(_fingerprints, f"doc_id {kind}, fp long"), "fingerprints")
    order = F.struct(F.col("doc_id.doc_id").isNull().alias("unnamed"), "doc_id")
    least = materialize(fps.groupBy("fp").agg(F.min(order).alias("least")), "distinct")
    stars = components(links(least.select("fp")))
    member = least.join(stars, least["fp"] == stars["node"], "left").select(F.coalesce("root", "fp").alias("root"), "least")
    keep = member.groupBy("root").agg(F.min("least").alias("x")).select("x.doc_id._row")
    return rows.select("_row", "_doc").join(keep, "_row", "left_semi").select("_doc.*")


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
