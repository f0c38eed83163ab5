"""Near copies by the Jaccard similarity of their 5-word shingles, verified exactly.

Texts link at a similarity of 0.8 or more (LEAST of PARTS) between the sets of
their shingles. Candidates come from SimHash fingerprints of these sets by the
covering tables of simhash_dedup: any two that differ in RADIUS or fewer bits meet
in a bucket for certain. Pairs near 0.8 mostly differ in more bits than a covering
family can span; for those MinHash adds buckets, BANDS keys of ROWS minima each. A
pair at exactly 0.8 misses all of them with probability (1 - 0.8^5)^25 = 5e-5, a
pair at 0.9 with 2e-10. A link holds only if the whole sets confirm it.

Texts with equal sets count as one from the start, so exact copies cost nothing,
and buckets with the same members are compared once. Only the sets of texts that
share a bucket move; texts are written once and don't move, as the rows wanted go
to them in bitmaps of row numbers while there are at most MAX_MAPS. Inside a bucket, pairs that are already connected are
skipped, so a large cluster costs about one comparison a member; a large bucket of
texts that are alike but below 0.8 is compared pair by pair.

Defined results: null texts are empty; texts without words are copies of each
other; fewer than five words make one shingle; a component keeps the row with the
smallest doc_id, nulls last, then text hash, whichever ids its rows share with
other components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, remove
from .simhash_dedup import _WORDS, components, lower_ascii, majority, shared

SHINGLE = 5
#: Shared shingles times PARTS are at least LEAST times all shingles of both.
LEAST, PARTS = 4, 5
BANDS, ROWS = 25, 5
#: Bitmaps of row numbers that are broadcast at most, 4 KB each for 32,768 numbers of a task's rows.
MAX_MAPS = 10_000
#: Shingles whose minima are taken at a time, which bounds the memory of a long text.
CHUNK = 1 << 12

_DEAL = np.random.default_rng(0).integers(0, 1 << 64, size=(2, BANDS * ROWS, 1), dtype=np.uint64, endpoint=False)
_FLIP, _ODD = _DEAL[0], _DEAL[1] | np.uint64(1)


def shingles(text: str) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    words = _WORDS(lower_ascii(text))
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(" ".join(words))], np.uint64)
    parts = map(" ".join, zip(*(words[i:] for i in range(SHINGLE))))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, count=len(words) - SHINGLE + 1))


def band_keys(found: np.ndarray) -> list[int]:
    """One signed 64-bit key per band; none for an empty set."""
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), CHUNK):
        least = np.minimum(least, ((found[at : at + CHUNK] ^ _FLIP) * _ODD).min(axis=1))
    digests = [xxhash.xxh64_intdigest(r.tobytes()) for r in least.reshape(BANDS, ROWS)]
    return np.array(digests, np.uint64).view(np.int64).tolist()


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared * PARTS >= LEAST * (len(a) + len(b) - shared)


def united(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of alike sets that connect all alike pairs."""
    sizes, part, out = np.array([len(s) for s in sets]), np.arange(len(sets)), []
    for i in range(len(sets) - 1):
        low, high = np.minimum(sizes[i], sizes[i + 1 :]), np.maximum(sizes[i], sizes[i + 1 :])
        for j in (np.flatnonzero((part[i + 1 :] != part[i]) & (low * PARTS >= high * LEAST)) + i + 1).tolist():
            if part[j] != part[i] and alike(sets[i], sets[j]):
                out.append((i, j))
                part[part == part[j]] = part[i]
    return out


def _signed(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, sids, fps, keys = [], [], [], []
            for t in b.column(2).to_pylist():
                found = shingles(t or "")
                hashes.append(xxhash.xxh64_intdigest((t or "").encode("utf-8", "surrogatepass")))
                sids.append(xxhash.xxh64_intdigest(found.tobytes()))
                fps.append(majority(found))
                keys.append(band_keys(found))
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), signed(hashes), signed(sids), signed(fps), pa.array(keys, pa.list_(pa.int64()))], names=["_row", "doc_id", "body", "sid", "fp", "keys"])

    return run, f"_row long, doc_id {kind}, body long, sid long, fp long, keys array<long>"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [shingles(t or "").tobytes() for t in b.column(0).to_pylist()]
        sids = np.array(list(map(xxhash.xxh64_intdigest, found)), np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(sids), pa.array(found, pa.binary())], names=["sid", "shingles"])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of batches of (t, k, sid, shingles) sorted by bucket; the last bucket of a batch waits for the next."""
    bucket, ids, sets = None, [], []

    def linked() -> pa.RecordBatch:
        pairs = united(sets)
        u, v = [max(ids[i], ids[j]) for i, j in pairs], [min(ids[i], ids[j]) for i, j in pairs]
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    for b in batches:
        for t, k, sid, found in zip(*(c.to_pylist() for c in b.columns)):
            if (t, k) != bucket:
                if ids:
                    yield linked()
                bucket, ids, sets = (t, k), [], []
            ids.append(sid)
            sets.append(np.frombuffer(found, np.uint64))
    if ids:
        yield linked()


def covered(distinct: DataFrame) -> DataFrame:
    """t, k, sid of distinct(sid, fp) by bucket: those of the covering tables, and equal fingerprints."""
    fps = materialize(distinct.groupBy("fp").agg(F.count(F.lit(1)).alias("n")), "fingerprints")
    met = fps.where("n > 1").select(F.lit(BANDS).alias("t"), F.col("fp").alias("k"), "fp")
    for level, (keys, rows) in enumerate(shared(fps), BANDS + 1):
        met = met.unionByName(rows.select(F.lit(level).alias("t"), F.xxhash64(*keys).alias("k"), "fp"))
    # A table of its own, so that the join may be split where many sets have one fingerprint.
    met = materialize(met, "covered")
    remove(fps)
    found = materialize(met.join(distinct.select("sid", "fp"), "fp").select("t", "k", "sid"), "covered")
    remove(met)
    return found


def marked(rows: DataFrame, wanted: DataFrame, most: int = MAX_MAPS) -> DataFrame:
    """The rows whose _row is in wanted(_row). They stay where they are unless wanted fills more than so many bitmaps."""
    kept = materialize(wanted.select("_row"), "wanted")
    which, bit = F.bitmap_bucket_number("_row"), F.bitmap_bit_position("_row")
    # Numbers move before they are gathered, else each task would send a bitmap for each of its numbers.
    maps = kept.select(which.alias("_map"), bit.alias("_bit")).repartition("_map").groupBy("_map").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    maps = materialize(maps, "maps")
    if maps.count() > most:
        remove(maps)
        return rows.join(kept, "_row", "left_semi")
    remove(kept)
    byte = F.conv(F.hex(F.substring("_bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.join(F.broadcast(maps), which == F.col("_map")).where(F.getbit(byte, bit % 8) == 1).select(*rows.columns)


def drop_near_copies(docs: DataFrame, max_maps: int = MAX_MAPS) -> DataFrame:
    """One row of docs(doc_id, text, ...) per component of near copies, with the columns of docs."""
    # Whatever docs' columns are named, they stay inside a struct; it is written once and its fields are read from it.
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    rows = materialize(docs.select(whole, F.monotonically_increasing_id().alias("_row")), "rows")
    run, kind = _signed(docs.schema["doc_id"].dataType.simpleString())
    signed = rows.select("_row", "_doc.doc_id", "_doc.text").mapInArrow(run, kind)
    order = [F.col("doc_id").isNull().alias("unnamed"), "doc_id", "body", "_row"]
    distinct = materialize(signed.groupBy("sid").agg(F.min(F.struct(*order, "fp", "keys")).alias("x")).select("sid", "x.*"), "distinct")
    near = covered(distinct)
    bands = distinct.select(F.posexplode("keys").alias("t", "k"), "sid").unionByName(near)
    buckets = bands.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("sid")).alias("x"), F.bit_xor(F.xxhash64("sid", F.lit(1))).alias("y")).where("n > 1")
    once = materialize(buckets.groupBy("n", "x", "y").agg(F.min(F.struct("t", "k")).alias("b")).select("b.t", "b.k"), "buckets")
    members = materialize(bands.join(once, ["t", "k"]).select("t", "k", "sid"), "members")
    wanted = members.select("sid").distinct().join(distinct.select("sid", "_row"), "sid")
    sets = materialize(marked(rows.select("_row", "_doc.text"), wanted, max_maps).select("text").mapInArrow(_sets, "sid long, shingles binary"), "sets")
    compared = members.join(sets, "sid").repartition("t", "k").sortWithinPartitions("t", "k", "sid").select("t", "k", "sid", "shingles")
    stars = components(compared.mapInArrow(_links, "u long, v long").distinct())
    member = distinct.join(stars, distinct["sid"] == stars["node"], "left").withColumn("root", F.coalesce("root", "sid"))
    keep = member.groupBy("root").agg(F.min(F.struct("unnamed", "doc_id", "body", "_row")).alias("x")).select("x._row")
    found = marked(rows, keep, max_maps).select("_doc.*")
    for done in (distinct, near, once, members, sets, stars):  # nothing reads them any more
        remove(done)
    return found


__all__ = ["alike", "band_keys", "covered", "drop_near_copies", "marked", "shingles", "united"]
