"""The near-dedup stage against brute-force 5-word Jaccard, and rows that share or lack ids."""

import random
from itertools import combinations

import corpus_pipeline
import xxhash
from datarill.llm import near_copies, simhash_dedup

DOCS = "doc_id long, text string, extra int"


def grams(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """The smallest row index of each component of texts at a similarity of 0.8 or more."""
    sets, parent = [grams(t) for t in rows], list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return sorted({root(k) for k in range(len(rows))})


def test_near_dedup_stage_matches_brute_force(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    texts = [None, "", "One", "one", "one two three"]
    for _ in range(60):
        base = r.choices(words, k=r.randint(40, 200))
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 3)):
            copy = list(base)
            for _ in range(r.randint(1, 5)):
                copy[r.randrange(len(copy))] = r.choice(words)
            texts.append(" ".join(copy))
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], DOCS)
    kept = corpus_pipeline.near_dedup(spark, df, "")
    assert sorted(x["doc_id"] for x in kept.collect()) == brute(texts) and kept.columns == df.columns
    assert corpus_pipeline.near_dedup(spark, df.limit(0), "").count() == 0


def test_components_that_share_or_lack_ids_keep_a_row_each(spark):
    r = random.Random(6)
    text = lambda: " ".join(r.choices([f"w{i}" for i in range(500)], k=60))
    a, b, c, d = (text() for _ in range(4))
    rows = [(None, a, 1), (None, b, 1), (None, a, 1), (7, c, 1), (7, d, 1), (7, d, 1), (8, d, 1)]
    df = spark.createDataFrame(rows, DOCS)
    for drop in (simhash_dedup.drop_near_duplicates, lambda x: corpus_pipeline.near_dedup(spark, x, "")):
        got = sorted(((x["doc_id"], x["text"]) for x in drop(df).collect()), key=repr)
        assert got == sorted([(None, a), (None, b), (7, c), (7, d)], key=repr)


def test_near_copies_that_share_no_minhash_band_meet_in_a_covering_table(spark):
    r = random.Random(7)
    base = r.choices([f"w{i}" for i in range(5000)], k=12000)
    other, hashed = list(base), [xxhash.xxh64_intdigest(" ".join(base[i : i + 5])) for i in range(len(base) - 4)]
    for band in range(near_copies.BANDS):  # change a word of one minimum in each band
        flip, odd = (int(x[band * near_copies.ROWS, 0]) for x in (near_copies._FLIP, near_copies._ODD))
        at = min(range(len(hashed)), key=lambda i: (hashed[i] ^ flip) * odd % (1 << 64))
        other[at + 2] = f"x{band}"
    texts = [" ".join(base), " ".join(other), " ".join(r.choices(base, k=300))]
    a, b = map(near_copies.shingles, texts[:2])
    assert near_copies.alike(a, b) and not any(x == y for x, y in zip(near_copies.band_keys(a), near_copies.band_keys(b)))
    assert (simhash_dedup.majority(a) ^ simhash_dedup.majority(b)).bit_count() <= simhash_dedup.RADIUS
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], DOCS)
    assert sorted(x["doc_id"] for x in corpus_pipeline.near_dedup(spark, df, "").collect()) == brute(texts) == [0, 2]


def test_fingerprints_within_the_radius_share_a_bucket(spark):
    r = random.Random(8)
    fps = [r.getrandbits(64) for _ in range(40)]
    for fp in list(fps):
        for n in (1, 2, 3, 4, 8):
            fps.append(fp ^ sum(1 << b for b in r.sample(range(64), n)))
    fps += fps[:5]
    rows = [(i, fp - (1 << 64) if fp >> 63 else fp) for i, fp in enumerate(fps)]
    met = {}
    for x in near_copies.covered(spark.createDataFrame(rows, "sid long, fp long")).collect():
        met.setdefault((x["t"], x["k"]), set()).add(x["sid"])
    pairs = {p for b in met.values() for p in combinations(sorted(b), 2)}
    near = {(i, j) for i, j in combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= simhash_dedup.RADIUS}
    assert near and near <= pairs


def test_near_dedup_moves_no_texts_and_gives_the_same_rows_beyond_the_bound(spark):
    r = random.Random(9)
    texts = [" ".join(r.choices([f"w{i}" for i in range(300)], k=40)) for _ in range(30)]
    texts += [t + " more" for t in texts[:9]] + texts[5:12]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], DOCS).repartition(5)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most, moves in ((near_copies.MAX_MAPS, False), (0, True)):
            kept = near_copies.drop_near_copies(df, most)
            assert sorted(x["doc_id"] for x in kept.collect()) == brute(texts)
            assert ("Exchange hashpartitioning" in kept._jdf.queryExecution().executedPlan().toString()) == moves
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_marked_rows_by_bitmaps(spark):
    rows = spark.range(100_000, numPartitions=2).selectExpr("id", "monotonically_increasing_id() AS _row")
    wanted = rows.where("id % 7 = 0 OR id BETWEEN 32760 AND 32780 OR id IN (0, 49999, 50000, 99999)")
    expected = sorted(x["id"] for x in wanted.collect())
    for most in (near_copies.MAX_MAPS, 0):
        assert sorted(x["id"] for x in near_copies.marked(rows, wanted.select("_row"), most).collect()) == expected
    assert near_copies.marked(rows, wanted.select("_row").limit(0)).count() == 0
