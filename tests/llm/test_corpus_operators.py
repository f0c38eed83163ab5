"""Operators over whole corpora and the pipeline, held against brute force."""

import random
import re
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

from datarill.llm import line_dedup, simhash_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def fp(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split(r"[ \t-\r]+", text) if x]
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)]
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """Smallest key reachable over links of at most three bits."""
    parent = {k: k for k in fps}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in combinations(sorted(fps), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 3:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {k: root(k) for k in fps}


def texts(seed, n=80):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    out = [None, "", " ", "One", "one two", "x" * 5000]
    for _ in range(n):
        base = r.choices(words, k=r.randint(3, 120))
        out.append(" ".join(base))
        for _ in range(r.randint(0, 2)):
            copy = list(base)
            copy[r.randrange(len(copy))] = r.choice(words)
            out.append(" ".join(copy))
    return out


def test_simhash_matches_brute_force(spark):
    t = texts(1)
    df = spark.createDataFrame([(i * 7 % 997, x) for i, x in enumerate(t)], "doc_id long, text string").withColumn("fp", F.lit("clash"))
    df = df.unionByName(df.limit(5))
    fps = {i * 7 % 997: fp(x) for i, x in enumerate(t)}
    want = brute_components(fps)
    rows = simhash_dedup.near_duplicates(df).collect()
    assert len(rows) == len(t) + 5
    assert all((r["fp"] % (1 << 64)) == fps[r["doc_id"]] and r["component_id"] == want[r["doc_id"]] for r in rows)
    kept = simhash_dedup.drop_near_duplicates(df)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values())) and kept.columns == df.columns
    assert simhash_dedup.near_duplicates(df.limit(0)).count() == 0


def test_every_pair_within_the_radius_shares_a_table():
    for phi in simhash_dedup.FAMILIES:
        m = [x % (1 << 64) for x in simhash_dedup.masks(phi)]
        for d in combinations(range(64), simhash_dedup.RADIUS):
            bits = sum(1 << i for i in d)
            assert any(not bits & x for x in m)


@pytest.mark.parametrize("cap", [2, 2048])
def test_links_of_crowded_buckets(spark, cap):
    r = random.Random(3)
    base = r.getrandbits(64)
    fps = {base ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))) for _ in range(60)} | {r.getrandbits(64) for _ in range(40)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    found = simhash_dedup.components(simhash_dedup.links(spark.createDataFrame([(x,) for x in signed], "fp long"), cap)).collect()
    got = {r["node"]: r["root"] for r in found}
    want = brute_components({s: s % (1 << 64) for s in signed})
    assert {s: got.get(s, s) for s in signed} == want


def test_components_of_long_paths_and_stars(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100 + i, 99) for i in range(30)] + [(205, 204), (204, 201), (205, 201)]
    got = {r["node"]: r["root"] for r in simhash_dedup.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 99 for i in range(30)}, 204: 201, 205: 201}
    assert simhash_dedup.components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_lines(rows):
    """Texts after removal, and how many lines went; rows are (doc_id, text, source)."""
    sites, first = {}, {}
    for i, t, s in rows:
        for p, line in enumerate((t or "").split("\n") if t is not None else []):
            if re.search(r"[^\x20\x09-\x0D]", line):
                sites.setdefault(line, set()).add(s or "")
                first[line] = min(first.get(line, (i, p)), (i, p))
    bad = {x for x, s in sites.items() if len(s) >= (line_dedup.LONG_SITES if len(re.findall(r"[^\x20\x09-\x0D]+", x)) >= line_dedup.LONG_WORDS else line_dedup.SHORT_SITES)}
    out = {}
    for i, t, s in rows:
        if t is None:
            out[i] = (None, 0)
            continue
        kept = [x for p, x in enumerate(t.split("\n")) if x not in bad or first[x] == (i, p)]
        out[i] = ("\n".join(kept), len(t.split("\n")) - len(kept))
    return out


def test_line_dedup_matches_brute_force(spark):
    r = random.Random(2)
    long = [" ".join(f"l{i}w{j}" for j in range(9 + 50 * (i % 2))) for i in range(12)]
    short = [f"short {i}" for i in range(6)] + ["", "  "]
    rows = [(i, "\n".join(r.choices(short, k=3) + r.choices(long, k=1) + [f"own line {i}"]), r.choice([None, *(f"s{k}" for k in range(9))])) for i in range(60)]
    rows += [(100, None, "s1"), (101, "", "s1"), (102, "\n\n", "s2"), (103, long[0] + "\n" + long[0], "s3")]
    df = spark.createDataFrame([(i, t, s, 1) for i, t, s in rows], "doc_id long, text string, source string, N_REMOVED int").withColumn("pos", F.lit(1)).withColumn("a", F.lit(2)).withColumn("_lines", F.lit("x")).withColumn("_gone", F.lit(3)).withColumn("_id", F.lit(4))
    got = {x["doc_id"]: (x["text"], x["n_removed"]) for x in line_dedup.dedup_lines(df).collect()}
    assert got == brute_lines(rows)
    found = line_dedup.dedup_lines(df, max_lines=0)  # by shuffles only
    assert {x["doc_id"]: (x["text"], x["n_removed"]) for x in found.collect()} == got
    assert found.columns == ["doc_id", "text", "source", "pos", "a", "_lines", "_gone", "_id", "n_removed"] and {(x["_lines"], x["_gone"], x["_id"]) for x in found.collect()} == {("x", 3, 4)}
    assert line_dedup.dedup_lines(df.unionByName(df)).count() == 2 * len(rows)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_rows_with_any_column_names_null_and_shared_ids(spark):
    import public_tokenizers

    from datarill.llm import byte_bpe, near_copies

    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (None, "another text of its own"), (7, "one of two"), (7, "quite unlike the other, with the same id"), (8, text), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))
    for name in ("_id", "_gone", "_lines", "_best", "_keep", "IDS", "_row", "_doc", "root", "sid", "fp"):
        df = df.withColumn(name, F.lit(name))
    want = sorted([(None, "another text of its own"), (7, "one of two"), (7, "quite unlike the other, with the same id"), (8, text), (9, None)], key=repr)
    for drop in (simhash_dedup.drop_near_duplicates, near_copies.drop_near_copies):
        found = drop(df)
        assert found.columns == df.columns and sorted(((r["doc_id"], r["text"]) for r in found.collect()), key=repr) == want
        assert {r["_row"] for r in found.collect()} == {"_row"} and drop(df.limit(0)).count() == 0
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = byte_bpe.encode(df, path)
    assert coded.columns == [c for c in df.columns if c != "IDS"] + ["ids"]
    assert sorted((r["again"] for r in byte_bpe.decode(coded, path, to="again").collect()), key=repr) == sorted((t or "" for _, t in rows), key=repr)
    assert line_dedup.dedup_lines(df).count() == len(rows)


def test_pipeline_stages(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    before = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        rows = out.collect()
        if name == "line_dedup":
            want = brute_lines([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()])
            assert {r["doc_id"]: r["text"] for r in rows} == {i: t for i, (t, _) in want.items()} and all(r["n_chars"] == len(r["text"]) for r in rows)
        if name == "near_dedup":
            want = brute_components({r["doc_id"]: fp(r["text"]) for r in docs.collect()})
            assert sorted(r["doc_id"] for r in rows) == sorted(set(want.values()))
        if name != "byte_bpe":
            assert out.columns == before
            docs = spark.createDataFrame(rows, out.schema)
        else:
            assert len(rows) == docs.count() and all(len(r["ids"]) == r["n_tokens"] for r in rows)
        seen.append(len(rows))
    assert 0 < seen[-1] <= seen[0] < 200
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, d).select("doc_id").collect()) == sorted(r["doc_id"] for r in rows)
    assert corpus_pipeline.ORACLE_SQL is None


def test_registered_queries_match_their_sql(spark):
    import duckdb

    from datarill.llm import queries

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    for name, sql in queries.SQL.items():
        df = queries.QUERIES[name](spark, d)
        got = sorted((tuple(r) for r in df.collect()), key=repr)
        want = sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({sql})").fetchall(), key=repr)
        assert got == want, name
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 11)}
