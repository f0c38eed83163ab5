"""Toxicity by nearest labelled examples: exact neighbours, held-out labels, and the query against a plain computation."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from datarill.llm import toxicity

SMALL = "/root/testdata/sf0.001"


def plain_vectors(texts, labels, relevant=True):
    """Sparse unit vectors of the examples, and a function that makes one of any text."""
    counts = [Counter(re.findall(r"\w+", (t or "").lower())) for t in texts]
    n, toxic = len(texts), sum(labels)
    df = Counter(w for c in counts for w in c)
    bad = Counter(w for c, y in zip(counts, labels) if y for w in c)

    def weight(w):
        out = math.log((1 + n) / (1 + df[w])) + 1
        if relevant and df[w]:
            chi = n * (bad[w] * n - df[w] * toxic) ** 2 / (toxic * (n - toxic) * df[w] * max(n - df[w], 0.5))
            out *= max(1.0, chi / (2 * math.log(max(2, len(df)))))
        return out

    def vector(c):
        v = {w: (1 + math.log(k)) * weight(w) for w, k in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {w: x / norm for w, x in v.items()}

    return [vector(c) for c in counts], lambda t: vector(Counter(re.findall(r"\w+", (t or "").lower())))


def plain_similarities(vectors, v):
    return np.array([sum(x * e.get(w, 0.0) for w, x in v.items()) for e in vectors])


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def fitted(spark, d, relevant=True):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out(labels["doc_id"])).select("doc_id", labels["toxic"].alias("label")), relevant=relevant)
    return model, {r["doc_id"]: r["text"] for r in docs.collect()}, {r["doc_id"]: r["toxic"] for r in labels.collect()}


def test_neighbours_equal_brute_force_on_all_documents(spark, monkeypatch):
    for block, first, dense, relevant in ((64, 8, 512, True), (4, 1, 8, True), (4, 1, 8, False)):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        monkeypatch.setattr(toxicity, "FIRST", first)
        monkeypatch.setattr(toxicity, "DENSE", dense)
        model, texts, labels = fitted(spark, SMALL, relevant)
        assert {labels[i] for i in model.ids} == {0, 1} and not any(held(i) for i in model.ids)
        vectors, vector = plain_vectors([texts[i] for i in model.ids], model.labels.tolist(), relevant)
        assert set().union(*(v.keys() for v in vectors)) == set(model.index.ids)  # no word of an example is left out
        ids = list(texts)
        for i, (near, similarity) in zip(ids, model.index.nearest([model.index.vector(toxicity.counted(texts[i])) for i in ids])):
            want = plain_similarities(vectors, vector(texts[i]))
            order = [j for j in np.argsort(-np.round(want, 9), kind="stable") if want[j] > 0][: toxicity.K]
            assert np.allclose(similarity, want[order], atol=1e-9) and np.allclose(want[near], want[order], atol=1e-9)
            assert len(near) == min(toxicity.K, (want > 0).sum())


def test_query_matches_a_plain_computation(spark):
    """Scores, folds and evidence of op1 from a model that is used one example at a time."""
    got = {r["doc_id"]: r for r in toxicity.op1_toxicity(spark, SMALL).collect()}
    model, texts, labels = fitted(spark, SMALL)
    assert sorted(got) == sorted(texts)
    vectors, vector = plain_vectors([texts[i] for i in model.ids], model.labels.tolist())
    rate = {y: sum(1 for i, t in labels.items() if not held(i) and t == y) for y in (0, 1)}
    n = len(model.ids)
    share = [rate[y] / sum(rate.values()) * n / max(1, (model.labels == y).sum()) for y in (0, 1)]
    for i, r in got.items():
        want = plain_similarities(vectors, vector(texts[i]))
        near = [j for j in np.argsort(-np.round(want, 12), kind="stable") if want[j] > 0][: toxicity.K]
        base = rate[1] / sum(rate.values())
        if near:
            votes = [(want[j] * share[model.labels[j]], model.labels[j]) for j in near]
            vote = (sum(s * y for s, y in votes) + toxicity.PRIOR * base) / (sum(s for s, _ in votes) + toxicity.PRIOR)
            p = 1 / (1 + math.exp(-(model.slope * math.log(vote / (1 - vote)) + model.shift)))
        else:
            p = base
        assert abs(r["score"] - p) < 1e-6 and r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] == held(i)
        assert len(r["evidence"]) == len(near) and not any(held(x) for x in r["evidence"])


def test_learns_words_of_a_class(spark):
    r = random.Random(1)
    words = [f"w{i}" for i in range(60)]
    bad = ["vile", "scum", "rot"]
    rows = [(i, " ".join(r.sample(words, 15) + (r.sample(bad, 2) if i % 5 == 0 else [])), int(i % 5 == 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = toxicity.fit(df, df.select("doc_id", "label"))
    assert set(words) | set(bad) == set(model.index.ids)
    scored = {x["doc_id"]: x for x in toxicity.score_texts(df, model).collect()}
    assert all((scored[i]["score"] >= 0.5) == bool(y) for i, _, y in rows)
    assert scored[0]["evidence"] and all(0 <= x["score"] <= 1 for x in scored.values())


def test_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in toxicity.op1_toxicity(spark, d).collect()}
    labels = [(r["doc_id"], r["toxic"]) for r in spark.read.parquet(f"{d}/labels.parquet").collect()]
    test = [(got[i]["score"], y) for i, y in labels if got[i]["held_out"]]
    up, down = [s for s, y in test if y], [s for s, y in test if not y]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in up for b in down]) > 0.97
    assert np.mean([s >= 0.5 for s in up]) > 0.85 and np.mean([s >= 0.5 for s in down]) < 0.01
    assert len(got) == 10000


def test_defined_results(spark):
    rows = [(1, "good day", 0), (2, "good day", 1), (3, "vile", 1), (3, "vile again", 1), (4, None, 0), (5, "", 1), (6, "fine", None), (None, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = toxicity.fit(df, df.select("doc_id", "label"))
    assert sorted(model.ids) == [1, 3] and model.base == 3 / 5  # equal texts: the smallest document; one text of document 3
    got = [(r["doc_id"], r["score"], r["evidence"]) for r in toxicity.score_texts(df, model).collect()]
    assert len(got) == len(rows) and all(s == model.base and not e for i, s, e in got if i in (4, 5, 6))
    alone = toxicity.fit(df, df.where("label = 1").select("doc_id", "label"))
    assert {r["score"] for r in toxicity.score_texts(df, alone).collect()} == {1.0}
    none = toxicity.fit(df, df.limit(0).select("doc_id", "label"))
    assert {r["score"] for r in toxicity.score_texts(df, none).collect()} == {0.0}
