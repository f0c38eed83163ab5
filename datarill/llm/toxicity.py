"""Toxicity by the nearest labelled examples under TF-IDF cosine.

Learning: a bounded sample of labelled rows (EXAMPLES of each class, those with
the smallest hashes; each distinct text once). Every word of every example, toxic
or not, is a term. A term's weight in a text is (1 + ln count) * idf * relevance:
relevance is the term's chi-square against the label over what chance gives the
best of as many terms (2 ln of their number), and 1 where that is less, so no
term is left out or weighs less than its TF-IDF. The examples' unit vectors form an
inverted index in blocks of BLOCK examples, with the largest weight of each term in
each block, as flat arrays.

Scoring: a text's K nearest examples are exact. The bound of a block is the sum of
its terms' largest weights times the text's; the FIRST blocks by falling bound give
a K-th best similarity, and then every other block whose bound reaches it is
scored. The votes are weighted by similarity and by class, so that each class
counts as often as among all labels, shrunk towards the base rate, and mapped to a
probability by a logistic curve fitted on CALIBRATION examples' own leave-one-out
votes. The neighbours are returned as evidence.

Only the sample reaches the driver; the model is broadcast and rows don't move
while scored. Labels, languages, sources and ids are no inputs of a score.

Defined results: null and empty texts, and texts that share no word with any
example, have no neighbours and score the base rate (0 without any labels); so does
every text if there is no toxic or no other example. Null labels are no
examples; of several labels of one document the largest holds; of several texts
of one document that with the smallest hash; of equal texts with different labels
that of the smallest document. Similarities that tie rank by the example's place
in the index. Repeated rows stay repeated.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

#: Labelled rows of each class that are learned from, at most.
EXAMPLES = 3000
#: Examples whose leave-one-out votes fit the logistic curve, at most; they are spread evenly over the index.
CALIBRATION = 1000
#: Neighbours of a text, examples of a block, and blocks that are scored first.
K, BLOCK, FIRST = 25, 64, 8
#: Most frequent terms, whose lists are kept as dense rows, and texts that are multiplied with them at a time.
DENSE, TOGETHER = 512, 64
#: Votes of the base rate against the neighbours' similarities.
PRIOR = 0.1

_WORDS = re.compile(r"\w+").findall


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def counted(text: str | None) -> Counter:
    """The words of a text and how often it has them."""
    return Counter(_WORDS((text or "").lower()))


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """low[0], ..., high[0] - 1, low[1], ..., high[1] - 1, and so on."""
    n = high - low
    ends = np.cumsum(n)
    return np.repeat(low - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)


class Index:
    """Unit vectors by term. The DENSE most frequent terms have a row of weights over all examples; the others have postings by block.

    Cell c holds the postings low[c]:low[c + 1] of one term in one block; a term's cells are cells[t]:cells[t + 1].
    """

    def __init__(self, ids: dict[str, int], weight: np.ndarray, unseen: float, examples: list[tuple[np.ndarray, np.ndarray]]):
        """ids has the terms, examples the terms and counts of each."""
        self.ids, self.weight, self.unseen, self.n = ids, weight, unseen, len(examples)
        self.blocks = -(-self.n // BLOCK)
        vectors = [self.unit(t, n) for t, n in examples]
        term = np.concatenate([t for t, _ in vectors] or [np.empty(0, np.int32)])
        at = np.repeat(np.arange(self.n, dtype=np.int32), [len(t) for t, _ in vectors])
        value = np.concatenate([w for _, w in vectors] or [np.empty(0)])
        del vectors
        frequent = np.sort(np.argsort(-np.bincount(term, minlength=len(ids)), kind="stable")[:DENSE])
        self.row = np.full(len(ids), -1, dtype=np.int32)
        self.row[frequent] = np.arange(len(frequent))
        self.dense = np.zeros((len(frequent), self.blocks * BLOCK))
        is_dense = self.row[term] >= 0
        self.dense[self.row[term[is_dense]], at[is_dense]] = value[is_dense]
        term, at, value = term[~is_dense], at[~is_dense], value[~is_dense]
        order = np.argsort(term, kind="stable")
        term, self.at, self.value = term[order], at[order], value[order]
        block = self.at // BLOCK
        new = np.ones(len(term), dtype=bool)
        new[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        first = np.flatnonzero(new)
        self.low = np.append(first, len(term))
        self.block = block[first]
        self.most = np.maximum.reduceat(self.value, first) if len(first) else np.empty(0)
        self.cells = np.searchsorted(term[first], np.arange(len(ids) + 1))

    def vector(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights of a text, as parts of its unit vector; words that no example has count in its length."""
        n = len(counts)
        return self.unit(np.fromiter(map(self.ids.get, counts.keys(), repeat(-1)), np.int32, n), np.fromiter(counts.values(), np.float64, n))

    def unit(self, term: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The terms in order with their weights; -1 is a word that no example has."""
        known = term >= 0
        w = (1 + np.log(counts)) * np.where(known, self.weight[term] if len(self.weight) else 0.0, self.unseen)
        norm = math.sqrt(float(w @ w))
        term, w = term[known], w[known]
        order = np.argsort(term)
        return term[order], w[order] / (norm or 1.0)

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int = K, without: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each vector the k examples most similar to it, exactly, nearest first, and their similarities; ``without`` names an example of each to leave out."""
        queries = np.zeros((len(vectors), len(self.dense)))
        rare = []
        for q, (term, w) in zip(queries, vectors):
            row = self.row[term]
            q[row[row >= 0]] = w[row >= 0]
            rare.append((term[row < 0], w[row < 0]))
        score = queries @ self.dense
        most = score.reshape(len(vectors), self.blocks, BLOCK).max(axis=2) if self.n else score
        return [self._nearest(*rare[i], score[i], most[i], k, without[i] if without else -1) for i in range(len(vectors))]

    def _nearest(self, term: np.ndarray, w: np.ndarray, score: np.ndarray, most: np.ndarray, k: int, without: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best, given what the frequent terms add to each example, and at most to one of each block."""
        low, high = self.cells[term], self.cells[term + 1]
        cells, weights = _ranges(low, high), np.repeat(w, high - low)
        block = self.block[cells]
        bound = most + np.bincount(block, weights=weights * self.most[cells], minlength=self.blocks)
        scored = np.zeros(self.blocks, dtype=bool)
        out = np.zeros(len(score))
        wanted = scored.copy()
        wanted[np.argsort(-bound, kind="stable")[:FIRST]] = True
        for _ in range(2):
            c = cells[wanted[block]]
            a, b = self.low[c], self.low[c + 1]
            p = _ranges(a, b)
            added = np.bincount(self.at[p], weights=np.repeat(weights[wanted[block]], b - a) * self.value[p], minlength=len(score))
            here = np.repeat(wanted, BLOCK)
            out[here] = np.round(score[here] + added[here], 12)
            if without >= 0:
                out[without] = 0.0
            scored |= wanted
            least = np.partition(out, -k)[-k] if len(out) >= k else 0.0
            wanted = ~scored & (bound > 0) & (bound >= least - 1e-9)
            if not wanted.any():
                break
        found = np.flatnonzero(out > 0)
        if len(found) > k:
            found = found[out[found] >= np.partition(out[found], -k)[-k]]
        found = found[np.argsort(-out[found], kind="stable")][:k]
        return found, out[found]


@dataclass
class Model:
    index: Index
    ids: list
    labels: np.ndarray
    base: float
    #: What an example of class 0 and 1 counts for: its class's share of all labels over its share of the sample.
    weights: tuple[float, float] = (1.0, 1.0)
    slope: float = 1.0
    shift: float = 0.0

    def vote(self, near: np.ndarray, similarity: np.ndarray) -> float:
        y = self.labels[near]
        s = similarity * np.where(y == 1, self.weights[1], self.weights[0])
        return float(((s * y).sum() + PRIOR * self.base) / (s.sum() + PRIOR))

    def curve(self, vote: float) -> float:
        vote = min(max(vote, 1e-6), 1 - 1e-6)
        return 1 / (1 + math.exp(-(self.slope * math.log(vote / (1 - vote)) + self.shift)))

    def calibrate(self, examples: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Fits slope and shift on leave-one-out votes by Newton's method, held near 1 and 0 by one pseudo-observation."""
        n = len(examples)
        if n < 20 or not 0 < self.labels.sum() < n:
            return
        chosen = np.linspace(0, n - 1, min(n, CALIBRATION)).astype(int).tolist()
        parts = [chosen[i : i + TOGETHER] for i in range(0, len(chosen), TOGETHER)]
        votes = np.clip([self.vote(*x) for part in parts for x in self.index.nearest([self.index.unit(*examples[i]) for i in part], without=part)], 1e-6, 1 - 1e-6)
        x, y = np.log(votes / (1 - votes)), self.labels[chosen].astype(float)
        c = np.where(y == 1, self.weights[1], self.weights[0])
        a, b = 1.0, 0.0
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
            w = c * p * (1 - p)
            g = np.array([(c * (p - y) * x).sum() + (a - 1), (c * (p - y)).sum() + b])
            h = np.array([[(w * x * x).sum() + 1, (w * x).sum()], [(w * x).sum(), w.sum() + 1]])
            step = np.linalg.solve(h, g)
            a, b = a - step[0], b - step[1]
            if abs(step).max() < 1e-9:
                break
        self.slope, self.shift = float(np.clip(a, 0.2, 5)), float(np.clip(b, -5, 5))

    def score(self, texts: list[str | None]) -> list[tuple[float, list]]:
        """The score of each text and the ids of its nearest examples."""
        out = []
        for i in range(0, len(texts), TOGETHER):
            part = texts[i : i + TOGETHER]
            if not self.index.n:
                out += [(self.base, []) for _ in part]
                continue
            for near, similarity in self.index.nearest([self.index.vector(counted(t)) for t in part]):
                out.append((self.curve(self.vote(near, similarity)), [self.ids[j] for j in near.tolist()]) if len(near) else (self.base, []))
        return out


def term_weights(terms: int, examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, relevant: bool = True) -> tuple[np.ndarray, float]:
    """idf times relevance of each of so many terms, and the weight of a word that no example has; plain idf if not ``relevant``."""
    n, toxic = len(examples), int(labels.sum())
    count = lambda y: np.bincount(np.concatenate([t for (t, _), x in zip(examples, labels.tolist()) if x == y] or [np.empty(0, np.int32)]), minlength=terms).astype(float)
    a = count(1)
    df = a + count(0)
    weight = np.log((1 + n) / (1 + df)) + 1
    if relevant and 0 < toxic < n:
        chi = n * (a * n - df * toxic) ** 2 / (toxic * (n - toxic) * df * np.maximum(n - df, 0.5))
        weight *= np.maximum(1.0, chi / (2 * math.log(max(2, terms))))
    return weight, math.log(1 + n) + 1


def model_of(ids: list, labels: np.ndarray, terms: dict[str, int], examples: list[tuple[np.ndarray, np.ndarray]], all_labels: dict[int, int] | None = None, relevant: bool = True) -> Model:
    """A model of examples, given as terms and counts; all_labels has the number of labels of each class, that of the examples if not given."""
    n, toxic = len(ids), int(labels.sum())
    whole = {y: max((all_labels or {}).get(y, 0), k) for y, k in ((0, n - toxic), (1, toxic))}
    total = whole[0] + whole[1]
    base = whole[1] / total if total else 0.0
    if not 0 < toxic < n:
        return Model(Index({}, np.empty(0), 1.0, []), [], np.empty(0, int), base)
    # Examples of like length stand together, which makes the blocks' largest weights tell more.
    order = sorted(range(n), key=lambda i: (len(examples[i][0]), i))
    ids, labels, examples = [ids[i] for i in order], labels[order], [examples[i] for i in order]
    weight, unseen = term_weights(len(terms), examples, labels, relevant)
    shares = (whole[0] / total * n / (n - toxic), whole[1] / total * n / toxic)
    model = Model(Index(terms, weight, unseen, examples), ids, labels, base, shares)
    model.calibrate(examples)
    return model


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [counted(t) for t in b.column(3).to_pylist()]
        terms, n = pa.array([list(c) for c in found], pa.list_(pa.string())), pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*b.columns[:3], terms, n], names=["doc_id", "body", "label", "terms", "n"])


def fit(docs: DataFrame, labelled: DataFrame, examples: int = EXAMPLES, relevant: bool = True) -> Model:
    """A model from docs(doc_id, text) and labelled(doc_id, label 0 or 1)."""
    rows = labelled.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    rows = materialize(rows, "labels")
    all_labels = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    drawn = [rows.where(F.col("label") == y).withColumn("o", F.xxhash64("doc_id")).orderBy("o", "doc_id").limit(examples).select("doc_id", "label") for y in (0, 1)]
    sample = F.broadcast(drawn[0].unionByName(drawn[1]))  # 2 * examples rows
    # One text of each document, so the sample stays as small whatever ids repeat.
    texts = docs.select("doc_id", "text").join(sample, "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("body"), "text")).alias("x"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = texts.select("doc_id", "x.body", "label", "x.text").mapInArrow(_examples, f"doc_id {kind}, body long, label int, terms array<string>, n array<long>").toArrow().sort_by("doc_id")
    ids, labels, vocabulary, rows, seen = [], [], {}, [], set()
    for b in found.to_batches(max_chunksize=64):  # strings of a few examples at a time
        for doc_id, body, label, terms, n in zip(*(c.to_pylist() for c in b.columns)):
            if terms and body not in seen:
                seen.add(body)
                ids.append(doc_id)
                labels.append(label)
                rows.append((np.fromiter((vocabulary.setdefault(t, len(vocabulary)) for t in terms), np.int32, len(terms)), np.array(n, np.float64)))
    del found
    return model_of(ids, np.array(labels, int), vocabulary, rows, all_labels, relevant)


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and evidence (ids of the nearest examples, nearest first) of every row of docs(doc_id, text, ...)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a Python worker reads it once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            found = model.score(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.list_(b.column(0).type))], names=["doc_id", "score", "evidence"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, evidence array<{kind}>")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence of every document."""
    docs = table(spark, sf_dir, "documents")
    labelled = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").alias("label"))
    scored = score_texts(docs, fit(docs, labelled))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
