"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words and word beginnings of 3 to 5 characters; all that are associated with either label
beyond chance (by chi-square over the fitting sample) make the vocabulary, and weights and norms are
over these terms. Document frequencies are those of all documents where these are given. Labelled examples are kept in blocks of an
inverted index with the largest impact of every term in each block. A text's cosine with any example
of a block is at most the sum of its own weights times these impacts, so blocks are visited by
falling bound until no bound reaches the k-th best cosine: the k nearest are exact. Votes weighted by
the squared cosine, shrunk towards the rate among examples without any term, are mapped to a
probability by a logistic curve that is fitted on a fold of the examples outside the index.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import bounded_batches, id_and_text

MAX_EXAMPLES = 6000  # bound of the labelled sample that the index is fitted on
LEAST_DOCS = 3
LEAST_CHI = 24.0  # weaker associations are chance among so many terms
NEIGHBOURS = 16
PRIOR_WEIGHT = 0.5
THRESHOLD = 0.3
BLOCK = 64
PREFIXES = (3, 4, 5)
_WORD = re.compile(r"[^\W_]+")


def _terms_of(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


class Terms:
    """Counts of the vocabulary's terms in whole texts: whole words, and beginnings of one length at a time."""

    def __init__(self, vocabulary: dict[str, int]):
        self.whole = {t: k for t, k in vocabulary.items() if not t.endswith("*")}
        begins = {n: {t[:-1]: k for t, k in vocabulary.items() if t.endswith("*") and len(t) == n + 1} for n in PREFIXES}
        self.begins = [(n, itemgetter(slice(n)), known) for n, known in begins.items() if known]

    def counts(self, text: str) -> dict[int, int]:
        words = Counter(_WORD.findall(text.lower()))
        found = {self.whole[w]: words[w] for w in self.whole.keys() & words.keys()}
        for n, begin, known in self.begins:
            begins = list(map(begin, words))
            hit = known.keys() & set(begins)
            if hit:
                for b, (word, times) in zip(begins, words.items()):
                    if b in hit and len(word) > n:
                        found[known[b]] = found.get(known[b], 0) + times
        return found


def logistic_map(raw: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of P(label 1) over the logit of the raw score, by Newton's method on smoothed targets."""
    ones = int(labels.sum())
    if not 0 < ones < len(labels):
        return 1.0, 0.0
    x = np.stack((_logit(raw), np.ones(len(raw))), axis=1)
    target = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (len(labels) - ones + 2))
    w = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - target))
        w -= step * min(1.0, 2 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)  # a falling map would turn the ranking around


def _logit(raw):
    raw = np.clip(raw, 1e-4, 1 - 1e-4)
    return np.log(raw / (1 - raw))


@dataclass
class NearestLabelled:
    """The fitted index; small whatever the corpus, as examples and vocabulary are bounded."""

    vocabulary: dict[str, int]
    idf: np.ndarray
    ids: np.ndarray  # of the examples, in index order
    labels: np.ndarray
    postings: list[dict[int, tuple[np.ndarray, np.ndarray]]]  # by block and term: places in the block, impacts
    impacts: np.ndarray  # largest by block and term
    base: float  # rate of label 1 among examples without any term
    neighbours: int = NEIGHBOURS
    curve: tuple[float, float] = (1.0, 0.0)  # slope and intercept over the logit of the raw score

    @classmethod
    def build(cls, vocabulary: dict[str, int], doc_freq: np.ndarray, n_docs: int, examples: list[tuple[int, int, dict[int, int]]]) -> NearestLabelled:
        idf = np.log((1 + n_docs) / (1 + doc_freq)) + 1
        blank = [y for _, y, c in examples if not c]
        base = (sum(blank) + 0.01) / (len(blank) + 1)
        vectors = [(i, y, *cls._weights(c, idf)) for i, y, c in examples if c]
        # alike examples side by side, so that a block's largest impacts are telling
        vectors.sort(key=lambda v: (int(v[2][np.argmax(v[3])]), v[1], v[0]))
        postings, impacts = [], np.zeros((-(-len(vectors) // BLOCK), len(vocabulary)))
        for b in range(len(impacts)):
            lists: dict[int, list[tuple[int, float]]] = {}
            for place, (_, _, terms, w) in enumerate(vectors[b * BLOCK : (b + 1) * BLOCK]):
                for t, x in zip(terms.tolist(), w.tolist()):
                    lists.setdefault(t, []).append((place, x))
            postings.append({t: (np.array([p for p, _ in li], np.int64), np.array([x for _, x in li])) for t, li in lists.items()})
            impacts[b, list(lists)] = [max(x for _, x in li) for li in lists.values()]
        return cls(vocabulary, idf, np.array([v[0] for v in vectors], np.int64), np.array([v[1] for v in vectors], np.int64), postings, impacts, base)

    @staticmethod
    def _weights(counts: dict[int, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        terms = np.array(sorted(counts), np.int64)
        w = (1 + np.log(np.array([counts[t] for t in terms.tolist()], float))) * idf[terms]
        return terms, w / np.sqrt(w @ w)

    def nearest(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the nearest examples, exactly; ties to the earlier place."""
        terms, w = self._weights(counts, self.idf)
        bounds = self.impacts[:, terms] @ w
        places, cosines = np.empty(0, np.int64), np.empty(0)
        for b in np.argsort(-bounds, kind="stable").tolist():
            if bounds[b] <= 0 or len(cosines) == self.neighbours and bounds[b] < cosines[-1] - 1e-12:
                break
            scores = np.zeros(BLOCK)
            for t, x in zip(terms.tolist(), w.tolist()):
                if t in self.postings[b]:
                    at, impact = self.postings[b][t]
                    scores[at] += impact * x
            hit = np.flatnonzero(scores)
            places, cosines = np.concatenate((places, hit + b * BLOCK)), np.concatenate((cosines, scores[hit]))
            best = np.lexsort((places, -cosines.round(12)))[: self.neighbours]
            places, cosines = places[best], cosines[best]
        return places, cosines

    def raw_score(self, counts: dict[int, int]) -> tuple[float, list[tuple[int, int, float]]]:
        """Shrunk vote and evidence: id, label and cosine of each neighbour."""
        if not counts:
            return self.base, []
        places, cosines = self.nearest(counts)
        votes = cosines**2
        score = (votes @ self.labels[places] + PRIOR_WEIGHT * self.base) / (votes.sum() + PRIOR_WEIGHT)
        return float(min(1.0, max(0.0, score))), list(zip(self.ids[places].tolist(), self.labels[places].tolist(), cosines.tolist()))

    def score(self, counts: dict[int, int]) -> tuple[float, list[tuple[int, int, float]]]:
        """Calibrated probability of label 1, and evidence."""
        raw, evidence = self.raw_score(counts)
        return float(1 / (1 + np.exp(-(self.curve[0] * _logit(raw) + self.curve[1])))), evidence


def fit(examples: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", corpus: DataFrame | None = None) -> NearestLabelled:
    """The index over ``examples``, which must be bounded (see ``bounded_sample``); ids name the evidence and choose the fold.

    One in six or so, by a hash of the id, stays outside the index and its vocabulary and calibrates the score.

    ``corpus`` gives the document frequencies, over all its rows; without it they are those of the examples.
    """
    rows = examples.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(label_col).cast("int").alias("y"))

    calibrates = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 8 == 3, F.lit(False))
    indexed = rows.where(~calibrates)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos, neg = Counter(), Counter()
        for batch in batches:
            for text, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                (pos if y else neg).update({t for w in set(_WORD.findall(text.lower())) for t in _terms_of(w)})
        terms = list(pos.keys() | neg.keys())
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([pos[t] for t in terms], pa.int64()), pa.array([neg[t] for t in terms], pa.int64())], ["term", "pos", "neg"])

    size = indexed.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("p")).first()
    n, p = int(size["n"]), int(size["p"])
    a, b = F.col("pos").cast("double"), F.col("neg").cast("double")
    chi = (a * (n - p) - b * p) ** 2 / ((a + b) * (n - a - b + 1))
    chosen = (
        indexed.mapInArrow(count, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        .where((a + b >= LEAST_DOCS) & (chi * n / max(1, p * (n - p)) >= LEAST_CHI)).orderBy(chi.desc(), "term").collect()
    )
    vocabulary = {r["term"]: k for k, r in enumerate(chosen)}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(vocabulary)
        for batch in batches:
            found = [sorted(terms.counts(t).items()) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array([[k for k, _ in f] for f in found], pa.list_(pa.int32())), pa.array([[c for _, c in f] for f in found], pa.list_(pa.int64()))], ["id", "y", "outside", "terms", "counts"])

    kept = rows.withColumn("outside", calibrates).mapInArrow(vectors, "id long, y int, outside boolean, terms array<int>, counts array<long>").collect()
    doc_freq, n_docs = np.array([r["pos"] + r["neg"] for r in chosen], float), n
    if corpus is not None:
        doc_freq, n_docs = _document_frequencies(corpus, text_col, vocabulary)
    index = NearestLabelled.build(vocabulary, doc_freq, n_docs, [(r["id"] if r["id"] is not None else -1, r["y"], dict(zip(r["terms"], r["counts"]))) for r in kept if not r["outside"]])
    outside = [(index.raw_score(dict(zip(r["terms"], r["counts"])))[0], r["y"]) for r in kept if r["outside"]]
    index.curve = logistic_map(np.array([x for x, _ in outside]), np.array([y for _, y in outside], np.int64))
    return index


def _document_frequencies(corpus: DataFrame, text_col: str, vocabulary: dict[str, int]) -> tuple[np.ndarray, int]:
    """Number of rows of ``corpus`` with each term, and of all its rows: one grouped aggregate, a row per term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, total, seen = Terms(vocabulary), 0, Counter()
        for batch in batches:
            total += batch.num_rows
            for text in batch.column(0).to_pylist():
                seen.update(terms.counts(text).keys())
        yield pa.RecordBatch.from_arrays([pa.array([-1, *seen], pa.int32()), pa.array([total, *seen.values()], pa.int64())], ["term", "n"])

    bounded_batches(corpus.sparkSession)
    texts = corpus.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = {r["term"]: r["n"] for r in texts.mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return np.array([found.get(k, 0) for k in range(len(vocabulary))], float), found.get(-1, 0)


def is_held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def bounded_sample(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> DataFrame:
    """At most ``max_examples`` labelled documents outside the held-out fold, chosen by a hash of the id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    known = known.where(~is_held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])


def score_documents(docs: DataFrame, index: NearestLabelled, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score, evidence)`` for every row.

    Null, empty and termless texts get the rate among termless examples; a null id is kept; repeated
    rows come out once each; texts are read whole; an empty table gives an empty one; without any
    labelled example every score is that rate's prior; neighbours of equal cosine (to 12 digits) come in the
    index's order. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))
        terms = Terms(index.vocabulary)
        for batch in batches:
            scored = [index.score(terms.counts(t)) for t in batch.column(1).to_pylist()]
            evidence = [[{"id": i, "label": y, "cosine": c} for i, y, c in e] for _, e in scored]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in scored], pa.float64()), pa.array(evidence, kind)], ["doc_id", "score", "evidence"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, evidence array<struct<id:long,label:int,cosine:double>>")


def score_column(index: NearestLabelled):
    """A column function from text to score, for filters on whole rows."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        terms = Terms(index.vocabulary)
        for texts in batches:
            yield texts.map(lambda t: index.score(terms.counts(t or ""))[0])

    return scored
