"""Operator 3: toxicity by maximum-scoring segments.

A word's features are the word itself and its first few bytes. The features learnt are
those of toxic labelled documents, told apart by 64-bit hashes. Their counts over the whole corpus are a
Dirichlet prior for the log-odds of each between toxic and other labelled documents; a
word's score is the best lower confidence bound of its features' log-odds less a
drift, so that ordinary text scores below zero.

A linear scan finds all maximal scoring segments of a document. Under the scores of
clean text the sum S of a document's best segment follows an extreme-value law:
P(max >= S) = 1 - exp(-K m exp(-lambda S)) for m words. lambda solves
E[exp(lambda s)] = 1 over clean labelled text, and K is fitted to the best segments of
clean labelled documents. Segments are passages if that probability is at most
``significant``. A document's score is a logistic function, fitted to labelled rows, of
the calibrated sums of its best and of all its segments.

Labels are learnt from at most ``Learning.most`` documents, those with the least hash of the
id, one row of each, and at most ``Learning.features`` features, those of most toxic documents;
corpus counts cover all documents. Held-out rows, crc32(id as text) mod 5 = 0, are
never learnt from.

Defined results: null and empty texts have no segments and get the score of such texts;
without labelled rows of both kinds all scores are 0; a row without an id is scored and
is not held out; labels that are null, or of ids without a document, are left out; ids
labelled twice count as toxic if any label is; of an id with several texts the least is learnt from;
equal texts have equal scores; very long texts are handled whole, one at a time; repeated rows and other
columns do no harm; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SALTS, U64, Chunk, Words, by_document, chunks, discard, documents_view, freeing, materialise, mix

SCORED = "doc_id long, held_out boolean, score double, predicted int, passages array<struct<start:long,end:long,sum:double,p:double>>"


@dataclass(frozen=True)
class Learning:
    most: int = 20_000  # labelled documents learnt from
    features: int = 1 << 18  # learnt at most
    prefixes: tuple[int, ...] = (5, 6, 7, 8)  # bytes, 8 at most; a word counts as a whole too
    prior: float = 20.0  # weight of the prior, in documents
    bound: float = 1.0  # standard errors below the log-odds
    drift: float = 1.0
    clip: float = 6.0
    significant: float = 0.05


@cache
def parting() -> np.ndarray:
    """Bytes that part words: all but ASCII letters and digits, and bytes of other letters."""
    out = np.ones(256, bool)
    out[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
    return out


class Tokens:
    """Words of a chunk, and the hashes of the features of each distinct word."""

    def __init__(self, chunk: Chunk, learn: Learning):
        self.words = w = Words(chunk, lower=True, parting=parting())
        self.code, distinct = pd.factorize(w.hash)  # of each word, among the distinct ones
        at = np.zeros(len(distinct), np.int64)
        at[self.code[::-1]] = np.arange(len(w))[::-1]  # the first place of each
        size = (w.end - w.start)[at]
        begin = np.ndarray(len(w.data) + 1, "<u8", np.concatenate([w.data, np.zeros(8, np.uint8)]), strides=(1,))[w.start[at]]
        columns = [distinct]
        for k in learn.prefixes:
            n = np.minimum(size, k).astype(U64)
            columns.append(mix(mix(begin & (~U64(0) >> (U64(64) - U64(8) * n))) ^ (n + U64(SALTS[0]))))
        self.features = np.column_stack(columns)

    def per_document(self) -> tuple[np.ndarray, np.ndarray]:
        """Document and feature, each pair once."""
        pairs = np.unique(self.words.doc_of().astype(np.int64) << 32 | self.code)
        doc, hashes = pairs >> 32, self.features[pairs & 0xFFFFFFFF]
        doc, hashes = np.repeat(doc, hashes.shape[1]), hashes.ravel()
        order = by_document(doc, hashes)
        doc, hashes = doc[order], hashes[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
        return doc[new], hashes[new]


COUNTS = "key long, n long, toxic long"


def counted(key: np.ndarray, n: np.ndarray, toxic: np.ndarray | None = None) -> pa.RecordBatch:
    toxic = np.zeros(len(key), np.int64) if toxic is None else toxic
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(key).view(np.int64)), pa.array(n.astype(np.int64)), pa.array(toxic.astype(np.int64))], ["key", "n", "toxic"])


def added_up(rows: DataFrame) -> DataFrame:
    """Sums of counts by key; tasks add up before the exchange."""
    return rows.groupBy("key").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))


def label_counts(sample: DataFrame, learn: Learning) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The features learnt, in order, and the other and toxic documents of each; ``learn.features`` bounds what is collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            doc, hashes = Tokens(chunk, learn).per_document()
            toxic = chunk.rows.column("toxic").to_numpy()[doc]
            yield counted(hashes, 1 - toxic, toxic)

    rows = added_up(sample.mapInArrow(run, COUNTS)).where("toxic > 0").orderBy(F.desc("toxic"), "key").limit(learn.features).toArrow()
    key, n, toxic = (rows.column(c).to_numpy() for c in ("key", "n", "toxic"))
    key = key.view(U64)
    order = np.argsort(key)
    return key[order], n[order], toxic[order]


def places(features: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The place of each hash among the features, or -1."""
    if not len(features):
        return np.full(hashes.shape, -1)
    at = np.minimum(np.searchsorted(features, hashes), len(features) - 1)
    return np.where(features[at] == hashes, at, -1)


def corpus_counts(docs: DataFrame, features: np.ndarray, learn: Learning) -> tuple[np.ndarray, int]:
    """How often each of the features occurs in all documents, and how many documents there are."""
    shared = docs.sparkSession.sparkContext.broadcast(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, documents = shared.value, 0
        total = np.zeros(len(own) + 1, np.int64)
        for chunk in chunks(batches):
            t = Tokens(chunk, learn)
            times = np.bincount(t.code, minlength=len(t.features)).astype(np.int64)
            at = places(own, t.features)
            np.add.at(total, at.ravel(), np.repeat(times, at.shape[1]))
            total[-1] = 0  # features that aren't known are at place -1
            documents += len(chunk.ids)
        total[-1] = documents
        there = np.flatnonzero(total)
        yield counted(there, total[there])

    out = np.zeros(len(features) + 1, np.int64)
    rows = added_up(docs.select("doc_id", "text").mapInArrow(run, COUNTS)).select("key", "n").toArrow()  # a row for each feature learnt, at most
    out[rows.column("key").to_numpy()] = rows.column("n").to_numpy()
    return out[:-1], int(out[-1])


def log_odds(corpus: np.ndarray, total: int, other: np.ndarray, toxic: np.ndarray, documents: tuple[int, int], learn: Learning) -> np.ndarray:
    """Lower confidence bounds of the log-odds of each feature.

    The Dirichlet prior is ``learn.prior`` documents that hold a feature as often as the corpus does, once in a document at most.
    """
    prior = learn.prior * np.minimum(1.0, (corpus + 1) / (total + 1))
    rate = []
    for y, n in ((toxic, documents[1]), (other, documents[0])):
        rate.append(np.log((y + prior) / (n + learn.prior - np.minimum(y, n) - prior + 1)))
    delta = rate[0] - rate[1]
    error = np.sqrt(1 / (toxic + prior) + 1 / (other + prior))
    return np.clip(delta - learn.bound * error, -learn.clip, learn.clip)


def maximal_segments(first: list[int], last: list[int], score: list[float], steps: list[int] | None = None) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of a sequence given as runs: first and last word, and sum.

    Linear time: each candidate keeps the sums before and after it, and which earlier
    candidate is the nearest with a smaller sum before it. A new run follows these links;
    a link once followed lies under the new candidate's own, or goes with what it swallows,
    and is never followed again. ``steps`` gets how many were followed.
    """
    kept: list[tuple[int, int, float, float, int]] = []  # first, last, sum before, sum after, link
    total, n = 0.0, 0
    for a, b, s in zip(first, last, score, strict=True):
        if s <= 0:
            total += s
            continue
        begin, before, after, j = a, total, total + s, len(kept) - 1
        total = after
        while True:
            while j >= 0 and kept[j][2] >= before:
                j, n = kept[j][4], n + 1
            if j < 0 or kept[j][3] >= after:
                break
            begin, before = kept[j][0], kept[j][2]
            link = kept[j][4]
            del kept[j:]
            j, n = link, n + 1
        kept.append((begin, b, before, after, j))
    if steps is not None:
        steps.append(n)
    return [(a, b, after - before) for a, b, before, after, _ in kept]


@dataclass(frozen=True)
class Model:
    table: np.ndarray | None  # a score for each feature
    learn: Learning
    known: np.ndarray | None = None  # the features, in order
    rate: float = 1.0  # lambda
    log_k: float = 0.0
    weights: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def scores(self, tokens: Tokens) -> np.ndarray:
        at = places(self.known, tokens.features)
        best = np.where(at >= 0, self.table[at], -self.learn.clip).max(axis=1, initial=-self.learn.clip)
        score = best[tokens.code] - self.learn.drift
        h = tokens.code
        again = h[1:] == h[:-1]
        first = tokens.words.docs[1:-1]  # of the documents after the first of the chunk
        again[first[(first > 0) & (first < len(h))] - 1] = False
        score[1:][again] = -self.learn.drift  # a word said again at once in a document tells nothing new
        return score

    def segments(self, tokens: Tokens) -> Iterator[list[tuple[int, int, float]]]:
        """Maximal segments of each document, by word."""
        s, w = self.scores(tokens), tokens.words
        up = s > 0
        for i in range(len(w.docs) - 1):
            a, b = int(w.docs[i]), int(w.docs[i + 1])
            at = np.flatnonzero(up[a:b])
            if not len(at):
                yield []
                continue
            sums = np.concatenate(([0.0], np.cumsum(s[a:b])))  # of this document alone, so that equal texts have equal sums
            cut = np.flatnonzero(np.diff(at) > 1) + 1
            first = at[np.concatenate(([0], cut))]
            last = at[np.concatenate((cut - 1, [len(at) - 1]))]
            run = sums[last + 1] - sums[first]
            gap = sums[first[1:]] - sums[last[:-1] + 1]
            order_first = np.empty(2 * len(first) - 1, np.int64)
            order_last, value = order_first.copy(), np.empty(2 * len(first) - 1)
            order_first[::2], order_last[::2], value[::2] = first, last, run
            order_first[1::2], order_last[1::2], value[1::2] = last[:-1] + 1, first[1:] - 1, gap
            yield maximal_segments((order_first + a).tolist(), (order_last + a).tolist(), value.tolist())

    def features(self, segments: list[tuple[int, int, float]], words: int) -> tuple[float, float]:
        """Calibrated sum, lambda S - ln(K m) and 0 at least, of the best segment, and the logarithm of 1 + that of all."""
        if not segments:
            return 0.0, 0.0
        above = np.maximum(0.0, self.rate * np.array([x[2] for x in segments]) - self.log_k - np.log(max(words, 1)))
        return float(above.max()), float(np.log1p(above.sum()))

    def p(self, total: float, words: int) -> float:
        return float(-np.expm1(-np.exp(self.log_k + np.log(max(words, 1)) - self.rate * total)))

    def probability(self, features: np.ndarray) -> np.ndarray:
        z = self.weights[0] + features @ np.array(self.weights[1:])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def solve_rate(values: np.ndarray, counts: np.ndarray) -> float:
    """The positive solution of E[exp(rate * s)] = 1, by halving."""
    values, p = values[counts > 0], counts[counts > 0] / counts.sum()
    most = min(64.0, 700 / max(float(values.max(initial=0)), 1.0))  # beyond, exp is out of range
    low, high = 0.0, min(1.0, most)
    value = lambda r: float((p * np.exp(r * values)).sum())
    while value(high) < 1 and high < most:
        low, high = high, min(2 * high, most)
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if value(middle) < 1 else (low, middle)
    return high


def fit_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton's method with a little shrinkage."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6, 1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, learn: Learning) -> DataFrame:
    """doc_id, text, toxic of at most ``learn.most`` labelled documents that aren't held out, a row of each, written to the shared folder."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    some = own.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(learn.most)
    found = docs.join(F.broadcast(some), "doc_id")  # at most learn.most rows are broadcast
    return materialise(found.groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select("doc_id", "text", "toxic"), "labelled")


def fit(docs: DataFrame, labels: DataFrame, learn: Learning = Learning()) -> Model:
    """Learn from the labelled sample, with the whole corpus as prior."""
    own = documents_view(docs)
    with freeing(docs.sparkSession):
        return _fit(own, training_sample(own, labels, learn), learn)


def _fit(own: DataFrame, sample: DataFrame, learn: Learning) -> Model:
    documents = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}  # two rows
    if len(documents) < 2:
        discard(sample)
        return Model(None, learn)
    known, other, toxic = label_counts(sample, learn)
    corpus, total = corpus_counts(own, known, learn)
    table = log_odds(corpus, total, other, toxic, (documents[0], documents[1]), learn)
    shared = sample.sparkSession.sparkContext.broadcast(Model(table, learn, known))
    grid = 4096  # of scores, from -16 to 16

    def ordinary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(grid, np.int64)
        for chunk in chunks(batches):
            s = shared.value.scores(t := Tokens(chunk, learn))
            clean = (chunk.rows.column("toxic").to_numpy() == 0)[t.words.doc_of()]
            total += np.bincount(np.clip((s[clean] + 16) * (grid / 32), 0, grid - 1).astype(np.int64), minlength=grid)
        yield counted(np.arange(grid), total)

    histogram = np.zeros(grid, np.int64)
    for r in added_up(sample.mapInArrow(ordinary, COUNTS)).collect():  # grid rows
        histogram[r["key"]] = r["n"]
    rate = solve_rate((np.arange(grid) + 0.5) * (32 / grid) - 16, histogram) if histogram.any() else 1.0

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            t = Tokens(chunk, learn)
            sums = [max((x[2] for x in f), default=0.0) for f in shared.value.segments(t)]
            yield pa.RecordBatch.from_arrays([chunk.rows.column("toxic"), pa.array(np.diff(t.words.docs)), pa.array(sums, pa.float64())], ["toxic", "words", "best"])

    rows = sample.mapInArrow(best, "toxic int, words long, best double").toPandas()  # at most learn.most rows
    clean = rows[(rows["toxic"] == 0) & (rows["best"] > 0)]
    euler = 0.5772156649015329  # the mean of a standard extreme value
    log_k = float((rate * clean["best"] - np.log(clean["words"])).mean() - euler) if len(clean) else 0.0
    model = Model(None, learn, None, rate, log_k)  # for its calibration only

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            t = Tokens(chunk, learn)
            x = [model.features(f, int(m)) for f, m in zip(shared.value.segments(t), np.diff(t.words.docs), strict=True)]
            yield pa.RecordBatch.from_arrays([chunk.rows.column("toxic"), *(pa.array(c, pa.float64()) for c in zip(*x, strict=True))], ["toxic", "best", "all"])

    rows = sample.mapInArrow(described, "toxic int, best double, all double").toPandas()  # at most learn.most rows
    discard(sample)
    return Model(table, learn, known, rate, log_k, tuple(fit_logistic(rows[["best", "all"]].to_numpy(), rows["toxic"].to_numpy(float))))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted and the significant passages by byte."""
    own = documents_view(docs).withColumn("held_out", held_out(F.col("doc_id")))
    shared = own.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("sum", pa.float64()), ("p", pa.float64())]))
        for chunk in chunks(batches):
            passages, features = [], []
            if m.table is None:
                values = np.zeros(len(chunk.ids))
                passages = [[] for _ in chunk.ids]
            else:
                t = Tokens(chunk, m.learn)
                w, words = t.words, np.diff(t.words.docs)
                for i, found in enumerate(m.segments(t)):
                    features.append(m.features(found, int(words[i])))
                    told = [(a, b, total, m.p(total, int(words[i]))) for a, b, total in found]
                    begin = int(chunk.bounds[i])
                    passages.append([{"start": int(w.start[a]) - begin, "end": int(w.end[b]) - begin, "sum": total, "p": p} for a, b, total, p in told if p <= m.learn.significant])
                values = m.probability(np.array(features))
            yield pa.RecordBatch.from_arrays([chunk.rows.column("doc_id"), chunk.rows.column("held_out"), pa.array(values), pa.array((values >= 0.5).astype(np.int32)), pa.array(passages, kind)], ["doc_id", "held_out", "score", "predicted", "passages"])

    return own.mapInArrow(run, SCORED)


def toxicity(docs: DataFrame, labels: DataFrame, learn: Learning = Learning()) -> DataFrame:
    return score(docs, fit(docs, labels, learn))


def keep_clean(docs: DataFrame, labels: DataFrame, learn: Learning = Learning()) -> DataFrame:
    """The rows of ``docs`` whose text the model does not reject, with all their columns."""
    model = fit(docs, labels, learn)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for chunk in chunks(batches):
            if m.table is None:
                yield chunk.rows
                continue
            t = Tokens(chunk, m.learn)
            x = [m.features(found, int(n)) for found, n in zip(m.segments(t), np.diff(t.words.docs), strict=True)]
            yield chunk.rows.filter(pa.array(m.probability(np.array(x)) < 0.5))

    return docs.mapInArrow(run, docs.schema)
