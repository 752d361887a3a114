"""Toxicity by subword-bag embeddings.

A word is the mean of the embeddings of its character n-grams (3 to 6 code points
of ``<word>``) and of the whole word, all hashed into a fixed number of buckets; a
text is the mean of its words; a linear softmax on top gives the class.  Embeddings
and softmax are trained jointly in numpy (Adam), so an unseen misspelling shares
most of its vectors with the words it resembles.

Training uses a bounded sample of labelled rows: at most ``PER_CLASS`` texts of each
class, of at most ``MAX_TRAIN_CHARS`` code points each, taken in the order of a hash
of their id.  Scoring covers every whole text; since everything after the lookup is
linear, a bucket's embedding and the softmax fold into one number a bucket
(``BUCKETS`` floats), which is all that a task receives.

Letters are lower-cased; words are ``[^\\x20\\x09-\\x0D]+``.  A null or empty text
gets the score of the bias alone; without labels, or with labels of one class, the
score is that class's share (0 without any); very long texts are averaged whole;
equal rows get equal scores; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import BASE, BASE_INV, Words, chunks, mix, powers

BUCKETS = 1 << 18
DIM = 6
MIN_N, MAX_N = 3, 6
PER_CLASS = 1200
MAX_TRAIN_CHARS = 30_000
#: left out: buckets of fewer training texts, or whose rates in the classes differ by fewer standard errors
MIN_TEXTS = 5
MIN_Z = 5.0
FLOOR = 1e-6
EPOCHS = 200
RATES = (1.0, 0.02, 0.05)


@dataclass
class Model:
    weight: np.ndarray  # float32, one number a bucket
    bias: float


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word index, bucket) of every subword of every word."""
    marked = "".join(f"<{w}>" for w in words)
    points = np.frombuffer(marked.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    size = np.fromiter((len(w) + 2 for w in words), dtype=np.int64, count=len(words))
    first = np.concatenate([[0], np.cumsum(size)])
    h = np.zeros(len(points) + 1, dtype=np.uint64)
    np.cumsum(mix(points + np.uint64(0x5BD1E995)) * powers(BASE, len(points)), out=h[1:])
    back = powers(BASE_INV, len(points) + 1)
    index, bucket = [], []
    for n in (*range(MIN_N, MAX_N + 1), 0):
        count = np.maximum(0, size - n + 1) if n else (size > MAX_N).astype(np.int64)
        own = np.repeat(np.arange(len(words)), count)
        start = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count) + first[own]
        end = start + n if n else first[own + 1]
        index.append(own)
        bucket.append((mix((h[end] - h[start]) * back[start] + np.uint64(n)) % np.uint64(BUCKETS)).astype(np.int64))
    return np.concatenate(index), np.concatenate(bucket)


def _word_list(w: Words, at: np.ndarray) -> list[str]:
    data = w.data.tobytes()
    return [data[s:e].decode("utf-8", "replace") for s, e in zip(w.start[at].tolist(), w.end[at].tolist())]


def _texts_by_bucket(own, bucket, p_doc, p_kind, y) -> np.ndarray:
    """Number of training texts of each class that have each bucket; subwords of one text count once."""
    n_docs = len(y)
    order = np.argsort(own, kind="stable")
    own, bucket = own[order], bucket[order]
    first = np.searchsorted(own, np.arange(own[-1] + 2 if len(own) else 1))
    total = np.zeros((2, BUCKETS))
    ends = np.searchsorted(p_doc, np.arange(n_docs + 1))
    for d in range(n_docs):
        mine = p_kind[ends[d] : ends[d + 1]]
        if len(mine):
            size = first[mine + 1] - first[mine]
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[mine], size)
            total[int(y[d]), np.unique(bucket[at])] += 1
    return total


def train(texts: list[str], labels: list[int], prior: float, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Joint training over the texts; ``prior`` is the share of class 1 to calibrate for."""
    y = np.asarray(labels, dtype=np.float64)
    if len(y) == 0 or y.min() == y.max():
        share = min(max(prior if len(y) else 0.0, 1e-6), 1 - 1e-6)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    w = Words(pc.utf8_lower(pa.array(texts, pa.string())))
    _, at, kind = np.unique(w.hash, return_index=True, return_inverse=True)
    own, bucket = features(_word_list(w, at))
    n_kinds, n_docs = len(at), len(texts)
    kind_share = 1.0 / np.maximum(1, np.bincount(own, minlength=n_kinds))
    doc = np.repeat(np.arange(n_docs), w.counts())
    doc_share = 1.0 / np.maximum(1, w.counts())
    pair, count = np.unique(doc * np.int64(n_kinds) + kind, return_counts=True)
    p_doc, p_kind = pair // n_kinds, pair % n_kinds
    p_weight = count * doc_share[p_doc]
    # buckets that the two classes have at differing rates; a word's share still counts all of its subwords
    have, size = _texts_by_bucket(own, bucket, p_doc, p_kind, y), np.array([n_docs - y.sum(), y.sum()])
    rate, pooled = have / size[:, None], (have.sum(axis=0) + 1) / (n_docs + 2)
    kept = (np.abs(rate[1] - rate[0]) >= MIN_Z * np.sqrt(pooled * (1 - pooled) * (1 / size).sum()))[bucket] & (have.sum(axis=0) >= MIN_TEXTS)[bucket]
    own, bucket = own[kept], bucket[kept]
    used, bucket = np.unique(bucket, return_inverse=True)
    rng = np.random.Generator(np.random.PCG64(seed))
    params = [rng.uniform(-1, 1, (len(used), DIM)) * 1e-3, rng.uniform(-1, 1, (DIM, 2)), np.zeros(2)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    positive = y.mean()
    row_weight = np.where(y == 1, 0.5 / positive, 0.5 / (1 - positive)) / n_docs
    target = np.stack([1 - y, y], axis=1)
    rates = RATES
    for step in range(1, epochs + 1):
        emb, out, bias = params
        kinds = np.stack([np.bincount(own, emb[bucket, d], n_kinds) * kind_share for d in range(DIM)], axis=1)
        docs = np.stack([np.bincount(p_doc, kinds[p_kind, d] * p_weight, n_docs) for d in range(DIM)], axis=1)
        logits = docs @ out + bias
        logits -= logits.max(axis=1, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(axis=1, keepdims=True)
        g = (prob - target) * row_weight[:, None]
        g_docs = g @ out.T
        g_kinds = np.stack([np.bincount(p_kind, g_docs[p_doc, d] * p_weight, n_kinds) * kind_share for d in range(DIM)], axis=1)
        g_emb = np.stack([np.bincount(bucket, g_kinds[own, d], len(used)) for d in range(DIM)], axis=1)
        for i, grad in enumerate((g_emb, docs.T @ g, g.sum(axis=0))):
            first[i] = 0.9 * first[i] + 0.1 * grad
            second[i] = 0.99 * second[i] + 0.01 * grad * grad
            params[i] = params[i] - rates[i] * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + FLOOR)
    emb, out, bias = params
    weight = np.zeros(BUCKETS, np.float32)
    weight[used] = emb @ (out[:, 1] - out[:, 0])
    share = min(max(prior, 1e-6), 1 - 1e-6)
    return Model(weight, float(bias[1] - bias[0] + np.log(share / (1 - share))))


class Scorer:
    """Scores batches; remembers the words it has met, up to ``keep`` of them."""

    def __init__(self, model: Model, keep: int = 1 << 20) -> None:
        self.model, self.keep = model, keep
        self.hashes, self.values = np.zeros(0, np.uint64), np.zeros(0)

    def words(self, w: Words) -> np.ndarray:
        kinds, at, kind = np.unique(w.hash, return_index=True, return_inverse=True)
        place = np.searchsorted(self.hashes, kinds)
        known = place < len(self.hashes)
        known[known] = self.hashes[place[known]] == kinds[known]
        value = np.empty(len(kinds))
        value[known] = self.values[place[known]]
        new = np.flatnonzero(~known)
        if len(new):
            own, bucket = features(_word_list(w, at[new]))
            total = np.bincount(own, self.model.weight[bucket], len(new))
            value[new] = total / np.maximum(1, np.bincount(own, minlength=len(new)))
            if len(self.hashes) + len(new) > self.keep:
                self.hashes, self.values = np.zeros(0, np.uint64), np.zeros(0)
            place = np.searchsorted(self.hashes, kinds[new])
            self.hashes = np.insert(self.hashes, place, kinds[new])
            self.values = np.insert(self.values, place, value[new])
        return value[kind]

    def score(self, texts: pa.Array) -> np.ndarray:
        w = Words(pc.utf8_lower(texts.cast(pa.large_string())))
        n = w.counts()
        total = np.concatenate([[0.0], np.cumsum(self.words(w))]) if len(w.hash) else np.zeros(1)
        mean = (total[w.first[1:]] - total[w.first[:-1]]) / np.maximum(1, n)
        return 1.0 / (1.0 + np.exp(-np.clip(mean + self.model.bias, -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Trains on a bounded sample of labels (doc_id, toxic) joined with docs."""
    labels = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = labels.agg(F.avg("toxic")).first()[0] or 0.0
    part = lambda c: labels.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    chosen = part(0).unionByName(part(1))
    # at most 2 * per_class ids
    rows = (
        docs.select("doc_id", "text")
        .where(F.col("text").isNotNull() & (F.length("text") <= MAX_TRAIN_CHARS))
        .join(F.broadcast(chosen), "doc_id")
        .dropDuplicates(["doc_id"])
        .collect()
    )
    rows.sort(key=lambda r: r.doc_id)
    return train([r.text for r in rows], [r.toxic for r in rows], share)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for b in chunks(batch, "text"):
                yield pa.record_batch([b.column(0), pa.array(scorer.score(b.column(1)), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(task, "doc_id long, score double")
