"""Quality classifier: random-indexing word vectors and a small calibrated network.

1. Every token (case kept; runs of letters, digits or marks) falls into one of
   ``BUCKETS`` buckets by hash.  A bucket has a sparse random index vector; its
   context vector is the sum of the index vectors met within ``REACH`` tokens,
   counted over all documents: each task adds up a table of its own, Spark sums
   the tables by bucket.  The result has BUCKETS x DIM numbers at any input size,
   which is why it may go through the driver and be broadcast.
2. A document is the mean, the spread and the neighbour product of its tokens'
   context vectors.
3. A network with one hidden layer is trained in numpy on a sample of at most
   ``SAMPLE`` labelled rows (those with the least hash of doc_id); a temperature
   fitted on a fifth of them that it was not trained on scales its outputs.

Defined cases: null and empty texts pool to zeros and get the network's output
for that; rows without a label, with a null label or outside the learning fold
teach nothing; repeated labels of a doc_id count by their mean; without both
labels in the sample every score is the sample's share of label 1 (0.5 without
any); an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.llm.common import Texts, fresh, hash_sample, in_fold, mix64, slices, text_key
from emberframe.llm.words import tokenise

BUCKETS = 1 << 15
DIM = 32
REACH = 2
SAMPLE = 20_000
_DIMS = [f"d{i}" for i in range(DIM)]


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Two non-zero places of each bucket's index vector, and their signs."""
    r = mix64(np.arange(BUCKETS, dtype=np.uint64) + np.uint64(77))
    a = r % np.uint64(DIM)
    b = (a + 1 + (r >> np.uint64(20)) % np.uint64(DIM - 1)) % np.uint64(DIM)
    signs = np.stack([(r >> np.uint64(50)) & np.uint64(1), (r >> np.uint64(51)) & np.uint64(1)]).astype(np.int32) * 2 - 1
    return np.stack([a, b]).astype(np.int64), signs


def context_counts(docs: DataFrame) -> DataFrame:
    """(bucket, n, d0..): tokens seen and summed neighbours' index vectors over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = _index_vectors()
        sums, seen = np.zeros(BUCKETS * DIM, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in slices(batches, limit=1 << 20):
            tok = tokenise(Texts(batch.column("text")), folded=False)
            bucket = (tok.hash >> np.uint64(49)).astype(np.int64)
            seen += np.bincount(bucket, minlength=BUCKETS)
            for gap in range(1, REACH + 1):
                near = tok.row[gap:] == tok.row[:-gap]
                left, right = bucket[:-gap][near], bucket[gap:][near]
                for centre, other in ((left, right), (right, left)):
                    for p, s in zip(places, signs, strict=True):
                        np.add.at(sums, centre * DIM + p[other], s[other])
        held = np.flatnonzero(seen)
        table = sums.reshape(BUCKETS, DIM)[held]
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(seen[held]), *(pa.array(table[:, i].copy()) for i in range(DIM))], ["bucket", "n", *_DIMS])

    rows = docs.select("text").mapInArrow(run, "bucket long, n long, " + ", ".join(f"{d} long" for d in _DIMS))
    return rows.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in ("n", *_DIMS)))


def word_vectors(docs: DataFrame) -> np.ndarray:
    """(BUCKETS, DIM) float32: mean context by bucket, centred and scaled over all tokens."""
    rows = context_counts(docs).toPandas()
    n, sums = np.zeros(BUCKETS), np.zeros((BUCKETS, DIM))
    n[rows["bucket"]] = rows["n"]
    sums[rows["bucket"]] = rows[_DIMS].to_numpy(float)
    mean = sums / np.maximum(n, 1)[:, None]
    share = (n / max(n.sum(), 1))[:, None]
    centre = (mean * share).sum(0)
    spread = np.sqrt(((mean - centre) ** 2 * share).sum(0)) + 1e-9
    return np.where(n[:, None] > 0, (mean - centre) / spread, 0).astype(np.float32)


def pooled(texts: Texts, vectors: np.ndarray) -> np.ndarray:
    """(rows, 3 DIM + 1) float32: mean, spread and product with the next token, and whether there is a token."""
    tok = tokenise(texts, folded=False)
    out = np.zeros((texts.n, 3 * DIM + 1), np.float32)
    if not len(tok.row):
        return out
    v = vectors[(tok.hash >> np.uint64(49)).astype(np.int64)]
    rows, starts, counts = np.unique(tok.row, return_index=True, return_counts=True)
    after = np.empty_like(v)
    after[:-1] = v[1:]
    after[starts + counts - 1] = v[starts]  # the last token meets the first
    mean = np.add.reduceat(v, starts, axis=0) / counts[:, None]
    out[rows, :DIM] = mean
    after *= v
    out[rows, 2 * DIM : -1] = np.add.reduceat(after, starts, axis=0) / counts[:, None]
    np.square(v, out=v)
    out[rows, DIM : 2 * DIM] = np.sqrt(np.maximum(np.add.reduceat(v, starts, axis=0) / counts[:, None] - mean**2, 0))
    out[rows, -1] = 1
    return out


class Network:
    """Inputs -> tanh layer -> one logit, by Adam on cross entropy."""

    def __init__(self, width: int, hidden: int = 32, seed: int = 5):
        self.rng = np.random.default_rng(seed)
        self.p = [self.rng.normal(0, width**-0.5, (width, hidden)), np.zeros(hidden), self.rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
        self.temperature = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w, b, u, c = self.p
        return np.tanh(((x - self.centre) / self.spread).clip(-8, 8) @ w + b) @ u + c[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.logits(x) / self.temperature).clip(-30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 30, batch: int = 256, rate: float = 3e-3, decay: float = 1e-4) -> None:
        self.centre, self.spread = x.mean(0), x.std(0) + 1e-6
        x = ((x - self.centre) / self.spread).clip(-8, 8)
        m, v, t = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0
        for epoch in range(epochs):
            order = self.rng.permutation(len(x))
            for start in range(0, len(x), batch):
                xs, ys = x[order[start : start + batch]], y[order[start : start + batch]]
                w, b, u, c = self.p
                h = np.tanh(xs @ w + b)
                d = (1 / (1 + np.exp(-(h @ u + c[0]).clip(-30, 30))) - ys) / len(xs)
                dh = d[:, None] * u * (1 - h * h)
                grads, t = [xs.T @ dh + decay * w, dh.sum(0), h.T @ d + decay * u, d.sum(keepdims=True)], t + 1
                step = rate * (1 - epoch / epochs) * (1 - 0.999**t) ** 0.5 / (1 - 0.9**t)
                for p, g, mi, vi in zip(self.p, grads, m, v, strict=True):
                    mi += 0.1 * (g - mi)
                    vi += 0.001 * (g * g - vi)
                    p -= step * mi / (np.sqrt(vi) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The temperature of the least cross entropy on rows kept out of ``fit``."""
        z = self.logits(x)
        losses = {t: np.mean(np.logaddexp(0, z / t) - y * z / t) for t in np.geomspace(0.5, 8, 49)}
        self.temperature = float(min(losses, key=losses.get))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, size: int) -> DataFrame:
    """(doc_id, text, y) of at most ``size`` labelled ids of the learning fold, by least hash; a repeated id teaches with one of its texts."""
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & learn).groupBy("doc_id").agg(F.avg(F.col(label).cast("double")).alias("y"))
    _, chosen = hash_sample(rows, "doc_id", size)
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``size`` rows
    return met.groupBy("doc_id").agg(F.min_by("text", text_key()).alias("text"), F.first("y").alias("y"))


class Constant:
    def __init__(self, share: float):
        self.share = share

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.share)


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, learn: Column, size: int = SAMPLE):
    width = vectors.shape[1] * 3 + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=1 << 20):
            x = pooled(Texts(batch.column("text")), vectors)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(list(x), pa.list_(pa.float32()))], ["doc_id", "y", "x"])

    rows = labelled_sample(docs, labels, "quality", learn, size).mapInArrow(run, "doc_id long, y double, x array<float>").toPandas()
    if not len(rows):
        return Constant(0.5)
    x = np.stack(rows["x"].to_numpy()).reshape(len(rows), width)
    y = rows["y"].to_numpy()
    order = np.lexsort((*x.T[:2], rows["doc_id"].to_numpy()))
    x, y = x[order], y[order]
    if y.min() == y.max() or len(y) < 20:
        return Constant(float(y.mean()))
    held = np.arange(len(y)) % 5 == 4
    net = Network(width)
    net.fit(x[~held], y[~held])
    net.calibrate(x[held], y[held])
    return net


def scores(docs: DataFrame, labels: DataFrame, learn: Column, size: int = SAMPLE, column: str = "score") -> DataFrame:
    """``docs`` with a column of scores: the probability of quality 1."""
    vectors = word_vectors(docs)
    net = train(docs, labels, vectors, learn, size)
    model = docs.sparkSession.sparkContext.broadcast((vectors, net))

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        vectors, net = model.value
        runs = slices(iter([pa.RecordBatch.from_arrays([text], ["text"])]), limit=1 << 20)
        return pa.array(np.concatenate([np.zeros(0), *(net.score(pooled(Texts(run.column(0)), vectors)) for run in runs)]))

    return docs.withColumn(column, score("text"))


def learning_fold() -> Column:
    return ~in_fold("doc_id", 5, 0)


def predictions(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    scored = scores(docs.select("doc_id", "text"), labels, learning_fold())
    return scored.select("doc_id", in_fold("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents that the classifier doesn't reject, with all their columns."""
    column = fresh(docs, "score")
    return scores(docs, labels, learning_fold(), column=column).where(F.col(column) >= threshold).select(*docs.columns)
