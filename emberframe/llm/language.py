"""Language identification by a bidirectional gated recurrent network over bytes.

The bytes of a text (capitals folded) run through two gated recurrent layers, one
in reading order and one against it, in windows of ``WINDOW`` bytes; the states
start anew at each window, in learning as in use.  From both states every
position gets a probability for each language, and a document's probabilities are
the mean over all its positions.  The gates and the candidate state use clipped
linear functions, which numpy evaluates many times faster than exponentials.

The network is trained in numpy by backpropagation through time on the whole texts
of at most ``SAMPLE`` documents (least hash of doc_id) that have a language and
belong to the learning fold; every window is learnt from once at least.

Defined cases: a text that is null or has no letter is ``und`` with score 0; so is
every text if there is nothing to learn from; null doc_ids are labelled like
others but teach nothing; of rows with one doc_id that of the least text hash teaches; ties go to the language that sorts first; an empty
table gives no rows; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.llm.common import Texts, in_fold, sampled_rows, slices
from emberframe.llm.words import fold

WINDOW = 64
STATE = 8
EMBED = 4
SAMPLE = 4000
#: Windows that run through the network together.
LANES = 4096
_FILL = 32


class Layer:
    """One direction: gates z, r = clip(Wg [h; e; 1]); c = clip(Wc [r h; e; 1]); h += z (c - h)."""

    def __init__(self, rng: np.random.Generator):
        n = STATE + EMBED + 1
        self.gates = (rng.normal(0, 0.25 * n**-0.5, (2 * STATE, n))).astype(np.float32)
        self.gates[:, -1] = 0.5
        self.candidate = rng.normal(0, n**-0.5, (STATE, n)).astype(np.float32)

    def run(self, embedded: Iterator[np.ndarray], lanes: int) -> Iterator[np.ndarray]:
        """States after every step; the array that is yielded is used again."""
        x = np.ones((STATE + EMBED + 1, lanes), np.float32)
        y = np.ones_like(x)
        g, c = np.empty((2 * STATE, lanes), np.float32), np.empty((STATE, lanes), np.float32)
        h = x[:STATE]
        h[:] = 0
        for e in embedded:
            x[STATE:-1] = e
            y[STATE:-1] = e
            np.matmul(self.gates, x, out=g)
            np.clip(g, 0, 1, out=g)
            np.multiply(g[STATE:], h, out=y[:STATE])
            np.matmul(self.candidate, y, out=c)
            np.clip(c, -1, 1, out=c)
            c -= h
            c *= g[:STATE]
            h += c
            yield h

    def forward(self, embedded: list[np.ndarray]) -> tuple[list[np.ndarray], list[tuple]]:
        """States, and what ``backward`` needs."""
        h = np.zeros((STATE, embedded[0].shape[1]), np.float32)
        one = np.ones((1, h.shape[1]), np.float32)
        states, tape = [], []
        for e in embedded:
            x = np.concatenate([h, e, one])
            a = self.gates @ x
            g = a.clip(0, 1)
            y = np.concatenate([g[STATE:] * h, e, one])
            b = self.candidate @ y
            c = b.clip(-1, 1)
            tape.append((x, a, g, y, b, c))
            h = h + g[:STATE] * (c - h)
            states.append(h)
        return states, tape

    def backward(self, tape: list[tuple], d_states: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Gradients of the gates, of the candidate, and of every step's embedding."""
        d_gates, d_candidate, d_embedded = np.zeros_like(self.gates), np.zeros_like(self.candidate), []
        dh = np.zeros_like(d_states[0])
        for (x, a, g, y, b, c), ds in zip(reversed(tape), reversed(d_states), strict=True):
            dh = dh + ds
            h, z, r = x[:STATE], g[:STATE], g[STATE:]
            db = dh * z * (np.abs(b) < 1)
            d_candidate += db @ y.T
            dy = self.candidate.T @ db
            da = np.concatenate([dh * (c - h), dy[:STATE] * h]) * ((a > 0) & (a < 1))
            d_gates += da @ x.T
            dx = self.gates.T @ da
            dh = dh * (1 - z) + dy[:STATE] * r + dx[:STATE]
            d_embedded.append(dx[STATE:-1] + dy[STATE:-1])
        return d_gates, d_candidate, d_embedded[::-1]


class Network:
    def __init__(self, languages: list[str], seed: int = 3):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.there, self.back = Layer(rng), Layer(rng)
        self.out = rng.normal(0, 0.3, (len(languages), 2 * STATE + 1)).astype(np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.there.gates, self.there.candidate, self.back.gates, self.back.candidate, self.out]

    def label(self, x: np.ndarray, real: np.ndarray) -> np.ndarray:
        """Summed position probabilities (languages, lanes) of windows x (WINDOW, lanes); ``real`` marks bytes of the text."""
        lanes = x.shape[1]
        embedded = [np.ascontiguousarray(self.embed[row].T) for row in x]
        ahead = np.empty((len(x), STATE, lanes), np.float32)
        for t, h in enumerate(self.there.run(iter(embedded), lanes)):
            ahead[t] = h
        both, total = np.ones((2 * STATE + 1, lanes), np.float32), np.zeros((len(self.languages), lanes), np.float32)
        p = np.empty_like(total)
        for t, h in zip(reversed(range(len(x))), self.back.run(reversed(embedded), lanes), strict=True):
            both[:STATE] = ahead[t]
            both[STATE:-1] = h
            np.matmul(self.out, both, out=p)
            np.clip(p, -20, 20, out=p)
            np.exp(p, out=p)
            p *= real[t] / p.sum(0)
            total += p
        return total

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Cross entropy over all positions of windows x (WINDOW, lanes) with languages y, and its gradients."""
        embedded = [np.ascontiguousarray(self.embed[row].T) for row in x]
        ahead, tape = self.there.forward(embedded)
        behind, tape_back = self.back.forward(embedded[::-1])
        behind = behind[::-1]
        d_out, d_ahead, d_behind, loss = np.zeros_like(self.out), [], [], 0.0
        one = np.ones((1, x.shape[1]), np.float32)
        lanes = np.arange(x.shape[1])
        for f, b in zip(ahead, behind, strict=True):
            both = np.concatenate([f, b, one])
            z = self.out @ both
            p = np.exp(z - z.max(0))
            p /= p.sum(0)
            loss -= float((np.log(p[y, lanes] + 1e-9) * weight).sum())
            p[y, lanes] -= 1
            p *= weight / len(x)
            d_out += p @ both.T
            d = self.out.T @ p
            d_ahead.append(d[:STATE])
            d_behind.append(d[STATE:-1])
        gf, cf, ef = self.there.backward(tape, d_ahead)
        gb, cb, eb = self.back.backward(tape_back, d_behind[::-1])
        d_embed = np.zeros_like(self.embed)
        np.add.at(d_embed, x.ravel(), np.concatenate([(a + b).T for a, b in zip(ef, eb[::-1], strict=True)]))
        return loss / len(x), [d_embed, gf, cf, gb, cb, d_out]

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 500, lanes: int = 192, rate: float = 0.02, seed: int = 9) -> None:
        """At least ``steps`` batches, and as many as take every window once."""
        rng, params = np.random.default_rng(seed), self.parameters()
        steps = max(steps, -(-len(y) // lanes))
        order = np.concatenate([rng.permutation(len(y)) for _ in range(-(-steps * lanes // len(y)))])
        share = np.bincount(y, minlength=len(self.languages)) / len(y)
        balance = ((np.maximum(share, 1e-6) ** -0.5)[y] * weight).astype(np.float32)
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for t in range(1, steps + 1):
            pick = order[(t - 1) * lanes : t * lanes]
            _, grads = self.gradients(np.ascontiguousarray(x[pick].T), y[pick], balance[pick] / balance[pick].sum())
            norm = float(sum((g**2).sum() for g in grads)) ** 0.5
            step = rate * (1 - t / (steps + 1)) * (1 - 0.99**t) ** 0.5 / (1 - 0.9**t)
            for p, g, mi, vi in zip(params, grads, m, v, strict=True):
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                mi += 0.1 * (g - mi)
                vi += 0.01 * (g * g - vi)
                p -= step * mi / (np.sqrt(vi) + 1e-7)


def windows(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(folded bytes with fill behind, first byte, bytes, row) of the windows that cover the texts."""
    count = -(-texts.lengths // WINDOW)
    row = np.repeat(np.arange(texts.n), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = texts.offsets[:-1][row] + nth * WINDOW
    data = np.concatenate([fold(texts.bytes), np.full(WINDOW, _FILL, np.uint8)])
    return data, start, np.minimum(WINDOW, texts.offsets[1:][row] - start), row


def cut_windows(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(WINDOW, lanes) bytes with fill, and which of them belong to the window."""
    step = np.arange(WINDOW)[:, None]
    real = step < size
    return np.where(real, data[np.minimum(start + step, len(data) - 1)], np.uint8(_FILL)), real.astype(np.float32)


def probabilities(texts: Texts, net: Network) -> np.ndarray:
    """(rows, languages): mean position probabilities; zeros for an empty text."""
    data, start, size, row = windows(texts)
    total = np.zeros((texts.n, len(net.languages)))
    for lo in range(0, len(start), LANES):
        part = slice(lo, lo + LANES)
        np.add.at(total, row[part], net.label(*cut_windows(data, start[part], size[part])).T)
    return total / np.maximum(texts.lengths, 1)[:, None]


def train(docs: DataFrame, learn: Column, size: int = SAMPLE) -> Network | None:
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)) & learn)
    chosen = sampled_rows(rows, ["lang"], size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, start, bytes_, row = windows(Texts(batch.column("text")))
            cells, _ = cut_windows(data, start, bytes_)
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1)) * WINDOW
            flat = np.ascontiguousarray(cells.T).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array([flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], ["doc_id", "lang", "bytes"])

    sample = chosen.mapInArrow(run, "doc_id long, lang string, bytes binary").toPandas()
    if not len(sample):
        return None
    sample = sample.sort_values("doc_id", kind="stable")
    languages = sorted(sample["lang"].unique())
    x = np.frombuffer(b"".join(sample["bytes"]), np.uint8).reshape(-1, WINDOW)
    each = (sample["bytes"].map(len) // WINDOW).to_numpy()
    y = np.repeat(np.searchsorted(languages, sample["lang"].to_numpy()), each)
    net = Network(languages)
    if len(languages) > 1:
        net.fit(x, y, np.repeat(each**-0.5, each))  # a long text counts for more than a short one, not for all of its windows
    return net


def predictions(docs: DataFrame, size: int = SAMPLE) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    held_out = in_fold("doc_id", 4, 2)
    model = docs.sparkSession.sparkContext.broadcast(train(docs, ~held_out, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for batch in slices(batches, limit=1 << 20):
            lettered = batch.column("lettered").to_numpy(zero_copy_only=False).astype(bool)
            names, score = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows)
            if net is not None:
                p = probabilities(Texts(batch.column("text")), net)
                best = p.argmax(1)
                names[lettered] = np.array(net.languages, object)[best[lettered]]
                score[lettered] = p.max(1)[lettered].clip(0, 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
