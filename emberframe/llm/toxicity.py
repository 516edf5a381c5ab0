"""Toxicity: weak supervision by many lexicon and pattern voters.

1. Words, pairs of words and word beginnings that stand out in toxic rows are
   counted on a sample of at most ``SAMPLE`` labelled rows of the learning fold
   (Spark sums the counts by feature) and give lexicons: strong ones of each kind,
   dealt at random to several voters, and a wide one of weaker features.  A seed
   lexicon of common insults votes too, and so do patterns that look at no lexicon
   (marks in rows, drawn-out letters, digits within words, capitals) or at one
   only beside something else (a seed word near an address).  A voter says toxic
   (1), clean (0) or nothing (-1).
2. A generative label model is fitted by expectation maximisation on the votes
   alone: class prior, each voter's accuracy table, and correlations.  Pairs of
   voters that go together beyond what the class explains (mutual information
   given the class, under the current posterior) form a tree; a voter's table is
   conditioned on its parent in it, so votes that repeat each other count once.
3. A linear classifier over the lexicon features is trained in numpy, from zero,
   on the posterior labels alone; two numbers (stretch and shift) calibrate its
   logits on the sample's labels, which moves the threshold and not the order.
   It scores whole texts.

Defined cases: null and empty texts have no features and get the classifier's
bias; rows without a label, with a null label or outside the learning fold teach
nothing; without toxic rows in the sample only the seed lexicon and the patterns
vote; repeated labels of a doc_id count by their mean; an empty table gives no
rows; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.llm.common import Texts, in_fold, mix64, slices
from emberframe.llm.quality import labelled_sample
from emberframe.llm.words import tokenise

SAMPLE = 20_000
PREFIXES = (4, 5, 6)
#: Log odds (toxic against clean rows that hold it) of the wide and of the strong lexicons.
WIDE, STRONG = 2.0, 4.25
#: Voters that each kind of strong lexicon is dealt to.
VOTERS = 4

#: Common English insults, a seed only; the learnt lexicons add other words and languages.
SEED_WORDS = (
    "idiot idiots moron morons stupid dumb fool loser losers trash garbage scum worthless pathetic disgusting clown filth vermin "
    "jerk imbecile cretin bastard bitch asshole shit fuck fucking whore slut retard degenerate parasite maggot pig swine liar coward"
).split()


#: Words that address someone.
ADDRESS = "you your youre yourself u ur du dich dir ihr euch tu toi vous te ti voi".split()
#: Tokens between an address and a seed word at most.
NEARBY = 4


def _address_hashes() -> np.ndarray:
    return np.unique(tokenise(Texts(pa.array(ADDRESS)), folded=True).hash)


def _seed_hashes() -> np.ndarray:
    return np.unique(tokenise(Texts(pa.array(SEED_WORDS)), folded=True).hash)


def _kinds(texts: Texts) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, feature, kind) of every letter run (kind 0), of it and the one before (kind 2), and of its first n bytes (kind n)."""
    tok = tokenise(texts, folded=True)
    words = tok.kind == 1
    row, word = tok.row[words], tok.hash[words]
    yield row, word, np.zeros(len(row), np.int8)
    pair = np.flatnonzero(row[1:] == row[:-1]) + 1
    yield row[pair], mix64(word[pair - 1] + np.uint64(2)) + word[pair], np.full(len(pair), 2, np.int8)
    for n in PREFIXES:
        h = tok.prefix(n)[words]
        some = np.flatnonzero(h)
        yield row[some], h[some], np.full(len(some), n, np.int8)


def features(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, kind) of the letter runs, each once a row."""
    row, feature, kind = (np.concatenate(x) for x in zip(*_kinds(texts), strict=True))
    _, first = np.unique(feature ^ mix64(row.astype(np.uint64) + np.uint64(3)), return_index=True)
    return row[first], feature[first], kind[first]


@dataclass
class Lexicon:
    """Sorted feature hashes with their kind, log odds and whether they are strong."""

    feature: np.ndarray
    kind: np.ndarray
    odds: np.ndarray
    strong: np.ndarray

    def __post_init__(self):
        # one bit per possible low 20 bits: most features of clean texts end here
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.feature & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def find(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """(row, place in the lexicon) of the features found, each once a row."""
        out_rows, out_at = [], []
        for row, h, _ in _kinds(texts):
            maybe = np.flatnonzero(self.sieve[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
            at = np.searchsorted(self.feature, h[maybe])
            at[at == len(self.feature)] = 0
            hit = self.feature[at] == h[maybe] if len(self.feature) else np.zeros(len(maybe), bool)
            out_rows.append(row[maybe[hit]])
            out_at.append(at[hit])
        rows, at = np.concatenate(out_rows), np.concatenate(out_at)
        pairs = np.unique(rows * (len(self.feature) + 1) + at)
        return pairs // (len(self.feature) + 1), pairs % (len(self.feature) + 1)


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Features that stand out in the toxic rows of ``sample`` (doc_id, text, y); as many as there are, which the sample bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            row, feature, kind = features(Texts(batch.column("text")))
            bad = batch.column("y").to_numpy() >= 0.5
            u, first, where = np.unique(feature, return_index=True, return_inverse=True)
            toxic = np.bincount(where, weights=bad[row], minlength=len(u))
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(kind[first]), pa.array(toxic), pa.array(np.bincount(where, minlength=len(u)) - toxic)], ["feature", "kind", "toxic", "clean"])

    totals = sample.agg(F.sum((F.col("y") >= 0.5).cast("long")).alias("toxic"), F.count("*").alias("n")).first()
    bad, good = totals.toxic or 0, totals.n - (totals.toxic or 0)
    seeds = _seed_hashes()
    counted = sample.select("text", "y").mapInArrow(run, "feature long, kind byte, toxic double, clean double").groupBy("feature").agg(F.max("kind").alias("kind"), F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("toxic") + 0.1) / (bad + 1)) - F.log((F.col("clean") + 0.5) / (good + 1))
    rows = counted.where("toxic >= 3").withColumn("odds", odds).where(F.col("odds") >= WIDE).toPandas()
    feature, kind = rows["feature"].to_numpy(np.int64).view(np.uint64), rows["kind"].to_numpy(np.int8)
    odds_, strong = rows["odds"].to_numpy(float), (rows["odds"] >= STRONG).to_numpy(bool)
    new = seeds[~np.isin(seeds, feature)]
    feature = np.concatenate([feature, new])
    order = np.argsort(feature)
    pad = lambda x, v: np.concatenate([x, np.full(len(new), v, x.dtype)])[order]
    return Lexicon(feature[order], pad(kind, 0), pad(odds_, 0.0), pad(strong, False))


def _patterns(texts: Texts) -> Iterator[np.ndarray]:
    """Votes that look at the shape of a text."""
    data, row = texts.bytes, texts.rows()
    share = lambda at: np.bincount(row[at], minlength=texts.n) / np.maximum(texts.lengths, 1)
    letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    same = np.zeros(len(data), bool)  # the third of three equal bytes
    same[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & (row[2:] == row[:-2])
    digit = np.zeros(len(data), bool)  # a digit or mark between two letters
    digit[1:-1] = letter[2:] & letter[:-2] & np.isin(data[1:-1], list(b"0134579@$")) & (row[2:] == row[:-2])
    marks = np.isin(data, list(b"!?"))
    yield np.where(share(np.flatnonzero(same & marks)) > 0.002, 1, -1)
    yield np.where(share(np.flatnonzero(same & letter)) > 0.002, 1, -1)
    yield np.where(share(np.flatnonzero(digit)) > 0.002, 1, -1)
    yield np.where(share(np.flatnonzero(letter & (data < 97))) > 0.3, 1, -1)
    tok = tokenise(texts, folded=True)
    you, slur = (np.flatnonzero(np.isin(tok.hash, h)) for h in (_address_hashes(), _seed_hashes()))
    before = np.searchsorted(you, slur)
    near = np.zeros(len(slur), bool)
    for other in (before - 1, before):
        ok = (other >= 0) & (other < len(you))
        at = you[other[ok]]
        near[ok] |= (np.abs(at - slur[ok]) <= NEARBY) & (tok.row[at] == tok.row[slur[ok]])
    yield np.where(np.bincount(tok.row[slur[near]], minlength=texts.n) > 0, 1, -1)


def votes(texts: Texts, lexicon: Lexicon, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(rows, voters) of 1, 0 or -1."""
    out = []
    count = lambda which: np.bincount(rows[which[at]], minlength=texts.n)
    deal = (mix64(lexicon.feature) >> np.uint64(40)) % np.uint64(VOTERS)
    for kinds in ((0,), (2,), PREFIXES):
        of_kind = lexicon.strong & np.isin(lexicon.kind, kinds)
        for v in range(VOTERS):
            out.append(np.where(count(of_kind & (deal == v)) > 0, 1, -1))
    seeds = np.isin(lexicon.feature, _seed_hashes())
    for v in range(VOTERS):
        out.append(np.where(count(seeds & (deal == v)) > 0, 1, -1))
    strong, weak = count(lexicon.strong | seeds), count(np.ones(len(lexicon.feature), bool))
    out.append(np.where(strong >= 2, 1, -1))  # several strong hits
    out.append(np.where(strong == 0, 0, -1))  # none at all
    out.append(np.where(weak == 0, 0, np.where((weak >= 4) & (weak * 400 > texts.lengths), 1, -1)))
    out.append(np.where((texts.lengths > 400) & (weak * 1000 < texts.lengths), 0, -1))  # long prose with next to no weak hits
    out.extend(_patterns(texts))
    return np.stack(out, axis=1).astype(np.int8)


class LabelModel:
    """P(class), and P(vote | class, parent's vote) along a tree of correlated voters."""

    def fit(self, votes: np.ndarray, rounds: int = 25) -> LabelModel:
        patterns, where = np.unique(votes + 1, axis=0, return_inverse=True)
        n = np.bincount(where.ravel()).astype(float)
        balance = ((patterns == 2).sum(1) - 0.5 * (patterns == 1).sum(1)) > 0
        post = np.where(balance, 0.9, 0.05)  # start from the votes' majority
        m = patterns.shape[1]
        hot = np.stack([patterns == k for k in range(3)], axis=2).astype(float)  # pattern, voter, vote
        self.parent = np.full(m, -1)
        for turn in range(rounds):
            weight = np.stack([n * (1 - post), n * post])
            self.prior = (weight.sum(1) + 1) / (n.sum() + 2)
            if turn in (3, 10):
                self.parent = self._tree(weight, hot)
            self.tables = []
            for v in range(m):
                given = np.ones((len(patterns), 1)) if self.parent[v] < 0 else hot[:, self.parent[v]]
                table = np.einsum("cp,pg,pk->cgk", weight, given, hot[:, v]) + 0.1
                self.tables.append(np.log(table / table.sum(2, keepdims=True)))
            post = self._posterior(patterns)
        return self

    @staticmethod
    def _tree(weight: np.ndarray, hot: np.ndarray) -> np.ndarray:
        """Maximum spanning forest of mutual information given the class; parents, -1 for roots."""
        m = hot.shape[1]
        joint = np.einsum("cp,pak,pbl->cabkl", weight, hot, hot) + 1e-9
        joint /= joint.sum((0, 3, 4), keepdims=True)
        one = joint.sum(4, keepdims=True)
        other = joint.sum(3, keepdims=True)
        both = joint.sum((3, 4), keepdims=True)
        info = (joint * np.log(joint * both / (one * other))).sum((0, 3, 4))
        np.fill_diagonal(info, 0)
        parent, inside = np.full(m, -1), {0}
        while len(inside) < m:
            rest = [v for v in range(m) if v not in inside]
            a, b = max(((a, b) for a in inside for b in rest), key=lambda x: info[x])
            if info[a, b] > 0.002:
                parent[b] = a
            inside.add(b)
        return parent

    def _posterior(self, patterns: np.ndarray) -> np.ndarray:
        z = np.log(self.prior)[:, None] + np.zeros((2, len(patterns)))
        for v, table in enumerate(self.tables):
            given = np.zeros(len(patterns), int) if self.parent[v] < 0 else patterns[:, self.parent[v]]
            z += table[:, given, patterns[:, v]]
        return 1 / (1 + np.exp((z[0] - z[1]).clip(-50, 50)))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return self._posterior(votes.astype(int) + 1)


@dataclass
class Linear:
    weights: np.ndarray
    bias: float

    def score(self, n: int, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        z = self.bias + np.bincount(rows, weights=self.weights[at], minlength=n)
        return 1 / (1 + np.exp(-z.clip(-30, 30)))


def fit_linear(n: int, rows: np.ndarray, at: np.ndarray, width: int, y: np.ndarray, steps: int = 400, rate: float = 0.05, decay: float = 2e-4) -> Linear:
    """Logistic regression on soft labels, by Adam over all rows."""
    w, b = np.zeros(width), float(np.log((y.mean() + 1e-4) / (1 - y.mean() + 1e-4)))
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    for t in range(1, steps + 1):
        d = Linear(w, b).score(n, rows, at) - y
        g, gb = np.bincount(at, weights=d[rows], minlength=width) / n + decay * w, d.mean()
        m, v, mb, vb = m + 0.1 * (g - m), v + 0.01 * (g * g - v), mb + 0.1 * (gb - mb), vb + 0.01 * (gb * gb - vb)
        step = rate * (1 - 0.99**t) ** 0.5 / (1 - 0.9**t)
        w, b = w - step * m / (np.sqrt(v) + 1e-8), b - step * mb / (vb**0.5 + 1e-8)
    return Linear(w, b)


def calibrated(model: Linear, n: int, rows: np.ndarray, at: np.ndarray, y: np.ndarray, steps: int = 300) -> Linear:
    """The classifier with its logits stretched and shifted to fit the sample's own labels; what stands out, and in which order, stays."""
    if y.min() == y.max():
        return model
    z = model.bias + np.bincount(rows, weights=model.weights[at], minlength=n)
    a, b, rate = 1.0, 0.0, 0.5
    for _ in range(steps):
        d = 1 / (1 + np.exp(-(a * z + b).clip(-30, 30))) - y
        a, b = min(max(a - rate * float((d * z).mean()), 0.5), 3.0), b - rate * float(d.mean())
    return Linear(model.weights * a, model.bias * a + b)


def train(docs: DataFrame, labels: DataFrame, learn: Column, size: int = SAMPLE) -> tuple[Lexicon, Linear]:
    sample = labelled_sample(docs, labels, "toxic", learn, size)
    lexicon = learn_lexicon(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = Texts(batch.column("text"))
            rows, at = lexicon.find(texts)
            found = np.split(at, np.searchsorted(rows, np.arange(1, texts.n)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("y"), pa.array([x.tolist() for x in found], pa.list_(pa.int32())), pa.array(votes(texts, lexicon, rows, at).tolist(), pa.list_(pa.int8()))], ["doc_id", "y", "found", "votes"]
            )

    held = sample.select("doc_id", "text", "y").mapInArrow(run, "doc_id long, y double, found array<int>, votes array<byte>").toPandas()
    if not len(held):
        return lexicon, Linear(np.full(len(lexicon.feature), 2.0), -2.0)
    held = held.iloc[np.lexsort((held["found"].map(len), held["doc_id"]))]
    ballots = np.stack(held["votes"].to_numpy()).astype(np.int8)
    post = LabelModel().fit(ballots).posterior(ballots)
    lengths = held["found"].map(len).to_numpy()
    rows = np.repeat(np.arange(len(held)), lengths)
    at = np.concatenate([np.asarray(x, np.int64) for x in held["found"]]) if lengths.sum() else np.zeros(0, np.int64)
    model = fit_linear(len(held), rows, at, len(lexicon.feature), post)
    return lexicon, calibrated(model, len(held), rows, at, held["y"].to_numpy())


def scores(docs: DataFrame, labels: DataFrame, learn: Column, size: int = SAMPLE) -> DataFrame:
    """``docs`` with a column ``score``: the probability of being toxic."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, learn, size))

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        lexicon, linear = model.value
        out = [np.zeros(0)]
        for run in slices(iter([pa.RecordBatch.from_arrays([text], ["text"])])):
            texts = Texts(run.column(0))
            out.append(linear.score(texts.n, *lexicon.find(texts)))
        return pa.array(np.concatenate(out))

    return docs.withColumn("score", score("text"))


def predictions(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    scored = scores(docs.select("doc_id", "text"), labels, ~in_fold("doc_id", 3, 1))
    return scored.select("doc_id", in_fold("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
