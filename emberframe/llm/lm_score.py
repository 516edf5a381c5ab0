"""LM scoring by cross-entropy difference of two matched n-gram models.

Tokens are the words of a text (runs of anything but ASCII white space) and an
end mark.  Both models are bigram models over one vocabulary, all words of all
documents: P(w | c) = (n(c, w) + MU P(w)) / (n(c) + MU) with P(w) = (n(w) + NU / V)
/ (N + NU) and V different words (Dirichlet smoothing).  Target counts come from
the documents labelled as good, background counts from all documents, scaled to
the target's total so that smoothing takes the same share from both.  From every
count a document's own share is taken out before it is scored, so that a model
never knows a text from itself; a text that occurs elsewhere too shows.

Nothing is sampled or capped: words and pairs of words are counted over the whole
corpus and brought back to the texts by ``tally``, so what is gathered grows with
the corpus.  Words and pairs are known by hashes of log2(bytes of text) + SPARE
bits, so one pair in 2 ** SPARE counts another's share as well.

A document's score is the mean loss per token under the target model minus that
under the background model: lower is closer to the target.

Defined cases: null and empty texts have 0 words, losses and score 0; without
target documents the background stands for both and every score is 0; null
doc_ids are scored like others; rows with the same doc_id or text are scored row
by row; repeated labels count by their mean; an empty table gives no rows; other
columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.llm.common import Texts, mix64
from emberframe.llm.tally import key_bits, tallied, text_bytes
from emberframe.llm.words import word_hashes

#: Weight of the lower order, in tokens: of single words below pairs, of the even chance below words.
MU = 10.0
NU = 10_000.0
SPARE = 14
#: Documents labelled as good (16 bytes each) up to which they are broadcast; beyond, they are shuffled with the texts.
BROADCAST_ROWS = 1 << 20
START, END = np.uint64(0), np.uint64(1)


def good_documents(labels: DataFrame) -> DataFrame:
    """(doc_id, good) of the documents labelled as good."""
    return labels.where("doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("q")).where("q >= 0.5").select("doc_id", F.lit(True).alias("good"))


class Grams:
    """Tokens of a slice: row, whether the first of a row, key of the word and of the pair with the word before."""

    def __init__(self, rows: pa.Table, bits: int):
        words, bounds = word_hashes(Texts(rows.column("text").combine_chunks()), False)
        self.words = np.diff(bounds)
        token = np.insert(words, bounds[1:], END)
        self.row = np.repeat(np.arange(len(self.words)), self.words + 1)
        self.first = np.zeros(len(token), bool)
        self.first[bounds[:-1] + np.arange(len(self.words))] = True
        before = np.append(START, token[:-1])
        before[self.first] = START
        # even keys are words, odd ones pairs; the pair of two start marks counts the texts
        self.word = self._key(mix64(token), bits) & ~np.uint64(1)
        self.pair = self._key(mix64(mix64(before) + token), bits) | np.uint64(1)
        self.text = self._key(mix64(mix64(np.array([START])) + START), bits) | np.uint64(1)

    @staticmethod
    def _key(hashes: np.ndarray, bits: int) -> np.ndarray:
        return hashes >> np.uint64(64 - bits)


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, target_loss, background_loss, score (bits per token)."""
    good = good_documents(labels)
    marks = F.broadcast(good) if good.count() <= BROADCAST_ROWS else good
    marked = docs.select(F.col("doc_id").cast("long"), "text").join(marks, "doc_id", "left").select("doc_id", "text", F.coalesce("good", F.lit(False)).alias("good"))
    total = text_bytes(docs)
    bits = key_bits(total, SPARE)

    def keys_of(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        grams, good = Grams(rows, bits), rows.column("good").to_numpy().astype(float)
        keys, where = np.unique(np.concatenate([grams.word, grams.pair, np.repeat(grams.text, len(good))]), return_inverse=True)
        weight = np.concatenate([good[grams.row], good[grams.row], good])
        return keys, np.stack([np.bincount(where, minlength=len(keys)), np.bincount(where, weight, len(keys))])

    def finish(rows: pa.Table, keys: np.ndarray, totals: np.ndarray, whole: np.ndarray) -> pa.Table:
        grams, good = Grams(rows, bits), rows.column("good").to_numpy().astype(bool)
        vocabulary, n_background, n_target = whole.astype(float).tolist()

        def counts(wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Background and target counts of every token's key without the text's own."""
            at = np.searchsorted(keys, wanted)
            _, where, own = np.unique(grams.row * len(keys) + at, return_inverse=True, return_counts=True)
            own = own[where]
            return totals[0, at].astype(float) - own, totals[1, at] - np.where(good[grams.row], own, 0.0)

        words, pairs = counts(grams.word), counts(grams.pair)
        texts = totals[:, np.searchsorted(keys, grams.text)].astype(float).ravel()
        length = (grams.words + 1)[grams.row]
        out = []
        # without a target the background stands for both
        for which, model in enumerate((1 if n_target else 0, 0)):
            own = np.where(good[grams.row], 1.0, 0.0) if model else np.ones(len(length))
            scale = 1.0 if model or not n_target else n_target / n_background
            before = np.append(0.0, words[model][:-1])
            before[grams.first] = (texts[model] - own)[grams.first]
            n = (n_target if model else n_background) - own * length
            single = (scale * words[model] + NU / vocabulary) / (scale * n + NU)
            loss = -np.log2((scale * pairs[model] + MU * single) / (scale * before + MU))
            out.append(np.where(grams.words > 0, np.add.reduceat(loss, np.flatnonzero(grams.first)) / (grams.words + 1), 0.0))
        return pa.table({"doc_id": rows.column("doc_id"), "n_words": pa.array(grams.words.astype(np.int64)), "target_loss": out[0], "background_loss": out[1], "score": out[0] - out[1]})

    return tallied(marked, total, bits, keys_of, finish, "doc_id long, n_words long, target_loss double, background_loss double, score double")
