"""Substring dedup: repeated runs of words as compacted paths of a de Bruijn graph.

A window is ``WINDOW`` consecutive words of a document.  A word goes if a window
covers it that starts earlier as well: in a smaller doc_id, or in the same document.

1. Every window picks its seed, the k-mer of ``SEED`` words with the least hash
   (the first of equals).  The seeds of a document are the edges of its path
   through the graph; equal windows have equal seeds at equal places, so windows
   meet where seeds meet, and a seed stands for up to nine windows.
2. Spark counts, over the corpus, each seed and each seed with its surroundings:
   the words that settle which windows pick it and which seed comes next.  Counts
   are gathered and joined back packed (``tally``).  A seed found once tells that
   its windows are found once.
3. A repeated seed whose surroundings are always the same does not branch.
   Neighbours of that kind with equal counts always come together, so they are
   compacted: a maximal nonbranching path becomes one entry, whatever its length.
   At a seed that branches each of its windows is an entry.
4. The entries, known by hashes of all their words, are gathered with their source
   coordinates (doc_id, place), and each is told whether its own is the first;
   entries that start elsewhere go.  Every occurrence of a path holds the whole
   path, so its first coordinate is that of each of its windows.

Both exchanges cost a key that is found everywhere one entry for each slice of
texts, so no key is hot.  Words and entries are known by 64-bit hashes.

Defined cases: null and empty texts have no words; texts under ``WINDOW`` words
lose nothing; a null doc_id comes after all others; rows with the same doc_id but
different texts are documents of their own, in the order of a hash of the text;
rows with the same doc_id and text are one document, and each of them gets its
answer; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.llm.common import Texts, mix64, text_key
from emberframe.llm.tally import firsts, key_bits, tallied, text_bytes
from emberframe.llm.words import count_words, kept_words, word_hashes

WINDOW = 20
SEED = 12
#: Odd multiplier of the rolling hashes.
STEP = np.uint64(0xD6E8FEB86659FD93)
#: Stands for what is before a text's first and after its last word.
OUTSIDE = np.uint64(0x2545F4914F6CDD1D)
#: Bits of a key beyond those that number the corpus' bytes; where two keys coincide, a branch may go unseen.
SPARE = 26
#: Sign bit, so that longs compare as unsigned numbers.
SIGN = np.uint64(1 << 63)

def _rolling(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words from each place on, built from runs of doubled length."""
    total, done = None, 0
    run, size = words, 1
    while True:
        if width & size:
            total = run if total is None else total[: len(run) - done] * STEP**np.uint64(size) + run[done:]
            done += size
        if done == width:
            return mix64(total[: max(0, len(words) - width + 1)])
        run = run[:-size] * STEP**np.uint64(size) + run[size:] if len(run) > size else run[:0]
        size *= 2


class Seeds:
    """The seeds of a run of texts: ``at`` (place of the word), ``first`` and ``last`` window, ``row``, and two keys."""

    def __init__(self, texts: Texts, window: int, seed: int):
        self.words, self.bounds = word_hashes(texts, False)
        n_kmers = window - seed + 1
        counts = np.maximum(np.diff(self.bounds) - window + 1, 0)
        row = np.repeat(np.arange(len(counts)), counts)
        starts = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + self.bounds[:-1][row]
        kmers = _rolling(self.words, seed)
        least, at = kmers[starts], starts.copy()
        for k in range(1, n_kmers):
            other = kmers[starts + k]
            less = other < least
            least[less], at[less] = other[less], starts[less] + k
        new = np.append(True, at[1:] != at[:-1])[: len(at)]
        self.row, self.at, self.first = row[new], at[new], starts[new]
        self.last = self.first + np.diff(np.append(np.flatnonzero(new), len(at))) - 1
        begin, end = self.bounds[:-1][self.row], self.bounds[1:][self.row]
        around = np.zeros(len(self.at), np.uint64)
        for k in range(1 - n_kmers, window + 1):
            place = self.at + k
            inside = (place >= begin) & (place < end)
            around = around * STEP + np.where(inside, self.words[np.where(inside, place, 0)] if len(self.words) else OUTSIDE, OUTSIDE)
        self.around = mix64(around)
        self.seed = least[new]

    def keys(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the seeds and of the seeds with their surroundings; the two low bits tell them apart."""
        shift = np.uint64(64 - bits)
        return (self.seed >> shift) & ~np.uint64(3), (self.around >> shift) & ~np.uint64(3) | np.uint64(1)

    def entries(self, count: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, first, last window) of the nonbranching paths and of the windows at branching seeds, by row."""
        repeated, free = count > 1, count == around
        # a path goes on where two seeds of a text don't branch and are found equally often
        joined = np.append(False, (self.row[1:] == self.row[:-1]) & free[1:] & free[:-1] & (count[1:] == count[:-1]))[: len(count)]
        head = np.flatnonzero(~joined & free & repeated)
        tail = np.flatnonzero(~np.append(joined[1:], False)[: len(count)] & free & repeated)
        branch = np.flatnonzero(~free & repeated)
        each = (self.last - self.first + 1)[branch]
        single = np.repeat(self.first[branch], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        row = np.concatenate([self.row[head], np.repeat(self.row[branch], each)])
        by_row = np.argsort(row, kind="stable")
        begin = self.bounds[:-1][row[by_row]]
        return row[by_row], np.concatenate([self.first[head], single])[by_row] - begin, np.concatenate([self.last[tail], single])[by_row] - begin


def _id_keys(ids: pa.ChunkedArray, bits: int) -> np.ndarray:
    known = mix64(ids.fill_null(0).to_numpy().view(np.uint64) + ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint64) * STEP)
    return (known >> np.uint64(64 - bits)) & ~np.uint64(3) | np.uint64(2)


def _texts(rows: pa.Table) -> Texts:
    return Texts(rows.column("text").combine_chunks())


def with_entries(rows: DataFrame, total: int, window: int, seed: int) -> DataFrame:
    """``rows`` (text, id, text_key and others), with their slice, what tells rows of one id apart, and the first and last windows of their entries."""
    bits = key_bits(total, SPARE)
    names = rows.columns

    def keys_of(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        own = _id_keys(rows.column("id"), bits)
        keys, counts = np.unique(np.concatenate([own, *Seeds(_texts(rows), window, seed).keys(bits)]), return_counts=True)
        return keys, counts[None]

    def finish(rows: pa.Table, keys: np.ndarray, totals: np.ndarray, _: np.ndarray) -> pa.Table:
        count = lambda wanted: totals[0, np.searchsorted(keys, wanted)]
        seeds = Seeds(_texts(rows), window, seed)
        row, first, last = seeds.entries(*map(count, seeds.keys(bits)))
        ends = pa.array(np.searchsorted(row, np.arange(rows.num_rows + 1)).astype(np.int32))
        apart = np.where(count(_id_keys(rows.column("id"), bits)) > 1, rows.column("text_key").to_numpy(), 0)
        spans = {c: pa.ListArray.from_arrays(ends, pa.array(v.astype(np.int32))) for c, v in (("first", first), ("last", last))}
        return pa.table({n: rows.column(n) for n in names} | {"slice": rows.column("slice"), "apart": pa.array(apart)} | spans)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return tallied(rows, total, bits, keys_of, finish, f"{kinds}, slice long, apart long, first array<int>, last array<int>")


class Entries:
    """Entries of a slice: their row, windows, key, and the coordinate that they start at as three unsigned numbers."""

    def __init__(self, rows: pa.Table, window: int):
        texts = _texts(rows)
        words, bounds = word_hashes(texts, False)
        first, last = (rows.column(c).combine_chunks() for c in ("first", "last"))
        self.row = np.repeat(np.arange(rows.num_rows), np.diff(first.offsets.to_numpy()))
        self.first, self.last = first.flatten().to_numpy(), last.flatten().to_numpy()
        begin = bounds[:-1][self.row]
        raw = memoryview(words.tobytes())
        spans = zip((8 * (begin + self.first)).tolist(), (8 * (begin + self.last + window)).tolist(), strict=True)
        self.key = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in spans), np.uint64, len(self.row))
        ids = rows.column("id").fill_null(0).to_numpy().view(np.uint64) ^ SIGN
        ids = np.where(rows.column("id").is_null().to_numpy(zero_copy_only=False), ~np.uint64(0), ids)
        self.at = np.stack([ids[self.row], (rows.column("apart").to_numpy().view(np.uint64) ^ SIGN)[self.row], self.first.astype(np.uint64)])

    def least(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(keys, each entry's place in them, the least coordinate of each key)."""
        order = np.lexsort((*self.at[::-1], self.key))
        keys, start, where = np.unique(self.key[order], return_index=True, return_inverse=True)
        place = np.empty(len(order), np.int64)
        place[order] = where
        return keys, place, self.at[:, order[start]]


def _dedup(rows: DataFrame, window: int, seed: int, result: Callable, schema: str) -> DataFrame:
    """``result(rows, [(words, words that go, kept words joined by one space)])`` of the slices of ``rows``."""
    total = text_bytes(rows)

    def keys_of(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        keys, _, least = Entries(rows, window).least()
        return keys, least

    def finish(rows: pa.Table, _: np.ndarray, told: np.ndarray, __: np.ndarray) -> pa.Table:
        entries = Entries(rows, window)
        keys, place, least = entries.least()
        again = (entries.at != least[:, place]).any(0) | (told[0, place] == 0 if len(keys) else False)
        row, spans = entries.row[again], np.stack([entries.first, entries.last], 1)[again]
        ends = np.searchsorted(row, np.arange(rows.num_rows + 1))
        texts = rows.column("text").cast(pa.large_binary()).to_pylist()
        return result(rows, [_kept(t or b"", spans[a:b], window) for t, a, b in zip(texts, ends[:-1], ends[1:], strict=True)])

    return tallied(with_entries(rows, total, window, seed), total, 64, keys_of, finish, schema, firsts)


def _kept(text: bytes, spans: np.ndarray, window: int) -> tuple[int, int, bytes]:
    """(words, words that go, kept words joined by one space) of a text whose runs of windows ``spans`` go."""
    n = count_words(text)
    edges = np.zeros(n + 1, np.int32)
    np.add.at(edges, spans[:, 0], 1)
    np.add.at(edges, spans[:, 1] + window, -1)
    keep = np.cumsum(edges[:-1]) == 0
    return n, int(n - keep.sum()), kept_words(text, keep)


def deduplicated(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """``docs`` with the kept words, joined by one space, as text; a null text stays null."""
    names = docs.columns
    held = {c: f"c{i}" for i, c in enumerate(names) if c != "text"}
    rows = docs.select(docs["text"], docs["doc_id"].cast("long").alias("id"), text_key().alias("text_key"), *(docs[c].alias(h) for c, h in held.items()))

    def result(rows: pa.Table, found: list[tuple[int, int, bytes]]) -> pa.Table:
        none = rows.column("text").is_null().to_pylist()
        texts = pa.array([None if gone else kept.decode() for gone, (_, _, kept) in zip(none, found, strict=True)], pa.string())
        return pa.table([texts if c == "text" else rows.column(held[c]) for c in names], names)

    return _dedup(rows, window, seed, result, docs.schema)


def digest(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space)."""

    def result(rows: pa.Table, found: list[tuple[int, int, bytes]]) -> pa.Table:
        n, gone, kept = zip(*found, strict=True)
        sha = [hashlib.sha256(k).hexdigest() for k in kept]
        return pa.table({"doc_id": rows.column("id"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})

    rows = docs.select("text", F.col("doc_id").cast("long").alias("id"), text_key().alias("text_key"))
    return _dedup(rows, window, seed, result, "doc_id long, n_words long, n_removed long, kept_sha256 string")


ORACLE = f"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM split)
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS nth FROM windows) WHERE nth > 1
), words AS (
  SELECT doc_id, ws[i] AS word, i FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM split)
), marked AS (
  SELECT w.doc_id, w.i, word, max(l.i) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM words w LEFT JOIN later l ON w.doc_id = l.doc_id AND w.i = l.i
), kept AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS text FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
