"""Periodic runs of words: a suffix automaton whose last occurrences are recoloured by access.

A run is a stretch of words with smallest period q (words q apart are equal) that
is at least ``LEAST`` words and ``TIMES`` periods long and that no neighbouring
word extends with the same period.  Per document, in one task, without a shuffle:

1. Words become numbers, equal for equal words.  A run of period q repeats, word
   by word, what stands q before; so all its k-mers but those of the first period
   were met at most q before, one after the other.  Stretches without such a chain
   of near k-mers hold no run and are left out; the rest are the regions.
2. A region's suffix automaton is built word by word.  Its suffix links form a
   tree in which the path from a prefix to the root holds all suffixes of the prefix.
3. The prefixes are appended in order.  Each accesses its path: the path falls into
   segments whose strings last ended at the same place, and all of it is recoloured
   with the new end.  A segment whose longest string is L words, seen d words ago,
   with d <= L, is a square of period d; one that can lie at the end of a run
   (L >= (TIMES - 1) d, and LEAST in all) is extended both ways, over the whole
   text, to a run.  As in a link-cut tree, accesses change segments O(n log n) times
   in all; since the text is there from the start, the tree is finished before the
   first access, and the segments lie in stacks along its heavy paths.
4. The same stretch found with several periods counts with the least.

Collapsing drops the words of every run but its first period.

Defined cases: null and empty texts have no words and no runs; a null doc_id is a
value like others; rows with the same doc_id or text are handled row by row; an
empty table gives no rows; other columns play no part.  A task holds one text at a
time, with some 40 bytes for each word of a region.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator
from fractions import Fraction
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.llm.common import mix64, slices
from emberframe.llm.words import kept_words

LEAST = 24
TIMES = 3

#: (doc_id, number of words) -> for every place the place of the word to read there, or None for the text as it is.
Reorder = Callable[[int | None, int], np.ndarray | None]
Run = tuple[int, int, int]


class Automaton:
    """Suffix automaton of a list of numbers: ``link`` and ``length`` of the states, ``ends``: the state of each prefix.

    Most states have one way on, which lies in two flat arrays; only the others have a dictionary.
    """

    def __init__(self, words: list[int]):
        self.link, self.length, self.ends = array("i", [-1]), array("i", [0]), array("i")
        self._by, self._to = array("i", [-1]), array("i", [-1])
        self._more: dict[int, dict[int, int]] = {}
        last = 0
        for word in words:
            last = self._append(last, word)
            self.ends.append(last)

    def _new(self, length: int, link: int) -> int:
        self.length.append(length)
        self.link.append(link)
        self._by.append(-1)
        self._to.append(-1)
        return len(self.length) - 1

    def _append(self, last: int, word: int) -> int:
        by, to, more, link, length = self._by, self._to, self._more, self.link, self.length
        new = self._new(length[last] + 1, 0)
        p, q = last, -1
        while p >= 0:
            if by[p] == word:
                q = to[p]
                break
            if by[p] < 0:
                by[p], to[p] = word, new
            else:
                ways = more.get(p)
                if ways is None:
                    more[p] = {word: new}
                elif (q := ways.get(word, -1)) >= 0:
                    break
                else:
                    ways[word] = new
            p = link[p]
        if q < 0:
            return new
        if length[q] == length[p] + 1:
            link[new] = q
            return new
        twin = self._new(length[p] + 1, link[q])
        by[twin], to[twin] = by[q], to[q]
        if q in more:
            more[twin] = dict(more[q])
        while p >= 0:
            if by[p] == word:
                if to[p] != q:
                    break
                to[p] = twin
            elif (ways := more.get(p)) is None or ways.get(word) != q:
                break
            else:
                ways[word] = twin
            p = link[p]
        link[q] = link[new] = twin
        return new


def _heads(link: array, length: array) -> array:
    """The top of the heavy path of every state of the tree of suffix links; no path goes through the root."""
    order = np.argsort(np.frombuffer(length, np.int32), kind="stable").tolist()
    size, heavy, head = array("i", [1]) * len(link), array("i", [-1]) * len(link), array("i", range(len(link)))
    best = array("i", [0]) * len(link)
    for v in reversed(order[1:]):
        up = link[v]
        size[up] += size[v]
        if size[v] > best[up]:
            best[up], heavy[up] = size[v], v
    for v in order[1:]:
        if link[v] > 0 and heavy[link[v]] == v:
            head[v] = head[link[v]]
    return head


def repeats(words: list[int], shared: int) -> Iterator[tuple[int, int, int]]:
    """(place, distance, length): the ``length`` words up to ``place`` also end ``distance`` before, and not between.

    One for every segment of every access whose longest string has ``shared`` words or more.
    """
    built = Automaton(words)
    link, length = built.link, built.length
    head = _heads(link, length)
    paths: dict[int, list[tuple[int, int]]] = {}
    for place, v in enumerate(built.ends):
        while (own := length[v]) >= shared:
            top = head[v]
            # segments of the path, deepest first: (words of the longest string, last end)
            stack, size = paths.setdefault(top, []), 0
            while stack and stack[-1][0] <= own:
                size, end = stack.pop()
                if size >= shared:
                    yield place, place - end, size
            if stack and size < own:
                yield place, place - stack[-1][1], own
            stack.append((own, place))
            v = link[top]


def _matches(a: np.ndarray, b: np.ndarray) -> int:
    """How many first entries of two arrays are equal."""
    done, step = 0, 64
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    while done < n:
        differ = a[done : done + step] != b[done : done + step]
        if differ.any():
            return done + int(differ.argmax())
        done, step = done + len(differ), step * 2
    return n


def _shared(least: int, times: int) -> int:
    """Words, at the least, that a run repeats after its first period."""
    return -(-least * (times - 1) // times)


def regions(ids: np.ndarray, bounds: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int]]]:
    """For every row (its words from ``bounds[r]`` to ``bounds[r + 1]``) the stretches outside which it has no run."""
    shared = _shared(least, times)
    k = max(1, shared // 2)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    n = max(0, len(ids) - k + 1)
    whole = row[:n] == row[len(row) - n :]
    grams = mix64(row[:n].astype(np.uint64))
    for j in range(k):
        grams = mix64(grams + ids[j : j + n].astype(np.uint64)) if j % 4 == 0 else grams * np.uint64(0x9E3779B97F4A7C15) + ids[j : j + n].astype(np.uint64)
    at = np.flatnonzero(whole)
    order = at[np.argsort(grams[at], kind="stable")]
    met = grams[order[1:]] == grams[order[:-1]]
    gap = np.zeros(n, np.int64)
    gap[order[1:][met]] = (order[1:] - order[:-1])[met]
    hot = np.flatnonzero(gap)
    while len(hot):
        new = np.append(True, (np.diff(hot) > 1) | (row[hot[1:]] != row[hot[:-1]]))
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(hot)))
        reach = (size + k - 1) // (times - 1)
        stretch = np.cumsum(new) - 1
        keep = (size[stretch] > shared - k) & (gap[hot] <= reach[stretch])
        if keep.all():
            break
        hot = hot[keep]
    found: list[list[tuple[int, int]]] = [[] for _ in range(len(bounds) - 1)]
    if not len(hot):
        return found
    first = hot[start]
    for r, a, b in zip(row[first].tolist(), (first - reach).tolist(), (first + size - 1 + k).tolist(), strict=True):
        a, b = max(a - int(bounds[r]), 0), b - int(bounds[r])
        if found[r] and a <= found[r][-1][1]:
            found[r][-1] = (min(a, found[r][-1][0]), max(b, found[r][-1][1]))
        else:
            found[r].append((a, b))
    return found


def runs_of(ids: np.ndarray, stretches: list[tuple[int, int]], least: int = LEAST, times: int = TIMES) -> list[Run]:
    """(start, length, period) of every run of a text, by start, then period."""
    periods: dict[tuple[int, int], int] = {}
    reached: dict[int, int] = {}  # by period, the end of the last stretch with it
    for a, b in stretches:
        for place, distance, length in repeats(ids[a:b].tolist(), _shared(least, times)):
            end = a + place
            if length < max(least - distance, (times - 1) * distance) or end <= reached.get(distance, -1):
                continue
            back = _matches(ids[: end + 1][::-1], ids[: end + 1 - distance][::-1])
            start = end + 1 - back - distance
            stop = end + 1 + _matches(ids[end + 1 :], ids[end + 1 - distance :])
            reached[distance] = stop - 1
            periods[start, stop] = min(distance, periods.get((start, stop), distance))
    return sorted((start, stop - start, period) for (start, stop), period in periods.items())


def cycled(doc_id: int | None, n: int) -> np.ndarray | None:
    """The registered query's order of words: a tenth of the documents, by their id, go in cycles from some word on."""
    h = crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    start = g % n
    period = 1 + (n - start) // (3 + g % 8)
    place = np.arange(n)
    return np.where(place < start, place, start + (place - start) % period)


def _read(batches: Iterator[pa.RecordBatch], reorder: Reorder | None, least: int, times: int) -> Iterator[tuple[pa.RecordBatch, list[tuple[bytes, int, np.ndarray | None, list[Run]]]]]:
    """Batches with (text, number of words, order of the words, runs) of every row."""
    for batch in slices(batches):
        texts = [t or b"" for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
        known: dict[bytes, int] = {}
        ids, orders = [], []
        for text, doc in zip(texts, batch.column("doc_id").to_pylist(), strict=True):
            words = text.split()
            own = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))
            orders.append(reorder(doc, len(own)) if reorder else None)
            ids.append(own if orders[-1] is None else own[orders[-1]])
        bounds = np.cumsum([0, *map(len, ids)])
        where = regions(np.concatenate(ids), bounds, least, times)
        yield batch, [(t, len(i), o, runs_of(i, w, least, times) if w else []) for t, i, o, w in zip(texts, ids, orders, where, strict=True)]


def _collapsed(text: bytes, n: int, order: np.ndarray | None, runs: list[Run]) -> bytes:
    """The words without those of a run after its first period, joined by one space."""
    keep = np.ones(n, bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    if order is None:
        return kept_words(text, keep)
    words = text.split()
    return b" ".join([words[i] for i in order[keep].tolist()])


def runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(doc_id, start, length, period): every run of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in _read(batches, None, least, times):
            found = [(nth, *r) for nth, (_, _, _, own) in enumerate(rows) for r in own]
            nth, *columns = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(nth, pa.int64())), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "start", "length", "period"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, start long, length long, period long")


def collapsed(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``docs`` with runs cut to their first period in the text, its words joined by one space; a null text stays null."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in _read(batches, None, least, times):
            none = batch.column("text").is_null().to_pylist()
            texts = pa.array([None if gone else _collapsed(*row).decode() for row, gone in zip(rows, none, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([texts if c == "text" else batch.column(c) for c in names], names)

    return docs.mapInArrow(run, docs.schema)


DIGEST = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def digest(docs: DataFrame, reorder: Reorder | None = None, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Per document: number of runs; start, length, period and exponent of the one with most periods; SHA-256 of all runs and of the collapsed text.

    ``reorder`` gives the order in which a document's words are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in _read(batches, reorder, least, times):
            out = []
            for row in rows:
                own = row[-1]
                start, length, period = min(own, key=lambda r: (Fraction(-r[1], r[2]), r[0], r[2]), default=(None, None, None))
                listed = "".join(f"{a},{b},{c}\n" for a, b, c in own).encode()
                out.append((len(own), start, length, period, 1000 * length // period if own else None, hashlib.sha256(listed).hexdigest(), hashlib.sha256(_collapsed(*row)).hexdigest()))
            columns = [pa.array(c, pa.int64() if i < 5 else pa.string()) for i, c in enumerate(zip(*out, strict=True))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], [c.split()[0] for c in DIGEST.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, DIGEST)
