"""Periodic runs against brute force and on odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from emberframe.llm import periodic

DOCS = "doc_id long, text string, start int, period string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], DOCS).repartition(3)


def brute(words, least=24, times=3):
    """Every period tried at every place."""
    found = {}
    for q in range(1, len(words) // times + 1):
        i = q
        while i < len(words):
            if words[i] != words[i - q]:
                i += 1
                continue
            s = i - q
            while i < len(words) and words[i] == words[i - q]:
                i += 1
            if i - s >= max(least, times * q):
                found.setdefault((s, i), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def cyclic(rng):
    """Words with nested and overlapping repeats."""
    k = rng.choice([1, 2, 3, 5, 100])
    out = [rng.randrange(k) for _ in range(rng.randrange(80))]
    for _ in range(rng.randrange(4)):
        if out:
            a, p = rng.randrange(len(out)), rng.randrange(1, 20)
            out[a:a] = out[a : a + p] * rng.randrange(1, 8)
            if rng.random() < 0.5:
                out[rng.randrange(len(out))] = rng.randrange(k + 1)
    return out


@pytest.mark.parametrize("least,times", [(24, 3), (6, 2), (1, 2), (10, 4), (2, 3)])
def test_runs_of_small_texts(least, times):
    rng, n = random.Random(least), 0
    for _ in range(200):
        rows = [cyclic(rng) for _ in range(3)]
        ids = np.array(sum(rows, []), np.int32)
        where = periodic.regions(ids, np.cumsum([0, *map(len, rows)]), least, times)
        for row, stretches in zip(rows, where, strict=True):
            want = brute(row, least, times)
            n += len(want)
            assert periodic.runs_of(np.array(row, np.int32), stretches, least, times) == want
    assert n > 300


def test_segments_are_last_occurrences():
    rng = random.Random(3)
    for _ in range(100):
        words = [rng.randrange(2) for _ in range(rng.randrange(1, 30))]
        got = {}
        for place, distance, length in periodic.repeats(words, 1):
            got[place, distance] = max(length, got.get((place, distance), 0))
        want = {}
        for i in range(len(words)):
            for n in range(1, i + 1):
                end = next((j for j in range(i - 1, n - 2, -1) if words[j - n + 1 : j + 1] == words[i - n + 1 : i + 1]), None)
                if end is not None:
                    want[i, i - end] = n
        assert got == want


def expected(doc, text, reorder):
    words = (text or "").encode().split()
    if reorder:
        h = zlib.crc32(str(doc).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    return (
        doc, len(runs), *best, runs and 1000 * best[1] // best[2] or None,
        hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
    )


def test_whole_queries(spark):
    rng = random.Random(8)
    rows = [(i, " \n".join(f"w{x}" for x in cyclic(rng))) for i in range(300)]
    table = docs(spark, rows)
    for reorder in (None, periodic.cycled):
        got = {tuple(r) for r in periodic.digest(table, reorder).collect()}
        assert got == {expected(i, t, reorder) for i, t in rows}
    found = Counter(r.doc_id for r in periodic.runs(table).collect())
    assert found == Counter({i: n for i, t in rows if (n := len(brute(t.split())))})
    texts = periodic.collapsed(table)
    assert texts.columns == table.columns
    assert {(r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in texts.collect()} == {(i, expected(i, t, None)[-1]) for i, t in rows}


def test_odd_rows(spark):
    long = " ".join(f"x{i % 20_011}" for i in range(90_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a " * 30), (4, "a " * 30), (4, "a " * 30), (5, "b\x0bb " * 12 + "b"), (6, "same " * 23), (7, "é à " * 12), (-8, long), (9, "y " * 50_000)]
    got = Counter(tuple(r) for r in periodic.digest(docs(spark, rows)).collect())
    small = [r for r in rows if len(r[1] or "") < 1000]
    assert Counter(expected(i, t, None) for i, t in small) == Counter({r: n for r, n in got.items() if r[0] not in (-8, 9)})
    by_id = {r[0]: r for r in got}
    assert by_id[-8][1:6] == (1, 0, 90_000, 20_011, 4497) and by_id[9][1:6] == (1, 0, 50_000, 1, 50_000_000)
    assert periodic.digest(docs(spark, [])).count() == periodic.runs(docs(spark, [])).count() == periodic.collapsed(docs(spark, [])).count() == 0
    assert {r.text is None for r in periodic.collapsed(docs(spark, [(1, None)])).collect()} == {True}
