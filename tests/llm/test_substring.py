"""Substring dedup against brute force, its SQL and on odd rows."""

from __future__ import annotations

import hashlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from emberframe.llm import substring

DOCS = "doc_id long, text string, spans string, text_key int, of_id long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], DOCS).repartition(3)


def brute(rows, window):
    """{(doc_id, text): (words, removed, digest)} by a dictionary of windows."""
    firsts, split = {}, {(i, t): (t or "").encode().split() for i, t in rows}
    order = sorted(split, key=lambda k: (k[0] is None, k[0] or 0))
    for key in order:
        for a in range(len(split[key]) - window + 1):
            firsts.setdefault(tuple(split[key][a : a + window]), (key, a))
    out = {}
    for key in order:
        w, gone = split[key], set()
        for a in range(len(w) - window + 1):
            if firsts[tuple(w[a : a + window])] != (key, a):
                gone |= set(range(a, a + window))
        out[key] = (len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())
    return out


def check(spark, rows, window=substring.WINDOW, seed=substring.SEED):
    table = docs(spark, rows)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in substring.digest(table, window, seed).collect())
    want = brute(rows, window)
    assert got == sorted((i is None, i or 0, *want[i, t]) for i, t in rows)
    texts = substring.deduplicated(table, window, seed)
    assert texts.columns == table.columns
    kept = sorted((r.doc_id is None, r.doc_id or 0, r.text is None, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in texts.collect())
    assert kept == sorted((i is None, i or 0, t is None, want[i, t][2]) for i, t in rows)
    assert {(r.spans, r.text_key, r.of_id) for r in texts.collect()} <= {("x", 1, 2)}


def test_passages_copies_and_periods(spark):
    rng = np.random.default_rng(5)
    word = lambda n, of=400: [f"w{x}" for x in rng.integers(of, size=n)]
    passages = [word(60), word(25), word(21), word(19)]
    rows = []
    for i in range(60):
        parts = [word(int(rng.integers(40)))]
        for p in rng.permutation(len(passages))[: rng.integers(4)]:
            parts += [passages[p][: rng.integers(15, 61)], word(int(rng.integers(12)))]
        rows.append((int(rng.permutation(1000)[0]) * 100 + i, "\t ".join(sum(parts, []))))
    whole = word(300)
    rows += [(7_000_000 + i, " ".join(whole)) for i in range(40)]  # copies
    rows += [(8_000_000 + i, " ".join(whole[:i] + ["edited"] + whole[i:])) for i in range(0, 300, 17)]  # near copies
    rows += [(9_000_000, "same " * 500), (9_000_001, "a b c " * 90), (9_000_002, " ".join(whole[:20])), (9_000_003, "a b " * 10)]
    check(spark, rows)


def test_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(60_000))
    text = " ".join(f"y{i}" for i in range(30))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, long), (5, text), (5, text), (6, text + " more"), (None, text), (-3, "z " + text), (8, text.upper()), (9, " ".join(["é"] * 40)), (10, " ".join(["é"] * 40))]
    check(spark, rows)
    # one id on many rows, and one text on many ids
    check(spark, [(1, f"{text} {i}") for i in (5,)] + [(1, text)] * 200 + [(2 + i, text) for i in range(200)])
    assert substring.digest(docs(spark, [])).count() == 0 and substring.deduplicated(docs(spark, [])).count() == 0


def test_one_id_with_different_texts(spark):
    text = " ".join(f"y{i}" for i in range(30))
    got = substring.digest(docs(spark, [(1, text + " a"), (1, text + " b"), (2, text)])).collect()
    assert sorted(r.n_removed for r in got) == [0, 30, 30]


@settings(max_examples=4, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c"]), max_size=40), min_size=1, max_size=6))
def test_small_alphabets(spark, texts):
    check(spark, [(i, " ".join(t)) for i, t in enumerate(texts)], 5, 3)


@pytest.mark.parametrize("window,seed", [(2, 1), (3, 3), (8, 5)])
def test_other_widths(spark, window, seed):
    rng = np.random.default_rng(window)
    check(spark, [(i, " ".join(rng.choice(list("abcd"), 30))) for i in range(12)], window, seed)


def test_sql_agrees(spark):
    folder = "/root/testdata/sf0.001"
    got = substring.digest(spark.read.parquet(f"{folder}/documents.parquet")).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = con.execute(substring.ORACLE).df()
    columns = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert got[columns].sort_values("doc_id").values.tolist() == want[columns].sort_values("doc_id").values.tolist()
    assert want.n_removed.sum() > 0
