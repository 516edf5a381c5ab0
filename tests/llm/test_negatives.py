"""Hard negatives against brute force, the SQL and on odd rows."""

from __future__ import annotations

from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from emberframe.llm import catalog, negatives

ROWS = "vec_id long, embedding array<double>, label int, uid string, part int, block int, v string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, l, "x", 1, 2, "y") for i, v, l in rows], ROWS).repartition(3)


def mined(spark, rows, every=5, **options):
    found = negatives.hard_negatives(negatives.quantised(table(spark, rows)), F.col("id") % every == 0, **options)
    return Counter((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in found.collect())


def brute(rows, every=5, n_positives=5, n=3, low=50, high=95):
    rows = [(i, [int(np.floor(256 * x)) for x in v], l) for i, v, l in rows if None not in (i, v, l) and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, v, label) in enumerate(rows):
        if i % every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w, strict=True)), j, m) for b, (j, w, m) in enumerate(rows) if b != a]
        for s, j, _ in sorted(x for x in scored if x[2] == label)[:n_positives]:
            fit = sorted(x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s)[:n]
            out += [(i, j, k + 1, m, -s, -t) for k, (t, m, _) in enumerate(fit)]
    return Counter(out)


@pytest.fixture(params=[(4096, (4096, 1 << 16)), (4, (10, 20))])
def sizes(request, monkeypatch):
    """As in production, and with many groups, hubs and blocks."""
    monkeypatch.setattr(negatives, "GROUP", request.param[0])
    monkeypatch.setattr(negatives, "BLOCK", request.param[1])


def test_clusters_and_copies(spark, sizes):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8))
    rows = [(int(i), (centres[rng.integers(6)] + rng.normal(size=8) * 0.15).tolist(), int(rng.integers(4))) for i in rng.permutation(180)]
    rows += [(1000 + i, rows[0][1], int(i % 3)) for i in range(40)]  # one vector, many ids
    got = mined(spark, rows)
    assert got == brute(rows) and len(got) > 100


def test_bounds_rule_out(monkeypatch):
    rng = np.random.default_rng(3)
    v = np.floor(256 * (rng.normal(size=(2000, 8)) * 0.05 + rng.normal(size=(20, 8))[rng.integers(20, size=2000)])).astype(np.int64)
    anchors = v[:64]
    search = negatives.Search(v, anchors, *negatives._tree(anchors))
    span = (anchors.astype(float) ** 2).sum(1)
    seen = 0
    for k, at, s in search.walk(lambda k: (0.8 * span[k], 0.9 * span[k], 0.0)):
        true = v @ anchors[k]
        assert (true[at] == s).all()
        assert set(np.flatnonzero((true >= 0.8 * span[k]) & (true <= 0.9 * span[k]))) <= set(at.tolist())
        seen += len(at)
    assert seen < 0.5 * len(v) * len(anchors)


def test_odd_rows(spark, sizes):
    nan, inf = float("nan"), float("inf")
    rows = [(5, [1.0, 0.5], 1), (10, [1.0, 0.5], 1), (1, [0.9, 0.5], 1), (2, [0.6, 0.5], 2), (3, [0.5, 0.5], 2), (4, None, 1), (15, [nan, 1.0], 1), (20, [inf, 1.0], 1), (25, [None, 1.0], 1), (30, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (6, [-1.0, -0.5], 1), (35, [-0.001, 0.0], 3), (40, [0.0, 0.0], 3), (45, [0.0, 0.0], 3)]
    assert mined(spark, rows) == brute(rows)
    # another length than most takes no part; repeated rows are rows of their own
    assert mined(spark, [*rows, (50, [1.0, 0.5, 3.0], 1), (51, [], 2)]) == brute(rows)
    twice = rows[:5] + rows[:4]
    assert mined(spark, twice) == brute(twice)
    assert not mined(spark, []) and not mined(spark, [(5, [1.0], 1)]) and not mined(spark, [(4, [1.0], 1), (3, [0.7], 2)])


def test_exact_beyond_doubles(spark):
    rows = [(i, [float(2**22 + i), float(2**21 - 7 * i)], i % 2) for i in range(12)]
    got = mined(spark, rows, high=100)
    assert got and got == brute(rows, high=100)
    # components far beyond a long's range don't fail
    mined(spark, [(0, [1e300, 1.0], 1), (1, [1e300, 2.0], 1), (2, [1e299, 1.0], 2)])


def test_sql_agrees(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    want = con.execute(negatives.ORACLE).df()
    got = catalog.op11_hard_negatives(spark, folder).toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want.values.tolist())) and len(want) > 0
