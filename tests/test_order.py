"""Places, percentiles, pages, names and components against plain Python."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberframe.operators import components, order, register
from emberframe.operators import events as ev


def test_running_counts(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, 1.0, 2.0, 2.0, 7.5]), rng.random() < 0.3) for i in range(500)]
    df = spark.createDataFrame(rows, "i long, v double, counted boolean").repartition(7)
    got = {r.i: r.nth for r in order.running(df, [F.col("v"), F.col("i")]).collect()}
    ranked = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert got == {r[0]: k + 1 for k, r in enumerate(ranked)}
    some = {r.i: r.nth for r in order.running(df, [F.col("v"), F.col("i")], F.col("counted")).collect()}
    assert some == {r[0]: sum(x[2] for x in ranked[: k + 1]) for k, r in enumerate(ranked)}
    assert order.running(df.where("false"), [F.col("i")]).count() == 0


def test_percentiles(spark):
    rng = np.random.default_rng(2)
    a, b = rng.integers(9, size=301).astype(float), rng.random(301)
    rows = [(float(x), None if i % 10 == 0 else float(y)) for i, (x, y) in enumerate(zip(a, b, strict=True))]
    got = {r.column: r for r in order.at_shares(spark.createDataFrame(rows, "a double, b double"), ["a", "b"], {"median": 0.5, "p90": 0.9, "least": 0.0, "most": 1.0}).collect()}
    for name, values in (("a", a), ("b", np.array([y for _, y in rows if y is not None]))):
        want = np.percentile(values, [50, 90, 0, 100])
        assert np.allclose([got[name].median, got[name].p90, got[name].least, got[name].most], want) and got[name].n == len(values)


def test_deep_pages_are_pages(spark):
    rows = [(i, None if i % 7 == 0 else float(i * 37 % 50), "Ab"[i % 2] + "x") for i in range(200)]
    df = spark.createDataFrame(rows, "event long, max_frp double, state string")
    for key, down in (("max_frp", True), ("max_frp", False), ("state", True), ("event", False)):
        shallow, deep = (register.page(df, key, down, limit=30, offset=60, shallow=s).collect() for s in (10_000, 0))
        assert shallow == deep and len(deep) == 30


@pytest.mark.parametrize("local", [1 << 20, 0, 40])
def test_components_in_one_task_or_in_rounds(spark, monkeypatch, local):
    monkeypatch.setattr(components, "LOCAL_EDGES", local)
    rng = random.Random(3)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(1000 + i, 1001 + i) for i in range(50)] + [(5, None), (None, 7)]
    got = {r.vertex: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent: dict[int, int] = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if None not in (a, b) and a != b:
            parent[top(a)] = top(b)
    groups = lambda of: {frozenset(v for v in of if of[v] == r) for r in of.values()}
    assert groups(got) == groups({v: top(v) for v in list(parent)})


def test_names_are_hashed_as_a_stream(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(5), rng.randrange(30) / 10, 100.0 + rng.randrange(30) / 10, "2024-01-01", rng.randrange(2359)) for _ in range(400)]
    df = spark.createDataFrame(rows, "cluster long, latitude double, longitude double, acq_date string, acq_time int").repartition(5)
    keys: dict[int, list[str]] = {}
    for c, lat, lon, day, at in rows:
        keys.setdefault(c, []).append(f"{lat:.5f},{lon:.5f},{day},{at}")
    want = {c: hashlib.sha1("|".join(sorted(k)).encode()).hexdigest() for c, k in keys.items()}
    assert {r.cluster: r.digest for r in ev.key_digests(df, "cluster").collect()} == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # groups go on over batches
    try:
        assert {r.cluster: r.digest for r in ev.key_digests(df, "cluster").collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert ev.key_digests(df.where("false"), "cluster").count() == 0
