"""Run a registered query and its SQL on the same tables and compare all values."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("TESTDATA", "/root/testdata")


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if hasattr(value, "tzinfo"):
        return str(value.replace(tzinfo=None))
    if type(value).__name__ == "Decimal":
        return float(f"{float(value):.9g}")
    return value


def sql_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    cur = con.execute("SET TimeZone='UTC'").execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in cur.fetchall()), key=repr)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted((tuple(plain(v) for v in r) for r in df.select(*names).collect()), key=repr)


def assert_same(df, sql: str, sf_dir: str) -> int:
    want_names, want = sql_rows(sql, sf_dir)
    names, got = spark_rows(df)
    assert names == want_names, (names, want_names)
    odd = [(a, b) for a, b in zip(got, want, strict=False) if a != b][:3]
    assert len(got) == len(want) and not odd, (len(got), len(want), odd)
    return len(got)
