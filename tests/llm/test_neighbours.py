"""Recall where queries are unlike most rows, and where codes hardly tell the rows of a list apart."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberframe.llm import neighbours

N, WIDTH = 20_000, 64


def _bunches(rng):
    """Tight bunches, with the queries alone in the open between them."""
    x = (rng.normal(size=(50, WIDTH)) * 3)[rng.integers(0, 50, N)] + rng.normal(size=(N, WIDTH)) * 0.05
    asked = np.arange(N) % 100 == 0
    x[asked] = rng.normal(size=(asked.sum(), WIDTH)) * 3
    return x


def _shells(rng):
    """Bunches whose rows lie at distances of six magnitudes from their middle."""
    return (rng.normal(size=(20, WIDTH)) * 10)[rng.integers(0, 20, N)] + rng.normal(size=(N, WIDTH)) * 10.0 ** -rng.integers(0, 6, (N, 1))


@pytest.mark.parametrize("made", [_bunches, _shells])
def test_recall_on_uneven_vectors(spark, tmp_path, made):
    x = made(np.random.default_rng(5))
    pd.DataFrame({"vec_id": np.arange(N), "embedding": list(x)}).to_parquet(tmp_path / "v.parquet")
    got = neighbours.search(spark.read.parquet(str(tmp_path / "v.parquet")), F.col("id") % 100 == 0).toPandas()
    hits = 0
    for q in range(0, N, 100):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(set(np.lexsort((np.arange(N), d))[:10]) & set(got.loc[got["query_id"] == q, "vec_id"]))
    assert hits / (N / 10) >= 0.95
