"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.operators.components import materialise

#: Java and RE2 pattern of a word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder; Python workers are told where this package lies, whatever folder the driver runs in."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, (env.get("PYTHONPATH"), root)))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Materialise in the shared checkpoint folder and cut the lineage.
cut = materialise


def in_fold(column: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of a column's text leaves ``remainder``; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def text_key(column: str = "text") -> Column:
    """64-bit hash of a text that tells rows with the same doc_id apart (null is a value of its own)."""
    return F.xxhash64(F.col(column), F.col(column).isNull())


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as make it none of ``df``'s columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """As many names, all different, that are none of ``df``'s columns."""
    longest = max([0, *(len(c) - len(c.lstrip("_")) for c in df.columns)])
    return [f"{'_' * (longest + 1)}{n}" for n in names]


def hash_sample(rows: DataFrame, key: str, size: int) -> tuple[int, DataFrame]:
    """(number of rows, the ``size`` rows with the least hash of ``key``); the same rows at every run.

    A filter on the hash keeps what is ranked near ``size`` rows, however many there are.
    """
    n = rows.select(key).count()
    share = min(1.0, (1.2 * size + 1000) / max(n, 1))
    near = rows if share == 1.0 else rows.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(share * (1 << 30)))
    return n, near.orderBy(F.pmod(F.xxhash64(key), F.lit(1 << 30)), key).limit(size)


def sampled_rows(rows: DataFrame, keep: list[str], size: int) -> DataFrame:
    """(doc_id, text, *keep) of at most ``size`` ids, one row each: that of the least text hash, however often the id occurs.

    ``size`` must be small enough for as many ids to be broadcast.
    """
    _, chosen = hash_sample(rows.select("doc_id"), "doc_id", size)
    met = rows.select("doc_id", "text", *keep).join(F.broadcast(chosen.distinct()), "doc_id")
    best = F.min_by(F.struct("text", *keep), F.struct(text_key(), *keep)).alias("r")
    return met.groupBy("doc_id").agg(best).select("doc_id", "r.*")


class Texts:
    """A run of rows of an Arrow string column as one byte array with offsets; null reads as empty."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary())
        if column.null_count:
            column = column.fill_null(b"")
        self.n = len(column)
        offsets = np.frombuffer(column.buffers()[1], np.int64, self.n + 1, column.offset * 8)
        data = column.buffers()[2]
        whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.bytes = whole[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        self.lengths = np.diff(self.offsets)

    def rows(self) -> np.ndarray:
        """The row of every byte."""
        return np.repeat(np.arange(self.n), self.lengths)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Cut record batches into runs of rows with about ``limit`` bytes of text, so that work arrays stay small.

    A single longer text comes as a run of its own.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        ends = np.cumsum(Texts(batch.column(at)).lengths)
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective avalanche of unsigned 64-bit values (public splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
