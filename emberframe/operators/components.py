"""Connected components of an edge table by repeated contraction.

Each round every vertex points to its smallest neighbour (or itself) under a
per-round order, and the edges are replaced by the edges between the pointed-to
vertices.  Every edge's image is kept, so no component falls apart; loops and
repeats go, so the table shrinks by a constant share per round for any shape of
graph, long chains included.  The round's pointers are kept and composed at the
end, last round first.

Once no more than ``LOCAL_EDGES`` edges are left, one task settles them; larger tables
are contracted until they are as small.  The edges are written to the checkpoint folder once a round; pointers follow from
them by one aggregation.  Each join then reads plain shuffles, which adaptive
execution can split where one vertex has very many edges, and a lost executor
costs one round at most.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.functions.ids import round_mask


#: Edges (16 bytes each) that one task may hold.
LOCAL_EDGES = 1 << 20
#: Rounds whose pointers are composed in one query.
COMPOSED = 4


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset a temporary folder, if driver and executors are one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    return folder.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def _tidy(edges: DataFrame, a: str, b: str) -> DataFrame:
    return edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _pointers(edges: DataFrame, nth: int) -> DataFrame:
    """(v, to): the smallest of every vertex and its neighbours, under the round's order."""
    mask = F.lit(round_mask(nth))
    both = F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w"))))
    nearest = edges.select(both.alias("e")).groupBy("e.v").agg(F.min(F.col("e.w").bitwiseXOR(mask)).alias("w"))
    return nearest.select("v", F.least("w", F.col("v").bitwiseXOR(mask)).bitwiseXOR(mask).alias("to"))


def least_vertices(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertices, the least vertex that each is connected to) of edges."""
    vertices, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = ends[: len(a)], ends[len(a) :]
    to = np.arange(len(vertices))
    while True:
        least = np.minimum(to[left], to[right])
        before = to.copy()
        for v in (left, right, before[left], before[right]):
            np.minimum.at(to, v, least)
        while (to[to] != to).any():
            to = to[to]
        if (to == before).all():
            return vertices, vertices[to]


def _settled(edges: DataFrame) -> DataFrame:
    """(v, to) of a table of few edges, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            v, to = least_vertices(*(np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("a", "b")))
            yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(to)], ["v", "to"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "v long, to long")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, root) for every vertex of an edge between two different vertices; ids are 64-bit integers.

    Vertices with the same root are connected.  The root is some vertex of the
    component; aggregate over it for a particular label, such as the least id.
    Edges with a null end and loops are ignored; an empty table gives no rows.
    """
    left = materialise(_tidy(edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")), "a", "b"))
    rounds: list[DataFrame] = []
    while left.count() > LOCAL_EDGES:
        to = _pointers(left, len(rounds))
        rounds.append(to)
        moved = left.join(to.select(F.col("v").alias("a"), F.col("to").alias("p")), "a").join(to.select(F.col("v").alias("b"), F.col("to").alias("q")), "b")
        left = materialise(_tidy(moved, "p", "q"))
    rounds.append(_settled(left))
    roots = rounds.pop()
    while rounds:
        onward = roots.select(F.col("v").alias("to"), F.col("to").alias("root"))
        roots = rounds.pop().join(onward, "to", "left").select("v", F.coalesce("root", "to").alias("to"))
        if len(rounds) % COMPOSED == 0:
            roots = materialise(roots)
    return roots.select(F.col("v").alias("vertex"), F.col("to").alias("root"))
