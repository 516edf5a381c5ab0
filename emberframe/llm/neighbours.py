"""Approximate nearest neighbours: inverted file with product-quantised residuals.

1. On a sample of at most ``SAMPLE`` vectors (least hash of the id) numpy learns
   coarse centroids and, on the residuals, one codebook for each of ``PARTS``
   groups of components.  Every vector is indexed: its nearest centroid's list
   and a code of one byte a part.
2. A list is dealt to blocks by its counted size, so that a list of very many
   copies is many blocks.  A query visits the lists nearest to it: as many as
   hold ``COVERAGE`` of the true neighbours of sample vectors within the sample
   (few where vectors cluster, most where they don't), more until they hold
   all of its own k nearest sample vectors (queries may be unlike most rows), and
   until they hold ``ENOUGH`` times k rows.  It goes to each of their blocks.
3. A block's task builds the query's distance tables, adds up the table entries
   of the codes (asymmetric distance) and what the codes leave out of each vector,
   keeps the best ``SHORTLIST`` by (distance, id) and reranks them by exact distance in
   double precision on the original vectors, which the block holds.  Rows that,
   by their own left-out part, may still be nearer than the k-th of these are
   reranked as well.  Its k best go on to a last ranking
   over the query's blocks.  The queries of a list come in chunks of about ``CHUNK``, by
   their counted number, and its blocks go to each of its chunks: no task holds
   all queries of a block, and a list that few queries visit is sent once.

Spark does the assignment, the dealing and the ranking; nothing but the learnt
tables and the list sizes (both bounded by ``LISTS``) passes the driver.

Defined cases: vectors that are null, all zero, or hold null or non-finite
components take no part, as query or candidate; nor do null ids, and vectors of
another length than most of the sample; rows that share an id are candidates of their
own for other queries, ask once, with the least of their vectors, and are all
left out of that answer, since an answer names ids; a query with fewer
candidates than k gets all of them; ties go to the smaller id; an empty table
gives no rows; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberframe.llm.common import hash_sample, mix64

SAMPLE = 20_000
LISTS = 1024
COVERAGE = 0.97
ENOUGH = 20
PARTS = 16
#: Most rows of a block; lists over twice the mean size are split anyway.
BLOCK = 1 << 16
SHORTLIST = 200
#: Standard deviations that the left-out part of a vector may point towards a query (its cosine to a direction has 1 / sqrt(width) of them).
DEVIATIONS = 2.0
#: Most numbers of the sample vectors that queries are compared with.
KNOWN = 1 << 22
#: Queries that a block's task holds, about.
CHUNK = 4096
#: Queries whose distances to a block are held at once.
STEP = 32


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, centres, 1)[:, 0]
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    """The k nearest centres of each row, nearest first."""
    out = np.empty((len(x), min(k, len(centres))), np.int64)
    for lo in range(0, len(x), 1024):
        d = (centres**2).sum(1) - 2 * x[lo : lo + 1024] @ centres.T
        out[lo : lo + 1024] = d.argmin(1)[:, None] if k == 1 else np.argsort(d, axis=1, kind="stable")[:, : out.shape[1]]
    return out


class Index:
    """Coarse centroids and residual codebooks."""

    def __init__(self, x: np.ndarray, lists: int, parts: int = PARTS, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.centres = _kmeans(x, lists, 8, rng)
        rest = x - self.centres[nearest(x, self.centres, 1)[:, 0]]
        self.cuts = np.linspace(0, x.shape[1], min(parts, x.shape[1]) + 1).astype(int)
        self.books = [_kmeans(rest[:, a:b], 256, 6, rng) for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]
        self.probes = self._probes(x, rng)
        self.known = x[: max(1, KNOWN // x.shape[1])]
        self.known_own = nearest(self.known, self.centres, 1)[:, 0]

    def _probes(self, x: np.ndarray, rng: np.random.Generator, k: int = 10, asked: int = 256) -> int:
        """Lists to visit so that they hold COVERAGE of the k nearest sample vectors of some sample vectors."""
        own = nearest(x, self.centres, 1)[:, 0]
        chosen = rng.choice(len(x), min(asked, len(x)), replace=False)
        place = np.empty((len(chosen), len(self.centres)), np.int64)
        np.put_along_axis(place, nearest(x[chosen], self.centres, len(self.centres)), np.arange(len(self.centres))[None], axis=1)
        d = (x**2).sum(1) - 2 * x[chosen] @ x.T
        d[np.arange(len(chosen)), chosen] = np.inf
        true = np.argsort(d, axis=1)[:, : min(k, len(x) - 1)]
        if not true.size:
            return 1
        return int(np.quantile(np.take_along_axis(place, own[true], axis=1), COVERAGE, method="higher")) + 1

    def reach(self, x: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
        """How many lists of ``order`` (nearest first) hold the k nearest sample vectors of each row, itself not counted."""
        out = np.ones(len(x), np.int64)
        near = min(k + 1, len(self.known))
        for lo in range(0, len(x), 256):
            d = (self.known**2).sum(1) - 2 * x[lo : lo + 256] @ self.known.T
            held = self.known_own[np.argpartition(d, near - 1, axis=1)[:, :near]]
            place = np.empty((len(d), len(self.centres)), np.int64)
            np.put_along_axis(place, order[lo : lo + 256], np.arange(len(self.centres))[None], axis=1)
            out[lo : lo + 256] = np.take_along_axis(place, held, axis=1).max(1) + 1
        return out

    def encode(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, squared length of what they leave out) of each row."""
        rest, codes, missed = x - self.centres[own], [], np.zeros(len(x))
        for a, b, book in zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True):
            code = nearest(rest[:, a:b], book, 1)[:, 0]
            missed += ((rest[:, a:b] - book[code]) ** 2).sum(1)
            codes.append(code)
        return np.stack(codes, axis=1).astype(np.uint8), missed

    def tables(self, query: np.ndarray, own: int) -> np.ndarray:
        """Squared distance of the query's residual to every codeword, by part."""
        rest = query - self.centres[own]
        out = np.full((len(self.books), 256), np.inf)
        for p, (a, b, book) in enumerate(zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True)):
            out[p, : len(book)] = ((book - rest[a:b]) ** 2).sum(1)
        return out


def usable(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """(id, v): the rows that take part."""
    v = F.col(column).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite)


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", column: str = "embedding", lists: int | None = None, probes: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row under ``is_query`` (over ``id``) its k nearest other rows found."""
    rows = usable(vectors, id_column, column)
    empty = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n, sample = hash_sample(rows, "id", SAMPLE)
    sample = sample.toPandas()
    if not len(sample):
        return empty
    width = int(sample["v"].map(len).mode()[0])
    x = np.stack([v for v in sample["v"] if len(v) == width])
    rows = rows.where(F.size("v") == width)
    index = Index(x, min(lists or int(np.clip(n**0.5 / 4, 1, LISTS)), len(x)))
    lists, probes, given = len(index.centres), probes or index.probes, bool(probes)
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            v = batch.column("v").flatten().to_numpy().reshape(-1, width)
            if len(v):
                own = nearest(v, index.centres, 1)[:, 0]
                codes, missed = index.encode(v, own)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(own, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(missed)], ["id", "v", "list", "code", "missed"])

    indexed = rows.mapInArrow(assign, "id long, v array<double>, list int, code binary, missed double")
    sizes = np.zeros(lists, np.int64)
    for row in indexed.groupBy("list").count().collect():  # one number for each list
        sizes[row["list"]] = row["count"]
    blocks = np.maximum(1, -(-sizes // int(np.clip(2 * sizes.mean(), 256, BLOCK))))

    def lists_of(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of the lists that each query visits: up to the one that makes the rows enough, ``probes`` and those of its nearest sample vectors at least."""
        order = nearest(v, shared.value.centres, lists)
        held = np.cumsum(sizes[order], axis=1)
        n = np.maximum(np.minimum((held < ENOUGH * k + 1).sum(1) + 1, lists), min(probes, lists))
        n = n if given else np.maximum(n, shared.value.reach(v, order, k))
        row, own = np.repeat(np.arange(len(n)), n), order[np.arange(lists) < n[:, None]]
        return row[sizes[own] > 0], own[sizes[own] > 0]

    def visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v").flatten().to_numpy().reshape(-1, width)
            if len(v):
                own, n = np.unique(lists_of(v)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(n, pa.int64())], ["list", "n"])

    asked = rows.where(is_query).groupBy("id").agg(F.min("v").alias("v"))
    chunks = np.ones(lists, np.int64)
    for row in asked.mapInArrow(visited, "list int, n long").groupBy("list").agg(F.sum("n").alias("n")).collect():  # one number for each list
        chunks[row["list"]] = -(-row["n"] // CHUNK)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v").flatten().to_numpy().reshape(-1, width)
            if not len(v):
                continue
            row, own = lists_of(v)
            each = blocks[own]
            take = np.repeat(np.arange(len(own)), each)
            block = np.arange(len(take)) - np.repeat(np.cumsum(each) - each, each)
            at, lists_ = pa.array(row[take]), own[take]
            chunk = (mix64(batch.column("id").to_numpy())[row[take]] % chunks[lists_].astype(np.uint64)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("v").take(at), pa.array(lists_, pa.int32()), pa.array(block, pa.int32()), pa.array(chunk)], ["query_id", "q", "list", "block", "chunk"])

    def scan(key: tuple, held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(held) and len(asked):
            index, own = shared.value, int(key[0])
            ids = held["id"].to_numpy()
            by_id = np.argsort(ids, kind="stable")
            ids = ids[by_id]
            v = np.stack(held["v"].to_numpy())[by_id]
            codes = np.frombuffer(b"".join(held["code"].to_numpy()[by_id]), np.uint8).reshape(len(ids), -1)
            missed = held["missed"].to_numpy()[by_id]
            queries, names = np.stack(asked["q"].to_numpy()), asked["query_id"].to_numpy()
            short = min(max(SHORTLIST, k), len(ids))
            share = 2 * min(1.0, DEVIATIONS / width**0.5)
            for lo in range(0, len(names), STEP):
                tables = np.stack([index.tables(q, own) for q in queries[lo : lo + STEP]])
                rough = np.zeros((len(tables), len(ids)))
                for p in range(codes.shape[1]):
                    rough += tables[:, p, codes[:, p]]
                least = rough + missed - share * np.sqrt(rough * missed)
                rough += missed
                itself = names[lo : lo + STEP, None] == ids
                rough[itself], least[itself] = np.inf, np.inf
                bound = np.partition(rough, short - 1, axis=1)[:, short - 1 : short]
                for name, q, d, b, low in zip(names[lo : lo + STEP].tolist(), queries[lo : lo + STEP], rough, bound, least, strict=True):
                    best = np.flatnonzero(d < b)
                    best = np.append(best, np.flatnonzero((d == b) & (d < np.inf))[: short - len(best)])  # ties to the smaller id
                    exact = ((v[best] - q) ** 2).sum(1)
                    if len(best) < len(ids) and len(best):
                        low[best] = np.inf
                        more = np.flatnonzero(low <= np.partition(exact, min(k, len(best)) - 1)[min(k, len(best)) - 1] * (1 + 1e-9))
                        best, exact = np.append(best, more), np.append(exact, ((v[more] - q) ** 2).sum(1))
                    exact = np.sqrt(exact)
                    order = np.lexsort((ids[best], exact))[:k]
                    out.extend(zip([name] * len(order), ids[best[order]].tolist(), exact[order].tolist(), strict=True))
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    def of_list(numbers: np.ndarray) -> Column:
        """A list's number, 1 for most."""
        more = {int(own): int(n) for own, n in enumerate(numbers) if n > 1}
        return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in more.items() for x in pair)), F.col("list")), F.lit(1)) if more else F.lit(1)

    dealt = indexed.withColumn("block", F.pmod(F.xxhash64("id"), of_list(blocks)).cast("int"))
    queries = asked.mapInArrow(visit, "query_id long, q array<double>, list int, block int, chunk int")
    dealt = dealt.withColumn("chunk", F.explode(F.sequence(F.lit(0), of_list(chunks) - 1)))
    found = dealt.groupBy("list", "block", "chunk").cogroup(queries.groupBy("list", "block", "chunk")).applyInPandas(scan, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
