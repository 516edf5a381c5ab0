"""Hard-negative mining: exact window searches for many anchors, bounded along spanning trees of the anchors.

Scores are integer inner products.  An anchor's positives are its best rows of the
same label; its negatives are rows of other labels whose score lies in a window
below a positive's.  Both are searches for rows whose score lies in a window.

1. Vectors are quantised; anchors are dealt into groups of at most ``GROUP``
   (positives: by label; negatives: by nearest hub, hubs being a bounded sample of
   the anchors).  A group's least spanning tree by distance is built once, in a task.
2. Candidates are dealt into blocks.  A task holds a group and a block and walks the
   tree from its root.  An anchor's score of a candidate differs from its parent's
   by no more than the edge's length times the candidate's norm, so the parent's
   scores, or bounds, bound the child's; only candidates whose bounds overlap the
   child's window are scored again, exactly.
3. Negatives: the same bounds along a tree of the hubs (the root of each group hangs
   on its hub) tell before the shuffle which groups a candidate may concern at all.
4. The best of each block meet in a last ranking over the anchor's blocks.

Nothing but hubs (``HUBS`` at most, with one window each) and counts by hub passes the driver.  The
anchors are a fixed share of the rows, so where bounds rule nothing out (scattered
vectors) every anchor is scored with every row, block by block.

Defined cases: rows with a null label or vector, a null id, or a null or non-finite
component take no part, nor do vectors of another length than the commonest (the
shorter of equals); quantised components beyond a long's range are cut to it, and so are scores, and
windows hold for exact scores; rows that share an id are rows of their own, as anchors too, and an anchor is
only left out of its own positives; ties go to the smaller id; an anchor with fewer
partners gets all; without any it gives no rows; an empty table gives no rows; other
columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberframe.llm.common import cut, hash_sample

POSITIVES = 5
NEGATIVES = 3
#: A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 50, 95
SCALE = 256

GROUP = 4096
HUBS = 1024
#: Rows of a block, from and to.
BLOCK = (4096, 1 << 16)
#: Blocks that a table makes as long as they are not too small or large.
BLOCKS = 64


RANGE = (-(1 << 63), (1 << 63) - 1)


def quantised(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", label_column: str = "label", relabelled: Column | None = None) -> DataFrame:
    """(id, label, v): rows that take part, components as whole numbers; ``relabelled`` (over id and label) replaces the label."""
    v = F.col(column).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("long").alias("label"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite)
    rows = rows if relabelled is None else rows.withColumn("label", relabelled.cast("long"))
    return rows.withColumn("v", F.transform("v", lambda x: F.floor(x * SCALE)))


def _tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, parent) of a least spanning tree by distance: parents come before children, the first is the root."""
    n, x = len(points), points.astype(float)
    order, parent, far = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, np.inf)
    left, now = np.ones(n, bool), 0
    for k in range(n):
        order[k], left[now] = now, False
        d = np.sqrt(((x - x[now]) ** 2).sum(1))
        near = left & (d < far)
        far[near], parent[near] = d[near], now
        if k < n - 1:
            rest = np.flatnonzero(left)
            now = int(rest[far[rest].argmin()])
    return order, parent


#: (an anchor) -> low and high end of its window, and how far its own followers are off.
Windows = Callable[[int], tuple[float, float, float]]


class Search:
    """Exact scores of a block's candidates at the anchors of a tree, where bounds don't rule them out."""

    def __init__(self, candidates: np.ndarray, anchors: np.ndarray, order: np.ndarray, parent: np.ndarray):
        top = [max(abs(int(m.max())), abs(int(m.min()))) if m.size else 0 for m in (candidates, anchors)]
        most = top[0] * top[1] * max(1, anchors.shape[1])
        # inner products are exact as doubles, longs, or Python's own numbers
        kind = float if most < 1 << 53 else np.int64 if most < 1 << 62 else object
        self.v, self.a = candidates.astype(kind), anchors.astype(kind)
        self.norm = np.sqrt((candidates.astype(float) ** 2).sum(1)) * (1 + 1e-9)
        near = anchors.astype(float)
        self.edge = np.sqrt(((near - near[parent]) ** 2).sum(1))
        self.order, self.parent = order.tolist(), parent.tolist()

    def scores(self, anchor: int, at: np.ndarray | None = None) -> np.ndarray:
        return (self.v if at is None else self.v[at]) @ self.a[anchor]

    def walk(self, windows: Windows) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(anchor, candidates, their scores) for each anchor, over all candidates whose bounds overlap its window.

        Of an anchor's children the one with most offspring comes last, so that
        bounds wait for the logarithm of the tree's size of anchors at most.
        """
        children: dict[int, list[int]] = {}
        size = dict.fromkeys(self.order, 1)
        for k in self.order[:0:-1]:
            children.setdefault(self.parent[k], []).append(k)
            size[self.parent[k]] += size[k]
        every = np.arange(len(self.v))
        todo: list[tuple[int, np.ndarray, np.ndarray]] = [(self.order[0], np.full(len(every), -np.inf), np.full(len(every), np.inf))]
        while todo:
            k, low, high = todo.pop()
            if k != self.order[0]:
                step = self.edge[k] * (1 + 1e-9) * self.norm + 1e-12 * (np.abs(low) + np.abs(high))
                low, high = low - step, high + step
            least, most, more = windows(k)
            inside = (high + more * self.norm >= least) & (low - more * self.norm <= most)
            if inside.mean() > 0.5:
                s = self.scores(k)
                low = high = s.astype(float)
                yield k, every, s
            else:
                at = np.flatnonzero(inside)
                s = self.scores(k, at)
                low[at] = high[at] = s.astype(float)
                yield k, at, s
            todo.extend((c, low, high) for c in sorted(children.get(k, []), key=lambda c: -size[c]))


def _best(s: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Places in ``at`` (ascending) of the ``n`` best scores, ties to the earlier."""
    if len(s) > n:
        bound = np.partition(s, len(s) - n)[len(s) - n]
        near = np.flatnonzero(s >= bound)
        return near[np.lexsort((at[near], -s[near]))[:n]] if s.dtype != object else near[sorted(range(len(near)), key=lambda i: (-s[near[i]], i))[:n]]
    return np.array(sorted(range(len(s)), key=lambda i: (-s[i], i)), np.int64)


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.stack(rows.to_numpy())


#: A group in one row: its anchors in the order of its tree's places.
GROUPED = "part long, chunk long, uid array<long>, id array<long>, label array<long>, v array<long>, order array<long>, parent array<long>, ends array<long>, positive array<long>, positive_score array<long>"


def _grouped(anchors: DataFrame) -> DataFrame:
    """One row for each (part, chunk) of anchors, with its spanning tree."""

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("uid")
        v = _matrix(rows["v"])
        held = [rows[c].to_numpy() for c in ("uid", "id", "label")]
        ends = np.cumsum(rows["positive"].map(len).to_numpy())
        flat = [np.concatenate(rows[c].to_numpy()) for c in ("positive", "positive_score")]
        return pd.DataFrame([(*key, *held, v.ravel(), *_tree(v), ends, *flat)], columns=_names(GROUPED))

    return anchors.groupBy("part", "chunk").applyInPandas(build, GROUPED)


def _met(candidates: DataFrame, groups: DataFrame, scan: Callable, schema: str) -> DataFrame:
    """``scan(ids, labels, group, search)`` of every block of candidates and every group that it meets.

    Both hold part, chunk and block; candidates are in the order of their ids.
    """

    def run(key: tuple, held: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(held) and len(group):
            held, g = held.sort_values("id", kind="stable"), group.iloc[0]
            search = Search(_matrix(held["v"]), g["v"].reshape(len(g["uid"]), -1), g["order"], g["parent"])
            for row in scan(held["id"].to_numpy(), held["label"].to_numpy(), g, search):
                out.append(tuple(min(max(int(x), RANGE[0]), RANGE[1]) for x in row))
        return pd.DataFrame(out, columns=_names(schema), dtype="int64")

    keys = ["part", "chunk", "block"]
    return candidates.groupBy(*keys).cogroup(groups.groupBy(*keys)).applyInPandas(run, schema)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _slot(what: str, n: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(what), "uid"), n)


def _each(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))


FOUND = "uid long, anchor_id long, own long, id long, score long"


def positives(rows: DataFrame, anchors: DataFrame, n: int = POSITIVES) -> DataFrame:
    """(uid, positive, positive_score): the ids and scores of each anchor's ``n`` best other rows of its label, best first.  ``rows`` and ``anchors`` hold uid, id, label, v."""

    def scan(ids: np.ndarray, _: np.ndarray, g: pd.Series, search: Search) -> Iterator[tuple]:
        near: dict[int, np.ndarray] = {}

        def window(k: int) -> tuple[float, float, float]:
            # what did best at the parent bounds the best scores from below
            seeds = near.get(search.parent[k], ())
            return (float(min(search.scores(k, seeds))) if len(seeds) > n else -np.inf), np.inf, 0.0

        for k, at, s in search.walk(window):
            pick = _best(s, at, n + 1)
            near[k] = at[pick]
            own = sum(int(x) ** 2 for x in search.a[k])
            yield from ((g["uid"][k], g["id"][k], own, i, x) for i, x in zip(ids[at[pick]].tolist(), s[pick].tolist(), strict=True))

    sizes = rows.groupBy("label").agg(F.count("*").alias("rows")).join(anchors.groupBy("label").agg(F.count("*").alias("anchors")), "label")
    sizes = sizes.select(F.col("label").alias("part"), F.ceil(F.col("rows") / BLOCK[1]).alias("blocks"), F.ceil(F.col("anchors") / GROUP).alias("chunks"))
    candidates = rows.withColumn("part", F.col("label")).join(sizes, "part").withColumn("block", _slot("block", F.col("blocks"))).withColumn("chunk", _each(F.col("chunks")))
    own = anchors.withColumn("part", F.col("label")).join(sizes, "part").withColumn("chunk", _slot("chunk", F.col("chunks")))
    nothing = F.array().cast("array<long>")
    groups = _grouped(own.withColumn("positive", nothing).withColumn("positive_score", nothing)).join(sizes, "part").withColumn("block", _each(F.col("blocks")))
    found = _met(candidates.drop("blocks", "chunks"), groups.drop("blocks", "chunks"), scan, FOUND)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= n + 1)
    # the anchor itself, if it is among the best, is the row with its id and its score with itself
    itself = F.min(F.when((F.col("id") == F.col("anchor_id")) & (F.col("score") == F.col("own")), F.col("rank"))).over(Window.partitionBy("uid"))
    others = ranked.withColumn("itself", itself).where("itself is null or rank <> itself").where(F.col("rank") - F.coalesce((F.col("rank") > F.col("itself")).cast("int"), F.lit(0)) <= n)
    listed = F.array_sort(F.collect_list(F.struct("rank", "id", "score")))
    return others.groupBy("uid").agg(listed.alias("best")).select("uid", F.col("best.id").alias("positive"), F.col("best.score").alias("positive_score"))


def windows_of(scores: Iterable[int], low: int, high: int) -> list[tuple[int, int]]:
    """Least and greatest whole score between ``low`` and ``high`` hundredths of each positive's; some hold nothing."""
    return [(-(-low * int(s) // 100), high * int(s) // 100) for s in scores]


NEGATIVE = "uid long, nth long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def _hubs(anchors: DataFrame, low: int, high: int) -> tuple[DataFrame, np.ndarray, pd.DataFrame]:
    """(anchors with a hub's number as part, and chunk; the hubs; by hub: chunks, window, radius)."""
    n = anchors.count()
    _, sample = hash_sample(anchors, "uid", min(HUBS, -(-n // GROUP)))
    points = np.stack([r["v"] for r in sample.orderBy("uid").collect()]).astype(np.int64)
    near = points.astype(float)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                v = _matrix(batch["v"]).astype(float)
                part = np.array([((near - x) ** 2).sum(1).argmin() for x in v])
                spans = [[w for w in windows_of(p, low, high) if w[0] <= w[1]] for p in batch["positive_score"]]
                yield pd.DataFrame({
                    "uid": batch["uid"], "part": part, "off": np.sqrt(((v - near[part]) ** 2).sum(1)),
                    "least": [float(min((w[0] for w in s), default=np.inf)) for s in spans], "most": [float(max((w[1] for w in s), default=-np.inf)) for s in spans],
                })

    dealt = cut(anchors.mapInPandas(assign, "uid long, part long, off double, least double, most double").where("least < 'inf'"))
    by_hub = dealt.groupBy("part").agg(F.ceil(F.count("*") / GROUP).alias("chunks"), F.min("least").alias("least"), F.max("most").alias("most"), F.max("off").alias("off")).toPandas()
    chunks = F.element_at(F.create_map(*(F.lit(int(x)) for pair in zip(by_hub["part"], by_hub["chunks"], strict=True) for x in pair)), F.col("part").cast("int")) if len(by_hub) else F.lit(1)
    placed = anchors.join(dealt.select("uid", "part"), "uid").withColumn("chunk", _slot("chunk", chunks))
    return placed, points, by_hub


def _concerned(rows: DataFrame, points: np.ndarray, by_hub: pd.DataFrame) -> DataFrame:
    """``rows`` once for each (part, chunk) with whose windows the bounds along the tree of hubs don't rule them out."""
    order, parent = _tree(points)
    facts = {int(r.part): (r.least, r.most, r.off * (1 + 1e-9), int(r.chunks)) for r in by_hub.itertuples()}
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", part long, chunk long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
            search = Search(v, points, order, parent)
            for hub, at, s in search.walk(lambda k: facts.get(k, (np.inf, -np.inf, 0.0, 0))[:3]):
                least, most, off, chunks = facts.get(hub, (np.inf, -np.inf, 0.0, 0))
                s, more = s.astype(float), off * search.norm[at] * (1 + 1e-9)
                held = batch.take(pa.array(at[(s + more >= least) & (s - more <= most)]))
                for chunk in range(chunks if held.num_rows else 0):
                    yield pa.RecordBatch.from_arrays([*held.columns, pa.array(np.full(len(held), hub)), pa.array(np.full(len(held), chunk))], [*held.schema.names, "part", "chunk"])

    return rows.mapInArrow(run, schema)


def hard_negatives(rows: DataFrame, is_anchor: Column, n_positives: int = POSITIVES, n: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors among ``quantised`` rows."""
    width = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").first()
    # numbered once, so that a task run again deals its rows as before
    rows = cut(rows.where(F.size("v") == (width["width"] if width else 0)).withColumn("uid", F.monotonically_increasing_id()))
    anchors = rows.where(is_anchor)
    asked = cut(anchors.join(positives(rows, anchors, n_positives), "uid"))
    if asked.isEmpty():
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    placed, points, by_hub = _hubs(asked, low, high)
    total = rows.count()
    blocks = F.lit(-(-total // int(np.clip(total // BLOCKS, *BLOCK))))

    def scan(ids: np.ndarray, labels: np.ndarray, g: pd.Series, search: Search) -> Iterator[tuple]:
        cuts = g["ends"][:-1]
        partners = list(zip(np.split(g["positive"], cuts), np.split(g["positive_score"], cuts), strict=True))
        spans = [windows_of(scores, low, high) for _, scores in partners]

        def window(k: int) -> tuple[float, float, float]:
            full = [w for w in spans[k] if w[0] <= w[1]]
            return float(min(w[0] for w in full)), float(max(w[1] for w in full)), 0.0

        for k, at, s in search.walk(window):
            least, most, _ = window(k)
            other = np.flatnonzero((labels[at] != g["label"][k]) & (s >= least) & (s <= most))
            at, s = at[other], s[other]
            for nth, ((a, b), positive, score) in enumerate(zip(spans[k], *partners[k], strict=True)):
                fit = np.flatnonzero((s >= a) & (s <= b))
                pick = fit[_best(s[fit], at[fit], n)]
                yield from ((g["uid"][k], nth, g["id"][k], positive, score, i, x) for i, x in zip(ids[at[pick]].tolist(), s[pick].tolist(), strict=True))

    candidates = _concerned(rows, points, by_hub).withColumn("block", _slot("block", blocks)).select("part", "chunk", "block", "id", "label", "v")
    groups = _grouped(placed).withColumn("block", _each(blocks))
    found = _met(candidates, groups, scan, NEGATIVE)
    best = Window.partitionBy("uid", "nth").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = f"""
WITH rows AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.id AS anchor_id, a.label = b.label AS same, b.id, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM rows a JOIN rows b ON a.id % 50 = 0 AND a.id <> b.id
), positive AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS nth FROM scored WHERE same
  ) WHERE nth <= {POSITIVES}
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
  FROM positive p JOIN scored s USING (anchor_id)
  WHERE NOT same AND {LOW} * positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * positive_score
) WHERE rank <= {NEGATIVES}
"""
