"""SimHash near-dedup over a Gray-order hierarchical index.

Fingerprints.  A text is lower-cased (A-Z), cut at ASCII white space and turned
into shingles of words, repeats included; each shingle is hashed with XXH64
(seed 42) and a fingerprint bit is 1 if it is set in over half of the hashes.

Index.  The 64 bits are cut into ``max_bits + 2`` blocks.  Two fingerprints that
differ in at most ``max_bits`` bits agree in two blocks at least, so they meet
in one of the upper nodes (two blocks, shared pattern).  A node with more than
``NODE_ROWS`` fingerprints is factored once more in the same way over its free
bits, so that a large group of near copies is spread over many nodes.  Nodes are
distributed by Spark and sorted by the Gray rank of the free bits.  Inside a node
runs of neighbours in Gray order form inner nodes, each with the bits that all
its members share (masked pattern); searching goes from the root down, adds up
the differences in the newly shared bits, and leaves out a whole group as soon
as the sum exceeds ``max_bits``.  A node returns a spanning forest of its links,
not its pairs, so output stays linear in the rows while no link is lost.

Components of the forest edges are labelled by their least doc_id.

Defined cases: null or empty text has fingerprint 0, linked like any other;
equal fingerprints are one vertex, so exact copies cost one row; null doc_ids
are never the label unless a component has no other; an empty table gives no
rows; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.llm.common import Texts, cut, fresh, mix64, slices, text_key
from emberframe.llm.tally import key_bits, tallied, text_bytes
from emberframe.llm.words import word_hashes
from emberframe.operators.components import connected_components

#: Fingerprints in an upper node beyond which it is factored once more.
NODE_ROWS = 2048
#: Children of an inner node of the in-task tree.
FAN = 8

_hash = partial(xxhash.xxh64_intdigest, seed=42)


def shingle_hashes(text: bytes, width: int) -> Iterator[np.ndarray]:
    """Hashes of all shingles of a text, in runs of bounded length."""
    words = text.lower().split()
    if not words:
        return
    if len(words) <= width:
        yield np.array([_hash(b" ".join(words))], np.uint64)
        return
    for start in range(0, len(words) - width + 1, 1 << 16):
        run = words[start : start + (1 << 16) + width - 1]
        joined = b" ".join(run)
        lengths = np.fromiter(map(len, run), np.int64, len(run))
        ends = np.cumsum(lengths + 1) - 1
        begins = (ends - lengths)[: len(run) - width + 1].tolist()
        stops = ends[width - 1 :].tolist()
        yield np.fromiter((_hash(joined[a:b]) for a, b in zip(begins, stops, strict=True)), np.uint64, len(begins))


def fingerprint(text: bytes, width: int) -> int:
    """Unsigned 64-bit SimHash; 0 for a text without words."""
    total, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, width):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(0, dtype=np.int32)
        n += len(hashes)
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = [fingerprint(t or b"", shingle) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def _blocks(free: list[int], parts: int) -> list[int]:
    """Bit masks of ``parts`` runs of nearly equal length over the bit positions ``free``."""
    return [sum(1 << b for b in run.tolist()) for run in np.array_split(np.array(free), parts)]


def masks(max_bits: int, within: int = (1 << 64) - 1) -> list[int]:
    """Masks of which at least one is free of differences, if at most ``max_bits`` bits of ``within`` differ."""
    free = [b for b in range(64) if within >> b & 1]
    return [a | b for a, b in combinations(_blocks(free, max_bits + 2), 2)]


_ALL = np.uint64((1 << 64) - 1)


def _gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of codes in reflected Gray order."""
    for step in (1, 2, 4, 8, 16, 32):
        codes = codes ^ (codes >> np.uint64(step))
    return codes


def _node_rows(max_bits: int) -> tuple[Callable, Callable]:
    """Arrow functions (fp, v) -> upper nodes and (view, pattern, rows, fp, v) -> nodes with the rank in them."""
    views = np.array(masks(max_bits), np.uint64)
    finer = np.array([masks(max_bits, int(~m)) for m in views], np.uint64)

    def upper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, v = (np.tile(batch.column(k).to_numpy(), len(views)) for k in ("fp", "v"))
            view = np.repeat(np.arange(len(views)), batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(view, pa.int32()), pa.array((fp.view(np.uint64) & views[view]).view(np.int64)), pa.array(fp), pa.array(v)], ["view", "pattern", "fp", "v"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            view, pattern, rows, fp, v = (batch.column(k).to_numpy() for k in ("view", "pattern", "rows", "fp", "v"))
            times = np.where(rows > NODE_ROWS, finer.shape[1], 1)
            at = np.repeat(np.arange(len(fp)), times)
            sub = np.where(times[at] > 1, np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times), -1)
            mask = np.where(sub < 0, np.uint64(0), finer[view[at], sub])
            codes = fp[at].view(np.uint64)
            rank = _gray_rank(codes & ~(views[view[at]] | mask)) ^ np.uint64(1 << 63)  # signed order is then unsigned order
            cols = [view[at], pattern[at], sub.astype(np.int32), (codes & mask).view(np.int64), rank.view(np.int64), fp[at], v[at]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["view", "pattern", "sub", "subpattern", "rank", "fp", "v"])

    return upper, split


def _nodes(fps: DataFrame, max_bits: int) -> DataFrame:
    """(view, pattern, sub, subpattern, rank, fp, v): every fingerprint once for each upper node that holds others too."""
    upper, split = _node_rows(max_bits)
    first = fps.select("fp", "v").mapInArrow(upper, "view int, pattern long, fp long, v long")
    held = first.groupBy("view", "pattern").agg(F.count("*").alias("rows")).where("rows > 1")
    met = first.join(held, ["view", "pattern"]).select("view", "pattern", "rows", "fp", "v")
    return met.mapInArrow(split, "view int, pattern long, sub int, subpattern long, rank long, fp long, v long")


def _levels(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Inner nodes over codes in Gray order, root level first: (bits newly shared at the node, their pattern).

    The bits that a parent's members share are taken out of its children, so
    differences add up along a path.
    """
    all_set, any_set = codes, codes
    shared = []
    while len(all_set) > 1:
        starts = np.arange(0, len(all_set), FAN)
        all_set, any_set = np.bitwise_and.reduceat(all_set, starts), np.bitwise_or.reduceat(any_set, starts)
        shared.append((~(all_set ^ any_set), all_set))
    shared.reverse()
    out = []
    for depth, (mask, pattern) in enumerate(shared):
        new = mask.copy()
        if depth:
            new &= ~np.repeat(shared[depth - 1][0], FAN)[: len(mask)]
        out.append((new, pattern & new))
    leaf = np.full(len(codes), (1 << 64) - 1, np.uint64)
    if shared:
        leaf &= ~np.repeat(shared[-1][0], FAN)[: len(codes)]
    out.append((leaf, codes & leaf))
    return out


def linked_pairs(codes: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (a < b) of codes in Gray order that differ in at most ``max_bits`` bits, in bounded runs."""
    levels = _levels(codes)
    step = max(1, (1 << 20) // len(codes))
    for start in range(0, len(codes), step):
        query = np.arange(start, min(start + step, len(codes)))
        node, acc = np.zeros(len(query), np.int64), np.zeros(len(query), np.uint8)
        for depth, (mask, pattern) in enumerate(levels):
            if depth:
                query, acc = np.repeat(query, FAN), np.repeat(acc, FAN)
                node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                # a group that ends before the query holds only pairs met from the other side
                last = np.minimum((node + 1) * FAN ** (len(levels) - 1 - depth), len(codes)) - 1
                fits = (node < len(mask)) & (last > query)
                query, node, acc = query[fits], node[fits], acc[fits]
            acc = acc + np.bitwise_count((codes[query] & mask[node]) ^ pattern[node])
            near = acc <= max_bits
            query, node, acc = query[near], node[near], acc[near]
        if len(query):
            yield query, node


def _forest(codes: np.ndarray, max_bits: int) -> np.ndarray:
    """For every code the index of a linked code's root; connected codes get the same root."""
    root = np.arange(len(codes))
    for a, b in linked_pairs(codes, max_bits):
        while True:
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                break
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            low, high = np.minimum(ra, rb), np.maximum(ra, rb)
            np.minimum.at(root, high, low)
            while (root[root] != root).any():
                root = root[root]
    return root


def links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """(a, b): vertices joined by links, a spanning forest for every upper node.

    ``fps`` has (fp, v).
    """
    keys = ["view", "pattern", "sub", "subpattern"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def search(node: list[np.ndarray], fp: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
            change = np.zeros(len(fp), bool)
            change[0] = True
            for k in node:
                change[1:] |= k[1:] != k[:-1]
            starts = np.flatnonzero(change)
            ends = np.append(starts[1:], len(fp))
            pairs = starts[ends - starts == 2]  # the commonest node: two leaves
            pairs = pairs[np.bitwise_count(fp[pairs] ^ fp[pairs + 1]) <= max_bits]
            a, b = [v[pairs]], [v[pairs + 1]]
            for lo, hi in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist(), strict=True):
                codes, names = fp[lo:hi], v[lo:hi]
                root = _forest(codes, max_bits)
                moved = np.flatnonzero(root != np.arange(len(codes)))
                a.append(names[moved])
                b.append(names[root[moved]])
            a, b = np.concatenate(a), np.concatenate(b)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy() for k in (*keys, "fp", "v")]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            same = np.ones(len(cols[0]), bool)
            for k in cols[:-2]:
                same &= k == k[-1]
            end = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if end:
                yield from search([c[:end] for c in cols[:-2]], cols[-2][:end].view(np.uint64), cols[-1][:end])
            held = [c[end:] for c in cols]
        if held is not None and len(held[0]):
            yield from search(held[:-2], held[-2].view(np.uint64), held[-1])

    return _nodes(fps, max_bits).repartition(*keys).sortWithinPartitions(*keys, "rank", "v").mapInArrow(run, "a long, b long").distinct()


def components(marked: DataFrame, max_bits: int = 2) -> DataFrame:
    """(doc_id, fp) -> (doc_id, fp, component_id); ``marked`` should be materialised, it is read twice."""
    classes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = connected_components(links(classes.select("fp", F.col("fp").alias("v")), max_bits)).select(F.col("vertex").alias("fp"), "root")
    reached = found.join(classes, "fp").groupBy("root").agg(F.min("least").alias("component"))
    grown = found.join(reached, "root").select("fp", "component")
    labelled = cut(classes.join(grown, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id")))
    return marked.join(labelled, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable)."""
    found = components(cut(fingerprints(docs, shingle)), max_bits)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Bits of the keys by which shingles are counted, beyond those that number the corpus' bytes.
SPARE = 8
#: Ratio of neighbouring classes of size.
STEP = 1.05
#: Stands for a null doc_id, behind all others.
NO_ID = (1 << 63) - 1


def shingle_sets(texts: Texts, width: int) -> tuple[list[np.ndarray], list[bytes]]:
    """Of every text the distinct hashes of its shingles of ``width`` words, ascending, and 128 bits of its word sequence."""
    words, bounds = word_hashes(texts, True)
    chain = np.zeros(len(words), np.uint64)
    for k in range(min(width, len(words))):
        chain[: len(words) - k] = mix64(chain[: len(words) - k] + words[k:])
    sets, digests = [], []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width or a == b:
            found = chain[a : max(a, b - width + 1)]
        else:  # the whole sequence
            found = np.zeros(1, np.uint64)
            for k in range(a, b):
                found = mix64(found + words[k])
        sets.append(np.unique(found))
        digests.append(xxhash.xxh3_128_digest(words[a:b].tobytes()))
    return sets, digests


def _content(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """(doc_id, text_key, h1, h2, n, singles, fp, prefix, shared) per row of ``docs``.

    h1 and h2 are 128 bits of the word sequence, n the number of shingles, singles
    those that no other row of the table holds.  Two sets with a Jaccard similarity
    of ``similarity`` share one of their rarest n - ceil(similarity * n) + 1
    elements, in whatever order all sets agree on; ``prefix`` has those of them that
    others hold too.  If it is empty nothing can be similar, and ``shared`` (all
    shingles that others hold) is left empty as well.
    """
    total = text_bytes(docs)
    bits = key_bits(total, SPARE)
    shift = np.uint64(64 - bits)

    def keys_of(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        sets, _ = shingle_sets(Texts(rows.column("text").combine_chunks()), width)
        keys, n = np.unique(np.concatenate(sets) >> shift, return_counts=True)
        return keys, n[None]

    def finish(rows: pa.Table, keys: np.ndarray, totals: np.ndarray, _: np.ndarray) -> pa.Table:
        sets, digests = shingle_sets(Texts(rows.column("text").combine_chunks()), width)
        held = totals[0, np.searchsorted(keys, np.concatenate(sets) >> shift)]
        alone, fps, prefixes, shares, at = [], [], [], [], 0
        for x in sets:
            times, at = held[at : at + len(x)], at + len(x)
            singles = int((times == 1).sum())
            rare = len(x) - int(np.ceil(similarity * len(x) - 1e-9)) + 1 if len(x) else 0
            fp, prefix, shared = 0, x[:0], x[:0]
            if singles < rare:
                prefix, shared = x[np.lexsort((x, times))[singles:rare]], x[times > 1]
                ones = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
                fp = int(np.packbits(ones * 2 > len(x), bitorder="little").view(np.int64)[0])
            alone.append(singles)
            fps.append(fp)
            prefixes.append(prefix.view(np.int64))
            shares.append(shared.view(np.int64))
        halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        lists = pa.list_(pa.int64())
        return pa.table({
            "doc_id": rows.column("doc_id"), "text_key": rows.column("text_key"), "h1": halves[:, 0].copy(), "h2": halves[:, 1].copy(), "n": pa.array(map(len, sets), pa.int32()),
            "singles": pa.array(alone, pa.int32()), "fp": pa.array(fps, pa.int64()), "prefix": pa.array(prefixes, lists), "shared": pa.array(shares, lists),
        })

    rows = docs.select(F.col("doc_id").cast("long"), text_key().alias("text_key"), "text")
    return tallied(rows, total, bits, keys_of, finish, "doc_id long, text_key long, h1 long, h2 long, n int, singles int, fp long, prefix array<long>, shared array<long>")


def _postings(suspects: DataFrame) -> DataFrame:
    """(s, v, n, at, alone): shingle ``s`` at place ``at`` of the prefix of text ``v``; ``alone``: share of shingles of its own."""
    return suspects.select("v", "n", "singles", (F.col("singles") / F.col("n")).alias("alone"), F.posexplode("prefix").alias("pos", "s")).select("s", "v", "n", (F.col("singles") + F.col("pos")).alias("at"), "alone")


def _pairs(df: DataFrame, v: str, w: str) -> DataFrame:
    return df.where(F.col(v) != F.col(w)).select(F.least(v, w).alias("a"), F.greatest(v, w).alias("b"))


def _by_fingerprint(suspects: DataFrame, max_bits: int) -> DataFrame:
    """(a, b): texts whose fingerprints the Gray-order index links, each fingerprint's texts through one of them."""
    first = suspects.groupBy("fp").agg(F.min("v").alias("w"))
    return links(first.select("fp", F.col("w").alias("v")), max_bits).unionByName(_pairs(suspects.join(first, "fp"), "v", "w"))


def _by_pivot(postings: DataFrame, similarity: float) -> DataFrame:
    """(a, b): every member of a bucket with the bucket's pivot, its member with the least share of shingles of its own.

    Where copies were edited apart from each other, that is the text they were made from.
    """
    best = postings.groupBy("s").agg(F.count("*").alias("rows"), F.max(F.struct(-F.col("alone"), F.xxhash64("v"), "v", "n")).alias("p")).where("rows > 1")
    met = postings.join(best.select("s", F.col("p.v").alias("w"), F.col("p.n").alias("m")), "s")
    return _pairs(met.where(F.least("n", "m") + 1e-6 >= similarity * F.greatest("n", "m")), "v", "w")


def _size_class(n: Column) -> Column:
    return F.floor(F.log(n) / F.log(F.lit(STEP))).cast("int")


def _across(postings: DataFrame, linked: DataFrame, similarity: float) -> DataFrame:
    """(a, b): all pairs of a bucket that can be similar and that ``linked`` doesn't connect.

    Two sets whose first common shingle stands at places ``at`` and ``bt`` share no
    more than min(n - at, m - bt), which bounds the size of a partner.  Members
    outside the bucket's largest component look for partners of each size in reach.
    """
    roots = connected_components(linked).select(F.col("vertex").alias("v"), "root")
    placed = postings.join(roots, "v", "left").withColumn("root", F.coalesce("root", "v"))
    kinds = placed.groupBy("s", "root").agg(F.count("*").alias("rows")).groupBy("s").agg(F.max_by("root", "rows").alias("most"), F.count("*").alias("kinds"))
    left = cut(placed.join(kinds.where("kinds > 1").select("s", "most"), "s"))
    reach = (F.col("n") - F.col("at")) * ((1 + similarity) / similarity) - F.col("n") + 1e-6
    sizes = F.explode(F.sequence(_size_class(similarity * F.col("n") - 1e-6), _size_class(reach)))
    outside = left.where((F.col("root") != F.col("most")) & (reach >= similarity * F.col("n") - 1e-6)).select("s", sizes.alias("size"), F.col("v").alias("w"), F.col("n").alias("m"), F.col("at").alias("bt"), F.col("root").alias("other"))
    both = left.withColumn("size", _size_class(F.col("n") + 1e-9)).join(outside, ["s", "size"])
    shared = F.least(F.col("n") - F.col("at"), F.col("m") - F.col("bt"))
    can = (F.least("n", "m") + 1e-6 >= similarity * F.greatest("n", "m")) & (shared + 1e-6 >= similarity / (1 + similarity) * (F.col("n") + F.col("m")))
    return _pairs(both.where((F.col("root") != F.col("other")) & can), "v", "w")


def _compared(pairs: DataFrame, suspects: DataFrame, similarity: float) -> DataFrame:
    """(a, b, linked): whether the sets of a pair are as similar as that."""
    side = lambda v, n, x: suspects.select(F.col("v").alias(v), F.col("n").alias(n), F.col("shared").alias(x))
    both = pairs.distinct().join(side("a", "n", "x"), "a").join(side("b", "m", "y"), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.select("a", "b", (common + 1e-9 >= similarity * (F.col("n") + F.col("m") - common)).alias("linked"))


def one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, max_bits: int = 2) -> DataFrame:
    """``docs`` with one document, that of the least doc_id, of every group of exact or near copies.

    Texts with the same words in the same order are one vertex (128-bit hashes).
    Two vertices are linked if the Jaccard similarity of their sets of shingles
    reaches ``similarity``; components of links are groups.  Candidates come from

    1. exact counts of all shingles: a text with enough shingles that no other holds
       has no near copy and leaves here; of the rest
    2. fingerprints of the same shingles, linked by the Gray-order index;
    3. the rarest shingles (prefix filter): linked sets share one of them.  The
       members of a shingle's bucket are compared with one pivot, then all pairs
       that are not connected yet and can be similar by their places and sizes.

    Each is compared exactly, so no link between groups is missed (fingerprints
    alone would: at similarity 0.8 some ten of 64 bits differ) and a large group
    of copies costs its rows, not its pairs.

    Defined cases: null and empty texts are copies of each other; a null doc_id
    stands behind all others; of identical rows one stays; an empty table gives
    no rows; other columns are kept and play no part.
    """
    least = F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), F.col("text_key").alias("_key"))).alias("least")
    whole = _content(docs, shingle, similarity).groupBy("h1", "h2").agg(least, *(F.first(k).alias(k) for k in ("n", "singles", "fp", "prefix", "shared")))
    texts = cut(whole.select(F.monotonically_increasing_id().alias("v"), "least", "n", "singles", "fp", "prefix", "shared"))
    suspects = texts.where(F.size("prefix") > 0)
    postings = _postings(suspects)
    seen = cut(_compared(_by_fingerprint(suspects, max_bits).unionByName(_by_pivot(postings, similarity)), suspects, similarity))
    rest = _across(postings, seen.where("linked"), similarity).join(seen, ["a", "b"], "left_anti")
    linked = cut(seen.where("linked").unionByName(_compared(rest, suspects, similarity).where("linked")))
    groups = connected_components(linked).select(F.col("vertex").alias("v"), "root")
    kept = texts.select("v", "least").join(groups, "v", "left").groupBy(F.coalesce("root", "v").alias("group")).agg(F.min("least").alias("least"))
    # identical rows are one before they are shuffled, so that none of them is a hot key
    row = [fresh(docs, "id"), fresh(docs, "key")]
    once = docs.withColumns(dict(zip(row, (F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), text_key()), strict=True))).dropDuplicates(row)
    return once.join(kept.select(F.col("least._id").alias(row[0]), F.col("least._key").alias(row[1])), row).select(*docs.columns)
