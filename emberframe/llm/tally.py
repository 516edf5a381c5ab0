"""Corpus-wide counts of keys that every text holds in great number, brought back to the texts.

A word, a pair of words or a shingle is a key of some 40 bits.  One row for each
key of each text would outweigh the texts many times over, so keys travel packed:

1. texts are dealt by hash into slices; a slice's distinct keys, in ascending
   order, go out in one row for each part of the key space;
2. a part adds up its keys over all slices and answers each slice with the totals
   of just the keys that it sent, in their order;
3. texts and answers of a slice meet again, and the slice is worked on with exact
   totals over the whole corpus.

The first and the third step read one and the same shuffle of the texts.  A key
that every text holds costs a part one entry for each slice, not for each text.
Sizes of slices and parts grow with the square root of the corpus up to a bound,
so that neither a task's memory nor the number of rows gets out of hand.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least and most bytes of text in a slice, and of the texts whose keys a part adds up.
SLICE_BYTES = (1 << 18, 1 << 26)
PART_BYTES = (1 << 20, 1 << 26)

#: (place of every entry among the part's keys, entries' counts: one row for each, number of keys) -> what each entry is told, one row for each.
Merge = Callable[[np.ndarray, np.ndarray, int], np.ndarray]


def sums(where: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """Every entry is told its key's totals."""
    return np.stack([np.bincount(where, c.astype(float), n).astype(np.uint64)[where] for c in counts])


def firsts(where: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """Every entry is told whether its counts, compared in order, are the least of its key."""
    order = np.lexsort((*counts[::-1], where))
    least = np.zeros(n, np.int64)
    least[where[order[::-1]]] = order[::-1]
    return (counts == counts[:, least[where]]).all(0)[None].astype(np.uint64)


#: A slice's rows -> (its distinct keys in ascending order, counts: one row for each thing that is counted).
Keys = Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]
#: (a slice's rows, its keys, what each is told, the corpus' sums over the even keys: how many, and of each count).
Finish = Callable[[pa.Table, np.ndarray, np.ndarray, np.ndarray], pa.Table]


def pack(values: np.ndarray) -> bytes:
    """64-bit values, byte by byte of all: leading zeros lie together, where compression finds them."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def key_bits(total: int, spare: int) -> int:
    """Width of keys at which two of a corpus of ``total`` bytes seldom coincide: one in 2 ** spare."""
    return min(64, ceil(log2(total + 2)) + spare)


def _grain(total: int, scale: int, bounds: tuple[int, int]) -> float:
    return min(max(scale * (2048 * total) ** 0.5, bounds[0]), bounds[1])


def tallied(docs: DataFrame, total: int, bits: int, keys_of: Keys, finish: Finish, schema: str, merge: Merge = sums) -> DataFrame:
    """``finish`` of every slice of ``docs`` (text and whatever else it needs), which hold ``total`` bytes of text.

    A column ``slice`` of ``docs`` says how they were dealt before.
    """
    slices = max(1, ceil(total / _grain(total, 1, SLICE_BYTES)))
    part_bits = min(bits, ceil(log2(max(1, total / _grain(total, 4, PART_BYTES)))))
    shift = np.uint64(bits - part_bits)

    def send(rows: pa.Table) -> pa.Table:
        keys, counts = keys_of(rows)
        at = np.searchsorted(keys >> shift if shift < 64 else np.zeros_like(keys), np.arange((1 << part_bits) + 1, dtype=np.uint64))
        runs = [(a, b) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        n = len(runs)
        return pa.table({
            "part": pa.array(range(n), pa.int64()),
            "slice": pa.array([rows.column("slice")[0].as_py()] * n, pa.int64()),
            "keys": pa.array([pack(np.diff(keys[a:b], prepend=np.uint64(0))) for a, b in runs], pa.binary()),
            "counts": pa.array([pack(counts[:, a:b].astype(np.uint64).ravel()) for a, b in runs], pa.binary()),
        })

    def add(rows: pa.Table) -> pa.Table:
        sent = [np.cumsum(unpack(k), dtype=np.uint64) for k in rows.column("keys").to_pylist()]
        counts = [unpack(c).reshape(-1, len(k)) if len(k) else None for c, k in zip(rows.column("counts").to_pylist(), sent, strict=True)]
        keys = np.concatenate(sent)
        known = np.unique(keys)
        kinds = max((len(c) for c in counts if c is not None), default=0)
        where = np.searchsorted(known, keys)
        entries = np.concatenate([np.zeros((kinds, 0), np.uint64), *(c for c in counts if c is not None)], axis=1)
        told = merge(where, entries, len(known)) if kinds else entries
        even = known % np.uint64(2) == 0
        whole = np.append(np.uint64(even.sum()), entries[:, even[where]].sum(1)).astype(np.uint64)
        ends = np.cumsum([len(k) for k in sent])
        return pa.table({
            "slice": rows.column("slice"),
            "part": rows.column("part"),
            "totals": pa.array([pack(told[:, b - len(k) : b].ravel()) for k, b in zip(sent, ends.tolist(), strict=True)], pa.binary()),
            "whole": pa.array([pack(whole)] * len(sent), pa.binary()),
        })

    def close(rows: pa.Table, answers: pa.Table) -> pa.Table:
        keys, counts = keys_of(rows)
        parts = answers.sort_by("part").to_pydict()
        told = [t for t in map(unpack, parts["totals"]) if len(t)]
        totals = [t.reshape(sum(map(len, told)) // len(keys), -1) for t in told]
        whole = np.zeros(1 + len(counts), np.uint64)
        for w in map(unpack, parts["whole"]):
            whole[: len(w)] += w
        return finish(rows, keys, np.concatenate(totals, 1) if totals else counts, whole)

    salted = F.xxhash64("text", F.monotonically_increasing_id())
    sliced = (docs if "slice" in docs.columns else docs.withColumn("slice", F.pmod(salted, F.lit(slices)))).groupBy("slice")
    sent = sliced.applyInArrow(send, "part long, slice long, keys binary, counts binary")
    answers = sent.groupBy("part").applyInArrow(add, "slice long, part long, totals binary, whole binary")
    return sliced.cogroup(answers.groupBy("slice")).applyInArrow(close, schema)
