"""Line dedup: range-partitioned line hashes, streamed first occurrences, keep bitmaps.

A line's key is the line stripped of ASCII white space with A-Z lower-cased.
Keys of ``MIN_CHARS`` code points or more that are found in ``MIN_DOCS``
documents or more lose all their lines except in the largest doc_id.

1. Whole texts become rows (doc_id, text_key, line number, 128-bit key hash).
2. The rows are range-partitioned and sorted by (hash, doc_id descending, line).
   The document is part of the range, so a key with very many lines is cut over
   several partitions instead of landing in one.
3. Each partition is streamed once.  The first document of a key is the one that
   keeps it; lines of later documents are marked as dropped once five documents
   were seen.  Only a partition's first and last key can go on in a neighbour;
   what decides them is emitted as open rows and settled by a small aggregate
   (two keys per partition at most, so it may be broadcast).
4. The marks become one compressed bitmap per document, which meets the text
   again only where kept text is asked for.

Defined cases: null or empty text is one empty line; an empty line is never
dropped; null doc_id counts as one document, smaller than all others; rows with
the same doc_id are one document, told apart by text when lines are dropped;
an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.llm.common import cut, fresh_names, slices, text_key

MIN_CHARS = 40
MIN_DOCS = 5
SPACE = b" \t\n\x0b\x0c\r"

LINES = "doc_id long, text_key long, at int, h1 long, h2 long"
MARKS = LINES + ", open boolean, seen int"


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, text_key, at, h1, h2) of every line whose key is long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, ats, digests = [], [], []
            for row, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                for at, line in enumerate((text or b"").split(b"\n")):
                    if len(line) < min_chars:
                        continue
                    key = line.strip(SPACE).lower()
                    if len(key) >= min_chars and (key.isascii() or len(key.decode(errors="replace")) >= min_chars):
                        rows.append(row)
                        ats.append(at)
                        digests.append(xxhash.xxh3_128_digest(key))
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(take), batch.column("text_key").take(take), pa.array(ats, pa.int32()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())],
                ["doc_id", "text_key", "at", "h1", "h2"],
            )

    return docs.select(F.col("doc_id").cast("long"), text_key().alias("text_key"), "text").mapInArrow(run, LINES)


def _stream(min_docs: int):
    """Marks of one sorted partition.

    Held over from batch to batch are, of one key, a row of the document that
    keeps it and the lines of the next few while they are fewer than ``min_docs``.
    The partition's first key is open whatever follows, so its rows go out at
    once; a null doc_id is a key's last document, so it is decided where it is met.
    ``seen`` tells of documents whose lines are settled already.
    """

    def marks(part: pa.Table, which: np.ndarray, open_: bool, seen: int = 0) -> pa.RecordBatch:
        out = part.take(pa.array(np.flatnonzero(which))).combine_chunks()
        more = [pa.array(np.full(len(out), open_)), pa.array(np.full(len(out), seen, np.int32))]
        return pa.RecordBatch.from_arrays([*(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in out.columns), *more], [*out.column_names, "open", "seen"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        enough = False  # the held key is in ``min_docs`` documents already
        first = None  # the partition's first key
        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.Table.from_batches([batch])
            part = part if held is None else pa.concat_tables([held, part])
            h1, h2 = (part.column(c).to_numpy() for c in ("h1", "h2"))
            doc, none = part.column("doc_id").fill_null(0).to_numpy(), part.column("doc_id").is_null().to_numpy()
            if first is None:
                first = (h1[0], h2[0])
            new_key = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
            new_doc = new_key | np.r_[True, (doc[1:] != doc[:-1]) | (none[1:] != none[:-1])]
            starts = np.flatnonzero(new_key)
            key = np.cumsum(new_key) - 1
            nth_doc = np.cumsum(new_doc) - np.cumsum(new_doc)[starts][key]  # 0 in the document that keeps the key
            docs_of = np.maximum.reduceat(nth_doc, starts) + 1
            if held is not None and enough:
                docs_of[0] = min_docs
            in_first = (h1 == first[0]) & (h2 == first[1])
            drop = ~in_first & (nth_doc > 0) & (docs_of[key] >= min_docs)
            yield marks(part, drop, False)
            if in_first.any():
                yield marks(part, in_first, True)
            wait = (key == len(starts) - 1) & ~in_first & ~drop & ~(none & (nth_doc > 0))
            wait[np.flatnonzero(wait & (nth_doc == 0))[:-1]] = False
            held = part.take(pa.array(np.flatnonzero(wait))).combine_chunks() if wait.any() else None
            enough = bool(docs_of[-1] >= min_docs)
        if held is not None:
            yield marks(held, np.ones(len(held), bool), True, min_docs if enough else 0)

    return run


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text_key, at) of every line that goes."""
    lines = cut(line_keys(docs, min_chars))
    order = ["h1", "h2", F.col("doc_id").desc_nulls_last(), "at", "text_key"]
    marks = cut(lines.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_stream(min_docs), MARKS))
    undecided = marks.where("open")
    keys = undecided.groupBy("h1", "h2").agg(F.greatest(F.count_distinct(F.struct("doc_id")), F.max("seen")).alias("docs"), F.max("doc_id").alias("keeper"))
    settled = undecided.join(F.broadcast(keys), ["h1", "h2"]).where((F.col("docs") >= min_docs) & ~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return marks.where("not open").select("doc_id", "text_key", "at").unionByName(settled.select("doc_id", "text_key", "at"))


def keep_bitmaps(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, text_key, keep): a compressed bitmap for each document that loses a line.

    ``keep`` is zlib over little-endian bits, one a line, in whole bytes up to
    the last line dropped; lines after it, and documents without a row, stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for ats in batch.column("ats").to_pylist():
                bits = np.ones(max(ats) // 8 * 8 + 8, np.uint8)
                bits[ats] = 0
                keep.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(keep, pa.binary())], ["doc_id", "text_key", "keep"])

    return dropped_lines(docs, **options).groupBy("doc_id", "text_key").agg(F.collect_set("at").alias("ats")).mapInArrow(run, "doc_id long, text_key long, keep binary")


def kept_lines(text: bytes | None, keep: bytes | None) -> tuple[list[bytes], list[bytes]]:
    """(all lines, kept lines) of a text under its bitmap."""
    lines = (text or b"").split(b"\n")
    if keep is None:
        return lines, lines
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), bitorder="little")
    return lines, [x for i, x in enumerate(lines) if i >= len(bits) or bits[i]]


def _with_bitmaps(docs: DataFrame, **options) -> tuple[DataFrame, str]:
    """``docs`` and each one's bitmap, in a column of the name returned."""
    key, id_, text, keep = fresh_names(docs, "key", "id", "text", "keep")
    maps = keep_bitmaps(docs, **options).select(F.col("doc_id").alias(id_), F.col("text_key").alias(text), F.col("keep").alias(keep))
    # hashing the bitmaps spares sorting the texts
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(key) == F.col(text))
    return docs.withColumn(key, text_key()).join(maps.hint("shuffle_hash"), same, "left"), keep


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the kept lines as text; a null text stays null."""

    @F.pandas_udf("string")
    def rebuilt(text, keep):
        return text.combine(keep, lambda t, k: t if k is None or t is None else b"\n".join(kept_lines(t.encode(), k)[1]).decode())

    marked, keep = _with_bitmaps(docs, **options)
    return marked.withColumn("text", rebuilt("text", keep)).select(*docs.columns)


def digest(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept_sha256."""
    marked, name = _with_bitmaps(docs.select(F.col("doc_id").cast("long"), "text"), **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, gone, sha = [], [], []
            for text, keep in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column(name).to_pylist(), strict=True):
                lines, kept = kept_lines(text, keep)
                n.append(len(lines))
                gone.append(len(lines) - len(kept))
                sha.append(hashlib.sha256(b"\n".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return marked.select("doc_id", "text", name).mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


ORACLE = f"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), lines AS (
  SELECT doc_id, i, parts[i] AS line,
         translate(trim(parts[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM split)
), common AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}
), marked AS (
  SELECT l.*, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM lines l LEFT JOIN common USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
