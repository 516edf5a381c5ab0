"""Token-ID / binary output: sequences materialised in training order.

Texts become token ids and are cut into sequences of ``stride`` tokens, the last
one ended by an end mark and padded.  Every sequence has a dense index: documents
stand in the order (block of the id, doc_id, text), blocks are counted first and
their starts summed, so indexes follow from counts alone.  A keyed Feistel network
with cycle walking permutes the indexes 0..N-1 onto themselves; the result is the
sequence's slot in the training order.  No sort and no random number decides it,
so a rerun, or a task repeated after a lost executor, writes the same bytes.
Slots are range-partitioned by number (the permutation makes them even, so the
ranges need no sampling) and each partition writes its shards in slot order:
a shard holds ``slots`` records of fixed stride, record k starts at byte
``(k - first_slot) * stride * width``, and a reader resumes from any slot.

Without a tokenizer the ids are UTF-8 bytes; END and PAD are byte values that
UTF-8 never uses.  With the path of a public tokenizer's vocabulary file ids
are little-endian unsigned 32-bit integers, END and PAD follow the vocabulary.

Defined cases: a null or empty text is one sequence that holds END alone; null
doc_ids and repeated rows each get their own sequences; an empty table gives no
shards; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.llm.common import cut, mix64, slices, text_key

STRIDE = 512
SLOTS = 2048
#: Blocks that documents are dealt to for counting: so many at least, and one for so many bytes of text; the driver holds one number for each.
BLOCKS, BLOCK_BYTES = 8192, 1 << 24
END, PAD = 0xFF, 0xFE
SHARDS = "shard long, first_slot long, n_slots int, doc_ids array<long>, parts array<int>, lengths array<int>, payload binary"


class Feistel:
    """A keyed permutation of 0..n-1."""

    def __init__(self, n: int, key: int, rounds: int = 6):
        self.n, self.half = n, max(1, ((n - 1).bit_length() + 1) // 2)
        self.keys = mix64(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))

    def _once(self, x: np.ndarray, keys: np.ndarray, back: bool) -> np.ndarray:
        half, low = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> half, x & low
        for key in keys:
            if back:
                left, right = right ^ (mix64(left + key) & low), left
            else:
                left, right = right, left ^ (mix64(right + key) & low)
        return left << half | right

    def _walk(self, x: np.ndarray, keys: np.ndarray, back: bool) -> np.ndarray:
        x = self._once(np.asarray(x, np.uint64), keys, back)
        while (out := np.flatnonzero(x >= self.n)).size:
            x[out] = self._once(x[out], keys, back)
        return x.astype(np.int64)

    def slot(self, index: np.ndarray) -> np.ndarray:
        return self._walk(index, self.keys, False)

    def index(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, self.keys[::-1], True)


def encoded(docs: DataFrame, tokenizer: str | None = None) -> tuple[DataFrame, int, int, int]:
    """((doc_id, text_key, ids binary), bytes an id, END, PAD)."""
    base = docs.select(F.col("doc_id").cast("long"), text_key().alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
    if tokenizer is None:
        return base.select("doc_id", "text_key", F.col("text").cast("binary").alias("ids")), 1, END, PAD
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(tokenizer)
    size, blob = vocabulary.get_vocab_size(), docs.sparkSession.sparkContext.broadcast(vocabulary.to_str())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = Tokenizer.from_str(blob.value)
        tok.encode_special_tokens = True  # their names in a text are ordinary text
        for batch in slices(batches):
            ids = [np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch(batch.column("text").to_pylist(), add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(ids, pa.binary())], ["doc_id", "text_key", "ids"])

    return cut(base.mapInArrow(run, "doc_id long, text_key long, ids binary")), 4, size, size + 1


def shards(docs: DataFrame, stride: int = STRIDE, slots: int = SLOTS, key: int = 20240229, tokenizer: str | None = None) -> DataFrame:
    """One row per shard, in slot order within and across partitions (columns: ``SHARDS``)."""
    spark = docs.sparkSession
    texts, width, end, pad = encoded(docs, tokenizer)
    blocks = max(BLOCKS, ceil((texts.agg(F.sum(F.octet_length("ids"))).first()[0] or 0) / BLOCK_BYTES))
    texts = texts.withColumn("block", F.pmod(F.xxhash64(F.coalesce("doc_id", "text_key")), F.lit(blocks)).cast("int"))
    pieces = F.floor(F.octet_length("ids") / width / stride).cast("long") + 1  # END always fits
    sizes = texts.groupBy("block").agg(F.sum(pieces).alias("n")).collect()
    starts = np.zeros(blocks + 1, np.int64)
    for row in sizes:
        starts[row.block + 1] = row.n
    starts = np.cumsum(starts)
    n = int(starts[-1])
    if not n:
        return spark.createDataFrame([], SHARDS)
    order, n_shards = Feistel(n, key), ceil(n / slots)
    mark = np.array([end], "<u4").tobytes()[:width]

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, at = -1, 0
        for batch in slices(batches, "ids"):
            where, docs_, parts, tokens = [], [], [], []
            for row, (own, ids) in enumerate(zip(batch.column("block").to_pylist(), batch.column("ids").to_pylist(), strict=True)):
                if own != block:
                    block, at = own, int(starts[own])
                ids = ids + mark
                step = stride * width
                count = ceil(len(ids) / step)
                where.append(np.arange(at, at + count))
                docs_.extend([row] * count)
                parts.extend(range(count))
                tokens.extend(ids[k : k + step] for k in range(0, len(ids), step))
                at += count
            slot = order.slot(np.concatenate(where))
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot // slots), pa.array(slot), batch.column("doc_id").take(pa.array(docs_)), pa.array(parts, pa.int32()), pa.array(tokens, pa.binary())], ["shard", "slot", "doc_id", "part", "tokens"]
            )

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, first = 0, None

        def flush() -> pa.RecordBatch:
            part = pa.Table.from_batches(held)
            slot = part.column("slot").to_numpy()
            if (slot != slot[0] + np.arange(len(slot))).any() or slot[0] % slots:
                raise ValueError(f"slots of shard {slot[0] // slots} aren't whole")
            room = np.full((len(slot), stride), pad, {1: "u1", 4: "<u4"}[width])
            lengths = []
            for k, x in enumerate(part.column("tokens").to_pylist()):
                ids = np.frombuffer(x, room.dtype)
                room[k, : len(ids)] = ids
                lengths.append(len(ids))
            lists = [[x] for x in (part.column("doc_id").to_pylist(), part.column("part").to_pylist(), lengths)]
            kinds = (pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.array([int(slot[0]) // slots]), pa.array([int(slot[0])]), pa.array([len(slot)], pa.int32()), *(pa.array(x, pa.list_(k)) for x, k in zip(lists, kinds, strict=True)), pa.array([room.tobytes()], pa.binary())],
                ["shard", "first_slot", "n_slots", "doc_ids", "parts", "lengths", "payload"],
            )

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                if first is None:
                    first = batch.column("slot")[at].as_py() // slots * slots
                left = min(slots, n - first) - rows
                piece = batch.slice(at, left)
                held.append(piece)
                rows, at = rows + piece.num_rows, at + piece.num_rows
                if rows == min(slots, n - first):
                    yield flush()
                    held, rows, first = [], 0, None
        if held:
            raise ValueError("a shard ends early")

    in_order = texts.repartition("block").sortWithinPartitions("block", "doc_id", "text_key")
    cells = in_order.select("block", "doc_id", "ids").mapInArrow(cut_up, "shard long, slot long, doc_id long, part int, tokens binary")
    # ranges of shards by number: about 64 MB each, and as many as the session's shuffles at least
    parts = min(n_shards, max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(n * stride * width / (64 << 20))))
    ranged = cells.repartitionById(parts, F.floor(F.col("shard") * parts / n_shards).cast("int")).sortWithinPartitions("slot")
    return ranged.select("slot", "doc_id", "part", "tokens").mapInArrow(assemble, SHARDS)


def read_from(spark: SparkSession, path: str, slot: int = 0, stride: int = STRIDE, slots: int = SLOTS, width: int = 1) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """Read written shards in training order from any slot: (slot, doc_id, part, token ids), one shard in memory at a time."""
    held = spark.read.parquet(path)
    last = held.agg(F.max("shard")).first()[0]
    for shard in range(slot // slots, -1 if last is None else last + 1):
        row = held.where(F.col("shard") == shard).first()
        ids = np.frombuffer(row.payload, {1: "u1", 4: "<u4"}[width]).reshape(row.n_slots, stride)
        for k in range(max(0, slot - row.first_slot), row.n_slots):
            yield row.first_slot + k, row.doc_ids[k], row.parts[k], ids[k, : row.lengths[k]]


def write_files(held: DataFrame, uri: str) -> DataFrame:
    """Write every shard's payload as ``shard-<number>.bin`` below a URI that all executors reach; (shard, file, bytes).

    A file is written under a task's own name and then moved, so a repeated task leaves whole files only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)
        store.create_dir(root, recursive=True)
        for batch in batches:
            names, sizes = [], []
            for shard, payload in zip(batch.column("shard").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                name, part = f"{root}/shard-{shard:010d}.bin", f"{root}/.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(payload)
                store.move(part, name)
                names.append(name.rpartition("/")[2])
                sizes.append(len(payload))
            yield pa.RecordBatch.from_arrays([batch.column("shard"), pa.array(names), pa.array(sizes, pa.int64())], ["shard", "file", "bytes"])

    return held.select("shard", "payload").mapInArrow(run, "shard long, file string, bytes long")
