"""Packing by first-fit decreasing with a tournament tree of bin capacities.

Documents are encoded, cut into pieces of at most ``capacity`` ids, and dealt at random into groups
of about ``group_docs`` documents; each group is packed on its own. Only lengths and checksums are
shuffled (the ids too if they are asked for), and a group's size doesn't depend on the table's.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_slices
from tidemark.llm.tokens import encoder, vocabulary

CAPACITY, END_ID, GROUP_DOCS = 4096, 2, 2048
VOCABULARY = "word_bpe_49k.json"


class CapacityTree:
    """A tournament over bins: each inner node holds the larger free capacity of its two sides,
    so the first bin with room for a piece is found by going down once."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.free = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        free, at = self.free, 1
        while at < self.leaves:
            at *= 2
            if free[at] < size:
                at += 1
        free[at] -= size
        leaf = at - self.leaves
        while at > 1:
            at //= 2
            top = max(free[2 * at], free[2 * at + 1])
            if free[at] == top:
                break
            free[at] = top
        return leaf


def first_fit_decreasing(sizes, capacity: int = CAPACITY) -> tuple[list[int], list[int]]:
    """For each piece its bin and its offset there. No piece may be larger than ``capacity``;
    equal sizes are placed in the given order. An empty list gives two empty lists."""
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    tree, filled = CapacityTree(max(1, len(sizes)), capacity), {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        k = tree.place(sizes[i])
        bins[i], offsets[i] = k, filled.get(k, 0)
        filled[k] = offsets[i] + sizes[i]
    return bins, offsets


def _cut(path: str, end_id: int, capacity: int, groups: int, with_ids: bool):
    def run(batches):
        enc, end, times, task = encoder(path), np.array([end_id], "<u4"), Counter(), TaskContext.get().partitionId()
        for b in batches:
            for a, z in text_slices(b.column(1)):
                part = b.slice(a, z - a)
                out: list[tuple] = []
                pieces: list[np.ndarray] = []
                for doc_id, ids in zip(part.column(0).to_pylist(), enc.encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    ids = np.concatenate([ids, end])
                    # equal rows are parted by how often the task has had them, whatever the order of its rows
                    own = (doc_id, len(ids), zlib.crc32(ids.tobytes()))
                    own, times[own] = f"{own}:{times[own]}:{task}", times[own] + 1
                    for at in range(0, len(ids), capacity):
                        piece = ids[at : at + capacity]
                        crc = zlib.crc32(piece.tobytes())
                        # whole sequences need no other piece, so they are dealt one by one
                        group = zlib.crc32((f"{own}:{at}" if len(piece) == capacity else own).encode()) % groups
                        out.append((doc_id, at, len(piece), crc, len(ids), group))
                        if with_ids:
                            pieces.append(piece)
                cols = list(zip(*out, strict=True))
                arrays = [pa.array(cols[0], part.column(0).type), *(pa.array(c, pa.int64()) for c in cols[1:])]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "grp"]
                if with_ids:
                    arrays.append(pa.array([_short(p) for p in pieces], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)
    return run


def _short(ids: np.ndarray) -> bytes:
    """Ids in two bytes each if they fit, else in four, with that size before them: they are shuffled so."""
    size = 2 if int(ids.max()) < 1 << 16 else 4
    return bytes([size]) + ids.astype(f"<u{size}").tobytes()


def _lists(column: pa.ChunkedArray) -> pa.ListArray:
    parts = [np.frombuffer(x, f"<u{x[0]}", offset=1).astype(np.int32) for x in column.to_pylist()]
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, parts)], dtype=np.int32), np.concatenate(parts))


def _pack(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pa.Table.from_batches(list(batches))
        keys = [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")]
        order = pc.sort_indices(pieces, sort_keys=keys).to_numpy()
        placed = first_fit_decreasing(pieces["length"].to_numpy()[order].tolist(), capacity)
        # only the places are computed; rows stay where they are, and ids become integers a few rows at a time
        bins, offsets = (np.empty(len(order), np.int64) for _ in placed)
        bins[order], offsets[order] = placed
        bins += pieces["grp"][0].as_py() << 32
        out = pieces.drop_columns("grp").append_column("sequence_id", pa.array(bins)).append_column("offset", pa.array(offsets))
        for at in range(0, len(out), 128):
            part = out.slice(at, 128)
            if "ids" in part.column_names:
                part = part.set_column(part.column_names.index("ids"), "ids", _lists(part["ids"]))
            yield from part.combine_chunks().to_batches()
    return run


def pack_documents(docs: DataFrame, tokenizer: str = VOCABULARY, end_id: int = END_ID, capacity: int = CAPACITY,
                   group_docs: int = GROUP_DOCS, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    A document is its whole text's ids and ``end_id``; a null or empty text is ``end_id`` alone. Each
    id lies in exactly one piece; a document longer than ``capacity`` fills whole sequences and leaves
    one remainder. Repeated rows and null doc_ids are packed as documents of their own; other columns
    are ignored; an empty table gives no rows. ``sequence_id`` is unique over all groups.
    """
    groups = max(1, -(-docs.count() // group_docs))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    cols = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long"
    more = ", ids array<int>" if with_ids else ""
    packed = ", ids binary" if with_ids else ""
    pieces = docs.select("doc_id", "text").mapInArrow(_cut(vocabulary(tokenizer), end_id, capacity, groups, with_ids), f"{cols}, grp long{packed}")
    return pieces.groupBy("grp").applyInArrow(_pack(capacity), f"{cols}{more}, sequence_id long, offset long")


def padding_share(packed: DataFrame, capacity: int = CAPACITY) -> float:
    """Padding by all positions, where a sequence whose length is a power of two needs none."""
    s = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    full = F.when(F.expr("(n & (n - 1)) = 0"), F.col("n")).otherwise(capacity)
    r = s.agg(F.sum(full).alias("all"), F.sum("n").alias("n")).first()
    return 1 - r["n"] / r["all"] if r["all"] else 0.0


def op6_pack(spark, sf_dir: str) -> DataFrame:
    """Each piece's place in its document and its sequence."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
