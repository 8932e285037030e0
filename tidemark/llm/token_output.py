"""Token ids as ORC files: run-length encoded integers, row indexes, Bloom filters on document ids."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import scratch_path, staged, text_slices
from tidemark.llm.tokens import encoder, vocabulary

VOCABULARY, END_ID = "byte_bpe_50k.json", 0
FILE_DOCS = 50_000  # documents a file at most, about
_FILE = "part int, doc_id long, ids array<int>"


class Turns:
    """A number for each row that spreads equal rows and doesn't depend on the order of a task's rows."""

    def __init__(self):
        self.times = Counter()

    def __call__(self, ids: np.ndarray) -> int:
        own = zlib.crc32(ids.tobytes())
        self.times[own] += 1
        return own + self.times[own]


def _encode(path: str, end_id: int, bounds: list[int]):
    """Rows of a file: its number by the document's place among ``bounds``. A document id that is a
    bound itself may go to either side, so even one id of many rows spreads over the files between."""
    def run(batches):
        enc, end, edges, turn = encoder(path), np.array([end_id], "<u4"), np.array(bounds, np.int64), Turns()
        for b in batches:
            for a, z in text_slices(b.column(1)):
                part = b.slice(a, z - a)
                ids = [np.concatenate([x, end]) for x in enc.encode([t or "" for t in part.column(1).to_pylist()])]
                doc = part.column(0)
                known = doc.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
                low, high = np.searchsorted(edges, known, "left"), np.searchsorted(edges, known, "right")
                file = [lo if lo == hi else lo + turn(x) % (hi - lo + 1) for x, lo, hi in zip(ids, low.tolist(), high.tolist(), strict=True)]
                sizes = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                values = pa.array(np.concatenate(ids).view("<i4"), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(file, pa.int32()), doc, pa.ListArray.from_arrays(pa.array(sizes), values)], names=["part", "doc_id", "ids"])
    return run


def write_token_ids(docs: DataFrame, path: str, tokenizer: str = VOCABULARY, end_id: int = END_ID, file_docs: int = FILE_DOCS) -> int:
    """Write one row per document, in ascending doc_id order over the numbered files; the number of files.

    Whole texts are encoded (null: empty) and get ``end_id``. A null doc_id comes first; repeated rows
    are all written; other columns are ignored; an empty table writes an empty file. The files' bounds
    are quantiles of doc_id, read without the texts; ids go once through a shuffle.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    files = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // file_docs))
    bounds = docs.approxQuantile("doc_id", [i / files for i in range(1, files)], 0.1 / files) if files > 1 else []
    rows = docs.mapInArrow(_encode(vocabulary(tokenizer), end_id, [int(b) for b in bounds]), _FILE)
    (rows.repartitionById(files, "part").sortWithinPartitions("part", "doc_id").write
     .option("orc.bloom.filter.columns", "doc_id").option("orc.create.index", "true").option("orc.row.index.stride", "1000")
     .option("orc.stripe.size", str(16 << 20)).orc(path))
    return files


def read_token_ids(spark: SparkSession, path: str, doc_ids=None) -> DataFrame:
    """The files' rows; stripes are read in parallel. With ``doc_ids`` the filter reaches the reader,
    which skips stripes and row groups by their minima, maxima and Bloom filters."""
    rows = spark.read.schema(_FILE).orc(path)
    return rows if doc_ids is None else rows.filter(F.col("doc_id").isin(list(doc_ids)))


def _digest(batches):
    for b in batches:
        lists = b.column(2)
        values, edges = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        sizes = np.diff(edges)
        crc = [zlib.crc32(values[a:z].astype("<i4", copy=False)) for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes.astype(np.int64)), pa.array(crc, pa.int64())], names=["part", "doc_id", "n_tokens", "ids_crc32"])


def token_index(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of rows read from the files: ``start`` counts the ids of all
    documents before. Sums run within each file and then over the few files."""
    d = staged(files.mapInArrow(_digest, "part int, doc_id long, n_tokens long, ids_crc32 long"), "digest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = d.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("part").orderBy("doc_id", "n_tokens", "ids_crc32").rowsBetween(Window.unboundedPreceding, 0)
    return (d.withColumn("upto", F.sum("n_tokens").over(own)).join(base, "part")
            .select("doc_id", (F.col("base") + F.col("upto") - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32"))


def op8_token_output(spark, sf_dir: str) -> DataFrame:
    """Each document's place, length and checksum, read back from the files."""
    path = scratch_path(spark, "tokens")
    write_token_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return token_index(read_token_ids(spark, path))
