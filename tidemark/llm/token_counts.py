"""Token counts by an exact histogram of encoded lengths and its suffix sums."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import staged, text_slices
from tidemark.llm.tokens import encoder, vocabulary

VOCABULARY = "byte_bpe_50k.json"
BLOCK = 1024  # lengths that one window task sums


def _lengths(path: str):
    def run(batches):
        enc = encoder(path)
        for b in batches:
            for a, z in text_slices(b.column(0)):
                n = [len(x) for x in enc.encode([t or "" for t in b.column(0).slice(a, z - a).to_pylist()])]
                length, count = np.unique(np.array(n, np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(length), pa.array(count.astype(np.int64))], names=["length", "n_docs"])
    return run


def length_histogram(docs: DataFrame, tokenizer: str = VOCABULARY) -> DataFrame:
    """``length, n_docs``: how many documents have each encoded length (null and empty texts: 0).

    Lengths are counted in each task before they are shuffled, so a hot length is one row a task.
    """
    return docs.select("text").mapInArrow(_lengths(vocabulary(tokenizer)), "length long, n_docs long").groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """Per length: ``docs_at_least``, ``tokens_at_least`` (of documents that long or longer),
    ``docs_at_most``, ``tokens_total`` and ``truncated_tokens`` (the sum of min(length, this length)).

    Sums run within blocks of lengths and then over the few blocks, never over all rows in one task.
    An empty histogram gives no rows.
    """
    h = histogram.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("t"), F.floor(F.col("length") / BLOCK).alias("block"))
    own = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("bn"), F.sum("t").alias("bt"))
    later = blocks.select("block", F.coalesce(F.sum("bn").over(down), F.lit(0)).alias("an"), F.coalesce(F.sum("bt").over(down), F.lit(0)).alias("at"))
    total = blocks.agg(F.sum("bn").alias("alln"), F.sum("bt").alias("allt"))
    out = h.withColumns({"sn": F.sum("n_docs").over(own), "st": F.sum("t").over(own)}).join(later, "block").join(F.broadcast(total))
    at_least, tokens = F.col("sn") + F.col("an"), F.col("st") + F.col("at")
    return out.select(
        "length", "n_docs", at_least.alias("docs_at_least"), tokens.alias("tokens_at_least"),
        (F.col("alln") - at_least + F.col("n_docs")).alias("docs_at_most"), F.col("allt").alias("tokens_total"),
        (F.col("allt") - tokens + F.col("length") * at_least).alias("truncated_tokens"))


def truncated_total(sums: DataFrame, limit: int) -> int:
    """Tokens kept if each document is cut to ``limit``: the shorter ones whole, the others ``limit`` each."""
    r = sums.filter(F.col("length") >= limit).agg(F.max("tokens_at_least").alias("t"), F.max("docs_at_least").alias("n")).first()
    total = sums.agg(F.max("tokens_total")).first()[0] or 0
    return total - (r["t"] or 0) + limit * (r["n"] or 0)


def length_quantile(sums: DataFrame, q: float) -> int | None:
    """The smallest length that at least the share ``q`` of the documents doesn't exceed; None without documents."""
    n = sums.agg(F.sum("n_docs")).first()[0]
    return None if not n else sums.filter(F.col("docs_at_most") >= q * n).agg(F.min("length")).first()[0]


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    """Totals, quantiles and truncated totals of the documents' encoded lengths."""
    return suffix_sums(staged(length_histogram(spark.read.parquet(f"{sf_dir}/documents.parquet")), "lengths"))
