"""Checks of ledger lines within their documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.keys import norm_key

LEAST_RECORDS, HITS, CENT = 20, 0.9, 0.011


def fixed_ratio(lines: DataFrame, document: str, category: str, amount: str, least: int = LEAST_RECORDS) -> DataFrame:
    """Categories whose line is one rate, at most a half, of the other lines of its document: ``category, rate,
    n_records, n_hits``.

    A record is a line whose category its document has once, and the sum of the document's other lines of the same
    sign. The rate is the upper median of amount by sum, to four or five places, whichever hits more records to the
    cent (four if both hit alike); nine tenths of at least ``least`` records must be hit. Lines without a document,
    category or amount, and documents of one line or without others of the sign, don't count. Documents are summed
    before anything is joined; a median is read from the counts of at most 100,002 ratios of a category.
    """
    kinds = dict(lines.dtypes)
    l = lines.select(norm_key(F.col(document), kinds[document]).alias("doc"), norm_key(F.col(category), kinds[category]).alias("cat"), F.col(amount).cast("double").alias("v"))
    l = l.filter("doc is not null and cat is not null and v <> 0 and not isnan(v)")
    per = l.groupBy("doc", F.signum("v").alias("sign"), "cat").agg(F.sum("v").alias("v"), F.count("*").alias("n"))
    # a document has as many rows left as categories
    doc = per.groupBy("doc", "sign").agg(F.sum("v").alias("all"), F.collect_list(F.when(F.col("n") == 1, F.struct("cat", "v"))).alias("once"))
    records = doc.select("all", F.inline("once")).select("cat", "v", F.round(F.col("all") - F.col("v"), 2).alias("d")).filter("d <> 0")
    at = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(F.col("v") / F.col("d"), 5)))
    counts = records.groupBy("cat", at.alias("ratio")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("cat")
    counts = counts.withColumns({"below": F.sum("n").over(w.orderBy("ratio")), "n_records": F.sum("n").over(w)})
    middle = counts.filter((F.col("below") > F.floor(F.col("n_records") / 2)) & (F.col("n_records") >= least)).groupBy("cat", "n_records").agg(F.min("ratio").alias("r5"))
    rates = middle.filter("r5 > 0 and r5 <= 0.5").withColumn("r4", F.round("r5", 4))
    hit = records.join(rates, "cat").groupBy("cat", "n_records", "r4", "r5").agg(*(F.count_if(F.abs(F.col("v") - F.round(F.col("d") * F.col(r), 2)) <= CENT).alias(f"h{r}") for r in ("r4", "r5")))
    four = F.col("hr4") >= F.col("hr5")
    out = hit.select(F.col("cat").alias("category"), F.when(four, F.col("r4")).otherwise(F.col("r5")).alias("rate"), "n_records", F.greatest("hr4", "hr5").alias("n_hits"))
    return out.filter((F.col("n_hits") >= HITS * F.col("n_records")) & (F.col("rate") > 0))


def contra_lines(df: DataFrame, key: str, debit: str, credit: str, lookup: DataFrame | None = None, marked: Column | None = None, usual: float = 0.8, least: int = 5, rare: float = 0.1, rare_lines: int = 20, found: int = 3) -> DataFrame:
    """All columns of lines on the side opposite their key's usual one, with ``usual_side``; none if there are fewer than ``found``.

    A line's side is debit if that isn't zero, else credit. The usual side is what ``lookup`` (``key, side``) says, else that of most of the
    key's lines (debit, if they are as many); a key counts if ``usual`` of its ``least`` lines or more keep to it. Lines are kept if
    ``marked`` holds for them; without a mark only a lookup is enough, and then only for keys of ``rare_lines`` lines or more of which
    ``rare`` at most are opposite. Keys are compared by the common equality; lines without a key or an amount have no side.
    """
    kinds = dict(df.dtypes)
    side = F.when(F.coalesce(F.col(debit), F.lit(0)) != 0, "debit").when(F.coalesce(F.col(credit), F.lit(0)) != 0, "credit")
    lines = df.select("*", norm_key(F.col(key), kinds[key]).cast("string").alias("_key"), side.alias("_side"))
    per = lines.filter("_key is not null and _side is not null").groupBy("_key").agg(F.count_if(F.col("_side") == "debit").alias("_d"), F.count_if(F.col("_side") == "credit").alias("_c"))
    most = F.when(F.col("_d") >= F.col("_c"), "debit").otherwise("credit")
    if lookup is not None:
        given = lookup.select(norm_key(F.col("key"), dict(lookup.dtypes)["key"]).cast("string").alias("_key"), F.lower(F.trim("side")).alias("_given")).filter("_key is not null").groupBy("_key").agg(F.min("_given").alias("_given"))
        per, most = per.join(given, "_key", "left").filter("_given in ('debit', 'credit')"), F.col("_given")
    per = per.withColumn("usual_side", most).withColumn("_n", F.col("_d") + F.col("_c")).withColumn("_own", F.when(F.col("usual_side") == "debit", F.col("_d")).otherwise(F.col("_c")))
    per = per.filter((F.col("_own") >= usual * F.col("_n")) & (F.col("_n") >= least))
    if marked is None and lookup is None:
        per = per.limit(0)
    elif marked is None:
        per = per.filter((F.col("_n") >= rare_lines) & (F.col("_n") - F.col("_own") <= rare * F.col("_n")))
    hit = lines.join(per.select("_key", "usual_side"), "_key").filter(F.col("_side") != F.col("usual_side"))
    if marked is not None:
        hit = hit.filter(F.coalesce(marked, F.lit(False)))
    few = hit.agg(F.count("*").alias("_found")).filter(F.col("_found") >= found)
    return hit.join(F.broadcast(few)).select(*df.columns, "usual_side")
