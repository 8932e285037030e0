"""Total rows that no label gives away: rows whose amounts are the sum of those above them.

Running sums of a sheet are made in chunks, so a long sheet is many tasks. What crosses rows is small: only rows that
could be totals, starts of stacked parts and labelled totals are walked through in order, with the sums at
the last break; what a total row itself added is taken out again.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scratch import staged
from tidemark.operators.tables import is_total_label

CHUNK, LEAST = 65_536, 3
CENT, CLOSE = Decimal("0.01"), Decimal("0.005")
_SUM = "decimal(38,8)"


def _walk(k: int):
    """Over a sheet's events in order: the rows that are totals, of a part or of all rows so far."""
    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        removed, base = [Decimal(0)] * k, [Decimal(0)] * k
        removed_n, base_n, parts, last = 0, 0, 0, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if last is not None and r["at"] <= last:
                    raise RuntimeError("events of a sheet are out of order")
                last = r["at"]
                grand = [r[f"p{i}"] - removed[i] for i in range(k)]
                n = r["before"] - removed_n
                if r["is_start"] or r["is_label"]:
                    base, base_n, parts = grand, n, parts + 1
                if not r["may"] or n - base_n < LEAST:
                    continue
                own = [(i, r[f"v{i}"]) for i in range(k) if r[f"v{i}"] is not None]
                kind = "part" if _adds_up(own, [g - b for g, b in zip(grand, base, strict=True)], r["cents"]) else "all" if parts and _adds_up(own, grand, r["cents"]) else None
                if kind:
                    for i, v in own:
                        removed[i] += v
                    removed_n, base, base_n, parts = removed_n + 1, grand, n, parts + 1
                    out.append((last, kind, n))
            yield pa.RecordBatch.from_arrays([*(pa.array([x.as_py()] * len(out), x.type) for x in key), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string())], names=[*(f"_s{i}" for i in range(len(key))), "_at", "kind"])
    return run


def _adds_up(own: list, sums: list, cents: list) -> bool:
    if any(cents):
        return any(cents[i] and v != 0 and abs(v - sums[i]) <= CENT for i, v in own)
    return bool(own) and all(abs(v - sums[i]) < CLOSE for i, v in own) and any(v != 0 for _, v in own)


def sum_totals(rows: DataFrame, sheet: list[str], position: str, guards: list[str], amounts: list[str], start: Column | None = None, labelled: Column | None = None) -> DataFrame:
    """``sheet..., position, kind`` of rows that are sums: ``part`` of the rows since the last break, ``all`` of those since the first row.

    A row may be a total if its ``guards`` (ids and dates) are blank or name a total, it has an amount, and three rows or more
    stand between it and the last break. Breaks are total rows, rows of ``start`` (a stacked part's first) and ``labelled``
    rows, which are known totals and no rows themselves. If a sheet has columns with cents, one of those must equal its sum
    within a cent; else every amount must. Null amounts are none; positions are whole and different in a sheet; sheets
    of fewer than four rows have no totals; amounts count to eight decimals.
    """
    keys, k = [f"_s{i}" for i in range(len(sheet))], len(amounts)
    blank = F.lit(True)
    for g in guards:
        text = F.trim(F.col(g).cast("string"))
        blank = blank & (F.col(g).isNull() | (text == "") | is_total_label(text))
    values = [F.expr(f"try_cast(`{a}` as {_SUM})").alias(f"v{i}") for i, a in enumerate(amounts)]
    no = F.lit(False)
    base = rows.select(*(F.col(s).alias(x) for s, x in zip(sheet, keys, strict=True)), F.col(position).cast("long").alias("at"), blank.alias("blank"), F.coalesce(start if start is not None else no, no).alias("is_start"),
                       F.coalesce(labelled if labelled is not None else no, no).alias("is_label"), *values)
    base = staged(base.withColumn("chunk", F.floor(F.col("at") / CHUNK)), "rows")
    none = F.lit(0).cast(_SUM)
    held = [F.when(F.col("is_label"), none).otherwise(F.coalesce(f"v{i}", none)) for i in range(k)]
    one = F.when(F.col("is_label"), 0).otherwise(1).cast("long")
    facts = base.groupBy(*keys).agg(F.array(*(F.coalesce(F.max(F.when(~F.col("is_label"), F.col(f"v{i}") % 1 != 0)), no) for i in range(k))).alias("cents"), F.sum(one).alias("rows")).filter("rows >= 4")
    chunks = base.groupBy(*keys, "chunk").agg(F.sum(one).alias("n"), *(F.sum(h).cast(_SUM).alias(f"c{i}") for i, h in enumerate(held)))
    above = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # one row a chunk
    chunks = chunks.select(*(F.col(x).alias(f"_{x}") for x in keys), F.col("chunk").alias("_chunk"), F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n0"), *(F.coalesce(F.sum(f"c{i}").over(above).cast(_SUM), none).alias(f"c{i}") for i in range(k)))
    within = Window.partitionBy(*keys, "chunk").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    run = base.withColumns({"before": F.coalesce(F.sum(one).over(within), F.lit(0)), **{f"p{i}": F.coalesce(F.sum(h).over(within).cast(_SUM), none) for i, h in enumerate(held)}})
    may = F.col("blank") & ~F.col("is_label") & F.coalesce(*(F.col(f"v{i}") for i in range(k))).isNotNull()
    events = run.withColumn("may", may).filter("may or is_start or is_label")
    same = F.col("chunk") == F.col("_chunk")
    for x in keys:
        same = same & F.col(x).eqNullSafe(F.col(f"_{x}"))
    events = events.join(chunks, same).withColumns({"before": F.col("before") + F.col("n0"), **{f"p{i}": (F.col(f"p{i}") + F.col(f"c{i}")).cast(_SUM) for i in range(k)}})
    known = F.lit(True)
    facts = facts.select(*(F.col(x).alias(f"_{x}_") for x in keys), "cents")
    for x in keys:
        known = known & F.col(x).eqNullSafe(F.col(f"_{x}_"))
    events = events.join(facts, known).select(*keys, "at", "before", "is_start", "is_label", "may", "cents", *(f"p{i}" for i in range(k)), *(f"v{i}" for i in range(k)))
    types = dict(base.dtypes)
    schema = ", ".join(f"{x} {types[x]}" for x in keys) + ", _at long, kind string"
    found = events.repartition(*keys).sortWithinPartitions(*keys, "at").groupBy(*keys).applyInArrow(_walk(k), schema)
    return found.select(*(F.col(x).alias(s) for s, x in zip(sheet, keys, strict=True)), F.col("_at").alias(position), "kind")
