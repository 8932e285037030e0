import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import totals

SCHEMA = "sheet string, r long, id string, amount double, qty double, starts boolean, total boolean, at string"


def brute(rows, cents):
    """One row after another, as a reader would."""
    out = []
    for sheet in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == sheet), key=lambda r: r[1])
        if sum(not r[6] for r in own) < 4:
            continue
        part, every, n, parts, pending = [0, 0], [0, 0], 0, 0, False
        for _, r, label, *vals, start, total, _ in own:
            if total:
                pending = True
                continue
            if start or pending:
                part, n, parts, pending = [0, 0], 0, parts + 1, False
            may = (label is None or label.strip() == "" or label.lower().startswith("total")) and any(v is not None for v in vals)
            def fits(sums):
                got = [(v, s, c) for v, s, c in zip(vals, sums, cents, strict=True) if v is not None]  # noqa: B023
                if any(cents):
                    return any(c and v != 0 and abs(v - s) <= 0.01 + 1e-9 for v, s, c in got)
                return all(abs(v - s) < 0.005 for v, s, c in got) and any(v for v, _, _ in got)
            if may and n >= 3 and (fits(part) or (parts and fits(every))):
                out.append((sheet, r, "part" if fits(part) else "all"))
                part, n, parts = [0, 0], 0, parts + 1
                continue
            part = [p + (v or 0) for p, v in zip(part, vals, strict=True)]
            every = [p + (v or 0) for p, v in zip(every, vals, strict=True)]
            n += 1
    return sorted(out)


def blocks(rng, sheet, count, cents=True, labels=False):
    rows, r, every = [], 0, [0.0, 0.0]
    for _ in range(count):
        r += rng.randrange(1, 3)
        own = [(round(rng.randrange(1, 5000) / (100 if cents else 1), 2) if cents else float(rng.randrange(1, 90)), float(rng.randrange(1, 9))) for _ in range(rng.randrange(2, 7))]
        begins = rng.random() < 0.5
        for i, (a, q) in enumerate(own):
            rows.append((sheet, r, rng.choice(["x1", "x2", None]), a, q, begins and i == 0, False, "c"))
            r += 1
        s = [round(sum(a for a, _ in own), 2), sum(q for _, q in own)]
        every = [e + x for e, x in zip(every, s, strict=True)]
        if rng.random() < 0.7:
            rows.append((sheet, r, rng.choice([None, " ", "Total", None, "Depot"]), s[0] + rng.choice([0, 0, 0, 5]), s[1] if rng.random() < 0.8 else None, False, labels and rng.random() < 0.3, "c"))
            r += 1
    rows.append((sheet, r, None, round(every[0], 2), every[1], False, False, "c"))
    return rows


@pytest.mark.parametrize("chunk", [totals.CHUNK, 7], ids=["one chunk", "many chunks"])
@pytest.mark.parametrize("cents", [True, False], ids=["cents", "whole"])
def test_totals_are_brute_force(spark, monkeypatch, cents, chunk):
    monkeypatch.setattr(totals, "CHUNK", chunk)
    rng = random.Random(7)
    rows = [r for s in range(5) for r in blocks(rng, f"s{s}", 24, cents, labels=s % 2 == 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = totals.sum_totals(df, ["sheet"], "r", ["id"], ["amount", "qty"], F.col("starts"), F.col("total")).collect()
    want = brute(rows, (cents, False))
    assert sorted(tuple(r) for r in got) == want and len(want) > 20


def test_fifty_blocks_whatever_their_label(spark):
    rows, r = [], 0
    for b in range(50):
        for i in range(4):
            rows.append(("s", r, f"id{i}", 1.25 + b, 1.0, False, False, "c"))
            r += 1
        rows.append(("s", r, None, 4 * (1.25 + b), None, False, False, "c"))
        r += 1
    got = totals.sum_totals(spark.createDataFrame(rows, SCHEMA), ["sheet"], "r", ["id"], ["amount", "qty"])
    assert sorted(x["r"] for x in got.collect()) == [5 * b + 4 for b in range(50)]


def test_rows_with_ids_small_and_empty_sheets(spark):
    rows = [("s", i, "k", 1.5, 1.0, False, False, "c") for i in range(4)] + [("s", 4, "k", 6.0, 4.0, False, False, "c"), ("t", 0, "a", 1.5, 1.0, False, False, "c"), ("t", 1, None, 1.5, 1.0, False, False, "c")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert totals.sum_totals(df, ["sheet"], "r", ["id"], ["amount", "qty"]).collect() == []
    assert totals.sum_totals(df.limit(0), ["sheet"], "r", ["id"], ["amount"]).collect() == []
    nulls = df.withColumn("sheet", F.lit(None).cast("string")).withColumn("id", F.when(F.col("r") < 4, F.col("id")))
    assert [(r["sheet"], r["r"]) for r in totals.sum_totals(nulls.filter("at = 'c'").filter("r <> 0 or amount = 1.5").dropDuplicates(["r"]), ["sheet"], "r", ["id"], ["amount"]).collect()] == [(None, 4)]
