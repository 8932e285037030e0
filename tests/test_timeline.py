import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.operators import ledger, timeline


def brute(rows):
    listed, per, got = {}, {}, {}
    for g, c, d in rows:
        m = d.year * 12 + d.month - 1
        listed.setdefault(g, set()).add(m)
        per[g, m] = per.get((g, m), 0) + 1
        got.setdefault((g, c), []).append(m)
    first, out = min(min(v) for v in listed.values()), []
    for (g, c), ms in got.items():
        start, mine = min(ms), sorted(listed[g])
        before, after = [m for m in mine if m < start], [m for m in mine if m >= start]
        rows_before = sum(per[g, m] for m in before)
        share = len(ms) / sum(per[g, m] for m in mine)
        debut, held = min(min(x) for (_, k), x in got.items() if k == c), sum(k == c for _, k in got)
        if len(before) >= 3 and len(after) >= 3 and len(ms) >= 5 and len(set(ms)) >= 0.8 * len(after) and (1 - share) ** rows_before <= 0.01 / len(got) and not (debut - first >= 3 and held >= 2):
            out.append((g, c, f"{start // 12}-{start % 12 + 1:02d}", len(before), len(ms)))
    return sorted(out)


def test_onsets_are_brute_force(spark):
    rng, rows = random.Random(11), []
    for m in range(14):
        for g in ("a", "b", "c", "d"):
            for _ in range(rng.randrange(8, 20)):
                rows.append((g, rng.choice(["x", "y"]), dt.datetime(2023 + m // 12, m % 12 + 1, rng.randrange(1, 28))))
            if g == "a" and m >= 5:
                rows += [(g, "fee", dt.datetime(2023 + m // 12, m % 12 + 1, 3))] * 3  # one group, from a month on
            if g in "bc" and m >= 6:
                rows += [(g, "new", dt.datetime(2023 + m // 12, m % 12 + 1, 4))] * 3  # of the whole table
            if g == "d" and m in (4, 9, 13):
                rows += [(g, "odd", dt.datetime(2023 + m // 12, m % 12 + 1, 5))] * 3  # not steady
    df = spark.createDataFrame(rows, "grp string, code string, day timestamp")
    assert brute(rows) == [("a", "fee", "2023-06", 5, 27)]
    assert sorted(tuple(r) for r in timeline.steady_onsets(df, "grp", "code", "day").collect()) == brute(rows)
    assert timeline.steady_onsets(df.limit(0), "grp", "code", "day").collect() == []


def test_off_cycle_code(spark):
    rows = [(i % 10 == 0, "manual" if i % 10 == 0 and i != 50 else "batch", "n", i) for i in range(200)]
    df = spark.createDataFrame(rows, "off boolean, kind string, only string, id int")
    assert [tuple(r) for r in timeline.off_cycle_code(df, F.col("off"), ["only", "id", "kind"]).collect()] == [("kind", "manual", 19, 0)]
    assert timeline.off_cycle_code(df.filter("not off"), F.col("off"), ["kind"]).collect() == [] and timeline.off_cycle_code(df.limit(0), F.col("off"), ["kind"]).collect() == []


def test_contra_lines(spark):
    rows = [("Rent", 5.0, None, "x")] * 30 + [("rent ", None, 5.0, "REV: x")] * 3 + [("Bank", 1.0, 0.0, "x")] * 20 + [("Bank", 0.0, 1.0, "x")] * 20 + [("Sales", None, 7.0, "x")] * 25 + [("Sales", 7.0, None, "x")] + [(None, 1.0, None, "x"), ("Rent", 0.0, None, "x")]
    df = spark.createDataFrame(rows, "account string, debit double, credit double, memo string")
    side = spark.createDataFrame([("RENT", "Debit"), ("Sales", "credit"), ("Bank", "debit")], "key string, side string")
    args = (df, "account", "debit", "credit")
    assert ledger.contra_lines(*args).collect() == []
    assert {(r["account"], r["usual_side"]) for r in ledger.contra_lines(*args, marked=F.col("memo").startswith("REV")).collect()} == {("rent ", "debit")}
    assert sorted(r["account"] for r in ledger.contra_lines(*args, lookup=side).collect()) == ["Sales", "rent ", "rent ", "rent "]
    assert ledger.contra_lines(df.filter("account = 'Sales'"), "account", "debit", "credit", lookup=side).collect() == []  # one is too few
    assert ledger.contra_lines(df.limit(0), "account", "debit", "credit", lookup=side).collect() == []
