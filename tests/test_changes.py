import datetime as dt
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.operators import changes

START = dt.date(2023, 1, 1)
SCHEMA = "day timestamp, site string, code string, person string, amount double, fee double, n int, switch string"


def table(days=400, rows=1200, change=200, planted=True, seed=1):
    """Sites A* hand over to B* at ``change``; IDs and names are written another way; the sign of amounts flips."""
    rng, out = random.Random(seed), []
    for i in range(rows):
        d = i * days // rows
        late = planted and d >= change
        k = rng.randrange(3)
        site = f"{'New' if late else 'Old'} site {'xyz'[k]}"
        code = f"{'B-' if late else 'A'}{rng.randrange(1000, 9999)}"
        person = ["Smith, Jo", "Doe, Ann", "Ray, Bo"][k] if late else ["Jo Smith", "Ann Doe", "Bo Ray"][k]
        amount = float(rng.randrange(1, 90)) * (-1 if late else 1)
        out.append((dt.datetime.combine(START + dt.timedelta(days=d), dt.time(5)), site, code, person, amount, float(rng.choice([1, 2, 3])) if not late else rng.random() * 100, k, "same"))
    return out


def brute_successions(hist, need, span):
    groups = defaultdict(lambda: defaultdict(list))
    for c, view, v, d, n in hist:
        groups[c, view][v] += [d] * n
    out = []
    for (c, view), values in groups.items():
        info = {}
        for v, ds in values.items():
            ds.sort()
            cut = int(0.03 * len(ds))
            s, e = ds[cut], ds[-1 - cut]
            if len(ds) >= need and e - s >= 0.1 * span:
                info[v] = (s, e, ds)
        for a, (sa, ea, da) in info.items():
            for b, (sb, eb, db) in info.items():
                if a != b and sb > sa and eb > ea and max(0, ea - sb) <= 0.15 * span and db[0] - da[-1] <= 14:
                    cost = {d: sum(x >= d for x in da) + sum(x < d for x in db) for d in set(db)}
                    out.append((c, view, a, b, min(cost, key=lambda d: (cost[d], d))))
    return sorted(out)


def test_successions_are_brute_force(spark):
    rng = random.Random(8)
    hist = []
    for c in "ab":
        for v in range(14):
            lo = rng.randrange(0, 300)
            hi = lo + rng.randrange(1, 200)
            hist += [(c, "label", f"v{v}", d, rng.randrange(1, 5)) for d in sorted(rng.sample(range(lo, hi + 1), min(hi - lo, 30)))]
    df = spark.createDataFrame(hist, "column string, view string, value string, day int, n long")
    got = sorted(tuple(r) for r in changes.successions(df, 20, 480).collect())
    assert got == brute_successions(hist, 20, 480) and len(got) > 20
    assert changes.successions(df.limit(0), 20, 480).collect() == []


def test_boundary_is_found_at_its_day(spark):
    df = spark.createDataFrame(table(), SCHEMA)
    rows = changes.boundaries(df, "day").collect()
    assert {r["boundary"] for r in rows} == {"2023-07-20"} == {r["day"] for r in rows}
    kinds = {(r["column"], r["kind"]) for r in rows}
    assert {("amount", "sign"), ("site", "label"), ("code", "form"), ("person", "form"), ("fee", "few"), ("fee", "whole")} <= kinds
    assert not any(c in ("n", "switch") for c, _ in kinds)
    sign = next(r for r in rows if r["kind"] == "sign")
    assert (sign["before"], sign["after"], sign["n_before"], sign["n_after"]) == ("positive", "negative", 600, 600)


def test_the_twin_without_a_change_gives_nothing(spark):
    df = spark.createDataFrame(table(planted=False), SCHEMA)
    assert changes.boundaries(df, "day").collect() == [] and changes.take_overs(df, "day").collect() == []
    assert changes.boundaries(df.limit(0), "day").collect() == [] and changes.boundaries(df.limit(50), "day").collect() == []


def test_labels_of_one_column_are_no_boundary(spark):
    df = spark.createDataFrame(table(), SCHEMA).select("day", "site", "switch")
    assert changes.boundaries(df, "day").collect() == []
    assert {(r["old"], r["new"]) for r in changes.take_overs(df, "day").collect()} == {(f"old site {a}", f"new site {b}") for a in "xyz" for b in "xyz"}


def test_near_dates_are_one_boundary(spark):
    first, second = table(change=200), table(change=230, seed=2)
    mixed = [(a[0], a[1], a[2], b[3], a[4], 1.0, 0, None) for a, b in zip(first, second, strict=True)]
    rows = changes.boundaries(spark.createDataFrame(mixed, SCHEMA), "day").collect()
    assert {r["boundary"] for r in rows} == {"2023-07-20"}
    assert {r["column"]: r["day"] for r in rows} == {"site": "2023-07-20", "code": "2023-07-20", "amount": "2023-07-20"}
    # names alone change at the later date: one column, so that date is none


def greedy(scored):
    used_a, used_b, out = set(), {}, []
    for a, b, s in sorted(set(scored), key=lambda t: (-t[2], t[0], t[1])):
        if a not in used_a and b not in used_b:
            used_a.add(a)
            used_b[b] = s
            out.append((a, b, s))
    return sorted(p for p in out if not any(a == p[0] and b != p[1] and s >= p[2] and used_b.get(b, -1) <= p[2] for a, b, s in scored))


@pytest.mark.parametrize("levels", [1000, 6], ids=["distinct", "ties"])
def test_mutual_best_is_the_greedy_answer(spark, levels):
    rng = random.Random(3)
    scored = [(f"a{i}", f"b{j}", rng.randrange(levels) / levels) for i in range(14) for j in range(12) if rng.random() < 0.6]
    df = spark.createDataFrame(scored + scored[:5], "a string, b string, score double")
    assert sorted(tuple(r) for r in changes.mutual_best(df).collect()) == greedy(scored)
    assert changes.mutual_best(df.limit(0)).collect() == []


def sites(rows=900, change=150):
    """Each old site's staff goes to one new site; the fourth site keeps its own, and staff differs between sites."""
    rng, out = random.Random(5), []
    for i in range(rows):
        d = i * 300 // rows
        k = rng.randrange(4)
        site = "Stays" if k == 3 else (["North", "South", "West"] if d < change else ["N-01", "S-02", "W-03"])[k]
        out.append((dt.datetime.combine(START + dt.timedelta(days=d), dt.time()), site, f"clerk {k}{rng.randrange(5)}", rng.choice(["red", "blue"])))
    return out


def test_handoffs_by_shared_values(spark):
    df = spark.createDataFrame(sites(), "day timestamp, site string, clerk string, colour string")
    rows = changes.handoffs(df, "site", "day", "2023-05-31", ["colour", "clerk"]).collect()
    assert {(r["old"], r["new"], r["via"], r["shared"]) for r in rows} == {("north", "n-01", "clerk", 5), ("south", "s-02", "clerk", 5), ("west", "w-03", "clerk", 5)}
    assert all(r["jaccard"] == 1.0 for r in rows)


def test_handoffs_by_pace_and_spelling(spark):
    """All share all: spelling and the pace of rows pair them, each once."""
    rng, rows = random.Random(9), []
    for i in range(1200):
        d = i * 300 // 1200
        k = rng.choice([0, 0, 0, 1])
        rows.append((dt.datetime.combine(START + dt.timedelta(days=d), dt.time()), (["open order", "held"] if d < 150 else ["open orders", "holding"])[k], rng.choice("ab")))
    df = spark.createDataFrame(rows, "day timestamp, status string, kind string")
    got = changes.handoffs(df, "status", "day", "2023-05-31", ["kind"]).collect()
    assert {(r["old"], r["new"]) for r in got} == {("open order", "open orders"), ("held", "holding")} and all(r["jaccard"] == 0.0 for r in got)


def test_profile_changes(spark):
    rng = random.Random(4)
    rows = [(dt.datetime(2023, 1, 1) + dt.timedelta(days=i), float(rng.randrange(3)) if i < 100 else rng.random() * 50, float(i % 50 + 1) * (1 if i < 100 else 5), float(i % 40)) for i in range(200)]
    df = spark.createDataFrame(rows, "day timestamp, a double, b double, c double")
    at = spark.createDataFrame([((dt.date(2023, 4, 11) - dt.date(1970, 1, 1)).days,)], "at int")
    assert {(r["column"], r["kind"]) for r in changes.profile_changes(df, "day", at, ["a", "b", "c"], 20).collect()} == {("a", "whole"), ("a", "few"), ("a", "scale"), ("b", "scale")}


def test_weighted_upper_median(spark):
    rng = random.Random(6)
    rows = [(g, float(rng.randrange(200)), rng.randrange(1, 9)) for g in "xyz" for _ in range(300)] + [("one", 4.0, 2)]
    df = spark.createDataFrame(rows, "g string, v double, c long")
    want = {}
    for g in {r[0] for r in rows}:
        flat = sorted(v for h, v, c in rows if h == g for _ in range(c))
        want[g] = flat[len(flat) // 2]
    assert {r["g"]: r["v"] for r in changes._weighted_upper_median(df, ["g"], "v", "c").collect()} == want


def test_counter_of_switches(spark):
    found = spark.createDataFrame([("a", 10), ("a", 12), ("b", 12), ("c", 12), ("d", 24), ("e", 25), ("f", 60)], "column string, switch int")
    assert Counter(tuple(r) for r in changes.switch_dates(found).collect()) == Counter([(12, 10), (25, 25), (60, 60)])
    assert changes.switch_dates(found.filter(F.lit(False))).collect() == []
