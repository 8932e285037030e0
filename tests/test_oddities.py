import datetime as dt
import random

import pytest

from tidemark.operators import oddities

SCHEMA = "day timestamp, site string, area string, clerk string, status string, item string, amount double, price double, fee double, kind string, value string"


def rows(odd=True, seed=3):
    """Five sites share clerks, statuses and prices; the sixth begins late, has its own clerks, most of the money and five times the price."""
    rng, out = random.Random(seed), []
    for i in range(3000):
        site = f"Site {i % 6}"
        strange = odd and i % 6 == 5
        d = rng.randrange(280, 300) if strange else rng.randrange(300)
        clerk = f"own {rng.randrange(3)}" if strange else f"clerk {rng.randrange(8)}"
        status = "open" if strange else rng.choice(["open", "closed", "held"])
        item = f"item {rng.randrange(2 if strange else 40)}"
        price = rng.choice([50.0, 60.0, 70.0]) * (1 if strange else 0.1)
        amount = rng.randrange(50, 70) * (40.0 if strange else 1.0)
        fee = 0.0 if strange else rng.choice([0.0, 0.0, 3.0])
        out.append((dt.datetime(2024, 1, 1) + dt.timedelta(days=d), site, "far" if i % 6 == 5 else "near", clerk, status, item, amount, price, fee, "clash", "x"))
    return out


def evidence(spark, data, **more):
    df = spark.createDataFrame(data, SCHEMA)
    args = dict(day="day", money="amount", price="price", measures=["fee"], categories=["clerk", "status", "item"]) | more
    return df, oddities.group_evidence(df, ["site", "area"], **args)


def test_odd_site_is_found_with_its_evidence(spark):
    df, ev = evidence(spark, rows())
    got = {(r["grouping"], r["value"], r["kind"]): r["weight"] for r in ev.collect()}
    mine = {k: w for (g, v, k), w in got.items() if (g, v) == ("site", "site 5")}
    assert mine == {"presence": 3, "late": 3, "private": 3, "share": 4, "price": 3, "adjust": 1, "missing": 1, "lifecycle": 1, "items": 1}
    assert {v for g, v, _ in got if g == "site"} == {"site 5"}
    kept = oddities.odd_groups(df, ["site", "area"], ev).collect()
    assert [(r["grouping"], r["value"], r["n_rows"]) for r in kept] == [("site", "site 5", 500)]


def test_the_twin_has_nothing(spark):
    df, ev = evidence(spark, rows(odd=False))
    assert ev.collect() == [] and oddities.odd_groups(df, ["site", "area"], ev).collect() == []


def test_a_busy_branch_is_not_odd(spark):
    """Many more rows, and money in proportion."""
    data = rows(odd=False)
    data += [(d, "Site 0", *rest) for d, _, *rest in rows(odd=False, seed=9)]
    _, ev = evidence(spark, data)
    assert ev.filter("weight >= 3").collect() == []


def test_presence_near_a_change_does_not_count(spark):
    _, ev = evidence(spark, rows(), cuts=["2024-10-08"])
    assert "presence" not in {r["kind"] for r in ev.collect()}
    _, ev = evidence(spark, rows(odd=False), title_end="2023-12-31")
    assert {(r["value"], r["kind"]) for r in ev.filter("grouping = 'site'").collect()} == {(f"site {i}", "late") for i in range(6)}


def test_shares_are_brute_force(spark):
    rng = random.Random(12)
    for turn in range(3):
        data = []
        for g in range(7):
            scale = rng.choice([1, 1, 1, 4, 9])
            data += [(dt.datetime(2024, 1, 1), f"g{g}", None, None, None, None, float(rng.randrange(1, 9) * scale), None, None, None, None) for _ in range(rng.randrange(15, 60))]
        df = spark.createDataFrame(data, SCHEMA)
        got = {(r["value"], r["weight"]) for r in oddities.group_evidence(df, ["site"], money="amount").collect()}
        by = {}
        for r in data:
            by.setdefault(r[1], []).append(r[6])
        total, n, want = sum(r[6] for r in data), len(data), set()
        big = {k: v for k, v in by.items() if len(v) >= 20}
        for k, v in big.items():
            peers = sorted((sum(w) / total) / (len(w) / n) for x, w in big.items() if x != k)
            share = sum(v) / total
            mine = share / (len(v) / n)
            if len(peers) < 2:
                continue
            if peers[0] > 0 and peers[-1] <= 2.5 * peers[0]:
                x = mine / peers[len(peers) // 2]
                w = 4 if x >= 5 and share >= 0.2 else 2 if x >= 3 and share >= 0.1 else 0
            else:
                w = 4 if mine >= 5 * peers[-1] and share >= 0.2 else 0
            if w:
                want.add((k, w))
        assert got == want, turn


@pytest.mark.parametrize("n", [0, 19])
def test_small_and_empty_tables(spark, n):
    df, ev = evidence(spark, rows()[:n])
    assert ev.collect() == [] and oddities.odd_groups(df, ["site", "area"], ev).collect() == []
