import numpy as np
import pyarrow.parquet as pq
import pytest

from tidemark.llm import hash_forest

SMALL = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int, tree int, score string"


def brute(rows, k=20, every=20):
    ok = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)})
    out = {}
    for i, v in ok:
        if i % every == 0:
            near = {}
            for j, w in ok:
                if j != i and len(w) == len(v):
                    near[j] = max(near.get(j, -np.inf), float(np.dot(v, w)))
            for j, s in near.items():
                out.setdefault(i, {})[j] = max(s, out.get(i, {}).get(j, -np.inf))
    return {i: sorted(near.items(), key=lambda t: (-round(t[1], 9), t[0]))[:k] for i, near in out.items()}


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "clash") for i, v in rows], SCHEMA)


def recall(got, want):
    hits = sum(sum(s >= want[q][-1][1] - 1e-9 for _, s in got.get(q, [])) for q in want)
    return hits / sum(map(len, want.values()))


def test_planes_are_at_right_angles():
    p = hash_forest.planes(8)
    assert p.shape == (hash_forest.TREES * hash_forest.BITS, 9) and np.allclose(p[:9] @ p[:9].T, np.eye(9))


def test_prefix_ranges():
    rng = np.random.default_rng(3)
    keys = np.sort(rng.integers(0, 1 << 62, 300))
    keys[50:70] = keys[50]
    keys.sort()
    asked = np.concatenate([keys[::17], rng.integers(0, 1 << 62, 20)])
    for level in (0, 1, 5, 30, 62):
        low, high = hash_forest.prefix_range(keys, asked, level)
        for a, lo, hi in zip(asked, low, high, strict=True):
            assert hi - lo == sum(int(x) >> (62 - level) == int(a) >> (62 - level) for x in keys)


def test_levels():
    assert hash_forest.level_for(1.0, 10, 0.9) == 62 and hash_forest.level_for(-1.0, 10, 0.9) == 0
    for cosine in (0.3, 0.9, 0.99):
        level, same = hash_forest.level_for(cosine, 10, 0.9), 1 - np.arccos(cosine) / np.pi
        assert 1 - (1 - same**level) ** 10 >= 0.9 > 1 - (1 - same ** (level + 1)) ** 10


def test_odd_rows_and_ties(spark):
    v, w = [1.0, 2.0, 0.0], [2.0, 4.0, 0.0]
    rows = [(0, v), (20, v), (20, v), (40, w), (5, v), (6, v), (7, [0.0, 0.0, 0.0]), (8, None), (9, []), (10, [1.0, None, 2.0]), (11, [float("nan"), 1.0, 1.0]), (12, [float("inf"), 1.0, 1.0]),
            (None, v), (60, [1.0, 1.0]), (61, [3.0, 1.0]), (80, [5.0]), (100, [0.0, 0.0, 0.0]), (13, [-1.0, 0.0, 0.0]), (14, [0.0, 0.0, 1e-300]), (20, [9.0, 0.0, 0.0])]
    got, want = result(hash_forest.nearest(frame(spark, rows))), brute(rows)
    want = {q: near for q, near in want.items() if near}
    assert {q: [i for i, _ in near] for q, near in got.items()} == {q: [i for i, _ in near] for q, near in want.items()}
    assert hash_forest.nearest(frame(spark, [])).collect() == []


def test_many_copies(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [1.0, 0.5, 0.25]) for i in range(400)] + [(i, rng.standard_normal(3).tolist()) for i in range(400, 600)]
    got, want = result(hash_forest.nearest(frame(spark, rows))), brute(rows)
    assert {q: [i for i, _ in near] for q, near in got.items() if q < 400} == {q: [i for i, _ in near] for q, near in want.items() if q < 400}


@pytest.mark.parametrize("norms", [False, True], ids=["unit", "norms"])
def test_groups_are_found_without_looking_at_all(spark, norms):
    """Vectors in groups: right by recall, and queries end at long prefixes."""
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((300, 32))
    x = centres[rng.integers(0, 300, 12_000)] + 0.15 * rng.standard_normal((12_000, 32))
    x = x / np.linalg.norm(x, axis=1)[:, None] * (rng.uniform(0.8, 1.0, 12_000)[:, None] if norms else 1)
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    got = result(hash_forest.nearest(df))
    q = np.arange(0, 12_000, 20)
    s = x[q] @ x.T
    s[np.arange(len(q)), q] = -np.inf
    want = {int(i): [(int(j), float(row[j])) for j in np.argsort(-row)[:20]] for i, row in zip(q, s, strict=True)}
    assert set(got) == set(want) and all(len(n) == 20 for n in got.values())
    assert recall(got, want) >= 0.9
    assert all(abs(s - float(x[i] @ x[j])) < 1e-12 for i, near in got.items() for j, s in near[:2])
    cosine = np.sort(s, 1)[:, -20] / np.linalg.norm(x[q], axis=1) / np.linalg.norm(x, axis=1).max()
    if not norms:
        assert np.median([hash_forest.level_for(c, hash_forest.TREES, hash_forest.RECALL) for c in cosine]) >= 7


def test_query_against_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in pq.read_table(f"{SMALL}/embeddings.parquet").to_pylist()]
    got, want = result(hash_forest.op11_nearest(spark, SMALL)), brute(rows)
    assert set(got) == set(want) and recall(got, want) >= 0.9
