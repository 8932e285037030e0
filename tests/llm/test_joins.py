import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, near_vectors, ngram_join, secrets, warc
from tidemark.llm.prefix_tree import PrefixTree, Sequence
from tidemark.llm.shingles import shingle_sets

SMALL = "/root/testdata/sf0.001"
BODY = "the quick brown fox jumps over the lazy dog and runs far away from all the other animals of the wood "
DOCS = [(9, BODY * 3), (4, BODY * 3), (5, (BODY * 3).upper()), (6, BODY * 2 + BODY + "x"), (7, ""), (8, None), (10, "  "), (11, "one two"), (12, "One  two"), (13, "one two three"), (None, BODY), (4, BODY * 3)]


def roots(n, pairs):
    at = {i: i for i in n}
    for _ in n:
        for a, b in pairs:
            at[a] = at[b] = min(at[a], at[b])
    return at


def test_prefix_trees_are_brute_force():
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 1 << 60, 60).astype(np.uint64))
    sets = []
    for i in range(90):
        s = base[rng.random(len(base)) < 0.95] if i % 3 else np.unique(rng.integers(0, 1 << 60, rng.integers(1, 70)).astype(np.uint64))
        sets.append(np.unique(np.concatenate([s, rng.integers(0, 1 << 60, rng.integers(0, 9)).astype(np.uint64)])))
    groups = np.arange(len(sets)) % 7
    whole = [Sequence.whole(s) for s in sets]
    tree, grouped = PrefixTree(whole), PrefixTree(whole, groups)
    shared, n = np.unique(np.concatenate(sets), return_counts=True)
    shared = shared[n > 1]
    for most in (1, 3, 40):  # lists of the first shared codes propose every link
        parts = []
        for s in sets:
            at = np.flatnonzero(np.isin(s, shared))
            parts.append(Sequence(s[at[:most]], at[:most], len(s), int(at[most]) if len(at) > most else len(s)))
        kept = [i for i, s in enumerate(parts) if len(s.codes)]
        some = PrefixTree([parts[i] for i in kept])
        for i, s in enumerate(sets):
            want = {k for k, t in enumerate(sets) if 100 * len(np.intersect1d(s, t)) >= 80 * len(np.union1d(s, t))}
            assert set(tree.search(whole[i]).tolist()) == want
            assert set(grouped.search(whole[i], group=groups[i]).tolist()) == {k for k in want if groups[k] != groups[i]}
            if len(parts[i].codes):
                assert want & set(kept) <= {kept[k] for k in some.search(parts[i]).tolist()}


def test_shingles():
    a, b, c, d, e = shingle_sets(pa.array(["A b c d e", "a  b\tc d e\n", None, " ", "a b"]))
    assert len(a) == 1 and (a == b).all() and len(c) == len(d) == 0 and len(e) == 1 and e[0] != a[0]


def test_link_documents(spark):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in DOCS], "doc_id long, text string, n long, code string")
    rows = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in ngram_join.link_documents(docs).collect())
    assert len(rows) == len(DOCS)
    got = {i: c for i, _, c in rows}
    assert [got[i] for i in (4, 5, 6, 9)] == [4] * 4 and got[7] == 7 and got[8] == 8 and got[10] == 10
    assert got[11] == got[12] == 11 and got[13] == 13 and got[-1] is None
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 4, 4, 7, 8, 10, 11, 13]
    assert ngram_join.link_documents(docs.limit(0)).count() == 0


def test_one_row_of_each_component(spark):
    other = "a wholly different text about ships and harbours far away from here and there"
    rows = [*DOCS, (None, BODY * 3), (4, other), (None, other), (None, "null ids too " * 9), (None, "null ids too " * 9), (20, ""), (20, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = ngram_join.keep_one_row(docs)
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"] or -1, r["text"]) for r in kept.collect()), key=repr)
    solo = [(7, ""), (8, None), (10, "  "), (11, "one two"), (13, "one two three"), (20, ""), (-1, None)]
    assert got == sorted([(4, BODY * 3), (4, other), (-1, "null ids too " * 9), *solo], key=repr)
    assert ngram_join.keep_one_row(docs.limit(0)).count() == 0


def test_count_links(spark):
    words = [f"w{i}" for i in range(100)]
    texts = [(i, " ".join(words[i // 2 : i // 2 + 60])) for i in range(24)] + [(50, ""), (51, None), (52, ""), (53, "one two"), (54, "One  two"), (None, words[0])]
    sets = {i: set(s.tolist()) for (i, _), s in zip(texts, shingle_sets(pa.array([t for _, t in texts])), strict=True)}
    want = {i: sum(j != i and j is not None and 100 * len(a & b) >= 80 * len(a | b) for j, b in sets.items()) if a and i is not None else 0 for i, a in sets.items()}
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: r["n_links"] for r in ngram_join.count_links(docs).collect()}
    assert got == want and max(want.values()) > 10
    assert ngram_join.count_links(docs.limit(0)).count() == 0


@pytest.fixture
def sorted_joins(spark):
    """Joins are broadcast only where the code says so, as they are on large tables."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_texts_kept_are_not_shuffled(spark, sorted_joins, monkeypatch):
    docs = spark.createDataFrame([(4, BODY * 3), (9, BODY * 3 + "."), (11, "one two"), (12, "three"), (13, ""), (None, "four")], "doc_id long, text string")
    for keep in (ngram_join.keep_one_row, ngram_join.keep_one):
        kept = keep(docs)
        assert exchanges(kept) == 0
        want = sorted((r["doc_id"] or -1) for r in kept.collect())
        assert want == [-1, 4, 11, 12, 13]
        with monkeypatch.context() as m:  # more rows go than may be sent
            m.setattr(ngram_join, "MOST_SENT", 0)
            assert sorted((r["doc_id"] or -1) for r in keep(docs).collect()) == want


def test_hits_are_dealt_once(spark, sorted_joins, monkeypatch):
    monkeypatch.setattr(ngram_join, "LISTED", 2)
    monkeypatch.setattr(ngram_join, "HOT", 2)
    hits = spark.createDataFrame([(c, node, 20, at) for node in (1, 2, 3) for at, c in enumerate((10, 11, 12, 13))], "code long, node long, n int, at int")
    live = hits.filter("node < 3 and code <> 11 or node = 3 and code = 10").withColumn("component", F.col("node") * 100)
    listed = ngram_join._listed(hits.filter("node < 4"), live)
    assert exchanges(listed) == 1
    got = {(r["node"], r["code"]): (r["component"], r["n"], r["at"], r["codes"], r["places"], r["end"]) for r in listed.collect()}
    tail = {10: ([10, 11], [0, 1], 2), 12: ([12, 13], [2, 3], 5), 13: ([13], [3], 5)}
    want = {(node, c): (node * 100, 20, c - 10, *tail[c]) for node in (1, 2) for c in (10, 12, 13)} | {(3, 10): (300, 20, 0, *tail[10])}
    assert got == want
    blocks = ngram_join._blocks(ngram_join.staged(listed, "entries"), (80, 100))
    assert exchanges(blocks) == 0
    rows = blocks.collect()
    meet = {(a["code"], a["node"], b["node"]) for a in rows if a["probes"] for b in rows if b["stored"] and (b["block"], b["code"]) == (a["block"], a["code"])}
    assert meet == {(c, x, y) for x, c in want for y, d in want if c == d and c < 13}  # 13 stands too late for a first common code


def test_cut_up_is_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(70)]
    texts = [(i, " ".join(w for w in words if rng.random() < 0.995)) for i in range(30)] + [(i, " ".join(words[i - 40 : i])) for i in range(40, 70)] + [(80, "one two"), (81, "One  two"), (82, None)]
    sets = {i: set(s.tolist()) for (i, _), s in zip(texts, shingle_sets(pa.array([t for _, t in texts])), strict=True)}
    pairs = [(i, j) for i, a in sets.items() for j, b in sets.items() if a and j != i and 100 * len(a & b) >= 80 * len(a | b)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for k, v in {"HOT": 3, "BLOCK": 8, "LISTED": 3, "GROUP": 4, "MOST_SENT": 0, "STARS": 0}.items():
        monkeypatch.setattr(ngram_join, k, v)
    assert {r["doc_id"]: r["n_links"] for r in ngram_join.count_links(docs).collect()} == {i: sum(p == i for p, _ in pairs) for i in sets}
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.link_documents(docs).collect()} == roots(list(sets), pairs)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize(("run", "sql"), [(ngram_join.op4_ngram_join, ngram_join.OP4_SQL), (decontaminate.op5_decontaminate, decontaminate.OP5_SQL), (near_vectors.op7_near_vectors, near_vectors.OP7_SQL), (warc.op9_warc, warc.OP9_SQL), (secrets.op10_secret_scan, secrets.OP10_SQL)])
def test_queries_equal_sql(spark, duck, run, sql):
    a, b = run(spark, SMALL).toPandas(), duck.execute(sql).df()
    a, b = (x[sorted(x.columns)].astype(object).where(x.notna(), None).map(lambda v: int(v) if isinstance(v, float) else v) for x in (a, b))
    assert list(a.columns) == list(b.columns)
    assert sorted(map(repr, a.values.tolist())) == sorted(map(repr, b.values.tolist()))


def test_decontaminate(spark):
    words = [f"w{i}" for i in range(40)]
    bench = spark.createDataFrame([(1, " ".join(words[:20])), (2, "short item"), (3, None), (4, "...")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "A " + " ".join(words[2:16]) + " z", 0), (2, " ".join(words[:12]), 0), (3, None, 0), (4, "", 0), (5, ("pad " * 500) + "Short, ITEM!", 0)], "doc_id long, text string, items int")
    r = {x["doc_id"]: x for x in decontaminate.contamination(docs, bench).collect()}
    assert r[1]["hits"] == list(range(1, 15)) and r[1]["items"] == ["1"] and r[2]["hits"] == [] and r[5]["items"] == ["2"] and r[3]["n_words"] == 0
    for sizes in ({}, {"most": 0}, {"most": 0, "sent": 0}):  # set in the plan, broadcast table, shuffle
        assert sorted(x["doc_id"] for x in decontaminate.decontaminate(docs, bench, **sizes).collect()) == [2, 3, 4, 5]
        cut = {x["doc_id"]: x["text"] for x in decontaminate.decontaminate(docs, bench, remove="spans", **sizes).collect()}
        assert cut[1] == "A z" and cut[2] == " ".join(words[:12]) and cut[3] is None
        same = {x["doc_id"]: x for x in decontaminate.contamination(docs, bench, **sizes).collect()}
        assert same == r
    assert decontaminate.contamination(docs, bench.limit(0)).filter("size(hits) > 0").count() == 0


def test_vectors(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.1], 1), (4, [1.0, 0.0], 2), (5, [0.0, 0.0], 1), (6, None, 1), (7, [nan, 1.0], 1), (8, [1.0, None], 1), (9, [1.0, 0.0], None), (10, [1.0, 0.0, 0.0], 1), (11, [], 1)]
    d = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, copies string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors.link_vectors(d).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1)} | {i: (0, i) for i in range(4, 12)}
    assert near_vectors.link_vectors(d.limit(0)).count() == 0


def test_vectors_of_several_lengths(spark, monkeypatch):
    rng, fitted, init = np.random.default_rng(3), [], near_vectors.Quantiser.__init__

    def recorded(self, sample, lists):
        fitted.append((sample.shape, lists))
        init(self, sample, lists)

    monkeypatch.setattr(near_vectors.Quantiser, "__init__", recorded)
    rows = [(i, rng.normal(size=3 if i % 4 else 4).tolist(), 1) for i in range(400)] + [(400, [1.0] * 9, 1)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in near_vectors.link_vectors(d).collect()}
    assert sorted(fitted) == [((1, 9), 1), ((100, 4), 2), ((300, 3), 4)]
    unit = {i: np.array(e) / np.linalg.norm(e) for i, e, _ in rows}
    assert got == {i: sum(j != i and len(a) == len(b) and float(a @ b) >= 0.93 for j, b in unit.items()) for i, a in unit.items()}


def test_archives(spark):
    long = "<p>" + "é" * 100 + "\r\n\r\nWARC/1.1\r\n</p>"
    rows = [(3, "http://a/\r\n3", long), (3, None, long), (1, "http://a/1", long), (2, None, "short"), (5, "u", "short"), (4, "u", None), (None, "u", long), (6, "u", long)]
    path = warc.scratch_path(spark, "test")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    records = warc.read_archives(spark, path).collect()
    assert len(records) == len(rows) and sum(r["record_type"] == "revisit" for r in records) == 3
    assert spark.read.text(path, lineSep="\r\n").filter("value = 'WARC-Type: warcinfo'").count() >= 1
    got = {r["page_id"]: r for r in records}
    assert len(got) == 7 and {k: v["refers_to"] for k, v in got.items()} == {3: 1, 1: None, 2: None, 5: None, 4: None, None: None, 6: 1}
    assert got[3]["payload_bytes"] == len(long.encode()) and got[3]["record_type"] == "revisit" and got[4]["payload_bytes"] == 0
    assert pq.read_table(f"{SMALL}/pages.parquet").num_rows > 0


def test_many_windows(spark):
    items = spark.range(20_000).selectExpr("id as item_id", "array_join(transform(sequence(0, 22), x -> concat('w', id * 23 + x)), ' ') as text")
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(23 * 777 + 2, 23 * 777 + 17))), (2, "w1 w2 w3"), (3, None)], "doc_id long, text string")
    assert decontaminate.benchmark_windows(items).n == 220_000
    got = {r["doc_id"]: (len(r["hits"]), r["items"]) for r in decontaminate.contamination(docs, items).collect()}
    assert got == {1: (15, ["777"]), 2: (0, []), 3: (0, [])}
