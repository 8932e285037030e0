import hashlib
import zlib

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle

SMALL = "/root/testdata/sf0.001"
DOCS = [(5, "É Ab", "en", "s1", 4), (5, "É Ab", "en", "s1", 4), (5, "other", None, "s1", None), (None, "no id", "de", "s1", 5), (7, None, "de", None, None), (8, "", "", None, 0),
        (10, "LONE", "en", "", 4), (11, "x" * 100_000 + "Y", "en", "Ω", 100_001), (12, "z", "en", "\U0001f600", 1)] + [(1000 + i, f"Text {i}", "en", "hot", i) for i in range(4200)]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(doc_id, text, lang, source, n):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n, text)))


def tree(nodes):
    """The root and, for each node, its runs up to it with its place in each."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for w, k in zip(ways, at, strict=True):
            w.append((runs[k // 16], k % 16))
        at = [k // 16 for k in at]
        nodes = [sha("".join(r)) for r in runs]
    return nodes[0], ways


def brute(docs):
    by = {}
    for d in docs:
        own = leaf(*d)
        low = None if d[1] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in d[1])
        changed = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 5 == 0
        by.setdefault(d[3], []).append((d[0], own, leaf(d[0], low, *d[2:]) if changed else own))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    rows = [sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, r[1])) for s in names]
    inner = [tree([r[1] for r in rs]) for rs in rows]
    root, outer = tree([t[0] for t in inner])
    out = []
    for rs, (sub, ways), beyond in zip(rows, inner, outer, strict=True):
        for (doc_id, own, given), way in zip(rs, ways, strict=True):
            proof = ""
            for run, k in way + beyond:
                proof += "".join(run[:k] + run[k + 1 :])
                given = sha("".join([*run[:k], given, *run[k + 1 :]]))
            out.append((doc_id, own, sub, root, sha(proof), given, given == root))
    return out


def result(spark, docs):
    df = spark.createDataFrame([(*d, 1, "clash") for d in docs], "doc_id long, text string, lang string, source string, n_chars long, pos long, tree string")
    changed = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    return merkle.merkle_manifest(merkle.leaves(df, changed, merkle.lower_ascii(F.col("text"))))


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("docs", [DOCS, DOCS[:1], DOCS[6:9], DOCS[9:25], DOCS[9:26]], ids=["all", "one", "lone", "a run", "a run and one"])
def test_manifest_is_brute_force(spark, docs):
    assert ordered(result(spark, docs).collect()) == ordered(brute(docs))


def test_many_sources(spark):
    docs = [(i, "T" if i % 3 else None, "en", f"s{i % 300}", 1) for i in range(700)]
    assert ordered(result(spark, docs).collect()) == ordered(brute(docs))


def test_empty_table(spark):
    assert result(spark, []).collect() == []


def test_tampering_is_found(spark):
    rows = result(spark, DOCS).collect()
    text = {d[0]: d[1] for d in DOCS}
    for r in rows:
        hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and text[r["doc_id"]] != (text[r["doc_id"]] or "").lower() and text[r["doc_id"]] is not None
        assert r["verified"] == (not hit)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SMALL}/documents.parquet'")
    want = con.execute(merkle.OP12_SQL).df()
    got = merkle.op12_merkle(spark, SMALL).toPandas()
    key = ["doc_id", "leaf"]
    pd.testing.assert_frame_equal(got.sort_values(key).reset_index(drop=True), want[got.columns].sort_values(key).reset_index(drop=True), check_dtype=False)
