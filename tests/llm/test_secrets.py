import hashlib
import re

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tidemark.llm import secrets as S

TABLE = "/root/testdata/sf0.001/documents.parquet"
KEY = "".join  # assembled so that no scanner of this repository takes them for real ones


def brute(text):
    text = text or ""
    word = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    found = []
    for m in re.finditer(rf"""({word})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 20:
            found.append((m.start(), 1, f"access:{m.start()}:{m.end()}"))
    for m in re.finditer(r"[0-9a-f]+", text):
        if len(m[0]) >= 24:
            found.append((m.start(), 2, f"hex:{m.start()}:{m.end()}"))
    found.sort()
    return [sum(k == i for _, k, _ in found) for i in range(3)], ",".join(x for *_, x in found)


CASES = [
    None, "", "no secret here", "token=short", "Password: hunter22", "ApiKey='abcdef' api_key=zzzzzz", "éé token = \"abc/def==\" x",
    "secretſ: abcdefg", KEY(["AKIA", "ABCDEFGHIJKLMNOP"]), KEY(["AKIA", "ABC"]), "0123456789abcdef01234567", "0123456789ABCDEF01234567",
    KEY(["token:", "0123456789abcdef01234567"]), "password=abc password=abcdef", "tokentoken=abcdefgh", "x" * 300_000 + " token=abcdef",
    KEY(["gh", "p_", "a" * 36]), KEY(["-----BEGIN RSA PRI", "VATE KEY-----"]),
]


def check(rows, texts):
    for r in rows:
        counts, joined = brute(texts[r["doc_id"]])
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == counts, r
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        base = ",".join(x for x in r["spans"].split(",") if x.split(":")[0] in ("assign", "access", "hex"))
        assert base == joined


def test_edge_cases(spark):
    texts = dict(enumerate(CASES))
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in texts.items()] * 2, "doc_id long, text string, spans string, n_hex string")
    rows = S.digest_columns(S.scan_secrets(docs)).collect()
    assert len(rows) == 2 * len(CASES)
    check(rows, texts)
    extra = {r["doc_id"]: r["spans"] for r in rows}
    assert "forge_token" in extra[len(CASES) - 2] and "private_key" in extra[len(CASES) - 1]
    assert S.scan_secrets(docs.limit(0)).count() == 0


def test_whole_table(spark):
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(TABLE).to_pylist()}
    rows = S.op10_secret_scan(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    check(rows, texts)


def test_queries_and_scan_everything():
    assert S.trigram_query(r"[0-9a-f]+") == []
    assert S.trigram_query("AKIA[A-Z0-9]+") == [("or", [(b"aki", b"kia")])]
    assert all(S._named(S.trigram_query(r.pattern)) for r in S.RULES if r.kind != "hex")


def test_rules_of_letters_beyond_ascii_and_of_either_case(spark):
    rules = [S.Rule("school", "ÉCOLE[0-9]+"), S.Rule("any", "(?i)secret="), S.Rule("part", "x(?i:stuvw)y")]
    assert S.trigram_query(rules[1].pattern) == [] and S.trigram_query(rules[0].pattern)
    texts = ["a ÉCOLE12 b", "école12", "ſecret=abc", "SECRET=", "xſTUvWy", "none"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: [(x["kind"], x["start"], x["end"]) for x in r["spans"]] for r in S.scan_secrets(docs, rules).collect()}
    assert found == {0: [("school", 2, 9)], 1: [], 2: [("any", 0, 7)], 3: [("any", 0, 7)], 4: [("part", 0, 7)], 5: []}


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "a token=abcdef b", 3), (2, None, 3), (3, "clean", 3)], "doc_id long, text string, n int")
    rows = {r["doc_id"]: r for r in S.redact_secrets(docs).collect()}
    assert rows[1]["text"] == f"a {S.MARK} b" and rows[2]["text"] is None and rows[3]["text"] == "clean"
    assert S.redact_secrets(docs).columns == docs.columns and F.col("n") is not None
