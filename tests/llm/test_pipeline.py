"""Every stage of the pipeline against a brute-force version on its own input."""

import re

import pyarrow.parquet as pq

import corpus_pipeline
from tests.llm.test_secrets import brute
from tidemark.llm.packing import VOCABULARY
from tidemark.llm.tokens import vocabulary

SMALL = "/root/testdata/sf0.001"
MARK = "[secret]"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def kept_of_near_copies(rows):
    sets, root = {r["doc_id"]: shingles(r["text"]) for r in rows}, {r["doc_id"]: r["doc_id"] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i for i in ids if find(i) == i}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def is_contaminated(text, windows):
    w = words(text)
    hit = {j for n in {len(x) for x in windows} for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for j in range(i, i + n)}
    return bool(hit) and 20 * len(hit) >= len(w)


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = corpus_pipeline.staged(stage(spark, docs, SMALL), name)
        seen.append((before, docs.collect()))
        assert name == "packing" or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    (a, b), (c, d), (e, f), (g, h), (i, packed) = seen
    assert {r["doc_id"] for r in b} == {r["doc_id"] for r in a if any(map(str.isalpha, r["text"] or ""))}
    truth = {r["doc_id"]: r["lang"] for r in a}
    assert sum(r["lang"] == truth[r["doc_id"]] for r in b if truth[r["doc_id"]]) >= 0.95 * sum(truth[r["doc_id"]] is not None for r in b)
    assert {r["doc_id"] for r in d} == kept_of_near_copies(c) and len(d) < len(c)
    windows = set()
    for item in pq.read_table(f"{SMALL}/benchmark.parquet").to_pylist():
        w = words(item["text"])
        n = min(13, len(w))
        windows |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    assert {r["doc_id"] for r in f} == {r["doc_id"] for r in e if not is_contaminated(r["text"], windows)} and len(f) < len(e)
    texts = {r["doc_id"]: r["text"] for r in g}
    assert len(h) == len(g)
    for r in h:
        if sum(brute(texts[r["doc_id"]])[0]) == 0 and MARK not in r["text"]:
            assert r["text"] == texts[r["doc_id"]]
        else:
            assert MARK in r["text"] and sum(brute(r["text"])[0]) == 0 and r["n_chars"] == len(r["text"])
    from tokenizers import Tokenizer

    enc, ids, rows = Tokenizer.from_file(vocabulary(VOCABULARY)), {}, {}
    for r in packed:
        ids.setdefault(r["doc_id"], []).append((r["start"], r["ids"]))
        rows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert {k: [x for _, part in sorted(v) for x in part] for k, v in ids.items()} == {r["doc_id"]: [*enc.encode(r["text"], add_special_tokens=False).ids, 2] for r in i}
    for parts in rows.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 4096
