import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import packing, token_counts, token_output, tokens
from tidemark.llm.common import scratch_path
from tidemark.llm.tokens import Encoder, vocabulary

SMALL = "/root/testdata/sf0.001"
TEXTS = [None, "", " ", "a", "Hello  world\n\n x\t", "don't 'start a.b", "É×÷ é́ α Σ. \x1c \xa0 <|endoftext|>", "word " * 30_000, "\x00a\x00", "9²½"]
ROWS = list(enumerate(TEXTS)) + [(3, "a"), (None, "null id")]


def plain(name):
    t = Tokenizer.from_file(vocabulary(name))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 7) for i, t in ROWS], "doc_id long, text string, part string, length int")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library(name):
    enc, library = Encoder(vocabulary(name)), plain(name)
    texts = [t or "" for t in TEXTS] + pq.read_table(f"{SMALL}/documents.parquet")["text"].to_pylist()[:100]

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.text(alphabet=st.sampled_from("aZé's .\n\t0-ĀŉſαΣ́\xa0 　×²"), max_size=30), max_size=4))
    def some(more):
        assert [x.tolist() for x in enc.encode(more)] == [library(t) for t in more]

    assert [x.tolist() for x in enc.encode(texts)] == [library(t) for t in texts]
    some()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_more_pieces_than_slots(monkeypatch, name):
    monkeypatch.setattr(tokens, "_SLOTS", 1 << 8)
    monkeypatch.setattr(tokens, "MOST_PIECES", 64)
    enc, library = Encoder(vocabulary(name)), plain(name)
    texts = [" ".join(str(i * 7919) for i in range(1000)), "", "a b", "x".join(f"{i:020d}\n" for i in range(300)), "Ω " + "1 2 3"]
    for _ in range(2):
        assert [x.tolist() for x in enc.encode(texts)] == [library(t) for t in texts]


def test_histogram_and_suffix_sums(spark, docs):
    ids = plain(token_counts.VOCABULARY)
    n = [len(ids(t)) for _, t in ROWS]
    sums = token_counts.suffix_sums(token_counts.length_histogram(docs)).cache()
    for r in sums.collect():
        k = r["length"]
        assert (r["n_docs"], r["docs_at_least"], r["docs_at_most"]) == (n.count(k), sum(x >= k for x in n), sum(x <= k for x in n))
        assert (r["tokens_at_least"], r["tokens_total"], r["truncated_tokens"]) == (sum(x for x in n if x >= k), sum(n), sum(min(x, k) for x in n))
    for limit in (0, 1, 2, 17, 10**6):
        assert token_counts.truncated_total(sums, limit) == sum(min(x, limit) for x in n)
    assert token_counts.length_quantile(sums, 0.5) == sorted(n)[-(-len(n) // 2) - 1]
    none = token_counts.suffix_sums(token_counts.length_histogram(docs.limit(0)))
    assert none.count() == 0 and token_counts.truncated_total(none, 5) == 0 and token_counts.length_quantile(none, 0.5) is None


def test_first_fit_decreasing_is_first_fit():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 77, 400):
        sizes = [int(x) for x in rng.integers(1, 101, n)]
        bins, offsets = packing.first_fit_decreasing(sizes, 100)
        free: list[int] = []
        for i in sorted(range(n), key=lambda i: -sizes[i]):
            k = next((k for k, f in enumerate(free) if f >= sizes[i]), len(free))
            free += [100] * (k == len(free))
            assert (bins[i], offsets[i]) == (k, 100 - free[k])
            free[k] -= sizes[i]


def check_packed(rows, texts, capacity):
    ids = plain(packing.VOCABULARY)
    want = sorted((str(i), tuple([*ids(t), 2])) for i, t in texts)
    assert sum(r["length"] for r in rows) == sum(len(x) for _, x in want)
    per, seqs = {}, {}
    for r in rows:
        per.setdefault(r["doc_id"], []).append(r)
        seqs.setdefault(r["sequence_id"], []).append(r)
        assert 0 < r["length"] <= capacity
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    for i, x in {i: x for i, x in ((i, [*ids(t), 2]) for i, t in texts)}.items():
        for r in per[i]:
            piece = np.array(x[r["start"] : r["start"] + r["length"]], "<u4")
            assert r["doc_tokens"] == len(x) and r["ids_crc32"] == zlib.crc32(piece.tobytes())


def test_packing(spark, docs):
    rows = packing.pack_documents(docs, capacity=64, group_docs=4).collect()
    check_packed(rows, ROWS, 64)
    with_ids = packing.pack_documents(docs, with_ids=True).collect()
    assert all(len(r["ids"]) == r["length"] for r in with_ids)
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_packing_whole_table(spark):
    packed = packing.op6_pack(spark, SMALL).cache()
    texts = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SMALL}/documents.parquet").to_pylist()]
    check_packed(packed.collect(), texts, packing.CAPACITY)
    assert packing.padding_share(packed) < 0.02


def test_token_files(spark, docs):
    ids = plain(token_output.VOCABULARY)
    path = scratch_path(spark, "test")
    token_output.write_token_ids(docs, path, file_docs=3)
    files = token_output.read_token_ids(spark, path)
    rows = token_output.token_index(files).orderBy("start").collect()
    assert len(rows) == len(ROWS)
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert [r["doc_id"] for r in rows] == [i for i, _ in sorted(ROWS, key=key)]
    text, at = dict(ROWS), 0
    for r in rows:
        x = [*ids(text[r["doc_id"]]), 0]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
        at += len(x)
    assert [r["ids"] for r in token_output.read_token_ids(spark, path, [4]).collect()] == [[*ids(TEXTS[4]), 0]]
    plan = token_output.read_token_ids(spark, path, [4])._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,4)]" in plan or "PushedFilters: [In(doc_id" in plan or "EqualTo(doc_id,4)" in plan
    none = scratch_path(spark, "test")
    token_output.write_token_ids(docs.limit(0), none)
    assert token_output.token_index(token_output.read_token_ids(spark, none)).count() == 0
