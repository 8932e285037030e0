import hashlib
from collections import Counter

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tidemark.llm import alignment
from tidemark.llm.tokens import PieceEncoder, vocabulary

SMALL = "/root/testdata/sf0.001"
TEXTS = [None, "", " ", "  ", "a", "Hello  world\n\n x\t ", "don't 'start a.b", "É×÷ é́ α Σ. \x1c \xa0 <|endoftext|> </s>", "word " * 4_000, "\x00a\x00", "9²½ 日本語のテキスト 한국어", "has ▁ inside", "a b c a b c", "\U0001f600 x"]
ROWS = list(enumerate(TEXTS)) + [(4, "a"), (None, "null id")]


def brute(rows):
    """By the contract's words, one link after another."""
    a = Tokenizer.from_file(vocabulary(alignment.VOCABULARY_A))
    a.encode_special_tokens = True
    names = {i: t for t, i in a.get_vocab().items()}
    b = SentencePieceProcessor(model_file=vocabulary(alignment.VOCABULARY_B))
    codes = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(c): c for c in codes} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in codes)}
    docs, counts = [], Counter()
    for doc_id, text in rows:
        if not text:
            docs.append((doc_id, [], [], [], []))
            continue
        ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        ta = [bytes(byte[c] for c in names[i]) for i in ia]
        tb = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ib, b.id_to_piece(ib), strict=True)]
        if not b"".join(ta) == b"".join(tb) == (" " + text).encode():
            docs.append((doc_id, [], [], [], []))
            continue
        ends = lambda ts: [sum(map(len, ts[: k + 1])) for k in range(len(ts))] if len(ts) < 500 else list(__import__("itertools").accumulate(map(len, ts)))
        ea, eb = ends(ta), ends(tb)
        cuts = sorted(set(ea) & set(eb))
        groups, i, j = [], 0, 0
        for c in cuts:
            x, y = [], []
            while i < len(ea) and ea[i] <= c:
                x.append(i)
                i += 1
            while j < len(eb) and eb[j] <= c:
                y.append(j)
                j += 1
            groups.append((x, y))
        links = [(ia[x], ib[y]) for xs, ys in groups for x in xs for y in ys if max(ea[x] - len(ta[x]), eb[y] - len(tb[y])) < min(ea[x], eb[y])]
        counts.update(links)
        docs.append((doc_id, ia, ib, [([ia[x] for x in xs], [ib[y] for y in ys]) for xs, ys in groups], links))
    top = Counter()
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    out = []
    for doc_id, ia, ib, groups, links in docs:
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc_id, len(ia), len(ib), len(groups), len(links), hashlib.sha256(said.encode()).hexdigest() if said else "", sum(counts[p] == top[p[1]] for p in links), sum(counts[p] for p in links)))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]


def ordered(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def test_piece_encoder_equals_library():
    path = vocabulary(alignment.VOCABULARY_B)
    enc, library = PieceEncoder(path), SentencePieceProcessor(model_file=path)
    texts = [t for t in TEXTS if t] + pq.read_table(f"{SMALL}/documents.parquet")["text"].to_pylist()[:100]

    @settings(max_examples=200, deadline=None)
    @given(st.lists(st.text(alphabet=st.sampled_from("aZé's .\n\t0-日Σ\xa0 　×\x00😀"), max_size=30), max_size=4))
    def some(more):
        more = [m for m in more if m]
        assert [x.tolist() for x in enc.encode([" " + m for m in more])] == [library.encode(m) for m in more]

    texts = [t for t in texts if t]
    assert [x.tolist() for x in enc.encode([" " + t for t in texts])] == [library.encode(t) for t in texts]
    some()


@pytest.mark.parametrize("run,block", [(alignment.RUN, alignment.BLOCK), (7, 40)], ids=["whole", "in parts and many blocks"])
def test_alignment_is_brute_force(spark, run, block):
    docs = spark.createDataFrame([(i, t, "clash", 3) for i, t in ROWS], "doc_id long, text string, pair string, n long")
    assert ordered(alignment.align_tokens(docs, run=run, block=block)) == brute(ROWS)


def test_query_is_brute_force_on_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SMALL}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    assert ordered(alignment.op13_align(spark, SMALL)) == brute(rows)


def test_groups_and_pairs(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in alignment.align_tokens(docs, with_groups=True).collect()}
    assert hashlib.sha256(rows[1]["groups"].encode()).hexdigest() == rows[1]["groups_sha256"] and rows[1]["groups"].startswith(rows[2]["groups"] + ";")
    pairs = {r["pair"]: r["links"] for r in alignment.pair_counts(alignment.aligned_blocks(docs)).collect()}
    a, b = map(int, rows[2]["groups"].split("|"))
    assert pairs[(a << 32) + b] == 2 and len(pairs) == 2


def test_empty_table(spark):
    assert alignment.align_tokens(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, alignment.align_tokens(nothing).select(*COLUMNS).collect())) == [(1, 0, 0, 0, 0, "", 0, 0), (2, 0, 0, 0, 0, "", 0, 0)]


def test_segments():
    text = "ab cd " * 50 + "  x" + "é ü " * 30
    parts = alignment.segments(text, 20)
    assert "".join(parts) == " " + text and len(parts) > 5 and all(p[0] == " " and p[1] != " " for p in parts[1:])
    assert alignment.segments("x" * 100, 20) == [" " + "x" * 100]
