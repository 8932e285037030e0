"""Alignment of two tokenisers' tokens by the bytes they stand for, and what tokens meet across a corpus.

Ends of tokens are running sums of their byte counts; ends that both have cut a text into groups
(``intersect1d``), a token's group is found by ``searchsorted``, and links come from repeating each token
by the number of tokens it overlaps. Documents are taken in blocks: a block numbers its different pairs, and
each document keeps those numbers, so a pair leaves a block once, however often it occurs. Pairs are
summed in two shuffles, the first with a salt, and the sums go back to the blocks that hold the pair.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import staged
from tidemark.llm.tokens import encoder, piece_encoder, vocabulary

VOCABULARY_A, VOCABULARY_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
RUN, BLOCK = 500_000, 8_000_000  # characters that are aligned at once, and those of a block, about
SALTS = 16
_STEP = 1 << 16  # tokens that are spelled at once
_CUT = re.compile(r"(?<=\w) (?=\w)")  # no token of either kind holds such a space and what stands before it
_SCHEMA = ("block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string,"
           " own binary, times binary, pair array<long>, n array<long>")
_NAMES = [c.split()[0] for c in _SCHEMA.split(", ")]


class TokenBytes:
    """The bytes of each id of a vocabulary."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def spell(self, ids: np.ndarray, raw: bytes) -> bool:
        """Whether the bytes of ``ids`` are those of ``raw``."""
        own, at = np.frombuffer(raw, np.uint8), 0
        if int(self.sizes[ids].sum()) != len(own):
            return False
        for i in range(0, len(ids), _STEP):
            part = ids[i : i + _STEP]
            size = self.sizes[part]
            ends = np.cumsum(size)
            spelled = self.flat[np.repeat(self.starts[part] - (ends - size), size) + np.arange(ends[-1])]
            if not np.array_equal(spelled, own[at : at + len(spelled)]):
                return False
            at += len(spelled)
        return True


def byte_level_tokens(vocab: dict[str, int]) -> list[bytes]:
    """Bytes by id; each character of a token stands for a byte: printable ones for themselves, the others, in order, for 256 and up."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    tokens = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        tokens[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
    return tokens


def piece_tokens(model) -> list[bytes]:
    """Bytes by id of a SentencePiece model."""
    pieces = map(model.id_to_piece, range(model.get_piece_size()))
    return [bytes([int(p[3:-1], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = encoder(path_a), piece_encoder(path_b)
        self.bytes_a = TokenBytes(byte_level_tokens(self.a.tokenizer.get_vocab()))
        self.bytes_b = TokenBytes(piece_tokens(self.b.model))
        self.names = np.array([str(i) for i in range(max(len(self.bytes_a.sizes), len(self.bytes_b.sizes)))], object)

    def align(self, texts: list[str]) -> list[tuple | None]:
        """For each text (its space before it): tokens of A and of B, groups, links, groups as text, pairs and how often
        each is linked; None where tokens don't spell the text."""
        a, b = self.a.encode(texts), self.b.encode(texts)
        raw = [t.encode() for t in texts]
        good = [i for i, r in enumerate(raw) if self.bytes_a.spell(a[i], r) and self.bytes_b.spell(b[i], r)]
        out: list[tuple | None] = [None] * len(texts)
        if not good:
            return out
        ids_a, ids_b = (np.concatenate([x[i] for i in good]).astype(np.int64) for x in (a, b))
        last_a, last_b = (np.cumsum([len(x[i]) for i in good]) for x in (a, b))
        ends_a, ends_b = np.cumsum(self.bytes_a.sizes[ids_a]), np.cumsum(self.bytes_b.sizes[ids_b])
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        first = np.searchsorted(ends_b, ends_a - self.bytes_a.sizes[ids_a], "right")
        count = np.searchsorted(ends_b, ends_a) - first + 1
        upto = np.cumsum(count)
        link_b = np.repeat(first - (upto - count), count) + np.arange(upto[-1])
        pairs = (np.repeat(ids_a, count) << 32) | ids_b[link_b]
        words = self._words(ids_a, ids_b, group_a, group_b)
        begin = np.zeros(4, np.int64)
        for i, za, zb in zip(good, last_a.tolist(), last_b.tolist(), strict=True):
            end = np.array([za, zb, group_a[za - 1] + 1, upto[za - 1]])
            own, times = np.unique(pairs[begin[3] : end[3]], return_counts=True)
            said = "".join(words[2 * (begin[0] + begin[1]) : 2 * (za + zb) - 1])
            out[i] = (*(end - begin).tolist(), said, own, times)
            begin = end
        return out

    def _words(self, ids_a, ids_b, group_a, group_b) -> list[str]:
        """Ids and what follows each, group by group."""
        n = len(ids_a) + len(ids_b)
        at_a = np.arange(len(ids_a)) + np.searchsorted(group_b, group_a)
        at_b = np.arange(len(ids_b)) + np.searchsorted(group_a, group_b, "right")
        words = np.empty(2 * n, object)
        words[2 * at_a], words[2 * at_b] = self.names[ids_a], self.names[ids_b]
        words[1::2] = ","
        words[2 * at_a[np.append(group_a[1:] != group_a[:-1], True)] + 1] = "|"
        words[2 * at_b[np.append(group_b[1:] != group_b[:-1], True)] + 1] = ";"
        return words.tolist()


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def segments(text: str, size: int = RUN) -> list[str]:
    """A text with the space before it, cut where no token of either kind can cross the cut; a text without such places stays whole."""
    text, out, at = " " + text, [], 0
    while len(text) - at > size and (cut := _CUT.search(text, at + size)):
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]]


def _packed(x: np.ndarray) -> bytes:
    """Integers in the least of one, two or four bytes, with that size before them."""
    size = next(s for s in (1, 2, 4) if not len(x) or int(x.max()) < 1 << 8 * s)
    return bytes([size]) + x.astype(f"<u{size}").tobytes()


def _unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"<u{x[0]}", offset=1)


class _Block:
    """Documents of a block, until their pairs are numbered."""

    def __init__(self, number: int, keep_groups: bool):
        self.number, self.keep, self.docs, self.size = number, keep_groups, [], 0

    def add(self, doc_id, parts: list[tuple | None]) -> None:
        if not parts or None in parts:
            self.docs.append((doc_id, 0, 0, 0, 0, "", "", np.zeros(0, np.int64), np.zeros(0, np.int64)))
            return
        sha = hashlib.sha256()
        for i, p in enumerate(parts):
            sha.update((";" * (i > 0) + p[4]).encode())
        own, times = parts[0][5:]
        if len(parts) > 1:
            own, which = np.unique(np.concatenate([p[5] for p in parts]), return_inverse=True)
            times = np.bincount(which, np.concatenate([p[6] for p in parts])).astype(np.int64)
        self.docs.append((doc_id, *(sum(p[k] for p in parts) for k in range(4)), sha.hexdigest(), ";".join(p[4] for p in parts) if self.keep else None, own, times))

    def rows(self) -> pa.RecordBatch:
        """One row a document, then one with the block's pairs and their numbers of links."""
        pairs, number = np.unique(np.concatenate([d[7] for d in self.docs]), return_inverse=True)
        n = np.bincount(number, np.concatenate([d[8] for d in self.docs]), len(pairs)).astype(np.int64)
        cuts = np.cumsum([0, *(len(d[7]) for d in self.docs)])
        own = [_packed(number[a:z]) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
        columns = [[self.number] * len(self.docs), *([d[k] for d in self.docs] for k in range(7)), own, [_packed(d[8]) for d in self.docs], [None] * len(self.docs), [None] * len(self.docs)]
        columns = [[*c, None] for c in columns[:-2]] + [[*c, x] for c, x in zip(columns[-2:], (pairs, n), strict=True)]
        columns[0][-1] = self.number
        types = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.binary()] * 2 + [pa.list_(pa.int64())] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=_NAMES)


def _align(path_a: str, path_b: str, keep_groups: bool, run: int, block_size: int):
    def go(batches):
        own, task = aligner(path_a, path_b), TaskContext.get().partitionId()
        block, waiting, size = _Block(task << 32, keep_groups), [], 0

        def flush():
            found = iter(own.align([s for _, parts in waiting for s in parts]))
            for doc_id, parts in waiting:
                block.add(doc_id, [next(found) for _ in parts])
            waiting.clear()

        for batch in batches:
            for i in range(len(batch)):
                doc_id, text = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                parts = segments(text, run) if text else []
                if len(parts) > 1:  # a long text is aligned part by part
                    block.add(doc_id, [own.align([p])[0] for p in parts])
                    block.size += len(text)
                else:
                    waiting.append((doc_id, parts))
                    size += len(text or "")
                if size >= run:
                    flush()
                    block.size, size = block.size + size, 0
                if block.size >= block_size:
                    flush()
                    yield block.rows()
                    block = _Block(block.number + 1, keep_groups)
        flush()
        if block.docs:
            yield block.rows()
    return go


def aligned_blocks(docs: DataFrame, tokenizer_a: str = VOCABULARY_A, tokenizer_b: str = VOCABULARY_B, with_groups: bool = False, run: int = RUN, block: int = BLOCK) -> DataFrame:
    """A staged table of blocks: rows of documents, and one row a block with its pairs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return staged(docs.mapInArrow(_align(vocabulary(tokenizer_a), vocabulary(tokenizer_b), with_groups, run, block), _SCHEMA), "aligned")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``pair, links, best`` of a corpus: a pair is A's id times 2 ** 32 plus B's; ``best`` is the most links that any pair of its B id has."""
    rows = blocks.filter("pair is not null").select("block", F.explode(F.arrays_zip("pair", "n")).alias("p"))
    part = rows.groupBy(F.col("p.pair").alias("pair"), F.pmod("block", F.lit(SALTS)).alias("salt")).agg(F.sum("p.n").alias("n"))
    total = staged(part.groupBy("pair").agg(F.sum("n").alias("links")).withColumn("b", F.expr("pair % 4294967296")), "pairs")
    return total.join(total.groupBy("b").agg(F.max("links").alias("best")), "b").select("pair", "links", "best")


def _sums(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """Each document of a block with the sums over its links."""
    links, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
    at = pairs.column("number").to_numpy()
    links[at], best[at] = pairs.column("links").to_numpy(), pairs.column("is_best").to_numpy(zero_copy_only=False)
    n_best, count_sum = [], []
    for own, times in zip(docs.column("own"), docs.column("times"), strict=True):
        own, times = _unpacked(own.as_py()), _unpacked(times.as_py()).astype(np.int64)
        n_best.append(int(times[best[own]].sum()))
        count_sum.append(int((times * links[own]).sum()))
    return docs.drop_columns(["block", "own", "times"]).append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))


def align_tokens(docs: DataFrame, tokenizer_a: str = VOCABULARY_A, tokenizer_b: str = VOCABULARY_B, with_groups: bool = False, run: int = RUN, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum`` of each document; ``groups`` too if asked for.

    A null or empty text, or one whose tokens of either kind don't spell it, has no tokens: zeros and ''.
    Repeated rows count for themselves; a null doc_id stays; other columns are ignored; an empty table gives no
    rows. Long texts are aligned in parts that no token crosses; blocks bound what a task holds. A block gives a
    pair once, so no pair can hold more of the shuffled rows than one in a block's number of pairs.
    """
    blocks = aligned_blocks(docs, tokenizer_a, tokenizer_b, with_groups, run, block)
    own = blocks.filter("pair is not null").select("block", F.posexplode("pair").alias("number", "pair"))
    back = own.join(pair_counts(blocks), "pair").select(F.col("block").alias("of"), "number", "links", (F.col("links") == F.col("best")).alias("is_best"))
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *(["groups"] if with_groups else [])]
    rows = blocks.filter("pair is null").select("block", *kept, "own", "times")
    fields = {f.name: f.dataType.simpleString() for f in blocks.schema}
    schema = ", ".join(f"{c} {fields[c]}" for c in kept) + ", n_best long, count_sum long"
    return rows.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(_sums, schema)


def op13_align(spark, sf_dir: str) -> DataFrame:
    """Each document's tokens, groups and links of the byte-level and the piece vocabulary."""
    return align_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
