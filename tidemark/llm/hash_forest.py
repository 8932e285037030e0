"""Nearest neighbours by a forest of sorted hash strings.

Every tree hashes a vector to a string of 62 bits, one a random plane, and holds its strings sorted, in blocks
of bounded size by their first bits. A query descends in the first trees to the longest prefix that strings
share with it, and ascends in them at once, a bit a step, until some thousand strings do. Their exact inner
products say how near its neighbours are at least, and so how long a prefix neighbours share in one of all
trees, with the probability asked for; there it ascends in all trees at once. All strings that share the
prefix, however many, are candidates and are ranked where they lie; what is less near than the neighbours known
by then stays there. On vectors in groups that
is a few; where a prefix is so short that all trees together would hold more than every vector, as on
vectors without any structure, every vector is compared once instead.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import staged

TREES, FIRST_TREES, BITS, SEED = 10, 4, 62, 11
ENOUGH = 4096  # strings in the first trees
RECALL = 0.92  # probability that the last of the neighbours shares the prefix in some tree
BLOCK, QUERIES = 4096, 1024  # strings, and queries, that one task compares at once
MOST_CELL_BITS = 40  # bits that a block's strings share at most
_CELL = ["size", "tree", "cell"]
_FOUND = "query long, class long, low long, score double"


@lru_cache(maxsize=8)
def planes(size: int) -> np.ndarray:
    """The planes of all trees, for vectors of ``size`` numbers and one more; those of a set are at right angles."""
    rng, rows = np.random.default_rng([SEED, size]), []
    if size > 4096:
        return rng.standard_normal((TREES * BITS, size + 1)) / math.sqrt(size + 1)
    while sum(map(len, rows)) < TREES * BITS:
        q, r = np.linalg.qr(rng.standard_normal((size + 1, size + 1)))
        rows.append((q * np.sign(np.diag(r))).T)
    return np.concatenate(rows)[: TREES * BITS]


def norms(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(1)
    return top * np.sqrt(((x / top[:, None]) ** 2).sum(1))


def hash_strings(x: np.ndarray, largest: float | None) -> np.ndarray:
    """A row of ``TREES`` hash strings for each vector; ``largest`` is the largest norm of stored vectors, None for queries.

    Stored vectors get a component that makes all norms equal, queries a zero: the nearest direction then has the largest inner product."""
    x = x / (largest if largest is not None else norms(x)[:, None])
    more = np.sqrt(np.maximum(0.0, 1 - (x**2).sum(1))) if largest is not None else np.zeros(len(x))
    signs = (np.column_stack([x, more]) @ planes(x.shape[1]).T > 0).reshape(len(x), TREES, BITS)
    return signs @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def level_for(cosine: float, trees: int, wanted: float) -> int:
    """The longest prefix that a vector at this cosine shares with a query in one of ``trees`` trees with probability ``wanted``."""
    same = 1 - math.acos(min(1.0, max(-1.0, cosine))) / math.pi
    one = 1 - (1 - wanted) ** (1 / trees)
    if same >= 1 - 1e-12:
        return BITS
    return 0 if same <= 0 else max(0, min(BITS, math.floor(math.log(one) / math.log(same))))


def _matrix(vectors, size: int) -> np.ndarray:
    """Vectors of ``size`` numbers from their bytes, as doubles."""
    raw = b"".join(vectors.to_pylist())
    return np.frombuffer(raw, "<f4" if len(raw) == 4 * size * len(vectors) else "<f8").reshape(-1, size).astype(np.float64)


def _numbers(batches):
    """Rows that have an inner product with others, their vector as bytes in its own width."""
    for b in batches:
        lists = b.column(1)
        sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
        for size in np.unique(sizes[sizes > 0]):
            part = b.take(pa.array(np.flatnonzero(sizes == size)))
            flat = part.column(1).flatten()
            flat = flat if flat.type == pa.float32() else flat.cast(pa.float64())
            bare = flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, size).any(1)
            x = flat.to_numpy(zero_copy_only=False).reshape(-1, size)
            rows = np.flatnonzero(np.isfinite(x).all(1) & x.any(1) & ~bare)
            ids = part.column(0).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(rows), size, np.int32)), pa.array([v.tobytes() for v in x[rows] + x.dtype.type(0)], pa.binary())], names=["vec_id", "size", "vector"])


def _by_size(batches, most: int = 2048):
    """Rows of one vector length each, and their vectors."""
    for b in batches:
        for at in range(0, len(b), most):
            part = b.slice(at, most)
            sizes = part.column("size").to_numpy()
            for size in np.unique(sizes):
                own = part.take(pa.array(np.flatnonzero(sizes == size)))
                yield int(size), own, _matrix(own.column("vector"), int(size))


def _norms(batches):
    for size, own, x in _by_size(batches):
        yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([len(own)], pa.int64()), pa.array([float(norms(x).max())])], names=["size", "n", "norm"])


def _hashed(bits: dict[int, int], largest: dict[int, float] | None, trees: range, keep: list[str]):
    """Each vector in each of ``trees``, with its hash string and the cell of that."""
    def run(batches):
        for size, own, x in _by_size(batches):
            keys = hash_strings(x, largest and largest[size])[:, trees.start : trees.stop].T.ravel()
            take = pa.array(np.tile(np.arange(len(own)), len(trees)))
            tree = np.repeat(np.array(trees, np.int32), len(own))
            yield pa.RecordBatch.from_arrays([*(own.column(c).take(take) for c in keep), pa.array(tree), pa.array(keys), pa.array(keys >> (BITS - bits[size]))], names=[*keep, "tree", "key", "cell"])
    return run


def prefix_range(keys: np.ndarray, asked: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the strings that share the first ``level`` bits of each asked one begin and end in sorted ``keys``."""
    low = (asked >> (BITS - level)) << (BITS - level)
    return np.searchsorted(keys, low), np.searchsorted(keys, low + ((1 << (BITS - level)) - 1), "right")


def _descend(bits: dict[int, int]):
    """In one block: for each query, how many strings share its prefix, for each length from the cell's on."""
    def run(stored: pa.Table, asking: pa.Table) -> pa.Table:
        keys, asked = np.sort(stored.column("key").to_numpy()), asking.column("key").to_numpy()
        counts = np.zeros((len(asked), BITS + 1), np.int64)
        for level in range(bits[stored.column("size")[0].as_py()] if len(keys) and len(asked) else BITS + 1, BITS + 1):
            low, high = prefix_range(keys, asked, level)
            if not (high > low).any():
                break
            counts[:, level] = high - low
        sizes = np.arange(len(asked) + 1, dtype=np.int32) * (BITS + 1)
        return pa.table({"class": asking.column("class"), "counts": pa.ListArray.from_arrays(pa.array(sizes), pa.array(counts.ravel()))})
    return run


def _near_top(scores: np.ndarray, k: int) -> np.ndarray:
    """Whether a score is among its row's ``k`` largest, or so near the last of them that rounding may decide."""
    if scores.shape[1] <= k:
        return np.ones(scores.shape, bool)
    last = -np.partition(-scores, k - 1, 1)[:, k - 1 : k]
    return (scores >= last) | (scores >= last - 1e-9 * np.abs(scores).max(1, keepdims=True))


def best_of(q: np.ndarray, x: np.ndarray, low: np.ndarray, classes: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of queries and of vectors, and exact inner products, of each query's ``k`` best that reach ``least``; ties go to the smaller ``low``."""
    scores = q @ x.T
    row, col = np.nonzero(_near_top(scores, k) & (scores >= (least - 1e-9 * np.abs(scores).max(1))[:, None]))
    exact = np.concatenate([(q[row[i : i + 65_536]] * x[col[i : i + 65_536]]).sum(1) for i in range(0, len(row) or 1, 65_536)])
    order = np.lexsort((classes[col], low[col], -exact, row))
    row, col, exact = row[order], col[order], exact[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k], exact[place < k]


def _rank(k: int):
    """In one block: each query's best among the strings that share its prefix."""
    def run(stored: pa.Table, asking: pa.Table) -> pa.Table:
        out = [pa.table({"query": pa.array([], pa.int64()), "class": pa.array([], pa.int64()), "low": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})]
        if len(stored) and len(asking):
            stored = stored.take(pa.array(np.argsort(stored.column("key").to_numpy(), kind="stable")))
            keys, classes, lows = (stored.column(c).to_numpy() for c in ("key", "class", "low"))
            size = stored.column("size")[0].as_py()
            x, q = _matrix(stored.column("vector"), size), _matrix(asking.column("vector"), size)
            asked, levels, who, least = (asking.column(c).to_numpy() for c in ("key", "level", "class", "least"))
            ends = np.zeros((len(asked), 2), np.int64)
            for level in np.unique(levels):  # one above the cell's takes the whole block
                here = levels == level
                ends[here] = np.column_stack(prefix_range(keys, asked[here], int(level)))
            ranges, which = np.unique(ends, axis=0, return_inverse=True)
            for i, (a, z) in enumerate(ranges.tolist()):
                if z > a:
                    here = np.flatnonzero(which.ravel() == i)
                    row, col, score = best_of(q[here], x[a:z], lows[a:z], classes[a:z], least[here], k)
                    out.append(pa.table({"query": pa.array(who[here[row]]), "class": pa.array(classes[a + col]), "low": pa.array(lows[a + col]), "score": pa.array(score)}))
        return pa.concat_tables(out)
    return run


def _first(rows: DataFrame, key: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each key; what a task can leave out goes before the shuffle."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("_n") <= k).drop("_n")


def _best(found: DataFrame, k: int) -> DataFrame:
    """A query's ``k`` best classes; trees may have found one several times."""
    once = found.groupBy("query", "class", "low").agg(F.max("score").alias("score"))
    return _first(once, ["query"], [F.desc("score"), "low", "class"], k)


class Forest:
    """Classes of equal vectors in all trees. Vectors of each length have trees of their own."""

    def __init__(self, classes: DataFrame):
        self.classes, self.spark = classes, classes.sparkSession
        facts = classes.mapInArrow(_norms, "size int, n long, norm double").groupBy("size").agg(F.sum("n").alias("n"), F.max("norm").alias("norm")).collect()
        self.largest = {r["size"]: r["norm"] for r in facts}
        self.bits = {r["size"]: min(MOST_CELL_BITS, max(0, math.ceil(math.log2(r["n"] / BLOCK)))) for r in facts}
        self.cells = staged(self.strings(range(TREES)).groupBy(*_CELL).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "cells")

    def per_size(self, values: dict):
        return F.element_at(F.create_map(*(F.lit(v) for kv in values.items() for v in kv)), F.col("size")) if values else F.lit(None)

    def strings(self, trees: range, *more: str) -> DataFrame:
        keep = ["class", "size", *more]
        types = {f.name: f.dataType.simpleString() for f in self.classes.schema}
        schema = ", ".join(f"{c} {types[c]}" for c in keep) + ", tree int, key long, cell long"
        return self.classes.select("class", "size", "low", "vector").mapInArrow(_hashed(self.bits, self.largest, trees, keep), schema)

    def asked(self, queries: DataFrame, trees: range) -> DataFrame:
        schema = "class long, size int, vector binary, tree int, key long, cell long"
        return queries.select("class", "size", "vector").mapInArrow(_hashed(self.bits, None, trees, ["class", "size", "vector"]), schema)

    def meet(self, strings: DataFrame, asking: DataFrame, compare, schema: str) -> DataFrame:
        """Strings and queries of equal cells, block by block, ``QUERIES`` queries at once, about. Cells of many strings, as of near copies, have many blocks."""
        asking = asking.join(self.cells, _CELL).withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).drop("blocks")
        asking = staged(asking, "asking")
        block = [*_CELL, "block"]
        parts = staged(asking.groupBy(*block).agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts")), "parts")
        asking = asking.join(parts, block).withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")).drop("parts")
        strings = strings.join(self.cells, _CELL).withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")).drop("blocks")
        strings = strings.join(parts, block).withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).drop("parts")
        key = [*block, "part"]
        return strings.groupBy(*key).cogroup(asking.groupBy(*key)).applyInArrow(compare, schema)

    def descend(self, queries: DataFrame, trees: range, enough: int) -> DataFrame:
        """``class, level``: the longest prefix that ``enough`` strings of ``trees`` together share, the cell's if none does."""
        counts = self.meet(self.strings(trees), self.asked(queries, trees).drop("vector"), _descend(self.bits), "class long, counts array<long>")
        counts = counts.groupBy("class").agg(F.array(*(F.sum(F.col("counts")[i]) for i in range(BITS + 1))).alias("counts"))
        level = F.expr(f"array_max(filter(sequence(0, {BITS}), i -> counts[i] >= {enough}))")
        return queries.join(counts, "class", "left").select("class", F.coalesce(level, self.per_size(self.bits)).cast("int").alias("level"))

    def ascend(self, queries: DataFrame, trees: range, k: int) -> DataFrame:
        """The ``k`` best, of ``least`` or more, of the strings that share ``level`` bits with a query in some tree; a level of 0 takes the first tree, that is, all strings."""
        asked = self.asked(queries, trees).join(queries.select("class", "level", "least"), "class").filter("level > 0 or tree = 0")
        asked = asked.withColumn("gap", F.greatest(F.lit(0), self.per_size(self.bits) - F.col("level")))
        first = F.expr("shiftleft(shiftright(cell, gap), gap)")  # a prefix shorter than a cell's is that of several cells
        asked = asked.withColumn("cell", F.explode(F.sequence(first, first + F.expr("shiftleft(1L, gap)") - 1))).drop("gap")
        return self.meet(self.strings(trees, "low", "vector"), asked, _rank(k), _FOUND)


def vector_classes(rows: DataFrame, k: int, every: int) -> DataFrame:
    """Equal vectors as one class: ``class, size, vector, low, ids, asks`` with its ``k`` + 1 smallest ids; ``asks`` says whether one is a query."""
    few = _first(rows.withColumn("asks", F.pmod("vec_id", F.lit(every)) == 0), ["size", "vector"], ["vec_id"], k + 1)
    asking = rows.filter(F.pmod("vec_id", F.lit(every)) == 0).select("size", "vector").distinct().withColumn("asks", F.lit(True))
    classes = few.groupBy("size", "vector").agg(F.min("vec_id").alias("low"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    classes = classes.join(asking, ["size", "vector"], "left").withColumn("class", F.monotonically_increasing_id())
    return staged(classes.select("class", "size", "vector", "low", "ids", F.coalesce("asks", F.lit(False)).alias("asks")), "classes")


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, recall: float = RECALL) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each row whose vec_id is divisible by ``every``.

    Nearest is the largest inner product in double precision, ties go to the smaller vec_id. Candidates are all rows
    but those of the query's own id, and of its vector's length. Null, empty and zero vectors and those with null or
    non-finite components take no part, nor does a null vec_id; repeated rows count once; an id of several vectors
    asks with each of them and gets the best; other columns are ignored; an empty table gives no rows.
    ``recall`` is the probability with which the last of a query's neighbours is to be found, were planes drawn anew.
    """
    able = vectors.filter("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rows = staged(able.mapInArrow(_numbers, "vec_id long, size int, vector binary").distinct(), "vectors")
    classes = vector_classes(rows, k, every)
    forest, queries = Forest(classes), classes.filter("asks")
    some = range(FIRST_TREES)
    reached = staged(forest.descend(queries, some, max(ENOUGH, 2 * k)), "levels")
    found = staged(forest.ascend(queries.join(reached, "class").withColumn("least", F.lit(float("-inf"))), some, k + 1), "found")
    last = _best(found, k + 1).groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("score"))
    after = reached.join(last, F.col("class") == F.col("query"), "left").join(queries.select("class", "size", "vector"), "class")
    after = after.mapInArrow(_next_level(forest.largest, k, recall), "class long, level int, least double")
    more = queries.join(staged(after, "levels"), "class")
    found = found.union(forest.ascend(more, range(TREES), k + 1))
    return _answers(_best(found, k + 1), rows, classes, k, every)


def _next_level(largest: dict[int, float], k: int, recall: float):
    """How long a prefix neighbours share that are as near as the last one found, and how near that is; queries that went there already have no row."""
    def run(batches):
        for size, own, x in _by_size(batches):
            out, reach = [], norms(x) * largest[size]
            for i, (c, level, n, score) in enumerate(zip(*(own.column(name).to_pylist() for name in ("class", "level", "n", "score")), strict=True)):
                if (n or 0) <= k:
                    out.append((c, 0, -math.inf))
                elif level > level_for(score / reach[i], FIRST_TREES, recall):
                    then = level_for(score / reach[i], TREES, recall)
                    out.append((c, then if 1 << then > TREES else 0, score))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.float64())], names=["class", "level", "least"])
    return run


def _answers(best: DataFrame, rows: DataFrame, classes: DataFrame, k: int, every: int) -> DataFrame:
    """Classes become ids again; each query leaves out its own."""
    near = best.join(classes.select("class", "ids"), "class").select("query", "score", F.explode("ids").alias("vec_id"))
    near = _first(near.groupBy("query", "vec_id").agg(F.max("score").alias("score")), ["query"], [F.desc("score"), "vec_id"], k + 1)
    near = near.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id", "score"))).alias("near"))
    near = near.join(classes.filter("asks").select(F.col("class").alias("query"), "size", "vector"), "query")
    asks = rows.filter(F.pmod("vec_id", F.lit(every)) == 0).join(near, ["size", "vector"])
    each = asks.select(F.col("vec_id").alias("query_id"), F.explode(F.expr(f"slice(filter(near, x -> x.vec_id <> vec_id), 1, {k})")).alias("x"))
    each = each.groupBy("query_id", F.col("x.vec_id").alias("vec_id")).agg(F.max("x.score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", place.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_nearest(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every twentieth vector."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
