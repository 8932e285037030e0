"""Near-duplicate vectors by product quantisation.

Unit vectors of equal label and bits are one class. Coarse centres part all classes into inverted lists;
residuals are stored as subspace codes with each one's exact coding error. A class is a query in every
list whose cell can hold a vector near enough (by its distance to the plane between the two centres);
there, table lookups give asymmetric distances, and what the distance less the coding error doesn't
rule out is decided by its cosine in double precision. Both bounds are safe, so no link is lost.
Lists are compared in blocks of bounded size; a block returns counts and a spanning forest, not pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import connected_components, staged

LEAST_COSINE = 0.93
SAMPLE = 16_384  # vectors that the centres and codebooks are fitted on, at most
MOST_LISTS, PARTS, CODES = 256, 8, 64
BLOCK = 2048  # stored vectors, and queries, in one block
_SLACK = 1e-6  # float32 rounding of distances


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * x @ centres.T, 1)


def k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """At most ``k`` centres; the first ones are spread evenly over the sample, empty ones stay where they are."""
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


class Quantiser:
    """Coarse centres and a codebook for each part of the residual."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.centres = k_means(sample, lists)
        rest = sample - self.centres[_nearest(sample, self.centres)]
        self.cuts = np.linspace(0, sample.shape[1], min(PARTS, sample.shape[1]) + 1).astype(int)
        self.books = [k_means(np.ascontiguousarray(rest[:, a:z]), CODES) for a, z in zip(self.cuts[:-1], self.cuts[1:], strict=True)]

    def cells(self, x: np.ndarray) -> np.ndarray:
        return _nearest(x, self.centres)

    def encode(self, x: np.ndarray, cell: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and how far each vector is from what its codes stand for."""
        rest = x - self.centres[cell]
        codes = np.stack([_nearest(rest[:, a:z], b) for a, z, b in zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True)], 1)
        back = np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], 1)
        return codes, np.sqrt(((rest - back) ** 2).sum(1))

    def distances(self, query: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of one exact query to all coded vectors of a list, by table lookups."""
        rest = query - self.centres[cell]
        total = np.zeros(len(codes))
        for i, (a, z, b) in enumerate(zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True)):
            total += ((b - rest[a:z]) ** 2).sum(1)[codes[:, i]]
        return np.sqrt(total)

    def probes(self, x: np.ndarray, cells: np.ndarray, reach: float) -> np.ndarray:
        """For each vector and list whether the list's cell comes within ``reach`` of it."""
        size = (self.centres**2).sum(1)
        d = (x**2).sum(1)[:, None] + size - 2 * x @ self.centres.T
        own = d[np.arange(len(x)), cells]
        kinds, which = np.unique(cells, return_inverse=True)
        apart = np.sqrt(np.maximum(0, size[kinds][:, None] + size - 2 * self.centres[kinds] @ self.centres.T))[which]
        return (d - own[:, None]) <= 2 * (reach + _SLACK) * apart + _SLACK


def _units(batches):
    """Rows whose vector can have a cosine, with its unit vector and a fingerprint of that."""
    for b in batches:
        lists = b.column(1)
        sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
        for size in np.unique(sizes[sizes > 0]):
            part = b.take(pa.array(np.flatnonzero(sizes == size)))
            flat = part.column(1).flatten()
            x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, size)
            with np.errstate(all="ignore"):
                top = np.abs(x).max(1)
                scaled = x / top[:, None]
                unit = scaled / np.sqrt((scaled**2).sum(1))[:, None]
            ok = np.isfinite(x).all(1) & (top > 0)
            rows = np.flatnonzero(ok)
            out = part.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [out.column(0), out.column(2), pa.array([u.tobytes() for u in unit[rows]], pa.binary())], names=["vec_id", "label", "unit"])


def _deal(quantisers, reach: float):
    """Each class as stored in its own list and as a query in every list that it has to look at."""
    def run(batches):
        for b in batches:
            for at in range(0, len(b), 1024):
                part = b.slice(at, 1024)
                units = part.column(1).to_pylist()
                sizes = np.array([len(u) for u in units])
                for size in np.unique(sizes):
                    rows = np.flatnonzero(sizes == size)
                    x = np.frombuffer(b"".join(units[i] for i in rows)).reshape(len(rows), -1)
                    first, q = quantisers.value.get(int(size), (0, None))
                    if q is not None:
                        cells = q.cells(x)
                        who, where = np.nonzero(q.probes(x, cells, reach))
                        cells, where = cells + first, where + first
                    else:  # a length that the sample doesn't have: one list of its own
                        cells = np.full(len(rows), -1 - size // 8)
                        who, where = np.arange(len(rows)), cells
                    take = np.concatenate([rows, rows[who]])
                    yield pa.RecordBatch.from_arrays(
                        [*(c.take(pa.array(take)) for c in part.columns), pa.array(np.concatenate([cells, where]).astype(np.int32)),
                         pa.array(np.arange(len(take)) < len(rows))],
                        names=["label", "unit", "vec_id", "copies", "cell", "stored"])
    return run


def _compare(quantisers, reach: float, least: float):
    """Of one block of stored vectors and one of queries: links of each query, and a forest of the linked."""
    def run(group: pa.Table) -> pa.Table:
        cell = group.column("cell")[0].as_py()
        stored = group.column("stored").to_numpy()
        ids, copies = group.column("vec_id").to_numpy(), group.column("copies").to_numpy()
        x = np.frombuffer(b"".join(group.column("unit").to_pylist())).reshape(len(ids), -1)
        s_ids, s_copies, s_x = ids[stored], copies[stored], x[stored]
        q_ids, q_x = ids[~stored], x[~stored]
        if not len(s_ids) or not len(q_ids):
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        first, q = quantisers.value.get(8 * x.shape[1], (0, None))
        if cell >= 0:
            cell -= first
            codes, error = q.encode(s_x, cell)
        u, v, n, joined = [], [], [], np.arange(len(s_ids))
        for k, (qid, vector) in enumerate(zip(q_ids.tolist(), q_x, strict=True)):
            near = np.flatnonzero(q.distances(vector, cell, codes) - error <= reach + _SLACK) if cell >= 0 else np.arange(len(s_ids))
            near = near[s_ids[near] != qid]
            if not len(near):
                continue
            near = near[(s_x[near] * vector).sum(1) >= least]
            if len(near):
                roots = np.unique(joined[near])
                joined[np.isin(joined, roots)] = roots[0]
                u += [qid] * len(roots)
                v += s_ids[roots].tolist()
                n += [int(s_copies[near].sum()), *[0] * (len(roots) - 1)]
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "n": pa.array(n, pa.int64())})
    return run


def link_vectors(vectors: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """``vec_id, n_links, component_id`` for each row (vec_id, embedding, label) of ``vectors``.

    Rows link when their labels are equal and not null and their cosine is at least ``least``. A vector that
    is null, empty or zero, or holds a null or a non-finite component, links with nothing and is its own
    component; vectors of different lengths don't link. Repeated rows are other vectors of the same id.
    Other columns are ignored; a null vec_id links with nothing; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    label_type = vectors.schema["label"].dataType.simpleString()
    able = rows.filter("vec_id is not null and label is not null and embedding is not null and not exists(embedding, x -> x is null)")
    units = staged(able.mapInArrow(_units, f"vec_id long, label {label_type}, unit binary"), "units")
    classes = staged(units.groupBy("label", "unit").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")), "classes")
    reach = math.sqrt(max(0.0, 2 - 2 * least))
    n = classes.count()
    if n == 0:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    # the sample is those of the smallest hashes, whatever the table's order
    picked = classes.filter(F.expr(f"pmod(xxhash64(vec_id), 1000000) <= {math.ceil(2e6 * SAMPLE / n)}")).select("vec_id", "unit")
    picked = picked.orderBy(F.xxhash64("vec_id")).limit(SAMPLE).collect()
    by_size, quantisers, first = {}, {}, 0
    for r in picked:
        by_size.setdefault(len(r["unit"]), []).append(np.frombuffer(r["unit"]))
    for size, sample in sorted(by_size.items()):  # vectors of each length have their own lists
        q = Quantiser(np.stack(sample), max(1, min(MOST_LISTS, int(math.sqrt(n * len(sample) / len(picked)) / 4))))
        quantisers[size] = (first, q)
        first += len(q.centres)
    quantisers = spark.sparkContext.broadcast(quantisers)

    dealt = classes.select("label", "unit", "vec_id", "copies").mapInArrow(
        _deal(quantisers, reach), f"label {label_type}, unit binary, vec_id long, copies long, cell int, stored boolean")
    dealt = staged(dealt, "lists")
    sizes = dealt.groupBy("label", "cell").agg(F.ceil(F.sum(F.col("stored").cast("int")) / BLOCK).cast("int").alias("sb"), F.ceil(F.sum((~F.col("stored")).cast("int")) / BLOCK).cast("int").alias("qb"))
    blocks = dealt.join(sizes.filter("sb > 0"), ["label", "cell"])
    own = F.pmod(F.xxhash64("vec_id"), F.when(F.col("stored"), F.col("sb")).otherwise(F.col("qb"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("stored"), F.col("qb")).otherwise(F.col("sb")) - 1)).alias("other")
    blocks = blocks.withColumn("own", own).select("*", other)
    blocks = blocks.select("label", "unit", "vec_id", "copies", "cell", "stored", F.when(F.col("stored"), F.col("own")).otherwise(F.col("other")).alias("s"), F.when(F.col("stored"), F.col("other")).otherwise(F.col("own")).alias("q"))
    found = blocks.groupBy("label", "cell", "s", "q").applyInArrow(_compare(quantisers, reach, least), "u long, v long, n long")
    found = staged(found, "links")
    # a repeated vec_id may stand for several classes; then its counts and components are shared
    counts = found.groupBy("u").agg(F.sum("n").alias("n"))
    components = connected_components(found.select("u", "v"))
    rep = classes.join(counts, F.col("vec_id") == F.col("u"), "left").drop("u").join(components, F.col("vec_id") == F.col("node"), "left")
    rep = rep.select("label", "unit", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    linked = units.join(rep, ["label", "unit"]).select("vec_id", "n_links", "component_id")
    alone = rows.select("vec_id").exceptAll(linked.select("vec_id"))
    return linked.union(alone.select("vec_id", F.lit(0).cast("long"), F.col("vec_id")))


def op7_near_vectors(spark, sf_dir: str) -> DataFrame:
    """Each vector's links and component."""
    linked = link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return linked.withColumn("kept", F.col("vec_id") == F.col("component_id"))


OP7_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
), l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), n AS (SELECT x, count(*) AS n FROM l GROUP BY 1),
r AS (SELECT vec_id AS x, vec_id AS c FROM embeddings UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.x),
m AS (SELECT x, min(c) AS c FROM r GROUP BY 1)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, m.c AS component_id, e.vec_id = m.c AS kept
FROM embeddings e LEFT JOIN n ON n.x = e.vec_id JOIN m ON m.x = e.vec_id
"""
