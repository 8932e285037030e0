"""A Merkle manifest of a dataset: one tree a source, and one over the sources' roots.

Leaves of a source stand in order, and every 16 consecutive nodes become one. A block holds the 4,096
leaves below one node of the third level, so blocks need nothing of each other: a DuckDB statement
in the task that has a block's Arrow table joins the digests of each run in order (``string_agg``) and
hashes them, level by level. Spark deals the blocks, builds the levels above them from their roots by the
same statement, and joins the proof of each block's root to the block; proofs of leaves never leave a task.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import staged

FAN, BLOCK_LEVELS = 16, 3
BLOCK = FAN**BLOCK_LEVELS
_HEX = 64  # characters of a digest
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NODE = "tree long, pos long, n long, node string"
_PATH = "array<struct<before string, after string>>"


def field_digest(columns: list[Column]) -> Column:
    """sha256 of fields: ``-`` for null, else the UTF-8 byte count, a colon and the value."""
    def one(c: Column) -> Column:
        s = c.cast("string")
        return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))
    return F.sha2(F.concat(*map(one, columns)), 256)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaves(docs: DataFrame, changed: Column, text: Column) -> DataFrame:
    """``source, doc_id, leaf, given``: ``given`` is the leaf with ``text`` for its text where ``changed`` holds."""
    fields = [F.col(c) for c in FIELDS]
    given = F.when(changed, field_digest([*fields[:-1], text]))
    return docs.select("source", "doc_id", field_digest(fields).alias("leaf"), given.alias("given")).select(
        "source", "doc_id", "leaf", F.coalesce("given", "leaf").alias("given"))


def ranked(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``pos``: each row's place, from 0, among the rows of its ``keys``, which may hold nulls.

    Rows are dealt by ranges of keys and order together, so one key fills many tasks; equal rows are told
    apart by a number, so they do too. Places are sums of the tasks' counts, one row a task and key.
    """
    by = [*keys, *order, "_apart"]
    rows = rows.withColumn("_apart", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    rows = staged(rows.drop("_apart").select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), "ranked")
    counts = rows.groupBy("_part", *keys).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).drop("_n", "_first")
    for k in keys:
        counts = counts.withColumnRenamed(k, f"_{k}_")
    same = F.col("_part") == F.col("_of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}_"))
    placed = rows.join(counts.withColumnRenamed("_part", "_of"), same).withColumn("pos", F.col("_base") + F.col("_at"))
    return placed.drop("_part", "_of", "_at", "_base", *(f"_{k}_" for k in keys))


def levels_of(n: int) -> int:
    """Levels above ``n`` nodes until one is left, at most those of a block."""
    k = 0
    while k < BLOCK_LEVELS and FAN**k < n:
        k += 1
    return k


@lru_cache(maxsize=1)
def _duck():
    import duckdb

    return duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB"})


def _run(sql: str, block: pa.Table, parameters: list[str] = ()) -> pa.Table:
    con = _duck()
    con.register("block", block)
    try:
        return con.sql(sql, params=list(parameters)).to_arrow_table()
    finally:
        con.unregister("block")


def _levels_sql(depth: int) -> str:
    """Tables r0 (nodes by place) to r<depth>: a run's digests in order as ``s``, and their digest ``h``."""
    parts = [f"r0 AS (SELECT pos % {BLOCK} AS i, node AS h FROM block)"]
    for k in range(1, depth + 1):
        parts.append(f"r{k} AS (SELECT i // {FAN} AS i, string_agg(h, '' ORDER BY i) AS s, sha256(string_agg(h, '' ORDER BY i)) AS h FROM r{k - 1} GROUP BY 1)")
    return "WITH " + ", ".join(parts)


def _sides_sql(depth: int) -> tuple[str, str]:
    """The digests before and after a node in its run, for each level, and the joins that give them."""
    sides = "".join(
        f", left(r{k + 1}.s, (b.pos // {FAN**k} % {FAN} * {_HEX})::INT) AS l{k}, substr(r{k + 1}.s, (b.pos // {FAN**k} % {FAN} * {_HEX} + {_HEX + 1})::INT) AS a{k}" for k in range(depth))
    joins = "".join(f" JOIN r{k + 1} ON r{k + 1}.i = b.pos % {BLOCK} // {FAN ** (k + 1)}" for k in range(depth))
    return sides, joins


def _roots(block: pa.Table) -> pa.Table:
    """The one node that a block's nodes become."""
    first = block.slice(0, 1).to_pylist()[0]
    depth = levels_of(first["n"])
    node = _run(f"{_levels_sql(depth)} SELECT h FROM r{depth}", block).column(0).cast(pa.string())
    return pa.table({"tree": pa.array([first["tree"]], pa.int64()), "pos": pa.array([first["pos"] // BLOCK], pa.int64()), "n": pa.array([-(-first["n"] // BLOCK)], pa.int64()), "node": node})


def _paths(block: pa.Table, above: pa.Table) -> pa.Table:
    """The siblings of each node of a block up to the tree's root, and that root."""
    depth = levels_of(block.column("n")[0].as_py()) if len(block) else 0
    sides, joins = _sides_sql(depth)
    own = "[" + ", ".join(f"{{'before': l{k}, 'after': a{k}}}" for k in range(depth)) + f"]::{_DUCK_PATH}"
    rows = _run(f"{_levels_sql(depth)}, p AS (SELECT b.tree, b.pos{sides} FROM block b{joins}) SELECT tree, pos, {own} AS path FROM p", block).to_pylist()
    up = above.to_pylist()[0]
    return pa.Table.from_pylist([{"tree": r["tree"], "pos": r["pos"], "root": up["root"], "path": r["path"] + up["path"]} for r in rows], schema=_PATH_SCHEMA)


_DUCK_PATH = 'STRUCT("before" VARCHAR, "after" VARCHAR)[]'
_PATH_SCHEMA = pa.schema([("tree", pa.int64()), ("pos", pa.int64()), ("root", pa.string()), ("path", pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())])))])


def _block_of(rows: DataFrame) -> DataFrame:
    return rows.withColumn("block", F.expr(f"pos div {BLOCK}"))


def block_roots(nodes: DataFrame) -> DataFrame:
    """The nodes (``tree, pos, n, node``; ``n`` is the tree's number of nodes) one block level up."""
    return _block_of(nodes).groupBy("tree", "block").applyInArrow(_roots, _NODE)


def climb(nodes: DataFrame) -> DataFrame:
    """``tree, pos, root, path`` of nodes: all digests beside the way to the root, from below.

    Each round is 4,096 times smaller than the one below it, and is written to the shared folder."""
    if nodes.filter("n > 1").isEmpty():
        return nodes.select("tree", "pos", F.col("node").alias("root"), F.expr(f"cast(array() as {_PATH})").alias("path"))
    above = climb(staged(block_roots(nodes), "nodes")).select("tree", F.col("pos").alias("block"), "root", "path")
    found = _block_of(nodes).groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInArrow(_paths, f"tree long, pos long, root string, path {_PATH}")
    return staged(found, "paths")


def _proofs(block: pa.Table, above: pa.Table) -> pa.Table:
    """What each leaf's proof hashes to, and the root that the given leaf folds to."""
    depth = levels_of(block.column("n")[0].as_py())
    up = above.to_pylist()[0]
    sides, joins = _sides_sql(depth)
    sql = f"{_levels_sql(depth)}, f0 AS (SELECT b.doc_id, b.node, b.given AS f{sides} FROM block b{joins})"
    for k in range(depth):
        sql += f", f{k + 1} AS (SELECT * EXCLUDE f, sha256(l{k} || f || a{k}) AS f FROM f{k})"
    steps, parameters = depth, []
    for step in up["path"]:
        sql += f", f{steps + 1} AS (SELECT * EXCLUDE f, sha256(? || f || ?) AS f FROM f{steps})"
        parameters += [step["before"], step["after"]]
        steps += 1
    beside = " || ".join([*(f"l{k} || a{k}" for k in range(depth)), "?"])
    beyond = "".join(s["before"] + s["after"] for s in up["path"])
    sql += f" SELECT doc_id, node AS leaf, ? AS subroot, ? AS root, sha256({beside}) AS proof_sha256, f AS folded_root, f = ? AS verified FROM f{steps}"
    out = _run(sql, block, [*parameters, up["subroot"], up["root"], beyond, up["root"]])
    return out.cast(_PROOF_SCHEMA)


_PROOF_SCHEMA = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), ("verified", pa.bool_())])


def merkle_manifest(rows: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` for rows of :func:`leaves`.

    Null sources are one source, the first; leaves of a source ascend by doc_id (null first), equal ids by
    leaf; repeated rows are leaves of their own. ``folded_root`` is what ``given`` and the siblings of ``leaf``
    give. A lone leaf is its source's root, a lone source's root the dataset's; an empty table gives no rows.
    """
    rows = staged(rows.select("source", F.col("doc_id").cast("long").alias("doc_id"), "leaf", "given"), "leaves")
    sources = ranked(rows.groupBy("source").agg(F.count("*").alias("n")), [], ["source"])
    sources = sources.select(F.col("source").alias("_name"), "n", F.col("pos").alias("tree"))
    placed = ranked(rows, ["source"], ["doc_id", "leaf"]).join(sources, F.col("source").eqNullSafe(F.col("_name")))
    placed = staged(placed.select("tree", "pos", "n", "doc_id", F.col("leaf").alias("node"), "given"), "placed")
    blocks = staged(block_roots(placed.select("tree", "pos", "n", "node")), "blocks")
    inner = climb(blocks)
    tops = inner.filter("pos = 0").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(0).cast("long").alias("n"), F.col("root").alias("node"))
    tops = staged(tops.withColumn("n", F.lit(tops.count()).cast("long")), "tops")
    outer = climb(tops).select(F.col("pos").alias("tree"), F.col("root").alias("top"), F.col("path").alias("beyond"))
    above = inner.join(outer, "tree").select("tree", F.col("pos").alias("block"), F.col("root").alias("subroot"), F.col("top").alias("root"), F.concat("path", "beyond").alias("path"))
    return _block_of(placed).groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInArrow(
        _proofs, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def op12_merkle(spark, sf_dir: str) -> DataFrame:
    """The manifest of all documents; texts of every fifth id (by its checksum) are lower-cased before they are verified."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    return merkle_manifest(leaves(docs, tampered, lower_ascii(F.col("text"))))


def _oracle_sql(deep: int = 6) -> str:
    """The same from nested runs in DuckDB; ``deep`` levels hold 16 ** deep leaves of a source, and as many sources."""
    def digest(text: str) -> str:
        one = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
        return "sha256(" + " || ".join(one.format(c) for c in (*FIELDS[:-1], text)) + ")"

    crc = ("xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),"
           " lambda a, b: xor(xor(a, b) // 2, 3988292384 * (xor(a, b) % 2))), 4294967295)")
    sql = [f"d AS (SELECT source, doc_id, {digest('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {digest(lower_sql())} ELSE {digest('text')} END AS given FROM documents)",
           "o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM d)",
           "a0 AS (SELECT tree, pos AS i, leaf AS h FROM o)"]
    for name, key, first in (("a", "tree", None), ("b", "0 AS tree", f"b0 AS (SELECT 0 AS tree, tree AS i, h FROM a{deep})")):
        if first:
            sql.append(first)
        for k in range(1, deep + 1):
            sql.append(f"{name}{k} AS (SELECT tree, i // n AS i, CASE WHEN n = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h, CASE WHEN n = 1 THEN NULL ELSE string_agg(h, '' ORDER BY i) END AS s"
                       f" FROM (SELECT *, CASE WHEN count(*) OVER (PARTITION BY tree) > 1 THEN {FAN} ELSE 1 END AS n FROM {name}{k - 1}) GROUP BY tree, i // n, n)")
    f, beside, joins = "o.given", [], []
    steps = []
    for name, tree, at in (("a", "o.tree", "o.pos"), ("b", "0", "o.tree")):
        for k in range(deep):
            place = f"{at} // {FAN**k} % {FAN} * {_HEX}"
            steps.append((f"{name}{k + 1}", f"{tree} = {name}{k + 1}.tree AND {name}{k + 1}.i = {at} // {FAN ** (k + 1)}", place))
    sql.append("p0 AS (SELECT doc_id, leaf, tree, pos, given AS f, '' AS proof FROM o)")
    for j, (table, on, place) in enumerate(steps):
        on, place = on.replace("o.", "q."), place.replace("o.", "q.")
        left, right = f"left(t.s, ({place})::INT)", f"substr(t.s, ({place} + {_HEX + 1})::INT)"
        sql.append(f"p{j + 1} AS (SELECT q.doc_id, q.leaf, q.tree, q.pos, CASE WHEN t.s IS NULL THEN q.f ELSE sha256({left} || q.f || {right}) END AS f,"
                   f" CASE WHEN t.s IS NULL THEN q.proof ELSE q.proof || {left} || {right} END AS proof FROM p{j} q JOIN {table} t ON {on.replace(table + '.', 't.')})")
    return ("WITH " + ",\n".join(sql) + f"\nSELECT p.doc_id, p.leaf, s.h AS subroot, r.h AS root, sha256(p.proof) AS proof_sha256, p.f AS folded_root, p.f = r.h AS verified"
            f" FROM p{len(steps)} p JOIN b0 s ON s.i = p.tree CROSS JOIN b{deep} r")


def lower_sql() -> str:
    return "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


OP12_SQL = _oracle_sql()
