"""Benchmark decontamination with DataFrame functions only.

Windows of an item's normalised words (13, or all of them if there are fewer) make a hash set that
is sent to all tasks; each document's window hashes are looked up in it where the row is, and what is
found is verified word by word. Up to ``MOST_WINDOWS`` the set is in the plan itself; up to ``MOST_SENT``
it is a broadcast table of 64-bit hashes, and only the positions that it holds leave their row. Only
beyond that, where a broadcast has no proven bound, positions are shuffled to the windows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 13
MOST_WINDOWS, MOST_BYTES = 50_000, 64 << 20  # of a benchmark whose windows are sent to all tasks
MOST_SENT = 8_000_000  # hashes that a table sent to all tasks may hold
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased (A-Z) runs of digits, letters and non-ASCII characters; null has none."""
    clean = F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _GAP, " "))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " ", -1))


def _parts(places: list[int], at: Column) -> Column:
    return F.xxhash64(*(F.get("wh", at + (k - 1)) for k in places))


def _among(size: int, known: tuple[list[int], list[int]]):
    """Whether the window at a 1-based place may be known: first by three of its words, then by all."""
    some, whole = known
    return lambda i: _parts(_three(size), i).isin(some) & _parts(list(range(size)), i).isin(whole)


def _three(size: int) -> list[int]:
    return sorted({0, size // 2, size - 1})


def _whole(size: int, at: Column) -> Column:
    return _parts(list(range(size)), at)


def _place(size: int):
    return lambda i: F.struct(i.alias("at"), F.lit(size).alias("n"), F.array_join(F.slice("w", i, F.lit(size)), " ").alias("window"))


def _hashed_place(size: int):
    return lambda i: F.struct(i.alias("at"), F.lit(size).alias("n"), _whole(size, i).alias("h"))


@dataclass
class Windows:
    """``table``: window, n_words, items (distinct ids), and h, its hash. ``hashes`` by size, None if they are too
    many for a plan; ``n``: how many windows there are."""

    table: DataFrame
    sizes: list[int]
    hashes: dict[int, tuple[list[int], list[int]]] | None
    n: int = 0


def benchmark_windows(benchmark: DataFrame, width: int = WIDTH, most: int = MOST_WINDOWS) -> Windows:
    """Distinct windows of all items. Items without words have none. Only counts and sizes, and hashes
    within the stated bounds, reach the driver."""
    w = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(width))
    at = F.explode(F.sequence(F.lit(1), F.size("w") - size + 1))
    rows = w.withColumn("n_words", size).select("item", "w", "n_words", at.alias("at"))
    rows = rows.select("item", "n_words", F.slice("w", F.col("at"), F.col("n_words")).alias("part"))
    table = rows.groupBy(F.array_join("part", " ").alias("window"), "n_words").agg(F.collect_set("item").alias("items"), F.first("part").alias("part"))
    total = table.agg(F.count("*").alias("n"), F.sum(F.length("window") + 16 + F.size("items") * 16).alias("bytes"),
                      F.collect_set("n_words").alias("sizes")).first()
    sizes, hashes = sorted(total["sizes"]), None
    if total["n"] <= most and (total["bytes"] or 0) <= MOST_BYTES:
        hashes = {}
        for s in sizes:
            own = table.filter(F.col("n_words") == s).select(F.transform("part", lambda x: F.xxhash64(x)).alias("wh"))
            found = own.select(_parts(_three(s), F.lit(1)), _parts(list(range(s)), F.lit(1))).collect()
            hashes[s] = sorted({r[0] for r in found}), sorted({r[1] for r in found})
    table = table.withColumn("wh", F.transform("part", lambda x: F.xxhash64(x)))
    h = F.lit(None).cast("long")
    for s in sizes:
        h = F.when(F.col("n_words") == s, _whole(s, F.lit(1))).otherwise(h)
    return Windows(table.select("window", "n_words", "items", h.alias("h")), sizes, hashes, total["n"])


def find_hits(docs: DataFrame, windows: Windows) -> DataFrame:
    """Per row of ``docs`` all its columns, ``w`` (its words), ``hits`` (sorted 0-based numbers of words inside
    any occurrence) and ``items`` (sorted ids of items with occurring windows).

    A row of a repeated or null doc_id is a row of its own. Rows that share a popular window aren't
    gathered: occurrences are only regrouped by row, after a partial aggregation.
    """
    own = docs.columns
    row = F.struct(*(F.col(f"`{c}`") for c in own)).alias("row")
    d = docs.select(row, words(F.col("text")).alias("w"), F.monotonically_increasing_id().alias("id"))
    found = []
    # the generator keeps the words and their hashes from being computed again for each window
    d = d.select("id", "row", F.inline(F.array(F.struct("w", F.transform("w", lambda x: F.xxhash64(x)).alias("wh")))))
    for s in windows.sizes:
        places = F.when(F.size("w") >= s, F.sequence(F.lit(1), F.size("w") - s + 1)).otherwise(F.array().cast("array<int>"))
        if windows.hashes is not None:
            places = F.filter(places, _among(s, windows.hashes[s]))
        found.append(F.transform(places, _place(s) if windows.hashes is not None else _hashed_place(s)))
    none = F.array().cast(f"array<struct<at:int,n:int,{'window:string' if windows.hashes is not None else 'h:long'}>>")
    d = d.select("id", "row", "w", (F.concat(*found) if found else none).alias("found"))
    return d


def _looked_up(d: DataFrame, windows: Windows, own: list[str], most: int) -> DataFrame:
    """Rows (own columns, at, n, items) of the places in ``found``: of all whose hash is some window's, and of each
    row's first; items is null where the words are no window's."""
    at = d.select(*own, "w", F.explode_outer("found").alias("f")).select(*own, "w", "f.at", "f.n", "f.h")
    hashes = windows.table.select("h", F.lit(True).alias("known")).distinct()
    text = F.array_join(F.slice("w", F.col("at"), F.col("n")), " ")
    if windows.n <= most:
        at = at.join(F.broadcast(hashes), "h", "left").filter("known or at is null or at = 1").withColumn("window", text)
    else:
        at = at.withColumn("window", text).drop("w").join(hashes, "h", "left").filter("known or at is null or at = 1")
    table = windows.table.select("window", F.col("n_words").alias("n"), "items")
    return at.select(*own, "at", "n", "window").join(table, ["window", "n"], "left").select(*own, "at", "n", "items")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, most: int = MOST_WINDOWS, sent: int = MOST_SENT) -> DataFrame:
    """``doc_id, n_words, hits, items`` for each row of ``docs``; see :func:`find_hits`.

    Null and empty texts have no words and no hits; without items, or with items without words, nothing
    is hit; columns other than doc_id, text and item_id are ignored. ``most`` and ``sent`` bound what is put into the
    plan and what is broadcast; they don't change the result.
    """
    windows = benchmark_windows(benchmark, width, most)
    d = find_hits(docs.select("doc_id", "text"), windows)
    if windows.hashes is None:
        d = d.select("id", F.col("row.doc_id").alias("doc_id"), F.size("w").cast("long").alias("n_words"), "w", "found")
        at = _looked_up(d, windows, ["id", "doc_id", "n_words"], sent)
    else:  # one pass over the texts: a row without candidates goes on with a null
        d = d.select("id", F.col("row.doc_id").alias("doc_id"), F.size("w").cast("long").alias("n_words"), "found")
        at = d.select("id", "doc_id", "n_words", F.explode_outer("found").alias("f")).select("id", "doc_id", "n_words", "f.at", "f.n", "f.window")
        at = at.join(F.broadcast(windows.table.select("window", F.col("n_words").alias("n"), "items")), ["window", "n"], "left")
    inside = F.when(F.col("items").isNotNull(), F.sequence(F.col("at") - 1, F.col("at") + F.col("n") - 2))
    return at.withColumn("inside", inside).groupBy("id", "doc_id", "n_words").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("inside")))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")).drop("id")


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """Hit words are at least a twentieth of the document's."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", width: int = WIDTH, most: int = MOST_WINDOWS, sent: int = MOST_SENT) -> DataFrame:
    """``docs`` with the same columns, without contaminated documents, or with the hit words cut out of
    ``text`` (``remove="spans"``: each with what stands before it and no word).

    A row that has no occurrence of any window is left as it is; null texts stay null.
    """
    own = docs.columns
    windows = benchmark_windows(benchmark, width, most)
    if windows.hashes is None:
        d = find_hits(docs, windows)
        spots = _looked_up(d, windows, ["id"], sent).filter("items is not null").groupBy("id").agg(F.collect_list(F.struct("at", "n")).alias("spots"))
        d = d.drop("found").join(spots, "id", "left").withColumn("spots", F.coalesce("spots", F.array().cast("array<struct<at:int,n:int>>")))
    else:
        exact = _exact_sets(windows)
        d = find_hits(docs, windows).withColumn("spots", F.filter("found", lambda f: exact(f["window"]))).drop("found")
    inside = F.array_distinct(F.flatten(F.transform("spots", lambda f: F.sequence(f["at"] - 1, f["at"] + f["n"] - 2))))
    d = d.withColumn("hits", inside)
    if remove == "documents":
        d = d.filter(~contaminated(F.size("hits"), F.size("w")))
        return d.select(*(F.col("row").getField(c).alias(c) for c in own))
    text = F.col("row.text")
    pieces = F.regexp_extract_all(text, F.lit(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    tail = F.regexp_extract(text, r"([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*)\z", 1)
    kept = F.filter(pieces, lambda _, i: ~F.array_contains(F.col("hits"), i))
    cut = F.when(F.size("hits") > 0, F.concat(F.array_join(kept, ""), tail)).otherwise(text)
    return d.select(*((cut if c == "text" else F.col("row").getField(c)).alias(c) for c in own))


def _exact_sets(windows: Windows):
    texts = [r["window"] for r in windows.table.select("window").collect()]
    return lambda window: window.isin(texts) if texts else F.lit(False)


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Each document's hit words and the items whose windows occur in it."""
    d = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.size("hits").cast("long")
    return d.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated(n_hit, F.col("n_words")).alias("contaminated"))


OP5_SQL = r"""
WITH iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), win AS (
  SELECT item, least(len(w), 13) AS n, unnest(generate_series(1, len(w) - least(len(w), 13) + 1)) AS p, w FROM iw WHERE len(w) > 0
), tab AS (
  SELECT n, array_to_string(w[p:p + n - 1], ' ') AS win, list(DISTINCT item) AS items FROM win GROUP BY 1, 2
), sizes AS (SELECT DISTINCT n FROM tab),
dw AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), pos AS (
  SELECT doc_id, n, w, unnest(generate_series(1, len(w) - n + 1)) AS p FROM dw, sizes WHERE len(w) >= n
), occ AS (
  SELECT doc_id, p, pos.n AS n, items FROM pos JOIN tab ON tab.n = pos.n AND array_to_string(w[p:p + pos.n - 1], ' ') = tab.win
), hit AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS q FROM occ) GROUP BY 1
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, unnest(items) AS item FROM occ) GROUP BY 1
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
