"""N-gram Jaccard join over prefix trees: classes of documents linked by shingle sets.

Equal sets are one class at once. The shingles of all classes have one global order: rare ones by
fingerprint, then the most frequent ones by their count over all documents. Two sets that link share
a shingle among the first fifth of both (the first ninth of the smaller one), so only those are
shuffled, and those that one set alone has go no further; of shingles that the same sets have the
first one stays. Sets first meet one leader for each shingle, which joins most copies. Then a prefix
tree is built over the sets that share a first shingle, from that shingle on, and traversed with each
of them: overlap is shared along a path, and a subtree is left once the remaining lengths can't reach
0.8, or once it holds only the probe's own component. What is proposed and not ruled out by parity
bitmaps is verified by trees of whole sets. No group of near copies is expanded into pairs once it is
connected.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import connected_components, discard, release, staged, text_slices
from tidemark.llm.prefix_tree import SHARE, PrefixTree, Sequence
from tidemark.llm.shingles import WIDTH, set_fingerprint, shingle_sets

STARS = 2  # rounds with leaders at most
FREQUENT = 100_000  # shingles that are ordered by count; any order gives the same links
CHUNK = 2_000_000  # shingles that a task counts at once
LISTED = 32  # codes of a set that a tree for proposals holds; what follows is bounded by its length
BLOCK, HOT = 4096, 1024  # sets in a block of trees, and of one code in one tree
GROUP, GROUP_CODES = 256, 1 << 22  # sets, and their codes, in a tree that verifies
SPREAD = 256  # keys over which the sets of a frequent shingle are dealt
MOST_SENT = 1_000_000  # ids that may be sent to all tasks; what they are joined to is shuffled to more of them
BITS = 4096  # of a set's parity bitmap
_COLD = np.uint64((1 << 62) - 1)
_FIRST = 1 << 62  # code of the rarest frequent shingle


class Order:
    """Codes whose numeric order is the global one; ``frequent``: shingles by ascending count."""

    def __init__(self, frequent: np.ndarray):
        self.sorted = np.argsort(frequent, kind="stable")
        self.frequent = frequent[self.sorted]

    def codes(self, shingles: np.ndarray) -> np.ndarray:
        out = shingles & _COLD
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, shingles), len(self.frequent) - 1)
            hot = self.frequent[at] == shingles
            out[hot] = _COLD + np.uint64(1) + self.sorted[at[hot]].astype(np.uint64)
        return np.sort(out)


def _long(values) -> pa.Array:
    return pa.array(values, pa.int64())


def _sent(ids: DataFrame) -> DataFrame:
    """A staged table, sent to all tasks while it is small, so that what it is joined to isn't shuffled."""
    return F.broadcast(ids) if ids.count() <= MOST_SENT else ids


def _survey(width: int):
    """Rows of documents (doc_id, n, a, b) and of shingles that are frequent in a chunk (a: shingle, n: count)."""
    def run(batches):
        held, size, seen = [], 0, set()

        def counted():
            values, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= 3
            return pa.RecordBatch.from_arrays(
                [pa.array([None] * int(often.sum()), pa.int64()), _long(n[often].astype(np.int64)), _long(values[often].view(np.int64)), pa.nulls(int(often.sum()), pa.int64()), pa.array([False] * int(often.sum()), pa.bool_())],
                names=["doc_id", "n", "a", "b", "is_doc"])

        for batch in batches:
            for s, e in text_slices(batch.column(1)):
                part = batch.slice(s, e - s)
                sets = shingle_sets(part.column(1), width)
                prints = [set_fingerprint(x) for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), _long([len(x) for x in sets]), _long([p[0] for p in prints]), _long([p[1] for p in prints]), pa.array([True] * len(sets), pa.bool_())],
                    names=["doc_id", "n", "a", "b", "is_doc"])
                for x, p in zip(sets, prints, strict=True):
                    if len(x) and p not in seen:
                        seen.add(p)
                        held.append(x)
                        size += len(x)
                if size >= CHUNK:
                    yield counted()
                    held, size, seen = [], 0, set()
        if size:
            yield counted()
    return run


def _first_codes(width: int, order, share):
    """Rows (key, node, place) of the first codes of each set that the task hasn't seen yet; ``key`` is the code, of
    which a frequent one has ``SPREAD``; ``place`` holds the set's size and the code's place in it."""
    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for s, e in text_slices(batch.column(0)):
                out, nodes, sizes, lengths = [], [], [], []
                for x in shingle_sets(batch.column(0).slice(s, e - s), width):
                    if not len(x) or (node := set_fingerprint(x)[0]) in seen:
                        continue
                    seen.add(node)
                    k = len(x) + share[0] * -len(x) // share[1] + 1
                    out.append(order.value.codes(x)[:k])
                    nodes.append(node)
                    sizes.append(len(x))
                    lengths.append(k)
                if out:
                    lengths = np.array(lengths)
                    at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                    place = np.repeat(np.array(sizes, np.int64) << 32, lengths) | at
                    codes, owner = np.concatenate(out).view(np.int64), np.repeat(nodes, lengths)
                    keys = np.where(codes > int(_COLD), _FIRST + (codes - _FIRST) * SPREAD + (owner & (SPREAD - 1)), codes)
                    yield pa.RecordBatch.from_arrays([_long(keys), _long(owner), _long(place)], names=["key", "node", "place"])
    return run


def _parity(shingles: np.ndarray) -> np.ndarray:
    """For each place whether an odd number of the set's shingles falls there: two bitmaps differ in at most
    as many places as the sets differ in shingles."""
    odd = np.bincount((shingles >> np.uint64(40)).astype(np.int64) % BITS, minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sets(width: int, made):
    """Rows (node, n, what ``made`` gives for the set) of the rows (node, text) whose text has that fingerprint, as a
    doc_id may be repeated with other texts. A null node stands for the text's own."""
    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for s, e in text_slices(batch.column(1)):
                nodes, sizes, out = [], [], []
                for node, x in zip(batch.column(0).slice(s, e - s).to_pylist(), shingle_sets(batch.column(1).slice(s, e - s), width), strict=True):
                    own = set_fingerprint(x)[0]
                    if len(x) and own not in seen and node in (None, own):
                        seen.add(own)
                        nodes.append(own)
                        sizes.append(len(x))
                        out.append(made(x))
                yield pa.RecordBatch.from_arrays([_long(nodes), pa.array(sizes, pa.int32()), pa.array(out, pa.list_(pa.int64()))], names=["node", "n", "made"])
    return run


@dataclass
class _Texts:
    """The documents (doc_id, text), and which of them has the set of a node (node, doc_id)."""

    docs: DataFrame
    places: DataFrame
    width: int
    order: object

    def sets(self, nodes: DataFrame | None, made) -> DataFrame:
        """``node, n, made`` of those nodes (None: all that have hits, or more). Their ids are sent to the texts while
        they are few; of all nodes, what is made is then shuffled instead of the texts."""
        places = self.places if nodes is None else staged(self.places.join(nodes, "node", "left_semi"), "places")
        kind = "node long, n int, made array<long>"
        if nodes is None and places.count() > MOST_SENT:
            return self.docs.select(F.lit(None).cast("long").alias("node"), "text").mapInArrow(_sets(self.width, made), kind).dropDuplicates(["node"])
        return self.docs.join(_sent(places), "doc_id").select("node", "text").mapInArrow(_sets(self.width, made), kind)

    def whole(self, nodes: DataFrame) -> DataFrame:
        order = self.order
        return self.sets(nodes, lambda x: order.value.codes(x).view(np.int64)).select("node", F.col("made").alias("codes"))


def _possible(pairs: DataFrame, bits: DataFrame, share) -> DataFrame:
    """The (staged) pairs whose bitmaps don't differ in more places than linked sets may differ in shingles. Bitmaps
    of sets without a pair aren't shuffled while few sets have one."""
    p, q = share
    bits = bits.select("node", F.col("n").alias("m"), F.col("made").alias("bits"))
    if pairs.count() <= MOST_SENT // 2:
        bits = bits.join(F.broadcast(pairs.select("node").union(pairs.select("probe")).distinct()), "node", "left_semi")
    both = pairs.join(bits, "node").join(bits.toDF("probe", "k", "other"), "probe")
    apart = F.aggregate(F.zip_with("bits", "other", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    # the overlap is at least p / (p + q) of both sizes together
    return both.filter(apart * (p + q) <= (F.col("m") + F.col("k")) * (q - p)).select("probe", "node", "n")


def _split(group: pa.Table, name: str, kind) -> list[np.ndarray]:
    """The lists of a column as arrays."""
    column = group.column(name).chunk(0)
    flat, cuts = column.flatten().to_numpy().astype(kind, copy=False), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
    return [flat[a:z] for a, z in zip(cuts[:-1], cuts[1:], strict=True)]


def _verified(share):
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        probe, nodes = group.column("probe")[0].as_py(), group.column("node").to_numpy()
        sets = [Sequence.whole(c) for c in _split(group, "codes", np.uint64)]
        own = np.flatnonzero(nodes == probe)
        others = np.flatnonzero(nodes != probe)
        hits = others[:0]
        if len(own) and len(others):
            hits = others[PrefixTree([sets[i] for i in others]).search(sets[own[0]], share)]
        return pa.table({"u": _long([probe] * len(hits)), "v": _long(nodes[hits])})
    return run


def _verify(pairs: DataFrame, texts: _Texts, share) -> DataFrame:
    """Links ``u, v`` among ``pairs`` (probe, node, n: codes of node). A probe's candidates are dealt to groups of
    bounded size, each with a tree of their whole sets."""
    per = pairs.groupBy("probe").agg(F.greatest(F.ceil(F.count("*") / GROUP), F.ceil(F.sum("n") / GROUP_CODES)).alias("parts"))
    dealt = pairs.join(per, "probe").select("probe", F.expr("pmod(xxhash64(node, probe), parts)").alias("part"), "node")
    probes = per.select("probe", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("probe").alias("node"))
    nodes = pairs.select("node").union(pairs.select("probe")).distinct()
    rows = texts.whole(nodes).join(_sent(staged(dealt.union(probes), "dealt")), "node").select("probe", "part", "node", "codes")
    return rows.groupBy("probe", "part").applyInArrow(_verified(share), "u long, v long")


def _may_be_smaller(share) -> Column:
    """Whether the smaller set of a link can have its first common code at this place: what it has from there on
    is at least what a set of its own size needs."""
    return F.expr(f"{sum(share)} * (n - at) >= {2 * share[0]} * n")


def _near(share) -> str:
    """Size and position bounds of a pair at its first common code."""
    p, q = share
    return (f"x.n * {q} >= y.n * {p} and y.n * {q} >= x.n * {p} and "
            f"{p + q} * least(x.n - x.at, y.n - y.at) >= {p} * (x.n + y.n)")


def _star_pairs(hits: DataFrame, turn: int, share) -> DataFrame:
    """Each set with one leader at most: of the leaders of its codes, that of the most codes. A code has a leader
    for each class of set sizes; classes overlap from turn to turn. In even turns it is the set that has the code
    earliest, which passes the position bound with most others; in odd turns any, by a hash."""
    hits = hits.withColumn("size", F.floor(F.log(F.col("n")) / math.log(share[1] / share[0]) + (turn // 2 % 2) / 2))
    early = F.col("at") / F.col("n") if turn % 2 == 0 else F.lit(0.0)
    leaders = hits.groupBy("code", "size").agg(F.min(F.struct(early.alias("e"), F.xxhash64("component", F.lit(turn)).alias("h"), "node", "n", "at", "component")).alias("y")).select("code", "size", "y.*")
    near = hits.alias("x").join(leaders.alias("y"), F.expr(f"x.code = y.code and x.size = y.size and x.component <> y.component and {_near(share)}"))
    votes = near.groupBy(F.col("x.node").alias("node"), F.col("y.node").alias("probe")).agg(F.count("*").alias("votes"), F.max("x.n").alias("n"))
    return votes.groupBy("node").agg(F.max(F.struct("votes", "probe", "n")).alias("best")).select("best.probe", "node", "best.n")


def _listed(hits: DataFrame, live: DataFrame) -> DataFrame:
    """The ``live`` hits (code, node, component) with the set's next shared codes (this one first), their places,
    and where the list ends."""
    ahead = Window.partitionBy("node").orderBy("at")
    some = ahead.rowsBetween(0, LISTED - 1)
    p, q = SHARE
    first = F.expr(f"n - cast(ceil(n * {p} / {q}) as int) + 1")
    both = hits.select("code", "node", "n", "at", F.lit(None).cast("long").alias("component")).union(live.select("code", "node", "n", "at", "component"))
    rows = both.repartition("node").groupBy("node", "code", "n", "at").agg(F.max("component").alias("component"))  # dealt once for all that follows
    whole = ahead.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("alive", F.max("component").over(whole)).filter("alive is not null").drop("alive")
    rows = rows.withColumns({"codes": F.collect_list("code").over(some), "places": F.collect_list("at").over(some), "end": F.coalesce(F.lead("at", LISTED).over(ahead), first)})
    return rows.filter("component is not null")


def _blocks(entries: DataFrame, share) -> DataFrame:
    """``entries`` dealt to blocks in which the trees of their codes are built: each entry is stored and probes. A
    code of more than ``HOT`` entries is cut into chunks, and each chunk of probes meets each chunk of stored ones.
    There is at most one such code for ``HOT`` entries, so these alone are sent to all tasks."""
    per = staged(entries.groupBy("code").agg(F.ceil(F.count("*") / HOT).cast("int").alias("chunks")).filter("chunks > 1"), "chunks")
    many = max(1, -(-entries.count() // BLOCK))
    dealt = entries.join(F.broadcast(per), "code", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    dealt = dealt.withColumns({"chunk": F.pmod(F.xxhash64("node"), F.col("chunks")), "small": _may_be_smaller(share)})
    cold = dealt.filter("chunks = 1").withColumns({"block": F.pmod(F.xxhash64("code"), F.lit(many)), "stored": F.lit(True), "probes": F.col("small")})
    hot = dealt.filter("chunks > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    stored = hot.withColumns({"block": F.xxhash64("code", "chunk", F.col("other").cast("long")), "stored": F.lit(True), "probes": F.lit(False)})
    probing = hot.filter("small").withColumns({"block": F.xxhash64("code", F.col("other").cast("long"), "chunk"), "stored": F.lit(False), "probes": F.lit(True)})
    names = ["block", "code", "node", "n", "component", "codes", "places", "end", "stored", "probes"]
    return cold.select(names).union(stored.select(names)).union(probing.select(names))


def _proposed(share):
    """Pairs (probe, node, n) of a block: the probe isn't larger, and the components differ."""
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        code, node, n, component, stored, probes, end = (group.column(c).to_numpy() for c in ("code", "node", "n", "component", "stored", "probes", "end"))
        sequences = [Sequence(c, a, int(m), int(z)) for c, a, m, z in zip(_split(group, "codes", np.uint64), _split(group, "places", np.int64), n, end, strict=True)]
        order = np.argsort(code, kind="stable")
        cuts = np.flatnonzero(np.diff(code[order])) + 1
        u, v = [], []
        for rows in np.split(order, cuts):
            held, asking = rows[stored[rows]], rows[probes[rows]]
            if len(held) and len(asking):
                tree = PrefixTree([sequences[i] for i in held], component[held])
                for i in asking:
                    near = held[tree.search(sequences[i], share, component[i])]
                    near = near[(n[near] > n[i]) | ((n[near] == n[i]) & (node[near] > node[i]))]
                    u.append(np.full(len(near), i))
                    v.append(near)
        u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (u, v))
        return pa.table({"probe": _long(node[u]), "node": _long(node[v]), "n": pa.array(n[v], pa.int32())})
    return run


def _tree_pairs(live: DataFrame, hits: DataFrame, share) -> DataFrame:
    """What the trees over the ``live`` codes propose."""
    entries = staged(_listed(hits, live), "entries")
    release(live.sparkSession)
    found = _blocks(entries, share).groupBy("block").applyInArrow(_proposed(share), "probe long, node long, n int")
    return found.distinct()


def _shared(first: DataFrame) -> DataFrame:
    """Rows (code, node, n, at) of the codes that two sets have. The frequent ones are taken to be shared and are
    dealt to many tasks; of the others none has many sets."""
    frequent = F.col("key") >= _FIRST
    own = Window.partitionBy("key")
    pairs = first.withColumns({"lo": F.min("node").over(own), "hi": F.max("node").over(own)}).filter(frequent | (F.col("lo") != F.col("hi")))
    once = pairs.dropDuplicates(["key", "node"])  # a set may have been seen by several tasks
    code = F.when(frequent, F.lit(_FIRST) + F.shiftright(F.col("key") - _FIRST, 8)).otherwise(F.col("key")).cast("long")
    return once.select(code.alias("code"), "node", F.shiftright("place", 32).cast("int").alias("n"), F.expr("cast(place & 4294967295 as int)").alias("at"))


def _kept(hits: DataFrame, share) -> DataFrame:
    """The hits whose code can be some link's first common one: two sets have it, one of them early enough, and
    no earlier code is had by the same sets."""
    per = hits.groupBy("code").agg(F.count("*").alias("sets"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"), F.max(_may_be_smaller(share)).alias("small"))
    first = per.filter("sets > 1 and small").groupBy("sets", "x", "y").agg(F.min("code").alias("code"))
    return hits.join(first.select("code"), "code")


def _prepared(docs: DataFrame, width: int, share):
    """Rows with set sizes and fingerprints, classes of equal sets, hits of shared first codes, those of them that
    propose pairs, and the texts and bitmaps of all that have such hits."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    survey = staged(docs.mapInArrow(_survey(width), "doc_id long, n long, a long, b long, is_doc boolean"), "survey")
    rows = survey.filter("is_doc").drop("is_doc")
    counts = survey.filter("not is_doc").groupBy("a").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "a").limit(FREQUENT)
    frequent = np.array([r["a"] for r in counts.collect()][::-1], np.int64).view(np.uint64)
    order = spark.sparkContext.broadcast(Order(frequent))

    known = docs.filter("doc_id is not null")
    first = known.select("text").mapInArrow(_first_codes(width, order, share), "key long, node long, place long")
    hits = staged(_shared(first), "hits")
    release(spark)
    kept = staged(_kept(hits, share), "kept")
    classes = staged(rows.filter("n > 0 and doc_id is not null").groupBy("a", "b").agg(F.min("doc_id").alias("doc_id")), "classes")
    places = staged(kept.select("node").distinct().join(classes, F.col("node") == F.col("a")).select("node", "doc_id"), "places")
    texts = _Texts(known, places, width, order)
    bits = staged(texts.sets(None, _parity), "bits")
    release(spark)
    return rows, classes, hits, kept, texts, bits


def link_documents(docs: DataFrame, width: int = WIDTH, share: tuple[int, int] = SHARE) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs``.

    Two documents link when ``share[1] * intersection >= share[0] * union`` of their shingle sets;
    ``component_id`` is the smallest doc_id reachable. A null or empty text, or one without words, has an
    empty set and is alone. A row with a null doc_id gets its set's size and a null component and links
    nothing. Repeated rows give repeated results. Other columns are ignored. An empty table gives no rows.
    """
    rows, classes, hits, kept, texts, bits = _prepared(docs, width, share)

    labels, links, star, turn = None, None, True, 0
    while True:
        live = kept.withColumn("component", F.col("node"))
        if labels is not None:  # codes of one component alone have nothing left to link
            live = kept.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
            mixed = live.groupBy("code").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("code")
            live = staged(live.join(mixed, "code"), "live")
        proposed = staged(_star_pairs(live, turn, share) if star else _tree_pairs(live, hits, share), "proposed")
        release(docs.sparkSession)
        pairs = staged(_possible(proposed, bits, share), "pairs")
        release(docs.sparkSession)
        found = None if pairs.isEmpty() else staged(_verify(pairs, texts, share), "links")
        joined = 0 if found is None else found.count()
        discard(proposed, pairs, live)
        release(docs.sparkSession)
        if joined:
            links = found if links is None else links.union(found)
            old, labels = labels, staged(connected_components(links), "components")
            discard(old)
        if not star:
            break
        turn += 1
        star = turn < STARS and joined > 0
    discard(hits, kept, bits)

    label = classes.select("a", "b", "doc_id")
    if labels is None:
        label = label.withColumnRenamed("doc_id", "component_id")
    else:
        label = label.join(labels, F.col("a") == F.col("node"), "left").withColumn("component", F.coalesce("component", "a"))
        top = label.groupBy("component").agg(F.min("doc_id").alias("component_id"))
        label = label.join(top, "component").select("a", "b", "component_id")
    out = rows.join(label, ["a", "b"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def count_links(docs: DataFrame, width: int = WIDTH, share: tuple[int, int] = SHARE) -> DataFrame:
    """``doc_id, n_links`` for each row of ``docs``: how many other rows link with it, copies included.

    Every pair of different sets that may link is tried, connected or not, so the work grows with the number of
    links between different sets; classes of equal sets only weigh. Rows with an empty set or a null doc_id have
    and give no links.
    """
    rows, classes, hits, kept, texts, bits = _prepared(docs, width, share)
    proposed = staged(_tree_pairs(kept.withColumn("component", F.col("node")), hits, share), "proposed")
    pairs = staged(_possible(proposed, bits, share), "pairs")
    links = staged(_verify(pairs, texts, share), "links")
    sizes = rows.filter("n > 0 and doc_id is not null").groupBy("a", "b").agg(F.count("*").alias("copies"))
    others = links.union(links.select("v", "u")).join(sizes.select(F.col("a").alias("v"), "copies"), "v").groupBy("u").agg(F.sum("copies").alias("others"))
    per = sizes.join(others, F.col("a") == F.col("u"), "left").select("a", "b", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    n = F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("n_links")).otherwise(0).cast("long")
    return rows.join(per, ["a", "b"], "left").select("doc_id", n.alias("n_links"))


def keep_one(docs: DataFrame, width: int = WIDTH, share: tuple[int, int] = SHARE) -> DataFrame:
    """``docs`` with one document of each component, that with the smallest doc_id; rows with a null
    doc_id stay. If that doc_id is repeated, its rows stay as they are."""
    first = F.max(F.col("doc_id") == F.col("component_id"))
    left = link_documents(docs, width, share).groupBy("doc_id").agg(first.alias("first")).filter("not first").select("doc_id")
    return docs.join(_sent(staged(left, "left")), "doc_id", "left_anti").select(docs.columns)


def keep_one_row(docs: DataFrame, width: int = WIDTH, share: tuple[int, int] = SHARE) -> DataFrame:
    """``docs`` with one row of each component, rows with null or repeated doc_ids included: of the smallest doc_id
    (null last), then of the smallest fingerprint of all its columns. Rows that are equal throughout are one.
    Rows without words link with nothing and stay, each different one once. The keys of rows that go are sent to all
    tasks while they are few, so that texts aren't shuffled."""
    keyed = docs.withColumn("_key", F.xxhash64(*docs.columns))
    linked = link_documents(keyed.select(F.col("_key").alias("doc_id"), "text"), width, share)
    group = staged(linked.groupBy(F.col("doc_id").alias("_key")).agg(F.min("component_id").alias("component"), F.count("*").alias("copies")), "group")
    release(docs.sparkSession)
    ids = keyed.groupBy("_key").agg(F.min("doc_id").alias("doc_id"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key", "copies")).alias("first")
    kept = staged(group.join(ids, "_key").groupBy("component").agg(first).select("component", "first._key", "first.copies"), "kept")
    of = kept.select("component", F.col("_key").alias("first"))
    left = staged(group.join(of, "component").filter("_key <> first or copies > 1").select("_key"), "left")
    release(docs.sparkSession)
    out = keyed.join(_sent(left), "_key", "left_anti")
    repeated = kept.filter("copies > 1").select("_key")
    if not repeated.isEmpty():
        out = out.union(keyed.join(repeated, "_key", "left_semi").dropDuplicates(["_key"]))
    return out.select(docs.columns)


def op4_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Each document's set size and component."""
    return link_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * o >= 80 * (p.n + q.n - o)
), r AS (
  SELECT doc_id AS x, doc_id AS c FROM documents UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.x
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(c) AS component_id FROM r GROUP BY 1) c USING (doc_id)
"""
