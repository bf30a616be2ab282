"""Jaccard self-join on word shingles by rare-first prefix filtering, and the components of its links.

Every set is ordered by how often its shingles occur in the corpus (counted for all documents in a table of fixed size), rarest
first. Two sets that are similar enough share a shingle in their prefixes. Pairs met there pass the length, positional and
suffix filters, come together once and are verified on the whole texts.

Equal sets are one representative. Components do not need every link of a dense group: the members of a posting list meet
a pivot first (lists of frequent shingles are salted, and the pivots of their parts meet the least one). Only pairs that are still in different components
after a few such rounds are enumerated, all of them, so no link between components is lost.

A link never leaves its component, so the links themselves are found component by component: its representatives are cut into blocks, every
pair of blocks is a tile, and a tile counts the overlaps of its whole texts by a matrix product. Each pair is verified in one tile.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfsense.llm.common import mix, shingle_set, signed, slices, small_batches, table, tidy, words
from shelfsense.session import materialise

WIDTH = 5
PERCENT = 80
#: Counters of shingle occurrences; a shingle's rank is its counter. The table is broadcast: 8 bytes each.
SLOT_BITS = 18
_CHUNK = 4096
#: Parts of the hash range whose sizes bound the overlap of two sets from above.
PARTS = 128
#: Documents per posting list part, by the shingle's counter.
LIST = 100_000
PIVOT_ROUNDS = 2
_BITS = 22
#: Shingles in a block of a component, about; a document counts ``_LEAST`` more, so that a block of short ones is bounded too.
TILE = 1 << 18
_LEAST = 1000


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def slot_counts(docs: DataFrame, width: int = WIDTH) -> np.ndarray:
    """How many documents hold a shingle of each slot, over all documents: partial tables per task, summed in two steps."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << SLOT_BITS, np.int64)
        for _, texts in slices(batches, "text"):
            for text in texts:
                n += np.bincount(_slots(shingle_set(words(text), width)), minlength=len(n)) if text else 0
        yield from _chunks({k: c for k, c in enumerate(n.reshape(-1, _CHUNK)) if c.any()})

    def _chunks(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        if sums:
            small = [c.astype("<u4" if c.max() < 1 << 32 else "<u8").tobytes() for c in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(small, pa.binary())], names=["chunk", "n"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(raw, "<u4" if len(raw) == 4 * _CHUNK else "<u8").astype(np.int64)
                sums[k] = sums[k] + part if k in sums else part
        yield from _chunks(sums)

    kind = "chunk int, n binary"
    once = small_batches(docs.select("text")).mapInArrow(tidy(count), kind).repartition("chunk", F.pmod(F.xxhash64("n"), F.lit(16)))
    rows = small_batches(once).mapInArrow(tidy(total), kind).repartition("chunk").mapInArrow(tidy(total), kind).collect()
    out = np.zeros((1 << SLOT_BITS) // _CHUNK * _CHUNK, np.int64).reshape(-1, _CHUNK)
    for chunk, raw in rows:
        out[chunk] = np.frombuffer(raw, "<u4" if len(raw) == 4 * _CHUNK else "<u8")
    return out.ravel()


def profiles(docs: DataFrame, counts: np.ndarray, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per document: set size, two fingerprints of the set, sizes of its parts, and its prefix with the salts of the lists."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch, texts in slices(batches, "text"):
            ids = batch.column(0).cast(pa.int64())
            n, f, g, parts, prefix, lists = [], [], [], [], [], []
            for text in texts:
                own = shingle_set(words(text), width)
                size = len(own)
                n.append(size)
                f.append(int(signed(np.array([np.bitwise_xor.reduce(mix(own + np.uint64(1)))], np.uint64))[0]) if size else 0)
                g.append(int(signed(np.array([mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)], np.uint64))[0]) if size else 0)
                parts.append(np.bincount((own >> np.uint64(57)).astype(np.int64), minlength=PARTS).tolist())
                count = often[_slots(own)]
                first = np.lexsort((own, count))[: size - (-(-percent * size // 100)) + 1] if size else np.empty(0, np.int64)
                prefix.append(signed(own[first]))
                lists.append((count[first] // LIST + 1).astype(np.int32))
            ends = np.concatenate([[0], np.cumsum([len(p) for p in prefix])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array(n, pa.int64()),
                    pa.array(f, pa.int64()),
                    pa.array(g, pa.int64()),
                    pa.array(parts, pa.list_(pa.int32())),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefix))),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists))),
                ],
                names=["doc_id", "n", "f", "g", "parts", "prefix", "lists"],
            )

    return small_batches(docs.select("doc_id", "text")).mapInArrow(tidy(run), "doc_id long, n long, f long, g long, parts array<int>, prefix array<long>, lists array<int>")


def _needed(a: Column, b: Column, percent: int) -> Column:
    """Smallest overlap of two sets of these sizes that links them."""
    return F.ceil(F.lit(percent) * (a + b) / F.lit(100 + percent) - 1e-9)


def _near_in_length(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _suffix(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Keep the pairs (a, b) of a written table whose parts allow the needed overlap."""
    sizes = _named_in(sizes, "doc", pairs).dropDuplicates(["doc"])
    both = pairs.join(sizes.select(F.col("doc").alias("a"), F.col("n").alias("na"), F.col("parts").alias("pa")), "a").join(
        sizes.select(F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("parts").alias("pb")), "b"
    )
    return both.where(_near_in_length(F.col("na"), F.col("nb"), percent) & _parts_allow("na", "nb", percent)).select("a", "b")


def _parts_allow(na: str, nb: str, percent: int) -> Column:
    most = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    return most >= _needed(F.col(na), F.col(nb), percent)


def _named_in(rows: DataFrame, key: str, pairs: DataFrame) -> DataFrame:
    """``rows`` whose key may be in pairs: a bitmap of fixed size keeps most others from being shuffled."""

    def bit(column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(1 << _BITS))

    maps = (
        pairs.select(bit("a").alias("bit"))
        .union(pairs.select(bit("b").alias("bit")))
        .groupBy(F.shiftright("bit", 15).alias("_map"))
        .agg(F.bitmap_construct_agg((F.col("bit") % 32768)).alias("_bits"))
    )
    byte = F.expr("cast(conv(hex(substring(_bits, cast(_bit % 32768 div 8 as int) + 1, 1)), 16, 10) as int)")
    return (
        rows.withColumn("_bit", bit(key))
        .withColumn("_map", F.shiftright("_bit", 15))
        .join(F.broadcast(maps), "_map")
        .where(byte.bitwiseAND(F.expr("shiftleft(1, cast(_bit % 8 as int))")) != 0)
        .select(*rows.columns)
    )


def verify(docs: DataFrame, pairs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(a, b, both, either) of the pairs that link, by the sets of their whole texts."""
    texts = _named_in(docs.select("doc_id", "text"), "doc_id", pairs).groupBy("doc_id").agg(F.min("text").alias("text"))
    rows = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(
        texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: OrderedDict[int, np.ndarray] = OrderedDict()

        def own(doc: int, text: str) -> np.ndarray:
            if doc in recent:
                recent.move_to_end(doc)
                return recent[doc]
            recent[doc] = shingle_set(words(text), width)
            if len(recent) > 64:
                recent.popitem(last=False)
            return recent[doc]

        for batch in batches:
            out = []
            for a, b, ta, tb in zip(*batch.columns, strict=True):
                a, b = a.as_py(), b.as_py()
                x, y = own(a, ta.as_py() if a not in recent else ""), own(b, tb.as_py() if b not in recent else "")
                both = len(np.intersect1d(x, y, assume_unique=True))
                either = len(x) + len(y) - both
                if both and 100 * both >= percent * either:
                    out.append((a, b, both, either))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(4)], names=["a", "b", "both", "either"])

    return small_batches(rows.select("a", "b", "ta", "tb")).mapInArrow(tidy(run), "a long, b long, both long, either long")


def components(edges: DataFrame) -> DataFrame:
    """(doc, component): the least document that edges (a, b) reach. Documents without an edge are absent.

    Every document moves to the least of itself and its neighbours, and the edges move along, until none is left; moves are then chained.
    """
    moves: DataFrame | None = None
    while True:
        sides = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        sides = sides.union(sides.select(F.col("v").alias("u"), F.col("u").alias("v")))
        step = materialise(sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("to")), "moves")
        moves = (
            step.select(F.col("u").alias("doc"), F.col("to").alias("component"))
            if moves is None
            else materialise(
                moves.join(step.withColumnRenamed("u", "component"), "component", "left").select("doc", F.coalesce("to", "component").alias("component")), "chained"
            )
        )
        edges = materialise(
            edges.join(step.select(F.col("u").alias("a"), F.col("to").alias("ta")), "a")
            .join(step.select(F.col("u").alias("b"), F.col("to").alias("tb")), "b")
            .where("ta <> tb")
            .select(F.col("ta").alias("a"), F.col("tb").alias("b"))
            .distinct(),
            "edges",
        )
        if edges.isEmpty():
            return moves


def _met(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs that meet at a shingle (px, py: its places in both), by length and by what may come before and after it."""
    nx, ny, px, py = (F.col(c) for c in ("nx", "ny", "px", "py"))
    bound = F.least(px, py) + F.least(nx - px, ny - py)
    return rows.where(_near_in_length(nx, ny, percent) & (bound >= _needed(nx, ny, percent)))


def connected(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(profiles, components of representatives, the links that were verified to find them): see :func:`join`."""
    prof = materialise(profiles(docs, slot_counts(docs, width), width, percent), "profiles")
    classes = prof.where("n > 0 AND doc_id IS NOT NULL").groupBy("f", "g", "n").agg(F.min("doc_id").alias("rep"))
    classes = materialise(classes, "classes")
    reps = prof.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    sizes = prof.where("n > 0").select(F.col("doc_id").alias("doc"), "n", "parts")
    posts = reps.select(F.col("doc_id").alias("doc"), "n", F.posexplode(F.arrays_zip("prefix", "lists")).alias("pos", "at")).select(
        F.col("at.prefix").alias("token"),
        F.pmod(F.xxhash64("doc"), F.col("at.lists")).cast("int").alias("part"),
        (F.col("at.lists") > 1).alias("salted"),
        "doc",
        "n",
        "pos",
    )
    whole = Window.partitionBy("token", "part").orderBy("doc").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.first(F.struct("doc", "n", "pos")).over(whole)
    posts = posts.withColumn("lo", first).withColumn("size", F.count("*").over(whole)).where("size > 1 OR salted")
    posts = materialise(posts, "postings")
    heads = posts.where("salted AND doc = lo.doc").select("token", "doc", "n", "pos")
    least = heads.groupBy("token").agg(F.min(F.struct("doc", "n", "pos")).alias("lo"))
    met = posts.select("doc", "n", "pos", "lo").union(heads.join(least, "token").select("doc", "n", "pos", "lo")).where("doc <> lo.doc")
    edges: DataFrame | None = None
    labels: DataFrame | None = None
    tried: DataFrame | None = None
    # A pivot has met its whole list and leaves it; so a list of two ends here.
    rest = posts.where("salted OR (size > 2 AND doc <> lo.doc)").select("token", "doc", "n", "pos")
    for turn in range(PIVOT_ROUNDS + 1):
        star = _met(
            met.select(F.col("doc").alias("b"), F.col("n").alias("nx"), F.col("pos").alias("px"), F.col("lo.doc").alias("a"), F.col("lo.n").alias("ny"), F.col("lo.pos").alias("py")), percent
        )
        pairs = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        new = materialise(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "met")
        pairs = materialise(_suffix(new, sizes, percent), "pairs")
        tried = pairs if tried is None else tried.union(pairs)
        found = materialise(verify(docs, pairs, width, percent), "links")
        edges = found if edges is None else edges.union(found)
        labels = components(edges)
        # Only lists whose members are not yet connected go on.
        own = rest.drop("component").join(labels, "doc", "left").withColumn("component", F.coalesce("component", "doc"))
        apart = own.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("token")
        rest = materialise(own.join(apart, "token", "left_semi"), "rest")
        if rest.isEmpty():
            return prof, labels_with_classes(prof, classes, labels), edges
        if turn < PIVOT_ROUNDS:
            order = F.struct(F.xxhash64("doc", F.lit(turn)), "doc")
            pivot = rest.groupBy("token").agg(F.min_by(F.struct("doc", "n", "pos", "component"), order).alias("lo"))
            turned = materialise(rest.join(pivot, "token"), "turned")
            met = turned.where("component <> lo.component")
            rest = turned.where("doc <> lo.doc").drop("lo")
    # Every pair that is still apart: rows outside the commonest component of a list against all rows of the list.
    common = rest.groupBy("token", "component").agg(F.count("*").alias("c")).groupBy("token").agg(F.max_by("component", F.struct("c", "component")).alias("major"))
    marked = rest.join(common, "token").join(sizes.dropDuplicates(["doc"]).select("doc", "parts"), "doc")
    minor = marked.where("component <> major").select("token", F.col("doc").alias("a"), F.col("n").alias("nx"), F.col("pos").alias("px"), F.col("component").alias("ca"), F.col("parts").alias("pa"))
    other = marked.select("token", F.col("doc").alias("b"), F.col("n").alias("ny"), F.col("pos").alias("py"), F.col("component").alias("cb"), F.col("parts").alias("pb"), (F.col("component") == F.col("major")).alias("in_major"))
    # All common prefix shingles of such a pair are here; a pair that links does so at its first one, where only what follows can be shared.
    nx, ny, px, py = (F.col(c) for c in ("nx", "ny", "px", "py"))
    here = _near_in_length(nx, ny, percent) & (F.least(nx - px, ny - py) >= _needed(nx, ny, percent)) & _parts_allow("nx", "ny", percent)
    apart = minor.join(other, "token").where("ca <> cb AND (in_major OR a < b)").where(here)
    once = apart.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    pairs = materialise(once, "pairs")
    edges = edges.union(materialise(verify(docs, pairs, width, percent), "links"))
    return prof, labels_with_classes(prof, classes, components(edges)), edges


def labels_with_classes(prof: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """(f, g, n, class_id, component): the component of every class of equal sets."""
    return classes.join(labels.withColumnRenamed("doc", "rep"), "rep", "left").select("f", "g", "n", F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("component"))


def overlaps(sets: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets at ``low`` (rows) and at ``high`` (columns)."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(often[code] > 1)
    code = (np.cumsum(often > 1) - 1)[code[shared]]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[shared][order]
    both = np.zeros((len(low), len(high)), np.int64)
    for lot in range(0, int(code[-1]) + 1 if len(code) else 0, _CHUNK):
        own = slice(*np.searchsorted(code, (lot, lot + _CHUNK)))
        x = np.zeros((len(sets), _CHUNK), np.float32)
        x[owner[own], code[own] - lot] = 1
        both += (x[low] @ x[high].T).astype(np.int64)
    return both


def _tiles(docs: DataFrame, found: DataFrame, edges: DataFrame, copies: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Tiles of two blocks of a component's representatives with their texts (and number of copies), and the links of components of two.

    A component of two has its one link already.
    """
    reps = found.select(F.col("class_id").alias("doc"), "n", "component")
    groups = reps.groupBy("component").agg(F.count("*").alias("members"), F.ceil(F.sum(F.col("n") + _LEAST) / TILE).cast("int").alias("blocks")).where("members > 2")
    cut = reps.join(groups, "component").select("doc", "component", "blocks", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int").alias("block"))
    weighed = cut.withColumn("copies", F.lit(1)) if copies is None else cut.join(copies.select(F.col("class_id").alias("doc"), "copies"), "doc")
    cut = materialise(weighed.select("doc", "component", "blocks", "block", F.col("copies").cast("long").alias("copies")), "blocks")
    named = cut.select(F.col("doc").alias("a"), F.col("doc").alias("b"))
    texts = _named_in(docs.select("doc_id", "text"), "doc_id", named).groupBy(F.col("doc_id").alias("doc")).agg(F.min("text").alias("text"))
    dealt = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(texts, "doc")
    tiles = dealt.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc", "copies", "text")
    return small_batches(tiles), edges.join(cut.select(F.col("doc").alias("a")), "a", "left_anti").select("a", "b", "both", "either")


class _Tile:
    """All pairs of a tile, verified on whole texts."""

    def __init__(self, rows: pa.Table, width: int, percent: int) -> None:
        block, i, j = np.asarray(rows["block"]), rows["i"][0].as_py(), rows["j"][0].as_py()
        sets = [shingle_set(words(t), width) for t in rows["text"].to_pylist()]
        n = np.array([len(s) for s in sets])
        self.ids, self.low, self.high = np.asarray(rows["doc"]), np.flatnonzero(block == i), np.flatnonzero(block == j)
        self.both = overlaps(sets, self.low, self.high)
        self.either = n[self.low][:, None] + n[self.high][None, :] - self.both
        near = (self.both > 0) & (100 * self.both >= percent * self.either)
        #: A link per pair, above the diagonal where the tile is a block with itself.
        self.near = np.triu(near, 1) if i == j else near


def every_link(docs: DataFrame, found: DataFrame, edges: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(a, b, both, either), a < b: all links between representatives, given their components and the links that connected those."""
    tiles, outside = _tiles(docs, found, edges, None)

    def verified(rows: pa.Table) -> pa.Table:
        tile = _Tile(rows, width, percent)
        at = np.nonzero(tile.near)
        a, b = tile.ids[tile.low[at[0]]], tile.ids[tile.high[at[1]]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "both": tile.both[at], "either": tile.either[at]})

    inside = tiles.groupBy("component", "i", "j").applyInArrow(verified, "a long, b long, both long, either long")
    return outside.union(inside)


def linked_copies(docs: DataFrame, found: DataFrame, edges: DataFrame, copies: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(class_id, linked): how many documents of other classes each class links with. A tile returns one sum per class it holds, not its links."""
    tiles, outside = _tiles(docs, found, edges, copies)

    def counted(rows: pa.Table) -> pa.Table:
        tile, weight = _Tile(rows, width, percent), np.asarray(rows["copies"])
        near = tile.near.astype(np.int64)
        linked = np.zeros(len(weight), np.int64)
        np.add.at(linked, tile.low, near @ weight[tile.high])
        np.add.at(linked, tile.high, near.T @ weight[tile.low])
        own = np.flatnonzero(linked)
        return pa.table({"class_id": tile.ids[own], "linked": linked[own]})

    inside = tiles.groupBy("component", "i", "j").applyInArrow(counted, "class_id long, linked long")
    sides = outside.select(F.col("a").alias("at"), F.col("b").alias("class_id")).union(outside.select(F.col("b").alias("at"), F.col("a").alias("class_id")))
    two = sides.join(copies, "class_id").select(F.col("at").alias("class_id"), F.col("copies").alias("linked"))
    return inside.union(two).groupBy("class_id").agg(F.sum("linked").alias("linked"))


def _members(prof: DataFrame, found: DataFrame) -> DataFrame:
    own = prof.select("doc_id", "n", "f", "g").join(found, ["f", "g", "n"], "left")
    alone = F.col("n") == 0
    return own.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.when(F.col("doc_id").isNotNull(), F.col("class_id"))).alias("class_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.when(F.col("doc_id").isNotNull(), F.col("component"))).alias("component_id"),
    ).dropDuplicates(["doc_id"])


def join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``class_id`` (least document with the same set), ``component_id`` and ``n_links`` of every document.

    A document's set holds its distinct ``width``-word shingles (fewer words: the whole sequence). Two documents link
    when ``100 * both >= percent * either``. A component is closed under links; its id is its least doc_id. ``n_links`` counts the other
    documents that link with this one, those with the same set included; :func:`pairs` has the links themselves.
    Defined cases: a null or empty text, or one of blanks, has an empty set, links with nothing and is its own component; a doc_id names one
    text, and its repeated rows come back once; a null doc_id has no component and no links; texts may have any length; an empty table gives no
    rows; further columns are not read.
    """
    prof, found, edges = connected(docs, width, percent)
    members = materialise(_members(prof, found), "members")
    copies = materialise(members.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("class_id").agg(F.count("*").alias("copies")), "copies")
    linked = materialise(linked_copies(docs, found, edges, copies, width, percent), "linked")
    counts = copies.join(linked, "class_id", "left").select("class_id", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    return members.join(counts, "class_id", "left").select("doc_id", "n_shingles", "class_id", "component_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def pairs(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``a``, ``b``, ``both``, ``either`` of every link between representatives (``class_id`` of :func:`join`), a < b, each once."""
    _, found, edges = connected(docs, width, percent)
    return every_link(docs, found, edges, width, percent)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the document with the least id stays, unchanged; documents without words stay."""
    prof, found, _ = connected(docs)
    gone = _members(prof, found).where("component_id < doc_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes, components and the number of links of every document; :func:`query_links` gives the links."""
    return join(table(spark, sf_dir, "documents"))


def query_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) END) AS sh FROM w),
n AS (SELECT w.doc_id, count(sh) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
h AS (SELECT doc_id, hash(sh) AS sh FROM s),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_n FROM h x JOIN h y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * both_n >= 80 * (p.n + q.n - both_n)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id),
k AS (SELECT a AS doc_id, count(*) AS n_links FROM l GROUP BY a),
c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY xs) AS class_id FROM (SELECT doc_id, list_sort(list(sh)) AS xs FROM h GROUP BY doc_id))
SELECT n.doc_id, n.n AS n_shingles, coalesce(any_value(c.class_id), n.doc_id) AS class_id, min(r.root) AS component_id,
       coalesce(any_value(k.n_links), 0) AS n_links
FROM n JOIN r USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN c USING (doc_id) GROUP BY n.doc_id, n.n
"""
