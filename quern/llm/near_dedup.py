"""Near-duplicate detection by one-permutation MinHash, banding and star edges.

Texts with equal shingle sets form one class; only class representatives go on.
Their sketches come from one hash pass with optimal densification: an empty bin
copies the bin that its own fixed random order reaches first. Bands of a sketch
are buckets. Each bucket sends star edges from its smallest member, so pairs
grow with the rows and not with a group's square.

A star can miss a link between two members that are both unlike the centre. So
of each bucket whose other members are still in different components after the
star edges, all members outside the largest component are compared with all of
other components. Buckets of one centre are one group, since their members are
mostly the same.

Both comparisons run inside blocks: a document's full set travels once to each
block that needs it, a block holds a bounded number of shingles, a large group
is a grid of blocks, and only confirmed edges, no more than members, come out.
No pair is ever a row of a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling
from .bitmap import BitMap
from .common import materialize, null_free, prepare
from .graph import components, smallest_reachable
from .substring_dedup import INSIDE

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SKETCH = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key1", pa.int64()), ("key2", pa.int64()), ("bands", pa.list_(pa.int64()))])
SKETCH_SQL = "doc_id long, n long, key1 long, key2 long, bands array<long>"
#: Shingles of one side of a comparison, and members of it; a larger side is cut into several.
SIDE_SHINGLES, SIDE_MEMBERS = 1 << 19, 2048
#: Places in one list of where a set travels to.
PLACES = 256


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each row: ``size`` words each, or all words of a shorter row."""
    for lo, hi in rolling.text_slices(column):
        data, offsets = rolling.flat(column, lo, hi)
        low = LOWER[data]
        words = rolling.split_words(low, offsets, INSIDE)
        hashes = rolling.word_hashes(low, words)
        start, found = rolling.windows(hashes, words.row, size)
        first = np.searchsorted(start, words.first)
        sums = rolling.prefix_sums(hashes, rolling.WORD_BASE)
        for row in range(hi - lo):
            a, b = words.first[row], words.first[row + 1]
            if b - a >= size or a == b:
                yield np.unique(found[first[row] : first[row + 1]])
            else:
                whole = rolling.span_hash(sums, np.array([a]), np.array([b]), rolling.WORD_BASE)
                yield rolling.mix(whole + np.uint64(b - a))


class Sketcher:
    def __init__(self, bands: int, rows: int):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        rng = np.random.Generator(np.random.PCG64(7))
        # for each bin a fixed random order of all bins: where an empty one looks for a value
        self.order = np.argsort(rng.random((self.bins, self.bins)), axis=1)
        self.salt = rng.integers(1, 2**63, self.bins, dtype=np.uint64)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """Band keys of a non-empty shingle set."""
        values = np.full(self.bins, np.iinfo(np.uint64).max, np.uint64)
        h = rolling.mix(hashes)
        np.minimum.at(values, ((h >> np.uint64(32)) * np.uint64(self.bins) >> np.uint64(32)).astype(np.int64), h << np.uint64(32) | h >> np.uint64(32))
        filled = values != np.iinfo(np.uint64).max
        empty = np.flatnonzero(~filled)
        if len(empty):
            order = self.order[empty]
            values[empty] = values[order[np.arange(len(empty)), filled[order].argmax(axis=1)]]
        mixed = rolling.mix(values ^ self.salt).reshape(self.bands, self.rows)
        return rolling.mix(mixed.sum(axis=1, dtype=np.uint64) ^ self.salt[: self.bands]).view(np.int64)


def _sketch(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketcher(bands, rows)
        for batch in batches:
            out: dict[str, list] = {"n": [], "key1": [], "key2": [], "bands": []}
            for found in shingle_sets(batch.column(1), size):
                out["n"].append(len(found))
                out["key1"].append(int(found.sum(dtype=np.uint64).view(np.int64)))
                out["key2"].append(int(rolling.mix(found ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)))
                out["bands"].append(sketch(found) if len(found) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[k], SKETCH.field(k).type) for k in out)], SKETCH.names)

    return run


DEALT = pa.schema([("block", pa.int32()), ("node", pa.int64()), ("unit", pa.list_(pa.int64())), ("first", pa.list_(pa.bool_())), ("root", pa.list_(pa.int64())), ("shingles", pa.list_(pa.int64()))])
DEALT_SQL = "block int, node long, unit array<long>, first array<boolean>, root array<long>, shingles array<long>"


def _deal(size: int):
    """(node, text, places) to its shingle set, once for each block it has a place in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            held, seen = 0, set()
            for node, places, found in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), shingle_sets(batch.column(1), size), strict=True):
                key = node, len(found), int(found.sum(dtype=np.uint64)), places[0]["unit"]
                if key in seen:  # a repeated row
                    continue
                seen.add(key)
                by_block: dict[int, list] = {}
                for place in places:
                    by_block.setdefault(place["block"], []).append(place)
                for block, own in by_block.items():
                    rows.append((block, node, *([x[name] for x in own] for name in ("unit", "first", "root")), found.view(np.int64)))
                    held += len(found)
                    if held > 1 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
            if rows:
                yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), DEALT, strict=True)], schema=DEALT)


def _shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of ``a`` with every set of ``b``."""
    out = np.zeros((len(a), len(b)), np.float32)
    common = np.intersect1d(np.concatenate(a), np.concatenate(b))
    if not len(common):
        return out
    sides = []
    for sets in (a, b):
        row, value = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets)
        at = np.minimum(np.searchsorted(common, value), len(common) - 1)
        held = common[at] == value
        order = np.argsort(at[held], kind="stable")
        row, at = row[held][order], at[held][order]
        sides.append((row, np.searchsorted(at, np.arange(len(common) + 1))))
    (ra, ea), (rb, eb) = sides
    na, nb = np.diff(ea), np.diff(eb)
    # rare shingles pair by pair, the others by products of matrices of ones and zeros
    rare = np.flatnonzero(na * nb <= 256)
    for lo in range(0, len(rare), 1 << 14):
        ids = rare[lo : lo + (1 << 14)]
        each = (na * nb)[ids]
        which = np.repeat(ids, each)
        k = np.arange(len(which)) - np.repeat(np.cumsum(each) - each, each)
        np.add.at(out, (ra[ea[which] + k // nb[which]], rb[eb[which] + k % nb[which]]), 1)
    often = np.flatnonzero(na * nb > 256)
    for lo in range(0, len(often), 512):
        ids = often[lo : lo + 512]
        ones = []
        for rows, edges, n, size in ((ra, ea, na, len(a)), (rb, eb, nb, len(b))):
            m = np.zeros((size, len(ids)), np.float32)
            column = np.repeat(np.arange(len(ids)), n[ids])
            k = np.arange(len(column)) - np.repeat(np.cumsum(n[ids]) - n[ids], n[ids])
            m[rows[np.repeat(edges[ids], n[ids]) + k], column] = 1
            ones.append(m)
        out += ones[0] @ ones[1].T
    return out


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """starts[0] .. ends[0]-1, starts[1] .. ends[1]-1 and so on."""
    n = ends - starts
    return np.arange(n.sum()) + np.repeat(starts - np.cumsum(n) + n, n)


def _compare(percent: int):
    """(u, v) that join the same nodes as all links between first and other members of the block's units."""

    def links(first, other, n, root, edges, code, mark) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if len(first) <= 8 or len(other) <= 8:
            few, many = (first, other) if len(first) <= len(other) else (other, first)
            for x in few.tolist():
                may = many[(root[many] != root[x]) & (100 * np.minimum(n[many], n[x]) >= percent * np.maximum(n[many], n[x]))]
                if len(may):
                    own = code[edges[x] : edges[x + 1]]
                    mark[own] = True
                    at = np.concatenate([[0], np.cumsum(n[may])])
                    shared = np.add.reduceat(mark[code[_ranges(edges[may], edges[may + 1])]], at[:-1], dtype=np.int64)
                    mark[own] = False
                    linked = may[100 * shared >= percent * (n[may] + n[x] - shared)]
                    yield np.full(len(linked), x), linked
            return
        for lo in range(0, len(first), SIDE_MEMBERS):
            for to in range(0, len(other), SIDE_MEMBERS):
                a, b = first[lo : lo + SIDE_MEMBERS], other[to : to + SIDE_MEMBERS]
                shared = _shared([code[edges[k] : edges[k + 1]] for k in a], [code[edges[k] : edges[k + 1]] for k in b]).astype(np.int64)
                x, y = np.nonzero((100 * shared >= percent * (n[a][:, None] + n[b][None, :] - shared)) & (root[a][:, None] != root[b][None, :]))
                yield a[x], b[y]

    def run(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        node = np.asarray(block["node"])
        flat = {name: block[name].combine_chunks() for name in ("unit", "first", "root", "shingles")}
        edges, values = np.asarray(flat["shingles"].offsets).astype(np.int64), np.asarray(flat["shingles"].values)
        edges = edges - edges[0]
        values = values[: edges[-1]]
        known, code = np.unique(values, return_inverse=True)
        code, n, mark = code.astype(np.int32), np.diff(edges), np.zeros(len(known), bool)
        del known, values
        unit, first, root = (np.asarray(flat[name].flatten().to_numpy(zero_copy_only=False)) for name in ("unit", "first", "root"))
        row = np.repeat(np.arange(len(node)), np.diff(np.asarray(flat["unit"].offsets)))
        order = np.lexsort((row, unit))
        cuts = np.flatnonzero(np.diff(unit[order], prepend=unit[order][:1] - 1, append=unit[order][-1:] + 1))
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        whose = np.zeros(len(node), np.int64)
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own = order[lo:hi]
            whose[row[own]] = root[own]
            found = list(links(row[own[first[own]]], row[own[~first[own]]], n, whose, edges, code, mark))
            u, v = (node[np.concatenate([f[k] for f in found])] if found else np.zeros(0, np.int64) for k in (0, 1))
            if len(u):
                u, v = smallest_reachable(u, v)
                us.append(u[u != v])
                vs.append(v[u != v])
        return pa.table({"u": pa.array(np.concatenate(us), pa.int64()), "v": pa.array(np.concatenate(vs), pa.int64())})

    return run


def _linked(docs: DataFrame, places: DataFrame, size: int, percent: int) -> DataFrame:
    """Edges that join what all links within the units of ``places`` join.

    places: (unit, node, first, root, n, part). In each unit first members are
    compared with other ones, unless their roots are equal. A node's places of
    one ``part`` travel together; a unit has at most about two sides' shingles.
    """
    places = materialize(places, "places")
    total = places.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0
    blocks = max(1, -(-total // SIDE_SHINGLES))
    place = F.struct(F.pmod(F.xxhash64("unit"), F.lit(blocks)).cast("int").alias("block"), "unit", "first", "root")
    lists = places.groupBy("node", "part").agg(F.collect_list(place).alias("places"))
    # texts without a place stay where they are; the lists grow with the data, so they are not broadcast
    texts = docs.filter(BitMap(places.select("node").distinct(), "node").may_hold("doc_id"))
    dealt = texts.join(lists.hint("merge"), F.col("doc_id") == F.col("node")).select("node", "text", "places").mapInArrow(_deal(size), DEALT_SQL)
    return materialize(dealt.groupBy("block").applyInArrow(_compare(percent), "u long, v long").distinct(), "links")


def _sides(members, shingles):
    """Into how many parts a side of so many members and shingles is cut."""
    return F.greatest(F.ceil(members / SIDE_MEMBERS), F.ceil(shingles / SIDE_SHINGLES), F.lit(1)).cast("int")


def _crowded(buckets: DataFrame) -> DataFrame:
    """(key, node, n, centre) of the members of each bucket besides its centre, the smallest node.

    One order of nodes for all bands: a group's members then mostly meet the same
    few centres, so their edges repeat and distinct ones stay few.
    """
    centres = buckets.groupBy("key").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("members"))
    centres = materialize(centres.filter("members > 1").select("key", "centre"), "centres")
    return materialize(buckets.join(centres, "key").filter("node <> centre").select("key", "node", "n", "centre"), "crowded")


def _stars(crowded: DataFrame) -> DataFrame:
    """Places for comparing each centre with the other members of its buckets."""
    members = materialize(crowded.select("centre", "node", "n").distinct(), "members")
    cut = members.groupBy("centre").agg(_sides(F.count(F.lit(1)) / 8, F.sum(F.col("n").cast("long"))).alias("parts"))
    cut = materialize(cut, "cut")
    unit = lambda part: F.xxhash64("centre", part)
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    others = members.join(cut, "centre").select(unit(own).alias("unit"), "node", F.lit(False).alias("first"), F.col("node").alias("root"), "n", F.lit(0).alias("part"))
    centres = cut.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    centres = centres.select(unit(F.col("k")).alias("unit"), F.col("centre").alias("node"), F.lit(True).alias("first"), F.col("centre").alias("root"), F.lit(0).alias("n"), F.floor(F.col("k") / PLACES).cast("int").alias("part"))
    return others.unionByName(centres)


def _across(crowded: DataFrame, roots: DataFrame) -> DataFrame:
    """Places for comparing members of one bucket that are in different components.

    Centres were compared before. Of a group's members those outside its largest
    component are first in a grid of units, and all are others.
    """
    labelled = materialize(crowded.join(roots, "node", "left").select("key", "centre", "node", "n", F.coalesce("root", "node").alias("root")), "labelled")
    mixed = labelled.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key")
    members = materialize(labelled.join(mixed, "key").select("centre", "node", "n", "root").distinct(), "open")
    sizes = members.groupBy("centre", "root").agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("n").cast("long")).alias("s"))
    groups = sizes.groupBy("centre").agg(F.max(F.struct("c", "root", "s")).alias("main"), F.sum("c").alias("c"), F.sum("s").alias("s"))
    groups = groups.select("centre", F.col("main.root").alias("main"), _sides(F.col("c") - F.col("main.c"), F.col("s") - F.col("main.s")).alias("few"), _sides(F.col("c"), F.col("s")).alias("all"))
    placed = materialize(members.join(materialize(groups, "groups"), "centre").withColumn("salt", F.xxhash64("node")), "placed")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod("salt", F.col(n)).cast("int")
    first = placed.filter("root <> main").withColumn("i", own("few")).withColumn("j", every("all")).withColumn("at", F.col("j"))
    other = placed.withColumn("j", own("all")).withColumn("i", every("few")).withColumn("at", F.col("i"))
    both = first.withColumn("first", F.lit(True)).unionByName(other.withColumn("first", F.lit(False)))
    return both.select(F.xxhash64("centre", "i", "j").alias("unit"), "node", "first", "root", "n", F.floor(F.col("at") / PLACES).cast("int").alias("part"))


def find_near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, bands: int = 40, rows: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text).

    A link needs 100 * |A & B| >= percent * |A | B|, on sets of ``shingle``
    words. component_id is the smallest doc_id reachable over links between
    texts that share a band. A pair of similarity s shares none with probability
    (1 - s**rows)**bands: 1e-7 at 80 percent here, 3e-7 at 85 percent with 32
    bands of 6 rows. Besides this, no link is lost.

    Null or wordless texts have the empty set and link with nothing. A row with
    null doc_id links with nothing, has null component_id and is kept. Rows of
    the same doc_id count as one document; identical rows get equal results.
    Very long texts are one set each. Other columns are ignored, an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    base = null_free(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    sketches = materialize(base.mapInArrow(_sketch(shingle, bands, rows), SKETCH_SQL), "sketches")
    linkable = sketches.filter("n > 0 and doc_id is not null")
    classes = materialize(linkable.groupBy("key1", "key2", "n").agg(F.min(F.struct("doc_id", "bands")).alias("least")).select("key1", "key2", "n", F.col("least.doc_id").alias("node"), F.col("least.bands").alias("bands")), "classes")
    crowded = _crowded(classes.select(F.explode("bands").alias("key"), "node", F.col("n").cast("int").alias("n")))
    links = _linked(base, _stars(crowded), shingle, percent)
    roots = materialize(components(links), "roots")
    more = _linked(base, _across(crowded, roots), shingle, percent)
    if not more.isEmpty():
        roots = materialize(components(links.union(more)), "roots")
    named = classes.select("key1", "key2", "n", "node").join(roots, "node", "left").select("key1", "key2", "n", F.coalesce("root", "node").alias("root"))
    named = materialize(named, "named")
    out = sketches.select("doc_id", "n", "key1", "key2").join(named, ["key1", "key2", "n"], "left")
    component = F.when(F.col("n") > 0, F.col("root")).otherwise(F.col("doc_id"))
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), component))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
