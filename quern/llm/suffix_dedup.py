"""Removal of byte strings that occur more than once, by sorted suffixes of anchors.

Every string of ``length`` bytes has an anchor: the ``gram`` bytes in it with
the smallest hash (the leftmost of equals). Equal strings have equal anchors at
the same place, so only suffixes that start at anchors need sorting, about one
position in eighty, and of those only anchors whose gram occurs again.

1. Groups of texts send each distinct anchor gram once; buckets count them.
2. Groups send the surroundings of repeated anchors, equal ones once.
3. A bucket sorts the suffixes that start at its anchors, and the reversed
   prefixes that end there, by deep-shallow sorting: multikey quicksort, eight
   bytes a character, to a shallow depth, then blind tries for the groups that
   still agree. Adjacent longest common prefixes then say, for every string
   around an anchor, whether the same bytes stand around another one. All
   comparisons are of bytes; hashes only choose candidates.
4. Groups remove every byte under a repeated string.

A gram that more than ``hot_groups`` groups hold could bring an unbounded
number of different surroundings to one task. Such a hot key is split into its
strings: these are spread over all buckets and compared there by two
independent 64-bit hashes. Two different ones among the 10**14 strings of
100 TB are taken for one with a probability below 1e-10 for the whole corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling
from .common import null_free, prepare, row_salted, text_bytes
from .substring_dedup import SPAN, _text, layout

PLACE_BITS = np.uint64(24)
PLACE = np.uint64((1 << 24) - 1)
SECOND_BASE = 0xA0761D6478BD642F | 1
MOST_SLICE = 1 << 20


# ---- deep-shallow sorting --------------------------------------------------


def blind_trie_order(strings: list[bytes]) -> list[int]:
    """Order of distinct strings of one length, through a blind trie.

    An inner node holds only the depth of its branching and the branching bytes.
    A string is sent down by these bytes alone to some leaf; one comparison with
    that leaf gives the true common prefix, and so the place to insert it.
    """
    root: object = 0
    for new in range(1, len(strings)):
        text = strings[new]
        node = root
        while isinstance(node, list):
            node = node[1].get(text[node[0]]) or next(iter(node[1].values()))
            node = node[0] if isinstance(node, tuple) else node
        other = strings[node]
        depth = next(i for i, (a, b) in enumerate(zip(text, other, strict=True)) if a != b)
        parent, at = None, root
        while isinstance(at, list) and at[0] < depth:
            parent, at = at, at[1][text[at[0]]][0]
        if isinstance(at, list) and at[0] == depth:
            at[1][text[depth]] = (new,)
            continue
        node = [depth, {other[depth]: (at,), text[depth]: (new,)}]
        if parent is None:
            root = node
        else:
            parent[1][text[parent[0]]] = (node,)
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if isinstance(node, list):
            todo += [child for _, (child,) in sorted(node[1].items(), reverse=True)]
        else:
            out.append(node)
    return out


def deep_shallow_sort(rows: np.ndarray, shallow: int = 8) -> np.ndarray:
    """Order of equally long byte rows (width a multiple of 8).

    Multikey quicksort on characters of eight bytes, all open groups at once: a
    group is parted by its middle row's character into smaller, equal and larger
    ones; the equal part goes on with the next character. Groups still equal
    after ``shallow`` characters are ordered by blind tries.
    """
    n = len(rows)
    words = np.ascontiguousarray(rows).view(">u8").reshape(n, -1).astype(np.uint64)
    shallow = min(shallow, words.shape[1])
    order = np.arange(n)
    starts, ends, depth = (np.array([x], np.int64) for x in (0, n, 0))
    if n < 2:
        return order
    deep: list[tuple[int, int]] = []
    while len(starts):
        at_end = depth >= shallow
        deep += zip(starts[at_end].tolist(), ends[at_end].tolist(), strict=True)
        starts, ends, depth = starts[~at_end], ends[~at_end], depth[~at_end]
        if not len(starts):
            break
        size = ends - starts
        group = np.repeat(np.arange(len(starts)), size)
        place = np.arange(len(group)) - np.repeat(np.cumsum(size) - size - starts, size)
        key = words[order[place], depth[group]]
        first = np.cumsum(size) - size
        # the middle one of three keys
        pivots = np.sort(np.stack([key[first], key[first + size // 2], key[first + size - 1]]), axis=0)[1]
        pivot = pivots[group]
        part = (key > pivot).astype(np.int64) + (key >= pivot)
        inner = np.argsort(group * 3 + part, kind="stable")
        order[place] = order[place][inner]
        counts = np.bincount(group * 3 + part, minlength=3 * len(starts)).reshape(-1, 3)
        lo = np.concatenate([starts[:, None], starts[:, None] + np.cumsum(counts, axis=1)[:, :2]], axis=1)
        deeper = np.stack([depth, depth + 1, depth], axis=1)
        open_ = counts > 1
        starts, ends, depth = lo[open_], (lo + counts)[open_], deeper[open_]
    for s, e in deep:
        same: dict[bytes, list[int]] = {}
        for i in order[s:e].tolist():
            same.setdefault(rows[i].tobytes(), []).append(i)
        if len(same) > 1:
            texts = list(same)
            order[s:e] = [i for k in blind_trie_order(texts) for i in same[texts[k]]]
    return order


def adjacent_prefixes(rows: np.ndarray, order: np.ndarray, block: int = 1 << 14) -> np.ndarray:
    """Common prefix of each row with the one before it in ``order``; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    for lo in range(1, len(order), block):
        hi = min(lo + block, len(order))
        differ = rows[order[lo:hi]] != rows[order[lo - 1 : hi - 1]]
        out[lo:hi] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


def repeated_strings(left: np.ndarray, right: np.ndarray, gram: int, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """For each surrounding and each d, whether another one has the same d bytes before and length - d bytes from its anchor.

    left: bytes before the anchor, nearest first. right: bytes from the anchor
    on. Only d in [least, most] count. Rows are distinct.
    """
    n, length, reach = len(right), right.shape[1], left.shape[1]
    order = deep_shallow_sort(right)
    common = adjacent_prefixes(right, order)
    same_gram = np.empty(n, np.int64)
    same_gram[order] = np.cumsum(common < gram)
    pad = -(reach + 8) % 8
    keyed = np.concatenate([same_gram.astype(">i8").view(np.uint8).reshape(n, 8), left, np.zeros((n, pad), np.uint8)], axis=1)
    left_order = deep_shallow_sort(keyed)
    left_common = adjacent_prefixes(keyed, left_order) - 8
    # the longest match of a row lies beside it in each order, which bounds the d that can be repeated
    low, high = least, most
    for sorted_, prefixes, on_left in ((left_order, left_common, True), (order, common, False)):
        longest = np.empty(n, np.int64)
        longest[sorted_] = np.maximum(prefixes, np.append(prefixes[1:], 0))
        low, high = (low, np.minimum(high, longest)) if on_left else (np.maximum(low, length - longest), high)
    out = np.zeros((n, reach + 1), bool)
    own, other = np.empty(n, np.int64), np.empty(n, np.int64)
    may = np.flatnonzero(low <= high)
    if not len(may):
        return out
    for d in range(int(low[may].min()), int(high[may].max()) + 1):
        at = may[(low[may] <= d) & (d <= high[may])]
        if not len(at):
            continue
        # two rows share a string if no common prefix between them, in either order, is too short
        own[left_order] = np.cumsum(left_common < d)
        other[order] = np.cumsum(common < length - d)
        key = own[at] * (n + 1) + other[at]
        by_key = np.argsort(key)
        same = np.diff(key[by_key]) == 0
        twin = np.zeros(len(at), bool)
        twin[1:] |= same
        twin[:-1] |= same
        out[at[by_key[twin]], d] = True
    return out


# ---- anchors ---------------------------------------------------------------


class Anchors:
    """Anchors of one slice of texts: place, first and last start of their strings, gram hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
        self.data, self.offsets, self.length = data, offsets, length
        n, width = len(data), length - gram + 1
        none = np.empty(0, np.int64)
        self.place = self.first = self.last = none
        self.hash = np.empty(0, np.uint64)
        if n < length:
            return
        self.sums = rolling.prefix_sums(rolling.byte_values(data), rolling.BYTE_BASE)
        inverse = rolling.powers(pow(rolling.BYTE_BASE, -1, 2**64), n)
        grams = n - gram + 1
        hashes = rolling.mix((self.sums[gram:] - self.sums[:grams]) * inverse[:grams])
        keys = np.full(-(-grams // width) * width, np.iinfo(np.uint64).max, np.uint64)
        keys[:grams] = hashes & ~PLACE | np.arange(grams, dtype=np.uint64)
        boxes = keys.reshape(-1, width)
        forward = np.minimum.accumulate(boxes, axis=1).ravel()
        backward = np.minimum.accumulate(boxes[:, ::-1], axis=1)[:, ::-1].ravel()
        starts = n - length + 1
        place = (np.minimum(backward[:starts], forward[width - 1 : width - 1 + starts]) & PLACE).astype(np.int64)
        row = np.searchsorted(offsets, np.arange(starts), "right") - 1
        valid = np.flatnonzero(np.arange(starts) + length <= offsets[row + 1])
        if not len(valid):
            return
        place = place[valid]
        new = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (valid[1:] != valid[:-1] + 1)))
        self.place, self.first, self.last = place[new], valid[new], valid[np.append(new[1:], len(valid)) - 1]
        self.hash = hashes[self.place]

    def surroundings(self, which: np.ndarray, reach: int) -> np.ndarray:
        """Rows of ``reach`` bytes before and ``length`` bytes from the anchor, zero where no string of it lies, with the two limits of d."""
        place, first, last = self.place[which], self.first[which], self.last[which]
        at = place[:, None] + np.arange(-reach, self.length)
        inside = (at >= first[:, None]) & (at < last[:, None] + self.length)
        rows = np.where(inside, self.data[np.where(inside, at, 0)], np.uint8(0))
        limits = np.stack([place - last, place - first], axis=1).astype(np.uint8)
        return np.concatenate([rows, limits], axis=1)

    def strings(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of all strings of these anchors, their hashes and second hashes."""
        if not len(which):
            return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
        count = self.last[which] - self.first[which] + 1
        start = np.repeat(self.first[which] - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(int(count.sum()))
        hashes = rolling.mix(rolling.span_hash(self.sums, start, start + self.length, rolling.BYTE_BASE))
        sums = rolling.prefix_sums(rolling.byte_values(self.data), SECOND_BASE)
        return start, hashes, rolling.mix(rolling.span_hash(sums, start, start + self.length, SECOND_BASE))


def slices(column: pa.Array, length: int, gram: int) -> list[tuple[int, int, int, Anchors]]:
    """(first row, last row, bytes before this part of the row, anchors); a very long text comes in overlapping parts."""
    out = []
    for lo, hi in rolling.text_slices(column, MOST_SLICE):
        data, offsets = rolling.flat(column, lo, hi)
        if len(data) <= 8 * MOST_SLICE:
            out.append((lo, hi, 0, Anchors(data, offsets, length, gram)))
            continue
        for at in range(0, len(data) - length + 1, 4 * MOST_SLICE):
            part = data[at : at + 4 * MOST_SLICE + length - 1]
            out.append((lo, hi, at, Anchors(part, np.array([0, len(part)]), length, gram)))
    return out


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    mixed = rolling.mix(hashes ^ np.uint64(0x2545F4914F6CDD1D))
    return ((mixed >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def packed(hashes: np.ndarray, bucket: np.ndarray, second: np.ndarray | None = None):
    """Distinct hashes, or pairs of them, by bucket: the rows, their buckets, which stand for several, and for every input its place among them."""
    columns = [hashes] if second is None else [hashes, second]
    order = np.lexsort((*reversed(columns), bucket))
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([x[order][1:] != x[order][:-1] for x in (bucket, *columns)], axis=0)
    first = np.flatnonzero(new)
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    again = np.diff(np.append(first, len(order))) > 1
    kept = order[first]
    return np.stack([x[kept] for x in columns], axis=1), bucket[kept], again, place


def _bucket_rows(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    if not len(bucket):
        return []
    cuts = np.append(0, np.flatnonzero(np.diff(bucket)) + 1)
    return [(int(bucket[s]), int(s), int(e)) for s, e in zip(cuts, np.append(cuts[1:], len(bucket)), strict=True)]


SENT = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("grp", pa.int32()), ("n", pa.int64()), ("sent", pa.binary()), ("again", pa.binary())])
SENT_SQL = "kind int, bucket int, grp int, n long, sent binary, again binary"
ANSWER = pa.schema([("grp", pa.int32()), ("kind", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64()), ("repeated", pa.binary()), ("hot", pa.binary())])
ANSWER_SQL = "grp int, kind int, bucket int, n long, repeated binary, hot binary"
GRAMS, STRINGS, UNITS = 0, 1, 2


def _send(kind: int, grp: int, rows: np.ndarray, bucket: np.ndarray, again: np.ndarray) -> pa.Table:
    """Rows of one kind, packed by bucket, which ascends."""
    cuts = _bucket_rows(bucket)
    return pa.Table.from_pydict({"kind": [kind] * len(cuts), "bucket": [c[0] for c in cuts], "grp": [grp] * len(cuts), "n": [e - s for _, s, e in cuts], "sent": [rows[s:e].tobytes() for _, s, e in cuts], "again": [np.packbits(again[s:e]).tobytes() for _, s, e in cuts]}, SENT)


def _bits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def _send_grams(length: int, gram: int, buckets: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        found = slices(_text(table), length, gram)
        hashes = np.concatenate([np.empty(0, np.uint64), *(a.hash for _, _, _, a in found)])
        h, b, again, _ = packed(hashes, _bucket(hashes, buckets))
        return _send(GRAMS, key[0].as_py(), h, b, again)

    return run


def _count(kind: int, hot_groups: int):
    """Answers, one bit for each hash sent: is it repeated, and did more than ``hot_groups`` groups send it?"""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        sizes = table.column("n").to_pylist()
        sent = np.frombuffer(b"".join(table.column("sent").to_pylist()), np.uint64).reshape(sum(sizes), -1).T
        again = np.concatenate([_bits(x, n) for x, n in zip(table.column("again").to_pylist(), sizes, strict=True)])
        order = np.lexsort(tuple(sent)) if len(sent) > 1 else np.argsort(sent[0])
        new = np.any([np.append(True, np.diff(x[order]) != 0) for x in sent], axis=0)
        first = np.flatnonzero(new)
        count = np.empty(len(order), np.int64)
        count[order] = np.diff(np.append(first, len(order)))[np.cumsum(new) - 1]
        repeated, hot = (count > 1) | again, count > hot_groups
        ends = np.cumsum(sizes)
        cut = [(e - n, e) for e, n in zip(ends.tolist(), sizes, strict=True)]
        return pa.Table.from_pydict({"grp": table.column("grp").to_pylist(), "kind": [kind] * len(cut), "bucket": table.column("bucket").to_pylist(), "n": sizes, "repeated": [np.packbits(repeated[s:e]).tobytes() for s, e in cut], "hot": [np.packbits(hot[s:e]).tobytes() for s, e in cut]}, ANSWER)

    return run


def _answers(table: pa.Table, kind: int, field: str) -> np.ndarray:
    rows = [r for r in zip(*(table.column(c).to_pylist() for c in ("kind", "bucket", "n", field)), strict=True) if r[0] == kind]
    return np.concatenate([np.empty(0, bool), *(_bits(raw, n) for _, _, n, raw in sorted(rows))])


class Group:
    """What a group derives, twice alike, from its texts and the answers about its grams."""

    def __init__(self, texts: pa.Array, answers: pa.Table, length: int, gram: int, buckets: int):
        self.slices = slices(texts, length, gram)
        reach = length - gram
        hashes = np.concatenate([np.empty(0, np.uint64), *(a.hash for _, _, _, a in self.slices)])
        _, _, _, place = packed(hashes, _bucket(hashes, buckets))
        repeated, hot = (_answers(answers, GRAMS, f)[place] if len(hashes) else np.empty(0, bool) for f in ("repeated", "hot"))
        self.candidates, self.hot, rows, own, strings = [], [], [], [], []
        done = 0
        for _, _, _, anchors in self.slices:
            r, h = (x[done : done + len(anchors.hash)] for x in (repeated, hot))
            done += len(anchors.hash)
            self.candidates.append(np.flatnonzero(r & ~h))
            self.hot.append(anchors.strings(np.flatnonzero(r & h)))
            rows.append(anchors.surroundings(self.candidates[-1], reach))
            own.append(anchors.hash[self.candidates[-1]])
        # equal surroundings are one unit
        rows = np.concatenate([np.empty((0, reach + length + 2), np.uint8), *rows])
        own = np.concatenate([np.empty(0, np.uint64), *own])
        sums = (rows * rolling.powers(SECOND_BASE, rows.shape[1])).sum(axis=1, dtype=np.uint64) if len(rows) < 1 << 14 else _row_sums(rows)
        key = rolling.mix(rolling.mix(sums) ^ own)
        _, self.unit_bucket, self.unit_again, self.unit = packed(key, _bucket(own, buckets))
        first = np.empty(len(self.unit_bucket), np.int64)
        first[self.unit[::-1]] = np.arange(len(self.unit))[::-1]
        if not (rows[first[self.unit]] == rows).all():  # two surroundings of one hash: keep all apart
            order = np.argsort(_bucket(own, buckets), kind="stable")
            self.unit = np.empty(len(rows), np.int64)
            self.unit[order] = np.arange(len(rows))
            self.unit_bucket, self.unit_again, first = _bucket(own, buckets)[order], np.zeros(len(rows), bool), order
        self.rows = rows[first]
        self.string_hashes, self.string_second = (np.concatenate([np.empty(0, np.uint64), *(s[i] for s in self.hot)]) for i in (1, 2))
        self.string_bucket = _bucket(self.string_second, buckets)


def _row_sums(rows: np.ndarray, block: int = 1 << 13) -> np.ndarray:
    weights = rolling.powers(SECOND_BASE, rows.shape[1])
    return np.concatenate([(rows[i : i + block] * weights).sum(axis=1, dtype=np.uint64) for i in range(0, len(rows), block)])


def _send_units(length: int, gram: int, buckets: int):
    """Surroundings of repeated anchors, and the strings of those that are hot."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return SENT.empty_table()
        g, grp = Group(_text(left), right, length, gram, buckets), key[0].as_py()
        h, b, again, _ = packed(g.string_hashes, g.string_bucket, g.string_second)
        return pa.concat_tables([_send(UNITS, grp, g.rows, g.unit_bucket, g.unit_again), _send(STRINGS, grp, h, b, again)])

    return run


def _decide(length: int, gram: int, hot_groups: int):
    """A bucket of units or of strings."""
    sort, count = _sort_units(length, gram), _count(STRINGS, hot_groups)
    return lambda key, table: (sort if key[0].as_py() == UNITS else count)(key, table)


def _sort_units(length: int, gram: int):
    reach = length - gram

    def run(key: tuple, table: pa.Table) -> pa.Table:
        sizes = table.column("n").to_pylist()
        rows = np.concatenate([np.frombuffer(x, np.uint8).reshape(-1, reach + length + 2) for x in table.column("sent").to_pylist()])
        again = np.concatenate([_bits(x, n) for x, n in zip(table.column("again").to_pylist(), sizes, strict=True)])
        # equal units of several groups are one, and then all their strings are repeated
        _, first, inverse, count = np.unique(_row_sums(rows), return_index=True, return_inverse=True, return_counts=True)
        if not (rows[first[inverse]] == rows).all():
            first, inverse, count = np.arange(len(rows)), np.arange(len(rows)), np.ones(len(rows), np.int64)
        distinct, more = rows[first], count > 1
        np.logical_or.at(more, inverse, again)
        least, most = distinct[:, -2].astype(np.int64), distinct[:, -1].astype(np.int64)
        d = np.arange(reach + 1)
        out = more[:, None] & (least[:, None] <= d) & (d <= most[:, None])
        # only grams with several different units are left to sort
        _, gram_inverse, units = np.unique(_row_sums(distinct[:, reach : reach + gram]), return_inverse=True, return_counts=True)
        todo = np.flatnonzero(units[gram_inverse] > 1)
        if len(todo):
            x = distinct[todo]
            out[todo] |= repeated_strings(x[:, :reach][:, ::-1], np.ascontiguousarray(x[:, reach : reach + length]), gram, least[todo], most[todo])
        bits = np.packbits(out, axis=1)[inverse]
        ends = np.cumsum(sizes)
        return pa.Table.from_pydict({"grp": table.column("grp").to_pylist(), "kind": [UNITS] * len(sizes), "bucket": table.column("bucket").to_pylist(), "n": [n * bits.shape[1] * 8 for n in sizes], "repeated": [bits[e - n : e].tobytes() for e, n in zip(ends, sizes, strict=True)], "hot": [b""] * len(sizes)}, ANSWER)

    return run


KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("removed", SPAN), ("kept", pa.binary())])
KEPT_SQL = "doc_id long, n_bytes long, n_removed long, removed array<struct<start: long, end: long>>, kept binary"


def _remove(length: int, gram: int, buckets: int):
    reach = length - gram

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = _text(left)
        g = Group(texts, right, length, gram, buckets)
        units = _answers(right, UNITS, "repeated").reshape(-1, -(-(reach + 1) // 8) * 8)[:, : reach + 1]
        _, _, _, place = packed(g.string_hashes, g.string_bucket, g.string_second)
        hot = _answers(right, STRINGS, "repeated")[place] if len(place) else np.empty(0, bool)
        gone: dict[int, list[np.ndarray]] = {}  # by first row: starts of repeated strings
        done = hot_done = 0
        for (lo, _, before, anchors), candidates, (start, _, _) in zip(g.slices, g.candidates, g.hot, strict=True):
            which, d = np.nonzero(units[g.unit[done : done + len(candidates)]]) if len(candidates) else (np.empty(0, np.int64),) * 2
            done += len(candidates)
            gone.setdefault(lo, []).append(anchors.place[candidates[which]] - d + before)
            gone[lo].append(start[hot[hot_done : hot_done + len(start)]] + before)
            hot_done += len(start)
        out: dict[str, list] = {"n_bytes": [], "n_removed": [], "removed": [], "kept": []}
        for lo, hi in rolling.text_slices(texts, MOST_SLICE):
            data, offsets = rolling.flat(texts, lo, hi)
            cover = rolling.covered(np.concatenate([np.empty(0, np.int64), *gone.get(lo, [])]), length, len(data))
            for row in range(hi - lo):
                own, mask = data[offsets[row] : offsets[row + 1]], cover[offsets[row] : offsets[row + 1]]
                spans = [{"start": s, "end": e} for s, e in zip(*(x.tolist() for x in rolling.runs(mask)), strict=True)] if mask.any() else []
                kept = own[~mask] if spans else own
                out["n_bytes"].append(len(own))
                out["n_removed"].append(len(own) - len(kept))
                out["removed"].append(spans)
                out["kept"].append(kept.tobytes())
        return pa.Table.from_pydict({"doc_id": left.column("doc_id"), **out}, KEPT)

    return run


def remove_repeated_bytes(docs: DataFrame, *, length: int = 200, gram: int = 48, hot_groups: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_removed, removed, kept) of every row of ``docs`` (doc_id, text).

    A byte of the UTF-8 text goes when it lies in a string of ``length`` bytes
    that also starts elsewhere, in the same text or another; overlaps count,
    matches never cross texts, strings are judged on the input. removed: the
    maximal [start, end) runs. kept: the remaining bytes.

    Null and empty texts, and texts shorter than a string, lose nothing.
    Repeated rows are texts of their own, so both lose their strings. Null ids
    stay null. A very long text is taken in overlapping parts. Other columns are
    ignored, an empty table gives no rows.
    """
    if not 8 <= gram <= length or (length - gram) > 255:
        raise ValueError("gram must lie between 8 and length, and length - gram must be below 256")
    spark = docs.sparkSession
    prepare(spark)
    groups, buckets = layout(text_bytes(docs))
    base = null_free(row_salted(docs, F.col("doc_id").cast("long").alias("doc_id"), F.col("text")))
    grouped = base.withColumn("grp", F.pmod("salt", F.lit(groups)).cast("int")).drop("salt")
    grams = grouped.groupBy("grp").applyInArrow(_send_grams(length, gram, buckets), SENT_SQL)
    flags = grams.groupBy("bucket").applyInArrow(_count(GRAMS, hot_groups), ANSWER_SQL)
    units = grouped.groupBy("grp").cogroup(flags.groupBy("grp")).applyInArrow(_send_units(length, gram, buckets), SENT_SQL)
    answers = flags.union(units.groupBy("kind", "bucket").applyInArrow(_decide(length, gram, hot_groups), ANSWER_SQL))
    return grouped.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(_remove(length, gram, buckets), KEPT_SQL)
