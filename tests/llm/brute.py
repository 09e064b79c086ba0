"""Plain-Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def covered(n: int, starts, length: int) -> list[bool]:
    edge = [0] * (n + 1)
    for s in starts:
        edge[s] += 1
        edge[s + length] -= 1
    out, depth = [], 0
    for e in edge[:-1]:
        depth += e
        out.append(depth > 0)
    return out


def substring(docs: list[tuple], window: int) -> list[tuple]:
    """(doc_id, n_words, n_removed, kept_sha256)"""
    words = [(i, (t or "").encode().split()) for i, t in docs]
    count = Counter(tuple(w[k : k + window]) for _, w in words for k in range(len(w) - window + 1))
    out = []
    for i, w in words:
        gone = covered(len(w), [k for k in range(len(w) - window + 1) if count[tuple(w[k : k + window])] > 1], window)
        out.append((i, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return out


def suffix(docs: list[tuple], length: int) -> list[tuple]:
    """(doc_id, n_bytes, n_removed, n_spans, kept)"""
    raw = [(i, (t or "").encode()) for i, t in docs]
    count = Counter(b[k : k + length] for _, b in raw for k in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        gone = covered(len(b), [k for k in range(len(b) - length + 1) if count[b[k : k + length]] > 1], length)
        spans = sum(g and not p for g, p in zip(gone, [False, *gone], strict=False))
        out.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def shingles(text: str | None, size: int = 3) -> set:
    w = (text or "").encode().translate(LOWER).split()
    if not w:
        return set()
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or {tuple(w)}


def near(docs: list[tuple], percent: int = 85, size: int = 3) -> list[tuple]:
    """(doc_id, n_shingles, component_id, kept); ids must be distinct."""
    sets = {i: shingles(t, size) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for i in sorted(sets):
        common = Counter(j for s in sets[i] for j in where[s])
        for j, n in common.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
        for s in sets[i]:
            where[s].append(i)
    return [(i, len(sets[i]), find(i), find(i) == i) for i, _ in docs]


def contamination(docs: list[tuple], items: list[tuple], n: int = 10) -> list[tuple]:
    """(doc_id, n_words, n_hit, items)"""
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall((t or "").encode().translate(LOWER))
    windows = defaultdict(set)
    for i, t in items:
        w = split(t)
        size = min(n, len(w))
        for k in range(len(w) - size + 1 if size else 0):
            windows[tuple(w[k : k + size])].add(i)
    out = []
    for i, t in docs:
        w = split(t)
        starts, found = defaultdict(list), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    starts[size].append(k)
                    found |= windows[tuple(w[k : k + size])]
        hit = [False] * len(w)
        for size, at in starts.items():
            hit = [a or b for a, b in zip(hit, covered(len(w), at, size), strict=True)]
        out.append((i, len(w), sum(hit), sorted(str(x) for x in found if x is not None)))
    return out


def line_chunks(docs: list[tuple], span: int = 3, average: int = 4) -> list[tuple]:
    """(doc_id, n_lines, n_removed, kept_text)"""
    import struct

    import xxhash

    long = lambda x, seed=42: xxhash.xxh64_intdigest(struct.pack("<Q", x), seed)
    mask = (1 << 64) - 1
    rotate = lambda x, by: ((x << by) | (x >> (64 - by))) & mask
    chunks = []
    for i, t in docs:
        lines = (t or "").split("\n")
        hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in lines]
        at = 0
        for k in range(len(lines)):
            rolled = hashes[k]
            for back in range(1, span):
                rolled ^= rotate(hashes[k - back] if k >= back else 0, 7 * back)
            value = long(rolled)
            signed = value - (1 << 64) if value >> 63 else value
            if signed % average == 0 or k == len(lines) - 1:
                chunks.append((i, at, lines[at : k + 1]))
                at = k + 1
    groups = defaultdict(list)
    for i, at, lines in chunks:
        if len(lines) > 1:
            groups[tuple(lines)].append((i, at))
    gone = {p for places in groups.values() for p in sorted(places)[1:]}
    out = []
    for i, t in docs:
        own = [c for c in chunks if c[0] == i]
        kept = [x for _, at, lines in own if (i, at) not in gone for x in lines]
        n = sum(len(lines) for _, _, lines in own)
        out.append((i, n, n - len(kept), "\n".join(kept) if n > len(kept) else t or ""))
    return out


def article_text(page: str) -> str:
    """Text of the article elements, block by block, by the standard library's parser."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        depth, off, blocks = 0, 0, ("",)

        def handle_starttag(self, tag, attrs):
            self.depth += tag == "article"
            self.off += tag in ("script", "style", "nav", "aside", "footer", "form", "title")
            if tag not in ("b", "i", "a", "em", "strong", "span"):
                self.blocks = (*self.blocks, "")

        def handle_endtag(self, tag):
            self.depth -= tag == "article"
            self.off -= tag in ("script", "style", "nav", "aside", "footer", "form", "title")
            if tag not in ("b", "i", "a", "em", "strong", "span"):
                self.blocks = (*self.blocks, "")

        def handle_data(self, data):
            if self.depth and not self.off:
                self.blocks = (*self.blocks[:-1], self.blocks[-1] + data)

    reader = Reader()
    reader.feed(page)
    reader.close()
    return " ".join(" ".join(b.split()) for b in reader.blocks if b.split())


def line_passages(rows: list[tuple]) -> list[tuple]:
    """(doc_id, n_lines, n_removed, kept_text), by comparing all passages of two or more lines; ids must be distinct."""
    seen: dict[tuple, tuple] = {}
    out = []
    for i, t in sorted(rows):
        lines = (t or "").split("\n")
        gone = set()
        for size in range(2, len(lines) + 1):
            for k in range(len(lines) - size + 1):
                first = seen.setdefault(tuple(lines[k : k + size]), (i, k))
                if first[0] != i or k >= first[1] + size:
                    gone.update(range(k, k + size))
        out.append((i, len(lines), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone) if gone else t or ""))
    return out
