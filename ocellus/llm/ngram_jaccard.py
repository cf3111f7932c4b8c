"""Operator 1: n-gram Jaccard join with signature trees.

Each document is its set of word n-grams (48-bit hashes of lower-cased words). The join finds the pairs
of documents whose sets have Jaccard similarity of at least a threshold:

1. Documents with one and the same set (128 bits) are collapsed; the set goes on once.
2. Sets are routed to *groups* by MinHash bands (three values a band), so that only sets that may be similar
   ever meet. Groups of one are dropped and groups with the same members are kept once; these decisions move
   16 bytes a row, no texts. What a group holds by chance is told by a first traversal, over bitmaps of SET_BITS.
   The n-grams of the sets that are left are then made, of those documents alone.
3. Similar sets are linked, in two rounds. In the first each set goes to the PICKS largest of its groups; what is linked
   there becomes one node: the OR of its members' bitmaps and the range of their sizes, of the kind that trees are made
   of. Groups that hold several nodes are then traversed as trees of these nodes, without any set. In the second round
   sets go only to those of their groups where their node may hold a partner of another node. Links make components.
4. Every pair of similar sets that any link connects lies in one component, so each set goes to its component
   once, and all pairs are found there. They are counted there, set by set (ngram_jaccard_classes), or listed
   (ngram_jaccard_join); documents with one and the same set are counted, not paired, so that copies cost no pairs.

Wherever sets meet, in 3 and 4, they meet in a *signature tree*: leaves are the members' token bitmaps, every node
above holds the OR of its children's bitmaps and the range of their sizes. The tree is traversed against itself, a
pair of nodes at a time, and a pair of nodes is dropped when the largest overlap that any two members below could
have is too small for the threshold. Pairs that reach the leaves are verified exactly.

Groups and components with more n-grams than BLOCK_GRAMS are split into blocks, and each pair of blocks becomes a
task of its own: memory is bounded and nothing is capped. A pair is lost only if no band routes it and no chain of
other pairs links it either: at similarity j the bands alone find 1 - (1 - j^3)^BANDS, 0.9999 at 0.55.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import kernels as K
from .common import Scratch, columns, cut, fresh, grouped_batches, key_filter, lean, may_hold, orderable, prepare

N = 2
THRESHOLD = 0.55
BANDS = 50
ROWS = 3
#: n-grams of one block of a group or component (6 bytes each).
BLOCK_GRAMS = 4_000_000
#: Documents with one and the same set that travel as one list; more are split.
LIST_IDS = 4096
#: Groups that a set goes to in the first round.
PICKS = 2
#: Bits of a set in the first traversal of its groups.
SET_BITS = 1024
#: Nodes up to which a group is traversed before its sets are there; larger ones are not thinned out.
GROUP_NODES = 50_000
#: How many places apart members are compared before a tree is traversed: enough to link most of a hot group in linear time.
NEAR = 4
#: Bits of a node that stands for sets which are linked.
NODE_BITS = 4096
#: Bits of a signature; up to so many different shared tokens a bitmap is exact.
MAX_BITS = 16_384
LEAF, FAN = 16, 8
_CHUNK_WORDS = 1 << 20
_GRAM_BYTES = 6


def _multipliers(count: int) -> np.ndarray:
    return K.mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def _sets(column: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a text column: (first row, rows, document of each distinct gram, grams)."""
    raw, off = K.text_buffer(column)
    for i, j in K.slices(off):
        for a in range(i, j, 1 << 15):  # documents are numbered in 16 bits beside 48-bit grams
            b = min(j, a + (1 << 15))
            d, h = K.word_hashes(raw[off[a] : off[b]], off[a : b + 1] - off[a])
            yield a, b - a, *K.distinct(*K.ngram_hashes(d, h, n, b - a))


def _set_ids(g: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name a set, as two int64 columns."""
    a = np.add.reduceat(K.mix(g + np.uint64(1)), first)
    b = np.add.reduceat(K.mix(g ^ np.uint64(0xA5A5A5A5A5A5A5A5)), first)
    return K.mix(a).view(np.int64), K.mix(b).view(np.int64)


def _sign(n: int, bands: int, rows: int):
    mult = _multipliers(bands * rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, _, d, g in _sets(batch.column("text"), n):
                u, first = K.runs(d)
                if not len(u):
                    continue
                s1, s2 = _set_ids(g, first)
                x = K.mix(g)
                far = x >> np.uint64(29)
                keys = np.zeros((len(u), bands), np.uint64)
                for k in range(bands * rows):
                    low = np.minimum.reduceat(x * mult[k] ^ far, first)
                    keys[:, k // rows] = K.mix(keys[:, k // rows] * np.uint64(31) + low + np.uint64(k // rows))
                at = pa.array(row + u)
                flat = pa.array(keys.reshape(-1).view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, bands, dtype=np.int32)), flat)
                size = np.diff(np.append(first, len(g)))
                flag = np.zeros((len(u), SET_BITS), bool)
                flag[np.repeat(np.arange(len(u)), size), (g % np.uint64(SET_BITS)).astype(np.int64)] = True
                bits = pa.FixedSizeBinaryArray.from_buffers(pa.binary(SET_BITS // 8), len(u), [None, pa.py_buffer(np.packbits(flag, axis=1).tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("k").take(at), pa.array(s1), pa.array(s2), pa.array(size.astype(np.int32)), bits, lists], ["doc_id", "k", "s1", "s2", "size", "bits", "bands"])

    return run


def _grams(n: int, wanted):
    """The sets of the documents whose key the filter `wanted` holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = batch.filter(pa.array(wanted.value.holds(batch.column("k").to_numpy())))
            if not mine.num_rows:
                continue
            for _, _, d, g in _sets(mine.column("text"), n):
                u, first = K.runs(d)
                if not len(u):
                    continue
                s1, s2 = _set_ids(g, first)
                ends = np.append(first, len(g)) * _GRAM_BYTES
                raw = np.ascontiguousarray(g.view(np.uint8).reshape(-1, 8)[:, :_GRAM_BYTES]).tobytes()
                packed = [raw[a:b] for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(s1), pa.array(s2), pa.array(packed, pa.binary())], ["s1", "s2", "grams"])

    return run


class SignatureTree:
    """Members' token bitmaps under nodes that hold the OR of the bitmaps and the range of sizes below.

    `excess` is a member's size less its bits: with hashed bitmaps, two members share at most
    (bits in common) + min(excess) tokens. With exact bitmaps it is 0 and bits in common are the overlap.
    """

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, excess: np.ndarray, side: np.ndarray, high: np.ndarray | None = None):
        self.levels = [(bits, sizes, sizes if high is None else high, excess, side, side)]
        self.starts: list[np.ndarray] = []
        width = LEAF
        while len(self.levels[-1][1]) > FAN:
            bits, low, high, excess, s0, s1 = self.levels[-1]
            first = np.arange(0, len(low), width)
            self.starts.append(np.append(first, len(low)))
            self.levels.append(
                (np.bitwise_or.reduceat(bits, first), np.minimum.reduceat(low, first), np.maximum.reduceat(high, first), np.maximum.reduceat(excess, first), np.minimum.reduceat(s0, first), np.maximum.reduceat(s1, first))
            )
            width = FAN

    def _alive(self, level: int, p: np.ndarray, q: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
        """Which node pairs may hold a pair of members with Jaccard >= t, and their bits in common."""
        bits, low, high, excess, s0, s1 = self.levels[level]
        ok = (high[p] >= t * low[q] - 1e-9) & (high[q] >= t * low[p] - 1e-9)
        ok &= ~((s0[p] == s1[p]) & (s0[q] == s1[q]) & (s0[p] == s0[q]) & (s0[p] >= 0))
        p, q = p[ok], q[ok]
        common = np.bitwise_count(bits[p] & bits[q]).sum(axis=1, dtype=np.int64)
        most = np.minimum(np.minimum(high[p], high[q]), common + np.minimum(excess[p], excess[q]))
        keep = most * (1 + t) >= t * (low[p] + low[q]) - 1e-9
        ok[ok] = keep
        return ok, common[keep]

    def close(self, t: float, near: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """As pairs(), but only of members up to `near` places apart."""
        m, chunk = len(self.levels[0][1]), max(1, _CHUNK_WORDS // max(1, self.levels[0][0].shape[1]))
        for k in range(1, min(near, m - 1) + 1):
            for a in range(0, m - k, chunk):
                p = np.arange(a, min(a + chunk, m - k))
                ok, common = self._alive(0, p, p + k, t)
                if ok.any():
                    yield p[ok], p[ok] + k, common

    def pairs(self, t: float, skip=None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(member, member, bits in common) that the bounds leave; skip(p, q) says which member pairs to pass over."""
        top = len(self.levels) - 1
        p, q = np.triu_indices(len(self.levels[top][1]), 0 if top else 1)
        chunk = max(1, _CHUNK_WORDS // max(1, self.levels[0][0].shape[1]))
        stack = [(top, p, q)]
        while stack:
            level, p, q = stack.pop()
            if len(p) > chunk:
                stack.append((level, p[chunk:], q[chunk:]))
                p, q = p[:chunk], q[:chunk]
            if level == 0:
                go = p != q
                if skip is not None and len(p):
                    go &= ~skip(p, q)
                p, q = p[go], q[go]
            if not len(p):
                continue
            ok, common = self._alive(level, p, q, t)
            p, q = p[ok], q[ok]
            if level == 0:
                if len(p):
                    yield p, q, common
                continue
            starts = self.starts[level - 1]
            step = max(1, chunk // (LEAF * LEAF))
            for k in range(0, len(p), step):  # children of a few node pairs at a time
                stack.append((level - 1, *self._children(starts, p[k : k + step], q[k : k + step])))

    @staticmethod
    def _children(starts: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        np_, nq = starts[p + 1] - starts[p], starts[q + 1] - starts[q]
        total = np_ * nq
        k = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
        width = np.repeat(nq, total)
        a, b = np.repeat(starts[p], total) + k // width, np.repeat(starts[q], total) + k % width
        own = np.repeat(p == q, total)
        ok = ~own | (a < b)
        # a node meets itself below the top level too, or pairs inside it would be lost
        return a[ok | (a == b)], b[ok | (a == b)]


def _bitmaps(member: np.ndarray, token: np.ndarray, members: int, width: int) -> np.ndarray:
    words = max(1, (width + 63) // 64)
    flat = np.zeros(members * words, np.uint64)
    np.bitwise_or.at(flat, member * words + token // 64, np.uint64(1) << (token % 64).astype(np.uint64))
    return flat.reshape(members, words)


def similar_pairs(sets: list[np.ndarray], t: float, side: np.ndarray | None = None, skip=None, near: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, overlap) of the pairs of sorted sets with Jaccard >= t, found with a signature tree.

    side: if given, only pairs of different sides. skip(i, j): pairs to pass over; asked as the search goes on.
    near: pairs up to so many places apart come first, and then once more; for callers that may stop early.
    """
    m = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, m)
    grams = np.concatenate(sets)
    _, token, count = np.unique(grams, return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    member = np.repeat(np.arange(m), sizes)
    keep = shared[token]
    member, token = member[keep], number[token[keep]]
    vocabulary = int(shared.sum())
    lone = sizes - np.bincount(member, minlength=m)  # tokens that no other member has cannot overlap
    side_of = np.full(m, -1) if side is None else side
    low = np.full(m, vocabulary, np.int64)
    np.minimum.at(low, member, token)
    order = np.lexsort((low, np.floor(np.log(np.maximum(sizes, 1)) / max(1e-9, -np.log(t))) if t < 1 else sizes, side_of))
    place = np.empty(m, np.int64)
    place[order] = np.arange(m)
    exact = vocabulary <= MAX_BITS
    bits = _bitmaps(place[member], token % MAX_BITS, m, min(vocabulary, MAX_BITS))
    excess = np.zeros(m, np.int64) if exact else (sizes - lone)[order] - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    tree = SignatureTree(bits, sizes[order], excess, side_of[order])
    mapped = None if skip is None else lambda p, q: skip(order[p], order[q])
    for p, q, overlap in chain(tree.close(t, near), tree.pairs(t, mapped)):
        i, j = order[p], order[q]
        if not exact:
            overlap = np.zeros(len(i), np.int64)
            own, inverse = np.unique(np.concatenate([i, j]), return_inverse=True)
            a, b = inverse[: len(i)], inverse[len(i) :]
            number_of = np.full(m, -1)
            number_of[own] = np.arange(len(own))
            mine = number_of[member] >= 0
            mem, tok = number_of[member[mine]], token[mine]
            for base in range(0, vocabulary, MAX_BITS):
                part = (tok >= base) & (tok < base + MAX_BITS)
                if part.any():
                    seg = _bitmaps(mem[part], tok[part] - base, len(own), MAX_BITS)
                    for k in range(0, len(a), 4096):
                        overlap[k : k + 4096] += np.bitwise_count(seg[a[k : k + 4096]] & seg[b[k : k + 4096]]).sum(axis=1, dtype=np.int64)
        ok = overlap * (1 + t) >= t * (sizes[i] + sizes[j]) - 1e-9
        if ok.any():
            yield i[ok], j[ok], overlap[ok]


def _members(table: pa.Table, names: list[str]) -> tuple[pa.Table, list[np.ndarray], list[np.ndarray]]:
    """A group without repeated members: its rows, the named columns and the sets. A row that the table holds twice comes twice."""
    table = table.combine_chunks()
    found = [table.column(c).to_numpy() for c in names]
    order = np.lexsort(found[::-1])
    first = np.ones(len(order), bool)
    first[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in found])
    at = order[first]
    table = table.take(pa.array(at)).combine_chunks()
    sets = []
    for x in table.column("grams").to_pylist():
        wide = np.zeros((len(x) // _GRAM_BYTES, 8), np.uint8)
        wide[:, :_GRAM_BYTES] = np.frombuffer(x, np.uint8).reshape(-1, _GRAM_BYTES)
        sets.append(wide.view(np.uint64).reshape(-1))
    return table, [c[at] for c in found], sets


def _numbered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Each pair (a, b) as a number from 0; equal pairs, equal numbers."""
    order = np.lexsort((b, a))
    change = np.zeros(len(order), np.int64)
    change[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(change)
    return out


_GROUP = ["g1", "g2", "bi", "bj"]


def _link(t: float):
    """Each linked member of a group (u) with one that stands for all that it is linked to (v). Members of one label (c1, c2) are linked already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped_batches(batches, _GROUP):
            if group.num_rows < 2:
                continue
            bi, bj = (group.column(c)[0].as_py() for c in ("bi", "bj"))
            table, (s1, s2), sets = _members(group, ["s1", "s2"])
            label = _numbered(table.column("c1").to_numpy(), table.column("c2").to_numpy())
            if label.max() == 0:
                continue
            _, first, inverse = np.unique(label, return_index=True, return_inverse=True)
            root = first[inverse]
            if bi != bj:
                side = (table.column("b").to_numpy() == bj).astype(np.int64)
            else:
                side = label if len(first) < len(label) else None
            linked = False
            for i, j, _ in similar_pairs(sets, t, side, lambda i, j: root[i] == root[j], NEAR):
                while True:
                    a, b = root[i], root[j]
                    apart = a != b
                    if not apart.any():
                        break
                    high, at = np.unique(np.maximum(a, b)[apart], return_index=True)
                    link = np.arange(len(root))
                    link[high] = np.minimum(a, b)[apart][at]
                    while (link[link] != link).any():
                        link = link[link]
                    root = link[root]
                    linked = True
                if not root.any():  # all are linked to the first
                    break
            if linked:
                names, size = np.unique(root, return_counts=True)
                i = np.flatnonzero(np.isin(root, names[size > 1]))
                j = root[i]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (s1[i], s2[i], s1[j], s2[j])], ["u1", "u2", "v1", "v2"])

    return run


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bitmap of each set, its size, and how much larger that is than the bits."""
    for batch in batches:
        size, excess, bits = [], [], []
        for x in batch.column("grams").to_pylist():
            wide = np.zeros((len(x) // _GRAM_BYTES, 8), np.uint8)
            wide[:, :_GRAM_BYTES] = np.frombuffer(x, np.uint8).reshape(-1, _GRAM_BYTES)
            flag = np.zeros(NODE_BITS, bool)
            flag[(wide.view(np.uint64).reshape(-1) % np.uint64(NODE_BITS)).astype(np.int64)] = True
            size.append(len(wide))
            excess.append(len(wide) - int(flag.sum()))
            bits.append(np.packbits(flag).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("s1"), batch.column("s2"), pa.array(size, pa.int64()), pa.array(excess, pa.int64()), pa.array(bits, pa.binary())], ["s1", "s2", "size", "excess", "bits"])


def _node(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One node a label: the OR of the bitmaps and the ranges of its members, which come sorted by label."""
    names = ["c1", "c2", "low", "high", "excess", "bits"]
    at: list | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        c1, c2, size, excess = (batch.column(c).to_numpy() for c in ("c1", "c2", "size", "excess"))
        bits = np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
        first = np.flatnonzero(np.concatenate([[True], (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1])]))
        own = [c1[first], c2[first], np.minimum.reduceat(size, first), np.maximum.reduceat(size, first), np.maximum.reduceat(excess, first), np.bitwise_or.reduceat(bits, first)]
        if at is not None:  # the last label may go on
            if at[0][0] == own[0][0] and at[1][0] == own[1][0]:
                for k, f in ((2, np.minimum), (3, np.maximum), (4, np.maximum), (5, np.bitwise_or)):
                    own[k][0] = f(own[k][0], at[k][0])
            else:
                own = [np.concatenate([a, b]) for a, b in zip(at, own)]
        at = [x[-1:] for x in own]
        if len(own[0]) > 1:
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:-1]) for x in own[:5]), pa.array([b.tobytes() for b in own[5][:-1]], pa.binary())], names)
    if at is not None:
        yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in at[:5]), pa.array([b.tobytes() for b in at[5]], pa.binary())], names)


def _promising(t: float, names: list[str]):
    """The nodes of each group (key) that may hold a set similar to one of another node there. names: the columns that name a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped_batches(batches, ["key"]):
            m = group.num_rows
            if m < 2:
                continue
            low, high = (group.column(c).to_numpy().astype(np.int64) for c in ("low", "high"))
            bits = np.frombuffer(b"".join(group.column("bits").to_pylist()), np.uint8).reshape(m, -1).view(np.uint64)
            excess = group.column("excess").to_numpy() if "excess" in group.column_names else low - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
            order = np.argsort(low, kind="stable")
            tree = SignatureTree(bits[order], low[order], excess[order], np.full(m, -1), high[order])
            alive = np.zeros(m, bool)
            for p, q, _ in tree.close(t, NEAR):
                alive[order[p]] = alive[order[q]] = True
            if not alive.all():  # the others meet all; those that are told already do not meet each other
                order = np.lexsort((low, alive))
                tree = SignatureTree(bits[order], low[order], excess[order], np.where(alive[order], 0, -1), high[order])
                for p, q, _ in tree.pairs(t):
                    alive[order[p]] = alive[order[q]] = True
                    if alive.all():
                        break
            if alive.any():
                yield pa.RecordBatch.from_arrays([pa.array(group.column(c).to_numpy()[alive]) for c in ("key", *names)], ["key", *names])

    return run


def _pairs(t: float):
    """All pairs of documents of each component, but for those with one and the same set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped_batches(batches, _GROUP):
            if group.num_rows < 2:
                continue
            bi, bj = (group.column(c)[0].as_py() for c in ("bi", "bj"))
            table, (s1, s2, _), sets = _members(group, ["s1", "s2", "part"])
            same = _numbered(s1, s2)
            side = None if bi == bj else (table.column("b").to_numpy() == bj).astype(np.int64)
            ids = table.column("ids").combine_chunks()
            ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
            flat, count = ids.flatten().to_numpy(), ids.value_lengths().to_numpy().astype(np.int64)
            begin = np.cumsum(count) - count
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            for i, j, overlap in similar_pairs(sets, t, side, lambda i, j: same[i] == same[j]):
                jaccard = overlap / (sizes[i] + sizes[j] - overlap)
                upto = np.cumsum(count[i] * count[j])
                at = 0
                while at < len(i):  # lists of copies multiply: some pairs of sets at a time
                    end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + (1 << 17), side="right")))
                    x, y = i[at:end], j[at:end]
                    total = count[x] * count[y]
                    pair = np.repeat(np.arange(len(x)), total)
                    k = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
                    a, b = flat[begin[x][pair] + k // count[y][pair]], flat[begin[y][pair] + k % count[y][pair]]
                    ok = a != b
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[ok]), pa.array(np.maximum(a, b)[ok]), pa.array(jaccard[at:end][pair][ok])], ["doc_id_a", "doc_id_b", "jaccard"])
                    at = end

    return run


def _counts(t: float):
    """How many documents each set of a group is similar to (links); n: how many have the set itself, which do not count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped_batches(batches, _GROUP):
            if group.num_rows < 2:
                continue
            g1, bi, bj = (group.column(c)[0].as_py() for c in ("g1", "bi", "bj"))
            table, (s1, s2), sets = _members(group, ["s1", "s2"])
            side = None if bi == bj else (table.column("b").to_numpy() == bj).astype(np.int64)
            n, links = table.column("n").to_numpy(), np.zeros(len(sets), np.int64)
            for i, j, _ in similar_pairs(sets, t, side):
                np.add.at(links, i, n[j])
                np.add.at(links, j, n[i])
            at = np.flatnonzero(links)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), g1)), *(pa.array(c[at]) for c in (s1, s2, links))], ["g1", "s1", "s2", "links"])

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, k, text): k names the row's number and text."""
    light = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return light.select("doc_id", F.xxhash64("doc_id", "text").alias("k"), "text")


def _signed(keyed: DataFrame, n: int, bands: int) -> DataFrame:
    """(doc_id, k, s1, s2, size, bits, bands) of the documents with words."""
    prepare(keyed.sparkSession)
    return keyed.mapInArrow(lean(_sign(n, bands, ROWS)), "doc_id long, k long, s1 long, s2 long, size int, bits binary, bands array<long>")


def _routes(signed: DataFrame, tables: Scratch) -> DataFrame:
    """(s1, key, m, w): the groups of each set, with their members and n-grams, but for groups of one and for repeats."""
    by_key = Window.partitionBy("key")
    sets = signed.groupBy("s1", "s2").agg(F.first("size").alias("size"), F.first("bands").alias("bands"))
    # one shuffle by key: groups of one go before anything else is joined or aggregated
    rows = tables.keep(sets.select("s1", "size", F.explode("bands").alias("key")).withColumn("m", F.count(F.lit(1)).over(by_key)).filter("m > 1").drop("m"))
    live = (
        rows.groupBy("key")
        .agg(F.count("*").alias("m"), F.sum("size").alias("w"), F.bit_xor("s1").alias("f1"), F.sum(F.shiftright("s1", 20)).alias("f2"))
        .groupBy("m", "w", "f1", "f2")
        .agg(F.min("key").alias("key"))
        .select("key", "m", "w")
    )
    return tables.keep(rows.select("s1", "key").join(live, "key").select("s1", "key", "m", "w"))


def _placed(packed: DataFrame, places: DataFrame, on: list[str], carried: list[str]) -> DataFrame:
    """The sets in their groups (g1, g2), in blocks, partitioned and sorted by group; places: on, g1, g2, w and what is carried."""
    rows = packed.join(places, on)
    rows = rows.withColumn("c", F.ceil(F.col("w") / BLOCK_GRAMS).cast("int"))
    rows = rows.withColumn("b", F.pmod(F.xxhash64("s1", "s2"), F.col("c")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    rows = rows.select("g1", "g2", F.least("b", "o").alias("bi"), F.greatest("b", "o").alias("bj"), "b", "s1", "s2", *carried, "grams")
    return rows.repartition(*_GROUP).sortWithinPartitions(*_GROUP)


def _components(keyed: DataFrame, signed: DataFrame, n: int, threshold: float, tables: Scratch) -> tuple[DataFrame, DataFrame]:
    """(s1, s2, c1, c2): the component of each set that is similar to another; and (s1, s2, grams) of these sets, and some more."""
    routes = _routes(signed, tables)
    bits = signed.select("s1", "s2", "size", "bits").join(routes.select("s1").distinct(), "s1")
    bits = bits.groupBy("s1", "s2").agg(F.first("size").alias("low"), F.first("bits").alias("bits")).withColumn("high", F.col("low"))
    large = F.col("m") > GROUP_NODES
    met = routes.filter(~large).select("s1", "key").join(bits, "s1").repartition("key").sortWithinPartitions("key")
    met = met.select("key", "s1", "low", "high", "bits").mapInArrow(lean(_promising(threshold, ["s1"])), "key long, s1 long")
    routes = tables.keep(routes.join(met.distinct(), ["key", "s1"]).unionByName(routes.filter(large)))
    live = tables.keep(signed.select("s1", "s2", "k").join(routes.select("s1").distinct(), "s1").groupBy("s1", "s2").agg(F.min("k").alias("k")))
    wanted = key_filter(live, "k")
    packed = tables.keep(keyed.select("k", "text").mapInArrow(lean(_grams(n, wanted)), "s1 long, s2 long, grams binary"))
    link = _link(threshold)

    def linked(rows: DataFrame, places: DataFrame) -> DataFrame:
        edges = _placed(rows, places, ["s1", "s2"], ["c1", "c2"]).mapInArrow(lean(link), "u1 long, u2 long, v1 long, v2 long")
        return edges.select(F.struct(F.col("u1").alias("s1"), F.col("u2").alias("s2")).alias("u"), F.struct(F.col("v1").alias("s1"), F.col("v2").alias("s2")).alias("v"))

    zero = F.lit(0).cast("long").alias("g2")
    most = F.slice(F.sort_array(F.collect_list(F.struct("m", "key", "w")), asc=False), 1, PICKS)
    best = routes.groupBy("s1").agg(most.alias("g")).select("s1", F.explode("g").alias("g")).select("s1", F.col("g.key").alias("g1"), zero, F.col("g.w").alias("w"))
    best = best.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("g1"))).filter("m > 1").drop("m")
    pairs = live.select("s1", "s2")
    first = tables.keep(linked(packed, pairs.join(best, "s1").select("s1", "s2", "g1", "g2", "w", F.col("s1").alias("c1"), F.col("s2").alias("c2"))))
    known = _flat(connected_components(first, tables))
    labelled = tables.keep(pairs.join(known, ["s1", "s2"], "left").select("s1", "s2", F.coalesce("c1", "s1").alias("c1"), F.coalesce("c2", "s2").alias("c2")))
    rest = tables.keep(routes.join(labelled, "s1").select("s1", "s2", "c1", "c2", "key", "w"))
    seats = rest.groupBy("key", "c1", "c2").agg(F.count("*").alias("n")).withColumn("labels", F.count(F.lit(1)).over(Window.partitionBy("key"))).filter("labels > 1")
    seats = tables.keep(seats.select("key", "c1", "c2", "labels"))
    few = F.col("labels") <= GROUP_NODES
    bits = packed.mapInArrow(lean(_bits), "s1 long, s2 long, size long, excess long, bits binary").join(labelled, ["s1", "s2"])
    bits = bits.join(seats.select("c1", "c2").distinct(), ["c1", "c2"]).repartition("c1", "c2").sortWithinPartitions("c1", "c2")
    nodes = bits.select("c1", "c2", "size", "excess", "bits").mapInArrow(lean(_node), "c1 long, c2 long, low long, high long, excess long, bits binary")
    seated = seats.filter(few).join(nodes, ["c1", "c2"]).select("key", "c1", "c2", "low", "high", "excess", "bits").repartition("key").sortWithinPartitions("key")
    seated = seated.mapInArrow(lean(_promising(threshold, ["c1", "c2"])), "key long, c1 long, c2 long").unionByName(seats.filter(~few).select("key", "c1", "c2"))
    places = rest.join(seated, ["key", "c1", "c2"])
    places = tables.keep(places.select("s1", "s2", F.col("key").alias("g1"), zero, "w", "c1", "c2"))
    again = key_filter(places.select("s1").distinct(), "s1")
    second = linked(packed.filter(may_hold(F.col("s1"), again)), places)
    tree = known.select(F.struct("s1", "s2").alias("u"), F.struct(F.col("c1").alias("s1"), F.col("c2").alias("s2")).alias("v"))
    return _flat(connected_components(second.unionByName(tree), tables)), packed


def _flat(components: DataFrame) -> DataFrame:
    return components.select("node.s1", "node.s2", F.col("component.s1").alias("c1"), F.col("component.s2").alias("c2"))


def ngram_jaccard_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, bands: int = BANDS) -> DataFrame:
    """All pairs (doc_id_a < doc_id_b, jaccard) of documents whose word n-gram sets have Jaccard >= threshold.

    docs needs `doc_id` and `text`; other columns are ignored, whatever their names. Defined cases: a null, empty
    or wordless text has no n-grams and no partner; a text of 1 to n-1 words has one n-gram, of all its words; rows
    with a null doc_id cannot be named in a pair and are left out; repeated rows count once, and a document is
    never paired with itself; rows of one doc_id and different texts are compared each, and a pair comes once for each
    two sets that agree; an empty table gives no rows. Texts are used whole, at any length.
    """
    keyed = _keyed(docs).filter("doc_id IS NOT NULL")
    with Scratch(docs.sparkSession) as tables:
        signed = tables.keep(_signed(keyed, n, bands))
        components, packed = _components(keyed, signed, n, threshold, tables)
        parts = signed.groupBy("s1", "s2").agg(F.ceil(F.count("*") / LIST_IDS).cast("int").alias("parts"))
        named = signed.select("s1", "s2", "size", "doc_id").join(parts, ["s1", "s2"]).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
        lists = tables.keep(named.groupBy("s1", "s2", "size", "part").agg(F.sort_array(F.collect_set("doc_id")).alias("ids")))
        here = lists.join(components, ["s1", "s2"])
        weight = here.groupBy("c1", "c2").agg(F.sum("size").alias("w"))
        places = here.join(weight, ["c1", "c2"]).select("s1", "s2", F.col("c1").alias("g1"), F.col("c2").alias("g2"), "w", "part", "ids")
        together = cut(_placed(packed, places, ["s1", "s2"], ["part", "ids"]))
        left = lists.select("s1", "s2", F.col("part").alias("pa"), F.col("ids").alias("a"))
        right = lists.select("s1", "s2", F.col("part").alias("pb"), F.col("ids").alias("b"))
        twice = cut(left.join(right, ["s1", "s2"]).filter("pa < pb OR (pa = pb AND size(a) > 1)").select("pa", "pb", "a", "b"))
    near = together.mapInArrow(lean(_pairs(threshold)), "doc_id_a long, doc_id_b long, jaccard double")
    copies = twice.select("pa", "pb", F.explode("a").alias("x"), "b")
    copies = copies.select("x", F.explode(F.filter("b", lambda y: (F.col("pa") < F.col("pb")) | (y > F.col("x")))).alias("y"))
    copies = copies.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"), F.lit(1.0).alias("jaccard"))
    return near.unionByName(copies)


def ngram_jaccard_classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, bands: int = BANDS) -> DataFrame:
    """(doc_id, class_id, links): each document's class and its number of links, one row a doc_id.

    Links are the pairs of ngram_jaccard_join(): links counts those that a document is in, copies and near copies alike,
    and a class holds all documents that links connect, named by its smallest doc_id. Defined cases as there; besides, a
    document without words or without partner is a class of its own with 0 links; rows with a null doc_id are left
    out; a doc_id with several texts is one document, linked by any of them, and two texts of its own are no link.
    """
    keyed = _keyed(docs).filter("doc_id IS NOT NULL")
    with Scratch(docs.sparkSession) as tables:
        signed = tables.keep(_signed(keyed, n, bands))
        components, packed = _components(keyed, signed, n, threshold, tables)
        components = tables.keep(components)
        own = signed.groupBy("doc_id", "s1", "s2").agg(F.first("size").alias("size"))
        held = tables.keep(own.groupBy("s1", "s2").agg(F.first("size").alias("size"), F.count("*").alias("n")))

        def counted(places: DataFrame) -> DataFrame:
            places = places.join(places.groupBy("g1", "g2").agg(F.sum("size").alias("w")), ["g1", "g2"])
            return _placed(packed, places, ["s1", "s2"], ["n"]).mapInArrow(lean(_counts(threshold)), "g1 long, s1 long, s2 long, links long")

        near = counted(held.join(components, ["s1", "s2"]).withColumnsRenamed({"c1": "g1", "c2": "g2"})).groupBy("s1", "s2").agg(F.sum("links").alias("links"))
        told = held.join(components, ["s1", "s2"], "left").join(near, ["s1", "s2"], "left")
        told = told.select("s1", "s2", F.struct(F.coalesce("c1", "s1").alias("c1"), F.coalesce("c2", "s2").alias("c2")).alias("c"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"))
        rows = tables.keep(own.join(told, ["s1", "s2"]))
        found = tables.keep(rows.groupBy("doc_id").agg(F.min("c").alias("c"), F.sum("links").alias("links"), F.count("*").alias("sets")))
        several = found.filter("sets > 1").select("doc_id", F.col("c").alias("first"))
        if not several.isEmpty():  # a doc_id with several texts joins their classes; links between its own texts do not count
            several = tables.keep(rows.join(several, "doc_id"))
            joined = connected_components(several.select(F.col("first").alias("u"), F.col("c").alias("v")), tables)
            inside = counted(several.select("s1", "s2", "size", F.col("doc_id").alias("g1"), F.col("c.c1").alias("g2"), F.lit(1).cast("long").alias("n")))
            inside = inside.groupBy(F.col("g1").alias("doc_id")).agg(F.sum("links").alias("inside"))
            found = found.join(inside, "doc_id", "left").withColumn("links", F.col("links") - F.coalesce("inside", F.lit(0)))
            found = tables.keep(found.join(joined, F.col("c") == F.col("node"), "left").select("doc_id", F.coalesce("component", "c").alias("c"), "links"))
        names = found.groupBy("c").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("m")).filter("m > 1")
        found = found.join(names, "c", "left").select("doc_id", "class_id", "links")
        every = keyed.select("doc_id").distinct().join(found, "doc_id", "left")
        return cut(every.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links")))


def connected_components(edges: DataFrame, tables: Scratch) -> DataFrame:
    """(node, component) of an undirected graph with edges (u, v) of any type that can be compared; a component is named by its smallest node.

    Alternating large-star and small-star rounds; each is one shuffle over the edges, and each pair of rounds
    is written. Nodes without edges do not appear.
    """
    edges = tables.keep(edges.filter("u <> v").select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).distinct())
    by_u = Window.partitionBy("u")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        large = both.withColumn("m", F.least(F.min("v").over(by_u), F.col("u"))).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.withColumn("m", F.min("v").over(by_u))
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        edges = tables.keep(small)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        state = now


def drop_near_duplicates(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, bands: int = BANDS) -> DataFrame:
    """docs without the near duplicates: of each group of documents that are linked by Jaccard >= threshold, one row stays.

    The row with the smallest doc_id stays (a null doc_id is larger than any, and such rows are compared like all others;
    ties: the smaller hash of number and text, then the smaller row, by its columns in order), with all its columns.
    Repeated rows count as copies. Rows without words (null, empty, signs only) stay, all of them. An empty table gives
    no rows; texts are used whole, at any length; other columns may have any name.
    Groups are found from spanning forests, so hot groups cost no list of pairs here. Only rows that may go, and those
    with which they are told apart, are moved; the others pass a filter of the keys that are in question.
    """
    keyed = _keyed(docs)
    with Scratch(docs.sparkSession) as tables:
        signed = tables.keep(_signed(keyed, n, bands))
        components, _ = _components(keyed, signed, n, threshold, tables)
        doc = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "k")
        rows = signed.groupBy("doc_id", "k", "s1", "s2").agg(F.count("*").alias("n"))
        rows = rows.join(components, ["s1", "s2"], "left").select("doc_id", "k", "n", F.coalesce("c1", "s1").alias("c1"), F.coalesce("c2", "s2").alias("c2"))
        rows = rows.withColumn("doc", doc)
        kept = rows.groupBy("c1", "c2").agg(F.min("doc").alias("best"), F.count("*").alias("m")).filter("m > 1")
        told = rows.join(kept, ["c1", "c2"], "left").withColumn("stays", F.col("best").isNull() | F.col("doc").eqNullSafe(F.col("best")))
        told = cut(told.filter("NOT stays OR n > 1").select("doc_id", "k", "stays"))
    asked = key_filter(told, "k")
    k, own, f_id, f_k, f_stays, row = fresh(docs, "key", "own", "id", "told", "stays", "row")
    marked = docs.withColumn(k, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    sure = marked.filter(~may_hold(F.col(k), asked)).select(columns(docs))
    told = told.select(F.col("doc_id").alias(f_id), F.col("k").alias(f_k), F.col("stays").alias(f_stays))
    open_ = marked.filter(may_hold(F.col(k), asked)).withColumn(own, F.col("doc_id").cast("long"))
    # joined by the key alone, so that the ranks below need no other shuffle
    same = (F.col(own) == F.col(f_id)) | (F.col(own).isNull() & F.col(f_id).isNull())
    open_ = open_.join(told, (F.col(k) == F.col(f_k)) & same, "left").filter(F.coalesce(F.col(f_stays), F.lit(True)))
    open_ = open_.withColumn(row, F.row_number().over(Window.partitionBy(k, own).orderBy(*orderable(docs))))
    open_ = open_.filter(F.col(f_stays).isNull() | (F.col(row) == 1))
    return sure.unionByName(open_.select(columns(docs)))


ORACLE = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), g AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) >= 2 THEN w[i] || ' ' || w[i + 1] ELSE w[1] END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM w WHERE len(w) >= 1)
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (
  SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b, count(*) AS o
  FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), p AS (
  SELECT doc_id_a, doc_id_b FROM o JOIN n x ON x.doc_id = doc_id_a JOIN n y ON y.doc_id = doc_id_b
  WHERE o * (1 + {THRESHOLD}) >= {THRESHOLD} * (x.n + y.n) - 1e-9
), e AS (SELECT doc_id_a AS u, doc_id_b AS v FROM p UNION ALL SELECT doc_id_b, doc_id_a FROM p),
r AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON e.u = r.v)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, coalesce(l.links, 0) AS links
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d
LEFT JOIN (SELECT u, min(v) AS class_id FROM r GROUP BY u) c ON c.u = d.doc_id
LEFT JOIN (SELECT u, count(*) AS links FROM e GROUP BY u) l ON l.u = d.doc_id
"""
