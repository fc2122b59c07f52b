"""N-gram Jaccard join by universe-partition pigeonhole.

Two documents link when the Jaccard similarity of their sets of five-word shingles is 0.8 or more.

*Sets of one size band share a partition of the universe of hashes into m segments.* If sets R and
S (|R| <= |S|) link, they differ in at most H = floor((|R| + |S|) / 9) elements. Give S a threshold
for each segment: -1 (skip it), 0 (its subset must be the same in R) or 1 (it may differ in one
element). If the sum of (threshold + 1) over the segments is H + 1 or more, some segment of R is
within its threshold, or else the sets would differ in more than H elements. So every set is
indexed under its own band by its segment subsets, and under some segments (``RESERVE``) also by
all subsets with one element deleted; S looks up its band and the next smaller one.
There are more segments than the pigeonhole needs (``SLACK``), so S may skip some; each reserve
segment raised to threshold 1 allows one more. *Allocation* picks what to skip by cost: subsets are
counted, S skips the most frequent ones and raises reserve segments while that is cheaper than the
next subset it would have to look up. Empty segments are skipped by all and not even packed; only in
a band in which some set has more of them than it may skip (``odd``) are they packed like others.

Links between pairs are verified exactly, on the sets. Pairs inside groups that are known to be
connected are never made:

1. Equal sets form classes; one document of each goes on.
2. A few segments of each set are looked up first; every class is verified against the two
   best-connected classes it meets there. Most links are found here and form groups.
3. All segments are looked up. Subsets whose sets are in one group drop out at once; the rest is
   allocated by cost. A class is then compared with one member of each other group it meets and,
   where that did not connect them, with all the members it meets. Families of texts that are
   alike, but less than 0.8, meet here: sets are dealt into blocks, families together, and within a
   pair of blocks each pair of sets that share a subset is held once against the histograms of the
   two over ``CELLS`` cells, whose common part bounds the intersection from above. Only pairs that
   this does not refute leave the task; they are verified on the texts.

Subsets travel packed: a task gathers the sets it reads into *blocks* and sends each partition of
the hash space one row a block, with the sorted subset names (their low ``CELL`` bits, as gaps), the
number of the set within its block and a byte of flags, about four bytes a subset. What a partition
finds to be shared goes back to the block, in the order of which the sets are known, and is allocated
there. What comes to the driver are counts and at most one number for each band.

Sets are compared as sets of 64-bit hashes, as words of 64 bits hashed from whole words: two unlike
shingles pass as equal with a probability of 2^-64, two unlike sets as copies with 2^-128.

Defined results: a text that is null, empty or without words has ``n_shingles`` 0 and is its own
component; fewer than five words make one shingle. Repeated rows get the same class and each keeps
its row. A text of any length is one set; it is hashed in pieces, and 8 bytes a word are held of it
(the verification holds those of two). A null id belongs to its class but is never the smallest; if a class has only null
ids, its component is null. An empty table gives an empty result. :func:`keep_first` keeps all
columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from florilege.llm.components import components
from florilege.llm.scratch import Scratch, keyed
from florilege.llm.shingles import digest, mix, shingle_sets

#: Links: NUM * |intersection| >= DEN * |union|.
NUM, DEN = 100, 80
#: Segments beyond the pigeonhole's need: a part of them, and so many at least.
SLACK, LEAST_SLACK = 0.12, 3
#: Reserve segments, also indexed with one element deleted: all while a band has so many or fewer,
#: then fewer, so that small sets, which a common line can fill, have many.
RESERVE, LEAST_RESERVE = 15, 2
#: Cells of the histograms that refute pairs, sets in a block of them, and look-ups in a part of a pair of blocks.
CELLS, BLOCK, PAIR = 1024, 2000, 100_000
#: Segments that the first, quick look-up uses.
QUICK = 16
#: Id lists are broadcast up to so many rows of 16 bytes.
BROADCAST_IDS = 200_000
#: Subsets in a block, and words for each partition of the hash space.
FLUSH, PART_WORDS = 1_000_000, 4_000_000
#: Bits of a subset's name that its partition keeps. A collision costs a candidate, no more.
CELL = 30

LOWER, DELETED = 1, 2
#: The segment of a reserve subset stands above these bits of its flags; others have NO_SEGMENT there.
SHIFT, NO_SEGMENT = 4, 15


def _bands() -> np.ndarray:
    """Lower ends of the size bands: each is 1.25 times the last, so that a set's partners are in two."""
    ends = [1]
    while ends[-1] < 1 << 40:
        ends.append(max(ends[-1] + 1, -(-ends[-1] * NUM // DEN)))
    return np.array(ends, np.int64)


BANDS = _bands()


def _need(s: int, most: int) -> int:
    """The pigeonhole's sum of (threshold + 1) for a set of size s and partners of up to ``most``."""
    return (s + min(s, most)) * (NUM - DEN) // (NUM + DEN) + 1


def _segments(band: int) -> int:
    most = int(BANDS[band + 1]) - 1
    need = _need(most * NUM // DEN, most)
    return need + max(LEAST_SLACK, int(np.ceil(SLACK * need)))


def _reserve(m: int) -> int:
    return m if m <= RESERVE else max(LEAST_RESERVE, RESERVE - (m - RESERVE) // 4)


#: Roles of the rows of a pair of blocks: a set with its histogram; a subset that is indexed, or else looked
#: up; one with an element deleted; one of a raised segment.
SET, INDEXED, REMOVED, RAISED = 1, 2, 4, 8

_bounds: dict[int, np.ndarray] = {}


def _cut(hashes: np.ndarray, m: int) -> np.ndarray:
    """Where each of the m segments begins in the sorted hashes, and where the last one ends."""
    if m not in _bounds:
        _bounds[m] = np.array([-(-(i << 32) // m) << 32 for i in range(m)], np.uint64)
    return np.append(np.searchsorted(hashes, _bounds[m]), len(hashes))


def _names(hashes: np.ndarray, at: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the segment subsets; names of the one-deletion subsets, and their segments."""
    sizes = np.diff(at)
    m = len(sizes)
    salted = mix(hashes, 0x3C)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(salted)))
    content = sums[at[1:]] - sums[at[:-1]]
    where = np.arange(m, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((band + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
    spare = _reserve(m)
    owner = np.repeat(np.arange(spare), sizes[:spare])
    less, many = salted[: len(owner)], sizes[owner] > 1
    owner, less = owner[many], less[many]
    return mix(content + where), mix(content[owner] - less + where[owner]), owner


def _allowance(s: int, band: int, sizes: np.ndarray, odd: bool) -> tuple[int, int]:
    """How many of the packed segments a set of size s may skip in a band, before it raises any (below
    0: it must raise so many), and which reserve segments it may raise, as bits. Segments of fewer
    than two are not raised, as that would have to meet empty ones."""
    m = len(sizes)
    free = m - _need(s, int(BANDS[band + 1]) - 1) - (0 if odd else int((sizes == 0).sum()))
    return min(free, 0x7FFF), int(((sizes[: _reserve(m)] > 1) << np.arange(_reserve(m))).sum())  # to skip fewer is safe


def _looked_up(s: int) -> range:
    """The bands that a set of size s looks up; its own is the last."""
    low, top = (int(np.searchsorted(BANDS, x, side="right")) - 1 for x in (-(-s * DEN // NUM), s))
    return range(low, top + 1)


def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc_id, n, hi, lo, quick, odd``: size and digest of each set, a few of its subsets, and the
    bands in which it has more empty segments than it can do without."""
    for batch in batches:
        n, hi, lo, quick, odd = [], [], [], [], []
        for hashes in shingle_sets(batch.column("text")):
            a, b = digest(hashes)
            n.append(len(hashes)), hi.append(a), lo.append(b)
            names, strange = np.zeros(0, np.int64), []
            for band in _looked_up(len(hashes)) if len(hashes) else ():
                at = _cut(hashes, _segments(band))
                free, offers = _allowance(len(hashes), band, np.diff(at), False)
                if -free > offers.bit_count():
                    strange.append(band)
            if len(hashes):
                names = _names(hashes, at, band)[0][:QUICK][np.diff(at)[:QUICK] > 1].view(np.int64)
            quick.append(names), odd.append(strange)
        lists = [pa.array(quick, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), *lists], ["doc_id", "n", "hi", "lo", "quick", "odd"])


def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From ``u, v, u_lo, v_lo, u_text, v_text``: the pairs that link. A text of another set is passed over."""
    for batch in batches:
        kept = []
        names = batch.column("u").to_numpy(zero_copy_only=False)
        fresh = np.concatenate(([True], names[1:] != names[:-1])) if len(names) else np.zeros(0, bool)
        lefts = shingle_sets(batch.column("u_text").filter(pa.array(fresh)))  # rows of one u follow each other
        rights = shingle_sets(batch.column("v_text"))
        u_lo, v_lo = batch.column("u_lo").to_pylist(), batch.column("v_lo").to_pylist()
        for i in range(batch.num_rows):
            left = next(lefts) if fresh[i] else left
            right = next(rights)
            both = np.intersect1d(left, right, assume_unique=True).size
            linked = NUM * both >= DEN * (len(left) + len(right) - both)
            kept.append(linked and digest(left)[1] == u_lo[i] and digest(right)[1] == v_lo[i])
        yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(kept, pa.bool_()))


def _histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc_id, n, cells``: how many hashes of the set fall in each cell (255: or more)."""
    for batch in batches:
        n, cells = [], []
        for hashes in shingle_sets(batch.column("text")):
            n.append(len(hashes))
            cells.append(np.minimum(np.bincount((hashes % np.uint64(CELLS)).astype(np.int64), minlength=CELLS), 255).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(cells, pa.binary())], ["doc_id", "n", "cells"])


def _compare(table):
    """Pairs of one pair of blocks that share a subset and that their histograms do not refute."""
    column = lambda c: table.column(c).to_numpy()
    role, ent, name = column("role"), column("ent"), column("name")
    none = pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
    is_set = role & SET > 0
    looks, index = np.flatnonzero(~is_set & (role & INDEXED == 0)), np.flatnonzero(~is_set & (role & INDEXED > 0))
    if not len(looks) or not len(index) or not is_set.any():
        return none
    ids, first = np.unique(ent[is_set], return_index=True)
    first = np.flatnonzero(is_set)[first]
    sets = table.select(["n", "comp", "cells"]).take(pa.array(first))  # in other rows these are null
    n, comp = (sets.column(c).to_numpy() for c in ("n", "comp"))
    cells = np.frombuffer(b"".join(x.as_py() for x in sets.column("cells")), np.uint8).reshape(-1, CELLS)
    full = (cells == 255).any(axis=1)
    index = index[np.argsort(name[index], kind="stable")]
    i_name, i_ent, i_del = name[index], ent[index], role[index] & REMOVED > 0
    s_name, s_ent, s_del, s_up = name[looks], ent[looks], role[looks] & REMOVED > 0, role[looks] & RAISED > 0
    i_comp, s_comp = (comp[np.searchsorted(ids, x)] for x in (i_ent, s_ent))
    us, a = np.unique(np.searchsorted(ids, i_ent), return_inverse=True)
    vs, b = np.unique(np.searchsorted(ids, s_ent), return_inverse=True)
    seen = np.zeros(len(us) * len(vs), bool)
    low, high = np.searchsorted(i_name, s_name, "left"), np.searchsorted(i_name, s_name, "right")
    ends = np.cumsum(high - low)
    out_u, out_v, at = [], [], 0
    while at < len(s_name):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 500_000, "right")))
        count = (high - low)[at:to]
        s = np.repeat(np.arange(at, to), count)
        i = np.arange(len(s)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low[at:to], count)
        at = to
        fit = ~(s_del[s] & i_del[i]) & (s_up[s] | ~i_del[i]) & (s_comp[s] != i_comp[i])
        code = np.unique(a[i[fit]] * len(vs) + b[s[fit]])
        code = code[~seen[code]]
        seen[code] = True
        x, y = us[code // len(vs)], vs[code % len(vs)]
        near = np.minimum(n[x], n[y]) * NUM >= np.maximum(n[x], n[y]) * DEN
        x, y = x[near], y[near]
        for k in range(0, len(x), 4096):
            p, q = x[k : k + 4096], y[k : k + 4096]
            most = np.minimum(cells[p], cells[q]).sum(axis=1, dtype=np.int64)
            keep = (NUM * most >= DEN * (n[p] + n[q] - most)) | (full[p] & full[q])
            out_u.append(ids[p[keep]])
            out_v.append(ids[q[keep]])
    if not out_u:
        return none
    return pa.table({"u": pa.array(np.concatenate(out_u)), "v": pa.array(np.concatenate(out_v))})


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes, the first byte of all numbers of an array before the second, compressed."""
    head = np.array([len(a) for a in arrays], np.int64).tobytes()
    raw = head + b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() for a in arrays)
    return np.int64(len(raw)).tobytes() + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _unpack(blob: bytes, *kinds: type) -> list[np.ndarray]:
    raw = pa.Codec("zstd").decompress(blob[8:], decompressed_size=int(np.frombuffer(blob, np.int64, 1)[0]), asbytes=True)
    sizes, at, out = np.frombuffer(raw, np.int64, len(kinds)), 8 * len(kinds), []
    for n, kind in zip(sizes.tolist(), kinds, strict=True):
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).view(kind).ravel())
        at += n * width
    return out


#: Arrays of a message from a block: gaps of cells, set within the block, flags; sets in groups of several, and their groups.
MESSAGE = np.uint32, np.uint16, np.uint8, np.uint16, np.int64
#: Of a block's head: id, group, size; then by band, own and lower: segments that may be skipped, segments that may be raised.
HEAD = np.int64, np.int64, np.int64, np.int16, np.int16, np.uint16, np.uint16
#: Of what a partition returns: cell, set within the block, flags, sets that are indexed there.
SHARED = np.uint32, np.uint16, np.uint8, np.uint32


class _Block:
    """Gathers the subsets of sets and yields them packed: a row for each partition of the hash space,
    and one with the sets themselves (``part`` -1)."""

    def __init__(self, name: int, parts: int):
        self.name, self.parts, self.held = name, parts, 0
        self.sets, self.names, self.flags, self.counts = [], [], [], []

    def add(self, one: tuple, names: list[np.ndarray], flags: list[np.ndarray]) -> None:
        self.sets.append(one)
        self.names += names
        self.flags += flags
        self.counts.append(sum(map(len, names)))
        self.held += self.counts[-1]

    def full(self) -> bool:
        return self.held >= FLUSH or len(self.sets) > 0xFFFE

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.sets:
            return
        names, flags = np.concatenate(self.names), np.concatenate(self.flags)
        owner = np.repeat(np.arange(len(self.sets), dtype=np.uint16), self.counts)
        part = (names >> np.uint64(CELL + 4)) % np.uint64(self.parts)
        key = part << np.uint64(CELL) | (names & np.uint64((1 << CELL) - 1))
        order = np.argsort(key)
        key = key[order]
        ends = np.searchsorted(key, np.arange(self.parts + 1, dtype=np.uint64) << np.uint64(CELL))
        ent, comp, *rest = (np.array(x, np.int64) for x in zip(*self.sets, strict=True))
        grouped = ent != comp
        head = _pack(ent, comp, rest[0], *(x.astype(kind) for x, kind in zip(rest[1:], HEAD[3:], strict=True)))
        dest, packed = [self.parts + self.name % self.parts], [head]
        for p in np.flatnonzero(np.diff(ends)).tolist():
            at = order[ends[p] : ends[p + 1]]
            cells = (key[ends[p] : ends[p + 1]] & np.uint64((1 << CELL) - 1)).astype(np.uint32)
            several = np.unique(owner[at][grouped[owner[at]]])
            dest.append(p)
            packed.append(_pack(np.diff(cells, prepend=np.uint32(0)), owner[at], flags[at], several, comp[several]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(dest, pa.int32()), pa.array([self.name] * len(dest), pa.int64()), pa.array([-1, *dest[1:]], pa.int32()), pa.array(packed, pa.binary())], ["dest", "block", "part", "packed"]
        )


def _signer(parts: int, odd: frozenset):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the same when a lost task runs again, as it reads the same rows in the same order
        first = TaskContext.get().partitionId() << 32
        block = _Block(first, parts)
        for batch in batches:
            ids, comps = batch.column("doc_id").to_pylist(), batch.column("comp").to_pylist()
            for ent, comp, hashes in zip(ids, comps, shingle_sets(batch.column("text")), strict=True):
                if not len(hashes):
                    continue
                bands = _looked_up(len(hashes))
                names, flags, free = [], [], {}
                for band in bands:
                    m = _segments(band)
                    at = _cut(hashes, m)
                    sizes = np.diff(at)
                    whole, less, owner = _names(hashes, at, band)
                    role = LOWER if band < bands[-1] else 0
                    free[role] = _allowance(len(hashes), band, sizes, band in odd)
                    segment = np.where(np.arange(m) < _reserve(m), np.arange(m), NO_SEGMENT)
                    packed = slice(None) if band in odd else sizes > 0
                    names += [whole[packed], less]
                    flags += [(role | segment[packed] << SHIFT).astype(np.uint8), (role | DELETED | owner << SHIFT).astype(np.uint8)]
                own, low = free[0], free.get(LOWER, (0, 0))
                block.add((ent, comp, len(hashes), own[0], low[0], own[1], low[1]), names, flags)
                if block.full():
                    yield from block.rows()
                    block = _Block(block.name + 1, parts)
        yield from block.rows()

    return sign


PACKED = "block long, part int, packed binary"


def _meet(table):
    """Of one partition of the hash space: the subsets that sets of two groups share, by block. Heads of blocks pass."""
    table = table.select(["block", "part", "packed"])
    if table.column("part")[0].as_py() < 0:
        return table
    part, blocks = table.column("part")[0].as_py(), table.column("block").to_pylist()
    messages = [_unpack(b.as_py(), *MESSAGE) for b in table.column("packed")]
    counts = [len(x[0]) for x in messages]
    cells = np.concatenate([np.cumsum(x[0], dtype=np.uint32) for x in messages])
    local, flags = (np.concatenate([x[i] for x in messages]) for i in (1, 2))
    names = np.unique(np.concatenate([x[4] for x in messages]))
    group = np.empty(len(cells), np.int64)  # groups of several from 0; of one by message and set, below 0
    at = 0
    for k, x in enumerate(messages):
        of = -1 - (np.int64(k) << 16) - np.arange(1 << 16)
        of[x[3]] = np.searchsorted(names, x[4])
        group[at : at + len(x[1])] = of[x[1]]
        at += len(x[1])
    order = np.argsort(cells, kind="stable")
    cells, group, role = cells[order], group[order], flags[order]
    begin = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
    size = np.diff(np.append(begin, len(cells)))
    other = np.maximum.reduceat(group, begin) != np.minimum.reduceat(group, begin)
    index = np.add.reduceat((role & LOWER == 0).astype(np.int64), begin)
    whole = np.minimum.reduceat(role & DELETED, begin) == 0
    keep = np.flatnonzero(np.repeat(other & (index > 0) & whole, size))
    met = np.repeat(np.minimum(index, 0xFFFFFFFF), size)[keep].astype(np.uint32)
    came = order[keep]
    back = np.argsort(came)
    came, cells, met = came[back], cells[keep][back], met[back]
    ends = np.searchsorted(came, np.concatenate(([0], np.cumsum(counts))))
    rows = [(blocks[k], _pack(cells[a:b], local[came[a:b]], flags[came[a:b]], met[a:b])) for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if b > a]
    return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([part] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["block", "part", "packed"])


MET = "name long, ent long, comp long, n long, deleted boolean, indexed boolean, looked boolean, up boolean"


def _allocate(table):
    """For the sets of one block: the shared subsets under which they are indexed, and those that they
    still look up after the cost-based allocation."""
    names = [x.split()[0] for x in MET.split(", ")]
    kinds = [pa.bool_() if "boolean" in x else pa.int64() for x in MET.split(", ")]
    parts, blobs = table.column("part").to_pylist(), table.column("packed").to_pylist()
    shared = [(p, _unpack(b, *SHARED)) for p, b in zip(parts, blobs, strict=True) if p >= 0]
    if not shared:
        return pa.table([pa.array([], k) for k in kinds], names)
    head = _unpack(blobs[parts.index(-1)], *HEAD)
    name = np.concatenate([np.int64(p) << CELL | x[0].astype(np.int64) for p, x in shared])
    local, flags, met = (np.concatenate([x[i] for _, x in shared]).astype(np.int64) for i in (1, 2, 3))
    lower, deleted, segment = flags & LOWER, flags & DELETED > 0, flags >> SHIFT
    order = np.lexsort((name, -met, deleted, lower, local))  # of each set and band: whole subsets first, the most frequent ahead
    key = local[order] << 1 | lower[order]
    begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    end = np.append(begin[1:], len(order))
    free = np.where(key[begin] & 1, head[4][key[begin] >> 1], head[3][key[begin] >> 1]).astype(np.int64)
    may = np.where(key[begin] & 1, head[6][key[begin] >> 1], head[5][key[begin] >> 1]).astype(np.int64)
    whole = np.add.reduceat((~deleted[order]).astype(np.int64), begin)
    looked, up = np.zeros(len(order), bool), np.zeros(len(order), bool)
    for i in np.flatnonzero(whole > free):  # the others skip all that they share
        rows = order[begin[i] : end[i]]
        skips, count = int(free[i]), int(whole[i])
        offers = np.flatnonzero(may[i] >> np.arange(NO_SEGMENT) & 1)
        reserve = segment[rows] < NO_SEGMENT
        cost = np.bincount(segment[rows][reserve], met[rows][reserve], NO_SEGMENT)
        offers = offers[np.argsort(cost[offers], kind="stable")]
        raised = max(0, -skips)
        while raised < len(offers) and skips + raised < count and cost[offers[raised]] < met[rows[skips + raised]]:
            raised += 1
        up[rows] = np.isin(segment[rows], offers[:raised])
        looked[rows] = up[rows] | (~deleted[rows] & (np.arange(len(rows)) >= skips + raised))
    at = np.flatnonzero(looked | (lower == 0))
    out = name[at], head[0][local[at]], head[1][local[at]], head[2][local[at]], deleted[at], lower[at] == 0, looked[at], up[at]
    return pa.table([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names)


def _few(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it has few rows; beyond, the join shuffles."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


class _Join:
    def __init__(self, docs: DataFrame):
        self.spark = docs.sparkSession
        self.scratch = Scratch(self.spark, "jaccard")
        self.docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
        self.turn = 0
        base = self.docs.mapInArrow(describe, "doc_id long, n long, hi long, lo long, quick array<long>, odd array<int>")
        self.base = self.scratch.write_texts(base, "base")
        self.classes = self.scratch.write(
            self.base.where("n > 0").groupBy("n", "hi", "lo").agg(F.min("doc_id").alias("rep"), F.first("quick").alias("quick")).where("rep is not null"), "classes"
        )

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The links among ``pairs`` (``u, v``: representatives)."""
        self.turn += 1
        pairs = self.scratch.write(pairs, f"pairs-{self.turn}")
        ids = pairs.select(F.col("u").alias("rep")).unionByName(pairs.select(F.col("v").alias("rep"))).distinct()
        ids = ids.join(self.classes.select("rep", "lo"), "rep").select(F.col("rep").alias("doc_id"), "lo")
        few = F.broadcast(ids) if pairs.count() <= BROADCAST_IDS // 2 else ids
        texts = self.docs.join(few, "doc_id").select("doc_id", "lo", "text")
        rows = pairs.join(texts.toDF("v", "v_lo", "v_text"), "v").join(texts.toDF("u", "u_lo", "u_text"), "u")
        links = rows.select("u", "v", "u_lo", "v_lo", "u_text", "v_text").mapInArrow(verify, "u long, v long")
        return self.scratch.write_texts(links, f"links-{self.turn}")

    def possible(self, looks: DataFrame, index: DataFrame) -> DataFrame:
        """Pairs of ``looks`` and ``index`` (``name, ent, comp, n, deleted``; ``looks`` with ``up``)
        that share a subset and that their histograms do not refute.

        Sets are dealt into blocks of about ``BLOCK``, those that meet the same smallest set
        together, so that families stay in one block and most subsets in few. A pair of blocks is
        one group, in which a pair of sets is made once, whatever the number of subsets it shares.
        """
        self.turn += 1
        removed = F.when(F.col("deleted"), REMOVED).otherwise(0)
        slim = lambda df, role: df.select("name", "ent", "comp", "n", role.cast("byte").alias("role"))
        both = slim(looks, removed + F.when(F.col("up"), RAISED).otherwise(0)).unionByName(slim(index, removed + INDEXED))
        both = self.scratch.write(both, f"both-{self.turn}")
        lead = self.scratch.write(both.groupBy("name").agg(F.min("ent").alias("lead")), f"leads-{self.turn}")
        placed = both.join(lead, "name").groupBy("ent").agg(F.min("lead").alias("lead"), F.max("n").alias("n"), F.min("comp").alias("comp"))
        placed = self.scratch.write(placed, f"placed-{self.turn}")
        crowd = self.scratch.write(placed.groupBy("lead").agg(F.count(F.lit(1)).alias("c")), f"crowds-{self.turn}")
        total = placed.count()
        if not total:
            return self.spark.createDataFrame([], "u long, v long")
        parts = -(-total // BLOCK)
        # a small crowd goes where its lead's hash says, a large one is cut up
        cut = F.pmod(F.xxhash64("ent"), F.ceil(F.col("c") / BLOCK))
        blocks = placed.join(crowd, "lead").select("ent", "n", "comp", F.when(F.col("c") > BLOCK, F.xxhash64("lead", cut)).otherwise(F.pmod(F.xxhash64("lead"), F.lit(parts))).alias("b"))
        blocks = self.scratch.write(blocks, f"blocks-{self.turn}")
        few = F.broadcast(blocks.select("ent", "b")) if total <= BROADCAST_IDS else blocks.select("ent", "b")
        entries = self.scratch.write(both.select("name", "ent", "role").join(few, "ent"), f"entries-{self.turn}")
        is_index = F.col("role").bitwiseAND(F.lit(INDEXED).cast("byte")) > 0
        side = lambda where, name: entries.where(where).select("name", F.col("b").alias(name)).distinct()
        meet = self.scratch.write(side(~is_index, "bv").join(side(is_index, "bu"), "name"), f"meet-{self.turn}")
        mine = F.when(is_index, F.col("bu")).otherwise(F.col("bv"))
        dealt = entries.join(meet, "name").where(F.col("b") == mine).select("bv", "bu", "name", "ent", "role")
        dealt = self.scratch.write(dealt, f"dealt-{self.turn}")
        # a pair of blocks with many look-ups is cut by their sets, each part against all that is indexed
        crowded = dealt.where(~is_index).groupBy("bv", "bu").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > PAIR).select("bv", "bu", F.ceil(F.col("c") / PAIR).cast("int").alias("cuts"))
        part = F.pmod(F.xxhash64("ent"), F.coalesce("cuts", F.lit(1))).cast("int")
        every = F.sequence(F.lit(0), F.coalesce("cuts", F.lit(1)) - 1)
        cut = dealt.join(crowded, ["bv", "bu"], "left").select("bv", "bu", "name", "ent", "role", F.explode(F.when(is_index, every).otherwise(F.array(part))).alias("cut"))
        cut = cut.select(F.xxhash64("bv", "bu", "cut").alias("pair"), "name", "ent", "role")
        ids = F.broadcast(blocks.select("ent")) if total <= BROADCAST_IDS else blocks.select("ent")
        cells = self.docs.join(ids, F.col("doc_id") == F.col("ent"), "left_semi").mapInArrow(_histograms, "doc_id long, n long, cells binary")
        cells = cells.groupBy(F.col("doc_id").alias("ent")).agg(F.first("cells").alias("cells"))
        cells = self.scratch.write_texts(cells.join(blocks.select("ent", "n", "comp"), "ent"), f"cells-{self.turn}")
        self.scratch.drop(*(f"{x}-{self.turn}" for x in ("both", "leads", "placed", "crowds", "blocks", "entries", "meet")))
        sets = cut.select("pair", "ent").distinct().join(cells, "ent").select("pair", F.lit(0).cast("long").alias("name"), "ent", F.lit(SET).cast("byte").alias("role"), "n", "comp", "cells")
        rows = cut.withColumns({"n": F.lit(None).cast("long"), "comp": F.lit(None).cast("long"), "cells": F.lit(None).cast("binary")}).unionByName(sets)
        return rows.groupBy("pair").applyInArrow(_compare, "u long, v long")

    def quick_pairs(self) -> DataFrame:
        """Each class with the two it shares most quick subsets with, of those that lead a subset (smallest id)."""
        entries = self.classes.select("rep", "n", F.explode("quick").alias("name"))
        leads = entries.groupBy("name").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("rep", "n")).alias("lead")).where("c > 1").drop("c")
        met = entries.join(self.scratch.write(leads, "leads"), "name").where(F.col("rep") != F.col("lead.rep"))
        met = met.where(F.least("n", F.col("lead.n")) * NUM >= F.greatest("n", F.col("lead.n")) * DEN)
        votes = met.groupBy(F.col("rep").alias("v"), F.col("lead.rep").alias("u")).agg(F.count(F.lit(1)).alias("c"))
        best = votes.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy(F.desc("c"), "u")))
        return best.where("r <= 2").select("u", "v")

    def met(self, groups: DataFrame) -> DataFrame:
        """Shared subsets of all segments between different groups, as rows of ``MET``."""
        copies = self.base.where("n > 0 and doc_id is not null").select("doc_id").join(self.classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_anti").select("doc_id", F.lit(None).cast("long").alias("comp"))
        moved = groups.where("node <> comp").select(F.col("node").alias("doc_id"), "comp")
        info = self.scratch.write(copies.unionByName(moved).distinct().withColumn("known", F.lit(True)), "info")
        tagged = self.docs.where("text is not null and doc_id is not null").join(_few(info), "doc_id", "left")
        tagged = tagged.where("known is null or comp is not null").select("doc_id", F.coalesce("comp", "doc_id").alias("comp"), "text")
        words = self.base.agg(F.sum("n")).collect()[0][0] or 0
        odd = frozenset(r[0] for r in self.base.select(F.explode("odd")).distinct().collect())
        parts = max(4 * int(self.spark.conf.get("spark.sql.shuffle.partitions")), 64, words // PART_WORDS)
        packed = tagged.mapInArrow(_signer(parts, odd), f"dest int, {PACKED}")
        shared = packed.groupBy("dest").applyInArrow(_meet, PACKED)
        return self.scratch.write_texts(shared.groupBy("block").applyInArrow(_allocate, MET), "met")

    def run(self) -> DataFrame:
        """``u, v``: enough links between representatives to connect all that are connected."""
        links = self.verified(self.quick_pairs())
        groups = self.scratch.write(components(links, self.scratch, "quick"), "groups-1")
        met = self.met(groups)
        looks = self.scratch.write(met.where("looked").select("name", "ent", "comp", "n", "deleted", "up"), "looks")
        index = met.where("indexed").join(_few(looks.select("name").distinct()), "name", "left_semi")
        index = self.scratch.write(index.select("name", "ent", "comp", "n", "deleted"), "index")
        self.scratch.drop("met")
        # one member of each other group first; of a group of one that is all
        single = index.join(groups.select("comp").distinct(), "comp", "left_anti")
        several = self.scratch.write(index.join(groups.select("comp").distinct(), "comp", "left_semi"), "several")
        heads = several.groupBy("name", "comp", "deleted").agg(F.min_by(F.struct("ent", "n"), "ent").alias("h")).select("name", "h.ent", "comp", "h.n", "deleted")
        links = links.unionByName(self.verified(self.possible(looks, single.unionByName(heads))))
        now = self.scratch.write(components(links, self.scratch, "second"), "groups-2")

        # then all members of groups of several that are still apart
        def labelled(df: DataFrame) -> DataFrame:
            return df.join(now.select(F.col("node").alias("ent"), F.col("comp").alias("new")), "ent", "left").withColumn("comp", F.coalesce("new", "ent")).drop("new")

        again = looks.join(several.select("name").distinct(), "name", "left_semi")
        return links.unionByName(self.verified(self.possible(labelled(again), labelled(several))))


def join_components(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs``."""
    return _components_of(_Join(docs))


def _components_of(job: _Join) -> DataFrame:
    links = job.run()
    comps = job.scratch.write(components(links, job.scratch, "final"), "groups-final")
    # representatives are the smallest ids of their classes, so the smallest representative is the smallest id
    moved = comps.where("node <> comp").select(F.col("node").alias("rep"), "comp")
    classes = job.classes.select("n", "hi", "lo", "rep").join(moved, "rep", "left").select("n", "hi", "lo", F.coalesce("comp", "rep").alias("component_id"))
    classes = job.scratch.write(classes, "class-components")
    job.scratch.keep_only("base", "class-components")
    out = job.base.select("doc_id", "n", "hi", "lo").join(classes, ["n", "hi", "lo"], "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each component, that of the smallest id, null ids last; all columns kept.

    Rows are joined by keys of their own, so that repeated rows, rows that share an id and rows of a
    null id are judged each by its text. Rows without shingles all stay.
    """
    scratch = Scratch(docs.sparkSession, "near-copies")
    rows = keyed(docs, scratch)
    job = _Join(rows.select(F.col("_row").alias("doc_id"), F.col("_doc.text").alias("text")))
    held = _components_of(job).where("n_shingles > 0")
    held = held.select(F.col("doc_id").alias("_gone"), "component_id").join(rows.select(F.col("_row").alias("_gone"), F.col("_doc.doc_id").alias("id")), "_gone")
    # a group of one loses nothing, so only groups of several are looked at
    first = held.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "_gone"))["_gone"].alias("_first"), F.count(F.lit(1)).alias("k")).where("k > 1")
    gone = scratch.write(held.join(first, "component_id").where("_gone <> _first").select("_gone"), "gone")
    job.scratch.keep_only()
    return rows.join(gone, F.col("_row") == F.col("_gone"), "left_anti").select("_doc.*")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
