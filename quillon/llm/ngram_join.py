"""N-gram Jaccard join with signature trees.

A document's set is its distinct five-word shingles, as 64-bit hashes. Documents
with equal sets are one *set*, named by a 64-bit sum over its shingles; only
sets are compared. Two sets link if 100 * |A and B| >= 80 * |A or B|.

Signature trees do the comparing: a node holds the OR of its sets' token bitmaps
and the range of their sizes; the dual traversal of two nodes stops where the
greatest possible overlap of any pair below them cannot reach the bar. At the
leaves the shingles themselves are compared, unless the pair is connected
already. Trees are built per task from rows that share a token:

1. Every (shingle, set) is dealt by shingle and counted over all documents. The
   hashes' leading bits make parts of about a million shingles, and a Spark
   partition holds several parts, which it takes one after the other. A shingle
   with a large share of all is hot: tasks report it in the scan that names the
   sets, and it isn't counted but passes for the most frequent, dealt by set.
   Shingles of one set only can't be part of an overlap and are dropped, but
   still count in the set's size.
2. Ordered from the rarest shingle on, a set can link only by one of its first
   size - ceil(0.8 * size) + 1 shingles. Sets whose share of these holds no
   shared shingle have no link at all: they are done.
3. Seeding: the others meet in chunks of bounded size under their smallest
   shingle hash; a tree per chunk links them. Chunks of a crowded hash send on
   one set a component, until one chunk holds them.
4. Completing: every pair not yet connected that shares a prefix shingle is
   tried as well. The sets are dealt to leaf nodes of bounded size, by component
   or by their most frequent shingle; node pairs are matched by shingle and size
   range, and each larger node is traversed against its partners. So no link is
   lost; pairs within a component are not listed.

``links`` lists every link between distinct sets: step 4 over the candidates of
step 2 with each set as its own component, by a traversal that skips no pair.
Its rows grow with the square of a group of near copies, as the links do.

Defined results: a text of fewer than five words has one shingle, the whole
sequence; null, empty and blank texts have none and link with nothing, not even
each other; repeated rows and equal ids each get a row; null ids take part in
links and are never the smallest id (a component of null ids only has a null
id); extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillon.llm.groups import attach_groups
from quillon.llm.scratch import release, written
from quillon.llm.textnp import SPACED, blocks, gram_hashes, mix, words

WORDS = 5
#: A link needs NUM * intersection >= DEN * union.
NUM, DEN = 100, 80
#: Sets in one chunk of a seed, and in one leaf node of the completing step; a task of that step meets a node and partners of about twice as many.
CHUNK = 256
#: Counts of a shingle stop here; rarer is what matters, and any order that all share is right.
TOP_COUNT = 4096
#: A shingle is hot from about this share of all rows (shingle, set) on; so at most 1/share of them are broadcast.
HOT_SHARE = 1 / 8192
#: Rows (shingle, set) that a task looks at together for large shares, and the fewest of one shingle that it reports.
LOOK, LEAST_HOT = 1 << 21, 64
#: Bits of a token bitmap.
BITS = 2048
FANOUT = 8
_M1, _M2 = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


# --- sets -------------------------------------------------------------------


def shingle_sets(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, offsets): the sorted distinct shingles of each text."""
    h, at, _, _ = words(raw, offs, SPACED)
    first = np.searchsorted(at, np.arange(len(offs)))
    g = gram_hashes(h, WORDS)
    out, sizes = [], np.zeros(len(offs), np.int64)
    for k in range(len(offs) - 1):
        a, b = first[k], first[k + 1]
        if b - a >= WORDS:
            own = np.sort(g[a : b - WORDS + 1])
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif b > a:
            own = gram_hashes(h[a:b], int(b - a))
        else:
            continue
        out.append(own)
        sizes[k + 1] = len(own)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.cumsum(sizes)


def names(tok: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The 64-bit name of each set; 0 for the empty one."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(tok ^ _M1))))
    name = total[offs[1:]] - total[offs[:-1]]
    n = np.diff(offs)
    return np.where(n > 0, mix(name + n.astype(np.uint64) * _M2) | np.uint64(1), np.uint64(0)).view(np.int64)


def _heavy(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The shingles with a large share of some sets' shingles, and how many of the sets have each."""
    tok, count = np.unique(np.concatenate(held), return_counts=True)
    large = count >= max(LEAST_HOT, int(count.sum() * HOT_SHARE))
    return tok[large].view(np.int64), count[large]


def _info(kind: pa.DataType):
    """Size and name of each row's set; and rows with a null name: shingles with a large share of what a task looked at (key), and how many sets of it have them (n)."""

    def report(held: list[np.ndarray]) -> pa.RecordBatch:
        tok, count = _heavy(held)
        return pa.RecordBatch.from_arrays([pa.nulls(len(tok), kind), pa.array(tok), pa.array(count, pa.int64()), pa.nulls(len(tok), pa.int64())], ["doc_id", "key", "n", "sig"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row, raw, offs in blocks(batch.column(1)):
                tok, at = shingle_sets(raw, offs)
                k = len(offs) - 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, k).cast(kind), batch.column(2).slice(row, k), pa.array(np.diff(at)), pa.array(names(tok, at))], ["doc_id", "key", "n", "sig"])
                held.append(tok)
                size += len(tok)
                if size > LOOK:
                    yield report(held)
                    held, size = [], 0
        if held:
            yield report(held)

    return run


# --- rows of many tokens, packed: a header a set, then its tokens ----------------


def pack(sig: np.ndarray, n: np.ndarray, run: np.ndarray, tok: np.ndarray, low_bytes: int, extra: np.ndarray | None = None) -> bytes:
    """Sets' names, sizes and numbers of tokens, then ``low_bytes`` of each token, then a 16-bit number each."""
    body = np.ascontiguousarray(tok.view(np.uint8).reshape(-1, 8)[:, :low_bytes])
    parts = [np.array([len(sig), len(tok)], np.int32).tobytes(), sig.astype(np.int64).tobytes(), n.astype(np.int32).tobytes(), run.astype(np.int32).tobytes(), body.tobytes()]
    if extra is not None:
        parts.append(extra.astype(np.uint16).tobytes())
    return b"".join(parts)


def unpack(data: bytes, low_bytes: int, extra: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """Per token: set name, set size, token, and the number packed with it."""
    k, m = np.frombuffer(data, np.int32, 2)
    at = 8
    sig = np.frombuffer(data, np.int64, k, at)
    n = np.frombuffer(data, np.int32, k, at := at + 8 * k)
    run = np.frombuffer(data, np.int32, k, at := at + 4 * k)
    body = np.frombuffer(data, np.uint8, m * low_bytes, at := at + 4 * k)
    tok = np.zeros((m, 8), np.uint8)
    tok[:, :low_bytes] = body.reshape(m, low_bytes)
    more = np.frombuffer(data, np.uint16, m, at + m * low_bytes) if extra else None
    return np.repeat(sig, run), np.repeat(n, run), tok.view(np.uint64).reshape(-1), more


def _runs(key: np.ndarray) -> np.ndarray:
    """Starts of runs of equal values, and the length at the end."""
    return np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)])) if len(key) else np.zeros(1, np.int64)


#: Fewest partitions of a shuffle of tokens, and the most of them for each of the session's shuffle partitions, as powers of two.
LEAST_LOG2, EACH_LOG2 = 6, 2


def slots(n: int) -> np.ndarray:
    """For each of ``n`` parts a number that Spark's hash partitioning puts in that partition of n.

    Dealt by the plain part numbers, some partitions would get several parts and
    others none. Spark hashes an int column with 32-bit Murmur3, seed 42.
    """
    out, start = np.full(n, -1, np.int64), 0
    turn = lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
    while (out < 0).any():
        value = np.arange(start, start + 8 * n, dtype=np.uint32)
        start += 8 * n
        k = turn(value * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        h = turn(np.uint32(42) ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= np.uint32(4)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        h ^= h >> np.uint32(16)
        at = h.view(np.int32).astype(np.int64) % n
        first = np.unique(at, return_index=True)
        fresh = out[first[0]] < 0
        out[first[0][fresh]] = value[first[1][fresh]]
    return out.astype(np.int32)


def low_bytes(parts_log2: int) -> int:
    """Bytes kept of a token that is dealt by its highest bits: with those, all 64."""
    return 8 - parts_log2 // 8


def _deal_tokens(parts_log2: int, partitions_log2: int, hot: np.ndarray):
    """(slot, p, hot, data): every set's tokens, dealt by their highest bits, and the ``hot`` ones (sorted) by those of the set's name. Sets met before in the task are left out."""
    slot, finer = slots(1 << partitions_log2), parts_log2 - partitions_log2

    def flush(sig, n, run, tok):
        owner = np.repeat(np.arange(len(sig)), run)
        if len(hot):
            is_hot = hot[np.minimum(np.searchsorted(hot, tok), len(hot) - 1)] == tok
            if is_hot.any():
                by_set = (sig.view(np.uint64)[owner[is_hot]] >> np.uint64(64 - parts_log2)).astype(np.int64)
                yield dealt(sig, n, owner[is_hot], tok[is_hot], by_set, True, 8)
                owner, tok = owner[~is_hot], tok[~is_hot]
        if len(tok):
            yield dealt(sig, n, owner, tok, (tok >> np.uint64(64 - parts_log2)).astype(np.int64), False, low_bytes(parts_log2))

    def dealt(sig, n, owner, tok, p, is_hot, width):
        order = np.argsort(p, kind="stable")
        p, owner, tok = p[order], owner[order], tok[order]
        cut = _runs(p)
        rows, data = [], []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            own = _runs(owner[a:b])
            who = owner[a:b][own[:-1]]
            rows.append(int(p[a]))
            data.append(pack(sig[who], n[who], np.diff(own), tok[a:b], width))
        part = np.array(rows, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(slot[part >> finer]), pa.array(part, pa.int32()), pa.array(np.full(len(part), is_hot)), pa.array(data, pa.binary())], ["slot", "p", "hot", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, raw, offs in blocks(batch.column(0), 2 << 20):
                tok, at = shingle_sets(raw, offs)
                sig, n = names(tok, at), np.diff(at)
                fresh = []
                for k, s in enumerate(sig.tolist()):
                    if s and s not in seen:
                        seen.add(s)
                        fresh.append(k)
                if len(seen) > 1 << 20:  # forgetting costs a repeated row, no more
                    seen.clear()
                if fresh:
                    yield from flush(sig[fresh], n[fresh], n[fresh], np.concatenate([tok[at[k] : at[k + 1]] for k in fresh]))

    return run


def _count_shared(parts_log2: int, partitions_log2: int):
    """Of the tokens of a part: those of several sets, dealt by set, with their count. Rows come sorted by part."""
    slot, finer = slots(1 << partitions_log2), parts_log2 - partitions_log2

    def out(tok, sig, n, count):
        q = (sig.view(np.uint64) >> np.uint64(64 - parts_log2)).astype(np.int64)
        order = np.lexsort((sig, q))
        tok, sig, n, count, q = tok[order], sig[order], n[order], count[order], q[order]
        cut = _runs(q)
        rows, data = [], []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            own = _runs(sig[a:b])[:-1]
            rows.append(int(q[a]))
            data.append(pack(sig[a:b][own], n[a:b][own], np.diff(np.append(own, b - a)), tok[a:b], 8, count[a:b]))
        part = np.array(rows, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(slot[part >> finer]), pa.array(part, pa.int32()), pa.array(data, pa.binary())], ["slot", "p", "data"])

    def settle(held, final):
        """Tokens known to be frequent leave at once, so that memory doesn't grow with a hot one."""
        sig, n, tok = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((sig, tok))
        sig, n, tok = sig[order], n[order], tok[order]
        new = np.concatenate(([True], (tok[1:] != tok[:-1]) | (sig[1:] != sig[:-1])))
        sig, n, tok = sig[new], n[new], tok[new]
        cut = _runs(tok)
        count = np.repeat(np.diff(cut), np.diff(cut))
        leave = (count >= 2) if final else (count >= TOP_COUNT)
        return (tok[leave], sig[leave], n[leave], np.minimum(count[leave], TOP_COUNT)), (sig[~leave], n[~leave], tok[~leave])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, hot, limit, part = [], 0, np.zeros(0, np.uint64), 1 << 20, None
        for batch in batches:
            for p, is_hot_row, data in zip(batch.column("p").to_pylist(), batch.column("hot").to_pylist(), batch.column("data"), strict=True):
                if is_hot_row:
                    sig, n, tok, _ = unpack(data.as_py(), 8)
                    yield out(tok, sig, n, np.full(len(tok), TOP_COUNT))
                    continue
                if p != part:
                    if held:
                        gone, _ = settle(held, True)
                        if len(gone[0]):
                            yield out(*gone)
                    held, size, hot, limit, part = [], 0, np.zeros(0, np.uint64), 1 << 20, p
                sig, n, tok, _ = unpack(data.as_py(), low_bytes(parts_log2))
                tok |= np.uint64(p << (64 - parts_log2))
                if len(hot):
                    k = np.minimum(np.searchsorted(hot, tok), len(hot) - 1)
                    is_hot = hot[k] == tok
                    if is_hot.any():
                        yield out(tok[is_hot], sig[is_hot], n[is_hot], np.full(int(is_hot.sum()), TOP_COUNT))
                        sig, n, tok = sig[~is_hot], n[~is_hot], tok[~is_hot]
                held.append((sig, n, tok))
                size += len(tok)
                if size > limit:
                    gone, rest = settle(held, False)
                    held, size = [rest], len(rest[0])
                    limit = max(1 << 20, 2 * size)
                    if len(gone[0]):
                        hot = np.union1d(hot, gone[0])
                        yield out(*gone)
        if held:
            gone, _ = settle(held, True)
            if len(gone[0]):
                yield out(*gone)

    return run


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets that a shared token puts in their prefix: sig, n, seed (smallest token hash), toks (shared ones), pref (those of the prefix).

    Rows come sorted by part, which is all that is held of them at a time.
    """
    held, part = [], None
    for batch in batches:
        for p, data in zip(batch.column("p").to_pylist(), batch.column("data"), strict=True):
            if p != part and held:
                yield from _prefixes(held)
                held = []
            part = p
            held.append(unpack(data.as_py(), 8, True))
    if held:
        yield from _prefixes(held)


def _prefixes(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    sig, n, tok, count = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((tok, count, sig))
    sig, n, tok, count = sig[order], n[order], tok[order], count[order]
    new = np.concatenate(([True], (tok[1:] != tok[:-1]) | (sig[1:] != sig[:-1])))
    sig, n, tok = sig[new], n[new], tok[new]
    cut = _runs(sig)
    rows = ([], [], [], [], [])
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        size = int(n[a])
        prefix = size - (DEN * size + NUM - 1) // NUM + 1
        left = prefix - (size - (b - a))  # the tokens of this set only are the rarest
        if left > 0:
            own = np.sort(tok[a:b])
            for col, x in zip(rows, (int(sig[a]), size, int(mix(own ^ _M2).min().view(np.int64)), own.tobytes(), tok[a : a + left].tobytes()), strict=True):
                col.append(x)
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    if rows[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], ["sig", "n", "seed", "toks", "pref"])


# --- signature trees --------------------------------------------------------------


class Tree:
    """Sets ordered by content. Level 0 holds a node a set; each node above covers FANOUT below.

    A node has: the OR of its bitmaps, least and greatest set size, most shared
    tokens, and most tokens beyond one a bit.
    """

    def __init__(self, sig: np.ndarray, n: np.ndarray, toks: list[np.ndarray]):
        seed = np.array([t[0] if len(t) else 0 for t in toks], np.uint64)
        order = np.lexsort((n, seed))  # near copies mostly share their smallest token
        self.sig, self.n, self.toks = sig[order], n[order].astype(np.int64), [toks[k] for k in order]
        flags = np.zeros((len(order), BITS), bool)
        for row, t in zip(flags, self.toks, strict=True):
            row[((t >> np.uint64(13)) & np.uint64(BITS - 1)).astype(np.int64)] = True
        have = np.array([len(t) for t in self.toks], np.int64)
        over = have - flags.sum(axis=1)
        self.levels = [(np.packbits(flags, axis=1).view(np.uint64), self.n, self.n, have, over)]
        while len(self.levels[-1][0]) > 1:
            bits, low, high, most, over = self.levels[-1]
            at = np.arange(0, len(bits), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(most, at), np.maximum.reduceat(over, at)))


def possible(a: tuple, i: np.ndarray, b: tuple, j: np.ndarray) -> np.ndarray:
    """Whether some pair below nodes i of level a and j of level b could link.

    Overlap is at most the tokens either side has, and at most the bits set in
    both nodes plus the tokens that one side holds beyond one a bit.
    """
    bits_a, low_a, high_a, most_a, over_a = a[0], a[1][i], a[2][i], a[3][i], a[4][i]
    bits_b, low_b, high_b, most_b, over_b = b[0], b[1][j], b[2][j], b[3][j], b[4][j]
    need = -(-DEN * (low_a + low_b) // (NUM + DEN))
    top = np.minimum(most_a, most_b)
    fit = (NUM * high_a >= DEN * low_b) & (NUM * high_b >= DEN * low_a) & (top >= need)
    for s in range(0, len(i), 1 << 14):
        k = s + np.flatnonzero(fit[s : s + (1 << 14)])
        both = np.bitwise_count(bits_a[i[k]] & bits_b[j[k]]).sum(axis=1, dtype=np.int64)
        fit[k] = both + np.minimum(over_a[k], over_b[k]) >= need[k]
    return fit


def overlap(ta: np.ndarray, tb: np.ndarray) -> int:
    both = np.concatenate((ta, tb))
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def linked(ta: np.ndarray, na: int, tb: np.ndarray, nb: int) -> bool:
    """Exact test on the sets' shared tokens and full sizes."""
    inter = overlap(ta, tb)
    return NUM * inter >= DEN * (na + nb - inter)


def _down(i: np.ndarray, j: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    kids = (i[:, None] * FANOUT + np.arange(FANOUT)).reshape(-1)
    there = kids < size
    return kids[there], np.repeat(j, FANOUT)[there]


def leaf_pairs(x: Tree, y: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Places of the sets of ``x`` and of ``y`` that could link, by dual traversal; in one tree the first is at most the second."""
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    lx, ly = len(x.levels) - 1, len(y.levels) - 1
    while len(i):
        fit = possible(x.levels[lx], i, y.levels[ly], j)
        i, j = i[fit], j[fit]
        if lx == ly == 0:
            break
        if lx >= ly:
            i, j = _down(i, j, len(x.levels[lx - 1][0]))
            lx -= 1
        else:
            j, i = _down(j, i, len(y.levels[ly - 1][0]))
            ly -= 1
        if x is y and lx == ly:
            keep = i <= j
            i, j = i[keep], j[keep]
    return i, j


def traverse(x: Tree, y: Tree, group_x: np.ndarray, group_y: np.ndarray) -> list[tuple[int, int]]:
    """Links (larger name, smaller name) between sets not connected yet, by dual traversal.

    ``x`` and ``y`` may be one tree. The group arrays number what is connected,
    by place in the tree, and are updated; pairs within a group are not tried.
    """
    i, j = leaf_pairs(x, y)
    edges = []
    for s in range(0, len(i), 4096):
        a, b = i[s : s + 4096], j[s : s + 4096]
        for k in np.flatnonzero(group_x[a] != group_y[b]).tolist():
            p, q = int(a[k]), int(b[k])
            old, new = group_y[q], group_x[p]
            if old != new and linked(x.toks[p], int(x.n[p]), y.toks[q], int(y.n[q])):
                group_x[group_x == old] = new
                group_y[group_y == old] = new
                sp, sq = int(x.sig[p]), int(y.sig[q])
                edges.append((max(sp, sq), min(sp, sq)))
    return edges


def all_links(x: Tree, y: Tree) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(larger names, smaller names, shared shingles) of all links between sets of ``x`` and of ``y``, block by block, by dual traversal."""
    i, j = leaf_pairs(x, y)
    if x is y:
        i, j = i[i < j], j[i < j]
    for s in range(0, len(i), 4096):
        a, b = i[s : s + 4096], j[s : s + 4096]
        inter = np.array([overlap(x.toks[p], y.toks[q]) for p, q in zip(a.tolist(), b.tolist(), strict=True)], np.int64)
        good = NUM * inter >= DEN * (x.n[a] + y.n[b] - inter)
        if good.any():
            sa, sb = x.sig[a[good]], y.sig[b[good]]
            yield np.maximum(sa, sb), np.minimum(sa, sb), inter[good]


def _by_key(batches: Iterator[pa.RecordBatch], keys: list[str]):
    """Data of one key after the other, from rows that are sorted by the keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(len(batch), bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cut = np.concatenate(([0], np.flatnonzero(change), [len(batch)]))
        if held and any(held[-1].column(k)[-1].as_py() != c[0] for k, c in zip(keys, cols, strict=True)):
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            held.append(batch.slice(a, b - a))
            if b < len(batch):
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _tree(t: pa.Table) -> Tree:
    return Tree(t.column("sig").to_numpy(), t.column("n").to_numpy(), [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("toks")])


_SEEDED = "a long, b long, seed long, sig long, n int, toks binary"


def _seed_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each chunk; and, for a seed of several chunks, one set a component to meet the others."""
    for t in _by_key(batches, ["seed", "chunk"]):
        edges, tree, chunks = [], None, t.column("chunks")[0].as_py()
        if len(t) > 1:
            tree = _tree(t)
            group = np.arange(len(t))
            edges = traverse(tree, tree, group, group)
        none = pa.nulls(len(edges))
        if edges:
            a, b = zip(*edges, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.binary())], ["a", "b", "seed", "sig", "n", "toks"])
        if chunks > 1:
            tree = tree or _tree(t)
            first = np.unique(group, return_index=True)[1] if len(t) > 1 else np.zeros(1, np.int64)
            gap = pa.nulls(len(first), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [gap, gap, pa.array([t.column("seed")[0].as_py()] * len(first), pa.int64()), pa.array(tree.sig[first]), pa.array(tree.n[first], pa.int32()), pa.array([tree.toks[k].tobytes() for k in first], pa.binary())],
                ["a", "b", "seed", "sig", "n", "toks"],
            )


def _node_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within an anchor node, and between its sets and its partners'."""
    for t in _by_key(batches, ["anchor", "part"]):
        own = t.column("own").to_numpy(zero_copy_only=False).astype(bool)
        number: dict[int, int] = {}
        of = {s: number.setdefault(c, len(number)) for s, c in zip(t.column("sig").to_pylist(), t.column("comp").to_pylist(), strict=True)}
        x = _tree(t.filter(pa.array(own)))
        gx = np.array([of[s] for s in x.sig.tolist()])
        edges = traverse(x, x, gx, gx) if len(set(gx.tolist())) > 1 else []
        if not own.all():
            y = _tree(t.filter(pa.array(~own)))
            edges += traverse(x, y, gx, np.array([of[s] for s in y.sig.tolist()]))
        if edges:
            a, b = zip(*edges, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _node_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All links within an anchor node, and between its sets and its partners'."""
    for t in _by_key(batches, ["anchor", "part"]):
        own = t.column("own").to_numpy(zero_copy_only=False).astype(bool)
        x = _tree(t.filter(pa.array(own)))
        for y in [x] if own.all() else [x, _tree(t.filter(pa.array(~own)))]:
            for a, b, shared in all_links(x, y):
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(shared)], ["a", "b", "shared"])


# --- connected components ------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(sig, root): the smallest name connected to each end of ``edges`` (a, b), a > b; roots themselves are absent.

    Every name first settles on its smallest smaller neighbour and hands its
    other ones to that; then pointers are doubled up to the roots. Everything
    stays distributed and written.
    """
    e = written(edges.select("a", "b").distinct(), "links")
    while True:
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        more = e.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        if more.isEmpty():
            break
        e = written(more.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
    up = e.select(F.col("a").alias("sig"), F.col("b").alias("root"))
    n = up.count()
    while True:
        above = up.select(F.col("sig").alias("root"), F.col("root").alias("next"))
        group = up.groupBy("root").agg(F.count(F.lit(1)).alias("group_size")).join(above, "root", "left")
        group = written(group.select("root", "group_size", F.coalesce("next", "root").alias("next")), "roots")
        if group.where("next <> root").isEmpty():
            return up
        up = written(attach_groups(up, group, "root", n).select("sig", F.col("next").alias("root")), "links")


# --- the join ----------------------------------------------------------------------------


def _explode_prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pref = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("pref")]
        at = np.repeat(np.arange(len(pref)), [len(p) for p in pref])
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(pref))] + [batch.column(c).take(pa.array(at)) for c in ("sig", "comp")], ["tok", "sig", "comp"])


def _links(cands: DataFrame) -> DataFrame:
    """(sig, root) of every candidate set that links with another."""
    rows = cands.select("seed", "sig", "n", "toks")
    links, count = None, cands.count()
    while count:
        crowded = rows.groupBy("seed").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks")).where("chunks > 1")
        dealt = rows.join(crowded, "seed", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("chunk", F.pmod(F.xxhash64("sig"), F.col("chunks").cast("long")).cast("int"))
        met = written(dealt.repartition("seed", "chunk").sortWithinPartitions("seed", "chunk").mapInArrow(_seed_trees, _SEEDED), "seeds")
        found = met.where("a is not null").select("a", "b")
        links = found if links is None else links.unionByName(found)
        rows = met.where("sig is not null").select("seed", "sig", "n", "toks")
        left = rows.count()
        if left > 0.7 * count:  # they don't thin out: the completing step has them
            break
        count = left
    root = components(links) if links is not None else None
    if root is None:
        return cands.select("sig", F.col("sig").alias("root")).limit(0)
    return written(complete(cands, root, links), "roots")


def complete(cands: DataFrame, root: DataFrame, links: DataFrame) -> DataFrame:
    """(sig, root) after all pairs of different components that share a prefix token were tried."""
    own = cands.select("sig", "n").join(root, "sig", "left").withColumn("comp", F.coalesce("root", "sig")).drop("root")
    size = written(own.groupBy("comp").agg(F.count(F.lit(1)).alias("group_size")), "sizes")
    own = written(attach_groups(own, size, "comp", cands.count()), "own")
    met = _meetings(cands, own)
    if met is None:
        return root
    more = written(met.mapInArrow(_node_trees, "a long, b long"), "links")
    if more.isEmpty():
        return root
    return components(links.unionByName(more))


def _meetings(cands: DataFrame, own: DataFrame) -> DataFrame | None:
    """Node by node the sets of ``own`` (sig, n, comp, group_size) and of the partner nodes, sorted by anchor and part; None if no token joins two components."""
    spread = own.select("sig", "comp").join(cands.select("sig", "pref"), "sig").mapInArrow(_explode_prefix, "tok long, sig long, comp long")
    active = written(
        spread.groupBy("tok").agg(F.min("comp").alias("one"), F.max("comp").alias("other"), F.count(F.lit(1)).alias("c")).where("one <> other").select("tok", "c"), "active"
    )
    if active.isEmpty():
        return None
    hit = written(spread.join(active, "tok"), "hit")
    # Leaf nodes: parts of one large component, or of the sets that have the same most frequent token.
    placed = own.join(hit.groupBy("sig").agg(F.max(F.struct("c", "tok"))["tok"].alias("home")), "sig")
    large = F.col("group_size") > CHUNK // 8
    placed = placed.withColumn("home", F.when(large, F.col("comp")).otherwise(F.col("home"))).withColumn("large", large)
    crowded = placed.groupBy("large", "home").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("parts")).where("parts > 1")
    placed = placed.join(crowded, ["large", "home"], "left")
    node = F.xxhash64("large", "home", F.pmod(F.xxhash64("sig"), F.coalesce("parts", F.lit(1))))
    placed = written(placed.select("sig", "n", "comp", node.alias("node")), "nodes")
    stats = placed.groupBy("node").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.count(F.lit(1)).alias("size"), F.when(F.min("comp") == F.max("comp"), F.min("comp")).alias("only")
    )
    met = written(hit.join(placed.select("sig", "node"), "sig").select("tok", "node").distinct().join(stats, "node"), "met")
    # One side leaves out the component with most of a token's nodes: two nodes of different components are not
    # both in it, and the nodes of one large component don't meet each other.
    each = met.where("only is not null").groupBy("tok", "only").agg(F.count(F.lit(1)).alias("c"))
    most = written(each.groupBy("tok").agg(F.max(F.struct("c", "only"))["only"].alias("most")), "main")
    rest = met.join(most, "tok", "left").where("most is null or only is null or only <> most").drop("most")
    x, y = met.alias("x"), rest.alias("y")
    first = F.struct("x.size", "x.node") >= F.struct("y.size", "y.node")
    side = lambda c: (F.when(first, F.col(f"x.{c}")).otherwise(F.col(f"y.{c}")), F.when(first, F.col(f"y.{c}")).otherwise(F.col(f"x.{c}")))
    (anchor, partner), (_, size) = side("node"), side("size")
    pairs = written(
        x.join(y, (F.col("x.tok") == F.col("y.tok")) & ~F.coalesce(F.col("x.only") == F.col("y.only"), F.lit(False))
               & (NUM * F.col("x.high") >= DEN * F.col("y.low")) & (NUM * F.col("y.high") >= DEN * F.col("x.low")))
        .select(anchor.alias("anchor"), partner.alias("partner"), size.alias("size")).distinct(),
        "pairs",
    )
    parts = pairs.groupBy("anchor").agg(F.ceil(F.sum("size") / (2 * CHUNK)).cast("long").alias("parts"))
    tasks = pairs.join(parts, "anchor").withColumn("part", F.pmod(F.xxhash64("partner"), "parts")).select("anchor", "partner", "part")
    sets = placed.join(cands.select("sig", "toks"), "sig")
    mine = tasks.select("anchor", "part").distinct().join(sets, F.col("anchor") == F.col("node")).withColumn("own", F.lit(True))
    theirs = tasks.where("partner <> anchor").join(sets, F.col("partner") == F.col("node")).withColumn("own", F.lit(False)).drop("partner")
    return mine.unionByName(theirs).drop("node").repartition("anchor", "part").sortWithinPartitions("anchor", "part")


def _sets(texts: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Per row of ``texts`` (doc_id, text, key) its set's size and name; the candidate sets; the number of rows."""
    kind = texts.schema["doc_id"].dataType.simpleString()
    found = written(texts.mapInArrow(_info(to_arrow_type(texts.schema["doc_id"].dataType)), f"doc_id {kind}, key long, n long, sig long"), "sets")
    info = found.where("sig IS NOT NULL")
    n_rows, n_tokens = info.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    # A shingle with twice HOT_SHARE of all is reported for at least half of that; the sums let at most 1 / HOT_SHARE pass.
    heavy = found.where("sig IS NULL").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= max(LEAST_HOT, int(n_tokens * HOT_SHARE)))
    hot = np.sort(np.array([r["key"] for r in heavy.select("key").collect()], np.int64).view(np.uint64))
    # A part holds about a million tokens, or the sets of as many. The number of partitions is the cluster's.
    parts_log2 = max(6, (int(n_tokens) >> 20).bit_length())
    spark = texts.sparkSession
    width = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    most = max(LEAST_LOG2, (width - 1).bit_length() + EACH_LOG2)
    partitions_log2 = min(most, max(LEAST_LOG2, (int(n_tokens) >> 20).bit_length()))
    deal = lambda df: df.repartition(1 << partitions_log2, "slot").sortWithinPartitions("p")
    dealt = deal(texts.select("text").mapInArrow(_deal_tokens(parts_log2, partitions_log2, hot), "slot int, p int, hot boolean, data binary"))
    shared = deal(dealt.mapInArrow(_count_shared(parts_log2, partitions_log2), "slot int, p int, data binary"))
    cands = shared.mapInArrow(_candidates, "sig long, n int, seed long, toks binary, pref binary")
    cands = written(cands, "candidates")
    release(texts.sparkSession)
    return info, cands, n_rows


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every link between distinct sets once: set_a > set_b, their sizes n_a and n_b, shared, and doc_a and doc_b, the smallest doc_id of each set.

    A row's number of links is the sum of the copies of the sets that its set
    links with, and its own set's other copies.
    """
    info, cands, _ = _sets(_texts(docs, id_col, text_col))
    met = _meetings(cands, cands.select("sig", "n", F.col("sig").alias("comp"), F.lit(1).alias("group_size")))
    if met is None:
        found = cands.select(F.col("sig").alias("a"), F.col("sig").alias("b"), F.lit(0).cast("long").alias("shared")).limit(0)
    else:
        # A node that meets its partners in several parts lists its own links in each.
        found = written(met.mapInArrow(_node_links, "a long, b long, shared long").distinct(), "links")
    sets = info.where("sig <> 0").groupBy("sig").agg(F.first("n").alias("n"), F.min("doc_id").alias("doc"))
    end = lambda k: sets.select(F.col("sig").alias(k), F.col("n").alias(f"n_{k}"), F.col("doc").alias(f"doc_{k}"))
    out = found.join(end("a"), "a").join(end("b"), "b")
    return out.select(F.col("a").alias("set_a"), F.col("b").alias("set_b"), "n_a", "n_b", "shared", "doc_a", "doc_b")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("key"))


def row_key(id_col: str, text_col: str) -> Column:
    """Tells rows with one id and different texts apart."""
    return F.xxhash64(id_col, text_col)


def sets_and_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest doc_id reachable by links), set_name."""
    return _components(_texts(docs, id_col, text_col)).select("doc_id", "n_shingles", F.col("least.doc_id").alias("component_id"), "set_name")


def _components(texts: DataFrame) -> DataFrame:
    """doc_id, key, n_shingles, set_name, and least: doc_id and key of the component's row with the smallest id."""
    info, cands, n_rows = _sets(texts)
    root = _links(cands)
    # Per set its rows, then per component its smallest id; each level is small against the one below.
    own = F.struct("doc_id", "key")
    sets = info.where("sig <> 0").groupBy("sig").agg(F.min(F.when(F.col("doc_id").isNotNull(), own)).alias("least"), F.count(F.lit(1)).alias("copies"))
    sets = written(sets.join(root, "sig", "left").withColumn("root", F.coalesce("root", "sig")), "sets")
    comps = written(sets.groupBy("root").agg(F.min("least").alias("least"), F.count(F.lit(1)).alias("group_size")), "components")
    named = written(attach_groups(sets.select("sig", "root", "copies"), comps, "root", n_rows).select("sig", "least", F.col("copies").alias("group_size")), "named")
    full = attach_groups(info.where("sig <> 0"), named, "sig", n_rows)
    out = ["doc_id", "key", F.col("n").alias("n_shingles"), "least", F.col("sig").alias("set_name")]
    return full.select(*out).unionByName(info.where("sig = 0").withColumn("least", own).select(*out))


def keep_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id. Rows without words all stay.

    Rows with a null id are in no group and stay. Of rows with the smallest id
    and different texts one stays; rows alike in id and text stay or go together.
    """
    found = _components(_texts(docs, id_col, text_col))
    gone = found.where(F.col("doc_id").isNotNull() & (F.struct("doc_id", "key") != F.col("least")))
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    away = (docs[id_col] == gone["_id"]) & (F.xxhash64(docs[id_col], docs[text_col]) == gone["_key"])
    return docs.join(gone, away, "left_anti")
