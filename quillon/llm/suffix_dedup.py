"""Suffix-array dedup: bytes covered by a string of MIN bytes that also starts elsewhere.

Repeated strings are found on a Burrows-Wheeler transform by breadth-first
backward extension. Intervals of all strings of length l are extended to the
left; a right end whose common prefix isn't known yet gets the value l, and only
such intervals go on. Values come in increasing order, so the search stops at
MIN: neighbours in the suffix array without a value share MIN bytes or more.

One transform over a whole corpus fits no machine. So each window of MIN bytes
is given to the leftmost smallest GRAM-byte hash in it (its anchor). Equal
windows have equal anchors, so they meet when text is dealt by anchor:

1. Each document is cut into *pieces*, the runs of windows with one anchor
   place. A window is in one piece; windows of one piece differ from each other.
2. Pieces of an anchor that are equal need no search: all their windows repeat.
   Equal are those whose anchor and content have equal 64-bit hashes (two others
   pass for equal by that chance only, and no structure of a text raises it).
   Those met in one task are settled there, and one of them goes on as their
   deputy, so a crowded passage is a row a task. Anchors with a large share of
   all pieces are dealt by content as well.
3. An anchor with different pieces sends one of each to a task, which makes the
   transform of many anchors' pieces at a time and searches it.
4. An anchor with very many different pieces (a passage of near copies) is not
   sent: its pieces are cut again by longer anchors, and go through 1 to 3.

Defined results: null text is no bytes; matches never cross documents; equal
rows are documents of their own and repeat each other; documents under MIN bytes
are kept whole; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.scratch import release, written
from quillon.llm.textnp import _VALUE, blocks, mix, powers, run_hashes

MIN = 200
GRAM = 48
#: Bytes of the anchors that a crowded anchor's windows are dealt by again, level by level. Windows that differ
#: within such a length no longer meet, and at MIN bytes only equal ones do.
GRAMS = (GRAM, 112, 160, MIN)
#: Different pieces from which on an anchor is crowded.
CROWD = 2000
#: An anchor is hot from about this share of all pieces on; so at most 1/share of them are broadcast.
HOT_SHARE = 1 / 4096
#: Bytes whose transform is made at once.
BATCH = 1 << 20
#: Bytes of text whose pieces a task settles among themselves.
SETTLE = 48 << 20
#: A block's places fit in so many bits; longer texts are cut in segments.
PLACE_BITS = 24
SEGMENT = 8 << 20
_BASE = 0xC2B2AE3D27D4EB4F


# --- pieces ---------------------------------------------------------------------------------


def pieces(raw: np.ndarray, offs: np.ndarray, gram: int = GRAM, min_len: int = MIN) -> tuple[np.ndarray, ...]:
    """(text, first window, end of windows, anchor, content hash) of every piece of a block; places count from the text's start."""
    n, wide = len(raw), min_len - gram + 1
    none = np.zeros(0, np.int64)
    if n < min_len:
        return none, none, none, none, none
    base = _BASE if gram == GRAM else _BASE + 2 * gram
    inverse = powers(pow(base, -1, 1 << 64), n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[raw] * powers(base, n + 1)[:n], out=total[1:])
    h = mix((total[gram:] - total[:-gram]) * inverse[: n - gram + 1])
    key = (h & ~np.uint64((1 << PLACE_BITS) - 1)) | np.arange(len(h), dtype=np.uint64)
    # Sliding minimum from running minima of blocks, forwards and backwards.
    rows = -(-len(key) // wide)
    padded = np.full(rows * wide, np.iinfo(np.uint64).max)
    padded[: len(key)] = key
    grid = padded.reshape(rows, wide)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    starts = n - min_len + 1
    anchor = (np.minimum(back[:starts], ahead[wide - 1 : wide - 1 + starts]) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    inside = np.ones(starts, bool)  # windows that cross no text's end
    for e in offs[1:-1].tolist():
        inside[max(0, e - min_len + 1) : e] = False
    change = np.ones(starts, bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    lo = np.flatnonzero(change & inside)
    if not len(lo):
        return none, none, none, none, none
    stop = np.ones(starts, bool)
    stop[:-1] = change[1:] | ~inside[1:]
    hi = np.flatnonzero(stop & inside) + 1
    end = hi + min_len - 1
    content = run_hashes(raw, lo, end)
    text = np.searchsorted(offs, lo, "right") - 1
    return text, lo - offs[text], hi - offs[text], h[anchor[lo]].view(np.int64), content.view(np.int64)


def _segments(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row of each text, its first byte, bytes, offsets): blocks, with long texts in overlapping segments."""
    for row, raw, offs in blocks(column):
        if len(raw) <= SEGMENT:
            yield np.arange(row, row + len(offs) - 1), np.zeros(len(offs) - 1, np.int64), raw, offs
        else:
            for s in range(0, len(raw) - MIN + 1, SEGMENT):
                part = raw[s : s + SEGMENT + MIN - 1]
                yield np.array([row]), np.array([s]), part, np.array([0, len(part)])


def _merge(d: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching spans of a document made one."""
    if not len(d):
        return d, lo, hi
    order = np.lexsort((lo, d))
    d, lo, hi = d[order], lo[order], hi[order]
    new = np.concatenate(([True], d[1:] != d[:-1]))
    # Running end within a document: lift each document above the last one's ends.
    lift = (np.cumsum(new) - 1) * (int(hi.max()) + 2)
    top = np.maximum.accumulate(hi + lift) - lift
    new[1:] |= lo[1:] > top[:-1]
    at = np.flatnonzero(new)
    return d[at], lo[at], np.append(top[at[1:] - 1], top[-1])


#: d and src name the text that a piece is in: a document, or at later levels the piece of it that begins at src.
_ROW = "kind byte, a long, c long, d long, src int, lo int, hi int, many boolean"


def _rows(kind, a, c, d, src, lo, hi, many) -> pa.RecordBatch:
    ints = [pa.array(x, pa.int32()) for x in (src, lo, hi)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(d), kind, np.int8)), pa.array(a), pa.array(c), pa.array(d), *ints, pa.array(many)], ["kind", "a", "c", "d", "src", "lo", "hi", "many"])


def _covered(d, lo, hi) -> pa.RecordBatch:
    d, lo, hi = _merge(d, lo, hi)
    zero = np.zeros(len(d), np.int64)
    return _rows(1, zero, zero, d, zero, lo, hi, zero.astype(bool))


def _settle(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """Covered spans (kind 1) of pieces met twice, one row a distinct piece (kind 0; many: settled already), and the anchors with a large share of these (kind 3; d: how many)."""
    d, src, lo, hi, a, c, many = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((c, a))
    d, src, lo, hi, a, c, many = (x[order] for x in (d, src, lo, hi, a, c, many))
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(a)))
    some = np.logical_or.reduceat(many, first) | (size > 1)
    twice = np.repeat(some, size)
    if twice.any():
        yield _covered(d[twice], lo[twice], hi[twice] + MIN - 1)
    yield _rows(0, a[first], c[first], d[first], src[first], lo[first], hi[first], some)
    heads = np.flatnonzero(np.concatenate(([True], a[first[1:]] != a[first[:-1]])))
    count = np.diff(np.append(heads, len(first)))
    large = count >= max(2.0, len(first) * HOT_SHARE)
    zero = np.zeros(int(large.sum()), np.int64)
    yield _rows(3, a[first[heads[large]]], zero, count[large], zero, zero, zero, zero.astype(bool))


def _cut(gram: int):
    """Pieces of texts (d, src, text, many) by anchors of ``gram`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            key, src, many = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("d", "src", "many"))
            for rows, begin, raw, offs in _segments(batch.column("text")):
                text, lo, hi, a, c = pieces(raw, offs, gram)
                if len(text):
                    row = rows[text]
                    move = begin[text] + src[row]
                    held.append((key[row], src[row], (lo + move).astype(np.int32), (hi + move).astype(np.int32), a, c, many[row]))
                size += len(raw)
                if size > SETTLE and held:
                    yield from _settle(held)
                    held, size = [], 0
        if held:
            yield from _settle(held)

    return run


def _compare(batches: Iterator[pa.RecordBatch], hot: tuple[int, ...] = ()) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by anchor and content: covered spans of equal pieces (kind 1), and of anchors with several pieces each of them (kind 2; many: settled already).

    A hot anchor's pieces are dealt over tasks by content, so all of them are sent.

    Between batches only the rows of the last piece are held, and of the last anchor
    its first piece, which is sent once a second one turns up.
    """
    state: dict = {"a": None, "first": None}
    hot_anchors = np.array(hot, np.int64)

    def settle(a, c, d, src, lo, hi, many):
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(a)))
        twice = np.add.reduceat(1 + many.astype(np.int64), first) >= 2
        rows = np.repeat(twice, size)
        if rows.any():
            yield _covered(d[rows], lo[rows], hi[rows] + MIN - 1)
        # One row a piece from here on; the anchor that was open goes in front if its first piece still waits.
        part = [x[first] for x in (a, c, d, src, lo, hi)] + [twice]
        if state["a"] == part[0][0] and state["first"] is not None:
            part = [np.concatenate(([f], x)).astype(x.dtype) for f, x in zip(state["first"], part, strict=True)]
        known = state["a"] == part[0][0] and state["first"] is None  # several pieces seen before
        heads = np.flatnonzero(np.concatenate(([True], part[0][1:] != part[0][:-1])))
        count = np.diff(np.append(heads, len(part[0])))
        mixed = (count >= 2) | np.isin(part[0][heads], hot_anchors)
        mixed[0] |= known
        send = np.repeat(mixed, count)
        if send.any():
            yield _rows(2, *(x[send] for x in part))
        state["a"] = part[0][-1]
        state["first"] = None if mixed[-1] else [x[-1] for x in part]

    carry = None
    for batch in batches:
        if not len(batch):
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in ("a", "c", "d", "src", "lo", "hi", "many")]
        if carry is not None:
            cols = [np.concatenate((x, y)) for x, y in zip(carry, cols, strict=True)]
        change = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]))
        last = int(change[-1]) + 1 if len(change) else 0
        if last:
            yield from settle(*(x[:last] for x in cols))
        carry = [x[last:] for x in cols]
    if carry is not None and len(carry[0]):
        yield from settle(*carry)


# --- the transform ------------------------------------------------------------------------------


def suffix_order(t: np.ndarray, end: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by their first ``depth`` symbols or more, by prefix doubling; each ends at ``end``. Also the inverse."""
    n = len(t)
    key, place = np.zeros(n, np.uint64), np.arange(n)
    for k in range(6):
        at = np.minimum(place + k, n - 1)
        key = (key << np.uint64(9)) | np.where(place + k <= end, t[at], 0).astype(np.uint64)
    h = 6
    while True:
        order = np.argsort(key)
        new = np.ones(n, bool)
        sorted_key = key[order]
        new[1:] = sorted_key[1:] != sorted_key[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if h >= depth or new.all():
            break
        beyond = place + h
        key = (rank.astype(np.uint64) << np.uint64(32)) | np.where(beyond <= end, rank[np.minimum(beyond, n - 1)], 0).astype(np.uint64)
        h *= 2
    inverse = np.empty(n, np.int64)
    inverse[order] = place
    return order, inverse


def shared_neighbours(bwt: np.ndarray, lf: np.ndarray, head: np.ndarray, depth: int) -> np.ndarray:
    """For each place in the suffix array, whether it shares ``depth`` symbols with the one before.

    bwt: symbol before each suffix, 0 where a piece starts. lf: place of the suffix
    one longer. head: first symbol of each suffix.
    """
    n = len(bwt)
    known = np.zeros(n + 1, bool)
    edge = np.flatnonzero(np.concatenate(([True], head[1:] != head[:-1])))
    lo, hi = edge, np.append(edge[1:], n)
    known[edge] = known[n] = True
    owner = np.zeros(n, np.int32)
    for _ in range(1, depth):
        if not len(lo):
            break
        size = hi - lo
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        who = np.repeat(np.arange(len(lo), dtype=np.int32), size)
        real = bwt[at] != 0
        to = lf[at[real]]
        owner[to] = who[real]
        to.sort()
        if not len(to):
            break
        cut = np.ones(len(to), bool)
        cut[1:] = (to[1:] != to[:-1] + 1) | (owner[to[1:]] != owner[to[:-1]]) | (head[to[1:]] != head[to[:-1]])
        first = np.flatnonzero(cut)
        lo, hi = to[first], to[np.append(first[1:], len(to)) - 1] + 1
        fresh = ~known[hi]
        lo, hi = lo[fresh], hi[fresh]
        known[hi] = True
    return ~known[:n]


def repeated(bodies: list[bytes], depth: int = MIN) -> list[np.ndarray]:
    """Per body, the places where a string of ``depth`` bytes starts that starts at another place too, in this or another body."""
    size = np.array([len(b) for b in bodies], np.int64)
    stop = np.cumsum(size + 1) - 1
    t = np.zeros(int(stop[-1]) + 1, np.int64)
    flat = np.frombuffer(b"".join(bodies), np.uint8)
    inner = np.arange(len(flat)) + np.repeat(np.arange(len(bodies)), size)
    t[inner] = flat.astype(np.int64) + 1
    end = np.repeat(stop, size + 1)
    order, inverse = suffix_order(t, end, depth)
    before = order - 1
    bwt = np.where(before >= 0, t[before], 0)
    same = shared_neighbours(bwt, inverse[before], t[order], depth)
    hit = same.copy()
    hit[:-1] |= same[1:]
    at = np.sort(order[hit & (end[order] - order >= depth)])
    body = np.searchsorted(stop, at)
    base = stop - size
    cut = np.searchsorted(body, np.arange(len(bodies) + 1))
    return [at[cut[k] : cut[k + 1]] - base[k] for k in range(len(bodies))]


_BODY = "a long, d long, lo int, many boolean, body binary"


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces without those that this task has let through: equal rows bring equal pieces, of which one a task goes on."""
    seen: set[tuple[int, int, int]] = set()
    for batch in batches:
        keys = zip(*(batch.column(k).to_pylist() for k in ("a", "d", "lo")), strict=True)
        new = [k not in seen and not seen.add(k) for k in keys]
        yield batch if all(new) else batch.filter(pa.array(new))


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Covered spans of pieces that aren't settled; rows come sorted by anchor."""

    def out(group):
        found = repeated([b for _, _, _, b in group])
        d, lo = [], []
        for (key, begin, many, _), at in zip(group, found, strict=True):
            if not many and len(at):
                lo.append(at + begin)
                d.append(np.full(len(at), key))
        if d:
            lo = np.concatenate(lo)
            yield _covered(np.concatenate(d), lo, lo + MIN)

    held, size, anchor, seen = [], 0, None, set()
    for batch in batches:
        for a, d, lo, many, body in zip(*(batch.column(k).to_pylist() for k in ("a", "d", "lo", "many", "body")), strict=True):
            if a != anchor and size > BATCH:  # an anchor's pieces stay together: at most CROWD of them
                yield from out(held)
                held, size = [], 0
            if a != anchor:
                seen = set()
            anchor = a
            if (d, lo) in seen:
                continue
            seen.add((d, lo))
            held.append((d, lo, many, body))
            size += len(body)
    if held:
        yield from out(held)


# --- the operator ------------------------------------------------------------------------------------


def _dealt(cut: DataFrame) -> DataFrame:
    """``_compare`` over all distinct pieces of ``cut``, dealt by anchor, and those of hot anchors by content too.

    A task reports the anchors that hold ``HOT_SHARE`` of its own pieces. One that
    holds twice that share of all pieces is reported for at least half of that, so
    the sums of the reports find it, and at most 1 / HOT_SHARE anchors pass.
    """
    pieces_ = cut.where("kind = 0")
    bar = max(2.0, pieces_.count() * HOT_SHARE)
    hot = cut.where("kind = 3").groupBy("a").agg(F.sum("d").alias("n")).where(F.col("n") >= bar).select("a")
    known = tuple(r[0] for r in hot.collect())  # at most 1 / HOT_SHARE rows
    split = F.broadcast(cut.sparkSession.createDataFrame([(x,) for x in known], "a long").withColumn("by_content", F.lit(True)))
    rows = pieces_.drop("kind").join(split, "a", "left").withColumn("salt", F.when(F.col("by_content"), F.col("c")).otherwise(0)).drop("by_content")
    return rows.repartition("a", "salt").drop("salt").sortWithinPartitions("a", "c").mapInArrow(partial(_compare, hot=known), _ROW)


def covered_spans(texts: DataFrame) -> DataFrame:
    """(d, lo, hi): spans of bytes to remove, by document key; they may overlap. ``texts``: d, text."""
    found: list[DataFrame] = []
    source = texts.select("d", F.lit(0).alias("src"), "text", F.lit(False).alias("many"))
    for gram in GRAMS:
        cut = written(source.mapInArrow(_cut(gram), _ROW), "pieces")
        met = written(_dealt(cut), "pieces-met")
        differ = met.where("kind = 2")
        crowded = written(differ.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD).select("a"), "crowded")
        more = gram < MIN and not crowded.isEmpty()
        # The bytes of the pieces: the texts meet them once a level, and later levels' texts are pieces themselves.
        wanted = differ.groupBy("d", "src").agg(F.collect_list(F.struct("a", "lo", "hi", "many")).alias("want"))
        body = F.expr(f"substring(cast(text AS binary), lo - src + 1, hi - lo + {MIN - 1})")
        bodies = source.select("d", "src", "text").join(wanted, ["d", "src"]).select("d", "src", "text", F.inline("want")).select("a", "d", "lo", "many", body.alias("body"))
        # Rows that are alike have one key, and so the same pieces: they go on once a task, not once a row.
        bodies = bodies.mapInArrow(_once, _BODY)
        if more:
            bodies = written(bodies, "bodies")
        few = bodies.join(crowded, "a", "left_anti") if more else bodies
        searched = written(few.repartition("a").sortWithinPartitions("a").mapInArrow(_search, _ROW), "pieces-searched")
        found += [cut, met, searched]
        if not more:
            break
        source = bodies.join(crowded, "a", "left_semi").select("d", F.col("lo").alias("src"), F.col("body").alias("text"), "many")
    release(texts.sparkSession)
    parts = [x.where("kind = 1").select("d", "lo", "hi") for x in found]
    return reduce(DataFrame.unionByName, parts)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols = ([], [], [], [])
        gone = batch.column("gone").to_pylist()
        for row, raw, offs in blocks(batch.column("text")):
            for k in range(len(offs) - 1):
                own = raw[offs[k] : offs[k + 1]]
                at = gone[row + k] or []
                lo, hi = (np.array([x[f] for x in at], np.int64) for f in ("lo", "hi"))
                _, lo, hi = _merge(np.zeros(len(lo), np.int64), lo, hi)
                if len(lo):
                    edge = np.concatenate(([0], np.stack((lo, hi), 1).reshape(-1), [len(own)]))
                    kept = b"".join(own[a:b].tobytes() for a, b in zip(edge[::2], edge[1::2], strict=True))
                else:
                    kept = own.tobytes()
                for col, x in zip(cols, (len(own), int((hi - lo).sum()), [{"lo": int(a), "hi": int(b)} for a, b in zip(lo, hi, strict=True)], kept), strict=True):
                    col.append(x)
        span = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), span, pa.binary()), strict=True))], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, spans (lo, hi of maximal removed runs), kept (the remaining bytes)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Equal rows share a key; each of them counts where pieces are met, and gets the same spans.
    rows = rows.select(F.xxhash64("doc_id", "text").alias("d"), "doc_id", "text")
    spans = covered_spans(rows.select("d", "text"))
    gone = spans.groupBy("d").agg(F.collect_set(F.struct("lo", "hi")).alias("gone"))
    both = rows.join(gone, "d", "left").select("doc_id", "text", "gone")
    kind = both.schema["doc_id"].dataType.simpleString()
    return both.mapInArrow(_remove, f"doc_id {kind}, n_bytes long, n_removed long, spans array<struct<lo:int,hi:int>>, kept binary")


def digest(removed: DataFrame) -> DataFrame:
    """The contract's columns."""
    return removed.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
