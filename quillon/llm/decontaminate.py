"""Benchmark decontamination: a prefix-filtered set join on item-sized windows.

A window is ``WINDOW`` consecutive words of a benchmark item (a whole shorter
item is one window). The tokens of a window are its word triples (pairs or
single words if it is shorter), each with its place. Exact containment allows
no missing token, so the necessary prefix of a window is one token: its rarest
one over all documents. A document token that equals some window's prefix token
proposes the window at one place only (positional bound: the token's place in
the window), if the window fits in the text there (length bound), and the words
of the window are then compared one by one: by hash first, then byte by byte.

Defined results: null and empty texts have no words and are not contaminated;
repeated items and windows are found once each under every item id; repeated
documents each get their row; items without words are never found; an empty
benchmark finds nothing; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.scratch import written
from quillon.llm.textnp import ALNUM, LOWER, blocks, gram_hashes, words

WINDOW = 10
#: Words of a token.
TOKEN = 3
#: Bytes of benchmark text that are gathered and broadcast at a time. A larger
#: benchmark is matched part by part, each part against all documents.
PART_BYTES = 16 << 20


class Windows:
    """The distinct windows of some items, and which items have each."""

    def __init__(self, items: list[tuple[object, str | None]]):
        texts = pa.array([t for _, t in items], pa.large_string())
        index: dict[bytes, int] = {}
        self.items: list[list[int]] = []
        self.ids = [i for i, _ in items]
        # The words of all items: hashes, and places in the lower-cased bytes. A window is a run of them.
        h_all, start_all, end_all, low_all, n_words, n_bytes = [], [], [], [], 0, 0
        begin, size = [], []
        for first, raw, offs in blocks(texts):
            h, at, start, end = words(raw, offs, ALNUM)
            low = LOWER[raw]
            plain = low.tobytes()
            bounds = np.searchsorted(at, np.arange(len(offs)))
            for k in range(len(offs) - 1):
                a, b = int(bounds[k]), int(bounds[k + 1])
                own = [plain[s:e] for s, e in zip(start[a:b].tolist(), end[a:b].tolist(), strict=True)]
                for s in range(max(1, len(own) - WINDOW + 1)) if own else ():
                    n = index.setdefault(b" ".join(own[s : s + WINDOW]), len(index))
                    if n == len(self.items):
                        self.items.append([])
                        begin.append(n_words + a + s)
                        size.append(min(WINDOW, len(own)))
                    if first + k not in self.items[n][-1:]:
                        self.items[n].append(first + k)
            for into, x in ((h_all, h), (start_all, start + n_bytes), (end_all, end + n_bytes), (low_all, low)):
                into.append(x)
            n_words, n_bytes = n_words + len(h), n_bytes + len(low)
        cat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        self.h, self.start, self.end, self.low = cat(h_all, np.uint64), cat(start_all, np.int64), cat(end_all, np.int64), cat(low_all, np.uint8)
        self.begin, self.size = np.array(begin, np.int64), np.array(size, np.int64)
        # Tokens: for windows of one size at a time, rows (token, window, place).
        tok, win, place = [], [], []
        for size in np.unique(self.size):
            rows = np.flatnonzero(self.size == size)
            t = min(TOKEN, int(size))
            for p in range(int(size) - t + 1):
                flat = self.h[self.begin[rows][:, None] + (p + np.arange(t))]
                tok.append(gram_hashes(flat.reshape(-1), t)[::t])
                win.append(rows)
                place.append(np.full(len(rows), p))
        self.tok, self.win, self.place = cat(tok, np.uint64), cat(win, np.int64), cat(place, np.int64)
        self.sizes = sorted({min(TOKEN, int(s)) for s in self.size})

    def choose(self, counts: dict[int, int]) -> None:
        """Keep the rarest token of each window; ties by hash, then place."""
        rare = np.array([counts.get(t, 0) for t in self.tok.view(np.int64).tolist()], np.int64)
        order = np.lexsort((self.place, self.tok, rare, self.win))
        order = order[np.unique(self.win[order], return_index=True)[1]]
        order = order[np.argsort(self.tok[order], kind="stable")]
        self.tok, self.win, self.place = self.tok[order], self.win[order], self.place[order]

    def same(self, win: np.ndarray, at: np.ndarray, h: np.ndarray, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which of the windows stand at words ``at`` of a block: all words by hash, and for those that agree by their bytes."""
        good = np.ones(len(win), bool)
        for p in range(WINDOW):
            k = np.flatnonzero(good & (p < self.size[win]))
            good[k] = h[at[k] + p] == self.h[self.begin[win[k]] + p]
        for p in range(WINDOW):
            k = np.flatnonzero(good & (p < self.size[win]))
            if not len(k):
                break
            x, y = at[k] + p, self.begin[win[k]] + p
            n = end[x] - start[x]
            equal = n == self.end[y] - self.start[y]
            good[k[~equal]] = False
            k, x, y, n = k[equal], x[equal], y[equal], n[equal]
            if len(k):
                first = np.cumsum(n) - n
                inner = np.arange(int(n.sum())) - np.repeat(first, n)
                differ = low[np.repeat(start[x], n) + inner] != self.low[np.repeat(self.start[y], n) + inner]
                good[k] = ~np.logical_or.reduceat(differ, first)
        return good

    def sieve(self) -> np.ndarray:
        """By the low bits of a hash: whether any token has them."""
        bits = np.zeros(1 << 18, bool)
        bits[(self.tok & np.uint64(len(bits) - 1)).astype(np.int64)] = True
        return bits


def _token_hits(windows: Windows, sieve: np.ndarray, h: np.ndarray, at: np.ndarray, tokens: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words of the token, positions in h, their token): the places where one of the sorted ``tokens`` stands within one text."""
    for t in windows.sizes:
        g = gram_hashes(h, t)
        pos = np.flatnonzero(sieve[(g & np.uint64(len(sieve) - 1)).astype(np.int64)])
        pos = pos[at[pos] == at[pos + t - 1]]
        k = np.minimum(np.searchsorted(tokens, g[pos]), len(tokens) - 1)
        good = tokens[k] == g[pos]
        yield t, pos[good], g[pos][good]


def _count_tokens(windows: Windows):
    tokens, sieve = np.unique(windows.tok), windows.sieve()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(tokens), np.int64)
        for batch in batches:
            for _, raw, offs in blocks(batch.column(0)):
                h, at, _, _ = words(raw, offs, ALNUM)
                for _, _, g in _token_hits(windows, sieve, h, at, tokens):
                    total += np.bincount(np.searchsorted(tokens, g), minlength=len(tokens))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(tokens[some].view(np.int64)), pa.array(total[some])], ["token", "n"])

    return run


def match_block(windows: Windows, sieve: np.ndarray, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per text its word count; per occurrence (text, first word within all words, window); the words' (text, start, end)."""
    h, at, start, end = words(raw, offs, ALNUM)
    n = len(offs) - 1
    count = np.bincount(at, minlength=n)
    first = np.concatenate(([0], np.cumsum(count)))
    found_at, found_win = [], []
    for t, pos, g in _token_hits(windows, sieve, h, at, windows.tok):
        lo, hi = np.searchsorted(windows.tok, g), np.searchsorted(windows.tok, g, "right")
        each = hi - lo
        pos = np.repeat(pos, each)
        k = np.repeat(lo - np.concatenate(([0], np.cumsum(each)[:-1])), each) + np.arange(each.sum()) if len(each) else np.zeros(0, np.int64)
        win, begin = windows.win[k], pos - windows.place[k]
        size = windows.size[win]
        text = at[pos]
        fits = (np.minimum(size, TOKEN) == t) & (begin >= first[text]) & (begin + size <= first[text + 1])
        win, begin = win[fits], begin[fits]
        same = windows.same(win, begin, h, LOWER[raw], start, end) if len(win) else np.zeros(0, bool)
        found_at.append(begin[same])
        found_win.append(win[same])
    begin, win = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_at, found_win))
    return count, at[begin] if len(begin) else begin, begin, win, first, (at, start, end)


def _scan(windows: Windows):
    sieve = windows.sieve()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, raw, offs in blocks(batch.column(1)):
                n = len(offs) - 1
                count, text, begin, win, first, _ = match_block(windows, sieve, raw, offs)
                edge = np.zeros(first[-1] + 1, np.int64)
                np.add.at(edge, begin, 1)
                np.add.at(edge, begin + windows.size[win], -1)
                hit = np.concatenate(([0], np.cumsum(np.cumsum(edge)[:-1] > 0)))
                items: list[list[int]] = [[] for _ in range(n)]
                for d, w in set(zip(text.tolist(), win.tolist(), strict=True)):
                    items[d] += windows.items[w]
                named = [sorted({str(windows.ids[i]) for i in own if windows.ids[i] is not None}) for own in items]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, n), pa.array(count, pa.int64()), pa.array(hit[first[1:]] - hit[first[:-1]], pa.int64()),
                     pa.array(named, pa.list_(pa.string()))],
                    ["doc_id", "n_words", "n_hit", "items"],
                )

    return run


def _parts(benchmark: DataFrame, item_col: str, item_text: str) -> list[DataFrame]:
    """The benchmark in parts of about PART_BYTES of text, after its size is checked."""
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // PART_BYTES))
    return [items] if n == 1 else [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def load_windows(texts: DataFrame, items: DataFrame) -> Windows:
    """The windows of one part, each with its rarest token over all documents as prefix."""
    windows = Windows([(r[0], r[1]) for r in items.collect()])
    if len(windows.tok):
        counts = texts.mapInArrow(_count_tokens(windows), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
        windows.choose({r[0]: r[1] for r in counts.collect()})  # at most one row a benchmark token
    return windows


def _occurrences(windows: Windows):
    """(d, begin, size, items) of every window found; rows: d, text."""
    sieve = windows.sieve()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            for row, raw, offs in blocks(batch.column(1)):
                _, text, begin, win, first, _ = match_block(windows, sieve, raw, offs)
                named = [[str(windows.ids[i]) for i in windows.items[w] if windows.ids[i] is not None] for w in win.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[row + text]), pa.array(begin - first[text], pa.int64()), pa.array(windows.size[win], pa.int64()), pa.array(named, pa.list_(pa.string()))],
                    ["d", "begin", "size", "items"],
                )

    return run


def _found_by_parts(texts: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """Occurrences of a benchmark that is too large to broadcast: part after part, each written before the next is loaded."""
    out = None
    for items in parts:
        windows = load_windows(texts.select("text"), items)
        if len(windows.tok):
            hits = written(texts.mapInArrow(_occurrences(windows), "d long, begin long, size long, items array<string>"), "benchmark-hits")
            out = hits if out is None else out.unionByName(hits)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_hit, items (sorted array of the ids, as strings, of items with occurring windows)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_hit long, items array<string>"
    parts = _parts(benchmark, item_col, item_text)
    if len(parts) == 1:
        return rows.mapInArrow(_scan(load_windows(rows.select("text"), parts[0])), schema)
    # Equal rows share a key and all that is found for them.
    keyed = rows.select(F.xxhash64("doc_id", "text").alias("d"), "doc_id", "text")
    plain = keyed.select(F.struct("d", "doc_id").alias("doc_id"), "text")
    counts = plain.mapInArrow(_scan(Windows([])), f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, n_words long, n_hit long, items array<string>").select("doc_id.d", "doc_id.doc_id", "n_words")
    found = _found_by_parts(keyed.select("d", "text"), parts)
    if found is None:
        return counts.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    # Words hit: spans in order, each adding what reaches beyond those before.
    spans = F.array_sort(F.collect_set(F.struct("begin", (F.col("begin") + F.col("size")).alias("end"))))
    zero = F.struct(F.lit(0).cast("long").alias("to"), F.lit(0).cast("long").alias("n"))
    total = F.aggregate(spans, zero, lambda a, s: F.struct(F.greatest(a["to"], s["end"]).alias("to"), (a["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(a["to"], s["begin"]))).alias("n")), lambda a: a["n"])
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_set("items"))))
    hits = found.groupBy("d").agg(total.alias("n_hit"), names.alias("items"))
    none = F.array().cast("array<string>")
    return counts.join(hits, "d", "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from ``contamination``."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the contaminated rows, all columns as they are."""
    parts, texts = _parts(benchmark, item_col, item_text), docs.select(F.col(text_col).alias("text"))
    if len(parts) > 1:
        found = _found_by_parts(texts.select(F.xxhash64("text").alias("d"), "text"), parts)
        if found is None:
            return docs
        keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.xxhash64(text_col).alias("d"))
        return keyed.join(found.select("d").distinct(), "d", "left_anti").select("row.*")
    windows = load_windows(texts, parts[0])
    if not len(windows.tok):
        return docs
    sieve, at = windows.sieve(), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(len(batch), bool)
            for row, raw, offs in blocks(batch.column(at)):
                keep[row + match_block(windows, sieve, raw, offs)[1]] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
