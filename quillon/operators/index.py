"""An inverted index that outlives a query: postings written by term, searched with block maxima, changed in increments.

Tables (of a ``Store``, so every change is one commit):

``postings``  bucket, term, slot: a row holds a term's postings in a slot (doc; tf, len and positions as four bytes a number),
              what the best of them can be at most (n, max_tf, min_len), and the documents that begin with the term (first);
              in folders by bucket (a hash of the term), sorted by term and slot
``blocks``    slot, n, words: what a slot holds
``lengths``   doc, len of every document added
``removed``   doc, upto: postings of the document in segments up to that number are dead

A document's slot is a hash of its id, alike for all terms of a segment, so the
bounds of a query's terms add up slot by slot. A search reads the bounds of its
terms (folders of their buckets, pages of their names, none of their postings),
scores the most promising slots to learn what the k-th best score is at least, then
reads only slots whose bound reaches it. Results equal those of scoring everything.
Texts are shuffled by slot and cut there, so that the shuffle by term carries a row
for each term of a slot, not for each posting. A slot of many texts is cut in
pieces: a term then has several rows in it, and the sum of their bounds is one too.

A replaced document is a new one whose older postings are dead; the number of
documents and words is kept in the manifest, and a term's document frequency is
the sum of its slots, less its dead postings. ``merge`` rewrites all segments as
one without dead postings.

Defined results: null texts and texts without words aren't indexed; of rows that
share an id in one batch, the one with the largest text counts; adding a known id
replaces it; deleting an unknown one does nothing; an empty index, and a query
without terms, give no rows; ties by id.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import index_tokens
from quillon.operators.search import B, K1
from quillon.session import tasks_for
from quillon.sources.lease import Lease
from quillon.sources.versions import Store

#: Ways to cut a text into terms, by the name that an index keeps.
TOKENS: dict[str, Callable[[Column], Column]] = {
    "folded": index_tokens,
    "letters": lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0)),
}
#: The same as texts, with the bytes that words are made of: a batch's words are found at once.
CUTS: dict[str, tuple[Callable[[Column], Column], Callable[[np.ndarray], np.ndarray]]] = {
    "folded": (lambda c: F.array_join(index_tokens(c), " "), lambda byte: byte != ord(" ")),
    "letters": (F.lower, lambda byte: (byte >= ord("a")) & (byte <= ord("z"))),
}
BUCKETS = 64
#: Documents of a slot on average, and slots of a segment at most.
SLOT, MOST_SLOTS = 1024, 1 << 20
#: Slots whose texts a task cuts, and bytes of texts that it cuts at once.
SLOTS, BYTES = 8, 1 << 24
#: Tasks that a bucket's postings are dealt to, by slot: no task gets all of a frequent term.
SPREAD = 8
#: Slots that the first round scores for each result wanted, and slots that are named in a filter at most.
FIRST, NAMED = 4, 2000


def _hash(spark: SparkSession, terms: list[str], buckets: int) -> list[int]:
    if not terms:
        return []
    return list(spark.range(1).select(*[F.pmod(F.xxhash64(F.lit(t)), F.lit(buckets)).cast("int") for t in terms]).first())


def _lists(first: np.ndarray, values: pa.Array) -> pa.ListArray:
    """Lists of ``values`` that begin at ``first``."""
    return pa.ListArray.from_arrays(pa.array(np.r_[first, len(values)].astype(np.int32)), values)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it; the first does."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _numbers(first: np.ndarray, values: np.ndarray) -> pa.Array:
    """Binaries of the numbers that begin at ``first``, four bytes each."""
    ends = np.r_[first, len(values)].astype(np.int32) * 4
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values, "<i4"))])


def _rows(code: np.ndarray, terms: pa.Array, slot: np.ndarray, doc: pa.Array, size: np.ndarray, at: np.ndarray, position: np.ndarray) -> pa.RecordBatch:
    """A row for each term and slot of some postings that are sorted by them and document; the positions of each begin ``at``."""
    tf, term = np.diff(np.r_[at, len(position)]), _changes(code, slot)
    begins = np.flatnonzero(position[at] == 0)
    columns = {
        "term": terms.take(pa.array(code[term])), "slot": pa.array(slot[term].astype(np.int32)), "n": pa.array(np.diff(np.r_[term, len(code)])),
        "max_tf": pa.array(np.maximum.reduceat(tf, term).astype(np.int32)), "min_len": pa.array(np.minimum.reduceat(size, term).astype(np.int64)),
        "doc": _lists(term, doc), "tf": _numbers(term, tf), "len": _numbers(term, size), "positions": _numbers(at[term], position),
        "first": _lists(np.searchsorted(begins, term), pa.StructArray.from_arrays([doc.take(pa.array(begins)), pa.array(size[begins].astype(np.int64))], ["doc", "len"])),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _row_type(kind: str) -> str:
    return f"term string, slot int, n long, max_tf int, min_len long, doc array<{kind}>, tf binary, len binary, positions binary, first array<struct<doc: {kind}, len: bigint>>"


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows as single postings; ``positions`` only if they are given."""
    for batch in batches:
        numbers = lambda name: np.frombuffer(b"".join(batch.column(name).to_pylist()), "<i4")  # noqa: B023, E731
        own = pa.array(np.repeat(np.arange(len(batch)), batch.column("doc").value_lengths().to_numpy()))
        tf = numbers("tf")
        columns = {c: batch.column(c).take(own) for c in ("bucket", "term", "slot", "seq")}
        columns |= {"doc": batch.column("doc").flatten(), "tf": pa.array(tf), "len": pa.array(numbers("len").astype(np.int64))}
        if "positions" in batch.schema.names:
            columns["positions"] = _lists(np.cumsum(tf) - tf, pa.array(numbers("positions")))
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _cut(piece: list[pa.RecordBatch], letters: np.ndarray) -> pa.RecordBatch | None:
    """The rows of a piece of one slot (slot, doc, text), by document."""
    column = lambda name: pa.concat_arrays([b.column(name) for b in piece])
    texts = column("text").cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    inside = letters[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    # A text's first byte begins a word whatever the text before ends with.
    heads = bounds[:-1][np.diff(bounds) > 0]
    begin[heads] = inside[heads]
    starts = np.flatnonzero(begin)
    if not len(starts):
        return None
    upto = np.searchsorted(starts, bounds)
    sizes = np.diff(upto)
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    kept = data[inside]
    ends = np.r_[np.flatnonzero(begin[inside]), len(kept)].astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(kept)).dictionary_encode()
    # One sort of numbers by term, then by the word's place.
    bits = len(starts).bit_length()
    key = (words.indices.to_numpy().astype(np.int64) << bits) | np.arange(len(starts))
    key.sort()
    word, code = key & ((1 << bits) - 1), key >> bits
    own = row[word]
    at = _changes(code, own)
    own, position = own[at], word - upto[own]
    doc = column("doc").take(pa.array(own))
    return _rows(code[at], words.dictionary, column("slot").to_numpy()[own], doc, sizes[own], at, position)


def _pieces(letters: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, slot, held = [], None, 0
        for batch in batches:
            slots, size = batch.column("slot").to_numpy(), pc.binary_length(batch.column("text")).to_numpy().astype(np.int64)
            upto = np.r_[0, np.cumsum(size)]
            ends = np.r_[_changes(slots)[1:], len(batch)]
            at = 0
            for end in ends.tolist():
                while at < end:
                    if piece and (slots[at] != slot or held >= BYTES):
                        if (out := _cut(piece, letters)) is not None:
                            yield out
                        piece, held = [], 0
                    to = min(end, max(at + 1, int(np.searchsorted(upto, upto[at] + BYTES - held, side="right")) - 1))
                    piece.append(batch.slice(at, to - at))
                    slot, held, at = slots[at], held + int(upto[to] - upto[at]), to
        if piece and (out := _cut(piece, letters)) is not None:
            yield out

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Single postings (term, slot, doc, tf, len, positions), sorted by term, slot and document, as rows."""
    for batch in batches:
        if len(batch):
            words, tf = batch.column("term").dictionary_encode(), batch.column("tf").to_numpy().astype(np.int64)
            slot, size = batch.column("slot").to_numpy(), batch.column("len").to_numpy()
            yield _rows(words.indices.to_numpy(), words.dictionary, slot, batch.column("doc"), size, np.cumsum(tf) - tf, batch.column("positions").flatten().to_numpy())


class TextIndex:
    """The index below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)

    @classmethod
    def create(cls, spark: SparkSession, root: str, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens: str = "folded", buckets: int = BUCKETS) -> TextIndex:
        """A new index of ``docs``."""
        own = cls(spark, root)
        if own.store.version():
            raise FileExistsError(root)
        kind = docs.schema[id_col].dataType.simpleString()
        none = spark.createDataFrame([], f"doc {kind}, len long, seq int")
        own.store.commit(
            replace={
                "postings": spark.createDataFrame([], f"bucket int, {_row_type(kind)}, seq int"),
                "blocks": spark.createDataFrame([], "slot int, n long, words long, seq int"),
                "lengths": none, "removed": none.select("doc", F.col("seq").alias("upto")),
            },
            meta={"tokens": tokens, "buckets": buckets, "seq": 0, "n": 0, "words": 0, "dead": False}, partition_by={"postings": ["bucket"]},
        )
        own.add(docs, id_col, text_col)
        return own

    # --- changes ---------------------------------------------------------------------

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lease: Lease | None = None) -> int:
        """Add documents, or replace those that are known; the new version is the result."""
        meta = self.store.meta()
        seq = meta["seq"] + 1
        given = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).where("doc is not null and text is not null")
        return self._commit(given, given.select("doc").distinct(), meta, seq, lease)

    def delete(self, ids: DataFrame, id_col: str = "doc_id", lease: Lease | None = None) -> int:
        """Delete documents by id; the new version is the result."""
        meta = self.store.meta()
        return self._commit(None, ids.select(F.col(id_col).alias("doc")).where("doc is not null").distinct(), meta, meta["seq"] + 1, lease)

    def _commit(self, given: DataFrame | None, gone: DataFrame, meta: dict, seq: int, lease: Lease | None) -> int:
        expected = self.store.version()
        segment = f"{seq:08d}-{expected}-{uuid.uuid4().hex[:8]}"
        append, written, more = {}, {}, (0, 0)
        known = self._lengths().join(gone, "doc", "left_semi")
        lost = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0))).first() if meta["n"] else (0, 0)
        if lost[0]:
            append["removed"] = known.select("doc", F.lit(seq - 1).alias("upto"))
        if given is not None:
            slots = self._slots(gone.count())
            # Lengths are made from the postings as written, not from the texts again; one term of a document is its first.
            postings = self._write("postings", self._postings(given, slots, seq, meta), segment, "bucket")
            firsts = postings.select(F.inline("first")).withColumn("seq", F.lit(seq))
            lengths = self._write("lengths", firsts, segment)
            more = lengths.agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0))).first()
            written["lengths"] = [segment]
            if more[0]:
                append["blocks"] = self._blocks(lengths, slots, seq)
                written["postings"] = [segment]
        if not (lost[0] or more[0]):
            return expected
        own = {"seq": seq, "n": meta["n"] + more[0] - lost[0], "words": meta["words"] + more[1] - lost[1], "dead": meta["dead"] or lost[0] > 0}
        return self.store.commit(append=append, meta=own, expected=expected, lease=lease, segment=segment, written=written)

    def _write(self, name: str, rows: DataFrame, segment: str, *by: str) -> DataFrame:
        path = f"{self.store.root}/data/{name}/segment={segment}"
        rows.write.partitionBy(*by).parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _slots(self, documents: int) -> int:
        return max(1, min(MOST_SLOTS, documents // SLOT))

    def _postings(self, given: DataFrame, slots: int, seq: int, meta: dict) -> DataFrame:
        text, letters = CUTS[meta["tokens"]]
        dealt = given.withColumn("slot", _slot(slots)).repartition(tasks_for(self.spark, slots, SLOTS), "slot")
        once = dealt.groupBy("slot", "doc").agg(F.max("text").alias("text"))
        rows = once.select("slot", "doc", text(F.col("text")).alias("text")).sortWithinPartitions("slot", "doc")
        each = rows.mapInArrow(_pieces(letters(np.arange(256))), _row_type(given.schema["doc"].dataType.simpleString()))
        named = each.select(F.pmod(F.xxhash64("term"), F.lit(meta["buckets"])).cast("int").alias("bucket"), *each.columns, F.lit(seq).alias("seq"))
        return self._dealt(named).sortWithinPartitions("bucket", "term", "slot")

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "bucket", F.pmod(F.col("slot"), F.lit(SPREAD)))

    def _blocks(self, lengths: DataFrame, slots: int, seq: int) -> DataFrame:
        return lengths.groupBy(_slot(slots).alias("slot")).agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("words")).withColumn("seq", F.lit(seq))

    def merge(self, lease: Lease | None = None) -> int:
        """Rewrite all segments as one, without dead postings; the new version is the result."""
        meta, expected = self.store.meta(), self.store.version()
        seq = meta["seq"] + 1
        live = self._alive(_single(self.store.read("postings")))
        lengths = self._lengths()
        slots, kind = self._slots(meta["n"]), lengths.schema["doc"].dataType.simpleString()
        sorted_ = self._dealt(live.withColumn("slot", _slot(slots))).sortWithinPartitions("bucket", "term", "slot", "doc")
        rows = sorted_.mapInArrow(_joined, _row_type(kind)).withColumns({"bucket": F.pmod(F.xxhash64("term"), F.lit(meta["buckets"])).cast("int"), "seq": F.lit(seq)})
        rows = rows.select([f.name for f in self.store.read("postings").schema])
        segment = f"{seq:08d}-{expected}-{uuid.uuid4().hex[:8]}"
        self._write("postings", rows, segment, "bucket")
        return self.store.commit(
            replace={"blocks": self._blocks(lengths, slots, seq), "lengths": lengths.select("doc", "len", F.lit(seq).alias("seq")), "removed": self.store.read("removed").limit(0)},
            meta={"seq": seq, "dead": False}, expected=expected, lease=lease, segment=segment, written={"postings": [segment]}, renew=("postings",),
        )

    # --- reading ---------------------------------------------------------------------

    def _last_removed(self) -> DataFrame:
        return self.store.read("removed").groupBy("doc").agg(F.max("upto").alias("upto"))

    def _alive(self, rows: DataFrame) -> DataFrame:
        """Rows (doc, seq, ...) whose document wasn't replaced or deleted later."""
        if not self.store.meta()["dead"]:
            return rows
        gone = self._last_removed()
        return rows.join(gone, "doc", "left").where("upto is null or seq > upto").drop("upto")

    def _lengths(self) -> DataFrame:
        return self._alive(self.store.read("lengths")).select("doc", "len")

    def _stored(self, terms: list[str]) -> DataFrame:
        """Rows of some terms; reads the folders of their buckets and, there, the pages that hold them."""
        return self.store.read("postings").where(F.col("bucket").isin(_hash(self.spark, terms, self.store.meta()["buckets"])) & F.col("term").isin(terms))

    def postings(self, terms: list[str], dead: bool = False) -> DataFrame:
        """Postings of some terms, one by one."""
        rows = _single(self._stored(list(dict.fromkeys(terms))))
        return rows if dead else self._alive(rows)

    def _scorable(self, terms: list[str], slots: list | None = None) -> DataFrame:
        """Postings of some terms, in some (seq, slot) if they are given, without positions."""
        rows = self._stored(terms)
        return self._alive(_single(rows if slots is None else rows.where(_within(slots)), positions=False))

    def blocks(self, terms: list[str]) -> DataFrame:
        """What the best posting of a term in a slot can be at most, and how many there are."""
        return self._stored(terms).select("bucket", "term", "slot", "n", "max_tf", "min_len", "seq")

    def terms(self, query: str) -> list[str]:
        """The terms of a query text, as the index cuts texts."""
        return list(self.spark.range(1).select(F.array_distinct(TOKENS[self.store.meta()["tokens"]](F.lit(query)))).first()[0])

    def frequencies(self, terms: list[str]) -> dict[str, int]:
        """In how many live documents each term occurs."""
        if self.store.meta()["dead"]:
            got = self.postings(terms).groupBy("term").agg(F.count(F.lit(1)))
        else:
            got = self.blocks(terms).groupBy("term").agg(F.sum("n"))
        return dict(got.collect())

    def _scores(self, rows: DataFrame, df: dict[str, int], meta: dict) -> DataFrame:
        mean = meta["words"] / max(1, meta["n"])
        part = self._weight(df, meta) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / mean))
        return rows.withColumn("part", part).groupBy("doc").agg(F.round(F.sum("part"), 6).alias("score"))

    def _weight(self, df: dict[str, int], meta: dict) -> Column:
        pairs = [x for t, n in df.items() for x in (F.lit(t), F.log(F.lit(1 + (meta["n"] - n + 0.5) / (n + 0.5))))]
        return F.create_map(*pairs)[F.col("term")]

    def search(self, terms: list[str] | str, k: int, skip: bool = True) -> DataFrame:
        """(doc, score): the k best documents by BM25 over an OR of ``terms``. Without ``skip`` all their postings are scored."""
        terms = self.terms(terms) if isinstance(terms, str) else list(dict.fromkeys(terms))
        meta = self.store.meta()
        df = self.frequencies(terms) if terms and meta["n"] else {}
        if not df:
            return self.store.read("lengths").limit(0).select("doc", F.lit(0.0).alias("score"))
        best = lambda rows: self._scores(rows, df, meta).orderBy(F.desc("score"), "doc").limit(k)
        if not skip:
            return best(self._scorable(terms))
        mean = meta["words"] / max(1, meta["n"])
        most = self._weight(df, meta) * F.col("max_tf") * (K1 + 1) / (F.col("max_tf") + K1 * (1 - B + B * F.col("min_len") / mean))
        bound = self.blocks(terms).groupBy("seq", "slot").agg(F.sum(most).alias("bound"))
        first = bound.orderBy(F.desc("bound"), "seq", "slot").limit(FIRST * k).collect()
        found = best(self._scorable(terms, first)).collect()
        # Fewer than k hits so far set no bar.
        bar = found[-1]["score"] - 2e-6 if len(found) == k else 0.0
        reach = bound.where(F.col("bound") >= bar)
        named = reach.limit(NAMED + 1).collect()
        if len(named) <= NAMED:
            return best(self._scorable(terms, named))
        return best(self._scorable(terms).join(reach.select("seq", "slot"), ["seq", "slot"], "left_semi"))

    def matching(self, terms: list[str] | str, phrase: bool = False) -> DataFrame:
        """(doc, n): documents with all ``terms``; with ``phrase``, in a row. n: how often the rarest of them, or the phrase, occurs."""
        if isinstance(terms, str):
            # A phrase may repeat a word.
            terms = list(self.spark.range(1).select(TOKENS[self.store.meta()["tokens"]](F.lit(terms))).first()[0])
        terms = list(terms)
        once = list(dict.fromkeys(terms))
        if not once:
            return self.store.read("lengths").limit(0).select("doc", F.lit(0).alias("n"))
        rows = self.postings(once).groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"), F.min("tf").alias("least")).where(F.size("at") == len(once))
        if not phrase:
            return rows.select("doc", F.col("least").alias("n"))
        follows = lambda p: _all([F.array_contains(F.col("at")[t], p + i) for i, t in enumerate(terms) if i])
        starts = F.filter(F.col("at")[terms[0]], follows) if len(terms) > 1 else F.col("at")[terms[0]]
        return rows.select("doc", F.size(starts).alias("n")).where("n > 0")


def _slot(slots: int) -> Column:
    return F.pmod(F.xxhash64("doc", F.lit(3)), F.lit(slots)).cast("int")


def _single(rows: DataFrame, positions: bool = True) -> DataFrame:
    """Stored rows as single postings: bucket, term, slot, seq, doc, tf, len and positions."""
    kind = rows.schema["doc"].dataType.elementType.simpleString()
    own = rows.select("bucket", "term", "slot", "seq", "doc", "tf", "len", *["positions"] * positions)
    return own.mapInArrow(_opened, f"bucket int, term string, slot int, seq int, doc {kind}, tf int, len long{', positions array<int>' * positions}")


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out &= c
    return out


def _within(slots: list) -> Column:
    """Whether a posting lies in one of some (seq, slot); the slots alone reach the scan's page filter."""
    by: dict[int, list[int]] = {}
    for r in slots:
        by.setdefault(r["seq"], []).append(r["slot"])
    if not by:
        return F.lit(False)
    exact = F.lit(False)
    for seq, own in by.items():
        exact |= (F.col("seq") == seq) & F.col("slot").isin(own)
    return F.col("slot").isin(sorted({s for own in by.values() for s in own})) & exact
