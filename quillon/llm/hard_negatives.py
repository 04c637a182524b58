"""Hard-negative mining by a Voronoi-partitioned nearest-neighbour join.

The score of an anchor and a row is the inner product of their vectors of whole
numbers. With M the largest norm, a row x gets one more entry, sqrt(M^2 - |x|^2),
and an anchor q a zero: then |q - x|^2 = |q|^2 + M^2 - 2 score, and the largest
inner products are the smallest distances.

Every row is assigned to its nearest pivot; a cell is known by its pivot and the
least and largest distance of its rows from it. Anchors are grouped by the cells
that they fall in, neighbouring cells together. A search runs in two rounds: an
anchor is joined with the rows of its group's own cells, which bounds the
distance of what it is looking for, then with those of every other cell that the
bounds (triangle inequality on both radii, and the plane between two pivots)
don't rule out for some anchor of the group. Only such cells are replicated to
the group. Within a group, anchors are matched with slices of its rows in blocks
of exact integer products, and only the best of each slice leave the task.

First search: the ``positives`` rows of the anchor's label with the largest
scores. Second search, for each positive: rows of other labels whose score lies
between ``low`` and ``high`` percent of the positive's, largest first.

Neither labels nor cells are shuffled as keys: rows of a group are dealt to its
slices by number, so neither a hot label nor a crowded cell meets in one task.

Defined results: rows with a null label, a null vector or null or non-finite
entries take no part; shorter vectors are filled up with 0; entries beyond +-2^16
count as that; rows with a null id are no anchors, and come after all others in
ties; rows that share an id are rows of their own (each an anchor, and each
other's positive), and of equal ids and scores the one that hashes lower comes
first; anchors without positives or negatives give no rows; a positive whose score
is below zero has no negatives; an empty table gives an empty result; other
columns are never read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm import vectors
from quillon.llm.scratch import written

#: Pivots at most; fewer for small tables.
PIVOTS = 256
#: Anchors of a group at most, and rows of a slice: every row goes to each group that its cell serves, every anchor to each slice of its group.
GROUP, SLICE, LEAST_SLICE = 8192, 32768, 512
#: Anchors that are scored against a slice at once.
BLOCK = 128
#: Pairs (cell, group) that are broadcast at most; beyond, they are joined by cell.
BROADCAST_PAIRS = 1_000_000
SCALE, MOST = 256, float(1 << 24)
#: Bounds are widened by this part of the largest norm, as distances are rounded.
SLACK = 1e-6


def whole_numbers(vec: Column) -> Column:
    return F.transform(vec.cast("array<double>"), lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(MOST)), F.lit(-MOST))).cast("int"))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows: in doubles where no sum can leave 53 bits."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < 2.0**53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


def best(score: np.ndarray, fits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest scores that fit in each row; ties by column. Rows ascend, scores fall."""
    m = score.shape[1]
    if m > 4 * k and float(np.abs(score).max(initial=0)) < 2.0**62 / m:
        key = np.where(fits, score * m - np.arange(m), np.iinfo(np.int64).min)
        top = np.argpartition(key, m - k, axis=1)[:, m - k :]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(key, top, 1), axis=1, kind="stable"), 1)
    else:
        top = np.argsort(-np.where(fits, score, -(2**62)), axis=1, kind="stable")[:, :k]
    row = np.repeat(np.arange(len(score)), top.shape[1])
    col = top.ravel()
    own = fits[row, col]
    return row[own], col[own]


class Cells:
    """Pivots in the space with one more entry, and what is known of their cells."""

    def __init__(self, pivots: np.ndarray, reach: float):
        self.pivots, self.reach = pivots, reach  # reach: the square of the largest norm
        self.least = self.most = np.zeros(0)

    def distances(self, x: np.ndarray, anchors: bool) -> np.ndarray:
        x = x.astype(float)
        more = np.zeros(len(x)) if anchors else np.sqrt(np.maximum(0, self.reach - (x**2).sum(1)))
        full = np.column_stack((x, more))
        return np.sqrt(np.maximum(0, (full**2).sum(1)[:, None] + (self.pivots**2).sum(1) - 2 * full @ self.pivots.T))

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest distance that a row of each cell can have from each anchor."""
        d = self.distances(x, True)
        home = d.argmin(1)
        between = np.sqrt(np.maximum(0, ((self.pivots[:, None] - self.pivots[None]) ** 2).sum(2)))
        apart = np.maximum(between[home], 1e-9)
        # A row of another cell lies beyond the plane between the two pivots.
        plane = (d**2 - np.take_along_axis(d, home[:, None], 1) ** 2) / (2 * apart)
        plane[np.arange(len(x)), home] = 0
        return np.maximum.reduce([d - self.most, self.least - d, plane, np.zeros_like(d)]), d + self.most


def _assign(rows: DataFrame, cells: Cells, dim: int) -> DataFrame:
    """Rows with the cell of each, its distance from the pivot, and the cell that it falls in as an anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = vectors.matrix(batch.column("x"), dim)
            d = cells.distances(x, False)
            cell = d.argmin(1)
            home = cells.distances(x, True).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(x)), cell]), pa.array(home.astype(np.int32))], [*batch.schema.names, "cell", "far", "home"])

    return rows.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema.fields)}, cell int, far double, home int")


def _chain(pivots: np.ndarray) -> list[int]:
    """All pivots, each followed by the nearest one that is left."""
    left, out = set(range(1, len(pivots))), [0]
    while left:
        rest = sorted(left)
        near = rest[int(((pivots[rest] - pivots[out[-1]]) ** 2).sum(1).argmin())]
        out.append(near)
        left.remove(near)
    return out


def groups_of(pivots: np.ndarray, anchors: dict[int, int], size: int = GROUP) -> dict[int, tuple[int, int]]:
    """For each cell with anchors, the first of its groups and how many they are: small neighbours share one, a crowded cell has several."""
    out: dict[int, tuple[int, int]] = {}
    number, held = 0, 0
    for cell in _chain(pivots):
        n = anchors.get(cell, 0)
        if not n:
            continue
        if held and held + n > size:
            number, held = number + 1, 0
        parts = -(-n // size)
        out[cell] = (number, parts)
        number, held = (number + parts, 0) if parts > 1 else (number, held + n)
    return out


_FOUND = "anchor long, anchor_id {id}, place int, row long, row_id {id}, score long"


class Search:
    """Anchors in groups against rows in cells, in two rounds."""

    def __init__(self, rows: DataFrame, anchors: DataFrame, cells: Cells, sizes: dict[int, int], group_cells: DataFrame, dim: int, slices: int):
        self.rows, self.anchors, self.cells, self.sizes, self.own, self.dim, self.slices = rows, anchors, cells, sizes, group_cells, dim, slices
        self.id = rows.schema["vec_id"].dataType.simpleString()

    def _joined(self, anchors: DataFrame, served: DataFrame, wanted: int, pick) -> DataFrame:
        """The best rows that the served (group, cell) pairs have for each anchor."""
        spark = self.rows.sparkSession
        size = F.broadcast(spark.createDataFrame([*self.sizes.items()], "cell int, size long"))
        # A slice is bounded in rows; small inputs are cut finer, to use the cluster.
        fine = F.greatest(F.lit(LEAST_SLICE), F.least(F.lit(SLICE), F.ceil(F.sum("size") / self.slices)))
        groups = written(served.join(size, "cell").groupBy("group").agg(F.ceil(F.sum("size") / fine).cast("int").alias("slices")), "slices")
        pairs = served.join(groups, "group")
        few = served.count() <= BROADCAST_PAIRS
        dealt = self.rows.join(F.broadcast(pairs) if few else pairs, "cell").withColumn("slice", F.pmod(F.xxhash64("rid", "group"), F.col("slices")).cast("int"))
        asked = anchors.join(F.broadcast(groups) if few else groups, "group").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
        dim = self.dim

        def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
            names = ["anchor", "anchor_id", "place", "row", "row_id", "score"]
            out = []
            if len(left) and len(right):
                right = right.sort_by([("vec_id", "ascending"), ("tie", "ascending"), ("rid", "ascending")])  # nulls last
                x, q = vectors.matrix(right.column("x"), dim), vectors.matrix(left.column("x"), dim)
                rid, label = right.column("rid").to_numpy(), right.column("label").to_numpy()
                for at in range(0, len(left), BLOCK):
                    part = left.slice(at, BLOCK)
                    score = products(q[at : at + BLOCK], x)
                    for place, i, j in pick(part, score, rid, label):
                        row = pa.array(i + at)
                        out.append([left.column("rid").take(row).combine_chunks(), left.column("vec_id").take(row).combine_chunks(), pa.array(np.full(len(i), place, np.int32)), right.column("rid").take(pa.array(j)).combine_chunks(), right.column("vec_id").take(pa.array(j)).combine_chunks(), pa.array(score[i, j])])
            kinds = [pa.int64(), left.schema.field("vec_id").type, pa.int32(), pa.int64(), left.schema.field("vec_id").type, pa.int64()]
            return pa.Table.from_arrays([pa.chunked_array([o[c] for o in out], kinds[c]) for c in range(len(names))], names)

        found = asked.select("group", "slice", *anchors.drop("group").columns).groupBy("group", "slice").cogroup(dealt.select("group", "slice", "rid", "tie", "vec_id", "label", "x").groupBy("group", "slice")).applyInArrow(run, _FOUND.format(id=self.id))
        return self._first(found, wanted)

    def _first(self, found: DataFrame, wanted: int) -> DataFrame:
        w = Window.partitionBy("anchor", "place").orderBy(F.col("score").desc(), F.col("row_id").asc_nulls_last(), F.xxhash64("row"), "row")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= wanted)

    def run(self, anchors: DataFrame, wanted: int, pick, serves, name: str) -> DataFrame:
        """``pick(anchors, scores, row numbers, labels)`` yields (place, anchor, row) of what may be wanted; ``serves(anchors, bounds)`` says which cells may hold better than the first round found."""
        first = written(self._joined(anchors, self.own, wanted, pick), f"{name}-own")
        lists = first.groupBy("anchor", "place").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).groupBy(F.col("anchor").alias("rid")).agg(F.collect_list(F.struct("place", "n", "least")).alias("got"))
        cells, dim, slack = self.cells, self.dim, SLACK * self.cells.reach**0.5

        def need(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = vectors.matrix(batch.column("x"), dim)
                low, high = cells.bounds(x)
                size = (x.astype(float) ** 2).sum(1) + cells.reach
                i, j = np.nonzero(serves(batch, low - slack, high + slack, lambda score, size=size: np.sqrt(np.maximum(0, size - 2 * score))))
                pairs = np.unique(np.column_stack((batch.column("group").to_numpy()[i], j)), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1].astype(np.int32))], ["group", "cell"])

        more = written(anchors.join(lists, "rid", "left").mapInArrow(need, "group long, cell int").distinct().join(F.broadcast(self.own), ["group", "cell"], "left_anti"), f"{name}-served")
        if more.isEmpty():
            return first
        rest = self._joined(anchors, more, wanted, pick)
        return written(self._first(first.drop("rank").unionByName(rest.drop("rank")), wanted), name)


def _got(batch: pa.RecordBatch, places: int, wanted: int) -> np.ndarray:
    """For each anchor and place the least score found so far, or minus infinity where fewer than ``wanted`` were found."""
    out = np.full((len(batch), places), -np.inf)
    for k, got in enumerate(batch.column("got").to_pylist()):
        for g in got or ():
            if g["n"] >= wanted:
                out[k, g["place"]] = g["least"]
    return out


def mine(embeddings: DataFrame, anchor: Column, label: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchor``: which rows are anchors; ``label``: their classes, as columns of
    ``embeddings``. ``low`` and ``high``: bounds of a negative's score, in percent.
    """
    kind = embeddings.schema[id_col].dataType.simpleString()
    out_schema = f"anchor_id {kind}, positive_id {kind}, rank int, negative_id {kind}, positive_score long, negative_score long"
    fine = embeddings.select(F.col(id_col).alias("vec_id"), label.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("asks"), F.col(vec_col).alias("v")).where(F.col("label").isNotNull() & vectors.finite(F.col("v")))
    spark = embeddings.sparkSession
    dim = vectors.dimension(fine, "v")
    x = vectors.padded(whole_numbers(F.col("v")), dim, F.lit(0))
    rows = written(fine.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "label", F.col("asks") & F.col("vec_id").isNotNull(), x.alias("x")).toDF("rid", "vec_id", "label", "asks", "x").withColumn("tie", F.xxhash64("label", "x")), "mining-rows")
    square = F.aggregate("x", F.lit(0.0), lambda a, c: a + c.cast("double") * c)
    n, reach = rows.agg(F.count(F.lit(1)), F.max(square)).first()
    if not n or not dim:
        return spark.createDataFrame([], out_schema)
    sample = rows.select("x").orderBy(F.xxhash64("x"), "x").limit(int(min(PIVOTS, max(1, n**0.5 / 4)))).collect()
    pivots = np.unique(np.array([r[0] for r in sample], float).reshape(-1, dim), axis=0)
    cells = Cells(np.column_stack((pivots, np.sqrt(np.maximum(0, reach - (pivots**2).sum(1))))), float(reach))
    cells.least = cells.most = np.zeros(len(pivots))
    rows = written(_assign(rows, cells, dim), "mining-cells")
    asks = rows.where("asks")
    sizes = {}
    cells.least, cells.most = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
    for c, size, near, far in rows.groupBy("cell").agg(F.count(F.lit(1)), F.min("far"), F.max("far")).collect():
        sizes[c], cells.least[c], cells.most[c] = size, near, far
    homes = dict(asks.groupBy("home").agg(F.count(F.lit(1)).alias("n")).collect())
    if not homes:
        return spark.createDataFrame([], out_schema)
    groups = groups_of(cells.pivots, homes)
    start = F.broadcast(spark.createDataFrame([(c, a, k) for c, (a, k) in groups.items()], "home int, start long, parts long"))
    grouped = asks.join(start, "home").withColumn("group", F.col("start") + F.pmod(F.xxhash64("rid"), F.col("parts")))
    anchors = written(grouped.select("group", "rid", "vec_id", "label", "x"), "mining-anchors")
    own = spark.createDataFrame(sorted({(a + i, c) for c, (a, k) in groups.items() for i in range(k)}), "group long, cell int")
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    search = Search(rows, anchors, cells, sizes, own, dim, slices)

    def same_label(part: pa.Table, score: np.ndarray, rid: np.ndarray, label: np.ndarray):
        fits = (part.column("label").to_numpy()[:, None] == label) & (part.column("rid").to_numpy()[:, None] != rid)
        yield 0, *best(score, fits, min(positives, score.shape[1]))

    def may_be_nearer(batch: pa.RecordBatch, near: np.ndarray, far: np.ndarray, distance) -> np.ndarray:
        least = _got(batch, 1, positives)[:, 0]
        return near <= np.where(np.isinf(least), np.inf, distance(least))[:, None]

    pos = search.run(anchors, positives, same_label, may_be_nearer, "positives")
    # Whole numbers s with low * score <= 100 * s <= high * score.
    bands = pos.where("score >= 0").select(F.col("anchor").alias("rid"), "rank", F.expr(f"(score * {low} + 99) div 100").alias("least"), F.expr(f"score * {high} div 100").alias("most"))
    listed = bands.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("rank", "least", "most"))).alias("bands"))
    asked = written(anchors.join(listed, "rid"), "mining-bands")

    def in_band(part: pa.Table, score: np.ndarray, rid: np.ndarray, label: np.ndarray):
        other = part.column("label").to_numpy()[:, None] != label
        least, most, there = _bands(part.column("bands"), positives)
        for p in range(positives):
            i = np.flatnonzero(there[:, p])
            if len(i):
                a, b = best(score[i], other[i] & (score[i] >= least[i, p, None]) & (score[i] <= most[i, p, None]), min(negatives, score.shape[1]))
                yield p, i[a], b

    def may_hold(batch: pa.RecordBatch, near: np.ndarray, far: np.ndarray, distance) -> np.ndarray:
        least, most, there = _bands(batch.column("bands"), positives)
        worst = np.maximum(_got(batch, positives, negatives), least)
        out = np.zeros(near.shape, bool)
        for p in range(positives):
            out |= there[:, p, None] & (near <= distance(worst[:, p])[:, None]) & (far >= distance(most[:, p])[:, None])
        return out

    neg = search.run(asked, negatives, in_band, may_hold, "negatives")
    of = pos.select("anchor", (F.col("rank") - 1).alias("place"), F.col("row_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = neg.join(of, ["anchor", "place"])
    return out.select("anchor_id", "positive_id", "rank", F.col("row_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _bands(column: pa.Array | pa.ChunkedArray, places: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least and largest score of each anchor's places, and whether there is one."""
    least, most, there = np.zeros((len(column), places), np.int64), np.zeros((len(column), places), np.int64), np.zeros((len(column), places), bool)
    for k, own in enumerate(column.to_pylist()):
        for b in own:
            least[k, b["rank"] - 1], most[k, b["rank"] - 1], there[k, b["rank"] - 1] = b["least"], b["most"], b["least"] <= b["most"]
    return least, most, there
