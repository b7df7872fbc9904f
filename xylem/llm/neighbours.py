"""Approximate nearest neighbours over shifted space-filling curves.

Vectors get one coordinate more, so that the largest inner product is the
nearest point, are projected at random, shifted and put in order along several
Hilbert curves. Each curve's order is cut into ranges of about equal size; a
query searches the range where it falls and ``span`` ranges to either side, and
what its windows on all curves hold is merged and ranked by exact product. The
span is the least that finds the wanted share of true neighbours for a bounded
sample of queries, which one linear pass answers exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, parts, read_table, written

CURVES, DIMENSIONS, BITS = 4, 8, 7
#: Rows of a range, bound on rows that fit the curves, on queries that fit the span, share of neighbours they must find.
RANGE_ROWS, FITTED, TRIED, WANTED = 8192, 8192, 96, 0.97


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of each row of ``cells`` (Skilling 2004)."""
    x = cells.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


class Curves:
    """Projections, shifts and cuts, fitted on at most ``FITTED`` vectors."""

    def __init__(self, sample: np.ndarray, rows: int, longest: float) -> None:
        rng = np.random.default_rng(5)
        d, self.longest, self.span = sample.shape[1] + 1, longest, 0
        p = min(DIMENSIONS, d)
        self.maps = [np.linalg.qr(rng.standard_normal((d, p)))[0] for _ in range(CURVES)]
        points = self.lifted(sample)
        self.low, self.scale = [], []
        for m in self.maps:
            a, b = np.quantile(points @ m, [0.002, 0.998], axis=0)
            width = np.maximum(b - a, 1e-12) * 1.25
            self.low.append(a - rng.uniform(0, 0.25, p) * (b - a))
            self.scale.append((1 << BITS) / width)
        n = max(1, -(-rows // RANGE_ROWS))
        self.cuts, self.base, self.pieces = [], [], []
        for key in self.keys(points).T:
            self.cuts.append(np.unique(np.quantile(key, np.arange(1, n) / n, method="nearest")) if n > 1 else np.empty(0, np.int64))
            share = np.bincount(np.searchsorted(self.cuts[-1], key), minlength=len(self.cuts[-1]) + 1) / len(key)
            pieces = np.maximum(1, np.ceil(share * rows / (2 * RANGE_ROWS))).astype(np.int64)  # a range that many equal keys fill is split
            self.pieces.append(pieces)
            self.base.append(np.concatenate(([0], np.cumsum(pieces)[:-1])))

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(self.longest**2 - (x * x).sum(1), 0))[:, None]])

    def aimed(self, q: np.ndarray) -> np.ndarray:
        return np.hstack([q * (self.longest / np.linalg.norm(q, axis=1))[:, None], np.zeros((len(q), 1))])

    def keys(self, points: np.ndarray) -> np.ndarray:
        top = (1 << BITS) - 1
        return np.stack([hilbert(np.clip((points @ m - a) * s, 0, top).astype(np.int64), BITS) for m, a, s in zip(self.maps, self.low, self.scale, strict=True)], 1)

    def ranges(self, points: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, k) for c, k in zip(self.cuts, self.keys(points).T, strict=True)], 1)


def vectors(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def foremost(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best ids, each with its best score, ties to the smaller id."""
    order = np.lexsort((ids, -scores))
    _, first = np.unique(ids[order], return_index=True)
    order = order[np.sort(first)][:k]
    return ids[order], scores[order]


def best(query: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each query's k best (ids, products), ties to the smaller id. The product is summed alike for equal vectors."""
    enough = k * int(np.unique(ids, return_counts=True)[1].max(initial=1))  # an id may have several vectors
    for i in range(0, len(query), 256):
        rough = query[i : i + 256] @ x.T
        if rough.shape[1] > enough:
            floor = -np.partition(-rough, enough - 1, axis=1)[:, enough - 1]
        else:
            floor = np.full(len(rough), -np.inf)
        for q, row, least in zip(query[i : i + 256], rough, floor, strict=True):
            at = np.flatnonzero(row >= least - 1e-9 * (1 + abs(least))) if np.isfinite(least) else np.arange(len(row))
            yield foremost(ids[at], (x[at] * q).sum(1), k)


def packed(rep: list, found: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rep, pa.int64()), pa.array([f[0] for f in found], pa.list_(pa.int64())), pa.array([f[1] for f in found], pa.list_(pa.float64()))], ["rep", "ids", "scores"])


_PACKED = "rep long, ids array<long>, scores array<double>"


def merged(rows: DataFrame, k: int) -> DataFrame:
    """One row per query from many, distinct ids only; rows of a query meet in order, never all at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, scores = None, None, None
        for batch in batches:
            out: list = []
            for rep, i, s in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                i, s = i.values.to_numpy(), s.values.to_numpy()
                if rep == now:
                    i, s = foremost(np.concatenate((ids, i)), np.concatenate((scores, s)), k)
                elif now is not None:
                    out.append((now, ids, scores))
                now, ids, scores = rep, i, s
            if out:
                yield packed([o[0] for o in out], [o[1:] for o in out])
        if now is not None:
            yield packed([now], [(ids, scores)])

    return rows.repartition(parts(rows.sparkSession), "rep").sortWithinPartitions("rep").mapInArrow(lean(run), _PACKED)


def neighbours(table: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products found for each row whose id is divisible by ``every``.

    Rows with a null id, and vectors that are null, zero, of another than the
    usual length or hold null or non-finite components take no part. Rows
    with the query's id count as its own. Rows that repeat id and vector count once;
    an id with several vectors is found, and asks, by the best product of any of them.
    Equal vectors are searched once, with their k + 1 smallest ids. Ties go to the smaller id.
    Empty tables give empty results; other columns, whatever their names, are not read.
    """
    spark = table.sparkSession
    v = table.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))
    usual = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if usual is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    v = v.where(F.size("v") == usual["n"]).distinct()
    first = Window.partitionBy("v").orderBy("id")
    candidates = written(v.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).select("id", "v"), "ann-candidates")
    asked = v.where(F.col("id") % every == 0)
    queries = written(asked.groupBy("v").agg(F.min("id").alias("rep")), "ann-queries")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    size = candidates.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("longest")).first()

    def some(df: DataFrame, id_: str, n: int) -> pa.Table:
        return df.orderBy(F.xxhash64(F.lit(7), id_), id_).limit(n).toArrow()

    sample = vectors(some(candidates, "id", FITTED)["v"].combine_chunks())
    curves = Curves(sample, size["n"], size["longest"])
    tried = some(queries, "rep", TRIED)
    if len(tried) and len(curves.cuts[0]):
        q, q_id = vectors(tried["v"].combine_chunks()), tried["rep"].to_numpy()

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    yield packed(list(range(len(q))), list(best(q, batch.column(0).to_numpy(), vectors(batch.column(1)), k + 1)))

        truth = {r["rep"]: [i for i in r["ids"] if i != q_id[r["rep"]]][:k] for r in merged(candidates.mapInArrow(lean(scan), _PACKED), k + 1).collect()}
        true_rows = candidates.where(F.col("id").isin([i for t in truth.values() for i in t])).dropDuplicates(["id"]).toArrow()  # at most TRIED * k
        where = dict(zip(true_rows["id"].to_pylist(), curves.ranges(curves.lifted(vectors(true_rows["v"].combine_chunks()))), strict=True))
        home = curves.ranges(curves.aimed(q))
        far = sorted(int(np.abs(where[i] - home[j]).min()) for j, t in truth.items() for i in t)
        curves.span = far[min(len(far) - 1, int(np.ceil(WANTED * len(far))))] if far else 0

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = curves
        for batch in batches:
            if not len(batch):
                continue
            ids, at = batch.column(0).to_numpy(), c.ranges(c.lifted(vectors(batch.column(1))))
            for curve in range(CURVES):
                piece = c.base[curve][at[:, curve]] + ids % c.pieces[curve][at[:, curve]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), curve, np.int32)), pa.array(piece), batch.column(0), batch.column(1)], ["curve", "piece", "id", "v"])

    def aim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = curves
        for batch in batches:
            if not len(batch):
                continue
            at = c.ranges(c.aimed(vectors(batch.column(1))))
            for curve in range(CURVES):
                lo = c.base[curve][np.maximum(at[:, curve] - c.span, 0)]
                last = np.minimum(at[:, curve] + c.span, len(c.base[curve]) - 1)
                n = c.base[curve][last] + c.pieces[curve][last] - lo
                row = np.repeat(np.arange(len(at)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + lo[row]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), curve, np.int32)), pa.array(piece), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row))], ["curve", "piece", "rep", "v"])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.Table.from_batches([packed([], [])])
        x, q = vectors(left["v"].combine_chunks()), vectors(right["v"].combine_chunks())
        return pa.Table.from_batches([packed(right["rep"].to_pylist(), list(best(q, left["id"].to_numpy(), x, k + 1)))])

    kind = candidates.schema["v"].dataType.simpleString()
    placed = candidates.select("id", "v").mapInArrow(lean(place), f"curve int, piece long, id long, v {kind}")
    aimed = queries.select("rep", "v").mapInArrow(lean(aim), f"curve int, piece long, rep long, v {kind}")
    found = placed.groupBy("curve", "piece").cogroup(aimed.groupBy("curve", "piece")).applyInArrow(search, _PACKED)
    top = merged(found, k + 1)
    members = asked.join(queries, "v").select(F.col("id").alias("query_id"), "rep").distinct()
    rows = members.join(top, "rep").select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("query_id", F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score")).where("query_id <> vec_id")
    rows = rows.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5(spark, sf_dir):
    return neighbours(read_table(spark, sf_dir, "embeddings"))
