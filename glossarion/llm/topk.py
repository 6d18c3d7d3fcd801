"""Exact top-k inner products by pivot-table elimination.

Vectors x become points (x, sqrt(M - |x|^2)) of one norm and queries points (q, 0), so that a larger
inner product is a smaller distance. A set of pivots is chosen once, and a table holds each row's
distances to all of them. By the triangle inequality the largest |d(q, p) - d(x, p)| over pivots p bounds
d(q, x) from below, hence the product from above. Each query takes a block's candidates in the order of
their bounds and stops at the first whose bound is below the k-th best product found so far. This is
exact, whatever the bounds are worth.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import shared_dir

#: Pivots, and the rows that they are chosen from: those of the least hashed ids.
PIVOTS, PIVOT_ROWS = 32, 1024
#: Rows of a group of queries, and of a block of candidates.
QUERY_BLOCK, BLOCK = 2048, 8192
#: The most blocks that one task meets with one group of queries.
BLOCKS = 8
#: Queries whose bounds on a block are held at a time, and the first candidates that each evaluates.
_TOGETHER, _FIRST = 32, 256


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """(id, v array<bigint>): floor(scale * x) of each component as a double; rows with a null or non-finite part go."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    fine = F.col(id_col).isNotNull() & F.col(vector).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.filter(F.coalesce(fine, F.lit(False))).select(id_col, F.transform(x, lambda c: F.floor(c * float(scale)).cast("bigint")).alias("v"))


def _rows(column: pa.ListArray, width: int | None = None) -> np.ndarray:
    """A column of arrays of numbers as a matrix of so many columns, or of the longest array's; shorter ones end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths, flat = column.value_lengths().to_numpy(), column.flatten().to_numpy()
    width = int(lengths.max(initial=0)) if width is None else width
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), flat.dtype)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _wide(m: np.ndarray, width: int) -> np.ndarray:
    return np.pad(m, ((0, 0), (0, width - m.shape[1])))


def choose_pivots(x: np.ndarray, most: float, n: int = PIVOTS) -> np.ndarray:
    """Of points (rows of x, lifted to squared norm `most`) n that lie far apart: each the farthest from those before."""
    points = np.c_[x, np.sqrt(np.maximum(most - (x * x).sum(1), 0))]
    if not len(points):
        return points
    chosen, far = [0], np.full(len(points), np.inf)
    while len(chosen) < min(n, len(points)):
        far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(1))
        chosen.append(int(far.argmax()))
    return points[chosen]


def pivot_distances(x: np.ndarray, asks: np.ndarray, pivots: np.ndarray, most: float) -> np.ndarray:
    """Distances of rows to the pivots; rows that ask have 0 as their last coordinate, others lie on the sphere."""
    x = x.astype(float)
    width = max(x.shape[1], pivots.shape[1] - 1)
    squares = (x * x).sum(1)
    last = np.where(asks, 0.0, np.sqrt(np.maximum(most - squares, 0)))
    points = np.c_[_wide(x, width), last]
    far = np.c_[_wide(pivots[:, :-1], width), pivots[:, -1]]
    return np.sqrt(np.maximum((points * points).sum(1)[:, None] + (far * far).sum(1) - 2 * (points @ far.T), 0))


class Asking:
    """A group of queries: rows, ids and vectors, distances to the pivots, and the best (score, id) found for each."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, q: np.ndarray, table: np.ndarray, k: int, most: float):
        self.rows, self.ids, self.q, self.table, self.k, self.most = rows, ids, q, table.astype(np.float32), k, most
        self.best = [np.zeros((0, 2), np.int64)] * len(ids)
        self.evaluated = self.pairs = 0

    def meet(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, table: np.ndarray) -> None:
        """Take in a block of candidates."""
        width = max(self.q.shape[1], x.shape[1])
        q, x, k = _wide(self.q, width), _wide(x, width), self.k
        top = max(int(np.abs(m).max(initial=0)) for m in (q, x))
        sums = top * top * max(1, width)  # the least type in which every partial sum is exact
        exact = np.float32 if sums < 1 << 24 else np.float64 if sums < 1 << 53 else object
        norms = (q.astype(float) ** 2).sum(1)
        slack = 1e-5 * (1 + np.sqrt(self.most + norms.max(initial=0.0)))  # for rounding, in units of distance
        q, x, columns = q.astype(exact), x.astype(exact), np.ascontiguousarray(table.T.astype(np.float32))
        for a in range(0, len(q), _TOGETHER):
            part = slice(a, a + _TOGETHER)
            low = np.zeros((len(q[part]), len(x)), np.float32)
            for p, column in enumerate(columns):  # the largest lower bound over pivots
                np.maximum(low, np.abs(column - self.table[part, p, None]), out=low)
            low = np.maximum(low - np.float32(slack), 0)
            for i, far in enumerate(low, a):
                # a product of at least s means a squared distance of at most |q|^2 + M - 2 s
                reach = norms[i] + self.most
                best, own = self.best[i], self.rows[i]
                worst = best[k - 1, 0] if len(best) >= k else None
                alive = np.flatnonzero(far * far <= self.limit(reach, worst)) if worst is not None else np.arange(len(far))
                alive = alive[np.argsort(far[alive], kind="stable")]
                start, step = 0, _FIRST
                while start < len(alive):
                    if worst is not None and far[alive[start]] ** 2 > self.limit(reach, worst):
                        break
                    take = alive[start : start + step]
                    self.evaluated += len(take)
                    scores = x[take] @ q[i]
                    good = rows[take] != own
                    if worst is not None:
                        good &= scores >= worst
                    if good.any():
                        got = np.stack([scores[good].astype(np.int64), ids[take[good]]], 1)
                        best = np.r_[best, got] if len(best) else got
                        best = best[np.lexsort((best[:, 1], -best[:, 0]))][:k]
                        worst = best[k - 1, 0] if len(best) >= k else None
                    start, step = start + step, 2 * step
                self.best[i] = best
        self.pairs += len(q) * len(x)

    @staticmethod
    def limit(reach: float, worst: int) -> float:
        """The largest squared distance at which a product can reach `worst`, rounded up."""
        return max(0.0, (reach - 2 * float(worst)) * (1 + 1e-6) + 1e-3)


def pivot_table(vectors: DataFrame, asks: str, id_col: str) -> tuple[DataFrame, int, float]:
    """(row, asks, id, v, d array<float>) of all vectors, once as candidates and those that ask again, written to the
    shared folder; how many candidates there are, and the largest squared norm."""
    spark, folder = vectors.sparkSession, shared_dir(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), "v", F.coalesce(F.expr(asks), F.lit(False)).alias("asks"))
    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c)
    largest = F.array_max(F.transform("v", lambda c: F.abs(c)))
    count, most, top = rows.agg(F.count("*"), F.coalesce(F.max(square), F.lit(0.0)), F.coalesce(F.max(largest), F.lit(0))).first()
    narrow = "smallint" if top < 1 << 15 else "int" if top < 1 << 31 else "bigint"
    rows = rows.withColumn("v", F.col("v").cast(f"array<{narrow}>"))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(PIVOT_ROWS).select("v").toArrow()
    pivots = choose_pivots(_rows(sample.column("v")).astype(float), most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for again in (False, True):
                part = batch.filter(batch.column("asks")) if again else batch
                if part.num_rows:
                    asking = np.full(part.num_rows, again)
                    d = pivot_distances(_rows(part.column("v")), asking, pivots, most).astype(np.float32)
                    cells = pa.ListArray.from_arrays(np.arange(len(d) + 1, dtype=np.int32) * len(pivots), pa.array(d.ravel()))
                    yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(asking), part.column("id"), part.column("v"), cells], names=["row", "asks", "id", "v", "d"])

    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    numbered.mapInArrow(run, f"row bigint, asks boolean, id bigint, v array<{narrow}>, d array<float>").write.parquet(f"{folder}/pivots")
    return spark.read.parquet(f"{folder}/pivots"), count, most


def search(vectors: DataFrame, asks: str, k: int = 20, id_col: str = "vec_id") -> DataFrame:
    """(query_id, rank int, id, score bigint): for each vector that asks the k others of highest inner product.

    vectors: (id bigint, v array<bigint>), see integer_vectors; asks: an SQL condition on them (null counts
    as false). A row is no candidate for itself; rows that repeat an id or a vector are rows like others,
    as queries and as candidates. Ties go to the smaller id. Fewer candidates than k give fewer rows,
    none give none; vectors of unlike lengths are compared as if the shorter ended in zeros. Products
    must fit a long. Other columns are dropped.

    Queries come in groups of a fixed expected size; each group meets every candidate once, in runs of
    blocks whose number follows the number of candidates. A task keeps a group and a block, and passes on
    k rows for each query and run. There is no pairwise join.
    """
    table, count, most = pivot_table(vectors, asks, id_col)
    groups = max(1, -(-table.filter("asks").count() // QUERY_BLOCK))
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    # runs of one block where few groups would leave cores idle, of several where there are many
    slots = max(1, -(-count // (BLOCK * BLOCKS)), min(-(-count // BLOCK), -(-2 * cores // groups)))
    group, slot = F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int"), F.pmod(F.xxhash64("row", F.lit(1)), F.lit(slots)).cast("int")
    q = table.filter("asks").select(group.alias("g"), F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"), "asks", "row", "id", "v", "d")
    x = table.filter("not asks").select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), slot.alias("slot"), "asks", "row", "id", "v", "d")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by group and slot, queries first."""
        asking: Asking | None = None
        held: list[pa.RecordBatch] = []
        unit: tuple | None = None

        def matrices() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            t = pa.Table.from_batches(held)
            held.clear()
            return t.column("row").to_numpy(), t.column("id").to_numpy(), _rows(t.column("v")), _rows(t.column("d"))

        def close() -> None:
            """Take in what is held: the unit's queries, or a block."""
            nonlocal asking
            if not held:
                return
            if unit[2]:
                asking = Asking(*matrices(), k, most)
            elif asking is not None:
                asking.meet(*matrices())
            else:
                held.clear()

        def results() -> pa.RecordBatch:
            n = [len(b) for b in asking.best]
            found = np.concatenate(asking.best)
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(asking.rows, n)), pa.array(np.repeat(asking.ids, n)), pa.array(found[:, 1]), pa.array(found[:, 0])], names=["query", "query_id", "id", "score"])

        for batch in batches:
            keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            starts = np.flatnonzero(np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in keys])]) if batch.num_rows else []
            for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                here = tuple(c[a].item() for c in keys)
                if here != unit:
                    close()
                    if unit is not None and here[:2] != unit[:2]:
                        if asking is not None:
                            yield results()
                        asking = None
                    unit = here
                held.append(batch.slice(a, b - a))
                if not unit[2] and sum(h.num_rows for h in held) >= BLOCK:
                    close()
        close()
        if asking is not None:
            yield results()

    rows = q.unionByName(x).repartition("g", "slot").sortWithinPartitions("g", "slot", F.desc("asks"), "row")
    found = rows.mapInArrow(run, "query bigint, query_id bigint, id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
