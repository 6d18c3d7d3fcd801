"""Best-fit packing into bins of several capacities.

A sequence costs more a token the longer it is, so that short bins are cheap and long ones are needed
for long pieces. Pieces are dealt by a hash of their id into shards of like size; each shard packs its
pieces longest first. A piece goes to the open bin of least room that holds it; if there is none, the
capacity is opened whose cost for each token that it can be filled with from the lengths still to come
is least. This is done for every set of capacities that holds the largest, and the cheapest packing of
the shard is taken: which lengths are used is decided jointly. In the end each bin takes the smallest
capacity that holds what it got.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import shared_dir

CAPACITIES = (512, 1024, 2048, 4096)
#: A sequence's own cost in tokens, and the length at which attention costs as much as all else.
OVERHEAD, SPAN = 32, 6144
#: Expected pieces of a shard.
SHARD = 20_000


def cost(capacity: int, overhead: int = OVERHEAD, span: int = SPAN) -> float:
    """What a sequence of a capacity costs, in tokens: its length, its share of attention, and a fixed part."""
    return capacity * (1 + capacity / span) + overhead


class _Left:
    """The pieces still to come: their distinct lengths in order and how many there are of each."""

    def __init__(self, lengths: Sequence[int]):
        values, counts = np.unique(np.asarray(lengths, np.int64), return_counts=True)
        self.values, self.count = values.tolist(), dict(zip(values.tolist(), counts.tolist(), strict=True))

    def take(self, n: int) -> None:
        self.count[n] -= 1
        if not self.count[n]:  # lengths fall, so that this one is the last
            self.values.pop()

    def fill(self, room: int) -> int:
        """Tokens that go into a room, taking the longest piece that fits each time."""
        got, values, count = 0, self.values, self.count
        top = bisect_right(values, room)
        while top and room:
            n = values[top - 1]
            if not n:
                break
            times = min(count[n], room // n)
            got += times * n
            room -= times * n
            top = bisect_right(values, room, 0, top - 1)
        return got


def pack_into(lengths: Sequence[int], capacities: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
    """Best fit with one set of capacities; see pack."""
    left = _Left(lengths)
    price = {c: cost(c) for c in capacities}
    room: list[tuple[int, int]] = []  # (room, bin) of open bins with room, sorted
    used: list[int] = []
    bins, offsets = [], []
    for n in lengths:
        left.take(n)
        at = bisect_left(room, (n, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            fits = [c for c in capacities if c >= n]
            free = min(fits, key=lambda c: (price[c] / max(1, n + left.fill(c - n)), c)) if len(fits) > 1 else fits[0]
            b = len(used)
            used.append(0)
        bins.append(b)
        offsets.append(used[b])
        used[b] += n
        if free > n:
            insort(room, (free - n, b))
    return bins, offsets, used


def pack(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES) -> tuple[list[int], list[int], list[int]]:
    """Each piece's bin and offset, and each bin's capacity; lengths, longest first, are at most the largest capacity.

    Of the packings with each set of capacities that holds the largest, the one of least cost after
    downsizing, of equals the one of fewest capacities; so the cost is never above that of best fit in
    bins of the largest only. Of equal bins the earlier opened is taken.
    """
    if not len(lengths):
        return [], [], []
    capacities = sorted(capacities)
    smaller, found = capacities[:-1], None
    for k in range(len(smaller) + 1):
        for chosen in combinations(smaller, k):
            bins, offsets, used = pack_into(lengths, [*chosen, capacities[-1]])
            sizes = [capacities[bisect_left(capacities, u)] for u in used]
            total = sum(map(cost, sizes))
            if found is None or total < found[0]:
                found = total, bins, offsets, sizes
    return found[1:]


def best_fit(df: DataFrame, length: str, id_col: str = "doc_id", capacities: Sequence[int] = CAPACITIES, shard: int = SHARD) -> DataFrame:
    """(id, piece int, start, length, shard, bin, capacity, offset) for every piece of every row of df.

    A row longer than the largest capacity is cut into pieces of that capacity and a rest: piece 0, 1,
    ... with `start` in the row. A null or negative length counts as 0 and takes no room, in a bin
    like any other. Bins are numbered within shards and hold pieces of one shard only. Ties in length
    go by id and piece; repeated rows are packed one by one. Ids may be of any type that can be sorted,
    null included. An empty table gives no rows. The shards' number follows the number of rows, so that
    each stays of a bounded expected size; only ids and lengths are shuffled. Other columns are
    dropped, whatever their names. Ids and lengths are first written to the shared folder: each is worked
    out once, and a row's shard follows its place there, so that an id that many rows share is spread.
    """
    spark, folder = df.sparkSession, shared_dir(df.sparkSession)
    most = max(capacities)
    n = F.greatest(F.coalesce(F.col(length).cast("bigint"), F.lit(0)), F.lit(0)).cast("bigint")
    df.select(F.col(id_col).alias("_id"), n.alias("_n")).write.parquet(f"{folder}/lengths")
    rows = spark.read.parquet(f"{folder}/lengths")
    kind = rows.schema["_id"].dataType.simpleString()
    pieces = rows.agg(F.coalesce(F.sum(F.greatest(F.ceil(F.col("_n") / most), F.lit(1))), F.lit(0))).first()[0]
    shards = max(1, -(-int(pieces) // shard))
    rows = rows.withColumn("_row", F.monotonically_increasing_id()).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil(F.col("_n") / most) - 1, F.lit(0)))))
    rows = rows.select("_row", "_id", F.col("piece").cast("int").alias("piece"), (F.col("piece") * most).alias("start"), F.least(F.lit(most), F.col("_n") - F.col("piece") * most).cast("bigint").alias("length"))
    # pieces are dealt one by one, so that a very long row's are spread as well
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("_row", "piece"), F.lit(shards)).cast("bigint")).drop("_row")
    capacities = tuple(capacities)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        current = None

        def result() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            bins, offsets, sizes = pack(t.column("length").to_pylist(), capacities)
            more = {"bin": pa.array(bins, pa.int64()), "capacity": pa.array(np.array(sizes, np.int64)[bins], pa.int64()), "offset": pa.array(offsets, pa.int64())}
            columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (*t.columns, *more.values())]
            return pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns], names=[*t.column_names, *more])

        for batch in batches:
            shard_of = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shard_of)) + 1).tolist(), len(shard_of)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b == a:
                    continue
                if held and shard_of[a] != current:
                    yield result()
                    held.clear()
                current = shard_of[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield result()

    ordered = rows.repartition("shard").sortWithinPartitions("shard", F.desc("length"), "_id", "piece")
    packed = ordered.mapInArrow(run, f"_id {kind}, piece int, start bigint, length bigint, shard bigint, bin bigint, capacity bigint, offset bigint")
    return packed.withColumnRenamed("_id", id_col)
