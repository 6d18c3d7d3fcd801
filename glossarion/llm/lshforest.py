"""Near-duplicates by an LSH forest: sorted orders of MinHash signatures, with candidates of a long common prefix.

Each of the TREES orders sorts the classes of equal shingle sets by a signature of its own, of DEEP minima.
Neighbours in an order whose common prefix is long enough are candidates. How long is told by region: a
run of classes that agree on SHALLOW minima is taken whole while it is small, and is cut by further minima
where it is crowded. At the full depth two sets of similarity s share a run with a chance of 1 - (1 - s^5)^32,
0.999997 at 0.8, and shallower runs add to that; whether candidates are linked is decided on their whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import neardup
from .components import connected_components
from .simhash import SEED
from .text import shared_dir, slices

WORDS, TREES, DEEP, SHALLOW = 4, neardup.BANDS, neardup.ROWS, 3
#: Shingles of a run that is not cut further.
REGION = 1 << 16
#: Rows of a run that a task holds; a longer one counts as crowded.
RUN = 1 << 20


def signatures(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of a shingle set in all orders: the order and SHALLOW minima as one number, and the others as one; 16 bits of each."""
    m = (neardup._mix(neardup.minima(found)) & np.uint64(0xFFFF)).astype(np.int64)
    head = np.arange(TREES, dtype=np.int64)
    for column in m[:, :SHALLOW].T:
        head = (head << 16) | column
    tail = np.zeros(TREES, np.int64)
    for column in m[:, SHALLOW:].T:
        tail = (tail << 16) | column
    return head, tail


def sketches(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, th, key, n, heads, tails) of each row: hashes of its text and shingle set, the set's size and signatures. No shuffle."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            sets = [neardup.shingles(t or b"", WORDS) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            key = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            both = [signatures(s) if len(s) else ([], []) for s in sets]
            lists = [pa.array([b[i] for b in both], pa.list_(pa.int64())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(key), pa.array([len(s) for s in sets], pa.int64()), *lists], names=[id_col, "th", "key", "n", "heads", "tails"])

    return df.select(id_col, neardup._text_hash(text).alias("th"), F.col(text).alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, th bigint, key bigint, n bigint, heads array<bigint>, tails array<bigint>")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (head, tail, key, n) in order to (k, key, n): the region k of each class that has neighbours there.

    The first and the last run of a task may go on in others, and runs above RUN rows aren't held whole;
    these are cut at full depth, which needs no sight of the rest.
    """
    held: list[np.ndarray] = []
    first, wide = True, None

    def result(head: np.ndarray, tail: np.ndarray, key: np.ndarray, n: np.ndarray, crowded: np.ndarray) -> pa.RecordBatch:
        """Of whole runs; crowded: runs (by row) that are cut at full depth whatever their weight."""
        k, todo = np.zeros(len(head), np.int64), np.ones(len(head), bool)
        keep = np.ones(len(head), bool)
        for depth in range(SHALLOW, DEEP + 1):
            at = np.flatnonzero(todo & (~crowded if depth < DEEP else True))
            if not len(at):
                continue
            rest = tail[at] >> (16 * (DEEP - depth)) if depth > SHALLOW else np.zeros(len(at), np.int64)
            starts = np.flatnonzero(np.r_[True, (head[at][1:] != head[at][:-1]) | (rest[1:] != rest[:-1])])
            sizes = np.diff(np.r_[starts, len(at)])
            weights = np.repeat(np.add.reduceat(n[at], starts), sizes)
            light = (weights <= REGION) | (depth == DEEP)
            name = neardup._mix(neardup._mix(neardup._mix(head[at].view(np.uint64)) + rest.view(np.uint64)) + np.uint64(depth)).view(np.int64)
            k[at[light]] = name[light]
            # a class without neighbours here ends, unless its run may go on elsewhere
            alone = light & (np.repeat(sizes, sizes) == 1) & ~crowded[at]
            keep[at[alone]] = False
            todo[at[light]] = False
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (k, key, n)], names=["k", "key", "n"])

    def flush(rows: list[np.ndarray], last: bool) -> pa.RecordBatch:
        """All rows but those of the last run, which are held, unless they are the last or too many."""
        nonlocal held, first, wide
        head = rows[0]
        start = int(np.flatnonzero(np.r_[True, head[1:] != head[:-1]])[-1])
        whole = last or len(head) - start > RUN
        crowded = np.zeros(len(head), bool)
        if first or wide == head[0]:
            crowded |= head == head[0]
        if whole:
            crowded |= head == head[-1]
        end = len(head) if whole else start
        held = [] if whole else [x[start:] for x in rows]
        if not whole and start == 0:
            return result(*(x[:0] for x in rows), crowded[:0])
        first, wide = False, head[-1] if whole else None
        return result(*(x[:end] for x in rows), crowded[:end])

    for batch in batches:
        if batch.num_rows:
            rows = [c.to_numpy() for c in batch.columns]
            yield flush([np.concatenate(x) for x in zip(held, rows, strict=True)] if held else rows, False)
    if held:
        yield flush(held, True)


def components(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row of df.

    n_shingles: the number of distinct shingles of four words of the lower-cased (A-Z) text, one for all its
    words if it has fewer, none for a null or blank text. component_id: the smallest id reachable over links
    of texts that share 0.8 or more of their shingles, itself included. Texts without shingles are linked
    with nothing: their component is their own id. Repeated rows and ids each keep their row; an id on
    unlike texts stands in each one's component. Rows whose id is null take the component of their shingle
    set (null if no other row has it), but link no others. Other columns don't matter. An empty table gives
    an empty result.
    """
    shared_dir(df.sparkSession)
    named = df.select(F.col(id_col).alias("_id"), F.col(text).alias("_t"))
    rows = sketches(named, "_id", "_t").checkpoint()
    own = rows.filter("_id is not null and n > 0")
    each = F.explode(F.arrays_zip("heads", "tails")).alias("x")
    order = own.dropDuplicates(["key"]).select("key", "n", each).select("x.heads", "x.tails", "key", "n")
    sorted_ = order.repartitionByRange("heads", "tails", "key").sortWithinPartitions("heads", "tails", "key")
    folder = shared_dir(df.sparkSession)
    sorted_.mapInArrow(_runs, "k bigint, key bigint, n bigint").write.parquet(f"{folder}/regions")
    regions = df.sparkSession.read.parquet(f"{folder}/regions")
    found = connected_components(neardup.bucket_links(named, own, regions, "_id", "_t", WORDS)).withColumnRenamed("v", "key")
    classes = own.groupBy("key").agg(F.min("_id").alias("least"))
    label = classes.join(found, "key", "left").select("key", F.coalesce("component", "key").alias("c"), "least")
    least = label.groupBy("c").agg(F.min("least").alias("component_id"))
    # keys are wrapped, so that Spark can split a component or a class of many rows
    label = label.withColumn("k", F.struct("c")).join(least.select(F.struct("c").alias("k"), "component_id"), "k").select(F.struct("key").alias("k"), "component_id")
    linked = rows.filter("n > 0").withColumn("k", F.struct("key")).join(label, "k", "left").select("_id", "n", "component_id")
    blank = rows.filter("n = 0").select("_id", "n", F.col("_id").alias("component_id"))
    return linked.unionByName(blank).select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
