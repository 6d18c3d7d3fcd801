"""SimHash near-duplicates by pigeonhole blocks.

A 64-bit fingerprint is cut into five blocks. Two fingerprints that differ in at most three bits agree
on at least two blocks, so that they meet under one of the ten pairs of blocks, where their Hamming
distance is verified. Equal fingerprints are one class throughout, and a bucket passes on a spanning
forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .components import connected_components
from .text import shared_dir, slices

SHINGLE, SEED, MAX_BITS = 3, 42, 3
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Buckets larger than this are cut into pieces, and each pair of pieces is one unit of work.
PIECE = 4096
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes) -> int:
    """Of a UTF-8 text, as a signed 64-bit number."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        hashes = [h(b" ".join(words), SEED)]
    else:
        hashes = [h(s, SEED) for s in map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[i : i + (1 << 16)], ">u8")
        ones += np.unpackbits(part.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` and fp (bigint) of each row's whole text; a null or blank text has fingerprint 0. No shuffle."""
    schema = StructType([*df.select(*keep).schema.fields, StructField("fp", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            texts = batch.column("_text").cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([fingerprint(t or b"") for t in texts], pa.int64())], names=[*keep, "fp"])

    return df.select(*keep, df[text].alias("_text")).mapInArrow(run, schema)


def _distance(a: np.ndarray, b: np.ndarray | np.int64) -> np.ndarray:
    """Differing bits; counted on unsigned numbers, as numpy counts those of a signed one's absolute value."""
    return np.bitwise_count(np.asarray(a ^ b).view(np.uint64))


def forest(fp: np.ndarray) -> list[tuple[int, int]]:
    """Edges (i, j) of a spanning forest of the links among fp; memory grows with its length only."""
    edges, left = [], np.arange(len(fp))
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = _distance(fp[left], fp[at]) <= MAX_BITS
            if near.any():
                found = left[near].tolist()
                edges += [(at, x) for x in found]
                queue += found
                left = left[~near]
    return edges


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket (columns: bucket, v, fp) to links (u, v); one bucket, of two pieces at most, is held."""
    rest = None
    for batch in _then_none(batches):
        if batch is not None:
            rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            rows = rows if rest is None else [np.concatenate(x) for x in zip(rest, rows, strict=True)]
        elif rest is None:
            return
        else:
            rows = rest
        bucket, v, fp = rows
        if not len(bucket):
            rest = rows
            continue
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        if batch is not None:  # the last bucket may go on in the next batch
            rest, (bucket, v, fp), starts = [x[starts[-1] :] for x in rows], [x[: starts[-1]] for x in rows], starts[:-1]
        sizes = np.diff(np.r_[starts, len(bucket)])
        size_of = np.repeat(sizes, sizes)
        us, vs = [], []
        for step in range(1, 8):  # small buckets, all at once: rows that lie `step` apart
            near = np.flatnonzero((bucket[step:] == bucket[:-step]) & (size_of[step:] <= 8) & (_distance(fp[step:], fp[:-step]) <= MAX_BITS))
            us.append(v[near])
            vs.append(v[near + step])
        for a, n in zip(starts[sizes > 8].tolist(), sizes[sizes > 8].tolist(), strict=True):
            if found := forest(fp[a : a + n]):
                i, j = np.array(found).T
                us.append(v[a + i])
                vs.append(v[a + j])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (us, vs)], names=["u", "v"])


def _then_none(items: Iterator) -> Iterator:
    yield from items
    yield None


def links(classes: DataFrame) -> DataFrame:
    """(u, v) that link classes (v bigint, fp bigint) into the components of all pairs at 3 or fewer differing bits."""

    def mask(*blocks: tuple[int, int]) -> int:
        m = sum(((1 << width) - 1) << start for start, width in blocks)
        return m - (1 << 64) if m >> 63 else m

    masks = [mask(a, b) for a, b in combinations(BLOCKS, 2)]
    keys: Column = F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m).cast("bigint")).alias("bits")) for i, m in enumerate(masks)])
    rows = classes.select("v", "fp", F.explode(keys).alias("key"))
    # buckets of one row end here; their sizes are joined by another key, so that Spark can split large ones
    shared = rows.groupBy("key.c", "key.bits").count().filter("count > 1").select(F.xxhash64("c", "bits").alias("k"), F.ceil(F.col("count") / PIECE).alias("pieces"))
    rows = rows.select("v", "fp", F.xxhash64("key.c", "key.bits").alias("k")).join(shared, "k")
    own = F.pmod(F.xxhash64("fp"), F.col("pieces"))
    rows = rows.select("k", "pieces", "v", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1)).alias("other"))
    unit = F.xxhash64("k", "pieces", F.least("own", "other"), F.greatest("own", "other"))
    rows = rows.select(unit.alias("bucket"), "v", "fp").repartition("bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(_links, "u bigint, v bigint")


def components(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) of every row of df.

    fingerprint: 16 lower-case hex digits over the lower-cased (A-Z) text's 3-word shingles. component_id:
    the smallest id reachable over links of 3 or fewer differing bits, itself included. Null and blank
    texts have fingerprint 0 and link like any other. Repeated rows and ids each keep their row; an id on
    unlike texts stands in each one's component. Ids may be of any type that can be sorted. Rows whose id
    is null take the component of their fingerprint (null if no other row has it), but link no others.
    Other columns don't matter. An empty table gives an empty result.
    """
    fps = fingerprints(df, text, (id_col,)).withColumnRenamed(id_col, "_id")
    return _labelled(fps).select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _labelled(fps: DataFrame) -> DataFrame:
    """(_id, fp) with c, the least fingerprint of the row's component, and component_id, the least id."""
    shared_dir(fps.sparkSession)
    fps = fps.checkpoint()
    classes = fps.groupBy("fp").agg(F.min("_id").alias("least"))
    found = connected_components(links(classes.filter("least is not null").select(F.col("fp").alias("v"), "fp"))).withColumnRenamed("v", "fp")
    label = classes.join(found, "fp", "left").select("fp", F.coalesce("component", "fp").alias("c"), "least")
    least = label.groupBy("c").agg(F.min("least").alias("component_id"))
    # keys are wrapped, so that Spark can split a component or a fingerprint of many rows
    label = label.withColumn("k", F.struct("c")).join(least.select(F.struct("c").alias("k"), "component_id"), "k").select(F.struct("fp").alias("k"), "c", "component_id")
    return fps.withColumn("k", F.struct("fp")).join(label, "k").drop("k")


def keep_one(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """df's rows with one left of each component: of the rows of its smallest id that of the least fingerprint, then row hash.

    An id that stands on unlike texts can so be left several times, once for each component whose smallest
    it is. Rows whose id is null stay; an empty table gives none; all columns stay, whatever their names.
    """
    named = df.filter(F.col(id_col).isNotNull()).select(F.struct("*").alias("_doc"), F.col(id_col).alias("_id"), F.col(text).alias("_t"))
    found = _labelled(fingerprints(named, "_t", ("_id",)))
    kept = found.filter("_id = component_id").groupBy("c").agg(F.min(F.struct("_id", "fp")).alias("r")).select("r._id", "r.fp")
    rows = fingerprints(named, "_t", ("_doc", "_id")).join(kept, ["_id", "fp"], "left_semi")
    place = F.row_number().over(Window.partitionBy("_id", "fp").orderBy(F.xxhash64("_doc")))
    return rows.withColumn("_n", place).filter("_n = 1").select("_doc.*").unionByName(df.filter(F.col(id_col).isNull()))
