"""Near-duplicates by the Jaccard similarity of five-word shingle sets, at 0.8 or more.

SimHash fingerprints and MinHash bands only find candidates; whether two texts are linked is decided on
their whole shingle sets. Texts whose fingerprints lie within three bits, in one step or several, are one
bucket. Three bits are too few for most pairs near 0.8, which the bands find: two sets of similarity s share
one with a chance of 1 - (1 - s^5)^32: 0.999997 at 0.8. Equal sets are one class throughout, and a bucket
passes on a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .components import connected_components
from .simhash import _LOWER, SEED
from .text import shared_dir, slices

WORDS, ROWS, BANDS = 5, 5, 32
#: Buckets of more shingles than this are cut into pieces.
PIECE = 1 << 19
_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, (2, ROWS * BANDS), np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles(text: bytes, most: int = WORDS) -> np.ndarray:
    """The distinct hashes of a lower-cased (A-Z) UTF-8 text's shingles of `most` words, sorted; of all its words where it has fewer."""
    words = text.translate(_LOWER).split()
    size = min(most, len(words))
    if not size:
        return np.empty(0, np.uint64)
    h = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        out = _mix(out + h[i : len(h) - size + 1 + i])
    return np.unique(out)


def minima(found: np.ndarray) -> np.ndarray:
    """BANDS rows of ROWS minima of a shingle set, each under a hash function of its own."""
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 4096):
        np.minimum(least, ((found[i : i + 4096, None] + _ODD[0]) * _ODD[1]).min(0), out=least)
    return least.reshape(BANDS, ROWS)


def bands(found: np.ndarray) -> np.ndarray:
    """One signed key per band of a shingle set's minima."""
    out = np.arange(BANDS, dtype=np.uint64)
    for column in minima(found).T:
        out = _mix(out + column)
    return out.view(np.int64)


def alike(shared: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | bool:
    """Whether sets of a and b members, of which they share some, have a Jaccard similarity of 0.8 or more."""
    return 9 * shared >= 4 * (a + b)


def forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges (i, j) of a spanning forest of the links among sets."""
    sizes = np.array([len(s) for s in sets])
    if len(sets) == 2:
        return [(0, 1)] if alike(len(np.intersect1d(*sets, assume_unique=True)), *sizes) else []
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    own, mark = np.split(flat, ends[:-1]), np.zeros(len(names), bool)
    edges, left = [], np.arange(len(sets))
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = left[alike(np.minimum(sizes[left], sizes[at]), sizes[left], sizes[at])]
            if not len(near):
                continue
            mark[own[at]] = True
            starts = np.r_[0, np.cumsum(sizes[near])[:-1]]
            shared = np.add.reduceat(mark[np.concatenate([own[i] for i in near])].astype(np.int64), starts)
            mark[own[at]] = False
            found = near[alike(shared, sizes[near], sizes[at])].tolist()
            edges += [(at, x) for x in found]
            queue += found
            left = np.setdiff1d(left, found, assume_unique=True)
    return edges


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by unit (columns: unit, key, members) to links (u, v); one unit is held."""
    unit, keys, sets = None, [], []

    def result() -> pa.RecordBatch:
        edges = forest(sets) if len(sets) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([keys[e[i]] for e in edges], pa.int64()) for i in (0, 1)], names=["u", "v"])

    for batch in slices(batches, "members"):
        for at, key, members in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if at != unit:
                yield result()
                unit, keys, sets = at, [], []
            keys.append(key)
            sets.append(np.frombuffer(members, np.uint64))
    yield result()


def _text_hash(text: str) -> Column:
    return F.xxhash64(text)


def sketches(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, th, key, n, bands, fp) of each row: the text's hash, its shingle set's hash and size, the bands, and the fingerprint. No shuffle."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            sets, fps = [shingles(t or b"") for t in texts], [simhash.fingerprint(t or b"") for t in texts]
            keys = [xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets]
            key = pa.array(np.array(keys, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), key, pa.array([len(s) for s in sets], pa.int64()), pa.array([bands(s) if len(s) else [] for s in sets], pa.list_(pa.int64())), pa.array(fps, pa.int64())], names=[id_col, "th", "key", "n", "bands", "fp"])

    return df.select(id_col, _text_hash(text).alias("th"), F.col(text).alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, th bigint, key bigint, n bigint, bands array<bigint>, fp bigint")


def _members(texts: DataFrame, most: int) -> DataFrame:
    """(key, members): each text's shingle set, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            sets = [shingles(t, most).tobytes() for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["key", "members"])

    return texts.select("key", "_text").mapInArrow(run, "key bigint, members binary")


def links(df: DataFrame, rows: DataFrame, id_col: str, text: str) -> DataFrame:
    """(u, v) that link the classes of rows (sketches of df) into the components of all found pairs at 0.8 or more."""
    own = rows.filter(F.col(id_col).isNotNull() & (F.col("n") > 0))
    banded = own.dropDuplicates(["key"]).select("key", "n", F.explode("bands").alias("k"))
    return bucket_links(df, own, banded.unionByName(fingerprint_buckets(own)), id_col, text)


def fingerprint_buckets(own: DataFrame) -> DataFrame:
    """(key, n, k): of each class the bucket k of the component of its fingerprint, by links of simhash.MAX_BITS or fewer bits."""
    found = connected_components(simhash.links(own.select(F.col("fp").alias("v"), "fp").distinct())).withColumnRenamed("v", "fp")
    label = own.select("key", "n", "fp").distinct().join(found, "fp", "left")
    return label.select("key", "n", F.xxhash64(F.lit("fingerprints"), F.coalesce("component", "fp")).alias("k")).distinct()


def bucket_links(df: DataFrame, own: DataFrame, keys: DataFrame, id_col: str, text: str, most: int = WORDS) -> DataFrame:
    """(u, v) that link classes into the components of all pairs at 0.8 or more that share a bucket.

    keys: (key, n, k) of each class and bucket k. own: (id, th, key) of the rows of df that stand for classes.
    most: words of a shingle. A bucket of over PIECE shingles is cut into pieces: each is searched by itself
    and with the bucket's first class, and only classes that this doesn't tie to it meet all pieces.
    """
    spark, folder = df.sparkSession, shared_dir(df.sparkSession)
    # buckets of one class end here, and of those with the same members (told by hashes) one is left
    h = F.xxhash64("key")
    shared = keys.groupBy("k").agg(F.count("*").alias("c"), F.sum("n").alias("total"), F.min("key").alias("a"), F.max("key").alias("b"), F.bit_xor("key").alias("x"), F.bit_xor(h).alias("y"))
    shared = shared.filter("c > 1").groupBy("c", "total", "a", "b", "x", "y").agg(F.min("k").alias("k")).select("k", "a", F.ceil(F.col("total") / PIECE).alias("pieces"))
    keys.join(shared, "k").select("k", "a", "pieces", "key").write.parquet(f"{folder}/buckets")
    buckets = spark.read.parquet(f"{folder}/buckets")
    # one row that has the text stands for its class; classes are reduced before the join, so that no row of a large one moves
    first = own.groupBy("key").agg(F.min(F.struct(id_col, "th")).alias("r")).join(buckets.select("key").distinct(), "key", "left_semi").select("key", F.col(f"r.{id_col}").alias(id_col), "r.th")
    texts = df.select(id_col, _text_hash(text).alias("th"), F.col(text).alias("_text")).join(first, [id_col, "th"])
    _members(texts, most).dropDuplicates(["key"]).write.parquet(f"{folder}/members")
    sets = spark.read.parquet(f"{folder}/members")

    def linked(units: DataFrame) -> DataFrame:
        rows = units.join(sets, "key").select("unit", "key", "members")
        return rows.repartition("unit").sortWithinPartitions("unit").mapInArrow(_links, "u bigint, v bigint")

    # each piece by itself, with the bucket's first class, which ties the pieces of a group together
    piece = F.pmod(F.xxhash64("key"), F.col("pieces"))
    everywhere = F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1)
    own_piece = buckets.select("k", "key", piece.alias("p"))
    leaders = buckets.filter("key = a and pieces > 1").select("k", "key", F.explode(everywhere).alias("p"))
    found = linked(own_piece.unionByName(leaders).distinct().select(F.xxhash64("k", "p").alias("unit"), "key"))
    large = buckets.filter("pieces > 1")
    if large.isEmpty():
        return found
    found.write.parquet(f"{folder}/within")
    found = spark.read.parquet(f"{folder}/within")
    # what is not yet tied to its bucket's first class meets every piece; such rows are few where a group is tight
    label = connected_components(found).withColumnRenamed("v", "key")
    first = large.filter("key = a").join(label, "key", "left").select("k", F.coalesce("component", "key").alias("main"))
    apart = large.join(label, "key", "left").join(first, "k").filter(F.coalesce("component", "key") != F.col("main")).join(keys.select("key", "n").distinct(), "key")
    apart = apart.select("k", "key", "pieces", "n")
    apart.write.parquet(f"{folder}/apart")
    apart = spark.read.parquet(f"{folder}/apart")
    parts = apart.groupBy("k").agg(F.ceil(F.sum("n") / PIECE).alias("parts"))
    part = F.pmod(F.xxhash64("key", F.lit(1)), F.col("parts"))
    alone = apart.join(parts, "k").select("k", part.alias("q"), F.explode(everywhere).alias("p"), "key")
    others = large.join(parts, "k").select("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("q"), piece.alias("p"), "key")
    return found.unionByName(linked(alone.unionByName(others).distinct().select(F.xxhash64("k", "q", "p").alias("unit"), "key")))


def components(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, th, component) of every row: th hashes the text, rows of linked texts have the same component.

    Null and blank texts are one component. Rows whose id is null link no others. Repeated rows each keep
    theirs; other columns don't matter; an empty table gives an empty result. df's id and text columns are
    read by name and may have any but th, key, n, bands and fp.
    """
    shared_dir(df.sparkSession)
    rows = sketches(df, id_col, text).checkpoint()
    found = connected_components(links(df, rows, id_col, text)).withColumnRenamed("v", "key")
    label = rows.select("key").distinct().join(found, "key", "left").select(F.struct("key").alias("k"), F.coalesce("component", "key").alias("component"))
    return rows.withColumn("k", F.struct("key")).join(label, "k").select(id_col, "th", "component")


def keep_one(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """df's rows with one left of each component: that of the smallest id (then text hash, then row hash). Rows whose id is null stay.

    Null and blank texts are copies of each other; of repeated rows one is left. All columns stay as they
    are, whatever their names; an empty table gives none.
    """
    named = df.filter(F.col(id_col).isNotNull()).select(F.struct("*").alias("_doc"), F.col(id_col).alias("_id"), F.col(text).alias("_t"))
    found = components(named, "_id", "_t")
    kept = found.groupBy("component").agg(F.min(F.struct("_id", "th")).alias("r")).select("r._id", "r.th")
    rows = named.withColumn("th", _text_hash("_t")).join(kept, ["_id", "th"], "left_semi")
    place = F.row_number().over(Window.partitionBy("_id", "th").orderBy(F.xxhash64("_doc")))
    return rows.withColumn("_n", place).filter("_n = 1").select("_doc.*").unionByName(df.filter(F.col(id_col).isNull()))
