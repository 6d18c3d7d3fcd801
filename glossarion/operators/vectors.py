"""Word vectors: exact nearest neighbours in blocks, centroids, similarity to glossary words, pooling."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type as _arrow_type
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..functions.scalar import dot, l2_normalise, scrub
from ..sources.files import shared_folder, written
from .units import STEP, Largest, held_by, meet

#: Digits to which similarities are rounded before they are compared.
DIGITS = 10
#: Expected targets whose matrix a task holds.
TARGETS = 4096
#: So many of a word's largest similarities are put in order for all keys; a key that has too few of them looks at all of its own.
FIRST = 64
#: Expected words that ask in a unit, and words that they meet at once.
_QUERY_BLOCK, _BLOCK = 32768, 8192


def unit_vectors(df: DataFrame, word: str = "word", vector: str = "vector") -> DataFrame:
    """(word, v): vectors with bad cells set to 0, at length 1; null vectors are left out."""
    return df.filter(F.col(vector).isNotNull()).select(F.col(word).alias("word"), l2_normalise(scrub(vector)).alias("v"))


def keep_one(df: DataFrame, key: str, order: Sequence, last: bool = False) -> DataFrame:
    """The first (or last) row of each key in a given order."""
    by = [F.desc(c) if last else F.asc(c) for c in order]
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*by))).filter("_rn = 1").drop("_rn")


def _set(mask: np.ndarray) -> np.ndarray:
    """np.flatnonzero of a mask that is mostly false: eight cells are looked at together."""
    flat = mask.ravel()
    whole = len(flat) // 8 * 8
    some = np.flatnonzero(flat[:whole].view(np.uint64))[:, None] * 8 + np.arange(8)
    return np.r_[some[flat[some]], whole + np.flatnonzero(flat[whole:])]


def _nearest(rows: DataFrame, k: int) -> DataFrame:
    """(query, nword, cossim): for rows (g, slot, asks, word, v), the k best of each unit (g, slot) for each word that asks there.

    With a sixth column `cells` a word is met by those only that ask for its cell: own cell as four bytes, and of
    words that ask the cells as packed bits after it. Products in single precision leave out what can't be
    among the k best, by a bound on their error; the others are taken anew in double.
    """
    masked = "cells" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by group and slot, words that ask first."""
        unit, held = None, []
        names = vecs = single = length = top = who = bits = None
        place: dict[str, int] = {}

        def matrix() -> tuple[np.ndarray, np.ndarray, list[bytes]]:
            words = np.concatenate([b.column(3).to_numpy(zero_copy_only=False) for b in held])
            flat = np.concatenate([b.column(4).flatten().to_numpy() for b in held])
            cells = [c for b in held for c in b.column(5).to_pylist()] if masked else []
            held.clear()
            return words, flat.reshape(len(words), -1), cells

        def own(cells: list[bytes]) -> np.ndarray:
            return np.frombuffer(b"".join(c[:4] for c in cells), "<i4")

        def take(a: int, sims: np.ndarray, words: np.ndarray, block: np.ndarray, most: float) -> None:
            """Merge products of the words that ask from place a on into their k best; ties by word.

            sims: the products with the rows of block in single precision; most: the longest of these rows.
            """
            low = top[a : a + len(sims), -1].copy()
            error = (block.shape[1] + 8) * 2.0**-23 * most * length[a : a + len(sims)]
            fresh = np.flatnonzero(low == -np.inf)
            if len(fresh) and sims.shape[1] > k:
                low[fresh] = np.partition(sims[fresh], -k, axis=1)[:, -k] - error[fresh]
            # what can be among the k best once it is rounded, ties included; most products end here
            least = (low - error - 10.0 ** (1 - DIGITS)).astype(np.float32)
            some = _set(sims >= np.nextafter(least, np.float32(-np.inf))[:, None])
            some = some[sims.ravel()[some] > -np.inf]
            if not len(some):
                return
            row, at = np.divmod(some, sims.shape[1])
            some = np.concatenate([np.einsum("ij,ij->i", vecs[a + row[i : i + 65536]], block[at[i : i + 65536]]) for i in range(0, len(row), 65536)])
            asks = np.unique(row)
            r, s, w = np.r_[np.repeat(asks, k), row], np.r_[top[a + asks].ravel(), np.round(some, DIGITS)], np.r_[who[a + asks].ravel(), words[at]]
            order = np.lexsort((-s, r))
            r, s, w = r[order], s[order], w[order]
            starts = np.searchsorted(r, asks)
            ends = np.r_[starts[1:], len(r)]
            for i in np.searchsorted(asks, np.unique(r[1:][(r[1:] == r[:-1]) & (s[1:] == s[:-1]) & (s[1:] > -np.inf)])):
                tied = slice(starts[i], ends[i])
                best = sorted(range(tied.start, tied.stop), key=lambda j: (-s[j], w[j]))
                s[tied], w[tied] = s[best], w[best]
            first = np.arange(len(r)) - np.repeat(starts, ends - starts) < k
            top[a + asks], who[a + asks] = s[first].reshape(-1, k), w[first].reshape(-1, k)

        def close() -> None:
            """Take in what is held: the unit's words that ask, or a block of others."""
            nonlocal names, vecs, single, length, top, who, bits
            if not held:
                return
            if unit[2]:
                names, vecs, cells = matrix()
                if masked:  # words of a cell ask for like cells
                    order = np.argsort(own(cells), kind="stable")
                    names, vecs = names[order], vecs[order]
                    bits = np.unpackbits(np.frombuffer(b"".join(cells[i][4:] for i in order), np.uint8).reshape(len(cells), -1), axis=1).view(bool)
                single, length = vecs.astype(np.float32), np.linalg.norm(vecs, axis=1)
                place.clear()
                place.update((w, i) for i, w in enumerate(names))
                top, who = np.full((len(names), k), -np.inf), np.full((len(names), k), "", object)
                return
            words, block, cells = matrix()
            if names is None:
                return
            cells = own(cells)
            same = [(i, j) for j, w in enumerate(words) if (i := place.get(w)) is not None]
            mine, here = np.array(same, int).reshape(-1, 2).T
            short, most = block.astype(np.float32), np.linalg.norm(block, axis=1).max()
            for a in range(0, len(names), 256):
                near = slice(None)
                if masked:
                    near = np.flatnonzero(bits[a : a + 256].any(0)[cells])
                    if not len(near):
                        continue
                sims = single[a : a + 256] @ short[near].T
                if masked:
                    sims[~bits[a : a + 256][:, cells[near]]] = -np.inf
                self_ = (mine >= a) & (mine < a + 256)
                at = here[self_] if not masked else np.searchsorted(near, here[self_])
                found = at < sims.shape[1] if not masked else (at < len(near)) & (near[np.minimum(at, len(near) - 1)] == here[self_])
                sims[(mine[self_] - a)[found], at[found]] = -np.inf
                take(a, sims, words[near], block[near], most)

        def result() -> Iterator[pa.RecordBatch]:
            for a in range(0, len(names), _BLOCK):
                best, words = top[a : a + _BLOCK], who[a : a + _BLOCK]
                found = best > -np.inf
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names[a : a + _BLOCK], found.sum(1)), pa.string()), pa.array(words[found], pa.string()), pa.array(best[found])], names=["query", "nword", "cossim"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            starts = np.flatnonzero(np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in keys])])
            for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                here = tuple(c[a].item() for c in keys)
                if here != unit:
                    close()
                    if unit is not None and here[:2] != unit[:2]:
                        if names is not None:
                            yield from result()
                        names = None
                    unit = here
                held.append(batch.slice(a, b - a))
                if not unit[2] and sum(h.num_rows for h in held) >= _BLOCK:
                    close()
        close()
        if names is not None:
            yield from result()

    rows = rows.repartition("g", "slot").sortWithinPartitions("g", "slot", F.desc("asks"))
    return rows.mapInArrow(run, "query string, nword string, cossim double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cossim"), "nword"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query", "rank", "nword", "cossim")


def knn(vectors: DataFrame, k: int, queries: DataFrame | None = None) -> DataFrame:
    """(query, rank, nword, cossim): the k nearest other words of each word by cosine, ties by word. Exact.

    vectors, queries: (word, v) at unit length, one row per word, vectors of one length. Queries come in
    groups of a bounded expected size; each group meets every block of words once, in a task that keeps
    k rows per query. Work is the product of both sizes; rows passed on grow with their sum.
    """
    queries = vectors if queries is None else queries
    groups = max(1, -(-queries.count() // _QUERY_BLOCK))
    count, cores = vectors.count(), vectors.sparkSession.sparkContext.defaultParallelism
    # runs of one block or less where few groups would leave cores idle, of eight blocks where there are many
    slots = max(1, -(-count // (8 * _BLOCK)), min(-(-count // 256), -(-2 * cores // groups)))
    q = queries.select(F.pmod(F.xxhash64("word"), F.lit(groups)).cast("int").alias("g"), F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"), F.lit(True).alias("asks"), "word", "v")
    x = vectors.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.pmod(F.xxhash64("word", F.lit(1)), F.lit(slots)).cast("int").alias("slot"), F.lit(False).alias("asks"), "word", "v")
    return _ranked(_nearest(q.unionByName(x), k), k)


def knn_lsh(vectors: DataFrame, k: int, bucket: float | None = None, tables: int = 10, seed: int = 42) -> DataFrame:
    """knn() by random projections: (query, rank, nword, cossim), approximate; every list is as long as knn()'s.

    A word meets the words of its bucket in each table, in units of a bounded expected size that keep k rows
    per query. bucket: 0.8 of the projections' spread if None, so that ten tables find 0.9 of the neighbours
    even where these are hardly nearer than other words. Lists that stay short are searched by knn().
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH

    if bucket is None:
        spread = vectors.select(F.posexplode("v").alias("dim", "x")).groupBy("dim").agg(F.var_pop("x").alias("x")).agg(F.sqrt(F.avg("x"))).first()[0]
        bucket = 0.8 * spread if spread else 1.0
    rows = vectors.select("word", array_to_vector("v").alias("features"), "v")
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=seed).fit(rows)
    hashed = model.transform(rows).select("word", "v", F.posexplode("hashes").alias("t", "h")).withColumn("h", vector_to_array("h")[0])
    parts = hashed.groupBy("t", "h").agg(F.ceil(F.count("*") / (8 * _BLOCK)).cast("int").alias("parts"))
    hashed = hashed.join(parts, ["t", "h"]).withColumn("own", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    q = hashed.select(F.xxhash64("t", "h", "own").alias("g"), each.alias("slot"), F.lit(True).alias("asks"), "word", "v")
    x = hashed.withColumn("p", each).select(F.xxhash64("t", "h", "p").alias("g"), F.col("own").alias("slot"), F.lit(False).alias("asks"), "word", "v")
    folder = shared_folder(vectors.sparkSession)
    _ranked(_nearest(q.unionByName(x), k).distinct(), k).write.parquet(folder)
    found = vectors.sparkSession.read.parquet(folder)
    whole = found.groupBy("query").count().filter(F.col("count") >= min(k, vectors.count() - 1)).select(F.col("query").alias("word"))
    short = vectors.join(whole, "word", "left_anti")
    if short.isEmpty():
        return found
    return found.join(whole.withColumnRenamed("word", "query"), "query", "left_semi").unionByName(knn(vectors, k, short)).select("query", "rank", "nword", "cossim")


def _centres(x: np.ndarray, cells: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Unit vectors in whose cells the rows of x lie: k-means by cosine from seeded rows."""
    centres = x[np.random.default_rng(seed).choice(len(x), cells, replace=False)]
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.where(length > 0, length, 1), centres)
    return centres


def knn_cells(vectors: DataFrame, k: int, cells: int | None = None, recall: float = 0.95, seed: int = 42, sample: int = 1 << 16, asked: int = 256) -> tuple[DataFrame, DataFrame]:
    """knn() over cells: (query, rank, nword, cossim), approximate, and (cell, words, queries), what was compared.

    Cells lie around centres, root of the number of words by default and 4,096 at most, that are found on the
    first `sample` words of a hashed order; every word belongs to the nearest centre's. A cell's radius bounds
    how near its words can be to a query, and a query is compared with the cells of the highest bounds. In how
    many is measured: for `asked` words, searched exactly, it is the least number that holds `recall` of
    their true neighbours. Where neighbours are hardly nearer than other words that is most of the cells.
    """
    spark = vectors.sparkSession
    vectors = written(vectors.select("word", "v"))
    n, order = vectors.count(), F.xxhash64(F.lit(seed), "word")
    first = vectors.orderBy(order, "word").limit(sample).toArrow()
    if n < 2:
        return knn(vectors, k), spark.createDataFrame([], "cell int, words bigint, queries bigint")
    x = np.array(first.column("v").to_pylist(), float)
    centres = _centres(x, min(cells or min(4096, int(n**0.5)), len(x)), seed)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sims = _matrix(batch.column(1)) @ centres.T
                own = sims.argmax(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(sims[np.arange(len(own)), own])], names=["word", "v", "cell", "near"])

    held = written(vectors.mapInArrow(assign, "word string, v array<double>, cell int, near double"))
    sizes = {r["cell"]: (r["c"], r["near"]) for r in held.groupBy("cell").agg(F.count("*").alias("c"), F.min("near").alias("near")).collect()}
    reach = np.array([np.arccos(np.clip(sizes[i][1], -1, 1)) if i in sizes else -np.inf for i in range(len(centres))])

    def ranked(v: np.ndarray) -> np.ndarray:
        """Cells in the order of the least angle that a word of them can have; empty ones last."""
        return np.argsort(np.maximum(0, np.arccos(np.clip(v @ centres.T, -1, 1)) - reach), axis=1, kind="stable")

    some = vectors.orderBy(order, "word").limit(asked)
    names = [r["word"] for r in some.select("word").collect()]
    true = knn(vectors, k, some).join(held.select(F.col("word").alias("nword"), "cell"), "nword").select("query", "cell").collect()
    at = np.argsort(ranked(x[: len(names)]), axis=1)  # each cell's place
    row = {w: i for i, w in enumerate(first.column("word").to_pylist()[: len(names)])}
    places = np.sort([at[row[r["query"]], r["cell"]] for r in true])
    probes = int(places[min(len(places) - 1, int(np.ceil(recall * len(places))) - 1)]) + 1

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                near = ranked(_matrix(part.column(1)))[:, :probes].astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, near.shape[1], dtype=np.int32)), pa.array(near.ravel()))], names=["word", "v", "cells"])

    asks = vectors.mapInArrow(ask, "word string, v array<double>, cells array<int>")
    count = asks.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("queries"))
    compared = written(held.groupBy("cell").agg(F.count("*").alias("words")).join(count, "cell"))
    # units of a bounded expected size, as in knn: words carry their cell, words that ask the cells that they ask for
    groups, slots = max(1, -(-n // _QUERY_BLOCK)), max(1, -(-n // (8 * _BLOCK)), -(-2 * spark.sparkContext.defaultParallelism // max(1, -(-n // _QUERY_BLOCK))))
    width = -(-len(centres) // 8) * 8

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                near = ranked(_matrix(part.column(1)))[:, :probes]
                bits = np.zeros((len(near), width), bool)
                np.put_along_axis(bits, near, True, axis=1)
                cells = [c.tobytes() + b.tobytes() for c, b in zip(part.column(2).to_numpy().astype("<i4"), np.packbits(bits, axis=1), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cells, pa.binary())], names=["word", "v", "cells"])

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [c.tobytes() for c in batch.column(2).to_numpy().astype("<i4")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells, pa.binary())], names=["word", "v", "cells"])

    kind, rows = "word string, v array<double>, cells binary", held.select("word", "v", "cell")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    q = rows.mapInArrow(packed, kind).select(F.pmod(F.xxhash64("word"), F.lit(groups)).cast("int").alias("g"), every(slots).alias("slot"), F.lit(True).alias("asks"), "word", "v", "cells")
    w = rows.mapInArrow(single, kind).select(every(groups).alias("g"), F.pmod(F.xxhash64("word", F.lit(1)), F.lit(slots)).cast("int").alias("slot"), F.lit(False).alias("asks"), "word", "v", "cells")
    return _ranked(_nearest(q.unionByName(w), k), k), compared


def _mean(vector: str) -> Column:
    """Mean of arrays of one length, component by component; tasks sum whole vectors before the shuffle."""
    return vector_to_array(Summarizer.mean(array_to_vector(F.transform(vector, lambda x: x.cast("double")))))


def centroids(vectors: DataFrame, members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, c): the mean of the members' vectors at unit length; keys without a vector or of mean zero are left out.

    Members are many rows of few bytes on disk, by which Spark would broadcast them; they are sorted and merged instead.
    """
    means = members.select(*keys, "word").hint("merge").join(vectors, "word").groupBy(*keys).agg(_mean("v").alias("c"))
    return means.filter(dot("c", "c") > 0).withColumn("c", l2_normalise("c"))


def _products(vectors: DataFrame, targets: DataFrame, names: Sequence[str], blank: str | None = None) -> DataFrame:
    """(names, word, cossim): rounded inner products of every word (word, v) with every target (names, c).

    The targets are the stated query set. They are taken in groups of at most about TARGETS rows, whose
    matrix goes to each task once and is multiplied block by block; more groups mean more passes over
    vectors. blank: where a target's column of that name is the word, the product is -1.
    """
    schema = StructType([*targets.select(*names).schema.fields, StructField("word", StringType()), StructField("cossim", DoubleType())])
    targets = written(targets.select(*names, "c"))
    groups, found = max(1, -(-targets.count() // TARGETS)), None
    for g in range(groups):
        part = targets.filter(F.pmod(F.xxhash64(*names), F.lit(groups)) == g).orderBy(*names).toArrow()
        matrix, labels = np.array(part.column("c").to_pylist(), float), part.select(list(names))

        def run(batches: Iterator[pa.RecordBatch], matrix=matrix, labels=labels) -> Iterator[pa.RecordBatch]:
            own = np.array(labels.column(blank).to_pylist(), object) if blank else None
            for batch in batches:
                for a in range(0, batch.num_rows if len(matrix) else 0, 1024):
                    rows = batch.slice(a, 1024)
                    words = rows.column(0).to_pylist()
                    sims = np.round(np.array(rows.column(1).to_pylist()) @ matrix.T, DIGITS)
                    if blank:
                        sims[np.array(words, object)[:, None] == own] = -1.0
                    at = pa.array(np.tile(np.arange(len(matrix)), len(words)))
                    columns = [labels.column(n).combine_chunks().take(at) for n in names]
                    yield pa.RecordBatch.from_arrays([*columns, rows.column(0).take(pa.array(np.repeat(np.arange(len(words)), len(matrix)))), pa.array(sims.ravel())], names=[*names, "word", "cossim"])

        sims = vectors.select("word", "v").mapInArrow(run, schema)
        found = sims if found is None else found.unionByName(sims)
    return found


def centroid_similarity(vectors: DataFrame, centres: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, word, csim): every word's cosine with each key's centroid."""
    return _products(vectors, centres, keys).withColumnRenamed("cossim", "csim")


def glossary_similarity(vectors: DataFrame, glossary: DataFrame, blank_self: bool = False) -> DataFrame:
    """(word, gword, cossim) of every word with every glossary word that has a vector. blank_self: a word's similarity to itself is -1."""
    targets = glossary.select("word").distinct().join(vectors, "word").select(F.col("word").alias("gword"), F.col("v").alias("c"))
    return _products(vectors, targets, ["gword"], "gword" if blank_self else None).select("word", "gword", "cossim")


class Near:
    """Of a unit's words (units.meet) the sum and the k largest similarities to each key's members; a member without a vector has no part."""

    def __init__(self, words: pa.Array, vectors: pa.Array, keys: int, k: int, blank_self: bool = False, first: int | None = None):
        self.names, self.x, self.blank = words.to_pylist() if blank_self else [], _matrix(vectors), blank_self
        self.n, self.total = np.zeros(keys, np.int64), np.zeros((len(self.x), keys))
        self.best = Largest(len(self.x), keys, k, first or FIRST)

    def add(self, words: pa.Array, vectors: pa.Array, holds: np.ndarray) -> None:
        known = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
        if not len(known):
            return
        holds, block, place = holds[known], _matrix(vectors.drop_null()), {}
        if self.blank:
            place = {w: j for j, w in enumerate(words.take(pa.array(known)).to_pylist())}
        mine, here = np.array([(i, place[w]) for i, w in enumerate(self.names) if w in place], int).reshape(-1, 2).T
        self.n += holds.sum(0)
        weights = holds.astype(float)
        for a in range(0, len(self.x), STEP):
            sims = np.round(self.x[a : a + STEP] @ block.T, DIGITS)
            own = (mine >= a) & (mine < a + STEP)
            sims[mine[own] - a, here[own]] = -1.0
            self.total[a : a + STEP] += sims @ weights
            self.best.add(a, sims, holds)

    def result(self, a: int, b: int) -> tuple[list[np.ndarray], np.ndarray]:
        """Largest, mean and summed k largest."""
        top = self.best.top[a:b]
        sums = np.zeros(top.shape[:2])
        for i in range(top.shape[2] - 1, -1, -1):  # from the largest on, as SQL sums a sorted list
            sums += np.where(top[:, :, i] > -np.inf, top[:, :, i], 0.0)
        return [top[:, :, -1], self.total[a:b] / np.maximum(self.n, 1), sums], np.broadcast_to(self.n > 0, sums.shape)


def member_features(vectors: DataFrame, members: DataFrame, keys: Sequence[str], k: int = 10, blank_self: bool = False) -> DataFrame:
    """(keys, word, mindist_all, avgdist_all, votetopk_all): largest, mean and summed k largest similarity of every word to a key's members.

    vectors: (word, v); members: (keys, word), those without a vector have no part. Words in units meet the
    members in blocks (units.meet); a block's products are reduced for each key at once, so that no pair of words
    is a row, and a unit has met all members before it yields rows, however many they are. At most TARGETS of
    them go to every task without a shuffle. blank_self: a word's similarity to itself is -1.
    """
    keys, first = list(keys), FIRST
    held, cells = held_by(written(members.select(*keys, "word").distinct()), keys)
    schema = StructType([*members.select(*keys).schema.fields, StructField("word", StringType()), *[StructField(c, DoubleType()) for c in ("mindist_all", "avgdist_all", "votetopk_all")]])

    class Met(Near):
        def __init__(self, words: pa.RecordBatch):
            super().__init__(words.column(0), words.column(1), len(cells), k, blank_self, first)

        def add(self, members: pa.RecordBatch, holds: np.ndarray) -> None:
            super().add(members.column(0), members.column(1), holds)

    known = held.join(vectors.select("word", "v"), "word")
    return meet(vectors.select("word", "v"), known, cells, schema, Met, len(cells) * (k + 1), TARGETS)


def lowest(vectors: DataFrame, centres: DataFrame, keys: Sequence[str], size: str) -> DataFrame:
    """(keys, word, csim): for each key the words of lowest similarity to its centroid, as many as `size` says, ties by word.

    centres: (keys, c, size), the stated set, which goes to each task. A task passes on that many words of
    each key and no more.
    """
    keys = list(keys)
    rows = centres.select(*keys, "c", F.col(size).alias("_size")).orderBy(*keys).toArrow()
    names, sizes = rows.select(keys), [int(x) for x in rows.column("_size").to_pylist()]
    matrix = np.array(rows.column("c").to_pylist(), float).reshape(len(sizes), -1)
    schema = StructType([*centres.select(*keys).schema.fields, *StructType.fromDDL("word string, csim double").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.empty(0), np.empty(0, object)) for _ in sizes]
        for batch in batches:
            for a in range(0, batch.num_rows if len(sizes) else 0, 1024):
                part = batch.slice(a, 1024)
                words = np.array(part.column(0).to_pylist(), object)
                sims = np.round(np.array(part.column(1).to_pylist()) @ matrix.T, DIGITS)
                for i, m in enumerate(sizes):
                    s, w = np.r_[best[i][0], sims[:, i]], np.r_[best[i][1], words]
                    if len(s) > m:
                        near = np.flatnonzero(s <= np.partition(s, m - 1)[m - 1]) if m else []
                        order = sorted(near, key=lambda j: (s[j], w[j]))[:m]
                        s, w = s[order], w[order]
                    best[i] = s, w
        counts = [len(s) for s, _ in best]
        at = pa.array(np.repeat(np.arange(len(sizes)), counts))
        fixed = [names.column(c).combine_chunks().take(at) if len(sizes) else pa.array([], _arrow_type(schema[c].dataType)) for c in keys]
        columns = [pa.array(np.concatenate([w for _, w in best]) if best else [], pa.string()), pa.array(np.concatenate([s for s, _ in best]) if best else [], pa.float64())]
        yield pa.RecordBatch.from_arrays([*fixed, *columns], names=schema.names)

    found = vectors.select("word", "v").mapInArrow(run, schema).join(centres.select(*keys, F.col(size).alias("_size")), keys)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("csim", "word"))
    return found.withColumn("_rn", rank).filter("_rn <= _size").select(*keys, "word", "csim")


def _runs(*columns: pa.Array) -> np.ndarray:
    """Where runs of equal rows begin."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= pa.compute.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _vectors(matrix: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, matrix.size + 1, max(1, matrix.shape[1]), dtype=np.int32)), pa.array(matrix.ravel()))


def pool_occurrences(tokens: DataFrame, table: int = 1 << 15) -> DataFrame:
    """(word, vector, cnt) from sub-token vectors (occurrence, word, vector): mean per occurrence, then per lower-cased word, at unit length.

    Sums are taken in numpy. Neighbouring rows of an occurrence are summed before the first shuffle; after
    it a task sums its occurrences' means by word, in a table of at most `table` words that is passed on when
    it is full; the second shuffle moves these sums. Rows without an occurrence, word or vector are left out.
    """
    rows = tokens.filter("occurrence is not null and word is not null and vector is not null")
    rows = rows.select(F.col("occurrence").cast("string").alias("occurrence"), F.lower("word").alias("word"), F.col("vector").cast("array<double>").alias("vector"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(occurrence, word, total, n) of runs."""
        for batch in batches:
            if batch.num_rows:
                at = _runs(batch.column(0), batch.column(1))
                sums = np.add.reduceat(_matrix(batch.column(2)), at, axis=0)
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in batch.columns[:2]), _vectors(sums), pa.array(np.diff(np.r_[at, batch.num_rows]))], names=["occurrence", "word", "total", "n"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """(words, means) of the occurrences of sorted rows; the last of a batch is held, as it may go on."""
        held = None
        for batch in batches:
            if held is not None:
                batch = pa.concat_batches([held, batch])
            if not batch.num_rows:
                continue
            at = _runs(batch.column(0), batch.column(1))
            held, done = batch.slice(int(at[-1])), batch.slice(0, int(at[-1]))
            if done.num_rows:
                yield sums_of(done, at[:-1])
        if held is not None:
            yield sums_of(held, np.zeros(1, np.int64))

    def sums_of(batch: pa.RecordBatch, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        n = np.add.reduceat(batch.column(3).to_numpy(), at)
        return batch.column(1).take(pa.array(at)), np.add.reduceat(_matrix(batch.column(2)), at, axis=0) / n[:, None]

    def by_word(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(word, total, n) of occurrences."""
        names: dict[str, int] = {}
        total = counts = None

        def result() -> pa.RecordBatch:
            size = len(names)
            out = pa.RecordBatch.from_arrays([pa.array(list(names), pa.string()), _vectors(total[:size].copy()), pa.array(counts[:size].copy())], names=["word", "total", "n"])
            names.clear()
            total[:], counts[:] = 0.0, 0
            return out

        for words, means in whole(batches):
            if total is None:
                total, counts = np.zeros((table, means.shape[1])), np.zeros(table, np.int64)
            for a in range(0, len(words), table):
                some = words[a : a + table].to_pylist()
                if len(names) + len(some) > table:
                    yield result()
                at = np.array([names.setdefault(w, len(names)) for w in some])
                np.add.at(total, at, means[a : a + table])
                np.add.at(counts, at, 1)
        if names:
            yield result()

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(word, total, n) of words of sorted sums."""
        held = None
        for batch in batches:
            if held is not None:
                batch = pa.concat_batches([held, batch])
            if not batch.num_rows:
                continue
            at = _runs(batch.column(0))
            sums, n = np.add.reduceat(_matrix(batch.column(1)), at, axis=0), np.add.reduceat(batch.column(2).to_numpy(), at)
            out = pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), _vectors(sums), pa.array(n)], names=["word", "total", "n"])
            held = out.slice(len(at) - 1)
            yield out.slice(0, len(at) - 1)
        if held is not None:
            yield held

    sums = rows.mapInArrow(merge, "occurrence string, word string, total array<double>, n bigint")
    each = sums.repartition("occurrence").sortWithinPartitions("occurrence", "word").mapInArrow(by_word, "word string, total array<double>, n bigint")
    means = each.repartition("word").sortWithinPartitions("word").mapInArrow(last, "word string, total array<double>, n bigint")
    return means.select("word", l2_normalise(F.transform("total", lambda x: x / F.col("n"))).alias("vector"), F.col("n").alias("cnt"))
