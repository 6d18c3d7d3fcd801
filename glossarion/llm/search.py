"""Ranked lexical search: a stated set of queries against all documents, term at a time with limited accumulators.

Documents are reduced to the queries' terms that they hold, once, and never shuffled. A task takes its
documents in pieces and each query's terms rarest first. A document gets an accumulator only while one
without could still reach the k best: when the bounds of the terms that are left sum to less than the k-th
partial score, no more are created, and the survivors are updated exactly. The k best go on from piece to
piece of a task, and those of the tasks are merged.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .text import shared_dir, slices

#: Bytes of terms: ASCII letters and digits and all that is not ASCII; others part terms. A-Z are lower-cased.
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Characters of queries whose terms are searched in one pass.
BLOCK = 1 << 24
#: Documents, and their terms, of a piece.
PIECE_DOCS, PIECE_TERMS = 1 << 16, 1 << 22


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, in order, repeats included."""
    return text.translate(_TERM).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def postings(docs: DataFrame, ids: dict[bytes, int], id_col: str, text: str) -> DataFrame:
    """(doc_id, n, terms, tfs) of each row: its number of terms, and which of the given ones it holds how often. No shuffle."""
    schema = StructType([StructField("doc_id", docs.schema[id_col].dataType), *StructType.fromDDL("n bigint, terms array<int>, tfs array<int>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            sizes, found, often = [], [], []
            for t in batch.column(1).cast(pa.binary()).to_pylist():
                all_terms = terms(t or b"")
                held = {ids[x]: n for x, n in Counter(all_terms).items() if x in ids}
                sizes.append(len(all_terms))
                found.append(list(held))
                often.append(list(held.values()))
            kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (sizes, found, often), kinds)], names=["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("_text")).mapInArrow(run, schema)


class Query:
    """A query's terms, rarest first: their numbers, weights times repeats, and the sums of the bounds of those after each."""

    def __init__(self, counted: Counter, df: np.ndarray, weights: np.ndarray, most: np.ndarray):
        at = np.array(sorted(counted, key=lambda t: (df[t], t)), np.int64)
        self.terms, self.factors = at, weights[at] * np.array([counted[t] for t in at.tolist()], np.int64)
        bounds = self.factors * most[at]
        self.left = bounds[::-1].cumsum()[::-1] - bounds


def take(query: Query, starts: np.ndarray, docs: np.ndarray, impacts: np.ndarray, n_docs: int, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, scores, accumulators) that may be among the k best of a piece.

    The piece's postings lie term by term, those of term t from starts[t] on. floor: a k-th score that is known.
    """
    total, made, alive, creating = np.zeros(n_docs, np.int64), np.zeros(n_docs, bool), 0, True
    for t, factor, left in zip(query.terms.tolist(), query.factors.tolist(), query.left.tolist(), strict=True):
        at, more = docs[starts[t] : starts[t + 1]], impacts[starts[t] : starts[t + 1]]
        if not creating:
            on = made[at]
            at, more = at[on], more[on]
        total[at] += factor * more
        if creating:
            made[at] = True
            kth = floor
            if left and len(at) and (alive := int(made.sum())) >= k:
                kth = max(kth, int(np.partition(total[made], alive - k)[alive - k]))
            creating = left >= kth
    found = np.flatnonzero(made & (total > 0))
    return found, total[found], int(made.sum())


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties by id."""
    if len(scores) > k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        ids, scores = ids[some], scores[some]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _search(held: DataFrame, queries: list[Query], n_terms: int, n_docs: int, n_all: int, k: int) -> DataFrame:
    """(q, doc_id, score, accumulators): each task's k best of each query, among rows of `postings` that have an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in queries]
        made, rows = [0] * len(queries), []

        def close() -> None:
            """Search what is held."""
            piece = pa.Table.from_batches(rows).combine_chunks()
            rows.clear()
            ids, n = piece.column("doc_id").to_numpy(), piece.column("n").to_numpy()
            lists = piece.column("terms").combine_chunks()
            term, tf = lists.flatten().to_numpy(), piece.column("tfs").combine_chunks().flatten().to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy())
            order = np.argsort(term, kind="stable")
            term, tf, doc = term[order], tf[order], doc[order]
            impacts = impact(tf, n[doc], n_docs, n_all)
            starts = np.searchsorted(term, np.arange(n_terms + 1))
            for i, query in enumerate(queries):
                if not len(query.terms):
                    continue
                known, scores = best[i]
                floor = int(scores[k - 1]) if len(scores) == k else 0
                at, more, count = take(query, starts, doc, impacts, len(ids), k, floor)
                best[i] = _best(np.r_[known, ids[at]], np.r_[scores, more], k)
                made[i] += count

        size = docs = 0
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                rows.append(part)
                size, docs = size + len(part.column(2).flatten()), docs + part.num_rows
                if size >= PIECE_TERMS or docs >= PIECE_DOCS:
                    close()
                    size = docs = 0
        if rows:
            close()
        lengths = [len(ids) for ids, _ in best]
        columns = [np.repeat(np.arange(len(queries), dtype=np.int32), lengths), *(np.concatenate(x) for x in zip(*best, strict=True)), np.repeat(np.array(made, np.int64), lengths)]
        yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["q", "doc_id", "score", "accumulators"])

    return held.mapInArrow(run, "q int, doc_id bigint, score bigint, accumulators bigint")


def impact(tf: np.ndarray, n: np.ndarray, n_docs: int, n_all: int) -> np.ndarray:
    """A term's part of a score before its weight, of documents of n terms that hold it tf times."""
    # n * n_docs in Python's integers where it could pass 64 bits
    wide = 75 * int(n.max(initial=0)) * n_docs >= 1 << 63
    m = np.array([25 + 75 * x * n_docs // n_all for x in n.tolist()], np.int64) if wide else 25 + 75 * n * n_docs // max(1, n_all)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def _blocks(items: DataFrame, text: str) -> Iterator[list]:
    """The queries in blocks of bounded size, which the driver holds one at a time."""
    block, size = [], 0
    for row in items.toLocalIterator():
        block.append(row)
        size += len(row[text] or "")
        if size >= BLOCK:
            yield block
            block, size = [], 0
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score of each query, ties by the smaller id.

    Scores are integers, see the module and `impact`; only those above 0 are listed. The queries are the
    stated set: each goes to all tasks, in blocks of about BLOCK characters, and more blocks mean more passes
    over the documents' text. Statistics are those of all documents. A null or blank text has no terms: such
    a query has no rows, such a document is in none. Documents whose id is null (bigint ids) count in the
    statistics, but aren't listed. Repeated documents are ranked side by side, repeated queries answered one
    by one. Other columns don't matter. Empty tables give no rows.
    """
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    schema = StructType([StructField("item_id", items.schema[item_col].dataType), StructField("rank", IntegerType()), StructField("doc_id", LongType()), StructField("score", LongType())])
    items = items.select(F.col(item_col).alias("_item"), F.col(item_text).alias("_text"))
    out = None
    for number, block in enumerate(_blocks(items, "_text")):
        counted = [Counter(terms((r["_text"] or "").encode())) for r in block]
        ids = {t: i for i, t in enumerate(sorted(set().union(*counted)))}
        postings(docs, ids, id_col, text).write.parquet(f"{folder}/held{number}")
        held = spark.read.parquet(f"{folder}/held{number}")
        n_docs, n_all = held.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        # of documents that hold a term equally often the shortest bounds the others; the driver gets a row for each of the block's terms
        each = held.select("n", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).groupBy("x.terms", "x.tfs").agg(F.count("*").alias("c"), F.min("n").alias("n"))
        m = f"25 + (cast({75 * n_docs} as decimal(18, 0)) * cast(n as decimal(18, 0))) div cast({max(1, n_all)} as decimal(18, 0))"
        stats = each.groupBy("terms").agg(F.sum("c").alias("df"), F.max(F.expr(f"(1000000000 * bigint(tfs)) div (1000 * bigint(tfs) + 8 * ({m}))")).alias("most"))
        df, most = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        for r in stats.toLocalIterator():
            df[r["terms"]], most[r["terms"]] = r["df"], r["most"]
        weights = np.array([weight(n_docs, int(x)) if x else 0 for x in df], np.int64)
        queries = [Query(Counter({ids[t]: n for t, n in c.items() if df[ids[t]]}), df, weights, most) for c in counted]
        found = _search(held.filter("doc_id is not null"), queries, len(ids), n_docs, n_all, k)
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "doc_id"))
        found = found.withColumn("rank", rank).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r["_item"]) for i, r in enumerate(block)], StructType([StructField("q", IntegerType()), schema["item_id"]]))
        found = found.join(names, "q").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out
