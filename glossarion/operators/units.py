"""Words in units of a bounded size that meet blocks of members: no pair of words is a row, and nothing is merged after the task."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..sources.files import written

#: Numbers that a unit of words holds, words that it has at most (both expected), and members that it meets at once.
HELD, WORDS, BLOCK = 3 << 23, 1 << 15, 16384
#: Words that are looked at together.
STEP = 256
#: Keys that members may have.
KEYS = 100_000


class Met(Protocol):
    """What a unit keeps of its words while blocks of members pass by."""

    def add(self, members: pa.RecordBatch, holds: np.ndarray) -> None:
        """members: (word, ...); holds: which member (row) belongs to which key (column)."""

    def result(self, a: int, b: int) -> tuple[list[np.ndarray], np.ndarray]:
        """Of the words from place a to b: columns (words x keys), and where there is a row."""


class Largest:
    """The k largest of each word's similarities to each key's members, in rising order; `start` where there are fewer."""

    def __init__(self, words: int, keys: int, k: int, first: int, start: float = -np.inf):
        """first: so many of a word's largest are put in order for all keys; a key that has too few of them looks at all of its own."""
        self.top, self.k, self.first = np.full((words, keys, k), start), k, first

    def add(self, a: int, sims: np.ndarray, holds: np.ndarray) -> None:
        """sims: the similarities of the words from place a on with a block's members."""
        held, size, n = self.top[a : a + len(sims)], holds.sum(0), sims.shape[1]
        # a large key's largest are mostly among the first of all members
        many = np.flatnonzero(size * self.first > 2 * np.minimum(self.k, size) * n)
        short = np.ones((len(sims), len(size)), bool)
        if len(many):
            some = sims > held[:, many, 0].min(1)[:, None]  # what no key would take is left out
            width = int(some.sum(1).max())
            if width <= self.first:
                row, col = np.nonzero(some)
                place = np.arange(len(row)) - np.searchsorted(row, row)
                at, value = np.zeros((len(sims), width), int), np.full((len(sims), width), -np.inf)
                at[row, place], value[row, place], rest = col, sims[row, col], np.full(len(sims), -np.inf)
            else:
                first = min(n, self.first)
                at = np.argpartition(sims, n - first, axis=1)[:, n - first :]
                value = np.take_along_axis(sims, at, axis=1)
                rest = value.min(1) if first < n else np.full(len(sims), -np.inf)
            new = np.where(holds.T[many][:, at].transpose(1, 0, 2), value[:, None], -np.inf)
            new = np.sort(self._best(held[:, many], new), axis=2)
            short[:, many] = new[:, :, 0] < rest[:, None]
            held[:, many] = np.where(short[:, many, None], held[:, many], new)
        for c in np.flatnonzero(short.any(0) & (size > 0)):
            rows, own = np.flatnonzero(short[:, c]), np.flatnonzero(holds[:, c])
            held[rows, c] = np.sort(self._best(held[rows, c], sims[np.ix_(rows, own)]), axis=1)

    def _best(self, held: np.ndarray, new: np.ndarray) -> np.ndarray:
        both = np.concatenate([held, new], axis=-1)
        return np.partition(both, both.shape[-1] - self.k, axis=-1)[..., -self.k :]


def emitted(state: Met, words: pa.Array, cells: Sequence[tuple], schema: StructType, n_keys: int) -> Iterator[pa.RecordBatch]:
    """(keys, word, columns) of a unit's words, key by key."""
    for a in range(0, len(words) if cells else 0, STEP):
        columns, there = state.result(a, min(a + STEP, len(words)))
        cell, row = np.nonzero(there.T)
        if not len(cell):
            continue
        fixed = [pa.array([c[i] for c in cells], to_arrow_type(schema[i].dataType)).take(pa.array(cell)) for i in range(n_keys)]
        yield pa.RecordBatch.from_arrays([*fixed, words.take(pa.array(row + a)), *[pa.array(x.T[cell, row]) for x in columns]], names=schema.names)


def held_by(members: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[tuple]]:
    """(word, at): each member with the numbers of the keys that hold it; and the keys by number, of which there are few."""
    spark, keys = members.sparkSession, list(keys)
    if not keys:
        return members.select("word").distinct().withColumn("at", F.array(F.lit(0))), [()]
    cells = [tuple(r) for r in members.select(*keys).distinct().limit(KEYS + 1).collect()]
    if len(cells) > KEYS:
        raise ValueError(f"more than {KEYS} keys of members")
    fields = members.select(*keys).schema.fields
    numbered = spark.createDataFrame([(*c, i) for i, c in enumerate(cells)], StructType([*[StructField(f"_{f.name}", f.dataType) for f in fields], StructField("_at", IntegerType())]))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return written(members.join(numbered, on).groupBy("word").agg(F.collect_set("_at").alias("at"))), cells


def _holds(at: pa.Array, keys: int) -> np.ndarray:
    sizes = pa.compute.list_value_length(at).fill_null(0).to_numpy(zero_copy_only=False)
    holds = np.zeros((len(at), keys), bool)
    holds[np.repeat(np.arange(len(at)), sizes), at.flatten().to_numpy()] = True
    return holds


def meet(words: DataFrame, members: DataFrame, cells: Sequence[tuple], schema: StructType, start: Callable[[pa.RecordBatch], Met], held: int, few: int) -> DataFrame:
    """Rows of a schema (keys, word, columns) of words that each met all members.

    words: (word, ...), a row each; members: (word, at, ...), see held_by, with any of words' other columns. At most
    `few` members go to every task at once. More are shuffled: words lie in units by their hash, in which each keeps
    `held` numbers, and all members go to every unit in blocks, sorted behind its words. `start` makes what a unit
    keeps of its words. What is shuffled grows with the words, and with the members times the units; a task
    holds a unit and a block.
    """
    n_keys, size = len(cells[0]) if cells else 0, max(STEP, min(WORDS, HELD // max(1, held)))
    rest = [c for c in words.columns if c != "word"]
    others = members.select("word", "at", *[F.col(c) if c in members.columns else F.lit(None).cast(words.schema[c].dataType).alias(c) for c in rest])
    words = words.select("word", *rest)
    if members.count() <= few:
        block = others.orderBy("word").toArrow().combine_chunks()
        whole = block.to_batches()[0] if block.num_rows else None

        def run_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if whole is None:
                return
            inner, holds = whole.select([0, *range(2, whole.num_columns)]), _holds(whole.column(1), len(cells))
            for batch in batches:
                for a in range(0, batch.num_rows, size):
                    part = batch.slice(a, size)
                    state = start(part)
                    state.add(inner, holds)
                    yield from emitted(state, part.column(0), cells, schema, n_keys)

        return words.mapInArrow(run_all, schema)
    count, cores = words.count(), words.sparkSession.sparkContext.defaultParallelism
    units = max(1, -(-count // size), min(2 * cores, -(-count // STEP)))
    own = words.select(F.pmod(F.xxhash64("word"), F.lit(units)).cast("int").alias("unit"), F.lit(True).alias("asks"), "word", F.lit(None).cast(ArrayType(IntegerType())).alias("at"), *rest)
    others = others.select(F.explode(F.sequence(F.lit(0), F.lit(units - 1))).alias("unit"), F.lit(False).alias("asks"), "word", "at", *rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by unit, words that ask first."""
        unit, part, state, names = None, [], None, None

        def close() -> None:
            """Take in what is held: the unit's words, or a block of members."""
            nonlocal state, names
            if not part:
                return
            whole = pa.concat_batches(part)
            part.clear()
            inner = whole.select([2, *range(4, whole.num_columns)])
            if unit[1]:
                state, names = start(inner), inner.column(0)
            elif state is not None:
                state.add(inner, _holds(whole.column(3), len(cells)))

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(2)]
            starts = np.flatnonzero(np.r_[True, (keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1])])
            for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                here = keys[0][a].item(), bool(keys[1][a])
                if here != unit:
                    close()
                    if unit is not None and here[0] != unit[0]:
                        if state is not None:
                            yield from emitted(state, names, cells, schema, n_keys)
                        state = None
                    unit = here
                part.append(batch.slice(a, b - a))
                if not unit[1] and sum(p.num_rows for p in part) >= BLOCK:
                    close()
        close()
        if state is not None:
            yield from emitted(state, names, cells, schema, n_keys)

    rows = own.unionByName(others).repartitionById(units, "unit").sortWithinPartitions("unit", F.desc("asks"))
    return rows.mapInArrow(run, schema)
