"""Similarity of words by their character n-grams."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalar import char_ngrams
from ..sources.files import written
from .units import STEP, Largest, held_by, meet

#: Members that go to every task without a shuffle.
TARGETS = 4096
#: So many of a word's largest similarities are put in order for all keys.
FIRST = 64


def gram_counts(words: DataFrame, low: int = 2, high: int = 4) -> DataFrame:
    """(word, ngram, tf) of the distinct words."""
    return words.select("word").distinct().select("word", F.explode(char_ngrams("word", low, high)).alias("ngram")).groupBy("word", "ngram").agg(F.count("*").alias("tf"))


def tfidf(grams: DataFrame, fitted: DataFrame) -> DataFrame:
    """(word, ngram, w): tf * (ln((1 + n) / (1 + df)) + 1), at unit length per word; n-grams unseen in fitted are ignored.

    fitted: gram_counts of the words that idf is counted on.
    """
    n = fitted.select("word").distinct().agg(F.count("*")).scalar()
    df = fitted.groupBy("ngram").agg(F.count("*").alias("df"))
    idf = df.select("ngram", (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    rows = grams.join(idf, "ngram").select("word", "ngram", (F.col("tf") * F.col("idf")).alias("x"))
    norms = rows.groupBy("word").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("len"))
    return rows.join(norms, "word").select("word", "ngram", (F.col("x") / F.col("len")).alias("w"))


def gram_vectors(words: DataFrame, members: DataFrame, low: int = 2, high: int = 4) -> tuple[DataFrame, DataFrame]:
    """(word, grams) of words and of members: tf-idf weights as tfidf gives them, vocabulary and idf of `words` alone; a row for each word that has any."""
    fitted = gram_counts(words, low, high)
    vector = F.array_sort(F.collect_list(F.struct("ngram", "w"))).alias("grams")
    own = written(tfidf(fitted, fitted).groupBy("word").agg(vector))
    return own, written(tfidf(gram_counts(members.select("word"), low, high), fitted).groupBy("word").agg(vector))


class Alike:
    """Of a unit's words (units.meet) the largest n-gram cosine to each key's members; those without grams have no part."""

    def __init__(self, grams: pa.Array, keys: int):
        gram, weight, sizes = _flat(grams)
        code = gram.dictionary_encode()
        self.ids = {g: i for i, g in enumerate(code.dictionary.to_pylist())}
        self.gram, self.weight, self.ends = code.indices.to_numpy(), weight, np.r_[0, np.cumsum(sizes)]
        self.best = Largest(len(grams), keys, 1, FIRST, 0.0)

    def add(self, grams: pa.Array, holds: np.ndarray) -> None:
        """Each word sums the lists of its n-grams' holders among the members."""
        gram, weight, sizes = _flat(grams)
        code, owner = gram.dictionary_encode(), np.repeat(np.arange(len(grams)), sizes)
        own = np.array([self.ids.get(g, -1) for g in code.dictionary.to_pylist()], int)[code.indices.to_numpy()]
        order = np.argsort(own, kind="stable")
        owner, weight = owner[order], weight[order]
        starts = np.searchsorted(own[order], np.arange(len(self.ids) + 1)).tolist()
        words = len(self.ends) - 1
        for a in range(0, words if len(grams) else 0, STEP):
            total = np.zeros((min(STEP, words - a), len(grams)))
            for i, row in enumerate(total):
                for p in range(self.ends[a + i], self.ends[a + i + 1]):
                    g = self.gram[p]
                    s, e = starts[g], starts[g + 1]
                    if s < e:
                        row[owner[s:e]] += self.weight[p] * weight[s:e]
            self.best.add(a, total, holds)

    def result(self, a: int, b: int) -> tuple[list[np.ndarray], np.ndarray]:
        best = self.best.top[a:b, :, 0]
        return [np.round(best, 10)], best > 0


def _flat(grams: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """n-grams and weights of all rows one after the other, and how many each row has."""
    gram, weight = grams.flatten().flatten()
    return gram, weight.to_numpy(), pa.compute.list_value_length(grams).fill_null(0).to_numpy(zero_copy_only=False)


def lexical_similarity(words: DataFrame, members: DataFrame, keys: Sequence[str] = (), low: int = 2, high: int = 4) -> DataFrame:
    """(keys, word, lexical): each word's largest n-gram cosine to the members of a key; words that share no n-gram are left out.

    The vocabulary and idf come from `words` alone. Words in units meet the members in blocks (units.meet), of whom
    TARGETS at most go to every task without a shuffle: each word sums its own n-grams' lists and keeps the
    largest for each key. So no n-gram, however common, is a key that rows meet under, and no pair of words is a row.
    """
    keys = list(keys)
    members = written(members.select(*keys, "word").distinct())
    held, cells = held_by(members, keys)
    own, ref = gram_vectors(words, members, low, high)
    schema = StructType([*members.select(*keys).schema.fields, *StructType.fromDDL("word string, lexical double").fields])

    class Met(Alike):
        def __init__(self, words: pa.RecordBatch):
            super().__init__(words.column(1), len(cells))

        def add(self, members: pa.RecordBatch, holds: np.ndarray) -> None:
            super().add(members.column(1), holds)

    return meet(own, written(held.join(ref, "word")), cells, schema, Met, len(cells), TARGETS)
