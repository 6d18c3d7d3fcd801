"""Toxicity classifier with a counterfactual penalty.

Logistic regression over the presence of words and word beginnings, hashed into a fixed number of
features. Every labelled text has counterfactuals: it names a group, its own or one that is put in, and
the training loss adds the squared change of the score when the name is swapped for another group's and
when it is taken out. So a group's name by itself carries no weight, whichever labels it stood with.
Only the features that tell most about the labels get a weight, which keeps long texts from adding up
noise.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .text import slices

FEATURES = 1 << 18
TOKEN = re.compile(r"[^\W\d_]+")
#: Groups' names that can stand for each other; each is swapped for the next in its line.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("female", "male"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("transgender", "cisgender"),
    ("immigrants", "citizens", "refugees"),
    ("african", "european", "american"),
    ("disabled", "deaf", "blind"),
    ("old", "young"),
)
_CACHED_WORDS = 60_000


def word_features(word: str) -> tuple[int, ...]:
    """A word's own feature and those of its first four and five letters."""
    return tuple({zlib.crc32(x.encode()) % FEATURES for x in ("w" + word, "p" + word[:4], "p" + word[:5])})


def text_features(words: set[str]) -> set[int]:
    return {f for w in words for f in word_features(w)}


def words_of(text: str) -> set[str]:
    return set(TOKEN.findall(text.lower()))


@dataclass(frozen=True)
class Model:
    """Weights of the features that have any, and the bias; at most FEATURES weights."""

    weights: dict[int, float]
    bias: float

    def score(self, words: set[str], cache: dict[str, tuple[int, ...]]) -> float:
        active: set[int] = set()
        for w in words:
            hit = cache.get(w)
            if hit is None:
                hit = cache[w] = tuple(f for f in word_features(w) if f in self.weights)
            if hit:
                active.update(hit)
        z = self.bias + sum(self.weights[f] for f in sorted(active))
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def counterfactuals(words: set[str], terms: tuple[tuple[str, ...], ...], number: int) -> list[tuple[list[int], list[int]]]:
    """Of a text's words two changes, each as the features lost and the features gained: names swapped, names taken out.

    A text that names no group is first given one name, the one that `number` picks.
    """
    place = {a: (line, i) for line in terms for i, a in enumerate(line)}
    named = words & place.keys()
    if not named:
        line = terms[number % len(terms)]
        named = {line[number // len(terms) % len(line)]}
        words = words | named
    with_names, others = text_features(words), words - named
    swapped = text_features(others | {place[w][0][(place[w][1] + 1) % len(place[w][0])] for w in named})
    return [(sorted(with_names - to), sorted(to - with_names)) for to in (swapped, text_features(others))]


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int, train: str, identity_terms=IDENTITY_TERMS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(toxic int, features array<int>, changes) of at most per_class documents of each label, the first by a hash of their id.

    changes: see counterfactuals; the names that texts without any are given follow a hash of the text.
    Null and other labels and null ids are left out, repeated labels count once; a null text has no
    features; empty tables give no rows.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull() & F.expr(train)).select(id_col, "toxic").distinct()
    first = [known.filter(F.col("toxic") == t).orderBy(F.xxhash64(id_col), id_col).limit(per_class) for t in (0, 1)]
    chosen = docs.select(id_col, F.col(text).alias("_text")).join(F.broadcast(first[0].union(first[1])), id_col).select("toxic", "_text")
    terms = tuple(map(tuple, identity_terms))
    change = pa.list_(pa.struct([("lost", pa.list_(pa.int32())), ("gained", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            plain, changes = [], []
            for t in batch.column(1).to_pylist():
                words = words_of(t or "")
                plain.append(sorted(text_features(words)))
                changes.append([{"lost": a, "gained": b} for a, b in counterfactuals(words, terms, zlib.crc32((t or "").encode()))] if terms else [])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array(plain, pa.list_(pa.int32())), pa.array(changes, change)], names=["toxic", "features", "changes"])

    return chosen.mapInArrow(run, "toxic int, features array<int>, changes array<struct<lost:array<int>,gained:array<int>>>")


def _dense(rows: list, index: np.ndarray, width: int) -> np.ndarray:
    """0/1 rows over the chosen features; index holds each feature's column or -1."""
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        at = index[np.asarray(r, np.int64)]
        out[i, at[at >= 0]] = 1
    return out


def fit(sample: list[tuple], counterfactual: float = 1.0, l2: float = 3e-4, min_docs: int = 3, features: int = 600, rounds: int = 30) -> Model:
    """Newton's method on rows (toxic, features, changes); both labels weigh the same.

    The loss: weighted mean log loss + counterfactual * mean squared score change over all counterfactuals
    + l2 * |w|^2, over the features whose presence tells most about the label (chi-squared, at most
    `features`) and those that a counterfactual changes. Without rows of both labels the model is a constant.
    """
    sample = sorted(sample, key=lambda r: (r[0], list(r[1])))
    y = np.array([r[0] for r in sample], float)
    n, n1 = len(y), y.sum()
    if not 0 < n1 < n:
        return Model({}, 50.0 if n1 else -50.0)

    def seen(rows: list) -> np.ndarray:
        return np.bincount(np.concatenate([np.asarray(r, np.int64) for r in rows] or [np.zeros(0, np.int64)]), minlength=FEATURES)

    all_docs, toxic_docs = seen([r[1] for r in sample]), seen([r[1] for r in sample if r[0]])
    expected = all_docs * (n1 / n)
    chi = (toxic_docs - expected) ** 2 / np.maximum(expected * (1 - n1 / n) * (1 - all_docs / n), 1e-9)
    chi[all_docs < min_docs] = 0
    pairs = [(lost, gained) for r in sample for lost, gained in r[2]]
    changed = seen([x for pair in pairs for x in pair]) > 0
    best = np.argsort(-chi, kind="stable")[:features]
    used = np.union1d(best[chi[best] > 0], np.flatnonzero(changed))
    index = np.full(FEATURES, -1)
    index[used] = np.arange(len(used))
    d = len(used)
    x = np.c_[_dense([r[1] for r in sample], index, d), np.ones(n)]
    weight = np.where(y > 0, 0.5 / n1, 0.5 / (n - n1))
    fixed = 2 * l2 * np.diag(np.r_[np.ones(d), 1e-3])
    for a in range(0, len(pairs), 4096):
        diff = _dense([p[0] for p in pairs[a : a + 4096]], index, d) - _dense([p[1] for p in pairs[a : a + 4096]], index, d)
        fixed[:d, :d] += 2 * counterfactual / len(pairs) * (diff.T @ diff)

    def loss(w: np.ndarray) -> float:
        return float((weight * np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ w))).sum() + 0.5 * w @ fixed @ w)

    w, now = np.zeros(d + 1), np.inf
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        grad = x.T @ (weight * (p - y)) + fixed @ w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + fixed
        step = np.linalg.solve(hess, grad)
        new = next((w - step * k for k in (1, 0.5, 0.25, 0.1, 0.01) if loss(w - step * k) <= loss(w)), w)
        w, before, now = new, now, loss(new)
        if before - now < 1e-7:
            break
    return Model({int(f): float(v) for f, v in zip(used, w[:-1], strict=True) if abs(v) > 1e-9}, float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, per_class: int = 2500, train: str = "true", **fitting) -> Model:
    """A model from a bounded sample: at most 2 * per_class labelled documents, whose hashed features go to the driver.

    Nulls and repeats as in labelled_sample; empty tables, or labels of one kind, give a constant score.
    """
    rows = [tuple(r) for r in labelled_sample(docs, labels, per_class, train).collect()]
    return fit(rows, **fitting)


def score(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` and score (double, 0 to 1: higher is likelier toxic) of each row's whole text.

    A null or empty text has the score of no words. The text is the only input of a score. Rows stay
    where they are, repeated ones included; other columns are dropped; an empty table gives no rows.
    text may be a field of a struct in keep (`struct.field`), and then goes to the tasks once.
    """
    struct, _, field = text.rpartition(".")
    inside = struct in keep
    schema = StructType([*df.select(*keep).schema.fields, StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[int, ...]] = {}
        if inside:
            batches = (pa.RecordBatch.from_arrays([*b.columns, pa.compute.struct_field(b.column(struct), field)], names=[*keep, "_text"]) for b in batches)
        for batch in slices(batches, "_text"):
            if len(cache) > _CACHED_WORDS:
                cache.clear()
            scores = [model.score(words_of(t or ""), cache) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=[*keep, "score"])

    return df.select(*keep, *([] if inside else [df[text].alias("_text")])).mapInArrow(run, schema)
