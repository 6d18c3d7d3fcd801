"""Column expressions for vectors, neighbour weights, lexical units and log lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WEIGHTS = ("constant", "inverse", "exponential")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product of two arrays, in double."""
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def bound(c: Column | str, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.transform(F.array(_col(c)), f)[0]


def l2_normalise(v: Column | str) -> Column:
    """The vector over its length; a zero vector stays as it is. The length is computed once a vector, not once a cell."""

    def over(v: Column) -> Column:
        lengths = F.array_repeat(norm(v), F.size(v))
        return F.zip_with(v, lengths, lambda x, n: x / F.when(n == 0, F.lit(1.0)).otherwise(n))

    return bound(_col(v).cast("array<double>"), over)


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def scrub(v: Column | str) -> Column:
    """NaN, infinite and null cells become 0."""
    return F.transform(_col(v), lambda x: F.when(is_finite(x), x.cast("double")).otherwise(0.0))


def bad_cells(v: Column | str) -> Column:
    return F.size(F.filter(_col(v), lambda x: ~is_finite(x)))


def neighbour_weight(distance: Column | str, kind: str) -> Column:
    """constant: 1; inverse: 1 / (d + 1e-5); exponential: e^-d."""
    d = _col(distance)
    match kind:
        case "constant":
            return F.lit(1.0)
        case "inverse":
            return F.lit(1.0) / (d + F.lit(1e-5))
        case "exponential":
            return F.exp(-d)
    raise ValueError(f"unknown weight {kind!r}; known: {', '.join(WEIGHTS)}")


def hash_order(*parts: Column | str | int) -> Column:
    """A reproducible random key: md5 of the parts joined by slashes."""
    return F.md5(F.concat_ws("/", *[F.lit(str(p)) if isinstance(p, int) else _col(p).cast("string") for p in parts]))


def char_ngrams(word: Column | str, low: int = 2, high: int = 4) -> Column:
    """Character n-grams inside word boundaries, lower-cased, each with its repeats.

    Each whitespace-separated word is padded by a space on both sides; a padded word shorter than n has
    no gram of size n, but every word has one of the least size.
    """
    def cut(padded: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1)))
        grams = F.transform(starts, lambda i: F.substr(padded, i, F.lit(n)))
        return grams if n == low else F.when(F.length(padded) >= n, grams).otherwise(F.array().cast("array<string>"))

    def of_word(w: Column) -> Column:
        padded = F.concat(F.lit(" "), w, F.lit(" "))
        return F.concat(*[cut(padded, n) for n in range(low, high + 1)])

    words = F.filter(F.split(F.lower(_col(word)), r"\s+"), lambda w: w != "")
    return F.flatten(F.transform(words, of_word))
