"""Ranking quality: ROC and precision-recall curves, thresholds, metrics at a threshold and at k.

Rows are reduced to distinct scores before any window, and windows are partitioned by the keys that
tell the curves apart (split, method, configuration).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.files import written


def score_groups(df: DataFrame, keys: Sequence[str], score: str = "score", label: str = "label") -> DataFrame:
    """(keys, score, np, nn): positives and negatives of each distinct score; null scores and labels are left out."""
    y = F.col(label).cast("int")
    rows = df.filter(F.col(score).isNotNull() & y.isNotNull())
    return rows.groupBy(*keys, F.col(score).alias("score")).agg(F.sum(y).alias("np"), F.sum(1 - y).alias("nn"))


def with_default(groups: DataFrame, totals: DataFrame, keys: Sequence[str], default: float = 0.0) -> DataFrame:
    """Score groups with those rows added that have no score of their own and take the default.

    totals: (keys, pos, neg). The group is merged by value, wherever it falls among the others.
    """
    seen = groups.groupBy(*keys).agg(F.sum("np").alias("_p"), F.sum("nn").alias("_n"))
    rest = totals.join(seen, list(keys), "left").select(*keys, F.lit(default).alias("score"), (F.col("pos") - F.coalesce("_p", F.lit(0))).alias("np"), (F.col("neg") - F.coalesce("_n", F.lit(0))).alias("nn"))
    both = groups.select(*keys, "score", "np", "nn").unionByName(rest.filter("np > 0 or nn > 0"))
    return both.groupBy(*keys, "score").agg(F.sum("np").alias("np"), F.sum("nn").alias("nn"))


def curve_points(groups: DataFrame, keys: Sequence[str], ranges: int = 1) -> DataFrame:
    """score_groups with tp, fp (of scores >= this one), pos, neg, tpr, fpr, precision and recall; rates of empty classes are null.

    ranges: into how many ranges of like many scores a curve is cut, so that several tasks share one of
    many distinct scores: sums run within ranges and go on from the totals of those above.
    """
    keys = list(keys)
    sums = {"pos": F.sum("np").over(Window.partitionBy(*keys)), "neg": F.sum("nn").over(Window.partitionBy(*keys))}
    if ranges == 1:
        down = Window.partitionBy(*keys).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
        df = groups.withColumns({"tp": F.sum("np").over(down), "fp": F.sum("nn").over(down), **sums})
    else:
        cuts = groups.groupBy(*keys).agg(F.percentile_approx("score", [i / ranges for i in range(1, ranges)]).alias("_cuts"))
        cut = groups.join(cuts, keys).withColumn("_range", F.size(F.filter("_cuts", lambda c: c > F.col("score")))).drop("_cuts")
        totals = cut.groupBy(*keys, "_range").agg(F.sum("np").alias("np"), F.sum("nn").alias("nn"))  # `ranges` rows a curve
        above = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        carried = totals.withColumns({"_tp": F.coalesce(F.sum("np").over(above), F.lit(0)), "_fp": F.coalesce(F.sum("nn").over(above), F.lit(0)), **sums}).drop("np", "nn")
        down = Window.partitionBy(*keys, "_range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
        df = cut.withColumns({"tp": F.sum("np").over(down), "fp": F.sum("nn").over(down)}).join(carried, [*keys, "_range"])
        df = df.withColumns({"tp": F.col("tp") + F.col("_tp"), "fp": F.col("fp") + F.col("_fp")}).drop("_range", "_tp", "_fp")
    return df.withColumns(
        {
            "tpr": F.try_divide(F.col("tp").cast("double"), F.col("pos")),
            "fpr": F.try_divide(F.col("fp").cast("double"), F.col("neg")),
            "precision": F.col("tp").cast("double") / (F.col("tp") + F.col("fp")),
            "recall": F.try_divide(F.col("tp").cast("double"), F.col("pos")),
        }
    )


def curve_summary(groups: DataFrame, keys: Sequence[str], ranges: int = 1) -> DataFrame:
    """One row per curve: pos, neg, roc_auc, average_precision, the Youden threshold ba_*, the F1 threshold f1_*.

    roc_auc counts ties half; average_precision is the step sum. Both are null for a single class. The
    Youden threshold is the highest of the best, infinite if no point beats the origin; the F1 threshold
    the lowest of the best. ranges: see curve_points.
    """
    pts = curve_points(groups, keys, ranges)
    f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + F.lit(1e-12))
    pts = pts.withColumn("f1", f1).withColumn("j", F.col("tpr") - F.col("fpr"))
    out = pts.groupBy(*keys).agg(
        F.first("pos").alias("pos"),
        F.first("neg").alias("neg"),
        F.sum((F.col("tp") - F.col("np") / F.lit(2.0)) * F.col("nn")).alias("area"),
        F.sum(F.col("np") * F.col("precision")).alias("steps"),
        F.max_by("score", F.struct("j", "score")).alias("ba_threshold"),
        F.max("j").alias("ba_j"),
        F.max_by(F.struct("score", "precision", "recall", "f1"), F.struct(F.col("f1"), -F.col("score"))).alias("best"),
    )
    both = F.col("pos").cast("double") * F.col("neg")
    return out.select(
        *keys,
        "pos",
        "neg",
        F.try_divide("area", both).alias("roc_auc"),
        F.when(both > 0, F.try_divide(F.col("steps"), F.col("pos").cast("double"))).alias("average_precision"),
        F.when(F.col("ba_j") > 0, F.col("ba_threshold")).otherwise(float("inf")).alias("ba_threshold"),
        F.col("best.score").alias("f1_threshold"),
        F.col("best.precision").alias("f1_precision"),
        F.col("best.recall").alias("f1_recall"),
        F.col("best.f1").alias("f1_best"),
    )


def span_summary(rows: DataFrame, totals: DataFrame, keys: Sequence[str], ns: Sequence[int], default: float = 0.0) -> DataFrame:
    """(keys, n, roc_auc, ba_threshold, f1_threshold) of the curves n of each key, as curve_summary of with_default has them.

    rows: (keys, low, high, score, label); a row counts in all curves from low to high, so that a score that
    stays for several n is moved and sorted once. totals: (keys, pos, neg), a row for each key, of every curve;
    rows of other keys must not be given. What has no row takes the default, below which no score may lie.
    A key's rows stream through a task by falling score, which holds a few sums for each n.
    """
    keys = list(keys)
    given = rows.filter(F.col("score").isNotNull() & F.col("label").isNotNull()).select(*keys, F.col("low").cast("int"), F.col("high").cast("int"), F.col("score").cast("double"), F.col("label").cast("int"))
    blank = {c: F.lit(None).cast("bigint") for c in ("pos", "neg")}
    first = totals.select(*keys, *[F.lit(None).cast(t).alias(c) for c, t in given.dtypes if c not in keys], F.col("pos").cast("bigint"), F.col("neg").cast("bigint"))
    ordered = given.withColumns(blank).unionByName(first).repartition(*keys).sortWithinPartitions(*keys, F.col("pos").isNull(), F.desc("score"))
    at, names = np.array(sorted(ns)), ["roc_auc", "ba_threshold", "f1_threshold"]
    schema = StructType([*totals.select(*keys).schema.fields, *StructType.fromDDL("n int, " + ", ".join(f"{c} double" for c in names)).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pos, neg, held = None, 0, 0, None
        tp = fp = area = j = j_at = f = f_at = None

        def points(scores: np.ndarray, p: np.ndarray, n: np.ndarray) -> None:
            """Go on by distinct scores with their positives and negatives in each curve."""
            nonlocal tp, fp, area
            tps, fps, seen = tp + np.cumsum(p, axis=0), fp + np.cumsum(n, axis=0), p + n > 0
            tp, fp = tps[-1], fps[-1]
            if not pos or not neg:
                return
            area += ((tps - p / 2) * n).sum(0)
            some, recall = np.where(seen, tps / pos - fps / neg, -np.inf), tps / pos
            precision = tps / np.maximum(tps + fps, 1)
            both = np.where(seen, 2 * precision * recall / (precision + recall + 1e-12), -np.inf)
            best = some.argmax(0), len(both) - 1 - both[::-1].argmax(0)
            for value, of, score, i, more in ((j, some, j_at, best[0], np.greater), (f, both, f_at, best[1], np.greater_equal)):
                top = np.take_along_axis(of, i[None], axis=0)[0]
                won = more(top, value) & (top > -np.inf)
                value[won], score[won] = top[won], scores[i[won]]

        def close() -> pa.RecordBatch:
            nonlocal held
            if held is not None and held[0] != default:
                points(np.array([held[0]]), *held[1:])
            held = None
            points(np.array([default]), pos - tp[None], neg - fp[None])
            fixed = [c.take(pa.array(np.zeros(len(at), np.int64))) for c in key]
            whole = pos > 0 and neg > 0
            auc = pa.array(area / (float(pos) * neg) if whole else np.zeros(len(at)), mask=np.full(len(at), not whole))
            return pa.RecordBatch.from_arrays([*fixed, pa.array(at, pa.int32()), auc, pa.array(np.where(j > 0, j_at, np.inf)), pa.array(f_at)], names=schema.names)

        for batch in batches:
            for a in range(0, batch.num_rows, 8192):
                part = batch.slice(a, 8192)
                low, high, score, label, p, n = part.columns[len(keys) :]
                starts = np.flatnonzero(p.is_valid().to_numpy(zero_copy_only=False))
                cuts = np.unique(np.r_[0, starts, part.num_rows]).tolist()
                for b, e in zip(cuts[:-1], cuts[1:], strict=True):
                    if p[b].is_valid:  # a key begins
                        if key is not None:
                            yield close()
                        key, pos, neg = [c.slice(b, 1) for c in part.columns[: len(keys)]], p[b].as_py(), n[b].as_py()
                        tp, fp, area = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.zeros(len(at))
                        j, j_at, f, f_at = (np.full(len(at), x) for x in (-np.inf, np.nan, -np.inf, np.nan))
                        b += 1
                    if b >= e:
                        continue
                    s, lows, highs, y = (c.slice(b, e - b).to_numpy() for c in (score, low, high, label))
                    inside = (lows[:, None] <= at) & (at <= highs[:, None])
                    new = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
                    count, good = np.add.reduceat(inside, new, axis=0, dtype=np.int64), np.add.reduceat(inside * y[:, None], new, axis=0, dtype=np.int64)
                    scores, good, bad = s[new], good, count - good
                    if held is not None:  # the last score before may go on
                        if held[0] == scores[0]:
                            good[:1] += held[1]
                            bad[:1] += held[2]
                        else:
                            scores, good, bad = np.r_[held[0], scores], np.r_[held[1], good], np.r_[held[2], bad]
                    held = scores[-1], good[-1:], bad[-1:]
                    if len(scores) > 1:
                        points(scores[:-1], good[:-1], bad[:-1])
        if key is not None:
            yield close()

    return ordered.mapInArrow(run, schema)


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 of counts; an empty denominator gives 0."""
    zero = F.lit(0.0)
    tp = tp.cast("double")
    precision = F.coalesce(F.try_divide(tp, tp + fp), zero)
    recall = F.coalesce(F.try_divide(tp, tp + fn), zero)
    return precision, recall, F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), zero)


def at_threshold(groups: DataFrame, keys: Sequence[str], threshold: str = "threshold") -> DataFrame:
    """(keys, tp, fp, fn, tn, precision, recall, f1): rows whose score is above, not at, the threshold count as positive."""
    above = F.col("score") > F.col(threshold)
    zero = F.lit(0)
    sums = groups.groupBy(*keys).agg(*[F.sum(F.when(c, F.col(x)).otherwise(zero)).alias(n) for n, c, x in (("tp", above, "np"), ("fp", above, "nn"), ("fn", ~above, "np"), ("tn", ~above, "nn"))])
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return sums.withColumns({"precision": p, "recall": r, "f1": f})


def rank_metrics(df: DataFrame, keys: Sequence[str], ks: Sequence[int], score: str = "score", label: str = "label", ties: Sequence[Column | str] = ("word",), divide_by_k: bool = False) -> DataFrame:
    """(keys, k, size, pos, tp, precision, recall, specificity, f1) among the k first by score, then ties.

    Precision divides by min(k, size), or by k; empty denominators give 0.
    """
    y = F.col(label).cast("int")
    totals = df.groupBy(*keys).agg(F.count("*").alias("size"), F.sum(y).alias("pos"))
    order = Window.partitionBy(*keys).orderBy(F.desc(score), *ties)
    top = df.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= max(ks))
    return _at_ks(totals, top.select(*keys, "rn", y.alias("y")), keys, ks, divide_by_k)


def _at_ks(totals: DataFrame, top: DataFrame, keys: Sequence[str], ks: Sequence[int], divide_by_k: bool = False) -> DataFrame:
    """rank_metrics from (keys, size, pos) and the first rows (keys, rn, y)."""
    hits = top.groupBy(*keys).agg(*[F.sum(F.when(F.col("rn") <= k, F.col("y")).otherwise(0)).alias(f"tp{k}") for k in ks])
    long = ", ".join(f"{k}, tp{k}" for k in ks)
    rows = totals.join(hits, list(keys)).select(*keys, "size", "pos", F.expr(f"stack({len(ks)}, {long}) as (k, tp)"))
    tp, zero = F.col("tp").cast("double"), F.lit(0.0)
    negatives = F.col("size") - F.col("pos")
    shown = F.col("k") if divide_by_k else F.least("k", "size")
    wrong = F.least("k", "size") - F.col("tp")
    p, r = F.coalesce(F.try_divide(tp, shown), zero), F.coalesce(F.try_divide(tp, F.col("pos")), zero)
    return rows.select(*keys, "k", "size", "pos", "tp", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide((negatives - wrong).cast("double"), negatives), zero).alias("specificity"), F.coalesce(F.try_divide(2 * p * r, p + r), zero).alias("f1"))


class _Ranked:
    """Of one list of scores the negatives between and at the positives' scores, and the k first rows, while the list passes by."""

    def __init__(self, scores: np.ndarray, k: int):
        self.at, self.np = np.unique(scores, return_counts=True)
        self.nn, self.k = np.zeros(2 * len(self.at) + 1, np.int64), k
        self.top = [np.empty(0), np.empty(0, np.int8), np.empty((0, 2), ">u8"), np.empty(0, np.int64)]

    def count(self, scores: np.ndarray) -> None:
        """Place 2 i + 1 is that of the positives' i-th score; 2 i that between it and the one below."""
        place = np.searchsorted(self.at, scores, "left") + np.searchsorted(self.at, scores, "right")
        self.nn += np.bincount(place, minlength=len(self.nn))

    def rank(self, scores: np.ndarray, valid: np.ndarray, ties: np.ndarray, labels: np.ndarray) -> None:
        """Null comes last and NaN first, as in a falling order of Spark's."""
        kind = np.where(valid, np.where(np.isnan(scores), 2, 1), 0).astype(np.int8)
        value = np.where(kind == 2, np.inf, np.where(kind == 0, -np.inf, scores))
        new = [value, kind, ties, labels]
        if len(self.top[0]) >= self.k:
            near = np.flatnonzero(value >= self.top[0].min())
            new = [x[near] for x in new]
        rows = [np.concatenate(x) for x in zip(self.top, new, strict=True)]
        if len(rows[0]) > self.k:
            near = np.flatnonzero(rows[0] >= np.partition(rows[0], len(rows[0]) - self.k)[-self.k])
            rows = [x[near] for x in rows]
            first = np.lexsort((rows[2][:, 1], rows[2][:, 0], -rows[0], -rows[1]))[: self.k]
            rows = [x[first] for x in rows]
        self.top = rows


def wide_metrics(df: DataFrame, keys: Sequence[str], methods: Sequence[str], ks: Sequence[int], tie: Column, parts: int = 1, word: str = "word", label: str = "label") -> DataFrame:
    """(keys, method, roc_auc, average_precision, k, precision, recall, specificity, f1) of scores that stand in a column for each method.

    As curve_summary and rank_metrics have them, ties at k in the order of tie, 16 bytes. A row is moved once for all methods. A
    task takes a key's positives, then its negatives as they pass by, and keeps of them how many lie at and between
    the positives' scores, which is all that both areas depend on, and the first rows. parts: into how many
    parts a key's negatives are dealt where there are few keys; positives go to each.
    """
    keys, methods, most = list(keys), list(methods), max(ks)
    of = F.pmod(F.xxhash64(word), F.lit(parts)).cast("int")
    y = F.col(label).cast("bigint")
    rows = df.select(*keys, of.alias("_own"), y.alias("_y"), F.coalesce(y == 1, F.lit(False)).alias("_asks"), tie.alias("_tie"), *[F.col(m).cast("double").alias(m) for m in methods])
    dealt = F.explode(F.when(F.col("_asks"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array("_own")))
    rows = rows.select(*keys, dealt.alias("_part"), "_asks", "_own", "_y", "_tie", *methods).repartition(*keys, "_part").sortWithinPartitions(*keys, "_part", F.desc("_asks"))
    n = len(keys)
    schema = StructType([*df.select(*keys).schema.fields, *StructType.fromDDL("method string, place bigint, np bigint, nn bigint, size bigint, pos bigint, value double, kind int, tie binary, y bigint").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by keys and part, positives first."""
        unit, held, lists, size, pos = None, [], None, 0, 0

        def take(part: pa.RecordBatch) -> None:
            nonlocal size, pos
            own, label, tie = part.column(n + 2).to_numpy(), part.column(n + 3), part.column(n + 4)
            mine = np.flatnonzero((own == unit[1]) | ~np.asarray(part.column(n + 1).to_numpy(zero_copy_only=False), bool))
            labels = label.fill_null(0).to_numpy()
            ties = np.frombuffer(b"".join(tie.to_pylist()), ">u8").reshape(-1, 2)
            size, pos = size + len(mine), pos + int(labels[mine].sum())
            for m, x in enumerate(part.columns[n + 5 :]):
                valid, scores = x.is_valid().to_numpy(zero_copy_only=False), x.fill_null(0.0).to_numpy()
                if lists[m] is None:
                    lists[m] = _Ranked(scores[valid], most)
                else:
                    lists[m].count(scores[valid & label.is_valid().to_numpy(zero_copy_only=False)])
                lists[m].rank(scores[mine], valid[mine], ties[mine], labels[mine])

        def start() -> None:
            """The unit's positives are there; without any the lists begin empty."""
            nonlocal lists, held
            if lists is None:
                lists = [None] * len(methods)
                take(pa.concat_batches(held) if held else blank)
                held = []

        def close() -> Iterator[pa.RecordBatch]:
            start()
            fixed = lambda c: [k.take(pa.array(np.zeros(c, np.int64))) for k in unit[2]]
            none = lambda c, t: pa.nulls(c, t)
            i, f = pa.int64(), pa.float64()
            yield pa.RecordBatch.from_arrays([*fixed(1), none(1, pa.string()), none(1, i), none(1, i), none(1, i), pa.array([size], i), pa.array([pos], i), none(1, f), none(1, pa.int32()), none(1, pa.binary()), none(1, i)], names=schema.names)
            for name, x in zip(methods, lists, strict=True):
                good = np.zeros(len(x.nn), np.int64)
                if unit[1] == 0:  # positives are in all parts
                    good[1::2] = x.np
                at = np.flatnonzero(good + x.nn)
                c = len(at)
                yield pa.RecordBatch.from_arrays([*fixed(c), pa.array([name] * c, pa.string()), pa.array(at, i), pa.array(good[at]), pa.array(x.nn[at]), *[none(c, i)] * 2, none(c, f), none(c, pa.int32()), none(c, pa.binary()), none(c, i)], names=schema.names)
                value, kind, ties, labels = x.top
                c = len(value)
                yield pa.RecordBatch.from_arrays([*fixed(c), pa.array([name] * c, pa.string()), *[none(c, i)] * 5, pa.array(value), pa.array(kind.astype(np.int32)), pa.array([t.tobytes() for t in ties.astype(">u8")], pa.binary()), pa.array(labels)], names=schema.names)

        blank = None
        for batch in batches:
            if not batch.num_rows:
                continue
            blank = batch.slice(0, 0)
            new = np.zeros(batch.num_rows, bool)
            new[0] = True
            for c in batch.columns[: n + 2]:
                a, b = c[1:], c[:-1]
                new[1:] |= (pa.compute.fill_null(pa.compute.not_equal(a, b), False).to_numpy(zero_copy_only=False)) | (a.is_valid().to_numpy(zero_copy_only=False) != b.is_valid().to_numpy(zero_copy_only=False))
            starts = np.flatnonzero(new)
            for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                here = tuple(c[a].as_py() for c in batch.columns[:n])
                part = int(batch.column(n)[a].as_py())
                if unit is None or (here, part) != unit[:2]:
                    if unit is not None:
                        yield from close()
                    unit, held, lists, size, pos = (here, part, [c.slice(a, 1) for c in batch.columns[:n]]), [], None, 0, 0
                if batch.column(n + 1)[a].as_py():
                    held.append(batch.slice(a, b - a))
                else:
                    start()
                    take(batch.slice(a, b - a))
        if unit is not None:
            yield from close()

    found = written(rows.mapInArrow(run, schema))
    by = [*keys, "method"]
    groups = found.filter("place is not null").groupBy(*by, F.col("place").cast("double").alias("score")).agg(F.sum("np").alias("np"), F.sum("nn").alias("nn"))
    totals = found.filter("size is not null").groupBy(*keys).agg(F.sum("size").alias("size"), F.sum("pos").alias("pos"))
    order = Window.partitionBy(*by).orderBy(F.desc("kind"), F.desc("value"), "tie")
    top = found.filter("value is not null").select(*by, F.row_number().over(order).alias("rn"), "y").filter(F.col("rn") <= most)
    points = curve_summary(groups, by).select(*by, "roc_auc", "average_precision")
    ranks = _at_ks(totals.withColumn("method", F.explode(F.array(*map(F.lit, methods)))), top, by, ks).select(*by, "k", "precision", "recall", "specificity", "f1")
    return points.join(ranks, by)


def best_by(df: DataFrame, keys: Sequence[str], value: str, prefer: Sequence[Column]) -> DataFrame:
    """The row of the largest value per key; NaN and null never win; ties go to the least `prefer`."""
    order = Window.partitionBy(*keys).orderBy(F.desc(value), *prefer)
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return rows.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")
