"""The user-facing evaluations, put together from the operators."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..functions import scalar
from ..functions.scalar import WEIGHTS
from ..operators import curves, lexical, models, neighbours, splits, summary, units, vectors
from ..sources.files import written

METHODS = ("vote", "mindist", "avgdist", "centroid", "mindist_all", "avgdist_all", "votetopk_all", "lexical", "hybrid", "pu_lr", "pu_rn")
#: What features() gives.
FEATURES = ("vote", "mindist", "avgdist", "cnt", "centroid", "mindist_all", "avgdist_all", "votetopk_all", "lexical")
#: Decimals of scores before ties are told.
DIGITS = 10
#: Rows that are given to each task as one value.
FEW = 100_000
#: Lengths of the reports.
KS = (50, 100, 200)


def _each(df: DataFrame, few: DataFrame) -> DataFrame:
    """df's rows with each of a few distinct rows (splits, parts, configurations), which reach the tasks as one value, not by a join.

    More than FEW of them are an error, so that what a task is given has a bound.
    """
    found = few.distinct().limit(FEW + 1).agg(F.collect_list(F.struct(*few.columns))).scalar()
    listed = df.withColumn("_few", found)
    checked = F.when(F.size("_few") <= FEW, F.col("_few")).otherwise(F.raise_error(F.lit(f"more than {FEW} rows for each row")))
    return listed.withColumn("_few", F.explode(checked)).select(*df.columns, "_few.*")


def background_of(all_splits: DataFrame, words: DataFrame, stop: DataFrame) -> DataFrame:
    """(word): the words of neither the glossary (all splits' words) nor the stop list; one list for all splits and parts."""
    outside = all_splits.select("word").union(stop.select("word")).distinct()
    return words.select("word").distinct().join(outside, "word", "left_anti")


def positives_of(all_splits: DataFrame, words: DataFrame) -> DataFrame:
    """(split_id, part, word, label): the splits' dev and test words among `words`."""
    known = words.select("word").distinct()
    return all_splits.filter(F.col("part").isin("dev", "test")).join(known, "word", "left_semi").select("split_id", "part", "word", F.lit(1).alias("label"))


def pools(all_splits: DataFrame, words: DataFrame, stop: DataFrame, background: str = "glossary") -> DataFrame:
    """(split_id, part, word, label): dev and test words among `words` as positives, against background negatives.

    background: `glossary`, see background_of, or `ref`: all words but the split's reference and the part's
    own words. This lists every word for each split and part; sampled_pools and evaluations over all of the
    background (select_and_test, pool_counts, split_counts) count it instead.
    """
    positive = positives_of(all_splits, words)
    parts = F.explode(F.array(F.lit("dev"), F.lit("test")))
    cells = all_splits.select("split_id").distinct().withColumn("part", parts)
    if background == "glossary":
        negative = _each(background_of(all_splits, words, stop), cells)
    elif background == "ref":
        ref = all_splits.filter("part = 'ref'").select("split_id", "word")
        own = all_splits.select("split_id", "part", "word").unionByName(ref.withColumn("part", parts))
        # each word carries the numbers of the cells that it isn't in: rows for words and cells are never joined
        numbered = written(cells.distinct().withColumn("_at", F.row_number().over(Window.orderBy("split_id", "part"))))  # few rows
        taken = own.join(numbered, ["split_id", "part"]).groupBy("word").agg(F.collect_set("_at").alias("_own"))
        free = words.select("word").distinct().join(stop.select("word").distinct(), "word", "left_anti").join(taken, "word", "left")
        found = numbered.limit(FEW + 1).agg(F.collect_list("_at")).scalar()
        listed = free.withColumn("_few", found)
        checked = F.when(F.size("_few") <= FEW, F.col("_few")).otherwise(F.raise_error(F.lit(f"more than {FEW} rows for each row")))
        rest = F.explode(F.array_except(checked, F.coalesce("_own", F.array().cast("array<int>"))))
        negative = listed.select("word", rest.alias("_at")).join(numbered, "_at").drop("_at")
    else:
        raise ValueError(f"unknown background {background!r}; known: glossary, ref")
    negative = negative.withColumn("label", F.lit(0))
    return positive.unionByName(negative.select("split_id", "part", "word", "label"))


def pool_counts(all_splits: DataFrame, words: DataFrame, stop: DataFrame) -> DataFrame:
    """(split_id, part, pos, neg): the sizes of `pools`, whose background isn't listed for them."""
    positive = positives_of(all_splits, words).groupBy("split_id", "part").agg(F.count("*").alias("pos"))
    cells = all_splits.select("split_id").distinct().withColumn("part", F.explode(F.array(F.lit("dev"), F.lit("test"))))
    size = background_of(all_splits, words, stop).agg(F.count("*")).scalar()
    return cells.join(positive, ["split_id", "part"], "left").select("split_id", "part", F.coalesce("pos", F.lit(0)).alias("pos"), size.alias("neg"))


def sampled_pools(all_splits: DataFrame, words: DataFrame, stop: DataFrame, neg_ratio: float, seed: int = 42) -> DataFrame:
    """`pools` with a seeded sample of the background for each split and part, at most neg_ratio negatives per positive.

    The background is counted and hashed, never listed for the splits (splits.sample_each).
    """
    positive = positives_of(all_splits, words)
    cells = positive.groupBy("split_id", "part").agg(F.floor(F.count("*") * neg_ratio).alias("most"))
    negative = splits.sample_each(written(background_of(all_splits, words, stop)), cells, ["part", "split_id"], seed)
    return positive.unionByName(negative.select("split_id", "part", "word", F.lit(0).alias("label")))


def split_counts(vecs: DataFrame, all_splits: DataFrame, stop: DataFrame, ks: Sequence[int] = KS, neg_ratio: float = 10, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Sizes of each split's evaluation, and the training negatives (split_id, word) that are left out of it.

    (split_id, ref, dev, test, ref_usable, test_pos, train_neg_used, ranked_neg, ranked_total, prevalence,
    chance_at_<k>): the parts' words; reference and test words with a vector; background words that are used
    as a seeded sample or as those of lowest centroid similarity, neg_ratio of either for each usable
    reference word; and what is ranked, with the terms that k random words would hold. Splits without a
    centroid or a test word with a vector are left out. The background is never listed for the splits.
    """
    part = lambda p: all_splits.filter(F.col("part") == p).select("split_id", "word")
    known = vecs.select("word")
    background = written(vecs.join(background_of(all_splits, vecs, stop), "word", "left_semi").select("word", "v"))
    centres = vectors.centroids(vecs, part("ref"), ["split_id"])
    held = all_splits.join(known, "word", "left_semi").groupBy("split_id").agg(F.count_if(F.col("part") == "ref").alias("ref_usable"), F.count_if(F.col("part") == "test").alias("test_pos"))
    n = background.agg(F.count("*")).scalar()
    most = F.least(n, F.floor(F.col("ref_usable") * neg_ratio))
    cells = written(centres.join(held.filter("test_pos > 0"), "split_id").withColumn("most", most))
    random = splits.sample_each(background.select("word"), cells.select(F.lit("train").alias("salt"), "split_id", "most"), ["salt", "split_id"], seed)
    reliable = vectors.lowest(background, cells, ["split_id"], "most")
    used = written(random.select("split_id", "word").union(reliable.select("split_id", "word")).distinct())
    sizes = all_splits.groupBy("split_id").agg(*[F.count_if(F.col("part") == p).alias(p) for p in splits.PARTS])
    out = cells.select("split_id", "ref_usable", "test_pos").join(sizes, "split_id").join(used.groupBy("split_id").agg(F.count("*").alias("train_neg_used")), "split_id")
    out = out.withColumn("ranked_neg", n - F.col("train_neg_used")).withColumn("ranked_total", F.col("test_pos") + F.col("ranked_neg"))
    p = F.col("test_pos").cast("double") / F.col("ranked_total")
    return out.select("split_id", *splits.PARTS, "ref_usable", "test_pos", "train_neg_used", "ranked_neg", "ranked_total", p.alias("prevalence"), *[(k * p).alias(f"chance_at_{k}") for k in ks]), used


def select_and_test(scores: DataFrame, pool: DataFrame, configs: Sequence[str], prefer: Sequence[Column], default: float, within: Sequence[str] = (), ks: Sequence[int] = KS, on: str = "ba", background: DataFrame | None = None) -> DataFrame:
    """A row per split (and `within`): the configuration of best dev ROC AUC, its dev threshold, and test metrics.

    scores: ([split_id,] configs, query, score), sparse: words of the pool without a row have the default
    score, which is below all scores; they are counted, not listed, for the curves. The last of configs is
    a number; scores may instead have low and high, between which a score stays. background: words that
    are negatives in every split and part, beside those of the pool; of those without a score only as many
    are ranked as a report at k can hold. The threshold is applied strictly; if then all or none of the
    test words are positive, precision, recall and F1 are those of the test's F1 threshold. Splits without
    both classes in dev or test are left out.
    """
    scores, pool = written(scores), written(pool)
    named = scores.withColumnRenamed("query", "word")
    own = "split_id" in scores.columns
    at, kinds, span = ["split_id", *configs], list(configs[:-1]), "low" in scores.columns
    n = configs[-1]
    totals = pool.groupBy("split_id", "part").agg(F.sum("label").alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    if background is not None:
        background = written(background)
        totals = totals.withColumn("neg", F.col("neg") + background.agg(F.count("*")).scalar())

    def listed(part: str, rows: DataFrame) -> DataFrame:
        """(split_id, configs, word, label, score) of a part's scored words, and of those of the background."""
        of = ["split_id", *[c for c in rows.columns if c not in ("split_id", "word", "score")], "word"]
        words = rows.join(pool.filter(F.col("part") == part).select("split_id", "word", "label"), ["split_id", "word"] if "split_id" in rows.columns else ["word"]).select(*of, "label", "score")
        if background is None:
            return words
        beside = (rows if "split_id" in rows.columns else _each(rows, pool.select("split_id").distinct())).join(background, "word", "left_semi")
        return words.unionByName(beside.select(*of, F.lit(0).alias("label"), "score"))

    grid = scores.select(*kinds, "low", "high").distinct().select(*kinds, F.explode(F.sequence("low", "high")).alias(n)) if span else scores.select(*configs)
    grid = written(grid.distinct())
    ns = [r[0] for r in grid.select(n).distinct().collect()]
    whole = totals.filter("part = 'dev'").drop("part")
    # words of the default score are counted with those that have no row
    rows = listed("dev", named.filter(F.col("score") != default)).join(whole.select("split_id"), "split_id", "left_semi")
    if not span:
        rows = rows.withColumns({"low": F.col(n), "high": F.col(n)})
    dev = curves.span_summary(rows, _each(whole, grid.select(*kinds)), ["split_id", *kinds], ns, default).withColumnRenamed("n", n).join(grid, list(configs), "left_semi")
    dev = dev.select(*at, F.col("roc_auc").alias("dev_roc_auc"), F.col(f"{on}_threshold").alias("threshold"))
    chosen = written(curves.best_by(dev, ["split_id", *within], "dev_roc_auc", prefer))
    # the test part is looked at for the chosen configurations only
    if span:
        named = named.join(chosen.select(*at), ["split_id", *kinds] if own else kinds).filter(F.col(n).between(F.col("low"), F.col("high")))
    else:
        named = named.join(chosen.select(*at), at if own else list(configs))
    found = written(listed("test", named.select(*at, "word", "score")))
    whole = totals.filter("part = 'test'").drop("part").join(chosen.select(*at), "split_id")
    groups = written(curves.with_default(curves.score_groups(found, at), whole, at, default))
    test = curves.curve_summary(groups, at).filter("roc_auc is not null").join(chosen, at)
    cut = curves.at_threshold(groups.join(chosen, at), at)
    same = (F.col("tp") + F.col("fp") == 0) | (F.col("fn") + F.col("tn") == 0)
    out = test.join(cut.withColumn("same", same), at).select(*at, "dev_roc_auc", "threshold", "roc_auc", "average_precision", *[F.when(F.col("same"), F.col(f"f1_{a}")).otherwise(F.col(b)).alias(b) for a, b in (("precision", "precision"), ("recall", "recall"), ("best", "f1"))])
    rest = pool.filter("part = 'test'").select("split_id", "word", "label").join(chosen.select(*at), "split_id")
    if background is not None:
        # fewer than k scored words leave room for the default's first; of the 2 k first words at least k have no score then
        first = background.orderBy("word").limit(2 * max(ks)).withColumn("label", F.lit(0))
        rest = rest.unionByName(_each(first, chosen.select(*at)).select(*rest.columns))
    ranked = found.unionByName(rest.join(found, [*at, "word"], "left_anti").withColumn("score", F.lit(default)).select(*found.columns))
    ranks = curves.rank_metrics(ranked, at, ks)
    wide = ranks.groupBy(*at).agg(*[F.max(F.when(F.col("k") == k, F.col("precision"))).alias(f"precision_at_{k}") for k in ks])
    return out.join(wide, at)


def weight_order(weight: str = "weight_type", order: Sequence[str] = WEIGHTS) -> Column:
    """A weight type's place in the order of choice."""
    return F.array_position(F.array(*map(F.lit, order)), F.col(weight))


def list_evaluate(nbr: DataFrame, all_splits: DataFrame, words: DataFrame, stop: DataFrame, limit: int, mode: str = "vote", neg_ratio: float | None = None, ks: Sequence[int] = KS) -> DataFrame:
    """Scores by reference terms among the neighbours; per split the dev-selected configuration and test metrics."""
    ref = all_splits.filter("part = 'ref'").select("split_id", "word")
    scores = neighbours.list_spans(nbr, ref, ["split_id"], limit, mode)
    pool, beside = (positives_of(all_splits, words), background_of(all_splits, words, stop)) if neg_ratio is None else (written(sampled_pools(all_splits, words, stop, neg_ratio)), None)
    return select_and_test(scores, pool, ["weight_type", "n"], [weight_order(), F.col("n")], neighbours.default_score(mode), ks=ks, background=beside)


def grid_evaluate(votes: DataFrame, keys: Sequence[str] = ("weight_type", "n")) -> DataFrame:
    """(keys, threshold_on, roc_auc, average_precision, threshold, precision, recall, f1) of votes (keys, query, label, score)."""
    groups = curves.score_groups(votes, keys)
    points = curves.curve_summary(groups, keys)
    ba = points.select(*keys, F.lit("ba").alias("threshold_on"), "roc_auc", "average_precision", F.col("ba_threshold").alias("threshold"))
    cut = curves.at_threshold(groups.join(ba.select(*keys, "threshold"), list(keys)), keys).select(*keys, "precision", "recall", "f1")
    f1 = points.select(*keys, F.lit("f1").alias("threshold_on"), "roc_auc", "average_precision", F.col("f1_threshold").alias("threshold"), F.col("f1_precision").alias("precision"), F.col("f1_recall").alias("recall"), F.col("f1_best").alias("f1"))
    return ba.join(cut, list(keys)).unionByName(f1)


def split_evaluate(votes: DataFrame, all_splits: DataFrame, ks: Sequence[int] = KS) -> DataFrame:
    """Stored votes (weight_type, n, query, label, score) under each split's own dev and test words; weight types by name."""
    pool = all_splits.filter(F.col("part") != "ref").join(votes.select(F.col("query").alias("word"), "label").distinct(), "word").select("split_id", "part", "word", "label")
    return select_and_test(votes.select("weight_type", "n", "query", "score"), pool, ["weight_type", "n"], [F.col("weight_type"), F.col("n")], 0.0, ks=ks)


def approach_scores(nbr: DataFrame) -> DataFrame:
    """(approach, weight_type, n, query, score): votes, normalised votes and exp(-central distance) of every prefix."""
    votes = neighbours.prefix_votes(nbr).select("query", "weight_type", "n", F.explode(F.map_from_arrays(F.array(F.lit("votes"), F.lit("votes_norm")), F.array("vote", "vote_norm"))).alias("approach", "score"))
    far = neighbours.prefix_distances(nbr).select("query", "n", F.explode(F.map_from_arrays(F.array(F.lit("mean"), F.lit("median")), F.array("central_mean", "central_median"))).alias("weight_type", "d"))
    far = far.select("query", "weight_type", "n", F.lit("distances").alias("approach"), F.exp(-F.col("d")).alias("score"))
    return votes.unionByName(far).withColumn("score", F.round("score", DIGITS))


def approach_evaluate(nbr: DataFrame, labels: DataFrame, all_splits: DataFrame, ks: Sequence[int] = KS) -> DataFrame:
    """The best configuration of each approach, per split, with the F1 threshold of dev."""
    pool = all_splits.filter(F.col("part") != "ref").join(labels, "word").select("split_id", "part", "word", "label")
    return select_and_test(approach_scores(nbr), pool, ["approach", "weight_type", "n"], [F.col("weight_type"), F.col("n")], 0.0, within=["approach"], ks=ks, on="f1")


def split_report(results: DataFrame, metrics: Sequence[str], keys: Sequence[str] = (), resamples: int = 10_000) -> DataFrame:
    """(keys, metric, n, mean, std, median, least, most, ci_low, ci_high) of per-split results."""
    long = written(results.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(list(keys), list(metrics), "metric", "value"))
    by = [*keys, "metric"]
    return summary.summarise(long, by).join(summary.bootstrap_ci(long, by, resamples=resamples), by)


def report_tables(results: DataFrame, info: DataFrame, metrics: Sequence[str], resamples: int = 10_000, bins: int = 20) -> dict[str, DataFrame]:
    """The tables of a report over splits, by name.

    results: a row per split (split_id, ..., metrics); info: (split_id, part, size, matched, positive,
    negative) of summary.split_info. split_info and per_split_results are these; aggregated_split_results
    is one row with <metric>_mean, _std, _median, _min, _max, _ci95_lo and _ci95_hi; split_distribution counts
    each metric's values in `bins` equal bins; test_statistics has least, most, mean and median of the test
    parts' matched, positive and negative words and positive rate.
    """
    results, info = written(results), written(info)
    report = written(split_report(results, metrics, resamples=resamples))
    names = {"mean": "mean", "std": "std", "median": "median", "least": "min", "most": "max", "ci_low": "ci95_lo", "ci_high": "ci95_hi"}
    wide = report.agg(*[F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{m}_{n}") for m in metrics for c, n in names.items()])
    long = results.select(*[F.col(m).cast("double").alias(m) for m in metrics]).unpivot([], list(metrics), "metric", "value")
    test = info.filter("part = 'test'").select(F.col("matched").cast("double").alias("test_matched"), F.col("positive").cast("double").alias("test_positive"), F.col("negative").cast("double").alias("test_negative"), F.coalesce(F.try_divide(F.col("positive").cast("double"), F.col("matched")), F.lit(0.0)).alias("test_positive_rate"))
    measures = test.unpivot([], test.columns, "measure", "value")
    statistics = measures.groupBy("measure").agg(F.min("value").alias("least"), F.max("value").alias("most"), F.avg("value").alias("mean"), F.percentile("value", 0.5).alias("median"))
    return {"split_info": info, "per_split_results": results, "aggregated_split_results": wide, "split_distribution": summary.histogram(long, ["metric"], bins=bins), "test_statistics": statistics}


def centroid_evaluate(vecs: DataFrame, all_splits: DataFrame, stop: DataFrame, restrict: DataFrame | None = None, ks: Sequence[int] = KS) -> DataFrame:
    """(split_id, k, pos, neg, roc_auc, average_precision, precision): test terms ranked by similarity to the reference centroid."""
    centres = written(vectors.centroids(vecs, all_splits.filter("part = 'ref'").select("split_id", "word"), ["split_id"]))
    words = vecs if restrict is None else vecs.join(restrict.select("word").distinct(), "word", "left_semi")
    tested = positives_of(all_splits, words).filter("part = 'test'").select("split_id", "word", "label")
    # rows for splits and words are merged: taken by their bytes on disk they would be broadcast
    known = vectors.centroid_similarity(words.join(tested.select("word").distinct(), "word", "left_semi"), centres, ["split_id"]).join(tested.hint("merge"), ["split_id", "word"])
    beside = vectors.centroid_similarity(words.join(background_of(all_splits, words, stop), "word", "left_semi"), centres, ["split_id"])
    scored = known.unionByName(beside.withColumn("label", F.lit(0)))
    points = curves.curve_summary(curves.score_groups(scored, ["split_id"], "csim"), ["split_id"]).filter("pos > 0")
    ranks = curves.rank_metrics(scored, ["split_id"], ks, "csim").select("split_id", "k", "precision")
    return points.select("split_id", "pos", "neg", "roc_auc", "average_precision").join(ranks, "split_id")


def features(vecs: DataFrame, nbr: DataFrame, all_splits: DataFrame, topk: int = 10, blank_self: bool = False, words: DataFrame | None = None) -> DataFrame:
    """(split_id, word, vote, mindist, avgdist, cnt, centroid, mindist_all, avgdist_all, votetopk_all, lexical).

    words: spellings for the lexical column; the words themselves without it. A feature without support is 0.
    """
    keys, ref = ["split_id"], all_splits.filter("part = 'ref'").select("split_id", "word")
    centre = {r["split_id"]: r["c"] for r in vectors.centroids(vecs, ref, keys).collect()}  # a row for each split
    held, cells = units.held_by(written(ref.distinct()), keys)
    own, members = lexical.gram_vectors(vecs.select("word") if words is None else words, held)
    # a word's rows come from one task: what splits and words have is never joined
    met = vecs.select("word", "v").join(own, "word", "left").join(neighbours.member_hits(nbr, held), "word", "left").select("word", "v", "grams", "hits")
    known = held.join(vecs.select("word", "v"), "word", "left").join(members, "word", "left")
    there = np.array([c[0] in centre for c in cells], bool)
    width = max(map(len, centre.values()), default=0)
    matrix = np.array([centre.get(c[0], np.zeros(width)) for c in cells]).reshape(len(cells), -1 if width else 0)

    class Met:
        def __init__(self, words: pa.RecordBatch):
            word, v, grams, hits = words.columns
            self.near, self.alike, self.linked = vectors.Near(word, v, len(cells), topk, blank_self), lexical.Alike(grams, len(cells)), neighbours.Linked(hits, len(cells))

        def add(self, members: pa.RecordBatch, holds: np.ndarray) -> None:
            word, v, grams, _ = members.columns
            self.near.add(word, v, holds)
            self.alike.add(grams, holds)
            self.linked.add(word, holds)

        def result(self, a: int, b: int) -> tuple[list[np.ndarray], np.ndarray]:
            csim = np.round(self.near.x[a:b] @ matrix.T, DIGITS)
            (graph, _), (full, _), (alike, _) = (x.result(a, b) for x in (self.linked, self.near, self.alike))
            return [*graph, csim, *full, *alike], np.broadcast_to(there, csim.shape)

    schema = StructType([*ref.select(*keys).schema.fields, StructField("word", StringType()), *[StructField(c, DoubleType()) for c in FEATURES]])
    out = units.meet(met, known, cells, schema, Met, len(cells) * (topk + 5), vectors.TARGETS)
    return out.select("split_id", "word", *[F.coalesce(F.round(c, DIGITS), F.lit(0.0)).alias(c) for c in FEATURES])


def feature_columns(feats: DataFrame) -> list[str]:
    """What the classifiers see of features."""
    return [c for c in feats.columns if c not in ("split_id", "word")]


def _marked(feats: DataFrame, all_splits: DataFrame, stop: DataFrame, neg_ratio_train: int | None, seed: int) -> tuple[DataFrame, DataFrame]:
    """feats' rows of the splits' own words with ref and test, and those of background words with random and reliable, the training negatives.

    The negatives are told by where each split's samples end (splits.lasts), so that no background row is moved or written.
    """
    # written, so that Spark knows how few they are before it moves any features for them
    key, terms = ["split_id"], written(all_splits.select("word").distinct())
    outside = written(terms.union(stop.select("word")).distinct())
    parts = all_splits.groupBy("split_id", "word").agg(*[F.max(F.col("part") == p).alias(p) for p in ("ref", "test")])
    # rows for splits and words are merged, see centroid_evaluate
    known = feats.join(terms, "word", "left_semi").join(parts.hint("merge"), ["split_id", "word"]).select(*feats.columns, "ref", "test")
    background = feats.join(outside, "word", "left_anti")
    if neg_ratio_train is None:
        return known, background.withColumns({"random": F.lit(True), "reliable": F.lit(True)})
    sizes = written(all_splits.filter("part = 'ref'").groupBy("split_id").agg((F.count("*") * neg_ratio_train).alias("most")))
    h, score = splits.hash_order(F.lit(seed), F.lit("train"), "split_id", "word"), F.coalesce(F.col("centroid").cast("double"), F.lit(float("-inf")))
    narrow = background.select("split_id", "word", score.alias("score"))
    hashed = narrow.withColumn("h", h)
    random = splits.lasts(hashed, key, sizes, "h", F.substring("h", 1, 3))
    ranged, bucket = splits.value_buckets(narrow, key, "score")
    reliable = splits.lasts(ranged, key, sizes, "score", bucket)
    for name, ends, value in (("random", random, h), ("reliable", reliable, score)):
        own = background.columns
        background = background.join(F.broadcast(written(ends)), key, "left").select(*own, splits.among_first(value, F.col("word")).alias(name))
    return known, background


def _training(known: DataFrame, background: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns with label and clf of _marked rows that pu_lr and pu_rn learn from."""
    both = F.explode(F.array(F.lit("pu_lr"), F.lit("pu_rn")))
    used = F.explode(F.array_compact(F.array(F.when(F.col("random"), "pu_lr"), F.when(F.col("reliable"), "pu_rn"))))
    positive = known.filter("ref").select(*columns, F.lit(1).alias("label"), both.alias("clf"))
    return positive.unionByName(background.filter("random or reliable").select(*columns, F.lit(0).alias("label"), used.alias("clf")))


def training_rows(feats: DataFrame, all_splits: DataFrame, stop: DataFrame, neg_ratio_train: int | None = 10, seed: int = 42) -> DataFrame:
    """feats with clf and label: what pu_lr and pu_rn learn from.

    Positives are the reference terms; negatives of pu_lr a hashed sample of background words, those of pu_rn
    the background words of lowest centroid similarity, neg_ratio_train of either for each term (None: all).
    feats are read several times.
    """
    return _training(*_marked(feats, all_splits, stop, neg_ratio_train, seed), feats.columns)


def learned_classifiers(feats: DataFrame, all_splits: DataFrame, stop: DataFrame, neg_ratio_train: int | None = 10, seed: int = 42, class_weight: bool = True) -> DataFrame:
    """(split_id, clf, weights, intercept, means, deviations): the classifiers of compare_methods, without its evaluation."""
    return models.fit_per_key(training_rows(feats, all_splits, stop, neg_ratio_train, seed), ["split_id", "clf"], feature_columns(feats), balanced=class_weight)


def compare_methods(feats: DataFrame, all_splits: DataFrame, stop: DataFrame, ks: Sequence[int] = KS, neg_ratio_train: int | None = 10, seed: int = 42, eval_full_pool: bool = False, class_weight: bool = True, use_lexical: bool = True, use_full: bool = True, classifiers: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(split_id, method, k, roc_auc, average_precision, precision, recall, specificity, f1), and the classifiers.

    pu_lr and pu_rn learn from training_rows, whose negatives are left out of the evaluation unless
    eval_full_pool; if that leaves no negatives there are no rows. class_weight: both classes weigh alike in
    training. use_lexical, use_full: with the lexical column, with those over all glossary words.
    classifiers: (split_id, clf, weights, intercept, means, deviations), given ones instead of trained ones.
    Ties at k go by a hashed order. For the control without signal see splits.randomised.
    """
    key, full = ["split_id"], ("mindist_all", "avgdist_all", "votetopk_all")
    feats = feats.drop(*([] if use_lexical else ["lexical"]), *([] if use_full else full))
    columns = feature_columns(feats)
    mixed = ["vote", "centroid", *(["lexical"] if use_lexical else [])]
    known, background = _marked(feats, all_splits, stop, neg_ratio_train, seed)
    fitted = written(models.fit_per_key(_training(known, background, feats.columns), ["split_id", "clf"], columns, balanced=class_weight) if classifiers is None else classifiers)  # a row for each split and classifier
    if not eval_full_pool:
        background = background.filter("not (random or reliable)")
    pool = known.filter("test").select(*feats.columns, F.lit(1).alias("label")).unionByName(background.select(*feats.columns, F.lit(0).alias("label")))
    scored = models.z_scores(pool, key, mixed, over=feats)
    scored = scored.withColumn("hybrid", F.round(sum((F.col(f"z_{c}") for c in mixed[1:]), F.col(f"z_{mixed[0]}")), DIGITS))
    for clf in ("pu_lr", "pu_rn"):
        scored = models.predict(scored, fitted.filter(F.col("clf") == clf).drop("clf"), key, columns, clf)
    tie = F.unhex(splits.hash_order(F.lit(seed), F.lit("ties"), "split_id", "word"))
    parts = max(1, -(-2 * feats.sparkSession.sparkContext.defaultParallelism // max(1, fitted.select("split_id").distinct().count())))
    return curves.wide_metrics(scored, key, [m for m in METHODS if m in scored.columns], ks, tie, parts), fitted


def score_words(vecs: DataFrame, counts: DataFrame, glossary: DataFrame, topk: int = 10) -> DataFrame:
    """(word, mindist_all, avgdist_all, votetopk_all, centroid, log_count): scores against one glossary, self-similarity blanked."""
    members = glossary.select(F.lit(0).alias("split_id"), "word").distinct()
    full = vectors.member_features(vecs, members, ["split_id"], topk, True)
    centre = vectors.centroid_similarity(vecs, vectors.centroids(vecs, members, ["split_id"]), ["split_id"])
    out = centre.join(full, ["split_id", "word"]).join(counts.select("word", "cnt"), "word", "left")
    return out.select("word", "mindist_all", "avgdist_all", "votetopk_all", F.col("csim").alias("centroid"), F.log1p(F.coalesce(F.col("cnt"), F.lit(0)).cast("double")).alias("log_count"))


def trained_scores(scores: DataFrame, glossary: DataFrame, columns: Sequence[str] = ("avgdist_all", "centroid", "log_count", "mindist_all", "votetopk_all"), reliable: int = 10) -> tuple[DataFrame, DataFrame]:
    """score_words with pu_lr and pu_rn, and the classifiers (clf, weights, intercept, means, deviations).

    pu_lr learns glossary words against all others, pu_rn against the `reliable` times as many others of
    lowest centroid similarity; features that are no finite numbers count as 0, and are standardised over
    all words. All tasks fit together, as the training set is the vocabulary.
    """
    known = glossary.select("word").distinct().withColumn("label", F.lit(1))
    clean = [F.when(scalar.is_finite(F.col(c)), F.col(c)).otherwise(0.0).alias(c) for c in columns]
    scores = written(scores)
    rows = scores.join(known, "word", "left").select("word", F.coalesce("label", F.lit(0)).alias("label"), *clean)
    stats = rows.agg(*[f(c) for c in columns for f in (F.avg, F.stddev_pop)]).first()
    scale = {c: (m or 0.0, d or 1.0) for c, m, d in zip(columns, stats[::2], stats[1::2], strict=True)}
    scaled = rows.select("word", "label", "centroid", *[((F.col(c) - m) / d).alias(f"s_{c}") for c, (m, d) in scale.items()])
    features = [f"s_{c}" for c in columns]
    m = max(1, rows.agg(F.sum("label")).first()[0] or 0) * reliable
    lowest = scaled.filter("label = 0").orderBy("centroid", "word").limit(m)
    out, fitted = rows.select("word"), None
    for clf, training in (("pu_lr", scaled), ("pu_rn", scaled.filter("label = 1").unionByName(lowest))):
        model = models.fit_large(training, features, standardise=False)
        out = out.join(models.predict(scaled, model, [], features, clf).select("word", clf), "word")
        model = model.select(F.lit(clf).alias("clf"), "*")
        fitted = model if fitted is None else fitted.unionByName(model)
    return scores.join(out, "word"), fitted


def evaluate_scores(long: DataFrame, positives: DataFrame, ks: Sequence[int] = KS, ranges: int = 64) -> DataFrame:
    """(method, k, roc_auc, average_precision, precision, recall, specificity, f1) of scores (word, method, score); precision divides by k.

    A method's curve goes over the whole vocabulary and is shared by tasks in ranges of its scores.
    """
    known = positives.select("word").distinct().withColumn("label", F.lit(1))
    rows = long.join(known, "word", "left").withColumn("label", F.coalesce("label", F.lit(0)))
    points = curves.curve_summary(curves.score_groups(rows, ["method"]), ["method"], ranges).select("method", "roc_auc", "average_precision")
    return points.join(curves.rank_metrics(rows, ["method"], ks, divide_by_k=True).select("method", "k", "precision", "recall", "specificity", "f1"), "method")


def diagnose(votes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Best n per weight type over all words by ROC AUC (T8), and the health flags of the middle n (T9)."""
    keys = ["weight_type", "n"]
    points = curves.curve_summary(curves.score_groups(votes, keys), keys)
    best = curves.best_by(points.select(*keys, "roc_auc"), ["weight_type"], "roc_auc", [F.col("n")])
    ns = votes.agg(F.array_sort(F.collect_set("n")).alias("ns")).select(F.element_at("ns", (F.size("ns") / 2).cast("int") + 1).alias("n"))
    return best, summary.health_flags(votes.join(ns, "n"))


def side_by_side(metrics: DataFrame, value: str = "roc_auc", models_: Sequence[str] | None = None) -> DataFrame:
    """Methods by models: one column per model with the mean of a metric over splits."""
    means = metrics.groupBy("method", "model").agg(F.avg(value).alias("m"))
    pivot = means.groupBy("method").pivot("model", list(models_)) if models_ else means.groupBy("method").pivot("model")
    return pivot.agg(F.first("m"))
