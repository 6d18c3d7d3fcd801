"""Summaries over splits: statistics, intervals, histograms, counts and data-health flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import hash_order


def summarise(long: DataFrame, keys: Sequence[str], value: str = "value", ddof: int = 1) -> DataFrame:
    """(keys, n, mean, std, median, least, most) of the values that are neither null nor NaN."""
    rows = long.filter(F.col(value).isNotNull() & ~F.isnan(value))
    std = F.stddev_samp(value) if ddof else F.stddev_pop(value)
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), std.alias("std"), F.percentile(value, 0.5).alias("median"), F.min(value).alias("least"), F.max(value).alias("most"))


def normal_ci(summary: DataFrame, z: float = 1.96) -> DataFrame:
    """A summary with ddof 0, with the normal interval ci_low, ci_high of its mean."""
    half = F.lit(z) * F.col("std") / F.sqrt(F.col("n").cast("double"))
    return summary.withColumns({"ci_low": F.col("mean") - half, "ci_high": F.col("mean") + half})


def bootstrap_ci(long: DataFrame, keys: Sequence[str], value: str = "value", resamples: int = 10_000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """(keys, ci_low, ci_high): percentile interval of the mean over seeded resamples.

    Values are one per split and key: short lists, numbered by their order, of few keys, that reach the tasks as
    one value. A resample is a row with its hashed numbers, which all keys share; a row per key and resample
    is all that moves.
    """
    spark = long.sparkSession
    rows = long.filter(F.col(value).isNotNull() & ~F.isnan(value))
    lists = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.col(value).cast("double"))).alias("xs"))
    longest = F.sequence(F.lit(0), lists.agg(F.coalesce(F.max(F.size("xs")), F.lit(1)) - 1).scalar())
    draws = spark.range(resamples).repartition(2 * spark.sparkContext.defaultParallelism, "id").withColumns({"_d": longest, "_lists": lists.agg(F.collect_list(F.struct("*"))).scalar()})
    draws = draws.select("id", "_lists", F.transform("_d", lambda d: F.conv(F.substring(hash_order(seed, "id", d), 1, 15), 16, 10).cast("bigint")).alias("h"))
    each = draws.select("id", "h", F.explode("_lists").alias("k")).select("id", "h", *[F.col(f"k.{k}").alias(k) for k in keys], "k.xs")
    n = F.size("xs")
    total = F.aggregate(F.transform(F.slice("h", 1, n), lambda x: F.get("xs", F.pmod(x, n).cast("int"))), F.lit(0.0), lambda s, x: s + x)
    means = each.select(*keys, (total / n).alias("m"))
    low = (1 - confidence) / 2
    return means.groupBy(*keys).agg(F.percentile("m", low).alias("ci_low"), F.percentile("m", 1 - low).alias("ci_high"))


def histogram(long: DataFrame, keys: Sequence[str], value: str = "value", bins: int = 20) -> DataFrame:
    """(keys, bin, low, high, n, mean): equal-width bins over [least, most], the last closed; a single value fills bin 0."""
    rows = long.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, F.col(value).alias("x"))
    ends = rows.groupBy(*keys).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.avg("x").alias("mean"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))).otherwise(0)
    counts = rows.join(ends, list(keys)).withColumn("bin", at.cast("int")).groupBy(*keys, "lo", "hi", "mean", "bin").agg(F.count("*").alias("n"))
    return counts.select(*keys, "bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), "n", "mean")


def class_rates(df: DataFrame, label: str = "label") -> DataFrame:
    """(n, positives, positive_rate, minority_rate) of a 0/1 label."""
    y = F.col(label).cast("int")
    out = df.agg(F.count(y).alias("n"), F.sum(y).alias("positives"))
    rate = F.try_divide(F.col("positives").cast("double"), F.col("n"))
    return out.select("n", "positives", rate.alias("positive_rate"), F.least(rate, 1 - rate).alias("minority_rate"))


def separation(df: DataFrame, keys: Sequence[str], score: str = "score", label: str = "label") -> DataFrame:
    """(keys, mean_pos, std_pos, mean_neg, std_neg, separation): scores by class, and the means' difference."""
    s, pos = F.col(score), F.col(label) == 1
    out = df.groupBy(*keys).agg(F.avg(F.when(pos, s)).alias("mean_pos"), F.stddev_pop(F.when(pos, s)).alias("std_pos"), F.avg(F.when(~pos, s)).alias("mean_neg"), F.stddev_pop(F.when(~pos, s)).alias("std_neg"))
    return out.withColumn("separation", F.col("mean_pos") - F.col("mean_neg"))


def health_flags(df: DataFrame, score: str = "score", label: str = "label", minority: float = 0.05) -> DataFrame:
    """(n, n_nan, n_inf, labels, flags): what is wrong with a table of scores and labels, as an array of names."""
    s = F.col(score).cast("double")
    out = df.agg(F.count("*").alias("n"), F.count_if(F.isnan(s)).alias("n_nan"), F.count_if(F.abs(s) == float("inf")).alias("n_inf"), F.array_sort(F.collect_set(label)).alias("labels"), F.avg(F.col(label).cast("double")).alias("rate"))
    odd = F.exists("labels", lambda x: ~x.isin(0, 1))
    rare = F.least(F.col("rate"), 1 - F.col("rate")) < minority
    flags = F.array_compact(F.array(F.when(odd, "labels"), F.when(F.col("n_nan") > 0, "nan"), F.when(F.col("n_inf") > 0, "inf"), F.when(rare, "imbalanced")))
    return out.select("n", "n_nan", "n_inf", "labels", flags.alias("flags"))


def split_info(pool: DataFrame, splits: DataFrame) -> DataFrame:
    """(split_id, part, size, matched, positive, negative): each part's words, those found in pool (word, label), by label."""
    joined = splits.select("split_id", "part", "word").join(pool.select("word", "label"), "word", "left")
    return joined.groupBy("split_id", "part").agg(F.count("*").alias("size"), F.count("label").alias("matched"), F.count_if(F.col("label") == 1).alias("positive"), F.count_if(F.col("label") == 0).alias("negative"))


def global_counts(vocabulary: DataFrame, queries: DataFrame, vectors: DataFrame, glossary: DataFrame) -> DataFrame:
    """One row: sizes of the word lists and of their overlaps with the glossary, and the share of it that is usable."""
    flagged = None
    for name, df in (("voc", vocabulary), ("query", queries), ("vec", vectors), ("gl", glossary)):
        part = df.select("word").distinct().withColumn("name", F.lit(name))
        flagged = part if flagged is None else flagged.unionByName(part)
    words = flagged.groupBy("word").agg(*[F.bool_or(F.col("name") == n).alias(n) for n in ("voc", "query", "vec", "gl")])
    out = words.agg(F.count_if("voc").alias("vocabulary"), F.count_if("query").alias("queries"), F.count_if(F.col("query") & F.col("vec")).alias("queries_with_vector"), F.count_if("gl").alias("glossary"), F.count_if(F.col("gl") & F.col("query")).alias("glossary_in_queries"), F.count_if(F.col("gl") & F.col("query") & F.col("vec")).alias("glossary_usable"))
    return out.withColumn("usable_share", F.try_divide(F.col("glossary_usable").cast("double"), F.col("glossary")))


def chance_levels(counts: DataFrame, ks: Sequence[int], keys: Sequence[str]) -> DataFrame:
    """(keys, k, prevalence, chance): share of positives pos / (pos + neg), and the positives that k random words would hold."""
    p = F.try_divide(F.col("pos").cast("double"), F.col("pos") + F.col("neg"))
    return counts.select(*keys, F.explode(F.array(*map(F.lit, ks))).alias("k"), p.alias("prevalence")).withColumn("chance", F.col("k") * F.col("prevalence"))


def enrichment(chance: DataFrame, observed: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, k, chance, observed, enrichment): mean chance over splits, hits among the first k, and how many times chance they are.

    chance: (keys, k, chance) of chance_levels; observed: (keys, k, precision). Without chance the ratio is null.
    """
    mean = chance.groupBy(*keys, "k").agg(F.avg("chance").alias("chance"))
    hits = observed.groupBy(*keys, "k").agg((F.avg("precision") * F.col("k")).alias("observed"))
    return mean.join(hits, [*keys, "k"]).withColumn("enrichment", F.try_divide("observed", "chance"))


def metric_table(long: DataFrame, metrics: Sequence[str], method: str = "method") -> DataFrame:
    """(method, <metric>_mean, <metric>_std, ...): each method's mean and population deviation over splits, from (method, metric, value)."""
    is_ = {m: F.when(F.col("metric") == m, F.col("value")) for m in metrics}
    return long.groupBy(method).agg(*[f(c).alias(f"{m}_{n}") for m, c in is_.items() for n, f in (("mean", F.avg), ("std", F.stddev_pop))])
