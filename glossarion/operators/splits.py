"""Reference, development and test splits of a word list, their checks, and hashed samples."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.scalar import hash_order, is_finite
from ..sources.files import written

PARTS = ("ref", "dev", "test")
#: Hex digits of a hash that tell its bucket.
_DIGITS = 3
#: Cells of a sample that are listed in each task.
CELLS = 100_000


def majority_class(df: DataFrame, word: str = "word", label: str = "label") -> DataFrame:
    """(word, label): 1 where more than half of a word's labels are 1; a tie gives 0."""
    y = F.col(label).cast("int")
    return df.groupBy(F.col(word).alias("word")).agg(F.when(F.sum(y) > F.count(y) / 2, 1).otherwise(0).alias("label"))


def _placed(rows: DataFrame, keys: Sequence[str], h: Column, cuts: Sequence[Column], word: str) -> DataFrame:
    """rows with n, the size of their key, _cut<i>, the cuts, and rn, their place among the key's rows in the order of h, as far as a cut can tell.

    cuts: places, from n and the columns that rows have one value of in each key. Rows are counted by ranges of their
    hashes (buckets), and only buckets that a cut parts are sorted; others' rows get the place after the last
    cut before them. A key's cuts are one row, and these are broadcast: Spark takes exploded rows to be as few
    as the words that they come from and would broadcast the rows. Rows of a null key are left out.
    """
    fixed = [c for c in rows.columns if c.startswith("_of_key_")]
    rows = rows.withColumn("h", h).withColumn("bucket", F.substring("h", 1, _DIGITS))
    counts = rows.groupBy(*keys, "bucket").agg(F.count("*").alias("c"), *[F.max(c).alias(c) for c in fixed])
    upto = F.sum("c").over(Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    sums = counts.withColumns({"upto": upto, "n": F.sum("c").over(Window.partitionBy(*keys)), **{c: F.max(c).over(Window.partitionBy(*keys)) for c in fixed}})
    sums = sums.withColumns({f"_cut{i}": c.cast("bigint") for i, c in enumerate(cuts)})
    reached = [F.min(F.when(F.col("upto") >= F.col(f"_cut{i}"), F.struct("upto", "bucket", "c"))).alias(f"_at{i}") for i in range(len(cuts))]
    sums = sums.groupBy(*keys).agg(*[F.max(c).alias(c) for c in ("n", *[f"_cut{i}" for i in range(len(cuts))])], *reached)
    # where each cut falls: in which bucket, what lies in lower ones, and whether it parts the bucket
    few, before, lower = [*keys, "n"], [], [F.lit(1).cast("bigint")]
    for i in range(len(cuts)):
        cut, at, bucket = F.col(f"_cut{i}"), F.col(f"_at{i}"), F.col(f"_bucket{i}")
        few += [cut, F.when(cut <= 0, "").when(cut > F.col("n"), "~").otherwise(at["bucket"]).alias(f"_bucket{i}"), F.when((cut > 0) & (cut < at["upto"]), at["upto"] - at["c"]).alias(f"_before{i}")]
        before.append(F.when(bucket == F.col("bucket"), F.col(f"_before{i}")))
        lower.append(F.when(bucket < F.col("bucket"), cut + 1))
    rows = rows.drop(*fixed).join(F.broadcast(sums.select(*few)), list(keys)).withColumn("before", F.coalesce(*before))
    place = F.row_number().over(Window.partitionBy(*keys, "bucket").orderBy("h", word)) + F.col("before")
    rest = rows.filter("before is null").withColumn("rn", F.greatest(*lower))
    return rest.unionByName(rows.filter("before is not null").withColumn("rn", place))


def make_splits(words: DataFrame, n_splits: int = 100, seed: int = 42, stop: DataFrame | None = None, strata: Sequence[str] = (), neg_ratio: float | None = None) -> DataFrame:
    """(split_id, part, word, strata): independent seeded shuffles, cut 80/10/10 within each stratum.

    words are taken once each, without those of stop. neg_ratio (with the stratum `label`): each split
    keeps at most that many words of label 0 per word of label 1, the first of its shuffle. Words are counted
    by ranges of their hashes, and only the ranges in which a part ends are sorted.
    """
    words = words.select("word", *strata).dropDuplicates(["word"])
    if stop is not None:
        words = words.join(stop.select("word").distinct(), "word", "left_anti")
    n = F.col("n")
    if neg_ratio is not None:  # one row; the same in all splits
        positives = words.agg(F.count_if(F.col("label") == 1)).scalar()
        words = words.withColumn("_of_key_most", F.when(F.col("label") != 1, F.floor(positives * neg_ratio)))
        n = F.least(n, F.coalesce("_of_key_most", n))
    # each word becomes n_splits rows: few words are shared by all tasks before that
    words = words.repartition(2 * words.sparkSession.sparkContext.defaultParallelism, "word")
    rows = words.withColumn("split_id", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    ref = F.floor(n * 0.8)
    dev = ref + F.floor(n * 0.1)
    rows = _placed(rows, ["split_id", *strata], hash_order(seed, "split_id", "word"), (ref, dev, n), "word")
    part = F.when(F.col("rn") <= F.col("_cut0"), "ref").when(F.col("rn") <= F.col("_cut1"), "dev").otherwise("test")
    return rows.filter("rn <= _cut2").select("split_id", part.alias("part"), "word", *strata)


def verify_splits(splits: DataFrame) -> DataFrame:
    """(split_id, repeated, shared): words repeated within a part, and words that stand in two or more parts."""
    per_part = splits.groupBy("split_id", "word", "part").count()
    per_word = per_part.groupBy("split_id", "word").agg(F.sum(F.col("count") - 1).alias("again"), F.count("*").alias("parts"))
    return per_word.groupBy("split_id").agg(F.sum("again").alias("repeated"), F.count_if(F.col("parts") > 1).alias("shared"))


def part_sizes(splits: DataFrame) -> DataFrame:
    """(part, least, most, mean) of the parts' sizes over splits."""
    sizes = splits.groupBy("split_id", "part").count()
    return sizes.groupBy("part").agg(F.min("count").alias("least"), F.max("count").alias("most"), F.avg("count").alias("mean"))


def hashed_sample(df: DataFrame, keys: Sequence[str], size: Column, salt: str, seed: int = 42, word: str = "word") -> DataFrame:
    """The first `size` rows of each key in a seeded hash order: a sample without replacement.

    size: a number for each key. Rows are counted by ranges of their hashes; only the range in which the
    sample ends is sorted.
    """
    rows = df.select(F.struct("*").alias("_row"), *keys, word, size.alias("_of_key_size"))
    rows = _placed(rows, keys, hash_order(F.lit(seed), F.lit(salt), *keys, word), [F.col("_of_key_size")], word)
    return rows.filter("rn <= _cut0").select("_row.*")


def value_buckets(df: DataFrame, keys: Sequence[str], value: str, buckets: int = 4096) -> tuple[DataFrame, Column]:
    """df with _least and _most, its key's finite extremes, and a bucket of the value that never falls while the value rises."""
    v = F.col(value)
    ends = df.groupBy(*keys).agg(*[f(F.when(is_finite(v), v)).alias(n) for n, f in (("_least", F.min), ("_most", F.max))])
    within = F.floor((v - F.col("_least")) / (F.col("_most") - F.col("_least")) * buckets)
    bucket = F.when(v <= F.col("_least"), 0).when(v >= F.col("_most"), buckets).otherwise(F.coalesce(within, F.lit(0)))
    return df.join(F.broadcast(ends), list(keys)), bucket.cast("int")


def lasts(df: DataFrame, keys: Sequence[str], sizes: DataFrame, value: str, bucket: Column, word: str = "word") -> DataFrame:
    """(keys, whole, last, last_word): the last row of each key's first `most` by value, then word, in rising order; whole: the key has no more rows.

    sizes: (keys, most), a row a key. Rows are counted by buckets, which must not fall while the value rises, and only the
    bucket in which the last row lies is sorted; so a sample is told by a comparison (among_first) and no row is moved for it.
    """
    keys = list(keys)
    rows = df.withColumn("_bucket", bucket)
    upto = F.sum("c").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0))
    counts = rows.groupBy(*keys, "_bucket").agg(F.count("*").alias("c")).withColumn("upto", upto).join(sizes, keys)
    at = F.min(F.when(F.col("upto") >= F.col("most"), F.struct("upto", "_bucket", "c")))
    cells = written(counts.groupBy(*keys).agg(F.max("most").alias("most"), F.max("upto").alias("n"), at.alias("at")))  # a row a key
    within = cells.filter("most > 0 and most < n").select(*keys, F.col("at._bucket").alias("_bucket"), (F.col("most") - F.col("at.upto") + F.col("at.c")).alias("_place"))
    ranked = rows.join(F.broadcast(within), [*keys, "_bucket"]).withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(value, word)))
    found = ranked.filter("_rn = _place").select(*keys, F.col(value).alias("last"), F.col(word).alias("last_word"))
    return cells.select(*keys, (F.col("most") >= F.col("n")).alias("whole")).join(found, keys, "left")


def among_first(value: Column, word: Column) -> Column:
    """Whether a row, joined with its key's row of lasts, is among the first."""
    return F.coalesce(F.col("whole") | (value < F.col("last")) | ((value == F.col("last")) & (word <= F.col("last_word"))), F.lit(False))


def sample_each(words: DataFrame, cells: DataFrame, salt: Sequence[str], seed: int = 42) -> DataFrame:
    """(cell's columns but `most`, word): of each cell a sample of `most` of the words (word), in a seeded hash order.

    words are distinct. cells: few rows (split, part, ...), each with its `most`; more than CELLS are an
    error. salt names the columns that go into the hash before the word. Words are never listed for each
    cell: a word yields rows only for cells in which its hash is below a threshold that leaves, all but
    surely, somewhat more than `most`; these are sorted. Where it leaves fewer it is doubled.
    """
    spark, names = words.sparkSession, [c for c in cells.columns if c != "most"]
    todo = [(tuple(r), 1.0 * r["most"] + 6 * math.sqrt(r["most"]) + 20) for r in cells.select(*names, "most").limit(CELLS + 1).collect()]
    if len(todo) > CELLS:
        raise ValueError(f"more than {CELLS} cells to sample for")
    kinds = cells.select(*names, "most").schema
    n, out = words.count(), spark.createDataFrame([], StructType([*kinds.fields[:-1], words.schema["word"]]))
    while todo:
        # hashes are compared by their first 15 digits
        tops = spark.createDataFrame([(*c, f"{min(16**15 - 1, int(16**15 * want / max(1, n))):015x}~") for c, want in todo], StructType([*kinds.fields, StructField("top", StringType())]))
        listed = tops.agg(F.collect_list(F.struct("*"))).scalar()
        hashed = F.transform("_cells", lambda x: F.struct(x.alias("x"), F.md5(F.concat_ws("/", F.lit(str(seed)), *[x[k].cast("string") for k in salt], F.col("word"))).alias("h")))
        near = words.select("word", listed.alias("_cells")).select("word", F.explode(F.filter(hashed, lambda y: y["h"] < y["x"]["top"])).alias("y"))
        found = written(near.select(*[F.col(f"y.x.{k}").alias(k) for k in [*names, "most"]], "word", F.col("y.h").alias("h")))
        held = {tuple(r[k] for k in names): r["c"] for r in found.groupBy(*names).agg(F.count("*").alias("c")).collect()}
        short = [(c, want) for c, want in todo if held.get(c[:-1], 0) < min(c[-1], n)]
        rank = F.row_number().over(Window.partitionBy(*names).orderBy("h", "word"))
        ready = found.withColumn("rn", rank).filter("rn <= most").select(*names, "word")
        if short:
            again = spark.createDataFrame([c for c, _ in short], kinds).select(*names)
            ready = ready.join(again, names, "left_anti")
        out = out.unionByName(ready)
        todo = [(c, want * 2) for c, want in short]
    return out


def randomised(splits: DataFrame, pool: DataFrame, seed: int = 42) -> DataFrame:
    """splits with every word replaced by one of the pool, one mapping for all splits: a control without signal.

    The splits' own words are no part of the pool, so that no false positive is a true one. A pool of
    fewer words than there are to replace is an error.
    """
    terms = splits.select("word").distinct()
    others = pool.select("word").distinct().join(terms, "word", "left_anti")
    need, have = terms.count(), others.count()
    if have < need:
        raise ValueError(f"{need} words to replace, but only {have} others in the pool")

    def ranked(words: DataFrame, salt: str, name: str) -> DataFrame:
        # numbered in ranges of the hash, so that no single task sorts all words
        keyed = words.select(F.col("word").alias(name)).withColumn("h", hash_order(seed, F.lit(salt), name)).withColumn("b", F.substring("h", 1, 2))
        sizes = keyed.groupBy("b").count()  # 256 rows at most
        before = sizes.select("b", F.coalesce(F.sum("count").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
        rn = F.row_number().over(Window.partitionBy("b").orderBy("h", name))
        return keyed.join(before, "b").select(name, (rn + F.col("offset")).alias("rn"))

    mapping = ranked(terms, "terms", "word").join(ranked(others, "pool", "new_word"), "rn").drop("rn")
    return splits.join(mapping, "word").select("split_id", "part", F.col("new_word").alias("word"))


def matched_list(master: DataFrame, stop: DataFrame, classes: DataFrame) -> DataFrame:
    """(word, label) of the words of a master list that are not in the stop list; label by majority among classes
    (word, label), null where a word has none."""
    words = master.select("word").distinct().join(stop.select("word").distinct(), "word", "left_anti")
    return words.join(majority_class(classes), "word", "left")


def list_counts(matched: DataFrame) -> DataFrame:
    """(words, matched, unmatched, positive): sizes of a matched_list."""
    return matched.agg(F.count("*").alias("words"), F.count("label").alias("matched"), F.count_if(F.col("label").isNull()).alias("unmatched"), F.count_if(F.col("label") == 1).alias("positive"))


def splits_of_list(matched: DataFrame, n_splits: int = 100, seed: int = 42, neg_ratio: float | None = None) -> DataFrame:
    """(split_id, part, word, label): stratified splits of the words of a matched_list that have a label."""
    return make_splits(matched.filter("label is not null"), n_splits, seed, strata=["label"], neg_ratio=neg_ratio)
