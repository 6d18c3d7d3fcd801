"""Run configurations from nested JSON documents, and the names of models by their sites."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import shared_folder

#: The files of a run that hold settings, in the order in which they are read.
PATTERNS = ("config_fed_*.json", "*config*.json", "train_config.json", "meta.json")

#: Levels of documents that are read one after the other.
LEVELS = 8
#: The settings, and the names under which each may stand in a document.
ALIASES: Mapping[str, Sequence[str]] = {
    "num_rounds": ("num_rounds", "n_rounds", "rounds"),
    "min_clients": ("min_clients", "min_num_clients"),
    "aggregation_epochs": ("aggregation_epochs", "aggr_epochs"),
    "weigh_by_local_iter": ("weigh_by_local_iter",),
    "negate_key_metric": ("negate_key_metric",),
    "lr": ("lr", "learning_rate"),
    "batch_size": ("batch_size", "train_batch_size", "per_device_train_batch_size", "bs"),
    "weight_decay": ("weight_decay",),
    "mlm_probability": ("mlm_probability", "mlm_prob"),
    "num_train": ("num_train", "num_train_samples", "max_train_samples", "train_size", "n_train"),
    "num_eval": ("num_eval", "num_eval_samples", "max_eval_samples", "eval_size", "n_eval", "num_val"),
    "r": ("r", "lora_r"),
    "lora_alpha": ("lora_alpha", "alpha"),
    "lora_dropout": ("lora_dropout", "dropout"),
    "bias": ("bias",),
    "task_type": ("task_type",),
}


def _entries(level: DataFrame) -> DataFrame:
    """(run, path, place, key, value, nested) of the members of each text's object or the items of its array, in order."""
    named, items = F.from_json("text", "map<string,variant>"), F.from_json("text", "array<variant>")
    # each reading of the text is named once: Spark would read it anew for every mention within a branch
    raw_named, raw_items = F.map_values(F.from_json("text", "map<string,string>")), F.from_json("text", "array<string>")
    of_object = F.zip_with(F.map_entries(named), raw_named, lambda e, raw: F.struct(e["key"].alias("k"), e["value"].alias("v"), raw.alias("raw")))
    of_array = F.zip_with(items, raw_items, lambda v, raw: F.struct(F.lit(None).cast("string").alias("k"), v.alias("v"), raw.alias("raw")))
    array = F.btrim("text", F.lit(" \t\r\n")).startswith("[")
    rows = level.select("run", "path", "place", F.posexplode(F.when(array, of_array).otherwise(of_object)).alias("i", "e"))
    kind = F.schema_of_variant("e.v")
    nested = F.coalesce(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.lit(False))
    return rows.select("run", "path", F.concat("place", F.array("i")).alias("place"), F.col("e.k").alias("key"), F.coalesce("e.raw", F.lit("null")).alias("value"), nested.alias("nested"))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (run, path, place, text) to the scalars with a key on all their levels, which Spark's reader has bounded."""
    for batch in batches:
        out = []
        for run, path, place, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rest = [(place, None, json.loads(text, parse_float=str, parse_int=str))]
            while rest:
                at, key, x = rest.pop()
                if isinstance(x, (dict, list)):
                    rest += [([*at, i], k, y) for i, (k, y) in enumerate(x.items() if isinstance(x, dict) else ((None, y) for y in x))]
                elif key is not None:
                    out.append((run, path, at, key, x if isinstance(x, str) else json.dumps(x)))
        kinds = (pa.string(), pa.string(), pa.list_(pa.int32()), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["run", "path", "place", "key", "value"])


def leaves(docs: DataFrame) -> DataFrame:
    """(run, path, place array<int>, key, value string): the scalars with a key of docs (run, path, text), on all levels.

    place tells where a value stands, level by level, so that its order is the document's; items of an array
    have no key and are looked into. Strings stand as they are, other values as Spark writes them in JSON.
    Each of the first LEVELS levels of all documents is one step, whose nested values are written to the
    shared folder for the next; what is nested deeper is walked by a task for itself. Texts that are no JSON,
    null ones, and those nested deeper than Spark's reader allows (1,000 levels) are left out: see
    unreadable. A name that stands twice in an object counts twice, below LEVELS once.
    """
    spark = docs.sparkSession
    level, found = docs.select("run", "path", F.array().cast("array<int>").alias("place"), "text"), None
    for _ in range(LEVELS):
        folder = shared_folder(spark)
        _entries(level).write.parquet(folder)
        rows = spark.read.parquet(folder)
        scalars = rows.filter("not nested and key is not null").select("run", "path", "place", "key", "value")
        found = scalars if found is None else found.unionByName(scalars)
        level = rows.filter("nested").select("run", "path", "place", F.col("value").alias("text"))
        if level.isEmpty():
            return found
    return found.unionByName(level.mapInArrow(_walk, "run string, path string, place array<int>, key string, value string"))


def unreadable(docs: DataFrame) -> DataFrame:
    """(run, path) of the documents that leaves leaves out, unless they are null: no JSON object or array, or nested too deeply."""
    read = F.coalesce(F.from_json("text", "map<string,variant>").isNotNull(), F.lit(False)) | F.coalesce(F.from_json("text", "array<variant>").isNotNull(), F.lit(False))
    return docs.filter(F.col("text").isNotNull() & ~read).select("run", "path")


def pattern_rank(path: str = "path", patterns: Sequence[str] = PATTERNS) -> Column:
    """The place of the first pattern that a file's name fits; null if none does."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.coalesce(*[F.when(name.rlike("^" + ".*".join(map(re.escape, p.split("*"))) + "$"), F.lit(i)) for i, p in enumerate(patterns)])


def run_configs(docs: DataFrame, aliases: Mapping[str, Sequence[str]] = ALIASES, patterns: Sequence[str] | None = None) -> DataFrame:
    """(run, key, value): the first scalar of each canonical key, by path, then in the document's order.

    patterns: files are read in the order of the first pattern that their names fit, then by path; others aren't read.
    """
    canonical = F.create_map(*[F.lit(x) for key, names in aliases.items() for name in names for x in (name, key)])
    if patterns is not None:
        docs = docs.withColumn("_rank", pattern_rank("path", patterns)).filter("_rank is not null")
        docs = docs.withColumn("path", F.concat(F.lpad(F.col("_rank").cast("string"), 4, "0"), F.lit("/"), "path"))
    found = leaves(docs).withColumn("key", canonical[F.col("key")]).filter("key is not null")
    return found.groupBy("run", "key").agg(F.min_by("value", F.struct("path", "place")).alias("value"))


def config_table(configs: DataFrame, sites: DataFrame, keys: Sequence[str] = tuple(ALIASES)) -> DataFrame:
    """(model_name, model_num, sites, <key>...): a row for each run of sites (model_sites), a column for each setting, empty where it has none.

    model_num numbers the runs by name from 1.
    """
    from pyspark.sql import Window

    wide = configs.groupBy("run").agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in keys])
    number = F.row_number().over(Window.orderBy("run"))  # a row for each run
    rows = sites.withColumn("model_num", number).join(wide, "run", "left")
    return rows.select(F.col("model").alias("model_name"), "model_num", "sites", *[F.coalesce(k, F.lit("")).alias(k) for k in keys])


def model_name(sites: DataFrame) -> DataFrame:
    """(run, model): a run's distinct sites, sorted and joined by plus signs."""
    return sites.groupBy("run").agg(F.array_join(F.array_sort(F.collect_set("site")), "+").alias("model"))


def model_sites(runs: DataFrame, folders: DataFrame, logged: DataFrame, letters: Mapping[str, str]) -> DataFrame:
    """(run, sites, model) of each run (run): its known sites, those of its folders (run, site) or else of its log.

    letters: the known sites, each with the letter that stands for it in the model's name, `Model ` and the
    letters in the order of the sites' names. A run without known sites has `?` and `model_<run>`.
    """
    letter = F.create_map(*[F.lit(x) for pair in letters.items() for x in pair])

    def of(df: DataFrame, name: str) -> DataFrame:
        known = df.filter(F.col("site").isin(*letters))
        return known.groupBy("run").agg(F.array_sort(F.collect_set("site")).alias(name))

    both = runs.select("run").distinct().join(of(folders, "a"), "run", "left").join(of(logged, "b"), "run", "left")
    sites = F.coalesce("a", "b")
    name = F.concat(F.lit("Model "), F.array_join(F.transform(sites, lambda s: letter[s]), ""))
    return both.select("run", F.coalesce(F.array_join(sites, ", "), F.lit("?")).alias("sites"), F.coalesce(name, F.concat(F.lit("model_"), "run")).alias("model"))
