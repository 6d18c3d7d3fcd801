"""Readers and writers of word lists, splits, scores, logs, configurations and votes."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Folders that are deleted at the end.
_OWN: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """A fresh path below spark.checkpoint.dir, which all machines share; below the warehouse where that is unset.

    The paths of an application lie in one folder, which is deleted when the driver ends.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    own = f"{(folder or spark.conf.get('spark.sql.warehouse.dir').rstrip('/') + '/_shared').rstrip('/')}/tables-{spark.sparkContext.applicationId}"
    if own not in _OWN:
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _OWN.add(own)
    return f"{own}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, where several steps read it."""
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def word_list(spark: SparkSession, path: str, mode: str = "line") -> DataFrame:
    """(word) of each non-blank line: the stripped line, its first token, or the stripped line in lower case."""
    text = F.trim("value")
    word = {"line": text, "token": F.split(text, r"\s+")[0], "lower": F.lower(text)}[mode]
    return spark.read.text(path).select(word.alias("word")).filter("word != ''")


def splits_json(spark: SparkSession, path: str) -> DataFrame:
    """(split_id, part, pos, word) of {"0": {"ref": [...], ...}, ...} or of a list of such objects.

    A file is one such document, however it is broken into lines, or holds one object a line, as
    write_splits_json writes them.
    """
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.split(F.trim("value"), r"(?<=\})\s*\n\s*(?=\{)")).alias("t"))
    parts = "struct<ref:array<string>,dev:array<string>,test:array<string>>"
    as_map = whole.filter("t like '{%'").select(F.explode(F.from_json("t", f"map<string,{parts}>")).alias("split_id", "p"))
    as_list = whole.filter("t like '[%'").select(F.posexplode(F.from_json("t", f"array<{parts}>")).alias("split_id", "p"))
    both = as_map.unionByName(as_list.withColumn("split_id", F.col("split_id").cast("string")))
    long = F.explode(F.array(*[F.struct(F.lit(x).alias("part"), F.col(f"p.{x}").alias("words")) for x in ("ref", "dev", "test")]))
    return both.select(F.col("split_id").cast("int").alias("split_id"), long.alias("x")).select("split_id", "x.part", F.posexplode("x.words").alias("pos", "word"))


def write_splits_json(splits: DataFrame, path: str) -> None:
    """Splits as JSON objects of one split each, a line of text each; words are in the order of their names."""
    words = splits.groupBy("split_id", "part").agg(F.array_sort(F.collect_list("word")).alias("words"))
    one = words.groupBy("split_id").agg(F.map_from_entries(F.collect_list(F.struct("part", "words"))).alias("m"))
    one.select(F.to_json(F.create_map(F.col("split_id").cast("string"), "m")).alias("value")).write.text(path)


def scores_csv(spark: SparkSession, path: str) -> DataFrame:
    """(word, method, score) of a CSV with a column per method."""
    df = spark.read.csv(path, header=True)
    methods = [c for c in df.columns if c != "word"]
    return df.select("word", *[F.col(c).cast("double").alias(c) for c in methods]).unpivot("word", methods, "method", "score")


def checkpoint_csv(spark: SparkSession, path: str) -> DataFrame:
    """([run,] round, dev_ppl, test_ppl); rows that name no round or hold no numbers are left out. Folders run=<name> give the run."""
    df = spark.read.csv(path, header=True)
    at = F.regexp_extract("model_checkpoint", r"^FL_global_model_([0-9]+)\.pt$", 1).try_cast("int")
    rows = df.select(*(["run"] if "run" in df.columns else []), at.alias("round"), F.col("dev_perplexity").try_cast("double").alias("dev_ppl"), F.col("test_perplexity").try_cast("double").alias("test_ppl"))
    return rows.dropna()


def log_metrics_csv(spark: SparkSession, path: str) -> DataFrame:
    """(log_label, series, round, validation_metric); malformed rows are left out."""
    df = spark.read.csv(path, header=True)
    return df.select("log_label", "series", F.col("round").try_cast("int").alias("round"), F.col("validation_metric").try_cast("double").alias("validation_metric")).dropna()


def log_lines(spark: SparkSession, path: str, run: str = "file") -> DataFrame:
    """(run, line, text) of the lines of text files, numbered from 0 in each run's order.

    run: `file`, a run is a file, named without extension; `folder`, a run is a folder's files one after the
    other, by name, as of a log that was written in parts; the folder gives its name (of run=<name> the name). Large files are read by several
    tasks: lines are written to the shared folder with the block that they stand in, numbered within it, and
    shifted by the lines of the blocks before.
    """
    file = F.col("_metadata.file_path")
    name = F.regexp_extract(file, r"([^/]+?)(\.[^./]*)?$", 1) if run == "file" else F.regexp_extract(file, r"(?:run=)?([^/]+)/[^/]+$", 1)
    raw = spark.read.option("recursiveFileLookup", True).text(path)
    rows = raw.select(name.alias("run"), file.alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("m"), F.col("value").alias("text"))
    folder = shared_folder(spark)
    rows.write.parquet(folder)
    rows = spark.read.parquet(folder)
    blocks = rows.groupBy("run", "file", "block").agg(F.count("*").alias("n"), F.min("m").alias("first"))  # a row for each block
    before = Window.partitionBy("run").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = blocks.select("file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return rows.join(shifts, ["file", "block"]).select("run", (F.col("m") + F.col("shift")).alias("line"), "text")


def write_log(lines: DataFrame, path: str) -> None:
    """(run, line, text) as plain text in a folder per run: its files, by name, hold the lines in order. Tasks share a long run."""
    ordered = lines.repartitionByRange("run", "line").sortWithinPartitions("run", "line")
    ordered.select("run", F.col("text").alias("value")).write.partitionBy("run").text(path)


def config_docs(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """(run, path, text) of all files of a pattern below a folder, a file being one document; a run is a file's folder."""
    whole = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    file = F.col("_metadata.file_path")
    return whole.select(F.regexp_extract(file, r"([^/]+)/[^/]+$", 1).alias("run"), file.alias("path"), F.col("value").alias("text"))


def write_config_docs(docs: DataFrame, path: str) -> None:
    """Documents (run, value) as a file each, in the run's folder, as config_docs reads them.

    A file costs far more than its few bytes, so the number of tasks is stated: by the bytes Spark would give all to one.
    """
    docs.repartition(4 * docs.sparkSession.sparkContext.defaultParallelism, "run").write.partitionBy("run").text(path)


def corpus_tokens(documents: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, pos, token): lower-cased tokens between white space, in order; a null text has none."""
    words = F.filter(F.split(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"\s+"), lambda w: w != "")
    return documents.select(id_col, F.posexplode(words).alias("pos", "token"))


def write_votes(votes: DataFrame, path: str, rows_per_file: int = 1 << 22) -> None:
    """Votes by approach and weight type, in ranges of n and query: tasks share a large one, and a grid cell is a run of rows in few files."""
    order = ["approach", "weight_type", "n", "query"]
    ranged = votes.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.write.option("maxRecordsPerFile", rows_per_file).partitionBy("approach", "weight_type").parquet(path)


def grid_cell(spark: SparkSession, path: str, approach: str, weight_type: str, n: int) -> DataFrame:
    """(query, label, score) of one cell: two pruned partitions and a pushed filter."""
    return spark.read.parquet(path).filter((F.col("approach") == approach) & (F.col("weight_type") == weight_type) & (F.col("n") == n)).select("query", "label", "score")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header each, one per part of df."""
    df.write.csv(path, header=True)


def write_tables(tables: Mapping[str, DataFrame], path: str) -> None:
    """Report tables as CSV files with a header, in a folder for each name."""
    for name, df in tables.items():
        write_csv(df, f"{path}/{name}.csv")


def vocabulary_ids(words: DataFrame, columns: Sequence[str] = ("word",)) -> DataFrame:
    """(word, id): distinct words numbered by name from 0, in ranges of words: no task sorts or numbers all of them.

    The ranges are written to the shared folder, numbered within, and shifted by the sizes of those before.
    """
    spark, folder = words.sparkSession, shared_folder(words.sparkSession)
    long = words.select(F.explode(F.array(*columns)).alias("word")).filter("word is not null").distinct()
    long.repartitionByRange("word").sortWithinPartitions("word").withColumn("m", F.monotonically_increasing_id()).write.parquet(folder)
    # the upper bits of m tell the range, the lower 33 the place in it
    ranged = spark.read.parquet(folder).select("word", F.shiftright("m", 33).alias("range"), F.col("m").bitwiseAND((1 << 33) - 1).alias("at"))
    sizes = ranged.groupBy("range").count()  # a row for each range
    starts = sizes.select("range", F.coalesce(F.sum("count").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    return ranged.join(starts, "range").select("word", (F.col("at") + F.col("start")).alias("id"))


def write_vectors(vecs: DataFrame, path: str) -> None:
    """Word vectors (word, v) as Parquet, sorted by word within each file, so that a word's row group is found by its name."""
    vecs.repartitionByRange("word").sortWithinPartitions("word").write.parquet(path)


def write_neighbours(nbr: DataFrame, path: str) -> None:
    """A neighbour store of (query, rank, nword, distance): vocabulary (word, id), and lists (query_id, neighbour_ids, distances).

    A list's neighbours are in the order of their ranks; words stand as numbers.
    """
    vocabulary_ids(nbr, ("query", "nword")).write.parquet(f"{path}/vocabulary")
    ids = nbr.sparkSession.read.parquet(f"{path}/vocabulary")
    coded = nbr.join(ids.withColumnsRenamed({"word": "query", "id": "query_id"}), "query").join(ids.withColumnsRenamed({"word": "nword", "id": "nid"}), "nword")
    lists = coded.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "nid", "distance"))).alias("x"))
    lists.select("query_id", F.transform("x", lambda s: s["nid"]).alias("neighbour_ids"), F.transform("x", lambda s: s["distance"]).alias("distances")).write.parquet(f"{path}/lists")


def read_neighbours(spark: SparkSession, path: str) -> DataFrame:
    """(query, rank, nword, distance) of a neighbour store, numbers turned into words again."""
    ids = spark.read.parquet(f"{path}/vocabulary")
    rows = spark.read.parquet(f"{path}/lists").select("query_id", F.posexplode(F.arrays_zip("neighbour_ids", "distances")).alias("at", "n"))
    rows = rows.select("query_id", (F.col("at") + 1).alias("rank"), F.col("n.neighbour_ids").alias("nid"), F.col("n.distances").alias("distance"))
    return rows.join(ids.withColumnsRenamed({"word": "query", "id": "query_id"}), "query_id").join(ids.withColumnsRenamed({"word": "nword", "id": "nid"}), "nid").select("query", "rank", "nword", "distance")
