"""Queries over the given tables: every operator applied to inputs that Spark derives from them."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, partial

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import scalar
from ..operators import configs, curves, lexical, models, neighbours, splits, summary, trainlog, vectors
from ..sources import files
from ..streaming import trainlog as streams
from . import pipelines

Query = Callable[[SparkSession, str], DataFrame]
K, N_SPLITS, KS, NEAR = 20, 100, (50, 100, 200), 0.15
#: Width of the event_id ranges in which a log's running minimum is taken.
CHUNK = 1 << 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a few digits; minus zero becomes zero."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


class Fixture:
    """The word vectors, lists, splits and neighbours that the tables stand for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.raw = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("w"), "vec_id").alias("word"), F.col("embedding").alias("vector"), F.col("label").cast("int").alias("label"))
        self.vecs = vectors.unit_vectors(self.raw)
        # the planted glossary: the words near w0, about an eighth of all
        first = self.vecs.filter("word = 'w0'").agg(F.min("v")).scalar()
        near = self.vecs.withColumn("v0", first).select("word", F.round(scalar.dot("v", "v0"), 10).alias("s"))
        self.glossary = files.written(near.filter(F.col("s") >= NEAR).select("word"))
        self.stop = self.raw.filter("label = 0").select("word").join(self.glossary, "word", "left_anti")
        self.null_glossary = self.raw.filter("label = 3").select("word")

    def lasts(self) -> bool:
        """Whether the tables written so far are still there."""
        spark = self.raw.sparkSession
        try:
            for name in ("glossary", "splits", "control", "nbr", "features"):
                if name in self.__dict__ and (held := self.__dict__[name].inputFiles()):
                    spark.read.parquet(held[0])
        except AnalysisException:  # no such path
            return False
        return True

    @cached_property
    def splits(self) -> DataFrame:
        return files.written(splits.make_splits(self.glossary, N_SPLITS))

    @cached_property
    def control(self) -> DataFrame:
        """The splits with their words replaced by others."""
        return files.written(splits.randomised(self.splits, self.raw.join(self.stop, "word", "left_anti")))

    @cached_property
    def nbr(self) -> DataFrame:
        """The neighbour store: written once, as every method reads it several times."""
        return files.written(vectors.knn(self.vecs, K).withColumn("distance", F.round(1 - F.col("cossim"), 10)))

    @property
    def labelled_nbr(self) -> DataFrame:
        known = self.glossary.withColumn("k", F.lit(1))
        return self.nbr.join(known.withColumnRenamed("word", "nword"), "nword", "left").withColumn("nlabel", F.coalesce("k", F.lit(0))).drop("k")

    @property
    def labels(self) -> DataFrame:
        known = self.glossary.withColumn("k", F.lit(1))
        return self.raw.select("word").join(known, "word", "left").select("word", F.coalesce("k", F.lit(0)).alias("label"))

    @cached_property
    def features(self) -> DataFrame:
        """Features per split and word, written once: samples, training and scores all read them."""
        return files.written(pipelines.features(self.vecs, self.nbr, self.splits))

    @property
    def neighbourhoods(self) -> DataFrame:
        """Nested form, with neighbours of a cosine above 0.2 only, so that lengths differ; src is the file."""
        rows = self.labelled_nbr.filter("cossim > 0.2").groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "cossim", F.col("nword").alias("word"), F.col("nlabel").alias("label")))).alias("x"))
        rows = self.labels.join(rows, self.labels["word"] == rows["query"], "left")
        pos = F.substring("word", 2, 18).cast("bigint")
        nested = F.transform(F.coalesce("x", F.array().cast("array<struct<rank:int,cossim:double,word:string,label:int>>")), lambda s: F.struct(s["cossim"].alias("cossim"), s["word"].alias("word"), s["label"].alias("label")))
        return rows.select(F.concat(F.lit("f"), (pos % 4).cast("string")).alias("src"), pos.alias("pos"), "word", "label", nested.alias("neighbours"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, line, text): events as a training log, one run per user_id % 4."""
    e = table(spark, sf_dir, "events")
    run, day = F.concat(F.lit("run"), (F.col("user_id") % 4).cast("string")), F.dayofmonth("ts")
    # the running minimum within ranges of event_id, and the one carried from the ranges before
    e = e.withColumn("_run", F.coalesce(F.col("user_id") % 4, F.lit(-1))).withColumn("_chunk", F.coalesce(F.floor(F.col("event_id") / CHUNK), F.lit(-(1 << 62))))
    before = Window.partitionBy("_run").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = e.groupBy("_run", "_chunk").agg(F.min("value").alias("_least")).select("_run", "_chunk", F.min("_least").over(before).alias("_carried"))
    e = e.withColumn("_own", F.min("value").over(Window.partitionBy("_run", "_chunk").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1))).join(carried, ["_run", "_chunk"])
    best = F.least("_own", "_carried")
    e = e.withColumn("is_best", (F.col("event_type") == "view") & (best.isNull() | (F.col("value") < best)))
    client = F.concat(F.lit("c"), "user_id")
    num = F.format_string("%.4f", -F.col("value"))
    text = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("validation metric "), num, F.lit(" from client "), client))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("Contribution from "), client, F.lit(" ACCEPTED by the aggregator at round "), day.cast("string")))
        .when(F.col("is_best"), F.concat(F.lit("new best validation metric at round "), day.cast("string"), F.lit(": "), num))
        .otherwise(F.concat(F.lit("Round "), day.cast("string"), F.lit(" started")))
    )
    return e.select(run.alias("run"), F.col("event_id").alias("line"), text.alias("text"))


def perf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, round, dev_ppl, test_ppl): mean values of views and signups by day, per user_id % 4."""
    e = table(spark, sf_dir, "events")
    rows = e.groupBy(F.concat(F.lit("run"), (F.col("user_id") % 4).cast("string")).alias("run"), F.dayofmonth("ts").alias("round")).agg(F.round(F.avg(F.when(F.col("event_type") == "view", F.col("value"))), 6).alias("dev_ppl"), F.round(F.avg(F.when(F.col("event_type") == "signup", F.col("value"))), 6).alias("test_ppl"))
    return rows.dropna()


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, event_id, score, label): whole-number values against purchases, in ten lists."""
    return table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("key"), "event_id", F.round("value").alias("score"), (F.col("event_type") == "purchase").cast("int").alias("label"))


QUERIES: dict[str, Query] = {}
_FIXTURES: dict[tuple, Fixture] = {}


def fixture(spark: SparkSession, sf_dir: str) -> Fixture:
    """The session's fixture of a folder of tables, whose own tables are written once; built anew if these have gone or the folder's files changed."""
    m = F.col("_metadata")
    state = table(spark, sf_dir, "embeddings").select(m["file_path"], m["file_size"], m["file_modification_time"].cast("string")).distinct()
    key = spark.sparkContext.applicationId, sf_dir, tuple(sorted(map(tuple, state.collect())))
    found = _FIXTURES.get(key)
    if found is None or not found.lasts():
        found = _FIXTURES[key] = Fixture(spark, sf_dir)
    return found


def query(name: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        return f

    return add


def on_fixture(name: str) -> Callable[[Callable[[Fixture], DataFrame]], Callable]:
    def add(f: Callable[[Fixture], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: rounded(f(fixture(spark, sf_dir)))
        return f

    return add


# sources, projections, neighbours
on_fixture("s13_knn")(lambda x: x.nbr.select("query", "rank", "nword", "cossim"))
on_fixture("s13_knn_lsh")(lambda x: vectors.knn_lsh(x.vecs, K))


@on_fixture("s13_knn_cells")
def s13_knn_cells(x: Fixture) -> DataFrame:
    """Of the search over cells: its lists' rows, whether it found 0.9 of all true neighbours, and whether it compared fewer than all pairs."""
    found, compared = vectors.knn_cells(x.vecs, K)
    found, n = files.written(found), x.vecs.agg(F.count("*")).scalar()
    hits = found.join(x.nbr, ["query", "nword"], "left_semi").agg(F.count("*")).scalar()
    pairs = compared.agg(F.sum(F.col("words") * F.col("queries"))).scalar()
    return found.agg(F.count("*").alias("listed"), F.countDistinct("query").alias("queries")).select("listed", "queries", (hits >= 0.9 * n * K).alias("enough"), (pairs < n * n).alias("fewer"))


on_fixture("s1_explode_neighbours")(lambda x: neighbours.explode_neighbours(x.neighbourhoods, 10))
on_fixture("p4_skip_labels")(lambda x: neighbours.explode_neighbours(x.neighbourhoods, 5, skip=(1,)))
on_fixture("a2_neighbour_limit")(lambda x: neighbours.neighbour_limit(x.neighbourhoods))
on_fixture("p8_first_long_enough")(lambda x: neighbours.explode_neighbours(neighbours.first_long_enough(x.neighbourhoods.unionByName(x.neighbourhoods.withColumn("src", F.lit("a"))), 4)))
on_fixture("p1_unit_vectors")(lambda x: x.vecs.select("word", F.posexplode("v").alias("dim", "x")))
on_fixture("w1_prefix_votes")(lambda x: neighbours.prefix_votes(x.labelled_nbr))
on_fixture("w3_prefix_distances")(lambda x: neighbours.prefix_distances(x.labelled_nbr))
on_fixture("a3_graph_features")(lambda x: neighbours.graph_features(x.nbr, x.splits.filter("part = 'ref'"), ["split_id"]))


@query("p2_scrub")
def p2_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors whose every 7th cell is not finite."""
    bad = F.transform("embedding", lambda x, i: F.when((F.col("vec_id") + i) % 7 == 0, F.lit(float("nan"))).otherwise(x.cast("double")))
    v = table(spark, sf_dir, "embeddings").select("vec_id", bad.alias("b"))
    return v.select("vec_id", scalar.bad_cells("b").alias("n_bad"), scalar.norm(scalar.scrub("b")).alias("norm"))


# vectors
on_fixture("a5_centroid_similarity")(lambda x: vectors.centroid_similarity(x.vecs, vectors.centroids(x.vecs, x.splits.filter("part = 'ref'"), ["split_id"]), ["split_id"]))
on_fixture("j5_glossary_similarity")(lambda x: vectors.glossary_similarity(x.vecs, x.glossary))
on_fixture("a4_glossary_features")(lambda x: vectors.member_features(x.vecs, x.splits.filter("part = 'ref'"), ["split_id"]))


@query("x11_aggregate_embeddings")
def x11_aggregate_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of conversations pooled from hashed sub-token vectors of four dimensions."""
    tokens = files.corpus_tokens(table(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("id"), "text"), "id")
    vector = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda d: F.conv(F.substring(F.md5(F.concat_ws("/", F.col("token"), F.col("pos") % 3, d)), 1, 6), 16, 10).cast("double") / 16777216)
    pooled = vectors.pool_occurrences(tokens.select(F.concat_ws("/", "id", "pos").alias("occurrence"), F.col("token").alias("word"), vector.alias("vector")))
    return pooled.select("word", "cnt", F.posexplode("vector").alias("dim", "x"))


# curves
@query("c_curve_summary")
def c_curve_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.curve_summary(curves.score_groups(scored_events(spark, sf_dir), ["key"]), ["key"])


@query("c5_curve_points")
def c5_curve_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.curve_points(curves.score_groups(scored_events(spark, sf_dir), ["key"]), ["key"])


@query("a8_at_threshold")
def a8_at_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = curves.score_groups(scored_events(spark, sf_dir), ["key"])
    best = curves.curve_summary(groups, ["key"]).select("key", F.col("ba_threshold").alias("threshold"))
    return curves.at_threshold(groups.join(best, "key"), ["key"])


@query("c_lineitem_curves")
def c_lineitem_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned items ranked by price within each supplier."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_extendedprice").alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("label"))
    return curves.curve_summary(curves.score_groups(rows, ["l_suppkey"]), ["l_suppkey"])


@query("t_rank_metrics")
def t_rank_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.rank_metrics(scored_events(spark, sf_dir), ["key"], (50, 100, 200, 5000), ties=("event_id",))


@query("t10_candidates")
def t10_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top of one list: a report of 50."""
    return scored_events(spark, sf_dir).orderBy(F.desc("score"), "event_id").limit(50)


@query("g6_random_ties")
def g6_random_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.rank_metrics(scored_events(spark, sf_dir), ["key"], (50, 100), ties=(scalar.hash_order(42, "key", "event_id"), "event_id"))


# splits
on_fixture("g1_random_splits")(lambda x: splits.make_splits(x.raw, N_SPLITS))
on_fixture("g2_stratified_splits")(lambda x: splits.make_splits(x.labels, N_SPLITS, stop=x.stop, strata=["label"], neg_ratio=2.0))
on_fixture("u3_verify_splits")(lambda x: splits.verify_splits(splits.make_splits(x.raw, N_SPLITS).union(x.splits)))
on_fixture("a13_part_sizes")(lambda x: splits.part_sizes(splits.make_splits(x.labels, N_SPLITS, strata=["label"], neg_ratio=2.0)))
on_fixture("a14_split_info")(lambda x: summary.split_info(x.labels.filter("word not like '%7'"), splits.make_splits(x.raw, N_SPLITS)))
on_fixture("g3_pools")(lambda x: pipelines.sampled_pools(x.splits, x.raw, x.stop, neg_ratio=3.0))
on_fixture("p11_pools")(lambda x: pipelines.pools(x.splits, x.raw, x.stop))
on_fixture("g4_training_sample")(lambda x: splits.hashed_sample(x.raw.join(x.glossary, "word", "left_anti").select("label", "word"), ["label"], F.lit(5), "train"))
on_fixture("g5_randomised")(lambda x: splits.randomised(x.splits, x.raw.join(x.stop, "word", "left_anti")))
on_fixture("u1_master_list")(lambda x: x.splits.select("word").distinct().exceptAll(x.stop.distinct()))
on_fixture("u2_master_stop")(lambda x: x.raw.filter("label < 2").select("word").intersect(x.glossary))
on_fixture("t6_reliable_negatives")(lambda x: models.reliable_negatives(vectors.centroid_similarity(x.vecs, vectors.centroids(x.vecs, x.splits.filter("part = 'ref'"), ["split_id"]), ["split_id"]), ["split_id"], "csim", 15))
on_fixture("j3_vocabulary_ids")(lambda x: files.vocabulary_ids(x.raw.select("word")))


@query("a1_majority_class")
def a1_majority_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of labelled documents by the quality of the documents that hold them."""
    tokens = files.corpus_tokens(table(spark, sf_dir, "documents")).join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return splits.majority_class(tokens.select(F.col("token").alias("word"), F.col("quality").alias("label")))


# lexical
@query("j6_lexical_similarity")
def j6_lexical_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names against those of each brand's parts."""
    parts = table(spark, sf_dir, "part")
    names = parts.select(F.col("p_name").alias("word"))
    ref = parts.select(F.col("p_brand").alias("brand"), F.col("p_name").alias("word")).distinct()
    return lexical.lexical_similarity(names, ref, ["brand"])


# summaries
def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c_curve_summary(spark, sf_dir).select("key", F.explode(F.map_from_arrays(F.array(F.lit("roc_auc"), F.lit("average_precision")), F.array("roc_auc", "average_precision"))).alias("metric", "value"))


query("a9_summary")(lambda s, d: summary.normal_ci(summary.summarise(_results(s, d), ["metric"], ddof=0)))
query("a10_bootstrap")(lambda s, d: summary.bootstrap_ci(_results(s, d), ["metric"], resamples=10_000))
query("a12_histogram")(lambda s, d: summary.histogram(table(s, d, "events").select("event_type", "value"), ["event_type"]))
query("a7_class_rates")(lambda s, d: summary.class_rates(scored_events(s, d)))
query("a20_separation")(lambda s, d: summary.separation(scored_events(s, d), ["key"]))
query("p14_health_flags")(lambda s, d: summary.health_flags(table(s, d, "events").select(F.when(F.col("event_id") % 100 == 0, float("nan")).otherwise(F.col("value")).alias("score"), (F.col("user_id") < 5).cast("int").alias("label"))).withColumn("labels", F.array_join("labels", ",")).withColumn("flags", F.array_join("flags", ",")))
on_fixture("a15_global_counts")(lambda x: summary.global_counts(x.raw, x.raw.filter("label != 9"), x.raw.filter("label != 8"), x.glossary))
on_fixture("a16_chance_levels")(lambda x: summary.chance_levels(pipelines.pool_counts(x.splits, x.raw, x.stop), KS, ["split_id", "part"]))
query("w9_hybrid")(lambda s, d: models.z_scores(scored_events(s, d).withColumn("flat", F.lit(1.0)), ["key"], ["score", "flat"]).select("key", "event_id", (F.col("z_score") + F.col("z_flat")).alias("hybrid")))

# logs and configurations
query("f1_log_events")(lambda s, d: trainlog.log_events(log_lines(s, d)))
query("w6_pair_metrics")(lambda s, d: trainlog.pair_metrics(trainlog.log_events(log_lines(s, d))))


@query("s8_log_files")
def s8_log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log written as plain text, in parts for each run, and read again with its line numbers."""
    folder = files.shared_folder(spark)
    files.write_log(log_lines(spark, sf_dir), folder)
    read = trainlog.log_events(files.log_lines(spark, folder, run="folder"))
    return read.groupBy("run", "kind").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.min("line").alias("first"), F.max("line").alias("last"))


@query("x12_training_log")
def x12_training_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = trainlog.log_events(log_lines(spark, sf_dir))
    return trainlog.log_metrics(trainlog.pair_metrics(events), events)


query("a17_round_average")(lambda s, d: trainlog.round_average(x12_training_log(s, d)))
query("w7_best_so_far")(lambda s, d: trainlog.best_so_far(trainlog.log_events(log_lines(s, d))))
query("a19_run_overview")(lambda s, d: trainlog.run_overview(trainlog.log_events(log_lines(s, d))))
query("x13_best_checkpoint")(lambda s, d: trainlog.best_checkpoint(perf(s, d)))


@query("x14_run_configs")
def x14_run_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings nested over the events' props, one document an event; one of each hundred does not parse."""
    e = table(spark, sf_dir, "events")
    doc = F.format_string('{"a": {"lr": %.3f, "other": [1, {"batch_size": %d}]}, "b": {"learning_rate": 9, "train_batch_size": %d}, "rounds": %d}', F.col("value"), F.col("user_id"), F.col("event_id"), F.dayofmonth("ts"))
    text = F.when(F.col("event_id") % 100 == 0, F.lit("{broken")).otherwise(doc)
    return configs.run_configs(e.select(F.concat(F.lit("run"), F.col("user_id") % 4).alias("run"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("path"), text.alias("text")))


@query("a25_model_sites")
def a25_model_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites of the runs: folders name those of even runs, the log those of the others; some have a letter."""
    logged = trainlog.log_events(log_lines(spark, sf_dir)).filter("site is not null").select("run", "site").distinct()
    folders = logged.filter("run in ('run0', 'run2')").select("run", "site")
    runs = logged.select("run").union(spark.range(1).select(F.lit("run9")))
    return configs.model_sites(runs, folders, logged, {f"c{i}": chr(65 + i) for i in range(12)})


# sinks read back
@query("s3_splits_json")
def s3_splits_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = files.shared_folder(spark)
    files.write_splits_json(fixture(spark, sf_dir).splits, folder)
    return files.splits_json(spark, folder)


@query("s5_scores_csv")
def s5_scores_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = files.shared_folder(spark)
    files.write_csv(table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("word"), F.col("p_retailprice").alias("price"), F.col("p_size").alias("size")), folder)
    return files.scores_csv(spark, folder)


@query("s6_checkpoint_csv")
def s6_checkpoint_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = files.shared_folder(spark)
    rows = perf(spark, sf_dir).select("run", F.concat(F.lit("FL_global_model_"), "round", F.lit(".pt")).alias("model_checkpoint"), F.col("dev_ppl").cast("string").alias("dev_perplexity"), F.when(F.col("round") % 9 == 0, "n/a").otherwise(F.col("test_ppl").cast("string")).alias("test_perplexity"))
    best = rows.dropDuplicates(["run"]).withColumn("model_checkpoint", F.lit("best_FL_global_model.pt"))
    rows.unionByName(best).write.partitionBy("run").csv(folder, header=True)
    return files.checkpoint_csv(spark, folder)


@query("s10_grid_cell")
def s10_grid_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, folder = fixture(spark, sf_dir), files.shared_folder(spark)
    files.write_votes(pipelines.approach_scores(x.labelled_nbr).join(x.labels.withColumnRenamed("word", "query"), "query"), folder)
    return files.grid_cell(spark, folder, "votes", "inverse", 7)


query("s11_corpus_tokens")(lambda s, d: files.corpus_tokens(table(s, d, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("doc_id"), "text")))

# pipelines
on_fixture("x1_grid_evaluate")(lambda x: pipelines.grid_evaluate(neighbours.prefix_votes(x.labelled_nbr).withColumn("score", F.round("vote", 10)).join(x.labels.withColumnRenamed("word", "query"), "query")))
on_fixture("x2_split_evaluate")(lambda x: pipelines.split_evaluate(neighbours.prefix_votes(x.labelled_nbr).withColumn("score", F.round("vote", 10)).join(x.labels.withColumnRenamed("word", "query"), "query"), splits.make_splits(x.labels, N_SPLITS, strata=["label"]).drop("label"), ks=KS))
for _mode in ("vote", "mindist", "avgdist"):
    on_fixture(f"x3_list_evaluate_{_mode}")(partial(lambda mode, x: pipelines.list_evaluate(x.nbr, x.splits, x.raw, x.stop, K, mode, ks=KS), _mode))
on_fixture("x4_approach_evaluate")(lambda x: pipelines.approach_evaluate(x.labelled_nbr, x.labels, splits.make_splits(x.labels, N_SPLITS, strata=["label"]).drop("label"), ks=KS))
on_fixture("x5_split_report")(lambda x: pipelines.split_report(pipelines.centroid_evaluate(x.vecs, x.splits, x.stop, ks=KS), ["roc_auc", "average_precision", "precision"], ["k"]))
on_fixture("x6_compare_methods")(lambda x: pipelines.compare_methods(x.features, x.splits, x.stop, KS, eval_full_pool=True)[0])
on_fixture("a24_learned_weights")(lambda x: pipelines.learned_classifiers(x.features, x.splits, x.stop).select("clf", F.posexplode("weights").alias("feature", "w")).groupBy("clf", "feature").agg(F.avg("w").alias("mean"), F.stddev_pop("w").alias("std")))
on_fixture("x7_centroid_evaluate")(lambda x: pipelines.centroid_evaluate(x.vecs, x.splits, x.stop, x.raw.filter("label != 5"), ks=KS))
on_fixture("x9_diagnose_best")(lambda x: pipelines.diagnose(neighbours.prefix_votes(x.labelled_nbr).withColumn("score", F.round("vote", 10)).join(x.labels.withColumnRenamed("word", "query"), "query"))[0])
on_fixture("x10_score_words")(lambda x: pipelines.score_words(x.vecs, x.raw.select("word", (F.col("label") * 3).alias("cnt")), x.glossary))
on_fixture("x10_evaluate_scores")(lambda x: pipelines.evaluate_scores(pipelines.score_words(x.vecs, x.raw.select("word", (F.col("label") * 3).alias("cnt")), x.glossary).unpivot("word", ["centroid", "log_count", "avgdist_all"], "method", "score"), x.null_glossary, KS))
query("x15_side_by_side")(lambda s, d: pipelines.side_by_side(_results(s, d).select(F.col("metric").alias("method"), F.concat(F.lit("m"), F.col("key") % 2).alias("model"), F.col("value").alias("roc_auc")), models_=["m0", "m1"]))


# further sources, lists and counts
@query("s4_word_list")
def s4_word_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as a text file, read in the three ways."""
    folder = files.shared_folder(spark)
    table(spark, sf_dir, "part").select(F.concat(F.lit(" "), F.initcap("p_name"), F.lit(" "))).write.text(folder)
    out = [files.word_list(spark, folder, m).distinct().withColumn("mode", F.lit(m)) for m in ("line", "token", "lower")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("s7_log_metrics_csv")
def s7_log_metrics_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = files.shared_folder(spark)
    rows = x12_training_log(spark, sf_dir)
    bad = F.when(F.col("round") == 5, "x").otherwise(F.col("validation_metric").cast("string"))
    rows.withColumn("validation_metric", bad).write.csv(folder, header=True)
    return files.log_metrics_csv(spark, folder)


@query("s9_config_docs")
def s9_config_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON file per user, in the user's folder; every tenth is broken."""
    folder = files.shared_folder(spark)
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    doc = F.when(F.col("user_id") % 10 == 0, "{broken").otherwise(F.format_string('{"t": {"batch_size": %d}}', "n"))
    files.write_config_docs(e.select(F.concat(F.lit("u"), "user_id").alias("run"), doc.alias("value")), folder)
    docs = files.config_docs(spark, folder, "*.txt")
    return configs.run_configs(docs.withColumn("run", F.substring("run", 5, 100)))


on_fixture("s12_restrict_vocabulary")(lambda x: x.vecs.select("word").join(x.nbr.select(F.col("nword").alias("word")).distinct(), "word", "left_semi"))
query("p13_model_names")(lambda s, d: configs.model_name(trainlog.log_events(log_lines(s, d)).filter("site is not null").select("run", F.concat(F.lit("s"), F.length("site")).alias("site"))))
query("t11_longest_run")(lambda s, d: trainlog.longest_run(trainlog.log_events(log_lines(s, d))))


on_fixture("x8_split_counts")(lambda x: pipelines.split_counts(x.vecs, x.splits, x.stop, KS, neg_ratio=2)[0])
on_fixture("u4_used_negatives")(lambda x: pipelines.split_counts(x.vecs, x.splits, x.stop, KS, neg_ratio=2)[1])
on_fixture("x9_diagnose_flags")(lambda x: pipelines.diagnose(neighbours.prefix_votes(x.labelled_nbr).withColumn("score", F.round("vote", 10)).join(x.labels.withColumnRenamed("word", "query"), "query"))[1].select("n", "n_nan", "n_inf", F.array_join("labels", ",").alias("labels"), F.array_join("flags", ",").alias("flags")))


def _log_stream(spark: SparkSession, sf_dir: str, folder: str, order: tuple[int, ...] = (0, 1, 2, 3)) -> DataFrame:
    """The log as a stream of four batches, ranges of lines in a given order."""
    lines = log_lines(spark, sf_dir)
    lines.write.parquet(f"{folder}/all")
    lines = spark.read.parquet(f"{folder}/all")
    low, high, n = lines.agg(F.min("line"), F.max("line"), F.count("*")).first()
    cuts = [low + (high + 1 - low) * i // 4 for i in range(5)] if n else []
    each = max(1, n // 4_000_000)  # files of a batch
    for a, b in [(cuts[i], cuts[i + 1]) for i in order] if n else []:
        lines.filter((F.col("line") >= a) & (F.col("line") < b)).repartition(each).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", each).parquet(f"{folder}/in" if n else f"{folder}/all")


def _batches(df: DataFrame, folder: str) -> DataFrame:
    """The rows of an update stream, run to its end, with the number of their batch."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{folder}/out")

    df.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(StructType([*df.schema.fields, StructField("batch", IntegerType())])).parquet(f"{folder}/out")


def _last_of_batches(df: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """An update stream run to its end; of each key the row of the last batch that changed it."""
    rest = [c for c in df.columns if c not in keys]
    last = _batches(df, folder).groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("x"))
    return last.select(*keys, "x.*")


@query("r1_pair_stream")
def r1_pair_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as a stream of files whose batches come in the wrong order, paired with state kept per run and site."""
    folder, key = files.shared_folder(spark), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, streams.PROVIDER)
    try:
        return streams.last_pairs(_batches(streams.pair_stream(_log_stream(spark, sf_dir, folder, (1, 0, 3, 2)), late=1 << 62), folder))
    finally:
        spark.conf.set(key, before)


@query("r2_best_stream")
def r2_best_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best so far of each run, as the stream leaves it."""
    folder = files.shared_folder(spark)
    return _last_of_batches(streams.best_stream(_log_stream(spark, sf_dir, folder)), folder, ["run"])


@query("r2_round_average_stream")
def r2_round_average_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running mean losses of the rounds over a stream of pairs, as the stream leaves them."""
    folder = files.shared_folder(spark)
    events = trainlog.log_events(log_lines(spark, sf_dir))
    trainlog.pair_metrics(events).select("run", "site", "line", "round", "value").repartition(4).write.parquet(f"{folder}/in")
    pairs = spark.readStream.schema(streams.PAIR).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    return _last_of_batches(streams.round_average_stream(pairs), folder, ["run", "round"])


# stores, lists to splits, tables of results
@on_fixture("k2_neighbour_store")
def k2_neighbour_store(x: Fixture) -> DataFrame:
    """Neighbours written as numbers and read back as words."""
    folder = files.shared_folder(x.raw.sparkSession)
    files.write_neighbours(x.nbr, folder)
    return files.read_neighbours(x.raw.sparkSession, folder)


@on_fixture("k5_vectors")
def k5_vectors(x: Fixture) -> DataFrame:
    """Unit vectors written and read back, at length one again."""
    folder = files.shared_folder(x.raw.sparkSession)
    files.write_vectors(x.vecs, folder)
    return x.raw.sparkSession.read.parquet(folder).select("word", scalar.norm("v").alias("length"), F.size("v").alias("dims"))


def _master(x: Fixture) -> DataFrame:
    """A master list: words of two labels, and as many that no class is known for; classes of some stand several times."""
    words = x.raw.filter("label in (1, 3)").select("word").union(x.raw.filter("label = 5").select(F.concat(F.lit("no-"), "word")))
    return splits.matched_list(words, x.stop, x.labels.unionByName(x.labels.filter("word like '%3'").withColumn("label", 1 - F.col("label"))))


on_fixture("x17_list_to_splits")(lambda x: splits.splits_of_list(_master(x), N_SPLITS, neg_ratio=4.0))
on_fixture("j11_list_counts")(lambda x: splits.list_counts(_master(x)))
on_fixture("p8_keep_last")(lambda x: vectors.keep_one(x.raw.select("label", F.substring("word", 2, 18).cast("bigint").alias("at"), "word"), "label", ["at"], last=True))
on_fixture("u5_ref_pools")(lambda x: pipelines.pools(x.splits, x.raw, x.stop, background="ref").groupBy("split_id", "part", "label").agg(F.count("*").alias("n"), F.min("word").alias("first")))


@on_fixture("a16_enrichment")
def a16_enrichment(x: Fixture) -> DataFrame:
    """Test terms among the first words by centroid similarity, against chance."""
    found = pipelines.centroid_evaluate(x.vecs, x.splits, x.stop, ks=KS)
    counts = found.select("split_id", "pos", "neg").distinct()
    return summary.enrichment(summary.chance_levels(counts, KS, ["split_id"]), found.select("split_id", "k", "precision"))


query("a23_metric_table")(lambda s, d: summary.metric_table(_results(s, d).withColumn("method", F.concat(F.lit("m"), F.col("key") % 3)), ["roc_auc", "average_precision"]))


@query("m4_fixed_weights")
def m4_fixed_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events scored by a classifier that is given; a feature that is no number has no part."""
    e = scored_events(spark, sf_dir).select("key", "event_id", "score", F.when(F.col("event_id") % 7 == 0, float("nan")).otherwise(F.col("event_id") % 10).alias("digit"))
    given = spark.createDataFrame([([0.5, -1.25], 0.75, [40.0, 4.5], [12.0, 3.0])], "weights array<double>, intercept double, means array<double>, deviations array<double>")
    return models.predict(e, given, [], ["score", "digit"], "p").select("key", "event_id", "p")


on_fixture("x10_trained_scores")(lambda x: pipelines.trained_scores(pipelines.score_words(x.vecs, x.raw.select("word", (F.col("label") * 3).alias("cnt")), x.glossary), x.glossary)[0].select("word", "pu_lr", "pu_rn"))
on_fixture("x6_randomised")(lambda x: pipelines.compare_methods(files.written(pipelines.features(x.vecs, x.nbr, x.control)), x.control, x.stop, KS, eval_full_pool=True)[0])


def _given(x: Fixture) -> DataFrame:
    """Classifiers that are given: a row for each split and kind, with weights of its own."""
    at = F.col("split_id")
    weights = F.array(*[F.round(F.lit(0.5) - F.lit(0.125) * i + F.lit(0.0625) * at, 6) for i in range(len(FEATURES))])
    rows = x.splits.select("split_id").distinct().withColumn("clf", F.explode(F.array(F.lit("pu_lr"), F.lit("pu_rn"))))
    sign = F.when(F.col("clf") == "pu_lr", 1.0).otherwise(-0.5)
    return rows.select("split_id", "clf", F.transform(weights, lambda w: w * sign).alias("weights"), F.lit(-0.25).alias("intercept"), F.array(*[F.lit(0.1 * (i % 3)) for i in range(len(FEATURES))]).alias("means"), F.array(*[F.lit(0.5 + 0.25 * (i % 2)) for i in range(len(FEATURES))]).alias("deviations"))


FEATURES = ("vote", "mindist", "avgdist", "cnt", "centroid", "mindist_all", "avgdist_all", "votetopk_all", "lexical")
on_fixture("x6_features")(lambda x: x.features)
on_fixture("x6_given_classifiers")(lambda x: pipelines.compare_methods(x.features, x.splits, x.stop, KS, neg_ratio_train=2, classifiers=_given(x))[0])
on_fixture("x6_training_rows")(lambda x: pipelines.training_rows(x.features, x.splits, x.stop, 2).select("split_id", "clf", "word", "label"))
on_fixture("a24_weight_table")(lambda x: models.weight_table(_given(x), FEATURES))


@on_fixture("m1_fitted_optima")
def m1_fitted_optima(x: Fixture) -> DataFrame:
    """What each split's classifiers learnt from, and whether the loss's gradient vanishes where training ended."""
    rows = files.written(pipelines.training_rows(x.features, x.splits, x.stop, 2))
    fitted = models.fit_per_key(rows, ["split_id", "clf"], FEATURES)
    return models.fit_gaps(rows, fitted, ["split_id", "clf"], FEATURES).select("split_id", "clf", "positives", "negatives", (F.col("gap") < 1e-6).alias("optimal"))


@on_fixture("m6_fitted_by_all")
def m6_fitted_by_all(x: Fixture) -> DataFrame:
    """The same of classifiers that all tasks fit together, one of each kind over all splits' rows."""
    rows = files.written(pipelines.training_rows(x.features, x.splits, x.stop, 2))
    out = None
    for clf in ("pu_lr", "pu_rn"):
        own = rows.filter(F.col("clf") == clf)
        gaps = models.fit_gaps(own, models.fit_large(own, FEATURES).withColumn("clf", F.lit(clf)), ["clf"], FEATURES)
        out = gaps if out is None else out.unionByName(gaps)
    return out.select("clf", "positives", "negatives", (F.col("gap") < 1e-3 * (F.col("positives") + F.col("negatives"))).alias("optimal"))


@query("x13_checkpoint_report")
def x13_checkpoint_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log, settings and checkpoints of each run; one run has no evaluated checkpoints, one none of the files."""
    e = table(spark, sf_dir, "events")
    run = F.concat(F.lit("run"), (F.col("user_id") % 4).cast("string"))
    doc = F.format_string('{"server": {"min_clients": %d, "n_rounds": %d}}', F.col("user_id"), F.col("event_id"))
    docs = e.select(run.alias("run"), F.concat(F.lit("/w/"), F.lpad(F.col("event_id").cast("string"), 12, "0"), F.when(F.col("event_id") % 3 == 0, "/meta.json").otherwise("/fed_config.json")).alias("path"), doc.alias("text"))
    found = perf(spark, sf_dir).filter("run != 'run1' and round % 2 = 0").select("run", F.concat(F.lit("FL_global_model_"), "round", F.lit(".pt")).alias("file"))
    settings = configs.run_configs(docs, patterns=configs.PATTERNS)
    return trainlog.checkpoint_report(trainlog.run_overview(trainlog.log_events(log_lines(spark, sf_dir))), settings, perf(spark, sf_dir).filter("run != 'run2'"), found)


@query("k4_config_table")
def k4_config_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of the runs with the sites of their logs, as a table written and read again."""
    folder = files.shared_folder(spark)
    logged = files.written(trainlog.log_events(log_lines(spark, sf_dir)).filter("site is not null").select("run", "site").distinct())  # the log is read once
    sites = configs.model_sites(logged.select("run"), logged.limit(0), logged, {f"c{i}": chr(65 + i) for i in range(12)})
    files.write_tables({"config_all_models": configs.config_table(x14_run_configs(spark, sf_dir), sites)}, folder)
    read = spark.read.csv(f"{folder}/config_all_models.csv", header=True)
    return read.select("model_name", F.col("model_num").cast("int").alias("model_num"), "sites", *[F.coalesce(k, F.lit("")).alias(k) for k in configs.ALIASES])


@on_fixture("x5_report_tables")
def x5_report_tables(x: Fixture) -> DataFrame:
    """The tables of a report over splits, written and read again, in one long table."""
    spark, folder = x.raw.sparkSession, files.shared_folder(x.raw.sparkSession)
    found = pipelines.centroid_evaluate(x.vecs, x.splits, x.stop, ks=KS[:1]).drop("k", "pos", "neg")
    info = summary.split_info(x.labels.filter("word not like '%7'"), splits.make_splits(x.raw, N_SPLITS))
    files.write_tables(pipelines.report_tables(found, info, ["roc_auc", "average_precision", "precision"]), folder)
    read = lambda name: spark.read.csv(f"{folder}/{name}.csv", header=True, inferSchema=True)
    wide = read("aggregated_split_results")
    out = [wide.unpivot([], wide.columns, "name", "value").select(F.lit("aggregated").alias("part"), "name", "value")]
    out.append(read("split_distribution").select(F.lit("distribution").alias("part"), F.concat_ws("/", "metric", "bin").alias("name"), F.col("n").cast("double").alias("value")))
    stats = read("test_statistics")
    out.append(stats.unpivot("measure", stats.columns[1:], "s", "value").select(F.lit("test").alias("part"), F.concat_ws("_", "measure", "s").alias("name"), "value"))
    out.append(read("per_split_results").agg(F.count("*").cast("double").alias("value")).select(F.lit("per_split").alias("part"), F.lit("rows").alias("name"), "value"))
    out.append(read("split_info").agg(F.sum("size").cast("double").alias("value")).select(F.lit("split_info").alias("part"), F.lit("size").alias("name"), "value"))
    first, *rest = out
    for df in rest:
        first = first.unionByName(df)
    return first
