"""Training logs: typed lines, metric and acceptance pairs, best-so-far and checkpoint choice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import shared_folder

#: Formats of the log's lines (fixed values), in the order in which they are tried.
METRIC = r"validation metric\s+(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)\s+from client\s+(\S+)"
ACCEPT = r"Contribution from\s+(\S+)\s+ACCEPTED by the aggregator at round\s+([0-9]+)"
BEST = r"new best validation metric at round\s+([0-9]+):\s+(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)"
STARTED = r"Round\s+([0-9]+)\s+started"


def log_events(lines: DataFrame) -> DataFrame:
    """(run, line, kind, site, round, value) of the lines (run, line, text) that have one of the formats."""
    text = F.col("text")
    kind = F.when(text.rlike(METRIC), "metric").when(text.rlike(ACCEPT), "accept").when(text.rlike(BEST), "best").when(text.rlike(STARTED), "round")
    rows = lines.withColumn("kind", kind).filter(F.col("kind").isNotNull())
    site = F.when(F.col("kind") == "metric", F.regexp_extract("text", METRIC, 2)).when(F.col("kind") == "accept", F.regexp_extract("text", ACCEPT, 1))
    at = F.when(F.col("kind") == "accept", F.regexp_extract("text", ACCEPT, 2)).when(F.col("kind") == "best", F.regexp_extract("text", BEST, 1)).when(F.col("kind") == "round", F.regexp_extract("text", STARTED, 1))
    value = F.when(F.col("kind") == "metric", F.regexp_extract("text", METRIC, 1)).when(F.col("kind") == "best", F.regexp_extract("text", BEST, 2))
    return rows.select("run", "line", "kind", site.alias("site"), at.try_cast("int").alias("round"), value.try_cast("double").alias("value"))


def _brackets(e: DataFrame, keys: list[str]) -> DataFrame:
    """e (kind, line, value, ...) with lost (an acceptance without a partner within keys), depth, partner (a column of the others' values) and taken (a metric that has one)."""
    order = Window.partitionBy(*keys).orderBy("line")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("b", F.sum(F.when(F.col("kind") == "metric", 1).otherwise(-1)).over(upto))
    e = e.withColumn("low", F.least(F.lit(0), F.min("b").over(upto)))
    before = F.least(F.lit(0), F.coalesce(F.min("b").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    accept = F.col("kind") == "accept"
    e = e.withColumn("lost", accept & (F.col("b") < before)).withColumn("depth", F.col("b") - F.col("low") + accept.cast("int"))
    # a lost acceptance stands at depth 1 of nothing; it is kept apart
    at = Window.partitionBy(*keys, "lost", "depth").orderBy("line")
    return e.withColumns({"partner": F.when(accept & ~F.col("lost"), F.lag("value").over(at)), "taken": ~accept & F.coalesce(F.lead("kind").over(at) == "accept", F.lit(False))})


def pair_metrics(events: DataFrame) -> DataFrame:
    """(run, site, line, round, value): each acceptance with the site's latest metric that is not yet taken.

    A metric opens and an acceptance closes, as brackets do: an acceptance's partner is the last metric
    at its depth. Acceptances with nothing open are left out. Events are cut into ranges of lines, written
    to the shared folder, so that tasks share a busy site: each range is matched by itself, and what it
    leaves, acceptances and then metrics, is matched over the ranges at the depths that their numbers give.
    """
    spark, folder = events.sparkSession, shared_folder(events.sparkSession)
    e = events.filter(F.col("kind").isin("metric", "accept")).select("run", "site", "line", "kind", "round", "value")
    cut = e.repartitionByRange("run", "site", "line").sortWithinPartitions("run", "site", "line")
    cut.withColumn("part", F.spark_partition_id()).write.parquet(f"{folder}/ranges")
    here = _brackets(spark.read.parquet(f"{folder}/ranges"), ["run", "site", "part"])
    here.select("run", "site", "part", "line", "kind", "round", "value", "lost", "taken", "partner").write.parquet(f"{folder}/matched")
    here = spark.read.parquet(f"{folder}/matched")
    found = here.filter("kind = 'accept' and not lost").select("run", "site", "line", "round", F.col("partner").alias("value"))
    left = here.filter("lost or (kind = 'metric' and not taken)")
    # a row for each site and range: closes, then opens; height: what is open before it
    sums = left.groupBy("run", "site", "part").agg(F.count_if("lost").alias("closes"), F.count_if(~F.col("lost")).alias("opens"))
    order = Window.partitionBy("run", "site").orderBy("part")
    net = F.sum(F.col("opens") - F.col("closes")).over(order)
    low = sums.withColumn("net", net).withColumn("dip", F.least(F.lit(0), F.min(F.col("net") - F.col("opens")).over(order)))
    height = F.coalesce(F.lag(F.col("net") - F.col("dip")).over(order), F.lit(0))
    sums = low.withColumn("height", height).select("run", "site", "part", "closes", "height")
    place = F.row_number().over(Window.partitionBy("run", "site", "part", "lost").orderBy("line"))
    left = left.withColumn("place", place).join(sums, ["run", "site", "part"])
    depth = F.when(F.col("lost"), F.col("height") - F.col("place") + 1).otherwise(F.greatest(F.col("height") - F.col("closes"), F.lit(0)) + F.col("place"))
    left = left.withColumn("depth", depth).filter("depth > 0")
    across = left.withColumn("partner", F.lag("value").over(Window.partitionBy("run", "site", "depth").orderBy("line"))).filter("lost")
    return found.unionByName(across.select("run", "site", "line", "round", F.col("partner").alias("value")))


def log_metrics(pairs: DataFrame, events: DataFrame) -> DataFrame:
    """(log_label, series, round, validation_metric): series site:<name> from the pairs and global_best."""
    own = pairs.select(F.col("run").alias("log_label"), F.concat(F.lit("site:"), "site").alias("series"), "round", F.col("value").alias("validation_metric"))
    best = events.filter("kind = 'best'").select(F.col("run").alias("log_label"), F.lit("global_best").alias("series"), "round", F.col("value").alias("validation_metric"))
    return own.unionByName(best)


def round_average(metrics: DataFrame) -> DataFrame:
    """(log_label, round, loss, sites): mean loss (-metric) of the sites' largest metric in a round."""
    one = metrics.filter(F.col("series").startswith("site:")).groupBy("log_label", "series", "round").agg(F.max("validation_metric").alias("m"))
    return one.groupBy("log_label", "round").agg(F.avg(-F.col("m")).alias("loss"), F.count("*").alias("sites"))


def best_so_far(events: DataFrame) -> DataFrame:
    """(run, round, best): the last recorded new best, held to the run's last round; rounds before the first are left out."""
    last = events.groupBy("run").agg(F.max("round").alias("last"))
    rounds = last.filter("last is not null").select("run", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("round"))
    best = events.filter("kind = 'best'").groupBy("run", "round").agg(F.max_by("value", "line").alias("v"))
    held = F.last("v", ignorenulls=True).over(Window.partitionBy("run").orderBy("round").rowsBetween(Window.unboundedPreceding, 0))
    return rounds.join(best, ["run", "round"], "left").withColumn("best", held).filter("best is not null").select("run", "round", "best")


def run_overview(events: DataFrame) -> DataFrame:
    """(run, last_best_round, last_best, sites): the last new best of each run, and its sites in order of first appearance."""
    best = events.filter("kind = 'best'").groupBy("run").agg(F.max_by(F.struct("round", "value"), "line").alias("b"))
    first = events.filter("site is not null").groupBy("run", "site").agg(F.min("line").alias("line"))
    sites = first.groupBy("run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "site"))), lambda s: s["site"]), ",").alias("sites"))
    return sites.join(best, "run", "full").select("run", F.col("b.round").alias("last_best_round"), F.col("b.value").alias("last_best"), "sites")


def best_checkpoint(perf: DataFrame) -> DataFrame:
    """(run, n, first_round, last_round, best_dev_round, best_dev, best_test_round, best_test, final_test, converged, target).

    perf: (run, round, dev_ppl, test_ppl); the first round wins ties; converged: best_test is below half of the worst.
    """
    def least(c: str):
        return F.min_by(F.struct("round", c), F.struct(c, "round"))

    out = perf.groupBy("run").agg(F.count("*").alias("n"), F.min("round").alias("first_round"), F.max("round").alias("last_round"), least("dev_ppl").alias("d"), least("test_ppl").alias("t"), F.max_by("test_ppl", "round").alias("final_test"), F.max("test_ppl").alias("worst"))
    return out.select("run", "n", "first_round", "last_round", F.col("d.round").alias("best_dev_round"), F.col("d.dev_ppl").alias("best_dev"), F.col("t.round").alias("best_test_round"), F.col("t.test_ppl").alias("best_test"), "final_test", (F.col("t.test_ppl") < F.col("worst") * 0.5).alias("converged"), F.concat(F.lit("FL_global_model_"), F.col("t.round").cast("string"), F.lit(".pt")).alias("target"))


def checkpoint_report(overview: DataFrame, settings: DataFrame, perf: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """A row per run: what its log, its settings and its evaluated checkpoints say, and the checkpoint to use.

    (run, sites, n_sites, num_rounds, min_clients, last_best_round, last_best, validation_loss, and the columns
    of best_checkpoint, early, target[, n_found, on_disk]). overview: run_overview; settings: (run, key, value)
    of run_configs; perf as in best_checkpoint; found: (run, file), the checkpoint files that are there.
    validation_loss is minus the metric; early: the best round lies in the first half, as where sites drift
    apart. target: the checkpoint of least test perplexity, else of the log's last best.
    """
    wide = settings.groupBy("run").agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in ("num_rounds", "min_clients")])
    best = best_checkpoint(perf).withColumnRenamed("target", "_target")
    rows = overview.join(wide, "run", "full").join(best, "run", "full")
    target = F.coalesce("_target", F.concat(F.lit("FL_global_model_"), F.col("last_best_round").cast("string"), F.lit(".pt")))
    rows = rows.withColumns({"n_sites": F.coalesce(F.size(F.split("sites", ",")), F.lit(0)), "validation_loss": -F.col("last_best"), "early": F.col("best_test_round") < F.col("last_round") * 0.5, "target": target})
    names = ["run", "sites", "n_sites", "num_rounds", "min_clients", "last_best_round", "last_best", "validation_loss", *[c for c in best.columns if c not in ("run", "_target")], "early", "target"]
    if found is None:
        return rows.select(names)
    held = found.groupBy("run").agg(F.count_if(F.col("file").rlike(r"^FL_global_model_.*\.pt$")).alias("n_found"), F.collect_set("file").alias("_files"))
    rows = rows.join(held, "run", "left")
    return rows.select(*names, F.coalesce("n_found", F.lit(0)).alias("n_found"), F.coalesce(F.array_contains("_files", F.col("target")), F.lit(False)).alias("on_disk"))


def longest_run(events: DataFrame) -> DataFrame:
    """(run, rounds) of the run with the most rounds, ties by name."""
    rounds = events.filter("round is not null").groupBy("run").agg(F.countDistinct("round").alias("rounds"))
    return rounds.agg(F.min_by(F.struct("run", "rounds"), F.struct(-F.col("rounds"), "run")).alias("x")).select("x.*")
