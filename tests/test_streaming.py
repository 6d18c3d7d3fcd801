"""The streams against the batch operators over the same lines."""

from glossarion.operators import trainlog
from glossarion.plans.queries import log_lines
from glossarion.streaming import trainlog as streams

SF = "/root/testdata/sf0.001"


def collected(spark, df, mode, tmp_path, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"ck_{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_streams_equal_batch(spark, tmp_path):
    lines = log_lines(spark, SF)
    for i, (a, b) in enumerate(((0, 300), (300, 600), (600, 1 << 40))):  # files in line order
        lines.filter(f"line >= {a} and line < {b}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{i}"))
    read = lambda: spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    events = trainlog.log_events(lines)
    want = sorted(map(tuple, trainlog.pair_metrics(events).select("run", "site", "line", "round", "value").collect()))
    best = collected(spark, streams.best_stream(read()), "update", tmp_path, "best").collect()
    last = {r["run"]: (r["round"], r["best"]) for r in best}
    assert last == {r["run"]: (r["last_best_round"], r["last_best"]) for r in trainlog.run_overview(events).collect() if r["last_best"] is not None}
    pairs = spark.createDataFrame(want, streams.PAIR)
    pairs.coalesce(1).write.parquet(str(tmp_path / "p"))
    stream = spark.readStream.schema(pairs.schema).parquet(str(tmp_path / "p"))
    running = {(r["run"], r["round"]): r["n"] for r in collected(spark, streams.round_average_stream(stream), "update", tmp_path, "avg").collect()}
    assert running == {(r["run"], r["round"]): r["count"] for r in pairs.groupBy("run", "round").count().collect()}


def test_pairs_of_late_lines(spark, tmp_path):
    """Batches in any order give the batch operator's pairs; lines beyond the bound are told; state is kept for few lines."""
    lines = log_lines(spark, SF).cache()
    top = lines.agg({"line": "max"}).first()[0] + 1
    want = sorted(map(tuple, trainlog.pair_metrics(trainlog.log_events(lines)).select("run", "site", "line", "round", "value").collect()))
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, streams.PROVIDER)
    try:
        for name, order, late in (("shuffled", (2, 0, 3, 1), top), ("orderly", (0, 1, 2, 3), 0), ("tight", (0, 1, 3, 2), 1)):
            for i, part in enumerate(order):
                lines.filter(f"line >= {top * part // 4} and line < {top * (part + 1) // 4}").coalesce(1).write.mode("append").parquet(str(tmp_path / name / "in"))
            stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name / "in"))
            out = str(tmp_path / name / "out")

            def write(batch, number, out=out):
                batch.selectExpr("*", f"{number} batch").write.mode("append").parquet(out)

            streams.pair_stream(stream, late).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", str(tmp_path / name / "ck")).trigger(availableNow=True).start().awaitTermination(300)
            found = spark.read.parquet(out)
            if name == "tight":
                assert found.filter("late").count() > 0
            else:
                assert found.filter("late").count() == 0
                assert sorted(map(tuple, streams.last_pairs(found).collect())) == want and want
    finally:
        spark.conf.set(key, before)
        lines.unpersist()
