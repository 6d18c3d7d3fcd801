"""Operators on small tables with results known by hand or by brute force."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossarion.functions import scalar
from glossarion.operators import configs, curves, lexical, models, neighbours, splits, summary, trainlog, vectors
from glossarion.plans import pipelines
from glossarion.sources import files


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_unknown_weight_is_an_error(spark):
    with pytest.raises(ValueError):
        scalar.neighbour_weight("d", "cubic")


def test_scrub_and_unit_vectors(spark):
    df = spark.createDataFrame([("a", [3.0, 4.0]), ("z", [0.0, 0.0]), ("n", [float("nan"), float("inf")]), ("x", None)], "word string, vector array<double>")
    assert dict(rows(vectors.unit_vectors(df), "word", "v")) == {"a": [0.6, 0.8], "z": [0.0, 0.0], "n": [0.0, 0.0]}


def test_lengths_are_computed_once_a_vector(spark):
    df = spark.createDataFrame([("a", [3.0, None, 4.0]), ("b", []), ("c", None)], "word string, v array<float>")
    assert dict(df.select("word", scalar.l2_normalise("v")).collect()) == {"a": [None, None, None], "b": [], "c": None}
    # once a cell would be 10^10 products here
    wide = spark.range(1).select(F.lit("w").alias("word"), F.array_repeat(F.lit(2.0), 100_000).alias("vector"))
    length = vectors.unit_vectors(wide).select(scalar.norm("v").alias("n"), F.size("v").alias("dims")).first()
    assert length["dims"] == 100_000 and abs(length["n"] - 1) < 1e-9


def test_char_ngrams(spark):
    df = spark.createDataFrame([("ab  C",), ("",)], "w string").select(scalar.char_ngrams("w").alias("g"))
    got = [sorted(r["g"]) for r in df.collect()]
    assert got[0] == sorted([" a", "ab", "b ", " ab", "ab ", " ab ", " c", "c ", " c "])
    assert got[1] == []


def _auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_average_precision_and_ties(spark):
    random.seed(1)
    data = [("k", float(random.randint(0, 9)), int(random.random() < 0.3)) for _ in range(300)]
    df = spark.createDataFrame(data, "k string, score double, label int")
    r = curves.curve_summary(curves.score_groups(df, ["k"]), ["k"]).first()
    assert math.isclose(r["roc_auc"], _auc([d[1:] for d in data]), rel_tol=1e-12)
    flipped = curves.curve_summary(curves.score_groups(df.withColumn("score", -F.col("score")), ["k"]), ["k"]).first()
    assert math.isclose(flipped["roc_auc"], 1 - r["roc_auc"], rel_tol=1e-12)
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    ml = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", numBins=0).evaluate(df.withColumn("label", F.col("label").cast("double")))
    assert math.isclose(r["roc_auc"], ml, rel_tol=1e-9)


def test_single_class_has_no_auc(spark):
    df = spark.createDataFrame([("k", 1.0, 1), ("k", 2.0, 1)], "k string, score double, label int")
    r = curves.curve_summary(curves.score_groups(df, ["k"]), ["k"]).first()
    assert r["roc_auc"] is None and r["average_precision"] is None and r["ba_threshold"] == math.inf


def test_threshold_is_applied_strictly(spark):
    df = spark.createDataFrame([("k", 1.0, 0), ("k", 2.0, 1), ("k", 3.0, 1)], "k string, score double, label int").withColumn("threshold", F.lit(2.0))
    g = curves.score_groups(df, ["k"]).withColumn("threshold", F.lit(2.0))
    assert rows(curves.at_threshold(g, ["k"]), "tp", "fp", "fn", "tn") == [(1, 0, 1, 1)]


def test_default_group_is_placed_by_value(spark):
    g = spark.createDataFrame([("k", -1.0, 1, 0), ("k", 2.0, 1, 1)], "k string, score double, np bigint, nn bigint")
    totals = spark.createDataFrame([("k", 3, 4)], "k string, pos bigint, neg bigint")
    assert rows(curves.with_default(g, totals, ["k"]), "score", "np", "nn") == [(-1.0, 1, 0), (0.0, 1, 3), (2.0, 1, 1)]


def test_rank_metrics_divide_by_what_is_there(spark):
    df = spark.createDataFrame([("k", "a", 3.0, 1), ("k", "b", 2.0, 0), ("k", "c", 2.0, 1)], "k string, word string, score double, label int")
    got = {r["k"]: r for r in curves.rank_metrics(df.withColumnRenamed("k", "g"), ["g"], (2, 10)).collect()}
    assert got[2]["precision"] == 0.5 and got[2]["recall"] == 0.5 and got[2]["specificity"] == 0.0
    assert got[10]["precision"] == pytest.approx(2 / 3)


def test_best_by_ignores_nan_and_prefers_the_first(spark):
    df = spark.createDataFrame([("s", 1, float("nan")), ("s", 2, 0.5), ("s", 3, 0.5)], "s string, n int, auc double")
    assert rows(curves.best_by(df, ["s"], "auc", [F.col("n")]), "n") == [(2,)]


def test_splits_partition_the_words(spark):
    words = spark.createDataFrame([(f"w{i}", int(i % 5 == 0)) for i in range(53)], "word string, label int")
    s = splits.make_splits(words, 3)
    assert rows(s.groupBy("split_id", "part").count(), "split_id", "part", "count") == sorted((i, p, n) for i in range(3) for p, n in (("ref", 42), ("dev", 5), ("test", 6)))
    assert rows(splits.verify_splits(s), "repeated", "shared") == [(0, 0)] * 3
    cut = splits.make_splits(words, 2, strata=["label"], neg_ratio=2.0)
    assert rows(cut.groupBy("split_id", "label").count(), "label", "count") == [(0, 22), (0, 22), (1, 11), (1, 11)]


def test_randomised_maps_each_word_once(spark):
    s = splits.make_splits(spark.createDataFrame([(f"w{i}",) for i in range(30)], "word string"), 2)
    pool = spark.createDataFrame([(f"p{i}",) for i in range(40)] + [(f"w{i}",) for i in range(30)], "word string")
    out = splits.randomised(s, pool)
    assert out.count() == 60 and out.select("word").distinct().count() == 30
    assert out.filter("word like 'w%'").count() == 0  # no true term stands for another
    assert rows(splits.verify_splits(out), "repeated", "shared") == [(0, 0)] * 2
    with pytest.raises(ValueError, match="30 words to replace, but only 5"):
        splits.randomised(s, pool.filter("word like 'w%'").union(pool.filter("word in ('p1', 'p2', 'p3', 'p4', 'p5')")))


def test_curves_by_ranges_equal_whole_curves(spark):
    random.seed(4)
    data = [(k, round(random.gauss(0, 1), 2), int(random.random() < 0.2)) for k in "ab" for _ in range(500)] + [("c", 1.0, 1)]
    groups = curves.score_groups(spark.createDataFrame(data, "k string, score double, label int"), ["k"])
    for f in (curves.curve_points, curves.curve_summary):
        whole, cut = f(groups, ["k"]), f(groups, ["k"], 7)
        near = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*whole.columns).fillna(-1).collect())
        assert near(whole) == near(cut)


def test_vocabulary_ids_over_several_ranges(spark, tmp_path):
    words = sorted({f"a{random.randint(0, 10**6)}" for _ in range(500)})
    df = spark.createDataFrame([(w,) for w in words * 2] + [(None,)], "word string")
    assert rows(files.vocabulary_ids(df), "word", "id") == list(zip(words, range(len(words)), strict=True))
    nbr = spark.createDataFrame([("x", 1, "y", 0.1), ("x", 2, "z", 0.2), ("y", 1, "x", 0.1)], "query string, rank int, nword string, distance double")
    files.write_neighbours(nbr, str(tmp_path / "store"))
    assert rows(files.read_neighbours(spark, str(tmp_path / "store")), *nbr.columns) == rows(nbr, *nbr.columns)


def test_log_lines_may_hold_any_white_space(spark):
    text = ["validation metric  -0.5 from client\ts1", "Contribution from  s1  ACCEPTED by the aggregator at round  3", "new best validation metric at round 4:  -1.5e-1", "Round  5 started", "Round started"]
    got = rows(trainlog.log_events(spark.createDataFrame([("r", i, t) for i, t in enumerate(text)], "run string, line bigint, text string")), "line", "kind", "round", "value")
    assert got == [(0, "metric", None, -0.5), (1, "accept", 3, None), (2, "best", 4, -0.15), (3, "round", 5, None)]


def test_missing_features_are_left_out_of_means(spark):
    nan = float("nan")
    df = spark.createDataFrame([(0, 1, 2.0, nan), (0, 1, 4.0, nan), (0, 0, nan, nan), (0, 0, 0.0, nan)], "k int, label int, a double, b double")
    m = models.fit_per_key(df, ["k"], ["a", "b"]).first()
    assert m["means"] == [2.0, 0.0] and m["deviations"][0] == pytest.approx(math.sqrt(8 / 3)) and m["weights"][1] == 0.0
    p = [r["score"] for r in models.predict(df, models.fit_per_key(df, ["k"], ["a", "b"]), ["k"], ["a", "b"]).collect() if math.isnan(r["a"])]
    assert p[0] == pytest.approx(1 / (1 + math.exp(-m["intercept"])))


def test_fit_over_all_tasks_equals_newton(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(150, 2)) * [1, 5] + [0, 3]
    y = (x[:, 0] + 0.5 * rng.normal(size=150) > 0.5).astype(int)
    df = spark.createDataFrame([(0, int(b), *map(float, a)) for a, b in zip(x, y, strict=True)], "k int, label int, a double, b double")
    for balanced in (True, False):
        one, all_ = models.fit_per_key(df, ["k"], ["a", "b"], balanced=balanced).first(), models.fit_large(df, ["a", "b"], balanced=balanced).first()
        assert all_["weights"] == pytest.approx(one["weights"], abs=1e-3) and all_["intercept"] == pytest.approx(one["intercept"], abs=1e-3)


def test_compare_methods_against_plain_python(spark):
    """Scores and metrics of one split; both classifiers by Newton's method on the same samples; the options."""
    rng = np.random.default_rng(11)
    names = [f"w{i:02}" for i in range(60)]
    parts = {"ref": names[:8], "dev": names[8:10], "test": names[10:16]}
    columns = ["vote", "centroid", "lexical", "cnt"]
    table = {w: rng.normal(size=4).round(3) + (1.0 if i < 16 else 0.0) for i, w in enumerate(names)}
    feats = spark.createDataFrame([(0, w, *map(float, np.abs(v) if c else v)) for c, (w, v) in ((0, x) for x in table.items())], "split_id int, word string, vote double, centroid double, lexical double, cnt double").withColumn("cnt", F.abs("cnt"))
    table = {w: np.r_[v[:3], abs(v[3])] for w, v in table.items()}
    sp = spark.createDataFrame([(0, p, w) for p, ws in parts.items() for w in ws], "split_id int, part string, word string")
    stop = spark.createDataFrame([("w59",)], "word string")
    out, fitted = pipelines.compare_methods(feats, sp, stop, ks=(5,), neg_ratio_train=2)
    got = {r["method"]: r for r in out.collect()}
    free = names[16:59]
    key = lambda w: hashlib.md5(f"42/train/0/{w}".encode()).hexdigest()
    samples = {"pu_lr": sorted(free, key=lambda w: (key(w), w))[:16], "pu_rn": sorted(free, key=lambda w: (table[w][1], w))[:16]}
    used = set(samples["pu_lr"]) | set(samples["pu_rn"])
    tested = [*parts["test"], *(w for w in free if w not in used)]
    z = lambda c: (lambda a: (a - a.mean()) / a.std())(np.array([table[w][c] for w in names]))
    mix = dict(zip(names, (z(0) + z(1) + z(2)).round(10), strict=True))
    scores = {"vote": {w: table[w][0] for w in names}, "hybrid": mix}
    for clf, negative in samples.items():
        x = np.array([table[w] for w in [*parts["ref"], *negative]])
        mean, dev = x.mean(0), x.std(0)
        w_ = models.newton_logistic((x - mean) / dev, np.array([1.0] * 8 + [0.0] * 16))
        scores[clf] = {w: 1 / (1 + math.exp(-((table[w] - mean) / dev @ w_[:4] + w_[4]))) for w in names}
        assert [r for r in fitted.collect() if r["clf"] == clf][0]["weights"] == pytest.approx(w_[:4].tolist(), rel=1e-6)
    for method, s in scores.items():
        assert got[method]["roc_auc"] == pytest.approx(_auc([(s[w], w in parts["test"]) for w in tested]), abs=1e-9)
        first = sorted(tested, key=lambda w: -s[w])[:5]
        assert got[method]["precision"] == pytest.approx(sum(w in parts["test"] for w in first) / 5)
    fewer, _ = pipelines.compare_methods(feats, sp, stop, ks=(5,), neg_ratio_train=None, eval_full_pool=True, class_weight=False, use_lexical=False)
    by = {r["method"]: r["roc_auc"] for r in fewer.collect()}
    assert "lexical" not in by and by["pu_lr"] == pytest.approx(by["pu_rn"])


def test_list_evaluation_counts_the_background(spark):
    """With and without listing the background the same rows come out, for reports longer than the scored words."""
    nbr = spark.createDataFrame([(f"w{i:02}", r, f"w{(i * 7 + r * 3) % 40:02}", 0.1 * r) for i in range(40) for r in (1, 2, 3)], "query string, rank int, nword string, distance double")
    words = spark.createDataFrame([(f"w{i:02}",) for i in range(40)], "word string")
    sp = splits.make_splits(words.filter("word < 'w20'"), 3)
    stop = words.filter("word = 'w39'")
    sparse = pipelines.list_evaluate(nbr, sp, words, stop, 3, ks=(2, 15, 100))
    scores = neighbours.list_scores(nbr, sp.filter("part = 'ref'").select("split_id", "word"), ["split_id"], 3)
    listed = pipelines.select_and_test(scores, pipelines.pools(sp, words, stop), ["weight_type", "n"], [pipelines.weight_order(), F.col("n")], 0.0, ks=(2, 15, 100))
    names = [c for c in sparse.columns if c != "precision_at_100"]
    assert rows(sparse, *names) == rows(listed, *names) and sparse.count() == 3
    # a report longer than the pool divides by the pool
    assert all(0 < r["precision_at_100"] <= 1 for r in sparse.collect())


def test_control_lists_and_sites(spark):
    runs = spark.createDataFrame([("1",), ("2",), ("3",)], "run string")
    pairs = lambda *x: spark.createDataFrame(x, "run string, site string")
    got = rows(configs.model_sites(runs, pairs(("1", "b"), ("1", "x")), pairs(("1", "a"), ("2", "b"), ("2", "a")), {"a": "A", "b": "B"}), "run", "sites", "model")
    assert got == [("1", "b", "Model B"), ("2", "a, b", "Model AB"), ("3", "?", "model_3")]
    classes = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1), ("s", 1)], "word string, label int")
    matched = splits.matched_list(spark.createDataFrame([("a",), ("b",), ("b",), ("n",), ("s",)], "word string"), spark.createDataFrame([("s",)], "word string"), classes)
    assert rows(matched.fillna(9), "word", "label") == [("a", 0), ("b", 1), ("n", 9)]
    assert tuple(splits.list_counts(matched).first()) == (3, 2, 1, 1)


def test_knn_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(90, 8))
    x[7] = x[8]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    names = [f"w{i}" for i in range(90)]
    df = spark.createDataFrame([(n, v.tolist()) for n, v in zip(names, x, strict=True)], "word string, v array<double>")
    sims = np.round(x @ x.T, vectors.DIGITS)
    want = sorted((names[i], r + 1, names[j]) for i in range(90) for r, j in enumerate(sorted((j for j in range(90) if j != i), key=lambda j: (-sims[i, j], names[j]))[:5]))
    assert rows(vectors.knn(df, 5), "query", "rank", "nword") == want


def test_neighbour_rules(spark):
    schema = "src string, pos bigint, word string, label int, neighbours array<struct<cossim:double,word:string,label:int>>"
    df = spark.createDataFrame([("b", 0, "x", 0, [(0.5, "p", 1)] * 3), ("a", 1, "x", 0, [(0.4, "q", 0)]), ("a", 2, "y", 9, [(0.3, "p", 2)] * 2), ("a", 3, "z", 0, [])], schema)
    assert neighbours.neighbour_limit(df).first()[0] == 1
    assert rows(neighbours.explode_neighbours(df, 2, skip=(9,)), "src", "query", "rank") == [("a", "x", 1), ("b", "x", 1), ("b", "x", 2)]
    assert rows(neighbours.first_long_enough(df, 2), "src", "word") == [("a", "y"), ("b", "x")]


def test_prefix_scores(spark):
    nbr = spark.createDataFrame([("q", 1, 0.1, 0), ("q", 2, 0.2, 1), ("q", 3, 0.4, 2)], "query string, rank int, distance double, nlabel int")
    votes = {(r["weight_type"], r["n"]): r for r in neighbours.prefix_votes(nbr).collect()}
    assert [votes["constant", n]["vote"] for n in (1, 2, 3)] == [0.0, 1.0, 3.0]
    assert 0 <= votes["inverse", 2]["vote_norm"] <= 1
    d = {r["n"]: r for r in neighbours.prefix_distances(nbr).collect()}
    assert d[1]["mindist"] == neighbours.NONE_SCORE and d[3]["mindist"] == -0.2 and d[3]["avgdist"] == pytest.approx(-0.3) and d[3]["central_median"] == 0.2


def test_signal_and_null(spark):
    """A planted glossary ranks high by centroid similarity, a random one near one half."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 16))
    x[:40] = x[0] + 0.7 * rng.normal(size=(40, 16))
    vecs = vectors.unit_vectors(spark.createDataFrame([(f"w{i:03d}", v.tolist()) for i, v in enumerate(x)], "word string, vector array<double>"))
    none = vecs.select("word").limit(0)

    def auc(names):
        s = splits.make_splits(spark.createDataFrame([(n,) for n in names], "word string"), 3)
        return np.mean([r["roc_auc"] for r in pipelines.centroid_evaluate(vecs, s, none, ks=(5,)).collect()])

    assert auc([f"w{i:03d}" for i in range(40)]) > 0.9
    assert 0.25 < auc([f"w{i:03d}" for i in range(40, 400, 9)]) < 0.75


def test_lexical_hand_case(spark):
    words = spark.createDataFrame([("abc",), ("abd",), ("xyz",)], "word string")
    got = dict(rows(lexical.lexical_similarity(words, spark.createDataFrame([("abc",)], "word string")), "word", "lexical"))
    assert got["abc"] == 1.0 and 0 < got["abd"] < 1 and "xyz" not in got


def test_histogram_of_one_value_and_summary(spark):
    df = spark.createDataFrame([("m", 2.0), ("m", 2.0), ("m", None), ("m", float("nan"))], "metric string, value double")
    assert rows(summary.histogram(df, ["metric"]), "bin", "n") == [(0, 2)]
    assert rows(summary.summarise(df, ["metric"]), "n", "mean", "std") == [(2, 2.0, 0.0)]
    assert rows(summary.bootstrap_ci(df, ["metric"], resamples=20), "ci_low", "ci_high") == [(2.0, 2.0)]


def test_health_flags(spark):
    df = spark.createDataFrame([(float("nan"), 0)] * 30 + [(float("inf"), 3)], "score double, label int")
    assert summary.health_flags(df).first()["flags"] == ["labels", "nan", "inf"] or "labels" in summary.health_flags(df).first()["flags"]


def test_newton_is_the_optimum_and_predicts(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 3))
    y = (x[:, 0] + 0.3 * rng.normal(size=200) > 0).astype(float)
    w = models.newton_logistic(x, y, balanced=False)
    p = 1 / (1 + np.exp(-(x @ w[:3] + w[3])))
    assert np.abs(x.T @ (p - y) + w[:3]).max() < 1e-6 and abs((p - y).sum()) < 1e-6
    df = spark.createDataFrame([(0, f"w{i}", int(y[i]), *map(float, x[i])) for i in range(200)], "split_id int, word string, label int, a double, b double, c double")
    scored = models.predict(df, models.fit_per_key(df, ["split_id"], ["a", "b", "c"]), ["split_id"], ["a", "b", "c"])
    assert curves.curve_summary(curves.score_groups(scored, ["split_id"]), ["split_id"]).first()["roc_auc"] > 0.95


def _stack(lines):
    out, open_ = [], {}
    for i, (kind, site, v) in enumerate(lines):
        if kind == "metric":
            open_.setdefault(site, []).append(v)
        elif open_.get(site):
            out.append((site, i, open_[site].pop()))
    return sorted(out)


def test_pairing_equals_a_stack(spark):
    random.seed(2)
    lines = [(random.choice(("metric", "accept")), random.choice("abc"), float(i)) for i in range(1500)]
    text = [("r", i, f"validation metric {-v} from client {s}" if k == "metric" else f"Contribution from {s} ACCEPTED by the aggregator at round 3") for i, (k, s, v) in enumerate(lines)]
    events = trainlog.log_events(spark.createDataFrame(text, "run string, line bigint, text string"))
    assert rows(trainlog.pair_metrics(events), "site", "line", "value") == [(s, i, -v) for s, i, v in _stack(lines)]


def test_best_checkpoint_prefers_the_first(spark):
    df = spark.createDataFrame([("r", 1, 5.0, 9.0), ("r", 2, 3.0, 4.0), ("r", 3, 3.0, 4.0)], "run string, round int, dev_ppl double, test_ppl double")
    r = trainlog.best_checkpoint(df).first()
    assert (r["best_dev_round"], r["best_test_round"], r["final_test"], r["target"]) == (2, 2, 4.0, "FL_global_model_2.pt")


def test_configs_take_the_first_alias(spark):
    deep = '{"a": [' * 60 + '{"bs": 16, "bias": null}' + "]}" * 60
    docs = spark.createDataFrame([("r", "b", '{"lr": 5}'), ("r", "a", '{"z": [{"learning_rate": 0.1}], "c": {"lr": 3}, "rounds": 7}'), ("r", "c", "{bad"), ("r", "d", deep), ("r", "e", None)], "run string, path string, text string")
    assert rows(configs.run_configs(docs), "key", "value") == [("batch_size", "16"), ("bias", "null"), ("lr", "0.1"), ("num_rounds", "7")]


def test_word_lists_and_splits_files(spark, tmp_path):
    (tmp_path / "w.txt").write_text(" Foo bar \n\n b \n")
    path = str(tmp_path / "w.txt")
    assert [rows(files.word_list(spark, path, m), "word") for m in ("line", "token", "lower")] == [[("Foo bar",), ("b",)], [("Foo",), ("b",)], [("b",), ("foo bar",)]]
    (tmp_path / "s.json").write_text('[{"ref": ["a", "b"], "dev": [], "test": ["c"]}]')
    assert rows(files.splits_json(spark, str(tmp_path / "s.json")), "split_id", "part", "pos", "word") == [(0, "ref", 0, "a"), (0, "ref", 1, "b"), (0, "test", 0, "c")]


def test_log_config_and_checkpoint_files(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "runA.log").write_text("Round 1 started\nvalidation metric -0.5 from client s1\nContribution from s1 ACCEPTED by the aggregator at round 1\n")
    lines = files.log_lines(spark, str(tmp_path / "logs"))
    assert rows(trainlog.pair_metrics(trainlog.log_events(lines)), "run", "site", "line", "round", "value") == [("runA", "s1", 2, 1, -0.5)]
    for run, text in (("r1", '{"a": {"lr": 0.1}}'), ("r2", "{bad")):
        (tmp_path / "conf" / run).mkdir(parents=True)
        (tmp_path / "conf" / run / "c.json").write_text(text)
    docs = files.config_docs(spark, str(tmp_path / "conf"))
    assert rows(configs.run_configs(docs), "run", "key", "value") == [("r1", "lr", "0.1")]
    (tmp_path / "p.csv").write_text("model_checkpoint,dev_perplexity,test_perplexity\nFL_global_model_3.pt,1.5,2\nbest_FL_global_model.pt,1,1\nFL_global_model_4.pt,x,2\n")
    assert rows(files.checkpoint_csv(spark, str(tmp_path / "p.csv")), "round", "dev_ppl", "test_ppl") == [(3, 1.5, 2.0)]


def test_knn_lsh_finds_most_neighbours_and_whole_lists(spark):
    """Random directions, where true neighbours are far, and one vector far from all others."""
    rng = np.random.default_rng(8)
    m = rng.normal(size=(400, 64))
    m[0] = -m[1:].sum(0)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    vecs = spark.createDataFrame([(f"w{i:03}", v.tolist()) for i, v in enumerate(m)], "word string, v array<double>")
    exact = set(rows(vectors.knn(vecs, 20), "query", "nword"))
    got = rows(vectors.knn_lsh(vecs, 20), "query", "nword")
    assert len(got) == len(set(got)) == len(exact) == 400 * 20
    assert len(exact & set(got)) >= 0.9 * len(exact)
    few = vecs.limit(5)
    assert rows(vectors.knn_lsh(few, 20), "query", "nword") == rows(vectors.knn(few, 20), "query", "nword")


def test_logs_and_csv_are_not_gathered(spark, tmp_path, monkeypatch):
    """Running minima by ranges equal those of one window; text and CSV files keep the parts of a table."""
    from pyspark.sql import Window

    from glossarion.plans import queries

    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(queries, "CHUNK", 7)
    lines = queries.log_lines(spark, sf)
    e = spark.read.parquet(f"{sf}/events.parquet")
    least = F.min("value").over(Window.partitionBy(F.col("user_id") % 4).orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1))
    best = e.withColumn("b", least).filter("event_type = 'view' and (b is null or value < b)")
    assert lines.count() == e.count()
    assert rows(lines.filter("text like 'new best%'"), "line") == rows(best, "event_id")
    files.write_log(lines, str(tmp_path / "log"))
    place = F.row_number().over(Window.partitionBy("run").orderBy("line")) - 1
    want = lines.withColumn("line", place.cast("bigint"))
    assert rows(files.log_lines(spark, str(tmp_path / "log"), run="folder"), "run", "line", "text") == rows(want, "run", "line", "text")
    files.write_csv(spark.range(10).repartition(3), str(tmp_path / "csv"))
    assert len(list((tmp_path / "csv").glob("*.csv"))) == 3
    assert rows(spark.read.csv(str(tmp_path / "csv"), header=True, inferSchema=True), "id") == [(i,) for i in range(10)]


def test_large_logs_are_read_in_blocks_with_their_line_numbers(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    text = {"a": [f"line {i} " + "x" * (i % 37) for i in range(3000)], "b": ["", "one", ""], "c": ["é" * (i % 5) for i in range(900)]}
    for name, lines in text.items():
        (tmp_path / "logs" / f"{name}.log").write_text("\n".join(lines) + "\n")
    want = sorted((n, i, x) for n, lines in text.items() for i, x in enumerate(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4001")
    try:
        assert spark.read.text(str(tmp_path / "logs")).select("_metadata.file_path", "_metadata.file_block_start").distinct().count() > 10
        assert rows(files.log_lines(spark, str(tmp_path / "logs")), "run", "line", "text") == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_pairs_reach_over_ranges(spark):
    """One busy site, cut into ranges: deep stacks, long runs of acceptances, and lost ones."""
    rng = random.Random(9)
    kinds = ["metric"] * 150 + ["accept"] * 200 + [k for _ in range(60) for k in (["metric"] * rng.randint(0, 9) + ["accept"] * rng.randint(0, 9))]
    lines = [(k, rng.choice("a" * 30 + "b"), float(i)) for i, k in enumerate(kinds)]
    events = spark.createDataFrame([("r", s, i, k, 3, v) for i, (k, s, v) in enumerate(lines)], "run string, site string, line bigint, kind string, round int, value double")
    n = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        assert rows(trainlog.pair_metrics(events.repartition(5)), "site", "line", "value") == _stack(lines)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_settings_keep_the_documents_order_at_any_depth(spark):
    deep = '{"a":' * 50_000 + "1" + "}" * 50_000
    nested = '{"a": [' * 300 + '{"bs": 16, "dropout": 0.1, "bias": null}' + "]}" * 300
    docs = [("r", "1", '{"z": {"lr": "{\\"lr\\": 7}", "x": []}, "a": {"lr": 2}, "e": {}, "n": null, "t": true}'), ("r", "2", deep), ("r", "3", "{bad"), ("r", "4", None), ("r", "5", nested), ("r", "6", '[1, {"lr": 1e-5}, ["s", {"alpha": "[x"}]]'), ("r", "7", "3")]
    df = spark.createDataFrame(docs, "run string, path string, text string")
    got = [(r["path"], r["key"], r["value"]) for r in sorted(configs.leaves(df).collect(), key=lambda r: (r["path"], r["place"]))]
    assert got == [("1", "lr", '{"lr": 7}'), ("1", "lr", "2"), ("1", "n", "null"), ("1", "t", "true"), ("5", "bs", "16"), ("5", "dropout", "0.1"), ("5", "bias", "null"), ("6", "lr", "1.0E-5"), ("6", "alpha", "[x")]
    assert rows(configs.unreadable(df), "path") == [("2",), ("3",), ("7",)]
    assert dict(rows(configs.run_configs(df), "key", "value")) == {"lr": '{"lr": 7}', "batch_size": "16", "lora_dropout": "0.1", "bias": "null", "lora_alpha": "[x"}
    assert configs.leaves(df.limit(0)).count() == 0


def test_settings_are_read_by_pattern_and_put_in_a_table(spark):
    docs = [("1", "/r/1/meta.json", '{"lr": 1, "bias": "m"}'), ("1", "/r/1/a_config.json", '{"lr": 2, "bs": 8}'), ("1", "/r/1/z/config_fed_server.json", '{"lr": 3}'), ("1", "/r/1/other.json", '{"r": 4}'), ("2", "/r/2/x.txt", '{"lr": 9}')]
    df = spark.createDataFrame(docs, "run string, path string, text string")
    found = configs.run_configs(df, patterns=configs.PATTERNS)
    assert rows(found, "run", "key", "value") == [("1", "batch_size", "8"), ("1", "bias", "m"), ("1", "lr", "3")]
    sites = spark.createDataFrame([("1", "a, b", "Model AB"), ("2", "?", "model_2")], "run string, sites string, model string")
    table = configs.config_table(found, sites)
    assert table.columns == ["model_name", "model_num", "sites", *configs.ALIASES]
    assert rows(table, "model_name", "model_num", "sites", "lr", "batch_size", "r") == [("Model AB", 1, "a, b", "3", "8", ""), ("model_2", 2, "?", "", "", "")]


def test_member_features_by_blocks_equal_pairs(spark, monkeypatch):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(70, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    names = [f"w{i:02}" for i in range(70)]
    vecs = spark.createDataFrame([(n, v.tolist()) for n, v in zip(names, x, strict=True)], "word string, v array<double>")
    member = {k: sorted(rng.choice(70, n, replace=False).tolist()) for k, n in ((0, 30), (1, 3), (2, 1))}
    members = spark.createDataFrame([(k, names[i]) for k, at in member.items() for i in at] + [(0, "absent"), (3, "absent"), (1, names[member[1][0]])], "split_id int, word string")
    for targets in (4096, 11):
        monkeypatch.setattr(vectors, "TARGETS", targets)
        for blank in (False, True):
            df = vectors.member_features(vecs, members, ["split_id"], 5, blank)
            sims = np.round(x @ x.T, vectors.DIGITS)
            if blank:
                np.fill_diagonal(sims, -1.0)
            got = {(r["split_id"], r["word"]): (r["mindist_all"], r["avgdist_all"], r["votetopk_all"]) for r in df.collect()}
            assert len(got) == 3 * 70
            for k, at in member.items():
                for i, n in enumerate(names):
                    s = sims[i, at]
                    assert got[k, n] == pytest.approx((s.max(), s.mean(), np.sort(s)[::-1][:5].sum()))
    monkeypatch.setattr(vectors, "TARGETS", 4096)
    plan = vectors.member_features(vecs, members, ["split_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_lowest_passes_on_few_words(spark):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(300, 4)).round(1)
    vecs = spark.createDataFrame([(f"w{i:03}", v.tolist()) for i, v in enumerate(x)], "word string, v array<double>").repartition(3)
    centres = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0], 7), (1, [0.0, 1.0, 0.0, 0.5], 400), (2, [0.0, 0.0, 1.0, 0.0], 0)], "split_id int, c array<double>, m int")
    got = rows(vectors.lowest(vecs, centres, ["split_id"], "m"), "split_id", "csim", "word")
    want = []
    for k, c, m in ((0, [1, 0, 0, 0], 7), (1, [0, 1, 0, 0.5], 400)):
        want += [(k, *t) for t in sorted((float(np.round(v @ np.array(c, float), 10)), f"w{i:03}") for i, v in enumerate(x))[:m]]
    assert got == sorted(want)


def test_samples_by_threshold_equal_sorting(spark, monkeypatch):
    key = lambda *p: hashlib.md5("/".join(map(str, p)).encode()).hexdigest()
    words = [f"w{i}" for i in range(900)]
    df = spark.createDataFrame([(w, i % 3) for i, w in enumerate(words)], "word string, label int")
    got = rows(splits.hashed_sample(df.withColumn("size", F.col("label") * 40), ["label"], F.col("size"), "s", 7), "label", "word")
    want = [(k, w) for k in range(3) for w in sorted((w for i, w in enumerate(words) if i % 3 == k), key=lambda w: key(7, "s", k, w))[: k * 40]]
    assert got == sorted(want)
    cells = spark.createDataFrame([(0, "dev", 5), (1, "dev", 400), (2, "test", 5000), (3, "test", 0)], "split_id int, part string, most bigint")
    for slack in (None, 1e-9):
        if slack:  # thresholds far too low at first: they are doubled
            monkeypatch.setattr(splits.math, "sqrt", lambda x: -x / 6.5)
        sampled = splits.sample_each(df.select("word"), cells, ["part", "split_id"], 7)
        want = [(k, p, w) for k, p, m in ((0, "dev", 5), (1, "dev", 400), (2, "test", 900)) for w in sorted(words, key=lambda w: key(7, p, k, w))[:m]]
        assert rows(sampled, "split_id", "part", "word") == sorted(want)
    monkeypatch.setattr(splits, "CELLS", 2)
    with pytest.raises(ValueError, match="more than 2 cells"):
        splits.sample_each(df.select("word"), cells, ["part", "split_id"])
    cut = splits.make_splits(df, 2, seed=3, strata=["label"])
    for k in range(2):
        for y in range(3):
            order = sorted((w for i, w in enumerate(words) if i % 3 == y), key=lambda w: (key(3, k, w), w))
            want = {"ref": order[:240], "dev": order[240:270], "test": order[270:]}
            for p, some in want.items():
                assert rows(cut.filter(f"split_id = {k} and label = {y} and part = '{p}'"), "word") == sorted((w,) for w in some)


def test_pooled_occurrences_equal_plain_means(spark):
    rng = np.random.default_rng(14)
    tokens = [(f"o{o}", f"W{o % 40}" if o % 2 else f"w{o % 40}", rng.normal(size=3).tolist()) for o in range(300) for _ in range(1 + o % 4)]
    tokens = [tokens[i] for i in rng.permutation(len(tokens))] + [("o1", None, [1.0, 1.0, 1.0]), (None, "w1", [1.0, 1.0, 1.0]), ("o2", "w2", None)]
    df = spark.createDataFrame(tokens, "occurrence string, word string, vector array<double>").repartition(5)
    groups = {}
    for o, w, v in tokens:
        if None not in (o, w, v):
            groups.setdefault(w.lower(), {}).setdefault(o, []).append(v)
    for table in (1 << 15, 3):
        got = {r["word"]: r for r in vectors.pool_occurrences(df, table).collect()}
        assert set(got) == set(groups)
        for w, occurrences in groups.items():
            mean = np.mean([np.mean(v, axis=0) for v in occurrences.values()], axis=0)
            assert got[w]["cnt"] == len(occurrences)
            assert got[w]["vector"] == pytest.approx((mean / np.linalg.norm(mean)).tolist())
    assert vectors.pool_occurrences(df.limit(0)).count() == 0


def test_votes_lie_in_ranges(spark, tmp_path):
    votes = spark.range(4000).select(F.lit("votes").alias("approach"), F.lit("inverse").alias("weight_type"), (F.col("id") % 40).cast("int").alias("n"), F.concat(F.lit("w"), "id").alias("query"), (F.col("id") % 2).cast("int").alias("label"), F.rand(1).alias("score"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files.write_votes(votes, str(tmp_path / "v"), 500)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(list((tmp_path / "v").rglob("*.parquet"))) >= 8
    cell = files.grid_cell(spark, str(tmp_path / "v"), "votes", "inverse", 7)
    assert cell.count() == 100 and spark.read.parquet(str(tmp_path / "v")).filter("n = 7").select("_metadata.file_path").distinct().count() <= 2


def test_knn_cells_finds_most_neighbours_of_few_cells(spark):
    """Where words lie in groups few cells are compared; alone and equal words have their lists too."""
    rng = np.random.default_rng(15)
    m = rng.normal(size=(30, 12))[rng.integers(0, 30, 600)] + 0.3 * rng.normal(size=(600, 12))
    m[5] = m[6]
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    vecs = spark.createDataFrame([(f"w{i:03}", v.tolist()) for i, v in enumerate(m)], "word string, v array<double>")
    exact = set(rows(vectors.knn(vecs, 10), "query", "nword"))
    found, compared = vectors.knn_cells(vecs, 10, asked=60)
    got = rows(found, "query", "nword")
    assert len(got) == len(set(got)) and len(exact & set(got)) >= 0.9 * len(exact)
    pairs = sum(r["words"] * r["queries"] for r in compared.collect())
    assert pairs < 0.5 * 600 * 600
    whole, _ = vectors.knn_cells(vecs, 10, recall=1.0, asked=600)
    assert rows(whole, "query", "rank", "nword") == rows(vectors.knn(vecs, 10), "query", "rank", "nword")
    assert vectors.knn_cells(vecs.limit(1), 10)[0].count() == 0


def most_broadcast(spark, df):
    """The largest number of rows that a run of df broadcasts."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    df.write.format("noop").mode("overwrite").save()
    most = 0
    for e in range(before, store.executionsCount()):
        run = store.executionsList().apply(e).executionId()
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in map(nodes.apply, range(nodes.size())):
            if node.name() == "BroadcastExchange":
                for m in map(node.metrics().apply, range(node.metrics().size())):
                    if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        most = max(most, int(values.get(m.accumulatorId()).get().replace(",", "")))
    return most


def test_splits_broadcast_keys_and_no_rows(spark):
    words = spark.range(2000).selectExpr("concat('w', id) word", "cast(id % 4 = 0 as int) label")
    sp = splits.make_splits(words, 20, strata=["label"], neg_ratio=2.0)
    assert most_broadcast(spark, sp) <= 40  # a row for each split and label
    got = {}
    for r in sp.collect():
        got.setdefault((r["split_id"], r["label"], r["part"]), set()).add(r["word"])
    key = lambda s, w: (hashlib.md5(f"42/{s}/{w}".encode()).hexdigest(), w)
    for s in range(20):
        for label, n in ((1, 500), (0, 1000)):
            order = sorted((f"w{i}" for i in range(2000) if (i % 4 == 0) == bool(label)), key=lambda w: key(s, w))[:n]
            a, b = int(n * 0.8), int(n * 0.8) + int(n * 0.1)
            assert [got[s, label, p] for p in ("ref", "dev", "test")] == [set(order[:a]), set(order[a:b]), set(order[b:])]


def test_hashed_sample_of_small_none_and_large_sizes(spark):
    df = spark.range(300).selectExpr("id % 3 g", "concat('w', id) word", "case id % 3 when 0 then 0 when 1 then 7 else 1000 end size")
    got = splits.hashed_sample(df, ["g"], F.col("size"), "s")
    assert most_broadcast(spark, got) <= 3
    first = sorted((f"w{i}" for i in range(1, 300, 3)), key=lambda w: (hashlib.md5(f"42/s/1/{w}".encode()).hexdigest(), w))[:7]
    assert sorted(r["word"] for r in got.collect()) == sorted([*first, *(f"w{i}" for i in range(2, 300, 3))])


@pytest.mark.parametrize("targets", [2, 4096])
def test_lexical_similarity_reduces_pairs_in_tasks(spark, monkeypatch, targets):
    monkeypatch.setattr(lexical, "TARGETS", targets)
    names = ["river", "rivers", "deliver", "stone", "stones", "zq", "tone", "live wire"]
    members = {"a": ["river", "stone"], "b": ["tone", "rivers", "absent"], "c": ["zq"], None: ["zq"]}
    words = spark.createDataFrame([(n,) for n in names], "word string")
    got = lexical.lexical_similarity(words, spark.createDataFrame([(k, w) for k, ws in members.items() for w in ws], "key string, word string"), ["key"])
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    grams = {w: Counter(f" {p} "[i : i + n] for p in w.split() for n in (2, 3, 4) for i in range(len(p) + 3 - n)) for w in {*names, "absent"}}
    df = Counter(g for n in names for g in grams[n])
    weight = {w: {g: c * (math.log((1 + len(names)) / (1 + df[g])) + 1) for g, c in gs.items() if g in df} for w, gs in grams.items()}
    unit = {w: {g: x / math.sqrt(sum(y * y for y in gs.values())) for g, x in gs.items()} for w, gs in weight.items()}
    want = {(k, n): max(sum(x * unit[m].get(g, 0) for g, x in unit[n].items()) for m in ms) for k, ms in members.items() for n in names}
    assert {(r["key"], r["word"]): r["lexical"] for r in got.collect()} == {k: pytest.approx(v, abs=1e-9) for k, v in want.items() if v > 0}


def test_many_small_files_are_written_by_several_tasks(spark, tmp_path):
    docs = spark.range(60).selectExpr("concat('u', id) as run", "concat('{\"lr\": ', id, '}') as value")
    files.write_config_docs(docs, f"{tmp_path}/docs")
    names = [p.name for p in (tmp_path / "docs").glob("run=*/part-*.txt")]
    assert len(names) == 60 and len({n.split("-")[1] for n in names}) > 4  # one file a document; one task wrote them all before
    found = configs.run_configs(files.config_docs(spark, f"{tmp_path}/docs", "*.txt"))
    assert {(r["run"], r["key"], r["value"]) for r in found.collect()} == {(f"run=u{i}", "lr", str(i)) for i in range(60)}


def test_units_are_few_and_ties_are_told_by_word(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 8))
    x[350:] = x[:350]  # every word has a twin at the same place
    df = vectors.unit_vectors(spark.createDataFrame([(f"w{i}", v.tolist()) for i, v in enumerate(x)], "word string, vector array<double>"))
    v = {r["word"]: np.array(r["v"]) for r in df.collect()}
    names = sorted(v)
    sims = np.round(np.array([v[w] for w in names]) @ np.array([v[w] for w in names]).T, vectors.DIGITS)
    want = sorted((w, r + 1, names[j]) for i, w in enumerate(names) for r, j in enumerate(sorted((j for j in range(700) if j != i), key=lambda j: (-sims[i, j], names[j]))[:7]))
    assert rows(vectors.knn(df, 7), "query", "rank", "nword") == want
    found, compared = vectors.knn_cells(df, 7, recall=1.0, asked=700)
    assert rows(found, "query", "rank", "nword") == want
    # a unit was a cell before, so that a word was copied to as many units as it asked for cells
    moved = found._jdf.queryExecution().optimizedPlan().toString()
    assert moved.count("cells") and "xs" not in moved and compared.count() > 1


def test_ref_pools_join_no_rows_of_words_and_cells(spark):
    words = [f"w{i}" for i in range(30)]
    parts = {(s, w): p for s in range(3) for i, w in enumerate(words[:20]) for p in [("ref", "dev", "test")[(i + s) % 3]] if (i + s) % 7}
    df = spark.createDataFrame([(s, p, w) for (s, w), p in parts.items()], "split_id int, part string, word string")
    stop, vocabulary = spark.createDataFrame([("w3",), ("w25",)], "word string"), spark.createDataFrame([(w,) for w in words], "word string")
    got = pipelines.pools(df, vocabulary, stop, background="ref")
    want = [(s, p, w, 1) for (s, w), p in parts.items() if p != "ref"]
    want += [(s, p, w, 0) for s in range(3) for p in ("dev", "test") for w in words if w not in ("w3", "w25") and parts.get((s, w)) not in ("ref", p)]
    assert rows(got, "split_id", "part", "word", "label") == sorted(want)
    # the anti join of every word in each cell sorted as many rows as that
    assert not any("LeftAnti" in x and "part" in x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines())


@pytest.mark.parametrize("first", [1, 12, 64])
def test_member_features_of_large_and_small_keys(spark, monkeypatch, first):
    monkeypatch.setattr(vectors, "FIRST", first, raising=True)
    rng = np.random.default_rng(5)
    x = {f"w{i:03}": v / np.linalg.norm(v) for i, v in enumerate(rng.normal(size=(220, 6)))}
    x["w001"] = x["w000"]  # equal similarities
    names = sorted(x)
    members = {0: names[:200], 1: names[:180], 2: names[100:104], 3: names[:2], 4: names[20:200]}
    vecs = spark.createDataFrame([(w, v.tolist()) for w, v in x.items()], "word string, v array<double>")
    df = spark.createDataFrame([(s, w) for s, ws in members.items() for w in ws], "split_id int, word string")
    got = {(r["split_id"], r["word"]): r for r in vectors.member_features(vecs, df, ["split_id"], 5).collect()}
    assert len(got) == 5 * 220
    for (s, w), r in got.items():
        sims = sorted((round(float(x[w] @ x[m]), 10) for m in members[s]), reverse=True)
        assert (r["mindist_all"], r["avgdist_all"], r["votetopk_all"]) == pytest.approx((sims[0], sum(sims) / len(sims), sum(sims[:5])), abs=1e-9)


def test_large_members_are_reduced_in_units(spark, monkeypatch):
    """More members than go to every task: units of words meet them in blocks, and no row of a key and word is merged after that."""
    from glossarion.operators import units

    rng = np.random.default_rng(8)
    x = {f"w{i:03}": v / np.linalg.norm(v) for i, v in enumerate(rng.normal(size=(600, 5)))}
    names = sorted(x)
    members = {s: sorted(rng.choice(names, n, replace=False).tolist()) for s, n in ((0, 480), (1, 400), (2, 3), (3, 30))}
    vecs = files.written(spark.createDataFrame([(w, v.tolist()) for w, v in x.items()], "word string, v array<double>"))
    df = spark.createDataFrame([(s, w) for s, ws in members.items() for w in ws], "split_id int, word string")
    monkeypatch.setattr(vectors, "TARGETS", 40)
    monkeypatch.setattr(units, "BLOCK", 64)
    monkeypatch.setattr(units, "HELD", 256 * 24)
    for blank in (False, True):
        found = vectors.member_features(vecs, df, ["split_id"], 5, blank)
        assert "Aggregate" not in plan_of(found) and plan_of(found).count("Exchange") <= 3  # the members' vectors, and the units
        got = {(r["split_id"], r["word"]): r for r in found.collect()}
        assert len(got) == 4 * 600
        for (s, w), r in got.items():
            sims = sorted((-1.0 if blank and m == w else round(float(x[w] @ x[m]), 10) for m in members[s]), reverse=True)
            assert (r["mindist_all"], r["avgdist_all"], r["votetopk_all"]) == pytest.approx((sims[0], sum(sims) / len(sims), sum(sims[:5])), abs=1e-9)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_units_of_few_keys_are_bounded(spark, monkeypatch):
    """One key holds few numbers for each word, and yet a unit takes no more than its share of the words."""
    from glossarion.operators import units

    monkeypatch.setattr(vectors, "TARGETS", 4)
    monkeypatch.setattr(units, "WORDS", 256)
    vecs = files.written(spark.range(6000).selectExpr("concat('w', id) word", "array(cast(cos(id) as double), cast(sin(id) as double)) v"))
    found = vectors.member_features(vecs, vecs.filter("word like 'w1%5'").selectExpr("0 split_id", "word"), ["split_id"], 3)
    assert found.rdd.getNumPartitions() >= 6000 // 256
    assert found.count() == 6000


def test_features_join_no_rows_of_splits_and_words(spark, monkeypatch):
    """What the operators have for each split and word comes out in one row, for few and for many members; splits without a centroid have none."""
    import re

    rng = np.random.default_rng(21)
    names = [f"w{i:03}" for i in range(90)]
    vecs = files.written(vectors.unit_vectors(spark.createDataFrame([(n, v.tolist()) for n, v in zip(names, rng.normal(size=(90, 5)), strict=True)], "word string, vector array<double>")))
    parts = [(s, "ref", n) for s in range(3) for n in rng.choice(names, 30, replace=False).tolist()] + [(0, "ref", "w0x"), (4, "ref", "w1x"), (0, "test", "w001")]
    sp = files.written(spark.createDataFrame(parts, "split_id int, part string, word string"))
    nbr, ref, key = files.written(vectors.knn(vecs, 6)), sp.filter("part = 'ref'").select("split_id", "word"), ["split_id"]
    pairs = [
        vectors.centroid_similarity(vecs, vectors.centroids(vecs, ref, key), key).withColumnRenamed("csim", "centroid"),
        neighbours.graph_features(nbr, ref, key).withColumnRenamed("query", "word"),
        vectors.member_features(vecs, ref, key),
        lexical.lexical_similarity(vecs.select("word"), ref, key),
    ]
    want = pairs[0]
    for df in pairs[1:]:
        want = want.join(df, ["split_id", "word"], "left")
    want = {(r["split_id"], r["word"]): [r[c] or 0.0 for c in pipelines.FEATURES] for r in want.collect()}
    assert len(want) == 3 * 90
    for targets in (4096, 20):
        monkeypatch.setattr(vectors, "TARGETS", targets)
        found = pipelines.features(vecs, nbr, sp)
        assert not re.search(r"Join \[split_id#\d+, word#\d+\]", plan_of(found))
        assert {(r["split_id"], r["word"]): [r[c] for c in pipelines.FEATURES] for r in found.collect()} == {k: pytest.approx(v, abs=2e-10) for k, v in want.items()}


def test_samples_are_told_by_their_last_rows(spark):
    """What is among the first of a key is what sorting finds, with ties, infinite values and NaN, and for sizes of none and of all."""
    rng = np.random.default_rng(4)
    values = [*rng.normal(size=150).round(1).tolist(), float("inf"), float("-inf"), float("nan"), float("nan"), 0.0, -0.0]
    data = [(k, f"w{i:03}", float(v)) for k in range(5) for i, v in enumerate(values)] + [(5, f"w{i}", 1.5) for i in range(9)] + [(6, "w0", float("nan"))]
    df = spark.createDataFrame(data, "split_id int, word string, score double")
    most = {0: 0, 1: 1, 2: 70, 3: len(values) - 2, 4: 1000, 5: 4, 6: 1}
    sizes = spark.createDataFrame(list(most.items()), "split_id int, most int")
    ranged, bucket = splits.value_buckets(df, ["split_id"], "score")
    ends = splits.lasts(ranged, ["split_id"], sizes, "score", bucket)
    got = df.join(ends, "split_id", "left").filter(splits.among_first(F.col("score"), F.col("word")))
    order = lambda r: (math.isnan(r[2]), 0.0 if math.isnan(r[2]) else r[2], r[1])
    want = [r[:2] for k, n in most.items() for r in sorted((r for r in data if r[0] == k), key=order)[:n]]
    assert rows(got, "split_id", "word") == sorted(want)


def test_training_rows_move_no_background(spark, monkeypatch):
    feats = files.written(spark.range(600).selectExpr("cast(id % 3 as int) split_id", "concat('w', id div 3) word", "cast(id * 37 % 101 as double) centroid", "cast(id as double) vote"))
    parts = [(s, p, f"w{i}") for s in range(3) for p, some in (("ref", range(8)), ("test", range(8, 12))) for i in some]
    sp, stop = spark.createDataFrame(parts, "split_id int, part string, word string"), spark.createDataFrame([("w199",)], "word string")
    kept = []
    monkeypatch.setattr(pipelines, "written", lambda df: kept.append(df.count()) or files.written(df))
    found = pipelines.training_rows(feats, sp, stop, 2)
    assert max(kept) <= 13  # words that are no background, and a row for each split; the 561 rows of the background were written before
    assert "Window" not in plan_of(found)
    assert rows(found.groupBy("split_id", "clf", "label").count(), "split_id", "clf", "label", "count") == [(s, c, y, n) for s in range(3) for c in ("pu_lr", "pu_rn") for y, n in ((0, 16), (1, 8))]


def test_gaps_move_no_training_rows(spark):
    training = spark.range(3_000_000).selectExpr("cast(id % 2 as int) k", "cast(id % 3 = 0 as int) label", "cast(id % 7 as double) a")
    given = spark.createDataFrame([(k, [0.0], 0.0, [0.0], [1.0]) for k in (0, 1)], "k int, weights array<double>, intercept double, means array<double>, deviations array<double>")
    found = models.fit_gaps(training, given, ["k"], ["a"])
    assert "SortMergeJoin" not in plan_of(found)
    assert rows(found, "k", "positives", "negatives") == [(0, 500_000, 1_000_000), (1, 500_000, 1_000_000)]


@pytest.mark.parametrize("parts", [1, 3])
def test_wide_metrics_equal_long_ones(spark, parts):
    """Ties in scores and at k, NaN, infinite and null scores, keys without one of the classes; each row is moved once."""
    rng = np.random.default_rng(6)
    names = ("flat", "few", "many")
    data = []
    for key in (0, 1, None):
        for i in range(400):
            odd = {7: None, 8: float("nan"), 9: float("inf"), 10: float("-inf"), 11: -0.0}.get(i % 40, float(rng.normal()))
            data.append((key, f"w{i:03}", int(rng.random() < 0.2), 0.5, float(rng.integers(4)), odd))
    data += [(2, f"w{i:03}", 0, float(i), 1.0, 2.0) for i in range(30)] + [(3, "w000", 1, 1.0, 1.0, 1.0)]
    df = files.written(spark.createDataFrame(data, "split_id int, word string, label int, flat double, few double, many double"))
    md5 = splits.hash_order(F.lit("ties"), "split_id", "word")
    long, by = df.unpivot(["split_id", "word", "label"], list(names), "method", "score"), ["split_id", "method"]
    points = curves.curve_summary(curves.score_groups(long, by), by).select(*by, "roc_auc", "average_precision")
    ranks = curves.rank_metrics(long, by, (5, 60), ties=(md5, "word")).select(*by, "k", "precision", "recall", "specificity", "f1")
    found = curves.wide_metrics(df, ["split_id"], names, (5, 60), F.unhex(md5), parts)
    order = lambda rs: {(r["split_id"], r["method"], r["k"]): tuple(r)[2:] for r in rs}
    want = order(points.join(ranks, by).select(*by, "k", "roc_auc", "average_precision", "precision", "recall", "specificity", "f1").collect())
    got = order(found.select("split_id", "method", "k", "roc_auc", "average_precision", "precision", "recall", "specificity", "f1").collect())
    assert set(got) == set(want) and len(want) == 4 * 3 * 2
    for k, v in want.items():
        assert got[k] == (k[2], *(x if x is None else pytest.approx(x, abs=1e-12) for x in v[1:])), k


def test_centroids_do_not_broadcast_members(spark):
    vecs = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 0.0])], "word string, v array<double>")
    members = spark.createDataFrame([(0, "a"), (0, "c"), (1, "b"), (1, "x"), (2, "x")], "split_id int, word string")
    found = vectors.centroids(files.written(vecs), files.written(members), ["split_id"])
    assert "Broadcast" not in plan_of(found)
    assert rows(found, "split_id", "c") == [(0, [1.0, 0.0]), (1, [0.0, 1.0])]


def small_splits(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    vecs = spark.createDataFrame([(w, [rng.gauss(0, 1) for _ in range(4)]) for w in words], "word string, v array<double>")
    parts = [(s, p, w) for s in range(3) for p, some in (("ref", words[:8]), ("dev", words[8:9]), ("test", words[9:10])) for w in some] + [(2, "test", "unknown"), (3, "ref", "w0"), (3, "test", "unknown")]
    return vecs, spark.createDataFrame(parts, "split_id int, part string, word string"), spark.createDataFrame([("w59",)], "word string")


def test_split_counts_meet_the_words_once(spark, monkeypatch):
    vecs, parts, stop = small_splits(spark)
    plans = []
    monkeypatch.setattr(pipelines, "written", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or files.written(df))
    out, _ = pipelines.split_counts(vecs, parts, stop, (5,), neg_ratio=2)
    assert max(p.count("LeftSemi") for p in plans) == 1
    assert rows(out, "split_id", "ref_usable", "test_pos", "test") == [(0, 8, 1, 1), (1, 8, 1, 1), (2, 8, 1, 2)]


def test_scores_of_splits_are_not_broadcast(spark):
    import re

    vecs, parts, stop = small_splits(spark)
    found = pipelines.centroid_evaluate(files.written(vecs), files.written(parts), stop, ks=(5,))
    assert not re.search(r"BroadcastHashJoin \[split_id#\d+, word#\d+\]", plan_of(found))
    assert rows(found, "split_id", "pos", "neg") == [(0, 1, 49), (1, 1, 49), (2, 1, 49)]


def test_knn_tells_what_single_precision_cannot(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 16))
    x[150:] = x[:150] + 1e-8 * rng.normal(size=(150, 16))  # products that are equal in single precision and not in double
    df = vectors.unit_vectors(spark.createDataFrame([(f"w{i}", v.tolist()) for i, v in enumerate(x)], "word string, vector array<double>"))
    v = {r["word"]: np.array(r["v"]) for r in df.collect()}
    names = sorted(v)
    sims = np.round(np.array([v[w] for w in names]) @ np.array([v[w] for w in names]).T, vectors.DIGITS)
    want = sorted((w, r + 1, names[j]) for i, w in enumerate(names) for r, j in enumerate(sorted((j for j in range(300) if j != i), key=lambda j: (-sims[i, j], names[j]))[:9]))
    assert rows(vectors.knn(df, 9), "query", "rank", "nword") == want
    mask = rng.random((7, 13)) < 0.1
    assert vectors._set(mask).tolist() == np.flatnonzero(mask).tolist()


def test_spans_have_the_curves_of_their_rows(spark):
    rng = np.random.default_rng(9)
    data = [(k, "a" if k % 2 else "b", lo, lo + int(rng.integers(0, 4)), float(rng.integers(-3, 6)) / 2, int(rng.random() < 0.3)) for k in range(4) for lo in rng.integers(1, 8, 40).tolist()]
    spans = spark.createDataFrame(data, "k int, w string, low int, high int, score double, label int")
    totals = spark.createDataFrame([(k, "a" if k % 2 else "b", 40, 60 if k else 0) for k in range(5)], "k int, w string, pos bigint, neg bigint")
    each = spans.select("k", "w", F.explode(F.sequence("low", "high")).alias("n"), "score", "label")
    grid = totals.crossJoin(spark.range(1, 12).select(F.col("id").cast("int").alias("n")))
    want = curves.curve_summary(curves.with_default(curves.score_groups(each, ["k", "w", "n"]), grid, ["k", "w", "n"], -2.0), ["k", "w", "n"]).filter("k > 0")
    got = curves.span_summary(spans.repartition(3), totals, ["k", "w"], range(1, 12), -2.0)
    columns = ("k", "w", "n", "roc_auc", "ba_threshold", "f1_threshold")
    assert rows(got.filter("k > 0"), *columns) == [tuple(pytest.approx(x) if isinstance(x, float) else x for x in r) for r in rows(want, *columns)]
    assert got.count() == 55 and got.filter("k = 0 and roc_auc is not null").isEmpty()
    # a row for each n was moved and sorted before
    assert "sequence" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_settings_are_read_once_a_text(spark):
    docs = spark.createDataFrame([("r", "a", '{"lr": 1, "x": [2, {"bs": "3"}], "n": null}'), ("r", "b", "{broken"), ("s", "c", '[{"lr": 0.50}, 7]')], "run string, path string, text string")
    level = configs._entries(docs.withColumn("place", F.array().cast("array<int>")))
    got = rows(level.withColumn("at", F.element_at("place", -1)), "run", "at", "key", "value", "nested")
    assert sorted(got, key=str) == sorted([("r", 0, "lr", "1", False), ("r", 1, "x", '[2,{"bs":"3"}]', True), ("r", 2, "n", "null", False), ("s", 0, None, '{"lr":0.5}', True), ("s", 1, None, "7", False)], key=str)
    # six times before
    assert level._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 4
