"""Models against plain, exhaustive or independent versions; odd tables for every operator and stage."""

import itertools
import math
import random
import re
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import TEXTS, brute_measures

import corpus_pipeline
from glossarion.llm import bpe, lattice, neardup, packing, pii, quality, queries, simhash, topk, toxicity, urls, warc
from glossarion.llm.queries import tokenizer_path

#: Sentences that the field has not seen; [kind text] is a span.
HELD_OUT = """
please ring [phone (617) 555-0134] after lunch
my cell is [phone 718-555-0119], thanks
the clinic, [phone 020 7946 0321], opens at 8
or phone [phone 503.555.0145] before 17:00
contact [phone (0117) 496 0777] for tickets
send comments to [email maria.s(at)letters.example.com] soon
[email office[at]guild.example.org] has the 12 forms
mail [email tom(at)example.net] or [email ann@example.net] today
debit my card [card 378734493671000] please
the number [card 3056 930902 5904] was printed twice
their router [ip 2001:db8:beef::10] restarted
ping [ip fe80::2] failed 3 times
on 14 March 2019 the shop sold 1,250 loaves
chapter 7.2 covers pages 88-104
flight KL1025 leaves gate D7 at 06:40
the ratio rose from 0.35 to 0.42 in 2021
part no 88-1204-55 is out of stock
call [phone +49 30 901820] or [phone 030 555 0199]
""".strip().splitlines()


def test_field_on_held_out_sentences():
    """Precision and recall of all spans, and of the fixed patterns' alone."""
    model, hits, wrong, missed, plain = pii.field(), 0, 0, 0, 0
    seen = {" ".join(w) for w, _ in pii.labelled()}
    for line in HELD_OUT:
        text, want, at = "", set(), 0
        for m in re.finditer(r"\[(email|ip|card|phone) ((?:[^\[\]]|\[at\])+)\]", line):
            text += line[at : m.start()]
            want.add((pii.KINDS.index(m[1]), len(text), len(text) + len(m[2])))
            text += m[2]
            at = m.end()
        text += line[at:]
        assert text not in seen
        spans = pii.find_spans([text], model)[0]
        got = {s[:3] for s in spans}
        hits, wrong, missed = hits + len(got & want), wrong + len(got - want), missed + len(want - got)
        plain += len({s[:3] for s in spans if s[3]} & want)
    assert hits / (hits + wrong) >= 0.9 and hits / (hits + missed) >= 0.9
    assert plain <= 3  # what the fixed patterns find by themselves


def test_field_viterbi_and_training_against_all_paths():
    model, rng, k = pii.field(), random.Random(2), len(pii.LABELS)
    words = [w for ws, _ in pii.labelled() for w in ws] + ["555-0100", "x@y", "(at)"]
    windows = [[rng.choice(words) for _ in range(n)] for n in (1, 2, 3, 4, 1, 4)]
    emit, n = model.scores(windows)

    def value(i, path):
        return model.first[path[0]] + sum(emit[i, t, y] for t, y in enumerate(path)) + sum(model.move[a, b] for a, b in zip(path, path[1:], strict=False))

    for i, got in enumerate(model.decode(windows)):
        best = max(value(i, p) for p in itertools.product(range(k), repeat=n[i]))
        assert value(i, got.tolist()) == pytest.approx(best)
    # at the optimum the features' expected counts equal the true ones less the L2 term; expectations by all paths
    rows = [(["call", "555-0100"], [0, 7]), (["ask", "me"], [0, 0]), (["1", "2"], [0, 0])]
    small = pii.train_field(rows, l2=0.5, rounds=2000)
    for (feature, role), at in list(small.index.items())[::5]:
        gap = np.zeros(k)
        for ws, ys in rows:
            e, _ = small.scores([ws])
            score = {p: small.first[p[0]] + e[0, 0, p[0]] + e[0, 1, p[1]] + small.move[p[0], p[1]] for p in itertools.product(range(k), repeat=2)}
            z = sum(math.exp(v) for v in score.values())
            for t in range(2):
                j = t + {"word": 0, "before": -1, "after": 1}[role]
                if 0 <= j < 2:
                    times = pii.shape_features(ws[j]).count(feature)
                    gap[ys[t]] += times
                    for p, v in score.items():
                        gap[p[t]] -= times * math.exp(v) / z
        assert np.abs(gap - 0.5 * small.emit[at]).max() < 0.02


def test_name_segmentation_against_all_cuts():
    rng = random.Random(4)
    for _ in range(300):
        name = "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
        spans = [(a, b) for a in range(len(name)) for b in range(a + 1, len(name) + 1)]
        known = {s: rng.randint(1, 50) for s in rng.sample(spans, rng.randint(0, min(8, len(spans))))}
        total = 500

        def cost(words):
            at, c = 0, 0.0
            for w in words:
                n = known.get((at, at + len(w)))
                c += math.log(total / n) if n else math.log(total) + len(w) * math.log(10)
                at += len(w)
            return c

        cuts = [[name[a:b] for a, b in zip((0, *c), (*c, len(name)), strict=True)] for r in range(len(name)) for c in itertools.combinations(range(1, len(name)), r)]
        got = urls.viterbi(name, lambda end, known=known: [(a, n) for (a, b), n in known.items() if b == end], total)
        assert "".join(got) == name and cost(got) == pytest.approx(min(map(cost, cuts)))


def test_naive_bayes_and_the_whole_query_against_plain_python(spark):
    folder = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{folder}/pages.parquet").collect()
    rules = [(r.verdict, r.rule) for r in queries.URL_RULES]
    words = Counter(w for p in pages for w in re.findall("[a-z]+", re.sub("<[^>]*>", " ", p["html"] or "").lower()) if len(w) >= 2)
    total = sum(words.values()) + 1
    parsed = {}
    for p in pages:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", p["url"] or "")
        host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
        fits = [(len(r), v, r) for v, r in rules if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
        _, verdict, rule = max(fits, key=lambda f: f[0]) if fits else (0, None, None)
        tokens = []
        for part in re.findall(r"[a-z]+|[^a-z.\-_]+", host):
            if part.isascii() and part[0].isalpha():
                known = lambda end, part=part: [(a, words[part[a:end]]) for a in range(end - 1) if words[part[a:end]]]
                tokens += ["h:" + w for w in urls.viterbi(part, known, total)]
            else:
                tokens.append("h:" + part)
        parsed[p["page_id"]] = host, path, rule, verdict, tokens + ["p:" + x for x in re.findall(r"[^\W_]+", path.lower())]
    bucket = lambda t: __import__("zlib").crc32(t.encode()) % urls.BUCKETS
    count = {v: Counter(bucket(t) for *_, verdict, ts in parsed.values() if verdict == v for t in ts) for v in ("block", "allow")}
    size = {v: sum(c.values()) + urls.BUCKETS for v, c in count.items()}
    prior = math.log((sum(p[3] == "block" for p in parsed.values()) + 1) / (sum(p[3] == "allow" for p in parsed.values()) + 1))
    score = lambda ts: prior + sum(math.log((count["block"][bucket(t)] + 1) / size["block"]) - math.log((count["allow"][bucket(t)] + 1) / size["allow"]) for t in ts)
    got = {r["page_id"]: r for r in queries.op3_url_filter(spark, folder).collect()}
    assert len(got) == len(pages)
    for i, (host, path, rule, verdict, tokens) in parsed.items():
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["score"] == pytest.approx(score(tokens))
        assert got[i]["verdict"] == (verdict or ("block" if score(tokens) > 0 else "allow"))


def test_pii_query_against_plain_search(spark):
    import hashlib

    from test_llm import PATTERNS

    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in queries.op4_pii(spark, folder).collect():
        t = texts[r["doc_id"]]
        base = [(k, *m.span()) for k, (p, ok) in enumerate(PATTERNS) for m in re.finditer(p, t) if ok(m[0], re.sub("[^0-9]", "", m[0]))]
        joined = [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in sorted(base)]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == i for s in base) for i in range(4)]
        assert r["base_sha256"] == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert set(joined) <= set(r["spans"].split(",")) or not joined


def test_held_out_columns_and_scores(spark):
    import zlib

    folder = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rest = lambda i, n: zlib.crc32(str(i).encode()) % n
    lm = {r["doc_id"]: r for r in queries.op9_lattice_lm(spark, folder).collect()}
    assert all(r["held_out"] == (rest(i, 10) == 0) for i, r in lm.items()) and len(lm) == len(docs)
    model = lattice.lattice(tokenizer_path("piece_bpe_32k.model"))
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t.translate(low)) for i, t in docs.items()}
    train = [i for i in docs if rest(i, 10) != 0]
    end = len(train) / sum(len(words[i]) + 1 for i in train)
    for i in list(docs)[::7]:
        want = sum(model.log10(w) + math.log10(1 - end) for w in words[i]) + math.log10(end)
        assert lm[i]["score"] == pytest.approx(want, rel=1e-9)
    tox = {r["doc_id"]: r for r in queries.op10_toxicity(spark, folder).collect()}
    assert all(r["held_out"] == (rest(i, 3) == 1) and r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for i, r in tox.items()) and len(tox) == len(docs)


ODD = [*TEXTS, "long " * 60_000, "x" * 200_000, "call (415) 555-0132 or a@b.co " * 3000]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns whose names the operators use."""
    names = "lang string, source string, n_chars bigint, ids string, score double, spans string, fp bigint, th bigint, n bigint, key bigint, _t int, _w int, _doc int, _id int, n_words int, kept boolean, rule string"
    rows = [(i, t, *[None] * 17) for i, t in enumerate(ODD)] + [(3, ODD[3], *[None] * 17)] * 3 + [(None, None, *[None] * 17), (None, ODD[3], *[None] * 17)]
    return spark.createDataFrame(rows, f"doc_id bigint, text string, {names}")


def test_operators_on_odd_tables(spark, odd):
    n, path = odd.count(), tokenizer_path()
    empty = odd.limit(0)
    labels = spark.createDataFrame([(0, 0), (3, 1), (4, 0), (None, 1), (5, None)], "doc_id bigint, toxic int")
    model = toxicity.train(odd, labels)
    pages = lambda d: d.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), F.col("text").alias("html"), "score", "rule", "key")
    rows = {
        "bpe": lambda d: bpe.token_counts(d, path),
        "ledger": quality.ledger,
        "urls": lambda d: urls.judge(pages(d), queries.URL_RULES),
        "pii": pii.detect,
        "redact": pii.redact,
        "simhash": simhash.components,
        "neardup": neardup.components,
        "lattice": lambda d: lattice.score(d, tokenizer_path("piece_bpe_32k.model")),
        "toxicity": lambda d: toxicity.score(d, model),
    }
    for name, f in rows.items():
        assert f(odd).count() == n, name
        assert f(empty).count() == 0, name
    book = quality.ledger(odd)
    assert {r["doc_id"]: tuple(r[m] for m in quality.MEASURES) for r in book.collect() if r["doc_id"] is not None} == {i: brute_measures(t) for i, t in enumerate(ODD)}
    assert [c for c in book.columns if c not in (*quality.MEASURES, "failure_bits")] == [c for c in odd.columns if c != "n_words"]
    assert {c: book.filter(F.col(c).isNotNull()).count() for c in ("_t", "_w", "_doc", "_id")} == dict.fromkeys(("_t", "_w", "_doc", "_id"), 0)
    for f in (simhash.keep_one, neardup.keep_one, lambda d: quality.keep(d, quality.BASE)):
        assert f(odd).columns == odd.columns and f(empty).count() == 0
    lengths = bpe.token_counts(odd, path)
    packed = packing.best_fit(lengths, "n_tokens")
    assert packed.agg(F.sum("length")).first()[0] == lengths.agg(F.sum("n_tokens")).first()[0]
    assert topk.search(topk.integer_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>")), "true").count() == 0


def test_simhash_keeps_unlike_texts_of_one_id_and_takes_string_ids(spark):
    rng = random.Random(3)
    text = lambda: " ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 5) for _ in range(80))
    a, b, c = text(), text(), text()
    df = spark.createDataFrame([("1", a), ("1", b), ("2", a), ("3", c), ("3", c), (None, a)], "doc_id string, text string")
    got = sorted((r["doc_id"] or "", r["text"]) for r in simhash.keep_one(df).collect())
    assert got == sorted([("1", a), ("1", b), ("3", c), ("", a)])
    assert {(r["doc_id"], r["component_id"]) for r in simhash.components(df).collect()} == {("1", "1"), ("2", "1"), ("3", "3"), (None, "1")}


def plain_near_copies(rows):
    """Ids left of rows (id, text): the least of each group linked at a five-word Jaccard of 0.8 or more."""
    sets = []
    for _, t in rows:
        w = (t or "").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})).split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if group[i] != group[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            a, b = sorted((group[i], group[j]))
            group = [a if g == b else g for g in group]
    return {min(rows[i][0] for i in range(len(rows)) if group[i] == g) for g in set(group)}


def test_pipeline_against_plain_python(spark):
    """run() on the smallest tables: each stage's rows from the operators' plain versions."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    left = [(r["doc_id"], r["text"]) for r in docs.collect()]
    left = [(i, t) for i, t in left if model.score(toxicity.words_of(t or ""), {}) < corpus_pipeline.TOXIC]
    assert 0 < len(left) < docs.count()

    def good(t):
        m = dict(zip(quality.MEASURES, brute_measures(t), strict=True))
        n = m["n_words"]
        return n >= 50 and 2 * m["n_repeat_words"] <= n and 10 * m["n_symbols"] <= n and 2 * m["n_dup_lines"] <= m["n_lines"] and 2 * n <= m["word_chars"] <= 15 * n and 10 * m["n_upper"] <= 4 * m["word_chars"]

    left = [(i, t) for i, t in left if good(t)]
    ids = plain_near_copies(left)
    left = {i: t for i, t in left if i in ids}
    b, texts = bpe.Bpe(tokenizer_path()), {}
    for i, t in left.items():
        out, end = "", 0
        for a, z, k in sorted((a, z, k) for k, a, z, _ in pii.find_spans([t], pii.field())[0]):
            if a >= end:
                out += t[end:a] + f"<{pii.KINDS[k].upper()}>"
            end = max(end, z)
        texts[i] = out + t[end:]
    want = {i: len(b.encode_batch([t])[0]) // 4 + 1 for i, t in texts.items()}
    rows = corpus_pipeline.run(spark, folder).collect()
    got = Counter()
    for r in rows:
        got[r["doc_id"]] += r["length"]
    assert dict(got) == want
    pieces = sorted((min(4096, n - a) for n in want.values() for a in range(0, n, 4096)), reverse=True)
    assert sum(map(packing.cost, {(r["shard"], r["bin"]): r["capacity"] for r in rows}.values())) == pytest.approx(sum(map(packing.cost, packing.pack(pieces)[2])))


def test_pipeline_stages_on_odd_tables(spark, odd, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(0, 0), (3, 1), (None, None)], "doc_id bigint, toxic int").withColumn("quality", F.lit(1)).write.parquet(f"{folder}/labels.parquet")
    kept = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, folder)
        assert kept.columns == odd.columns and stage(spark, odd.limit(0), folder).count() == 0
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, odd, folder).select("doc_id").distinct().count() == odd.select("doc_id").distinct().count()
    assert last(spark, odd.limit(0), folder).count() == 0


def test_entry_names_what_is_missing(monkeypatch):
    """Only the subpackage's own absence is passed over."""
    import importlib

    import __spark_entry__

    monkeypatch.setitem(sys.modules, "glossarion.llm", None)
    monkeypatch.delitem(sys.modules, "corpus_pipeline")
    try:
        assert not any(q.startswith("op") for q in importlib.reload(__spark_entry__).queries())
    finally:
        monkeypatch.undo()
        importlib.reload(__spark_entry__)
    assert "op1_bpe" in __spark_entry__.queries()


def test_warc_payload_of_an_empty_archive(spark, tmp_path):
    (tmp_path / "x.gz").write_bytes(b"")
    assert warc.read(spark, str(tmp_path)).count() == 0
