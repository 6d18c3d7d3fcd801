"""The LSH forest, the prefix trie and the ranked search against brute force, on small and on odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glossarion.llm import lshforest, neardup, search, trie

LOWER = {c: c + 32 for c in range(65, 91)}


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def brute_components(rows):
    """(n, component) of each row (id, text), by all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(len(s), least[find(i)] if d is not None else None) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def near_copies(rng, n):
    """Texts at all similarities around 0.8, in chains and groups."""
    vocabulary = ["w%d" % i for i in range(400)]
    out = []
    for _ in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((3, 8, 40, 120)))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            base = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 30))):
                base[rng.randrange(len(base))] = rng.choice(vocabulary)
            out.append(rng.choice((" ", "\t\n")).join(base).upper())
    return out


@pytest.mark.parametrize("region, run, partitions, piece", [(1 << 16, 1 << 20, 4, 1 << 19), (200, 1 << 20, 7, 120), (1, 3, 5, 1 << 19)])
def test_forest_equals_all_pairs(spark, monkeypatch, region, run, partitions, piece):
    monkeypatch.setattr(neardup, "PIECE", piece)
    monkeypatch.setattr(lshforest, "REGION", region)
    monkeypatch.setattr(lshforest, "RUN", run)
    rng = random.Random(region)
    rows = list(enumerate(near_copies(rng, 60)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(partitions)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in lshforest.components(df).collect()}
    want = dict(zip([i for i, _ in rows], brute_components(rows), strict=True))
    assert got == want
    assert len({c for _, c in want.values()}) < len(rows)


def test_forest_query_equals_all_pairs_of_the_table(spark):
    from glossarion.llm.queries import op11_lsh_forest

    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = {d: (n, c, c == d) for (d, _), (n, c) in zip(rows, brute_components(rows), strict=True)}
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in op11_lsh_forest(spark, folder).collect()} == want


def test_large_buckets_in_pieces_equal_all_pairs(spark, monkeypatch):
    """One bucket of all classes, cut small: tight groups, chains and classes that nothing links."""
    rng = random.Random(21)
    rows = list(enumerate(t for t in near_copies(rng, 50)))
    df = spark.createDataFrame(rows, "_id bigint, _t string").repartition(3)
    own = lshforest.sketches(df, "_id", "_t").filter("n > 0").cache()
    want = dict(zip([i for i, _ in rows], brute_components(rows), strict=True))
    for piece in (100, 700, 1 << 19):
        monkeypatch.setattr(neardup, "PIECE", piece)
        keys = own.dropDuplicates(["key"]).select("key", "n", F.lit(7).cast("bigint").alias("k"))
        found = {r["v"]: r["component"] for r in neardup.connected_components(neardup.bucket_links(df, own, keys, "_id", "_t", 4)).collect()}
        groups = {}
        for r in own.collect():
            groups.setdefault(found.get(r["key"], r["key"]), set()).add(r["_id"])
        expected = {}
        for i, (_, c) in want.items():
            expected.setdefault(c, set()).add(i)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_forest_on_odd_tables(spark):
    texts = [None, "", " \n\t", "One two three", "one TWO three", "one two three four", "naïve café — 日本語 ԱԲ", "naïve CAFÉ — 日本語 ԱԲ", "x y z " * 4000, "x y z " * 3000]
    rows = [(i, t, i * 1.5, "q") for i, t in enumerate(texts)] + [(3, texts[3], 4.5, "q"), (None, "one two three", 0.0, "q"), (None, "no id here at all", 0.0, "q"), (None, None, 0.0, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, key double, component_id string")
    got = sorted(map(tuple, lshforest.components(df).collect()), key=str)
    want = [(d, n, c) for (d, *_), (n, c) in zip(rows, brute_components([r[:2] for r in rows]), strict=True)]
    want[11] = (None, 1, 3)  # a row without id takes its text's component
    assert got == sorted(want, key=str)
    assert lshforest.components(df.limit(0)).count() == 0
    assert lshforest.components(df.filter("doc_id < 3")).count() == 3


def test_forest_runs_are_cut_where_crowded():
    rng = np.random.default_rng(3)
    n = 4000
    head, tail = np.sort(rng.integers(0, 40, n)), rng.integers(0, 6, n) << 16 | rng.integers(0, 6, n)
    order = np.lexsort((tail, head))
    head, tail, key, size = head[order], tail[order], np.arange(n), np.full(n, 100)
    batches = [pa.RecordBatch.from_arrays(list(map(pa.array, (head[a:b], tail[a:b], key[a:b], size[a:b]))), names=["head", "tail", "key", "n"]) for a, b in ((0, 700), (700, 701), (701, n))]
    found = [r for b in lshforest._runs(iter(batches)) for r in b.to_pylist()]
    at = {r["key"]: r["k"] for r in found}
    assert len(at) == len(found)
    for h in range(40):
        own = np.flatnonzero(head == h)
        crowded = h in (head[0], head[-1]) or 100 * len(own) > lshforest.REGION
        for depth_key in ([tail[i] for i in own] if crowded else [0]):
            same = [i for i in own if not crowded or tail[i] == depth_key]
            assert len({at[i] for i in same if i in at}) <= 1 or 100 * len(own) > lshforest.REGION
    assert len(set(at.values())) > 40


def test_near_duplicate_stage_keeps_values(spark):
    """Extra columns with the names that the operator uses inside stay as they are."""
    rows = [(1, "a b c d e f g", 111, 7, 1.0, "k"), (2, "A B c d e f g", 222, 8, 2.0, "l"), (3, "other words stand in this text", 333, 9, None, None), (None, "a b c d e f g", 444, 1, 0.5, "m"), (4, None, 5, 6, 7.0, "n"), (5, " ", 6, 7, 8.0, "o")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, th bigint, _rn bigint, component double, key string")
    assert sorted(map(tuple, neardup.keep_one(df).collect()), key=str) == sorted([rows[0], rows[2], rows[3], rows[4]], key=str)


def brute_trie(rows, limit=None):
    turns = {}
    for c, t, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append(((t is not None, t or 0), role or "", text or ""))
    own = {c: [(r, x) for _, r, x in sorted(v, key=lambda y: y[:2])] for c, v in turns.items()}
    built = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - c % 100, [])[:h] + mine[h:])
    nodes = {}
    for c, s in built.items():
        for d in range(len(s) + 1):
            nodes.setdefault(s[:d], set()).add(c)
    out = set()
    for s, members in nodes.items():
        below = [x for x in nodes if x[: len(s)] == s]
        children = [x for x in below if len(x) == len(s) + 1]
        leaves = sum(not any(y[: len(x)] == x and len(y) == len(x) + 1 for y in nodes) for x in below)
        saved = sum((len(nodes[x]) - 1) * len(x[-1][1]) for x in below if x)
        ends = ",".join(map(str, sorted(c for c in members if built[c] == s)))
        out.add((min(members), len(s), min(nodes[s[:-1]]) if s else None, len(members), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out, len(nodes)


@pytest.mark.parametrize("limit", [1, 6, 40, 1 << 12])
def test_trie_equals_brute_force(spark, limit):
    rng = random.Random(limit)
    rows = []
    for c in [*rng.sample(range(330), 70), 1000, 1003, 20017]:
        n = rng.choice((1, 1, 2, 4, 7, 30))
        for t in range(n):
            rows.append((c, rng.choice((t, t, None)) if n == 1 else t, rng.choice(("user", "bot", None)), rng.choice(("a", "bé", "", None)) if t < 4 else "same"))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    want, n = brute_trie(rows)
    found = trie.prefix_trie(df, limit).collect()
    assert len(found) == n
    assert {tuple(r) for r in found} == want


def test_trie_with_one_long_and_many_equal_conversations(spark):
    rows = [(5, t, "user", f"t{t}") for t in range(3000)] + [(700 + i, t, "user", f"t{t}") for i in range(300) for t in range(12)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(6)
    want, n = brute_small(rows)
    got = trie.prefix_trie(df, 500).collect()
    assert len(got) == n
    assert {tuple(r) for r in got} == want


def brute_small(rows):
    """brute_trie with subtree sums from the ends of the sequences up, for long ones."""
    own = {}
    for c, t, r, x in rows:
        own.setdefault(c, []).append((t, r, x))
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = [y[1:] for y in sorted(own.get(c - c % 100, []))[:h] + sorted(own[c])[h:]]
    root = {"next": {}, "in": set(), "ends": []}
    for c, s in built.items():
        at = root
        at["in"].add(c)
        for y in s:
            at = at["next"].setdefault(y, {"next": {}, "in": set(), "ends": []})
            at["in"].add(c)
        at["ends"].append(c)
    order, stack = [], [(root, 0, None, "")]
    while stack:
        node, d, parent, text = stack.pop()
        order.append((node, d, parent, text))
        stack += [(x, d + 1, node, y[1]) for y, x in node["next"].items()]
    out = set()
    for node, d, parent, text in reversed(order):
        node["leaves"] = sum(x["leaves"] for x in node["next"].values()) or 1
        node["saved"] = (len(node["in"]) - 1) * len(text) + sum(x["saved"] for x in node["next"].values())
        sha = hashlib.sha256(",".join(map(str, sorted(node["ends"]))).encode()).hexdigest()
        out.add((min(node["in"]), d, parent and min(parent["in"]), len(node["in"]), len(node["next"]), node["leaves"], node["saved"], sha))
    return out, len(order)


def test_trie_on_odd_tables(spark):
    rows = [(None, 1, "user", "lost"), (205, 0, "user", "short"), (7, 2, None, None), (7, None, "user", "first"), (7, 2, "bot", "x" * 100_000), (7, 2, "bot", "x" * 100_000), (0, 1, "", "")]
    df = spark.createDataFrame([(*r, 9, "z") for r in rows], "conv_id bigint, turn bigint, role string, text string, c int, at string")
    want, n = brute_trie(rows)
    got = trie.prefix_trie(df).collect()
    assert len(got) == n and {tuple(r) for r in got} == want
    assert any(r["depth"] == 0 and r["n_convs"] == 3 for r in got)
    assert trie.prefix_trie(df.limit(0)).count() == 0


def brute_search(docs, items, k):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    held = [(d, Counter(cut(t)), len(cut(t))) for d, t in docs]
    n_docs, n_all, df = sum(n > 0 for *_, n in held), sum(n for *_, n in held), Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c, n in held:
            if d is None or not n:
                continue
            m = 100 - 75 + 75 * n * n_docs // n_all
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in cut(text) if t in c)
            if score > 0:
                found.append((-score, d))
        out += [(item, i + 1, d, -s) for i, (s, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("piece", [3, 50, 1 << 16])
def test_search_equals_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(search, "PIECE_DOCS", piece)
    rng = random.Random(piece)
    vocabulary = [f"t{i}" for i in range(60)] + ["Ä", "日本", "x1"]
    text = lambda n: "".join(rng.choice(vocabulary[: rng.choice((5, 20, 63))]) + rng.choice((" ", ", ", "\n-")) for _ in range(n))
    docs = [(i, text(rng.choice((0, 1, 5, 40)))) for i in range(300)] + [(7, "t1 t2 t3"), (7, "t1 t2 t3"), (None, "t1 t62 t59"), (900, None), (901, "…")]
    items = [(i, text(rng.choice((1, 3, 12)))) for i in range(25)] + [(3, "t1 T1 t2"), (40, None), (41, ""), (42, "unknown words"), (None, "t5 t9")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, item_id int").repartition(4)
    bench = spark.createDataFrame([(*i, "n") for i in items], "item_id bigint, text string, doc_id string")
    got = [tuple(r) for r in search.search(df, bench, k=4).collect()]
    assert sorted(got, key=str) == brute_search(docs, items, 4)
    monkeypatch.setattr(search, "BLOCK", 40)  # several blocks of queries
    assert sorted(map(tuple, search.search(df, bench, k=4).collect()), key=str) == brute_search(docs, items, 4)


def test_search_creates_few_accumulators_and_empty_tables(spark):
    rows = [(i, "common " * (1 + i % 3) + ("rare " * 3 if i % 40 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    items = spark.createDataFrame([(1, "rare common")], "item_id bigint, text string")
    assert [r["doc_id"] % 40 for r in search.search(docs, items, k=5).collect()] == [0] * 5
    query, tf = search.Query(Counter({0: 1, 1: 1}), np.array([400, 10]), np.array([1, 3000]), np.array([10**6, 10**6])), np.full(410, 10**5)
    at = np.r_[np.arange(400), np.arange(0, 400, 40)]
    found, scores, made = search.take(query, np.array([0, 400, 410]), at, tf, 400, 5, 0)
    assert made == 10 and found.tolist() == list(range(0, 400, 40)) and set(scores.tolist()) == {3001 * 10**5}
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.limit(0), items.limit(0))):
        out = search.search(d, i)
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == 0


def test_search_impact_beyond_64_bits():
    n, tf = np.array([3, 1 << 40, 77]), np.array([1, 5, 2])
    wide = search.impact(tf, n, 1 << 40, 1 << 50)
    assert wide.tolist() == [10**9 * t // (1000 * t + 8 * (25 + 75 * x * (1 << 40) // (1 << 50))) for x, t in zip(n.tolist(), tf.tolist(), strict=True)]
