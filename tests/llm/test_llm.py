"""The training-data operators on small tables, against brute force, round trips and held-out labels."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossarion.llm import bpe, components, lattice, packing, pii, quality, simhash, topk, toxicity, urls, warc
from glossarion.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [None, "", " \n\t", "One two three", "one TWO three", "naïve café — 日本語 ԱԲ", "a" * 3000, "x y z " * 400, "<|endoftext|>hi<|endoftext|>", "dup line\ndup line\n\ndup line"]


@pytest.fixture(scope="module")
def docs(spark):
    """Null, empty, long and repeated texts, a repeated row, a null id, and columns with clashing names."""
    rows = [(i, t, "en", 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "en", 1), (None, "no id here", None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, ids string, n_words int")


def test_bpe_equals_the_library(spark, docs):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    own = Tokenizer.from_file(path)
    got = bpe.encode_decode(docs, path, keep=("doc_id", "text")).collect()
    assert len(got) == docs.count()
    for r in got:
        want = own.encode(r["text"] or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == want
        assert r["decoded"] == own.decode(want, skip_special_tokens=False) == (r["text"] or "")
    assert bpe.encode_decode(docs.limit(0), path).count() == 0


def test_bpe_random_texts_and_both_trees():
    from tokenizers import Tokenizer

    path = tokenizer_path()
    own, b, rng = Tokenizer.from_file(path), bpe.Bpe(path), random.Random(4)
    texts = ["".join(rng.choice("abct the'sé1 \n🙂Ա") for _ in range(rng.randint(0, 200))) for _ in range(200)]
    assert [np.frombuffer(x, "<u4").tolist() for x in b.encode_batch(texts)] == [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]
    words = ["".join(rng.choice("thean ") for _ in range(n)).encode() for n in (1, 2, 7, 33, 64)]
    assert b.merge_batch(words, 64) == [b.merge_one(w) for w in words]
    assert b.decode(np.array([b.byte_id[0xE9]], "<u4").tobytes()) == "�"


def brute_measures(text):
    t = text or ""
    w = WORD.findall(t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = Counter(grams)
    covered = {j for i, g in enumerate(grams) if many[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines), len(lines) - len(set(lines)), len(covered), sum("A" <= c <= "Z" for c in t))


def test_quality_measures_and_policies(spark, docs):
    rng = random.Random(7)
    more = [(100 + i, "".join(rng.choice(["a ", "b ", "C# ", "\n"]) for _ in range(rng.randint(0, 60))), "", 0) for i in range(60)]
    more += [(200 + i, "".join(rng.choice(["f", "\f", "fa ", " b", "v", "\v", "\\f", "r\r"]) for _ in range(rng.randint(0, 12))), "", 0) for i in range(200)]
    more += [(500 + i, t, "", 0) for i, t in enumerate(("f", "f f f", "a b f", "\ff", "f\f", "\f", "fa b c fa b c", "\fa b c a b c\f"))]
    df = docs.unionByName(spark.createDataFrame(more, docs.schema))
    book = quality.ledger(df)
    for r in book.collect():
        assert tuple(r[m] for m in quality.MEASURES) == brute_measures(r["text"])
        assert (r["failure_bits"] & quality.BASE.mask == 0) == (r["n_words"] >= 50 and 100 * r["n_repeat_words"] <= 50 * r["n_words"])
    kept = quality.keep(df, quality.STANDARD)
    assert kept.columns == df.columns and kept.count() == book.filter("failure_bits = 0").count()
    effect = {r["rule"]: r for r in quality.ablation(book, quality.BASE).collect()}
    assert effect["few_words"]["n_failed"] == book.filter("n_words < 50").count()
    assert quality.keep(df.limit(0), quality.STANDARD).count() == 0


def test_url_rules_and_segmentation(spark):
    rules = (urls.Rule("allow", "org/"), urls.Rule("block", "example.org/es/"), urls.Rule("block", "com/de/"), urls.Rule("allow", "com/fr/"))
    data = [(1, "http://A.Example.ORG/es/1?x", None), (2, "https://b.org", "<p>good news good shop</p>"), (3, None, ""), (4, "nothing", None), (5, "http://goodnews.com/de/1", None), (6, "http://x.com/fr/2#t", None), (6, "http://x.com/fr/2#t", None), (7, "http://goodnews.com/en/7", "news")]
    pages = spark.createDataFrame(data, "page_id bigint, url string, html string")
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages, rules).collect())
    assert [g[:4] for g in got] == [(1, "a.example.org", "/es/1", "example.org/es/"), (2, "b.org", "", None), (3, "", "", None), (4, "", "", None), (5, "goodnews.com", "/de/1", "com/de/"), (6, "x.com", "/fr/2", "com/fr/"), (6, "x.com", "/fr/2", "com/fr/"), (7, "goodnews.com", "/en/7", None)]
    assert dict((g[0], g[4]) for g in got)[5] == "block" and dict((g[0], g[4]) for g in got)[7] == "block"
    assert urls.viterbi("goodnewsx", lambda end: {4: [(0, 2)], 8: [(4, 2)]}.get(end, ()), 6) == ["good", "news", "x"]
    assert urls.judge(pages.limit(0), rules).count() == 0


def test_url_hosts_of_any_length(spark):
    """Long hosts cost in proportion to their length, and words of any length are known."""
    import time

    rng = random.Random(11)
    long_word = "".join(rng.choice("abcdefgh") for _ in range(3000))
    hosts = ["".join(rng.choice("abc") for _ in range(100_000)), long_word + "news", "good" * 20_000, "a" * 50_000 + ".1x--" + "news"]
    pages = spark.createDataFrame([(i, f"http://{h}/p", f"good news good abc <b>{long_word}</b>") for i, h in enumerate(hosts)], "page_id bigint, url string, html string")
    urls.judge(pages.limit(1), ()).count()
    began = time.time()
    counts = urls.word_counts(pages)
    got = {r["host"]: r["host_words"] for r in urls.segment(urls.parse(pages), counts).collect()}
    assert time.time() - began < 60
    assert all("".join(w) == h for h, w in got.items() if "." not in h)
    assert got[hosts[1]] == [long_word, "news"] and got[hosts[2]] == ["good"] * 20_000
    assert got[hosts[3]] == ["a" * 50_000, "1", "x", "news"]
    assert {r["host"] for r in urls.judge(pages, ()).collect()} == set(hosts)


def test_name_hashes_tell_parts_apart():
    rng = random.Random(12)
    name = "".join(rng.choice("ab") for _ in range(300))
    sums, powers = urls._prefixes(name)
    for size in (1, 2, 7, 30, 300):
        got = urls.parts_of(sums, powers, size).tolist()
        assert got == [urls.name_hash(name[i : i + size]) for i in range(len(name) - size + 1)]
        assert len(set(got)) == len({name[i : i + size] for i in range(len(name) - size + 1)})


PATTERNS = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s, d: True),
    (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s, d: all(int(x) <= 255 for x in s.split("."))),
    (r"[0-9]([\x20-]?[0-9])+", lambda s, d: 16 <= len(d) <= 19 and pii.luhn(d)),
    (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s, d: 8 <= len(d) <= 15),
)


def test_fixed_patterns_equal_plain_search():
    rng = random.Random(3)
    for _ in range(5000):
        t = "".join(rng.choice("01259.@+-() a%_b\n") for _ in range(rng.randint(0, 60)))
        want = sorted((k, *m.span()) for k, (p, ok) in enumerate(PATTERNS) for m in re.finditer(p, t) if ok(m[0], re.sub("[^0-9]", "", m[0])))
        assert sorted(pii.fixed_spans(t)) == want


def test_field_adds_spans_and_leaves_clean_text(spark):
    texts = ["call (415) 555-0132 now", "mail joe(at)site.example.com", "card 4111111111111111, ok", "clean words only", "Version 2.0. of 2021", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: [(s["kind"], s["fixed"]) for s in r["spans"]] for r in pii.detect(df).collect()}
    assert got == {0: [("phone", False)], 1: [("email", False)], 2: [("card", True)], 3: [], 4: [], 5: [], 6: []}
    masked = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert masked[0] == "call <PHONE> now" and masked[2] == "card <CARD>, ok" and masked[5] is None and masked[3] == texts[3]


def test_packing_keeps_every_piece(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([0, 3, 3, 700, 4096, 9000, None])) for i in range(400)] + [(1, 3), (1, 3)]
    got = packing.best_fit(spark.createDataFrame(rows, "doc_id bigint, n bigint"), "n", shard=100).collect()
    assert sum(r["length"] for r in got) == sum(n or 0 for _, n in rows)
    bins = {}
    for r in got:
        bins.setdefault((r["shard"], r["bin"], r["capacity"]), []).append((r["offset"], r["length"]))
    for (_, _, capacity), inside in bins.items():
        inside.sort()
        assert all(a + n <= b for (a, n), (b, _) in zip(inside, inside[1:], strict=False))
        used = sum(n for _, n in inside)
        assert used <= capacity and capacity == min(c for c in packing.CAPACITIES if c >= used)


def best_packing(lengths, capacities):
    """The least cost of any packing, by trying every partition of the pieces into bins."""

    def partitions(items):
        if not items:
            yield []
            return
        for rest in partitions(items[1:]):
            yield [[items[0]], *rest]
            for i in range(len(rest)):
                yield [*rest[:i], [items[0], *rest[i]], *rest[i + 1 :]]

    fits = lambda u: next((packing.cost(c) for c in capacities if c >= u), math.inf)
    return min(sum(fits(sum(b)) for b in p) for p in partitions(lengths))


def total_cost(lengths, capacities):
    bins, offsets, sizes = packing.pack(lengths, capacities)
    for b, c in enumerate(sizes):
        inside = sorted((o, n) for x, o, n in zip(bins, offsets, lengths, strict=True) if x == b)
        assert all(o + n <= o2 for (o, n), (o2, _) in zip(inside, inside[1:], strict=False)) and sum(n for _, n in inside) <= c
    return sum(map(packing.cost, sizes)), sizes


def test_pack_is_near_the_best_packing_and_uses_several_capacities():
    rng, caps = random.Random(3), packing.CAPACITIES
    worst, equal = 1.0, 0
    for _ in range(60):
        lengths = sorted((rng.choice([rng.randint(1, 600), rng.randint(1, 4096)]) for _ in range(7)), reverse=True)
        best, (got, _) = best_packing(lengths, caps), total_cost(lengths, caps)
        worst, equal = max(worst, got / best), equal + (got < best * 1.000001)
        assert got >= best * 0.999999
    assert worst < 1.25 and equal >= 40
    lengths = sorted((min(4096, int(rng.lognormvariate(6.2, 1))) for _ in range(3000)), reverse=True)
    got, sizes = total_cost(lengths, caps)
    assert len(set(sizes)) >= 3
    for k in range(4):  # no worse than best fit with any smaller set of capacities that holds the largest
        assert got <= total_cost(lengths, caps[k:])[0]
    assert packing.pack([]) == ([], [], []) and packing.pack([0, 0])[2] == [512]


def test_packing_ids_of_any_type_and_clashing_names(spark):
    rows = [("a", 5, 1), ("b", 9000, 2), (None, 7, 3), ("a", 5, 1)] + [("hot", 700, 0)] * 300
    df = spark.createDataFrame(rows, "n string, length bigint, shard int")
    got = packing.best_fit(df, "length", "n", shard=50).collect()
    assert sum(r["length"] for r in got) == sum(r[1] for r in rows) and len(got) == len(rows) + 2
    assert len({r["shard"] for r in got if r["n"] == "hot"}) > 3  # one id of most rows doesn't fill one task
    empty = packing.best_fit(df.limit(0), "length", "n")
    assert empty.count() == 0 and empty.columns[0] == "n"


def test_warc_round_trip_over_small_ranges(spark, tmp_path):
    big = "<p>" + "payload " * 30
    data = [(1, "http://a/ü x", big), (2, None, big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", big), (6, "u", big), (-9, "u", "é" * 60)]
    pages = spark.createDataFrame(data, "page_id bigint, url string, html string")
    warc.write(pages, str(tmp_path / "w"))
    for size in (64, 1 << 20):
        got = sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read(spark, str(tmp_path / "w"), size).collect())
        want = sorted((i, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), "revisit" if h == big and i > 1 else "response", 1 if h == big and i > 1 else None) for i, _, h in data)
        assert got == want
    again = warc.read(spark, str(tmp_path / "w"), 64).select("path", "offset", "record_type").distinct()
    assert again.count() == len(data) and again.filter("offset is null or record_type = 'damaged'").count() == 0
    warc.write(pages.limit(0), str(tmp_path / "e"))
    assert warc.read(spark, str(tmp_path / "e")).count() == 0


def test_warc_damaged_records_are_reported(spark, tmp_path):
    """A byte flipped anywhere in an archive costs at most the record that it is in, and is never passed over."""
    blocks = [b"HTTP/1.1 200 OK\r\n\r\n" + bytes(random.Random(i).randrange(256) for _ in range(400)) for i in range(8)]
    members = [warc.record([("WARC-Type", "response"), ("WARC-Record-ID", warc.record_id(i))], b) for i, b in enumerate(blocks)]
    starts = np.cumsum([0] + [len(m) for m in members]).tolist()
    whole = b"".join(members)
    rng = random.Random(1)
    for trial in range(120):
        k = rng.randrange(len(members))
        at = starts[k] + (trial % 12 if trial < 60 else rng.randrange(len(members[k]) - 30))
        data = bytearray(whole)
        data[at] ^= 1 << rng.randrange(8)
        (tmp_path / "a.warc.gz").write_bytes(data)
        for size in (100, 500, 1 << 20):
            found = [r for s in range(0, len(whole), size) for r in warc.records(str(tmp_path / "a.warc.gz"), s, s + size)]
            good = [warc.parse(d)[1] for _, d in found if d is not None]
            intact = [b for i, b in enumerate(blocks) if i != k]
            assert [b for b in good if b in intact] == intact
            assert blocks[k] in good or any(d is None for _, d in found) or len(good) == len(blocks)
    (tmp_path / "a.warc.gz").write_bytes(whole[: starts[5]] + b"\0" * 40 + whole[starts[5] + 40 :])
    with pytest.raises(Exception, match="damaged record at offset"):
        warc.read(spark, str(tmp_path)).collect()
    rows = warc.read(spark, str(tmp_path), damaged="report").collect()
    assert sorted(r["page_id"] for r in rows if r["record_type"] == "response") == [0, 1, 2, 3, 4, 6, 7]
    assert [r["offset"] for r in rows if r["record_type"] == "damaged"] == [starts[5]]


def test_warc_members_end_in_a_zero_byte():
    assert all(warc.record([("A", "b")], b"x" * n)[-1] == 0 for n in (0, 1, 5000))
    assert [warc.id_of(warc.record_id(i)) for i in (0, -1, None, 2**63 - 1)] == [0, -1, None, 2**63 - 1]


def test_topk_equals_brute_force_with_ties(spark):
    rng = random.Random(8)
    rows = [(i, [float(rng.choice([-1, 0, 0.5, 1])) for _ in range(4)]) for i in range(150)]
    rows += [(200, None), (201, [float("nan"), 1.0, 0.0, 0.0]), (202, [1.0]), (203, []), rows[5], rows[40], rows[40], (60, [1.0, 0.5, 0.0, -1.0]), (None, [1.0, 1.0, 1.0, 1.0])]
    v = topk.integer_vectors(spark.createDataFrame([(*r, 1, True) for r in rows], "vec_id bigint, embedding array<float>, v int, asks boolean"))
    full = [(i, [math.floor(64 * x) for x in e] + [0] * (4 - len(e))) for i, e in rows if i is not None and e is not None and not any(x != x for x in e)]

    def brute(k):
        out = []
        for at, (q, x) in enumerate(full):
            if q % 20 == 0:
                best = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for j, (i, y) in enumerate(full) if j != at)[:k]
                out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
        return sorted(out)

    for k in (7, 500):
        found = topk.search(v, "vec_id % 20 = 0", k)
        assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found.collect()) == brute(k)
    assert topk.search(v.limit(0), "vec_id % 20 = 0").count() == 0 == topk.search(v, "false").count()


def test_topk_takes_candidates_in_bound_order_and_stops():
    rng = np.random.default_rng(2)
    centres = rng.integers(-2000, 2000, (40, 6))
    x = (centres[rng.integers(0, 40, 3000)] + rng.integers(-5, 6, (3000, 6))).astype(np.int64)
    most = float((x * x).sum(1).max())
    pivots = topk.choose_pivots(x[:500].astype(float), most)
    rows, ask = np.arange(3000), np.arange(0, 3000, 100)
    table = topk.pivot_distances(x, np.zeros(3000, bool), pivots, most)
    group = topk.Asking(ask, ask, x[ask], topk.pivot_distances(x[ask], np.ones(30, bool), pivots, most), 5, most)
    for a in range(0, 3000, 1000):
        group.meet(rows[a : a + 1000], rows[a : a + 1000], x[a : a + 1000], table[a : a + 1000])
    for i, best in zip(ask, group.best, strict=True):
        scores = x @ x[i]
        want = sorted((-int(s), j) for j, s in enumerate(scores) if j != i)[:5]
        assert [(-int(s), int(j)) for s, j in best] == want
    assert group.pairs == 30 * 3000 and group.evaluated < 0.6 * group.pairs
    large = np.array([[1 << 40, 3], [1 << 40, -3], [5, 1 << 20]])  # products beyond a double's whole numbers
    most = float((large.astype(float) ** 2).sum(1).max())
    pivots = topk.choose_pivots(large.astype(float), most)
    far = topk.Asking(np.array([2]), np.array([2]), large[2:], topk.pivot_distances(large[2:], np.ones(1, bool), pivots, most), 2, most)
    far.meet(np.arange(3), np.arange(3), large, topk.pivot_distances(large, np.zeros(3, bool), pivots, most))
    assert far.best[0].tolist() == [[5 * (1 << 40) + 3 * (1 << 20), 0], [5 * (1 << 40) - 3 * (1 << 20), 1]]


def test_simhash_fingerprints_and_components(spark):
    import xxhash

    def slow(text):
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return f"{sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)):016x}"

    rng = random.Random(6)
    base = [rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(300)]
    texts = TEXTS + [" ".join(base[:k] + ["zz"] + base[k:]) for k in range(0, 300, 10)] + [" ".join(base)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, None), (None, "One two three")], "doc_id bigint, text string")
    got = simhash.components(df).collect()
    assert all(r["fingerprint"] == slow(texts[r["doc_id"]] if r["doc_id"] is not None else "One two three") for r in got)
    fps = {i: int(slow(t), 16) for i, t in enumerate(texts)}
    comp = {i: i for i in fps}
    for _ in fps:
        comp = {i: min(comp[j] for j in fps if bin(fps[i] ^ fps[j]).count("1") <= 3) for i in fps}
    assert all(r["component_id"] == comp[r["doc_id"]] for r in got if r["doc_id"] is not None)
    assert sorted(r["doc_id"] for r in simhash.keep_one(df.filter("doc_id is not null")).collect()) == sorted(set(comp.values()))
    assert simhash.components(df.limit(0)).count() == 0


def test_forest_spans_near_fingerprints():
    fp = np.array([0, 1, 3, 7 << 40, -1, -2], np.int64)
    assert len(simhash.forest(fp)) == 4


def test_components_of_a_long_chain(spark):
    n = 300
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (5, 5)], "u bigint, v bigint")
    got = {r["v"]: r["component"] for r in components.connected_components(edges).collect()}
    assert got == {i: 0 for i in range(1, n)} | {1001: 1000}


def test_lattice_scores_against_brute_force(spark):
    path = tokenizer_path("piece_bpe_32k.model")
    model = lattice.Lattice(path)

    def all_ways(s):
        if not s:
            return 1.0
        total = sum(math.exp(model.logp[s[:k]]) * all_ways(s[k:]) for k in range(1, len(s) + 1) if s[:k] in model.logp)
        return total if s[0] in model.logp else total + math.exp(model.byte * len(s[0].encode())) * all_ways(s[1:])

    for w in ("the", "clown", "日x", "ñu"):
        assert model.log10(w) == pytest.approx(math.log10(all_ways("▁" + w)))
    texts = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, "one more")]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    tokens = [(i, WORD.findall((t or "").translate(low)) + [None]) for i, t in texts]
    c = Counter(w for i, t in tokens if not held(i) for w in t)
    n, v = sum(c.values()), len(c)
    base = lambda t: sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
    for frequent in (2, 1000):
        got = lattice.score(df, path, train="crc32(string(doc_id)) % 10 != 0", frequent=frequent).collect()
        key = lambda x: (x[0] is None, x[0] or 0, round(x[1], 6), x[2])
        a = sorted(((r["doc_id"], r["base_score"], r["n_tokens"], r["n_known"]) for r in got), key=key)
        b = sorted(((i, base(t), len(t), sum(c[w] > 0 for w in t)) for i, t in tokens), key=key)
        assert [x[0] for x in a] == [x[0] for x in b] and [x[2:] for x in a] == [x[2:] for x in b]
        assert [x[1] for x in a] == pytest.approx([x[1] for x in b])
        assert all(r["train_tokens"] == n for r in got)


def test_toxicity_learns_and_ignores_group_names(spark):
    rng = random.Random(12)
    filler = ["river", "stone", "window", "garden", "market", "music", "bread", "paper"]

    def text(bad, group):
        words = [rng.choice(filler) for _ in range(12)] + (["idiotic"] if bad else []) + ([group] if group else [])
        rng.shuffle(words)
        return " ".join(words)

    # in the labels groups' names go with insults; a fair score must not follow them
    groups = ["muslim", "gay", "women", "immigrants"]
    data = [(i, text(i % 3 == 0 and rng.random() < 0.7, rng.choice(groups) if rng.random() < (0.9 if i % 3 == 0 else 0.1) else ""), int(i % 3 == 0)) for i in range(300)]
    docs = spark.createDataFrame([d[:2] for d in data] + [(900, None), (901, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(d[0], d[2]) for d in data] + [(0, None), (None, 1), (901, 0), (900, 0)], "doc_id bigint, toxic int")
    sample = toxicity.labelled_sample(docs, labels, 2500, "true").collect()
    assert len(sample) == 302 and all(len(r["changes"]) == 2 and all(c["lost"] for c in r["changes"]) for r in sample)
    fair, plain = toxicity.train(docs, labels), toxicity.train(docs, labels, counterfactual=0.0)  # the default penalty, and none
    probe = lambda m, t: m.score(toxicity.words_of(t), {})
    neutral = [text(False, g) for g in [*groups, "jewish", "old"] for _ in range(40)]
    wrong = lambda m: sum(probe(m, t) >= 0.5 for t in neutral)
    assert wrong(plain) > 0.4 * len(neutral) and wrong(fair) < 0.05 * len(neutral)
    assert sum(probe(fair, text(True, "")) >= 0.7 for _ in range(40)) >= 38
    scored = {r["doc_id"]: r["score"] for r in toxicity.score(docs, fair).collect()}
    assert len(scored) == 302 and 0 <= scored[900] == scored[901] <= 1
    assert toxicity.fit([]).score(set(), {}) < 0.01
    assert toxicity.score(docs, toxicity.train(docs.limit(0), labels)).count() == 302 and toxicity.score(docs.limit(0), fair).count() == 0


def test_pipeline_stages_keep_the_columns(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality rules", "near duplicates", "personal data", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    packed = corpus_pipeline.run(spark, folder)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} <= ids and packed.count() > 0


def test_near_copies_of_the_stage_against_brute_force(spark):
    """All pairs at a five-word Jaccard of 0.8 or more are linked, none below; one row a group is left, with ids that stand on several texts."""
    import corpus_pipeline
    from glossarion.llm import neardup

    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(500)]
    texts = []
    for _ in range(40):
        base = rng.choices(vocabulary, k=rng.randint(50, 300))
        texts.append(" ".join(base))
        for share in (0.005, 0.01, 0.02, 0.03, 0.05):
            texts.append(" ".join(rng.choice(vocabulary) if rng.random() < share else w for w in base))
    texts += [None, "", " ", "Two words", "two WORDS", "two words more"]
    rows = list(enumerate(texts)) + [(0, texts[0]), (0, "another text of the same id"), (None, texts[0]), (None, None)]
    rng.shuffle(rows)

    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    ids = [r for r in sorted(set(rows), key=str) if r[0] is not None]
    sets, group = [grams(t) for _, t in ids], list(range(len(ids)))
    near = [(i, j) for i in range(len(ids)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    assert sum(sets[i] != sets[j] for i, j in near) > 50
    for i, j in near:
        a, b = group[i], group[j]
        group = [min(a, b) if g in (a, b) else g for g in group]
    want = sorted(min(ids[i][0] for i in range(len(ids)) if group[i] == g) for g in set(group))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = corpus_pipeline.drop_near_copies(spark, df, "").collect()
    assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == want
    assert "another text of the same id" in {r["text"] for r in got}
    assert sum(r["doc_id"] is None for r in got) == 2
    assert neardup.keep_one(df.limit(0)).count() == 0
    exact = [neardup.shingles((t or "").encode()) for _, t in ids]
    assert {(max(e), min(e)) for e in neardup.forest(exact[:30])} <= {(i, j) for i, j in near if i < 30}


def test_near_copies_are_found_by_fingerprints_alone_and_decided_on_whole_sets(spark):
    """Without a shared band: pairs within three bits are linked at a Jaccard of 0.8 or more, and not below."""
    from glossarion.llm import neardup

    rng = random.Random(8)
    texts = []
    for _ in range(30):
        base = [f"w{rng.randint(0, 500)}" for _ in range(120)]
        texts += [" ".join(base), " ".join([*base, "end"]), " ".join([*base[:-1], "last"])]
    twice = ["a b c " * 50 + " ".join(f"{x}{i}" for i in range(9)) for x in "pq"]  # the repeated words make the fingerprints, the others the sets
    df = spark.createDataFrame(list(enumerate([*texts, *twice])), "doc_id bigint, text string")
    rows = neardup.sketches(df).withColumn("bands", F.array().cast("array<bigint>")).checkpoint()
    got = {tuple(sorted(r)) for r in neardup.links(df, rows, "doc_id", "text").collect()}
    fps = {r["key"]: r["fp"] & (1 << 64) - 1 for r in rows.collect()}
    sets = {r["key"]: neardup.shingles(t.encode()) for r, t in zip(rows.orderBy("doc_id").collect(), [*texts, *twice], strict=True)}
    alike = lambda a, b: bool(neardup.forest([sets[a], sets[b]]))
    near = {tuple(sorted((a, b))) for a in sets for b in sets if a < b and (fps[a] ^ fps[b]).bit_count() <= 3}
    assert all(alike(a, b) for a, b in got) and len({p for p in near if alike(*p)}) > 20 and not all(alike(*p) for p in near)
    group = {r["v"]: r["component"] for r in components.connected_components(spark.createDataFrame(sorted(got), "u bigint, v bigint")).collect()}
    assert all(group.get(a, a) == group.get(b, b) for a, b in near if alike(a, b))


def test_toxicity_reads_a_text_inside_of_what_it_keeps(spark):
    docs = spark.createDataFrame([(1, "vile scum here"), (2, None), (3, "a calm note"), (1, "")], "doc_id bigint, text string")
    model = toxicity.Model({f: 1.5 for f in toxicity.word_features("scum")}, -1.0)
    want = sorted(map(tuple, toxicity.score(docs, model).collect()))
    scored = toxicity.score(docs.select(F.struct("*").alias("_doc")), model, "_doc.text", keep=("_doc",))
    assert sorted(map(tuple, scored.select("_doc.doc_id", "score").collect())) == want
    assert "_text" not in scored._jdf.queryExecution().optimizedPlan().toString()  # the text went to the tasks twice before
