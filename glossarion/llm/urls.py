"""URL filters: host and path rules, and naive Bayes over segmented names for the rest.

Hosts' letter runs are split into words by unigram Viterbi over word counts of the pages themselves. A run
asks for its parts by hash and length, so that neither it nor a part of it moves with them. Multinomial naive Bayes, learned from the URLs that rules decide, then scores host words and path
tokens. Its tokens are hashed into a fixed number of buckets, so that the model has a fixed size.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import shared_dir

BUCKETS = 1 << 16
_ODD = np.random.default_rng(42).integers(1, 1 << 62, 2).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """`host/path`: fits the host and its subdomains, where the URL's path starts with /path."""

    verdict: str
    rule: str

    def fits(self) -> Column:
        host, _, path = self.rule.partition("/")
        return ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)


def parse(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with host (A-Z lower-cased) and path; both are empty for a null URL or one without ://."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    whole = F.coalesce(F.col(url), F.lit(""))
    return pages.withColumns({"host": F.translate(F.regexp_extract(whole, pattern, 1), _UPPER, _LOWER), "path": F.regexp_extract(whole, pattern, 2)})


def match(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Parsed pages with rule and rule_verdict: of the rules that fit the longest, of like ones the first; else null."""
    longest = sorted(rules, key=lambda r: -len(r.rule))
    found = F.coalesce(*[F.when(r.fits(), F.struct(F.lit(r.rule).alias("rule"), F.lit(r.verdict).alias("verdict"))) for r in longest], F.lit(None).cast("struct<rule:string,verdict:string>"))
    return pages.withColumn("_r", found).withColumns({"rule": F.col("_r.rule"), "rule_verdict": F.col("_r.verdict")}).drop("_r")


def word_counts(pages: DataFrame, html: str = "html") -> DataFrame:
    """(word, n): words of two or more letters a-z in the pages' text, tags left out; counted before the shuffle."""
    plain = F.lower(F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]*>", " "))
    words = pages.select(plain.alias("t")).select(F.explode(F.expr("regexp_extract_all(t, '[a-z]+', 0)")).alias("word"))
    return words.filter(F.length("word") >= 2).groupBy("word").agg(F.count("*").alias("n"))


def viterbi(name: str, known: Callable[[int], Iterable[tuple[int, int]]], total: int) -> list[str]:
    """The likeliest words of a run of letters; known(end): (start, count) of each known word that ends there.

    A word of count n costs log(total / n); unknown letters cost as a word ten times rarer than any
    seen for each letter, so that longer unknown pieces are unlikelier. Ties go to fewer words, then to the
    longer last one. Work grows with the letters and the known words, however long the run.
    """
    one, letter = math.log(total), math.log(10)
    best: list[tuple[float, int, int]] = [(0.0, 0, 0)]
    unknown: tuple[float, int, int] | None = None  # the best way that ends in an unknown piece, and where that begins
    for end in range(1, len(name) + 1):
        cost, words, _ = best[end - 1]
        fresh = (cost + one + letter, words + 1, end - 1)
        unknown = fresh if unknown is None else min(fresh, (unknown[0] + letter, unknown[1], unknown[2]))
        options = [unknown]
        for start, n in known(end):
            options.append((best[start][0] + math.log(total / n), best[start][1] + 1, start))
        best.append(min(options))
    out, end = [], len(name)
    while end:
        start = best[end][2]
        out.append(name[start:end])
        end = start
    return out[::-1]


def _prefixes(name: str) -> tuple[np.ndarray, np.ndarray]:
    """Polynomial hashes of a name's beginnings, and the multiplier's powers."""
    letters = np.frombuffer(name.encode(), np.uint8).astype(np.uint64)
    powers = np.ones(len(letters) + 1, np.uint64)
    np.multiply.accumulate(np.r_[np.uint64(1), np.full(len(letters), _ODD[0])], out=powers)
    # h(i) = sum of letter j times base^-j up to i; parts are compared after a shift by base^(n - start)
    inverse = np.uint64(pow(int(_ODD[0]), -1, 1 << 64))
    down = np.multiply.accumulate(np.r_[np.uint64(1), np.full(len(letters), inverse)])
    return np.r_[np.uint64(0), np.add.accumulate((letters + np.uint64(1)) * down[:-1])], powers


def parts_of(sums: np.ndarray, powers: np.ndarray, length: int) -> np.ndarray:
    """Signed hashes of all parts of a length, by where they begin."""
    x = (sums[length:] - sums[:-length]) * powers[: len(sums) - length]
    x = (x ^ (x >> np.uint64(29))) * _ODD[1]
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def name_hash(word: str) -> int:
    sums, powers = _prefixes(word)
    return int(parts_of(sums, powers, len(word))[0])


def _hashed_counts(counts: DataFrame) -> DataFrame:
    """(h, size, n) of word counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([name_hash(w) for w in words], pa.int64()), pa.array([len(w) for w in words], pa.int32()), batch.column(1)], names=["h", "size", "n"])

    return counts.select("word", "n").mapInArrow(run, "h bigint, size int, n bigint")


def segment(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """(host, host_words array<string>) of the distinct hosts of `hosts` by word counts (word, n).

    Hosts are cut into their letter runs. A distinct run asks for its distinct parts, of the lengths that
    words have, as pairs of a hash of 64 bits and a length; the counts found go back to the run by its own
    hash. Rows grow with a run's letters times the lengths, and hold no text.
    """
    spark, folder = hosts.sparkSession, shared_dir(hosts.sparkSession)
    total = int(counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) + 1
    _hashed_counts(counts).write.parquet(f"{folder}/words")
    words = spark.read.parquet(f"{folder}/words")
    # the words' lengths: no more than the root of twice their letters
    lengths = sorted(r["size"] for r in words.select("size").distinct().toLocalIterator())
    hosts.select("host").distinct().write.parquet(f"{folder}/names")
    names = spark.read.parquet(f"{folder}/names")
    runs = names.select(F.explode(F.expr("regexp_extract_all(host, '[a-z]+', 0)")).alias("run")).distinct()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(run, h, size): a run by its hash."""
        held: list[tuple[int, int, np.ndarray]] = []

        def result() -> pa.RecordBatch:
            sizes = [len(x) for *_, x in held]
            columns = [np.repeat(np.array([x[0] for x in held], np.int64), sizes), np.concatenate([np.empty(0, np.int64), *(x[2] for x in held)]), np.repeat(np.array([x[1] for x in held], np.int32), sizes)]
            held.clear()
            return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["run", "h", "size"])

        rows = 0
        for batch in batches:
            for name in batch.column(0).to_pylist():
                sums, powers = _prefixes(name)
                own = int(parts_of(sums, powers, len(name))[0])
                for size in lengths:
                    if size > len(name):
                        break
                    held.append((own, size, np.unique(parts_of(sums, powers, size))))
                    rows += len(held[-1][2])
                    if rows >= 1 << 16:
                        yield result()
                        rows = 0
        yield result()

    asked = runs.mapInArrow(ask, "run bigint, h bigint, size int")
    keyed = asked.select("run", F.struct("h", "size").alias("key"))
    known = keyed.join(words.select(F.struct("h", "size").alias("key"), "n"), "key")
    # a run's known parts: no more than its letters times the lengths
    known = known.groupBy("run").agg(F.collect_list(F.struct("key.h", "key.size", "n")).alias("m"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([name_hash(x) for x in batch.column(0).to_pylist()], pa.int64())], names=["text", "run"])

    cut = runs.mapInArrow(number, "text string, run bigint").join(known, "run", "left").select("text", "m")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, m in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found: dict[int, list[tuple[int, int]]] = {}
                counts: dict[int, dict[int, int]] = {}
                for x in m or ():
                    counts.setdefault(x["size"], {})[x["h"]] = x["n"]
                sums, powers = _prefixes(text)
                for size, held in counts.items():
                    parts = parts_of(sums, powers, size)
                    for start in np.flatnonzero(np.isin(parts, np.fromiter(held, np.int64, len(held)))).tolist():
                        found.setdefault(start + size, []).append((start, held[int(parts[start])]))
                out.append(viterbi(text, lambda end, found=found: found.get(end, ()), total))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], names=["text", "words"])

    cut.mapInArrow(split, "text string, words array<string>").write.parquet(f"{folder}/runs")
    done = spark.read.parquet(f"{folder}/runs")
    # a host's pieces in order: runs of letters, and what else isn't a dot, hyphen or underscore
    pieces = names.select("host", F.posexplode(F.expr("regexp_extract_all(host, '[a-z]+|[^a-z._\\\\-]+', 0)")).alias("at", "text"))
    pieces = pieces.join(done, "text", "left").select("host", "at", F.coalesce("words", F.array("text")).alias("words"))
    whole = pieces.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("at", "words"))).alias("x"))
    joined = names.join(whole, "host", "left")
    return joined.select("host", F.coalesce(F.flatten(F.transform("x", lambda y: y["words"])), F.array().cast("array<string>")).alias("host_words"))


def tokens() -> Column:
    """What naive Bayes sees: host words and, without the query, the path's runs of letters or digits."""
    path = F.filter(F.split(F.lower("path"), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    return F.concat(F.transform(F.coalesce("host_words", F.array().cast("array<string>")), lambda x: F.concat(F.lit("h:"), x)), F.transform(path, lambda x: F.concat(F.lit("p:"), x)))


@dataclass(frozen=True)
class NaiveBayes:
    """log P(bucket | block) - log P(bucket | allow), and the same of the classes' shares of URLs."""

    odds: np.ndarray
    prior: float

    def score(self, words: Sequence[str]) -> float:
        return self.prior + float(sum(self.odds[zlib.crc32(w.encode()) % BUCKETS] for w in words))


def learn(pages: DataFrame) -> NaiveBayes:
    """From pages (tokens, rule_verdict) that a rule decides; BUCKETS rows of counts at most go to the driver."""
    decided = pages.filter("rule_verdict is not null")
    blocks = F.count_if(F.col("rule_verdict") == "block").alias("block")
    allows = F.count_if(F.col("rule_verdict") == "allow").alias("allow")
    rows = decided.select("rule_verdict", F.explode("tokens").alias("t")).groupBy((F.crc32("t") % BUCKETS).alias("bucket")).agg(blocks, allows).collect()
    b, a = decided.agg(blocks, allows).first()
    counts = np.zeros((2, BUCKETS))
    for r in rows:
        counts[:, r["bucket"]] = r["block"], r["allow"]
    share = np.log((counts + 1) / (counts.sum(1, keepdims=True) + BUCKETS))
    return NaiveBayes(share[0] - share[1], math.log((b + 1) / (a + 1)))


def judge(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(id, host, path, rule, verdict, score) of every row of pages.

    verdict: that of the longest rule that fits; without one `block` if the naive Bayes score (log odds of
    block) is above 0, else `allow`. Null URLs have an empty host and path. Rows stay apart if ids
    repeat. With no decided URLs all scores are 0, hence `allow`; an empty table gives no rows. Other
    columns of pages are dropped, whatever their names. Hosts may be of any length. Hosts' words and the rows to score are written to
    the shared folder.
    """
    folder = shared_dir(pages.sparkSession)
    parsed = match(parse(pages.select(F.col(id_col).alias("_id"), F.col(url).alias("_url")), "_url"), rules).drop("_url")
    segment(parsed, word_counts(pages, html)).write.parquet(f"{folder}/hosts")
    hosts = pages.sparkSession.read.parquet(f"{folder}/hosts")
    # the join's key is wrapped, so that Spark can split a host of many pages; what follows reads its rows twice
    keyed = parsed.withColumn("k", F.struct("host")).join(hosts.select(F.struct("host").alias("k"), "host_words"), "k")
    keyed.select("_id", "host", "path", "rule", "rule_verdict", tokens().alias("tokens")).write.parquet(f"{folder}/rows")
    rows = pages.sparkSession.read.parquet(f"{folder}/rows")
    model = learn(rows)
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(t) for t in batch.column("tokens").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], "score"])

    scored = rows.select("_id", "host", "path", "rule", "rule_verdict", "tokens").mapInArrow(run, f"_id {kind}, host string, path string, rule string, rule_verdict string, score double")
    own = F.when(F.col("score") > 0, "block").otherwise("allow")
    return scored.select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("rule_verdict", own).alias("verdict"), "score")
