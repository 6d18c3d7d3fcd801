"""Neighbour lists and the scores of words by the known terms among their neighbours."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import WEIGHTS, neighbour_weight

#: The score of a word without a known neighbour in the distance modes.
NONE_SCORE = -1e9


def neighbour_limit(neighbourhoods: DataFrame) -> DataFrame:
    """(neighbour_limit): the least number of neighbours of the words that have any."""
    return neighbourhoods.filter(F.size("neighbours") > 0).agg(F.min(F.size("neighbours")).alias("neighbour_limit"))


def explode_neighbours(neighbourhoods: DataFrame, limit: int | None = None, skip: Sequence[int] = ()) -> DataFrame:
    """(src, pos, query, label, rank, nword, nlabel, cossim): one row per neighbour, the first `limit` of each.

    Words of a label in skip and words without neighbours are left out; repeated words stay.
    """
    rows = neighbourhoods.filter(F.size("neighbours") > 0)
    if skip:
        rows = rows.filter(~F.coalesce(F.col("label").isin(*skip), F.lit(False)))
    taken = F.slice("neighbours", 1, limit) if limit else F.col("neighbours")
    rows = rows.select("src", "pos", F.col("word").alias("query"), "label", F.posexplode(taken).alias("at", "n"))
    return rows.select("src", "pos", "query", "label", (F.col("at") + 1).alias("rank"), F.col("n.word").alias("nword"), F.col("n.label").alias("nlabel"), F.col("n.cossim").cast("double").alias("cossim"))


def first_long_enough(neighbourhoods: DataFrame, limit: int) -> DataFrame:
    """Of each word the first occurrence, by file and place, that has at least `limit` neighbours, cut to them."""
    rows = neighbourhoods.filter(F.size("neighbours") >= limit)
    order = Window.partitionBy("word").orderBy("src", "pos")
    rows = rows.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")
    return rows.withColumn("neighbours", F.slice("neighbours", 1, limit))


def weighted(nbr: DataFrame, distance: str = "distance", weights: Sequence[str] = WEIGHTS) -> DataFrame:
    """nbr once per weight type, with weight_type and w."""
    each = F.array(*[F.struct(F.lit(k).alias("weight_type"), neighbour_weight(distance, k).alias("w")) for k in weights])
    return nbr.withColumn("_x", F.explode(each)).select(*nbr.columns, "_x.weight_type", "_x.w")


def prefix_votes(nbr: DataFrame, keys: Sequence[str] = ("query",), distance: str = "distance", weights: Sequence[str] = WEIGHTS) -> DataFrame:
    """(keys, weight_type, n, vote, vote_norm) for every prefix length n: sums of weight * nlabel over the n nearest.

    vote_norm divides by the weights' sum + 1e-12. Labels count as numbers.
    """
    rows = weighted(nbr, distance, weights)
    upto = Window.partitionBy(*keys, "weight_type").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    vote = F.sum(F.col("w") * F.coalesce("nlabel", F.lit(0))).over(upto)
    return rows.select(*keys, "weight_type", F.col("rank").alias("n"), vote.alias("vote"), (vote / (F.sum("w").over(upto) + F.lit(1e-12))).alias("vote_norm"))


def prefix_distances(nbr: DataFrame, keys: Sequence[str] = ("query",), distance: str = "distance") -> DataFrame:
    """(keys, n, mindist, avgdist, central_mean, central_median) over the n nearest.

    mindist and avgdist: minus the least and mean distance of neighbours with nlabel > 0, NONE_SCORE without
    any; central_*: mean and median of all n distances.
    """
    upto = Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    d, known = F.col(distance), F.when(F.col("nlabel") > 0, F.col(distance))
    none = F.lit(NONE_SCORE)
    return nbr.select(
        *keys,
        F.col("rank").alias("n"),
        F.coalesce(-F.min(known).over(upto), none).alias("mindist"),
        F.coalesce(-F.avg(known).over(upto), none).alias("avgdist"),
        F.avg(d).over(upto).alias("central_mean"),
        F.percentile(d, 0.5).over(upto).alias("central_median"),
    )


def graph_features(nbr: DataFrame, members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, query, vote, mindist, avgdist, cnt): sum, largest, mean and number of similarities to neighbours among the members."""
    rows = nbr.join(members.select(*keys, F.col("word").alias("nword")), "nword")
    return rows.groupBy(*keys, "query").agg(F.sum("cossim").alias("vote"), F.max("cossim").alias("mindist"), F.avg("cossim").alias("avgdist"), F.count("*").alias("cnt"))


def member_hits(nbr: DataFrame, members: DataFrame) -> DataFrame:
    """(word, hits): of each word the neighbours that are any key's members, with their similarities."""
    rows = nbr.join(members.select(F.col("word").alias("nword")).distinct(), "nword", "left_semi")
    return rows.groupBy(F.col("query").alias("word")).agg(F.collect_list(F.struct("nword", F.col("cossim").cast("double").alias("cossim"))).alias("hits"))


class Linked:
    """Of a unit's words (units.meet) what graph_features has for each key, from their member_hits."""

    def __init__(self, hits: pa.Array, keys: int):
        word, sims = hits.flatten().flatten()
        sizes = pa.compute.list_value_length(hits).fill_null(0).to_numpy(zero_copy_only=False)
        self.words, self.sims, self.row = word.to_pylist(), sims.to_numpy(), np.repeat(np.arange(len(hits)), sizes)
        self.vote, self.n, self.most = np.zeros((len(hits), keys)), np.zeros((len(hits), keys), np.int64), np.full((len(hits), keys), -np.inf)

    def add(self, words: pa.Array, holds: np.ndarray) -> None:
        place = {w: j for j, w in enumerate(words.to_pylist())}
        at = np.array([place.get(w, -1) for w in self.words], int)
        met = np.flatnonzero(at >= 0)
        for a in range(0, len(met), 4096):
            some = met[a : a + 4096]
            held, row, sims = holds[at[some]], self.row[some], self.sims[some, None]
            np.add.at(self.vote, row, held * sims)
            np.add.at(self.n, row, held)
            np.maximum.at(self.most, row, np.where(held, sims, -np.inf))

    def result(self, a: int, b: int) -> tuple[list[np.ndarray], np.ndarray]:
        """vote, mindist, avgdist and cnt; 0 where there is no hit."""
        n, vote = self.n[a:b], self.vote[a:b]
        return [vote, np.where(n > 0, self.most[a:b], 0.0), vote / np.maximum(n, 1), n.astype(float)], n > 0


def list_spans(nbr: DataFrame, members: DataFrame, keys: Sequence[str], limit: int, mode: str = "vote", distance: str = "distance", weights: Sequence[str] = WEIGHTS) -> DataFrame:
    """(keys, weight_type, low, high, query, score): list_scores with a row for all n from low to high, between which a score stays."""
    rows = nbr.filter(F.col("rank") <= limit).join(members.select(*keys, F.col("word").alias("nword")), "nword")
    # sums up to each member, which hold until the next one: a row per prefix length comes only after the shuffle
    rows = rows.groupBy(*keys, "query").agg(F.array_sort(F.collect_list(F.struct("rank", F.col(distance).alias("d")))).alias("hits"))  # `limit` at most
    rows = rows.select(*keys, "query", F.posexplode("hits").alias("at", "hit"), "hits")
    last = F.coalesce(F.try_element_at("hits", F.col("at") + 2)["rank"] - 1, F.lit(limit))
    upto = F.transform(F.slice("hits", 1, F.col("at") + 1), lambda h: h["d"])
    if mode == "vote":
        kinds = F.array(*[F.struct(F.lit(w).alias("weight_type"), F.aggregate(F.transform(upto, lambda d: neighbour_weight(d, w)), F.lit(0.0), lambda a, x: a + x).alias("score")) for w in weights])
    else:
        score = -F.array_min(upto) if mode == "mindist" else -F.aggregate(upto, F.lit(0.0), lambda a, x: a + x) / F.size(upto)
        kinds = F.array(F.struct(F.lit("constant").alias("weight_type"), score.alias("score")))
    rows = rows.filter(F.col("hit.rank") <= last).select(*keys, "query", F.col("hit.rank").alias("low"), last.alias("high"), F.explode(kinds).alias("x"))
    return rows.select(*keys, "x.weight_type", "low", "high", "query", F.round("x.score", 10).alias("score"))


def list_scores(nbr: DataFrame, members: DataFrame, keys: Sequence[str], limit: int, mode: str = "vote", distance: str = "distance", weights: Sequence[str] = WEIGHTS) -> DataFrame:
    """(keys, weight_type, n, query, score) for n = 1..limit where any of the n nearest neighbours is a member.

    Only members' rows take part, so that the grid stays sparse; words without a row have the mode's
    default score (default_score). vote sums weights; mindist and avgdist are minus a distance and know no
    weight type, which is then `constant`.
    """
    rows = list_spans(nbr, members, keys, limit, mode, distance, weights)
    return rows.select(*keys, "weight_type", F.explode(F.sequence("low", "high")).alias("n"), "query", "score")


def default_score(mode: str) -> float:
    return 0.0 if mode == "vote" else NONE_SCORE
