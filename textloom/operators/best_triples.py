"""The k best triples by a measure, exact, without shuffling all triples.

The k-th best score of some triples (those of one residue of a hash, fully counted) is no better than that of all triples.
A triple whose bound is worse can't be among the k best, so its rows are dropped where the text is read. Bounds come
from the counts of frequent words, which every task holds, and for measures that grow with the count of a triple from
counts of hashed triples, of which a triple's own count is a part. What is left is counted and scored in full.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from . import ngrams

#: One in so many distinct triples gives the score to beat; places of hashed counts; frequent words are those with over one in so many tokens.
RESIDUES, PLACES, SHARE = 64, 1 << 20, 1_000_000

#: Measures that are powers of f where a rare word occurs f times: the bound lies at one of the ends of f.
POWERS = ("mi", "mi_marginal", "mi_two", "mi_root", "mi_single", "mi_like")


def _bound(name: str, measure: Callable[..., Column], words: list[Column], most: Column, rare: int, n: Column) -> Column:
    """The highest score of a triple of words with these counts (null: less than ``rare``) that occurs ``most`` times at most."""
    at = lambda f, low: measure(f, *[F.coalesce(c, low) for c in words], n)
    one = F.lit(1)
    if name in POWERS:
        return F.greatest(at(one, one), at(most, most))
    if name == "log_likelihood":  # words that are rare occur f times at least; f is at least 1
        product = [F.coalesce(c, one).cast("double") for c in words]
        known = words[0].isNotNull() & words[1].isNotNull() & words[2].isNotNull()
        ratio = F.when(known, most).otherwise(one) * n / (product[0] * product[1] * product[2])
        return 2 * most * F.greatest(F.lit(0.0), F.log2(ratio))
    return at(most, one)  # t-scores grow with f and fall with the words' counts


def _reach(name: str, m: Column, n: float) -> Column:
    """The highest score of a triple that occurs m times at most, whatever its words."""
    if name != "log_likelihood":
        return F.sqrt(m.cast("double"))
    f = F.least(m.cast("double"), F.lit(max(1.0, math.sqrt(n) / math.e)))
    return F.greatest(F.lit(0.0), 2 * f * F.log2(F.lit(n) / (f * f)))


def best_triples(triples: DataFrame, unigrams: DataFrame, size: float, name: str, measure: Callable[..., Column], k: int, lowest: bool = False, first: bool = False) -> DataFrame:
    """(w1, w2, w3, f, score) of the k first by score, rounded to six places, ties by words.

    unigrams: (token, n), as a written table; first: they count words as first of a triple, so only w1's count bounds f.
    """
    spark = triples.sparkSession
    one_row = spark.range(1).select(F.lit(float(size)).alias("n"))
    places = F.pmod(F.xxhash64(*ngrams.TRIPLE), F.lit(RESIDUES * PLACES))

    def top(rows: DataFrame) -> DataFrame:
        scored = ngrams.scored(ngrams.triple_counts(rows), unigrams, one_row, measure)
        return ngrams.top(scored.withColumn("score", F.round("score", 6)), k, lowest=lowest).select(*ngrams.TRIPLE, "f", "score")

    some = top(triples.where(places % RESIDUES == 0)).collect()  # k rows
    if len(some) < k:
        return top(triples)
    goal = some[-1]["score"]
    goal += (1 if lowest else -1) * 1e-6 * (2 + abs(goal))  # the bounds aren't rounded
    tokens = unigrams.agg(F.sum("n")).first()[0]
    rare = max(2, -(-tokens // SHARE))
    often = F.broadcast(unigrams.where(F.col("n") >= rare))  # at most SHARE words
    rows = triples
    for c, w in zip("abc", ngrams.TRIPLE):
        rows = rows.join(often.select(F.col("token").alias(w), F.col("n").alias(c)), w, "left")
    words, n = [F.col(c) for c in "abc"], F.lit(float(size))
    if lowest:  # mutual information falls with the words' counts, and f is 1 at least
        return top(rows.where(measure(F.lit(1), *[F.coalesce(c, F.lit(rare)) for c in words], n) <= goal).select(*ngrams.TRIPLE))
    most = F.coalesce("a", F.lit(rare)) if first else F.least(*[F.coalesce(c, F.lit(rare)) for c in words])
    if name not in POWERS:
        held = F.floor(places / RESIDUES).cast("int")
        heavy = triples.groupBy(held.alias("place")).agg(F.count("*").alias("m")).where(_reach(name, F.col("m"), float(size)) >= goal)
        rows = rows.withColumn("place", held).join(F.broadcast(heavy), "place")  # at most PLACES rows
        most = F.least(most, F.col("m"))
    return top(rows.where(_bound(name, measure, words, most, rare, n) >= goal).select(*ngrams.TRIPLE))
