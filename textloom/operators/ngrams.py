"""Token tables, n-grams, counts and collocation scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import words

TRIPLE = ["w1", "w2", "w3"]


def token_table(docs: DataFrame, toks: Column | None = None, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, pos, token), one row a token; ``toks`` is an array column (default: lower-cased words of text)."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(words("text") if toks is None else toks).alias("pos", "token"))


def annotation_table(docs: DataFrame, sents: Column, tokenize: Callable[[Column], Column]) -> DataFrame:
    """(doc_id, sent, pos, token, length) from sentences and a tokenizer; length: the tokens of the sentence."""
    rows = docs.select("doc_id", F.posexplode(sents).alias("sent", "s")).select("doc_id", "sent", tokenize(F.col("s")).alias("toks"))
    return rows.select("doc_id", "sent", F.size("toks").alias("length"), F.posexplode("toks").alias("pos", "token")).select("doc_id", "sent", "pos", "token", "length")


def token_counts(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("token").agg(F.count("*").alias("n"))


def ngram_structs(toks: Column, n: int = 3, padded: bool = False) -> Column:
    """All runs of n neighbouring tokens of an array as structs w1..wn; padded: also the runs that begin in the last n - 1 places, filled with nulls.

    The runs are the array zipped with itself moved on, so the tokens are taken once a place and not once a run.
    """
    size = F.size(toks) if padded else F.greatest(F.size(toks) - (n - 1), F.lit(0))
    moved = [F.slice(toks, F.lit(k + 1), size) if k else F.slice(toks, F.lit(1), size) for k in range(n)]
    return F.transform(F.arrays_zip(*moved), lambda x: F.struct(*[x[str(k)].alias(f"w{k + 1}") for k in range(n)]))


def triples(docs: DataFrame, toks: Column, padded: bool = False) -> DataFrame:
    """(doc_id, w1, w2, w3). The runs stay inside ``toks``, so an array a document crosses sentences and one a sentence doesn't. No shuffle."""
    return docs.select("doc_id", F.inline(ngram_structs(toks, 3, padded)))


def triple_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*TRIPLE).agg(F.count("*").alias("f"))


def marginals(counts: DataFrame) -> DataFrame:
    """Counts by first word, first two, outer two and all three, from counts of padded triples (w1, w2, w3, f): (level, w1, w2, w3, f).

    Each level is summed up from counts, the first words from those of the first two; give a written table.
    """
    none = F.lit(None).cast("string")
    two = counts.groupBy("w1", "w2").agg(F.sum("f").alias("f"))
    return (
        counts.select(F.lit("w1_w2_w3").alias("level"), *TRIPLE, "f")
        .union(two.select(F.lit("w1_w2"), "w1", "w2", none, "f"))
        .union(counts.groupBy("w1", "w3").agg(F.sum("f").alias("f")).select(F.lit("w1_w3"), "w1", none, "w3", "f"))
        .union(two.groupBy("w1").agg(F.sum("f").alias("f")).select(F.lit("w1"), "w1", none, none, "f"))
    )


def scored(counts: DataFrame, unigrams: DataFrame, size: DataFrame, measure: Callable[..., Column], name: str = "score") -> DataFrame:
    """counts (w1, w2, w3, f) with c1, c2, c3 from unigrams (token, n), corpus size from the one row of size (n), and the score.

    The vocabulary grows with the corpus, so no join is forced to be a broadcast; the planner broadcasts a small one.
    """
    out = counts
    for k, w in enumerate(TRIPLE, 1):
        out = out.join(unigrams.select(F.col("token").alias(w), F.col("n").alias(f"c{k}")), w)
    out = out.crossJoin(F.broadcast(size.select(F.col("n").alias("size"))))  # one row
    return out.select(*TRIPLE, "f", "c1", "c2", "c3", measure(F.col("f"), F.col("c1"), F.col("c2"), F.col("c3"), F.col("size")).alias(name))


def top(scores: DataFrame, k: int, name: str = "score", lowest: bool = False) -> DataFrame:
    """First k by score, ties by words."""
    return scores.orderBy(F.asc(name) if lowest else F.desc(name), *TRIPLE).limit(k)
