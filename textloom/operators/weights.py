"""Sparse term weights: (doc_id, term, weight) tables; a dense matrix is never built."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def term_counts(tokens: DataFrame) -> DataFrame:
    """(doc_id, term, tf) from (doc_id, token)."""
    return tokens.groupBy("doc_id", F.col("token").alias("term")).agg(F.count("*").alias("tf"))


def term_counts_in_rows(docs: DataFrame, toks: Column, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, term, tf, length) of a table with one row a document: counted inside the row, so nothing is shuffled.

    The tokens are sorted; a term's count is the distance between the places where it and the next one begin.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.sort_array(toks).alias("s"))
    first = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: (i == 0) | (F.get("s", i) != F.get("s", i - 1)))
    rows = rows.where(F.size("s") > 0).select("doc_id", "s", F.concat(first, F.array(F.size("s"))).alias("b"))
    terms = F.transform(F.slice("b", F.lit(1), F.size("b") - 1), lambda at, k: F.struct(F.get("s", at).alias("term"), (F.get("b", k + 1) - at).cast("long").alias("tf")))
    return rows.select("doc_id", F.size("s").cast("long").alias("length"), F.inline(terms)).select("doc_id", "term", "tf", "length")


def run_lengths(items: Column) -> Column:
    """How often each item of a sorted array occurs, in order; the array is taken once."""

    def lengths(s: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        gaps = F.transform(F.array(F.concat(first, F.array(F.size(s)))), lambda b: F.transform(F.slice(b, F.lit(1), F.size(b) - 1), lambda at, k: (F.get(b, k + 1) - at).cast("long")))
        return F.when(F.size(s) > 0, F.get(gaps, F.lit(0))).otherwise(F.array().cast("array<bigint>"))

    return F.get(F.transform(F.array(items), lambda s: F.when(s.isNotNull(), lengths(s))), F.lit(0))


def document_frequency(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def _ln_ratio(n: Column, df: Column) -> Column:
    return F.log(n / df)


#: idf by name, of the number of documents and the document frequency.
IDF = {
    "ln_ratio": _ln_ratio,
    "ln_smooth": lambda n, df: F.log((n + 1) / (df + 1)),
    "log10_smooth": lambda n, df: F.log10(n + 1) - F.log10(df + 1),
    "ln_plus_one": lambda n, df: F.log(n / df + 1),
    "ln_one_plus": lambda n, df: F.log(1 + n / (1 + df)),
}


def tf_idf(tf: DataFrame, docs: DataFrame, idf: str = "ln_smooth", relative: bool = False, lengths: DataFrame | None = None, df: DataFrame | None = None) -> DataFrame:
    """(doc_id, term, weight): tf times one of IDF. docs: the documents counted (one row each).

    relative: tf is divided by the document's length, from a column of tf, from lengths (doc_id, length) or else the sum
    of its tf. df: document frequencies, if they are at hand. tf is read for each of these: give a written table.
    """
    df = document_frequency(tf) if df is None else df
    n = docs.agg(F.count("*").cast("double").alias("n"))
    rows = tf.join(df, "term").crossJoin(F.broadcast(n))
    count = F.col("tf").cast("double")
    if relative:
        if "length" not in tf.columns and lengths is None:
            lengths = tf.groupBy("doc_id").agg(F.sum("tf").alias("length"))
        rows = rows if lengths is None else rows.join(lengths, "doc_id")
        count = count / F.col("length")
    return rows.select("doc_id", "term", (count * IDF[idf](F.col("n"), F.col("df").cast("double"))).alias("weight"))


def l2_normalized(weights: DataFrame) -> DataFrame:
    norm = weights.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return weights.join(norm, "doc_id").select("doc_id", "term", F.coalesce(F.try_divide("weight", "norm"), F.lit(0.0)).alias("weight"))


def category_weights(tokens: DataFrame) -> DataFrame:
    """(category, term, weight) from (category, line, token): lines that hold a term, ln(1 + categories / those with the term), L2-normalized by category."""
    lines = tokens.select("category", "line", "token").distinct().groupBy("category", F.col("token").alias("term")).agg(F.count("*").alias("tf"))
    spread = lines.groupBy("term").agg(F.count("*").alias("df"))
    all_ = tokens.agg(F.countDistinct("category").cast("double").alias("c"))
    raw = lines.join(spread, "term").crossJoin(F.broadcast(all_)).select(F.col("category").alias("doc_id"), "term", (F.col("tf") * F.log(1 + F.col("c") / F.col("df"))).alias("weight"))
    return l2_normalized(raw).withColumnRenamed("doc_id", "category")


def position_weights(tokens: DataFrame) -> DataFrame:
    """(doc_id, pos, weight) from (doc_id, sent, pos, token): tf over sentence length times ln(1 + N / (1 + df)) at each place of a sentence,
    sentences padded with zeros to the document's longest one, mean over its sentences. N and df count sentences."""
    sents = tokens.groupBy("doc_id", "sent").agg(F.count("*").alias("length"))
    tf = tokens.groupBy("doc_id", "sent", "token").agg(F.count("*").alias("tf"))
    df = tf.groupBy("token").agg(F.count("*").alias("df"))
    n = sents.agg(F.count("*").cast("double").alias("n"))
    many = sents.groupBy("doc_id").agg(F.count("*").alias("sents"))
    rows = tokens.join(tf, ["doc_id", "sent", "token"]).join(sents, ["doc_id", "sent"]).join(df, "token").crossJoin(F.broadcast(n)).join(many, "doc_id")
    value = F.col("tf") / F.col("length") * F.log(1 + F.col("n") / (1 + F.col("df"))) / F.col("sents")
    return rows.groupBy("doc_id", "pos").agg(F.sum(value).alias("weight"))


def cosine_pairs(weights: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, cosine) of listed document pairs, through their common terms."""
    norm = weights.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    left = weights.select(F.col("doc_id").alias("a"), "term", F.col("weight").alias("x"))
    right = weights.select(F.col("doc_id").alias("b"), "term", F.col("weight").alias("y"))
    dot = pairs.join(left, "a").join(right, ["b", "term"]).groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    out = pairs.join(dot, ["a", "b"], "left").join(norm.select(F.col("doc_id").alias("a"), F.col("norm").alias("na")), "a", "left").join(norm.select(F.col("doc_id").alias("b"), F.col("norm").alias("nb")), "b", "left")
    return out.select("a", "b", F.coalesce(F.try_divide(F.col("dot"), F.col("na") * F.col("nb")), F.lit(0.0)).alias("cosine"))


def terms_above_percentile(counts: DataFrame, share: float = 0.8) -> DataFrame:
    """Terms whose count is at least the linear percentile of all counts (token, n)."""
    cut = counts.agg(F.percentile("n", share).alias("cut"))
    return counts.crossJoin(F.broadcast(cut)).where("n >= cut").select("token", "n")


def ranked_in_document(weights: DataFrame, k: int) -> DataFrame:
    """The k heaviest terms of each document."""
    r = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("weight"), "term"))
    return weights.withColumn("rank", r).where(F.col("rank") <= k)
