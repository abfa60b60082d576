"""Vectors as arrays of doubles: products, distances, means, expansions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


#: Numbers in a table of vectors up to which it is sent to all tasks; a larger one is joined by shuffle.
BROADCAST_NUMBERS = 1 << 24


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null if a vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def l2_squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column, space: str = "cosine") -> Column:
    """cosine: 1 - cos; l2: squared; ip: 1 - product; abs_cosine: 1 - |cos|."""
    if space == "cosine":
        return 1 - cosine(a, b)
    if space == "l2":
        return l2_squared(a, b)
    if space == "ip":
        return 1 - dot(a, b)
    if space == "abs_cosine":
        return 1 - F.abs(cosine(a, b))
    raise ValueError(f"unknown space: {space}")


def normalized(a: Column) -> Column:
    """L2-normalized; a zero vector stays."""
    n = norm(a)
    return F.when(n == 0, a).otherwise(F.zip_with(a, F.array_repeat(n, F.size(a)), lambda x, y: x / y))  # the norm is taken once


def expanded(a: Column, *functions: Callable[[Column], Column]) -> Column:
    """The vector followed by each function of its elements."""
    return F.concat(a, *[F.transform(a, f) for f in functions])


def root_abs(x: Column) -> Column:
    return F.sqrt(F.abs(x))


def zeroed(a: Column, first: int) -> Column:
    """The first places set to zero."""
    return F.concat(F.array_repeat(F.lit(0.0), first), F.slice(a, first + 1, F.greatest(F.size(a) - first, F.lit(0))))


def mean_vectors(rows: DataFrame, key: str | list[str], vec: str, divisor: Column | None = None) -> DataFrame:
    """(key, vec, dims): element-wise mean by key, over positions so that no vector is gathered; divisor replaces the row count."""
    keys = [key] if isinstance(key, str) else key
    long = rows.select(*keys, F.posexplode(vec).alias("d", "x"))
    div = F.count("*") if divisor is None else divisor
    sums = long.groupBy(*keys, "d").agg((F.sum("x") / div).alias("x"))
    return sums.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias(vec))


def document_vectors(tokens: DataFrame, table: DataFrame, dims: int, how: str = "mean", weights: DataFrame | None = None) -> DataFrame:
    """(doc_id, vector) from tokens (doc_id, sent, token) and table (token, vector); zero vectors where nothing is known.

    how: ``mean``: sum of known tokens over all tokens. ``sentences``: mean over sentences of (sum of known tokens over
    sentence length). ``known``: mean over sentences of the mean of known tokens; sentences without any are left out.
    ``distinct``: mean over the distinct known terms. ``weighted``: mean over sentences of the weighted sum over the
    document's weights (doc_id, term, weight). ``dims``: sentence sums over the vector's length, mean over sentences.
    """
    from ..plans.cuts import written

    if how not in ("mean", "distinct", "sentences", "known", "weighted", "dims"):
        raise ValueError(f"unknown mean: {how}")
    table = written(table)
    table = F.broadcast(table) if table.count() * dims <= BROADCAST_NUMBERS else table
    places = [f"x{d}" for d in range(dims)]
    sums = lambda value: [F.sum(value(F.get("vector", F.lit(d)))).alias(x) for d, x in enumerate(places)]  # noqa: E731  a vector is never spread over rows
    rows = tokens.join(table, "token", "left")
    if how == "mean":
        found = rows.groupBy("doc_id").agg(F.count("*").alias("n"), *sums(lambda x: x))
    elif how == "distinct":
        known = tokens.join(table, "token").groupBy("doc_id", "token").agg(F.first("vector").alias("vector"))
        known = known.groupBy("doc_id").agg(F.count("*").alias("n"), *sums(lambda x: x))
        found = tokens.select("doc_id").distinct().join(known, "doc_id", "left")
    elif how == "known" or "length" not in tokens.columns or "pos" not in tokens.columns:
        sents = rows.groupBy("doc_id", "sent").agg(F.count("*").alias("length"), F.count("vector").alias("k"), *sums(lambda x: x))
        size = {"sentences": F.col("length"), "known": F.col("k"), "dims": F.lit(dims), "weighted": F.lit(1)}[how]
        count = F.count(F.when(F.col("k") > 0, 1)) if how == "known" else F.count("*")
        found = sents.groupBy("doc_id").agg(count.alias("n"), *[F.sum(F.try_divide(x, size)).alias(x) for x in places])
    else:  # sentences are counted by their first tokens, so only documents are grouped
        size = F.col("length") if how == "sentences" else F.lit(dims)
        found = rows.groupBy("doc_id").agg(F.count(F.when(F.col("pos") == 0, 1)).alias("n"), *sums(lambda x: x / size))
    if how == "weighted":  # a term's weight counts once for each place where it stands
        heavy = weights.withColumnRenamed("term", "token").join(table, "token").select("doc_id", "token", "weight", "vector")
        here = tokens.join(table.select("token"), "token", "left_semi").groupBy("doc_id", "token").agg(F.count("*").alias("tf"))
        own = here.join(heavy, ["doc_id", "token"]).groupBy("doc_id").agg(*sums(lambda x: x * F.col("weight") * F.col("tf")))
        total = weights.groupBy("doc_id").agg(F.sum("weight").alias("total"))
        found = found.select("doc_id", "n").join(total, "doc_id").join(own, "doc_id", "left").select("doc_id", "n", *[F.try_divide(x, "total").alias(x) for x in places])
    return found.select("doc_id", F.array(*[F.coalesce(F.try_divide(x, "n"), F.lit(0.0)) for x in places]).alias("vector"))


def hashed_bag(toks: Column, dims: int = 64) -> Column:
    """A stand-in for a sentence model: tokens hashed to signed places, L2-normalized."""
    place = F.transform(toks, lambda t: F.pmod(F.xxhash64(t), F.lit(dims)).cast("int"))
    sums = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.size(F.filter(place, lambda p: p == d)).cast("double"))
    return normalized(sums)


def word_similarity(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """Cosine of listed word pairs (word, other, kind), the base word first."""
    a = table.select(F.col("token").alias("word"), F.col("vector").alias("__a"))
    b = table.select(F.col("token").alias("other"), F.col("vector").alias("__b"))
    return pairs.join(a, "word", "left").join(b, "other", "left").withColumn("cosine", cosine(F.col("__a"), F.col("__b"))).drop("__a", "__b")


def similar_words(table: DataFrame, positive: list[str], negative: list[str], k: int = 10) -> DataFrame:
    """The k words nearest to the sum of unit vectors of some words less those of others."""
    signs = {**{w: 1.0 for w in positive}, **{w: -1.0 for w in negative}}
    sign = F.create_map(*[F.lit(x) for kv in signs.items() for x in kv])
    chosen = table.where(F.col("token").isin(*signs)).select("token", F.transform(normalized(F.col("vector")), lambda x: x * F.element_at(sign, F.col("token"))).alias("v"))
    goal = chosen.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.sum("x").alias("x")).agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("goal"))
    return table.where(~F.col("token").isin(*signs)).crossJoin(F.broadcast(goal)).select("token", cosine(F.col("vector"), F.col("goal")).alias("cosine")).orderBy(F.desc("cosine"), "token").limit(k)
