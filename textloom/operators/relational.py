"""Row-level operators: ids, splits, samples, dedup, census, encodings, set operations, quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def concatenated(*cols: str, separator: str = " ") -> Column:
    """Columns joined by a separator; nulls are skipped."""
    return F.concat_ws(separator, *cols)


def row_ids(df: DataFrame, order: list[str], name: str = "row_id") -> DataFrame:
    """Gapless ids from 0 in the given order: ranges are sorted and counted apart, so no task orders all rows."""
    from ..plans.cuts import written

    parts = written(df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).withColumn("__p", F.spark_partition_id()))
    sizes = parts.groupBy("__p").agg(F.count("*").alias("n"))  # one row a partition
    before = sizes.select("__p", F.coalesce(F.sum("n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__o"))
    place = F.row_number().over(W.partitionBy("__p").orderBy(*[F.col(c).asc_nulls_first() for c in order]))
    return parts.join(F.broadcast(before), "__p").withColumn(name, F.col("__o") + place - 1).drop("__p", "__o")


def hash_split(df: DataFrame, key: str, shares: dict[str, int], name: str = "part", seed: int = 42) -> DataFrame:
    """Rows dealt to named parts by a hash of their key: shares are percents that sum to 100. Stable under any partitioning."""
    if sum(shares.values()) != 100:
        raise ValueError("shares must sum to 100")
    h = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(100))
    part, at = F.lit(None).cast("string"), 0
    for label, share in shares.items():
        part = F.when((h >= at) & (h < at + share), label).otherwise(part)
        at += share
    return df.withColumn(name, part)


def crc_split(df: DataFrame, key: str, shares: dict[str, int], name: str = "part") -> DataFrame:
    """As hash_split, by the CRC-32 of the key's decimal text, which other systems have too."""
    h = F.pmod(F.crc32(F.col(key).cast("string")), F.lit(100))
    part, at = F.lit(None).cast("string"), 0
    for label, share in shares.items():
        part = F.when((h >= at) & (h < at + share), label).otherwise(part)
        at += share
    return df.withColumn(name, part)


def digest_split(df: DataFrame, key: str, shares: dict[str, int], name: str = "part") -> DataFrame:
    """As hash_split, by the first 32 bits of the MD5 of the key's decimal text."""
    h = F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long"), F.lit(100))
    part, at = F.lit(None).cast("string"), 0
    for label, share in shares.items():
        part = F.when((h >= at) & (h < at + share), label).otherwise(part)
        at += share
    return df.withColumn(name, part)


def shuffled(df: DataFrame, seed: int = 42) -> DataFrame:
    return df.orderBy(F.rand(seed))


def sampled(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n random rows without replacement: a top-n, not a full sort."""
    return df.orderBy(F.rand(seed)).limit(n)


def sampled_with_replacement(df: DataFrame, share: float, seed: int = 42) -> DataFrame:
    return df.sample(True, share, seed)


def first_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def null_census(df: DataFrame) -> DataFrame:
    """(column, nulls) for every column."""
    sums = df.agg(*[F.sum(F.col(c).isNull().cast("int")).alias(c) for c in df.columns])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit(0)).cast("long").alias("nulls")) for c in df.columns])).alias("x")).select("x.*")


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key the one of smallest order; a grouped minimum (combined before the shuffle), not a window."""
    first = df.groupBy(key).agg(F.min_by(F.struct(*[c for c in df.columns if c != key]), order).alias("__r"))
    return first.select(*[F.col(key) if c == key else F.col(f"__r.{c}").alias(c) for c in df.columns])


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many rows repeat an earlier one's keys."""
    return df.groupBy(*keys).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"))


def at_least(counts: DataFrame, n: int, name: str = "n") -> DataFrame:
    return counts.where(F.col(name) >= n)


def vocabulary(counts: DataFrame, size: int) -> DataFrame:
    """The most frequent tokens, ties in order of the token."""
    return counts.orderBy(F.desc("n"), "token").limit(size)


def label_codes(df: DataFrame, label: str, name: str = "code") -> DataFrame:
    """Rows with the 0-based rank of their label among the distinct labels."""
    codes = df.select(label).where(F.col(label).isNotNull()).distinct()
    codes = codes.withColumn(name, F.row_number().over(W.orderBy(label)) - 1)  # distinct labels only
    return df.join(F.broadcast(codes), label, "left") if codes.count() < 100_000 else df.join(codes, label, "left")


def label_of_path(path: Column | str, levels_up: int = 1) -> Column:
    """The folder that a file lies in, or one further up."""
    return F.element_at(F.split(path, "/"), -1 - levels_up)


def label_of_id(ident: Column | str) -> Column:
    """The part of an id before its last underscore."""
    return F.regexp_extract(ident, r"^(.*)_[^_]*$", 1)


def per_class(df: DataFrame, label: str, order: list[Column | str], n: int) -> DataFrame:
    """The first n rows of each label."""
    r = F.row_number().over(W.partitionBy(label).orderBy(*order))
    return df.withColumn("__r", r).where(F.col("__r") <= n).drop("__r")


def difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b.select(key).distinct(), key, "left_anti")


def without_separators(lines: DataFrame, is_separator: Column, order: str, by: str, name: str = "sent") -> DataFrame:
    """Rows that aren't separators, with the number of separators before them in their group."""
    return lines.withColumn(name, F.sum(is_separator.cast("int")).over(W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, 0))).where(~is_separator)


def unpivoted(df: DataFrame, ids: list[str], values: list[str], variable: str = "metric", value: str = "value") -> DataFrame:
    return df.unpivot(ids, values, variable, value)
