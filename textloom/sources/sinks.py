"""Sinks. Tables are keyed by document; a file for each document is never written."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def annotation_parquet(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Token rows by part and label; mode ``append`` adds to earlier ones."""
    rows.write.mode(mode).partitionBy("part", "label").parquet(path)


def annotation_tsv(rows: DataFrame, path: str) -> None:
    """One blank-line separated text for each document, by label: ``token<TAB>stem<TAB>lemma`` lines."""
    line = F.concat_ws("\t", "token", "stem", "lemma")
    sents = rows.groupBy("label", "doc_id", "sent").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", line.alias("l")))), lambda x: x["l"]), "\n").alias("s"))
    docs = sents.groupBy("label", "doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sent", "s"))), lambda x: x["s"]), "\n\n").alias("value"))
    docs.select("label", "value").write.mode("overwrite").partitionBy("label").option("lineSep", "\n\n\n").text(path)


def csv_named(rows: DataFrame, path: str, header: bool = False, separator: str = ",", null: str = "") -> None:
    """CSV as the reader takes it, all fields in quotes. ``null`` stands for nulls; where it is empty, empty strings come back as nulls."""
    options = {"quoteAll": True, "quote": '"', "escape": '"', "lineSep": "\n", "nullValue": null, "emptyValue": ""}
    rows.write.csv(path, header=header, sep=separator, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, **options)


def counts(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def embeddings_tsv(rows: DataFrame, path: str, key: str = "doc_id", vec: str = "embedding") -> None:
    """``id<TAB>f1<TAB>...`` lines, as the reader takes them; also for topic shares."""
    rows.select(F.concat_ws("\t", F.col(key).cast("string"), F.array_join(F.transform(vec, lambda x: x.cast("string")), "\t")).alias("value")).write.mode("overwrite").text(path)


def triplets_tsv(rows: DataFrame, path: str) -> None:
    rows.select("doc_id", "term", "tf").write.mode("overwrite").csv(path, sep="\t", quote="")


def head_csv(rows: DataFrame, path: str, n: int = 10) -> None:
    rows.limit(n).write.mode("overwrite").csv(path, header=True)


def report(rows: DataFrame, path: str, *order) -> None:
    """A sorted report in one file."""
    rows.orderBy(*order).coalesce(1).write.mode("overwrite").csv(path, header=True, sep="\t")


def model(fitted, path: str) -> None:
    fitted.write().overwrite().save(path)
