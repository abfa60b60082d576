"""The corpus pipeline: documents in, packed training windows out.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; between stages the documents are
written as Parquet and read again. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.llm.common import bounded, columns, scratch, table, unused, written
from textloom.llm.decontaminate import phrase_matches
from textloom.llm.exact_repeats import cut_passages
from textloom.llm.langid import fit, predict
from textloom.llm.packing import pack
from textloom.llm.simhash import near_duplicates

#: Below this mean probability of the best language a document is rejected.
LEAST_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those for which no language stands out, go.

    So null, empty and blank texts go; long texts are read whole; repeated rows fare alike, null ids and null languages are
    no reason to go; an empty table stays empty; other columns are kept, whatever their names.
    """
    names = unused(docs, "held_out", "lang_pred", "score")
    kept = predict(docs, fit(docs), names).where((F.col(names[1]) != "und") & (F.col(names[2]) >= LEAST_SCORE))
    return kept.select(*columns(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest doc_id (of repeated rows one).

    Texts whose SimHash fingerprints the pigeonring brings together are compared exactly; what those leave apart, a filter
    that is complete for the similarity provides. Null and empty texts are copies of each other alone; a null id stays only where its group has no other, once; long texts
    are compared whole; an empty table stays empty; other columns are kept, whatever their names (of rows of one id and
    text, those of one row).
    """
    rows = near_duplicates(docs).groupBy("doc_id", "md5").agg(F.count("*").alias("n"), F.max("class_id").alias("class_id"))
    rows = written(rows.withColumn("gone", ~F.coalesce(F.col("doc_id") == F.col("class_id"), F.col("class_id").isNull())).where("gone OR n > 1"), "near-gone")
    mine, id_, md5 = unused(docs, "digest", "id", "md5")
    named = docs.withColumn(mine, F.md5(F.coalesce("text", F.lit(""))))
    listed = lambda which: bounded(rows.where(which).select(F.col("doc_id").alias(id_), F.col("md5").alias(md5)))
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(mine) == F.col(md5))
    once = named.join(listed("true"), same, "left_anti")
    repeated = named.join(listed("NOT gone"), same, "left_semi").dropDuplicates(["doc_id", mine])
    return once.union(repeated).select(*columns(docs))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 240 bytes, or of 51 words that take fewer, that also start elsewhere are cut out; a document of which nothing is left goes.

    Null, empty and short texts stay as they are; long texts are compared whole; all rows of a repeated text of a passage's
    length go, whatever their ids; an empty table stays empty; other columns are kept, whatever their names, but for
    n_chars, which is counted anew.
    """
    (left,) = unused(docs, "left")
    cut = cut_passages(docs, left).withColumn(left, F.trim(left))
    new = {"text": F.coalesce(left, "text"), "n_chars": F.coalesce(F.char_length(left).cast("long"), "n_chars") if "n_chars" in docs.columns else None}
    return cut.where(F.col(left).isNull() | (F.col(left) != "")).select(*[new[c].alias(c) if c in new else x for c, x in zip(docs.columns, columns(docs))])


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words in a row of a benchmark item (or a shorter item) go.

    Null and empty texts have no words and stay; long texts are searched whole; copies and repeated rows fare alike; an empty
    table stays empty; other columns are kept, whatever their names.
    """
    names = unused(docs, "n_words", "hits", "item_ids")
    return phrase_matches(docs, table(spark, sf_dir, "benchmark"), names=names).where(F.size(names[1]) == 0).select(*columns(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, placed in training windows.

    A null text is packed as an empty one, which has one token; null ids are kept; long texts are cut; repeated rows are
    packed each; an empty table gives no pieces; only doc_id and text are read, whatever else the columns are called.
    """
    return pack(docs)


STAGES = [("language ID", language), ("SimHash near-dedup", near_copies), ("suffix-array dedup", repeats), ("benchmark decontamination", decontaminated), ("packing", packed)]

#: SQL has neither the network nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, "stage-" + name.split()[0].lower())
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
