"""Sources. Schemas are given, never inferred, and a sentence index is a column, never a separator row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

TITLED = "label string, title string, text string"
_CSV = {"multiLine": True, "escape": '"', "quote": '"'}


def csv_named(spark: SparkSession, path: str, schema: str = TITLED, header: bool = False, separator: str = ",", encoding: str = "UTF-8", line_end: str | None = None, null: str = "") -> DataFrame:
    """CSV of a given schema, with or without a header; quoted fields may hold line ends.

    Without ``line_end`` the first line end of a file, be it inside quotes, counts as that of the file, and others are changed
    to it. ``null`` is what nulls are written as; if it isn't empty, an empty string stays one.
    """
    known = {"lineSep": line_end} if line_end else {}
    return spark.read.schema(schema).csv(path, header=header, sep=separator, encoding=encoding, nullValue=null, emptyValue="", **known, **_CSV)


def load(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """Any format that Spark reads, by name."""
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def text_tree(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(path, part, label, name, text): one row a file of a ``part/label/name`` tree, read whole in any encoding."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    parts = F.split("path", "/")
    return files.select("path", F.element_at(parts, -3).alias("part"), F.element_at(parts, -2).alias("label"), F.element_at(parts, -1).alias("name"), F.decode("content", encoding).alias("text"))


def whole_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, text): one row a file below the paths."""
    return spark.read.text(paths, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def annotations(files: DataFrame, columns: list[str], separator: str = "\n\n", header: bool = False) -> DataFrame:
    """(path, sent, pos, columns...) from whole annotation files (path, text).

    Sentences are parted by ``separator`` (a blank line; a line of tabs also counts), tokens by line ends, fields by tabs.
    """
    text = F.regexp_replace("text", "\r\n", "\n")
    if header:
        text = F.regexp_replace(text, r"^[^\n]*\n", "")
    sents = F.split(text, r"\n[\t ]*\n" if separator == "\n\n" else separator)
    lines = files.select("path", F.posexplode(F.filter(F.transform(sents, lambda s: F.filter(F.split(s, "\n"), lambda x: F.trim(F.replace(x, F.lit("\t"), F.lit(""))) != "")), lambda s: F.size(s) > 0)).alias("sent", "rows"))
    rows = lines.select("path", "sent", F.posexplode("rows").alias("pos", "line"))
    fields = F.split("line", "\t")
    return rows.select("path", "sent", "pos", *[F.get(fields, F.lit(k)).alias(c) for k, c in enumerate(columns)])


def marked_annotations(lines: DataFrame, order: str, key: str, token: str = "token", marker: str = "<endofsentence>") -> DataFrame:
    """Token rows of one table with marker rows between sentences: rows without markers, with a sentence index."""
    sep = F.col(token).isNull() | (F.col(token) == marker)
    index = F.sum(sep.cast("int")).over(W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return lines.withColumn("sent", index).where(~sep)


def embeddings_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, embedding) from ``id<TAB>f1<TAB>...`` lines; a trailing tab is ignored."""
    f = F.split(F.regexp_replace("value", r"\t+$", ""), "\t")
    return spark.read.text(path).where("value <> ''").select(F.get(f, F.lit(0)).alias("doc_id"), F.slice(f, 2, F.size(f)).cast("array<double>").alias("embedding"))


def triplets_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, term, tf)"""
    return spark.read.schema("doc_id string, term string, tf long").csv(path, sep="\t", quote="")


def counts_json(spark: SparkSession, path: str) -> DataFrame:
    """(token, n) from a JSON object of counts."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,bigint>")).alias("token", "n"))


def mapping_lines(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) from flat ``key: value`` lines, as in a one-level YAML file; comments and blank lines are skipped."""
    v = F.trim("value")
    return spark.read.text(path).where((v != "") & ~v.startswith("#") & v.contains(": ")).select(F.trim(F.substring_index("value", ": ", 1)).alias("key"), F.trim(F.regexp_replace("value", r"^.*?: ", "")).alias("value"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(part, path) from a JSON object of lists of paths."""
    lists = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("part", "paths"))
    return lists.select("part", F.explode("paths").alias("path"))


def of_manifest(files: DataFrame, listed: DataFrame, part: str) -> DataFrame:
    """Rows whose path a part of the manifest lists."""
    return files.join(listed.where(F.col("part") == part).select("path"), "path", "left_semi")


def labels_of(files: DataFrame, level: int = -2) -> DataFrame:
    """The distinct folder names at a level of the paths."""
    return files.select(F.element_at(F.split("path", "/"), level).alias("label")).distinct()


def latin1(content: Column | str) -> Column:
    return F.decode(content, "ISO-8859-1")


#: Bytes up to which a Parquet table is dealt out anew: so small a one has few row groups, which would keep few cores busy.
SMALL_TABLE = 32 << 20


def dealt_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table; a small one in as many parts as there are cores, any other as its row groups lie."""
    rows = spark.read.parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    size = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(hadoop).getLength()
    return rows.repartition(spark.sparkContext.defaultParallelism) if size <= SMALL_TABLE else rows


def saved_model(spark: SparkSession, path: str):
    """A fitted model of any of Spark's kinds, as ``sinks`` saved it."""
    from pyspark.ml.util import DefaultParamsReader

    return DefaultParamsReader.loadParamsInstance(path, spark)
