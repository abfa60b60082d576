"""Token counts as delta-maintained rollups.

Totals of documents and tokens by source, language and tokenizer version are sums, so a batch of changes is folded to
one signed row a group and appended. A batch is committed once: it is written aside and renamed to the folder of its id,
and a batch whose folder or whose id in a compacted base exists is left as it is. Batches can be compacted to such a base
of totals, which keeps their ids. The rename is one step on file systems that have one (HDFS, local, viewfs); on object
stores without, commit from one writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import bounded, scratch, small_batches, table, written
from .packing import WordIds, tokenizer_path

GROUP = ["source", "lang", "tokenizer"]
DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def signed(changes: DataFrame) -> DataFrame:
    """Signed sums by group of changes (op, source, lang, tokenizer, tokens, old_tokens).

    op: ``insert`` adds a document and its tokens, ``delete`` takes them away, ``revise`` replaces old_tokens by tokens.
    Any other op, a null one included, is an error when the changes are read. Null counts are 0; null source, language
    or tokenizer form groups of their own; repeated rows count each; an empty table gives an empty table.
    """
    op, new, old = F.col("op"), F.coalesce("tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    known = F.when(op.isin("insert", "delete", "revise"), op).otherwise(F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce(op, F.lit("null")))))
    docs = F.when(known == "insert", 1).when(known == "delete", -1).otherwise(0)
    tokens = F.when(op == "insert", new).when(op == "delete", -new).otherwise(new - old)
    return changes.groupBy(*GROUP).agg(F.sum(docs).cast("long").alias("n_docs"), F.sum(tokens).cast("long").alias("n_tokens"))


class Rollup:
    """Totals kept below a folder of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _store(self, path: str):
        jpath = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return jpath.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jpath

    def _names(self, folder: str) -> list[str]:
        store, path = self._store(f"{self.folder}/{folder}")
        return sorted(x.getPath().getName() for x in store.listStatus(path)) if store.exists(path) else []

    def _base(self) -> str | None:
        """The newest base."""
        names = self._names("bases")
        return f"{self.folder}/bases/{names[-1]}" if names else None

    def _held(self, base: str | None) -> DataFrame:
        """Ids of the batches that a base holds."""
        return self.spark.read.schema("batch string").parquet(f"{base}/ids") if base else self.spark.createDataFrame([], "batch string")

    def _place(self, aside: str, goal: str) -> bool:
        """Move a folder that was written aside to its place, unless that is taken."""
        (store, aside_path), (_, goal_path) = self._store(aside), self._store(goal)
        store.mkdirs(goal_path.getParent())
        # a writer that lost a race finds the goal there; some stores then move the folder into it, which is undone
        if store.exists(goal_path) or not store.rename(aside_path, goal_path):
            store.delete(aside_path, True)
            return False
        _, inside = self._store(f"{goal}/{aside.rpartition('/')[2]}")
        if store.exists(inside):
            store.delete(inside, True)
            return False
        return True

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch; False if one of this id is there already (its changes are then not read)."""
        if not batch or any(c in batch for c in "/\\"):
            raise ValueError(f"not a batch id: {batch!r}")
        goal = f"{self.folder}/batches/batch={batch}"
        store, goal_path = self._store(goal)
        if store.exists(goal_path) or self._held(self._base()).where(F.col("batch") == batch).count():
            return False
        aside = f"{self.folder}/aside/{uuid.uuid4().hex}"
        signed(changes).write.parquet(aside)
        return self._place(aside, goal)

    def _deltas(self, base: str | None) -> list[tuple[str, str]]:
        """(id, folder) of the batches that the base doesn't hold."""
        names = [n.partition("=")[2] for n in self._names("batches")]
        listed = self.spark.createDataFrame([(n,) for n in names], "batch string")
        return [(r["batch"], f"{self.folder}/batches/batch={r['batch']}") for r in listed.join(self._held(base), "batch", "left_anti").collect()]  # ids of folders

    def _sums(self, base: str | None, deltas: list[tuple[str, str]]) -> DataFrame:
        folders = [f for _, f in deltas] + ([f"{base}/totals"] if base else [])
        rows = self.spark.read.schema(DELTA).parquet(*folders) if folders else self.spark.createDataFrame([], DELTA)
        return rows.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 OR n_tokens <> 0")

    def compact(self) -> bool:
        """Fold all batches committed so far into a new base; their ids stay known, their folders go. False if another compaction won.

        A reader that has chosen its folders before keeps them to its end only if nothing is deleted under it: compact when
        no totals are being read.
        """
        base = self._base()
        deltas = self._deltas(base)
        number = int(base.rpartition("/")[2]) + 1 if base else 0
        aside = f"{self.folder}/aside/{uuid.uuid4().hex}"
        self._sums(base, deltas).write.parquet(f"{aside}/totals")
        ids = self.spark.createDataFrame([(i,) for i, _ in deltas], "batch string")
        self._held(base).union(ids).write.parquet(f"{aside}/ids")
        if not self._place(aside, f"{self.folder}/bases/{number:012d}"):
            return False
        for _, folder in deltas:
            store, path = self._store(folder)
            store.delete(path, True)
        return True

    def totals(self) -> DataFrame:
        """Current totals by group; groups whose documents and tokens have all gone are left out."""
        base = self._base()
        return self._sums(base, self._deltas(base))


def count_tokens(docs: DataFrame, word_file: str | None = None, byte_file: str | None = None) -> DataFrame:
    """docs (doc_id, source, lang, text) -> (doc_id, source, lang, digest, words, bytes, clean): ids by two public tokenizers,
    and by the second for the text with runs of white space made one blank.

    A null text is empty and has no ids; strings of special tokens are ordinary text to the second; other columns are left
    out; null ids, sources and languages are kept; repeated rows are counted each; texts are taken whole; an empty table
    gives an empty table.
    """
    small_batches(docs.sparkSession)
    word_path, byte_path = word_file or tokenizer_path(), byte_file or tokenizer_path("byte_bpe_50k.tiktoken")
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("lang", pa.string()), ("digest", pa.string()), ("words", pa.int64()), ("bytes", pa.int64()), ("clean", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pieces = WordIds(word_path), byte_pieces(byte_path)
        for batch in batches:
            counts = []
            for text in batch.column(4).to_pylist():
                plain, tidy = len(pieces(text)), " ".join(text.split())
                counts.append((len(words(text)) // 4, plain, plain if tidy == text else len(pieces(tidy))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.array([c[k] for c in counts], pa.int64()) for k in range(3))], schema=schema)

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), "source", "lang", F.md5(text).alias("digest"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, source string, lang string, digest string, words long, bytes long, clean long")


def byte_pieces(path: str):
    """Encoder of a byte-level vocabulary file of ranks."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    """Four batches over all documents: inserts for two tokenizer versions, deletes of later copies, counts of German texts revised as
    their white space is tidied; one batch is replayed, and all are compacted half-way."""
    counts = written(count_tokens(table(spark, sf_dir, "documents")), "token-counts")
    each = lambda rows, op, pairs: rows.select(F.lit(op).alias("op"), "source", "lang", F.explode(F.array(*[F.struct(F.lit(t).alias("tokenizer"), n.alias("tokens"), o.alias("old_tokens")) for t, n, o in pairs])).alias("x")).select("op", "source", "lang", "x.*")
    none, both = F.lit(None).cast("long"), [("word_bpe_49k", F.col("words")), ("byte_bpe_50k", F.col("bytes"))]
    first = bounded(written(counts.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "token-copies"))
    later = counts.join(first, "digest").where("doc_id > first")
    staying = counts.join(first, "digest", "left").where("first IS NULL OR doc_id IS NULL OR doc_id <= first")
    rollup = Rollup(spark, scratch(spark, "rollup"))
    inserted = each(counts, "insert", [(t, n, none) for t, n in both])
    rollup.commit("inserts", inserted)
    rollup.commit("copies", each(later, "delete", [(t, n, none) for t, n in both]))
    rollup.compact()
    rollup.commit("inserts", inserted)  # a replay changes nothing
    rollup.commit("revised", each(staying.where("lang = 'de'"), "revise", [("byte_bpe_50k", F.col("clean"), F.col("bytes"))]))
    return rollup.totals()
