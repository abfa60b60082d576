"""Context, prompts and answers from search results and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import sentences, words

#: Put before a question when a passage model embeds it.
QUERY_PREFIX = "Represent this sentence for searching relevant passages:"


def prefixed(question: Column | str, prefix: str = QUERY_PREFIX) -> Column:
    return F.concat(F.lit(prefix + " "), F.col(question) if isinstance(question, str) else question)


def contexts(result: DataFrame, documents: DataFrame, k: int = 5, separator: str = " ", numbered: bool = False) -> DataFrame:
    """(query_id, context): the texts of the first k hits, in rank order."""
    rows = result.where(F.col("rank") < k).join(documents.select("id", "document"), "id")
    text = F.concat((F.col("rank") + 1).cast("string"), F.lit(". "), F.col("document")) if numbered else F.col("document")
    # k rows a query at most
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", text.alias("t")))), lambda x: x["t"]), separator).alias("context"))


def prompt(context: Column | str, question: Column | str) -> Column:
    return F.format_string("Context: %s\nQuestion: %s\nAnswer:", F.col(context) if isinstance(context, str) else context, F.col(question) if isinstance(question, str) else question)


def extractive_answer(context: Column | str, question: Column | str) -> Column:
    """A stand-in for a reader model: the sentence of the context that has most words of the question, the first among equals."""
    c = F.col(context) if isinstance(context, str) else context
    q = F.array_distinct(words(question))
    sents = sentences(c)
    shared = F.zip_with(sents, F.array_repeat(q, F.size(sents)), lambda s, w: F.struct((-F.size(F.array_intersect(F.array_distinct(words(s)), w))).alias("n"), s.alias("s")))
    ranked = F.transform(shared, lambda x, i: F.struct(x["n"].alias("n"), i.alias("i"), x["s"].alias("s")))
    return F.get(F.array_sort(ranked), F.lit(0))["s"]


def overlap_f1(answer: Column | str, expected: Column | str) -> Column:
    """F1 of the distinct words two texts have in common."""
    a, b = F.array_distinct(words(answer)), F.array_distinct(words(expected))
    common = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(2 * common.cast("double"), (F.size(a) + F.size(b)).cast("double")), F.lit(0.0))


def last_turns(conversations: DataFrame, role: str = "user") -> DataFrame:
    """(conv_id, turn, text): the last turn of a role in each conversation."""
    rows = conversations.where(F.col("role") == role)
    return rows.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("text"))


def histories(conversations: DataFrame, separator: str = "\n") -> DataFrame:
    """(conv_id, history): all turns in order as ``role: text`` lines."""
    line = F.concat_ws(": ", "role", "text")
    return conversations.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("t")))), lambda x: x["t"]), separator).alias("history"))


def answer_with(rows: DataFrame, reader, context: str = "context", question: str = "question", name: str = "answer") -> DataFrame:
    """Answers by a Column function of (context, question): a pandas UDF around a model, or ``extractive_answer``."""
    return rows.withColumn(name, reader(F.col(context), F.col(question)))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    return conversations.withColumn("n", F.row_number().over(W.partitionBy("conv_id", "role").orderBy("turn")))
