"""A position-tracking lexer: typed tokens that cover the text without gaps."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .patterns import ABBREVIATIONS, FOREIGN_PHONES, LEXER_KINDS

TOKEN = "array<struct<pos:int,kind:string,text:string>>"
#: Characters of the texts whose tokens a worker holds at a time (or one text), and tokens in a batch of rows.
CHARS, TOKENS = 1 << 18, 1 << 16


def kinds(news: bool = True) -> list[tuple[str, str]]:
    """The kinds in priority order: with abbreviations and numbers (news), or with foreign phone numbers instead."""
    if news:
        return [("abbrev", "|".join(f"(?i:{re.escape(a)})" for a in ABBREVIATIONS)), *LEXER_KINDS]
    rest = [k for k in LEXER_KINDS if k[0] not in ("numeral", "number")]
    return [*rest[:2], *FOREIGN_PHONES, *rest[2:]]


def lexed(text: str, news: bool = True) -> Iterator[tuple[int, str, str]]:
    for m in _PATTERNS[news].finditer(text):
        kind, part = m.lastgroup, m.group()
        if kind == "abbrev":
            kind, part = "word", ABBREVIATIONS[part.lower()]
        yield m.start(), kind, part


def lex(text: str, news: bool = True) -> list[tuple[int, str, str]]:
    return list(lexed(text, news))


_PATTERNS = {news: re.compile("|".join(f"(?P<{k}>{p})" for k, p in kinds(news))) for news in (True, False)}


def typed_tokens(news: bool = True):
    """A pandas UDF: text -> array of (pos, kind, text). A batch's tokens are held for some of its texts at a time."""

    @F.pandas_udf(TOKEN)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            run_of = (texts.str.len().fillna(0).cumsum() // CHARS).astype("int64")
            for _, few in texts.groupby(run_of.to_numpy(), sort=False):
                yield few.map(lambda t: None if t is None else [{"pos": a, "kind": b, "text": c} for a, b, c in lexed(t, news)])

    return run


def typed_rows(docs: DataFrame, id_col: str = "doc_id", text: str = "text", news: bool = True) -> DataFrame:
    """(doc_id, pos, kind, text), one row a token. Tokens leave a worker in batches of TOKENS, so not even those of one text are held at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            tokens = ((k, *x) for k, t in enumerate(batch.column(1)) if t.is_valid for x in lexed(t.as_py(), news))
            while some := list(islice(tokens, TOKENS)):
                row, pos, kind, part = zip(*some)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row, pa.int64())), pa.array(pos, pa.int32()), pa.array(kind, pa.string()), pa.array(part, pa.string())], ["doc_id", "pos", "kind", "text"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, pos int, kind string, text string")
