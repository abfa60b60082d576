"""Documents cut into fragments. Each function gives an array column of strings; ``fragments`` explodes it with ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sliding(text: Column | str, size: int = 200, step: int = 100, keep_tail: bool = True) -> Column:
    """Windows of ``size`` characters every ``step``. Without the tail: only starts that have more than ``step`` characters after them."""
    t = _col(text)
    n = F.char_length(t)
    starts = F.ceil((n - step) / step) if not keep_tail else F.greatest(F.ceil(n / step) - 0, F.lit(0))
    if keep_tail:  # a window that begins inside the last full window's reach adds nothing
        starts = F.when(n <= size, F.when(n > 0, 1).otherwise(0)).otherwise(F.ceil((n - size) / step) + 1)
    starts = starts.cast("int")
    return F.when(starts >= 1, F.transform(F.sequence(F.lit(0), starts - 1), lambda k: F.substring(t, k * step + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def fixed(text: Column | str, size: int = 100, keep_tail: bool = True) -> Column:
    """Pieces of ``size`` characters; without the tail only full ones."""
    t = _col(text)
    n = F.char_length(t)
    count = (F.ceil(n / size) if keep_tail else F.floor(n / size)).cast("int")
    return F.when(count >= 1, F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.substring(t, k * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def packed(sents: Column | str, limit: int, measure: str = "chars", keep_tail: bool = True, over: bool = False) -> Column:
    """Sentences packed in order, joined by blanks.

    measure: chars or words. A fragment ends before the sentence that would pass the limit; with ``over`` it ends after
    the sentence that reaches it. A single longer sentence is a fragment of its own. Without the tail, the last fragment
    is dropped unless it was closed by its size.
    """
    sents = _col(sents)
    size = (lambda s: F.char_length(s)) if measure == "chars" else (lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: w != "")))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("cur"), F.lit(0).alias("n"))

    def state(done: Column, cur: Column, n: Column) -> Column:
        return F.struct(done.alias("done"), cur.alias("cur"), n.cast("int").alias("n"))

    def step(s: Column, x: Column) -> Column:
        n = s["n"] + size(x)
        none = F.array().cast("array<string>")
        joined = F.concat(s["cur"], F.array(x))
        if over:
            return F.when(n >= limit, state(F.concat(s["done"], F.array(F.array_join(joined, " "))), none, F.lit(0))).otherwise(state(s["done"], joined, n))
        full = (n > limit) & (F.size(s["cur"]) > 0)
        return F.when(full, state(F.concat(s["done"], F.array(F.array_join(s["cur"], " "))), F.array(x), size(x))).otherwise(state(s["done"], joined, n))

    end = lambda s: F.when((F.size(s["cur"]) > 0) & F.lit(keep_tail), F.concat(s["done"], F.array(F.array_join(s["cur"], " ")))).otherwise(s["done"])
    return F.aggregate(sents, start, step, end)


def packed_then_cut(sents: Column | str, limit: int = 200, step: int = 100, keep_tail: bool = True, cut_at: bool = False) -> Column:
    """As packed by characters; fragments longer than the limit (with ``cut_at``: of at least it) are cut into sliding windows."""
    long = (lambda f: F.char_length(f) >= limit) if cut_at else (lambda f: F.char_length(f) > limit)
    return F.flatten(F.transform(packed(sents, limit, keep_tail=keep_tail), lambda f: F.when(long(f), sliding(f, limit, step)).otherwise(F.array(f))))


def split_overlapping(toks: Column | str, size: int, overlap: int = 0) -> Column:
    """Token arrays of ``size`` with ``overlap`` tokens in common, joined by blanks; the tail is kept."""
    t = _col(toks)
    step = size - overlap
    if step <= 0:
        raise ValueError("overlap must be smaller than size")
    n = F.size(t)
    count = F.when(n <= size, F.least(n, F.lit(1))).otherwise(F.ceil((n - size) / step) + 1).cast("int")
    windows = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.array_join(F.slice(t, k * step + 1, F.lit(size)), " "))
    return F.when(n > 0, windows).when(n == 0, F.array().cast("array<string>"))


def fragments(docs: DataFrame, pieces: Column, *metadata: str) -> DataFrame:
    """(fragment_id, doc_id, fragment_no, fragment, metadata...): the id is doc_id/fragment_no."""
    rows = docs.select("doc_id", *metadata, F.posexplode(pieces).alias("fragment_no", "fragment"))
    return rows.select(F.concat_ws("/", "doc_id", "fragment_no").alias("fragment_id"), "doc_id", "fragment_no", "fragment", *metadata)
