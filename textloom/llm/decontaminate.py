"""Benchmark decontamination over a positional inverted index (DataFrame functions only).

The terms of the test items are counted in the corpus first. For each window of an item, the positions of its rarest terms
are its anchors; the index stores the corpus postings (term, document key, position) of the anchors' terms, which are few.
The anchors' posting lists, moved back by their offsets, are intersected: only places where an item's anchors fall on one
alignment are candidates. The words of candidates are then compared along the alignment, which gives the exact phrase
matches. Equal texts have one key, and are compared once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, bounded, columns, table, unused, written

WINDOW = 10
#: Rarest terms of a window whose lists are intersected.
RAREST = 2
_GAPS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text: runs of letters a-z (A-Z lower-cased), digits and all characters beyond ASCII; none for null."""
    return F.coalesce(F.filter(F.split(ascii_lower(text), _GAPS), lambda w: w != ""), F.array().cast("array<string>"))


def item_table(items: DataFrame) -> DataFrame:
    """(item, words, ids): the distinct word sequences of the items, with the ids (as strings) that have them."""
    words = items.select(F.col("item_id").cast("string").alias("id"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    return words.groupBy("words").agg(F.collect_set("id").alias("ids")).select(F.xxhash64("words").alias("item"), "words", "ids")


def corpus_counts(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(term, n): how often each term of the items (words) stands in docs (text); written. Combined before the shuffle."""
    terms = items.select(F.explode("words").alias("term")).distinct()
    placed = docs.select(F.explode(words_of(F.col("text"))).alias("term"))
    return written(placed.join(bounded(terms), "term").groupBy("term").agg(F.count("*").alias("n")), "term-counts")


def build_index(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Postings (term, key, pos) of docs (key, text), written to the shared folder; all terms, or only those of ``terms`` (term).

    Null and empty texts have no postings; rows of one key have theirs each; texts of any length are taken whole; an
    empty table gives an empty index; other columns are left out.
    """
    postings = docs.select("key", F.posexplode(words_of(F.col("text"))).alias("pos", "term"))
    if terms is not None:
        postings = postings.join(bounded(terms), "term")
    return written(postings.select("term", "key", "pos"), "postings")


def anchors(items: DataFrame, frequencies: DataFrame, window: int, rarest: int = RAREST) -> DataFrame:
    """(item, term, anchor): positions of the rarest terms of every window of which all terms occur in the corpus."""
    placed = items.select("item", F.posexplode("words").alias("pos", "term"))
    placed = placed.join(frequencies, "term", "left").groupBy("item").agg(F.sort_array(F.collect_list(F.struct("pos", "term", F.col("n")))).alias("p"))
    size = F.size("p")
    span = F.least(size, F.lit(window))

    def best(start: Column) -> Column:
        terms = F.slice("p", start, span)
        ranked = F.sort_array(F.transform(terms, lambda x: F.struct(x["n"].alias("n"), x["pos"].alias("pos"), x["term"].alias("term"))))
        return F.when(F.exists(terms, lambda x: x["n"].isNull()), F.array().cast(ranked_type)).otherwise(F.slice(ranked, 1, rarest))

    ranked_type = "array<struct<n:bigint,pos:int,term:string>>"
    chosen = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), size - span + 1), best)))
    return placed.select("item", F.explode(chosen).alias("a")).select("item", F.col("a.term").alias("term"), F.col("a.pos").alias("anchor"))


def alignments(index: DataFrame, chosen: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Candidates (key, item, shift): document position minus item position where enough of an item's anchors (chosen) meet."""
    lists = index.join(bounded(chosen), "term").select("key", "item", (F.col("pos") - F.col("anchor")).alias("shift"), "anchor")
    met = lists.groupBy("key", "item", "shift").agg(F.min("anchor").alias("a"), F.max("anchor").alias("b"))
    single = items.where((F.size("words") == 1) | (F.lit(min(window, RAREST)) == 1)).select("item", F.lit(True).alias("single"))
    return met.join(bounded(single), "item", "left").where("a < b OR single").select("key", "item", "shift")


def _runs(words: Column, c: Column, window: int) -> Column:
    """Document word ranges [a, b) in which a candidate's item runs along for at least a window."""
    size = F.size(c["words"])
    need = F.least(size, F.lit(window))
    empty = F.array().cast("array<struct<a:int,b:int>>")
    start = F.struct(F.lit(0).alias("run"), empty.alias("found"))

    def closed(state: Column, at: Column) -> Column:
        ended = F.struct((c["shift"] + at - state["run"]).alias("a"), (c["shift"] + at).alias("b"))
        return F.when(state["run"] >= need, F.concat(state["found"], F.array(ended))).otherwise(state["found"])

    def step(state: Column, at: Column) -> Column:
        same = F.coalesce(F.get(words, c["shift"] + at) == F.get(c["words"], at), F.lit(False))
        return F.when(same, F.struct((state["run"] + 1).alias("run"), state["found"].alias("found"))).otherwise(F.struct(F.lit(0).alias("run"), closed(state, at).alias("found")))

    return F.aggregate(F.sequence(F.lit(0), size - 1), start, step, lambda s: closed(s, size))


def _union_length(runs: Column) -> Column:
    """Positions covered by a list of [a, b) ranges."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda s, r: F.struct((s["n"] + F.greatest(F.lit(0), r["b"] - F.greatest(r["a"], s["end"]))).alias("n"), F.greatest(s["end"], r["b"]).alias("end"))
    return F.aggregate(F.sort_array(runs), start, step, lambda s: s["n"])


def phrase_matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, names: tuple[str, str, str] = ("n_words", "hits", "item_ids")) -> DataFrame:
    """Every row of docs (all its columns) with n_words, hits (array of word ranges [a, b)) and item_ids (array of strings).

    An item's windows are its runs of ``window`` words (a shorter item is one window); a hit is a document range in
    which one occurs. Null texts have no words, items without words none to find, items of null id aren't named; texts
    of any length are taken whole; repeated rows and equal items are each answered; empty tables give no hits. The three
    new columns may be given other ``names``; columns of docs with these names are replaced, all others kept.
    """
    docs = docs.drop(*names)
    (key,) = unused(docs, "key")
    tests = written(item_table(items), "items")
    keyed = docs.select(F.xxhash64("text").alias("key"), "text")
    chosen = written(anchors(tests, corpus_counts(keyed, tests), window), "anchors")
    index = build_index(keyed, chosen.select("term").distinct())
    found = written(alignments(index, chosen, tests, window), "alignments")
    per_text = found.join(bounded(tests), "item").groupBy("key").agg(F.collect_list(F.struct("shift", "words", "ids")).alias("found"))
    texts = keyed.join(bounded(found.select("key").distinct()), "key", "left_semi").dropDuplicates(["key"])
    # through a generator, as the optimizer would else move the splitting into the loop over an item's words
    compared = texts.join(per_text, "key").select("key", "found", F.explode(F.array(words_of(F.col("text")))).alias("words"))
    matches = F.filter(F.transform("found", lambda c: F.struct(_runs(F.col("words"), c, window).alias("runs"), c["ids"].alias("ids"))), lambda m: F.size(m["runs"]) > 0)
    answers = compared.select("key", matches.alias("m")).where(F.size("m") > 0)
    answers = written(answers.select(F.col("key").alias(key), F.flatten("m.runs").alias(names[1]), F.array_sort(F.array_distinct(F.flatten("m.ids"))).alias(names[2])), "phrases")
    none = "array<struct<a:int,b:int>>", "array<string>"
    out = docs.withColumn(key, F.xxhash64("text")).join(bounded(answers), key, "left")
    new = [F.coalesce(F.col(f"`{c}`"), F.array().cast(kind)).alias(c) for c, kind in zip(names[1:], none)]
    return out.select(*columns(docs), F.size(words_of(F.col("text"))).cast("long").alias(names[0]), *new)


def proximity_matches(docs: DataFrame, items: DataFrame, span: int = 30, rarest: int = 3) -> DataFrame:
    """(doc_id, item_id): documents in which the ``rarest`` rarest terms of an item (all, if fewer) stand within ``span`` words.

    Positions are put on two grids of cells 2 * span wide, half a cell apart, so a cluster lies inside a cell of one.
    Null and empty texts, and items without words or with a term that the corpus lacks, match nothing; equal texts, equal
    items and repeated rows are each answered; texts are taken whole; empty tables give no matches; of equally rare terms
    the first by spelling counts; other columns are left out.
    """
    tests = written(item_table(items), "items")
    keyed = docs.select(F.xxhash64("text").alias("key"), "text")
    counts = corpus_counts(keyed, tests)
    ranked = tests.select("item", F.explode(F.array_distinct("words")).alias("term")).join(counts, "term").groupBy("item").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "term"))), 1, rarest).alias("t"))
    wanted = tests.join(ranked, "item").where(F.size("t") == F.least(F.lit(rarest), F.size(F.array_distinct("words"))))
    terms = written(wanted.select("item", F.size("t").alias("need"), F.explode("t.term").alias("term")), "proximity-terms")
    index = build_index(keyed, terms.select("term").distinct())
    near = index.join(bounded(terms), "term").select("key", "item", "need", "term", "pos", F.explode(F.array(F.floor(F.col("pos") / F.lit(2 * span)) * 2, F.floor((F.col("pos") + span) / F.lit(2 * span)) * 2 + 1)).alias("cell"))
    cells = near.groupBy("key", "item", "need", "cell").agg(F.sort_array(F.collect_set(F.struct("pos", "term"))).alias("p"))
    close = F.exists("p", lambda x: F.size(F.array_distinct(F.transform(F.filter("p", lambda y: (y["pos"] >= x["pos"]) & (y["pos"] < x["pos"] + span)), lambda y: y["term"]))) >= F.col("need"))
    hit = cells.where(close).select("key", "item").distinct().join(bounded(tests.select("item", F.explode("ids").alias("item_id"))), "item").select("key", "item_id").distinct()
    return docs.select("doc_id", F.xxhash64("text").alias("key")).join(bounded(hit), "key").select("doc_id", "item_id")


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = phrase_matches(docs, table(spark, sf_dir, "benchmark"))
    hit = _union_length(F.col("hits")).cast("long")
    return got.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


def proximity_query(spark, sf_dir: str) -> DataFrame:
    return proximity_matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
