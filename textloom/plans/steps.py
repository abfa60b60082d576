"""Queries of single steps: sinks read back by the readers, row-level operators, searches with options, metrics in other forms."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions import text as X
from ..operators import chunks, metrics, ngrams, qa, relational as R, search, vectors as V, weights as T
from ..sources import readers, sinks
from . import cuts
from .catalog import _E, _OUT, _PRED, _PRF, _SENT_TOK, SENT, TOK, _asked, _knn_sql, _predicted, _rounded, docs, query, six, t

# ---------------------------------------------------------------- what sinks write, as readers take it


def _csv(spark, d, header: bool, separator: str):
    path = cuts.place(spark, "csv")
    rows = docs(spark, d).select(F.col("lang").alias("label"), F.col("source").alias("title"), "text")
    null = path.rsplit("/", 1)[-1]  # a new name, so no value holds it
    put = lambda df, a, b: df.select(*[F.replace(c, F.lit(a), F.lit(b)).alias(c) for c in df.columns])
    sinks.csv_named(put(rows, "\0", f"{null}.0"), path, header, separator, null)  # CSV parsers take the character 0 for an end
    back = put(readers.csv_named(spark, path, header=header, separator=separator, line_end="\n", null=null), f"{null}.0", "\0")
    return back.select("label", "title", F.md5("text").alias("digest"))


_CSV_SQL = "SELECT lang AS label, source AS title, md5(text) AS digest FROM documents"


@query(_CSV_SQL)
def csv_without_header(spark, d):
    return _csv(spark, d, False, ",")


@query(_CSV_SQL)
def csv_with_header(spark, d):
    return _csv(spark, d, True, ";")


@query("SELECT lang AS label, source AS name, count(*) AS n, md5(string_agg(md5(text), ',' ORDER BY md5(text))) AS digest FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL AND text IS NOT NULL GROUP BY lang, source")
def text_tree(spark, d):
    """A tree part/label/name of files that hold the documents of a source; the reader gives back label, name and text."""
    path = cuts.place(spark, "tree")
    rows = docs(spark, d).where("lang IS NOT NULL AND source IS NOT NULL AND text IS NOT NULL")
    tree = rows.select(F.lit("train").alias("part"), F.col("lang").alias("label"), F.col("source").alias("name"), F.col("text").alias("value")).write.partitionBy("part", "label", "name")
    tree.option("lineSep", "\u0001").text(path)
    files = readers.text_tree(spark, path).select(F.col("part").alias("label"), F.col("label").alias("name"), "text")  # each name is a folder of part files
    one = files.select(*[F.substring_index(c, "=", -1).alias(c) for c in ("label", "name")], F.explode(F.split(F.regexp_replace("text", "\u0001$", ""), "\u0001")).alias("text"))
    return one.groupBy("label", "name").agg(F.count("*").alias("n"), F.md5(F.array_join(F.sort_array(F.collect_list(F.md5("text"))), ",")).alias("digest"))


@query(f"WITH {_SENT_TOK} SELECT lang AS label, token, 's-' || token AS stem, count(*) AS n FROM st JOIN documents USING (doc_id) WHERE lang IS NOT NULL GROUP BY ALL")
def annotation_files(spark, d):
    """Token lines by label, blank lines between sentences, counted again from the files."""
    path = cuts.place(spark, "annotations")
    rows = ngrams.annotation_table(docs(spark, d).where("lang IS NOT NULL"), X.sentences("text", "stops"), X.words)
    rows = rows.join(docs(spark, d).select("doc_id", F.col("lang").alias("label")), "doc_id")
    sinks.annotation_tsv(rows.withColumn("stem", F.concat(F.lit("s-"), "token")).withColumn("lemma", F.col("token")), path)
    back = readers.annotations(readers.whole_files(spark, path), ["token", "stem", "lemma"])
    return back.where("token = lemma").groupBy(F.regexp_extract("path", "label=([^/]*)", 1).alias("label"), "token", "stem").agg(F.count("*").alias("n"))


@query("SELECT CAST(vec_id AS VARCHAR) AS doc_id, len(embedding) AS dims, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings")
def embedding_lines(spark, d):
    path = cuts.place(spark, "embeddings")
    sinks.embeddings_tsv(t(spark, d, "embeddings").select("vec_id", V.doubles("embedding").alias("embedding")), path, "vec_id")
    back = readers.embeddings_tsv(spark, path)
    return back.select("doc_id", F.size("embedding").cast("long").alias("dims"), six(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query(f"WITH {TOK} SELECT CAST(doc_id AS VARCHAR) AS doc_id, token AS term, count(*) AS tf FROM tok GROUP BY ALL")
def triplet_lines(spark, d):
    path = cuts.place(spark, "triplets")
    sinks.triplets_tsv(T.term_counts_in_rows(docs(spark, d), X.words("text")), path)
    return readers.triplets_tsv(spark, path)


@query(f"WITH {TOK} SELECT token, count(*) AS n FROM tok GROUP BY token ORDER BY n DESC, token LIMIT 500")
def dictionary_json(spark, d):
    path = cuts.place(spark, "dictionary")
    top = R.vocabulary(ngrams.token_counts(ngrams.token_table(docs(spark, d))), 500)  # 500 entries make one object
    top.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("token", "n")))).alias("value")).write.text(path)
    return readers.counts_json(spark, path)


@query("SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM documents GROUP BY source HAVING count(*) % 2 = 0)")
def manifest_rows(spark, d):
    """A JSON object of the sources' lists by part, and the rows of one part."""
    path = cuts.place(spark, "manifest")
    parts = docs(spark, d).groupBy("source").agg(F.count("*").alias("n")).where("source IS NOT NULL").select("source", F.when(F.col("n") % 2 == 0, "even").otherwise("odd").alias("part"))
    lists = parts.groupBy("part").agg(F.collect_list("source").alias("paths"))
    lists.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("part", "paths")))).alias("value")).write.text(path)
    rows = docs(spark, d).select("doc_id", F.col("source").alias("path"))
    return readers.of_manifest(rows, readers.manifest(spark, path), "even").select("doc_id", F.col("path").alias("source"))


@query("SELECT lang AS key, CAST(count(*) AS VARCHAR) || ' documents: all' AS value FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def mapping_file(spark, d):
    path = cuts.place(spark, "mapping")
    line = F.concat("lang", F.lit(": "), F.col("n").cast("string"), F.lit(" documents: all"))
    lines = docs(spark, d).where("lang IS NOT NULL").groupBy("lang").agg(F.count("*").alias("n")).select(line.alias("value"))
    lines.union(spark.createDataFrame([("# a comment",), ("",)], "value string")).write.text(path)
    return readers.mapping_lines(spark, path)


@query(f"WITH {_SENT_TOK} SELECT doc_id, CAST(sent AS BIGINT) AS sent, count(*) AS n FROM st GROUP BY ALL")
def marked_rows(spark, d):
    """One table of tokens with a marker row after each sentence; the sentence index is counted from the markers."""
    sents = docs(spark, d).select("doc_id", F.posexplode(X.sentences("text", "stops")).alias("s", "text"))
    lines = sents.select("doc_id", "s", F.posexplode(F.concat(X.words("text"), F.array(F.lit("<endofsentence>")))).alias("p", "token")).withColumn("at", F.struct("s", "p"))
    return readers.marked_annotations(lines, "at", "doc_id").groupBy("doc_id", "sent").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- rows


@query("SELECT doc_id, md5(concat_ws('. ', source, text)) AS digest, 1 AS class FROM documents")
def concatenated(spark, d):
    rows = docs(spark, d).withColumn("digest", F.md5(R.concatenated("source", "text", separator=". "))).withColumn("class", F.lit(1))
    return rows.drop("text", "lang", "source", "n_chars")


@query("SELECT doc_id, lang, coalesce(quality, -1) AS quality FROM documents LEFT JOIN labels USING (doc_id) WHERE text IS NOT NULL AND lang IS NOT NULL")
def nulls_dropped_and_filled(spark, d):
    joined = docs(spark, d).join(t(spark, d, "labels"), "doc_id", "left")
    return joined.dropna(subset=["text", "lang"]).fillna({"quality": -1}).select("doc_id", "lang", "quality")


@query(r"SELECT doc_id, md5(regexp_replace(text, '[^\p{L}\p{M}\p{Nd}\p{Pc}\s]', '', 'g')) AS digest FROM documents")
def punctuation_removed(spark, d):
    return docs(spark, d).select("doc_id", F.md5(X.without_punctuation("text")).alias("digest"))


@query(r"WITH x AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')) AS w FROM documents) SELECT doc_id, count(*) AS n, CAST(sum(length(w)) AS BIGINT) AS chars FROM x WHERE regexp_matches(w, '^([A-Za-z]+[-.@]?)+') GROUP BY doc_id")
def lemma_like_words(spark, d):
    words = docs(spark, d).select("doc_id", F.explode(X.tokens("text", "blank")).alias("w")).where(X.lemma_like("w"))
    return words.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.char_length("w")).alias("chars"))


@query("SELECT doc_id, source AS from_id, lang AS from_path FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def labels_from_names(spark, d):
    rows = docs(spark, d).where("lang IS NOT NULL AND source IS NOT NULL")
    return rows.select("doc_id", R.label_of_id(F.concat_ws("_", "source", "doc_id")).alias("from_id"), R.label_of_path(F.concat_ws("/", F.lit("train"), "lang", "doc_id")).alias("from_path"))


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars, doc_id LIMIT 75")
def first_rows(spark, d):
    return R.first_rows(docs(spark, d).select("doc_id", "n_chars"), ["n_chars", "doc_id"], 75)


@query(f"WITH {TOK}, v AS (SELECT token FROM tok GROUP BY token ORDER BY count(*) DESC, token LIMIT 50) SELECT doc_id, v.token, coalesce(n, 0) AS n FROM (SELECT doc_id FROM documents) CROSS JOIN v LEFT JOIN (SELECT doc_id, token, count(*) AS n FROM tok GROUP BY ALL) USING (doc_id, token)")
def terms_in_documents(spark, d):
    """Each of the 50 most frequent words in each document, 0 where it isn't there."""
    counts = cuts.written(T.term_counts_in_rows(docs(spark, d), X.words("text")))
    top = F.broadcast(R.vocabulary(counts.groupBy(F.col("term").alias("token")).agg(F.sum("tf").alias("n")), 50).select("token"))  # 50 rows
    asked = t(spark, d, "documents").select("doc_id")
    known = counts.select("doc_id", F.col("term").alias("token"), F.col("tf").alias("n"))
    return asked.crossJoin(top).join(known, ["doc_id", "token"], "left").fillna({"n": 0}).select("doc_id", "token", "n")


@query(f"WITH {TOK}, v AS (SELECT token FROM tok GROUP BY token HAVING count(*) >= 5) SELECT doc_id, count(*) AS n FROM tok SEMI JOIN v USING (token) GROUP BY doc_id")
def tokens_of_vocabulary(spark, d):
    tok = ngrams.token_table(docs(spark, d))
    known = cuts.written(R.at_least(ngrams.token_counts(tok), 5))
    return tok.join(known, "token", "left_semi").groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"WITH {TOK} SELECT DISTINCT token, CAST(dense_rank() OVER (ORDER BY token) AS BIGINT) - 1 AS place FROM tok")
def sorted_vocabulary(spark, d):
    return R.row_ids(ngrams.token_counts(ngrams.token_table(docs(spark, d))).select("token"), ["token"], "place").select("token", "place")


@query("SELECT doc_id AS id, 'document' AS kind FROM documents UNION ALL SELECT page_id, 'page' FROM pages UNION ALL SELECT vec_id, 'vector' FROM embeddings")
def union_of_tables(spark, d):
    kind = lambda name, key, label: t(spark, d, name).select(F.col(key).alias("id"), F.lit(label).alias("kind"))
    return kind("documents", "doc_id", "document").union(kind("pages", "page_id", "page")).union(kind("embeddings", "vec_id", "vector"))


@query(f"WITH x AS (SELECT doc_id, lang, unnest({SENT}) AS fragment, generate_subscripts({SENT}, 1) - 1 AS fragment_no FROM documents) SELECT doc_id || '/' || fragment_no AS fragment_id, doc_id, CAST(fragment_no AS INTEGER) AS fragment_no, md5(fragment) AS digest, lang FROM x")
def fragment_table(spark, d):
    rows = chunks.fragments(docs(spark, d), X.sentences("text", "stops"), "lang")
    return rows.select("fragment_id", "doc_id", "fragment_no", F.md5("fragment").alias("digest"), "lang")


@query("SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS INTEGER) AS n FROM conversations")
def numbered_turns(spark, d):
    return qa.numbered_turns(t(spark, d, "conversations")).select("conv_id", "turn", "role", "n")


@query(f"WITH {TOK}, r AS (SELECT doc_id, token AS term, count(*) AS weight, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, token) AS rank FROM tok GROUP BY doc_id, token) SELECT doc_id, CAST(rank AS INTEGER) AS rank, term, weight FROM r WHERE rank <= 5")
def top_terms(spark, d):
    counts = T.term_counts_in_rows(docs(spark, d), X.words("text")).select("doc_id", "term", F.col("tf").alias("weight"))
    return T.ranked_in_document(counts, 5).select("doc_id", "rank", "term", "weight")


# ---------------------------------------------------------------- vectors and searches

_LEN = "sqrt(list_sum([x * x for x in {}]))"


@query(f"""WITH {_E}, p AS (SELECT a.vec_id, a.e AS x, b.e AS y FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)
    SELECT vec_id, round(1 - list_cosine_similarity(x, y), 6) AS cosine, round(1 - abs(list_cosine_similarity(x, y)), 6) AS abs_cosine, round(1 - list_inner_product(x, y), 6) AS ip, round(power(list_distance(x, y), 2), 6) AS l2,
    round(list_sum(x) / {_LEN.format('x')}, 6) AS unit_total, round(list_sum(x[9:]), 6) AS tail, round(list_sum([sqrt(abs(v)) for v in x]), 6) AS roots FROM p""")
def vector_distances(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", V.doubles("embedding").alias("x"))
    x, y = F.col("x"), F.col("y")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), x.alias("y")), "vec_id")
    return pairs.select("vec_id", *[six(V.distance(x, y, s)).alias(s) for s in ("cosine", "abs_cosine", "ip", "l2")], six(total(V.normalized(x))).alias("unit_total"), six(total(V.zeroed(x, 8))).alias("tail"), six(total(F.transform(x, V.root_abs))).alias("roots"))


_TEXTS = "JOIN documents ON doc_id = c.vec_id"


@query(f"""WITH {_E}, s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, 1 - list_cosine_similarity(c.e, q.e) AS d FROM e c {_TEXTS}, (SELECT * FROM e WHERE vec_id % 100 = 0) q WHERE contains(text, 'an') AND NOT contains(text, 'xy')),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) - 1 AS rank FROM s) SELECT query_id, rank, id FROM r WHERE rank < 5""")
def knn_by_document(spark, d):
    """Only rows whose document holds one string and not another."""
    known = t(spark, d, "embeddings").join(docs(spark, d).select(F.col("doc_id").alias("vec_id"), F.col("text").alias("document")), "vec_id")
    rule = search.where_document({"$and": [{"$contains": "an"}, {"$not_contains": "xy"}]})
    return search.knn(known, _asked(spark, d), 5, "cosine", id_col="vec_id", where=rule).select("query_id", F.col("rank").cast("long").alias("rank"), "id")


@query(_knn_sql("l2", 7) + " SELECT query_id, rank, id FROM r WHERE rank < 1 + query_id % 7")
def knn_own_k(spark, d):
    asked = _asked(spark, d).withColumn("k", (1 + F.col("query_id") % 7).cast("int"))
    return search.knn(t(spark, d, "embeddings"), asked, "k", "l2", id_col="vec_id").select("query_id", F.col("rank").cast("long").alias("rank"), "id")


# ---------------------------------------------------------------- metrics


@query(f"WITH {_OUT} SELECT label, round(coalesce(5 * tp / nullif(CAST(5 * tp + 4 * fn + fp AS DOUBLE), 0), 0), 6) AS f2 FROM o")
def f_two(spark, d):
    return metrics.per_class(_predicted(spark, d), beta=2.0).select("label", six("f1").alias("f2"))


@query(f"WITH {_OUT}, x AS (SELECT {_PRF} FROM o) SELECT round(avg(p) * 100, 6) AS precision, round(avg(r) * 100, 6) AS recall, round(avg(f) * 100, 6) AS f1, (SELECT round(avg(CAST(label = prediction AS INT)) * 100, 6) FROM p) AS accuracy FROM x")
def metrics_percent(spark, d):
    return _rounded(metrics.percent(metrics.macro(_predicted(spark, d))))


@query(f"""WITH {_PRED}, k AS (SELECT unnest([0, 500, 1500, 4000]) AS cut), g AS (SELECT cut, quality AS label, CASE WHEN n_chars > cut THEN 1 ELSE 0 END AS prediction FROM labels JOIN documents USING (doc_id), k),
    m AS (SELECT cut, count(*) FILTER (label = 1 AND prediction = 1) / nullif(CAST(count(*) FILTER (prediction = 1) AS DOUBLE), 0) AS p, count(*) FILTER (label = 1 AND prediction = 1) / nullif(CAST(count(*) FILTER (label = 1) AS DOUBLE), 0) AS r FROM g GROUP BY cut),
    l AS (SELECT 'over ' || cut AS model, 'precision' AS metric, round(coalesce(p, 0), 6) AS value FROM m UNION ALL SELECT 'over ' || cut, 'recall', round(coalesce(r, 0), 6) FROM m)
    SELECT metric, min(model) AS model, value FROM l JOIN (SELECT metric, max(value) AS value FROM l GROUP BY metric) USING (metric, value) GROUP BY metric, value""")
def best_models(spark, d):
    """The best of four length rules by each metric of the class 1."""
    rows = t(spark, d, "labels").join(docs(spark, d).select("doc_id", "n_chars"), "doc_id")
    table = None
    for cut in (0, 500, 1500, 4000):
        predicted = rows.select(F.col("quality").alias("label"), (F.col("n_chars") > cut).cast("int").alias("prediction"))
        one = metrics.per_class(predicted).where("label = 1").select(F.lit(f"over {cut}").alias("model"), six("precision").alias("precision"), six("recall").alias("recall"))
        table = one if table is None else table.union(one)
    return metrics.best(table, ["precision", "recall"])


@query("SELECT doc_id, place FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS place FROM documents) WHERE place <= 10")
def ranked_by_language(spark, d):
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id"))
    return docs(spark, d).select("doc_id", place.cast("long").alias("place")).where("place <= 10")
