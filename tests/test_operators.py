import math
import statistics

import pytest
from pyspark.sql import functions as F

from textloom.functions import measures as M, text as X
from textloom.operators import chunks, metrics, models, ngrams, qa, relational as R, search, vectors as V, weights as T
from textloom.sources import readers, sinks
from textloom.streaming import events


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, "a b c a b"), (2, "a b c"), (3, ""), (4, None), (5, "x")], "doc_id long, text string")


def test_ngrams(docs):
    t = ngrams.triples(docs, X.words("text"))
    assert sorted(map(tuple, ngrams.triple_counts(t).collect())) == [("a", "b", "c", 2), ("b", "c", "a", 1), ("c", "a", "b", 1)]
    padded = ngrams.triples(docs, X.words("text"), padded=True)
    assert padded.count() == 9 and padded.where("w2 IS NULL").count() == 3
    m = {(r.level, r.w1, r.w2, r.w3): r.f for r in ngrams.marginals(ngrams.triple_counts(padded)).collect()}
    assert m["w1", "a", None, None] == 3 and m["w1_w2", "a", "b", None] == 3 and m["w1_w3", "a", None, "c"] == 2


def test_scores(docs):
    tok = ngrams.token_table(docs)
    got = ngrams.scored(ngrams.triple_counts(ngrams.triples(docs, X.words("text"))), ngrams.token_counts(tok), tok.agg(F.count("*").alias("n")), lambda f, a, b, c, n: f * n / (a * b * c))
    assert ngrams.top(got, 1).first().score == pytest.approx(2 * 9 / (3 * 3 * 2))


def test_weights(docs):
    tf = T.term_counts(ngrams.token_table(docs))
    w = {(r.doc_id, r.term): r.weight for r in T.tf_idf(tf, docs.select("doc_id"), "ln_smooth").collect()}
    assert w[1, "a"] == pytest.approx(2 * math.log(6 / 3)) and w[5, "x"] == pytest.approx(math.log(3))
    n = T.l2_normalized(T.tf_idf(tf, docs.select("doc_id"), "ln_plus_one", relative=True))
    assert all(r.s == pytest.approx(1) for r in n.groupBy("doc_id").agg(F.sum(F.col("weight") ** 2).alias("s")).collect())
    c = T.cosine_pairs(n, docs.sparkSession.createDataFrame([(1, 2), (1, 5), (3, 1)], "a long, b long"))
    got = {(r.a, r.b): r.cosine for r in c.collect()}
    assert got[1, 5] == got[3, 1] == 0 and 0.8 < got[1, 2] <= 1


def test_term_counts_inside_rows(docs):
    got = T.term_counts_in_rows(docs, X.words("text")).collect()
    assert {(r.doc_id, r.term, r.tf) for r in got} == {tuple(r) for r in T.term_counts(ngrams.token_table(docs)).collect()} and len(got) == 7
    assert {(r.doc_id, r.length) for r in got} == {(1, 5), (2, 3), (5, 1)}
    relative = lambda tf: {(r.doc_id, r.term): round(r.weight, 9) for r in T.tf_idf(tf, docs.select("doc_id"), relative=True).collect()}
    assert relative(T.term_counts_in_rows(docs, X.words("text"))) == relative(T.term_counts(ngrams.token_table(docs)))


def test_small_tables_are_dealt_out(spark, tmp_path):
    from textloom.sources import readers

    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/small")
    rows = readers.dealt_table(spark, f"{tmp_path}/small")
    assert rows.count() == 1000 and rows.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_grid_search_and_saved_models(spark, tmp_path):
    from pyspark.ml.classification import LinearSVC

    from textloom.operators import metrics, models
    from textloom.sources import readers, sinks

    rows = spark.createDataFrame([(i, i % 2, [float(i % 2) * 2 - 1 + (i % 7) / 10, 1.0]) for i in range(80)], "id long, label int, vector array<double>")
    found = models.grid_search(rows, "id", lambda a, b, reg: models.linear_svm(a, b, scheme="ovo", reg=reg, max_iter=5), {"reg": [0.01, 0.1]}, metrics.macro).collect()
    assert sorted(r.model for r in found) == ["reg=0.01", "reg=0.1"] and all(r.f1 == 1 for r in found)
    from pyspark.ml.functions import array_to_vector

    ready = rows.select("label", array_to_vector("vector").alias("features"))
    fitted = LinearSVC(maxIter=5).fit(ready)
    sinks.model(fitted, f"{tmp_path}/svm")
    again = readers.saved_model(spark, f"{tmp_path}/svm")
    assert [r.prediction for r in again.transform(ready).collect()] == [r.prediction for r in fitted.transform(ready).collect()]


def test_smooth_idf_equals_the_library(docs):
    from pyspark.ml.feature import IDF, CountVectorizer

    rows = docs.where("text IS NOT NULL").select("doc_id", X.words("text").alias("t"))
    counted = (cv := CountVectorizer(inputCol="t", outputCol="f").fit(rows)).transform(rows)
    idf = IDF(inputCol="f", outputCol="w").fit(counted)
    mine = {(r.doc_id, r.term): r.weight for r in T.tf_idf(T.term_counts(ngrams.token_table(rows, F.col("t"))), rows.select("doc_id")).collect()}
    for r in idf.transform(counted).collect():
        for k, term in enumerate(cv.vocabulary):
            assert r.w[k] == pytest.approx(mine.get((r.doc_id, term), 0.0))


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    a, b, z = F.col("a"), F.col("b"), F.col("z")
    row = df.select(V.cosine(a, b), V.l2_squared(a, b), V.distance(a, b, "ip"), V.normalized(a), V.cosine(a, z), V.normalized(z), V.zeroed(a, 1), V.expanded(a, V.root_abs)).first()
    assert row[0] == pytest.approx(0.96) and row[1] == 2 and row[2] == -23 and row[3] == [0.6, 0.8] and row[4] is None and row[5] == [0, 0] and row[6] == [0, 4] and row[7][2:] == [math.sqrt(3), 2]
    tok = spark.createDataFrame([(1, 0, "p"), (1, 0, "q"), (1, 1, "?"), (2, 0, "?"), (1, 1, "p")], "doc_id long, sent int, token string")
    table = spark.createDataFrame([("p", [1.0, 0.0]), ("q", [0.0, 1.0])], "token string, vector array<double>")
    got = lambda how, w=None: dict(V.document_vectors(tok, table, 2, how, w).collect())
    assert got("mean") == {1: [0.5, 0.25], 2: [0, 0]} and got("sentences")[1] == [0.5, 0.25] and got("known")[1] == [0.75, 0.25]
    assert got("distinct")[1] == [0.5, 0.5] and got("dims")[1] == [0.5, 0.25]
    w = spark.createDataFrame([(1, "p", 1.0), (1, "q", 3.0)], "doc_id long, term string, weight double")
    assert got("weighted", w)[1] == [0.25, 0.375]
    assert [r.token for r in V.similar_words(table, ["p"], [], 1).collect()] == ["q"]


def test_chunks(spark):
    df = spark.createDataFrame([("abcdefghij" * 25, "One two. Three four five. Six."), ("short", ""), ("", None)], "t string, s string")
    got = lambda c: [r[0] for r in df.select(c).collect()]
    assert [len(x) for x in got(chunks.sliding("t", 200, 100))[0]] == [200, 150] and got(chunks.sliding("t", 200, 100))[1:] == [["short"], []]
    assert [len(x) for x in got(chunks.sliding("t", 200, 100, False))[0]] == [200, 150] and got(chunks.sliding("t", 200, 100, False))[1] == []
    assert [len(x) for x in got(chunks.fixed("t", 100))[0]] == [100, 100, 50] and [len(x) for x in got(chunks.fixed("t", 100, False))[0]] == [100, 100]
    s = X.sentences("s", "stops")
    assert got(chunks.packed(s, 20))[0] == ["One two.", "Three four five.", "Six."] or got(chunks.packed(s, 25))[0] == ["One two. Three four five.", "Six."]
    assert got(chunks.packed(s, 3, "words", over=True, keep_tail=False))[0] == ["One two. Three four five."]
    assert got(chunks.split_overlapping(X.tokens("s", "blank"), 3, 1))[0] == ["One two. Three", "Three four five.", "five. Six."]
    assert all(len(x) <= 6 for x in got(chunks.packed_then_cut(s, 6, 3))[0])
    frag = chunks.fragments(spark.createDataFrame([(7, "a b")], "doc_id long, s string"), X.tokens("s", "blank")).collect()
    assert [r.fragment_id for r in frag] == ["7/0", "7/1"]


def test_search(spark, tmp_path):
    rows = spark.createDataFrame([("a", [1.0, 0.0], "red fox", {"k": "1"}), ("b", [0.6, 0.8], "blue fox", {"k": "2"}), ("c", [0.0, 1.0], "red cat", {"k": "1"})], "id string, embedding array<double>, document string, metadata map<string,string>")
    q = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [0.0, 2.0], 2)], "query_id long, embedding array<double>, k int")
    ids = lambda r: [(x.query_id, x.id) for x in r.orderBy("query_id", "rank").collect()]
    assert ids(search.knn(rows, q, 2)) == [(1, "a"), (1, "b"), (2, "c"), (2, "b")]
    assert ids(search.knn(rows, q, "k", "l2")) == [(1, "a"), (2, "c"), (2, "b")]
    assert ids(search.knn(rows, q, 3, "cosine", threshold=0.1)) == [(1, "a"), (2, "c")]
    store = search.Collections(spark, str(tmp_path / "store"))
    store.create("x", rows)
    store.add("x", rows.where("id = 'a'").withColumn("id", F.lit("d")))
    assert store.count("x") == 4 and store.names() == ["x"]
    assert ids(store.query("x", q, k=1, where={"k": "1"}, where_doc={"$and": [{"$contains": "red"}, {"$not_contains": "cat"}]})) == [(1, "a"), (2, "a")]
    with pytest.raises(ValueError):
        store.query("x")
    text = spark.createDataFrame([(1, "fox")], "query_id long, text string")
    assert store.query("x", texts=text, embed=lambda t: F.array(F.lit(1.0), F.lit(0.0)), k=1).first().id == "a"
    store.drop("x")
    assert store.names() == []
    ranks = search.expected_ranks(search.knn(rows, q, 2), spark.createDataFrame([(1, "b"), (2, "a")], "query_id long, expected_id string"), 2)
    assert search.mean_rank(ranks).first().mean_rank == 1.5
    assert {r.id for r in search.lsh_knn(rows, [1.0, 0.0], 1, 2.0).collect()} == {"a"}


def test_blocks_of_queries_give_the_same(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 5)]) for i in range(40)], "id long, embedding array<double>")
    q = rows.select(F.col("id").alias("query_id"), "embedding")
    whole = sorted(map(tuple, search.knn(rows, q, 3, "l2").collect()))
    monkeypatch.setattr(search, "QUERY_BLOCK", 7)
    assert sorted(map(tuple, search.knn(rows, q, 3, "l2").collect())) == whole


def test_search_joins_no_pairs_and_keeps_the_order_of_brute_force(spark):
    import numpy as np

    v = np.round(np.random.default_rng(1).normal(size=(900, 8)), 1)
    v[300:600] = v[:300]  # ties by distance
    data = [(i, [float(x) for x in v[i]]) for i in range(900)]
    rows = spark.createDataFrame([*data, (-1, None), (-2, [0.0] * 8), (-3, [1.0, None] + [0.0] * 6), (-4, [1.0])], "id long, embedding array<double>")
    q = spark.createDataFrame([(i, data[i][1]) for i in range(0, 900, 30)], "query_id long, embedding array<double>")
    for space in search.SPACES:
        got = search.knn(rows.repartition(5), q, 7, space)
        assert "Join" not in (plan := got._jdf.queryExecution().toString()) and "Cartesian" not in plan
        pairs = rows.crossJoin(q.withColumnRenamed("embedding", "e")).select("query_id", "id", V.distance(F.col("embedding"), F.col("e"), space).alias("d"))
        want = {}
        for r in sorted(pairs.where("d IS NOT NULL").collect(), key=lambda r: (r.query_id, r.d, r.id)):
            want.setdefault(r.query_id, []).append((r.id, r.d))
        assert sorted((r.query_id, r.rank, r.id, r.distance) for r in got.collect()) == [(a, k, *x) for a in sorted(want) for k, x in enumerate(want[a][:7])]
    few = [(r.rank, r.id) for r in search.knn(rows.where("id < 1"), q.where("query_id = 0"), 9, "cosine").orderBy("rank").collect()]
    assert few == [(0, 0), (1, -4), (2, -3), (3, -2), (4, -1)]  # unknown distances last, as in the SQL


def test_metrics(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("c", "d")], "label string, prediction string")
    o = {r.label: (r.tp, r.fp, r.fn, r.tn) for r in metrics.outcomes(rows).collect()}
    assert o == {"a": (1, 0, 1, 3), "b": (2, 1, 0, 2), "c": (0, 0, 1, 4), "d": (0, 1, 0, 4)}
    m = metrics.macro(rows).first()
    assert m.precision == pytest.approx((1 + 2 / 3) / 4) and m.recall == pytest.approx(1.5 / 4) and m.accuracy == 0.6
    assert metrics.micro(rows).first().f1 == pytest.approx(0.6) and metrics.nan_mean(rows).first().precision == pytest.approx((1 + 2 / 3 + 0) / 3)
    best = metrics.best(spark.createDataFrame([("m1", 0.5, 0.9), ("m2", 0.7, 0.9)], "model string, f1 double, acc double"), ["f1", "acc"])
    assert {(r.metric, r.model) for r in best.collect()} == {("f1", "m2"), ("acc", "m1")}


def test_relational(spark):
    df = spark.createDataFrame([(i, f"t{i % 3}", None if i == 4 else i) for i in range(10)], "doc_id long, text string, x int")
    assert sorted(r.doc_id for r in R.keep_first(df, "text", "doc_id").collect()) == [0, 1, 2] and R.duplicates(df, ["text"]).first()[0] == 7
    assert {r.column: r.nulls for r in R.null_census(df).collect()} == {"doc_id": 0, "text": 0, "x": 1}
    assert [r.row_id for r in R.row_ids(df, ["doc_id"]).orderBy("doc_id").collect()] == list(range(10))
    s = R.crc_split(df, "doc_id", {"train": 80, "test": 20})
    assert {r.part for r in s.collect()} <= {"train", "test"} and s.where("part IS NULL").count() == 0
    assert {r.text: r.code for r in R.label_codes(df, "text").collect()} == {"t0": 0, "t1": 1, "t2": 2}
    assert R.per_class(df, "text", [F.desc("doc_id")], 2).count() == 6 and R.difference(df, df.where("x > 3"), "doc_id").count() == 5
    assert df.select(R.label_of_path(F.lit("a/b/c.txt")), R.label_of_id(F.lit("en_us_7"))).first()[:] == ("b", "en_us")


def test_qa(spark):
    conv = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, "user", "who?"), (2, 0, "system", "x")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in qa.last_turns(conv).collect()] == [(1, 2, "who?")]
    assert {r.conv_id: r.history for r in qa.histories(conv).collect()}[1] == "user: hi\nassistant: yo\nuser: who?"
    df = spark.createDataFrame([("The sky is blue. Grass is green.", "What is green?")], "context string, question string")
    assert df.select(qa.extractive_answer("context", "question"), qa.overlap_f1("context", "question")).first()[0] == "Grass is green."
    hits = spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (1, 2, "c")], "query_id long, rank int, id string")
    texts = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "id string, document string")
    assert qa.contexts(hits, texts, 2, "\n", numbered=True).first().context == "1. A\n2. B"


def test_models(spark):
    rows = spark.createDataFrame([(i, [float(i % 2) * 2 + i % 3 * 0.1, float(i % 5) * 0.1, 1.0], i % 2) for i in range(60)], "id long, vector array<double>, label int")
    for scheme in ("ovr", "ovo"):
        got = models.linear_svm(rows, rows, scheme=scheme, max_iter=10)
        assert metrics.accuracy(got).first()[0] == 1.0
    p = models.reduced(rows, "vector", 2, whiten=True).select("reduced").collect()
    assert statistics.stdev(r.reduced[0] for r in p) == pytest.approx(1, abs=1e-6) and abs(statistics.mean(r.reduced[0] for r in p)) < 1e-9
    table = models.experiments(spark, models.grid(lambda max_iter: models.linear_svm(rows, rows, max_iter=max_iter), {"max_iter": [2, 5]}), metrics.macro)
    assert table.count() == 2 and "f1" in table.columns
    c, r2 = models.fitted_curve([(x, 2 * x + 1) for x in range(5)], 1)
    assert c == pytest.approx([2, 1]) and r2 == pytest.approx(1)
    assert rows.select(models.polynomial_features(F.col("vector")).alias("p")).first().p[3:] != []


def test_topics_and_word_vectors(spark):
    docs = spark.createDataFrame([(i, "cat dog pet" if i % 2 else "sun moon star") for i in range(30)], "doc_id long, text string")
    t = models.Topics(docs, X.words("text"), 2, 5, 50)
    assert t.distributions().count() == 30 and t.top_documents().count() == 2 and t.terms(2).count() == 4 and t.perplexity() > 0
    _, table = models.word_vectors(docs, X.words("text"), dims=4)
    assert table.count() == 6 and len(table.first().vector) == 4


def test_csv_gives_back_every_text(spark, tmp_path):
    from textloom.plans.steps import csv_with_header, csv_without_header

    texts = ["a\r\nb", "", "c\rd", None, 'e;"f",\n', "\ufeffg", "h\0", " # i\\ "]
    rows = spark.createDataFrame([(k, t, s, t) for k, t in enumerate(texts) for s in ("x", "", None)], "doc_id long, text string, source string, lang string")
    rows.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    want = sorted(map(str, rows.select("lang", "source", F.md5("text")).collect()))
    for query in (csv_with_header, csv_without_header):
        got = query(spark, str(tmp_path)).toDF("lang", "source", "md5(text)")
        assert sorted(map(str, got.collect())) == want


def test_marked_rows_of_a_text_of_many_sentences(spark, tmp_path):
    from textloom.plans.steps import marked_rows

    spark.createDataFrame([(1, "a b. " * 2200), (2, "c")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, marked_rows(spark, str(tmp_path)).collect()))
    assert got == [(1, k, 2) for k in range(2200)] + [(2, 0, 1)]


def test_top_triple_of_a_document_without_a_shuffle(spark):
    from textloom.plans.catalog import QUERIES

    assert "Exchange" not in QUERIES["document_loglik_top"](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString().replace("Exchange RoundRobin", "")
    items = spark.createDataFrame([([],), (None,), (["a"],), (["a", "a", "b", "c", "c"],)], "t array<string>")
    assert [r[0] for r in items.select(T.run_lengths(F.col("t"))).collect()] == [[], None, [1], [2, 1, 2]]


def test_word_vectors_are_trained_by_more_tasks_where_there_are_more_words(spark, monkeypatch):
    given, real = [], models.Word2Vec
    monkeypatch.setattr(models, "Word2Vec", lambda **options: given.append(options.get("numPartitions")) or real(**options))
    docs = spark.createDataFrame([(i, "cat dog pet sun" if i else None) for i in range(31)], "doc_id long, text string")
    _, table = models.word_vectors(docs, X.words("text"), dims=4)
    monkeypatch.setattr(models, "TASK_WORDS", 40, raising=False)
    _, more = models.word_vectors(docs, X.words("text"), dims=4)
    assert given == [1, 3] and table.count() == more.count() == 4


def test_best_triples_drop_rows_by_bounds_and_no_triple(spark, monkeypatch):
    from textloom.operators import best_triples as B

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").coalesce(1)
    triples, uni = ngrams.triples(docs, X.words("text")).cache(), ngrams.token_counts(ngrams.token_table(docs)).cache()
    firsts = triples.groupBy(F.col("w1").alias("token")).agg(F.count("*").alias("n")).cache()
    n, total = uni.agg(F.sum("n")).first()[0], triples.count()
    counted, real = [], ngrams.triple_counts
    whole = real(triples).cache()
    monkeypatch.setattr(B, "RESIDUES", 4)
    monkeypatch.setattr(ngrams, "triple_counts", lambda rows: counted.append(rows) or real(rows))
    for name, words, lowest in [("t_score", uni, False), ("t_score_smoothed", firsts, False), ("log_likelihood", uni, False), *[(m, uni, False) for m in B.POWERS], ("mi", uni, True)]:
        got = B.best_triples(triples, words, n, name, M.MEASURES[name], 30, lowest, words is firsts).collect()
        size = spark.range(1).select(F.lit(float(n)).alias("n"))
        want = ngrams.top(ngrams.scored(whole, words, size, M.MEASURES[name]).withColumn("score", F.round("score", 6)), 30, lowest=lowest).collect()
        assert [tuple(r) for r in got] == [(r.w1, r.w2, r.w3, r.f, r.score) for r in want]
        assert counted[-1].count() < total / 3
    few = triples.limit(5)
    assert len(B.best_triples(few, uni, n, "mi", M.MEASURES["mi"], 30).collect()) == few.distinct().count()


def test_document_vectors_group_documents_and_spread_no_vector(spark):
    docs = spark.createDataFrame([(1, "p q p. z z. p."), (2, "z."), (3, "q z! q q p? ...")], "doc_id long, text string")
    tok = ngrams.annotation_table(docs, X.sentences("text", "stops"), X.words)
    table = spark.createDataFrame([("p", [1.0, 0.0]), ("q", [0.0, 1.0])], "token string, vector array<double>")
    weights = T.tf_idf(T.term_counts(tok), docs.select("doc_id"))
    for how in ("mean", "distinct", "sentences", "known", "dims", "weighted"):
        got = V.document_vectors(tok, table, 2, how, weights)
        assert "explode(vector" not in got._jdf.queryExecution().toString()
        plain = dict(V.document_vectors(tok.drop("pos", "length"), table, 2, how, weights).collect())
        assert {k: pytest.approx(v) for k, v in plain.items()} == dict(got.collect()) and plain[2] == [0, 0]
    sents = V.document_vectors(tok, table, 2, "sentences")
    assert "sent" not in str(sents._jdf.queryExecution().optimizedPlan().toString()).split("Aggregate [doc_id")[1].split("]")[0]
    assert dict(sents.collect())[1] == pytest.approx([(2 / 3 + 0 + 1) / 3, (1 / 3) / 3])


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('1,"Tit, le","two\nlines ""q"""\n2,x,y\n')
    rows = readers.csv_named(spark, str(tmp_path / "a.csv")).orderBy("label").collect()
    assert rows[0].title == "Tit, le" and rows[0].text == 'two\nlines "q"'
    tree = tmp_path / "tree" / "train" / "sport"
    tree.mkdir(parents=True)
    (tree / "1.txt").write_bytes("café".encode("latin1"))
    r = readers.text_tree(spark, str(tmp_path / "tree"), "ISO-8859-1").first()
    assert (r.part, r.label, r.name, r.text) == ("train", "sport", "1.txt", "café")
    files = spark.createDataFrame([("p", "a\tx\tl\nb\ty\tl\n\nnan\tz\tl\n\t\t\nc\tw\tl")], "path string, text string")
    got = [tuple(r)[1:4] for r in readers.annotations(files, ["token", "stem", "lemma"]).orderBy("sent", "pos").collect()]
    assert got == [(0, 0, "a"), (0, 1, "b"), (1, 0, "nan"), (2, 0, "c")]
    marked = spark.createDataFrame([(1, i, t) for i, t in enumerate(["a", "b", "<endofsentence>", "c"])], "doc_id long, n long, token string")
    assert [(r.token, r.sent) for r in readers.marked_annotations(marked, "n", "doc_id").orderBy("n").collect()] == [("a", 0), ("b", 0), ("c", 1)]
    vec = spark.createDataFrame([("d1", [1.5, -2.0])], "doc_id string, embedding array<double>")
    sinks.embeddings_tsv(vec, str(tmp_path / "e"))
    assert readers.embeddings_tsv(spark, str(tmp_path / "e")).first()[:] == ("d1", [1.5, -2.0])
    trip = spark.createDataFrame([("d", "a\"b", 3)], "doc_id string, term string, tf long")
    sinks.triplets_tsv(trip, str(tmp_path / "t"))
    assert readers.triplets_tsv(spark, str(tmp_path / "t")).first()[:] == ("d", 'a"b', 3)
    (tmp_path / "c.json").write_text('{"a": 3, "b": 1}')
    assert dict(readers.counts_json(spark, str(tmp_path / "c.json")).collect()) == {"a": 3, "b": 1}
    (tmp_path / "m.json").write_text('{"train": ["x", "y"], "test": ["z"]}')
    m = readers.manifest(spark, str(tmp_path / "m.json"))
    assert readers.of_manifest(spark.createDataFrame([("x",), ("z",)], "path string"), m, "train").count() == 1
    (tmp_path / "e.yml").write_text("# c\n🌩: weather\n")
    assert readers.mapping_lines(spark, str(tmp_path / "e.yml")).first()[:] == ("🌩", "weather")


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:10:00", 5, "a", 1.0), (2, "2024-01-01 00:20:00", 5, "a", 2.0), (3, "2024-01-01 03:00:00", 5, "b", 3.0)], "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = events.read(spark, str(tmp_path / "in"), "event_id long, ts timestamp, user_id long, event_type string, value double")
    q = events.tumbling(stream).writeStream.format("memory").queryName("tumbled").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.n, r.total) for r in spark.table("tumbled").collect()] == [(2, 3.0)]
    assert events.sessions(rows).count() == 2 and events.tumbling(rows).count() == 2


def test_lsh_of_all_queries_against_brute_force(spark):
    from textloom.plans.catalog import QUERIES

    sf = "/root/testdata/sf0.01"
    best, got = ({(r.query_id, r.id) for r in QUERIES[name](spark, sf).collect()} for name in ("knn_l2", "lsh_neighbours"))
    assert len(got) == len(best) and {q for q, _ in got} == {q for q, _ in best} and len({q for q, _ in best}) > 1
    assert len(best & got) >= 0.9 * len(best)
    few = spark.createDataFrame([(k, [100.0 * k, 0.0]) for k in range(12)], "id long, embedding array<double>")  # alone in their buckets
    found = search.lsh_knn_join(few, few.select(F.col("id").alias("query_id"), "embedding"), 5, id_col="id").collect()
    assert len(found) == 60 and {r.rank for r in found} == set(range(5))
