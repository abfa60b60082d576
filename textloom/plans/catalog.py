"""Named queries over the shared tables, and the same results as SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import measures as M, stem as stemming, text as X
from ..functions.lexer import typed_rows
from ..functions.protected import protected_sentences
from ..operators import chunks, metrics, models, ngrams, qa, relational as R, search, vectors as V, weights as T
from ..operators.best_triples import best_triples
from ..sources import readers
from ..streaming import events as E
from . import cuts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.dealt_table(spark, f"{sf_dir}/documents.parquet")


def english(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).where("lang = 'en'").select("doc_id", "text")


def six(c):
    return F.round(c, 6)


WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
TOK = f"tok AS (SELECT doc_id, unnest({WORDS}) AS token, generate_subscripts({WORDS}, 1) AS pos FROM documents)"
EN_TOK = f"tok AS (SELECT doc_id, unnest({WORDS}) AS token, generate_subscripts({WORDS}, 1) AS pos FROM documents WHERE lang = 'en')"
TRI = """tri AS (SELECT * FROM (SELECT doc_id, token AS w1, lead(token) OVER d AS w2, lead(token, 2) OVER d AS w3 FROM tok
         WINDOW d AS (PARTITION BY doc_id ORDER BY pos)) WHERE w3 IS NOT NULL)"""
COUNTS = "f AS (SELECT w1, w2, w3, count(*) AS f FROM tri GROUP BY ALL), u AS (SELECT token, count(*) AS n FROM tok GROUP BY token), s AS (SELECT count(*) AS n FROM tok)"

# ---------------------------------------------------------------- tokens and n-grams


@query(f"WITH {TOK} SELECT token, count(*) AS n FROM tok GROUP BY token")
def token_freq(spark, d):
    return ngrams.token_counts(ngrams.token_table(docs(spark, d)))


@query(f"WITH {TOK} SELECT count(DISTINCT token) AS vocabulary, count(*) AS tokens FROM tok")
def vocab_size(spark, d):
    return ngrams.token_counts(ngrams.token_table(docs(spark, d))).agg(F.count("*").alias("vocabulary"), F.sum("n").alias("tokens"))


@query(f"WITH {TOK} SELECT token, count(*) AS n FROM tok GROUP BY token ORDER BY n DESC, token LIMIT 8192")
def vocab_top(spark, d):
    return R.vocabulary(ngrams.token_counts(ngrams.token_table(docs(spark, d))), 8192)


@query(f"WITH {TOK} SELECT token, count(*) AS n FROM tok GROUP BY token HAVING count(*) >= 3")
def vocab_min_count(spark, d):
    return R.at_least(ngrams.token_counts(ngrams.token_table(docs(spark, d))), 3)


@query(f"WITH {TOK}, r AS (SELECT token FROM tok GROUP BY token HAVING count(*) < 2) SELECT doc_id, count(*) AS n FROM tok WHERE token NOT IN (SELECT token FROM r) GROUP BY doc_id")
def rare_anti_join(spark, d):
    tok = ngrams.token_table(docs(spark, d))
    rare = ngrams.token_counts(tok).where("n < 2")
    return tok.join(rare, "token", "left_anti").groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"WITH {TOK}, c AS (SELECT token, count(*) AS n FROM tok GROUP BY token) SELECT token, n FROM c WHERE n >= (SELECT quantile_cont(n, 0.8) FROM c)")
def terms_above_p80(spark, d):
    return T.terms_above_percentile(ngrams.token_counts(ngrams.token_table(docs(spark, d))))


@query(f"WITH {TOK}, {TRI} SELECT w1, w2, w3, count(*) AS f FROM tri GROUP BY ALL HAVING count(*) >= 2")
def trigram_freq(spark, d):
    return ngrams.triple_counts(ngrams.triples(docs(spark, d), X.words("text"))).where("f >= 2")


def _scores(measure: str, expr: str, words: str = "u", size: str = "s", lowest: bool = False, lang: str | None = None):
    sql = f"""WITH {EN_TOK if lang else TOK}, {TRI}, {COUNTS}, i AS (SELECT w1 AS token, count(*) AS n FROM tri GROUP BY w1), v AS (SELECT count(DISTINCT token) AS n FROM tok), tt AS (SELECT sum(f) AS n FROM f),
        x AS (SELECT w1, w2, w3, f.f, CAST(f.f AS DOUBLE) AS g, CAST(a.n AS DOUBLE) AS c1, CAST(b.n AS DOUBLE) AS c2, CAST(c.n AS DOUBLE) AS c3, CAST(z.n AS DOUBLE) AS n
              FROM f JOIN {words} a ON a.token = w1 JOIN {words} b ON b.token = w2 JOIN {words} c ON c.token = w3, {size} z)
        SELECT w1, w2, w3, f, round({expr}, 6) AS score FROM x ORDER BY score {'' if lowest else 'DESC'}, w1, w2, w3 LIMIT 30"""

    def run(spark, d):
        chosen = english(spark, d) if lang else docs(spark, d)
        chosen = cuts.written(chosen.select("doc_id", X.words("text").alias("toks")))  # read up to five times
        triples = ngrams.triples(chosen, F.col("toks"))
        within = F.greatest(F.size("toks") - 2, F.lit(0))
        tokens = ngrams.token_counts(ngrams.token_table(chosen, F.col("toks")))
        uni = tokens if words == "u" else ngrams.token_counts(ngrams.token_table(chosen, F.slice("toks", F.lit(1), within)))  # i: words as the first of a triple
        uni = cuts.written(uni)
        n = {
            "s": lambda: uni.agg(F.sum("n")),
            "v": lambda: tokens.agg(F.count("*")),
            "tt": lambda: chosen.agg(F.sum(within)),
        }[size]().first()[0]
        return best_triples(triples, uni, n or 0, measure, M.MEASURES[measure], 30, lowest, words == "i")

    return run, sql


for _name, _args in {
    "trigram_tscore_top": ("t_score", "(g - c1 * c2 * c3 / (n * n)) / sqrt(g)", "u", "s", False, "en"),
    "trigram_tscore_smoothed_top": ("t_score_smoothed", "(g - c1 * c2 * c3 / (n * n)) / sqrt(g + 1e-5)", "i", "v"),
    "trigram_mi_top": ("mi", "log2(g * n * n / (c1 * c2 * c3))"),
    "trigram_mi_bottom": ("mi", "log2(g * n * n / (c1 * c2 * c3))", "u", "s", True),
    "trigram_mi_marginal_top": ("mi_marginal", "log2(g * n * n) - log2(c1 * c2 * c3)"),
    "trigram_mi_two_top": ("mi_two", "log2(g * n * n / (c1 * c2))", "u", "tt"),
    "trigram_mi_root_top": ("mi_root", "ln(g * n * n / sqrt(c1 * c2 * c3))"),
    "trigram_mi_single_top": ("mi_single", "log2(g * n / (c1 * c2 * c3))", "u", "tt"),
    "trigram_loglik_top": ("log_likelihood", "2 * g * log2(g / (c1 * c2 * c3 / n))", "u", "tt"),
    "trigram_mi_like_top": ("mi_like", "g * g * g / (c1 * c2 * c3)"),
}.items():
    QUERIES[_name], ORACLES[_name] = _scores(*_args)


@query(f"WITH {TOK}, c AS (SELECT doc_id, count(*) AS u FROM tok GROUP BY doc_id) SELECT doc_id, round((greatest(u - 2, 0) - u / (CAST(u AS DOUBLE) * u)) / sqrt(greatest(u - 2, 0) + 1e-5), 6) AS score FROM c")
def document_tscore(spark, d):
    n = F.size(X.words("text"))
    return docs(spark, d).select("doc_id", n.alias("u")).where("u > 0").select("doc_id", six(M.t_score_document(F.greatest(F.col("u") - 2, F.lit(0)), F.col("u"))).alias("score"))


@query(f"""WITH {TOK}, p AS (SELECT token AS w1, lead(token) OVER d AS w2, lead(token, 2) OVER d AS w3 FROM tok WINDOW d AS (PARTITION BY doc_id ORDER BY pos))
    SELECT CASE grouping(w2, w3) WHEN 3 THEN 'w1' WHEN 1 THEN 'w1_w2' WHEN 2 THEN 'w1_w3' ELSE 'w1_w2_w3' END AS level, w1, w2, w3, count(*) AS f
    FROM p GROUP BY GROUPING SETS ((w1), (w1, w2), (w1, w3), (w1, w2, w3)) HAVING count(*) >= 5""")
def trigram_marginals(spark, d):
    return ngrams.marginals(cuts.written(ngrams.triple_counts(ngrams.triples(docs(spark, d), X.words("text"), padded=True)))).where("f >= 5")


@query(f"WITH {TOK}, b AS (SELECT token AS w1, lead(token) OVER (PARTITION BY doc_id ORDER BY pos) AS w2 FROM tok) SELECT w1, w2, count(*) AS f FROM b WHERE w2 IS NOT NULL GROUP BY ALL ORDER BY f DESC, w1, w2 LIMIT 100")
def bigram_top(spark, d):
    g = docs(spark, d).select(F.inline(ngrams.ngram_structs(X.words("text"), 2)))
    return g.groupBy("w1", "w2").agg(F.count("*").alias("f")).orderBy(F.desc("f"), "w1", "w2").limit(100)


# ---------------------------------------------------------------- text functions

SENT = r"list_filter(list_transform(string_split(regexp_replace(text, '(\.\.\.|\?\?|[.?!])', chr(92) || '1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"
SENT = SENT.replace("chr(92) || '1' || chr(1)", r"'\1' || chr(1)")


@query(f"WITH s AS (SELECT doc_id, {SENT} AS s FROM documents) SELECT doc_id, CAST(len(s) AS INTEGER) AS n_sentences, CAST(coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS INTEGER) AS longest FROM s")
def sentence_stats(spark, d):
    s = docs(spark, d).select("doc_id", X.sentences("text", "stops").alias("s"))
    return s.select("doc_id", F.size("s").alias("n_sentences"), F.coalesce(F.array_max(F.transform("s", F.char_length)), F.lit(0)).alias("longest"))


@query(f"""WITH s AS (SELECT doc_id, {SENT} AS s FROM documents), x AS (SELECT doc_id, unnest(s) AS t, generate_subscripts(s, 1) - 1 AS sent FROM s)
    SELECT doc_id, CAST(sent AS INTEGER) AS sent, CAST(len(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}_]+')) AS INTEGER) AS n FROM x""")
def annotation_tokens(spark, d):
    s = docs(spark, d).select("doc_id", F.posexplode(X.sentences("text", "stops")).alias("sent", "t"))
    return s.select("doc_id", "sent", F.size(X.words("t")).alias("n"))


def digest(parts):
    """The number of an array's strings, and the MD5 of them all, joined."""
    return F.coalesce(F.size(parts), F.lit(0)).alias("n"), F.md5(F.array_join(parts, "|")).alias("digest")


def digest_sql(parts: str, source: str = "documents", with_: str = "") -> str:
    return f"{with_ or 'WITH'} x AS (SELECT doc_id, {parts} AS c FROM {source}) SELECT doc_id, CAST(len(c) AS INTEGER) AS n, md5(array_to_string(c, '|')) AS digest FROM x"


def plain(pattern: str) -> str:
    """A token class in the syntax without look-around: Unicode classes spelled out, word edges left out (a scan of whole runs begins and ends at them)."""
    out, inside = "", False
    for at, c in enumerate(pattern):
        if c == "\\" or at and pattern[at - 1] == "\\" and (at < 2 or pattern[at - 2] != "\\"):
            out += c
        else:
            inside = (inside or c == "[") and c != "]"
            out += c
        if out.endswith("\\w"):
            out = out[:-2] + (r"\p{L}\p{M}\p{Nd}\p{Pc}" if inside else r"[\p{L}\p{M}\p{Nd}\p{Pc}]")
        elif out.endswith("\\d"):
            out = out[:-2] + r"\p{Nd}"
        elif out.endswith("\\b"):
            out = out[:-2]
    return out


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def token_sql(kind: str) -> str:
    """The tokens of a kind as a list; for kinds whose classes need no look-around."""
    return f"regexp_extract_all(text, {quoted('|'.join(map(plain, X.TOKEN_CLASSES[kind])))})"


BLANK = r"regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')"
_PLAIN_KINDS = ("mail_phone_link", "tweet", "tweet_words", "simple", "russian", "letters", "words")
for _k in (*X.TOKENIZERS,):

    def _run(spark, d, k=_k):
        return docs(spark, d).select("doc_id", *digest(X.tokens("text", k)))

    query(digest_sql(BLANK) if _k == "blank" else digest_sql(token_sql(_k)) if _k in _PLAIN_KINDS else None, f"tokens_{_k}")(_run)


def _trimmed(parts: str) -> str:
    return rf"list_filter(list_transform({parts}, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"


def _cut_sql(near: str, cut: str, wide: int) -> str:
    """Pieces of a text between the places p at which a condition holds: after the character at p, or (wide) around it. near: what the characters c of a text must be at such a place i."""
    return f"""WITH w AS (SELECT doc_id, list(p ORDER BY p) AS cuts FROM (SELECT doc_id, text, unnest(list_filter(range(1, len(c) + 1), lambda i: {near})) AS p FROM (SELECT doc_id, text, string_split(text, '') AS c FROM documents)) WHERE {cut} GROUP BY doc_id),
        v AS (SELECT doc_id, text, coalesce(cuts, []) AS cuts FROM documents LEFT JOIN w USING (doc_id)),
        u AS (SELECT doc_id, list_transform(range(0, len(cuts) + 1), lambda i: text[CASE WHEN i = 0 THEN 1 ELSE cuts[i] + 1 END : CASE WHEN i = len(cuts) THEN length(text) ELSE cuts[i + 1] - {wide} END]) AS p FROM v),"""


_B = r"[\p{L}\p{M}\p{Nd}\p{Pc}]"
_AFTER = rf"NOT coalesce(p > {{4}} AND regexp_matches(substr(text, p - {{4}}, 4), '^{_B}\.{_B}.$'), false) AND NOT coalesce(p > {{3}} AND regexp_matches(substr(text, p - {{3}}, 3), '^[A-Z][a-z]\.$'), false)"
_CUTS = {
    "guarded": ("c[i] IN ('.', '?', '!')", rf"substr(text, p, 1) IN ('.', '?', '!') AND regexp_matches(substr(text, p + 1, 1), '^[\s#]$') AND " + _AFTER.replace("p > {4}", "p >= 4").replace("p > {3}", "p >= 3").replace("{4}", "3").replace("{3}", "2"), 0),
    "lines": ("i > 1 AND c[i - 1] IN ('.', '?', '!', chr(10))", r"regexp_matches(substr(text, p, 1), '^\s$') AND p > 1 AND substr(text, p - 1, 1) IN ('.', '?', '!', chr(10)) AND " + _AFTER.replace("{4}", "4").replace("{3}", "3"), 1),
    "newline": ("c[i] = chr(10) OR i > 1 AND c[i - 1] IN ('.', '?', '!')", rf"""(regexp_matches(substr(text, p, 1), '^\s$') AND p > 1 AND substr(text, p - 1, 1) IN ('.', '?', '!') AND regexp_matches(substr(text, p + 1, 1), '^[A-Z]$')
        AND NOT coalesce(p > 3 AND regexp_matches(substr(text, p - 3, 3), '^\s{_B}\.$'), false) AND {_AFTER.replace("{4}", "4").replace("{3}", "3")})
        OR (substr(text, p, 1) = chr(10) AND NOT (p > 1 AND substr(text, p - 1, 1) IN (',', '-', ':')) AND regexp_matches(substr(text, p + 1, 2), '^([A-Z]|" )'))""", 1),
}
_SENTENCE_SQL = {
    "stops": digest_sql(SENT),
    "capital": digest_sql(_trimmed(r"string_split(regexp_replace(text, '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1))")),
    "dropped": digest_sql(_trimmed(f"regexp_split_to_array(text, {quoted(X.SENTENCE_SPLITS['dropped'])})")),
    "guarded": digest_sql(_trimmed("p"), "u", _cut_sql(*_CUTS["guarded"])),
    "newline": digest_sql(_trimmed("p"), "u", _cut_sql(*_CUTS["newline"])),
    "lines": digest_sql(_trimmed("flatten(list_transform(p, lambda x: string_split(x, chr(10))))"), "u", _cut_sql(*_CUTS["lines"])),
}
for _k in X.SEGMENTERS:

    def _cut(spark, d, k=_k):
        return docs(spark, d).select("doc_id", *digest(X.sentences("text", k)))

    query(_SENTENCE_SQL[_k], f"sentences_{_k}")(_cut)


@query(r"""SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS blanks, md5(regexp_replace(text, '\d', '', 'g')) AS digits, md5(lower(text)) AS low,
    md5(regexp_replace(regexp_replace(regexp_replace(text, '[^ А-ЯЁа-яё]', ' ', 'g'), '\s{2,}', ' ', 'g'), '^ | $', '', 'g')) AS cyrillic FROM documents""")
def normalizers(spark, d):
    return docs(spark, d).select("doc_id", F.md5(X.collapse_blanks("text")).alias("blanks"), F.md5(X.without_digits("text")).alias("digits"), F.md5(F.lower("text")).alias("low"), F.md5(X.cyrillic_only("text")).alias("cyrillic"))


@query("SELECT doc_id, CAST(len(list_filter(" + WORDS + ", lambda x: NOT list_contains([" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + "], x))) AS INTEGER) AS n FROM documents")
def stop_words_removed(spark, d):
    return docs(spark, d).select("doc_id", F.size(X.without_stop_words(X.words("text"))).alias("n"))


def _social_sql() -> str:
    out = "text"
    for pattern, by in ((r"\r|\n", " "), (r"(?:https?\://|www\.)\S+", ""), (X.TOKEN_CLASSES["social"][1], ""), (r"\@\S+", " "), (r"#\S+", " "), (r"(:|;|=)(-|_)?(\)|\(|D|P)", ""), (r"[^\x00-\x7f]", ""), (r"\s\s+", " "), (r"[?.!]+([?.!])", r"\1")):
        out = f"regexp_replace({out}, {quoted(pattern)}, '{by}', 'g')"
    return f"list_filter(regexp_split_to_array({out}, '\\s+'), lambda x: x <> '')"


@query(digest_sql(_social_sql()))
def social_clean(spark, d):
    return docs(spark, d).select("doc_id", *digest(X.social_clean("text")))


@query(None)
def sentences_protected(spark, d):
    return docs(spark, d).select("doc_id", *digest(protected_sentences()(F.col("text"))))


@query(f"""WITH k AS (SELECT doc_id, unnest({token_sql("tweet")}) AS t, generate_subscripts({token_sql("tweet")}, 1) AS i FROM documents),
    e AS (SELECT *, t IN ('.', '?', '!', '...') AS ends, coalesce(lag(t) OVER w IN ('.', '?', '!', '...'), false) AS after FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    g AS (SELECT *, sum(CAST(after AND NOT ends AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS sent FROM e),
    s AS (SELECT doc_id, sent, string_agg(t, ' ' ORDER BY i) AS s FROM g GROUP BY ALL),
    x AS (SELECT doc_id, list(s ORDER BY sent) AS c FROM s GROUP BY doc_id)
    SELECT doc_id, CAST(coalesce(len(c), 0) AS INTEGER) AS n, md5(coalesce(array_to_string(c, '|'), '')) AS digest FROM documents LEFT JOIN x USING (doc_id)""")
def sentences_of_tokens(spark, d):
    cut = F.transform(X.sentences_of_tokens(X.tokens("text", "tweet")), lambda s: F.array_join(s, " "))
    return docs(spark, d).select("doc_id", *digest(cut))


@query(None)
def typed_lexer(spark, d):
    return typed_rows(docs(spark, d)).groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("SELECT conv_id, turn, role AS author, CASE WHEN turn % 2 = 0 THEN 's: ' || role END AS subject, '--' || chr(10) || text AS body FROM conversations")
def mail_headers(spark, d):
    head = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("From: nobody\nSubject: s: "), "role", F.lit("\n"))).otherwise(F.lit("To: all\n\n"))
    mail = t(spark, d, "conversations").withColumn("mail", F.concat(head, F.lit("From: "), "role", F.lit("\n\n--\n"), "text"))
    parts = mail.select("conv_id", "turn", X.mail_parts("mail").alias("m"))
    return parts.select("conv_id", "turn", F.try_element_at("m.headers", F.lit("From")).alias("author"), F.try_element_at("m.headers", F.lit("Subject")).alias("subject"), "m.body")


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN source || ' of ' || lang END AS author FROM documents")
def author_extraction(spark, d):
    sender = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Date: x From: "), "source", F.lit(" Lines: 3"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("From:\n "), "source", F.lit(" of "), "lang")).otherwise(F.lit("Date: x From: Lines: 3"))
    return docs(spark, d).select("doc_id", X.author(sender).alias("author"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'weather,birds' ELSE 'positive-attitude' END AS labels FROM documents")
def pictograph_labels(spark, d):
    marked = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("x"), F.lit("🌩"), F.lit("🐦"))).otherwise(F.array(F.lit("😊")))
    return docs(spark, d).select("doc_id", F.array_join(X.mapped(marked), ",").alias("labels"))


@query(None)
def vocabulary_stems(spark, d):
    vocab = ngrams.token_counts(ngrams.token_table(docs(spark, d)))
    return stemming.with_stems(stemming.with_stems(vocab), stem="lemma", language="lemma").select("token", "stem", "lemma", "n")


# ---------------------------------------------------------------- weights

TF = f"{TOK}, tf AS (SELECT doc_id, token AS term, count(*) AS tf FROM tok GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM documents), l AS (SELECT doc_id, sum(tf) AS length FROM tf GROUP BY doc_id)"


@query(f"WITH {TF} SELECT term, df FROM df")
def doc_freq(spark, d):
    return T.document_frequency(T.term_counts_in_rows(docs(spark, d), X.words("text")))


def _weighted(spark, d, idf: str, relative: bool = False):
    tf = cuts.written(T.term_counts_in_rows(docs(spark, d), X.words("text")))  # the only pass over the texts
    return T.tf_idf(tf, t(spark, d, "documents").select("doc_id"), idf, relative, df=cuts.written(T.document_frequency(tf)))


def _weights(idf: str, expr: str, relative: bool):
    count = "tf / CAST(length AS DOUBLE)" if relative else "tf"

    def run(spark, d):
        w = _weighted(spark, d, idf, relative)
        return w.groupBy("doc_id").agg(F.count("*").alias("terms"), six(F.sum("weight")).alias("total"), six(F.max("weight")).alias("most"))

    return run, f"WITH {TF}, w AS (SELECT doc_id, {count} * ({expr}) AS weight FROM tf JOIN df USING (term) JOIN l USING (doc_id), n) SELECT doc_id, count(*) AS terms, round(sum(weight), 6) AS total, round(max(weight), 6) AS most FROM w GROUP BY doc_id"


for _name, _args in {
    "tfidf_ratio_ln": ("ln_ratio", "ln(n / df)", True),
    "tfidf_count_ln": ("ln_ratio", "ln(n / df)", False),
    "tfidf_smooth": ("ln_smooth", "ln((n + 1) / (df + 1))", False),
    "tfidf_log10": ("log10_smooth", "log10(n + 1) - log10(df + 1)", True),
    "tfidf_plus_one": ("ln_plus_one", "ln(n / df + 1)", True),
    "tfidf_one_plus": ("ln_one_plus", "ln(1 + n / (1 + df))", True),
}.items():
    QUERIES[_name], ORACLES[_name] = _weights(*_args)


@query(f"""WITH lines AS (SELECT lang AS category, doc_id AS line, unnest(list_distinct({WORDS})) AS term FROM documents), tf AS (SELECT category, term, count(*) AS tf FROM lines GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), c AS (SELECT CAST(count(DISTINCT category) AS DOUBLE) AS c FROM lines), w AS (SELECT category, term, tf * ln(1 + c / df) AS w FROM tf JOIN df USING (term), c)
    SELECT category, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY category)), 6) AS weight FROM w""")
def tfidf_category(spark, d):
    lines = docs(spark, d).select(F.col("lang").alias("category"), F.col("doc_id").alias("line"), F.explode(F.array_distinct(X.words("text"))).alias("token"))
    return T.category_weights(lines).select("category", "term", six("weight").alias("weight"))


@query(f"WITH lines AS (SELECT lang, unnest(list_distinct({WORDS})) AS term FROM documents) SELECT term, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'es') AS es, count(*) FILTER (lang = 'fr') AS fr FROM lines GROUP BY term")
def term_category_matrix(spark, d):
    lines = docs(spark, d).select("lang", F.explode(F.array_distinct(X.words("text"))).alias("term"))
    return lines.groupBy("term").agg(*[F.count(F.when(F.col("lang") == x, 1)).alias(x) for x in ("de", "en", "es", "fr")])


@query(f"""WITH {TF}, w AS (SELECT doc_id, term, tf * ln((n + 1) / (df + 1)) AS w FROM tf JOIN df USING (term), n), m AS (SELECT doc_id, sqrt(sum(w * w)) AS m FROM w GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, a.doc_id + 1 AS b, sum(a.w * b.w) AS dot FROM w a JOIN w b ON b.doc_id = a.doc_id + 1 AND a.term = b.term GROUP BY a.doc_id)
    SELECT x.doc_id AS a, x.doc_id + 1 AS b, round(coalesce(dot / nullif(ma.m * mb.m, 0), 0), 6) AS cosine FROM documents x JOIN documents y ON y.doc_id = x.doc_id + 1
    LEFT JOIN p ON p.a = x.doc_id LEFT JOIN m ma ON ma.doc_id = x.doc_id LEFT JOIN m mb ON mb.doc_id = y.doc_id""")
def doc_cosine_pairs(spark, d):
    ids = docs(spark, d).select("doc_id")
    w = cuts.written(_weighted(spark, d, "ln_smooth"))
    pairs = ids.select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b")).join(ids.withColumnRenamed("doc_id", "b"), "b", "left_semi")
    return T.cosine_pairs(w, pairs).select("a", "b", six("cosine").alias("cosine"))


# ---------------------------------------------------------------- vectors and search


@query("SELECT vec_id, round(sqrt(list_sum([x * x for x in embedding::DOUBLE[]])), 6) AS norm, round(list_sum(embedding[1:8]::DOUBLE[]), 6) AS head, round(list_sum([sin(x) for x in embedding::DOUBLE[]]), 6) AS sines, len(embedding) * 3 AS dims FROM embeddings")
def vector_features(spark, d):
    v = V.doubles("embedding")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    wide = V.expanded(v, F.sin, F.cos)
    return t(spark, d, "embeddings").select("vec_id", six(V.norm(v)).alias("norm"), six(total(F.slice(v, 1, 8))).alias("head"), six(total(F.slice(wide, F.size(v) + 1, F.size(v)))).alias("sines"), F.size(wide).cast("long").alias("dims"))


@query("WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings) SELECT label, CAST(d AS INTEGER) AS d, round(avg(x), 6) AS x FROM x GROUP BY ALL")
def label_means(spark, d):
    return V.mean_vectors(t(spark, d, "embeddings").select("label", V.doubles("embedding").alias("v")), "label", "v").select("label", F.posexplode("v").alias("d", "x")).withColumn("x", six("x"))


_DIST = {"cosine": "1 - list_cosine_similarity(c.e, q.e)", "l2": "list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_transform(range(1, len(c.e) + 1), lambda i: [c.e[i], q.e[i]])])", "ip": "1 - list_inner_product(c.e, q.e)"}
_E = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"


def _knn_sql(space: str, k: int, where: str = "TRUE") -> str:
    return f"""WITH {_E}, s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, {_DIST[space]} AS d FROM e c, (SELECT * FROM e WHERE vec_id % 100 = 0) q WHERE {where}),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) - 1 AS rank FROM s)"""


def _asked(spark, d):
    return t(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


for _space in search.SPACES:

    def _near(spark, d, space=_space):
        got = search.knn(t(spark, d, "embeddings"), _asked(spark, d), 10, space, id_col="vec_id")
        return got.select("query_id", F.col("rank").cast("long").alias("rank"), "id", six("distance").alias("distance"))

    query(_knn_sql(_space, 10) + " SELECT query_id, rank, id, round(d, 6) AS distance FROM r WHERE rank < 10", f"knn_{_space}")(_near)


@query(_knn_sql("cosine", 5, "c.label = 3") + " SELECT query_id, rank, id FROM r WHERE rank < 5")
def knn_filtered(spark, d):
    got = search.knn(t(spark, d, "embeddings"), _asked(spark, d), 5, "cosine", id_col="vec_id", where=search.where_metadata({"label": 3}, ""))
    return got.select("query_id", F.col("rank").cast("long").alias("rank"), "id")


@query(_knn_sql("l2", 50) + " SELECT query_id, rank, id FROM r WHERE rank < 50 AND d <= 1.6")
def knn_threshold(spark, d):
    got = search.knn(t(spark, d, "embeddings"), _asked(spark, d), 50, "l2", 1.6, id_col="vec_id")
    return got.select("query_id", F.col("rank").cast("long").alias("rank"), "id")


@query(_knn_sql("ip", 20) + " , x AS (SELECT vec_id AS query_id, vec_id + 1 AS id FROM embeddings WHERE vec_id % 100 = 0), h AS (SELECT coalesce(r.rank, 20) AS rank FROM x LEFT JOIN r ON r.query_id = x.query_id AND r.id = x.id AND r.rank < 20) SELECT round(avg(rank), 6) AS mean_rank, count(*) AS queries FROM h")
def mean_rank(spark, d):
    asked = _asked(spark, d)
    got = search.knn(t(spark, d, "embeddings"), asked, 20, "ip", id_col="vec_id")
    ranks = search.expected_ranks(got, asked.select("query_id", (F.col("query_id") + 1).alias("expected_id")), 20)
    return search.mean_rank(ranks).select(six("mean_rank").alias("mean_rank"), "queries")


@query(_knn_sql("cosine", 5) + " SELECT query_id, CAST(length(string_agg(text, ' ' ORDER BY rank)) AS INTEGER) AS n_chars, md5(string_agg(text, ' ' ORDER BY rank)) AS digest FROM r JOIN documents ON doc_id = id WHERE rank < 5 GROUP BY query_id")
def context_top5(spark, d):
    got = search.knn(t(spark, d, "embeddings"), _asked(spark, d), 5, "cosine", id_col="vec_id")
    whole = qa.contexts(got, docs(spark, d).select(F.col("doc_id").alias("id"), F.col("text").alias("document")))
    return whole.select("query_id", F.char_length("context").alias("n_chars"), F.md5("context").alias("digest"))


# ---------------------------------------------------------------- metrics

_PRED = "p AS (SELECT quality AS label, CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END AS prediction FROM labels JOIN documents USING (doc_id))"
_OUT = f"{_PRED}, k AS (SELECT DISTINCT unnest([label, prediction]) AS label FROM p), o AS (SELECT k.label, count(*) FILTER (p.label = k.label AND prediction = k.label) AS tp, count(*) FILTER (p.label <> k.label AND prediction = k.label) AS fp, count(*) FILTER (p.label = k.label AND prediction <> k.label) AS fn, count(*) FILTER (p.label <> k.label AND prediction <> k.label) AS tn FROM k, p GROUP BY k.label)"
_PRF = "coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0) AS p, coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0) AS r, coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0) AS f, tp + fn AS s"


def _predicted(spark, d):
    rows = t(spark, d, "labels").join(docs(spark, d).select("doc_id", "n_chars"), "doc_id")
    return rows.select(F.col("quality").alias("label"), (F.col("n_chars") > 1500).cast("int").alias("prediction"))


def _rounded(df):
    return df.select(*[six(c).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


for _name, (_f, _sql) in {
    "confusion": (metrics.confusion, f"WITH {_PRED} SELECT label, prediction, count(*) AS n FROM p GROUP BY ALL"),
    "class_outcomes": (metrics.outcomes, f"WITH {_OUT} SELECT label, tp, fp, fn, tn FROM o"),
    "metrics_per_class": (metrics.per_class, f"WITH {_OUT}, x AS (SELECT label, {_PRF} FROM o) SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, s AS support FROM x"),
    "metrics_macro": (metrics.macro, f"WITH {_OUT}, x AS (SELECT {_PRF} FROM o) SELECT round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(f), 6) AS f1, (SELECT round(avg(CAST(label = prediction AS INT)), 6) FROM p) AS accuracy FROM x"),
    "metrics_micro": (metrics.micro, f"WITH {_OUT}, y AS (SELECT CAST(sum(tp) AS DOUBLE) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM o) SELECT round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM y"),
    "metrics_weighted": (metrics.weighted, f"WITH {_OUT}, x AS (SELECT {_PRF} FROM o) SELECT round(sum(p * s) / sum(s), 6) AS precision, round(sum(r * s) / sum(s), 6) AS recall, round(sum(f * s) / sum(s), 6) AS f1 FROM x"),
    "metrics_nan_mean": (metrics.nan_mean, f"WITH {_OUT}, x AS (SELECT tp / nullif(CAST(tp + fp AS DOUBLE), 0) AS p, tp / nullif(CAST(tp + fn AS DOUBLE), 0) AS r, (tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE) AS a FROM o) SELECT round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(2 * p * r / nullif(p + r, 0)), 6) AS f1, round(avg(a), 6) AS accuracy FROM x"),
}.items():

    def _metric(spark, d, f=_f):
        return _rounded(f(_predicted(spark, d)))

    query(_sql, _name)(_metric)

# ---------------------------------------------------------------- chunks


def _chunk(pieces, sql: str, name: str):
    def run(spark, d):
        rows = docs(spark, d).select("doc_id", pieces().alias("c"))
        return rows.select("doc_id", F.size("c").alias("n"), F.md5(F.array_join("c", "|")).alias("digest"))

    query(sql and f"WITH x AS (SELECT doc_id, {sql} AS c FROM documents) SELECT doc_id, CAST(len(c) AS INTEGER) AS n, md5(array_to_string(c, '|')) AS digest FROM x", name)(run)


_chunk(lambda: chunks.fixed("text", 100, False), "list_transform(range(0, length(text) // 100), lambda k: substr(text, k * 100 + 1, 100))", "fixed_chunks")
_chunk(lambda: chunks.fixed("text", 100), "list_transform(range(0, CAST(ceil(length(text) / 100.0) AS BIGINT)), lambda k: substr(text, k * 100 + 1, 100))", "fixed_chunks_tail")
_chunk(lambda: chunks.sliding("text", 200, 100, False), "list_transform(range(0, greatest(0, CAST(ceil((length(text) - 100) / 100.0) AS BIGINT))), lambda k: substr(text, k * 100 + 1, 200))", "sliding_chunks")
_chunk(lambda: X.sentences("text", "stops"), SENT, "sentence_chunks")


def _packed_sql(size: str, new: str, pieces: str = "[cur]") -> str:
    """Sentences packed one after the other; new: whether the next one (z: its size) begins a fragment, given the size n of this one."""
    return f"""WITH RECURSIVE s AS (SELECT doc_id, {SENT} AS s FROM documents),
        r AS (SELECT doc_id, s, 1 AS i, 1 AS frag, s[1] AS cur, {size.format('s[1]')} AS n FROM s WHERE len(s) > 0 UNION ALL
              SELECT doc_id, s, i + 1, frag + CAST({new} AS INTEGER), CASE WHEN {new} THEN x ELSE cur || ' ' || x END, CASE WHEN {new} THEN z ELSE n + z END
              FROM (SELECT *, s[i + 1] AS x, {size.format('s[i + 1]')} AS z FROM r WHERE i < len(s))),
        f AS (SELECT doc_id, frag, arg_max(cur, i) AS cur FROM r GROUP BY ALL), x AS (SELECT doc_id, flatten(list({pieces} ORDER BY frag)) AS c FROM f GROUP BY doc_id)
        SELECT doc_id, CAST(coalesce(len(c), 0) AS INTEGER) AS n, md5(coalesce(array_to_string(c, '|'), '')) AS digest FROM documents LEFT JOIN x USING (doc_id)"""


def _packed(name: str, pieces, sql: str):
    def run(spark, d):
        return docs(spark, d).select("doc_id", *digest(pieces()))

    query(sql, name)(run)


_WINDOWED = "CASE WHEN length(cur) > 200 THEN list_transform(range(0, CAST(ceil((length(cur) - 200) / 100.0) AS BIGINT) + 1), lambda k: substr(cur, k * 100 + 1, 200)) ELSE [cur] END"
_packed("packed_chunks", lambda: chunks.packed(X.sentences("text", "stops"), 200), _packed_sql("length({})", "(n + z > 200)"))
_packed("packed_word_chunks", lambda: chunks.packed(X.sentences("text", "stops"), 20, "words", over=True), _packed_sql(r"len(regexp_extract_all({}, '[^ \t\n\x0B\f\r]+'))", "(n >= 20)"))
_packed("packed_cut_chunks", lambda: chunks.packed_then_cut(X.sentences("text", "stops")), _packed_sql("length({})", "(n + z > 200)", _WINDOWED))
_chunk(lambda: chunks.split_overlapping(X.tokens("text", "blank"), 100, 20), f"list_transform(range(0, CASE WHEN len({BLANK}) = 0 THEN 0 WHEN len({BLANK}) <= 100 THEN 1 ELSE CAST(ceil((len({BLANK}) - 100) / 80.0) AS BIGINT) + 1 END), lambda k: array_to_string({BLANK}[k * 80 + 1 : k * 80 + 100], ' '))", "overlapping_chunks")

# ---------------------------------------------------------------- relational


@query("SELECT doc_id, source, md5(text) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def dedup_keep_first(spark, d):
    return R.keep_first(docs(spark, d).withColumn("digest", F.md5("text")).select("doc_id", "source", "digest"), "digest", "doc_id").select("doc_id", "source", "digest")


@query("SELECT CAST(count(*) - count(DISTINCT text) AS BIGINT) AS duplicates FROM documents")
def duplicate_count(spark, d):
    return R.duplicates(docs(spark, d).select(F.md5("text").alias("h")), ["h"])


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL")
def label_counts(spark, d):
    return docs(spark, d).groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("SELECT unnest(['doc_id', 'text', 'lang', 'source', 'n_chars']) AS column, unnest([count(*) - count(doc_id), count(*) - count(text), count(*) - count(lang), count(*) - count(source), count(*) - count(n_chars)]) AS nulls FROM documents")
def null_census(spark, d):
    return R.null_census(docs(spark, d))


@query("SELECT doc_id, CASE WHEN h < 80 THEN 'train' WHEN h < 90 THEN 'val' ELSE 'test' END AS part FROM (SELECT doc_id, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 AS h FROM documents)")
def split_assign(spark, d):
    return R.digest_split(docs(spark, d).select("doc_id"), "doc_id", {"train": 80, "val": 10, "test": 10})


@query("WITH k AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS code FROM (SELECT DISTINCT lang FROM documents)) SELECT doc_id, lang, CAST(code AS INTEGER) AS code FROM documents JOIN k USING (lang)")
def label_codes(spark, d):
    return R.label_codes(docs(spark, d).select("doc_id", "lang"), "lang").select("doc_id", "lang", "code")


@query("SELECT doc_id, lang, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 3")
def quota_per_class(spark, d):
    return R.per_class(docs(spark, d).select("doc_id", "lang", "n_chars"), "lang", [F.desc("n_chars"), "doc_id"], 3)


@query("SELECT doc_id, CAST(row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS BIGINT) AS row_id FROM documents")
def row_numbers(spark, d):
    return R.row_ids(docs(spark, d).select("doc_id", "n_chars"), ["n_chars", "doc_id"]).select("doc_id", "row_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def set_difference(spark, d):
    return R.difference(docs(spark, d).select("doc_id", "lang"), t(spark, d, "labels"), "doc_id")


@query("SELECT doc_id, quality, toxic, text IS NOT NULL AS known FROM documents LEFT JOIN labels USING (doc_id)")
def left_outer_labels(spark, d):
    return docs(spark, d).join(t(spark, d, "labels"), "doc_id", "left").select("doc_id", "quality", "toxic", F.col("text").isNotNull().alias("known"))


@query("SELECT doc_id, metric, CAST(value AS INTEGER) AS value FROM (UNPIVOT labels ON quality, toxic INTO NAME metric VALUE value)")
def unpivot_labels(spark, d):
    return R.unpivoted(t(spark, d, "labels"), ["doc_id"], ["quality", "toxic"]).select("doc_id", "metric", "value")


@query("SELECT lang, arg_max(doc_id, n_chars * 1000000 - doc_id) AS longest FROM documents GROUP BY lang")
def arg_max(spark, d):
    return docs(spark, d).groupBy("lang").agg(F.max_by("doc_id", F.col("n_chars") * 1000000 - F.col("doc_id")).alias("longest"))


@query("SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS sum_qty, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_lines(spark, d):
    return t(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("double").alias("sum_qty"), F.count("*").alias("n"))


@query("SELECT n_name, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def orders_by_nation(spark, d):
    o, c, n = t(spark, d, "orders").select("o_custkey"), t(spark, d, "customer").select("c_custkey", "c_nationkey"), t(spark, d, "nation").select("n_nationkey", "n_name")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("orders"))


# ---------------------------------------------------------------- conversations and streams


@query("SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role = 'user') WHERE r = 1")
def last_user_turns(spark, d):
    return qa.last_turns(t(spark, d, "conversations"))


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS history FROM conversations GROUP BY conv_id")
def histories(spark, d):
    return qa.histories(t(spark, d, "conversations"))


@query("SELECT conv_id, turn, 'Context: ' || role || chr(10) || 'Question: Represent this sentence for searching relevant passages: ' || text || chr(10) || 'Answer:' AS prompt FROM conversations")
def prompts(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", qa.prompt("role", qa.prefixed("text")).alias("prompt"))


@query(r"""WITH t AS (SELECT a.conv_id, list_distinct(regexp_extract_all(lower(a.text), '[\p{L}\p{N}_]+')) AS x, list_distinct(regexp_extract_all(lower(b.text), '[\p{L}\p{N}_]+')) AS y
    FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1) SELECT conv_id, round(coalesce(2 * len(list_intersect(x, y)) / nullif(CAST(len(x) + len(y) AS DOUBLE), 0), 0), 6) AS f1 FROM t""")
def answer_overlap(spark, d):
    a = t(spark, d, "conversations")
    b = a.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", six(qa.overlap_f1("text", "answer")).alias("f1"))


@query(None)
def extractive_answers(spark, d):
    rows = t(spark, d, "conversations").groupBy("conv_id").agg(F.max_by("text", "turn").alias("context"), F.min_by("text", "turn").alias("question"))
    return qa.answer_with(rows, qa.extractive_answer).select("conv_id", "answer")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(spark, d):
    return E.tumbling(t(spark, d, "events")).withColumn("total", F.round("total", 4))


# ---------------------------------------------------------------- models (numbers depend on the library, so rows only)


@query(None)
def word2vec_documents(spark, d):
    _, table = models.word_vectors(docs(spark, d), X.words("text"), dims=16, min_count=5)
    tok = ngrams.annotation_table(docs(spark, d), X.sentences("text", "stops"), X.words)
    return V.document_vectors(tok, table, 16, "known")


@query(None)
def similar_words(spark, d):
    _, table = models.word_vectors(docs(spark, d), X.words("text"), dims=16, min_count=5)
    return V.similar_words(table, ["the"], ["of"], 10)


@query(None)
def lsh_neighbours(spark, d):
    return search.lsh_knn_join(t(spark, d, "embeddings"), _asked(spark, d), 10, id_col="vec_id")


@query(f"""WITH {TOK}, {TRI}, g AS (SELECT doc_id, max(f) AS f, sum(f) AS total FROM (SELECT doc_id, w1, w2, w3, count(*) AS f FROM tri GROUP BY ALL) GROUP BY doc_id),
    r AS (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) AS r FROM (SELECT doc_id, token, count(*) AS n FROM tok GROUP BY ALL)),
    x AS (SELECT doc_id, CAST(total AS DOUBLE) AS t, f / t AS p, max(n) FILTER (r = 1) / t AS x, max(n) FILTER (r = 2) / t AS y, max(n) FILTER (r = 3) / t AS z FROM r JOIN g USING (doc_id) GROUP BY doc_id, total, f)
    SELECT doc_id, round(2 * t * (p * log2(p / (x * z * y * z))), 6) AS score FROM x WHERE z IS NOT NULL""")
def document_loglik_top(spark, d):
    """Of each document's most frequent triple, against its three most frequent words; all as shares of its triples."""
    toks = docs(spark, d).select("doc_id", X.words("text").alias("toks"))
    joined = F.transform(ngrams.ngram_structs(F.col("toks"), 3), lambda w: F.concat_ws(" ", w["w1"], w["w2"], w["w3"]))  # words hold no blanks
    most = lambda items, n: F.slice(F.sort_array(T.run_lengths(F.sort_array(items)), asc=False), 1, n)
    row = F.struct((F.size("toks") - 2).cast("double").alias("total"), most(F.col("toks"), 3).alias("top"), most(joined, 1).alias("f"))
    top = toks.select("doc_id", F.inline(F.filter(F.array(row), lambda r: (F.size(r["top"]) == 3) & (F.size(r["f"]) == 1))))
    x, y, z = (F.col("top")[k] / F.col("total") for k in range(3))
    return top.select("doc_id", six(M.log_likelihood_top(F.col("total"), F.col("f")[0] / F.col("total"), x, y, z)).alias("score"))


_SENT_TOK = rf"""s AS (SELECT doc_id, unnest({SENT}) AS t, generate_subscripts({SENT}, 1) - 1 AS sent FROM documents),
    st AS (SELECT doc_id, sent, unnest(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}_]+')) AS token, generate_subscripts(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}_]+'), 1) AS pos FROM s)"""


@query(f"WITH {_SENT_TOK}, tok AS (SELECT doc_id || '-' || sent AS doc_id, token, pos FROM st), {TRI} SELECT w1, w2, w3, count(*) AS f FROM tri GROUP BY ALL HAVING count(*) >= 2")
def trigrams_in_sentences(spark, d):
    sents = docs(spark, d).select("doc_id", F.explode(X.sentences("text", "stops")).alias("s"))
    return ngrams.triple_counts(ngrams.triples(sents, X.words("s"))).where("f >= 2")


@query(digest_sql(f"list_filter({SENT}, lambda x: NOT list_contains(['?', '!', '.', '...', '?!', '!?'], x))"))
def sentences_with_words(spark, d):
    return docs(spark, d).select("doc_id", *digest(X.without_bare_terminators(X.sentences("text", "stops"))))


@query(f"""WITH {TOK}, {TRI}, {COUNTS}, x AS (SELECT w1, w2, w3, f.f, CAST(f.f AS DOUBLE) AS g, CAST(a.n AS DOUBLE) AS c1, CAST(b.n AS DOUBLE) AS c2, CAST(c.n AS DOUBLE) AS c3, CAST(z.n AS DOUBLE) AS n
        FROM f JOIN u a ON a.token = w1 JOIN u b ON b.token = w2 JOIN u c ON c.token = w3, s z WHERE f.f >= 3)
    SELECT w1, w2, w3, round(ln(g * n * n / sqrt(c1 * c2 * c3)), 6) AS own, round(log2(g * n * n) - log2(c1 * c2 * c3), 6) AS pmi, round((g - c1 * c2 * c3 / (n * n)) / sqrt(g + 1e-20), 6) AS student_t FROM x""")
def score_maps(spark, d):
    """Own mutual information and the library's two measures, each a table by triple, joined on it."""
    counts = cuts.written(ngrams.triple_counts(ngrams.triples(docs(spark, d), X.words("text"))))
    uni = cuts.written(ngrams.token_counts(ngrams.token_table(docs(spark, d))))
    n = uni.agg(F.sum("n").alias("n"))
    table = lambda name, measure: ngrams.scored(counts.where("f >= 3"), uni, n, M.MEASURES[measure], name).select(*ngrams.TRIPLE, six(name).alias(name))
    return table("own", "mi_root").join(table("pmi", "pmi"), ngrams.TRIPLE).join(table("student_t", "student_t"), ngrams.TRIPLE)


# document vectors from a given table: the 40 most frequent words get the first 8 places of the embeddings 0 to 39
_PARTS = {
    "mean": "q AS (SELECT doc_id, d, sum(x) AS x FROM k GROUP BY ALL), z AS (SELECT doc_id, count(*) AS n FROM st GROUP BY doc_id), o AS (SELECT doc_id, d, x / n AS x FROM q JOIN z USING (doc_id))",
    "distinct": "o AS (SELECT doc_id, d, avg(x) AS x FROM (SELECT DISTINCT doc_id, token, d, x FROM k) GROUP BY ALL)",
    "sentences": "z AS (SELECT doc_id, sent, count(*) AS n FROM st GROUP BY ALL), y AS (SELECT doc_id, count(*) AS m FROM z GROUP BY doc_id), q AS (SELECT doc_id, sent, d, sum(x) / n AS x FROM k JOIN z USING (doc_id, sent) GROUP BY doc_id, sent, d, n), o AS (SELECT doc_id, d, sum(x) / m AS x FROM q JOIN y USING (doc_id) GROUP BY doc_id, d, m)",
    "known": "q AS (SELECT doc_id, sent, d, avg(x) AS x FROM k GROUP BY ALL), o AS (SELECT doc_id, d, avg(x) AS x FROM q GROUP BY ALL)",
    "weighted": "tf AS (SELECT doc_id, token, count(*) AS tf FROM st GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token), n AS (SELECT count(*) AS n FROM documents), wt AS (SELECT doc_id, token, tf * ln((n + 1.0) / (df + 1.0)) AS w FROM tf JOIN df USING (token), n), a AS (SELECT doc_id, sum(w) AS total FROM wt GROUP BY doc_id), y AS (SELECT doc_id, count(DISTINCT sent) AS m FROM st GROUP BY doc_id), o AS (SELECT doc_id, d, sum(x * w) / total / m AS x FROM k JOIN wt USING (doc_id, token) JOIN a USING (doc_id) JOIN y USING (doc_id) GROUP BY doc_id, d, total, m)",
    "dims": "y AS (SELECT doc_id, count(DISTINCT sent) AS m FROM st GROUP BY doc_id), o AS (SELECT doc_id, d, sum(x) / 8 / m AS x FROM k JOIN y USING (doc_id) GROUP BY doc_id, d, m)",
}
for _how, _part in _PARTS.items():

    def _vectors(spark, d, how=_how):
        tok = cuts.written(ngrams.annotation_table(docs(spark, d), X.sentences("text", "stops"), X.words))
        first = R.vocabulary(ngrams.token_counts(tok), 40).withColumn("vec_id", F.row_number().over(W.orderBy(F.desc("n"), "token")) - 1)  # 40 rows
        table = first.join(t(spark, d, "embeddings"), "vec_id").select("token", F.slice(V.doubles("embedding"), 1, 8).alias("vector"))
        terms = F.flatten(F.transform(X.sentences("text", "stops"), X.words))
        weights = T.tf_idf(cuts.written(T.term_counts_in_rows(docs(spark, d), terms)), t(spark, d, "documents").select("doc_id")) if how == "weighted" else None
        return V.document_vectors(tok, table, 8, how, weights).select("doc_id", F.posexplode("vector").alias("d", "x")).withColumn("x", six("x") + F.lit(0.0))

    query(f"""WITH {_SENT_TOK}, v AS (SELECT token, embedding[1:8]::DOUBLE[] AS v FROM (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) - 1 AS vec_id FROM st GROUP BY token) JOIN embeddings USING (vec_id) WHERE vec_id < 40),
        k AS (SELECT doc_id, sent, token, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS d FROM st JOIN v USING (token)), {_part}
        SELECT doc_id, CAST(e.d AS INTEGER) AS d, round(coalesce(x, 0), 6) + 0.0 AS x FROM (SELECT DISTINCT doc_id FROM st) CROSS JOIN (SELECT unnest(range(0, 8)) AS d) e LEFT JOIN o USING (doc_id, d)""", f"document_vectors_{_how}")(_vectors)


@query(None)
def grid_search_svm(spark, d):
    """Kernels as features, by strength of regularization, judged on held-out rows of the training part."""
    rows = R.hash_split(t(spark, d, "embeddings").select("vec_id", (F.col("label") % 2).alias("label"), F.slice(V.doubles("embedding"), 1, 16).alias("embedding")), "vec_id", {"train": 80, "test": 20})
    kernels = {"linear": lambda v: v, "rbf": lambda v: models.fourier_features(v, 16, 32), "poly": models.polynomial_features}

    def estimate(train, test, kernel, reg):
        wide = lambda df: df.withColumn("embedding", kernels[kernel](F.col("embedding")))
        return models.linear_svm(wide(train), wide(test), "embedding", scheme="ovo", max_iter=5, reg=reg)

    found = models.grid_search(rows.where("part = 'train'"), "vec_id", estimate, {"kernel": list(kernels), "reg": [0.01, 1.0]}, metrics.macro)
    return models.ranked_models(found, "f1").select("place", "model", "f1")


@query(None)
def pca_embeddings(spark, d):
    return models.reduced(t(spark, d, "embeddings"), "embedding", 2).select("vec_id", "reduced")


@query(None)
def svm_quality(spark, d):
    rows = R.hash_split(t(spark, d, "embeddings").select("vec_id", (F.col("label") % 2).alias("label"), "embedding"), "vec_id", {"train": 80, "test": 20})
    got = models.linear_svm(rows.where("part = 'train'"), rows.where("part = 'test'"), "embedding", max_iter=5, scheme="ovo")
    return metrics.macro(got.select("label", "prediction"))


@query(None)
def perceptron_labels(spark, d):
    rows = R.hash_split(t(spark, d, "embeddings").select("vec_id", "label", "embedding"), "vec_id", {"train": 80, "test": 20})
    got = models.perceptron(rows.where("part = 'train'"), rows.where("part = 'test'"), [64, 32, 10], "embedding", max_iter=20)
    return metrics.micro(got.select("label", "prediction"))


@query(None)
def lda_topics(spark, d):
    topics = models.Topics(docs(spark, d), X.without_stop_words(X.words("text")), k=4, max_iter=3, vocabulary=1000)
    return topics.terms(10)
