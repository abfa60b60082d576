import re

import pytest
from pyspark.sql import functions as F

from textloom.functions import measures, text as X
from textloom.functions.lexer import lex, typed_tokens
from textloom.functions.patterns import ABBREVIATIONS, TOKEN_CLASSES
from textloom.functions.stem import lemma_noun, stem_english, stem_russian, with_stems


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "t string").select(*columns).first()


@pytest.mark.parametrize("text, want", [("", []), ("foo bar", ["foo", "bar"]), ("    ", []), ("foo\tbar\nbaz    qux\t\t\t\nquux", ["foo", "bar", "baz", "qux", "quux"])])
def test_blank_tokens(spark, text, want):
    assert one(spark, text, X.tokens("t", "blank"))[0] == want


def test_all_tokenizers_and_segmenters_take_null(spark):
    row = one(spark, None, *[f(F.col("t")) for f in (*X.TOKENIZERS.values(), *X.SEGMENTERS.values())])
    assert all(v is None for v in row)


@pytest.mark.parametrize(
    "kind, text, want",
    [
        ("mail_phone_link", "write had221@gmd.com or +78554434555, see https://bit.ly/x", ["write", "had221@gmd.com", "or", "+78554434555", "see", "https://bit.ly/x"]),
        ("simple", "a@b.ru +7-901-000-00-00 naïve", ["a@b.ru", "+7-901-000-00-00", "naïve"]),
        ("news", "U.S grew 3,5 well-known dog's end.", ["U.S", "grew", "3,5", "well-known", "dog's", "end", "."]),
        ("news", "at 12:30 on 1.02.2003 corporate", ["at", "12:30", "on", "1.02", ".", "2003", "corpo", "rate"]),
        ("news_social", "at 9:05 I'd go.", ["at", "9:05", "I", "'", "d", "go", "."]),
        ("tweet", "see #tag @me don't!", ["see", "#tag", "@me", "don't", "!"]),
        ("letters", "Привет, world 5", ["Привет", "world"]),
        ("russian", "Да?! нет... x@y.ru", ["Да", "?!", "нет", "...", "x@y.ru"]),
        ("masked", "I <3 you :)", ["I", "<3", "you", ":)"]),
    ],
)
def test_token_classes(spark, kind, text, want):
    assert one(spark, text, X.tokens("t", kind))[0] == want


@pytest.mark.parametrize("kind", ["news", "news_social", "inner_marks", "social", "masked"])
def test_token_classes_with_look_around_over_whole_texts(spark, kind):
    """Python's own engine takes the same patterns; SQL has no look-around."""
    pattern = re.compile("|".join(re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), c) for c in TOKEN_CLASSES[kind]))
    odd = ["at 12:30, 1,5 U.N corp. x-ray dog's @me #tag a.b@c.de \U0001f31e (555) 123-4567 <3 :-) 50% $5 I'm well-known?!", "A.B. said: \"re-do it\"\nok.", "", None]
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").union(spark.createDataFrame([(x,) for x in odd], "text string"))
    for r in rows.select("text", X.tokens("text", kind).alias("t")).collect():
        assert r.t == (None if r.text is None else [m[0] for m in pattern.finditer(r.text)])


def test_sentences(spark):
    assert one(spark, "One... two? three! four", X.sentences("t", "stops"))[0] == ["One...", "two?", "three!", "four"]
    assert one(spark, "One... two? three! four", X.sentences("t", "stops", keep_tail=False))[0] == ["One...", "two?", "three!"]
    assert one(spark, "Dr. No went. He left! ok", X.sentences("t", "guarded"))[0] == ["Dr. No went.", "He left!", "ok"]
    assert one(spark, "A b. C d. e", X.sentences("t", "capital"))[0] == ["A b.", "C d. e"]
    assert one(spark, "a.b!!c?", X.sentences_of_tokens(F.array(*map(F.lit, ["a", ".", "b", "!", "!", "c", "?"]))))[0] == [["a", "."], ["b", "!", "!"], ["c", "?"]]


def test_normalizers(spark):
    assert one(spark, " a  b\n", X.collapse_blanks("t"))[0] == "a b"
    assert one(spark, "5 Мир, мир! x", X.cyrillic_only("t"))[0] == "Мир мир"
    assert one(spark, "a, b-c!", X.without_punctuation("t"))[0] == "a bc"
    assert one(spark, "The cat", X.without_stop_words(X.tokens("t", "blank")))[0] == ["cat"]
    assert one(spark, "see http://x.y @me #tag word :) é wow!!!", X.social_clean("t"))[0] == ["see", "word", "wow!"]
    m = one(spark, "From: a b\nTo: c\n\nHello: no\nrest: x\nbody line\nmore: y", X.mail_parts("t"))[0]
    assert m.headers["From"] == "a b" and m.body == "body line\nmore: y"
    assert one(spark, "From: jane doe Subject: x", X.author("t"))[0] == "jane doe" and one(spark, "nobody", X.author("t"))[0] is None
    assert one(spark, "x 🌩 🐦", X.mapped(X.tokens("t", "blank")))[0] == ["weather", "birds"]
    assert one(spark, "Dr.", X.expanded("t", ABBREVIATIONS))[0] == "doctor"


def test_lexer(spark):
    text = "Dr. Who's 4th call: 8(901)000-00-00, at 10.0.0.1! \"so\" 5-6 é"
    got = lex(text)
    assert [k for _, k, _ in got if k != "whitespace"] == ["word", "word", "numeral", "word", "other", "mobile_phone", "punct", "word", "ipaddress", "punct", "quoted", "number", "other"]
    assert got[0] == (0, "word", "doctor") and sum(len(t) for _, _, t in got[1:]) + 3 == len(text)
    assert ("mobile_phone_usa", "+1(234)567-8901") in [(k, t) for _, k, t in lex("+1(234)567-8901", news=False)]
    assert len(one(spark, text, typed_tokens()(F.col("t")))[0]) == len(got)


def test_lexer_holds_few_tokens_at_a_time(spark, monkeypatch):
    import pandas as pd

    from textloom.functions import lexer

    texts = ["one two, 3 " * 400, None, "", "x"] * 250
    pieces = list(typed_tokens().func(iter([pd.Series(texts)])))
    assert sum(map(len, pieces)) == len(texts) and max(sum(len(x) for x in p if x) for p in pieces) < 2 * lexer.CHARS
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts[:9])], "doc_id long, text string").coalesce(1)
    want = sorted((k, *x) for k, t in enumerate(texts[:9]) if t for x in lex(t))
    assert sorted(map(tuple, lexer.typed_rows(rows).collect())) == want
    assert rows.select("doc_id", F.size(typed_tokens()(F.col("text"))).alias("n")).where("n > 0").agg(F.sum("n")).first()[0] == len(want)


def test_sentences_of_many_tokens_take_time_by_their_number(spark):
    import time

    began = time.perf_counter()
    row = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(200_000)), lambda k: F.when(k % 10 == 0, ".").otherwise("a")).alias("t"))
    assert row.select(F.size(X.sentences_of_tokens("t"))).first()[0] == 20_000 and time.perf_counter() - began < 15
    odd = spark.createDataFrame([([],), (None,), ([".", "."],), (["a", None, ".", None, ".", "b"],)], "t array<string>")
    assert [r[0] for r in odd.select(X.sentences_of_tokens("t")).collect()] == [[], None, [[".", "."]], [["a", None, ".", None, "."], ["b"]]]


# published vocabulary pairs
@pytest.mark.parametrize("word, stem", [("consign", "consign"), ("consigned", "consign"), ("consistency", "consist"), ("knightly", "knight"), ("knives", "knive"), ("generate", "generat"), ("generic", "generic"), ("hopping", "hop"), ("hoping", "hope"), ("flies", "fli"), ("dying", "die"), ("happily", "happili"), ("nationalization", "nation"), ("skies", "sky"), ("sensational", "sensat"), ("controlling", "control"), ("cry", "cri"), ("by", "by"), ("say", "say"), ("ties", "tie"), ("agreed", "agre"), ("succeed", "succeed"), ("rate", "rate")])
def test_english_stems(word, stem):
    assert stem_english(word) == stem


@pytest.mark.parametrize("word, stem", [("важная", "важн"), ("важнейшие", "важн"), ("вагонами", "вагон"), ("валяется", "валя"), ("поделившись", "подел"), ("павлович", "павлович"), ("пальцами", "пальц"), ("радость", "радост"), ("длинный", "длин")])
def test_russian_stems(word, stem):
    assert stem_russian(word) == stem


def test_lemmas_and_join(spark):
    assert [lemma_noun(w) for w in ("cities", "men", "boxes", "cats", "bus", "glasses", "news")] == ["city", "man", "box", "cat", "bus", "glass", "new"]
    got = with_stems(spark.createDataFrame([("Cats", 1), (None, 2), ("Cats", 3)], "token string, n int"))
    assert sorted((r.n, r.stem) for r in got.collect()) == [(1, "cat"), (2, None), (3, "cat")]


def test_measures(spark):
    args = [F.lit(x) for x in (4, 10, 20, 30, 1000)]
    row = one(spark, "", *[f(*args).alias(k) for k, f in measures.MEASURES.items()])
    assert row.t_score == pytest.approx((4 - 10 * 20 * 30 / 1e6) / 2) and row.mi == pytest.approx(row.mi_marginal)
    assert row.mi_two == pytest.approx(14.28771) and row.mi_like == pytest.approx(64 / 6000)
    big = one(spark, "", measures.t_score(*[F.lit(x) for x in (5, 10**9, 10**9, 10**9, 10**10)]))[0]
    assert big == pytest.approx((5 - 1e27 / 1e20) / 5**0.5)


def test_protected_sentences(spark):
    from textloom.functions.protected import protected_sentences, split_protected

    text = "Mail a.b@c.org now. Dr. No paid 3.50 at www.x.com! Call +7 901 000.00.00, e.g. today?! Last one"
    want = ["Mail a.b@c.org now.", "Dr. No paid 3.50 at www.x.com!", "Call +7 901 000.00.00, e.g. today?!", "Last one"]
    assert split_protected(text) == want and split_protected("") == []
    assert one(spark, text, protected_sentences()(F.col("t")))[0] == want
