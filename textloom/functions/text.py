"""Text functions, Column in and Column out: segmenters, tokenizers and normalizers. Null in gives null out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from .patterns import PICTOGRAPHS, SENTENCE_SPLITS, STOP_WORDS, TOKEN_CLASSES


def unicode(pattern: str) -> str:
    """A pattern whose word, digit and space classes cover all of Unicode."""
    return "(?U)" + pattern


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: Column | str, kind: str = "words") -> Column:
    """Tokens of one of TOKEN_CLASSES in text order; ``blank`` splits on white space."""
    if kind == "blank":
        return F.filter(F.split(_col(text), r"\s+"), lambda t: t != "")
    return F.regexp_extract_all(_col(text), F.lit(unicode("|".join(TOKEN_CLASSES[kind]))), F.lit(0))


def words(text: Column | str) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def sentences(text: Column | str, kind: str = "guarded", keep_tail: bool = True) -> Column:
    """Trimmed, non-empty sentences by one of SENTENCE_SPLITS, or ``stops``: after each run of terminators.

    With ``stops`` and without ``keep_tail`` the text after the last terminator is dropped.
    """
    text = _col(text)
    if kind == "stops":
        marked = F.regexp_replace(text, r"(\.\.\.|\?\?|[.?!])", "$1\u0001")
        parts = F.transform(F.split(marked, "\u0001"), lambda s: F.trim(s))
        parts = parts if keep_tail else F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
        return F.filter(parts, lambda s: s != "") if keep_tail else parts
    parts = F.split(text, unicode(SENTENCE_SPLITS[kind]))
    if kind == "lines":
        parts = F.flatten(F.transform(parts, lambda s: F.split(s, "\n")))
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, unicode(r"^\s+|\s+$"), "")), lambda s: s != "")


def without_bare_terminators(sents: Column | str, bare: tuple[str, ...] = ("?", "!", ".", "...", "?!", "!?")) -> Column:
    """Sentences that are more than one terminator."""
    return F.filter(_col(sents), lambda s: ~s.isin(*bare))


def sentences_of_tokens(toks: Column | str, ends: tuple[str, ...] = (".", "?", "!", "...")) -> Column:
    """Arrays of tokens, cut after each run of terminators (repeated terminators stay together); the tail is kept."""
    last = F.array(*[F.lit(e) for e in ends])

    def cut(t: Column) -> Column:
        """Slices of the tokens between the places that follow an end and don't hold one; each token is copied once."""
        size = F.size(t)
        begin = lambda i: (i == 0) | (F.array_contains(last, F.get(t, i - 1)) & ~F.array_contains(last, F.get(t, i)))
        first = F.filter(F.sequence(F.lit(0), size - 1), begin)
        pieces = F.get(F.transform(F.array(F.concat(first, F.array(size))), lambda b: F.transform(F.slice(b, F.lit(1), F.size(b) - 1), lambda at, k: F.slice(t, at + 1, F.get(b, k + 1) - at))), F.lit(0))
        return F.when(size > 0, pieces).otherwise(F.array().cast("array<array<string>>"))

    return F.get(F.transform(F.array(_col(toks)), lambda t: F.when(t.isNotNull(), cut(t))), F.lit(0))  # the tokens are taken once


def lower_tokens(toks: Column | str) -> Column:
    return F.transform(_col(toks), F.lower)


def without_stop_words(toks: Column | str, stop: list[str] | None = None) -> Column:
    """Tokens whose lower-cased form isn't a stop word."""
    listed = F.array(*[F.lit(w) for w in (STOP_WORDS if stop is None else stop)])
    return F.filter(_col(toks), lambda t: ~F.array_contains(listed, F.lower(t)))


def without_punctuation(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), unicode(r"[^\w\s]"), "")


def strip_terminator(token: Column | str) -> Column:
    return F.regexp_replace(_col(token), r"[.!?,]$", "")


def lemma_like(token: Column | str) -> Column:
    """Whether a token starts with letters, joined by single - . or @ marks."""
    return _col(token).rlike(r"^(?:[A-Za-z]+[-.@]?)+")


def collapse_blanks(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(text), r"\s+", " "))


def without_digits(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), r"\d", "")


def cyrillic_only(text: Column | str) -> Column:
    """Everything but Russian letters and blanks becomes a blank, runs of blanks one, none at the ends."""
    text = F.regexp_replace(_col(text), "[^ А-ЯЁа-яё]", " ")
    return F.regexp_replace(F.regexp_replace(text, r"\s{2,}", " "), r"^ | $", "")


def social_clean(text: Column | str, keep_tag_words: bool = False) -> Column:
    """Blank-separated words without links, addresses, mentions, hashtags, emoticons, non-ASCII and repeated terminators."""
    steps = [
        (r"\r|\n", " "), (r"(?:https?\://|www\.)\S+", ""), (TOKEN_CLASSES["social"][1], ""), (r"\@\S+", " "),
        (r"#([\w-]+)", "$1") if keep_tag_words else (r"#\S+", " "), (r"(:|;|=)(-|_)?(\)|\(|D|P)", ""), (r"[^\x00-\x7f]", ""), (r"\s\s+", " "), (r"[\?\.\!]+(?=[\?\.\!])", ""),
    ]
    out = _col(text)
    for pattern, by in steps:
        out = F.regexp_replace(out, pattern, by)
    return tokens(out, "blank")


def mail_parts(text: Column | str) -> Column:
    """struct(headers map, body): ``Key: value`` lines up to the first other line; blank lines between them are skipped."""
    lines = F.split(_col(text), "\n")
    head = lambda line: F.instr(line, ": ") > 0
    n = F.aggregate(lines, F.struct(F.lit(0).alias("n"), F.lit(False).alias("done")), lambda s, x: F.when(s["done"] | ~(head(x) | (x == "")), F.struct(s["n"].alias("n"), F.lit(True).alias("done"))).otherwise(F.struct((s["n"] + 1).alias("n"), F.lit(False).alias("done"))), lambda s: s["n"])
    pairs = F.transform(F.filter(F.slice(lines, F.lit(1), n), head), lambda x: F.struct(F.substring_index(x, ": ", 1).alias("k"), F.substring(x, F.instr(x, ": ") + 2, F.length(x)).alias("v")))
    # of a repeated key the last value counts
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    values = F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"])
    return F.struct(F.map_from_arrays(keys, values).alias("headers"), F.array_join(F.slice(lines, n + 1, F.size(lines)), "\n").alias("body"))


def author(text: Column | str) -> Column:
    """What follows ``From:`` up to the next ``word:``; null if absent or blank."""
    sender = F.regexp_extract(_col(text), r"(?s)From:(.*?)(?=\w+:|$)", 1)
    return F.nullif(F.regexp_replace(sender, unicode(r"^\s+|\s+$"), ""), F.lit(""))


def mapped(toks: Column | str, mapping: dict[str, str] | None = None) -> Column:
    """Labels of the tokens that have one, in token order."""
    table = F.create_map(*[F.lit(x) for kv in (PICTOGRAPHS if mapping is None else mapping).items() for x in kv])
    return F.filter(F.transform(_col(toks), lambda t: F.element_at(table, t)), lambda x: x.isNotNull())


def expanded(token: Column | str, mapping: dict[str, str]) -> Column:
    """A token's expansion, looked up in lower case; itself if there is none."""
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.element_at(table, F.lower(_col(token))), _col(token))


#: Ways to cut a text, by name.
SEGMENTERS: dict[str, Callable[[Column], Column]] = {k: (lambda t, k=k: sentences(t, k)) for k in (*SENTENCE_SPLITS, "stops")}
TOKENIZERS: dict[str, Callable[[Column], Column]] = {k: (lambda t, k=k: tokens(t, k)) for k in (*TOKEN_CLASSES, "blank")}
