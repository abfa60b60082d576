"""Stems and lemmas. They are computed once for each distinct word, never for each token."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# The published English (Porter2) and Russian Snowball suffixes and exceptions.
_V = "aeiouy"
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_LI = "cdeghkmnrt"
_WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_SAME = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less"}
_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")

_RU_V = "аеиоуыэюя"
_RU_GERUND = (("в", "вши", "вшись"), ("ив", "ивши", "ившись", "ыв", "ывши", "ывшись"))
_RU_ADJ = "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею".split()
_RU_PART = ("ем нн вш ющ щ".split(), "ивш ывш ующ".split())
_RU_VERB = ("ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно".split(), "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю".split())
_RU_NOUN = "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я".split()


def _regions(w: str, vowels: str) -> tuple[int, int]:
    """Starts of R1 and R2: after the first consonant that follows a vowel, and the same again."""
    ends = []
    at = 0
    for _ in range(2):
        m = re.compile(f"[{vowels}][^{vowels}]").search(w, at)
        at = m.end() if m else len(w)
        ends.append(at)
    return ends[0], ends[1]


def _short(w: str, r1: int) -> bool:
    return r1 >= len(w) and (re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$", w) is not None or re.fullmatch(r"[aeiouy][^aeiouy]", w) is not None)


def stem_english(word: str) -> str:
    w = word.lower().replace("’", "'")
    if len(w) <= 2:
        return w
    if w in _WHOLE:
        return _WHOLE[w]
    if w in _SAME:
        return w
    w = w.lstrip("'") if w.startswith("'") else w
    w = re.sub(r"(^|[aeiouy])y", lambda m: m[1] + "Y", w)
    prefix = re.match(r"gener|commun|arsen", w)
    r1, r2 = _regions(w, _V)
    if prefix:
        r1 = prefix.end()
        m = re.compile(r"[aeiouy][^aeiouy]").search(w, r1)
        r2 = m.end() if m else len(w)
    w = re.sub(r"'s'$|'s$|'$", "", w)
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(r"[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in _AFTER_1A:
        return w
    # 1b
    m = re.search(r"(eedly|eed|ingly|edly|ing|ed)$", w)
    if m and m[1] in ("eed", "eedly"):
        if m.start() >= r1:
            w = w[: m.start()] + "ee"
    elif m and re.search(r"[aeiouy]", w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_DOUBLE):
            w = w[:-1]
        elif _short(w, r1):
            w += "e"
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    # 2
    for n in range(7, 1, -1):
        s = w[-n:]
        if s in _STEP2 or s in ("ogi", "li"):
            if len(w) - n >= r1:
                if s in _STEP2:
                    w = w[:-n] + _STEP2[s]
                elif s == "ogi":
                    w = w[:-1] if w[-4:-3] == "l" else w
                elif w[-3:-2] and w[-3] in _LI:
                    w = w[:-2]
            break
    # 3
    for n in range(7, 2, -1):
        s = w[-n:]
        if s in _STEP3 or s == "ative":
            if s == "ative":
                w = w[:-5] if len(w) - 5 >= r2 else w
            elif len(w) - n >= r1:
                w = w[:-n] + _STEP3[s]
            break
    # 4
    for n in range(5, 1, -1):
        s = w[-n:]
        if s in _STEP4 or s == "ion":
            if len(w) - n >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
                w = w[:-n]
            break
    # 5
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not re.search(r"([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$", w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def stem_russian(word: str) -> str:
    w = word.lower().replace("ё", "е")
    m = re.search(f"[{_RU_V}]", w)
    rv = m.end() if m else len(w)
    _, r2 = _regions(w, _RU_V)
    head, tail = w[:rv], w[rv:]

    def drop(groups: tuple, t: str) -> str | None:
        """Without the longest ending: those of the first group stand after а or я, which stays."""
        found = [(len(e), e) for e in groups[1] if t.endswith(e)] + [(len(e), e) for e in groups[0] if t.endswith(e) and t[: -len(e)].endswith(("а", "я"))]
        return t[: -max(found)[0]] if found else None

    def plain(endings: list[str], t: str) -> str | None:
        found = [len(e) for e in endings if t.endswith(e)]
        return t[: -max(found)] if found else None

    t = drop(_RU_GERUND, tail)
    if t is None:
        t = plain(["ся", "сь"], tail)
        tail = tail if t is None else t
        t = plain(_RU_ADJ, tail)
        if t is not None:
            p = drop(_RU_PART, t)
            t = t if p is None else p
        else:
            t = drop(_RU_VERB, tail)
            if t is None:
                t = plain(_RU_NOUN, tail)
    tail = tail if t is None else t
    tail = tail[:-1] if tail.endswith("и") else tail
    for e in ("ость", "ост"):
        if tail.endswith(e) and len(head) + len(tail) - len(e) >= r2:
            tail = tail[: -len(e)]
            break
    if tail.endswith(("ейше", "ейш")):
        tail = tail[: -4 if tail.endswith("ейше") else -3]
    if tail.endswith("нн"):
        tail = tail[:-1]
    elif tail.endswith("ь"):
        tail = tail[:-1]
    return head + tail


# Irregular plural nouns and the regular noun endings, tried in order.
_NOUNS = {"men": "man", "women": "woman", "children": "child", "feet": "foot", "teeth": "tooth", "geese": "goose", "mice": "mouse", "people": "people", "indices": "index", "data": "data", "wolves": "wolf", "lives": "life", "wives": "wife", "knives": "knife", "leaves": "leaf", "halves": "half", "shelves": "shelf"}
_NOUN_ENDINGS = [("sses", "ss"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("ies", "y"), ("men", "man")]


def lemma_noun(word: str) -> str:
    """An approximate noun lemma by exceptions and endings: no dictionary is at hand, so unknown forms follow the rules."""
    w = word.lower()
    if w in _NOUNS:
        return _NOUNS[w]
    for end, by in _NOUN_ENDINGS:
        if w.endswith(end) and len(w) > len(end) + 1:
            return w[: -len(end)] + by
    return w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith(("ss", "us", "is")) else w


STEMMERS = {"english": stem_english, "russian": stem_russian, "lemma": lemma_noun}


def stems(word: Column, language: str = "english") -> Column:
    """A pandas UDF over words; use ``with_stems`` for tables of tokens."""
    f = STEMMERS[language]

    @F.pandas_udf("string")
    def run(words: pd.Series) -> pd.Series:
        return words.map(lambda w: None if w is None else f(w))

    return run(word)


def with_stems(tokens: DataFrame, word: str = "token", stem: str = "stem", language: str = "english") -> DataFrame:
    """tokens with a stem column, computed on the distinct words and joined back (null words have null stems)."""
    distinct = tokens.select(F.col(word).alias("__w")).where("__w IS NOT NULL").distinct()
    table = distinct.withColumn(stem, stems(F.col("__w"), language))
    return tokens.drop(stem).join(table, F.col(word) == F.col("__w"), "left").drop("__w")
