"""Sentence segmentation that never cuts inside addresses, numbers, titles and initials."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F

# Titles, company endings and address endings whose dot doesn't end a sentence.
_TITLES = "Mr|St|Mrs|Ms|Dr|Prof|Capt|Lt|Mt|Inc|Ltd|Jr|Sr|Co|Ph\\.D|e\\.g|i\\.e|vs"
_SITES = "com|net|org|io|gov|edu|me|ru|de|fr"

#: Stretches whose dots stay inside a sentence, in order.
_KEEP = re.compile(
    rf"""[\w.+-]+@[\w-]+(?:\.[\w-]+)+          # mail address
    |(?:https?://|www\.)\S*[^\s.,!?]           # link
    |\w[\w-]*\.(?:{_SITES})\b                  # site name
    |\+?\d[\d().\s-]{{6,}}\d                   # phone number
    |\d+(?:\.\d+)+                             # decimals, versions
    |\b(?:[A-Za-z]\.){{2,}}(?!\s+[A-Z])        # initialism that doesn't end a sentence
    |\b(?:{_TITLES})\.                         # title
    |\b[A-Z]\.(?=\s)                           # initial""",
    re.X,
)
_END = re.compile(r"(?:[.?!]+[\"”')]*|\n+)\s*")


def split_protected(text: str) -> list[str]:
    """Trimmed, non-empty sentences; the tail is kept."""
    held = [m.span() for m in _KEEP.finditer(text)]
    out, start, k = [], 0, 0
    for m in _END.finditer(text):
        while k < len(held) and held[k][1] <= m.start():
            k += 1
        if k < len(held) and held[k][0] <= m.start() < held[k][1] and not (m.end() > held[k][1] and text[m.start()] == "\n"):
            continue
        out.append(text[start : m.end()])
        start = m.end()
    out.append(text[start:])
    return [s for s in (x.strip() for x in out) if s]


def protected_sentences():
    """A pandas UDF: text -> array of sentences."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else split_protected(t))

    return run
