"""Packing documents into windows of tokens by the online sum-of-squares rule.

Each task packs the rows it reads. The pieces of the windows that it couldn't fill go on to a second online pass, by the
same rule, over the pieces of many tasks; only what is still open at its end is cut to fill whole windows.
"""

from __future__ import annotations

import functools
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import small_batches, table, written

WINDOW, END = 2048, 1
#: Open windows that a task holds at most, for its memory; beyond it all go on (to the second pass, or there to be cut).
OPEN_WINDOWS = 4096
#: Ids of left-over pieces that a task of the second pass gets.
SECOND_IDS = 1 << 24
#: Words in one generation of those whose ids a worker remembers, which changes no result; common words pass on to the next generation, rare ones go.
REMEMBERED = 100_000

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NUMBERS = [(n, pa.int64()) for n in "doc_id start length ids_crc32 doc_tokens sequence_id offset".split()]
_PIECE = pa.schema([*_NUMBERS, ("ids", pa.binary())])


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Remembered:
    """The words met last, in two generations of at most ``most`` each: a full one becomes the old one, and what was old and not met since goes."""

    def __init__(self, most: int):
        self.most = most
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get(self, word: str) -> bytes | None:
        got = self.new.get(word)
        if got is None and (got := self.old.get(word)) is not None:
            self.put(word, got)
        return got

    def put(self, word: str, ids: bytes) -> None:
        if len(self.new) >= self.most:
            self.old, self.new = self.new, {}
        self.new[word] = ids


class WordIds:
    """Ids of texts by the word-level BPE file, as little-endian 32-bit bytes.

    Its pre-tokenizer never joins characters across white space, so the ids of a text are those of its
    white-space-separated words in turn, and each distinct word is tokenized once. Texts with a special token's
    string or with separators on which notions of white space differ go to the tokenizer whole.
    """

    PARTS = r"\p{L}+|'(?:s|t|re|ve|m|ll|d)|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"
    ASCII_PARTS = re.compile(r"[a-z]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\sa-z0-9]+")
    WHOLE = re.compile("<\\|(?:startoftext|endoftext)\\|>|[\x1c-\x1f]", re.I)

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.parts = regex.compile(self.PARTS)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spare = iter(range(256, 512))
        self.letters = [chr(b if b in printable else next(spare)) for b in range(256)]
        self.plain = str.maketrans({b: self.letters[b] for b in range(128)})
        self.of_part, self.of_word = Remembered(REMEMBERED), Remembered(REMEMBERED)

    def _part(self, part: str) -> bytes:
        got = self.of_part.get(part)
        if got is None:
            shown = part.translate(self.plain) if part.isascii() else "".join([self.letters[b] for b in part.encode()])
            got = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(shown)])
            self.of_part.put(part, got)
        return got

    def _word(self, word: str) -> bytes:
        got = self.of_word.get(word)
        if got is not None:
            return got
        if word.isascii():
            parts = self.ASCII_PARTS.findall(word.lower())
        else:
            parts = self.parts.findall(unicodedata.normalize("NFC", word).replace("Σ", "σ").lower())
        got = b"".join([self._part(p) for p in parts])
        self.of_word.put(word, got)
        return got

    def __call__(self, text: str) -> bytes:
        if self.WHOLE.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        known, word = self.of_word.new, self._word
        return b"".join([known[w] if w in known else word(w) for w in text.split()])


@functools.lru_cache(1)
def word_ids(path: str) -> WordIds:
    """One tokenizer a worker, whose tasks follow each other: it and its words are in memory once."""
    return WordIds(path)


class SumOfSquares:
    """Windows being filled, as a count for each fill level and a stack of windows at each level.

    A piece goes to the level (0: a new window) that makes the sum of the squared counts of partially filled
    windows smallest; among equal ones to the fullest. Closed windows are lists of pieces (doc, start, ids, tokens).
    """

    def __init__(self, window: int = WINDOW, most_open: int = OPEN_WINDOWS):
        self.window, self.most_open, self.open = window, most_open, 0
        self.counts = np.zeros(window + 1, np.int64)
        self.at: list[list[list]] = [[] for _ in range(window + 1)]

    def add(self, piece: tuple) -> list[list]:
        """Place a piece of 1 to ``window`` ids; the windows that this closed."""
        n = len(piece[2]) // 4
        counts, top = self.counts, self.window - n
        gain = 2 * (counts[n : self.window + 1] - counts[: top + 1]) + 2  # the change of the sum of squares
        gain[top] -= 1  # a filled window leaves the sum
        gain[0] = 2 * counts[n] + 1  # a new window
        full = counts[: top + 1] > 0
        full[0] = True
        level = top - int(np.argmin(np.where(full, gain, np.iinfo(np.int64).max)[::-1]))
        if level:
            window = self.at[level].pop()
            counts[level] -= 1
            self.open -= 1
        else:
            window = []
        window.append(piece)
        if level + n == self.window:
            return [window]
        self.at[level + n].append(window)
        counts[level + n] += 1
        self.open += 1
        return []

    @property
    def crowded(self) -> bool:
        return self.open > self.most_open

    def drain(self) -> list[tuple]:
        """Take the pieces out of all open windows, the fullest first."""
        pieces = [p for level in range(self.window - 1, 0, -1) for w in self.at[level] for p in w]
        self.at = [[] for _ in range(self.window + 1)]
        self.counts[:] = 0
        self.open = 0
        return pieces


def filled(pieces: list[tuple], window: int) -> list[list]:
    """Windows filled with the pieces in turn, which are cut for it; all are full but the last."""
    out, current, room = [], [], window
    for doc, start, ids, tokens in pieces:
        while ids:
            head, ids = ids[: 4 * room], ids[4 * room :]
            current.append((doc, start, head, tokens))
            start += len(head) // 4
            room -= len(head) // 4
            if not room:
                out.append(current)
                current, room = [], window
    return out + [current] if current else out


class _Numbered:
    """Rows of closed windows, numbered on from a task's first number, and of pieces that go on with their ids."""

    def __init__(self, first: int):
        self.sequence = first

    def rows(self, windows: list[list], left: list[tuple] = ()) -> Iterator[pa.RecordBatch]:
        out = []
        for w in windows:
            offset = 0
            for doc, start, ids, tokens in w:
                out.append((doc, start, len(ids) // 4, zlib.crc32(ids), tokens, self.sequence, offset, None))
                offset += len(ids) // 4
            self.sequence += 1
        out += [(doc, start, len(ids) // 4, None, tokens, None, None, ids) for doc, start, ids, tokens in left]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _PIECE)], schema=_PIECE)


def pack(docs: DataFrame, tokenizer_file: str | None = None, window: int = WINDOW, end_id: int = END) -> DataFrame:
    """Pieces of all documents (doc_id, text), placed in windows of ``window`` tokens.

    Documents longer than a window first fill whole ones; the rest is placed online, by a first pass in the task that
    reads the document, and, where its window stayed unfilled, by a second over SECOND_IDS left-over ids a task. At the
    end of that the pieces of unfilled windows are cut to fill whole ones, so at most one sequence a task of the second
    pass needs padding. A null text is empty; every document ends with ``end_id``, so the empty one has one token; null
    ids are kept; repeated rows are packed each; texts of any length are taken whole; among equally good levels the
    fullest counts; an empty table gives an empty table; other columns are left out.
    """
    small_batches(docs.sparkSession)
    path = tokenizer_file or tokenizer_path()
    end = np.array([end_id], "<u4").tobytes()

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, packer, out = word_ids(path), SumOfSquares(window), _Numbered(TaskContext.get().partitionId() << 32)
        for batch in batches:
            closed, left = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = ids_of(text or "") + end
                tokens, start = len(ids) // 4, 0
                while tokens - start >= window:
                    closed.append([(doc, start, ids[4 * start : 4 * (start + window)], tokens)])
                    start += window
                if start < tokens:
                    closed += packer.add((doc, start, ids[4 * start :], tokens))
                if packer.crowded:
                    left += packer.drain()
            yield from out.rows(closed, left)
        yield from out.rows([], packer.drain())

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, out = SumOfSquares(window), _Numbered(1 << 61 | TaskContext.get().partitionId() << 32)
        for batch in batches:
            closed = []
            for doc, start, tokens, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids"))):
                closed += packer.add((doc, start, ids, tokens))
                if packer.crowded:
                    closed += filled(packer.drain(), window)
            yield from out.rows(closed)
        yield from out.rows(filled(packer.drain(), window))

    first = written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(first_pass, f"{PIECE}, ids binary"), "packing-first")
    left = first.where("ids IS NOT NULL").select("doc_id", "start", "doc_tokens", "ids")
    n_ids = first.where("ids IS NOT NULL").agg(F.sum("length")).first()[0] or 0
    second = left.repartition(max(1, -(-n_ids // SECOND_IDS))).mapInArrow(second_pass, f"{PIECE}, ids binary")
    return first.where("ids IS NULL").union(second).drop("ids")


def op8_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
