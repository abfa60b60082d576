"""Repeated byte strings across a corpus, by distributed prefix doubling.

A string of ``length`` bytes repeats if it starts at two places. Places first get the rank of their next 3/8 of
``length`` bytes, a 64-bit content hash: the only hash there is. From then on ranks are doubled: the rank at a place and
the rank one offset on form a pair, Spark sorts all pairs, places of a unique pair leave, and equal pairs get one new
rank; the offsets are 3/8 and then 1/4 of the length. Two strings so count as equal if four 64-bit ranks are, 256 bits.

Doubling all places of a corpus would sort every byte of it several times, so only those are doubled that can matter:

1. Of every run of ``length`` bytes the place with the smallest rank inside it is its sample (leftmost among equals).
   Equal runs have equal samples at equal distances, so a run whose sample is unique is unique.
2. The 3/4 of its bytes around a sample that every run of one class (the distance to the sample, in quarters) holds are
   a pair of ranks. Runs leave if these bytes are unique.
3. Neighbouring runs that share a sample form a stretch. If the bytes under a stretch stand elsewhere too, all its runs
   repeat. Stretches unlike all others, and one copy of each that they could share runs with, are cut into pieces of
   ``length / 16`` starts, which are compared likewise: by the bytes that all runs of the piece hold, then whole.
4. What is left, where a repeat begins or ends, is doubled start by start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from .common import bounded, columns, discard, numbered, parallelism, release, small_batches, table, unused, written

LENGTH = 400
#: Repeated passages besides: so many bytes, and so many words where these take fewer bytes.
PASSAGE, PASSAGE_WORDS = 240, 51
#: Rows of a batch that a task hands on.
FLUSH = 100_000
#: Bytes of short texts that a task works on at once.
TOGETHER = 1 << 17
_MASK = (1 << 64) - 1

PAIR = "near long, far long, key long, at int, part int"
_PAIR = pa.schema([("near", pa.int64()), ("far", pa.int64()), ("key", pa.int64()), ("at", pa.int32()), ("part", pa.int32())])
STRETCH = "core array<bigint>, whole array<bigint>, n int, key long, lo int"
_STRETCH = pa.schema([("core", pa.list_(pa.int64())), ("whole", pa.list_(pa.int64())), ("n", pa.int32()), ("key", pa.int64()), ("lo", pa.int32())])


class Ranks:
    """Content hashes of all substrings of one length of a text: a polynomial over random odd byte values, mod 2^64, scrambled."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, length: int, size: int = 1 << 16, seed: int = 11):
        self.length = length
        self.values = np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self._grow(size)

    def _grow(self, size: int) -> None:
        def powers(base: int) -> np.ndarray:
            p = np.full(size, base, np.uint64)
            p[0] = 1
            return np.cumprod(p, dtype=np.uint64)

        self.size, self.powers, self.inverse = size, powers(self.BASE), powers(pow(self.BASE, -1, 1 << 64))

    def of(self, text: str) -> np.ndarray:
        return self.of_bytes(text.encode())

    def of_bytes(self, text: bytes) -> np.ndarray:
        data = np.frombuffer(text, np.uint8)
        if len(data) > self.size:
            self._grow(2 * len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.powers[: len(data)], dtype=np.uint64, out=sums[1:])
        x = (sums[self.length :] - sums[: -self.length]) * self.inverse[: max(0, len(sums) - self.length)]
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        return x


def sampled(ranks: np.ndarray, window: int) -> np.ndarray:
    """For each run of ``window`` positions the leftmost one of smallest rank, compared by its high 32 bits wherever the run stands."""
    bits = np.uint64(32)
    packed = ranks >> bits << bits | np.arange(len(ranks), dtype=np.uint64)
    padded = np.full(-(-len(ranks) // window) * window, _MASK, np.uint64)
    padded[: len(ranks)] = packed
    rows = padded.reshape(-1, window)
    ahead = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(rows, 1).ravel()
    least = np.minimum(ahead[: len(ranks) - window + 1], behind[window - 1 : len(ranks)])
    return (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def steps(ascending: np.ndarray) -> np.ndarray:
    """The distinct values of an ascending array."""
    return ascending[np.concatenate([[True], ascending[1:] != ascending[:-1]])]


def cover(ranks: np.ndarray, lo: np.ndarray, size: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """For each lo the ranks that cover the next ``size`` bytes, the last one flush with their end; and how many they are."""
    n = -(-size // base)
    ends = np.cumsum(n)
    step = np.arange(ends[-1]) - np.repeat(ends - n, n)
    at = np.repeat(lo, n) + np.minimum(step * base, np.repeat(size, n) - base)
    return ranks[at], n


def spread(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The n numbers from each lo on."""
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _numbers(column: pa.Array, row: int) -> np.ndarray:
    return column[row].values.to_numpy().astype(np.int64)


def sample_rows(docs: DataFrame, length: int) -> DataFrame:
    """(rank, key, own) for the samples of each text (key, text): its distinct ranks, and whether one stands at two places of it.

    The texts of about TOGETHER bytes are laid end to end and worked on at once; runs that cross from one into the next don't count.
    """
    base = length * 3 // 8
    schema = pa.schema([("rank", pa.int64()), ("key", pa.int64()), ("own", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Ranks(base)

        def block(keys: list[int], texts: list[bytes]) -> pa.RecordBatch:
            sizes = np.array([len(t) for t in texts])
            ends = np.cumsum(sizes)
            r = hashes.of_bytes(b"".join(texts))
            starts = spread(ends - sizes, sizes - length + 1)  # of whole runs
            of_text = np.repeat(np.arange(len(texts)), sizes - length + 1)
            at = sampled(r, length - base + 1)[starts]
            first = np.concatenate([[True], (at[1:] != at[:-1]) | (of_text[1:] != of_text[:-1])])
            ranks, of_text = r[at[first]], of_text[first]
            order = np.lexsort((ranks, of_text))
            ranks, of_text = ranks[order], of_text[order]
            new = np.flatnonzero(np.concatenate([[True], (ranks[1:] != ranks[:-1]) | (of_text[1:] != of_text[:-1])]))
            return pa.RecordBatch.from_arrays([_signed(ranks[new]), pa.array(np.array(keys, np.int64)[of_text[new]]), pa.array(np.diff(np.append(new, len(ranks))) > 1)], schema=schema)

        keys, texts, held = [], [], 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys.append(key)
                texts.append(text.encode())
                held += len(texts[-1])
                if held >= TOGETHER:
                    yield block(keys, texts)
                    keys, texts, held = [], [], 0
        if texts:
            yield block(keys, texts)

    return docs.mapInArrow(run, "rank long, key long, own boolean")


def _heads(ranks: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each run its sample, and the first of the bytes that all runs of its class hold."""
    sample = sampled(ranks, length - length * 3 // 8 + 1)
    return sample, sample - (sample - np.arange(len(sample))) // (length // 4) * (length // 4)


def _pairs(ranks: np.ndarray, at: np.ndarray, offsets: list[int], base: int, key: int) -> tuple:
    """Columns of pairs of ranks one offset apart, from some bytes after each place on (part 0, 1 and so on)."""
    every = np.concatenate([at + o for o in offsets])
    return ranks[every].view(np.int64), ranks[every + base].view(np.int64), np.full(len(every), key, np.int64), np.tile(at, len(offsets)).astype(np.int32), np.repeat(np.arange(len(offsets), dtype=np.int32), len(at))


def _gathered(columns_: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Record batches of many texts' columns; a list column comes as its values and their counts."""
    held, rows = [], 0

    def batch() -> pa.RecordBatch:
        parts, out = iter([np.concatenate(c) for c in zip(*held)]), []
        for field in schema:
            values = next(parts)
            if pa.types.is_list(field.type):
                ends = np.concatenate([[0], np.cumsum(next(parts))]).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(values)))
            else:
                out.append(pa.array(values))
        return pa.RecordBatch.from_arrays(out, schema=schema)

    for c in columns_:
        held.append(c)
        rows += len(c[-1])
        if rows >= FLUSH:
            yield batch()
            held, rows = [], 0
    if held:
        yield batch()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(key, text, lists...) of each row, lists as numpy arrays."""
    for batch in batches:
        for k, (key, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            yield key, text, *(batch.column(c)[k].values.to_numpy() for c in range(2, batch.num_columns))


def class_pairs(docs: DataFrame, length: int) -> DataFrame:
    """A pair for every class of runs whose sample repeats; docs: (key, text, ranks), the repeated samples' ranks."""
    base = length * 3 // 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Ranks(base)

        def columns_() -> Iterator[tuple]:
            for key, text, repeated in _rows(batches):
                r = hashes.of(text)
                sample, head = _heads(r, length)
                here, again = steps(sample), np.zeros(len(r), bool)
                again[here] = np.isin(r[here], repeated.view(np.uint64))
                yield _pairs(r, np.unique(head[again[sample]]), [0], base, key)

        yield from _gathered(columns_(), _PAIR)

    return docs.mapInArrow(run, PAIR)


def start_pairs(docs: DataFrame, length: int) -> DataFrame:
    """Two pairs for each of single starts, a quarter apart, which cover its run; docs: (key, text, los, ns), the last two of ranges of starts."""
    base = length * 3 // 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Ranks(base)
        yield from _gathered((_pairs(hashes.of(text), spread(lo.astype(np.int64), n.astype(np.int64)), [0, length // 4], base, key) for key, text, lo, n in _rows(batches)), _PAIR)

    return docs.mapInArrow(run, PAIR)


def stretches(docs: DataFrame, length: int, grain: int = 0) -> DataFrame:
    """(core, whole, n, key, lo): n neighbouring starts from lo on that share a sample; the ranks that cover what their runs
    have in common with those that could equal them, and those that cover all bytes under them.

    docs: (key, text, heads) with the heads of open classes: whole stretches, whose core is the sample's rank; or
    (key, text, los, ns): their starts cut where the distance to the sample reaches a multiple of ``grain``, whose core
    are the bytes that each run of such a piece holds.
    """
    base = length * 3 // 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Ranks(base)

        def columns_() -> Iterator[tuple]:
            for key, text, *lists in _rows(batches):
                r = hashes.of(text)
                sample, head = _heads(r, length)
                at = np.sort(spread(*(x.astype(np.int64) for x in lists))) if grain else np.flatnonzero(np.isin(head, lists[0].astype(np.int64)))
                if not len(at):
                    continue
                sample = sample[at]
                piece = (sample - at) // grain if grain else sample
                first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (sample[1:] != sample[:-1]) | (piece[1:] != piece[:-1])]))
                n, lo = np.diff(np.append(first, len(at))), at[first]
                core = cover(r, sample[first] - piece[first] * grain, np.full(len(lo), length - grain + 1), base) if grain else (r[sample[first]], np.ones(len(lo), np.int64))
                whole = cover(r, lo, n - 1 + length, base)
                yield core[0].view(np.int64), core[1], whole[0].view(np.int64), whole[1], n.astype(np.int32), np.full(len(lo), key, np.int64), lo.astype(np.int32)

        yield from _gathered(columns_(), _STRETCH)

    return docs.mapInArrow(run, STRETCH)


def reranked(pairs: DataFrame) -> DataFrame:
    """(rank, key, at, part) of the rows of pairs (near, far, key, at, part) whose pair stands in another row too; equal pairs get one rank.

    All rows are sorted by their pair, dealt to tasks by range, so a pair that very many rows have is spread over several.
    Each task numbers the pairs it holds. Only its first and its last pair can go on in another task: these (two a task
    at most) are brought together after, and share the least of their numbers.
    """
    pairs = pairs if hasattr(pairs, "scratch_path") else written(pairs, "repeats-unsorted")  # it is read twice, for the bounds of the ranges too
    ordered = pairs.repartitionByRange(parallelism(pairs.sparkSession), "near", "far", "key", "at", "part").sortWithinPartitions("near", "far")
    schema = pa.schema([("rank", pa.int64()), ("near", pa.int64()), ("far", pa.int64()), ("twice", pa.bool_()), ("key", pa.int64()), ("at", pa.int32()), ("part", pa.int32())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, held = (TaskContext.get().partitionId() << 40) - 1, None  # held: the last pair's rows so far (its last, once there are two), not handed on yet

        def rows(ranks, near, far, key, at, part, edge, twice) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ranks), pa.array(near, mask=~edge), pa.array(far, mask=~edge), pa.array(twice), pa.array(key), pa.array(at), pa.array(part)], schema=schema)

        first = True
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held[:5], cols)]
            near, far = cols[0], cols[1]
            new = np.concatenate([[held is None], (near[1:] != near[:-1]) | (far[1:] != far[:-1])])
            ranks = rank + np.cumsum(new)
            alike = np.zeros(len(near), bool)
            alike[1:] |= ~new[1:]
            alike[:-1] |= ~new[1:]
            if held is not None:
                alike[0] |= held[5]
            of_first = (ranks == ranks[0]) & first
            last = len(near) - 1
            # all rows but the last go on; whether that one's pair is unique the next batch shows
            go = np.flatnonzero((alike | of_first)[:last])
            if len(go):
                yield rows(ranks[go], *(c[go] for c in cols), of_first[go], alike[go])
            first = first and bool(of_first[last])
            held = [*(c[last:] for c in cols), bool(alike[last])]
            rank = int(ranks[last])
        if held is not None:
            # rows of the last pair that went on before the end was known carry no pair; their number leads to it
            yield rows(np.array([rank]), *held[:5], np.array([True]), np.array([held[5]]))

    out = written(ordered.mapInArrow(number, "rank long, near long, far long, twice boolean, key long, at int, part int"), "repeats-ranked")
    edges = out.where("near IS NOT NULL").groupBy("near", "far", "rank").agg(F.max("twice").alias("twice"))
    edges = written(edges, "repeats-edges")  # at most two rows a task
    joined = edges.groupBy("near", "far").agg(F.min("rank").alias("to"), (F.max("twice") | (F.count("*") > 1)).alias("again"))
    shared = F.broadcast(edges.join(joined, ["near", "far"]).select("rank", "to", "again"))
    ranks = written(out.join(shared, "rank", "left").where("again IS NULL OR again").select(F.coalesce("to", "rank").alias("rank"), "key", "at", "part"), "repeats-ranks")
    discard(out, edges, pairs)
    release(ranks.sparkSession)
    return ranks


def repeated_starts(pairs: DataFrame) -> DataFrame:
    """(key, at) of the starts whose two parts' ranks, doubled, stand at another start too."""
    halves = reranked(pairs)
    part = lambda k: F.max(F.when(F.col("part") == k, F.col("rank")))
    both = halves.groupBy("key", "at").agg(part(0).alias("near"), part(1).alias("far")).where("near IS NOT NULL AND far IS NOT NULL")
    starts = reranked(both.select("near", "far", "key", "at", F.lit(0).alias("part")))
    discard(halves)
    return starts.select("key", "at")


def alike_and_open(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of stretches: (key, lo, n) of those whose bytes stand under another one, and of those, one of each kind, whose starts must be looked at singly."""
    kinds = written(rows.groupBy("core", "whole", "n").agg(F.count("*").alias("c"), F.first("key").alias("key"), F.first("lo").alias("lo")), "repeats-kinds")  # both of one row, any of them
    mixed = written(kinds.groupBy("core").agg(F.min("c").alias("least"), F.count("*").alias("kinds")).where("least = 1 AND kinds > 1").select("core"), "repeats-mixed")
    lone = written(kinds.join(mixed, "core").select("key", "lo", "n"), "repeats-lone")
    alike = written(rows.join(kinds.where("c > 1").select("core", "whole", "n"), ["core", "whole", "n"]).select("key", "lo", "n"), "repeats-alike")
    discard(kinds, mixed)
    return alike, lone


def covered_runs(lo: np.ndarray, n: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs covered by ``length`` bytes from each of n starts from each lo."""
    order = np.argsort(lo, kind="stable")
    a, b = lo[order], np.maximum.accumulate((lo + n - 1 + length)[order])
    new = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
    return list(zip(a[new].tolist(), np.append(b[new[1:] - 1], b[-1]).tolist()))


def cut_runs(data: bytes, runs: list[tuple[int, int]], whole_characters: bool = False) -> tuple[bytes, list[tuple[int, int]]]:
    """The bytes outside the runs; with ``whole_characters`` a character that is not wholly inside a run stays."""
    kept, at, cut = [], 0, []
    for a, b in runs:
        if whole_characters:
            while a < b and data[a] & 0xC0 == 0x80:
                a += 1
            while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
                b -= 1
        if a < b:
            kept.append(data[at:a])
            at = b
            cut.append((a, b))
    return b"".join([*kept, data[at:]]), cut


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(digest, spans) of the distinct texts that lose bytes: the maximal runs [a, b) covered by strings of ``length`` bytes
    that also start elsewhere; digest is the SHA-256 of the text, in binary. Rules as for ``repeated_runs``."""
    if length % 16:
        raise ValueError(f"not a multiple of 16: {length}")
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") >= length)
    texts = texts.select("text", F.unhex(F.sha2("text", 256)).alias("digest"), F.xxhash64("text").alias("hash"))
    copies = texts.select("digest", F.octet_length("text").cast("long").alias("bytes")).groupBy("digest").agg(F.count("*").alias("n"), F.max("bytes").alias("bytes")).where("n > 1")
    copies = written(copies, "repeats-copies")
    copied = bounded(copies.select("digest"))

    samples = written(sample_rows(texts.select("hash", "text"), length), "repeats-samples")
    shared = written(samples.groupBy("rank").agg(F.min("key").alias("a"), F.max("key").alias("b"), F.max("own").alias("own")).where("a < b OR own").select("rank"), "repeats-shared")
    mine = written(samples.join(shared, "rank").groupBy(F.col("key").alias("hash")).agg(F.collect_set("rank").alias("ranks")), "repeats-ranks")
    discard(samples, shared)
    found = texts.join(bounded(mine.select("hash")), "hash", "left_semi")
    # only copies are brought together to leave one of each
    chosen = found.join(copied, "digest", "left_anti").unionByName(found.join(copied, "digest", "left_semi").dropDuplicates(["digest"]))
    chosen = written(chosen.withColumn("key", F.monotonically_increasing_id()), "repeats-chosen")
    release(spark)

    def ranges(rows: DataFrame) -> DataFrame:
        both = rows.groupBy("key").agg(F.collect_list(F.struct("lo", "n")).alias("s"))
        return written(both.select("key", F.col("s.lo").alias("los"), F.col("s.n").alias("ns")), "repeats-ranges")

    of_classes = reranked(class_pairs(chosen.join(bounded(mine), "hash").select("key", "text", "ranks"), length))
    heads = written(of_classes.groupBy("key").agg(F.collect_set("at").alias("heads")), "repeats-heads")
    discard(mine, of_classes)
    whole = written(stretches(chosen.join(bounded(heads), "key").select("key", "text", "heads"), length), "repeats-stretches")
    alike, lone = alike_and_open(whole)
    pieces = written(stretches(chosen.join(bounded(ranges(lone)), "key").select("key", "text", "los", "ns"), length, length // 16), "repeats-pieces")
    discard(whole, heads)
    release(spark)
    alike_pieces, lone_pieces = alike_and_open(pieces)
    discard(pieces)
    single = repeated_starts(start_pairs(chosen.join(bounded(ranges(lone_pieces)), "key").select("key", "text", "los", "ns"), length))
    starts = ranges(alike.union(alike_pieces).union(single.select("key", F.col("at").alias("lo"), F.lit(1).alias("n"))))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[[a, b] for a, b in covered_runs(_numbers(batch.column(1), k), _numbers(batch.column(2), k), length)] for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(pa.list_(pa.int64())))], names=["key", "spans"])

    spans = starts.mapInArrow(merge, "key long, spans array<array<bigint>>")
    spans = chosen.select("key", "digest").join(spans, "key").select("digest", "spans").join(copied, "digest", "left_anti")
    out = written(spans.union(copies.select("digest", F.array(F.array(F.lit(0).cast("long"), "bytes")))), "repeats-spans")
    discard(chosen, alike, alike_pieces, lone, lone_pieces, starts)
    release(spark)
    return out


RUNS = "digest string, n_removed long, n_spans long, kept binary, spans array<array<bigint>>"
_RUNS = pa.schema([("digest", pa.string()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("spans", pa.list_(pa.list_(pa.int64())))])


def repeated_runs(docs: DataFrame, length: int = LENGTH, whole_characters: bool = False) -> DataFrame:
    """Distinct texts that lose bytes: (digest, n_removed, n_spans, kept, spans); digest is the text's SHA-256 in hex.

    docs: (doc_id, text); ``length`` is a multiple of 16. A byte goes if a string of ``length`` bytes over it also starts
    anywhere else in the documents, the same one included; all copies lose it. Matches never cross documents. Equal texts
    are compared once: such a text of at least ``length`` bytes goes whole. ``kept`` holds the remaining bytes. Null and
    empty texts, and those shorter than ``length``, lose nothing; ids may be null or repeated (a row counts as a document
    of its own); texts of any length are taken whole; an empty table gives an empty table; other columns are left out.
    """
    spans = repeated_spans(docs, length)
    texts = docs.where(F.octet_length("text") >= length).select("text", F.unhex(F.sha2("text", 256)).alias("digest"))
    found = texts.join(bounded(spans), "digest").dropDuplicates(["digest"]).select(F.lower(F.hex("digest")).alias("digest"), "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for digest, text, runs in zip(*(c.to_pylist() for c in batch.columns)):
                data = text.encode()
                kept, cut = cut_runs(data, runs, whole_characters)
                out.append((digest, len(data) - len(kept), len(cut), kept, [[a, b] for a, b in cut]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _RUNS)] if out else [pa.array([], f.type) for f in _RUNS], schema=_RUNS)

    return found.mapInArrow(run, RUNS)


_BLANK = np.isin(np.arange(256), np.frombuffer(b" \t\n\r\f\v", np.uint8))


def word_windows(data: bytes, words: int, below: int) -> list[tuple[int, int]]:
    """Byte ranges of all runs of ``words`` words that take fewer than ``below`` bytes."""
    blank = np.concatenate([[True], _BLANK[np.frombuffer(data, np.uint8)], [True]])
    starts, ends = np.flatnonzero(blank[:-1] & ~blank[1:]), np.flatnonzero(~blank[:-1] & blank[1:])
    first, last = starts[: max(0, len(starts) - words + 1)], ends[words - 1 :]
    short = last - first < below
    return list(zip(first[short].tolist(), last[short].tolist()))


def passage_spans(docs: DataFrame, length: int = PASSAGE, words: int = PASSAGE_WORDS) -> tuple[DataFrame, DataFrame]:
    """(digest, spans, short) of the distinct texts that lose bytes to repeated passages, and the first two of ``repeated_spans`` alone.

    short: the runs of ``words`` words that take fewer than ``length`` bytes, so hold no string of that length, and stand
    elsewhere too. These windows (few in prose) are compared by content hash, over all documents.
    """
    spans = repeated_spans(docs, length)
    texts = docs.where(F.octet_length("text") >= 2 * words - 1).select("text", F.unhex(F.sha2("text", 256)).alias("digest"))
    window_schema = pa.schema([("hash", pa.int64()), ("digest", pa.binary()), ("a", pa.int64()), ("b", pa.int64())])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            for text, digest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = text.encode()
                found = word_windows(data, words, length)
                for at in range(0, len(found), FLUSH):
                    part = found[at : at + FLUSH]
                    hashes = np.array([xxh64_intdigest(data[a:b], 11) for a, b in part], np.uint64).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array([digest] * len(part), pa.binary()), *(pa.array(x) for x in zip(*part))], schema=window_schema)

    found = written(texts.mapInArrow(windows, "hash long, digest binary, a long, b long"), "repeats-words")
    again = written(found.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "repeats-again")
    short = written(found.join(bounded(again), "hash").groupBy("digest").agg(F.collect_set(F.array("a", "b")).alias("short")), "repeats-short")
    both = written(spans.join(short, "digest", "full"), "repeats-passages")
    discard(found, again, short)
    return both, spans


def without_passages(data: bytes, spans: list | None, short: list | None) -> bytes:
    """What is left of a text; characters that aren't wholly inside a passage stay."""
    runs = cut_runs(data, spans or [], whole_characters=True)[1] + [tuple(x) for x in short or []]
    if not runs:
        return data
    lo, hi = np.array(runs, np.int64).T
    return cut_runs(data, covered_runs(lo, hi - lo, 1), whole_characters=True)[0]


def cut_passages(docs: DataFrame, left: str, length: int = PASSAGE, words: int = PASSAGE_WORDS) -> DataFrame:
    """docs (all columns, among them text) with ``left``: null for a text that loses nothing, else the text less its repeated
    passages of ``length`` bytes, characters kept whole, and of ``words`` words that take fewer bytes.

    Null, empty and short texts lose nothing; equal texts, ties and repeated rows are copies and go whole if they are as
    long as a passage; long texts are compared whole; an empty table gives an empty table; the texts are read, not shuffled,
    while the list of passages is small enough to be broadcast.
    """
    passages, _ = passage_spans(docs.select("text"), length, words)
    return _cut(docs, passages, left)


def _cut(docs: DataFrame, passages: DataFrame, left: str) -> DataFrame:
    small_batches(docs.sparkSession)
    names = unused(docs, "digest", "spans", "short")
    listed = passages.select(*[F.col(c).alias(n) for c, n in zip(("digest", "spans", "short"), names)])
    rows = docs.withColumn(names[0], F.unhex(F.sha2("text", 256))).join(bounded(listed), names[0], "left")
    docs_names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *columns_, spans, short = batch.columns
            out = [None] * batch.num_rows
            for k in _listed(spans, short):
                out[k] = without_passages(columns_[at][k].as_py().encode(), spans[k].as_py(), short[k].as_py()).decode()
            yield pa.RecordBatch.from_arrays([*columns_, pa.array(out, pa.string())], names=[*docs_names, left])

    ordered = rows.select(*columns(docs), *[F.col(n) for n in names[1:]])
    return numbered(ordered).mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(left, T.StringType())]))


def _listed(*lists: pa.Array) -> list[int]:
    """Rows in which a list isn't null."""
    return np.flatnonzero(np.any([x.is_valid().to_numpy(zero_copy_only=False) for x in lists], 0)).tolist()


def run_texts(docs: DataFrame) -> DataFrame:
    """(digest, a, text) of each row and run: docs (digest, text, runs); the text from byte a on, widened to whole characters.

    Runs are disjoint, so two such texts share fewer bytes than a character has.
    """
    schema = pa.schema([("digest", pa.binary()), ("a", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for digest, text, runs in zip(*(c.to_pylist() for c in batch.columns)):
                data = text.encode()
                for a, b in runs:
                    while data[a] & 0xC0 == 0x80:
                        a -= 1
                    while b < len(data) and data[b] & 0xC0 == 0x80:
                        b += 1
                    out.append((digest, a, data[a:b].decode()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    return docs.mapInArrow(run, "digest binary, a long, text string")


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """The 400-byte rule; and, as ``text``, what is left of a text without its repeated passages of over 50 words.

    A repeated string of LENGTH bytes lies inside one run of repeated passages, so only runs that long are searched for it, as
    texts of their own; equal ones are compared once.
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    rows = docs.withColumn("digest", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    passages, runs = passage_spans(docs)
    long_enough = runs.select("digest", F.filter("spans", lambda s: s[1] - s[0] >= LENGTH).alias("runs")).where(F.size("runs") > 0)
    within = written(run_texts(rows.join(bounded(long_enough), "digest").select("digest", "text", "runs")), "repeats-within")
    cuts = repeated_spans(within.select("text"), LENGTH).withColumnRenamed("digest", "own")
    placed = within.select("digest", "a", F.unhex(F.sha2("text", 256)).alias("own")).distinct().join(bounded(cuts), "own")
    moved = placed.select("digest", F.transform("spans", lambda s: F.transform(s, lambda x: x + F.col("a"))).alias("spans"))
    whole = moved.groupBy("digest").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("cut"))
    found = rows.join(bounded(written(passages.join(whole, "digest", "full"), "repeats-found")), "digest", "left")
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, size, own, text, spans, short, cut = batch.columns
            removed, runs_, kept, left = [0] * len(doc), [0] * len(doc), own.to_pylist(), text.to_pylist()
            for k in _listed(spans, short, cut):
                data = left[k].encode()
                left[k] = without_passages(data, spans[k].as_py(), short[k].as_py()).decode()
                if cut[k].is_valid:
                    rest, out = cut_runs(data, cut[k].as_py())
                    removed[k], runs_[k], kept[k] = len(data) - len(rest), len(out), hashlib.sha256(rest).hexdigest()
            yield pa.RecordBatch.from_arrays([doc, size, pa.array(removed, pa.int64()), pa.array(runs_, pa.int64()), pa.array(kept, pa.string()), pa.array(left, pa.string())], schema=schema)

    shown = found.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.lower(F.hex("digest")).alias("own"), "text", "spans", "short", "cut")
    return shown.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")
