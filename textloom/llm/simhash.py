"""SimHash near-duplicate detection with pigeonring filtering.

A fingerprint stands on a ring of m segments. If two fingerprints differ in at most ``most`` bits, some chain of
consecutive segments starts at which, for every length l, the first l segments differ in at most l * most / m bits.
While l * most < m that budget is below one, so the chain's head must be equal: it is the key on which candidates
meet. Longer prefixes of the chain prune candidates before the full Hamming check.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded, discard, release, small_batches, table, written
from .components import connected_components

BITS, SEED = 64, 42
#: Members of a bucket up to which its pairs are tried; larger buckets link through shared neighbours (hubs) instead.
PAIRED = 32

FINGERPRINT = "doc_id long, fp long, fingerprint string"
_FINGERPRINT = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("fingerprint", pa.string())])


def shingle_digests(data: bytes, words: int) -> list[bytes]:
    """XXH64 digests of all word shingles of a text, repeats included; the text's A-Z are lower-cased first."""
    from xxhash import xxh64_digest

    w = data.lower().split()
    if not w:
        return []
    if len(w) <= words:
        return [xxh64_digest(b" ".join(w), SEED)]
    return [xxh64_digest(b" ".join(s), SEED) for s in zip(*(w[k:] for k in range(words)))]


def ones_of(rows: np.ndarray) -> np.ndarray:
    """Set bits in each column of rows of bytes; 255 rows at a time, whose sums fit a byte."""
    ones = np.zeros(8 * rows.shape[1], np.int64)
    for at in range(0, len(rows), 255):
        ones += np.unpackbits(rows[at : at + 255], axis=1).sum(0, dtype=np.uint8)
    return ones


def fingerprint(text: str | None, words: int) -> bytes:
    """Eight bytes: bit by bit, whether it is set in over half of the digests; zero without words."""
    digests = shingle_digests((text or "").encode(), words)
    if not digests:
        return bytes(8)
    rows = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 8)
    return np.packbits(2 * ones_of(rows) > len(rows)).tobytes()


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, fp, fingerprint) of every row: the bits as a signed long and as 16 hex digits."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [fingerprint(t, words) for t in batch.column(1).to_pylist()]
            longs = np.frombuffer(b"".join(got), ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(longs), pa.array([g.hex() for g in got], pa.string())], schema=_FINGERPRINT)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, FINGERPRINT)


def _signed(x: int) -> int:
    x &= (1 << BITS) - 1
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _segments(m: int) -> list[int]:
    """Masks of m segments around the ring, as equal as can be."""
    cuts = [round(k * BITS / m) for k in range(m + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]


def links(fps: DataFrame, most: int) -> DataFrame:
    """(u, v) edges that connect exactly what pairs of fingerprints (column fp, distinct) at ``most`` or fewer differing bits connect.

    Buckets of up to PAIRED members try their pairs. In a larger bucket, every member names the hubs within half of
    ``most`` bits of it (outside the equal head); two members are near each other exactly if they name a hub in
    common, so a star over each hub's members gives the same components with rows in proportion to the members.
    """
    if most == 0:
        return fps.select(F.col("fp").alias("u"), F.col("fp").alias("v")).where("false")
    m = 3 * most + 1
    segments = _segments(m)
    head = -(-m // most) - 1  # lengths whose budget is below one
    chains = [[sum(segments[(k + j) % m] for j in range(n + 1)) for n in range(m)] for k in range(m)]
    keys = F.array(*[F.struct(F.lit(k).alias("at"), F.col("fp").bitwiseAND(F.lit(_signed(chains[k][head - 1]))).alias("key")) for k in range(m)])
    keyed = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.at", "k.key")
    sizes = written(keyed.groupBy("at", "key").agg(F.count("*").alias("n")).where("n > 1"), "simhash-sizes")
    met = written(keyed.join(sizes, ["at", "key"]), "simhash-met")

    few = met.where(F.col("n") <= PAIRED).select("at", "key", "fp")
    pair = few.withColumnRenamed("fp", "u").join(few.withColumnRenamed("fp", "v"), ["at", "key"]).where("u < v")
    differ = F.col("u").bitwiseXOR(F.col("v"))
    count = lambda mask: F.bit_count(differ.bitwiseAND(F.lit(_signed(mask))))
    chain_holds = F.lit(False)
    for k in range(m):
        holds = F.col("at") == k
        for n in range(head, m):  # prefixes of head + 1 and more segments
            holds = holds & (count(chains[k][n]) <= (n + 1) * most // m)
        chain_holds = chain_holds | holds
    near = pair.where(chain_holds & (F.bit_count(differ) <= most)).select("u", "v")

    inner, outer = most // 2, -(-most // 2)
    flips = {}
    for k in range(m):
        free = [b for b in range(BITS) if not chains[k][head - 1] >> b & 1]
        flips[k] = [(0, 0)] + [(_signed(sum(1 << b for b in c)), d) for d in range(1, outer + 1) for c in combinations(free, d)]
    many = met.where(F.col("n") > PAIRED).select("at", "key", "fp")
    if outer == 1:
        masks = F.lit(None).cast("array<struct<x:bigint,d:int>>")
        for k, pairs in flips.items():
            masks = F.when(F.col("at") == k, F.array(*[F.struct(F.lit(x).alias("x"), F.lit(d).alias("d")) for x, d in pairs])).otherwise(masks)
        many = many.select("at", "key", "fp", F.explode(masks).alias("f"))
    else:  # too many flips for literals; their number depends on ``most`` alone
        listed = fps.sparkSession.createDataFrame([(k, (x, d)) for k, pairs in flips.items() for x, d in pairs], "at int, f struct<x:bigint,d:int>")
        many = many.join(F.broadcast(listed), "at")
    hubs = many.select("at", "fp", F.col("fp").bitwiseXOR(F.col("f.x")).alias("hub"), F.col("f.d").alias("d"))
    centres = hubs.groupBy("at", "hub").agg(F.min(F.when(F.col("d") <= inner, F.col("fp"))).alias("u"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("u IS NOT NULL AND a < b").drop("a", "b")
    stars = hubs.join(centres, ["at", "hub"]).where("u <> fp").select("u", F.col("fp").alias("v")).distinct()
    return near.union(stars)


def simhash_components(docs: DataFrame, words: int = 5, most: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs (doc_id, text).

    The fingerprint takes all shingles of ``words`` words, repeats included; fingerprints link at ``most`` or fewer
    differing bits; component_id is the smallest doc_id reachable, the row's own included. A null, empty or blank
    text has fingerprint zero, which links like any other; null ids are kept and never name a component unless it
    has no other id; repeated rows are kept; an empty table gives an empty table; other columns are left out.
    """
    rows = written(fingerprints(docs, words), "simhash-rows")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    roots = connected_components(links(nodes.select("fp"), most))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fingerprint", "component_id")


#: The wide fingerprint of near_duplicates: segments on its ring, bits of a segment, and the share of bits that may differ; sets of similarity 0.8 differ in 0.15 on average.
SEGMENTS, SEGMENT_BITS, DIFFER = 64, 24, 0.2
_SALTS = np.random.default_rng(3).integers(0, 1 << 64, SEGMENTS * SEGMENT_BITS // 64, dtype=np.uint64)
#: Columns of the parities of a set of shingles.
PARITIES = ["p0", "p1", "p2", "p3"]
#: One text in SAMPLED counts for the shingles that are common; those that SAMPLE_HITS of them hold, COMMON at most, go last in the order of near_duplicates.
SAMPLED, SAMPLE_HITS, COMMON = 16, 8, 200_000


def ring_holds(differ: np.ndarray, most: float) -> np.ndarray:
    """Rows of differing bits by segment that pass the pigeonring: a chain start from which every prefix keeps its budget, and the total."""
    n, m = differ.shape
    sums = np.cumsum(np.concatenate([differ, differ], 1), 1)
    before = np.concatenate([np.zeros((n, 1), sums.dtype), sums[:, : m - 1]], 1)
    alive = np.ones((n, m), bool)
    for length in range(1, m + 1):
        alive &= sums[:, length - 1 : length - 1 + m] - before <= length * most / m
        if not alive.any():
            break
    return alive.any(1)


def shingle_set(text: str, words: int) -> np.ndarray:
    """The distinct shingles of a text as longs, in ascending order."""
    return np.unique(np.frombuffer(b"".join(shingle_digests(text.encode(), words)), np.int64))


def wide_fingerprint(s: np.ndarray) -> np.ndarray:
    """SimHash of a set of shingles in SEGMENTS * SEGMENT_BITS bits, one integer a segment: each bit is set if it is in over half of the members' mixed hashes."""
    ones = np.zeros(SEGMENTS * SEGMENT_BITS, np.int64)
    for at in range(0, len(s), 4080):
        x = s[at : at + 4080, None].view(np.uint64) ^ _SALTS
        for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
            x = (x ^ x >> np.uint64(31)) * np.uint64(factor)
        ones += ones_of((x ^ x >> np.uint64(31)).view(np.uint8))
    bits = np.packbits((2 * ones > len(s)).reshape(SEGMENTS, SEGMENT_BITS), axis=1).astype(np.int32)
    return bits[:, 0] << 16 | bits[:, 1] << 8 | bits[:, 2]


def _on_the_ring(fps: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) of wide fingerprints (key, segments) that pass the pigeonring."""
    sides = pairs.distinct()
    for k in "uv":
        sides = sides.join(fps.select(F.col("key").alias(k), F.col("segments").alias("s" + k)), k)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = (b.column(k).flatten().to_numpy().reshape(-1, SEGMENTS) for k in (2, 3))
            holds = ring_holds(np.bitwise_count(a ^ c).astype(np.int32), DIFFER * SEGMENTS * SEGMENT_BITS)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(holds))

    return written(sides.select("u", "v", "su", "sv").mapInArrow(prune, "u long, v long"), "ring-pairs")


def ring_pairs(fps: DataFrame) -> DataFrame:
    """(u, v) pairs of wide fingerprints (key, segments), keys distinct, that meet on an equal segment and pass the pigeonring.

    All members of a bucket are tried against one of them, so rows follow the members. The result's ``buckets`` are for
    ``ring_rest``, which tries the other pairs.
    """
    slot = F.col("at").cast("long") * (1 << SEGMENT_BITS) + F.col("value")
    keyed = fps.select("key", F.posexplode("segments").alias("at", "value")).select("key", slot.alias("slot"))
    sizes = written(keyed.groupBy("slot").agg(F.count("*").alias("n"), F.min("key").alias("hub")).where("n > 1"), "ring-sizes")
    met = written(keyed.join(bounded(sizes), "slot"), "ring-met")
    near = _on_the_ring(fps, met.where(F.col("key") != F.col("hub")).select(F.col("hub").alias("u"), F.col("key").alias("v")))
    discard(sizes)
    near.buckets = met
    return near


def ring_rest(fps: DataFrame, buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs that ``ring_pairs`` did not try, of buckets of up to PAIRED members, where no links (node, root) connect the two yet."""
    few = buckets.where(F.col("n").between(3, PAIRED)).join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    split = written(few.groupBy("slot").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("slot"), "ring-split")
    open_ = written(few.where(F.col("key") != F.col("hub")).join(bounded(split), "slot").select("slot", "key", "root"), "ring-open")
    apart = (F.col("x.key") < F.col("y.key")) & (F.col("x.root") != F.col("y.root"))
    near = _on_the_ring(fps, open_.alias("x").join(open_.alias("y"), "slot").where(apart).select(F.col("x.key").alias("u"), F.col("y.key").alias("v")))
    discard(split, open_)
    return near


def parities(s: np.ndarray) -> list[int]:
    """256 bits, each whether an odd number of the set's members falls on it: two sets differ in as many members at least as bits."""
    bits = np.bincount((s.view(np.uint64) >> np.uint64(20)).astype(np.int64) & 255, minlength=256) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64).tolist()


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(row's doc_id, key, md5, class_id): class_id is the smallest doc_id of the texts that near-duplicate links connect.

    Two texts link if the Jaccard similarity of their sets of ``words``-word shingles (A-Z lower-cased) is at least
    ``similarity``; equal texts are one. Candidates come from a wide SimHash of the sets, by pigeonring (``ring_pairs``);
    an exact check of the sets follows, first against one text of each bucket, then for pairs that these links leave
    apart (``ring_rest``), so a large group doesn't meet in all its pairs. No budget on a SimHash is complete for a similarity, so a prefix filter provides the
    pairs that these links leave apart: with all sets in one order, two sets of m
    and n shingles that have at least c in common share one before the last c - 1 of each. The order is free, so
    shingles that a sample finds common go last, where few texts look for them; no pair depends on the sample. Pairs whose
    parities differ in more bits than such sets differ in shingles are never made. Texts
    that share a prefix shingle first link to one of them; then every pair of a shingle is tried that these links leave apart, so what is connected is exact and the rows of a large
    group follow its texts. Null and blank texts
    link to nothing but equal ones; null ids never name a class unless it has no other; an empty table gives an empty
    table; other columns are left out.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("key", F.xxhash64("text")).withColumn("md5", F.md5("text"))
    rows = written(plain.select("doc_id", "key", "md5"), "near-rows")
    # a key that two texts share belongs to the one of smaller md5; the other stands alone
    nodes = written(rows.groupBy("key").agg(F.min("md5").alias("owner"), F.max("md5").alias("last")), "near-nodes")
    strangers = rows.join(nodes.where("owner <> last"), "key").where("md5 <> owner").select("key", "md5").distinct()
    owners = plain.join(bounded(strangers), ["key", "md5"], "left_anti")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t, words))], names=["token"])

    sample = owners.where(F.pmod(F.xxhash64("md5"), F.lit(SAMPLED)) == 0).dropDuplicates(["key"]).select("text")
    often = sample.mapInArrow(tokens, "token long").groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= SAMPLE_HITS)
    found = sorted((r["token"], r["n"]) for r in often.orderBy(F.desc("n"), "token").limit(COMMON).collect())
    common, counts = np.array([t for t, _ in found], np.int64), np.array([n for _, n in found], np.int64)

    def ordered(s: np.ndarray) -> np.ndarray:
        if not len(common):
            return s
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        return s[np.lexsort((s, np.where(common[at] == s, counts[at], 0)))]

    prefix_schema = pa.schema([("key", pa.int64()), ("token", pa.int64()), ("rest", pa.int32()), ("n", pa.int32()), *((p, pa.int64()) for p in PARITIES), ("segments", pa.list_(pa.int32()))])

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [ordered(shingle_set(t, words)) for t in b.column(1).to_pylist()]
            if not sets:
                continue
            n = np.array([len(s) for s in sets], np.int64)
            take = np.where(n > 0, n - np.ceil(similarity * n - 1e-6).astype(np.int64) + 1, 0)
            token = np.concatenate([s[:k] for s, k in zip(sets, take)])
            rest = np.concatenate([np.arange(m, m - k, -1) for m, k in zip(n, take)])
            later = rest != np.repeat(n, take)  # parities and fingerprint stand in a text's first row
            bits = [pa.array(np.repeat(p, take), mask=later) for p in np.array([parities(s) for s in sets]).T]
            wide = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * SEGMENTS), pa.array(np.concatenate([wide_fingerprint(s) for s in sets])))
            at = np.repeat(np.arange(len(n)), take)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(token), pa.array(rest.astype(np.int32)), pa.array(np.repeat(n, take).astype(np.int32)), *bits, wide.take(pa.array(at, mask=later))], schema=prefix_schema)

    # rest: the shingles from this one on; first: whether it can be the first that a partner of the same size or larger has in common
    share = similarity / (1 + similarity)
    heads = written(owners.select("key", "text").mapInArrow(prefixes, f"key long, token long, rest int, n int, {' long, '.join(PARITIES)} long, segments array<int>"), "near-heads")
    fps = written(heads.where("p0 IS NOT NULL").groupBy("key").agg(F.first("segments").alias("segments")), "near-fingerprints")
    sketch = written(heads.where("p0 IS NOT NULL").groupBy("key").agg(*[F.first(p).alias(p) for p in PARITIES]), "near-sketch")
    shared = written(heads.groupBy("token").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a < b").select("token"), "near-tokens")
    met = written(heads.withColumn("first", F.col("rest") >= 2 * F.col("n") * F.lit(share) - 1e-6).drop(*PARITIES, "segments").join(bounded(shared), "token").distinct(), "near-met")
    discard(heads, shared)

    def sides(pairs: DataFrame, of: DataFrame) -> DataFrame:
        left, right = (of.select(F.col("key").alias(k), *[F.col(c).alias(c + k) for c in of.columns if c != "key"]) for k in "uv")
        return pairs.join(left, "u").join(right, "v")

    def similar(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (u, v) whose sets are similar enough."""
        pairs = written(pairs, "near-pairs")
        keys = lambda df: bounded(df.select(F.col("u").alias("key")).union(df.select(F.col("v").alias("key"))).distinct())
        # of at least c common shingles the first l stand before the last c - l of each set, so heads of this length share l
        tops = written(met.join(keys(pairs), "key", "left_semi").groupBy("key").agg(F.first("n").alias("n"), F.collect_list("token").alias("t")), "near-tops")
        least = F.ceil(F.lit(share) * (F.col("nu") + F.col("nv")) - 1e-6)
        length = lambda k: least + 1 - F.ceil(F.lit(similarity) * F.col(f"n{k}") - 1e-6)
        hopeful = written(sides(pairs, tops).where(F.size(F.array_intersect("tu", "tv")) >= F.least(length("u"), length("v"))).select("u", "v"), "near-hopeful")
        discard(pairs, tops)
        release(docs.sparkSession)
        chosen = owners.join(keys(hopeful), "key", "left_semi").select("key", "text").dropDuplicates(["key"])
        sets = written(chosen.mapInArrow(shingles, "key long, s array<bigint>"), "near-sets")
        common = F.size(F.array_intersect("su", "sv"))
        links = written(sides(hopeful, sets).where(common >= F.lit(similarity) * (F.size("su") + F.size("sv") - common)).select("u", "v"), "near-links")
        discard(hopeful, sets)
        release(docs.sparkSession)
        return links

    set_schema = pa.schema([("key", pa.int64()), ("s", pa.list_(pa.int64()))])

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t, words) for t in b.column(1).to_pylist()], pa.list_(pa.int64()))], schema=set_schema)

    at_all = lambda x, y: (F.col(f"{x}.rest") >= F.lit(share) * (F.col(f"{x}.n") + F.col(f"{y}.n")) - 1e-6) & (F.col(f"{y}.rest") >= F.lit(share) * (F.col(f"{x}.n") + F.col(f"{y}.n")) - 1e-6)
    differ = lambda x, y: sum((F.bit_count(F.col(f"{x}.{p}").bitwiseXOR(F.col(f"{y}.{p}"))) for p in PARITIES), F.lit(0))
    fits = lambda x, y: at_all(x, y) & (differ(x, y) <= F.lit(1 - 2 * share) * (F.col(f"{x}.n") + F.col(f"{y}.n")) + 1e-6)
    ordered_pair = [F.least("x.key", "y.key").alias("u"), F.greatest("x.key", "y.key").alias("v")]
    star = lambda roots: roots.select(F.col("root").alias("u"), F.col("node").alias("v"))  # noqa: E731  as much is connected by them
    ring = ring_pairs(fps)
    roots = bounded(written(connected_components(similar(ring)), "near-roots"))
    roots = bounded(written(connected_components(star(roots).union(similar(ring_rest(fps, ring.buckets, roots)))), "near-roots"))
    discard(fps, ring.buckets)
    release(docs.sparkSession)
    # what the fingerprints leave apart: each shingle's texts first against the one of them that has most of its shingles in common with others
    central = written(met.groupBy("key").agg(F.count("*").alias("met")), "near-central")
    drawn = F.struct((F.col("met") / F.col("n")).alias("share"), F.xxhash64("key").alias("h"), "key", "rest", "n")
    pivots = met.join(bounded(central), "key").groupBy("token").agg(F.max(drawn).alias("p")).select("token", "p.key", "p.rest", "p.n")
    stars = met.alias("x").join(pivots.alias("y"), "token").where((F.col("x.key") != F.col("y.key")) & at_all("x", "y")).select(*ordered_pair).distinct()
    for k in "uv":
        stars = stars.join(roots.select(F.col("node").alias(k), F.col("root").alias("r" + k)), k, "left")
    linked = star(roots).union(similar(stars.where("coalesce(ru, u) <> coalesce(rv, v)").select("u", "v")))
    roots = written(connected_components(linked), "near-roots")
    release(docs.sparkSession)

    # then all pairs that are not connected yet: those outside a shingle's largest part against all its texts
    placed = written(met.join(bounded(roots.withColumnRenamed("node", "key")), "key", "left").withColumn("root", F.coalesce("root", "key")), "near-placed")
    discard(central)
    parts = placed.groupBy("token", "root").agg(F.count("*").alias("size"))
    split = written(parts.groupBy("token").agg(F.max(F.struct("size", "root")).alias("most"), F.count("*").alias("parts")).where("parts > 1").select("token", F.col("most.root").alias("most")), "near-split")
    release(docs.sparkSession)
    open_ = written(placed.join(bounded(split), "token").join(bounded(sketch), "key"), "near-open")
    discard(placed, split)
    release(docs.sparkSession)
    few, small, large = F.col("root") != F.col("most"), open_.where("first"), open_
    apart = (F.col("x.n") <= F.col("y.n")) & (F.col("x.root") != F.col("y.root")) & fits("x", "y")
    pair = lambda a, b: a.alias("x").join(b.alias("y"), "token").where(apart).select(*ordered_pair)
    linked = star(roots).union(similar(pair(small.where(few), large).union(pair(small.where(~few), large.where(few))).distinct()))

    roots = connected_components(linked)
    named = rows.join(nodes.select("key", "owner"), "key").join(roots.withColumnRenamed("node", "key"), "key", "left")
    label = F.when(F.col("md5") == F.col("owner"), F.coalesce("root", "key").cast("string")).otherwise(F.col("md5"))
    named = written(named.select("doc_id", "key", "md5", label.alias("class")), "near-named")
    least = written(named.groupBy("class").agg(F.min("doc_id").alias("class_id")), "near-classes")
    return named.join(least, "class").select("doc_id", "key", "md5", "class_id")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"), words=3, most=2)
