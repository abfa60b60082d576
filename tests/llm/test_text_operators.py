import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from textloom.llm import components, decontaminate, exact_repeats, packing, sharding, simhash, token_counts


def by_id(rows):
    return {r.doc_id: r for r in rows}


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def brute_fingerprint(t, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(t or ""))
    s = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_simhash_components(docs, texts, empty):
    got = simhash.simhash_components(docs, words=3, most=2).collect()
    assert len(got) == docs.count()
    prints = [brute_fingerprint(t, 3) for t in texts]
    sets = Sets()
    for i, a in enumerate(prints):
        for j in range(i):
            if bin(a ^ prints[j]).count("1") <= 2:
                sets.join(i, j)
    for r in got:
        if r.doc_id is not None:
            assert int(r.fingerprint, 16) == prints[r.doc_id]
            assert r.component_id == sets.find(r.doc_id)
    assert simhash.simhash_components(empty).count() == 0


def test_links_of_small_and_large_buckets(spark):
    rng = np.random.default_rng(1)
    centre = int(rng.integers(1 << 62))
    fps = {centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 63, (300, 2))} | {int(x) for x in rng.integers(1 << 62, size=200)}
    fps |= {x ^ 3 for x in list(fps)[:20]} | {0, 1, 7, 127}
    fps = sorted(fps)
    for most in (1, 2, 3):
        want = Sets()
        for i, a in enumerate(fps):
            for b in fps[:i]:
                if bin(a ^ b).count("1") <= most:
                    want.join(a, b)
        edges = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), most).collect()
        have = Sets()
        for e in edges:
            have.join(e.u, e.v)
        assert all(want.find(x) == have.find(x) for x in fps), most


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(200, 100 + i) for i in range(40)] + [(7, 7), (300, 301), (301, 300)]
    got = dict(components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert all(got[i] == 0 for i in range(61)) and got[200] == 100 and got[301] == 300 and 7 in got
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_ring():
    rng = np.random.default_rng(2)
    d = rng.integers(0, 5, (500, 10))
    assert (simhash.ring_holds(d, 20) == (d.sum(1) <= 20)).all()


def shingles(t, n=5):
    w = low(t or "").split()
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_near_duplicates(docs, texts, empty):
    got = {r.doc_id: r.class_id for r in simhash.near_duplicates(docs).collect() if r.doc_id is not None}
    sets, all_ = Sets(), [shingles(t) for t in texts]
    for i, a in enumerate(all_):
        for j in range(i):
            b = all_[j]
            if (texts[i] or "") == (texts[j] or "") or (a and len(a & b) >= 0.8 * len(a | b)):
                sets.join(i, j)
    assert got == {i: sets.find(i) for i in range(len(texts))}
    assert simhash.near_duplicates(empty).count() == 0


def test_near_duplicates_of_a_large_group(spark):
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 10_000, 300)]
    rows = [(0, " ".join(base))]
    for i in range(1, 120):  # each is near the first, few are near each other
        words = list(base)
        for at in rng.choice(300, 6, replace=False):
            words[at] = f"edit{i}-{at}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(f"o{x}" for x in rng.integers(0, 10_000, 200))) for i in range(50)]
    got = dict(simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "class_id").collect())
    near = [i for i, t in rows if len(shingles(t) & shingles(rows[0][1])) >= 0.8 * len(shingles(t) | shingles(rows[0][1]))]
    assert len(near) > 80 and all(got[i] == 0 for i in near)
    assert all(got[i] == i for i, _ in rows[120:])


def brute_runs(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        m = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                m[i : i + length] = True
        out.append(m)
    return data, out


def test_repeats(spark, texts, empty):
    for length in (400, 64):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        lost = {r.digest: r for r in exact_repeats.repeated_runs(docs, length).collect()}
        for b, m in zip(*brute_runs(texts, length)):
            r = lost.get(hashlib.sha256(b).hexdigest())
            assert (r.n_removed if r else 0) == m.sum()
            if r:
                assert bytes(r.kept) == np.frombuffer(b, np.uint8)[~m].tobytes()
                assert r.n_spans == (np.diff(np.concatenate([[0], m.astype(int)])) == 1).sum() == len(r.spans)
    assert exact_repeats.repeated_runs(empty).count() == 0


def test_repeats_of_many_shapes(spark, monkeypatch):
    """Texts over two letters, shared passages at all distances, edits, periods: many ties of ranks and samples."""
    rng = np.random.default_rng(7)
    word = lambda n: "".join(rng.choice(list("ab "), n))
    base = word(900)
    texts = [base, "q" + base[:500] + "é" + base[498:], word(300) + base[100:260] + word(300) + base[100:250] + word(50), "abc" * 300, "abc" * 200 + word(40), "x" * 500, "x" * 63, "x" * 64, base[:64], base[836:], word(10), None, "", base]
    texts += [word(60) + base[k : k + 64 + k % 5] + word(60) for k in range(0, 800, 37)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for length in (64, 160):
        lost = {r.digest: r for r in exact_repeats.repeated_runs(docs, length).collect()}
        for b, m in zip(*brute_runs(texts, length)):
            r = lost.get(hashlib.sha256(b).hexdigest())
            assert (r.n_removed if r else 0) == m.sum() and (not r or bytes(r.kept) == np.frombuffer(b, np.uint8)[~m].tobytes())


def test_reranked(spark):
    """One rank for each pair that stands twice, though pairs go on over batches and tasks; pairs that stand once leave."""
    rng = np.random.default_rng(3)
    rows = [(int(a), int(b), k, k % 1000, 0) for k, (a, b) in enumerate(rng.integers(0, 40, (3000, 2)))] + [(7, 7, k, k, 1) for k in range(4000)] + [(1 << 60, -5, 0, 0, 2), (-(1 << 62), 3, 1, 1, 2)]
    got = exact_repeats.reranked(spark.createDataFrame(rows, exact_repeats.PAIR).repartition(5)).collect()
    pair = {r[2:]: r[:2] for r in rows}
    assert len(pair) == len(rows)
    times = Counter(pair.values())
    assert sorted((r.key, r.at, r.part) for r in got) == sorted(k for k, v in pair.items() if times[v] > 1)
    ranks = {(pair[(r.key, r.at, r.part)], r["rank"]) for r in got}
    assert len(ranks) == len({a for a, _ in ranks}) == len({b for _, b in ranks})
    assert exact_repeats.reranked(spark.createDataFrame([], exact_repeats.PAIR)).count() == 0


def test_op6_query(spark, tmp_path):
    rng = np.random.default_rng(4)
    new = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**4, n))
    short, long = new(60), new(90)
    texts = [f"{new(30)} {short} {new(30)}", f"{short} {new(20)}", f"{new(9)} {long} {new(9)}", f"{long} {new(40)}", long, new(100), None, "", "é" * 30]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = by_id(exact_repeats.op6_suffix_dedup(spark, str(tmp_path)).collect())
    assert len(got) == len(texts) and len(short) < 400 < len(long)
    for d, (b, m) in enumerate(zip(*brute_runs(texts, 400))):
        kept = np.frombuffer(b, np.uint8)[~m].tobytes()
        assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans) == (len(b), m.sum(), (np.diff(np.concatenate([[0], m.astype(int)])) == 1).sum())
        assert got[d].kept_sha256 == hashlib.sha256(kept).hexdigest()
    assert all(short not in got[d].text for d in (0, 1)) and all(long not in got[d].text for d in (2, 3, 4))
    assert [got[d].text for d in (5, 6, 7, 8)] == texts[5:]


def test_op6_searches_runs_of_passages_alone(spark, tmp_path, monkeypatch):
    """Runs that begin and end inside characters, two in a text, one of 400 bytes inside a longer one; only their bytes are searched."""
    rng = np.random.default_rng(14)
    new = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**4, n))
    one, two = new(90), new(120)
    texts = [f"{new(300)}é{one}é{new(300)}é{two}ü{new(9)}", f"{new(300)}©{one}ê{new(9)}", f"{new(200)}ĩ{two}{new(9)}", f"{new(9)}{two[50:460]}é{new(9)}", f"{new(9)}{one}{two}{new(9)}", two, two]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    searched = []

    def watched(docs, length=400, real=exact_repeats.repeated_spans):
        if length == 400:
            searched.extend(r.text for r in docs.collect())
        return real(docs, length)

    monkeypatch.setattr(exact_repeats, "repeated_spans", watched)
    got = by_id(exact_repeats.op6_suffix_dedup(spark, str(tmp_path)).collect())
    for d, (b, m) in enumerate(zip(*brute_runs(texts, 400))):
        assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans) == (len(b), m.sum(), (np.diff(np.concatenate([[0], m.astype(int)])) == 1).sum())
        assert got[d].kept_sha256 == hashlib.sha256(np.frombuffer(b, np.uint8)[~m].tobytes()).hexdigest()
    assert max(len(t) for t in searched) < len(one) + len(two) + 9


def test_cut_keeps_characters_whole():
    data = "aé日b".encode()
    kept, cut = exact_repeats.cut_runs(data, [(2, 5)], whole_characters=True)
    assert kept.decode() == "aé日b" and cut == []
    kept, cut = exact_repeats.cut_runs(data, [(1, 6)], whole_characters=True)
    assert kept.decode() == "ab"


def test_decontamination(spark, docs, texts, empty):
    items = [(1, " ".join(texts[30 - 25].split()[:14]) if texts[5] else "one"), (2, "One"), (3, ""), (4, None), (None, "one two"), (10, texts[-4][20:300]), (11, texts[-4][20:300]), (12, "x" * 1500)]
    items = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.phrase_matches(docs, items)
    assert got.columns == [*docs.columns, "n_words", "hits", "item_ids"] and got.count() == docs.count()
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for r in items.collect():
        w = pattern.findall(low(r.text or ""))
        n = min(10, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[s : s + n])] |= {str(r.item_id)} if r.item_id is not None else set()
    for d, r in by_id(got.collect()).items():
        if d is None:
            continue
        w, hit, ids = pattern.findall(low(texts[d] or "")), set(), set()
        for k, v in windows.items():
            for s in range(len(w) - len(k) + 1):
                if tuple(w[s : s + len(k)]) == k:
                    hit |= set(range(s, s + len(k)))
                    ids |= v
        assert r.n_words == len(w) and {p for h in r.hits for p in range(h.a, h.b)} == hit and r.item_ids == sorted(ids)
    assert decontaminate.phrase_matches(empty, items).count() == 0
    none = decontaminate.phrase_matches(docs, spark.createDataFrame([], items.schema))
    assert none.where("size(hits) > 0").count() == 0 and none.count() == docs.count()


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "far alpha " + "x " * 5 + "beta y y gamma"), (2, "alpha " + "x " * 80 + "beta gamma"), (3, "gamma beta alpha"), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(9, "alpha beta gamma")], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.proximity_matches(docs, items, span=20).collect()) == [1, 3]


def test_sharding(docs, texts, empty):
    for shards in (24, 3):
        got = sharding.shard_contiguous(docs, shards).collect()
        assert len(got) == docs.count()
        slots, size, at = defaultdict(list), Counter(), {}
        for r in got:
            slots[r.shard].append(r.slot)
            size[r.shard] += r.size
            if r.doc_id is not None:
                t = texts[r.doc_id]
                assert r.size == len((t or "").encode()) + 8 and r.text_crc32 == zlib.crc32((t or "").encode())
                assert at.setdefault(t, r.shard) == r.shard
        assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and max(slots) < shards
        groups = {}
        for r in sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id)):
            groups[r.text] = groups.get(r.text, 0) + len((r.text or "").encode()) + 8
        fits = lambda c: max(groups.values()) <= c and _cuts(groups.values(), c) <= shards
        best = next(c for c in range(max(groups.values()), sum(groups.values()) + 1) if fits(c))
        assert max(size.values()) <= best == got[0].capacity
    assert sharding.shard_contiguous(empty).count() == 0


def _cuts(sizes, c):
    n, a = 1, 0
    for z in sizes:
        if a + z > c:
            n, a = n + 1, 0
        a += z
    return n


def test_sharding_outline_is_refined(monkeypatch, spark):
    monkeypatch.setattr(sharding, "OUTLINE", 16)
    rng = np.random.default_rng(5)
    rows = [(i, "y" * int(rng.integers(1, 400)) + str(i)) for i in range(400)]
    got = sharding.shard_contiguous(spark.createDataFrame(rows, "doc_id long, text string"), 7)
    sizes = [len(t) + 8 for _, t in rows]
    best = next(c for c in range(max(sizes), sum(sizes)) if _cuts(sizes, c) <= 7)
    sums = [r.s for r in got.groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert max(sums) <= best == got.first().capacity and len(sums) == 7
    assert min(sums) > 0.9 * sum(sums) / 7  # no shard is left short


def test_packing(docs, texts, empty):
    from tokenizers import Tokenizer

    real = Tokenizer.from_file(packing.tokenizer_path())
    got = packing.pack(docs, window=256).where("doc_id IS NOT NULL").collect()
    pieces, sequences = defaultdict(set), defaultdict(set)
    for r in got:
        pieces[r.doc_id].add((r.start, r.length, r.ids_crc32, r.doc_tokens))
        sequences[r.sequence_id].add((r.offset, r.length))
    for d, t in enumerate(texts):
        ids, at = real.encode(t or "", add_special_tokens=False).ids + [1], 0
        if d == 3:
            continue  # its row is there twice
        for start, n, crc, total in sorted(pieces[d]):
            assert start == at and total == len(ids) and crc == zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())
            at += n
        assert at == len(ids)
    every = packing.pack(docs, window=256)
    fill = every.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("e")).collect()
    assert all(r.n == r.e <= 256 for r in fill)
    assert sum(r.n < 256 for r in fill) <= 1  # the left-over ids are few, so one task packs them
    assert packing.pack(empty).count() == 0


def test_word_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    ids, real = packing.WordIds(packing.tokenizer_path()), Tokenizer.from_file(packing.tokenizer_path())
    for t in ["It's we'll DON'T 'S", "ÀÉ çá ΣΑΣ İx", "a\x1cb c\x85d e f g", "<|endoftext|> x <|STARTOFTEXT|>", "１２3 ½ ４ x²", "日本語 テスト!!", "", "  ", "a_b-c.d", "​zero‍", "é ́x"]:
        assert ids(t) == np.array(real.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_sum_of_squares_prefers_even_counts():
    p = packing.SumOfSquares(10)
    for n in (4, 4, 6):
        p.add((0, 0, b"abcd" * n, n))
    # the second 4 moves the first window to 8 (change 0, a new window 3); the 6 fits nowhere else than in a new one
    assert p.counts[8] == p.counts[6] == 1 and p.counts.sum() == p.open == 2
    assert p.add((0, 0, b"abcd" * 2, 2)) and p.counts[8] == 0  # filling the 8 is best
    assert [sum(len(x[2]) // 4 for x in w) for w in packing.filled(p.drain(), 10)] == [6] and p.open == 0


def test_sum_of_squares_against_a_slow_packer():
    """Each piece goes where the sum of squared counts, added up anew for every choice, is smallest, the fullest window first."""
    rng = np.random.default_rng(2)
    for window in (7, 20):
        p, levels, closed = packing.SumOfSquares(window), [], 0
        for k in range(400):
            n = int(rng.integers(1, window))
            total = lambda x: sum(v * v for v in Counter(x).values())
            choices = []
            for level in {0, *levels}:
                if level + n <= window:
                    after = list(levels)
                    if level:
                        after.remove(level)
                    after += [level + n] if level + n < window else []
                    choices.append((total(after), -level, after))
            _, level, after = min(choices)
            full = p.add((k, 0, b"abcd" * n, n))
            assert bool(full) == (n - level == window)
            levels, closed = after, closed + bool(full)
            assert p.counts.tolist() == [levels.count(x) for x in range(window + 1)] and p.open == len(levels)
        pieces = p.drain()
        out = packing.filled(pieces, window)
        assert all(sum(len(x[2]) // 4 for x in w) == window for w in out[:-1]) and sum(len(x[2]) for w in out for x in w) == sum(len(x[2]) for x in pieces)


def test_packing_goes_on_when_too_many_windows_are_open(spark, docs, monkeypatch):
    p = packing.SumOfSquares(10, most_open=3)
    for k in range(4):
        p.add((k, 0, b"abcd" * 6, 6))
    assert p.crowded and len(p.drain()) == 4 and p.open == 0 and not p.crowded
    monkeypatch.setattr(packing, "SECOND_IDS", 500)
    got = packing.pack(docs, window=64).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("e")).collect()
    assert all(r.n == r.e <= 64 for r in got)


def test_components_that_need_too_many_rounds(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    with pytest.raises(RuntimeError):
        components.connected_components(edges, most_rounds=1)


def test_token_rollup(spark, empty):
    rows = lambda *r: spark.createDataFrame(list(r), "op string, source string, lang string, tokenizer string, tokens long, old_tokens long")
    from textloom.llm.common import scratch

    roll = token_counts.Rollup(spark, scratch(spark, "test"))
    assert roll.totals().count() == 0
    assert roll.commit("a", rows(("insert", "s", "en", "v", 5, None), ("insert", "s", "en", "v", 7, None), ("insert", None, None, "v", None, None)))
    assert not roll.commit("a", rows(("insert", "s", "en", "v", 100, None)))
    assert roll.commit("b", rows(("delete", "s", "en", "v", 5, None), ("revise", "s", "en", "v", 9, 7)))
    assert roll.commit("c", rows().limit(0) if False else spark.createDataFrame([], rows(("insert", "s", "e", "v", 1, 1)).schema))
    assert {tuple(r) for r in roll.totals().collect()} == {("s", "en", "v", 1, 9), (None, None, "v", 1, 0)}
    assert roll.compact() and {tuple(r) for r in roll.totals().collect()} == {("s", "en", "v", 1, 9), (None, None, "v", 1, 0)}
    assert not roll.commit("a", rows(("insert", "s", "en", "v", 100, None))) and not roll.commit("b", rows(("delete", "s", "en", "v", 5, None)))
    assert roll.commit("d", rows(("delete", "s", "en", "v", 9, None)))
    assert {tuple(r) for r in roll.totals().collect()} == {(None, None, "v", 1, 0)}
    assert roll.compact() and roll.compact() and not roll.commit("d", rows()) and {tuple(r) for r in roll.totals().collect()} == {(None, None, "v", 1, 0)}
    try:
        roll.commit("e", rows(("drop", "s", "en", "v", 9, None)))
        raise AssertionError
    except Exception as e:
        assert "unknown change" in str(e)


def test_op5_query_against_a_plain_count(spark, docs, texts, tmp_path):
    import base64

    import public_tokenizers as P
    import tiktoken
    from tokenizers import Tokenizer

    docs.where("doc_id IS NOT NULL").withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "de").otherwise(F.col("lang"))).distinct().write.parquet(f"{tmp_path}/documents.parquet")
    words = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pieces = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want, seen = defaultdict(lambda: [0, 0]), set()
    for i, t in enumerate(x or "" for x in texts):
        if t in seen:
            continue
        seen.add(t)
        lang = "de" if i % 3 == 0 else "en"
        for name, n in (("word_bpe_49k", len(words.encode(t, add_special_tokens=False).ids)), ("byte_bpe_50k", len(pieces.encode_ordinary(" ".join(t.split()) if lang == "de" else t)))):
            want[(f"s{i % 3}", lang, name)][0] += 1
            want[(f"s{i % 3}", lang, name)][1] += n
    got = {(r.source, r.lang, r.tokenizer): [r.n_docs, r.n_tokens] for r in token_counts.op5_token_counts(spark, str(tmp_path)).collect()}
    assert got == dict(want)


def test_near_duplicates_that_differ_by_a_block(spark):
    rng = np.random.default_rng(8)
    new = lambda n: [f"w{x}" for x in rng.integers(0, 100_000, n)]
    texts = []
    for n in range(80, 480, 4):
        base = new(n)
        cut = int((n - 4) * rng.uniform(0.81, 0.85))
        swap = int((n - 4) * rng.uniform(0.895, 0.92))
        texts += [base, base + new(int((n - 4) * rng.uniform(0.18, 0.245))), (other := new(n)), other[: cut + 4], (third := new(n)), third[:swap] + new(n - swap)]
    texts = [" ".join(t) for t in texts]
    near = [i for i in range(0, len(texts), 2) if len(shingles(texts[i]) & shingles(texts[i + 1])) >= 0.8 * len(shingles(texts[i]) | shingles(texts[i + 1]))]
    assert len(near) > 250
    got = dict(simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", "class_id").collect())
    assert got == {i: i - 1 if i % 2 and i - 1 in near else i for i in range(len(texts))}


def test_near_duplicates_among_texts_of_a_template(spark):
    rng = np.random.default_rng(9)
    new = lambda n: [f"w{x}" for x in rng.integers(0, 1_000_000, n)]
    template, texts = new(255), []
    for _ in range(1500):
        texts.append(template + new(45))
    for i in range(60):  # two thirds of the tail of another text
        texts.append(texts[i][:-15] + new(15))
    texts = [" ".join(t) for t in texts]
    sets = [shingles(t) for t in texts]
    alike = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    assert all(alike(i, 1500 + i) >= 0.8 > alike(i, i + 1) for i in range(60))
    got = dict(simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", "class_id").collect())
    assert got == {i: i - 1500 if i >= 1500 else i for i in range(1560)}


def test_near_duplicates_meet_on_the_ring(spark, monkeypatch):
    rng = np.random.default_rng(12)
    new = lambda n: [f"w{x}" for x in rng.integers(0, 100_000, n)]
    texts = []
    for k in range(60):
        base = new(200)
        edited = list(base)
        for at in rng.choice(200, 1 + k % 3, replace=False):
            edited[at] = f"edit{k}"
        texts += [" ".join(base), " ".join(edited)]
    sets = [simhash.shingle_set(t, 5) for t in texts]
    fps = [simhash.wide_fingerprint(s) for s in sets]
    bits = lambda a, b: sum(int(x).bit_count() for x in a ^ b)
    most = simhash.DIFFER * simhash.SEGMENTS * simhash.SEGMENT_BITS
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if (fps[i] == fps[j]).any() and bits(fps[i], fps[j]) <= most}
    made = []

    def watched(table, real=simhash.ring_pairs):
        keys = {r.key: next(i for i, f in enumerate(fps) if f.tolist() == r.segments) for r in table.collect()}
        got = real(table)
        made.append({tuple(sorted((keys[r.u], keys[r.v]))) for r in got.collect()})
        return got

    monkeypatch.setattr(simhash, "ring_pairs", watched)
    got = dict(simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", "class_id").collect())
    assert made == [want] and len(want & {(2 * k, 2 * k + 1) for k in range(60)}) >= 57
    assert got == {i: i - i % 2 for i in range(120)}


def test_a_group_of_near_copies_does_not_meet_in_all_its_pairs(spark, monkeypatch):
    rng = np.random.default_rng(13)
    new = lambda n: [f"w{x}" for x in rng.integers(0, 100_000, n)]
    base, texts = new(12_000), []
    for k in range(31):  # as many as a bucket tries in pairs, all near each other
        edited = list(base)
        edited[int(rng.integers(12_000))] = f"edit{k}"
        texts.append(" ".join(edited))
    texts += [" ".join(new(100)) for _ in range(9)]
    compared = []

    def watched(df, label, real=simhash.written):
        out = real(df, label)
        if label in ("ring-pairs", "near-pairs"):
            compared.append(out.count())
        return out

    monkeypatch.setattr(simhash, "written", watched)
    got = dict(simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", "class_id").collect())
    assert got == {i: 0 if i < 31 else i for i in range(40)}
    assert max(compared) < 31 * 30 // 4


def test_words_that_the_packer_remembers():
    words = packing.Remembered(3)
    for k in range(50):
        words.put(f"rare{k}", b"")
        assert (words.get("common") or words.put("common", b"x")) in (None, b"x")
        assert len(words.new) <= 3 and len(words.old) <= 3
    assert words.get("common") == b"x" and words.get("rare0") is None and words.get("rare49") == b""
    path = packing.tokenizer_path()
    assert packing.word_ids(path) is packing.word_ids(path)
