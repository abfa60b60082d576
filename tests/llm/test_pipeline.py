import re
import zlib
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from textloom.llm import packing
from textloom.llm.langid import fit, predict

SF = "/root/testdata/sf0.001"
CLASHING = ["score", "lang_pred", "held_out", "n_words", "hits", "item_ids", "key", "md5", "digest", "id", "left", "words", "class_id", "a.b", "SCORE_"]


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def test_stages_take_effect(spark, docs, texts):
    kept = docs
    counts = []
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, kept, SF)
        assert out.columns == docs.columns, name
        kept = out.cache()
        counts.append(kept.count())
    rows = kept.collect()
    assert counts == sorted(counts, reverse=True) and counts[0] < docs.count()
    left = [r.text for r in rows]
    assert all(re.search(r"[^\W\d_]", t) for t in left) and len(set(left)) == len(left)
    passage = texts[-4]
    windows = {passage[i : i + 300] for i in range(0, len(passage) - 300)}
    assert sum(any(w in t for w in windows) for t in left) <= 1
    pieces = pipeline.STAGES[-1][1](spark, kept, SF)
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in rows}


def test_clashing_columns_keep_their_values(spark, docs):
    wide = docs.drop("key", "digest")
    for k, name in enumerate(CLASHING):
        wide = wide.withColumn(name, F.lit(float(k)))
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, wide, SF)
        assert out.columns == wide.columns, name
        rows = out.collect()
        assert rows and all(r[wide.columns.index(c)] == k for r in rows for k, c in enumerate(CLASHING)), name
    assert pipeline.packed(spark, wide, SF).count() >= wide.count()


def test_empty_tables(spark, empty):
    for name, stage in pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name


# each stage of the pipeline by brute force, over documents with nulls, blanks, copies, repeated rows, ties and long texts


def slow_language(rows, judged):
    return [r for r in rows if judged[r.text] is not None and judged[r.text] >= pipeline.LEAST_SCORE]


def slow_near_copies(rows):
    def shingles(t):
        w = low(t or "").split()
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, up = [shingles(r.text) for r in rows], list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if (rows[i].text or "") == (rows[j].text or "") or (a and len(a & b) >= 0.8 * len(a | b)):
                up[find(i)] = find(j)
    best = {}
    for i, r in enumerate(rows):
        best.setdefault(find(i), []).append(r)
    return [min(g, key=lambda r: (r.doc_id is None, r.doc_id)) for g in best.values()]


def slow_repeats(rows, length=240, words=51):
    data = [(r.text or "").encode() for r in rows]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    spans = [[(a.start(), b.end()) for a, b in zip(w, w[words - 1 :])] for w in ([*re.finditer(rb"\S+", b)] for b in data)]
    passages = Counter(b[s:e] for b, x in zip(data, spans) for s, e in x if e - s < length)
    out = []
    for r, b, x in zip(rows, data, spans):
        long, gone = np.zeros(len(b), bool), np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            long[i : i + length] |= seen[b[i : i + length]] > 1
        for mask, runs in ((long, None), (gone, [(s, e) for s, e in x if e - s < length and passages[b[s:e]] > 1])):
            for s, e in runs if runs is not None else [(m.start(), m.end()) for m in re.finditer(b"\x01+", mask.astype(np.uint8).tobytes())]:
                while s < e and b[s] & 0xC0 == 0x80:
                    s += 1
                while e > s and e < len(b) and b[e] & 0xC0 == 0x80:
                    e -= 1
                gone[s:e] = True
        if not gone.any():
            out.append((r.doc_id, r.text))
        elif left := np.frombuffer(b, np.uint8)[~gone].tobytes().decode().strip(" "):
            out.append((r.doc_id, left))
    return out


def slow_decontaminated(rows, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t or ""))
    windows = {tuple(w[s : s + 10]) for w in map(words, items) for s in range(max(1, len(w) - 9)) if w}
    sizes = {len(w) for w in windows}
    return [r for r in rows if not any(tuple(w[s : s + n]) in windows for w in [words(r.text)] for n in sizes for s in range(len(w) - n + 1))]


def test_stages_against_brute_force(spark, docs, texts):
    (items,) = zip(*duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall())
    planted = [(900 + k, "some words before " + " ".join(t.split()[k : k + 11]) + " and some after them", "en", "s", 5, 1, "r", 2, 3) for k, t in enumerate(items[:5])]
    start = docs.union(spark.createDataFrame(planted, docs.schema))
    rows = start.collect()
    same = lambda got, want: sorted(got, key=str) == sorted(want, key=str)
    net = fit(start)
    judged = {r.text: None if r.lang_pred == "und" else r.score for r in predict(start, net).collect()}
    assert same(pipeline.language(spark, start, SF).collect(), slow_language(rows, judged))
    assert same([(r.doc_id, r.text) for r in pipeline.near_copies(spark, start, SF).collect()], [(r.doc_id, r.text) for r in slow_near_copies(rows)])
    assert same([(r.doc_id, r.text) for r in pipeline.repeats(spark, start, SF).collect()], slow_repeats(rows))
    clean = pipeline.decontaminated(spark, start, SF).collect()
    assert same(clean, slow_decontaminated(rows, items)) and not {r.doc_id for r in clean} & set(range(900, 905))


def test_run_packs_what_the_stages_keep(spark):
    """The whole run over sf0.001: its pieces are the ids of the texts that the brute-force stages keep after language ID."""
    from tokenizers import Tokenizer

    assert [n for n, _ in pipeline.STAGES] == ["language ID", "SimHash near-dedup", "suffix-array dedup", "benchmark decontamination", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = slow_near_copies(pipeline.language(spark, docs, SF).collect())
    (items,) = zip(*duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall())
    row = type("Row", (), {"__init__": lambda self, d, t: self.__dict__.update(doc_id=d, text=t)})
    kept = {r.doc_id: r.text for r in slow_decontaminated([row(d, t) for d, t in slow_repeats(kept)], items)}
    real, pieces = Tokenizer.from_file(packing.tokenizer_path()), {}
    for r in pipeline.run(spark, SF).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    assert pieces.keys() == kept.keys() and len(kept) > 50
    for d, text in kept.items():
        ids, at = real.encode(text, add_special_tokens=False).ids + [1], 0
        for start, n, crc in sorted(pieces[d]):
            assert start == at and crc == zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())
            at += n
        assert at == len(ids)


def test_repeats_of_short_words(spark):
    words = lambda a, n: " ".join(f"{k % 90 + 10}" for k in range(a, a + 7 * n, 7))
    passage, below = words(3, 51), " ".join("zyxw"[k % 4] + str(k % 9) for k in range(50))
    long = lambda c: " ".join(f"{c}{k}word" for k in range(60))
    texts = [f"{long('a')} {passage} {long('b')}", f"{long('c')} {passage}", f"{passage} é {long('d')}", f"{long('e')} {below} {long('f')}", f"{long('g')} {below} {long('h')}", passage]
    assert len(passage) < 240 and len(below) < 240
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in pipeline.repeats(spark, docs, SF).collect()}
    assert got == {0: f"{long('a')}  {long('b')}", 1: long("c"), 2: f"é {long('d')}", 3: texts[3], 4: texts[4]}
