"""Language identification by a small byte convolutional network, trained in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import numbered, small_batches, table

#: Bytes of a window; a text is cut into such windows, all of them scored.
WINDOW = 256
WIDTHS, FILTERS, DIM = (2, 3, 4), 8, 8
#: The training sample: at most so many documents of each language, fewer where there are over LANGUAGES of them, and so many windows of each document.
SAMPLE_DOCS, SAMPLE_WINDOWS, LANGUAGES = 240, 6, 64
PREDICTED = "held_out boolean, lang_pred string, score double"
_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class ByteConvNet:
    """Byte embeddings, filters of several widths, rectified maxima over a window, a linear layer and softmax."""

    labels: list[str]
    embed: np.ndarray  # 256 x DIM
    filters: list[np.ndarray]  # width x DIM x FILTERS
    bias: np.ndarray  # widths * FILTERS
    out: np.ndarray  # widths * FILTERS x labels
    out_bias: np.ndarray

    @classmethod
    def train(cls, windows: np.ndarray, targets: np.ndarray, labels: list[str], epochs: int = 6, batch: int = 64, rate: float = 0.004, seed: int = 1) -> ByteConvNet:
        """Adam on cross entropy. windows: n x WINDOW bytes; targets: indexes into labels."""
        rng = np.random.default_rng(seed)
        n_out = len(WIDTHS) * FILTERS
        net = cls(labels, rng.normal(0, 0.5, (256, DIM)), [rng.normal(0, 1 / np.sqrt(w * DIM), (w, DIM, FILTERS)) for w in WIDTHS], np.zeros(n_out), rng.normal(0, 0.3, (n_out, len(labels))), np.zeros(len(labels)))
        params = [net.embed, *net.filters, net.bias, net.out, net.out_bias]
        m1, m2, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                grads = net._gradients(windows[pick], targets[pick])
                step += 1
                for p, g, a, b in zip(params, grads, m1, m2):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        return net

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        e, n = self.embed[x], len(x)
        pooled, where = [], []
        for k, f in enumerate(self.filters):
            w = len(f)
            z = sum(e[:, j : x.shape[1] - w + 1 + j] @ f[j] for j in range(w))
            at = z.argmax(1)
            where.append(at)
            pooled.append(np.take_along_axis(z, at[:, None], 1)[:, 0] + self.bias[k * FILTERS : (k + 1) * FILTERS])
        raw = np.concatenate(pooled, 1)
        hidden = np.maximum(raw, 0)
        logits = hidden @ self.out + self.out_bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(n), y] -= 1
        p /= n
        d_raw = (p @ self.out.T) * (raw > 0)
        d_embed, d_filters = np.zeros_like(self.embed), []
        rows = np.arange(n)[:, None]
        for k, f in enumerate(self.filters):
            d, df = d_raw[:, k * FILTERS : (k + 1) * FILTERS], np.zeros_like(f)
            for j in range(len(f)):
                codes = x[rows, where[k] + j]  # n x FILTERS
                df[j] = np.einsum("nfd,nf->df", self.embed[codes], d)
                np.add.at(d_embed, codes, d[:, :, None] * f[j].T)
            d_filters.append(df)
        return [d_embed, *d_filters, d_raw.sum(0), hidden.T @ p, p.sum(0)]

    def compiled(self) -> CompiledNet:
        return CompiledNet(self)


class CompiledNet:
    """The same network with embedding and filters multiplied out: what two neighbouring bytes add is one table row."""

    def __init__(self, net: ByteConvNet):
        def pairs(a, b):  # 65536 x FILTERS; the first byte of a pair is the low one
            return np.ascontiguousarray((b[:, None, :] + a[None, :, :]).reshape(65536, -1), np.float32)

        f = [[net.embed @ g[j] for j in range(len(g))] for g in net.filters]
        self.two = pairs(f[0][0], f[0][1])
        self.three, self.third = pairs(f[1][0], f[1][1]), f[1][2].astype(np.float32)
        self.four, self.rest = pairs(f[2][0], f[2][1]), pairs(f[2][2], f[2][3])
        self.net = net

    def scores(self, windows: np.ndarray) -> np.ndarray:
        """Softmax rows for n x WINDOW bytes."""
        out = np.empty((len(windows), len(self.net.labels)))
        for at in range(0, len(windows), 64):
            x = windows[at : at + 64].astype(np.int32)
            code = x[:, :-1] | x[:, 1:] << 8
            two = self.two.take(code, 0).max(1)
            three = (self.three.take(code[:, :-1], 0) + self.third.take(x[:, 2:], 0)).max(1)
            four = (self.four.take(code[:, :-2], 0) + self.rest.take(code[:, 2:], 0)).max(1)
            hidden = np.maximum(np.concatenate([two, three, four], 1) + self.net.bias, 0)
            logits = hidden @ self.net.out + self.net.out_bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            out[at : at + 64] = p / p.sum(1, keepdims=True)
        return out


def windows_of(data: bytes) -> np.ndarray:
    """The whole text as windows; the last one is padded with blanks, an empty text has one blank window."""
    n = max(1, -(-len(data) // WINDOW))
    return np.frombuffer(data.ljust(n * WINDOW), np.uint8).reshape(n, WINDOW)


def held_out(id_col) -> object:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, docs_a_language: int = SAMPLE_DOCS, seed: int = 1) -> ByteConvNet:
    """Train on a bounded sample of the labelled rows that aren't held out.

    The sample: of every language the ``docs_a_language`` documents of smallest hashed id, and SAMPLE_WINDOWS windows
    spread evenly over each; languages of fewer documents are repeated up to the largest. Over LANGUAGES languages
    share the rows of LANGUAGES among them, one document each at least.
    """
    ids = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    ids = ids.select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    languages = ids.agg(F.count_distinct("lang").alias("n")).first()["n"]
    each = docs_a_language if languages <= LANGUAGES else max(1, LANGUAGES * docs_a_language // languages)
    chosen = ids.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("r") <= each).select("doc_id", "lang")
    keys = [(r["doc_id"], r["lang"]) for r in chosen.collect()]  # LANGUAGES * docs_a_language, or one for each language
    picked = docs.sparkSession.createDataFrame(keys, "doc_id long, lang string").distinct()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                w = windows_of(text.encode())
                for k in sorted({*np.linspace(0, len(w) - 1, min(len(w), SAMPLE_WINDOWS)).astype(int).tolist()}):
                    rows.append((lang, w[k].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["lang", "w"])

    got = sorted((r["lang"], bytes(r["w"])) for r in docs.select("doc_id", "lang", "text").join(F.broadcast(picked), ["doc_id", "lang"]).select("lang", "text").mapInArrow(cut, "lang string, w binary").collect())
    labels = sorted({lang for lang, _ in got})
    if not labels:
        return ByteConvNet.train(np.zeros((0, WINDOW), np.uint8), np.zeros(0, int), ["und"], seed=seed)
    x = np.frombuffer(b"".join(w for _, w in got), np.uint8).reshape(-1, WINDOW)
    y = np.array([labels.index(lang) for lang, _ in got])
    most = np.bincount(y).max()
    even = np.concatenate([np.resize(np.flatnonzero(y == k), most) for k in range(len(labels))])
    return ByteConvNet.train(x[even], y[even], labels, seed=seed)


def predict(docs: DataFrame, net: ByteConvNet, names: tuple[str, str, str] = ("held_out", "lang_pred", "score")) -> DataFrame:
    """Every row of docs (all its columns) with held_out, lang_pred and score.

    The score of a language is its mean probability over all windows of the text, weighted by their bytes.
    ``und`` with score 0 for a null text or one without a letter. Only the text is read for the prediction; null
    ids are not held out; repeated rows get equal results; texts of any length are read whole; of equally probable
    languages the first by name counts; an empty table gives an empty table. The three new columns may be given other
    ``names``; columns of docs with these names are replaced, all others kept.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(*names)
    schema = docs.schema
    docs_names, texts = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fast, labels = net.compiled(), net.labels
        for batch in batches:
            pred, score = [], []
            for text in batch.column(texts).to_pylist():
                if not text or not _LETTER.search(text):
                    pred.append("und")
                    score.append(0.0)
                    continue
                data = text.encode()
                p = fast.scores(windows_of(data))
                weight = np.full(len(p), WINDOW, float)
                weight[-1] = len(data) - WINDOW * (len(p) - 1)
                mean = weight @ p / weight.sum()
                k = int(mean.argmax())
                pred.append(labels[k])
                score.append(float(min(1.0, mean[k])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*docs_names, *names[1:]])

    from pyspark.sql import types as T

    out = T.StructType([*schema.fields, T.StructField(names[1], T.StringType()), T.StructField(names[2], T.DoubleType())])
    return numbered(docs).mapInArrow(run, out).withColumn(names[0], held_out(F.col("doc_id")))


def op10_langid(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs.select("doc_id", "text"), fit(docs)).select("doc_id", "held_out", "lang_pred", "score")
