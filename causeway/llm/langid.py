"""Language identification by a byte convolutional network, trained and applied in numpy.

Texts are cut into windows of ``LENGTH`` bytes, the last one padded with zero bytes. Bytes are embedded, filters of
several widths run over each window, each filter keeps its maximum, and a softmax layer gives the languages. A
document's logits are the mean of its windows' logits, weighted by their bytes; every window of a text counts.

Training reads at most ``docs_per_language`` labelled documents of each language (those with the smallest id
hashes) and at most ``windows_per_doc`` evenly spaced windows of each.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.llm.common import annotate, map_batches, quoted

LENGTH = 128
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBEDDING = 8
CHUNK = 256
UNKNOWN = "und"
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes | None) -> bool:
    """Whether a text has a letter of any script."""
    if not text:
        return False
    return bool(_ASCII_LETTER.search(text)) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


def windows(text: bytes, length: int = LENGTH) -> bytes:
    """The text, padded with zero bytes to whole windows."""
    return text.ljust(-(-len(text) // length) * length, b"\0")


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray  # (256, EMBEDDING)
    filters: np.ndarray  # (max width * EMBEDDING, filters); rows beyond a filter's width are zero
    bias: np.ndarray
    out: np.ndarray  # (filters, languages)
    out_bias: np.ndarray

    @classmethod
    def start(cls, languages: list[str], seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        n = FILTERS * len(WIDTHS)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        net = cls(languages, draw(256, EMBEDDING, scale=0.5), draw(max(WIDTHS) * EMBEDDING, n, scale=0.3), np.zeros(n, np.float32), draw(n, len(languages), scale=0.2), np.zeros(len(languages), np.float32))
        net.filters *= net.mask()
        return net

    @staticmethod
    def mask() -> np.ndarray:
        return np.concatenate([np.repeat((np.arange(max(WIDTHS) * EMBEDDING) < w * EMBEDDING)[:, None], FILTERS, 1) for w in WIDTHS], 1).astype(np.float32)

    def columns(self, rows: np.ndarray) -> np.ndarray:
        """(windows, positions, max width * EMBEDDING): what the filters see."""
        flat = self.embedding[rows].reshape(len(rows), -1)
        return np.lib.stride_tricks.sliding_window_view(flat, self.filters.shape[0], axis=1)[:, ::EMBEDDING]

    def convolve(self, rows: np.ndarray) -> np.ndarray:
        seen = self.columns(rows)
        n, positions, wide = seen.shape
        return (seen.reshape(n * positions, wide) @ self.filters).reshape(n, positions, -1)

    def logits(self, rows: np.ndarray) -> np.ndarray:
        """One row of logits for each window (a row of LENGTH bytes)."""
        made = [np.maximum(self.convolve(rows[i : i + CHUNK]).max(axis=1) + self.bias, 0) @ self.out + self.out_bias for i in range(0, len(rows), CHUNK)]
        return np.concatenate(made) if made else np.zeros((0, len(self.languages)), np.float32)

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
        live = [i for i, t in enumerate(texts) if has_letter(t)]
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not live or not self.languages:
            return names, scores
        padded = [windows(texts[i]) for i in live]
        logits = self.logits(np.frombuffer(b"".join(padded), np.uint8).reshape(-1, LENGTH))
        counts = np.array([len(p) // LENGTH for p in padded])
        first = np.cumsum(counts) - counts
        share = np.full(len(logits), float(LENGTH))
        share[first + counts - 1] = [len(texts[i]) - LENGTH * (n - 1) for i, n in zip(live, counts.tolist())]
        mean = np.add.reduceat(logits * share[:, None], first, axis=0) / np.add.reduceat(share, first)[:, None]
        odds = np.exp(mean - mean.max(axis=1, keepdims=True))
        odds /= odds.sum(axis=1, keepdims=True)
        for i, best, p in zip(live, odds.argmax(axis=1).tolist(), odds.max(axis=1).tolist()):
            names[i], scores[i] = self.languages[best], p
        return names, scores


def train(rows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = 8, batch: int = 128, rate: float = 4e-3, seed: int = 7) -> Network:
    """Adam on the cross-entropy, languages weighted alike."""
    net = Network.start(languages, seed)
    if len(languages) < 2:
        return net
    rng, mask, wide = np.random.default_rng(seed), net.mask(), max(WIDTHS)
    weight = (len(labels) / (len(languages) * np.bincount(labels, minlength=len(languages)).clip(1))).astype(np.float32)
    values = [net.embedding, net.filters, net.bias, net.out, net.out_bias]
    first, second, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), batch):
            pick = order[at : at + batch]
            x, y = rows[pick], labels[pick]
            n = len(pick)
            made = net.convolve(x)
            where = made.argmax(axis=1)  # (n, filters)
            best = np.take_along_axis(made, where[:, None], 1)[:, 0] + net.bias
            hidden = np.maximum(best, 0)
            logits = hidden @ net.out + net.out_bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(n), y] -= 1
            p *= weight[y][:, None] / n
            back = (p @ net.out.T) * (best > 0)
            seen = net.embedding[x[np.arange(n)[:, None, None], where[:, :, None] + np.arange(wide)]]  # (n, filters, wide, EMBEDDING)
            grad_filters = np.einsum("nf,nfk->kf", back, seen.reshape(n, -1, wide * EMBEDDING)) * mask
            grad_seen = (back[:, :, None] * net.filters.T[None]).reshape(-1, EMBEDDING)
            grad_embedding = np.zeros_like(net.embedding)
            np.add.at(grad_embedding, x[np.arange(n)[:, None, None], where[:, :, None] + np.arange(wide)].ravel(), grad_seen)
            grads = [grad_embedding, grad_filters, back.sum(0), hidden.T @ p, p.sum(0)]
            step += 1
            pace = rate * (1 - epoch / (epochs + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for v, g, a, b in zip(values, grads, first, second):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                v -= (pace * a / (np.sqrt(b) + 1e-8)).astype(np.float32)
    return net


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = 800, windows_per_doc: int = 4, most_languages: int = 1000, **options) -> Network:
    """A network for the languages of ``labelled`` (rows to learn from only). Rows with a null language or without a
    letter do not count; without any row there is no language, and every prediction is ``und``."""
    spark = labelled.sparkSession
    named = labelled.where(quoted(lang_col).isNotNull() & (F.length(quoted(text_col)) > 0)).select(
        quoted(lang_col).cast("string").alias("lang"), F.xxhash64(quoted(id_col).cast("string")).alias("h"), quoted(text_col).cast("binary").alias("text")
    )
    counts = named.groupBy("lang").agg(F.count("*").alias("n")).limit(most_languages + 1).collect()
    if len(counts) > most_languages:
        raise ValueError(f"more than {most_languages} languages: raise most_languages if that is meant")
    if not counts:
        return Network.start([])
    top = (1 << 63) - 1
    limits = spark.createDataFrame([(r.lang, top if r.n <= 2 * docs_per_language + 50 else -top + int(2 * top * (1.5 * docs_per_language + 50) / r.n)) for r in counts], "lang string, most long")
    some = named.join(F.broadcast(limits), "lang").where("h <= most")  # at most most_languages rows are broadcast
    first = Window.partitionBy("lang").orderBy("h")  # over about 1.5 * docs_per_language rows of each language
    some = some.withColumn("row", F.row_number().over(first)).where(F.col("row") <= docs_per_language).select("lang", "text")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, cuts = [], []
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if has_letter(text):
                padded = windows(text)
                n = len(padded) // LENGTH
                for i in sorted({round(k * (n - 1) / max(1, windows_per_doc - 1)) for k in range(windows_per_doc)}):
                    langs.append(lang)
                    cuts.append(padded[i * LENGTH : (i + 1) * LENGTH])
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(cuts, pa.binary())], names=["lang", "window"])

    # at most languages * docs_per_language * windows_per_doc windows of LENGTH bytes
    got = sorted((r.lang, bytes(r.window)) for r in map_batches(some, "lang string, window binary", cut).collect())
    if not got:
        return Network.start([])
    languages = sorted({lang for lang, _ in got})
    index = {lang: i for i, lang in enumerate(languages)}
    rows = np.frombuffer(b"".join(w for _, w in got), np.uint8).reshape(-1, LENGTH)
    return train(rows, np.array([index[lang] for lang, _ in got]), languages, **options)


def predict(docs: DataFrame, network: Network, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` as c0, c1, ... with lang_pred and score, over whole texts.

    Null texts and texts without a letter are ``und`` with score 0; repeated rows are each predicted; an empty table
    gives an empty result; columns of ``docs`` may have any names."""
    sent = docs.sparkSession.sparkContext.broadcast(network)

    def compute(texts):
        names, scores = sent.value.predict(texts)
        return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

    return annotate(docs, text_col, keep, "lang_pred string, score double", compute)
