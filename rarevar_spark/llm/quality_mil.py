"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` words. Every passage is encoded by how its bytes' classes follow each
other and how its words repeat; gated attention weighs the encoded passages, and the weighted sum is scored. Encoder, attention
and scorer are learned together from document labels. Only the text is looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import keep
from .textkit import BLANK_SEPARATED, slices, span_hashes, word_bounds

PASSAGE_WORDS = 64
#: classes of bytes: lower, upper, digit, blank, newline, sentence marks, other marks, beyond ASCII
_CLASS = np.array([
    7 if b >= 128 else 0 if 97 <= b <= 122 else 1 if 65 <= b <= 90 else 2 if 48 <= b <= 57 else 4 if b == 10 else 3 if b <= 32 else 5 if chr(b) in ".,;:!?'\"-()" else 6
    for b in range(256)
], dtype=np.int64)
N_FEATURES = 64 + 6


def encode_passages(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features (passages, N_FEATURES) and the document of each passage; a text without a word is one passage of zeros."""
    n_docs = len(off) - 1
    start, end, doc = word_bounds(raw, off, BLANK_SEPARATED)
    words_in = np.bincount(doc, minlength=n_docs)
    per_doc = np.maximum(-(-words_in // PASSAGE_WORDS), 1)
    of = np.repeat(np.arange(n_docs), per_doc)
    first = np.concatenate([[0], np.cumsum(per_doc)[:-1]])
    x = np.zeros((len(of), N_FEATURES))
    if not len(start):
        return x, of
    nth = np.arange(len(doc)) - np.searchsorted(doc, np.arange(n_docs))[doc]
    passage = first[doc] + nth // PASSAGE_WORDS
    head = np.flatnonzero(np.diff(passage, prepend=-1))
    begin = start[head]  # bytes from a passage's first word up to the next passage's belong to it
    stop = np.minimum(np.append(begin[1:], len(raw)), off[doc[head] + 1])
    inside = np.zeros(len(raw) + 1, dtype=np.int64)
    inside[begin] += passage[head] + 1
    np.subtract.at(inside, stop, passage[head] + 1)
    at = np.cumsum(inside[:-1]) - 1
    cls = _CLASS[raw]
    ok = (at[:-1] >= 0) & (at[:-1] == at[1:])
    code = (at[:-1] * 64 + cls[:-1] * 8 + cls[1:])[ok]
    pairs = np.bincount(code, minlength=len(of) * 64)[: len(of) * 64].reshape(len(of), 64)
    x[:, :64] = np.sqrt(pairs / np.maximum(pairs.sum(axis=1, keepdims=True), 1))
    n = np.bincount(passage, minlength=len(of)).astype(float)
    size = (end - start).astype(float)
    mean = np.bincount(passage, weights=size, minlength=len(of)) / np.maximum(n, 1)
    square = np.bincount(passage, weights=size**2, minlength=len(of)) / np.maximum(n, 1)
    h = span_hashes(raw, start, end)
    order = np.lexsort((h, passage))
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    distinct = np.bincount(passage[order][new], minlength=len(of))
    again = np.zeros(len(h))
    again[1:] = (h[1:] == h[:-1]) & (passage[1:] == passage[:-1])
    x[:, 64] = np.log1p(n) / 4
    x[:, 65] = mean / 10
    x[:, 66] = np.sqrt(np.maximum(square - mean**2, 0)) / 10
    x[:, 67] = distinct / np.maximum(n, 1)
    x[:, 68] = np.bincount(passage, weights=again, minlength=len(of)) / np.maximum(n, 1)
    x[:, 69] = np.bincount(passage, weights=_CLASS[raw[end - 1]] == 6, minlength=len(of)) / np.maximum(n, 1)
    return x, of


def _forward(w: dict[str, np.ndarray], x: np.ndarray, of: np.ndarray, n: int) -> dict[str, np.ndarray]:
    z = (x - w["mean"]) / w["scale"]
    h = np.tanh(z @ w["E"] + w["e"])
    t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
    s = (t * g) @ w["a"]
    begin = np.searchsorted(of, np.arange(n))
    a = np.exp(s - np.maximum.reduceat(s, begin)[of])
    a /= np.add.reduceat(a, begin)[of]
    bag = np.add.reduceat(a[:, None] * h, begin, axis=0)
    p = 1 / (1 + np.exp(-np.clip(bag @ w["c"] + w["d"], -40, 40)))
    return {"z": z, "h": h, "t": t, "g": g, "a": a, "bag": bag, "p": p}


def score(w: dict[str, np.ndarray], x: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Probability of label 1 for each of ``n`` documents."""
    return _forward(w, x, of, n)["p"]


def gradient(w: dict[str, np.ndarray], f: dict[str, np.ndarray], of: np.ndarray, err: np.ndarray) -> dict[str, np.ndarray]:
    """Derivatives by the weights of a loss whose derivatives by the documents' logits are ``err``, after a forward pass ``f``."""
    d_bag = err[:, None] * w["c"]
    d_a = (d_bag[of] * f["h"]).sum(axis=1)
    mean_a = np.bincount(of, weights=f["a"] * d_a, minlength=len(err))
    d_s = f["a"] * (d_a - mean_a[of])
    d_tg = d_s[:, None] * w["a"]
    d_t = d_tg * f["g"] * (1 - f["t"] ** 2)
    d_g = d_tg * f["t"] * f["g"] * (1 - f["g"])
    d_h = f["a"][:, None] * d_bag[of] + d_t @ w["V"].T + d_g @ w["U"].T
    d_e = d_h * (1 - f["h"] ** 2)
    return {"E": f["z"].T @ d_e, "e": d_e.sum(axis=0), "V": f["h"].T @ d_t, "U": f["h"].T @ d_g, "a": (f["t"] * f["g"]).T @ d_s, "c": f["bag"].T @ err, "d": np.array([err.sum()])}


def fit(x: np.ndarray, of: np.ndarray, y: np.ndarray, width: int = 24, gates: int = 12, epochs: int = 25, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights learned by Adam on the documents' log loss, classes weighed alike."""
    rng = np.random.default_rng(seed)
    w = {
        "mean": x.mean(axis=0), "scale": x.std(axis=0) + 0.02,
        "E": rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], width)), "e": np.zeros(width),
        "V": rng.normal(0, width**-0.5, (width, gates)), "U": rng.normal(0, width**-0.5, (width, gates)), "a": rng.normal(0, gates**-0.5, gates),
        "c": rng.normal(0, width**-0.5, width), "d": np.zeros(1),
    }
    n = len(y)
    begin = np.append(np.searchsorted(of, np.arange(n)), len(of))
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    learned = [k for k in w if k not in ("mean", "scale")]
    m, v, step = {k: 0.0 for k in learned}, {k: 0.0 for k in learned}, 0
    for _ in range(epochs):
        for docs in np.array_split(rng.permutation(n), max(1, n // 64)):
            rows = np.concatenate([np.arange(begin[d], begin[d + 1]) for d in docs])
            bag_of = np.repeat(np.arange(len(docs)), begin[docs + 1] - begin[docs])
            f = _forward(w, x[rows], bag_of, len(docs))
            err = (f["p"] - y[docs]) * weight[docs] / len(docs)
            grad = gradient(w, f, bag_of, err)
            step += 1
            for k in learned:
                g = grad[k] + decay * w[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g**2
                w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return w


def held_out() -> Column:
    """True for the documents whose labels are not learned from."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2


def _texts(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = 3000, sample_passages: int = 100_000) -> dict[str, np.ndarray] | None:
    """Weights from at most ``sample_docs`` labelled documents (those of least hash of doc_id) and ``sample_passages`` passages.

    ``docs`` are the documents that may be learned from, ``labels`` has doc_id and quality (0 or 1; others and null are left
    out; of repeated ids the least counts). None without both labels.
    """
    known = labels.where("quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality").cast("int")).alias("y"))
    chosen = known.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, off in slices(batch.column(1)):
                x, of = encode_passages(raw, off)
                data = [x[of == k].astype(np.float32).tobytes() for k in range(j - i)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(data, pa.binary())], ["doc_id", "y", "x"])

    # text goes to the tasks of the chosen ids; the ids are at most sample_docs rows
    sample = _texts(docs).join(F.broadcast(chosen), "doc_id").mapInArrow(rows, "doc_id long, y int, x binary")
    sample = keep(sample, "quality-sample")
    total, ids = 0, []  # sizes first, so that no more passages than wanted come to the driver
    for r in sorted(sample.select("doc_id", (F.octet_length("x") / (4 * N_FEATURES)).cast("long").alias("n")).collect()):
        if total + r["n"] <= sample_passages:
            total += r["n"]
            ids.append(r["doc_id"])
    bags, y = [], []
    for r in sorted(sample.where(F.col("doc_id").isin(ids)).collect(), key=lambda r: r["doc_id"]) if ids else []:
        bags.append(np.frombuffer(r["x"], dtype=np.float32).reshape(-1, N_FEATURES))
        y.append(r["y"])
    if len(set(y)) < 2:
        return None
    return fit(np.concatenate(bags).astype(float), np.repeat(np.arange(len(bags)), [len(b) for b in bags]), np.array(y, dtype=float))


def score_documents(docs: DataFrame, w: dict[str, np.ndarray] | None, threshold: float = 0.7) -> DataFrame:
    """doc_id, score and predicted (1 from ``threshold`` on) of every document, from its whole text.

    Null, empty and blank texts are scored as one passage without words; without weights every score is 0.5. Rows of a
    repeated doc_id are scored each; other columns are ignored; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(w)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            for i, j, raw, off in slices(batch.column(1)):
                p = np.full(j - i, 0.5) if w is None else score(w, *encode_passages(raw, off), j - i)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return _texts(docs).mapInArrow(rows, "doc_id long, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame, sample_docs: int = 3000) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; learned from the documents that are not held out."""
    w = train(docs.where(~held_out()), labels, sample_docs)
    return score_documents(docs, w).select("doc_id", held_out().alias("held_out"), "score", "predicted")
