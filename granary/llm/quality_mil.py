"""Quality classifier: attention-based multiple-instance learning over passages.

A text is cut into passages of `PASSAGE` words. Each passage is encoded (shares of character classes, repetition, a hashed bag of
its words) and mapped to a vector; gated attention, learned from the documents' labels alone, weighs the passages; the weighted
sum is scored. So a label on the document teaches which passages tell its quality.

Learning takes at most `FIT_ROWS` labelled ids, those with the least hash of the id, and of the text of each at most `FIT_PASSAGES`
passages, evenly spread over all of it (a documented bound, with the same law at every size), so that what the driver gathers has a
bound too; encoding and scoring read every whole text. Only the text is an input of a score.

Cases: null and empty texts are one passage without words and get a score as others; rows that repeat get equal scores; a label
is null: the row teaches nothing; several labels of one id: the least counts; several texts of one id: that of the least hash teaches; labels of one class only, or none: every score is
the share of good ones (one half without any); an empty table gives no rows; further columns are ignored. A worker holds one
batch, encoded some million characters at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.common import free_name, tidy

PASSAGE, HASHED, HIDDEN, ATTENTION = 64, 256, 32, 16
FIT_ROWS, FIT_PASSAGES, EPOCHS, STEPS, AT_A_TIME = 4000, 64, 14, 900, 1_000_000
THRESHOLD = 0.3

# Character classes by byte: each ASCII punctuation mark has its own.
_CLASS = np.zeros(256, np.int64)
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = 0 if 97 <= _b <= 122 else 1 if 65 <= _b <= 90 else 2 if 48 <= _b <= 57 else 3 if _b >= 128 else 4 if _b == 10 else 5 if _b <= 32 or _b == 127 else -1
_marks = [b for b in range(256) if _CLASS[b] == -1]
_CLASS[_marks] = 6 + np.arange(len(_marks))
CLASSES = 6 + len(_marks)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
DENSE = CLASSES + 6
WIDTH = DENSE + HASHED
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of all texts (rows), and where each text's passages begin (with the end). Every text has one at least."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    doc_end = np.cumsum([len(r) + 1 for r in raw])
    space = _SPACE[buf]
    start = np.flatnonzero(~space & np.append(True, space[:-1]))
    end = np.flatnonzero(~space & np.append(space[1:], True)) + 1
    doc = np.searchsorted(doc_end, start, side="right")
    n_words = np.bincount(doc, minlength=len(texts))
    n_passages = np.maximum(1, -(-n_words // PASSAGE))
    begin = np.append(0, np.cumsum(n_passages))
    first_word = np.cumsum(n_words) - n_words
    passage = begin[doc] + (np.arange(len(start)) - first_word[doc]) // PASSAGE
    total = int(begin[-1])
    x = np.zeros((total, WIDTH), np.float32)
    words = np.maximum(np.bincount(passage, minlength=total), 1).astype(np.float32)
    if len(start):
        # Bytes belong to the passage of the word that they are in or follow.
        until = np.append(start[1:], len(buf))
        of_byte = np.repeat(passage, until - start)
        body = buf[start[0] :]
        hist = np.bincount(of_byte * CLASSES + _CLASS[body], minlength=total * CLASSES).reshape(total, CLASSES).astype(np.float32)
        x[:, :CLASSES] = np.log1p(100 * hist / np.maximum(hist.sum(axis=1, keepdims=True), 1)) / 4
        with np.errstate(over="ignore"):
            power = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(buf), _BASE, np.uint64)]))
            prefix = np.append(np.uint64(0), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[:-1]))
            back = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(buf), _INVERSE, np.uint64)]))[start]
            h = (prefix[end] - prefix[start]) * back
            h ^= h >> np.uint64(31)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
        bag = np.bincount(passage * HASHED + (h & np.uint64(HASHED - 1)).astype(np.int64), minlength=total * HASHED).reshape(total, HASHED).astype(np.float32)
        x[:, DENSE:] = np.sqrt(bag / words[:, None])
        near = lambda k: np.bincount(passage[k:][(h[k:] == h[:-k]) & (passage[k:] == passage[:-k])], minlength=total) / words
        key = (passage.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24))
        distinct = np.bincount((np.unique(key) >> np.uint64(40)).astype(np.int64), minlength=total)
        x[:, CLASSES + 0], x[:, CLASSES + 1] = near(1), near(2)
        x[:, CLASSES + 2] = distinct / words
        x[:, CLASSES + 3] = np.minimum(np.bincount(passage, weights=end - start, minlength=total) / words / 10, 10)
    n = np.repeat(n_words, n_passages)
    x[:, CLASSES + 4] = np.log1p(n) / 8
    x[:, CLASSES + 5] = n < 10
    return x, begin


class Model:
    """Parameters of encoder, gated attention and scorer; or a constant."""

    def __init__(self, seed: int = 7, constant: float | None = None) -> None:
        r = np.random.default_rng(seed)
        init = lambda a, b: (r.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.constant = constant
        self.p = {
            "W": init(WIDTH, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": init(HIDDEN, ATTENTION), "U": init(HIDDEN, ATTENTION),
            "w": init(ATTENTION, 1), "c": init(HIDDEN, 1), "d": np.zeros(1, np.float32),
        }

    def forward(self, x: np.ndarray, begin: np.ndarray) -> dict[str, np.ndarray]:
        p, starts = self.p, begin[:-1]
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["w"]
        e = e[:, 0]
        lens = np.diff(begin)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), lens))
        a = e / np.repeat(np.add.reduceat(e, starts), lens)
        z = np.add.reduceat(h * a[:, None], starts, axis=0)
        logit = (z @ p["c"])[:, 0] + p["d"][0]
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "score": 1 / (1 + np.exp(-np.clip(logit, -30, 30)))}

    def score(self, x: np.ndarray, begin: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(begin) - 1, self.constant)
        return self.forward(x, begin)["score"].astype(np.float64)

    def gradient(self, x: np.ndarray, begin: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self.forward(x, begin)
        lens, n = np.diff(begin), len(y)
        d_logit = ((f["score"] - y) / n)[:, None].astype(np.float32)
        d_z = np.repeat(d_logit @ p["c"].T, lens, axis=0)
        d_a = (d_z * f["h"]).sum(axis=1)
        d_e = f["a"] * (d_a - np.repeat(np.add.reduceat(d_a * f["a"], begin[:-1]), lens))
        d_tg = d_e[:, None] @ p["w"].T
        d_t, d_g = d_tg * f["g"] * (1 - f["t"] ** 2), d_tg * f["t"] * f["g"] * (1 - f["g"])
        d_h = d_z * f["a"][:, None] + d_t @ p["V"].T + d_g @ p["U"].T
        d_u = d_h * (1 - f["h"] ** 2)
        return {
            "W": x.T @ d_u, "b": d_u.sum(axis=0), "V": f["h"].T @ d_t, "U": f["h"].T @ d_g, "w": (f["t"] * f["g"]).T @ d_e[:, None],
            "c": f["z"].T @ d_logit, "d": d_logit.sum(axis=0),
        }


def fit(x: np.ndarray, begin: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Learns by Adam over batches of documents, their passages in bags; few rows are gone through more often, for `STEPS` steps."""
    if len(y) == 0 or y.min() == y.max():
        return Model(constant=float(y.mean()) if len(y) else 0.5)
    model, r = Model(seed), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(q) for k, q in model.p.items()}
    lens, step, size = np.diff(begin), 0, 64
    epochs = max(epochs, -(-STEPS * size // len(y)))
    for epoch in range(epochs):
        rate = 4e-3 * (1 - epoch / epochs)
        order = r.permutation(len(y))
        for at in range(0, len(y), size):
            pick, step = order[at : at + size], step + 1
            n = lens[pick]
            rows = np.repeat(begin[pick] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            grad = model.gradient(x[rows], np.append(0, np.cumsum(n)), y[pick])
            for k, g in grad.items():
                g = g + 1e-4 * model.p[k]
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.002 * (g * g - v[k])
                model.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.998**step)) + 1e-7)).astype(np.float32)
    return model


def _pieces(texts: list[str]) -> Iterator[slice]:
    at = 0
    while at < len(texts):
        size, to = 0, at
        while to < len(texts) and (to == at or size + len(texts[to]) <= AT_A_TIME):
            size += len(texts[to])
            to += 1
        yield slice(at, to)
        at = to


def held_out(doc_id: Column, parts: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts == 0


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = FIT_ROWS) -> Model:
    """A model from labels (doc_id, label) of rows that are not held out; rows: how many at most."""
    known = labels.where(F.col(label).isNotNull() & ~held_out(F.col("doc_id"), 5)).groupBy("doc_id").agg(F.min(label).alias("y"))
    picked = known.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(rows)
    # At most `rows` rows, so they are broadcast; of ids that repeat among documents one text is taken, before the driver sees any.
    t = F.coalesce("text", F.lit(""))
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min_by(t, F.struct(F.xxhash64(t), F.length(t))).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            all_ = batch["text"].tolist()
            for part in _pieces(all_):
                x, begin = encode(all_[part])
                spread = [np.unique(np.linspace(a, b - 1, min(b - a, FIT_PASSAGES)).astype(np.int64)) for a, b in zip(begin[:-1], begin[1:], strict=True)]
                packed = [x[rows].astype(np.float16).tobytes() for rows in spread]
                yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy()[part], "y": batch["y"].to_numpy()[part], "x": packed})

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = texts.mapInPandas(tidy(run), f"doc_id {kind}, y int, x binary").collect()
    got = sorted(got, key=lambda r: r["doc_id"])
    bags = [np.frombuffer(r["x"], np.float16).astype(np.float32).reshape(-1, WIDTH) for r in got]
    begin = np.append(0, np.cumsum([len(b) for b in bags])).astype(np.int64)
    return fit(np.concatenate(bags) if bags else np.zeros((0, WIDTH), np.float32), begin, np.array([r["y"] for r in got], np.float32))


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with a column of scores (0 to 1), all other columns kept as they are."""
    kept = docs.drop(name)
    schema = T.StructType([*kept.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ = [t or "" for t in batch.column("text").to_pylist()]
            scores = [model.score(*encode(all_[part])) for part in _pieces(all_)]
            column = pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, name])

    return kept.mapInArrow(tidy(run), schema)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = learn(docs, labels)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id"), 5).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the classifier does not reject, unchanged."""
    name = free_name(docs.columns, "_quality")
    scored = score(docs, learn(docs.select("doc_id", "text"), labels), name)
    return scored.where(F.col(name) >= threshold).drop(name)
