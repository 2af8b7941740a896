"""Quality score by a byte-level convolutional network in numpy.

The network embeds bytes, applies learned filters of ``WIDTH`` bytes at every
place of overlapping chunks that cover the whole text, max-pools each chunk,
and combines the chunks (their mean and their maximum) into one probability.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqspark.llm.common import bounded_labels, crc_fold, tidy, utf8, written

WIDTH, EMBED, FILTERS = 8, 8, 24
#: Bytes of a chunk; neighbours overlap by WIDTH - 1, so no place is missed.
CHUNK = 1024
#: Labelled rows of each class to learn from, each with its whole text.
PER_CLASS = 2_000
STEPS, BATCH, RATE = 400, 64, 8e-3


def new_network(seed: int = 8) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    return {"embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
            "filters": rng.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)).astype(np.float32),
            "shift": np.zeros(FILTERS, np.float32),
            "out": np.zeros(2 * FILTERS, np.float32), "bias": np.zeros(1, np.float32)}


def _windows(embedded: np.ndarray) -> np.ndarray:
    """Every WIDTH consecutive rows side by side."""
    n = len(embedded) - WIDTH + 1
    return np.lib.stride_tricks.as_strided(embedded, (n, WIDTH * EMBED), (embedded.strides[0], embedded.itemsize))


def chunk_maxima(net: dict, data: np.ndarray) -> np.ndarray:
    """Each chunk's maximum of each filter, at least 0 (chunks x FILTERS)."""
    if len(data) < WIDTH:
        data = np.r_[data, np.zeros(WIDTH - len(data), np.uint8)]
    step = CHUNK - WIDTH + 1
    out = []
    for at in range(0, len(data) - WIDTH + 1, 32 * step):  # bounded work space
        part = net["embed"][data[at:at + 32 * step + WIDTH - 1]]
        high = np.ascontiguousarray(_windows(part)) @ net["filters"]
        out.append(np.maximum.reduceat(high, np.arange(0, len(high), step), axis=0))
    return np.maximum(np.concatenate(out) + net["shift"], 0)


def text_features(maxima: np.ndarray) -> np.ndarray:
    return np.r_[maxima.mean(axis=0), maxima.max(axis=0)]


def probability(net: dict, data: bytes) -> float:
    f = text_features(chunk_maxima(net, np.frombuffer(data, np.uint8)))
    return float(1 / (1 + np.exp(-np.clip(f @ net["out"] + net["bias"][0], -30, 30))))


def train(texts: list[list[bytes]], labels: np.ndarray, weights: np.ndarray, seed: int = 8) -> dict[str, np.ndarray]:
    """Fits the network to rows of chunks by Adam on the logistic loss; the
    gradient of a maximum goes to the place that attained it."""
    net = new_network(seed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.items()}
    rng = np.random.default_rng(seed)
    t = 0
    epochs = max(4, -(-STEPS * BATCH // len(texts)))
    for epoch in range(epochs):
        rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        for rows in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // BATCH)):
            grad = {k: np.zeros_like(v) for k, v in net.items()}
            for r in rows:
                maxima, best = [], []
                for body in texts[r]:
                    d = np.frombuffer(body.ljust(WIDTH, b"\0"), np.uint8)
                    high = np.ascontiguousarray(_windows(net["embed"][d])) @ net["filters"]
                    at = high.argmax(axis=0)
                    maxima.append(high[at, np.arange(FILTERS)] + net["shift"])
                    best.append((d, at))
                raw = np.array(maxima)
                m = np.maximum(raw, 0)
                f = text_features(m)
                p = 1 / (1 + np.exp(-np.clip(f @ net["out"] + net["bias"][0], -30, 30)))
                e = np.float32((p - labels[r]) * weights[r] / len(rows))
                grad["out"] += e * f
                grad["bias"] += e
                top = m.argmax(axis=0)
                back = np.repeat(e * net["out"][None, :FILTERS] / len(m), len(m), axis=0)
                back[top, np.arange(FILTERS)] += e * net["out"][FILTERS:]
                back *= raw > 0
                grad["shift"] += back.sum(axis=0)
                for g, (d, at) in zip(back, best, strict=True):
                    spots = at[:, None] + np.arange(WIDTH)  # FILTERS x WIDTH
                    seen = net["embed"][d[spots]].reshape(FILTERS, -1)
                    grad["filters"] += (seen * g[:, None]).T
                    np.add.at(grad["embed"], d[spots].ravel(), (net["filters"].T * g[:, None]).reshape(-1, EMBED))
            t += 1
            for k in net:
                g = grad[k] + (1e-4 * net[k] if k in ("out", "filters") else 0)
                m1, m2 = moments[k]
                m1 += 0.1 * (g - m1)
                m2 += 0.001 * (g * g - m2)
                net[k] = (net[k] - rate * (m1 / (1 - 0.9 ** t)) / (np.sqrt(m2 / (1 - 0.999 ** t)) + 1e-8)).astype(np.float32)
    return net


def text_chunks(data: bytes) -> list[bytes]:
    """The overlapping chunks that scoring sees: all of the text."""
    step = CHUNK - WIDTH + 1
    return [data[at:at + CHUNK] for at in range(0, max(len(data) - WIDTH, 0) + 1, step)]


def training_rows(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(_label, _weight, _b)`` of the sampled labelled rows, texts whole."""
    rows = docs.select(F.col(id_col).alias("_did"), utf8(F.col(text_col)).alias("_b"))
    return rows.join(F.broadcast(sample), rows["_did"] == sample["_id"]).select("_label", "_weight", "_b")


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "quality", label_id_col: str = "doc_id", per_class: int = PER_CLASS) -> DataFrame:
    """``(id_col, held_out, score)`` of every row of ``docs``.

    The network is fitted on at most about ``per_class`` labelled rows of each
    class whose crc32 fold is not the held-out one, on all overlapping chunks
    of their texts, as every text is scored.  Without labelled rows of both classes scores are 0.5.

    Null text counts as empty and is scored like a text of padding; null and
    repeated ids and repeated rows each keep a row; an empty table gives no
    rows; other columns are not read."""
    spark = docs.sparkSession
    sample = written(bounded_labels(labels, label_col, per_class, label_id_col), "quality-labels")
    known = training_rows(docs, sample, id_col, text_col).toArrow()
    y = known.column("_label").to_numpy().astype(np.float32)
    texts = known.column("_b").to_pylist()
    order = sorted(range(len(y)), key=lambda i: (y[i], texts[i]))  # independent of row order
    if len(set(y.tolist())) == 2:
        w = known.column("_weight").to_numpy().astype(np.float32)
        w = w / w.mean()
        net = train([text_chunks(texts[i]) for i in order], y[order], w[order])
    else:
        net = new_network()
    model = spark.sparkContext.broadcast(net)
    rows = docs.select(F.col(id_col).alias("_id"), utf8(F.col(text_col)).alias("_b"))

    def score(batches):
        for b in batches:
            p = [probability(model.value, x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64())], ["_id", "score"])

    return (rows.mapInArrow(tidy(score), f"_id {rows.schema['_id'].dataType.simpleString()}, score double")
            .select(F.col("_id").alias(id_col), (crc_fold(F.col("_id")) == 1).alias("held_out"), "score"))
