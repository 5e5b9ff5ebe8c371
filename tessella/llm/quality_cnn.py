"""Quality by a byte-level convolutional network in numpy.

Filters over WIDTH bytes (a learned table of weights for each place and byte) slide over the whole text. Overlapping
chunks of CHUNK bytes, which together cover the text, take the maximum of each filter; a rectified linear layer makes a
logit of a chunk, and a logistic layer over the mean, least and greatest chunk logit makes one probability. Trained with
Adam, in a fixed number of steps, on a bounded sample of labelled documents.

Defined results: a null or empty text has one chunk in which no filter fires; a NUL byte counts as padding; repeated
rows are scored each; a null doc_id has the remainder of an empty text; without usable labels of both kinds the score
is 0 for all; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import frugal
from tessella.llm.training import logistic, remainder, sample, sigmoid

WIDTH, FILTERS = 6, 16
BLOCK, CHUNK_BLOCKS, STRIDE_BLOCKS = 64, 8, 7
CHUNK = BLOCK * CHUNK_BLOCKS
THRESHOLD = 0.3
STEPS, BATCH, RATE = 2500, 64, 0.01
#: Bounds of the training sample: documents of each label, bytes of each, chunks of each.
SAMPLE = {0: 1500, 1: 2500}
SAMPLE_BYTES = 20_000
TRAIN_CHUNKS = 6
#: The weight of padding: a place that touches it never is a maximum.
PAD = np.float32(-1e3)


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts one after another, each padded with NUL to whole blocks, and the blocks of each."""
    blocks = np.array([max(1, -(-len(t) // BLOCK)) for t in texts], np.int64)
    ends = np.cumsum(blocks) * BLOCK
    out = np.zeros(int(ends[-1]) + WIDTH if len(texts) else WIDTH, np.uint8)
    for t, end, n in zip(texts, ends.tolist(), blocks.tolist()):
        out[end - n * BLOCK : end - n * BLOCK + len(t)] = np.frombuffer(t, np.uint8)
    return out, blocks


def block_maxima(table: np.ndarray, data: np.ndarray) -> np.ndarray:
    """(blocks, FILTERS): each filter's maximum among the places that start in a block."""
    n = (len(data) - WIDTH) // BLOCK
    out = np.empty((n, FILTERS), np.float32)
    slab = 64
    for first in range(0, n, slab):
        last = min(n, first + slab)
        a, b = first * BLOCK, last * BLOCK
        values = table[0].take(data[a:b], axis=0)
        for k in range(1, WIDTH):
            values += table[k].take(data[a + k : b + k], axis=0)
        values.reshape(last - first, BLOCK, FILTERS).max(axis=1, out=out[first:last])
    return out


def guarded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """As ``padded``, with a text that fills its last block followed by one more block, so no place runs into the next text."""
    return padded([t + b"\0" * WIDTH for t in texts])


def chunk_maxima(table: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The chunks of all texts, as (chunks, FILTERS), and the number of chunks of each text."""
    data, blocks = guarded(texts)
    maxima = block_maxima(table, data)
    chunks = np.maximum(1, -(-(blocks - (CHUNK_BLOCKS - STRIDE_BLOCKS)) // STRIDE_BLOCKS))
    first = np.repeat(np.cumsum(blocks) - blocks, chunks)
    end = np.repeat(np.cumsum(blocks), chunks)
    nth = np.arange(chunks.sum()) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    start = first + nth * STRIDE_BLOCKS
    stop = np.minimum(start + CHUNK_BLOCKS, end)
    maxima = np.vstack([maxima, np.full((1, FILTERS), PAD, np.float32)])
    return np.maximum.reduceat(maxima, np.column_stack([start, stop]).ravel(), axis=0)[::2], chunks


def features(model: dict, texts: list[bytes]) -> np.ndarray:
    """Mean, least and greatest chunk logit of each text."""
    if not texts:
        return np.zeros((0, 3))
    maxima, chunks = chunk_maxima(model["table"], texts)
    logits = np.maximum(maxima + model["bias"], 0) @ model["out"] + model["shift"]
    at = np.cumsum(chunks) - chunks
    return np.column_stack([np.add.reduceat(logits, at) / chunks, np.minimum.reduceat(logits, at), np.maximum.reduceat(logits, at)])


def train(rows: list[tuple[str, int]], seed: int = 0) -> dict | None:
    """A model from (text, label) rows; None without both labels."""
    if len({y for _, y in rows}) < 2:
        return None
    rng = np.random.default_rng(seed)
    x, y = [], []
    for text, label in rows:
        raw = text.encode()
        starts = np.arange(0, max(1, len(raw) - (CHUNK - BLOCK * STRIDE_BLOCKS)), BLOCK * STRIDE_BLOCKS)
        for at in rng.permutation(starts)[:TRAIN_CHUNKS]:
            x.append(np.frombuffer(raw[at : at + CHUNK].ljust(CHUNK + WIDTH, b"\0"), np.uint8))
            y.append(label)
    x, y = np.array(x), np.array(y, np.float32)
    share = np.where(y == 1, 0.5 / max((y == 1).mean(), 1e-9), 0.5 / max((y == 0).mean(), 1e-9)).astype(np.float32)
    p = {
        "table": rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32),
        "bias": np.zeros(FILTERS, np.float32),
        "out": rng.normal(0, 0.3, FILTERS).astype(np.float32),
        "shift": np.zeros(1, np.float32),
    }
    p["table"][:, 0] = PAD
    moments, step = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}, 0
    while step < STEPS:
        order = rng.permutation(len(x))
        for at in range(0, len(order), BATCH):
            if step == STEPS:
                break
            pick = order[at : at + BATCH]
            b = x[pick]
            values = p["table"][0].take(b[:, :CHUNK], axis=0)
            for k in range(1, WIDTH):
                values += p["table"][k].take(b[:, k : CHUNK + k], axis=0)
            where = values.argmax(axis=1)
            h = np.take_along_axis(values, where[:, None], axis=1)[:, 0] + p["bias"]
            active = np.maximum(h, 0)
            error = ((sigmoid(active @ p["out"] + p["shift"]) - y[pick]) * share[pick] / len(pick)).astype(np.float32)
            back = error[:, None] * p["out"] * (h > 0)
            grad = {"out": active.T @ error, "shift": error.sum(keepdims=True), "bias": back.sum(axis=0), "table": np.zeros_like(p["table"])}
            for k in range(WIDTH):
                np.add.at(grad["table"][k], (np.take_along_axis(b, where + k, axis=1), np.arange(FILTERS)), back)
            step += 1
            for name, g in grad.items():
                m, v = moments[name]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p[name] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            p["table"][:, 0] = PAD
    p["weights"] = logistic(features(p, [t.encode() for t, _ in rows]), np.array([y for _, y in rows], float))
    return p


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """``docs`` as (doc_id, score), whole texts."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model["weights"]
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                x = features(model, [(t or "").encode() for t in batch.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sigmoid(x @ w[:-1] + w[-1]))], schema=schema)

    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(frugal(run), "doc_id long, score double")


def fitted(docs: DataFrame, labels: DataFrame) -> dict | None:
    """A model from the labelled rows whose crc32 remainder by 5 is not 0."""
    return train(sample(docs, labels, "quality", SAMPLE, 5, 0, SAMPLE_BYTES))


def classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the quality score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, model)
    return out.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
