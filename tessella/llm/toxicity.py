"""Toxicity by compression distance with two zstandard dictionaries.

One dictionary is trained on ordinary text, the other on toxic text: on the fragments of toxic documents whose byte
n-grams are far commoner there than in ordinary documents. The toxic coder holds both, the ordinary coder its own and
a filler of the same size, so a window without anything toxic has nearly the same length under both. A text is cut at
word ends into windows that cover all of it; each is compressed under both, behind a preamble that both know, so that
the fixed cost of a compressed block falls on both alike. How many windows save how many bytes is turned into a
probability by thresholds and weights calibrated on training documents that the dictionaries did not see.

Defined results: null and empty texts have no window and get the score of a text that saves nothing; repeated rows
are scored each; a null doc_id has the remainder of an empty text; without usable labels of both kinds the score is
0 for all; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import frugal
from tessella.llm.training import logistic, remainder, sample, sigmoid

WINDOW = 48
#: zstandard's level, and the shortest match: under the length of a short word with its spaces, over that of common endings.
LEVEL, MATCH = 12, 6
GRAM = 6
#: Bytes that UTF-8 text does not start with, known to both dictionaries.
PREAMBLE = bytes(range(128, 160))
#: Saved bytes of which the windows are counted.
STEPS = np.arange(1, 9)
THRESHOLD = 0.3
#: Bounds of the training sample: documents of each label, and bytes of each.
SAMPLE = {1: 1500, 0: 2500}
SAMPLE_BYTES = 20_000
ORDINARY_DICT, TOXIC_DICT = 16_384, 8_192


def normal(text: str | None) -> bytes:
    """Lower-case A-Z, white space collapsed, padded with a space at both ends."""
    return b" ".join([b"", *(text or "").encode().lower().split(), b""])


def windows(data: bytes) -> list[bytes]:
    """Whole words, together at least WINDOW bytes (the last window may be shorter), that cover the text."""
    out, at = [], 0
    while at < len(data) - 1:
        end = data.find(b" ", min(at + WINDOW, len(data) - 1))
        out.append(data[at : end + 1])
        at = end
    return out


def grams(data: bytes) -> np.ndarray:
    """The distinct byte n-grams of a text, as integers."""
    return np.unique(_gram_at(data))


def _gram_at(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).astype(np.int64)
    n = len(raw) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = np.zeros(n, np.int64)
    for k in range(GRAM):
        out = out << 8 | raw[k : k + n]
    return out


def toxic_fragments(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """The passages of toxic texts made of n-grams that many toxic and hardly any ordinary texts hold."""
    counts = []
    for texts in (toxic, ordinary):
        found = Counter()
        for data in texts:
            found.update(grams(data).tolist())
        counts.append(found)
    least = max(3, 0.02 * len(toxic))
    marked = np.array(sorted(g for g, n in counts[0].items() if n >= least and n / len(toxic) > 20 * (counts[1][g] + 0.5) / len(ordinary)), np.int64)
    out = []
    for data in toxic:
        hit = np.isin(_gram_at(data), marked)
        edges = np.flatnonzero(np.diff(np.r_[0, hit.view(np.int8), 0]))
        out += [data[a : b + GRAM - 1] for a, b in zip(edges[::2], edges[1::2])]
    # The outermost bytes are chance neighbours of what marks a passage.
    return [f[1:-1] if len(f) > GRAM + 2 else f for f in out]


def raw_dictionary(size: int, samples: list[bytes]) -> bytes:
    """The content of a dictionary trained on ``samples``; few samples are taken as they are, commonest last."""
    try:
        trained = zstandard.train_dictionary(size, samples).as_bytes()
        return trained[-min(size, len(trained)) :]
    except zstandard.ZstdError:
        return b"".join(s for s, _ in reversed(Counter(samples).most_common()))[-size:]


class Coder:
    """The two compressors."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        settings = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=MATCH, write_checksum=False, write_content_size=False, write_dict_id=False)
        filler = np.random.default_rng(0).integers(160, 256, len(toxic)).astype(np.uint8).tobytes()
        self.pair = []
        for content in (ordinary + filler + PREAMBLE, ordinary + toxic + PREAMBLE):
            content = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(compression_params=settings)
            self.pair.append(zstandard.ZstdCompressor(dict_data=content, compression_params=settings).compress)

    def features(self, data: bytes) -> np.ndarray:
        """Logarithms of the number of windows in which the toxic dictionary saves so many bytes, of all windows, and of the shares."""
        plain, toxic = self.pair
        saved = np.array([len(plain(PREAMBLE + w)) - len(toxic(PREAMBLE + w)) for w in windows(data)], int)
        counts, n = (saved[:, None] >= STEPS).sum(axis=0), max(len(saved), 1)
        return np.r_[np.log1p(counts), np.log(n), np.log1p(20 * counts / n)]


def dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """The ordinary and the toxic dictionary of training texts."""
    pieces = [d[at : at + 256] for d in ordinary for at in range(0, len(d), 256)]
    fragments = toxic_fragments(toxic, ordinary)
    return raw_dictionary(ORDINARY_DICT, pieces), raw_dictionary(TOXIC_DICT, fragments) if fragments else b""


def train(rows: list[tuple[str, int]]) -> dict | None:
    """Dictionaries and calibration from (text, label) rows; None without both labels.

    Calibration is crossed: each half of the texts is measured by dictionaries of the other half.
    """
    toxic = sorted({normal(t) for t, y in rows if y == 1})
    ordinary = sorted({normal(t) for t, y in rows if y == 0})
    if not toxic or not ordinary:
        return None
    x, y = [], []
    for half in (0, 1):
        seen = (toxic[half::2] or toxic, ordinary[half::2] or ordinary)
        unseen = (toxic[1 - half :: 2], ordinary[1 - half :: 2])
        coder = Coder(*dictionaries(*seen))
        for label, texts in zip((1, 0), unseen):
            x += [coder.features(d) for d in texts]
            y += [label] * len(texts)
    content = dictionaries(toxic, ordinary)
    return {"ordinary": content[0], "toxic": content[1], "weights": logistic(np.array(x), np.array(y, float))}


def scored(docs: DataFrame, model: dict | None, name: str = "_score") -> DataFrame:
    """``docs`` with a column ``name`` (it may not have one), the score of whole texts; ``docs`` has a column text and may have any others."""
    if name in docs.columns:
        raise ValueError(f"there is a column {name}")
    if model is None:
        return docs.withColumn(name, F.lit(0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(model["ordinary"], model["toxic"])
        w = model["weights"]
        for batch in batches:
            x = np.array([coder.features(normal(t.as_py())) for t in batch.column("text")]).reshape(-1, len(w) - 1)
            yield batch.append_column(name, pa.array(sigmoid(x @ w[:-1] + w[-1])))

    return docs.mapInArrow(frugal(run), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, score) of whole texts."""
    return scored(docs.select("doc_id", "text"), model).select("doc_id", F.col("_score").alias("score"))


def fitted(docs: DataFrame, labels: DataFrame) -> dict | None:
    """A model from the labelled rows whose crc32 remainder by 4 is not 2."""
    return train(sample(docs, labels, "toxic", SAMPLE, 4, 2, SAMPLE_BYTES))


def classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the toxicity score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, model)
    return out.select("doc_id", (remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
