"""Token counts through a digest cache.

A text's key is the SHA-256 of its content (null as empty; nothing else is normalised, as any other change could
change the count) together with the digest of the tokenizer's file. Counts stored under that key are joined;
only the distinct texts that miss are encoded, once each, and appended to the cache.

The cache is a Parquet table in the shared folder, one directory for each tokenizer digest. A run that is cut
short leaves whole appends or none; two runs that append the same key leave equal rows, of which one is read.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated rows are returned each; a null doc_id
is returned as such; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import public_tokenizers
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, frugal

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
_WORKER: dict = {}


def tokenizer_digest(path: str) -> str:
    """The tokenizer's version: the digest of its file."""
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def count_tokens(path: str, texts: list[str]) -> list[int]:
    """Tokens of each text, without begin, end or added special tokens."""
    if path not in _WORKER:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _WORKER[path] = lambda some: [len(model.encode(x)) for x in some]  # one at a time: a list of ids is large
        else:
            import tokenizers

            model = tokenizers.Tokenizer.from_file(path)
            _WORKER[path] = lambda some: [len(x.ids) for x in model.encode_batch_fast(some, add_special_tokens=False)]
    return _WORKER[path](texts)


def encode(path: str):
    """mapInArrow function: (digest, text) to (digest, n_tokens)."""
    schema = pa.schema([("digest", pa.binary()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                counts = count_tokens(path, batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("digest").cast(pa.binary()), pa.array(counts, pa.int64())], schema=schema)

    return run


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """The cache: (digest, n_tokens), empty where none has been written."""
    schema = "digest binary, n_tokens long"
    try:
        return spark.read.schema(schema).parquet(folder)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def count(spark: SparkSession, docs: DataFrame, path: str, cache: str, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit; new texts are appended to ``cache``."""
    folder = f"{cache}/tokenizer={tokenizer_digest(path)}"
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    old = stored(spark, folder)
    # The partial aggregate keeps one copy of a text for each task before the shuffle, so hot texts stay small.
    misses = keyed.join(old, "digest", "left_anti") if old.head(1) else keyed
    misses = misses.groupBy("digest").agg(F.first("text").alias("text"))
    misses.mapInArrow(frugal(encode(path)), "digest binary, n_tokens long").write.mode("append").parquet(folder)
    # Written, so that the join deals both sides anew and can split a text that a third of all rows share.
    counts = Scratch(spark, "token-counts").save(stored(spark, folder).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    out = keyed.select("doc_id", "digest", "n_bytes").join(counts, "digest")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def count_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: token counts of all documents, with a cache that starts empty."""
    cache = Scratch(spark, "token-cache").root
    return count(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(MODEL), cache)
