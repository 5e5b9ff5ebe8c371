"""The corpus pipeline: five stages over ``documents``, each applying one operator of tessella.llm.

Stages run in order; each works on all rows that its predecessor kept. All but the last return the columns of
documents. Null texts are empty; rows with equal ids stay separate rows; an empty table runs through.

1. toxicity: documents whose compression-distance score reaches the threshold go.
2. near duplicates: one document of each group stays, the one with the smallest id.
3. repeated passages: bytes that a string of 200 bytes covers which also starts elsewhere are cut out; a document of
   which nothing is left goes.
4. mixing: documents are taken by the curriculum, as often as the mix takes them, in training order.
5. packing: the pieces of all documents with their sequences.
"""

from __future__ import annotations

from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm import minhash, mixing, packing, suffix_dedup, toxicity
from tessella.llm.common import Scratch, frugal

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the toxicity threshold."""
    model = toxicity.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.scored(docs, model).where(F.col("_score") < toxicity.THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates at five words and a similarity of 0.8: that of the smallest id, an
    unknown one last. Texts without words are in no group and all stay."""
    marks = minhash.grouped(Scratch(spark, "near-duplicates"), docs, 5, 80)
    first = F.min_by("row", F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row")))
    chosen = marks.where("component IS NOT NULL").groupBy("component").agg(first.alias("row")).select("row", F.lit(True).alias("_one"))
    apart = marks.where("component IS NULL").select("row", F.lit(False).alias("_one")).distinct()
    kept = docs.withColumn("_row", minhash.row_key()).join(chosen.union(apart), F.col("_row") == F.col("row"))
    # Rows equal in id and text share their hash: one of a group stays.
    number = F.when(F.col("_one"), F.lit(-1)).otherwise(F.monotonically_increasing_id())
    return kept.withColumn("_number", number).dropDuplicates(["_row", "_number"])


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated passages; characters that a cut splits go as well."""
    found, columns = suffix_dedup.deduplicated(spark, docs), docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column("text").to_pylist(), batch.column("_spans").to_pylist()
            kept = [t if t is None or not s else suffix_dedup.kept_bytes(t.encode(), s).decode(errors="ignore") for t, s in zip(texts, spans)]
            gone = pa.array([bool(s) and not (t or "").strip() for t, s in zip(kept, spans)], pa.bool_())
            given = {"text": pa.array(kept, batch.schema.field("text").type), "n_chars": pa.array([0 if t is None else len(t) for t in kept], pa.int64())}
            yield pa.RecordBatch.from_arrays([*(given.get(c, batch.column(c)) for c in columns), gone], names=[*columns, "_gone"])

    schema = T.StructType([*(T.StructField("n_chars", T.LongType()) if f.name == "n_chars" else f for f in docs.schema), T.StructField("_gone", T.BooleanType())])
    return found.select(*docs.columns, "_spans").mapInArrow(frugal(cut), schema).where("NOT _gone")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of the curriculum, each as often as the mix takes it."""
    return mixing.curriculum(spark, docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece with its sequence and place."""
    return packing.pack(spark, docs, public_tokenizers.path("word_bpe_49k.json"))


def with_all_columns(stage):
    """The stage over the columns of documents alone; whatever other columns there are, of any name, come through."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        others = [c for c in docs.columns if c not in COLUMNS]
        packed = docs.select(*COLUMNS, *([F.struct(*(F.col(f"`{c}`") for c in others)).alias("_others")] if others else []))
        out = stage(spark, packed, sf_dir)
        return out.select(*(F.col(c) if c in COLUMNS else F.col("_others").getField(c).alias(c) for c in docs.columns))

    return run


STAGES = [
    ("toxicity", with_all_columns(drop_toxic)),
    ("near_duplicates", with_all_columns(drop_near_duplicates)),
    ("suffix_array", with_all_columns(cut_repeats)),
    ("mixing", with_all_columns(mix_sources)),
    ("packing", pack_sequences),
]

#: Compression lengths, minimum hashes and tokenizers are beyond SQL; tests hold every stage against its plain form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's result written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
