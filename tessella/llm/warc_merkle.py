"""Merkle fixity audit of WARC records.

A leaf is the SHA-256 of a whole record. Records stand at byte offsets; a node of level 0 covers a range of offsets
(``RANGE`` bytes, so a bounded number of records), a node above covers ``FAN`` ranges side by side; each is the hash of
its children in order. Two replicas are compared from the root down: only the children of nodes that differ are
joined, so sound branches cost nothing, and in the end the records of the differing ranges alone are compared.

Defined results: null urls and texts are empty; repeated rows are records of their own, each at its offset; a null
page_id comes first; a record that only one replica has is "missing" or "extra"; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, running_total

RANGE = 1 << 16
FAN = 16


def record(url: Column, html: Column) -> Column:
    """The bytes of a WARC/1.1 response record, as text."""
    body = F.coalesce(html, F.lit(""))
    head = ["WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: ", F.coalesce(url, F.lit("")), "\r\nContent-Type: text/html\r\nContent-Length: ", F.octet_length(body).cast("string"), "\r\n\r\n"]
    return F.concat(*(F.lit(x) if isinstance(x, str) else x for x in head), body, F.lit("\r\n\r\n"))


def levels(scratch: Scratch, leaves: DataFrame, name: str, top: int) -> list[DataFrame]:
    """Nodes (node, hash) of each level from 0 to ``top``; ``leaves`` has (offset, leaf)."""
    children = F.array_sort(F.collect_list(F.struct("_place", "_leaf")))
    joined = lambda: F.sha2(F.concat(F.lit("node"), F.array_join(F.transform(children, lambda x: F.concat_ws("@", x["_place"].cast("string"), x["_leaf"])), "|")), 256)
    now = leaves.select(F.floor(F.col("offset") / RANGE).alias("node"), F.col("offset").alias("_place"), F.col("leaf").alias("_leaf"))
    out = []
    for level in range(top + 1):
        now = scratch.save(now.groupBy("node").agg(joined().alias("hash")), f"{name}-{level}")
        out.append(now)
        now = now.select(F.floor(F.col("node") / FAN).alias("node"), F.col("node").alias("_place"), F.col("hash").alias("_leaf"))
    return out


def audit(spark: SparkSession, one: DataFrame, two: DataFrame) -> DataFrame:
    """(offset, status) of the records that differ: corrupt, missing (from ``two``) or extra (only there). Both have (offset, leaf)."""
    scratch = Scratch(spark, "merkle")
    end = max(x.agg(F.max("offset")).first()[0] or 0 for x in (one, two))
    top = 0
    while end // RANGE // FAN**top:
        top += 1
    trees = [levels(scratch, x, n, top) for x, n in ((one, "one"), (two, "two"))]
    differing = None
    for level in range(top, -1, -1):
        a, b = (t[level].select("node", F.col("hash").alias(h)) for t, h in zip(trees, ("_a", "_b")))
        if differing is not None:
            parents = differing.select(F.col("node").alias("_parent"))
            a, b = (x.join(parents, F.floor(F.col("node") / FAN) == F.col("_parent"), "left_semi") for x in (a, b))
        differing = scratch.save(a.join(b, "node", "full").where("NOT _a <=> _b").select("node"), f"differing-{level}")
    ranges = differing.select(F.col("node").alias("_range"))
    a, b = (x.join(ranges, F.floor(F.col("offset") / RANGE) == F.col("_range"), "left_semi").select("offset", F.col("leaf").alias(n)) for x, n in ((one, "_a"), (two, "_b")))
    status = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").otherwise("corrupt")
    return a.join(b, "offset", "full").where("NOT _a <=> _b").select("offset", status.alias("status"))


def audit_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: all pages as WARC records, audited against a replica in which the last byte is another in every record whose leaf starts with 00."""
    scratch = Scratch(spark, "warc")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    whole = pages.select("page_id", "url", record(F.col("url"), F.col("html")).alias("record"))
    leaf = F.sha2("record", 256)
    flipped = F.expr("concat(substring(record, 1, length(record) - 1), 'X')")  # of the same length, so all offsets hold
    hashed = whole.select("page_id", "url", F.octet_length("record").cast("long").alias("length"), leaf.alias("leaf"), F.when(leaf.startswith("00"), F.sha2(flipped, 256)).otherwise(leaf).alias("replica"))
    laid = running_total(scratch, "records", hashed, [F.col("page_id"), F.col("url"), F.col("leaf")], "length").withColumnRenamed("_before", "offset")
    laid = scratch.save(laid, "laid")
    found = audit(spark, laid.select("offset", "leaf"), laid.select("offset", F.col("replica").alias("leaf")))
    out = laid.join(found, "offset", "left")
    return out.select("page_id", F.col("offset").alias("record_offset"), F.col("length").alias("record_length"), F.col("leaf").alias("sha256"), F.coalesce("status", F.lit("intact")).alias("status"))


AUDIT_SQL = r"""
WITH records AS (
  SELECT page_id, url, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
    || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, ''))
    || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM pages),
hashed AS (SELECT page_id, url, strlen(record)::BIGINT AS record_length, sha256(record) AS sha256 FROM records)
SELECT page_id, coalesce(sum(record_length) OVER (ORDER BY page_id NULLS FIRST, url NULLS FIRST, sha256 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS record_offset,
  record_length, sha256, CASE WHEN sha256 LIKE '00%' THEN 'corrupt' ELSE 'intact' END AS status FROM hashed
"""
