"""Exact substring deduplication with suffix arrays, over UTF-8 bytes.

A byte is removed if a string of LENGTH bytes covers it that also starts anywhere else. Such strings meet as follows.

1. Every string of LENGTH bytes has an anchor: its leftmost SEED-byte gram of least hash, which depends on the string
   alone. Anchors are counted over the corpus; only anchors that stand in two places go on. Copies of a whole text are
   one text there.
2. Around a shared anchor, on a grid of STEP bytes fixed by the anchor, stand cores of LENGTH - STEP + 1 bytes. Equal
   strings have their core at the same place, so they are in the family of that core; a row of a family is the core
   with the STEP - 1 bytes on either side. Equal rows travel as one, with their number.
3. The rows of families go to tasks by family, and each task builds suffix arrays of them by linear grouping. A core is
   one symbol there, as is the whole row where a family has no other; a row that stands for several is written twice.
   Neighbours in the array that share a string of LENGTH bytes show the repeated strings. A text that several documents
   hold is one symbol in the same way.
   A family with more different rows than FAMILY is cut by cores that are half of the remaining bytes longer, and its
   parts are sorted alike, down to cores of the whole LENGTH bytes.
4. Repeated strings are joined to their texts, and the bytes that they cover are taken out.

Defined results: a null text is empty; texts shorter than LENGTH bytes are kept whole; repeated rows are copies of each
other; a null doc_id is returned as such; an empty table gives an empty result; other columns come through, but for
one named _spans, which is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, free, frugal
from tessella.llm.suffix_array import repeated_windows

LENGTH, SEED, STEP = 200, 32, 16
EDGE = STEP - 1
#: Different rows of one family that a task gathers, and symbols of one suffix array.
FAMILY, SYMBOLS = 1024, 40_000
#: Bytes of texts that are looked at together; a longer text is a slab of its own.
SLAB = 1 << 18
_rng = np.random.default_rng(11)
BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LANES = _rng.integers(0, 2**63, 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The mask of a whole text.
WHOLE = -1


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the SEED bytes from each place on, by doubling."""
    out, width = BYTE[data], 1
    while width < SEED:
        out = out[:-width] * np.uint64(0x9E3779B97F4A7C15) + out[width:]
        out ^= out >> np.uint64(29)
        width *= 2
    return out * np.uint64(0xBF58476D1CE4E5B9)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    square = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of all strings of LENGTH bytes: text, hash, place, and the first and last start of the strings that have it.

    ``data``: the bytes of all texts, one after another; ``sizes``: their lengths.
    """
    begins = np.cumsum(sizes) - sizes
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none.astype(np.uint64), none, none, none
    hashes = gram_hashes(data)
    bits = np.uint64(max(20, int(len(hashes)).bit_length()))
    ranked = hashes >> bits << bits | np.arange(len(hashes), dtype=np.uint64)  # equal hashes: the leftmost
    least = sliding_least(ranked, LENGTH - SEED + 1) & ((np.uint64(1) << bits) - np.uint64(1))
    last = begins + sizes - LENGTH  # the last start of each text
    text = np.repeat(np.arange(len(sizes)), sizes)[: len(least)]
    starts = np.flatnonzero(np.arange(len(least)) <= last[text])
    least, text = least[starts].astype(np.int64), text[starts]
    new = np.r_[True, (least[1:] != least[:-1]) | (text[1:] != text[:-1])] if len(starts) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    final = np.r_[first[1:], len(starts)] - 1
    of = text[first]
    at = least[first]
    return of, hashes[at], at - begins[of], starts[first] - begins[of], starts[final] - begins[of]


def offsets(column: pa.Array) -> np.ndarray:
    """Where the values of a binary or list column begin and end in its buffer."""
    return np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def slabs(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of about SLAB bytes of ``data``, with these bytes and the length of each text, without a copy."""
    if not batch.num_rows:
        return
    column = batch.column("data")
    ends = offsets(column)
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + SLAB, side="right")) - 1)
        yield batch.slice(start, stop - start), raw[ends[start] : ends[stop]], np.diff(ends[start : stop + 1])
        start = stop


def find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, data) to (text, hash, place)."""
    for batch in batches:
        for rows, data, sizes in slabs(batch):
            of, hashes, place, _, _ = anchors(data, sizes)
            yield pa.RecordBatch.from_arrays([rows.column("text").take(pa.array(of)), pa.array(hashes.view(np.int64)), pa.array(place, pa.int32())], names=["text", "hash", "place"])


def cut_out(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Pieces of ``data`` as a binary column."""
    ends = np.cumsum(sizes)
    index = np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.r_[0, ends].astype(np.int32).tobytes()), pa.py_buffer(data[index].tobytes())])


def names_of(data: np.ndarray, starts: np.ndarray, size: int) -> pa.Array:
    """128-bit hashes of ``size`` bytes from each start on, as a binary column."""
    wide = -(-size // 8) * 8
    padded = np.r_[data, np.zeros(wide - size, np.uint8)]
    pieces = np.zeros((len(starts), wide), np.uint8)
    if len(starts):
        pieces[:, :size] = np.lib.stride_tricks.sliding_window_view(padded, size)[starts]
    lanes = pieces.view(np.uint64)
    out = np.empty((len(starts), 2), np.uint64)
    for k, factor in enumerate(LANES):
        h = np.full(len(starts), factor)
        for lane in lanes.T:
            h = (h ^ lane) * factor
            h ^= h >> np.uint64(29 + 3 * k)
        h *= np.uint64(0x94D049BB133111EB)
        out[:, k] = h ^ (h >> np.uint64(32))
    return pa.Array.from_buffers(pa.binary(), len(out), [None, pa.py_buffer((16 * np.arange(len(out) + 1)).astype(np.int32).tobytes()), pa.py_buffer(out.tobytes())])


def find_cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, data, places of shared anchors) to (text, core, left, right, at): a row of a family for each place of the grid."""
    limit, size = 1 << 40, LENGTH - EDGE
    for batch in batches:
        for rows, data, sizes in slabs(batch):
            of, _, place, low, high = anchors(data, sizes)
            lists = rows.column("places")
            ends = offsets(lists)
            wanted = lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]].astype(np.int64)
            shared = np.repeat(np.arange(len(sizes)), np.diff(ends)) * limit + wanted
            hit = np.isin(of * limit + place, shared)
            of, place, low, high = of[hit], place[hit], low[hit], high[hit]
            # Cores stand at place - STEP * j; a core has the strings that start from EDGE bytes before it up to it.
            least, most = (place - high) // STEP, (place - low) // STEP
            number = most - least + 1
            j = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number) + np.repeat(least, number)
            # Two anchors a multiple of STEP apart share cores; each place of a text is one row.
            keys = np.unique(np.repeat(of, number) * limit + np.repeat(place, number) - STEP * j)
            for some in np.array_split(keys, max(1, len(keys) // 4096)):
                own, at = some // limit, some % limit
                begin = (np.cumsum(sizes) - sizes)[own] + at
                before, after = np.minimum(EDGE, at), np.minimum(EDGE, sizes[own] - at - size)
                columns = [rows.column("text").take(pa.array(own)), names_of(data, begin, size), cut_out(data, begin - before, before), cut_out(data, begin + size, after), pa.array(at, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["text", "core", "left", "right", "at"])


def find_repeats(edge: int):
    """mapInArrow function over whole families, sorted by core: the rows with repeated strings and a bit mask of these, by
    the distance of the start before the core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            masks = repeated_windows(rows, edge).tolist()
            found = [(*r[:3], m) for r, m in zip(rows, masks) if m]
            return pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in found], pa.binary()) for k in range(3)), pa.array([r[3] for r in found], pa.int64())], names=["core", "left", "right", "mask"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("core", "left", "right", "n"))):
                if len(rows) * 2 * STEP > SYMBOLS and row[0] != rows[-1][0]:
                    yield flush()
                    rows = []
                rows.append(row)
        if rows:
            yield flush()

    return run


def masks(scratch: Scratch, counted: DataFrame, edge: int = EDGE) -> DataFrame:
    """(core, left, right, mask) of the rows of families with repeated strings; ``counted`` has (core, left, right, n)."""
    families = counted.groupBy("core").agg(F.count("*").alias("_rows"), F.sum("n").alias("_all")).where("_all > 1")
    families = scratch.save(families, f"families-{edge}")
    own = counted.join(families, "core")
    if edge:
        own = own.where(F.col("_rows") <= FAMILY)
    own = own.select("core", "left", "right", "n").repartition("core").sortWithinPartitions("core")
    found = own.mapInArrow(frugal(find_repeats(edge)), "core binary, left binary, right binary, mask long")
    if not edge or families.where(F.col("_rows") > FAMILY).count() == 0:
        return found
    # Strings that start at least ``half`` + 1 bytes before the core have the bytes before it in common, the others those after it.
    half = edge // 2
    large = scratch.save(counted.join(families.where(F.col("_rows") > FAMILY).select("core"), "core"), f"large-{edge}")
    longer = half + 1
    before = large.where(F.octet_length("left") >= longer).select("core", "left", "right", "n", F.substring("left", -longer, longer).alias("more"), F.lit("left").alias("side"), F.expr(f"substring(left, 1, length(left) - {longer})").alias("l"), F.substring("right", 1, half).alias("r"))
    after = large.where(F.octet_length("right") >= longer).select("core", "left", "right", "n", F.substring("right", 1, longer).alias("more"), F.lit("right").alias("side"), F.substring("left", -half, half).alias("l"), F.expr(f"substring(right, {longer + 1}, {half})").alias("r"))
    parts = before.union(after).where(F.octet_length("l") + F.octet_length("r") >= half)
    parts = parts.withColumn("part", F.unhex(F.md5(F.concat(F.col("core"), F.encode(F.col("side"), "UTF-8"), F.col("more")))))
    parts = scratch.save(parts, f"parts-{edge}")
    smaller = parts.groupBy("part", "l", "r").agg(F.sum("n").alias("n")).select(F.col("part").alias("core"), F.col("l").alias("left"), F.col("r").alias("right"), "n")
    smaller = masks(scratch, scratch.save(smaller, f"counted-{half}"), half).select(F.col("core").alias("part"), F.col("left").alias("l"), F.col("right").alias("r"), F.col("mask").alias("m"))
    shift = F.when(F.col("side") == "left", longer).otherwise(0)
    back = parts.join(smaller, ["part", "l", "r"]).groupBy("core", "left", "right").agg(F.sum(F.call_function("shiftleft", F.col("m"), shift)).alias("mask"))
    return found.union(back)


def repeats(scratch: Scratch, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(text, at, mask) for each distinct text with repeated strings, and (text) that several rows hold; ``docs`` has (text digest, data)."""
    found = scratch.save(docs.mapInArrow(frugal(find_anchors), "text binary, hash long, place int"), "anchors")
    place = F.xxhash64("text", "place")  # copies of a text are one place
    shared = found.groupBy("hash").agg(F.min(place).alias("_a"), F.max(place).alias("_b")).where("_a <> _b").select("hash")
    shared = scratch.save(shared, "shared")
    places = found.join(shared, "hash", "left_semi").groupBy("text").agg(F.collect_set("place").alias("places"))
    places = scratch.save(places, "places")
    scratch.drop("anchors", "shared")
    # Each task sends one copy of a text.
    once = docs.groupBy("text").agg(F.first("data").alias("data")).join(places, "text").select("text", "data", "places")
    rows = scratch.save(once.mapInArrow(frugal(find_cores), "text binary, core binary, left binary, right binary, at int"), "rows")
    none = F.lit(b"")
    copies = docs.groupBy("text").agg(F.count("*").alias("n")).where("n > 1").select(F.col("text").alias("core"), none.alias("left"), none.alias("right"), "n")
    counted = scratch.save(rows.groupBy("core", "left", "right").agg(F.count("*").alias("n")).union(copies), "counted")
    marked = scratch.save(masks(scratch, counted), "masks")
    out = scratch.save(rows.join(marked.where(F.col("mask") != WHOLE), ["core", "left", "right"]).select("text", "at", "mask"), "found")
    whole = scratch.save(marked.where(F.col("mask") == WHOLE).select(F.col("core").alias("text")), "whole")
    scratch.drop("rows", "counted", "masks")
    return out, whole


def covered(at: np.ndarray, masks: np.ndarray) -> list[tuple[int, int]]:
    """The maximal runs of covered bytes."""
    row, bit = np.nonzero(masks[:, None] >> np.arange(STEP) & 1)
    starts = np.unique(at[row] - bit)
    if not len(starts):
        return []
    breaks = np.flatnonzero(starts[1:] > starts[:-1] + LENGTH)
    return list(zip(starts[np.r_[0, breaks + 1]].tolist(), (starts[np.r_[breaks, len(starts) - 1]] + LENGTH).tolist()))


def deduplicated(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with _spans, the removed runs (start, end) of UTF-8 bytes of each row's text; empty if nothing is removed."""
    if "_spans" in docs.columns:
        raise ValueError("there is a column _spans")
    scratch = Scratch(spark, "suffix")
    text = F.coalesce(F.col("text"), F.lit(""))
    name = free("_name", docs)
    named = docs.withColumn(name, F.unhex(F.md5(text)))
    long = named.where(F.octet_length(text) >= LENGTH)
    found, whole = repeats(scratch, long.select(F.col(name).alias("text"), text.cast("binary").alias("data")))
    kind = "array<struct<start:bigint,end:bigint>>"
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_at")
            ends = offsets(lists)
            at, bits = (lists.values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            spans = [[{"start": s, "end": e} for s, e in covered(at[a:b], bits[a:b])] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("text").cast(pa.binary()), pa.array(spans, span)], names=["_name", "_spans"])

    single = found.join(whole, "text", "left_anti").groupBy("text").agg(F.collect_list(F.struct("at", "mask")).alias("_at"))
    single = single.mapInArrow(frugal(merge), f"_name binary, _spans {kind}")
    # An end of -1: all of the text.
    every = whole.select(F.col("text").alias("_name"), F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(-1).cast("long").alias("end"))).cast(kind).alias("_spans"))
    spans = scratch.save(single.union(every), "spans")
    scratch.drop("found")
    end = F.when(F.col("_spans")[0]["end"] == -1, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.octet_length(text).cast("long").alias("end"))).cast(kind))
    return named.join(spans.withColumnRenamed("_name", name), name, "left").withColumn("_spans", F.coalesce(end, "_spans", F.array().cast(kind))).drop(name)


def kept_bytes(data: bytes, spans: list) -> bytes:
    if not len(spans):
        return data
    out, at = [], 0
    for span in spans:
        out.append(data[at : span["start"]])
        at = span["end"]
    return b"".join([*out, data[at:]])


def remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: what is removed of every document, and the digest of the rest."""
    docs = deduplicated(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "_spans"))):
                data = (text or "").encode()
                kept = kept_bytes(data, spans)
                rows.append((doc, len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    return docs.mapInArrow(frugal(digests), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


REMOVE_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
sized AS (SELECT r, doc_id, b, octet_length(b)::BIGINT AS n FROM docs),
strings AS (SELECT r, i, md5(hex(array_slice(b, i, i + 199))) AS h FROM (SELECT r, b, unnest(range(1, n - 198)) AS i FROM sized WHERE n >= 200)),
twice AS (SELECT r, i FROM strings QUALIFY count(*) OVER (PARTITION BY h) > 1),
marked AS (SELECT r, i, CASE WHEN i - lag(i) OVER o <= 200 THEN 0 ELSE 1 END AS new FROM twice WINDOW o AS (PARTITION BY r ORDER BY i)),
runs AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS run FROM marked),
spans AS (SELECT r, min(i) AS s, max(i) + 200 AS e FROM runs GROUP BY r, run),
pieces AS (SELECT r, s, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 1) AS before, e FROM spans),
kept AS (
  SELECT p.r, string_agg(CASE WHEN s > before THEN hex(array_slice(b, before, s - 1)) ELSE '' END, '' ORDER BY s) AS front,
    max(e) AS last, sum(e - s)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans
  FROM pieces p JOIN sized d ON p.r = d.r GROUP BY p.r)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(CASE WHEN k.r IS NULL THEN b ELSE unhex(front || CASE WHEN last <= n THEN hex(array_slice(b, last, n)) ELSE '' END) END) AS kept_sha256
FROM sized d LEFT JOIN kept k ON d.r = k.r
"""
