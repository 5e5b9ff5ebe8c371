"""Scanning folders and reading audio headers and samples; headers are read without their payload."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import columns as C
from tessella.schema import AUDIO_EXTENSIONS

#: RIFF format codes (PCM, IEEE float, extensible) and the length of a broadcast description.
PCM, FLOAT, EXTENSIBLE, DESCRIPTION = 1, 3, 0xFFFE, 256
HEADER = "duration double, sample_rate int, bit_depth int, channels int, description string"
UNKNOWN = {"duration": None, "sample_rate": None, "bit_depth": None, "channels": None, "description": ""}
#: Bit depths of libsndfile's subtypes.
SUBTYPES = {"PCM_U8": 8, "PCM_S8": 8, "PCM_16": 16, "PCM_24": 24, "PCM_32": 32, "FLOAT": 32, "DOUBLE": 64}

#: How many of Spark's shares of small files one task takes at most.
TOGETHER = 16


def scan(spark: SparkSession, root: str) -> DataFrame:
    """path (relative to root), filename, ext, size, mtime of every audio file; no content is read.

    Spark deals small files to tasks by some 32; as starting a task costs more than that many of them, up to TOGETHER
    such shares are one task's where there are enough for all cores.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    shares = files.rdd.getNumPartitions()
    files = files.coalesce(max(4 * spark.sparkContext.defaultParallelism, shares // TOGETHER, 1))
    base = urlparse(root).path.rstrip("/") + "/"
    plain = F.regexp_replace("path", r"^[a-z0-9]+:(//[^/]*)?/*", "/")
    relative = F.expr(f"substring_index({{0}}, '{base}', -1)".replace("{0}", "_p"))
    named = files.withColumn("_p", plain).withColumn("_r", relative)
    out = named.select(F.col("path").alias("uri"), F.col("_r").alias("path"), F.element_at(F.split("_r", "/"), -1).alias("filename"), C.extension(F.col("_r")).alias("ext"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"))
    return out.where(F.col("ext").isin(*AUDIO_EXTENSIONS))


def riff_chunks(f, size: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, offset, length) of each chunk; chunks start at even places."""
    at = 12
    while at + 8 <= size:
        f.seek(at)
        head = f.read(8)
        if len(head) < 8:
            return
        name, length = head[:4], struct.unpack("<I", head[4:])[0]
        yield name, at + 8, length
        at += 8 + length + (length & 1)


def wav_header(f) -> dict:
    """Duration, rate, depth, channels and broadcast description of a WAV file; the payload is skipped."""
    f.seek(0, io.SEEK_END)
    size = f.tell()
    f.seek(0)
    out, rate, data = dict(UNKNOWN), 0, None
    start = f.read(12)
    if len(start) < 12 or start[:4] not in (b"RIFF", b"RF64") or start[8:] != b"WAVE":
        return out
    for name, at, length in riff_chunks(f, size):
        f.seek(at)
        if name == b"fmt " and min(length, size - at) >= 16:
            _, out["channels"], out["sample_rate"], rate, _, out["bit_depth"] = struct.unpack("<HHIIHH", f.read(16))
        elif name == b"data":
            data = min(length, size - at)
        elif name == b"bext":
            text = f.read(min(DESCRIPTION, length)).split(b"\0")[0].decode("ascii", "ignore")
            out["description"] = "".join(" " if c < " " else c for c in text).strip()
    if data is not None and rate:
        out["duration"] = round(data / rate, 3)
    return out


def other_header(path: str) -> dict:
    """The header of other formats, where libsndfile is installed; unknown if anything fails."""
    try:
        import soundfile

        info = soundfile.info(path)
        return {"duration": round(info.duration, 3), "sample_rate": info.samplerate, "bit_depth": SUBTYPES.get(info.subtype), "channels": info.channels, "description": ""}
    except Exception:  # noqa: BLE001  (no library, or a file that it can't read: all unknown)
        return dict(UNKNOWN)


class NotMounted(RuntimeError):
    """A file in a store that tasks can't open by path."""


def local(uri: str) -> str:
    """The path of a file that every machine mounts."""
    at = urlparse(uri)
    if at.scheme not in ("", "file"):
        raise NotMounted(f"{uri}: only files of a mounted folder can be opened; use with_headers_of_content")
    return unquote(at.path) if at.scheme else uri


def header(uri: str) -> dict:
    path = local(uri)
    try:
        if path.lower().endswith(".wav"):
            with open(path, "rb") as f:
                return wav_header(f)
        return other_header(path)
    except (OSError, struct.error):
        return dict(UNKNOWN)


def with_headers(files: DataFrame) -> DataFrame:
    """Files (uri, ...) with their header columns, read where the tasks run, from a file system that all of them mount."""
    from pyspark.sql import types as T

    schema = T.StructType([*files.schema.fields, *T._parse_datatype_string(HEADER).fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = pd.DataFrame([header(u) for u in rows["uri"]], columns=list(UNKNOWN), dtype=object)
            yield pd.concat([rows.reset_index(drop=True), found], axis=1)

    return files.mapInPandas(run, schema)


def with_headers_of_content(spark: SparkSession, root: str) -> DataFrame:
    """(uri, header columns) of WAV files in any store that Spark reads; the content passes through, so prefer ``with_headers``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[wW][aA][vV]").load(root)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame([{"uri": u, **wav_header(io.BytesIO(c))} for u, c in zip(rows["path"], rows["content"])], columns=["uri", *UNKNOWN], dtype=object)

    return files.select("path", "content").mapInPandas(run, f"uri string, {HEADER}")


def samples(raw: bytes, code: int, bits: int, channels: int) -> np.ndarray:
    """(frames, channels) doubles within -1..1 of WAV payload bytes."""
    width = bits // 8
    raw = raw[: len(raw) // (width * channels) * width * channels]
    if code == FLOAT:
        flat = np.frombuffer(raw, "<f4" if bits == 32 else "<f8").astype(float)
    elif bits == 8:
        flat = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    elif bits == 24:
        three = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        flat = ((three[:, 0] << 8 | three[:, 1] << 16 | three[:, 2] << 24) >> 8) / 8388608.0
    else:
        flat = np.frombuffer(raw, f"<i{width}").astype(float) / 2 ** (bits - 1)
    return flat.reshape(-1, channels)


def read_blocks(f, frames: int) -> Iterator[tuple[np.ndarray, int]]:
    """(block, rate) of a WAV file, ``frames`` frames at a time: memory stays bounded."""
    f.seek(0, io.SEEK_END)
    size = f.tell()
    form, data = None, None
    for name, at, length in riff_chunks(f, size):
        f.seek(at)
        if name == b"fmt ":
            code, channels, rate, _, align, bits = struct.unpack("<HHIIHH", f.read(16))
            if code == EXTENSIBLE and length >= 26:
                f.seek(at + 24)
                code = struct.unpack("<H", f.read(2))[0]
            form = code, bits, channels, rate, align
        elif name == b"data":
            data = at, min(length, size - at)
    if form is None or data is None:
        raise ValueError("no fmt or data chunk")
    code, bits, channels, rate, align = form
    at, left = data
    if left < align:
        yield np.zeros((0, channels)), rate
    while left > 0:
        f.seek(at)
        raw = f.read(min(left, frames * align))
        if len(raw) < align:
            return
        yield samples(raw, code, bits, channels), rate
        at, left = at + len(raw), left - len(raw)


def read_wav(f) -> tuple[np.ndarray, int]:
    """All samples and the rate."""
    blocks = list(read_blocks(f, 1 << 20))
    return (np.concatenate([b for b, _ in blocks]), blocks[0][1]) if blocks else (np.zeros((0, 1)), 0)


def wav_bytes(x: np.ndarray, rate: int, bits: int = 16) -> bytes:
    """A PCM WAV file of (frames, channels) doubles, clipped to -1..1; 16 bits by default, 24 for tests and masters."""
    x = np.asarray(x, float)
    x = x[:, None] if x.ndim == 1 else x
    scale = 2 ** (bits - 1)
    whole = np.clip(np.rint(x * scale), -scale, scale - 1).astype(np.int32)
    raw = whole.astype("<i2").tobytes() if bits == 16 else whole.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    align = x.shape[1] * bits // 8
    form = struct.pack("<HHIIHH", PCM, x.shape[1], rate, rate * align, align, bits)
    return b"RIFF" + struct.pack("<I", 36 + len(raw)) + b"WAVEfmt " + struct.pack("<I", 16) + form + b"data" + struct.pack("<I", len(raw)) + raw


def write_wavs(files: DataFrame) -> DataFrame:
    """Write (uri, content) rows where the tasks run, and return (uri, size) of each. A file appears whole or not at all."""
    import os

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for uri, content in zip(rows["uri"], rows["content"]):
                path = local(uri)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(f"{path}.{os.getpid()}.tmp", "wb") as f:
                    f.write(content)
                os.replace(f"{path}.{os.getpid()}.tmp", path)
            yield pd.DataFrame({"uri": rows["uri"], "size": [len(c) for c in rows["content"]]})

    return files.select("uri", "content").mapInPandas(run, "uri string, size long")


def rename_files(moves: DataFrame) -> DataFrame:
    """Rename (old_uri, new_uri) where the tasks run, and return the rows of ``moves`` that were: a file that is gone, or
    whose new name has come into use since, stays as it is."""
    import os

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            done = []
            for old, new in zip(rows["old_uri"], rows["new_uri"]):
                old, new = local(old), local(new)
                # A task that runs again finds what it did the first time.
                again = os.path.exists(new) and not os.path.exists(old)
                free = os.path.exists(old) and not os.path.exists(new)
                if free:
                    os.makedirs(os.path.dirname(new), exist_ok=True)
                    os.rename(old, new)
                done.append(free or again)
            yield rows[done]

    return moves.mapInPandas(run, moves.schema)
