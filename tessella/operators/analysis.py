"""Per-file analyses: Arrow-batched functions over (path, uri) rows that read each file once, in the task that has its row.

Files of any length stay within memory: what is longer than STREAM_FRAMES is read in blocks. Filter the rows (only WAV,
only missing) before these functions: Spark does not move a filter through them.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import dsp
from tessella.operators import segments
from tessella.sources.audio import local, read_blocks, read_wav, wav_bytes, wav_header

#: Fixed value: the level of a file without samples.
FLOOR_DB = -100.0
LEVELS = "path string, levels array<double>, frame_s double, sample_rate int, duration double, lufs double, peak_db double, error string"


#: Values (of arrays), or bytes, of output rows that are handed on together.
TOGETHER = 1 << 20


def per_file(df: DataFrame, function: Callable[[str, pd.Series], list[tuple]], schema: str) -> DataFrame:
    """``function(path on disk, row)`` gives the output rows of each row of ``df``; those of small files are handed on together."""
    names = [f.strip().split(" ")[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            waiting, size = [], 0
            for row in rows.itertuples(index=False):
                found = function(local(row.uri), row)
                waiting += found
                size += sum(len(v) for r in found for v in r if isinstance(v, (bytes, list, np.ndarray)))
                if size >= TOGETHER:
                    yield pd.DataFrame(waiting, columns=names)
                    waiting, size = [], 0
            if waiting:
                yield pd.DataFrame(waiting, columns=names)

    return df.mapInPandas(run, schema)


def load(path: str) -> tuple[np.ndarray, int]:
    """All samples and the rate; no samples and rate 0 of a file that can't be read. Other formats need ``soundfile``."""
    try:
        with open(path, "rb") as f:
            return read_wav(f)
    except (OSError, ValueError):
        return decoded(path)


def decoded(path: str) -> tuple[np.ndarray, int]:
    try:
        import soundfile

        return soundfile.read(path, dtype="float64", always_2d=True)
    except Exception:  # noqa: BLE001  (no library, or a file that it can't read)
        return np.zeros((0, 1)), 0


#: Frames that are read together.
READ_FRAMES = 1 << 18


def blocks_of(path: str) -> tuple[int, Iterator[tuple[np.ndarray, int]]]:
    """How many frames a file has, and (block, rate) of READ_FRAMES at a time. Other formats than WAV need ``soundfile``."""
    with open(path, "rb") as f:
        if f.read(4) in (b"RIFF", b"RF64"):
            head = wav_header(f)
            return int((head["duration"] or 0) * (head["sample_rate"] or 0)), _wav_blocks(path)
    try:
        import soundfile
    except ImportError:
        raise ValueError("no WAV file, and there is no soundfile") from None
    info = soundfile.info(path)
    return info.frames, ((x, info.samplerate) for x in soundfile.blocks(path, blocksize=READ_FRAMES, dtype="float64", always_2d=True))


def _wav_blocks(path: str) -> Iterator[tuple[np.ndarray, int]]:
    with open(path, "rb") as f:
        yield from read_blocks(f, READ_FRAMES)


def analyse(path: str, loudness: bool = True) -> dict:
    """One read of a file in blocks: levels, loudness (unless it is not wanted) and peak. Without samples all of them are the floor.

    A file of over STREAM_FRAMES frames has its RMS level for a loudness, and keeps its tail frame.
    """
    frames, blocks = blocks_of(path)
    long = frames > dsp.STREAM_FRAMES
    levels, energy, top, total, rest, rate, frame, meter = [], 0.0, 0.0, 0, np.zeros(0), 0, 1, None
    for block, rate in blocks:
        frame, one = max(1, int(rate * dsp.FRAME_S)), dsp.mono(block)
        energy, top, total = energy + float((one**2).sum()), max(top, float(np.abs(block).max(initial=0))), total + len(one)
        if loudness and not long:
            meter = meter or dsp.Loudness(rate, block.shape[1])
            meter.add(block)
        rest = np.concatenate([rest, one])
        whole = len(rest) // frame * frame
        if whole:
            levels.append(dsp.frame_levels(rest[:whole], frame, keep_tail=False))
        rest = rest[whole:]
    if not rate:
        raise ValueError("no samples and no format")
    if not total:
        return {"levels": np.array([FLOOR_DB]), "frame": frame, "rate": rate, "frames": 0, "lufs": FLOOR_DB, "peak_db": FLOOR_DB}
    if len(rest) and (long or not levels):
        levels.append(dsp.frame_levels(rest, frame, keep_tail=True))
    mean = round(float(dsp.db(np.sqrt(energy / total), dsp.LEVEL_EPS)), 2)
    found = meter.result() if meter else None
    return {"levels": np.concatenate(levels), "frame": frame, "rate": rate, "frames": total, "lufs": mean if found is None else found, "peak_db": round(float(dsp.db(max(top, dsp.LEVEL_EPS))), 2)}


def analysed(files: DataFrame, loudness: bool = True) -> DataFrame:
    """Levels, loudness (the RMS level if it is not wanted) and peak of each file; a file that can't be read has an error and nothing else."""

    def one(path, row):
        try:
            a = analyse(path, loudness)
        except (OSError, ValueError, struct.error) as problem:
            return [(row.path, None, None, None, None, None, None, str(problem))]
        return [(row.path, a["levels"], a["frame"] / a["rate"], a["rate"], a["frames"] / a["rate"], a["lufs"], a["peak_db"], None)]

    return per_file(files.select("path", "uri"), one, LEVELS)


def envelope(files: DataFrame) -> DataFrame:
    """Level series for a graph: frames of 20 ms, longer in long files, so that at most 8,000 stand for a file.

    ``peak_db`` is the greatest level that is above the floor.
    """

    def one(path, row):
        x, rate = load(path)
        if not rate:
            return []
        seconds = max(dsp.FRAME_S, len(x) / max(rate, 1) / 8000)
        frame = max(1, int(rate * seconds))
        levels = dsp.frame_levels(dsp.mono(x), frame, keep_tail=True) if len(x) else np.array([FLOOR_DB])
        levels = np.maximum(levels, FLOOR_DB)
        heard = levels[levels > FLOOR_DB + 1]
        return [(row.path, levels, frame / rate, rate, len(x) / rate, round(float(heard.max()), 2) if len(heard) else FLOOR_DB)]

    return per_file(files.select("path", "uri"), one, "path string, levels array<double>, frame_s double, sample_rate int, duration double, peak_db double")


def long_form(levels: DataFrame) -> DataFrame:
    """(path, idx, level, frame_s, peak_db) rows of level arrays."""
    rows = levels.where("levels IS NOT NULL").select("path", "frame_s", "peak_db", F.posexplode("levels").alias("idx", "level"))
    return rows.withColumn("idx", F.col("idx").cast("long"))


def chops(levels: DataFrame, gap_s: float = 1.5, sound_s: float = 0.3) -> DataFrame:
    """(path, silence_db, min_gap_s, min_sound_s, chops, continuous): the suggested threshold of each file, to one decimal, and
    the sounds it gives. A file of at most one sound is continuous: one piece, without parameters."""
    rows = long_form(levels).withColumn("level", F.greatest("level", F.lit(FLOOR_DB)))
    suggested = segments.suggest_threshold(rows, ["path"]).withColumn("threshold", F.bround("threshold", 1))
    every = rows.join(suggested, "path")
    found = segments.gap_segments(every, ["path"], F.col("threshold"), segments.frames_of(F.lit(gap_s), F.col("frame_s")), F.lit(sound_s) / F.col("frame_s"))
    number = suggested.join(found.groupBy("path").agg(F.count("*").alias("_n")), "path", "left")
    several = F.coalesce("_n", F.lit(0)) > 1
    values = {"silence_db": F.col("threshold"), "min_gap_s": F.lit(gap_s), "min_sound_s": F.lit(sound_s)}
    return number.select("path", *(F.when(several, x).alias(c) for c, x in values.items()), F.when(several, F.col("_n")).otherwise(1).cast("int").alias("chops"), (~several).alias("continuous"))


def fingerprints(files: DataFrame) -> DataFrame:
    """(path, vector, model): 48 acoustic features."""

    def one(path, row):
        x, rate = load(path)
        return [(row.path, dsp.fingerprint(x, rate).tolist(), "features48")] if len(x) else []

    return per_file(files.select("path", "uri"), one, "path string, vector array<float>, model string")


def loops(files: DataFrame, min_s: float = 0.0) -> DataFrame:
    """A loop suggestion for each file."""
    fields = "start_s double, end_s double, min_s double, short boolean, crossfade_ms double, periodic boolean, period_ms double, strength double, duration double"

    def one(path, row):
        x, rate = load(path)
        return [(row.path, *dsp.suggest_loop(x, rate, min_s).values())] if len(x) else []

    return per_file(files.select("path", "uri"), one, f"path string, {fields}")


def numbered(path: str, suffix: str) -> str:
    stem, dot, _ = path.rpartition(".")
    return f"{stem if dot else path}{suffix}"


def chop_files(files: DataFrame) -> DataFrame:
    """(parent, uri, content) of 16-bit pieces; ``files`` has segments, an array of (start, end) in seconds. Empty ones get no number."""

    def one(path, row):
        x, rate = load(path)
        parts = dsp.pieces(x, rate, [(s["start"], s["end"]) for s in row.segments])
        return [(row.path, numbered(row.uri, f"_chop{k:02d}.wav"), wav_bytes(p, rate)) for k, p in enumerate(parts, 1)]

    return per_file(files.select("path", "uri", "segments"), one, "parent string, uri string, content binary")


def loop_files(files: DataFrame, whole: bool = False) -> DataFrame:
    """(parent, uri, content) of 16-bit loops; ``files`` has start_s, end_s, crossfade_ms and curve. ``whole`` as in ``preview_clips``."""

    def one(path, row):
        x, rate = load(path)
        found = dsp.loops(x, rate, [(row.start_s, row.end_s)], round(row.crossfade_ms / 1000 * rate), row.curve, whole)
        return [(row.path, numbered(row.uri, "_loop.wav"), wav_bytes(y, rate)) for y in found]

    return per_file(files.select("path", "uri", "start_s", "end_s", "crossfade_ms", "curve"), one, "parent string, uri string, content binary")


def preview_clips(files: DataFrame, whole: bool = False) -> DataFrame:
    """(path, rate, channels, frames, content): 16-bit samples to listen to; ``files`` has segments and crossfade_ms (null: no loop).

    ``whole``: loops have the length of their region also in files that end before it (``dsp.loops``)."""

    def one(path, row):
        x, rate = load(path)
        if not len(x):
            return []
        fade = None if pd.isna(row.crossfade_ms) else float(row.crossfade_ms)
        clip = dsp.preview_clip(x, rate, [(s["start"], s["end"]) for s in row.segments], fade, whole=whole)
        return [(row.path, rate, x.shape[1], len(clip), clip.astype("<i2").tobytes())]

    return per_file(files.select("path", "uri", "segments", "crossfade_ms"), one, "path string, rate int, channels int, frames int, content binary")


def copies_16_bit(files: DataFrame) -> DataFrame:
    """(parent, uri, content) of 16-bit copies, without those that exist."""
    import os

    def one(path, row):
        target = numbered(row.uri, "_16bit.wav")
        if os.path.exists(local(target)):
            return []
        x, rate = load(path)
        return [(row.path, target, wav_bytes(dsp.normal_peak(x), rate))] if len(x) else []

    return per_file(files.select("path", "uri"), one, "parent string, uri string, content binary")


def wav_copies(files: DataFrame) -> DataFrame:
    """(parent, uri, content) of 16-bit WAV files decoded from other formats; needs ``soundfile``, and fails on what it can't read."""

    def one(path, row):
        import soundfile

        x, rate = soundfile.read(path, dtype="float64", always_2d=True)
        return [(row.path, numbered(row.uri, ".wav"), wav_bytes(dsp.normal_peak(x), rate))]

    return per_file(files.select("path", "uri"), one, "parent string, uri string, content binary")


class HashingEmbedder:
    """A deterministic stand-in where no text model is at hand: hashed words. It is not equivalent to a learned model."""

    name, size = "hashing-not-a-model", 256

    def embed(self, texts: list[str]) -> np.ndarray:
        import re
        import zlib

        out = np.zeros((len(texts), self.size), np.float32)
        for row, text in zip(out, texts):
            for word in re.findall("[a-z0-9]+", text.lower()):
                code = zlib.crc32(word.encode())
                row[code % self.size] += 1 if code & 1 << 20 else -1
        return out / (np.linalg.norm(out, axis=1, keepdims=True) + 1e-9)

    query_embed = embed


@lru_cache(maxsize=2)
def _session(model: str, threads: int):
    """A model's session, opened once by each worker process."""
    import onnxruntime

    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = threads
    return onnxruntime.InferenceSession(model, options, providers=["CPUExecutionProvider"])


class OnnxEmbedder:
    """An audio or text tower as an ONNX file: batches of 32, unit vectors."""

    def __init__(self, model: str, prepare: Callable, name: str, threads: int = 8):
        self.model, self.prepare, self.name, self.threads = model, prepare, name, threads

    def embed(self, inputs: list) -> np.ndarray:
        session = _session(self.model, self.threads)
        out = np.vstack([session.run(None, self.prepare(inputs[k : k + 32]))[0] for k in range(0, len(inputs), 32)])
        return out / (np.linalg.norm(out, axis=1, keepdims=True) + 1e-9)

    query_embed = embed


def audio_tower(model: str) -> OnnxEmbedder:
    """The audio side of an audio-text model, over log-mel inputs."""
    return OnnxEmbedder(model, lambda mels: {"input_features": np.concatenate(mels).astype(np.float32)}, "audio-text")


def text_tower(model: str, tokenizer: str, length: int = 77) -> OnnxEmbedder:
    """The text side of an audio-text model: texts become padded token ids with a mask."""
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(tokenizer)
    encoder.enable_truncation(length)
    encoder.enable_padding()

    def prepare(texts: list[str]) -> dict[str, np.ndarray]:
        found = encoder.encode_batch(texts)
        return {"input_ids": np.array([e.ids for e in found], np.int64), "attention_mask": np.array([e.attention_mask for e in found], np.int64)}

    return OnnxEmbedder(model, prepare, "audio-text")


def text_vectors(texts: DataFrame, embedder) -> DataFrame:
    """(path, vector, model) of (path, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"path": rows["path"], "vector": embedder.embed(rows["text"].fillna("").tolist()).tolist(), "model": embedder.name})

    return texts.select("path", "text").mapInPandas(run, "path string, vector array<float>, model string")


def audio_vectors(files: DataFrame, embedder, settings: dict) -> DataFrame:
    """(path, vector, model) of audio files through a model's mel input."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), 32):
                some = rows.iloc[at : at + 32]
                sounds = [load(local(uri)) for uri in some["uri"]]
                some, mels = some[[bool(len(x)) for x, _ in sounds]], [dsp.model_mel(x, r, settings) for x, r in sounds if len(x)]
                if not mels:
                    continue
                yield pd.DataFrame({"path": some["path"], "vector": embedder.embed(mels).tolist(), "model": embedder.name})

    return files.select("path", "uri").mapInPandas(run, "path string, vector array<float>, model string")
