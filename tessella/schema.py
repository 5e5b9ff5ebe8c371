"""Schemas of the catalog's tables, and read-time migrations of older records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CATALOG = "path string, filename string, bundle string, library string, supplier string, url string, ext string, size long, mtime long, duration double, sample_rate int, bit_depth int, channels int, description string"
TRACKLIST = "file_seq int, row_seq int, filename string, library string, supplier string, url string"
USERDATA = "path string, rating int, plays int, tags string, level double, gain_db double, target_db double, vol_mult double"
CHOPPING = "path string, silence_db double, min_gap_s double, min_sound_s double, chops int, continuous boolean, size long"
LOUDNESS = "path string, lufs double, rms_db double, peak_db double, size long"
VECTORS = "path string, vector array<float>, model string"
EDITS = "seq long, path string, field string, value string"
SEGMENT = "array<struct<start:bigint,end:bigint>>"

#: The audio extensions that a scan takes.
AUDIO_EXTENSIONS = ("wav", "aif", "aiff", "flac", "mp3", "ogg", "m4a")
#: Default chop parameters (threshold in dB, gap and sound in seconds).
CHOP_DEFAULTS = {"silence_db": -60.0, "min_gap_s": 1.5, "min_sound_s": 0.3}


def finite(x: Column) -> Column:
    """NaN stands for a missing number in older files: null."""
    return F.when(~F.isnan(x), x)


def migrate_userdata(df: DataFrame) -> DataFrame:
    """``target_db`` was the old name of ``level``, ``vol_mult`` a factor in place of ``gain_db``."""
    from tessella.functions.columns import gain_db

    old = F.when(F.col("gain_db").isNotNull() | (F.col("vol_mult") > 0), gain_db(finite(F.col("gain_db")), finite(F.col("vol_mult"))))
    return df.withColumns({"level": F.coalesce(finite(F.col("level")), finite(F.col("target_db"))), "gain_db": old}).drop("target_db", "vol_mult")


def migrate_loudness(df: DataFrame) -> DataFrame:
    """``rms_db`` was the old name of ``lufs``."""
    return df.withColumn("lufs", F.coalesce(finite(F.col("lufs")), finite(F.col("rms_db")))).drop("rms_db")
