"""Scalar functions over catalog columns; each takes and returns Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bounds of the gain scale in dB, and the level of a sound at level 10.
GAIN_MIN, GAIN_MAX, TOP_LEVEL_DB, SILENT_DB = -80.0, 24.0, -10.0, -120.0
#: Bounds of the chop parameters (threshold in dB, gap and sound in seconds).
CHOP_DB, CHOP_SECONDS = (-90.0, 0.0), (0.0, 10.0)


def to_column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounding by floor(x * 10^k + 0.5), the same in every engine that has IEEE doubles."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def clamp(x: Column, low: float, high: float) -> Column:
    """``x`` within low..high; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def clean_text(x: Column) -> Column:
    """Control characters become spaces; the ends are trimmed."""
    return F.trim(F.regexp_replace(x, r"[\x00-\x1f]", " "))


def norm_header(x: Column) -> Column:
    """A header cell for comparison: trimmed, upper case, null as empty."""
    return F.upper(F.trim(F.coalesce(x, F.lit(""))))


def tokenize(x: Column) -> Column:
    """Runs of ASCII letters and digits of the lower-cased text; anything else, accents too, splits words."""
    return F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def natural_key(x: Column) -> Column:
    """A sort key for case-insensitive natural order: digit runs compare as numbers of any length.

    A run is written without its leading zeros behind the number of its digits, in ten places.
    """
    runs = F.regexp_extract_all(F.lower(x), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    digits = lambda t: F.ltrim(t, F.lit("0"))
    return F.array_join(F.transform(runs, lambda t: F.when(t.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits(t)).cast("string"), 10, "0"), digits(t))).otherwise(t)), "")


def stem(filename: Column) -> Column:
    """A file name without its last extension."""
    return F.regexp_replace(filename, r"\.[^.]*$", "")


def extension(path: Column) -> Column:
    """The lower-case extension without its dot, or an empty text."""
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def sibling_path(path: Column, suffix: str) -> Column:
    """The path with its last extension replaced by ``suffix``."""
    return F.concat(stem(path), F.lit(suffix))


def directory(root: str, path: Column) -> Column:
    """The absolute directory of a file under ``root``."""
    return F.regexp_replace(F.concat_ws("/", F.lit(root), path), r"/[^/]*$", "")


def has_invalid_name(filename: Column) -> Column:
    """Whether a file name holds characters that common file systems forbid."""
    return filename.rlike(r'[\x00-\x1f<>:"/\\|?*]')


def valid_name(name: Column) -> Column:
    """A name with forbidden characters as spaces, white space collapsed; "renamed" if nothing is left."""
    text = F.trim(F.regexp_replace(F.regexp_replace(name, r'[\x00-\x1f<>:"/\\|?*]', " "), r"\s+", " "))
    return F.when(text == "", F.lit("renamed")).otherwise(text)


def short_bundle(bundle: Column) -> Column:
    """A bundle's short title from its first four digits."""
    digits = F.regexp_replace(F.coalesce(bundle, F.lit("")), "[^0-9]", "")
    return F.when(F.length(digits) >= 4, F.concat(F.lit("GDC "), F.substring(digits, 1, 4))).otherwise(F.lit("GDC (orig)"))


def format_time(seconds: Column, milliseconds: bool = True) -> Column:
    """``m:ss.mmm`` or ``m:ss`` with a sign if negative; null as an empty text."""
    sign = F.when(seconds < 0, F.lit("-")).otherwise(F.lit(""))
    if milliseconds:
        total = F.floor(F.abs(seconds) * 1000 + 0.5).cast("long")
        text = F.format_string("%d:%02d.%03d", F.floor(total / 60000), F.floor(total / 1000) % 60, total % 1000)
    else:
        total = F.floor(F.abs(seconds)).cast("long")
        text = F.format_string("%d:%02d", F.floor(total / 60), total % 60)
    return F.when(seconds.isNull(), F.lit("")).otherwise(F.concat(sign, text))


def _fixed(x: Column, digits: int) -> Column:
    """A non-negative number with so many decimals, by integer arithmetic."""
    scale = 10**digits
    units = F.floor(x * scale + 0.5).cast("long")
    return F.format_string(f"%d.%0{digits}d", F.floor(units / scale), units % scale) if digits else F.format_string("%d", units)


def format_rate(hertz: Column) -> Column:
    """A sample rate in kHz, with one decimal if it is not whole; null as an empty text."""
    text = F.when(hertz % 1000 == 0, F.concat(_fixed(hertz / 1000.0, 0), F.lit(" kHz"))).otherwise(F.concat(_fixed(hertz / 1000.0, 1), F.lit(" kHz")))
    return F.when(hertz.isNull(), F.lit("")).otherwise(text)


def format_size(n_bytes: Column) -> Column:
    """Megabytes with one decimal from 1 MiB on, else whole kilobytes; null as an empty text."""
    mega = F.lit(1048576.0)
    text = F.when(n_bytes >= mega, F.concat(_fixed(n_bytes / mega, 1), F.lit(" MB"))).otherwise(F.concat(_fixed(n_bytes / F.lit(1024.0), 0), F.lit(" KB")))
    return F.when(n_bytes.isNull(), F.lit("")).otherwise(text)


def format_number(x: Column) -> Column:
    """A count with k and M units."""
    sign = F.when(x < 0, F.lit("-")).otherwise(F.lit(""))
    size = F.abs(x)
    text = F.when(size >= 1e6, F.concat(_fixed(size / 1e6, 1), F.lit("M"))).when(size >= 1e3, F.concat(_fixed(size / 1e3, 1), F.lit("k"))).otherwise(_fixed(size, 0))
    return F.when(x.isNull(), F.lit("")).otherwise(F.concat(sign, text))


def format_column(x: Column, unit: str) -> Column:
    """A value by its column's unit: time, rate, size, db or number."""
    by_unit = {"time": format_time, "rate": format_rate, "size": format_size, "db": format_gain, "number": format_number}
    return by_unit[unit](x)


def stars(rating: Column) -> Column:
    """A rating as that many stars; 0 and null as an empty text."""
    return F.when(rating > 0, F.repeat(F.lit("★"), rating.cast("int"))).otherwise(F.lit(""))


def format_gain(gain: Column) -> Column:
    """A signed gain to one decimal; 0 and null as an empty text."""
    tenth = F.floor(F.abs(gain) * 10 + 0.5).cast("long")
    text = F.concat(F.when(gain < 0, F.lit("-")).otherwise(F.lit("+")), F.format_string("%d.%d", F.floor(tenth / 10), tenth % 10))
    return F.when(gain.isNull() | (tenth == 0), F.lit("")).otherwise(text)


def format_level(level: Column) -> Column:
    """A level to one decimal; 0 and null as an empty text."""
    return F.when(level.isNull() | (level <= 0), F.lit("")).otherwise(_fixed(level, 1))


def level_to_db(level: Column) -> Column:
    """A perceptual level (0..10; twice the level is 10 dB more) in dBFS."""
    return F.when(level <= 0, F.lit(SILENT_DB)).otherwise(TOP_LEVEL_DB + 10.0 * F.log2(level / 10.0))


def db_to_level(db: Column) -> Column:
    """The inverse of ``level_to_db``, within 0..10."""
    return clamp(10.0 * F.pow(F.lit(2.0), (db - TOP_LEVEL_DB) / 10.0), 0.0, 10.0)


def gain_db(gain: Column, vol_mult: Column) -> Column:
    """The gain in use: the stored one, else that of an older volume factor, else 0."""
    old = F.when(vol_mult > 0, 20.0 * F.log10(vol_mult)).otherwise(F.lit(0.0))
    return F.coalesce(clamp(gain, GAIN_MIN, GAIN_MAX), old)


def target_gain(level: Column, lufs: Column, peak_db: Column) -> Column:
    """struct(gain, capped): what brings a sound to its level without clipping, to 0.1 dB; null if anything is missing."""
    wanted, room = level_to_db(level) - lufs, -peak_db
    gain = half_up(clamp(F.least(wanted, room), GAIN_MIN, GAIN_MAX), 1)
    known = level.isNotNull() & lufs.isNotNull() & peak_db.isNotNull()
    return F.when(known, F.struct(gain.alias("gain"), (wanted > room).alias("capped")))


def final_db(lufs: Column, gain: Column) -> Column:
    """Loudness after gain; null without a measured loudness."""
    return lufs + F.coalesce(gain, F.lit(0.0))


def playback_db(volume: Column, gain: Column) -> Column:
    """Playback volume in dB: a factor of at most 0.001 is silent (-80 dB), plus the gain."""
    return F.when(volume <= 0.001, F.lit(-80.0)).otherwise(20.0 * F.log10(volume)) + F.coalesce(gain, F.lit(0.0))


def height(db: Column, floor_db: float = -90.0) -> Column:
    """A level's perceptual height in a graph, 0 at the floor and 1 at 0 dB."""
    least = 2.0 ** (floor_db / 10.0)
    return clamp((F.pow(F.lit(2.0), db / 10.0) - least) / (1.0 - least), 0.0, 1.0)


def height_to_db(h: Column, floor_db: float = -90.0) -> Column:
    """The inverse of ``height``."""
    least = 2.0 ** (floor_db / 10.0)
    return F.greatest(F.lit(floor_db), 10.0 * F.log2(clamp(h, 0.0, 1.0) * (1.0 - least) + least))


def slider_value(fraction: Column, low: float, high: float) -> Column:
    """A slider's value: logarithmic where the range spans over two decades, else linear."""
    if low > 0 and high / low > 100:
        return F.exp(F.lit(float(low)) * 0 + F.log(F.lit(float(low))) + fraction * (F.log(F.lit(float(high))) - F.log(F.lit(float(low)))))
    return low + fraction * (high - low)


def slider_fraction(value: Column, low: float, high: float) -> Column:
    """The inverse of ``slider_value``."""
    if low > 0 and high / low > 100:
        return (F.log(value) - F.log(F.lit(float(low)))) / (F.log(F.lit(float(high))) - F.log(F.lit(float(low))))
    return (value - low) / (high - low)


def parse_number(text: Column, fallback: Column | float | None = None) -> Column:
    """A number from a text, or the fallback."""
    value = F.trim(text).try_cast("double")
    return F.coalesce(value, fallback if isinstance(fallback, Column) else F.lit(fallback).cast("double"))


def chop_edit(value: Column, field: str) -> Column:
    """A chop parameter within its bounds."""
    return clamp(value, *(CHOP_DB if field == "silence_db" else CHOP_SECONDS))


def to_sample(seconds: Column, rate: Column, n: Column) -> Column:
    """Seconds as a sample index within 0..n, rounded half to even."""
    return F.least(F.greatest(F.bround(seconds * rate).cast("long"), F.lit(0).cast("long")), n.cast("long"))


def is_playable(ext: Column, channels: Column) -> Column:
    """mp3, or wav with at most two channels (an unknown number counts as none)."""
    return (ext == "mp3") | ((ext == "wav") & (F.coalesce(channels, F.lit(0)) <= 2))


def folder_fallback(path: Column) -> Column:
    """struct(bundle, library, supplier) from a relative path.

    The first part is the bundle; the second, without underscores at its end, is "supplier - library" or a library. A
    file directly in a bundle gives its own name as the library, one at the root its own name as the bundle.
    """
    parts = F.split(path, "/")
    second = F.trim(F.rtrim(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), F.lit("_")))
    cut = F.split(second, " - ", 2)
    has = F.size(cut) > 1
    return F.struct(
        F.get(parts, F.lit(0)).alias("bundle"),
        F.when(has, F.trim(F.get(cut, F.lit(1)))).otherwise(second).alias("library"),
        F.when(has, F.trim(F.get(cut, F.lit(0)))).otherwise(F.lit("")).alias("supplier"),
    )


def doc_text(filename: Column, description: Column, library: Column, supplier: Column) -> Column:
    """What is embedded of a record: the stem as words, description, library and supplier, without the empty ones."""
    name = F.trim(F.translate(stem(filename), "_-", "  "))
    return F.concat_ws(" ", *(F.nullif(F.trim(x), F.lit("")) for x in (name, description, library, supplier)))


def unit(v: Column) -> Column:
    """A vector over its length plus 1e-9, in doubles."""
    d = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x)) + 1e-9
    return F.transform(d, lambda x: x / norm)


def dot(a: Column, b: Column) -> Column:
    """The inner product of two vectors, in doubles."""
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def rms_db(mean_square: Column, eps: float = 1e-9) -> Column:
    """The level in dB of a mean square."""
    return 20.0 * F.log10(F.sqrt(mean_square) + eps)


def peak_db(peak: Column) -> Column:
    """The level in dB of a peak, at least that of 1e-12."""
    return 20.0 * F.log10(F.greatest(peak, F.lit(1e-12)))


def power_to_db(power: Column, least: float = 1e-10) -> Column:
    """Decibels of a power, clipped from below."""
    return 10.0 * F.log10(F.greatest(power, F.lit(least)))


def adaptive_frame_s(duration: Column, frame_s: float = 0.02, frames: int = 8000) -> Column:
    """A frame length that keeps an envelope within ``frames`` frames."""
    return F.greatest(F.lit(frame_s), duration / frames)


def is_short(duration: Column, least: float) -> Column:
    """Known and shorter than ``least`` seconds; an unknown or zero duration is not short."""
    return F.coalesce((duration > 0) & (duration < least), F.lit(False))


def crossfade_fraction(xfade_ms: Column, region_s: Column, duration_s: Column) -> Column:
    """The share of a file that a crossfade of its loop region covers."""
    return F.least(xfade_ms / 1000.0, region_s / 2.0) / duration_s


def hz_to_mel(f: Column, scale: str = "htk") -> Column:
    """Hertz to mel on the htk, kaldi or slaney scale."""
    if scale == "htk":
        return 2595.0 * F.log10(1.0 + f / 700.0)
    if scale == "kaldi":
        return 1127.0 * F.log(1.0 + f / 700.0)
    step = 27.0 / F.log(F.lit(6.4))
    return F.when(f >= 1000.0, 15.0 + F.log(f / 1000.0) * step).otherwise(3.0 * f / 200.0)


def json_number(text: Column, path: str) -> Column:
    """A number of a JSON text; null where the text or the value is none."""
    return F.get_json_object(text, path).try_cast("double")


def is_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()
