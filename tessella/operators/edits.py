"""Edits as a log: (seq, path, field, value); the present value is the latest, folded with a grouped maximum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import columns as C
from tessella.schema import CHOP_DEFAULTS

TEXT_FIELDS, NUMBER_FIELDS = ("tags", "description"), ("rating", "gain_db", "level", "silence_db", "min_gap_s", "min_sound_s")


def validated(edits: DataFrame) -> DataFrame:
    """Edits with clean values: texts trimmed, numbers within their bounds; a blank gain is 0, a blank level clears it.

    Edits of a number that are no number are rejected.
    """
    text, field = F.trim(F.coalesce("value", F.lit(""))), F.col("field")
    number = text.try_cast("double")
    bounded = (
        F.when(field == "gain_db", C.clamp(number, C.GAIN_MIN, C.GAIN_MAX))
        .when(field == "level", C.clamp(number, 0.0, 10.0))
        .when(field == "rating", C.clamp(number, 0.0, 5.0))
        .when(field == "silence_db", C.clamp(number, *C.CHOP_DB))
        .otherwise(C.clamp(number, *C.CHOP_SECONDS))
    )
    value = F.when(field.isin(*TEXT_FIELDS), text).when((text == "") & (field == "gain_db"), F.lit("0.0")).when((text == "") & (field == "level"), F.lit(None)).otherwise(bounded.cast("string"))
    rejected = field.isin(*NUMBER_FIELDS) & (text != "") & number.isNull()
    blank = field.isin("rating", "silence_db", "min_gap_s", "min_sound_s") & (text == "")
    return edits.where(~rejected & ~blank).withColumn("value", value)


def folded(edits: DataFrame) -> DataFrame:
    """(path, field, value): the latest edit of each field."""
    return edits.groupBy("path", "field").agg(F.max_by("value", "seq").alias("value"))


def wide(edits: DataFrame, fields: list[str]) -> DataFrame:
    """(path, fields...): the latest value of each field, in one pre-aggregated pass; null if never set."""
    latest = [F.max(F.when(F.col("field") == f, F.struct("seq", "value"))).getField("value").alias(f) for f in fields]
    return edits.groupBy("path").agg(*latest)


def play_counts(events: DataFrame, user: str = "path") -> DataFrame:
    """Plays that ended by themselves."""
    return events.where("finished").groupBy(user).agg(F.count("*").alias("plays"))


def level_edit(userdata: DataFrame, loudness: DataFrame, edits: DataFrame) -> DataFrame:
    """User data after edits (path, level): a set level brings its gain, a cleared one leaves the gain as it is."""
    joined = userdata.join(edits.select("path", F.col("level").alias("_level"), F.lit(True).alias("_edited")), "path", "full").join(loudness.select("path", "lufs", "peak_db"), "path", "left")
    level = F.when(F.col("_edited"), F.col("_level")).otherwise(F.col("level"))
    target = C.target_gain(F.col("_level"), F.col("lufs"), F.col("peak_db"))
    gain = F.when(F.col("_edited") & target.isNotNull(), target["gain"]).otherwise(F.col("gain_db"))
    return joined.withColumns({"_new_level": level, "_new_gain": gain}).select("path", *(F.col("_new_level").alias("level") if c == "level" else F.col("_new_gain").alias("gain_db") if c == "gain_db" else F.col(c) for c in userdata.columns if c != "path"))


def recomputed_gains(userdata: DataFrame, loudness: DataFrame) -> DataFrame:
    """All gains that follow from a level, with ``updated``. The whole table is gone through, not only what a view shows."""
    joined = userdata.join(loudness.select("path", "lufs", "peak_db"), "path", "left")
    target = C.target_gain(F.col("level"), F.col("lufs"), F.col("peak_db"))
    known = target.isNotNull()
    return joined.withColumns({"updated": known & ~target["gain"].eqNullSafe(F.col("gain_db")), "gain_db": F.when(known, target["gain"]).otherwise(F.col("gain_db"))}).drop("lufs", "peak_db")


def chop_edit(chopping: DataFrame, edits: DataFrame) -> DataFrame:
    """Chop parameters after edits (path, field, value): defaults where there were none; an edit ends ``continuous``."""
    fields = ["silence_db", "min_gap_s", "min_sound_s"]
    numbered = edits.withColumn("seq", F.col("seq")) if "seq" in edits.columns else edits.withColumn("seq", F.lit(0))
    new = wide(numbered, fields).select("path", *(F.col(f).cast("double").alias(f"_{f}") for f in fields), F.lit(True).alias("_edited"))
    out = chopping.join(new, "path", "full")
    value = lambda f: F.when(F.col("_edited"), C.chop_edit(F.coalesce(f"_{f}", f, F.lit(CHOP_DEFAULTS[f])), f)).otherwise(F.col(f))
    return out.withColumns({f: value(f) for f in fields} | {"continuous": F.when(F.col("_edited"), F.lit(False)).otherwise(F.col("continuous"))}).drop("_edited", *(f"_{f}" for f in fields))


def analysed_chop(chopping: DataFrame, results: DataFrame) -> DataFrame:
    """Analysed parameters (same columns) in place of the stored ones."""
    return chopping.join(results.select("path"), "path", "left_anti").unionByName(results)


def bulk(paths: DataFrame, field: str, value: Column, seq: int = 0) -> DataFrame:
    """One validated edit of a field for each path; all have the number of their batch."""
    return validated(paths.select(F.lit(seq).cast("long").alias("seq"), "path", F.lit(field).alias("field"), value.cast("string").alias("value")))


def pasted(userdata: DataFrame, source: str, targets: DataFrame, fields: list[str], seq: int = 0) -> DataFrame:
    """Validated edits that give the targets the fields of the record ``source``; a value that it lacks is pasted as blank."""
    cells = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("")).alias("value")) for f in fields)))
    copied = userdata.where(F.col("path") == source).limit(1).select(cells.alias("_c")).select("_c.*")  # a row for each field
    return validated(targets.select(F.lit(seq).cast("long").alias("seq"), "path").crossJoin(F.broadcast(copied)))


def cleared(paths: DataFrame, fields: list[str], seq: int = 0) -> DataFrame:
    """Validated edits that blank the fields of each path."""
    return validated(paths.select(F.lit(seq).cast("long").alias("seq"), "path", F.explode(F.array(*map(F.lit, fields))).alias("field"), F.lit("").alias("value")))


def deleted(catalog: DataFrame, userdata: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Catalog and user data without the paths; analyses of them stay behind."""
    return tuple(x.join(paths.select("path"), "path", "left_anti") for x in (catalog, userdata))


def applied_levels(userdata: DataFrame, edits: DataFrame) -> DataFrame:
    """One row: how many records the level edits reach."""
    return userdata.join(edits.select("path").distinct(), "path", "left_semi").agg(F.count("*").alias("applied"))
