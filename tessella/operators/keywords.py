"""Keywords: how many libraries use a word in their name or file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.columns import natural_key

#: Words that say nothing about a sound.
STOPWORDS = (
    "the", "and", "for", "with", "from", "into", "out", "off", "this", "that", "are", "was", "has", "its", "you",
    "by", "on", "in", "at", "or", "of", "an", "as", "no", "to", "is", "it", "my", "be", "we", "up", "so", "re", "wav",
    "wave", "aif", "aiff", "flac", "mp3", "ogg", "stereo", "mono", "ortf", "xy", "ab", "ms", "db", "hz", "khz", "bit",
    "bits", "ch", "mix", "master", "final", "take", "ver", "version",
)


def keeps(token: Column) -> Column:
    """At least two characters, not all digits, not a stop word."""
    return (F.length(token) >= 2) & ~token.rlike("^[0-9]+$") & ~token.isin(*STOPWORDS)


def document_frequency(df: DataFrame, group: list[str], texts: list[str]) -> DataFrame:
    """(token, n): in how many groups a token occurs. Each task keeps one of a group's equal tokens before they are shuffled."""
    text = F.lower(F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in texts)))
    # As ``tokenize``, but what splits is cheaper to find than what is found.
    each = df.select(*group, F.explode(F.split(text, "[^a-z0-9]+")).alias("token")).where(keeps(F.col("token"))).distinct()
    return each.groupBy("token").agg(F.count("*").alias("n"))


def keywords(df: DataFrame, group: list[str], texts: list[str], limit: int = 500) -> DataFrame:
    """The commonest tokens, ties in natural order."""
    return document_frequency(df, group, texts).orderBy(F.desc("n"), natural_key(F.col("token")), "token").limit(limit)


def narrowed(found: DataFrame, needle: str, limit: int = 500) -> DataFrame:
    """Keywords that contain a text."""
    return found.where(F.contains(F.col("token"), F.lit(needle.strip().lower()))).orderBy(F.desc("n"), natural_key(F.col("token")), "token").limit(limit)
