"""Ranking by vectors: cosine search and standardised distance over all rows, top n by one partial sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.columns import dot, half_up, unit

SEARCH_TOP, SIMILAR_TOP = 400, 500


def ranked(scored: DataFrame, n: int, key: str = "path") -> DataFrame:
    """(rank, key, score) of the n best; the rank is a column, and ties go by key. Each task keeps n rows."""
    best = scored.orderBy(F.desc("score"), key).limit(n)
    # At most n rows are numbered.
    return best.select(F.row_number().over(Window.orderBy(F.desc("score"), key)).alias("rank"), key, "score")


def text_search(vectors: DataFrame, query: list[float], n: int = SEARCH_TOP, clip: bool = False, key: str = "path") -> DataFrame:
    """The n vectors of greatest cosine with a query vector, to four decimals; ``clip`` keeps scores within 0..1."""
    q = F.array(*(F.lit(float(x)) for x in query))
    score = dot(unit(F.col("vector")), unit(q))
    if clip:
        score = F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))
    return ranked(vectors.select(key, half_up(score, 4).alias("score")), n, key)


def similar_by_cosine(vectors: DataFrame, path, n: int = SIMILAR_TOP, key: str = "path") -> DataFrame:
    """The n vectors most like that of ``path``, without itself; scores within 0..1. One row is broadcast."""
    one = vectors.where(F.col(key) == path).select(unit(F.col("vector")).alias("_q")).limit(1)
    score = F.least(F.greatest(dot(unit(F.col("vector")), F.col("_q")), F.lit(0.0)), F.lit(1.0))
    others = vectors.where(F.col(key) != path).crossJoin(F.broadcast(one))
    return ranked(others.select(key, half_up(score, 4).alias("score")), n, key)


def standardisation(vectors: DataFrame) -> DataFrame:
    """One row (means, deviations): population statistics of each place over all vectors, pre-aggregated by place."""
    each = vectors.select(F.posexplode(F.col("vector").cast("array<double>")).alias("pos", "x"))
    stats = each.groupBy("pos").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("deviation"))
    rows = F.sort_array(F.collect_list(F.struct("pos", "mean", "deviation")))  # as many as the vectors have places
    return stats.agg(rows.alias("_r")).select(F.transform("_r", lambda r: r["mean"]).alias("means"), F.transform("_r", lambda r: r["deviation"] + 1e-9).alias("deviations"))


def similar_by_distance(vectors: DataFrame, path, n: int = SIMILAR_TOP, key: str = "path") -> DataFrame:
    """The n vectors nearest to that of ``path`` after standardisation, without itself; the score is 1 / (1 + distance)."""
    stats = standardisation(vectors)
    one = vectors.where(F.col(key) == path).select(F.col("vector").cast("array<double>").alias("_q")).limit(1)
    others = vectors.where(F.col(key) != path).crossJoin(F.broadcast(stats)).crossJoin(F.broadcast(one))
    delta = F.zip_with(F.zip_with(F.col("vector").cast("array<double>"), F.col("_q"), lambda a, b: a - b), F.col("deviations"), lambda d, s: d / s)
    distance = F.sqrt(F.aggregate(delta, F.lit(0.0), lambda s, x: s + x * x))
    return ranked(others.select(key, half_up(1.0 / (1.0 + distance), 4).alias("score")), n, key)


def similar(vectors: DataFrame, embeddings: DataFrame | None, path, n: int = SIMILAR_TOP, key: str = "path") -> DataFrame:
    """By learned embeddings wherever they exist, else by acoustic features."""
    if embeddings is not None and embeddings.head(1):
        return similar_by_cosine(embeddings, path, n, key)
    return similar_by_distance(vectors, path, n, key)


def filtered_ranking(found: DataFrame, catalog: DataFrame, condition, key: str = "path") -> DataFrame:
    """Filters apply to the top n alone: they pull no further rows in, and the rank stays."""
    return found.join(catalog, key).where(condition).orderBy("rank")
