"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight and a schedule: a curve over training time 0..1 that says when its words are
wanted. The integral of the curve, scaled to the source's target, is its cumulative demand. A source's
documents stand in a fixed pseudo-random order (md5 of the id); a document is placed where the cumulative
demand reaches the middle of its words, and documents are range-sorted by that position.

Targets: sources in code-point order, null last, take the weights in turn and share ``share`` of all words.
A target stops at ``max_epochs`` times its source; the excess goes to the others by weight, again and again.

Defined results: a null or blank text has size 0 and is taken 0 times; a null source is a source of its
own; repeated rows are separate documents; an empty table gives an empty result; other columns are kept by
``curriculum`` and may have any name that does not start with an underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, free, n_words, running_total

WEIGHTS = (5, 2, 1)
#: Knots (time, weight) of the three schedules that sources take in turn: even, falling, rising.
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 2.0), (1.0, 0.0)), ((0.0, 0.0), (1.0, 2.0)))


def integral(schedule) -> list[tuple[float, float, float, float, float]]:
    """Segments (start, end, weight at start, slope, integral before) of a piecewise-linear schedule, its whole integral scaled to 1."""
    area = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]))
    out, before = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        a, b = w0 / area, w1 / area
        out.append((t0, t1, a, (b - a) / (t1 - t0), before))
        before += (t1 - t0) * (a + b) / 2
    return out


def position(share: Column, schedule) -> Column:
    """The time at which the cumulative demand reaches ``share`` (0..1): the inverse of the integral."""
    segments = integral(schedule)
    times = []
    for t0, _, a, slope, before in segments:
        x = share - F.lit(before)
        times.append(F.lit(t0) + (x / a if slope == 0 else (F.sqrt(F.greatest(F.lit(0.0), F.lit(a * a) + x * (2 * slope))) - a) / slope))
    out = times[-1]
    for time, following in zip(times[-2::-1], segments[:0:-1]):
        out = F.when(share < following[4], time).otherwise(out)
    return F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0))


def targets(scratch: Scratch, sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """(source, source_size, turn, target): one row per source; ``sizes`` has (source, size)."""
    spark = scratch.spark
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_one", F.lit(1).cast("long"))
    sums = running_total(scratch, "sources", sums, [F.col("source").isNull(), F.col("source")], "_one")
    turn = (F.col("_before") % len(weights)).cast("int")
    weight = F.element_at(F.array(*map(F.lit, weights)), turn + 1)
    sums = scratch.save(sums.select("source", "source_size", turn.alias("turn"), weight.cast("long").alias("weight")), "weights")
    total = sums.agg(F.sum("source_size")).first()[0] or 0
    rate, capped = 0.0, -1
    while True:  # each round caps at least one more source
        cap = F.col("source_size") * max_epochs
        over = (cap <= F.col("weight") * F.lit(rate)) | (F.col("source_size") == 0)
        n, full, rest = sums.agg(F.count_if(over), F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight")))).first()
        if n == capped or not rest:
            break
        rate, capped = (share * total - (full or 0)) / rest, n
    target = F.least(cap.cast("double"), F.col("weight") * F.lit(rate))
    return sums.select("source", "source_size", "turn", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(target).alias("target"))


def assign(spark: SparkSession, docs: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, share: float = 1.5, max_epochs: int = 2, order_by: str | None = None) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, before (words of its source that stand before it), turn.

    A source gives whole rounds of its documents, then the rest of its target from the front of its order;
    the document at the end of that rest gives only the words still wanted, so the target is met to the word.
    """
    scratch = Scratch(spark, "mixing")
    sizes = scratch.save(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    goal = scratch.save(targets(scratch, sizes, weights, share, max_epochs), "targets")
    shuffled = F.col(order_by) if order_by else F.md5(F.col("doc_id").cast("string"))
    order = [F.col("source").isNull(), F.col("source"), shuffled, F.col("doc_id"), F.col("size")]
    placed = scratch.save(running_total(scratch, "ordered", sizes, order, "size"), "placed")
    first = placed.groupBy("source").agg(F.min("_before").alias("_first")).withColumnRenamed("source", "_source")
    goal = goal.join(first, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumnRenamed("source", "_source")
    joined = placed.join(goal, F.col("source").eqNullSafe(F.col("_source")))
    wanted = F.round("target").cast("long")
    rounds = F.when(F.col("source_size") > 0, F.floor(wanted / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0).cast("long")
    before = F.col("_before") - F.col("_first")
    rest = F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), F.col("_wanted") - F.col("_rounds") * F.col("source_size") - F.col("before")))
    out = joined.withColumns({"_wanted": wanted, "_rounds": rounds, "before": before}).withColumn("taken", F.col("_rounds") * F.col("size") + rest)
    return out.select("doc_id", "source", "size", "source_size", "target", "taken", "before", "turn", "_wanted", "_rounds")


def when(schedules, epoch: Column) -> Column:
    """The training time, 0..1, of a document's round ``epoch``: where demand reaches the middle of what it gives."""
    given = F.least(F.col("size"), F.col("taken") - epoch * F.col("size"))
    share = (epoch * F.col("source_size") + F.col("before") + given / 2) / F.greatest(F.col("_wanted"), F.lit(1))
    out = position(share, schedules[-1])
    for k in range(len(schedules) - 1):
        out = F.when(F.col("turn") % len(schedules) == k, position(share, schedules[k])).otherwise(out)
    return out


def row_key(docs: DataFrame) -> Column:
    """What rows that are equal in id, source and text share."""
    parts = [F.coalesce(F.concat(F.lit("="), docs[c].cast("string")), F.lit("-")) for c in ("doc_id", "source", "text")]
    return F.md5(F.concat_ws("\x00", *parts))


def curriculum(spark: SparkSession, docs: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """The mix: a row of ``docs`` for each time that a document is taken, with _position and _words, range-sorted by position.

    A document of which only a part is wanted (the last of its source) stays whole in its row; _words says how much counts.
    Rows equal in id, source and text count each, and are written out as the first of them.
    """
    key = free("_key", docs)
    keyed = docs.withColumn(key, row_key(docs))
    taken = assign(spark, keyed.withColumn("doc_id", F.col(key)), weights, schedules, share, max_epochs, order_by="doc_id").where("taken > 0")
    times = taken.withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")).cast("int") - 1)))
    times = times.select(F.col("doc_id").alias(key), when(schedules, F.col("_epoch")).alias("_position"), F.least(F.col("size"), F.col("taken") - F.col("_epoch") * F.col("size")).alias("_words"))
    return keyed.dropDuplicates([key]).join(times, key).drop(key).orderBy("_position", "doc_id")


def mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the words that the mix takes of each document, and the time of its first use."""
    taken = assign(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    first = F.when(F.col("taken") > 0, when(SCHEDULES, F.lit(0)))
    out = taken.select("doc_id", "size", "source_size", "target", "taken", F.floor(first * 1e6 + 0.5).alias("position_ppm"))
    return out.orderBy(F.col("position_ppm").asc_nulls_last(), "doc_id")


MIX_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
named AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn FROM sized GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][turn + 1]::BIGINT AS weight, source_size * 2 AS cap FROM named),
rounds AS (
  SELECT 0 AS k, 0.0::DOUBLE AS rate, -1::BIGINT AS capped
  UNION ALL
  SELECT k + 1, coalesce((1.5::DOUBLE * t.total - t.full_words) / nullif(t.rest, 0), rate), t.n
  FROM rounds, LATERAL (
    SELECT sum(source_size)::BIGINT AS total,
      coalesce(sum(CASE WHEN cap <= weight * rate OR source_size = 0 THEN cap END), 0)::BIGINT AS full_words,
      coalesce(sum(CASE WHEN NOT (cap <= weight * rate OR source_size = 0) THEN weight END), 0)::BIGINT AS rest,
      count(*) FILTER (cap <= weight * rate OR source_size = 0) AS n FROM weighed) t
  WHERE t.n <> capped AND t.rest > 0),
final AS (SELECT rate FROM rounds ORDER BY k DESC LIMIT 1),
goals AS (
  SELECT source, source_size, turn,
    CASE WHEN source_size = 0 THEN 0.0 ELSE least(cap::DOUBLE, weight * rate) END::DOUBLE AS target FROM weighed, final),
placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR) NULLS FIRST, doc_id NULLS FIRST, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM sized),
joined AS (
  SELECT p.doc_id, p.size, p.before, g.source_size, g.turn, g.target, round(g.target)::BIGINT AS wanted,
    CASE WHEN g.source_size > 0 THEN round(g.target)::BIGINT // g.source_size ELSE 0 END AS whole
  FROM placed p JOIN goals g ON p.source IS NOT DISTINCT FROM g.source),
counted AS (
  SELECT *, (whole * size + least(size, greatest(0, wanted - whole * source_size - before)))::BIGINT AS taken FROM joined),
shared AS (SELECT *, (before + least(size, taken) / 2.0::DOUBLE) / greatest(wanted, 1) AS share FROM counted)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN floor(1e6 * least(greatest(CASE turn
    WHEN 0 THEN share WHEN 1 THEN (sqrt(greatest(0.0, 4.0 + share * -4.0)) - 2.0) / -2.0
    ELSE sqrt(greatest(0.0, 0.0 + share * 4.0)) / 2.0 END, 0.0), 1.0) + 0.5)::BIGINT END AS position_ppm
FROM shared
"""
