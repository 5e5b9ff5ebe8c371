"""Sounds and gaps in level series: segmentation, histogram, threshold suggestion and parameter sweeps.

A series is in long form (key columns, idx from 0, level). All of it is windows over one key, so series are spread
over tasks by key; a single series is bounded by the frame limit of an envelope.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the threshold suggestion: histogram bounds, the smoothed bin that counts as empty (in thirds of bins
#: and thousandths of the frames), the range of candidates and the fallback.
FLOOR_DB, EMPTY_SHARE, LOW_DB, HEADROOM_DB, CLIP, DEFAULT_DB = -90, 0.006, -70.0, 10.0, (-68.0, -50.0), -60.0


def frames_of(seconds: Column, frame_s: Column) -> Column:
    """A gap in frames, at least one, rounded half to even."""
    return F.greatest(F.lit(1).cast("long"), F.bround(seconds / frame_s).cast("long"))


def gap_segments(series: DataFrame, keys: list[str], threshold: Column, gap_frames: Column, sound_frames: Column) -> DataFrame:
    """(keys, start, end): runs of loud frames with quiet gaps shorter than ``gap_frames`` inside; half-open.

    A segment ends after its last loud frame, but one that is still open at the end of the series reaches to that end.
    Segments shorter than ``sound_frames`` (not rounded) drop out. The three columns are constant in a series.
    """
    by = Window.partitionBy(*keys)
    order = by.orderBy("idx")
    loud = series.withColumn("_n", F.max("idx").over(by) + 1).withColumns({"_gap": gap_frames, "_sound": sound_frames}).where(F.col("level") >= threshold)
    before = F.lag("idx").over(order)
    loud = loud.withColumn("_new", F.when(before.isNull() | (F.col("idx") - before > F.col("_gap")), 1).otherwise(0))
    loud = loud.withColumn("_island", F.sum("_new").over(order))
    runs = loud.groupBy(*keys, "_island").agg(F.min("idx").alias("start"), (F.max("idx") + 1).alias("_end"), F.first("_n").alias("_n"), F.first("_gap").alias("_gap"), F.first("_sound").alias("_sound"))
    end = F.when(F.col("_n") - F.col("_end") < F.col("_gap"), F.col("_n")).otherwise(F.col("_end"))
    return runs.withColumn("end", end).where(F.col("end") - F.col("start") >= F.col("_sound")).select(*keys, "start", "end")


def counts(segments: DataFrame, series: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sounds, gaps) of every series, those without a segment too."""
    found = segments.groupBy(*keys).agg(F.count("*").alias("sounds"))
    every = series.select(*keys).distinct().join(found, keys, "left")
    return every.select(*keys, F.coalesce("sounds", F.lit(0)).cast("long").alias("sounds"), F.greatest(F.coalesce("sounds", F.lit(0)) - 1, F.lit(0)).cast("long").alias("gaps"))


def why_empty(series: DataFrame, keys: list[str], threshold: Column, gap_frames: Column, sound_frames: Column) -> DataFrame:
    """(keys, sounds, too_short): where no sound is long enough, how many were found before the length counts."""
    kept = gap_segments(series, keys, threshold, gap_frames, sound_frames).groupBy(*keys).agg(F.count("*").alias("_kept"))
    every = gap_segments(series, keys, threshold, gap_frames, F.lit(0)).groupBy(*keys).agg(F.count("*").alias("_all"))
    joined = series.select(*keys).distinct().join(every, keys, "left").join(kept, keys, "left")
    sounds = F.coalesce("_kept", F.lit(0)).cast("long")
    return joined.select(*keys, sounds.alias("sounds"), F.when(sounds == 0, F.coalesce("_all", F.lit(0))).otherwise(0).cast("long").alias("too_short"))


def to_samples(segments: DataFrame, frame_samples: int, rate: int, n: Column) -> DataFrame:
    """Frames to samples; the end stays within the frames' whole time."""
    limit = F.floor(F.lit(float(rate)) * (n * F.lit(float(frame_samples)) / F.lit(float(rate)))).cast("long")
    return segments.withColumns({"start": F.col("start") * frame_samples, "end": F.least(F.col("end") * frame_samples, limit)})


def effective(segments: Column, region: Column) -> Column:
    """A manual region (frames as struct start, end) wider than 0.0005 stands for the found segments."""
    manual = F.transform(F.array(region), lambda r: F.struct(r["start"].cast("double").alias("start"), r["end"].cast("double").alias("end")))
    found = F.transform(segments, lambda s: F.struct(s["start"].cast("double").alias("start"), s["end"].cast("double").alias("end")))
    return F.when(region.isNotNull() & (region["end"] - region["start"] > 0.0005), manual).otherwise(found)


def loop_spec(segments: Column, frame_s: Column) -> Column:
    """struct(start_s, end_s) of the one segment; null unless there is exactly one."""
    one = F.get(segments, F.lit(0))
    return F.when(F.size(segments) == 1, F.struct((one["start"] * frame_s).alias("start_s"), (one["end"] * frame_s).alias("end_s")))


def _in_histogram() -> Column:
    return (F.col("level") >= FLOOR_DB) & (F.col("level") <= 0)


def _bin() -> Column:
    return F.least(F.floor(F.col("level")) - FLOOR_DB, F.lit(-FLOOR_DB - 1)).cast("int")


def histogram(series: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bin, n): whole decibels from -90 to 0, bins 0..89; 0 dB is in the last bin, what is outside is left out."""
    return series.where(_in_histogram()).groupBy(*keys, _bin().alias("bin")).agg(F.count("*").alias("n"))


def suggest_threshold(series: DataFrame, keys: list[str], peak: Column | None = None) -> DataFrame:
    """(keys, threshold): a nearly empty decibel between the noise and the sounds, else the fixed default.

    Series without a frame over -99 dB get the default. The smoothed histogram is the sum of three bins with nothing
    beyond the ends. ``peak``: a column of the series (constant in it), or the greatest level.
    """
    usable, level = F.col("level") > -99, F.col("level")
    # One pass: the bins of a series are counted before they come together, ninety at most.
    binned = F.when(usable & _in_histogram(), _bin())
    counted = series.groupBy(*keys, binned.alias("_bin")).agg(F.count_if(usable).alias("_n"), F.max(F.when(usable, level if peak is None else peak)).alias("_peak"))
    bins = F.collect_list(F.when(F.col("_bin").isNotNull(), F.struct("_bin", "_n")))
    joined = counted.groupBy(*keys).agg(F.sum("_n").alias("_n"), F.max("_peak").alias("_peak"), F.map_from_entries(bins).alias("_bins"))
    of = lambda b: F.coalesce(F.col("_bins")[b], F.lit(0).cast("long"))
    spine = F.sequence(F.lit(0), F.lit(-FLOOR_DB - 1))
    smooth = F.transform(spine, lambda b: F.struct((of(b - 1) + of(b) + of(b + 1)).alias("_three"), (b + F.lit(FLOOR_DB + 0.5)).alias("_centre")))
    joined = joined.withColumn("_candidates", F.filter(smooth, lambda c: (c["_centre"] >= LOW_DB) & (c["_centre"] <= F.col("_peak") - HEADROOM_DB)))
    joined = joined.withColumns({"_n": F.nullif("_n", F.lit(0)), "_some": F.size("_candidates"), "_best": F.array_min("_candidates")})
    clip = lambda x: F.least(F.greatest(x, F.lit(CLIP[0])), F.lit(CLIP[1]))
    few = clip(F.least(F.lit(DEFAULT_DB), F.col("_peak") - 15.0))
    valley = F.when(F.col("_best._three") <= F.col("_n") * EMPTY_SHARE, clip(F.col("_best._centre"))).otherwise(F.lit(DEFAULT_DB))
    threshold = F.when(F.col("_n").isNull(), F.lit(DEFAULT_DB)).when(F.coalesce("_some", F.lit(0)) < 3, few).otherwise(valley)
    return joined.select(*keys, threshold.alias("threshold"))


def sweep(series: DataFrame, keys: list[str], peaks: DataFrame, frame_s: float, min_sound_s: float = 0.3) -> DataFrame:
    """(keys, threshold_kind, gap_s, sounds) over five thresholds and three gaps; ``peaks``: (keys, peak)."""
    # Fixed values of the sweep: thresholds in dBFS, thresholds below the peak, gaps in seconds.
    absolute, relative, gaps = (-55.0, -60.0, -65.0), (-30.0, -40.0), (0.5, 1.0, 2.0)
    kinds = [F.struct(F.lit(f"{t:g}").alias("kind"), F.lit(t).alias("at"), F.lit(0.0).alias("of_peak")) for t in absolute]
    kinds += [F.struct(F.lit(f"peak{t:g}").alias("kind"), F.lit(t).alias("at"), F.lit(1.0).alias("of_peak")) for t in relative]
    kinds_of = peaks.withColumn("_k", F.explode(F.array(*kinds)))
    kinds_of = kinds_of.select(*keys, F.col("_k.kind").alias("threshold_kind"), (F.col("_k.at") + F.col("_k.of_peak") * F.col("peak")).alias("_threshold"))
    # One pass over the series: a frame keeps the thresholds that it reaches, and only such frames are sorted.
    own, by = [*keys, "threshold_kind"], Window.partitionBy(*keys, "threshold_kind")
    limits = kinds_of.groupBy(*keys).agg(F.collect_list(F.struct("threshold_kind", "_threshold")).alias("_t"))  # five
    sizes = series.groupBy(*keys).agg((F.max("idx") + 1).alias("_n"))
    loud = series.join(limits, keys).select(*keys, "idx", F.explode(F.filter("_t", lambda t: F.col("level") >= t["_threshold"])["threshold_kind"]).alias("threshold_kind"))
    before, frames, least = F.lag("idx").over(by.orderBy("idx")), {g: max(1, round(g / frame_s)) for g in gaps}, min_sound_s / frame_s
    # The smallest gap's islands, once; wider gaps join them by the quiet between them.
    shortest = min(frames.values())
    marked = loud.withColumn("_before", before).withColumn("_new", F.when(F.col("_before").isNull() | (F.col("idx") - F.col("_before") > shortest), 1).otherwise(0))
    islands = marked.withColumn("_island", F.sum("_new").over(by.orderBy("idx"))).groupBy(*own, "_island").agg(F.min("idx").alias("s"), (F.max("idx") + 1).alias("e"))
    lists = islands.groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("_runs")).join(sizes, keys)

    def sounds(gap: float) -> Column:
        """How many runs, joined over gaps of so many frames, are long enough."""
        gap_frames = F.lit(frames[gap]).cast("long")
        last = lambda acc: acc["e"]
        closing = lambda s, e: F.when((e - s) >= least, 1).otherwise(0)
        start = F.struct(F.lit(0).alias("n"), F.lit(None).cast("long").alias("s"), F.lit(None).cast("long").alias("e"))
        joins = lambda acc, r: acc["s"].isNotNull() & (r["s"] - last(acc) + 1 <= gap_frames)
        step = lambda acc, r: F.struct((acc["n"] + F.when(acc["s"].isNull() | joins(acc, r), 0).otherwise(closing(acc["s"], acc["e"]))).alias("n"), F.when(joins(acc, r), acc["s"]).otherwise(r["s"]).alias("s"), r["e"].alias("e"))
        end = lambda acc: F.when(F.col("_n") - acc["e"] < gap_frames, F.col("_n")).otherwise(acc["e"])
        return F.aggregate("_runs", start, step, lambda acc: acc["n"] + F.when(acc["s"].isNull(), 0).otherwise(closing(acc["s"], end(acc))))

    each = lists.select(*own, F.explode(F.array(*(F.struct(F.lit(g).alias("gap_s"), sounds(g).cast("long").alias("sounds")) for g in gaps))).alias("_g")).select(*own, "_g.*")
    grid = kinds_of.select(*own, F.explode(F.array(*map(F.lit, gaps))).alias("gap_s"))
    return grid.join(each, [*own, "gap_s"], "left").withColumn("sounds", F.coalesce("sounds", F.lit(0)).cast("long"))


def plateau(series: DataFrame, keys: list[str], percent: float = 0.9, below: float = 6.0) -> DataFrame:
    """(keys, start, end): the longest run of frames within ``below`` dB of a percentile, the first of equals; both included."""
    limit = series.groupBy(*keys).agg((F.percentile("level", F.lit(percent)) - below).alias("_limit"))
    order = Window.partitionBy(*keys).orderBy("idx")
    loud = series.join(limit, keys).where(F.col("level") > F.col("_limit")).withColumn("_island", F.col("idx") - F.row_number().over(order))
    runs = loud.groupBy(*keys, "_island").agg(F.min("idx").alias("start"), F.max("idx").alias("end"))
    best = runs.groupBy(*keys).agg(F.max(F.struct((F.col("end") - F.col("start")).alias("n"), (-F.col("start")).alias("s"), "end")).alias("_b"))
    return best.select(*keys, (-F.col("_b.s")).alias("start"), F.col("_b.end").alias("end"))


def regular_runs(onsets: DataFrame, keys: list[str], period: Column) -> DataFrame:
    """(keys, first, last, n): the longest run of onsets spaced 0.6 to 1.6 periods, the first of equals. ``onsets``: (keys, at)."""
    order = Window.partitionBy(*keys).orderBy("at")
    gap = F.col("at") - F.lag("at").over(order)
    marked = onsets.withColumn("_p", period).withColumn("_gap", gap)
    new = F.when(F.col("_gap").between(F.col("_p") * 0.6, F.col("_p") * 1.6), 0).otherwise(1)
    runs = marked.withColumn("_run", F.sum(new).over(order)).groupBy(*keys, "_run").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n"))
    best = runs.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("first")).alias("f"), "last")).alias("_b"))
    return best.select(*keys, (-F.col("_b.f")).alias("first"), F.col("_b.last").alias("last"), F.col("_b.n").alias("n"))


def clamp_edit(segments: DataFrame, keys: list[str], n: Column) -> DataFrame:
    """Edited boundaries within their neighbours: from the previous end to the next start, at least one frame long."""
    order = Window.partitionBy(*keys).orderBy("ordinal")
    low = F.coalesce(F.lag("end").over(order), F.lit(0).cast("long"))
    high = F.coalesce(F.lead("start").over(order), n)
    clamped = segments.withColumns({"_low": low, "_high": high})
    start = F.least(F.greatest("new_start", "_low"), F.col("end") - 1)
    end = F.greatest(F.least("new_end", "_high"), F.col("start") + 1)
    return clamped.withColumns({"clamped_start": start, "clamped_end": end}).drop("_low", "_high")


def timeline(pieces: DataFrame, keys: list[str], silence: int) -> DataFrame:
    """``pieces`` (keys, ordinal, length) with their offset on a line with ``silence`` between them."""
    before = Window.partitionBy(*keys).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.withColumn("offset", F.coalesce(F.sum(F.col("length") + silence).over(before), F.lit(0)).cast("long"))


def interval_lookup(points: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """``points`` (keys, f) with the value interpolated in the first interval (p0..p1 to v0..v1) that holds f, else -1."""
    near = intervals.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("ordinal", "p0", "p1", "v0", "v1"))).alias("_map"))  # the few pieces of one file
    inside = F.get(F.filter("_map", lambda m: F.col("f").between(m["p0"], m["p1"])), F.lit(0))
    share = F.when(inside["p1"] > inside["p0"], (F.col("f") - inside["p0"]) / (inside["p1"] - inside["p0"])).otherwise(0.0)
    value = F.coalesce(inside["v0"] + share * (inside["v1"] - inside["v0"]), F.lit(-1.0))
    return points.join(near, keys, "left").withColumn("value", value).drop("_map")


def frame_rms(samples: DataFrame, keys: list[str], frame: int, keep_tail: bool) -> DataFrame:
    """(keys, frame_idx, level): RMS level of each ``frame`` samples (keys, i, x).

    Without ``keep_tail`` a last, shorter frame is left out, unless it is the only one.
    """
    n = samples.groupBy(*keys, F.floor(F.col("i") / frame).alias("frame_idx")).agg(F.avg(F.col("x") * F.col("x")).alias("_ms"), F.count("*").alias("_n"))
    if not keep_tail:
        n = n.where((F.col("_n") == frame) | (F.col("frame_idx") == 0))
    from tessella.functions.columns import rms_db

    return n.select(*keys, "frame_idx", rms_db(F.col("_ms")).alias("level"))


def sliding_rms(samples: DataFrame, keys: list[str], window: int, hop: int) -> DataFrame:
    """(keys, i, rms) over ``window`` samples from every ``hop``-th on, while a whole window is left."""
    order = Window.partitionBy(*keys).orderBy("i").rowsBetween(0, window - 1)
    rows = samples.withColumns({"_ms": F.avg(F.col("x") * F.col("x")).over(order), "_n": F.count("*").over(order)})
    return rows.where((F.col("_n") == window) & (F.col("i") % hop == 0)).select(*keys, "i", F.sqrt("_ms").alias("rms"))


def rolloff(spectra: DataFrame, keys: list[str], share: float = 0.85) -> DataFrame:
    """(keys, bin): the first bin (keys, bin, magnitude) at which so much of the sum is reached."""
    whole = Window.partitionBy(*keys)
    rows = spectra.withColumns({"_sum": F.sum("magnitude").over(whole.orderBy("bin")), "_all": F.sum("magnitude").over(whole)})
    return rows.where(F.col("_sum") >= F.col("_all") * share).groupBy(*keys).agg(F.min("bin").alias("bin"))


def quantiles(values: DataFrame, keys: list[str], value: str, unique: str, at: dict[str, float]) -> DataFrame:
    """(keys, names of ``at``): exact quantiles, interpolated between neighbours; null and NaN values are left out.

    Values are numbered in a range sort, and only the one or two rows that a quantile lies between are looked at, so a
    key may have any share of the rows.
    """
    from tessella.operators.view import numbered_within

    rows = values.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, F.col(value).alias("_v"), F.col(unique).alias("_u"))
    placed = numbered_within(rows, keys, [F.col("_v"), F.col("_u")], "_i")
    sizes = placed.groupBy(*keys).agg(F.count("*").alias("_n"))
    wanted = sizes.select(*keys, F.explode(F.array(*(F.struct(F.lit(n).alias("q"), ((F.col("_n") - 1) * F.lit(x)).alias("p")) for n, x in at.items()))).alias("_w")).select(*keys, "_w.*")
    ends = wanted.select(*keys, "q", "p", F.explode(F.array_distinct(F.array(F.floor("p"), F.ceil("p")))).alias("_i"))
    found = placed.join(ends, [*keys, "_i"]).groupBy(*keys, "q").agg(F.min("_v").alias("_a"), F.max("_v").alias("_b"), F.first("p").alias("p"))
    each = found.withColumn("_x", F.col("_a") + (F.col("p") - F.floor("p")) * (F.col("_b") - F.col("_a")))
    return each.groupBy(*keys).agg(*(F.max(F.when(F.col("q") == n, F.col("_x"))).alias(n) for n in at))


def level_of_blocks(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, level): the RMS level of a long signal from (keys, energy, n), the sums of squares of its blocks."""
    from tessella.functions.columns import rms_db

    return blocks.groupBy(*keys).agg((F.sum("energy") / F.sum("n")).alias("_ms")).select(*keys, rms_db(F.col("_ms"), 1e-12).alias("level"))
