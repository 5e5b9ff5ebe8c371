"""Further operators over the driver's tables: display and parameter functions, edits, renames, windows and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import columns as C
from tessella.operators import catalog, edits, segments, view
from tessella.plans.queries import segments_sql, series, table
from tessella.plans.queries import SERIES
from tessella.plans.registry import register


def round6(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"


@register("rename_plan", r"""
WITH f AS (SELECT DISTINCT p_brand AS folder, CASE WHEN p_size % 4 = 0 THEN 'a?' WHEN p_size % 4 = 1 THEN 'a:' ELSE 'a ' END || p_size % 3 || CASE WHEN p_size % 4 < 2 THEN '' WHEN p_size % 5 = 0 THEN '_1' WHEN p_size % 5 = 1 THEN '_3' ELSE '' END || '.wav' AS filename FROM part),
n AS (SELECT *, regexp_matches(filename, '[<>:"/\\|?*]') AS bad, 'a ' || filename[3] AS stem, filename[4:-5] AS mark FROM f),
taken AS (SELECT DISTINCT folder, stem, CASE WHEN mark = '' THEN 0 ELSE mark[2:]::INT END AS k FROM n WHERE NOT bad),
wanted AS (SELECT *, row_number() OVER (PARTITION BY folder, stem ORDER BY lower(folder || '/' || filename), folder || '/' || filename) AS nth FROM n WHERE bad),
free AS (SELECT w.folder, w.stem, g.k, row_number() OVER (PARTITION BY w.folder, w.stem ORDER BY g.k) AS nth FROM (SELECT DISTINCT folder, stem FROM wanted) w CROSS JOIN (SELECT unnest(range(0, 12)) AS k) g
  WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.folder = w.folder AND t.stem = w.stem AND t.k = g.k))
SELECT w.folder || '/' || filename AS old, w.folder || '/' || w.stem || CASE WHEN k > 0 THEN '_' || k ELSE '' END || '.wav' AS new FROM wanted w JOIN free f ON w.folder = f.folder AND w.stem = f.stem AND w.nth = f.nth
""")
def rename_plan(spark: SparkSession, folder: str) -> DataFrame:
    """New names for files that can't be stored everywhere, with the first free number where the clean name is taken."""
    size = F.col("p_size")
    mark = F.when(size % 4 < 2, "").when(size % 5 == 0, "_1").when(size % 5 == 1, "_3").otherwise("")
    name = F.concat(F.when(size % 4 == 0, "a?").when(size % 4 == 1, "a:").otherwise("a "), (size % 3).cast("string"), mark, F.lit(".wav"))
    files = table(spark, folder, "part").select(F.concat_ws("/", "p_brand", name).alias("path"), name.alias("filename")).distinct()
    return catalog.plan_renames(files)


@register("playable_flags", """
WITH f AS (SELECT p_partkey, (['wav', 'mp3', 'ogg'])[p_size % 3 + 1] AS ext, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size % 5 END AS channels, CASE WHEN p_size % 7 = 0 THEN NULL ELSE (p_size % 7 - 1) * 0.5::DOUBLE END AS duration FROM part)
SELECT p_partkey, ext = 'mp3' OR (ext = 'wav' AND coalesce(channels, 0) <= 2) AS playable, coalesce(duration > 0 AND duration < 1.5, false) AS continuous FROM f WHERE ext <> 'ogg'
""")
def playable_flags(spark: SparkSession, folder: str) -> DataFrame:
    """What the player takes, and what is too short to be read."""
    size = F.col("p_size")
    files = table(spark, folder, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, ("wav", "mp3", "ogg"))), (size % 3 + 1).cast("int")).alias("ext"), F.when(size % 5 != 0, size % 5).alias("channels"), F.when(size % 7 != 0, (size % 7 - 1) * 0.5).alias("duration"))
    return files.where("ext <> 'ogg'").select("p_partkey", C.is_playable(F.col("ext"), F.col("channels")).alias("playable"), C.is_short(F.col("duration"), 1.5).alias("continuous"))


@register("slider_functions", f"""
SELECT p_partkey, {round6("exp(ln(20.0::DOUBLE) + p_size / 50.0::DOUBLE * (ln(20000.0::DOUBLE) - ln(20.0::DOUBLE)))")} AS log_value, {round6("2.0 + p_size / 50.0::DOUBLE * 6.0")} AS linear_value,
  {round6("(ln(p_retailprice) - ln(1.0::DOUBLE)) / (ln(5000.0::DOUBLE) - ln(1.0::DOUBLE))")} AS fraction,
  {round6("greatest(-90.0, 10.0::DOUBLE * log2(p_size / 50.0::DOUBLE * (1.0 - pow(2.0, -9.0)) + pow(2.0, -9.0)))")} AS db FROM part
""")
def slider_functions(spark: SparkSession, folder: str) -> DataFrame:
    """Slider positions and graph heights, and back."""
    share = F.col("p_size") / 50.0
    return table(spark, folder, "part").select(
        "p_partkey", C.half_up(C.slider_value(share, 20, 20000), 6).alias("log_value"), C.half_up(C.slider_value(share, 2.0, 8.0), 6).alias("linear_value"),
        C.half_up(C.slider_fraction(F.col("p_retailprice"), 1, 5000), 6).alias("fraction"), C.half_up(C.height_to_db(share), 6).alias("db"),
    )


@register("mel_scales", f"""
SELECT p_partkey, {round6("2595.0::DOUBLE * log10(1.0 + p_retailprice / 700.0)")} AS htk, {round6("1127.0::DOUBLE * ln(1.0 + p_retailprice / 700.0)")} AS kaldi,
  {round6("CASE WHEN p_retailprice >= 1000.0 THEN 15.0::DOUBLE + ln(p_retailprice / 1000.0) * (27.0 / ln(6.4::DOUBLE)) ELSE 3.0::DOUBLE * p_retailprice / 200.0 END")} AS slaney FROM part
""")
def mel_scales(spark: SparkSession, folder: str) -> DataFrame:
    hertz = F.col("p_retailprice")
    return table(spark, folder, "part").select("p_partkey", *(C.half_up(C.hz_to_mel(hertz, s), 6).alias(s) for s in ("htk", "kaldi", "slaney")))


@register("format_values", """
WITH v AS (SELECT p_partkey, p_size, p_retailprice * (p_size * p_size) - 5000 AS x FROM part), u AS (SELECT *, abs(x) AS a FROM v)
SELECT p_partkey, CASE WHEN x < 0 THEN '-' ELSE '' END || CASE WHEN a >= 1e6 THEN printf('%d.%dM', floor(a / 1e6 * 10 + 0.5)::BIGINT // 10, floor(a / 1e6 * 10 + 0.5)::BIGINT % 10)
    WHEN a >= 1e3 THEN printf('%d.%dk', floor(a / 1e3 * 10 + 0.5)::BIGINT // 10, floor(a / 1e3 * 10 + 0.5)::BIGINT % 10) ELSE printf('%d', floor(a * 1 + 0.5)::BIGINT) END AS number,
  CASE WHEN p_size % 6 > 0 THEN repeat('★', p_size % 6) ELSE '' END AS stars,
  CASE WHEN p_size = 25 THEN '' ELSE CASE WHEN p_size < 25 THEN '-' ELSE '+' END || printf('%d.%d', floor(abs((p_size - 25) / 4.0::DOUBLE) * 10 + 0.5)::BIGINT // 10, floor(abs((p_size - 25) / 4.0::DOUBLE) * 10 + 0.5)::BIGINT % 10) END AS gain FROM u
""")
def format_values(spark: SparkSession, folder: str) -> DataFrame:
    size = F.col("p_size")
    x = F.col("p_retailprice") * (size * size) - 5000
    return table(spark, folder, "part").select("p_partkey", C.format_column(x, "number").alias("number"), C.stars(size % 6).alias("stars"), C.format_column((size - 25) / 4.0, "db").alias("gain"))


@register("parse_numbers", """
SELECT event_id, coalesce(try_cast(trim(CASE WHEN event_id % 3 = 0 THEN ' ' || value || ' ' WHEN event_id % 3 = 1 THEN event_type ELSE '' END) AS DOUBLE), -1.0) AS parsed,
  least(greatest(value - 200, -90.0), 0.0) AS silence_db, least(greatest(value / 20, 0.0), 10.0) AS min_gap_s FROM events
""")
def parse_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Permissive numbers, and chop parameters within their bounds."""
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" "), F.col("value").cast("string"), F.lit(" "))).when(F.col("event_id") % 3 == 1, F.col("event_type")).otherwise("")
    return table(spark, folder, "events").select("event_id", C.parse_number(text, -1.0).alias("parsed"), C.chop_edit(F.col("value") - 200, "silence_db").alias("silence_db"), C.chop_edit(F.col("value") / 20, "min_gap_s").alias("min_gap_s"))


@register("row_range", "SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice, p_partkey) AS row FROM part QUALIFY row BETWEEN 11 AND 40")
def row_range(spark: SparkSession, folder: str) -> DataFrame:
    """The rows between two clicks, in display order."""
    part = table(spark, folder, "part").select("p_partkey", "p_retailprice")
    return view.row_range(part, [F.col("p_retailprice"), F.col("p_partkey")], 40, 11).select("p_partkey", "row")


@register("session_sounds", """
WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WHERE value >= 50),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM l)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS frames FROM s GROUP BY user_id, session
""")
def session_sounds(spark: SparkSession, folder: str) -> DataFrame:
    """Sounds as session windows; their end is the last loud frame's own time."""
    from tessella.streaming.incremental import sounds

    events = table(spark, folder, "events").withColumn("at", F.col("ts").cast("timestamp"))
    found = sounds(events, "user_id", "at", "value", 50.0, "2 hours", "1 hour")
    return found.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "frames")


@register("window_levels", """
SELECT event_type, epoch_us(date_trunc('day', ts)) AS start_us, floor(sqrt(avg(value * value)) * 1e6 + 0.5) / 1e6 AS rms FROM events GROUP BY 1, 2
""")
def window_levels(spark: SparkSession, folder: str) -> DataFrame:
    """RMS of tumbling windows in event time."""
    from tessella.streaming.incremental import windowed_levels

    events = table(spark, folder, "events").withColumn("at", F.col("ts").cast("timestamp"))
    found = windowed_levels(events, "event_type", "at", F.col("value"), "1 day", "1 hour")
    return found.select("event_type", F.unix_micros("start").alias("start_us"), C.half_up(F.col("rms"), 6).alias("rms"))


@register("needs_16_bit", r"""
WITH f AS (SELECT p_partkey, p_brand || '/' || p_partkey // 2 || CASE WHEN p_partkey % 2 = 1 AND p_size % 2 = 0 THEN '_16bit.wav' ELSE '.wav' END AS path, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN 16 ELSE 24 END AS depth FROM part)
SELECT p_partkey, path FROM f WHERE depth > 16 AND NOT EXISTS (SELECT 1 FROM f g WHERE g.path = regexp_replace(f.path, '\.[^.]*$', '') || '_16bit.wav')
""")
def needs_16_bit(spark: SparkSession, folder: str) -> DataFrame:
    """Deep files without a 16-bit sibling."""
    key, size = F.col("p_partkey"), F.col("p_size")
    path = F.concat("p_brand", F.lit("/"), F.floor(key / 2).cast("string"), F.when((key % 2 == 1) & (size % 2 == 0), "_16bit.wav").otherwise(".wav"))
    files = table(spark, folder, "part").select("p_partkey", path.alias("path"), F.when(size % 3 == 1, 16).when(size % 3 == 2, 24).alias("bit_depth"))
    return catalog.needs_16_bit(files).select("p_partkey", "path")


@register("inherit_fields", """
SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END, c_mktsegment) AS tags, c_acctbal AS level FROM orders LEFT JOIN customer ON o_custkey = c_custkey
""")
def inherit_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Derived records take their parent's values where they have none."""
    children = table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("parent"), F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority")).alias("tags"))
    parents = table(spark, folder, "customer").select(F.col("c_custkey").alias("path"), F.col("c_mktsegment").alias("tags"), F.col("c_acctbal").alias("level"))
    return catalog.inherit(children, parents, ["tags", "level"]).select("o_orderkey", "tags", "level")


FIELDS = "(['gain_db', 'level', 'rating', 'tags', 'silence_db'])[event_id % 5 + 1]"
VALUES = "CASE WHEN event_id % 7 = 0 THEN ' ' WHEN event_id % 11 = 0 THEN 'x' ELSE (floor(value) - 150)::INT::VARCHAR END"


@register("validated_edits", f"""
WITH e AS (SELECT event_id AS seq, user_id AS path, {FIELDS} AS field, trim({VALUES}) AS t FROM events), n AS (SELECT *, try_cast(t AS DOUBLE) AS x FROM e)
SELECT seq, path, field, CASE WHEN field = 'tags' THEN t END AS text, CASE field WHEN 'tags' THEN NULL WHEN 'gain_db' THEN CASE WHEN t = '' THEN 0.0 ELSE least(greatest(x, -80.0), 24.0) END
  WHEN 'level' THEN CASE WHEN x IS NOT NULL THEN least(greatest(x, 0.0), 10.0) END WHEN 'rating' THEN least(greatest(x, 0.0), 5.0) ELSE least(greatest(x, -90.0), 0.0) END AS number
FROM n WHERE field = 'tags' OR (t = '' AND field IN ('gain_db', 'level')) OR x IS NOT NULL
""")
def validated_edits(spark: SparkSession, folder: str) -> DataFrame:
    """Edits with trimmed texts and bounded numbers; what is no number is rejected."""
    key = F.col("event_id")
    field = F.element_at(F.array(*map(F.lit, ("gain_db", "level", "rating", "tags", "silence_db"))), (key % 5 + 1).cast("int"))
    value = F.when(key % 7 == 0, " ").when(key % 11 == 0, "x").otherwise((F.floor("value") - 150).cast("string"))
    log = table(spark, folder, "events").select(key.alias("seq"), F.col("user_id").alias("path"), field.alias("field"), value.alias("value"))
    text = F.col("field") == "tags"
    return edits.validated(log).select("seq", "path", "field", F.when(text, F.col("value")).alias("text"), F.when(~text, F.col("value").try_cast("double")).alias("number"))


@register("level_edit", """
WITH u AS (SELECT c_custkey AS path, 5.0::DOUBLE AS level, 1.5::DOUBLE AS gain FROM customer), m AS (SELECT c_custkey AS path, -20.0::DOUBLE - c_custkey % 13 AS lufs, -(c_custkey % 9)::DOUBLE AS peak FROM customer WHERE c_custkey % 4 <> 0),
e AS (SELECT c_custkey AS path, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE (c_custkey % 10 + 1)::DOUBLE END AS level FROM customer WHERE c_custkey % 3 = 0),
j AS (SELECT u.path, u.level, u.gain, e.path IS NOT NULL AS edited, e.level AS new, lufs, peak FROM u LEFT JOIN e ON u.path = e.path LEFT JOIN m ON u.path = m.path)
SELECT path, CASE WHEN edited THEN new ELSE level END AS level, CASE WHEN edited AND new IS NOT NULL AND lufs IS NOT NULL
  THEN floor(least(greatest(least(-10.0::DOUBLE + 10.0::DOUBLE * log2(new / 10.0) - lufs, -peak), -80.0::DOUBLE), 24.0::DOUBLE) * 10 + 0.5) / 10 ELSE gain END AS gain_db FROM j
""")
def level_edit(spark: SparkSession, folder: str) -> DataFrame:
    """Levels that are set bring their gains; cleared ones leave them."""
    key = F.col("c_custkey")
    customer = table(spark, folder, "customer").select(key)
    user = customer.select(key.alias("path"), F.lit(5.0).alias("level"), F.lit(1.5).alias("gain_db"))
    loud = customer.where(key % 4 != 0).select(key.alias("path"), (F.lit(-20.0) - key % 13).alias("lufs"), (-(key % 9)).cast("double").alias("peak_db"))
    new = customer.where(key % 3 == 0).select(key.alias("path"), F.when(key % 5 != 0, (key % 10 + 1).cast("double")).alias("level"))
    return edits.level_edit(user, loud, new)


@register("chop_edit", """
WITH c AS (SELECT s_suppkey AS path, CASE WHEN s_suppkey % 2 = 0 THEN -50.0::DOUBLE END AS db, CASE WHEN s_suppkey % 2 = 0 THEN 1.0::DOUBLE END AS gap, s_suppkey % 2 = 1 AS continuous FROM supplier WHERE s_suppkey % 5 <> 0),
e AS (SELECT s_suppkey AS path, -(s_suppkey * 3)::DOUBLE AS db FROM supplier WHERE s_suppkey % 3 = 0)
SELECT coalesce(c.path, e.path) AS path, CASE WHEN e.path IS NOT NULL THEN least(greatest(e.db, -90.0), 0.0) ELSE c.db END AS silence_db,
  CASE WHEN e.path IS NOT NULL THEN coalesce(gap, 1.5) ELSE gap END AS min_gap_s, CASE WHEN e.path IS NOT NULL THEN false ELSE continuous END AS continuous FROM c FULL JOIN e ON c.path = e.path
""")
def chop_edit(spark: SparkSession, folder: str) -> DataFrame:
    """Edited chop parameters, with defaults where there were none."""
    key = F.col("s_suppkey")
    supplier = table(spark, folder, "supplier").select(key)
    even = key % 2 == 0
    stored = supplier.where(key % 5 != 0).select(key.alias("path"), F.when(even, -50.0).alias("silence_db"), F.when(even, 1.0).alias("min_gap_s"), F.when(even, 0.3).alias("min_sound_s"), (~even).alias("continuous"))
    log = supplier.where(key % 3 == 0).select(key.alias("seq"), key.alias("path"), F.lit("silence_db").alias("field"), (-(key * 3)).cast("string").alias("value"))
    return edits.chop_edit(stored, log).select("path", "silence_db", "min_gap_s", "continuous")


@register("recomputed_gains", """
WITH p AS (SELECT p_partkey AS path, CASE WHEN p_size % 6 = 0 THEN NULL ELSE p_size / 5.0::DOUBLE END AS level, 3.0::DOUBLE AS gain, -20.0::DOUBLE - p_size % 17 AS lufs, -(p_size % 8)::DOUBLE AS peak FROM part),
g AS (SELECT *, CASE WHEN level IS NOT NULL THEN floor(least(greatest(least(-10.0::DOUBLE + 10.0::DOUBLE * log2(level / 10.0) - lufs, -peak), -80.0::DOUBLE), 24.0::DOUBLE) * 10 + 0.5) / 10 END AS target FROM p)
SELECT path, coalesce(target, gain) AS gain_db, target IS NOT NULL AND target <> gain AS updated FROM g
""")
def recomputed_gains(spark: SparkSession, folder: str) -> DataFrame:
    """All gains that follow from levels, and which of them changed."""
    size = F.col("p_size")
    part = table(spark, folder, "part")
    user = part.select(F.col("p_partkey").alias("path"), F.when(size % 6 != 0, size / 5.0).alias("level"), F.lit(3.0).alias("gain_db"))
    loud = part.select(F.col("p_partkey").alias("path"), (F.lit(-20.0) - size % 17).alias("lufs"), (-(size % 8)).cast("double").alias("peak_db"))
    return edits.recomputed_gains(user, loud).select("path", "gain_db", "updated")


@register("segment_samples", f"""
WITH {SERIES.strip()}, {segments_sql("user_id", "series", "-45.0::DOUBLE", "3", "1")}
SELECT user_id, "start" * 960 AS "start", least("end" * 960, floor(48000.0::DOUBLE * (1000 * 960.0::DOUBLE / 48000.0))::BIGINT) AS "end" FROM found
""")
def segment_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Segments in samples."""
    found = segments.gap_segments(series(spark, folder), ["user_id"], F.lit(-45.0), F.lit(3), F.lit(1))
    return segments.to_samples(found, 960, 48000, F.lit(1000)).select("user_id", "start", "end")


@register("loop_specs", """
WITH s AS (SELECT p_partkey, p_size % 3 AS n, p_size::DOUBLE AS a, p_size + 10.0::DOUBLE AS b, CASE WHEN p_size % 4 = 0 THEN p_size / 10.0::DOUBLE END AS r0, CASE WHEN p_size % 4 = 0 THEN p_size / 10.0::DOUBLE + (CASE WHEN p_size % 8 = 0 THEN 0.0001 ELSE 2.5 END)::DOUBLE END AS r1 FROM part),
e AS (SELECT p_partkey, CASE WHEN r0 IS NOT NULL AND r1 - r0 > 0.0005 THEN 1 ELSE n END AS n, CASE WHEN r0 IS NOT NULL AND r1 - r0 > 0.0005 THEN r0 ELSE a END AS s, CASE WHEN r0 IS NOT NULL AND r1 - r0 > 0.0005 THEN r1 ELSE b END AS e FROM s)
SELECT p_partkey, n AS pieces, CASE WHEN n = 1 THEN floor(s * 0.02::DOUBLE * 1e6 + 0.5) / 1e6 END AS start_s, CASE WHEN n = 1 THEN floor(e * 0.02::DOUBLE * 1e6 + 0.5) / 1e6 END AS end_s FROM e
""")
def loop_specs(spark: SparkSession, folder: str) -> DataFrame:
    """A manual region stands for the found segments; a loop needs exactly one."""
    size = F.col("p_size")
    piece = F.struct(size.cast("long").alias("start"), (size + 10).cast("long").alias("end"))
    found = F.slice(F.array(piece, piece), 1, (size % 3).cast("int"))
    region = F.when(size % 4 == 0, F.struct((size / 10.0).alias("start"), (size / 10.0 + F.when(size % 8 == 0, 0.0001).otherwise(2.5)).alias("end")))
    parts = table(spark, folder, "part").select("p_partkey", segments.effective(found, region).alias("segments"))
    spec = segments.loop_spec(F.col("segments"), F.lit(0.02))
    return parts.select("p_partkey", F.size("segments").alias("pieces"), C.half_up(spec["start_s"], 6).alias("start_s"), C.half_up(spec["end_s"], 6).alias("end_s"))


@register("stale_records", """
WITH s AS (SELECT p_partkey AS path, p_size + (p_partkey % 4 = 0)::INT AS size, p_partkey % 6 = 0 AS continuous, CASE WHEN p_partkey % 3 = 0 THEN 2.0 ELSE 1.5 END AS gap FROM part WHERE p_partkey % 5 <> 0)
SELECT p_partkey FROM part LEFT JOIN s ON p_partkey = path WHERE NOT coalesce(p_size = size AND (continuous OR gap = 1.5), false)
""")
def stale_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records whose stored analysis no longer fits their size or the parameters."""
    key = F.col("p_partkey")
    part = table(spark, folder, "part").select(key, "p_size")
    store = part.where(key % 5 != 0).select(key.alias("path"), (F.col("p_size") + F.when(key % 4 == 0, 1).otherwise(0)).alias("size"), (key % 6 == 0).alias("continuous"), F.when(key % 3 == 0, 2.0).otherwise(1.5).alias("min_gap_s"))
    records = part.select(key.alias("path"), F.col("p_size").alias("size"))
    return catalog.stale(records, store, {"min_gap_s": F.lit(1.5)}).select(F.col("path").alias("p_partkey"))


@register("change_flag", """
SELECT count(*) FILTER (o_totalprice > 100000) AS parsed, count(*) AS before, count(*) FILTER (o_orderstatus <> 'P') AS after, true AS changed FROM orders
""")
def change_flag(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a scan changed anything."""
    orders = table(spark, folder, "orders")
    return catalog.changed(orders.where("o_totalprice > 100000"), orders, orders.where("o_orderstatus <> 'P'"))


@register("prefix_lookup", "SELECT max(p_partkey) AS p_partkey, p_name FROM part WHERE starts_with(p_name, (SELECT substr(p_name, 1, 5) FROM part ORDER BY p_partkey LIMIT 1)) GROUP BY p_name ORDER BY 1 LIMIT 1")
def prefix_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """The first record whose name starts like a given one."""
    part = table(spark, folder, "part")
    name = part.orderBy("p_partkey").first()["p_name"]
    return catalog.first_with_prefix(part.select(F.col("p_name").alias("filename"), F.col("p_partkey").alias("path")), name, 5).select(F.col("path").alias("p_partkey"), F.col("filename").alias("p_name"))


@register("unit_vectors", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)
SELECT vec_id, floor(list_dot_product(v, v) / ((sqrt(list_dot_product(v, v)) + 1e-9::DOUBLE) * (sqrt(list_dot_product(v, v)) + 1e-9::DOUBLE)) * 1e6 + 0.5) / 1e6 AS norm, floor(v[1] / (sqrt(list_dot_product(v, v)) + 1e-9::DOUBLE) * 1e6 + 0.5) / 1e6 AS first FROM v
""")
def unit_vectors(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", C.unit(F.col("embedding")).alias("u"))
    return vectors.select("vec_id", C.half_up(C.dot(F.col("u"), F.col("u")), 6).alias("norm"), C.half_up(F.get("u", F.lit(0)), 6).alias("first"))


@register("cumulative_energy", """
WITH b AS (SELECT user_id, event_type, sum(value * value) AS e, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id, floor(20.0::DOUBLE * log10(sqrt(sum(e) / sum(n)) + 1e-12::DOUBLE) * 1e2 + 0.5) / 1e2 AS rms_db FROM b GROUP BY user_id
""")
def cumulative_energy(spark: SparkSession, folder: str) -> DataFrame:
    """The level of a long signal from the sums of its blocks."""
    blocks = table(spark, folder, "events").groupBy("user_id", "event_type").agg(F.sum(F.col("value") * F.col("value")).alias("energy"), F.count("*").alias("n"))
    return segments.level_of_blocks(blocks, ["user_id"]).select("user_id", C.half_up(F.col("level"), 2).alias("rms_db"))


@register("catalog_order", "SELECT page_id, row_number() OVER (ORDER BY lower(url), page_id) AS place FROM pages")
def catalog_order(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the catalog with its place in the catalog's own order."""
    pages = table(spark, folder, "pages").select("page_id", F.lower("url").alias("u"))
    return view.numbered(pages, [F.col("u"), F.col("page_id")]).select("page_id", "place")
