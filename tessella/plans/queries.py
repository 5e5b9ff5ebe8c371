"""The catalog engine's operators over the driver's tables, each with the same computation in DuckDB SQL.

Tables stand in for a catalog by shape: documents and parts are records, labels and orders sidecars, events level series
and edit logs, embeddings vector stores, pages paths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import columns as C
from tessella.operators import catalog, edits, keywords, segments, vectors, view
from tessella.plans.registry import register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def series(spark: SparkSession, folder: str) -> DataFrame:
    """Each user's event values in time as a level series from -90 to 0 dB: (user_id, idx, level)."""
    events = table(spark, folder, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    level = F.least(F.greatest(F.col("value") / 5.0 - 90.0, F.lit(-90.0)), F.lit(0.0))
    return events.select("user_id", (F.row_number().over(order) - 1).cast("long").alias("idx"), level.alias("level"))


SERIES = """
series AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
  least(greatest(value / 5.0::DOUBLE - 90.0::DOUBLE, -90.0::DOUBLE), 0.0::DOUBLE) AS level FROM events)"""


def segments_sql(keys: str, source: str, threshold: str, gap: str, sound: str) -> str:
    """CTEs that end in ``found`` (keys, start, end)."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    return f"""
sizes AS (SELECT {keys}, max(idx) + 1 AS n FROM {source} GROUP BY {keys}),
loud AS (SELECT {keys}, idx, {gap} AS gap, {sound} AS sound, lag(idx) OVER (PARTITION BY {keys} ORDER BY idx) AS before FROM {source} WHERE level >= {threshold}),
marked AS (SELECT *, CASE WHEN before IS NULL OR idx - before > gap THEN 1 ELSE 0 END AS new FROM loud),
islands AS (SELECT *, sum(new) OVER (PARTITION BY {keys} ORDER BY idx) AS island FROM marked),
runs AS (SELECT {keys}, island, min(idx) AS first, max(idx) + 1 AS last, any_value(gap) AS gap, any_value(sound) AS sound FROM islands GROUP BY {keys}, island),
ended AS (SELECT {", ".join("a." + k for k in keys.split(", "))}, first, CASE WHEN n - last < gap THEN n ELSE last END AS last, sound FROM runs a JOIN sizes b ON {on}),
found AS (SELECT {keys}, first AS "start", last AS "end" FROM ended WHERE last - first >= sound)"""


@register("view_text_filter", """
SELECT d.doc_id, lang, source, n_chars, coalesce(quality, 0) AS quality, coalesce(toxic, -1) AS toxic,
  row_number() OVER (ORDER BY source_key, d.doc_id) AS place
FROM (SELECT *, array_to_string(list_transform(regexp_extract_all(lower(coalesce(source, '')), '[0-9]+|[^0-9]+'), lambda t: CASE WHEN regexp_matches(t, '^[0-9]') THEN lpad(length(ltrim(t, '0'))::VARCHAR, 10, '0') || ltrim(t, '0') ELSE t END), '') AS source_key FROM documents) d
LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id
WHERE contains(lower(concat_ws(' ', coalesce(text, ''), coalesce(lang, ''), coalesce(source, ''))), 'the') AND contains(lower(concat_ws(' ', coalesce(text, ''), coalesce(lang, ''), coalesce(source, ''))), 'src1')
  AND n_chars BETWEEN 200 AND 5000
""")
def view_text_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Every row of a view with its place: text terms, a range, sidecar defaults and natural sort."""
    labels = table(spark, folder, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    spec = view.ViewSpec(text="the src1", text_fields=("text", "lang", "source"), ranges={"n_chars": (200, 5000)}, sort="source")
    # Predicates reach the scan below the join; texts end there.
    shown = view.matching(table(spark, folder, "documents"), spec).drop("text").join(labels, "doc_id", "left")
    values = shown.select("doc_id", "lang", "source", "n_chars", F.coalesce("quality", F.lit(0)).alias("quality"), F.coalesce("toxic", F.lit(-1)).alias("toxic"))
    return view.numbered(values, [view.sort_key(values, spec.sort), F.col("doc_id")])


@register("view_column_filters", """
SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part
WHERE contains(lower(p_name), 'a') AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#21', 'Brand#23', 'Brand#5') AND p_size BETWEEN 5 AND 40
""")
def view_column_filters(spark: SparkSession, folder: str) -> DataFrame:
    """A substring, ticked values and an inclusive range."""
    spec = view.ViewSpec(contains={"p_name": " A "}, allowed={"p_brand": frozenset(["Brand#11", "Brand#12", "Brand#21", "Brand#23", "Brand#5", ""])}, ranges={"p_size": (5, 40)})
    return view.apply(table(spark, folder, "part"), spec, key="p_partkey").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")


@register("view_full_range", "SELECT p_partkey, p_size FROM part")
def view_full_range(spark: SparkSession, folder: str) -> DataFrame:
    """A range as wide as the data is no filter."""
    part = table(spark, folder, "part")
    low, high = view.column_range(part, "p_size").first()
    return view.apply(part, view.ViewSpec(ranges={"p_size": (low, high)}), "p_partkey", {"p_size": (low, high)}).select("p_partkey", "p_size")


@register("view_sidecar_join", """
SELECT d.doc_id AS path, source, coalesce(quality, 0) AS rating, coalesce(toxic, 0) AS plays, coalesce(CASE WHEN toxic = 1 THEN 'toxic' END, '') AS tags,
  CASE WHEN toxic = 1 AND quality = 1 THEN -40.0::DOUBLE END AS silence_db, CASE WHEN toxic = 1 AND quality = 1 THEN 0.5::DOUBLE END AS min_gap_s, CASE WHEN toxic = 1 THEN 3 END AS chops,
  CASE WHEN toxic = 1 THEN quality = 0 END AS continuous, CASE WHEN quality = 1 THEN -20.0::DOUBLE + 2.5 END AS final_db
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""")
def view_sidecar_join(spark: SparkSession, folder: str) -> DataFrame:
    """A catalog with its user data, chop parameters and loudness, and the stand-ins of what is missing."""
    records = table(spark, folder, "documents").select(F.col("doc_id").alias("path"), "source")
    labels, toxic, good = table(spark, folder, "labels").withColumnRenamed("doc_id", "path"), F.col("toxic") == 1, F.col("quality") == 1
    user = labels.select("path", F.col("quality").alias("rating"), F.col("toxic").alias("plays"), F.when(toxic, "toxic").alias("tags"), F.when(good, 2.5).alias("gain_db"), F.lit(1).alias("size"))
    chops = labels.where(toxic).select("path", F.when(good, -40.0).alias("silence_db"), F.lit(0.5).alias("min_gap_s"), F.lit(0.3).alias("min_sound_s"), F.lit(3).alias("chops"), (~good).alias("continuous"))
    loud = labels.where(good).select("path", F.lit(-20.0).alias("lufs"), F.lit(1).alias("size"))
    joined = catalog.with_sidecars(records, user, chops, loud)
    return joined.select("path", "source", "rating", "plays", "tags", "silence_db", "min_gap_s", "chops", "continuous", "final_db")


@register("tracklist_enrich", """
SELECT l_orderkey, l_linenumber, 'Bundle ' || l_returnflag AS bundle, coalesce(nullif(CASE WHEN p_size > 25 THEN p_brand ELSE '' END, ''), 'Lib' || l_linenumber) AS library,
  coalesce(nullif(p_type, ''), 'Sup ' || l_linestatus) AS supplier, CASE WHEN p_partkey % 2 = 0 THEN 'http://x/' || p_partkey ELSE '' END AS url
FROM (SELECT * FROM lineitem) LEFT JOIN (SELECT * FROM part WHERE p_size % 5 <> 0) ON l_partkey = p_partkey
""")
def tracklist_enrich(spark: SparkSession, folder: str) -> DataFrame:
    """Files with their tracklist's library, supplier and link, or their folder's where that has none."""
    name = lambda key: F.concat(F.lit("snd"), F.col(key).cast("string"), F.lit(".wav"))
    part = table(spark, folder, "part").where("p_size % 5 <> 0")
    listed = part.select(F.upper(name("p_partkey")).alias("filename"), F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise("").alias("library"), F.col("p_type").alias("supplier"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("http://x/"), F.col("p_partkey").cast("string"))).alias("url"))
    own = F.concat(F.lit("Sup "), "l_linestatus", F.lit(" - Lib"), F.col("l_linenumber").cast("string"), F.lit("_"))
    files = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", name("l_partkey").alias("filename"), F.concat_ws("/", F.concat(F.lit("Bundle "), "l_returnflag"), own, name("l_partkey")).alias("path"))
    return catalog.enrich(files, listed).select("l_orderkey", "l_linenumber", "bundle", "library", "supplier", "url")


@register("only_missing", "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def only_missing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source")
    return catalog.without(docs, table(spark, folder, "labels"), "doc_id")


@register("only_missing_any", """
SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'O')
  OR NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'F')
""")
def only_missing_any(spark: SparkSession, folder: str) -> DataFrame:
    """Records that at least one of two stores lacks."""
    orders = table(spark, folder, "orders")
    stores = [orders.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("c_custkey")) for s in "OF"]
    return catalog.missing(table(spark, folder, "customer").select("c_custkey", "c_name"), *stores, key="c_custkey")


@register("targeted", "SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def targeted(spark: SparkSession, folder: str) -> DataFrame:
    paths = table(spark, folder, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return catalog.targeted(table(spark, folder, "customer").select("c_custkey", "c_acctbal"), paths, "c_custkey")


@register("upsert_latest", """
WITH new AS (SELECT user_id AS key, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT key, value FROM new UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT key FROM new)
""")
def upsert_latest(spark: SparkSession, folder: str) -> DataFrame:
    """The latest event of each user over the customers' balances."""
    events = table(spark, folder, "events").select(F.col("user_id").alias("key"), "ts", "event_id", "value")
    old = table(spark, folder, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"))
    return catalog.upsert(old, catalog.latest(events, ["key"], ["ts", "event_id"]).select("key", "value"), "key")


@register("incremental_split", """
SELECT o.o_orderkey, coalesce(o.o_totalprice = l.total AND o.o_custkey = l.part, false) AS reused FROM orders o
LEFT JOIN (SELECT l_orderkey, max(l_partkey) AS part, max(l_extendedprice) AS total FROM lineitem GROUP BY 1) l ON l.l_orderkey = o.o_orderkey
""")
def incremental_split(spark: SparkSession, folder: str) -> DataFrame:
    """Which records may be taken from the cache: same size and time."""
    files = table(spark, folder, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_totalprice").alias("size"), F.col("o_custkey").alias("mtime"))
    cache = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("path")).agg(F.max("l_extendedprice").alias("size"), F.max("l_partkey").alias("mtime"))
    return catalog.split_reused(files, cache).select(F.col("path").alias("o_orderkey"), "reused")


@register("merge_vectors", """
SELECT vec_id, label FROM (SELECT vec_id, label + 100 AS label FROM embeddings WHERE label < 3 UNION ALL SELECT vec_id, label FROM embeddings WHERE label >= 3)
WHERE vec_id IN (SELECT p_partkey FROM part)
""")
def merge_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """New vectors win, and only those of the present catalog stay."""
    old = table(spark, folder, "embeddings").select("vec_id", "label")
    new = old.where("label < 3").withColumn("label", F.col("label") + 100)
    return catalog.merge_vectors(old, new, table(spark, folder, "part").select(F.col("p_partkey").alias("vec_id")), "vec_id")


STOP_SQL = ", ".join(f"'{w}'" for w in keywords.STOPWORDS)


@register("keyword_df", f"""
WITH tokens AS (SELECT DISTINCT source, lang, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents)
SELECT token, count(*) AS n FROM tokens WHERE length(token) >= 2 AND NOT regexp_matches(token, '^[0-9]+$') AND token NOT IN ({STOP_SQL}) GROUP BY token
""")
def keyword_df(spark: SparkSession, folder: str) -> DataFrame:
    """In how many libraries (source and language) each keyword occurs."""
    return keywords.document_frequency(table(spark, folder, "documents"), ["source", "lang"], ["text"])


NATURAL_SQL = "array_to_string(list_transform(regexp_extract_all(lower({0}), '[0-9]+|[^0-9]+'), lambda t: CASE WHEN regexp_matches(t, '^[0-9]') THEN lpad(length(ltrim(t, '0'))::VARCHAR, 10, '0') || ltrim(t, '0') ELSE t END), '')"


@register("keyword_top", f"""
WITH tokens AS (SELECT DISTINCT p_brand, unnest(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9]+')) AS token FROM part),
counted AS (SELECT token, count(*) AS n FROM tokens WHERE length(token) >= 2 AND NOT regexp_matches(token, '^[0-9]+$') AND token NOT IN ({STOP_SQL}) GROUP BY token)
SELECT token, n, row_number() OVER (ORDER BY n DESC, {NATURAL_SQL.format("token")}, token) AS place FROM counted QUALIFY place <= 500
""")
def keyword_top(spark: SparkSession, folder: str) -> DataFrame:
    """The keyword panel: the 500 commonest, ties in natural order."""
    top = keywords.keywords(table(spark, folder, "part"), ["p_brand"], ["p_name", "p_type"])
    order = Window.orderBy(F.desc("n"), C.natural_key(F.col("token")), "token")
    return top.select("token", "n", F.row_number().over(order).alias("place"))


@register("natural_sort", f"SELECT p_partkey, p_brand, dense_rank() OVER (ORDER BY {NATURAL_SQL.format('p_brand')}) AS place FROM part")
def natural_sort(spark: SparkSession, folder: str) -> DataFrame:
    """Brands in natural order: distinct keys are numbered in a range sort, then joined."""
    part = table(spark, folder, "part").select("p_partkey", "p_brand", C.natural_key(F.col("p_brand")).alias("key"))
    places = view.numbered(part.select("key").distinct(), [F.col("key")])
    return part.join(places, "key").select("p_partkey", "p_brand", "place")


@register("distinct_values", f"SELECT p_type AS value, row_number() OVER (ORDER BY {NATURAL_SQL.format('p_type')}, p_type) AS place FROM (SELECT DISTINCT p_type FROM part WHERE p_type <> '')")
def distinct_values(spark: SparkSession, folder: str) -> DataFrame:
    return view.distinct_values(table(spark, folder, "part"), "p_type")


@register("filter_kinds", """
SELECT * FROM (VALUES ('p_size', 'range'), ('p_retailprice', 'range')) t(name, kind)
UNION ALL SELECT 'p_brand', CASE WHEN count(DISTINCT p_brand) <= 25 THEN 'tick' ELSE 'text' END FROM part WHERE p_brand <> ''
UNION ALL SELECT 'p_name', CASE WHEN count(DISTINCT p_name) <= 25 THEN 'tick' ELSE 'text' END FROM part WHERE p_name <> ''
""")
def filter_kinds(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    return spark.createDataFrame([(c, view.filter_kind(part, c)) for c in ("p_size", "p_retailprice", "p_brand", "p_name")], "name string, kind string")


@register("column_range", "SELECT min(p_retailprice) AS low, max(p_retailprice) AS high FROM part")
def column_range(spark: SparkSession, folder: str) -> DataFrame:
    return view.column_range(table(spark, folder, "part"), "p_retailprice")


@register("global_counts", """
SELECT count(*) AS records, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality IS NULL) AS missing, count(*) FILTER (n_chars > 1000) AS long FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def global_counts(spark: SparkSession, folder: str) -> DataFrame:
    joined = table(spark, folder, "documents").select("doc_id", "n_chars").join(table(spark, folder, "labels"), "doc_id", "left")
    return catalog.counted(joined, {"good": F.col("quality") == 1, "missing": F.col("quality").isNull(), "long": F.col("n_chars") > 1000})


@register("gap_segments", f"""
WITH {SERIES.strip()}, {segments_sql("user_id", "series", "-45.0::DOUBLE", "3", "1")} SELECT user_id, "start", "end" FROM found
""")
def gap_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Sounds in each user's series."""
    return segments.gap_segments(series(spark, folder), ["user_id"], F.lit(-45.0), F.lit(3), F.lit(1))


@register("segment_counts", f"""
WITH {SERIES.strip()}, {segments_sql("user_id", "series", "-20.0::DOUBLE", "2", "3")}
SELECT s.user_id, count(f.user_id) AS sounds, greatest(count(f.user_id) - 1, 0) AS gaps FROM (SELECT DISTINCT user_id FROM series) s LEFT JOIN found f ON s.user_id = f.user_id GROUP BY s.user_id
""")
def segment_counts(spark: SparkSession, folder: str) -> DataFrame:
    s = series(spark, folder)
    return segments.counts(segments.gap_segments(s, ["user_id"], F.lit(-20.0), F.lit(2), F.lit(3)), s, ["user_id"])


@register("why_empty", f"""
WITH {SERIES.strip()}, {segments_sql("user_id", "series", "-20.0::DOUBLE", "2", "0")}
SELECT s.user_id, count(*) FILTER ("end" - "start" >= 6) AS sounds, CASE WHEN count(*) FILTER ("end" - "start" >= 6) = 0 THEN count(f.user_id) ELSE 0 END AS too_short
FROM (SELECT DISTINCT user_id FROM series) s LEFT JOIN found f ON s.user_id = f.user_id GROUP BY s.user_id
""")
def why_empty(spark: SparkSession, folder: str) -> DataFrame:
    return segments.why_empty(series(spark, folder), ["user_id"], F.lit(-20.0), F.lit(2), F.lit(6))


HISTOGRAM_SQL = f"""
WITH {SERIES.strip()}, usable AS (SELECT user_id % 10 AS grp, level FROM series WHERE level > -99),
bins AS (SELECT grp, least(floor(level)::INT + 90, 89) AS bin, count(*) AS n FROM usable WHERE level BETWEEN -90 AND 0 GROUP BY 1, 2)"""


@register("level_histogram", HISTOGRAM_SQL + " SELECT grp, bin, n FROM bins")
def level_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return segments.histogram(series(spark, folder).withColumn("grp", F.col("user_id") % 10), ["grp"])


@register("histogram_valley", HISTOGRAM_SQL + """,
totals AS (SELECT grp, count(*) AS n, max(level) AS peak FROM usable GROUP BY grp),
dense AS (SELECT t.grp, s.bin, coalesce(b.n, 0) AS n FROM totals t CROSS JOIN (SELECT unnest(range(90)) AS bin) s LEFT JOIN bins b ON b.grp = t.grp AND b.bin = s.bin),
smooth AS (SELECT grp, bin - 89.5::DOUBLE AS centre, sum(n) OVER (PARTITION BY grp ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS three FROM dense),
best AS (SELECT s.grp, count(*) AS candidates, arg_min(struct_pack(three := three, centre := centre), three * 1000 + centre + 100) AS b FROM smooth s JOIN totals t ON s.grp = t.grp WHERE centre >= -70 AND centre <= peak - 10 GROUP BY s.grp)
SELECT t.grp, CASE WHEN coalesce(candidates, 0) < 3 THEN least(greatest(least(-60.0::DOUBLE, peak - 15), -68), -50)
  WHEN b.three <= 0.006::DOUBLE * n THEN least(greatest(b.centre, -68), -50) ELSE -60.0::DOUBLE END AS threshold FROM totals t LEFT JOIN best USING (grp)
""")
def histogram_valley(spark: SparkSession, folder: str) -> DataFrame:
    """A threshold for each group of series."""
    return segments.suggest_threshold(series(spark, folder).withColumn("grp", F.col("user_id") % 10), ["grp"])


@register("percentiles", """
SELECT event_type, floor(quantile_cont(value, 0.05) * 1e6 + 0.5) / 1e6 AS p5, floor(quantile_cont(value, 0.5) * 1e6 + 0.5) / 1e6 AS p50,
  floor(quantile_cont(value, 0.9) * 1e6 + 0.5) / 1e6 AS p90, floor(quantile_cont(value, 0.95) * 1e6 + 0.5) / 1e6 AS p95 FROM events GROUP BY event_type
""")
def percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Exact, interpolated percentiles."""
    at = {f"p{round(q * 100)}": q for q in (0.05, 0.5, 0.9, 0.95)}
    found = segments.quantiles(table(spark, folder, "events"), ["event_type"], "value", "event_id", at)
    return found.select("event_type", *(C.half_up(F.col(n), 6).alias(n) for n in at))


@register("frame_rms", """
WITH samples AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, value / 500.0::DOUBLE AS x FROM events),
frames AS (SELECT event_type, i // 50 AS frame_idx, avg(x * x) AS ms, count(*) AS n FROM samples GROUP BY 1, 2)
SELECT event_type, frame_idx, floor(20.0::DOUBLE * log10(sqrt(ms) + 1e-9::DOUBLE) * 1e6 + 0.5) / 1e6 AS level FROM frames WHERE n = 50 OR frame_idx = 0
""")
def frame_rms(spark: SparkSession, folder: str) -> DataFrame:
    """RMS levels of whole frames of 50 samples; the few types are numbered in a range sort."""
    samples = view.numbered_within(table(spark, folder, "events").select("event_type", "event_id", (F.col("value") / 500.0).alias("x")), ["event_type"], [F.col("event_id")])
    found = segments.frame_rms(samples, ["event_type"], 50, keep_tail=False)
    return found.withColumn("level", C.half_up(F.col("level"), 6))


@register("peak_level", "SELECT event_type, floor(20.0::DOUBLE * log10(greatest(max(abs(value / 500.0::DOUBLE)), 1e-12::DOUBLE)) * 1e2 + 0.5) / 1e2 AS peak_db FROM events GROUP BY event_type")
def peak_level(spark: SparkSession, folder: str) -> DataFrame:
    found = table(spark, folder, "events").groupBy("event_type").agg(F.max(F.abs(F.col("value") / 500.0)).alias("p"))
    return found.select("event_type", C.half_up(C.peak_db(F.col("p")), 2).alias("peak_db"))


@register("sliding_rms", """
WITH samples AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, value AS x FROM events),
w AS (SELECT user_id, i, avg(x * x) OVER o AS ms, count(*) OVER o AS n FROM samples WINDOW o AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING))
SELECT user_id, i, floor(sqrt(ms) * 1e6 + 0.5) / 1e6 AS rms FROM w WHERE n = 8 AND i % 3 = 0
""")
def sliding_rms(spark: SparkSession, folder: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("event_id")
    samples = table(spark, folder, "events").select("user_id", (F.row_number().over(order) - 1).cast("long").alias("i"), F.col("value").alias("x"))
    return segments.sliding_rms(samples, ["user_id"], 8, 3).withColumn("rms", C.half_up(F.col("rms"), 6))


@register("param_sweep", f"""
WITH {SERIES.strip()}, peaks AS (SELECT user_id, max(level) AS peak FROM series GROUP BY user_id),
kinds(kind, base, rel) AS (VALUES ('-55', -55.0::DOUBLE, 0), ('-60', -60.0, 0), ('-65', -65.0, 0), ('peak-30', -30.0, 1), ('peak-40', -40.0, 1)),
grid AS (SELECT user_id, kind AS threshold_kind, gap_s, base + rel * peak AS threshold FROM peaks, kinds, (VALUES (0.5::DOUBLE), (1.0), (2.0)) g(gap_s)),
every AS (SELECT s.user_id, threshold_kind, gap_s, idx, level, threshold FROM series s JOIN grid g ON s.user_id = g.user_id),
{segments_sql("user_id, threshold_kind, gap_s", "every", "threshold", "greatest(1, round_even(gap_s / 0.5, 0))", "1.0")}
SELECT g.user_id, g.threshold_kind, g.gap_s, count(f.user_id) AS sounds FROM grid g LEFT JOIN found f ON g.user_id = f.user_id AND g.threshold_kind = f.threshold_kind AND g.gap_s = f.gap_s GROUP BY 1, 2, 3
""")
def param_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """Sounds in each series under fifteen parameter sets."""
    s = series(spark, folder)
    return segments.sweep(s, ["user_id"], s.groupBy("user_id").agg(F.max("level").alias("peak")), 0.5, 0.5)


@register("plateau", f"""
WITH {SERIES.strip()}, limits AS (SELECT user_id, quantile_cont(level, 0.9) - 6.0 AS low FROM series GROUP BY user_id),
loud AS (SELECT s.user_id, idx, idx - row_number() OVER (PARTITION BY s.user_id ORDER BY idx) AS island FROM series s JOIN limits l ON s.user_id = l.user_id WHERE level > low),
runs AS (SELECT user_id, min(idx) AS s, max(idx) AS e FROM loud GROUP BY user_id, island)
SELECT user_id, s AS "start", e AS "end" FROM runs QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY e - s DESC, s) = 1
""")
def plateau(spark: SparkSession, folder: str) -> DataFrame:
    """The longest loud run of each series."""
    return segments.plateau(series(spark, folder), ["user_id"])


@register("regular_runs", """
WITH o AS (SELECT user_id, epoch_us(ts) AS t FROM events), g AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS gap FROM o),
r AS (SELECT *, sum(CASE WHEN gap BETWEEN 36000000000 * 0.6 AND 36000000000 * 1.6 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY t) AS run FROM g),
n AS (SELECT user_id, run, min(t) AS first, max(t) AS last, count(*) AS n FROM r GROUP BY user_id, run)
SELECT user_id, first, last, n FROM n QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) = 1
""")
def regular_runs(spark: SparkSession, folder: str) -> DataFrame:
    onsets = table(spark, folder, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return segments.regular_runs(onsets, ["user_id"], F.lit(36_000_000_000))


@register("rolloff", """
WITH b AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS bin, floor(value) AS m FROM events),
c AS (SELECT user_id, bin, sum(m) OVER (PARTITION BY user_id ORDER BY bin) AS s, sum(m) OVER (PARTITION BY user_id) AS a FROM b)
SELECT user_id, min(bin) AS bin FROM c WHERE s >= a * 0.85::DOUBLE GROUP BY user_id
""")
def rolloff(spark: SparkSession, folder: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("event_id")
    spectra = table(spark, folder, "events").select("user_id", (F.row_number().over(order) - 1).cast("long").alias("bin"), F.floor("value").cast("double").alias("magnitude"))
    return segments.rolloff(spectra, ["user_id"])


@register("clamp_edit", """
WITH s AS (SELECT conv_id, turn AS ordinal, turn * 100 AS s, turn * 100 + 60 AS e, turn * 100 + length(text) % 200 - 100 AS ns, turn * 100 + 60 + length(text) % 150 - 50 AS ne FROM conversations),
w AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY conv_id ORDER BY ordinal), 0) AS low, coalesce(lead(s) OVER (PARTITION BY conv_id ORDER BY ordinal), 1000000) AS high FROM s)
SELECT conv_id, ordinal, least(greatest(ns, low), e - 1) AS clamped_start, greatest(least(ne, high), s + 1) AS clamped_end FROM w
""")
def clamp_edit(spark: SparkSession, folder: str) -> DataFrame:
    """Edited boundaries kept between their neighbours."""
    size = F.length("text")
    turns = table(spark, folder, "conversations").select(
        "conv_id", F.col("turn").alias("ordinal"), (F.col("turn") * 100).alias("start"), (F.col("turn") * 100 + 60).alias("end"),
        (F.col("turn") * 100 + size % 200 - 100).alias("new_start"), (F.col("turn") * 100 + 60 + size % 150 - 50).alias("new_end"),
    )
    return segments.clamp_edit(turns, ["conv_id"], F.lit(1_000_000).cast("long")).select("conv_id", "ordinal", "clamped_start", "clamped_end")


@register("timeline_concat", """
SELECT conv_id, turn AS ordinal, length(text) AS length, coalesce(sum(length(text) + 100) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM conversations
""")
def timeline_concat(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces one after another, with silence between them."""
    pieces = table(spark, folder, "conversations").select("conv_id", F.col("turn").alias("ordinal"), F.length("text").cast("long").alias("length"))
    return segments.timeline(pieces, ["conv_id"], 100)


@register("interval_lookup", """
WITH m AS (SELECT conv_id, turn, turn * 0.1::DOUBLE AS p0, turn * 0.1::DOUBLE + 0.08 AS p1, turn * 10.0::DOUBLE AS v0, turn * 10.0::DOUBLE + 5 AS v1 FROM conversations),
p AS (SELECT conv_id, turn AS k, (length(text) % 100) / 100.0::DOUBLE AS f FROM conversations),
h AS (SELECT p.conv_id, k, f, m.turn, v0 + (f - p0) / (p1 - p0) * (v1 - v0) AS v FROM p JOIN m ON p.conv_id = m.conv_id AND f BETWEEN p0 AND p1 QUALIFY row_number() OVER (PARTITION BY p.conv_id, k ORDER BY m.turn) = 1)
SELECT p.conv_id, p.k, floor(coalesce(v, -1.0) * 1e6 + 0.5) / 1e6 AS value FROM p LEFT JOIN h ON p.conv_id = h.conv_id AND p.k = h.k
""")
def interval_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Points mapped through the first interval that holds them."""
    turns = table(spark, folder, "conversations")
    t = F.col("turn")
    maps = turns.select("conv_id", t.alias("ordinal"), (t * 0.1).alias("p0"), (t * 0.1 + 0.08).alias("p1"), (t * 10.0).alias("v0"), (t * 10.0 + 5).alias("v1"))
    points = turns.select("conv_id", t.alias("k"), ((F.length("text") % 100) / 100.0).alias("f"))
    return segments.interval_lookup(points, maps, ["conv_id"]).select("conv_id", "k", C.half_up(F.col("value"), 6).alias("value"))


@register("cosine_topk", """
WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 0), u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE vec_id <> 0),
s AS (SELECT vec_id, list_dot_product(u.v, list_transform(q.embedding, lambda x: x::DOUBLE)) / (sqrt(list_dot_product(u.v, u.v)) + 1e-9::DOUBLE) / (sqrt(list_dot_product(list_transform(q.embedding, lambda x: x::DOUBLE), list_transform(q.embedding, lambda x: x::DOUBLE))) + 1e-9::DOUBLE) AS c FROM u, q),
r AS (SELECT vec_id, floor(least(greatest(c, 0), 1) * 1e4 + 0.5) / 1e4 AS score FROM s)
SELECT row_number() OVER (ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM r QUALIFY rank <= 50
""")
def cosine_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 vectors most like vector 0."""
    store = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return vectors.similar_by_cosine(store, 0, 50, "vec_id")


@register("similar_zscore", """
WITH e AS (SELECT vec_id, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings),
s AS (SELECT pos, stddev_pop(x) + 1e-9::DOUBLE AS d FROM e GROUP BY pos), q AS (SELECT pos, x FROM e WHERE vec_id = 0),
t AS (SELECT e.vec_id, sqrt(sum(((e.x - q.x) / s.d) * ((e.x - q.x) / s.d))) AS dist FROM e JOIN s ON e.pos = s.pos JOIN q ON e.pos = q.pos WHERE e.vec_id <> 0 GROUP BY e.vec_id),
r AS (SELECT vec_id, floor(1.0 / (1.0 + dist) * 1e4 + 0.5) / 1e4 AS score FROM t)
SELECT row_number() OVER (ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM r QUALIFY rank <= 50
""")
def similar_zscore(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 vectors nearest to vector 0 after standardisation."""
    store = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return vectors.similar_by_distance(store, 0, 50, "vec_id")


@register("standardisation", """
SELECT pos, floor(avg(x) * 1e6 + 0.5) / 1e6 AS mean, floor((stddev_pop(x) + 1e-9) * 1e6 + 0.5) / 1e6 AS deviation
FROM (SELECT unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY pos
""")
def standardisation(spark: SparkSession, folder: str) -> DataFrame:
    stats = vectors.standardisation(table(spark, folder, "embeddings").select(F.col("embedding").alias("vector")))
    flat = stats.select(F.posexplode(F.arrays_zip("means", "deviations")).alias("pos", "s"))
    return flat.select(F.col("pos").cast("long").alias("pos"), C.half_up(F.col("s.means"), 6).alias("mean"), C.half_up(F.col("s.deviations"), 6).alias("deviation"))


@register("ranked_filter", """
WITH q AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE vec_id = 3),
s AS (SELECT vec_id, label, list_dot_product(list_transform(embedding, lambda x: x::DOUBLE), q.v) / (sqrt(list_dot_product(list_transform(embedding, lambda x: x::DOUBLE), list_transform(embedding, lambda x: x::DOUBLE))) + 1e-9::DOUBLE) / (sqrt(list_dot_product(q.v, q.v)) + 1e-9::DOUBLE) AS c FROM embeddings, q WHERE vec_id <> 3),
r AS (SELECT vec_id, label, floor(least(greatest(c, 0), 1) * 1e4 + 0.5) / 1e4 AS score FROM s),
t AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM r QUALIFY rank <= 100) SELECT rank, vec_id, score, label FROM t WHERE label < 4
""")
def ranked_filter(spark: SparkSession, folder: str) -> DataFrame:
    """A filter over a ranked base: applied to the top 100, with the ranks kept."""
    store = table(spark, folder, "embeddings")
    found = vectors.similar_by_cosine(store.select("vec_id", F.col("embedding").alias("vector")), 3, 100, "vec_id")
    return vectors.filtered_ranking(found, store.select("vec_id", "label"), F.col("label") < 4, "vec_id").select("rank", "vec_id", "score", "label")


@register("level_gain", """
WITH p AS (SELECT p_partkey, p_size / 5.0::DOUBLE AS level, CASE WHEN p_size % 7 = 0 THEN NULL ELSE -(p_retailprice / 50.0::DOUBLE) END AS lufs, -(p_size % 12)::DOUBLE AS peak FROM part),
d AS (SELECT *, CASE WHEN level <= 0 THEN -120.0 ELSE -10.0::DOUBLE + 10.0::DOUBLE * log2(level / 10.0) END AS db FROM p)
SELECT p_partkey, floor(db * 1e6 + 0.5) / 1e6 AS level_db, CASE WHEN lufs IS NOT NULL THEN floor(least(greatest(least(db - lufs, -peak), -80.0::DOUBLE), 24.0::DOUBLE) * 10 + 0.5) / 10 END AS gain,
  CASE WHEN lufs IS NOT NULL THEN db - lufs > -peak END AS capped, CASE WHEN lufs IS NOT NULL THEN floor((lufs + floor(least(greatest(least(db - lufs, -peak), -80.0::DOUBLE), 24.0::DOUBLE) * 10 + 0.5) / 10) * 1e6 + 0.5) / 1e6 END AS final_db FROM d
""")
def level_gain(spark: SparkSession, folder: str) -> DataFrame:
    """Gains that bring sounds to their levels without clipping."""
    part = table(spark, folder, "part").select("p_partkey", (F.col("p_size") / 5.0).alias("level"), F.when(F.col("p_size") % 7 != 0, -(F.col("p_retailprice") / 50.0)).alias("lufs"), (-(F.col("p_size") % 12)).cast("double").alias("peak_db"))
    target = C.target_gain(F.col("level"), F.col("lufs"), F.col("peak_db"))
    return part.withColumn("t", target).select("p_partkey", C.half_up(C.level_to_db(F.col("level")), 6).alias("level_db"), F.col("t.gain").alias("gain"), F.col("t.capped").alias("capped"), C.half_up(C.final_db(F.col("lufs"), F.col("t.gain")), 6).alias("final_db"))


@register("gain_functions", """
SELECT p_partkey, floor(least(greatest(10.0::DOUBLE * pow(2.0, ((-p_size)::DOUBLE + 10.0) / 10.0), 0.0), 10.0) * 1e6 + 0.5) / 1e6 AS level,
  floor(CASE WHEN p_size % 3 = 0 THEN 20.0::DOUBLE * log10(p_size / 10.0::DOUBLE) ELSE least(greatest((p_size * 2 - 60)::DOUBLE, -80.0), 24.0) END * 1e6 + 0.5) / 1e6 AS gain,
  floor((CASE WHEN p_size / 50000.0::DOUBLE <= 0.001 THEN -80.0 ELSE 20.0::DOUBLE * log10(p_size / 50000.0::DOUBLE) END + 1.5) * 1e6 + 0.5) / 1e6 AS playback,
  floor(least(greatest((pow(2.0, (-p_size)::DOUBLE / 10.0) - pow(2.0, -9.0)) / (1.0 - pow(2.0, -9.0)), 0.0), 1.0) * 1e6 + 0.5) / 1e6 AS height FROM part
""")
def gain_functions(spark: SparkSession, folder: str) -> DataFrame:
    size = F.col("p_size")
    gain = C.gain_db(F.when(size % 3 != 0, (size * 2 - 60).cast("double")), size / 10.0)
    return table(spark, folder, "part").select("p_partkey", C.half_up(C.db_to_level((-size).cast("double")), 6).alias("level"), C.half_up(gain, 6).alias("gain"), C.half_up(C.playback_db(size / 50000.0, F.lit(1.5)), 6).alias("playback"), C.half_up(C.height((-size).cast("double")), 6).alias("height"))


@register("path_fallback", """
WITH p AS (SELECT page_id, string_split(regexp_replace(url, '^[a-z]+://', ''), '/') AS parts, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages),
s AS (SELECT *, trim(rtrim(coalesce(parts[2], ''), '_')) AS second FROM p)
SELECT page_id, parts[1] AS bundle, CASE WHEN contains(second, ' - ') THEN trim(substr(second, position(' - ' IN second) + 3)) ELSE second END AS library,
  CASE WHEN contains(second, ' - ') THEN trim(string_split(second, ' - ')[1]) ELSE '' END AS supplier, regexp_replace('/lib/' || path, '/[^/]*$', '') AS directory,
  regexp_replace(path, '\\.[^.]*$', '') || '_16bit.wav' AS sibling FROM s
""")
def path_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """Bundle, library and supplier from paths, directories and sibling paths."""
    paths = table(spark, folder, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path")).withColumn("f", C.folder_fallback(F.col("path")))
    return paths.select("page_id", "f.bundle", "f.library", "f.supplier", C.directory("/lib", F.col("path")).alias("directory"), C.sibling_path(F.col("path"), "_16bit.wav").alias("sibling"))


@register("doc_text", """
SELECT p_partkey, concat_ws(' ', nullif(trim(translate(regexp_replace(p_name || '.wav', '\\.[^.]*$', ''), '_-', '  ')), ''), nullif(trim(CASE WHEN p_size > 20 THEN p_type ELSE '' END), ''), nullif(trim(p_brand), '')) AS text FROM part
""")
def doc_text(spark: SparkSession, folder: str) -> DataFrame:
    text = C.doc_text(F.concat("p_name", F.lit(".wav")), F.when(F.col("p_size") > 20, F.col("p_type")).otherwise(""), F.col("p_brand"), F.lit(""))
    return table(spark, folder, "part").select("p_partkey", text.alias("text"))


@register("edit_fold", "SELECT user_id AS path, event_type AS field, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def edit_fold(spark: SparkSession, folder: str) -> DataFrame:
    """The latest value of each field of each record."""
    return edits.folded(table(spark, folder, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("path"), F.col("event_type").alias("field"), "value"))


@register("edit_wide", """
SELECT user_id AS path, arg_max(value, event_id) FILTER (event_type = (SELECT min(event_type) FROM events)) AS first_type, arg_max(value, event_id) FILTER (event_type = (SELECT max(event_type) FROM events)) AS last_type FROM events GROUP BY user_id
""")
def edit_wide(spark: SparkSession, folder: str) -> DataFrame:
    """The log as one row for each record."""
    log = table(spark, folder, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("path"), F.col("event_type").alias("field"), "value")
    low, high = log.agg(F.min("field"), F.max("field")).first()
    return edits.wide(log, [low, high]).select("path", F.col(low).alias("first_type"), F.col(high).alias("last_type"))


@register("play_counts", "SELECT user_id, count(*) AS plays FROM events WHERE value > 100 GROUP BY user_id")
def play_counts(spark: SparkSession, folder: str) -> DataFrame:
    return edits.play_counts(table(spark, folder, "events").withColumn("finished", F.col("value") > 100), "user_id")


@register("delete_anti", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def delete_anti(spark: SparkSession, folder: str) -> DataFrame:
    gone = table(spark, folder, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return catalog.without(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), gone, "o_custkey")


@register("rename_migration", """
SELECT p_partkey, coalesce('moved/' || r.n_name, p_brand) AS path FROM part LEFT JOIN (SELECT 'Brand#' || (n_nationkey + 11) AS old, n_name FROM nation) r ON p_brand = r.old
""")
def rename_migration(spark: SparkSession, folder: str) -> DataFrame:
    """Sidecar keys follow their files' new paths."""
    moves = table(spark, folder, "nation").select(F.concat(F.lit("Brand#"), (F.col("n_nationkey") + 11).cast("string")).alias("old"), F.concat(F.lit("moved/"), "n_name").alias("new"))
    return catalog.rename(table(spark, folder, "part").select("p_partkey", F.col("p_brand").alias("path")), moves)


@register("sibling_paths", r"""
WITH f AS (SELECT 'lib/' || page_id // 2 || CASE WHEN page_id % 2 = 0 THEN '.wav' WHEN page_id % 3 = 0 THEN '.ogg' ELSE '_16bit.wav' END AS path FROM pages)
SELECT f.path, g.path AS sibling FROM f JOIN f g ON g.path = regexp_replace(f.path, '\.[^.]*$', '') || '_16bit.wav' WHERE f.path <> g.path
""")
def sibling_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Every record with its 16-bit sibling: a self-join on stem and suffix."""
    key = F.col("page_id")
    path = F.concat(F.lit("lib/"), F.floor(key / 2).cast("string"), F.when(key % 2 == 0, ".wav").when(key % 3 == 0, ".ogg").otherwise("_16bit.wav"))
    return catalog.siblings(table(spark, folder, "pages").select(path.alias("path")), "_16bit.wav")


@register("selection_toggle", """
WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F')
(SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL (SELECT k FROM b EXCEPT SELECT k FROM a)
""")
def selection_toggle(spark: SparkSession, folder: str) -> DataFrame:
    """The symmetric difference of two selections."""
    orders = table(spark, folder, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus")
    a, b = (orders.where(F.col("o_orderstatus") == s).select("k").distinct() for s in "OF")
    return view.toggle_selection(a, b)


FORMAT_SQL = """
SELECT event_id, CASE WHEN t < 0 THEN '-' ELSE '' END || printf('%d:%02d.%03d', (ms // 60000), (ms // 1000) % 60, ms % 1000) AS time,
  CASE WHEN bytes >= 1048576 THEN printf('%d.%d MB', mb // 10, mb % 10) ELSE printf('%d KB', floor(bytes / 1024.0 + 0.5)::BIGINT) END AS size,
  CASE WHEN rate % 1000 = 0 THEN printf('%d kHz', rate // 1000) ELSE printf('%d.%d kHz', khz // 10, khz % 10) END AS rate,
  CASE WHEN length(digits) >= 4 THEN 'GDC ' || substr(digits, 1, 4) ELSE 'GDC (orig)' END AS bundle
FROM (SELECT event_id, value - 200 AS t, floor(abs(value - 200) * 1000 + 0.5)::BIGINT AS ms, floor(value * 20000)::BIGINT AS bytes,
  floor(floor(value * 20000) / 1048576.0 * 10 + 0.5)::BIGINT AS mb, (event_id % 50) * 500 AS rate, floor((event_id % 50) * 500 / 1000.0 * 10 + 0.5)::BIGINT AS khz,
  regexp_replace(props, '[^0-9]', '', 'g') AS digits FROM events)
"""


@register("format_functions", FORMAT_SQL)
def format_functions(spark: SparkSession, folder: str) -> DataFrame:
    """Display texts of times, sizes, rates and bundles."""
    value = F.col("value")
    return table(spark, folder, "events").select("event_id", C.format_time(value - 200).alias("time"), C.format_size(F.floor(value * 20000)).alias("size"), C.format_rate((F.col("event_id") % 50) * 500).alias("rate"), C.short_bundle(F.col("props")).alias("bundle"))


@register("tokens", "SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS tokens, trim(regexp_replace(text, '[\\x00-\\x1f]', ' ', 'g'), ' ') AS clean FROM benchmark")
def tokens(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select("item_id", C.tokenize(F.col("text")).alias("tokens"), C.clean_text(F.col("text")).alias("clean"))


@register("json_props", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k, json_valid(props) AS valid FROM events")
def json_props(spark: SparkSession, folder: str) -> DataFrame:
    """JSON values read with an explicit type."""
    return table(spark, folder, "events").select("event_id", C.json_number(F.col("props"), "$.k").alias("k"), C.is_json(F.col("props")).alias("valid"))


@register("effective_params", """
SELECT d.doc_id AS path, CASE WHEN toxic = 0 THEN -40.0 - quality ELSE -60.0 - (d.doc_id % 3) END::DOUBLE AS silence_db, CASE WHEN toxic = 0 THEN 0.5 ELSE 1.5 END::DOUBLE AS min_gap_s FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""")
def effective_params(spark: SparkSession, folder: str) -> DataFrame:
    """Saved parameters where there are any, else the suggested threshold and the present setting."""
    saved = table(spark, folder, "labels").select(F.col("doc_id").alias("path"), F.when(F.col("toxic") == 0, F.lit(-40.0) - F.col("quality")).alias("silence_db"), F.lit(0.5).alias("min_gap_s"))
    records = table(spark, folder, "documents").select(F.col("doc_id").alias("path"))
    return catalog.effective_params(records, saved, F.lit(-60.0) - F.col("path") % 3, {"min_gap_s": F.lit(1.5)}).select("path", "silence_db", "min_gap_s")
