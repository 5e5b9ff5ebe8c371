"""Queries over signals and tables of sizes that the small tables do not have."""

import json

import duckdb
import numpy as np
import pandas as pd
import pytest

from tessella.functions import dsp
from tessella.plans import signal_queries as _registered  # noqa: F401
from tessella.plans import registry

from .test_oracles import rows


@pytest.fixture(scope="module")
def signals(tmp_path_factory):
    """A folder with events of users of few and of many samples."""
    folder = tmp_path_factory.mktemp("signals")
    users = np.repeat([1, 2, 3, 4, 5], [31, 39, 40, 41, 10_500])
    value = np.random.default_rng(5).integers(1, 49_000, len(users)) / 100
    pd.DataFrame({"event_id": np.arange(len(users)), "user_id": users, "value": value}).to_parquet(folder / "events.parquet")
    return str(folder)


def equals_sql(spark, folder, name, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    found, expected = registry.QUERIES[name](spark, folder).toPandas(), con.execute(registry.ORACLES[name]).df()
    assert len(found) and rows(found) == rows(expected)


def test_crossfades_of_short_signals(spark, signals):
    equals_sql(spark, signals, "crossfades", "events")


def test_loops_keep_their_length_where_the_signal_ends():
    x = np.arange(1.0, 101.0)[:, None]
    ends = [(0, 8), (0, 4)]
    for a, b in zip(dsp.loops(x, 10, ends, 10), (x[:80], x[:40])):
        np.testing.assert_array_equal(a, dsp.crossfade_loop(b, 10))
    assert [len(y) for y in dsp.loops(x, 10, [(2, 11), (3, 3), (2, 20)], 20)] == [60, 60]
    part, lacking = dsp.loops(x, 10, [(2, 11), (2, 20)], 20, whole=True)
    np.testing.assert_array_equal(part, dsp.crossfade_loop(x[20:], 10))  # of the 20 samples behind the loop, 10 are there
    assert len(lacking) == 160 and (lacking[:80] == x[20:]).all() and not lacking[80:].any()
    np.testing.assert_array_equal(dsp.loops(x, 10, [(2, 8)], 10, whole=True)[0], dsp.crossfade_loop(x[20:80], 10))
    assert len(dsp.pieces(x, 10, [(2, float("inf"))])[0]) == 80


def test_clips_of_short_and_long_signals(spark, signals):
    equals_sql(spark, signals, "preview_clips", "events")
    equals_sql(spark, signals, "previews", "events")


def test_pieces_of_short_and_long_signals(spark, signals):
    equals_sql(spark, signals, "wav_pieces", "events")


def test_small_files_are_read_once_and_together(spark, signals, tmp_path):
    from tessella.operators import analysis
    from tessella.sources import audio

    for k in range(1200):
        (tmp_path / f"u{k}.wav").write_bytes(audio.wav_bytes(np.full(20, (k + 1) / 2000), 1000))
    files = audio.scan(spark, str(tmp_path))
    assert files.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism and files.count() == 1200
    out, sizes = analysis.per_file(files.coalesce(1), lambda path, row: [(row.path,)], "path string"), []

    def frames(batches):
        for rows in batches:
            yield pd.DataFrame({"n": [len(rows)]})

    assert out.distinct().count() == 1200
    sizes = [r.n for r in out.mapInPandas(frames, "n long").collect()]
    assert sum(sizes) == 1200 and len(sizes) < 12
    found = analysis.analysed(files, loudness=False)
    assert found.where("size(levels) = 1 AND error IS NULL").count() == 1200


def test_files_of_chops_are_read_once(spark, signals):
    calls = spark.sparkContext.accumulator(0)
    from tessella.operators import analysis

    plain = analysis.per_file

    def counted(df, function, schema):
        def one(path, row):
            calls.add(1)
            return function(path, row)

        return plain(df, one, schema)

    analysis.per_file = counted
    try:
        equals_sql(spark, signals, "wav_chops", "events")
    finally:
        analysis.per_file = plain
    assert calls.value == 5


def test_threshold_counts_bins_in_one_pass(spark):
    from tessella.operators import segments

    rng = np.random.default_rng(3)
    lists = [rng.uniform(-110, 5, 400).tolist(), [-99.5, -100.0], [*rng.normal(-20, 3, 200), *rng.normal(-80, 3, 200)], [-45.0] * 3, [*rng.normal(-20, 3, 300), *rng.normal(-63, 1, 100)]]
    series = spark.createDataFrame([(k, i, float(v)) for k, x in enumerate(lists) for i, v in enumerate(x)], "path long, idx long, level double")

    def expected(x):
        usable = [v for v in x if v > -99]
        if not usable:
            return -60.0
        n = np.bincount([min(int(np.floor(v)) + 90, 89) for v in usable if -90 <= v <= 0], minlength=90)
        three = np.convolve(n, [1, 1, 1], "same")
        found = sorted((int(t), b - 89.5) for b, t in enumerate(three) if -70 <= b - 89.5 <= max(usable) - 10)
        clip = lambda v: min(max(v, -68.0), -50.0)
        if len(found) < 3:
            return clip(min(-60.0, max(usable) - 15))
        return clip(found[0][1]) if found[0][0] <= 0.006 * len(usable) else -60.0

    found = segments.suggest_threshold(series, ["path"])
    assert {r.path: r.threshold for r in found.collect()} == {k: expected(x) for k, x in enumerate(lists)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan


def test_a_catalog_file_is_read_by_many_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    from tessella import schema
    from tessella.sources import stores

    kinds = dict(f.strip().split(" ") for f in schema.CATALOG.split(","))
    values = {"path": F.concat(F.lit("ä/"), F.col("id").cast("string")), "filename": F.lit('"files": [{"'), "size": F.col("id"), "description": F.lit(']}, {"library_root": "x"} \x85')}
    rows = spark.range(3000).select(*(values.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items()))
    target, size = str(tmp_path / "index.json"), spark.conf.get("spark.sql.files.maxPartitionBytes")
    expected = sorted(map(tuple, rows.collect()))
    stores.write_catalog_json(rows, target, 'a "root"\\ä')
    (tmp_path / "old.json").write_text(json.dumps(json.loads((tmp_path / "index.json").read_text())))  # of an older program: one line
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        back = stores.read_catalog_json(spark, target)
        assert back.rdd.getNumPartitions() > 4
        assert sorted(map(tuple, back.collect())) == expected
        old = stores.read_catalog_json(spark, str(tmp_path / "old.json"))
        assert old.columns == back.columns and sorted(map(tuple, old.collect())) == expected
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    text = (tmp_path / "index.json").read_text()
    stores.write_text(spark, target, text.replace(json.loads(text)["generated"], "2001-02-03 04:05:06"))
    for root in ("/a", "/b"):
        stores.write_catalog_json(rows.limit(2), target, root)
        kept = json.loads((tmp_path / "index.json").read_text())
        assert (kept["generated"], kept["count"], kept["library_root"], len(kept["files"])) == ("2001-02-03 04:05:06", 2, root, 2)


def test_an_incremental_scan_joins_each_side_once(spark):
    from pyspark.sql import functions as F

    from tessella.operators import catalog

    kind = "path string, size long, mtime double"
    files = spark.createDataFrame([("same", 1, 1.0), ("size", 2, 1.0), ("mtime", 1, 2.0), ("new", 1, 1.0), ("null", None, 1.0), ("twice", 3, 3.0)], kind)
    cache = spark.createDataFrame([("same", 1, 1.0), ("size", 1, 1.0), ("mtime", 1, 1.0), ("gone", 1, 1.0), ("null", None, 1.0), ("twice", 3, 3.0), ("twice", 4, 3.0)], kind).withColumn("value", F.lit("cached"))
    now = catalog.incremental(files, cache, lambda some: some.withColumn("value", F.lit("parsed")))
    assert sorted((r.path, r.size, r.value) for r in now.collect() if r.path != "null") == [("mtime", 1, "parsed"), ("new", 1, "parsed"), ("same", 1, "cached"), ("size", 2, "parsed"), ("twice", 3, "cached")]
    assert [r.value for r in now.where("path = 'null'").collect()] == ["parsed"]
    assert now._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2
