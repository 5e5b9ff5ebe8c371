"""Catalog operators on small tables with their edge rows."""

import json
import random

import pytest
from pyspark.sql import functions as F
from tessella import schema
from tessella.functions import columns as C
from tessella.operators import catalog, edits, keywords, segments, vectors, view
from tessella.plans import more_queries as _registered  # noqa: F401
from tessella.plans import registry
from tessella.sources import stores, tracklists


def one(spark, expression):
    return spark.range(1).select(expression).first()[0]


def plain_segments(levels, threshold, gap, sound):
    """The rule as a walk over frames."""
    out, start, quiet = [], None, 0
    for i, x in enumerate(levels):
        if x >= threshold:
            start, quiet = (i if start is None else start), 0
        elif start is not None:
            quiet += 1
            if quiet >= gap:
                out.append((start, i - quiet + 1))
                start = None
    if start is not None:
        out.append((start, len(levels)))
    return [(a, b) for a, b in out if b - a >= sound]


def as_series(spark, lists):
    return spark.createDataFrame([(k, i, float(x)) for k, levels in enumerate(lists) for i, x in enumerate(levels)], "path long, idx long, level double")


def test_segments_equal_a_walk(spark):
    rng = random.Random(1)
    lists = [[rng.choice([-90, -10]) if rng.random() < 0.5 else -10 * rng.random() * 9 for _ in range(rng.randint(1, 60))] for _ in range(80)]
    lists += [[-10] * 50 + [-90] * 120 + [-10] * 50, [-10] * 50 + [-90] * 20 + [-10] * 50, [-10] * 200, [-90] * 30]
    s = as_series(spark, lists)
    for gap, sound in ((1, 0), (3, 2), (75, 0), (4, 2.5)):
        found = {}
        for r in segments.gap_segments(s, ["path"], F.lit(-40.0), F.lit(gap), F.lit(sound)).collect():
            found.setdefault(r.path, []).append((r.start, r.end))
        for k, levels in enumerate(lists):
            assert sorted(found.get(k, [])) == plain_segments(levels, -40, gap, sound)
    seventy_five = segments.gap_segments(s, ["path"], F.lit(-40.0), F.lit(75), F.lit(0))
    counted = {r.path: (r.sounds, r.gaps) for r in segments.counts(seventy_five, s, ["path"]).collect()}
    assert [counted[k] for k in range(80, 84)] == [(2, 1), (1, 0), (1, 0), (0, 0)]
    why = {r.path: (r.sounds, r.too_short) for r in segments.why_empty(s, ["path"], F.lit(-40.0), F.lit(75), F.lit(500)).collect()}
    assert why[80] == (0, 2)


def test_threshold_suggestion(spark):
    lists = [[-9.0] * 100 + [-70.5] * 100, [-100.0] * 10, [-55.0] * 100 + [-54.0] * 100, [-5.0] * 100 + [-80.0] * 100, [-float(k % 90) - 0.5 for k in range(2000)]]
    found = {r.path: r.threshold for r in segments.suggest_threshold(as_series(spark, lists), ["path"]).collect()}
    assert found[0] == -68.0  # the first empty valley over the noise, within the bounds
    assert found[1] == -60.0 and found[2] == -68.0 and found[3] == -68.0 and found[4] == -60.0
    bins = {(r.path, r.bin): r.n for r in segments.histogram(as_series(spark, [[0.0, -0.5, -90.0, -89.5, -91.0, 1.0]]), ["path"]).collect()}
    assert bins == {(0, 89): 2, (0, 0): 2}


def test_frames_and_samples(spark):
    samples = spark.createDataFrame([("a", i, 1.0) for i in range(25)] + [("b", i, 1.0) for i in range(3)], "path string, i long, x double")
    assert sorted((r.path, r.frame_idx) for r in segments.frame_rms(samples, ["path"], 10, False).collect()) == [("a", 0), ("a", 1), ("b", 0)]
    assert segments.frame_rms(samples, ["path"], 10, True).count() == 4
    assert one(spark, segments.frames_of(F.lit(0.25), F.lit(0.1))) == 2 and one(spark, segments.frames_of(F.lit(0.0), F.lit(0.1))) == 1
    parts = spark.createDataFrame([(0, 5), (7, 12)], "start long, end long")
    assert [tuple(r) for r in segments.to_samples(parts, 960, 48000, F.lit(12)).collect()] == [(0, 4800), (6720, 11520)]


def test_effective_segments_and_loops(spark):
    found = F.array(F.struct(F.lit(1).alias("start"), F.lit(5).alias("end")), F.struct(F.lit(9).alias("start"), F.lit(12).alias("end")))
    region = F.struct(F.lit(2.5).alias("start"), F.lit(3.5).alias("end"))
    narrow = F.struct(F.lit(2.5).alias("start"), F.lit(2.5001).alias("end"))
    assert len(one(spark, segments.effective(found, region))) == 1 and len(one(spark, segments.effective(found, narrow))) == 2
    assert one(spark, segments.loop_spec(found, F.lit(0.02))) is None
    assert one(spark, segments.loop_spec(F.slice(found, 1, 1), F.lit(0.02)))["end_s"] == pytest.approx(0.1)


def test_scalars(spark):
    text = [
        C.format_time(F.lit(-61.5)), "-1:01.500", C.format_time(F.lit(3725.0), False), "62:05", C.format_time(F.lit(None).cast("double")), "",
        C.format_rate(F.lit(48000)), "48 kHz", C.format_rate(F.lit(44100)), "44.1 kHz", C.format_size(F.lit(1048576 * 5 // 2)), "2.5 MB", C.format_size(F.lit(2048)), "2 KB",
        C.format_number(F.lit(1500.0)), "1.5k", C.format_number(F.lit(-2_500_000.0)), "-2.5M", C.stars(F.lit(3)), "★★★", C.stars(F.lit(0)), "",
        C.format_gain(F.lit(0.04)), "", C.format_gain(F.lit(-3.25)), "-3.3", C.format_gain(F.lit(6.0)), "+6.0", C.format_level(F.lit(5.0)), "5.0",
        C.short_bundle(F.lit("GDC_20_17 part")), "GDC 2017", C.short_bundle(F.lit("GDC 1")), "GDC (orig)", C.clean_text(F.lit(" a\tb\x01 ")), "a b", C.norm_header(F.lit(" file ")), "FILE",
        C.valid_name(F.lit('a<b>:"c"')), "a b c", C.valid_name(F.lit("???")), "renamed", C.sibling_path(F.lit("a.b/c.d.wav"), "_16bit.wav"), "a.b/c.d_16bit.wav",
        C.directory("/lib", F.lit("a/b.wav")), "/lib/a", C.extension(F.lit("a.b/C.WAV")), "wav",
    ]
    assert [one(spark, e) for e in text[::2]] == text[1::2]
    numbers = [C.level_to_db(F.lit(10.0)), -10.0, C.level_to_db(F.lit(5.0)), -20.0, C.level_to_db(F.lit(0.0)), -120.0, C.db_to_level(F.lit(-20.0)), 5.0, C.gain_db(F.lit(99.0), F.lit(None).cast("double")), 24.0, C.gain_db(F.lit(None).cast("double"), F.lit(10.0)), 20.0, C.gain_db(F.lit(None).cast("double"), F.lit(0.0)), 0.0, C.playback_db(F.lit(0.001), F.lit(1.0)), -79.0, C.height_to_db(C.height(F.lit(-12.0))), -12.0, C.parse_number(F.lit(" x "), 7.0), 7.0, C.slider_value(C.slider_fraction(F.lit(300.0), 1, 20000), 1, 20000), 300.0, C.slider_value(F.lit(0.5), 0, 10), 5.0, C.chop_edit(F.lit(-99.0), "silence_db"), -90.0, C.crossfade_fraction(F.lit(500.0), F.lit(0.6), F.lit(3.0)), 0.1]
    assert [one(spark, e) for e in numbers[::2]] == pytest.approx(numbers[1::2])
    target = one(spark, C.target_gain(F.lit(10.0), F.lit(-30.0), F.lit(-6.0)))
    assert (target["gain"], target["capped"]) == (6.0, True)
    assert one(spark, C.target_gain(F.lit(None).cast("double"), F.lit(-30.0), F.lit(-6.0))) is None
    assert one(spark, C.final_db(F.lit(None).cast("double"), F.lit(3.0))) is None
    assert one(spark, C.tokenize(F.lit("Café 12_kHz"))) == ["caf", "12", "khz"]
    assert [one(spark, C.is_playable(F.lit(e), F.lit(n).cast("int"))) for e, n in (("mp3", 6), ("wav", 2), ("wav", 4), ("wav", None), ("ogg", 1))] == [True, True, False, True, False]
    assert [one(spark, C.is_short(F.lit(d).cast("double"), 2.0)) for d in (1.0, 0.0, None, 3.0)] == [True, False, False, False]


def test_folder_fallback(spark):
    given = ["B/Sup - Lib_/f.wav", "B/Lib__/f.wav", "B/f.wav", "f.wav"]
    rows = spark.createDataFrame([(p,) for p in given], "path string").select(C.folder_fallback(F.col("path")).alias("f")).collect()
    assert [tuple(r.f) for r in rows] == [("B", "Lib", "Sup"), ("B", "Lib", ""), ("B", "f.wav", ""), ("f.wav", "", "")]


FILES = [("B/S - L/A10.wav", "A10.wav", "wav", 5, 1), ("B/S - L/a2.WAV", "a2.WAV", "wav", 6, 2), ("B/x%_y.wav", "x%_y.wav", "wav", 7, 3), ("C/z.mp3", "z.mp3", "mp3", 8, 4)]


def files(spark):
    return spark.createDataFrame(FILES, "path string, filename string, ext string, size long, mtime long")


def test_enrichment_and_sidecars(spark):
    listed = spark.createDataFrame([("a2.wav", "Listed", "", "u"), ("z.mp3", "", "Zed", "")], "filename string, library string, supplier string, url string")
    rows = {r.filename: r for r in catalog.enrich(files(spark), listed).collect()}
    assert (rows["a2.WAV"].library, rows["a2.WAV"].supplier, rows["a2.WAV"].url) == ("Listed", "S", "u")
    assert (rows["z.mp3"].library, rows["z.mp3"].supplier, rows["A10.wav"].library) == ("z.mp3", "Zed", "L")
    user = schema.migrate_userdata(spark.createDataFrame([("C/z.mp3", 4, 2, "t", None, None, 5.0, 2.0), ("B/x%_y.wav", None, None, None, float("nan"), 3.0, None, None)], schema.USERDATA))
    assert {r.path: (r.level, None if r.gain_db is None else round(r.gain_db, 2)) for r in user.collect()} == {"C/z.mp3": (5.0, 6.02), "B/x%_y.wav": (None, 3.0)}
    loud = schema.migrate_loudness(spark.createDataFrame([("C/z.mp3", None, -20.0, -3.0, 8)], schema.LOUDNESS))
    chops = spark.createDataFrame([("C/z.mp3", None, 1.0, 1.0, 1, True, 8), ("B/x%_y.wav", -50.0, 1.0, 0.2, 3, False, 7)], schema.CHOPPING)
    joined = {r.path: r for r in catalog.with_sidecars(files(spark), user.withColumn("size", F.lit(1)), chops, loud).collect()}
    assert (joined["C/z.mp3"].final_db, joined["C/z.mp3"].min_gap_s, joined["C/z.mp3"].chops) == (pytest.approx(-13.98, abs=0.01), None, 1)
    assert (joined["B/S - L/A10.wav"].rating, joined["B/S - L/A10.wav"].tags, joined["B/S - L/A10.wav"].final_db) == (0, "", None)


def test_incremental_catalog(spark):
    cache = spark.createDataFrame([("B/S - L/A10.wav", 5, 1, "old"), ("C/z.mp3", 8, 9, "old"), ("gone.wav", 1, 1, "old")], "path string, size long, mtime long, note string")
    parse = lambda some: some.select("path", "size", "mtime", F.lit("new").alias("note"))
    now = catalog.incremental(files(spark), cache, parse)
    assert {(r.path, r.note) for r in now.collect()} == {("B/S - L/A10.wav", "old"), ("B/S - L/a2.WAV", "new"), ("B/x%_y.wav", "new"), ("C/z.mp3", "new")}
    assert catalog.changed(parse(files(spark)).limit(0), now, now).first()["changed"] is False
    chopped = spark.createDataFrame([("B/S - L/A10.wav", 5, 1.5, None), ("B/S - L/a2.WAV", 6, 9.0, True), ("B/x%_y.wav", 7, 2.0, False), ("C/z.mp3", 1, 1.5, False)], "path string, size long, min_gap_s double, continuous boolean")
    assert sorted(r.path for r in catalog.stale(files(spark), chopped, {"min_gap_s": F.lit(1.5)}).collect()) == ["B/x%_y.wav", "C/z.mp3"]


def test_view(spark):
    df = files(spark).withColumns({"library": F.lit("Lib"), "supplier": F.lit(None).cast("string"), "description": F.lit(""), "tags": F.lit("red")})
    names = lambda spec, **k: [r.filename for r in view.apply(df, spec, **k).collect()]
    assert names(view.ViewSpec(sort="filename")) == ["a2.WAV", "A10.wav", "x%_y.wav", "z.mp3"]
    assert names(view.ViewSpec(sort="size", descending=True))[0] == "z.mp3"
    assert names(view.ViewSpec(text="%_ RED")) == ["x%_y.wav"] and names(view.ViewSpec(text="lib  a2")) == ["a2.WAV"]
    assert names(view.ViewSpec(contains={"filename": " A1 "})) == ["A10.wav"]
    assert names(view.ViewSpec(allowed={"ext": frozenset(["mp3", ""])}, ranges={"size": (None, 8)})) == ["z.mp3"]
    assert len(names(view.ViewSpec(ranges={"size": (5, 8)}), bounds={"size": (5, 8)})) == 4
    spec = view.ViewSpec(text="rain").with_keyword("Rain").with_keyword("roof").clicked("size").clicked("size")
    assert (spec.text, spec.descending, spec.cleared().sort) == ("rain roof", True, None)
    assert view.filter_kind(df, "ext") == "tick" and view.filter_kind(df, "size") == "range"
    assert [r.value for r in view.distinct_values(df, "filename").orderBy("place").collect()] == ["a2.WAV", "A10.wav", "x%_y.wav", "z.mp3"]
    assert tuple(view.column_range(df.limit(0), "size").first()) == (0.0, 1.0)
    for order in ([], [5, 5, 5], [2, -1, 999, 0], list(range(22))):
        assert sorted(view.repaired_order(order, 22)) == list(range(22))
    a, b = (df.where(F.col("size") < 7).select("path"), df.where(F.col("size") > 5).select("path"))
    assert view.toggle_selection(a, b).count() == 3 and view.extend_selection(a, b).count() == 4 and view.replace_selection(a, b).count() == 3
    assert [r.filename for r in view.row_range(df, [F.col("size")], 3, 2).orderBy("row").collect()] == ["a2.WAV", "x%_y.wav"]
    assert view.reordered(df, [3]).columns[0] == df.columns[3]


def test_keywords(spark):
    rows = [("L1", "Rain roof 24 the wav"), ("L1", "rain Café"), ("L2", "rain_roof-2"), ("L3", "thunder")]
    found = {r.token: r.n for r in keywords.document_frequency(spark.createDataFrame(rows, "lib string, name string"), ["lib"], ["name"]).collect()}
    assert found == {"rain": 2, "roof": 2, "caf": 1, "thunder": 1}
    top = keywords.keywords(spark.createDataFrame(rows, "lib string, name string"), ["lib"], ["name"], 3)
    assert [r.token for r in top.collect()] == ["rain", "roof", "caf"]
    assert [r.token for r in keywords.narrowed(top, "OO").collect()] == ["roof"]


def test_renames_and_siblings(spark):
    records = spark.createDataFrame([("d/a?.wav", "a?.wav", 24), ("d/a.wav", "a.wav", 16), ("d/a*.wav", "a*.wav", 24), ("d/???", "???", None), ("d/b.wav", "b.wav", 24), ("d/b_16bit.wav", "b_16bit.wav", 16), ("e/c.wav", "c.wav", 32)], "path string, filename string, bit_depth int")
    moves = {r.old: r.new for r in catalog.plan_renames(records).collect()}
    assert moves == {"d/a*.wav": "d/a .wav", "d/a?.wav": "d/a _1.wav", "d/???": "d/renamed"}
    moved = catalog.rename(records, spark.createDataFrame(list(moves.items()), "old string, new string"))
    assert "d/a _1.wav" in {r.path for r in moved.collect()} and moved.count() == 7
    assert sorted(r.path for r in catalog.needs_16_bit(records).collect()) == ["d/a*.wav", "d/a?.wav", "e/c.wav"]
    assert [tuple(r) for r in catalog.siblings(records, "_16bit.wav").collect()] == [("d/b.wav", "d/b_16bit.wav")]
    children = spark.createDataFrame([("d/a.wav", None), ("d/b.wav", "own")], "parent string, tags string")
    parents = spark.createDataFrame([("d/a.wav", "red"), ("d/b.wav", "blue")], "path string, tags string")
    assert {r.parent: r.tags for r in catalog.inherit(children, parents, ["tags"]).collect()} == {"d/a.wav": "red", "d/b.wav": "own"}
    assert catalog.first_with_prefix(records, "b_16").first()["filename"] == "b_16bit.wav"


def test_edits(spark):
    log = spark.createDataFrame([(1, "p", "tags", " a "), (2, "p", "tags", "b"), (3, "p", "gain_db", "99"), (4, "p", "gain_db", "x"), (5, "q", "gain_db", ""), (6, "q", "level", "7"), (7, "q", "level", " "), (8, "q", "rating", "9"), (9, "q", "rating", ""), (10, "r", "silence_db", "-99")], schema.EDITS)
    found = {(r.path, r.field): r.value for r in edits.folded(edits.validated(log)).collect()}
    assert found == {("p", "tags"): "b", ("p", "gain_db"): "24.0", ("q", "gain_db"): "0.0", ("q", "level"): None, ("q", "rating"): "5.0", ("r", "silence_db"): "-90.0"}
    user = spark.createDataFrame([("p", 3, 8.0, 1.0), ("q", 1, 5.0, 2.0)], "path string, rating int, level double, gain_db double")
    loud = spark.createDataFrame([("p", -30.0, -20.0), ("s", -30.0, -6.0)], "path string, lufs double, peak_db double")
    levels = spark.createDataFrame([("p", 10.0), ("q", None), ("s", 10.0)], "path string, level double")
    rows = {r.path: (r.level, r.gain_db) for r in edits.level_edit(user, loud, levels).collect()}
    assert rows == {"p": (10.0, 20.0), "q": (None, 2.0), "s": (10.0, 6.0)}
    again = {r.path: (r.gain_db, r.updated) for r in edits.recomputed_gains(user, loud).collect()}
    assert again["q"] == (2.0, False) and again["p"][1]
    chops = spark.createDataFrame([("p", None, None, None, 1, True, 5)], schema.CHOPPING)
    edited = edits.chop_edit(chops, spark.createDataFrame([(1, "p", "silence_db", "-45"), (1, "n", "min_gap_s", "99")], schema.EDITS))
    assert {r.path: (r.silence_db, r.min_gap_s, r.min_sound_s, r.continuous) for r in edited.collect()} == {"p": (-45.0, 1.5, 0.3, False), "n": (-60.0, 10.0, 0.3, False)}
    assert edits.bulk(user, "rating", F.lit("4"), 12).select("value").distinct().first()[0] == "4.0"
    assert [x.count() for x in edits.deleted(user, loud, user.where("path = 'p'"))] == [1, 1]
    assert edits.applied_levels(user, levels).first()[0] == 2


def test_vectors(spark):
    rows = [(k, v) for k, v in enumerate([[1.0, 0.0], [0.9, 0.1], [0.0, 1.0], [-1.0, 0.0], [1.0, 0.0]])]
    store = spark.createDataFrame(rows, "path long, vector array<float>")
    found = vectors.similar_by_cosine(store, 0, 3).collect()
    assert [(r.rank, r.path) for r in found] == [(1, 4), (2, 1), (3, 2)] and found[0].score == 1.0
    assert vectors.text_search(store, [1.0, 0.0], 10).collect()[-1].score == -1.0
    assert vectors.similar_by_distance(store, 0, 9).first().path == 4
    assert vectors.similar(store, store.limit(0), 0, 1).first().path == 4
    assert json.loads(stores.ranked_result(vectors.similar_by_cosine(store, 0, 2), "q"))["paths"] == [4, 1]


def test_tracklists(spark, tmp_path):
    book = "Title,,\n,FileName ,Library Name,Supplier,URL,Library (old)\n,A.wav,One,S,u,\n,,x,,,\n,b.wav,Two,S\n"
    (tmp_path / "a.csv").write_bytes(("﻿" + book).encode())
    (tmp_path / "b.csv.xls").write_bytes("filename,library\nA.WAV,Späte\n".encode("latin-1"))
    (tmp_path / "catalog.csv").write_text("filename,library\nc.wav,Skip\n")
    import zipfile

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "c.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>FILENAME</t></si><si><r><t>Li</t></r><r><t>brary</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2" t="inlineStr"><is><t>d.wav</t></is></c><c r="C2"><v>7</v></c></row></sheetData></worksheet>')
    found = {r.filename: r.library for r in tracklists.index(tracklists.load(spark, str(tmp_path))).collect()}
    assert found == {"a.wav": "Späte", "b.wav": "", "d.wav": "7"} or found == {"a.wav": "Späte", "b.wav": "Two", "d.wav": "7"}


def test_stores(spark, tmp_path):
    folder = str(tmp_path / "t")
    for k in range(3):
        stores.write_table(spark.range(k + 1).select(F.col("id").cast("string").alias("path")), folder)
    assert stores.read_table(spark, folder, "path string").count() == 3
    assert stores.versions(spark, folder) == {"current": 2, "previous": 1}
    import shutil

    shutil.rmtree(f"{folder}/v2")
    assert stores.read_table(spark, folder, "path string").count() == 2
    assert stores.read_table(spark, str(tmp_path / "none"), "path string").count() == 0
    (tmp_path / "u.json").write_text("{broken")
    (tmp_path / "u.json.bak").write_text(json.dumps({"a.wav": {"rating": 3}, "b.wav": {"plays": 2.0}}))
    rows = {r.path: (r.rating, r.plays) for r in stores.read_sidecar_json(spark, str(tmp_path / "u.json"), "rating int, plays double").collect()}
    assert rows == {"a.wav": (3, None), "b.wav": (None, 2.0)}
    records = spark.createDataFrame([("b.wav", "b.wav", "B", "L", "", "", "wav", 1, 2, 0.5, 48000, 16, 2, "x\ty"), ("A.wav", "A.wav", "B", "L", "", "", "wav", 1, 2, None, None, None, None, "")], schema.CATALOG)
    stores.write_catalog_json(records, str(tmp_path / "index.json"), "/lib")
    back = stores.read_catalog_json(spark, str(tmp_path / "index.json")).collect()
    assert [(r.path, r.description, r.bit_depth) for r in back] == [("A.wav", "", None), ("b.wav", "x y", 16)]
    assert json.loads((tmp_path / "index.json").read_text())["count"] == 2
    import numpy as np

    np.savez(tmp_path / "v.npz", vectors=np.eye(2, dtype=np.float32), paths=np.array(["a", "b"]), model=np.array("m"))
    assert [tuple(r) for r in stores.read_vectors(spark, str(tmp_path / "v.npz")).orderBy("path").collect()] == [("a", [1.0, 0.0], "m"), ("b", [0.0, 1.0], "m")]
    assert stores.view_state('{"order": [2, 2, 9], "sort": 99, "search": 5}', 3) == {"order": [2, 0, 1], "sort": 2, "descending": False, "search": "5"}
    assert stores.view_state("nonsense", 2)["order"] == [0, 1]
    (tmp_path / "config.json").write_text('{"library_root": "/lib"}')
    assert stores.read_config(str(tmp_path / "config.json")) == {"library_root": "/lib"}
    assert stores.preprocessor({"fft_window_size": 512, "max_length_s": 2})["nb_max_samples"] == 96000


def test_catalog_order_numbers_every_page(spark, tmp_path):
    urls = [f"http://{'Ab'[k % 2]}/{k * 7919 % 1203 // 3}" for k in range(1203)]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    found = registry.QUERIES["catalog_order"](spark, str(tmp_path)).collect()
    order = sorted(range(1203), key=lambda k: (urls[k].lower(), k))
    assert sorted((r.place, r.page_id) for r in found) == list(enumerate(order, 1))


def test_numbering_of_no_rows_and_of_one_key(spark):
    assert view.numbered(spark.range(0), [F.col("id")]).count() == 0
    found = view.numbered(spark.range(999).withColumn("same", F.lit("x")), [F.col("same"), -F.col("id")]).collect()
    assert sorted((r.place, r.id) for r in found) == [(k + 1, 998 - k) for k in range(999)]


def test_the_text_view_shows_every_match(spark, tmp_path):
    docs = [(k, "The rain" if k % 5 else "rain", "en", f"src1{k % 13}", 300) for k in range(1500)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, 1, 0), (7, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    found = registry.QUERIES["view_text_filter"](spark, str(tmp_path)).collect()
    order = sorted((d for d in docs if d[0] % 5), key=lambda d: (int(d[3][3:]), d[0]))
    assert sorted((r.place, r.doc_id) for r in found) == [(n, d[0]) for n, d in enumerate(order, 1)]
    assert {(r.quality, r.toxic) for r in found if r.doc_id == 7} == {(1, 1)} and {(r.quality, r.toxic) for r in found if r.doc_id != 7} == {(0, -1)}


def test_every_record_finds_its_sibling(spark, tmp_path):
    spark.range(1200).select(F.col("id").alias("page_id"), F.lit("u").alias("url")).write.parquet(str(tmp_path / "pages.parquet"))
    found = registry.QUERIES["sibling_paths"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in found) == sorted((f"lib/{k // 2}.wav", f"lib/{k // 2}_16bit.wav") for k in range(1, 1200, 2) if k % 3)


def test_natural_keys_of_long_numbers(spark):
    """Numbers of any length compare as numbers."""
    names = ["a9", "a10", "a007", "a" + "1" + "0" * 20 + "1", "a1" + "0" * 19 + "99", "A2", "a", "b1", "a10b"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    found = [r.n for r in df.orderBy(C.natural_key(F.col("n")), "n").collect()]
    assert found == ["a", "A2", "a007", "a9", "a10", "a10b", "a1" + "0" * 19 + "99", "a" + "1" + "0" * 20 + "1", "b1"] or found[-3:-1] == sorted(names[3:5], key=lambda n: int(n[1:]))
    assert len({r[0] for r in df.select(C.natural_key(F.col("n"))).collect()}) == len(names)


def test_renames_avoid_each_other(spark):
    """A new name is neither an existing one nor another new one, whatever their stems."""
    names = ["a .wav", "a?.wav", "a *.wav", "a _1?.wav", "a _1 .wav", "a _2.wav", "x:y.wav", "x<y.wav"]
    records = spark.createDataFrame([(f"d/{n}", n) for n in names], "path string, filename string")
    moves = {r.old: r.new for r in catalog.plan_renames(records.repartition(3)).collect()}
    kept = {f"d/{n}" for n in names} - set(moves)
    assert len(set(moves.values())) == len(moves) == 5 and not set(moves.values()) & kept
    assert catalog.plan_renames(records.limit(0)).count() == 0


def test_quantiles_and_numbers_within_keys(spark):
    """Exact quantiles of keys of any share, nulls and ties included, as numpy gives them."""
    import numpy as np

    rng = np.random.default_rng(2)
    rows = [("hot", float(np.round(x, 2)), k) for k, x in enumerate(rng.normal(size=2000))] + [("one", 5.0, 9001), ("two", 1.0, 9002), ("two", 2.0, 9003), ("hot", None, 9004), ("hot", float("nan"), 9005), ("none", None, 9006)]
    df = spark.createDataFrame(rows, "k string, v double, id long").repartition(5)
    at = {"low": 0.05, "mid": 0.5, "high": 0.999}
    found = {r.k: (r.low, r.mid, r.high) for r in segments.quantiles(df, ["k"], "v", "id", at).collect()}
    plain = {k: [v for kk, v, _ in rows if kk == k and v is not None and v == v] for k in ("hot", "one", "two")}
    assert set(found) == set(plain)
    for k, values in plain.items():
        np.testing.assert_allclose(found[k], np.quantile(values, list(at.values())), atol=1e-12)
    assert segments.quantiles(df.limit(0), ["k"], "v", "id", at).count() == 0
    placed = view.numbered_within(df.where("k = 'two'"), ["k"], [F.col("v"), F.col("id")])
    assert sorted((r.v, r.i) for r in placed.collect()) == [(1.0, 0), (2.0, 1)]


def test_pasted_and_cleared_cells(spark):
    user = spark.createDataFrame([("a", " wet ", 99.0, None), ("b", None, None, 3)], "path string, tags string, gain_db double, rating int")
    targets = spark.createDataFrame([("b",), ("c",)], "path string")
    found = {(r.path, r.field): r.value for r in edits.pasted(user, "a", targets, ["tags", "gain_db", "rating"], 7).collect()}
    assert found == {(p, f): v for p in "bc" for f, v in (("tags", "wet"), ("gain_db", "24.0"))}
    assert edits.pasted(user, "nowhere", targets, ["tags"]).count() == 0
    assert {(r.field, r.value) for r in edits.cleared(targets, ["tags", "level", "rating"]).collect()} == {("tags", ""), ("level", None)}
