"""A small library of sounds, end to end, and the streams."""

import json
import os
import sys

import numpy as np
import pytest
from pyspark import SparkFiles
from pyspark.sql import functions as F
from tessella.operators import analysis
from tessella.plans import commands
from tessella.plans.pipeline import Library
from tessella.sources import audio
from tessella.streaming import incremental

RATE = 48000


def tone(seconds, amplitude=0.5, f=1000):
    return amplitude * np.sin(2 * np.pi * f * np.arange(int(seconds * RATE)) / RATE)


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("sounds")
    folder = root / "GDC 2017" / "Sup - Rain_"
    folder.mkdir(parents=True)
    gap = np.zeros(2 * RATE)
    (folder / "bursts.wav").write_bytes(audio.wav_bytes(np.concatenate([tone(0.5), gap, tone(0.5), gap, tone(0.5)]), RATE, 24))
    (folder / "tone.WAV").write_bytes(audio.wav_bytes(np.column_stack([tone(1.0), tone(1.0)]), RATE))
    (folder / "brief.wav").write_bytes(audio.wav_bytes(tone(0.1), RATE))
    (folder / "noise.wav").write_bytes(audio.wav_bytes(np.random.default_rng(0).normal(size=2 * RATE) * 0.1, RATE))
    (folder / "broken.wav").write_bytes(b"RIFFxxxxWAVE")
    (root / "notes.txt").write_text("not a sound")
    (root / "list.csv").write_text("FILENAME,LIBRARY,SUPPLIER,URL\nTONE.wav,Listed,Someone,http://x\n")
    return Library(spark, str(root), str(tmp_path_factory.mktemp("store")))


def test_index_is_incremental(library):
    first = library.index()
    assert first == {"ok": True, "count": 5, "parsed": 5, "reused": 0, "changed": True}
    rows = {r.filename: r for r in library.table("catalog").collect()}
    assert (rows["tone.WAV"].library, rows["tone.WAV"].channels, rows["tone.WAV"].ext, rows["tone.WAV"].duration) == ("Listed", 2, "wav", 1.0)
    assert (rows["bursts.wav"].library, rows["bursts.wav"].supplier, rows["bursts.wav"].bit_depth, rows["bursts.wav"].duration) == ("Rain", "Sup", 24, 5.5)
    assert rows["broken.wav"].duration is None
    assert library.index() == {"ok": True, "count": 5, "parsed": 0, "reused": 5, "changed": False}
    content = audio.with_headers_of_content(library.spark, library.root).collect()
    assert {r.duration for r in content if "bursts" in r.uri} == {5.5}


def test_analysis(library):
    library.analyse(min_duration=0.2)
    chops = {r.path.rpartition("/")[2]: r for r in library.table("chopping").collect()}
    assert chops["bursts.wav"].chops == 3 and chops["tone.WAV"].chops == 1 and chops["brief.wav"].continuous
    loud = {r.path.rpartition("/")[2]: r for r in library.table("loudness").collect()}
    assert abs(loud["bursts.wav"].peak_db + 6.02) < 0.2 and -13 < loud["tone.WAV"].lufs < -3 and "broken.wav" not in loud
    assert library.analyse(only_missing=True)["analysed"] <= 2  # what has no loudness yet


def test_streamed_and_whole_analysis_agree(library, monkeypatch):
    path = f"{library.root}/GDC 2017/Sup - Rain_/noise.wav"
    whole = analysis.analyse(path)
    monkeypatch.setattr(analysis.dsp, "STREAM_FRAMES", 1000)
    streamed = analysis.analyse(path)
    np.testing.assert_allclose(streamed["levels"][: len(whole["levels"])], whole["levels"], atol=1e-9)
    assert streamed["peak_db"] == whole["peak_db"]


def test_vectors_and_search(library, capsys):
    library.fingerprint()
    library.embed()
    paths = {r.path for r in library.table("fingerprints").collect()}
    assert len(paths) == 4 and library.table("embeddings").count() == 5

    def run(*arguments):
        code = commands.main([arguments[0], library.root, library.store, *arguments[1:]], library.spark)
        return code, json.loads(capsys.readouterr().out.strip().splitlines()[-1])

    code, found = run("search", "bursts rain")
    assert code == 0 and found["paths"][0].endswith("bursts.wav") and len(found["paths"]) == 5
    tone_path = next(p for p in paths if p.endswith("tone.WAV"))
    code, found = run("similar", tone_path, "--topn", "2")
    assert code == 0 and len(found["paths"]) == 2 and tone_path not in found["paths"]
    code, found = run("loopfind", next(p for p in paths if p.endswith("noise.wav")), "--min-s", "1")
    assert found["ok"] and found["end_s"] - found["start_s"] >= 1
    code, found = run("envelope", tone_path)
    assert found["n"] == 50 and found["peak_db"] == pytest.approx(-9.03, abs=0.2)
    code, found = run("explore_gaps", "bursts")
    assert len(found["sweep"]) == 15 and {r["sounds"] for r in found["sweep"] if r["gap_s"] == 1.0} == {3}
    code, found = run("similar", "nowhere.wav")
    assert found["paths"] == []
    assert run("loopfind", "nowhere.wav") == (1, {"ok": False, "error": "no such file: nowhere.wav"})
    with pytest.raises(SystemExit):
        commands.main(["loopfind", library.root, library.store, "x", "--unknown"], library.spark)


def test_derived_files(library, capsys):
    source = next(r.path for r in library.table("catalog").collect() if r.path.endswith("bursts.wav"))
    for command, spec, expected in (
        ("chop", {"segments": [[0, 0.5], [1, 1], [2.5, 3.0]]}, ["bursts_chop01.wav", "bursts_chop02.wav"]),
        ("loopify", {"start_s": 0, "end_s": 0.5, "crossfade_ms": 100}, ["bursts_loop.wav"]),
        ("to_16bit", {}, ["bursts_16bit.wav"]),
    ):
        assert commands.main([command, library.root, library.store, source, "--spec", json.dumps(spec)], library.spark) == 0
        found = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
        assert [p.rpartition("/")[2] for p in found["paths"]] == expected
    rows = {r.filename: r for r in library.table("catalog").collect()}
    assert len(rows) == 9 and rows["bursts_loop.wav"].duration == pytest.approx(0.4) and rows["bursts_loop.wav"].bit_depth == 16
    assert rows["bursts_chop01.wav"].library == "Rain" and rows["bursts_chop02.wav"].duration == 0.5


def test_other_formats_are_decoded_or_fail(spark, tmp_path, capsys):
    root, store = tmp_path / "sounds", tmp_path / "store"
    folder = root / "Bundle" / "Sup - Rain_"
    folder.mkdir(parents=True)
    (folder / "rain.mp3").write_bytes(b"no sound")
    (folder / "tone.wav").write_bytes(audio.wav_bytes(tone(0.1), RATE))
    small = Library(spark, str(root), str(store))
    small.index()
    paths = {r.filename: r.path for r in small.table("catalog").collect()}

    def run(name):
        code = commands.main(["to_wav", small.root, small.store, paths[name]], spark)
        return code, json.loads(capsys.readouterr().out.strip().splitlines()[-1])

    assert run("tone.wav") == (1, {"ok": False, "error": "source is already a .wav"})
    code, found = run("rain.mp3")  # no soundfile, or nothing that it can read
    assert code == 1 and not found["ok"]
    assert sorted(p.name for p in folder.iterdir()) == ["rain.mp3", "tone.wav"] and small.table("catalog").count() == 2
    stub = tmp_path / "soundfile.py"
    stub.write_text("import numpy as np\nclass info:\n    frames, samplerate, duration, subtype, channels = 200, 8000, 0.025, 'PCM_16', 2\n    def __init__(self, path): pass\ndef blocks(path, blocksize, dtype, always_2d):\n    yield read(path, dtype, True)[0]\ndef read(path, dtype, always_2d):\n    return np.array([[0.5, -2.0], [1.0, 0.0]] * 100), 8000\n")
    spark.sparkContext.addPyFile(str(stub))
    try:
        code, found = run("rain.mp3")
        files = spark.createDataFrame([("rain.mp3", str(folder / "rain.mp3"))], "path string, uri string")
        decoded, loops = analysis.analysed(files).first(), analysis.loops(files).first()
    finally:
        os.remove(SparkFiles.get("soundfile.py"))
    assert decoded.error is None and decoded.sample_rate == 8000 and decoded.peak_db == pytest.approx(6.02, abs=0.01) and loops.duration == 200 / 8000
    assert (code, found["written"], found["paths"]) == (0, 1, ["Bundle/Sup - Rain_/rain.wav"])
    x, rate = analysis.load(str(folder / "rain.wav"))
    assert rate == 8000 and x.shape == (200, 2) and x[0].tolist() == [0.25, -1.0]
    assert {r.filename: r.library for r in small.table("catalog").collect()}["rain.wav"] == "Rain"


def test_whole_rescan(library):
    assert list(library.rescan()) == ["index", "analyse", "fingerprint", "embed"]
    assert library.rename_invalid().count() == 0


def test_streams(spark, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    edits = spark.createDataFrame([(1, "p", "tags", "a"), (2, "p", "tags", "b"), (3, "q", "level", "5")], "seq long, path string, field string, value string")
    edits.write.parquet(source)
    stream = incremental.new_files(spark, source, edits.schema)
    incremental.fold_edits(stream, out, check).awaitTermination()
    spark.createDataFrame([(4, "q", "level", "6")], edits.schema).write.mode("append").parquet(source)
    incremental.fold_edits(incremental.new_files(spark, source, edits.schema), out, check).awaitTermination()
    expected = {("p", "b"), ("q", "6")}
    assert {(r.path, r.value) for r in incremental.present(spark, out).collect()} == expected
    assert incremental.compact(spark, out) == 0
    assert {(r.path, r.value) for r in incremental.present(spark, out).collect()} == expected
    batches = str(tmp_path / "batches")
    listener = incremental.Progress()
    spark.streams.addListener(listener)
    query = incremental.commit_batches(incremental.new_files(spark, source, edits.schema, 1), batches, lambda b: b.select("path").distinct(), str(tmp_path / "c2"), "work")
    query.awaitTermination()
    assert spark.read.parquet(batches).select("path").distinct().count() == 2
    with incremental.Cancellation(spark, "job") as job:
        assert spark.range(3).count() == 3
        job.cancel()
    spark.streams.removeListener(listener)


def test_streamed_sounds(spark, tmp_path):
    rows = [(1, f"2024-01-01 00:00:{k:02d}", -10.0 if k % 20 < 5 else -90.0) for k in range(60)] + [(1, "2024-01-01 01:00:00", -10.0)]
    df = spark.createDataFrame(rows, "id long, at string, level double").withColumn("at", F.to_timestamp("at"))
    df.write.parquet(str(tmp_path / "in"))
    stream = incremental.new_files(spark, str(tmp_path / "in"), df.schema)
    found = incremental.sounds(stream, "id", "at", "level", -40.0, "4 seconds", "1 minute")
    query = found.writeStream.format("memory").queryName("sounds").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination()
    got = sorted((r.start.second, r.end.second, r.frames) for r in spark.table("sounds").collect())
    assert got[:3] == [(0, 4, 5), (20, 24, 5), (40, 44, 5)]
    levels = incremental.windowed_levels(incremental.new_files(spark, str(tmp_path / "in"), df.schema), "id", "at", F.col("level"), "10 seconds", "1 minute")
    query = levels.writeStream.format("memory").queryName("levels").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "d")).start()
    query.awaitTermination()
    assert spark.table("levels").count() == 7


def test_a_file_without_samples_has_the_floor_level(spark, tmp_path):
    (tmp_path / "empty.wav").write_bytes(audio.wav_bytes(np.zeros((0, 2)), RATE))
    (tmp_path / "broken.wav").write_bytes(b"RIFF")
    (tmp_path / "short.wav").write_bytes(audio.wav_bytes(tone(0.01), RATE))
    files = spark.createDataFrame([(n, str(tmp_path / n)) for n in ("empty.wav", "broken.wav", "short.wav")], "path string, uri string")
    found = {r.path: r for r in analysis.analysed(files).collect()}
    assert (found["empty.wav"].levels, found["empty.wav"].lufs, found["empty.wav"].peak_db, found["empty.wav"].sample_rate) == ([-100.0], -100.0, -100.0, RATE)
    assert found["broken.wav"].error and found["broken.wav"].levels is None
    assert len(found["short.wav"].levels) == 1
    assert {r.path for r in analysis.loops(files.where("path <> 'broken.wav'")).collect()} == {"short.wav"}
    assert {r.path: r.levels for r in analysis.envelope(files).collect()}["empty.wav"] == [-100.0]


def test_invalid_names_are_renamed_on_disk(spark, tmp_path):
    root, store = tmp_path / "sounds", tmp_path / "store"
    folder = root / "Bundle" / "Sup - Rain_"
    folder.mkdir(parents=True)
    for k, name in enumerate(("a .wav", "a?.wav", "A?.wav", "a _1.wav", "a*.wav", "b.wav", "?.mp3")):
        (folder / name).write_bytes(audio.wav_bytes(tone(0.1 + k / 100), RATE))
    small = Library(spark, str(root), str(store))
    small.index()
    moves = {r.old.rpartition("/")[2]: r.new.rpartition("/")[2] for r in small.rename_invalid().collect()}
    assert moves == {"a*.wav": "a _2.wav", "A?.wav": "A .wav", "a?.wav": "a _3.wav", "?.mp3": ".mp3"}
    assert sorted(p.name for p in folder.iterdir() if not p.name.endswith(".crc")) == sorted(["a .wav", "a _1.wav", "b.wav", "a _2.wav", "a _3.wav", "A .wav", ".mp3"])
    assert sorted(r.filename for r in small.table("catalog").collect()) == sorted(p.name for p in folder.iterdir())
    assert small.rename_invalid().count() == 0
    gone = small.delete(spark.createDataFrame([("Bundle/Sup - Rain_/b.wav",), ("nowhere.wav",)], "path string"), str(tmp_path / "trash"))
    assert [r.path for r in gone.collect()] == ["Bundle/Sup - Rain_/b.wav"]
    assert (tmp_path / "trash" / "Bundle" / "Sup - Rain_" / "b.wav").exists() and small.table("catalog").count() == 6


def test_tables_are_replaced_in_one_step(spark, tmp_path):
    """The pointer is there at any time, and what is read back is compared with what was written."""
    from tessella.sources import stores

    folder = str(tmp_path / "t")
    for k in range(3):
        assert stores.write_table(spark.range(k + 1), folder) == k
    assert stores.read_table(spark, folder, "id long").count() == 3
    stores.write_text(spark, f"{folder}/x.json", "a")
    stores.write_text(spark, f"{folder}/x.json", "b")
    assert stores._read_text(spark, f"{folder}/x.json") == "b" and not (tmp_path / "t" / "x.json.tmp").exists()
    rows = spark.createDataFrame([(f"p{k}", f"f\x01{k}", None) for k in range(50)], "path string, filename string, size long").repartition(4)
    target = str(tmp_path / "index.json")
    stores.write_catalog_json(rows, target, "/lib")
    first = json.loads((tmp_path / "index.json").read_text())
    assert first["count"] == 50 and [f["path"] for f in first["files"]] == sorted(f"p{k}" for k in range(50)) and first["files"][0]["filename"] == "f 0"
    stores.write_text(spark, target, json.dumps(first | {"generated": "2001-02-03 04:05:06"}))
    stores.write_catalog_json(rows.limit(0), target, "/lib")
    again = json.loads((tmp_path / "index.json").read_text())
    assert (again["generated"], again["count"], again["files"]) == ("2001-02-03 04:05:06", 0, [])
    stores.write_catalog_json(rows, target, "/lib", scanned=True)
    assert json.loads((tmp_path / "index.json").read_text())["generated"] > "2001-02-03 04:05:06"


def test_only_mounted_files_are_opened(spark):
    files = spark.createDataFrame([("a.wav", "s3a://bucket/a.wav")], "path string, uri string")
    with pytest.raises(Exception, match="mounted"):
        audio.with_headers(files).collect()


def test_progress_and_cancellation(library, tmp_path, capsys):
    progress = tmp_path / "progress.json"
    assert commands.main(["fingerprint", library.root, library.store, "--progress", str(progress)], library.spark) == 0
    assert json.loads(progress.read_text())["over"]
    stop = tmp_path / "stop"
    stop.write_text("")
    assert commands.main(["fingerprint", library.root, library.store, "--cancel", str(stop)], library.spark) == 1
    assert library.spark.range(3).count() == 3
    paths = tmp_path / "paths.json"
    one = library.table("catalog").where("filename LIKE '%bursts.wav'").first()["path"]
    paths.write_text(json.dumps([one]))
    capsys.readouterr()
    assert commands.main(["loudness", library.root, library.store, "--paths", str(paths), "--renames"], library.spark) == 0
    found = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert found["analysed"] == 1 and found["renames"] == []
    # What has its size and these parameters is not analysed again.
    library.analyse(only="chopping")
    assert library.analyse(only="chopping")["analysed"] == 0 and library.analyse(only="loudness")["analysed"] == 0
    assert library.analyse(gap_s=2.5, only="chopping")["analysed"] > 0


def test_audio_text_model(library, tmp_path, capsys):
    """Both towers over a stub of the runtime: its vector is the mean of the input."""
    assert commands.main(["clap_search", library.root, library.store, "rain", "--model", str(tmp_path)], library.spark) == 1
    from tokenizers import Tokenizer, models, pre_tokenizers

    tokenizer = Tokenizer(models.WordLevel({"[UNK]": 0, "rain": 1}, unk_token="[UNK]"))
    tokenizer.pre_tokenizer = pre_tokenizers.Whitespace()
    tokenizer.save(str(tmp_path / "tokenizer.json"))
    stub = tmp_path / "onnxruntime.py"
    stub.write_text(
        "import numpy as np\nclass SessionOptions: pass\nclass InferenceSession:\n    def __init__(self, *a, **b): pass\n"
        "    def run(self, _, given):\n        x = next(iter(given.values()))\n        return [np.array([[1.0, float(np.mean(v)) % 7] for v in x], np.float32)]\n"
    )
    library.spark.sparkContext.addPyFile(str(stub))
    known = sys.modules.pop("onnxruntime", None)
    sys.path.insert(0, str(tmp_path))
    analysis._session.cache_clear()
    capsys.readouterr()
    try:
        assert commands.main(["clap_embed", library.root, library.store, "--model", str(tmp_path)], library.spark) == 0
        assert commands.main(["clap_search", library.root, library.store, "rain", "--model", str(tmp_path), "--topn", "2"], library.spark) == 0
    finally:
        sys.path.remove(str(tmp_path))
        sys.modules.pop("onnxruntime", None)
        analysis._session.cache_clear()
        os.remove(SparkFiles.get("onnxruntime.py"))
        if known:
            sys.modules["onnxruntime"] = known
    made, found = map(json.loads, capsys.readouterr().out.strip().splitlines()[-2:])
    assert made["ok"] and made["total"] > 2 and len(found["paths"]) == 2 and all(0 <= s <= 1 for s in found["scores"])
