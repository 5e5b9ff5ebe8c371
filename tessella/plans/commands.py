"""The command line: python -m tessella.plans.commands COMMAND ROOT STORE [options]; the result is one JSON object."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessella.operators import analysis, catalog, segments, vectors
from tessella.plans.pipeline import Library
from tessella.sources import stores
from tessella.streaming.incremental import Watch

#: The names of the audio and the text tower and of the tokenizer in a model's folder.
AUDIO_TOWER, TEXT_TOWER, TOKENIZER = "audio_model.onnx", "text_model.onnx", "tokenizer.json"
COMMANDS = ("index", "envelope", "analyse_audio", "suggest_chops", "loudness", "fingerprint", "embed", "search", "similar", "chop", "loopify", "loopfind", "to_wav", "to_16bit", "explore_gaps", "clap_embed", "clap_search", "rescan")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tessella")
    out.add_argument("command", choices=COMMANDS)
    out.add_argument("root", help="folder of the audio files")
    out.add_argument("store", help="folder of the tables")
    out.add_argument("target", nargs="?", default="", help="a path, a query text or a file name")
    out.add_argument("--full", action="store_true")
    out.add_argument("--gap", type=float, default=1.5)
    out.add_argument("--sound", type=float, default=0.3)
    out.add_argument("--min-dur", type=float, default=0.0)
    out.add_argument("--min-s", type=float, default=0.0)
    out.add_argument("--only-missing", action="store_true")
    out.add_argument("--topn", type=int, default=500)
    out.add_argument("--model", default="", help="folder of an audio-text model: two ONNX towers, a tokenizer and perhaps preprocessor_config.json")
    out.add_argument("--paths", default="", help="JSON file with the list of paths to analyse")
    out.add_argument("--renames", action="store_true", help="rename files with invalid names first")
    out.add_argument("--progress", default="", help="JSON file that shows the tasks done and all tasks so far")
    out.add_argument("--cancel", default="", help="the command stops when this file appears")
    out.add_argument("--spec", default="{}", help="JSON: segments [[start, end], ...], or start_s, end_s, crossfade_ms, curve")
    return out


def one_file(library: Library, path: str):
    found = library.uris(library.table("catalog").where(F.col("path") == path))
    if not found.head(1):
        raise ValueError(f"no such file: {path}")
    return found


def execute(library: Library, a: argparse.Namespace) -> dict:
    spec = json.loads(a.spec)
    if a.command == "index":
        return library.index(a.full)
    if a.command in ("analyse_audio", "suggest_chops", "loudness"):
        renames = [r.asDict() for r in library.rename_invalid().orderBy("old").collect()] if a.renames else []
        paths = library.spark.createDataFrame([(p,) for p in json.loads(Path(a.paths).read_text())], "path string") if a.paths else None
        only = {"analyse_audio": None, "suggest_chops": "chopping", "loudness": "loudness"}[a.command]
        return library.analyse(a.gap, a.sound, a.only_missing, paths, a.min_dur, only) | ({"renames": renames} if a.renames else {})
    if a.command == "fingerprint":
        return library.fingerprint(a.only_missing)
    if a.command == "embed":
        return library.embed(only_missing=a.only_missing)
    if a.command in ("clap_embed", "clap_search"):
        folder = Path(a.model or ".")
        settings = folder / "preprocessor_config.json"
        if a.command == "clap_embed":
            tower = analysis.audio_tower(str(folder / AUDIO_TOWER))
            return library.embed_audio(tower, stores.preprocessor(json.loads(settings.read_text()) if settings.exists() else {}), a.only_missing)
        query = analysis.text_tower(str(folder / TEXT_TOWER), str(folder / TOKENIZER)).embed([a.target])[0].tolist()
        return json.loads(stores.ranked_result(vectors.text_search(library.table("audio_vectors"), query, a.topn, clip=True), a.target))
    if a.command == "rescan":
        return library.rescan()
    if a.command == "search":
        query = analysis.HashingEmbedder().query_embed([a.target])[0].tolist()
        return json.loads(stores.ranked_result(vectors.text_search(library.table("embeddings"), query, a.topn), a.target))
    if a.command == "similar":
        found = vectors.similar(library.table("fingerprints"), library.table("audio_vectors"), a.target, a.topn)
        return json.loads(stores.ranked_result(found, a.target))
    if a.command == "explore_gaps":
        levels = analysis.analysed(library.uris(catalog.first_with_prefix(library.table("catalog"), a.target)))
        rows = analysis.long_form(levels)
        found = segments.sweep(rows.select("path", "idx", "level"), ["path"], rows.where("level > -99").groupBy("path").agg(F.max("level").alias("peak")), 0.02, a.sound)
        return {"ok": True, "sweep": [r.asDict() for r in found.orderBy("path", "threshold_kind", "gap_s").collect()]}
    file = one_file(library, a.target)
    if a.command == "envelope":
        levels = analysis.envelope(file)
        row = levels.first().asDict()
        suggested = segments.suggest_threshold(analysis.long_form(levels), ["path"]).first()
        shown = {"levels": [round(x, 1) for x in row["levels"]], "n": len(row["levels"])}
        return {"ok": True, **row, **shown, "floor_db": round(min(row["levels"]), 2), "suggested_db": round(suggested["threshold"], 1)}
    if a.command == "loopfind":
        return {"ok": True, **analysis.loops(file, a.min_s).first().asDict()}
    if a.command == "chop":
        parts = F.array(*(F.struct(F.lit(float(s)).alias("start"), F.lit(float(e)).alias("end")) for s, e in spec["segments"]))
        return library.derive(analysis.chop_files(file.withColumn("segments", parts)))
    if a.command == "loopify":
        values = {"start_s": float(spec["start_s"]), "end_s": float(spec["end_s"]), "crossfade_ms": float(spec.get("crossfade_ms", 200)), "curve": spec.get("curve", "equal_power")}
        return library.derive(analysis.loop_files(file.withColumns({k: F.lit(v) for k, v in values.items()})))
    if a.command == "to_wav":
        if a.target.lower().endswith(".wav"):
            raise ValueError("source is already a .wav")
        return library.derive(analysis.wav_copies(file))
    return library.derive(analysis.copies_16_bit(file))


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run a command; a failure, or being cancelled, is a result too: {"ok": false, "error": ...} and exit code 1."""
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("tessella").getOrCreate()
    try:
        with Watch(spark, a.progress, a.cancel):
            result = execute(Library(spark, a.root, a.store), a)
    except Exception as problem:  # noqa: BLE001  (whatever it is, the caller gets it as JSON)
        result = {"ok": False, "error": str(problem)}
    print(json.dumps(result))
    return 0 if result.get("ok", True) else 1


if __name__ == "__main__":
    sys.exit(main())
