"""Catalogs, sidecars and vector stores: JSON of older installations, versioned Parquet of this one.

A table is a folder of numbered versions and a pointer file with the number that counts. A write makes a whole new
version, reads it back, and then replaces the pointer, so readers see the old table or the new one; one version before
it is kept, and stands in where the current one can't be read.
"""

from __future__ import annotations

import json
import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessella.functions.columns import clean_text
from tessella.schema import CATALOG


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is replaced as a whole: written beside, then renamed."""
    fs, p = _fs(spark, path)
    _, beside = _fs(spark, path + ".tmp")
    out = fs.create(beside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    replace(spark, path + ".tmp", path)


def replace(spark: SparkSession, source: str, target: str) -> None:
    """Move a file over another in one step, so that there is the old one or the new one at any time."""
    jvm = spark._jvm
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(rename, 1)
    over[0] = rename.OVERWRITE
    old, new = (jvm.org.apache.hadoop.fs.Path(p) for p in (source, target))
    conf = spark._jsc.hadoopConfiguration()
    uri = new.getFileSystem(conf).makeQualified(new).toUri()
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri, conf).rename(old, new, over)


def versions(spark: SparkSession, folder: str) -> dict:
    text = _read_text(spark, f"{folder}/CURRENT.json")
    return json.loads(text) if text else {"current": None, "previous": None}


def write_table(df: DataFrame, folder: str, sort: list | None = None) -> int:
    """Commit a new version; returns its number. Nothing is visible until all of it has been written and read back."""
    spark = df.sparkSession
    have = versions(spark, folder)
    number = max([-1, *(v for v in have.values() if v is not None)]) + 1
    # Rows are counted and hashed as they are written, and again as they are read back.
    marks = [F.count("*").alias("n"), *([] if any("map<" in t or "variant" in t for _, t in df.dtypes) else [F.sum(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)).cast("decimal(38,0)")).alias("h")])]
    seen = Observation()
    (df.sort(*sort) if sort else df).observe(seen, *marks).write.mode("overwrite").parquet(f"{folder}/v{number}")
    back = spark.read.schema(df.schema).parquet(f"{folder}/v{number}").agg(*marks).first().asDict()
    if back != seen.get:
        raise OSError(f"{folder}/v{number}: {back} was read back, {seen.get} was written")
    write_text(spark, f"{folder}/CURRENT.json", json.dumps({"current": number, "previous": have["current"]}))
    if have["previous"] is not None:
        fs, p = _fs(spark, f"{folder}/v{have['previous']}")
        fs.delete(p, True)
    return number


def read_table(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The current version, else the one before, else an empty table."""
    for number in versions(spark, folder).values():
        if number is None:
            continue
        try:
            return spark.read.parquet(f"{folder}/v{number}")
        except AnalysisException:
            continue
    return spark.createDataFrame([], schema)


#: What a catalog file of this program begins with, up to its first record; each other record has a line of its own.
HEAD = r'^\{"library_root": "(?:[^"\\]|\\.)*", "generated": "(?:[^"\\]|\\.)*", "count": [0-9]+, "files": \['
#: Bytes of a file in which its head must end.
HEAD_BYTES = 1 << 16


def _catalog_head(spark: SparkSession, path: str) -> dict | None:
    """What stands before the records of a catalog file that has them in lines of their own; None for other files."""
    fs, p = _fs(spark, path)
    if not fs.exists(p) or fs.getFileStatus(p).isDirectory():
        return None
    stream = fs.open(p)
    try:
        whole = fs.getFileStatus(p).getLen()
        start = bytes(stream.readNBytes(HEAD_BYTES)).decode("utf-8", "ignore")
        stream.seek(max(0, whole - 3))
        end = bytes(stream.readNBytes(3))
    finally:
        stream.close()
    found = re.match(HEAD, start)
    return json.loads(found[0] + "]}") if found and end == b"\n]}" else None


def read_catalog_json(spark: SparkSession, path: str) -> DataFrame:
    """A catalog file {library_root, generated, count, files}; numbers get their types from the schema.

    What ``write_catalog_json`` has written is read by lines, so any number of tasks share it. Of other files there is
    no place to start in but the first, and one task reads them.
    """
    if _catalog_head(spark, path):
        value = F.regexp_replace(F.regexp_replace("value", HEAD, ""), "^,", "")
        lines = spark.read.option("lineSep", "\n").text(path).where("value <> ']}'")
        return lines.select(F.from_json(value, CATALOG).alias("r")).select("r.*")
    raw = spark.read.schema(f"files array<struct<{', '.join(f.strip().replace(' ', ': ', 1) for f in CATALOG.split(','))}>>").json(path, multiLine=True)
    return raw.select(F.inline("files"))


def read_sidecar_json(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """A file {path: {fields}} as rows; the backup stands in for a broken or absent file, and nothing for both."""
    kind = f"map<string, struct<{', '.join(f.strip().replace(' ', ': ', 1) for f in fields.split(','))}>>"
    for candidate in (path, f"{path}.bak"):
        text = _read_text(spark, candidate)
        if not text:
            continue
        rows = spark.read.text(candidate, wholetext=True).select(F.from_json("value", kind).alias("m")).where("m IS NOT NULL")
        if rows.head(1):
            return rows.select(F.explode("m").alias("path", "_v")).select("path", "_v.*")
    names = [f.strip() for f in fields.split(",")]
    return spark.createDataFrame([], ", ".join(["path string", *names]))


def write_catalog_json(catalog: DataFrame, path: str, root: str, scanned: bool = False) -> None:
    """A catalog file for older readers, in order; control characters are scrubbed, and the time of the last scan
    (``generated``) of a file that is there is kept unless ``scanned``.

    Tasks write the records; the driver only strings their files together, byte by byte.
    """
    clean = catalog.select(*(clean_text(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in catalog.dtypes)).orderBy(F.lower("path"), "path")
    spark, rows = catalog.sparkSession, f"{path}.rows"
    seen = Observation()
    record = F.concat(F.lit(","), F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).alias("value")
    clean.select(record).observe(seen, F.count("*").alias("n")).write.mode("overwrite").text(rows)
    before = None if scanned else _catalog_head(spark, path) or _generated(spark, path)
    stamp = before["generated"] if before and before["generated"] else spark.sql("SELECT date_format(current_timestamp(), 'yyyy-MM-dd HH:mm:ss')").first()[0]
    fs, _ = _fs(spark, path)
    _, beside = _fs(spark, path + ".tmp")
    out = fs.create(beside, True)
    try:
        head = json.dumps({"library_root": root, "generated": stamp, "count": seen.get["n"]})[:-1]
        out.write(bytearray(f'{head}, "files": ['.encode()))
        parts = sorted((s for s in fs.listStatus(_fs(spark, rows)[1]) if s.getLen() and s.getPath().getName().startswith("part-")), key=lambda s: s.getPath().getName())
        for k, part in enumerate(parts):
            stream = fs.open(part.getPath())
            stream.seek(0 if k else 1)  # every record follows a separator, but for the first
            spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 16, False)
            stream.close()
        out.write(bytearray(b"]}"))
    finally:
        out.close()
    fs.delete(_fs(spark, rows)[1], True)
    replace(spark, path + ".tmp", path)


def _generated(spark: SparkSession, path: str) -> dict | None:
    """The time of a catalog file of any form."""
    fs, p = _fs(spark, path)
    found = spark.read.json(path, multiLine=True, schema="generated string").first() if fs.exists(p) and fs.getFileStatus(p).getLen() else None
    return found.asDict() if found else None


def read_vectors(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    """A vector store (path, vector, model) in Parquet, or in a NumPy archive of an older installation."""
    if not path.endswith(".npz"):
        return spark.read.parquet(path)
    import numpy as np
    import pandas as pd

    with np.load(path, allow_pickle=False) as store:
        name = str(store["model"]) if "model" in store else model
        rows = pd.DataFrame({"path": store["paths"].astype(str), "vector": [v.tolist() for v in store["vectors"].astype(np.float32)], "model": name})
    return spark.createDataFrame(rows, "path string, vector array<float>, model string")


def write_vectors(vectors: DataFrame, folder: str) -> int:
    """A vector store in catalog order."""
    return write_table(vectors, folder, [F.lower("path"), F.col("path")])


def ranked_result(found: DataFrame, query: str) -> str:
    """A ranked list as {ok, query, paths, scores}; it has as many rows as were asked for."""
    rows = found.orderBy("rank").collect()
    return json.dumps({"ok": True, "query": query, "paths": [r["path"] for r in rows], "scores": [r["score"] for r in rows]})


def read_config(path: str) -> dict:
    """The library configuration, a small JSON file beside the program."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def view_state(text: str, columns: int) -> dict:
    """A saved view state: sort, direction, search and a repaired column order; nonsense becomes the default."""
    from tessella.operators.view import repaired_order

    try:
        state = json.loads(text)
        state = state if isinstance(state, dict) else {}
    except ValueError:
        state = {}
    order = state.get("order", [])
    sort = state.get("sort", 0)
    return {
        "order": repaired_order([int(k) for k in order if isinstance(k, (int, float))] if isinstance(order, list) else [], columns),
        "sort": min(max(int(sort), 0), columns - 1) if isinstance(sort, (int, float)) else 0,
        "descending": bool(state.get("descending", False)),
        "search": str(state.get("search", "")),
    }


#: Defaults of the audio model's preprocessing, and the older names of its settings.
MEL_DEFAULTS = {"sampling_rate": 48000, "n_fft": 1024, "hop_length": 480, "feature_size": 64, "frequency_min": 50, "frequency_max": 14000, "nb_max_samples": 480000}
MEL_ALIASES = {"n_fft": ("fft_window_size", "n_fft"), "nb_max_samples": ("nb_max_samples",)}


def preprocessor(settings: dict) -> dict:
    """The model's settings over the defaults; the longest input may be given in seconds."""
    out = {k: next((settings[a] for a in MEL_ALIASES.get(k, (k,)) if a in settings), v) for k, v in MEL_DEFAULTS.items()}
    if "nb_max_samples" not in settings:
        out["nb_max_samples"] = settings.get("max_length_s", 10) * settings.get("sampling_rate", MEL_DEFAULTS["sampling_rate"])
    return out

