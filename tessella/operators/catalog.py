"""Catalog operators: enrichment, sidecar joins, work lists, upserts, renames and derived records."""

from __future__ import annotations

from functools import reduce
from itertools import chain, count

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import columns as C


def enrich(files: DataFrame, tracklist: DataFrame, key: str = "filename") -> DataFrame:
    """Files with library, supplier and url: the tracklist's where it has them, else those of the folder.

    ``tracklist`` has one row for each lower-case file name; Spark broadcasts it only while it is small.
    """
    listed = tracklist.select(F.lower(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in ("library", "supplier", "url")))
    folder = C.folder_fallback(F.col("path"))
    out = files.withColumn("_folder", folder).join(listed, F.lower(files[key]) == F.col("_key"), "left")
    given = lambda c: F.nullif(F.col(f"_{c}"), F.lit(""))
    return out.withColumns(
        {
            "bundle": F.col("_folder.bundle"),
            "library": F.coalesce(given("library"), F.col("_folder.library")),
            "supplier": F.coalesce(given("supplier"), F.col("_folder.supplier")),
            "url": F.coalesce(given("url"), F.lit("")),
        }
    ).drop("_folder", "_key", "_library", "_supplier", "_url")


def with_sidecars(catalog: DataFrame, userdata: DataFrame, chopping: DataFrame, loudness: DataFrame, key: str = "path") -> DataFrame:
    """The catalog with its three sidecars: left joins on the path, with the defaults of what is missing."""
    chops = chopping.select(
        key,
        *(F.when(F.col("silence_db").isNotNull(), F.col(c)).alias(c) for c in ("silence_db", "min_gap_s", "min_sound_s")),
        "chops",
        "continuous",
    )
    out = reduce(lambda a, b: a.join(b, key, "left"), (userdata.drop("size"), chops, loudness.drop("size")), catalog)
    return out.withColumns({"rating": F.coalesce("rating", F.lit(0)), "plays": F.coalesce("plays", F.lit(0)), "tags": F.coalesce("tags", F.lit("")), "final_db": C.final_db(F.col("lufs"), F.col("gain_db"))})


def split_reused(files: DataFrame, cache: DataFrame, key: str = "path") -> DataFrame:
    """Files with ``reused``: whether the cached record has the same size and mtime."""
    old = cache.select(F.col(key).alias("_key"), F.col("size").alias("_size"), F.col("mtime").alias("_mtime"))
    same = F.coalesce((F.col("size") == F.col("_size")) & (F.col("mtime") == F.col("_mtime")), F.lit(False))
    return files.join(old, files[key] == F.col("_key"), "left").withColumn("reused", same).drop("_key", "_size", "_mtime")


def incremental(files: DataFrame, cache: DataFrame, parse, key: str = "path", full: bool = False) -> DataFrame:
    """The new catalog: cached records of unchanged files, ``parse`` of the others; files that are gone drop out.

    A file is unchanged where path, size and mtime are, so each side is one join on the three.
    """
    if full:
        return parse(files)
    same = [key, "size", "mtime"]
    kept = cache.join(files.select(*same), same, "left_semi").select(*cache.columns)
    return kept.unionByName(parse(files.join(cache.select(*same), same, "left_anti").select(*files.columns)), allowMissingColumns=True)


def changed(parsed: DataFrame, cache: DataFrame, now: DataFrame) -> DataFrame:
    """One row with ``changed``: something was parsed, or the number of records differs."""
    counts = [x.agg(F.count("*").alias(n)) for x, n in ((parsed, "parsed"), (cache, "before"), (now, "after"))]
    return reduce(lambda a, b: a.join(b), counts).withColumn("changed", (F.col("parsed") > 0) | (F.col("before") != F.col("after")))


def missing(catalog: DataFrame, *stores: DataFrame, key: str = "path") -> DataFrame:
    """Records that at least one store lacks."""
    out, absent = catalog, F.lit(False)
    for k, store in enumerate(stores):
        out = out.join(store.select(F.col(key).alias(f"_k{k}")).distinct(), F.col(key) == F.col(f"_k{k}"), "left")
        absent = absent | F.col(f"_k{k}").isNull()
    return out.where(absent).select(*catalog.columns)


def stale(catalog: DataFrame, store: DataFrame, parameters: dict[str, Column], key: str = "path") -> DataFrame:
    """Records whose stored analysis is absent, of another size, or made with other parameters.

    A continuous record was made without parameters, so only its size counts.
    """
    old = store.select(F.col(key).alias("_key"), F.col("size").alias("_size"), F.coalesce("continuous", F.lit(False)).alias("_continuous"), *(F.col(c).alias(f"_{c}") for c in parameters))
    same = F.col("size") == F.col("_size")
    made = reduce(lambda a, b: a & b, (F.col(f"_{c}").eqNullSafe(x) for c, x in parameters.items()), F.lit(True))
    fresh = F.coalesce(same & (F.col("_continuous") | made), F.lit(False))
    return catalog.join(old, catalog[key] == F.col("_key"), "left").where(~fresh).select(*catalog.columns)


def targeted(catalog: DataFrame, paths: DataFrame, key: str = "path") -> DataFrame:
    return catalog.join(paths.select(key), key, "left_semi")


def without(catalog: DataFrame, paths: DataFrame, key: str = "path") -> DataFrame:
    return catalog.join(paths.select(key), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """Old records but for those that come anew, and the new ones."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def merge_vectors(old: DataFrame, new: DataFrame, catalog: DataFrame, key: str = "path") -> DataFrame:
    """New vectors win; only those of the present catalog stay."""
    return upsert(old, new, key).join(catalog.select(key), key, "left_semi")


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: a grouped maximum, which is pre-aggregated, not a window."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_best"))
    return best.select(*keys, "_best.*").select(*rows.columns)


def needs_16_bit(catalog: DataFrame) -> DataFrame:
    """Records of over 16 bits whose 16-bit sibling is not in the catalog."""
    deep = catalog.where(F.col("bit_depth") > 16).withColumn("_sibling", C.sibling_path(F.col("path"), "_16bit.wav"))
    return deep.join(catalog.select(F.col("path").alias("_sibling")), "_sibling", "left_anti").drop("_sibling")


def siblings(catalog: DataFrame, suffix: str) -> DataFrame:
    """(path, sibling): records whose sibling with ``suffix`` is in the catalog."""
    other = catalog.select(F.col("path").alias("sibling"))
    return catalog.select("path", C.sibling_path(F.col("path"), suffix).alias("_s")).join(other, F.col("_s") == F.col("sibling")).where("path <> sibling").select("path", "sibling")


def inherit(children: DataFrame, parents: DataFrame, fields: list[str], parent_key: str = "parent") -> DataFrame:
    """Children (with their parent's path) with the parent's values wherever they have none."""
    own = [c for c in fields if c in children.columns]
    given = parents.select(F.col("path").alias("_parent"), *(F.col(c).alias(f"_{c}") for c in fields))
    out = children.join(given, children[parent_key] == F.col("_parent"), "left")
    return out.withColumns({c: F.coalesce(c, f"_{c}") if c in own else F.col(f"_{c}") for c in fields}).drop("_parent", *(f"_{c}" for c in fields))


def rename(rows: DataFrame, renames: DataFrame, key: str = "path") -> DataFrame:
    """Rows under their new paths; ``renames`` has (old, new)."""
    moved = rows.join(renames, rows[key] == renames["old"], "left").withColumn(key, F.coalesce("new", key))
    return moved.select(*rows.columns)


def plan_renames(catalog: DataFrame) -> DataFrame:
    """(old, new) for invalid file names: cleaned, with the first number that no other name of the folder has.

    Names that could meet differ in their numbers alone, so they go to one task: those of a folder with one extension and
    one stem. Files are renamed in the order of the catalog.
    """
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", r"/[^/]*$", "/")).otherwise(F.lit(""))
    bad = C.has_invalid_name(F.col("filename"))
    clean = F.when(bad, C.valid_name(F.col("filename"))).otherwise(F.col("filename"))
    dotted = r"^(.+)(\.[^.]*)$"
    named = catalog.select("path", folder.alias("_folder"), bad.alias("_bad"), clean.alias("_clean"))
    named = named.withColumns({"_dot": F.regexp_extract("_clean", dotted, 2), "_stem": F.when(F.col("_clean").rlike(dotted), F.regexp_extract("_clean", dotted, 1)).otherwise(F.col("_clean"))})
    named = named.withColumn("_root", F.regexp_replace("_stem", r"(_\d+)+$", ""))
    group = ["_folder", "_root", "_dot"]

    def number(rows: pd.DataFrame) -> pd.DataFrame:
        taken, moves = set(rows.loc[~rows["_bad"], "_clean"]), []
        wanted = rows.loc[rows["_bad"], ["path", "_folder", "_clean", "_stem", "_dot"]]
        for path, folder, name, stem, dot in sorted(wanted.itertuples(index=False, name=None), key=lambda r: (r[0].lower(), r[0])):
            new = next(n for n in chain([name], (f"{stem}_{k}{dot}" for k in count(1))) if n not in taken)
            taken.add(new)
            moves.append((path, folder + new))
        return pd.DataFrame(moves, columns=["old", "new"])

    concerned = named.join(named.where("_bad").select(*group).distinct(), group, "left_semi")
    return concerned.groupBy(*group).applyInPandas(number, "old string, new string")


def child_records(parents: DataFrame, children: DataFrame) -> DataFrame:
    """Catalog records of derived files (parent, path, size, mtime, duration, sample_rate, channels, bit_depth), with the parent's origin."""
    origin = parents.select(F.col("path").alias("parent"), "bundle", "library", "supplier", "url", "description")
    out = children.join(origin, "parent", "left")
    return out.withColumns({"filename": F.element_at(F.split("path", "/"), -1), "ext": C.extension(F.col("path"))}).drop("parent")


def first_with_prefix(catalog: DataFrame, name: str, length: int = 30) -> DataFrame:
    """The first record whose file name starts with the first characters of ``name``; of equal names the last record."""
    return latest(catalog.where(F.col("filename").startswith(name[:length])), ["filename"], ["path"]).orderBy("path").limit(1)


def work_list(catalog: DataFrame, *stores: DataFrame, min_duration: float = 0.0) -> DataFrame:
    """WAV records, those that a store lacks if stores are given, with ``continuous``: too short to be read at all."""
    wav = catalog.where(F.col("ext") == "wav")
    return (missing(wav, *stores) if stores else wav).withColumn("continuous", C.is_short(F.col("duration"), min_duration))


def effective_params(records: DataFrame, chopping: DataFrame, suggested: Column, settings: dict[str, Column], key: str = "path") -> DataFrame:
    """Records with the chop parameters that hold: the saved ones where there are any, else the suggested threshold and the present settings."""
    fields = ["silence_db", *settings]
    saved = chopping.select(key, *(F.col(c).alias(f"_{c}") for c in fields))
    joined, has = records.join(saved, key, "left"), F.col("_silence_db").isNotNull()
    values = {"silence_db": suggested} | settings
    return joined.withColumns({c: F.when(has, F.col(f"_{c}")).otherwise(x) for c, x in values.items()}).drop(*(f"_{c}" for c in fields))


def counted(records: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """One row: the number of records, and of those that each condition holds for."""
    return records.agg(F.count("*").alias("records"), *(F.count_if(x).alias(c) for c, x in conditions.items()))
