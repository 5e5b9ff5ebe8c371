"""The rescan pipeline: catalog, levels and chops, fingerprints, text vectors, audio vectors; each step is incremental."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import schema
from tessella.functions import columns as C
from tessella.operators import analysis, catalog, edits
from tessella.sources import audio, stores, tracklists


@dataclass
class Library:
    """A library's audio root and the folder of its tables."""

    spark: SparkSession
    root: str
    store: str

    def table(self, name: str) -> DataFrame:
        kinds = {"catalog": schema.CATALOG, "chopping": schema.CHOPPING, "loudness": schema.LOUDNESS, "userdata": schema.USERDATA, "fingerprints": schema.VECTORS, "embeddings": schema.VECTORS, "audio_vectors": schema.VECTORS}
        return stores.read_table(self.spark, f"{self.store}/{name}", kinds[name])

    def put(self, name: str, df: DataFrame) -> None:
        stores.write_table(df, f"{self.store}/{name}", [F.lower("path"), F.col("path")])

    def uris(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("uri", F.concat(F.lit(self.root.rstrip("/") + "/"), "path"))

    def index(self, full: bool = False) -> dict:
        """Scan, read the headers of new and changed files, enrich, and commit the catalog as a whole."""
        files, cache = audio.scan(self.spark, self.root), self.table("catalog")
        listed = tracklists.index(tracklists.load(self.spark, self.root))

        def parse(some: DataFrame) -> DataFrame:
            return catalog.enrich(audio.with_headers(some), listed).select(*cache.columns)

        parsed = files if full else catalog.split_reused(files, cache).where("NOT reused")
        new = catalog.incremental(files, cache, parse, full=full)
        before, read = cache.count(), parsed.count()
        self.put("catalog", new)
        count = self.table("catalog").count()
        return {"ok": True, "count": count, "parsed": read, "reused": count - read, "changed": read > 0 or count != before}

    def analyse(self, gap_s: float = 1.5, sound_s: float = 0.3, only_missing: bool = False, paths: DataFrame | None = None, min_duration: float = 0.0, only: str | None = None) -> dict:
        """Chop parameters and loudness in one read of each file, or only the table named; what is too short is continuous
        without being read."""
        chopping, loudness = self.table("chopping"), self.table("loudness")
        wanted = [t for name, t in (("chopping", chopping), ("loudness", loudness)) if only in (None, name)]
        records = self.table("catalog")
        if only == "chopping" and not only_missing and paths is None:  # what has its size and these parameters stays, with its manual edits
            records = catalog.stale(records, chopping, {"min_gap_s": F.lit(gap_s), "min_sound_s": F.lit(sound_s)})
        if only == "loudness" and not only_missing and paths is None:
            records = catalog.stale(records, loudness.withColumn("continuous", F.lit(False)), {})
        work = catalog.work_list(records, *(wanted if only_missing else []), min_duration=min_duration)
        work = catalog.targeted(work, paths) if paths is not None else work
        short = F.col("continuous")
        levels = analysis.analysed(self.uris(work.where(~short)), loudness=only != "chopping")
        sizes = work.select("path", "size")
        stored = f"{self.store}/levels"
        stores.write_table(levels, stored)
        levels = stores.read_table(self.spark, stored, analysis.LEVELS).where("error IS NULL")
        if only != "loudness":
            made = analysis.chops(levels, gap_s, sound_s).join(sizes, "path")
            brief = work.where(short).drop("continuous").select("path", *(F.lit(None).cast("double").alias(c) for c in ("silence_db", "min_gap_s", "min_sound_s")), F.lit(1).alias("chops"), F.lit(True).alias("continuous"), "size")
            self.put("chopping", edits.analysed_chop(chopping, made.unionByName(brief).select(*chopping.columns)))
        if only != "chopping":
            loud = levels.select("path", "lufs", F.lit(None).cast("double").alias("rms_db"), "peak_db").join(sizes, "path").select(*loudness.columns)
            self.put("loudness", catalog.upsert(loudness, loud))
        return {"ok": True, "analysed": levels.count(), "total": work.count()}

    def _vectors(self, name: str, make, only_missing: bool) -> dict:
        records, old = self.table("catalog"), self.table(name)
        work = catalog.missing(records, old) if only_missing else records
        stores.write_vectors(catalog.merge_vectors(old, make(work), records), f"{self.store}/{name}")
        return {"ok": True, "total": self.table(name).count()}

    def fingerprint(self, only_missing: bool = True) -> dict:
        return self._vectors("fingerprints", lambda rows: analysis.fingerprints(self.uris(rows.where("ext = 'wav'"))), only_missing)

    def embed(self, embedder=None, only_missing: bool = True) -> dict:
        text = C.doc_text(F.col("filename"), F.col("description"), F.col("library"), F.col("supplier"))
        return self._vectors("embeddings", lambda rows: analysis.text_vectors(rows.withColumn("text", text), embedder or analysis.HashingEmbedder()), only_missing)

    def embed_audio(self, embedder, settings: dict | None = None, only_missing: bool = True) -> dict:
        make = lambda rows: analysis.audio_vectors(self.uris(rows.where("ext = 'wav'")), embedder, settings or stores.MEL_DEFAULTS)
        return self._vectors("audio_vectors", make, only_missing)

    def derive(self, made: DataFrame) -> dict:
        """Write derived files (parent, uri, content) and upsert their records, with the parents' origin."""
        folder = f"{self.store}/derived"
        stores.write_table(made, folder)
        made = stores.read_table(self.spark, folder, "parent string, uri string, content binary")
        written = audio.write_wavs(made).count()
        prefix = self.root.rstrip("/") + "/"
        heads = audio.with_headers(made.select("parent", "uri")).drop("description")
        child = heads.withColumns({"path": F.expr(f"substring(uri, {len(prefix) + 1})"), "mtime": F.unix_timestamp()}).join(made.select("uri", F.octet_length("content").cast("long").alias("size")), "uri")
        old = self.table("catalog")
        records = catalog.child_records(old, child.drop("uri")).select(*old.columns)
        self.put("catalog", catalog.upsert(old, records))
        return {"ok": True, "written": written, "paths": [r["path"] for r in records.select("path").orderBy("path").collect()]}

    def rename_invalid(self) -> DataFrame:
        """Rename files with invalid names, then their keys in every table that goes by path; returns (old, new) of what
        was renamed. Vector stores are made anew."""
        root = F.lit(self.root.rstrip("/") + "/")
        planned = catalog.plan_renames(self.table("catalog")).withColumns({"old_uri": F.concat(root, "old"), "new_uri": F.concat(root, "new")})
        # Written before and after, so that a plan is made once and files move once.
        stores.write_table(planned, f"{self.store}/planned-renames")
        planned = stores.read_table(self.spark, f"{self.store}/planned-renames", "old string, new string, old_uri string, new_uri string")
        stores.write_table(audio.rename_files(planned).select("old", "new"), f"{self.store}/renames")
        moves = stores.read_table(self.spark, f"{self.store}/renames", "old string, new string")
        if not moves.head(1):
            return moves
        for name in ("catalog", "userdata", "chopping", "loudness"):
            moved = catalog.rename(self.table(name), moves)
            self.put(name, moved.withColumn("filename", F.element_at(F.split("path", "/"), -1)) if name == "catalog" else moved)
        return moves

    def delete(self, paths: DataFrame, trash: str) -> DataFrame:
        """Move files to a trash folder and take their records out of catalog and user data; returns the (path) that went.
        Their analyses stay behind."""
        gone = catalog.targeted(self.table("catalog"), paths).select("path")
        at = lambda folder: F.concat(F.lit(folder.rstrip("/") + "/"), "path")
        stores.write_table(audio.rename_files(gone.withColumns({"old_uri": at(self.root), "new_uri": at(trash)})).select("path"), f"{self.store}/deleted")
        gone = stores.read_table(self.spark, f"{self.store}/deleted", "path string")
        for name, rows in zip(("catalog", "userdata"), edits.deleted(self.table("catalog"), self.table("userdata"), gone)):
            self.put(name, rows)
        return gone

    def rescan(self, embedder=None, audio_embedder=None) -> dict[str, dict]:
        """All steps in order; a step that fails leaves the results of those before it."""
        steps = {"index": self.index, "analyse": lambda: self.analyse(only_missing=True), "fingerprint": self.fingerprint, "embed": lambda: self.embed(embedder)}
        if audio_embedder is not None:
            steps["embed_audio"] = lambda: self.embed_audio(audio_embedder)
        return {name: step() for name, step in steps.items()}
