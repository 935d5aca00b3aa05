"""Processing only new or changed records, by differing immutable table versions.

A :class:`VersionedTable` is a folder of immutable data files and one manifest per version. A commit adds a file
with the changed records and, where they replace earlier ones, a deletion vector: which key is no longer live in
which file. The version of each source that a run has processed is saved in the manifest of the run's own
output, so output and progress become visible in one atomic step: a run that dies before it leaves no trace and
is simply run again, and a run that is repeated after it finds nothing to do.

What changed between two versions follows from their manifests: rows of files that only the later has are new, rows
of files that only the earlier has and keys of deletion vectors that only the later has are gone, and a record that
is on both sides has changed only if its values have. A file both versions have is never read.

:meth:`VersionedTable.take_runs` turns a ledger of runs into versions: each succeeded run is a commit of a file of
its entries and of the deletion vectors of the earlier ones. A table that lies somewhere as immutable files becomes
a version without being copied by :meth:`VersionedTable.adopt`. :func:`record_delta` is the difference between two
sets of live records; :func:`live_of_runs` says in one plain aggregation what ``take_runs`` and ``read`` give and is
what they are tested against.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def instant(text: Column) -> Column:
    """Nanoseconds since 1970 of an RFC 3339 text of any zone and precision; null if it is none."""
    shape = r"^\s*(\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d)(?:[.,](\d{1,9})\d*)?\s*([Zz]|[+-]\d\d:?\d\d)?\s*$"
    whole, part, zone = (F.regexp_extract(text, shape, k) for k in (1, 2, 3))
    zone = F.when((zone == "") | (F.upper(zone) == "Z"), "+00:00").otherwise(zone)
    seconds = F.unix_seconds(F.try_to_timestamp(F.concat(F.translate(whole, "tT", "  "), zone)))
    return F.when(text.rlike(shape), seconds * F.lit(1_000_000_000) + F.rpad(part, 9, "0").cast("bigint"))


def live_of_runs(ledger: DataFrame, runs: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The live ``keys + values`` after all succeeded runs of ``ledger(run_id, ...)``.

    Each succeeded run's entries are one added file; its deletion vector holds the keys of that file in earlier
    ones, so that of each key the newest entry lives. Runs that failed or whose status is null committed nothing.
    Of several entries of one run for a key the greatest wins. The entries are pre-aggregated before the shuffle.
    """
    succeeded = runs.where(F.col("status") == "succeeded").select("run_id").distinct()
    files = ledger.join(succeeded, "run_id", "left_semi")
    newest = files.groupBy(*keys).agg(F.max(F.struct("run_id", *values)).alias("_entry"))
    return newest.select(*keys, *[F.col(f"_entry.{v}").alias(v) for v in values])


def record_delta(current: DataFrame, live: DataFrame, keys: list[str], changed: Column) -> DataFrame:
    """The keys of ``current`` that are not live, or whose live record ``changed``, one row each.

    In ``changed``, the columns of ``live`` are called ``live.<name>`` and those of ``current`` ``now.<name>``.
    Null keys equal each other. A ``changed`` of null counts as unchanged.
    """
    return _changed(current, live, keys, changed).select(*[F.col(f"now.{k}").alias(k) for k in keys]).distinct()


def _changed(current: DataFrame, live: DataFrame, keys: list[str], changed: Column) -> DataFrame:
    rows, old = current.alias("now"), live.withColumn("_live", F.lit(True)).alias("live")
    on = [F.col(f"now.{k}").eqNullSafe(F.col(f"live.{k}")) for k in keys]
    return rows.join(old, on, "left").where(F.col("live._live").isNull() | F.coalesce(changed, F.lit(False)))


class VersionedTable:
    """A table of immutable versions under ``path``, keyed by ``keys``.

    A manifest holds ``files`` (name to folder; an adopted one also has ``columns``), ``vectors`` (folders of rows
    ``_file, *keys``: the key is dead in that file), ``schema`` of the rows and ``processed``, versions of sources.
    Null keys equal each other. A column that a file lacks is null.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")  # noqa: SLF001

    def _names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._at(folder))] if self._fs.exists(self._at(folder)) else []

    def version(self) -> int:
        """The newest committed version; 0 before the first."""
        return max([int(n[:-5]) for n in self._names("versions") if n.endswith(".json") and n[0] != "."], default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version == 0:
            return {"version": 0, "files": {}, "vectors": [], "schema": None, "processed": {}}
        stream = self._fs.open(self._at(f"versions/{version:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> int:
        """Make a manifest visible, all at once; ``FileExistsError`` if its version is there already."""
        number = manifest["version"]
        draft, final = self._at(f"versions/.{uuid.uuid4().hex}"), self._at(f"versions/{number:012d}.json")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise FileExistsError(f"version {number} is already there")
        return number

    def _merged(self, schema: str | None, df: DataFrame) -> str:
        known = StructType.fromJson(json.loads(schema)) if schema else StructType()
        for field in df.schema:
            if field.name not in known.names:
                known = known.add(field.name, field.dataType, True)
            elif known[field.name].dataType != field.dataType:
                raise ValueError(f"{field.name} has another type than before")
        return known.json()

    def commit(self, upserts: DataFrame | None = None, deletes: DataFrame | None = None, processed: dict | None = None, base: int | None = None, replace: bool = False) -> int:
        """Publish a version that adds ``upserts`` (one row per key) and removes the keys of ``deletes``.

        ``base`` is the version the writer has worked from: if another was committed since, nothing is changed and
        ``FileExistsError`` raised, so a slow run can't put older rows over newer ones. With ``replace`` the files
        before it are left out of the version, which then holds ``upserts`` alone. ``processed`` names the versions
        of the sources this one covers.
        """
        old = self.manifest(base)
        if self.version() != old["version"]:
            raise FileExistsError(f"version {old['version']} is no longer the newest")
        new = {**old, "version": old["version"] + 1, "files": {} if replace else dict(old["files"]), "vectors": [] if replace else list(old["vectors"]), "processed": {**old["processed"], **(processed or {})}}
        gone = [deletes.select(*self.keys)] if deletes is not None else []
        if upserts is not None:
            name = uuid.uuid4().hex
            upserts.write.parquet(f"{self.path}/data/_batch={name}/_file={name}")
            new["files"][name] = {"path": f"{self.path}/data/_batch={name}/_file={name}"}
            new["schema"] = self._merged(old["schema"], upserts)
            gone.append(self.spark.read.schema(upserts.schema).parquet(new["files"][name]["path"]).select(*self.keys))
        if gone and old["files"] and not replace:
            keys = gone[0] if len(gone) == 1 else gone[0].unionByName(gone[1])
            live = self._live(old, list(old["files"])).select("_file", *self.keys).alias("l")
            vector = f"{self.path}/deleted/{uuid.uuid4().hex}"
            live.join(keys.distinct().alias("g"), self._same("l", "g"), "left_semi").write.parquet(vector)
            new["vectors"].append(vector)
        return self._publish(new)

    def compact(self) -> int:
        """Publish a version of the same records in one new file, so that later commits read no long history."""
        old = self.manifest()
        rows = self._live(old, list(old["files"])).drop("_file") if old["files"] else None
        return self.commit(rows, base=old["version"], replace=True)

    def adopt(self, path: str, columns: list[str], processed: dict | None = None) -> int:
        """Publish a version that holds the ``columns`` of the immutable parquet files at ``path`` and nothing else.

        Nothing is copied: the manifest points to them.
        """
        old = self.manifest()
        rows = self.spark.read.parquet(path).select(*columns)
        file = {"path": path, "columns": columns}
        return self._publish({**old, "version": old["version"] + 1, "files": {uuid.uuid4().hex: file}, "vectors": [], "schema": self._merged(old["schema"], rows), "processed": {**old["processed"], **(processed or {})}})

    def take_runs(self, ledger: DataFrame, runs: DataFrame, values: list[str]) -> int:
        """A version for each succeeded run of ``ledger(run_id, *keys, *values)``, in their order; the newest version.

        Runs that failed or whose status is null committed nothing. Of several entries of one run for a key the
        greatest counts. Entries are reduced before they are exchanged, and written in ranges of (run, keys), so
        that a run of most of the entries is spread over as many tasks. A key has at most one row per run.
        """
        done = runs.where(F.col("status") == "succeeded").select("run_id").distinct()
        entries = ledger.join(done, "run_id", "left_semi").groupBy("run_id", *self.keys).agg(F.max(F.struct(*values)).alias("_v"))
        later = F.lead("run_id").over(Window.partitionBy(*self.keys).orderBy("run_id"))
        rows = entries.select("run_id", *self.keys, *[F.col(f"_v.{v}").alias(v) for v in values], later.alias("_by"))
        batch = uuid.uuid4().hex
        sorted_rows = rows.withColumns({"_batch": F.lit(batch), "_file": F.col("run_id").cast("string")}).repartitionByRange("run_id", *self.keys)
        sorted_rows.drop("run_id").write.partitionBy("_batch", "_file").parquet(f"{self.path}/data")
        written_at = f"data/_batch={batch}"
        files = {n.removeprefix("_file="): {"path": f"{self.path}/{written_at}/{n}"} for n in self._names(written_at) if n.startswith("_file=")}
        stored = rows.drop("run_id")
        back = self.spark.read.schema(StructType([*stored.schema.fields, StructField("_file", StringType())])).option("basePath", f"{self.path}/data")
        if files:
            dead = back.parquet(*[f["path"] for f in files.values()]).where("_by is not null").select("_file", *self.keys, "_by")
            dead.write.partitionBy("_by").parquet(f"{self.path}/deleted/{batch}")
        vectors = {n.removeprefix("_by="): f"{self.path}/deleted/{batch}/{n}" for n in self._names(f"deleted/{batch}") if n.startswith("_by=")}
        now = self.manifest()
        now["schema"] = self._merged(now["schema"], stored.drop("_by"))
        for run in sorted(files, key=int):
            now = {**now, "version": now["version"] + 1, "files": {**now["files"], run: files[run]}, "vectors": [*now["vectors"], *([vectors[run]] if run in vectors else [])], "processed": {**now["processed"], "run": int(run)}}
            self._publish(now)
        return now["version"]

    def _same(self, one: str, two: str) -> list[Column]:
        return [F.col(f"{one}.{k}").eqNullSafe(F.col(f"{two}.{k}")) for k in self.keys]

    def _live(self, manifest: dict, names: list[str]) -> DataFrame:
        """The live rows of some files of a version, with the file of each in ``_file``: one scan, one anti-join."""
        schema = StructType.fromJson(json.loads(manifest["schema"]))
        out = None
        own = [manifest["files"][n]["path"] for n in names if "columns" not in manifest["files"][n]]
        if own:
            wide = StructType([*schema.fields, StructField("_file", StringType())])
            out = self.spark.read.schema(wide).option("basePath", f"{self.path}/data").parquet(*own).select(*wide.names)
        for n in names:
            file = manifest["files"][n]
            if "columns" in file:
                rows = self.spark.read.parquet(file["path"]).select(*[F.col(f.name) if f.name in file["columns"] else F.lit(None).cast(f.dataType).alias(f.name) for f in schema], F.lit(n).alias("_file"))
                out = rows if out is None else out.unionByName(rows)
        if out is None:
            return self.spark.createDataFrame([], StructType([*schema.fields, StructField("_file", StringType())]))
        if not manifest["vectors"]:
            return out
        dead = self._dead(manifest["vectors"])
        return out.alias("r").join(dead.alias("d"), [F.col("r._file") == F.col("d._file"), *self._same("r", "d")], "left_anti")

    def _dead(self, vectors: list[str]) -> DataFrame:
        return self.spark.read.parquet(*vectors).select("_file", *self.keys)

    def read(self, version: int | None = None) -> DataFrame | None:
        """The live records of a version; None if it has no file."""
        manifest = self.manifest(version)
        return self._live(manifest, list(manifest["files"])).drop("_file") if manifest["files"] else None

    def delta(self, since: int, until: int | None = None, changed: Column | None = None) -> tuple[DataFrame | None, DataFrame | None]:
        """``(upserted rows, keys deleted)`` between two versions, from their two manifests.

        Added rows are the live rows of files only the later has. Gone are the live rows of files only the earlier
        has and those that deletion vectors only the later has took from files both have. Upserted are the added
        rows without a gone one of the same key, or for which ``changed`` holds (see :func:`record_delta`; without
        it, any other value is a change). Deleted are the keys that are gone and not added.
        """
        old, new = self.manifest(since), self.manifest(until)
        fresh = [n for n in new["files"] if n not in old["files"]]
        left = [n for n in old["files"] if n not in new["files"]]
        kept = [n for n in new["files"] if n in old["files"]]
        vectors = [v for v in new["vectors"] if v not in old["vectors"]]
        added = self._live(new, fresh).drop("_file") if fresh else None
        parts = [self._live(old, left)] if left else []
        if vectors and kept:
            struck = self._dead(vectors).alias("v")
            rows = self._live(old, kept).alias("k")
            parts.append(rows.join(struck, [F.col("k._file") == F.col("v._file"), *self._same("k", "v")], "left_semi"))
        if not parts:
            return added, None
        gone = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        gone = gone.drop("_file")
        if added is None:
            return None, gone.select(*self.keys)
        values = [c for c in added.columns if c not in self.keys]
        differs = ~F.struct(*[F.col(f"now.{c}") for c in values]).eqNullSafe(F.struct(*[F.col(f"live.{c}") for c in values])) if values else F.lit(False)
        upserted = _changed(added, gone, self.keys, differs if changed is None else changed).select(*[F.col(f"now.{c}").alias(c) for c in added.columns])
        deleted = gone.select(*self.keys).alias("g").join(added.select(*self.keys).alias("a"), self._same("g", "a"), "left_anti")
        return upserted, deleted


def run_incrementally(source: VersionedTable, output: VersionedTable, name: str, process) -> int | None:
    """Process what ``source`` gained since the version saved in ``output``; the new output version, or None.

    ``process`` maps the upserted rows to output rows of the same keys. If another run commits to ``output`` in the
    meantime, this one changes nothing and raises ``FileExistsError``.
    """
    base = output.manifest()
    done, now = base["processed"].get(name, 0), source.version()
    if done >= now:
        return None
    upserted, deleted = source.delta(done, now)
    return output.commit(process(upserted) if upserted is not None else None, deleted, {name: now}, base=base["version"])
