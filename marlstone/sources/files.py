"""Files as sources and sinks: span logs, line search, snippets, snapshots, artifacts, pages."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPAN_SCHEMA = "trace_id string, span_id string, parent_span_id string, name string, start_time_unix_nano bigint, end_time_unix_nano bigint, attributes map<string,string>, status string, session_id string"
SKIPPED_DIRECTORIES = (".git", "node_modules", "vendor", "dist", "build", ".venv", "__pycache__")


def read_span_log(spark: SparkSession, path: str, session: str | None = None, since: int | None = None, until: int | None = None) -> DataFrame:
    """Spans of JSON lines files; lines that are no JSON or have no span id are skipped."""
    rows = spark.read.schema(SPAN_SCHEMA).option("mode", "DROPMALFORMED").json(path).where("span_id is not null")
    if session is not None:
        rows = rows.where(F.col("session_id") == session)
    if since is not None:
        rows = rows.where(F.col("start_time_unix_nano") >= since)
    return rows if until is None else rows.where(F.col("start_time_unix_nano") <= until)


def write_span_log(spans: DataFrame, path: str) -> None:
    """Append spans as JSON lines, a directory per session; those of none go to ``_inbox``."""
    home = F.coalesce(F.nullif(F.trim("session_id"), F.lit("")), F.lit("_inbox"))
    spans.withColumn("session", home).write.mode("append").partitionBy("session").json(path)


def glob_pattern(glob: str) -> str:
    """The regular expression of a glob: ``**`` crosses directories, ``*`` and ``?`` do not."""
    out = re.escape(glob).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return f"(?:^|/){out}$"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``(path, line, text)`` of text files under a directory, lines counted from 1; known vendored directories are left out."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), "value")
    kept = files.where(~F.col("path").rlike("/(?:" + "|".join(map(re.escape, SKIPPED_DIRECTORIES)) + ")/"))
    return kept.select("path", F.posexplode(F.split("value", "\n")).alias("line", "text")).select("path", (F.col("line") + 1).alias("line"), "text")


def grep(source: DataFrame, pattern: str, regex: bool = False, glob: str | None = None) -> DataFrame:
    """The rows of ``source(path, line, text)`` that hold a text or, with ``regex``, match a pattern."""
    rows = source if glob is None else source.where(F.col("path").rlike(glob_pattern(glob)))
    return rows.where(F.col("text").rlike(pattern) if regex else F.contains("text", F.lit(pattern)))


def snippet(source: DataFrame, path: str, start: int, end: int, context: int = 0, most: int = 500) -> DataFrame:
    """Lines ``start`` to ``end`` and ``context`` around of the file that is ``path`` or ends in it, at most ``most`` of them."""
    first = max(1, start - context)
    inside = F.col("line").between(first, min(end + context, first + most - 1))
    return source.where(((F.col("path") == path) | F.endswith("path", F.lit(f"/{path}"))) & inside).orderBy("path", "line")


class Snapshots:
    """A table published whole: written aside, counted, and then named by one pointer file; the one before is kept."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")  # noqa: SLF001

    def manifest(self) -> dict:
        if not self._fs.exists(self._at("current.json")):
            return {}
        stream = self._fs.open(self._at("current.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def publish(self, df: DataFrame, source_revision: str = "") -> dict:
        """Write, verify and publish; a snapshot whose rows can't be read back as written is never named."""
        from pyspark.sql import Observation

        before, name, seen = self.manifest(), uuid.uuid4().hex, Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        rows = seen.get["rows"]
        if self.spark.read.parquet(f"{self.path}/{name}").count() != rows:
            raise OSError("the snapshot can't be read back as written")
        manifest = {"snapshot": name, "rows": rows, "schema": self._digest(df), "generation": before.get("generation", 0) + 1, "source_revision": source_revision, "previous": before.get("snapshot")}
        draft = self._at(f".{name}.json")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway  # noqa: SLF001
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        # One atomic step: whoever reads finds the snapshot before or this one.
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, self._at("current.json"), options)  # noqa: SLF001
        return manifest

    def read(self, previous: bool = False) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self.manifest()['previous' if previous else 'snapshot']}")

    def verify(self) -> bool:
        """Whether the published snapshot has the rows and schema its manifest names."""
        m = self.manifest()
        df = self.read()
        return df.count() == m["rows"] and self._digest(df) == m["schema"]

    @staticmethod
    def _digest(df: DataFrame) -> str:
        """Of the names and types; files know of no column that can't be null."""
        return hashlib.sha256(repr(df.dtypes).encode()).hexdigest()


class CursorError(ValueError):
    """A page cursor of another request, or of a table that has changed since."""


def page(df: DataFrame, order: list, request: str, generation: int, size: int = 50, cursor: str | None = None, most: int = 500) -> tuple[DataFrame, str]:
    """A page of ``df`` in a total ``order``, and the cursor of the next. A cursor only fits its request and generation."""
    mark, offset = hashlib.sha256(request.encode()).hexdigest()[:16], 0
    if cursor is not None:
        try:
            version, offset, whose, when = json.loads(base64.urlsafe_b64decode(cursor))
        except ValueError as e:
            raise CursorError("invalid cursor") from e
        if version != 1 or whose != mark:
            raise CursorError("invalid cursor")
        if when != generation:
            raise CursorError("stale cursor")
    size = min(size, most)
    following = base64.urlsafe_b64encode(json.dumps([1, offset + size, mark, generation]).encode()).decode()
    return df.orderBy(*order).offset(offset).limit(size), following
