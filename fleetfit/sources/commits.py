"""Tables of committed writes: files first, then one small manifest that names them.

A write is known by its writer and batch. Its files go to a folder of their own; they belong to the table from the moment
its manifest stands under the name of writer and batch, which a single rename does. So a write that broke off leaves files
that nobody reads, a write that is repeated finds its manifest and does nothing, and of two at once one wins.

Small commits may be merged into one that replaces them; their manifests stay, so that a repeated write is still known.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any, NamedTuple
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MANIFEST = "name string, files string, level int, replaces array<string>"
MERGER = "merged"
#: So many commits of one level are merged into one of the next.
MERGE_AFTER = 8


class Commit(NamedTuple):
    name: str
    files: str
    level: int
    replaces: list[str]


class CommitTable:
    """The table in folder ``path`` of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # --- manifests, through Spark's own file systems -------------------------------------------

    def _file_system(self) -> tuple[Any, Callable[[str], Any]]:
        jvm = self.spark._jvm
        conf = self.spark._jsparkSession.sessionState().newHadoopConf()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(jvm.java.net.URI(self.path), conf)
        return files, lambda p: jvm.org.apache.hadoop.fs.Path(p)

    def _exists(self, path: str) -> bool:
        files, at = self._file_system()
        return files.util().exists(at(path))

    def _put(self, name: str, text: str) -> bool:
        """Whether a manifest of this name is written now; false where there is one already."""
        files, at = self._file_system()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        fs = at(self.path).getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        fs.mkdirs(at(f"{self.path}/commits"))
        own = at(f"{self.path}/commits/_{uuid.uuid4().hex}")
        out = fs.create(own, False)
        out.write(bytearray(text.encode()))
        out.close()
        options = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(own, at(self._manifest(name)), options)  # refuses a name that is taken
        except Exception as refused:
            if not self._exists(self._manifest(name)):
                raise refused
            fs.delete(own, False)
            return False
        return True

    def _manifest(self, name: str) -> str:
        return f"{self.path}/commits/{name}.json"

    def commits(self) -> list[Commit]:
        """All commits. Manifests are read by Spark; only their few fields come to the driver."""
        if not self._exists(f"{self.path}/commits"):
            return []
        rows = self.spark.read.schema(MANIFEST).json(f"{self.path}/commits").collect()
        return [Commit(r["name"], r["files"], r["level"] or 0, r["replaces"] or []) for r in rows]

    def live(self) -> list[Commit]:
        """The commits that make up the table now, in the order of their names."""
        found = self.commits()
        gone = {name for c in found for name in c.replaces}
        return sorted((c for c in found if c.name not in gone), key=lambda c: c.name)

    # --- writing and reading -------------------------------------------------------------------

    def write(self, rows: DataFrame, partition_by: list[str] | None = None) -> str:
        """Write files that belong to no commit yet; returns their folder's name."""
        files = uuid.uuid4().hex
        rows.write.mode("errorifexists").partitionBy(*(partition_by or [])).parquet(f"{self.path}/data/commit={files}")
        return files

    def commit(self, name: str, files: str, level: int = 0, replaces: list[str] | None = None) -> bool:
        content = {"name": name, "files": files, "level": level, "replaces": replaces or []}
        return self._put(name, json.dumps(content))

    def append(self, rows: DataFrame, writer: str, batch: object, partition_by: list[str] | None = None) -> bool:
        """Add ``rows`` as this batch of the writer. False, and nothing is computed, where that batch is there already."""
        name = f"{quote(writer, safe='')}.{quote(str(batch), safe='')}"
        if self._exists(self._manifest(name)):
            return False
        return self.commit(name, self.write(rows, partition_by))

    def read(self, schema: T.StructType | None = None, commits: list[Commit] | None = None) -> DataFrame:
        """The rows of all live commits, or of the given ones. Without any commit ``schema`` is needed."""
        chosen = self.live() if commits is None else commits
        if not chosen:
            if schema is None:
                raise ValueError(f"nothing has been committed to {self.path}")
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.option("basePath", f"{self.path}/data")
        if schema is not None:
            reader = reader.schema(T.StructType([*schema.fields, T.StructField("commit", T.StringType())]))
        return reader.parquet(*[f"{self.path}/data/commit={c.files}" for c in chosen]).drop("commit")

    def merge(self, combine: Callable[[DataFrame], DataFrame], after: int = MERGE_AFTER, schema: T.StructType | None = None) -> int:
        """Merge every ``after`` commits of a level into one of the next by ``combine``; returns how many merges were made.

        A row is rewritten once per level, so the cost per row grows with the logarithm of the number of commits."""
        made, levels = 0, {}
        for c in self.live():
            levels.setdefault(c.level, []).append(c)
        for level in sorted(levels):
            while len(levels[level]) >= after:
                some, levels[level] = levels[level][:after], levels[level][after:]
                name = f"{MERGER}.{level + 1}.{uuid.uuid4().hex}"
                files = self.write(combine(self.read(schema, some)))
                self.commit(name, files, level + 1, [c.name for c in some])
                levels.setdefault(level + 1, []).append(Commit(name, files, level + 1, []))
                made += 1
        return made
