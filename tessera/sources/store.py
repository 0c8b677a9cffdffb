"""Tables in a folder on any Hadoop file system, and one manifest that says which of their versions count.

A version is written to a folder of its own and counts once a manifest names it. A commit is one new
manifest, for any number of tables at once: readers see all of it or nothing, and a run that fails
before it has changed nothing. There is one writer at a time.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Manifests, with the versions that they name, that stay for readers that began before the last commit.
KEEP = 2


class Files:
    """The few calls of a path's own file system that are needed here."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.root = root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._text = spark._jvm.org.apache.commons.io.IOUtils

    def _at(self, name: str):
        return self._path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(name))) if self.exists(name) else []

    def children(self, name: str = "") -> tuple[list[str], list[str]]:
        """Names of the folders and of the files in a folder; links are not followed."""
        folders: list[str] = []
        plain: list[str] = []
        if self._fs.getUri().getScheme() == "file":  # the same, without a call to the JVM for every name
            place = Path(self._fs.makeQualified(self._at(name)).toUri().getPath())
            for entry in os.scandir(place) if place.is_dir() else []:
                (folders if entry.is_dir(follow_symlinks=False) else plain).append(entry.name)
            return sorted(folders), sorted(plain)
        for s in self._fs.listStatus(self._at(name)) if self.exists(name) else []:
            (folders if s.isDirectory() else plain).append(s.getPath().getName())
        return sorted(folders), sorted(plain)

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._text.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """A whole new file or, if there is one of the name, an error: written aside and renamed."""
        aside = f"{name}.{uuid.uuid4().hex}"
        stream = self._fs.create(self._at(aside), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self.exists(name) or not self._fs.rename(self._at(aside), self._at(name)):
            self._fs.delete(self._at(aside), False)
            raise FileExistsError(f"{self.root}/{name}")

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


class Store:
    """Named tables below ``root``; ``manifest`` has their current folders and whatever else a commit records."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, StructType | str]) -> None:
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)
        self.schemas = {name: StructType.fromDDL(s) if isinstance(s, str) else s for name, s in schemas.items()}

    def _numbers(self) -> list[str]:
        return [n for n in self.files.names("_manifest") if n.endswith(".json")]

    def manifest(self) -> dict:
        numbers = self._numbers()
        return json.loads(self.files.read(f"_manifest/{numbers[-1]}")) if numbers else {"tables": {}}

    def path(self, folder: str) -> str:
        return f"{self.root}/{folder}"

    def new_folder(self, name: str) -> str:
        return f"{name}/v-{time.time_ns()}-{uuid.uuid4().hex[:6]}"

    def read(self, name: str, manifest: dict | None = None) -> DataFrame:
        folder = (manifest or self.manifest())["tables"].get(name)
        schema = self.schemas[name]
        return self.spark.createDataFrame([], schema) if folder is None else self.spark.read.schema(schema).parquet(self.path(folder))

    def write(self, name: str, rows: DataFrame) -> str:
        """The folder of a new version, which does not count before it is committed."""
        folder = self.new_folder(name)
        columns = [F.col(f.name).cast(f.dataType) for f in self.schemas[name].fields]
        rows.select(*columns).write.option("compression", "zstd").parquet(self.path(folder))
        return folder

    def commit(self, tables: dict[str, str | None], **more) -> None:
        """One manifest with these versions (None: the table is empty) and values; what only older ones than the kept ones name is deleted."""
        numbers, old = self._numbers(), self.manifest()
        named = {k: v for k, v in (old["tables"] | tables).items() if v is not None}
        number = int(numbers[-1].split(".")[0]) + 1 if numbers else 0
        self.files.create(f"_manifest/{number:020}.json", json.dumps(old | more | {"tables": named}))
        self._clean()

    def _clean(self) -> None:
        numbers = self._numbers()
        for gone in numbers[:-KEEP]:
            self.files.delete(f"_manifest/{gone}")
        kept = "".join(self.files.read(f"_manifest/{n}") for n in numbers[-KEEP:])
        for name in self.files.names():
            for version in self.files.names(name) if not name.startswith("_") else []:
                if version.startswith("v-") and f"{name}/{version}" not in kept:
                    self.files.delete(f"{name}/{version}")


class VersionedTable:
    """One table in a folder of its own."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str) -> None:
        self.store = Store(spark, path, {"rows": schema})

    @property
    def version(self) -> str | None:
        return self.store.manifest()["tables"].get("rows")

    def read(self) -> DataFrame:
        return self.store.read("rows")

    def write(self, snapshot: DataFrame) -> None:
        self.store.commit({"rows": self.store.write("rows", snapshot)})

    def wipe(self) -> None:
        self.store.commit({"rows": None})
