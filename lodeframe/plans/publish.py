"""Publishing tables as a new folder of any store that Spark writes to, whole or not at all.

Tables are written by the executors into a folder beside the destination. The executors also work out the digest of each
part, a rename that never replaces anything puts the folder into its place, and a manifest, written last, names every
part with its size and digest: a folder without one is no publication.
"""

from __future__ import annotations

import hashlib
import json
from contextlib import suppress
from pathlib import Path
from typing import Any
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import EngineError
from ..functions.scalars import fingerprint
from ..operators.tables import safe_table_name
from ..sources.writers import safe_columns

MANIFEST = "manifest.json"
#: Files of a publication that aren't parts of it.
BESIDE = (MANIFEST, "audit.json")


class Store:
    """What publishing asks of the file system that a path belongs to, by Hadoop's interface."""

    def __init__(self, spark: SparkSession, path: str | Path):
        self.jvm = spark.sparkContext._jvm
        self.gateway = spark.sparkContext._gateway
        self.fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        uri = self.fs.makeQualified(self._path(path)).toUri()
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri, self.fs.getConf())

    def _path(self, path: str | Path):
        return self.jvm.org.apache.hadoop.fs.Path(str(path))

    def qualified(self, path: str | Path) -> str:
        return self.fs.makeQualified(self._path(path)).toString()

    def exists(self, path: str | Path) -> bool:
        return self.fs.exists(self._path(path))

    def make(self, path: str | Path) -> None:
        self.fs.mkdirs(self._path(path))

    def delete(self, path: str | Path) -> None:
        self.fs.delete(self._path(path), True)

    def move(self, path: str | Path, to: str | Path) -> None:
        """A rename that fails where anything, an empty folder too, is already."""
        if self.exists(to):
            raise EngineError(f"{Path(str(to)).name} exists already")
        none = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        self.context.rename(self._path(path), self._path(to), none)

    def write(self, path: str | Path, text: str) -> None:
        stream = self.fs.create(self._path(path), False)
        try:
            stream.write(text.encode())
        finally:
            stream.close()

    def read(self, path: str | Path) -> str:
        stream = self.fs.open(self._path(path))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def files(self, path: str | Path) -> list[tuple[str, int, int]]:
        """(path below it, bytes, time of change) of all files below a folder, or of a file itself under its name."""
        top, found = self.qualified(path), []
        if self.fs.getFileStatus(self._path(path)).isFile():
            status = self.fs.getFileStatus(self._path(path))
            return [(status.getPath().getName(), status.getLen(), status.getModificationTime())]
        each = self.fs.listFiles(self._path(path), True)
        while each.hasNext():
            status = each.next()
            found.append((status.getPath().toString().removeprefix(top).lstrip("/"), status.getLen(), status.getModificationTime()))
        return sorted(found)


def source_state(spark: SparkSession, path: str | Path) -> tuple[str, int]:
    """(SHA-256, bytes) of a file or folder: of its content on this machine, else of the names, sizes and times of change of
    its files, as reading a large source once more is dearer than a job."""
    store = Store(spark, path)
    if store.qualified(path).startswith("file:"):
        return fingerprint(str(path).removeprefix("file://").removeprefix("file:"))
    found = store.files(path)
    return hashlib.sha256(repr(found).encode()).hexdigest(), sum(f[1] for f in found)


def output_names(keys: list[tuple[Any, str]], files: dict[Any, str]) -> dict[tuple[Any, str], str]:
    """The name that each table, known by source and sheet, leaves the engine under: its sheet, or with several sources
    the source's file name, ' - ' and the sheet. No two are equal, whatever their case."""
    named: dict[tuple[Any, str], str] = {}
    taken: set[str] = set()
    for source, sheet in sorted(keys, key=lambda k: (str(k[0]), k[1])):
        wanted = f"{Path(files[source]).stem} - {sheet}" if len(files) > 1 else sheet
        name, n = wanted, 1
        while name.casefold() in taken:
            n += 1
            name = f"{wanted} ({n})"
        taken.add(name.casefold())
        named[source, sheet] = name
    return named


def write_parts(tables: dict[str, DataFrame], folder: str, kind: str) -> dict[str, dict[str, Any]]:
    """A folder of parts for each table, written by the executors; what of the manifest is known before the digests."""
    known, taken = {}, set()
    for name, df in tables.items():
        own = safe_table_name(name, taken)
        if kind == "csv":
            safe_columns(df).write.options(header=True, quote='"', escape='"').csv(f"{folder}/{own}")
        else:
            df.write.parquet(f"{folder}/{own}")
        known[name] = {"folder": own, "format": kind, "schema": df.schema.jsonValue()}
    return known


def digests(spark: SparkSession, folder: str) -> dict[str, dict[str, Any]]:
    """Bytes and SHA-256 of each part below a folder, by its path there; the executors read the parts. A row for each part
    meets on the driver."""
    parts = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    own = F.substring_index("path", "/" + folder.rstrip("/").rsplit("/", 1)[-1] + "/", -1)
    rows = parts.select(own.alias("path"), "length", F.sha2("content", 256).alias("sha256")).collect()
    return {r["path"]: {"bytes": r["length"], "sha256": r["sha256"]} for r in sorted(rows, key=lambda r: r["path"])}


class Publication:
    """A folder beside the destination, which becomes it by commit(); leaving the block without that deletes the folder, or
    with an error and a ``failed_folder``, in the same store, moves it there."""

    def __init__(self, spark: SparkSession, destination: str | Path, failed_folder: str | Path | None = None, job: str = "job"):
        self.spark, self.store = spark, Store(spark, destination)
        self.destination, self.failed_folder, self.job = self.store.qualified(destination).rstrip("/"), failed_folder, job
        if self.store.exists(self.destination):
            raise EngineError(f"{Path(self.destination).name} exists already")
        if failed_folder and not Store(spark, failed_folder).qualified("/") == self.store.qualified("/"):
            raise EngineError("the folder for failed results has to be in the destination's store")
        self.parent, _, name = self.destination.rpartition("/")
        self.folder = f"{self.parent}/.staged-{name}-{uuid4().hex}"
        self.moved = self.done = False

    def __enter__(self) -> Publication:
        self.store.make(self.folder)
        return self

    def local(self) -> Path:
        """The staged folder for writers that know local files only."""
        if not self.folder.startswith("file:"):
            raise EngineError("this writer needs a destination on this machine")
        return Path(self.folder.removeprefix("file:").replace("//", "/"))

    def commit(self, manifest: dict[str, Any]) -> None:
        """``manifest["parts"]`` gives the bytes of each part, which have to be there after the rename as well."""
        self.store.move(self.folder, self.destination)
        self.moved = True
        there = {path: size for path, size, _ in self.store.files(self.destination)}
        lost = [path for path, part in manifest["parts"].items() if there.get(path) != part["bytes"]]
        if lost:
            raise EngineError(f"{len(lost)} parts didn't arrive whole, {lost[0]} among them")
        self.store.write(f"{self.destination}/{MANIFEST}", json.dumps(manifest, default=str, indent=1))
        self.done = True

    def __exit__(self, kind, error, trace) -> None:
        if self.done:
            return
        place = self.destination if self.moved else self.folder
        if error is not None and self.failed_folder and self.store.files(place):
            self.store.make(self.failed_folder)
            to = f"{self.store.qualified(self.failed_folder).rstrip('/')}/{self.job}-{uuid4().hex}"
            self.store.move(place, to)
            self.store.write(f"{to}/failed.txt", str(error))
        with suppress(Exception):  # the error that led here is the one to tell
            self.store.delete(place)


def publish(
    spark: SparkSession, tables: dict[str, DataFrame], destination: str | Path, kind: str = "parquet", more: dict[str, Any] | None = None
) -> dict[str, Any]:
    """Publishes tables and returns the manifest."""
    with Publication(spark, destination) as staged:
        known = write_parts(tables, staged.folder, kind)
        manifest = (more or {}) | {"tables": known, "parts": digests(spark, staged.folder)}
        staged.commit(manifest)
    return manifest


def published(spark: SparkSession, folder: str | Path, verify: bool = False) -> dict[str, DataFrame]:
    """The tables of a publication by name; with ``verify``, only if all parts still have their digests."""
    store = Store(spark, folder)
    if not store.exists(f"{folder}/{MANIFEST}"):
        raise EngineError(f"{Path(str(folder)).name} is not a publication")
    manifest = json.loads(store.read(f"{folder}/{MANIFEST}"))
    if verify and {k: v for k, v in digests(spark, store.qualified(folder)).items() if k not in BESIDE} != manifest["parts"]:
        raise EngineError(f"{Path(str(folder)).name} has changed since it was published")
    tables = {}
    for name, t in manifest["tables"].items():
        schema = T.StructType.fromJson(t["schema"])
        reader = spark.read.schema(schema)
        place = f"{store.qualified(folder)}/{t['folder']}"
        tables[name] = reader.options(header=True, quote='"', escape='"').csv(place) if t["format"] == "csv" else reader.parquet(place)
    return tables
