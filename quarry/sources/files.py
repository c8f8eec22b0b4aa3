"""A table as a list of its live Parquet files, so that rows can be taken out by writing only the files that hold them.

``add`` appends files; ``rewrite`` reads the files that hold given keys, writes
what is left of them, and leaves all others as they are, names included. A
change becomes visible at once, when the next version of the list is in place
(created under another name and renamed; a version that is there already is an
error, so two writers never overwrite each other). Only then files that are no
longer listed are removed: nothing that was taken out stays on disk. A run that
stops before leaves the former version as it was; what it wrote is never
listed and goes with ``sweep``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LIST = "_live"
#: The part of a file's address that stands in the list.
NAME = r"/(d-[0-9a-f]{32}/.*)$"


class Files:
    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, options: dict[str, str] | None = None):
        self.spark, self.path, self.schema, self.options = spark, path.rstrip("/"), schema, options or {}

    def _store(self, path: str):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """Number of the newest list, 0 for a table that was never written."""
        where, fs = self._store(f"{self.path}/{LIST}")
        if not fs.exists(where):
            return 0
        return max((int(s.getPath().getName()) for s in fs.listStatus(where) if s.getPath().getName().isdigit()), default=0)

    def names(self) -> list[str]:
        """Live files, by their names below the table's folder."""
        version = self.version()
        if not version:
            return []
        where, fs = self._store(f"{self.path}/{LIST}/{version}")
        stream = fs.open(where)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return text.split("\n") if text else []

    def chosen(self, names: Iterable[str] | None = None, parts: Iterable[int] | None = None) -> list[str]:
        """Live files, or those of ``names``, of some parts (of tables that are written with ``by``) if these are given."""
        names = self.names() if names is None else list(names)
        wanted = None if parts is None else {f"part={p}" for p in parts}
        return [n for n in names if wanted is None or n.split("/")[1] in wanted]

    def read(self, names: Iterable[str] | None = None, parts: Iterable[int] | None = None) -> DataFrame:
        """The rows of the chosen files, all live ones if none are named."""
        chosen = self.chosen(names, parts)
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*[f"{self.path}/{n}" for n in chosen]) if chosen else self.spark.createDataFrame([], self.schema)

    def add(self, rows: DataFrame, by: Column | None = None, drop: Iterable[str] = ()) -> list[str]:
        """Writes rows (with ``by``, a small number, in a folder for each of its values) and lists them instead of ``drop``."""
        columns = self.spark.createDataFrame([], self.schema).columns
        folder = f"d-{uuid.uuid4().hex}"
        writer = (rows.select(*columns) if by is None else rows.select(*columns, by.alias("part"))).write.options(**self.options)
        (writer if by is None else writer.partitionBy("part")).parquet(f"{self.path}/{folder}")
        where, fs = self._store(f"{self.path}/{folder}")
        found, new = fs.listFiles(where, True), []
        while found.hasNext():
            name = found.next().getPath().toString()
            if name.endswith(".parquet"):
                new.append(name[name.rindex(folder) :])
        self._list(new, set(drop))
        return new

    def _list(self, new: list[str], drop: set[str]) -> None:
        version = self.version()
        names = [n for n in self.names() if n not in drop] + new
        target, fs = self._store(f"{self.path}/{LIST}/{version + 1}")
        draft, _ = self._store(f"{self.path}/{LIST}/.{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray("\n".join(names).encode()))
        out.close()
        if fs.exists(target) or not fs.rename(draft, target):
            fs.delete(draft, False)
            raise RuntimeError(f"version {version + 1} of {self.path} was written by another")
        for name in drop:
            where, _ = self._store(f"{self.path}/{name}")
            fs.delete(where, False)
        for old in range(1, version + 1):
            where, _ = self._store(f"{self.path}/{LIST}/{old}")
            fs.delete(where, False)

    def holding(self, keys: DataFrame, on: list[str], parts: Iterable[int] | None = None) -> list[str]:
        """Live files with a row of these keys. Of the files only the key columns are read."""
        chosen = self.chosen(parts=parts)
        if not chosen:
            return []
        rows = self.read(chosen).select(*on, F.regexp_extract("_metadata.file_path", NAME, 1).alias("file"))
        return sorted(r["file"] for r in rows.join(keys.select(*on).distinct(), on, "left_semi").select("file").distinct().collect())

    def rewrite(self, keys: DataFrame, on: list[str], change: Callable[[DataFrame], DataFrame] | None = None, by: Column | None = None, parts: Iterable[int] | None = None, more: DataFrame | None = None) -> list[str]:
        """Takes rows with these keys out, or puts ``change`` of their files' rows in place of these, and adds ``more``, in
        one version; returns the files that were written anew."""
        touched = self.holding(keys, on, parts)
        rows = self.read(touched)
        left = change(rows) if change else rows.join(keys.select(*on).distinct(), on, "left_anti")
        if touched or more is not None:
            self.add(left if more is None else left.unionByName(more), by, touched)
        return touched

    def sweep(self) -> int:
        """Removes files that no list has: what a run that stopped left behind. Returns how many."""
        where, fs = self._store(self.path)
        live, gone, found = set(self.names()), 0, fs.listFiles(where, True)
        while found.hasNext():
            at = found.next().getPath()
            name = at.toString()
            place = name.find("/d-", len(where.toString()) - 1)
            if place >= 0 and name[place + 1 :] not in live:
                gone += name.endswith(".parquet")
                fs.delete(at, False)
        return gone
