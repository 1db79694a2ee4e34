"""A live directory tree as rows of a manifest, and manifests as Parquet."""

from __future__ import annotations

import os
import stat

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import MANIFEST

#: Extended attributes that are not recorded live in the caller's list; files of other kinds
#: than these are skipped.
_KINDS = {stat.S_IFDIR: "DIR", stat.S_IFREG: "FILE", stat.S_IFLNK: "SYMLINK"}


class _Part(InputPartition):
    def __init__(self, top: str | None):
        self.value = top


class TreeReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self):
        tops = sorted(e.name for e in os.scandir(self.root))
        return [_Part(None), *map(_Part, tops)]

    def read(self, partition):
        if partition.value is None:
            row = self._row(self.root, ".")
            if row:
                yield row
            return
        todo = [partition.value]
        while todo:
            rel = todo.pop()
            full = os.path.join(self.root, rel)
            row = self._row(full, rel)
            if row:
                yield row
                if row[1] == "DIR":
                    todo += [f"{rel}/{e.name}" for e in os.scandir(full)]

    @staticmethod
    def _row(full: str, rel: str):
        s = os.lstat(full)
        kind = _KINDS.get(stat.S_IFMT(s.st_mode))
        if kind is None:
            return None
        link = os.readlink(full) if kind == "SYMLINK" else None
        return (rel, kind, s.st_mode, int(s.st_mtime), s.st_size if kind == "FILE" else None, s.st_uid, s.st_gid, link, None, None, [], False)


class TreeSource(DataSource):
    """``spark.read.format("file_tree").option("path", root)``: one partition per top-level entry."""

    @classmethod
    def name(cls):
        return "file_tree"

    def schema(self):
        return MANIFEST

    def reader(self, schema):
        return TreeReader(self.options["path"])


def scan_tree(spark: SparkSession, root: str) -> DataFrame:
    spark.dataSource.register(TreeSource)
    return spark.read.format("file_tree").option("path", root).load()


def write_manifest(manifest: DataFrame, path: str) -> None:
    """Rows in path order as Parquet."""
    manifest.orderBy("path").write.mode("overwrite").parquet(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(path)
