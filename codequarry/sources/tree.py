"""A Python data source that lists a directory tree, hidden names and links included.

    spark.dataSource.register(TreeSource)
    spark.read.format("repotree").option("root", "/project").load()

Rows are (path, name, is_directory, is_symlink, error).  Links are never followed:
a link to a directory is no directory, and nothing below it is listed.  A
directory that cannot be listed is a row with the error, so that whoever reaches
it decides.  The upper levels are dealt into partitions until there are
``PARTITIONS`` of them; the root has to be mounted where executors run.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from codequarry.functions import patterns
from codequarry.functions.paths import order_key

SCHEMA = "path string, name string, is_directory boolean, is_symlink boolean, error string"
PARTITIONS = 64


class ScanError(Exception):
    pass


@dataclass
class Top(InputPartition):
    """An entry, with or without what is below it."""

    path: str
    below: bool


class TreeReader(DataSourceReader):
    def __init__(self, root: str, skip: dict[str, list[str]], prefix: str) -> None:
        self.root, self.skip, self.prefix = root, skip, prefix

    def _skipped(self, path: str, name: str) -> bool:
        """If configuration excludes a directory, so that it need not be walked at all."""
        whole = f"{self.prefix}{path}/"
        return any(patterns.python_regex(e).search(name) for e in self.skip.get("names", ())) or any(patterns.python_regex(e).search(whole) for e in self.skip.get("paths", ()))

    def _entry(self, path: str) -> tuple[tuple | None, list[str]]:
        """An entry's row (none for a link to a directory) and the paths below it."""
        whole = os.path.join(self.root, path)
        link, directory, name = os.path.islink(whole), os.path.isdir(whole), os.path.basename(path)
        if directory and link:
            return None, []
        error, below = None, []
        if directory and not self._skipped(path, name):
            try:
                below = [f"{path}/{n}" for n in sorted(os.listdir(whole))]
            except OSError as failed:
                error = f"{path} cannot be listed: {failed.strerror or failed}"
        return (path, name, directory, link, error), below

    def partitions(self) -> list[Top]:
        """The root's entries, and those below them level by level while there are few."""
        level, done = sorted(os.listdir(self.root)), []
        while level and len(done) + len(level) < PARTITIONS:
            done += [Top(path, False) for path in level]
            level = [lower for path in level for lower in self._entry(path)[1]]
        return done + [Top(path, True) for path in level]

    def read(self, partition: Top) -> Iterator[tuple]:
        todo = [partition.path]
        while todo:
            row, below = self._entry(todo.pop())
            if row:
                yield row
            if partition.below:
                todo.extend(reversed(below))


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repotree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        root = self.options.get("root")
        if not root or not os.path.isdir(root):
            raise ScanError(f"not a directory: {root}")
        return TreeReader(root, json.loads(self.options.get("skip", "{}")), self.options.get("prefix", ""))


def entries(spark: SparkSession, root: str, names: list[str] | tuple[str, ...] = (), paths: list[str] | tuple[str, ...] = (), prefix: str | None = None) -> DataFrame:
    """All entries below ``root``; directories whose name or path (behind ``prefix``) fits one of the expressions are not walked."""
    try:
        os.listdir(root)
    except OSError as error:
        raise ScanError(f"{root} cannot be listed: {error.strerror or error}") from error
    spark.dataSource.register(TreeSource)
    source = spark.read.format("repotree").option("root", root).option("skip", json.dumps({"names": list(names), "paths": list(paths)}))
    return source.option("prefix", f"{prefix.strip('/')}/" if prefix else "").load()


def ordered(found: DataFrame) -> DataFrame:
    """Adds ord_key: a directory's files, then its directories, depth first."""
    key = F.when(F.col("is_directory"), order_key(F.col("path"), True)).otherwise(order_key(F.col("path")))
    return found.withColumn("ord_key", key)


def gitignore_lines(found: DataFrame, root: str) -> DataFrame:
    """(base_dir, rule_ord, line, error) of every .gitignore among the entries that is no link; one row for a file that cannot be read."""
    import pyarrow as pa

    schema = pa.schema([("base_dir", pa.string()), ("rule_ord", pa.int32()), ("line", pa.string()), ("error", pa.string())])

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                base = os.path.dirname(path)
                try:
                    with open(os.path.join(root, path), encoding="utf-8-sig") as file:
                        rows = [{"base_dir": base, "rule_ord": k, "line": line} for k, line in enumerate(file.read().split("\n"))]
                except (OSError, UnicodeDecodeError) as error:
                    rows = [{"base_dir": base, "error": f"{path} cannot be read: {error}"}]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    chosen = found.where("name = '.gitignore' AND NOT is_directory AND NOT is_symlink").select("path")
    return chosen.mapInArrow(run, "base_dir string, rule_ord int, line string, error string")
