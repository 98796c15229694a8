"""Reading files safely, and classifying what was read."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.functions.text import clean_text
from codequarry.operators.config import validate_limit

MOST_BYTES, SAMPLE, BATCH_BYTES = 8 * 1024 * 1024, 2048, 8 * 1024 * 1024
UNSAFE = ("escaped_symlink", "outside_project", "path_mismatch")
SCHEMA = "path string, status string, content string, resolved_path string, size_bytes long, is_symlink boolean, error_type string, error_message string"


def content_status(content: Column, size: Column, limit: int = MOST_BYTES) -> Column:
    """binary if a sample of the bytes has a NUL, else oversized beyond the limit, else text."""
    sample = F.substring(content, 1, min(SAMPLE, limit + 1))
    return F.when(F.contains(sample, F.lit(bytearray(b"\x00"))), "binary").when(size > limit, "oversized").otherwise("text")


def read_one(root: str, path: str, limit: int = MOST_BYTES) -> dict:
    """The ladder of checks for one file below ``root``; content only if its status is text."""
    base = Path(root).resolve()
    row: dict = {"path": path, "status": None, "content": None, "resolved_path": None, "size_bytes": None, "is_symlink": False, "error_type": None, "error_message": None}

    def failed(error: Exception) -> dict:
        return row | {"status": "unreadable", "error_type": type(error).__name__, "error_message": str(error)}

    lexical = Path(os.path.abspath(base / path))
    if not lexical.is_relative_to(base):
        return row | {"status": "outside_project"}
    if lexical.relative_to(base).as_posix() != path:
        return row | {"status": "path_mismatch"}
    if lexical.is_symlink():
        row["is_symlink"] = True
        try:
            resolved = lexical.resolve(strict=True)
        except (OSError, RuntimeError) as error:
            return failed(error)
        return row | {"resolved_path": str(resolved), "status": "symlink" if resolved.is_relative_to(base) else "escaped_symlink"}
    try:
        resolved = lexical.resolve(strict=True)
    except (OSError, RuntimeError) as error:
        return failed(error)
    row["resolved_path"] = str(resolved)
    if not resolved.is_relative_to(base):
        return row | {"status": "outside_project"}
    try:
        facts = resolved.stat()
        row["size_bytes"] = facts.st_size
        if not stat.S_ISREG(facts.st_mode):
            return row | {"status": "unreadable", "error_type": "UnsupportedFileType", "error_message": "not a regular file"}
        with resolved.open("rb") as file:
            sample = file.read(min(SAMPLE, limit + 1))
            if b"\x00" in sample:
                return row | {"status": "binary"}
            if facts.st_size > limit:
                return row | {"status": "oversized"}
            data = sample + file.read(limit + 1 - len(sample))
            now = os.fstat(file.fileno()).st_size
    except OSError as error:
        return failed(error)
    row["size_bytes"] = max(facts.st_size, now, len(data))
    if len(data) > limit or row["size_bytes"] > limit:
        return row | {"status": "oversized"}
    return row | {"status": "text", "content": data.decode("utf-8", "ignore")}


def read_files(files: DataFrame, root: str, limit: int = MOST_BYTES) -> DataFrame:
    """``SCHEMA`` for every path of ``files``; the root has to be mounted where executors run.

    A batch is handed on as soon as its texts reach ``BATCH_BYTES``.
    """
    limit = validate_limit(limit)
    types = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    arrow = pa.schema([(f.split()[0], types[f.split()[1]]) for f in SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for path in batch.column(0).to_pylist():
                rows.append(read_one(root, path, limit))
                held += len(rows[-1]["content"] or "")
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.select("path").mapInArrow(run, SCHEMA).withColumn("content", clean_text(F.col("content")))


def summary(evidence: DataFrame) -> DataFrame:
    """One row of the counters of a source report."""
    named = {"added_files": "text", "skipped_binary_files": "binary", "skipped_oversized_files": "oversized", "skipped_unreadable_files": "unreadable", "skipped_symlink_files": "symlink"}
    counts = [F.count_if(F.col("status") == status).alias(name) for name, status in named.items()]
    return evidence.agg(*counts, F.count_if(F.col("status").isin(*UNSAFE)).alias("skipped_unsafe_path_files")).select(
        "*", F.lit(0).cast("long").alias("skipped_ignored_files"), F.lit(0).cast("long").alias("skipped_markdown_error_files")
    )


def log_line(path: Column, status: Column, size: Column, error_type: Column, error_message: Column) -> Column:
    """What a report run says of a file."""
    detail = F.concat(F.coalesce(error_type, F.lit("UnknownError")), F.when(F.coalesce(error_message, F.lit("")) != "", F.concat(F.lit(": "), error_message)).otherwise(F.lit("")))
    skip = F.concat(F.lit("[SKIP "), F.replace(status, F.lit("_"), F.lit("-")), F.lit("] "), path)
    return (
        F.when(status == "text", F.concat(F.lit("[ADD] "), path))
        .when(status == "oversized", F.concat(skip, F.lit(" -> "), F.coalesce(F.concat(size.cast("string"), F.lit(" bytes")), F.lit("unknown size"))))
        .when(status == "unreadable", F.concat(skip, F.lit(" -> "), detail))
        .otherwise(skip)
    )
