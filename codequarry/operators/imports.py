"""Resolving imports to files: one explode, one hash join, one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.functions import paths


def module_index(files: DataFrame) -> DataFrame:
    """module, module_paths (sorted, distinct) over every python file of (path, language), whatever its status."""
    named = files.where("language = 'python'").select("path", paths.module_name(F.col("path")).alias("module")).where("module is not null")
    return named.groupBy("module").agg(F.array_sort(F.collect_set("path")).alias("module_paths"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Adds requested_modules, status, target_path and candidate_paths to the imports of python files."""
    # a file's package is found once, not once for each of its imports
    python = files.where("language = 'python'").select("path").distinct().withColumn("__package", paths.package_name(F.col("path")))
    asked = imports.join(python, "path")
    invalid = paths.invalid_relative(F.col("level"), F.col("__package"))
    asked = asked.withColumn("__invalid", invalid)
    module = paths.requested_module(F.col("level"), F.col("module"), F.col("imported_name"), F.col("__package"))
    asked = asked.withColumn("__module", F.when(~F.col("__invalid") & (module != ""), module))
    found = asked.join(module_index(files).withColumnRenamed("module", "__known"), F.col("__module") == F.col("__known"), "left")
    empty = F.array().cast("array<string>")
    candidates = F.coalesce("module_paths", empty)
    status = (
        F.when(F.col("__invalid"), "invalid_relative_import").when(F.size(candidates) == 0, "unresolved").when(F.size(candidates) == 1, "resolved_internal").otherwise("ambiguous")
    )
    return found.select(
        *imports.columns,
        F.when(F.col("__module").isNotNull(), F.array("__module")).otherwise(empty).alias("requested_modules"),
        status.alias("status"),
        F.when(F.size(candidates) == 1, F.get(candidates, F.lit(0))).alias("target_path"),
        candidates.alias("candidate_paths"),
    )
