"""Column expressions over paths and module names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parent_key(path: Column) -> Column:
    """The directory of a path, empty at the root."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)).otherwise(F.lit(""))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def order_key(path: Column, is_directory: bool = False) -> Column:
    """Sorting by this array gives a directory's files first, then its directories, depth first."""
    parts = F.split(path, "/")
    above = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.concat(F.lit("1"), p))
    return F.concat(above, F.array(F.concat(F.lit("1" if is_directory else "0"), F.element_at(parts, -1))))


def policy_path(path: Column, prefix: str | None) -> Column:
    """A path as ignore rules see it when only a part of a project is scanned."""
    clean = (prefix or "").replace("\\", "/").strip("/")
    return F.concat_ws("/", F.lit(clean), path) if clean else path


def _python_stem(path: Column) -> Column:
    """A .py path without its ending; null for other paths.

    Names are cut by patterns that mention their input once: conditions on these
    columns are pushed below joins, and an input used often would be copied often.
    """
    return F.regexp_extract(F.when(F.lower(path).endswith(".py"), path), r"(?si)^(.*)\.py\z", 1)


def _dotted(slashed: Column) -> Column:
    return F.nullif(F.translate(slashed, "/", "."), F.lit(""))


def module_name(path: Column) -> Column:
    """The dotted name, without a leading src and without __init__."""
    own = F.regexp_replace(_python_stem(path), r"(?:^|/)__init__\z", "")
    return _dotted(F.regexp_replace(own, r"^src/", ""))


def is_package(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?i)\.py\z", "") == "__init__"


def package_name(path: Column) -> Column:
    """The dotted name of the package that relative imports start from."""
    inner = F.regexp_replace(_python_stem(path), r"^src/(?!__init__\z)", "")
    return _dotted(F.regexp_replace(inner, r"(?:^|/)[^/]*\z", ""))


def requested_module(level: Column, module: Column, imported: Column, package: Column) -> Column:
    """The module that an import asks for; null where it asks for none or reaches too far up."""
    parts = F.split(package, "[.]")
    base = F.when(package.isNotNull() & (level - 1 < F.size(parts)), F.slice(parts, F.lit(1), F.greatest(F.size(parts) - (level - 1), F.lit(0))))
    last = F.coalesce(F.when(module != "", module), imported)
    relative = F.when(base.isNotNull(), F.concat_ws(".", F.array_join(base, "."), last))
    return F.when(level == 0, module).otherwise(relative)


def invalid_relative(level: Column, package: Column) -> Column:
    return (level > 0) & (package.isNull() | (level - 1 >= F.size(F.split(package, "[.]"))))


def from_bound_name(imported: Column, alias: Column) -> Column:
    return F.when(imported.isNotNull(), F.coalesce(alias, imported))


def plain_bound_name(module: Column, imported: Column, alias: Column) -> Column:
    return F.when(imported.isNull(), F.coalesce(alias, F.when(~F.contains(module, F.lit(".")), module)))


def scope_visible(binding: Column, call: Column) -> Column:
    return F.coalesce(binding.isNull() | binding.eqNullSafe(call) | call.startswith(F.concat(binding, F.lit("."))), F.lit(False))
