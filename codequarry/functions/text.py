"""Column expressions over file contents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DROPPED_CHARACTERS = r"[^\t\n\r\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]"


def clean_text(content: Column) -> Column:
    """Content without control characters and non-characters."""
    return F.regexp_replace(content, DROPPED_CHARACTERS, "")


def longest_backtick_run(content: Column) -> Column:
    runs = F.transform(F.regexp_extract_all(content, F.lit("(`+)"), F.lit(1)), F.length)
    return F.coalesce(F.array_max(runs), F.lit(0))


def safe_fence(content: Column) -> Column:
    """A fence that no run of backticks inside closes."""
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), longest_backtick_run(content) + 1))


def is_blank(content: Column) -> Column:
    return content.rlike(r"(?U)^[\s\x1c-\x1f]*$")


def section(path: Column, content: Column, label: Column) -> Column:
    """One file of a source report."""
    head = F.concat(F.lit("# `"), path, F.lit("`\n\n"))
    fence = safe_fence(content)
    body = F.concat(fence, label, F.lit("\n"), content, F.lit("\n"), fence, F.lit("\n\n"))
    return F.concat(head, F.when(is_blank(content), F.lit("[empty file]\n\n")).otherwise(body), F.lit("---\n\n"))
