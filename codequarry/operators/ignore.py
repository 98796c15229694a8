"""Ignore rules: names, project paths and nested gitignore files."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.functions import patterns
from codequarry.operators.shared import materialise

NEVER = r"[^\s\S]"
BROADCAST_RULES = 100_000


def any_of(text: Column, expressions: list[str]) -> Column:
    """One regular expression for a configuration's rules; they are few, and constants."""
    return text.rlike("|".join(f"(?:{e})" for e in expressions) or NEVER)


@dataclass(frozen=True)
class IgnoreRules:
    """Rules of one kind (folders or files), split by whether they name a path."""

    names: tuple[str, ...]
    paths: tuple[str, ...]

    @classmethod
    def of(cls, rules: list[str]) -> IgnoreRules:
        globs = tuple(patterns.glob_regex(r) for r in rules if "/" not in r)
        found = (patterns.gitignore_rule(r, literal_start=True) for r in rules if "/" in r)
        return cls(globs, tuple(r.regex for r in found if r))

    def matches(self, name: Column, path: Column, is_directory: bool) -> Column:
        whole = F.concat(path, F.lit("/")) if is_directory else path
        return any_of(name, list(self.names)) | any_of(whole, list(self.paths))


def gitignore_rules(lines: DataFrame) -> DataFrame:
    """(base_dir, rule_ord, regex, negated) from (base_dir, rule_ord, line); lines are few next to files."""
    schema = "base_dir string, rule_ord int, regex string, negated boolean"

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for base, order, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rule = patterns.gitignore_rule(line)
                if rule:
                    rows.append({"base_dir": base, "rule_ord": order, "regex": rule.regex, "negated": rule.negated})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("base_dir", pa.string()), ("rule_ord", pa.int32()), ("regex", pa.string()), ("negated", pa.bool_())]))

    return lines.select("base_dir", F.col("rule_ord").cast("int"), "line").mapInArrow(run, schema)


def ancestors(path: Column) -> Column:
    """The directories above a path, from the root (empty) down."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def gitignore_verdicts(entries: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, is_directory, ignored) for the entries that some rule speaks of; the deepest rule set's last match decides.

    An equi-join on ancestor directories stands in for a prefix join.  The root's
    rules are met by every entry, so rules are broadcast up to ``BROADCAST_RULES``.
    """
    above = entries.select("path", "is_directory", F.explode(ancestors(F.col("path"))).alias("base_dir"))
    rules = materialise(rules)
    joined = above.join(F.broadcast(rules) if rules.count() <= BROADCAST_RULES else rules, "base_dir")
    inside = F.when(F.col("base_dir") == "", F.col("path")).otherwise(F.expr("substring(path, length(base_dir) + 2)"))
    whole = F.when(F.col("is_directory"), F.concat(inside, F.lit("/"))).otherwise(inside)
    hit = joined.withColumn("__whole", whole).where(F.expr("__whole rlike regex"))
    place = F.struct(F.length("base_dir").alias("depth"), F.col("rule_ord"))
    return hit.groupBy("path", "is_directory").agg(F.max_by(~F.col("negated"), place).alias("ignored"))


def keep_reached(entries: DataFrame, excluded_directories: DataFrame) -> DataFrame:
    """Entries without an excluded directory among their ancestors (or themselves).

    A rule set inside a pruned directory speaks only of what is pruned with it,
    so no level-by-level walk is needed.
    """
    keyed = entries.select("*", F.explode(F.array_append(F.filter(ancestors(F.col("path")), lambda p: p != ""), F.when(F.col("is_directory"), F.col("path")))).alias("__above"))
    gone = keyed.join(excluded_directories.select(F.col("path").alias("__above")).distinct(), "__above", "left_semi").select("path", "is_directory").distinct()
    return entries.join(gone, ["path", "is_directory"], "left_anti")


def prune(entries: DataFrame, folders: IgnoreRules, files: IgnoreRules, gitignore: DataFrame | None = None, policy: Column | None = None, output_directories: tuple[str, ...] = ()) -> DataFrame:
    """What a scan that skips ignored directories reaches: (path, name, is_directory) entries.

    Configured folder rules come first, then output directories, then gitignore.
    ``policy`` is the path that configured rules see, if it differs.
    """
    seen = policy if policy is not None else F.col("path")
    configured = F.when(F.col("is_directory"), folders.matches(F.col("name"), seen, True)).otherwise(files.matches(F.col("name"), seen, False))
    own = reduce(lambda a, b: a | b, [F.col("path") == d for d in output_directories], F.lit(False)) & F.col("is_directory")
    marked = entries.withColumn("__out", configured | own)
    if gitignore is not None:
        said = gitignore_verdicts(entries.select("path", "is_directory"), gitignore)
        marked = marked.join(said, ["path", "is_directory"], "left").withColumn("__out", F.col("__out") | F.coalesce("ignored", F.lit(False))).drop("ignored")
    gone = marked.where("__out AND is_directory").select("path")
    return keep_reached(marked.where("NOT __out").drop("__out"), gone)


def scope_match(scope: str, folders: IgnoreRules) -> str | None:
    """The first ancestor of a scope path that the folder rules name."""
    parts = scope.split("/")
    for k in range(1, len(parts) + 1):
        path = "/".join(parts[:k])
        if any(patterns.python_regex(e).search(parts[k - 1]) for e in folders.names) or any(patterns.python_regex(e).search(path + "/") for e in folders.paths):
            return path
    return None
