"""What a run does: scan, read, classify, parse, resolve, render."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions.language import language_of
from codequarry.functions.paths import policy_path
from codequarry.operators import calls as call_rules
from codequarry.operators import config, ignore, imports, reading
from codequarry.operators.shared import apart, materialise
from codequarry.plans import reports
from codequarry.sources import facts, tree


class OutputError(Exception):
    pass


class DocumentationError(Exception):
    pass


def scan(spark: SparkSession, root: Path, rules: dict[str, list[str]], outputs: tuple[Path, ...] = (), gitignore: bool = True, prefix: str | None = None) -> DataFrame:
    """Entries (path, name, is_directory, is_symlink, ord_key) that the rules leave."""
    folders, files = ignore.IgnoreRules.of(rules[config.FOLDERS]), ignore.IgnoreRules.of(rules[config.FILES])
    found = materialise(tree.entries(spark, str(root), folders.names, folders.paths, prefix))
    inside = tuple(o.resolve().relative_to(root).as_posix() for o in outputs if o.resolve().is_relative_to(root) and o.resolve() != root)
    policy = policy_path(F.col("path"), prefix)
    first = ignore.prune(found, folders, files, None, policy, inside)
    if gitignore:
        # configured exclusion first: a gitignore file in an excluded directory is never read
        lines = materialise(tree.gitignore_lines(first, str(root)))
        rules_of = ignore.gitignore_rules(lines.where("error IS NULL"))
        first = materialise(ignore.prune(first, folders, files, rules_of, policy, inside))
        # nor does it matter if one in a directory that gitignore rules exclude cannot be read
        reached = first.where("is_directory").select(F.col("path").alias("base_dir")).unionByName(spark.range(1).select(F.lit("").alias("base_dir")))
        _refuse(lines.where("error IS NOT NULL").join(reached, "base_dir", "left_semi").select("base_dir", "error"))
    _refuse(first.where("error IS NOT NULL").select(F.col("path").alias("base_dir"), "error"))
    return materialise(tree.ordered(first.drop("error")))


def _refuse(errors: DataFrame) -> None:
    first = errors.orderBy("base_dir").first()
    if first:
        raise tree.ScanError(first["error"])


def evidence(entries: DataFrame, root: Path, limit: int = reading.MOST_BYTES) -> DataFrame:
    """Files with what reading them gave and their language."""
    files = entries.where("NOT is_directory")
    read = reading.read_files(files.repartition(max(1, files.sparkSession.sparkContext.defaultParallelism)), str(root), limit)
    return materialise(files.select("path", "ord_key").join(read, "path").withColumn("language", language_of(F.col("path"))))


@dataclass(frozen=True)
class Trace:
    files: DataFrame
    facts: DataFrame
    imports: DataFrame
    calls: DataFrame


def trace(files: DataFrame) -> Trace:
    """Facts, resolved imports and resolved calls of (path, language, status, content)."""
    found = materialise(facts.facts(files))
    resolved = materialise(imports.resolve_imports(facts.relation(found, "imports"), apart(files.select("path", "language"))))
    decided = call_rules.resolve_calls(found, resolved)
    of_calls = facts.relation(found, "calls").drop("dynamic_kind").join(apart(decided), ["path", "ord"])
    return Trace(files, found, resolved, materialise(of_calls))


def trace_text(made: Trace) -> Iterator[str]:
    yield from reports.pieces(reports.trace_lines(made.files, made.imports, made.calls), ["section", "key"], "line", "\n")
    yield "\n"


def architecture_text(entries: DataFrame, name: str) -> Iterator[str]:
    yield "# Project Architecture\n\n"
    yield from reports.pieces(reports.architecture_lines(entries, name), ["ord_key"], "line", "\n")


def report_text(found: DataFrame, name: str, title: str = "Project Report", source_root: str | None = None) -> Iterator[str]:
    yield reports.report_head(title, name, source_root)
    yield from reports.pieces(reports.source_sections(found), ["ord_key"], "section", "")


def report_log(found: DataFrame) -> Iterator[str]:
    """What a report says of every file, in order."""
    line = reading.log_line(F.col("path"), F.col("status"), F.col("size_bytes"), F.col("error_type"), F.col("error_message"))
    return (row[0] for row in found.select("ord_key", line.alias("line")).orderBy("ord_key").select("line").toLocalIterator())


SUMMARY = {
    "Added text files": "added_files", "Skipped ignored files": "skipped_ignored_files", "Skipped binary files": "skipped_binary_files", "Skipped oversized files": "skipped_oversized_files",
    "Skipped unreadable files": "skipped_unreadable_files", "Skipped symlink files": "skipped_symlink_files", "Skipped unsafe-path files": "skipped_unsafe_path_files",
    "Skipped markdown-error files": "skipped_markdown_error_files",
}


def summary_lines(found: DataFrame, target: Path) -> list[str]:
    """The eight counters of a source report, and where it is."""
    counts = reading.summary(found).first()
    return ["", "Report summary:", *(f"  {label}: {counts[key]}" for label, key in SUMMARY.items()), f"  Report saved to: {target}"]


@dataclass(frozen=True)
class Scope:
    name: str
    exists: bool
    ignored: bool = False
    overridden: bool = False
    report: Path | None = None
    counts: dict | None = None


def documentation(spark: SparkSession, root: Path, output: Path, rules: dict[str, list[str]], consent: Callable[[], bool] | None = None) -> list[Scope]:
    """One report for docs/public and docs/private each; an excluded private scope needs consent."""
    folders, made = ignore.IgnoreRules.of(rules[config.FOLDERS]), []
    for scope in ("public", "private"):
        label, where = f"docs/{scope}", root / "docs" / scope
        for part in (root / "docs", where):
            if part.is_symlink():
                raise DocumentationError(f"a documentation path is a symbolic link: {part}")
        if not where.exists():
            made.append(Scope(scope, False))
            continue
        if not where.is_dir():
            raise DocumentationError(f"a documentation path is no directory: {where}")
        target = output / f"{root.name or 'root'}-{scope}-docs-report.md"
        matched = ignore.scope_match(label, folders)
        private = scope == "private" and matched == label
        agreed = private and consent is not None and consent()
        if target.is_symlink() or target.exists() and not target.is_file():
            raise DocumentationError(f"the report cannot be written there: {target}")
        if private and not agreed:
            target.unlink(missing_ok=True)
            made.append(Scope(scope, True, True))
            continue
        found = evidence(scan(spark, where, rules, (output,), gitignore=False, prefix=label), where)
        found = found.where("false") if matched is not None and not agreed else found
        reports.write(target, report_text(found, root.name or "root", f"{scope.title()} Documentation Report", f"{label}/"))
        made.append(Scope(scope, True, matched is not None, agreed, target, reading.summary(found).first().asDict()))
    return made


def documentation_lines(scopes: list[Scope]) -> list[str]:
    """What a documentation run says at its end."""
    out = ["Documentation report summary:"]
    counted = {label: key for label, key in SUMMARY.items() if key != "skipped_ignored_files"}
    for scope in scopes:
        out.append(f"  docs/{scope.name}/: {'found' if scope.exists else 'not found'}")
        if scope.ignored:
            out.append("    Ignore policy: " + ("private-scope exclusion overridden for this run" if scope.overridden else "entire scope excluded"))
        if scope.report is None:
            out.append("    Report: not generated")
        else:
            out += [f"    {label}: {scope.counts[key]}" for label, key in counted.items()] + [f"    Report: {scope.report}"]
    return [*out, f"  Documentation reports generated: {sum(s.report is not None for s in scopes)}"]
