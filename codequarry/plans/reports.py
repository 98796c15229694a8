"""Reports as ordered lines.

Every report is a DataFrame with its order in columns; ``pieces`` hands it to a
single file, when one is asked for, partition by partition.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.functions.language import fence_label
from codequarry.functions.text import section
from codequarry.operators import graph
from codequarry.operators.shared import materialise

INDENT = "│   "
MODULE = "<module>"


def architecture_lines(entries: DataFrame, root_name: str) -> DataFrame:
    """(ord_key, line) of a tree: the root, then each directory's files before its directories.

    ``entries``: path, name, is_directory, ord_key.
    """
    depth = F.size(F.split("path", "/"))
    below = entries.select("ord_key", F.concat(F.repeat(F.lit(INDENT), depth), F.col("name"), F.when(F.col("is_directory"), "/").otherwise("")).alias("line"))
    root = entries.sparkSession.range(1).select(F.array().cast("array<string>").alias("ord_key"), F.lit(f"{root_name}/").alias("line"))
    return root.unionByName(below)


def source_sections(evidence: DataFrame) -> DataFrame:
    """(ord_key, section) of the text files of (ord_key, path, status, content, language)."""
    made = section(F.col("path"), F.col("content"), fence_label(F.col("language")))
    return evidence.where("status = 'text'").select("ord_key", made.alias("section"))


def report_head(title: str, project: str, source_root: str | None = None) -> str:
    parts = [f"# {title}", f"**Project:** `{project}`", *([f"**Documentation root:** `{source_root}`"] if source_root else []), "---"]
    return "".join(f"{p}\n\n" for p in parts)


def _code(*parts: Column | str) -> Column:
    return F.concat(F.lit("`"), *[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit("`"))


def _says(*parts: Column | str) -> Column:
    return F.concat(F.lit("- "), *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _list(items: Column) -> Column:
    return F.when(F.size(items) > 0, F.array_join(items, ", ")).otherwise("<none>")


def trace_lines(files: DataFrame, imports: DataFrame, calls: DataFrame) -> DataFrame:
    """(section, key, line) of the dependency trace; sort by section, then key.

    ``calls``: call facts joined with their resolutions; ``key`` is an array of
    strings that sorts like the evidence (numbers padded).
    """
    found = graph.edges(imports, calls)
    spark = files.sparkSession
    pad = lambda c: F.lpad(F.col(c).cast("string"), 10, "0")
    evidence = F.concat(files_key("path"), F.array(pad("ord")))
    at = F.concat(_code(F.col("path")), F.lit(":"), F.col("line").cast("string"), F.lit(" "))
    scope = F.coalesce("scope", F.lit(MODULE))
    in_scope = F.concat(F.lit("(scope "), _code(scope), F.lit(")"))
    line_no = F.concat(F.lit("(line "), F.col("line").cast("string"))
    target = _code(F.col("target_path"), "::", F.coalesce("target_symbol", F.lit("<unknown>")))
    called = _code(F.when(F.size("target_parts") > 0, F.array_join("target_parts", ".")).otherwise("<dynamic>"))
    options = _code(_list(F.transform("candidate_targets", lambda t: F.concat(t["source_path"], F.lit("::"), t["qualified_name"]))))
    asked, paths = _code(_list(F.col("requested_modules"))), _code(_list(F.col("candidate_paths")))

    edge = F.when(F.col("kind") == "call", _says("[CALL] ", _code(F.col("source_path"), "::", scope), " → ", target, " ", line_no, ")")).otherwise(
        _says("[IMPORT] ", _code(F.col("source_path")), " → ", _code(F.col("target_path")), " ", line_no, ", scope ", _code(scope), ")")
    )
    edge_key = F.concat(F.array(F.col("kind_rank").cast("string")), files_key("source_path"), F.array(pad("ord")))
    numbers = graph.counters(files, imports, calls, found).select(pad("place").alias("p"), _says(F.col("label"), ": ", F.col("value").cast("string")).alias("line"))
    parts: list[tuple[str, DataFrame]] = [
        ("Summary", numbers.select(F.array("p").alias("key"), "line")),
        ("Confirmed internal dependencies", found.select(edge_key.alias("key"), edge.alias("line"))),
        ("Confirmed calls by caller", _indexed(graph.outbound_edges(found), F.concat(F.lit("  - CALLS "), _code(F.col("target_path"), "::", F.col("target_symbol")), F.lit(" "), line_no, F.lit(")")))),
        (
            "Confirmed calls by callee",
            _indexed(graph.inbound_edges(found), F.concat(F.lit("  - CALLED BY "), _code(F.col("source_path"), "::", F.when(F.col("scope") == "", MODULE).otherwise(F.col("scope"))), F.lit(" "), line_no, F.lit(")"))),
        ),
        ("Unresolved imports", _where(imports, "unresolved", evidence, _says(at, "requested ", asked))),
        ("Ambiguous imports", _where(imports, "ambiguous", evidence, _says(at, "requested ", asked, "; candidates: ", paths))),
        ("Invalid relative imports", _where(imports, "invalid_relative_import", evidence, F.rtrim(_says(at)))),
        ("Potential internal calls (not confirmed edges)", _where(calls, "potential_internal", evidence, _says(at, called, " → candidate ", options, " ", in_scope))),
        ("Shadowed call candidates", _where(calls, "shadowed", evidence, _says(at, called, " shadowed by ", _code(F.coalesce("shadowed_by", F.lit("unknown"))), " ", in_scope))),
        ("Unresolved calls", _where(calls, "unresolved", evidence, _says(at, called, " ", in_scope))),
        ("Ambiguous call candidates", _where(calls, "ambiguous", evidence, _says(at, called, "; candidates: ", options))),
        ("Dynamic calls", _where(calls, "dynamic", evidence, _says(at, "kind ", _code(F.coalesce("dynamic_kind", F.lit("unknown"))), " ", in_scope))),
    ]
    heads = [(k, line) for k, (title, _) in enumerate(parts) for line in ([["# Dependency Trace", ""], [""]][min(k, 1)] + [f"## {title}", ""])]
    rows = ", ".join(f"({k}, {n}, '{line}')" for n, (k, line) in enumerate(heads))
    fixed = spark.sql(f"SELECT section, array('', lpad(cast(n AS string), 10, '0')) AS key, line FROM VALUES {rows} AS t(section, n, line)")
    bodies = [body.select(F.lit(k).alias("section"), F.concat(F.array(F.lit("1")), F.col("key")).alias("key"), "line") for k, (_, body) in enumerate(parts)]
    # written once: which sections are empty is read off the lines, not off what they were made of
    lines = materialise(functools.reduce(DataFrame.unionByName, bodies))
    sections = spark.sql("SELECT section FROM VALUES " + ", ".join(f"({k})" for k in range(len(parts))) + " AS t(section)")
    none = sections.join(lines.select("section").distinct(), "section", "left_anti").select("section", F.array(F.lit("1")).alias("key"), F.lit("- None.").alias("line"))
    return fixed.unionByName(lines).unionByName(none)


def files_key(path: str) -> Column:
    from codequarry.functions.paths import order_key

    return order_key(F.col(path))


def _where(rows: DataFrame, status: str, key: Column, line: Column) -> DataFrame:
    return rows.where(F.col("status") == status).select(key.alias("key"), line.alias("line"))


def _indexed(edges: DataFrame, item: Column) -> DataFrame:
    """An endpoint's line and, below it, one line an edge; each is a row of its own, whatever the number of edges."""
    head = _says(_code(F.col("path"), "::", F.coalesce("symbol", F.lit(MODULE))))
    place = F.array("path", F.coalesce("symbol", F.lit("")))
    heads = edges.select("path", "symbol").distinct().select(F.concat(place, F.array(F.lit("0"))).alias("key"), head.alias("line"))
    order = F.array(F.lit("1"), "source_path", "scope", F.lpad(F.col("line").cast("string"), 10, "0"), "target_path", "target_symbol")
    return heads.unionByName(edges.select(F.concat(place, order).alias("key"), item.alias("line")))


def pieces(rows: DataFrame, order: list[str], column: str, separator: str) -> Iterator[str]:
    """A report's parts in order; the driver holds one partition at a time."""
    for number, row in enumerate(rows.orderBy(*order).select(column).toLocalIterator()):
        if number:
            yield separator
        yield row[0]


def write(path: Path, parts: Iterable[str]) -> None:
    """UTF-8 with plain line feeds; the file takes its name when it is whole."""
    path.parent.mkdir(parents=True, exist_ok=True)
    unfinished = path.with_name(f".{path.name}.part")
    try:
        with unfinished.open("w", encoding="utf-8", newline="\n") as file:
            file.writelines(parts)
        unfinished.replace(path)
    finally:
        unfinished.unlink(missing_ok=True)
