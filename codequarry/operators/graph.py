"""The dependency graph: nodes, confirmed edges, call indexes and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EDGE_ORDER = "struct(source_path, coalesce(scope, '') AS scope, line, target_path, coalesce(target_symbol, '') AS target_symbol)"


def nodes(files: DataFrame) -> DataFrame:
    return files.select("path").distinct()


def edges(imports: DataFrame, calls: DataFrame) -> DataFrame:
    """kind_rank, path, ord, source_path, target_path, kind, line, scope, target_symbol.

    ``imports``: resolved imports; ``calls``: call facts with their resolutions.
    """
    of_imports = imports.where("status = 'resolved_internal' AND target_path IS NOT NULL").selectExpr(
        "0 AS kind_rank", "ord", "path AS source_path", "target_path", "'import' AS kind", "line", "scope", "cast(NULL AS string) AS target_symbol"
    )
    of_calls = calls.where("status = 'resolved_internal' AND resolved_target IS NOT NULL").selectExpr(
        "1 AS kind_rank", "ord", "path AS source_path", "resolved_target.source_path AS target_path", "'call' AS kind", "line", "scope", "resolved_target.qualified_name AS target_symbol"
    )
    return of_imports.unionByName(of_calls)


def _edges(found: DataFrame, path: str, symbol: str) -> DataFrame:
    rows = found.where("kind = 'call' AND target_symbol IS NOT NULL")
    return rows.select(F.col(path).alias("path"), F.col(symbol).alias("symbol"), F.expr(EDGE_ORDER).alias("e")).select("path", "symbol", "e.*")


def outbound_edges(found: DataFrame) -> DataFrame:
    """(path, symbol, source_path, scope, line, target_path, target_symbol): confirmed calls, each by its caller."""
    return _edges(found, "source_path", "scope")


def inbound_edges(found: DataFrame) -> DataFrame:
    """The same by what is called."""
    return _edges(found, "target_path", "target_symbol")


def _index(edges: DataFrame) -> DataFrame:
    return edges.groupBy("path", "symbol").agg(F.array_sort(F.collect_list(F.struct("source_path", "scope", "line", "target_path", "target_symbol"))).alias("edges"))


def outbound(found: DataFrame) -> DataFrame:
    """(path, symbol, edges): confirmed calls by caller; a module's own calls have a null symbol.

    An endpoint's edges are one row here; ``outbound_edges`` has them as rows.
    """
    return _index(outbound_edges(found))


def inbound(found: DataFrame) -> DataFrame:
    """(path, symbol, edges): confirmed calls by callee."""
    return _index(inbound_edges(found))


def counters(files: DataFrame, imports: DataFrame, calls: DataFrame, found: DataFrame) -> DataFrame:
    """(place, label, value): the sixteen figures of a trace."""
    by_import = imports.agg(
        F.count(F.lit(1)).alias("imports"), *[F.count_if(F.col("status") == s).alias(f"i_{s}") for s in ("resolved_internal", "unresolved", "ambiguous", "invalid_relative_import")]
    )
    kinds = ("resolved_internal", "potential_internal", "unresolved", "ambiguous", "dynamic", "shadowed")
    by_call = calls.agg(F.count(F.lit(1)).alias("calls"), *[F.count_if(F.col("status") == s).alias(f"c_{s}") for s in kinds])
    confirmed = found.where("kind = 'call' AND target_symbol IS NOT NULL")
    other = [
        nodes(files).agg(F.count(F.lit(1)).alias("nodes")), found.agg(F.count(F.lit(1)).alias("edges")),
        confirmed.select("source_path", "scope").distinct().agg(F.count(F.lit(1)).alias("callers")), confirmed.select("target_path", "target_symbol").distinct().agg(F.count(F.lit(1)).alias("callees")),
    ]
    labels = {
        "nodes": "Source nodes", "imports": "Import resolutions", "calls": "Call resolutions", "edges": "Confirmed internal edges", "i_resolved_internal": "Resolved internal imports",
        "c_resolved_internal": "Resolved internal calls", "callers": "Confirmed caller endpoints", "callees": "Confirmed callee endpoints", "i_unresolved": "Unresolved imports", "i_ambiguous": "Ambiguous imports",
        "i_invalid_relative_import": "Invalid relative imports", "c_potential_internal": "Potential internal calls", "c_unresolved": "Unresolved calls", "c_ambiguous": "Ambiguous calls", "c_dynamic": "Dynamic calls", "c_shadowed": "Shadowed calls",
    }
    places = {name: k for k, name in enumerate(labels)}
    out = None
    for one in (by_import, by_call, *other):
        cells = F.explode(F.array(*[F.struct(F.lit(places[c]).alias("place"), F.lit(labels[c]).alias("label"), F.col(c).cast("long").alias("value")) for c in one.columns]))
        rows = one.select(cells.alias("x")).select("x.*")
        out = rows if out is None else out.unionByName(rows)
    return out
