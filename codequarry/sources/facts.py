"""Facts of Python sources: one parse and one walk per file, all relations at once.

``facts`` turns (path, language, status, content) into one row per file with the
parse outcome and arrays of structs; ``relation`` unnests one of them.  Nothing
is executed: the text goes to ``ast`` and ``symtable`` only.
"""

from __future__ import annotations

import ast
import functools
import symtable
import warnings
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARSER_ID = "python.ast"
IMPLICIT = (ast.Lambda, ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)

#: name, columns; every relation also has ``path``
RELATIONS = {
    "imports": "ord int, module string, imported_name string, alias string, level int, scope string, line int",
    "symbols": "ord int, name string, qualified_name string, kind string, line int, end_line int, in_body boolean, decorated boolean",
    "calls": "ord int, target_kind string, target_parts array<string>, scope string, line int, dynamic_kind string, at_init boolean, implicit boolean, implicit_shadow boolean, ctor_name string, ctor_line int",
    "flags": "scope string, name string, is_parameter boolean, is_nonlocal boolean, is_free boolean, is_assigned boolean, is_imported boolean, is_local boolean, is_global boolean",
    "module_bindings": "name string, kind string, line int",
    "classes": "name string, line int, bases array<string>, n_bases int, has_keywords boolean",
    "class_bindings": "class_name string, class_line int, name string, kind string, line int",
    "class_members": "class_name string, class_line int, name string, kind string, line int, decorated boolean",
    "mutations": "receiver string, member string",
}
OUTCOME = "path string, status string, parser_id string, error_type string, error_message string, error_line int"
SCHEMA = OUTCOME + "".join(f", {name} array<struct<{', '.join(c.replace(' ', ':', 1) for c in columns.split(', '))}>>" for name, columns in RELATIONS.items())
_ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
ARROW_SCHEMA = pa.schema(
    [(f.split(" ")[0], _ARROW[f.split(" ")[1]]) for f in OUTCOME.split(", ")]
    + [(name, pa.list_(pa.struct([(c.split(" ")[0], _ARROW[c.split(" ")[1]]) for c in columns.split(", ")]))) for name, columns in RELATIONS.items()]
)


def dotted(node: ast.expr) -> tuple[str, ...] | None:
    """The parts of a plain name or attribute chain."""
    if isinstance(node, ast.Name):
        return (node.id,)
    if isinstance(node, ast.Attribute):
        left = dotted(node.value)
        return left and (*left, node.attr)
    return None


def dynamic_kind(callee: ast.expr) -> str:
    if isinstance(callee, ast.Subscript):
        return "subscript_selected"
    if isinstance(callee, ast.Call):
        return "getattr_result" if isinstance(callee.func, ast.Name) and callee.func.id == "getattr" else "returned_callable"
    return "other"


def bound_names(node: ast.AST) -> list[tuple[str, str]]:
    """(name, kind) of what a single node binds in the scope it runs in; ``*`` stands for every name."""
    if isinstance(node, (*FUNCTIONS, ast.ClassDef)):
        return [(node.name, "definition")]
    if isinstance(node, ast.Import):
        return [(a.asname or a.name.partition(".")[0], "import") for a in node.names]
    if isinstance(node, ast.ImportFrom):
        return [("*", "star_import") if a.name == "*" else (a.asname or a.name, "import") for a in node.names]
    if isinstance(node, ast.Name) and not isinstance(node.ctx, ast.Load):
        return [(node.id, "name_binding")]
    if isinstance(node, ast.ExceptHandler) and node.name:
        return [(node.name, "exception_binding")]
    if isinstance(node, (ast.MatchAs, ast.MatchStar)) and node.name:
        return [(node.name, "match_binding")]
    if isinstance(node, ast.MatchMapping) and node.rest:
        return [(node.rest, "match_binding")]
    return []


def _implicit_names(node: ast.AST) -> set[str]:
    """Names that a lambda or a comprehension binds for what is inside."""
    if isinstance(node, ast.Lambda):
        a = node.args
        return {x.arg for x in (*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg)))}
    return {n.id for g in node.generators for n in ast.walk(g.target) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)}


class Walk:
    """All facts of one module, gathered with an explicit stack so that depth is no limit."""

    def __init__(self, tree: ast.Module) -> None:
        self.rows: dict[str, list[dict]] = {name: [] for name in RELATIONS}
        self.tree, self.parent = tree, {}
        self.call_nodes: list[tuple[ast.Call, tuple[str, ...] | None, str | None]] = []
        body = set(map(id, tree.body))
        # (node, scope parts, class in whose scope it runs or None, runs in module scope)
        stack: list[tuple[ast.AST, tuple[str, ...], ast.ClassDef | None, bool]] = [(n, (), None, True) for n in reversed(tree.body)]
        for n in tree.body:
            self.parent[n] = tree
        while stack:
            node, scope, owner, module = stack.pop()
            self.visit(node, scope, owner, module, id(node) in body)
            inner = scope
            if isinstance(node, (*FUNCTIONS, ast.ClassDef)):
                inner, module = (*scope, node.name), False
                owner = node if isinstance(node, ast.ClassDef) and id(node) in body else None
            elif isinstance(node, ast.Lambda):
                module, owner = False, None
            children = list(ast.iter_child_nodes(node))
            for child in children:
                self.parent[child] = node
            stack.extend((c, inner, owner, module) for c in reversed(children))
        self.finish_calls()

    def add(self, relation: str, **row) -> None:
        self.rows[relation].append(row)

    def visit(self, node: ast.AST, scope: tuple[str, ...], owner: ast.ClassDef | None, module: bool, in_body: bool) -> None:
        where = ".".join(scope) or None
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            plain = isinstance(node, ast.Import)
            for a in node.names:
                self.add(
                    "imports", ord=len(self.rows["imports"]), module=a.name if plain else node.module, imported_name=None if plain else a.name,
                    alias=a.asname, level=0 if plain else node.level, scope=where, line=node.lineno,
                )
        elif isinstance(node, (*FUNCTIONS, ast.ClassDef)):
            kind = "class" if isinstance(node, ast.ClassDef) else "async_function" if isinstance(node, ast.AsyncFunctionDef) else "function"
            self.add(
                "symbols", ord=len(self.rows["symbols"]), name=node.name, qualified_name=".".join((*scope, node.name)), kind=kind,
                line=node.lineno, end_line=node.end_lineno, in_body=in_body, decorated=bool(node.decorator_list),
            )
            if kind == "class" and in_body:
                bases = [b.id if isinstance(b, ast.Name) else None for b in node.bases]
                self.add("classes", name=node.name, line=node.lineno, bases=bases, n_bases=len(bases), has_keywords=bool(node.keywords))
                for member in node.body:
                    if isinstance(member, FUNCTIONS):
                        named = "async_function" if isinstance(member, ast.AsyncFunctionDef) else "function"
                        self.add("class_members", class_name=node.name, class_line=node.lineno, name=member.name, kind=named, line=member.lineno, decorated=bool(member.decorator_list))
        elif isinstance(node, ast.Call):
            self.call_nodes.append((node, dotted(node.func), where))
            args = node.args
            if isinstance(node.func, ast.Name) and node.func.id in ("setattr", "delattr") and len(args) > 1 and isinstance(args[0], ast.Name) and isinstance(args[1], ast.Constant) and isinstance(args[1].value, str):
                self.add("mutations", receiver=args[0].id, member=args[1].value)
        elif isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name) and not isinstance(node.ctx, ast.Load):
            self.add("mutations", receiver=node.value.id, member=node.attr)
        if isinstance(node, ast.NamedExpr):
            self.add("module_bindings", name=node.target.id, kind="named_expression", line=node.lineno)
        for name, kind in bound_names(node):
            if module:
                self.add("module_bindings", name=name, kind=kind, line=getattr(node, "lineno", 0))
            if owner is not None:
                self.add("class_bindings", class_name=owner.name, class_line=owner.lineno, name=name, kind=kind, line=getattr(node, "lineno", 0))

    def above(self, node: ast.AST) -> Iterator[tuple[ast.AST, ast.AST]]:
        child = node
        while (up := self.parent.get(child)) is not None:
            yield child, up
            child = up

    def finish_calls(self) -> None:
        # calls of one target on one line share what their positions say
        at_init: dict[tuple, bool] = defaultdict(bool)
        implicit: dict[tuple, bool] = defaultdict(bool)
        shadow: dict[tuple, bool] = defaultdict(bool)
        count: dict[tuple, int] = defaultdict(int)
        for node, parts, _ in self.call_nodes:
            if not parts:
                continue
            key, deferred = (node.lineno, parts), False
            count[key] += 1
            for child, up in self.above(node):
                deferred |= isinstance(up, FUNCTIONS) and any(child is s for s in up.body) or isinstance(up, ast.Lambda) and child is up.body
                if isinstance(up, IMPLICIT):
                    implicit[key] = True
                    shadow[key] |= parts[0] in _implicit_names(up)
            at_init[key] |= not deferred
        for k, (node, parts, where) in enumerate(self.call_nodes):
            key = (node.lineno, parts)
            kind = "dynamic" if not parts else "name" if len(parts) == 1 else "attribute"
            made = self.constructor(node, parts, where) if kind == "attribute" and len(parts) == 2 and where and count[key] == 1 else None
            self.add(
                "calls", ord=k, target_kind=kind, target_parts=list(parts or ()), scope=where, line=node.lineno, dynamic_kind=None if parts else dynamic_kind(node.func),
                at_init=at_init[key] if parts else False, implicit=implicit[key] if parts else False, implicit_shadow=shadow[key] if parts else False,
                ctor_name=made and made[0], ctor_line=made and made[1],
            )

    def constructor(self, node: ast.Call, parts: tuple[str, ...], where: str) -> tuple[str, int] | None:
        """(class name, line) of ``x = C()`` before ``x.m()`` with only passive statements between."""
        steps = where.split(".")
        container = self.tree.body
        if len(steps) == 2:
            owners = [n for n in container if isinstance(n, ast.ClassDef) and n.name == steps[0]]
            if len(owners) != 1:
                return None
            container = owners[0].body
        elif len(steps) != 1:
            return None
        functions = [n for n in container if isinstance(n, FUNCTIONS) and n.name == steps[-1]]
        statement = self.parent.get(node)
        whole = isinstance(statement, (ast.Expr, ast.Return, ast.Assign, ast.AnnAssign)) and statement.value is node
        if len(functions) != 1 or not whole:
            return None
        body = functions[0].body
        at = next((k for k, s in enumerate(body) if s is statement), 0)
        for before in reversed(body[:at]):
            if isinstance(before, ast.Assign) and len(before.targets) == 1 and isinstance(before.targets[0], ast.Name) and before.targets[0].id == parts[0]:
                value = before.value
                if isinstance(value, ast.Call) and isinstance(value.func, ast.Name) and not value.args and not value.keywords and before.lineno < node.lineno:
                    return value.func.id, value.lineno
                return None
            if not passive(before, parts[0]):
                return None
        return None


def passive(statement: ast.stmt, receiver: str) -> bool:
    """Nothing in the statement can change or pass on what the receiver is."""

    def still(value: ast.expr) -> bool:
        if isinstance(value, (ast.Tuple, ast.List)):
            return all(map(still, value.elts))
        return isinstance(value, ast.Constant) or isinstance(value, ast.Name) and isinstance(value.ctx, ast.Load) and value.id != receiver

    if isinstance(statement, ast.Expr):
        return isinstance(statement.value, ast.Constant)
    if isinstance(statement, ast.Assign):
        return all(isinstance(t, ast.Name) and t.id != receiver for t in statement.targets) and still(statement.value)
    return isinstance(statement, ast.Pass)


def symbol_flags(content: str, wanted: set[tuple[str | None, str]]) -> list[dict]:
    """What the compiler's symbol tables say of (scope, name); no row where a scope is not one table."""
    try:
        root = symtable.symtable(content, "<source>", "exec")
    except (SyntaxError, ValueError, RecursionError):
        return []
    tables: dict[str | None, symtable.SymbolTable | None] = {None: root}

    def table(scope: str | None) -> symtable.SymbolTable | None:
        if scope not in tables:
            above, _, name = scope.rpartition(".")
            outer = table(above or None)
            try:
                tables[scope] = outer.lookup(name).get_namespace() if outer is not None else None
            except (KeyError, ValueError):
                tables[scope] = None
        return tables[scope]

    out = []
    for scope, name in sorted(wanted, key=lambda w: (w[0] or "", w[1])):
        inside = table(scope)
        try:
            symbol = inside.lookup(name) if inside is not None else None
        except KeyError:
            symbol = None
        if symbol is not None:
            tests = ("parameter", "nonlocal", "free", "assigned", "imported", "local", "global")
            out.append({"scope": scope, "name": name} | {f"is_{t}": bool(getattr(symbol, f"is_{t}")()) for t in tests})
    return out


def file_facts(path: str, language: str | None, status: str | None, content: str | None) -> dict:
    row: dict = {"path": path, "status": None, "parser_id": None, "error_type": None, "error_message": None, "error_line": None}
    row |= {name: [] for name in RELATIONS}
    if status != "text":
        return row | {"status": "non_text_source"}
    if content is None:
        return row | {"status": "invalid_text_evidence", "error_type": "InvalidTextEvidence", "error_message": "a text result has no content"}
    parser = PARSERS.get(language or "")
    if parser is None:
        return row | {"status": "unsupported_language"}
    row["parser_id"] = parser.identifier
    try:
        found = parser.parse(path, content)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as error:
        return row | {"status": "syntax_error", "error_type": "SyntaxError", "error_message": getattr(error, "msg", None) or str(error), "error_line": getattr(error, "lineno", None)}
    return row | {"status": "parsed"} | found


#: Texts of at most so many characters are kept, with what was found in them, while they are among the latest so many.
SMALL, RECENT = 1_000, 512


def parse_python(path: str, content: str) -> dict[str, list[dict]]:
    """Facts of a text, which do not depend on its path; trees hold many copies of small files, and those are walked once."""
    return _parsed_small(content) if len(content) <= SMALL else _parsed(content)


def _parsed(content: str) -> dict[str, list[dict]]:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        walk = Walk(ast.parse(content, type_comments=True))
        wanted: set[tuple[str | None, str]] = {(c["scope"], c["target_parts"][0]) for c in walk.rows["calls"] if c["scope"] and c["target_parts"]}
        for i in walk.rows["imports"]:
            wanted.add((i["scope"], i["alias"] or i["imported_name"] or i["module"]))
        walk.rows["flags"] = symbol_flags(content, wanted)
    return walk.rows


_parsed_small = functools.lru_cache(RECENT)(_parsed)


@dataclass(frozen=True)
class Parser:
    """How sources of a language become the rows of ``RELATIONS``; a syntax error is raised as one."""

    identifier: str
    parse: Callable[[str, str], dict[str, list[dict]]]


#: Parsers by language: another language is one more entry.
PARSERS: dict[str, Parser] = {"python": Parser(PARSER_ID, parse_python)}


#: A task parses at most so many files where cores have enough to do, and never fewer than the second figure.
MOST_FILES, LEAST_FILES = 20_000, 500


def parts(files: int, cores: int) -> int:
    """Tasks that parse so many files: all cores work, and a task stays bounded however many files there are."""
    return max(1, min(-(-files // LEAST_FILES), max(4 * cores, -(-files // MOST_FILES))))


def facts(files: DataFrame) -> DataFrame:
    """One row of facts per file of (path, language, status, content).

    Files are dealt anew by path: a small table of many sources is one split of
    one Parquet file, and as such would be parsed by a single task.  ``files``
    should be materialised, since it is counted first.
    """

    parsers = dict(PARSERS)  # as registered on the driver

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from codequarry.sources import facts as here

        here.PARSERS.update(parsers)
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                rows = [file_facts(*values) for values in zip(*(c.to_pylist() for c in batch.slice(low, 64).columns), strict=True)]
                yield pa.RecordBatch.from_pylist(rows, schema=ARROW_SCHEMA)

    dealt = files.select("path", "language", "status", "content").repartition(parts(files.count(), files.sparkSession.sparkContext.defaultParallelism), "path")
    return dealt.mapInArrow(run, SCHEMA)


def relation(found: DataFrame, name: str) -> DataFrame:
    """One of ``RELATIONS`` as rows keyed by ``path``."""
    return found.select("path", F.inline(name))


def outcomes(found: DataFrame) -> DataFrame:
    return found.select("path", "status", "parser_id", "error_type", "error_message", "error_line")
