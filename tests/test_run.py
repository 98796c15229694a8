"""Whole runs over small trees, and the rules that need files or python objects."""

from __future__ import annotations

import json

import pytest

from pyspark.sql import functions as F

from codequarry import cli
from codequarry.functions import language, patterns
from codequarry.operators import config, ignore, reading
from codequarry.plans import run
from codequarry.sources import facts, tree


@pytest.fixture
def project(tmp_path):
    root = tmp_path / "proj"
    (root / "pkg").mkdir(parents=True)
    (root / "node_modules").mkdir()
    (root / "build").mkdir()
    (root / "docs" / "public").mkdir(parents=True)
    (root / "pkg" / "__init__.py").write_text("")
    (root / "pkg" / "a.py").write_text("from .b import f\n\ndef g():\n    return f()\n")
    (root / "pkg" / "b.py").write_text("def f():\n    return 1\n")
    (root / "pkg" / "bad.py").write_text("def (\n")
    (root / "node_modules" / "x.js").write_text("1")
    (root / "build" / "made.txt").write_text("1")
    (root / "blob.bin").write_bytes(b"\x00\x01")
    (root / "empty.txt").write_text("")
    (root / "ticks.md").write_text("a ```` b")
    (root / "debug.log").write_text("no")
    (root / "keep.log").write_text("yes")
    (root / ".gitignore").write_text("*.log\n!keep.log\nbuild/\n")
    (root / "docs" / "public" / "guide.md").write_text("# Guide")
    (root / "link.txt").symlink_to(root / "ticks.md")
    return root


def test_command_line(spark, project, tmp_path):
    out = tmp_path / "out"
    assert cli.main(["--project", str(project), "--architecture", "--report", "--trace", "--docs", "--output", str(out)], spark, lambda: False) == 0
    made = {p.name: p.read_text() for p in (out / "proj").iterdir()}
    assert set(made) == {"proj-architecture.md", "proj-project-report.md", "proj-trace.md", "proj-public-docs-report.md"}
    tree, report, trace = made["proj-architecture.md"], made["proj-project-report.md"], made["proj-trace.md"]
    assert "pkg/" in tree and "keep.log" in tree and not any(x in tree for x in ("debug.log", "node_modules", "made.txt"))
    assert "# `pkg/a.py`" in report and "`````" in report and "[empty file]" in report and "blob.bin" not in report
    assert "- Resolved internal calls: 1" in trace and "pkg/b.py" in trace
    assert "# Guide" in made["proj-public-docs-report.md"]
    again = tmp_path / "again"
    assert cli.main(["--project", str(project), "--architecture", "--minus-gitignore", "--output", str(again)], spark) == 0
    assert "debug.log" in (again / "proj" / "proj-architecture.md").read_text()


def test_command_line_refuses(spark, project, tmp_path, capsys):
    assert cli.main([], spark) == 0
    assert cli.main(["--project", str(project)], spark) == 1
    assert cli.main(["--project", str(tmp_path / "absent"), "--trace"], spark) == 1
    (tmp_path / "file").write_text("")
    (tmp_path / "taken").mkdir()
    (tmp_path / "taken" / "proj").write_text("")
    assert cli.main(["--project", str(project), "--trace", "--output", str(tmp_path / "taken")], spark) == 4


def test_report_says_what_it_did(spark, project, tmp_path, capsys):
    out = tmp_path / "out"
    assert cli.main([str(project), "--report"], spark) == 1
    assert cli.main(["--project", str(project), "--report", "--output", str(out)], spark) == 0
    said = capsys.readouterr().out.splitlines()
    assert "[ADD] pkg/a.py" in said and "[SKIP binary] blob.bin" in said and "[SKIP symlink] link.txt" in said
    at = said.index("Report summary:")
    texts = [line for line in said if line.startswith("[ADD] ")]
    wanted = {"Added text files": len(texts), "Skipped ignored files": 0, "Skipped binary files": 1, "Skipped oversized files": 0, "Skipped unreadable files": 0, "Skipped symlink files": 1}
    wanted |= {"Skipped unsafe-path files": 0, "Skipped markdown-error files": 0, "Report saved to": out / "proj" / "proj-project-report.md"}
    assert said[at + 1 :] == [f"  {label}: {value}" for label, value in wanted.items()]


def test_oversized_files_are_told(spark, tmp_path, capsys):
    root = tmp_path / "big"
    root.mkdir()
    (root / "a.txt").write_text("x" * (reading.MOST_BYTES + 1))
    (root / "b.txt").write_text("small")
    assert cli.main(["--project", str(root), "--report", "--output", str(tmp_path / "out")], spark) == 0
    said = capsys.readouterr().out
    assert f"[SKIP oversized] a.txt -> {reading.MOST_BYTES + 1} bytes" in said and "  Skipped oversized files: 1" in said
    assert "small" in (tmp_path / "out" / "big" / "big-project-report.md").read_text()


def test_positional_form_writes_tree_and_report(spark, project, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    assert cli.main([str(project)], spark) == 0
    assert {p.name for p in (tmp_path / "reports" / "proj").iterdir()} == {"proj-architecture.md", "proj-project-report.md"}


def test_a_rule_file_that_cannot_be_read_ends_the_scan(spark, project, tmp_path, capsys):
    run_ = lambda: cli.main(["--project", str(project), "--architecture", "--output", str(tmp_path / "out")], spark)
    (project / "build" / ".gitignore").write_bytes(b"\xff\xfe\xff")
    assert run_() == 0  # within what the root's rules exclude
    (project / "pkg" / ".gitignore").write_bytes(b"\xff\xfe\xff")
    assert run_() == 1 and "pkg/.gitignore cannot be read" in capsys.readouterr().err


def test_a_folder_that_cannot_be_listed(spark, project, tmp_path, monkeypatch):
    rows = {"pkg": "pkg cannot be listed: no", "build": "build cannot be listed: no"}
    listed = tree.entries
    spoiled = lambda *a, **k: listed(*a, **k).withColumn("error", F.coalesce("error", *[F.when(F.col("path") == p, m) for p, m in rows.items()]))
    monkeypatch.setattr(run.tree, "entries", spoiled)
    assert cli.main(["--project", str(project), "--architecture", "--output", str(tmp_path / "out")], spark) == 1
    del rows["pkg"]
    assert cli.main(["--project", str(project), "--architecture", "--output", str(tmp_path / "out")], spark) == 0
    reader = tree.TreeReader(str(project / "absent"), {}, "")
    assert reader._entry("x")[0][4] is None and tree.TreeReader(str(project), {"names": ["^pkg$"], "paths": []}, "")._entry("pkg")[1] == []
    with pytest.raises(tree.ScanError):
        tree.entries(spark, str(project / "absent"))


def test_output_within_the_project_is_no_evidence(spark, project):
    for _ in range(2):
        assert cli.main(["--project", str(project), "--architecture", "--output", str(project / "made")], spark) == 0
        assert "proj-architecture" not in (project / "made" / "proj" / "proj-architecture.md").read_text()


def test_default_registry(spark, project, tmp_path, monkeypatch):
    registry = tmp_path / "personal_ignores.json"
    registry.write_text(json.dumps({"schema_version": 1, "projects": {"proj": {"IGNORE_FILES": ["*.md"]}}}))
    monkeypatch.setattr(config, "default_registry", lambda: registry)
    assert "*.md" in config.load(project)[config.FILES]
    assert config.load(project, tmp_path / "absent.json") == config.merged(config.RECOMMENDED)


def test_another_parser(spark, monkeypatch):
    nothing = {name: [] for name in facts.RELATIONS}
    symbol = {"ord": 0, "name": "x", "qualified_name": "x", "kind": "function", "line": 1, "end_line": 1, "in_body": True, "decorated": False}
    monkeypatch.setitem(facts.PARSERS, "text", facts.Parser("words", lambda path, content: nothing | {"symbols": [symbol | {"name": content}]}))
    rows = spark.createDataFrame([("a.txt", "text", "text", "hello"), ("b.c", "c", "text", "x"), ("c.py", "python", "binary", None), ("d.py", "python", "text", None)], "path string, language string, status string, content string")
    found = facts.facts(rows)
    assert {r.path: (r.status, r.parser_id) for r in facts.outcomes(found).collect()} == {
        "a.txt": ("parsed", "words"), "b.c": ("unsupported_language", None), "c.py": ("non_text_source", None), "d.py": ("invalid_text_evidence", None)
    }
    assert [r.name for r in facts.relation(found, "symbols").collect()] == ["hello"]


def test_calls_of_a_tree(spark, project):
    found = run.evidence(run.scan(spark, project, {config.FOLDERS: [], config.FILES: []}), project)
    made = run.trace(found.select("path", "language", "status", "content"))
    (call,) = made.calls.where("path = 'pkg/a.py'").collect()
    assert (call.status, call.proof, call.resolved_target.source_path) == ("resolved_internal", "internal_import_binding", "pkg/b.py")
    outcomes = {r.path: r.status for r in facts.outcomes(made.facts).collect()}
    assert outcomes["pkg/bad.py"] == "syntax_error" and outcomes["pkg/a.py"] == "parsed"


def test_reading_ladder(project, tmp_path):
    outside = tmp_path / "outside.txt"
    outside.write_text("secret")
    (project / "escape.txt").symlink_to(outside)
    status = lambda path, **k: reading.read_one(str(project), path, **k)["status"]
    assert status("ticks.md") == "text" and status("blob.bin") == "binary" and status("empty.txt") == "text"
    assert status("absent.txt") != "text" and status("escape.txt") != "text" and status("../outside.txt") != "text" and status("link.txt") != "text"
    assert status("ticks.md", limit=4) == "oversized"
    for wrong in (0, -1, True, "9"):
        with pytest.raises((ValueError, TypeError)):
            config.validate_limit(wrong)


def test_gitignore_rules():
    cases = [
        ("*.log", "a/b.log", True), ("/a", "a", True), ("/a", "b/a", False), ("a/**/z", "a/b/c/z", True), ("a/**/z", "a/z", True), ("d/", "d", False), ("d/", "d/", True), ("[!a]x", "bx", True),
        ("[!a]x", "ax", False), (r"\#x", "#x", True), ("a?c", "a/c", False),
    ]
    for line, path, wanted in cases:
        assert bool(patterns.python_regex(patterns.gitignore_rule(line).regex).search(path)) is wanted, (line, path)
    assert patterns.gitignore_rule("# note") is None and patterns.gitignore_rule("   ") is None and patterns.gitignore_rule("!x").negated


def test_languages(spark):
    assert len(language.languages()) == 104
    rows = spark.createDataFrame([(p,) for p in ("a.py", "x/Dockerfile", "A.PY", "a.C", "a.c", "t.d.ts", "unknown.zzz", "noending")], "path string")
    found = {r.path: r.l for r in rows.select("path", language.language_of(rows.path).alias("l")).collect()}
    assert found["a.py"] == found["A.PY"] == "python" and found["x/Dockerfile"] == "dockerfile" and found["unknown.zzz"] == found["noending"] == "unknown"
    assert found["a.C"] != found["a.c"]


def test_scope_of_documentation():
    assert ignore.scope_match("docs/private", ignore.IgnoreRules.of(["private"])) == "docs/private"
    assert ignore.scope_match("docs/private", ignore.IgnoreRules.of(["docs"])) == "docs"
    assert ignore.scope_match("docs/private", ignore.IgnoreRules.of(["other"])) is None


def test_configuration(tmp_path):
    root = tmp_path / "p"
    root.mkdir()
    registry = {"schema_version": 1, "projects": {"p": {"ROOT_NAME": "p", "ROOT_PATH": str(root), "IGNORE_FOLDERS": ["gone"], "IGNORE_FILES": ["*.tmp"]}}}
    rules = config.registry_rules(json.dumps(registry), root)
    assert rules[config.FOLDERS] == ["gone"] and rules[config.FILES] == ["*.tmp"]
    with pytest.raises(config.ConfigurationError):
        config.registry_rules(json.dumps(registry | {"schema_version": 99}), root)
    with pytest.raises(config.ConfigurationError):
        config.registry_rules("{", root)
    assert config.merged({config.FOLDERS: ["a", "b"], config.FILES: []}, {config.FOLDERS: ["b"], config.FILES: ["c"]})[config.FILES] == ["c"]


TRACED = {
    "__init__.py": "",
    "a.py": """from .b import f, K
import pkg.b as w
from . import nowhere
from .... import far

def g(cb):
    x = K()
    return f(), w.f(), cb(), x.m(), other()

def h(f):
    return f()

f()
t[0]()
""",
    "b.py": "def f():\n    return 1\n\nclass K:\n    def m(self):\n        return f()\n",
    "c.py": "def f():\n    pass\nf = 1\ndef g():\n    return f()\n",
}
#: read line by line against the sources above
TRACE = """# Dependency Trace

## Summary

- Source nodes: 4
- Import resolutions: 5
- Call resolutions: 11
- Confirmed internal edges: 8
- Resolved internal imports: 3
- Resolved internal calls: 5
- Confirmed caller endpoints: 3
- Confirmed callee endpoints: 2
- Unresolved imports: 1
- Ambiguous imports: 0
- Invalid relative imports: 1
- Potential internal calls: 1
- Unresolved calls: 2
- Ambiguous calls: 0
- Dynamic calls: 2
- Shadowed calls: 1

## Confirmed internal dependencies

- [IMPORT] `pkg/a.py` → `pkg/b.py` (line 1, scope `<module>`)
- [IMPORT] `pkg/a.py` → `pkg/b.py` (line 1, scope `<module>`)
- [IMPORT] `pkg/a.py` → `pkg/b.py` (line 2, scope `<module>`)
- [CALL] `pkg/a.py::g` → `pkg/b.py::K` (line 7)
- [CALL] `pkg/a.py::g` → `pkg/b.py::f` (line 8)
- [CALL] `pkg/a.py::g` → `pkg/b.py::f` (line 8)
- [CALL] `pkg/a.py::<module>` → `pkg/b.py::f` (line 13)
- [CALL] `pkg/b.py::K.m` → `pkg/b.py::f` (line 6)

## Confirmed calls by caller

- `pkg/a.py::<module>`
  - CALLS `pkg/b.py::f` (line 13)
- `pkg/a.py::g`
  - CALLS `pkg/b.py::K` (line 7)
  - CALLS `pkg/b.py::f` (line 8)
  - CALLS `pkg/b.py::f` (line 8)
- `pkg/b.py::K.m`
  - CALLS `pkg/b.py::f` (line 6)

## Confirmed calls by callee

- `pkg/b.py::K`
  - CALLED BY `pkg/a.py::g` (line 7)
- `pkg/b.py::f`
  - CALLED BY `pkg/a.py::<module>` (line 13)
  - CALLED BY `pkg/a.py::g` (line 8)
  - CALLED BY `pkg/a.py::g` (line 8)
  - CALLED BY `pkg/b.py::K.m` (line 6)

## Unresolved imports

- `pkg/a.py`:3 requested `pkg.nowhere`

## Ambiguous imports

- None.

## Invalid relative imports

- `pkg/a.py`:4

## Potential internal calls (not confirmed edges)

- `pkg/c.py`:5 `f` → candidate `pkg/c.py::f` (scope `g`)

## Shadowed call candidates

- `pkg/a.py`:11 `f` shadowed by `parameter` (scope `h`)

## Unresolved calls

- `pkg/a.py`:8 `x.m` (scope `g`)
- `pkg/a.py`:8 `other` (scope `g`)

## Ambiguous call candidates

- None.

## Dynamic calls

- `pkg/a.py`:8 kind `callback_parameter` (scope `g`)
- `pkg/a.py`:14 kind `subscript_selected` (scope `<module>`)
"""


def test_every_line_of_a_trace(spark, tmp_path):
    root = tmp_path / "proj"
    (root / "pkg").mkdir(parents=True)
    for name, text in TRACED.items():
        (root / "pkg" / name).write_text(text)
    assert cli.main(["--project", str(root), "--trace", "--output", str(tmp_path / "out")], spark) == 0
    assert (tmp_path / "out" / "proj" / "proj-trace.md").read_text() == TRACE
