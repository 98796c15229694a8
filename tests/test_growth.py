"""What must not grow with the number of files: files a task parses, and rows that pass the driver."""

from __future__ import annotations

from codequarry.operators import calls, shared
from codequarry.plans import bindings, cases, evidence, reports, run
from codequarry.sources import facts


def test_one_split_of_files_is_parsed_by_many_tasks(spark):
    rows = spark.range(0, 4 * facts.LEAST_FILES, 1, 1).selectExpr("concat('p', id, '/a.py') AS path", "'python' AS language", "'text' AS status", "concat('def f', id, '(): ...') AS content")
    found = facts.facts(rows)
    assert rows.rdd.getNumPartitions() == 1 and found.rdd.getNumPartitions() == 4
    names = facts.relation(found, "symbols").selectExpr("concat('p', substring(name, 2), '/a.py') = path AS same").collect()
    assert len(names) == 4 * facts.LEAST_FILES and all(n.same for n in names)


def test_copies_of_a_small_text_are_walked_once(monkeypatch):
    walked, walk = [], facts.Walk
    monkeypatch.setattr(facts, "Walk", lambda tree: walked.append(1) or walk(tree))
    facts._parsed_small.cache_clear()
    small, large = "def f(): return g()\n", "def f(): return g()\n" + "#" * facts.SMALL
    found = [facts.file_facts(path, "python", "text", text) for path in ("a.py", "b.py") for text in (small, large, "def (\n")]
    assert [(r["path"], r["status"]) for r in found] == [(p, s) for p in ("a.py", "b.py") for s in ("parsed", "parsed", "syntax_error")]
    assert all({**a, "path": ""} == {**b, "path": ""} for a, b in zip(found[:3], found[3:], strict=True)) and len(walked) == 3


def test_tasks_of_a_parse_are_bounded():
    assert [facts.parts(n, 8) for n in (0, 1, 500, 501, 10_000, 10_000_000)] == [1, 1, 1, 2, 20, 500]


def test_no_table_of_a_trace_passes_the_driver(spark, sf_dir, monkeypatch):
    plans = []

    def seen(frame):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return shared.materialise(frame)

    for module in (calls, run):
        monkeypatch.setattr(module, "materialise", seen)
    made = run.trace(evidence._sources(spark, sf_dir, bindings.sources_sql(cases.CASES)))
    assert made.calls.count() > 100 and len(plans) > 15
    assert not [p for p in plans if "Broadcast" in p]


def test_a_report_is_made_of_lines_written_once(spark):
    files = spark.createDataFrame([("a.py",)], "path string")
    at = "path string, ord int, line int, scope string, status string"
    asked = spark.createDataFrame([], f"{at}, target_path string, requested_modules array<string>, candidate_paths array<string>")
    target = "struct<source_path:string,line:int,qualified_name:string,kind:string>"
    called = spark.createDataFrame([("a.py", 0, 1, None, "unresolved", None, ["f"], [], None, None)], f"{at}, resolved_target {target}, target_parts array<string>, candidate_targets array<{target}>, shadowed_by string, dynamic_kind string")
    made = reports.trace_lines(files, asked, called)
    plan = made._jdf.queryExecution().analyzed().toString()
    assert "LogicalRDD" not in plan and plan.count(" parquet") == 2  # nothing but the written lines, twice
    lines = {(r.section, r.line) for r in made.collect()}
    assert {k for k, line in lines if line == "- None."} == set(range(1, 12)) - {9} and (9, "- `a.py`:1 `f` (scope `<module>`)") in lines
