"""Evidence relations derived from the driver's tables, for queries that other engines can repeat.

The SQL below is plain enough for Spark and for other engines alike, so that a
query and its counterpart start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

EXTENSIONS = (".py", ".d.ts", ".blade.php", ".C", ".h", ".TXT", ".md", "", ".c", ".tar.gz", ".pyi", ".Rs", ".j2")
_EXTENSION = "CASE doc_id % 13 " + " ".join(f"WHEN {k} THEN '{e}'" for k, e in enumerate(EXTENSIONS)) + " END"

#: path and content of every document, in folders by language and source, and some blank files
FILES_FROM_DOCUMENTS = f"""
SELECT doc_id, coalesce(lang, 'none') || '/' || coalesce(source, 'none') || '/' ||
    CASE WHEN doc_id % 17 = 0 THEN 'Dockerfile' WHEN doc_id % 17 = 1 THEN 'GNUmakefile' WHEN doc_id % 17 = 2 THEN 'Build' ELSE 'd' || CAST(doc_id AS VARCHAR(20)) || {_EXTENSION} END AS path,
  coalesce(text, '') || repeat('`', CAST(doc_id % 7 AS INT)) || chr(CAST(1 + doc_id % 31 AS INT)) AS content
FROM documents
UNION ALL SELECT -1 - doc_id, 'none/blank/b' || CAST(doc_id AS VARCHAR(20)) || '.md', '  ' FROM documents WHERE doc_id % 29 = 0
"""

PATHS_FROM_PAGES = """
SELECT page_id, regexp_replace(substr(bare, instr(bare, '/') + 1), '/+$', '') AS path FROM (
  SELECT page_id, split_part(split_part(substr(url, instr(url, '://') + 3), '?', 1), '#', 1) AS bare FROM pages WHERE url LIKE '%://%/%'
) AS b
"""

_MODULE = """CASE WHEN s_suppkey % 10 = 0 THEN 'src/n' || CAST(s_nationkey AS VARCHAR(20)) || '/__init__.py'
  WHEN s_suppkey % 7 = 0 THEN 'n' || CAST(s_nationkey AS VARCHAR(20)) || '/s' || CAST(s_suppkey AS VARCHAR(20)) || '.py'
  WHEN s_suppkey % 13 = 0 THEN 'src/n' || CAST(s_nationkey AS VARCHAR(20)) || '/s' || CAST(s_suppkey AS VARCHAR(20)) || '.pyi'
  ELSE 'src/n' || CAST(s_nationkey AS VARCHAR(20)) || '/s' || CAST(s_suppkey AS VARCHAR(20)) || '.py' END"""

#: path of python files made of suppliers; some stand twice, in and out of src
MODULES = f"""
SELECT DISTINCT path FROM (
  SELECT {_MODULE} AS path FROM supplier
  UNION ALL SELECT 'n' || CAST(s_nationkey AS VARCHAR(20)) || '/s' || CAST(s_suppkey AS VARCHAR(20)) || '.py' FROM supplier WHERE s_suppkey % 11 = 0
) AS m
"""

#: imports of those files, one for each line item
IMPORTS = f"""
SELECT {_MODULE.replace("s_", "a.s_")} AS path, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS ord,
  CASE WHEN l_linenumber % 4 > 0 AND l_partkey % 5 = 0 THEN NULL WHEN l_linenumber % 4 = 1 THEN 's' || CAST(b.s_suppkey AS VARCHAR(20))
    ELSE 'n' || CAST(b.s_nationkey AS VARCHAR(20)) || '.s' || CAST(b.s_suppkey AS VARCHAR(20)) END AS module,
  CASE WHEN l_linenumber % 4 = 0 AND l_partkey % 2 = 0 THEN NULL ELSE 's' || CAST(b.s_suppkey AS VARCHAR(20)) END AS imported_name,
  CASE WHEN l_partkey % 3 = 0 THEN 'alias' END AS alias, CAST(l_linenumber % 4 AS INT) AS level, CASE WHEN l_partkey % 4 = 0 THEN 'g' END AS scope, CAST(l_linenumber AS INT) AS line
FROM lineitem JOIN supplier a ON a.s_suppkey = l_suppkey JOIN (SELECT *, row_number() OVER (ORDER BY s_suppkey) - 1 AS place FROM supplier) b ON b.place = l_partkey % (SELECT count(*) FROM supplier)
"""

#: template: files (name, text) and the outcome of each call (file, line, target, status, proof, shadowed_by, dynamic_kind, resolved)
TEMPLATES: list[tuple[list[tuple[str, str]], list[tuple]]] = [
    ([("a", "def f(): ...\ndef g(): return f()\n")], [("a", 2, "f", "resolved_internal", "same_file_stable_binding", None, None, "f")]),
    ([("a", "def f(): ...\ndef g(): return f()\nf = other\n")], [("a", 2, "f", "potential_internal", None, None, None, None)]),
    ([("a", "from .b import K\ndef g(): return K()\n"), ("b", "class K: pass\n")], [("a", 2, "K", "resolved_internal", "internal_import_binding", None, None, "K")]),
    ([("a", "x = K()\nfrom .b import K\n"), ("b", "class K: pass\n")], [("a", 1, "K", "potential_internal", None, None, None, None)]),
    ([("a", "from .b import K\nclass K: pass\ndef g(): return K()\n"), ("b", "class K: pass\n")], [("a", 3, "K", "ambiguous", None, None, None, None)]),
    ([("a", "import {p}.b as w\ndef g(): return w.f()\n"), ("b", "def f(): ...\n")], [("a", 2, "w.f", "resolved_internal", "internal_module_attribute_binding", None, None, "f")]),
    ([("a", "import {p}.b as w\nw.f = 1\ndef g(): return w.f()\n"), ("b", "def f(): ...\n")], [("a", 3, "w.f", "potential_internal", None, None, None, None)]),
    ([("a", "class K:\n  def m(self): ...\ndef g(): return K.m(None)\n")], [("a", 3, "K.m", "resolved_internal", "same_file_class_attribute_binding", None, None, "K.m")]),
    ([("a", "from .b import K\ndef g(): return K.m(None)\n"), ("b", "class K:\n  def m(self): ...\n")], [("a", 2, "K.m", "resolved_internal", "internal_imported_class_attribute_binding", None, None, "K.m")]),
    ([("a", "class B:\n  def m(self): ...\nclass C(B): pass\ndef g(): return C.m(None)\n")], [("a", 4, "C.m", "resolved_internal", "same_file_inherited_class_attribute_binding", None, None, "B.m")]),
    ([("a", "from .b import B\nclass C(B): pass\ndef g(): return C.m(None)\n"), ("b", "class B:\n  def m(self): ...\n")], [("a", 3, "C.m", "resolved_internal", "internal_imported_inherited_class_attribute_binding", None, None, "B.m")]),
    (
        [("a", "class K:\n  def m(self): ...\ndef g():\n  x = K()\n  return x.m()\n")],
        [("a", 4, "K", "resolved_internal", "same_file_stable_binding", None, None, "K"), ("a", 5, "x.m", "resolved_internal", "local_instance_constructor_binding", None, None, "K.m")],
    ),
    (
        [("a", "class B:\n  def m(self): ...\nclass C(B): pass\ndef g():\n  x = C()\n  return x.m()\n")],
        [("a", 5, "C", "resolved_internal", "same_file_stable_binding", None, None, "C"), ("a", 6, "x.m", "resolved_internal", "local_instance_inherited_method_binding", None, None, "B.m")],
    ),
    (
        [("a", "class K:\n  def m(self): ...\ndef g():\n  x = K()\n  h()\n  return x.m()\n")],
        [("a", 4, "K", "resolved_internal", "same_file_stable_binding", None, None, "K"), ("a", 5, "h", "unresolved", None, None, None, None), ("a", 6, "x.m", "unresolved", None, None, None, None)],
    ),
    ([("a", "def f(): ...\ndef g(f): return f()\n")], [("a", 2, "f", "shadowed", None, "parameter", None, None)]),
    ([("a", "def g(cb): return cb()\n")], [("a", 1, "cb", "dynamic", None, None, "callback_parameter", None)]),
    (
        [("a", "t[0]()\ngetattr(o, n)()\nh()()\n(lambda: 1)()\n")],
        [
            ("a", 1, "", "dynamic", None, None, "subscript_selected", None), ("a", 2, "", "dynamic", None, None, "getattr_result", None), ("a", 2, "getattr", "unresolved", None, None, None, None),
            ("a", 3, "", "dynamic", None, None, "returned_callable", None), ("a", 3, "h", "unresolved", None, None, None, None), ("a", 4, "", "dynamic", None, None, "other", None),
        ],
    ),
    ([("a", "class L:\n  def m(self): ...\nclass R:\n  def m(self): ...\nclass W(L, R): pass\ndef g(): return W.m(None)\n")], [("a", 6, "W.m", "resolved_internal", "same_file_inherited_class_attribute_binding", None, None, "L.m")]),
    ([("a", "class A: pass\nclass L(A):\n  def m(self): ...\nclass R(A):\n  def m(self): ...\nclass W(L, R): pass\ndef g(): return W.m(None)\n")], [("a", 7, "W.m", "unresolved", None, None, None, None)]),
    ([("a", "def (\n")], []),
]


def quoted(value: str | int | None) -> str:
    if value is None:
        return "NULL"
    return str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def templates_sql(templates: list) -> str:
    """(template, file, source) rows; a source's {p} stands for the folder, and line feeds are written as ~."""
    rows = [f"({k}, {quoted(name)}, {quoted(text.replace(chr(10), '~'))})" for k, (files, _) in enumerate(templates) for name, text in files]
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") AS t(template, file, source)"


def outcomes_sql(templates: list) -> str:
    rows = [f"({k}, {', '.join(map(quoted, call))})" for k, (_, calls) in enumerate(templates) for call in calls]
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") AS t(template, file, line, target, status, proof, shadowed_by, dynamic_kind, resolved)"


def sources_sql(templates: list) -> str:
    """One folder of python files for each part."""
    return f"""
SELECT 'p' || CAST(p_partkey AS VARCHAR(20)) || '/' || file || '.py' AS path, replace(replace(source, '~', chr(10)), '{{p}}', 'p' || CAST(p_partkey AS VARCHAR(20))) AS content
FROM part JOIN ({templates_sql(templates)}) AS t ON t.template = p_partkey % {len(templates)}
"""


SOURCES = sources_sql(TEMPLATES)

#: profiles (customers) that may fit projects (nations)
PROFILES = """
SELECT c_nationkey AS project, c_custkey AS profile, CASE c_mktsegment WHEN 'BUILDING' THEN NULL WHEN 'AUTOMOBILE' THEN 3 WHEN 'MACHINERY' THEN 2 WHEN 'HOUSEHOLD' THEN 1 ELSE 0 END AS base,
  c_custkey % 50 AS draw FROM customer
"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")


def bound(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A binding's rows, over the tables of ``sf_dir`` that it names."""
    import re

    names = [t for t in TABLES if re.search(rf"\b(?:FROM|JOIN) {t}\b", sql)]
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in names}
    text = re.sub(r"[{}]", lambda m: m[0] * 2, sql)
    for t in names:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **frames)
