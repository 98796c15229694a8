"""Registered queries of the evidence operators, each with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions import language, paths, patterns, text
from codequarry.operators import config, graph, ignore, imports, reading
from codequarry.operators.shared import materialise
from codequarry.plans import bindings as b
from codequarry.plans import cases, reports, run
from codequarry.sources import facts, tree

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def registered(sql: str | None = None):
    def keep(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return keep


# ---- files made of documents

_RULES = "SELECT * FROM (VALUES " + ", ".join(
    f"('{lang.name}', '{kind}', '{key}')" for lang in language.languages().values() for kind, keys in (("basename", lang.basenames), ("exact", lang.exact_suffixes), ("folded", lang.suffixes)) for key in keys
) + ") AS r(language, kind, key)"
_CLASSIFIED = f"""
SELECT doc_id, path, content, CASE WHEN name = 'Dockerfile' THEN 'dockerfile' WHEN name = 'GNUmakefile' THEN 'makefile' WHEN name = 'Build' THEN 'starlark'
    WHEN ends_with(name, '.d.ts') THEN 'typescript' WHEN ends_with(name, '.blade.php') THEN 'blade' WHEN ends_with(name, '.C') THEN 'cpp' WHEN ends_with(name, '.py') OR ends_with(name, '.pyi') THEN 'python'
    WHEN ends_with(name, '.c') THEN 'c' WHEN ends_with(name, '.TXT') THEN 'plain_text' WHEN ends_with(name, '.md') THEN 'markdown' WHEN ends_with(name, '.Rs') THEN 'rust'
    WHEN ends_with(name, '.j2') THEN 'jinja' ELSE 'unknown' END AS language
FROM (SELECT *, split_part(path, '/', 3) AS name FROM ({b.FILES_FROM_DOCUMENTS}) AS x)
"""
_LABELS = "CASE language " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in language.FENCE_LABELS.items()) + " ELSE language END"
_RUN = "list_max(list_transform(regexp_extract_all(content, '`+'), lambda x: length(x)))"
_FENCE = f"repeat('`', CAST(greatest(3, 1 + coalesce({_RUN}, 0)) AS INT))"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.bound(spark, sf_dir, b.FILES_FROM_DOCUMENTS).withColumn("language", language.language_of(F.col("path")))


@registered(f"SELECT path, language, {_LABELS} AS label FROM ({_CLASSIFIED})")
def language_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("path", "language", language.fence_label(F.col("language")).alias("label"))


@registered(f"SELECT language, {_LABELS} AS label, count(*) AS files, CAST(sum(length(content)) AS BIGINT) AS characters, CAST(max(length({_FENCE})) AS INT) AS longest_fence FROM ({_CLASSIFIED}) GROUP BY language")
def fence_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship slice: files to languages to fences to figures of each language, one partial aggregation."""
    found = _documents(spark, sf_dir).withColumn("fence", F.length(text.safe_fence(F.col("content"))))
    grouped = found.groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.sum(F.char_length("content")).alias("characters"), F.max("fence").alias("longest_fence"))
    return grouped.withColumn("label", language.fence_label(F.col("language")))


@registered("SELECT language, category, kind, key FROM (" + _RULES + ") JOIN (SELECT * FROM (VALUES " + ", ".join(f"('{d.name}', '{d.category}')" for d in language.languages().values()) + ") AS c(language, category)) USING (language)")
def language_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.dimension(spark)


@registered(f"SELECT doc_id, length(cleaned) AS n, md5(cleaned) AS digest FROM (SELECT doc_id, regexp_replace(content, '[^\\t\\n\\r\\x{{20}}-\\x{{D7FF}}\\x{{E000}}-\\x{{FFFD}}\\x{{10000}}-\\x{{10FFFF}}]', '', 'g') AS cleaned FROM ({b.FILES_FROM_DOCUMENTS}))")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = _documents(spark, sf_dir).select("doc_id", text.clean_text(F.col("content")).alias("c"))
    return cleaned.select("doc_id", F.char_length("c").cast("long").alias("n"), F.md5(F.col("c").cast("binary")).alias("digest"))


@registered(f"SELECT doc_id, {_FENCE} AS fence FROM ({b.FILES_FROM_DOCUMENTS})")
def safe_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", text.safe_fence(F.col("content")).alias("fence"))


_SECTION = f"""'# `' || path || '`' || chr(10) || chr(10) || CASE WHEN regexp_matches(content, '^\\s*$') THEN '[empty file]' || chr(10) || chr(10)
  ELSE {_FENCE} || {_LABELS} || chr(10) || content || chr(10) || {_FENCE} || chr(10) || chr(10) END || '---' || chr(10) || chr(10)"""


@registered(f"SELECT path, md5({_SECTION}) AS digest, length({_SECTION}) AS n FROM ({_CLASSIFIED})")
def report_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _documents(spark, sf_dir).withColumn("status", F.lit("text")).withColumn("ord_key", F.array("path"))
    made = reports.source_sections(found).select(F.get("ord_key", F.lit(0)).alias("path"), "section")
    return made.select("path", F.md5(F.col("section").cast("binary")).alias("digest"), F.char_length("section").cast("long").alias("n"))


LIMIT = reading.MOST_BYTES
#: documents, some with a NUL before the text, and a few texts one byte above the limit
_READ = f"""SELECT doc_id, 'd' || CAST(doc_id AS VARCHAR(20)) AS path, coalesce(text, '') AS content, doc_id % 9 = 0 AS has_nul FROM documents
  UNION ALL SELECT -1 - doc_id, 'long' || CAST(doc_id AS VARCHAR(20)), repeat('x', {LIMIT + 1}), false FROM documents WHERE doc_id % 5000 = 7"""
_SIZE = "octet_length(encode(content)) + CASE WHEN has_nul THEN 1 ELSE 0 END"
_STATUS = f"CASE WHEN has_nul THEN 'binary' WHEN {_SIZE} > {LIMIT} THEN 'oversized' ELSE 'text' END"


def _read(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.bound(spark, sf_dir, _READ)
    data = F.concat(F.when(F.col("has_nul"), F.lit(bytearray(b"\x00"))).otherwise(F.lit(bytearray())), F.col("content").cast("binary"))
    sized = rows.withColumn("data", data).withColumn("size_bytes", F.octet_length("data").cast("long"))
    return sized.withColumn("status", reading.content_status(F.col("data"), F.col("size_bytes"), LIMIT))


@registered(f"SELECT doc_id, {_STATUS} AS status, CAST({_SIZE} AS BIGINT) AS size_bytes FROM ({_READ})")
def read_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir).select("doc_id", "status", "size_bytes")


@registered(f"""SELECT count(*) FILTER (status = 'text') AS added_files, count(*) FILTER (status = 'binary') AS skipped_binary_files, count(*) FILTER (status = 'oversized') AS skipped_oversized_files,
  0 AS skipped_unreadable_files, 0 AS skipped_symlink_files, 0 AS skipped_unsafe_path_files, 0 AS skipped_ignored_files, 0 AS skipped_markdown_error_files FROM (SELECT {_STATUS} AS status FROM ({_READ}))""")
def read_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.summary(_read(spark, sf_dir))


@registered(f"""SELECT doc_id, CASE status WHEN 'text' THEN '[ADD] ' || path WHEN 'oversized' THEN '[SKIP oversized] ' || path || ' -> ' || size || ' bytes' ELSE '[SKIP binary] ' || path END AS log_line
  FROM (SELECT *, {_STATUS} AS status, {_SIZE} AS size FROM ({_READ}))""")
def skip_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return _read(spark, sf_dir).select("doc_id", reading.log_line(F.col("path"), F.col("status"), F.col("size_bytes"), none, none).alias("log_line"))


# ---- paths made of pages

FOLDER_RULES, FILE_RULES = ["d?", "*.egg-info", "[!ef]r", "fr/1*/", "/es/2"], ["1*", "*9", "[2-4]5*", "en/7*", "!fr"]
_PARENT = "CASE WHEN path LIKE '%/%' THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '' END"


@registered(f"SELECT page_id, {_PARENT} AS parent, split_part(path, '/', -1) AS name, length(path) - length(replace(path, '/', '')) AS depth FROM ({b.PATHS_FROM_PAGES})")
def parent_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.bound(spark, sf_dir, b.PATHS_FROM_PAGES)
    return rows.select("page_id", paths.parent_key(F.col("path")).alias("parent"), paths.basename(F.col("path")).alias("name"), (F.size(F.split("path", "/")) - 1).cast("long").alias("depth"))


@registered(f"SELECT page_id, 'docs/public/' || path AS policy FROM ({b.PATHS_FROM_PAGES})")
def policy_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.bound(spark, sf_dir, b.PATHS_FROM_PAGES).select("page_id", paths.policy_path(F.col("path"), "\\docs\\public/").alias("policy"))


@registered(f"""SELECT page_id, (length(a) = 2 AND a LIKE 'd%') OR a LIKE '%.egg-info' OR (length(a) = 2 AND ends_with(a, 'r') AND left(a, 1) NOT IN ('e', 'f')) AS folder,
  z LIKE '1%' OR z LIKE '%9' OR (left(z, 1) IN ('2', '3', '4') AND substr(z, 2, 1) = '5') OR z = '!fr' AS file FROM (SELECT page_id, split_part(path, '/', 1) AS a, split_part(path, '/', -1) AS z FROM ({b.PATHS_FROM_PAGES}))""")
def ignore_basename(spark: SparkSession, sf_dir: str) -> DataFrame:
    folders, files = (ignore.IgnoreRules.of([r for r in rules if "/" not in r]) for rules in (FOLDER_RULES, FILE_RULES))
    rows = b.bound(spark, sf_dir, b.PATHS_FROM_PAGES)
    return rows.select("page_id", folders.matches(F.get(F.split("path", "/"), F.lit(0)), F.lit("x"), True).alias("folder"), files.matches(paths.basename(F.col("path")), F.lit("x"), False).alias("file"))


@registered(f"""SELECT page_id, path LIKE '%/%' AND (starts_with(path, 'es/2/') OR regexp_matches(path, '^fr/1[^/]*/')) AS folder, regexp_matches(path, '^en/7[^/]*(/|$)') AS file
  FROM ({b.PATHS_FROM_PAGES})""")
def ignore_path_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    folders, files = (ignore.IgnoreRules.of([r for r in rules if "/" in r]) for rules in (FOLDER_RULES, FILE_RULES))
    rows, nothing = b.bound(spark, sf_dir, b.PATHS_FROM_PAGES), F.lit("")
    return rows.select("page_id", folders.matches(nothing, paths.parent_key(F.col("path")), True).alias("folder"), files.matches(nothing, F.col("path"), False).alias("file"))


GITIGNORE = [("", 0, "1*"), ("", 1, "!1[0-4]*"), ("", 2, "de/*"), ("de", 0, "!2*"), ("fr", 0, "/3*"), ("fr", 1, "# no rule"), ("fr", 2, "!**/35*"), ("es", 0, "*7")]
_ENTRIES = f"SELECT DISTINCT path FROM ({b.PATHS_FROM_PAGES}) AS p WHERE path LIKE '%/%'"


def _gitignore(spark: SparkSession) -> DataFrame:
    lines = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{d}', {k}, '{line}')" for d, k, line in GITIGNORE) + " AS t(base_dir, rule_ord, line)")
    return ignore.gitignore_rules(lines)


@registered(f"""
SELECT path, CASE WHEN top = 'de' AND name LIKE '2%' THEN false WHEN top = 'fr' AND name LIKE '35%' THEN false WHEN top = 'fr' AND name LIKE '3%' THEN true WHEN top = 'es' AND name LIKE '%7' THEN true
    WHEN top = 'de' THEN true WHEN regexp_matches(name, '^1[0-4]') THEN false WHEN name LIKE '1%' THEN true END AS ignored
FROM (SELECT path, split_part(path, '/', 1) AS top, split_part(path, '/', 2) AS name FROM ({_ENTRIES}))
""")
def gitignore_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files right below a language's folder; nested rule sets speak last."""
    entries = b.bound(spark, sf_dir, _ENTRIES).select("path", F.lit(False).alias("is_directory"))
    return entries.join(ignore.gitignore_verdicts(entries, _gitignore(spark)), ["path", "is_directory"], "left").select("path", "ignored")


_TREE = "SELECT DISTINCT 'n' || CAST(n_regionkey AS VARCHAR(20)) || '/k' || CAST(n_nationkey AS VARCHAR(20)) || '/c' || CAST(c_custkey AS VARCHAR(20)) || '.txt' AS path FROM customer JOIN nation ON n_nationkey = c_nationkey"


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = b.bound(spark, sf_dir, _TREE)
    above = files.select(F.explode(F.filter(ignore.ancestors(F.col("path")), lambda p: p != "")).alias("path")).distinct()
    both = files.withColumn("is_directory", F.lit(False)).unionByName(above.withColumn("is_directory", F.lit(True)))
    return tree.ordered(both.withColumn("name", paths.basename(F.col("path"))))


_PRUNED = f"SELECT path FROM ({_TREE}) WHERE split_part(path, '/', 1) <> 'n2' AND NOT regexp_matches(split_part(path, '/', 2), '^k1[0-9]$') AND NOT ends_with(path, '7.txt')"


@registered(f"SELECT path FROM ({_PRUNED})")
def prune_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    folders, files = ignore.IgnoreRules.of(["k1[0-9]", "/n2"]), ignore.IgnoreRules.of(["*7.txt"])
    return ignore.prune(_entries(spark, sf_dir), folders, files).where("NOT is_directory").select("path")


@registered(f"""
WITH files AS ({_TREE}), every AS (
  SELECT path, 0 AS d FROM files UNION SELECT split_part(path, '/', 1), 1 FROM files UNION SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2), 1 FROM files
)
SELECT path, row_number() OVER (ORDER BY CASE WHEN d = 1 THEN '1' || replace(path, '/', '/1') ELSE '1' || split_part(path, '/', 1) || '/1' || split_part(path, '/', 2) || '/0' || split_part(path, '/', 3) END) AS place,
  repeat('│   ', 1 + length(path) - length(replace(path, '/', ''))) || split_part(path, '/', -1) || CASE WHEN d = 1 THEN '/' ELSE '' END AS line
FROM every
""")
def architecture_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a tree with their place in it; a range-partitioned sort, places by partition offsets."""
    lines = reports.architecture_lines(_entries(spark, sf_dir), "root").where("size(ord_key) > 0")
    return numbered(lines.withColumn("path", F.expr("array_join(transform(ord_key, k -> substring(k, 2)), '/')")), "ord_key").select("path", "place", "line")


def numbered(frame: DataFrame, order: str) -> DataFrame:
    """Adds ``place``, the rank in a global order, without a single-partition window."""
    from pyspark.sql import Window

    part = materialise(frame.repartitionByRange(order).withColumn("__part", F.spark_partition_id()))
    sizes = part.groupBy("__part").count().withColumnRenamed("count", "__n")
    starts = sizes.withColumn("__start", F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)))  # one row a partition
    within = part.withColumn("__k", F.row_number().over(Window.partitionBy("__part").orderBy(order)))
    return within.join(starts, "__part").withColumn("place", F.coalesce("__start", F.lit(0)) + F.col("__k")).drop("__part", "__n", "__start", "__k")


@registered("""SELECT c_nationkey AS project, string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules FROM (
  SELECT c_nationkey, 'r' || CAST(c_custkey % 7 AS VARCHAR(20)) AS rule FROM customer UNION ALL SELECT n_nationkey, 'base' FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)) GROUP BY 1""")
def ignore_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = b.bound(spark, sf_dir, "SELECT c_nationkey AS project, 'r' || CAST(c_custkey % 7 AS STRING) AS rule FROM customer").groupBy("project").agg(F.collect_set("rule").alias("rules"))
    return own.select("project", F.array_join(F.array_sort(F.array_union("rules", F.array(F.lit("base")))), ",").alias("rules"))


_FITS = f"SELECT project, profile, CASE WHEN base IS NOT NULL AND (base < 3 OR draw < 10) THEN base END AS specificity FROM ({b.PROFILES}) AS p"


@registered(f"""SELECT project, CAST(min(profile) AS BIGINT) AS profile, count(*) > 1 AS tied FROM (SELECT *, rank() OVER (PARTITION BY project ORDER BY specificity DESC) AS place FROM ({_FITS}) WHERE specificity IS NOT NULL) WHERE place = 1 GROUP BY project""")
def profile_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return config.best_profiles(b.bound(spark, sf_dir, _FITS))


# ---- modules and imports made of suppliers and line items

_STEM = "regexp_replace(path, '\\.py$', '')"
_SHORT = f"CASE WHEN {_STEM} LIKE '%/__init__' THEN regexp_replace({_STEM}, '/__init__$', '') ELSE {_STEM} END"
_NAME = f"CASE WHEN ends_with(path, '.py') THEN replace(CASE WHEN {_SHORT} LIKE 'src/%' THEN substr({_SHORT}, 5) ELSE {_SHORT} END, '/', '.') END"
_PACKAGE = f"CASE WHEN NOT ends_with(path, '.py') THEN NULL WHEN {_STEM} LIKE '%/__init__' THEN {_NAME} WHEN {_NAME} LIKE '%.%' THEN regexp_extract({_NAME}, '^(.*)\\.[^.]*$', 1) END"
_REQUEST = f"""
SELECT i.*, CASE WHEN level = 0 THEN module WHEN package IS NULL OR level - 1 >= steps THEN NULL
    WHEN level = 1 THEN package || '.' || coalesce(module, imported_name) ELSE array_to_string(list_slice(string_split(package, '.'), 1, steps - (level - 1)), '.') || '.' || coalesce(module, imported_name) END AS request,
  level > 0 AND (package IS NULL OR level - 1 >= steps) AS invalid
FROM (SELECT *, len(string_split(package, '.')) AS steps FROM (SELECT *, {_PACKAGE} AS package FROM ({b.IMPORTS}))) i
"""
_INDEX = f"SELECT name AS module, string_agg(path, ',' ORDER BY path) AS paths, count(*) AS n FROM (SELECT path, {_NAME} AS name FROM ({b.MODULES})) WHERE name IS NOT NULL AND name <> '' GROUP BY name"
_RESOLVED = f"""SELECT r.path, r.ord, r.line, r.scope, r.imported_name, CASE WHEN invalid THEN 'invalid_relative_import' WHEN x.n IS NULL THEN 'unresolved' WHEN x.n = 1 THEN 'resolved_internal' ELSE 'ambiguous' END AS status,
  coalesce(r.request, '') AS requested, CASE WHEN x.n = 1 THEN x.paths END AS target_path, coalesce(x.paths, '') AS candidates FROM ({_REQUEST}) r LEFT JOIN ({_INDEX}) x ON x.module = r.request"""


def _modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.bound(spark, sf_dir, b.MODULES).withColumn("language", language.language_of(F.col("path")))


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imports.resolve_imports(b.bound(spark, sf_dir, b.IMPORTS), _modules(spark, sf_dir))


@registered(f"SELECT path, {_NAME} AS module FROM ({b.MODULES})")
def module_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _modules(spark, sf_dir).select("path", paths.module_name(F.col("path")).alias("module"))


@registered(f"SELECT path, {_PACKAGE} AS package FROM ({b.MODULES})")
def package_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _modules(spark, sf_dir).select("path", paths.package_name(F.col("path")).alias("package"))


@registered(f"SELECT module, paths FROM ({_INDEX})")
def module_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imports.module_index(_modules(spark, sf_dir)).select("module", F.array_join("module_paths", ",").alias("paths"))


@registered(f"SELECT path, ord, request AS requested, invalid FROM ({_REQUEST})")
def requested_module(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.bound(spark, sf_dir, b.IMPORTS).withColumn("package", paths.package_name(F.col("path")))
    asked = paths.requested_module(F.col("level"), F.col("module"), F.col("imported_name"), F.col("package"))
    return rows.select("path", "ord", asked.alias("requested"), paths.invalid_relative(F.col("level"), F.col("package")).alias("invalid"))


@registered(f"""SELECT path, ord, CASE WHEN imported_name IS NOT NULL THEN coalesce(alias, imported_name) END AS bound_from,
  CASE WHEN imported_name IS NULL THEN coalesce(alias, CASE WHEN module NOT LIKE '%.%' THEN module END) END AS bound_plain FROM ({b.IMPORTS})""")
def bound_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    imported, alias = F.col("imported_name"), F.col("alias")
    rows = b.bound(spark, sf_dir, b.IMPORTS)
    return rows.select("path", "ord", paths.from_bound_name(imported, alias).alias("bound_from"), paths.plain_bound_name(F.col("module"), imported, alias).alias("bound_plain"))


_SCOPES = "SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'a' WHEN 2 THEN 'a.b' ELSE 'ab' END AS bs, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'a' WHEN 2 THEN 'a.b' WHEN 3 THEN 'a.b.c' ELSE 'ab.c' END AS cs FROM events"


@registered(f"SELECT event_id, bs IS NULL OR coalesce(bs = cs, false) OR coalesce(starts_with(cs, bs || '.'), false) AS visible FROM ({_SCOPES})")
def scope_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.bound(spark, sf_dir, _SCOPES).select("event_id", paths.scope_visible(F.col("bs"), F.col("cs")).alias("visible"))


@registered(f"SELECT path, ord, status, requested, target_path, candidates FROM ({_RESOLVED})")
def import_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).select("path", "ord", "status", F.array_join("requested_modules", ",").alias("requested"), "target_path", F.array_join("candidate_paths", ",").alias("candidates"))


@registered(f"SELECT status, count(*) AS n FROM ({_RESOLVED}) GROUP BY status")
def import_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of imports and, for indexes, a call for every resolved from-import: its name as the target's symbol."""
    found = _resolved(spark, sf_dir)
    target = "struct(target_path AS source_path, line, imported_name AS qualified_name, 'function' AS kind)"
    calls = found.where("imported_name IS NOT NULL").selectExpr("path", "ord", "line", "scope", "status", f"CASE WHEN target_path IS NOT NULL THEN {target} END AS resolved_target")
    return graph.edges(found, calls)


_EDGES = f"""SELECT 'import' AS kind, path AS source_path, target_path, ord, line, scope, NULL AS target_symbol FROM ({_RESOLVED}) WHERE status = 'resolved_internal'
  UNION ALL SELECT 'call', path, target_path, ord, line, scope, imported_name FROM ({_RESOLVED}) WHERE status = 'resolved_internal' AND imported_name IS NOT NULL"""


@registered(_EDGES)
def dependency_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return import_edges(spark, sf_dir).select("kind", "source_path", "target_path", "ord", "line", "scope", "target_symbol")


_PACKED = "source_path || '|' || coalesce(scope, '') || '|' || line || '|' || target_path || '|' || target_symbol"
_PACKED_ORDER = "source_path, coalesce(scope, ''), line, target_path, target_symbol"


def _packed(index: DataFrame) -> DataFrame:
    item = lambda e: F.concat_ws("|", e["source_path"], e["scope"], e["line"].cast("string"), e["target_path"], e["target_symbol"])
    return index.select("path", "symbol", F.size("edges").cast("long").alias("n"), F.md5(F.array_join(F.transform("edges", item), ",").cast("binary")).alias("digest"))


@registered(f"SELECT source_path AS path, scope AS symbol, count(*) AS n, md5(string_agg({_PACKED}, ',' ORDER BY {_PACKED_ORDER})) AS digest FROM ({_EDGES}) WHERE kind = 'call' GROUP BY 1, 2")
def call_outbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(graph.outbound(import_edges(spark, sf_dir)))


@registered(f"SELECT target_path AS path, target_symbol AS symbol, count(*) AS n, md5(string_agg({_PACKED}, ',' ORDER BY {_PACKED_ORDER})) AS digest FROM ({_EDGES}) WHERE kind = 'call' GROUP BY 1, 2")
def call_inbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(graph.inbound(import_edges(spark, sf_dir)))


@registered(f"SELECT path FROM ({b.MODULES})")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.nodes(_modules(spark, sf_dir))


# ---- python sources made of parts

_COUNT = len(b.TEMPLATES)


def _sources(spark: SparkSession, sf_dir: str, sql: str = b.SOURCES) -> DataFrame:
    files = b.bound(spark, sf_dir, sql).withColumn("language", language.language_of(F.col("path"))).withColumn("status", F.lit("text"))
    return materialise(files.select("path", "language", "status", "content"))


def traced(spark: SparkSession, sf_dir: str, sql: str = b.SOURCES) -> run.Trace:
    """Facts and resolutions of all parts' sources."""
    return run.trace(_sources(spark, sf_dir, sql))


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(facts.facts(_sources(spark, sf_dir)))


_EXPECTED = f"""SELECT 'p' || CAST(p_partkey AS VARCHAR(20)) || '/' || file || '.py' AS path, CAST(line AS INT) AS line, target, status, proof, shadowed_by, dynamic_kind, resolved
  FROM part JOIN ({b.outcomes_sql(b.TEMPLATES)}) AS t ON t.template = p_partkey % {_COUNT}"""


def _calls(spark: SparkSession, sf_dir: str, sql: str = b.SOURCES) -> DataFrame:
    found = traced(spark, sf_dir, sql).calls
    return found.select("path", "line", F.array_join("target_parts", ".").alias("target"), "status", "proof", "shadowed_by", "dynamic_kind", F.col("resolved_target.qualified_name").alias("resolved"))


@registered(_EXPECTED)
def call_resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calls(spark, sf_dir)


_CASES = f"""SELECT 'p' || CAST(p_partkey AS VARCHAR(20)) || '/' || file || '.py' AS path, CAST(line AS INT) AS line, target, status, proof, shadowed_by, dynamic_kind, resolved
  FROM part JOIN ({b.outcomes_sql(cases.CASES)}) AS t ON t.template = p_partkey % {len(cases.CASES)}"""


@registered(_CASES)
def call_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every call of the hard programs, one program for each part."""
    return _calls(spark, sf_dir, b.sources_sql(cases.CASES))


@registered(f"SELECT status, proof, shadowed_by, dynamic_kind, count(*) AS n FROM ({_CASES}) GROUP BY ALL")
def call_case_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return call_cases(spark, sf_dir).groupBy("status", "proof", "shadowed_by", "dynamic_kind").agg(F.count(F.lit(1)).alias("n"))


def _of(name: str, condition: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _calls(spark, sf_dir).where(condition)

    QUERIES[name], SQL[name] = query, f"SELECT * FROM ({_EXPECTED}) WHERE {condition}"


for _name, _condition in {
    "call_name_same_file": "proof = 'same_file_stable_binding'",
    "call_name_import": "proof = 'internal_import_binding'",
    "call_module_attr": "proof = 'internal_module_attribute_binding'",
    "call_class_attr": "proof IN ('same_file_class_attribute_binding', 'internal_imported_class_attribute_binding')",
    "call_inherited": "proof IN ('same_file_inherited_class_attribute_binding', 'internal_imported_inherited_class_attribute_binding')",
    "call_local_instance": "proof IN ('local_instance_constructor_binding', 'local_instance_inherited_method_binding')",
    "call_shadowed": "status = 'shadowed'",
    "dynamic_calls": "status = 'dynamic'",
    "call_unproven": "status IN ('potential_internal', 'ambiguous', 'unresolved')",
}.items():
    _of(_name, _condition)

_BAD = next(k for k, (files, _) in enumerate(b.TEMPLATES) if files[0][1] == "def (\n")


@registered(f"SELECT path, CASE WHEN bad THEN 'syntax_error' ELSE 'parsed' END AS status, 'python.ast' AS parser_id, CASE WHEN bad THEN 'SyntaxError' END AS error_type FROM (SELECT path, content = 'def (' || chr(10) AS bad FROM ({b.SOURCES}))")
def parse_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.outcomes(parsed(spark, sf_dir)).select("path", "status", "parser_id", "error_type")


def _template_rows(columns: str, rows: list[tuple]) -> str:
    values = ", ".join(f"({', '.join(map(b.quoted, r))})" for r in rows)
    return f"SELECT 'p' || CAST(p_partkey AS VARCHAR(20)) || '/' || file || '.py' AS path, t.* EXCLUDE (template, file) FROM part JOIN (VALUES {values}) AS t(template, file, {columns}) ON t.template = p_partkey % {_COUNT}"


#: template, file, line, kind, qualified name; read off the templates by eye
_SYMBOLS = [
    (0, "a", 1, "function", "f"), (0, "a", 2, "function", "g"), (1, "a", 1, "function", "f"), (1, "a", 2, "function", "g"), (2, "a", 2, "function", "g"), (2, "b", 1, "class", "K"), (3, "b", 1, "class", "K"),
    (4, "a", 2, "class", "K"), (4, "a", 3, "function", "g"), (4, "b", 1, "class", "K"), (5, "a", 2, "function", "g"), (5, "b", 1, "function", "f"), (6, "a", 3, "function", "g"), (6, "b", 1, "function", "f"),
    (7, "a", 1, "class", "K"), (7, "a", 2, "function", "K.m"), (7, "a", 3, "function", "g"), (8, "a", 2, "function", "g"), (8, "b", 1, "class", "K"), (8, "b", 2, "function", "K.m"),
    (9, "a", 1, "class", "B"), (9, "a", 2, "function", "B.m"), (9, "a", 3, "class", "C"), (9, "a", 4, "function", "g"), (10, "a", 2, "class", "C"), (10, "a", 3, "function", "g"), (10, "b", 1, "class", "B"), (10, "b", 2, "function", "B.m"),
    (11, "a", 1, "class", "K"), (11, "a", 2, "function", "K.m"), (11, "a", 3, "function", "g"), (12, "a", 1, "class", "B"), (12, "a", 2, "function", "B.m"), (12, "a", 3, "class", "C"), (12, "a", 4, "function", "g"),
    (13, "a", 1, "class", "K"), (13, "a", 2, "function", "K.m"), (13, "a", 3, "function", "g"), (14, "a", 1, "function", "f"), (14, "a", 2, "function", "g"), (15, "a", 1, "function", "g"),
    (17, "a", 1, "class", "L"), (17, "a", 2, "function", "L.m"), (17, "a", 3, "class", "R"), (17, "a", 4, "function", "R.m"), (17, "a", 5, "class", "W"), (17, "a", 6, "function", "g"),
    (18, "a", 1, "class", "A"), (18, "a", 2, "class", "L"), (18, "a", 3, "function", "L.m"), (18, "a", 4, "class", "R"), (18, "a", 5, "function", "R.m"), (18, "a", 6, "class", "W"), (18, "a", 7, "function", "g"),
]
_IMPORTED = [(2, "a", 1, "b", "K", None, 1), (3, "a", 2, "b", "K", None, 1), (4, "a", 1, "b", "K", None, 1), (5, "a", 1, "{p}.b", None, "w", 0), (6, "a", 1, "{p}.b", None, "w", 0), (8, "a", 1, "b", "K", None, 1), (10, "a", 1, "b", "B", None, 1)]


@registered(_template_rows("line, kind, qualified_name", _SYMBOLS))
def parsed_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.relation(parsed(spark, sf_dir), "symbols").select("path", "line", "kind", "qualified_name")


@registered(f"SELECT path, line, replace(module, '{{p}}', split_part(path, '/', 1)) AS module, imported_name, alias, level FROM ({_template_rows('line, module, imported_name, alias, level', _IMPORTED)})")
def parsed_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.relation(parsed(spark, sf_dir), "imports").select("path", "line", "module", "imported_name", "alias", "level")


@registered(f"SELECT path, line, CASE WHEN target = '' THEN 'dynamic' WHEN target LIKE '%.%' THEN 'attribute' ELSE 'name' END AS target_kind, target FROM ({_EXPECTED})")
def parsed_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.relation(parsed(spark, sf_dir), "calls").select("path", "line", "target_kind", F.array_join("target_parts", ".").alias("target"))


_N_IMPORTS = f"({_template_rows('line, module, imported_name, alias, level', _IMPORTED)})"
_OUT = f"SELECT count(DISTINCT (path, line_scope)) FROM (SELECT path, CASE WHEN target = 'K' AND line = 1 THEN '' ELSE 'g' END AS line_scope FROM ({_EXPECTED}) WHERE status = 'resolved_internal')"


@registered(f"""
SELECT label, CAST(value AS BIGINT) AS value FROM (
  SELECT 'Source nodes' AS label, (SELECT count(*) FROM ({b.SOURCES})) AS value UNION ALL SELECT 'Import resolutions', (SELECT count(*) FROM {_N_IMPORTS}) UNION ALL SELECT 'Call resolutions', (SELECT count(*) FROM ({_EXPECTED}))
  UNION ALL SELECT 'Confirmed internal edges', (SELECT count(*) FROM {_N_IMPORTS}) + (SELECT count(*) FROM ({_EXPECTED}) WHERE status = 'resolved_internal') UNION ALL SELECT 'Resolved internal imports', (SELECT count(*) FROM {_N_IMPORTS})
  UNION ALL SELECT 'Unresolved imports', 0 UNION ALL SELECT 'Ambiguous imports', 0 UNION ALL SELECT 'Invalid relative imports', 0 UNION ALL SELECT 'Confirmed caller endpoints', ({_OUT})
  UNION ALL SELECT 'Confirmed callee endpoints', (SELECT count(DISTINCT (split_part(path, '/', 1), resolved)) FROM ({_EXPECTED}) WHERE status = 'resolved_internal')
  UNION ALL SELECT label, (SELECT count(*) FROM ({_EXPECTED}) e WHERE e.status = s.status) FROM (VALUES ('Resolved internal calls', 'resolved_internal'), ('Potential internal calls', 'potential_internal'), ('Unresolved calls', 'unresolved'),
    ('Ambiguous calls', 'ambiguous'), ('Dynamic calls', 'dynamic'), ('Shadowed calls', 'shadowed')) AS s(label, status))
""")
def trace_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = traced(spark, sf_dir)
    return graph.counters(made.files, made.imports, made.calls, graph.edges(made.imports, made.calls)).select("label", "value")


@registered()
def trace_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole trace as ordered lines."""
    made = traced(spark, sf_dir)
    return reports.trace_lines(made.files, made.imports, made.calls).select("section", F.array_join("key", "/").alias("key"), "line")


@registered()
def tree_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """This package's own tree through the data source."""
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    return tree.entries(spark, str(root), [patterns.glob_regex("__pycache__")]).select("path", "name", "is_directory", "is_symlink")


#: fixed values: languages that are registered without any rule for paths
_NO_PATHS = "('matlab', 'objective_c', 'solidity', 'tsql', 'unknown', 'verilog')"


@registered(f"SELECT language, language NOT IN {_NO_PATHS} AS recognised FROM (VALUES " + ", ".join(f"('{name}')" for name in language.languages()) + ") AS t(language)")
def path_recognised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every registered language, whether some path is taken for it."""
    rows = ", ".join(f"('{k.name}', {str(k.recognised_by_path).lower()})" for k in language.languages().values())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(language, recognised)")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fence_label(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
