"""Resolving calls by joins over fact relations.

Heads of calls (a name, or the receiver of ``a.b``) meet the symbols of their
file and the import bindings they can see; stability of a definition is an
aggregation over binding sites; inheritance is a closure over proven hops that
advances by one join a level.  Every step is an equi-join on a path first, so
files spread over the cluster and nothing is broadcast by hand.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.operators.shared import apart, materialise
from codequarry.sources import facts as F_

TARGET = "struct({t}.path AS source_path, {t}.line AS line, {t}.qualified_name AS qualified_name, {t}.kind AS kind)"
TARGETS = "array<struct<source_path:string,line:int,qualified_name:string,kind:string>>"
SPECIAL = "('__new__', '__init__', '__getattribute__', '*')"
INHERITED = {"same": "same_file_inherited_class_attribute_binding", "import": "internal_imported_inherited_class_attribute_binding"}


def query(frame: DataFrame, sql: str, **frames: DataFrame) -> DataFrame:
    """``sql`` over ``frames``, which meet in joins that keep them off the driver."""
    return frame.sparkSession.sql(sql, **{name: apart(f) for name, f in frames.items()})


@dataclass(frozen=True)
class Relations:
    """The facts that resolution reads, and what follows from them file by file."""

    calls: DataFrame
    symbols: DataFrame
    flags: DataFrame
    imports: DataFrame  # resolved internally, with both bound names
    stable: DataFrame  # path, name, kind, line of definitions that are a module's only binding
    classes: DataFrame
    class_bindings: DataFrame
    members: DataFrame  # symbols Class.member by class, with is_stable
    mutations: DataFrame


def relations(found: DataFrame, import_resolutions: DataFrame) -> Relations:
    get = lambda name: F_.relation(found, name)
    symbols, classes, class_bindings = get("symbols"), get("classes"), get("class_bindings")
    mutations = get("mutations").distinct()
    bound = import_resolutions.where("status = 'resolved_internal'").selectExpr(
        "path", "ord", "scope", "line", "target_path", "imported_name",
        "CASE WHEN imported_name IS NOT NULL THEN coalesce(alias, imported_name) END AS bound_from",
        "CASE WHEN imported_name IS NULL THEN coalesce(alias, CASE WHEN NOT contains(module, '.') THEN module END) END AS bound_plain",
    )
    sites = get("module_bindings").groupBy("path", "name").agg(F.count(F.lit(1)).alias("n"), F.max("kind").alias("kind"), F.max("line").alias("line"))
    stable = query(
        found,
        """
        SELECT s.path, s.name, s.kind, s.line FROM {symbols} s
        JOIN {sites} b ON b.path = s.path AND b.name = s.name AND b.n = 1 AND b.kind = 'definition' AND b.line = s.line
        LEFT ANTI JOIN (SELECT path FROM {sites} WHERE name = '*') star ON star.path = s.path
        WHERE s.in_body AND NOT s.decorated AND s.qualified_name = s.name
        """,
        symbols=symbols, sites=sites,
    )
    class_sites = query(found, "SELECT path, class_name, class_line, name, count(*) AS n, max(kind) AS kind, max(line) AS line FROM {b} GROUP BY ALL", b=class_bindings)
    proper = query(found, "SELECT path, class_name, class_line, name, kind, line, min(decorated) AS decorated FROM {own} GROUP BY ALL", own=get("class_members"))
    named = query(
        found,
        """
        SELECT DISTINCT path, qualified_name, kind, line, substring_index(qualified_name, '.', 1) AS class_name,
          substring(qualified_name, length(substring_index(qualified_name, '.', 1)) + 2) AS member
        FROM {symbols} WHERE size(split(qualified_name, '[.]')) = 2
        """,
        symbols=symbols,
    )
    members = query(
        found,
        """
        SELECT m.path, m.class_name, m.member, m.qualified_name, m.kind, m.line, p.class_line,
          p.name IS NOT NULL AND NOT p.decorated AND coalesce(s.n = 1 AND s.kind = 'definition' AND s.line = m.line, false) AND star.path IS NULL AND mu.path IS NULL AS is_stable
        FROM {named} m
        LEFT JOIN {proper} p ON p.path = m.path AND p.class_name = m.class_name AND p.name = m.member AND p.kind = m.kind AND p.line = m.line
        LEFT JOIN {sites} s ON s.path = p.path AND s.class_name = p.class_name AND s.class_line = p.class_line AND s.name = p.name
        LEFT JOIN {sites} star ON star.path = p.path AND star.class_name = p.class_name AND star.class_line = p.class_line AND star.name = '*'
        LEFT JOIN {mutations} mu ON mu.path = m.path AND mu.receiver = m.class_name AND mu.member = m.member
        """,
        named=named, proper=proper, sites=class_sites, mutations=mutations,
    )
    return Relations(
        get("calls"), symbols, get("flags"), materialise(bound), materialise(stable), classes.dropDuplicates(["path", "name", "line"]), class_bindings, materialise(members), materialise(mutations)
    )


VISIBLE = "(i.scope IS NULL OR i.scope <=> c.scope OR startswith(c.scope, i.scope || '.'))"
SHADOW = """CASE WHEN f.is_parameter THEN 'parameter' WHEN f.is_nonlocal THEN 'nonlocal' WHEN f.is_free THEN 'free' WHEN f.is_assigned THEN 'assignment'
  WHEN f.is_imported THEN CASE WHEN {imported} THEN NULL ELSE 'import' END WHEN f.is_local THEN 'local' END"""
CLEAN = "(b.is_imported AND NOT b.is_assigned AND NOT b.is_parameter AND NOT b.is_nonlocal AND NOT b.is_free)"


def heads(r: Relations, calls: DataFrame, classes_only: bool) -> DataFrame:
    """For each (path, ord): candidates of the first part, shadowing, and a proven target if there is one.

    A target is proven through its only import binding or its stable definition.
    """
    top = r.symbols.where("qualified_name = name" + (" AND kind = 'class'" if classes_only else ""))
    own = query(calls, f"SELECT c.path, c.ord, {TARGET.format(t='t')} AS target FROM {{calls}} c JOIN {{top}} t ON t.path = c.path AND t.name = c.target_parts[0]", calls=calls, top=top)
    imported = query(
        calls,
        f"""
        SELECT c.path, c.ord, {TARGET.format(t="t")} AS target,
          coalesce({CLEAN}, false) AND NOT ((i.scope <=> c.scope OR (i.scope IS NULL AND c.at_init)) AND i.line >= c.line) AS proves
        FROM {{calls}} c
        JOIN {{imports}} i ON i.path = c.path AND i.bound_from = c.target_parts[0] AND {VISIBLE}
        JOIN {{top}} t ON t.path = i.target_path AND t.name = i.imported_name
        LEFT JOIN {{flags}} b ON b.path = i.path AND b.scope <=> i.scope AND b.name = i.bound_from
        """,
        calls=calls, imports=r.imports, top=top, flags=r.flags,
    )
    both = query(
        calls,
        """
        SELECT path, ord, array_sort(collect_set(CASE WHEN own THEN target END)) AS same, array_sort(collect_set(CASE WHEN NOT own THEN target END)) AS imported,
          count_if(NOT own) AS bindings, bool_and(CASE WHEN NOT own THEN proves END) AS proves, count_if(own) AS same_rows
        FROM (SELECT path, ord, target, true AS own, false AS proves FROM {own} UNION ALL SELECT path, ord, target, false, proves FROM {imported}) GROUP BY path, ord
        """,
        own=own, imported=imported,
    )
    none = f"cast(array() AS {TARGETS})"
    joined = query(
        calls,
        f"""
        SELECT c.path, c.ord, c.scope, c.line, c.at_init, c.implicit_shadow, coalesce(h.same, {none}) AS same, coalesce(h.imported, {none}) AS imported,
          coalesce(h.bindings, 0) AS bindings, coalesce(h.proves, false) AS proves, coalesce(h.same_rows, 0) AS same_rows,
          coalesce(f.is_parameter, false) AS is_parameter, {SHADOW.format(imported="coalesce(h.bindings, 0) > 0")} AS shadow,
          CASE WHEN f.is_imported AND h.bindings > 0 THEN h.imported ELSE array_sort(array_distinct(concat(coalesce(h.same, {none}), coalesce(h.imported, {none})))) END AS candidates
        FROM {{calls}} c
        LEFT JOIN {{both}} h ON h.path = c.path AND h.ord = c.ord
        LEFT JOIN {{flags}} f ON f.path = c.path AND f.scope = c.scope AND f.name = c.target_parts[0]
        """,
        calls=calls, both=both, flags=r.flags,
    )
    # with one candidate in all, every import binding is a binding of that candidate
    return query(
        calls,
        """
        SELECT j.*, CASE WHEN size(candidates) <> 1 OR implicit_shadow THEN NULL
            WHEN bindings = 1 AND proves AND array_contains(imported, candidates[0]) THEN 'import'
            WHEN s.path IS NOT NULL AND same_rows = 1 AND array_contains(same, candidates[0]) AND NOT (j.at_init AND candidates[0].line >= j.line) THEN 'same' END AS proven,
          candidates[0] AS target
        FROM (SELECT *, get(candidates, 0) AS only FROM {joined}) j
        LEFT JOIN {stable} s ON s.path = j.only.source_path AND s.path = j.path AND s.name = j.only.qualified_name AND s.kind = j.only.kind AND s.line = j.only.line
        """.replace("candidates[0] AS target", "only AS target"),
        joined=joined, stable=r.stable,
    )


RESULT = "path, ord, status, candidate_targets, resolved_target, proof, shadowed_by, dynamic_kind"
NO_TARGET = "cast(NULL AS struct<source_path:string,line:int,qualified_name:string,kind:string>)"


def name_calls(r: Relations) -> DataFrame:
    found = heads(r, r.calls.where("target_kind = 'name'"), classes_only=False)
    return query(
        found,
        f"""
        SELECT path, ord,
          CASE WHEN is_parameter AND size(same) = 0 AND bindings = 0 THEN 'dynamic' WHEN shadow IS NOT NULL THEN 'shadowed' WHEN proven IS NOT NULL THEN 'resolved_internal'
            WHEN size(candidates) = 0 THEN 'unresolved' WHEN size(candidates) = 1 THEN 'potential_internal' ELSE 'ambiguous' END AS status,
          CASE WHEN shadow IS NOT NULL THEN cast(array() AS {TARGETS}) ELSE candidates END AS candidate_targets,
          CASE WHEN shadow IS NULL AND proven IS NOT NULL THEN target END AS resolved_target,
          CASE WHEN shadow IS NULL THEN CASE proven WHEN 'import' THEN 'internal_import_binding' WHEN 'same' THEN 'same_file_stable_binding' END END AS proof,
          CASE WHEN NOT (is_parameter AND size(same) = 0 AND bindings = 0) THEN shadow END AS shadowed_by,
          CASE WHEN is_parameter AND size(same) = 0 AND bindings = 0 THEN 'callback_parameter' END AS dynamic_kind
        FROM {{found}}
        """,
        found=found,
    )


def module_attribute_calls(r: Relations, calls: DataFrame) -> DataFrame:
    """Calls ``module.function`` through a plain import; only those that the rule decides."""
    rows = query(
        calls,
        f"""
        SELECT c.path, c.ord, {TARGET.format(t="t")} AS target,
          coalesce({CLEAN}, false) AND NOT (i.scope <=> c.scope AND i.line >= c.line) AND s.path IS NOT NULL AND m.path IS NULL AS proves,
          {SHADOW.format(imported="true")} AS shadow
        FROM {{calls}} c
        JOIN {{imports}} i ON i.path = c.path AND i.bound_plain = c.target_parts[0] AND {VISIBLE}
        JOIN {{top}} t ON t.path = i.target_path AND t.name = c.target_parts[1]
        LEFT JOIN {{flags}} b ON b.path = i.path AND b.scope <=> i.scope AND b.name = i.bound_plain
        LEFT JOIN {{flags}} f ON f.path = c.path AND f.scope = c.scope AND f.name = c.target_parts[0]
        LEFT JOIN {{stable}} s ON s.path = t.path AND s.name = t.qualified_name AND s.kind = t.kind AND s.line = t.line
        LEFT JOIN {{mutations}} m ON m.path = c.path AND m.receiver = c.target_parts[0] AND m.member = c.target_parts[1]
        """,
        calls=calls, imports=r.imports, top=r.symbols.where("qualified_name = name"), flags=r.flags, stable=r.stable, mutations=r.mutations,
    )
    return query(
        calls,
        f"""
        SELECT path, ord, CASE WHEN shadow IS NOT NULL THEN 'shadowed' WHEN proven THEN 'resolved_internal' WHEN size(targets) = 1 THEN 'potential_internal' ELSE 'ambiguous' END AS status,
          CASE WHEN shadow IS NULL THEN targets ELSE cast(array() AS {TARGETS}) END AS candidate_targets, CASE WHEN shadow IS NULL AND proven THEN targets[0] END AS resolved_target,
          CASE WHEN shadow IS NULL AND proven THEN 'internal_module_attribute_binding' END AS proof, shadow AS shadowed_by, cast(NULL AS string) AS dynamic_kind
        FROM (SELECT path, ord, array_sort(collect_set(target)) AS targets, max(shadow) AS shadow, count(*) = 1 AND bool_and(proves) AS proven FROM {{rows}} GROUP BY path, ord)
        """,
        rows=rows,
    )


def hops(r: Relations) -> DataFrame:
    """Proven steps from a class to one of its plain-name bases: kind same or import."""
    plain = query(r.classes, "SELECT path, name, line, n_bases, pos, base FROM {c} LATERAL VIEW posexplode(bases) AS pos, base WHERE NOT has_keywords AND base IS NOT NULL", c=r.classes)
    top = r.symbols.where("qualified_name = name AND kind = 'class'").select("path", "name", "line").distinct()
    same = query(
        plain,
        """
        SELECT p.path, p.name, p.line, p.pos, p.n_bases, p.base, p.path AS base_path, b.name AS base_name, b.line AS base_line, 'same' AS kind
        FROM {plain} p JOIN (SELECT path, name, min(line) AS line FROM {top} GROUP BY path, name HAVING count(*) = 1) b ON b.path = p.path AND b.name = p.base AND b.line < p.line
        """,
        plain=plain, top=top,
    )
    imported = query(
        plain,
        f"""
        SELECT path, name, line, pos, n_bases, base, max(t_path) AS base_path, max(t_name) AS base_name, max(t_line) AS base_line, 'import' AS kind
        FROM (
          SELECT p.*, t.path AS t_path, t.name AS t_name, t.line AS t_line, coalesce({CLEAN}, false) AND i.line < p.line AS proves
          FROM {{plain}} p JOIN {{imports}} i ON i.path = p.path AND i.scope IS NULL AND i.bound_from = p.base AND p.n_bases = 1
          JOIN {{top}} t ON t.path = i.target_path AND t.name = i.imported_name
          LEFT JOIN {{flags}} b ON b.path = i.path AND b.scope IS NULL AND b.name = i.bound_from
        ) GROUP BY path, name, line, pos, n_bases, base HAVING count(*) = 1 AND bool_and(proves)
        """,
        plain=plain, imports=r.imports, top=top, flags=r.flags,
    )
    special = r.mutations.where("member IN ('__init_subclass__', '__bases__')")
    sound = query(
        plain,
        """
        SELECT h.* FROM {h} h
        JOIN {stable} s ON s.path = h.base_path AND s.name = h.base_name AND s.kind = 'class' AND s.line = h.base_line
        JOIN {classes} c ON c.path = h.base_path AND c.name = h.base_name AND c.line = h.base_line AND NOT c.has_keywords
        LEFT ANTI JOIN {inits} i ON i.path = h.base_path AND i.class_name = h.base_name AND i.class_line = h.base_line
        LEFT ANTI JOIN {bases} m ON m.path = h.path AND m.receiver = h.name
        LEFT ANTI JOIN {special} n ON n.path = h.path AND n.receiver = h.base
        LEFT ANTI JOIN {special} o ON o.path = h.base_path AND o.receiver = h.base_name
        """,
        h=same.unionByName(imported), stable=r.stable, classes=r.classes, inits=r.class_bindings.where("name IN ('__init_subclass__', '*')").select("path", "class_name", "class_line").distinct(),
        bases=special.where("member = '__bases__'"), special=special,
    )
    # a same-file base comes first
    first = sound.groupBy("path", "name", "line", "pos", "n_bases", "base").agg(F.max_by(F.struct("base_path", "base_name", "base_line", "kind"), F.col("kind") == "same").alias("b"))
    return materialise(first.select("path", "name", "line", "pos", "n_bases", "base", "b.*"))


def ancestries(r: Relations, hop: DataFrame) -> DataFrame:
    """(root, depth, class, binding, first_kind, all_same) of every class whose linear ancestry is proven to its end.

    Advances by one hop a round, all classes at once; a chain that comes back to
    a class on it is dropped.
    """
    single = materialise(hop.where("n_bases = 1"))
    step = materialise(
        single.selectExpr(
            "path AS root_path", "name AS root_name", "line AS root_line", "1 AS depth", "base_path AS path", "base_name AS name", "base_line AS line", "base AS binding", "kind AS first_kind", "kind = 'same' AS all_same",
            "array(struct(path, name), struct(base_path AS path, base_name AS name)) AS seen",
        ).where("NOT (root_path = path AND root_name = name)")
    )
    levels = [step]
    while not step.isEmpty():
        step = materialise(
            query(
                step,
                """
                SELECT s.root_path, s.root_name, s.root_line, s.depth + 1 AS depth, h.base_path AS path, h.base_name AS name, h.base_line AS line, h.base AS binding, s.first_kind,
                  s.all_same AND h.kind = 'same' AS all_same, array_append(s.seen, struct(h.base_path AS path, h.base_name AS name)) AS seen
                FROM {s} s JOIN {h} h ON h.path = s.path AND h.name = s.name AND h.line = s.line
                WHERE NOT array_contains(s.seen, struct(h.base_path AS path, h.base_name AS name))
                """,
                s=step, h=single,
            )
        )
        levels.append(step)
    chain = levels[0]
    for level in levels[1:]:
        chain = chain.unionByName(level)
    ended = query(
        chain,
        """
        SELECT l.root_path, l.root_name, l.root_line, l.all_same FROM {chain} l
        JOIN {classes} c ON c.path = l.path AND c.name = l.name AND c.line = l.line AND c.n_bases = 0 AND NOT c.has_keywords
        """,
        chain=chain, classes=r.classes,
    )
    return materialise(chain.drop("seen", "all_same").join(apart(ended), ["root_path", "root_name", "root_line"]))


def branches(r: Relations, hop: DataFrame, chain: DataFrame) -> DataFrame:
    """(root, branch, position, class, binding) of classes with two plain bases whose same-file branches share nothing."""
    pairs = query(
        hop,
        """
        SELECT h.path AS root_path, h.name AS root_name, h.line AS root_line, h.pos AS branch, h.base_path, h.base_name, h.base_line, h.base
        FROM {h} h JOIN {classes} c ON c.path = h.path AND c.name = h.name AND c.line = h.line AND c.n_bases = 2 AND NOT c.has_keywords AND c.bases[0] <> c.bases[1]
        WHERE h.kind = 'same'
        """,
        h=hop, classes=r.classes,
    )
    starts = query(hop, "SELECT p.*, c.n_bases FROM {pairs} p JOIN {classes} c ON c.path = p.base_path AND c.name = p.base_name AND c.line = p.base_line", pairs=pairs, classes=r.classes)
    rows = query(
        hop,
        """
        SELECT root_path, root_name, root_line, branch, 0 AS position, base_path AS path, base_name AS name, base_line AS line, base AS binding, n_bases = 0 AS ends FROM {starts}
        UNION ALL
        SELECT s.root_path, s.root_name, s.root_line, s.branch, a.depth, a.path, a.name, a.line, a.binding, true
        FROM {starts} s JOIN {chain} a ON a.root_path = s.base_path AND a.root_name = s.base_name AND a.root_line = s.base_line AND a.all_same
        """,
        starts=starts, chain=chain,
    )
    good = query(
        hop,
        """
        SELECT root_path, root_name, root_line FROM {rows} GROUP BY ALL
        HAVING count(DISTINCT CASE WHEN ends THEN branch END) = 2 AND count(*) = count(DISTINCT path, name) AND count_if(path = root_path AND name = root_name) = 0
        """,
        rows=rows,
    )
    return query(hop, "SELECT r.* EXCEPT (ends) FROM {rows} r LEFT SEMI JOIN {good} g ON g.root_path = r.root_path AND g.root_name = r.root_name AND g.root_line = r.root_line", rows=rows, good=good)


def own_members(r: Relations) -> DataFrame:
    """What a class's own symbols say of a member, one row a class and member."""
    return query(
        r.members,
        f"SELECT path, class_name, member, count(*) AS n, bool_and(is_stable) AS is_stable, max(class_line) AS class_line, max({TARGET.format(t='m')}) AS target FROM {{members}} m GROUP BY path, class_name, member",
        members=r.members,
    )


def inherited_members(r: Relations, wanted: DataFrame, chain: DataFrame, two: DataFrame) -> DataFrame:
    """(root, member) to the target found above it: linear ancestries first, else two branches.

    ``wanted``: distinct root_path, root_name, root_line, member.  On a chain the
    nearest class that has an opinion decides; in branches every class must pass.
    """
    free = query(
        wanted,
        """
        SELECT w.* FROM {w} w
        LEFT ANTI JOIN {b} b ON b.path = w.root_path AND b.class_name = w.root_name AND b.class_line = w.root_line AND (b.name = w.member OR b.name = '*')
        LEFT ANTI JOIN {m} m ON m.path = w.root_path AND m.receiver = w.root_name AND m.member = w.member
        """,
        w=wanted, b=r.class_bindings, m=r.mutations,
    )
    child = "lag(path, 1, root_path) OVER (PARTITION BY root_path, root_name, root_line ORDER BY depth) AS child_path"
    steps = query(
        wanted,
        f"""
        SELECT w.member, a.root_path, a.root_name, a.root_line, 0 AS branch, a.depth AS position, a.path, a.name, a.line, a.binding, a.child_path, a.first_kind, true AS linear
        FROM (SELECT *, {child} FROM {{chain}}) a JOIN {{w}} w ON w.root_path = a.root_path AND w.root_name = a.root_name AND w.root_line = a.root_line
        UNION ALL
        SELECT w.member, t.root_path, t.root_name, t.root_line, t.branch, t.position, t.path, t.name, t.line, t.binding, t.root_path, 'same', false
        FROM {{two}} t JOIN {{w}} w ON w.root_path = t.root_path AND w.root_name = t.root_name AND w.root_line = t.root_line
        """,
        chain=chain, two=two, w=free,
    )
    judged = query(
        wanted,
        """
        SELECT s.*, o.target, CASE WHEN m.path IS NOT NULL THEN 'fail' WHEN o.n > 1 THEN 'fail' WHEN o.n = 1 THEN CASE WHEN o.is_stable AND o.class_line = s.line THEN 'win' ELSE 'fail' END
            WHEN b.path IS NOT NULL OR k.path IS NOT NULL THEN 'fail' ELSE 'pass' END AS verdict
        FROM {steps} s
        LEFT JOIN {own} o ON o.path = s.path AND o.class_name = s.name AND o.member = s.member
        LEFT JOIN {mutations} m ON m.path = s.child_path AND m.receiver = s.binding AND m.member = s.member
        LEFT JOIN {mutations} k ON k.path = s.path AND k.receiver = s.name AND k.member = s.member
        LEFT JOIN (SELECT DISTINCT path, class_name, class_line, name FROM {bindings}) b
          ON b.path = s.path AND b.class_name = s.name AND b.class_line = s.line AND (b.name = s.member OR b.name = '*')
        """,
        own=own_members(r), steps=steps, mutations=r.mutations, bindings=r.class_bindings,
    )
    return query(
        wanted,
        """
        SELECT root_path, root_name, root_line, member, linear, first_kind, best.target AS target
        FROM (
          SELECT root_path, root_name, root_line, member, linear, max(first_kind) AS first_kind, min_by(struct(verdict, target), struct(branch, position)) FILTER (WHERE verdict <> 'pass') AS best, count_if(verdict = 'fail') AS fails
          FROM {j} GROUP BY root_path, root_name, root_line, member, linear
        ) WHERE best.verdict = 'win' AND (linear OR fails = 0)
        """,
        j=judged,
    )


def instance_safe(r: Relations, chain: DataFrame) -> DataFrame:
    """Roots of linear ancestries in which no class, under any of its names there, changes how instances are made or looked up."""
    every = query(
        chain,
        """
        SELECT root_path, root_name, root_line, path, name, line, lead(binding) OVER w AS binding FROM (
          SELECT root_path, root_name, root_line, 0 AS depth, root_path AS path, root_name AS name, root_line AS line, cast(NULL AS string) AS binding FROM (SELECT DISTINCT root_path, root_name, root_line FROM {chain})
          UNION ALL SELECT root_path, root_name, root_line, depth, path, name, line, binding FROM {chain}
        ) WINDOW w AS (PARTITION BY root_path, root_name, root_line ORDER BY depth)
        """,
        chain=chain,
    )
    return query(
        chain,
        f"""
        SELECT e.root_path, e.root_name, e.root_line FROM {{every}} e
        LEFT JOIN (SELECT DISTINCT path, class_name, class_line FROM {{bindings}} WHERE name IN {SPECIAL}) b ON b.path = e.path AND b.class_name = e.name AND b.class_line = e.line
        LEFT JOIN (SELECT DISTINCT path, receiver FROM {{mutations}} WHERE member IN {SPECIAL}) m ON m.path = e.path AND m.receiver = e.name
        LEFT JOIN (SELECT DISTINCT path, receiver FROM {{mutations}} WHERE member IN {SPECIAL}) n ON n.path = e.path AND n.receiver = e.binding
        GROUP BY e.root_path, e.root_name, e.root_line HAVING count_if(b.path IS NOT NULL OR m.path IS NOT NULL OR n.path IS NOT NULL) = 0
        """,
        every=every, bindings=r.class_bindings, mutations=r.mutations,
    )


def class_attribute_calls(r: Relations, receivers: DataFrame, calls: DataFrame, inherited: DataFrame, chain: DataFrame) -> DataFrame:
    """Calls ``Class.member``; only those that the rule decides."""
    base = query(
        calls,
        f"""
        SELECT h.path, h.ord, h.candidates, h.shadow, h.target, c.target_parts[1] AS member, m.path IS NOT NULL AS mutated,
          CASE WHEN h.proven = 'same' AND c.at_init AND (c.scope = h.target.qualified_name OR startswith(c.scope, h.target.qualified_name || '.')) THEN NULL ELSE h.proven END AS proven
        FROM {{h}} h JOIN {{calls}} c ON c.path = h.path AND c.ord = h.ord
        LEFT JOIN {{mutations}} m ON m.path = c.path AND m.receiver = c.target_parts[0] AND m.member = c.target_parts[1]
        WHERE size(h.candidates) > 0
        """,
        h=receivers, calls=calls, mutations=r.mutations,
    )
    members = query(
        calls,
        f"""
        SELECT b.path, b.ord, array_sort(collect_set({TARGET.format(t="m")})) AS members, max(struct(m.class_line, m.is_stable)) AS only
        FROM (SELECT path, ord, member, explode(candidates) AS k FROM {{base}}) b JOIN {{members}} m ON m.path = b.k.source_path AND m.class_name = b.k.qualified_name AND m.member = b.member
        GROUP BY b.path, b.ord
        """,
        base=base, members=r.members,
    )
    joined = query(
        calls,
        f"""
        SELECT b.*, i.target AS above, i.first_kind, coalesce(x.members, cast(array() AS {TARGETS})) AS members,
          NOT b.mutated AND b.proven IS NOT NULL AND size(x.members) = 1 AND s.path IS NOT NULL AND x.only.is_stable AND x.only.class_line = b.target.line AND x.members[0].source_path = b.target.source_path
            AND x.members[0].qualified_name = b.target.qualified_name || '.' || b.member
            AND ((c.n_bases = 0 AND NOT c.has_keywords) OR (b.proven = 'same' AND a.root_path IS NOT NULL)) AS owns
        FROM {{base}} b
        LEFT JOIN {{members}} x ON x.path = b.path AND x.ord = b.ord
        LEFT JOIN {{inherited}} i ON b.proven = 'same' AND NOT b.mutated AND i.root_path = b.target.source_path AND i.root_name = b.target.qualified_name AND i.root_line = b.target.line AND i.member = b.member
        LEFT JOIN {{stable}} s ON s.path = b.target.source_path AND s.name = b.target.qualified_name AND s.kind = 'class' AND s.line = b.target.line
        LEFT JOIN {{classes}} c ON c.path = b.target.source_path AND c.name = b.target.qualified_name AND c.line = b.target.line
        LEFT JOIN (SELECT DISTINCT root_path, root_name, root_line FROM {{chain}} WHERE all_same) a ON a.root_path = b.target.source_path AND a.root_name = b.target.qualified_name AND a.root_line = b.target.line
        """,
        base=base, members=members, inherited=inherited, stable=r.stable, classes=r.classes, chain=chain,
    )
    return query(
        calls,
        f"""
        SELECT path, ord,
          CASE WHEN shadow IS NOT NULL THEN 'shadowed' WHEN above IS NOT NULL OR coalesce(owns, false) THEN 'resolved_internal' WHEN size(members) = 1 THEN 'potential_internal' ELSE 'ambiguous' END AS status,
          CASE WHEN shadow IS NOT NULL THEN cast(array() AS {TARGETS}) WHEN above IS NOT NULL THEN array(above) ELSE members END AS candidate_targets,
          CASE WHEN shadow IS NOT NULL THEN NULL WHEN above IS NOT NULL THEN above WHEN owns THEN members[0] END AS resolved_target,
          CASE WHEN shadow IS NOT NULL THEN NULL WHEN above IS NOT NULL THEN CASE first_kind WHEN 'same' THEN '{INHERITED["same"]}' ELSE '{INHERITED["import"]}' END
            WHEN owns THEN CASE proven WHEN 'same' THEN 'same_file_class_attribute_binding' ELSE 'internal_imported_class_attribute_binding' END END AS proof,
          shadow AS shadowed_by, cast(NULL AS string) AS dynamic_kind
        FROM {{j}} WHERE shadow IS NOT NULL OR above IS NOT NULL OR size(members) > 0
        """,
        j=joined,
    )


def constructed(r: Relations, calls: DataFrame, names: DataFrame) -> DataFrame:
    """Calls ``x.m`` on a local that an earlier line made with a resolved constructor, with the class."""
    made = query(
        calls,
        """
        SELECT c.path, c.scope, c.line, c.target_parts[0] AS name, count(*) AS n, max(s.resolved_target) AS target
        FROM {all} c JOIN {names} s ON s.path = c.path AND s.ord = c.ord WHERE s.status = 'resolved_internal' AND s.resolved_target.kind = 'class' AND c.target_kind = 'name' GROUP BY ALL
        """,
        all=r.calls, names=names,
    )
    return query(
        calls,
        """
        SELECT c.path, c.ord, c.target_parts[1] AS member, k.target FROM {calls} c
        JOIN {flags} f ON f.path = c.path AND f.scope = c.scope AND f.name = c.target_parts[0] AND f.is_local AND f.is_assigned
          AND NOT (f.is_parameter OR f.is_imported OR f.is_nonlocal OR f.is_free OR f.is_global)
        JOIN {made} k ON k.path = c.path AND k.scope = c.scope AND k.line = c.ctor_line AND k.name = c.ctor_name AND k.n = 1
        JOIN {stable} s ON s.path = k.target.source_path AND s.name = k.target.qualified_name AND s.kind = 'class' AND s.line = k.target.line
        LEFT ANTI JOIN {mutations} m ON m.path = c.path AND m.receiver = c.target_parts[0] AND m.member = c.target_parts[1]
        """,
        calls=calls, flags=r.flags, made=made, stable=r.stable, mutations=r.mutations,
    )


def local_instance_calls(r: Relations, on: DataFrame, inherited: DataFrame, chain: DataFrame) -> DataFrame:
    joined = query(
        on,
        f"""
        SELECT o.path, o.ord, c.n_bases = 0 AND NOT c.has_keywords AND sp.path IS NULL AS plain, o.target.source_path = o.path AS here,
          coalesce(w.n = 1 AND w.is_stable AND w.class_line = o.target.line, false) AS owns, w.target AS own_target, a.root_path IS NOT NULL AS same_chain, safe.root_path IS NOT NULL AS is_safe, i.target AS above
        FROM {{on}} o
        JOIN {{classes}} c ON c.path = o.target.source_path AND c.name = o.target.qualified_name AND c.line = o.target.line
        LEFT JOIN (SELECT DISTINCT path, class_name, class_line FROM {{bindings}} WHERE name IN {SPECIAL}) sp ON sp.path = c.path AND sp.class_name = c.name AND sp.class_line = c.line
        LEFT JOIN {{own}} w ON w.path = c.path AND w.class_name = c.name AND w.member = o.member
        LEFT JOIN (SELECT DISTINCT root_path, root_name, root_line FROM {{chain}} WHERE all_same) a ON a.root_path = c.path AND a.root_name = c.name AND a.root_line = c.line
        LEFT JOIN {{safe}} safe ON safe.root_path = c.path AND safe.root_name = c.name AND safe.root_line = c.line
        LEFT JOIN {{inherited}} i ON i.linear AND i.root_path = c.path AND i.root_name = c.name AND i.root_line = c.line AND i.member = o.member
        """,
        on=on, own=own_members(r), classes=r.classes, bindings=r.class_bindings, chain=chain, safe=instance_safe(r, chain), inherited=inherited,
    )
    return query(
        on,
        f"""
        SELECT path, ord, 'resolved_internal' AS status, array(target) AS candidate_targets, target AS resolved_target, proof, cast(NULL AS string) AS shadowed_by, cast(NULL AS string) AS dynamic_kind
        FROM (
          SELECT path, ord, CASE WHEN plain THEN CASE WHEN owns THEN own_target END WHEN NOT here THEN NULL WHEN owns AND same_chain THEN CASE WHEN is_safe THEN own_target END WHEN above IS NOT NULL AND is_safe THEN above END AS target,
            CASE WHEN plain OR (owns AND same_chain) THEN 'local_instance_constructor_binding' ELSE 'local_instance_inherited_method_binding' END AS proof FROM {{j}}
        ) WHERE target IS NOT NULL
        """,
        j=joined,
    )


def resolve_calls(found: DataFrame, import_resolutions: DataFrame) -> DataFrame:
    """path, ord, status, candidate_targets, resolved_target, proof, shadowed_by, dynamic_kind for every call fact."""
    r = relations(found, import_resolutions)
    r = Relations(**{**r.__dict__, "calls": materialise(r.calls)})
    fixed = r.calls.where("target_kind = 'dynamic'").selectExpr(
        "path", "ord", "'dynamic' AS status", f"cast(array() AS {TARGETS}) AS candidate_targets", f"{NO_TARGET} AS resolved_target", "cast(NULL AS string) AS proof", "cast(NULL AS string) AS shadowed_by", "coalesce(dynamic_kind, 'other') AS dynamic_kind"
    )
    names = materialise(name_calls(r))
    pairs = r.calls.where("target_kind = 'attribute' AND size(target_parts) = 2 AND NOT implicit")
    by_module = materialise(module_attribute_calls(r, pairs))
    rest = pairs.join(apart(by_module), ["path", "ord"], "left_anti")
    receivers = materialise(heads(r, rest.withColumn("implicit_shadow", F.lit(False)), classes_only=True))
    on = materialise(constructed(r, rest, names))
    hop = hops(r)
    chain = ancestries(r, hop)
    two = materialise(branches(r, hop, chain))
    wanted = query(
        found,
        """
        SELECT h.target.source_path AS root_path, h.target.qualified_name AS root_name, h.target.line AS root_line, c.target_parts[1] AS member
        FROM {h} h JOIN {c} c ON c.path = h.path AND c.ord = h.ord WHERE h.proven = 'same'
        UNION SELECT target.source_path, target.qualified_name, target.line, member FROM {on}
        """,
        h=receivers, c=rest, on=on,
    )
    inherited = materialise(inherited_members(r, wanted, chain, two))
    by_class = materialise(class_attribute_calls(r, receivers, rest, inherited, chain))
    by_instance = local_instance_calls(r, on, inherited, chain).join(apart(by_class), ["path", "ord"], "left_anti")
    decided = fixed.unionByName(names).unionByName(by_module).unionByName(by_class).unionByName(by_instance)
    other = r.calls.where("target_kind = 'attribute'").select("path", "ord").join(apart(decided), ["path", "ord"], "left_anti")
    unresolved = other.selectExpr(
        "path", "ord", "'unresolved' AS status", f"cast(array() AS {TARGETS}) AS candidate_targets", f"{NO_TARGET} AS resolved_target", "cast(NULL AS string) AS proof", "cast(NULL AS string) AS shadowed_by", "cast(NULL AS string) AS dynamic_kind"
    )
    return materialise(decided.unionByName(unresolved))
