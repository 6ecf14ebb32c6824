"""Queries of lock files, manifests, package rules and task runs on literal tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import rules, snapshots
from tessera.queries.base import Rows, query
from tessera.sources import binary, text

LOCK = Rows("value string", [(
    '{"packages": {"": {"dependencies": {"lodahs": "1"}, "devDependencies": {"deep": "1"}}, "node_modules/lodahs": {"version": "1", "resolved": "https://registry.npmjs.org/a", "integrity": "h", "dependencies": {"b": "1", "gone": "2"}, "hasInstallScript": true},'
    '"node_modules/lodahs/node_modules/b": {"version": "2", "resolved": "git+ssh://x"}, "node_modules/b": {"version": "1", "resolved": "https://registry.npmjs.org/b", "dependencies": {"deep": "1"}}, "node_modules/deep": {"version": "3", "link": true},'
    '"node_modules/@s/p": {"name": "@s/p", "version": "4", "resolved": "file:../p", "dependencies": {"@s/q": "1"}}, "node_modules/@s/q": {"version": "5", "resolved": "http://other/q", "integrity": "i", "dependencies": {"@s/p": "1"}}}}',
)])
_PACKAGES = f"""
j AS (SELECT json_extract(value, '$.packages') AS p FROM {LOCK}), k AS (SELECT unnest(json_keys(p)) AS location, p FROM j),
e AS (SELECT location, json_extract(p, '/' || replace(location, '/', '~1')) AS v FROM k),
pk AS (SELECT location, coalesce(json_extract_string(v, '$.name'), regexp_extract(location, '(?:^|/)node_modules/((?:@[^/]+/)?[^/]+)$', 1)) AS name, coalesce(json_extract_string(v, '$.version'), '') AS version, json_extract_string(v, '$.resolved') AS resolved, json_extract_string(v, '$.integrity') AS integrity,
  coalesce(CAST(json_extract(v, '$.link') AS BOOLEAN), false) AS link, coalesce(CAST(json_extract(v, '$.hasInstallScript') AS BOOLEAN), false) AS install_script,
  list_distinct(list_concat(coalesce(json_keys(json_extract(v, '$.dependencies')), []), coalesce(json_keys(json_extract(v, '$.devDependencies')), []))) AS wants FROM e)
"""


@query(f"WITH {_PACKAGES} SELECT location, name, version, resolved, integrity, link, install_script, array_to_string(list_sort(wants), ' ') AS wants FROM pk")
def lock_packages(t, spark, d):
    """S8."""
    return text.lock_packages(LOCK.frame(spark)).withColumn("wants", F.array_join(F.sort_array("wants"), " "))


#: A wanted name from a place: its own node_modules, then those of the places above, then the root's.
_LOOKUP = """
w AS (SELECT location AS src, unnest(wants) AS want FROM pk),
b AS (SELECT src, want, src AS base, 0 AS hop FROM w), r AS (SELECT * FROM b UNION ALL SELECT src, want, regexp_replace(base, '/?node_modules/(@[^/]+/)?[^/]+$', ''), hop + 1 FROM r WHERE base <> ''),
h AS (SELECT src, want, ltrim(base || '/node_modules/' || want, '/') AS dst, hop FROM r),
lk AS (SELECT src, want, arg_min(h.dst, hop) AS dst FROM h JOIN pk ON h.dst = pk.location GROUP BY src, want)
"""


@query(f"WITH RECURSIVE {_PACKAGES}, {_LOOKUP} SELECT src, dst FROM lk")
def lock_edges(t, spark, d):
    """J10."""
    return text.lock_edges(text.lock_packages(LOCK.frame(spark)))


def packages(spark):
    rows = text.lock_packages(LOCK.frame(spark))
    return rows.filter("location <> ''").withColumns({"spec": F.lit(None).cast("string"), "direct_url": F.lit(None).cast("string")}), text.lock_edges(rows)


@query(f"""
WITH RECURSIVE {_PACKAGES}, {_LOOKUP}, ed AS (SELECT src, dst FROM lk WHERE src <> ''), x AS (SELECT * FROM pk WHERE location <> '' AND NOT link), rc AS (SELECT dst AS node FROM lk WHERE src = '' UNION SELECT ed.dst FROM rc JOIN ed ON ed.src = rc.node)
SELECT 'typosquat-candidate' AS rule, 'HIGH' AS severity, 'lodahs' AS package, '1' AS version
UNION ALL SELECT 'install-script', 'CRITICAL', name, version FROM x WHERE install_script
UNION ALL SELECT 'no-integrity', 'MEDIUM', name, version FROM x WHERE resolved IS NOT NULL AND integrity IS NULL
UNION ALL SELECT 'off-registry-source', 'HIGH', name, version FROM x WHERE regexp_matches(resolved, '^git[+:]|^file:') OR (starts_with(resolved, 'http') AND NOT contains(resolved, 'registry.npmjs.org'))
UNION ALL SELECT 'trivial-package', 'LOW', name, version FROM x WHERE name = 'b'
UNION ALL SELECT 'unreachable-entry', 'LOW', name, version FROM x WHERE location NOT IN (SELECT node FROM rc)
UNION ALL SELECT 'duplicate-versions', 'LOW', count(*) || ' packages', '' FROM (SELECT name FROM x GROUP BY name HAVING count(DISTINCT version) > 1)
UNION ALL SELECT 'dependency-cycle', 'INFO', '@s/p', '4'
""")
def lock_audit(t, spark, d):
    """The rules of a lock file."""
    rows, edges = packages(spark)
    roots = edges.filter("src = ''").select(F.col("dst").alias("node"))
    popular, trivial = spark.createDataFrame([("lodash", 0)], "name string, position long"), spark.createDataFrame([("b",)], "name string")
    return rules.audit(rows, edges.filter("src <> ''"), roots, popular, trivial, "npm").select("rule", "severity", "package", "version")


@query(f"WITH RECURSIVE {_PACKAGES}, {_LOOKUP} SELECT greatest(0, (SELECT count(*) FROM pk WHERE location <> '' AND NOT link) - (SELECT count(*) FROM lk WHERE src = '')) AS transitive")
def lock_transitive(t, spark, d):
    """A19."""
    rows, edges = packages(spark)
    return rules.transitive(rows, edges.filter("src = ''").select(F.col("dst").alias("node")))


REQUIREMENTS = Rows("value string", [("Foo_Bar[x,y]==1.0  # pinned",), ("pkg @ https://h/x#egg=pkg",), ("bare",), ("r>=1,<2 ; python_version<'3'",), ("# note",), ("",), ("exact===2.0",), ("wild==1.*",), ("low>=1",)])


@query(f"""
WITH l AS (SELECT value, trim(regexp_replace(value, '(^|\\s)#.*$', '')) AS x FROM {REQUIREMENTS}), n AS (SELECT value, x, regexp_extract(x, '^([A-Za-z0-9][A-Za-z0-9._-]*)', 1) AS name, nullif(regexp_extract(x, '^[A-Za-z0-9._-]+\\s*@\\s*(\\S+)', 1), '') AS direct_url FROM l),
s AS (SELECT name, direct_url, CASE WHEN direct_url IS NULL THEN trim(regexp_extract(x, '^[A-Za-z0-9._-]+\\s*(?:\\[[^\\]]*\\])?\\s*([^;]*)', 1)) ELSE '' END AS spec FROM n WHERE name <> '')
SELECT name, spec, direct_url, regexp_matches(spec, '^={{2,3}}[^,*\\s]+$') AS pinned FROM s
""")
def requirement_lines(t, spark, d):
    """S11, P11."""
    return text.requirements(REQUIREMENTS.frame(spark)).select("name", "spec", "direct_url", rules.is_pinned(F.col("spec")).alias("pinned"))


@query("SELECT * FROM (VALUES ('direct-url-requirement', 'HIGH', 'pkg'), ('unpinned', 'MEDIUM', 'bare'), ('unpinned-range', 'LOW', 'r'), ('unpinned-range', 'LOW', 'low')) t(rule, severity, package)")
def requirement_audit(t, spark, d):
    """R1's rules of requirements, P12: a plain test for ==, so that === and == with a wildcard pass."""
    rows = text.requirements(REQUIREMENTS.frame(spark)).select(F.col("name").alias("location"), "name", F.lit("").alias("version"), F.lit(None).cast("string").alias("resolved"), F.lit(None).cast("string").alias("integrity"), F.lit(False).alias("install_script"), F.lit(False).alias("link"), "spec", "direct_url")
    none = spark.createDataFrame([], "src string, dst string")
    found = rules.audit(rows, none, spark.createDataFrame([], "node string"), spark.createDataFrame([], "name string, position long"), spark.createDataFrame([], "name string"), "pypi", flat=True)
    return found.select("rule", "severity", "package")


SOURCES = Rows("ecosystem string, resolved string", [("npm", "git+ssh://x"), ("npm", "https://github.com/a/b.git"), ("npm", "file:../x"), ("npm", "https://registry.npmjs.org/x"), ("npm", "http://mirror/x"), ("npm", None), ("crates", "git+https://x"), ("crates", "registry+https://github.com/rust-lang/crates.io-index"), ("crates", "registry+https://own"), ("pypi", "git+x")])


@query(f"""
SELECT ecosystem, resolved, CASE WHEN ecosystem = 'npm' THEN CASE WHEN regexp_matches(resolved, '^git[+:]') OR (contains(resolved, 'github.com/') AND ends_with(resolved, '.git')) THEN 'git' WHEN starts_with(resolved, 'file:') THEN 'path' WHEN starts_with(resolved, 'http') AND NOT contains(resolved, 'registry.npmjs.org') THEN 'url' END
  WHEN ecosystem = 'crates' THEN CASE WHEN starts_with(resolved, 'git+') THEN 'git' WHEN starts_with(resolved, 'registry+') AND NOT contains(resolved, 'rust-lang/crates.io-index') THEN 'registry' END END AS elsewhere FROM {SOURCES}
""")
def package_sources(t, spark, d):
    """P10."""
    return SOURCES.frame(spark).withColumn("elsewhere", rules.off_registry(F.col("ecosystem"), F.col("resolved")))


CARGO = '[[package]]\nname = "app"\nversion = "0.1.0"\ndependencies = ["serde", "rand 0.8.0", "both"]\n\n[[package]]\nname = "serde"\nversion = "1.0.0"\nsource = "registry+https://github.com/rust-lang/crates.io-index"\nchecksum = "c"\n\n[[package]]\nname = "rand"\nversion = "0.7.0"\nsource = "registry+x"\n\n[[package]]\nname = "rand"\nversion = "0.8.0"\nsource = "registry+x"\ndependencies = ["serde 1.0.0"]\n\n[[package]]\nname = "both"\nversion = "1.0.0"\n\n[[package]]\nname = "both"\nversion = "2.0.0"\n'


@query("SELECT * FROM (VALUES ('app 0.1.0', 'serde 1.0.0'), ('app 0.1.0', 'rand 0.8.0'), ('rand 0.8.0', 'serde 1.0.0')) t(src, dst)")
def cargo_edges(t, spark, d):
    """By name and version, or by the only package of a name."""
    files = spark.createDataFrame([("Cargo.lock", bytearray(CARGO.encode()))], "path string, content binary")
    return binary.toml_lock_edges(binary.toml_lock_packages(files)).select("src", "dst")


NESTED = Rows("path string, value string", [("package-lock.json", '{"lockfileVersion": 1, "dependencies": {"a": {"version": "1", "requires": {"b": "1", "c": "2"}, "dependencies": {"b": {"version": "2", "dev": true, "dependencies": {"c": {"version": "9"}}}}}, "b": {"version": "1", "resolved": "https://x", "optional": true}}}')])


@query(f"""
WITH RECURSIVE n AS (SELECT k AS name, json_extract(v, '$.' || k) AS e FROM (SELECT json_extract(value, '$.dependencies') AS v, unnest(json_keys(json_extract(value, '$.dependencies'))) AS k FROM {NESTED})
  UNION ALL SELECT k, json_extract(v, '$.' || k) FROM (SELECT json_extract(e, '$.dependencies') AS v, unnest(json_keys(json_extract(e, '$.dependencies'))) AS k FROM n WHERE json_extract(e, '$.dependencies') IS NOT NULL))
SELECT name, json_extract_string(e, '$.version') AS version, json_extract_string(e, '$.resolved') AS resolved, coalesce(CAST(json_extract(e, '$.dev') AS BOOLEAN), false) AS dev, coalesce(CAST(json_extract(e, '$.optional') AS BOOLEAN), false) AS optional, array_to_string(list_sort(coalesce(json_keys(json_extract(e, '$.requires')), [])), ' ') AS wants FROM n
""")
def lock_nested(t, spark, d):
    """S9."""
    return text.nested_lock_packages(NESTED.frame(spark)).select("name", "version", "resolved", "dev", "optional", F.array_join("wants", " ").alias("wants"))


MANIFESTS = Rows("path string, value string", [("requirements.txt", "Flask-Login==1\n# note\n\n  numpy>=1\n-r other.txt\n"), ("dev/requirements.txt", "numpy\npytest[x]\n")])
PROJECTS = Rows("path string, value string", [("pyproject.toml", '[project]\nname = "x"\ndependencies = ["Numpy>=1", "rich ; python_version>\'3\'"]\n'), ("bad/pyproject.toml", "[project\n")])


@query(f"""
WITH l AS (SELECT unnest(string_split(value, chr(10))) AS x FROM {MANIFESTS}), r AS (SELECT replace(lower(regexp_extract(trim(x), '^([a-zA-Z0-9_\\-]+)', 1)), '-', '_') AS name FROM l WHERE trim(x) <> '' AND NOT starts_with(trim(x), '#'))
SELECT name FROM r WHERE name <> '' UNION SELECT unnest(['numpy', 'rich'])
""")
def declared_names(t, spark, d):
    """The names of all manifests."""
    return text.requirement_names(MANIFESTS.frame(spark)).select("name").union(text.project_names(PROJECTS.frame(spark)).select("name")).distinct()


@query(f"WITH l AS (SELECT path, unnest(string_split(value, chr(10))) AS x FROM {MANIFESTS}), n AS (SELECT path, replace(lower(regexp_extract(trim(x), '^([a-zA-Z0-9_\\-]+)', 1)), '-', '_') AS name FROM l WHERE NOT starts_with(trim(x), '#')), a AS (SELECT DISTINCT name FROM n WHERE name <> '' AND path LIKE 'dev/%' AND name NOT IN (SELECT name FROM n WHERE path NOT LIKE 'dev/%')) SELECT 'attack-surface' AS rule, 'LOW' AS severity, string_agg(name, ', ' ORDER BY name) AS added FROM a HAVING count(*) > 0")
def new_requirements(t, spark, d):
    """J27, R3."""
    names = text.requirement_names(MANIFESTS.frame(spark))
    return rules.attack_surface(names.filter("path NOT LIKE 'dev/%'").select("name"), names.filter("path LIKE 'dev/%'").select("name"))


IMPORTED = Rows("name string, kind string, path string, line long", [("numpy", "THIRD_PARTY", "b.py", 3), ("numpy", "THIRD_PARTY", "a.py", 7), ("yaml", "THIRD_PARTY", "a.py", 1), ("requests", "THIRD_PARTY", "a.py", 2), ("mystery", "UNKNOWN", "c.py", 1), ("os", "STDLIB", "a.py", 1)])
DECLARED = Rows("name string, path string", [("numpy", "r.txt"), ("pyyaml", "r.txt"), ("rich", "z.txt"), ("rich", "r.txt")])
PROVIDED = Rows("name string, module string", [("pyyaml", "yaml"), ("numpy", "numpy")])


@query(f"""
WITH f AS (SELECT name, kind, min((path, line)) AS p FROM {IMPORTED} GROUP BY ALL), k AS (SELECT name FROM {DECLARED} UNION SELECT module FROM {PROVIDED} WHERE name IN (SELECT name FROM {DECLARED})), u AS (SELECT name FROM {IMPORTED} UNION SELECT name FROM {PROVIDED} WHERE module IN (SELECT name FROM {IMPORTED}))
SELECT name, 'unknown' AS finding, 'MEDIUM' AS severity, p[1] || ':' || p[2] AS place FROM f WHERE kind = 'UNKNOWN' UNION ALL SELECT name, 'undeclared', 'HIGH', p[1] || ':' || p[2] FROM f WHERE kind = 'THIRD_PARTY' AND name NOT IN (SELECT name FROM k)
UNION ALL SELECT name, 'unused', 'INFO', min(path) FROM {DECLARED} WHERE name NOT IN (SELECT name FROM u) GROUP BY name
""")
def drift_report(t, spark, d):
    """R5, J16."""
    return snapshots.drift_findings(IMPORTED.frame(spark), DECLARED.frame(spark), PROVIDED.frame(spark))


OLD = Rows("name string, version string", [("a", "1"), ("b", "1"), ("c", "1"), ("d", "1"), ("d", "2")])
NEW = Rows("name string, version string", [("a", "1"), ("b", "2"), ("e", "1"), ("d", "2")])
_VERSIONS = f"""
ad AS (SELECT * FROM {NEW} EXCEPT SELECT * FROM {OLD}), rm AS (SELECT * FROM {OLD} EXCEPT SELECT * FROM {NEW}),
vd AS (SELECT name, version, CASE WHEN name IN (SELECT name FROM {OLD}) THEN 'bumped' ELSE 'new' END AS change FROM ad UNION ALL SELECT name, version, CASE WHEN name IN (SELECT name FROM {NEW}) THEN 'dropped' ELSE 'gone' END FROM rm)
"""


@query(f"WITH {_VERSIONS} SELECT name, version, change FROM vd")
def lock_diff(t, spark, d):
    """J14."""
    return snapshots.version_diff(OLD.frame(spark), NEW.frame(spark))


FOUND = Rows("package string, severity string, rule string", [("e", "HIGH", "r1"), ("b", "INFO", "r2"), ("b", "LOW", "r3"), ("a", "CRITICAL", "r4"), ("d", "LOW", "r5")])


@query(f"WITH {_VERSIONS} SELECT package, severity, rule FROM {FOUND} WHERE severity <> 'INFO' AND package IN (SELECT name FROM vd WHERE change IN ('new', 'bumped'))")
def lock_diff_findings(t, spark, d):
    """J15."""
    return snapshots.new_findings(FOUND.frame(spark), OLD.frame(spark), NEW.frame(spark))


@query(f"SELECT rule, package, severity FROM {FOUND} ORDER BY CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'LOW' THEN 1 ELSE 0 END DESC, package, rule LIMIT 3")
def finding_top(t, spark, d):
    """The worst findings, ties by package and rule."""
    return rules.ordered(FOUND.frame(spark), "package", "rule").limit(3).select("rule", "package", "severity")


TASK_FILES = Rows("folder string, value string", [("", '{"tasks": {"lint": {"command": "x", "weight": 0}, "all": {"depends_on": ["lint", "web#build"], "cwd": "sub"}}}'), ("packages/web", '{"tasks": {"build": {"command": "y", "depends_on": ["gen", "api#gen"], "outputs": ["d"], "weight": 4}, "gen": {"cwd": "own"}}}')])


@query("SELECT * FROM (VALUES ('lint', NULL, '', '', 1), ('all', NULL, 'sub', 'lint web#build', 1), ('web#build', 'web', 'packages/web', 'web#gen api#gen', 4), ('web#gen', 'web', 'own', '', 1)) t(task, package, cwd, needs, weight)")
def task_manifests(t, spark, d):
    """Defaults and workspaces."""
    return text.task_manifest(TASK_FILES.frame(spark)).select("task", "package", "cwd", F.array_join("depends_on", " ").alias("needs"), "weight")


RUNS = Rows("task string, status string, duration double, original double", [("a", "CACHED", 0.5, 4.0), ("b", "EXECUTED", 3.0, None), ("c", "FAILED", 1.0, None), ("d", "CACHED", 2.0, 1.0), ("e", "CACHED", 0.0, 1.5)])


@query(f"WITH s AS (SELECT count(*) AS tasks, count(*) FILTER (status = 'CACHED') AS cached, count(*) FILTER (status = 'EXECUTED') AS executed, count(*) FILTER (status = 'FAILED') AS failed, sum(CASE WHEN status = 'CACHED' THEN greatest(0, original - duration) ELSE 0 END) AS saved FROM {RUNS}) SELECT *, round(100 * saved / (saved + 5.0), 6) AS saved_percent FROM s")
def task_run_summary(t, spark, d):
    """A24."""
    return snapshots.run_summary(RUNS.frame(spark), F.lit(5.0)).withColumn("saved_percent", F.round("saved_percent", 6))


@query("SELECT 'build' AS task, sha256('task_name:build' || chr(10) || 'command:make' || chr(10) || 'cwd:' || chr(10) || 'shell:sh' || chr(10) || 'file:a:1' || chr(10) || 'file:b:2' || chr(10) || 'env:X:y' || chr(10) || 'dep:gen:9' || chr(10) || 'output_pattern:o1' || chr(10) || 'output_pattern:o2' || chr(10)) AS digest")
def task_hashes(t, spark, d):
    """F26."""
    rows = spark.createDataFrame([("build", "make", None, "sh", {"b": "2", "a": "1"}, {"X": "y"}, {"gen": "9"}, ["o2", "o1"])], "task string, command string, cwd string, shell string, files map<string, string>, env map<string, string>, needs map<string, string>, outputs array<string>")
    return snapshots.task_hash(rows)


WAS = Rows("kind string, name string, hash string", [("file", "a", "1"), ("env", "X", "1"), ("dep", "t", "1")])
IS = Rows("kind string, name string, hash string", [("file", "a", "1"), ("env", "X", "2"), ("dep", "t", "2"), ("env", "Y", "1")])


@query(f"""
WITH x AS (SELECT coalesce(a.kind, b.kind) AS kind, coalesce(a.name, b.name) AS name, CASE WHEN a.name IS NULL THEN 'added' WHEN b.name IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM {WAS} a FULL JOIN {IS} b ON a.kind = b.kind AND a.name = b.name WHERE a.hash IS DISTINCT FROM b.hash)
SELECT kind, name, change FROM x ORDER BY CASE kind WHEN 'file' THEN 0 WHEN 'env' THEN 1 ELSE 2 END, CASE change WHEN 'added' THEN 0 WHEN 'deleted' THEN 1 ELSE 2 END, name LIMIT 1
""")
def cache_miss_reason(t, spark, d):
    """J23."""
    return snapshots.miss_reason(WAS.frame(spark), IS.frame(spark))


@query("WITH a AS (SELECT doc_id, sha256(text) AS h FROM documents), p AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN sha256('x') ELSE h END AS h FROM a WHERE doc_id % 7 <> 0) SELECT CAST(a.doc_id AS VARCHAR) AS path, CASE WHEN p.doc_id IS NULL THEN 'left out' WHEN p.h = a.h THEN 'unchanged' ELSE 'rewritten' END AS action FROM a LEFT JOIN p ON a.doc_id = p.doc_id")
def change_ledger(t, spark, d):
    """J22."""
    rows = t("documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("sha256"))
    prepared = rows.filter("doc_id % 7 <> 0").withColumn("sha256", F.when(F.col("doc_id") % 5 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.col("sha256")))
    return snapshots.ledger(rows, prepared)
