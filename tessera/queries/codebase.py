"""Queries of operators on source files, symbols and their changes, on literal tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import codebase, graph, rules, search, snapshots
from tessera.queries.base import Rows, query
from tessera.sources import code, javascript

FILES = Rows("path string, code string", [
    ("src/app.js", "// TODO start\nimport http from './http';\nconst b = require(\"../lib/b.js\");\nimport './side';\n\nasync function main() { return 1; }\nconst run = async (x) => x;\nclass App {}\n/* class Gone {} */\napp.get('/users/:id', auth, users.show);\napp.post(\"/users\", async (req, res) => { res.send(1, 2); });\n"),
    ("src/http/index.js", "export * from '../util';\n// fixme: function ghost() {}\nfunction get(a) {}\nfunction get(b) {}\nlet put = function named(x) {};\nrouter.delete('/x');\nrouter.delete('/x');\n"),
    ("src/util.js", "\n\n  \nvar once = y => y; // todo TODO\n"),
    ("lib/b.js", "import x from 'outside';\nconst c = require('./c');\nclass B extends A {}\n"),
    ("lib/c.json", "{}"),
    ("src/side.js", ""),
    ("test/app.test.js", "import '../src/app';\nimport '../missing';\r\nclass T {}\r\n"),
])
_PLAIN = r"regexp_replace(regexp_replace(code, '/\*[\s\S]*?\*/', '', 'g'), '(?m)//.*$', '', 'g')"
_NAME = "[a-zA-Z_$][a-zA-Z0-9_$]*"
_METRICS = rf"""
f AS (SELECT path, code, {_PLAIN} AS plain FROM {FILES}),
m AS (SELECT path, CASE WHEN code = '' THEN 0 ELSE len(regexp_split_to_array(code, '\r?\n')) END AS lines, CASE WHEN code = '' THEN 0 ELSE len(list_filter(regexp_split_to_array(code, '\r?\n'), lambda x: regexp_matches(x, '^\s*$'))) END AS blank_lines,
  len(regexp_extract_all(code, '(?i)\bTODO\b')) AS todos, len(regexp_extract_all(code, '(?i)\bFIXME\b')) AS fixmes,
  list_distinct(list_concat(regexp_extract_all(plain, '(?:async\s+)?function\s+({_NAME})\s*\(', 1), regexp_extract_all(plain, '(?:const|let|var)\s+({_NAME})\s*=\s*(?:async\s*)?(?:function(?:\s+{_NAME})?\s*\(|\([^)]*\)\s*=>|{_NAME}\s*=>)', 1))) AS functions,
  list_distinct(regexp_extract_all(plain, 'class\s+({_NAME})', 1)) AS classes FROM f)
"""


@query(f"WITH {_METRICS} SELECT path, CAST(lines AS INTEGER) AS lines, CAST(blank_lines AS INTEGER) AS blank_lines, CAST(todos AS INTEGER) AS todos, CAST(fixmes AS INTEGER) AS fixmes, array_to_string(list_sort(functions), ' ') AS functions, array_to_string(list_sort(classes), ' ') AS classes FROM m")
def js_metrics(t, spark, d):
    """F12."""
    return javascript.metrics(FILES.frame(spark)).withColumns({c: F.array_join(F.sort_array(c), " ") for c in ("functions", "classes")})


@query(f"WITH {_METRICS} SELECT count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(blank_lines) AS BIGINT) AS blank_lines, CAST(sum(todos) AS BIGINT) AS todos, CAST(sum(fixmes) AS BIGINT) AS fixmes, CAST(sum(len(functions)) AS BIGINT) AS functions, CAST(sum(len(classes)) AS BIGINT) AS classes, arg_min(path, (-lines, path)) AS largest FROM m")
def js_totals(t, spark, d):
    """A7."""
    return javascript.totals(javascript.metrics(FILES.frame(spark)))


_EDGES = Rows("src string, dst string", [("src/app.js", "src/http/index.js"), ("src/app.js", "lib/b.js"), ("src/app.js", "src/side.js"), ("src/http/index.js", "src/util.js"), ("lib/b.js", "lib/c.json"), ("test/app.test.js", "src/app.js")])


@query(f"SELECT src, dst FROM {_EDGES}")
def js_import_edges(t, spark, d):
    """Relative imports and the files that they lead to."""
    return javascript.import_edges(FILES.frame(spark))


@query(rf"""
WITH f AS (SELECT path, {_PLAIN} AS plain FROM {FILES}), s AS (SELECT path, unnest(list_distinct(list_concat(regexp_extract_all(plain, '(?:import\s+(?:[\w*\s{{}},$]+\s+from\s+)?|export\s+(?:[\w*\s{{}},$]+\s+from\s+)?)[''"]([^''"]+)[''"]', 1), regexp_extract_all(plain, '\brequire\s*\(\s*[''"]([^''"]+)[''"]\s*\)', 1)))) AS specifier FROM f)
SELECT path, specifier FROM s WHERE starts_with(specifier, './') OR starts_with(specifier, '../')
""")
def js_specifiers(t, spark, d):
    """F13."""
    return javascript.specifiers(FILES.frame(spark))


_ROUTES = Rows("path string, method string, route string, handler string", [("src/app.js", "GET", "/users/:id", "users.show"), ("src/app.js", "POST", "/users", "anonymous"), ("src/http/index.js", "DELETE", "/x", "anonymous")])


@query(f"SELECT path, method, route, handler FROM {_ROUTES}")
def js_routes(t, spark, d):
    """F14."""
    return javascript.routes(FILES.frame(spark))


PATHS = Rows("path string", [("src/app.js",), ("test/app.test.js",), ("Tests\\x.js",), ("a/__tests__/b.js",), ("a/contest/b.js",), ("lib/test-util.js",), ("lib/x.spec.js",), ("latest.js",), ("fixtures/a",)])


@query(rf"SELECT path, regexp_matches(p, '(^|/)(tests?|__tests__|fixtures)/') OR regexp_matches(string_split(p, '/')[-1], '^test[-_]|\.(test|spec)\.js$') AS is_test FROM (SELECT path, lower(replace(path, '\', '/')) AS p FROM {PATHS})")
def test_paths(t, spark, d):
    """P3."""
    return PATHS.frame(spark).withColumn("is_test", javascript.is_test(F.col("path")))


@query(f"""
WITH {_METRICS}, e AS {_EDGES}, n AS (SELECT path, (SELECT count(*) FROM e WHERE dst = path) AS dependents, path NOT IN (SELECT dst FROM e) AND path NOT LIKE 'test/%' AND path NOT LIKE '%.json' AS entry FROM m)
SELECT m.path, round(5 * dependents + 20 * entry::INT + 2 * len(functions) + 3 * len(classes) + 2 * todos + 3 * fixmes + lines / 100, 2) AS score FROM m JOIN n ON m.path = n.path ORDER BY score DESC, m.path LIMIT 3
""")
def js_starting_files(t, spark, d):
    """Where to begin reading."""
    measured, edges = javascript.metrics(FILES.frame(spark)), javascript.import_edges(FILES.frame(spark))
    inward = graph.degrees(edges).select(F.col("node").alias("path"), F.col("in_degree").alias("dependents"))
    sources = measured.select(F.col("path").alias("node"))
    entries = graph.entry_points(edges, sources).filter(~javascript.is_test(F.col("node")) & ~F.col("node").endswith(".json")).select(F.col("node").alias("path"), F.lit(True).alias("entry"))
    rows = measured.join(inward, "path", "left").join(entries, "path", "left")
    score = search.starting_score(F.coalesce("dependents", F.lit(0)), F.coalesce("entry", F.lit(False)), F.size("functions"), F.size("classes"), F.col("todos"), F.col("fixmes"), F.col("lines"))
    return search.recommended(rows.select("path", score.alias("score")), "path")


PYTHON = Rows("path string, code string", [
    ("pkg/a.py", "import os, json.decoder\nfrom subprocess import run\n\ndef f(x: int, *, y=1) -> str:\n    \"\"\"Says.\"\"\"\n    if x and y or x:\n        for i in range(x):\n            pass\n    try:\n        eval('1')\n    except ValueError:\n        pass\n    return getattr(os, 'x')()\n\nclass C:\n    def m(self):\n        return self.g()\n"),
    ("pkg/b.py", "import pickle\nfrom . import a\npickle.loads(b'')\nrun('x', shell=True)\n__import__('y')\n"),
    ("pkg/bad.py", "def (:\n"),
])


@query("SELECT * FROM (VALUES ('pkg/a.py', 'f', 'function', 6, false), ('pkg/a.py', 'C', 'class', 1, false), ('pkg/a.py', 'C.m', 'function', 1, false)) t(path, symbol, kind, complexity, typed)")
def py_symbols(t, spark, d):
    """Symbols with the ways through them (one, an if, a loop, a handler, two more operands) and whether all is typed."""
    return code.symbols(code.parsed(PYTHON.frame(spark))).select("path", "symbol", "kind", "complexity", "typed")


@query("SELECT * FROM (VALUES ('pkg/a.py', 'eval', 'CRITICAL', 10), ('pkg/b.py', 'pickle.loads', 'HIGH', 3), ('pkg/b.py', 'run', 'HIGH', 4), ('pkg/b.py', '__import__', 'MEDIUM', 5)) t(path, callee, severity, line)")
def py_dangerous(t, spark, d):
    """P5."""
    return code.dangerous(code.parsed(PYTHON.frame(spark))).select("path", "callee", "severity", "line")


@query("SELECT * FROM (VALUES ('f', 'range', 'PROVEN'), ('f', 'eval', 'PROVEN'), ('f', 'getattr', 'UNKNOWN'), ('f', '', 'UNKNOWN'), ('C.m', 'self.g', 'INFERRED'), ('', 'pickle.loads', 'INFERRED'), ('', 'run', 'PROVEN'), ('', '__import__', 'PROVEN')) t(caller, callee, confidence)")
def py_calls(t, spark, d):
    """How sure a call's target is."""
    return code.calls(code.parsed(PYTHON.frame(spark))).select("caller", "callee", "confidence")


@query("SELECT * FROM (VALUES ('os', 'STDLIB'), ('json', 'STDLIB'), ('subprocess', 'STDLIB'), ('pickle', 'UNKNOWN')) t(module, kind)")
def py_import_kinds(t, spark, d):
    """P4."""
    table = lambda *names: spark.createDataFrame([(n,) for n in names], "module string")
    return code.classified(code.imports(code.parsed(PYTHON.frame(spark))), table("os", "json", "subprocess"), table("pkg"), table("numpy")).select("module", "kind")


ROUTED = Rows("path string, code string", [("web.py", "from flask import Flask\n\n@app.route('/a', methods=['POST', 'GET'])\ndef a(): ...\n\n@app.route('/b')\ndef b(): ...\n\n@router.put('/c/{id}')\nasync def c(): ...\n\n@other('/d')\ndef d(): ...\n")])


@query("SELECT * FROM (VALUES ('web.py', 'a', 'GET', '/a'), ('web.py', 'a', 'POST', '/a'), ('web.py', 'b', 'GET', '/b'), ('web.py', 'c', 'PUT', '/c/{id}')) t(path, function, method, route)")
def py_routes(t, spark, d):
    """routes by decorators of two frameworks."""
    return code.decorator_routes(code.parsed(ROUTED.frame(spark)))


CALLS = Rows("path string, caller string, callee string, receiver string, confidence string", [("a.py", "a.f", "helper", None, "PROVEN"), ("a.py", "a.f", "load", None, "PROVEN"), ("a.py", "a.f", "self.go", "self", "INFERRED"), ("a.py", "a.f", "getattr", None, "UNKNOWN"), ("a.py", "a.f", "db.query", "db", "INFERRED"), ("b.py", "b.g", "helper", None, "PROVEN"), ("b.py", "b.g", "np", None, "PROVEN")])
SYMBOLS = Rows("path string, qname string, position long", [("a.py", "a.C.helper", 2), ("a.py", "a.helper", 1), ("a.py", "a.f", 3), ("b.py", "b.g", 1)])
IMPORTS = Rows("path string, module string, name string, alias string", [("a.py", "io_tools", "load", None), ("b.py", "numpy", "array", "np")])


@query(f"""
WITH o AS (SELECT path, regexp_extract(qname, '[^.]+$') AS l, arg_min(qname, position) AS own FROM {SYMBOLS} GROUP BY 1, 2), i AS (SELECT * FROM {IMPORTS})
SELECT caller, callee, CASE WHEN confidence = 'UNKNOWN' THEN callee WHEN receiver IN ('self', 'cls') THEN regexp_extract(callee, '[^.]+$') WHEN receiver IS NULL AND own IS NOT NULL THEN own WHEN receiver IS NULL AND i.module IS NOT NULL THEN i.module || '.' || callee ELSE callee END AS target,
  CASE WHEN confidence = 'UNKNOWN' THEN 'UNKNOWN' WHEN receiver IS NULL AND own IS NOT NULL THEN 'PROVEN' ELSE 'INFERRED' END AS confidence
FROM {CALLS} c LEFT JOIN o ON c.path = o.path AND c.callee = o.l LEFT JOIN i ON c.path = i.path AND (c.callee = i.name OR c.callee = i.alias)
""")
def call_targets(t, spark, d):
    """J4."""
    return codebase.callees(CALLS.frame(spark), SYMBOLS.frame(spark), IMPORTS.frame(spark))


@query(f"""
WITH c AS (SELECT DISTINCT caller, callee FROM {CALLS}), k AS (SELECT c.*, qname, CASE WHEN qname = callee THEN 0 ELSE 1 END AS rank, position FROM c JOIN {SYMBOLS} s ON qname = callee OR regexp_extract(qname, '[^.]+$') = callee)
SELECT caller, callee, arg_min(qname, (rank, position)) AS target FROM k GROUP BY caller, callee
""")
def call_targets_by_name(t, spark, d):
    """J5."""
    return rules.resolved_calls(CALLS.frame(spark).select("caller", "callee"), SYMBOLS.frame(spark).select("qname", "position"))


CHANGED = Rows("symbol string, module string", [("auth.check_token", "auth"), ("db.Store.get", "db"), ("util.text.fold", "util.text"), ("x.get", "x")])
TESTS = Rows("test string, path string", [("tests.test_check_token", "t/a.py"), ("tests.test_check_token_expired", "t/a.py"), ("tests.get_test", "t/b.py"), ("tests.test_other", "t/b.py"), ("tests.Test_Getter", "t/c.py"), ("tests.test_unfolded", "t/c.py")])
TEST_IMPORTS = Rows("path string, module string", [("t/b.py", "db"), ("t/c.py", "util.text.more"), ("t/c.py", "text")])
_BY_NAME = "regexp_extract(lower(test), '[^.]+$')"


@query(f"""
WITH p AS (SELECT symbol, module, test, path, {_BY_NAME} AS t, lower(regexp_extract(symbol, '[^.]+$')) AS f FROM {CHANGED}, {TESTS}),
x AS (SELECT p.*, starts_with(t, 'test_' || f) OR t = f || '_test' AS by_name, EXISTS (SELECT 1 FROM {TEST_IMPORTS} i WHERE i.path = p.path AND (i.module = p.module OR starts_with(i.module, p.module || '.') OR ends_with(p.module, '.' || i.module))) AS by_import FROM p)
SELECT symbol, test, CASE WHEN by_name AND by_import THEN 'name_match+import_match' WHEN by_name THEN 'name_match' ELSE 'import_match' END AS method FROM x WHERE by_name OR by_import
""")
def tests_by_name_and_import(t, spark, d):
    """J6."""
    return codebase.tests_of(CHANGED.frame(spark), TESTS.frame(spark), TEST_IMPORTS.frame(spark))


@query(f"SELECT symbol, test FROM {CHANGED}, {TESTS} WHERE contains({_BY_NAME}, lower(regexp_extract(symbol, '[^.]+$')))")
def tests_by_name_inside(t, spark, d):
    """J7."""
    return codebase.covering_tests(CHANGED.frame(spark), TESTS.frame(spark))


SERVED = Rows("function string, route string", [("auth.check_token", "/token"), ("api.get", "/get"), ("api.get", "/get"), ("api.put", "/put"), ("x.get", "/x")])


@query(f"SELECT DISTINCT symbol, function, route FROM {CHANGED}, {SERVED} WHERE symbol = function OR regexp_extract(symbol, '[^.]+$') = regexp_extract(function, '[^.]+$')")
def routes_of_changes(t, spark, d):
    """J8."""
    return codebase.routes_of(CHANGED.frame(spark), SERVED.frame(spark))


DOCS = Rows("path string, body string", [("README.md", "Use check_token() before budget, then fold."), ("docs/a.md", "nothing to see"), ("docs/b.md", "The widget folds; get_all works")])


@query(f"SELECT DISTINCT symbol, path FROM {CHANGED}, {DOCS} WHERE contains(body, regexp_extract(symbol, '[^.]+$'))")
def documents_of_changes(t, spark, d):
    """J9."""
    return codebase.documents_of(CHANGED.frame(spark), DOCS.frame(spark))


EDGES = Rows("src string, dst string, position long", [("m.a", "auth.check_token", 3), ("m.a", "auth.check_token", 1), ("m.b", "check_token", 2), ("m.c", "other.get", 4), ("m.d", "forget", 5)])


@query(f"SELECT symbol, src, min(position) AS position FROM {CHANGED}, {EDGES} WHERE dst = symbol OR regexp_extract(dst, '[^.]+$') = regexp_extract(symbol, '[^.]+$') GROUP BY symbol, src")
def callers_of_changes(t, spark, d):
    """J3."""
    return rules.callers_of(CHANGED.frame(spark), EDGES.frame(spark))


NOW = Rows("qname string, path string, docstring string, logic string", [("a.f", "a.py", "Adds two numbers together.", "1"), ("a.g", "a.py", "Takes one from the other.", "2"), ("a.h", "a.py", None, "3"), ("b.i", "b.py", "Something long enough here.", "4"), ("c.j", "c.py", "", "5"), ("a.new", "a.py", "A new one with some words.", "6")])
BEFORE = Rows("qname string, path string, docstring string, logic string", [("a.f", "a.py", "Adds two numbers together.", "9"), ("a.g", "a.py", "Takes one from another.", "8"), ("a.h", "a.py", None, "3"), ("b.i", "b.py", "Something long enough here.", "7")])
RECENT = Rows("name string", [("a.py",), ("b.other",), ("c.j",)])


@query(f"""
SELECT n.qname, CASE WHEN n.qname NOT IN (SELECT name FROM {RECENT}) AND n.path NOT IN (SELECT name FROM {RECENT}) THEN false WHEN coalesce(n.docstring, '') = '' THEN true WHEN b.qname IS NULL THEN false ELSE b.logic <> n.logic AND b.docstring = n.docstring END AS stale
FROM {NOW} n LEFT JOIN {BEFORE} b ON n.qname = b.qname
""")
def stale_symbols(t, spark, d):
    """P8."""
    return codebase.stale(NOW.frame(spark), BEFORE.frame(spark), RECENT.frame(spark))


KNOWN = Rows("qname string, callers long, tests long, is_test boolean, rank double, unknown_edges long", [("a", 3, 0, False, 0.1, 0), ("b", 3, 0, False, 0.2, 0), ("c", 0, 0, False, 0.3, 0), ("d", 2, 1, False, 0.1, 0), ("e", 5, 0, True, 0.1, 0), ("f", 1, 0, False, 0.1, 2), ("g", 0, 2, False, 0.0, 0)])


@query(f"SELECT qname, callers FROM {KNOWN} WHERE callers > 0 AND tests = 0 AND NOT is_test")
def risky_symbols(t, spark, d):
    """A12's risky symbols."""
    return codebase.risky(KNOWN.frame(spark))


@query(f"SELECT badge, count(*) AS n FROM (SELECT CASE WHEN unknown_edges > 0 THEN 'UNKNOWN' WHEN tests > 0 AND callers > 0 THEN 'PROVEN' WHEN tests > 0 OR callers > 0 THEN 'INFERRED' ELSE 'UNKNOWN' END AS badge FROM {KNOWN}) GROUP BY badge")
def badge_counts(t, spark, d):
    """P9, A12's breakdown."""
    return rules.badges(KNOWN.frame(spark)).groupBy("badge").agg(F.count("*").alias("n"))


HITS = Rows("id string, score double", [("a", 4.0), ("b", 2.0), ("c", 3.0), ("e", 1.0)])
RANKED = Rows("id string, name string, rank double, badge string, stale boolean, is_test boolean", [("a", "__init__", 0.5, "PROVEN", False, False), ("b", "run", 1.0, "INFERRED", True, False), ("c", "go", 0.0, "UNKNOWN", False, False), ("e", "test_x", 0.2, "PROVEN", False, True)])


@query(f"""
WITH s AS (SELECT id, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS score FROM {HITS})
SELECT s.id, round(0.6 * CASE WHEN regexp_matches(name, '^__.*__$') THEN score / 2 ELSE score END + 0.2 * rank + 0.2 * CASE badge WHEN 'PROVEN' THEN 1.0 WHEN 'INFERRED' THEN 0.65 ELSE 0.3 END * CASE WHEN stale THEN 0.5 ELSE 1 END, 6) AS score,
  row_number() OVER (ORDER BY 0.6 * CASE WHEN regexp_matches(name, '^__.*__$') THEN score / 2 ELSE score END + 0.2 * rank + 0.2 * CASE badge WHEN 'PROVEN' THEN 1.0 WHEN 'INFERRED' THEN 0.65 ELSE 0.3 END * CASE WHEN stale THEN 0.5 ELSE 1 END DESC) AS place
FROM s JOIN {RANKED} r ON s.id = r.id WHERE NOT is_test
""")
def search_blended(t, spark, d):
    """Scaled over all hits, blended, ranked."""
    return search.placed(search.blended(HITS.frame(spark), RANKED.frame(spark), "id"), "id").withColumn("score", F.round("score", 6))


@query(f"""
SELECT DISTINCT caller AS src, 'calls' AS kind, callee AS dst FROM {CALLS} UNION SELECT function, 'served_by', route FROM {SERVED} UNION SELECT symbol, 'tested_by', test FROM {CHANGED}, {TESTS} WHERE contains({_BY_NAME}, lower(regexp_extract(symbol, '[^.]+$')))
UNION SELECT symbol, 'documented_by', path FROM {CHANGED}, {DOCS} WHERE contains(body, regexp_extract(symbol, '[^.]+$'))
""")
def evidence_graph(t, spark, d):
    """G14."""
    changed = CHANGED.frame(spark)
    return codebase.evidence_edges(CALLS.frame(spark).select("caller", F.col("callee").alias("target")), SERVED.frame(spark).withColumnRenamed("function", "symbol"), codebase.covering_tests(changed, TESTS.frame(spark)), codebase.documents_of(changed, DOCS.frame(spark)))


_FLAGS = ["public", "documented", "decorated", "auth_related", "security_calls", "imports_changed", "broad_handler_added", "args_changed", "returns_changed", "handlers_changed", "security_changed", "docstring_changed", "body_changed"]


def _symbol(name: str, change: str, true: str, *numbers: int) -> tuple:
    return (name, change, *(f in true.split() for f in _FLAGS), *numbers)


DIFF = Rows(f"symbol string, change string, {', '.join(f'{f} boolean' for f in _FLAGS)}, callers long, routes long, tests long, tests_changed long, complexity long", [
    _symbol("a.f", "modified", "public documented args_changed body_changed", 2, 0, 0, 0, 12),
    _symbol("a._g", "modified", "args_changed handlers_changed imports_changed", 0, 1, 1, 1, 1),
    _symbol("a.login", "modified", "public auth_related decorated broad_handler_added handlers_changed body_changed", 1, 2, 3, 0, 14),
    _symbol("a.spawn", "modified", "security_calls security_changed documented docstring_changed body_changed", 0, 0, 1, 1, 2),
    _symbol("a.fresh", "added", "public", 0, 0, 1, 1, 1),
    _symbol("a._quiet", "added", "", 0, 0, 1, 1, 1),
    _symbol("a.main", "added", "public", 0, 0, 1, 1, 1),
])
_RULES = {
    "signature-changed": ("public AND change = 'modified' AND (args_changed OR returns_changed)", "'HIGH'"),
    "handlers-changed": ("handlers_changed AND NOT broad_handler_added", "'MEDIUM'"),
    "broad-handler": ("broad_handler_added", "'HIGH'"),
    "security-changed": ("auth_related OR (security_calls AND security_changed)", "CASE WHEN security_changed THEN 'HIGH' ELSE 'MEDIUM' END"),
    "route-affected": ("routes > 0", "CASE WHEN decorated THEN 'HIGH' ELSE 'MEDIUM' END"),
    "no-test": ("tests = 0", "'MEDIUM'"),
    "tests-unchanged": ("tests > 0 AND body_changed AND tests_changed = 0", "'HIGH'"),
    "imports-changed": ("imports_changed", "'MEDIUM'"),
    "stale-docstring": ("documented AND body_changed AND NOT docstring_changed", "'MEDIUM'"),
    "complex": ("complexity > 10", "CASE WHEN tests = 0 THEN 'HIGH' ELSE 'MEDIUM' END"),
    "orphan": ("change = 'added' AND callers = 0 AND routes = 0 AND NOT regexp_matches(symbol, '(^|\\.)_[^.]*$') AND NOT regexp_matches(symbol, '(^|\\.)(main|cli|app|setup|run)$')", "'MEDIUM'"),
}
_FOUND = " UNION ALL ".join(f"SELECT '{name}' AS rule, symbol, {severity} AS severity FROM d WHERE {when}" for name, (when, severity) in _RULES.items())


@query(f"WITH d AS {DIFF} {_FOUND}")
def change_rules(t, spark, d):
    """R2, P19 beside it: the eleven rules."""
    return rules.change_findings(DIFF.frame(spark), {k: rules.RULES[k] for k in _RULES}).select("rule", "symbol", "severity")


@query(f"WITH d AS {DIFF}, f AS ({_FOUND}) SELECT rule, symbol, severity FROM f WHERE NOT (rule = 'no-test' AND symbol = 'a.f') AND rule <> 'complex'")
def change_rules_suppressed(t, spark, d):
    """Findings without those that a table of exceptions names, by symbol and rule or by rule alone."""
    found = rules.change_findings(DIFF.frame(spark), {k: rules.RULES[k] for k in _RULES}).withColumnRenamed("symbol", "file")
    left = rules.suppressed(found, spark.createDataFrame([("a.f", "no-test")], "file string, rule string"))
    return rules.disabled(left, spark.createDataFrame([("complex",)], "rule string")).select("rule", F.col("file").alias("symbol"), "severity")


@query(f"WITH d AS {DIFF}, f AS ({_FOUND}), r AS (SELECT max(CASE severity WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 END) AS r FROM f) SELECT CASE r WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' END AS severity, 'INFERRED' AS confidence FROM r")
def change_overall(t, spark, d):
    """The worst severity and the least sure confidence."""
    sure = F.when(F.col("rule").isin("route-affected", "security-changed", "tests-unchanged"), "INFERRED").otherwise("PROVEN")
    return codebase.overall(rules.change_findings(DIFF.frame(spark), {k: rules.RULES[k] for k in _RULES}).withColumn("confidence", sure))


@query(f"WITH d AS {DIFF}, f AS ({_FOUND}) SELECT true AS high, false AS critical, count(*) FILTER (severity = 'HIGH') AS n FROM f")
def change_gate(t, spark, d):
    """P20: whether findings are as severe as a bound."""
    found = rules.change_findings(DIFF.frame(spark), {k: rules.RULES[k] for k in _RULES})
    return rules.gate(found).select(F.col("failed").alias("high")).join(rules.gate(found, "critical").select(F.col("failed").alias("critical"))).join(found.agg(F.count_if(F.col("severity") == "HIGH").alias("n")))


@query(f"SELECT symbol, 'test_' || regexp_replace(regexp_extract(symbol, '[^.]+$'), '^_+', '') AS test_name, CAST(args_changed::INT + handlers_changed::INT + security_changed::INT + (routes > 0)::INT + (tests = 0)::INT AS INTEGER) AS steps FROM {DIFF}")
def change_checklist(t, spark, d):
    """F35."""
    return codebase.checklist(DIFF.frame(spark)).withColumn("steps", F.size("steps"))


CHANGES = Rows("id long, symbol string, callers long", [(1, "a", 4), (1, "b", 2), (2, "c", 0), (3, "d", 1), (4, "e", 30)])
FINDINGS = Rows("id long, symbol string, rule string, severity string", [(1, "a", "no-test", "MEDIUM"), (1, "a", "broad-handler", "HIGH"), (1, "b", "security-changed", "HIGH"), (3, "d", "stale-docstring", "LOW"), (4, "e", "attack-surface", "LOW"), (4, "e", "tests-unchanged", "HIGH"), (4, "e", "complex", "MEDIUM"), (4, "e", "no-test", "MEDIUM")])
CONFIDENCE = Rows("id long, confidence string", [(1, "PROVEN"), (1, "UNKNOWN"), (1, "INFERRED"), (3, "PROVEN"), (4, "UNKNOWN")])


@query(f"""
WITH c AS (SELECT id, sum(callers) AS n, count(DISTINCT symbol) AS symbols FROM {CHANGES} GROUP BY id),
f AS (SELECT id, least(100, greatest(sum(CASE severity WHEN 'HIGH' THEN 40 WHEN 'MEDIUM' THEN 15 WHEN 'LOW' THEN 5 ELSE 0 END), CASE WHEN count(*) FILTER (severity = 'HIGH') > 0 THEN 70 ELSE 0 END)) AS severity, count(DISTINCT symbol) FILTER (rule IN ('no-test', 'tests-unchanged')) AS untested,
  least(100, max(CASE rule WHEN 'broad-handler' THEN 75 WHEN 'security-changed' THEN 85 WHEN 'attack-surface' THEN 90 END) + 10 * (count(*) FILTER (rule IN ('broad-handler', 'security-changed', 'attack-surface')) - 1)) AS security FROM {FINDINGS} GROUP BY id),
e AS (SELECT id, 100 - round_even(100 * sum(CASE confidence WHEN 'PROVEN' THEN 1.0 WHEN 'INFERRED' THEN 0.6 ELSE 0.2 END) / count(*), 0) AS unsure FROM {CONFIDENCE} GROUP BY id),
s AS (SELECT c.id, round_even(0.3 * coalesce(severity, 0) + 0.25 * CASE WHEN n <= 0 THEN 0 WHEN n <= 2 THEN 25 WHEN n <= 5 THEN 55 WHEN n <= 10 THEN 80 ELSE 100 END + 0.2 * least(100, 100 * coalesce(untested, 0) / symbols) + 0.15 * coalesce(security, 0) + 0.1 * coalesce(unsure, 0), 0) AS score FROM c LEFT JOIN f ON c.id = f.id LEFT JOIN e ON c.id = e.id)
SELECT id, CAST(score AS INTEGER) AS score, CASE WHEN score >= 75 THEN 'CRITICAL' WHEN score >= 50 THEN 'HIGH' WHEN score >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM s
""")
def change_risk(t, spark, d):
    """A15, with A14 in its last part."""
    return rules.risk_score(codebase.risk_parts(CHANGES.frame(spark), FINDINGS.frame(spark), CONFIDENCE.frame(spark)))


@query(f"SELECT id, CAST(round_even(100 * sum(CASE confidence WHEN 'PROVEN' THEN 1.0 WHEN 'INFERRED' THEN 0.6 ELSE 0.2 END) / count(*), 0) AS INTEGER) AS score FROM {CONFIDENCE} WHERE id = 1 GROUP BY id")
def change_confidence(t, spark, d):
    """A14."""
    return rules.confidence_score(CONFIDENCE.frame(spark).filter("id = 1")).select(F.lit(1).cast("long").alias("id"), "score")


OLD_IMPORTS = Rows("path string, name string", [("a.py", "os"), ("a.py", "json.loads"), ("b.py", "sys"), ("c.py", None), ("gone.py", "x")])
NEW_IMPORTS = Rows("path string, name string", [("a.py", "os"), ("a.py", "re"), ("b.py", "sys"), ("c.py", "abc"), ("new.py", "y")])


@query(f"""
WITH p AS (SELECT DISTINCT o.path FROM {OLD_IMPORTS} o JOIN {NEW_IMPORTS} n ON o.path = n.path),
x AS (SELECT path, coalesce((SELECT string_agg(DISTINCT name, ' ' ORDER BY name) FROM {NEW_IMPORTS} n WHERE n.path = p.path AND name NOT IN (SELECT name FROM {OLD_IMPORTS} o WHERE o.path = p.path AND name IS NOT NULL)), '') AS added,
  coalesce((SELECT string_agg(DISTINCT name, ' ' ORDER BY name) FROM {OLD_IMPORTS} o WHERE o.path = p.path AND name NOT IN (SELECT name FROM {NEW_IMPORTS} n WHERE n.path = p.path AND name IS NOT NULL)), '') AS removed FROM p)
SELECT path, added, removed FROM x WHERE added <> '' OR removed <> ''
""")
def import_set_changes(t, spark, d):
    """J26."""
    return codebase.import_changes(OLD_IMPORTS.frame(spark), NEW_IMPORTS.frame(spark)).select("path", F.array_join("added", " ").alias("added"), F.array_join("removed", " ").alias("removed"))


SYMBOL_SCHEMA = "path string, symbol string, args array<string>, returns string, decorators array<string>, handlers array<string>, security boolean, docstring string, calls array<string>"
OLD = Rows(SYMBOL_SCHEMA, [("a.py", "f", ["x"], None, [], ["E"], False, "d", ["p", "q"]), ("a.py", "g", [], "int", [], [], False, None, []), ("a.py", "h", [], None, [], [], False, "old", ["p"]), ("a.py", "same", ["a"], None, ["r"], [], True, "x", ["z"])])
NEW = Rows(SYMBOL_SCHEMA, [("a.py", "f", ["x", "y"], None, [], [], False, "d", ["q", "p", "p"]), ("a.py", "i", [], None, [], [], False, None, []), ("a.py", "h", [], None, [], [], False, "new", ["p"]), ("a.py", "same", ["a"], None, ["r"], [], True, "x", ["z"])])


@query(f"""
SELECT coalesce(o.symbol, n.symbol) AS symbol, CASE WHEN o.symbol IS NULL THEN 'added' WHEN n.symbol IS NULL THEN 'deleted' ELSE 'modified' END AS change, o.args IS DISTINCT FROM n.args AS args_changed, o.handlers IS DISTINCT FROM n.handlers AS handlers_changed
FROM {OLD} o FULL JOIN {NEW} n ON o.path = n.path AND o.symbol = n.symbol
WHERE o.symbol IS NULL OR n.symbol IS NULL OR o.args IS DISTINCT FROM n.args OR o.returns IS DISTINCT FROM n.returns OR o.decorators IS DISTINCT FROM n.decorators OR o.handlers IS DISTINCT FROM n.handlers OR o.security IS DISTINCT FROM n.security OR list_sort(list_distinct(o.calls)) IS DISTINCT FROM list_sort(list_distinct(n.calls))
""")
def symbol_changes(t, spark, d):
    """J2."""
    return snapshots.symbol_diff(OLD.frame(spark), NEW.frame(spark)).select("symbol", "change", "args_changed", "handlers_changed")


CALLEES = Rows("name string", [("subprocess.run",), ("os.system",), ("print",), ("HashMap.put",), ("user.login",), ("sum",), ("validate",), ("oauth_session",)])


@query(f"""
SELECT name, regexp_matches(lower(name), 'subprocess|popen|system|execv|execve|execl|socket|connect|urlopen|urlretrieve|urlparse|httpconnection|httpsconnection|remove|unlink|rmdir|rmtree|auth|authenticate|authorize|login|logout|token|password|credential|secret|encrypt|decrypt|hash|verify|validate_token|sign|unsign') AS security,
  regexp_matches(lower(name), 'auth|authenticate|authorize|login|logout|token|password|credential|secret|verify|validate|sign|unsign|jwt|oauth|session') AS auth FROM {CALLEES}
""")
def security_names(t, spark, d):
    """P6."""
    return CALLEES.frame(spark).select("name", codebase.is_security_call(F.col("name")).alias("security"), codebase.is_auth_related(F.col("name")).alias("auth"))
