"""Queries of scans, sinks, file kinds and manifests: on a small folder that the query writes, and on literal tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import sinks
from tessera.operators import inspect, rules, snapshots
from tessera.plans.paths import PathQuery, ignored, kind, statistics
from tessera.queries.base import Rows, query
from tessera.queries.graphs import NEEDS, TASKS
from tessera.sources import binary, scan
from tessera.storage import fresh_dir

TREE = Rows("path string, body string", [
    ("app.js", "a"), ("src/Main.JS", "bb"), ("src/x.ts", ""), ("src/deep/er/y.js", "ccc"), ("node_modules/m/z.js", "d"), ("src/build/w.js", "e"), ("tool.py", "import os"), ("pkg/__init__.py", ""), ("pkg/mod.py", "x = 1"),
    ("pkg/__pycache__/mod.py", "f"), (".hidden/h.py", "g"), ("pkg/.dot.py", "h"), ("requirements.txt", "a==1"), ("pkg/requirements.txt", "b"), ("pyproject.toml", "[project]"), ("venv/v.py", "i"), ("README", "readme"), ("docs/a.md", "md"), ("docs/sub/b.md", "md"),
])


def folder(spark) -> str:
    """The tree as files."""
    from pyarrow import fs

    top = fresh_dir(spark, "tree")
    store, base = fs.FileSystem.from_uri(top)
    for path, body in TREE.rows:
        store.create_dir(f"{base}/{path}".rpartition("/")[0], recursive=True)
        with store.open_output_stream(f"{base}/{path}") as file:
            file.write(body.encode())
    return top


def entries(spark, pruned=()):
    return scan.listing(spark, folder(spark), pruned)


_INSIDE = "list_has_any(string_split(path, '/')[:-2], [{}])"


@query(f"WITH f AS (SELECT path, length(body) AS size FROM {TREE}), d AS (SELECT DISTINCT array_to_string(string_split(path, '/')[1:i], '/') AS path FROM f, range(1, 9) t(i) WHERE i < len(string_split(path, '/'))) SELECT path, regexp_extract(path, '[^/]+$') AS name, false AS is_dir, size, lower(regexp_extract(regexp_extract(path, '[^/]+$'), '^.+(\\.[^.]*)$', 1)) AS extension FROM f UNION ALL SELECT path, regexp_extract(path, '[^/]+$'), true, NULL, lower(regexp_extract(regexp_extract(path, '[^/]+$'), '^.+(\\.[^.]*)$', 1)) FROM d")
def scan_listing(t, spark, d):
    """S33."""
    return entries(spark).select("path", "name", "is_dir", "size", scan.extension(F.col("name")).alias("extension"))


@query(f"SELECT path FROM {TREE} WHERE lower(path) LIKE '%.js' AND NOT " + _INSIDE.format("'node_modules', '.git', '.svn', '.hg', 'dist', 'build', 'coverage', '.next', '.cache'"))
def scan_sources(t, spark, d):
    """S2."""
    return scan.source_files(entries(spark, scan.SOURCE_IGNORED))


@query(f"""
SELECT path, CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%requirements.txt' THEN 'requirements' ELSE 'pyproject' END AS kind, CASE WHEN path LIKE '%.py' THEN CASE WHEN contains(path, '/') THEN string_split(path, '/')[1] ELSE regexp_replace(path, '\\.py$', '') END END AS module
FROM {TREE} WHERE regexp_matches(path, '\\.py$|(^|/)requirements\\.txt$|(^|/)pyproject\\.toml$') AND NOT """ + _INSIDE.format("'.git', 'venv', '.venv', '__pycache__', 'node_modules'"))
def scan_project(t, spark, d):
    """S3."""
    return scan.python_project(entries(spark, scan.PROJECT_IGNORED))


@query(f"SELECT path FROM {TREE} WHERE path LIKE '%.py' AND NOT regexp_matches(path, '(^|/)\\.') AND NOT contains(path, '__pycache__/')")
def scan_tree(t, spark, d):
    """S4."""
    return scan.python_tree(entries(spark))


@query(f"SELECT path, length(body) AS size FROM {TREE}")
def scan_guarded(t, spark, d):
    """Within its cap (tests hold what happens beyond)."""
    return scan.guarded(entries(spark), 100)


@query(f"WITH f AS (SELECT path, 'file' AS type FROM {TREE} UNION SELECT array_to_string(string_split(path, '/')[1:i], '/'), 'dir' FROM {TREE}, range(1, 9) t(i) WHERE i < len(string_split(path, '/'))) SELECT path, type FROM f WHERE regexp_matches(path, '^src(?:/[^/]+)*$') AND NOT regexp_matches(path, '^(?:[^/]+/)*[^/]*\\.ts$')")
def scan_globs(t, spark, d):
    """Files and folders below a prefix, without some, nothing unreadable."""
    return scan.matching(entries(spark), PathQuery(["src/**"], exclude=["**/*.ts"], types=["file", "dir"]), strict=True).select("path", "type")


@query(f"SELECT path FROM {TREE} WHERE regexp_matches(path, '^(?:[^/]+/)*[^/]*\\.md$') OR regexp_matches(path, '^docs/[^/]*$') OR path = 'README'")
def scan_many_globs(t, spark, d):
    """Several patterns, each file once."""
    return scan.globbed(entries(spark), ["**/*.md", "docs/*", "README"])


@query(f"SELECT path, CAST(length(body) AS INTEGER) AS n FROM {TREE} WHERE path LIKE '%.md'")
def scan_contents(t, spark, d):
    """Contents of what a scan has found."""
    top = folder(spark)
    found = scan.globbed(scan.listing(spark, top), ["**/*.md"])
    return scan.contents(spark, top, found).select("path", F.octet_length("content").alias("n"))


RULES = Rows("directory string, pattern string, position long", [("", "*.md", 0), ("", "!b.md", 1), ("pkg", "mod.py", 2), ("", "# note", 3), ("src", "deep/", 4)])


@query(f"SELECT path FROM {TREE} WHERE NOT regexp_matches(path, '^(?:[^/]+/)*a\\.md$') AND NOT regexp_matches(path, '^pkg/(?:[^/]+/)*mod\\.py$') AND NOT starts_with(path, 'src/deep/')")
def scan_ignored(t, spark, d):
    """Q8: ignore rules, the last match wins, ! re-includes."""
    return ignored(TREE.frame(spark).select("path"), RULES.frame(spark))


@query(f"SELECT count(*) AS considered, count(*) FILTER (regexp_matches(path, '^(?:[^/]+/)*[^/]*\\.py$') AND NOT regexp_matches(path, '(^|/)\\.') AND NOT starts_with(path, 'venv')) AS matched, count(*) FILTER (regexp_matches(path, '(^|/)\\.')) AS hidden, count(*) FILTER (starts_with(path, 'venv')) AS excluded FROM {TREE}")
def scan_statistics(t, spark, d):
    """Counters of one pass."""
    return statistics(TREE.frame(spark).select("path"), PathQuery(["**/*.py"], exclude=["venv/**"]))


@query(f"SELECT count(*) AS n FROM (SELECT path FROM {TREE} WHERE NOT regexp_matches(path, '(^|/)\\.') LIMIT 5)")
def scan_counted(t, spark, d):
    """The count mode honours the limit; without a pattern all paths fit."""
    return PathQuery(limit=5).run(TREE.frame(spark).select("path")).agg(F.count("*").alias("n"))


PATTERNS = Rows("pattern string", [("a/b.txt",), ("a/*.txt",), ("src/**/x",), ("**/x",), ("*",), ("a/{b,c}/d",), ("a/[xy]/**",)])


@query(f"SELECT pattern, CASE WHEN NOT regexp_matches(pattern, '[*?\\[{{]') THEN 'literal' WHEN NOT contains(pattern, '**') AND NOT regexp_matches(pattern, '[*?\\[{{].*/') THEN 'single_directory' WHEN regexp_matches(pattern, '^[^/*?\\[{{]+/') THEN 'fixed_prefix' ELSE 'unbounded' END AS kind FROM {PATTERNS}")
def pattern_kinds(t, spark, d):
    """Q1, and what Q9's text begins with."""
    return spark.createDataFrame([(p, kind(p)) for (p,) in PATTERNS.rows], "pattern string, kind string")


_HEADS = [("a.jpg", "FFD8FFE0"), ("b.png", "89504E470D0A1A0A00"), ("c.exe", "4D5A9000"), ("d.txt", "4D5A0000"), ("e.pdf", "255044462D312E37"), ("f", "7F454C4602"), ("g.json", "7B7D"), ("h.csv", "612C62"), ("i.zip", "504B0304"), ("j.doc", "504B0304"), ("k.dat", "00010203"), ("l.dat", "68656C6C6F"), ("m.svg", "3C7376673E"), ("n.gz", "1F8B08"), ("o.html", "3C68746D6C3E"), ("p.dat", "")]
HEADS = Rows("path string, head string", _HEADS)
_KIND = "CASE WHEN starts_with(head, 'FFD8FF') THEN 'jpeg' WHEN starts_with(head, '89504E470D0A1A0A') THEN 'png' WHEN starts_with(head, '255044462D') THEN 'pdf' WHEN starts_with(head, '504B0304') THEN 'zip' WHEN starts_with(head, '1F8B') THEN 'gzip' WHEN starts_with(head, '4D5A') THEN 'pe-executable' WHEN starts_with(head, '7F454C46') THEN 'elf-executable' WHEN head = '3C7376673E' THEN 'svg' WHEN head = '3C68746D6C3E' THEN 'html' WHEN path LIKE '%.json' THEN 'json' WHEN path LIKE '%.csv' THEN 'csv' WHEN starts_with(head, '00') THEN 'binary' ELSE 'text' END"


def kinds(spark):
    rows = HEADS.frame(spark).select("path", F.unhex("head").alias("content"))
    return rows.select("path", binary.file_type(F.col("content"), F.col("path")).alias("kind"))


@query(f"SELECT path, {_KIND} AS kind FROM {HEADS}")
def file_kinds(t, spark, d):
    """S19."""
    return kinds(spark)


@query(f"""
WITH k AS (SELECT path, {_KIND} AS kind FROM {HEADS})
SELECT path, 'extension-mismatch' AS rule, CASE WHEN kind LIKE '%executable' THEN 'CRITICAL' ELSE 'HIGH' END AS severity FROM k WHERE (kind = 'pe-executable' AND path NOT LIKE '%.exe') OR (kind = 'zip' AND path NOT LIKE '%.zip')
UNION ALL SELECT path, 'executable', 'HIGH' FROM k WHERE kind LIKE '%executable'
""")
def file_findings(t, spark, d):
    """R6."""
    return rules.content_findings(kinds(spark))


CSVS = Rows("path string, body string", [("a.csv", "a,b\n1,2\n3,4\n"), ("b.csv", "a,b\n1\n2,3,4\n5\n"), ("c.csv", "x\n")])


@query(f"SELECT path, CAST(len(string_split(line, ',')) AS INTEGER) AS width, count(*) AS n FROM (SELECT path, unnest(string_split(rtrim(body, chr(10)), chr(10))) AS line FROM {CSVS} WHERE path = 'b.csv') GROUP BY ALL")
def csv_widths(t, spark, d):
    """Rows by their number of columns, of files with several."""
    return inspect.ragged(CSVS.frame(spark))


JSONS = Rows("path string, body string", [("a.jsonl", '{"a": 1}\n\n{"a": \n[1, 2]\nnope\n'), ("b.jsonl", '{"ok": true}\n'), ("c.jsonl", "\n".join("x" for _ in range(14)))])


@query(f"""
WITH l AS (SELECT path, unnest(string_split(body, chr(10))) AS line, unnest(range(1, len(string_split(body, chr(10))) + 1)) AS n FROM {JSONS}),
b AS (SELECT path, n, row_number() OVER (PARTITION BY path ORDER BY n) AS k FROM l WHERE trim(line) <> '' AND NOT json_valid(line))
SELECT path, CAST(n AS INTEGER) AS line FROM b WHERE k <= 10
""")
def json_line_errors(t, spark, d):
    """the first ten lines that are no JSON."""
    return inspect.json_line_errors(JSONS.frame(spark)).select("path", "line")


@query(f"SELECT path, length(body) AS size, sha256(body) AS sha256 FROM {TREE}")
def bundle_manifest(t, spark, d):
    """S30's manifest."""
    return sinks.manifest(TREE.frame(spark).select("path", F.col("body").cast("binary").alias("content")))


@query(f"SELECT path, 'same' AS state, sha256(body) AS sha256 FROM {TREE}")
def bundle_contents(t, spark, d):
    """A bundle's entries, read back, against its manifest."""
    files = TREE.frame(spark).select("path", F.col("body").cast("binary").alias("content"))
    back = inspect.zip_entries(sinks.bundle(files).withColumn("path", F.lit("bundle.zip"))).filter("entry <> 'manifest.json'")
    listed = sinks.manifest(back.select(F.col("entry").alias("path"), "content"))
    errors = snapshots.manifest_errors(sinks.manifest(files), listed)
    return listed.join(errors, "path", "left").select("path", F.coalesce("error", F.lit("same")).alias("state"), "sha256")


THERE = Rows("path string, size long, sha256 string", [("app.js", 1, "x"), ("README", 6, "y"), ("extra", 0, "z")])


@query(f"""
WITH m AS (SELECT path, length(body) AS size, sha256(body) AS sha256 FROM {TREE})
SELECT coalesce(m.path, e.path) AS path, CASE WHEN m.path IS NULL THEN 'not listed' WHEN e.path IS NULL THEN 'missing' WHEN m.size <> e.size THEN 'size' WHEN m.sha256 <> e.sha256 THEN 'hash' END AS error FROM m FULL JOIN {THERE} e ON m.path = e.path
WHERE m.path IS NULL OR e.path IS NULL OR m.size <> e.size OR m.sha256 <> e.sha256
""")
def manifest_errors(t, spark, d):
    """A manifest against what is there."""
    return snapshots.manifest_errors(sinks.manifest(TREE.frame(spark).select("path", F.col("body").cast("binary").alias("content"))), THERE.frame(spark))


@query(f"SELECT sha256(body) AS name, count(*) AS files FROM {TREE} GROUP BY 1")
def blob_store(t, spark, d):
    """Two puts into a store keep each content once; all files come back."""
    files = TREE.frame(spark).select("path", F.col("body").cast("binary").alias("content"))
    store = fresh_dir(spark, "blobs")
    sinks.store_blobs(files.filter("path < 'n'"), store)
    named = sinks.store_blobs(files, store)
    back = sinks.restore_blobs(spark, store, named)
    return back.groupBy(F.sha2("content", 256).alias("name")).agg(F.count("*").alias("files"))


@query("SELECT '{\"cwd\":null,\"n\":' || r_regionkey || ',\"name\":\"' || r_name || '\"}' AS json FROM region")
def sink_canonical_json(t, spark, d):
    """S22."""
    return sinks.canonical_json(t("region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("n"), F.lit(None).cast("string").alias("cwd")))


@query("SELECT r_name, r_regionkey FROM region")
def sink_pretty_json(t, spark, d):
    """Written as text and read back."""
    out = fresh_dir(spark, "pretty")
    sinks.write_lines(sinks.pretty_json(t("region").select("r_name", "r_regionkey")), out)
    # a row's object ends where a line is only a brace
    back = spark.read.text(out, lineSep="}").select(F.from_json(F.concat("value", F.lit("}")), "r_name string, r_regionkey int").alias("x"))
    return back.filter("x.r_name IS NOT NULL").select("x.*")


@query("SELECT '{\"path\":\"' || url || '\"}' AS line FROM pages WHERE NOT regexp_matches(url, '[\"\\\\]')")
def sink_json_lines(t, spark, d):
    """S25."""
    return sinks.json_lines(t("pages").filter(~F.col("url").rlike(r'["\\]')).select(F.col("url").alias("path")))


HISTORY = Rows("position long, timestamp string, command string, cwd string, status string, exit_code long", [(0, "2024-01-01", 'echo "hi", all', "/tmp", "ok", 0), (1, "2024-01-02", "ls\n-l", None, "failed", 2), (2, "", "", "", "", None)])


@query(f"SELECT -1 AS position, 'Timestamp,Command,Working Directory,Status,Exit Code' AS line UNION ALL SELECT position, array_to_string(list_transform([timestamp, command, coalesce(cwd, ''), status, coalesce(CAST(exit_code AS VARCHAR), '')], lambda x: '\"' || replace(x, '\"', '\"\"') || '\"'), ',') FROM {HISTORY}")
def sink_history_csv(t, spark, d):
    """S24."""
    return sinks.history_csv(HISTORY.frame(spark))


FINDINGS = Rows("rule string, severity string, confidence string, evidence string, file string, line long", [("no-test", "MEDIUM", "PROVEN", "none found", "a\\b.py", 3), ("broad-handler", "HIGH", "PROVEN", "except all", "a/c.py", None), ("no-test", "LOW", "INFERRED", 'says "x"', None, 9)])


@query(f"""
WITH f AS (SELECT *, coalesce(replace(file, '\\', '/'), 'unknown') AS uri FROM {FINDINGS})
SELECT rule, CASE severity WHEN 'HIGH' THEN 'error' WHEN 'MEDIUM' THEN 'warning' ELSE 'note' END AS level, '[' || confidence || '] ' || evidence AS text, uri, coalesce(line, 1) AS line, '2.1.0' AS version, CAST((SELECT count(DISTINCT rule) FROM f) AS INTEGER) AS rules FROM f
""")
def sink_sarif(t, spark, d):
    """The log, read back as JSON."""
    shape = "version string, runs array<struct<tool: struct<driver: struct<rules: array<struct<id: string>>>>, results: array<struct<ruleId: string, level: string, message: struct<text: string>, locations: array<struct<physicalLocation: struct<artifactLocation: struct<uri: string>, region: struct<startLine: long>>>>>>>>"
    log = sinks.sarif(FINDINGS.frame(spark)).select(F.from_json("json", shape).alias("j"))
    rows = log.select("j.version", F.size(F.col("j.runs")[0]["tool"]["driver"]["rules"]).alias("rules"), F.explode(F.col("j.runs")[0]["results"]).alias("r"))
    at = F.col("r.locations")[0]["physicalLocation"]
    return rows.select(F.col("r.ruleId").alias("rule"), "r.level", F.col("r.message.text").alias("text"), at["artifactLocation"]["uri"].alias("uri"), at["region"]["startLine"].alias("line"), "version", "rules")


@query(f"SELECT CASE WHEN need IS NULL THEN '    ' || t.task || ';' ELSE '    ' || need || ' --> ' || t.task || ';' END AS line FROM {TASKS} t LEFT JOIN {NEEDS} n ON t.task = n.task")
def sink_diagram(t, spark, d):
    """S27."""
    return sinks.diagram(TASKS.frame(spark), NEEDS.frame(spark))


@query("SELECT o_orderkey % 3 AS run, count(*) AS hits FROM orders GROUP BY 1")
def sink_history_tables(t, spark, d):
    """Three runs and their hits, appended to two tables and joined again."""
    out = fresh_dir(spark, "history")
    for run in range(3):
        sinks.record_analysis(spark.createDataFrame([(run,)], "id long"), t("orders").filter(F.col("o_orderkey") % 3 == run).select(F.lit(run).cast("long").alias("id"), "o_orderkey"), out)
    saved = spark.read.parquet(f"{out}/analyses").join(spark.read.parquet(f"{out}/rule_hits"), "id")
    return saved.groupBy(F.col("id").alias("run")).agg(F.count("*").alias("hits"))


@query(f"SELECT 'needs' AS name, count(*) AS n FROM {NEEDS} UNION ALL SELECT 'tasks', count(*) FROM {TASKS}")
def sink_index(t, spark, d):
    """An index's tables saved and loaded."""
    out = fresh_dir(spark, "index")
    sinks.save_index({"tasks": TASKS.frame(spark), "needs": NEEDS.frame(spark)}, out)
    frames = sinks.load_index(spark, out, ["tasks", "needs"])
    counted = [f.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, f in frames.items()]
    return counted[0].unionByName(counted[1])


OLD_TEXT = Rows("path string, body string", [("a", "one\ntwo\nthree\nfour\nfive\nsix\nseven\neight\n"), ("b", "same\n"), ("c", "gone\n")])
NEW_TEXT = Rows("path string, body string", [("a", "one\ntwo\n3\nfour\nfive\nsix\nseven\neight\n"), ("b", "same\n"), ("d", "new\n")])
_DIFF_A = "--- a\n+++ a\n@@ -1,6 +1,6 @@\n one\n two\n-three\n+3\n four\n five\n six\n"
_DIFFS = Rows("path string, diff string", [("a", _DIFF_A), ("c", "--- c\n+++ c\n@@ -1 +0,0 @@\n-gone\n"), ("d", "--- d\n+++ d\n@@ -0,0 +1 @@\n+new\n")])


@query(f"SELECT path, diff FROM {_DIFFS}")
def text_diffs(t, spark, d):
    """Unified diffs of files that changed."""
    return inspect.unified_diffs(OLD_TEXT.frame(spark), NEW_TEXT.frame(spark))


CONDITIONS = Rows("position long, kind string, path string, value string", [(0, "exists", "app.js", None), (1, "exists", "none", None), (2, "not_exists", "none", None), (3, "is_file", "app.js", None), (4, "is_file", "src", None), (5, "is_dir", "src", None), (6, "is_dir", "none", None), (7, "contains", "README", "adm"), (8, "contains", "README", "xyz"), (9, "sha256", "README", "6B4F0D9E"), (10, "is_file", "link", None)])


@query(f"""
WITH f AS (SELECT path, 'file' AS type, body FROM {TREE} UNION SELECT DISTINCT string_split(path, '/')[1], 'dir', NULL FROM {TREE} WHERE contains(path, '/') UNION SELECT 'link', 'symlink', NULL)
SELECT position, CASE kind WHEN 'exists' THEN f.path IS NOT NULL WHEN 'not_exists' THEN f.path IS NULL WHEN 'is_file' THEN coalesce(type = 'file', false) WHEN 'is_dir' THEN coalesce(type = 'dir', false) WHEN 'contains' THEN contains(body, value) ELSE sha256(body) = lower(value) END AS holds FROM {CONDITIONS} c LEFT JOIN f ON c.path = f.path
""")
def file_conditions(t, spark, d):
    """P17."""
    from tessera.operators import transactions

    top = entries(spark).filter("is_dir AND NOT contains(path, '/')").select("path", F.lit("dir").alias("type"), F.lit(None).cast("binary").alias("content"))
    files = TREE.frame(spark).select("path", F.lit("file").alias("type"), F.col("body").cast("binary").alias("content"))
    link = spark.createDataFrame([("link", "symlink", None)], "path string, type string, content binary")
    return transactions.conditions(CONDITIONS.frame(spark), files.unionByName(top).unionByName(link)).select("position", "holds")
