from pyspark.sql import functions as F

from tessera.operators import names, rules, secrets, sessions, snapshots
from tessera.sources.text import lock_edges, lock_packages, requirements


def rows(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


def test_diff(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2"), ("n", None)], "k string, v string")
    b = spark.createDataFrame([("y", "3"), ("z", "4"), ("n", None)], "k string, v string")
    assert rows(snapshots.diff(a, b, "k", "v"), "k", "change") == [("x", "deleted"), ("y", "modified"), ("z", "added")]
    assert snapshots.diff(a, a, "k", "v").count() == 0


def test_versions_and_drift(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "name string, version string")
    new = spark.createDataFrame([("a", "2"), ("b", "1"), ("d", "1")], "name string, version string")
    assert rows(snapshots.version_diff(old, new), "name", "version", "change") == [("a", "1", "dropped"), ("a", "2", "bumped"), ("c", "1", "gone"), ("d", "1", "new")]
    assert rows(snapshots.drift(old, new, "name"), "name", "finding") == [("c", "unused"), ("d", "undeclared")]
    assert rows(snapshots.compared(old, new, "name"), "name", "state") == [("a", "open"), ("b", "open"), ("c", "resolved"), ("d", "new")]


def test_duplicates_and_manifest(spark):
    files = spark.createDataFrame([("b", "same", 4), ("a", "same", 4), ("c", "other", 5)], "path string, sha256 string, size long")
    assert rows(snapshots.duplicates(files, "path", F.col("sha256"), F.col("size")), "copies", "canonical", "reclaimable") == [(2, "a", 4)]
    wrong = spark.createDataFrame([("b", "same", 4), ("a", "else", 4), ("d", "x", 1)], "path string, sha256 string, size long")
    assert rows(snapshots.manifest_errors(files, wrong), "path", "error") == [("a", "hash"), ("c", "missing"), ("d", "not listed")]
    assert rows(snapshots.ledger(files, wrong), "path", "action") == [("a", "rewritten"), ("b", "unchanged"), ("c", "left out")]
    assert rows(snapshots.reused(files, "path", "sha256"), "path", "uses") == [("a", 2), ("b", 2)]


def test_miss_reason(spark):
    a = spark.createDataFrame([("env", "A", "1"), ("file", "f", "1")], "kind string, name string, hash string")
    b = spark.createDataFrame([("env", "A", "2"), ("file", "f", "2")], "kind string, name string, hash string")
    assert tuple(snapshots.miss_reason(a, b).first()) == ("file", "f", "modified")


def test_osa():
    assert names.osa("ab", "ba", 2) == 1 and names.osa("ca", "abc", 3) == 3 and names.osa("kitten", "sitting", 2) is None and names.osa("é", "e", 1) == 1 and names.osa("", "", 0) == 0


def test_near_pairs_equal_brute_force(spark):
    words = ["alpha", "alpah", "alhpa", "beta", "bet", "be", "b", "", "gamma", "gama", "gaamma", "alpha"]
    frame = spark.createDataFrame([(w,) for w in words], "n string")

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = _next(row, i, x, b)
        return row[-1]

    def _next(above, i, x, b):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
        return row

    want = sorted((a, b, plain(a, b)) for a in set(words) for b in set(words) if a < b and plain(a, b) <= 2)
    assert rows(names.near_pairs(frame, "n"), "a", "b", "distance") == want


def test_squats(spark):
    popular = spark.createDataFrame([("requests", 0), ("numpy", 1), ("@types/node", 2), ("tar", 3), ("python-dotenv", 4)], "name string, position int")
    found = spark.createDataFrame([("reqeusts",), ("nurnpy",), ("etag",), ("python-dotnev",), ("@jest/core",), ("numpy",)], "name string")
    assert rows(names.squats(found, popular), "name", "target", "distance", "kind") == [("nurnpy", "numpy", None, "confusable"), ("python-dotnev", "python-dotenv", 1, "near"), ("reqeusts", "requests", 1, "near")]


def test_secrets(spark):
    key = "AKIA" + "B" * 16
    texts = spark.createDataFrame([(1, f"id {key} and password = 'correct horse'"), (2, "nothing"), (3, None), (4, "\x00\x01\x02"), (5, "mail a.b@c.de at 10.0.0.1, 10.0.0.2")], "id long, text string")
    assert rows(secrets.findings(texts, "id", "text"), "id", "rule", "secret") == [(1, "aws_access_key", "AKIA" + "*" * 16), (1, "hardcoded_password", "corr" + "*" * 9)]
    assert rows(secrets.content_counts(texts, "id", "text", "email", "ipv4"), "id", "email", "ipv4") == [(5, 1, 2)]
    run = "aB3dE5gH7jK9mN1pQ3sT5vX7zC9bD1fG"
    high = spark.createDataFrame([(1, run), (2, "a" * 40)], "id long, text string")
    assert rows(secrets.high_entropy(high, "id", "text"), "id", "run") == [(1, run)]
    assert rows(secrets.file_risk(secrets.findings(texts, "id", "text").withColumn("severity", F.lower("severity")), "id"), "id", "risk", "status") == [(1, 42, "blocked")]


def test_sessions(spark):
    events = spark.createDataFrame([("s", 1, "q", "a"), ("s", 2, "r", "b"), ("s", 3, "q", "c"), ("s", 4, "q", "d"), ("s", 5, "r", "e")], "s string, i long, kind string, v string")
    pairs = sessions.paired(events, "s", "i", F.col("kind") == "q", F.col("kind") == "r", "v")
    assert rows(pairs, "request", "response", "request_value", "response_value") == [(1, 2, "a", "b"), (4, 5, "d", "e")]
    asked = spark.createDataFrame([("k", 1), ("k", 2), ("k", 3)], "k string, i long")
    recorded = spark.createDataFrame([("k", 10, "x"), ("k", 20, "y")], "k string, i long, a string")
    assert [r.answer for r in sessions.nth_answers(asked, recorded, ["k"], "i", "a").orderBy("i").collect()] == ["x", "y", None]
    faults = spark.createDataFrame([(0, 2, 500, 0), (1, 2, 503, 9)], "position int, i long, status int, delay int")
    assert sessions.with_faults(asked, faults, "i").orderBy("i").collect()[1].fault_status == 503


LOCK = """{"packages": {"": {"dependencies": {"a": "1"}}, "node_modules/a": {"version": "1", "resolved": "https://registry.npmjs.org/a", "integrity": "h", "dependencies": {"b": "1"}},
"node_modules/a/node_modules/b": {"version": "2", "resolved": "git+ssh://x"}, "node_modules/b": {"version": "1", "resolved": "https://registry.npmjs.org/b", "integrity": "h", "hasInstallScript": true}}}"""


def test_lock_files_and_audit(spark):
    packages = lock_packages(spark.createDataFrame([(LOCK,)], "value string"))
    edges = lock_edges(packages)
    assert rows(edges, "src", "dst") == [("", "node_modules/a"), ("node_modules/a", "node_modules/a/node_modules/b")]
    full = packages.filter("location <> ''").withColumns({"spec": F.lit(None).cast("string"), "direct_url": F.lit(None).cast("string")})
    roots = spark.createDataFrame([("node_modules/a",)], "node string")
    popular = spark.createDataFrame([("zzzzzz", 0)], "name string, position int")
    trivial = spark.createDataFrame([("a",)], "name string")
    found = rules.audit(full, edges.filter("src <> ''"), roots, popular, trivial, "npm")
    assert rows(found, "rule", "severity", "package") == [("duplicate-versions", "LOW", "1 packages"), ("install-script", "MEDIUM", "b"), ("no-integrity", "MEDIUM", "b"), ("off-registry-source", "HIGH", "b"), ("trivial-package", "LOW", "a"), ("unreachable-entry", "LOW", "b")]
    assert rules.gate(found).first().failed and not rules.gate(found, "critical").first().failed


def test_requirements(spark):
    lines = ["# note", "Foo_Bar[x,y]==1.0  # pinned", "pkg @ https://h/x#egg=pkg", "bare", "r>=1,<2 ; python_version<'3'", ""]
    got = requirements(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [(r.name, r.extras, r.spec, r.direct_url) for r in got.collect()] == [("Foo_Bar", ["x", "y"], "==1.0", None), ("pkg", [], "", "https://h/x#egg=pkg"), ("bare", [], "", None), ("r", [], ">=1,<2", None)]
    pinned = spark.createDataFrame([("==1.0",), ("===1",), ("==1.*",), (">=1",)], "s string").select(rules.is_pinned(F.col("s"))).collect()
    assert [r[0] for r in pinned] == [True, True, False, False]


def test_rule_engine(spark):
    flags = ["public", "documented", "decorated", "auth_related", "security_calls", "imports_changed", "broad_handler_added", *(f"{x}_changed" for x in ("args", "returns", "handlers", "security", "docstring", "body"))]
    make = lambda symbol, change, true, *numbers: (symbol, change, *(f in true for f in flags), *numbers)
    schema = f"symbol string, change string, {', '.join(f'{f} boolean' for f in flags)}, callers int, routes int, tests int, tests_changed int, complexity int"
    symbols = spark.createDataFrame([make("f", "modified", ["public", "documented", "args_changed", "body_changed"], 2, 0, 0, 0, 12), make("m.g", "added", ["imports_changed"], 0, 0, 1, 1, 1), make("m.main", "added", ["auth_related"], 0, 1, 1, 0, 1), make("h", "modified", ["handlers_changed", "broad_handler_added", "body_changed"], 0, 0, 2, 0, 11)], schema)
    found = rules.change_findings(symbols)
    assert rows(found, "rule", "symbol", "severity") == sorted([("complex", "f", "HIGH"), ("no-test", "f", "MEDIUM"), ("signature-changed", "f", "HIGH"), ("stale-docstring", "f", "MEDIUM"), ("imports-changed", "m.g", "MEDIUM"), ("orphan", "m.g", "MEDIUM"), ("security-changed", "m.main", "MEDIUM"), ("route-affected", "m.main", "MEDIUM"), ("broad-handler", "h", "HIGH"), ("tests-unchanged", "h", "HIGH"), ("complex", "h", "MEDIUM")])
    assert tuple(rules.overall(found).first()) == ("HIGH", 11)
    edges = spark.createDataFrame([("PROVEN",), ("INFERRED",), ("UNKNOWN",)], "confidence string")
    assert rules.confidence_score(edges).first().score == 60 and rules.confidence_score(edges.limit(0)).first().score == 100
    calls = spark.createDataFrame([("x.f", "g"), ("x.f", "m.h"), ("x.f", "none")], "caller string, callee string")
    known = spark.createDataFrame([("m.h", 2), ("n.g", 1), ("m.g", 0)], "qname string, position int")
    assert rows(rules.resolved_calls(calls, known), "callee", "target") == [("g", "m.g"), ("m.h", "m.h")]
