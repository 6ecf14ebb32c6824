"""What changes in a code base touch: resolved calls, tests, routes, documents, staleness, risky symbols, evidence edges, risk.

Symbols have qualified names; the last part is the local one. Names are short, so tests by "holds" and "begins with" are equi-joins on
what can be cut of a name, not comparisons of all with all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.rules import SEVERITIES, first_match, severity_rank

#: Parts of a callee's name that matter for security, and parts of a function's name that suggest authentication; case counts for nothing.
SECURITY_NAMES = (
    "subprocess popen system execv execve execl socket connect urlopen urlretrieve urlparse httpconnection httpsconnection remove unlink rmdir rmtree "
    "auth authenticate authorize login logout token password credential secret encrypt decrypt hash verify validate_token sign unsign"
).split()
AUTH_NAMES = "auth authenticate authorize login logout token password credential secret verify validate sign unsign jwt oauth session".split()
#: Points of findings by severity, the least with any HIGH one; points of callers by their most; rules that weigh on security.
SEVERITY_POINTS, LEAST_WITH_HIGH = {"HIGH": 40.0, "MEDIUM": 15.0, "LOW": 5.0}, 70.0
CALLER_POINTS = {0: 0.0, 2: 25.0, 5: 55.0, 10: 80.0}
SECURITY_POINTS = {"broad-handler": 75.0, "security-changed": 85.0, "attack-surface": 90.0}
UNTESTED = ["no-test", "tests-unchanged"]
CONFIDENCES = ["UNKNOWN", "INFERRED", "PROVEN"]
SHORT_DOCSTRING = 20


def local(name: str) -> Column:
    return F.element_at(F.split(name, "\\."), -1)


def is_auth_related(name: Column) -> Column:
    return F.lower(name).rlike("|".join(AUTH_NAMES))


def is_security_call(callee: Column) -> Column:
    return F.lower(callee).rlike("|".join(SECURITY_NAMES))


def callees(calls: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """caller, callee, target, confidence of calls (path, caller, callee, receiver, confidence), the first of five rules that fits.

    What is unknown stays so; a method of self or cls is its last part; a bare name is the first symbol of the same file (path, qname, position), else what an import
    (path, module, name, alias) brings; a method with a receiver that is some symbol's name, and all else, stays as written.
    """
    rows = calls.withColumn("_id", F.monotonically_increasing_id())
    own = symbols.groupBy("path", local("qname").alias("callee")).agg(F.min_by("qname", "position").alias("_own"))
    brought = imports.select("path", "module", F.explode(F.array_distinct(F.array_compact(F.array("name", "alias")))).alias("callee")).groupBy("path", "callee").agg(F.min("module").alias("_module"))
    out = rows.join(own, ["path", "callee"], "left").join(brought, ["path", "callee"], "left")
    bare, unknown = F.col("receiver").isNull(), F.col("confidence") == "UNKNOWN"
    target = F.when(unknown, F.col("callee")).when(F.col("receiver").isin("self", "cls"), local("callee")).when(bare & F.col("_own").isNotNull(), F.col("_own")).when(bare & F.col("_module").isNotNull(), F.concat_ws(".", "_module", "callee")).otherwise(F.col("callee"))
    sure = F.when(unknown, "UNKNOWN").when(bare & F.col("_own").isNotNull(), "PROVEN").otherwise("INFERRED")
    return out.select("caller", "callee", target.alias("target"), sure.alias("confidence"))


def beginnings(name: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(name)), lambda n: F.substr(name, F.lit(1), n))


def parts(name: Column) -> Column:
    """All strings that a name holds."""
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(name)), lambda k: F.transform(F.sequence(F.lit(1), F.length(name) - k + 1), lambda n: F.substr(name, k, n)))))


def tests_of(changed: DataFrame, tests: DataFrame, test_imports: DataFrame) -> DataFrame:
    """symbol, test, method (name_match, import_match or both). changed: symbol, module. tests: test, path. test_imports: path, module.

    By name: test_ and the local name begin the test's name, or the local name and _test are it. By import: a test file imports the module, something
    inside it, or a last part of it.
    """
    wanted = changed.select("symbol", "module", F.lower(local("symbol")).alias("_f"))
    named = tests.withColumn("_t", F.lower(local("test")))
    tails = F.when(F.col("_t").startswith("test_") & (F.length("_t") > 5), beginnings(F.substring("_t", 6, 1 << 20))).otherwise(F.array().cast("array<string>"))
    whole = F.when(F.col("_t").rlike("_test$") & (F.length("_t") > 5), F.array(F.regexp_replace("_t", "_test$", ""))).otherwise(F.array().cast("array<string>"))
    by_name = named.select("test", F.explode(F.array_distinct(F.concat(tails, whole))).alias("_f")).join(wanted, "_f").select("symbol", "test", F.lit("name_match").alias("method"))
    # a module is imported by itself, by what is below it, or by a last part of its name
    pieces = F.split("module", "\\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda k: F.array_join(F.slice(pieces, k, F.size(pieces)), "."))
    by_end = wanted.select("symbol", F.explode(ends).alias("_m")).join(test_imports.select("path", F.col("module").alias("_m")), "_m").select("symbol", "path")
    heads = F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda k: F.array_join(F.slice(pieces, F.lit(1), k), "."))
    by_head = test_imports.select("path", F.explode(heads).alias("_m")).join(wanted.select("symbol", F.col("module").alias("_m")), "_m").select("symbol", "path")
    by_import = by_end.unionByName(by_head).distinct().join(tests, "path").select("symbol", "test", F.lit("import_match").alias("method"))
    both = by_name.unionByName(by_import).groupBy("symbol", "test").agg(F.sort_array(F.collect_set("method"), False).alias("_m"))
    return both.select("symbol", "test", F.array_join("_m", "+").alias("method"))


def covering_tests(symbols: DataFrame, tests: DataFrame) -> DataFrame:
    """symbol, test: the local name is somewhere in the test's local name; case counts for nothing."""
    cut = tests.select("test", F.explode(parts(F.lower(local("test")))).alias("_p"))
    return symbols.select("symbol", F.lower(local("symbol")).alias("_p")).join(cut, "_p").select("symbol", "test").distinct()


def routes_of(changed: DataFrame, routes: DataFrame) -> DataFrame:
    """symbol, function, route of the routes (function, route) that a changed symbol serves, by the qualified or the local name; each function and path once a symbol."""
    whole = changed.select("symbol", F.col("symbol").alias("function")).join(routes, "function")
    short = changed.select("symbol", local("symbol").alias("_l")).join(routes.withColumn("_l", local("function")), "_l").drop("_l")
    return whole.select("symbol", "function", "route").unionByName(short.select("symbol", "function", "route")).dropDuplicates(["symbol", "function", "route"])


def documents_of(symbols: DataFrame, docs: DataFrame) -> DataFrame:
    """symbol, path of the documents (path, body) that hold the local name. A name is one word's part, so the distinct words are cut, not the texts searched for each name."""
    words = docs.select("path", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"\w+"), 0))).alias("word"))
    known = words.select("word").distinct().select("word", F.explode(parts(F.col("word"))).alias("_p"))
    hits = symbols.select("symbol", local("symbol").alias("_p")).join(known, "_p").select("symbol", "word").distinct()
    return hits.join(words, "word").select("symbol", "path").distinct()


def stale(now: DataFrame, before: DataFrame, recent: DataFrame) -> DataFrame:
    """qname, stale. now, before: qname, path, docstring, logic. recent: name (of symbols or files).

    Only what is named as recent can be stale: without a docstring, or where the logic changed and the docstring did not. A symbol that was not there before is judged by
    its docstring alone, which must have some length.
    """
    names = recent.select("name").distinct()
    touched = now.join(names.withColumnRenamed("name", "qname"), "qname", "left_semi").select("qname").union(now.join(names.withColumnRenamed("name", "path"), "path", "left_semi").select("qname")).distinct().withColumn("_touched", F.lit(True))
    old = before.select("qname", F.col("docstring").alias("_d"), F.col("logic").alias("_l"))
    rows = now.join(touched, "qname", "left").join(old, "qname", "left")
    short = F.length(F.trim(F.coalesce("docstring", F.lit("")))) < SHORT_DOCSTRING
    rot = (F.col("_l") != F.col("logic")) & F.col("_d").eqNullSafe(F.col("docstring"))
    verdict = F.when(F.col("_touched").isNull(), F.lit(False)).when(F.coalesce("docstring", F.lit("")) == "", short).when(F.col("_l").isNull(), F.lit(False)).otherwise(rot)
    return rows.select("qname", verdict.alias("stale"))


def risky(symbols: DataFrame) -> DataFrame:
    """qname, callers of the symbols that are called and not tested, most called first, then by rank and name. symbols: qname, callers, tests, is_test, rank."""
    return symbols.filter("callers > 0 AND tests = 0 AND NOT is_test").orderBy(F.desc("callers"), F.desc("rank"), "qname").select("qname", "callers")


def evidence_edges(calls: DataFrame, served: DataFrame, tested: DataFrame, documented: DataFrame) -> DataFrame:
    """src, kind, dst: one table of what is known of symbols: calls, served_by, tested_by, documented_by."""
    named = [(calls.select(F.col("caller").alias("src"), F.col("target").alias("dst")), "calls"), (served.select(F.col("symbol").alias("src"), F.col("route").alias("dst")), "served_by"), (tested.select(F.col("symbol").alias("src"), F.col("test").alias("dst")), "tested_by"), (documented.select(F.col("symbol").alias("src"), F.col("path").alias("dst")), "documented_by")]
    out = None
    for rows, kind in named:
        rows = rows.select("src", F.lit(kind).alias("kind"), "dst").distinct()
        out = rows if out is None else out.unionByName(rows)
    return out


def import_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, added, removed (names in order) of the files in both whose imports (path, name) differ. A file without imports is there with a null name."""
    a = before.groupBy("path").agg(F.collect_set("name").alias("_a"))
    b = after.groupBy("path").agg(F.collect_set("name").alias("_b"))
    rows = a.join(b, "path").select("path", F.sort_array(F.array_except("_b", "_a")).alias("added"), F.sort_array(F.array_except("_a", "_b")).alias("removed"))
    return rows.filter((F.size("added") > 0) | (F.size("removed") > 0))


def checklist(symbols: DataFrame) -> DataFrame:
    """symbol, test_name, steps: what to verify for a changed symbol (symbol, args_changed, handlers_changed, security_changed, routes, tests)."""
    bare = F.regexp_replace(local("symbol"), "^_+", "")
    said = [("args_changed", "check that callers pass the new arguments"), ("handlers_changed", "check that errors still reach the callers"), ("security_changed", "review the security calls"), ("routes > 0", "call the routes that lead here"), ("tests = 0", "write a first test")]
    return symbols.select("symbol", F.concat(F.lit("test_"), bare).alias("test_name"), F.array_compact(F.array(*(F.when(F.expr(when), F.lit(what)) for when, what in said))).alias("steps"))


def overall(findings: DataFrame) -> DataFrame:
    """severity (the worst), confidence (the least sure) of findings; INFO and PROVEN without any."""
    worst = F.coalesce(F.max(severity_rank(F.col("severity"))), F.lit(0))
    sure = F.coalesce(F.min(F.coalesce(*(F.when(F.col("confidence") == c, F.lit(i)) for i, c in enumerate(CONFIDENCES)))), F.lit(len(CONFIDENCES) - 1))
    pick = lambda names, at: F.element_at(F.array(*map(F.lit, names)), at + 1)
    return findings.agg(pick(SEVERITIES, F.greatest(worst, F.lit(0))).alias("severity"), pick(CONFIDENCES, sure).alias("confidence"))


def risk_parts(changes: DataFrame, findings: DataFrame, edges: DataFrame) -> DataFrame:
    """id, blast, severity, tests, security, confidence: the five parts of a change's risk, 0 to 100 each.

    changes: id, symbol, callers. findings: id, symbol, rule, severity. edges: id, confidence. Severity by points of the findings, 70 at least with a HIGH one; blast by steps of the callers; tests by the share of
    symbols whose tests are missing or unchanged; security by its worst rule and ten for each further one; confidence by what is not certain.
    """
    points = F.coalesce(*(F.when(F.col("severity") == s, F.lit(p)) for s, p in SEVERITY_POINTS.items()), F.lit(0.0))
    security = F.coalesce(*(F.when(F.col("rule") == r, F.lit(p)) for r, p in SECURITY_POINTS.items()))
    found = findings.groupBy("id").agg(
        F.least(F.lit(100.0), F.greatest(F.sum(points), F.when(F.count_if(F.col("severity") == "HIGH") > 0, F.lit(LEAST_WITH_HIGH)).otherwise(0.0))).alias("severity"),
        F.coalesce(F.least(F.lit(100.0), F.max(security) + 10.0 * (F.count(security) - 1)), F.lit(0.0)).alias("security"),
        F.count_distinct(F.when(F.col("rule").isin(UNTESTED), F.col("symbol"))).alias("_untested"),
    )
    callers = F.sum("callers")
    touched = changes.groupBy("id").agg(F.coalesce(*(F.when(callers <= most, F.lit(p)) for most, p in CALLER_POINTS.items()), F.lit(100.0)).alias("blast"), F.count_distinct("symbol").alias("_symbols"))
    weight = F.when(F.col("confidence") == "PROVEN", 1.0).when(F.col("confidence") == "INFERRED", 0.6).otherwise(0.2)
    sure = edges.groupBy("id").agg(F.greatest(F.lit(0.0), 100.0 - F.bround(100 * F.sum(weight) / F.count("*"), 0)).alias("confidence"))
    rows = touched.join(found, "id", "left").join(sure, "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return rows.select("id", "blast", zero("severity"), F.least(F.lit(100.0), 100.0 * F.coalesce("_untested", F.lit(0)) / F.col("_symbols")).alias("tests"), zero("security"), zero("confidence"))


__all__ = ["callees", "checklist", "covering_tests", "documents_of", "evidence_edges", "first_match", "import_changes", "is_auth_related", "is_security_call", "overall", "risk_parts", "risky", "routes_of", "stale", "tests_of"]
