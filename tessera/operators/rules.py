"""Rule engines: findings as unions of one select a rule, ordered, filtered and summed up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import banded
from tessera.operators import graph
from tessera.operators.names import squats

SEVERITIES = ["INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL"]
DEEP, ESTABLISHED, MOST_CYCLES = 6, 3, 5

RULES: dict[str, Callable[[DataFrame], DataFrame]] = {}


def rule(name: str) -> Callable:
    """Registers a function of a frame of changed symbols that gives rows: symbol, severity, detail."""

    def add(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        RULES[name] = f
        return f

    return add


def severity_rank(severity: Column) -> Column:
    return F.coalesce(*(F.when(F.upper(severity) == s, F.lit(i)) for i, s in enumerate(SEVERITIES)), F.lit(-1))


def ordered(findings: DataFrame, *tie: str) -> DataFrame:
    return findings.orderBy(severity_rank(F.col("severity")).desc(), *tie)


def selected(findings: DataFrame, only: str | None = None, verbose: bool = False, most: int | None = None, tie: tuple[str, ...] = ("rule", "package", "version")) -> DataFrame:
    """Of one rule, without INFO unless verbose, the first `most`."""
    out = findings.filter(F.col("rule") == only) if only else findings
    out = out if verbose else out.filter(F.col("severity") != "INFO")
    out = ordered(out, *tie)
    return out.limit(most) if most is not None else out


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("n"))


def gate(findings: DataFrame, fail_on: str = "HIGH") -> DataFrame:
    """failed: whether any finding is as severe as that."""
    return findings.agg(F.coalesce(F.max(severity_rank(F.col("severity"))) >= SEVERITIES.index(fail_on.upper()), F.lit(False)).alias("failed"))


def suppressed(findings: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Findings without those that a row (file, rule) of the suppressions names."""
    return findings.join(suppressions.select("file", "rule"), ["file", "rule"], "left_anti")


def disabled(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings without those of a disabled rule (rule)."""
    return findings.join(rules.select("rule"), "rule", "left_anti")


def off_registry(ecosystem: Column, resolved: Column) -> Column:
    """git, path, url or registry, where a package comes from elsewhere than its default registry; else null."""
    r = F.lower(resolved)
    npm = (
        F.when(r.startswith("git+") | r.startswith("git:") | (r.contains("github.com/") & r.endswith(".git")), "git")
        .when(r.startswith("file:"), "path")
        .when(r.startswith("http") & ~r.contains("registry.npmjs.org"), "url")
    )
    crates = F.when(r.startswith("git+"), "git").when(r.startswith("registry+") & ~r.contains("github.com/rust-lang/crates.io-index"), "registry")
    return F.when(ecosystem == "npm", npm).when(ecosystem == "crates", crates)


def is_pinned(spec: Column) -> Column:
    """One == or === clause without a wildcard."""
    return spec.rlike(r"^\s*={2,3}\s*[^,*\s]+\s*$")


def audit(packages: DataFrame, edges: DataFrame, roots: DataFrame, popular: DataFrame, trivial: DataFrame, ecosystem: str, flat: bool = False) -> DataFrame:
    """rule, severity, package, version of a package graph.

    packages: location, name, version, resolved, integrity, install_script, link, spec, direct_url. edges: src, dst and roots:
    node, of locations. popular: name, position. trivial: name.
    """
    rows = packages.filter(~F.col("link"))
    degree = graph.degrees(edges).select(F.col("node").alias("location"), "in_degree")
    near = squats(rows, popular)
    named = rows.join(near, "name").join(degree, "location", "left")
    squat = named.select(F.when(F.col("kind") == "confusable", "confusable-name").otherwise("typosquat-candidate").alias("rule"), F.when(F.col("kind") == "confusable", "HIGH").when(F.coalesce("in_degree", F.lit(0)) >= ESTABLISHED, "INFO").when(F.col("distance") == 1, "HIGH").otherwise("MEDIUM").alias("severity"), "name", "version")
    scripts = rows.filter("install_script").join(near.select("name", F.lit(True).alias("_s")).distinct(), "name", "left").select(F.lit("install-script").alias("rule"), F.when(F.col("_s"), "CRITICAL").otherwise("MEDIUM").alias("severity"), "name", "version")
    plain = lambda when, name, severity: F.when(when, F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity")))
    wants_hash = F.col("resolved").isNotNull() if ecosystem == "npm" else F.coalesce(F.col("resolved").startswith("registry+"), F.lit(False)) if ecosystem == "crates" else F.lit(False)
    python = F.lit(ecosystem == "pypi")
    direct, spec = F.col("direct_url").isNotNull(), F.trim(F.coalesce("spec", F.lit("")))
    each = rows.join(trivial.select("name", F.lit(True).alias("_t")).distinct(), "name", "left").select(
        "name",
        "version",
        F.explode(
            F.array_compact(
                F.array(
                    plain(wants_hash & F.col("integrity").isNull(), "no-integrity", "MEDIUM"),
                    plain(off_registry(F.lit(ecosystem), F.col("resolved")).isNotNull(), "off-registry-source", "HIGH"),
                    plain(F.col("_t"), "trivial-package", "LOW"),
                    plain(python & direct, "direct-url-requirement", "HIGH"),
                    plain(python & ~direct & (spec == ""), "unpinned", "MEDIUM"),
                    plain(python & ~direct & (spec != "") & ~spec.contains("=="), "unpinned-range", "LOW"),
                )
            )
        ).alias("f"),
    ).select("f.rule", "f.severity", "name", "version")
    out = squat.unionByName(scripts).unionByName(each)
    if not flat:
        depth = graph.depths(edges, roots).select(F.col("node").alias("location"), "depth")
        placed = rows.join(depth, "location", "left")
        out = out.unionByName(placed.filter(F.col("depth") >= DEEP).select(F.lit("deep-transitive").alias("rule"), F.lit("INFO").alias("severity"), "name", "version"))
        out = out.unionByName(placed.filter("depth IS NULL").select(F.lit("unreachable-entry").alias("rule"), F.lit("LOW").alias("severity"), "name", "version"))
    versions = rows.groupBy("name").agg(F.count_distinct("version").alias("v")).filter("v > 1").agg(F.count("*").alias("n")).filter("n > 0")
    out = out.unionByName(versions.select(F.lit("duplicate-versions").alias("rule"), F.lit("LOW").alias("severity"), F.format_string("%d packages", "n").alias("name"), F.lit("").alias("version")))
    rings = graph.cycles(edges, MOST_CYCLES).select(F.col("members")[0].alias("_first")).join(rows.select(F.col("location").cast("string").alias("_first"), "name", "version"), "_first")
    out = out.unionByName(rings.select(F.lit("dependency-cycle").alias("rule"), F.lit("INFO").alias("severity"), "name", "version"))
    return out.withColumnRenamed("name", "package")


def changes(name: str, when: str, severity: str, detail: str) -> None:
    """A rule that is one condition on the frame of changed symbols. severity: a level, or 'A if condition else B'."""
    high, _, rest = severity.partition(" if ")
    condition, _, low = rest.partition(" else ")

    def f(symbols: DataFrame) -> DataFrame:
        level = F.when(F.expr(condition), high).otherwise(low) if condition else F.lit(severity)
        return symbols.filter(when).select("symbol", level.alias("severity"), F.lit(detail).alias("detail"))

    RULES[name] = f


#: Names that are called from outside, so that nothing in the code calls them.
ENTRY_NAMES = "('main', 'cli', 'app', 'setup', 'run')"
_LOCAL = "element_at(split(symbol, '[.]'), -1)"
changes("signature-changed", "public AND change = 'modified' AND (args_changed OR returns_changed)", "HIGH", "its signature changed")
changes("handlers-changed", "handlers_changed AND NOT broad_handler_added", "MEDIUM", "its exception handlers changed")
changes("broad-handler", "broad_handler_added", "HIGH", "it now catches every exception")
changes("security-changed", "auth_related OR (security_calls AND security_changed)", "HIGH if security_changed else MEDIUM", "a security boundary was touched")
changes("route-affected", "routes > 0", "HIGH if decorated else MEDIUM", "a route leads to it")
changes("no-test", "tests = 0", "MEDIUM", "no test names it")
changes("tests-unchanged", "tests > 0 AND body_changed AND tests_changed = 0", "HIGH", "it changed and its tests did not")
changes("imports-changed", "imports_changed", "MEDIUM", "its file imports other names")
changes("stale-docstring", "body_changed AND NOT docstring_changed AND documented", "MEDIUM", "it changed and its description did not")
changes("complex", "complexity > 10", "HIGH if tests = 0 else MEDIUM", "over ten ways through it")
changes("orphan", f"change = 'added' AND callers = 0 AND routes = 0 AND NOT startswith({_LOCAL}, '_') AND {_LOCAL} NOT IN {ENTRY_NAMES}", "MEDIUM", "nothing calls it")


def attack_surface(before: DataFrame, after: DataFrame) -> DataFrame:
    """rule, severity, added: one finding if requirements (name) are new, with their names in order. Its own rule, beside those of symbols."""
    new = after.select("name").distinct().join(before.select("name"), "name", "left_anti")
    rows = new.agg(F.array_join(F.sort_array(F.collect_list("name")), ", ").alias("added"), F.count("*").alias("_n")).filter("_n > 0")
    return rows.select(F.lit("attack-surface").alias("rule"), F.lit("LOW").alias("severity"), "added")


#: The extensions that belong to a kind of content.
EXTENSIONS = {
    "jpeg": [".jpg", ".jpeg", ".jpe"],
    "png": [".png"],
    "gif": [".gif"],
    "pdf": [".pdf"],
    "zip": [".zip", ".jar", ".apk", ".epub", ".docx", ".docm", ".xlsx", ".xlsm", ".pptx", ".pptm"],
    "gzip": [".gz", ".tgz"],
    "bzip2": [".bz2", ".tbz", ".tbz2"],
    "xz": [".xz", ".txz"],
    "tar": [".tar"],
    "rar": [".rar"],
    "7z": [".7z"],
    "pe-executable": [".exe", ".dll", ".sys", ".scr", ".com"],
    "elf-executable": ["", ".so", ".bin", ".run"],
}


def content_findings(files: DataFrame) -> DataFrame:
    """path, rule, severity of files (path, kind) whose extension belongs to other content, and of executables."""
    suffix = F.lower(F.regexp_extract("path", r"[^/.][^/]*(\.[^./]+)$", 1))
    fits = F.coalesce(*(F.when(F.col("kind") == kind, suffix.isin(known)) for kind, known in EXTENSIONS.items()), F.lit(True))
    runs = F.col("kind").endswith("executable")
    found = F.array_compact(F.array(F.when(~fits, F.struct(F.lit("extension-mismatch").alias("rule"), F.when(runs, "CRITICAL").otherwise("HIGH").alias("severity"))), F.when(runs, F.struct(F.lit("executable").alias("rule"), F.lit("HIGH").alias("severity")))))
    return files.select("path", F.explode(found).alias("f")).select("path", "f.rule", "f.severity")


def change_findings(symbols: DataFrame, rules: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """rule, symbol, severity, detail of a symbol diff with the columns that the rules name.

    change, public, documented, decorated, auth_related, security_calls, imports_changed, broad_handler_added, the flags ..._changed of args, returns, handlers, security, docstring and body, and the numbers callers,
    routes, tests, tests_changed, complexity.
    """
    out = None
    for name, f in (rules or RULES).items():
        rows = f(symbols).select(F.lit(name).alias("rule"), "symbol", "severity", "detail")
        out = rows if out is None else out.unionByName(rows)
    return out


def overall(findings: DataFrame) -> DataFrame:
    """severity (the worst; INFO without findings), fired."""
    worst = F.greatest(F.coalesce(F.max(severity_rank(F.col("severity"))), F.lit(0)), F.lit(0))
    return findings.agg(F.element_at(F.array(*map(F.lit, SEVERITIES)), worst + 1).alias("severity"), F.count("*").alias("fired"))


def confidence_score(edges: DataFrame) -> DataFrame:
    """score: percent of certainty of edges (confidence), 100 without any; halves round to even."""
    weight = F.when(F.col("confidence") == "PROVEN", 1.0).when(F.col("confidence") == "INFERRED", 0.6).otherwise(0.2)
    return edges.agg(F.coalesce(F.bround(100 * F.sum(weight) / F.count("*"), 0), F.lit(100.0)).cast("int").alias("score"))


def newest(rows: DataFrame, order: list[str], most: int) -> DataFrame:
    """The newest rows, then in time order."""
    return rows.orderBy(*(F.desc(c) for c in order)).limit(most).orderBy(*order)


def callers_of(changed: DataFrame, edges: DataFrame) -> DataFrame:
    """symbol, src of the callers of changed symbols: by the last part of the name, the first edge of each pair (edges: src, dst, position)."""
    last = lambda c: F.element_at(F.split(c, "\\."), -1)
    hits = changed.select("symbol", last(F.col("symbol")).alias("_k")).join(edges.withColumn("_k", last(F.col("dst"))), "_k")
    return hits.groupBy("symbol", "src").agg(F.min("position").alias("position"))


def first_match(candidates: DataFrame, key: str) -> DataFrame:
    """key, target of candidates (key, target, rank, position): the lowest rank, then position."""
    return candidates.groupBy(key).agg(F.min_by("target", F.struct("rank", "position")).alias("target"))


def resolved_calls(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """caller, callee, target: the qualified name itself, else the first symbol (position) with that last part."""
    last = F.element_at(F.split("qname", "\\."), -1)
    exact = calls.join(symbols.select(F.col("qname").alias("callee")), "callee").select("caller", "callee", F.col("callee").alias("target"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("position"))
    short = calls.join(symbols.select(last.alias("callee"), F.col("qname").alias("target"), F.col("position").cast("long").alias("position")), "callee").select("caller", "callee", "target", F.lit(1).alias("rank"), "position")
    return exact.unionByName(short).groupBy("caller", "callee").agg(F.min_by("target", F.struct("rank", "position")).alias("target"))


def badges(symbols: DataFrame) -> DataFrame:
    """qname, badge from callers, tests and whether any edge is UNKNOWN."""
    return symbols.select("qname", F.when(F.col("unknown_edges") > 0, "UNKNOWN").when((F.col("tests") > 0) & (F.col("callers") > 0), "PROVEN").when((F.col("tests") > 0) | (F.col("callers") > 0), "INFERRED").otherwise("UNKNOWN").alias("badge"))


#: Weights of a change's five parts, and bands of the sum.
RISK_WEIGHTS = {"severity": 0.30, "blast": 0.25, "tests": 0.20, "security": 0.15, "confidence": 0.10}
RISK_BANDS = {75: "CRITICAL", 50: "HIGH", 25: "MEDIUM", 0: "LOW"}


def risk_score(parts: DataFrame) -> DataFrame:
    """id, score, band from five parts of 0 to 100; halves round to even."""
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.bround(sum((w * F.col(c) for c, w in RISK_WEIGHTS.items()), F.lit(0.0)), 0))).cast("int")
    return parts.select("id", score.alias("score"), banded(score, RISK_BANDS).alias("band"))


def bounded_newest(rows: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """Of each key the newest rows only: a bounded history."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter(F.col("_n") <= most).drop("_n")


def transitive(packages: DataFrame, roots: DataFrame) -> DataFrame:
    """transitive: how many packages (link) are neither links nor roots; 0 at least."""
    n = packages.agg(F.count_if(~F.col("link")).alias("_n")).join(roots.agg(F.count("*").alias("_r")))
    return n.select(F.greatest(F.lit(0), F.col("_n") - F.col("_r")).cast("long").alias("transitive"))
