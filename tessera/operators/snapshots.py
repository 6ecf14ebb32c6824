"""Comparing snapshots: full-join diffs, set differences, duplicates, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import byte_values


def diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """key, change (added, deleted, modified), before, after of the keys that differ. Equal values are left out before anything is built of them."""
    a, b = before.select(key, F.col(value).alias("before"), F.lit(True).alias("_a")), after.select(key, F.col(value).alias("after"), F.lit(True).alias("_b"))
    rows = a.join(b, key, "full").filter(F.col("_a").isNull() | F.col("_b").isNull() | ~F.col("before").eqNullSafe(F.col("after")))
    return rows.select(key, F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "deleted").otherwise("modified").alias("change"), "before", "after")


def symbol_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, symbol and a flag for each of args, returns, decorators, handlers, security, calls, docstring that changed.

    Columns: path, symbol, args, returns, decorators, handlers, security, calls (arrays where they are lists; calls compare as sets).
    A symbol counts as modified if its signature, decorators, handlers, security flag or set of callees changed.
    """
    plain = lambda c: F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))))
    fields = ["args", "returns", "decorators", "handlers", "security", "docstring"]
    a = before.select("path", "symbol", *(F.col(f).alias(f"a_{f}") for f in fields), plain(F.col("calls")).alias("a_calls"), F.lit(True).alias("_a"))
    b = after.select("path", "symbol", *(F.col(f).alias(f"b_{f}") for f in fields), plain(F.col("calls")).alias("b_calls"), F.lit(True).alias("_b"))
    rows = a.join(b, ["path", "symbol"], "full")
    for f in [*fields, "calls"]:
        rows = rows.withColumn(f"{f}_changed", ~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")))
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "deleted").when(F.col("args_changed") | F.col("returns_changed") | F.col("decorators_changed") | F.col("handlers_changed") | F.col("security_changed") | F.col("calls_changed"), "modified")
    return rows.withColumn("change", kind).filter("change IS NOT NULL").select("path", "symbol", "change", *(f"{f}_changed" for f in [*fields, "calls"]))


def version_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """name, version, change of package rows: new, bumped (the name was there at another version), gone, or dropped (the name stays)."""
    old, new = before.select("name", "version").distinct(), after.select("name", "version").distinct()
    added = new.join(old, ["name", "version"], "left_anti").join(old.select("name", F.lit(True).alias("_had")).distinct(), "name", "left").select("name", "version", F.when(F.col("_had"), "bumped").otherwise("new").alias("change"))
    removed = old.join(new, ["name", "version"], "left_anti").join(new.select("name", F.lit(True).alias("_has")).distinct(), "name", "left").select("name", "version", F.when(F.col("_has"), "dropped").otherwise("gone").alias("change"))
    return added.unionByName(removed)


def drift(declared: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """key, finding, severity: used but not declared, declared but not used."""
    undeclared = used.select(key).distinct().join(declared.select(key), key, "left_anti").select(key, F.lit("undeclared").alias("finding"), F.lit("HIGH").alias("severity"))
    unused = declared.select(key).distinct().join(used.select(key), key, "left_anti").select(key, F.lit("unused").alias("finding"), F.lit("INFO").alias("severity"))
    return undeclared.unionByName(unused)


def new_findings(findings: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """The findings (package, severity, ...) above INFO on packages that version_diff() says came."""
    added = version_diff(before, after).filter("change IN ('new', 'bumped')").select(F.col("name").alias("package")).distinct()
    return findings.filter("severity <> 'INFO'").join(added, "package", "left_semi")


def drift_findings(imports: DataFrame, declared: DataFrame, provided: DataFrame) -> DataFrame:
    """name, finding, severity, place: imports (name, kind, path, line) of unknown kind are MEDIUM, third-party ones that no manifest declares HIGH, declared ones (name, path) that nothing imports INFO.

    provided: name, module: under which modules a distribution is imported. The place is the first import, or the first manifest.
    """
    first = imports.groupBy("name", "kind").agg(F.min(F.struct("path", "line")).alias("_p"))
    where = F.concat_ws(":", "_p.path", "_p.line")
    known = declared.select("name").union(provided.join(declared.select("name").distinct(), "name", "left_semi").select("module")).distinct()
    unknown = first.filter("kind = 'UNKNOWN'").select("name", F.lit("unknown").alias("finding"), F.lit("MEDIUM").alias("severity"), where.alias("place"))
    undeclared = first.filter("kind = 'THIRD_PARTY'").join(known, "name", "left_anti").select("name", F.lit("undeclared").alias("finding"), F.lit("HIGH").alias("severity"), where.alias("place"))
    used = imports.select("name").union(provided.select("name", "module").join(imports.select(F.col("name").alias("module")).distinct(), "module", "left_semi").select("name")).distinct()
    unused = declared.groupBy("name").agg(F.min("path").alias("place")).join(used, "name", "left_anti").select("name", F.lit("unused").alias("finding"), F.lit("INFO").alias("severity"), "place")
    return unknown.unionByName(undeclared).unionByName(unused)


def task_hash(tasks: DataFrame) -> DataFrame:
    """task, digest of all that a task's result hangs on: name, command, cwd, shell, files, env, needs (maps) and outputs, in order."""
    lines = lambda kind, m: F.transform(F.sort_array(F.map_keys(m)), lambda k: F.concat(F.lit(f"{kind}:"), k, F.lit(":"), F.element_at(F.col(m), k), F.lit("\n")))
    head = F.array(*(F.concat(F.lit(f"{label}:"), F.coalesce(c, F.lit("")), F.lit("\n")) for label, c in (("task_name", "task"), ("command", "command"), ("cwd", "cwd"), ("shell", "shell"))))
    tail = F.transform(F.sort_array("outputs"), lambda o: F.concat(F.lit("output_pattern:"), o, F.lit("\n")))
    return tasks.select("task", F.sha2(F.array_join(F.concat(head, lines("file", "files"), lines("env", "env"), lines("dep", "needs"), tail), ""), 256).alias("digest"))


def run_summary(results: DataFrame, total: Column) -> DataFrame:
    """tasks, cached, executed, failed, saved, saved_percent of task results (status, duration, original); total: the time of the whole run."""
    saved = F.coalesce(F.sum(F.when((F.col("status") == "CACHED") & (F.col("original") > F.col("duration")), F.col("original") - F.col("duration"))), F.lit(0.0))
    state = lambda s: F.count_if(F.col("status") == s)
    rows = results.agg(F.count("*").alias("tasks"), state("CACHED").alias("cached"), state("EXECUTED").alias("executed"), state("FAILED").alias("failed"), saved.alias("saved"))
    return rows.withColumn("saved_percent", F.when(F.col("saved") + total > 0, 100.0 * F.col("saved") / (F.col("saved") + total)).otherwise(0.0))


def duplicates(rows: DataFrame, key: str, digest: Column, size: Column) -> DataFrame:
    """digest, size, copies, canonical (the least key), reclaimable bytes of the contents that several rows have."""
    groups = rows.select(digest.alias("digest"), size.alias("size"), key).groupBy("digest", "size").agg(F.count("*").alias("copies"), F.min(key).alias("canonical"))
    return groups.filter("copies > 1").withColumn("reclaimable", F.col("size") * (F.col("copies") - 1))


def reused(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, uses of the rows whose value others have too. Joined by the value's digest, so that long values are not moved."""
    marked = rows.select(key, F.sha2(F.col(value), 256).alias("_d")).filter("_d IS NOT NULL")
    return marked.join(marked.groupBy("_d").agg(F.count("*").alias("uses")).filter("uses > 1"), "_d").select(key, "uses")


def manifest_errors(manifest: DataFrame, entries: DataFrame) -> DataFrame:
    """path, error of a manifest (path, size, sha256) against what is there."""
    m = manifest.select("path", F.col("size").alias("_s"), F.col("sha256").alias("_h"), F.lit(True).alias("_m"))
    e = entries.select("path", "size", "sha256", F.lit(True).alias("_e"))
    error = F.when(F.col("_m").isNull(), "not listed").when(F.col("_e").isNull(), "missing").when(F.col("_s") != F.col("size"), "size").when(F.col("_h") != F.col("sha256"), "hash")
    return m.join(e, "path", "full").select("path", error.alias("error")).filter("error IS NOT NULL")


def miss_reason(before: DataFrame, now: DataFrame) -> DataFrame:
    """One reason why a cached result does not hold (kind, name, hash on both sides): kinds in the order file, env, dependency; then added, removed, changed; then the least name."""
    rows = diff(before.withColumn("k", F.struct("kind", "name")), now.withColumn("k", F.struct("kind", "name")), "k", "hash")
    rank = F.struct(F.when(F.col("k.kind") == "file", 0).when(F.col("k.kind") == "env", 1).otherwise(2), F.when(F.col("change") == "added", 0).when(F.col("change") == "deleted", 1).otherwise(2), "k.name")
    return rows.select("k.kind", "k.name", "change", rank.alias("_r")).orderBy("_r").limit(1).drop("_r")


def compared(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """key, state (resolved, new, open) of two sets."""
    a, b = before.select(key).distinct().withColumn("_a", F.lit(True)), after.select(key).distinct().withColumn("_b", F.lit(True))
    return a.join(b, key, "full").select(key, F.when(F.col("_b").isNull(), "resolved").when(F.col("_a").isNull(), "new").otherwise("open").alias("state"))


def ledger(original: DataFrame, prepared: DataFrame) -> DataFrame:
    """path, action of each original file: unchanged, rewritten or left out."""
    p = prepared.select("path", F.col("sha256").alias("_p"))
    return original.join(p, "path", "left").select("path", F.when(F.col("_p").isNull(), "left out").when(F.col("_p") == F.col("sha256"), "unchanged").otherwise("rewritten").alias("action"))


def parity(chunks: DataFrame, stripe: list[str], body: str) -> DataFrame:
    """stripe..., parity: the exclusive or of a stripe's binary chunks, shorter ones padded by zeros. A partial aggregate by place in the chunk."""
    bytes_ = chunks.select(*stripe, F.posexplode(byte_values(F.col(body))).alias("_at", "_b"))
    sums = bytes_.groupBy(*stripe, "_at").agg(F.bit_xor("_b").alias("_x"))
    return sums.groupBy(*stripe).agg(F.sort_array(F.collect_list(F.struct("_at", "_x"))).alias("_p")).select(*stripe, F.unhex(F.array_join(F.transform("_p", lambda p: F.lpad(F.hex(p["_x"]), 2, "0")), "")).alias("parity"))


def recovered(there: DataFrame, parities: DataFrame, lost: DataFrame, stripe: list[str], chunk: str, body: str) -> DataFrame:
    """stripe..., chunk, body of one lost chunk a stripe (lost: stripe..., chunk, size): the parity of what is there and of the stripe's parity."""
    both = there.select(*stripe, body).unionByName(parities.select(*stripe, F.col("parity").alias(body)))
    whole = parity(both, stripe, body)
    return lost.join(whole, stripe).select(*stripe, chunk, F.substring("parity", F.lit(1), F.col("size")).alias(body))
