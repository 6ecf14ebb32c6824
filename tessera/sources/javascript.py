"""JavaScript source files as tables, all of built-in expressions: metrics, declarations, relative imports, routes.

Frames of files have the columns path and code; paths are relative, with /.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The shapes that count as declarations, imports and routes.
NAME = "[a-zA-Z_$][a-zA-Z0-9_$]*"
FUNCTION = rf"(?:async\s+)?function\s+({NAME})\s*\("
ASSIGNED = rf"(?:const|let|var)\s+({NAME})\s*=\s*(?:async\s*)?(?:function(?:\s+{NAME})?\s*\(|\([^)]*\)\s*=>|{NAME}\s*=>)"
CLASS = rf"class\s+({NAME})"
IMPORT = r"""(?:import\s+(?:[\w*\s{},$]+\s+from\s+)?|export\s+(?:[\w*\s{},$]+\s+from\s+)?)['"]([^'"]+)['"]"""
REQUIRE = r"""\brequire\s*\(\s*['"]([^'"]+)['"]\s*\)"""
ROUTE = rf"""(?im)(?:{NAME})\s*\.\s*(get|post|put|patch|delete)\s*\(\s*(['"`])([^'"`\r\n]+)\2\s*(?:,\s*([\s\S]*?))?\s*\)(?:\s*;|\s*$|\s*\n)"""
TESTS = r"(?:^|/)(?:tests?|__tests__|fixtures)/|(?:^|/)test[-_][^/]*$|\.(?:test|spec)\.js$"


def without_comments(code: Column) -> Column:
    """Without comments; what looks like one inside a string goes too."""
    return F.regexp_replace(F.regexp_replace(code, r"/\*[\s\S]*?\*/", ""), r"(?m)//.*$", "")


def is_test(path: Column) -> Column:
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/"))).rlike(TESTS)


def metrics(files: DataFrame) -> DataFrame:
    """path, lines, blank_lines, todos, fixmes, functions, classes (names in order of sight, each once)."""
    code, plain = F.col("code"), without_comments(F.col("code"))
    every = F.split(code, "\r?\n", -1)
    names = lambda pattern: F.regexp_extract_all(plain, F.lit(pattern), 1)
    return files.select(
        "path",
        F.when(code == "", 0).otherwise(F.size(every)).alias("lines"),
        F.when(code == "", 0).otherwise(F.size(F.filter(every, lambda x: x.rlike(r"^\s*$")))).alias("blank_lines"),
        F.regexp_count(code, F.lit(r"(?i)\bTODO\b")).alias("todos"),
        F.regexp_count(code, F.lit(r"(?i)\bFIXME\b")).alias("fixmes"),
        F.array_distinct(F.concat(names(FUNCTION), names(ASSIGNED))).alias("functions"),
        F.array_distinct(names(CLASS)).alias("classes"),
    )


def totals(measured: DataFrame) -> DataFrame:
    """One row of sums, and the file with most lines (of equals the first by path; null without files)."""
    return measured.agg(
        F.count("*").alias("files"),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("lines", "blank_lines", "todos", "fixmes")),
        F.coalesce(F.sum(F.size("functions")), F.lit(0)).alias("functions"),
        F.coalesce(F.sum(F.size("classes")), F.lit(0)).alias("classes"),
        F.min_by("path", F.struct(-F.col("lines"), "path")).alias("largest"),
    )


def specifiers(files: DataFrame) -> DataFrame:
    """path, specifier of relative imports, exports and requires."""
    plain = without_comments(F.col("code"))
    found = F.array_distinct(F.transform(F.concat(F.regexp_extract_all(plain, F.lit(IMPORT), 1), F.regexp_extract_all(plain, F.lit(REQUIRE), 1)), F.trim))
    return files.select("path", F.explode(F.filter(found, lambda s: s.startswith("./") | s.startswith("../"))).alias("specifier"))


def joined_path(folder: Column, relative: Column) -> Column:
    """The path that a relative one leads to; .. beyond the top stays at the top."""
    parts = F.filter(F.split(F.concat_ws("/", folder, relative), "/"), lambda p: ~p.isin("", "."))
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda done, p: F.when(p == "..", F.slice(done, F.lit(1), F.greatest(F.lit(0), F.size(done) - 1))).otherwise(F.concat(done, F.array(p))))
    return F.array_join(walked, "/")


def import_edges(files: DataFrame) -> DataFrame:
    """src, dst: the file that each relative import leads to: itself, index.js in the folder, with .js, with .json, the first of these; imports that lead nowhere give no row."""
    wanted = specifiers(files).withColumn("to", joined_path(F.regexp_extract("path", "^(.*)/[^/]*$", 1), F.col("specifier")))
    tried = wanted.select("path", "specifier", F.posexplode(F.array("to", F.concat("to", F.lit("/index.js")), F.concat("to", F.lit(".js")), F.concat("to", F.lit(".json")))).alias("rank", "dst"))
    hits = tried.join(files.select(F.col("path").alias("dst")), "dst")
    return hits.groupBy("path", "specifier").agg(F.min_by("dst", "rank").alias("dst")).select(F.col("path").alias("src"), "dst").distinct()


def last_argument(arguments: Column) -> Column:
    """The last argument outside brackets, trimmed; null without any."""
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("now"), F.lit(None).cast("string").alias("last"))

    def step(s: Column, c: Column) -> Column:
        comma = (c == ",") & (s["depth"] == 0)
        depth = s["depth"] + c.isin("(", "{", "[").cast("int") - c.isin(")", "}", "]").cast("int")
        last = F.when(comma & (F.trim(s["now"]) != ""), F.trim(s["now"])).otherwise(s["last"])
        return F.struct(depth.alias("depth"), F.when(comma, F.lit("")).otherwise(F.concat(s["now"], c)).alias("now"), last.alias("last"))

    # blanks that trim() does not know become blanks first
    flat = F.regexp_replace(arguments, r"\s", " ")
    return F.aggregate(F.split(flat, ""), start, step, lambda s: F.when(F.trim(s["now"]) != "", F.trim(s["now"])).otherwise(s["last"]))


def routes(files: DataFrame) -> DataFrame:
    """path, method, route, handler of route declarations; a function written in place is anonymous. The same declaration of a file counts once."""
    plain = without_comments(F.col("code"))
    part = lambda k: F.regexp_extract(F.col("m"), ROUTE, k)
    found = files.select("path", F.explode(F.regexp_extract_all(plain, F.lit(ROUTE), 0)).alias("m"))
    rows = found.select("path", F.upper(part(1)).alias("method"), F.trim(part(3)).alias("route"), last_argument(part(4)).alias("_last"))
    inline = F.col("_last").contains("=>") | F.col("_last").rlike(r"(?i)^(?:async\s*\(|\(|function\b|async\s+function\b)")
    name = F.regexp_extract("_last", rf"^({NAME}(?:\.{NAME})*)", 1)
    return rows.select("path", "method", "route", F.when(F.col("_last").isNull() | inline | (name == ""), "anonymous").otherwise(name).alias("handler")).distinct()
