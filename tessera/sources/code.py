"""Python source files as tables: imports, calls and symbols. Parsing is Python's own; everything after is declared on the tables.

Frames of files have the columns path and code. A file that doesn't parse gives no rows.
"""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

CALL = "struct<caller: string, callee: string, confidence: string, line: int, shell: boolean>"
SYMBOL = "struct<symbol: string, kind: string, line: int, args: array<string>, returns: string, decorators: array<string>, handlers: array<string>, docstring: string, complexity: int, typed: boolean, logic: string>"
PARSED = f"path string, imports array<struct<module: string, line: int>>, calls array<{CALL}>, symbols array<{SYMBOL}>"
BRANCHES = (ast.If, ast.For, ast.While, ast.AsyncFor, ast.ExceptHandler, ast.comprehension)
SCOPES = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)


def dotted(node: ast.expr) -> str:
    """a.b.c of a chain of names, else what its last attribute is called."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        head = dotted(node.value)
        return f"{head}.{node.attr}" if head else node.attr
    return ""


def confidence(node: ast.expr) -> str:
    return "PROVEN" if isinstance(node, ast.Name) and node.id != "getattr" else "INFERRED" if isinstance(node, ast.Attribute) else "UNKNOWN"


def described(node: ast.AST, name: str) -> dict:
    """A function's or a class's row."""
    function = not isinstance(node, ast.ClassDef)
    nodes = list(ast.walk(node))
    args = [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs] if function else []
    typed = [a for i, a in enumerate(args) if not (i == 0 and a.arg in ("self", "cls"))]
    body = node.body[1:] if ast.get_docstring(node, clean=False) is not None else node.body
    return {
        "symbol": name,
        "kind": "function" if function else "class",
        "line": node.lineno,
        "args": [ast.unparse(a) for a in args],
        "returns": ast.unparse(node.returns) if function and node.returns else None,
        "decorators": [ast.unparse(d) for d in node.decorator_list],
        "handlers": [ast.unparse(n.type) if n.type else "" for n in nodes if isinstance(n, ast.ExceptHandler)],
        "docstring": ast.get_docstring(node),
        "complexity": 1 + sum(isinstance(n, BRANCHES) for n in nodes) + sum(len(n.values) - 1 for n in nodes if isinstance(n, ast.BoolOp)),
        "typed": function and node.returns is not None and all(a.annotation is not None for a in typed),
        "logic": hashlib.sha1("\n".join(ast.dump(x) for x in body).encode()).hexdigest(),
    }


def parse(path: str, code: str) -> dict | None:
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError):
        return None
    row: dict = {"path": path, "imports": [], "calls": [], "symbols": []}
    waiting: list[tuple[ast.AST, str]] = [(tree, "")]
    while waiting:
        node, scope = waiting.pop()
        if isinstance(node, SCOPES):
            scope = f"{scope}.{node.name}" if scope else node.name
            row["symbols"].append(described(node, scope))
        elif isinstance(node, ast.Import):
            row["imports"] += [{"module": a.name.split(".")[0], "line": node.lineno} for a in node.names]
        elif isinstance(node, ast.ImportFrom) and node.module and not node.level:
            row["imports"].append({"module": node.module.split(".")[0], "line": node.lineno})
        elif isinstance(node, ast.Call):
            shell = any(k.arg == "shell" and isinstance(k.value, ast.Constant) and k.value.value is True for k in node.keywords)
            row["calls"].append({"caller": scope, "callee": dotted(node.func), "confidence": confidence(node.func), "line": node.lineno, "shell": shell})
        waiting += [(child, scope) for child in ast.iter_child_nodes(node)]
    for part in row.values():
        if isinstance(part, list):
            part.sort(key=lambda x: x["line"])
    return row


def parsed(files: DataFrame) -> DataFrame:
    schema = to_arrow_schema(_parse_datatype_string(PARSED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (r := parse(p, c or "")) is not None]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("path", "code").mapInArrow(run, PARSED)


def imports(files: DataFrame) -> DataFrame:
    return files.select("path", F.explode("imports").alias("x")).select("path", "x.*")


def calls(files: DataFrame) -> DataFrame:
    return files.select("path", F.explode("calls").alias("x")).select("path", "x.*")


def symbols(files: DataFrame) -> DataFrame:
    return files.select("path", F.explode("symbols").alias("x")).select("path", "x.*")


def danger(callee: Column, shell: Column) -> Column:
    """The severity of a call that runs what it is given, or null."""
    last_two = F.regexp_extract(callee, r"([^.]+\.)?[^.]+$", 0)
    runs = callee.contains("subprocess") | last_two.isin("run", "Popen", "call", "check_call", "check_output")
    return F.when(last_two.isin("eval", "exec"), "CRITICAL").when(last_two.isin("pickle.loads", "loads"), "HIGH").when(runs & shell, "HIGH").when(last_two.isin("__import__", "importlib.import_module"), "MEDIUM")


def dangerous(files: DataFrame) -> DataFrame:
    """path, line, callee, severity."""
    return calls(files).withColumn("severity", danger(F.col("callee"), F.col("shell"))).filter("severity IS NOT NULL").select("path", "line", "callee", "severity")


def classified(found: DataFrame, stdlib: DataFrame, local: DataFrame, installed: DataFrame) -> DataFrame:
    """found (module) with kind: STDLIB, LOCAL, THIRD_PARTY or UNKNOWN, in that order; the three others are tables of module."""
    out = found
    for flag, side in (("_s", stdlib), ("_l", local), ("_i", installed)):
        out = out.join(side.select("module").distinct().withColumn(flag, F.lit(True)), "module", "left")
    return out.withColumn("kind", F.when(F.col("_s"), "STDLIB").when(F.col("_l"), "LOCAL").when(F.col("_i"), "THIRD_PARTY").otherwise("UNKNOWN")).drop("_s", "_l", "_i")


#: What a decorator of a web framework ends in.
METHODS = ["get", "post", "put", "patch", "delete", "head", "options"]


def decorator_routes(files: DataFrame) -> DataFrame:
    """path, function, method, route of functions with a decorator ....route('/x', methods=[...]) (GET without methods) or ....get('/x') and the like."""
    each = symbols(files).select("path", F.col("symbol").alias("function"), F.explode("decorators").alias("d"))
    quoted = F.regexp_extract("d", r"^[\w.]+\(\s*[rf]?'([^']*)'", 1)
    verb = F.regexp_extract("d", r"^[\w.]*\.(\w+)\(", 1)
    named = F.regexp_extract_all(F.regexp_extract("d", r"methods\s*=\s*[\[(]([^\])]*)", 1), F.lit(r"'(\w+)'"), 1)
    methods = F.when(verb.isin(METHODS), F.array(F.upper(verb))).when((verb == "route") & (F.size(named) > 0), F.transform(named, F.upper)).when(verb == "route", F.array(F.lit("GET")))
    return each.select("path", "function", F.explode(methods).alias("method"), quoted.alias("route")).filter("route <> ''")
