"""Path patterns compiled to column predicates: **, *, ?, classes, flat braces; names, types, extensions, ignore rules."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class PatternError(ValueError):
    """A pattern that the language doesn't allow."""


def braces(pattern: str) -> list[str]:
    """The alternatives of flat {a,b} groups; nested or open braces are errors."""
    head, found, rest = pattern.partition("{")
    if "}" in head:
        raise PatternError(f"unmatched brace in {pattern}")
    if not found:
        return [pattern]
    inner, closed, tail = rest.partition("}")
    if not closed or "{" in inner:
        raise PatternError(f"nested or open brace in {pattern}")
    return [head + x + y for x in inner.split(",") for y in braces(tail)]


def _class(text: str, at: int) -> tuple[str, int]:
    """The regular expression of the class that opens at `at`, and the place after it."""
    k, negated, items = at + 1, False, []
    if text[k : k + 1] in ("!", "^") and k < len(text):
        negated, k = True, k + 1
    first = True
    while True:
        if k >= len(text):
            raise PatternError("open class")
        if text[k] == "]" and not first:
            break
        first = False
        if text[k + 1 : k + 2] == "-" and text[k + 2 : k + 3] not in ("", "]"):
            if text[k] > text[k + 2]:
                raise PatternError("descending range")
            items.append(f"\\x{{{ord(text[k]):x}}}-\\x{{{ord(text[k + 2]):x}}}")
            k += 3
        else:
            items.append(f"\\x{{{ord(text[k]):x}}}")
            k += 1
    return ("(?!/)[" + ("^" if negated else "") + "".join(items) + "]"), k + 1


def segment(text: str) -> str:
    out, k = [], 0
    while k < len(text):
        if text[k] == "*":
            out.append("[^/]*")
        elif text[k] == "?":
            out.append("[^/]")
        elif text[k] == "[":
            part, k = _class(text, k)
            out.append(part)
            continue
        else:
            out.append(re.sub(r"([^\w/])", r"\\\1", text[k]))
        k += 1
    return "".join(out)


def expression(pattern: str) -> str:
    """The anchored regular expression of one pattern without braces."""
    text = pattern.replace("\\", "/")
    if text.startswith("/") or re.match("[A-Za-z]:", text):
        raise PatternError("patterns are relative")
    parts = [p for p in text.split("/") if p not in ("", ".")]
    if ".." in parts:
        raise PatternError("patterns stay below their root")
    parts = [p for i, p in enumerate(parts) if not (p == "**" and i and parts[i - 1] == "**")]
    if parts == ["**"]:
        return "^(?:[^/]+(?:/[^/]+)*)?$"
    out, joined = "", True  # joined: no slash is due before the next segment
    for i, part in enumerate(parts):
        if part == "**":
            if i == len(parts) - 1:
                out += "(?:/[^/]+)*"
            else:
                out += ("" if joined else "/") + "(?:[^/]+/)*"
                joined = True
        else:
            out += ("" if joined else "/") + segment(part)
            joined = False
    return f"^{out}$"


def kind(pattern: str) -> str:
    """How a pattern can be searched: literal, single_directory, fixed_prefix or unbounded."""
    parts = pattern.split("/")
    special = lambda p: bool(re.search(r"[*?\[{]", p))
    if not any(map(special, parts)):
        return "literal"
    if "**" not in parts and not any(map(special, parts[:-1])):
        return "single_directory"
    return "fixed_prefix" if not special(parts[0]) else "unbounded"


def matches(path: Column, patterns: list[str]) -> Column:
    """Whether any pattern matches. Literal patterns are an IN list and a fixed prefix a starts-with test, both of which can be pushed to a scan."""
    every = [p for x in patterns for p in braces(x)]
    literal = [p for p in every if kind(p) == "literal"]
    out = path.isin(literal) if literal else F.lit(False)
    for p in every:
        if kind(p) != "literal":
            test = path.rlike(expression(p))
            prefix = re.match(r"([^*?\[{]*/)", p)
            out = out | (path.startswith(prefix[1].rstrip("/")) & test if prefix else test)
    return out


@dataclass
class PathQuery:
    patterns: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    terms: list[str] = field(default_factory=list)
    extensions: list[str] = field(default_factory=list)
    types: list[str] = field(default_factory=list)
    hidden: bool = False
    limit: int | None = None
    sort: bool = False

    def predicate(self, path: str = "path", type_: str | None = None) -> Column:
        p = F.col(path)
        name = F.element_at(F.split(p, "/"), -1)
        out = matches(p, self.patterns) if self.patterns else F.lit(True)
        if self.exclude:
            out = out & ~matches(p, self.exclude)
        if self.terms:
            any_term = F.lit(False)
            for term in self.terms:
                any_term = any_term | name.contains(term)
            out = out & any_term
        if self.extensions:
            out = out & F.regexp_extract(name, r"\.([^.]*)$", 1).isin(self.extensions)
        if not self.hidden:
            out = out & ~p.rlike(r"(^|/)\.")
        if self.types and type_:
            out = out & F.col(type_).isin(self.types)
        return out

    def run(self, files: DataFrame, path: str = "path", type_: str | None = None, *tie: str) -> DataFrame:
        """Sorted before it is limited."""
        out = files.filter(self.predicate(path, type_))
        if self.sort:
            out = out.orderBy(path, *tie)
        return out if self.limit is None else out.limit(self.limit)

    def explain(self) -> str:
        lines = [f"{kind(p):17} {p}" for x in self.patterns or ["**/*"] for p in braces(x)]
        return "\n".join([*lines, *(f"exclude           {x}" for x in self.exclude), f"hidden            {self.hidden}", f"limit             {self.limit}"])


COMPILED = "directory string, regex string, ignores boolean, position long"


def compiled_rules(rules: DataFrame) -> DataFrame:
    """COMPILED of ignore rules (directory, pattern, position): a bare name matches at any depth below its directory, and all that lies below a match is matched too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for directory, pattern, position in zip(*(c.to_pylist() for c in batch.columns)):
                text = pattern.strip()
                if not text or text.startswith("#"):
                    continue
                ignores, text, base = not text.startswith("!"), text.lstrip("!").rstrip("/"), directory.strip("/")
                deep = (f"{base}/" if base else "") + (text.lstrip("/") if "/" in text else f"**/{text}")
                out += [(base, expression(p), ignores, position) for x in (deep, f"{deep}/**") for p in braces(x)]
            if out:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.string(), pa.bool_(), pa.int64()))], names=["directory", "regex", "ignores", "position"])

    return rules.select("directory", "pattern", F.col("position").cast("long")).mapInArrow(run, COMPILED)


def ignored(files: DataFrame, rules: DataFrame, path: str = "path") -> DataFrame:
    """files without those whose last matching ignore rule isn't a ! rule.

    Rules are a table, met by the directories above a path; so a path is tried against the rules of its own directories only, however many there are.
    """
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    tried = files.select(path, F.explode(above).alias("directory")).join(compiled_rules(rules), "directory").filter(F.rlike(F.col(path), F.col("regex")))
    gone = tried.groupBy(path).agg(F.max_by("ignores", "position").alias("_gone")).filter("_gone").select(path)
    return files.join(gone, path, "left_anti")


def statistics(files: DataFrame, query: PathQuery, path: str = "path") -> DataFrame:
    """considered, matched, hidden, excluded: counters of one pass."""
    p = F.col(path)
    return files.agg(F.count("*").alias("considered"), F.count_if(query.predicate(path)).alias("matched"), F.count_if(p.rlike(r"(^|/)\.")).alias("hidden"), F.count_if(matches(p, query.exclude) if query.exclude else F.lit(False)).alias("excluded"))
