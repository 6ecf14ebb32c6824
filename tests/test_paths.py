import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.plans.paths import PathQuery, PatternError, braces, expression, ignored, kind, statistics


def slow(pattern, path):
    """Segments matched one by one."""
    def seg(p, s):
        if not p:
            return not s
        if p[0] == "*":
            return any(seg(p[1:], s[k:]) for k in range(len(s) + 1))
        return bool(s) and p[0] in ("?", s[0]) and seg(p[1:], s[1:])

    def go(ps, ss):
        if not ps:
            return not ss
        if ps[0] == "**":
            return go(ps[1:], ss) or bool(ss) and go(ps, ss[1:])
        return bool(ss) and seg(ps[0], ss[0]) and go(ps[1:], ss[1:])

    return go(pattern.split("/"), path.split("/"))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["**", "a", "b", "*", "a*", "?", "*b"]), min_size=1, max_size=5), st.lists(st.sampled_from(["a", "b", "ab", "aab"]), min_size=1, max_size=5))
def test_expression_equals_a_slow_matcher(pattern, path):
    assert bool(re.match(expression("/".join(pattern)), "/".join(path))) == slow("/".join(pattern), "/".join(path))


def test_braces_and_kinds():
    assert braces("a.{rs,toml}") == ["a.rs", "a.toml"]
    assert [kind(p) for p in ("a/b", "a/*.x", "a/**/b", "**/b")] == ["literal", "single_directory", "fixed_prefix", "unbounded"]


@pytest.mark.parametrize("pattern", ["/a", "../a", "C:/a", "[b-a]", "[a"])
def test_errors(pattern):
    with pytest.raises(PatternError):
        expression(pattern)


@pytest.mark.parametrize("pattern", ["{a,{b}}", "{a", "a}"])
def test_brace_errors(pattern):
    with pytest.raises(PatternError):
        braces(pattern)


FILES = ["src/main.rs", "src/lib/a.toml", "src/lib/.hidden/x.rs", "target/y.rs", "README.md", "a[1].txt"]


def files(spark):
    return spark.createDataFrame([(f,) for f in FILES], "path string")


def test_query(spark):
    run = lambda **k: sorted(r.path for r in PathQuery(**k).run(files(spark)).collect())
    assert run(patterns=["**/*.{rs,toml}"], exclude=["target/**"]) == ["src/lib/a.toml", "src/main.rs"]
    assert run(patterns=["**/*.rs"], hidden=True) == ["src/lib/.hidden/x.rs", "src/main.rs", "target/y.rs"]
    assert run(patterns=["README.md"]) == ["README.md"]
    assert run(patterns=["a[[]1].txt"]) == ["a[1].txt"]
    assert run(terms=["main"], extensions=["rs"]) == ["src/main.rs"]
    assert [r.path for r in PathQuery(["**"], sort=True, limit=2).run(files(spark)).collect()] == ["README.md", "a[1].txt"]
    row = statistics(files(spark), PathQuery(["**/*.rs"], exclude=["target/**"])).first()
    assert (row.considered, row.matched, row.hidden, row.excluded) == (6, 1, 1, 1)


def test_ignore_rules(spark):
    rules = spark.createDataFrame([("", "*.rs", 1), ("", "!main.rs", 2), ("src/lib", "a.toml", 3)], "directory string, pattern string, position int")
    assert sorted(r.path for r in ignored(files(spark), rules).collect()) == ["README.md", "a[1].txt", "src/main.rs"]


def test_explain():
    assert "fixed_prefix" in PathQuery(["src/**/x"]).explain()
