"""Queries of graph operators: deep trees, chains, cycles, levels, affected tasks, call graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import graph
from tessera.plans.paths import expression
from tessera.queries.base import Rows, query

DEEP = 75
#: A chain of DEEP nodes with short cuts to every 50th from the 20 before it, and a ring at its end.
_CHAIN = f"SELECT printf('n%03d', i) AS src, printf('n%03d', i + 1) AS dst FROM range({DEEP - 1}) t(i) UNION ALL SELECT printf('n%03d', i), printf('n%03d', i + 3) FROM range({DEEP - 3}) t(i) WHERE i % 50 = 20 UNION ALL SELECT printf('n%03d', {DEEP - 1}), 'n060'"


def deep_edges(spark):
    name = lambda c: F.format_string("n%03d", c)
    i = F.col("id")
    steps = spark.range(DEEP - 1).select(name(i).alias("src"), name(i + 1).alias("dst"))
    cuts = spark.range(DEEP - 3).filter(i % 50 == 20).select(name(i).alias("src"), name(i + 3).alias("dst"))
    return steps.unionByName(cuts).unionByName(spark.range(1).select(name(F.lit(DEEP - 1)).alias("src"), F.lit("n060").alias("dst")))


def deep_tree(spark):
    return graph.depths(deep_edges(spark), spark.createDataFrame([("n000",)], "node string"))


# the recursion goes on over the depth, so that all ways of one length are one row
_DEPTHS = f"""e AS ({_CHAIN}), w(node, depth) AS (SELECT 'n000', 1 UNION SELECT dst, depth + 1 FROM w JOIN e ON node = src WHERE depth < {DEEP + 5}),
d AS (SELECT node, min(depth) AS depth FROM w GROUP BY node), t AS (SELECT d.node, d.depth, (SELECT min(p.node) FROM d p JOIN e ON p.node = e.src WHERE e.dst = d.node AND p.depth = d.depth - 1) AS parent FROM d)"""


@query(f"WITH RECURSIVE {_DEPTHS} SELECT node, CAST(depth AS INTEGER) AS depth, parent FROM t")
def graph_deep_depths(t, spark, d):
    """G2 far beyond 64 levels, with several ways and a ring."""
    return deep_tree(spark).select("node", "depth", "parent")


@query(f"""
WITH RECURSIVE {_DEPTHS}, c(node, chain, up, hops) AS (SELECT node, [node], parent, 1 FROM t UNION ALL SELECT c.node, list_prepend(t.node, chain), t.parent, hops + 1 FROM c JOIN t ON c.up = t.node WHERE hops <= 64)
SELECT node, CASE WHEN hops = 65 THEN '… > ' ELSE '' END || array_to_string(chain, ' > ') AS chain FROM c WHERE up IS NULL OR hops = 65
""")
def graph_blame(t, spark, d):
    """Chains from the root, of long ones the last 65 nodes after an ellipsis."""
    return graph.blame(deep_tree(spark)).select("node", F.array_join("chain", " > ").alias("chain"))


RINGS = Rows("src string, dst string", [("b", "c"), ("c", "a"), ("a", "b"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "d"), ("g", "g"), ("x", "a"), ("f", "z"), ("h", "i"), ("i", "h"), ("i", "j"), ("j", "i")])
_SIMPLE = f"""e AS {RINGS}, w(start, node, path) AS (SELECT src, dst, [src] FROM e WHERE dst >= src UNION ALL SELECT start, dst, list_append(path, node) FROM w JOIN e ON node = src WHERE node <> start AND NOT list_contains(path, node) AND dst >= start),
r AS (SELECT DISTINCT path FROM w WHERE node = start)"""


@query(f"WITH RECURSIVE {_SIMPLE} SELECT array_to_string(path, ' -> ') AS cycle, CAST(len(path) AS INTEGER) AS nodes FROM r")
def graph_cycles(t, spark, d):
    """Cycles, the least node first (here a depth-first walk closes all simple ones)."""
    return graph.cycles(RINGS.frame(spark)).select(F.array_join("members", " -> ").alias("cycle"), F.size("members").alias("nodes"))


@query(f"WITH RECURSIVE {_SIMPLE} SELECT DISTINCT unnest(path) AS node FROM r")
def graph_cyclic_nodes(t, spark, d):
    """G4 as a flag: the nodes that lie on a cycle, without bridges."""
    return graph.on_a_cycle(RINGS.frame(spark))


TASKS = Rows("task string, inputs string, weight long", [("lint", "src/**/*.py", 1), ("build", "src/**", 5), ("test", "tests/**", 7), ("docs", "docs/*.md", 2), ("pack", "setup.cfg", 3), ("ship", "", 1), ("notes", "docs/notes/**", 1)])
NEEDS = Rows("task string, need string", [("test", "build"), ("test", "lint"), ("pack", "build"), ("pack", "docs"), ("ship", "pack"), ("ship", "test"), ("ship", "build")])
CHANGED = Rows("path string", [("docs/guide.md",), ("docs/notes/a/b.txt",), ("README",)])


@query(f"""
WITH RECURSIVE n AS {NEEDS}, w(task, level) AS (SELECT task, 0 FROM {TASKS} WHERE task NOT IN (SELECT task FROM n) UNION SELECT n.task, level + 1 FROM w JOIN n ON w.task = n.need)
SELECT CAST(level AS INTEGER) AS level, string_agg(task, ' ' ORDER BY task) AS tasks FROM (SELECT task, max(level) AS level FROM w GROUP BY task) GROUP BY level
""")
def dag_levels(t, spark, d):
    """Levels with the names in order."""
    rows = graph.levels(TASKS.frame(spark).select("task"), NEEDS.frame(spark))
    return rows.groupBy("level").agg(F.array_join(F.sort_array(F.collect_list("task")), " ").alias("tasks"))


@query(f"""
WITH RECURSIVE n AS {NEEDS}, w(target, task) AS (SELECT task, task FROM {TASKS} WHERE task IN ('test', 'pack') UNION SELECT target, need FROM w JOIN n ON w.task = n.task)
SELECT DISTINCT task FROM w
""")
def dag_needed(t, spark, d):
    """What two targets need, themselves among it."""
    return graph.needed(NEEDS.frame(spark), spark.createDataFrame([("test",), ("pack",)], "task string"))


_DIRECT = rf"""g AS (SELECT task, '^' || CASE inputs WHEN 'src/**/*.py' THEN 'src/(?:[^/]+/)*[^/]*\.py' WHEN 'src/**' THEN 'src(?:/[^/]+)*' WHEN 'tests/**' THEN 'tests(?:/[^/]+)*' WHEN 'docs/*.md' THEN 'docs/[^/]*\.md' WHEN 'docs/notes/**' THEN 'docs/notes(?:/[^/]+)*' ELSE inputs END || '$' AS re FROM {TASKS} WHERE inputs <> ''),
x AS (SELECT DISTINCT g.task, path FROM g JOIN {CHANGED} c ON regexp_matches(path, re))"""


def directly_changed(spark):
    """Tasks whose pattern a changed path fits; a row a pair. The patterns become one predicate each, so the changed paths are read once a task's pattern and not joined."""
    paths, out = CHANGED.frame(spark), None
    for task, inputs, _ in TASKS.rows:
        if inputs:
            rows = paths.filter(F.col("path").rlike(expression(inputs))).select(F.lit(task).alias("task"), "path")
            out = rows if out is None else out.unionByName(rows)
    return out


@query(f"WITH {_DIRECT} SELECT task, path FROM x")
def dag_changed_globs(t, spark, d):
    """J24."""
    return directly_changed(spark)


@query(f"WITH RECURSIVE {_DIRECT}, w(task) AS (SELECT task FROM x UNION SELECT n.task FROM w JOIN {NEEDS} n ON n.need = w.task) SELECT task FROM w")
def dag_affected(t, spark, d):
    """Tasks with a changed input, and all that need them."""
    return graph.affected(NEEDS.frame(spark), directly_changed(spark).select("task").distinct())


@query("""
WITH e AS (SELECT DISTINCT o_custkey, l_suppkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey), r AS (SELECT l_suppkey AS node, count(*) AS rank FROM e GROUP BY 1)
SELECT node, round(rank / (SELECT max(rank) FROM r), 6) AS rank FROM r
""")
def graph_scaled_rank(t, spark, d):
    """Ranks by the largest."""
    edges = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_suppkey").distinct()
    ranks = edges.groupBy(F.col("l_suppkey").alias("node")).agg(F.count("*").alias("rank"))
    return graph.scaled_rank(ranks).select("node", F.round("rank", 6).alias("rank"))


CALLS = Rows("src string, dst string", [("app.main", "app.load"), ("app.main", "auth.login"), ("auth.login", "auth.check"), ("auth.check", "db.get"), ("app.load", "db.get"), ("tests.test_check", "auth.check"), ("tests.test_main", "app.main"), ("api.route_login", "auth.login"), ("db.get", "db.retry"), ("db.retry", "db.get")])


@query(f"""
WITH RECURSIVE e AS {CALLS}, w(start, node, depth) AS (SELECT dst, src, 1 FROM e UNION SELECT start, e.src, least(depth + 1, 2) FROM w JOIN e ON e.dst = w.node),
u AS (SELECT start, node, min(depth) AS depth FROM w GROUP BY 1, 2)
SELECT start AS symbol, count(*) FILTER (depth = 1) AS direct, count(*) FILTER (depth > 1) AS transitive, count(*) FILTER (regexp_matches(node, '(^|\\.)test_[^.]*$')) AS tests, count(*) FILTER (regexp_matches(node, 'route|api|endpoint|view|handler')) AS routes FROM u WHERE start IN ('db.get', 'auth.check', 'auth.login') GROUP BY start
""")
def graph_impact(t, spark, d):
    """G11 on G10 backwards: direct and transitive callers, tests, routes."""
    starts = spark.createDataFrame([("db.get",), ("auth.check",), ("auth.login",)], "node string")
    return graph.impact(CALLS.frame(spark), starts)


@query(f"WITH RECURSIVE e AS {CALLS}, w(start, node) AS (SELECT src, dst FROM e UNION SELECT start, e.dst FROM w JOIN e ON e.src = w.node) SELECT start, node FROM w")
def graph_forward_reach(t, spark, d):
    """G10 forward from every node: the start itself only on a cycle."""
    edges = CALLS.frame(spark)
    return graph.reachable(edges, graph.nodes_of(edges))


@query(f"""
WITH e AS {CALLS}, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e)
SELECT node, coalesce((SELECT string_agg(DISTINCT src, ' ' ORDER BY src) FROM e WHERE dst = node), '') AS callers, coalesce((SELECT string_agg(DISTINCT dst, ' ' ORDER BY dst) FROM e WHERE src = node), '') AS callees,
  (SELECT count(*) FROM e WHERE dst = node) AS sites FROM n
""")
def graph_adjacency(t, spark, d):
    """Callers and callees of each node, and the number of call sites."""
    return graph.adjacency(CALLS.frame(spark)).select("node", F.array_join("callers", " ").alias("callers"), F.array_join("callees", " ").alias("callees"), "sites")


ASKED = Rows("asked string", [("db.get",), ("login",), ("chec",), ("test_main",), ("nothing",), ("main",)])


@query(f"""
WITH e AS {CALLS}, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
c AS (SELECT asked, node, CASE WHEN node = asked THEN 0 WHEN regexp_extract(node, '[^.]+$') = asked THEN 1 WHEN contains(node, asked) THEN 2 END AS rank FROM {ASKED} a, n)
SELECT asked, arg_min(node, (rank, node)) AS node FROM c WHERE rank IS NOT NULL GROUP BY asked
""")
def graph_name_lookup(t, spark, d):
    """The node itself, else the first with that last part, else the first that holds the text."""
    return graph.named(graph.nodes_of(CALLS.frame(spark)), ASKED.frame(spark))
