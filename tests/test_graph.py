import pytest

from tessera.operators import graph


def edges(spark, *pairs):
    return spark.createDataFrame([(a, b) for a, b in pairs], "src string, dst string")


def nodes(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def test_pagerank(spark):
    ranks = {r.node: r["rank"] for r in graph.pagerank(edges(spark, "ab", "bc", "ca")).collect()}
    assert all(v == pytest.approx(1 / 3) for v in ranks.values())
    ranks = {r.node: r["rank"] for r in graph.pagerank(edges(spark, "ab", "ac", "ab")).collect()}
    assert sum(ranks.values()) == pytest.approx(1) and ranks["b"] == pytest.approx(ranks["c"]) and ranks["b"] > ranks["a"]
    assert graph.pagerank(edges(spark)).count() == 0
    assert graph.pagerank(edges(spark), nodes=nodes(spark, "x")).first()["rank"] == pytest.approx(1)
    assert all(r["rank"] == pytest.approx(1.0) for r in graph.scaled_rank(graph.pagerank(edges(spark, "ab", "ba"))).collect())


def test_degrees(spark):
    got = {r.node: (r.out_degree, r.in_degree) for r in graph.degrees(edges(spark, "ab", "ac", "cb")).collect()}
    assert got == {"a": (2, 0), "b": (0, 2), "c": (1, 1)}
    assert [r.node for r in graph.entry_points(edges(spark, "ab"), nodes(spark, "a", "b", "z")).orderBy("node").collect()] == ["a", "z"]
    assert [r.node for r in graph.leaves(edges(spark, "ab"), nodes(spark, "a", "b", "z")).orderBy("node").collect()] == ["b", "z"]


def test_depths_on_a_cyclic_graph(spark):
    tree = graph.depths(edges(spark, "ab", "bc", "ca", "ad", "dc"), nodes(spark, "a"))
    assert {r.node: (r.depth, r.parent) for r in tree.collect()} == {"a": (1, None), "b": (2, "a"), "d": (2, "a"), "c": (3, "b")}
    assert {r.node: r.chain for r in graph.chains(tree).collect()} == {"a": ["a"], "b": ["a", "b"], "d": ["a", "d"], "c": ["a", "b", "c"]}


def test_depths_have_no_bound_and_blame_is_cut(spark):
    chain = [f"n{i:03}" for i in range(81)]
    tree = graph.depths(spark.createDataFrame(list(zip(chain, chain[1:])), "src string, dst string"), nodes(spark, chain[0]))
    assert {r.node: r.depth for r in tree.collect()} == {n: i + 1 for i, n in enumerate(chain)}
    assert {r.node: r.chain for r in graph.chains(tree).collect()} == {n: chain[: i + 1] for i, n in enumerate(chain)}
    shown = {r.node: r.chain for r in graph.blame(tree).collect()}
    assert shown["n063"] == chain[:64] and shown["n064"] == ["…", *chain[:65]] and shown["n080"] == ["…", *chain[16:]]


def test_reachable_counts_the_start_on_a_cycle_only(spark):
    got = sorted((r.start, r.node) for r in graph.reachable(edges(spark, "ab", "bc", "cb"), nodes(spark, "a", "b")).collect())
    assert got == [("a", "b"), ("a", "c"), ("b", "b"), ("b", "c")]


def test_cycles(spark):
    assert sorted(r.node for r in graph.on_a_cycle(edges(spark, "ab", "bc", "ca", "cd", "de", "xa", "ff")).collect()) == ["a", "b", "c", "f"]
    assert graph.on_a_cycle(edges(spark, "ab", "bc")).count() == 0
    # a bridge between two cycles lies on none
    assert sorted(r.node for r in graph.on_a_cycle(edges(spark, "ab", "ba", "bx", "xy", "yc", "cd", "dc")).collect()) == ["a", "b", "c", "d"]


def test_cycle_lists(spark):
    found = lambda *pairs: sorted(r.members for r in graph.cycles(edges(spark, *pairs)).collect())
    assert found("bc", "ca", "ab", "xy", "yx", "zq") == [["a", "b", "c"], ["x", "y"]]
    assert found("ff", "ab") == [["f"]] and found("ab") == []
    assert found("ab", "ba", "ac", "ca") == [["a", "b"], ["a", "c"]]
    assert graph.cycles(edges(spark, "ab", "ba", "cd", "dc"), 1).count() == 1


def test_levels(spark):
    tasks = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "task string")
    needs = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a")], "task string, need string")
    assert {r.task: r.level for r in graph.levels(tasks, needs).collect()} == {"a": 0, "d": 0, "b": 1, "c": 2}
    assert sorted(r.task for r in graph.affected(needs, spark.createDataFrame([("a",)], "task string")).collect()) == ["a", "b", "c"]
    with pytest.raises(ValueError, match="in a cycle: a -> c -> a"):
        graph.levels(tasks, needs.union(spark.createDataFrame([("a", "c")], needs.schema)))
    with pytest.raises(ValueError, match="unknown"):
        graph.levels(tasks, needs.union(spark.createDataFrame([("a", "zz")], needs.schema)))
