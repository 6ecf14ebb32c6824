"""Graph operators over edge frames (src, dst): degrees, depths, reachability, levels, cycles, PageRank."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.storage import discard, written

DAMPING = 0.85
#: Levels that one job of a walk takes while they have so few nodes, and tables after which what was seen is written as one.
LEVELS_AT_ONCE, NARROW = 8, 100_000
TABLES_AT_ONCE = 16


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """node, out_degree, in_degree of every end of an edge, in one aggregate."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.node").agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))


def entry_points(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes that nothing points to."""
    return nodes.join(edges.select(F.col("dst").alias("node")), "node", "left_anti")


def leaves(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("src").alias("node")), "node", "left_anti")


def most_depended_on(edges: DataFrame, most: int = 10) -> DataFrame:
    return degrees(edges).select("node", F.col("in_degree").alias("dependents")).orderBy(F.desc("dependents"), "node").limit(most)


def depths(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """node, depth (a root's is 1), parent (null for a root); unreachable nodes are left out. Of several parents the least is taken.

    Breadth first until no new node is met, however deep that is; a level a job, or several at once where the level is small. Rows stay small:
    chains() builds paths from the parents.
    """
    links = written(edges.select("src", "dst").distinct(), "links")
    parent = F.lit(None).cast(edges.schema["src"].dataType)
    frontier = written(roots.select("node", F.lit(1).alias("depth"), parent.alias("parent")).dropDuplicates(["node"]), "depths")
    seen, depth, tables = frontier, 1, 1
    while (width := frontier.count()) > 0:
        levels_ = LEVELS_AT_ONCE if width <= NARROW else 1
        rows = frontier
        for _ in range(levels_):
            # each row and where it leads, in one pass; what is reached over a node that was seen before has been seen too, so it drops out below
            here = F.struct("node", "depth", F.col("parent").alias("parent"))
            there = F.when(F.col("dst").isNotNull(), F.struct(F.col("dst").alias("node"), (F.col("depth") + 1).alias("depth"), F.col("src").alias("parent")))
            led = rows.join(links, F.col("node") == F.col("src"), "left").select(F.explode(F.array_compact(F.array(here, there))).alias("r"))
            rows = led.groupBy("r.node").agg(F.min(F.struct("r.depth", "r.parent")).alias("_x")).select("node", "_x.depth", "_x.parent")
        found = written(rows.join(seen.select("node"), "node", "left_anti"), "depths")
        depth, tables = depth + levels_, tables + 1
        frontier, seen = found.filter(F.col("depth") == depth), seen.unionByName(found)
        if tables % TABLES_AT_ONCE == 0:  # else the plan grows with the depth
            seen = written(seen, "depths")
    discard(links)
    return seen


def chains(tree: DataFrame, most: int | None = None) -> DataFrame:
    """node, chain (its ancestors from the root on, and itself) of a tree (node, parent), by doubling: as many rounds as the depth has bits.

    most: only so many of the nearest are kept, and an ellipsis before them where they are that many.
    """
    rows = written(tree.select("node", F.array(F.col("node").cast("string")).alias("chain"), F.col("parent").alias("up")), "chains")
    while not (rows.filter("up IS NOT NULL") if most is None else rows.filter(F.col("up").isNotNull() & (F.size("chain") < most))).isEmpty():
        above = rows.select(F.col("node").alias("up"), F.col("chain").alias("_c"), F.col("up").alias("_u"))
        chain = F.concat(F.coalesce("_c", F.array().cast("array<string>")), F.col("chain"))
        before, rows = rows, written(rows.join(above, "up", "left").select("node", (chain if most is None else F.slice(chain, -F.least(F.lit(most), F.size(chain)), F.lit(most))).alias("chain"), F.col("_u").alias("up")), "chains")
        discard(before)
    if most is None:
        return rows.select("node", "chain")
    return rows.select("node", F.when(F.size("chain") >= most, F.concat(F.array(F.lit("…")), "chain")).otherwise(F.col("chain")).alias("chain"))


def blame(tree: DataFrame, hops: int = 64) -> DataFrame:
    """node, chain as it is printed: the way from the root, of a longer one the last nodes after an ellipsis."""
    return chains(tree, hops + 1)


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """start, node for every node that a start (column node) reaches; the start itself only where it lies on a cycle."""
    out = written(starts.select(F.col("node").alias("start")).join(edges, F.col("start") == F.col("src")).select("start", F.col("dst").alias("node")).distinct(), "reached")
    frontier = out
    while not frontier.isEmpty():
        step = frontier.join(edges, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        frontier = written(step.join(out, ["start", "node"], "left_anti"), "frontier")
        out = out.unionByName(frontier)
    return out


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def on_a_cycle(edges: DataFrame) -> DataFrame:
    """Nodes on a cycle: the ends of edges between nodes that reach each other.

    Nodes without a way in, or without a way out, go until none is left. What is left may hold bridges between cycles; there, rounds hand
    the least label forward and backward: nodes with one label both ways are of one strong component, and edges between others go.
    """
    left = edges.distinct()
    before = -1
    while (now := left.count()) != before:
        before = now
        left = written(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"), "cyclic")
    return strong_edges(left).select(F.col("src").alias("node")).distinct()


def least_labels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, label: the least node that reaches it, itself included. A row a node in every round, so a large cycle costs no pairs."""
    rows = written(nodes.select("node", F.col("node").alias("label")), "labels")
    while True:
        handed = edges.join(rows, F.col("src") == F.col("node")).select(F.col("dst").alias("node"), "label")
        after = written(rows.unionByName(handed).groupBy("node").agg(F.min("label").alias("label")), "labels")
        moved = after.join(rows.withColumnRenamed("label", "was"), "node").filter("label <> was")
        done = moved.isEmpty()
        discard(rows)
        rows = after
        if done:
            return rows


def strong_edges(edges: DataFrame) -> DataFrame:
    """The edges inside strong components: of each pair of labels, by the least node that reaches a node and the least that it reaches, one component settles a round."""
    out, left = None, edges
    while not left.isEmpty():
        nodes = nodes_of(left)
        down = least_labels(left, nodes).select("node", F.col("label").alias("down"))
        up = least_labels(reversed_edges(left), nodes).select("node", F.col("label").alias("up"))
        labels = written(down.join(up, "node"), "labels")
        a, b = labels.select(F.col("node").alias("src"), F.col("down").alias("_d"), F.col("up").alias("_u")), labels.select(F.col("node").alias("dst"), F.col("down").alias("_e"), F.col("up").alias("_v"))
        # ends with other labels are of other components; where the least node is reached and reaches, the component is settled
        same = written(left.join(a, "src").join(b, "dst").filter("_d = _e AND _u = _v").select("src", "dst", (F.col("_d") == F.col("_u")).alias("settled")), "same")
        settled = same.filter("settled").select("src", "dst")
        out = settled if out is None else out.unionByName(settled)
        left = same.filter("NOT settled").select("src", "dst")
    return out if out is not None else edges


CYCLE = "members array<string>"


def cycles(edges: DataFrame, most: int | None = None) -> DataFrame:
    """members (the least node first, not repeated at the end) of the cycles that a depth-first walk of the nodes in order closes: a sample, not all simple cycles.

    Only the nodes on a cycle are walked; what lies off any cycle drops out before, and those nodes go to one task, for the walk is one after the other.
    """
    core = on_a_cycle(edges).select("node")
    inner = edges.select("src", "dst").distinct().join(core.withColumnRenamed("node", "src"), "src", "left_semi").join(core.withColumnRenamed("node", "dst"), "dst", "left_semi")
    ways = inner.groupBy(F.col("src").cast("string").alias("node")).agg(F.sort_array(F.collect_list(F.col("dst").cast("string"))).alias("to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = {n: t for batch in batches for n, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())}
        found: dict[tuple[str, ...], None] = {}
        done: set[str] = set()
        for start in sorted(to):
            path, place, waiting = [start], {start: 0}, [iter(to[start])]
            if start in done:
                continue
            while waiting:
                step = next(waiting[-1], None)
                if step is None:
                    waiting.pop()
                    done.add(path[-1])
                    del place[path.pop()]
                elif step in place:
                    ring = path[place[step] :]
                    least = ring.index(min(ring))
                    found.setdefault(tuple(ring[least:] + ring[:least]))
                elif step not in done:
                    place[step] = len(path)
                    path.append(step)
                    waiting.append(iter(to[step]))
        rings = [list(x) for x in found][:most]
        if rings:
            yield pa.record_batch([pa.array(rings, pa.list_(pa.string()))], names=["members"])

    return ways.coalesce(1).mapInArrow(run, CYCLE)


def levels(tasks: DataFrame, needs: DataFrame) -> DataFrame:
    """task, level: 0 for tasks that need none, else one more than the highest need (needs: task, need). Raises on a cycle or an unknown need."""
    known = tasks.select("task")
    if not needs.join(known.withColumnRenamed("task", "need"), "need", "left_anti").isEmpty():
        raise ValueError("a task needs an unknown task")
    out, left, level = None, written(known, "tasks"), 0
    while not left.isEmpty():
        waiting = needs.join(left.withColumnRenamed("task", "need"), "need", "left_semi").select("task")
        ready = written(left.join(waiting, "task", "left_anti").select("task", F.lit(level).alias("level")), "ready")
        if ready.isEmpty():
            ring = cycles(needs.select(F.col("task").alias("src"), F.col("need").alias("dst")), 1).first()
            raise ValueError(f"tasks need each other in a cycle: {' -> '.join([*ring.members, ring.members[0]])}")
        out = ready if out is None else out.unionByName(ready)
        left, level = written(left.join(ready, "task", "left_anti"), "tasks"), level + 1
    return out if out is not None else known.withColumn("level", F.lit(0))


def needed(needs: DataFrame, targets: DataFrame) -> DataFrame:
    """The targets (column task) and all that they need, directly or not."""
    reached = reachable(needs.select(F.col("task").alias("src"), F.col("need").alias("dst")), targets.select(F.col("task").alias("node")))
    return targets.select("task").union(reached.select("node")).distinct()


def affected(needs: DataFrame, changed: DataFrame) -> DataFrame:
    """The changed tasks (column task) and all that need them, directly or not."""
    reached = reachable(needs.select(F.col("need").alias("src"), F.col("task").alias("dst")), changed.select(F.col("task").alias("node")))
    return changed.select("task").union(reached.select("node")).distinct()


def pagerank(edges: DataFrame, rounds: int = 100, tolerance: float | None = 1e-6, nodes: DataFrame | None = None) -> DataFrame:
    """node, rank: uniform start, dangling mass shared by all, repeated edges once; ends after `rounds` or when the ranks move by less than the tolerance in all."""
    links = written(edges.select("src", "dst").distinct(), "links")
    nodes = written(nodes.select("node").distinct() if nodes is not None else nodes_of(links), "nodes")
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    # out-degrees are joined once: each node's share is known where its links are
    fan = links.groupBy("src").agg(F.count("*").alias("fan"))
    ranks = written(nodes.join(fan, nodes["node"] == fan["src"], "left").select("node", "fan", F.lit(1.0 / n).alias("rank"), F.lit(1.0 / n).alias("was")), "ranks")
    for done in range(rounds):
        # two numbers a round come to the driver: what the dangling nodes hold, and how far the ranks moved
        dangling, moved = ranks.agg(F.coalesce(F.sum(F.when(F.col("fan").isNull(), F.col("rank"))), F.lit(0.0)), F.sum(F.abs(F.col("rank") - F.col("was")))).first()
        if done and tolerance is not None and moved < tolerance:
            break
        shares = links.join(ranks.filter("fan IS NOT NULL").select(F.col("node").alias("src"), (F.col("rank") / F.col("fan")).alias("inflow")), "src")
        parts = shares.select(F.col("dst").alias("node"), "inflow", F.lit(None).cast("long").alias("fan"), F.lit(None).cast("double").alias("was")).unionByName(ranks.select("node", F.lit(0.0).alias("inflow"), "fan", F.col("rank").alias("was")))
        before, ranks = ranks, written(parts.groupBy("node").agg(F.max("fan").alias("fan"), ((1 - DAMPING + DAMPING * dangling) / n + DAMPING * F.sum("inflow")).alias("rank"), F.max("was").alias("was")), "ranks")
        discard(before)
    return ranks.select("node", "rank")


def scaled_rank(ranks: DataFrame) -> DataFrame:
    """rank divided by the largest; all 0 if that is 0."""
    most = ranks.agg(F.max("rank").alias("_m"))
    return ranks.crossJoin(most).select("node", F.when(F.col("_m") > 0, F.col("rank") / F.col("_m")).otherwise(0.0).alias("rank"))


#: What the name of a caller holds that serves a route.
ROUTE_WORDS = ["route", "api", "endpoint", "view", "handler"]


def impact(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """symbol, direct, transitive (callers beyond the direct ones), tests (test_ begins the last part), routes (by words in the name) of the column node of `symbols`."""
    back = reversed_edges(calls)
    direct = back.select(F.col("src").alias("start"), F.col("dst").alias("node"), F.lit(True).alias("direct")).distinct()
    rows = reachable(back, symbols).join(direct, ["start", "node"], "left")
    number = lambda c: F.count_if(c)
    near = F.coalesce("direct", F.lit(False))
    return rows.groupBy(F.col("start").alias("symbol")).agg(number(near).alias("direct"), number(~near).alias("transitive"), number(F.col("node").rlike(r"(^|\.)test_[^.]*$")).alias("tests"), number(F.col("node").rlike("|".join(ROUTE_WORDS))).alias("routes"))


def adjacency(calls: DataFrame) -> DataFrame:
    """node, callers, callees (distinct, in order) and sites: how many calls lead to it, repeated ones counted."""
    ends = calls.select(F.col("dst").alias("node"), F.col("src").alias("caller"), F.lit(None).cast("string").alias("callee")).unionByName(calls.select(F.col("src").alias("node"), F.lit(None).cast("string").alias("caller"), F.col("dst").alias("callee")))
    return ends.groupBy("node").agg(F.sort_array(F.collect_set("caller")).alias("callers"), F.sort_array(F.collect_set("callee")).alias("callees"), F.count("caller").alias("sites"))


def named(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """asked, node: the node of that name, else the first whose last part it is, else the first that holds it; a name without any gives no row.

    The first two are equi-joins; only what these leave is searched as text, against the distinct names.
    """
    last = F.element_at(F.split("node", "\\."), -1)
    exact = asked.join(nodes.select(F.col("node").alias("asked"), "node"), "asked").select("asked", "node", F.lit(0).alias("rank"))
    short = asked.join(nodes.select(last.alias("asked"), "node"), "asked").select("asked", "node", F.lit(1).alias("rank"))
    known = exact.unionByName(short)
    part = asked.join(known.select("asked").distinct(), "asked", "left_anti").join(nodes, F.contains(F.col("node"), F.col("asked"))).select("asked", "node", F.lit(2).alias("rank"))
    return known.unionByName(part).groupBy("asked").agg(F.min_by("node", F.struct("rank", "node")).alias("node"))
