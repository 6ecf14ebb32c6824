"""The queries of the library's operators on the standard tables, and the SQL that each is held against.

Doubles are rounded on both sides; every top-k ends its order with a unique key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import TOKEN_RUN, log_pattern, skeleton
from tessera.operators import changelog, graph, logs, names, rules, search, secrets, sessions, snapshots
from tessera.plans.paths import PathQuery
from tessera.queries import codebase, files, graphs, packages, stores, texts
from tessera.queries.base import QUERIES, SQL, query
from tessera.streaming import replay

__all__ = ["QUERIES", "SQL", "codebase", "files", "graphs", "packages", "stores", "texts"]

QUERY_TEXT = "the hand tion"
PAGERANK_ROUNDS = 10
AS_OF = "2024-01-20 00:00:00"


def log_lines(t: Callable) -> DataFrame:
    """events as log lines: errors stay errors, sign-ups are warnings, the rest information."""
    kind = F.col("event_type")
    return t("events").select("user_id", "ts", F.when(kind == "error", "ERROR").when(kind == "signup", "WARNING").otherwise("INFO").alias("level"))


@query("SELECT upper(event_type) AS level, count(*) AS n FROM events GROUP BY 1")
def log_level_counts(t, spark, d):
    return logs.level_counts(t("events").select(F.upper("event_type").alias("level")))


@query("SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, hour LIMIT 5")
def log_busiest_hours(t, spark, d):
    return logs.busiest_hours(t("events").select("ts"))


@query("""
WITH c AS (SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'signup') AS warnings FROM events GROUP BY user_id)
SELECT user_id, total, errors, warnings, greatest(0, least(100, 100 - 7 * errors - 2 * warnings)) AS score,
  CASE WHEN greatest(0, least(100, 100 - 7 * errors - 2 * warnings)) >= 85 THEN 'HEALTHY' WHEN greatest(0, least(100, 100 - 7 * errors - 2 * warnings)) >= 65 THEN 'STABLE WITH WARNINGS'
  WHEN greatest(0, least(100, 100 - 7 * errors - 2 * warnings)) >= 40 THEN 'NEEDS ATTENTION' ELSE 'CRITICAL' END AS status FROM c
""")
def log_health(t, spark, d):
    return logs.health(log_lines(t), "user_id").select("user_id", "total", "errors", "warnings", "score", "status")


@query(r"""
SELECT trim(regexp_replace(regexp_replace(lower(url), '\b\d+\b', '<number>', 'g'), '\b[a-f0-9]{8,}\b', '<id>', 'g')) AS pattern, count(*) AS n
FROM pages GROUP BY 1 ORDER BY n DESC, min(page_id), pattern LIMIT 5
""")
def log_patterns(t, spark, d):
    lines = t("pages").select(F.lit("ERROR").alias("level"), F.col("url").alias("message"), "page_id")
    return logs.error_patterns(lines, F.col("page_id"))


_STOP = ", ".join(f"'{w}'" for w in ("a an the is are was were be been being have has had do does did will would shall should may might must can could to of in for on with at by from as into through and but or not if then that this it its self").split())
_TOKENS = rf"list_filter(regexp_split_to_array(lower(regexp_replace(text, '([a-z])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda t: length(t) >= 2 AND NOT list_contains([{_STOP}], t))"


@query(f"""
WITH d AS (SELECT doc_id, {_TOKENS} AS t FROM documents),
p AS (SELECT doc_id, unnest(t) AS term FROM d), f AS (SELECT doc_id, term, count(*) AS tf FROM p WHERE term IN ('hand', 'tion') GROUP BY 1, 2),
c AS (SELECT count(*) AS n, avg(len(t)) AS a FROM d), df AS (SELECT term, count(*) AS df FROM f GROUP BY 1)
SELECT f.doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / greatest(a, 1)))), 6) AS score
FROM f JOIN d ON f.doc_id = d.doc_id JOIN df ON f.term = df.term, c GROUP BY f.doc_id ORDER BY sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / greatest(a, 1)))) DESC, f.doc_id LIMIT 20
""")
def text_bm25_topk(t, spark, d):
    return search.top(search.bm25(t("documents"), "doc_id", "text", QUERY_TEXT), "doc_id").select("doc_id", F.round("score", 6).alias("score"))


@query(f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) GROUP BY term HAVING count(DISTINCT doc_id) >= 5")
def text_token_df(t, spark, d):
    return search.document_frequency(t("documents"), "text").filter("df >= 5")


def purchases(t) -> DataFrame:
    """customer -> part edges, each once; parts have no way out."""
    rows = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")).distinct()


_EDGES = "e AS (SELECT DISTINCT concat('c', o_custkey) AS src, concat('p', l_partkey) AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"
_RANKS = ",\n".join(f"r{k} AS (SELECT node, 0.15 / n + 0.85 * (SELECT sum(rank) FROM r{k - 1} WHERE node NOT IN (SELECT src FROM f)) / n + 0.85 * coalesce(i, 0) AS rank FROM v, c, LATERAL (SELECT 1) LEFT JOIN (SELECT dst, sum(rank / fan) AS i FROM e JOIN f ON e.src = f.src JOIN r{k - 1} ON e.src = node GROUP BY dst) x ON x.dst = v.node)".replace("FROM v, c, LATERAL (SELECT 1) LEFT JOIN", "FROM (SELECT * FROM v, c) v LEFT JOIN") for k in range(1, PAGERANK_ROUNDS + 1))


@query(f"""
WITH {_EDGES}, v AS (SELECT src AS node FROM e UNION SELECT dst FROM e), c AS (SELECT count(*) AS n FROM v), f AS (SELECT src, count(*) AS fan FROM e GROUP BY 1),
r0 AS (SELECT node, 1.0::DOUBLE / n AS rank FROM v, c),
{_RANKS}
SELECT node, round(rank, 8) AS rank FROM r{PAGERANK_ROUNDS}
""")
def graph_pagerank(t, spark, d):
    return graph.pagerank(purchases(t), PAGERANK_ROUNDS, None).select("node", F.round("rank", 8).alias("rank"))


@query(f"WITH {_EDGES} SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY node")
def graph_degrees(t, spark, d):
    return graph.degrees(purchases(t))


@query(f"WITH {_EDGES} SELECT dst AS node, count(*) AS dependents FROM e GROUP BY 1 ORDER BY dependents DESC, node LIMIT 10")
def graph_most_depended_on(t, spark, d):
    return graph.most_depended_on(purchases(t))


def places(t) -> DataFrame:
    """region -> nation -> customer -> order edges."""
    return (
        t("nation").select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"))
        .unionByName(t("customer").select(F.concat(F.lit("n"), "c_nationkey").alias("src"), F.concat(F.lit("c"), "c_custkey").alias("dst")))
        .unionByName(t("orders").select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("o"), "o_orderkey").alias("dst")))
    )


_PLACES = """e AS (SELECT concat('r', n_regionkey) AS src, concat('n', n_nationkey) AS dst FROM nation UNION ALL SELECT concat('n', c_nationkey), concat('c', c_custkey) FROM customer
UNION ALL SELECT concat('c', o_custkey), concat('o', o_orderkey) FROM orders)"""


@query(f"""
WITH RECURSIVE {_PLACES}, w AS (SELECT concat('r', r_regionkey) AS node, 1 AS depth, concat('r', r_regionkey) AS path FROM region UNION ALL SELECT dst, depth + 1, path || '/' || dst FROM w JOIN e ON node = src)
SELECT node, depth, path FROM w
""")
def graph_depths(t, spark, d):
    roots = t("region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"))
    tree = graph.depths(places(t), roots)
    return tree.select("node", "depth").join(graph.chains(tree), "node").select("node", "depth", F.array_join("chain", "/").alias("path"))


@query(f"""
WITH RECURSIVE {_PLACES}, w AS (SELECT concat('n', n_nationkey) AS start, concat('n', n_nationkey) AS node FROM nation UNION SELECT start, dst FROM w JOIN e ON node = src)
SELECT start, count(*) AS reached FROM w WHERE node <> start GROUP BY start
""")
def graph_reachable(t, spark, d):
    starts = t("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"))
    return graph.reachable(places(t), starts).groupBy("start").agg(F.count("*").alias("reached"))


@query(f"WITH {_EDGES} SELECT count(*) AS entry_points FROM (SELECT src AS node FROM e UNION SELECT dst FROM e) WHERE node NOT IN (SELECT dst FROM e)")
def graph_entry_points(t, spark, d):
    edges = purchases(t)
    return graph.entry_points(edges, graph.nodes_of(edges)).agg(F.count("*").alias("entry_points"))


@query("""
WITH p AS (SELECT DISTINCT p_name FROM part WHERE p_name IS NOT NULL)
SELECT a.p_name AS a, b.p_name AS b, CAST(levenshtein(a.p_name, b.p_name) AS INTEGER) AS distance FROM p a JOIN p b ON a.p_name < b.p_name AND abs(length(a.p_name) - length(b.p_name)) <= 2 WHERE levenshtein(a.p_name, b.p_name) <= 2
""")
def fuzzy_near_names(t, spark, d):
    return names.near_pairs(t("part"), "p_name")


@query("""
WITH p AS (SELECT DISTINCT p_name FROM part WHERE p_name IS NOT NULL UNION SELECT unnest(['abcdef', 'badcef', 'red blot', 'edr bolt', 'tinw idget']))
SELECT a.p_name AS a, b.p_name AS b, CAST(damerau_levenshtein(a.p_name, b.p_name) AS INTEGER) AS distance FROM p a JOIN p b ON a.p_name < b.p_name WHERE damerau_levenshtein(a.p_name, b.p_name) <= 2
""")
def fuzzy_osa(t, spark, d):
    more = spark.createDataFrame([("abcdef",), ("badcef",), ("red blot",), ("edr bolt",), ("tinw idget",)], "p_name string")
    return names.aligned_pairs(t("part").select("p_name").unionByName(more), "p_name")


@query("SELECT translate(regexp_replace(replace(replace(lower(p_name), 'rn', 'm'), 'vv', 'w'), '[-_.]', '', 'g'), '01|53', 'ollse') AS skeleton, count(*) AS n FROM part GROUP BY 1")
def fuzzy_skeleton(t, spark, d):
    return t("part").groupBy(skeleton(F.col("p_name")).alias("skeleton")).agg(F.count("*").alias("n"))


@query("SELECT p_name AS name, CAST(damerau_levenshtein(p_name, 'rde bolt') AS INTEGER) AS distance FROM (SELECT DISTINCT p_name FROM part) WHERE damerau_levenshtein(p_name, 'rde bolt') <= 4 ORDER BY distance, name LIMIT 5")
def fuzzy_suggestions(t, spark, d):
    return names.suggestions(t("part").select(F.col("p_name").alias("name")), "rde bolt", 4)


@query(r"""
SELECT doc_id, CAST(len(regexp_extract_all(text, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b')) AS INTEGER) AS email, CAST(len(regexp_extract_all(text, '\b(?:\d{1,3}\.){3}\d{1,3}\b')) AS INTEGER) AS ipv4 FROM documents
WHERE regexp_matches(text, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b') OR regexp_matches(text, '\b(?:\d{1,3}\.){3}\d{1,3}\b')
""")
def secrets_content(t, spark, d):
    return secrets.content_counts(t("documents"), "doc_id", "text", "email", "ipv4")


@query(r"""
WITH r AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z0-9_\-+/=]{20,}'))) AS run FROM documents),
c AS (SELECT doc_id, run, ch, count(*) AS n FROM (SELECT doc_id, run, unnest(string_split(run, '')) AS ch FROM r) GROUP BY ALL)
SELECT doc_id, run, round(-sum(n / length(run) * log2(n / length(run))), 6) AS entropy FROM c GROUP BY doc_id, run HAVING -sum(n / length(run) * log2(n / length(run))) >= 3.0
""")
def secrets_entropy(t, spark, d):
    return secrets.high_entropy(t("documents"), "doc_id", "text", 3.0).select("doc_id", "run", F.round("entropy", 6).alias("entropy")).distinct()


@query(r"SELECT doc_id, sha256(regexp_replace(text, '(?i)\b(token|secret|password|api_?key)(\s*[=:]\s*)(\S+)', '\1\2***', 'g')) AS redacted FROM documents WHERE regexp_matches(text, '(?i)\b(token|secret|password|api_?key)\s*[=:]\s*\S')")
def secrets_redact(t, spark, d):
    return t("documents").filter(F.col("text").rlike(r"(?i)\b(token|secret|password|api_?key)\s*[=:]\s*\S")).select("doc_id", F.sha2(secrets.redacted_text(F.col("text")), 256).alias("redacted"))


@query("SELECT sha256(text) AS digest, CAST(strlen(text) AS INTEGER) AS size, count(*) AS copies, min(doc_id) AS canonical, CAST(strlen(text) * (count(*) - 1) AS BIGINT) AS reclaimable FROM documents GROUP BY 1, 2 HAVING count(*) > 1".replace(", 2 HAVING", ", text HAVING"))
def dedupe_exact(t, spark, d):
    return snapshots.duplicates(t("documents"), "doc_id", F.sha2("text", 256), F.octet_length("text"))


@query("SELECT doc_id, uses FROM (SELECT doc_id, count(*) OVER (PARTITION BY text) AS uses FROM documents WHERE text IS NOT NULL) WHERE uses > 1")
def reuse_groups(t, spark, d):
    return snapshots.reused(t("documents"), "doc_id", "text")


@query("""
WITH a AS (SELECT o_orderkey, o_orderstatus AS before FROM orders WHERE o_orderkey % 10 <> 0), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS after FROM orders WHERE o_orderkey % 10 <> 1)
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'deleted' ELSE 'modified' END AS change, before, after
FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR before IS DISTINCT FROM after
""")
def diff_orders(t, spark, d):
    orders = t("orders").select("o_orderkey", "o_orderstatus")
    key = F.col("o_orderkey")
    # the two sides are two snapshots made of one table
    after = orders.filter(key % 10 != 1).withColumn("o_orderstatus", F.when(key % 7 == 0, "X").otherwise(F.col("o_orderstatus")))
    return snapshots.diff(orders.filter(key % 10 != 0), after, "o_orderkey", "o_orderstatus")


@query("""
SELECT p_partkey, 'unused' AS finding, 'INFO' AS severity FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)
UNION ALL SELECT DISTINCT l_partkey, 'undeclared', 'HIGH' FROM lineitem WHERE l_quantity > 40 AND l_partkey NOT IN (SELECT p_partkey FROM part)
""")
def drift_sets(t, spark, d):
    return snapshots.drift(t("part").select("p_partkey"), t("lineitem").filter("l_quantity > 40").select(F.col("l_partkey").alias("p_partkey")), "p_partkey")


@query("""
WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-01'), b AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01')
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, CASE WHEN b.o_custkey IS NULL THEN 'resolved' WHEN a.o_custkey IS NULL THEN 'new' ELSE 'open' END AS state FROM a FULL JOIN b ON a.o_custkey = b.o_custkey
""")
def compare_sets(t, spark, d):
    cut = F.lit("1995-01-01").cast("timestamp_ntz")
    return snapshots.compared(t("orders").filter(F.col("o_orderdate") < cut), t("orders").filter(F.col("o_orderdate") >= cut), "o_custkey")


def event_log(t) -> DataFrame:
    """events as a change log of users: errors delete, sign-ups prolong, all else sets; lifetimes are the values in hours."""
    kind = F.col("event_type")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return t("events").select(F.col("event_id").alias("id"), F.col("ts").alias("seq_ts"), F.row_number().over(_by_user()).cast("long").alias("seq"), F.when(kind == "error", "DELETE").when(kind == "signup", "EXPIRE").otherwise("SET").alias("op"), F.col("user_id").alias("key"), F.col("value").cast("string").alias("value"), F.when(kind != "error", F.col("value") * 3600).alias("ttl"), seconds.alias("ts"))


def _by_user():
    from pyspark.sql import Window

    return Window.partitionBy("user_id").orderBy("ts", "event_id")


@query("""
WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)
SELECT user_id, event_id, event_type FROM l WHERE n = 1 AND event_type <> 'error'
""")
def kv_latest(t, spark, d):
    log = t("events").select(F.col("user_id").alias("key"), F.struct("ts", "event_id").alias("seq"), F.when(F.col("event_type") == "error", "DELETE").otherwise("SET").alias("op"), "event_id", "event_type")
    return changelog.live(log, F.lit(0)).select(F.col("key").alias("user_id"), "event_id", "event_type")


_REPLAY = f"""
b AS (SELECT user_id, event_id, ts, value, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type <> 'signup'),
s AS (SELECT user_id, event_id, ts, epoch_us(ts) / 1e6 + value * 3600 AS until, value FROM b WHERE n = 1 AND event_type <> 'error' AND (value IS NULL OR value > 0)),
o AS (SELECT * FROM s WHERE until IS NULL OR until > epoch_us(TIMESTAMP '{AS_OF}') / 1e6),
x AS (SELECT o.user_id, arg_max(epoch_us(e.ts) / 1e6 + e.value * 3600, (e.ts, e.event_id)) AS new, bool_or(e.value <= 0 OR epoch_us(e.ts) / 1e6 + e.value * 3600 <= epoch_us(TIMESTAMP '{AS_OF}') / 1e6) AS dead
  FROM o JOIN events e ON e.user_id = o.user_id AND e.event_type = 'signup' AND e.value IS NOT NULL AND (e.ts, e.event_id) > (o.ts, o.event_id) GROUP BY 1)
"""


def as_of():
    return F.unix_micros(F.lit(AS_OF).cast("timestamp")) / 1e6


@query(f"WITH {_REPLAY} SELECT o.user_id, round(coalesce(new, until), 3) AS expires_at FROM o LEFT JOIN x ON o.user_id = x.user_id WHERE NOT coalesce(dead, false)")
def kv_replay_ttl(t, spark, d):
    return changelog.replay(event_log(t), as_of()).select(F.col("key").alias("user_id"), F.round("expires_at", 3).alias("expires_at"))


@query(f"""
WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events), u AS (SELECT epoch_us(ts) / 1e6 + value * 3600 AS until FROM l WHERE n = 1 AND event_type <> 'error')
SELECT count(*) FILTER (NOT coalesce(until <> 0 AND epoch_us(TIMESTAMP '{AS_OF}') / 1e6 >= until, false)) AS live, count(*) FILTER (coalesce(until <> 0 AND epoch_us(TIMESTAMP '{AS_OF}') / 1e6 >= until, false)) AS expired FROM u
""")
def kv_stats(t, spark, d):
    return changelog.stats(event_log(t).withColumn("expires_at", F.col("ts") + F.col("ttl")), as_of())


@query("""
WITH w AS (SELECT conv_id, turn AS request, role, lead(turn) OVER p AS response, lead(role) OVER p AS next, text, lead(text) OVER p AS answer FROM conversations WINDOW p AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, request, response, length(text) AS asked, length(answer) AS answered FROM w WHERE role = 'user' AND next = 'assistant'
""")
def session_pairs(t, spark, d):
    role = F.col("role")
    rows = sessions.paired(t("conversations"), "conv_id", "turn", role == "user", role == "assistant", "text")
    return rows.select("conv_id", "request", "response", F.length("request_value").cast("long").alias("asked"), F.length("response_value").cast("long").alias("answered"))


@query("""
WITH v AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type = 'view'), p AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type = 'purchase')
SELECT v.user_id, v.event_id, p.event_id AS answer FROM v LEFT JOIN p ON v.user_id = p.user_id AND v.n = p.n
""")
def session_nth(t, spark, d):
    events = t("events").select("user_id", "event_id", "event_type")
    rows = sessions.nth_answers(events.filter("event_type = 'view'"), events.filter("event_type = 'purchase'"), ["user_id"], "event_id", "event_id")
    return rows.select("user_id", "event_id", "answer")


@query("""
WITH s AS (SELECT doc_id, n_chars, sum(n_chars) OVER () AS total, sum(n_chars) OVER (ORDER BY doc_id) - n_chars AS before FROM documents)
SELECT doc_id, n_chars FROM s WHERE total - before > total / 2
""")
def lru_evict(t, spark, d):
    half = F.col("_all") / 2
    return changelog.evicted(t("documents"), "doc_id", "doc_id", "n_chars", half).select("doc_id", "n_chars")


_PATH = r"regexp_extract(url, '^[A-Za-z]+://[^/]+/([^?#]*)', 1)"


@query(rf"""
SELECT page_id, {_PATH} AS path FROM pages WHERE regexp_matches({_PATH}, '^en(?:/[^/]+)*$') AND NOT regexp_matches({_PATH}, '^(?:[^/]+/)*[^/]*\.html$') AND NOT regexp_matches({_PATH}, '(^|/)\.') ORDER BY path, page_id LIMIT 50
""")
def path_query(t, spark, d):
    files = t("pages").select("page_id", F.regexp_extract("url", r"^[A-Za-z]+://[^/]+/([^?#]*)", 1).alias("path"))
    return PathQuery(["en/**"], exclude=["**/*.html"], sort=True, limit=50).run(files, "path", None, "page_id")


@query("""
WITH f AS (SELECT o_orderkey, o_orderpriority, CASE left(o_orderpriority, 1) WHEN '1' THEN 4 WHEN '2' THEN 3 WHEN '3' THEN 2 WHEN '4' THEN 1 ELSE 0 END AS r FROM orders)
SELECT CAST(o_orderkey AS VARCHAR) AS package, CASE r WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 1 THEN 'LOW' ELSE 'INFO' END AS severity FROM f WHERE r > 0 ORDER BY r DESC, package LIMIT 100
""")
def finding_order(t, spark, d):
    return rules.selected(order_findings(t), most=100).select("package", "severity")


def order_findings(t) -> DataFrame:
    first = F.substring("o_orderpriority", 1, 1)
    severity = F.when(first == "1", "CRITICAL").when(first == "2", "HIGH").when(first == "3", "MEDIUM").when(first == "4", "LOW").otherwise("INFO")
    return t("orders").select(F.lit("priority").alias("rule"), severity.alias("severity"), F.col("o_orderkey").cast("string").alias("package"), F.lit("").alias("version"))


@query("SELECT CASE left(o_orderpriority, 1) WHEN '1' THEN 'CRITICAL' WHEN '2' THEN 'HIGH' WHEN '3' THEN 'MEDIUM' WHEN '4' THEN 'LOW' ELSE 'INFO' END AS severity, count(*) AS n FROM orders GROUP BY 1")
def finding_counts(t, spark, d):
    return rules.severity_counts(order_findings(t))


@query("SELECT o_orderkey, o_orderdate FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50)")
def history_last_n(t, spark, d):
    return rules.newest(t("orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 50)


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders) WHERE n <= 3")
def history_bounded(t, spark, d):
    return rules.bounded_newest(t("orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 3)


@query("SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(json_extract(props, '$.k')) AS n FROM events GROUP BY event_type")
def json_props(t, spark, d):
    rows = t("events").select("event_type", F.from_json("props", "k long")["k"].alias("k"))
    return rows.groupBy("event_type").agg(F.sum("k").alias("total"), F.count("k").alias("n"))


@query("SELECT user_id, event_id, before FROM (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE event_id <> before + 1")
def seq_gaps(t, spark, d):
    return changelog.sequence_gaps(t("events"), "user_id", "event_id")


@query("SELECT l_returnflag, bit_xor(l_orderkey * 1000 + l_linenumber) AS parity FROM lineitem GROUP BY 1")
def parity_xor(t, spark, d):
    return t("lineitem").groupBy("l_returnflag").agg(F.bit_xor(F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("parity"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_counts(t, spark, d):
    stream = replay.file_stream(spark, d, t("events"), "events.parquet")
    return replay.drained(replay.counts(stream, "event_type"), "complete", "counts")
