"""Queries of scalar functions, secret rules and fuzzy names on literal tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import names, secrets
from tessera.queries.base import Rows, query

PASSWORDS = Rows("id long, value string", [(1, ""), (2, "abc"), (3, "Password123!x"), (4, "correct horse battery staple"), (5, "aaaaaaaabbbbbbbb"), (6, "Tr0ub4dor&3"), (7, "qWeRtY12345"), (8, "zX9$kL2@mN7!pQ4#"), (9, None), (10, "zzz111###AAA"), (11, "abc"), (12, "12345678901234567890123456")])
#: Runs of three and more are told by characters that equal both before them but not the third before.
_SCORES = f"""
p AS {PASSWORDS},
c AS (SELECT id, value, coalesce(length(value), 0) AS n, list_transform(range(1, coalesce(length(value), 0) + 1), lambda i: value[i]) AS ch FROM p),
f AS (SELECT *, regexp_matches(value, '[A-Z]')::INT AS u, regexp_matches(value, '[a-z]')::INT AS l, regexp_matches(value, '[0-9]')::INT AS g, regexp_matches(value, '[^A-Za-z0-9]')::INT AS s,
  len(list_filter(range(3, n + 1), lambda i: ch[i] = ch[i - 1] AND ch[i] = ch[i - 2] AND (i = 3 OR ch[i] <> ch[i - 3]))) AS runs, len(list_distinct(ch)) AS distinct_n FROM c),
t AS (SELECT *, least(100, floor(round(n * log2(greatest(1, 26 * u + 26 * l + 10 * g + 26 * s)), 2) * 1.25 + 0.5)) AS base FROM f),
r AS (SELECT id, value, CASE WHEN n = 0 THEN 0 ELSE greatest(0, least(100, base + CASE WHEN n >= 24 THEN 20 WHEN n >= 16 THEN 10 WHEN n >= 12 THEN 0 WHEN n >= 8 THEN -15 ELSE -30 END
  + CASE WHEN u + l + g + s < 3 AND n < 20 THEN 10 * (u + l + g + s - 4) ELSE 0 END + CASE WHEN regexp_matches(lower(value), '12345|qwerty|asdfgh|password|admin|letmein|welcome|monkey|abc123|iloveyou|dragon') THEN -20 ELSE 0 END
  - least(20, 10 * runs) + CASE WHEN n >= 8 AND distinct_n < 0.5 * n THEN -15 ELSE 0 END)) END AS score FROM t)
"""


@query(f"WITH {_SCORES} SELECT id, CAST(score AS INTEGER) AS score, CASE WHEN score >= 90 THEN 'EXCELLENT' WHEN score >= 80 THEN 'STRONG' WHEN score >= 60 THEN 'MODERATE' WHEN score >= 40 THEN 'WEAK' ELSE 'CRITICAL' END AS tier FROM r")
def password_scores(t, spark, d):
    """F23."""
    return secrets.password_audit(PASSWORDS.frame(spark))


@query(f"""
WITH {_SCORES}, h AS (SELECT greatest(0, floor(avg(CASE WHEN value IS NULL THEN 80 ELSE score END) + 0.5) - 5 * (SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM r WHERE value IS NOT NULL GROUP BY value HAVING count(*) > 1))) AS score FROM r)
SELECT CAST(score AS BIGINT) AS score, CASE WHEN score >= 85 THEN 'HEALTHY' WHEN score >= 70 THEN 'FAIR' ELSE 'AT RISK' END AS band FROM h
""")
def vault_health(t, spark, d):
    """A26, with A27's reuse: entries without a value count 80."""
    return secrets.vault_health(PASSWORDS.frame(spark)).select(F.col("score").cast("long").alias("score"), "band")


SIZES = Rows("given string", [("10",), ("1.5 kB",), ("2MiB",), ("3g",), (" 7 b ",), ("1 tib",), ("x",), ("5 mi",), ("12 qb",)])


@query(f"""
WITH s AS (SELECT given, regexp_extract(given, '^\\s*(\\d+(?:\\.\\d+)?)\\s*([A-Za-z]*)\\s*$', 1) AS n, lower(regexp_extract(given, '^\\s*(\\d+(?:\\.\\d+)?)\\s*([A-Za-z]*)\\s*$', 2)) AS u FROM {SIZES}),
b AS (SELECT given, CASE WHEN n <> '' THEN CAST(floor(CAST(n AS DOUBLE) * CASE WHEN u IN ('', 'b') THEN 1 WHEN regexp_matches(u, '^[kmgt]b?$') THEN power(1000, strpos('kmgt', u[1])) WHEN regexp_matches(u, '^[kmgt]ib?$') THEN power(1024, strpos('kmgt', u[1])) END) AS BIGINT) END AS bytes FROM s)
SELECT given, bytes, CASE WHEN bytes >= 1024 ** 4 THEN printf('%.1f TiB', bytes / 1024 ** 4) WHEN bytes >= 1024 ** 3 THEN printf('%.1f GiB', bytes / 1024 ** 3) WHEN bytes >= 1024 ** 2 THEN printf('%.1f MiB', bytes / 1024 ** 2) WHEN bytes >= 1024 THEN printf('%.1f KiB', bytes / 1024) ELSE CAST(bytes AS VARCHAR) || ' B' END AS shown FROM b
""")
def sizes_parsed(t, spark, d):
    """sizes read and shown again."""
    rows = SIZES.frame(spark).withColumn("bytes", text.byte_size(F.col("given")))
    return rows.withColumn("shown", text.human_size(F.col("bytes")))


DURATIONS = Rows("given string", [("90",), ("90s",), ("5m",), ("1.5h",), ("2d",), ("2 w",), ("",)])


@query(f"WITH s AS (SELECT given, regexp_extract(given, '^\\s*(\\d+(?:\\.\\d+)?)\\s*([smhd]?)\\s*$', 1) AS n, regexp_extract(given, '^\\s*(\\d+(?:\\.\\d+)?)\\s*([smhd]?)\\s*$', 2) AS u FROM {DURATIONS}) SELECT given, CASE WHEN n <> '' THEN CAST(n AS DOUBLE) * CASE u WHEN 'm' THEN 60 WHEN 'h' THEN 3600 WHEN 'd' THEN 86400 ELSE 1 END END AS seconds FROM s")
def durations_parsed(t, spark, d):
    """durations."""
    return DURATIONS.frame(spark).withColumn("seconds", text.duration_seconds(F.col("given")))


ENTRIES = Rows("name string", [("a/b.txt",), ("",), ("/etc/x",), ("C:\\x",), ("c:/x",), ("a/../b",), ("..",), ("a..b/c",), ("..\\x",), ("a/..",), ("ok/…/x",)])


@query(f"WITH e AS (SELECT name, replace(name, '\\', '/') AS p FROM {ENTRIES}) SELECT name, p = '' OR p[1] = '/' OR regexp_matches(p, '^[A-Za-z]:') OR list_contains(string_split(p, '/'), '..') AS unsafe FROM e")
def archive_names(t, spark, d):
    """P18."""
    return ENTRIES.frame(spark).withColumn("unsafe", text.unsafe_archive_name(F.col("name")))


SCANNED = Rows("id long, body string", [
    (1, "key = " + "A1b2C3d4E5f6G7h8J9k0LmNoPq\nnext line  " + "zZ9yY8xX7wW6vV5uU4tT3sS2rR1q"),
    (2, "plain words only"),
    (3, "a\n\n  " + "aaaaaaaaaaaaaaaaaaaaaaaa" + " and Q7w8E9r0T1y2U3i4O5p6AsDfGhJk"),
    (4, "AKIA" + "Z7Q9X3W5V1B8N6M2" + " is caught, " + "x8" + "AKIA" + "Z7Q9X3W5V1B8N6M2" + "q is a longer run"),
])


@query(rf"""
WITH s AS (SELECT id, body, list_transform(range(1, length(body) + 1), lambda i: body[i]) AS ch FROM {SCANNED}),
m AS (SELECT id, body, i FROM s, LATERAL (SELECT unnest(range(1, length(body) + 1)) AS i) WHERE regexp_matches(ch[i], '[A-Za-z0-9_\-+/=]') AND (i = 1 OR NOT regexp_matches(ch[i - 1], '[A-Za-z0-9_\-+/=]'))),
r AS (SELECT id, body, i, regexp_extract(substr(body, i), '^[A-Za-z0-9_\-+/=]+') AS run FROM m),
c AS (SELECT id, i, run, x, count(*) AS n FROM (SELECT id, i, run, unnest(string_split(run, '')) AS x FROM r WHERE length(run) >= 20) GROUP BY ALL),
h AS (SELECT id, i, run, -sum(n / length(run) * log2(n / length(run))) AS bits FROM c GROUP BY id, i, run)
SELECT h.id, CAST(len(string_split(substr(body, 1, h.i - 1), chr(10))) AS INTEGER) AS line, CAST(length(string_split(substr(body, 1, h.i - 1), chr(10))[-1]) + 1 AS INTEGER) AS place, run, round(bits, 6) AS entropy
FROM h JOIN s ON h.id = s.id WHERE bits >= 3.9 AND NOT regexp_matches(run, '^AKIA[0-9A-Z]{{16}}$')
""")
def secrets_places(t, spark, d):
    """F19 by place, W11: line and column of runs of high entropy that no rule has found at that place."""
    return secrets.high_entropy(SCANNED.frame(spark), "id", "body", 3.9).select("id", "line", F.col("column").alias("place"), "run", F.round("entropy", 6).alias("entropy"))


def secret(kind: str, n: int) -> str:
    """A made-up secret of a kind: its prefix and a run of characters."""
    return kind + "".join("aB3dE5gH7jK9"[i % 12] for i in range(n))


FOUND = Rows("id long, body string", [
    (1, "id " + secret("AKIA", 0) + "A1B2C3D4E5F6G7H8" + " and " + secret("sk_live_", 20)),
    (2, "token " + secret("ghp_", 36) + "\n" + secret("xoxb-", 24)),
    (3, "url postgres://user:" + "pa55word" + "@host/db end"),
    (4, "nothing here"),
    (5, "SECRET_KEY = " + secret("", 18) + "\nother"),
    (6, secret("sk_test_", 16) + " " + secret("eyJ", 10) + "." + secret("eyJ", 9) + "." + secret("", 8)),
])
#: Rule, severity, pattern with the secret in its group: those that RE2 can run.
_RULES = Rows("rule string, severity string, pattern string", [(r, s, p) for r, (s, p) in text.SECRET_RULES.items() if r in ("aws_access_key", "stripe_api_key", "stripe_test_key", "github_pat", "jwt_token", "slack_token", "db_connection_string")])
_KNOWN = ", ".join(f"'{p}'" for p in text.KNOWN_PREFIXES)


@query(f"""
WITH f AS (SELECT id, rule, severity, unnest(regexp_extract_all(body, pattern, 1)) AS s FROM (SELECT f.id, f.body, r.rule, r.severity, r.pattern FROM {FOUND} f, {_RULES} r) x),
p AS (SELECT *, list_filter([{_KNOWN}], lambda k: starts_with(s, k) AND length(s) > length(k) + 1)[1] AS k FROM f)
SELECT id, rule, severity, CASE WHEN k IS NOT NULL THEN k || repeat('*', greatest(4, length(s) - length(k))) WHEN length(s) <= 4 THEN repeat('*', length(s)) WHEN length(s) <= 8 THEN s[1:2] || repeat('*', length(s) - 2) ELSE s[1:4] || repeat('*', length(s) - 4) END AS secret, CAST(length(s) AS INTEGER) AS length
FROM p
""".replace("unnest(regexp_extract_all(body, pattern, 1))", "unnest(CASE rule " + " ".join(f"WHEN '{r}' THEN regexp_extract_all(body, '{p.replace(chr(39), chr(39) * 2)}', 1)" for r, _, p in _RULES.rows) + " END)"))
def secrets_rules(t, spark, d):
    """the rules that SQL's patterns can say too, with what is shown of the secrets."""
    kinds = [r for r, _, _ in _RULES.rows]
    return secrets.findings(FOUND.frame(spark), "id", "body").filter(F.col("rule").isin(kinds)).select("id", "rule", "severity", "secret", "length")


@query(f"""
WITH f AS (SELECT id, 'jwt' AS k, 'high' AS s, len(regexp_extract_all(body, '\\beyJ[A-Za-z0-9_-]{{8,}}\\.[A-Za-z0-9_-]{{8,}}\\.[A-Za-z0-9_-]{{8,}}\\b')) AS n FROM {FOUND} UNION ALL SELECT id, 'github_token', 'high', len(regexp_extract_all(body, '\\bgh[pousr]_[A-Za-z0-9]{{20,}}\\b')) FROM {FOUND}
UNION ALL SELECT id, 'aws_key', 'high', len(regexp_extract_all(body, '\\b(?:AKIA|ASIA)[A-Z0-9]{{16}}\\b')) FROM {FOUND})
SELECT id, CAST(least(100, sum(12 * n)) AS BIGINT) AS risk, 'review' AS status FROM f WHERE n > 0 GROUP BY id
""")
def secrets_file_risk(t, spark, d):
    """F22's token kinds, and A21: the risk of a file and what its worst finding makes of it."""
    counts = secrets.content_counts(FOUND.frame(spark), "id", "body", "jwt", "github_token", "aws_key")
    each = F.array(*(F.struct(F.lit(text.CONTENT_PATTERNS[k][0]).alias("severity"), F.col(k).alias("n")) for k in ("jwt", "github_token", "aws_key")))
    found = counts.select("id", F.explode(each).alias("f")).select("id", "f.severity", F.explode(F.when(F.col("f.n") > 0, F.sequence(F.lit(1), F.col("f.n"))).otherwise(F.array().cast("array<int>"))).alias("_n"))
    return secrets.file_risk(found, "id").select("id", F.col("risk").cast("long").alias("risk"), "status")


CONTROLS = Rows("id long, body string", [(1, "text\twith tabs\nand lines"), (2, "\x01\x02\x03abcdefgh"), (3, "\x01" + "a" * 9), (4, "\x01" + "a" * 8), (5, "a" * 600 + "\x02" * 300)])


@query(f"SELECT id, len(regexp_extract_all(substr(body, 1, 512), '[\\x01-\\x08\\x0E-\\x1F]')) / length(substr(body, 1, 512)) > 0.1 AS is_binary FROM {CONTROLS}".replace("(1, 'text", "(1, 'text").replace("\x01", "' || chr(1) || '").replace("\x02", "' || chr(2) || '").replace("\x03", "' || chr(3) || '"))
def binary_texts(t, spark, d):
    """P16."""
    return CONTROLS.frame(spark).select("id", text.looks_binary(F.col("body")).alias("is_binary"))


CHECKED = Rows("body string", [("123456789",), ("",), ("a",), ("The quick brown fox jumps over the lazy dog",)])


@query(f"""
WITH RECURSIVE b(body, i, c) AS (SELECT body, 0, 4294967295::BIGINT FROM {CHECKED} UNION ALL
  SELECT body, i + 1, CASE WHEN i % 8 = 0 THEN CASE WHEN (xor(c, ascii(body[i // 8 + 1])) & 1) = 1 THEN xor(xor(c, ascii(body[i // 8 + 1])) >> 1, 2197175160) ELSE xor(c, ascii(body[i // 8 + 1])) >> 1 END WHEN (c & 1) = 1 THEN xor(c >> 1, 2197175160) ELSE c >> 1 END FROM b WHERE i < 8 * length(body))
SELECT body, xor(c, 4294967295::BIGINT) AS crc FROM b WHERE i = 8 * length(body)
""")
def checksums_crc32c(t, spark, d):
    """F25."""
    return CHECKED.frame(spark).withColumn("crc", text.crc32c(F.col("body").cast("binary")))


@query("SELECT doc_id, sha256(text) AS sha256, sha1(text) AS sha1, md5(text) AS md5 FROM documents WHERE text IS NOT NULL")
def content_digests(t, spark, d):
    """F24."""
    return t("documents").filter("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("sha256"), F.sha1("text").alias("sha1"), F.md5("text").alias("md5"))


_KEY = "a key of a cache"


@query(f"""
WITH m AS (SELECT page_id, encode(url) AS u FROM pages), k AS (SELECT '{_KEY}' AS key),
p AS (SELECT unhex(string_agg(printf('%02x', xor(CASE WHEN i <= length(key) THEN ascii(key[i]) ELSE 0 END, 54)), '' ORDER BY i)) AS inner_pad, unhex(string_agg(printf('%02x', xor(CASE WHEN i <= length(key) THEN ascii(key[i]) ELSE 0 END, 92)), '' ORDER BY i)) AS outer_pad FROM k, range(1, 65) t(i))
SELECT page_id, sha256(outer_pad || unhex(sha256(inner_pad || u))) AS signature FROM m, p WHERE u IS NOT NULL
""")
def content_signatures(t, spark, d):
    """F26's signature: HMAC-SHA-256 under one key."""
    return t("pages").filter("url IS NOT NULL").select("page_id", text.hmac(F.col("url").cast("binary"), _KEY.encode()).alias("signature"))


#: The published values of RFC 4226, appendix D, for the counters 0 to 9.
_HOTP = Rows("counter long, code string", list(enumerate("755224 287082 359152 969429 338314 254676 287922 162583 399871 520489".split())))
#: The published values of RFC 6238, appendix B (SHA-1, 8 digits).
_TOTP = Rows("seconds long, code string", [(59, "94287082"), (1111111109, "07081804"), (1111111111, "14050471"), (1234567890, "89005924"), (2000000000, "69279037"), (20000000000, "65353130")])


@query(f"SELECT counter, code FROM {_HOTP}")
def hotp_codes(t, spark, d):
    """F32 against the published values."""
    return spark.range(10).select(F.col("id").alias("counter"), text.hotp(F.col("id"), text.base32_key("GEZD GNBV GY3T QOJQ GEZD GNBV GY3T QOJQ")).alias("code"))


@query(f"SELECT seconds, code FROM {_TOTP}")
def totp_codes(t, spark, d):
    """F32 against the published values."""
    return _TOTP.frame(spark).select("seconds", text.totp(F.col("seconds"), b"12345678901234567890", 8).alias("code"))


NAMES = Rows("name string", [("@scope/left-pad",), ("lodash",), ("@a/b/c",), ("Flask_SQL.Alchemy",), ("zope..interface",), ("@",)])


@query(f"SELECT name, nullif(regexp_extract(name, '^@([^/]+)/(.+)$', 1), '') AS scope, regexp_replace(name, '^@[^/]+/', '') AS bare, regexp_replace(lower(name), '[-_.]+', '-', 'g') AS normal FROM {NAMES}")
def name_parts(t, spark, d):
    """F5, F6."""
    return NAMES.frame(spark).select("name", text.name_scope(F.col("name")).alias("scope"), text.bare_name(F.col("name")).alias("bare"), text.package_name(F.col("name")).alias("normal"))


INSTALLED = Rows("name string", [("lodahs",), ("1odash",), ("lodash",), ("expresss",), ("reqest",), ("reactt-doom",), ("@evil/react-dom",), ("@types/express",), ("lodash-es",), ("chalkk",), ("axois",), ("rn0rnent",), ("xyz",)])
POPULAR = Rows("name string, position long", [("lodash", 0), ("express", 1), ("request", 2), ("react-dom", 3), ("@babel/react-dom", 4), ("chalk", 5), ("axios", 6), ("moment", 7), ("@types/express", 8)])
_SKELETON = "translate(regexp_replace(replace(replace(lower({0}), 'rn', 'm'), 'vv', 'w'), '[-_.]', '', 'g'), '01|53', 'ollse')"


@query(f"""
WITH p AS (SELECT name AS target, position, {_SKELETON.format('name')} AS s, nullif(regexp_extract(name, '^@([^/]+)/', 1), '') AS tscope, regexp_replace(name, '^@[^/]+/', '') AS tbare FROM {POPULAR}),
n AS (SELECT name, {_SKELETON.format('name')} AS s, nullif(regexp_extract(name, '^@([^/]+)/', 1), '') AS scope, regexp_replace(name, '^@[^/]+/', '') AS bare FROM {INSTALLED} WHERE name NOT IN (SELECT target FROM p)),
c AS (SELECT name, arg_min(target, position) AS target FROM n JOIN p ON n.s = p.s GROUP BY name),
d AS (SELECT name, target, position, damerau_levenshtein(bare, tbare) AS distance, least(length(bare), length(tbare)) AS short FROM n, p WHERE (scope IS NULL) = (tscope IS NULL) AND scope IS NOT DISTINCT FROM tscope IS NOT TRUE OR (scope IS NULL AND tscope IS NULL)),
b AS (SELECT name, arg_min(target, (distance, position)) AS target, CAST(min(distance) AS INTEGER) AS distance FROM d WHERE distance = 1 AND short >= 5 OR distance = 2 AND short >= 8 GROUP BY name)
SELECT name, target, CAST(NULL AS INTEGER) AS distance, 'confusable' AS kind FROM c UNION ALL SELECT name, target, distance, 'near' FROM b WHERE name NOT IN (SELECT name FROM c)
""".replace("(scope IS NULL) = (tscope IS NULL) AND scope IS NOT DISTINCT FROM tscope IS NOT TRUE OR (scope IS NULL AND tscope IS NULL)", "(scope IS NULL AND tscope IS NULL) OR (scope IS NOT NULL AND tscope IS NOT NULL AND scope <> tscope)"))
def name_squats(t, spark, d):
    """Names near a popular one, or that look like it."""
    return names.squats(INSTALLED.frame(spark), POPULAR.frame(spark)).select("name", "target", "distance", "kind")


COMMANDS = Rows("position long, name string", [(0, "build"), (1, "rebuild-all"), (2, "Build:docs"), (3, "bild"), (4, "test"), (5, "guild")])


@query(f"SELECT position, name FROM {COMMANDS} WHERE levenshtein(lower(name), 'build') <= 2 OR contains(lower(name), 'build')")
def name_likely(t, spark, d):
    """T15."""
    return names.likely(COMMANDS.frame(spark), "Build")


WORDS = Rows("word string", [("mkdri",), ("cpoy",), ("is_fil",), ("is_xil",), ("zzz",), ("mve",), ("delte",), ("exist",), ("is_di",)])
KNOWN = Rows("name string", [(w,) for w in "require assert mkdir copy move write replace delete exists not_exists is_file is_dir contains sha256".split()])


@query(f"WITH d AS (SELECT word, name, levenshtein(word, name) AS d FROM {WORDS}, {KNOWN}), b AS (SELECT word, min(d) AS d FROM d GROUP BY word) SELECT d.word, min(name) AS name FROM d JOIN b ON d.word = b.word AND d.d = b.d WHERE b.d <= 2 GROUP BY d.word HAVING count(*) = 1")
def name_only_nearest(t, spark, d):
    """a suggestion only where one name is nearest."""
    return names.only_nearest(WORDS.frame(spark), KNOWN.frame(spark))


@query("SELECT page_id, length(replace(html, 'the', 'THE')) AS n, sha256(replace(html, 'the', 'THE')) AS replaced, contains(html, 'script') AS has_script FROM pages WHERE html IS NOT NULL")
def text_replaced(t, spark, d):
    """whole texts searched and replaced."""
    new = F.replace(F.col("html"), F.lit("the"), F.lit("THE"))
    return t("pages").filter("html IS NOT NULL").select("page_id", F.length(new).cast("long").alias("n"), F.sha2(new, 256).alias("replaced"), F.col("html").contains("script").alias("has_script"))


CHUNKS = Rows("stripe long, chunk long, body string", [(1, 0, "the first chunk"), (1, 1, "another, longer chunk"), (1, 2, "short"), (2, 0, "alone"), (2, 1, "")])


@query(f"""
WITH b AS (SELECT stripe, chunk, i, ascii(body[i]) AS x FROM {CHUNKS} c, LATERAL (SELECT unnest(range(1, length(body) + 1)) AS i)),
p AS (SELECT stripe, i, bit_xor(x) AS x FROM b GROUP BY stripe, i)
SELECT stripe, string_agg(printf('%02X', x), '' ORDER BY i) AS parity FROM p GROUP BY stripe
""")
def parity_stripes(t, spark, d):
    """the parity of a stripe's chunks, the shorter ones padded."""
    from tessera.operators import snapshots

    return snapshots.parity(CHUNKS.frame(spark).withColumn("body", F.col("body").cast("binary")), ["stripe"], "body").select("stripe", F.hex("parity").alias("parity"))


@query(f"SELECT stripe, chunk, body FROM {CHUNKS} WHERE stripe = 1 AND chunk = 1 OR stripe = 2 AND chunk = 0")
def parity_recovered(t, spark, d):
    """of each stripe a lost chunk, from the others and the parity."""
    from tessera.operators import snapshots

    chunks = CHUNKS.frame(spark).withColumn("body", F.col("body").cast("binary"))
    parity = snapshots.parity(chunks, ["stripe"], "body")
    lost = chunks.filter("stripe = 1 AND chunk = 1 OR stripe = 2 AND chunk = 0").select("stripe", "chunk", F.octet_length("body").alias("size"))
    there = chunks.join(lost.select("stripe", "chunk"), ["stripe", "chunk"], "left_anti")
    return snapshots.recovered(there, parity, lost, ["stripe"], "chunk", "body").select("stripe", "chunk", F.col("body").cast("string").alias("body"))


DUPLICATES = Rows("id long, body string, a long, s string", [(1, '{"a": 1, "a": 2}', 2, None), (2, '{"s": "\\ud83d\\ude00", "a": 7}', 7, "😀"), (3, '{"a": 1', None, None), (4, '{"s": "x"}', None, "x")])


@query(f"SELECT id, a, s FROM {DUPLICATES}")
def json_duplicate_keys(t, spark, d):
    """the last of equal keys wins, surrogate pairs are one character, what is no JSON is null."""
    parsed = F.from_json("body", "a long, s string")
    return DUPLICATES.frame(spark).select("id", parsed["a"].alias("a"), parsed["s"].alias("s"))
