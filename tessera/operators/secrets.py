"""Scanning texts for secrets and other content that should not be published."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import CONTENT_PATTERNS, SECRET_RULES, TOKEN_RUN, column_of, entropy, line_of, looks_binary, password_score, password_tier, places, redacted

LEAST_ENTROPY = 4.5
#: What a finding of each severity adds to a file's risk.
RISK = {"info": 0, "low": 1, "medium": 4, "high": 12, "critical": 30}


def content_counts(rows: DataFrame, key: str, text: str, *kinds: str) -> DataFrame:
    """key and the number of matches of each kind, for rows with any."""
    kinds = kinds or tuple(CONTENT_PATTERNS)
    counts = rows.select(key, *(F.regexp_count(text, F.lit(CONTENT_PATTERNS[k][1])).alias(k) for k in kinds))
    return counts.filter(" OR ".join(f"{k} > 0" for k in kinds))


def findings(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, rule, severity, secret (redacted), length of each match of a secret rule; texts that look binary are left out."""
    open_ = rows.filter(~F.coalesce(looks_binary(F.col(text)), F.lit(False)))
    each = F.array(*(F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.regexp_extract_all(text, F.lit(pattern), 1).alias("found")) for rule, (severity, pattern) in SECRET_RULES.items()))
    found = open_.select(key, F.explode(F.filter(each, lambda x: F.size(x["found"]) > 0)).alias("f"))
    hits = found.select(key, "f.rule", "f.severity", F.explode("f.found").alias("s"))
    shown = F.when(F.col("rule") == "private_key", "-----BEGIN PRIVATE KEY-----\n[REDACTED PRIVATE KEY CONTENT]\n-----END PRIVATE KEY-----").otherwise(redacted(F.col("s")))
    return hits.select(key, "rule", "severity", shown.alias("secret"), F.length("s").alias("length"))


def _ranger(pattern: str) -> Callable[[Column], Column]:
    """start, end of a rule's group inside a match (start, text) of its pattern; of the match itself where the pattern does not fit that text alone."""

    def of(match: Column) -> Column:
        group = F.regexp_extract(match["text"], pattern, 1)
        start = match["start"] + F.greatest(F.lit(0), F.position(group, match["text"]) - 1)
        return F.struct(start.alias("start"), (start + F.length(F.when(group == "", match["text"]).otherwise(group))).alias("end"))

    return of


def high_entropy(rows: DataFrame, key: str, text: str, least: float = LEAST_ENTROPY) -> DataFrame:
    """key, line, column, run, entropy of token runs of 20 and more characters, but for those that lie inside a secret that a rule has found at that place."""
    t = F.col(text)
    caught = F.lit(None).cast("array<struct<start: int, end: int>>")
    for _, pattern in SECRET_RULES.values():
        # a rule's match is looked at as a whole text: its group is the secret in it
        secret = F.transform(places(t, pattern), _ranger(pattern)).cast("array<struct<start: int, end: int>>")
        caught = F.concat(F.coalesce(caught, F.array().cast("array<struct<start: int, end: int>>")), secret)
    runs = rows.select(key, t.alias("_t"), caught.alias("_c"), F.explode(places(t, TOKEN_RUN)).alias("_r"))
    free = ~F.exists("_c", lambda c: (c["start"] <= F.col("_r.start")) & (c["end"] >= F.col("_r.start") + F.length("_r.text")))
    found = runs.withColumn("entropy", entropy(F.col("_r.text"))).filter((F.col("entropy") >= least) & free)
    return found.select(key, line_of(F.col("_t"), F.col("_r.start")).alias("line"), column_of(F.col("_t"), F.col("_r.start")).alias("column"), F.col("_r.text").alias("run"), "entropy")


def redacted_text(text: Column) -> Column:
    """The text with the secrets of key=value pairs as stars."""
    return F.regexp_replace(text, r"(?i)\b(token|secret|password|api_?key)(\s*[=:]\s*)(\S+)", "$1$2***")


def file_risk(found: DataFrame, key: str) -> DataFrame:
    """key, risk (at most 100), status by the worst severity."""
    weight, rank = F.coalesce(*(F.when(F.col("severity") == s, F.lit(w)) for s, w in RISK.items())), F.coalesce(*(F.when(F.col("severity") == s, F.lit(i)) for i, s in enumerate(RISK)))
    rows = found.groupBy(key).agg(F.least(F.lit(100), F.sum(weight)).alias("risk"), F.max(rank).alias("_r"))
    return rows.select(key, "risk", F.when(F.col("_r") == 4, "blocked").when(F.col("_r") == 3, "review").when(F.col("_r") == 2, "caution").otherwise("clear").alias("status"))


def vault_health(entries: DataFrame) -> DataFrame:
    """score, band over entries (id, value): the mean password score less 5 for each entry whose value others have too; halves round up."""
    scored = entries.select("id", F.when(F.col("value").isNull(), F.lit(80)).otherwise(password_score(F.col("value"))).alias("s"), F.sha2("value", 256).alias("d"))
    uses = scored.filter("d IS NOT NULL").groupBy("d").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("reused"))
    score = F.greatest(F.lit(0), F.floor(F.col("mean") + 0.5) - 5 * F.col("reused"))
    out = scored.agg(F.avg("s").alias("mean")).crossJoin(uses).select(score.alias("score"))
    return out.withColumn("band", F.when(F.col("score") >= 85, "HEALTHY").when(F.col("score") >= 70, "FAIR").otherwise("AT RISK"))


def password_audit(entries: DataFrame) -> DataFrame:
    score = password_score(F.col("value"))
    return entries.select("id", score.alias("score"), password_tier(score).alias("tier"))
