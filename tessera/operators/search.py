"""Ranked text search: postings, BM25, min-max scaling and the blend with graph rank and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import STOP_WORDS, all_tokens, spaced
from tessera.storage import written

K1, B = 1.5, 0.75
#: Weights of the blend, and of the evidence badges.
TEXT_WEIGHT, RANK_WEIGHT, EVIDENCE_WEIGHT = 0.60, 0.20, 0.20
BADGES = {"PROVEN": 1.0, "INFERRED": 0.65, "UNKNOWN": 0.30}


def _kept(term: Column) -> Column:
    return (F.length(term) >= 2) & ~term.isin(STOP_WORDS)


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, tf. Stop words go as rows, in compiled code, not inside arrays."""
    return docs.select(key, F.explode(all_tokens(F.col(text))).alias("term")).filter(_kept(F.col("term"))).groupBy(key, "term").agg(F.count("*").alias("tf"))


def document_frequency(docs: DataFrame, text: str) -> DataFrame:
    """term, df: each document gives each of its terms once, so nothing is counted by document."""
    rows = docs.select(F.explode(F.array_distinct(all_tokens(F.col(text)))).alias("term")).filter(_kept(F.col("term")))
    return rows.groupBy("term").agg(F.count("*").alias("df"))


def query_terms(query: str) -> dict[str, int]:
    """The query's terms with their number: one asked twice counts twice."""
    import re

    words = re.split("[^a-z0-9]+", re.sub("([a-z])([A-Z])", r"\1 \2", query).lower())
    out: dict[str, int] = {}
    for word in words:
        if len(word) >= 2 and word not in STOP_WORDS:
            out[word] = out.get(word, 0) + 1
    return out


def bm25(docs: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """key, score of the documents with a score over 0.

    One pass over the texts: each document gives its length and the counts of the few query terms, by regular expressions and not by lists of
    words. These few numbers are written; the corpus figures are one row of them. Nothing else of the texts is kept or shuffled.
    """
    terms = query_terms(query)
    names = list(terms)
    low = spaced(F.col(text))

    def number(pattern: str) -> Column:
        return F.coalesce(F.regexp_count(low, F.lit(f"(?<![a-z0-9]){pattern}(?![a-z0-9])")), F.lit(0))

    stop = "|".join(STOP_WORDS)
    length = number(f"(?!(?:{stop})(?![a-z0-9]))[a-z0-9]{{2,}}")
    counts = written(docs.select(key, length.alias("len"), *(number(n).alias(f"f{i}") for i, n in enumerate(names))), "counts")
    corpus = counts.agg(F.count("*").alias("n"), F.avg("len").alias("avg"), *(F.sum((F.col(f"f{i}") > 0).cast("int")).alias(f"d{i}") for i in range(len(names))))
    score = F.lit(0.0)
    for i, name in enumerate(names):
        f, d = F.col(f"f{i}"), F.col(f"d{i}")
        idf = F.log((F.col("n") - d + 0.5) / (d + 0.5) + 1.0)
        score = score + F.when(f > 0, terms[name] * idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.greatest(F.col("avg"), F.lit(1.0))))).otherwise(0.0)
    return counts.filter(" OR ".join(f"f{i} > 0" for i in range(len(names))) or "false").crossJoin(corpus).select(key, score.alias("score")).filter("score > 0")


def top(scores: DataFrame, key: str, most: int = 20) -> DataFrame:
    return scores.orderBy(F.desc("score"), key).limit(most)


def scaled(scores: DataFrame) -> DataFrame:
    """score from 0 to 1 over all hits; 1 where all are equal."""
    every = Window.partitionBy()
    low, high = F.min("score").over(every), F.max("score").over(every)
    return scores.withColumn("score", F.when(low == high, F.lit(1.0)).otherwise((F.col("score") - low) / (high - low)))


def blended(hits: DataFrame, symbols: DataFrame, key: str, tests_too: bool = False) -> DataFrame:
    """key, score. symbols: key, name, rank (0 to 1), badge, stale, is_test. Scaled over all hits, tests among them, before tests go."""
    rows = scaled(hits).join(symbols, key)
    text = F.when(F.col("name").rlike("^__.*__$"), F.col("score") * 0.5).otherwise(F.col("score"))
    weight = F.coalesce(*(F.when(F.col("badge") == b, F.lit(w)) for b, w in BADGES.items()), F.lit(BADGES["UNKNOWN"])) * F.when(F.col("stale"), 0.5).otherwise(1.0)
    out = rows if tests_too else rows.filter(~F.col("is_test"))
    return out.select(key, (TEXT_WEIGHT * text + RANK_WEIGHT * F.coalesce("rank", F.lit(0.0)) + EVIDENCE_WEIGHT * weight).alias("score"))


def starting_score(dependents, entry, functions, classes, todos, fixmes, lines):  # noqa: ANN001, ANN201
    """How good a file is to begin reading at."""
    return F.round(5 * dependents + 20 * entry.cast("int") + 2 * functions + 3 * classes + 2 * todos + 3 * fixmes + lines / 100, 2)


def recommended(scores: DataFrame, key: str, most: int = 3) -> DataFrame:
    """The files to begin with: by score, then by key; none where `most` is 0."""
    return top(scores, key, most)


def placed(scores: DataFrame, key: str) -> DataFrame:
    """scores with place, from 1, by falling score and key. For the rows of a result page: the window has no partition."""
    return scores.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), key)).cast("long"))
