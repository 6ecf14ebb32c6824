"""Fuzzy names: bounded edit distance with transpositions, look-alike joins, suggestions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import bare_name, name_scope, skeleton

#: Edits, and how long both names must be for so many to be credible.
CREDIBLE = {1: 5, 2: 8}


def osa(a: str, b: str, most: int) -> int | None:
    """Optimal string alignment: insert, delete, replace, swap neighbours; None beyond `most`."""
    if abs(len(a) - len(b)) > most:
        return None
    two, one = [0] * (len(b) + 1), list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, two[j - 2] + 1)
            row.append(best)
        if min(row) > most:
            return None
        two, one = one, row
    return one[-1] if one[-1] <= most else None


def with_distance(pairs: DataFrame, a: str, b: str, most: int) -> DataFrame:
    """pairs with `distance` of those within `most` edits. A swap costs two plain edits, so twice the bound is a native filter before the Python step."""
    near = pairs.filter(F.levenshtein(a, b, 2 * most) >= 0)

    @F.pandas_udf("int")
    def measured(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in parts:
            yield pd.Series([osa(p, q, most) for p, q in zip(x, y)], dtype="Int32")

    return near.withColumn("distance", measured(a, b)).filter("distance IS NOT NULL")


def deletions(name: str, most: int) -> Column:
    """The name's signatures: the name and what is left of it when up to `most` characters go (most 1 or 2)."""
    one = lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda k: F.concat(F.substr(s, F.lit(1), k - 1), F.substr(s, k + 1)))
    first = F.array_union(F.array(F.col(name)), one(F.col(name)))
    return first if most == 1 else F.array_union(first, F.array_distinct(F.flatten(F.transform(first, one))))


def near_pairs(names: DataFrame, name: str, most: int = 2) -> DataFrame:
    """a, b, distance of distinct names within `most` plain edits, a before b.

    Names within k edits share a string that deleting up to k characters of each leaves. So this is an equi-join on such
    strings, not a comparison of all names with all.
    """
    rows = names.select(F.col(name).alias("a")).filter("a IS NOT NULL").distinct()
    keyed = rows.select("a", F.explode(deletions("a", most)).alias("_k"))
    pairs = keyed.join(keyed.select(F.col("a").alias("b"), "_k"), "_k").filter("a < b").select("a", "b").distinct()
    return pairs.withColumn("distance", F.levenshtein("a", "b")).filter(F.col("distance") <= most)


def squats(names: DataFrame, popular: DataFrame) -> DataFrame:
    """name, target, distance, kind: names that look like a popular one (both: name; popular: position too). Confusable beats near; of equal distances the first popular name wins.

    The popular names are the small side: each name has the strings that deletions leave, and so have they.
    """
    p = popular.select(F.col("name").alias("target"), "position")
    odd = names.select("name").distinct().join(p.select(F.col("target").alias("name")), "name", "left_anti")
    alike = odd.withColumn("_s", skeleton(F.col("name"))).join(p.withColumn("_s", skeleton(F.col("target"))), "_s").groupBy("name").agg(F.min_by("target", "position").alias("target"))
    confusable = alike.select("name", "target", F.lit(None).cast("int").alias("distance"), F.lit("confusable").alias("kind"))
    a = odd.withColumns({"_bare": bare_name(F.col("name")), "_scope": name_scope(F.col("name"))})
    b = p.withColumns({"_tbare": bare_name(F.col("target")), "_tscope": name_scope(F.col("target"))})
    a, b = a.withColumn("_k", F.explode(deletions("_bare", 2))), b.withColumn("_k", F.explode(deletions("_tbare", 2)))
    pairs = a.join(b, "_k").filter(F.col("_scope").isNull() == F.col("_tscope").isNull()).filter(~F.coalesce(F.col("_scope") == F.col("_tscope"), F.lit(False))).dropDuplicates(["name", "target"])
    near = with_distance(pairs, "_bare", "_tbare", 2)
    length = F.least(F.length("_bare"), F.length("_tbare"))
    credible = near.filter(F.coalesce(*(F.when(F.col("distance") == d, length >= n) for d, n in CREDIBLE.items()), F.lit(False)))
    best = credible.groupBy("name").agg(F.min(F.struct("distance", "position", "target")).alias("x")).select("name", "x.target", "x.distance", F.lit("near").alias("kind"))
    return confusable.unionByName(best.join(confusable, "name", "left_anti"))


def aligned_pairs(names: DataFrame, name: str, most: int = 2) -> DataFrame:
    """a, b, distance of distinct names within `most` edits where swapping neighbours is one edit, a before b. The signatures are those of near_pairs(): a swap is met by deleting one of the two on each side."""
    rows = names.select(F.col(name).alias("a")).filter("a IS NOT NULL").distinct()
    keyed = rows.select("a", F.explode(deletions("a", most)).alias("_k"))
    pairs = keyed.join(keyed.select(F.col("a").alias("b"), "_k"), "_k").filter("a < b").select("a", "b").distinct()
    return with_distance(pairs, "a", "b", most)


def suggestions(names: DataFrame, asked: str, most: int = 2, at_most: int = 5) -> DataFrame:
    """name, distance of the names nearest to the one asked for, a swap being one edit."""
    near = with_distance(names.select("name").distinct().withColumn("_asked", F.lit(asked)), "name", "_asked", most)
    return near.select("name", "distance").orderBy("distance", "name").limit(at_most)


def likely(names: DataFrame, asked: str, most: int = 2) -> DataFrame:
    """name, position (both given) of the names that are near in plain edits, or hold what was asked for; case counts for nothing, no limit."""
    low = F.lower("name")
    near = (F.levenshtein(low, F.lit(asked.lower())) <= most) | low.contains(asked.lower())
    return names.filter(near).select("position", "name")


def only_nearest(words: DataFrame, names: DataFrame, most: int = 2) -> DataFrame:
    """word, name: the nearest name in plain edits, if it is within `most` and no other is as near. An equi-join on what deletions leave."""
    keyed = words.select("word").distinct().withColumn("_k", F.explode(deletions("word", most)))
    known = names.select("name").distinct().withColumn("_k", F.explode(deletions("name", most)))
    pairs = keyed.join(known, "_k").select("word", "name").distinct().withColumn("d", F.levenshtein("word", "name")).filter(F.col("d") <= most)
    best = pairs.groupBy("word", "d").agg(F.min("name").alias("name"), F.count("*").alias("n"))
    return best.groupBy("word").agg(F.min_by(F.struct("name", "n"), "d").alias("b")).filter("b.n = 1").select("word", "b.name")
