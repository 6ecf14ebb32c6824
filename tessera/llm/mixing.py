"""Mixing sources to target weights: entropy balancing, in DataFrame operations alone.

Document rates r = exp(l * size / mean size of the source), at most MAX_RATE, are the rates nearest to 1
in relative entropy whose words sum to the source's target. The dual is convex and falls apart by source:
one l each, found by Newton steps on the logarithm of the words, repeated until every source has settled. The steps run on the counts of (source,
size), so a hot source costs as many rows as it has sizes. Rates become copies: the whole part,
and one more where the fraction beats the document's draw (a hash) by more than a threshold, which two
passes over histograms of these margins set so that the source's words come nearest to the target.

Targets: sources in code-point order, null last, weigh 1, 2, 3, 1, ...; they share all words by weight,
none above MAX_RATE times its own; the excess goes to the others by weight.

Copies hang on (doc_id, source, size) alone: ties in draws go the same way, and no text moves for them.

Edge cases: a null text has size 0; a document of size 0 has one copy of no words. A null source is a source.
Repeated rows share their draw. An empty table gives no rows. The input's columns keep their names;
the operator's own are prefixed, so that names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.shared import discard, sheltered, written

WORD = "[^\\x20\\x09-\\x0D]+"
MAX_RATE = 3
#: Steps between two looks at how far the sources are from their targets; bisection alone needs some 60 in all.
STEPS_PER_TABLE = 4
MOST_STEPS = 120
MOST_TILT = 1e6
#: A source has settled when its words are so near to its target, relatively.
SETTLED = 1e-9
BINS = 4096


def sized(docs: DataFrame) -> DataFrame:
    """With _size (words) and _key (the source, so that null is a key too)."""
    return docs.withColumns({"_size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"), "_key": F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("t"))})


def targets(by_source: DataFrame) -> DataFrame:
    """_key, _source_size, _target, _mean from the sources' sums: one row a source, so that windows over all are small."""
    every = Window.partitionBy()
    weighed = by_source.withColumn("_weight", 1 + (F.row_number().over(Window.orderBy("_key")) - 1) % 3)
    capped = weighed.withColumns({"_cap": MAX_RATE * F.col("_source_size"), "_all": F.sum("_source_size").over(every), "_weights": F.sum("_weight").over(every)})
    capped = capped.withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    before = Window.orderBy("_ratio", "_key").rowsBetween(Window.unboundedPreceding, -1)
    level = capped.withColumn("_level", (F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / (F.col("_weights") - F.coalesce(F.sum("_weight").over(before), F.lit(0))))
    # sources by rising ratio: the first that the level does not fill sets the level of all that follow
    filled = level.withColumn("_theta", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_key", "_level"))).over(every)["_level"])
    return filled.select("_key", "_source_size", "_mean", F.when(F.col("_theta").isNull(), F.col("_cap").cast("double")).otherwise(F.least(F.col("_cap").cast("double"), F.col("_theta") * F.col("_weight"))).alias("_target"))


def rate(tilt: Column, size: Column, mean: Column) -> Column:
    return F.when(F.col("_full"), F.lit(float(MAX_RATE))).otherwise(F.least(F.lit(float(MAX_RATE)), F.exp(F.least(F.lit(50.0), tilt * size / mean))))


def newton_step(counts: DataFrame, state: DataFrame) -> DataFrame:
    r = rate(F.col("_tilt"), F.col("_size"), F.col("_mean"))
    words = F.col("_n") * F.col("_size")
    moment = F.when(r < MAX_RATE, words * r * F.col("_size") / F.col("_mean")).otherwise(F.lit(0.0))
    sums = counts.join(state, "_key").groupBy("_key").agg(*(F.first(c).alias(c) for c in ("_source_size", "_mean", "_target", "_full", "_tilt", "_lo", "_hi")), F.sum(words * r).alias("_words"), F.sum(moment).alias("_slope"))
    low = F.when(F.col("_words") < F.col("_target"), F.col("_tilt")).otherwise(F.col("_lo"))
    high = F.when(F.col("_words") > F.col("_target"), F.col("_tilt")).otherwise(F.col("_hi"))
    bracket = sums.withColumns({"_lo": low, "_hi": high, "_next": F.col("_tilt") - F.log(F.try_divide("_words", "_target")) * F.try_divide("_words", "_slope")})
    inside = F.col("_next").isNotNull() & ~F.isnan("_next") & (F.col("_next") > F.col("_lo")) & (F.col("_next") < F.col("_hi"))
    middle = (F.col("_lo") + F.col("_hi")) / 2
    # none left either where the bracket has closed: no tilt brings the words nearer
    closed = F.col("_hi") - F.col("_lo") <= 1e-12 * F.greatest(F.lit(1.0), F.abs("_tilt"))
    gap = F.when(closed, F.lit(0.0)).otherwise(F.coalesce(F.abs(F.log(F.try_divide("_words", "_target"))), F.lit(0.0)))
    tilt = F.when(gap < SETTLED, F.col("_tilt")).when(inside, F.col("_next")).otherwise(middle)
    return bracket.select("_key", "_source_size", "_mean", "_target", "_full", tilt.alias("_tilt"), "_lo", "_hi", gap.alias("_gap"))


def balanced(rows: DataFrame) -> DataFrame:
    """A row a source: _key, _source_size, _mean, _target, _full, _tilt. rows: _key, _size."""
    counts = written(rows.groupBy("_key", "_size").agg(F.count("*").alias("_n")), "sizes")
    by_source = counts.groupBy("_key").agg(F.sum(F.col("_n") * F.col("_size")).alias("_source_size"), F.sum("_n").alias("_docs"))
    by_source = by_source.select("_key", "_source_size", F.greatest(F.lit(1.0), F.col("_source_size") / F.col("_docs")).alias("_mean"))
    state = targets(by_source).withColumns({"_full": F.col("_target") >= MAX_RATE * F.col("_source_size") * (1 - 1e-12), "_tilt": F.lit(0.0), "_lo": F.lit(-MOST_TILT), "_hi": F.lit(MOST_TILT)})
    state = written(state, "tilts")
    for _ in range(0, MOST_STEPS, STEPS_PER_TABLE):
        before = state
        for _ in range(STEPS_PER_TABLE):
            state = newton_step(counts, state)
        state = written(state, "tilts")
        discard(before)
        if (state.agg(F.max("_gap")).first()[0] or 0.0) < SETTLED:
            discard(counts)
            return state.drop("_lo", "_hi", "_gap")
    raise RuntimeError("a source did not settle at its target")


def with_margin(rows: DataFrame, state: DataFrame) -> DataFrame:
    """_base copies, and the margin (fraction less draw, from -1 to 1) in two levels of bins."""
    drawn = F.pmod(F.xxhash64("doc_id", "_key"), F.lit(1 << 30)) / float(1 << 30)
    out = rows.join(state, "_key").withColumn("_rate", rate(F.col("_tilt"), F.col("_size"), F.col("_mean")))
    out = out.withColumns({"_base": F.floor("_rate"), "_place": (1 - (F.col("_rate") - F.floor("_rate") - drawn)) / 2 * BINS})
    out = out.withColumns({"_bin": F.floor("_place"), "_sub": F.floor((F.col("_place") - F.floor("_place")) * BINS)})
    return out.withColumn("_open", (F.col("_base") < MAX_RATE) & (F.col("_size") > 0))


def crossing(bins: DataFrame, state: DataFrame, level: str, before: str) -> DataFrame:
    """The bin of each source in which its extra words reach what is needed, and the words of the bins before it."""
    order = Window.partitionBy("_key").orderBy(level)
    summed = bins.join(state, "_key").withColumn("_upto", F.sum("_words").over(order) + F.col(before))
    found = summed.filter((F.col("_upto") >= F.col("_need")) & (F.col("_upto") - F.col("_words") < F.col("_need")))
    return found.groupBy("_key").agg(F.min(F.struct(level, (F.col("_upto") - F.col("_words")).alias("_done"), "_words", "_need")).alias("_x")).select("_key", F.col("_x")[level].alias(f"{level}_at"), F.col("_x._done").alias("_done"), F.col("_x._words").alias("_there"), F.col("_x._need").alias("_need"))


def mix(docs: DataFrame, columns: tuple[str, ...] | None = None) -> DataFrame:
    """The chosen columns of docs (all if None) with _size, _source_size, _target, _rate and _copies."""
    kept = docs.columns if columns is None else list(columns)
    rows = sized(docs)
    if columns is not None:  # small rows: read the texts once
        rows = written(rows.select(*kept, "_size", "_key"), "mixed")
    state = balanced(rows.select("_key", "_size"))
    margins = with_margin(rows.select("doc_id", "_key", "_size"), state)
    bins = written(margins.groupBy("_key", "_bin", "_sub").agg(F.sum(F.when(F.col("_open"), F.col("_size")).otherwise(0)).alias("_words"), F.sum(F.col("_base") * F.col("_size")).alias("_whole")), "margins")
    need = bins.groupBy("_key").agg(F.sum("_whole").alias("_whole")).join(state.select("_key", "_target"), "_key").select("_key", (F.col("_target") - F.col("_whole")).alias("_need"), F.lit(0).cast("long").alias("_none"))
    first = crossing(bins.groupBy("_key", "_bin").agg(F.sum("_words").alias("_words")), need, "_bin", "_none")
    inner = bins.join(first.select("_key", "_bin_at", "_done", "_need"), "_key").filter(F.col("_bin") == F.col("_bin_at")).groupBy("_key", "_sub").agg(F.sum("_words").alias("_words"))
    second = crossing(inner, first.select("_key", "_bin_at", "_done", "_need"), "_sub", "_done")
    last = second.select("_key", "_sub_at", (F.col("_need") - F.col("_done") > F.col("_done") + F.col("_there") - F.col("_need")).alias("_with_last"))
    limits = state.join(need.select("_key", "_need"), "_key").join(first.select("_key", "_bin_at"), "_key", "left").join(last, "_key", "left")
    limits = written(limits, "limits")  # a row a source, of known size: Spark broadcasts it if it is small, so that no text moves
    marked = with_margin(rows, limits)
    beyond = F.col("_need") > 0  # no crossing: all that are open, or none
    extra = F.when(F.col("_bin_at").isNull(), beyond).when(F.col("_bin") != F.col("_bin_at"), F.col("_bin") < F.col("_bin_at")).when(F.col("_sub") != F.col("_sub_at"), F.col("_sub") < F.col("_sub_at")).otherwise(F.col("_with_last"))
    copies = F.col("_base") + F.when(F.col("_open") & F.coalesce(extra, F.lit(False)), 1).otherwise(0)
    return marked.select(*kept, "_size", "_source_size", "_target", "_rate", F.when(F.col("_size") == 0, 1).otherwise(copies).cast("long").alias("_copies"))


def copied(docs: DataFrame) -> DataFrame:
    """Each document as often as its copies say; the columns of docs."""
    rows, restored = sheltered(docs, "doc_id", "text", "source")
    mixed = mix(rows).filter("_copies > 0")
    return restored(mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), ("doc_id", "source"))
    return mixed.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"), F.col("_copies").alias("copies"), F.round("_rate", 6).alias("rate"))
