"""Mix sources to target weights with hash-threshold histograms.

Every row has a hash of 60 bits. A source's budget is met by the rows below a threshold of that hash: sums of
words by source and hash bucket (12 bits a level) say in which bucket the threshold lies, and only that bucket is
refined at the next level. Nothing is sorted; the rows of a smaller budget are always among those of a larger one.
The table of sources has a row for each source; ranking them takes one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.llm.common import fresh, materialize, n_words, quoted, tidy

BITS, LEVEL = 60, 12
WEIGHTS = (3.0, 1.0, 2.0)


def row_hash(seed: int) -> Column:
    """60 bits from all that tells rows apart; rows that repeat entirely share it, and are taken or left together."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "source", "text"), 64 - BITS)


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes: (source, source_size). Adds target: share of all sizes dealt by weight, at most `most` times a source's
    size; what is above is dealt again by weight among the others. Sources go by code point, null last, and take the
    weights in turn."""
    ranked = sizes.withColumn("at", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("at") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("most", F.lit(float(most)) * F.col("source_size"))
    up = Window.orderBy(F.col("most") / F.col("w"), "at")
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = F.coalesce(F.sum("most").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("w").over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    ranked = ranked.withColumn("level", (F.lit(float(share)) * F.sum("source_size").over(every) - full) / left)
    first = F.first(F.when(F.col("level") <= F.col("most") / F.col("w"), F.col("level")), ignorenulls=True)
    ranked = ranked.withColumn("level", first.over(up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least("most", F.coalesce(F.col("level") * F.col("w"), F.col("most")))
    return ranked.select("source", "source_size", target.alias("target"))


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """sized: (source, size, h); goals: (source, source_size, target). A row for each source, with the whole copies of
    everything it gives and the hash below which rows are taken once more."""
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = goals.withColumn("copies", copies)
    state = state.withColumn("rest", F.greatest(F.col("target") - F.col("copies") * F.col("source_size"), F.lit(0.0)))
    state = materialize(state.select("*", F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("rows")), "mix")
    for depth in range(BITS // LEVEL):
        width = 1 << (BITS - LEVEL * (depth + 1))
        bounds = state.select(F.col("source").alias("of"), F.col("lo").alias("from"))
        inside = sized.join(bounds, F.col("source").eqNullSafe(F.col("of"))) if depth else sized.withColumn("from", F.lit(0).cast("long"))
        if depth:
            inside = inside.where((F.col("h") >= F.col("from")) & (F.col("h") < F.col("from") + (width << LEVEL)))
        bucket = F.shiftright(F.col("h") - F.col("from"), BITS - LEVEL * (depth + 1))
        hist = inside.groupBy("source", bucket.alias("b")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"))
        run = F.sum("words").over(Window.partitionBy("source").orderBy("b"))
        hist = hist.withColumn("upto", run).select(F.col("source").alias("of"), "b", "words", "rows", "upto")
        near = state.drop("words", "rows").join(hist, F.col("source").eqNullSafe(F.col("of")))
        first = F.min(F.when(F.col("upto") >= F.col("rest"), F.struct("b", "words", "rows", "upto")))
        last = F.max(F.struct("b", "words", "rows", "upto"))
        near = near.groupBy("source", "source_size", "target", "copies", "rest", "lo").agg(F.coalesce(first, last).alias("at"))
        state = materialize(
            near.select(
                "source", "source_size", "target", "copies",
                F.greatest(F.col("rest") - (F.col("at.upto") - F.col("at.words")), F.lit(0.0)).alias("rest"),
                (F.col("lo") + F.col("at.b") * F.lit(width)).alias("lo"),
                F.col("at.words").cast("long").alias("words"), F.col("at.rows").cast("long").alias("rows"),
            ),
            "mix",
        )
        if state.where("rows > 1").isEmpty():
            break
    above = F.when(F.col("rest") * 2 >= F.col("words"), F.col("lo") + width).otherwise(F.col("lo"))
    return state.select("source", "source_size", "target", "copies", above.alias("below"))


def _plan(docs: DataFrame, weights: Sequence[float], share: float, most: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """(sized, bounds): each row's doc_id, source, size and hash, and thresholds()."""
    sized = materialize(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), row_hash(seed).alias("h")), "sizes")
    sizes = materialize(sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")), "sources")
    return sized, thresholds(sized, targets(sizes, weights, share, most))


@tidy
def plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 0) -> DataFrame:
    """thresholds() of the sources of docs."""
    return _plan(docs, weights, share, most, seed)[1]


def _times() -> Column:
    return F.col("copies") + F.when(F.col("h") < F.col("below"), 1).otherwise(0)


@tidy
def mixture(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 0) -> DataFrame:
    """docs: doc_id, source, text. A row for each input row: doc_id, source, size, source_size, target, copies, taken.

    A null text has size 0; a null source is a source of its own; rows that repeat entirely get the same copies, each
    of them counted. An empty table gives an empty result.
    """
    sized, bounds = _plan(docs, weights, share, most, seed)
    both = sized.join(bounds.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    return both.select("doc_id", "source", "size", "source_size", "target", _times().alias("copies"), (F.col("size") * _times()).alias("taken"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 0) -> DataFrame:
    """The mix itself: all columns of docs, whatever their names, a row for each copy that is taken, numbered from 1 in
    mix_copy, which gets underscores where docs has such a column. Null and empty texts have size 0 and are taken as their
    source is; rows that repeat entirely are taken alike; an empty table gives an empty mix."""
    bounds = plan(docs, weights, share, most, seed)
    bound, copy = fresh("bound", docs.columns), fresh("mix_copy", docs.columns)
    own = bounds.select(F.struct("source", "copies", "below").alias(bound))
    times = F.col(f"{bound}.copies") + F.when(row_hash(seed) < F.col(f"{bound}.below"), 1).otherwise(0)
    both = docs.join(own, F.col("source").eqNullSafe(F.col(f"{bound}.source")))
    copies = F.when(times > 0, F.sequence(F.lit(1).cast("long"), times)).otherwise(F.array().cast("array<bigint>"))
    return both.select(*map(quoted, docs.columns), F.explode(copies).alias(copy))
