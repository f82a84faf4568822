"""Operator 7: mixing sources to target weights, in DataFrame functions only.

Words are counted once for each document and summed for each source before anything is
shuffled.  A source's target is its weight's share of all words, stopped at ``most``
times its own; the excess goes to the others by weight until none is above.  That fixed
point is min(most * size, level * weight) for one level, found with running sums over
the sources.  A document is then emitted floor(rate) times, and once more if a hash of
the seed and its id falls under the fraction, so reruns agree.

Cases: a null text has size 0; a null source is a source of its own, ordered last; a
source of no words has rate 0; rows that repeat an id decide alike; an empty table
gives no rows.  Columns named like those made here are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import BLANKS, unit_hash, whole_row, written

WEIGHTS = (5, 2, 1)
MOST = 3.0
SEED = "mix-1"


def n_words(text: Column) -> Column:
    """Number of runs without ASCII white space: the separators of the trimmed text and one; null: 0."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")
    bare = F.trim(bare)
    return F.when(bare == "", F.lit(0)).otherwise(F.length(bare) - F.length(F.replace(bare, F.lit(" "), F.lit(""))) + 1).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``: one row for each source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    picked = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    w = sizes.withColumn("weight", picked.cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    # in order of cap / weight: the level if those before are at their caps; it holds from the first source that it leaves under its cap, and falls after that one
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(order), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(order), F.lit(0.0)))
    found = w.withColumn("level", level).withColumn("level", F.max(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.col("level"))).over(every))
    return found.select("source", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight"))).alias("target"))


MADE = ("size", "source_size", "target", "rate", "copies")


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size`` in a table of their own, so that a plan reads each text once."""
    return written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST, seed: str = SEED, size: str | None = None) -> DataFrame:
    """``docs`` with ``size, source_size, target, rate, copies``; every row stays, those with no copy too.

    ``size`` names a column that has the sizes already.
    """
    counted = F.col(size) if size else n_words(F.col("text"))
    rows = docs.select(whole_row(docs), F.col("source").alias("source"), F.col("doc_id").alias("doc_id"), counted.alias("size"))
    per_source = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    # written, so that its size is known when the join is planned: rows are not shuffled for a few sources
    per_source = written(per_source.select(F.col("source").alias("of"), "source_size", "target"), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = rows.join(per_source, rows["source"].eqNullSafe(F.col("of")), "left").withColumn("rate", rate)
    extra = (unit_hash(seed, "doc_id") < F.col("rate") - F.floor("rate")).cast("long")
    planned = joined.withColumn("copies", F.floor("rate") + extra)
    return planned.select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in MADE), *MADE)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: ``docs``' columns, each document as often as its copies."""
    plan = mix_plan(docs.select(whole_row(docs), "doc_id", "source", "text"), **options)
    return plan.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
