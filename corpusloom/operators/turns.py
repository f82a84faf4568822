"""Instruction turns: choice of split and variants, audits, usable turns, label masks, held-out questions."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IGNORE = -100
# The variants that are trained and those that are listed as left out.
VARIANTS = ("fr_fr", "fr_long", "mos_mos", "traduction", "correction")
LEFT_OUT = ("fr_mos", "mos_fr")
# Fixed value: the seed of the held-out questions.
QUESTIONS_SEED = 20260912


def chosen(turns: DataFrame, split: str = "train", variants: tuple[str, ...] = VARIANTS) -> DataFrame:
    return turns.filter((F.col("split") == split) & F.col("variant").isin(*variants))


def unlisted_variants(turns: DataFrame, variants: tuple[str, ...] = VARIANTS, left_out: tuple[str, ...] = LEFT_OUT) -> DataFrame:
    """``variant, turns`` of the variants that no list names; a missing one is ``?``."""
    name = F.coalesce("variant", F.lit("?"))
    return turns.select(name.alias("variant")).filter(~F.col("variant").isin(*variants, *left_out)).groupBy("variant").agg(F.count("*").alias("turns"))


def counts(turns: DataFrame, column: str) -> DataFrame:
    return turns.groupBy(F.coalesce(column, F.lit("?")).alias(column)).agg(F.count("*").alias("turns"))


def top_tasks(turns: DataFrame, n: int = 8, pos: str = "turn_id") -> DataFrame:
    """The commonest tasks, of equals the one seen first."""
    by = turns.groupBy(F.coalesce("task", F.lit("?")).alias("task")).agg(F.count("*").alias("turns"), F.min(pos).alias("first"))
    return by.orderBy(F.desc("turns"), "first").limit(n).select("task", "turns")


def turn_length(messages: Column) -> Column:
    return F.aggregate(messages, F.lit(0).cast("long"), lambda n, m: n + F.coalesce(F.length(m["content"]), F.lit(0)))


def longest(turns: DataFrame) -> DataFrame:
    return turns.agg(F.coalesce(F.max(turn_length(F.col("messages"))), F.lit(0)).alias("longest"))


def usable(messages: Column, prompt_length: Column, full_length: Column, window: int = 2048) -> Column:
    """Two messages at least, the last the assistant's, and an answer that fits the window."""
    return F.coalesce((F.size(messages) >= 2) & (F.element_at(messages, -1)["role"] == "assistant") & (full_length <= window) & (prompt_length < full_length), F.lit(False))


def label_mask(ids: Column, prompt_length: Column, ignore: int = IGNORE) -> Column:
    """The ids with those of the prompt masked."""
    return F.transform(ids, lambda x, i: F.when(i < prompt_length, F.lit(ignore)).otherwise(x))


def question_candidates(turns: DataFrame, task: str = "expliquer_proverbe") -> DataFrame:
    return turns.filter((F.col("split") == "val") & F.col("variant").startswith("mos") & (F.col("task") == task))


def sampled(candidates: DataFrame, n: int = 12, seed: int = QUESTIONS_SEED, pos: str = "turn_id") -> DataFrame:
    """``n`` rows without replacement, by hash of seed and position: the same rows on every run; fewer than ``n`` raise."""
    rows = candidates.orderBy(F.md5(F.concat_ws(":", F.lit(seed), pos)), pos).limit(n)
    if (found := rows.count()) < n:
        raise ValueError(f"{found} candidates, {n} needed")
    return rows


def sampled_as_python(candidates: DataFrame, n: int = 12, seed: int = QUESTIONS_SEED, pos: str = "turn_id") -> DataFrame:
    """The rows that ``random.Random(seed).sample`` takes of the candidates in order; their places alone reach the driver."""
    total = candidates.count()
    if total < n:
        raise ValueError(f"{total} candidates, {n} needed")
    wanted = random.Random(seed).sample(range(total), n)
    places = candidates.sparkSession.createDataFrame([(p, k) for k, p in enumerate(wanted)], "place long, draw int")
    return numbered(candidates, pos).join(F.broadcast(places), "place").orderBy("draw").drop("place", "draw")


def numbered(rows: DataFrame, pos: str, name: str = "place") -> DataFrame:
    """Places from 0 in order of ``pos``: rows are ordered over all tasks, counted in each, and offset by the counts before."""
    from .packing import with_offsets

    return with_offsets(rows.withColumn("_one", F.lit(1)), [pos], "_one", name).drop("_one")


def numbered_within(rows: DataFrame, by: str, pos: str, name: str = "place") -> DataFrame:
    """Places from 0 in order of ``pos`` (null last) within each ``by``: those of all rows less the first of their group, so that a large group is no one task's."""
    from .packing import with_offsets

    placed = with_offsets(rows.withColumn("_one", F.lit(1)), [F.col(by), F.col(pos).asc_nulls_last()], "_one", name).drop("_one")
    first = placed.groupBy(F.col(by).alias("_by")).agg(F.min(name).alias("_first"))
    return placed.join(first, F.col(by).eqNullSafe(F.col("_by"))).withColumn(name, F.col(name) - F.col("_first")).drop("_by", "_first")


def ready(turns: DataFrame, leaks: DataFrame, missing_start: str | None) -> DataFrame:
    """One row of what a run needs and ``ready``."""
    train, val = chosen(turns), chosen(turns, "val")
    parts = train.agg(F.count("*").alias("train")).join(val.agg(F.count("*").alias("val")), how="cross").join(leaks.agg(F.count("*").alias("leaks")), how="cross")  # one row each
    one = parts.join(unlisted_variants(turns).agg(F.count("*").alias("unlisted")), how="cross").withColumn("start_missing", F.lit(missing_start).cast("string"))
    return one.withColumn("ready", (F.col("train") > 0) & (F.col("leaks") == 0) & (F.col("unlisted") == 0) & F.col("start_missing").isNull())
