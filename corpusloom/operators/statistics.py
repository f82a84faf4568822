"""Bits per character as ratios of sums, and their percentile bootstrap.

Resampling follows a fixed generator, so that an interval computed again is the one that
was reported: the draws of Python's ``random.Random(seed).randrange(n)``, made once for a
number of texts.  A group (one measurement, or a pair of them) has a few hundred texts;
groups are dealt over the executors, and only a row for each comes out.
"""

from __future__ import annotations

import functools
import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The seed, the number of resamples and the level of reported intervals.
SEED, RESAMPLES, LEVEL = 20260831, 2000, 0.95
#: Drawn places that are held at once.
HELD = 1 << 21
#: Slots of a draw that a row of plain SQL makes at once.
SLOTS = 1 << 16


def bits_per_character(nll: Column, chars: Column) -> Column:
    """Aggregate: total bits over total characters, NaN without characters."""
    total = F.sum(chars)
    return F.when(F.coalesce(total, F.lit(0)) == 0, F.lit(float("nan"))).otherwise(F.sum(nll) / math.log(2) / total)


def measured(per_text: DataFrame, by: list[str]) -> DataFrame:
    """``bits_per_character`` (4 digits), ``perplexity`` (3), ``tokens``, ``chars`` of ``nll, chars, tokens``; texts under two tokens weigh nothing."""
    long = F.col("tokens") >= 2
    rows = per_text.withColumn("nll", F.when(long, F.col("nll")).otherwise(0.0)).withColumn("chars", F.when(long, F.col("chars")).otherwise(0)).withColumn("tokens", F.when(long, F.col("tokens")).otherwise(0))
    perplexity = F.when(F.sum("tokens") > 0, F.exp(F.sum("nll") / F.sum("tokens"))).otherwise(F.lit(float("nan")))
    return rows.groupBy(*by).agg(F.round(bits_per_character(F.col("nll"), F.col("chars")), 4).alias("bits_per_character"), F.round(perplexity, 3).alias("perplexity"), F.sum("tokens").alias("tokens"), F.sum("chars").alias("chars"))


@functools.lru_cache(maxsize=4)
def python_draws(seed: int, n: int, resamples: int) -> np.ndarray:
    """(resamples, n) indices as ``random.Random(seed)`` gives them."""
    draw = random.Random(seed).randrange
    return np.array([[draw(n) for _ in range(n)] for _ in range(resamples)], dtype=np.int64).reshape(resamples, n)


def draws_in_parts(seed: int, n: int, resamples: int):
    """The rows of ``python_draws``, at most ``HELD`` places (or one row) at once."""
    if n * resamples <= HELD:
        yield python_draws(seed, n, resamples)
        return
    draw, step = random.Random(seed).randrange, max(1, HELD // n)
    for begin in range(0, resamples, step):
        rows = min(step, resamples - begin)
        yield np.fromiter((draw(n) for _ in range(rows * n)), np.int64, rows * n).reshape(rows, n)


def congruential_in_parts(seed: int, n: int, resamples: int, a: int = 7919, b: int = 104729):
    """Draws that plain SQL can make too: slot ``s`` of draw ``d`` takes place ``(a d + b s + d s) mod n``; the seed shifts the draws."""
    step, slot = max(1, HELD // n), np.arange(n, dtype=np.int64)
    for begin in range(0, resamples, step):
        draw = np.arange(begin, min(begin + step, resamples), dtype=np.int64)[:, None] + seed
        yield (a * draw + b * slot + draw * slot) % n


def bounds(values: np.ndarray, level: float) -> tuple[float, float]:
    """The two order statistics of a percentile interval; values that are not numbers are left out."""
    values = np.sort(values[~np.isnan(values)])
    if not len(values):
        return math.nan, math.nan
    tail, n = (1 - level) / 2, len(values)
    return float(values[int(tail * n)]), float(values[min(int((1 - tail) * n), n - 1)])


def ratios(nll: np.ndarray, chars: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(chars > 0, nll / math.log(2) / chars, np.nan)


def bootstrap(nll: np.ndarray, chars: np.ndarray, seed: int = SEED, resamples: int = RESAMPLES, level: float = LEVEL, draws=draws_in_parts) -> tuple[float, float, float]:
    """(value, low, high); each text's pair is drawn together.  Arrays (sides, texts) with two sides give second minus first."""
    nll, chars = np.atleast_2d(nll), np.atleast_2d(chars)
    whole = ratios(nll.sum(1), chars.sum(1))
    value = whole[-1] - whole[0] if len(whole) == 2 else whole[0]
    n = nll.shape[1]
    if n < 2:
        return float(value), float(value), float(value)
    parts = [[ratios(x[picked].sum(1), c[picked].sum(1)) for x, c in zip(nll, chars)] for picked in draws(seed, n, resamples)]
    drawn = [np.concatenate(side) for side in zip(*parts)]
    return float(value), *bounds(drawn[0] if len(drawn) == 1 else drawn[1] - drawn[0], level)


def intervals(per_text: DataFrame, by: list[str], seed: int = SEED, resamples: int = RESAMPLES, level: float = LEVEL, draws=draws_in_parts) -> DataFrame:
    """``value, low, high`` of each group of ``pos, nll, chars``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        found = bootstrap(pdf["nll"].to_numpy(float), pdf["chars"].to_numpy(float), seed, resamples, level, draws)
        return pd.DataFrame([[*pdf[by].iloc[0], *found]], columns=[*by, "value", "low", "high"])

    fields = ", ".join(f"{c} {per_text.schema[c].dataType.simpleString()}" for c in by)
    return per_text.select(*by, "pos", "nll", "chars").groupBy(*by).applyInPandas(run, f"{fields}, value double, low double, high double")


def differences(before: DataFrame, after: DataFrame, by: list[str], seed: int = SEED, resamples: int = RESAMPLES, level: float = LEVEL, draws=draws_in_parts) -> DataFrame:
    """``value, low, high`` of after minus before on the same texts, drawn in pairs; null where the two sides' places differ."""
    side = lambda df, s: df.select(*by, "pos", F.col("nll").alias(f"nll_{s}"), F.col("chars").alias(f"chars_{s}"))
    both = side(before, "b").join(side(after, "a"), [*by, "pos"], "full")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        sides = ["nll_b", "nll_a", "chars_b", "chars_a"]
        if pdf[sides].isna().any(axis=None):
            found = (None, None, None)
        else:
            nb, na, cb, ca = (pdf[c].to_numpy(float) for c in sides)
            found = bootstrap(np.stack([nb, na]), np.stack([cb, ca]), seed, resamples, level, draws)
        return pd.DataFrame([[*pdf[by].iloc[0], *found]], columns=[*by, "value", "low", "high"])

    fields = ", ".join(f"{c} {before.schema[c].dataType.simpleString()}" for c in by)
    return both.groupBy(*by).applyInPandas(run, f"{fields}, value double, low double, high double")


def congruential_draws(per_text: DataFrame, by: list[str], resamples: int, a: int = 7919, b: int = 104729) -> DataFrame:
    """Draws in plain SQL, for engines without Python's generator: slot ``s`` of draw ``d`` takes place ``(a d + b s + d s) mod n``.

    Returns the sums ``nll, chars`` of each group's draws; an equi-join on the place, never all pairs of texts.
    Places are reckoned in 64 bits, and slots are made ``SLOTS`` at once by all tasks, so that a group may have any number of texts.
    Spark takes the exploded slots for as small as what they are made of, so they are merged, never broadcast.
    """
    spark = per_text.sparkSession
    sizes = per_text.groupBy(*by).agg(F.count("*").alias("n"))
    parts = sizes.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).withColumn("begin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(SLOTS).cast("long"))))
    parts = parts.repartition(spark.sparkContext.defaultParallelism, *by, "draw", "begin")
    slots = parts.withColumn("slot", F.explode(F.sequence("begin", F.least(F.col("begin") + SLOTS, F.col("n")) - 1)))
    picked = slots.withColumn("pos", F.pmod(F.lit(a).cast("long") * F.col("draw") + (F.lit(b).cast("long") + F.col("draw")) * F.col("slot"), F.col("n"))).drop("begin", "slot")
    return picked.hint("merge").join(per_text.withColumn("pos", F.col("pos").cast("long")), [*by, "pos"]).groupBy(*by, "draw").agg(F.sum("nll").alias("nll"), F.sum("chars").alias("chars"))


def overlap(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    return (low_a <= high_b) & (low_b <= high_a)


def half_width(low: Column, high: Column) -> Column:
    return (high - low) / 2


def plus_minus(value: Column, low: Column, high: Column) -> Column:
    return F.format_string("%.4f +/- %.4f", value, half_width(low, high))


def percent_change(start: Column, end: Column) -> Column:
    return 100 * (end - start) / start


def verdict(low: Column, high: Column) -> Column:
    """Of a difference of costs: better under zero, worse over it."""
    return F.when(high < 0, "better").when(low > 0, "worse").otherwise("not separated")
