"""chrF and chrF++ of a corpus from summed sentence statistics, and their paired bootstrap.

As published: character n-grams up to 6 without white space, for chrF++ word n-grams up to
2 with punctuation apart, beta 2; precision and recall are averaged over the orders that
both sides have.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .statistics import draws_in_parts

CHARS, BETA = 6, 2
# Seed and draws of the reported intervals.
SEED, DRAWS = 20260825, 1000
#: Pairs whose n-grams are counted together.
PAIRS = 256
PUNCTUATION = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def words_of(sentence: str) -> list[str]:
    """Words with one mark of punctuation at an end apart."""
    out = []
    for w in sentence.split():
        if len(w) > 1 and w[-1] in PUNCTUATION:
            out += [w[:-1], w[-1]]
        elif len(w) > 1 and w[0] in PUNCTUATION:
            out += [w[0], w[1:]]
        else:
            out.append(w)
    return out


def _units(sentences: list[list], known: dict) -> tuple[np.ndarray, np.ndarray]:
    """(number of each unit, sentence of each unit) of sentences one after another."""
    flat = np.fromiter((known.setdefault(u, len(known)) for s in sentences for u in s), np.int64)
    return flat, np.repeat(np.arange(len(sentences)), [len(s) for s in sentences])


def _matched(sides: list[tuple[np.ndarray, np.ndarray]], most: int, pairs: int) -> list[np.ndarray]:
    """For each order up to ``most``: n-grams of the first side, of the second, and those that match, by pair."""
    out = []
    units = [u for u, _ in sides]
    width = 1 + max((int(u.max()) for u in units if len(u)), default=0)
    grams = units
    for n in range(1, most + 1):
        if n > 1:  # each n-gram is its first n - 1 units and its last
            codes = [g[: max(0, len(u) - n + 1)] * width + u[n - 1 :] for g, u in zip(grams, units)]
            _, numbers = np.unique(np.concatenate(codes), return_inverse=True)
            grams = [numbers[: len(codes[0])], numbers[len(codes[0]) :]]
        size = 1 + max((int(g.max()) for g in grams if len(g)), default=0)
        # n-grams that reach into the next sentence have a number, but do not count
        inside = [of[: len(g)][of[: len(g)] == of[n - 1 :]] * size + g[of[: len(g)] == of[n - 1 :]] for g, (_, of) in zip(grams, sides)]
        (h, hn), (r, rn) = (np.unique(x, return_counts=True) for x in inside)
        both, i, j = np.intersect1d(h, r, assume_unique=True, return_indices=True)
        out += [np.bincount(k // size, weights=w, minlength=pairs) for k, w in ((h, hn), (r, rn), (both, np.minimum(hn[i], rn[j])))]
    return out


def batch_statistics(hypotheses: list[str | None], references: list[str | None], word_order: int = 0) -> np.ndarray:
    """For each pair and order the n-grams of the hypothesis, of the reference, and those that match."""
    n = len(hypotheses)
    texts = [[s or "" for s in side] for side in (hypotheses, references)]
    bare = [["".join(s.split()) for s in side] for side in texts]
    chars = [(np.frombuffer("".join(side).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64), np.repeat(np.arange(n), [len(s) for s in side])) for side in bare]
    columns = _matched(chars, CHARS, n)
    if word_order:
        known: dict = {}
        columns += _matched([_units([words_of(s) for s in side], known) for side in texts], word_order, n)
    return np.stack(columns, axis=1) if n else np.empty((0, 3 * (CHARS + word_order)))


def f_score(stats: np.ndarray, beta: int = BETA) -> np.ndarray:
    """Of (..., 3 * orders) sums, in percent."""
    s = np.asarray(stats, dtype=float).reshape(*np.shape(stats)[:-1], -1, 3)
    h, r, m = s[..., 0], s[..., 1], s[..., 2]
    both = (h > 0) & (r > 0)
    n = np.maximum(both.sum(-1), 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        p = np.where(both, m / h, 0).sum(-1) / n
        q = np.where(both, m / r, 0).sum(-1) / n
        score = (1 + beta**2) * p * q / (beta**2 * p + q)
    return 100 * np.nan_to_num(score)


def statistics(rows: DataFrame, word_order: int = 0) -> DataFrame:
    """``rows`` (with ``hypothesis, reference``) and ``stats array<double>``."""

    def run(hypotheses: pd.Series, references: pd.Series) -> pd.Series:
        found = [batch_statistics(hypotheses.iloc[a : a + PAIRS].tolist(), references.iloc[a : a + PAIRS].tolist(), word_order) for a in range(0, len(hypotheses), PAIRS)]
        return pd.Series([row for part in found for row in part])

    return rows.withColumn("stats", F.pandas_udf(run, "array<double>")("hypothesis", "reference"))


def corpus_score(rows: DataFrame, by: list[str], word_order: int = 0) -> DataFrame:
    """``chrf`` of each group, to 2 digits, from statistics summed by order before the ratio is taken."""
    long = statistics(rows, word_order).select(*by, F.posexplode("stats").alias("at", "n"))
    sums = long.groupBy(*by, F.floor(F.col("at") / 3).alias("of")).agg(*(F.sum(F.when(F.col("at") % 3 == k, F.col("n"))).alias(c) for k, c in enumerate("hrm")))
    both = (F.col("h") > 0) & (F.col("r") > 0)
    mean = lambda x: F.coalesce(F.avg(F.when(both, x)), F.lit(0.0))
    parts = sums.groupBy(*by).agg(mean(F.col("m") / F.col("h")).alias("p"), mean(F.col("m") / F.col("r")).alias("q"))
    score = F.when(F.col("p") + F.col("q") > 0, (1 + BETA**2) * F.col("p") * F.col("q") / (BETA**2 * F.col("p") + F.col("q"))).otherwise(0.0)
    return parts.select(*by, F.round(100 * score, 2).alias("chrf"))


def aligned(left: DataFrame, right: DataFrame) -> DataFrame:
    """``id, pos, left_text, right_text`` by id, in the left's order; of repeated right ids the last counts; a left id without a match raises."""
    one = right.groupBy("id").agg(F.max_by("text", "pos").alias("right_text"))
    joined = left.select("id", "pos", F.col("text").alias("left_text")).join(one.withColumn("_there", F.lit(True)), "id", "left")
    text = F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit("no line for id "), F.col("id").cast("string")))).otherwise(F.col("right_text"))
    return joined.select("id", "pos", "left_text", text.alias("right_text")).orderBy("pos")


def paired(rows: DataFrame, comparisons: list[tuple[str, str]], seed: int = SEED, draws: int = DRAWS, generator=draws_in_parts) -> DataFrame:
    """``direction, a, b, difference, low, high`` of ``name, direction, pos, hypothesis, reference``: the same draws for all pairs."""
    spark = rows.sparkSession
    pairs = spark.createDataFrame([(a, b) for a, b in comparisons], "a string, b string")
    stats = statistics(rows).select("name", "direction", "pos", "stats")
    side = lambda s: stats.select(F.col("name").alias(s), "direction", "pos", F.col("stats").alias(f"stats_{s}"))
    both = F.broadcast(pairs).join(side("a"), "a").join(side("b"), ["b", "direction", "pos"])  # the pairs are as given

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        a, b = (np.stack(pdf[c].to_numpy()).astype(float) for c in ("stats_a", "stats_b"))
        found = np.sort(np.concatenate([f_score(a[picked].sum(1)) - f_score(b[picked].sum(1)) for picked in generator(seed, len(a), draws)]))
        value = f_score(a.sum(0)) - f_score(b.sum(0))
        return pd.DataFrame([[*pdf[["direction", "a", "b"]].iloc[0], float(value), found[int(0.025 * draws)], found[int(0.975 * draws)]]], columns=["direction", "a", "b", "difference", "low", "high"])

    return both.groupBy("direction", "a", "b").applyInPandas(run, "direction string, a string, b string, difference double, low double, high double")
