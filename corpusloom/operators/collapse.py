"""Generations that have collapsed: many answers with one opening, or one answer to several questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def _largest(answers: DataFrame, by: list[str], key: Column) -> DataFrame:
    """Grouped twice: the count of a common answer is combined before it is shuffled."""
    groups = answers.groupBy(*by, key.alias("_key")).agg(F.count("*").alias("n"))
    return groups.groupBy(*by).agg(F.count("*").alias("distinct_groups"), F.max("n").alias("largest"), F.sum("n").alias("answers"))


def openings(answers: DataFrame, by: list[str], words: int = 2, text: str = "obtenu") -> DataFrame:
    """``distinct_groups, largest, answers`` by the first words."""
    return _largest(answers, by, T.opening(F.col(text), words))


def repeats(answers: DataFrame, by: list[str], text: str = "obtenu") -> DataFrame:
    """The same by whole answers."""
    return _largest(answers, by, F.col(text))


def verdicts(answers: DataFrame, by: list[str], words: int = 2, text: str = "obtenu") -> DataFrame:
    """``answers_each`` (no answer twice), ``speaks_to_each`` (no opening for a majority) and ``collapsed``: why, or null."""
    o = openings(answers, by, words, text).select(*by, F.col("distinct_groups").alias("openings"), F.col("largest").alias("opening_largest"))
    r = repeats(answers, by, text).select(*by, F.col("distinct_groups").alias("distinct_answers"), F.col("largest").alias("answer_largest"), "answers")
    joined = o.join(r, by)
    each, speaks = F.col("answer_largest") < 2, F.col("opening_largest") * 2 <= F.col("answers")
    why = F.when(~each, F.format_string("%d distinct answers for %d questions, one is given %d times", "distinct_answers", "answers", "answer_largest")).when(
        ~speaks, F.format_string("%d openings for %d questions, the largest answers %d of them", "openings", "answers", "opening_largest")
    )
    return joined.withColumn("answers_each", each).withColumn("speaks_to_each", speaks).withColumn("collapsed", why)


def answer_key(arm: Column, point: Column) -> Column:
    """``arm, step``: the step is what follows the last ``checkpoint-``, or the whole name."""
    tail = F.substring_index(point, "checkpoint-", -1)
    return F.struct(arm.alias("arm"), F.when(tail == "", point).otherwise(tail).alias("step"))


def counted_answers(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Answers (``depart, point, obtenu, question``) to the current questions, whatever their words' order, with ``arm, step``.

    Answers without a question are left out.
    """
    current = questions.select(T.bag_of_words(F.col("question")).alias("_bag")).distinct()
    keyed = answers.withColumn("_bag", T.bag_of_words(F.col("question"))).join(current, "_bag", "left_semi").drop("_bag")
    arm = F.split_part(F.coalesce("depart", F.lit("")), F.lit("@"), F.lit(1))
    return keyed.withColumn("_key", answer_key(F.when(arm == "", "?").otherwise(arm), F.col("point"))).select("*", "_key.arm", "_key.step").drop("_key")


def mean_echo(probes: DataFrame, by: list[str], family: str = "conversation_moore") -> DataFrame:
    """Mean share of a question's words that its answer repeats, to 3 digits; null without probes of the family."""
    own = F.when(F.col("famille") == family, T.overlap(F.col("prompt"), F.col("reponse")))
    return probes.groupBy(*by).agg(F.round(F.avg(own), 3).alias("echo"))
