"""Factual probes: four verdicts for an answer, tallies, re-scoring, flips against a base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import unicode

# The verdicts as they are stored.
RIGHT, TRAPPED, UNCLEAR, UNKNOWN = "juste", "piege", "ambigu", "faux"
VERDICTS = (RIGHT, TRAPPED, UNCLEAR, UNKNOWN)
BUDGET = 320
APOSTROPHES = "’ʼ‘"
EDGE = r"[\p{L}\p{N}_]"
# What a pattern reads as more than itself.
SPECIAL = r"([\\.\[\]{}()*+?^$|#&~\-])"


def normalised(text: Column, exact: bool = True) -> Column:
    """Case-folded, with one kind of apostrophe; accents stay."""
    return F.translate(T.folded(text, exact), APOSTROPHES, "'" * len(APOSTROPHES))


def contains(needle: Column, haystack: Column) -> Column:
    """Whether a normalised needle stands in a normalised text between word boundaries; a trailing ``*`` leaves its end open.

    A boundary is where a word character meets another character or the text's end; each end of the needle asks for
    one in view of its own character.
    """
    open_end = needle.endswith("*")
    stem = F.when(open_end, F.substr(needle, F.lit(1), F.length(needle) - 1)).otherwise(needle)
    quoted = F.regexp_replace(stem, SPECIAL, r"\\$1")
    front = F.when(stem.rlike(f"^{EDGE}"), f"(?<!{EDGE})").otherwise(f"(?<={EDGE})")
    back = F.when(open_end, "").when(stem.rlike(f"{EDGE}$"), f"(?!{EDGE})").otherwise(f"(?={EDGE})")
    # an empty stem is at any boundary
    blank = F.when(open_end, f"(?<!{EDGE})(?={EDGE})|(?<={EDGE})(?!{EDGE})").otherwise(f"(?<!{EDGE})(?={EDGE})|(?<={EDGE})(?!{EDGE})")
    return F.regexp_like(haystack, F.when(stem == "", blank).otherwise(F.concat(front, quoted, back)))


GAP = "\u0001"


def _each(items: Column, f) -> Column:
    """``f`` of the texts of a list, folded as one text whose parts a character keeps apart that texts do not have; null is an empty list."""
    return F.when(F.size(items) > 0, F.split(f(F.array_join(items, GAP)), GAP)).otherwise(F.array().cast("array<string>"))


def score(answer: Column, expected: Column, traps: Column, complete: Column | None = None, exact: bool = True) -> Column:
    """The verdict; an answer that was cut short and has neither is unclear."""
    hay = normalised(answer, exact)

    def any_of(items: Column) -> Column:
        found = _each(items, lambda t: normalised(t, exact))
        # beside each needle its text, as a lambda may not call a Python function
        return F.exists(F.arrays_zip(found.alias("n"), F.array_repeat(hay, F.size(found)).alias("h")), lambda x: contains(x["n"], x["h"]))

    right, trapped = any_of(expected), any_of(traps)
    whole = F.lit(True) if complete is None else F.coalesce(complete, F.lit(True))
    return F.when(right & trapped, UNCLEAR).when(right, RIGHT).when(trapped, TRAPPED).when(whole, UNKNOWN).otherwise(UNCLEAR)


def flattened(text: Column, exact: bool = True) -> Column:
    """Case-folded without accents."""
    return F.regexp_replace(unicode.nfd(unicode.casefold(text)) if exact else T.folded(text, False), r"\p{Mn}", "")


def present(needle: Column, haystack: Column) -> Column:
    """Of flattened texts: a number stands between other characters than digits, anything else anywhere."""
    numeric = F.regexp_replace(needle, "[ .]", "").rlike(r"^\p{Nd}+$")
    quoted = F.regexp_replace(needle, SPECIAL, r"\\$1")
    return F.when(numeric, F.regexp_like(haystack, F.concat(F.lit(r"(?<!\p{Nd})"), quoted, F.lit(r"(?!\p{Nd})")))).otherwise(F.contains(haystack, needle))


def judged(rows: DataFrame, exact: bool = True) -> DataFrame:
    """The second scorer's ``verdict`` of ``answer, expected, traps``: plain containment without accents, no word boundaries."""
    flat = rows.withColumn("_a", flattened(F.col("answer"), exact)).withColumns({f"_{c}": _each(F.col(c), lambda t: flattened(t, exact)) for c in ("expected", "traps")})
    right = F.exists("_expected", lambda x: present(x, F.col("_a")))
    trapped = F.exists("_traps", lambda x: present(x, F.col("_a")))
    return flat.withColumn("verdict", F.when(right & trapped, UNCLEAR).when(right, RIGHT).when(trapped, TRAPPED).otherwise(UNKNOWN)).drop("_a", "_expected", "_traps")


def tally(rows: DataFrame, by: list[str], verdict: str = "note") -> DataFrame:
    """A column for each verdict, zeros kept."""
    return rows.groupBy(*by).agg(*(F.count_if(F.col(verdict) == v).alias(v) for v in VERDICTS))


def budget_of(budget: Column, faits: Column) -> Column:
    """The token budget that a point's answers had: its own field, else told from its answers' fields."""
    return F.coalesce(budget, F.when((F.size(faits) > 0) & faits[0]["complet"].isNotNull(), 128).otherwise(48))


def answers_the_probe(budget: Column, ids: Column, probe_ids: Column, wanted: int = BUDGET) -> Column:
    """Whether a point has answered these items at this budget."""
    return F.coalesce(budget == wanted, F.lit(False)) & (F.array_sort(F.array_distinct(ids)) == F.array_sort(F.array_distinct(probe_ids)))


def rescored(answers: DataFrame, facts: DataFrame) -> DataFrame:
    """``answers`` (``id, note, reponse, complet``) with ``new_note`` from ``facts`` (``id, attendu, piege``); an unknown id raises."""
    known = facts.select("id", "attendu", "piege", F.lit(True).alias("_known"))
    joined = answers.join(known, "id", "left")
    note = F.when(F.col("_known").isNull(), F.raise_error(F.concat(F.lit("no such fact: "), F.coalesce("id", F.lit("null"))))).otherwise(score(F.col("reponse"), F.col("attendu"), F.col("piege"), F.col("complet")))
    return joined.withColumn("new_note", note).drop("attendu", "piege", "_known")


def changed(rows: DataFrame) -> DataFrame:
    """Re-scored rows whose verdict is another: with ``change`` as ``id before->after``."""
    return rows.filter(~F.col("note").eqNullSafe(F.col("new_note"))).withColumn("change", F.concat("id", F.lit(" "), F.coalesce("note", F.lit("")), F.lit("->"), "new_note"))


def flips(base: DataFrame, now: DataFrame) -> DataFrame:
    """``id, lost, gained`` of each item of ``now`` against the base's verdict (both ``id, note``); an item the base lacks is neither."""
    joined = now.join(base.select("id", F.col("note").alias("was")), "id", "left")
    was, is_ = F.col("was") == RIGHT, F.col("note") == RIGHT
    return joined.select("id", F.coalesce(was & ~is_, F.lit(False)).alias("lost"), F.coalesce(F.col("was").isNotNull() & ~was & is_, F.lit(False)).alias("gained"))
