"""Training curves: order of points, stop signals, the cut, the point to keep, ranking of arms.

``points``: ``arm, point, step`` and the measurements as columns; the base is a row of its
own arm ``base``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import facts as facts_op

# Capabilities that should fall, hold and are watched, and how much of its base value a held one may lose.
SHOULD_DROP = ("moore_humain", "francais_parallele")
SHOULD_HOLD = ("anglais", "francais", "code", "maths")
WATCH_APART = ("moore_whisper",)
HOLD_TOLERANCE = 0.03
NOT_COMPARABLE = "facts not comparable: another budget, or another set of items"
# The steps of five epochs of each arm.
FINAL_STEP = {"A": 6005, "B": 2755, "C": 6025, "P2": 6120}
EPOCHS = 5
ARM_POINT = r"^(?:A|B|C|P|P2)-\d+-checkpoint-\d+$"


def run_label(start: Column) -> Column:
    """``C@checkpoint-4820`` is ``C-4820``; without ``@`` nothing changes."""
    arm, point = F.substring_index(start, "@", 1), F.substr(start, F.length(F.substring_index(start, "@", 1)) + 2)
    return F.when(point == "", arm).otherwise(F.concat(arm, F.lit("-"), F.substring_index(point, "-", -1)))


def arm_of(point: Column, path: Column) -> Column:
    """The arm that a point's path names: the last part with a hyphen that is no checkpoint, up to its first hyphen."""
    parts = F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda p: F.contains(p, F.lit("-")) & ~p.startswith("checkpoint"))
    return F.when(point == "base", "base").otherwise(F.coalesce(F.split_part(F.try_element_at(parts, F.lit(-1)), F.lit("-"), F.lit(1)), F.lit("?")))


def order_key(name: Column) -> Column:
    """``(kind, step)``: the base first, then by the digits after the last ``checkpoint-``, or all digits of a name without it."""
    tail = F.when(F.contains(name, F.lit("checkpoint-")), F.substring_index(name, "checkpoint-", -1)).otherwise(name)
    digits = F.regexp_replace(tail, r"[^0-9]", "")
    step = F.when((name == "base") | (digits == ""), F.lit(0)).otherwise(digits.cast("long"))
    return F.struct(F.when(name == "base", 0).otherwise(1).alias("kind"), step.cast("long").alias("step"))


def is_arm_point(name: Column) -> Column:
    return name.rlike(ARM_POINT)


def path_parts(path: Column, arms: list[str]) -> Column:
    """``arm, step`` of a run's path, null for others."""
    pattern = r"/cpt/([A-Z0-9]+)-\d{8}-\d{4}/checkpoint-(\d+)$"
    arm = F.regexp_extract(path, pattern, 1)
    return F.when(arm.isin(arms), F.struct(arm.alias("arm"), F.regexp_extract(path, pattern, 2).cast("long").alias("step")))


def epoch_of(arm: Column, step: Column, final: dict[str, int] = FINAL_STEP, epochs: int = EPOCHS) -> Column:
    return F.lit(epochs) * step / F.create_map(*(F.lit(x) for kv in final.items() for x in kv))[arm]


def display_name(arm: Column, point: Column) -> Column:
    return F.when(arm == "base", point).otherwise(F.concat_ws("/", arm, point))


def curve_table(points: DataFrame, value: str) -> DataFrame:
    """``arm, epoch, value`` with the base at epoch 0 of every arm, in order."""
    arms = points.filter("arm <> 'base'").select("arm").distinct()
    base = points.filter("arm = 'base'").select(F.lit(0.0).alias("epoch"), F.col(value).alias("value")).limit(1)
    start = arms.join(F.broadcast(base), how="cross")  # one row on one side
    own = points.filter("arm <> 'base'").select("arm", "epoch", F.col(value).alias("value"))
    return start.select("arm", "epoch", "value").unionByName(own).orderBy("arm", "epoch", "value")


def evaluations(log: DataFrame, final_step: int | None = None) -> DataFrame:
    """``pas, epoque, eval_loss`` of a log's evaluations in order, the one after the final step left out."""
    rows = log.filter("eval_loss IS NOT NULL")
    return (rows if final_step is None else rows.filter(F.col("pas") != final_step)).select("pas", "epoque", "eval_loss").orderBy("pas")


def with_previous(points: DataFrame, base: DataFrame, columns: list[str]) -> DataFrame:
    """Each point's predecessor on its arm as ``previous_*``, and the base as ``base_*``; the first point's predecessor is the base."""
    order = Window.partitionBy("arm").orderBy("step", "point")
    one = base.select(*(F.col(c).alias(f"base_{c}") for c in columns)).limit(1)
    rows = points.filter("arm <> 'base'").join(F.broadcast(one), how="cross")  # one row on one side
    return rows.withColumn("n", F.row_number().over(order)).withColumns({f"previous_{c}": F.when(F.col("n") == 1, F.col(f"base_{c}")).otherwise(F.lag(c).over(order)) for c in columns}).drop("n")


def hold_marks(capabilities: tuple[str, ...] = SHOULD_HOLD, tolerance: float = HOLD_TOLERANCE) -> Column:
    """Marks of the held capabilities that lost more of their base value than allowed."""

    def mark(c: str) -> Column:
        lost = (F.col(c) - F.col(f"base_{c}")) / F.col(f"base_{c}")
        return F.when(lost > tolerance, F.format_string(f"{c} +%.1f %% (over %.0f %%)", 100 * lost, F.lit(100 * tolerance)))

    return F.array_compact(F.array(*map(mark, capabilities)))


def same_items(budget: Column, ids: Column, other_budget: Column, other_ids: Column) -> Column:
    """Whether two tallies share budget and items."""
    return budget.eqNullSafe(other_budget) & (F.array_sort(F.array_distinct(ids)) == F.array_sort(F.array_distinct(other_ids)))


def marks(value: str = "moore_humain") -> Column:
    """Stop signals of a row of :func:`with_previous` with ``rise_low, rise_high, rise`` (null: no interval), ``comparable``, ``lost_ids``."""
    unknown = F.when(F.col(value) >= F.col(f"previous_{value}"), F.format_string("overfitting? (bpc %.4f -> %.4f, no interval: re-measure)", F.col(f"previous_{value}"), F.col(value)))
    known = F.when(F.col("rise_low") > 0, F.format_string("overfitting (bpc %+.4f [%+.4f, %+.4f])", "rise", "rise_low", "rise_high"))
    rise = F.when(F.col("rise_low").isNull(), unknown).otherwise(known)
    items = F.when(~F.col("comparable"), NOT_COMPARABLE).when(F.size("lost_ids") > 0, F.concat(F.lit("facts learned otherwise: "), F.array_join("lost_ids", ", ")))
    return F.concat(F.array_compact(F.array(rise, items)), hold_marks())


def lost_facts(base_answers: DataFrame, answers: DataFrame, verdict: str = facts_op.TRAPPED) -> DataFrame:
    """``arm, point, lost_ids``: facts that the base has right and a point answers with ``verdict``, sorted."""
    known = base_answers.filter(F.col("note") == facts_op.RIGHT).select("id").distinct()
    lost = answers.filter(F.col("note") == verdict).join(known, "id", "left_semi")
    return lost.groupBy("arm", "point").agg(F.array_sort(F.collect_set("id")).alias("lost_ids"))


def forgotten(base_answers: DataFrame, answers: DataFrame) -> DataFrame:
    """Known facts that a point does not answer any more: reported, no signal."""
    return lost_facts(base_answers, answers, facts_op.UNKNOWN)


def unclear(base_answers: DataFrame, answers: DataFrame) -> DataFrame:
    return lost_facts(base_answers, answers, facts_op.UNCLEAR)


def cut_and_best(points: DataFrame, value: str = "moore_humain", signal: str = "signal", collapsed: str = "collapsed") -> DataFrame:
    """``points`` with ``cut`` (the arm's first step with a signal), ``eligible``, ``skipped`` and ``kept``.

    The kept point has the lowest value before the cut among those that have not collapsed; a tie goes to the earliest.
    """
    arm = Window.partitionBy("arm")
    cut = points.withColumn("cut", F.min(F.when(F.col(signal), F.col("step"))).over(arm))
    before = F.col("cut").isNull() | (F.col("step") < F.col("cut"))
    rows = cut.withColumn("skipped", before & F.col(collapsed).isNotNull()).withColumn("eligible", before & F.col(collapsed).isNull())
    best = F.row_number().over(Window.partitionBy("arm", "eligible").orderBy(value, "step", "point"))
    return rows.withColumn("kept", F.col("eligible") & (best == 1))


def shown(points: DataFrame) -> DataFrame:
    """Of each arm the kept point, or its last where none can be kept: ``arm, point, step, kept``."""
    order = Window.partitionBy("arm").orderBy(F.desc("kept"), F.desc("step"))
    return points.withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")


def coverage(points: DataFrame) -> DataFrame:
    """``arm, points, first_step, last_step, is_curve``: under three points there is no curve."""
    return points.filter("arm <> 'base'").groupBy("arm").agg(F.count("*").alias("points"), F.min("step").alias("first_step"), F.max("step").alias("last_step"), (F.count("*") >= 3).alias("is_curve"))


def bpc_matrix(long: DataFrame, names: list[str]) -> DataFrame:
    """Capability by point: ``long`` is ``capability, name, value``."""
    return long.groupBy("capability").pivot("name", names).agg(F.first("value")).orderBy("capability")


def ranked(kept: DataFrame, against: str, value: str = "moore_humain", pairs: DataFrame | None = None) -> DataFrame:
    """Arms, the reference first, with their kept point's difference to the reference's, and the verdict of its interval.

    ``pairs``: ``arm, low, high`` of the paired differences; arms without one are not separated.
    """
    reference = kept.filter(F.col("arm") == against).select(F.col(value).alias("reference")).limit(1)
    if reference.isEmpty():
        raise ValueError(f"no arm {against} to compare with")
    rows = kept.join(F.broadcast(reference), how="cross")  # one row on one side
    rows = rows.join(pairs, "arm", "left") if pairs is not None else rows.withColumns({"low": F.lit(None).cast("double"), "high": F.lit(None).cast("double")})
    verdict = F.when(F.col("arm") == against, "reference").when(F.col("high") < 0, "better").when(F.col("low") > 0, "worse").otherwise("not separated")
    star = F.coalesce((F.col("low") > 0) | (F.col("high") < 0), F.lit(False))
    return rows.withColumn("difference", F.col(value) - F.col("reference")).withColumn("star", star).withColumn("verdict", verdict).orderBy(F.when(F.col("arm") == against, 0).otherwise(1), "arm")


def transfer(per_text: DataFrame, reference: str = "P2") -> DataFrame:
    """Each arm minus the reference, paired over texts: ``capability, stage, arm, value, low, high`` of ``capability, stage, arm, pos, nll, chars``."""
    from .statistics import differences

    other = per_text.filter(F.col("arm") != reference)
    base = per_text.filter(F.col("arm") == reference).drop("arm").join(other.select("capability", "stage", "arm").distinct(), ["capability", "stage"])
    return differences(base, other, ["capability", "stage", "arm"])
