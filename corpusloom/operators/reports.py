"""Reports over point files: which point of each arm to keep, and how the arms compare.

``points`` are rows of :func:`corpusloom.sources.tables.points`; ``answers`` are rows of
:func:`corpusloom.operators.collapse.counted_answers`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import tables
from . import collapse, curves, facts, statistics

CAPABILITIES = (*curves.SHOULD_DROP, *curves.SHOULD_HOLD, *curves.WATCH_APART)


def wide(points: DataFrame) -> DataFrame:
    """``arm, stem, point, step``, a column for each capability, ``budget, ids, right, trapped``."""
    order = curves.order_key(F.col("point"))
    bpc = [F.col("mesures")[c]["bits_par_caractere"].alias(c) for c in CAPABILITIES]
    ids = F.coalesce(F.transform("faits", lambda f: f["id"]), F.array().cast("array<string>"))
    of = lambda verdict: F.coalesce(F.transform(F.filter("faits", lambda f: f["note"] == verdict), lambda f: f["id"]), F.array().cast("array<string>"))
    return points.select(
        curves.arm_of(F.col("point"), F.col("chemin")).alias("arm"), "stem", "point", order["step"].alias("step"), *bpc,
        facts.budget_of(F.col("budget_faits"), F.col("faits")).alias("budget"), ids.alias("ids"), of(facts.RIGHT).alias("right"), of(facts.TRAPPED).alias("trapped"),
        of(facts.UNKNOWN).alias("unknown"), of(facts.UNCLEAR).alias("unclear"),
    )


def base_of(rows: DataFrame) -> DataFrame:
    """The base, found by its name; none raises."""
    base = rows.filter("point = 'base'").limit(1)
    if base.isEmpty():
        raise ValueError("no base among the points")
    return base


def per_text(points: DataFrame, capability: str) -> DataFrame:
    return tables.per_text(tables.measures(points).filter((F.col("capability") == capability) & F.col("per_text").isNotNull())).select("stem", "pos", "nll", "chars")


def paired(points: DataFrame, pairs: DataFrame, capability: str, **options) -> DataFrame:
    """``stem, value, low, high`` of each pair (``stem, other``): stem minus other; null without per-text values on both sides."""
    texts = per_text(points, capability)
    after = texts.join(pairs.select("stem"), "stem", "left_semi")
    before = texts.withColumnRenamed("stem", "other").join(pairs.select("stem", "other"), "other").drop("other")
    return statistics.differences(before, after, ["stem"], **options)


def keepable(points: DataFrame, answers: DataFrame | None = None, **options) -> DataFrame:
    """Points of the arms with ``marks, signal, collapsed, unchecked, forgotten, cut, eligible, kept``."""
    rows = wide(points)
    base = base_of(rows)
    known = curves.with_previous(rows, base, ["moore_humain", *curves.SHOULD_HOLD, "stem", "budget", "ids", "right"])
    rise = paired(points, known.select("stem", F.col("previous_stem").alias("other")), "moore_humain", **options)
    known = known.join(rise.select("stem", F.col("value").alias("rise"), F.col("low").alias("rise_low"), F.col("high").alias("rise_high")), "stem", "left")
    known = known.withColumn("comparable", curves.same_items(F.col("budget"), F.col("ids"), F.col("base_budget"), F.col("base_ids")))
    known = known.withColumn("lost_ids", F.array_sort(F.array_intersect("base_right", "trapped"))).withColumn("forgotten", F.array_sort(F.array_intersect("base_right", "unknown"))).withColumn("ambiguous", F.array_sort(F.array_intersect("base_right", "unclear")))
    known = known.withColumn("marks", curves.marks()).withColumn("signal", F.size(F.filter("marks", lambda m: m != curves.NOT_COMPARABLE)) > 0)
    if answers is None:
        known = known.withColumn("collapsed", F.lit(None).cast("string")).withColumn("unchecked", F.lit(False))
    else:
        said = collapse.verdicts(answers.select("arm", F.col("step").alias("answer_step"), "obtenu"), ["arm", "answer_step"])
        key = collapse.answer_key(F.col("arm"), F.col("point"))
        known = known.withColumn("answer_step", key["step"]).join(said.select("arm", "answer_step", "collapsed", F.lit(True).alias("said")), ["arm", "answer_step"], "left")
        known = known.withColumn("unchecked", F.col("said").isNull())
    columns = ["arm", "stem", "point", "step", *CAPABILITIES, "comparable", "marks", "signal", "collapsed", "unchecked", "forgotten", "ambiguous"]
    return curves.cut_and_best(known.select(*columns))


def bpc_table(points: DataFrame) -> DataFrame:
    """Capability by point, the base first."""
    rows = wide(points)
    names = [r["name"] for r in rows.select(curves.display_name(F.col("arm"), F.col("point")).alias("name"), curves.order_key(F.col("point")).alias("o"), "arm").orderBy("o", "arm", "name").collect()]
    long = rows.select(curves.display_name(F.col("arm"), F.col("point")).alias("name"), F.expr("stack({}, {}) AS (capability, value)".format(len(CAPABILITIES), ", ".join(f"'{c}', {c}" for c in CAPABILITIES))))
    return curves.bpc_matrix(long.filter("value IS NOT NULL"), names)


def against_base(points: DataFrame, capability: str = "moore_humain", **options) -> DataFrame:
    """``stem, value, low, high, star`` of each point minus the base."""
    rows = wide(points)
    pairs = rows.filter("point <> 'base'").select("stem").join(F.broadcast(base_of(rows).select(F.col("stem").alias("other"))), how="cross")  # one row on one side
    return paired(points, pairs, capability, **options).withColumn("star", (F.col("low") > 0) | (F.col("high") < 0))


def compare(points: DataFrame, answers: DataFrame | None = None, **options) -> tuple[int, DataFrame | None]:
    """(exit code, kept points): 2 without points, 1 if an arm keeps nothing, else 0."""
    if points.isEmpty():
        return 2, None
    rows = keepable(points, answers, **options)
    by_arm = rows.groupBy("arm").agg(F.max("kept").alias("keeps"))
    return int(not by_arm.filter("NOT keeps").isEmpty()), rows.filter("kept")


def arms(points: DataFrame, against: str = "A", answers: DataFrame | None = None, capability: str = "moore_humain", **options) -> DataFrame:
    """The point shown of each arm, ranked against the reference arm's by paired differences."""
    shown = curves.shown(keepable(points, answers, **options))
    if shown.filter(F.col("arm") == against).isEmpty():
        raise ValueError(f"no arm {against} to compare with")
    reference = shown.filter(F.col("arm") == against).select(F.col("stem").alias("other"))
    pairs = shown.filter(F.col("arm") != against).select("arm", "stem").join(F.broadcast(reference), how="cross")  # one row on one side
    gaps = pairs.join(paired(points, pairs, capability, **options), "stem").select("arm", "low", "high")
    return curves.ranked(shown, against, capability, gaps)


def with_facts(points: DataFrame, answers: DataFrame, budget: int) -> DataFrame:
    """Points with the facts of new answers (``point, id, domaine, note, reponse, complet``) put in and counted; points without new answers stay."""
    fact = F.struct("id", "domaine", "note", "reponse", "complet")
    one = answers.groupBy("point").agg(F.array_sort(F.collect_list(fact)).alias("_faits"), F.struct(*(F.count_if(F.col("note") == v).cast("int").alias(v) for v in facts.VERDICTS)).alias("_compte"))
    joined = points.join(one, "point", "left")
    kind = {f.name: f.dataType for f in points.schema.fields}
    new = {"faits": F.coalesce(F.col("_faits").cast(kind["faits"]), "faits"), "faits_compte": F.coalesce(F.col("_compte").cast(kind["faits_compte"]), "faits_compte"), "budget_faits": F.when(F.col("_faits").isNull(), F.col("budget_faits")).otherwise(budget)}
    return joined.withColumns(new).select(*points.columns)
