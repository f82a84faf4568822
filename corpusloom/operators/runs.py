"""Runs and their checkpoints: listings, retention, selection, resuming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Files that only resuming needs.
RESUME_STATE = ("optimizer.pt", "scheduler.pt", "rng_state.pth", "trainer_state.json")
REQUIRED_TO_RESUME = "trainer_state.json"


def split_uri(uri: Column) -> Column:
    """``bucket, prefix`` of an object's address."""
    return F.struct(F.regexp_extract(uri, r"^s3a?://([^/]+)/?(.*)$", 1).alias("bucket"), F.regexp_extract(uri, r"^s3a?://([^/]+)/?(.*)$", 2).alias("prefix"))


def run_names(listing: DataFrame, prefix: str = "") -> DataFrame:
    """``run``: distinct first parts of the keys that start with ``prefix``, in order of name."""
    run = F.split_part("key", F.lit("/"), F.lit(1))
    return listing.filter(F.contains("key", F.lit("/"))).select(run.alias("run")).filter(F.col("run").startswith(prefix)).distinct().orderBy("run")


def checkpoints(listing: DataFrame) -> DataFrame:
    """``run, name, step`` of the checkpoints that a listing's keys lie in; a name must be digits after its hyphen; by number."""
    parts = listing.select(F.split_part("key", F.lit("/"), F.lit(1)).alias("run"), F.split_part("key", F.lit("/"), F.lit(2)).alias("name"))
    step = F.regexp_extract("name", r"^checkpoint-(\d+)$", 1)
    return parts.filter(step != "").withColumn("step", step.cast("long")).distinct().orderBy("run", "step")


def latest(points: DataFrame) -> DataFrame:
    return points.groupBy("run").agg(F.max_by("name", "step").alias("name"), F.max("step").alias("step"))


def by_eval(log: DataFrame, kept: DataFrame) -> DataFrame:
    """Of each run the kept checkpoint with the lowest evaluation loss, the earliest of equals: ``run, name, step, eval_loss``."""
    rows = log.filter("eval_loss IS NOT NULL").select("run", F.col("pas").cast("long").alias("step"), "eval_loss").join(kept.select("run", "step").distinct(), ["run", "step"], "left_semi")
    best = rows.groupBy("run").agg(F.min(F.struct("eval_loss", "step")).alias("b"))
    return best.select("run", F.concat(F.lit("checkpoint-"), "b.step").alias("name"), "b.step", "b.eval_loss")


def epoch_saves(saves: DataFrame, steps_per_epoch: int) -> DataFrame:
    """``saves`` (``run, step``) with ``opens``: the first save of each epoch; none without steps per epoch."""
    if not steps_per_epoch:
        return saves.withColumn("opens", F.lit(False))
    first = F.row_number().over(Window.partitionBy("run", F.floor(F.col("step") / steps_per_epoch)).orderBy("step"))
    return saves.withColumn("opens", first == 1)


def retention(saves: DataFrame, steps_per_epoch: int, keep_all: bool = True) -> DataFrame:
    """What becomes of each save once the next arrives: ``prune`` its resume state, ``delete`` it, or nothing for the last."""
    rows = epoch_saves(saves, steps_per_epoch)
    following = F.lead("step").over(Window.partitionBy("run").orderBy("step"))
    action = F.when(following.isNull(), None).when(F.col("opens") | F.lit(keep_all), "prune").otherwise("delete")
    return rows.withColumn("action", action)


def deletions(listing: DataFrame, actions: DataFrame) -> DataFrame:
    """Keys that the actions remove: all of a deleted checkpoint, the resume state of a pruned one."""
    of = listing.withColumn("run", F.split_part("key", F.lit("/"), F.lit(1))).withColumn("step", F.regexp_extract("key", r"^[^/]*/checkpoint-(\d+)/", 1).try_cast("long"))
    rows = of.join(actions.filter("action IS NOT NULL").select("run", "step", "action"), ["run", "step"])
    return rows.filter((F.col("action") == "delete") | F.substring_index("key", "/", -1).isin(*RESUME_STATE)).select("key", "action")


def resume_refused(done: Column, before: Column, total: Column) -> Column:
    """Why a checkpoint cannot go on under this ceiling, or null."""
    return F.when(F.coalesce(done, F.lit(0)) >= total, "there is nothing left to train").when(before.isNotNull() & (before != total), "the set or the epoch count has changed since")


def resolved(listing: DataFrame, prefix: str, local: DataFrame | None = None) -> DataFrame:
    """``run, name, step, place`` to resume from: the newest local run with a checkpoint, else the newest stored one with its state; no row: a fresh run.

    Both listings have ``key``; a run's name ends with its time, so the last by name is the newest.
    """

    def newest(found: DataFrame, place: str) -> DataFrame:
        return latest(checkpoints(found)).filter(F.col("run").startswith(prefix)).withColumn("place", F.lit(place))

    stored = newest(listing, "stored")
    state = listing.filter(F.col("key").endswith("/" + REQUIRED_TO_RESUME)).select(F.split_part("key", F.lit("/"), F.lit(1)).alias("run"), F.split_part("key", F.lit("/"), F.lit(2)).alias("name"))
    every = stored.join(state.distinct(), ["run", "name"], "left_semi").select("run", "name", "step", "place")
    if local is not None:
        every = every.unionByName(newest(local, "local").select("run", "name", "step", "place"))
    return every.orderBy("place", F.desc("run")).limit(1)


def resume_named(listing: DataFrame, name: str) -> DataFrame:
    """``run, name, step`` of a run named by hand, ``run`` or ``run/checkpoint-N``; without its state it cannot be resumed, which raises."""
    run, _, point = name.strip("/").partition("/")
    own = checkpoints(listing).filter(F.col("run") == run)
    chosen = own.filter(F.col("name") == point) if point else latest(own)
    state = listing.filter(F.col("key").endswith("/" + REQUIRED_TO_RESUME)).select(F.split_part("key", F.lit("/"), F.lit(1)).alias("run"), F.split_part("key", F.lit("/"), F.lit(2)).alias("name"))
    found = chosen.join(state.distinct(), ["run", "name"], "left_semi").select("run", "name", "step")
    if found.isEmpty():
        raise ValueError(f"{name} has no checkpoint with {REQUIRED_TO_RESUME}")
    return found


def start_missing(listing: DataFrame, start: str) -> str | None:
    """Why a start (``base``, an arm, or ``arm@checkpoint-N``) cannot be resolved, or None."""
    if start == "base":
        return None
    arm, _, wanted = start.partition("@")
    run = run_names(listing, f"{arm}-").agg(F.max("run")).first()[0]
    if run is None:
        return f"no run for arm {arm}"
    own = checkpoints(listing).filter(F.col("run") == run)
    if own.isEmpty():
        return f"no checkpoint in {run}"
    if wanted and own.filter(F.col("name") == wanted).isEmpty():
        last = [r["name"] for r in own.orderBy(F.desc("step")).limit(3).collect()][::-1]
        return f"{run} has no {wanted}; it has {', '.join(last)}"
    return None


def run_time(name: Column) -> Column:
    """The time in a run's name."""
    return F.try_to_timestamp(F.regexp_extract(name, r"(\d{8}-\d{4})$", 1), F.lit("yyyyMMdd-HHmm"))


def run_name(arm: Column, time: Column) -> Column:
    """The name of a run that begins at a time."""
    return F.concat_ws("-", arm, F.date_format(time, "yyyyMMdd-HHmm"))
