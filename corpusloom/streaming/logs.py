"""Training logs as streams: progress rows appended, and the retention of checkpoints as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import LOG


def read_log(spark: SparkSession, directory: str, schema: str = LOG, per_trigger: int | None = None) -> DataFrame:
    """Rows of the log files of a folder as they arrive, with ``run`` from the file's name."""
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.json(directory).withColumn("run", F.regexp_replace(F.col("_metadata.file_name"), r"\.[^/]*$", ""))


def append_log(stream: DataFrame, target: str, checkpoint: str):
    """Appends each batch as Parquet exactly once; ends when all that is there has been read."""
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def progress_row(df: DataFrame) -> DataFrame:
    """Rows with ``pas`` and ``epoque`` to three digits."""
    return df.withColumn("pas", F.col("pas").cast("int")).withColumn("epoque", F.round(F.coalesce("epoque", "epoch"), 3))


def best_so_far(stream: DataFrame) -> DataFrame:
    """Of each run the lowest evaluation loss so far and its step: state is one row for each run."""
    rows = stream.filter("eval_loss IS NOT NULL").select("run", F.struct("eval_loss", F.col("pas").cast("long").alias("step")).alias("x"))
    best = rows.groupBy("run").agg(F.min("x").alias("x"))
    return best.select("run", "x.step", "x.eval_loss")


def retention(stream: DataFrame, steps_per_epoch: int, keep_all: bool = True) -> DataFrame:
    """Saves (``run, step``) as they arrive: ``run, step, opens, previous, action``, as the batch plan has them.

    State of a run: the save before, whether that one opened an epoch, and the highest epoch so far.  ``action`` says what
    becomes of the save before: ``prune`` or ``delete``.  Saves of one trigger are taken by step, so a run's saves may
    come in any order within it.  One that comes after a later one was handled, or again, changes nothing: its
    ``action`` is ``late`` and its ``previous`` null, so that nothing is removed on its account.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        previous, kept, top = state.get if state.exists else (None, False, -1)
        rows = []
        for step in sorted(int(s) for pdf in batches for s in pdf["step"].tolist()):
            if previous is not None and step <= previous:
                rows.append((key[0], step, False, None, "late"))
                continue
            epoch = step // steps_per_epoch if steps_per_epoch else -1
            opens = bool(steps_per_epoch) and epoch > top
            top = epoch if opens else top
            rows.append((key[0], step, opens, previous, None if previous is None else "prune" if kept else "delete"))
            previous, kept = step, opens or keep_all
        state.update((previous, kept, int(top)))
        yield pd.DataFrame(rows, columns=["run", "step", "opens", "previous", "action"]).astype({"previous": "Int64"})

    return stream.select("run", "step").filter("step IS NOT NULL").groupBy("run").applyInPandasWithState(run, "run string, step long, opens boolean, previous long, action string", "previous long, kept boolean, top long", "append", "NoTimeout")
