"""Packing in document order: ids, a separator before each next document, cut every window, the short tail dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def with_offsets(rows: DataFrame, order: list[str | Column], size: str, name: str = "offset") -> DataFrame:
    """``rows`` with the sum of ``size`` over all rows before, in order of ``order`` (unique).

    In two levels, without one task for all: rows are ranged over tasks, summed in each, and the few sums of the tasks
    before are added.
    """
    # written once, as two readers of a range partitioning might see it drawn twice
    ranged = written(rows.repartitionByRange(*order).withColumn("_task", F.spark_partition_id()), "ranged")
    own = F.coalesce(F.sum(size).over(Window.partitionBy("_task").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = ranged.groupBy("_task").agg(F.sum(size).alias("_sum"))
    before = totals.withColumn("_base", F.coalesce(F.sum("_sum").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_task", "_base")
    # one row for each task
    return ranged.withColumn("_own", own).join(F.broadcast(before), "_task").withColumn(name, (F.col("_own") + F.col("_base")).cast("long")).drop("_task", "_own", "_base")


def packed(docs: DataFrame, ids: Column, order: list[str], separator: int, window: int) -> DataFrame:
    """``sequence, ids``: every document's ids, a separator between documents, in windows; a short last window is dropped.

    A document is cut into its pieces before anything is shuffled by window, so what moves is the ids themselves.
    """
    rows = docs.select(*order, ids.alias("_ids")).withColumn("_n", F.size("_ids") + 1)
    placed = with_offsets(rows, order, "_n", "_at")
    # the separator stands before a document, but not before the first
    led = placed.withColumn("_ids", F.when(F.col("_at") == 0, F.col("_ids")).otherwise(F.concat(F.array(F.lit(separator)), "_ids"))).withColumn("_at", F.when(F.col("_at") == 0, F.lit(0)).otherwise(F.col("_at") - 1))
    w = F.lit(window)
    first, last = F.floor(F.col("_at") / w), F.floor((F.col("_at") + F.size("_ids") - 1) / w)
    pieces = led.filter(F.size("_ids") > 0).withColumn("sequence", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.lit(0).cast("long"), F.col("sequence") * w - F.col("_at"))
    end = F.least(F.size("_ids").cast("long"), (F.col("sequence") + 1) * w - F.col("_at"))
    pieces = pieces.select("sequence", (F.col("_at") + begin).alias("_at"), F.slice("_ids", (begin + 1).cast("int"), (end - begin).cast("int")).alias("_ids"))
    whole = pieces.groupBy("sequence").agg(F.array_sort(F.collect_list(F.struct("_at", "_ids"))).alias("_p"))  # at most a window of ids
    return whole.select("sequence", F.flatten(F.transform("_p", lambda p: p["_ids"])).alias("ids")).filter(F.size("ids") == window)


def cached(docs: DataFrame, ids: Column, order: list[str], separator: int, window: int, out: str, fingerprint: str) -> DataFrame:
    """The packed table, read if this mixture was packed at this window before."""
    from ..sources import files

    spark = docs.sparkSession
    path = f"{out.rstrip('/')}/packed-{fingerprint}-{window}"
    if not files.exists(spark, f"{path}/_SUCCESS"):
        packed(docs, ids, order, separator, window).write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)
