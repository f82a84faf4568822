"""Training mixtures: plan, budgeted load, anti-join, report, freezing.

Document order is semantic, so every document has its ``file`` and ``pos``.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import written
from . import leaks
from .packing import with_offsets

TAKES = ("all", "unpaired", "fill")


def take_of(phrase: Column) -> Column:
    """How a recipe's phrase takes from a file; an unknown phrase raises."""
    return (
        F.when(phrase.startswith("sans la part appariee"), "unpaired")
        .when(phrase.startswith("cote") | (phrase == "tout"), "all")
        .when(phrase == "completer", "fill")
        .otherwise(F.raise_error(F.concat(F.lit("unknown take: "), F.coalesce(phrase, F.lit("null")))))
    )


def plan(recipe: DataFrame) -> DataFrame:
    """``path, take, budget, pos`` of a recipe's sources (``pos, fichier, prendre, tokens``): one row for each path.

    The same path taken in two ways raises.
    """
    rows = recipe.select(F.col("fichier").alias("path"), take_of(F.col("prendre")).alias("take"), "tokens", "pos")
    rows = rows.withColumn("budget", F.when(F.col("take") == "fill", F.col("tokens")))
    one = rows.groupBy("path").agg(F.min("pos").alias("pos"), F.min("take").alias("take"), F.max("take").alias("last"), F.min("budget").alias("budget"), F.max("budget").alias("most"), F.count("budget").alias("budgets"), F.count("*").alias("n"))
    twice = (F.col("take") != F.col("last")) | (F.col("budget") != F.col("most")) | ((F.col("budgets") != 0) & (F.col("budgets") != F.col("n")))
    checked = F.when(twice, F.raise_error(F.concat(F.lit("taken in two ways: "), F.col("path")))).otherwise(F.col("take"))
    return one.select("path", checked.alias("take"), "budget", "pos")


def recipe_sources(recipe: DataFrame) -> DataFrame:
    """``part, pos, fichier, prendre, tokens`` from a recipe document's ``parts`` map."""
    parts = recipe.select(F.explode("parts").alias("part", "of"))
    return parts.select("part", F.posexplode("of.sources").alias("pos", "s")).select("part", "pos", "s.fichier", "s.prendre", "s.tokens")


def witness(docs: DataFrame, exclude: list[str]) -> DataFrame:
    """Rows whose register is not excluded; those without one stay."""
    return docs.filter(F.col("registre").isNull() | ~F.col("registre").isin(exclude)) if exclude else docs


def witness_keys(docs: DataFrame, exclude: list[str] = ()) -> DataFrame:
    return witness(docs, list(exclude)).select(T.key(F.col("text")).alias("key")).distinct()


def paired_keys(bilingual: DataFrame) -> DataFrame:
    """Keys of the texts before the first blank line."""
    return bilingual.select(T.key(T.source_side(F.col("text"))).alias("key")).distinct()


def loaded(docs: DataFrame, sources: DataFrame, paired: DataFrame | None, routed: DataFrame | None) -> DataFrame:
    """Each row of the plan's files with what became of it.

    ``docs``: ``file, pos, part, text, tokens``; ``sources``: a plan; ``paired``: keys of the paired part; ``routed``:
    keys by part of :func:`corpusloom.operators.leaks.routes`.  Adds ``dropped`` (paired), ``leak`` and ``kept``.  In
    order: paired rows go; a file with a budget takes rows while the tokens of the accepted ones before are less;
    leaks are skipped and cost nothing.

    Texts are looked at once: the numbers of the rows that leak or are paired are written, and joined to the rows.
    """
    rows = docs.join(sources.select(F.col("path").alias("file"), "take", "budget"), "file").withColumn("row_id", F.struct("file", "pos"))
    keyed = rows.select("row_id", "part", "take", T.key(F.col("text")).alias("_key"))
    gone = F.lit(False)
    if paired is not None:
        own = keyed.filter("take = 'unpaired'").join(paired.select(F.col("key").alias("_key")), "_key", "left_semi")
        rows = rows.join(written(own.select("row_id", F.lit(True).alias("_gone")), "paired"), "row_id", "left")
        gone = F.coalesce("_gone", F.lit(False))
    rows = rows.withColumn("dropped", gone).drop("_gone")
    if routed is None:
        rows = rows.withColumn("leak", F.lit(None).cast("string"))
    else:
        rows = rows.join(written(leaks.leaking(keyed.drop("take"), routed), "leaks"), "row_id", "left")
    cost = F.when(F.col("leak").isNull() & ~F.col("dropped"), F.col("tokens")).otherwise(F.lit(0))
    ends = _ends(rows.filter("budget IS NOT NULL").select("file", "pos", "budget", cost.alias("_cost")))
    rows = rows.join(F.broadcast(ends), "file", "left")  # a row for each file of the recipe
    reached = ~F.col("dropped") & (F.col("_end").isNull() | (F.col("pos") < F.col("_end")))
    return rows.withColumn("reached", reached).withColumn("kept", F.col("reached") & F.col("leak").isNull()).drop("row_id", "_end")


def _ends(costs: DataFrame) -> DataFrame:
    """``file, _end`` of ``file, pos, budget, _cost``: the first place of each file before which its budget is used up.

    A file of any size is summed by many tasks: rows are ranged over them, summed in each, and what the tasks before
    have of the file is added.
    """
    # written, as two readers of a range partitioning might see it drawn twice
    ranged = written(costs.repartitionByRange("file", "pos").withColumn("_task", F.spark_partition_id()), "costs")
    before = Window.partitionBy("file").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("file", "_task").agg(F.sum("_cost").alias("_sum"))
    base = totals.select("file", "_task", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    own = F.coalesce(F.sum("_cost").over(Window.partitionBy("_task", "file").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row for each task and file in it
    spent = ranged.withColumn("_own", own).join(F.broadcast(base), ["file", "_task"]).filter(F.col("_own") + F.col("_base") >= F.col("budget"))
    return spent.groupBy("file").agg(F.min("pos").alias("_end"))


def report(rows: DataFrame) -> DataFrame:
    """``file, documents, tokens, dropped_paired, leaks, budget`` of :func:`loaded` rows."""
    return rows.groupBy("file").agg(
        F.count_if("kept").alias("documents"),
        F.coalesce(F.sum(F.when(F.col("kept"), F.col("tokens"))), F.lit(0)).alias("tokens"),
        F.count_if("dropped").alias("dropped_paired"),
        F.count_if(F.col("reached") & F.col("leak").isNotNull()).alias("leaks"),
        F.first("budget").alias("budget"),
    )


def shares(kept: DataFrame, label: Column) -> DataFrame:
    """``label, tokens, ratio``: tokens of each share and its percentage, largest first; no tokens at all raises."""
    by = kept.groupBy(label.alias("label")).agg(F.sum("tokens").alias("tokens"))
    total = F.sum("tokens").over(Window.partitionBy())
    ratio = F.when(total == 0, F.raise_error(F.lit("a mixture without tokens has no shares"))).otherwise(F.round(100 * F.col("tokens") / total, 2))
    return by.withColumn("ratio", ratio).orderBy(F.desc("tokens"), "label")


def label_of(file: Column, labels: dict[str, str]) -> Column:
    """A file's share, ``?`` if it has none."""
    if not labels:
        return F.lit("?")
    return F.coalesce(F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))[file], F.lit("?"))


def sequence_count(tokens: Column, documents: Column, window: int = 1024) -> Column:
    """Whole windows of all tokens and one separator for each document."""
    return F.floor((tokens + documents) / F.lit(window)).cast("long")


def fingerprint(rows: DataFrame, order: list[str]) -> str:
    """First 12 hex digits of the sha256 of all texts in order, a NUL after each: streamed, partition by partition."""
    digest = hashlib.sha256()
    for row in rows.select(*order, "text").orderBy(*order).toLocalIterator(prefetchPartitions=True):
        digest.update(row["text"].encode() + b"\x00")
    return digest.hexdigest()[:12]


def block_fingerprint(rows: DataFrame, order: list[str], block: int = 1 << 16) -> str:
    """First 12 hex digits of a digest of all texts in order that no single task computes.

    Texts are hashed where they are; the digests of ``block`` texts, and of so many blocks, are hashed together, so that
    a row for each four billion texts reaches the driver.
    """
    digests = with_offsets(rows.select(*order, F.sha2("text", 256).alias("digest"), F.lit(1).alias("_one")), order, "_one", "place").select("place", "digest")
    for _ in range(2):
        own = digests.groupBy(F.floor(F.col("place") / block).alias("of")).agg(F.array_sort(F.collect_list(F.struct("place", "digest"))).alias("d"))
        digests = own.select(F.col("of").alias("place"), F.sha2(F.array_join("d.digest", ""), 256).alias("digest"))
    last = "".join(r["digest"] for r in digests.orderBy("place").collect())
    return hashlib.sha256(last.encode()).hexdigest()[:12]


def freeze(rows: DataFrame, arm: str, out: str, order: list[str], labels: dict[str, str], licences: dict[str, str], recipe: dict, note: str = "", date: str | None = None, name=fingerprint) -> dict:
    """Writes the kept rows as zstd Parquet (``text, part, source``) under a folder named by their content, then card and pointer.

    Any leak refuses.  ``name`` gives the content's mark: the one that streams all texts in order, so that marks can be
    compared with earlier ones, or :func:`block_fingerprint`, which scales.  Returns the card.
    """
    from ..sources import files

    spark = rows.sparkSession
    counts = report(rows).orderBy("file").collect()  # a row for each file of the recipe
    if leaked := sum(r["leaks"] for r in counts):
        raise ValueError(f"{leaked} held-out texts in the mixture: nothing is frozen")
    kept = rows.filter("kept")
    mark = name(kept, order)
    uri = f"{out.rstrip('/')}/{arm}-{mark}"
    labelled = kept.withColumn("source", F.col("file")).withColumn("part", label_of(F.col("file"), labels))
    labelled.orderBy(*order).select("text", "part", "source").write.option("compression", "zstd").mode("overwrite").parquet(f"{uri}/data")
    by_share = {r["label"]: (r["tokens"], r["ratio"]) for r in shares(labelled, F.col("part")).collect()}
    documents, tokens = sum(r["documents"] for r in counts), sum(r["tokens"] for r in counts)
    date = date or str(spark.sql("SELECT current_date()").first()[0])
    card = {
        "bras": arm, "empreinte": mark, "fige_le": date, "documents": documents, "tokens": tokens,
        "tokens_par_part": {k: v[0] for k, v in by_share.items()}, "ratio_obtenu": {k: v[1] for k, v in by_share.items()},
        "sequences_1024": (tokens + documents) // 1024, "fuites_tenu_a_lecart": leaked, "capacites_controlees": sorted({c for cs in leaks.TARGETS.values() for c in cs}),
        "par_fichier": {r["file"]: {"documents": r["documents"], "tokens": r["tokens"], "dropped_paired": r["dropped_paired"], "leaks": r["leaks"], "budget": r["budget"]} for r in counts},
        "recette": recipe, "licences": {p: licences.get(p, "?") for p in by_share}, "note": note,
    }
    files.write_text(spark, f"{uri}/carte.json", json.dumps(card, ensure_ascii=False, indent=1))
    # the pointer comes after the data, so that it never names what is not there
    files.write_text(spark, f"{out.rstrip('/')}/{arm}.json", json.dumps({"bras": arm, "empreinte": mark, "uri": uri, "fige_le": date}, ensure_ascii=False))
    return card


def frozen(spark: SparkSession, arm: str, out: str) -> tuple[DataFrame, dict] | None:
    """(texts, card) of a frozen arm, None if there is none; the scan reads ``text`` alone."""
    card = frozen_card(spark, arm, out)
    return None if card is None else (spark.read.parquet(f"{card['uri']}/data").select("text"), card)


def frozen_card(spark: SparkSession, arm: str, out: str) -> dict | None:
    """The card without a scan of the data."""
    from ..sources import files

    pointer = files.read_text(spark, f"{out.rstrip('/')}/{arm}.json")
    if pointer is None:
        return None
    uri = json.loads(pointer)["uri"]
    card = files.read_text(spark, f"{uri}/carte.json")
    return None if card is None else json.loads(card) | {"uri": uri}


def verified(loaded_tokens: Column, declared: Column, leaked: Column, documents: Column) -> Column:
    """Whether a mixture is ready: drift under one percent, no leaks, not empty."""
    return (F.abs(loaded_tokens - declared) / declared < 0.01) & (leaked == 0) & (documents > 0)


def training_cost(sequences: Column, window: int = 1024, epochs: int = 5, batch: int = 32, throughput: float = 3901.0, dollars: float = 1.89) -> Column:
    """Steps of an epoch rounded down and up, hours and dollars."""
    hours = sequences * window * epochs / F.lit(throughput) / 3600
    return F.struct(F.floor(sequences / batch).alias("steps_floor"), F.ceil(sequences / batch).alias("steps_ceil"), hours.alias("hours"), (hours * dollars).alias("dollars"))
