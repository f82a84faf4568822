"""Readers of the relations, each with its own schema: nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files

MIXTURE_DOC = "text string, tokens long, registre string"
HELD_OUT = "capacite string, text string"
RECIPE = "quoi string, total_tokens long, manque map<string,long>, parts map<string,struct<sources:array<struct<fichier:string,prendre:string,tokens:long>>>>"
FACT = "id string, domaine string, question string, attendu array<string>, piege array<string>"
FACT_ANSWER = "id string, domaine string, note string, reponse string, complet boolean"
MEASURE = "struct<bits_par_caractere:double,intervalle:array<double>,perplexite:double,tokens:long,caracteres:long,par_texte:array<array<double>>>"
POINT = (
    f"point string, chemin string, socle string, fenetre int, decodage string, mesures map<string,{MEASURE}>, "
    "faits array<struct<id:string,domaine:string,note:string,reponse:string,complet:boolean>>, faits_compte struct<juste:int,piege:int,ambigu:int,faux:int>, "
    "budget_faits int, echo_conversation_moore double, sondes array<struct<prompt:string,famille:string,reponse:string>>"
)
HELD_OUT_ANSWER = "depart string, point string, obtenu string, task string, repond_moore boolean, question string"
LOG = (
    "pas int, epoque double, epoch double, loss double, grad_norm double, learning_rate double, eval_loss double, eval_runtime double, eval_samples_per_second double, "
    "eval_steps_per_second double, train_runtime double, train_samples_per_second double, train_steps_per_second double, total_flos double, train_loss double"
)
TURN = "split string, variant string, task string, source string, messages array<struct<role:string,content:string>>"
FLORES = "id int, text string"
TRAINER_STATE = "global_step int, max_steps int"


def lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with ``file`` and ``pos`` in the file's order; a missing file raises.

    A file is read by one task, as its lines' places are its order; undecodable bytes are replaced and blank lines passed over.
    """
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    rows = text.select("file", F.posexplode(F.split("value", "\r?\n")).alias("pos", "line")).filter(F.trim("line") != "")
    return rows.select("file", F.col("pos").cast("long").alias("pos"), F.from_json("line", schema).alias("r")).select("file", "pos", "r.*")


def split_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of files of any size with ``file`` and ``pos``, split over tasks: ``pos`` rises in the file's order, with gaps.

    A line's ``pos`` is the first byte of its block and its number in the task, so that of one file of
    one block it is its number in the file; files that share a task begin higher.  Every line takes a byte at least, so numbers stay under the next block's first byte; a block
    that shares its task is a file's last one.  Blank lines count and are passed over, as is a carriage return at an end.
    """
    number = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    text = spark.read.option("lineSep", "\n").text(path)
    rows = text.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("begins"), "value").withColumn("number", number)
    rows = rows.filter(F.trim(F.rtrim("value", F.lit("\r"))) != "")
    return rows.select("file", (F.col("begins") + F.col("number")).alias("pos"), F.from_json("value", schema).alias("r")).select("file", "pos", "r.*")


def mixture(spark: SparkSession, path: str, missing_ok: bool = False) -> DataFrame:
    """Documents of a mixture file, of any size; with ``missing_ok`` a missing file has no rows."""
    if missing_ok and not files.exists(spark, path):
        return spark.createDataFrame([], f"file string, pos long, {MIXTURE_DOC}")
    return split_lines(spark, path, MIXTURE_DOC)


def large_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines where order does not count: split over tasks, columns pruned."""
    return spark.read.schema(schema).json(path)


def documents_of(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """One JSON document for each file, with ``stem``."""
    rows = spark.read.option("multiLine", "true").schema(schema).json(glob)
    return rows.select(F.regexp_replace("_metadata.file_name", r"\.json$", "").alias("stem"), "*")


def points(spark: SparkSession, glob: str) -> DataFrame:
    return documents_of(spark, glob, POINT)


def measures(point: DataFrame) -> DataFrame:
    """``stem, point, capability`` and the measurement's fields, the texts' pairs as ``per_text`` (nll, chars)."""
    rows = point.select("stem", "point", F.explode("mesures").alias("capability", "m"))
    pairs = F.transform("m.par_texte", lambda x: F.struct(x[0].alias("nll"), x[1].cast("long").alias("chars")))
    return rows.select("stem", "point", "capability", "m.bits_par_caractere", F.col("m.intervalle")[0].alias("low"), F.col("m.intervalle")[1].alias("high"), "m.perplexite", "m.tokens", "m.caracteres", pairs.alias("per_text"))


def per_text(measured: DataFrame) -> DataFrame:
    return measured.select("stem", "point", "capability", F.posexplode("per_text").alias("pos", "x")).select("stem", "point", "capability", "pos", "x.nll", "x.chars")


def answers(spark: SparkSession, directory: str) -> DataFrame:
    return lines(spark, f"{directory.rstrip('/')}/reponses-*.jsonl", HELD_OUT_ANSWER)


def turns(spark: SparkSession, path: str) -> DataFrame:
    """Instruction turns in the file's order, with ``turn_id``."""
    return lines(spark, path, TURN).withColumnRenamed("pos", "turn_id").drop("file")


def flores(spark: SparkSession, path: str) -> DataFrame:
    """Sentences of one language: ``id, text, pos``."""
    return lines(spark, path, FLORES).select("id", "text", "pos")


def log(spark: SparkSession, path: str) -> DataFrame:
    """A run's training log."""
    return lines(spark, path, LOG).drop("file")


def trainer_state(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", "true").schema(TRAINER_STATE).json(path)


def recipe(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", "true").schema(RECIPE).json(path)


def held_out(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HELD_OUT).json(path)


def licences(spark: SparkSession, path: str) -> dict[str, str]:
    """Licence by part of a small CSV: blank ones are passed over, a later line wins; an absent file has none."""
    import csv
    import io

    text = files.read_text(spark, path)
    return {r["part"]: r["licence"] for r in csv.DictReader(io.StringIO(text or "")) if r.get("licence")}


def rewritten(df: DataFrame, path: str) -> None:
    """Replaces a table that ``df`` may be read from: written beside it, the old one put aside, the new one put in its place.

    At any moment the old or the new table is whole under ``path``, ``path.new`` or ``path.old``.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    fresh, aside = f"{path}.new", f"{path}.old"
    fs, at = files._at(spark, path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    df.write.mode("overwrite").parquet(fresh)
    files.delete(spark, aside)
    if fs.exists(at) and not fs.rename(at, place(aside)):
        raise OSError(f"{path} cannot be put aside")
    if not fs.rename(place(fresh), at):
        fs.rename(place(aside), at)
        raise OSError(f"{path} cannot be replaced")
    files.delete(spark, aside)
