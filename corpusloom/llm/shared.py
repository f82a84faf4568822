"""What the operators of this subpackage share: the shared folder, tables, row keys."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_dir

#: ASCII white space as the contracts have it.
BLANKS = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/corpusloom/{name}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Paths of the tables that results given out so far are read from.
LEFT: list[str] = []


class Tables:
    """Tables of one run of an operator, in the shared folder: lineage ends there and lost executors cost nothing.

    A table is dropped once what was made of it is written; those that the result is read from stay in ``LEFT``.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, name: str, **options) -> DataFrame:
        """``df`` written and read again; a table of the same name goes, as ``df`` may be made of it, after that."""
        path, before = scratch(self.spark, name), self.paths.get(name)
        df.write.options(**options).parquet(path)
        self.paths[name] = path
        LEFT.append(path)
        self._remove(before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._remove(self.paths.pop(name, None))

    def _remove(self, path: str | None) -> None:
        if path:
            removed(self.spark, path)
            LEFT.remove(path)


def swept(spark: SparkSession, docs: DataFrame, paths: list[str]) -> None:
    """Removes the tables at ``paths``, left by results that are written by now, but for those that ``docs`` is read from."""
    read = docs.inputFiles() if paths else []
    for path in list(paths):
        if not any(path.rpartition("/")[2] in file for file in read):
            removed(spark, path)
            paths.remove(path)
            LEFT.remove(path)


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """``df`` as a table that stays."""
    return Tables(df.sparkSession).write(df, name, **options)


#: Bytes of an Arrow batch, and what Spark takes if nothing else is set: 10,000 texts, or 64 MB.
BATCH_BYTES, _USUAL = 8 << 20, f"{64 << 20}b"


def bounded_batches(spark: SparkSession) -> None:
    """Lets texts pass between Spark and its Python workers in batches of ``BATCH_BYTES``, unless the session has a bound of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, _USUAL) == _USUAL:
        spark.conf.set(name, str(BATCH_BYTES))


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("*",)))


def unit_hash(seed: str, *cols: str) -> Column:
    """A double in [0, 1) from 52 bits of the md5 of the seed and the columns; the same in every engine."""
    text = F.concat_ws(":", F.lit(seed), *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in cols))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that names made by an operator cannot clash with them."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in df.columns)).alias("row")


def row_schema(df: DataFrame, before: str = "", after: str = "") -> T.StructType:
    """Fields of ``before``, the ``row`` of ``df`` whatever its columns are called, and those of ``after``."""
    fields = lambda ddl: T.StructType.fromDDL(ddl).fields if ddl else []
    return T.StructType([*fields(before), T.StructField("row", df.schema["row"].dataType), *fields(after)])
