"""Small files and listings through Hadoop's file systems: local, HDFS or an object store alike."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of a data root in the order in which they are searched.
BUCKETS = ("travail", "source", "produit", "attente")


def _at(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _at(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_bytes(spark: SparkSession, path: str) -> bytes | None:
    """A small object, None if it is not there."""
    fs, p = _at(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    raw = read_bytes(spark, path)
    return None if raw is None else raw.decode("utf-8", "replace")


def find(spark: SparkSession, root: str, name: str, buckets: tuple[str, ...] = BUCKETS) -> str | None:
    """The first folder's file of this name."""
    return next((p for p in (f"{root.rstrip('/')}/{b}/{name}" for b in buckets) if exists(spark, p)), None)


def path(spark: SparkSession, root: str, name: str, buckets: tuple[str, ...] = BUCKETS) -> str:
    if (found := find(spark, root, name, buckets)) is None:
        raise FileNotFoundError(f"{name} is in none of {', '.join(buckets)} under {root}")
    return found


def listing(spark: SparkSession, root: str) -> DataFrame:
    """``key, size`` of all files under a root, keys relative to it; pages of an object store are followed."""
    fs, p = _at(spark, root)
    base = fs.makeQualified(p).toUri().getPath().rstrip("/") + "/"
    rows = []
    if fs.exists(p):
        files = fs.listFiles(p, True)
        while files.hasNext():
            f = files.next()
            rows.append((f.getPath().toUri().getPath().removeprefix(base), f.getLen()))
    return spark.createDataFrame(rows, "key string, size long")


def digests(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """``key, sha256`` of the files under a root, keys relative to it, hashed on the executors."""
    fs, p = _at(spark, root)
    base = fs.makeQualified(p).toString().rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select(F.replace("path", F.lit(base), F.lit("")).alias("key"), F.sha2("content", 256).alias("sha256"))


def matches(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """``key, matches``: true, false, or null where the object is absent."""
    return wanted.select("key", F.col("sha256").alias("wanted")).join(found, "key", "left").select("key", (F.col("wanted") == F.col("sha256")).alias("matches"))


def digest(spark: SparkSession, file: str, block: int = 1 << 20) -> str | None:
    """sha256 of one file of any size, a block at a time."""
    fs, p = _at(spark, file)
    if not fs.exists(p):
        return None
    jvm, out, stream = spark.sparkContext._jvm, hashlib.sha256(), fs.open(p)
    try:
        while raw := bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, block))):
            out.update(raw)
    finally:
        stream.close()
    return out.hexdigest()


def writable(spark: SparkSession, root: str) -> str | None:
    """Why nothing can be written under a root, at most 300 characters, or None."""
    probe = f"{root.rstrip('/')}/.write-probe"
    try:
        write_text(spark, probe, "probe")
        if read_text(spark, probe) != "probe":
            return "what was written does not read back"
        delete(spark, probe)
    except Exception as e:  # whatever the store says is the answer
        return str(e)[:300]
    return None


def delete(spark: SparkSession, target: str) -> bool:
    fs, p = _at(spark, target)
    return fs.delete(p, True)


def copy(spark: SparkSession, source: str, target: str, strict: bool = False) -> bool:
    """Copies a file or folder between file systems; a failure raises if ``strict``, else is False."""
    try:
        (a, p), (b, q) = _at(spark, source), _at(spark, target)
        return spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(a, p, b, q, False, True, spark.sparkContext._jsc.hadoopConfiguration())
    except Exception:
        if strict:
            raise
        return False


def remove_keys(spark: SparkSession, root: str, plan: DataFrame) -> int:
    """Deletes the keys of a plan under a root; how many were there."""
    return sum(delete(spark, f"{root.rstrip('/')}/{r['key']}") for r in plan.select("key").toLocalIterator())
