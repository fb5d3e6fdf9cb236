"""Files and folders on whatever storage a path names, through Hadoop's FileSystem; and checks that need the JVM."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _at(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if it is missing."""
    fs, p = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def make_folder(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.mkdirs(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None if there is none."""
    fs, p = _at(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes beside the file first and then puts the new one in its place, so that a reader never sees half of it."""
    fs, p = _at(spark, path)
    new = p.suffix(".new")
    out = fs.create(new, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    fs.delete(p, False)
    if not fs.rename(new, p):
        raise OSError(f"cannot write {path}")


def stored(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A Parquet table, or an empty one of the schema where nothing is stored yet."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def regex_error(pattern: str) -> str | None:
    """What is wrong with a pattern, as the engine that will run it says; None for a good one."""
    from pyspark import SparkContext
    from pyspark.errors import IllegalArgumentException

    context = SparkContext._active_spark_context
    if context is None:
        raise RuntimeError("patterns are checked by a running session")
    try:
        context._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException as e:
        return str(e).strip().splitlines()[0]
    return None
