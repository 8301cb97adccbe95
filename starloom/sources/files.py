"""Small files beside tables, through Hadoop's file systems, so that any store Spark reads will do."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a file that must not be there yet; False if it is."""
    fs, at = _fs(spark, path)
    if fs.exists(at):
        return False
    try:
        out = fs.create(at, False)
    except Exception as e:
        if "AlreadyExists" in str(e):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def read(spark: SparkSession, path: str) -> str:
    fs, at = _fs(spark, path)
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def names(spark: SparkSession, path: str) -> list[str]:
    """What is in a folder, in order; nothing if there is no folder."""
    fs, at = _fs(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at, True)


def state(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of the files of a table: another state, another content."""
    fs, at = _fs(spark, path)
    found, out = fs.listFiles(at, True), []
    while found.hasNext():
        x = found.next()
        out.append((x.getPath().toString(), x.getLen(), x.getModificationTime()))
    return tuple(sorted(out))
