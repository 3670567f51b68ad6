"""Files in folders that the driver and all executors share, by Hadoop's file systems."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only on a single machine whose session names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def fresh_dir(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def located(spark: SparkSession, path: str):
    """(file system, path) as Hadoop has them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = located(spark, path)
    return fs.exists(at)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of a folder's entries, in order; none of a folder that isn't there."""
    fs, at = located(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, at = located(spark, path)
    fs.delete(at, True)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def write_new(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file whole or not at all; one that is there already is an error."""
    fs, at = located(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(f"{at.getParent().toString()}/.{uuid.uuid4().hex}")
    out = fs.create(part, False)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(at) or not fs.rename(part, at):
        fs.delete(part, False)
        raise FileExistsError(path)


def written(df: DataFrame, path: str) -> DataFrame:
    """Write as Parquet and read again, which cuts the lineage."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
