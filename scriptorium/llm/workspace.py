"""Shared scratch tables: the way these operators cut lineage.

A cluster names a folder that every executor and the driver can reach in ``spark.checkpoint.dir``; tables written there
outlive any executor. Only where the setting is absent and all is one machine (tests, laptops) is a folder of our own used.
Tables stay for as long as results may be read from them: :func:`clear` removes an application's.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Used only when the session names no shared folder and its master is local.
DEFAULT_DIR = "file:///tmp/checkpoints/scriptorium"


def shared_dir(spark: SparkSession) -> str:
    """ValueError on a cluster whose session names none: a folder of each machine's own would lose data."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    return (named or DEFAULT_DIR).rstrip("/")


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/scriptorium-{spark.sparkContext.applicationId}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: what follows no longer depends on how it was made."""
    spark = df.sparkSession
    path = f"{_own(spark)}/{uuid.uuid4().hex}/{label}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Remove every table that this application staged. Results that still read them must be stored before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def extended(source: DataFrame, added: str) -> StructType:
    """The schema of a table without its last column (the text that a step reads), and the columns that are added."""
    return StructType([*source.schema.fields[:-1], *StructType.fromDDL(added).fields])
