"""What several operators of this subpackage share."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where checkpoints go if the session names no folder and runs on one machine, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only on one machine, as in tests, may it be unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return folder or LOCAL_CHECKPOINTS


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read from there: a lost executor costs nothing that came before."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def ascii_lower(text: Column) -> Column:
    """text with A-Z in lower case and all else as it is. lower() does just this where every character is one byte."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def private_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet (names are compared as Spark does, without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
