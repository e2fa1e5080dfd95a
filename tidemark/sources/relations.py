"""Where rows come from and go to: tables, paths and DataFrames."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.exprs import col
from tidemark.specs import Expr, Source

FORMATS = ("parquet", "orc", "json", "csv", "avro", "text")


def relation(spark: SparkSession, source: Source) -> DataFrame:
    """A DataFrame as it is; text with a slash or a known ending is a path (parquet unless the ending says else), other text a table."""
    if isinstance(source, DataFrame):
        return source
    ending = source.rsplit(".", 1)[-1].lower()
    if ending in FORMATS:
        return spark.read.format(ending).load(source)
    return spark.read.parquet(source) if "/" in source else spark.table(source)


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors share, under spark.checkpoint.dir; on one machine that may be unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{shared or '/tmp/checkpoints'}/{name}-{uuid.uuid4().hex}"


def filtered(df: DataFrame, where: Expr | None) -> DataFrame:
    return df if where is None else df.where(col(where))


def append(df: DataFrame, table: str) -> None:
    df.write.insertInto(table) if df.sparkSession.catalog.tableExists(table) else df.write.saveAsTable(table)


def replace(df: DataFrame, table: str, partition_by: tuple[str, ...] = (), comment: str | None = None, day_of: str | None = None, cluster_by: tuple[str, ...] = ()) -> None:
    """df as the table's new content; comment, such as a fingerprint of what it was made from, is kept as a property.

    day_of: an instant's column, whose day becomes the partition column event_day. cluster_by: columns whose equal values lie
    together in a partition's files, so that row groups can be skipped; without partitions the whole table is sorted by them.
    """
    if day_of is not None:
        df, partition_by = df.withColumn("event_day", F.to_date(day_of)), (*partition_by, "event_day")
    if cluster_by:
        df = df.repartition(*partition_by).sortWithinPartitions(*partition_by, *cluster_by) if partition_by else df.repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by)
    writer = df.write.mode("overwrite").partitionBy(*partition_by) if partition_by else df.write.mode("overwrite")
    writer.saveAsTable(table)
    if comment is not None:
        text = comment.replace("\\", "\\\\").replace("'", "\\'")
        df.sparkSession.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('tidemark.made_from' = '{text}')")


def fingerprint(spark: SparkSession, table: str) -> str | None:
    """The comment that replace() left, None without table or comment."""
    if not spark.catalog.tableExists(table):
        return None
    rows = spark.sql(f"SHOW TBLPROPERTIES {table}").where(F.col("key") == "tidemark.made_from").collect()
    return rows[0]["value"] if rows else None
