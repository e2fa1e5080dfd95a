"""Index upkeep and simple series on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.valueindex import index_rows


def index_stream(source: DataFrame, columns: dict[str, str], entity: str, at: str, event_name: str, path: str, checkpoint: str, late: str = "3 days") -> StreamingQuery:
    """Appends recorded values to an index folder as they arrive, each once within the lateness that is waited for."""
    rows = index_rows(source, columns, entity, at, event_name).withColumn("at", F.col("at").cast("timestamp"))
    once = rows.withWatermark("at", late).dropDuplicatesWithinWatermark(["column_key", "entity", "at", "value", "event_name"])
    out = once.withColumn("at", F.col("at").cast("timestamp_ntz"))
    return out.writeStream.format("parquet").option("checkpointLocation", checkpoint).partitionBy("column_key").trigger(availableNow=True).start(path)


def totals(source: DataFrame, at: str, length: str = "1 day", slide: str | None = None, late: str = "1 day", by: tuple[str, ...] = (), entity: str | None = None) -> DataFrame:
    """window, keys, total, and with an entity uniques (by a sketch, so that state stays small), of a stream in tumbling or
    sliding windows; late rows count until the watermark passes."""
    timed = source.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy(F.window(at, length, slide), *by).agg(F.count("*").alias("total"), *([] if entity is None else [F.approx_count_distinct(entity).alias("uniques")]))
