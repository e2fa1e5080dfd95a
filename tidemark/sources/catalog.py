"""Facts about tables and columns: names, types, event names, density, units of epochs."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.exprs import col
from tidemark.functions.timeaxis import epoch_unit, literal_now
from tidemark.specs import Expr

NAMES, SAMPLE = 1_000, 1_000


def family(kind: T.DataType) -> str:
    """What filters and pickers may do with a column of this type."""
    if isinstance(kind, T.StringType):
        return "string"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.NumericType):
        return "numeric"
    if isinstance(kind, T.DateType):
        return "date"
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return "timestamp"
    return "time" if type(kind).__name__ == "TimeType" else "other"


def can_be_entity(kind: T.DataType) -> bool:
    return isinstance(kind, T.StringType | T.IntegralType) or isinstance(kind, T.DecimalType) and kind.scale == 0


def columns(df: DataFrame) -> list[dict]:
    return [{"name": f.name, "type": f.dataType.simpleString(), "family": family(f.dataType), "entity": can_be_entity(f.dataType)} for f in df.schema]


def databases(spark: SparkSession) -> list[str]:
    return [d.name for d in spark.catalog.listDatabases()]


def tables(spark: SparkSession, database: str | None = None) -> list[str]:
    return [t.name for t in spark.catalog.listTables(database)]


def layout(spark: SparkSession, table: str) -> dict:
    """Partition and bucket columns of a table."""
    own = spark.catalog.listColumns(table)
    return {"partition": [c.name for c in own if c.isPartition], "bucket": [c.name for c in own if c.isBucket]}


def event_names(df: DataFrame, name: Expr, event_time: Expr | None = None, start=None, end=None, limit: int = NAMES) -> DataFrame:
    """value: distinct names in a window, in order, at most `limit`."""
    if event_time is not None and start is not None:
        df = df.where(col(event_time) >= start)
    if event_time is not None and end is not None:
        df = df.where(col(event_time) < end)
    return df.select(col(name).alias("value")).where("value IS NOT NULL").distinct().orderBy("value").limit(limit)


def census(df: DataFrame, name: Expr, event_time: Expr) -> DataFrame:
    """value, month, rows, first_at, last_at: what each event name has in each month."""
    rows = df.select(col(name).alias("value"), col(event_time).alias("at"))
    return rows.groupBy("value", F.trunc("at", "MONTH").alias("month")).agg(F.count("*").alias("rows"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def census_by_name(months: DataFrame) -> DataFrame:
    return months.groupBy("value").agg(F.sum("rows").alias("rows"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))


class CensusCache:
    """The census of a source in a folder, kept for TTL; then only its last months are counted anew, unless names or the
    source are others than those it was made from."""

    TTL, LATE_DAYS = timedelta(hours=24), 3

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _stamp(self) -> dict:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/stamp.json")
        if not p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return {}
        return json.loads(self.spark.read.text(p.toString(), wholetext=True).first()[0])

    def get(self, df: DataFrame, made_from: str, name: str, event_time: str, now: datetime | None = None) -> DataFrame:
        """What census() gives, from the cache as far as it holds."""
        now, key = now or datetime.now(), [made_from, name, event_time]
        stamp = self._stamp()
        known = stamp.get("key") == key
        if known and now - datetime.fromisoformat(stamp["at"]) <= self.TTL:
            return self.spark.read.parquet(f"{self.path}/{stamp['folder']}")
        if known:
            first = (datetime.fromisoformat(stamp["at"]) - timedelta(days=self.LATE_DAYS)).replace(day=1, hour=0, minute=0, second=0, microsecond=0)
            old = self.spark.read.parquet(f"{self.path}/{stamp['folder']}")
            months = old.where(F.col("month") < F.lit(first.date())).unionByName(census(df.where(col(event_time) >= F.lit(first)), name, event_time))
        else:
            months = census(df, name, event_time)
        folder = f"months-{now:%Y%m%d%H%M%S%f}"
        months.write.mode("overwrite").parquet(f"{self.path}/{folder}")
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/stamp.json")
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        out = fs.create(p, True)  # after the rows: a reader never sees a stamp without them
        out.write(bytearray(json.dumps({"key": key, "at": now.isoformat(), "folder": folder}).encode()))
        out.close()
        if known and stamp["folder"] != folder:
            fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{stamp['folder']}"), True)
        return self.spark.read.parquet(f"{self.path}/{folder}")


#: A filter prunes if it spares more than half the bytes, and at least so many.
SHARE, LEAST_SAVED = 0.5, 20 << 20
#: Files smaller than this on average, and more partitions than this, make a table slow to plan and to read.
SMALL_FILE, MANY_PARTITIONS = 16 << 20, 4_000


def bytes_touched(df: DataFrame, where: Expr | None = None) -> int:
    """Bytes of the files that hold rows of the filter; what a scan has to open, however it is partitioned or sorted."""
    some = df.select("*", F.col("_metadata.file_path").alias("__tm_file"), F.col("_metadata.file_size").alias("__tm_size"))
    some = some if where is None else some.where(col(where))
    return some.groupBy("__tm_file").agg(F.first("__tm_size").alias("b")).agg(F.sum("b")).first()[0] or 0


def prunes(df: DataFrame, where: Expr, share: float = SHARE, least: int = LEAST_SAVED) -> bool:
    """Whether files can be passed over under the filter: more than half the bytes, and 20 MiB at least."""
    total, touched = bytes_touched(df), bytes_touched(df, where)
    return touched < share * total and total - touched > least


def diagnose(df: DataFrame, event_time: str, event_column: str | None = None, least: int = LEAST_SAVED) -> list[dict]:
    """check, ok, found, advice: how well a source of files is laid out for reports over a range of time and single events."""
    files = df.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("b")).groupBy("f").agg(F.first("b").alias("b"))
    folder = F.regexp_extract_all("f", F.lit("/([^/=]+)=[^/]*"), F.lit(1))
    facts = files.agg(F.count("*").alias("n"), F.sum("b").alias("bytes"), F.countDistinct(F.regexp_extract("f", "^(.*)/[^/]*$", 1)).alias("folders"), F.first(folder).alias("columns")).first()
    n, total, keys = facts["n"], facts["bytes"] or 0, facts["columns"] or []
    out = [{"check": "partitions", "ok": bool(keys), "found": ", ".join(keys) or "none", "advice": "" if keys else f"partition by the day of {event_time}"}]
    out.append({"check": "partition_count", "ok": facts["folders"] <= MANY_PARTITIONS, "found": str(facts["folders"]), "advice": "" if facts["folders"] <= MANY_PARTITIONS else "partition by month instead"})
    small = n > 1 and total / n < SMALL_FILE and total > SMALL_FILE
    out.append({"check": "file_size", "ok": not small, "found": f"{total // max(n, 1)} bytes in {n} files", "advice": "write fewer, larger files" if small else ""})
    ends = df.agg(F.max(event_time).alias("last"), F.min(event_time).alias("first")).first()
    if ends["last"] is not None:
        middle = ends["first"] + (ends["last"] - ends["first"]) * 0.75
        ok = prunes(df, F.col(event_time) >= F.lit(middle), least=least)
        out.append({"check": "time", "ok": ok, "found": f"the last quarter since {middle}", "advice": "" if ok else f"a range of {event_time} reads nearly all files: partition or sort by it"})
    if event_column is not None and (name := df.groupBy(event_column).count().orderBy("count", event_column).select(event_column).first()) is not None:
        ok = prunes(df, F.col(event_column).eqNullSafe(F.lit(name[0])), least=least)
        out.append({"check": "events", "ok": ok, "found": str(name[0]), "advice": "" if ok else f"one event reads nearly all files: sort by {event_column} within partitions"})
    return out


def access(spark: SparkSession, source, folder: str | None = None) -> dict:
    """read, write (None if not asked), problem: whether the session may read a source and write to a folder."""
    from tidemark.plans.runner import problem
    from tidemark.sources.relations import relation

    out: dict = {"read": False, "write": None, "problem": None}
    try:
        relation(spark, source).limit(1).count()
        out["read"] = True
        if folder is not None:
            out["write"] = False
            probe = f"{folder.rstrip('/')}/_access_probe"
            spark.range(1).write.mode("overwrite").parquet(probe)
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(probe)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
            out["write"] = True
    except (PySparkException, OSError) as e:
        out["problem"] = problem(e)
    return out


def density(df: DataFrame, expr: Expr, event_time: Expr, now: datetime | None = None, days: int = 30) -> DataFrame:
    """rows, with_value: over the last days."""
    recent = df.where(col(event_time) >= literal_now(now) - F.make_dt_interval(F.lit(days)))
    return recent.agg(F.count("*").alias("rows"), F.count(col(expr)).alias("with_value"))


def epoch_kind(df: DataFrame, column: str, sample: int = SAMPLE) -> str:
    """Seconds, milliseconds or microseconds, by the median of a few values."""
    some = df.select(F.col(column).cast("double").alias("x")).where("x IS NOT NULL").limit(sample)
    return epoch_unit(some.agg(F.median("x")).first()[0])
