"""A maintained index of recorded values: what a column held for each entity, and when.

The index is a folder of Parquet, partitioned by column key, with a small registry (JSON) beside it. Rows are (column_key,
entity, at, value as text, event_name). A column is indexed once; later runs add what is new since each event name's last
instant, less a lookback for late rows, without those that are there already. Queries read the index and, past its day of
completeness, the source itself, so they are exact however old it is.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, replace
from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.exprs import col, null_safe
from tidemark.sources.catalog import density
from tidemark.specs import Breakdown, Values

COLUMNS = ("column_key", "entity", "at", "value", "event_name")
SCHEMA = "column_key string, entity {entity}, at timestamp_ntz, value string, event_name string"
MAX_DENSITY, PROBE_DAYS, PROBE_TTL = 0.25, 30, timedelta(days=7)
#: Bookmarks that are broadcast, and names whose counts the registry keeps, up to so many; of more, one count for all.
MAX_BROADCAST, MAX_NAMES, ALL = 100_000, 10_000, "*"
LOOKBACK_DAYS, REFRESH_AFTER, DROP_AFTER, SWEEP_EVERY = 3, timedelta(days=7), timedelta(days=60), timedelta(hours=24)


def column_key(expr: str) -> str:
    """A plain column's name, else a hash of the expression."""
    return expr if expr.isidentifier() else "x" + hashlib.sha1(expr.encode()).hexdigest()[:16]


def index_rows(source: DataFrame, columns: dict[str, str], entity: str, at: str, event_name: str) -> DataFrame:
    """The recorded values of several columns, from one scan: a row for each value that is there."""
    base = source.select(col(entity).alias("entity"), col(at).cast("timestamp_ntz").alias("at"), col(event_name).alias("event_name"), F.array(*(F.struct(F.lit(k).alias("column_key"), col(e).cast("string").alias("value")) for k, e in columns.items())).alias("x"))
    rows = base.where("entity IS NOT NULL AND at IS NOT NULL").select("entity", "at", "event_name", F.inline("x")).where("value IS NOT NULL")
    return rows.select(*COLUMNS)


def bookmarks(index: DataFrame) -> DataFrame:
    """event_name, last_at, rows of an index: null and empty names are names of their own."""
    return index.groupBy("column_key", "event_name").agg(F.max("at").alias("last_at"), F.count("*").alias("rows"))


def anti_append(index: DataFrame, fresh: DataFrame, marks: DataFrame, lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """Rows of fresh that the index lacks, from each name's bookmark less the lookback on; names without a bookmark in full."""
    floor = marks.select(F.col("column_key").alias("k"), F.col("event_name").alias("m"), (F.col("last_at") - F.make_dt_interval(F.lit(lookback_days))).alias("floor"))
    if floor.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        floor = F.broadcast(floor)
    near = fresh.join(floor, (F.col("column_key") == F.col("k")) & F.col("event_name").eqNullSafe(F.col("m")), "left")
    near = near.where("floor IS NULL OR at >= floor").drop("k", "m", "floor")
    have = index.select(*(F.col(c).alias(f"i_{c}") for c in COLUMNS))
    same = null_safe([F.col(c) for c in COLUMNS], [F.col(f"i_{c}") for c in COLUMNS])
    return near.join(have, same, "left_anti")


@dataclass
class Entry:
    expr: str
    last_at: str | None = None
    complete_until: str | None = None
    refreshed: str | None = None
    used: str | None = None
    probed: str | None = None
    density: float | None = None
    counts: dict[str, int] = field(default_factory=dict)


@dataclass(frozen=True)
class Mapping:
    """Where an index comes from; another mapping is another index."""

    source: str
    entity: str
    at: str
    event_name: str

    @property
    def fingerprint(self) -> str:
        return hashlib.sha1(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()


class ValueIndex:
    """The index of one source in a folder that the session's file system can reach."""

    def __init__(self, spark: SparkSession, path: str, source: DataFrame, mapping: Mapping, now: datetime | None = None):
        self.spark, self.path, self.source, self.mapping = spark, path.rstrip("/"), source, mapping
        self.now = now or datetime.now()
        self.entries = self._load()

    def _file(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/registry.json")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _load(self) -> dict[str, Entry]:
        fs, p = self._file()
        if not fs.exists(p):
            return {}
        stored = json.loads("".join(r["value"] for r in self.spark.read.text(p.toString(), wholetext=True).collect()))
        return {k: Entry(**v) for k, v in stored["columns"].items()} if stored["fingerprint"] == self.mapping.fingerprint else {}

    def _save(self) -> None:
        fs, p = self._file()
        out = fs.create(p, True)
        out.write(bytearray(json.dumps({"fingerprint": self.mapping.fingerprint, "columns": {k: asdict(v) for k, v in self.entries.items()}}).encode()))
        out.close()

    def _stamp(self) -> str:
        return self.now.isoformat()

    def _age(self, stamp: str | None) -> timedelta:
        return self.now - datetime.fromisoformat(stamp) if stamp else timedelta.max

    def _rows(self, keys: list[str]) -> DataFrame:
        return index_rows(self.source, {k: self.entries[k].expr for k in keys}, self.mapping.entity, self.mapping.at, self.mapping.event_name)

    def read(self) -> DataFrame:
        kind = self.source.select(col(self.mapping.entity)).schema[0].dataType.simpleString()
        return self.spark.read.schema(SCHEMA.format(entity=kind)).parquet(f"{self.path}/rows")

    def exists(self, key: str) -> bool:
        fs, _ = self._file()
        return fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/rows/column_key={key}"))

    def plan(self, exprs: list[str], probe: bool = True) -> dict[str, str]:
        """For each column: attach, build, refresh, rebuild or live. With probe=False nothing is run, and unknown columns are live."""
        out = {}
        for expr in dict.fromkeys(exprs):
            key = column_key(expr)
            entry = self.entries.get(key)
            if entry and entry.complete_until and not self.exists(key):
                out[key] = "rebuild"
            elif entry and entry.complete_until:
                out[key] = "refresh" if self._age(entry.refreshed) > REFRESH_AFTER else "attach"
            elif not probe:
                out[key] = "live"
            else:
                entry = self.entries.setdefault(key, Entry(expr))
                if entry.density is None or self._age(entry.probed) > PROBE_TTL:
                    r = density(self.source, expr, self.mapping.at, self.now, PROBE_DAYS).first()
                    entry.density, entry.probed = (r["with_value"] / r["rows"] if r["rows"] else 0.0), self._stamp()
                out[key] = "live" if entry.density > MAX_DENSITY else "build"
        return out

    def apply(self, plan: dict[str, str]) -> None:
        """Builds and refreshes what the plan says. A column is in the registry only once its rows are written."""
        build = [k for k, v in plan.items() if v in ("build", "rebuild")]
        if build:
            self._write(self._rows(build), "overwrite")
            self._record(build)
        refresh = [k for k, v in plan.items() if v == "refresh"]
        if refresh:
            self._refresh(refresh)
        for key in plan:
            if key in self.entries:
                self.entries[key].used = self._stamp()
        self._save()

    def _write(self, rows: DataFrame, mode: str) -> None:
        # One column is one partition; within it, entities lie together, so that row groups can be skipped.
        rows = rows.repartition("column_key", "entity").sortWithinPartitions("column_key", "entity", "at")
        rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("column_key").parquet(f"{self.path}/rows")
        fs, _ = self._file()
        out = fs.create(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/mapping.txt"), True)
        out.write(bytearray(self.mapping.fingerprint.encode()))
        out.close()

    def _counts(self, keys: list[str]) -> dict[str, tuple[dict[str, int], datetime | None]]:
        """For each column: rows by event name (as JSON), or of all where there are over MAX_NAMES; and the last instant."""
        marks = bookmarks(self.read().where(F.col("column_key").isin(keys)))
        sums = {r["column_key"]: r for r in marks.groupBy("column_key").agg(F.count("*").alias("names"), F.sum("rows").alias("rows"), F.max("last_at").alias("last_at")).collect()}
        few = [k for k, r in sums.items() if r["names"] <= MAX_NAMES]
        out = {k: ({ALL: sums[k]["rows"]} if k in sums else {}, sums[k]["last_at"] if k in sums else None) for k in keys}
        out |= {k: ({}, sums[k]["last_at"]) for k in few}
        for r in marks.where(F.col("column_key").isin(few)).collect():
            out[r["column_key"]][0][json.dumps(r["event_name"])] = r["rows"]
        return out

    def _record(self, keys: list[str]) -> None:
        for key, (counts, last) in self._counts(keys).items():
            entry = self.entries[key]
            entry.counts = counts
            entry.last_at = last.isoformat() if last else None
            done = (last or self.now - timedelta(days=3650)) - timedelta(days=max(1, LOOKBACK_DAYS))
            entry.complete_until = done.replace(hour=0, minute=0, second=0, microsecond=0).isoformat()
            entry.refreshed = self._stamp()

    def _refresh(self, keys: list[str]) -> None:
        """Adds new rows; a column whose counts have shrunk since the last time has lost rows and is built anew."""
        counts = self._counts(keys)
        lost = []
        for k in keys:
            before, after = self.entries[k].counts, counts[k][0]
            if ALL in before or ALL in after:
                before, after = ({ALL: sum(x.values())} for x in (before, after))
            if any(after.get(n, 0) < c for n, c in before.items()):
                lost.append(k)
        if lost:
            self._write(self._rows(lost), "overwrite")
        whole = [k for k in keys if k not in lost]
        if whole:
            index = self.read().where(F.col("column_key").isin(whole))
            self._write(anti_append(index, self._rows(whole), bookmarks(index)), "append")
        self._record(keys)

    def forget_names(self, names: list[str | None], fresh: bool = False) -> None:
        """Drops the rows of these event names from all columns; with fresh, what the source has of them takes their place."""
        keys = [k for k, e in self.entries.items() if e.complete_until and self.exists(k)]
        if not keys or not names:
            return
        known = [n for n in names if n is not None]
        theirs = F.coalesce(F.col("event_name").isin(known), F.lit(False)) if known else F.lit(False)
        theirs = theirs | F.col("event_name").isNull() if None in names else theirs
        rows = self.read().where(F.col("column_key").isin(keys) & ~theirs).select(*COLUMNS)
        if fresh:
            rows = rows.unionByName(self._rows(keys).where(theirs))
        self._write(rows, "overwrite")  # by partition, each swapped when its new files are complete
        left = {r[0] for r in self.read().select("column_key").distinct().collect()}
        for key in set(keys) - left:  # a partition without new rows isn't swapped
            self._delete(key)
        if kept := [k for k in keys if k in left]:
            self._record(kept)
        for key in set(keys) - set(kept):
            self.entries[key].complete_until = None
        self._save()

    def repair_names(self, now_census: DataFrame, known: DataFrame) -> list[str]:
        """Event names whose census (value, rows, first_at) shrank or begins earlier than it did; their rows, and only these, are
        taken anew."""
        changed = now_census.alias("n").join(known.alias("k"), F.expr("n.value <=> k.value"), "full").where("n.rows < k.rows OR n.rows IS NULL OR n.first_at < k.first_at")
        names = [r[0] for r in changed.select(F.coalesce("n.value", "k.value")).limit(MAX_NAMES).collect()]
        self.forget_names(names, fresh=True)
        return names

    def sweep(self, wanted: list[str], last: str | None = None) -> list[str]:
        """Drops columns that no one used for DROP_AFTER and that aren't wanted now; the registry goes first."""
        if last is not None and self._age(last) < SWEEP_EVERY:
            return []
        keep = {column_key(e) for e in wanted}
        gone = [k for k, e in self.entries.items() if k not in keep and e.complete_until and self._age(e.used) > DROP_AFTER]
        for k in gone:
            del self.entries[k]
        self._save()
        for k in gone:
            self.drop(k)
        return gone

    def _delete(self, key: str) -> None:
        fs, _ = self._file()
        fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/rows/column_key={key}"), True)

    def drop(self, key: str) -> None:
        self._delete(key)
        if key in self.entries:
            del self.entries[key]
            self._save()

    def reconcile(self, wanted: list[str] = ()) -> list[str]:
        """Registry and rows agree again: entries without rows are forgotten; partitions that the registry lost are taken back
        if they are those of a wanted expression and were written under this mapping, else dropped. What was taken back."""
        fs, _ = self._file()
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        root, mark = path(f"{self.path}/rows"), path(f"{self.path}/mapping.txt")
        there = {s.getPath().getName() for s in fs.listStatus(root)} if fs.exists(root) else set()
        there = {n.removeprefix("column_key=") for n in there if n.startswith("column_key=")}
        ours = fs.exists(mark) and self.spark.read.text(mark.toString()).first()[0] == self.mapping.fingerprint
        self.entries = {k: e for k, e in self.entries.items() if not e.complete_until or k in there}
        exprs = {column_key(e): e for e in wanted}
        back = sorted(k for k in there & set(exprs) if ours and not (k in self.entries and self.entries[k].complete_until))
        self.entries |= {k: Entry(exprs[k]) for k in back}
        if back:
            self._record(back)
        for k in there - {k for k, e in self.entries.items() if e.complete_until}:
            self._delete(k)
        self._save()
        return back

    def attach(self, b: Breakdown, names: list[str] | None = None) -> Breakdown:
        """b reading from the index, with the source itself after its day of completeness; b as it is if its column isn't there.

        names: event names that may record values, which must be what fill_from says: without them a breakdown with a
        fill_from stays as it is, as the index doesn't know which of its rows satisfy it.
        """
        if b.fill_from is not None and names is None:
            return b
        key = column_key(b.expr) if isinstance(b.expr, str) else None
        entry = self.entries.get(key) if key else None
        if entry is None or not entry.complete_until or b.at == "rows" or not self.exists(key):
            return b
        rows = self.read().where(F.col("column_key") == key)
        if names is not None:
            rows = rows.where(F.col("event_name").isin(names))
        kind = self.source.select(col(b.expr)).schema[0].dataType
        # Rows later than the day of completeness come from the source; those of the index there may be incomplete.
        until = datetime.fromisoformat(entry.complete_until)
        rows = rows.where(F.col("at") <= F.lit(until).cast("timestamp_ntz")).select("entity", "at", F.col("value").cast(kind).alias("value"))
        return replace(b, values=Values(rows), complete_until=F.lit(until).cast("timestamp_ntz"))


def with_fallback(indexed, live):
    """indexed(), or live() if a relation that it reads is gone."""
    from tidemark.plans.runner import missing_relation

    try:
        return indexed()
    except AnalysisException as e:
        if not missing_relation(e):
            raise
        return live()
