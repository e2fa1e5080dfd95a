"""Running queries with bounds: an estimate of what is read, caps on it, limits on what comes back, time-outs."""

from __future__ import annotations

import threading
import uuid
from dataclasses import dataclass
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW_LIMIT, CAP_BYTES, TIMEOUT_S = 1_000_000, 10 << 30, 600
#: The size that Spark gives what it knows nothing of.
UNKNOWN = 2**63 - 1
#: What this runner can do, for callers that ask.
CAPABILITIES = frozenset({"dry_run", "bytes_processed", "scan_cap"})


class CapExceeded(RuntimeError):
    def __init__(self, size: int, cap: int):
        super().__init__(f"the query would read {size} bytes; the cap is {cap}")
        self.size, self.cap = size, cap


@dataclass(frozen=True)
class Result:
    rows: list[dict[str, Any]]
    bytes_estimated: int | None
    job: str


def _scans(node) -> list[int]:
    """Sizes of a plan's scans, each with the projection and the filters right above it."""
    below, top = node, node
    while below.nodeName() in ("Project", "Filter"):
        below = below.children().apply(0)
    children = below.children()
    if children.length() == 0:
        return [min(int(top.stats().sizeInBytes()), int(below.stats().sizeInBytes()))]
    return [x for i in range(children.length()) for x in _scans(children.apply(i))]


def estimate(df: DataFrame) -> int | None:
    """Bytes of the columns that the plan's scans read, as far as Spark knows; None where it can't tell. Nothing is run."""
    try:
        sizes = _scans(df._jdf.queryExecution().optimizedPlan())
    except Exception:  # the plan's statistics are no stable interface
        return None
    return None if max(sizes, default=0) >= UNKNOWN else sum(sizes)


#: Kinds of failure by what stands in Spark's error condition or message, the first that fits.
PROBLEMS = (
    ("missing_relation", ("TABLE_OR_VIEW_NOT_FOUND", "PATH_NOT_FOUND", "NoSuchTable", "FileNotFoundException")),
    ("missing_column", ("UNRESOLVED_COLUMN", "FIELD_NOT_FOUND", "UNRESOLVED_FIELD")),
    ("syntax", ("PARSE_SYNTAX_ERROR", "PARSE_EMPTY_STATEMENT", "ParseException")),
    ("unknown_function", ("UNRESOLVED_ROUTINE",)),
    ("wrong_type", ("DATATYPE_MISMATCH", "CAST_INVALID_INPUT", "INVALID_PARAMETER_VALUE", "CANNOT_PARSE")),
    ("no_permission", ("AccessControlException", "Permission denied", "INSUFFICIENT_PERMISSIONS", "AccessDenied")),
    ("cancelled", ("OPERATION_CANCELED", "cancelled", "interruptTag")),
    ("out_of_memory", ("OutOfMemoryError", "OUT_OF_MEMORY", "ExecutorLostFailure")),
)


def problem(error: BaseException) -> str:
    """The kind of an error: too_large, timeout, one of PROBLEMS, or other."""
    if isinstance(error, CapExceeded):
        return "too_large"
    if isinstance(error, TimeoutError):
        return "timeout"
    text = f"{type(error).__name__} {getattr(error, 'getCondition', lambda: '')() or ''} {error}"
    return next((kind for kind, marks in PROBLEMS if any(m in text for m in marks)), "other")


def missing_relation(error: Exception) -> bool:
    """Whether a query failed because a table or path is gone."""
    return isinstance(error, AnalysisException) and problem(error) == "missing_relation"


def most_recent(df: DataFrame, key: str, n: int = ROW_LIMIT, labels: tuple[str, ...] = ()) -> DataFrame:
    """The rows with the n greatest keys, in ascending order: a bound on what comes back."""
    return df.orderBy(F.col(key).desc(), *labels).limit(n).orderBy(key, *labels)


def run(df: DataFrame, limit: int = ROW_LIMIT, cap_bytes: int | None = CAP_BYTES, timeout_s: float = TIMEOUT_S) -> Result:
    """The first `limit` rows as dicts. Refuses plans that read more than cap_bytes (None: no cap), and is stopped after timeout_s."""
    size = estimate(df)
    if cap_bytes is not None and size is not None and size > cap_bytes:
        raise CapExceeded(size, cap_bytes)
    spark, tag = df.sparkSession, f"tidemark-{uuid.uuid4().hex}"
    spark.addTag(tag)
    late = threading.Event()
    clock = threading.Timer(timeout_s, lambda: (late.set(), spark.interruptTag(tag)))
    clock.start()
    try:
        return Result([r.asDict() for r in df.limit(limit).collect()], size, tag)
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"the query was stopped after {timeout_s} s") from e
        raise
    finally:
        clock.cancel()
        spark.removeTag(tag)
