"""Settings of a report that are kept between sessions: a JSON file that the session's file system can reach."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import SparkSession

#: Settings with their defaults; a value must be of the default's type, and one of CHOICES where there are any.
DEFAULTS: dict[str, Any] = {"timezone": "UTC", "week_start": "monday", "hour_style": "24", "decimal": ".", "grain": "day", "top_n": 8, "exact": False, "row_limit": 1_000_000, "scan_cap_bytes": 10 << 30}
CHOICES = {"week_start": ("monday", "sunday"), "hour_style": ("12", "24"), "decimal": (".", ","), "grain": ("hour", "day", "week", "month", "day_of_week", "hour_of_day")}


class Preferences:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _file(self):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def all(self) -> dict[str, Any]:
        """Every setting; what is stored but unknown or unfit is left out, so that an old file never stops a report."""
        fs, p = self._file()
        stored = json.loads(self.spark.read.text(p.toString(), wholetext=True).first()[0]) if fs.exists(p) else {}
        return DEFAULTS | {k: v for k, v in stored.items() if k in DEFAULTS and self.fault(k, v) is None}

    @staticmethod
    def fault(key: str, value: Any) -> str | None:
        if key not in DEFAULTS:
            return f"there is no setting {key}"
        if type(value) is not type(DEFAULTS[key]) or type(value) is int and value < 1:
            return f"{key} doesn't take {value!r}"
        return None if value in CHOICES.get(key, (value,)) else f"{key} is one of {CHOICES[key]}"

    def set(self, **values: Any) -> dict[str, Any]:
        """Stores settings, all or none, and gives all that hold then."""
        if faults := [f for k, v in values.items() if (f := self.fault(k, v))]:
            raise ValueError("; ".join(faults))
        fs, p = self._file()
        now = self.all() | values
        out = fs.create(p, True)
        out.write(bytearray(json.dumps({k: v for k, v in now.items() if v != DEFAULTS[k]}).encode()))
        out.close()
        return now

    def form(self, form: dict[str, Any]) -> dict[str, Any]:
        """A form with the settings where it says nothing itself."""
        own = self.all()
        return {k: own[k] for k in ("timezone", "week_start", "grain", "top_n", "exact", "row_limit")} | form
