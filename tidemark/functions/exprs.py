"""Columns from expressions, and the few shapes that several operators need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.specs import Expr

#: Before the names of columns that operators add; a source with such a column is refused.
PRIVATE = "__tm_"


def col(e: Expr) -> Column:
    return F.expr(e) if isinstance(e, str) else e


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def refuse(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """df, unless it has a column that an operator derives and expressions couldn't tell from it."""
    have = {c.lower() for c in df.columns}
    clash = sorted(n for n in names if n.lower() in have) or sorted(c for c in df.columns if c.lower().startswith(PRIVATE))
    if clash:
        raise ValueError(f"the source has columns of these names, which are derived: {', '.join(clash)}")
    return df


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def json_value(column: Expr, path: str) -> Column:
    """The scalar at a path such as a.b in JSON text; null for objects, arrays and what isn't there."""
    steps = "".join(f"['{p}']" for p in path.split("."))
    found = F.get_json_object(col(column), "$" + steps)
    return F.when(~F.coalesce(found.startswith("{") | found.startswith("["), F.lit(False)), found)


def json_number(column: Expr, path: str) -> Column:
    return json_value(column, path).try_cast("double")


def null_safe(left: list[Column], right: list[Column]) -> Column:
    out = F.lit(True)
    for a, b in zip(left, right, strict=True):
        out = out & a.eqNullSafe(b)
    return out


def grid(n: int) -> Column:
    """0 to n, both included, as a generator."""
    if n < 0:
        raise ValueError("a grid needs n of 0 or more")
    return F.explode(F.sequence(F.lit(0), F.lit(n)))
