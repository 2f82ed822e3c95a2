"""The form in which queries leave: days as text, counts as long, sums rounded to six places; the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.views import SQL


def tidy(df: DataFrame) -> DataFrame:
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("date", "timestamp"):
            c = c.cast("string")
        elif kind in ("double", "float"):
            c = F.round(c.cast("double"), 6) + 0.0  # no negative zero
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        out.append(c.alias(name))
    return df.select(out)


def sql(views: str, columns: str, body: str) -> str:
    """SQL over the named views (body may begin with further common tables, `name as (...),`). columns: names with :d for days, :f for doubles, :i for longs."""
    chosen = []
    for c in columns.split():
        name, _, kind = c.partition(":")
        chosen.append({"d": f"cast({name} as varchar) as {name}", "f": f"round(cast({name} as double), 6) + 0.0 as {name}", "i": f"cast({name} as bigint) as {name}"}.get(kind, name))
    head = [SQL[v] for v in views.split()]
    extra, _, last = body.strip().rpartition(";;")
    if extra.strip():
        head.append(extra.strip())
    return ("with " + ",\n".join(head) + "\n" if head else "") + f"select {', '.join(chosen)} from ({last.strip()}) t"
