"""Small helpers shared by the catalog modules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import NTZ


def rnd(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def ts_lit(text: str):
    return F.lit(text).cast(NTZ)


def sql_round(digits: int, *cols: str) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in cols)


def flag(sql: str, name: str) -> str:
    """A boolean as DOUBLE, the form ``tidy`` gives booleans."""
    return f"CAST(CAST(({sql}) AS INTEGER) AS DOUBLE) AS {name}"
