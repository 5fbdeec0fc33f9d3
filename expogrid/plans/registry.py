"""The table of registered queries and their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

COUNTED = re.compile(r"(^|_)(members|units|weight|qty|qty_o|qty_f|total)$|^qty|^[a-e]0_(s\d|students|boys|girls)$")


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Comparable values: doubles rounded (no negative zero), whole numbers and flags as long."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegralType, T.BooleanType)):
            c = c.cast("long")
        elif COUNTED.search(f.name) and not isinstance(f.dataType, T.StringType):
            # sums of whole weights are whole; anything else is an error and must show
            c = F.when(c == F.floor(c), c.cast("long")).when(c.isNotNull(), F.raise_error(F.lit(f"{f.name} holds a value that is not whole")).cast("long"))
        elif isinstance(f.dataType, T.DoubleType):
            c = F.round(c, digits) + F.lit(0.0)
        out.append(c.alias(f.name))
    return df.select(*out)


QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None, digits: int = 6):
    def wrap(f: Query) -> Query:
        QUERIES[name] = lambda spark, folder: tidy(f(spark, folder), digits)
        if sql is not None:
            ORACLES[name] = sql
        return f
    return wrap
