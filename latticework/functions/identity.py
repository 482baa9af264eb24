"""Vertex and edge ids, and typed reading of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def vid(scope: str, key: str | Column) -> Column:
    """"<Scope>^<raw id>"."""
    return F.concat(F.lit(f"{scope}^"), (F.col(key) if isinstance(key, str) else key).cast("string"))


def with_edge_ids(edges: DataFrame, label: str) -> DataFrame:
    """Adds ``eid`` = "<label>: <src> -> <dst> @ <n>", n counting the edges of an ordered pair from 0 in the order of all other columns.

    The ordinal is taken within (src, dst), so its sort is as distributed as the pairs are."""
    rest = [F.col(f"`{c}`") for c in edges.columns if c not in ("src", "dst")]
    n = F.row_number().over(Window.partitionBy("src", "dst").orderBy(*(rest or [F.lit(1)]))) - 1
    return edges.withColumn("eid", F.concat(F.lit(f"{label}: "), "src", F.lit(" -> "), "dst", F.lit(" @ "), n.cast("string")))


#: Types of typed headers and of attribute rows.
TYPES = {"int": "bigint", "long": "bigint", "float": "double", "double": "double", "string": "string"}


def typed(column: Column, kind: str) -> Column:
    """A text read as one of TYPES; what cannot be read is null."""
    target = TYPES[kind]
    return column if target == "string" else column.try_cast(target)
