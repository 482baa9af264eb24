"""Match results as texts: "(:Label id)" and "[:Label]", or with attributes "(:Label {key: value, ...})"."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..pattern import Pattern


def attribute_text(df: DataFrame, attributes: list[str]) -> Column:
    """``{k: v, ...}`` of the non-null attributes in order of their names; texts stand in quotes."""
    parts = []
    for a in sorted(attributes):
        c, kind = F.col(f"`{a}`"), df.schema[a].dataType
        if isinstance(kind, T.StructType):
            c, quoted = F.coalesce(c["i"].cast("string"), c["d"].cast("string"), F.concat(F.lit('"'), c["s"], F.lit('"'))), False
        else:
            quoted = isinstance(kind, T.StringType)
        value = F.concat(F.lit('"'), c, F.lit('"')) if quoted else c.cast("string")
        parts.append(F.when(value.isNotNull(), F.concat(F.lit(f"{a}: "), value)))
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")) if parts else F.lit("{}")


def simplified(matches: DataFrame, pattern: Pattern) -> DataFrame:
    """One text column for each pattern id, vertices first, each in order of the ids."""
    cols = [F.concat(F.lit(f"(:{pattern.vertices[v].label} "), f"`v_{v}`", F.lit(")")).alias(v) for v in sorted(pattern.vertices)]
    cols += [F.when(F.col(f"`e_{e}`").isNotNull(), F.lit(f"[:{pattern.edges[e].label}]")).alias(e) for e in sorted(pattern.edges)]
    return matches.select(cols)


def detailed(matches: DataFrame, pattern: Pattern, graph) -> DataFrame:
    """Like ``simplified`` with all attributes; they are fetched after matching, by one join for each pattern id."""
    out = matches
    for v, p in sorted(pattern.vertices.items()):
        table = graph.vertices_of(p.label)
        text = F.concat(F.lit(f"(:{p.label} "), attribute_text(table, [c for c in table.columns if c != "vid"]), F.lit(")"))
        out = out.join(table.select(F.col("vid").alias(f"v_{v}"), text.alias(v)), f"v_{v}")
    for e, p in sorted(pattern.edges.items()):
        table = graph.edges_of(p.label, pattern.vertices[p.src].label, pattern.vertices[p.dst].label)
        text = F.concat(F.lit(f"[:{p.label} "), attribute_text(table, [c for c in table.columns if c not in ("eid", "src", "dst")]), F.lit("]"))
        out = out.join(table.select(F.col("eid").alias(f"e_{e}"), text.alias(e)), f"e_{e}")
    return out.select(*(f"`{v}`" for v in sorted(pattern.vertices)), *(f"`{e}`" for e in sorted(pattern.edges)))
