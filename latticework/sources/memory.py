"""Small graphs from rows."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from ..model import EdgeTable, PropertyGraph

_KINDS = {int: T.LongType(), float: T.DoubleType(), str: T.StringType()}


def _schema(fixed: list[str], rows: list[dict]) -> T.StructType:
    from ..functions.predicates import MIXED

    kinds: dict[str, set] = {}
    for r in rows:
        for k, v in r.items():
            kinds.setdefault(k, set()).update({type(v)} if v is not None else ())
    pick = lambda k: _KINDS[next(iter(k))] if len(k) == 1 else MIXED if k else T.StringType()
    return T.StructType([T.StructField(c, T.StringType()) for c in fixed] + [T.StructField(k, pick(kinds[k])) for k in sorted(kinds)])


def _cell(value, kind):
    if not isinstance(kind, T.StructType) or value is None:
        return value
    return (value if isinstance(value, int) else None, value if isinstance(value, float) else None, value if isinstance(value, str) else None)


def graph(spark: SparkSession, vertices: list[tuple], edges: list[tuple] = ()) -> PropertyGraph:
    """From (vid, label[, attributes]) and (eid, src, dst, label[, attributes]); values of several types under one key and
    label become a struct of i, d and s."""
    by_label: dict[str, list] = {}
    for v in vertices:
        by_label.setdefault(v[1], []).append((v[0], v[2] if len(v) > 2 else {}))
    out, label_of = {}, {v[0]: v[1] for v in vertices}
    for label, rows in by_label.items():
        s = _schema(["vid"], [a for _, a in rows])
        out[label] = spark.createDataFrame([(i, *(_cell(a.get(f.name), f.dataType) for f in s.fields[1:])) for i, a in rows], s)
    groups: dict[tuple, list] = {}
    for e in edges:
        groups.setdefault((e[3], label_of.get(e[1]), label_of.get(e[2])), []).append((e[:3], e[4] if len(e) > 4 else {}))
    tables = []
    for (label, src, dst), rows in groups.items():
        s = _schema(["eid", "src", "dst"], [a for _, a in rows])
        tables.append(EdgeTable(label, spark.createDataFrame([(*i, *(_cell(a.get(f.name), f.dataType) for f in s.fields[3:])) for i, a in rows], s), src, dst, src is not None and dst is not None))
    return PropertyGraph(spark, out, tables)
