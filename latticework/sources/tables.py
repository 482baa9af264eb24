"""The property graph over the relational tables: narrow selects, so filters and columns reach the Parquet scans."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import vid
from ..model import EdgeTable, Frames, PropertyGraph

#: label -> table, key, {attribute: column}
VERTICES = {
    "Region": ("region", "r_regionkey", {"name": "r_name"}),
    "Nation": ("nation", "n_nationkey", {"name": "n_name"}),
    "Customer": ("customer", "c_custkey", {"name": "c_name", "acctbal": "c_acctbal", "mktsegment": "c_mktsegment"}),
    "Supplier": ("supplier", "s_suppkey", {"name": "s_name", "acctbal": "s_acctbal"}),
    "Part": ("part", "p_partkey", {"name": "p_name", "brand": "p_brand", "type": "p_type", "size": "p_size", "retailprice": "p_retailprice"}),
    "Order": ("orders", "o_orderkey", {"status": "o_orderstatus", "totalprice": "o_totalprice", "orderdate": "o_orderdate", "priority": "o_orderpriority"}),
    "Event": ("events", "event_id", {"ts": "ts", "type": "event_type", "value": "value"}),
}
_LINE = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax", "lineNumber": "l_linenumber", "returnFlag": "l_returnflag", "lineStatus": "l_linestatus", "shipDate": "l_shipdate"}
#: label, source label, target label, table, source key, target key, {attribute: column}
EDGES = [
    ("isPartOf", "Nation", "Region", "nation", "n_nationkey", "n_regionkey", {}),
    ("isLocatedIn", "Customer", "Nation", "customer", "c_custkey", "c_nationkey", {}),
    ("isLocatedIn", "Supplier", "Nation", "supplier", "s_suppkey", "s_nationkey", {}),
    ("placedBy", "Order", "Customer", "orders", "o_orderkey", "o_custkey", {}),
    ("triggeredBy", "Event", "Customer", "events", "event_id", "user_id", {}),
    ("contains", "Order", "Part", "lineitem", "l_orderkey", "l_partkey", _LINE),
    ("suppliedBy", "Order", "Supplier", "lineitem", "l_orderkey", "l_suppkey", _LINE),
]
#: what tells two edges of one pair apart: a line's other keys
LINE_KEY = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


def attribute(df: DataFrame, column: str) -> Column:
    """Timestamps as epoch milliseconds (zone-less ones are read as UTC), integers as long."""
    kind = dict(df.dtypes)[column]
    if kind == "timestamp_ntz":
        return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(column))
    if kind == "timestamp":
        return F.unix_millis(column)
    return F.col(column).cast("long") if kind in ("int", "bigint", "smallint", "tinyint") else F.col(column)


def edge_parts(df: DataFrame, src: str, dst: str, table: str) -> list[Column]:
    """What an edge's id is made of: the ends' keys, or a line's own keys and its date."""
    if table == "lineitem":
        return [*(F.col(c) for c in LINE_KEY), attribute(df, "l_shipdate").alias("l_shipdate")]
    return [F.col(src), F.col(dst)]


def edge_id(label: str, parts: list[Column]) -> Column:
    return F.concat_ws(":", F.lit(label), *(p.cast("string") for p in parts))


def graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The graph over the tables of a folder, each opened when a query first needs it."""
    opened: dict[str, DataFrame] = {}

    def table(name: str) -> DataFrame:
        if name not in opened:
            opened[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return opened[name]

    def vertices(label: str) -> DataFrame:
        name, key, attrs = VERTICES[label]
        df = table(name)
        return df.select(vid(label, key).alias("vid"), F.col(key).cast("long").alias("id"), *(attribute(df, c).alias(a) for a, c in attrs.items()))

    def edges(keyed: bool, label: str, src: str, dst: str, name: str, a: str, b: str, attrs: dict[str, str]) -> DataFrame:
        df = table(name).filter(F.col(a).isNotNull() & F.col(b).isNotNull())
        parts = edge_parts(df, a, b, name)
        if keyed:  # nothing is rendered before the joins
            ids = (F.struct(*(p.alias(f"k{i}") for i, p in enumerate(parts))).alias("eid"), F.col(a).cast("long").alias("src"), F.col(b).cast("long").alias("dst"))
        else:
            ids = (edge_id(label, parts).alias("eid"), vid(src, a).alias("src"), vid(dst, b).alias("dst"))
        return df.select(*ids, *(attribute(df, c).alias(x) for x, c in attrs.items()))

    def render(label: str, name: str, eid: Column) -> Column:
        return edge_id(label, [eid[f"k{i}"] for i in range(len(LINE_KEY) + 1 if name == "lineitem" else 2)])

    made = [EdgeTable(e[0], partial(edges, False, *e), e[1], e[2], True, partial(edges, True, *e), partial(render, e[0], e[3])) for e in EDGES]
    return PropertyGraph(spark, Frames({k: partial(vertices, k) for k in VERTICES}), made, "id")
