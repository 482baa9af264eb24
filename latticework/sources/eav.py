"""Entity-attribute-value tables: vertices (vid, label), edges (eid, label, src_vid, dst_vid) and attribute rows (owner, key, value, type)
with types int, float and string, as frames or in an SQLite file."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import typed
from ..model import EdgeTable, PropertyGraph

# Table and column names of the interchange files.
TABLES = {
    "db_vertex": "vid string, label string",
    "db_edge": "eid string, label string, src_vid string, dst_vid string",
    "vertex_attribute": "vid string, key string, value string, type string",
    "edge_attribute": "eid string, key string, value string, type string",
}


def assemble(owners: DataFrame, attributes: DataFrame, owner: str, keys: list[tuple[str, str]]) -> DataFrame:
    """The owners with a column for each (key, type) of ``keys``; a key listed with several types becomes a struct of i, d and s. Owners
    without attributes stay, with nulls. One aggregate by owner, which combines before the shuffle."""
    def value(k: str, t: str):
        return F.max(F.when((F.col("key") == k) & (F.col("type") == t), typed(F.col("value"), t)))

    by_key: dict[str, list[str]] = {}
    for k, t in keys:
        by_key.setdefault(k, []).append(t)
    if not by_key:
        return owners
    cols = []
    for k, types in sorted(by_key.items()):
        if len(types) == 1:
            cols.append(value(k, types[0]).alias(k))
        else:
            i, d, s = (value(k, t) if t in types else F.lit(None).cast(kind) for t, kind in (("int", "long"), ("float", "double"), ("string", "string")))
            cols.append(F.when(F.coalesce(i.isNotNull() | d.isNotNull() | s.isNotNull(), F.lit(False)), F.struct(i.alias("i"), d.alias("d"), s.alias("s"))).alias(k))
    return owners.join(attributes.groupBy(owner).agg(*cols), owner, "left")


def graph(spark: SparkSession, vertex: DataFrame, edge: DataFrame, vertex_attribute: DataFrame, edge_attribute: DataFrame) -> PropertyGraph:
    """Labels, keys and types are read first (a row for each); values come from joins."""
    def shape(owners, attributes, owner):
        out = {r.label: [] for r in owners.select("label").distinct().collect()}
        for r in attributes.join(owners.select(owner, "label"), owner).select("label", "key", "type").distinct().collect():
            out[r.label].append((r.key, r.type))
        return out

    vertices = {}
    for label, keys in shape(vertex, vertex_attribute, "vid").items():
        vertices[label] = assemble(vertex.filter(F.col("label") == label).select("vid"), vertex_attribute, "vid", keys)
    tables = []
    for label, keys in shape(edge, edge_attribute, "eid").items():
        own = edge.filter(F.col("label") == label).select("eid", F.col("src_vid").alias("src"), F.col("dst_vid").alias("dst"))
        tables.append(EdgeTable(label, assemble(own, edge_attribute, "eid", keys), integrity=False))
    return PropertyGraph(spark, vertices, tables)


def read_sqlite(spark: SparkSession, path: str, rows: int = 50_000) -> PropertyGraph:
    """A graph from an SQLite file of this form, read on the driver in slices: an adapter for small interchange files."""
    def slices(table: str) -> Iterator[list]:
        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
            cursor = db.execute(f"SELECT {', '.join(c.split()[0] for c in TABLES[table].split(', '))} FROM {table}")
            while part := cursor.fetchmany(rows):
                yield part

    def frame(table: str) -> DataFrame:
        out = spark.createDataFrame([], TABLES[table])
        for part in slices(table):
            out = out.unionByName(spark.createDataFrame(part, TABLES[table]))
        return out

    return graph(spark, *(frame(t) for t in TABLES))


def write_sqlite(path: str, g: PropertyGraph) -> None:
    """The reverse, row by row through the driver's iterator: for small graphs."""
    kinds = {"bigint": "int", "int": "int", "double": "float", "string": "string"}
    with sqlite3.connect(path) as db:
        for table, columns in TABLES.items():
            db.execute(f"DROP TABLE IF EXISTS {table}")
            key = "id INTEGER PRIMARY KEY, " if table.endswith("attribute") else ""
            db.execute(f"CREATE TABLE {table} ({key}{', '.join(c.split()[0] + ' TEXT' for c in columns.split(', '))})")

        def attributes(table, owner, df, row):
            for name, kind in df.dtypes:
                if kind in kinds and name not in ("vid", "eid", "src", "dst") and row[name] is not None:
                    db.execute(f"INSERT INTO {table} ({owner}, key, value, type) VALUES (?, ?, ?, ?)", (row[owner], name, str(row[name]), kinds[kind]))

        for label, df in g.vertices.items():
            for r in df.toLocalIterator():
                db.execute("INSERT INTO db_vertex VALUES (?, ?)", (r.vid, label))
                attributes("vertex_attribute", "vid", df, r)
        for t in g.edges:
            for r in t.frame.toLocalIterator():
                db.execute("INSERT INTO db_edge VALUES (?, ?, ?, ?)", (r.eid, t.label, r.src, r.dst))
                attributes("edge_attribute", "eid", t.frame, r)
