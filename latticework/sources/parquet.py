"""Graphs as Parquet: ``v/<label>/`` and ``e/<source label>_<label>_<target label>/``, with a small manifest."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from ..model import EdgeTable, PropertyGraph


def save(g: PropertyGraph, path: str, mode: str = "error") -> None:
    """Edges are written sorted by source within their partitions, so that row groups can be skipped on ``src``."""
    about = {"vertices": sorted(g.vertices), "edges": []}
    for label, df in g.vertices.items():
        df.write.mode(mode).parquet(f"{path}/v/{label}")
    for k, t in enumerate(g.edges):
        name = f"{t.src_label or 'any'}_{t.label}_{t.dst_label or 'any'}-{k}"
        t.frame.repartition("src").sortWithinPartitions("src", "dst").write.mode(mode).parquet(f"{path}/e/{name}")
        about["edges"].append({"name": name, "label": t.label, "src": t.src_label, "dst": t.dst_label, "integrity": t.integrity})
    g.spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.mode(mode).json(f"{path}/manifest")


def load(spark: SparkSession, path: str) -> PropertyGraph:
    about = json.loads(spark.read.schema("about string").json(f"{path}/manifest").first().about)
    vertices = {label: spark.read.parquet(f"{path}/v/{label}") for label in about["vertices"]}
    return PropertyGraph(spark, vertices, [EdgeTable(e["label"], spark.read.parquet(f"{path}/e/{e['name']}"), e["src"], e["dst"], e["integrity"]) for e in about["edges"]])
