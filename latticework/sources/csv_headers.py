"""Pipe-separated files with typed headers.

Node files: first column ``:ID(<Scope>)``, attributes ``name``, ``name:int``, ``name:long`` or ``name:float``, and ``:LABEL``. Relationship files:
``:START_ID(<Scope>)``, ``:END_ID(<Scope>)``, attributes, ``:TYPE``. Null cells stay null. ``normalised_*`` turn raw headers into this form."""

from __future__ import annotations

import re
from functools import reduce
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import typed, vid, with_edge_ids
from ..model import EdgeTable, PropertyGraph

#: Raw attributes that hold 64-bit numbers.
LONG_ATTRIBUTES = ("birthday", "classYear", "creationDate", "joinDate", "length")


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, under their header names (Spark numbers names that repeat)."""
    return spark.read.csv(path, sep="|", header=True, inferSchema=False)


def capital(word: str) -> str:
    return word[:1].upper() + word[1:]


def file_words(path: str) -> list[str]:
    """The words of a file's name without its part numbers: ``person_knows_person_0_0.csv`` gives three."""
    return re.sub(r"(_\d+)*\.csv.*$", "", PurePosixPath(path).name).split("_")


def _suffixed(name: str) -> str:
    return f"{name}:long" if name in LONG_ATTRIBUTES else name


def normalised_nodes(raw: DataFrame, path: str) -> DataFrame:
    """Raw nodes: the first column becomes ``:ID(<Scope>)`` and ``id:long``; a ``type`` column becomes ``:LABEL`` in title case, else the
    file's first word is the label."""
    scope = capital(file_words(path)[0])
    first, *rest = raw.columns
    cols = [F.col(f"`{first}`").alias(f":ID({scope})"), F.col(f"`{first}`").alias("id:long")]
    cols += [F.col(f"`{c}`").alias(_suffixed(c)) for c in rest if c != "type"]
    return raw.select(*cols, (F.initcap("type") if "type" in rest else F.lit(scope)).alias(":LABEL"))


def normalised_edges(raw: DataFrame, path: str) -> DataFrame:
    """Raw relationships: the first two columns become the ends, the file's second word the type."""
    src, label, dst = (file_words(path) + ["", ""])[:3]
    a, b, *rest = raw.columns
    return raw.select(F.col(f"`{a}`").alias(f":START_ID({capital(src)})"), F.col(f"`{b}`").alias(f":END_ID({capital(dst)})"), *(F.col(f"`{c}`").alias(_suffixed(c)) for c in rest), F.lit(label).alias(":TYPE"))


def _attributes(df: DataFrame, names: list[str]) -> list:
    out = []
    for c in names:
        name, _, kind = c.partition(":")
        out.append(typed(F.col(f"`{c}`"), kind or "string").alias(name))
    return out


def _scope(header: str) -> str:
    m = re.fullmatch(r":(?:ID|START_ID|END_ID)\((.*)\)", header)
    if not m:
        raise ValueError(f"{header!r} is no id header")
    return m[1]


def nodes(df: DataFrame) -> DataFrame:
    """(vid, label, attributes) of a normalised node frame."""
    first, *rest = df.columns
    return df.select(vid(_scope(first), F.col(f"`{first}`")).alias("vid"), F.col("`:LABEL`").alias("label"), *_attributes(df, [c for c in rest if c != ":LABEL"]))


def edges(df: DataFrame) -> tuple[DataFrame, str, str]:
    """((src, dst, label, attributes), source scope, target scope) of a normalised relationship frame."""
    a, b, *rest = df.columns
    frame = df.select(vid(_scope(a), F.col(f"`{a}`")).alias("src"), vid(_scope(b), F.col(f"`{b}`")).alias("dst"), F.col("`:TYPE`").alias("label"), *_attributes(df, [c for c in rest if c != ":TYPE"]))
    return frame, _scope(a), _scope(b)


def graph(spark: SparkSession, node_files: list[str], edge_files: list[str], raw: bool = False) -> PropertyGraph:
    """A graph over the files; ``raw`` headers are normalised first. Labels are read from the files (a few values for each node file)."""
    by_label: dict[str, list[DataFrame]] = {}
    labels_of: dict[str, list[str]] = {}
    for path in node_files:
        df = read_raw(spark, path)
        df = nodes(normalised_nodes(df, path) if raw else df)
        found = [r.label for r in df.select("label").distinct().collect()]
        scope = capital(file_words(path)[0])
        labels_of.setdefault(scope, []).extend(found)
        for label in found:
            by_label.setdefault(label, []).append(df.filter(F.col("label") == label).drop("label"))
    vertices = {k: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), v) for k, v in by_label.items()}
    tables = []
    for path in edge_files:
        df = read_raw(spark, path)
        frame, src, dst = edges(normalised_edges(df, path) if raw else df)
        ends = [labels_of.get(s, []) for s in (src, dst)]
        for label in [r.label for r in frame.select("label").distinct().collect()]:
            own = with_edge_ids(frame.filter(F.col("label") == label).drop("label"), label)
            # a scope of one label types the edge's end; files do not promise that every end exists
            tables.append(EdgeTable(label, own, *(e[0] if len(e) == 1 else None for e in ends), integrity=False))
    return PropertyGraph(spark, vertices, tables)
