"""Label and attribute statistics, each from one or two aggregates over the frames."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import PropertyGraph

BINS = 10


def label_counts(g: PropertyGraph) -> DataFrame:
    """(kind, label, n): every label once, over all its frames."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit("vertex").alias("kind"), F.lit(label).alias("label"), "n") for label, df in g.vertices.items()]
    parts += [t.frame.agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), F.lit(t.label).alias("label"), "n") for t in g.edges]
    if not parts:
        return g.spark.createDataFrame([], "kind string, label string, n long")
    return reduce(DataFrame.unionByName, parts).groupBy("kind", "label").agg(F.sum("n").alias("n"))


def label_statistics(g: PropertyGraph) -> dict:
    """The counts as a driver-side dictionary: a row for each label."""
    out: dict = {"v_cnt": 0, "e_cnt": 0, "v_label_cnt": {}, "e_label_cnt": {}}
    for r in sorted(label_counts(g).collect(), key=lambda r: (r.kind, r.label)):
        side = "v" if r.kind == "vertex" else "e"
        out[f"{side}_cnt"] += r.n
        out[f"{side}_label_cnt"][r.label] = r.n
    return out


def statistics_json(stats: dict) -> str:
    return json.dumps(stats, indent=2, sort_keys=True)


def attribute_summary(df: DataFrame, attribute: str) -> DataFrame:
    """One row: attr, n_rows, n_values, n_nulls, n_distinct, min_value, max_value (numbers as double, null for texts), and the
    selectivities of = and !=, taken as 1 / n_distinct and its complement."""
    c = F.col(f"`{attribute}`")
    numeric = isinstance(df.schema[attribute].dataType, T.NumericType)
    edge = (lambda f: f(c).cast("double")) if numeric else (lambda f: F.lit(None).cast("double"))
    out = df.agg(F.count("*").alias("n_rows"), F.count(c).alias("n_values"), F.count_distinct(c).alias("n_distinct"), edge(F.min).alias("min_value"), edge(F.max).alias("max_value"))
    eq = F.when(F.col("n_distinct") > 0, 1 / F.col("n_distinct"))
    return out.select(F.lit(attribute).alias("attr"), "n_rows", "n_values", (F.col("n_rows") - F.col("n_values")).alias("n_nulls"), "n_distinct", "min_value", "max_value", eq.alias("sel_eq"), (1 - eq).alias("sel_ne"))


def histogram(df: DataFrame, attribute: str, bins: int = BINS) -> DataFrame:
    """(bin, low, high, n, sel_le): at most ``bins`` equal-width bins, the last closed, with the share of all rows up to each bin's end.

    A single distinct value is one bin. Bins without rows are not listed."""
    x = df.select(F.col(f"`{attribute}`").cast("double").alias("x"))
    ends = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("rows"), F.count_distinct("x").alias("ndv"))
    both = x.filter("x is not null").crossJoin(F.broadcast(ends))  # one row of bounds
    width = (F.col("hi") - F.col("lo")) / F.least(F.lit(bins), F.col("ndv"))
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("x") - F.col("lo")) / width), F.least(F.lit(bins), F.col("ndv")) - 1)).otherwise(0).cast("int")
    counted = both.groupBy(place.alias("bin"), "lo", "hi", "rows", "ndv").agg(F.count("*").alias("n"))
    w = F.col("hi") - F.col("lo")
    k = F.least(F.lit(bins), F.col("ndv"))
    running = F.sum("n").over(Window.orderBy("bin"))  # at most ``bins`` rows
    return counted.select("bin", (F.col("lo") + F.col("bin") * w / k).alias("low"), F.when(F.col("bin") == k - 1, F.col("hi")).otherwise(F.col("lo") + (F.col("bin") + 1) * w / k).alias("high"), "n", (running / F.col("rows")).alias("sel_le"))


def value_counts(df: DataFrame, attribute: str) -> DataFrame:
    return df.filter(F.col(f"`{attribute}`").isNotNull()).groupBy(F.col(f"`{attribute}`").alias("value")).agg(F.count("*").alias("n"))


def attribute_statistics(g: PropertyGraph) -> DataFrame:
    """``attribute_summary`` of every attribute of every label, with kind and label."""
    parts = []
    for label, df in g.vertices.items():
        parts += [attribute_summary(df, a).select(F.lit("vertex").alias("kind"), F.lit(label).alias("label"), "*") for a in df.columns if a != "vid" and not isinstance(df.schema[a].dataType, T.StructType)]
    for t in g.edges:
        parts += [attribute_summary(t.frame, a).select(F.lit("edge").alias("kind"), F.lit(t.label).alias("label"), "*") for a in t.frame.columns if a not in ("eid", "src", "dst") and not isinstance(t.frame.schema[a].dataType, T.StructType)]
    return reduce(DataFrame.unionByName, parts)


def frequent_sets(sets: DataFrame, column: str, min_count: int = 2) -> DataFrame:
    """Frequent item sets of an array column with at least ``min_count`` occurrences: (items, freq)."""
    from pyspark.ml.fpm import FPGrowth

    n = max(1, sets.count())
    found = FPGrowth(itemsCol=column, minSupport=min(1.0, min_count / n)).fit(sets.select(F.array_distinct(column).alias(column))).freqItemsets
    return found.filter(F.col("freq") >= min_count).select(F.sort_array("items").alias("items"), "freq")
