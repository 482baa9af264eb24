"""The property graph: one typed frame for each vertex label, and one for each edge label between two vertex labels."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.predicates import apply
from .pattern import Pred


class Frames(Mapping):
    """Frames by label, made on first use: a query opens only the tables that it reads."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]):
        self._makers, self._made = makers, {}

    def __getitem__(self, label: str) -> DataFrame:
        if label not in self._made:
            self._made[label] = self._makers[label]()
        return self._made[label]

    def __iter__(self):
        return iter(self._makers)

    def __len__(self):
        return len(self._makers)


@dataclass
class EdgeTable:
    """Edges of one label. Where both end labels are given and ``integrity`` holds, every end is known to be a vertex of that label."""

    label: str
    source: DataFrame | Callable[[], DataFrame]  # eid, src, dst, attributes
    src_label: str | None = None
    dst_label: str | None = None
    integrity: bool = True
    #: the same edges with the ends' keys in place of ids (``src``, ``dst``) and an ``eid`` that ``render`` turns into the id
    keyed: Callable[[], DataFrame] | None = None
    render: Callable[[Column], Column] | None = None

    @property
    def frame(self) -> DataFrame:
        if not isinstance(self.source, DataFrame):
            self.source = self.source()
        return self.source

    def fits(self, src: str | None, dst: str | None) -> bool:
        return (None in (src, self.src_label) or src == self.src_label) and (None in (dst, self.dst_label) or dst == self.dst_label)

    def typed(self, side: str) -> bool:
        return self.integrity and (self.src_label if side == "src" else self.dst_label) is not None


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


@dataclass
class PropertyGraph:
    spark: SparkSession
    vertices: Mapping[str, DataFrame] = field(default_factory=dict)  # label -> vid, attributes
    edges: list[EdgeTable] = field(default_factory=list)
    #: the column of every vertex frame that holds its key, where ids are "<label>^<key>" with keys of 64 bits
    key: str | None = None

    def vertices_of(self, label: str, preds: tuple[Pred, ...] = ()) -> DataFrame:
        """All vertices of a label (an empty frame if there is none) on which the predicates hold."""
        df = self.vertices.get(label)
        return apply(self.spark.createDataFrame([], "vid string") if df is None else df, preds)

    def vertex(self, vid: str) -> DataFrame:
        """The vertex with this id, with its label, in a frame of one row or none."""
        label, _, raw = vid.partition("^")
        if self.key and label in self.vertices and raw.removeprefix("-").isdecimal() and abs(int(raw)) < 1 << 63:
            # the id names its label and key, so one table is opened and the filter on the key reaches its scan
            df = self.vertices[label]
            return df.filter((F.col(self.key) == int(raw)) & (F.col("vid") == vid)).withColumn("label", F.lit(label))
        found = [df.filter(F.col("vid") == vid).withColumn("label", F.lit(label)) for label, df in self.vertices.items()]
        return _union(found) if found else self.spark.createDataFrame([], "vid string, label string")

    def all_vertices(self) -> DataFrame:
        """(vid, label) of every vertex."""
        rows = [df.select("vid", F.lit(label).alias("label")) for label, df in self.vertices.items()]
        return _union(rows) if rows else self.spark.createDataFrame([], "vid string, label string")

    def tables_of(self, label: str, src: str | None = None, dst: str | None = None) -> list[EdgeTable]:
        return [t for t in self.edges if t.label == label and t.fits(src, dst)]

    def edges_of(self, label: str, src: str | None = None, dst: str | None = None, preds: tuple[Pred, ...] = ()) -> DataFrame:
        """Edges of a label that may run between the two vertex labels, on which the predicates hold."""
        frames = [apply(t.frame, preds) for t in self.tables_of(label, src, dst)]
        return _union(frames) if frames else self.spark.createDataFrame([], "eid string, src string, dst string")

    def ends_known(self, label: str, src: str, dst: str, side: str) -> bool:
        """Whether every such edge's end on that side is known to be a vertex of the label asked for."""
        return all(t.typed(side) for t in self.tables_of(label, src, dst))
