"""Near copies by overlap of word shingles: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

First by SimHash, as in ``simhash.py`` but over five-word shingles: texts whose fingerprints are equal or linked by the pigeonring search are
candidates (of a fingerprint's links three, so that a large group needs no pairs of all with all), and those whose sets overlap by 0.8 are joined.

Three bits pass over most pairs near 0.8, so the texts that are still apart are compared where they share one of ``BANDS`` keys, each made from ``ROWS``
min hashes: a pair at exactly 0.8 is missed with probability (1 - 0.8^4)^40 = 7e-10, a closer one less often. Every candidate is
decided by the exact overlap of the sets.

Texts with equal sets are one node. Within a key all nodes are first compared with three of their number, among them the one
that meets most others, which in a group of copies is close to the text they were made from. Nodes whose key is still split between components after
that are searched exactly, by prefix filtering: shingles in order of rarity, pairs by a shared one among the first fifth of both, at
places that still allow the overlap. Of each shingle's nodes those of its largest component are only looked up, not compared with
each other, so a large group of near copies needs no pairs of all with all.

Defined results: words as in ``simhash.py``; a text of fewer than five words is one shingle; null and word-less texts equal each
other and nothing else; repeated rows each get a row; a null id never names a component unless all ids in it are null; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, id_and_text, ship
from .components import connected_components
from .simhash import pigeonring_links, text_fingerprint

SHINGLE = 5
BANDS, ROWS = 40, 4
_NO_ID = (1 << 63) - 1
_CHUNK = 2048
_MIX = np.random.default_rng(42).integers(0, 1 << 63, (2, BANDS * ROWS, 1), np.uint64)
_FLIP, _TIMES = _MIX[0], _MIX[1] << np.uint64(1) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(raw: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a UTF-8 text's word shingles, in order."""
    words = raw.lower().split()  # as in text_fingerprint
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    w = np.fromiter(map(digest, words), np.uint64, len(words))
    n = max(1, len(w) - shingle + 1)
    h = np.zeros(n, np.uint64)
    for k in range(min(shingle, len(w))):
        h = h * _STEP + w[k : k + n]
        h ^= h >> np.uint64(29)
    return np.unique(h)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key for each band; none for an empty set."""
    if not len(hashes):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), _CHUNK):
        np.minimum(least, ((hashes[i : i + _CHUNK] ^ _FLIP) * _TIMES).min(axis=1), out=least)
    rows = least.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = (key ^ rows[:, k]) * _STEP
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def _hashed(name: str, of, printed: bool):
    """doc_id, node and a list of integers made from each text's set; with ``printed`` also the text's SimHash fingerprint."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                sets = [shingle_set(x.as_py()) for x in b.column("text").cast(pa.binary())]
                nodes = np.fromiter((xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets), np.uint64, len(sets)).view(np.int64)
                columns = {"doc_id": b.column("doc_id"), "node": pa.array(nodes), name: pa.array([of(s).view(np.int64) for s in sets], pa.list_(pa.int64()))}
                if printed:
                    fp = np.fromiter((text_fingerprint(x.as_py(), SHINGLE) for x in b.column("text").cast(pa.binary())), np.uint64, len(sets))
                    columns["fp"] = pa.array(fp.view(np.int64))
                yield pa.RecordBatch.from_pydict(columns)

    return run


def _with(docs: DataFrame, name: str, of, printed: bool = False) -> DataFrame:
    return docs.mapInArrow(_hashed(name, of, printed), f"doc_id long, node long, {name} array<long>" + ", fp long" * printed)


def _ordered(x: str, y: str) -> tuple[Column, Column]:
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _print_pairs(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of ``nodes(node, fp)`` by fingerprint: each with the first of its own fingerprint, and the first ones of fingerprints within three bits,
    of which up to three for each."""
    prints = scratch.put(nodes.groupBy("fp").agg(F.min("node").alias("first")), "prints")
    links = scratch.put(pigeonring_links(prints), "print_links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    some = both.groupBy("a").agg(F.array_distinct(F.array(F.min("b"), F.max("b"), F.min_by("b", F.xxhash64("b")))).alias("b")).select("a", F.explode("b").alias("b"))
    ends = [prints.select(F.col("fp").alias(x), F.col("first").alias(y)) for x, y in (("a", "x"), ("b", "y"))]
    near = some.join(ends[0], "a").join(ends[1], "b").select(*_ordered("x", "y"))
    equal = nodes.join(prints, "fp").filter("node <> first").select(*_ordered("node", "first"))
    out = scratch.put(near.unionByName(equal).distinct(), "print_pairs")
    scratch.free(prints, links)
    return out


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets overlap by 0.8 or more: |a & b| / |a | b| >= 4 / 5, in integers."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    fits = both.filter(5 * F.least(F.size("sa"), F.size("sb")) >= 4 * F.greatest(F.size("sa"), F.size("sb")))
    return fits.filter(9 * F.size(F.array_intersect("sa", "sb")) >= 4 * (F.size("sa") + F.size("sb"))).select("a", "b")


def _split_pairs(nodes: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of different parts of ``nodes(node, part)`` that may overlap by 0.8: all that do are among them.

    If |x & y| >= 4/9 (|x| + |y|), the first shingle that both share, in any one order of all shingles, is among the first
    floor(|x| / 5) + 1 of x and likewise of y, and as many as needed must follow it in both."""
    bags = sets.join(nodes, "node").select("node", "part", "shingles")
    tokens = bags.select("node", F.explode("shingles").alias("token"))
    spread = bags.select("part", F.explode("shingles").alias("token")).groupBy("token").agg(F.count("*").alias("df"), (F.min("part") < F.max("part")).alias("met"))
    ranked = scratch.put(spread, "rarity")
    order = tokens.join(ranked, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "token", "met"))).alias("order"))
    first = order.select("node", F.size("order").alias("n"), F.expr("slice(order, 1, cast(size(order) / 5 as int) + 1)").alias("first"))
    entries = first.join(nodes, "node").select("node", "part", "n", F.posexplode("first").alias("at", "x")).filter("x.met").select(F.col("x.token").alias("token"), "node", "part", "n", (F.col("n") - F.col("at")).alias("rest"))
    entries = scratch.put(entries, "prefixes")
    of_part = entries.groupBy("token", "part").agg(F.count("*").alias("c"), F.min("n").alias("low"))
    tops = of_part.groupBy("token").agg(F.max_by("part", F.struct("c", "part")).alias("main"), F.min("low").alias("low"), F.count("*").alias("parts")).filter("parts > 1")
    fits = 9 * F.col("rest") >= 4 * (F.col("n") + F.greatest(F.col("low"), F.ceil(F.col("n") * 4 / 5)))
    minor = scratch.put(entries.join(tops, "token").filter("part <> main").filter(fits).select("token", *(F.col(c).alias(f"{c}_b") for c in ("node", "part", "n", "rest"))), "minor")
    near = (F.col("part") != F.col("part_b")) & (5 * F.least("n", "n_b") >= 4 * F.greatest("n", "n_b")) & (9 * F.least("rest", "rest_b") >= 4 * (F.col("n") + F.col("n_b")))
    found = minor.join(entries, "token").filter(near).select(F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b")).distinct()
    out = scratch.put(found, "split_pairs")
    scratch.free(ranked, entries, minor)
    return out


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) for every row; component_id is the smallest id reachable over links."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "copies")
    texts = id_and_text(docs, id_col, text_col)
    rows = scratch.put(_with(texts, "bands", band_keys, True), "signatures")
    nodes = scratch.put(rows.groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("fp").alias("fp"), F.min("bands").alias("bands")), "nodes")
    weights = nodes.select("node", F.coalesce("rep", F.lit(_NO_ID)).alias("w"))
    own = nodes.select("node", F.col("node").alias("w"))
    alike = _print_pairs(nodes.select("node", "fp"), scratch)
    keys = nodes.select("node", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    live = scratch.put(keys.join(shared, "key").groupBy("node").agg(F.collect_list("key").alias("keys"), F.sum("n").alias("met")), "live")
    # the sets are larger than the texts, so they are made for texts with a candidate alone, one row of each node
    met = live.select("node").unionByName(alike.select(F.explode(F.array("a", "b")).alias("node")))
    some = scratch.put(weights.join(met, "node", "left_semi").select("w").distinct(), "sought")
    found = texts.join(some, F.coalesce("doc_id", F.lit(_NO_ID)) == F.col("w"), "left_semi")
    sets = scratch.put(_with(found, "shingles", lambda s: s).groupBy("node").agg(F.min("shingles").alias("shingles")), "sets")
    links = scratch.put(_alike(alike, sets), "close_links")
    close = connected_components(links, own, scratch).withColumnRenamed("w_min", "part")
    live = scratch.put(live.join(close, "node", "left").withColumn("part", F.coalesce("part", "node")), "apart")
    keyed = live.select(F.struct("node", "part").alias("x"), "met", F.explode("keys").alias("key"))
    hubs = keyed.groupBy("key").agg(F.max_by("x", F.struct("met", "x")).alias("h0"), F.min("x").alias("h1"), F.min_by("x", F.xxhash64("x.node")).alias("h2"))
    hubs = keyed.join(scratch.put(hubs, "hubs"), "key").select("x", F.explode(F.array_distinct(F.array("h0", "h1", "h2"))).alias("hub")).filter("x.part <> hub.part")
    pairs = scratch.put(hubs.select(*_ordered("x.node", "hub.node")).distinct().join(alike, ["a", "b"], "left_anti"), "hub_pairs")
    links = scratch.put(links.unionByName(_alike(pairs, sets)), "hub_links")
    parts = connected_components(links, own, scratch).withColumnRenamed("w_min", "part")
    keyed = live.select("node", F.explode("keys").alias("key"))
    placed = scratch.put(keyed.join(parts, "node", "left").select("key", "node", F.coalesce("part", "node").alias("part")), "placed")
    open_ = placed.groupBy("key").agg(F.min("part").alias("p0"), F.max("part").alias("p1")).filter("p0 <> p1").select("key")
    left = scratch.put(placed.join(open_, "key", "left_semi").select("node", "part").distinct(), "open")
    rest = _split_pairs(left, sets, scratch).join(pairs.unionByName(alike), ["a", "b"], "left_anti")
    links = scratch.put(links.unionByName(_alike(rest, sets)), "links")
    classes = connected_components(links, weights, scratch)
    smallest = F.nullif(F.coalesce("w_min", F.coalesce("rep", F.lit(_NO_ID))), F.lit(_NO_ID))
    named = scratch.put(nodes.select("node", "rep").join(classes, "node", "left").select("node", smallest.alias("component_id")), "classes")
    scratch.free(live, some, sets, alike, pairs, placed, left, links)
    return rows.select("doc_id", "node").join(named, "node").select("doc_id", "component_id")
