"""SimHash near-duplicate detection with pigeonring candidate filtering.

Fingerprint: 64 bits; a bit is set if it is set in more than half of the XXH64 hashes (seed 42) of the text's
word shingles. Two texts are linked at ``TAU`` = 3 or fewer differing bits.

Pigeonring: the 64 bits are four segments on a ring. If the total difference is at most 3, then from some
segment i on, every chain of l consecutive segments (l = 1..4) differs in at most floor(3 * l / 4) bits: 0, 1, 2, 3.
A chain's start is therefore found by an equi-join on segment i (no difference) and one half of segment i + 1
(at most one difference, so at least one half is equal): a 24-bit key, eight rows for each distinct fingerprint.
The longer chain budgets are checked in the join itself, before the full Hamming check.

Equal fingerprints are one node, so copies cost nothing here; a fingerprint has at most
C(64,1) + C(64,2) + C(64,3) = 43,744 different neighbours whatever the size of the corpus, so links grow with the input.

Defined results: null or word-less text has fingerprint zero and is linked like any other; repeated rows each
get a row; a null id never names a component unless all ids in it are null; an empty table gives no rows; other
columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, id_and_text, ship
from .components import connected_components

TAU = 3
SHINGLE = 3
SEGMENTS = 4
WIDTH = 16
_NO_ID = (1 << 63) - 1
_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)


def text_fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of a UTF-8 text as an unsigned integer."""
    words = raw.lower().split()  # on bytes: lower-cases A-Z alone, and splits at \x20 and \x09-\x0D alone
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        parts = [joined]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-1]))[: len(words) - shingle + 1].tolist()
        parts = [joined[i:j] for i, j in zip(starts, (ends[shingle - 1 :] - 1).tolist())]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, 42) for s in parts), np.uint64, len(parts)).view(np.uint8).reshape(-1, 8)
    out = 0
    for byte in range(8):  # hashes are little-endian
        ones = np.bincount(h[:, byte], minlength=256) @ _BYTE_BITS
        out |= int(np.packbits(2 * ones > len(parts), bitorder="little")[0]) << (8 * byte)
    return out


def _fingerprints(batches):
    for b in batches:
        texts = b.column("text").cast(pa.binary())
        fp = np.fromiter((text_fingerprint(x.as_py()) for x in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit integer, one row for each row of the input."""
    ship(docs.sparkSession)
    return id_and_text(docs, id_col, text_col).mapInArrow(_fingerprints, "doc_id long, fp long")


def _segment(fp: Column, i: int, width: int = WIDTH) -> Column:
    return F.shiftrightunsigned(fp, WIDTH * (i % SEGMENTS)).bitwiseAND(F.lit((1 << width) - 1))


def _differ(i: int) -> Column:
    return F.bit_count(_segment(F.col("a").bitwiseXOR(F.col("b")), i))


def chain_keys(fp: Column) -> Column:
    """Per chain start i and half of segment i + 1: one 24-bit key with its start and half in the high bits."""
    keys = []
    for i in range(SEGMENTS):
        for half in range(2):
            part = F.shiftrightunsigned(_segment(fp, i + 1), 8 * half).bitwiseAND(F.lit(255))
            keys.append(F.struct(F.lit(i).alias("start"), (F.lit((2 * i + half) << 24) + _segment(fp, i) * 256 + part).alias("key")))
    return F.array(*keys)


def pigeonring_links(nodes: DataFrame) -> DataFrame:
    """All pairs (a < b) of the distinct ``fp`` in ``nodes`` with at most TAU differing bits."""
    rows = nodes.select("fp", F.explode(chain_keys(F.col("fp"))).alias("k")).select("fp", "k.start", "k.key")
    left, right = rows.withColumnRenamed("fp", "a"), rows.select(F.col("fp").alias("b"), "key")
    chains = F.lit(False)
    for i in range(SEGMENTS):
        sums = [_differ(i)]
        for step in range(1, SEGMENTS):
            sums.append(sums[-1] + _differ(i + step))
        fits = F.lit(True)
        for length, total in enumerate(sums[:-1], 1):
            fits = fits & (total <= TAU * length // SEGMENTS)
        chains = chains | ((F.col("start") == i) & fits)
    full = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= TAU
    on = (left["key"] == right["key"]) & (F.col("a") < F.col("b")) & chains & full
    return left.join(right, on).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id is the smallest id reachable over links."""
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    fps = scratch.put(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = scratch.put(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    links = scratch.put(pigeonring_links(nodes), "pairs")
    weights = nodes.select(F.col("fp").alias("node"), F.coalesce("rep", F.lit(_NO_ID)).alias("w"))
    classes = connected_components(links, weights, scratch).withColumnRenamed("node", "fp")
    smallest = F.nullif(F.coalesce("w_min", F.coalesce("rep", F.lit(_NO_ID))), F.lit(_NO_ID))
    # Staged, so that the join below reads both sides through exchanges of its own, whose hot partitions Spark splits.
    named = scratch.put(nodes.join(classes, "fp", "left").select("fp", smallest.alias("component_id")), "classes")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def op1_simhash(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """The digest: doc_id, fingerprint as 16 lower-case hex digits, component_id."""
    hex16 = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return near_duplicates(documents).select("doc_id", hex16.alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """Pipeline stage: of each component of near copies (``near_copies.py``: fingerprints of five-word shingles, then their exact overlap) the rows of
    the document with the smallest id stay; rows without an id stay too."""
    from .near_copies import near_copies  # which uses the fingerprints of this module

    found = near_copies(docs.select("doc_id", "text"))
    kept = found.filter("doc_id = component_id").select("doc_id").distinct()
    # a semi join on the id alone: no key is hot, ids being unique or repeated rows of one document
    return docs.filter("doc_id is not null").join(kept, "doc_id", "left_semi").select(docs.columns).unionByName(docs.filter("doc_id is null"))
