"""Toxicity scoring: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the hashed slots of its words, of the first ``STEMS`` letters of its longer words, of its
adjacent word pairs and of its word pairs with one word between them; each distinct slot counts once, however
long the text. Training keeps the FTRL state (z, n) per slot, so every coordinate has its own rate, and L1 sets
most weights to exactly zero: what is broadcast is the short list of non-zero weights, at most ``SLOTS`` of them.

Labels come only from the training fold; at most ``SAMPLE`` labelled rows are used, those with the smallest hash
of their id, which is a bounded uniform sample. Every text is scored whole.

Defined results: a null text scores as an empty one (the bias alone); rows with a null or absent label never
train; of conflicting labels of one id the larger counts; without labels the score is a constant below 0.5;
a null id is held out (its crc32 of the empty text is 0) and scored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WorkerMemory, crc32_mod, free_names, id_and_text, parts_of, ship

SLOTS = 1 << 20
STEMS = (4, 5, 6, 7, 8)
SAMPLE = 12_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 2.0, 1.0, 8.0, 0.0
FOLDS = 5
_WORD = re.compile(r"\w+")
_KEEP = 48 << 20  # bytes of words and their hashes that a worker remembers
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
_memory = WorkerMemory(_KEEP, 240)
_packed = struct.Struct(f"<{1 + len(STEMS)}Q").pack


def _hash(word: str) -> bytes:
    """Of the word and of its first letters; a word that is not longer than a stem has its own hash there."""
    digest, raw = xxhash.xxh3_64_intdigest, word.encode("utf-8", "surrogatepass")
    h = digest(raw)
    cut = raw.__getitem__ if len(raw) == len(word) else lambda to: word[to].encode("utf-8", "surrogatepass")
    return _packed(h, *(digest(b"^" + cut(slice(n))) if len(word) > n else h for n in STEMS))


def _word_hashes(words: list[str]) -> np.ndarray:
    _memory.turn()
    known = _memory.young
    _memory.learn(set(words).difference(known), _hash)
    return np.frombuffer(b"".join(map(known.__getitem__, words)), "<u8").reshape(len(words), -1)


def active_slots(text: str) -> np.ndarray:
    """The slots of a text's features, with repeats."""
    words = _WORD.findall(text.lower())
    if not words:
        return np.empty(0, np.int64)
    both = np.concatenate([_word_hashes(part) for part in parts_of(words)])
    h = both[:, 0]
    parts = [(both * _MIX[0]).ravel(), h[:-1] * _MIX[1] + h[1:] * _MIX[2], h[:-2] * _MIX[2] + h[2:] * _MIX[3]]
    return (np.concatenate(parts) >> np.uint64(44)).astype(np.int64)


def ftrl_train(examples: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> tuple[float, np.ndarray]:
    """Bias and weights after ``epochs`` passes over (distinct slots, label) in the given order."""
    positive = sum(y for _, y in examples)
    bias = math.log((positive + 0.5) / (len(examples) - positive + 1.5))
    z, n = np.zeros(SLOTS), np.zeros(SLOTS)

    def weights(at):
        zi = z[at]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for at, y in examples:
            w = weights(at)
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, bias + float(w.sum()))))) - y
            grown = np.sqrt(n[at] + g * g)
            z[at] += g - (grown - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    return bias, weights(np.arange(SLOTS))


def _train(batches):
    """One task over the bounded sample; yields (slot, weight), with the bias at slot -1."""
    rows = []
    _memory.enter()
    for b in batches:
        for doc_id, text, y in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("toxic").to_pylist()):
            rows.append((xxhash.xxh3_64_intdigest(str(doc_id)), np.unique(active_slots(text)).astype(np.int32), int(y)))
    rows.sort(key=lambda r: (r[0], r[2], len(r[1])))
    bias, w = ftrl_train([(at, y) for _, at, y in rows])
    at = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([-1], at))), pa.array(np.concatenate(([bias], w[at])))], ["slot", "weight"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[float, np.ndarray, np.ndarray]:
    """(bias, slots, weights) learnt from labelled rows outside the held-out fold."""
    ship(docs.sparkSession)
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter("doc_id is not null and toxic is not null")
        .filter(crc32_mod("doc_id", FOLDS) != 0)
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    # at most ``sample`` rows of (id, label): a fixed bound, so it may be broadcast
    met = id_and_text(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", (F.col("toxic") > 0).cast("int").alias("toxic"))
    # of rows that repeat an id one text counts, so that the training task has at most ``sample`` rows
    rows = met.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one")).select("doc_id", F.col("one.text").alias("text"), "toxic")
    found = rows.repartition(1).mapInArrow(_train, "slot long, weight double").collect()
    bias = next((r.weight for r in found if r.slot < 0), -1.0)
    kept = sorted((r.slot, r.weight) for r in found if r.slot >= 0)
    return bias, np.array([s for s, _ in kept], np.int64), np.array([w for _, w in kept])


def scores(rows: DataFrame, model: tuple[float, np.ndarray, np.ndarray], text_col: str = "text") -> DataFrame:
    """The rows with a last column added, ``_lw_score`` or, where that is taken, the name with underscores."""
    spark = rows.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    place, (name,) = rows.columns.index(text_col), free_names(rows, "_lw_score")

    def score(batches):
        _memory.enter()
        bias, slots, weights = shared.value
        dense = np.zeros(SLOTS)
        dense[slots] = weights
        live = dense != 0
        for b in batches:
            out = []
            for text in b.column(place):
                at = active_slots(text.as_py() or "")
                at = np.unique(at[live[at]])
                out.append(1 / (1 + math.exp(-max(-700.0, min(700.0, bias + float(dense[at].sum()))))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], [*b.schema.names, name])

    return rows.mapInArrow(score, T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType())]))


def op6_toxicity(spark: SparkSession, documents: DataFrame, labels: DataFrame) -> DataFrame:
    scored = scores(id_and_text(documents), train(documents, labels))
    return scored.select("doc_id", (crc32_mod("doc_id", FOLDS) == 0).alias("held_out"), F.col("_lw_score").alias("score"), (F.col("_lw_score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pipeline stage: rows predicted toxic go; all others stay unchanged."""
    scored = scores(docs, train(docs, labels))
    return scored.filter(F.col(scored.columns[-1]) < 0.5).select(docs.columns)
