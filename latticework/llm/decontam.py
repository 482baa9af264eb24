"""Benchmark decontamination: a BM25 inverted index of the test items, searched by block-max WAND.

The index holds the items, broadcast behind a check of their size; beyond the bound they are searched in shards, one after the other, each
found set being written before the next shard is read. Document frequencies, the mean length and the stride are those of all items,
so a score does not depend on the shards. The queries are the training passages: windows of 2 * stride words every stride
words over the whole text, where stride is at least the longest item, so that every item-sized run of words
lies in one passage. An item's BM25 impacts are divided by the score it gives its own words: a passage's score is
the weighted share of the item that it covers, and all items at or above ``THRESHOLD`` are retrieved. Items are ordered so that
like ones stand together, and cut into at most ``RANGES`` ranges; for all passages of a text at once the sums of their distinct
words' largest impacts in each range are taken, and cursors move only in ranges whose sum reaches the threshold.

A retrieved item is a leak if the passage's text holds at least ``OVERLAP`` of the five-word shingles of its question
and of its answer. Items carry no fields: the last sentence is the answer, the rest the question (in an item of one
sentence the last third of its words).

A very long text's passages are scored a group at a time (``GROUP``), so what is held does not grow with the text beyond its words.

Defined results: null or word-less texts and items match nothing; items under five words are compared as one
shingle; repeated rows each give their rows; equal item texts each count; rows without an id are searched and
returned with a null id; empty tables give no rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, id_and_text, ship

K1, B = 1.2, 0.75
BLOCK = 16
RANGES = 64
THRESHOLD = 0.6
OVERLAP = 0.8
SHINGLE = 5
STRIDE = 64
INDEX_BYTES = 16 << 20  # of items' text in a shard; its index is some ten times that in each worker
GROUP = 256  # passages whose bounds are held at once
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.?!])\s+|\n+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    n = min(SHINGLE, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    parts = [w for s in _SENTENCE.split(text) if (w := words_of(s))]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = parts[0] if parts else []
    cut = len(words) - len(words) // 3
    return words[:cut], words[cut:]


@dataclass
class Corpus:
    """Figures of all items with words: their number, words in all, the longest one's words, and in how many items a word stands."""

    count: int
    words: int
    longest: int
    df: dict[str, int]

    @classmethod
    def of(cls, bags: list[list[str]]) -> Corpus:
        df: dict[str, int] = {}
        for bag in bags:
            for w in set(bag):
                df[w] = df.get(w, 0) + 1
        return cls(len(bags), sum(map(len, bags)), max(map(len, bags), default=0), df)


class ItemIndex:
    """Term -> postings (item, impact) in item order, with the largest impact of each block of ``BLOCK`` postings."""

    def __init__(self, items: list[tuple[int, str]], corpus: Corpus | None = None):
        """``corpus``: the figures of all items where these are but a shard of them."""
        self.items = []
        for item_id, text in items:
            q, a = question_and_answer(text or "")
            if q or a:
                self.items.append((item_id, q, a, shingles(q), shingles(a)))
        about = corpus or Corpus.of([q + a for _, q, a, _, _ in self.items])
        df, count, mean = about.df, about.count, about.words / max(1, about.count)
        # like items stand together: by their most widespread words
        self.items.sort(key=lambda x: sorted({*x[1], *x[2]}, key=lambda w: (-df[w], w))[:6])
        bags = [q + a for _, q, a, _, _ in self.items]
        self.terms = {w: i for i, w in enumerate(sorted({w for bag in bags for w in bag}))}
        self.docs: list[list[int]] = [[] for _ in self.terms]
        self.impacts: list[list[float]] = [[] for _ in self.terms]
        for d, bag in enumerate(bags):
            raw = {}
            for w in set(bag):
                tf = bag.count(w)
                raw[w] = math.log(1 + (count - df[w] + 0.5) / (df[w] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(bag) / mean))
            own = sum(raw.values())
            for w, x in raw.items():
                self.docs[self.terms[w]].append(d)
                self.impacts[self.terms[w]].append(x / own)
        self.block_max = [[max(xs[i : i + BLOCK]) for i in range(0, len(xs), BLOCK)] for xs in self.impacts]
        self.most = np.array([max(xs) for xs in self.impacts] + [0.0])
        self.size = max(4, -(-len(self.items) // RANGES))
        #: the largest impact of each term in each range of ``size`` items; a row of zeros stands for all other words
        self.peaks = np.zeros((len(self.terms) + 1, -(-len(self.items) // self.size)), np.float32)
        for t, (ds, xs) in enumerate(zip(self.docs, self.impacts)):
            np.maximum.at(self.peaks[t], np.array(ds) // self.size, np.array(xs, np.float32))
        self.stride = max(STRIDE, about.longest)

    def search(self, terms: list[int], threshold: float = THRESHOLD, begin: int = 0, end: int | None = None) -> list[tuple[int, float]]:
        """Every (item, score) with score >= threshold among items ``begin`` to ``end``, by block-max WAND over the distinct ``terms``."""
        end = len(self.items) if end is None else end
        lists, found = [], []
        for t in terms:
            p = bisect_left(self.docs[t], begin)
            if p < len(self.docs[t]) and self.docs[t][p] < end:
                lists.append([self.docs[t][p], p, t])  # current item, place, term
        while lists:
            lists.sort()
            bound, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(lists):
                bound += self.most[t]
                if bound >= threshold - 1e-9:
                    pivot = k
                    break
            if pivot < 0:
                break
            at = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == at:
                pivot += 1
            shallow, until = 0.0, end
            for d, p, t in lists[: pivot + 1]:  # the block that would hold ``at``, without moving the cursor
                b = bisect_left(self.docs[t], at, p) // BLOCK
                if b < len(self.block_max[t]):
                    shallow += self.block_max[t][b]
                    last = min(len(self.docs[t]), (b + 1) * BLOCK) - 1
                    until = min(until, self.docs[t][last] + 1)
            if shallow >= threshold - 1e-9:
                if lists[0][0] == at:
                    score = sum(self.impacts[t][p] for d, p, t in lists[: pivot + 1])
                    if score >= threshold - 1e-9:
                        found.append((at, score))
                    target = at + 1
                else:
                    target = at
            else:  # no item below the nearest block end, nor below the next list's item, can reach the threshold
                target = min(until, lists[pivot + 1][0] if pivot + 1 < len(lists) else end)
                target = max(target, at + 1)
            kept = []
            for k, (d, p, t) in enumerate(lists):
                if k <= pivot and d < target:
                    p = bisect_left(self.docs[t], target, p)
                    if p == len(self.docs[t]) or self.docs[t][p] >= end:
                        continue
                    d = self.docs[t][p]
                kept.append([d, p, t])
            lists = kept
        return found

    def leaks(self, text: str) -> list[tuple[int, float, float, float, int]]:
        """(item_id, score, question overlap, answer overlap, first word of the passage), the best passage of each item."""
        words = words_of(text)
        if not words or not self.items:
            return []
        none, s = len(self.terms), self.stride
        ids = np.fromiter((self.terms.get(w, none) for w in words), np.int32, len(words))
        windows = max(1, -(-len(words) // s) - 1)
        padded = np.full((windows + 1) * s, none, np.int32)
        padded[: len(ids)] = ids
        rows = np.sort(np.concatenate([padded[: windows * s].reshape(windows, s), padded[s:].reshape(windows, s)], axis=1), axis=1)
        fresh = rows < none
        fresh[:, 1:] &= rows[:, 1:] != rows[:, :-1]
        per = fresh.sum(axis=1)
        some = np.flatnonzero(per)
        best: dict[int, tuple] = {}
        for lo in range(0, len(some), GROUP):
            part = some[lo : lo + GROUP]
            starts = np.cumsum(per[part]) - per[part]
            bounds = np.add.reduceat(self.peaks[rows[part][fresh[part]]], starts, axis=0)
            at, ranges = np.nonzero(bounds >= THRESHOLD - 1e-5)
            for k, r in zip(part[at].tolist(), ranges.tolist()):
                self._verify(words, k, self.search(rows[k][fresh[k]].tolist(), THRESHOLD, r * self.size, min(len(self.items), (r + 1) * self.size)), best)
        return [best[d] for d in sorted(best)]

    def _verify(self, words: list[str], k: int, hits: list[tuple[int, float]], best: dict[int, tuple]) -> None:
        """Keeps of the items retrieved by passage k those whose question and answer it holds."""
        if not hits:
            return
        s = self.stride
        here = words[k * s : (k + 2) * s]
        near: dict[int, set] = {}
        for d, score in hits:
            item_id, q, a, qs, an = self.items[d]
            share = []
            for w, sh in ((q, qs), (a, an)):
                n = min(SHINGLE, len(w))
                if n and n not in near:
                    near[n] = {tuple(here[i : i + n]) for i in range(len(here) - n + 1)}
                share.append(len(sh & near[n]) / len(sh) if sh else 1.0)
            if min(share) >= OVERLAP and (d not in best or (-score, k) < (-best[d][1], best[d][4] // s)):
                best[d] = (item_id, score, share[0], share[1], k * s)


def _bags(batches):
    """Words of each item, for the figures over all items."""
    for b in batches:
        bags = [q + a for q, a in map(question_and_answer, b.column("text").to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array([len(x) for x in bags], pa.int64()), pa.array([sorted(set(x)) for x in bags], pa.list_(pa.string()))], ["n", "words"])


def _shards(items: DataFrame, scratch: Scratch):
    """The items in shards of about INDEX_BYTES of text: one in practice, more if the benchmark grows."""
    texts = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    n = max(1, -(-total // INDEX_BYTES))
    in_order = lambda part: sorted(((r.item_id, r.text) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if n == 1:
        yield ItemIndex(in_order(texts))
        return
    bags = texts.mapInArrow(_bags, "n long, words array<string>").filter("n > 0")
    sums = bags.agg(F.count("*").alias("count"), F.sum("n").alias("words"), F.max("n").alias("longest")).first()
    if not sums["count"]:
        return
    df = scratch.put(bags.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df")), "frequencies")
    for k in range(n):
        part = texts.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        own = part.mapInArrow(_bags, "n long, words array<string>").select(F.explode("words").alias("word")).distinct()
        yield ItemIndex(in_order(part), Corpus(sums["count"], sums["words"], sums.longest, {r.word: r.df for r in df.join(own, "word", "left_semi").collect()}))
    scratch.free(df)


_OUT = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, passage_start long"


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each (row of docs, leaked item), with the best passage's score and overlaps."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "leaks")
    out, before = None, None
    for index in _shards(items, scratch):
        if before is not None:  # one shard at a time: what it found is written, then it goes
            out, before = _written(out, before, scratch)
        shared = before = spark.sparkContext.broadcast(index)

        def search(batches, shared=shared):
            ix = shared.value
            for b in batches:
                cols: list[list] = [[] for _ in range(6)]
                for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                    for hit in ix.leaks(text.as_py()):
                        for c, v in zip(cols, (doc_id, *hit)):
                            c.append(v)
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [x.split()[0] for x in _OUT.split(", ")])

        part = id_and_text(docs, id_col, text_col).mapInArrow(search, _OUT)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], _OUT) if out is None else out


def _written(found: DataFrame, shared, scratch: Scratch) -> tuple[DataFrame, None]:
    made = scratch.put(found, "shard")
    shared.destroy()
    return made, None


def op2_decontamination(spark: SparkSession, documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    return find_leaks(documents, benchmark)


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Pipeline stage: rows in which no item is found stay unchanged; a narrow pass, without a shuffle."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "clean")
    out, place, before = docs, docs.columns.index("text"), None
    for index in _shards(items, scratch):
        if before is not None:
            out, before = _written(out, before, scratch)
        shared = before = spark.sparkContext.broadcast(index)

        def clean(batches, shared=shared):
            for b in batches:
                yield b.filter(pa.array([not shared.value.leaks(t.as_py() or "") for t in b.column(place)], pa.bool_()))

        out = out.mapInArrow(clean, T.StructType(docs.schema.fields))
    return out
