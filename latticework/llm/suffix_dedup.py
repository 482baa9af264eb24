"""Repeated passages across documents by sparse suffix arrays.

A text's suffixes are kept only where its content says so: of every ``WINDOW`` consecutive runs of ``K`` words the one
with the smallest hash marks a position (a minimiser). Any passage of ``LEAST`` = K + WINDOW - 1 words selects the same
position wherever it stands, so equal passages meet at suffixes that share K words or more. Three steps:

1. positions are grouped by a 64-bit key of their first K words, and those whose key stands in one document alone fall out, which is
   nearly all; equal keys are only candidates, words are compared later;
2. the suffixes left carry the words on both sides that passages selected by them can reach, at most WINDOW - 1 before and LEAST behind.
   Suffixes with equal words around them are one (by a 128-bit cryptographic digest). They are sorted in range partitions, by the key
   of their first K words and then by their words, and each is compared word by word with its neighbour. Inside a stretch of
   suffixes that share K words, passages that reach left by o words are equal where the suffixes share LEAST - o words (a run of
   neighbours) and the o words before them: matches are extended to the left in this way, for every o;
3. a key at the border of a partition may go on in the next one, so its passages are grouped by the digest of their words instead.
   A passage that stands in a third of all documents fills whole partitions and is resolved by that aggregate, in parts.

Of each class of equal passages of LEAST words the first occurrence (smallest id, then place) is the representative; all
others point to it, so copies are never expanded into pairs; consecutive passages with one representative are joined into the longest
match. Words are ``[^\\x20\\x09-\\x0D]+``, compared exactly.

Defined results: texts under LEAST words, null or empty ones have no passage; repeats inside one document alone are no
match; rows that repeat an id and a text are one document; rows with an id but another text are documents of
their own with that id (equal passages in them alone are no match); rows without an id take no part; empty tables give
no rows; other columns are ignored, and may have any names.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, WorkerMemory, free_names, parts_of, ship

K, WINDOW = 25, 26
LEAST = K + WINDOW - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_memory = WorkerMemory(48 << 20, 190)  # words and their hashes
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _word_keys(words: list[bytes]) -> np.ndarray:
    out = np.empty(len(words), np.uint64)
    at = 0
    for part in parts_of(words):
        _memory.turn()
        _memory.learn(set(part).difference(_memory.young), xxhash.xxh3_64_intdigest)
        out[at : at + len(part)] = np.fromiter(map(_memory.young.__getitem__, part), np.uint64, len(part))
        at += len(part)
    return out


def _up_to(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def run_keys(words: list[bytes], *sizes: int) -> list[np.ndarray]:
    """For each size the keys of all runs of so many words: a polynomial over word hashes modulo 2^64."""
    n = len(words)
    power, inverse = _up_to(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_word_keys(words) * power[:n], out=total[1:])
    return [_mixed((total[s:] - total[: n - s + 1]) * inverse[: n - s + 1]) for s in sizes]


def minimisers(keys: np.ndarray) -> np.ndarray:
    """For each window of WINDOW run keys the place of its smallest, the leftmost of equal ones."""
    return np.lib.stride_tricks.sliding_window_view(keys, WINDOW).argmin(axis=1) + np.arange(len(keys) - WINDOW + 1)


def _suffixes(key_bits: int):
    def run(batches):
        _memory.enter()
        for b in batches:
            keys, ids, marks, places = [], [], [], []
            for doc_id, mark, text in zip(b.column("doc_id").to_pylist(), b.column("mark").to_pylist(), b.column("text").cast(pa.binary())):
                words = text.as_py().split()
                if len(words) < LEAST:
                    continue
                (k,) = run_keys(words, K)
                at = np.unique(minimisers(k))
                keys.append(k[at] >> np.uint64(64 - key_bits))
                places.append(at)
                ids.append(np.full(len(at), doc_id))
                marks.append(np.full(len(at), mark))
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(marks)), pa.array(np.concatenate(places).astype(np.int32))],
                    ["key", "doc_id", "mark", "place"],
                )

    return run


_OCCURRENCE = "ctx binary, key long, doc_id long, mark long, place int, low int, high int, left binary, right binary"


def _joined(words: list[bytes]) -> bytes:
    """Each word with a tab behind it, which no word holds: texts that begin with the same words stand together in byte order."""
    return b"".join([w + b"\t" for w in words])


def _occurrences(batches):
    """The suffixes at the row's places. The windows that a place is the minimiser of begin ``low`` to ``high`` words before it; the words
    that these windows hold on both sides are sent once by a task."""
    _memory.enter()
    sent: set[bytes] = set()
    for b in batches:
        cols: list[list] = [[] for _ in range(9)]
        for doc_id, mark, text, at in zip(*(b.column(c).to_pylist() for c in ("doc_id", "mark")), b.column("text").cast(pa.binary()), b.column("places")):
            words = text.as_py().split()
            (k,) = run_keys(words, K)
            where = minimisers(k)
            places = np.sort(at.values.to_numpy())
            begin, end = np.searchsorted(where, places), np.searchsorted(where, places, "right")
            for p, key, s, e in zip(places.tolist(), k[places].view(np.int64).tolist(), begin.tolist(), end.tolist()):
                low, high = p - e + 1, p - s
                left, right = _joined(words[p - high : p]), _joined(words[p : p + LEAST - low])
                ctx = hashlib.blake2b(b"%d %d " % (low, high) + left + right, digest_size=16).digest()
                if ctx in sent:
                    left = right = None
                else:
                    if len(sent) > 200_000:  # only a saving
                        sent.clear()
                    sent.add(ctx)
                for c, x in zip(cols, (ctx, key, doc_id, mark, p, low, high, left, right)):
                    c.append(x)
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [x.split()[0] for x in _OCCURRENCE.split(", ")])


_FOUND = "ctx binary, low int, high int, rep_doc long, rep_place int, rep_mark long, window binary, last long"


class _Suffix:
    """A suffix in sorted order: its words, its first occurrence, and how many words it shares with the one before."""

    __slots__ = ("ctx", "low", "high", "first", "last", "left", "right", "words", "cut", "shared")

    def __init__(self, ctx, low, high, first, last, left, right):
        self.ctx, self.low, self.high, self.first, self.last, self.left, self.right = ctx, low, high, first, last, left, right
        self.words = right.split(b"\t")[:-1]
        before = left.split(b"\t")[:-1]
        #: where in ``left`` its last o words begin
        self.cut = [len(left)] * (len(before) + 1)
        for o, w in enumerate(reversed(before), 1):
            self.cut[o] = self.cut[o - 1] - len(w) - 1
        self.shared = 0

    def compare(self, other: _Suffix) -> None:
        n = 0
        for a, b in zip(self.words, other.words):
            if a != b:
                break
            n += 1
        self.shared = n

    def behind(self, n: int) -> bytes:
        return self.right if n == len(self.words) else _joined(self.words[:n])


def _stretch(rows: list[_Suffix], out: list[list]) -> None:
    """Finds the representatives of all windows of neighbours that share K words; adds ranges of offsets with one representative."""
    found: list[list] = [[] for _ in rows]
    for o in range(min(r.low for r in rows), max(r.high for r in rows) + 1):
        groups: dict[tuple[int, bytes], list[int]] = {}
        run = 0
        for i, r in enumerate(rows):
            if r.shared < LEAST - o:
                run = i
            if r.low <= o <= r.high:
                groups.setdefault((run, r.left[r.cut[o] :]), []).append(i)
        for same in groups.values():
            first = min(rows[i].first for i in same)
            if first[0] < max(rows[i].last for i in same):
                for i in same:
                    found[i].append((o, first))
    for r, ranges in zip(rows, found):
        start = 0
        for k, (o, first) in enumerate(ranges):
            if k + 1 == len(ranges) or ranges[k + 1] != (o + 1, first):
                for c, x in zip(out, (r.ctx, ranges[start][0], o, *first, None, None)):
                    c.append(x)
                start = k + 1


def _open(rows: list[_Suffix], out: list[list]) -> None:
    """The windows of a stretch that may go on in another partition, each with the digest of its words."""
    for r in rows:
        for o in range(r.low, r.high + 1):
            digest = hashlib.blake2b(b"%d " % o + r.left[r.cut[o] :] + r.behind(LEAST - o), digest_size=16).digest()
            for c, x in zip(out, (r.ctx, o, o, *r.first, digest, r.last)):
                c.append(x)


def _neighbours(batches):
    """Sorted suffixes of one partition: (ctx, range of offsets, representative); open windows for its first key and its last."""
    kinds = [pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64()]
    names = [x.split()[0] for x in _FOUND.split(", ")]
    cols: list[list] = [[] for _ in kinds]

    def batch():
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)
        for c in cols:
            c.clear()
        return made

    def close(rows: list[_Suffix]) -> None:
        start = 0
        for i in range(1, len(rows) + 1):
            if i < len(rows):
                rows[i].compare(rows[i - 1])
            if i == len(rows) or rows[i].shared < K:
                _stretch(rows[start:i], cols)
                start = i

    rows: list[_Suffix] = []
    key, first_key = None, True
    for b in batches:
        firsts = zip(*(b.column(c).to_pylist() for c in ("doc_id", "place", "mark")))
        for own, ctx, low, high, last, left, right, first in zip(*(b.column(c).to_pylist() for c in ("key", "ctx", "low", "high", "last", "left", "right")), firsts):
            if key is not None and own != key:
                if first_key:
                    _open(rows, cols)
                else:
                    close(rows)
                rows, first_key = [], False
            elif first_key and len(rows) >= 1000:
                _open(rows, cols)
                rows = []
            key = own
            rows.append(_Suffix(ctx, low, high, first, last, left, right))
            if len(cols[0]) > 5000:
                yield batch()
    _open(rows, cols)
    yield batch()


_SPANS = "doc_id long, mark long, start_word int, n_words int, rep_doc_id long, rep_start_word int, is_first boolean"


def _runs(batches):
    """Joins a document's matching windows into the longest matches with one partner."""
    for b in batches:
        cols: list[list] = [[] for _ in range(7)]
        for doc_id, mark, rows in zip(b.column("doc_id").to_pylist(), b.column("mark").to_pylist(), b.column("rows")):
            v = rows.values
            place, low, high, rep, at, own = (v.field(k).to_numpy(zero_copy_only=False) for k in range(6))
            n = high - low + 1
            offset = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            place, rep, at, own = np.repeat(place, n) - offset, np.repeat(rep, n), np.repeat(at, n) - offset, np.repeat(own, n)
            order = np.argsort(place, kind="stable")
            place, rep, at, own = place[order], rep[order], at[order], own[order]
            cut = np.flatnonzero((np.diff(place) != 1) | (np.diff(rep) != 0) | (np.diff(at) != 1) | (own[1:] != own[:-1])) + 1
            first, last = np.concatenate(([0], cut)), np.concatenate((cut, [len(place)])) - 1
            for f, e in zip(first.tolist(), last.tolist()):
                same = bool(own[f]) and at[f] == place[f]
                for c, x in zip(cols, (doc_id, mark, int(place[f]), int(place[e] - place[f]) + LEAST, int(rep[f]), int(at[f]), same)):
                    c.append(x)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [x.split()[0] for x in _SPANS.split(", ")])


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text")).filter("doc_id is not null and text is not null")


def repeated_passages(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", key_bits: int = 64) -> DataFrame:
    """One row for each longest match of a document with a representative: doc_id, mark (hash of its text), start_word, n_words,
    rep_doc_id, rep_start_word, and whether it is the representative itself. Fewer ``key_bits`` give more candidates, not other results."""
    ship(docs.sparkSession)
    marked = _marked(docs, id_col, text_col)
    suffixes = scratch.put(marked.mapInArrow(_suffixes(key_bits), "key long, doc_id long, mark long, place int"), "suffixes")
    met = scratch.put(suffixes.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("key"), "met")
    places = scratch.put(suffixes.join(met, "key").groupBy("doc_id", "mark").agg(F.collect_set("place").alias("places")), "places")
    scratch.free(suffixes, met)
    seen = scratch.put(marked.join(places, ["doc_id", "mark"]).mapInArrow(_occurrences, _OCCURRENCE), "occurrences")
    scratch.free(places)
    first = F.min(F.struct("doc_id", "place", "mark")).alias("first")
    contexts = seen.groupBy("ctx").agg(first, F.max("doc_id").alias("last"), *(F.max(c).alias(c) for c in ("key", "low", "high", "left", "right")))
    contexts = scratch.put(contexts.select("ctx", "key", "first.doc_id", "first.place", "first.mark", "last", "low", "high", "left", "right"), "contexts")
    # what the driver samples for the ranges is a key and a digest for each row, not words
    sorted_ = contexts.repartitionByRange("key", "ctx").sortWithinPartitions("key", "right", "ctx")
    found = scratch.put(sorted_.mapInArrow(_neighbours, _FOUND), "neighbours")
    scratch.free(contexts)
    rep = F.struct("rep_doc", "rep_place", "rep_mark")
    left = found.filter("window is not null")
    classes = scratch.put(left.groupBy("window").agg(F.min(rep).alias("rep"), F.max("last").alias("last")).filter("rep.rep_doc < last").select("window", "rep"), "classes")
    ranges = found.filter("window is null").select("ctx", "low", "high", rep.alias("rep")).unionByName(left.join(classes, "window").select("ctx", "low", "high", "rep"))
    ranges = scratch.put(ranges, "ranges")
    own = (F.col("rep.rep_doc") == F.col("doc_id")) & (F.col("rep.rep_mark") == F.col("mark"))
    row = F.struct("place", "low", "high", F.col("rep.rep_doc").alias("rep"), F.col("rep.rep_place").alias("at"), own.alias("own"))
    spans = scratch.put(seen.select("ctx", "doc_id", "mark", "place").join(ranges, "ctx").groupBy("doc_id", "mark").agg(F.collect_set(row).alias("rows")).mapInArrow(_runs, _SPANS), "spans")
    scratch.free(seen, found, classes, ranges)
    return spans


def op10_suffix_dedup(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """Every repeated passage of LEAST words or more: the document, its place there, and the representative's."""
    spans = repeated_passages(documents, Scratch(spark, "suffixes"))
    return spans.select("doc_id", "start_word", "n_words", "rep_doc_id", "rep_start_word", "is_first")


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans (first word, number of words) and the white space before each."""
    data = text.encode()
    at = [m.span() for m in _WORD.finditer(data)]
    keep, end, out = np.ones(len(at), bool), 0, []
    for start, n in spans:
        keep[start : start + n] = False
    for k, (lo, hi) in zip(keep.tolist(), at):
        if k:
            out.append(data[end:hi])
        end = hi
    return b"".join([*out, data[end:]]).decode()


def cut_repeats(docs: DataFrame) -> DataFrame:
    """Pipeline stage: repeated passages stay in their first document and are cut from all others; a document
    that loses its last word goes. Texts without such a passage stay byte for byte; n_chars follows the text."""
    scratch = Scratch(docs.sparkSession, "cut")
    spans = repeated_passages(docs.select("doc_id", "text"), scratch)
    own_id, own_mark, own_spans = free_names(docs, "_lw_id", "_lw_mark", "_lw_spans")
    again = spans.filter("not is_first").groupBy(F.col("doc_id").alias(own_id), F.col("mark").alias(own_mark))
    lists = scratch.put(again.agg(F.collect_set(F.struct("start_word", "n_words")).alias(own_spans)), "lists")
    scratch.free(spans)
    at, n_at = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def cut(batches):
        for b in batches:
            cols, stay = list(b.columns[:-1]), []
            texts = cols[at].to_pylist()
            sizes = None if n_at is None else cols[n_at].to_pylist()
            for i, found in enumerate(b.column(b.num_columns - 1)):
                if found.is_valid:
                    texts[i] = cut_words(texts[i], list(zip(*(found.values.field(k).to_pylist() for k in range(2)))))
                    if sizes is not None:
                        sizes[i] = len(texts[i])
                stay.append(not found.is_valid or bool(texts[i].strip()))
            cols[at] = pa.array(texts, pa.string())
            if sizes is not None:
                cols[n_at] = pa.array(sizes, cols[n_at].type)
            yield pa.RecordBatch.from_arrays(cols, b.schema.names[:-1]).filter(pa.array(stay, pa.bool_()))

    same = (docs["doc_id"].cast("long") == F.col(own_id)) & (F.xxhash64(docs["text"]) == F.col(own_mark))
    return docs.join(lists, same, "left").select(*(docs[c] for c in docs.columns), own_spans).mapInArrow(cut, T.StructType(docs.schema.fields))
