"""Language-model scoring with a trigram model in Elias-Fano tries.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; each text ends with an end token. Three jobs:

1. counts of all words of the training texts (partial counts per task, then one aggregate); the ``NAMED`` most frequent of them, a fixed
   number, are broadcast with ids, all others go by their 64-bit hash, so no list of all words is held anywhere;
2. one pass over all texts that sends, in sorted and packed blocks, the trigrams of all texts to shards: each with its count in the block's
   training texts and the texts that ask for it. A row has its own numbers for the hashes in it. A shard is a range of contexts (last word,
   word before; hashed words behind the others, by hash); contexts of a word that is too frequent for one shard are dealt over several, each of
   which gets that word's bigram counts;
3. each shard merges its counts into a trie, maps it into memory from a temporary file, and answers its queries; the
   answers are integers, summed by block of texts. As the answers need all counts, a shard's rows wait in a temporary file.

Model: interpolated absolute discounting over all words, p(w|u,v) = (c(uvw) - D)/c(uv) + D t(uv)/c(uv) p(w|v), and so down to the
smoothed word frequency. Probabilities sum to one over the vocabulary with one unseen word. For a hashed word w a shard does not know the frequency;
p is linear in it, so the shard answers with both coefficients and the frequency, looked up by hash, is put in when a block's answers meet.
``SHORTLIST`` may bound the words that have n-grams of their own (none by default): the others are then one class, each weighted by its frequency in it.
The trie's levels: last words; their successors with p(w|v); contexts (v, u) with back-off weights; and the successors in
a context, written as their rank among the successors of v. Probabilities are quantised to 2^-9 in log10.

What is held at a time: a block of texts (map side), a shard's trigrams (about ``SHARD_TOKENS`` tokens' worth, whatever the size of the corpus).

Defined results: a null or empty text is its end token alone; without training texts every count is zero; a null id is held
out (crc32 of the empty text is 0); repeated rows count as often as they occur and each get a row; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
import tempfile
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_BYTES, Scratch, crc32_mod, give_back, id_and_text, ship
from .elias_fano import EliasFano

FOLDS = 10
NAMED = (1 << 17) - 3
SHORTLIST: int | None = None
UNKNOWN, END, BEGIN, FIRST = 0, 1, 2, 3  # ids; words of the short list follow, then, from HASHED on, the hashed words of a block, row or shard
BITS = 17
HASHED = 1 << BITS
SLOT_BITS = BITS + 1  # places of words in the order of shards: ids, then the first bits of hashes
DISCOUNT = 0.75
STEP = 1 / 512
SHARD_TOKENS = 3_000_000
BLOCK_TOKENS = 2_000_000
HASHED_WEIGHT = 2  # tokens after a hashed word count as so many: hardly two share a word, a pair or a context, so a trie holds more for each
PIECE = 1 << 19  # tokens in a row at most: with three hashed words each, its ids stay below 2^21 and a trigram is 63 bits
END_WORD = b""
_FLUSH = 300_000


def tokens(raw: bytes) -> list[bytes]:
    return raw.lower().split()  # bytes: lower-cases A-Z alone


# ---- packed blocks


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted 64-bit integers: differences, byte planes, zstandard."""
    d = np.diff(keys.astype(np.uint64), prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64).astype(np.int64)


def pack_small(values: np.ndarray) -> bytes:
    v = values.astype(np.uint32)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(v.view(np.uint8).reshape(-1, 4).T).tobytes())


def unpack_small(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.uint32).ravel().astype(np.int64)


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    if not sum(map(len, keys)):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    return k[first], np.add.reduceat(c, first)


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where the rows of sorted columns change."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def in_order(v: np.ndarray, u: np.ndarray, w: np.ndarray, bits: int) -> np.ndarray:
    """The order of trigrams of ids of so many bits."""
    if 3 * bits > 63:
        return np.lexsort((w, u, v))
    key = v.astype(np.int64)
    for x in (u, w):
        key <<= bits
        key |= x
    return np.argsort(key, kind="stable")


def one_of(parts: list[tuple], names: np.ndarray | None = None) -> tuple:
    """Merges counted n-grams (names, bits, context, w, counts), or rows of them as packed, whose ids from HASHED on are places in their own sorted
    ``names`` (hashes). The context is two ids of ``bits`` bits, or one. ``names``: more for the result. The list is used up."""
    own = [p[0] if len(p) == 5 else unpack_sorted(p[0]).view(np.uint64) for p in parts]
    names = np.unique(np.concatenate([*own, np.empty(0, np.uint64) if names is None else names]))
    bits = (HASHED + len(names)).bit_length()
    n = sum(map(size_of, parts))
    whole = 3 * bits <= 63  # then one key holds the context and w
    key, word, count, at = np.empty(n, np.int64), np.empty(0 if whole else n, np.int64), np.empty(n, np.int64), 0
    while parts:
        p = parts.pop()
        known, b, ctx, w, c = p if len(p) == 5 else learned(*p)
        to = np.concatenate([np.arange(HASHED), HASHED + np.searchsorted(names, known)])
        here = slice(at, at + len(c))
        at += len(c)
        key[here] = to[ctx >> b] << bits | to[ctx & ((1 << b) - 1)]
        count[here] = c
        if whole:
            key[here] <<= bits
            key[here] |= to[w]
        else:
            word[here] = to[w]
    key, word, count = key[:at], word[:at], count[:at]
    order = np.argsort(key, kind="stable") if whole else np.lexsort((word, key))
    key, count = key[order], count[order]
    word = word if whole else word[order]
    first = runs(key) if whole else runs(key, word)
    key, count = key[first], np.add.reduceat(count, first) if len(first) else count
    return (names, bits, key >> bits, key & ((1 << bits) - 1), count) if whole else (names, bits, key, word[first], count)


def size_of(part: tuple) -> int:
    return len(part[4]) if len(part) == 5 else zstandard.frame_content_size(part[2]) // 8


def opened(names: bytes, keys: bytes, counts: bytes) -> tuple:
    known, key = unpack_sorted(names).view(np.uint64), unpack_sorted(keys)
    bits = (HASHED + len(known)).bit_length()
    return known, bits, key >> bits, key & ((1 << bits) - 1), unpack_small(counts)


def learned(names: bytes, keys: bytes, counts: bytes) -> tuple:
    """Those n-grams of a row that occur in training texts."""
    known, bits, ctx, w, c = opened(names, keys, counts)
    c = c[: len(w)]
    has = c > 0
    return known, bits, ctx[has], w[has], c[has]


# ---- job 1: word counts


def _count(batches):
    from collections import Counter

    held, texts = Counter(), 0

    def block():
        return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "c"])

    for b in batches:
        for text in b.column("text").cast(pa.binary()):
            held.update(tokens(text.as_py()))
            texts += 1
            if len(held) > _FLUSH:
                yield block()
                held.clear()
    if texts:
        held[END_WORD] += texts
        yield block()


def word_counts(training: DataFrame) -> DataFrame:
    """(word, c) over all rows of ``training(text)``; the empty word is the end token."""
    return training.select("text").mapInArrow(_count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Lexicon:
    """The short list with its counts, the totals, and the cuts of the shards. ``closed``: the words outside the list are one class."""

    def __init__(self, words: list[bytes], counts: np.ndarray, total: int, distinct: int, closed: bool):
        self.words, self.total, self.distinct, self.closed = words, total, distinct, closed
        self.c = np.zeros(FIRST + len(words), np.int64)
        own = dict(zip(words, range(len(words))))
        at_end = own.get(END_WORD)  # always there if there is a training text
        self.c[FIRST:] = counts
        self.c[END] = counts[at_end] if at_end is not None else 0
        if at_end is not None:
            self.c[FIRST + at_end] = 0
        outside = total - int(self.c[1:].sum())
        self.c[UNKNOWN] = outside if closed else 0
        self.hashed = 0 if closed else outside  # tokens
        self.rest = distinct - len(words)  # known words outside the short list
        z = total + 0.1 * (distinct + 1)
        self.base = np.log10((self.c + 0.1) / z)
        self.base[UNKNOWN] = self.base[BEGIN] = 0.0
        self.class_mass = float(outside + 0.1 * (self.rest + 1))
        self.p1 = (self.c + 0.1) / z
        self.p1[UNKNOWN], self.p1[BEGIN] = self.class_mass / z, 0.0
        self.z = z
        self._shards()

    def _shards(self):
        """Cuts of the contexts (v, u) into shards of about SHARD_TOKENS tokens; words too frequent for one shard are cut by u."""
        weight = np.zeros(2 * HASHED)
        weight[: len(self.c)] = self.c
        weight[BEGIN] = weight[END]  # every text begins once
        weight[END] = 0  # no token follows an end
        weight[HASHED:] = HASHED_WEIGHT * self.hashed / HASHED
        self.n_shards = max(1, int(-(-weight.sum() // SHARD_TOKENS)))
        most = max(1.0, weight.sum() / self.n_shards)
        by_u = np.cumsum(weight) / max(1.0, weight.sum())
        cuts, self.heavy, held = [0], {}, 0.0
        for v in np.flatnonzero(weight).tolist():
            if weight[v] > 1.25 * most and v < HASHED:
                parts = int(np.ceil(weight[v] / most))
                inner = np.unique(np.searchsorted(by_u, np.arange(1, parts) / parts))
                if held:
                    cuts.append(v << SLOT_BITS)
                first = len(cuts) - 1
                cuts.extend((v << SLOT_BITS | inner[inner > 0]).tolist())
                self.heavy[v] = (first, len(cuts) - 1)
                cuts.append((v + 1) << SLOT_BITS)
                held = 0.0
            else:
                if held and held + weight[v] > 1.25 * most:
                    cuts.append(v << SLOT_BITS)
                    held = 0.0
                held += weight[v]
        self.cuts = np.array(sorted(set(cuts)), np.int64)  # first context of each shard
        self.n_shards = len(self.cuts)
        spans = {}
        for v in self.heavy:  # shards by key, after equal cuts are merged
            lo = int(np.searchsorted(self.cuts, v << SLOT_BITS, "right")) - 1
            hi = int(np.searchsorted(self.cuts, ((v + 1) << SLOT_BITS) - 1, "right")) - 1
            spans[v] = (lo, hi)
        self.heavy = spans


# ---- job 2: blocks

_PART = "place int, shard int, kind int, block long, keys binary, counts binary, extra binary, who binary"
_NAMES = [x.split()[0] for x in _PART.split(", ")]
WORDS, PAIRS, GRAMS, ASKED, ODD, RARE, TEXTS = range(7)  # kinds, in the order in which a shard or a block needs them


def _rows(rows: list[tuple], places: np.ndarray) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
    return pa.RecordBatch.from_arrays([pa.array(places[[r[0] for r in rows]], pa.int32()), *cols], _NAMES)


def _rare_shard(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes.astype(np.uint64) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _rare_rows(kind: int, block: int, hashes: np.ndarray, values: np.ndarray, n: int) -> list[tuple]:
    """Unsigned hashes in order with a number each, cut by shard."""
    order = np.argsort(hashes, kind="stable")
    hashes, values = hashes[order], values[order]
    ends = np.searchsorted(_rare_shard(hashes, n), np.arange(n + 1))
    return [(s, kind, block, pack_sorted(hashes[a:b]), values[a:b].astype("<i8").tobytes() if kind == WORDS else pack_small(values[a:b]), None, None) for s, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())) if b > a]


def _row_ids(*columns: np.ndarray) -> tuple[np.ndarray, int, list[np.ndarray]]:
    """The hashed ones among a row's ids, in order; the bits of an id; and the ids with those numbered by their place."""
    columns = [c.astype(np.int64) for c in columns]
    used = np.unique(np.concatenate([c[c >= HASHED] for c in columns]))
    own = [np.where(c < HASHED, c, HASHED + np.searchsorted(used, c)) for c in columns] if len(used) else columns
    return used - HASHED, (HASHED + len(used)).bit_length(), own


def _blocks(shared):
    def run(batches):
        from pyspark import TaskContext

        lex: Lexicon = shared.value
        ids_of = {w: FIRST + i for i, w in enumerate(lex.words)}
        digest, task = xxhash.xxh3_64_intdigest, TaskContext.get().partitionId()
        serial = 0
        held: list[np.ndarray] = []
        doc_ids, train, rare, n_rare, base = [], [], [], [], []
        size = 0

        def close():
            nonlocal serial, size
            block = task << 32 | serial
            serial += 1
            out, sent = [], 0
            lengths = np.fromiter(map(len, held), np.int64, len(held))
            w = np.concatenate(held)
            who = np.repeat(np.arange(len(held), dtype=np.int32), lengths)
            learn = np.array(train, bool)[who]
            hashes = np.array(rare, np.uint64)
            names = np.empty(0, np.uint64)
            if not lex.closed:
                names, at = np.unique(hashes, return_inverse=True)
                odd = np.flatnonzero(w == UNKNOWN)
                w[odd] = HASHED + at
                who[odd] = np.arange(len(odd))  # for a hashed word not its text, but the number of the occurrence
            starts = np.cumsum(lengths) - lengths
            v = np.empty_like(w)
            u = np.empty_like(w)
            v[1:], u[2:] = w[:-1], w[:-2]
            v[starts] = BEGIN
            u[starts] = BEGIN
            second = starts[lengths > 1] + 1
            u[second] = BEGIN
            order = in_order(v, u, w, (HASHED + len(names)).bit_length())
            v, u, w, who, learn = (x[order] for x in (v, u, w, who, learn))
            slots = np.concatenate([np.arange(HASHED), HASHED + (names >> np.uint64(64 - BITS)).astype(np.int64)])
            first = runs(v, u)
            contexts = slots[v[first]] << SLOT_BITS | np.where(v[first] < HASHED, slots[u[first]], 0)
            ends = np.append(first, len(v))[np.append(np.searchsorted(contexts, lex.cuts), len(first))].tolist()
            del order, first, contexts
            for s in range(lex.n_shards):
                for a in range(ends[s], ends[s + 1], PIECE):
                    b = min(a + PIECE, ends[s + 1])
                    used, bits, (x, y, z) = _row_ids(v[a:b], u[a:b], w[a:b])
                    key = x << (2 * bits) | y << bits | z
                    first = runs(key)
                    counts = np.concatenate([np.add.reduceat(learn[a:b].astype(np.int64), first), np.diff(first, append=len(key))])  # in training texts, in all
                    out.append((s, GRAMS, block, pack_sorted(key[first]), pack_small(counts), pack_sorted(names[used]), pack_small(who[a:b])))
                    if sum(len(x) for x in out[-1][3:]) + sent > BATCH_BYTES:
                        yield _rows(out, lex.places)
                        out, sent = [], 0
                    else:
                        sent += sum(len(x) for x in out[-1][3:])
            for word, (lo, hi) in lex.heavy.items():
                if hi > lo:
                    a, b = np.searchsorted(v, [word, word + 1])
                    k2, c2 = np.unique(w[a:b][learn[a:b]], return_counts=True)
                    for i in range(0, len(k2), PIECE):
                        used, bits, (x,) = _row_ids(k2[i : i + PIECE])
                        packed = pack_sorted(word << bits | x), pack_small(c2[i : i + PIECE]), pack_sorted(names[used])
                        out.extend((s, PAIRS, block, *packed, None) for s in range(lo, hi + 1))
            if rare:
                out.extend(_rare_rows(RARE, block, hashes, np.arange(len(hashes)), lex.n_shards))
            ids = pa.array(doc_ids, pa.int64())
            sink = pa.BufferOutputStream()
            about = pa.RecordBatch.from_arrays([ids, pa.array(lengths), pa.array(n_rare, pa.int64()), pa.array(base, pa.float64())], ["doc_id", "n_tokens", "n_rare", "base"])
            with pa.ipc.new_stream(sink, about.schema) as writer:
                writer.write_batch(about)
            out.append((block % lex.n_shards, TEXTS, block, sink.getvalue().to_pybytes(), None, None, None))
            for x in (held, doc_ids, train, rare, n_rare, base):
                x.clear()
            size = 0
            yield _rows(out, lex.places)

        for b in batches:
            for doc_id, learns, text in zip(b.column("doc_id").to_pylist(), b.column("learns").to_pylist(), b.column("text").cast(pa.binary())):
                words = tokens(text.as_py())
                ids = np.fromiter(map(ids_of.get, words, repeat(UNKNOWN)), np.int32, len(words))
                odd = np.flatnonzero(ids == UNKNOWN).tolist()
                rare.extend([digest(words[i]) for i in odd])
                n_rare.append(len(odd))
                base.append(float(lex.base[ids].sum() + lex.base[END]))
                held.append(np.append(ids, np.int32(END)))
                doc_ids.append(doc_id)
                train.append(learns)
                size += len(ids) + 1
                if size >= BLOCK_TOKENS:
                    yield from close()
                    give_back()
        if held:
            yield from close()
        give_back()

    return run


def _counted_words(shared):
    """Counts of the words outside the short list, for the shards that are asked for them."""

    def run(batches):
        lex: Lexicon = shared.value
        short = set(lex.words)
        hashes, counts = [], []
        for b in batches:
            for w, c in zip(b.column("word").to_pylist(), b.column("c").to_pylist()):
                if w not in short:
                    hashes.append(xxhash.xxh3_64_intdigest(w))
                    counts.append(c)
            if len(hashes) > 500_000:
                yield _rows(_rare_rows(WORDS, 0, np.array(hashes, np.uint64), np.array(counts, np.int64), lex.n_shards), lex.places)
                hashes, counts = [], []
        if hashes:
            yield _rows(_rare_rows(WORDS, 0, np.array(hashes, np.uint64), np.array(counts, np.int64), lex.n_shards), lex.places)

    return run


# ---- job 3: tries

NONE = 65_535


def quantised(p: np.ndarray) -> np.ndarray:
    return np.minimum(np.round(-np.log10(np.maximum(p, 1e-120)) / STEP), 65_535).astype(np.uint16)


class Trie:
    """Levels: words v; (v, w) with p(w|v); contexts (v, u); (context, rank of w among the successors of v) with p(w|u,v)."""

    def __init__(self, k3: np.ndarray, c3: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], p1: np.ndarray, w3: np.ndarray | None = None, bits: int = BITS):
        """Trigram keys v|u|w in order with counts; ``pairs``: bigram keys v|w of the words whose trigrams are not all here. With ``w3``, the keys are
        v|u alone. ``bits``: of an id. Words outside ``p1`` have zero there, so that theirs is the part of p that does not depend on it."""
        ctx3, w3 = (k3 >> bits, k3 & ((1 << bits) - 1)) if w3 is None else (k3, w3)
        mask, v3 = (1 << bits) - 1, ctx3 >> bits
        heavy = np.unique(pairs[0] >> bits)
        own = ~np.isin(v3, heavy) if len(heavy) else np.ones(len(v3), bool)
        k2, c2 = merged([v3[own] << bits | w3[own], pairs[0]], [c3[own], pairs[1]])
        w2 = k2 & mask
        v2 = k2 >> bits
        first = np.flatnonzero(np.concatenate(([True], v2[1:] != v2[:-1]))) if len(v2) else np.empty(0, np.int64)
        words, starts = v2[first], np.append(first, len(v2))
        total = np.add.reduceat(c2, first) if len(first) else np.empty(0, np.int64)
        of = np.repeat(np.arange(len(words), dtype=np.int32), np.diff(starts))
        weight2 = DISCOUNT * np.diff(starts) / np.maximum(total, 1)
        p2 = (c2 - DISCOUNT) / total[of] + weight2[of] * np.where(w2 < len(p1), p1[np.minimum(w2, len(p1) - 1)], 0) if len(k2) else np.empty(0)
        del own, of, c2
        first3 = np.flatnonzero(np.concatenate(([True], ctx3[1:] != ctx3[:-1]))) if len(ctx3) else np.empty(0, np.int64)
        contexts, n3 = ctx3[first3], np.diff(np.append(first3, len(ctx3)))
        total3 = np.add.reduceat(c3, first3) if len(first3) else np.empty(0, np.int64)
        of3 = np.repeat(np.arange(len(contexts), dtype=np.int32), n3)
        weight3 = DISCOUNT * n3 / np.maximum(total3, 1)
        at2 = np.searchsorted(k2, v3 << bits | w3).astype(np.int32)
        p3 = (c3 - DISCOUNT) / total3[of3] + weight3[of3] * p2[at2] if len(ctx3) else np.empty(0)
        vi = np.searchsorted(words, v3).astype(np.int32)
        span = int(np.diff(starts).max(initial=0)).bit_length()
        self.span, self.bits, self._starts = span, bits, None
        self.q2, self.q3, self.b2, self.b3 = map(quantised, (p2, p3, weight2, weight3))
        triples = of3.astype(np.int64) << span | (at2 - starts[vi])
        del p2, p3, of3, at2, vi, v3, w3, ctx3, k3, c3, total3, weight3
        self.parts = {
            "words": EliasFano.of(words, 1 << bits),
            "starts": EliasFano.of(starts + np.arange(len(starts)), len(k2) + len(starts) + 1),  # strictly increasing; get() takes the index off again
            "pairs": EliasFano.of(np.searchsorted(words, v2) << bits | w2, (len(words) + 1) << bits),
            "contexts": EliasFano.of(np.searchsorted(words, contexts >> bits) << bits | (contexts & mask), (len(words) + 1) << bits),
            "triples": EliasFano.of(triples, (len(contexts) + 1) << span),
        }

    def save(self, path: str) -> None:
        arrays = [np.array([self.span, self.bits], np.int64), self.q2, self.q3, self.b2, self.b3]
        for part in self.parts.values():
            arrays.extend(part.arrays())
        with open(path, "wb") as f:
            places, at = [], 8 * (1 + 3 * len(arrays))
            for a in arrays:
                places += [at, len(a), a.dtype.itemsize]
                at += -(-a.nbytes // 8) * 8
            f.write(np.array([len(arrays), *places], np.int64).tobytes())
            for a in arrays:
                f.write(a.tobytes() + b"\0" * (-a.nbytes % 8))

    @classmethod
    def load(cls, path: str) -> "Trie":
        """The levels mapped into memory; only what is looked at is read."""
        head = np.fromfile(path, np.int64, 1)
        table = np.fromfile(path, np.int64, 1 + 3 * int(head[0]))[1:].reshape(-1, 3).tolist()
        kinds = {1: np.uint8, 2: np.uint16, 8: np.uint64}
        arrays = [np.memmap(path, kinds[size], "r", at, (n,)) if n else np.empty(0, kinds[size]) for at, n, size in table]
        self = cls.__new__(cls)
        self.span, self.bits, self._starts = int(arrays[0][0]), int(arrays[0][1]), None
        self.q2, self.q3, self.b2, self.b3 = arrays[1:5]
        self.parts = {}
        for k, name in enumerate(("words", "starts", "pairs", "contexts", "triples")):
            about, low, high = arrays[5 + 3 * k : 8 + 3 * k]
            self.parts[name] = EliasFano(int(about[0]), int(about[1]), low, high)
        return self

    def ask(self, key: np.ndarray, q1: np.ndarray) -> np.ndarray:
        """For trigram keys the quantised -log10 p, as integers; q1: the quantised p1 by word."""
        return self.look(key >> (2 * self.bits), (key >> self.bits) & ((1 << self.bits) - 1), key & ((1 << self.bits) - 1), q1)[0]

    def look(self, v: np.ndarray, u: np.ndarray, w: np.ndarray, q1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The quantised -log10 p of words w after u, v; and the quantised factor of p1 in it. Where q1 lacks w, the first is that of
        the part of p beside that factor times p1, NONE if it is zero."""
        named = w < len(q1)
        out = np.where(named, q1[np.minimum(w, len(q1) - 1)], NONE).astype(np.int64)
        factor = np.zeros(len(w), np.int64)
        vi = self.parts["words"].find(v)
        known = np.flatnonzero(vi >= 0)
        if not len(known):
            return out, factor
        vi, u, w, named = vi[known], u[known], w[known], named[known]
        at2 = self.parts["pairs"].find(vi << self.bits | w)
        two = np.where(at2 >= 0, self.q2[np.maximum(at2, 0)], 0).astype(np.int64)
        two = np.where(at2 >= 0, two, np.where(named, out[known] + self.b2[vi], NONE))
        ctx = self.parts["contexts"].find(vi << self.bits | u)
        if self._starts is None:
            self._starts = self.parts["starts"].get(np.arange(self.parts["starts"].n)).astype(np.int64) - np.arange(self.parts["starts"].n)
            self._starts = self._starts.astype(np.int32)
        both = np.flatnonzero((ctx >= 0) & (at2 >= 0))
        at3 = np.full(len(vi), -1)
        if len(both) and self.parts["triples"].n:
            at3[both] = self.parts["triples"].find(ctx[both] << self.span | (at2[both] - self._starts[vi[both]]))
        weight = np.where(ctx >= 0, self.b3[np.maximum(ctx, 0)].astype(np.int64) if len(self.b3) else 0, 0)
        back = np.where(named | (at2 >= 0), weight + two, NONE)
        out[known] = np.where(at3 >= 0, self.q3[np.maximum(at3, 0)].astype(np.int64) if len(self.q3) else 0, back)
        factor[known] = weight + self.b2[vi]
        return out, factor


_ANSWER = "block long, shard int, kind int, data binary"


def _answers(shared):
    def run(batches):
        lex: Lexicon = shared.value
        q1 = quantised(lex.p1)
        now = None
        words: list = []
        pairs: list = []
        known: tuple | None = None

        def answer(kind, shard, block, data):
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([shard], pa.int32()), pa.array([kind], pa.int32()), pa.array([data], pa.binary())], ["block", "shard", "kind", "data"])

        def waiting(spool):
            spool.seek(0)
            while True:
                try:
                    yield pickle.load(spool)
                except EOFError:
                    return

        def built(spool, folder):
            """The shard's trie, and the hashes that its ids stand for."""
            grams: list = []
            fresh = 0
            for _, *row, _ in waiting(spool):
                grams.append(tuple(row))
                fresh += size_of(grams[-1])
                if len(grams) > 1 and fresh > max(2 * SHARD_TOKENS, size_of(grams[0])):  # merge as rows come in
                    grams, fresh = [one_of(grams)], 0
            p = one_of(pairs)
            names, bits, *g = one_of(grams, p[0])
            give_back()
            p = one_of([p], names)
            p = p[2] << bits | p[3], p[4]
            ctx, w, c = g.pop(0), g.pop(0).astype(np.int32), g.pop(0)
            Trie(ctx, c, p, lex.p1, w, bits).save(f"{folder}/trie")
            del p, ctx, w, c
            give_back()
            return Trie.load(f"{folder}/trie"), names

        def asked(spool, folder):
            trie, names = built(spool, folder)
            for block, names_there, keys, counts, texts in waiting(spool):
                there, bits, ctx, w, times = opened(names_there, keys, counts)
                times = times[len(w) :]
                at = np.searchsorted(names, there)
                same = at < len(names)
                same[same] = names[at[same]] == there[same]
                to = np.concatenate([np.arange(HASHED), HASHED + np.where(same, at, len(names))])  # one id more: for words that no n-gram here has
                steps, factor = trie.look(to[ctx >> bits], to[ctx & ((1 << bits) - 1)], to[w], q1)
                who, each = unpack_small(texts), np.repeat(np.arange(len(w)), times)
                odd = w[each] >= HASHED
                at = each[~odd]
                sums = np.bincount(who[~odd], weights=steps[at]).astype(np.int64)
                at = np.flatnonzero(sums)
                yield answer(ASKED, now, block, _two(at, sums[at]))
                if odd.any():
                    at, number = each[odd], who[odd]
                    order = np.argsort(number, kind="stable")
                    at = at[order]
                    yield answer(ODD, now, block, _two(number[order], np.minimum(steps[at], NONE) << 32 | factor[at]))
            spool.seek(0)
            spool.truncate()
            del trie, names
            give_back()

        with tempfile.TemporaryDirectory() as folder, open(f"{folder}/rows", "w+b") as spool:
            for b in batches:
                for i in range(b.num_rows):
                    shard, kind, block, keys, counts, extra, who = (b.column(k)[i].as_py() for k in range(1, 8))
                    if (shard != now or kind > GRAMS) and spool.tell():
                        yield from asked(spool, folder)
                    if shard != now:
                        now, known, words, pairs = shard, None, [], []
                    if kind == WORDS:
                        words.append((unpack_sorted(keys).view(np.uint64), np.frombuffer(counts, "<i8")))
                    elif kind == PAIRS:
                        pairs.append(opened(extra, keys, counts))
                        if len(pairs) >= 16:
                            pairs = [one_of(pairs)]
                    elif kind == GRAMS:
                        pickle.dump((block, extra, keys, counts, who), spool)
                    elif kind == RARE:
                        if known is None:
                            h, c = (np.concatenate([x[k] for x in words]) if words else np.empty(0, t) for k, t in ((0, np.uint64), (1, np.int64)))
                            order = np.argsort(h, kind="stable")
                            known, words = (h[order], c[order]), []
                        h, number = unpack_sorted(keys).view(np.uint64), unpack_small(counts)
                        at = np.searchsorted(known[0], h)
                        hit = np.flatnonzero(at < len(known[0]))
                        hit = hit[known[0][at[hit]] == h[hit]]
                        c = np.zeros(len(h), np.int64)
                        c[hit] = known[1][at[hit]]
                        order = np.argsort(number, kind="stable")
                        yield answer(RARE, shard, block, _two(number[order], c[order]))
                    else:
                        yield answer(TEXTS, shard, block, keys)
            if spool.tell():
                yield from asked(spool, folder)

    return run


def _two(at: np.ndarray, values: np.ndarray) -> bytes:
    a = pack_sorted(at)
    planes = np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T)  # sums of a very long text pass 2^32
    return len(a).to_bytes(4, "little") + a + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _untwo(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:4], "little")
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[4 + n :]), np.uint8).reshape(8, -1)
    return unpack_sorted(data[4 : 4 + n]), np.ascontiguousarray(planes.T).view("<i8").ravel()


_OUT = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _texts(shared):
    """Adds up the answers of each block; its texts come last, as their kind is the largest."""

    def run(batches):
        lex: Lexicon = shared.value
        now, asked, odd, rare = None, [], [], []
        for b in batches:
            for i in range(b.num_rows):
                block, _, kind, data = (b.column(k)[i].as_py() for k in range(4))
                if block != now:
                    now, asked, odd, rare = block, [], [], []
                if kind != TEXTS:
                    {ASKED: asked, ODD: odd, RARE: rare}[kind].append(_untwo(data))
                else:
                    about = pa.ipc.open_stream(data).read_next_batch()
                    n, n_rare, base = (about.column(k).to_numpy() for k in (1, 2, 3))
                    steps, c = np.zeros(len(n), np.int64), np.zeros(int(n_rare.sum()), np.int64)
                    for at, x in asked:
                        np.add.at(steps, at, x)
                    for at, x in rare:
                        c[at] = x
                    doc = np.repeat(np.arange(len(n)), n_rare)
                    own = (c + 0.1) / lex.z
                    sums = lambda x: np.bincount(doc, weights=x, minlength=len(n))
                    known, logs = sums(c > 0).astype(np.int64), sums(np.log10(own))
                    seen = n - n_rare - int(lex.c[END] == 0) + known
                    if lex.closed:
                        within = logs + n_rare * np.log10(lex.z / lex.class_mass)
                    else:
                        for at, x in odd:
                            part = np.where(x >> 32 < NONE, 10.0 ** ((x >> 32) * -STEP), 0.0)
                            own[at] = part + 10.0 ** ((x & 0xFFFFFFFF) * -STEP) * own[at]
                        within = sums(np.log10(own))
                    yield pa.RecordBatch.from_arrays([about.column(0), pa.array(n), pa.array(seen), pa.array(base + logs), pa.array(within - steps * STEP)], [x.split()[0] for x in _OUT.split(", ")])

    return run


def _spark_hash(i: np.ndarray) -> np.ndarray:
    """Spark's hash of an int: 32-bit Murmur3 with seed 42."""
    turn = lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
    k = turn(i.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
    h = turn(np.uint32(42) ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(4)
    for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> np.uint32(shift))) * np.uint32(by)
    return (h ^ (h >> np.uint32(16))).view(np.int32)


def _places(n: int) -> np.ndarray:
    """For each of n shards a number that hashes to a partition of its own, so that no task gets several shards and another none."""
    out = np.full(n, -1)
    start, step = 0, 16 * n
    while (out < 0).any():
        parts, first = np.unique(_spark_hash(np.arange(start, start + step)) % n, return_index=True)
        out[parts] = np.where(out[parts] < 0, start + first, out[parts])
        start += step
    return out


def score_texts(docs: DataFrame, learns, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row; rows where the column expression ``learns`` (over doc_id and
    text) holds are the training texts."""
    spark = docs.sparkSession
    ship(spark)
    rows = id_and_text(docs, id_col, text_col).withColumn("learns", F.coalesce(learns, F.lit(False)))
    counts = scratch.put(word_counts(rows.filter("learns")), "counts")
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    # the end token first: it has an id whatever its count
    limit = NAMED if SHORTLIST is None else min(SHORTLIST, NAMED)
    top = counts.orderBy(F.desc(F.length("word") == 0), F.desc("c"), "word").limit(limit).toArrow()
    lex = Lexicon(top.column("word").to_pylist(), top.column("c").to_numpy(), int(sums.n), int(sums.v), SHORTLIST is not None)
    lex.places = _places(lex.n_shards)
    shared = spark.sparkContext.broadcast(lex)
    parts = rows.mapInArrow(_blocks(shared), _PART).unionByName(counts.mapInArrow(_counted_words(shared), _PART))
    answers = parts.repartition(lex.n_shards, "place").sortWithinPartitions("shard", "kind", "block").mapInArrow(_answers(shared), _ANSWER)
    found = answers.repartition("block").sortWithinPartitions("block", "kind", "shard").mapInArrow(_texts(shared), _OUT)
    return found.withColumn("train_tokens", F.lit(lex.total).cast("long"))


def op7_ngram_lm(spark: SparkSession, documents: DataFrame) -> DataFrame:
    found = score_texts(documents, crc32_mod("doc_id", FOLDS) != 0, Scratch(spark, "lm"))
    return found.select("doc_id", (crc32_mod("doc_id", FOLDS) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
