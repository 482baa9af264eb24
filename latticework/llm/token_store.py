"""Content-addressed store of token ids.

Each document's ids (its tokens, then the end id) are cut into chunks where a rolling hash over the last ``SPAN`` ids says so,
so equal runs of ids give equal chunks wherever they stand. A chunk is addressed by the BLAKE2b digest of its bytes
and stored once; a document is a recipe: its chunks' digests in order, its place in the whole id stream, and the
Merkle root over the digests. Reading recomputes every chunk's digest, every root and the whole manifest, and raises an error
where a chunk, a recipe or a row of the manifest is damaged or lost.

Layout under one folder: ``pieces/kind=chunk`` (digest, payload: the id width in bytes, 2 or 4, then little-endian ids), ``recipes/``
(in ascending order of id: doc_id, copy, start, n_tokens, digests, sizes, root) and ``manifest/`` (a Merkle tree over the recipes' roots,
up to one root for the store).

Writing takes one pass over the texts and one shuffle, of chunks and recipes together: each task sends a chunk
once, equal chunks meet in digest order, and of equal neighbours one is kept. CRC-32 values of documents are combined
from those of their chunks, so payloads are not shuffled again for reading.

Defined results: a null text is empty and has the end id alone; rows that repeat an id each have a recipe, ordered by
their content's root; a null id comes before all others; an empty table gives no rows and an empty store.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import PART, Scratch, WorkerMemory, id_and_text, parts_of, ship

END_ID = 1
SPAN = 16
MEAN_BITS = 9  # a cut every 2^9 ids on average
MIN_IDS, MAX_IDS = 128, 4096
_KEEP = 128 << 20  # bytes of words and their ids that a worker remembers
_GEAR_SEED = 20_240_607


# ---- tokens

_encoders: dict = {}


class WordEncoder:
    """Encodes texts with a tokenizer that drops white space: the distinct words of a batch are encoded apart, and remembered.

    Only for tokenizers that lower-case, part letters from punctuation, never reach over white space and mark a word's last
    token; tests compare whole texts with the library."""

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(data.decode())
        # words that are known to be plain need the model alone: no normaliser, and bytes are put as its characters here
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        put = {b: chr(b) for b in range(0x80)}
        for c in range(0xA1, 0x250):
            put.update(zip(chr(c).encode(), as_bytes.pre_tokenize_str(chr(c))[0][0]))
        self.bytes = "".join(put.get(b, "\ufffe") for b in range(256))  # the character of each byte; U+FFFE: none, an error
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.last[i] = token.endswith(_WORD_END)
        self.memory = WorkerMemory(_KEEP, 170, _encoders.clear)  # word -> its ids' bytes

    def encode_batch(self, texts: list[str], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, each text's with ``end_id`` behind them, and the end of each text among them."""
        split = pc.split_pattern(pa.array([spaced(t) for t in texts], pa.large_string()), " ")
        words = split.values
        coded = pc.dictionary_encode(words)
        distinct = objects(coded.dictionary)
        loads = self._ids_of(distinct)
        size = np.fromiter(map(len, loads), np.int64, len(loads)) // 4
        at = coded.indices.to_numpy()
        # the empty strings that the split leaves between blanks have no ids
        lengths = size[at] if len(at) else np.empty(0, np.int64)
        pool, first = np.frombuffer(b"".join(loads), np.uint32), np.cumsum(size) - size
        before = np.concatenate(([0], np.cumsum(lengths)))
        ends = before[split.offsets.to_numpy()[1:]]
        spread = np.arange(before[-1]) + np.repeat((first[at] if len(at) else lengths) - before[:-1], lengths)
        ids = pool[spread]
        return (ids, ends) if end_id is None else (np.insert(ids, ends, np.uint32(end_id)), ends + np.arange(1, len(ends) + 1))

    def _ids_of(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for part in parts_of(words):
            self.memory.turn()
            young = self.memory.young
            found = list(map(young.get, part))
            if lacks := [k for k, ids in enumerate(found) if ids is None]:
                missing = [part[k] for k in lacks]
                self._learn(missing)
                for k, ids in zip(lacks, map(young.__getitem__, missing)):
                    found[k] = ids
            out += found
        return out

    def _learn(self, words: list[str]) -> None:
        """Ids of words go into the memory: what the older generation knows is carried over, the library encodes the rest. Words of
        letters alone are encoded in one string and parted at the tokens that end a word; letters and the signs behind them are put
        together; all others are encoded one by one."""
        young, old, add = self.memory.young, self.memory.old, self.memory.add
        fresh = words
        if known := {w: ids for w, ids in zip(words, map(old.get, words)) if ids is not None}:
            add(known)
            fresh = [w for w in words if w not in known]
        plain = set(filter(_plain, fresh))
        other, pairs = set(), []
        for w in fresh:
            if w in plain:
                continue
            stem = w.rstrip(_SIGNS)
            if stem != w and _plain(stem):
                pairs.append((w, stem))
                plain.add(stem)
                other.add(w[len(stem) :])
            else:
                other.add(w)
        joined = [w for w in plain if w not in young]
        joined = [w for w in joined if not w.isascii()] + [w for w in joined if w.isascii()]
        parts = [joined[lo : lo + _JOINED] for lo in range(0, len(joined), _JOINED)]
        texts = [" ".join(part) for part in parts]
        found = self.bare.encode_batch_fast([t if t.isascii() else codecs.charmap_decode(t.encode(), "strict", self.bytes)[0] for t in texts], add_special_tokens=False)
        for part, e in zip(parts, found):
            ids = np.array(e.ids, np.uint32)
            ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            if len(ends) != len(part):
                other.update(part)
                continue
            data = ids.tobytes()
            add({w: data[i:j] for w, i, j in zip(part, [0, *ends], ends)})
        rest = [w for w in other if w not in young]
        add({w: np.array(e.ids, np.uint32).tobytes() for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False))})
        add({w: young[stem] + young[w[len(stem) :]] for w, stem in pairs})


_WORD_END = "</w>"
_JOINED = 500
_SIGNS = "!\"#$%&()*+-/:;<=>?@[\\]^_`{|}~.,"  # of ASCII all but the apostrophe, which starts endings of its own
# In texts of Latin letters alone the tokenizer's own lower-casing and splitting can be done first.
_ODD = re.compile("[^\t\n\r\x20-\x7e\xa1-\u012f\u0131-\u024f]")
_PLAIN = bytes([9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0x100)])
_INSIDE = bytes(c for c in _PLAIN if chr(c).isalnum() or chr(c) in " .,")
_BESIDE = re.compile(r"[.,](?:[^\w\s]|_)|(?:[^\w\s]|_)[.,]")


# a match for words of the letters among these that are their own lower case
_plain = re.compile("[" + "".join(c for c in map(chr, range(0x250)) if c.isalpha() and not _ODD.search(c) and c.lower() == c) + "]+").fullmatch


def objects(column: pa.Array) -> list:
    """A column of strings or bytes as Python objects, made in one call and not one scalar after the other."""
    return column.to_numpy(zero_copy_only=False).tolist()


def spaced(text: str) -> str:
    """The text with blanks alone between its words: the four white-space characters that all parties agree on become blanks, and
    whatever else may be one stays inside a word, for the library to decide. Where it is certain, letters are lower-cased, and
    a full stop or comma that stands beside no other sign, a token of its own, becomes a word of its own."""
    text = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
    try:
        raw = text.encode("latin-1")
        odd = raw.translate(None, _PLAIN)
    except UnicodeEncodeError:
        raw, odd = None, _ODD.search(text)
    if odd:
        return text
    low = text.lower()
    certain = raw is not None and not raw.translate(None, _INSIDE) and not any(x in low for x in ("..", ",,", ".,", ",."))
    return low.replace(".", " . ").replace(",", " , ") if certain or not _BESIDE.search(low) else low


def encoder(data: bytes) -> WordEncoder:
    """One encoder for a tokenizer's file in each worker process, so that what it remembers outlives a task."""
    key = hashlib.sha256(data).digest()
    enc = _encoders.get(key) or WordEncoder(data)
    enc.memory.enter()  # another tokenizer's encoder goes here
    _encoders[key] = enc
    return enc


# ---- chunks

_gear = np.random.default_rng(_GEAR_SEED).integers(0, 1 << 63, 1 << 16, dtype=np.uint64).astype(np.uint32)


def marks(ids: np.ndarray) -> np.ndarray:
    """Places behind an id whose rolling hash has its top bits zero. A hash reaches over SPAN ids, fewer than MIN_IDS, so ids that
    stand before a document's own do not matter to it."""
    if not len(ids):
        return np.empty(0, np.int64)
    # the bits that decide are among the lower 32; a sum over 2k ids is one over k and, shifted, that of the k before them
    h, k = _gear[(ids & 0xFFFF) ^ (ids >> 16)], 1
    while k < SPAN:
        before = h[:-k] << np.uint32(k)
        h[k:] += before
        k *= 2
    return np.flatnonzero(h & np.uint32(((1 << MEAN_BITS) - 1) << (SPAN - 1)) == 0) + 1


def cuts(n: int, marked: list[int]) -> list[int]:
    """Ends of the chunks of n ids: at marks, within the size limits."""
    out, start = [], 0
    for at in marked:
        while at - start > MAX_IDS:
            start += MAX_IDS
            out.append(start)
        if at - start >= MIN_IDS and at < n:
            out.append(at)
            start = at
    while n - start > MAX_IDS:
        start += MAX_IDS
        out.append(start)
    return [*out, n]


def pack(ids: np.ndarray) -> bytes:
    return b"\x02" + ids.astype("<u2").tobytes() if ids.size == 0 or int(ids.max()) < 1 << 16 else b"\x04" + ids.astype("<u4").tobytes()


def unpack(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, "<u2" if payload[0] == 2 else "<u4", offset=1).astype(np.uint32)


def address(payload: bytes) -> bytes:
    return hashlib.blake2b(payload, digest_size=16).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Pairs are hashed upwards; an odd last node moves up as it is. Leaves and inner nodes have different prefixes."""
    if not leaves:
        return hashlib.blake2b(b"", digest_size=16).digest()
    level = [hashlib.blake2b(b"\0" + x, digest_size=16).digest() for x in leaves]
    while len(level) > 1:
        up = [hashlib.blake2b(b"\1" + a + b, digest_size=16).digest() for a, b in zip(level[::2], level[1::2])]
        level = up + level[len(up) * 2 :]
    return level[0]


def _digests(joined: bytes) -> list[bytes]:
    return [joined[i : i + 16] for i in range(0, len(joined), 16)]


# ---- crc-32 of joined byte strings

_POLY = 0xEDB88320
_shifts: dict[int, int] = {}


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of CRC-32, in its reflected bit order."""
    p, m = 0, 1 << 31
    while m:
        if a & m:
            p ^= b
        b = b >> 1 ^ _POLY if b & 1 else b >> 1
        m >>= 1
    return p


def _shift(n: int) -> int:
    """x^(8n): what n further bytes do to a CRC."""
    if n not in _shifts:
        p, square, k = 1 << 31, 1 << 23, n
        while k:
            if k & 1:
                p = _times(p, square)
            square = _times(square, square)
            k >>= 1
        if len(_shifts) > 100_000:
            _shifts.clear()
        _shifts[n] = p
    return _shifts[n]


def crc_join(first: int, second: int, second_bytes: int) -> int:
    return _times(_shift(second_bytes), first) ^ second


_tables: list[np.ndarray] = []  # by k: what 2^k further bytes do to each byte of a CRC


def _table(k: int) -> np.ndarray:
    while len(_tables) <= k:
        by = _shift(1 << len(_tables))
        made = np.zeros((4, 256), np.uint32)
        for bit in range(32):
            at, low = bit // 8, 1 << bit % 8
            made[at, low : 2 * low] = made[at, :low] ^ np.uint32(_times(by, 1 << bit))
        _tables.append(made)
    return _tables[k]


def crcs_shifted(crcs: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What n further bytes, one number for each, do to CRCs: a document's is the exclusive or of its chunks' ones, each shifted by
    the bytes behind it."""
    out = crcs.astype(np.uint32)
    for k in range(int(n.max(initial=0)).bit_length()):
        at = np.flatnonzero(n >> k & 1)
        t, c = _table(k), out[at]
        out[at] = t[0][c & 255] ^ t[1][c >> 8 & 255] ^ t[2][c >> 16 & 255] ^ t[3][c >> 24]
    return out


# ---- writing

_PIECES = "kind string, key binary, doc_id long, payload binary, sizes array<int>"


_GROUP = 4 << 20  # characters that are encoded at once


def _groups(ids: list, texts: list[str]):
    lo = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size > _GROUP:
            yield ids[lo : k + 1], texts[lo : k + 1]
            lo, size = k + 1, 0
    if lo < len(texts):
        yield ids[lo:], texts[lo:]


def _pieces_of(shared, end_id: int):
    def run(batches):
        enc, sent = encoder(shared.value), set()
        for b in batches:
            for doc_ids, texts in _groups(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                kind, keys, owners, loads, sizes = [], [], [], [], []
                stream, ends = enc.encode_batch(texts, end_id)
                marked, ends = marks(stream), ends.tolist()
                narrow = stream.astype("<u2").tobytes() if int(stream.max(initial=0)) < 1 << 16 else None  # then every chunk's width is 2
                of = np.searchsorted(marked, ends, "right").tolist()
                begin = low = 0
                for doc_id, end, high in zip(doc_ids, ends, of):
                    digests, own, start = [], [], begin
                    for at in cuts(end - begin, (marked[low:high] - begin).tolist()):
                        payload = pack(stream[start : begin + at]) if narrow is None else b"\x02" + narrow[2 * start : 2 * (begin + at)]
                        digest = address(payload)
                        digests.append(digest)
                        own.append(begin + at - start)
                        start = begin + at
                        if digest not in sent:
                            if len(sent) > 200_000:  # only a saving: a chunk that is sent again meets its equal later
                                sent.clear()
                            sent.add(digest)
                            kind.append("chunk"), keys.append(digest), owners.append(None), loads.append(payload), sizes.append(None)
                    kind.append("recipe"), keys.append(merkle_root(digests)), owners.append(doc_id), loads.append(b"".join(digests)), sizes.append(own)
                    begin, low = end, high
                cols = [pa.array(kind, pa.string()), pa.array(keys, pa.binary()), pa.array(owners, pa.int64()), pa.array(loads, pa.binary()), pa.array(sizes, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in _PIECES.split(", ")])

    return run


def _without_equal_neighbours(batches):
    """In key order, of equal chunks the first stays; recipes all stay."""
    last = None
    for b in batches:
        key, chunk = b.column("key"), pc.equal(b.column("kind"), "chunk").to_numpy(zero_copy_only=False)
        if chunk.any():  # they come before all recipes
            stay = ~chunk
            stay[0] |= key[0].as_py() != last
            stay[1:] |= pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False)
            last = key[int(np.count_nonzero(chunk)) - 1].as_py()
            b = b if stay.all() else b.filter(pa.array(stay))
        yield b


FAN = 1024  # entries under one node of the manifest


def _nodes(batches):
    for b in batches:
        roots = [merkle_root([bytes(r["root"]) for r in sorted(x, key=lambda r: r["at"])]) for x in b.column("roots").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("level", "part", "node", "n_recipes")), pa.array(roots, pa.binary())], ["level", "part", "node", "n_recipes", "root"])


_NODE = "level int, part int, node long, n_recipes long, root binary"


def _tree(recipes: DataFrame) -> DataFrame:
    """Merkle nodes over ``recipes(part, copy, root)``: at level 0 one for each FAN recipes of a part, in their order, at the next one for
    each FAN nodes, until a part has one; at last one for the store. No list is longer than FAN but the last, one root for each part."""
    most = recipes.agg(F.max("copy")).first()[0] or 0
    below = recipes.select("part", (F.col("copy").cast("long") - 1).alias("at"), F.lit(1).cast("long").alias("n_recipes"), "root")
    level, out = 0, None
    while True:
        node = (F.col("at") / FAN).cast("long")
        groups = below.groupBy("part", node.alias("node")).agg(F.sum("n_recipes").alias("n_recipes"), F.collect_list(F.struct("at", "root")).alias("roots"))
        made = groups.select(F.lit(level).alias("level"), "part", "node", "n_recipes", "roots").mapInArrow(_nodes, _NODE)
        out = made if out is None else out.unionByName(made)
        below = made.select("part", F.col("node").alias("at"), "n_recipes", "root")
        most = -(-most // FAN)
        level += 1
        if most <= 1:
            break
    top = below.agg(F.sum("n_recipes").alias("n_recipes"), F.collect_list(F.struct(F.col("part").alias("at"), "root")).alias("roots")).filter("n_recipes is not null")
    return out.unionByName(top.select(F.lit(level).alias("level"), F.lit(-1).alias("part"), F.lit(0).cast("long").alias("node"), "n_recipes", "roots").mapInArrow(_nodes, _NODE))


def write_store(docs: DataFrame, tokenizer_path: str, path: str, scratch: Scratch, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes, cuts and stores all rows of ``docs`` under ``path``."""
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer_path, "rb") as f:  # a file of fixed size, on the driver
        shared = spark.sparkContext.broadcast(f.read())
    pieces = id_and_text(docs, id_col, text_col).mapInArrow(_pieces_of(shared, end_id), _PIECES)
    # recipes are dealt by id and root, so that many copies of one document do not meet in one task
    place = F.when(F.col("kind") == "chunk", F.xxhash64("key")).otherwise(F.xxhash64("doc_id", "key"))
    met = pieces.withColumn("place", place).repartition("place").sortWithinPartitions("kind", "key").drop("place")
    raw = f"{path}/pieces"
    met.mapInArrow(_without_equal_neighbours, _PIECES).write.option("compression", "zstd").partitionBy("kind").parquet(raw)
    kinds = spark.read.schema("key binary, doc_id long, payload binary, sizes array<int>, kind string").parquet(raw)
    recipes = kinds.filter("kind = 'recipe'").select("doc_id", F.col("key").alias("root"), F.col("payload").alias("digests"), "sizes", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_tokens"))
    dealt = scratch.put(recipes.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("root")).withColumn("part", F.spark_partition_id()), "dealt")
    # starts: a running sum inside each range, after the sum of all ranges before it (one row for each range)
    sums = dealt.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    order = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "root")
    rows = dealt.join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.coalesce(F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("copy", F.row_number().over(order))
    rows = rows.select("part", "copy", "doc_id", "start", "n_tokens", "digests", "sizes", "root")
    rows.write.option("compression", "zstd").parquet(f"{path}/recipes")
    scratch.free(dealt)
    made = spark.read.schema(rows.schema).parquet(f"{path}/recipes")
    _tree(made.select("part", "copy", "root")).write.parquet(f"{path}/manifest")
    scratch.remove(f"{raw}/kind=recipe")


# ---- reading

_RECIPE = "part int, copy int, doc_id long, start long, n_tokens long, digests binary, sizes array<int>, root binary"


def _checked_chunks(batches):
    for b in batches:
        n, crc = [], []
        for key, load in zip(objects(b.column("digest")), objects(b.column("payload"))):
            if address(load) != key:
                raise ValueError(f"chunk {key.hex()} does not match its digest")
            ids = unpack(load)
            n.append(len(ids))
            crc.append(zlib.crc32(ids.astype("<u4", copy=False)))
        yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(n, pa.int32()), pa.array(crc, pa.int64())], ["digest", "n", "crc"])


def _recipe_rows(batches):
    """(part, copy, doc_id, start, n_tokens, seq, digest) for each chunk of each recipe; roots are verified."""
    for b in batches:
        digests: list[bytes] = []
        first = [0]
        for doc_id, joined, root in zip(b.column("doc_id").to_pylist(), objects(b.column("digests")), objects(b.column("root"))):
            own = _digests(joined)
            if merkle_root(own) != root:
                raise ValueError(f"recipe of {doc_id} does not match its root")
            digests += own
            first.append(len(digests))
        first = np.array(first)
        of = np.repeat(np.arange(b.num_rows), np.diff(first))
        cols = [*(b.column(c).take(pa.array(of)) for c in ("part", "copy", "doc_id", "start", "n_tokens")), pa.array((np.arange(len(of)) - first[of]).astype(np.int32)), pa.array(digests, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["part", "copy", "doc_id", "start", "n_tokens", "seq", "digest"])


def _documents(batches):
    for b in batches:
        lists = b.column("chunks")
        seq, n, crc = lists.flatten().flatten()
        if n.null_count:
            raise ValueError("a recipe names a chunk that is not in the store")
        count = pc.list_value_length(lists).to_numpy()
        of = np.repeat(np.arange(len(count)), count)
        order = np.lexsort((seq.to_numpy(), of))
        n, crc = n.to_numpy().astype(np.int64)[order], crc.to_numpy()[order]
        behind = np.cumsum(n)  # ids up to each chunk's end; each list has a chunk, as each document has an end id
        ends = np.cumsum(count) - 1
        sizes = np.diff(behind[ends], prepend=0)
        if (sizes != b.column("n_tokens").to_numpy()).any():
            raise ValueError("a recipe and its chunks differ in length")
        shifted = crcs_shifted(crc, 4 * (behind[ends][of] - behind))
        crcs = np.bitwise_xor.reduceat(shifted, ends + 1 - count).astype(np.int64) if len(of) else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def _recipe_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_RECIPE).parquet(f"{path}/recipes").mapInArrow(_recipe_rows, "part int, copy int, doc_id long, start long, n_tokens long, seq int, digest binary")


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("key binary, payload binary, kind string").parquet(f"{path}/pieces").filter("kind = 'chunk'").select(F.col("key").alias("digest"), "payload")


def verify_manifest(spark: SparkSession, path: str) -> None:
    """Raises an error unless the manifest is what the stored recipes give."""
    ship(spark)
    stored = spark.read.schema(_NODE).parquet(f"{path}/manifest")
    recipes = spark.read.schema(_RECIPE).parquet(f"{path}/recipes").select("part", "copy", "root")
    names = ["level", "part", "node"]
    both = _tree(recipes).withColumnsRenamed({"n_recipes": "n", "root": "r"}).join(stored, names, "full")
    if bad := both.filter(~(F.col("n").eqNullSafe(F.col("n_recipes")) & F.col("r").eqNullSafe(F.col("root")))).select(*names).limit(1).collect():
        raise ValueError(f"the manifest and the recipes differ at {bad[0]}")


def read_digests(spark: SparkSession, path: str, scratch: Scratch) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    ship(spark)
    verify_manifest(spark, path)
    known = scratch.put(_chunks(spark, path).mapInArrow(_checked_chunks, "digest binary, n int, crc long"), "checked")
    rows = _recipe_chunks(spark, path).join(known, "digest", "left")
    docs = rows.groupBy("part", "copy", "doc_id", "start", "n_tokens").agg(F.collect_list(F.struct("seq", "n", "crc")).alias("chunks"))
    return docs.mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and the ids themselves, rebuilt from recipes and chunks; every chunk is checked against its digest."""
    ship(spark)
    verify_manifest(spark, path)

    def rebuild(batches):
        for b in batches:
            ids = []
            for n, chunks in zip(b.column("n_tokens").to_pylist(), b.column("chunks").to_pylist()):
                parts = []
                for c in sorted(chunks, key=lambda c: c["seq"]):
                    if c["payload"] is None:
                        raise ValueError("a recipe names a chunk that is not in the store")
                    if address(c["payload"]) != c["digest"]:
                        raise ValueError(f"chunk {c['digest'].hex()} does not match its digest")
                    parts.append(unpack(c["payload"]))
                ids.append(np.concatenate(parts).astype(np.int32))
                if len(ids[-1]) != n:
                    raise ValueError("a recipe and its chunks differ in length")
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "start", "ids"])

    rows = _recipe_chunks(spark, path).join(_chunks(spark, path), "digest", "left")
    docs = rows.groupBy("part", "copy", "doc_id", "start", "n_tokens").agg(F.collect_list(F.struct("seq", "digest", "payload")).alias("chunks"))
    return docs.mapInArrow(rebuild, "doc_id long, start long, ids array<int>")


def op8_token_store(spark: SparkSession, documents: DataFrame) -> DataFrame:
    import public_tokenizers

    scratch = Scratch(spark, "tokens")
    path = scratch.path("store")
    write_store(documents, public_tokenizers.path("word_bpe_49k.json"), path, scratch)
    return read_digests(spark, path, scratch)
