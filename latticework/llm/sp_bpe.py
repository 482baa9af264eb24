"""Exact SentencePiece BPE encoding by backtracking, and decoding.

A model of merge type merges, while it can, the adjacent pair whose concatenation is the piece of best score (of equal
ones the leftmost). Its result is the only segmentation in which every two adjacent tokens are compatible: merging
their joint text from single characters gives those two tokens again. So the encoder takes, from left to
right, the longest piece that an Aho-Corasick automaton found at a position, checks compatibility with the token
before it by re-merging the pair (remembered), tries the next shorter piece if it fails, and steps back if none is
left; a bitfield marks positions from which no rest can be encoded, so none is tried twice.

Texts are split into units beforehand: no piece holds a word-start mark after another character, so no merge
crosses the place before a mark; characters outside the vocabulary (written as bytes) stand alone. Where a
vocabulary breaks this rule the whole text is one unit. Units recur, and a worker remembers a bounded number of them.

Runs of word-start marks are pieces of one equal score whose merges depend on the whole run; units that hold
such a run are merged directly, in priority order.

Defined results: null text is the empty text; the empty text has no tokens; every other text starts with the
dummy prefix that the model asks for; repeated rows and null ids each give a row; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WorkerMemory, id_and_text, parts_of, ship

MARK = "▁"
_KEEP = 160 << 20  # bytes of units that a worker remembers
_PAIRS = 300_000  # pairs of tokens that it remembers
_SHORT = 32
_NONE = float("-inf")
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


_codecs: dict[str, Codec] = {}


def read_model(data: bytes) -> dict:
    """Pieces (text, score, kind) and the settings used here, from the model's protocol-buffer bytes."""

    def fields(buf: bytes):
        i = 0

        def varint(i):
            x = shift = 0
            while True:
                c = buf[i]
                x |= (c & 127) << shift
                i, shift = i + 1, shift + 7
                if c < 128:
                    return x, i

        while i < len(buf):
            tag, i = varint(i)
            kind = tag & 7
            if kind == 0:
                value, i = varint(i)
            else:
                n, i = (8, i) if kind == 1 else (4, i) if kind == 5 else varint(i)
                value, i = buf[i : i + n], i + n
            yield tag >> 3, value

    import struct

    out = {"pieces": [], "model_type": 1, "byte_fallback": False, "normalizer": "", "dummy_prefix": True, "strip": True, "escape": True, "rules": b""}
    for no, value in fields(data):
        if no == 1:
            p = dict(fields(value))
            out["pieces"].append((p.get(1, b"").decode(), struct.unpack("<f", p.get(2, b"\0\0\0\0"))[0], p.get(3, NORMAL)))
        elif no == 2:
            t = dict(fields(value))
            out["model_type"], out["byte_fallback"] = t.get(3, 1), bool(t.get(35, 0))
        elif no == 3:
            s = dict(fields(value))
            out |= {"normalizer": s.get(1, b"").decode(), "rules": s.get(2, b""), "dummy_prefix": bool(s.get(3, 1)), "strip": bool(s.get(4, 1)), "escape": bool(s.get(5, 1))}
    return out


class Codec:
    def __init__(self, model: dict):
        if model["model_type"] != 2 or not model["byte_fallback"] or model["rules"] or model["strip"] or not model["escape"] or not model["dummy_prefix"]:
            raise ValueError("only merge-type models with byte fallback, identity normalisation and a dummy prefix are covered")
        if any(kind in (USER_DEFINED, UNUSED) for _, _, kind in model["pieces"]):
            raise ValueError("user-defined and unused pieces are not covered")
        self.pieces = [p for p, _, _ in model["pieces"]]
        self.ids = {p: i for i, (p, _, kind) in enumerate(model["pieces"]) if kind == NORMAL}
        self.score = {p: s for p, s, kind in model["pieces"] if kind == NORMAL}
        self.byte_ids = [-1] * 256
        self.byte_of = {}
        for i, (p, _, kind) in enumerate(model["pieces"]):
            if kind == BYTE:
                self.byte_ids[int(p[3:-1], 16)] = i
                self.byte_of[i] = int(p[3:-1], 16)
        self.silent = {i for i, (_, _, kind) in enumerate(model["pieces"]) if kind == CONTROL}
        self.special = self.silent | set(self.byte_of)
        self.chars = {c for p in self.ids for c in p}
        whole = any(MARK in p.lstrip(MARK) for p in self.ids) or any(c not in self.ids for c in self.chars)
        gap = "\n" if "\n" not in self.chars else ""
        self.inner = {x + y for p in self.ids for x, y in zip(p, p[1:])}
        self.unit = re.compile(r"(?s).+" if whole else rf"{MARK}+[^{MARK}{gap}]*|[^{MARK}{gap}]+" + (r"|\n" if gap else ""))
        self.runs = any(set(p) == {MARK} and len(p) > 1 for p in self.ids)
        self.direct_only = whole
        self.odd = re.compile((f"{MARK}{{2}}|" if self.runs else "") + "[^" + re.escape("".join(sorted(self.chars))) + "]")
        self.most = max(map(len, self.ids))
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in self.ids), "") for p in self.ids}
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.memory = WorkerMemory(_KEEP, 380, _codecs.clear)  # unit -> its ids as text, their number, its surface

    def merge(self, text: str) -> list[str]:
        """The definition: merge adjacent symbols by best score, then leftmost."""
        if len(text) > _SHORT:
            return self._merge_long(text)
        sym, get = list(text), self.score.get
        joint = [get(x + y, _NONE) for x, y in zip(sym, sym[1:])]
        while joint:
            best = max(joint)
            if best == _NONE:
                break
            i = joint.index(best)
            sym[i : i + 2] = [sym[i] + sym[i + 1]]
            del joint[i]
            if i < len(joint):
                joint[i] = get(sym[i] + sym[i + 1], _NONE)
            if i:
                joint[i - 1] = get(sym[i - 1] + sym[i], _NONE)
        return sym

    def _merge_long(self, text: str) -> list[str]:
        """The same with a heap, for texts on which scanning for the best pair would be quadratic."""
        sym, n = list(text), len(text)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i):
            j = after[i]
            if j < n and (s := self.score.get(sym[i] + sym[j])) is not None:
                heapq.heappush(heap, (-s, i, j, sym[i] + sym[j]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, j, joint = heapq.heappop(heap)
            if not sym[i] or not sym[j] or after[i] != j or sym[i] + sym[j] != joint:
                continue
            sym[i], sym[j], after[i] = joint, "", after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [s for s in sym if s]

    def compatible(self, a: str, b: str) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > _PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merge(a + b) == [a, b]
        return known

    def longest_at(self, text: str, place: int) -> str:
        """The longest piece that starts at ``place``: the automaton's trie bounds its length."""
        size = self.automaton.longest_prefix(text[place : place + self.most])
        while text[place : place + size] not in self.ids:
            size -= 1
        return text[place : place + size]

    def backtrack(self, text: str) -> list[str] | None:
        """Tokens of a text whose characters are all in the vocabulary."""
        # the first path: the automaton's longest matches, as far as neighbours are compatible
        tokens: list[str] = []
        known, last, place, n = self.pairs.get, "", 0, len(text)
        for end, size in self.automaton.iter_long(text):
            token = text[end - size + 1 : end + 1]
            if tokens:
                fits = known((last, token))
                if not (self.compatible(last, token) if fits is None else fits):
                    break
            tokens.append(token)
            last, place = token, end + 1
        failed = 0
        trying = self.longest_at(text, place) if place < n else ""
        while place < n:
            while trying:
                end = place + len(trying)
                if not failed >> end & 1:
                    if not tokens:
                        break
                    fits = known((tokens[-1], trying))
                    if self.compatible(tokens[-1], trying) if fits is None else fits:
                        break
                trying = self.shorter[trying]
            if trying:
                tokens.append(trying)
                place = end
                trying = self.longest_at(text, place) if place < n else ""
            else:
                failed |= 1 << place
                if not tokens:
                    return None
                back = tokens.pop()
                place -= len(back)
                trying = self.shorter[back]
        return tokens

    def encode_unit(self, unit: str) -> list[int]:
        if not (self.direct_only or self.odd.search(unit)):
            ids = self.ids
            tokens = self.backtrack(unit)
            if tokens is None:  # every character is a piece and the merged form is always compatible, so there is a way
                raise ValueError(f"no way through {unit!r}")
            return [ids[t] for t in tokens]
        out: list[int] = []
        run: list[str] = []

        def close():
            if run:
                part = "".join(run)
                tokens = None if self.direct_only or (self.runs and MARK * 2 in part) else self.backtrack(part)
                out.extend(self.ids[t] for t in (self.merge(part) if tokens is None else tokens))
                run.clear()

        if self.direct_only:
            for t in self.merge(unit):
                out.extend([self.ids[t]] if t in self.ids else [self.byte_ids[x] for x in t.encode()])
            return out
        for c in unit:
            if c in self.chars:
                run.append(c)
            else:
                close()
                out.extend(self.byte_ids[x] for x in c.encode())
        close()
        return out

    def surface(self, ids: list[int]) -> str:
        """The text of tokens in the middle of a sequence; runs of byte tokens are read as UTF-8."""
        if not any(map(self.special.__contains__, ids)):
            return "".join([self.pieces[i] for i in ids]).replace(MARK, " ")
        parts, held = [], bytearray()
        for i in ids:
            if (x := self.byte_of.get(i)) is not None:
                held.append(x)
                continue
            if held:
                parts.append(held.decode("utf-8", "replace"))
                held.clear()
            if i not in self.silent:
                parts.append(self.pieces[i])
        if held:
            parts.append(held.decode("utf-8", "replace"))
        return "".join(parts).replace(MARK, " ")

    def _known(self, unit: str) -> tuple[str, int, str]:
        got = self.memory.young.get(unit) or self.memory.old.get(unit)
        if got is None:
            if unit[-2:] not in self.inner and len(unit) > 1 and unit[-1] in self.chars and unit[-2] in self.chars:
                # no piece holds these two characters side by side, so no merge joins them: a word and its punctuation
                stem, end = self._known(unit[:-1]), self._known(unit[-1])
                got = (f"{stem[0]},{end[0]}", stem[1] + end[1], stem[2] + end[2])
            else:
                ids = self.encode_unit(unit)
                got = (",".join(map(str, ids)), len(ids), self.surface(ids))
        self.memory.put(unit, got)
        return got

    def split(self, text: str) -> list[str]:
        return self.unit.findall((MARK + text).replace(" ", MARK)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for u in self.split(text) for i in self.encode_unit(u)]

    def decode(self, ids: list[int]) -> str:
        text = self.surface(ids)
        return text[1:] if ids and self.pieces[ids[0]].startswith(MARK) else text

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, sha-256 of the ids joined by commas, sha-256 of the decoded text."""
        got: list[tuple[str, int, str]] = []
        for units in parts_of(self.split(text)):
            self.memory.turn()
            known, new = self.memory.young.get, self._known
            got += [known(u) or new(u) for u in units]
        decoded = "".join([g[2] for g in got])
        if decoded.startswith(" "):  # the dummy prefix
            decoded = decoded[1:]
        sha = hashlib.sha256
        return sum([g[1] for g in got]), sha(",".join([g[0] for g in got]).encode()).hexdigest(), sha(decoded.encode()).hexdigest()


def codec(data: bytes) -> Codec:
    """One codec for each model in each worker process, so that what it remembers outlives a task."""
    key = hashlib.sha256(data).hexdigest()
    c = _codecs.get(key) or Codec(read_model(data))
    c.memory.enter()  # another model's codec goes here
    _codecs[key] = c
    return c


def encode_and_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row; the model file (fixed size) is read once, on the driver."""
    spark = docs.sparkSession
    ship(spark)
    with open(model_path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batches):
        c = codec(shared.value)
        for b in batches:
            rows = [c.digest(t.as_py()) for t in b.column("text")]
            n, ids, dec = ([r[k] for r in rows] for k in range(3))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(dec, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_ids(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id and the ids themselves."""
    spark = docs.sparkSession
    ship(spark)
    with open(model_path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batches):
        c = codec(shared.value)
        for b in batches:
            ids = pa.array([c.encode(t.as_py()) for t in b.column("text")], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), ids], ["doc_id", "ids"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, ids array<int>")


def op5_sentencepiece(spark: SparkSession, documents: DataFrame) -> DataFrame:
    import public_tokenizers

    return encode_and_decode(documents, public_tokenizers.path("piece_bpe_32k.model"))
