"""Tokenizers, token store, language model, toxicity."""

import hashlib
import math
import random
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tokenizers

from latticework.llm import ngram_lm, sp_bpe, token_store, toxicity
from latticework.llm.common import Scratch, crc32_mod
from latticework.llm.elias_fano import EliasFano

SP = public_tokenizers.path("piece_bpe_32k.model")
WORD = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "   ", "\n", "a", " a  b", "▁x ▁▁y", "\x00a", "日本 𠀀 ﬁ é", "x" * 3000, "word.\nNext, word", "<s> </s> <0x0A> <unk>", "a b c\x1cd\x0be", "İSTANBUL Σς ΑΣ", "it's don't we'll 12 3.5", "a\r\n\tb ", "<|endoftext|>x", "é café"]


def table(spark, texts):
    return spark.createDataFrame(list(texts), "doc_id long, text string")


def sample(spark, data):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]


def test_sentencepiece_equals_the_library(spark, data):
    sp = sentencepiece.SentencePieceProcessor(model_file=SP)
    texts = sample(spark, data) + [(10_000 + k, t) for k, t in enumerate(ODD)]
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in sp_bpe.encode_and_decode(table(spark, [*texts, (20_000, None)]), SP).collect()}
    for i, t in [*texts, (20_000, "")]:
        ids = sp.encode(t)
        assert got[i] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()), t
    ids = {r.doc_id: r.ids for r in sp_bpe.encode_ids(table(spark, texts[-len(ODD) :]), SP).collect()}
    assert ids == {i: sp.encode(t) for i, t in texts[-len(ODD) :]}


def test_sentencepiece_on_random_texts():
    sp = sentencepiece.SentencePieceProcessor(model_file=SP)
    codec = sp_bpe.codec(open(SP, "rb").read())
    r = random.Random(11)
    letters = [*" \n\tabcdeñé▁日\U00020000\x00.,'", "  ", "   ", "the", "ing", " th", "́"]
    for _ in range(4000):
        t = "".join(r.choice(letters) for _ in range(r.randint(0, 40)))
        ids = sp.encode(t)
        assert codec.encode(t) == ids and codec.decode(ids) == sp.decode(ids)


def test_backtracking_equals_merging():
    codec = sp_bpe.codec(open(SP, "rb").read())
    r = random.Random(12)
    for _ in range(3000):
        t = "▁" + "".join(r.choice("abcdehinorstuäß") for _ in range(r.randint(1, 14)))
        assert codec.backtrack(t) == codec.merge(t) == codec._merge_long(t)


def test_store_equals_the_library_and_round_trips(spark, data):
    tok = tokenizers.Tokenizer.from_file(WORD)
    texts = sample(spark, data) + [(10_000 + k, t) for k, t in enumerate(ODD)] + [(5, "the same again"), (5, "the same again"), (None, "no id")]
    docs = table(spark, [*texts, (20_000, None)])
    scratch = Scratch(spark, "test")
    path = scratch.path("store")
    token_store.write_store(docs, WORD, path, scratch)
    rows = token_store.read_digests(spark, path, scratch).collect()
    want, start = [], 0
    streams = defaultdict(list)
    for i, t in [*texts, (20_000, "")]:
        streams[i].append(np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4"))
    got = sorted(rows, key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in [*texts, (20_000, "")]), key=lambda i: (i is not None, i))
    for r in got:
        assert r.start == start
        start += r.n_tokens
        assert (r.n_tokens, r.ids_crc32) in [(len(s), zlib.crc32(s.tobytes())) for s in streams[r.doc_id]]
    for r in token_store.read_ids(spark, path).collect():
        assert any(r.ids == s.tolist() for s in streams[r.doc_id])
    chunks = spark.read.parquet(f"{path}/pieces/kind=chunk")
    assert chunks.count() == chunks.select("key").distinct().count()
    levels = spark.read.parquet(f"{path}/manifest").groupBy("level").agg({"n_recipes": "sum"}).collect()
    assert len(levels) >= 2 and all(x[1] == len(got) for x in levels)
    del want


def test_store_finds_damage(spark):
    scratch = Scratch(spark, "test")
    path = scratch.path("store")
    token_store.write_store(table(spark, [(1, "some words"), (2, "other words")]), WORD, path, scratch)
    broken = spark.read.parquet(f"{path}/pieces/kind=chunk").selectExpr("key", "doc_id", "concat(payload, x'0000') as payload", "sizes").collect()
    scratch.remove(f"{path}/pieces/kind=chunk")
    spark.createDataFrame(broken, "key binary, doc_id long, payload binary, sizes array<int>").write.parquet(f"{path}/pieces/kind=chunk")
    with pytest.raises(Exception, match="does not match its digest"):
        token_store.read_digests(spark, path, scratch)


@pytest.mark.parametrize("what", ["pieces/kind=chunk", "recipes", "manifest"])
def test_store_finds_losses(spark, monkeypatch, what):
    monkeypatch.setattr(token_store, "FAN", 4)
    scratch = Scratch(spark, "test")
    path = scratch.path("store")
    token_store.write_store(table(spark, [(k, f"some words {k}") for k in range(40)]), WORD, path, scratch)
    assert token_store.read_digests(spark, path, scratch).count() == token_store.read_ids(spark, path).count() == 40
    kept = spark.read.parquet(f"{path}/{what}")
    rows, schema = kept.collect(), kept.schema
    scratch.remove(f"{path}/{what}")
    spark.createDataFrame(rows[1:], schema).write.parquet(f"{path}/{what}")
    for read in (lambda: token_store.read_digests(spark, path, scratch), lambda: token_store.read_ids(spark, path)):
        with pytest.raises(Exception, match="not in the store|differ"):
            read().collect()


def test_words_beside_signs_and_odd_letters():
    tok = tokenizers.Tokenizer.from_file(WORD)
    enc = token_store.encoder(open(WORD, "rb").read())
    r = random.Random(21)
    letters = [*" \n\tabcDÉñßsÿ.,.,'-&$3²½_", "  ", ". ", ", ", "'s", "n't", "日", "\u00a0", "\x1c", "\x85", "\u2003", "ſ", "Ǆ", "İ"]
    for n in (20, 28, len(letters)):
        texts = ["".join(r.choice(letters[:n]) for _ in range(r.randint(0, 30))) for _ in range(3000)]
        ids, ends = enc.encode_batch(texts)
        for t, a, b in zip(texts, [0, *ends.tolist()], ends.tolist()):
            assert ids[a:b].tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_equal_runs_share_chunks_and_crcs_join():
    r = np.random.default_rng(1)
    shared = r.integers(0, 49_000, 20_000).astype(np.uint32)
    def chunks(ids):
        ends = token_store.cuts(len(ids), token_store.marks(ids).tolist())
        assert ends[-1] == len(ids) and all(0 < b - a <= token_store.MAX_IDS for a, b in zip([0, *ends], ends))
        return [ids[a:b].tobytes() for a, b in zip([0, *ends], ends)]
    one, two = chunks(np.concatenate([r.integers(0, 9, 777).astype(np.uint32), shared])), chunks(np.concatenate([shared, r.integers(0, 9, 500).astype(np.uint32)]))
    assert len(set(one) & set(two)) >= len(set(one)) - 4
    assert token_store.cuts(0, []) == [0] and token_store.cuts(10_000, token_store.marks(np.full(10_000, 70_000, np.uint32)).tolist())[-1] == 10_000
    a, b = r.bytes(1000), r.bytes(333)
    assert token_store.crc_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b) and token_store.crc_join(zlib.crc32(a), 0, 0) == zlib.crc32(a)
    big = np.array([5, 70_000], np.uint32)
    assert token_store.unpack(token_store.pack(big)).tolist() == [5, 70_000]


def python_calls(run):
    """What run gives, and how many Python functions were called for it."""
    calls = 0
    def count(frame, event, arg):
        nonlocal calls
        calls += event == "call"
    sys.setprofile(count)
    try:
        return run(), calls
    finally:
        sys.setprofile(None)


def test_store_calls_no_function_for_each_word_or_chunk():
    tok = tokenizers.Tokenizer.from_file(WORD)
    enc = token_store.encoder(open(WORD, "rb").read())
    r = random.Random(77)
    words = ["".join(r.choice("abcdehinorstuäßéœ") for _ in range(12)) for _ in range(20_000)]
    text = " ".join(words)
    (ids, _), calls = python_calls(lambda: enc.encode_batch([text]))
    assert ids.tolist() == tok.encode(text, add_special_tokens=False).ids and calls < 2_000

    g = np.random.default_rng(77)
    streams = [g.integers(0, 49_000, n).astype("<u4") for n in (1, 2, 200, 5_000, *g.integers(1, 3_000, 400).tolist())]
    rows = []
    for s in streams:
        ends = token_store.cuts(len(s), np.sort(g.integers(1, len(s) + 1, len(s) // 150)).tolist())
        chunks = [{"seq": k, "n": b - a, "crc": zlib.crc32(s[a:b].tobytes())} for k, (a, b) in enumerate(zip([0, *ends], ends))]
        r.shuffle(chunks)
        rows.append(chunks)
    kind = pa.list_(pa.struct([("seq", pa.int32()), ("n", pa.int32()), ("crc", pa.int64())]))
    n, at = pa.array([len(s) for s in streams], pa.int64()), pa.array(range(len(streams)), pa.int64())
    batch = pa.RecordBatch.from_arrays([at, at, n, pa.array(rows, kind)], ["doc_id", "start", "n_tokens", "chunks"])
    list(token_store._documents(iter([batch])))  # tables are made once
    cut = [batch.slice(3), batch.slice(0, 0)]
    (got, empty), calls = python_calls(lambda: list(token_store._documents(iter(cut))))
    assert got.column("ids_crc32").to_pylist() == [zlib.crc32(s.tobytes()) for s in streams[3:]] and empty.num_rows == 0 and calls < 300
    rows[7] = [{"seq": 0, "n": None, "crc": None}]
    for changed, what in ((pa.array(rows, kind), "not in the store"), (pa.array(rows[:7] + [rows[0]] + rows[8:], kind), "differ in length")):
        with pytest.raises(ValueError, match=what):
            list(token_store._documents(iter([batch.set_column(3, "chunks", changed)])))


def test_marks_and_equal_neighbours():
    ids = np.random.default_rng(3).integers(0, 70_000, 30_000).astype(np.uint32)
    gear = np.random.default_rng(token_store._GEAR_SEED).integers(0, 1 << 63, 1 << 16, dtype=np.uint64)[(ids & 0xFFFF) ^ (ids >> 16)]
    for n in (0, 1, 2, 3, 15, 16, 17, 30_000):
        h = np.zeros(n, np.uint64)
        for k in range(min(n, token_store.SPAN)):
            h[k:] += gear[: n - k] << np.uint64(k)
        assert token_store.marks(ids[:n]).tolist() == (np.flatnonzero((h >> np.uint64(15)) & np.uint64(511) == 0) + 1).tolist()
    rows = [("chunk", b"a"), ("chunk", b"a"), ("chunk", b"b"), ("chunk", b"b"), ("chunk", b"c"), ("recipe", b"c"), ("recipe", b"c"), ("recipe", b"d")]
    for step in range(1, 9):
        batches = [pa.RecordBatch.from_pylist([{"kind": k, "key": v} for k, v in rows[lo : lo + step]]) for lo in range(0, 8, step)]
        got = [(x["kind"], x["key"]) for b in token_store._without_equal_neighbours(iter([batches[0].slice(0, 0), *batches])) for x in b.to_pylist()]
        assert got == [rows[k] for k in (0, 2, 4, 5, 6, 7)]


def test_elias_fano():
    r = np.random.default_rng(2)
    for n, universe in ((0, 10), (1, 1), (1, 1 << 50), (1000, 1000), (5000, 1 << 20), (3000, 1 << 51)):
        v = np.unique(r.integers(0, universe, n)) if n < universe else np.arange(n)
        ef = EliasFano.of(v, universe)
        ask = np.concatenate([v, r.integers(0, universe, 2000), [0, universe - 1]]).astype(np.int64)
        assert (ef.successor(ask) == np.searchsorted(v, ask)).all()
        at = np.searchsorted(v, ask)
        inside = at < len(v)
        want = np.where(inside & (v[np.minimum(at, max(0, len(v) - 1))] == ask), at, -1) if len(v) else np.full(len(ask), -1)
        assert (ef.find(ask) == want).all() and (ef.get(np.arange(len(v))) == v).all()


def plain_lm(rows, short):
    tokens = {i: (t or "").encode().lower().split() + [b""] for i, t in rows}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 10]
    c = Counter(w for i in train for w in tokens[i])
    n, v = sum(c.values()), len(c)
    z = n + 0.1 * (v + 1)
    top = {w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:short]} | {b""}
    name = lambda w: w if w in top else None
    rare = n - sum(c[w] for w in top)
    mass = rare + 0.1 * (v - len(top & set(c)) + 1)
    c3, c2, t3, t2, n3, n2 = Counter(), Counter(), defaultdict(set), defaultdict(set), Counter(), Counter()
    for i in train:
        x = ["^", "^", *map(name, tokens[i])]
        for k in range(2, len(x)):
            c3[tuple(x[k - 2 : k + 1])] += 1
            c2[x[k - 1], x[k]] += 1
            n3[x[k - 2], x[k - 1]] += 1
            n2[x[k - 1]] += 1
            t3[x[k - 2], x[k - 1]].add(x[k])
            t2[x[k - 1]].add(x[k])

    def p(a, b, w):
        q = (mass if w is None else c[w] + 0.1) / z
        if n2[b]:
            q = max(c2[b, w] - 0.75, 0) / n2[b] + 0.75 * len(t2[b]) / n2[b] * q
        if n3[a, b]:
            q = max(c3[a, b, w] - 0.75, 0) / n3[a, b] + 0.75 * len(t3[a, b]) / n3[a, b] * q
        return q

    out = {}
    for i, x in tokens.items():
        y = ["^", "^", *map(name, x)]
        score = sum(math.log10(p(y[k - 2], y[k - 1], y[k])) for k in range(2, len(y))) + sum(math.log10((c[w] + 0.1) / mass) for w in x if name(w) is None)
        out[i] = (zlib.crc32(str(i).encode()) % 10 == 0, len(x), sum(c[w] > 0 for w in x), n, sum(math.log10((c[w] + 0.1) / z) for w in x), score)
    return out


@pytest.mark.parametrize("short,shard", [(1 << 17, 3_000_000), (40, 400), (300, 5000)])
def test_language_model_against_plain_counts(spark, data, monkeypatch, short, shard):
    monkeypatch.setattr(ngram_lm, "SHORTLIST", short)
    monkeypatch.setattr(ngram_lm, "SHARD_TOKENS", shard)
    rows = sample(spark, data)[:60] + [(70_000, ""), (70_001, None), (70_002, "unseenword The the THE"), (70_003, "a " * 500)]
    want = plain_lm(rows, short)
    got = ngram_lm.op7_ngram_lm(spark, table(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        held, n, known, total, base, score = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert abs(r.base_score - base) < 1e-6 and abs(r.score - score) < 0.004 * n


@pytest.mark.parametrize("named,shard", [(None, 60_000), (40, 400), (300, 5000), (1, 3_000_000)])
def test_language_model_keeps_contexts_of_every_word(spark, data, monkeypatch, named, shard):
    monkeypatch.setattr(ngram_lm, "SHARD_TOKENS", shard)
    if named is None:  # more words than ids, under the module's own settings; each twice, in the same surroundings
        own = [" ".join(f"w{k}" for k in range(i, i + 2500)) for i in range(0, 150_000, 2500)]
        rows = list(enumerate(own + own[::-1] + ["w7 w8 w9 unseen w149000 w149001 w5", "w140000 w140001 " * 30]))
    else:  # most words by their hash
        monkeypatch.setattr(ngram_lm, "NAMED", named, raising=False)
        monkeypatch.setattr(ngram_lm, "PIECE", 50, raising=False)
        rows = sample(spark, data)[:60] + [(70_000, ""), (70_001, None), (70_002, "unseenword The the THE"), (70_003, "a " * 500), (70_004, "odd1 odd2 odd3 odd1 odd2 odd4")]
    want = plain_lm(rows, 1 << 40)
    got = ngram_lm.op7_ngram_lm(spark, table(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        held, n, known, total, base, score = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert abs(r.base_score - base) < 1e-6 * n and abs(r.score - score) < 0.004 * n


def test_ngrams_merge_in_any_steps():
    r = np.random.default_rng(4)

    def part(n_names, n):
        names, bits = np.unique(r.integers(0, 1 << 62, n_names).astype(np.uint64)), (ngram_lm.HASHED + n_names).bit_length()
        v, u, w = (ngram_lm.HASHED + r.integers(-3, len(names), n) for _ in range(3))
        return names, bits, v << bits | u, w, r.integers(1, 9, n)

    def plain(names, bits, ctx, w, c):
        word = lambda i: int(i) if i < ngram_lm.HASHED else (int(names[i - ngram_lm.HASHED]),)
        out = Counter()
        for x, k, m in zip(ctx.tolist(), w.tolist(), c.tolist()):
            out[word(x >> bits), word(x & ((1 << bits) - 1)), word(k)] += m
        return out

    a, b, wide = part(5, 300), part(9, 300), part(2_200_000, 2000)  # the last with ids too wide for one key
    for parts in ([a, b], [a, b, wide], [a, a, b]):
        want = sum((plain(*p) for p in parts), Counter())
        got = ngram_lm.one_of(list(parts))
        assert plain(*got) == want and len(got[4]) == len(want)
        steps = ngram_lm.one_of([ngram_lm.one_of(list(parts[:1])), *parts[1:]])
        assert all((x == y).all() for x, y in zip(got[2:], steps[2:]))


def test_language_model_without_training_texts(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    got = ngram_lm.op7_ngram_lm(spark, table(spark, [(held[0], "a b"), (held[1], None)])).collect()
    assert all(r.held_out and r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 for r in got)
    assert ngram_lm.op7_ngram_lm(spark, table(spark, [])).count() == 0


def test_trie_saved_and_mapped(tmp_path):
    r = np.random.default_rng(3)
    k3 = np.unique(r.integers(3, 12, 400) << 34 | r.integers(3, 12, 400) << 17 | r.integers(1, 12, 400))
    c3 = r.integers(1, 9, len(k3))
    p1 = np.full(20, 0.05)
    trie = ngram_lm.Trie(k3, c3, (np.empty(0, np.int64), np.empty(0, np.int64)), p1)
    trie.save(str(tmp_path / "trie"))
    ask = np.concatenate([k3, r.integers(0, 19, 500) << 34 | r.integers(0, 19, 500) << 17 | r.integers(0, 19, 500)])
    assert (ngram_lm.Trie.load(str(tmp_path / "trie")).ask(ask, ngram_lm.quantised(p1)) == trie.ask(ask, ngram_lm.quantised(p1))).all()


def check_toxicity(spark, docs, labels, recall):
    got = toxicity.op6_toxicity(spark, docs, labels)
    assert got.count() == docs.count()
    rows = got.join(labels, "doc_id").filter("held_out and toxic is not null").select("toxic", "predicted", "score").collect()
    positive = [r for r in rows if r.toxic]
    assert len(positive) >= 40 and sum(r.predicted for r in positive) >= recall * len(positive) and sum(r.predicted for r in rows if not r.toxic) <= 0.01 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)
    assert got.filter(crc32_mod("doc_id", 5) == 0).count() == got.filter("held_out").count()


def test_toxicity_on_the_held_out_fold(spark):
    """The table has some 350 toxic rows to learn from, and marks texts whose words recur in few of them."""
    folder = "/root/testdata/sf0.1"
    check_toxicity(spark, spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"), 0.85)


def test_toxicity_with_enough_labels(spark):
    """5,000 texts of 10 to 2,000 words, each toxic one with some of 30 words that are inflected and put anywhere."""
    r = random.Random(13)
    plain = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    bad = ["".join(r.choice("klmnop") for _ in range(r.randint(4, 7))) for _ in range(30)]
    docs, labels = [], []
    for k in range(5000):
        words = [r.choice(plain) for _ in range(r.choice((10, 60, 300, 2000)))]
        if toxic := int(r.random() < 0.15):
            for _ in range(max(3, len(words) // 40)):
                words.insert(r.randrange(len(words)), r.choice(bad) + r.choice(("", "s", "ed", "ing")))
        docs.append((k, " ".join(words)))
        labels.append((k, 1, toxic))
    check_toxicity(spark, table(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), 0.95)


def test_training_equals_a_plain_loop():
    r = random.Random(14)
    examples = [(np.array(sorted(r.sample(range(40), r.randint(1, 25)))), int(r.random() < 0.3)) for _ in range(300)]
    bias, got = toxicity.ftrl_train(examples, 3)
    z, n = Counter(), Counter()
    def weight(i):
        return 0.0 if abs(z[i]) <= toxicity.L1 else -(z[i] - math.copysign(toxicity.L1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)
    for _ in range(3):
        for at, y in examples:
            w = {i: weight(i) for i in at.tolist()}
            g = 1 / (1 + math.exp(-bias - sum(w.values()))) - y
            for i in w:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA * w[i]
                n[i] += g * g
    assert np.allclose(got[:40], [weight(i) for i in range(40)]) and not got[40:].any() and got.any()


def test_repeated_ids_do_not_grow_the_sample(spark):
    docs = table(spark, [(k % 6, f"text {k % 9}") for k in range(300)])
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(6)], "doc_id long, quality int, toxic int")
    once = table(spark, [(k, min((f"text {j % 9}" for j in range(300) if j % 6 == k), key=lambda t: spark.sql(f"select xxhash64('{t}')").first()[0])) for k in range(6)])
    assert toxicity.train(docs, labels)[0] == toxicity.train(once, labels)[0]


def test_toxicity_corner_cases(spark):
    docs = spark.createDataFrame([(1, "bad fool", 1), (2, "good day", 2), (3, None, 3), (3, "bad", 3), (None, "bad", 4)], "doc_id long, text string, _lw_score_ int")
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (2, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert len(toxicity.op6_toxicity(spark, docs, labels).collect()) == 5
    none = toxicity.op6_toxicity(spark, docs, labels.limit(0)).collect()
    assert len({r.score for r in none}) == 1 and none[0].predicted == 0
    assert toxicity.drop_toxic(docs, labels.limit(0)).columns == docs.columns
    assert toxicity.op6_toxicity(spark, docs.limit(0), labels).count() == 0


def test_shards_have_partitions_of_their_own(spark):
    from pyspark.sql import functions as F

    for n in (1, 7, 36, 500):
        places = ngram_lm._places(n)
        df = spark.createDataFrame([(int(p),) for p in places], "p int").select(F.pmod(F.hash("p"), F.lit(n)).alias("k"))
        assert sorted(r.k for r in df.collect()) == list(range(n))


def test_sums_of_very_long_texts_keep_all_bits():
    at, sums = np.array([0, 3, 9]), np.array([5, (1 << 32) + 7, 1 << 45])
    got = ngram_lm._untwo(ngram_lm._two(at, sums))
    assert (got[0] == at).all() and (got[1] == sums).all()
