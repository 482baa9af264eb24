"""SimHash components, suffix matches and decontamination against brute force."""

import itertools
import random
from collections import defaultdict

import xxhash

from latticework.llm import decontam, simhash, suffix_dedup
from latticework.llm.common import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in texts], SCHEMA)


def words_text(r, n, vocab=400):
    return " ".join(f"w{r.randrange(vocab)}" for _ in range(n))


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    parts = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in parts]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h)) if h else 0


def plain_components(items):
    """Smallest id reachable over links of 3 bits, by repeated passes."""
    fps = {}
    for i, f in items:
        fps.setdefault(f, []).append(i)
    label = {f: min(v) for f, v in fps.items()}
    moved = True
    while moved:
        moved = False
        for a, b in itertools.combinations(fps, 2):
            if (a ^ b).bit_count() <= 3 and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                moved = True
    return {i: label[f] for i, f in items}


def test_components_against_brute_force(spark):
    r = random.Random(3)
    long = words_text(r, 900)
    texts = [(k, words_text(r, r.randint(1, 60))) for k in range(10, 40)]
    for k in range(40, 80):  # near copies, each with one word of many changed
        w = long.split()
        w[r.randrange(900)] = f"x{k}"
        texts.append((k, " ".join(w)))
    texts += [(90, ""), (91, "  \n"), (92, texts[0][1].upper()), (93, texts[0][1]), (94, "A b"), (95, "é É"), (96, " x y z t")]
    got = {x.doc_id: (x.fingerprint, x.component_id) for x in simhash.op1_simhash(spark, table(spark, [*texts, (97, None)])).collect()}
    fps = [(i, plain_fingerprint(t)) for i, t in [*texts, (97, None)]]
    comp = plain_components(fps)
    assert got == {i: (f"{f:016x}", comp[i]) for i, f in fps}
    assert got[97] == ("0" * 16, comp[90]) and len({comp[k] for k in range(40, 80)}) < 40


def test_links_and_long_chains(spark):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(60)]
    chain = [base[0]]
    for _ in range(25):  # each three bits from the one before: one component with a long diameter
        x = chain[-1]
        for b in r.sample(range(64), 3):
            x ^= 1 << b
        chain.append(x)
    values = list({*base, *chain, *(b ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for b in base), 0, (1 << 64) - 1, 7, 15})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.pigeonring_links(spark.createDataFrame([(v,) for v in signed], "fp long"))
    got = {frozenset((x.a, x.b)) for x in links.collect()}
    assert got == {frozenset((signed[i], signed[j])) for i, j in itertools.combinations(range(len(values)), 2) if (values[i] ^ values[j]).bit_count() <= 3}
    from latticework.llm.components import connected_components

    nodes = spark.createDataFrame([(f, k) for k, f in enumerate(signed)], "node long, w long")
    found = {x.node: x.w_min for x in connected_components(links, nodes, Scratch(spark, "test")).collect()}
    want = plain_components(list(zip(range(len(values)), values)))
    linked = {f for pair in got for f in pair}
    assert found == {f: want[k] for k, f in enumerate(signed) if f in linked}


def test_one_of_each_stays(spark):
    docs = table(spark, [(5, "a b c d"), (2, "A B c d"), (9, "totally other words here now"), (None, "a b c d"), (2, "A B c d")])
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns and sorted((x.doc_id for x in kept.collect()), key=str) == [2, 2, 9, None]


def plain_matches(texts):
    places = defaultdict(set)
    for i, t in texts:
        w = (t or "").encode().split()
        for k in range(len(w) - suffix_dedup.LEAST + 1):
            places[tuple(w[k : k + suffix_dedup.LEAST])].add((i, k))
    out = defaultdict(set)
    for v in places.values():
        if len({i for i, _ in v}) > 1:
            for i, k in v:
                out[i].add((k, *min(v)))
    return out


def test_repeated_passages_against_brute_force(spark):
    r = random.Random(7)
    a, b = words_text(r, 80), words_text(r, 51)
    texts = [(k, words_text(r, r.randint(0, 200))) for k in range(20)]
    texts += [(20, f"{words_text(r, 30)} {a} {words_text(r, 5)}"), (21, f"{a}\n\n{words_text(r, 90)}"), (22, f"{words_text(r, 9)} {b} {words_text(r, 9)} {a}"), (23, f"{b} end"), (24, a), (25, a), (26, f"{' '.join(a.split()[:60])} {words_text(r, 60)}")]
    texts += [(27, f"{words_text(r, 10)} {(w := words_text(r, 55))} {w}"), (28, "the same line " * 60), (29, "the same line " * 70), (30, ""), (31, " ".join(a.split()[:49]))]
    rows = suffix_dedup.op10_suffix_dedup(spark, table(spark, [*texts, (32, None), (None, a), (24, a)])).collect()
    got = defaultdict(set)
    for x in rows:
        assert x.n_words >= suffix_dedup.LEAST
        for k in range(x.n_words - suffix_dedup.LEAST + 1):
            got[x.doc_id].add((x.start_word + k, x.rep_doc_id, x.rep_start_word + k))
    assert got == plain_matches(texts)
    assert 27 not in got and 31 not in got


def test_key_collisions_and_partition_borders_change_nothing(spark):
    """Four keys for all suffixes, and many partitions, so that stretches of equal words cross their borders."""
    r = random.Random(17)
    common = words_text(r, 70)
    texts = [(k, f"{words_text(r, r.randint(0, 60))} {' '.join(common.split()[k % 7 : 70 - k % 5])} {words_text(r, r.randint(0, 60))}") for k in range(150)]
    texts += [(200 + k, words_text(r, 90)) for k in range(20)] + [(300 + k, " ".join(texts[k][1].split()[k:])) for k in range(30)]
    docs, want = table(spark, texts), plain_matches(texts)
    def matches(**options):
        got = defaultdict(set)
        for x in suffix_dedup.repeated_passages(docs, Scratch(spark, "test"), **options).collect():
            for k in range(x.n_words - suffix_dedup.LEAST + 1):
                got[x.doc_id].add((x.start_word + k, x.rep_doc_id, x.rep_start_word + k))
        return got
    assert matches(key_bits=2) == want
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert matches() == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_cutting_keeps_first_occurrences_and_clean_texts(spark):
    r = random.Random(8)
    a = words_text(r, 60)
    docs = table(spark, [(1, f"start {a} end"), (2, f"other\n {a}\tlast  words"), (3, a), (4, "clean  text\n\n stays"), (5, None), (6, "")])
    docs = docs.selectExpr("*", "1 as mark", "2 as spans", "3 as place")
    out = suffix_dedup.cut_repeats(docs)
    assert out.columns == docs.columns
    got = {x.doc_id: (x.text, x.n_chars) for x in out.collect()}
    assert got[1][0] == f"start {a} end" and got[2] == ("other\tlast  words", 17) and 3 not in got and got[4][0] == "clean  text\n\n stays" and got[5] == (None, None) and got[6] == ("", 0)


def test_wand_equals_full_scoring():
    r = random.Random(1)
    items = [(k, ". ".join(words_text(r, r.randint(3, 20), 60) for _ in range(2))) for k in range(150)]
    ix = decontam.ItemIndex(items)
    for threshold in (0.2, 0.5, 0.8):
        for _ in range(60):
            terms = sorted(r.sample(range(len(ix.terms)), 25))
            full = defaultdict(float)
            for t in terms:
                for d, x in zip(ix.docs[t], ix.impacts[t]):
                    full[d] += x
            got = ix.search(terms, threshold)
            assert [d for d, _ in got] == sorted(d for d, s in full.items() if s >= threshold - 1e-9)
            assert all(abs(s - full[d]) < 1e-9 for d, s in got)


def test_leaks_against_brute_force(spark):
    r = random.Random(2)
    items = [(k, f"{words_text(r, 25, 2000)}. {words_text(r, 9, 2000)}.") for k in range(40)] + [(40, "Single short"), (41, ""), (42, None)]
    docs = [(k, f"{words_text(r, r.randint(0, 400), 2000)} {items[k % 40][1] if k % 3 == 0 else ''} {words_text(r, 150, 2000)}") for k in range(60)]
    docs += [(60, items[1][1].split(". ")[0]), (61, items[2][1].upper()), (62, None), (63, ""), (64, "single   SHORT!"), (None, items[3][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontam.find_leaks(table(spark, docs), bench).collect()}
    want = set()
    for i, t in docs:
        have = decontam.words_of(t or "")
        for j, item in items:
            q, a = decontam.question_and_answer(item or "")
            share = []
            for part in (q, a):
                n = min(5, len(part))
                here = {tuple(have[k : k + n]) for k in range(len(have) - n + 1)} if n else set()
                sh = decontam.shingles(part)
                share.append(len(sh & here) / len(sh) if sh else 1.0)
            if (q or a) and min(share) >= 0.8:
                want.add((i, j))
    assert got == want and len(want) > 20
    kept = decontam.drop_leaks(table(spark, docs), bench)
    assert sorted(x.doc_id for x in kept.collect() if x.doc_id is not None) == sorted(i for i, _ in docs if i is not None and i not in {w[0] for w in want})


def test_benchmark_in_shards_gives_the_same(spark, monkeypatch):
    r = random.Random(4)
    items = [(k, words_text(r, 30, 3000)) for k in range(30)]
    docs = table(spark, [(k, f"{words_text(r, 200, 3000)} {items[k][1]}") for k in range(20)])
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = lambda: {(x.doc_id, x.item_id, round(x.score, 9), x.passage_start) for x in decontam.find_leaks(docs, bench).collect()}
    whole = found()
    monkeypatch.setattr(decontam, "INDEX_BYTES", 1500)
    assert found() == whole and {x[:2] for x in whole} == {(k, k) for k in range(20)}
    assert decontam.drop_leaks(docs, bench).count() == 0 and decontam.find_leaks(docs, bench.filter("item_id < 0")).count() == 0


def test_long_texts_in_groups_of_passages(monkeypatch):
    r = random.Random(6)
    items = [(k, words_text(r, 30, 3000)) for k in range(30)]
    text = " ".join(f"{words_text(r, 150, 3000)} {items[k % 30][1]}" for k in range(60))
    ix = decontam.ItemIndex(items)
    whole = ix.leaks(text)
    monkeypatch.setattr(decontam, "GROUP", 3)
    assert ix.leaks(text) == whole and {x[0] for x in whole} == set(range(30))


def plain_copies(items):
    """Smallest id reachable over pairs of texts with a Jaccard similarity of five-word shingles of 0.8 or more."""
    sets = {}
    for i, t in items:
        w = (t or "").encode().lower().split()
        sets.setdefault(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))), []).append(i)
    label = {s: min(v) for s, v in sets.items()}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 5 * len(a & b) >= 4 * len(a | b)]
    moved = True
    while moved:
        moved = False
        for a, b in links:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                moved = True
    return {i: label[s] for s, v in sets.items() for i in v}


def test_stage_removes_near_copies_beyond_three_bits(spark):
    r = random.Random(11)
    centre = words_text(r, 200, 5000).split()
    texts = [(k, words_text(r, r.randint(1, 300))) for k in range(10)] + [(10, ""), (11, None), (12, "a b"), (13, "A  b"), (14, " ".join(centre))]
    for k in range(15, 75):  # about one to seven words changed: similarities on both sides of 0.8
        w = list(centre)
        for _ in range(r.randint(1, 7)):
            w[r.randrange(200)] = f"x{r.random()}"
        texts.append((k, " ".join(w)))
    want = plain_copies(texts)
    assert {x.doc_id for x in simhash.keep_one_of_each(table(spark, texts)).collect()} == {i for i in want if want[i] == i}
    far = [i for i, t in texts[15:] if (plain_fingerprint(t) ^ plain_fingerprint(texts[14][1])).bit_count() > 3 and want[i] == 14]
    assert far and {want[i] for i, _ in texts[15:]} != {14}


def test_stage_takes_fingerprints_of_five_words(spark, monkeypatch):
    """Without the min-hash keys, the pairs within three bits are still found, and decided by their overlap."""
    import numpy as np

    from latticework.llm import near_copies

    monkeypatch.setattr(near_copies, "band_keys", lambda hashes: np.empty(0, np.int64))
    r = random.Random(12)
    texts = []
    for k in range(0, 80, 2):
        w = words_text(r, 400, 5000).split()
        texts.append((k, " ".join(w)))
        for _ in range(r.randint(1, 3)):
            w[r.randrange(400)] = f"x{r.random()}"
        texts.append((k + 1, " ".join(w)))
    texts += [(80, ""), (81, "a b c d e"), (82, "a b c d e " * 2)]
    fp = {i: simhash.text_fingerprint(t.encode(), near_copies.SHINGLE) for i, t in texts}
    near = {k + 1 for k in range(0, 80, 2) if (fp[k] ^ fp[k + 1]).bit_count() <= 3}
    assert 5 < len(near) < 40 and {i for i in near if fp[i] != fp[i - 1]}
    assert {x.doc_id for x in simhash.keep_one_of_each(table(spark, texts)).collect()} == {i for i, _ in texts} - near


def test_stage_finds_all_overlaps_of_a_table(spark, data):
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{data}/documents.parquet").collect()]
    want = plain_copies(rows)
    assert {x.doc_id for x in simhash.keep_one_of_each(table(spark, rows)).collect()} == {i for i in want if want[i] == i}
