"""Web archives, page text, quality rules."""

import gzip
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from latticework.llm import html_blocks, quality_mcd, warc

PAGES = "page_id long, url string, html string"


def test_arc_versions():
    for version in (1, 2):
        data = warc.write_arc(version, "a.arc", [("http://x/", "19970203040506", "text/html", b"HTTP/1.0 200 OK\r\nA: b\r\n\r\n<p>\n\n</p>"), ("dns:x", "199702030405", "text/dns", b"1.2.3.4\n"), ("http://y/", "19970203", "text/html", b"")])
        records = list(warc.read_arc(data))
        assert [r.version for r in records] == [version] * 4
        made = [warc.to_warc(r, "a.arc") for r in records]
        assert [m["type"] for m in made] == ["warcinfo", "response", "resource", "resource"]
        assert made[1]["date"] == "1997-02-03T04:05:06Z" and made[2]["date"] == "1997-02-03T04:05:00Z" and made[3]["date"] == "1997-02-03T00:00:00Z"
        assert made[1]["payload"] == b"<p>\n\n</p>" and made[1]["payload_sha1"] == hashlib.sha1(b"<p>\n\n</p>").hexdigest() and made[1]["block_sha1"] != made[1]["payload_sha1"]
        assert len({m["record_id"] for m in made}) == 4 and made == [warc.to_warc(r, "a.arc") for r in warc.read_arc(data)]


@pytest.mark.parametrize("damage", [b"http://x/ 0 0 0 5\nabc", b"filedesc://a 0 0 text/plain 4\n9 0 \n", b"filedesc://a 0 0 text/plain 400\n1 0 \n"])
def test_arc_damage(damage):
    with pytest.raises(ValueError):
        list(warc.read_arc(damage))


def test_arc_files(spark, tmp_path):
    data = warc.write_arc(2, "b.arc", [("http://x/", "19970203040506", "text/html", b"HTTP/1.0 200 OK\r\n\r\nhello")])
    (tmp_path / "a.arc").write_bytes(data)
    (tmp_path / "b.arc.gz").write_bytes(gzip.compress(data[:120]) + gzip.compress(data[120:]))
    rows = warc.arc_files(spark, str(tmp_path)).filter("type = 'response'").collect()
    assert [bytes(r.payload) for r in rows] == [b"hello"] * 2


def plain_warc(rows):
    by = {}
    for i, _, html in rows:
        if html and len(html.encode()) >= 1000:
            by.setdefault(html, []).append(i)
    out = Counter()
    for i, _, html in rows:
        b = (html or "").encode()
        ids = by.get(html, [])
        best = max((x for x in ids if x is not None), default=None)
        again = len(ids) > 1 and i != best
        out[i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", best if again else None] += 1
    return out


def test_revisits_against_brute_force(spark):
    r = random.Random(1)
    big = ["é" * 500, "x\r\n\r\nWARC/1.0\r\n\r\n" * 60, "z" * 999, "y" * 1000]
    rows = [(k, f"http://h/{k}", r.choice([*big, None, "", f"page {k}" * 200, "small"])) for k in range(120)]
    rows += [(500, None, big[0]), (501, "http://a b/\n", big[3]), (None, "http://n/", big[1])]
    got = Counter(tuple(x) for x in warc.op4_warc(spark, spark.createDataFrame(rows, PAGES)).collect())
    assert got == plain_warc(rows)


def test_repeated_rows_and_empty_tables(spark):
    same = (7, "http://x/", "q" * 1500)
    got = sorted(tuple(x)[3:] for x in warc.op4_warc(spark, spark.createDataFrame([same, same, same], PAGES)).collect())
    assert [g[0] for g in got] == ["response", "revisit", "revisit"] and [g[1] for g in got] == [None, 7, 7]
    assert warc.op4_warc(spark, spark.createDataFrame([], PAGES)).count() == 0


CASES = [
    ("", ""), ("plain", None), ("<p>one</p>", None),
    ("<article><h1>T &amp; x</h1><p>a <b>b</b>\n  c<br>d</p><p>e&nbsp;f</p></article><footer>foot words here</footer>", "T & x\n\na b c d\n\ne f"),
    ("<nav><ul><li><a href='/'>Home</a></ul></nav><main><p>text here<p>more text</main><aside>side</aside>", "text here\n\nmore text"),
    ("<article><script>var a='</p>';</script><p>kept</p><style>p{}</style><!-- <p>no</p> --><p>also</article>", "kept\n\nalso"),
    ("<article><p>body text</p><div class='comments'><p>reader says a lot of things about all that, at length</p></div><form>name <input> send it</form></article>", "body text"),
    ("<div class='cookie-notice'>We use cookies on this site for many reasons</div><article><p>5 &lt; 6 & 7 < 8</p></article>", "5 < 6 & 7 < 8"),
    ("<article><p title='a > b'>quoted</p><div style='display: none'>hidden words</div></article>", "quoted"),
    ("<article><p>first</p><div class='ad'>buy this now</div><p>second</p></article", "first\n\nsecond"),
]


@pytest.mark.parametrize("page,want", CASES)
def test_main_text(page, want):
    got = html_blocks.main_text(page)
    assert got == want if want is not None else isinstance(got, str)


def nameless_page(r, tag):
    """A page without named containers, with its blocks and whether each is main text."""
    words = lambda n: " ".join(f"w{r.randrange(999)}" for _ in range(n))
    blocks = [("li", words(r.randint(1, 3)), 1, 0) for _ in range(r.randint(2, 7))]
    if r.random() < 0.4:
        blocks.append(("div", words(r.randint(3, 12)), 0, 0))
    blocks.append(("h1", words(r.randint(2, 10)), 0, 1))
    for _ in range(r.randint(1, 8)):
        blocks.append((tag, words(r.randint(15, 120)), 0, 1))
        if r.random() < 0.2:
            blocks += [("h2", words(r.randint(1, 6)), 0, 1), (tag, words(r.randint(15, 90)), 0, 1)]
    if r.random() < 0.4:
        blocks += [("li", words(r.randint(2, 8)), 1, 0) for _ in range(r.randint(2, 5))]
    blocks.append(("div", words(r.randint(3, 10)), 0, 0))
    return "<body>" + "".join(f"<{t}><a href='x'>{x}</a></{t}>" if link else f"<{t}>{x}</{t}>" for t, x, link, _ in blocks), blocks


@pytest.mark.parametrize("tag", ["p", "div"])
def test_tree_beats_names_alone_on_pages_without_names(tag):
    """Without names there is one region, so a rule by region alone keeps all or nothing: about half is right then."""
    r = random.Random(31)
    right = by_region = total = 0
    for _ in range(300):
        page, blocks = nameless_page(r, tag)
        assert len({b[4:] for b in html_blocks.text_blocks(page)}) == 1
        got = set(html_blocks.main_text(page).split("\n\n"))
        right += sum((text in got) == bool(y) for _, text, _, y in blocks)
        by_region += sum(y for *_, y in blocks)
        total += len(blocks)
    assert right >= 0.97 * total and max(by_region, total - by_region) <= 0.6 * total


def test_whole_texts_come_back():
    r = random.Random(32)
    words = lambda n: " ".join(f"w{r.randrange(999)}" for _ in range(n))
    parts = [words(5), words(50), words(30), words(20)]
    body = f"<body><h1>{parts[0]}</h1>" + "".join(f"<p>{x}</p>" for x in parts[1:])
    assert html_blocks.main_text(f"<body><p>{parts[1]}") == html_blocks.main_text(f"<body><div>{parts[1]}") == parts[1]
    for page in (body, body + "<ul><li><a href='x'>a b</a></li><li><a href='y'>c</a></li></ul>", f"<form id='f'>{body}</form>", f"<form><article>{body}</article></form>"):
        assert html_blocks.main_text(page) == "\n\n".join(parts)
    for page in ('<p title="' + ">" * 40 + '">body text', "<p data=it's>body text", "<p title='never closed>body text", '<p a="x>y" b=\'>\' c>body text'):
        assert html_blocks.main_text(page) == "body text"
    long = " ".join(f"w{k}" for k in range(300_000))
    assert html_blocks.main_text(f"<nav>menu</nav><p>{long}</p>") == long


def test_tree_fits_its_table_and_generalises():
    rows = html_blocks.labelled_rows()
    assert all((html_blocks.judge(html_blocks.TREE, x) >= 0.5) == bool(y) for x, y in rows)
    held = [(x, y) for k, (x, y) in enumerate(rows) if k % 4 == 0]
    tree = html_blocks.grow([r for k, r in enumerate(rows) if k % 4])
    assert sum((html_blocks.judge(tree, x) >= 0.5) == bool(y) for x, y in held) >= 0.85 * len(held)


def test_pages_on_the_given_table(spark, data):
    """Against the articles' own paragraphs, cut out by their tags."""
    import html

    pages = spark.read.parquet(f"{data}/pages.parquet")
    got = {r.page_id: r for r in html_blocks.op9_html_extraction(spark, pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        want = "\n\n".join(x for x in parts if x)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


def test_pages_corner_cases(spark):
    rows = [(1, None, None), (None, "u", ""), (2, "u", "<" * 2000), (2, "u", "<p " * 500), (3, "u", "<article>" + "<div>" * 3000 + "deep")]
    got = html_blocks.op9_html_extraction(spark, spark.createDataFrame(rows, PAGES)).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got) and [r.text for r in got if r.page_id == 3] == ["deep"]


WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_statistics(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    out = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))
    return (*out, out[0] < 20 or 100 * out[4] > 30 * out[0])


DOCS = "doc_id long, text string, lang string, source string, n_chars long, g string, rows int, x0 int"


def test_statistics_against_brute_force(spark):
    r = random.Random(4)
    texts = [" ".join(r.choice("ab") for _ in range(r.randint(0, 60))) for _ in range(40)]
    texts += ["", None, "\n\n \t", "one", "a b c d e f g h", "a b c d e f g h a b c d e f g h", "x " * 500, "é ü #$%\n<b>\n<b>\n \n<b>", "q\x0br\x0cs\x1ct", "l1 a\nl1 a\r\nl1 a\n" * 9]
    texts += [" ".join(f"w{k}" for k in range(30)), "ab " * 20_000]
    rows = [(k, t, None if k % 3 else "en", "s", 0, "clash", 1, 2) for k, t in enumerate(texts)]
    got = {x.doc_id: tuple(x)[1:7] for x in quality_mcd.judge(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {k: plain_statistics(t) for k, t in enumerate(texts)}


def test_outliers(spark):
    r = random.Random(5)
    def clean():
        return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(3, 7))) for _ in range(r.randint(60, 200)))
    rows = [(k, clean(), "en", "big" if k % 3 else "other", 0, "", 0, 0) for k in range(300)]
    bad = {300: " ".join(f"{w}$$$" for w in clean().split()), 301: " ".join(w * 6 for w in clean().split()), 302: "\n".join([clean()[:40]] + [f"l{k}\nsame line" for k in range(40)])}
    rows += [(k, t, "en", "big", 0, "", 0, 0) for k, t in bad.items()] + [(303, bad[300], "en", "rare", 0, "", 0, 0), (None, clean(), None, None, 0, "", 0, 0), (304, clean(), "en", "big", 0, "", 0, 0)]
    df = spark.createDataFrame(rows, DOCS)
    got = quality_mcd.op3_quality_mcd(spark, df).collect()
    kept = {x.doc_id: x.kept for x in got}
    assert len(got) == len(rows) and all(kept[k] for k in [*range(300), 304, None]) and not any(kept[k] for k in (300, 301, 302))
    assert not kept[303]  # the only row of its source, judged as its language
    again = quality_mcd.op3_quality_mcd(spark, df.repartition(7)).collect()
    assert {x.doc_id: x.distance for x in got} == {x.doc_id: x.distance for x in again}
    assert quality_mcd.op3_quality_mcd(spark, df.limit(0)).count() == 0


def test_estimate_equals_numpy(spark):
    """One concentration step from SQL sums against the same step in numpy."""
    r = np.random.default_rng(6)
    x = np.round(r.normal(0, 1, (500, 4)) @ r.normal(0, 1, (4, 4)) * 1000).astype(int)
    rows = spark.createDataFrame([("g", *map(int, v)) for v in x], "g string, x0 long, x1 long, x2 long, x3 long")
    est = quality_mcd._estimates(rows, 1.0).first()
    cov = np.cov(x.T, bias=True) + np.diag([(f * 1000) ** 2 for f in quality_mcd.FLOORS])
    low = np.linalg.cholesky(cov)
    assert np.allclose([est[f"m{i}"] for i in range(4)], x.mean(0)) and np.allclose([[est[f"l{i}{j}"] if j <= i else 0 for j in range(4)] for i in range(4)], low)
    d = rows.crossJoin(quality_mcd._estimates(rows, 1.0).drop("g")).select(quality_mcd._distance().alias("d")).collect()
    y = x - x.mean(0)
    assert np.allclose([v.d for v in d], np.einsum("ij,jk,ik->i", y, np.linalg.inv(cov), y))


def plain_mcd(x):
    """Centre, covariance and number of rows of one group, by both starts."""
    floors, n = np.array(quality_mcd.FLOORS) * 1000, len(x)
    def cov(rows, widen):
        return rows.mean(0), np.cov(rows.T, bias=True).reshape(4, 4) * widen + np.diag(floors**2)
    mid = np.percentile(x, 50, axis=0)
    starts = [(mid, np.diag((np.percentile(abs(x - mid), 50, axis=0) * 1.4826) ** 2 + floors**2)), cov(x, 1.0)]
    best = []
    for m, c in starts:
        for _ in range(quality_mcd.STEPS):
            q = np.floor(np.log1p(np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)) * 200)
            m, c = cov(x[q <= np.percentile(q, 75)], quality_mcd.CONSISTENCY)
        best.append((np.linalg.slogdet(c)[1], m, c))
    return n, *min(best, key=lambda b: b[0])[1:]


def plain_drawn(own, wider):
    (n, m, c), (_, wm, wc) = own, wider
    share = n * n / (n * n + quality_mcd.PRIOR**2)
    return n, m * share + wm * (1 - share), c * share + wc * (1 - share)


def test_verdicts_against_brute_force(spark):
    r = random.Random(9)
    def text(k):
        words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(r.randint(22, 120))]
        for _ in range(r.choice((0, 0, 0, 1, 3, 40))):
            words[r.randrange(len(words))] += "$%"
        return "\n".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9)) + "\nsame line" * r.choice((0, 0, 0, 2, 30))
    rows = [(k, text(k), "en" if k % 4 else "de", r.choice(("a", "a", "a", "b", "b", f"rare{k % 5}"))) for k in range(600)]
    got = {x.doc_id: x for x in quality_mcd.judge(spark.createDataFrame([(*x, 0, "", 0, 0) for x in rows], DOCS)).collect()}
    vectors = {}
    for k, t, lang, source in rows:
        n, chars, symbols, lines, again, failed = plain_statistics(t)
        if not failed:
            raw = (chars / n, np.log1p(100 * symbols / chars), np.log1p(100 * lines / n), np.log1p(100 * again / n))
            vectors[k] = (lang, source, np.floor(np.array(raw) * 1000 + 0.5))
    group = lambda pick: plain_mcd(np.array([x for *_, x in filter(pick, vectors.values())]))
    whole = group(lambda v: True)
    tongues = {a: plain_drawn(group(lambda v: v[0] == a), whole) for a in ("en", "de")}
    finals = {(a, b): plain_drawn(group(lambda v: v[:2] == (a, b)), tongues[a]) for a, b in {v[:2] for v in vectors.values()}}
    rejected = 0
    for k, x in got.items():
        assert x.base_failed == (k not in vectors)
        if k in vectors:
            a, b, v = vectors[k]
            _, m, c = finals[a, b]
            d = (v - m) @ np.linalg.inv(c) @ (v - m)
            assert abs(x.distance - d) <= 1e-6 * max(1, d) and x.kept == (d <= quality_mcd.CUTOFF)
            rejected += not x.kept
    assert 10 < rejected < 300 and len(finals) > 10


def test_huge_words_do_not_overflow(spark):
    rows = [(k, " ".join(["w" * 100_000] * 3 + [f"v{j}" for j in range(17)]) if k < 3 else " ".join(f"w{j}{k}" for j in range(30)), "en", "s", 0, "", 0, 0) for k in range(40)]
    got = quality_mcd.op3_quality_mcd(spark, spark.createDataFrame(rows, DOCS)).collect()
    assert {x.doc_id for x in got if not x.kept} == {0, 1, 2}
    big = spark.createDataFrame([("g", quality_mcd.MOST, 0, 0, 0)] * 9, "g string, x0 long, x1 long, x2 long, x3 long")
    assert quality_mcd._covariances(big, 1.0).first().m0 == quality_mcd.MOST


def test_quality_runs_no_python(spark, data, capsys):
    """Neither the query's own plan nor that of any table it wrote on the way."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    quality_mcd.op3_quality_mcd(spark, docs).explain()
    assert not re.search("Python|Arrow|Pandas", capsys.readouterr().out)
    quality_mcd.text_statistics(docs.withColumn("text", quality_mcd.F.coalesce("text", quality_mcd.F.lit(""))), "doc_id").explain()
    assert not re.search("Python|Arrow|Pandas", capsys.readouterr().out)
    source = open(quality_mcd.__file__).read()
    assert not re.search(r"udf|mapIn|applyIn|pandas|\.rdd|toPandas|\.collect\(|toArrow", source.split('"""', 2)[2])


def test_small_sources_and_languages_are_judged(spark):
    r = random.Random(8)
    def clean():
        return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(3, 7))) for _ in range(r.randint(60, 200)))
    bad = lambda: " ".join(f"{w}$$$" for w in clean().split())
    rows = [(k, clean(), "en", "big") for k in range(120)] + [(k, clean(), "en", "tail") for k in range(120, 140)] + [(k, clean(), "fr", "tail") for k in range(140, 160)]
    rows += [(200, bad(), "en", "tail"), (201, bad(), "fr", "tail"), (202, bad(), None, None), (203, clean(), None, None), (204, "short", "fr", "tail")]
    got = {x.doc_id: x for x in quality_mcd.op3_quality_mcd(spark, spark.createDataFrame([(*x, 0, "", 0, 0) for x in rows], DOCS)).collect()}
    assert len(got) == len(rows) and all((x.distance is None) == x.base_failed for x in got.values())
    assert {k for k, x in got.items() if not x.kept} == {200, 201, 202, 204}


def test_large_records_make_smaller_files_and_damage_is_found(spark, monkeypatch):
    from latticework.llm.common import Scratch

    monkeypatch.setattr(warc, "FILE_BYTES", 3_000_000)
    r = random.Random(3)
    rows = [(k, f"http://h/{k}", "".join(r.choice("abcdef") for _ in range(1_000_000))) for k in range(7)]
    df = spark.createDataFrame(rows, PAGES).coalesce(1)
    assert Counter(tuple(x) for x in warc.op4_warc(spark, df).collect()) == plain_warc(rows)
    scratch = Scratch(spark, "test")
    records, path = scratch.put(warc.records_of(df), "records"), scratch.path("warc")
    warc.write_warc(warc.with_revisits(records, scratch), path, warc.records_per_file(records))
    files = [bytes(x.content) for x in spark.read.format("binaryFile").load(path).select("content").collect()]
    assert len(files) >= 3 and sum(len(list(warc.read_records(f))) for f in files) == 7
    plain = warc.inflate(files[0])
    for broken in (plain[:-4], plain[:-10], plain[5:], plain.replace(b"WARC/1.0", b"XXXX/1.0", 1)):
        with pytest.raises(ValueError):
            list(warc.read_records(broken))
