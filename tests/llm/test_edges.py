"""Every operator on empty tables, null columns, repeated rows and extra columns under names used inside."""

import pytest

from latticework.llm import decontam, html_blocks, ngram_lm, quality_mcd, simhash, sp_bpe, suffix_dedup, token_store, toxicity, warc

EXTRA = ["_lw_score", "_lw_id", "_lw_spans", "_LW_mark", "ctx", "left", "key", "mark", "place", "fp", "rep", "w", "node", "label", "g", "rows", "source_", "n", "m0", "l00", "x0", "word", "c", "shard", "block", "kind", "digest", "first", "last", "spans", "type", "distance", "learns", "component_id", "payload_sha1", "row_id", "part", "tox_score", "_words", "item_id", "page"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)
PAGES = "page_id long, url string, html string, " + ", ".join(f"`{c}` string" for c in EXTRA)


def documents(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * len(EXTRA)) for r in rows], DOCS)


def operators(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g h. i j k l m."), (None, None), (1, "a b c d e f g h. i j k l m.")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0), (1, 1, 1), (None, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    return {
        "op1": lambda d: simhash.op1_simhash(spark, d), "op2": lambda d: decontam.op2_decontamination(spark, d, bench), "op3": lambda d: quality_mcd.op3_quality_mcd(spark, d),
        "op5": lambda d: sp_bpe.op5_sentencepiece(spark, d), "op6": lambda d: toxicity.op6_toxicity(spark, d, labels), "op7": lambda d: ngram_lm.op7_ngram_lm(spark, d),
        "op8": lambda d: token_store.op8_token_store(spark, d), "op10": lambda d: suffix_dedup.op10_suffix_dedup(spark, d),
        "stage1": simhash.keep_one_of_each, "stage2": lambda d: decontam.drop_leaks(d, bench), "stage6": lambda d: toxicity.drop_toxic(d, labels), "stage10": suffix_dedup.cut_repeats,
    }


PER_ROW = {"op1", "op3", "op5", "op6", "op7", "op8"}
NAMES = ["op1", "op2", "op3", "op5", "op6", "op7", "op8", "op10", "stage1", "stage2", "stage6", "stage10"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, name):
    rows = [(1, "a b c d e f g h. i j k l m.", "en", "s", 27), (1, "a b c d e f g h. i j k l m.", "en", "s", 27), (2, None, None, None, None), (None, None, None, None, None), (3, "", "en", "", 0), (None, "w " * 30_000, "de", "s", 60_000), (4, "w " * 30_000, "de", "s", 60_000)]
    got = operators(spark)[name](documents(spark, rows)).collect()
    assert len(got) == len(rows) if name in PER_ROW else len(got) <= len(rows) + 5


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, name):
    assert operators(spark)[name](documents(spark, [])).collect() == []


def test_pages(spark):
    rows = [(1, "u", "<p>x</p>" * 400), (1, "u", "<p>x</p>" * 400), (None, None, None), (2, "", "")]
    df = spark.createDataFrame([(*r, *["x"] * len(EXTRA)) for r in rows], PAGES)
    for op in (warc.op4_warc, html_blocks.op9_html_extraction):
        assert len(op(spark, df).collect()) == 4 and op(spark, df.limit(0)).collect() == []
