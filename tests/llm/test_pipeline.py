"""The pipeline's stages on the smallest table, each against its own brute force."""

import hashlib
import importlib.util

import public_tokenizers
import pytest
import sentencepiece

pytestmark = pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline is not there")


def test_stages_take_effect_and_keep_the_columns(spark, data):
    import corpus_pipeline as p
    from latticework.llm import decontam

    from .test_near_and_repeats import plain_copies, plain_matches

    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, before = docs.columns, docs
    rows = lambda df: {r.doc_id: r for r in df.collect()}
    seen = {}
    for name, stage in p.STAGES[:-1]:
        after = spark.createDataFrame(stage(spark, before, data).collect(), docs.schema)
        assert after.columns == columns
        seen[name] = (rows(before), rows(after))
        before = after
    a, b = seen["toxicity"]
    assert all(a[i] == b[i] for i in b) and len(b) >= 0.8 * len(a)
    a, b = seen["simhash"]
    comp = plain_copies([(i, r.text) for i, r in a.items()])
    assert b == {i: r for i, r in a.items() if comp[i] == i}
    a, b = seen["suffixes"]
    found = plain_matches([(i, r.text) for i, r in a.items()])
    for i, r in a.items():
        drop = {k + j for k, *first in found.get(i, ()) if tuple(first) != (i, k) for j in range(50)}
        left = [w for k, w in enumerate((r.text or "").encode().split()) if k not in drop]
        assert (b[i].text.encode().split() == left) if i in b else not left
        assert drop or b[i] == r
    a, b = seen["decontamination"]
    index = decontam.ItemIndex([(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()])
    assert b == {i: r for i, r in a.items() if not index.leaks(r.text or "")}
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    last = rows(p.STAGES[-1][1](spark, before, data))
    assert {i: (r.n_tokens, r.ids_sha256) for i, r in last.items()} == {i: (len(x := sp.encode(r.text or "")), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for i, r in b.items()}
    whole = rows(p.run(spark, data))
    assert {i: r.ids_sha256 for i, r in whole.items()} == {i: r.ids_sha256 for i, r in last.items()}


@pytest.mark.parametrize("empty", [False, True])
def test_the_whole_run_on_odd_rows_and_empty_tables(spark, tmp_path, empty):
    """Nulls in any column, empty, very long and repeated texts, and a column under a name used inside."""
    import corpus_pipeline as p

    long = " ".join(f"w{k}" for k in range(60_000))
    rows = [(1, "a few plain words of one text", "en", "s", 29, "x"), (1, "a few plain words of one text", "en", "s", 29, "x"), (2, None, None, None, None, None), (None, None, None, None, None, None), (3, "", "en", "", 0, "x"), (4, long, "de", "s", len(long), "x"), (5, f"other start {long}", "de", "s", 0, "x")]
    docs = "doc_id long, text string, lang string, source string, n_chars long, _lw_score string"
    tables = {"documents": (rows, docs), "labels": ([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int"), "benchmark": ([(1, "Some question here? Its answer."), (None, None)], "item_id long, text string")}
    for name, (data, schema) in tables.items():
        spark.createDataFrame([] if empty else data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = [r.doc_id for r in p.run(spark, str(tmp_path)).collect()]
    # 2 and 3 equal each other, 5 is a near copy of 4; rows without an id are never removed as copies
    assert sorted(got, key=str) == ([] if empty else [1, 1, 2, 4, None])
