"""Corpus pipeline: five stages over the documents table, each written as Parquet and read again by the next.

1. toxicity: documents predicted toxic go;
2. simhash: of each component of near copies (five-word shingles, similarity 0.8 or more) the document with the smallest id stays;
3. suffixes: passages of 50 words or more that an earlier document holds are cut; a document left without words goes;
4. decontamination: documents that hold a benchmark item's question and answer go;
5. sentencepiece: the remaining texts are encoded and decoded; one row of digests for each document.

All but the last return the columns of the documents table, under whatever names further ones have.

Defined results: null and word-less texts count as copies of each other, so the one with the smallest id stays; rows without an id are never
removed as copies and are never cut; rows that repeat an id and a text go or stay together; long texts are handled whole; of equal
occurrences the one in the smallest id is first; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from latticework.llm.common import Scratch, read_table
from latticework.llm.decontam import drop_leaks
from latticework.llm.simhash import keep_one_of_each
from latticework.llm.sp_bpe import op5_sentencepiece
from latticework.llm.suffix_dedup import cut_repeats
from latticework.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each(docs)


def suffixes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cut_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op5_sentencepiece(spark, docs)


STAGES = [("toxicity", toxicity), ("simhash", simhash), ("suffixes", suffixes), ("decontamination", decontamination), ("sentencepiece", sentencepiece)]

#: No stage of it is expressible in SQL; tests compare it with a brute-force version on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.free(before)
        before = docs
    return docs
