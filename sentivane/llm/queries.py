"""The registered queries of this subpackage, each next to its SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from sentivane.llm import (
    ctw, packing, quality, quality_model, quotes, sentencepiece_bpe, simhash, syncmers,
    token_files, toxicity, urls, whitening, word_runs,
)
from sentivane.llm.texts import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def register(fn):
        QUERIES[key] = fn
        if sql:
            ORACLE[key] = sql
        return fn

    return register


@query("op1_sentencepiece")
def op1(spark, sf_dir):
    return sentencepiece_bpe.digests(
        table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op2_quality_rules", quality.SQL)
def op2(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents"))


@query("op3_toxicity")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query("op4_url_filters")
def op4(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages"))


@query("op5_chat_formatting", quotes.SQL)
def op5(spark, sf_dir):
    return quotes.conversations(table(spark, sf_dir, "conversations"))


@query("op7_simhash")
def op7(spark, sf_dir):
    found = simhash.groups(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"))


@query("op9_packing")
def op9(spark, sf_dir):
    return packing.digests(packing.pieces(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


@query("op8_fingerprints")
def op8(spark, sf_dir):
    return syncmers.edited(table(spark, sf_dir, "documents"))


@query("op10_token_counts")
def op10(spark, sf_dir):
    return token_files.of_documents(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op6_lm_scoring")
def op6(spark, sf_dir):
    return ctw.scores(table(spark, sf_dir, "documents"))


@query("op11_quality_classifier")
def op11(spark, sf_dir):
    return quality_model.classified(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op12_periodic_runs")
def op12(spark, sf_dir):
    return word_runs.digests(table(spark, sf_dir, "documents"))


@query("op13_whitening")
def op13(spark, sf_dir):
    return whitening.whiten(whitening.whole_numbers(table(spark, sf_dir, "embeddings")))
