"""The corpus pipeline: toxicity, quality rules, near-duplicates, packing."""

from __future__ import annotations

import public_tokenizers
from sentivane.llm import packing, quality, simhash, toxicity
from sentivane.session import stage


def toxicity_stage(spark, docs, sf_dir):
    """Documents that the ordinal model, fitted on the labels, calls toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.clean(docs, toxicity.fit(docs, labels))


def quality_stage(spark, docs, sf_dir):
    """Documents that fail a quality rule go."""
    return quality.keep(docs)


def near_duplicate_stage(spark, docs, sf_dir):
    """One document of every group of near copies stays, the one with the least id."""
    return simhash.keep_one(docs)


def packing_stage(spark, docs, sf_dir):
    """Pieces of the documents in windows of 2048 tokens."""
    return packing.digests(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", toxicity_stage), ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage), ("packing", packing_stage),
]

ORACLE_SQL = None  # the toxicity model is fitted and fingerprints need XXH64: no SQL twin


def run(spark, sf_dir):
    """All stages over `documents`, each written as Parquet and reread as the next one's docs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
