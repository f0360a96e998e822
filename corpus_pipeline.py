"""The corpus pipeline: whole documents through five stages, each on all that its predecessor kept.

Quality rules and toxicity drop the documents that they reject, the n-gram join keeps one document of each group of near
duplicates (five words, Jaccard 0.8; a pair of large texts at the very threshold is missed with a chance below 1e-5),
decontamination drops documents that share ten words with the benchmark, and packing returns the pieces of sequences.  All
but the last return the columns of documents.
"""

from __future__ import annotations

from stemforge.llm import decontaminate, ngram_join, pack, quality, queries, toxicity


def good(spark, docs, sf_dir):
    """Documents that meet the quality rules."""
    return quality.good_documents(docs)


def civil(spark, docs, sf_dir):
    """Documents whose toxicity score is below one half; the model learns from the labelled documents among them."""
    return toxicity.civil_documents(spark, docs, queries.toxicity_model(spark, sf_dir, docs))


def distinct(spark, docs, sf_dir):
    """One document of each group of near duplicates."""
    return ngram_join.one_of_each(spark, docs, exact=False)


def clean(spark, docs, sf_dir):
    """Documents without a span of the benchmark."""
    return decontaminate.clean_documents(spark, docs, queries.table(spark, sf_dir, "benchmark"))


def packed(spark, docs, sf_dir):
    """Pieces of the documents in sequences of 2048 tokens."""
    return pack.pack(docs, queries.vocabulary(queries.WORD_BPE))


STAGES = [("quality rules", good), ("toxicity", civil), ("n-gram Jaccard join", distinct), ("benchmark decontamination", clean), ("packing", packed)]
#: Robust estimates, a trained model and tokenizers are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The packed pieces; every stage's result is written to the shared folder and read again, and its scratch tables are removed."""
    from stemforge.llm.shared import remove, saved, swept

    docs = before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with swept(spark):
            docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if name != STAGES[0][0]:
            remove(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
