"""A training-data pipeline over `documents`: filter, deduplicate, mask, mix, pack.

Each stage is a function of (spark, docs, folder) that returns a DataFrame. All stages but the last return the
columns of `documents`; each reads what the stage before it has written.
"""

import public_tokenizers

from gridtide.functions.sizes import cut_lineage
from gridtide.llm import mixing, neardup, packing, perplexity, pii

#: SQL can express neither the language model nor the packing; the stages are tested one by one instead.
ORACLE_SQL = None


def quality_classifier(spark, docs, folder):
    """Documents whose perplexity under the model of trusted text is within the threshold of their language."""
    return perplexity.trusted_quality(docs, spark.read.parquet(f"{folder}/labels.parquet"))


def near_duplicates(spark, docs, folder):
    """One document of each group of near-duplicates."""
    return neardup.one_of_each(docs)


def personal_data(spark, docs, folder):
    """All documents, with personal data masked in their texts."""
    return pii.mask_documents(docs)


def source_mixing(spark, docs, folder):
    """Documents as often as the target weights of their sources take them."""
    return mixing.mixed_documents(docs)


def best_fit_packing(spark, docs, folder):
    """Token pieces of all documents with their place in sequences."""
    return packing.pack(docs, public_tokenizers.path(packing.VOCABULARY))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]


def run(spark, folder):
    """Apply all stages to `documents`; every stage but the last is written as Parquet and read again."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, folder))
    return STAGES[-1][1](spark, docs, folder)
