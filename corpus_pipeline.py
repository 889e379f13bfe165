"""Corpus pipeline: toxicity, exact dedup, n-gram Jaccard join, PII, packing, each over all that the stage before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. A stage that begins deletes the scratch tables of the
stages before it, and no others: their results have been written by then, which a caller of STAGES has to see to as well.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import exact_dedup, jaccard_join, packing, pii, toxicity
from strandline.llm.common import labelled, release, scratch_path, table
from strandline.llm.queries import held_out

#: No SQL can express the classifier, the tokenizer or the disclosure test; tests/llm holds the run against brute force.
ORACLE_SQL = None

#: Labels of scratch tables: what the stages write for themselves, and their results in run().
OWN, RESULT = "pipeline stage", "pipeline result"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go. It learns from labels of rows that are not held out."""
    release(OWN)
    with labelled(OWN):
        model = toxicity.train(docs, table(spark, sf_dir, "labels").filter(~held_out()))
        return toxicity.keep_clean(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays."""
    release(OWN)
    with labelled(OWN):
        return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents the one with the least id stays."""
    release(OWN)
    with labelled(OWN):
        return jaccard_join.keep_representatives(docs)


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their personal data replaced; n_chars follows a text that changes."""
    release(OWN)
    with labelled(OWN):
        return pii.sanitise(docs, length_col="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, as op8_packing returns them."""
    import public_tokenizers

    release(OWN)
    return packing.pack_digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram jaccard join", drop_near_copies),
    ("pii", remove_personal_data),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again in the shared folder."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        own = f"{RESULT} {uuid.uuid4().hex}"
        with labelled(own):
            path = scratch_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            release(before)
        before = own
    return docs
