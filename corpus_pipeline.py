"""A training corpus from raw documents: five stages, each one of the subpackage's operators.

Every stage takes all rows its predecessor kept and, but for the last, returns the columns
of ``documents``.  ``run`` writes what a stage returns as Parquet in the shared checkpoint
folder and reads it again for the next, so lost executors never redo earlier stages.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm._store import checkpoint_dir
from quillon.llm.minhash import keep_one_of_each
from quillon.llm.mixing import mix_documents
from quillon.llm.packing import pack
from quillon.llm.rules import filter_documents
from quillon.llm.suffix import dedup_passages

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    return filter_documents(docs)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates (five words, similarity 0.8) the one with the smallest id stays."""
    return keep_one_of_each(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes and more that an earlier document has are cut out; n_chars follows."""
    return dedup_passages(docs, chars_col="n_chars")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, or ranges of their words, as often as the mix takes them; n_chars follows."""
    return mix_documents(docs)


def length_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's bucket, batch and slot."""
    return pack(docs, carry=("text", "lang", "source"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("minhash_dedup", minhash_dedup),
    ("suffix_dedup", suffix_dedup),
    ("source_mixing", source_mixing),
    ("length_packing", length_packing),
]

#: Near-duplicate groups, suffix spans and block quotas together are beyond SQL; the tests
#: hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.  What a stage has read is removed once it has written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            written = f"{folder}/{k}-{name}"
            docs.write.parquet(written)
            docs = spark.read.parquet(written)
            if before:
                path = spark._jvm.org.apache.hadoop.fs.Path(before)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            before = written
    return docs
