"""The training-data pipeline: five of the operators, one after the other.

Each stage takes (spark, docs, sf_dir) and returns what is left of ``docs``
with the same columns; the last adds the token ids.  A stage's result is
written as Parquet in the shared folder and read again as the next one's
documents, which also cuts the lineage.  SQL cannot express the stages (a
trained network, balanced sampling, tokenizer merges), so ``ORACLE_SQL`` is
None; ``tests/llm`` holds them against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from outagekit.llm.bpe_dropout import encoded
from outagekit.llm.common import fresh_dir, table
from outagekit.llm.exact_dedup import drop_copies
from outagekit.llm.mixing import mixed
from outagekit.llm.simhash import drop_near_duplicates
from outagekit.llm.toxicity import drop_toxic

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of documents that go to a Python worker at once (Spark's own bound is 64 MB).
BATCH_BYTES = 4 << 20


def in_small_batches(spark: SparkSession) -> None:
    """Bound the batches of the stages that send whole documents to Python
    workers, whatever the rows' lengths; a session's own setting stays."""
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, str(BATCH_BYTES))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below their language's toxicity threshold."""
    in_small_batches(spark)
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_copies(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near fingerprints."""
    in_small_batches(spark)
    return drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixed(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with ids, n_ids and lossless."""
    in_small_batches(spark)
    return encoded(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("simhash_dedup", simhash_dedup),
    ("mix_sources", mix_sources),
    ("sentencepiece", sentencepiece),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
