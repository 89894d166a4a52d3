"""From raw documents to a training mix, stage by stage.

A stage is ``(spark, docs, sf_dir) -> DataFrame``. Its result is written as Parquet to the
folder all executors share and read again as the next stage's documents, so a lost
executor or a failed stage never repeats the stages before it; what a stage was given is removed once its
result is written. All stages but the last keep
the columns of ``documents``; the last adds how often the mix takes a document and how many
words that makes.

Defined cases: null and empty texts are scored, compared and mixed like any others, and hold nothing that a stage
removes. Documents without an identifier are no duplicates. Of rows equal in identifier and text one stays; different texts of
one identifier are different documents. Ties are broken by identifier, then text. Texts are read whole whatever their
length. An empty table passes every stage empty. Columns beyond those of ``documents`` go through as they are, whatever their
names; only ``copies`` and ``taken`` are replaced by the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blotter.llm import decontaminate, mixing, pii, simhash, toxicity
from blotter.llm.common import read_table, released, staged

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

MIX_WEIGHTS = (5, 2, 1)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. Labels kept for tests are not learnt from."""
    labels = read_table(spark, sf_dir, "labels")
    network = toxicity.fit(docs, labels.filter(~toxicity.is_held_out(F.col("doc_id"))))
    if network is None:
        return docs
    score = toxicity.score_text(docs, network)
    return docs.filter(score(F.col("text").cast("string")) < toxicity.THRESHOLD)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the document with the smallest identifier."""
    found = simhash.near_duplicates(simhash.fingerprints(docs))
    return simhash.keep_first(docs, found)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontaminate.remove_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    clean = pii.redact(docs, pii.fit_classifier(docs))
    length = F.length("text").cast("long")
    return clean.withColumn("n_chars", F.coalesce(length, F.col("n_chars")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes."""
    return mixing.mixed_documents(docs, mixing.mix(mixing.measure(docs), MIX_WEIGHTS))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_leaks),
    ("personal_data", without_personal_data),
    ("mixing", mixed),
]

# The toxicity model and the near-duplicate components have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = given = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        after = staged(stage(spark, docs, sf_dir), name)
        if docs is not given:
            released(docs)
        docs = after
    return docs
