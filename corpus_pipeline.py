"""The training-data pipeline over documents, one operator a stage.

Each stage takes what the one before kept, as read again from its Parquet files, and returns it in
the columns of documents; the last adds each row's shard and slot. Toxic documents go, one document
of each group of near duplicates stays, documents that hold a whole benchmark window go, sources
are mixed to their targets (a document may come twice then), and all rows are shuffled into shards.

Rows with null texts pass the first filter, count as one group of copies with all other texts
without words in the second, and pass the third. Rows without ``doc_id`` are rows like any other and
stand last in a group; of rows equal in id and text one stays. Ties go by id, then by the text's
hash. Columns may clash in case with the stages' own (in sessions that tell case apart), and new
columns get names that are free. An empty table passes as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusweave.catalog import table
from corpusweave.llm import decontamination, mixing, sharding, simhash, toxicity
from corpusweave.llm.frames import cut

SHARDS = 8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trains on the labelled documents and drops what reaches its language's threshold; null and empty texts score as texts without words."""
    return toxicity.reject(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of texts similar by 0.8 or more in five-word shingles; all texts without words are one component."""
    return simhash.keep_first(docs, similarity=0.8, width=5)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a whole 13-word window of any item, or with a twentieth of their words in shorter items; texts without words stay."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source's documents as often as the mix asks, in shards' random order; null is a source, texts without words follow their block."""
    mixed = mixing.mix(docs)
    return mixed.drop(*mixed.columns[-2:])


def shard_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shuffles all rows into shards under the law ``rows``; repeated rows have places of their own."""
    return sharding.shard(docs, SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard_rows),
]

#: SQL can express neither the trained classifier nor the seeded draws; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared checkpoint folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
