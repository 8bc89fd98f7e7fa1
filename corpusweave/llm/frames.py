"""Small helpers on DataFrames that every operator of this subpackage uses."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the word-based contracts: runs of all but 0x20 and 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, by exact name, though others differ from them in case alone."""
    at = [df.columns.index(n) for n in names]
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).select(*(F.col(f"c{i}").alias(n) for i, n in zip(at, names, strict=True)))


def apart(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with every column but the first of each of ``names`` under a name that clashes with none, in any case; ``toDF(*df.columns)`` brings them back."""
    own = {df.columns.index(n): n for n in names}
    return df.toDF(*(own.get(i, f"column {i}") for i in range(len(df.columns))))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it in any case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def shared(spark: SparkSession) -> SparkSession:
    """Sees to a checkpoint folder: the session's own, or a temporary one where none is set and all runs on one machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), f"checkpoint-{uuid.uuid4().hex}"))
    return spark


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder; later plans start from those files."""
    shared(df.sparkSession)
    return df.checkpoint(eager=True)


HOT_SHARE, SALTS = 1000, 256


def join_salted(rows: DataFrame, table: DataFrame, key: str, by: str) -> DataFrame:
    """``rows`` joined with ``table``, one row a ``key`` (a long), where a few keys may hold most rows.

    Keys of over a thousandth of the rows, so fewer than a thousand, come to the driver; their rows are
    dealt by ``by`` over ``SALTS`` copies of the table's row. All others meet as in any join.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("rows_of_key")).filter(F.col("rows_of_key") > HOT_SHARE)
    some = {r[0]: r[1] for r in counts.orderBy(F.desc("rows_of_key")).limit(HOT_SHARE).collect()}
    total = rows.count() if some else 0
    hot = [k for k, n in some.items() if k is not None and n * HOT_SHARE > total]
    if not hot:
        return rows.join(table, key)
    salted = rows.withColumn("salt", F.when(F.col(key).isin(hot), F.pmod(F.xxhash64(by), F.lit(SALTS))).otherwise(0).cast("int"))
    copies = table.withColumn("salt", F.explode(F.when(F.col(key).isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(copies, [key, "salt"]).drop("salt")


def doc_crc(doc_id: Column | str = "doc_id") -> Column:
    """crc32 of the id as text modulo 4: 2 marks the rows held out of any learning."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary")) % 4


def held_out(doc_id: str = "doc_id") -> Column:
    """True for rows held out; an absent id is held out, as it can't be told to be allowed."""
    return F.coalesce(doc_crc(doc_id) == 2, F.lit(True))
