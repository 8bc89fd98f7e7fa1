"""Collections of vectors and payloads as Parquet tables: create, upsert, check, version, scan.

A collection is a folder of versions; a version is complete or isn't there (the name file is written
last), so readers never see half an upload. Layout stands in for payload indexes: partitions by a
low-cardinality key, files sorted by another, Bloom filters for point lookups.
"""

from __future__ import annotations

import io
import time
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.operators.vectors import upsert

DIM = 768


def create(df: DataFrame, path: str, partition: str = "category", sort: str = "point_id", bloom: tuple[str, ...] = ("chunk_id",)) -> None:
    """Writes a version, replacing what is at ``path``."""
    writer = df.sortWithinPartitions(sort).write.mode("overwrite").partitionBy(partition)
    for name in bloom:
        if name in df.columns:
            writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
    writer.parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def next_version(spark: SparkSession, base: str, version: int, batch: DataFrame, key: str = "point_id", order: str = "batch_at") -> DataFrame:
    """Upserts ``batch`` into version ``version`` under ``base`` and writes the next one."""
    merged = upsert(load(spark, f"{base}/v={version}"), batch, key, order)
    create(merged, f"{base}/v={version + 1}")
    return load(spark, f"{base}/v={version + 1}")


def settled(read: Callable[[], DataFrame], expected: int, wait: float = 2.0, most: float = 300.0) -> DataFrame:
    """What ``read`` gives once it has ``expected`` rows; it is read again every ``wait`` seconds, and an error after ``most``."""
    until = time.monotonic() + most
    while True:
        df = read()
        have = df.count()
        if have >= expected:
            return df
        if time.monotonic() + wait > until:
            raise TimeoutError(f"{have} of {expected} rows")
        time.sleep(wait)


def aligned(*frames: DataFrame) -> int:
    """The common number of rows, or an error."""
    counts = {f.count() for f in frames}
    if len(counts) != 1:
        raise ValueError(f"row counts differ: {sorted(counts)}")
    return counts.pop()


def scroll(df: DataFrame, wanted: list[Column], *payload: str) -> DataFrame:
    """A filtered scan of some payload columns."""
    return df.filter(reduce(lambda a, b: a & b, wanted)).select(*payload) if wanted else df.select(*payload)


def payload(chunks: DataFrame, facets: str = "facets") -> DataFrame:
    """Chunk columns with the facets spread out; a facet of the same name wins."""
    spread = [f.name for f in chunks.schema[facets].dataType.fields]
    return chunks.select(*(c for c in chunks.columns if c != facets and c not in spread), *(F.col(f"{facets}.{n}").alias(n) for n in spread))


def gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """(name, freq) of a JSON file ``{"entities": {name: count}, "count": n}``."""
    raw = spark.read.schema("entities map<string,bigint>, count bigint").option("multiLine", True).json(path)
    return raw.select(F.explode("entities").alias("name", "freq"))


def jdbc(spark: SparkSession, url: str, query: str, key: str, low: int, high: int, parts: int) -> DataFrame:
    """A relational source read in ranges of ``key``."""
    return spark.read.format("jdbc").options(url=url, dbtable=f"({query}) AS q", partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts).load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", batch: int = 1000, **options: str) -> None:
    """Rows into a relational table, in batches by partition."""
    df.write.format("jdbc").mode(mode).options(url=url, dbtable=table, batchsize=batch, **options).save()


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, vector) of every row of the ``.npy`` matrices at ``path``; a file is one task's work."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = np.load(io.BytesIO(content.as_buffer()), allow_pickle=False)
                if found.ndim != 2:
                    raise ValueError(f"{name} has {found.ndim} dimensions, not 2")
                for lo in range(0, len(found), 4096):
                    some = found[lo : lo + 4096].astype(np.float32)
                    vectors = pa.FixedSizeListArray.from_arrays(pa.array(some.ravel()), found.shape[1]).cast(pa.list_(pa.float32()))
                    yield pa.RecordBatch.from_arrays([pa.array([name.rsplit("/", 1)[-1]] * len(some)), pa.array(np.arange(lo, lo + len(some))), vectors], ["file", "at", "vector"])

    return files.mapInArrow(run, "file string, at long, vector array<float>")


def write_npy(vectors: DataFrame, path: str, order: str, vector: str = "vector", rows: int = 100_000) -> int:
    """Writes ``.npy`` matrices of up to ``rows`` rows, in the order of ``order`` within a file; the number of files.

    Matrices are made on the executors; the driver writes one file after another through Spark's file system.
    """
    dim = F.size(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def made() -> pa.RecordBatch:
            out = io.BytesIO()
            np.save(out, np.concatenate(held))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], ["content"])

        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                some = batch.slice(lo, rows).column(0)
                held.append(some.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(some), -1))
                if sum(map(len, held)) >= rows:
                    yield made()
        if held:
            yield made()

    spark, n = vectors.sparkSession, 0
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    ordered = vectors.filter(dim > 0).sortWithinPartitions(order).select(F.col(vector).cast("array<float>"))
    for n, row in enumerate(ordered.mapInArrow(run, "content binary").toLocalIterator(), 1):
        place = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/part-{n - 1:06d}.npy")
        stream = place.getFileSystem(conf).create(place, True)
        stream.write(bytearray(row["content"]))
        stream.close()
    return n
