"""Files in and out: JSON lines, text lists, evaluation questions, cached pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusweave.functions.text import without_follow_up

MANIFEST = "url string, category string"
QUESTIONS = "id string, question string, category string, expected_entity string, expected_intent string, expected_enumerate_group string, notes string"


def read_lines(spark: SparkSession, path: str, schema: str | StructType, strict: bool = False) -> DataFrame:
    """JSON lines; a malformed line is skipped, or with ``strict`` an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def write_lines(df: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines; each write is atomic, so an appending job that fails can be run again from what is there."""
    df.write.mode("append" if append else "overwrite").json(path)


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """One value a line, blank lines left out."""
    return spark.read.text(path).select(F.trim("value").alias("value")).filter("value <> ''")


def write_list(values: DataFrame, path: str) -> None:
    """Distinct values, sorted over all files."""
    values.select("value").distinct().orderBy("value").write.mode("overwrite").text(path)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of labelled questions."""
    return spark.read.schema(QUESTIONS).option("multiLine", True).json(path)


def dialogues(lines: DataFrame, column: str = "value") -> DataFrame:
    """(convo, turn, question) of lines whose turns are parted by ``|``; follow-up marks are cut."""
    turns = F.filter(F.transform(F.split(column, r"\|"), lambda t: without_follow_up(F.trim(t))), lambda t: t != "")
    return lines.select("convo", F.posexplode(turns).alias("turn", "question"))


def cache_name(url):
    """The landed file of a URL."""
    return F.concat(F.md5(url.cast("binary")), F.lit(".html"))


def write_cached_pages(pages: DataFrame, folder: str, *keys: str) -> None:
    """Fetched pages (url, html) into the cache: rows of (file, html) and the ``keys`` of each landing, in folders by the name's first two digits."""
    named = pages.select(cache_name(F.col("url")).alias("file"), *keys, "html")
    named.withColumn("lead", F.substring("file", 1, 2)).write.mode("append").partitionBy("lead").parquet(folder)


def read_cached_pages(spark: SparkSession, folder: str, *keys: str, loose: bool = False) -> DataFrame:
    """(file, html) of the cache and the ``keys`` of each landing; with ``loose``, of a folder of single ``.html`` files."""
    if not loose:
        return spark.read.parquet(folder).select("file", *keys, "html")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("content").cast("string").alias("html"))


def cache_hits(manifest: DataFrame, cached: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """Manifest rows with their landed HTML, and those that still have to be fetched. A URL's landings
    serve all its rows (the least HTML, so that reruns agree), or with ``keys`` each landing its own row."""
    named, by = manifest.withColumn("file", cache_name(F.col("url"))), ["file", *keys]
    once = cached.groupBy(*by).agg(F.min("html").alias("html"))
    return named.join(once, by), named.join(once.select(*by), by, "left_anti")
