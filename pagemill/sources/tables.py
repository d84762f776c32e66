"""Landed tables, as batches and as streams of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.schemas import PAGES


def read_table(spark: SparkSession, path: str, schema: str = PAGES) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def stream_table(
    spark: SparkSession, path: str, schema: str = PAGES, files_per_trigger: int = 64,
    **options: str,
) -> DataFrame:
    """A file stream. `files_per_trigger` bounds a micro-batch, and with it every group in it."""
    reader = spark.readStream.schema(schema).options(**options)
    return reader.option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def has_body(html: str = "html") -> Column:
    return F.coalesce(F.col(html), F.lit("")) != ""


def with_body(pages: DataFrame) -> DataFrame:
    return pages.filter(has_body())


def without_body(pages: DataFrame) -> DataFrame:
    """Pages whose fetch counts as failed."""
    return pages.filter(~has_body())
