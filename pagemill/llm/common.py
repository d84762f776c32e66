"""Helpers the operators share: row maps over Arrow batches, folds, and word splitting."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

WORD = re.compile(r"\w+")

# Texts are long: a batch of the usual ten thousand would take an executor's memory several times
# over, in the JVM, on the way, and in each Python worker.
BATCH = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": 1_000,
    "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: str | None) -> list[str]:
    """The lower-case words of a text; a null has none."""
    return WORD.findall(text.lower()) if text else []


def fold(key: str | Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; null for a null key."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(key.cast("string").cast("binary")) % n


def map_batches(
    df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType
) -> DataFrame:
    """Run `work` on each Arrow batch; partitions are independent and nothing is shuffled.

    The session's batches are made no larger than BATCH, which stays set.
    """
    limit_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = work(batch)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def limit_batches(spark: SparkSession) -> None:
    for name, most in BATCH.items():
        now = spark.conf.get(name).lower().removesuffix("b")
        # A size in another unit is somebody's choice.
        if now.lstrip("-").isdigit() and not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as keep it apart from df's columns."""
    taken, out = {x.lower() for x in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


class Memo(dict):
    """A bounded cache of a function of one argument. It is emptied when full, never wrong."""

    def __init__(self, function: Callable, most: int = 300_000) -> None:
        super().__init__()
        self.function, self.most = function, most

    def __missing__(self, key):  # noqa: ANN001, ANN204
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.function(key)
        return value
