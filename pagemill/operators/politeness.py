"""Per-domain delays and the earliest start each request may have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.urls import host_of, strip
from pagemill.operators.ordering import SLICE_ROWS, number_rows

# A settings string up to this size gives a delay table that may be broadcast.
MAX_BROADCAST_CHARS = 4 << 20
_DECIMAL = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)$"


def domain_delays(raw: DataFrame, column: str = "raw") -> DataFrame:
    """(host, delay_sec) from `host:sec,host:sec` texts; bad parts are skipped, the last wins."""
    part = strip("part")
    colon = F.length(part) - F.length(F.substring_index(part, ":", -1))
    number = strip(F.substring_index(part, ":", -1))
    parts = raw.select(F.posexplode(F.split(column, ",")).alias("pos", "part")).filter(
        F.contains(part, F.lit(":"))
    )
    read = parts.select(
        "pos",
        F.lower(strip(F.substring(part, F.lit(1), colon - 1))).alias("host"),
        F.when(F.rlike(number, F.lit(_DECIMAL)), number.try_cast("double")).alias("delay_sec"),
    )
    return (
        read.filter(F.col("delay_sec").isNotNull())
        .groupBy("host")
        .agg(F.max_by("delay_sec", "pos").alias("delay_sec"))
    )


def delays_from_text(spark: SparkSession, raw: str) -> DataFrame:
    """The delay table of one settings text, marked for broadcast while the text is small."""
    table = domain_delays(spark.createDataFrame([(raw,)], "raw string"))
    return F.broadcast(table) if len(raw) <= MAX_BROADCAST_CHARS else table


def with_delay(
    df: DataFrame, delays: DataFrame, default: float, url: str = "url", out: str = "delay_sec"
) -> DataFrame:
    """Add `host` and the delay: of the host, else of the host without `www.`, else the default."""
    own = delays.select(F.col("host").alias("_own"), F.col("delay_sec").alias("_own_delay"))
    bare = delays.select(F.col("host").alias("_bare"), F.col("delay_sec").alias("_bare_delay"))
    df = df.withColumn("host", host_of(url))
    short = F.when(F.startswith(F.col("host"), F.lit("www.")), F.substring("host", 5, 1 << 20))
    return (
        df.join(own, F.col("host") == F.col("_own"), "left")
        .join(bare, short == F.col("_bare"), "left")
        .withColumn(out, F.coalesce("_own_delay", "_bare_delay", F.lit(default)))
        .drop("_own", "_own_delay", "_bare", "_bare_delay")
    )


def politeness_plan(
    requests: DataFrame, order: str = "ordinal", host: str = "host", delay: str = "delay_sec",
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Add `start_after_sec`: one delay for every earlier request to the same host.

    The delay is a property of the host, so the offset is (position - 1) * delay; positions come
    from bounded slices, so a host with a third of all requests does not end in one task.
    """
    placed = number_rows(requests, order, by=(host,), out="_place", slice_rows=slice_rows)
    start: Column = (F.col("_place") - 1) * F.col(delay)
    return placed.withColumn("start_after_sec", start).drop("_place")
