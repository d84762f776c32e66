"""Order-dependent steps that do not put a whole key, or the whole table, into one task.

A plain window over a key hands all rows of that key to one task. Here the rows of a key are cut
into slices of their order column first. Windows run inside slices; one summary row per key and
slice carries the result over to the next slice. The rows are shuffled once, by (key, slice): the
join with the summary finds them already in place. Slices are spans of time; a span of a key that
holds more than SLICE_ROWS rows, be it one moment, is cut further into slices of so many rows, by
numbering its rows in order. Keys must not be null.

The input is read by both branches; callers `cut` one that is costly to work out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.session import cut

SLICE_ROWS = 1_000_000
SLICE_SECONDS = 3_600


def number_rows(
    df: DataFrame, order: str | tuple[str, ...], by: tuple[str, ...] = (), out: str = "ordinal",
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Number the rows 1, 2, .. by a unique `order`, overall or per `by`.

    Overall, the rows are sorted by range and written with their place in their partition; the
    carry has one row per partition, however `order` is spread. Per `by`, `order` is one whole
    number and a slice spans `slice_rows` values of it, so no window holds more rows than that.
    """
    if not by:
        return _number_all(df, (order,) if isinstance(order, str) else order, out)
    df = df.withColumn("_slice", F.expr(f"`{order}` div {slice_rows}"))
    group = [*by, "_slice"]
    local = df.withColumn("_local", F.row_number().over(Window.partitionBy(*group).orderBy(order)))
    carry = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        df.groupBy(*group)
        .agg(F.count("*").alias("_n"))
        .select(*group, F.sum("_n").over(carry).alias("_before"))
    )
    return (
        local.join(before, group, "left")
        .withColumn(out, F.coalesce("_before", F.lit(0)) + F.col("_local"))
        .drop("_local", "_before", "_slice")
    )


def _number_all(df: DataFrame, order: tuple[str, ...], out: str) -> DataFrame:
    placed = cut(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    part = F.shiftright("_at", 33)
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        placed.groupBy(part.alias("_part"))
        .agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    )
    # One row per partition of the sort, so this is small.
    return (
        placed.join(F.broadcast(before), part == F.col("_part"))
        .withColumn(out, F.col("_before") + F.col("_at") - F.shiftleft("_part", 33) + 1)
        .drop("_at", "_part", "_before")
    )


def with_previous(
    df: DataFrame, key: str, ts: str, seq: str, value: str, out: str = "previous",
    slice_seconds: int = SLICE_SECONDS, slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Add the `value` of the row before in (`ts`, `seq`) order within `key`, null for the first.

    `value` must not be null. No task has more than `slice_rows` rows of a key in its windows.
    """
    df = _sliced(df, key, ts, seq, slice_seconds, slice_rows)
    group = [key, *_SLICE]
    local = df.withColumn(
        "_local", F.lag(value).over(Window.partitionBy(*group).orderBy(ts, seq))
    )
    carry = Window.partitionBy(key).orderBy(*_SLICE)
    before = (
        df.groupBy(*group)
        .agg(F.max_by(value, F.struct(ts, seq)).alias("_last"))
        .select(*group, F.lag("_last").over(carry).alias("_before"))
    )
    return (
        local.join(before, group, "left")
        .withColumn(out, F.coalesce("_local", "_before"))
        .drop("_local", "_before", *_SLICE)
    )


def with_latest_mark(
    df: DataFrame, key: str, ts: str, seq: str, marked: str, out: str = "mark",
    slice_seconds: int = SLICE_SECONDS, slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Add struct(`ts`, `seq`) of the nearest row at or before this one whose `marked` is true."""
    df = _sliced(df, key, ts, seq, slice_seconds, slice_rows)
    group = [key, *_SLICE]
    point = F.when(F.col(marked), F.struct(F.col(ts).alias("ts"), F.col(seq).alias("seq")))
    running = (
        Window.partitionBy(*group)
        .orderBy(ts, seq)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = df.withColumn("_local", F.max(point).over(running))
    carry = (
        Window.partitionBy(key).orderBy(*_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    )
    before = (
        df.groupBy(*group)
        .agg(F.max(point).alias("_last"))
        .select(*group, F.max("_last").over(carry).alias("_before"))
    )
    return (
        local.join(before, group, "left")
        .withColumn(out, F.coalesce("_local", "_before"))
        .drop("_local", "_before", *_SLICE)
    )


#: A slice: a span of time, and a part of it by rows.
_SLICE = ("_slice", "_piece")


def _sliced(
    df: DataFrame, key: str, ts: str, seq: str, slice_seconds: int, slice_rows: int
) -> DataFrame:
    """Add _SLICE. Only the rows of spans that hold too many are numbered, by a sort over ranges."""
    df = df.withColumn("_slice", _span(ts, slice_seconds))
    on = [key, "_slice"]
    hot = df.groupBy(*on).agg(F.count("*").alias("_n")).filter(F.col("_n") > slice_rows).select(*on)
    if hot.isEmpty():
        return df.withColumn("_piece", F.lit(0).cast("long"))
    hot = cut(hot)
    many = number_rows(df.join(hot, on, "left_semi"), (key, ts, seq), out="_piece")
    many = cut(many.withColumn("_piece", F.expr(f"_piece div {slice_rows}")))
    few = df.join(hot, on, "left_anti").withColumn("_piece", F.lit(0).cast("long"))
    return few.unionByName(many)


def first_rows(df: DataFrame, key: str, ts: str, seq: str) -> DataFrame:
    """`key`, `ts`, `seq` of the first row per key; partial aggregation absorbs hot keys."""
    earliest = F.min(F.struct(F.col(ts).alias("ts"), F.col(seq).alias("seq"))).alias("at")
    return (
        df.groupBy(key)
        .agg(earliest)
        .select(key, F.col("at.ts").alias(ts), F.col("at.seq").alias(seq))
    )


def latest_rows(df: DataFrame, key: str, ts: str, seq: str) -> DataFrame:
    """The last row per key in (`ts`, `seq`) order, as an aggregate rather than a window."""
    rest = [name for name in df.columns if name != key]
    return (
        df.groupBy(key)
        .agg(F.max_by(F.struct(*rest), F.struct(ts, seq)).alias("row"))
        .select(key, *[F.col(f"row.{name}").alias(name) for name in rest])
        .select(*df.columns)
    )


def _span(ts: str, seconds: int) -> Column:
    return F.expr(f"unix_micros(cast(`{ts}` as timestamp)) div {seconds * 1_000_000}")
