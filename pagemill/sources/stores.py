"""Tables that grow by batches.

A batch is one partition folder, written by overwrite: running a batch again replaces its own
rows and nothing else. Every so many batches the rows so far are folded into a snapshot, which lies
in buckets by key. A batch that asks for its own keys joins them to the snapshot where it lies: only
the keys are shuffled, and for few keys only their buckets are opened. Besides, it reads the few
batches since.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial
from hashlib import md5

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagemill import schemas
from pagemill.operators.items import current_items, new_versions
from pagemill.session import cut, side_by_side

VERSIONS = (
    "id long, url string, title string, price double, availability string, rating int, "
    "description string, fetched_at timestamp, seq long"
)
#: Up to so many keys are written into the filter of a read.
FEW_KEYS = 256
BUCKETS = 64
COMPACT_EVERY = 8
MARKER = "upto long, buckets int, top long"


def no_rows(spark: SparkSession, schema: str) -> DataFrame:
    """A table that the planner knows to be empty, so that no job is run to read it."""
    kinds = StructType.fromDDL(schema)
    return spark.range(0).filter(F.lit(False)).select(*[F.lit(None).cast(x.dataType).alias(x.name) for x in kinds])


@dataclass(frozen=True)
class BatchTable:
    """Batches under `path`; with a `key` and a `fold`, snapshots in buckets of that key.

    `fold` takes rows with their batch_id to one row per key. `buckets` may be raised from one
    snapshot to the next; each remembers its own.
    """

    spark: SparkSession
    path: str
    schema: str
    key: str | None = None
    fold: Callable[[DataFrame], DataFrame] | None = None
    buckets: int = BUCKETS
    every: int = COMPACT_EVERY

    def write(self, df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/batches/batch_id={batch_id}")

    def read(self, before: int | None = None, keep_batch: bool = False) -> DataFrame:
        """The rows of all batches, or of those before one, from the last snapshot on."""
        snapshot, rows = self._layers(before)
        rows = rows if snapshot is None else snapshot.unionByName(rows)
        return rows if keep_batch else rows.drop("batch_id")

    def read_batch(self, batch_id: int) -> DataFrame:
        return self._rows("batches").filter(F.col("batch_id") == batch_id).drop("batch_id")

    def matching(
        self, keys: DataFrame, before: int | None = None, keep_batch: bool = False
    ) -> DataFrame:
        """The rows of `read` whose key is among `keys`, without a shuffle of the snapshot.

        A table without a `key` has no snapshot, and is matched on the first column of `keys`.
        """
        key = self.key or keys.columns[0]
        keys = cut(keys.select(key).filter(F.col(key).isNotNull()).distinct())
        few = [row[0] for row in keys.limit(FEW_KEYS + 1).collect()]
        snapshot, rows = self._layers(before)
        layers = [rows] if snapshot is None else [snapshot, rows]
        if len(few) <= FEW_KEYS:
            layers = [layer.filter(F.col(key).isin(few)) for layer in layers]
        else:
            layers = [layer.join(keys, key, "left_semi") for layer in layers]
        found = layers[0] if len(layers) == 1 else layers[0].unionByName(layers[1])
        return found if keep_batch else found.drop("batch_id")

    def compact_due(self, batch_id: int) -> None:
        """Fold the batches before this one, if a multiple of `every` lies behind the last snapshot.

        The rule depends on the batch's number alone, so a batch that runs again reads the same.
        """
        due = batch_id // self.every * self.every
        if self.fold is None or due <= 0:
            return
        last = self._last_snapshot(batch_id)
        if due > (0 if last is None else last["upto"] + 1) and not self._rows("batches", due).isEmpty():
            self.compact(due - 1)

    def compact(self, upto: int) -> None:
        """Write the fold of all rows up to a batch; readers then skip the batches it covers.

        A snapshot counts once its marker is there, so one that was cut short is never read.
        """
        last = self._last_snapshot(upto + 1)
        if last is not None and last["upto"] == upto:
            return
        rows = cut(self.fold(self.read(before=upto + 1, keep_batch=True)))
        name = self._snapshot_table(upto, self.buckets)
        names = self.spark.table(name).columns
        rows.select(names).repartition(self.buckets, self.key).write.insertInto(name, overwrite=True)
        self.spark.catalog.refreshTable(name)
        top = rows.agg(F.max("id")).first()[0] if "id" in names else None
        marker = self.spark.createDataFrame([(upto, self.buckets, top)], MARKER)
        marker.coalesce(1).write.mode("append").parquet(f"{self.path}/complete")

    def top_id(self, before: int | None = None) -> int:
        """The highest `id`: the snapshot's is in its marker, so only later batches are read."""
        last = self._last_snapshot(before)
        later = self._layers(before, last)[1].agg(F.max("id")).first()[0]
        return max(0, later or 0, (last["top"] if last else 0) or 0)

    def _layers(self, before: int | None, last: Row | None = None) -> tuple[DataFrame | None, DataFrame]:
        """The last snapshot, if there is one, and the batches behind it; both with batch_id."""
        last = last or self._last_snapshot(before)
        rows = self._rows("batches", before)
        if last is None:
            return None, rows
        snapshot = self.spark.table(self._snapshot_table(last["upto"], last["buckets"]))
        upto = F.lit(last["upto"]).cast("long")
        return snapshot.withColumn("batch_id", upto), rows.filter(F.col("batch_id") > last["upto"])

    def _snapshot_table(self, upto: int, buckets: int) -> str:
        """The session's name for a snapshot's folder; Spark learns from it how the files are dealt."""
        path = f"{self.path}/snapshots/{upto}"
        name = f"spark_catalog.default.pagemill_{md5(path.encode()).hexdigest()}"
        place = path.replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({self.schema}) USING parquet "
            f"CLUSTERED BY ({self.key}) SORTED BY ({self.key}) INTO {buckets} BUCKETS LOCATION '{place}'"
        )
        return name

    def _last_snapshot(self, before: int | None) -> Row | None:
        done = self._table("complete", MARKER)
        if before is not None:
            done = done.filter(F.col("upto") < before)
        return done.orderBy(F.desc("upto")).first()

    def _rows(self, kind: str, before: int | None = None) -> DataFrame:
        rows = self._table(kind, f"{self.schema}, batch_id long")
        return rows if before is None else rows.filter(F.col("batch_id") < before)

    def _table(self, kind: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{kind}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return no_rows(self.spark, schema)


def latest_items(rows: DataFrame) -> DataFrame:
    return current_items(rows, keep_order=True)


def last_marks(rows: DataFrame) -> DataFrame:
    """A key is marked again once its mark has expired, so the last mark is the one that holds."""
    return rows.groupBy("url_key").agg(F.max("seen_at").alias("seen_at"))


def counter_totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("name").agg(F.sum("amount").alias("amount"))


@dataclass(frozen=True)
class ItemStore:
    """Item versions, appended per batch; snapshots hold one per URL."""

    spark: SparkSession
    path: str

    @property
    def versions(self) -> BatchTable:
        return BatchTable(self.spark, self.path, VERSIONS, "url", latest_items)

    def current(self, before: int | None = None) -> DataFrame:
        return current_items(self.versions.read(before))

    def upsert(self, records: DataFrame, batch_id: int) -> None:
        """Add the records of a batch: url, the item fields, fetched_at and seq.

        Of the items before it reads those of its own URLs.
        """
        self.versions.compact_due(batch_id)
        known = current_items(self.versions.matching(records.select("url"), before=batch_id))
        rows = new_versions(records, known, top=self.versions.top_id(before=batch_id))
        self.versions.write(rows, batch_id)

    def compact(self, upto: int) -> None:
        self.versions.compact(upto)


@dataclass(frozen=True)
class CrawlStore:
    """Everything a run reads and writes, under one folder in shared storage."""

    spark: SparkSession
    path: str

    @property
    def items(self) -> ItemStore:
        return ItemStore(self.spark, f"{self.path}/items")

    @property
    def results(self) -> BatchTable:
        return BatchTable(self.spark, f"{self.path}/results", schemas.RESULTS)

    @property
    def seen(self) -> BatchTable:
        return BatchTable(self.spark, f"{self.path}/seen", schemas.SEEN, "url_key", last_marks)

    @property
    def content_state(self) -> BatchTable:
        return BatchTable(
            self.spark, f"{self.path}/content_state", schemas.CONTENT_STATE, "url_key", latest_hashes
        )

    @property
    def dead_letters(self) -> BatchTable:
        return BatchTable(self.spark, f"{self.path}/dead_letters", schemas.DEAD_LETTER)

    @property
    def counters(self) -> BatchTable:
        schema = "name string, amount long"
        return BatchTable(self.spark, f"{self.path}/counters", schema, "name", counter_totals, buckets=1)

    def current_content_state(
        self, before: int | None = None, keys: DataFrame | None = None
    ) -> DataFrame:
        """The latest hash per key over all batches, or of some keys."""
        if keys is None:
            return latest_hashes(self.content_state.read(before, keep_batch=True))
        return latest_hashes(self.content_state.matching(keys, before, keep_batch=True))

    def write_nothing(self, batch_id: int, incremental: bool) -> None:
        """A batch without requests leaves no row, nor one that an earlier try of it has left."""
        parts = [self.items.versions, self.results, self.seen, self.dead_letters, self.counters]
        parts += [self.content_state] if incremental else []
        side_by_side(self.spark, *(partial(x.write, no_rows(self.spark, x.schema), batch_id) for x in parts))

    def compact_due(self, batch_id: int) -> None:
        """What a run reads back is folded every few batches, before a batch reads it."""
        for one in (self.items.versions, self.seen, self.content_state, self.counters):
            one.compact_due(batch_id)

    def compact(self, upto: int) -> None:
        """Fold what a run reads back: items, marks, hashes and counters up to a batch."""
        for one in (self.items.versions, self.seen, self.content_state, self.counters):
            one.compact(upto)


def latest_hashes(rows: DataFrame) -> DataFrame:
    """The last hash per key; `rows` have their `batch_id`, and a batch has one row per key."""
    return (
        rows.groupBy("url_key")
        .agg(F.max_by(F.struct("content_sha1", "set_at"), F.struct("set_at", "batch_id")).alias("s"))
        .select("url_key", "s.content_sha1", "s.set_at")
    )
