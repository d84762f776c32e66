"""Per-key state over event time: expiring marks and content hashes.

State lives in the state store (RocksDB). Keys are dealt into groups by their hash, and the values
of a group's keys lie together in one state row: the worker is called, and the store is asked, once
per group and micro-batch, not once per key, which is what a stream of many keys would spend its
time on. A group that a micro-batch touches is read and written whole. The number of groups belongs
to the checkpoint, as the number of partitions does. The rows of one group and one micro-batch are
held as arrays while they are put in time order; the stream's trigger limit (`files_per_trigger`)
bounds them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DataType

#: So many groups of keys; a hundred million keys are some fifty thousand small values in each.
GROUPS = 2_048
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def by_group(rows: DataFrame, key: str, groups: int) -> GroupedData:
    return rows.withColumn("key_group", F.pmod(F.xxhash64(key), F.lit(groups))).groupBy("key_group")


class ValueOfKey:
    """The value state of one key, `key`, among the values of a group."""

    def __init__(self, rows: tuple[list, ...] | None) -> None:
        keys, *values = rows or ([], [])
        self.rows = dict(zip(keys, zip(*values, strict=True), strict=True))
        self.key, self.changed = None, False

    def exists(self) -> bool:
        return self.key in self.rows

    def get(self) -> tuple | None:
        return self.rows.get(self.key)

    def update(self, value: tuple) -> None:
        self.rows[self.key], self.changed = value, True

    def columns(self) -> tuple[list, ...]:
        return list(self.rows), *map(list, zip(*self.rows.values(), strict=True))


class Grouped(StatefulProcessor):
    """Runs the step of one key for each key of a group."""

    def __init__(self, one: ExpiringMark | ContentHash) -> None:
        self.one = one

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.values = handle.getValueState("values", f"url_key array<string>, {self.one.VALUES}")

    def handleInputRows(
        self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any
    ) -> Iterator[pd.DataFrame]:
        at, seq, sha1, names, codes = _in_order(rows)
        self.one.stored = stored = ValueOfKey(self.values.get())
        cuts = np.flatnonzero(np.diff(codes)) + 1
        taken, flags = [], []
        for start, stop in zip([0, *cuts], [*cuts, len(at)], strict=True):
            stored.key = names[codes[start]]
            positions, changed = self.one.step(at[start:stop], None if sha1 is None else sha1[start:stop])
            taken.append(start + positions)
            flags.append(changed)
        if stored.changed:
            self.values.update(stored.columns())
        taken = np.concatenate(taken)
        out = {"url_key": names[codes[taken]], "at": at[taken], "seq": seq[taken]}
        yield pd.DataFrame(out if flags[0] is None else out | {"changed": np.concatenate(flags)})

    def close(self) -> None:
        pass


class ExpiringMark:
    """Accepts a row when its key has no mark, or one older than the time to live."""

    VALUES = "at array<bigint>"

    def __init__(self, ttl: int) -> None:
        self.ttl = ttl

    def step(self, at: np.ndarray, sha1: None) -> tuple[np.ndarray, None]:
        """The accepted ones of a key's rows, by their positions."""
        position = 0
        if self.stored.exists():
            position = int(np.searchsorted(at, self.stored.get()[0] + self.ttl, "right"))
        taken = []
        while position < len(at):
            taken.append(position)
            position += int(np.searchsorted(at[position:], at[position] + self.ttl, "right"))
        if taken:
            self.stored.update((int(at[taken[-1]]),))
        return np.array(taken, dtype=np.int64), None


class ContentHash:
    """Flags rows whose hash differs from the stored one, or finds that one expired."""

    VALUES = "sha1 array<string>, at array<bigint>"

    def __init__(self, ttl: int | None) -> None:
        self.ttl = ttl

    def handleInputRows(
        self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any
    ) -> Iterator[pd.DataFrame]:
        """The rows of one key alone."""
        at, seq, sha1, *_ = _in_order(rows)
        yield pd.DataFrame({"url_key": key[0], "at": at, "seq": seq, "changed": self.step(at, sha1)[1]})

    def step(self, at: np.ndarray, sha1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The positions of a key's rows, which are all given out, and their flags."""
        before = self.stored.get() if self.stored.exists() else (None, 0)
        kept, kept_at = before
        flags = np.zeros(len(at), dtype=bool)
        # Behind a flagged row, the next one is where the hash differs from the row before, or
        # the first past the time to live.
        null = pd.isna(sha1)
        differs = np.flatnonzero((sha1[1:] != sha1[:-1]) | null[1:] | null[:-1]) + 1
        fresh = kept is None or bool(null[0]) or kept != sha1[0]
        position = 0 if fresh else self._next(at, differs, 0, kept_at)
        while position < len(at):
            flags[position] = True
            kept, kept_at = None if null[position] else sha1[position], int(at[position])
            position = self._next(at, differs, position, kept_at)
        if flags.any():
            self.stored.update((kept, kept_at))
        return np.arange(len(at)), flags

    def _next(self, at: np.ndarray, differs: np.ndarray, position: int, kept_at: int) -> int:
        i = int(np.searchsorted(differs, position, "right"))
        found = int(differs[i]) if i < len(differs) else len(at)
        if self.ttl is not None:
            found = min(found, int(np.searchsorted(at, kept_at + self.ttl, "right")))
        return found


def ttl_first_seen_stream(
    requests: DataFrame, ttl_sec: float, ts: str = "arrived_at", seq: str = "seq", groups: int = GROUPS
) -> DataFrame:
    """(url_key, ts, seq) of accepted rows. A row older than the key's mark counts as seen."""
    kind = requests.schema[ts].dataType
    rows = _narrow(requests, ts, seq)
    accepted = by_group(rows, "url_key", groups).transformWithStateInPandas(
        statefulProcessor=Grouped(ExpiringMark(int(ttl_sec * 1_000_000))),
        outputStructType="url_key string, at long, seq long",
        outputMode="Append",
        timeMode="None",
    )
    return accepted.select("url_key", _time(kind).alias(ts), F.col("seq").alias(seq))


def content_changed_stream(
    observed: DataFrame, ttl_sec: float | None = None, ts: str = "fetched_at", seq: str = "seq", groups: int = GROUPS
) -> DataFrame:
    """(url_key, ts, seq, changed) for observations (url_key, content_sha1, ts, seq)."""
    kind = observed.schema[ts].dataType
    rows = _narrow(observed, ts, seq, "content_sha1")
    flagged = by_group(rows, "url_key", groups).transformWithStateInPandas(
        statefulProcessor=Grouped(ContentHash(None if ttl_sec is None else int(ttl_sec * 1_000_000))),
        outputStructType="url_key string, at long, seq long, changed boolean",
        outputMode="Append",
        timeMode="None",
    )
    return flagged.select("url_key", _time(kind).alias(ts), F.col("seq").alias(seq), "changed")


def _narrow(df: DataFrame, ts: str, seq: str, *more: str) -> DataFrame:
    at = F.unix_micros(F.col(ts).cast("timestamp")).alias("at")
    return df.select("url_key", at, F.col(seq).alias("seq"), *more)


def _time(kind: DataType):
    return F.timestamp_micros("at").cast(kind)


def _in_order(
    rows: Iterator[pd.DataFrame],
) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray, np.ndarray]:
    """Times, numbers and hashes of the rows, by key and time; the keys, and which one a row has."""
    parts = list(rows)
    at = np.concatenate([part["at"].to_numpy() for part in parts])
    seq = np.concatenate([part["seq"].to_numpy() for part in parts])
    names, codes = np.array([None], dtype=object), np.zeros(len(at), dtype=np.int64)
    if "url_key" in parts[0]:
        codes, found = pd.factorize(np.concatenate([part["url_key"].to_numpy(dtype=object) for part in parts]), use_na_sentinel=False)
        names = np.array([None if pd.isna(x) else x for x in found], dtype=object)
    order = np.lexsort((seq, at, codes))
    sha1 = None
    if "content_sha1" in parts[0]:
        sha1 = np.concatenate([part["content_sha1"].to_numpy() for part in parts])[order]
    return at[order], seq[order], sha1, names, codes[order]
