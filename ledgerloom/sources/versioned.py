"""A table kept in slots, each replaced as a whole; a manifest says which version of each slot counts.

A slot is a partition value (a month, a day).  A change writes new versions of
the touched slots next to the old ones and then one new manifest, so a reader
sees all of a change or nothing, and a job that dies half-way leaves only files
nobody refers to.  Every manifest carries the number of its change and a stamp
a slot; a change delivered again can be told and skipped.  The manifest has one
row a slot: a calendar, not the data.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

SLOT, VERSION, CHANGE = "slot", "version", "change"


def _folder(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _folder(spark, path)
    return fs.exists(place)


@dataclass(frozen=True)
class Manifest:
    """``change`` is -1 before the first; ``slots`` maps a slot to (version, stamp)."""

    change: int
    slots: Mapping[str, tuple[str, str]]


class VersionedTables:
    """Tables of one folder that change together, slot by slot."""

    def __init__(self, spark: SparkSession, path: str, names: Iterable[str]) -> None:
        self.spark, self.path, self.names = spark, path.rstrip("/"), tuple(names)

    def manifest(self) -> Manifest:
        if not exists(self.spark, f"{self.path}/manifest"):
            return Manifest(-1, {})
        rows = self.spark.read.schema(f"{SLOT} string, {VERSION} string, stamp string, {CHANGE} bigint").parquet(f"{self.path}/manifest")
        last = rows.agg(F.max(CHANGE)).first()[0]
        if last is None:
            return Manifest(-1, {})
        # a change that leaves no slot is one row without a slot
        held = rows.filter(F.col(CHANGE) == last).collect()
        return Manifest(last, {r.slot: (r.version, r.stamp) for r in held if r.slot is not None})

    def replace(self, tables: Mapping[str, DataFrame], stamps: Mapping[str, str], drop: Iterable[str] = (), change: int | None = None) -> Manifest:
        """New versions of the slots in ``stamps`` (slot -> stamp) from ``tables``, whose rows carry ``slot``; ``drop`` slots end.

        A slot without rows is empty from now on.  Rows of other slots must not be there.
        """
        old, version = self.manifest(), uuid4().hex[:16]
        for name, df in tables.items():
            df.withColumn(VERSION, F.lit(version)).write.mode("append").partitionBy(SLOT, VERSION).parquet(f"{self.path}/{name}")
        gone = set(drop)
        slots = {s: v for s, v in old.slots.items() if s not in gone} | {s: (version, stamp) for s, stamp in stamps.items()}
        number = old.change + 1 if change is None else change
        rows = [(s, v, stamp, number) for s, (v, stamp) in sorted(slots.items())] or [(None, None, None, number)]
        self.spark.createDataFrame(rows, f"{SLOT} string, {VERSION} string, stamp string, {CHANGE} bigint").coalesce(1) \
            .write.mode("append").parquet(f"{self.path}/manifest")
        return Manifest(number, slots)

    def read(self, name: str, schema: str, slots: Iterable[str] | None = None) -> DataFrame:
        """The current rows, with their slot, of all slots or of those named; other slots are never opened."""
        held = self.manifest().slots
        wanted = held if slots is None else [s for s in slots if s in held]
        if not wanted or not exists(self.spark, f"{self.path}/{name}"):
            return self.spark.createDataFrame([], f"{schema}, {SLOT} string")
        now = [f"{s}/{held[s][0]}" for s in wanted]
        rows = self.spark.read.schema(f"{schema}, {SLOT} string, {VERSION} string").parquet(f"{self.path}/{name}")
        # partition columns alone: the files of other versions are pruned
        return rows.filter(F.concat_ws("/", SLOT, VERSION).isin(now)).drop(VERSION)

    def vacuum(self) -> int:
        """Delete versions that the last manifest does not name, and older manifests' rows; returns how many were deleted.

        For times when no reader still uses an older manifest.
        """
        last, gone = self.manifest(), 0
        live = {f"{SLOT}={s}/{VERSION}={v}" for s, (v, _) in last.slots.items()}
        for name in self.names:
            fs, place = _folder(self.spark, f"{self.path}/{name}")
            if not fs.exists(place):
                continue
            for slot in fs.listStatus(place):
                if slot.isDirectory():
                    for version in fs.listStatus(slot.getPath()):
                        if f"{slot.getPath().getName()}/{version.getPath().getName()}" not in live:
                            fs.delete(version.getPath(), True)
                            gone += 1
        return gone
