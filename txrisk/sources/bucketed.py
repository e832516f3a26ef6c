"""Bucketed tables in a shared folder, in numbered parts of which only committed ones count.

A table lies in one folder, clustered and sorted by its keys into a fixed number of
buckets, and partitioned by ``part``. Joins and aggregations on all of its keys need no
shuffle of it. A part that was written but not committed, by a job that failed half-way,
is never read; the next attempt takes a new number. The folder outlives the session:
opening it again declares the table and finds its parts.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PART = "part"


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


class BucketedTable:
    """One bucketed table. ``columns`` is the DDL of its columns without ``part``."""

    def __init__(self, spark: SparkSession, path: str, columns: str, keys: list[str], buckets: int):
        self.spark, self.path, self.keys, self.buckets = spark, path, keys, buckets
        self.name = "bucketed_" + hashlib.sha256(path.encode()).hexdigest()[:16]
        listed = ", ".join(f"`{key}`" for key in keys)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}, {PART} INT) USING parquet PARTITIONED BY ({PART}) "
            f"CLUSTERED BY ({listed}) SORTED BY ({listed}) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
        if exists(spark, path):
            spark.sql(f"ALTER TABLE {self.name} RECOVER PARTITIONS")
        self.columns = [c for c in spark.table(self.name).columns if c != PART]

    def last_part(self) -> int:
        """The highest part number on disk, committed or not; 0 if there is none."""
        found = self.spark.sql(f"SHOW PARTITIONS {self.name}").collect()
        return max((int(row.partition.split("=")[1]) for row in found), default=0)

    def write_part(self, rows: DataFrame, part: int) -> None:
        """Write one new part. Each bucket of it is one file, written by one task."""
        view, session = f"{self.name}_new", rows.sparkSession
        rows.select(*self.columns).repartition(self.buckets, *self.keys).createOrReplaceTempView(view)
        try:
            session.sql(f"INSERT INTO {self.name} PARTITION ({PART} = {int(part)}) SELECT * FROM {view}")
        finally:
            session.catalog.dropTempView(view)
        session.catalog.refreshTable(self.name)

    def read(self, parts: list[int]) -> DataFrame:
        """The rows of the given parts; the files of others are not listed."""
        return self.spark.table(self.name).where(F.col(PART).isin(parts) if parts else F.lit(False)).drop(PART)


class Commits:
    """The list of committed parts of a folder: (part, name, replaces).

    A commit is one small file, moved into place when its job ends. A commit that replaces
    makes all parts before it count no more.
    """

    _DDL = "part int, name string, replaces boolean, note string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> list:
        if not exists(self.spark, self.path):
            return []
        return sorted(self.spark.read.schema(self._DDL).parquet(self.path).collect(), key=lambda row: row.part)

    def add(self, part: int, name: str, replaces: bool = False, note: str = "") -> None:
        row = self.spark.createDataFrame([(part, name, replaces, note)], self._DDL)
        row.coalesce(1).write.mode("append").parquet(self.path)

    @staticmethod
    def valid(rows: list) -> list[int]:
        last = max((row.part for row in rows if row.replaces), default=0)
        return [row.part for row in rows if row.part >= last]
