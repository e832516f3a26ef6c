"""The prediction log as a store: batches that can be sent again, and a summary kept with them.

Each batch is written as a new part and counts once its commit is there. Sending a batch
again under its name does nothing; one that failed half-way leaves a part that no reader
takes. Rows are partitioned by month and sorted by time, so a lookback reads the months it
touches and, in them, the row groups it needs.

With its rows a batch brings their summary: sums by day and score. Monitoring adds up
summaries of whole days; rows are read only for days that a lookback cuts in two.
"""

from __future__ import annotations

import json
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from txrisk import fixed_values as fv
from txrisk.operators import drift
from txrisk.session import materialize
from txrisk.sources.bucketed import PART, Commits, exists
from txrisk.sources.prediction_log import lookback

DAY, MONTH = "dt", "month"


class LogStore:
    """A prediction log in a shared folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.commits = Commits(spark, f"{self.path}/commits")

    def _last_on_disk(self) -> int:
        folder = f"{self.path}/rows"
        if not exists(self.spark, folder):
            return 0
        place = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        listed = place.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(place)
        names = [status.getPath().getName() for status in listed]
        return max((int(name.split("=")[1]) for name in names if name.startswith(f"{PART}=")), default=0)

    def append(self, batch: str, rows: DataFrame) -> bool:
        """Add a batch of log rows; False if the batch is there already.

        The summary is taken from the written rows, so both tell the same whatever a
        repeated computation of ``rows`` would give.
        """
        commits = self.commits.rows()
        if any(row.name == batch for row in commits):
            return False
        part = 1 + max([row.part for row in commits] + [self._last_on_disk()])
        place = f"{self.path}/rows/{PART}={part}"
        dated = rows.withColumn(DAY, F.to_date("ts")).withColumn(MONTH, F.date_format(DAY, "yyyy-MM"))
        spread = dated.hint("rebalance", F.col(MONTH)).sortWithinPartitions(MONTH, "ts")
        spread.write.partitionBy(MONTH).parquet(place)
        written = self.spark.read.schema(dated.schema).parquet(place)
        summary = drift.summarise(written, DAY)
        summary.coalesce(1).write.parquet(f"{self.path}/summary/{PART}={part}")
        note = f"{dated.schema.json()}\n{summary.schema.json()}"
        self.commits.add(part, batch, note=note)
        return True

    def _committed(self, kind: str, at: int) -> DataFrame:
        commits = self.commits.rows()
        if not commits:
            raise ValueError("the log holds no batch yet")
        schema = StructType.fromJson(json.loads(commits[0].note.split("\n")[at]))
        found = self.spark.read.schema(schema.add(PART, IntegerType())).parquet(f"{self.path}/{kind}")
        return found.where(F.col(PART).isin(Commits.valid(commits))).drop(PART)

    def rows(self) -> DataFrame:
        """All committed rows, with ``dt``."""
        return self._committed("rows", 0).drop(MONTH)

    def recent(self, as_of: str | datetime, days: int) -> DataFrame:
        """The rows of a lookback; months outside it are not listed."""
        moment = _moment(as_of)
        months = [(moment - timedelta(days=days)).strftime("%Y-%m"), moment.strftime("%Y-%m")]
        rows = self._committed("rows", 0).where(F.col(MONTH).between(*months)).drop(MONTH)
        return lookback(rows, as_of, days)

    def summary(self) -> DataFrame:
        """Sums by day and score, one row per batch that has them."""
        return self._committed("summary", 1)

    def lookback_summary(self, as_of: str | datetime, lookbacks: list[int] = fv.LOOKBACK_DAYS) -> DataFrame:
        """What ``drift.lookback_summary`` gives, from the kept sums.

        Whole days come from the summary. If ``as_of`` is not a midnight, its own day and
        the first day of each lookback are cut; only these are summed from rows.
        """
        moment, spans = _moment(as_of), sorted(lookbacks)
        today = moment.replace(hour=0, minute=0, second=0, microsecond=0)
        ages = F.datediff(F.lit(today.date()), F.col(DAY))
        cut = [] if moment == today else [0, *spans]
        whole = self.summary().where(
            (F.col(DAY) < F.lit(today.date()))
            & (F.col(DAY) >= F.lit((today - timedelta(days=spans[-1])).date()))
            & ~ages.isin(cut)
        )
        shortest = F
        for days in spans:
            shortest = shortest.when(ages <= days, days)
        columns = ["n", *drift.SUMMED]
        parts = whole.select(shortest.alias("slice"), "risk_score", *columns)
        if cut:
            days_cut = [(today - timedelta(days=age)).date() for age in cut]
            rows = self.recent(as_of, spans[-1]).where(F.col(DAY).isin(days_cut))
            parts = parts.unionByName(drift.sliced_summary(rows, as_of, spans))
        return materialize(drift.copy_into_longer(parts, spans), "log-summary")

    def drift_metrics(self, as_of: str | datetime, lookbacks: list[int] = fv.LOOKBACK_DAYS) -> DataFrame:
        return drift.metrics_from_summary(self.lookback_summary(as_of, lookbacks), ["period_days"])

    def score_histogram(self, as_of: str, days: int = 30) -> DataFrame:
        """Ten score buckets of the whole days before a midnight ``as_of``."""
        summary = self.lookback_summary(as_of, [days])
        return drift.histogram_of_counts(summary.select("risk_score", "n"))

    def trend(self, days: int = 90) -> DataFrame:
        daily = self.summary().groupBy(F.col(DAY).alias("day")).agg(
            F.sum("n").alias("n"),
            F.sum("flagged").alias("flagged"),
            F.sum(F.col("risk_score") * F.col("n")).alias("score"),
        )
        return drift.trend_of_days(daily, days)


def _moment(as_of: str | datetime) -> datetime:
    return datetime.fromisoformat(as_of) if isinstance(as_of, str) else as_of
