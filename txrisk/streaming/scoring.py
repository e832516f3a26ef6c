"""Scoring a stream of payments and appending it to the prediction log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from txrisk import fixed_values as fv
from txrisk.operators.history import History
from txrisk.operators.hot_keys import HotKeys
from txrisk.plans.feature_table import transform
from txrisk.plans.scoring import score_with
from txrisk.plans.training import Ensemble, score_ensemble
from txrisk.sources.prediction_log import to_log


def score_stream(
    payments: DataFrame,
    history: History,
    threshold: float = fv.SCORECARD_THRESHOLD,
    extra: tuple[str, ...] = (),
    hot: HotKeys | None = None,
) -> DataFrame:
    """Row features, stream-static joins with the fitted history, score, verdict.

    Adaptive execution does not act on a stream, so frequent accounts are named in
    ``hot``: those of the latest stored rows.
    """
    return score_with(payments, history, threshold, extra, hot)


def score_ensemble_stream(
    payments: DataFrame,
    history: History,
    model: Ensemble,
    threshold: float | None = None,
    hot: HotKeys | None = None,
) -> DataFrame:
    """The trained ensemble on a stream: the same features and models as in a batch. A
    model is scored row by row, so it needs no state."""
    return score_ensemble(transform(payments, history, hot=hot), model, threshold)


def log_stream(scored: DataFrame) -> DataFrame:
    return to_log(scored)


def start_file_sink(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    partition_by: str | None = None,
    available_now: bool = True,
    every: str = "1 minute",
) -> StreamingQuery:
    """Append to Parquet. The checkpoint and the sink's own commit log make a
    restart neither lose nor repeat rows."""
    writer = stream.writeStream.format("parquet").outputMode("append")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": every}
    return writer.trigger(**trigger).start()


def start_update_sink(
    stream: DataFrame, path: str, checkpoint: str, available_now: bool = True, every: str = "1 minute"
) -> StreamingQuery:
    """Store what each batch changed in a folder of its own. A batch that is run again
    overwrites its folder, so no version appears twice."""

    def store(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    writer = stream.writeStream.outputMode("update").foreachBatch(store)
    trigger = {"availableNow": True} if available_now else {"processingTime": every}
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def append_log_stream(scored: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    dated = to_log(scored).withColumn("dt", F.to_date("ts"))
    return start_file_sink(dated, path, checkpoint, partition_by="dt", **options)
