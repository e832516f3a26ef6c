"""Scoring a stream with history that grows with it.

The state is the history store: each micro-batch is scored with the history of all earlier
ones and then added to it. Its tables are keyed, bucketed and shared, so they are not bound
to the stream's partitions, survive lost executors, and can be read by other jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from txrisk import fixed_values as fv
from txrisk.operators.history import PARTS, hot_keys_of
from txrisk.operators.history_store import HistoryStore
from txrisk.plans.scoring import score_with
from txrisk.session import materialize


def score_and_grow(
    payments: DataFrame,
    store: HistoryStore,
    sink: str,
    checkpoint: str,
    label: str = "stream",
    parts: tuple[str, ...] = PARTS,
    threshold: float = fv.SCORECARD_THRESHOLD,
    extra: tuple[str, ...] = (),
    available_now: bool = True,
    every: str = "1 minute",
) -> StreamingQuery:
    """Write scored payments to ``sink``, a folder per micro-batch.

    A micro-batch that is run again finds its own payments in the store, perhaps; it takes
    the history before them, so it writes the same rows over the first ones and adds nothing
    twice. Accounts that are frequent in the micro-batch are split over many tasks.
    """
    store.declare(payments.schema)

    def run(rows: DataFrame, number: int) -> None:
        batch, name = materialize(rows, "stream-batch"), f"{label} {number}"
        known = store.history(parts, before=name)
        scored = score_with(batch, known, threshold, extra, hot_keys_of(batch, parts))
        scored.write.mode("overwrite").parquet(f"{sink}/batch={number}")
        store.add(name, batch)

    trigger = {"availableNow": True} if available_now else {"processingTime": every}
    return payments.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**trigger).start()
