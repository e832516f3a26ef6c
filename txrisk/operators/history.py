"""History of accounts and banks: fitted on one table, applied to any table.

``fit_history`` sees only the table it is given, so fitting on the training rows
keeps labels and counts of later rows out of the features. Fitting on the whole
table gives the descriptive variant.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk import fixed_values as fv
from txrisk.functions.scalars import count_if, flag
from txrisk.operators import network
from txrisk.operators.hot_keys import HotKeys, find_hot_keys, join_spread
from txrisk.operators.network import DST, SRC
from txrisk.operators.profiles import LABEL
from txrisk.session import materialize

PARTS = ("sender", "receiver", "bank", "cycle")
#: Sums of money and of squares; amounts keep four digits after the point.
MONEY, SQUARES = "decimal(38,4)", "decimal(38,2)"


@dataclass(frozen=True)
class History:
    """Fitted tables; a part that was not asked for is None."""

    sender: DataFrame | None = None
    receiver: DataFrame | None = None
    bank: DataFrame | None = None
    cycle: DataFrame | None = None

    def parts(self) -> dict[str, DataFrame]:
        found = {name: getattr(self, name) for name in PARTS}
        return {name: table for name, table in found.items() if table is not None}


def batch_sums(tx: DataFrame) -> DataFrame:
    """Sums by (sender, receiver, bank): all that history needs, in one pass.

    Money is summed in decimals, so totals do not depend on the order of tasks.
    """
    amount = F.col("amount_paid").cast("decimal(28,4)")
    square = (F.col("amount_paid").cast("double") * F.col("amount_paid").cast("double")).cast(SQUARES)
    return tx.groupBy(SRC, DST, "from_bank").agg(
        F.count(F.lit(1)).alias("n_tx"),
        count_if(F.col(LABEL) == 1).alias("n_laundering"),
        F.sum(amount).cast(MONEY).alias("amount"),
        F.sum(square).cast(SQUARES).alias("squares"),
    )


def edges_of(sums: DataFrame) -> DataFrame:
    """The edge table from ``batch_sums``."""
    return sums.groupBy(SRC, DST).agg(
        F.sum("n_laundering").alias("n_laundering"), F.sum("n_tx").alias("n_tx"), F.sum("amount").cast(MONEY).alias("amount")
    )


def bank_sums(sums: DataFrame) -> DataFrame:
    """Mean and deviation of amounts, rows and positives per bank, from additive sums."""
    n, total = F.sum("n_tx"), F.sum("amount").cast("double")
    spread = (F.sum("squares").cast("double") - total * total / n) / (n - 1)
    deviation = F.when(n > 1, F.sqrt(F.greatest(spread, F.lit(0.0))))
    return sums.where(F.col("from_bank").isNotNull()).groupBy("from_bank").agg(
        (total / n).alias("mean"), deviation.alias("deviation"), n.alias("n"), F.sum("n_laundering").alias("bad")
    )


def sender_history(edge_table: DataFrame) -> DataFrame:
    """Per sender: distinct receivers, rows, total and mean sent."""
    totals = edge_table.where(F.col(SRC).isNotNull()).groupBy(SRC).agg(
        F.count(DST).alias("others"), F.sum("n_tx").alias("n_tx"), F.sum("amount").alias("amount")
    )
    return sender_view(totals)


def sender_view(totals: DataFrame) -> DataFrame:
    """Sender columns from counterparties, rows and amount per sender."""
    amount = F.col("amount").cast("double")
    total, n = F.round(amount, 2), F.col("n_tx")
    return totals.select(
        SRC,
        F.col("others").alias("fan_out_degree"),
        n.alias("tx_velocity"),
        total.alias("total_sent"),
        F.round(F.round(amount, 6) / n, 2).alias("avg_sent"),
        F.round(total / F.greatest(n, F.lit(1)), 2).alias("amount_per_tx"),
    )


def receiver_history(edge_table: DataFrame) -> DataFrame:
    """Per receiver: distinct senders, rows, total and mean received."""
    totals = edge_table.where(F.col(DST).isNotNull()).groupBy(DST).agg(
        F.count(SRC).alias("others"), F.sum("n_tx").alias("n_tx"), F.sum("amount").alias("amount")
    )
    return receiver_view(totals)


def receiver_view(totals: DataFrame) -> DataFrame:
    """Receiver columns from counterparties, rows and amount per receiver."""
    amount = F.col("amount").cast("double")
    return totals.select(
        DST,
        F.col("others").alias("fan_in_degree"),
        F.col("n_tx").alias("n_received"),
        F.round(amount, 2).alias("total_received"),
        F.round(F.round(amount, 6) / F.col("n_tx"), 2).alias("avg_received"),
    )


def bank_history(tx: DataFrame, hubs: int = fv.HUB_BANKS) -> DataFrame:
    """Per sending bank: amounts, positive share in percent, hub flag.

    One aggregate serves the amount score, the risk score and the hub list.
    """
    sums = (
        tx.where(F.col("from_bank").isNotNull())
        .groupBy("from_bank")
        .agg(
            F.avg("amount_paid").alias("mean"),
            F.stddev("amount_paid").alias("deviation"),
            F.count(F.lit(1)).alias("n"),
            count_if(F.col(LABEL) == 1).alias("bad"),
        )
    )
    return with_hubs(bank_view(sums), hubs)


def bank_view(sums: DataFrame) -> DataFrame:
    """Bank columns from the mean and deviation of amounts, rows and positives per bank."""
    return sums.select(
        "from_bank",
        F.round("mean", 2).alias("bank_avg_amount"),
        F.round("deviation", 2).alias("bank_std_amount"),
        F.col("n").alias("bank_total_tx"),
        F.col("bad").alias("bank_laund_tx"),
        F.round(F.col("bad") / F.col("n") * 100.0, 6).alias("bank_risk_score"),
    )


def with_hubs(banks: DataFrame, hubs: int) -> DataFrame:
    """Marks the banks with the most positives. The list of them has ``hubs`` rows at
    most, hence the broadcast."""
    banks = materialize(banks, "bank-sums")
    top = (
        banks.where(F.col("bank_laund_tx") > 0)
        .orderBy(F.col("bank_laund_tx").desc(), F.col("from_bank"))
        .limit(hubs)
        .select("from_bank", F.lit(1).alias("is_hub_bank"))
    )
    return banks.join(F.broadcast(top), "from_bank", "left").fillna({"is_hub_bank": 0})


def cycle_history(edge_table: DataFrame, include_self_loops: bool = True) -> DataFrame:
    return network.cycle_edges(edge_table, include_self_loops).withColumn("is_in_cycle", F.lit(1))


@contextmanager
def job_pool(df: DataFrame):
    """Run independent Spark jobs side by side; the cluster shares its slots."""
    with ThreadPoolExecutor(max_workers=len(PARTS) + 1) as pool:
        yield lambda work: pool.submit(inheritable_thread_target(df.sparkSession)(work))


def fit_history(
    tx: DataFrame,
    parts: tuple[str, ...] = PARTS,
    hubs: int = fv.HUB_BANKS,
    include_self_loops: bool = True,
) -> History:
    """Compute and store the history tables.

    The payments are read once. Parts of accounts and of banks come from the same sums by
    (sender, receiver, bank), which are stored when more than one part needs them.
    """
    if parts == ("bank",):
        return History(bank=materialize(bank_history(tx, hubs), "bank"))
    if parts == ("cycle",):
        return History(cycle=materialize(cycle_history(network.edges(tx), include_self_loops), "cycle"))
    sums = batch_sums(tx)
    if len(parts) > 1:
        sums = materialize(sums, "batch-sums")
    edge_table = edges_of(sums)
    if len(parts) - ("bank" in parts) > 1:
        edge_table = materialize(edge_table, "edges")
    build = {
        "sender": lambda: sender_history(edge_table),
        "receiver": lambda: receiver_history(edge_table),
        "cycle": lambda: cycle_history(edge_table, include_self_loops),
        "bank": lambda: with_hubs(bank_view(bank_sums(sums)), hubs),
    }
    with job_pool(tx) as submit:
        pending = {part: submit(lambda part=part: materialize(build[part](), part)) for part in parts}
        return History(**{part: job.result() for part, job in pending.items()})


_KEYS = {"sender": [SRC], "receiver": [DST], "cycle": [SRC, DST], "bank": ["from_bank"]}
_COLUMNS = {
    "sender": ["fan_out_degree", "tx_velocity", "total_sent", "avg_sent", "amount_per_tx"],
    "receiver": ["fan_in_degree", "total_received", "avg_received"],
    "cycle": ["is_in_cycle"],
    "bank": ["bank_avg_amount", "bank_std_amount", "bank_risk_score", "is_hub_bank"],
}


def attach_history(rows: DataFrame, history: History, hot: HotKeys | None = None) -> DataFrame:
    """Left-join every fitted part to the rows, the same way at every size.

    The parts are stored tables of known size, so Catalyst broadcasts those under its
    threshold and the rows do not move. Others are shuffled with the rows; adaptive
    execution then splits the partitions of frequent keys, those of unknown accounts
    included, by the bytes that the joined rows really have.

    With ``hot`` (from ``hot_keys.find_hot_keys`` over the rows, or over the latest rows of
    a stream) frequent keys are split explicitly, which also holds where adaptive
    execution does not act.
    """
    spread_by = rows.columns
    for part, table in history.parts().items():
        keys, wanted = _KEYS[part], table.select(*_KEYS[part], *_COLUMNS[part])
        rows = rows.join(wanted, keys, "left") if hot is None else join_spread(rows, wanted, keys, hot, spread_by)
    return rows


def hot_keys_of(rows: DataFrame, parts: tuple[str, ...] = PARTS, **options) -> HotKeys:
    """Frequent keys of the rows that will be joined with the given parts."""
    return find_hot_keys(rows, sorted({key for part in parts for key in _KEYS[part]}), **options)


def amount_zscore():
    """Distance of the amount to the bank mean in deviations; a missing or zero
    deviation counts as one."""
    deviation = F.when(F.col("bank_std_amount") > 0, F.col("bank_std_amount")).otherwise(F.lit(1.0))
    return F.round((F.col("amount_paid") - F.col("bank_avg_amount")) / deviation, 4)


def high_fan_out(limit: int = fv.HIGH_FAN_OUT):
    return flag(F.col("fan_out_degree") > limit)
