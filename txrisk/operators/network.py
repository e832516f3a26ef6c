"""Account network: edges, degrees, reciprocal flows.

Every operator starts from the edge table, one row per distinct sender and
receiver. Building it shuffles on both ends, so an account with a huge number of
payments is spread over many tasks, and repeated payments are combined before
the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.functions.scalars import count_if, share_pct
from txrisk.operators.profiles import LABEL

SRC, DST = "from_account", "to_account"


def edges(tx: DataFrame, *extra_keys: str) -> DataFrame:
    """Distinct (sender, receiver) with row count, positives and amount."""
    return tx.groupBy(SRC, DST, *extra_keys).agg(
        F.count(F.lit(1)).alias("n_tx"),
        count_if(F.col(LABEL) == 1).alias("n_laundering"),
        F.sum("amount_paid").alias("amount"),
    )


def distinct_edges(tx: DataFrame) -> DataFrame:
    return tx.select(SRC, DST).distinct()


def degree_by_class(tx: DataFrame, direction: str) -> DataFrame:
    """Distinct counterparties, rows and amount per account and class."""
    account, other = (SRC, DST) if direction == "out" else (DST, SRC)
    return (
        edges(tx, LABEL)
        .groupBy(account, LABEL)
        .agg(
            F.count(other).alias("counterparties"),
            F.sum("n_tx").alias("n_tx"),
            F.round(F.sum("amount"), 2).alias("total_amount"),
        )
    )


def degree_summary(degrees: DataFrame) -> DataFrame:
    return degrees.groupBy(LABEL).agg(
        F.round(F.avg("counterparties"), 2).alias("avg_counterparties"),
        F.round(F.avg("n_tx"), 2).alias("avg_tx"),
        F.max("counterparties").alias("max_counterparties"),
    )


def velocity_by_class(tx: DataFrame) -> DataFrame:
    return tx.groupBy(SRC, LABEL).agg(F.count(F.lit(1)).alias("n_tx"))


def velocity_summary(velocity: DataFrame) -> DataFrame:
    return velocity.groupBy(LABEL).agg(
        F.round(F.avg("n_tx"), 2).alias("avg_tx"),
        F.max("n_tx").alias("max_tx"),
    )


def self_loops(tx: DataFrame) -> DataFrame:
    looped = F.col(SRC) == F.col(DST)
    return tx.agg(
        count_if(looped).alias("self_loops"),
        count_if(looped & (F.col(LABEL) == 1)).alias("laundering_self_loops"),
    ).withColumn("rate_pct", share_pct(F.col("laundering_self_loops"), F.col("self_loops")))


def bank_flows(tx: DataFrame) -> DataFrame:
    """Bank to bank flow of the positive payments."""
    return (
        tx.where(F.col(LABEL) == 1)
        .groupBy("from_bank", "to_bank")
        .agg(F.count(F.lit(1)).alias("n_tx"), F.round(F.sum("amount_paid"), 2).alias("total_amount"))
    )


def _two_way(edge_table: DataFrame) -> DataFrame:
    """One row per unordered account pair with the counts of both directions.

    A direction and its reverse meet under the same unordered key, so reciprocal
    flows are found by one aggregation and no self-join. Unknown accounts never
    match. For a self-payment both directions are the same edge.
    """
    known = edge_table.where(F.col(SRC).isNotNull() & F.col(DST).isNotNull())
    up, down = F.col(SRC) <= F.col(DST), F.col(SRC) >= F.col(DST)
    return known.groupBy(
        F.least(SRC, DST).alias("low"), F.greatest(SRC, DST).alias("high")
    ).agg(
        F.sum(F.when(up, F.col("n_tx")).otherwise(0)).alias("n_up"),
        F.sum(F.when(down, F.col("n_tx")).otherwise(0)).alias("n_down"),
        F.sum(F.when(up, F.col("n_laundering")).otherwise(0)).alias("bad_up"),
        F.sum(F.when(down, F.col("n_laundering")).otherwise(0)).alias("bad_down"),
    ).where((F.col("n_up") > 0) & (F.col("n_down") > 0))


def cycle_edges(edge_table: DataFrame, include_self_loops: bool = True) -> DataFrame:
    """Directed edges whose reverse exists too, with their row count."""
    pairs = _two_way(edge_table)
    loop = F.col("low") == F.col("high")
    if not include_self_loops:
        pairs = pairs.where(~loop)
    forward = F.struct(F.col("low").alias(SRC), F.col("high").alias(DST), F.col("n_up").alias("n_tx"))
    back = F.struct(F.col("high").alias(SRC), F.col("low").alias(DST), F.col("n_down").alias("n_tx"))
    directed = F.when(loop, F.array(forward)).otherwise(F.array(forward, back))
    return pairs.select(F.explode(directed).alias("e")).select("e.*")


def cycle_pair_counts(edge_table: DataFrame) -> DataFrame:
    """Number of forward x reverse row pairs, and of distinct payments, in cycles.

    The pairs are counted as products of edge counts; they are never produced.
    """
    pairs = _two_way(edge_table).where(F.col("low") != F.col("high"))
    zero = F.lit(0).cast("bigint")
    counted = pairs.agg(
        F.coalesce(F.sum(F.col("n_up") * F.col("n_down") * 2), zero).alias("cycle_pairs"),
        F.coalesce(
            F.sum(F.col("bad_up") * F.col("n_down") + F.col("bad_down") * F.col("n_up")), zero
        ).alias("laundering_pairs"),
        F.coalesce(F.sum(F.col("n_up") + F.col("n_down")), zero).alias("cycle_tx"),
        F.coalesce(F.sum(F.col("bad_up") + F.col("bad_down")), zero).alias("laundering_tx"),
    )
    return counted.withColumn("rate_pct", share_pct(F.col("laundering_pairs"), F.col("cycle_pairs")))


def graph_size(edge_table: DataFrame) -> DataFrame:
    """Nodes, edges and payments. Pass a stored edge table: it is read twice."""
    ends = edge_table.select(F.explode(F.array(SRC, DST)).alias("account")).where("account IS NOT NULL")
    nodes = ends.distinct().agg(F.count(F.lit(1)).alias("nodes")).scalar()
    return edge_table.agg(
        F.count(F.lit(1)).alias("edges"),
        F.sum("n_tx").alias("transactions"),
        F.sum("n_laundering").alias("laundering_transactions"),
    ).select(nodes.alias("nodes"), "edges", "transactions", "laundering_transactions")
