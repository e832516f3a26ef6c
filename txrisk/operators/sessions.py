"""Activity sessions of accounts: payments without a longer pause between them.

Rows of one account in one stretch as long as the gap always belong to one session, so they
are first summed by account and stretch, which also spreads a busy account over tasks. The
sessions come from these pieces. Pieces of different batches, or of the micro-batches of a
stream, can be stored and put together later: late payments close pauses that earlier
batches left open.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txrisk.operators.network import SRC
from txrisk.operators.profiles import LABEL

#: A pause of this many seconds ends a session: thirty days.
GAP = 30 * 24 * 3600
_SUMS = ["n_tx", "n_laundering", "amount"]


def session_pieces(tx: DataFrame, gap: int = GAP, account: str = SRC, ts: str = "ts") -> DataFrame:
    """Sums by account and stretch of time. Rows without an account or time are left out."""
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / 1_000_000
    known = tx.where(F.col(account).isNotNull() & F.col(ts).isNotNull())
    return known.groupBy(account, F.floor(seconds / gap).alias("stretch")).agg(
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
        F.count(F.lit(1)).alias("n_tx"),
        F.sum(F.col(LABEL).cast("long")).alias("n_laundering"),
        F.sum(F.col("amount_paid").cast("decimal(28,4)")).cast("decimal(38,4)").alias("amount"),
    )


def sessions_of_pieces(pieces: DataFrame, gap: int = GAP, account: str = SRC) -> DataFrame:
    """Sessions from pieces of any number of batches.

    A session ends ``gap`` seconds after its last payment; a payment at that very moment
    still belongs to it, as in Spark's session windows. It is open while the latest payment
    of all does not lie after its end.
    """
    together = pieces.groupBy(account, "stretch").agg(
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), *[F.sum(c).cast("decimal(38,4)" if c == "amount" else "long").alias(c) for c in _SUMS]
    )
    ordered = Window.partitionBy(account).orderBy("stretch")
    pause = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(gap))
    starts = F.coalesce(F.col("first_ts") > F.lag("last_ts").over(ordered) + pause, F.lit(True))
    numbered = together.withColumn("_starts", starts.cast("int")).withColumn(
        "_session", F.sum("_starts").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    found = numbered.groupBy(account, "_session").agg(
        F.min("first_ts").alias("session_start"), F.max("last_ts").alias("last_ts"), *[F.sum(c).alias(c) for c in _SUMS]
    )
    latest = pieces.agg(F.max("last_ts").alias("latest")).scalar()
    end = F.col("last_ts") + pause
    return found.select(
        account,
        "session_start",
        end.alias("session_end"),
        "n_tx",
        "n_laundering",
        F.col("amount").cast("double").alias("amount"),
        F.when(end >= latest, 1).otherwise(0).alias("is_open"),
    )


def account_sessions(tx: DataFrame, gap: int = GAP, account: str = SRC) -> DataFrame:
    return sessions_of_pieces(session_pieces(tx, gap, account), gap, account)


def closed_sessions(stream: DataFrame, gap: int = GAP, delay: str = "1 day", account: str = SRC, ts: str = "ts") -> DataFrame:
    """Sessions of a stream that no later payment can change, by its watermark.

    They come out once the watermark passes their end, and their state is dropped then;
    payments later than ``delay`` are lost, while stored pieces keep all of them.
    """
    window = F.session_window(ts, f"{gap} seconds")
    timed = stream.where(F.col(account).isNotNull()).withColumn(ts, F.col(ts).cast("timestamp"))
    grouped = timed.withWatermark(ts, delay).groupBy(window, account)
    return grouped.agg(F.count(F.lit(1)).alias("n_tx")).select(
        account, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n_tx"
    )
