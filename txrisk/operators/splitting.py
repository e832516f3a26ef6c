"""Splits and samples that do not depend on partitioning.

There is no row id, so a row is placed by a hash of its content: the same row
falls on the same side in every run, program and cluster layout. Equal rows stay
together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk.functions.scalars import count_if, guarded_div, share_pct
from txrisk.operators.profiles import LABEL
from txrisk.session import materialize

BUCKETS = 10_000
SPLIT_SALT = "split-42"
VALIDATION_SALT = "validation-42"
SAMPLE_SALT = "sample-42"


def content_text(df: DataFrame, columns: list[str] | None = None) -> Column:
    """All values of a row as one text, written alike on every platform."""
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def text(name: str) -> Column:
        value = F.col(name)
        if isinstance(kinds[name], (T.DoubleType, T.FloatType)):
            value = value.cast("decimal(38,6)")
        return F.coalesce(value.cast("string"), F.lit("null"))

    return F.concat_ws("|", *[text(name) for name in columns or df.columns])


def content_hash(df: DataFrame, salt: str, columns: list[str] | None = None) -> Column:
    """Even 32-bit number from the content of a row."""
    digest = F.md5(F.concat(F.lit(salt), F.lit("|"), content_text(df, columns)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def bucket(df: DataFrame, salt: str, columns: list[str] | None = None) -> Column:
    """Even bucket 0..9999 from the content hash."""
    return (content_hash(df, salt, columns) % BUCKETS).cast("int")


def split_stratified(
    df: DataFrame,
    train_share: float = 0.8,
    salt: str = SPLIT_SALT,
    columns: list[str] | None = None,
    names: tuple[str, str] = ("train", "test"),
) -> DataFrame:
    """Adds ``split``. The hash is independent of the label, so each class is cut
    at the same share."""
    cut = round(train_share * BUCKETS)
    side = F.when(bucket(df, salt, columns) < cut, names[0]).otherwise(names[1])
    return df.withColumn("split", side)


def split_temporal(df: DataFrame, train_share: float = 0.8, ts: str = "ts") -> DataFrame:
    """Adds ``split``: train is the first part of the time range."""
    span = df.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    cut = span.select(F.col("lo") + (F.col("hi") - F.col("lo")) * F.lit(train_share)).scalar()
    return df.withColumn("split", F.when(F.col(ts) <= cut, "train").otherwise("test"))


def split_summary(df: DataFrame, label: str = LABEL) -> DataFrame:
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"),
        count_if(F.col(label) == 1).alias("positives"),
    ).withColumn("positive_pct", share_pct(F.col("positives"), F.col("n")))


def undersample(
    df: DataFrame,
    ratio: float = 10.0,
    salt: str = SAMPLE_SALT,
    columns: list[str] | None = None,
    label: str = LABEL,
) -> DataFrame:
    """All positives, and a hash sample of about ``ratio`` negatives per positive."""
    counts = df.agg(
        count_if(F.col(label) == 1).alias("pos"), count_if(F.col(label) == 0).alias("neg")
    )
    wanted = guarded_div(F.col("pos") * F.lit(float(ratio)), F.col("neg")) * (1 << 32)
    limit = counts.select(F.coalesce(wanted, F.lit(0.0))).scalar()
    return df.where((F.col(label) == 1) | (content_hash(df, salt, columns) < limit))


_HASH, _HIGH = "_hash", "_high"


def _reached(counts: DataFrame, label: str, value: str, quota: Column, cap: str) -> DataFrame:
    """Per class the smallest value up to which at least ``quota`` rows lie, and the rows
    before it. ``counts`` has a row per class and value, 65,536 per class at most."""
    upto = Window.partitionBy(label).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = counts.withColumn("_upto", F.sum("n").over(upto))
    first = F.min(F.struct(value, (F.col("_upto") - F.col("n")).alias("before")))
    # a class with fewer rows than its quota gets no row here: all of it is taken
    return running.where(F.col("_upto") >= quota).groupBy(label, *([cap] if cap else [])).agg(first.alias("at"))


def take_quota(
    df: DataFrame,
    quota: Column,
    label: str = LABEL,
    salt: str = SAMPLE_SALT,
    columns: list[str] | None = None,
    name: str = "taken",
) -> DataFrame:
    """Marks exactly ``quota`` rows of each class: those with the smallest content hashes.

    ``quota`` is a column of ``label``, ``n`` (rows of the class) and ``totals`` (a map of
    all classes to their rows). The k-th smallest hash is found by counting twice, first
    the upper, then the lower half of the hash, so no class is sorted or brought together.
    Rows that share the last hash are counted by content; of a repeated row as many copies
    are taken as are missing. A quota of zero or less takes no row, one beyond the class
    all of it; rows without a class are never taken.
    """
    carried = df.columns
    # read four times below, so written once
    hashed = materialize(df.withColumn(_HASH, content_hash(df, salt, columns)), "quota-rows")
    high, low = F.shiftright(_HASH, 16), F.col(_HASH).bitwiseAND((1 << 16) - 1)
    upper = materialize(
        hashed.where(F.col(label).isNotNull()).groupBy(label, high.alias(_HIGH)).agg(F.count(F.lit(1)).alias("n")), "quota-counts"
    )
    sizes = upper.groupBy(label).agg(F.sum("n").alias("n"))
    # one row per class
    totals = F.map_from_entries(F.collect_list(F.struct(label, "n")))
    whole = sizes.select(label, "n").withColumn("totals", sizes.agg(totals.alias("t")).scalar())
    wanted = materialize(whole.select(label, F.least(quota.cast("long"), F.col("n")).alias("quota")), "quotas")
    counts = upper.join(wanted.where("quota > 0"), label)
    first = _reached(counts, label, _HIGH, F.col("quota"), "quota").select(
        label, F.col("at." + _HIGH).alias(_HIGH), (F.col("quota") - F.col("at.before")).alias("left")
    )
    inside = hashed.join(first, (F.col(_HASH).isNotNull()) & (hashed[label] == first[label]) & (high == first[_HIGH]))
    lower = inside.groupBy(first[label].alias(label), first[_HIGH].alias(_HIGH), first["left"].alias("left"), low.alias("low")).agg(
        F.count(F.lit(1)).alias("n")
    )
    last = _reached(lower.withColumn("both", F.struct(_HIGH, "left")), label, "low", F.col("left"), "both").select(
        label,
        (F.shiftleft("both." + _HIGH, 16) + F.col("at.low")).alias("_last"),
        (F.col("both.left") - F.col("at.before")).alias("_missing"),
    )
    last = materialize(last, "quota-cuts")
    cut = hashed.join(last, label, "left")
    decided = cut.where((F.col(_HASH) != F.col("_last")) | F.col("_last").isNull())
    decided = decided.select(*carried, F.coalesce(F.col(_HASH) < F.col("_last"), F.lit(False)).alias(name))
    return decided.unionByName(_settle_ties(cut.where(F.col(_HASH) == F.col("_last")), carried, label, name))


def _settle_ties(tied: DataFrame, carried: list[str], label: str, name: str) -> DataFrame:
    """Rows with the last hash of their class: one row per content, taken in order of content."""
    groups = tied.groupBy(*carried, "_missing").agg(F.count(F.lit(1)).alias("n"))
    # different contents with one 32-bit hash: a class in 2 ** 32 of its rows
    before = Window.partitionBy(label).orderBy(*carried).rowsBetween(Window.unboundedPreceding, -1)
    free = F.col("_missing") - F.coalesce(F.sum("n").over(before), F.lit(0))
    taken = F.least(F.greatest(free, F.lit(0)), F.col("n"))
    copies = F.concat(F.array_repeat(F.lit(True), taken.cast("int")), F.array_repeat(F.lit(False), (F.col("n") - taken).cast("int")))
    return groups.withColumn("_copies", copies).select(*carried, F.explode("_copies").alias(name))


def split_exact(
    df: DataFrame,
    train_share: float = 0.8,
    salt: str = SPLIT_SALT,
    columns: list[str] | None = None,
    names: tuple[str, str] = ("train", "test"),
    label: str = LABEL,
) -> DataFrame:
    """Adds ``split``; each class is cut at its share to the row (halves go to the first part)."""
    quota = F.floor(F.col("n") * F.lit(float(train_share)) + F.lit(0.5))
    marked = take_quota(df, quota, label, salt, columns)
    return marked.withColumn("split", F.when(F.col("taken"), names[0]).otherwise(names[1])).drop("taken")


def undersample_exact(
    df: DataFrame,
    ratio: float = 10.0,
    salt: str = SAMPLE_SALT,
    columns: list[str] | None = None,
    label: str = LABEL,
) -> DataFrame:
    """All positives and exactly ``ratio`` negatives per positive, or all there are."""
    positives = F.coalesce(F.try_element_at("totals", F.lit(1)), F.lit(0))
    quota = F.when(F.col(label) == 1, F.col("n")).otherwise(F.floor(positives * F.lit(float(ratio))))
    return take_quota(df, quota, label, salt, columns).where("taken").drop("taken")


def class_weight(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Negatives per positive: the weight of a positive row."""
    counts = df.agg(
        count_if(F.col(label) == 1).alias("positives"), count_if(F.col(label) == 0).alias("negatives")
    )
    return counts.withColumn(
        "positive_weight",
        F.round(guarded_div(F.col("negatives").cast("double"), F.col("positives")), 6),
    )


def union_parts(*parts: DataFrame) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
