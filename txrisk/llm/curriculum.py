"""Mixing of sources to target weights along a time-varying curriculum.

Each source has a target of words and a schedule, a piecewise linear density over
training time from 0 to 1. The integral of the schedule, scaled to the target, is the
source's cumulative demand. The documents of a source stand one after another in an
order set by a hash, as often as the target needs; a copy whose middle lies before the
target is taken, and the time at which the demand reaches that middle is its training
position. Ordering by position gives the mix.

Running totals are built in two levels, over hash slices of a source and inside a
slice, so that no task holds a source. Only tables with one row per source pass
through a window without a partition key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txrisk.llm.common import materialize, whole_text, words_of

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
SLICE_DIGITS = 3  # hexadecimal digits: 4096 slices a source
#: (time, density) knots; the sources take them in turn: constant, falling, rising.
SCHEDULES: tuple[tuple[tuple[float, float], ...], ...] = (
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 0.5), (0.5, 0.5), (1.0, 2.0)),
)


def sized(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Narrow rows with the words of the whole text and the place in the source's order."""
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return docs.select(
        "doc_id",
        "source",
        F.size(words_of(whole_text())).cast("long").alias("size"),
        order.alias("place"),
        F.substring(order, 1, SLICE_DIGITS).alias("slice"),
        *keep,
    )


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS
) -> DataFrame:
    """One row per source: weight, words, target and rank.

    Sources rank by code point, null last, and take the weights in turn. The words of all
    sources are shared by weight; a share stops at ``max_repeats`` times the source's words
    and the excess is shared again. That is the water level that the sources reach in the
    order of cap over weight, so one running sum settles it.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.get(F.array(*[F.lit(w) for w in weights]), ((F.col("rank") - 1) % len(weights)).cast("int"))
    ranked = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("rank", F.row_number().over(by_name))
        .withColumn("weight", turn.cast("long"))
        .withColumn("cap", F.col("source_size") * max_repeats)
    )
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    earlier = by_level.rowsBetween(Window.unboundedPreceding, -1)
    filled = (
        ranked.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("capped", F.coalesce(F.sum("cap").over(earlier), F.lit(0)))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0)))
        .withColumn("level", (F.col("total") - F.col("capped")).cast("double") / F.col("open"))
        # The first source that its cap does not stop sets the level of all later ones.
        .withColumn("stopped", F.col("cap") <= F.col("level") * F.col("weight"))
    )
    level = F.min(F.when(~F.col("stopped"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(everything)
    return filled.withColumn("water", level["level"]).select(
        "source",
        "source_size",
        "weight",
        "rank",
        F.least(
            F.col("cap").cast("double"),
            F.coalesce(F.col("water") * F.col("weight"), F.col("cap").cast("double")),
        ).alias("target"),
    )


def running_start(sizes: DataFrame) -> DataFrame:
    """Adds ``start``: the words of the source's documents that stand before the row.

    Rows with the same doc_id and size share a place; their mutual order does not matter.
    """
    slices = sizes.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = slices.select(
        F.col("source").alias("of"),
        F.col("slice").alias("in_slice"),
        F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"),
    )
    inside = (
        Window.partitionBy("source", "slice")
        .orderBy("place", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = sizes.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    same = F.col("source").eqNullSafe(F.col("of")) & (F.col("slice") == F.col("in_slice"))
    return (
        local.join(bases, same)
        .withColumn("start", F.col("base") + F.col("inside"))
        .drop("of", "in_slice", "base", "inside")
    )


def demand_time(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time at which the integral of a schedule reaches a share (0 to 1) of its whole."""
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
    whole, reached, found = sum(areas), 0.0, None
    for (left, right), area in reversed(list(zip(zip(knots, knots[1:]), areas))):
        reached = sum(areas[: knots.index(left)])
        rest = share * whole - reached
        slope = (right[1] - left[1]) / (right[0] - left[0])
        if slope:
            step = (F.sqrt(F.lit(left[1] ** 2) + F.lit(2 * slope) * rest) - left[1]) / slope
        else:
            step = rest / left[1]
        time = F.lit(left[0]) + step
        found = time if found is None else F.when(share * whole <= reached + area, time).otherwise(found)
    return found


def assign(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    schedules=SCHEDULES,
    max_repeats: int = MAX_REPEATS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Each document with its source's target, the copies taken and their positions.

    ``positions`` has one time for each copy taken, ``taken`` the words of all copies,
    ``start`` the words before the row in its source's order.
    Null texts and texts of white space have size 0 and are not taken.
    """
    sizes = materialize(sized(docs, keep), "sizes")
    targets = materialize(source_targets(sizes, weights, max_repeats), "targets")
    named = targets.select(F.col("source").alias("of"), "source_size", "target", "rank")
    joined = running_start(sizes).join(named, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    middle = F.col("start") + F.col("size") / 2
    times = F.lit(None).cast("double")
    for turn, knots in enumerate(schedules):
        mine = (F.col("rank") - 1) % len(schedules) == turn
        times = F.when(mine, demand_time(F.col("share"), knots)).otherwise(times)
    copies = F.filter(
        F.array(*[(middle + F.lit(k) * F.col("source_size")) for k in range(max_repeats)]),
        lambda at: (F.col("size") > 0) & (at < F.col("target")),
    )
    shares = F.transform(copies, lambda at: at / F.col("target"))
    placed = joined.withColumn("shares", shares).withColumn("copies", F.size("shares"))
    for k in range(max_repeats):
        placed = placed.withColumn("share", F.get("shares", F.lit(k))).withColumn(f"time{k}", times)
    found = F.filter(F.array(*[F.col(f"time{k}") for k in range(max_repeats)]), lambda t: t.isNotNull())
    return placed.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("copies")).alias("taken"),
        "start",
        found.alias("positions"),
        *keep,
    )


def mix(assigned: DataFrame) -> DataFrame:
    """The mix in order, stored: a row (source, start, size, position) per copy taken.

    ``assigned`` comes from ``assign``; within a source no two rows with words have the same
    start. The parts are ranges of position, each sorted.
    """
    copies = assigned.select("source", "start", "size", F.explode("positions").alias("position"))
    return materialize(copies.orderBy("position", "source", "start"), "mix")


def taken_by(assigned: DataFrame, mixed: DataFrame) -> DataFrame:
    """The assigned rows with the words that the mix holds of them and their first place in it."""
    counted = mixed.groupBy("source", "start").agg(
        F.sum("size").alias("in_mix"), F.min("position").alias("first_position")
    )
    counted = counted.withColumnsRenamed({"source": "of", "start": "from"})
    # rows without words share their start with the next row, and are in no mix
    same = F.col("source").eqNullSafe(F.col("of")) & (F.col("start") == F.col("from")) & (F.col("size") > 0)
    joined = assigned.join(counted, same, "left").drop("of", "from", "taken")
    return joined.withColumn("taken", F.coalesce("in_mix", F.lit(0).cast("long"))).drop("in_mix")


def _row_keys(docs: DataFrame) -> tuple[Column, Column]:
    """Two hashes over all columns of a row; equal rows have equal hashes."""
    values = []
    for field in docs.schema.fields:
        column = F.col(f"`{field.name}`")
        values += [column.isNull(), F.to_json(F.struct(column)) if "map<" in field.dataType.simpleString() else column]
    return F.xxhash64(F.lit(0), *values), F.xxhash64(F.lit(1), *values)


def training_order(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the documents' columns, a row per copy taken, sorted by position.

    Each row keeps its own positions. Rows that are equal in all columns cannot be told apart,
    so one of them stands for all and takes the positions of all.
    """
    first, second = _row_keys(docs)
    marked = docs.withColumns({"__first": first, "__second": second})
    taken = assign(marked, keep=("__first", "__second"), **options).where(F.size("positions") > 0)
    keys = ["__first", "__second"]
    copies = taken.groupBy(*keys).agg(F.flatten(F.collect_list("positions")).alias("__positions"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = marked.select(*keys, whole.alias("__row")).groupBy(*keys).agg(F.first("__row").alias("__row"))
    spread = rows.join(copies, keys).withColumn("__position", F.explode("__positions"))
    return spread.orderBy("__position", "__row.doc_id").select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns])
