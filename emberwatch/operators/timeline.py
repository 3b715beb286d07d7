"""Ordered work on event tables, cut into slices.

A window over a whole key puts all rows of a hot key into one task. Here every
window runs over (key, slice of the order axis); what a slice needs from the
others is one summary row per slice, carried over with a second, small window.
Frames only ever grow, so a slice costs one sort and one pass.

``order`` names a long column: microseconds for events, a turn number for talks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3_600_000_000


def sliced(df: DataFrame, order: str, width: int) -> DataFrame:
    return df.withColumn("_slice", F.floor(F.col(order) / F.lit(width)).cast("long"))


def nearest(
    df: DataFrame,
    keys: list[str],
    order: str,
    marks: dict[str, tuple[Column, dict[str, Column]]],
    width: int = HOUR,
    later: bool = True,
    same: bool = False,
) -> DataFrame:
    """For every row the nearest later (or earlier) row of its key that meets a test.

    ``marks`` maps an output column to (test, payload); the output is a struct
    ``(at, *payload)``, NULL when there is no such row. ``same`` lets rows with
    an equal order value count, the row itself included. Ties go to the
    smallest payload.
    """
    best = F.min if later else F.max
    direction = F.col(order).desc() if later else F.col(order).asc()
    frame = sliced(df, order, width)
    for name, (test, payload) in marks.items():
        value = F.struct(F.col(order).alias("at"), *[c.alias(n) for n, c in payload.items()])
        frame = frame.withColumn(f"_mark_{name}", F.when(test, value))

    summary = frame.groupBy(*keys, "_slice").agg(*[best(f"_mark_{name}").alias(f"_edge_{name}") for name in marks])
    slice_order = F.col("_slice").desc() if later else F.col("_slice").asc()
    others = Window.partitionBy(*keys).orderBy(slice_order).rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.select(
        *keys, "_slice", *[best(f"_edge_{name}").over(others).alias(f"_carry_{name}") for name in marks]
    )

    inside = Window.partitionBy(*keys, "_slice").orderBy(direction).rangeBetween(
        Window.unboundedPreceding, 0 if same else -1
    )
    for name in marks:
        frame = frame.withColumn(f"_own_{name}", best(f"_mark_{name}").over(inside))
    joined = frame.join(summary, [*keys, "_slice"], "left")
    for name in marks:
        joined = joined.withColumn(name, F.coalesce(f"_own_{name}", f"_carry_{name}"))
    return joined.drop("_slice", *[f"_{kind}_{name}" for name in marks for kind in ("mark", "own", "carry")])


def running_total(
    df: DataFrame, keys: list[str], order: str, amounts: dict[str, Column], width: int = HOUR
) -> DataFrame:
    """Sums of ``amounts`` over all rows of the key up to and including the order value."""
    frame = sliced(df, order, width)
    for name, amount in amounts.items():
        frame = frame.withColumn(f"_amount_{name}", amount)
    summary = frame.groupBy(*keys, "_slice").agg(*[F.sum(f"_amount_{n}").alias(f"_slice_{n}") for n in amounts])
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.select(*keys, "_slice", *[F.sum(f"_slice_{n}").over(before).alias(f"_before_{n}") for n in amounts])
    inside = Window.partitionBy(*keys, "_slice").orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    for name in amounts:
        frame = frame.withColumn(f"_inside_{name}", F.sum(f"_amount_{name}").over(inside))
    joined = frame.join(summary, [*keys, "_slice"], "left")
    for name in amounts:
        total = F.coalesce(F.col(f"_inside_{name}"), F.lit(0)) + F.coalesce(F.col(f"_before_{name}"), F.lit(0))
        joined = joined.withColumn(name, total)
    return joined.drop("_slice", *[f"_{kind}_{n}" for n in amounts for kind in ("amount", "inside", "before")])


def trailing_total(
    df: DataFrame,
    keys: list[str],
    order: str,
    span: int | Column,
    amounts: dict[str, Column],
    width: int = HOUR,
    expires: Column | None = None,
) -> DataFrame:
    """Sums over the rows of the key in ``[order - span, order]``; a row may have a span of its own.

    Every row adds its amount when it happens and takes it back once it is
    older than ``span`` (or at ``expires``): a running total over twice the
    rows, instead of a frame that is summed anew for every row.
    """
    for name, amount in amounts.items():
        df = df.withColumn(f"_in_{name}", amount)
    leaves = F.col(order) + F.lit(span) + 1
    if expires is not None:
        leaves = F.least(leaves, expires)
    step = F.explode(
        F.array(
            F.struct(F.lit(1).alias("sign"), F.col(order).alias("at")),
            F.struct(F.lit(-1).alias("sign"), leaves.alias("at")),
        )
    )
    steps = df.withColumn("_step", step).withColumn("_at", F.col("_step.at")).withColumn("_sign", F.col("_step.sign"))
    signed = {name: F.col(f"_in_{name}") * F.col("_sign") for name in amounts}
    totals = running_total(steps.drop("_step"), keys, "_at", signed, width)
    return totals.filter(F.col("_sign") == 1).drop("_at", "_sign", *[f"_in_{n}" for n in amounts])


def sessions(df: DataFrame, keys: list[str], order: str, gap: int, width: int | None = None) -> DataFrame:
    """Add ``session_start``: the order value that opens the row's gap session.

    A row opens a session when the row before it is more than ``gap`` away.
    """
    width = width or HOUR
    frame = sliced(df, order, width)
    inside = Window.partitionBy(*keys, "_slice").orderBy(order)
    frame = frame.withColumn("_previous", F.lag(order).over(inside))
    opens = F.col("_previous").isNotNull() & (F.col(order) - F.col("_previous") > gap)
    frame = frame.withColumn("_opens", F.when(opens, F.col(order)))

    summary = frame.groupBy(*keys, "_slice").agg(
        F.min(order).alias("_first"), F.max(order).alias("_last"), F.max("_opens").alias("_inner")
    )
    by_slice = Window.partitionBy(*keys).orderBy("_slice")
    apart = F.col("_first") - F.lag("_last").over(by_slice) > gap
    summary = summary.withColumn("_head", F.when(F.coalesce(apart, F.lit(True)), F.col("_first")))
    open_after = F.coalesce("_inner", "_head")
    earlier = by_slice.rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.withColumn("_carried", F.coalesce(F.col("_head"), F.max(open_after).over(earlier)))

    started = F.max("_opens").over(inside.rangeBetween(Window.unboundedPreceding, 0))
    joined = frame.withColumn("_own", started).join(
        summary.select(*keys, "_slice", "_carried"), [*keys, "_slice"], "left"
    )
    return joined.withColumn("session_start", F.coalesce("_own", "_carried")).drop(
        "_slice", "_previous", "_opens", "_own", "_carried"
    )
