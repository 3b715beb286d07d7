"""Parents, children and descendants of processes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.session import cut_lineage


def with_parent(
    processes: DataFrame, guid: str, parent_guid: str, columns: list[str], order: list[str] | None = None
) -> DataFrame:
    """Process rows with columns of their parent, prefixed ``parent_``.

    Where a guid has several rows, its first one by ``order`` (the columns themselves if none) counts.
    """
    first = F.min_by(F.struct(*columns), F.struct(*(order or columns)))
    parents = processes.groupBy(F.col(guid).alias(parent_guid)).agg(first.alias("_first"))
    parents = parents.select(parent_guid, *[F.col(f"_first.{c}").alias(f"parent_{c}") for c in columns])
    return processes.join(parents, parent_guid)


def descendants(processes: DataFrame, guid: str, parent_guid: str, test: Column) -> DataFrame:
    """Processes with an ancestor that meets ``test``, however far up.

    Pointer doubling: each round every process looks as far up again as it
    could before, so depth n takes log2(n) joins. A process leaves the rounds
    once it has met a hit or run out of ancestors; one that has looked further
    than there are processes is on a cycle without a hit. Each round is written
    to the checkpoint folder.
    """
    tested = processes.select(F.col(guid).alias("id"), F.col(parent_guid).alias("up"), test.alias("own"))
    own = tested.select(F.col("id").alias("up"), F.col("own").alias("_hit"), F.lit(True).alias("_known"))
    own = own.groupBy("up").agg(F.bool_or("_hit").alias("_hit"), F.first("_known").alias("_known"))
    start = tested.join(own, "up", "left").select(
        "id", F.when(F.col("_known"), F.col("up")).alias("up"), F.coalesce("_hit", F.lit(False)).alias("hit")
    )
    state = cut_lineage(start)
    furthest, reach = state.count(), 1
    while reach <= furthest:
        open_rows = state.filter(~F.col("hit") & F.col("up").isNotNull())
        if open_rows.isEmpty():
            break
        above = state.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("hit").alias("_hit"))
        above = above.groupBy("up").agg(F.max("_up").alias("_up"), F.bool_or("_hit").alias("_hit"))
        moved = open_rows.join(above, "up").select("id", F.col("_up").alias("up"), F.col("_hit").alias("hit"))
        closed = state.filter(F.col("hit") | F.col("up").isNull())
        state = cut_lineage(closed.unionByName(moved))
        reach *= 2
    hits = state.filter("hit").select(F.col("id").alias(guid)).distinct()
    return processes.join(hits, guid, "left_semi")
