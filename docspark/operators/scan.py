"""Running sums and last values along one order of all rows, with no group in one task.

The rows are range-sorted into blocks and staged. What a block adds is summarised in one
row, the summaries of the blocks before are combined and staged (one row a block), and every row meets the
summary of its own block: a chapter, book or user may hold any share of the rows. So running columns of running columns
are windows in a row over one exchange; each adds one pass for its summaries, which reads the columns that they need.
Restarts at a group's first row are differences of running sums, or a last value taken there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.plans.staging import stage

BLOCK, PLACE = "__block", "__place"


def in_order(rows: DataFrame, order: list[str], name: str = "ordered") -> DataFrame:
    """rows with their block and place (unique, increasing along ``order``; nulls first), staged once."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = dealt.withColumn(PLACE, F.monotonically_increasing_id())
    return stage(placed.withColumn(BLOCK, F.shiftright(PLACE, 33).cast("int")), name)


def running(rows: DataFrame, sums: dict[str, Column] | None = None, last: dict[str, Column] | None = None, before: dict[str, Column] | None = None) -> DataFrame:
    """rows (of ``in_order``) with running columns: ``sums`` up to and with the row; ``last`` value that is not null up to and with the row, or ``before`` it."""
    sums, last, before = sums or {}, last or {}, before or {}
    values = last | before
    own = rows.withColumns({f"__s_{k}": c.cast("long") for k, c in sums.items()} | {f"__v_{k}": c for k, c in values.items()})
    held = [F.sum(f"__s_{k}").alias(f"__s_{k}") for k in sums]
    held += [F.max(F.when(F.col(f"__v_{k}").isNotNull(), F.struct(PLACE, F.col(f"__v_{k}").alias("v")))).alias(f"__v_{k}") for k in values]
    earlier = Window.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    blocks = own.groupBy(BLOCK).agg(*held)
    blocks = blocks.select(BLOCK, *[F.sum(f"__s_{k}").over(earlier).alias(f"__b_{k}") for k in sums], *[F.last(f"__v_{k}", True).over(earlier).alias(f"__b_{k}") for k in values])
    met = own.join(F.broadcast(stage(blocks, "block-sums")), BLOCK)
    inside = Window.partitionBy(BLOCK).orderBy(PLACE)
    upto, past = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow), inside.rowsBetween(Window.unboundedPreceding, -1)
    out = {k: F.coalesce(F.sum(f"__s_{k}").over(upto), F.lit(0)) + F.coalesce(f"__b_{k}", F.lit(0)) for k in sums}
    wrapped = {k: F.when(F.col(f"__v_{k}").isNotNull(), F.struct(F.col(f"__v_{k}").alias("v"))) for k in values}
    out |= {k: F.coalesce(F.last(wrapped[k], True).over(upto if k in last else past)["v"], F.col(f"__b_{k}.v")) for k in values}
    return met.withColumns(out).drop(*[f"__{x}_{k}" for x in "svb" for k in {**sums, **values}])
