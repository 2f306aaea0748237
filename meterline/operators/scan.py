"""Values carried from one key to the next, over a summary of one row per meter or strip."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterline.schema import METER

BITS = 21  # meters per block; three levels cover every BIGINT


def _before(order: str, *block: str):
    spec = Window.partitionBy(*block) if block else Window.partitionBy(F.lit(0))
    return spec.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def exclusive_scan(
    summary: DataFrame,
    sums: list[str],
    lasts: list[str],
    rows: int,
    single_task_rows: int,
    key: str = METER,
    bits: int = BITS,
) -> DataFrame:
    """Sum and latest non-null value over all keys below each key, as ``before_<name>``.

    ``rows`` is the counted size of ``summary``. Up to ``single_task_rows`` one window does; above,
    keys are scanned in blocks of at most 2**bits numbers, the block totals in blocks again, so no
    task ever sees more than one block.
    """
    if rows <= single_task_rows:
        window = _before(key)
        return summary.select(
            key,
            *[F.coalesce(F.sum(n).over(window), F.lit(0)).alias(f"before_{n}") for n in sums],
            *[F.last(n, ignorenulls=True).over(window).alias(f"before_{n}") for n in lasts],
        )

    levels = [key, "_block", "_superblock"]
    summary = summary.withColumn("_block", F.shiftright(F.col(key), bits)).withColumn(
        "_superblock", F.shiftright(F.col(key), 2 * bits)
    )
    scanned = []
    for depth, level in enumerate(levels):
        parents = levels[depth + 1 :]
        if depth:
            summary = summary.groupBy(*levels[depth:]).agg(
                *[F.sum(n).alias(n) for n in sums],
                *[F.max_by(n, F.when(F.col(n).isNotNull(), F.col(levels[depth - 1]))).alias(n)
                  for n in lasts],
            )
        window = _before(level, *parents[:1])
        scanned.append(
            summary.select(
                *levels[depth:],
                *[F.coalesce(F.sum(n).over(window), F.lit(0)).alias(f"_{depth}_{n}") for n in sums],
                *[F.last(n, ignorenulls=True).over(window).alias(f"_{depth}_{n}") for n in lasts],
            )
        )
    meters, blocks, superblocks = scanned
    joined = meters.join(blocks.drop("_superblock"), "_block").join(superblocks, "_superblock")

    def combine(name: str, how) -> Column:
        return how([F.col(f"_{depth}_{name}") for depth in range(len(levels))])

    return joined.select(
        key,
        *[
            combine(n, lambda cs: reduce(lambda a, b: a + b, cs)).alias(f"before_{n}")
            for n in sums
        ],
        *[combine(n, lambda cs: F.coalesce(*cs)).alias(f"before_{n}") for n in lasts],
    )
