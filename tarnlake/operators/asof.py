"""As-of joins by one sorted pass: both sides are united and the last payload before each left row is carried along."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, payload: list[str], *, forward: bool = False, strict: bool = False, inner: bool = False, ties: list[str] | None = None) -> DataFrame:
    """Each left row with the payload of the last right row at or before it (forward: the first at or after; strict: not at).

    Linear after one shuffle on `by`; the payload travels in a struct, so a matched NULL is a match. Rows whose time is NULL
    match nothing. `ties` orders right rows of one time: the last of them (forward: the first) is taken.
    """
    # a right row of the same time must come before the left row to match it, in either walk
    right_side, left_side = (1, 0) if strict else (0, 1)
    ties = ties or []
    keep = [c for c in left.columns]
    lhs = left.select(F.struct(*keep).alias("__row"), *[F.col(c).alias(f"__b{i}") for i, c in enumerate(by)], F.col(left_on).alias("__t"), F.lit(left_side).alias("__side"), *[F.lit(None).cast(right.schema[c].dataType).alias(f"__o{i}") for i, c in enumerate(ties)])
    rhs = right.where(F.col(right_on).isNotNull()).select(F.struct(*payload).alias("__hit"), *[F.col(c).alias(f"__b{i}") for i, c in enumerate(by)], F.col(right_on).alias("__t"), F.lit(right_side).alias("__side"), *[F.col(c).alias(f"__o{i}") for i, c in enumerate(ties)])
    both = lhs.unionByName(rhs, allowMissingColumns=True)
    turn = (lambda c: F.desc_nulls_first(c)) if forward else (lambda c: F.asc_nulls_first(c))
    order = [turn("__t"), F.asc("__side"), *[turn(f"__o{i}") for i in range(len(ties))]]
    window = Window.partitionBy(*[f"__b{i}" for i in range(len(by))]).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("__found", F.last("__hit", ignorenulls=True).over(window)).where("__row is not null")
    out = out.withColumn("__found", F.when(F.col("__t").isNotNull(), F.col("__found")))
    if inner:
        out = out.where("__found is not null")
    return out.select(*[F.col(f"__row.{c}").alias(c) for c in keep], *[F.col(f"__found.{c}").alias(c) for c in payload])
