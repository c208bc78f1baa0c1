"""Intervals, islands and nearest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(frame: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """Numbers the maximal runs of equal values: adds ``island`` (from 0 per group)."""
    window = Window.partitionBy(*group).orderBy(*order)
    change = (F.lag(value).over(window).isNotNull() & ~F.lag(value).over(window).eqNullSafe(F.col(value))).cast("int")
    return frame.withColumn("_change", change).withColumn("island", F.sum("_change").over(window.rowsBetween(Window.unboundedPreceding, 0))).drop("_change")


def allen(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    """Allen's relation of two half-open intervals."""
    return (
        F.when(hi_a < lo_b, "before")
        .when(lo_a > hi_b, "after")
        .when(hi_a == lo_b, "meets")
        .when(lo_a == hi_b, "met_by")
        .when((lo_a == lo_b) & (hi_a == hi_b), "equal")
        .when((lo_a == lo_b) & (hi_a < hi_b), "starts")
        .when(lo_a == lo_b, "started_by")
        .when((hi_a == hi_b) & (lo_a > lo_b), "finishes")
        .when(hi_a == hi_b, "finished_by")
        .when((lo_a > lo_b) & (hi_a < hi_b), "during")
        .when((lo_a < lo_b) & (hi_a > hi_b), "contains")
        .when(lo_a < lo_b, "overlaps")
        .otherwise("overlapped_by")
    )


def interval_relation(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    """Relation of one interval to another; a shared end alone is inside or
    containing, ends that touch are met; NONE where an end is null."""
    return (
        F.when(lo_a.isNull() | hi_a.isNull() | lo_b.isNull() | hi_b.isNull(), "NONE")
        .when((lo_a == lo_b) & (hi_a == hi_b), "EQUAL")
        .when((lo_a >= lo_b) & (hi_a <= hi_b), "INSIDE")
        .when((lo_a <= lo_b) & (hi_a >= hi_b), "CONTAIN")
        .when(lo_a > hi_b, "AFTER")
        .when(hi_a < lo_b, "BEFORE")
        .when(lo_a == hi_b, "BEGIN_MEET_END")
        .when(hi_a == lo_b, "END_MEET_BEGIN")
        .otherwise("OVERLAP")
    )


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Pairs of overlapping intervals (lo, hi) with equal keys.

    Both sides are spread over buckets of ``width``; a pair is kept in the
    bucket where it begins, so it comes out once. Columns of b get ``_b``.
    """
    bucket = lambda: F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width)))
    left = a.where("hi > lo").withColumn("_bucket", bucket())
    right = b.where("hi > lo").withColumn("_bucket", bucket())
    right = right.select(*keys, "_bucket", *(F.col(c).alias(f"{c}_b") for c in b.columns if c not in keys))
    joined = left.join(right, [*keys, "_bucket"]).where((F.col("lo") < F.col("hi_b")) & (F.col("lo_b") < F.col("hi")))
    return joined.where(F.floor(F.greatest("lo", "lo_b") / width) == F.col("_bucket")).drop("_bucket")


def latest_before(frame: DataFrame, group: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Adds the latest non-null value of earlier rows of the group."""
    window = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return frame.withColumn(name, F.last(value, ignorenulls=True).over(window))


def non_overlapping(spans: DataFrame, group: list[str]) -> DataFrame:
    """Spans kept by falling priority, then length, then start, none overlapping
    a kept one; per group, in Arrow batches (``lo, hi, priority``)."""
    import pandas as pd

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        order = pdf.assign(_n=pdf["hi"] - pdf["lo"]).sort_values(["priority", "_n", "lo", "hi"], ascending=[False, False, True, True])
        taken: list[tuple[int, int]] = []
        keep = []
        for i, lo, hi in zip(order.index, order["lo"], order["hi"]):
            if all(hi <= a or lo >= b for a, b in taken):
                taken.append((lo, hi))
                keep.append(i)
        return pdf.loc[sorted(keep)]

    return spans.groupBy(*group).applyInPandas(pick, spans.schema)
