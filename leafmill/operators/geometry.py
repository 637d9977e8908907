"""Boxes as four integer columns x1, y1, x2, y2: predicates, overlap measures and greedy suppression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOX = ("x1", "y1", "x2", "y2")


def box(alias: str = "") -> tuple[Column, ...]:
    return tuple(F.col(f"{alias}.{c}" if alias else c) for c in BOX)


def within(inner: str, outer: str) -> Column:
    """All four edges of inner lie in outer, edges included."""
    a, b = box(inner), box(outer)
    return (a[0] >= b[0]) & (a[1] >= b[1]) & (a[2] <= b[2]) & (a[3] <= b[3])


def overlaps(left: str, right: str) -> Column:
    """The boxes share at least an edge point."""
    a, b = box(left), box(right)
    return (a[2] >= b[0]) & (b[2] >= a[0]) & (a[3] >= b[1]) & (b[3] >= a[1])


def iou_of(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union; 0 for boxes without common area."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    both = w * h
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return F.when((w > 0) & (h > 0) & (union > 0), both.cast("double") / union.cast("double")).otherwise(F.lit(0.0))


def iou(left: str, right: str) -> Column:
    return iou_of(box(left), box(right))


def clamped(width: Column | int, height: Column | int, last_start: bool = False) -> dict[str, Column]:
    """Box columns clamped to a page; with last_start, starts stay one pixel inside."""
    width, height = (x if isinstance(x, Column) else F.lit(x) for x in (width, height))
    low = lambda c, top: F.least(F.greatest(F.col(c), F.lit(0)), top - 1) if last_start else F.greatest(F.col(c), F.lit(0))
    return {"x1": low("x1", width), "y1": low("y1", height), "x2": F.least("x2", width), "y2": F.least("y2", height)}


def greedy_suppression(df: DataFrame, keys: list[str], order: list[Column], item: Column, clash: Callable[[Column, Column], Column]) -> DataFrame:
    """One row for each group with `kept`: its items in order, without those that clash with a kept one.

    The fold holds one group in one row, as suppression is sequential in it; a group is a page and label.
    `order` are orderable expressions, smallest first, and become part of the items as o0, o1, ...
    """
    entry = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], item.alias("item"))
    listed = df.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("__all"))
    none = F.slice("__all", 1, 0)
    kept = F.aggregate("__all", none, lambda acc, x: F.when(F.exists(acc, lambda y: clash(y["item"], x["item"])), acc).otherwise(F.concat(acc, F.array(x))))
    return listed.select(*keys, kept.alias("kept"))


def nms(df: DataFrame, keys: list[str], score: str, tie: list[str], threshold: float) -> DataFrame:
    """Rows kept by greedy non-maximum suppression: a box goes if its IoU with a kept one is above the threshold."""
    fields = F.struct(*[F.col(c).alias(c) for c in (*BOX, score, *tie)])
    clash = lambda a, b: iou_of(tuple(a[c] for c in BOX), tuple(b[c] for c in BOX)) > threshold
    kept = greedy_suppression(df, keys, [-F.col(score), *[F.col(t) for t in tie]], fields, clash)
    return kept.select(*keys, F.explode("kept").alias("k")).select(*keys, "k.item.*")
