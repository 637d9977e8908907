"""Detections to categorised regions: containment, orphans, background by child area, region ids.

All joins have the page as an equality key, so none is a product; a page's boxes are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import not_blank
from .geometry import BOX, overlaps, within


def confident(det: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    """Detections of the threshold's score or more."""
    return det.filter(F.col(score) >= threshold)


def children(det: DataFrame) -> DataFrame:
    """(parent p, child c): boxes of label 1 inside boxes of label 0 of the page; a child may have several parents."""
    p, c = det.filter("label = 0").alias("p"), det.filter("label = 1").alias("c")
    return p.join(c, (F.col("p.page_index") == F.col("c.page_index")) & within("c", "p"))


def partial_overlaps(det: DataFrame) -> DataFrame:
    """(parent p, child c) that touch or overlap, but not inside: a warning each."""
    p, c = det.filter("label = 0").alias("p"), det.filter("label = 1").alias("c")
    return p.join(c, (F.col("p.page_index") == F.col("c.page_index")) & overlaps("c", "p") & ~within("c", "p"))


def orphans(det: DataFrame) -> DataFrame:
    """Boxes of label 1 inside no box of label 0 of their page."""
    c, p = det.filter("label = 1").alias("c"), det.filter("label = 0").select("page_index", *BOX).alias("p")
    return c.join(p, (F.col("c.page_index") == F.col("p.page_index")) & within("c", "p"), "left_anti")


def background(white: Column, total: Column, threshold: float = 0.6) -> Column:
    """Simple if the white share reaches the threshold, else (and without pixels) Complex."""
    return F.when((total > 0) & (white / F.nullif(total, F.lit(0)) >= threshold), F.lit("Simple")).otherwise(F.lit("Complex"))


def with_page_boxes(det: DataFrame, white: Column | None = None) -> DataFrame:
    """det with n_children, child_area and white of each box of label 0, and `alone` for boxes of label 1 in no box of label 0.

    One window over a page's boxes, which are few: no join, and the table is read once. `white` is a child's
    white-pixel count, by default its area.
    """
    area = F.greatest(F.col("x2") - F.col("x1"), F.lit(0)) * F.greatest(F.col("y2") - F.col("y1"), F.lit(0))
    box = F.struct(*BOX, area.cast("long").alias("area"), (white if white is not None else area).cast("long").alias("white"))
    page = Window.partitionBy("page_index")
    of = lambda label: F.collect_list(F.when(F.col("label") == label, box)).over(page)
    rows = det.withColumns({"__outer": of(0), "__inner": of(1)})
    inside = lambda a, b: (a["x1"] >= b["x1"]) & (a["y1"] >= b["y1"]) & (a["x2"] <= b["x2"]) & (a["y2"] <= b["y2"])
    me = {c: F.col(c) for c in BOX}
    rows = rows.withColumn("__kids", F.when(F.col("label") == 0, F.filter("__inner", lambda c: inside(c, me))))
    total = lambda field: F.when(F.col("label") == 0, F.aggregate("__kids", F.lit(0).cast("long"), lambda s, c: s + c[field])).otherwise(F.lit(0).cast("long"))
    return rows.withColumns({
        "n_children": F.when(F.col("label") == 0, F.size("__kids")).otherwise(0).cast("long"), "child_area": total("area"), "white": total("white"),
        "alone": (F.col("label") == 1) & ~F.exists("__outer", lambda p: inside(me, p)),
    }).drop("__outer", "__inner", "__kids")


def with_warnings(det: DataFrame) -> DataFrame:
    """Boxes of labels 0 and 1 with `warnings`: "partial overlap" for each box of label 0 that a box of label 1 touches and isn't inside of,
    "orphan" for a box of label 1 in none, "no child" for a box of label 0 with none.

    One window over a page's boxes, as in `with_page_boxes`. Boxes without a page, or without an edge, meet no other.
    """
    page = Window.partitionBy("page_index")
    of = lambda label: F.collect_list(F.when((F.col("label") == label) & F.col("page_index").isNotNull(), F.struct(*BOX))).over(page)
    rows = det.filter("label in (0, 1)").withColumns({"__outer": of(0), "__inner": of(1)})
    inside = lambda a, b: F.coalesce((a["x1"] >= b["x1"]) & (a["y1"] >= b["y1"]) & (a["x2"] <= b["x2"]) & (a["y2"] <= b["y2"]), F.lit(False))
    touch = lambda a, b: (a["x2"] >= b["x1"]) & (b["x2"] >= a["x1"]) & (a["y2"] >= b["y1"]) & (b["y2"] >= a["y1"])
    me = {c: F.col(c) for c in BOX}
    partial = F.array_repeat(F.lit("partial overlap"), F.size(F.filter("__outer", lambda p: touch(me, p) & ~inside(me, p))))
    orphan = F.array_repeat(F.lit("orphan"), (~F.exists("__outer", lambda p: inside(me, p))).cast("int"))
    alone = F.array_repeat(F.lit("no child"), (~F.exists("__inner", lambda c: inside(c, me))).cast("int"))
    return rows.withColumn("warnings", F.when(F.col("label") == 1, F.concat(partial, orphan)).otherwise(alone)).drop("__outer", "__inner")


def categorised(det: DataFrame, white: Column | None = None, keep_orphans: bool = True, include_free_text: bool = True) -> DataFrame:
    """Region id, page, label, box, background and number and area of children.

    Ids are page * 10000 + place in the order: label 0, orphans, label 2, each by bubble_index. `white`
    is a child's white-pixel count; label 0 without children, orphans and label 2 are Complex.
    """
    rows = with_page_boxes(det, white).filter(F.col("label").isin(0, 2) | (F.col("alone") & F.lit(keep_orphans)))
    rank = Window.partitionBy("page_index").orderBy("label", "bubble_index")
    out = rows.withColumns({"background_type": background(F.col("white"), F.col("child_area")), "region_id": F.col("page_index") * 10000 + F.row_number().over(rank) - 1})
    out = out if include_free_text else out.filter("label <> 2")
    return out.select("page_index", "region_id", "label", *BOX, "background_type", "n_children", "child_area")


def renderable(regions: DataFrame, translations: DataFrame, replaced: DataFrame, keys: list[str], text: str = "translated_text") -> DataFrame:
    """Regions whose text is drawn, with it: not replaced by an image, with a translation that isn't blank, and with child boxes."""
    some = translations.filter(not_blank(text)).select(*keys, text)
    return regions.filter("n_children > 0").join(some, keys).join(replaced.select(*keys), keys, "left_anti")


def cleaned_or_skipped(regions: DataFrame, valid: DataFrame | None, keys: list[str]) -> DataFrame:
    """regions with `cleaned`: whether the region is in the valid set (all are without a set). The others pass through as they are."""
    if valid is None:
        return regions.withColumn("cleaned", F.lit(True))
    known = valid.select(*keys).distinct().withColumn("__valid", F.lit(True))
    return regions.join(known, keys, "left").withColumn("cleaned", F.coalesce("__valid", F.lit(False))).drop("__valid")
