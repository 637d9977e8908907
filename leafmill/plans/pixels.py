"""Queries over pixels: embeddings stand for 8 x 8 grey images or heat maps, worked on as stacks in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import raster, text
from ..operators import regions
from ..session import table
from .registry import query

SIDE = 8


def stacked(of: Callable[[np.ndarray], list], schema: str):
    """For mapInArrow over (id, values): `of` gets the maps of a batch as one (n, 8, 8) array of doubles, and gives a column
    each for the rest of the schema; ids without values have nulls."""
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches):
        for batch in batches:
            values = batch.column(1)
            there = values.is_valid()
            known = values.filter(there)
            maps = known.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, SIDE, SIDE)
            columns = [x if isinstance(x, pa.Array) else pa.array(x) for x in of(maps)]
            if len(known) < len(values):
                at = pa.array(np.where(there.to_numpy(zero_copy_only=False), np.cumsum(there.to_numpy(zero_copy_only=False)) - 1, 0), mask=~there.to_numpy(zero_copy_only=False))
                columns = [pc.take(x, at) for x in columns]
            yield pa.record_batch([batch.column(0), *columns], names=names)

    return run


def _of_maps(spark, sf, of, schema: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "embedding").mapInArrow(stacked(of, schema), schema)


def _joined(values: np.ndarray) -> pa.Array:
    """Each map's values as one text, with commas."""
    flat = values.reshape(len(values), -1).astype(np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, max(flat.shape[1], 1)), pa.int32()), pc.cast(pa.array(flat.ravel()), pa.string()))
    return pc.binary_join(lists, ",")


def grey(maps: np.ndarray) -> np.ndarray:
    """8-bit images of maps: 0 to 1 becomes 0 to 255, cut to whole values. Single precision, as the table has it."""
    return np.floor(np.clip(maps, 0, 1) * 255).astype(np.uint8)


_GREY = "CAST(floor(greatest(least(CAST(embedding[i + 1] AS DOUBLE), 1), 0) * 255) AS INTEGER)"
_PIXELS = f"px AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, {_GREY} AS v, embedding[i + 1] > 0.15 AS m FROM embeddings, (SELECT CAST(unnest(range(0, 64)) AS INTEGER) AS i))"


@query("""WITH p AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, embedding[i + 1] > 0.15 AS m FROM embeddings, (SELECT unnest(range(0, 64)) AS i)),
d AS (SELECT a.vec_id, a.y, a.x, bool_or(b.m) AS m FROM p a JOIN p b ON a.vec_id = b.vec_id AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 GROUP BY ALL)
SELECT vec_id, count(*) FILTER (m) AS n_on, round(100.0 * count(*) FILTER (m) / 64, 4) AS coverage FROM d GROUP BY vec_id""")
def q_mask_dilate(spark, sf):
    """Embeddings as 8 x 8 heat maps: mask and two rounds of dilation in Arrow batches."""
    def of(maps):
        on = (raster.dilate(raster.mask_of(maps.astype(np.float32), np.float32(0.15))) > 0).sum(axis=(1, 2))
        return [on, np.round(100.0 * on / SIDE**2, 4)]

    return _of_maps(spark, sf, of, "vec_id long, n_on long, coverage double")


@query()
def q_png_pages(spark, sf):
    """Embeddings as grey images in PNG form."""
    out = _of_maps(spark, sf, lambda maps: [pa.array([raster.png(m) for m in grey(maps)], pa.binary())], "vec_id long, png binary")
    return out.select("vec_id", text.data_url("png").alias("url"))


def _upscaled_sql(corners: bool) -> str:
    at = "i * 7 / 14.0::DOUBLE" if corners else "least(i * 8 / 15.0::DOUBLE, 7)"
    return f"""SELECT vec_id, round(sum(v), 4) AS total, count(*) FILTER (v > 0.1) AS n_on FROM (
  SELECT vec_id, (e[8 * y0 + x0 + 1] * (1 - fx) + e[8 * y0 + x1 + 1] * fx) * (1 - fy) + (e[8 * y1 + x0 + 1] * (1 - fx) + e[8 * y1 + x1 + 1] * fx) * fy AS v
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    (SELECT CAST(floor(p) AS INT) AS y0, CAST(least(floor(p) + 1, 7) AS INT) AS y1, p - floor(p) AS fy FROM (SELECT {at} AS p FROM (SELECT unnest(range(0, 15)) AS i))),
    (SELECT CAST(floor(p) AS INT) AS x0, CAST(least(floor(p) + 1, 7) AS INT) AS x1, p - floor(p) AS fx FROM (SELECT {at} AS p FROM (SELECT unnest(range(0, 15)) AS i)))) GROUP BY vec_id"""


def _upscaled(spark, sf, corners: bool) -> DataFrame:
    def of(maps):
        wide = raster.resize_bilinear(maps, 15, 15, corners)
        return [np.round(wide.sum(axis=(1, 2)), 4), (raster.mask_of(wide, 0.1) > 0).sum(axis=(1, 2))]

    return _of_maps(spark, sf, of, "vec_id long, total double, n_on long")


@query(_upscaled_sql(True))
def q_upscaled_corners(spark, sf):
    """8 x 8 heat maps at 15 x 15, corners aligned, and their masks."""
    return _upscaled(spark, sf, True)


@query(_upscaled_sql(False))
def q_upscaled_ratio(spark, sf):
    """8 x 8 heat maps at 15 x 15, by the ratio of the sizes."""
    return _upscaled(spark, sf, False)


@query("""SELECT label, i AS pos, max(embedding[i + 1]) AS v, bool_or(embedding[i + 1] > 0.15) AS masked FROM embeddings, (SELECT CAST(unnest(range(0, 64)) AS INTEGER) AS i) GROUP BY label, i""")
def q_heat_max_by_label(spark, sf):
    """Element-wise largest value of a label's heat maps, and the union of their masks: partial aggregates of pixels."""
    e = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("pos", "v"))
    return e.groupBy("label", "pos").agg(F.max("v").alias("v"), F.bool_or(F.col("v") > 0.15).alias("masked"))


@query("""WITH RECURSIVE p AS (SELECT vec_id, i // 8 AS y, i % 8 AS x FROM embeddings, (SELECT unnest(range(0, 64)) AS i) WHERE embedding[i + 1] > 0.15),
r AS (SELECT vec_id, y * 8 + x AS root, y, x FROM p UNION SELECT p.vec_id, r.root, p.y, p.x FROM r JOIN p ON p.vec_id = r.vec_id AND abs(p.y - r.y) <= 1 AND abs(p.x - r.x) <= 1),
c AS (SELECT vec_id, y, x, min(root) AS part FROM r GROUP BY ALL),
b AS (SELECT vec_id, part, (max(x) + 1 - min(x)) * (max(y) + 1 - min(y)) AS area FROM c GROUP BY ALL)
SELECT e.vec_id, count(area) AS n_boxes, CAST(coalesce(sum(area), 0) AS BIGINT) AS area FROM embeddings e LEFT JOIN b ON b.vec_id = e.vec_id AND area >= 4 GROUP BY e.vec_id""")
def q_mask_contours(spark, sf):
    """Boxes of the connected parts of each mask, of an area of 4 at least."""
    def of(maps):  # parts are followed map by map
        found = [raster.bounding_boxes(m, 4) for m in raster.mask_of(maps.astype(np.float32), np.float32(0.15))]
        return [pa.array([len(b) for b in found], pa.int64()), pa.array([sum((x2 - x1) * (y2 - y1) for x1, y1, x2, y2 in b) for b in found], pa.int64())]

    return _of_maps(spark, sf, of, "vec_id long, n_boxes long, area long")


_WHITE = "count(*) FILTER (embedding[i + 1] >= 0.05 AND i // 8 BETWEEN 1 AND 3 AND i % 8 BETWEEN 1 AND 3) + count(*) FILTER (embedding[i + 1] >= 0.05 AND i // 8 BETWEEN 2 AND 6 AND i % 8 BETWEEN 2 AND 6)"


@query(f"""SELECT vec_id, {_WHITE} AS white, CAST(34 AS BIGINT) AS total, CASE WHEN ({_WHITE}) / 34.0::DOUBLE >= 0.4 THEN 'Simple' ELSE 'Complex' END AS background_type
FROM embeddings, (SELECT unnest(range(0, 64)) AS i) GROUP BY vec_id""")
def q_white_ratio(spark, sf):
    """White pixels of two overlapping child boxes inside a parent box, on embeddings as images."""
    def of(maps):
        white, total = raster.white_counts(maps.astype(np.float32) >= np.float32(0.05), (1, 1, 7, 7), [(0, 0, 4, 4), (2, 2, 8, 8)])
        return [white, np.full(len(maps), total)]

    shares = _of_maps(spark, sf, of, "vec_id long, white long, total long")
    return shares.withColumn("background_type", regions.background(F.col("white"), F.col("total"), 0.4))


@query("""SELECT vec_id, array_to_string([CASE WHEN embedding[(i % 8) * 8 + 8 - i // 8] > 0.15 THEN 1 ELSE 0 END for i in range(0, 64)], '') AS bits FROM embeddings""")
def q_rotated_masks(spark, sf):
    """Masks turned left by 90 degrees."""
    def of(maps):
        bits = raster.rotate_stack(raster.mask_of(maps.astype(np.float32), np.float32(0.15))) > 0
        return [pc.replace_substring(_joined(bits), ",", "")]

    return _of_maps(spark, sf, of, "vec_id long, bits string")


def _resampled_sql(m: int, kernel: str, support: float, columns: str) -> str:
    """Separable resampling of the 8 x 8 grey images to m x m, pixels rounded, as `raster.resample` has it."""
    ratio = 8 / m
    wide = max(ratio, 1.0)
    reach = support * wide
    return f"""WITH {_PIXELS},
k AS (SELECT j, o, (o + 0.5 - (j + 0.5) * {ratio!r}::DOUBLE) / {wide!r}::DOUBLE AS d FROM (SELECT unnest(range(0, {m})) AS j), (SELECT unnest(range(0, 8)) AS o)
  WHERE o >= floor((j + 0.5) * {ratio!r}::DOUBLE - {reach!r}::DOUBLE) AND o < ceil((j + 0.5) * {ratio!r}::DOUBLE + {reach!r}::DOUBLE)),
w AS (SELECT j, o, ({kernel}) / sum({kernel}) OVER (PARTITION BY j) AS w FROM k),
t AS (SELECT vec_id, j AS y, x, sum(v * w) AS v FROM px JOIN w ON px.y = w.o GROUP BY vec_id, j, x),
r AS (SELECT vec_id, t.y AS y, j AS x, CAST(greatest(least(floor(round(sum(v * w), 6) + 0.5), 255), 0) AS BIGINT) AS v FROM t JOIN w ON t.x = w.o GROUP BY vec_id, t.y, j)
SELECT vec_id, {columns} FROM r GROUP BY vec_id"""


_TRIANGLE = "greatest(1 - abs(d), 0)"
_LANCZOS = "CASE WHEN abs(d) >= 3 THEN 0 WHEN d = 0 THEN 1 ELSE 3 * sin(pi() * d) * sin(pi() * d / 3) / (pi() * pi() * d * d) END"
_ALL = "string_agg(CAST(v AS VARCHAR), ',' ORDER BY y, x) AS pixels"


def _resampled(spark, sf, size: int) -> DataFrame:
    def of(maps):
        wide = [raster.resample(m, size, size) for m in grey(maps)]
        return [_joined(np.stack(wide) if wide else np.zeros((0, size, size)))]

    return _of_maps(spark, sf, of, "vec_id long, pixels string")


@query(_resampled_sql(16, _TRIANGLE, 1.0, _ALL))
def q_resampled_larger(spark, sf):
    """Grey images at 16 x 16 by the triangle kernel."""
    return _resampled(spark, sf, 16)


@query(_resampled_sql(4, _TRIANGLE, 1.0, _ALL))
def q_resampled_smaller(spark, sf):
    """Grey images at 4 x 4: the kernel widens."""
    return _resampled(spark, sf, 4)


@query(_resampled_sql(60, _LANCZOS, 3.0, "sum(v) AS total, count(*) FILTER (v > 127) AS n_light, CAST(15 AS BIGINT) AS steps").replace("sum(v) AS total", "CAST(sum(v) AS BIGINT) AS total"))
def q_line_inputs(spark, sf):
    """Grey images as inputs of the line reader: height 60 by the Lanczos kernel, and their time steps."""

    def of(maps):
        total, light, steps = [], [], []
        for m in grey(maps):
            line, n = raster.line_input(m[..., None])
            whole = np.round(line * 255).astype(np.int64)
            total.append(int(whole.sum()))
            light.append(int((whole > 127).sum()))
            steps.append(n)
        return [pa.array(x, pa.int64()) for x in (total, light, steps)]

    return _of_maps(spark, sf, of, "vec_id long, total long, n_light long, steps long")


@query(f"WITH {_PIXELS} SELECT vec_id, string_agg(CAST(CASE WHEN m THEN 255 ELSE v END AS VARCHAR), ',' ORDER BY y, x) AS pixels FROM px GROUP BY vec_id")
def q_white_filled(spark, sf):
    """Grey images with white under their masks."""

    def of(maps):
        mask = raster.mask_of(maps.astype(np.float32), np.float32(0.15))
        return [_joined(raster.fill_white(grey(maps)[..., None], mask)[..., 0])]

    return _of_maps(spark, sf, of, "vec_id long, pixels string")


@query(f"""WITH {_PIXELS}, b AS (SELECT a.vec_id, a.y, a.x, CASE WHEN a.m THEN 255 ELSE 0 END AS base, CASE WHEN s.m THEN 255 WHEN NOT s.m THEN 0 END AS part FROM px a LEFT JOIN px s ON s.vec_id = a.vec_id AND s.y = a.y - 1 AND s.x = a.x - 2 AND a.y <= 6)
SELECT vec_id, string_agg(CAST(greatest(base, coalesce(part, 0)) AS VARCHAR), ',' ORDER BY y, x) AS pixels FROM b GROUP BY vec_id""")
def q_assembled_masks(spark, sf):
    """A page's mask of two region masks, by the larger value; the second is cut off at the edge."""

    def of(maps):
        mask = raster.mask_of(maps.astype(np.float32), np.float32(0.15))
        return [_joined(raster.assemble((SIDE, SIDE), [(0, 0, mask), (2, 1, mask[:, :6])]))]

    return _of_maps(spark, sf, of, "vec_id long, pixels string")


@query(f"""WITH {_PIXELS}, b AS (SELECT a.vec_id, a.y, a.x, a.v AS base, s.v AS part FROM px a LEFT JOIN px s ON s.vec_id = a.vec_id AND s.y = a.y - 1 AND s.x = a.x - 2 AND a.y <= 6)
SELECT vec_id, string_agg(CAST(coalesce(part, base) AS VARCHAR), ',' ORDER BY y, x) AS pixels FROM b GROUP BY vec_id""")
def q_overlaid_regions(spark, sf):
    """A region pasted over a page, cut off at the edge."""

    def of(maps):
        return [_joined(raster.overlay(grey(maps), [(2, 1, grey(maps)[:, :6])]))]

    return _of_maps(spark, sf, of, "vec_id long, pixels string")


@query(f"""WITH {_PIXELS}, b AS (SELECT *, CASE WHEN (x BETWEEN 3 AND 6 AND y BETWEEN 2 AND 7) AND (x IN (3, 4, 5, 6) OR y IN (2, 3, 6, 7)) THEN '255.50.50'
  WHEN x BETWEEN 0 AND 7 AND y BETWEEN 0 AND 5 AND (x <= 2 OR x >= 5 OR y <= 2 OR y >= 3) THEN '0.100.255' END AS frame FROM px)
SELECT vec_id, string_agg(coalesce(frame, v || '.' || v || '.' || v), ',' ORDER BY y, x) AS pixels FROM b GROUP BY vec_id""")
def q_debug_frames(spark, sf):
    """Frames of an outer box, 3 wide, that reaches over the edges, and of an inner one, 2 wide, over it."""

    def of(maps):
        out = []
        for m in grey(maps):
            framed = raster.debug_frames(np.repeat(m[..., None], 3, axis=2), [(1, 3, 2, 6, 9), (0, -4, 0, 12, 5)])
            out.append(",".join(".".join(map(str, p)) for p in framed.reshape(-1, 3).tolist()))
        return [pa.array(out, pa.string())]

    return _of_maps(spark, sf, of, "vec_id long, pixels string")


@query(f"WITH {_PIXELS} SELECT vec_id, CAST(sum(v) * 3 + 8 * (38 * 255 + 2 * 200) * 3 AS BIGINT) AS total, CAST(48 AS BIGINT) AS width FROM px GROUP BY vec_id")
def q_number_panels(spark, sf):
    """Grey images with a number panel at the left: 40 wide, white, with a grey line of 2 pixels."""

    def of(maps):
        wide = [raster.numbered_panel(np.repeat(m[..., None], 3, axis=2), 40) for m in grey(maps)]
        return [pa.array([int(w.sum()) for w in wide], pa.int64()), pa.array([w.shape[1] for w in wide], pa.int64())]

    return _of_maps(spark, sf, of, "vec_id long, total long, width long")
