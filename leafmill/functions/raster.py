"""Pixel arithmetic on numpy arrays, for Arrow functions, and the column forms of what is plain arithmetic."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def resize_bilinear(a: np.ndarray, height: int, width: int, corners: bool = True) -> np.ndarray:
    """Bilinear resize of one map or a stack of them, with corner-aligned coordinates, or with the ratio of the sizes."""
    h, w = a.shape[-2:]
    def axis(n: int, m: int) -> np.ndarray:
        scale = ((n - 1) / (m - 1) if m > 1 else 0.0) if corners else n / m
        return np.minimum(np.arange(m) * scale, n - 1)
    y, x = axis(h, height), axis(w, width)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    upper, lower = a[..., y0, :], a[..., y1, :]
    top = upper[..., x0] * (1 - fx) + upper[..., x1] * fx
    return top * (1 - fy) + (lower[..., x0] * (1 - fx) + lower[..., x1] * fx) * fy


def triangle(x: np.ndarray) -> np.ndarray:
    return np.maximum(1 - np.abs(x), 0)


def lanczos3(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0)


def resample_weights(n: int, m: int, kernel, support: float) -> np.ndarray:
    """(m, n) weights of n old samples for each of m new ones: the kernel around each new centre, widened where the
    image shrinks, over old samples within the image, with sum 1."""
    ratio = n / m
    wide = max(ratio, 1.0)
    centre = (np.arange(m) + 0.5) * ratio
    reach = support * wide
    low = np.clip(np.floor(centre - reach), 0, n - 1)
    high = np.clip(np.ceil(centre + reach), low + 1, n)
    old = np.arange(n)[None, :]
    w = kernel((old + 0.5 - centre[:, None]) / wide)
    w = np.where((old >= low[:, None]) & (old < high[:, None]), w, 0)
    return w / w.sum(axis=1, keepdims=True)


def resample(image: np.ndarray, height: int, width: int, kernel=triangle, support: float = 1.0) -> np.ndarray:
    """8-bit image (h, w) or (h, w, channels) at another size: rows first, then columns, rounded and kept within 0 to 255.

    Halves go up, after sums are rounded to six digits, so that their order doesn't matter.
    """
    down = resample_weights(image.shape[0], height, kernel, support)
    across = resample_weights(image.shape[1], width, kernel, support)
    tall = np.tensordot(down, image.astype(np.float64), axes=(1, 0))
    out = np.moveaxis(np.tensordot(across, tall, axes=(1, 1)), 0, 1)
    return np.clip(np.floor(np.round(out, 6) + 0.5), 0, 255).astype(np.uint8)


def mask_of(heat: np.ndarray, threshold: float = 0.3) -> np.ndarray:
    return np.where(heat > threshold, 255, 0).astype(np.uint8)


def combined(maps: list[np.ndarray], height: int, width: int) -> np.ndarray:
    """Largest value of several heat maps, each resized first."""
    return np.maximum.reduce([resize_bilinear(m, height, width) for m in maps])


def dilate(mask: np.ndarray, rounds: int = 2) -> np.ndarray:
    """3 x 3 maximum filter of one mask or a stack of them, outside ignored."""
    out = mask
    for _ in range(rounds):
        p = np.pad(out, [(0, 0)] * (out.ndim - 2) + [(1, 1), (1, 1)])
        out = np.maximum.reduce([p[..., i : i + out.shape[-2], j : j + out.shape[-1]] for i in range(3) for j in range(3)])
    return out


def fill_white(image: np.ndarray, mask: np.ndarray) -> np.ndarray:
    return np.where((mask > 0)[..., None], np.uint8(255), image)


def assemble(shape: tuple[int, int], parts: list[tuple[int, int, np.ndarray]]) -> np.ndarray:
    """Full mask of region masks (x, y, mask), by the larger value; masks may be stacks of one length."""
    out = np.zeros((*parts[0][2].shape[:-2], *shape) if parts else shape, np.uint8)
    for x, y, m in parts:
        h, w = min(m.shape[-2], shape[0] - y), min(m.shape[-1], shape[1] - x)
        out[..., y : y + h, x : x + w] = np.maximum(out[..., y : y + h, x : x + w], m[..., :h, :w])
    return out


def overlay(base: np.ndarray, parts: list[tuple[int, int, np.ndarray]]) -> np.ndarray:
    """Regions of a grey image, or of a stack of them, pasted in order; later ones win."""
    out = base.copy()
    for x, y, m in parts:
        h, w = min(m.shape[-2], out.shape[-2] - y), min(m.shape[-1], out.shape[-1] - x)
        out[..., y : y + h, x : x + w] = m[..., :h, :w]
    return out


def crop(image: np.ndarray, x1: int, y1: int, x2: int, y2: int) -> np.ndarray:
    h, w = image.shape[:2]
    return image[max(y1, 0) : min(y2, h), max(x1, 0) : min(x2, w)]


def rotate_left(image: np.ndarray) -> np.ndarray:
    return np.rot90(image)


def rotate_stack(maps: np.ndarray) -> np.ndarray:
    """A stack of maps, each turned left by 90 degrees."""
    return np.rot90(maps, axes=(-2, -1))


def outline(image: np.ndarray, x1: int, y1: int, x2: int, y2: int, colour: tuple[int, ...], thick: int) -> np.ndarray:
    """A rectangle's frame, drawn inwards; both corners are part of it, and are moved into the image first."""
    out, (h, w) = image.copy(), image.shape[:2]
    x1, x2 = (min(max(v, 0), w - 1) for v in (x1, x2))
    y1, y2 = (min(max(v, 0), h - 1) for v in (y1, y2))
    for t in range(thick):
        for y in (y1 + t, y2 - t):
            if 0 <= y < h:
                out[y, x1 : x2 + 1] = colour
        for x in (x1 + t, x2 - t):
            if 0 <= x < w:
                out[y1 : y2 + 1, x] = colour
    return out


#: Colour and width of the frames around boxes of label 0 and of label 1.
DEBUG_FRAMES = {0: ((0, 100, 255), 3), 1: ((255, 50, 50), 2)}


def debug_frames(image: np.ndarray, boxes: list[tuple[int, int, int, int, int]]) -> np.ndarray:
    """Frames of boxes (label, x1, y1, x2, y2): label 0 first, label 1 over them."""
    out = image
    for label, (colour, thick) in DEBUG_FRAMES.items():
        for k, *box in boxes:
            if k == label:
                out = outline(out, *box, (*colour, 255)[: image.shape[-1]], thick)
    return out


def numbered_panel(image: np.ndarray, panel: int) -> np.ndarray:
    """A white panel of that width at the left of an RGB image, with a grey line of 2 pixels between; digits need a font and are not drawn."""
    h, w = image.shape[:2]
    out = np.full((h, w + panel, image.shape[2]), 255, np.uint8)
    out[:, panel:] = image
    out[:, panel - 2 : panel, :3] = 200
    return out


def white_share(image: np.ndarray, parent: tuple[int, int, int, int], boxes: list[tuple[int, int, int, int]], level: int = 240) -> tuple[int, int]:
    """White pixels and all pixels of child boxes inside the parent and the page; overlaps count twice."""
    white, total = white_counts((image >= level).all(axis=-1), parent, boxes)
    return int(white), total


def white_counts(white: np.ndarray, parent: tuple[int, int, int, int], boxes: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, int]:
    """As `white_share`, for one map of white pixels or a stack of them."""
    h, w = white.shape[-2:]
    count, total = np.zeros(white.shape[:-2], np.int64), 0
    for x1, y1, x2, y2 in boxes:
        part = white[..., max(y1, parent[1], 0) : max(min(y2, parent[3], h), 0), max(x1, parent[0], 0) : max(min(x2, parent[2], w), 0)]
        count = count + part.sum(axis=(-2, -1))
        total += part.shape[-2] * part.shape[-1]
    return count, total


def bounding_boxes(mask: np.ndarray, least_area: int = 100) -> list[tuple[int, int, int, int]]:
    """Boxes of 8-connected parts of a mask of at least that area, in reading order."""
    seen, out = np.zeros(mask.shape, bool), []
    for y, x in zip(*np.nonzero(mask), strict=True):
        if seen[y, x]:
            continue
        stack, ys, xs = [(y, x)], [], []
        seen[y, x] = True
        while stack:
            a, b = stack.pop()
            ys.append(a)
            xs.append(b)
            for c in range(max(a - 1, 0), min(a + 2, mask.shape[0])):
                for d in range(max(b - 1, 0), min(b + 2, mask.shape[1])):
                    if mask[c, d] and not seen[c, d]:
                        seen[c, d] = True
                        stack.append((c, d))
        box = (int(min(xs)), int(min(ys)), int(max(xs)) + 1, int(max(ys)) + 1)
        if (box[2] - box[0]) * (box[3] - box[1]) >= least_area:
            out.append(box)
    return sorted(out, key=lambda b: (b[1], b[0]))


def chw(image: np.ndarray, size: int) -> np.ndarray:
    """Square detector input: resized by the triangle kernel, 0 to 1, channels first."""
    return np.moveaxis(resample(image, size, size), -1, 0).astype(np.float32) / np.float32(255)


def fitted_size(width: int, height: int, target: int, step: int = 64, least: int = 256) -> tuple[int, int, float]:
    """(width, height, scale): the larger side scaled to the target, both cut to whole pixels, rounded up to a multiple of `step`, `least` at least."""
    scale = np.float32(target) / np.float32(max(width, height))
    side = lambda n: max(-(-int(np.float32(n) * scale) // step) * step, least)
    return side(width), side(height), float(scale)


def cleaner_input(image: np.ndarray, target: int) -> tuple[np.ndarray, tuple[int, int, float]]:
    """Input of the text cleaner: values 0 to 255, channels first, and (height, width, scale)."""
    width, height, scale = fitted_size(image.shape[1], image.shape[0], target)
    return np.moveaxis(resample(image, height, width), -1, 0).astype(np.float32), (height, width, scale)


def line_input(image: np.ndarray, line: int = 60, least: int = 10) -> tuple[np.ndarray, int]:
    """Input of the line reader: height `line`, width in proportion (`least` at least), 0 to 1, channels first; and its time steps."""
    h, w = image.shape[:2]
    width = max(int(np.float32(w) * (np.float32(line) / np.float32(max(h, 1)))), least)
    return np.moveaxis(resample(image, line, width, lanczos3, 3.0), -1, 0).astype(np.float32) / np.float32(255), width // 4


def png(image: np.ndarray) -> bytes:
    """A PNG of an 8-bit grey (h, w) or RGB (h, w, 3) image."""
    h, w = image.shape[:2]
    rows = np.ascontiguousarray(image, np.uint8).reshape(h, -1)
    raw = np.hstack([np.zeros((h, 1), np.uint8), rows]).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if image.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def blend(front: Column, back: Column, alpha: Column) -> Column:
    """Blended channel, cut to an integer."""
    return (front * alpha + back * (F.lit(1.0) - alpha)).cast("int")


def panel_width(height: Column) -> Column:
    """Width of the number panel beside a region."""
    return F.least(F.greatest((height * 0.15).cast("int"), F.lit(40)), F.lit(80))


def fitted_side(side: Column, scale: Column, step: int = 64, least: int = 256) -> Column:
    """A scaled side, rounded up to a multiple of `step`."""
    return F.greatest(F.ceil(side * scale / step) * step, F.lit(least)).cast("int")


def sequence_length(width: Column, height: Column, line: int = 60) -> Column:
    """Time steps of a line scaled to height 60: a quarter of its width, of 10 pixels at least."""
    return F.floor(F.greatest(F.round(width * F.lit(float(line)) / height), F.lit(10)) / 4).cast("int")


def text_margin(width: Column, height: Column) -> Column:
    return F.least(F.greatest((F.least(width, height) * 0.02).cast("int"), F.lit(2)), F.lit(8))


def largest_fitting(sizes: Column, fits) -> Column:
    """The largest of the candidate sizes that fits; null if none does."""
    return F.array_max(F.filter(sizes, fits))


def canvas(x1: Column, y1: Column, x2: Column, y2: Column) -> dict[str, Column]:
    """Geometry of the canvas that a region's text is drawn on, from the union of its child boxes: sides, margin (2 % of the smaller
    side, 2 to 8), room for the text, and the bounds of the font size."""
    width, height = (F.greatest(b - a, F.lit(1)).cast("double") for a, b in ((x1, x2), (y1, y2)))
    margin = F.least(F.greatest(F.least(width, height) * 0.02, F.lit(2.0)), F.lit(8.0))
    room = lambda side: F.greatest(side - margin * 2, F.lit(10.0))
    most = F.greatest(F.least(room(height), F.lit(72.0)), F.lit(8.0))
    return {"canvas_width": width, "canvas_height": height, "margin": margin, "room_width": room(width), "room_height": room(height), "least_font": F.lit(7.0), "most_font": most}


def centred(room: Column, text: Column, margin: Column) -> Column:
    """Where a text of that extent starts in its room, the margin included."""
    return F.greatest((room - text) / 2.0 + margin, margin)


def best_font_size(fits, least: float, most: float, smallest: float = 6.0) -> float:
    """The largest size that fits: by bisection to within 1, then by steps of a half around it, as a larger size may break fewer lines.

    If `least` doesn't fit, whole steps down to `smallest`, which is the answer if nothing fits.
    """
    low, high = max(least, smallest), most
    best = low
    if fits(high):
        best = high
    elif not fits(low):
        size = low
        while size >= smallest and not fits(size):
            size -= 1.0
        if size < smallest:
            return smallest
        best = size
    else:
        a, b = low, high
        while b - a > 1.0:
            middle = (a + b) / 2.0
            a, b = (middle, b) if fits(middle) else (a, middle)
        best = a
    around = [min(max(best + k / 2, low), high) for k in range(-6, 7) if k]
    return max([best, *(x for x in around if x > best and fits(x))])
