"""Pixels, on numpy arrays inside Arrow functions: enhancement, resizing, contours, turning, drawing. Grey images are (h, w),
colour ones (h, w, 3) in red, green, blue, of bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEAN, DEVIATION = np.array([0.485, 0.456, 0.406], np.float32), np.array([0.229, 0.224, 0.225], np.float32)


def luma(rgb: np.ndarray) -> np.ndarray:
    """Grey value (77 r + 150 g + 29 b) / 256."""
    c = rgb.astype(np.uint32)
    return ((77 * c[..., 0] + 150 * c[..., 1] + 29 * c[..., 2]) >> 8).astype(np.uint8)


def variance(gray: np.ndarray) -> float:
    """Population variance."""
    g = gray.astype(np.float64)
    return float((g * g).mean() - g.mean() ** 2) if g.size else 0.0


def auto_contrast(rgb: np.ndarray) -> np.ndarray:
    """Stretched to the whole range where the grey range is under 200 and not nothing."""
    g = luma(rgb)
    lo, hi = int(g.min()), int(g.max())
    if hi - lo >= 200 or hi == lo:
        return rgb
    table = np.clip((np.arange(256) - lo) * 255 // (hi - lo), 0, 255).astype(np.uint8)
    return table[rgb]


def box_blur(gray: np.ndarray) -> np.ndarray:
    """Mean of three by three, edges repeated, whole numbers."""
    p = np.pad(gray.astype(np.uint32), 1, mode="edge")
    rows = p[:, :-2] + p[:, 1:-1] + p[:, 2:]
    return ((rows[:-2] + rows[1:-1] + rows[2:]) // 9).astype(np.uint8)


def unsharp(rgb: np.ndarray, strength: float = 0.8) -> np.ndarray:
    """Every channel scaled by how far the grey value stands off its blur."""
    g = luma(rgb)
    f = 1 + (g.astype(np.float32) - box_blur(g)) * strength / 128
    return np.clip(rgb.astype(np.float32) * f[..., None], 0, 255).astype(np.uint8)


def enhanced(rgb: np.ndarray, below: float = 500.0) -> np.ndarray:
    """Contrast and sharpness for images of low variance, others as they are."""
    return unsharp(auto_contrast(rgb)) if variance(luma(rgb)) < below else rgb


def shadows_removed(rgb: np.ndarray) -> np.ndarray:
    """Brightness evened out by a background at an eighth of the size; images under 16 pixels as they are."""
    h, w = rgb.shape[:2]
    if h < 16 or w < 16:
        return rgb
    small = resized(luma(rgb)[..., None], max(w // 8, 4), max(h // 8, 4))[..., 0]
    back = resized(box_blur(box_blur(small))[..., None], w, h)[..., 0].astype(np.float32)
    return np.clip(rgb.astype(np.float32) * (220 / np.maximum(back, 10))[..., None], 0, 255).astype(np.uint8)


def adaptive_threshold(gray: np.ndarray, c: int = 10) -> np.ndarray:
    """White where a pixel is above its blur less c."""
    return np.where(gray.astype(np.int32) > box_blur(gray).astype(np.int32) - c, 255, 0).astype(np.uint8)


def resized(img: np.ndarray, w: int, h: int) -> np.ndarray:
    """Bilinear; when shrinking, the weights widen so that every source pixel counts."""

    def weights(n: int, m: int) -> np.ndarray:
        scale = n / m
        reach = max(scale, 1.0)
        at = (np.arange(m) + 0.5) * scale - 0.5
        k = np.maximum(0, 1 - np.abs(np.arange(n)[None] - at[:, None]) / reach)
        return k / k.sum(1, keepdims=True)

    x = img.astype(np.float64)
    y = np.einsum("mh,hwc->mwc", weights(img.shape[0], h), x)
    return np.clip(np.rint(np.einsum("nw,mwc->mnc", weights(img.shape[1], w), y)), 0, 255).astype(np.uint8)


def detector_input(rgb: np.ndarray, longest: int = 960) -> tuple[np.ndarray, float, float]:
    """(channels, h, w) normalised for the detector, and the scales back to the image."""
    h, w = rgb.shape[:2]
    r = min(1.0, longest / max(h, w))
    side = lambda s: max(int(np.floor(s * r / 32 + 0.5)) * 32, 32)
    tw, th = side(w), side(h)
    x = (resized(rgb, tw, th).astype(np.float32) / 255 - MEAN) / DEVIATION
    return x.transpose(2, 0, 1), w / tw, h / th


def recogniser_input(rgb: np.ndarray, height: int = 48, most: int = 320) -> np.ndarray:
    """(channels, 48, w) with values from -1 to 1."""
    h, w = rgb.shape[:2]
    tw = int(min(max(np.floor(height * w / h + 0.5), 16), most))
    return (resized(rgb, tw, height).astype(np.float32) / 127.5 - 1).transpose(2, 0, 1)


def recogniser_batch(crops: list[np.ndarray]) -> np.ndarray:
    """Inputs of a batch, padded with zeros to the widest."""
    xs = [recogniser_input(c) for c in crops]
    out = np.zeros((len(xs), 3, 48, max(x.shape[2] for x in xs)), np.float32)
    for i, x in enumerate(xs):
        out[i, :, :, : x.shape[2]] = x
    return out


def components(on: np.ndarray) -> np.ndarray:
    """Labels of connected areas (eight neighbours) from 1, 0 for background: smallest label spread until nothing changes."""
    lab = np.where(on, np.arange(1, on.size + 1).reshape(on.shape), 0)
    while True:
        p = np.pad(lab, 1)
        new = lab
        for dy in (0, 1, 2):
            for dx in (0, 1, 2):
                q = p[dy : dy + lab.shape[0], dx : dx + lab.shape[1]]
                new = np.where(on & (q > 0), np.minimum(np.where(new > 0, new, q), q), new)
        # jump to the label's own label
        flat = np.r_[0, new.ravel()]
        new = np.where(on, flat[new], 0)
        if (new == lab).all():
            break
        lab = new
    _, out = np.unique(lab, return_inverse=True)
    return out.reshape(on.shape) if not on.all() else out.reshape(on.shape) + 1


def contours(prob: np.ndarray, threshold: float = 0.25, least_side: int = 3) -> list[np.ndarray]:
    """Border points (x, y) of every area of the map that is at least three pixels wide and high and has three border
    points; holes have no border of their own."""
    on = prob >= threshold
    lab = components(on)
    out = []
    for k in range(1, int(lab.max()) + 1 if lab.size else 1):
        m = lab == k
        p = np.pad(m, 1)
        inside = p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:]
        ys, xs = np.nonzero(m & ~inside)
        if len(xs) >= 3 and xs.max() - xs.min() + 1 >= least_side and ys.max() - ys.min() + 1 >= least_side:
            out.append(np.stack([xs, ys], 1))
    return out


def quarter_turns(img: np.ndarray, n: int) -> np.ndarray:
    """Turned clockwise by n quarters."""
    return np.rot90(img, -(n % 4))


def sampled(img: np.ndarray, x: np.ndarray, y: np.ndarray, fill: int = 255) -> np.ndarray:
    """Bilinear values at (x, y), `fill` outside."""
    h, w = img.shape[:2]
    out = np.full((*x.shape, img.shape[2]), float(fill))
    ok = (x >= 0) & (y >= 0) & (x <= w - 1) & (y <= h - 1)
    xs, ys = x[ok], y[ok]
    x0, y0 = np.floor(xs).astype(int), np.floor(ys).astype(int)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = (xs - x0)[:, None], (ys - y0)[:, None]
    i = img.astype(np.float64)
    out[ok] = (i[y0, x0] * (1 - fx) + i[y0, x1] * fx) * (1 - fy) + (i[y1, x0] * (1 - fx) + i[y1, x1] * fx) * fy
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def deskewed(img: np.ndarray, degrees: float) -> np.ndarray:
    """Turned back by an angle around the middle, white outside; as it is under half a degree."""
    if abs(degrees) < 0.5:
        return img
    h, w = img.shape[:2]
    t = np.deg2rad(degrees)
    yy, xx = np.mgrid[0:h, 0:w].astype(np.float64)
    cx, cy = w / 2, h / 2
    x = np.cos(t) * (xx - cx) - np.sin(t) * (yy - cy) + cx
    y = np.sin(t) * (xx - cx) + np.cos(t) * (yy - cy) + cy
    return sampled(img, x, y)


def quad_crop(img: np.ndarray, quad: np.ndarray) -> np.ndarray | None:
    """The content of four corners (from top left, clockwise) as an upright image; None under three pixels. A quad turned
    by under 1.5 degrees is cut out upright."""
    p = np.asarray(quad, float)
    d = lambda a, b: np.hypot(*(p[b] - p[a]))
    w, h = int(np.floor(max(d(0, 1), d(3, 2)) + 0.5)), int(np.floor(max(d(0, 3), d(1, 2)) + 0.5))
    if w < 3 or h < 3:
        return None
    a = np.degrees(np.arctan2(p[1, 1] - p[0, 1], p[1, 0] - p[0, 0]))
    if abs(a) < 1.5:
        x0, y0 = np.maximum(p.min(0), 0).astype(int)
        x1, y1 = np.ceil(p.max(0)).astype(int)
        cut = img[y0:y1, x0:x1]
        return cut if cut.shape[0] >= 3 and cut.shape[1] >= 3 else None
    u, v = np.meshgrid((np.arange(w) + 0.5) / w, (np.arange(h) + 0.5) / h)
    at = lambda k: (1 - v) * ((1 - u) * p[0, k] + u * p[1, k]) + v * ((1 - u) * p[3, k] + u * p[2, k])
    return sampled(img, at(0), at(1))


def outlined(rgb: np.ndarray, polygons: list[tuple[np.ndarray, tuple[int, int, int]]]) -> np.ndarray:
    """A copy with polygons drawn, three pixels wide."""
    out = rgb.copy()
    h, w = out.shape[:2]
    for points, colour in polygons:
        pts = np.floor(np.asarray(points, float) + 0.5).astype(int)
        for (x0, y0), (x1, y1) in zip(pts, np.roll(pts, -1, axis=0)):
            n = max(abs(x1 - x0), abs(y1 - y0), 1)
            xs, ys = np.rint(np.linspace(x0, x1, n + 1)).astype(int), np.rint(np.linspace(y0, y1, n + 1)).astype(int)
            for dx in (-1, 0, 1):
                for dy in (-1, 0, 1):
                    ok = (xs + dx >= 0) & (xs + dx < w) & (ys + dy >= 0) & (ys + dy < h)
                    out[ys[ok] + dy, xs[ok] + dx] = colour
    return out


def mapped_pixels(images: DataFrame, change: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """images (height, width, data in blue-green-red) with a function on colour arrays applied; Arrow batches, a few images
    at a time; an image that fails keeps its data and has an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for h, w, data in zip(b["height"], b["width"], b["data"]):
                try:
                    rgb = np.frombuffer(data, np.uint8).reshape(h, w, 3)[..., ::-1]
                    out = change(rgb)
                    rows.append((out.shape[0], out.shape[1], out[..., ::-1].tobytes(), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((h, w, data, f"Invalid image: {e}"))
            new = pd.DataFrame(rows, columns=["height", "width", "data", "error"], index=b.index)
            yield b.assign(**new)

    fields = [f for f in images.schema.fields if f.name not in ("height", "width", "data", "error")]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in fields), "height int", "width int", "data binary", "error string"])
    keep = images.select(*[f.name for f in fields], "height", "width", "data").withColumn("error", F.lit(None).cast("string"))
    return keep.mapInPandas(run, schema)


def coloured(gray: np.ndarray) -> np.ndarray:
    """A grey image in three equal channels."""
    return np.repeat(gray[..., None], 3, axis=2)


def mapped_grids(df: DataFrame, column: str, width: int, change: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """df with the array column `column`, the pixels of a grey image of some width row by row, changed by a function on grey
    images; a null image stays null."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([None if v is None else change(np.asarray(v).reshape(-1, width).astype(np.uint8)).astype(np.int32).ravel() for v in s], dtype=object)

    return df.withColumn(column, run(F.col(column)))


def grid_contours(df: DataFrame, column: str, width: int, threshold: float) -> DataFrame:
    """df without `column`, a map of some width, but with the number of its contours and of their points."""

    @F.pandas_udf("struct<n_contours:int,n_points:int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            found = [contours(np.asarray(v).reshape(-1, width), threshold) if v is not None else [] for v in s]
            yield pd.DataFrame({"n_contours": [len(c) for c in found], "n_points": [sum(map(len, c)) for c in found]}, dtype="int32")

    return df.withColumn("_c", run(F.col(column))).select(*[c for c in df.columns if c != column], "_c.n_contours", "_c.n_points")


# Colours of the bands of confidence, from the least confidence on.
BANDS = [(0.9, (34, 197, 94)), (0.75, (59, 130, 246)), (0.5, (245, 158, 11)), (-1.0, (239, 68, 68))]


def annotated(images: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """images (keys, height, width, data) with the polygons of their regions (keys, polygon, conf) drawn in the colour of
    their confidence; an image without regions stays as it is."""
    g = regions.groupBy(*keys).agg(F.collect_list(F.struct("polygon", "conf")).alias("_regions"))

    @F.pandas_udf("binary")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for cols in batches:
            out = []
            for h, w, data, found in zip(*cols):
                if found is None or data is None or not h or not w or h < 0:
                    out.append(data)
                    continue
                rgb = np.frombuffer(data, np.uint8).reshape(h, w, 3)[..., ::-1]
                drawn = [(np.array([(p["x"], p["y"]) for p in r["polygon"]]), next(c for b, c in BANDS if r["conf"] >= b)) for r in found]
                out.append(outlined(rgb, drawn)[..., ::-1].tobytes())
            yield pd.Series(out, dtype=object)

    x = images.join(g, keys, "left")
    return x.withColumn("data", run("height", "width", "data", "_regions")).select(*images.columns)
