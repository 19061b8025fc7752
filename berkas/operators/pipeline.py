"""From images to regions with text: one Arrow pass over the pixels (enhance, detect, straighten, crop, recognise, read
doubtful crops again); order, lines and text of the regions are DataFrame work (`operators.layout`).

Edge cases: an image that is null, empty, too large or cannot be read, and one whose model is missing or fails, has its
error in the row and no regions, and the others go on; an image without text has an empty list; equal images are read once
each unless `dedup.scored_once` goes before; an empty table gives no rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from berkas.config import Config
from berkas.operators import vision

REGION = "struct<idx:int,text:string,conf:double,min_x:double,min_y:double,max_x:double,max_y:double,polygon:array<struct<x:double,y:double>>>"
BATCH = 16


def detected(rgb: np.ndarray, detector: Callable, config: Config) -> list[tuple[np.ndarray, float]]:
    """(four corners, confidence) of the text regions of an image, overlapping ones left out."""
    tensor, sx, sy = vision.detector_input(rgb, config.det_max_side_len)
    prob = np.asarray(detector(tensor[None]), dtype=float)
    h, w = prob.shape
    scale, most = np.array([sx, sy]), np.array([rgb.shape[1], rgb.shape[0]], float)
    found = []
    for pts in vision.contours(prob, config.det_threshold, 4):
        lo, hi = pts.min(0), pts.max(0)
        inside = prob[lo[1] : hi[1] + 1, lo[0] : hi[0] + 1]
        score = float(inside[inside >= config.det_threshold].mean())
        if score < config.det_box_thresh:
            continue
        # the border as its box: area over perimeter sets how far it grows
        bw, bh = (hi - lo).astype(float)
        grow = max(bw * bh, 1.0) * config.unclip_ratio / max(2 * (bw + bh), 1.0)
        d = pts - pts.mean(0)
        angle = 0.5 * np.arctan2(2 * (d[:, 0] * d[:, 1]).sum(), (d[:, 0] ** 2).sum() - (d[:, 1] ** 2).sum())
        if 1.5 <= abs(np.degrees(angle)) <= 45:
            turn = np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
            uv = d @ turn
            (u0, v0), (u1, v1) = uv.min(0) - grow, uv.max(0) + grow
            quad = np.array([(u0, v0), (u1, v0), (u1, v1), (u0, v1)]) @ turn.T + pts.mean(0)
            quad = np.clip(quad, 0, [w - 1, h - 1])
        else:
            (x0, y0), (x1, y1) = np.maximum(lo - grow, 0), np.minimum(hi + grow, [w - 1, h - 1])
            quad = np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1)])
        found.append((np.clip(quad * scale, 0, most), score))
    return suppressed(found, config.nms_iou_threshold)


def suppressed(regions: list[tuple[np.ndarray, float]], most: float) -> list[tuple[np.ndarray, float]]:
    """Regions by falling confidence, without those that overlap a kept one by more than `most` of their union."""
    kept: list[tuple[np.ndarray, float]] = []
    for quad, score in sorted(regions, key=lambda r: -r[1]):
        if all(_overlap(quad, k) <= most for k, _ in kept):
            kept.append((quad, score))
    return kept


def _overlap(a: np.ndarray, b: np.ndarray) -> float:
    side = np.minimum(a.max(0), b.max(0)) - np.maximum(a.min(0), b.min(0))
    both = float(np.maximum(side, 0).prod())
    every = float((a.max(0) - a.min(0)).prod() + (b.max(0) - b.min(0)).prod()) - both
    return both / every if every > 0 else 0.0


def skew(regions: list[tuple[np.ndarray, float]]) -> float:
    """Mean slope in degrees of the upper edges over twenty pixels long that slope by under 45."""
    d = np.array([q[1] - q[0] for q, _ in regions]) if regions else np.zeros((0, 2))
    a = np.degrees(np.arctan2(d[:, 1], d[:, 0]))
    a = a[(np.hypot(d[:, 0], d[:, 1]) > 20) & (np.abs(a) < 45)]
    return float(a.mean()) if len(a) else 0.0


def crop(rgb: np.ndarray, quad: np.ndarray) -> np.ndarray | None:
    """The pixels of a region: turned upright where it is tilted, else its box with a margin; None under three pixels."""
    if np.degrees(abs(np.arctan2(*(quad[1] - quad[0])[::-1]))) >= 1.5:
        return vision.quad_crop(rgb, quad)
    h = max(float(quad[:, 1].max() - quad[:, 1].min()), 1.0)
    mx, my = max(h * 0.15, 3), max(h * 0.1, 2)
    x0, y0 = np.maximum(np.floor(quad.min(0) - [mx, my]), 0).astype(int)
    x1, y1 = np.minimum(np.ceil(quad.max(0) + [mx, my]), [rgb.shape[1], rgb.shape[0]]).astype(int)
    return rgb[y0:y1, x0:x1] if x1 - x0 >= 3 and y1 - y0 >= 3 else None


def recognised(crops: list[np.ndarray], recogniser: Callable) -> list[tuple[str, float]]:
    """(text, confidence) of crops, read in batches of like width."""
    order = sorted(range(len(crops)), key=lambda i: crops[i].shape[1] / crops[i].shape[0])
    out: list = [("", 0.0)] * len(crops)
    for a in range(0, len(order), BATCH):
        for i, got in zip(order[a : a + BATCH], recogniser([crops[i] for i in order[a : a + BATCH]])):
            out[i] = got
    return out


def read_image(rgb: np.ndarray, detector: Callable, recogniser: Callable, config: Config = Config()) -> list[tuple[np.ndarray, str, float]]:
    """(four corners, text, confidence) of the regions of an image that can be read."""
    img = vision.enhanced(rgb, config.enhancement_variance_threshold) if config.enhancement_enabled else rgb
    regions = detected(img, detector, config)
    if config.deskew_enabled and abs(angle := skew(regions)) >= 1.5:
        img = vision.deskewed(img, angle)
        regions = detected(img, detector, config) or regions
    cut = [(q, c) for q, _ in regions if (c := crop(img, q)) is not None]
    items = [(q, c, t, s) for (q, c), (t, s) in zip(cut, recognised([c for _, c in cut], recogniser)) if t and s >= config.rec_threshold]
    if config.second_pass_enabled:
        weak = [i for i, x in enumerate(items) if x[3] < config.second_pass_threshold]
        again = recognised([vision.enhanced(items[i][1], config.enhancement_variance_threshold) for i in weak], recogniser)
        for i, (t, s) in zip(weak, again):
            if t and s > items[i][3]:
                items[i] = (*items[i][:2], t, s)
    return [(q, t, float(s)) for q, _, t, s in items]


def read(images: DataFrame, detector: Callable | None, recogniser: Callable | None, config: Config = Config()) -> DataFrame:
    """images (height, width, data in blue-green-red or grey, error, ...) with `regions` in place of the pixels."""
    keep = [f for f in images.schema.fields if f.name not in ("data", "error", "regions")]

    def one(h, w, data) -> tuple[list, str | None]:
        if data is None or not h or not w or h < 0 or w < 0:
            return [], "Invalid image: Image has zero width or height"
        if w > config.max_image_width or h > config.max_image_height:
            return [], f"Image too large: {w}x{h} exceeds {config.max_image_width}x{config.max_image_height}"
        if detector is None or recogniser is None:
            return [], f"Model not found: no {'detection' if detector is None else 'recognition'} model was given"
        try:
            px = np.frombuffer(data, np.uint8).reshape(h, w, -1)
            rgb = np.repeat(px[..., :1], 3, 2) if px.shape[2] == 1 else px[..., 2::-1]
        except ValueError as e:
            return [], f"Invalid image: {e}"
        try:
            got = read_image(rgb, detector, recogniser, config)
        except FileNotFoundError as e:
            return [], str(e)
        except Exception as e:  # noqa: BLE001
            return [], f"Inference failed: {e}"
        rows = []
        for i, (q, t, s) in enumerate(got):
            (x0, y0), (x1, y1) = q.min(0), q.max(0)
            rows.append({"idx": i, "text": t, "conf": s, "min_x": x0, "min_y": y0, "max_x": x1, "max_y": y1, "polygon": [{"x": x, "y": y} for x, y in q]})
        return rows, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [([], e) if isinstance(e, str) else one(h, w, d) for h, w, d, e in zip(b["height"], b["width"], b["data"], b["error"])]
            yield b.drop(columns=["data", "error"]).assign(regions=[g for g, _ in got], error=[e for _, e in got])

    given = images if "error" in images.columns else images.withColumn("error", F.lit(None).cast("string"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), f"regions array<{REGION}>", "error string"])
    return given.select(*[f.name for f in keep], "data", "error").mapInPandas(run, schema)


def words(found: DataFrame, keys: list[str]) -> DataFrame:
    """A row per region of `read`."""
    return found.select(*keys, F.explode("regions").alias("r")).select(*keys, "r.*")
