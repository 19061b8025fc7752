"""Boxes and polygons as column arithmetic. A box is four columns or a struct with min_x, min_y, max_x, max_y; a polygon is
array<struct<x,y>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(c: Column) -> Column:
    """Round half away from zero, as INT."""
    return F.round(c).cast("int")


def aabb(polygon: Column) -> Column:
    """Bounding box of a polygon; zeros for an empty one."""
    xs, ys = F.transform(polygon, lambda p: p["x"]), F.transform(polygon, lambda p: p["y"])
    z = F.lit(0.0)
    return F.struct(F.coalesce(F.array_min(xs), z).alias("min_x"), F.coalesce(F.array_min(ys), z).alias("min_y"), F.coalesce(F.array_max(xs), z).alias("max_x"), F.coalesce(F.array_max(ys), z).alias("max_y"))


def box(min_x, min_y, max_x, max_y) -> Column:
    c = [F.col(x) if isinstance(x, str) else x for x in (min_x, min_y, max_x, max_y)]
    return F.struct(*[x.cast("double").alias(n) for x, n in zip(c, ("min_x", "min_y", "max_x", "max_y"))])


def box_width(b: Column, least: float = 0.0) -> Column:
    return F.greatest(b["max_x"] - b["min_x"], F.lit(least))


def box_height(b: Column, least: float = 0.0) -> Column:
    return F.greatest(b["max_y"] - b["min_y"], F.lit(least))


def box_area(b: Column, least: float = 0.0) -> Column:
    """Area; text regions count sides of at least one (least=1), plain boxes of at least zero."""
    return box_width(b, least) * box_height(b, least)


def center(b: Column) -> tuple[Column, Column]:
    return (b["min_x"] + b["max_x"]) / 2, (b["min_y"] + b["max_y"]) / 2


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two regions, with sides of at least one; 0 where there is no union."""
    w = F.greatest(F.least(a["max_x"], b["max_x"]) - F.greatest(a["min_x"], b["min_x"]), F.lit(0.0))
    h = F.greatest(F.least(a["max_y"], b["max_y"]) - F.greatest(a["min_y"], b["min_y"]), F.lit(0.0))
    inter = w * h
    union = box_area(a, 1.0) + box_area(b, 1.0) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def polygon_area(polygon: Column) -> Column:
    """Shoelace area, at least 1."""
    return F.greatest(F.abs(_sum(F.zip_with(polygon, _turned(polygon), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]))) / 2, F.lit(1.0))


def polygon_perimeter(polygon: Column) -> Column:
    """Length of the outline, at least 1."""
    return F.greatest(_sum(F.zip_with(polygon, _turned(polygon), lambda p, q: F.sqrt(F.pow(p["x"] - q["x"], F.lit(2.0)) + F.pow(p["y"] - q["y"], F.lit(2.0))))), F.lit(1.0))


def _turned(polygon: Column) -> Column:
    return F.when(F.size(polygon) > 0, F.concat(F.slice(polygon, 2, F.greatest(F.size(polygon) - 1, F.lit(0))), F.slice(polygon, 1, 1))).otherwise(polygon)


def unclip_distance(polygon: Column, ratio: float = 1.6) -> Column:
    """How far a region is grown: area times ratio over perimeter."""
    return polygon_area(polygon) * ratio / polygon_perimeter(polygon)


def moment_angle(points: Column) -> Column:
    """Angle of the main axis of points, in radians, from second central moments; 0 for no points."""
    n = F.size(points)
    mx = _sum(F.transform(points, lambda p: p["x"].cast("double"))) / n
    my = _sum(F.transform(points, lambda p: p["y"].cast("double"))) / n
    m20 = _sum(F.transform(points, lambda p: (p["x"] - mx) * (p["x"] - mx)))
    m02 = _sum(F.transform(points, lambda p: (p["y"] - my) * (p["y"] - my)))
    m11 = _sum(F.transform(points, lambda p: (p["x"] - mx) * (p["y"] - my)))
    return F.when(n > 0, F.atan2(2 * m11, m20 - m02) / 2).otherwise(0.0)


def oriented_box(points: Column, distance: Column, width: Column, height: Column, scale_x: Column, scale_y: Column) -> Column:
    """Four corners of the region of points, grown by distance, clamped to the map and scaled to the image. Turned along
    the main axis where its angle is between 1.5 and 45 degrees, else upright."""
    t = moment_angle(points)
    deg = F.abs(F.degrees(t))
    turned = (deg >= 1.5) & (deg <= 45)
    c, s = F.cos(t), F.sin(t)
    us = F.transform(points, lambda p: p["x"] * c + p["y"] * s)
    vs = F.transform(points, lambda p: -p["x"] * s + p["y"] * c)
    u0, u1 = F.array_min(us) - distance, F.array_max(us) + distance
    v0, v1 = F.array_min(vs) - distance, F.array_max(vs) + distance
    xs, ys = F.transform(points, lambda p: p["x"].cast("double")), F.transform(points, lambda p: p["y"].cast("double"))
    x0, x1 = F.array_min(xs) - distance, F.array_max(xs) + distance
    y0, y1 = F.array_min(ys) - distance, F.array_max(ys) + distance

    def corner(u, v, x, y):
        px = F.when(turned, u * c - v * s).otherwise(x)
        py = F.when(turned, u * s + v * c).otherwise(y)
        return F.struct((F.least(F.greatest(px, F.lit(0.0)), width) * scale_x).alias("x"), (F.least(F.greatest(py, F.lit(0.0)), height) * scale_y).alias("y"))

    return F.array(corner(u0, v0, x0, y0), corner(u1, v0, x1, y0), corner(u1, v1, x1, y1), corner(u0, v1, x0, y1))


def skew_degrees(polygon: Column) -> Column:
    """Angle of the top edge of a region in degrees; null if it has under four corners, the edge is not longer than 20,
    or the angle is not under 45 degrees."""
    p, q = F.try_element_at(polygon, F.lit(1)), F.try_element_at(polygon, F.lit(2))
    dx, dy = (q["x"] - p["x"]).cast("double"), (q["y"] - p["y"]).cast("double")
    a = F.degrees(F.atan2(dy, dx))
    return F.when((F.size(polygon) >= 4) & (F.sqrt(dx * dx + dy * dy) > 20) & (F.abs(a) < 45), a)


def padded_crop(b: Column, width: Column, height: Column) -> Column:
    """Upright crop around a box: 15 % of its height to the sides (at least 3), 10 % above and below (at least 2), inside
    the image; null where less than 3 pixels remain."""
    h = box_height(b, 1.0)
    px, py = F.greatest(h * 0.15, F.lit(3.0)), F.greatest(h * 0.1, F.lit(2.0))
    x0, y0 = F.greatest(b["min_x"] - px, F.lit(0.0)).cast("int"), F.greatest(b["min_y"] - py, F.lit(0.0)).cast("int")
    x1, y1 = F.least(F.ceil(b["max_x"] + px), width).cast("int"), F.least(F.ceil(b["max_y"] + py), height).cast("int")
    w, h = x1 - x0, y1 - y0
    return F.when((w >= 3) & (h >= 3), F.struct(x0.alias("x"), y0.alias("y"), w.alias("w"), h.alias("h")))


def quad_crop_size(polygon: Column) -> Column:
    """(w, h) of a crop of a turned quad: the longer of opposite edges, rounded; null under 3 pixels or without four
    corners."""
    p = [F.try_element_at(polygon, F.lit(i)) for i in (1, 2, 3, 4)]
    d = lambda a, b: F.sqrt(F.pow(b["x"] - a["x"], F.lit(2.0)) + F.pow(b["y"] - a["y"], F.lit(2.0)))
    w = rounded(F.greatest(d(p[0], p[1]), d(p[3], p[2])))
    h = rounded(F.greatest(d(p[0], p[3]), d(p[1], p[2])))
    return F.when((F.size(polygon) == 4) & (w >= 3) & (h >= 3), F.struct(w.alias("w"), h.alias("h")))


def detection_size(w: Column, h: Column, longest: int = 960) -> Column:
    """Size and scales of the detector's input: shrunk if the longer side is above `longest`, sides rounded to 32."""
    big = F.greatest(w, h)
    r = F.when(big > longest, F.lit(float(longest)) / big).otherwise(F.lit(1.0))
    side = lambda s: F.greatest(F.round(s * r / 32) * 32, F.lit(32.0)).cast("int")
    return F.struct(side(w).alias("w"), side(h).alias("h"), (w / side(w)).alias("scale_x"), (h / side(h)).alias("scale_y"))


def recognition_width(w: Column, h: Column, height: int = 48, most: int = 320) -> Column:
    """Width of a crop at the recogniser's height, from 16 to `most`."""
    return F.greatest(F.least(F.round(F.lit(float(height)) * w / h), F.lit(float(most))), F.lit(16.0)).cast("int")


def sequence_length(target_w: Column, batch_w: Column, steps: Column) -> Column:
    """Recogniser steps that belong to a crop of target_w in a batch padded to batch_w."""
    return F.least(F.ceil(target_w / batch_w * steps) + 2, steps).cast("int")


# Colours of confidence bands.
BANDS = [(0.90, "green", (46, 204, 113)), (0.75, "blue", (52, 152, 219)), (0.50, "amber", (243, 156, 18)), (0.0, "red", (231, 76, 60))]


def confidence_band(conf: Column) -> Column:
    out = F.lit(BANDS[-1][1])
    for least, name, _ in BANDS[-2::-1]:
        out = F.when(conf >= least, name).otherwise(out)
    return out
