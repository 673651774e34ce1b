"""Box geometry as column expressions: whole-stage codegen, no UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PANORAMA, TILE, OVERLAP = 2048, 640, 128
KEEP_VISIBLE, DROP_VISIBLE = 0.6, 0.2
SMALL, LARGE = 1024, 9216  # square pixels
BANDS = (16, 24, 32, 48, 96)  # pixels


def _c(x: Column | str | float) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def parse_bbox(box: Column) -> Column:
    """x1, y1, x2, y2 of a struct with xmin..ymax or x, y, w, h; raises on neither."""
    corners = F.struct(box["xmin"].alias("x1"), box["ymin"].alias("y1"), box["xmax"].alias("x2"), box["ymax"].alias("y2"))
    extent = F.struct(box["x"].alias("x1"), box["y"].alias("y1"), (box["x"] + box["w"]).alias("x2"), (box["y"] + box["h"]).alias("y2"))
    return F.when(box["xmin"].isNotNull(), corners).when(box["x"].isNotNull() & box["w"].isNotNull(), extent).otherwise(F.raise_error(F.lit("unknown box form")).cast("struct<x1:double,y1:double,x2:double,y2:double>"))


def xyxy_to_yolo(x1, y1, x2, y2, width, height) -> Column:
    """cx, cy, w, h normalised to the image; raises on an empty image."""
    x1, y1, x2, y2, width, height = map(_c, (x1, y1, x2, y2, width, height))
    box = F.struct(((x1 + x2) / 2 / width).alias("cx"), ((y1 + y2) / 2 / height).alias("cy"), ((x2 - x1) / width).alias("w"), ((y2 - y1) / height).alias("h"))
    return F.when((width > 0) & (height > 0), box).otherwise(F.raise_error(F.lit("image without extent")).cast("struct<cx:double,cy:double,w:double,h:double>"))


def bbox_wh(box: Column) -> Column:
    return F.struct(F.coalesce(box["xmax"] - box["xmin"], box["w"], F.lit(0.0)).alias("w"), F.coalesce(box["ymax"] - box["ymin"], box["h"], F.lit(0.0)).alias("h"))


def px_area(w, h, size: int = PANORAMA) -> Column:
    return _c(w) * _c(h) * F.lit(float(size * size))


def size_bucket(area) -> Column:
    """Buckets of the evaluation: 9216 square pixels is large."""
    return F.when(_c(area) < SMALL, "small").when(_c(area) < LARGE, "medium").otherwise("large")


def size_bin(area) -> Column:
    """Bins of the data report: 9216 square pixels is medium."""
    return F.when(_c(area) < SMALL, "small").when(_c(area) > LARGE, "large").otherwise("medium")


def size_band(w, h, size: int = PANORAMA) -> Column:
    """Longer side in pixels, in half-open bands."""
    side = F.greatest(_c(w), _c(h)) * size
    out, low = F.when(side < BANDS[0], f"<{BANDS[0]}"), BANDS[0]
    for high in BANDS[1:]:
        out, low = out.when(side < high, f"{low}-{high}"), high
    return out.otherwise(f">={BANDS[-1]}")


def _overlap(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a2, b2) - F.greatest(a1, b1))


def iou(a: Column, b: Column) -> Column:
    """IoU of two structs cx, cy, w, h; the union from widths and heights; 0 for an empty union."""
    inter = _overlap(a["cx"] - a["w"] / 2, a["cx"] + a["w"] / 2, b["cx"] - b["w"] / 2, b["cx"] + b["w"] / 2) * _overlap(a["cy"] - a["h"] / 2, a["cy"] + a["h"] / 2, b["cy"] - b["h"] / 2, b["cy"] + b["h"] / 2)
    union = a["w"] * a["h"] + b["w"] * b["h"] - inter
    return F.when(union <= 0, 0.0).otherwise(inter / union)


def to_xyxy(b: Column) -> Column:
    return F.struct((b["cx"] - b["w"] / 2).alias("x1"), (b["cy"] - b["h"] / 2).alias("y1"), (b["cx"] + b["w"] / 2).alias("x2"), (b["cy"] + b["h"] / 2).alias("y2"))


def iou_xyxy(a: Column, b: Column) -> Column:
    """IoU of two structs x1, y1, x2, y2; the union from corners; 0 without overlap."""
    inter = _overlap(a["x1"], a["x2"], b["x1"], b["x2"]) * _overlap(a["y1"], a["y2"], b["y1"], b["y2"])
    union = (a["x2"] - a["x1"]) * (a["y2"] - a["y1"]) + (b["x2"] - b["x1"]) * (b["y2"] - b["y1"]) - inter
    return F.when((inter <= 0) | (union <= 0), 0.0).otherwise(inter / union)


def clip(box: Column, tile: Column) -> Column:
    """The part of a box inside a tile (null if none) and the visible share vf of its area."""
    x1, y1 = F.greatest(box["x1"], tile["x1"]), F.greatest(box["y1"], tile["y1"])
    x2, y2 = F.least(box["x2"], tile["x2"]), F.least(box["y2"], tile["y2"])
    area = (box["x2"] - box["x1"]) * (box["y2"] - box["y1"])
    seen = (x2 > x1) & (y2 > y1) & (area > 0)
    inside = F.when(seen, F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")))
    return F.struct(inside.alias("box"), F.when(seen, (x2 - x1) * (y2 - y1) / area).otherwise(0.0).alias("vf"))


def visibility_class(vf: Column, in_subset: Column, keep: float = KEEP_VISIBLE, drop: float = DROP_VISIBLE, other: bool = False) -> Column:
    """drop, label, other or ignore."""
    out = F.when(vf <= drop, "drop").when(in_subset & (vf >= keep), "label")
    if other:
        out = out.when(~in_subset & (vf >= keep), "other")
    return out.otherwise("ignore")


def offsets(length: int, size: int = TILE, overlap: int = OVERLAP) -> list[int]:
    """Tile origins along one side; the last one is moved back to the border."""
    if overlap >= size:
        raise ValueError("overlap must be less than the tile size")
    if length <= size:
        return [0]
    found = list(range(0, length - size, size - overlap))
    return [*found, length - size]


def tile_grid(width: int = PANORAMA, height: int = PANORAMA, size: int = TILE, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    return [(x, y) for y in offsets(height, size, overlap) for x in offsets(width, size, overlap)]


def offset_array(length: Column, size: int = TILE, overlap: int = OVERLAP) -> Column:
    """:func:`offsets` for a column of side lengths."""
    if overlap >= size:
        raise ValueError("overlap must be less than the tile size")
    last = length - size
    return F.when(length <= size, F.array(F.lit(0).cast("long"))).otherwise(F.array_distinct(F.concat(F.sequence(F.lit(0).cast("long"), last.cast("long"), F.lit(size - overlap).cast("long")), F.array(last.cast("long")))))


def det_to_panorama(box: Column, x_off: Column, y_off: Column, tile: Column | int = TILE, size: int = PANORAMA) -> Column:
    """A tile-normalised box cx, cy, w, h in panorama-normalised coordinates."""
    t = _c(tile)
    return F.struct(((x_off + box["cx"] * t) / size).alias("cx"), ((y_off + box["cy"] * t) / size).alias("cy"), (box["w"] * t / size).alias("w"), (box["h"] * t / size).alias("h"))


def ignore_to_panorama(box: Column, x_off: Column, y_off: Column, size: int = PANORAMA) -> Column:
    """A tile-pixel box x1..y2 in panorama-normalised corners."""
    return F.struct(((x_off + box["x1"]) / size).alias("x1"), ((y_off + box["y1"]) / size).alias("y1"), ((x_off + box["x2"]) / size).alias("x2"), ((y_off + box["y2"]) / size).alias("y2"))


def yolo_to_px(box: Column, width: int, height: int) -> Column:
    """Clamped integer corners, rounded half to even."""
    def at(v: Column, most: int) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(most), F.bround(v * most, 0).cast("int")))

    return F.struct(at(box["cx"] - box["w"] / 2, width).alias("x1"), at(box["cy"] - box["h"] / 2, height).alias("y1"), at(box["cx"] + box["w"] / 2, width).alias("x2"), at(box["cy"] + box["h"] / 2, height).alias("y2"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
