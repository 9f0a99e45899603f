"""Column functions on boxes, angles and units; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English Metric Units of a point; pixels of an image without resolution to points.
EMU_PER_PT, PT_PER_PX = 12700, 72 / 96


def corners(box: Column) -> list[Column]:
    """x1, y1, x2, y2 of an array of four numbers, turned the right way round; nulls for any other array."""
    good = F.size(box) == 4
    at = lambda i: F.when(good, F.get(box, F.lit(i)))
    return [F.least(at(0), at(2)), F.least(at(1), at(3)), F.greatest(at(0), at(2)), F.greatest(at(1), at(3))]


def area(p: str = "") -> Column:
    return (F.col(f"{p}x2") - F.col(f"{p}x1")).cast("double") * (F.col(f"{p}y2") - F.col(f"{p}y1"))


def shared(a: str, b: str, axis: str) -> Column:
    """Length that two boxes share on one axis, 0 if none."""
    return F.greatest(F.least(F.col(f"{a}{axis}2"), F.col(f"{b}{axis}2")) - F.greatest(F.col(f"{a}{axis}1"), F.col(f"{b}{axis}1")), F.lit(0))


def intersection_over_union(a: str, b: str) -> Column:
    """Shared area over joint area of two boxes, 0 where both are empty."""
    both = (shared(a, b, "x") * shared(a, b, "y")).cast("double")
    joint = area(a) + area(b) - both
    return F.when(joint > 0, both / joint).otherwise(F.lit(0.0))


def contains(outer: str, inner: str, slack: float = 0) -> Column:
    return (
        (F.col(f"{inner}x1") >= F.col(f"{outer}x1") - slack) & (F.col(f"{inner}y1") >= F.col(f"{outer}y1") - slack)
        & (F.col(f"{inner}x2") <= F.col(f"{outer}x2") + slack) & (F.col(f"{inner}y2") <= F.col(f"{outer}y2") + slack)
    )


def centre_in(outer: str, inner: str) -> Column:
    cx, cy = (F.col(f"{inner}x1") + F.col(f"{inner}x2")) / 2, (F.col(f"{inner}y1") + F.col(f"{inner}y2")) / 2
    return (cx >= F.col(f"{outer}x1")) & (cx <= F.col(f"{outer}x2")) & (cy >= F.col(f"{outer}y1")) & (cy <= F.col(f"{outer}y2"))


def quarter_turn(angle: Column, snap: float = 5.0) -> Column:
    """An angle in 0..359, drawn to a quarter turn within ``snap`` degrees; null, NaN and infinity are 0."""
    a = F.when(angle.isNull() | F.isnan(angle) | (F.abs(angle) == float("inf")), 0.0).otherwise(F.pmod(angle.cast("double"), F.lit(360.0)))
    near = F.pmod(F.bround(a / 90) * 90, F.lit(360.0))
    off = F.least(F.abs(a - near), 360 - F.abs(a - near))
    return F.when(off <= snap, near).otherwise(a)


def line_rotation(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, length: Column) -> Column:
    """Rotation of a text line by its baseline: a skew from 5 to 60 degrees as it is, 90 for a tall box of two characters or more, else 0."""
    skew = F.degrees(F.atan2((y1 - y0).cast("double"), (x1 - x0).cast("double")))
    tall = (height >= 2 * width) & (length >= 2)
    return F.when(F.abs(skew).between(5, 60), F.pmod(skew, F.lit(360.0))).when(tall, 90.0).otherwise(0.0)


def rescaled(value: Column, size: Column, grid: int = 1000) -> Column:
    """A coordinate of a 0..grid square in pixels of a side, rounded half to even and kept within it."""
    return F.greatest(F.lit(0), F.least(size, F.bround(value.cast("double") * size / grid))).cast("int")


def to_emu(px: Column, zoom: Column) -> Column:
    """Pixels at a zoom (pixels a point) in EMU; a zoom of null or 0 is 1."""
    return F.bround(px.cast("double") / F.coalesce(F.nullif(zoom, F.lit(0.0)), F.lit(1.0)) * EMU_PER_PT).cast("long")


def third(x1: Column, x2: Column, width: Column) -> Column:
    """left, center or right by the third of the page that a box's centre lies in; left for a page without width."""
    share = F.try_divide((x1 + x2) / 2, F.nullif(width, F.lit(0.0)))
    return F.when(share > 2 / 3, "right").when(share >= 1 / 3, "center").otherwise("left")


def estimated_lines(text: Column, width: Column, zoom: Column, wide: Column) -> Column:
    """Lines that a text takes in a box: by its newlines, or by seven pixels a character and zoom, twice that for the ``wide`` ones; 50 at most, 1 for no text."""
    z = F.greatest(zoom, F.lit(1.0))
    ratio = (F.length(text) + wide) * 7.0 * z / F.greatest(width.cast("double"), F.lit(1.0))
    by_width = F.least(F.greatest(F.ceil(ratio - 0.25), F.lit(1)), F.lit(50))
    return F.when(F.coalesce(text, F.lit("")) == "", 1).otherwise(F.greatest(F.regexp_count(text, F.lit("\n")) + 1, by_width)).cast("int")


def estimated_size(height: Column, lines: Column, zoom: Column, default: float = 11.0) -> Column:
    """Font size in points by the height of a line; the default where that lies outside 6 to 96."""
    size = F.greatest(height, F.lit(0)) / F.greatest(lines, F.lit(1)) / F.greatest(zoom, F.lit(1e-6)) * 0.7
    return F.when(size.between(6.0, 96.0), F.bround(size, 1)).otherwise(default)


def is_container(height_pt: Column, lines: Column, line_pt: Column, ratio: float = 7.0) -> Column:
    """True for a box far higher than its lines need: it belongs to something around the table."""
    return (height_pt > 0) & (lines > 0) & (line_pt > 0) & (height_pt > lines * line_pt * ratio)


def recentred(x: Column, width: Column, natural: Column) -> list[Column]:
    """x and width of a box narrowed to its natural width about its centre; unchanged if it isn't wider."""
    narrower = (width > 0) & (natural > 0) & (natural < width)
    return [F.when(narrower, x + F.floor((width - natural) / 2)).otherwise(x), F.when(narrower, natural).otherwise(width)]
