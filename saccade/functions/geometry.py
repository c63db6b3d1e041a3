"""Geometry on Columns: points, quads and circular angles. A quad is four (x, y) pairs of Columns, in order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[Column, Column]
EDGE = 1e-6


def quad(polygon: str) -> list[Point]:
    """The corners of an array-of-structs column."""
    return [(F.get(F.col(polygon), F.lit(i)).x, F.get(F.col(polygon), F.lit(i)).y) for i in range(4)]


def as_polygon(points: list[Point]) -> Column:
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in points])


def blend(a: Column, b: Column, alpha: Column) -> Column:
    return (1 - alpha) * a + alpha * b


def blend_angle(a: Column, b: Column, alpha: Column, half: int = -1) -> Column:
    """Interpolation in degrees along the shorter arc; at exactly half a turn, backwards, or forwards from a to b with half=1."""
    arc = F.pmod(b - a + 180, F.lit(360.0)) - 180
    if half > 0:
        arc = F.when((arc == -180) & (b >= a), 180.0).otherwise(arc)
    return a + alpha * arc


def rotate(point: Point, center: Point, degrees: Column) -> Point:
    dx, dy, angle = point[0] - center[0], point[1] - center[1], F.radians(degrees)
    return center[0] + dx * F.cos(angle) - dy * F.sin(angle), center[1] + dx * F.sin(angle) + dy * F.cos(angle)


def side(points: list[Point], i: int) -> Column:
    (ax, ay), (bx, by) = points[i], points[(i + 1) % 4]
    return F.hypot(bx - ax, by - ay)


def side_lengths(points: list[Point]) -> list[Column]:
    return [side(points, i) for i in range(4)]


def rescale(points: list[Point], center: Point, size: float | None) -> list[Point]:
    """The quad scaled about center so that the longer of its first two sides is size; a quad without extent collapses."""
    if size is None or size <= 0:
        return points
    length = F.greatest(side(points, 0), side(points, 1))
    scale = F.when(length > 0, F.lit(float(size)) / F.nullif(length, F.lit(0.0))).otherwise(0.0)
    return [(center[0] + (x - center[0]) * scale, center[1] + (y - center[1]) * scale) for x, y in points]


def in_quad(point: Point, points: list[Point]) -> Column:
    """Whether a point is in a convex quad of either winding, its edges included."""
    px, py = point
    crosses = []
    for i in range(4):
        (ax, ay), (bx, by) = points[i], points[(i + 1) % 4]
        crosses.append((bx - ax) * (py - ay) - (by - ay) * (px - ax))
    left = reduce(lambda a, b: a & b, [c >= -EDGE for c in crosses])
    right = reduce(lambda a, b: a & b, [c <= EDGE for c in crosses])
    return left | right


def canonical(point: Point, center: Point, angle: Column, size: float) -> Point:
    """Pixel of a point in the upright box of the given size around center."""
    x, y = rotate(point, center, -angle)
    clip = lambda v: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(float(size - 1)), v))).cast("int")
    return clip(x - center[0] + size / 2), clip(y - center[1] + size / 2)


def centroid(points: list[Point]) -> Point:
    return sum((x for x, _ in points[1:]), points[0][0]) / 4, sum((y for _, y in points[1:]), points[0][1]) / 4


def expand(points: list[Point], margin: float) -> list[Point]:
    cx, cy = centroid(points)
    return [(cx + (x - cx) * (1 + margin), cy + (y - cy) * (1 + margin)) for x, y in points]


def extent(points: list[Point]) -> Column:
    xs, ys = [x for x, _ in points], [y for _, y in points]
    return F.greatest(F.greatest(*xs) - F.least(*xs), F.greatest(*ys) - F.least(*ys))


def round_up_to_ten(v: Column) -> Column:
    return (F.ceil(v / 10) * 10).cast("int")


def bottom_angle(left: Point, right: Point) -> Column:
    return F.degrees(F.atan2(right[1] - left[1], right[0] - left[0]))


def crop_bounds(points: list[Point], width: int, height: int) -> tuple[Column, Column, Column, Column]:
    """Integer left, top, right, bottom around a quad, clamped to the image."""
    xs, ys = [x for x, _ in points], [y for _, y in points]
    low = lambda v: F.greatest(F.lit(0), F.floor(F.least(*v)).cast("int"))
    high = lambda v, most: F.least(F.lit(most), F.ceil(F.greatest(*v)).cast("int"))
    return low(xs), low(ys), high(xs, width), high(ys, height)


# fixed values: width of the reference tag, side of the region, gap between them, in the tag's own units
TAG_WIDTH, REGION_SIDE, REGION_GAP = 287.0, 861.0, 82.0


def bottom_corners(corners: list[Point]) -> tuple[Point, Point]:
    """A tag's bottom left corner, of the smallest x - y, and bottom right one, of the largest x + y (first of ties)."""

    def pick(keys: list[Column], best: Column) -> Point:
        xs, ys = F.lit(None).cast("double"), F.lit(None).cast("double")
        for key, (x, y) in reversed(list(zip(keys, corners, strict=True))):
            xs, ys = F.when(key == best, x).otherwise(xs), F.when(key == best, y).otherwise(ys)
        return xs, ys

    minus, plus = [x - y for x, y in corners], [x + y for x, y in corners]
    return pick(minus, F.least(*minus)), pick(plus, F.greatest(*plus))


def region_beside(left: Point, right: Point, tag_width: float = TAG_WIDTH, region: float = REGION_SIDE, gap: float = REGION_GAP) -> list[Point]:
    """The region beside a tag's bottom edge, as bottom left, bottom right, top right, top left; nulls for an edge without length."""
    dx, dy = right[0] - left[0], right[1] - left[1]
    some = F.hypot(dx, dy) > 0
    # the unit vector times the tag's scale is the edge over the tag's width
    ux, uy = F.when(some, dx / tag_width), F.when(some, dy / tag_width)
    near, far = gap, gap + region
    br, bl = (left[0] - near * ux, left[1] - near * uy), (left[0] - far * ux, left[1] - far * uy)
    return [bl, br, (br[0] + region * uy, br[1] - region * ux), (bl[0] + region * uy, bl[1] - region * ux)]


def tag_region(corners: list[Point]) -> list[Point]:
    return region_beside(*bottom_corners(corners))
