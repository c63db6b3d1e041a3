"""Events in moving regions of interest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import asof


def valid_boxes(boxes: DataFrame) -> DataFrame:
    """boxes (t, polygon, angle, center) with complete geometry."""
    return boxes.where("t is not null and polygon is not null and angle is not null and center is not null and size(polygon) = 4")


def boxes_from_tags(tags: DataFrame, margin: float = 0.03) -> DataFrame:
    """t, polygon, angle, center of the region beside tag 0; undetected or degenerate tags keep t with null geometry."""
    left, right = G.bottom_corners(G.quad("corners"))
    edges = _row(tags, ["t", "tag_id", "corners"], {"lx": left[0], "ly": left[1], "rx": right[0], "ry": right[1]})
    region = G.region_beside((F.col("lx"), F.col("ly")), (F.col("rx"), F.col("ry")))
    found = (F.col("tag_id") == 0) & (F.size("corners") == 4)
    rows = _row(edges, ["t"], {"found": F.coalesce(found, F.lit(False)), **{f"{'xy'[k]}{i}": region[i][k] for i in range(4) for k in range(2)}})
    points = [(F.col(f"x{i}"), F.col(f"y{i}")) for i in range(4)]
    center = G.centroid(points)
    # the centroid and the angle of the bottom edge stay as they are when the region grows about its centroid
    wide = G.expand(points, margin) if margin > 0 else points
    found = F.col("found") & F.col("x0").isNotNull()
    return rows.select(
        "t",
        F.when(found, G.as_polygon(wide)).alias("polygon"),
        F.when(found, G.bottom_angle(points[0], points[1])).alias("angle"),
        F.when(found, F.struct(center[0].alias("x"), center[1].alias("y"))).alias("center"),
    )


def trajectory(boxes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return valid_boxes(boxes).select(*(keys or []), "t", F.col("center.x").alias("center_x"), F.col("center.y").alias("center_y"), "angle")


def target_size(boxes: DataFrame) -> DataFrame:
    """size: extent of the first box, rounded up to ten."""
    rows = valid_boxes(boxes).withColumn("_e", G.extent(G.quad("polygon")))
    return rows.agg(G.round_up_to_ten(F.min_by("_e", "t")).alias("size"))


def with_box(events: DataFrame, boxes: DataFrame, keys: list[str] | None = None, size: float | None = None) -> DataFrame:
    """events with the interpolated box at their time: corner columns x0..y3, angle, cx, cy; scaled to size if given."""
    keys = keys or []
    flat = valid_boxes(boxes)
    flat = flat.select(*keys, "t", "angle", F.col("center.x").alias("cx"), F.col("center.y").alias("cy"), *[G.quad("polygon")[i][k].alias(f"{'xy'[k]}{i}") for i in range(4) for k in range(2)])
    joined = asof.asof_interpolated(events, flat, keys)
    mix = lambda c: G.blend(F.col(f"prev.{c}"), F.col(f"next.{c}"), F.col("alpha"))
    names = ["cx", "cy", *[f"{c}{i}" for i in range(4) for c in "xy"]]
    angle = G.blend_angle(F.col("prev.angle"), F.col("next.angle"), F.col("alpha"))
    out = _row(joined, events.columns, {"angle": angle, **{c: mix(c) for c in names}})
    if size:
        points = G.rescale([(F.col(f"x{i}"), F.col(f"y{i}")) for i in range(4)], (F.col("cx"), F.col("cy")), size)
        corners = {f"{'xy'[k]}{i}": points[i][k] for i in range(4) for k in range(2)}
        out = _row(out, events.columns, {"angle": F.col("angle"), "cx": F.col("cx"), "cy": F.col("cy"), **corners})
    return out


def with_either_box(events: DataFrame, boxes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """events with the left-sided interpolated box of all frames (polygon x0..y3, angle, cx, cy); where one side has no box, the other's.

    boxes may have null geometry (not detected); such rows still count as frames. Neither side has one: nulls.
    """
    keys = keys or []
    names = ["cx", "cy", *[f"{c}{i}" for i in range(4) for c in "xy"]]
    whole = F.col("polygon").isNotNull() & F.col("angle").isNotNull() & F.col("center").isNotNull()
    corners = [G.quad("polygon")[i][k].alias(f"{'xy'[k]}{i}") for i in range(4) for k in range(2)]
    flat = boxes.select(*keys, "t", whole.alias("found"), "angle", F.col("center.x").alias("cx"), F.col("center.y").alias("cy"), *corners)
    joined = asof.asof_left(events, flat, keys)
    one, two = F.col("prev.found"), F.col("next.found")

    def either(c: str, blended: Column) -> Column:
        return F.when(one & two, blended).when(one, F.col(f"prev.{c}")).when(two, F.col(f"next.{c}"))

    angle = either("angle", G.blend_angle(F.col("prev.angle"), F.col("next.angle"), F.col("alpha"), half=1))
    return _row(joined, events.columns, {"angle": angle, **{c: either(c, G.blend(F.col(f"prev.{c}"), F.col(f"next.{c}"), F.col("alpha"))) for c in names}})


def _row(df: DataFrame, keep: list[str], columns: dict) -> DataFrame:
    """keep and computed columns; these are values of a one-row generator, so the optimizer does not copy them into every later use."""
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def filter_events(events: DataFrame, boxes: DataFrame, keys: list[str] | None = None, size: float | None = None, double_rotation: bool = False) -> DataFrame:
    """Events inside the box at their time, moved into the upright box of size (default: the largest box).

    double_rotation rotates the event against the box before the containment test, which is only right for upright boxes.
    """
    if not size:
        size = valid_boxes(boxes).agg(F.max(F.greatest(G.side(G.quad("polygon"), 0), G.side(G.quad("polygon"), 1)))).first()[0]
        if size is None:
            return events.limit(0)
        placed = with_box(events, boxes, keys)
    else:
        placed = with_box(events, boxes, keys, size)
    points = [(F.col(f"x{i}"), F.col(f"y{i}")) for i in range(4)]
    point, center = (F.col("x").cast("double"), F.col("y").cast("double")), (F.col("cx"), F.col("cy"))
    tested = G.rotate(point, center, -F.col("angle")) if double_rotation else point
    inside = placed.where(G.in_quad(tested, points))
    x, y = G.canonical(point, center, F.col("angle"), size)
    return inside.select(*[x.alias(c) if c == "x" else y.alias(c) if c == "y" else F.col(c) for c in events.columns])
