"""Event-camera views of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G

ORIGIN = 1704067200000000  # 2024-01-01 in microseconds
DAY = 86_400_000_000
FRAME = 21_600_000_000
BOX_DAYS = 31


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t, x, y, p and value of the events table."""
    on = F.col("event_type").isin("click", "purchase", "signup")
    return table(spark, sf_dir, "events").select(
        F.unix_micros(F.col("ts").cast("timestamp")).alias("t"),
        (F.col("user_id") % 16).cast("int").alias("x"),
        F.expr("cast(user_id div 16 as int)").alias("y"),
        F.when(on, 1).otherwise(0).cast("tinyint").alias("p"),
        "value",
    )


EVENTS_SQL = """e AS (SELECT epoch_us(ts) AS t, (user_id % 16)::INT AS x, (user_id // 16)::INT AS y,
  (CASE WHEN event_type IN ('click', 'purchase', 'signup') THEN 1 ELSE 0 END)::TINYINT AS p, value FROM events)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-frames of six hours: frame_idx, t, x, y, lum (the pixel's largest value)."""
    idx = F.expr(f"cast((t - {ORIGIN}) div {FRAME} as int)")
    rows = events(spark, sf_dir).groupBy(idx.alias("frame_idx"), "x", "y").agg(F.max("value").alias("lum"))
    return rows.select("frame_idx", (F.lit(ORIGIN) + F.col("frame_idx").cast("long") * FRAME).alias("t"), "x", "y", "lum")


PIXELS_SQL = f"""f AS (SELECT frame_idx, {ORIGIN} + frame_idx::BIGINT * {FRAME} AS t, x, y, lum FROM
  (SELECT ((t - {ORIGIN}) // {FRAME})::INT AS frame_idx, x, y, max(value) AS lum FROM e GROUP BY ALL))"""


def flat_boxes(spark: SparkSession) -> DataFrame:
    """One box a day: t, angle, cx, cy and its corners x0..y3, turning 40 degrees a day."""
    d = F.col("id").cast("int")
    angle = (F.pmod(d * 40 + 180, F.lit(360)) - 180).cast("double")
    cx, cy = (8 + d % 3).cast("double"), (5 + d % 2).cast("double")
    rows = spark.range(BOX_DAYS).select((F.lit(ORIGIN) + F.col("id") * DAY).alias("t"), angle.alias("angle"), cx.alias("cx"), cy.alias("cy"))
    center = (F.col("cx"), F.col("cy"))
    corners = [G.rotate((F.col("cx") + dx, F.col("cy") + dy), center, F.col("angle")) for dx, dy in ((-4, 3), (4, 3), (4, -3), (-4, -3))]
    return rows.select("t", "angle", "cx", "cy", *[F.round(corners[i][k], 6).alias(f"{'xy'[k]}{i}") for i in range(4) for k in range(2)])


def boxes(spark: SparkSession) -> DataFrame:
    return _as_boxes(flat_boxes(spark))


def _as_boxes(flat: DataFrame) -> DataFrame:
    polygon = G.as_polygon([(F.col(f"x{i}"), F.col(f"y{i}")) for i in range(4)])
    return flat.select("t", polygon.alias("polygon"), "angle", F.struct(F.col("cx").alias("x"), F.col("cy").alias("y")).alias("center"))


def event_flat_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box for each event: about its pixel, turned by its value; columns as of flat_boxes()."""
    rows = events(spark, sf_dir).select("t", (F.col("value") * 0.7310585 - 180).alias("angle"), (F.col("x") + 8).cast("double").alias("cx"), (F.col("y") + 5).cast("double").alias("cy"))
    corners = [G.rotate((F.col("cx") + dx, F.col("cy") + dy), (F.col("cx"), F.col("cy")), F.col("angle")) for dx, dy in ((-4, 3), (4, 3), (4, -3), (-4, -3))]
    return rows.select("t", "angle", "cx", "cy", *[corners[i][k].alias(f"{'xy'[k]}{i}") for i in range(4) for k in range(2)])


def event_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_boxes(event_flat_boxes(spark, sf_dir))


def _corner_sql(i: int, dx: int, dy: int, digits: int | None = 6) -> str:
    x, y = f"cx + {dx} * cos(radians(angle)) - {dy} * sin(radians(angle))", f"cy + {dx} * sin(radians(angle)) + {dy} * cos(radians(angle))"
    return f"{x} AS x{i}, {y} AS y{i}" if digits is None else f"round({x}, {digits}) AS x{i}, round({y}, {digits}) AS y{i}"


BOXES_SQL = f"""b AS (SELECT t, angle, cx, cy, {', '.join(_corner_sql(i, dx, dy) for i, (dx, dy) in enumerate(((-4, 3), (4, 3), (4, -3), (-4, -3))))} FROM
  (SELECT {ORIGIN} + d * {DAY} AS t, ((d * 40 + 180) % 360 - 180)::DOUBLE AS angle, (8 + d % 3)::DOUBLE AS cx, (5 + d % 2)::DOUBLE AS cy FROM range({BOX_DAYS}) r(d)))"""


_CORNERS_SQL = ", ".join(_corner_sql(i, dx, dy, None) for i, (dx, dy) in enumerate(((-4, 3), (4, 3), (4, -3), (-4, -3))))
EVENT_BOXES_SQL = f"{EVENTS_SQL}, b AS (SELECT t, angle, cx, cy, {_CORNERS_SQL} FROM (SELECT t, value * 0.7310585::DOUBLE - 180 AS angle, (x + 8)::DOUBLE AS cx, (y + 5)::DOUBLE AS cy FROM e))"


LEVELS = 20


def fits(spark: SparkSession) -> DataFrame:
    """Bucket fits of a sensor with k1 = 5, k2 = 20, k4 = 1e-7, k5 = 5e-9 and waves in place of noise: LEVELS luminances times LEVELS changes."""
    p, i, j = F.col("id") % 2, F.floor(F.col("id") / 2) % LEVELS, F.floor(F.col("id") / (2 * LEVELS))
    rows = spark.range(2 * LEVELS * LEVELS).select(p.cast("tinyint").alias("p"), (1 + i * 5.0).alias("l"), (j * 4.0 - 38).alias("d"), (1 + F.sin(7 * i + 13 * j + p) / 50).alias("wave"), (200 + (i * 37 + j * 101) % 1800).cast("long").alias("count"))
    mu = (5.0 * F.col("d") / 16667 / (F.col("l") + 20) + 1e-7 + 5e-9 * F.col("l")) * F.col("wave")
    return rows.select("p", (F.col("l") - 0.5).alias("mean_min"), (F.col("l") + 0.5).alias("mean_max"), (F.col("d") - 0.5).alias("diff_min"), (F.col("d") + 0.5).alias("diff_max"), mu.alias("mu"), "count")


FITS_SQL = f"""fits AS (SELECT p, l - 0.5 AS mean_min, l + 0.5 AS mean_max, d - 0.5 AS diff_min, d + 0.5 AS diff_max, (5.0 * d / 16667 / (l + 20) + 1e-7 + 5e-9 * l) * wave AS mu, count FROM
  (SELECT (id % 2)::TINYINT AS p, 1 + i * 5.0::DOUBLE AS l, j * 4.0::DOUBLE - 38 AS d, 1 + sin(7 * i + 13 * j + id % 2) / 50 AS wave, 200 + (i * 37 + j * 101) % 1800 AS count FROM
  (SELECT id, (id // 2) % {LEVELS} AS i, id // {2 * LEVELS} AS j FROM range({2 * LEVELS * LEVELS}) r(id))))"""


def gappy_boxes(spark: SparkSession) -> DataFrame:
    """boxes with nothing detected on every fifth day and the one before it."""
    day = F.expr(f"(t - {ORIGIN}) div {DAY}") % 5
    seen = day < 3
    return boxes(spark).select("t", *[F.when(seen, F.col(c)).alias(c) for c in ("polygon", "angle", "center")])
