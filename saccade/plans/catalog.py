"""All queries of the event engine with the SQL that must give the same rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import pixels as P
from ..operators import accumulator, asof, calibration, cloud, frames, histogram, intervals, ordered, regression, roi, simulate, spectrum, voxel
from ..params import PRESETS, preset
from ..params import preset_table as presets
from ..sources import frames as sources
from ..sources import sinks
from ..storage import scratch
from ..streaming import events as streams
from ..streaming import live
from . import lens

QUERIES: dict = {}
SQL: dict = {}
MINUTE = 60_000_000
LONGEST = 400_000 * 1_000_000


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


E = f"WITH {lens.EVENTS_SQL}"
EF = f"{E}, {lens.PIXELS_SQL}"
#: Intervals of a pixel's events, in seconds.
TAU = f"{E}, i AS (SELECT * FROM (SELECT x, y, p, t, t - lag(t) OVER (PARTITION BY x, y ORDER BY t) AS tau, count(*) OVER (PARTITION BY x, y) AS n FROM e) WHERE tau > 0 AND n >= 10)"


def _taus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.intervals(lens.events(spark, sf_dir).select("t", "x", "y", "p"), least=10)


@_query("event_intervals", f"{TAU} SELECT x, y, t, tau FROM i")
def event_intervals(spark, sf_dir):
    return _taus(spark, sf_dir).select("x", "y", "t", "tau")


_IG = "1 / (avg(1 / s) - 1 / avg(s))"


@_query(
    "interval_ig_fit",
    f"{TAU}, s AS (SELECT p, tau / 1e6 AS s FROM i) SELECT p, count(*) AS n, round(avg(s), 3) AS mean, round({_IG}, 3) AS shape, round(1 / avg(s), 9) AS mu, round(1 / sqrt({_IG}), 6) AS sigma FROM s GROUP BY p",
)
def interval_ig_fit(spark, sf_dir):
    fitted = intervals.fit(_taus(spark, sf_dir).withColumn("s", F.col("tau") / 1e6), "s", ("p",))
    return rounded(fitted.select("p", "n", "mean", "shape", "mu", "sigma"), mean=3, shape=3, mu=9, sigma=6)


@_query("interval_levy_fit", f"{TAU} SELECT p, count(*) AS n, round(count(*) / sum(1e6 / tau), 3) AS levy_scale FROM i GROUP BY p")
def interval_levy_fit(spark, sf_dir):
    fitted = intervals.fit(_taus(spark, sf_dir).withColumn("s", F.col("tau") / 1e6), "s", ("p",))
    return rounded(fitted.select("p", "n", "levy_scale"), levy_scale=3)


@_query(
    "interval_pool_stats",
    f"""{TAU}, s AS (SELECT x, y, tau / 1e6 AS s FROM i) SELECT count(*) AS n, count(DISTINCT (x, y)) AS pixels, round(avg(s), 3) AS mean, round(quantile_cont(s, 0.5), 3) AS median,
  round(stddev_pop(s), 3) AS std, round(min(s), 6) AS min, round(max(s), 6) AS max FROM s""",
)
def interval_pool_stats(spark, sf_dir):
    stats = intervals.pool_statistics(_taus(spark, sf_dir).withColumn("s", F.col("tau") / 1e6), "s")
    return rounded(stats, mean=3, median=3, std=3, min=6, max=6)


_HZ = 0.01  # events here are hours apart: at most one in 100 s


@_query(
    "event_freq_stats",
    f"""{TAU}, h AS (SELECT x, y, 1e6 / tau AS hz FROM i WHERE 1e6 / tau <= {_HZ}) SELECT count(*) AS n, count(DISTINCT (x, y)) AS pixels, round(avg(hz), 9) AS mean,
  round(quantile_cont(hz, 0.5), 9) AS median, round(stddev_pop(hz), 9) AS std, round(min(hz), 9) AS min, round(max(hz), 9) AS max FROM h""",
)
def event_freq_stats(spark, sf_dir):
    stats, _ = intervals.frequency_spectrum(lens.events(spark, sf_dir), 10, _HZ)
    return rounded(stats, mean=9, median=9, std=9, min=9, max=9)


def _hist_sql(source: str, value: str, lo: str, hi: str, bins: int, extra: str = "") -> str:
    """Dense histogram of source.value over [lo, hi], last bin closed."""
    return f"""v AS (SELECT {value} AS v, {lo} AS lo, {hi} AS hi FROM {source}),
g AS (SELECT v, lo, hi, least(floor((v - lo) * {bins} / (hi - lo)), {bins - 1})::BIGINT AS b FROM v WHERE v >= lo AND v <= hi),
k AS (SELECT CASE WHEN v < lo + b * (hi - lo) / {bins} THEN b - 1 WHEN b < {bins - 1} AND v >= lo + (b + 1) * (hi - lo) / {bins} THEN b + 1 ELSE b END AS bin, count(*) AS n FROM g GROUP BY 1),
r AS (SELECT any_value(lo) AS lo, any_value(hi) AS hi FROM v)
SELECT q.bin, round(lo + q.bin * (hi - lo) / {bins}, 6) AS "left", round(lo + (q.bin + 1) * (hi - lo) / {bins}, 6) AS "right", coalesce(n, 0)::BIGINT AS count{extra}
FROM range({bins}) q(bin) CROSS JOIN r LEFT JOIN k ON k.bin = q.bin"""


@_query("event_freq_hist", f"{TAU}, h AS (SELECT 1e6 / tau AS hz FROM i WHERE 1e6 / tau <= {_HZ}), " + _hist_sql("h", "hz", "0.0::DOUBLE", f"{_HZ}::DOUBLE", 50))
def event_freq_hist(spark, sf_dir):
    _, bins = intervals.frequency_spectrum(lens.events(spark, sf_dir), 10, _HZ)
    return rounded(bins, left=6, right=6)


@_query(
    "interval_density_hist",
    f"{TAU}, h AS (SELECT tau / 1e6 AS s FROM i WHERE tau <= {LONGEST}), " + _hist_sql("h", "s", "0.0::DOUBLE", "400000.0::DOUBLE", 40, f", round(coalesce(n, 0) / (sum(coalesce(n, 0)) OVER () * (hi - lo) / 40), 9) AS density"),
)
def interval_density_hist(spark, sf_dir):
    taus = _taus(spark, sf_dir).where(F.col("tau") <= LONGEST).withColumn("s", F.col("tau") / 1e6)
    return rounded(histogram.density(taus, "s", 40, 0.0, 400_000.0), left=6, right=6, density=9)


@_query("busy_pixels", f"{E} SELECT x, y, count(*) AS n FROM e GROUP BY x, y HAVING count(*) >= 50")
def busy_pixels(spark, sf_dir):
    return intervals.busy_pixels(lens.events(spark, sf_dir), 50).groupBy("x", "y").agg(F.count("*").alias("n"))


_STEP = "d AS (SELECT *, lag(lum) OVER w AS a, lag(frame_idx) OVER w AS j FROM f WINDOW w AS (PARTITION BY x, y ORDER BY frame_idx))"
_NAIVE = f"{EF}, {_STEP}, n AS (SELECT t, x, y, (CASE WHEN lum > a THEN 1 ELSE 0 END)::TINYINT AS p FROM d WHERE j = frame_idx - 1 AND abs(lum - a) > 20)"


@_query("naive_events", f"{_NAIVE} SELECT * FROM n")
def naive_events(spark, sf_dir):
    return frames.naive_events(lens.pixels(spark, sf_dir))


@_query("event_map", f"{_NAIVE} SELECT x, y, CASE WHEN arg_max(p, t * 2 + 1 - p) > 0 THEN 1 ELSE -1 END AS value FROM n GROUP BY x, y")
def event_map(spark, sf_dir):
    return frames.event_map(frames.naive_events(lens.pixels(spark, sf_dir)))


@_query("frame_stats", f"{EF} SELECT frame_idx, round(avg(lum) / 1023, 6) AS mean, round(var_pop(lum) / (1023 * 1023), 6) AS variance, round((max(lum) - min(lum)) / 1023, 6) AS range FROM f GROUP BY frame_idx")
def frame_stats(spark, sf_dir):
    return rounded(frames.frame_statistics(lens.pixels(spark, sf_dir), 1023.0), mean=6, variance=6, range=6)


@_query("resolution", f"{E} SELECT max(x) + 1 AS width, max(y) + 1 AS height FROM e")
def resolution(spark, sf_dir):
    return frames.resolution(lens.events(spark, sf_dir))


@_query("aedat_prepare", f"{E} SELECT t, x, y, p > 0 AS p FROM e WHERE t >= 0")
def aedat_prepare(spark, sf_dir):
    return frames.prepared_events(lens.events(spark, sf_dir))


@_query("validity_report", f"{E} SELECT count(*) AS events, count_if(t IS NULL OR t < 0)::BIGINT AS bad_time, count_if(x NOT BETWEEN 0 AND 15 OR y NOT BETWEEN 0 AND 4)::BIGINT AS out_of_frame, count_if(p NOT IN (0, 1))::BIGINT AS bad_polarity FROM e")
def validity_report(spark, sf_dir):
    return frames.validity_report(lens.events(spark, sf_dir), 16, 5)


@_query("event_cap", f"{E} SELECT count(*) AS n FROM (SELECT * FROM e LIMIT 500)")
def event_cap(spark, sf_dir):
    return lens.events(spark, sf_dir).limit(500).agg(F.count("*").alias("n"))


@_query(
    "clock_offset",
    f"""WITH o AS (SELECT t, row_number() OVER (ORDER BY t) AS idx FROM (SELECT DISTINCT epoch_us(date_trunc('day', ts)) AS t FROM events)),
a AS (SELECT idx, t AS a, lead(t) OVER (ORDER BY idx) - t AS da, t + 5000000 + (idx % 7) * 1000000 AS b FROM o),
r AS (SELECT *, lead(b) OVER (ORDER BY idx) - b AS db FROM a)
SELECT idx::INT AS idx, round(db / da, 9) AS ratio, b - a AS "offset" FROM r WHERE da > 0 AND db IS NOT NULL ORDER BY abs(db / da - 1), idx LIMIT 1""",
)
def clock_offset(spark, sf_dir):
    days = lens.events(spark, sf_dir).select(F.expr(f"(t div {lens.DAY}) * {lens.DAY}").alias("t")).distinct()
    other = days.select((F.col("t") + 5_000_000 + (F.row_number().over(Window.orderBy("t")) % 7) * 1_000_000).alias("t"))
    return rounded(asof.clock_offset(days, other), ratio=9)


_BOXED = f"{E}, {lens.BOXES_SQL}, n AS (SELECT *, lead(t) OVER (ORDER BY t) AS hi, row_number() OVER (ORDER BY t) AS k FROM b)"


def _mix_sql(c: str) -> str:
    return f"((1 - alpha) * a.{c} + alpha * z.{c})"


_ASOF = f"""{_BOXED}, m AS (SELECT e.*, n.k, CASE WHEN e.t < n.t OR n.hi IS NULL THEN 0.0 ELSE (e.t - n.t) / (n.hi - n.t) END AS alpha, CASE WHEN e.t < n.t OR n.hi IS NULL THEN n.k ELSE n.k + 1 END AS k2
  FROM e JOIN n ON (e.t >= n.t OR n.k = 1) AND (e.t < n.hi OR n.hi IS NULL)),
q AS (SELECT m.t, m.x, m.y, m.p, m.alpha, a.t AS prev_t, z.t AS next_t, a.angle + alpha * (((z.angle - a.angle + 180) % 360 + 360) % 360 - 180) AS angle,
  {', '.join(f'{_mix_sql(c)} AS {c}' for c in ('cx', 'cy'))}, {', '.join(f'{_mix_sql(f"{c}{i}")} AS {c}{i}' for i in range(4) for c in 'xy')}
  FROM m JOIN n a ON a.k = m.k JOIN n z ON z.k = m.k2)"""


@_query("asof_interp", f"{_ASOF} SELECT t, x, y, prev_t, next_t, round(alpha, 9) AS alpha, round(cx, 6) AS cx, round(cy, 6) AS cy FROM q")
def asof_interp(spark, sf_dir):
    out = asof.asof_interpolated(lens.events(spark, sf_dir), lens.flat_boxes(spark))
    mix = lambda c: G.blend(F.col(f"prev.{c}"), F.col(f"next.{c}"), F.col("alpha"))
    return rounded(out.select("t", "x", "y", F.col("prev.t").alias("prev_t"), F.col("next.t").alias("next_t"), "alpha", mix("cx").alias("cx"), mix("cy").alias("cy")), alpha=9, cx=6, cy=6)


@_query("angle_interp", f"{_ASOF} SELECT t, x, y, round(angle, 6) AS angle FROM q")
def angle_interp(spark, sf_dir):
    return rounded(roi.with_box(lens.events(spark, sf_dir).select("t", "x", "y"), lens.boxes(spark)).select("t", "x", "y", "angle"), angle=6)


def _cross_sql(i: int) -> str:
    j = (i + 1) % 4
    return f"(x{j} - x{i}) * (y - y{i}) - (y{j} - y{i}) * (x - x{i})"


_INSIDE = " OR ".join("(" + " AND ".join(f"{_cross_sql(i)} {op}" for i in range(4)) + ")" for op in (">= -1e-6", "<= 1e-6"))
_ROI = f"{_ASOF}, w AS (SELECT * FROM q WHERE {_INSIDE})"
_SIZE = 100


@_query("roi_filter", f"{_ROI} SELECT p, count(*) AS n, min(t) AS first_t, max(t) AS last_t FROM w GROUP BY p")
def roi_filter(spark, sf_dir):
    out = roi.filter_events(lens.events(spark, sf_dir).select("t", "x", "y", "p"), lens.boxes(spark), size=None)
    return out.groupBy("p").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@_query(
    "roi_transform",
    f"""{_ASOF}, s AS (SELECT *, CASE WHEN g > 0 THEN {_SIZE} / g ELSE 0 END AS k FROM (SELECT *, greatest(sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2), sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2)) AS g FROM q)),
z AS (SELECT t, x, y, p, angle, cx, cy, {', '.join(f'c{c} + ({c}{i} - c{c}) * k AS {c}{i}' for i in range(4) for c in 'xy')} FROM s)
SELECT t, p, greatest(0, least({_SIZE - 1}, floor(cx + (x - cx) * cos(radians(-angle)) - (y - cy) * sin(radians(-angle)) - cx + {_SIZE} / 2)))::INT AS x,
  greatest(0, least({_SIZE - 1}, floor(cy + (x - cx) * sin(radians(-angle)) + (y - cy) * cos(radians(-angle)) - cy + {_SIZE} / 2)))::INT AS y FROM z WHERE {_INSIDE}""",
)
def roi_transform(spark, sf_dir):
    return roi.filter_events(lens.events(spark, sf_dir).select("t", "x", "y", "p"), lens.boxes(spark), size=_SIZE).select("t", "p", "x", "y")


@_query(
    "tag_region",
    f"""WITH {lens.EVENT_BOXES_SQL}, c AS (SELECT t, least(x0 - y0, x1 - y1, x2 - y2, x3 - y3) AS lo, greatest(x0 + y0, x1 + y1, x2 + y2, x3 + y3) AS hi, * EXCLUDE (t) FROM b),
k AS (SELECT t, {', '.join(f'CASE {" ".join(f"WHEN x{i} {op} y{i} = {best} THEN {c}{i}" for i in range(4))} END AS {name}{c}' for name, op, best in (('l', '-', 'lo'), ('r', '+', 'hi')) for c in 'xy')} FROM c),
u AS (SELECT *, (rx - lx) / n AS ux, (ry - ly) / n AS uy, n / 287 AS s FROM (SELECT *, sqrt((rx - lx) ** 2 + (ry - ly) ** 2) AS n FROM k)),
r AS (SELECT *, lx - 82 * s * ux AS ax, ly - 82 * s * uy AS ay FROM u)
SELECT t, round(degrees(atan2(uy, ux)), 4) AS angle, round(ax, 4) AS right_x, round(ay, 4) AS right_y, round(ax - 861 * s * ux, 4) AS left_x, round(ay - 861 * s * uy, 4) AS left_y FROM r""",
)
def tag_region(spark, sf_dir):
    tags = lens.event_boxes(spark, sf_dir).select("t", F.lit(0).alias("tag_id"), F.col("polygon").alias("corners"))
    out = roi.boxes_from_tags(tags, 0.0)
    corner = lambda i: F.get("polygon", F.lit(i))
    rows = out.select("t", "angle", corner(1).x.alias("right_x"), corner(1).y.alias("right_y"), corner(0).x.alias("left_x"), corner(0).y.alias("left_y"))
    return rounded(rows, angle=4, right_x=4, right_y=4, left_x=4, left_y=4)


@_query("trajectory", f"WITH {lens.EVENT_BOXES_SQL} SELECT t, cx AS center_x, cy AS center_y, angle FROM b")
def trajectory(spark, sf_dir):
    return roi.trajectory(lens.event_boxes(spark, sf_dir))


@_query(
    "asof_prev_next",
    f"""{EF}, g AS (SELECT DISTINCT frame_idx, t FROM f), h AS (SELECT frame_idx AS a, t AS lo, lead(frame_idx) OVER (ORDER BY t) AS b, lead(t) OVER (ORDER BY t) AS hi FROM g),
i AS (SELECT *, row_number() OVER (ORDER BY lo) AS k, count(*) OVER () AS n FROM h WHERE b IS NOT NULL)
SELECT e.t, x, y, a AS prev_frame, b AS next_frame, hi - lo AS frame_dt FROM e JOIN i ON (e.t > lo OR k = 1) AND (e.t <= hi OR k = n)""",
)
def asof_prev_next(spark, sf_dir):
    grid = lens.pixels(spark, sf_dir).select("frame_idx", "t").distinct()
    out = asof.asof_bracket(lens.events(spark, sf_dir), grid)
    return out.select("t", "x", "y", F.col("prev.frame_idx").alias("prev_frame"), F.col("next.frame_idx").alias("next_frame"), (F.col("next.t") - F.col("prev.t")).alias("frame_dt"))


_LUM = f"""{EF}, g AS (SELECT DISTINCT frame_idx, t FROM f), h AS (SELECT frame_idx AS a, t AS lo, lead(frame_idx) OVER (ORDER BY t) AS b, lead(t) OVER (ORDER BY t) AS hi FROM g),
i AS (SELECT *, row_number() OVER (ORDER BY lo) AS k, count(*) OVER () AS n FROM h WHERE b IS NOT NULL),
j AS (SELECT e.t, x, y, p, a, b, hi - lo AS frame_dt FROM e JOIN i ON (e.t > lo OR k = 1) AND (e.t <= hi OR k = n)),
l AS (SELECT j.t, j.x, j.y, j.p, u.lum AS prev_lum, v.lum AS next_lum, frame_dt FROM j JOIN f u ON u.frame_idx = a AND u.x = j.x AND u.y = j.y JOIN f v ON v.frame_idx = b AND v.x = j.x AND v.y = j.y)"""


def _attached(spark, sf_dir):
    return calibration.attach_luminance(lens.events(spark, sf_dir).select("t", "x", "y", "p"), lens.pixels(spark, sf_dir))


@_query("lum_attach", f"{_LUM} SELECT * FROM l WHERE x >= 2 AND x < 12 AND y >= 0 AND y < 8")
def lum_attach(spark, sf_dir):
    return calibration.attach_luminance(lens.events(spark, sf_dir).select("t", "x", "y", "p"), lens.pixels(spark, sf_dir), (2, 0, 12, 8))


_LI = f"""{_LUM}, o AS (SELECT p, x, y, t, t - lag(t) OVER w AS tau, lag(prev_lum) OVER w AS a, lag(next_lum) OVER w AS b, lag(frame_dt) OVER w AS dt FROM l WINDOW w AS (PARTITION BY p, x, y ORDER BY t)),
li AS (SELECT p, x, y, t, tau, (a + b) / 2 AS lbar, b - a AS dl, dt FROM o WHERE tau > 0 AND tau < {LONGEST * 10})"""


@_query("luminance_intervals", f"{_LI} SELECT p, x, y, t, tau, round(lbar, 6) AS lbar, round(dl, 6) AS dl, dt FROM li")
def luminance_intervals(spark, sf_dir):
    return rounded(intervals.luminance_intervals(_attached(spark, sf_dir), LONGEST * 10), lbar=6, dl=6)


@_query("voxel_grid", f"""{E}, r AS (SELECT *, 4 * (t - min(t) OVER ()) / greatest(max(t) OVER () - min(t) OVER (), 1) AS tau FROM e), s AS (SELECT x, y, floor(tau)::BIGINT AS i, tau - floor(tau) AS f, CASE WHEN p > 0 THEN 1 ELSE -1 END AS q FROM r),
u AS (SELECT i AS bin, y, x, q * (1 - f) AS v FROM s UNION ALL SELECT i + 1, y, x, q * f FROM s) SELECT bin, y, x, round(sum(v), 5) AS val FROM u WHERE bin < 5 GROUP BY ALL""")
def voxel_grid(spark, sf_dir):
    return rounded(voxel.voxel_grid(lens.events(spark, sf_dir), 5), val=5)


@_query("tumbling_window", f"{E} SELECT (t // 3600000000) * 3600000000 AS start_us, count(*) AS events, sum(p)::BIGINT AS on_events FROM e GROUP BY 1")
def tumbling_window(spark, sf_dir):
    return streams.tumbling_counts(lens.events(spark, sf_dir), "1 hour")


@_query(
    "late_cutoff",
    f"{E}, h AS (SELECT *, {lens.ORIGIN} + ((t - {lens.ORIGIN} + 1800000000 * (x % 2)) // 7200000000) * 7200000000 AS frame_t FROM e), g AS (SELECT frame_t, lag(frame_t) OVER (ORDER BY frame_t) AS c FROM (SELECT DISTINCT frame_t FROM h)) SELECT h.t, x, y, p, frame_t FROM h JOIN g USING (frame_t) WHERE c IS NULL OR h.t > c",
)
def late_cutoff(spark, sf_dir):
    rows = lens.events(spark, sf_dir).withColumn("frame_t", F.expr(f"{lens.ORIGIN} + ((t - {lens.ORIGIN} + 1800000000 * (x % 2)) div 7200000000) * 7200000000"))
    return frames.late_cutoff(rows).select("t", "x", "y", "p", "frame_t")


@_query("rate_series", f"{E}, z AS (SELECT t, (min(t) OVER ())::DOUBLE AS a, (max(t) OVER ())::DOUBLE AS b FROM e), s AS (" + _hist_sql("z", "t::DOUBLE", "a", "b", 64, ", round(coalesce(n, 0) / ((hi - lo) / 64 / 1e6), 6) AS rate").replace("v AS (", "WITH v AS (", 1) + ") SELECT bin, count, rate FROM s")
def rate_series(spark, sf_dir):
    return rounded(histogram.rate_series(lens.events(spark, sf_dir), "t", 64).select("bin", "count", "rate"), rate=6)


_BINS = 32


@_query(
    "rate_dft",
    f"""{E}, z AS (SELECT t::DOUBLE AS v, (min(t) OVER ())::DOUBLE AS lo, (max(t) OVER ())::DOUBLE AS hi FROM e), c AS (SELECT least(floor((v - lo) * {_BINS} / (hi - lo)), {_BINS - 1})::BIGINT AS bin, count(*) AS n FROM z GROUP BY 1),
w AS (SELECT any_value((hi - lo) / 1e6) AS s FROM z), m AS (SELECT k, sum(n / (s / {_BINS}) * cos(2 * pi() * ((k * bin) % {_BINS}) / {_BINS})) AS re, sum(-n / (s / {_BINS}) * sin(2 * pi() * ((k * bin) % {_BINS}) / {_BINS})) AS im, any_value(s) AS s FROM c, w, range({_BINS // 2 + 1}) q(k) GROUP BY k)
SELECT k, round(k / s, 9) AS hz, round(sqrt(re * re + im * im) * CASE WHEN k = 0 THEN 1 ELSE 2 END / {_BINS}, 9) AS magnitude FROM m""",
)
def rate_dft(spark, sf_dir):
    return rounded(spectrum.rate_dft(lens.events(spark, sf_dir), _BINS), hz=9, magnitude=9)


@_query(
    "fft_spectrum",
    f"""{E}, z AS (SELECT t::DOUBLE AS v, (min(t) OVER ())::DOUBLE AS lo, (max(t) OVER ())::DOUBLE AS hi FROM e), n AS (SELECT any_value((hi - lo) * 1e-6) AS s, greatest(1024, floor(1e-3 * any_value((hi - lo) * 1e-6)))::BIGINT AS n FROM z),
c AS (SELECT least(floor((v - lo) * n / (hi - lo)), n - 1)::BIGINT AS bin, count(*) AS c FROM z, n GROUP BY 1),
m AS (SELECT k, sum(c / (s / n) * cos(2 * pi() * ((k * bin) % n) / n)) AS re, sum(-c / (s / n) * sin(2 * pi() * ((k * bin) % n) / n)) AS im, any_value(s) AS s, any_value(n) AS n FROM c, n, range(100000) q(k) WHERE k <= n // 2 GROUP BY k)
SELECT k, round(k / s, 9) AS hz, round(sqrt(re * re + im * im) * CASE WHEN k = 0 THEN 1 ELSE 2 END / n, 9) AS magnitude FROM m WHERE k / s <= 1e-3""",
)
def fft_spectrum(spark, sf_dir):
    return rounded(spectrum.spectrum(lens.events(spark, sf_dir), 1e-3, 1e-3), hz=9, magnitude=9)


@_query(
    "hist2d_range",
    """WITH d AS (SELECT l_quantity AS x, l_extendedprice AS y, min(l_quantity) OVER () AS xa, max(l_quantity) OVER () AS xb, min(l_extendedprice) OVER () AS ya, max(l_extendedprice) OVER () AS yb FROM lineitem),
c AS (SELECT least(floor((x - xa) * 30 / (xb - xa)), 29) AS i, least(floor((y - ya) * 30 / (yb - ya)), 29) AS j, any_value(xa) AS xa, any_value(xb) AS xb, any_value(ya) AS ya, any_value(yb) AS yb, count(*) AS n FROM d GROUP BY 1, 2)
SELECT round(coalesce(min(CASE WHEN n > 100 THEN xa + i * (xb - xa) / 30 END), any_value(xa)), 6) AS x_min, round(coalesce(max(CASE WHEN n > 100 THEN xa + (i + 1) * (xb - xa) / 30 END), any_value(xb)), 6) AS x_max,
  round(coalesce(min(CASE WHEN n > 100 THEN ya + j * (yb - ya) / 30 END), any_value(ya)), 4) AS y_min, round(coalesce(max(CASE WHEN n > 100 THEN ya + (j + 1) * (yb - ya) / 30 END), any_value(yb)), 4) AS y_max FROM c""",
)
def hist2d_range(spark, sf_dir):
    out = histogram.valid_range(lens.table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice")
    return rounded(out, x_min=6, x_max=6, y_min=4, y_max=4)


_CELLS = "WITH d AS (SELECT (CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::TINYINT AS p, l_quantity AS lbar, l_discount * 100 AS dl, l_extendedprice / 1000 AS tau FROM lineitem)"


def _cells(spark, sf_dir):
    return lens.table(spark, sf_dir, "lineitem").select(F.when(F.col("l_returnflag") == "R", 1).otherwise(0).cast("tinyint").alias("p"), F.col("l_quantity").alias("lbar"), (F.col("l_discount") * 100).alias("dl"), (F.col("l_extendedprice") / 1000).alias("tau"))


def _fits(spark, sf_dir):
    ranges = spark.createDataFrame([(0, 0.5, 50.5, -0.5, 10.5), (1, 0.5, 50.5, -0.5, 10.5)], "p tinyint, x_min double, x_max double, y_min double, y_max double")
    return calibration.bucket_fits(_cells(spark, sf_dir), ranges, bins=5, least=50)


_FITS = f"""{_CELLS}, c AS (SELECT p, floor((lbar - 0.5) * 5 / 50) AS i, floor((dl + 0.5) * 5 / 11) AS j, tau FROM d WHERE lbar >= 0.5 AND lbar < 50.5 AND dl >= -0.5 AND dl < 10.5),
g AS (SELECT p, i, j, count(*) AS n, avg(tau) AS m, 1 / (avg(1 / tau) - 1 / avg(tau)) AS l FROM c GROUP BY ALL HAVING count(*) >= 50),
k AS (SELECT p, 0.5 + i * 50.0 / 5 AS mean_min, 0.5 + (i + 1) * 50.0 / 5 AS mean_max, -0.5 + j * 11.0 / 5 AS diff_min, -0.5 + (j + 1) * 11.0 / 5 AS diff_max, m AS mu_hat, l AS lambda_hat, CASE WHEN p = 1 THEN -1 ELSE 1 END / m AS mu, 1 / sqrt(l) AS sigma, n AS count FROM g)"""


@_query("bucket_fit", f"{_FITS} SELECT p, round(mean_min, 6) AS mean_min, round(mean_max, 6) AS mean_max, round(diff_min, 6) AS diff_min, round(diff_max, 6) AS diff_max, round(mu_hat, 5) AS mu_hat, round(lambda_hat, 5) AS lambda_hat, round(mu, 7) AS mu, round(sigma, 6) AS sigma, count FROM k")
def bucket_fit(spark, sf_dir):
    return rounded(_fits(spark, sf_dir), mean_min=6, mean_max=6, diff_min=6, diff_max=6, mu_hat=5, lambda_hat=5, mu=7, sigma=6)


def _line_sql(source: str, x: str, y: str, w: str, by: str, least: int = 1) -> str:
    return f"""(SELECT {by}, n, total, xy / xx AS slope, my - xy / xx * mx AS intercept FROM (SELECT {by}, count(*) AS n, sum({w}) AS total, any_value(mx) AS mx, any_value(my) AS my, sum({w} * ({x} - mx) * ({y} - my)) AS xy, nullif(sum({w} * ({x} - mx) * ({x} - mx)), 0) AS xx
  FROM {source} JOIN (SELECT {by}, sum({w} * {x}) / sum({w}) AS mx, sum({w} * {y}) / sum({w}) AS my FROM {source} GROUP BY {by} HAVING count(*) >= {least}) USING ({by}) GROUP BY {by}))"""


@_query("wls_line", f"WITH s AS (SELECT l_returnflag, l_quantity AS x, l_extendedprice AS y, 1 + l_discount AS w FROM lineitem) SELECT l_returnflag, n, round(total, 4) AS total, round(slope, 4) AS slope, round(intercept, 3) AS intercept FROM {_line_sql('s', 'x', 'y', 'w', 'l_returnflag')}")
def wls_line(spark, sf_dir):
    rows = lens.table(spark, sf_dir, "lineitem").withColumn("w", 1 + F.col("l_discount"))
    return rounded(regression.weighted_line(rows, "l_quantity", "l_extendedprice", "w", ["l_returnflag"]), total=4, slope=4, intercept=3)


@_query(
    "wls_plane",
    """WITH s AS (SELECT p_brand AS g, p_size::DOUBLE AS u, p_partkey::DOUBLE AS v, p_retailprice AS y, 1 + p_size % 3 AS w FROM part),
m AS (SELECT g, sum(w * u) / sum(w) AS mu, sum(w * v) / sum(w) AS mv, sum(w * y) / sum(w) AS my FROM s GROUP BY g),
c AS (SELECT s.g, count(*) AS n, any_value(mu) AS mu, any_value(mv) AS mv, any_value(my) AS my, sum(w * (u - mu) * (u - mu)) AS uu, sum(w * (u - mu) * (v - mv)) AS uv, sum(w * (v - mv) * (v - mv)) AS vv, sum(w * (u - mu) * (y - my)) AS uy, sum(w * (v - mv) * (y - my)) AS vy FROM s JOIN m ON s.g = m.g GROUP BY s.g),
k AS (SELECT *, (uy * vv - vy * uv) / (uu * vv - uv * uv) AS a, (vy * uu - uy * uv) / (uu * vv - uv * uv) AS b FROM c)
SELECT g AS p_brand, n, round(a, 5) AS slope_u, round(b, 7) AS slope_v, round(my - a * mu - b * mv, 3) AS intercept FROM k""",
)
def wls_plane(spark, sf_dir):
    rows = lens.table(spark, sf_dir, "part").withColumn("w", 1 + F.col("p_size") % 3)
    return rounded(regression.weighted_plane(rows, "p_size", "p_partkey", "p_retailprice", "w", ["p_brand"]), slope_u=5, slope_v=7, intercept=3)


def _plane_sql(source: str, by: str) -> str:
    """slope_u, slope_v, intercept of y ~ u + v, weights w."""
    return f"""(SELECT {by}, (uy * vv - vy * uv) / (uu * vv - uv * uv) AS slope_u, (vy * uu - uy * uv) / (uu * vv - uv * uv) AS slope_v, my - (uy * vv - vy * uv) / (uu * vv - uv * uv) * mu_ - (vy * uu - uy * uv) / (uu * vv - uv * uv) * mv AS intercept FROM
  (SELECT {by}, any_value(mu_) AS mu_, any_value(mv) AS mv, any_value(my) AS my, sum(w * (u - mu_) * (u - mu_)) AS uu, sum(w * (u - mu_) * (v - mv)) AS uv, sum(w * (v - mv) * (v - mv)) AS vv, sum(w * (u - mu_) * (y - my)) AS uy, sum(w * (v - mv) * (y - my)) AS vy
   FROM {source} JOIN (SELECT {by}, sum(w * u) / sum(w) AS mu_, sum(w * v) / sum(w) AS mv, sum(w * y) / sum(w) AS my FROM {source} GROUP BY {by}) USING ({by}) GROUP BY {by}))"""


#: Line items as intervals of a sensor: the rate grows with the discount and falls with the quantity, the tax scatters it.
_RESPONSES = """WITH d AS (SELECT (CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::TINYINT AS p, l_quantity AS lbar, l_discount * 100 + 1 AS dl, (l_quantity + 20) * 3333 / (l_discount * 100 + 1) * (1 + l_tax) AS tau FROM lineitem),
cells AS (SELECT p, floor((lbar - 0.5) * 10 / 50) AS i, floor((dl - 0.5) * 11 / 11) AS j, tau FROM d WHERE lbar >= 0.5 AND lbar < 50.5 AND dl >= 0.5 AND dl < 11.5),
fitted AS (SELECT p, i, j, count(*) AS n, avg(tau) AS m, 1 / (avg(1 / tau) - 1 / avg(tau)) AS l FROM cells GROUP BY ALL HAVING count(*) >= 10),
k AS (SELECT p, 0.5 + i * 50.0 / 10 AS mean_min, 0.5 + (i + 1) * 50.0 / 10 AS mean_max, 0.5 + j * 11.0 / 11 AS diff_min, 0.5 + (j + 1) * 11.0 / 11 AS diff_max, CASE WHEN p = 1 THEN 1 ELSE -1 END / m AS mu, n AS count FROM fitted WHERE l > 0)"""


def _response_fits(spark, sf_dir):
    rate = (F.col("l_quantity") + 20) * 3333 / (F.col("l_discount") * 100 + 1) * (1 + F.col("l_tax"))
    rows = lens.table(spark, sf_dir, "lineitem").select(F.when(F.col("l_returnflag") == "R", 1).otherwise(0).cast("tinyint").alias("p"), F.col("l_quantity").alias("lbar"), (F.col("l_discount") * 100 + 1).alias("dl"), rate.alias("tau"))
    ranges = spark.createDataFrame([(p, bins, 0.5, 50.5, 0.5, 11.5) for p, bins in ((0, 10), (1, 10))], "p tinyint, bins int, x_min double, x_max double, y_min double, y_max double").drop("bins")
    return calibration.bucket_fits(rows, ranges, bins=(10, 11), least=10, on_sign=1)


@_query(
    "sensor_constants",
    f"""{_RESPONSES}, f AS (SELECT p, (mean_min + mean_max) / 2 AS lbar, (diff_min + diff_max) / 2 / 16667.0 AS kdl, mu, count FROM k),
s AS (SELECT * FROM {_line_sql('f', 'kdl', 'mu', 'count', 'p, lbar', 5)}), r AS (SELECT p, lbar, 1 / slope AS inverse, total FROM s WHERE slope <> 0),
g AS (SELECT p, 1 / slope AS k1, intercept / slope AS k2 FROM {_line_sql('r', 'lbar', 'inverse', 'total', 'p')}),
o AS (SELECT f.p, kdl / (f.lbar + k2) AS u, f.lbar AS v, mu AS y, count AS w FROM f JOIN s ON s.p = f.p AND s.lbar = f.lbar JOIN g ON g.p = f.p)
SELECT p, round(k1, 6) AS k1, round(k2, 5) AS k2, round(slope_u, 6) AS k1_check, round(intercept * 1e9, 3) AS k4, round(slope_v * 1e9, 5) AS k5 FROM g JOIN {_plane_sql('o', 'p')} USING (p)""",
)
def sensor_constants(spark, sf_dir):
    found = calibration.sensor_constants(_response_fits(spark, sf_dir))
    return rounded(found.select("p", "k1", "k2", "k1_check", (F.col("k4") * 1e9).alias("k4"), (F.col("k5") * 1e9).alias("k5")), k1=6, k2=5, k1_check=6, k4=3, k5=5)


@_query(
    "calibrate_sessions",
    f"""{_LI}, b AS (SELECT p, min(lbar) AS xa, max(lbar) AS xb, min(dl) AS ya, max(dl) AS yb FROM li GROUP BY p),
c AS (SELECT p, least(floor((lbar - xa) * 30 / (xb - xa)), 29) AS i, least(floor((dl - ya) * 30 / (yb - ya)), 29) AS j, any_value(xa) AS xa, any_value(xb) AS xb, any_value(ya) AS ya, any_value(yb) AS yb, count(*) AS n FROM li JOIN b USING (p) GROUP BY 1, 2, 3),
v AS (SELECT p, coalesce(min(CASE WHEN n > 100 THEN xa + i * (xb - xa) / 30 END), any_value(xa)) AS xa, coalesce(max(CASE WHEN n > 100 THEN xa + (i + 1) * (xb - xa) / 30 END), any_value(xb)) AS xb,
  coalesce(min(CASE WHEN n > 100 THEN ya + j * (yb - ya) / 30 END), any_value(ya)) AS ya, coalesce(max(CASE WHEN n > 100 THEN ya + (j + 1) * (yb - ya) / 30 END), any_value(yb)) AS yb FROM c GROUP BY p),
k AS (SELECT p, floor((lbar - xa) * 4 / (xb - xa)) AS i, floor((dl - ya) * 4 / (yb - ya)) AS j, xa, xb, ya, yb, tau / 1e6 AS s FROM li JOIN v USING (p) WHERE lbar >= xa AND lbar < xb AND dl >= ya AND dl < yb),
z AS (SELECT p, i, j, any_value(xa) AS xa, any_value(xb) AS xb, any_value(ya) AS ya, any_value(yb) AS yb, count(*) AS n, avg(s) AS m, 1 / (avg(1 / s) - 1 / avg(s)) AS l FROM k GROUP BY p, i, j)
SELECT p, round(xa + i * (xb - xa) / 4, 4) AS mean_min, round(xa + (i + 1) * (xb - xa) / 4, 4) AS mean_max, round(ya + j * (yb - ya) / 4, 4) AS diff_min, round(ya + (j + 1) * (yb - ya) / 4, 4) AS diff_max,
  round(m, 2) AS mean_s, round(l, 2) AS shape_s, round(CASE WHEN p = 1 THEN -1 ELSE 1 END / m * 1e6, 4) AS mu, n AS count FROM z WHERE n >= 20 AND l > 0""",
)
def calibrate_sessions(spark, sf_dir):
    fitted = calibration.calibrate(_attached(spark, sf_dir), LONGEST * 10, bins=4, least=20)
    out = fitted.select("p", "mean_min", "mean_max", "diff_min", "diff_max", (F.col("mu_hat") / 1e6).alias("mean_s"), (F.col("lambda_hat") / 1e6).alias("shape_s"), (F.col("mu") * 1e12).alias("mu"), "count")
    return rounded(out, mean_min=4, mean_max=4, diff_min=4, diff_max=4, mean_s=2, shape_s=2, mu=4)


@_query("normalize_cloud", f"{E}, r AS (SELECT *, min(t) OVER () AS a, max(t) OVER () AS b, max(x) OVER () AS mx, min(x) OVER () AS nx, max(y) OVER () AS my, min(y) OVER () AS ny FROM e) SELECT round((t - a) / (b - a), 9) AS t, round((x - nx) / (mx - nx), 9) AS x, coalesce(round((y - ny) / nullif(my - ny, 0), 9), 0) AS y FROM r")
def normalize_cloud(spark, sf_dir):
    return rounded(cloud.normalized(lens.events(spark, sf_dir).select("t", "x", "y")), t=9, x=9, y=9)


@_query("time_range_filter", f"{E} SELECT count(*) AS n FROM e WHERE t BETWEEN (SELECT min(t) FROM e WHERE p = 1 AND x = 3) AND (SELECT max(t) FROM e WHERE p = 1 AND x = 3)")
def time_range_filter(spark, sf_dir):
    rows = lens.events(spark, sf_dir)
    return cloud.within_time_of(rows, rows.where("p = 1 and x = 3")).agg(F.count("*").alias("n"))


def _drifts(spark, sf_dir):
    k = preset("DVS346")
    rows = frames.consecutive(lens.pixels(spark, sf_dir)).where("prev_lum is not null")
    mean, change = P.mean_luminance(F.col("prev_lum"), F.col("lum")), F.col("lum") - F.col("prev_lum")
    return rows.withColumn("mu", P.drift(mean, change, (F.col("t") - F.col("prev_t")) / 1e6, k)).withColumn("sigma", P.diffusion(mean, k))


_K = preset("DVS346")
_DRIFT = f"""{EF}, d AS (SELECT *, lag(lum) OVER w AS a, lag(t) OVER w AS s FROM f WINDOW w AS (PARTITION BY x, y ORDER BY frame_idx)),
m AS (SELECT frame_idx, x, y, {_K.k1!r} * (lum - a) / ((t - s) / 1e6) / ((a + lum) / 2 + {_K.k2!r}) + {_K.k4!r} + {_K.k5!r} * (a + lum) / 2 AS mu, {_K.k3!r} * sqrt((a + lum) / 2) / ((a + lum) / 2 + {_K.k2!r}) + {_K.k6!r} AS sigma FROM d WHERE a IS NOT NULL)"""


@_query("drift_diffusion", f"{_DRIFT} SELECT frame_idx, x, y, round(mu * 1e6, 6) AS mu, round(sigma * 1e6, 6) AS sigma FROM m")
def drift_diffusion(spark, sf_dir):
    return _drifts(spark, sf_dir).select("frame_idx", "x", "y", F.round(F.col("mu") * 1e6, 6).alias("mu"), F.round(F.col("sigma") * 1e6, 6).alias("sigma"))


@_query(
    "first_barrier_prob",
    f"""{_DRIFT}, z AS (SELECT frame_idx, x, y, mu * 10 AS mu, (x - 8) / 16.0 AS r FROM m), q AS (SELECT *, 2 * mu AS k, 1 - r AS a, 1 + r AS b FROM z)
SELECT frame_idx, x, y, round(CASE WHEN mu > 0 THEN (1 - exp(-k * b)) / (1 - exp(-k * 2)) WHEN mu < 0 THEN (exp(k * a) - exp(k * 2)) / (1 - exp(k * 2)) ELSE b / 2 END, 6) AS p_on FROM q""",
)
def first_barrier_prob(spark, sf_dir):
    prob = P.first_barrier_probability(F.col("mu") * 10, F.lit(1.0), (F.col("x") - 8) / 16.0)
    return _drifts(spark, sf_dir).select("frame_idx", "x", "y", F.round(prob, 6).alias("p_on"))


@_query("pixel_functions", f"{E}, v AS (SELECT t, x, y, floor(value)::INT AS v FROM e) SELECT t, x, y, floor(v * 255 / 1023)::INT AS eight, (v >> 6) & 1023 AS bits, round(0.299 * v + 0.587 * (v % 256) + 0.114 * (v % 7))::INT AS gray, trunc((t - {lens.ORIGIN}) / 1000)::BIGINT AS us FROM v")
def pixel_functions(spark, sf_dir):
    return _pixel_functions(lens.events(spark, sf_dir))


def _pixel_functions(rows):
    v = F.col("v")
    rows = rows.withColumn("v", F.floor("value").cast("int"))
    return rows.select("t", "x", "y", P.ten_to_eight_bits(v).alias("eight"), P.unpack_ten_bits(v).alias("bits"), P.gray(v, v % 256, v % 7).alias("gray"), P.to_microseconds(F.col("t"), F.lit(lens.ORIGIN)).alias("us"))


@_query(
    "pixel_functions_all",
    """WITH v AS (SELECT l_orderkey, l_linenumber, floor(l_extendedprice)::INT % 65536 AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, floor(v % 1024 * 255 / 1023)::INT AS eight, (v >> 6) & 1023 AS bits, round(0.114 * (v % 256) + 0.587 * (v % 251) + 0.299 * (v % 241))::INT AS gray, floor(v / 256)::INT AS high FROM v""",
)
def pixel_functions_all(spark, sf_dir):
    """The pixel functions over line items as 16-bit pixels, gray from channels in blue, green, red order."""
    v = F.col("v")
    rows = lens.table(spark, sf_dir, "lineitem").withColumn("v", F.floor("l_extendedprice").cast("int") % 65536)
    return rows.select("l_orderkey", "l_linenumber", P.ten_to_eight_bits(v % 1024).alias("eight"), P.unpack_ten_bits(v).alias("bits"), P.gray(v % 256, v % 251, v % 241, "bgr").alias("gray"), P.sixteen_to_eight_bits(v).alias("high"))


@_query(
    "eight_bits",
    f"{E}, v AS (SELECT t, x, y, floor(value * 130)::INT AS v FROM e) SELECT t, x, y, floor(v / 256)::INT AS high, floor(v / (max(v) OVER (PARTITION BY x, y))::DOUBLE * 255)::INT AS stretched FROM v",
)
def eight_bits(spark, sf_dir):
    rows = lens.events(spark, sf_dir).select("t", "x", "y", F.floor(F.col("value") * 130).cast("int").alias("v"))
    most = F.max("v").over(Window.partitionBy("x", "y"))
    return rows.select("t", "x", "y", P.sixteen_to_eight_bits(F.col("v")).alias("high"), P.stretch_to_eight_bits(F.col("v"), most).alias("stretched"))


@_query("center_crop", f"{E} SELECT t, x - 4 AS x, y - 1 AS y, p FROM e WHERE x BETWEEN 4 AND 11 AND y BETWEEN 1 AND 8")
def center_crop(spark, sf_dir):
    return P.center_crop(lens.events(spark, sf_dir), 16, 10, 8, 8).select("t", "x", "y", "p")


@_query(
    "preset_table",
    f"""{E}, c AS (SELECT * FROM (VALUES {', '.join(f'({i}, {n!r}, ' + ', '.join(f'{float(v)!r}::DOUBLE' for v in vars(preset(n)).values()) + ')' for i, n in enumerate(PRESETS))}) v(i, camera, k1, k2, k3, k4, k5, k6))
SELECT camera, k1, k2, k3, k4, k5, k6, count(*) AS n, round(avg(k3 * sqrt(value) / (value + k2) + k6) * 1e6, 6) AS mean_sigma FROM e JOIN c ON i = x % {len(PRESETS)} GROUP BY ALL""",
)
def preset_table(spark, sf_dir):
    """The presets with the events of the pixels that have them, and the mean noise at their values."""
    names = list(PRESETS)
    camera = F.get(F.array(*[F.lit(n) for n in names]), F.col("x") % len(names))
    joined = lens.events(spark, sf_dir).withColumn("camera", camera).join(F.broadcast(presets(spark)), "camera")
    sigma = F.col("k3") * F.sqrt("value") / (F.col("value") + F.col("k2")) + F.col("k6")
    out = joined.groupBy("camera", "k1", "k2", "k3", "k4", "k5", "k6").agg(F.count("*").alias("n"), (F.avg(sigma) * 1e6).alias("mean_sigma"))
    return rounded(out, mean_sigma=6)


@_query(
    "ig_density",
    f"{E} SELECT t, x, y, round(CASE WHEN value > 0 THEN sqrt(5 / (2 * pi() * (value / 100) ** 3)) * exp(-5 * (value / 100 - 2) ** 2 / (8 * value / 100)) ELSE 0 END, 9) AS density FROM e",
)
def ig_density(spark, sf_dir):
    density = P.inverse_gaussian_pdf(F.col("value") / 100, F.lit(2.0), F.lit(5.0))
    return rounded(lens.events(spark, sf_dir).select("t", "x", "y", density.alias("density")), density=9)


@_query(
    "voxel_levels",
    f"""{E}, r AS (SELECT *, 4 * (t - min(t) OVER ()) / greatest(max(t) OVER () - min(t) OVER (), 1) AS tau FROM e), s AS (SELECT x, y, floor(tau)::BIGINT AS i, tau - floor(tau) AS f, CASE WHEN p > 0 THEN 1 ELSE -1 END AS q FROM r),
u AS (SELECT i AS bin, y, x, q * (1 - f) AS v FROM s UNION ALL SELECT i + 1, y, x, q * f FROM s), g AS (SELECT bin, y, x, sum(v) AS val FROM u WHERE bin < 5 GROUP BY ALL),
b AS (SELECT bin, CASE WHEN count(*) = 256 THEN min(val) ELSE least(min(val), 0) END AS lo, CASE WHEN count(*) = 256 THEN max(val) ELSE greatest(max(val), 0) END AS hi FROM g GROUP BY bin)
SELECT bin, y, x, round((val - lo) / nullif(hi - lo, 0), 6) AS level FROM g JOIN b USING (bin)""",
)
def voxel_levels(spark, sf_dir):
    return rounded(voxel.normalized_slices(voxel.voxel_grid(lens.events(spark, sf_dir), 5), 16, 16).select("bin", "y", "x", "level"), level=6)


def _quad_sql(f: str) -> str:
    return ", ".join(f.format(c=c, i=i) for i in range(4) for c in "xy")


@_query(
    "quad_measures",
    f"""WITH {lens.EVENT_BOXES_SQL}, m AS (SELECT *, (x0 + x1 + x2 + x3) / 4 AS mx, (y0 + y1 + y2 + y3) / 4 AS my FROM b), w AS (SELECT t, mx, my, {_quad_sql('m{c} + ({c}{i} - m{c}) * 1.25 AS {c}{i}')} FROM m)
SELECT t, {_quad_sql('round({c}{i}, 6) AS {c}{i}')}, {', '.join(f'round(sqrt((x{(i + 1) % 4} - x{i}) ** 2 + (y{(i + 1) % 4} - y{i}) ** 2), 6) AS side{i}' for i in range(4))},
  (ceil(round(greatest(greatest(x0, x1, x2, x3) - least(x0, x1, x2, x3), greatest(y0, y1, y2, y3) - least(y0, y1, y2, y3)), 6) / 10) * 10)::INT AS size,
  greatest(0, floor(least(x0, x1, x2, x3)))::INT AS "left", greatest(0, floor(least(y0, y1, y2, y3)))::INT AS top, least(16, ceil(greatest(x0, x1, x2, x3)))::INT AS "right", least(10, ceil(greatest(y0, y1, y2, y3)))::INT AS bottom FROM w""",
)
def quad_measures(spark, sf_dir):
    wide = G.expand([(F.col(f"x{i}"), F.col(f"y{i}")) for i in range(4)], 0.25)
    rows = lens.event_flat_boxes(spark, sf_dir).select("t", *[wide[i][k].alias(f"{'xy'[k]}{i}") for i in range(4) for k in range(2)])
    points = [(F.col(f"x{i}"), F.col(f"y{i}")) for i in range(4)]
    bounds = dict(zip(("left", "top", "right", "bottom"), G.crop_bounds(points, 16, 10), strict=True))
    names = [f"{c}{i}" for i in range(4) for c in "xy"]
    return rows.select("t", *[F.round(c, 6).alias(c) for c in names], *[F.round(v, 6).alias(f"side{i}") for i, v in enumerate(G.side_lengths(points))], G.round_up_to_ten(F.round(G.extent(points), 6)).alias("size"), *[v.alias(n) for n, v in bounds.items()])


@_query(
    "either_box",
    f"""{E}, {lens.BOXES_SQL}, z AS (SELECT t, CASE WHEN ok THEN angle END AS angle, CASE WHEN ok THEN cx END AS cx, CASE WHEN ok THEN cy END AS cy, ok FROM (SELECT *, ((t - {lens.ORIGIN}) // {lens.DAY}) % 5 < 3 AS ok FROM b)),
n AS (SELECT *, lead(t) OVER (ORDER BY t) AS hi, row_number() OVER (ORDER BY t) AS k FROM z),
m AS (SELECT e.t, x, y, n.k, n.t AS lo, hi, CASE WHEN e.t <= n.t OR hi IS NULL THEN n.k ELSE n.k + 1 END AS k2 FROM e JOIN n ON (e.t > n.t OR n.k = 1) AND (e.t <= n.hi OR n.hi IS NULL)),
q AS (SELECT m.t, m.x, m.y, CASE WHEN m.k = m.k2 THEN 0.0 ELSE (m.t - lo) / (m.hi - lo) END AS w, a.ok AS o1, c.ok AS o2, a.angle AS a1, c.angle AS a2, a.cx AS x1, c.cx AS x2, a.cy AS y1, c.cy AS y2,
  CASE WHEN c.angle - a.angle > 180 THEN -360 WHEN c.angle - a.angle < -180 THEN 360 ELSE 0 END AS turn FROM m JOIN n a ON a.k = m.k JOIN n c ON c.k = m.k2)
SELECT t, x, y, {', '.join(f'round(CASE WHEN o1 AND o2 THEN {both} WHEN o1 THEN {one} WHEN o2 THEN {two} END, 6) AS {name}' for name, both, one, two in (('angle', 'a1 + w * (a2 + turn - a1)', 'a1', 'a2'), ('cx', '(1 - w) * x1 + w * x2', 'x1', 'x2'), ('cy', '(1 - w) * y1 + w * y2', 'y1', 'y2')))} FROM q""",
)
def either_box(spark, sf_dir):
    return rounded(roi.with_either_box(lens.events(spark, sf_dir).select("t", "x", "y"), lens.gappy_boxes(spark)).select("t", "x", "y", "angle", "cx", "cy"), angle=6, cx=6, cy=6)


@_query("strided_parts", f"{E} SELECT t, x, y, ((row_number() OVER (ORDER BY t) - 1) % 7)::INT AS part FROM e")
def strided_parts(spark, sf_dir):
    return ordered.strided(lens.events(spark, sf_dir).select("t", "x", "y"), 7, "t")


@_query("union_of_clocks", f"{E} SELECT t - {lens.ORIGIN} AS t, x, y, p, 'shifted' AS source FROM e WHERE p > 0 UNION ALL SELECT t, x, y, p, NULL FROM e WHERE p = 0")
def union_of_clocks(spark, sf_dir):
    rows = lens.events(spark, sf_dir).select("t", "x", "y", "p")
    on = rows.where("p > 0").withColumn("t", P.shifted_clock(F.col("t"), F.lit(lens.ORIGIN))).withColumn("source", F.lit("shifted"))
    return ordered.union_all([on, rows.where("p = 0")])


@_query("subsample_size", f"{E} SELECT least(count(*), 700)::BIGINT AS n, 1 AS inside FROM e")
def subsample_size(spark, sf_dir):
    rows = lens.events(spark, sf_dir).select("t", "x", "y", "p")
    some = ordered.subsample(rows, 700, 3)
    return some.agg(F.count("*").alias("n")).crossJoin(some.join(rows, rows.columns, "left_anti").agg((F.count("*") == 0).cast("int").alias("inside")))


@_query(
    "interval_analysis",
    f"{TAU} SELECT count(*) AS n, round(avg(tau / 1e6), 3) AS mean, round(1 / (avg(1e6 / tau) - 1 / avg(tau / 1e6)), 3) AS shape, count(DISTINCT (x, y)) AS pixels FROM i",
)
def interval_analysis(spark, sf_dir):
    fitted, _ = intervals.interval_analysis(lens.events(spark, sf_dir).select("t", "x", "y", "p"), 10)
    return rounded(fitted.select("n", (F.col("mean") / 1e6).alias("mean"), (F.col("shape") / 1e6).alias("shape"), "pixels"), mean=3, shape=3)


@_query("needed_frames", f"{_LUM} SELECT frame_idx, count(*) AS pixels FROM f WHERE frame_idx IN (SELECT a FROM j UNION SELECT b FROM j) GROUP BY frame_idx")
def needed_frames(spark, sf_dir):
    pixels = lens.pixels(spark, sf_dir)
    near = asof.asof_bracket(lens.events(spark, sf_dir), pixels.select("frame_idx", "t").distinct()).select(F.col("prev.frame_idx").alias("_a"), F.col("next.frame_idx").alias("_b"))
    return calibration.needed_frames(near, pixels).groupBy("frame_idx").agg(F.count("*").alias("pixels"))


@_query("cloud_distance")
def cloud_distance(spark, sf_dir):
    rows = lens.events(spark, sf_dir)
    value = cloud.cloud_distance(rows.where("p = 1"), rows.where("p = 0"), blur=0.05, scaling=0.5, points=3000)
    return spark.createDataFrame([(value,)], "distance double")


@_query("parameter_search")
def parameter_search(spark, sf_dir):
    real = lens.events(spark, sf_dir).select("t", "x", "y", "p")
    return cloud.simulated_distances(_full_frames(spark, sf_dir), real, 4, fill=50.0)


_LEVEL = "0.5 + sign(a.level - 0.5) * greatest(abs(a.level - 0.5) - 1e-12 * (b.t - a.t), 0)"


@_query(
    "accumulator_map",
    f"""{E}, l AS (SELECT x, y, list({{'level': 0.5::DOUBLE, 't': t, 'p': p::INT}} ORDER BY t, p) AS l FROM e GROUP BY x, y),
r AS (SELECT x, y, list_reduce(list_concat([{{'level': 0.5::DOUBLE, 't': l[1].t, 'p': -1}}], l), lambda a, b: {{'level': least(1.0, greatest(0.0, {_LEVEL} + CASE WHEN b.p > 0 THEN 0.25 ELSE -0.25 END))::DOUBLE, 't': b.t, 'p': b.p}}) AS r FROM l)
SELECT x, y, round(r.level, 9) AS level, r.t AS t FROM r""",
)
def accumulator_map(spark, sf_dir):
    return rounded(streams.accumulate(lens.events(spark, sf_dir), decay=1e-12), level=9)


_QUARTER = 6 * 3_600_000_000


@_query(
    "accumulator_slices",
    f"""{E}, w AS (SELECT x, y, t, p, t // {_QUARTER} AS slice, list({{'level': 0.5::DOUBLE, 't': t, 'p': p::INT}}) OVER u AS l, row_number() OVER (PARTITION BY x, y, t // {_QUARTER} ORDER BY t DESC, p DESC) AS k, count(*) OVER (PARTITION BY x, y, t // {_QUARTER}) AS n
  FROM e WINDOW u AS (PARTITION BY x, y ORDER BY t, p ROWS UNBOUNDED PRECEDING)),
r AS (SELECT x, y, slice, n, t, list_reduce(list_concat([{{'level': 0.5::DOUBLE, 't': l[1].t, 'p': -1}}], l), lambda a, b: {{'level': least(1.0, greatest(0.0, {_LEVEL} + CASE WHEN b.p > 0 THEN 0.25 ELSE -0.25 END))::DOUBLE, 't': b.t, 'p': b.p}}).level AS level FROM w WHERE k = 1)
SELECT x, y, slice, n, t, round(level, 9) AS level, (slice + 1) * {_QUARTER} AS "end", round(0.5 + sign(level - 0.5) * greatest(abs(level - 0.5) - 1e-12 * ((slice + 1) * {_QUARTER} - t), 0), 9) AS shown FROM r""",
)
def accumulator_slices(spark, sf_dir):
    return rounded(accumulator.slice_frames(lens.events(spark, sf_dir), _QUARTER, decay=1e-12), level=9, shown=9)


def _full_frames(spark, sf_dir):
    """Pseudo-frames in milliseconds: every pixel's luminance scaled to the sensor's, short enough apart for events."""
    return lens.pixels(spark, sf_dir).select("frame_idx", (F.col("frame_idx").cast("long") * 8333).alias("t"), "x", "y", (F.col("lum") / 2).alias("lum"))


@_query("dvs_events")
def dvs_events(spark, sf_dir):
    return simulate.dvs_events(_full_frames(spark, sf_dir), "DVS346", seed=1, fill=50.0)


@_query(
    "wls_time",
    f"{E}, s AS (SELECT p, t::DOUBLE AS x, value AS y, (1 + p)::DOUBLE AS w FROM e) SELECT p, n, round(total, 3) AS total, round(slope * 1e15, 2) AS slope_e15, round(intercept, 2) AS intercept FROM {_line_sql('s', 'x', 'y', 'w', 'p')}",
)
def wls_time(spark, sf_dir):
    """value ~ t with t in microseconds of our days, about 1.7e15."""
    rows = lens.events(spark, sf_dir).withColumn("w", 1 + F.col("p"))
    out = regression.weighted_line(rows, "t", "value", "w", ["p"]).withColumn("slope_e15", F.col("slope") * 1e15)
    return rounded(out.select("p", "n", "total", "slope_e15", "intercept"), total=3, slope_e15=2, intercept=2)


_WEEK = 7 * lens.DAY
_BRIGHT = f"e AS (SELECT * FROM a WHERE p = 1 AND value > 100 AND t >= {lens.ORIGIN + _WEEK} AND t < {lens.ORIGIN + 2 * _WEEK})"


@_query(
    "needed_frame_scan",
    f"""WITH {lens.EVENTS_SQL.replace('e AS (', 'a AS (', 1)}, {lens.PIXELS_SQL.replace('FROM e GROUP', 'FROM a GROUP').replace('max(value) AS lum', 'floor(max(value) * 10)::BIGINT AS lum')}, {_BRIGHT},
g AS (SELECT DISTINCT frame_idx, t FROM f), h AS (SELECT frame_idx AS a, t AS lo, lead(frame_idx) OVER (ORDER BY t) AS b, lead(t) OVER (ORDER BY t) AS hi FROM g),
i AS (SELECT *, row_number() OVER (ORDER BY lo) AS k, count(*) OVER () AS n FROM h WHERE b IS NOT NULL),
j AS (SELECT e.t, x, y, a, b FROM e JOIN i ON (e.t > lo OR k = 1) AND (e.t <= hi OR k = n))
SELECT j.t, j.x, j.y, a AS prev_frame, b AS next_frame, coalesce(u.lum, 0)::INT AS prev_lum, coalesce(v.lum, 0)::INT AS next_lum FROM j LEFT JOIN f u ON u.frame_idx = a AND u.x = j.x AND u.y = j.y LEFT JOIN f v ON v.frame_idx = b AND v.x = j.x AND v.y = j.y""",
)
def needed_frame_scan(spark, sf_dir):
    """All frames are written to a frame store; the events of one week that are of interest read theirs only, a tenth of the frames."""
    rows = lens.events(spark, sf_dir)
    store, _, _ = _stored_frames(spark, sf_dir)
    bright = rows.where((F.col("p") == 1) & (F.col("value") > 100) & (F.col("t") >= lens.ORIGIN + _WEEK) & (F.col("t") < lens.ORIGIN + 2 * _WEEK)).select("t", "x", "y")
    near = asof.asof_bracket(bright, sources.frame_times(spark, store))
    near = near.select("t", "x", "y", F.col("prev.frame_idx").alias("prev_frame"), F.col("next.frame_idx").alias("next_frame"))
    wanted = near.select(F.explode(F.array("prev_frame", "next_frame")).alias("frame_idx"))
    lums = sources.pixel_rows(sources.frames_at(wanted, store))
    for side in ("prev", "next"):
        own = lums.select(F.col("frame_idx").alias(f"{side}_frame"), "x", "y", F.col("lum").alias(f"{side}_lum"))
        near = near.join(own, [f"{side}_frame", "x", "y"])
    return near.select("t", "x", "y", "prev_frame", "next_frame", "prev_lum", "next_lum")


@_query("live_replay", f"{E} SELECT 'c' || (x % 4) AS camera, t, x, y, p, row_number() OVER (PARTITION BY x % 4 ORDER BY t, x, y, p) - 1 AS record FROM e")
def live_replay(spark, sf_dir):
    """The events as logs of four cameras, played back by the live source in batches of 8,000 at most, by streams side by side."""
    logs, out = scratch(spark), scratch(spark)
    rows = lens.events(spark, sf_dir).withColumn("camera", F.concat(F.lit("c"), (F.col("x") % 4).cast("string")))
    live.write_logs(rows, logs)
    return live.play_back(spark, logs, out, 8000)


@_query("asof_keyed", f"{EF} SELECT e.t, e.x, e.y, e.p, f.frame_idx AS frame_idx, f.lum AS lum FROM e ASOF LEFT JOIN f ON e.x = f.x AND e.y = f.y AND e.t >= f.t")
def asof_keyed(spark, sf_dir):
    """Each event with its own pixel's last frame row: a dimension as large as the fact, keyed by pixel."""
    out = asof.asof_union(lens.events(spark, sf_dir).select("t", "x", "y", "p"), lens.pixels(spark, sf_dir), ["x", "y"])
    return out.select("t", "x", "y", "p", F.col("prev.frame_idx").alias("frame_idx"), F.col("prev.lum").alias("lum"))


@_query("validity_observed", SQL["validity_report"])
def validity_observed(spark, sf_dir):
    """The counts of validity_report, seen by the pass that writes the events' intervals."""
    rows, seen = frames.observed_validity(lens.events(spark, sf_dir), 16, 5)
    intervals.intervals(rows.select("t", "x", "y", "p")).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([seen.get], "events long, bad_time long, out_of_frame long, bad_polarity long")


@_query("session_scan", f"{E} SELECT 's' || (x % 3) AS session, count(*) AS n, min(t) AS first_t, max(t) AS last_t, sum(p)::BIGINT AS on_events FROM e WHERE t < {lens.ORIGIN + 10 * lens.DAY} GROUP BY 1")
def session_scan(spark, sf_dir):
    """The events as a folder of sessions, scanned by row groups: two columns, the first ten days."""
    folder = scratch(spark)
    rows = lens.events(spark, sf_dir).select(F.concat(F.lit("s"), (F.col("x") % 3).cast("string")).alias("part"), "t", "x", "y", "p", F.col("value").alias("prev_lum"), F.col("value").alias("next_lum"), F.lit(5).cast("long").alias("frame_dt"))
    for name in ("s0", "s1", "s2"):
        rows.where(F.col("part") == name).drop("part").orderBy("t").write.option("parquet.block.size", 1 << 15).option("parquet.page.row.count.limit", 500).parquet(f"{folder}/{name}")
    found = sources.scan_sessions(spark, folder, columns=["t", "p"], times=(None, lens.ORIGIN + 10 * lens.DAY - 1))
    return found.groupBy("session").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.sum("p").alias("on_events"))


def _summary_step(state, batch):
    t, p = batch.column("t").to_numpy(), batch.column("p").to_numpy()
    n, first, last, on = state
    return n + len(t), min(first, int(t.min())), max(last, int(t.max())), on + int(p.sum())


@_query("session_fold", f"{E} SELECT x AS session, count(*) AS n, min(t) AS first_t, max(t) AS last_t, sum(p)::BIGINT AS on_events FROM e GROUP BY x")
def session_fold(spark, sf_dir):
    rows = lens.events(spark, sf_dir).select(F.col("x").alias("session"), "t", "p")
    out = sources.fold_sessions(rows, lambda: (0, 1 << 62, -(1 << 62), 0), _summary_step, lambda s: {"n": [s[0]], "first_t": [s[1]], "last_t": [s[2]], "on_events": [s[3]]}, "n long, first_t long, last_t long, on_events long")
    return out.where("error is null").select("session", "n", "first_t", "last_t", "on_events")


@_query("fit_table_round_trip", SQL["bucket_fit"])
def fit_table_round_trip(spark, sf_dir):
    """Bucket fits written as CSV with the other tools' column names, and read back."""
    path = scratch(spark)
    names = {v: k for k, v in sources.FIT_NAMES.items()}
    sources.write_table(_fits(spark, sf_dir).withColumnsRenamed(names), path, "csv")
    return rounded(sources.read_fits(spark, path), mean_min=6, mean_max=6, diff_min=6, diff_max=6, mu_hat=5, lambda_hat=5, mu=7, sigma=6)


@_query("event_text_round_trip", f"{E} SELECT t, x, y, p FROM e WHERE t >= 0")
def event_text_round_trip(spark, sf_dir):
    """The events as text in ordered parts, read by the manifest."""
    path = scratch(spark) + ".txt"
    sources.write_event_text(lens.events(spark, sf_dir).where("t >= 0"), path)
    return sources.read_events(spark, path)


def _brightest(image):
    """A detector: the brightest pixel (the first of equal ones) as tag 0 with the corners of its square; a dark frame has none."""
    at = int(image.argmax())
    if image.flat[at] < 2500:
        return []
    x, y = at % image.shape[1], at // image.shape[1]
    return [(0, [(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1)])]


def _stored_frames(spark, sf_dir):
    """(folder, height, width) of all frames of lens.pixels, luminances times ten, in a frame store."""
    height, width, store = lens.events(spark, sf_dir).agg(F.max("y") + 1).first()[0], 16, scratch(spark)
    pixels = lens.pixels(spark, sf_dir).withColumn("lum", F.floor(F.col("lum") * 10))
    sources.write_frames(sources.packed_frames(pixels, height, width), store, height, width)
    return store, height, width


@_query(
    "detected_tags",
    f"""{EF}, m AS (SELECT t, arg_min({{'x': x, 'y': y}}, -floor(lum * 10) * 1000000 + y * 16 + x) AS a, max(floor(lum * 10)) AS lum FROM f GROUP BY t)
SELECT t, CASE WHEN lum >= 2500 THEN 0 END AS tag_id, CASE WHEN lum >= 2500 THEN a.x::DOUBLE END AS "left", CASE WHEN lum >= 2500 THEN a.y::DOUBLE END AS top, CASE WHEN lum >= 2500 THEN a.x + 1.0::DOUBLE END AS "right", CASE WHEN lum >= 2500 THEN a.y + 1.0::DOUBLE END AS bottom FROM m""",
)
def detected_tags(spark, sf_dir):
    """A detector plugged in over all frames of the store."""
    store, _, _ = _stored_frames(spark, sf_dir)
    found = sources.detect(sources.read_frames(spark, store), _brightest)
    corner = lambda i: F.get("corners", F.lit(i))
    return found.select("t", "tag_id", corner(0).x.alias("left"), corner(0).y.alias("top"), corner(2).x.alias("right"), corner(2).y.alias("bottom"))


@_query("frames_by_time", f"{EF} SELECT frame_idx, t, x, y, floor(lum * 10)::INT AS lum FROM f WHERE t >= {lens.ORIGIN + 3 * lens.DAY} AND t <= {lens.ORIGIN + 5 * lens.DAY} AND floor(lum * 10) > 0")
def frames_by_time(spark, sf_dir):
    """The frames of two days from one headerless file, found through the records of its metadata file.

    The file is the store's parts in a row; a metadata record is 38 bytes, so a store of 1 x 19 pixels of 16 bits holds them.
    """
    store, height, width = _stored_frames(spark, sf_dir)
    frames_file, metadata_file, records = f"{store}/all.dat", f"{store}/metadata.dat", scratch(spark)
    times = sources.frame_times(spark, store)
    # the file counts its frames from 0, the store by number
    numbered = ordered.numbered(times.select("frame_idx", "t"), "frame_idx", "place").withColumn("place", (F.col("place") - 1).cast("int"))

    def pack(batches):
        for batch in batches:
            rows = np.zeros(batch.num_rows, np.dtype([("s", "<f8"), ("r", "S30")]))
            rows["s"], rows["r"] = batch.column(1).to_numpy(), b"2024-01-01 00:00:00.000000"
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([1] * n, pa.int32()), pa.array([19] * n, pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], names=["frame_idx", "height", "width", "px"])

    packed = numbered.select("place", F.col("t").cast("double")).mapInArrow(pack, "frame_idx int, height int, width int, px binary")
    sources.write_frames(packed, records, 1, 19)
    sinks.join_parts(store, frames_file, ".dat")
    sinks.join_parts(records, metadata_file, ".dat")
    got = sources.read_frames(spark, frames_file, height, width, times=(lens.ORIGIN + 3 * lens.DAY, lens.ORIGIN + 5 * lens.DAY), metadata=metadata_file, ordered=True)
    lums = sources.pixel_rows(got).where("lum > 0").withColumnRenamed("frame_idx", "place")
    return lums.join(numbered, "place").select("frame_idx", "t", "x", "y", "lum")


@_query(
    "rgb_frame_scan",
    """WITH o AS (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS v FROM orders), c AS (SELECT o_orderkey, v % 256 AS r, (v // 256) % 256 AS g, v % 251 AS b, v % 7 AS a FROM o)
SELECT o_orderkey::INT AS frame_idx, r::INT AS c0, g::INT AS c1, b::INT AS c2, a::INT AS c3, round(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b)::INT AS gray FROM c WHERE o_orderkey >= 50""",
)
def rgb_frame_scan(spark, sf_dir):
    """Orders as frames of one pixel with four channels: written, pruned by number, unpacked, turned gray."""
    store, v = scratch(spark), F.floor("o_totalprice").cast("long")
    byte = lambda c: F.lpad(F.hex(c), 2, "0")
    px = F.unhex(F.concat(byte(v % 256), byte(F.floor(v / 256) % 256), byte(v % 251), byte(v % 7)))
    rows = lens.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("int").alias("frame_idx"), F.lit(1).alias("height"), F.lit(1).alias("width"), px.alias("px"))
    sources.write_frames(rows, store, 1, 1, 4)
    pixels = sources.pixel_rows(sources.read_frames(spark, store, frames=(50, None)), 4)
    return pixels.select("frame_idx", "c0", "c1", "c2", "c3", P.gray(F.col("c0"), F.col("c1"), F.col("c2")).alias("gray"))


@_query("recorded_timestamps", f"{EF} SELECT DISTINCT t FROM f WHERE frame_idx < 60")
def recorded_timestamps(spark, sf_dir):
    """The recorder over a stream of the frames, and the times that its metadata has."""
    source, out = scratch(spark), scratch(spark)
    store, _, _ = _stored_frames(spark, sf_dir)
    rows = sources.read_frames(spark, store).select("frame_idx", F.col("t").cast("double").alias("sensor_ts"), "height", "width", "px")
    rows.write.parquet(source)
    query = sources.record(spark.readStream.schema(rows.schema).parquet(source), out, f"{out}-checkpoint", most=60)
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    metadata = spark.read.option("header", True).option("inferSchema", True).csv(f"{out}/metadata/batch=*")
    return sources.timestamps(metadata)


@_query("video_times", f"{EF} SELECT DISTINCT frame_idx, frame_idx::BIGINT * 33333 AS t FROM f")
def video_times(spark, sf_dir):
    return lens.pixels(spark, sf_dir).select("frame_idx").distinct().withColumn("t", P.video_time(F.col("frame_idx"), 30.0))


_ODD = ", ".join(str(float(i)) for i in range(101, 1, -2))


def _normal_sql(z: str) -> str:
    return f"CASE WHEN {z} > 6 THEN 1 WHEN {z} < -6 THEN 0 ELSE 0.5 + exp(-{z} * {z} / 2) / sqrt(2 * pi()) * {z} * list_reduce([1.0::DOUBLE, {_ODD}], lambda a, b: 1 + {z} * {z} / b * a) END"


@_query(
    "ig_interval",
    f"""{E}, v AS (SELECT t, x, y, value / 100 AS s, value / 100 + 0.5 AS u FROM e), z AS (SELECT t, x, y, sqrt(5 / s) * (s / 2 - 1) AS s1, -sqrt(5 / s) * (s / 2 + 1) AS s2, sqrt(5 / u) * (u / 2 - 1) AS u1, -sqrt(5 / u) * (u / 2 + 1) AS u2 FROM v)
SELECT t, x, y, round({_normal_sql('u1')} + exp(5) * ({_normal_sql('u2')}) - ({_normal_sql('s1')} + exp(5) * ({_normal_sql('s2')})), 5) AS probability FROM z""",
)
def ig_interval(spark, sf_dir):
    """Probability that an inverse Gaussian passage (mean 2, shape 5) falls into the half second after each event's value."""
    start = F.col("value") / 100
    value = P.inverse_gaussian_interval(start, start + 0.5, F.lit(2.0), F.lit(5.0))
    return rounded(lens.events(spark, sf_dir).select("t", "x", "y", value.alias("probability")), probability=5)
