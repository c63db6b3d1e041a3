"""Schemas of the relations the engine works on, and the check that a frame has them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])


_TYPES = {"TINYINT": T.ByteType(), "INT": T.IntegerType(), "BIGINT": T.LongType(), "DOUBLE": T.DoubleType(), "STRING": T.StringType(), "BINARY": T.BinaryType()}


def _fields(text: str) -> T.StructType:
    """A schema of flat columns; needs no session, unlike StructType.fromDDL."""
    pairs = (part.split() for part in text.split(", "))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


#: An event: microseconds, pixel, polarity 0 or 1.
EVENTS = _fields("t BIGINT, x INT, y INT, p TINYINT")
#: A packed frame: little-endian pixels, row-major.
FRAMES = _fields("frame_idx INT, height INT, width INT, px BINARY")
FRAMES_WITH_TIME = _fields("frame_idx INT, height INT, width INT, px BINARY, t BIGINT")
FRAME_TIMES = _fields("frame_idx INT, t BIGINT")
PIXELS = _fields("frame_idx INT, t BIGINT, x INT, y INT, lum DOUBLE")
METADATA = _fields("frame_idx INT, sensor_ts DOUBLE, real_ts STRING, real_us BIGINT")
BOXES = T.StructType([T.StructField("t", T.LongType()), T.StructField("polygon", T.ArrayType(_POINT)), T.StructField("angle", T.DoubleType()), T.StructField("center", _POINT)])
EVENTS_WITH_LUMINANCE = _fields("t BIGINT, x INT, y INT, p TINYINT, prev_lum DOUBLE, next_lum DOUBLE, frame_dt BIGINT")
FITS = _fields("p TINYINT, mean_min DOUBLE, mean_max DOUBLE, diff_min DOUBLE, diff_max DOUBLE, mu_hat DOUBLE, lambda_hat DOUBLE, mu DOUBLE, sigma DOUBLE, count BIGINT")


def require(df: DataFrame, *columns: str) -> DataFrame:
    """df, if it has all columns; a clear error at plan time otherwise."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
