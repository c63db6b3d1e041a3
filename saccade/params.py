"""Sensor parameters: immutable presets of k1 to k6 per camera type."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Sensor:
    k1: float
    k2: float
    k3: float
    k4: float
    k5: float
    k6: float


# fixed values: k1 to k6 of the supported camera types
PRESETS = {
    "DVS346": Sensor(0.00018 * 29250, 20, 0.0001, 1e-7, 5e-9, 0.00001),
    "DVS240": Sensor(0.000094 * 47065, 23, 0.0002, 1e-7, 5e-8, 0.00001),
    "Raw2DVS346": Sensor(2.388, 4.166e-7, 1.541e-6, 9.768e-8, 1.466e-11, 9.824e-6),
    "RGB2DVS346": Sensor(5.332474147628972, 0.9003332027266823, 8.288263352543993e-06, 1.0992397172828087e-07, 3.302652963977818e-09, 1.1012444038716504e-07),
}


def preset(camera: str) -> Sensor:
    """Parameters of a camera type; an unknown type is an error."""
    if camera not in PRESETS:
        raise KeyError(f"unknown camera type {camera!r}; known: {', '.join(PRESETS)}")
    return PRESETS[camera]


def preset_table(spark: SparkSession) -> DataFrame:
    rows = [(name, *map(float, vars(s).values())) for name, s in PRESETS.items()]
    return spark.createDataFrame(rows, "camera string, k1 double, k2 double, k3 double, k4 double, k5 double, k6 double")
