"""Calibration read from JSON.

A signal that the file leaves out has means of 0 and deviations of 0.01, as has a pattern with
probabilities of 0.01; the whole file counts only if three signals at least have both deviations above
0.01, else the defaults hold. A temperature under 0.1 means the default. Each section is read by its
own name.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import constants as C

SCHEMA = """
version int, temperature double,
signals map<string, struct<mu_ai: double, sigma_ai: double, mu_h: double, sigma_h: double>>,
binary map<string, struct<p_ai: double, p_h: double>>,
patterns map<string, struct<p_ai: double, p_h: double>>
"""


@dataclass(frozen=True)
class Calibration:
    gaussian: dict[str, tuple[float, float, float, float]] = field(default_factory=lambda: dict(C.GAUSSIAN))
    binary: dict[str, tuple[float, float]] = field(default_factory=lambda: dict(C.BINARY))
    temperature: float = C.TEMPERATURE
    loaded: bool = False

    @property
    def limit(self) -> float:
        return C.CLAMP if self.loaded else C.CLAMP_UNCALIBRATED


def parse(texts: DataFrame) -> DataFrame:
    """value (JSON) -> its fields; null fields where the JSON has none."""
    return texts.select(F.from_json("value", SCHEMA).alias("c")).select("c.*")


def calibration(parsed: DataFrame) -> Calibration:
    """The calibration in the first row; the table has one, so this reads one small row."""
    row = parsed.first()
    if row is None:
        return Calibration()
    signals, patterns = row.signals or {}, row.binary or row.patterns or {}
    gaussian = {}
    valid = 0
    for name in C.GAUSSIAN:
        s = signals.get(name)
        mu_a, dev_a, mu_h, dev_h = ((s[k] or 0.0) for k in ("mu_ai", "sigma_ai", "mu_h", "sigma_h")) if s else (0.0,) * 4
        valid += dev_a > 0.01 and dev_h > 0.01
        gaussian[name] = (mu_a, max(dev_a, 0.01), mu_h, max(dev_h, 0.01))
    if valid < 3:
        return Calibration()
    binary = {}
    for name in C.BINARY:
        s = patterns.get(name)
        p, q = ((s["p_ai"] or 0.0), (s["p_h"] or 0.0)) if s else (0.0, 0.0)
        binary[name] = (min(max(p, 0.01), 0.99), min(max(q, 0.01), 0.99))
    heat = row.temperature or 0.0
    return Calibration(gaussian, binary, C.TEMPERATURE if heat < 0.1 else heat, True)


def load(spark: SparkSession, path: str) -> Calibration:
    return calibration(parse(spark.read.text(path, wholetext=True)))


def as_table(spark: SparkSession, c: Calibration) -> DataFrame:
    """Parameters as rows, for reports."""
    rows = [(k, *map(float, v)) for k, v in c.gaussian.items()] + [(k, float(p), None, float(q), None) for k, (p, q) in c.binary.items()]
    return spark.createDataFrame(rows, "signal string, mu_ai double, sigma_ai double, mu_h double, sigma_h double")


def bounds_table(spark: SparkSession, c: Calibration, threshold: float) -> DataFrame:
    """What else a report's method depends on, by name."""
    rows = [("temperature", float(c.temperature)), ("clamp of a signal", float(c.limit)), ("calibrated", float(c.loaded)), ("duplicate distance", float(threshold))]
    return spark.createDataFrame(rows, "setting string, value double")
