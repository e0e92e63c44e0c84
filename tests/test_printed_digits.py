"""Printed numbers against C's formatter."""

import random

from pyspark.sql import functions as F

from kinweave.sources import sinks


def test_printed_digits(spark):
    """Halves go to the even digit and decimals that aren't exact to their exact value's side, as C prints them."""
    r = random.Random(3)
    values = [0.0, -0.5, 0.3828125, 0.4765625, 0.0078125, 0.1234565, 123456789.25, 0.25, 0.05, 2.5, *(r.gauss(0, 50) for _ in range(500)), *(round(r.random(), 7) for _ in range(500)), *(r.randrange(-999, 9999) / 256 for _ in range(500))]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", *(sinks.fixed("v", d).alias(f"d{d}") for d in (0, 1, 6))).collect()
    assert [tuple(r) for r in rows] == [(v, f"{v:.0f}", f"{v:.1f}", f"{v:.6f}") for v in values]
    assert spark.sql("SELECT CAST(NULL AS DOUBLE) v UNION ALL SELECT double('NaN')").select(sinks.fixed("v", 6).alias("x")).filter(F.col("x").isNotNull()).count() >= 1
