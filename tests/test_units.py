"""Every flow unit of the survey is known."""

import pytest
from pyspark.sql import functions as F

from fleetgauge.functions import units

GAS = {"nl/min": 6.0, "nl/h": 0.1, "nml/min": 0.006, "sccm": 0.006, "slm": 6.0, "sl/min": 6.0, "nm3/h": 100.0, "nm3/min": 6000.0, "ml/min": None}
LIQUID = {"m3/h": 6.0, "m³/h": 6.0, "m3/min": 360.0, "m³/min": 360.0, "l/min": 0.36, "l/h": 0.006, "gpm": 1.36275, "gph": 0.0227125}


@pytest.mark.parametrize("table, expected", [(units.GAS_NL_MIN, GAS), (units.LIQUID_M3H, LIQUID)])
def test_flow_units(spark, table, expected):
    df = spark.createDataFrame([(6.0, u) for u in expected], "v double, u string")
    got = {r["u"]: r["x"] for r in df.select("u", units.by_factor(F.col("v"), F.col("u"), table).alias("x")).collect()}
    assert got == {u: None if x is None else pytest.approx(x) for u, x in expected.items()}
