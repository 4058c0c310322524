"""Features of quarterly aggregates for the risk model, with stand-ins for what wasn't measured."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrowmill.functions import scalars as S

#: Fixed values of the model: what an unmeasured district counts as, and how many tests a quarter must have.
UNMEASURED = {"wqi": 50.0, "industry": 50.0, "density": 500.0}
LEAST_TESTS = 3

_RATE = "decimal(10,4)"


def with_changes(aggregates: DataFrame) -> DataFrame:
    """aggregates (district_id, state, commodity, quarter, fail_rate) with slope, state_rate, season and label.

    slope: the rate less that of the quarter before in the same district and commodity, null for the first or where a rate is
    missing. state_rate: the mean of the known rates of the state's districts, null without any. Rates are
    added as decimals, so sums don't depend on their order.
    """
    rate = F.col("fail_rate").cast(_RATE)
    before = F.lag(rate).over(Window.partitionBy("district_id", "commodity").orderBy("quarter"))
    peers = Window.partitionBy("state", "commodity", "quarter")
    mean = F.sum(rate).over(peers).cast("double") / F.count(rate).over(peers)
    return aggregates.withColumns({"slope": (rate - before).cast("double"), "state_rate": mean, "season": S.quarter_season(F.col("quarter")), "label": F.when(F.col("fail_rate") > 0, 1).otherwise(0)})


def imputed(rows: DataFrame) -> DataFrame:
    """rows with no gaps in their features: a missing slope is 0, a state's missing mean the own rate, a district's measures as UNMEASURED says; NaN counts as missing, and so does a measure whose column isn't there."""

    def known(name: str) -> Column:
        if name not in rows.columns:
            return F.lit(None).cast("double")
        value = F.col(name).cast("double")
        return F.when(~F.isnan(value), value)

    fills = {"slope": F.lit(0.0), "state_rate": F.col("fail_rate").cast("double")} | {k: F.lit(v) for k, v in UNMEASURED.items()}
    return rows.withColumns({name: F.coalesce(known(name), fill) for name, fill in fills.items()})


def training_features(aggregates: DataFrame, districts: DataFrame) -> DataFrame:
    """One row for each aggregate of enough tests in a known district: the features that a forest is fitted on.

    districts: district_id, state and those of wqi, industry and density that were measured; one row a district.
    """
    enough = aggregates.where(F.col("n_tests") >= LEAST_TESTS).join(districts, "district_id")
    full = imputed(with_changes(enough))
    return full.select("district_id", "commodity", "quarter", "state", "n_tests", "fail_rate", "slope", "state_rate", "season", *UNMEASURED, "label")
