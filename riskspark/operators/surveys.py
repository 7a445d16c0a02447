"""Survey responses as features."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.functions.risk import nps_risk
from riskspark.functions.text import has_non_english


def nps_features(nps: DataFrame) -> DataFrame:
    return nps.where(F.col("account_id").isNotNull()).select(
        "account_id", F.col("score").alias("nps_score"), nps_risk(F.col("score")).alias("nps_risk_score"),
        "verbatim_comment", has_non_english(F.col("verbatim_comment")).alias("has_non_english"))
