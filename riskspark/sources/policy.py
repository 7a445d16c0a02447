"""SDK support policy as a small dimension table."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark import schemas
from riskspark.functions.values import SDK_EMPTY_RISK, SDK_FACTS, SDK_POLICY, SDK_UNLISTED_RISK


def sdk_policy_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SDK_POLICY, schemas.SDK_POLICY)


def sdk_facts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SDK_FACTS.items()), "fact string, value string")


def apply_sdk_policy(versions: DataFrame, policy: DataFrame | None = None) -> DataFrame:
    """Policy score and label per distinct version; the policy has a handful of fixed rows."""
    policy = policy if policy is not None else sdk_policy_table(versions.sparkSession)
    v = F.lower(F.regexp_replace("sdk_version", r"(?U)^\s+|\s+$", ""))
    # every pattern a version can match, so that the lookup is an equi-join
    patterns = F.array_append(
        F.transform(F.sequence(F.lit(1), F.greatest(F.length("_v"), F.lit(1))),
                    lambda n: F.struct(F.lit("prefix").alias("match_kind"), F.substring("_v", F.lit(1), n).alias("pattern"))),
        F.struct(F.lit("exact").alias("match_kind"), F.col("_v").alias("pattern")))
    matched = (
        versions.select("sdk_version").distinct().withColumn("_v", v)
        .select("sdk_version", F.inline_outer(patterns))
        .join(policy.withColumn("_n", F.length("pattern")), ["match_kind", "pattern"], "left")
        .groupBy("sdk_version")
        .agg(F.max_by(F.struct("score", "label", "sunset_date"), "_n").alias("p")))
    default = F.when(F.coalesce("sdk_version", F.lit("")) == "", SDK_EMPTY_RISK).otherwise(SDK_UNLISTED_RISK)
    return matched.select("sdk_version", F.coalesce("p.score", default).alias("sdk_risk_score"),
                          F.col("p.label").alias("policy_label"), F.col("p.sunset_date").alias("sunset_date"))
