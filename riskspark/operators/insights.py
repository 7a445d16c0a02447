"""Portfolio insights: who is affected (one row per account) and what it adds up to."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.functions.risk import on_sunset_sdk
from riskspark.functions.text import money_full

ACTIONABLE = ("High", "Medium")
INSIGHTS = ["sunset_renewal", "silent_cluster", "csm_concentration", "enterprise_detractors"]


def actionable(accounts: DataFrame) -> DataFrame:
    return accounts.where(F.col("risk_tier").isin(*ACTIONABLE))


def high_only(accounts: DataFrame) -> DataFrame:
    return accounts.where(F.col("risk_tier") == "High")


def v3_renewing(accounts: DataFrame) -> DataFrame:
    return accounts.where(on_sunset_sdk(F.col("latest_sdk_version")))


def silent_rows(accounts: DataFrame) -> DataFrame:
    return accounts.where(F.coalesce("silent_churn_flag", F.lit(False)))


def enterprise_detractors(accounts: DataFrame) -> DataFrame:
    return accounts.where((F.col("plan_tier") == "Enterprise")
                          & (F.coalesce(F.col("nps_score"), F.lit(10.0)) <= 6))


def exposure(accounts: DataFrame) -> DataFrame:
    """Number of accounts and their ARR."""
    return accounts.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("arr"), F.lit(0)).alias("arr"))


def csm_load(accounts: DataFrame) -> DataFrame:
    """At-risk accounts and ARR per CSM."""
    return (actionable(accounts).where(F.col("csm_name").isNotNull())
            .groupBy("csm_name").agg(F.count(F.lit(1)).alias("n"), F.sum("arr").alias("arr")))


def csm_concentration(accounts: DataFrame) -> DataFrame:
    """The CSM with most at-risk accounts, the alphabetically first on ties."""
    return csm_load(accounts).orderBy(F.desc("n"), "csm_name").limit(1)


def csm_arr_leader(accounts: DataFrame) -> DataFrame:
    """The CSM with most at-risk ARR, which may be another one."""
    return csm_load(accounts).orderBy(F.desc("arr"), "csm_name").limit(1)


def csm_concentration_accounts(accounts: DataFrame) -> DataFrame:
    top = csm_concentration(accounts).select("csm_name")  # one row
    return actionable(accounts).join(F.broadcast(top), "csm_name")


def _conditions() -> dict[str, Column]:
    return {
        INSIGHTS[0]: on_sunset_sdk(F.col("latest_sdk_version")),
        INSIGHTS[1]: F.coalesce("silent_churn_flag", F.lit(False)),
        INSIGHTS[2]: F.col("risk_tier").isin(*ACTIONABLE) & F.col("csm_name").isNotNull(),
        INSIGHTS[3]: F.coalesce((F.col("plan_tier") == "Enterprise")
                                & (F.coalesce(F.col("nps_score"), F.lit(10.0)) <= 6), F.lit(False)),
    }


def insight_members(accounts: DataFrame) -> DataFrame:
    """(insight_code, account_id, account_name, arr): as many rows as there are affected accounts."""
    top = csm_concentration(accounts).select("csm_name", F.lit(True).alias("_top"))  # one row
    conditions = _conditions()
    conditions[INSIGHTS[2]] = conditions[INSIGHTS[2]] & F.coalesce("_top", F.lit(False))
    codes = F.array_compact(F.array(*[F.when(cond, code) for code, cond in conditions.items()]))
    return (accounts.join(F.broadcast(top), "csm_name", "left")
            .select(F.explode(codes).alias("insight_code"), "account_id", "account_name", "arr"))


def tier_totals(accounts: DataFrame) -> DataFrame:
    """One row: counts and ARR overall, per tier and of silent accounts."""
    tier = lambda name: F.col("risk_tier") == name
    arr_of = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("arr"))), F.lit(0))
    return accounts.agg(
        F.count(F.lit(1)).alias("total_renewing"),
        F.coalesce(F.sum("arr"), F.lit(0)).alias("total_arr_at_risk"),
        *[F.count_if(tier(t)).alias(f"{t.lower()}_risk_count") for t in ("High", "Medium", "Low")],
        *[arr_of(tier(t)).alias(f"{t.lower()}_arr") for t in ("High", "Medium", "Low")],
        F.count_if(F.coalesce("silent_churn_flag", F.lit(False))).alias("silent_count"))


def _insight_text(code: Column) -> dict[str, Column]:
    n, arr, csm = F.col("n").cast("string"), money_full(F.col("arr")), F.coalesce("csm_name", F.lit(""))
    by_code = lambda a, b, c, d: (F.when(code == INSIGHTS[0], a).when(code == INSIGHTS[1], b)
                                  .when(code == INSIGHTS[2], c).otherwise(d))
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return {
        "title": by_code(F.lit("Forced SDK migration meets renewal"),
                         F.lit("Good surveys over falling usage"),
                         say("Most at-risk accounts sit with ", csm),
                         F.lit("Enterprise detractors")),
        "observation": by_code(
            say(n, " renewing account(s) worth ", arr, " still run a retired SDK"),
            say(n, " account(s) score 7 or more while usage falls"),
            say(csm, " owns ", n, " High or Medium accounts worth ", arr),
            say(n, " Enterprise account(s) worth ", arr, " scored 6 or less")),
        "why_non_obvious": by_code(
            F.lit("The version and the end date are each harmless; together they open an exit"),
            F.lit("A survey alone would rank these accounts as healthy"),
            F.lit("Each account looks manageable until one person has to save all of them"),
            F.lit("A lost reference customer costs more than its own contract")),
        "action": by_code(
            F.lit("Bundle a guided migration with the renewal"),
            F.lit("Audit usage instead of trusting the survey"),
            F.lit("Give this owner temporary support on the largest accounts"),
            F.lit("Bring in an executive sponsor")),
    }


def portfolio_insights(accounts: DataFrame) -> DataFrame:
    """Up to four rows (insight_code, n, arr, csm_name, texts); an insight nobody has is left out.

    One pass over the accounts: sums per CSM first, everything else from those few rows.
    """
    conditions = _conditions()
    per_csm = accounts.groupBy("csm_name").agg(
        *[F.count_if(cond).alias(f"n_{code}") for code, cond in conditions.items()],
        *[F.sum(F.when(cond, F.col("arr"))).alias(f"arr_{code}") for code, cond in conditions.items()])
    owner = INSIGHTS[2]
    totals = per_csm.agg(
        *[F.sum(f"{part}_{code}").alias(f"{part}_{code}") for code in INSIGHTS if code != owner for part in ("n", "arr")],
        F.min(F.when(F.col(f"n_{owner}") > 0, F.struct(
            (-F.col(f"n_{owner}")).alias("neg"), "csm_name", F.col(f"arr_{owner}").alias("arr")))).alias("_top"))
    no_csm = F.lit(None).cast("string")
    row = lambda code: (
        F.struct(F.lit(code).alias("insight_code"), (-F.col("_top.neg")).alias("n"), F.col("_top.arr").alias("arr"),
                 F.col("_top.csm_name").alias("csm_name")) if code == owner else
        F.struct(F.lit(code).alias("insight_code"), F.col(f"n_{code}").alias("n"), F.col(f"arr_{code}").alias("arr"),
                 no_csm.alias("csm_name")))
    rows = totals.select(F.inline(F.array(*[row(code) for code in INSIGHTS]))).where("n > 0")
    return rows.withColumns(_insight_text(F.col("insight_code")))


def executive_summary(accounts: DataFrame) -> DataFrame:
    totals = tier_totals(accounts)
    text = F.concat(
        F.col("total_renewing").cast("string"), F.lit(" accounts worth "), money_full(F.col("total_arr_at_risk")),
        F.lit(" renew in the window: "), F.col("high_risk_count").cast("string"), F.lit(" High ("),
        money_full(F.col("high_arr")), F.lit("), "), F.col("medium_risk_count").cast("string"),
        F.lit(" Medium ("), money_full(F.col("medium_arr")), F.lit(")."))
    return totals.withColumn("executive_summary", text)
