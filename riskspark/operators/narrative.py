"""Explanation codes and texts of one account row."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.functions.text import keep, money_full, percent, sdk_score_label


def _num(name: str, default: float = 0.0) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(default))


def _facts() -> dict[str, Column]:
    # a sentiment risk of 0 counts as unknown
    sentiment = F.coalesce(F.nullif(F.col("csm_sentiment_score").cast("double"), F.lit(0.0)), F.lit(0.5))
    return {
        "decline": _num("usage_decline_score"), "p1": _num("p1_open_count"),
        "open": _num("open_ticket_count"), "sdk": _num("sdk_risk_score"),
        "silent": F.coalesce("silent_churn_flag", F.lit(False)), "sentiment": sentiment,
        "nps": F.col("nps_score").cast("double"), "days": F.col("days_to_renewal"),
    }


def driver_codes() -> Column:
    f = _facts()
    rules = [
        F.when(f["decline"] >= 0.7, "usage_severe").when(f["decline"] >= 0.4, "usage_moderate"),
        F.when(f["silent"], "silent_churn"),
        F.when(f["p1"] > 0, "open_p1").when(f["open"] > 0, "open_tickets"),
        F.when(f["sdk"] >= 1.0, "sdk_sunset").when(f["sdk"] >= 0.5, "sdk_upgrade"),
        F.when(f["nps"] <= 6, "detractor"),
        F.when(f["sentiment"] >= 0.7, "negative_notes"),
        F.when(f["days"] <= 30, "days_30"),
    ]
    codes = keep(*rules)
    return F.when(F.size(codes) > 0, codes).otherwise(F.array(F.lit("composite")))


def action_codes() -> Column:
    f = _facts()
    codes = keep(
        F.when(f["days"] <= 30, "escalate_now"), F.when(f["p1"] > 0, "resolve_p1"),
        F.when(f["sdk"] >= 1.0, "migration_session"), F.when(f["silent"], "executive_review"),
        F.when((f["decline"] >= 0.5) & ~f["silent"], "usage_audit"))
    return F.when(F.size(codes) > 0, codes).otherwise(F.array(F.lit("schedule_renewal")))


def summary_code() -> Column:
    f = _facts()
    return (F.when(f["silent"], "silent_churn").when(f["decline"] >= 0.5, "usage_decline")
            .when(f["p1"] > 0, "open_p1").otherwise("moderate"))


def urgency_code() -> Column:
    return F.when(F.col("days_to_renewal") <= 30, "immediate").otherwise("proactive")


def _texts(codes: Column, texts: dict[str, Column]) -> Column:
    """The text of each code, in code order."""
    def one(code: Column) -> Column:
        expr = None
        for name, text in texts.items():
            expr = F.when(code == name, text) if expr is None else expr.when(code == name, text)
        return expr
    return F.transform(codes, one)


def _line(*parts) -> Column:
    """Concatenate, showing missing values as `?`."""
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("?")) if isinstance(p, Column) else F.lit(p)
                      for p in parts])


def with_narrative(accounts: DataFrame) -> DataFrame:
    """Codes first (in scratch columns), then the texts from them: no UDF, no shuffle."""
    f = _facts()
    nps, days, p1 = F.col("nps_score").cast("int"), F.col("days_to_renewal"), F.col("p1_open_count").cast("int")
    opened, decline, label = F.col("open_ticket_count").cast("int"), percent(f["decline"]), sdk_score_label(f["sdk"])
    score = F.format_string("%.2f", F.col("risk_score"))
    drivers = {
        "usage_severe": _line("Usage fell steeply (decline risk ", decline, ")"),
        "usage_moderate": _line("Usage is sliding (decline risk ", decline, ")"),
        "silent_churn": _line("Survey score ", nps, "/10 hides a sharp fall in usage"),
        "open_p1": _line(p1, " critical ticket(s) still open"),
        "open_tickets": _line(opened, " ticket(s) still open"),
        "sdk_sunset": _line(label, " is out of support and forces a migration"),
        "sdk_upgrade": _line(label, " needs an upgrade"),
        "detractor": _line("Survey detractor with ", nps, "/10"),
        "negative_notes": F.lit("Recent call notes read negative"),
        "days_30": _line("Only ", days, " days of contract left"),
        "composite": _line("Several small signals add up to a risk of ", score),
    }
    actions = {
        "escalate_now": _line("Escalate today: ", days, " days to renewal"),
        "resolve_p1": _line("Close ", p1, " critical ticket(s) before talking about renewal"),
        "migration_session": _line("Offer a guided migration away from ", label),
        "executive_review": F.lit("Hold an executive review and look for a rival evaluation"),
        "usage_audit": F.lit("Audit usage with the technical team and offer onboarding"),
        "schedule_renewal": _line(F.col("csm_name"), " to arrange a renewal talk with ", F.col("account_name")),
    }
    branches = {
        "silent_churn": _line("The survey still looks fine at ", nps, "/10 while usage risk is ", decline, "."),
        "usage_decline": _line("Usage risk is ", decline, " with ", p1, " critical ticket(s) open."),
        "open_p1": _line(p1, " critical ticket(s) block the renewal talk."),
        "moderate": _line("No single signal stands out, but ", days, " days are short."),
    }
    lead = _line(F.col("account_name"), " is a ", F.col("risk_tier"), " renewal risk (", score, ") with ",
                 money_full(F.col("arr")), " due in ", days, " days.")
    branch = _texts(F.array(F.col("_summary")), branches)[0]
    note = _line("Contract ends ", F.col("contract_end_date"), ": ",
                 F.when(F.col("_urgency") == "immediate", "escalate immediately").otherwise("reach out now"))
    coded = accounts.withColumns({"_drivers": driver_codes(), "_actions": action_codes(),
                                  "_summary": summary_code(), "_urgency": urgency_code()})
    return coded.withColumns({
        "narrative_summary": F.concat_ws(" ", lead, branch),
        "narrative_risk_drivers": _texts(F.col("_drivers"), drivers),
        "narrative_actions": _texts(F.col("_actions"), actions),
        "narrative_urgency": note,
        "narrative_source": F.lit("rule_based"),
    }).drop("_drivers", "_actions", "_summary", "_urgency")
