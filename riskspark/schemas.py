"""Declared schemas; nothing is inferred from the data."""

from pyspark.sql import types as T


def _schema(*fields):
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


_S, _L, _D = T.StringType(), T.LongType(), T.DoubleType()

# As written in the files: dates and numbers that may be malformed are read as text first.
ACCOUNTS_FILE = _schema(
    ("account_id", _L), ("account_name", _S), ("arr", _L), ("contract_end_date", _S),
    ("plan_tier", _S), ("industry", _S), ("csm_name", _S), ("region", _S))
USAGE_FILE = _schema(
    ("account_id", _L), ("month", _S), ("api_calls", _L), ("content_entries_created", _L),
    ("active_users", _L), ("workflows_triggered", _L), ("sdk_version", _S))
NPS_FILE = _schema(("account_id", _L), ("score", _S), ("verbatim_comment", _S))
# The ticket file's columns are matched by header name, so only the used ones are declared.
TICKET_COLUMNS = ["account_id", "created_date", "priority", "status", "subject",
                  "resolution_time_hours"]

TICKETS = _schema(
    ("ticket_id", _L), ("account_id", _L), ("created_date", T.DateType()), ("priority", _S),
    ("status", _S), ("subject", _S), ("resolution_time_hours", _D))
NOTES = _schema(("note_pos", _L), ("raw_text", _S))
SDK_POLICY = _schema(
    ("match_kind", _S), ("pattern", _S), ("score", _D), ("label", _S), ("sunset_date", T.DateType()))

INSIGHT = _schema(
    ("title", _S), ("observation", _S), ("why_non_obvious", _S), ("action", _S),
    ("affected_accounts", T.ArrayType(_S)))
STORED_INSIGHT = _schema(
    ("insight_code", _S), ("n", _L), ("arr", _L), ("csm_name", _S), ("title", _S), ("observation", _S),
    ("why_non_obvious", _S), ("action", _S), ("affected_accounts", T.ArrayType(_S)), ("reference_date", _S))
PORTFOLIO = T.StructType([
    T.StructField("insights", T.ArrayType(INSIGHT)), T.StructField("executive_summary", _S)])
META = _schema(
    ("reference_date", _S), ("window_days", _L), ("generated_at", _S), ("total_renewing", _L),
    ("total_arr_at_risk", _L), ("high_risk_count", _L), ("medium_risk_count", _L),
    ("low_risk_count", _L))
SIGNAL = _schema(("raw_value", _D), ("weight", _D), ("contribution", _D))
_LIST = T.ArrayType(_S)
REPORT_ACCOUNT = _schema(
    ("account_id", _L), ("account_name", _S), ("arr", _L), ("contract_end_date", _S),
    ("plan_tier", _S), ("industry", _S), ("csm_name", _S), ("region", _S),
    ("api_calls_slope_risk", _D), ("active_users_slope_risk", _D), ("workflow_slope_risk", _D),
    ("usage_step_drop", _D), ("usage_decline_score", _D), ("latest_sdk_version", _S),
    ("avg_api_calls_6m", _D), ("latest_active_users", _D), ("avg_active_users", _D),
    ("api_calls_series", T.ArrayType(_schema(("month", _S), ("api_calls", _L)))),
    ("ticket_count_total", _D), ("p1_open_count", _D), ("avg_resolution_hours", _D),
    ("support_health_score", _D), ("open_ticket_count", _D), ("ticket_subjects", _LIST),
    ("nps_score", _D), ("nps_risk_score", _D), ("verbatim_comment", _S),
    ("has_non_english", T.BooleanType()), ("sdk_risk_score", _D), ("days_to_renewal", _L),
    ("renewal_urgency_score", _D), ("csm_notes_raw", _LIST), ("has_csm_notes", T.BooleanType()),
    ("silent_churn_flag", T.BooleanType()), ("csm_sentiment_score", _D), ("risk_score", _D),
    ("risk_tier", _S), ("base_score", _D), ("total_boost", _D),
    ("signal_breakdown", T.MapType(_S, SIGNAL)), ("boosters_applied", _LIST),
    ("risk_flags", _LIST), ("positive_signals", _LIST), ("key_stakeholder_concern", _S),
    ("csm_recommended_action", _S), ("english_translation", _S), ("detected_language", _S),
    ("nps_key_themes", _LIST), ("sentiment_alignment", _S), ("alignment_note", _S),
    ("narrative_summary", _S), ("narrative_risk_drivers", _LIST), ("narrative_actions", _LIST),
    ("narrative_urgency", _S))
REPORT = T.StructType([
    T.StructField("meta", META), T.StructField("portfolio_insights", PORTFOLIO),
    T.StructField("accounts", T.ArrayType(REPORT_ACCOUNT))])
