"""Fixed values the results depend on: weights, thresholds, word lists, labels.

Everything in this module is data. Changing an entry changes the output.
"""

from datetime import date

# --- Fixed values: scoring -------------------------------------------------
SIGNAL_WEIGHTS = {
    "usage_decline_score": 0.25,
    "support_health_score": 0.20,
    "nps_risk_score": 0.15,
    "sdk_risk_score": 0.15,
    "csm_sentiment_score": 0.15,
    "renewal_urgency_score": 0.10,
}
HIGH_AT = 0.60
MEDIUM_AT = 0.35
NEUTRAL_SENTIMENT = 0.5
BOOST_OPEN_P1 = (0.10, "Open P1 tickets")
BOOST_SILENT = (0.10, "Silent churn pattern (high NPS + declining usage)")
BOOST_SUNSET = (0.08, "SDK v3.x sunset critical — must migrate now")

# --- Fixed values: features ------------------------------------------------
PRIORITY_WEIGHTS = {"P1": 4.0, "P2": 2.0, "P3": 1.0, "P4": 0.5}
STATUS_WEIGHTS = {"Open": 2.0, "Escalated": 2.5, "Resolved": 0.2}
UNLISTED_WEIGHT = 1.0
OPEN_STATUSES = ("Open", "Escalated")
TICKET_SATURATION = 30.0
TICKET_MONTHS = 6
RENEWAL_DAYS = 90
MISSING_USAGE_RISK = 0.3
MISSING_SUPPORT_RISK = 0.0
MISSING_NPS_RISK = 0.5
SILENT_MIN_NPS = 7
SILENT_MIN_DECLINE = 0.5

# --- Fixed values: SDK policy (match kind, pattern, score, label, sunset) ---
SDK_POLICY = [
    ("prefix", "v3", 1.0, "SDK v3.x (SUNSET)", date(2026, 4, 30)),
    ("exact", "v4.0.0", 0.6, "SDK v4.0/v4.1", None),
    ("exact", "v4.1.0", 0.6, "SDK v4.0/v4.1", None),
    ("exact", "v4.2.0", 0.15, "SDK v4.2.x", None),
    ("exact", "v4.2.3", 0.15, "SDK v4.2.x", None),
    ("prefix", "v4.3", 0.0, "SDK v4.3.x", None),
]
SDK_EMPTY_RISK = 0.3
SDK_UNLISTED_RISK = 0.2
SDK_FACTS = {
    "sdk_v3_sunset_date": "2026-04-30",
    "sdk_v3_security_patches_end": "2026-04-30",
    "legacy_editor_removal_version": "v4.4.0",
    "legacy_editor_removal_expected": "May 2026",
    "breaking_change_sdk_v420": "true",
    "breaking_change_affected_below": "v4.2.0",
    "locale_fix_version": "v4.2.3",
    "locale_fix_affects": "v4.0.0,v4.1.0",
}
# lower bound of the two-digit score -> label, highest first
SDK_SCORE_LABELS = [
    (0.99, "SDK v3.x (SUNSET)"),
    (0.59, "SDK v4.0/v4.1"),
    (0.14, "SDK v4.2.x"),
    (-0.01, "SDK v4.3.x"),
]

# --- Fixed values: signal labels --------------------------------------------
TOP_SIGNAL_LABELS = {
    "usage_decline_score": "📉 Declining usage",
    "support_health_score": "🎫 Support ticket burden",
    "nps_risk_score": "😟 Low/concerning NPS",
    "sdk_risk_score": "⚠️ SDK deprecation risk",
    "csm_sentiment_score": "🗣️ Negative CSM sentiment",
    "renewal_urgency_score": "⏰ Renewal urgency",
}
BAR_LABELS = {
    "usage_decline_score": "Usage Decline Trend",
    "support_health_score": "Support Ticket Burden",
    "nps_risk_score": "NPS Score Risk",
    "sdk_risk_score": "Sunset SDK Version Risk",
    "csm_sentiment_score": "CSM Notes Sentiment",
    "renewal_urgency_score": "Contract Renewal Urgency",
}

# --- Fixed values: note keywords (keyword -> flag), in reporting order -------
COMPETITORS = ["hygraph", "contentful", "kontent.ai", "sanity", "strapi",
               "builder.io", "wordpress", "drupal"]
NEGATIVE_KEYWORDS = {
    "evaluating alternatives": "Actively evaluating competitor CMS",
    "competitor": "Competitor mention",
    "no show": "No-show on CSM calls — disengagement signal",
    "churn": "Churn explicitly mentioned",
    "cancel": "Cancellation language used",
    "angry": "Customer expressed anger",
    "furious": "Billing/product dispute causing customer fury",
    "escalate": "Escalation requested",
    "walk": "Threatened to walk",
    "discount": "Discount demanded — pricing sensitivity",
    "budget cut": "Budget reduction communicated",
    "downgrade": "Downgrade risk mentioned",
    "poc": "Proof of concept with competitor underway",
    "lost faith": "Champion lost faith in product/roadmap",
    "acquiring": "M&A activity — vendor contracts under review",
}
POSITIVE_KEYWORDS = {
    "expand": "Expansion plans discussed",
    "upgrade": "Upgrade interest expressed",
    "budget approved": "Budget for renewal approved",
    "champagne": "Strong renewal / expansion confirmed",
    "locked in": "Renewal locked in",
    "2-year": "Multi-year extension discussed",
    "love": "Strong product satisfaction expressed",
    "great qbr": "Positive QBR outcome",
    "adding seats": "Seat expansion in progress",
}
EXECUTIVE_KEYWORDS = ["vp ", "cto", "cro", "ciso", "coo", "cfo", "executive", "president"]
KEYWORD_TOTAL = 24
MAX_FLAGS = 5
MAX_POSITIVES = 3

# --- Fixed values: note dates and name matching -------------------------------
MONTH_NUMBERS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6,
    "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
    "january": 1, "february": 2, "march": 3, "april": 4, "june": 6, "july": 7,
    "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
}
DEFAULT_NOTE_YEAR = 2026
SIMILARITY_CUTOFF = 55.0

# --- Fixed values: report ------------------------------------------------------
PLACEHOLDER_FRAGMENTS = [
    "narrative generation failed",
    "Review account signals manually",
    "Risk data computed but",
]
EXPORT_COLUMNS = [
    "account_name", "arr", "contract_end_date", "risk_score", "risk_tier",
    "plan_tier", "industry", "region", "csm_name", "nps_score",
    "latest_sdk_version", "p1_open_count", "silent_churn_flag",
    "days_to_renewal", "narrative_summary",
]
BRIEFING_NOTE_CHARS = 1500
PORTFOLIO_PREVIEW_ROWS = 20
