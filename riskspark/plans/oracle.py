"""The same results in plain SQL for an independent engine, one statement per registered query."""

import re

from riskspark.functions.values import (
    COMPETITORS, EXECUTIVE_KEYWORDS, MAX_FLAGS, MAX_POSITIVES, NEGATIVE_KEYWORDS, POSITIVE_KEYWORDS,
    BAR_LABELS, TOP_SIGNAL_LABELS,
)
from riskspark.sources.standins import DUCKDB_DIALECT, VIEWS, view_sql

REF = "DATE '2001-08-01'"
WS = r"'^\s+|\s+$'"


def clip(x: str) -> str:
    return f"least(greatest({x}, 0e0), 1e0)"


def r6(x: str, name: str | None = None) -> str:
    return f"round({x}, 6) + 0e0 AS {name or x}"


def r6s(*names: str) -> str:
    return ", ".join(r6(n) for n in names)


def slope(y: str, name: str) -> str:
    return (f"CASE WHEN count(*) < 2 THEN 0e0 WHEN max({y}) = 0 OR avg({y}) = 0 THEN 0e0 "
            f"ELSE {clip(f'-4e0 * regr_slope({y}, pos) / avg({y})')} END AS {name}")


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def has(keyword: str) -> str:
    return f"contains(txt, '{keyword}')"


def listed(pairs, cap: int | None = None) -> str:
    """Texts of the true conditions joined by |, at most `cap` of them."""
    items = ", ".join(f"CASE WHEN {cond} THEN {value} END" for cond, value in pairs)
    kept = f"[x FOR x IN [{items}] IF x IS NOT NULL]"
    if cap:
        kept = f"list_slice({kept}, 1, {cap})"
    return f"coalesce(array_to_string({kept}, '|'), '')"


def count_true(conditions) -> str:
    return " + ".join(f"CAST({c} AS INT)" for c in conditions)


STEP_MID = "n // 2"
RIVALS = f"concat_ws(', ', {', '.join(f'CASE WHEN {has(k)} THEN {quoted([k])} END' for k in COMPETITORS)})"
NEGATIVE = [(has(k), f"concat('{v} (', CASE WHEN rivals = '' THEN 'unnamed' ELSE rivals END, ')')" if k == "competitor"
             else quoted([v])) for k, v in NEGATIVE_KEYWORDS.items()]
POSITIVE = [(has(k), quoted([v])) for k, v in POSITIVE_KEYWORDS.items()]
SIGNALS = ["usage_decline_score", "support_health_score", "nps_risk_score", "sdk_risk_score",
           "csm_sentiment_score", "renewal_urgency_score"]
WEIGHTS = ["0.25e0", "0.2e0", "0.15e0", "0.15e0", "0.15e0", "0.1e0"]


def base_sum(pairs) -> str:
    return "(" + " + ".join(["0e0"] + [f"{s} * {w}" for s, w in pairs]) + ")"


BOOST = ("(0e0 + CASE WHEN p1_open_count > 0 THEN 0.1e0 ELSE 0e0 END + CASE WHEN silent_churn_flag THEN 0.1e0 "
         "ELSE 0e0 END + CASE WHEN sdk_risk_score >= 1 THEN 0.08e0 ELSE 0e0 END)")


def score(source: str, pairs=tuple(zip(SIGNALS, WEIGHTS))) -> str:
    return f"""SELECT * EXCLUDE (b, o, s), round(s, 4) AS risk_score, round(b, 4) AS base_score, round(o, 4) AS total_boost,
      CASE WHEN s >= 0.6e0 THEN 'High' WHEN s >= 0.35e0 THEN 'Medium' ELSE 'Low' END AS risk_tier
    FROM (SELECT *, {clip('b + o')} AS s FROM (SELECT *, {base_sum(pairs)} AS b, {BOOST} AS o FROM {source}))"""


def sdk_case(v: str) -> str:
    t = f"lower(trim({v}))"
    return (f"CASE WHEN {v} IS NULL OR {v} = '' THEN 0.3e0 WHEN starts_with({t}, 'v3') THEN 1e0 "
            f"WHEN {t} IN ('v4.0.0', 'v4.1.0') THEN 0.6e0 WHEN {t} IN ('v4.2.0', 'v4.2.3') THEN 0.15e0 "
            f"WHEN starts_with({t}, 'v4.3') THEN 0e0 ELSE 0.2e0 END")


def nps_case(s: str) -> str:
    return (f"CASE WHEN {s} IS NULL THEN 0.5e0 WHEN {s} <= 6 THEN 1e0 - {s} / 12e0 WHEN {s} <= 8 "
            f"THEN 0.3e0 - ({s} - 7) * 0.1e0 ELSE greatest(0e0, 0.1e0 - ({s} - 9) * 0.05e0) END")


def foreign(t: str) -> str:
    return (f"coalesce(length({t}) > 0 AND length(regexp_replace({t}, '[\\x00-\\x7F]', '', 'g')) "
            f"/ CAST(greatest(length({t}), 1) AS DOUBLE) > 0.1e0, false)")


URGENCY = "CASE WHEN {d} <= 0 THEN 1e0 WHEN {d} <= 30 THEN 0.9e0 WHEN {d} <= 60 THEN 0.6e0 ELSE 0.3e0 END"
DAYS = f"date_diff('day', {REF}, contract_end_date)"
PRIORITY = "CASE priority WHEN 'P1' THEN 4e0 WHEN 'P2' THEN 2e0 WHEN 'P3' THEN 1e0 WHEN 'P4' THEN 0.5e0 ELSE 1e0 END"
STATUS = "CASE status WHEN 'Open' THEN 2e0 WHEN 'Escalated' THEN 2.5e0 WHEN 'Resolved' THEN 0.2e0 ELSE 1e0 END"

STEPS = {name: view_sql(name, DUCKDB_DIALECT) for name in VIEWS}
STEPS["upos"] = """SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY month) - 1 AS pos,
  count(*) OVER (PARTITION BY account_id) AS n FROM v_usage"""
STEPS["uslopes"] = f"""SELECT account_id, {slope('api_calls', 'api_calls_slope_risk')},
  {slope('active_users', 'active_users_slope_risk')}, {slope('workflows_triggered', 'workflow_slope_risk')},
  max_by(sdk_version, month) AS latest_sdk_version, avg(api_calls) AS avg_api_calls_6m,
  max_by(active_users, month) AS latest_active_users, avg(active_users) AS avg_active_users,
  avg(CASE WHEN pos < {STEP_MID} THEN api_calls END) AS early, avg(CASE WHEN pos >= {STEP_MID} THEN api_calls END) AS late
  FROM upos GROUP BY account_id"""
STEPS["ustep"] = f"""SELECT *, CASE WHEN early > 0 THEN {clip('2e0 * (early - late) / early')} ELSE 0e0 END AS usage_step_drop
  FROM uslopes"""
STEPS["uf"] = f"""SELECT * EXCLUDE (early, late), {clip('0.4e0 * api_calls_slope_risk + 0.3e0 * active_users_slope_risk + 0.15e0 * workflow_slope_risk + 0.5e0 * usage_step_drop')} AS usage_decline_score
  FROM ustep"""
STEPS["recent"] = f"SELECT * FROM v_tickets WHERE created_date >= {REF} - INTERVAL 6 MONTH"
STEPS["tf"] = f"""SELECT account_id, count(*) AS ticket_count_total,
  count(CASE WHEN priority = 'P1' AND status IN ('Open', 'Escalated') THEN 1 END) AS p1_open_count,
  count(CASE WHEN status IN ('Open', 'Escalated') THEN 1 END) AS open_ticket_count,
  round(avg(CASE WHEN status = 'Resolved' THEN resolution_time_hours END), 1) AS avg_resolution_hours,
  {clip(f'sum({PRIORITY} * {STATUS}) / 30e0')} AS support_health_score
  FROM recent GROUP BY account_id"""
STEPS["nf"] = f"""SELECT account_id, score AS nps_score, {nps_case('score')} AS nps_risk_score, verbatim_comment,
  {foreign('verbatim_comment')} AS has_non_english FROM v_nps"""
STEPS["joined"] = """SELECT a.*, uf.* EXCLUDE (account_id, usage_decline_score), tf.* EXCLUDE (account_id, ticket_count_total, p1_open_count, open_ticket_count, support_health_score),
  nf.* EXCLUDE (account_id, nps_risk_score), coalesce(usage_decline_score, 0.3e0) AS usage_decline_score,
  coalesce(ticket_count_total, 0) AS ticket_count_total, coalesce(p1_open_count, 0) AS p1_open_count,
  coalesce(open_ticket_count, 0) AS open_ticket_count, coalesce(support_health_score, 0e0) AS support_health_score,
  coalesce(nps_risk_score, 0.5e0) AS nps_risk_score, coalesce(notes, 0) > 0 AS has_csm_notes
  FROM v_accounts a LEFT JOIN uf USING (account_id) LEFT JOIN tf USING (account_id) LEFT JOIN nf USING (account_id)
  LEFT JOIN (SELECT account_id, count(*) AS notes FROM v_notes GROUP BY account_id) c USING (account_id)"""
STEPS["f"] = f"""SELECT *, {sdk_case('latest_sdk_version')} AS sdk_risk_score, {DAYS} AS days_to_renewal,
  {URGENCY.format(d=DAYS)} AS renewal_urgency_score, 0.5e0 AS csm_sentiment_score,
  coalesce(nps_score, 0) >= 7 AND usage_decline_score >= 0.5e0 AS silent_churn_flag FROM joined"""
STEPS["s"] = score("f")
STEPS["due"] = f"SELECT * FROM s WHERE contract_end_date BETWEEN {REF} AND {REF} + 90"
STEPS["txts"] = """SELECT account_id, lower(string_agg(raw_text, ' ' ORDER BY note_pos)) AS txt,
  string_agg(raw_text, chr(10) ORDER BY note_pos) AS lines FROM v_notes GROUP BY account_id"""
STEPS["rival"] = f"SELECT *, {RIVALS} AS rivals FROM txts"
STEPS["sig"] = f"""SELECT account_id, n_pos, n_neg, rivals, risk_flags, positive_signals, executive_keyword,
  round(1e0 - {clip('0.5e0 + (n_pos - n_neg) / 24e0')}, 4) AS csm_sentiment_score,
  CASE WHEN rivals <> '' THEN 'competitor' WHEN n_neg > 0 THEN 'risk' WHEN n_pos > 0 THEN 'positive' END AS action_code
  FROM (SELECT account_id, rivals, {count_true(c for c, _ in POSITIVE)} AS n_pos, {count_true(c for c, _ in NEGATIVE)} AS n_neg,
    {listed(NEGATIVE, MAX_FLAGS)} AS risk_flags, {listed(POSITIVE, MAX_POSITIVES)} AS positive_signals,
    CASE {' '.join(f"WHEN {has(k)} THEN '{k.strip()}'" for k in EXECUTIVE_KEYWORDS)} END AS executive_keyword FROM rival)"""
STEPS["resc_in"] = """SELECT due.* EXCLUDE (csm_sentiment_score, risk_score, base_score, total_boost, risk_tier),
  coalesce(sig.csm_sentiment_score, 0.5e0) AS csm_sentiment_score, coalesce(sig.risk_flags, '') AS flag_text
  FROM due LEFT JOIN sig USING (account_id)"""
STEPS["resc"] = score("resc_in")
STEPS["gap"] = """SELECT *, CASE account_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'Risk data computed but narrative generation failed' ELSE 'A real text' END AS narrative_summary,
  account_id % 2 = 0 AS flagged, CASE account_id % 8 WHEN 0 THEN 'translated' WHEN 4 THEN '' END AS english_translation,
  CASE account_id % 4 WHEN 0 THEN 'fr' WHEN 1 THEN 'English' WHEN 2 THEN '' END AS detected_language FROM due"""
STEPS["vers"] = """SELECT event_id, CASE CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 12 WHEN 0 THEN 'v4.3.0' WHEN 1 THEN 'v4.1.0'
  WHEN 2 THEN 'v4.2.3' WHEN 3 THEN 'v4.0.0' WHEN 4 THEN 'v3.2.0' WHEN 5 THEN ' V3.1.2 ' WHEN 6 THEN 'v4.2.0' WHEN 7 THEN 'v4.2.1'
  WHEN 8 THEN 'V4.3.9' WHEN 9 THEN 'v5.0' WHEN 10 THEN '' END AS version FROM events"""
STEPS["parts"] = "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT account_id, {i} AS ord, '{s}' AS signal, {s} AS raw, {w} AS weight, round({s} * {w}, 4) AS contribution FROM s"
    for i, (s, w) in enumerate(zip(SIGNALS, WEIGHTS))) + ")"


def label_case(table: dict[str, str]) -> str:
    return "CASE signal " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


V3 = "starts_with(coalesce(latest_sdk_version, ''), 'v3')"
DETRACTOR = "plan_tier = 'Enterprise' AND coalesce(nps_score, 10) <= 6"
RISKY = "risk_tier IN ('High', 'Medium')"
TOP_CSM = f"(SELECT csm_name FROM due WHERE {RISKY} GROUP BY csm_name ORDER BY count(*) DESC, csm_name LIMIT 1)"
BOOSTERS = listed([("p1_open_count > 0", "'Open P1 tickets'"),
                   ("silent_churn_flag", "'Silent churn pattern (high NPS + declining usage)'"),
                   ("sdk_risk_score >= 1", "'SDK v3.x sunset critical — must migrate now'")])
MONEY = lambda x: (f"CASE WHEN {x} >= 1000000 THEN '$' || format('{{:.2f}}', {x} / 1e6) || 'M' WHEN {x} >= 1000 "
                   f"THEN '$' || format('{{:.0f}}', {x} / 1e3) || 'K' ELSE '$' || CAST({x} AS VARCHAR) END")
FULL = lambda x: f"'$' || format('{{:,}}', CAST({x} AS BIGINT))"
NPS_TEXT = "coalesce(CAST(CAST(floor({0}) AS INT) AS VARCHAR) || '/10', 'N/A')"
PCT = "'-' || CAST(CAST(trunc({0} * 100) AS INT) AS VARCHAR) || '%'"
BIG = lambda x: f"CAST({x} AS BIGINT)"
DRIVERS = listed([
    ("usage_decline_score >= 0.7e0", "'usage_severe'"),
    ("usage_decline_score >= 0.4e0 AND usage_decline_score < 0.7e0", "'usage_moderate'"),
    ("silent_churn_flag", "'silent_churn'"), ("p1_open_count > 0", "'open_p1'"),
    ("p1_open_count = 0 AND open_ticket_count > 0", "'open_tickets'"), ("sdk_risk_score >= 1", "'sdk_sunset'"),
    ("sdk_risk_score >= 0.5e0 AND sdk_risk_score < 1", "'sdk_upgrade'"), ("nps_score <= 6", "'detractor'"),
    ("days_to_renewal <= 30", "'days_30'")])
ACTIONS = listed([
    ("days_to_renewal <= 30", "'escalate_now'"), ("p1_open_count > 0", "'resolve_p1'"),
    ("sdk_risk_score >= 1", "'migration_session'"), ("silent_churn_flag", "'executive_review'"),
    ("usage_decline_score >= 0.5e0 AND NOT silent_churn_flag", "'usage_audit'")])
N_TEXTS = lambda codes: f"CASE WHEN {RISKY} THEN greatest(len(string_split({codes}, '|')), 1) ELSE 0 END"
HEADER_DATE = r"(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}|[A-Za-z]+\s+\d{1,2})"
ISO, WORD = r"\d{4}-\d{2}-\d{2}", r"[A-Za-z]+\s+\d{1,2}"
FIRST_LINE = "string_split(raw_text, chr(10))[1]"
EXPLICIT = r"nullif(regexp_extract(raw_text, '(?i)(?:acct|#|account)\s*(\d{4})', 1), '')"
INSIGHT_ROWS = f"""SELECT * FROM (
  SELECT 'sunset_renewal' AS insight_code, count(*) AS n, {BIG('sum(arr)')} AS arr, CAST(NULL AS VARCHAR) AS csm_name FROM due WHERE {V3}
  UNION ALL SELECT 'silent_cluster', count(*), {BIG('sum(arr)')}, NULL FROM due WHERE silent_churn_flag
  UNION ALL SELECT 'csm_concentration', count(*), {BIG('sum(arr)')}, max(csm_name) FROM due WHERE {RISKY} AND csm_name = {TOP_CSM}
  UNION ALL SELECT 'enterprise_detractors', count(*), {BIG('sum(arr)')}, NULL FROM due WHERE {DETRACTOR}) WHERE n > 0"""
# two digits, halves away from zero
TWO = lambda x: f"CAST(CAST(round(CAST({x} AS DECIMAL(18, 10)), 2) AS DECIMAL(18, 2)) AS VARCHAR)"
NOTE_LISTS = "account_id, " + r6("csm_sentiment_score") + ", risk_flags, positive_signals"
DATED = """SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, o_orderkey % 8 AS k FROM orders"""

# Name similarity without any pruning but by length: shared tokens, then the longest common subsequence of what is
# left, one bit per letter of the name.
HEADER = f"regexp_replace(regexp_replace(array_to_string(list_slice(string_split(raw_text, chr(10)), 1, 2), ' '), '{HEADER_DATE}[\\s|\\-—]*', ''), {WS}, '', 'g')"


def _token_set(text: str) -> str:
    return f"list_sort(list_distinct(list_filter(regexp_split_to_array({text}, '\\s+'), lambda w: w <> '')))"


def similarity(fold: str) -> str:
    """note_pos, account_id, account_name and match_score of notes without an explicit id."""
    text = lambda tokens: f"array_to_string({tokens}, ' ')"
    return f"""WITH open_notes AS (SELECT note_pos, {HEADER} AS header FROM v_note_texts WHERE {EXPLICIT} IS NULL),
      h AS (SELECT header, {_token_set(f'{fold}(header)')} AS ht FROM (SELECT DISTINCT header FROM open_notes)),
      n AS (SELECT account_id, account_name, {_token_set(f'{fold}(account_name)')} AS nt FROM v_accounts),
      p AS (SELECT *, length({text('ht')}) AS la, length({text('nt')}) AS lb, list_filter(ht, lambda w: list_contains(nt, w)) AS shared FROM h, n),
      q AS (SELECT *, length({text('shared')}) AS k, {text('list_filter(ht, lambda w: NOT list_contains(nt, w))')} AS ra,
              {text('list_filter(nt, lambda w: NOT list_contains(ht, w))')} AS rb
            FROM p WHERE len(shared) > 0 OR 200e0 * least(la, lb) / (la + lb) >= 55),
      m AS (SELECT *, (CAST(1 AS BIGINT) << length(rb)) - 1 AS whole, list_transform(string_split(ra, ''), lambda c:
              list_sum(list_transform(string_split(rb, ''), lambda d, i: CASE WHEN c = d THEN CAST(1 AS BIGINT) << (i - 1) ELSE 0 END))::BIGINT) AS masks FROM q),
      l AS (SELECT *, CASE WHEN ra = '' OR rb = '' THEN 0 ELSE length(rb) - bit_count(list_reduce(list_prepend(whole, masks),
              lambda r, x: ((r + (r & x)) | (r - (r & x))) & whole)) END AS lcs FROM m),
      z AS (SELECT *, round(CASE WHEN k > 0 AND (k = la OR k = lb) THEN 100e0 ELSE greatest(
              CASE WHEN k > 0 THEN 200e0 * k / (k + least(la, lb)) ELSE 0e0 END,
              200e0 * (CASE WHEN k > 0 THEN k + 1 ELSE 0 END + lcs) / (la + lb)) END, 9) AS score FROM l WHERE la > 0 AND lb > 0)
      SELECT note_pos, account_id, account_name, score AS match_score FROM open_notes JOIN (
        SELECT * FROM z WHERE score >= 55 QUALIFY row_number() OVER (PARTITION BY header ORDER BY score DESC, account_id) = 1) USING (header)"""


TOKEN = f"nullif(regexp_extract({FIRST_LINE}, '({ISO}|(?:1[0-2]|0?[1-9])/\\d{{1,2}}|{WORD})', 1), '')"
NOTE_DATE = """CASE WHEN tok LIKE '____-%' THEN try_cast(tok AS DATE) WHEN tok LIKE '%/%' THEN CAST(try_strptime(tok || '/2026', '%m/%d/%Y') AS DATE)
  ELSE CAST(coalesce(try_strptime(regexp_replace(tok, '\\s+', ' ') || ' 2026', '%B %d %Y'), try_strptime(regexp_replace(tok, '\\s+', ' ') || ' 2026', '%b %d %Y')) AS DATE) END"""

ORACLE = {
    "a1_scan_accounts": "SELECT * FROM v_accounts",
    "a2_scan_usage": "SELECT account_id, month, api_calls, content_entries_created, active_users, workflows_triggered, sdk_version FROM v_usage",
    "a3_scan_tickets": "SELECT * EXCLUDE (resolution_time_hours), CASE WHEN ticket_id % 10 <> 0 THEN resolution_time_hours END AS resolution_time_hours FROM v_tickets",
    "a4_scan_nps": "SELECT account_id, score, replace(verbatim_comment, chr(10), ' ') AS verbatim_comment FROM v_nps",
    "a1_sift_accounts": """SELECT CASE WHEN reason IS NULL THEN account_id END AS account_id, reason, CASE WHEN reason IS NOT NULL THEN regexp_extract(account_name, '(Firm[0-9]+)', 1)
  ELSE concat_ws('|', account_id, account_name, arr, contract_end_date, plan_tier, industry, csm_name, region) END AS detail
FROM (SELECT *, CASE account_id % 50 WHEN 7 THEN 'malformed account_id' WHEN 9 THEN 'missing account_id' WHEN 11 THEN 'malformed contract_end_date' WHEN 17 THEN 'malformed arr' END AS reason FROM v_accounts)""",
    "a4_sift_nps": """SELECT CASE WHEN account_id % 20 <> 3 THEN account_id END AS account_id, CASE WHEN account_id % 20 = 3 THEN 'malformed account_id' END AS reason,
  CASE WHEN account_id % 20 = 3 THEN concat('c', account_id) ELSE concat_ws('|', account_id, CASE WHEN account_id % 20 <> 5 THEN CAST(score AS VARCHAR) END, concat('c', account_id)) END AS detail FROM v_nps""",
    "a5_scan_note_blocks": f"SELECT row_number() OVER (ORDER BY note_pos) - 1 AS note_pos, regexp_replace(raw_text, {WS}, '', 'g') AS raw_text FROM v_notes",
    "a6_sdk_policy_table": f"""SELECT DISTINCT sdk_version, {sdk_case('sdk_version')} AS sdk_risk_score,
      CASE WHEN starts_with(sdk_version, 'v3') THEN 'SDK v3.x (SUNSET)' WHEN sdk_version IN ('v4.0.0', 'v4.1.0') THEN 'SDK v4.0/v4.1'
      WHEN sdk_version = 'v4.2.3' THEN 'SDK v4.2.x' WHEN starts_with(sdk_version, 'v4.3') THEN 'SDK v4.3.x' END AS policy_label,
      CASE WHEN starts_with(sdk_version, 'v3') THEN DATE '2026-04-30' END AS sunset_date FROM v_usage""",
    "a7_table_bundle": f"""SELECT name, n, {REF} AS reference_date FROM (SELECT 'accounts' AS name, count(*) AS n FROM v_accounts
      UNION ALL SELECT 'usage', count(*) FROM v_usage UNION ALL SELECT 'tickets', count(*) FROM v_tickets
      UNION ALL SELECT 'nps', count(*) FROM v_nps UNION ALL SELECT 'notes', count(*) FROM v_notes)""",
    "a8_report_sink": f"SELECT account_id, contract_end_date, risk_tier, {r6s('risk_score', 'usage_decline_score')}, {BOOSTERS} AS boosters_applied, {r6('round(nps_risk_score * 0.15e0, 4)', 'nps_part')} FROM due",
    "a9_report_source": f"""SELECT {REF} AS reference_date, {BIG('90')} AS window_days, count(*) AS total_renewing, {BIG('sum(arr)')} AS total_arr_at_risk,
      count(*) FILTER (risk_tier = 'High') AS high_risk_count, count(*) FILTER (risk_tier = 'Medium') AS medium_risk_count,
      count(*) FILTER (risk_tier = 'Low') AS low_risk_count FROM due""",
    "a9_report_insights": INSIGHT_ROWS,
    "a10_csv_export": "SELECT account_name, arr, contract_end_date, risk_score, risk_tier, plan_tier, latest_sdk_version, p1_open_count, silent_churn_flag FROM due",
    "b1_recent_tickets": "SELECT ticket_id, account_id, created_date, priority, status FROM recent",
    "b2_filter_renewing": f"SELECT account_id, contract_end_date, {r6s('risk_score')}, risk_tier FROM due",
    "b3_portfolio_filter": f"SELECT account_id, risk_tier, csm_name, region, industry FROM s WHERE {RISKY} AND region IN ('AFRICA', 'ASIA', 'EUROPE') AND industry IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE')",
    "b4_actionable_tiers": f"SELECT account_id, risk_tier FROM due WHERE {RISKY}",
    "b5_non_english_mask": "SELECT account_id, has_non_english FROM due WHERE has_non_english",
    "b6_high_only": f"SELECT account_id, {r6s('risk_score')} FROM s WHERE risk_tier = 'High'",
    "b7_enrichment_gaps": """SELECT count(*) AS accounts, count(*) FILTER (account_id % 3 <> 2) AS needs_narrative,
      count(*) FILTER (NOT flagged AND has_csm_notes) AS needs_notes,
      count(*) FILTER (coalesce(has_non_english, false) AND coalesce(english_translation, '') = '') AS needs_translation,
      CASE WHEN EXISTS (FROM (""" + INSIGHT_ROWS + """)) THEN 0::BIGINT ELSE 1::BIGINT END AS needs_insights FROM gap""",
    "b8_is_real_narrative": "SELECT account_id, narrative_summary = 'A real text' AS is_real FROM gap",
    "b9_v3_renewing": f"SELECT account_id, latest_sdk_version FROM due WHERE {V3}",
    "b10_enterprise_detractors": f"SELECT account_id, nps_score FROM due WHERE {DETRACTOR}",
    "b11_silent_rows": f"SELECT account_id, nps_score, {r6s('usage_decline_score')} FROM s WHERE silent_churn_flag",
    "b12_card_flags": f"SELECT account_id, p1_open_count > 0 AS has_open_p1, silent_churn_flag AS is_silent, {V3} AS on_sunset_sdk, days_to_renewal <= 30 AS ends_in_30_days FROM due",
    "b13_display_fallbacks": """SELECT account_id, CASE WHEN account_id % 3 = 2 THEN narrative_summary ELSE 'none yet' END AS shown_summary,
      CASE WHEN account_id % 4 = 0 THEN 'driver' WHEN flagged THEN 'flag' ELSE '' END AS shown_drivers,
      CASE WHEN account_id % 5 = 0 THEN 'act' WHEN account_id % 7 = 0 THEN 'call' ELSE '' END AS shown_actions FROM gap""",
    "b14_translated_view": """SELECT account_id, account_id % 8 = 0 AS is_translated,
      CASE WHEN account_id % 8 = 0 THEN 'translated' ELSE verbatim_comment END AS shown_comment FROM gap""",
    "c1_join_usage": f"SELECT account_id, account_name, latest_sdk_version, {r6s('usage_decline_score')} FROM v_accounts LEFT JOIN uf USING (account_id)",
    "c2_join_tickets": f"SELECT account_id, ticket_count_total, {r6s('support_health_score', 'avg_resolution_hours')} FROM v_accounts LEFT JOIN tf USING (account_id)",
    "c3_join_nps": f"""SELECT account_id, region, nps_score, {r6s('nps_risk_score')} FROM v_accounts LEFT JOIN (
      SELECT account_id, nps_score, nps_risk_score FROM nf UNION ALL SELECT account_id, 10e0, {nps_case('10e0')} FROM nf WHERE account_id % 3 = 0) USING (account_id)""",
    "c4_join_defaults": f"SELECT account_id, p1_open_count, ticket_count_total, open_ticket_count, {r6s('usage_decline_score', 'support_health_score', 'nps_risk_score')} FROM s",
    "c5_join_notes": """SELECT account_id, note_pos, raw_text, count(note_pos) OVER (PARTITION BY account_id) AS note_count, note_pos IS NOT NULL AS has_csm_notes
      FROM v_accounts LEFT JOIN v_notes USING (account_id)""",
    "c6_resolve_explicit": f"SELECT note_pos, CAST({EXPLICIT} AS BIGINT) AS account_id, CAST({EXPLICIT} AS BIGINT) IN (SELECT account_id FROM v_accounts) AS id_known FROM v_note_texts WHERE {EXPLICIT} IS NOT NULL",
    "c7_resolve_fuzzy": f"SELECT note_pos, account_id, account_name, {r6s('match_score')} FROM ({similarity('')})",
    "c8_resolve_first_word": r"""SELECT note_pos, account_id, account_name FROM (
      SELECT DISTINCT note_pos, unnest(regexp_extract_all(lower(raw_text), '[\p{L}\p{N}_]+')) AS w FROM v_note_texts)
      JOIN v_accounts ON lower(string_split(account_name, ' ')[1]) = w""",
    "c9_resolve_notes": rf"""WITH ids AS (SELECT note_pos, CAST({EXPLICIT} AS BIGINT) AS id FROM v_note_texts),
      named AS ({similarity('lower')}),
      worded AS (SELECT note_pos, min_by(a.account_id, a.account_id) AS account_id, min_by(account_name, a.account_id) AS account_name FROM (
        SELECT DISTINCT note_pos, unnest(regexp_extract_all(lower(raw_text), '[\p{{L}}\p{{N}}_]+')) AS w FROM v_note_texts)
        JOIN v_accounts a ON lower(string_split(account_name, ' ')[1]) = w GROUP BY note_pos)
      SELECT note_pos, {NOTE_DATE} AS note_date, coalesce(id, n.account_id, w.account_id) AS account_id,
        CASE WHEN id IS NULL THEN coalesce(n.account_name, w.account_name) END AS account_name,
        CASE WHEN id IS NOT NULL THEN 'explicit' WHEN n.note_pos IS NOT NULL THEN 'similarity' WHEN w.note_pos IS NOT NULL THEN 'first_word' END AS match_method,
        CASE WHEN id IS NULL THEN match_score END AS match_score,
        CASE WHEN id IS NOT NULL THEN id IN (SELECT account_id FROM v_accounts) ELSE coalesce(n.account_id, w.account_id) IS NOT NULL END AS id_known
      FROM (SELECT note_pos, {TOKEN} AS tok FROM v_note_texts) JOIN ids USING (note_pos)
      LEFT JOIN named n USING (note_pos) LEFT JOIN worded w USING (note_pos)""",
    "c10_annotation_lookup": f"SELECT account_id, {r6('coalesce(csm_sentiment_score, 0.5e0)', 'csm_sentiment_score')}, coalesce(risk_flags, '') AS risk_flags, coalesce(positive_signals, '') AS positive_signals FROM v_accounts LEFT JOIN sig USING (account_id)",
    "c11_upsert_by_id": """SELECT account_id, pos, priority, CASE WHEN account_id % 2 = 0 AND account_id IN (SELECT account_id FROM v_nps) THEN 'Reviewed' ELSE status END AS status
      FROM (SELECT account_id, min(ticket_id) AS pos, max_by(priority, ticket_id) AS priority, max_by(status, ticket_id) AS status FROM v_tickets GROUP BY account_id)""",
    "c12_concat_columns": f"SELECT account_id, account_name, {r6s('csm_sentiment_score', 'risk_score', 'base_score')} FROM s",
    "d1_usage_slopes": f"SELECT account_id, {r6s('api_calls_slope_risk', 'active_users_slope_risk', 'workflow_slope_risk')} FROM uf",
    "d2_usage_step_drop": f"SELECT account_id, {r6s('usage_step_drop')} FROM uf",
    "d3_usage_decline": f"SELECT account_id, {r6s('usage_decline_score')} FROM uf",
    "d4_usage_levels": f"SELECT account_id, latest_sdk_version, latest_active_users, {r6s('avg_api_calls_6m', 'avg_active_users')} FROM uf",
    "d5_usage_series": "SELECT account_id, pos, month, api_calls FROM upos",
    "d6_ticket_weights": f"SELECT ticket_id, priority, status, {r6(f'{PRIORITY} * {STATUS}', 'weight')} FROM v_tickets",
    "d7_ticket_features": f"SELECT account_id, ticket_count_total, p1_open_count, open_ticket_count, {r6s('support_health_score', 'avg_resolution_hours')} FROM tf",
    "d8_ticket_subjects": """SELECT account_id, count(subject) OVER (PARTITION BY account_id) AS ticket_subject_count, subject, created_date, ticket_id
      FROM v_accounts LEFT JOIN (SELECT account_id, subject, created_date, ticket_id FROM recent
            QUALIFY row_number() OVER (PARTITION BY account_id, subject ORDER BY created_date, ticket_id) = 1) USING (account_id)""",
    "d9_csm_concentration": f"SELECT csm_name, count(*) AS n, {BIG('sum(arr)')} AS arr FROM due WHERE {RISKY} AND csm_name = {TOP_CSM} GROUP BY csm_name",
    "d9_csm_concentration_accounts": f"SELECT csm_name, account_id, account_name FROM due WHERE {RISKY} AND csm_name = {TOP_CSM}",
    "d10_arr_by_csm": f"SELECT csm_name, {BIG('sum(arr)')} AS arr FROM due WHERE {RISKY} GROUP BY csm_name",
    "d11_tier_counts": "SELECT risk_tier, count(*) AS count FROM s GROUP BY risk_tier",
    "d12_sdk_by_tier": "SELECT latest_sdk_version, risk_tier, count(*) AS count FROM s WHERE latest_sdk_version IS NOT NULL GROUP BY ALL",
    "d13_score_histogram": f"SELECT {BIG('least(floor(round(risk_score * 10000) / 500), 19)')} AS bin, risk_tier, count(*) AS count FROM s GROUP BY ALL",
    "d14_portfolio_totals": f"""SELECT count(*) AS total_renewing, {BIG('sum(arr)')} AS total_arr_at_risk,
      {', '.join(f"count(*) FILTER (risk_tier = '{t}') AS {t.lower()}_risk_count, {BIG(f'''coalesce(sum(arr) FILTER (risk_tier = '{t}'), 0)''')} AS {t.lower()}_arr" for t in ('High', 'Medium', 'Low'))},
      count(*) FILTER (silent_churn_flag) AS silent_count FROM due""",
    "d15_filter_domains": "SELECT DISTINCT * FROM (SELECT 'csm_name' AS attribute, csm_name AS value FROM due UNION ALL SELECT 'region', region FROM due UNION ALL SELECT 'industry', industry FROM due)",
    "d16_load_audit": """SELECT 'accounts' AS metric, count(*) AS value FROM v_accounts UNION ALL SELECT 'usage_rows', count(*) FROM v_usage
      UNION ALL SELECT 'tickets', count(*) FROM v_tickets UNION ALL SELECT 'nps_responses', count(*) FROM v_nps
      UNION ALL SELECT 'notes', count(*) FROM v_notes UNION ALL SELECT 'notes_with_account', count(account_id) FROM v_notes
      UNION ALL SELECT 'silent_flags', count(*) FILTER (silent_churn_flag) FROM s""",
    "d17_report_audit": "SELECT account_id, account_name, risk_tier, account_id % 3 = 2 AS has_narrative, flagged AS has_flags, EXISTS (FROM (" + INSIGHT_ROWS + ")) AS has_insights FROM gap ORDER BY risk_score DESC, account_id LIMIT 8",
    "d18_v3_exposure": f"SELECT count(*) AS n, {BIG('coalesce(sum(arr), 0)')} AS arr FROM due WHERE {V3}",
    "d19_silent_cluster": "SELECT count(*) AS n FROM due WHERE silent_churn_flag",
    "d20_detractor_exposure": f"SELECT count(*) AS n, {BIG('coalesce(sum(arr), 0)')} AS arr FROM due WHERE {DETRACTOR}",
    "d18_d20_insight_members": f"""SELECT 'sunset_renewal' AS insight_code, account_id, account_name, arr FROM due WHERE {V3}
      UNION ALL SELECT 'silent_cluster', account_id, account_name, arr FROM due WHERE silent_churn_flag
      UNION ALL SELECT 'csm_concentration', account_id, account_name, arr FROM due WHERE {RISKY} AND csm_name = {TOP_CSM}
      UNION ALL SELECT 'enterprise_detractors', account_id, account_name, arr FROM due WHERE {DETRACTOR}""",
    "e1_month_position": "SELECT account_id, month, pos, n FROM upos",
    "e1_month_position_skew_safe": "SELECT account_id, month, pos, n FROM upos",
    "e2_latest_row": "SELECT account_id, month, api_calls, active_users, sdk_version FROM upos WHERE pos = n - 1",
    "e3_rank_by_risk": f"SELECT account_id, {r6s('risk_score')}, rank() OVER (ORDER BY risk_score DESC) AS risk_rank FROM s",
    "e4_top_signals": f"""SELECT account_id, string_agg(label, '|' ORDER BY contribution DESC, ord) AS top_signals FROM (
      SELECT account_id, {label_case(TOP_SIGNAL_LABELS)} AS label, contribution, ord FROM parts
      QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY contribution DESC, ord) <= 3) GROUP BY account_id""",
    "e5_top20_high": f"SELECT account_id, {r6s('risk_score')} FROM (SELECT * FROM s WHERE risk_tier = 'High' ORDER BY risk_score DESC, account_id LIMIT 20)",
    "e6_list_caps": f"SELECT account_id, {BIG(f'least(n_neg, {MAX_FLAGS})')} AS n_flags, {BIG(f'least(n_pos, {MAX_POSITIVES})')} AS n_positives, risk_flags, positive_signals FROM sig",
    "e7_silent_spotlight": f"""SELECT account_id, account_name, {MONEY('arr')} AS arr_text, {NPS_TEXT.format('nps_score')} AS nps_text,
      {PCT.format('usage_decline_score')} AS decline_text, risk_tier, contract_end_date, csm_name FROM s WHERE silent_churn_flag""",
    "e8_head_views": "SELECT account_id, account_name, arr, contract_end_date, risk_score, risk_tier FROM due ORDER BY risk_score DESC, account_id LIMIT 15",
    "e9_text_cap": "SELECT account_id, substr(lines, 1, 1500) AS note_text, CAST(length(lines) AS BIGINT) AS note_chars FROM txts",
    "g1_note_date_token": f"""SELECT note_pos, nullif(regexp_extract({FIRST_LINE}, '({ISO}|(?:1[0-2]|0?[1-9])/\\d{{1,2}}|{WORD})', 1), '') AS token,
      nullif(regexp_extract({FIRST_LINE}, '({ISO}|0?[1-9]/\\d{{1,2}}|{WORD})', 1), '') AS narrow_token FROM v_note_texts""",
    "g2_parse_note_date": f"""SELECT o_orderkey, CASE WHEN k IN (0, 3, 5) THEN make_date(y, m, d) WHEN k = 2 THEN make_date(2000 + y % 100, m, d)
      WHEN k IN (1, 4) AND NOT (m = 2 AND d = 29) THEN make_date(2026, m, d) END AS note_date FROM ({DATED})""",
    "g3_days_to_renewal": f"SELECT account_id, {DAYS} AS days_to_renewal FROM v_accounts",
    "g4_renewal_urgency": f"SELECT account_id, {URGENCY.format(d=DAYS)} AS urgency FROM v_accounts",
    "g5_nps_risk": f"SELECT account_id, {r6(nps_case('sc'), 'nps_risk')} FROM (SELECT account_id, score - (account_id % 4) * 0.125e0 AS sc FROM v_nps)",
    "g6_sdk_risk": f"SELECT event_id, version, {sdk_case('version')} AS sdk_risk FROM vers",
    "g7_clip_round": f"""SELECT l_returnflag, l_linestatus, {r6('avg(c)', 'mean_clipped')}, round(avg(c), 1) AS one_digit,
      count(*) FILTER (c = 1) AS at_top, count(*) FILTER (c = 0) AS at_bottom
      FROM (SELECT *, {clip('l_extendedprice * l_discount / 5000e0 - 0.2e0')} AS c FROM lineitem) GROUP BY ALL""",
    "g8_arr_millions": f"SELECT account_id, {r6s('risk_score')}, {r6('arr / 1e6', 'arr_m')}, risk_tier, plan_tier, csm_name, days_to_renewal FROM due",
    "g9_progress_pct": f"SELECT account_id, signal, {BIG('least(greatest(trunc(contribution * 100), 0), 100)')} AS pct, CASE WHEN contribution > 0.6e0 THEN 'red' WHEN contribution > 0.3e0 THEN 'amber' ELSE 'green' END AS band FROM parts",
    "h1_clean_header": f"""SELECT note_pos, regexp_replace(regexp_replace(array_to_string(list_slice(string_split(raw_text, chr(10)), 1, 2), ' '), '{HEADER_DATE}[\\s|\\-—]*', ''), {WS}, '', 'g') AS header FROM v_note_texts""",
    "h2_has_non_english": f"SELECT doc_id, {foreign('text')} AS has_non_english FROM documents",
    "h3_keyword_hits": "SELECT account_id, " + ", ".join(
        f"{listed([(has(k), quoted([k])) for k in words])} AS {name}" for name, words in (
            ("negative", NEGATIVE_KEYWORDS), ("positive", POSITIVE_KEYWORDS), ("competitor", COMPETITORS),
            ("executive", EXECUTIVE_KEYWORDS))) + " FROM txts",
    "h4_money_short": f"SELECT account_id, {MONEY('arr')} AS arr_text, {MONEY('(arr * 7)')} AS arr_text_7, {MONEY('(arr % 1000)')} AS small_text FROM v_accounts",
    "h5_nps_text": f"SELECT account_id, {NPS_TEXT.format('score')} AS nps_text FROM v_nps",
    "h6_decline_pct_text": f"SELECT account_id, {PCT.format('round(usage_decline_score, 6)')} AS decline_text FROM s",
    "h7_sdk_label": f"""SELECT event_id, CASE WHEN r >= 0.99e0 THEN 'SDK v3.x (SUNSET)' WHEN r >= 0.59e0 THEN 'SDK v4.0/v4.1' WHEN r >= 0.14e0 THEN 'SDK v4.2.x' ELSE 'SDK v4.3.x' END AS score_label,
      CASE WHEN r = 1 THEN 'sunset' WHEN r = 0.6e0 THEN 'upgrade needed' WHEN r = 0.15e0 THEN 'stable' WHEN r = 0 THEN 'current' ELSE 'moderate' END AS exact_label,
      CASE WHEN coalesce(version, '') = '' THEN 'Unknown' WHEN starts_with(lower(version), 'v3') THEN version || ' (SUNSET)'
      WHEN lower(version) IN ('v4.0.0', 'v4.1.0') THEN version || ' (upgrade needed)' ELSE version END AS display_label
      FROM (SELECT *, {sdk_case('version')} AS r FROM vers)""",
    "h8_signal_labels": f"SELECT account_id, signal, {label_case(BAR_LABELS)} AS label, {label_case(TOP_SIGNAL_LABELS)} AS top_label FROM parts",
    "h9_breakdown_map": f"SELECT account_id, signal, {r6('round(raw, 3)', 'raw_value')}, {r6s('weight', 'contribution')} FROM parts",
    "h10_json_text_to_list": """SELECT doc_id, CAST(CASE doc_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS BIGINT) AS n,
      CASE doc_id % 3 WHEN 0 THEN text || '|second' WHEN 1 THEN text ELSE '' END AS items FROM documents""",
    "h11_reply_to_struct": """SELECT doc_id AS account_id, doc_id % 6 < 4 AS parsed,
      round(CASE WHEN doc_id % 6 < 3 THEN 1e0 - doc_id % 5 / 4e0 WHEN doc_id % 6 = 3 THEN 0.75e0 ELSE 0.5e0 END, 6) AS csm_sentiment_score,
      CASE WHEN doc_id % 6 < 3 THEN 'flag|' || lang WHEN doc_id % 6 = 3 THEN 'a|b' ELSE '' END AS risk_flags,
      CASE WHEN doc_id % 6 < 3 THEN source ELSE '' END AS positive_signals,
      CAST(CASE WHEN doc_id % 6 < 3 THEN length(text) ELSE 0 END AS BIGINT) AS concern_length FROM documents""",
    "h12_sentiment_to_risk": f"""SELECT doc_id, {r6("round(1e0 - coalesce(CASE WHEN toxic IS NOT NULL THEN (quality + doc_id % 7 / 7e0) / 2e0 END, 0.5e0), 4)", 'risk')} FROM documents LEFT JOIN labels USING (doc_id)""",
    "i1_silent_churn": "SELECT account_id, silent_churn_flag FROM s",
    "i2_build_features": """SELECT account_id, account_name, arr, contract_end_date, plan_tier, industry, csm_name, region, """ + r6s(
        "api_calls_slope_risk", "active_users_slope_risk", "workflow_slope_risk", "usage_step_drop", "usage_decline_score",
        "avg_api_calls_6m", "avg_active_users", "avg_resolution_hours", "support_health_score", "nps_risk_score",
        "sdk_risk_score", "renewal_urgency_score") + """, latest_sdk_version, latest_active_users, ticket_count_total, p1_open_count,
      open_ticket_count, nps_score, has_non_english, has_csm_notes, silent_churn_flag, days_to_renewal FROM f""",
    "i3_risk_score": f"SELECT account_id, {r6s('risk_score', 'base_score', 'total_boost')}, risk_tier FROM (" + score(
        "f", (("usage_decline_score", "0.6e0"), ("nps_risk_score", "0.5e0"), ("sdk_risk_score", "0.2e0"))) + ")",
    "i4_score_all": f"SELECT account_id, {r6s('risk_score', 'base_score', 'total_boost')}, risk_tier, {BOOSTERS} AS boosters_applied FROM s",
    "i5_rescore": f"SELECT account_id, {r6s('csm_sentiment_score', 'risk_score', 'base_score')}, risk_tier FROM resc",
    "i6_portfolio_insights": INSIGHT_ROWS,
    "i6_executive_summary": f"""SELECT n AS total_renewing, h AS high_risk_count, n || ' accounts worth ' || {FULL('a')} || ' renew in the window: ' || h || ' High (' || {FULL('ha')} || '), ' || m || ' Medium (' || {FULL('ma')} || ').' AS executive_summary
      FROM (SELECT count(*) AS n, sum(arr) AS a, count(*) FILTER (risk_tier = 'High') AS h, coalesce(sum(arr) FILTER (risk_tier = 'High'), 0) AS ha,
      count(*) FILTER (risk_tier = 'Medium') AS m, coalesce(sum(arr) FILTER (risk_tier = 'Medium'), 0) AS ma FROM due)""",
    "i7_note_signals": f"""SELECT {NOTE_LISTS}, executive_keyword, action_code, 'Notes mention a senior stakeholder: ' || executive_keyword AS key_stakeholder_concern,
      CASE action_code WHEN 'competitor' THEN 'Set up an executive call about the rival offer: ' || rivals WHEN 'risk' THEN 'Raise with leadership: ' || lower(string_split(risk_flags, '|')[1])
      WHEN 'positive' THEN 'Close the renewal paperwork and note the expansion interest' END AS csm_recommended_action FROM sig""",
    "i8_account_narrative": f"""SELECT account_id, coalesce(nullif({DRIVERS}, ''), 'composite') AS drivers, coalesce(nullif({ACTIONS}, ''), 'schedule_renewal') AS actions,
      CASE WHEN silent_churn_flag THEN 'silent_churn' WHEN usage_decline_score >= 0.5e0 THEN 'usage_decline' WHEN p1_open_count > 0 THEN 'open_p1' ELSE 'moderate' END AS summary,
      CASE WHEN days_to_renewal <= 30 THEN 'immediate' ELSE 'proactive' END AS urgency FROM due""",
    "j1_annotate_notes": f"SELECT {NOTE_LISTS} FROM sig WHERE account_id IN (SELECT account_id FROM v_accounts)",
    "j1_annotate_notes_by_function": f"""WITH noted AS (SELECT account_id, raw_text, row_number() OVER (PARTITION BY account_id ORDER BY note_pos) - 1 AS i
        FROM v_notes WHERE account_id IN (SELECT account_id FROM v_accounts)),
      calls AS (SELECT account_id, i // 3 AS c, count(*) AS k FROM noted GROUP BY ALL),
      flags AS (SELECT account_id, length(raw_text) || ' characters' AS v, min(i) AS i FROM noted GROUP BY ALL),
      goods AS (SELECT account_id, k || ' notes' AS v, min(c) AS i FROM calls GROUP BY ALL)
      SELECT account_id, {r6('CASE WHEN min(k) = max(k) THEN min(k) / 4e0 ELSE round(sum(k * k / 4e0) / sum(k), 4) END', 'csm_sentiment_score')},
        (SELECT string_agg(v, '|' ORDER BY f.i) FROM flags f WHERE f.account_id = calls.account_id) AS risk_flags,
        (SELECT string_agg(v, '|' ORDER BY g.i) FROM goods g WHERE g.account_id = calls.account_id) AS positive_signals,
        'part 0' AS key_stakeholder_concern FROM calls GROUP BY account_id""",
    "j1_note_labels": """WITH noted AS (SELECT account_id, raw_text, row_number() OVER (PARTITION BY account_id ORDER BY note_pos) - 1 AS i
        FROM v_notes WHERE account_id IN (SELECT account_id FROM v_accounts)),
      calls AS (SELECT account_id, i // 3 AS c, count(*) AS k FROM noted GROUP BY ALL),
      labels AS (SELECT account_id, 'flag' AS kind, length(raw_text) || ' characters' AS v, min(i) AS i FROM noted GROUP BY ALL
        UNION ALL SELECT account_id, 'positive', k || ' notes', min(c) * 3 FROM calls GROUP BY ALL)
      SELECT account_id, kind, i // 3 AS chunk_no, i % 3 AS item, v AS "value" FROM labels""",
    "j2_annotate_nps_by_function": """SELECT DISTINCT account_id, nps_score, CASE WHEN trim(verbatim_comment, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') = '' THEN '' ELSE length(verbatim_comment) || ' characters' END AS english_translation,
        CASE WHEN trim(verbatim_comment, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') = '' THEN 'en' ELSE CAST(CAST(nps_score AS BIGINT) AS VARCHAR) END AS detected_language
      FROM (SELECT account_id, nps_score, verbatim_comment FROM nf WHERE nps_score IS NOT NULL UNION ALL SELECT account_id, 10e0, verbatim_comment FROM nf)""",
    "j2_annotate_nps": "SELECT account_id, verbatim_comment AS english_translation, 'unknown' AS detected_language, 'consistent' AS sentiment_alignment FROM due WHERE has_non_english",
    "j3_annotate_account": f"SELECT account_id, risk_tier, {RISKY} AS has_text, {BIG(N_TEXTS(DRIVERS))} AS n_drivers, {BIG(N_TEXTS(ACTIONS))} AS n_actions FROM due",
    "j4_annotate_portfolio": f"""SELECT insight_code, CASE insight_code WHEN 'sunset_renewal' THEN 'Forced SDK migration meets renewal' WHEN 'silent_cluster' THEN 'Good surveys over falling usage'
      WHEN 'csm_concentration' THEN 'Most at-risk accounts sit with ' || csm_name ELSE 'Enterprise detractors' END AS title, n, arr FROM ({INSIGHT_ROWS})""",
    "j5_briefing_table": f"""WITH t AS (SELECT account_id, string_agg(raw_text, chr(10) ORDER BY note_pos) AS notes FROM v_notes GROUP BY account_id)
      SELECT account_id, coalesce(length(notes), 0) AS note_chars, concat_ws(chr(10), 'Account: ' || coalesce(account_name, '?') || ' / ' || account_id, 'ARR: ' || {FULL('arr')},
        'Plan: ' || concat_ws(' / ', plan_tier, industry, region), 'Contract end: ' || concat_ws(' in days ', CAST(contract_end_date AS VARCHAR), CAST(days_to_renewal AS VARCHAR)),
        'CSM: ' || coalesce(csm_name, 'n/a'), 'Risk: ' || {TWO('risk_score')} || ' ' || risk_tier, 'Usage decline: ' || {TWO('usage_decline_score')},
        'Silent churn: ' || coalesce(silent_churn_flag, false), 'Tickets total, critical open, open: ' || concat_ws(', ', CAST(ticket_count_total AS INT), CAST(p1_open_count AS INT), CAST(open_ticket_count AS INT)),
        'SDK: ' || CASE round(sdk_risk_score, 2) WHEN 1 THEN 'sunset' WHEN 0.6 THEN 'upgrade needed' WHEN 0.15 THEN 'stable' WHEN 0 THEN 'current' ELSE 'moderate' END,
        'Survey: ' || coalesce(CAST(nps_score AS VARCHAR), 'n/a'), 'Comment: ' || coalesce(verbatim_comment, 'n/a'),
        CASE WHEN has_non_english AND regexp_matches(verbatim_comment, '\\S') THEN 'Original language: unknown' END,
        'Notes: ' || coalesce(substring(notes, 1, 1500), 'n/a'), 'Flags: ' || replace(flag_text, '|', '; '), 'Positives: ' || replace(coalesce(positive_signals, ''), '|', '; '),
        'Concern: ' || coalesce('Notes mention a senior stakeholder: ' || executive_keyword, 'n/a')) AS briefing
      FROM resc LEFT JOIN (SELECT account_id, positive_signals, executive_keyword FROM sig) g USING (account_id) LEFT JOIN t USING (account_id)""",
    "j6_portfolio_lines": f"""SELECT coalesce(string_agg(line, chr(10) ORDER BY risk_score DESC, account_id), '') AS portfolio_text FROM (
      SELECT risk_score, account_id, concat_ws(' | ', account_name, 'ARR ' || {FULL('arr')}, 'tier ' || risk_tier, 'sdk ' || coalesce(latest_sdk_version, '?'),
        'csm ' || csm_name, 'industry ' || industry, 'region ' || region, 'silent ' || CAST(silent_churn_flag AS VARCHAR), 'critical ' || p1_open_count,
        'nps ' || coalesce(CAST(nps_score AS VARCHAR), '?')) AS line
      FROM s WHERE risk_tier = 'High' ORDER BY risk_score DESC, account_id LIMIT 20)""",
    "j7_enrich_missing": f"""SELECT account_id, {r6s('csm_sentiment_score', 'risk_score')}, risk_tier, true AS has_narrative,
      CASE WHEN account_id % 2 = 0 THEN 'flag' WHEN has_csm_notes THEN flag_text END AS risk_flags, CASE WHEN coalesce(has_non_english, false) AND account_id % 8 <> 0 THEN verbatim_comment ELSE english_translation END AS english_translation
      FROM (SELECT r.*, CASE account_id % 8 WHEN 0 THEN 'translated' WHEN 4 THEN '' END AS english_translation FROM (""" + score(
        """(SELECT * EXCLUDE (csm_sentiment_score), CASE WHEN account_id % 2 = 0 THEN 0.5e0 ELSE csm_sentiment_score END AS csm_sentiment_score FROM resc_in)""") + ") r)",
    "j8_analyse_portfolio": f"""SELECT account_id, {r6s('csm_sentiment_score', 'risk_score')}, risk_tier, CASE WHEN has_non_english THEN 'unknown' ELSE 'en' END AS detected_language,
      flag_text AS risk_flags, {RISKY} AS has_text FROM resc""",
}


# other ways to the same rows
ORACLE["a9_report_document"] = ORACLE["a8_report_sink"]
ORACLE["c11_upsert_parted"] = ORACLE["c11_upsert_by_id"]
ORACLE["i4_score_landed"] = ORACLE["i4_score_all"]


def statements() -> dict[str, str]:
    """Each query with only the named steps it needs in front."""
    names = list(STEPS)

    direct = {n: {m for m in names if m != n and re.search(rf"\b(?:FROM|JOIN)\s+{m}\b", STEPS[n])} for n in names}

    def closure(sql: str) -> list[str]:
        todo = [n for n in names if re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", sql)]
        seen: set[str] = set()
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += direct[n]
        return [n for n in names if n in seen]

    out = {}
    for key, sql in ORACLE.items():
        steps = closure(sql)
        prefix = ("WITH " + ", ".join(f"{n} AS ({STEPS[n]})" for n in steps) + " ") if steps else ""
        out[key] = prefix + f"SELECT * FROM ({sql})"
    return out
