"""One query per operator over the stand-in tables of a TPC-H-like folder."""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark import schemas
from riskspark.functions import dates, risk, text
from riskspark.functions.numeric import clip01
from riskspark.operators import annotate as A
from riskspark.operators import features as FE
from riskspark.operators import gaps, insights, merge, portfolio, scoring, signals, surveys, usage
from riskspark.operators import narrative as N
from riskspark.operators import resolve, tickets
from riskspark.operators.lists import owned
from riskspark.plans import renewals
from riskspark.scratch import scratch_dir, stored
from riskspark.sources import landing, parted, policy, rejects, report, tables
from riskspark.sources.notes import scan_note_blocks
from riskspark.sources.standins import REF, raw, standin, standin_tables

QUERIES = {}
PORTFOLIO_COLUMNS = ["account_id", "account_name", "arr", "contract_end_date", "plan_tier", "industry",
                     "csm_name", "region"]


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def r6(column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c, 6) + F.lit(0.0)


def r6s(*names: str) -> list[Column]:
    return [r6(n).alias(n) for n in names]


def joined(*names: str) -> list[Column]:
    return [F.array_join(F.col(n), "|").alias(n) for n in names]


def scored(spark, sf) -> DataFrame:
    return renewals.scored_accounts(standin_tables(spark, sf))


def due(spark, sf) -> DataFrame:
    return renewals.renewing_accounts(standin_tables(spark, sf))


def positions(spark, sf) -> DataFrame:
    return usage.month_positions(standin(spark, sf, "v_usage"), unique_months=True)


def written_csv(spark, df: DataFrame) -> str:
    path = scratch_dir(spark)
    df.write.option("header", True).option("escape", '"').csv(path)
    return path


# --- scans, sources, sinks ---------------------------------------------------------

@query
def a1_scan_accounts(spark, sf):
    return tables.scan_accounts(spark, written_csv(spark, standin(spark, sf, "v_accounts")))


@query
def a2_scan_usage(spark, sf):
    rows = standin(spark, sf, "v_usage").select(
        "account_id", F.date_format("month", "yyyy-MM").alias("month"), "api_calls",
        "content_entries_created", "active_users", "workflows_triggered", "sdk_version")
    return tables.scan_usage(spark, written_csv(spark, rows))


@query
def a3_scan_tickets(spark, sf):
    hours = F.when(F.col("ticket_id") % 10 == 0, "n/a").otherwise(F.col("resolution_time_hours").cast("string"))
    rows = standin(spark, sf, "v_tickets").withColumn("resolution_time_hours", hours)
    return tables.scan_tickets(spark, written_csv(spark, rows))


@query
def a4_scan_nps(spark, sf):
    score = F.coalesce(F.col("score").cast("string"), F.lit("none"))
    comment = F.regexp_replace("verbatim_comment", "\n", " ")  # one CSV record per line
    rows = standin(spark, sf, "v_nps").withColumns({"score": score, "verbatim_comment": comment})
    return tables.scan_nps(spark, written_csv(spark, rows))


def sifted(spark, sf, source, rows, reason) -> DataFrame:
    """A source written with malformed records, read in two parts: good rows and what each rejected record lacked."""
    path = scratch_dir(spark)
    rows.write.option("header", True).option("escape", '"').csv(path)
    part = rejects.sift(spark, source, path)
    named = part.rejects.select(F.lit(None).cast("long").alias("account_id"), "reason", F.regexp_extract("record", reason, 1).alias("detail"))
    return part.rows.select("account_id", F.lit(None).cast("string").alias("reason"), F.concat_ws("|", *part.rows.columns).alias("detail")).unionByName(named)


@query
def a1_sift_accounts(spark, sf):
    at = F.col("account_id") % 50
    rows = standin(spark, sf, "v_accounts").select(
        F.when(at == 7, F.concat(F.lit("id"), "account_id")).when(at != 9, F.col("account_id").cast("string")).alias("account_id"), "account_name",
        F.when(at == 17, "much").otherwise(F.col("arr").cast("string")).alias("arr"),
        F.when(at == 11, "2001-13-45").otherwise(F.col("contract_end_date").cast("string")).alias("contract_end_date"),
        "plan_tier", "industry", "csm_name", "region")
    return sifted(spark, sf, "accounts", rows, r"(Firm\d+)")


@query
def a4_sift_nps(spark, sf):
    at = F.col("account_id") % 20
    rows = standin(spark, sf, "v_nps").select(
        F.when(at == 3, F.concat("account_id", F.lit("?"))).otherwise(F.col("account_id").cast("string")).alias("account_id"),
        F.when(at == 5, "none").otherwise(F.col("score").cast("string")).alias("score"), F.concat(F.lit("c"), "account_id").alias("verbatim_comment"))
    return sifted(spark, sf, "nps", rows, r"(c\d+)")


@query
def a5_scan_note_blocks(spark, sf):
    path = scratch_dir(spark)
    (standin(spark, sf, "v_notes").orderBy("note_pos").select("raw_text")
     .write.option("lineSep", "\n---\n").text(path))
    return scan_note_blocks(spark, path)


@query
def a6_sdk_policy_table(spark, sf):
    return policy.apply_sdk_policy(standin(spark, sf, "v_usage").select("sdk_version"))


@query
def a7_table_bundle(spark, sf):
    t = standin_tables(spark, sf)
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
              for name, df in (("accounts", t.accounts), ("usage", t.usage), ("tickets", t.tickets),
                               ("nps", t.nps), ("notes", t.notes))]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out.withColumn("reference_date", F.lit(t.reference_date))


@query
def a8_report_sink(spark, sf):
    path = scratch_dir(spark)
    rows = stored(due(spark, sf))
    report.write_report(rows, insights.portfolio_insights(rows), path, REF, fmt="json")
    back = report.read_report(spark, path, "accounts", REF, "json", schemas.REPORT_ACCOUNT)
    return back.select("account_id", F.to_date("contract_end_date").alias("contract_end_date"), "risk_tier",
                       *r6s("risk_score", "usage_decline_score"), *joined("boosters_applied"),
                       r6(F.col("signal_breakdown")["nps_risk_score"]["contribution"]).alias("nps_part"))


@query
def a9_report_source(spark, sf):
    path = scratch_dir(spark)
    rows = stored(due(spark, sf))
    report.write_report(rows, insights.portfolio_insights(rows), path, REF, generated=REF)
    return report.read_report(spark, path, "meta", REF).select(
        F.col("reference_date").cast("date").alias("reference_date"), "window_days", "total_renewing",
        "total_arr_at_risk", "high_risk_count", "medium_risk_count", "low_risk_count")


@query
def a9_report_insights(spark, sf):
    path = scratch_dir(spark)
    rows = stored(due(spark, sf))
    report.write_report(rows, insights.portfolio_insights(rows), path, REF, generated=REF)
    return report.read_insights(spark, path, REF).select("insight_code", "n", "arr", "csm_name")


@query
def a9_report_document(spark, sf):
    """The accounts written as documents of the exchange format, eight of them, and read back."""
    path = scratch_dir(spark)
    rows = report.account_json(due(spark, sf).withColumns({"contract_end_date": F.col("contract_end_date").cast("string")}))
    rows = rows.select(F.pmod(F.xxhash64("account_id"), F.lit(8)).alias("k"), F.lit(1).alias("part"), F.concat(F.lit(","), "json").alias("value"))
    edges = spark.range(8).select(F.col("id").alias("k"), F.explode(F.array(
        F.struct(F.lit(0).alias("part"), F.lit('{"meta": {"window_days": 90}, "accounts": [{"account_id": -1}').alias("value")),
        F.struct(F.lit(2).alias("part"), F.lit("]}").alias("value")))).alias("e")).select("k", "e.*")
    (rows.unionByName(edges).repartition("k").sortWithinPartitions("k", "part").select("k", "value")
     .write.partitionBy("k").text(path))
    back = report.read_report_document(spark, path).where("account_id >= 0")
    return back.select("account_id", F.to_date("contract_end_date").alias("contract_end_date"), "risk_tier",
                       *r6s("risk_score", "usage_decline_score"), *joined("boosters_applied"),
                       r6(F.col("signal_breakdown")["nps_risk_score"]["contribution"]).alias("nps_part"))


@query
def a10_csv_export(spark, sf):
    path = scratch_dir(spark)
    report.export_csv(due(spark, sf), path)
    return spark.read.option("header", True).csv(path).select(
        "account_name", F.col("arr").cast("long").alias("arr"), F.to_date("contract_end_date").alias("contract_end_date"),
        F.col("risk_score").cast("double").alias("risk_score"), "risk_tier", "plan_tier", "latest_sdk_version",
        F.col("p1_open_count").cast("long").alias("p1_open_count"),
        F.col("silent_churn_flag").cast("boolean").alias("silent_churn_flag"))


# --- projections, filters, predicates -------------------------------------------------

@query
def b1_recent_tickets(spark, sf):
    return tickets.recent_tickets(standin(spark, sf, "v_tickets"), REF).select(
        "ticket_id", "account_id", "created_date", "priority", "status")


@query
def b2_filter_renewing(spark, sf):
    return scoring.by_risk(scoring.filter_renewing(scored(spark, sf), REF)).select(
        "account_id", "contract_end_date", *r6s("risk_score"), "risk_tier")


@query
def b3_portfolio_filter(spark, sf):
    return portfolio.portfolio_filter(
        scored(spark, sf), tiers=["High", "Medium"], regions=["AFRICA", "ASIA", "EUROPE"],
        industries=["BUILDING", "MACHINERY", "AUTOMOBILE"]).select("account_id", "risk_tier", "csm_name", "region", "industry")


@query
def b4_actionable_tiers(spark, sf):
    return insights.actionable(due(spark, sf)).select("account_id", "risk_tier")


@query
def b5_non_english_mask(spark, sf):
    return A.non_english(due(spark, sf)).select("account_id", "has_non_english")


@query
def b6_high_only(spark, sf):
    return insights.high_only(scored(spark, sf)).select("account_id", *r6s("risk_score"))


def report_with_gaps(spark, sf) -> DataFrame:
    """Renewals as a report in which some annotations are missing or failed."""
    i = F.col("account_id")
    return due(spark, sf).withColumns({
        "narrative_summary": F.when(i % 3 == 0, "").when(i % 3 == 1, "Risk data computed but narrative generation failed")
        .otherwise("A real text"),
        "risk_flags": F.when(i % 2 == 0, F.array(F.lit("flag"))).otherwise(F.lit(None)),
        "positive_signals": text.empty_list(),
        "narrative_risk_drivers": F.when(i % 4 == 0, F.array(F.lit("driver"))).otherwise(text.empty_list()),
        "narrative_actions": F.when(i % 5 == 0, F.array(F.lit("act"))).otherwise(F.lit(None)),
        "csm_recommended_action": F.when(i % 7 == 0, "call").when(i % 7 == 1, " ").otherwise(F.lit(None)),
        "detected_language": F.when(i % 4 == 0, "fr").when(i % 4 == 1, "English").when(i % 4 == 2, "").otherwise(F.lit(None)),
        "english_translation": F.when(i % 8 == 0, "translated").when(i % 8 == 4, "").otherwise(F.lit(None)),
    })


@query
def b7_enrichment_gaps(spark, sf):
    return gaps.gap_counts(report_with_gaps(spark, sf), insights.portfolio_insights(due(spark, sf)))


@query
def b8_is_real_narrative(spark, sf):
    return report_with_gaps(spark, sf).select(
        "account_id", text.is_real_narrative(F.col("narrative_summary")).alias("is_real"))


@query
def b9_v3_renewing(spark, sf):
    return insights.v3_renewing(due(spark, sf)).select("account_id", "latest_sdk_version")


@query
def b10_enterprise_detractors(spark, sf):
    return insights.enterprise_detractors(due(spark, sf)).select("account_id", "nps_score")


@query
def b11_silent_rows(spark, sf):
    return insights.silent_rows(scored(spark, sf)).select("account_id", "nps_score", *r6s("usage_decline_score"))


@query
def b12_card_flags(spark, sf):
    return portfolio.card_flags(due(spark, sf))


@query
def b13_display_fallbacks(spark, sf):
    shown = portfolio.display_fallbacks(report_with_gaps(spark, sf), "none yet")
    return shown.select("account_id", "shown_summary", *joined("shown_drivers", "shown_actions"))


@query
def b14_translated_view(spark, sf):
    return portfolio.translated_view(report_with_gaps(spark, sf))


# --- joins and lookups --------------------------------------------------------------------

@query
def c1_join_usage(spark, sf):
    t = standin_tables(spark, sf)
    return t.accounts.join(usage.usage_features(t.usage, True), "account_id", "left").select(
        "account_id", "account_name", "latest_sdk_version", *r6s("usage_decline_score"))


@query
def c2_join_tickets(spark, sf):
    t = standin_tables(spark, sf)
    return t.accounts.join(tickets.ticket_features(t.tickets, REF), "account_id", "left").select(
        "account_id", "ticket_count_total", *r6s("support_health_score", "avg_resolution_hours"))


@query
def c3_join_nps(spark, sf):
    t = standin_tables(spark, sf)
    # every third account answers twice: the join repeats it
    twice = t.nps.unionByName(t.nps.where("account_id % 3 = 0").withColumn("score", F.lit(10.0)))
    return FE.join_surveys(t.accounts, surveys.nps_features(twice)).select(
        "account_id", "region", "nps_score", *r6s("nps_risk_score"))


@query
def c4_join_defaults(spark, sf):
    return scored(spark, sf).select("account_id", "p1_open_count", "ticket_count_total", "open_ticket_count",
                                    *r6s("usage_decline_score", "support_health_score", "nps_risk_score"))


@query
def c5_join_notes(spark, sf):
    t = standin_tables(spark, sf)
    own = FE.account_notes(t.notes, t.accounts)
    counts = FE.attach_count(t.accounts.select("account_id"), own, "account_id", "note_count")
    return counts.join(own, "account_id", "left").select(
        "account_id", "note_pos", "raw_text", "note_count", (F.col("note_count") > 0).alias("has_csm_notes"))


def note_texts(spark, sf) -> DataFrame:
    return standin(spark, sf, "v_note_texts").select("note_pos", "raw_text")


@query
def c6_resolve_explicit(spark, sf):
    return resolve.resolve_explicit(note_texts(spark, sf), standin(spark, sf, "v_accounts"))


@query
def c7_resolve_fuzzy(spark, sf):
    notes = note_texts(spark, sf)
    left = notes.where(resolve.explicit_id(F.col("raw_text")).isNull())
    return resolve.resolve_fuzzy(left, standin(spark, sf, "v_accounts"), case_sensitive=True).select(
        "note_pos", "account_id", "account_name", *r6s("match_score"))


@query
def c8_resolve_first_word(spark, sf):
    return resolve.resolve_first_word(note_texts(spark, sf), standin(spark, sf, "v_accounts"))


@query
def c9_resolve_notes(spark, sf):
    return resolve.resolve_notes(note_texts(spark, sf), standin(spark, sf, "v_accounts"), texts=False)


def note_annotations(spark, sf) -> DataFrame:
    return signals.note_signals(standin(spark, sf, "v_notes"))


@query
def c10_annotation_lookup(spark, sf):
    base = standin(spark, sf, "v_accounts").select("account_id")
    found = note_annotations(spark, sf)
    return A.annotation_lookup(base, found, A.NOTE_DEFAULTS()).select(
        "account_id", *r6s("csm_sentiment_score"), *joined("risk_flags", "positive_signals"))


@query
def c11_upsert_by_id(spark, sf):
    # orders as a change log per customer: last order wins at the first one's position
    log = standin(spark, sf, "v_tickets").select("account_id", F.col("ticket_id").alias("pos"), "priority", "status")
    base = merge.last_by_key(log, "account_id", "pos")
    updates = standin(spark, sf, "v_nps").where("account_id % 2 = 0").select(
        "account_id", F.lit("Reviewed").alias("status"))
    return merge.upsert_by_id(base, updates, ["status"]).select("account_id", "pos", "priority", "status")


@query
def c11_upsert_parted(spark, sf):
    """The same upsert on a stored table, of which only the parts with changed rows are written anew."""
    log = standin(spark, sf, "v_tickets").select("account_id", F.col("ticket_id").alias("pos"), "priority", "status")
    base, path = merge.last_by_key(log, "account_id", "pos"), scratch_dir(spark)
    parted.write_parted(base, path, parts=16)
    updates = standin(spark, sf, "v_nps").where("account_id % 2 = 0").select("account_id", F.lit("Reviewed").alias("status"))
    parted.upsert_parted(spark, path, base.schema, updates, ["status"])
    return parted.read_parted(spark, path, base.schema).select("account_id", "pos", "priority", "status")


@query
def c12_concat_columns(spark, sf):
    t = standin_tables(spark, sf)
    return scoring.score_accounts(FE.build_features(t)).select(
        "account_id", "account_name", *r6s("csm_sentiment_score", "risk_score", "base_score"))


# --- aggregations ----------------------------------------------------------------------------

@query
def d1_usage_slopes(spark, sf):
    return usage.usage_slopes(positions(spark, sf)).select("account_id", *r6s(*usage.METRICS.values()))


@query
def d2_usage_step_drop(spark, sf):
    return usage.usage_step_drop(positions(spark, sf)).select("account_id", *r6s("usage_step_drop"))


@query
def d3_usage_decline(spark, sf):
    return usage.usage_features(standin(spark, sf, "v_usage"), True).select("account_id", *r6s("usage_decline_score"))


@query
def d4_usage_levels(spark, sf):
    return usage.usage_levels(positions(spark, sf)).select(
        "account_id", "latest_sdk_version", "latest_active_users", *r6s("avg_api_calls_6m", "avg_active_users"))


@query
def d5_usage_series(spark, sf):
    return usage.usage_series(positions(spark, sf)).withColumn("pos", F.col("pos").cast("long"))


@query
def d6_ticket_weights(spark, sf):
    return standin(spark, sf, "v_tickets").select(
        "ticket_id", "priority", "status", r6(tickets.ticket_weight()).alias("weight"))


@query
def d7_ticket_features(spark, sf):
    return tickets.ticket_features(standin(spark, sf, "v_tickets"), REF).select(
        "account_id", "ticket_count_total", "p1_open_count", "open_ticket_count",
        *r6s("support_health_score", "avg_resolution_hours"))


@query
def d8_ticket_subjects(spark, sf):
    t = standin_tables(spark, sf)
    own = FE.account_subjects(t, t.accounts)
    return FE.with_subject_count(t.accounts.select("account_id"), own).join(own, "account_id", "left")


@query
def d9_csm_concentration(spark, sf):
    return insights.csm_concentration(due(spark, sf))


@query
def d9_csm_concentration_accounts(spark, sf):
    return insights.csm_concentration_accounts(due(spark, sf)).select("csm_name", "account_id", "account_name")


@query
def d10_arr_by_csm(spark, sf):
    return portfolio.arr_by_csm(due(spark, sf))


@query
def d11_tier_counts(spark, sf):
    return portfolio.tier_counts(scored(spark, sf))


@query
def d12_sdk_by_tier(spark, sf):
    return portfolio.sdk_by_tier(scored(spark, sf))


@query
def d13_score_histogram(spark, sf):
    return portfolio.score_histogram(scored(spark, sf)).withColumn("bin", F.col("bin").cast("long"))


@query
def d14_portfolio_totals(spark, sf):
    return insights.tier_totals(due(spark, sf))


@query
def d15_filter_domains(spark, sf):
    return portfolio.filter_domains(due(spark, sf))


@query
def d16_load_audit(spark, sf):
    t = standin_tables(spark, sf)
    return portfolio.load_audit(t).unionByName(
        scored(spark, sf).agg(F.count_if("silent_churn_flag").alias("value"))
        .select(F.lit("silent_flags").alias("metric"), "value"))


@query
def d17_report_audit(spark, sf):
    return gaps.report_audit(report_with_gaps(spark, sf), insights.portfolio_insights(due(spark, sf)))


@query
def d18_v3_exposure(spark, sf):
    return insights.exposure(insights.v3_renewing(due(spark, sf)))


@query
def d19_silent_cluster(spark, sf):
    return insights.exposure(insights.silent_rows(due(spark, sf))).select("n")


@query
def d20_detractor_exposure(spark, sf):
    return insights.exposure(insights.enterprise_detractors(due(spark, sf)))


@query
def d18_d20_insight_members(spark, sf):
    return insights.insight_members(due(spark, sf))


# --- windows, sorts, limits ---------------------------------------------------------------------

@query
def e1_month_position(spark, sf):
    return positions(spark, sf).select("account_id", "month", F.col("pos").cast("long").alias("pos"), "n")


@query
def e1_month_position_skew_safe(spark, sf):
    # the detour for usage tables without a promise of one row per account and month
    rows = usage.month_positions(standin(spark, sf, "v_usage"), unique_months=False)
    return rows.select("account_id", "month", F.col("pos").cast("long").alias("pos"), "n")


@query
def e2_latest_row(spark, sf):
    return usage.latest_rows(standin(spark, sf, "v_usage")).select(
        "account_id", "month", "api_calls", "active_users", "sdk_version")


@query
def e3_rank_by_risk(spark, sf):
    return scoring.by_risk(scoring.rank_by_risk(scored(spark, sf))).select("account_id", *r6s("risk_score"), "risk_rank")


@query
def e4_top_signals(spark, sf):
    top = scoring.top_signals(F.col("signals"), 3)
    return scored(spark, sf).select("account_id", F.array_join(top, "|").alias("top_signals"))


@query
def e5_top20_high(spark, sf):
    return A.top_high(scored(spark, sf)).select("account_id", *r6s("risk_score"))


@query
def e6_list_caps(spark, sf):
    return note_annotations(spark, sf).select(
        "account_id", F.size("risk_flags").cast("long").alias("n_flags"),
        F.size("positive_signals").cast("long").alias("n_positives"), *joined("risk_flags", "positive_signals"))


@query
def e7_silent_spotlight(spark, sf):
    return portfolio.silent_spotlight(scored(spark, sf))


@query
def e8_head_views(spark, sf):
    return portfolio.head_view(due(spark, sf))


@query
def e9_text_cap(spark, sf):
    return A.first_note_text(standin(spark, sf, "v_notes"))


# --- scalar functions: dates and math --------------------------------------------------------------

@query
def g1_note_date_token(spark, sf):
    block = F.col("raw_text")
    return note_texts(spark, sf).select(
        "note_pos", dates.note_date_token(block).alias("token"),
        dates.note_date_token(block, narrow_slash=True).alias("narrow_token"))


@query
def g2_parse_note_date(spark, sf):
    return dated_orders(spark, sf).select("o_orderkey", dates.parse_note_date(F.col("token")).alias("note_date"))


def dated_orders(spark, sf) -> DataFrame:
    """The order dates written in eight styles, two of them impossible."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 8
    fmt = lambda pattern: F.date_format(d, pattern)
    return raw(spark, sf, "orders").select("o_orderkey", (
        F.when(k == 0, fmt("yyyy-MM-dd")).when(k == 1, fmt("M/d")).when(k == 2, fmt("MM/dd/yy"))
        .when(k == 3, fmt("M/d/yyyy")).when(k == 4, fmt("MMM d")).when(k == 5, F.lower(fmt("MMMM d yyyy")))
        .when(k == 6, "2/30").otherwise("soon 12")).alias("token"))


@query
def g3_days_to_renewal(spark, sf):
    return standin(spark, sf, "v_accounts").select(
        "account_id", dates.days_to(F.col("contract_end_date"), F.lit(REF)).cast("long").alias("days_to_renewal"))


@query
def g4_renewal_urgency(spark, sf):
    days = dates.days_to(F.col("contract_end_date"), F.lit(REF))
    return standin(spark, sf, "v_accounts").select("account_id", dates.renewal_urgency(days).alias("urgency"))


@query
def g5_nps_risk(spark, sf):
    # halves and quarters too, so every branch is met
    return standin(spark, sf, "v_nps").withColumn("score", F.col("score") - (F.col("account_id") % 4) * 0.125).select(
        "account_id", r6(risk.nps_risk(F.col("score"))).alias("nps_risk"))


@query
def g6_sdk_risk(spark, sf):
    return sdk_variants(spark, sf).select("event_id", "version", risk.sdk_risk(F.col("version")).alias("sdk_risk"))


def sdk_variants(spark, sf) -> DataFrame:
    """A version text per event: plain, padded, upper-case, unlisted, empty and missing."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int") % 12
    names = ["v4.3.0", "v4.1.0", "v4.2.3", "v4.0.0", "v3.2.0", " V3.1.2 ", "v4.2.0", "v4.2.1", "V4.3.9", "v5.0", ""]
    version = F.when(k == 0, names[0])
    for i, name in enumerate(names[1:], 1):
        version = version.when(k == i, name)
    return raw(spark, sf, "events").select("event_id", version.alias("version"))


@query
def g7_clip_round(spark, sf):
    part = F.col("l_extendedprice") * F.col("l_discount") / 5000 - 0.2
    return raw(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        r6(F.avg(clip01(part))).alias("mean_clipped"), F.round(F.avg(clip01(part)), 1).alias("one_digit"),
        F.count_if(clip01(part) == 1).alias("at_top"), F.count_if(clip01(part) == 0).alias("at_bottom"))


@query
def g8_arr_millions(spark, sf):
    return portfolio.arr_scatter(due(spark, sf)).select(
        "account_id", *r6s("risk_score", "arr_m"), "risk_tier", "plan_tier", "csm_name",
        F.col("days_to_renewal").cast("long").alias("days_to_renewal"))


@query
def g9_progress_pct(spark, sf):
    return portfolio.signal_bars(scored(spark, sf)).select(
        "account_id", "signal", F.col("pct").cast("long").alias("pct"), "band")


# --- scalar functions: strings, arrays, maps, JSON ----------------------------------------------------

@query
def h1_clean_header(spark, sf):
    return note_texts(spark, sf).select("note_pos", text.clean_header(F.col("raw_text")).alias("header"))


@query
def h2_has_non_english(spark, sf):
    return raw(spark, sf, "documents").select(
        "doc_id", text.has_non_english(F.col("text")).alias("has_non_english"))


@query
def h3_keyword_hits(spark, sf):
    return signals.keyword_hits(standin(spark, sf, "v_notes")).select(
        "account_id", *joined("negative", "positive", "competitor", "executive"))


@query
def h4_money_short(spark, sf):
    return standin(spark, sf, "v_accounts").select(
        "account_id", text.money_short(F.col("arr")).alias("arr_text"),
        text.money_short(F.col("arr") * 7).alias("arr_text_7"), text.money_short(F.col("arr") % 1000).alias("small_text"))


@query
def h5_nps_text(spark, sf):
    return standin(spark, sf, "v_nps").select("account_id", text.nps_text(F.col("score")).alias("nps_text"))


@query
def h6_decline_pct_text(spark, sf):
    return scored(spark, sf).select("account_id", text.decline_pct_text(F.round("usage_decline_score", 6)).alias("decline_text"))


@query
def h7_sdk_label(spark, sf):
    version = F.col("version")
    return sdk_variants(spark, sf).select(
        "event_id", text.sdk_score_label(risk.sdk_risk(version)).alias("score_label"),
        text.sdk_exact_label(risk.sdk_risk(version)).alias("exact_label"), text.sdk_display_label(version).alias("display_label"))


@query
def h8_signal_labels(spark, sf):
    bars = portfolio.signal_bars(scored(spark, sf))
    return bars.select("account_id", "signal", "label", text.top_signal_label(F.col("signal")).alias("top_label"))


@query
def h9_breakdown_map(spark, sf):
    return scored(spark, sf).select("account_id", F.explode("signal_breakdown").alias("signal", "part")).select(
        "account_id", "signal", *[r6(F.col(f"part.{c}")).alias(c) for c in ("raw_value", "weight", "contribution")])


@query
def h10_json_text_to_list(spark, sf):
    doc = F.col("text")
    given = (F.when(F.col("doc_id") % 3 == 0, F.to_json(F.array(doc, F.lit("second"))))
             .when(F.col("doc_id") % 3 == 1, doc).otherwise("[]"))
    items = text.json_text_to_list(given)
    return raw(spark, sf, "documents").select(
        "doc_id", F.size(items).cast("long").alias("n"), F.array_join(items, "|").alias("items"))


def reply_texts(spark, sf) -> DataFrame:
    """Annotator replies about whole documents in six shapes: plain, fenced, chatty, trailing comma, prose, empty."""
    i = F.col("doc_id")
    body = F.to_json(F.struct(
        (i % 5 / 4.0).alias("sentiment_score"), F.array(F.lit("flag"), F.col("lang")).alias("risk_flags"),
        F.array(F.col("source")).alias("positive_signals"), F.col("text").alias("key_stakeholder_concern")))
    loose = F.concat(F.lit('{"sentiment_score": 0.25, "risk_flags": ["a", "b",], "positive_signals": [],}'))
    reply = (F.when(i % 6 == 0, body)
             .when(i % 6 == 1, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\nbye")))
             .when(i % 6 == 2, F.concat(F.lit("Sure. "), body, F.lit(" Done.")))
             .when(i % 6 == 3, F.concat(F.lit("x "), loose)).when(i % 6 == 4, F.lit("I cannot help.")).otherwise(""))
    return raw(spark, sf, "documents").select(i.alias("account_id"), reply.alias("reply"))


@query
def h11_reply_to_struct(spark, sf):
    return A.notes_from_replies(reply_texts(spark, sf)).select(
        "account_id", "parsed", *r6s("csm_sentiment_score"), *joined("risk_flags", "positive_signals"),
        F.coalesce(F.length("key_stakeholder_concern"), F.lit(0)).cast("long").alias("concern_length"))


@query
def h12_sentiment_to_risk(spark, sf):
    sentiment = F.when(F.col("toxic").isNotNull(), (F.col("quality") + F.col("doc_id") % 7 / 7.0) / 2)
    labels = raw(spark, sf, "labels")
    docs = raw(spark, sf, "documents").select("doc_id")
    return docs.join(labels, "doc_id", "left").select("doc_id", r6(A.sentiment_to_risk(sentiment)).alias("risk"))


# --- scoring and decisions ----------------------------------------------------------------------------

@query
def i1_silent_churn(spark, sf):
    return scored(spark, sf).select("account_id", "silent_churn_flag")


FEATURES = ["api_calls_slope_risk", "active_users_slope_risk", "workflow_slope_risk", "usage_step_drop",
            "usage_decline_score", "avg_api_calls_6m", "avg_active_users", "avg_resolution_hours",
            "support_health_score", "nps_risk_score", "sdk_risk_score", "renewal_urgency_score"]


@query
def i2_build_features(spark, sf):
    return FE.build_features(standin_tables(spark, sf)).select(
        *PORTFOLIO_COLUMNS, *r6s(*FEATURES), "latest_sdk_version", "latest_active_users", "ticket_count_total",
        "p1_open_count", "open_ticket_count", "nps_score", "has_non_english", "has_csm_notes", "silent_churn_flag",
        F.col("days_to_renewal").cast("long").alias("days_to_renewal"))


@query
def i3_risk_score(spark, sf):
    # own weights: a signal nobody has counts as 0, the sum is clipped
    weights = {"usage_decline_score": 0.6, "nps_risk_score": 0.5, "sdk_risk_score": 0.2, "unheard_of": 0.3}
    return scoring.score_accounts(FE.build_features(standin_tables(spark, sf)), weights).select(
        "account_id", *r6s("risk_score", "base_score", "total_boost"), "risk_tier")


@query
def i4_score_all(spark, sf):
    return scored(spark, sf).select("account_id", *r6s("risk_score", "base_score", "total_boost"), "risk_tier",
                                    *joined("boosters_applied"))


@query
def i4_score_landed(spark, sf):
    """The same scores from landing tables."""
    prefix = f"landed_{uuid.uuid4().hex}"
    t = landing.land(standin_tables(spark, sf), scratch_dir(spark), prefix, buckets=16)
    return renewals.scored_accounts(t).select("account_id", *r6s("risk_score", "base_score", "total_boost"), "risk_tier",
                                              *joined("boosters_applied"))


@query
def i5_rescore(spark, sf):
    t = standin_tables(spark, sf)
    rows = A.annotation_lookup(renewals.renewing_accounts(t), signals.note_signals(renewals.renewing_notes(t)), A.NOTE_DEFAULTS())
    return scoring.by_risk(scoring.score_accounts(rows)).select(
        "account_id", *r6s("csm_sentiment_score", "risk_score", "base_score"), "risk_tier")


@query
def i6_portfolio_insights(spark, sf):
    return insights.portfolio_insights(due(spark, sf)).select("insight_code", "n", "arr", "csm_name")


@query
def i6_executive_summary(spark, sf):
    return insights.executive_summary(due(spark, sf)).select("total_renewing", "high_risk_count", "executive_summary")


@query
def i7_note_signals(spark, sf):
    return note_annotations(spark, sf).select(
        "account_id", *r6s("csm_sentiment_score"), *joined("risk_flags", "positive_signals"),
        "executive_keyword", "action_code", "key_stakeholder_concern", "csm_recommended_action")


@query
def i8_account_narrative(spark, sf):
    return due(spark, sf).select(
        "account_id", F.array_join(N.driver_codes(), "|").alias("drivers"),
        F.array_join(N.action_codes(), "|").alias("actions"), N.summary_code().alias("summary"),
        N.urgency_code().alias("urgency"))


# --- annotation ------------------------------------------------------------------------------------------

@query
def j1_annotate_notes(spark, sf):
    t = standin_tables(spark, sf)
    return A.annotate_notes(t.accounts, t.notes).select(
        "account_id", *r6s("csm_sentiment_score"), *joined("risk_flags", "positive_signals"))


def described(row):
    """A caller's function: what can be counted in a list of notes."""
    texts = list(row["csm_notes_raw"])
    return {"csm_sentiment_score": len(texts) / 4, "risk_flags": [f"{len(t)} characters" for t in texts],
            "positive_signals": [f"{len(texts)} notes"], "key_stakeholder_concern": f"part {row['chunk_no']}"}


@query
def j1_annotate_notes_by_function(spark, sf):
    """A caller's function on lists of three notes."""
    t = standin_tables(spark, sf)
    return A.annotate_notes(t.accounts, t.notes, described, notes_per_call=3).select(
        "account_id", *r6s("csm_sentiment_score"), *joined("risk_flags", "positive_signals"), "key_stakeholder_concern")


@query
def j1_note_labels(spark, sf):
    """The labels of the same calls as rows."""
    t = standin_tables(spark, sf)
    return A.note_labels(A.note_calls(owned(t.notes, t.accounts), described, notes_per_call=3))


@query
def j2_annotate_nps(spark, sf):
    rows = A.non_english(due(spark, sf))
    return A.annotate_nps(rows).select("account_id", "english_translation", "detected_language", "sentiment_alignment")


@query
def j2_annotate_nps_by_function(spark, sf):
    """A caller's function on every response; each account answers twice."""
    t = standin_tables(spark, sf)
    twice = surveys.nps_features(t.nps.unionByName(t.nps.withColumn("score", F.lit(10.0))))
    fn = lambda row: {"english_translation": f"{len(row['verbatim_comment'])} characters", "detected_language": f"{row['nps_score']:.0f}"}
    found = A.annotate_nps(twice.where(F.col("nps_score").isNotNull()), fn)
    return found.select("account_id", "nps_score", "english_translation", "detected_language")


@query
def j3_annotate_account(spark, sf):
    return A.narrate(due(spark, sf)).select(
        "account_id", "risk_tier", (F.col("narrative_summary") != "").alias("has_text"),
        F.size("narrative_risk_drivers").cast("long").alias("n_drivers"),
        F.size("narrative_actions").cast("long").alias("n_actions"))


@query
def j4_annotate_portfolio(spark, sf):
    return A.annotate_portfolio(due(spark, sf)).select("insight_code", "title", "n", "arr")


@query
def j5_briefing_table(spark, sf):
    t = standin_tables(spark, sf)
    return A.briefings(renewals.analysed_renewals(t), renewals.renewing_notes(t))


@query
def j6_portfolio_lines(spark, sf):
    return A.portfolio_lines(scored(spark, sf))


@query
def j7_enrich_missing(spark, sf):
    t = standin_tables(spark, sf)
    filled = gaps.enrich_missing(report_with_gaps(spark, sf), t.notes, progress=scratch_dir(spark))
    return filled.select("account_id", *r6s("csm_sentiment_score", "risk_score"), "risk_tier",
                         text.is_real_narrative(F.col("narrative_summary")).alias("has_narrative"),
                         *joined("risk_flags"), "english_translation")


@query
def j8_analyse_portfolio(spark, sf):
    t = standin_tables(spark, sf)
    return renewals.analysed_renewals(t).select("account_id", *r6s("csm_sentiment_score", "risk_score"), "risk_tier", "detected_language",
                       *joined("risk_flags"), (F.col("narrative_summary") != "").alias("has_text"))
