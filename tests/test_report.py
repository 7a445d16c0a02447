"""Annotators, gap filling, report files and the whole job on small inputs."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from riskspark.functions.replies import reply_to_struct
from riskspark.functions.text import is_real_narrative
from riskspark.operators import annotate as A
from riskspark.operators import gaps, insights, portfolio
from riskspark.plans import renewals
from riskspark.scratch import stored
from riskspark.sources import report, standins, tables

REF = standins.REF
SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def bundle(spark):
    return standins.standin_tables(spark, SF_DIR)


@pytest.fixture(scope="module")
def due(spark, bundle):
    rows = renewals.renewing_accounts(bundle).persist()
    yield rows
    rows.unpersist()


REPLIES = {
    "plain": '{"sentiment_score": 0.25, "risk_flags": ["a"]}',
    "fenced": 'Sure:\n```json\n{"sentiment_score": 0.25, "risk_flags": ["a"]}\n```\nBye {x}',
    "chatty": 'Here it is {"sentiment_score": "0.25", "risk_flags": ["a"]} hope it helps',
    "comma": '{"sentiment_score": 0.25, "risk_flags": ["a",],}',
    "quotes": "{'sentiment_score': 0.25}",
    "array": '[{"sentiment_score": 0.25}]',
    "prose": "cannot say", "empty": "", "none": None,
}


def test_replies(spark):
    df = spark.createDataFrame(list(REPLIES.items()), "name string, reply string")
    got = {r["name"]: r["r"] for r in df.select("name", reply_to_struct(F.col("reply"), A.REPLY_FIELDS).alias("r")).collect()}
    for name in ("plain", "fenced", "chatty", "comma"):
        assert float(got[name]["sentiment_score"]) == 0.25 and got[name]["risk_flags"] == ["a"], name
    for name in ("quotes", "prose", "empty", "none"):
        assert got[name] is None, name
    # the outermost braces of a list of one object are an object
    assert float(got["array"]["sentiment_score"]) == 0.25


def test_own_note_annotator_and_its_failures(spark):
    accounts = spark.createDataFrame([(1,), (2,), (3,)], "account_id long")
    notes = spark.createDataFrame([(1, 0, "b"), (1, 1, "a"), (2, 2, "fail"), (8, 3, "x")], "account_id long, note_pos long, raw_text string")

    def fn(row):
        if "fail" in row["csm_notes_raw"]:
            raise ValueError("no")
        return {"csm_sentiment_score": 0.9, "risk_flags": list(row["csm_notes_raw"]), "positive_signals": []}

    got = {r["account_id"]: (r["csm_sentiment_score"], r["risk_flags"]) for r in A.annotate_notes(accounts, notes, fn).collect()}
    assert got == {1: (0.9, ["b", "a"]), 2: (0.5, [])}
    each = {r["account_id"]: r["risk_flags"] for r in A.annotate_notes(accounts, notes, fn, notes_per_call=1).collect()}
    assert each == {1: ["b", "a"], 2: []}
    merged = A.annotation_lookup(accounts, A.annotate_notes(accounts, notes, fn), A.NOTE_DEFAULTS()).orderBy("account_id").collect()
    assert [(r["csm_sentiment_score"], r["risk_flags"]) for r in merged] == [(0.9, ["b", "a"]), (0.5, []), (0.5, [])]


def test_calls_of_one_account_are_merged(spark):
    fields = A.NOTE_CALL_FIELDS
    calls = spark.createDataFrame([
        (1, 0.2, ["a", "b"], None, None, "call", 0, 3), (1, 0.8, ["b", "c", None], ["p"], "later", "wait", 1, 1),
        (2, None, None, None, None, None, 0, 1)], fields)
    got = {r["account_id"]: tuple(r)[1:] for r in A.merge_note_calls(calls).collect()}
    assert got == {1: (0.35, ["a", "b", "c"], ["p"], "later", "call"), 2: (None, [], [], None, None)}
    counts = {r["account_id"]: tuple(r)[1:] for r in A.merge_note_calls(calls, lists=False).collect()}
    assert counts == {1: (0.35, 3, 1, "later", "call"), 2: (None, 0, 0, None, None)}
    assert sorted(map(tuple, A.note_labels(calls).collect())) == [
        (1, "flag", 0, 0, "a"), (1, "flag", 0, 1, "b"), (1, "flag", 1, 1, "c"), (1, "positive", 1, 0, "p")]


def test_every_response_of_an_account_keeps_its_own_annotation(spark):
    rows = spark.createDataFrame([(1, 2.0, "mauvais"), (1, 9.0, "tres bien"), (1, None, "sans"), (1, None, "sans"), (2, 3.0, None)],
                                 "account_id long, nps_score double, verbatim_comment string").withColumn("has_non_english", F.lit(True))
    got = A.translate(rows, lambda row: {"english_translation": row["verbatim_comment"].upper(), "detected_language": "fr"})
    assert sorted((r["account_id"], r["verbatim_comment"] or "", r["english_translation"]) for r in got.collect()) == [
        (1, "mauvais", "MAUVAIS"), (1, "sans", "SANS"), (1, "sans", "SANS"), (1, "tres bien", "TRES BIEN"), (2, "", "")]


def test_own_comment_annotator(spark):
    rows = spark.createDataFrame([(1, 5.0, "bon"), (2, 5.0, " "), (3, None, "bad")], "account_id long, nps_score double, verbatim_comment string")

    def fn(row):
        if row["verbatim_comment"] == "bad":
            raise RuntimeError
        return {"english_translation": "good", "detected_language": "fr", "nps_key_themes": ["t"], "sentiment_alignment": "misaligned"}

    got = {r["account_id"]: (r["english_translation"], r["detected_language"]) for r in A.annotate_nps(rows, fn).collect()}
    assert got == {1: ("good", "fr"), 2: ("", "en"), 3: ("bad", "unknown")}


def test_own_account_annotator_sees_the_briefing(spark, bundle, due):
    def fn(row):
        assert row["briefing"].startswith("Account: ")
        return {"narrative_summary": "mine " + row["account_name"], "narrative_risk_drivers": [], "narrative_actions": []}

    rows = A.analyse(due, bundle.notes, account_fn=fn).collect()
    for r in rows:
        assert r["narrative_summary"] == ("" if r["risk_tier"] == "Low" else "mine " + r["account_name"])
    assert any(r["risk_tier"] != "Low" for r in rows)


def test_failed_account_annotator_leaves_a_placeholder(spark, due):
    rows = A.narrate(due.withColumn("risk_flags", F.array(F.lit("f"))), lambda row: 1 / 0)
    bad = rows.where("risk_tier <> 'Low'")
    assert bad.where(is_real_narrative(F.col("narrative_summary"))).count() == 0 < bad.count()
    assert bad.first()["narrative_risk_drivers"] == ["f"]


def test_portfolio_annotator(spark, due):
    seen = A.annotate_portfolio(due, lambda facts: {"insights": [{"title": str(facts["total_renewing"]), "affected_accounts": ["x"]}]})
    row = seen.first()
    assert int(row["title"]) == due.count() and row["affected_accounts"] == ["x"]
    assert A.annotate_portfolio(due, lambda facts: 1 / 0).count() == 0


def test_gap_fill_resumes(spark, bundle, due, tmp_path):
    calls = spark.sparkContext.accumulator(0)
    report_rows = due.withColumns({
        "narrative_summary": F.when(F.col("account_id") % 2 == 0, "done").otherwise(""), "narrative_risk_drivers": F.lit(None).cast("array<string>"),
        "narrative_actions": F.lit(None).cast("array<string>"), "narrative_urgency": F.lit(""), "risk_flags": F.lit(None).cast("array<string>"),
        "positive_signals": F.lit(None).cast("array<string>"), "key_stakeholder_concern": F.lit(None).cast("string"),
        "csm_recommended_action": F.lit(None).cast("string"), "english_translation": F.lit(""), "detected_language": F.lit("en"),
        "nps_key_themes": F.lit(None).cast("array<string>"), "sentiment_alignment": F.lit(""), "alignment_note": F.lit("")})

    def fn(row):
        calls.add(1)
        return {"narrative_summary": "filled", "narrative_risk_drivers": ["d"], "narrative_actions": [], "narrative_urgency": ""}

    def fill():
        return {r["account_id"]: r["narrative_summary"] for r in gaps.enrich_missing(
            report_rows, bundle.notes, str(tmp_path / "progress"), account_fn=fn).collect()}

    first = fill()
    used = calls.value
    assert used == sum(1 for a in first if a % 2) and set(first.values()) == {"done", "filled"}
    assert fill() == first and calls.value == used  # nothing is asked twice


def test_failed_calls_are_made_again(spark, bundle, due, tmp_path, monkeypatch):
    """A function that fails at first and answers later; answers stay, failures leave a trace and are tried again."""
    monkeypatch.setattr(gaps, "CALL_BATCHES", 2)
    report_rows = stored(A.analyse(due, bundle.notes).withColumn("narrative_summary", F.lit("")))
    notes = stored(bundle.notes)
    folder = str(tmp_path / "progress")

    def down(row):
        raise ConnectionError("no route")

    def half(row):
        return {"narrative_summary": f"answer {row['account_id']}"} if row["account_id"] % 2 else None

    fill = lambda fn, **more: {r["account_id"]: r["narrative_summary"] for r in gaps.enrich_missing(
        report_rows, notes, folder, account_fn=fn, **more).collect()}
    ledger = lambda: {(r["account_id"], r["attempt"]): (r["call_status"], r["call_error"]) for r in gaps.call_ledger(spark, folder, "narratives").collect()}
    first = fill(down)
    assert len(first) > 4 and all("narrative generation failed" in t for t in first.values())
    assert ledger() == {(a, 1): ("failed", "ConnectionError: no route") for a in first}
    second = fill(half)
    assert all((t == f"answer {a}") == (a % 2 == 1) for a, t in second.items())
    calls = ledger()
    assert all(calls[a, 2] == (("ok", None) if a % 2 else ("failed", "TypeError: expected a dictionary, got NoneType")) for a in first)
    assert fill(down, attempts=2) == second and ledger() == calls  # enough attempts; answers are never asked for again
    last = fill(lambda row: {"narrative_summary": "late"})
    assert all(t == (f"answer {a}" if a % 2 else "late") for a, t in last.items())
    assert set(ledger()) - set(calls) == {(a, 3) for a in first if a % 2 == 0}


def test_outcomes_of_every_annotator(spark, due):
    def odd(row):
        if row["account_id"] % 2:
            raise ValueError("odd")
        return {}

    accounts = spark.createDataFrame([(1,), (2,)], "account_id long")
    notes = spark.createDataFrame([(a, p, "x") for a in (1, 2) for p in range(3)], "account_id long, note_pos long, raw_text string")
    status = lambda df: {r["account_id"]: (r["call_status"], r["call_error"]) for r in df.collect()}
    want = {1: ("failed", "ValueError: odd"), 2: ("ok", None)}
    assert status(A.annotate_notes(accounts, notes, odd, 2, outcomes=True)) == want
    assert set(status(A.annotate_notes(accounts, notes, outcomes=True)).values()) == {("ok", None)}
    responses = accounts.withColumns({"nps_score": F.lit(1.0), "verbatim_comment": F.lit("bien")})
    assert status(A.annotate_nps(responses, odd, outcomes=True)) == want
    blank = A.annotate_nps(responses.withColumn("verbatim_comment", F.lit(" ")), odd, outcomes=True)
    assert set(status(blank).values()) == {("ok", None)}
    failed = A.annotate_portfolio(due, lambda facts: 1 / 0, outcomes=True).collect()
    assert [(r["title"], r["call_status"], r["call_error"]) for r in failed] == [(None, "failed", "ZeroDivisionError: division by zero")]


def test_report_round_trip(spark, bundle, due, tmp_path):
    path = str(tmp_path / "report")
    renewals.run_report(bundle, path)
    renewals.run_report(bundle.with_(reference_date=date(2001, 9, 1)), path)  # another date beside it
    back = report.read_report(spark, path, ref=REF)
    assert back.count() == due.count() and report.read_report(spark, path).select("reference_date").distinct().count() == 2
    meta = report.read_report(spark, path, "meta", REF).first()
    assert meta["total_renewing"] == due.count()
    found = report.read_report(spark, path, "portfolio_insights", REF).collect()
    members = report.read_report(spark, path, "insight_members", REF).groupBy("insight_code").count().collect()
    assert {r["insight_code"]: r["n"] for r in found} == {r["insight_code"]: r["count"] for r in members}
    some = report.account_json(back.limit(3)).first()
    parsed = json.loads(some["json"])
    assert parsed["account_id"] == some["account_id"] and isinstance(parsed["boosters_applied"], list)
    renewals.run_enrichment(spark, bundle, path, str(tmp_path / "filled"), portfolio_fn=lambda facts: 1 / 0)
    filled = report.read_report(spark, str(tmp_path / "filled"), ref=REF)
    kept = report.read_insights(spark, str(tmp_path / "filled"), REF)
    counts = gaps.gap_counts(filled, kept).first()
    assert counts["needs_narrative"] == 0 and counts["needs_insights"] == 0
    assert kept.count() == len(found)  # the report had its insights: the function was not asked
    for name in report.LISTS:
        one, two = (report.read_report(spark, p, name, REF).count() for p in (path, str(tmp_path / "filled")))
        assert one == two


def test_insights_are_made_where_there_are_none(spark, due, tmp_path):
    none = report.read_insights(spark, str(tmp_path / "nothing"), REF)
    assert gaps.gap_counts(gaps.with_gaps(due.withColumns({**A.NARRATIVE_DEFAULTS(), **A.NOTE_DEFAULTS(), **A.NPS_DEFAULTS()})), none).first()["needs_insights"] == 1
    made = gaps.fill_insights(none, due)
    assert made.count() == insights.portfolio_insights(due).count() > 0
    assert gaps.fill_insights(made.limit(1), due).count() == 1


def test_document_in_the_exchange_format(spark, tmp_path):
    doc = {"meta": {"reference_date": "2026-04-10", "window_days": 90, "total_renewing": 1},
           "portfolio_insights": {"insights": [{"title": "t", "affected_accounts": ["A"]}], "executive_summary": "e"},
           "accounts": [{"account_id": 7, "account_name": "A", "arr": 5, "risk_score": 0.7, "nps_score": None, "risk_flags": ["x"],
                         "signal_breakdown": {"nps_risk_score": {"raw_value": 0.5, "weight": 0.15, "contribution": 0.075}}}]}
    path = tmp_path / "risk_report.json"
    path.write_text(json.dumps(doc, indent=2))
    row = report.read_report_document(spark, str(path)).first()
    assert (row["account_id"], row["nps_score"], row["risk_flags"]) == (7, None, ["x"])
    assert row["signal_breakdown"]["nps_risk_score"]["contribution"] == 0.075
    meta, found = report.read_document_parts(spark, str(path))
    assert meta.first()["window_days"] == 90 and found.first()["affected_accounts"] == ["A"]


def test_filter_drops_missing_attributes(spark, due):
    hole = due.withColumn("region", F.when(F.col("account_id") % 2 == 0, F.col("region")))
    assert portfolio.portfolio_filter(hole).count() == hole.where("region is not null").count()


def test_count_and_arr_leaders_may_differ(spark):
    rows = spark.createDataFrame([("b", 1, "High"), ("b", 1, "Medium"), ("a", 1, "High"), ("a", 2, "High"), ("c", 9, "High"), ("c", 99, "Low")],
                                 "csm_name string, arr long, risk_tier string")
    assert insights.csm_concentration(rows).first()["csm_name"] == "a"
    assert insights.csm_arr_leader(rows).first()["csm_name"] == "c"


def test_files_to_report(spark, tmp_path):
    """The command line job on files with malformed numbers, a missing ticket file and quotes in comments."""
    (tmp_path / "accounts.csv").write_text(
        "account_id,account_name,arr,contract_end_date,plan_tier,industry,csm_name,region\n"
        "1,Acme Corp,100,2026-05-01,Starter,Media,Ann,EU\n2,Beacon,200,2027-05-01,Scale,Media,Bob,EU\n")
    (tmp_path / "usage.csv").write_text(
        "account_id,month,api_calls,content_entries_created,active_users,workflows_triggered,sdk_version\n"
        "1,2026-01,100,1,10,10,v3.1\n1,2026-02,50,1,5,5,v3.1\n1,2026-03,10,1,1,1,v3.2\n")
    (tmp_path / "nps.csv").write_text('account_id,score,verbatim_comment\n1,8,"fine, ""really"""\n2,n/a,\n')
    (tmp_path / "notes.txt").write_text("=== t ===\n---\n4/1 Acme Corp\nThey will cancel\n---\n4/2 nobody known here\n")
    out = str(tmp_path / "out")
    renewals.main(["--accounts", str(tmp_path / "accounts.csv"), "--usage", str(tmp_path / "usage.csv"), "--nps", str(tmp_path / "nps.csv"),
                   "--notes", str(tmp_path / "notes.txt"), "--output", out, "--reference-date", "2026-04-10", "--csv", str(tmp_path / "csv")])
    r = report.read_report(spark, out).first()
    assert r["account_id"] == 1 and r["verbatim_comment"] == 'fine, "really"' and r["silent_churn_flag"]
    assert r["risk_flags"] == ["Cancellation language used"] and r["latest_sdk_version"] == "v3.2"
    notes = report.read_report(spark, out, "account_notes").collect()
    assert [(n["account_id"], n["raw_text"]) for n in notes] == [(1, "4/1 Acme Corp\nThey will cancel")] and r["ticket_count_total"] == 0
    series = report.read_report(spark, out, "account_series").orderBy("pos").collect()
    assert [p["api_calls"] for p in series] == [100, 50, 10] and r["ticket_subject_count"] == 0
    scores = tables.scan_nps(spark, str(tmp_path / "nps.csv")).orderBy("account_id").collect()
    assert [(s["score"], s["verbatim_comment"]) for s in scores] == [(8.0, 'fine, "really"'), (None, "")]
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns[0] == "account_name"
