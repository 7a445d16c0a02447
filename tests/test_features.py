"""Feature, score and tier edges."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from riskspark.functions import dates, risk, text
from riskspark.operators import features, lists, merge, scoring, surveys, tickets

TICKET = "ticket_id long, account_id long, created_date date, priority string, status string, subject string, resolution_time_hours double"


def values(spark, data, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(data, schema).select(*columns).collect()]


def test_ticket_window_and_weights(spark):
    ref = date(2026, 8, 31)  # six months back clamps to 28 February
    data = [(1, 1, date(2026, 2, 28), "P1", "Open", "a", None), (2, 1, date(2026, 2, 27), "P1", "Open", "old", None),
            (3, 1, date(2027, 1, 1), "P9", "Odd", "b", None), (4, 1, date(2026, 3, 1), "P1", "Resolved", "a", 5.04),
            (5, 2, date(2026, 3, 1), "P2", "Escalated", "c", 9.0)]
    data += [(100 + i, 3, date(2026, 5, 1), "P1", "Escalated", "x", None) for i in range(9)]
    out = {r["account_id"]: r for r in tickets.ticket_features(spark.createDataFrame(data, TICKET), ref).collect()}
    one = out[1]
    assert (one["ticket_count_total"], one["p1_open_count"], one["open_ticket_count"]) == (3, 1, 1)
    assert one["support_health_score"] == pytest.approx((4 * 2 + 1 + 4 * 0.2) / 30)
    assert one["avg_resolution_hours"] == 5.0 and out[2]["avg_resolution_hours"] is None
    assert out[3]["support_health_score"] == 1.0
    subjects = tickets.ticket_subjects(spark.createDataFrame(data, TICKET), ref)
    base = spark.createDataFrame([(1,), (2,), (9,)], "account_id long")
    mine = lists.owned(subjects, base).orderBy("account_id", "created_date", "ticket_id").collect()
    assert [(r["account_id"], r["subject"]) for r in mine] == [(1, "a"), (1, "b"), (2, "c")]
    counted = lists.attach_count(base, subjects, "account_id", "n").collect()
    assert {r["account_id"]: r["n"] for r in counted} == {1: 2, 2: 1, 9: 0}


def test_chunks_hold_every_item_of_a_hot_key_in_order(spark):
    """One key owns 50,000 items; gaps in the positions, a shared and a missing one lose nothing."""
    hot = spark.range(50_000).select(F.lit(1).cast("long").alias("k"), (F.col("id") * 3).alias("p"), F.col("id").cast("string").alias("v"))
    few = spark.createDataFrame([(2, 9, "b"), (2, 1, "a"), (2, None, "first"), (3, 5, "x"), (3, 5, None), (None, 1, "nobody")], "k long, p long, v string")
    chunks = lists.chunked(hot.unionByName(few), "k", "p", "v", "items", 64).collect()
    got = {}
    for r in sorted(chunks, key=lambda r: (r["k"], r["chunk_no"])):
        assert 1 <= len(r["items"]) <= 64 and r["chunk_no"] == len(got.get(r["k"], [])) // 64
        got.setdefault(r["k"], []).extend(r["items"])
    assert got[1] == [str(i) for i in range(50_000)] and got[2] == ["first", "a", "b"]
    assert set(got) == {1, 2, 3} and sorted(got[3], key=str) == [None, "x"]


@pytest.mark.parametrize("score,want", [(None, .5), (0.0, 1.0), (6.0, .5), (6.5, .35), (7.0, .3), (8.0, .2), (8.5, .1),
                                        (9.0, .1), (10.0, .05), (12.0, 0.0)])
def test_nps_risk(spark, score, want):
    # 8.5 lies above the passive range: 0.1 - (8.5 - 9) * 0.05
    want = 0.125 if score == 8.5 else want
    assert values(spark, [(score,)], "s double", risk.nps_risk(F.col("s")))[0][0] == pytest.approx(want)


def test_sdk_risk(spark):
    cases = {None: .3, "": .3, " V3.1 ": 1.0, "v4.0.0": .6, "v4.1.0": .6, "v4.2.0": .15, "v4.2.1": .2, "v4.2.3": .15,
             "v4.3.9": 0.0, "v5.0": .2, "  ": .2}
    rows = values(spark, [(k,) for k in cases], "v string", "v", risk.sdk_risk(F.col("v")))
    assert dict(rows) == cases


def test_urgency_edges(spark):
    got = values(spark, [(d,) for d in (-1, 0, 1, 30, 31, 60, 61)], "d int", dates.renewal_urgency(F.col("d")))
    assert [g[0] for g in got] == [1.0, 1.0, .9, .9, .6, .6, .3]


def test_non_english_needs_more_than_a_tenth(spark):
    rows = values(spark, [("é" + "a" * 9,), ("éé" + "a" * 9,), ("",), (None,), ("不错",)], "t string",
                  text.has_non_english(F.col("t")))
    assert [r[0] for r in rows] == [False, True, False, False, True]


def test_window_edges(spark):
    ref = date(2026, 4, 10)
    ends = [date(2026, 4, 9), ref, date(2026, 7, 9), date(2026, 7, 10)]
    df = spark.createDataFrame([(i, e) for i, e in enumerate(ends)], "account_id int, contract_end_date date")
    assert sorted(r[0] for r in scoring.filter_renewing(df, ref).collect()) == [1, 2]


def score_rows(spark, rows, **kw):
    cols = ("account_id long, usage_decline_score double, support_health_score double, nps_risk_score double, "
            "sdk_risk_score double, csm_sentiment_score double, renewal_urgency_score double, p1_open_count long, "
            "silent_churn_flag boolean")
    return scoring.score_accounts(spark.createDataFrame(rows, cols), **kw).orderBy("account_id").collect()


def test_score_tier_boosters(spark):
    none = (0.0,) * 6
    rows = score_rows(spark, [
        (1, *none, 0, False), (2, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 2, True), (3, None, 1.0, 1.0, 0.0, 0.0, 0.0, 0, False),
        (4, 0.0, 0.0, 0.0, 0.0, 0.0, 5.9996, 0, False)])
    assert (rows[0]["risk_score"], rows[0]["risk_tier"]) == (0.0, "Low")
    assert rows[1]["risk_score"] == 1.0 and len(rows[1]["boosters_applied"]) == 3
    assert (rows[2]["risk_score"], rows[2]["risk_tier"]) == (0.35, "Medium")  # a missing signal counts as 0
    assert (rows[3]["risk_score"], rows[3]["risk_tier"]) == (0.6, "Medium")  # shown .6, tiered by .59996
    assert rows[1]["signal_breakdown"]["nps_risk_score"]["contribution"] == 0.15


def test_own_weights_and_boosters(spark):
    extra = [scoring.Booster(F.col("account_id") == 1, 0.25, "mine")]
    r = score_rows(spark, [(1, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 9, True)],
                   weights={"usage_decline_score": 0.5, "nobody_has_this": 3.0}, boosters=extra)[0]
    assert r["risk_score"] == 0.75 and r["boosters_applied"] == ["mine"]
    assert r["signal_breakdown"]["nobody_has_this"]["raw_value"] == 0.0


def test_top_signals_keep_weight_order_on_ties(spark):
    df = score_rows(spark, [(1, 0.6, 0.75, 1.0, 1.0, 0.0, 0.0, 0, False)])
    top = scoring.top_signals(F.col("signals"), 2)
    cols = spark.createDataFrame(df).select(top.alias("t")).first()["t"]
    assert [t.split(" ", 1)[1] for t in cols] == ["Declining usage", "Support ticket burden"]


def test_repeated_surveys_repeat_the_account(spark):
    accounts = spark.createDataFrame([(1, "a"), (2, "b")], "account_id long, account_name string")
    nps = spark.createDataFrame([(1, 9.0, ""), (1, 3.0, "x"), (7, 1.0, "")], "account_id long, score double, verbatim_comment string")
    feats = surveys.nps_features(nps)
    plain = sorted(features.join_surveys(accounts, feats, unique=True).collect(), key=repr)
    assert plain == sorted(features.join_surveys(accounts, feats, unique=False).collect(), key=repr)
    assert len(plain) == 3


def test_upsert_like_a_dictionary(spark):
    log = spark.createDataFrame([(1, 0, "a", "x"), (2, 1, "b", "y"), (1, 2, None, "z")], "account_id long, pos long, v string, w string")
    base = merge.last_by_key(log, "account_id", "pos")
    assert sorted(tuple(r) for r in base.collect()) == [(1, 0, None, "z"), (2, 1, "b", "y")]
    updates = spark.createDataFrame([(2, "new"), (9, "ghost")], "account_id long, v string")
    out = sorted(tuple(r) for r in merge.upsert_by_id(base, updates, ["v"]).select("account_id", "v", "w").collect())
    assert out == [(1, None, "z"), (2, "new", "y")]
    nothing = merge.upsert_by_id(base, updates.limit(0), ["v"]).select(*base.columns)
    assert sorted(nothing.collect()) == sorted(base.collect())


def test_rank_matches_sql_rank(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate([.5, .9, .5, .1, .9])], "account_id int, risk_score double")
    got = {r["account_id"]: r["risk_rank"] for r in scoring.rank_by_risk(df).collect()}
    assert got == {1: 1, 4: 1, 0: 3, 2: 3, 3: 5}


@pytest.mark.parametrize("amount,shown", [(2500, "$2K"), (3500, "$4K"), (3185000, "$3.19M"), (1005000, "$1.00M"),
                                          (1125000, "$1.12M"), (999, "$999"), (1955000, "$1.96M"), (12826000, "$12.83M")])
def test_money_rounds_like_the_binary_quotient(spark, amount, shown):
    assert shown == (f"${amount / 1e6:.2f}M" if amount >= 1e6 else f"${amount / 1e3:.0f}K" if amount >= 1e3 else f"${amount}")
    assert values(spark, [(amount,)], "a long", text.money_short(F.col("a"))) == [(shown,)]
