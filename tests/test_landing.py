"""Landing tables: equal results, whole months left out, and joins without an exchange."""

import re
import uuid

import pytest
from pyspark.sql import functions as F

from riskspark.operators import tickets, usage
from riskspark.operators.features import build_features
from riskspark.sources import landing
from riskspark.sources.standins import REF, standin_tables

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path, prefix = str(tmp_path_factory.mktemp("landing")), f"landed_{uuid.uuid4().hex}"
    plain = standin_tables(spark, SF_DIR)
    return plain, landing.land(plain, path, prefix, buckets=4), path, prefix


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def rows(frame):
    names = sorted(frame.columns)
    return sorted((tuple(str(r[c]) for c in names) for r in frame.collect()))


def test_features_are_equal(spark, stored):
    plain, landed, _, _ = stored
    cols = ["account_id", "latest_sdk_version", "ticket_count_total", "nps_score", "note_count",
            *[F.round(c, 6).alias(c) for c in ("usage_decline_score", "support_health_score")]]
    assert rows(build_features(landed).select(*cols)) == rows(build_features(plain).select(*cols))


def test_old_months_of_tickets_are_not_read(stored):
    plain, landed, _, _ = stored
    recent = tickets.recent_tickets(landed.tickets, REF)
    assert re.search(r"PartitionFilters: \[[^\]]*created_month#\d+ >= ", plan(recent))
    assert len(recent.inputFiles()) > 0
    read = {r[0] for r in recent.select(F.input_file_name()).distinct().collect()}
    every = {r[0] for r in landed.tickets.select(F.input_file_name()).distinct().collect()}
    assert len(read) < len(every)
    assert rows(recent.select(*plain.tickets.columns)) == rows(tickets.recent_tickets(plain.tickets, REF))


def test_usage_joins_without_an_exchange(spark, stored):
    plain, landed, _, _ = stored
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = lambda t: t.accounts.join(usage.usage_features(t.usage, True), "account_id", "left")
        assert "Exchange" not in plan(joined(landed))
        assert "Exchange" in plan(joined(plain))
        assert joined(landed).count() == plain.accounts.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_tables_are_found_again_by_another_catalog(spark, stored):
    plain, landed, path, prefix = stored
    again = f"again_{uuid.uuid4().hex}"
    ddl = {name: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in getattr(landed, name).schema) for name in landing.NAMES}
    landing.attach(spark, path, again, ddl, buckets=4, unique_months=True, unique_surveys=True)
    t = landing.landed(spark, again, REF, unique_months=True, unique_surveys=True)
    for name in landing.NAMES:
        columns = getattr(plain, name).columns
        assert rows(getattr(t, name).select(*columns)) == rows(getattr(plain, name)), name
    assert "Exchange" not in plan(usage.usage_features(t.usage, True))


def test_without_promises_nothing_is_bucketed_but_accounts(spark, tmp_path):
    plain = standin_tables(spark, SF_DIR).with_(unique_months=False, unique_surveys=False)
    prefix = f"landed_{uuid.uuid4().hex}"
    landed = landing.land(plain.with_(tickets=plain.tickets.limit(0)), str(tmp_path), prefix, buckets=4)
    shown = lambda name: spark.sql(f"SHOW CREATE TABLE {prefix}_{name}").first()[0]
    assert "CLUSTERED BY" in shown("accounts") and not any("CLUSTERED BY" in shown(n) for n in ("usage", "nps", "tickets", "notes"))
    assert tickets.recent_tickets(landed.tickets, REF).count() == 0
