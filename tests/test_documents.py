"""Single JSON documents cut into tasks, against a reader that takes them whole."""

import json

import pytest
from pyspark.sql import functions as F

from riskspark import schemas
from riskspark.sources import report, splits
from riskspark.sources.documents import document_objects

ODD = ['plain', 'a } b { c', 'quote " and \\ and \\" }', '{"accounts": [{"account_id": 1}]}', 'ends with \\', 'line\nbreak\tä 漢 😀 }', '', '"', '}}}{{{', '"accounts": [']


def account(i):
    return {"account_id": i, "account_name": ODD[i % len(ODD)], "nps_score": None if i % 3 else i / 2, "risk_flags": ODD[:i % 4],
            "api_calls_series": [{"month": "2026-01", "api_calls": i}] * (i % 3), "csm_notes_raw": [ODD[(i + k) % len(ODD)] * (i % 7) for k in range(i % 3)],
            "signal_breakdown": {"nps_risk_score": {"raw_value": 0.5, "weight": 0.1, "contribution": i / 100}} if i % 2 else {}}


def document(n, order=("meta", "portfolio_insights", "accounts"), more=None):
    parts = {"meta": {"reference_date": "2026-04-10", "total_renewing": n},
             "portfolio_insights": {"insights": [{"title": t, "affected_accounts": [t]} for t in ODD], "executive_summary": "x } y"},
             "accounts": [account(i) for i in range(n)]}
    return {k: parts[k] for k in order} | (more or {})


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("broadcast", [True, False])
def test_a_document_of_many_splits_equals_the_whole_read(spark, tmp_path, small_splits, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(splits, "BROADCAST_SPLITS", 0)
    (tmp_path / "a.json").write_text(json.dumps(document(150), indent=2))
    (tmp_path / "b.json").write_text(json.dumps(document(60, ("accounts", "portfolio_insights", "meta")), ensure_ascii=False))
    (tmp_path / "c.json").write_text(json.dumps(document(0)) + "\n")
    (tmp_path / "d.json").write_text(json.dumps(document(3, more={"other": [{"account_id": 9}], "n": 1, "accounts_2": {"account_id": 8}})) + "\n\n")
    path = str(tmp_path)
    assert spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions() > 8
    whole = spark.read.schema(schemas.REPORT).json(path, multiLine=True)
    as_json = lambda rows: sorted(r[0] for r in rows.select(F.to_json(F.struct("*"))).collect())
    assert as_json(report.read_report_document(spark, path)) == as_json(whole.select(F.inline("accounts")))
    meta, found = report.read_document_parts(spark, path)
    assert as_json(meta) == as_json(whole.select("meta.*"))
    assert as_json(found) == as_json(whole.select(F.inline("portfolio_insights.insights")))
    order = [(r["file"][-6:], r["number"], json.loads(r["text"])["account_id"]) for r in document_objects(spark, path, "accounts").collect()]
    assert [x[2] for x in sorted(order) if x[0] == "a.json"] == list(range(150))


def test_a_broken_document_is_named(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"accounts": [{"account_id": 1}, {"account_id": 2}')
    with pytest.raises(ValueError, match="r.json"):
        report.read_report_document(spark, str(tmp_path / "r.json"))
    (tmp_path / "e.json").write_text('{"accounts": []}')
    assert report.read_report_document(spark, str(tmp_path / "e.json")).collect() == []
    (tmp_path / "f.json").write_text("")
    assert report.read_report_document(spark, str(tmp_path / "f.json")).collect() == []
