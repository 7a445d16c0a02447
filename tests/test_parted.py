"""Upserts that rewrite only the parts they change."""

import pytest
from pyspark.sql import functions as F

from riskspark.operators.merge import upsert_by_id
from riskspark.sources import parted

SCHEMA = "account_id long, nps_score double, status string, names array<string>, weights map<string,double>"


@pytest.fixture
def base(spark):
    rows = [(i, float(i % 3), f"s{i}", [f"n{i}"], {"a": float(i)}) for i in range(200)] + [(7, 9.0, "again", None, None), (None, 1.0, "nobody", [], {})]
    return spark.createDataFrame(rows, SCHEMA)


def as_rows(frame):
    return sorted((r["account_id"] is None, r["account_id"], r["nps_score"], r["status"], r["names"]) for r in frame.collect())


def test_an_upsert_rewrites_only_changed_parts(spark, base, tmp_path):
    path = str(tmp_path / "t")
    assert parted.write_parted(base, path, parts=32) == 1
    assert as_rows(parted.read_parted(spark, path, SCHEMA)) == as_rows(base)
    updates = spark.createDataFrame([(5, "new", ["x"]), (7, "both", None), (11, "s11", ["n11"]), (9999, "unknown", []), (None, "none", [])],
                                    "account_id long, status string, names array<string>")
    touched = parted.upsert_parted(spark, path, SCHEMA, updates, ["status", "names"])
    expected = {r[0] for r in spark.createDataFrame([(5,), (7,)], "k long").select(parted.part_of("k", 32)).collect()}
    assert set(touched) == expected  # 11 is unchanged, 9999 unknown
    assert len(list((tmp_path / "t" / "rows" / "version=2").glob("part=*"))) == len(expected)
    want = upsert_by_id(base, updates, ["status", "names"])
    assert as_rows(parted.read_parted(spark, path, SCHEMA)) == as_rows(want)
    assert as_rows(parted.read_parted(spark, path, SCHEMA, 1)) == as_rows(base)
    weights = {r["account_id"]: r["weights"] for r in parted.read_parted(spark, path, SCHEMA).where("account_id in (5, 6)").collect()}
    assert weights == {5: {"a": 5.0}, 6: {"a": 6.0}}
    assert parted.upsert_parted(spark, path, SCHEMA, updates, ["status", "names"]) == []
    assert not (tmp_path / "t" / "state" / "version=3").exists()


def test_several_keys_match_null_with_null(spark, base, tmp_path):
    path = str(tmp_path / "t")
    parted.write_parted(base, path, parts=4)
    updates = spark.createDataFrame([(7, 9.0, "only the second")], "account_id long, nps_score double, status string")
    assert len(parted.upsert_parted(spark, path, SCHEMA, updates, ["status"], ["account_id", "nps_score"])) == 1
    found = {r["status"] for r in parted.read_parted(spark, path, SCHEMA).where("account_id = 7").collect()}
    assert found == {"s7", "only the second"}


def test_a_stopped_upsert_is_not_seen(spark, base, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    parted.write_parted(base, path, parts=8)
    updates = base.where("account_id = 3").select("account_id", F.lit("later").alias("status"))

    def stop(*args):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:
        m.setattr(parted, "_finish", stop)
        with pytest.raises(RuntimeError):
            parted.upsert_parted(spark, path, SCHEMA, updates, ["status"])
    assert as_rows(parted.read_parted(spark, path, SCHEMA)) == as_rows(base)
    assert len(parted.upsert_parted(spark, path, SCHEMA, updates, ["status"])) == 1
    assert as_rows(parted.read_parted(spark, path, SCHEMA)) == as_rows(upsert_by_id(base, updates, ["status"]))


def test_empty_and_missing_tables(spark, base, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(ValueError):
        parted.read_parted(spark, path, SCHEMA)
    parted.write_parted(base.limit(0), path, parts=4)
    assert parted.read_parted(spark, path, SCHEMA).collect() == []
    assert parted.upsert_parted(spark, path, SCHEMA, base.select("account_id", "status"), ["status"]) == []
    assert parted.write_parted(base, path, parts=4) == 2
    assert as_rows(parted.read_parted(spark, path, SCHEMA)) == as_rows(base)
