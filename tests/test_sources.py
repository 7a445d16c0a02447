"""Quarantine of malformed records, and note numbering that moves no text."""

import io
from contextlib import redirect_stdout
from datetime import date

import pytest

from riskspark.sources import tables
from riskspark.sources.notes import scan_note_blocks
from riskspark.sources.rejects import sift, write_rejects

ACCOUNTS = '''account_id,account_name,arr,contract_end_date,plan_tier,industry,csm_name,region
1,"Firm, ""One""",100,2026-05-01,Scale,Tech,Ann,EU
x2,Two,100,2026-05-01,Scale,Tech,Ann,EU
,Three,100,2026-05-01,Scale,Tech,Ann,EU
4,Four,much,2026-05-01,Scale,Tech,Ann,EU
5,Five,100,2026-13-01,Scale,Tech,Ann,EU
6,Six,100,2026-05-01,Scale,Tech,Ann
7,Seven,100,2026-05-01,Scale,Tech,Ann,EU,more
8,"Eight,100,2026-05-01,Scale,Tech,Ann,EU
9,,,,,,,
10,Ten,12, 2026-06-02 ,,,Ann,EU
'''


def written(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_accounts_in_two_parts(spark, tmp_path):
    part = sift(spark, "accounts", written(tmp_path, "a.csv", ACCOUNTS))
    rows = {r["account_id"]: (r["account_name"], r["arr"], r["contract_end_date"]) for r in part.rows.collect()}
    assert rows == {1: ('Firm, "One"', 100, date(2026, 5, 1)), 9: (None, None, None), 10: ("Ten", 12, date(2026, 6, 2))}
    rejects = {r["record"].split(",")[0]: r["reason"] for r in part.rejects.collect()}
    assert rejects == {"x2": "malformed account_id", "": "missing account_id", "4": "malformed arr", "5": "malformed contract_end_date",
                       "6": "number of fields", "7": "number of fields", "8": "number of fields"}
    assert {r["record"] for r in part.rejects.collect()} <= set(ACCOUNTS.splitlines())
    assert part.rows.schema == tables.scan_accounts(spark, str(tmp_path / "a.csv")).schema
    assert part.rows.count() == 3 and part.rejects.select("source").distinct().count() == 1  # pruned scans see the same records


def test_good_files_have_no_rejects(spark, tmp_path):
    good = "\n".join(line for line in ACCOUNTS.splitlines() if line[:2] in ("ac", "1,", "9,")) + "\n"
    path = written(tmp_path, "a.csv", good)
    part = sift(spark, "accounts", path)
    assert part.rejects.count() == 0 and part.admitted(0.0).collect() == tables.scan_accounts(spark, path).collect()
    empty = sift(spark, "accounts", written(tmp_path, "b.csv", good.splitlines()[0] + "\n"))
    assert empty.admitted(0.0).count() == 0 and empty.rejects.count() == 0


def test_coerced_numbers_are_not_rejected(spark, tmp_path):
    nps = sift(spark, "nps", written(tmp_path, "n.csv", "account_id,score,verbatim_comment\n1,9,ok\n2,none,\n3,NaN,x\nz,1,y\n"))
    assert sorted(map(tuple, nps.rows.collect())) == [(1, 9.0, "ok"), (2, None, ""), (3, None, "x")]
    assert [(r["reason"], r["record"]) for r in nps.rejects.collect()] == [("malformed account_id", "z,1,y")]
    tickets = "subject,account_id,created_date,priority,status,resolution_time_hours,extra\ns,1,2026-01-02,P1,Open,n/a,e\ns,2,soon,P1,Open,4,e\n"
    part = sift(spark, "tickets", written(tmp_path, "t.csv", tickets))
    assert [(r["account_id"], r["created_date"], r["resolution_time_hours"]) for r in part.rows.collect()] == [(1, date(2026, 1, 2), None)]
    assert part.rows.schema == tables.scan_tickets(spark, str(tmp_path / "t.csv")).schema
    assert [r["reason"] for r in part.rejects.collect()] == ["malformed created_date"]


def test_allowed_share(spark, tmp_path):
    part = sift(spark, "accounts", written(tmp_path, "a.csv", ACCOUNTS))
    assert part.admitted(0.7).count() == 3
    with pytest.raises(ValueError, match="accounts: 7 of 10 records rejected.*number of fields: 3"):
        part.admitted(0.69)


def test_tables_with_a_rejects_folder(spark, tmp_path):
    paths = [written(tmp_path, "a.csv", ACCOUNTS), written(tmp_path, "u.csv", "account_id,month,api_calls,content_entries_created,active_users,workflows_triggered,sdk_version\n1,2026-01,5,1,1,1,v4\n1,2026-0x,5,1,1,1,v4\n"),
             written(tmp_path, "n.csv", "account_id,score,verbatim_comment\n1,9,ok\n"), written(tmp_path, "notes.txt", "3/1 acct 0001 call")]
    out = str(tmp_path / "rejects")
    bundle = tables.load_tables(spark, *paths, rejects=out, allowed_rejects=0.7)
    assert bundle.accounts.count() == 3 and bundle.usage.count() == 1 and bundle.tickets.count() == 0
    found = spark.read.parquet(out).groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in found} == {"accounts": 7, "usage": 1}
    write_rejects([sift(spark, "usage", paths[1])], out)  # a repeated run replaces its own folder
    assert spark.read.parquet(out).count() == 8
    with pytest.raises(Exception):
        tables.load_tables(spark, *paths).accounts.collect()


def test_numbering_moves_no_text(spark, tmp_path):
    notes = [f"note {i} " + "x" * (i % 50) + ("\n----\nmore" if i % 7 == 0 else "") for i in range(400)]
    for part in range(3):
        (tmp_path / f"part-{part}.txt").write_text("\n---\n".join(notes[part * 150:(part + 1) * 150]))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        found = scan_note_blocks(spark, str(tmp_path))
        got = [tuple(r) for r in found.orderBy("note_pos").collect()]
        shown = io.StringIO()
        with redirect_stdout(shown):
            found.explain()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = [t.strip() for n in notes for t in n.split("\n----\n")]
    assert got == list(enumerate(want))
    text_side = [line for line in shown.getvalue().splitlines() if "Exchange" in line]
    assert text_side and all("Broadcast" in line or "SinglePartition" in line for line in text_side)
