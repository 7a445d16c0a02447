"""Note log, dates, account resolution and keyword signals against plain Python."""

import random
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from riskspark.functions import dates, text
from riskspark.functions.values import EXECUTIVE_KEYWORDS, NEGATIVE_KEYWORDS, POSITIVE_KEYWORDS
from riskspark.operators import resolve, signals
from riskspark.sources.notes import scan_note_blocks

NOTE = "note_pos long, raw_text string"
ACCOUNT = "account_id long, account_name string"
NAMES = ["Acme Corp", "Beacon Health Group", "Beacon Group", "Delta-9 Labs", "Echo & Sons", "Fjord Group", "Global Group",
         "Acme Holdings", "Zenit Motors", "O'Neil Foods", "Yahoo! Media", "Group"]


@pytest.fixture(scope="module")
def accounts(spark):
    return spark.createDataFrame([(1000 + i, n) for i, n in enumerate(NAMES)], ACCOUNT)


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column).first()[0]


def test_log_blocks_keep_file_order(spark, tmp_path):
    log = "=== Title ===\nfirst note\n\n---\n\n 3/1 one \n---\n\n---\n3/2 two\n-----\n3/3 three\n----\nfour\n--- not a line\n"
    (tmp_path / "notes.txt").write_text(log)
    got = [tuple(r) for r in scan_note_blocks(spark, str(tmp_path)).orderBy("note_pos").collect()]
    want = [b.strip() for b in re.split(r"\n---+\n", log)]
    want = [b for b in want if b and not b.startswith("===")]
    assert got == list(enumerate(want))


def test_log_read_in_many_splits(spark, tmp_path):
    notes = [f"note {i} " + "x" * (i % 50) for i in range(500)]
    for part in range(3):
        (tmp_path / f"part-{part}.txt").write_text("\n---\n".join(notes[part * 200:(part + 1) * 200]))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = [r["raw_text"] for r in scan_note_blocks(spark, str(tmp_path)).orderBy("note_pos").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [n.strip() for n in notes]


def test_title_block_can_be_recovered(spark, tmp_path):
    (tmp_path / "notes.txt").write_text("=== Title ===\n(internal)\n\nMar 12 - first\n---\nsecond")
    got = [r["raw_text"] for r in scan_note_blocks(spark, str(tmp_path), strip_title=True).orderBy("note_pos").collect()]
    assert got == ["Mar 12 - first", "second"]


@pytest.mark.parametrize("token,want", [
    ("2026-03-20", date(2026, 3, 20)), ("3/15", date(2026, 3, 15)), ("04/03/25", date(2025, 4, 3)), ("4/3/1999", date(1999, 4, 3)),
    ("march 25", date(2026, 3, 25)), ("Apr 1 2024", date(2024, 4, 1)), ("2/30", None), ("2026-13-01", None), ("soon 12", None), (None, None)])
def test_note_dates(spark, token, want):
    assert one(spark, token, dates.parse_note_date(F.col("v"))) == want


def test_slash_months_above_nine(spark):
    assert one(spark, "12/05 call", dates.note_date_token(F.col("v"))) == "12/05"
    assert one(spark, "12/05 call", dates.note_date_token(F.col("v"), narrow_slash=True)) == "2/05"
    assert one(spark, "no date\n3/4", dates.note_date_token(F.col("v"))) is None


def test_header_loses_only_the_first_date(spark):
    got = one(spark, "3/15 | — Acme 4/16\nApr 3 call\nthird", text.clean_header(F.col("v")))
    assert got == "Acme 4/16 Apr 3 call"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
    return row[-1]


def token_set_similarity(left, right):
    a, b = set(left.split()), set(right.split())
    if not a or not b:
        return 0.0
    both, rest_a, rest_b = (" ".join(sorted(s)) for s in (a & b, a - b, b - a))
    if both and (not rest_a or not rest_b):
        return 100.0
    gap = 1 if both else 0
    len_a, len_b = len(both) + gap + len(rest_a), len(both) + gap + len(rest_b)
    distance = len(rest_a) + len(rest_b) - 2 * lcs(rest_a, rest_b)
    scores = [100 - 100 * distance / (len_a + len_b)]
    if both:
        scores += [100 - 100 * (1 + len(r)) / (len(both) + n) for r, n in ((rest_a, len_a), (rest_b, len_b))]
    return max(scores)


def brute_force(header, names, fold, cutoff=55.0):
    best = None
    for order, name in enumerate(names):
        score = token_set_similarity(fold(header), fold(name))
        if score >= cutoff - 1e-9 and (best is None or score > best[0] + 1e-9):
            best = (score, order)
    return best


@pytest.mark.parametrize("case_sensitive", [True, False])
@pytest.mark.parametrize("common", [1000, 1, 0])
def test_similarity_equals_brute_force(spark, accounts, case_sensitive, common):
    rnd = random.Random(7)
    words = sorted({w for n in NAMES for w in n.split()}) + ["call", "with", "Zenith", "Becon", "grp", "fjrd", "labs"]
    headers = {" ".join(rnd.choices(words, k=rnd.randint(1, 6))) for _ in range(150)}
    headers |= {"beacon health", "Zenit Moters", "Gruop", "Glbal Grp", "x", "é é"}
    got = {r["header"]: (r["score"], r["account_id"] - 1000) for r in resolve.similarity_matches(
        spark.createDataFrame([(h,) for h in headers], "header string"), accounts,
        case_sensitive=case_sensitive, common_names=common).collect()}
    fold = (lambda s: s) if case_sensitive else str.lower
    for h in headers:
        want = brute_force(h, NAMES, fold)
        if want is None:
            assert h not in got
        else:
            assert got[h][0] == pytest.approx(want[0], abs=1e-6) and got[h][1] == want[1], h


def first_word(block, names):
    for order, name in enumerate(names):
        if re.search(rf"\b{re.escape(name.split()[0])}\b", block, re.I):
            return order
    return None


def test_first_word_equals_brute_force(spark, accounts):
    blocks = ["talk to ACME today", "pacme", "delta-9 is back", "delta-99", "delta 9", "echo-location", "an o'neil thing", "x o'neils",
              "yahoo! yes", "yahoo!yes", "beacon, global", "zenit_motors", "the GROUP", "é-acme-é", "nothing"]
    got = {r["note_pos"]: r["account_id"] - 1000 for r in resolve.resolve_first_word(
        spark.createDataFrame(list(enumerate(blocks)), NOTE), accounts).collect()}
    want = {i: first_word(b, NAMES) for i, b in enumerate(blocks) if first_word(b, NAMES) is not None}
    assert got == want


def test_cascade(spark, accounts):
    notes = spark.createDataFrame([
        (0, "3/1 note (acct 1003)\nAcme Corp"), (1, "3/2 ACCOUNT 9999"), (2, "3/3 Beacon Health Group\nfine"),
        (3, "3/4 a long line that names nobody at all in its first words\nand more of the same kind of text here\nZenit"),
        (4, "just words without any match to be found in this rather long first line\nqqq")], NOTE)
    got = {r["note_pos"]: r for r in resolve.resolve_notes(notes, accounts).collect()}
    assert [(got[i]["account_id"], got[i]["match_method"], got[i]["id_known"]) for i in range(5)] == [
        (1003, "explicit", True), (9999, "explicit", False), (1001, "similarity", True), (1008, "first_word", True), (None, None, False)]
    assert got[0]["account_name"] is None and got[2]["match_score"] == 100.0 and got[3]["note_date"] == date(2026, 3, 4)


def plain_signals(notes):
    combined = " ".join(notes).lower()
    neg = [k for k in NEGATIVE_KEYWORDS if k in combined]
    pos = [k for k in POSITIVE_KEYWORDS if k in combined]
    execs = [k.strip() for k in EXECUTIVE_KEYWORDS if k in combined]
    base = min(1.0, max(0.0, 0.5 + (len(pos) - len(neg)) / 24))
    return neg, pos, execs[0] if execs else None, round(1 - base, 4)


def test_signals_as_if_notes_were_one_text(spark, monkeypatch):
    monkeypatch.setattr(signals, "NOTES_PER_CHUNK", 3)  # neighbours also meet at chunk borders
    rnd = random.Random(3)
    bits = ["they no", "show up", "Budget", "approved now", "vp", "VP of", "great", "qbr", "lost faith", "churn", "adding", "seats", "walked", "ok"]
    notes, rows = {}, []
    for account in range(40):
        texts = [rnd.choice(bits) for _ in range(rnd.randint(1, 9))]
        notes[account] = texts
        rows += [(account, account * 5 + 2 * i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "account_id long, note_pos long, raw_text string").repartition(5)
    found = {r["account_id"]: r for r in signals.keyword_hits(df).collect()}
    scored = {r["account_id"]: r for r in signals.note_signals(df).collect()}
    for account, texts in notes.items():
        neg, pos, executive, risk = plain_signals(texts)
        assert (found[account]["negative"], found[account]["positive"]) == (neg, pos)
        assert scored[account]["executive_keyword"] == executive
        assert scored[account]["csm_sentiment_score"] == pytest.approx(risk, abs=1e-9)


def test_word_boundaries(spark):
    df = spark.createDataFrame([(1, 1, "the director of connectors"), (2, 1, "the CTO said so"), (3, 1, "a no"), (3, 2, "show today")],
                               "account_id long, note_pos long, raw_text string")
    loose = {r["account_id"]: r["executive"] for r in signals.keyword_hits(df).collect()}
    strict = {r["account_id"]: r for r in signals.keyword_hits(df, word_boundary=True).collect()}
    assert loose[1] == ["cto"] and strict[1]["executive"] == [] and strict[2]["executive"] == ["cto"]
    assert strict[3]["negative"] == ["no show"]


@pytest.mark.parametrize("common", [0, 1, 1000])
def test_equal_scores_go_to_the_earlier_account(spark, common):
    """A ceiling rounded otherwise than the score would lose the earlier of two equal matches."""
    from riskspark.operators.resolve import similarity_matches
    heads = spark.createDataFrame([("abc xy",)], "header string")
    accounts = spark.createDataFrame([(1, "bcx"), (2, "abc qqqqqqq")], "account_id long, account_name string")
    for rows in (accounts, accounts.where("account_id = 1")):
        found = similarity_matches(heads, rows, common_names=common, cutoff=60.0).collect()
        assert [r["account_id"] for r in found] == [1]


def test_common_subsequence_of_many_pairs(spark):
    """Short and long texts, empty ones, wide characters and zero characters at the end."""
    from riskspark.functions.similarity import lcs_length
    rnd = random.Random(11)
    word = lambda most: "".join(rnd.choice("abc é字😀\0") for _ in range(rnd.randint(0, most)))
    pairs = [(i, word(n), word(m)) for i, (n, m) in enumerate([(8, 8), (64, 64), (70, 3), (3, 90), (90, 90)] * 40)]
    pairs += [(900, "a" * 64, "a" * 64), (901, "a" * 64, "a" * 65), (902, "a" * 65, "a" * 66), (903, "", "a"), (904, "a\0", "a\0\0")]
    got = dict(spark.createDataFrame(pairs, "i int, a string, b string").select("i", lcs_length("a", "b")).collect())
    assert got == {i: lcs(a, b) for i, a, b in pairs}


def test_many_headers_and_names_of_one_letter_profile(spark, monkeypatch):
    """Cutting both sides into cells loses no pair and meets none twice."""
    monkeypatch.setattr(resolve, "NAMES_PER_CELL", 3)
    monkeypatch.setattr(resolve, "HEADS_PER_CELL", 2)
    names = [f"firm{i:03d}" for i in range(40)]
    headers = [f"frim{i:03d}" for i in range(20)] + ["mrif999"]
    accounts = spark.createDataFrame(list(enumerate(names)), ACCOUNT)
    got = {r["header"]: (r["score"], r["account_id"]) for r in resolve.similarity_matches(
        spark.createDataFrame([(h,) for h in headers], "header string"), accounts).collect()}
    want = {h: brute_force(h, names, str.lower) for h in headers}
    assert set(got) == {h for h, best in want.items() if best}
    assert all(got[h][1] == want[h][1] and got[h][0] == pytest.approx(want[h][0], abs=1e-6) for h in got)


@pytest.mark.parametrize("resolver", [resolve.resolve_fuzzy, resolve.resolve_notes])
def test_no_table_that_grows_is_broadcast_for_its_file_size(spark, monkeypatch, resolver):
    """Stored tables are small as files and large as rows; the list of common tokens and word buckets alone may be broadcast."""
    plans, stored = [], resolve.stored
    shown = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df
    monkeypatch.setattr(resolve, "stored", lambda df: stored(shown(df)))
    accounts = spark.createDataFrame([(k, f"Firm{k:03d} {('North', 'South')[k % 2]}") for k in range(40)],
                                     ACCOUNT)
    notes = spark.createDataFrame([(k, f"2001-03-20 | Firm{k:03d} North | desk\ntext") for k in range(60)], NOTE)
    found = shown(resolver(notes, accounts, case_sensitive=True))
    assert found.where("match_score = 100").count() > 0
    joins = [line for p in plans for line in p.splitlines() if "BroadcastHashJoin" in line or "BroadcastNestedLoopJoin" in line]
    # what else may be broadcast has come out of a shuffle of its own and is weighed by its rows at run time
    assert [j for j in joins if "LeftAnti" not in j and "LeftSemi" not in j and "LeftOuter, BuildRight" not in j] == []


def joined_rows(plan):
    """Rows out of the joins of a plan that has run."""
    rows, name = 0, plan.nodeName()
    if "Join" in name:
        rows += plan.metrics().apply("numOutputRows").value()
    below = [plan.executedPlan()] if name.startswith("AdaptiveSparkPlan") else [plan.plan()] if "QueryStage" in name else [
        plan.children().apply(i) for i in range(plan.children().size())]
    return rows + sum(joined_rows(p) for p in below)


def test_look_alike_names_do_not_meet_every_header(spark):
    """The best of many names that differ by their digits is found without a row for each pair."""
    names = [f"Firm{k:04d} Holding" for k in range(2000)]
    headers = [f"frm{k * 37 % 2000:04d} holdng" for k in range(200)]
    found = resolve.similarity_matches(spark.createDataFrame([(h,) for h in headers], "header string"),
                                       spark.createDataFrame(list(enumerate(names)), ACCOUNT))
    got = {r["header"]: (round(r["score"], 6), r["account_id"]) for r in found.collect()}
    some = headers[::40]
    want = {h: brute_force(h, names, str.lower) for h in some}
    assert len(got) == 200 and {h: got[h] for h in some} == {h: (round(s, 6), k) for h, (s, k) in want.items()}
    assert joined_rows(found._jdf.queryExecution().executedPlan()) < 20_000  # of 400,000 pairs


def test_first_words_of_one_and_of_more_pieces(spark):
    accounts = spark.createDataFrame([(1, "delta-9 Labs"), (2, "echo Sons"), (3, "o'neil"), (4, "zeta")], ACCOUNT)
    notes = ["an echo", "delta-9!", "echo, zeta", "(o'neil)", "delta 9", "zetaecho"]
    got = {r["note_pos"]: r["account_id"] for r in resolve.resolve_first_word(spark.createDataFrame(list(enumerate(notes)), NOTE), accounts).collect()}
    assert got == {0: 2, 1: 1, 2: 2, 3: 3}


def test_other_words_stop_where_first_words_fill_the_buckets(spark, monkeypatch):
    monkeypatch.setattr(resolve, "WORD_BUCKETS", 64)
    accounts = spark.createDataFrame([(k, f"firm{k} Labs") for k in range(300)], ACCOUNT)
    notes = spark.createDataFrame([(k, f"firm{k * 3} " + " ".join(f"w{k}x{i}" for i in range(30))) for k in range(100)], NOTE)
    found = resolve.resolve_first_word(notes, accounts)
    assert {r["note_pos"]: r["account_id"] for r in found.collect()} == {k: k * 3 for k in range(100)}
    assert joined_rows(found._jdf.queryExecution().executedPlan()) < 1000  # of 3,100 words


@pytest.mark.parametrize("backwards", [False, True])
def test_best_names_equal_brute_force(monkeypatch, backwards):
    """Every kind of walk: steps cut in two, one node kept, headers of several words, names that share tokens with the header."""
    import numpy as np
    import pandas as pd
    from riskspark.functions import name_tree
    rnd = random.Random(5)
    text = lambda letters, n: "".join(rnd.choice(letters) for _ in range(n))
    monkeypatch.setattr(name_tree, "STEP_ROWS", 50)
    monkeypatch.setattr(name_tree, "BEAM", 1)
    for letters, length, most in [("ab ", 5, 12), ("abc é字😀 ", 9, 12), ("0123456789 firm", 9, 12), ("ab ", 70, 150)]:
        names = list({text(letters, length) for _ in range(60)} | {text(letters, length - 3) + "x y" for _ in range(60)})
        names = [n[::-1] for n in names] if backwards else names
        order = rnd.sample(range(500), len(names))
        heads = [text(letters + "xy", rnd.randint(1, most)) for _ in range(30)]
        total = [len(h) + length for h in heads]
        floor = [rnd.choice([20.0, 55.0, round(200 * rnd.randint(1, length) / t, 9)]) for t in total]
        before = [rnd.choice([1000, 200]) for _ in heads]
        found = name_tree.best_names(
            pd.DataFrame({"hid": range(30), "rest": heads, "known": 0, "total": total, "floor": floor, "before": before}),
            pd.DataFrame({"nid": np.arange(len(names)), "rest": names, "ord": order}))
        got = {r.hid: (r.shared_length, -r.ord) for r in found.itertuples()}
        for i, h in enumerate(heads):
            apart = [(lcs(h, n), -o) for n, o in zip(names, order) if not set(h.split(" ")) & set(n.split(" "))]
            score = lambda reached: round(200 * reached / total[i], 9)
            good = [(k, o) for k, o in apart if score(k) > floor[i] or score(k) == floor[i] and -o < before[i]]
            assert got.get(i) == max(good, default=None), (h, floor[i])


def test_cascade_without_texts(spark, accounts):
    """The same rows, those of notes that come twice too."""
    notes = spark.createDataFrame([(0, "3/1 note (acct 1003)"), (2, "3/3 Beacon Health Group\nfine"), (2, "3/5 Beacon Health Group\nfine"), (4, "qqq"), (5, None)], NOTE)
    known, slim = resolve.resolve_notes(notes, accounts).drop("raw_text"), resolve.resolve_notes(notes, accounts, texts=False)
    assert known.columns == slim.columns and sorted(map(str, known.collect())) == sorted(map(str, slim.collect()))
