"""Messages of lists and digests on odd rows, and fingerprints that follow pack, code and instruction."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from winnow.operators import cards, gates, state
from winnow.plans import rules

ROWS = "job_id string, title string, company string, url string, score int, applied_at timestamp, status string"
NOW = dt.datetime(2026, 3, 20)


def message(spark, rows):
    table = spark.createDataFrame(rows, ROWS)
    return cards.applications_message(state.applications_recent(table, 15), state.application_stats(table, F.lit(NOW))).collect()[0].message


def test_applications(spark):
    assert message(spark, []) == "No applications yet."
    rows = [("b", "A & <B>", "C&D", "https://x", 0, dt.datetime(2026, 3, 19, 23), "applied"), ("a", None, None, None, None, dt.datetime(2026, 3, 1), "applied"), ("c", "", "", "", 7, None, "applied")]
    assert message(spark, rows).split("\n") == [
        "📋 <b>Applications</b> — 3 in all, 1 in 7 days", "⏳ No answer for over 14 days: <b>1</b>", "─" * 22,
        '· 2026-03-19 — <a href="https://x">A &amp; &lt;B&gt;</a> — C&amp;D · 0/100', "· 2026-03-01 — untitled", "·  — untitled · 7/100",
    ]
    assert message(spark, rows[:2]).split("\n")[3:] == ["· 2026-03-19 — <a href=\"https://x\">A &amp; &lt;B&gt;</a> — C&amp;D · 0/100", "· 2026-03-01 — untitled"]
    assert "⏳" not in message(spark, rows[:1])
    assert len(message(spark, rows * 9).split("\n")) == 3 + 15


def test_digest_and_mark(spark):
    items = spark.createDataFrame([(None, "t0", "l0"), (dt.datetime(2026, 3, 4), "t1", "l1"), (dt.datetime(2026, 3, 9), "t2", "l2")], "when timestamp, title string, link string")
    assert cards.digest_message(items, "News").collect()[0].message.split("\n") == ["<b>News</b>", "", '• 09.03 <a href="l2">t2</a>', '• 04.03 <a href="l1">t1</a>', '• — <a href="l0">t0</a>']
    assert cards.digest_message(items.where("false"), "News").collect()[0].message is None
    assert spark.range(1).select(cards.applied_mark(F.lit("x"), F.lit(NOW))).collect()[0][0] == "x\n\n✅ <b>Applied · 20.03</b>"


def test_fingerprints(monkeypatch):
    pack, other = rules.demo_pack(), rules.demo_pack()
    other.weights["remote"] += 1
    assert pack.fingerprint() == rules.demo_pack().fingerprint() != other.fingerprint()
    assert len({p.scoring_version(*x) for p in (pack, other) for x in (("do", "me"), ("do", "you"), ("dom", "e"))}) == 6
    before = pack.fingerprint()
    real = rules.inspect.getsource
    rules.code_fingerprint.cache_clear()
    monkeypatch.setattr(rules.inspect, "getsource", lambda m: real(m) + ("# changed" if m is gates else ""))
    assert pack.fingerprint() != before and pack.scoring_version("a", "b") == rules.demo_pack().scoring_version("a", "b")
    rules.code_fingerprint.cache_clear()
