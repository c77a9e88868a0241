"""Source readers on literal payloads."""

from __future__ import annotations

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from winnow.sources import SOURCES, pages


def read(spark, name, body, **more):
    row = {"body": body, **more}
    kinds = {str: "string", int: "int", bool: "boolean"}
    return SOURCES[name].read(spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in row.items()))).collect()


def md5(x):
    return hashlib.md5(x.encode()).hexdigest()[:12]


def test_remote3(spark):
    card = '<a href="/remote-jobs/ops"><p class="body-small text-tertiary-white">Acme</p><h2 class="t">Ops Lead</h2><p>3d</p></a>'
    (r,) = read(spark, "remote3", f'{card}{card}<a href="/remote-jobs/x"><h2>No</h2></a><a href="/about"><h2>About us</h2></a>')
    assert (r.id, r.title, r.company, r.description, r.url) == (f"r3_{md5('/remote-jobs/ops')}", "Ops Lead", "Acme", "Ops Lead at Acme", "https://remote3.co/remote-jobs/ops")
    assert r.published_at is not None


def test_laborx(spark):
    row = lambda *links: '<p class="name-row x">' + " at ".join(links) + "</p>"
    link = lambda href, text: f'<a class="name-link" href="{href}">{text}</a>'
    body = row('<a href="/y">icon</a>', link("/vacancies/ops", "Ops"), link("/c/acme", "Acme")) + row(link("/users/1", "Someone")) + row(link("/vacancies/none", " ")) + row(link("/vacancies/alone", "Alone"))
    got = {r.title: (r.id, r.company, r.description) for r in read(spark, "laborx", body)}
    assert got == {"Ops": (f"lbx_{md5('/vacancies/ops')}", "Acme", "Ops at Acme"), "Alone": (f"lbx_{md5('/vacancies/alone')}", "", "Alone at")}


def test_habr_cards_with_a_modifier(spark):
    card = lambda mark, n: f'<div class="{mark}"><div class="vacancy-card__title"><a href="/vacancies/{n}">Job {n}</a></div><div class="vacancy-card__meta">Удалённо</div></div>'
    rows = read(spark, "habr", card("vacancy-card", 1) + card("vacancy-card vacancy-card--appearance", 2))
    assert {(r.id, r.title, r.is_remote) for r in rows} == {("habr_1", "Job 1", True), ("habr_2", "Job 2", True)}


def test_contra_takes_opportunities_only(spark):
    rows = read(spark, "contra", '<a href="/opportunity/a1">Great work</a><a href="/opportunities">All of the work</a>')
    assert [r.title for r in rows] == ["Great work"]


@pytest.mark.parametrize(("pay", "low", "high"), [("$50k–$80k", 50000, 80000), ("$50k–n/a", 50000, None), ("$50k", 50000, 50000), ("n/a", None, None), ("1–2–3", 1, 3), ("", None, None)])
def test_remoteok_salary(spark, pay, low, high):
    (r,) = read(spark, "remoteok", json.dumps([{"legal": "x"}, {"id": "7", "position": "Ops", "salary": pay}]))
    assert (r.id, r.salary_min, r.salary_max) == ("rok_7", low, high)


def test_channel_text_is_parted_at_every_tag(spark):
    body = '<div class="tgme_widget_message x"><div class="tgme_widget_message_text"><b>Operations manager</b> for a remote job<br/>Salary</div><a class="tgme_widget_message_date" href="https://t.me/c/5"><time datetime="2026-01-01T00:00:00+00:00"></time></a></div>'
    (r,) = pages.channel_pages(spark.createDataFrame([(body, "c")], "body string, channel string")).collect()
    assert (r.post_id, r.text.split("\n")[0]) == ("5", "Operations manager")


@pytest.mark.parametrize(("name", "body", "want"), [
    ("lever", json.dumps([{"id": "1", "text": "Ops", "lists": [{"text": "You", "content": "do"}], "categories": {"location": "Remote"}}]), ("lv_1", "Ops", "Ops\n\nYou\ndo", True)),
    ("ashby", json.dumps({"jobs": [{"id": "1", "title": "Ops", "descriptionPlain": "d", "workplaceType": "Hybrid"}, {"id": "2", "isListed": False}]}), ("ab_1", "Ops", "d\nWork format: Hybrid (on-site presence required)", False)),
    ("greenhouse", json.dumps({"jobs": [{"id": 1, "title": "Ops", "content": "d", "location": {"name": "Remote"}}]}), ("gh_1", "Ops", "d", True)),
])
def test_json_boards(spark, name, body, want):
    (r,) = read(spark, name, body, company="c")
    assert (r.id, r.title, r.description, r.is_remote) == want


def test_hh_feed_keeps_every_id_of_a_feed_that_is_reordered(spark):
    """A feed that gives its items in another order each time it is read, as a shuffle does that isn't sorted."""
    item = "<item><title>job {0}</title><link>http://x/{0}</link><description>a</description><pubDate></pubDate></item>"

    @F.udf("string")
    def body(page, by_date):
        ids = [page * 64 + i for i in range(20 if by_date else 64)]
        random.SystemRandom().shuffle(ids)
        return "<rss><channel>" + "".join(map(item.format, ids)) + "</channel></rss>"

    asked = spark.range(12).select(F.col("id").alias("query"), F.explode(F.array(F.lit(True), F.lit(False))).alias("by_date"))
    rows = pages.hh_feed(asked.select(body.asNondeterministic()("query", "by_date").alias("body"), "query", "by_date")).select("id", "title").collect()
    assert sorted((r.id, r.title) for r in rows) == sorted((f"hh_{i}", f"job {i}") for i in range(12 * 64))
