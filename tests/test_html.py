"""Whole elements against a parser, and pages with nested elements for every reader that takes them."""

from __future__ import annotations

import hashlib
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from winnow import queries as q
from winnow.functions import html as hx
from winnow.sources import pages


class Tree(HTMLParser):
    """Spans of all elements of a name, with their attributes: an end tag closes the innermost open one."""

    def __init__(self, text, name):
        super().__init__()
        self.text, self.name, self.open, self.found = text, name, [], []
        self.lines = [0]
        for line in text.split("\n"):
            self.lines.append(self.lines[-1] + len(line) + 1)
        self.feed(text)
        self.found += [(at, len(text), attrs) for at, attrs in self.open]
        self.found.sort(key=lambda x: x[0])

    def at(self):
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def handle_starttag(self, tag, attrs):
        if tag == self.name:
            self.open.append((self.at(), dict(attrs)))

    def handle_endtag(self, tag):
        if tag == self.name and self.open:
            start, attrs = self.open.pop()
            self.found.append((start, self.text.index(">", self.at()) + 1, attrs))


def elements(text, name):
    text = re.sub(r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", "", text or "")
    return [(text[a:b], attrs) for a, b, attrs in Tree(text, name).found]


def test_all_pages_by_parser(spark, sf):
    html = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", q._as_vacancies(F.col("html")).alias("html")).collect()}
    found = q.QUERIES["page_elements"](spark, sf).collect()
    assert len(found) == len(html)
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    for r in found:
        own = [e for e, attrs in elements(html[r.page_id], "div") if attrs.get("data-qa") == "vacancy-description"]
        assert (r.own_chars, r.own_md5) == ((len(own[0]), md5(own[0])) if own else (None, None))
        for name in ("nav", "li", "div"):
            assert r[f"{name}_md5"] == md5("|".join(e for e, _ in elements(html[r.page_id], name)))


@pytest.mark.parametrize(("html", "want"), [
    ('<div id="a"><div>x</div>y</div>z', ['<div id="a"><div>x</div>y</div>', "<div>x</div>"]),
    ("<DIV>a<divider>b</divider></DIV>c", ["<DIV>a<divider>b</divider></DIV>"]),
    ("<div>open<div>in</div>", ["<div>open<div>in</div>", "<div>in</div>"]),
    ("</div><div>late</div>", ["<div>late</div>"]),
    ("<!-- <div> --><div>a<script>'<div>'</script></div><div>b</div>", ["<div>a</div>", "<div>b</div>"]),
    ("no element", []), ("", []), (None, None), ("<div", []),
    ("<div>" * 300 + "deep" + "</div>" * 300, None),
])
def test_elements(spark, html, want):
    (r,) = spark.createDataFrame([(html,)], "html string").select(hx.elements(F.col("html"), "div").alias("e"), hx.first_with(F.col("html"), "").alias("first")).collect()
    if want is None and html:
        want = ["<div>" * k + "deep" + "</div>" * k for k in range(300, 0, -1)]
    assert r.e == want


def test_full_text(spark):
    long = "word " * 70
    def one(body):
        return spark.createDataFrame([(body,)], "b string").select(pages.full_text(F.col("b"))).first()[0]

    nested = f'<body><menu>Menu</menu><div data-qa="vacancy-description" class="g"><div><p>{long}</p></div><ul><li>last</li></ul></div><footer>foot</footer></body>'
    assert one(nested) == long + "last"
    assert one(f'<div data-qa="vacancy-description">short</div><section data-qa="vacancy-section"><div class="x vacancy-description"><div>a</div>{long}</div></section>') == "a " + long.strip()
    assert one(f'<div class="vacancy-description-old">{long}</div><p class="vacancy-description">{long}</p>') == long.strip()
    assert one(f"<body>{long}</body>") is None and one(None) is None


def test_channel_post_keeps_what_follows_an_inner_element(spark):
    post = '<div class="tgme_widget_message x"><div class="tgme_widget_message_text js">Operations manager<div class="quote">We are hiring</div>salary 2000 USD</div><a class="tgme_widget_message_date" href="https://t.me/c/5"></a></div>'
    (r,) = pages.channel_pages(spark.createDataFrame([(post, "c")], "body string, channel string")).collect()
    assert r.text.split("\n") == ["Operations manager", "We are hiring", "salary 2000 USD"]


def test_habr_parts_with_inner_elements(spark):
    card = '<div class="vacancy-card"><div class="vacancy-card__title"><a href="/vacancies/1">Job</a></div><div class="vacancy-card__skills"><div>Python</div> <div>SQL</div></div><div class="vacancy-card__meta"><div>Офис</div><div>Удалённо</div></div></div>'
    (r,) = pages.habr(spark.createDataFrame([(card,)], "body string")).collect()
    assert r.description == "Job. Навыки: Python SQL. Офис Удалённо" and r.is_remote


def test_web3_card_with_inner_elements(spark):
    card = '<div class="job-card"><div><h2>Ops</h2></div><div><span class="company">Acme<</span></div><a href="/x/1">go</a><div><span class="tag">defi</span></div></div><a href="/job/2">Other job</a>'
    (r,) = pages.web3career(spark.createDataFrame([(card,)], "body string")).collect()
    assert (r.title, r.company, r.tags, r.url) == ("Ops", "Acme", ["defi"], "https://web3.career/x/1")
