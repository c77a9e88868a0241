"""Sources in HTML and XML: cards and links by patterns, feeds by the XML functions.

Names of classes and attributes in the patterns are fixed values: they must be those of the sites' markup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions import html as hx
from winnow.functions import text as tx
from winnow.operators.funnel_ops import keep_first
from winnow.schema import conform


def absolute(href: Column, base: str) -> Column:
    return F.when(href.startswith("http"), href).otherwise(F.concat(F.lit(base), href))


def after_first(parts: Column) -> Column:
    return F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))


def links(html: Column, holds: str = "") -> Column:
    """array<struct<href, title>> of anchors whose address holds a string, titles without tags."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*href=[\"'][^\"']*" + holds + r"[^\"']*[\"'][^>]*>.*?</a>"), F.lit(0))
    return F.transform(found, lambda a: F.struct(F.regexp_extract(a, r"(?i)href=[\"']([^\"']*)", 1).alias("href"), tx.plain(a).alias("title")))


def link_board(payloads: DataFrame, prefix: str, site: str, base: str, holds: str, least_title: int = 1) -> DataFrame:
    """Boards read as links: ids from the address, one row per address."""
    rows = payloads.select(F.explode(links(F.col("body"), holds)).alias("a")).where(F.length("a.title") >= least_title)
    url = absolute(F.col("a.href"), base)
    rows = rows.select(F.concat(F.lit(prefix), tx.short_md5(url)).alias("id"), F.col("a.title").alias("title"), F.lit("").alias("company"), F.col("a.title").alias("description"), url.alias("url"), F.lit(site).alias("source"), F.lit(True).alias("is_remote"))
    return conform(keep_first(rows, F.col("id"), ["title"]).dropDuplicates(["id"]))


def web3career(payloads: DataFrame, base: str = "https://web3.career") -> DataFrame:
    """Cards if a page has any, else its links to jobs."""
    mark = r"(?:job_seen_beacon|data-jobid|job-card|class=\"job\")"
    cards = F.concat(*[hx.elements(F.col("body"), name, mark) for name in ("tr", "div", "article")])
    pick = lambda c, form: tx.plain(F.regexp_extract(c, form, 1))
    rows = payloads.withColumn("cards", cards)
    told = rows.select(F.explode("cards").alias("c"))
    url = F.when(F.col("href") != "", absolute(F.col("href"), base)).otherwise("")
    told = told.select(
        pick(F.col("c"), r"(?is)<h[23][^>]*>(.*?)</h[23]>").alias("title"), pick(F.col("c"), r"(?is)class=\"company(?:-name)?\"[^>]*>(.*?)<").alias("company"),
        F.regexp_extract("c", r"(?i)href=\"([^\"]*)", 1).alias("href"), F.transform(F.regexp_extract_all("c", F.lit(r"(?is)class=\"(?:tag|badge|skill)\"[^>]*>(.*?)<"), F.lit(1)), tx.plain).alias("tags"),
    )
    told = told.select(
        F.concat(F.lit("w3c_"), tx.short_md5(url)).alias("id"), "title", "company", F.concat(F.col("title"), F.lit(" at "), F.col("company"), F.lit(". Tags: "), F.array_join("tags", ", ")).alias("description"),
        url.alias("url"), F.lit("web3.career").alias("source"), F.lit(True).alias("is_remote"), "tags",
    )
    return conform(told).unionByName(link_board(rows.where(F.size("cards") == 0), "w3c_", "web3.career", base, "/job/"))


def at_company(title: Column, company: Column) -> Column:
    return F.btrim(F.concat(title, F.lit(" at "), company), F.lit(". "))


def remote3(payloads: DataFrame, base: str = "https://remote3.co") -> DataFrame:
    """Cards are links; title and company are elements inside, the id comes from the address as written."""
    found = F.regexp_extract_all("body", F.lit(r"(?is)<a\b[^>]*href=[\"'][^\"']*/remote-jobs/[^\"']*[\"'][^>]*>.*?</a>"), F.lit(0))
    a = F.col("a")
    rows = payloads.select(F.explode(found).alias("a")).select(
        F.regexp_extract(a, r"(?i)href=[\"']([^\"']*)", 1).alias("href"), tx.plain(F.regexp_extract(a, r"(?is)<h2\b[^>]*>(.*?)</h2>", 1)).alias("title"),
        tx.plain(F.regexp_extract(a, r"(?is)<p\b[^>]*class=\"(?:[^\"]* )?body-small(?: [^\"]*)?\"[^>]*>(.*?)</p>", 1)).alias("company"),
    ).where(F.length("title") >= 3)
    rows = rows.select(
        F.concat(F.lit("r3_"), F.left(F.md5("href"), F.lit(12))).alias("id"), "title", "company", at_company(F.col("title"), F.col("company")).alias("description"),
        absolute(F.col("href"), base).alias("url"), F.lit("remote3.co").alias("source"), F.lit(True).alias("is_remote"), F.current_timestamp().alias("published_at"),
    )
    return conform(keep_first(rows, F.col("id"), ["title"]).dropDuplicates(["id"]))


def laborx(payloads: DataFrame, base: str = "https://laborx.com") -> DataFrame:
    """Rows of names: the first name link is the title of a vacancy, the second the company; one row per address."""
    rows = payloads.select(F.explode(F.regexp_extract_all("body", F.lit(r"(?is)<p[^>]*name-row[^>]*>.*?</p>"), F.lit(0))).alias("p"))
    named = F.filter(F.regexp_extract_all("p", F.lit(r"(?is)<a\b[^>]*>.*?</a>"), F.lit(0)), lambda a: a.rlike(r"(?i)^<a\b[^>]*class=\"(?:[^\"]* )?name-link(?: [^\"]*)?\""))
    rows = rows.select(F.transform(named, lambda a: F.struct(F.regexp_extract(a, r"(?i)href=[\"']([^\"']*)", 1).alias("href"), tx.plain(a).alias("title"))).alias("l"))
    href, title, company = F.get("l", F.lit(0)).href, F.get("l", F.lit(0)).title, tx.blank(F.get("l", F.lit(1)).title)
    rows = rows.where(href.contains("/vacancies/") & (title != ""))
    rows = rows.select(
        F.concat(F.lit("lbx_"), tx.short_md5(href)).alias("id"), title.alias("title"), company.alias("company"), at_company(title, company).alias("description"),
        absolute(href, base).alias("url"), F.lit("laborx.com").alias("source"), F.lit(True).alias("is_remote"), F.current_timestamp().alias("published_at"),
    )
    return conform(rows.dropDuplicates(["id"]))


def habr(payloads: DataFrame, base: str = "https://career.habr.com") -> DataFrame:
    """Vacancy cards; the description is put together from title, skills and meta line."""
    c = F.col("c")
    rows = payloads.select(F.explode(after_first(F.split("body", r"class=\"(?:[^\"]* )?vacancy-card(?: [^\"]*)?\""))).alias("c"))
    part = lambda name: tx.blank(tx.plain(hx.first_with(c, hx.class_is(f"vacancy-card__{name}"))))
    href = F.regexp_extract(c, r"(?is)vacancy-card__title\"[^>]*>.*?href=\"([^\"]*)", 1)
    rows = rows.select(
        F.regexp_extract(href, r"([^/]+)/*$", 1).alias("vid"), part("title").alias("title"), tx.plain(F.regexp_extract(c, r"(?is)(<a[^>]*href=\"[^\"]*/companies/[^\"]*\"[^>]*>.*?</a>)", 1)).alias("company"),
        part("skills").alias("skills"), part("meta").alias("meta"), absolute(href, base).alias("url"),
    ).where("vid <> '' and title <> ''")
    text = F.concat_ws(". ", F.col("title"), F.when(F.col("skills") != "", F.concat(F.lit("Навыки: "), F.col("skills"))), F.nullif(F.col("meta"), F.lit("")))
    return conform(rows.select(
        F.concat(F.lit("habr_"), F.col("vid")).alias("id"), "title", "company", text.alias("description"), "url", F.lit("career.habr.com").alias("source"), F.nullif(F.col("meta"), F.lit("")).alias("location"),
        F.lower(F.concat_ws(" ", "meta", "skills")).contains("удал").alias("is_remote"),
    ).dropDuplicates(["id"]))


def linkedin(payloads: DataFrame, most: int = 400) -> DataFrame:
    """body, rank (watched companies first), page -> cards, the first `most` of them by rank; one row per id."""
    b = F.col("b")
    take = lambda form: tx.plain(F.regexp_extract(b, form, 1))
    rows = payloads.select("rank", "page", F.posexplode(after_first(F.split("body", "<li>"))).alias("pos", "b"))
    url = F.regexp_extract(b, r"href=\"(https://[a-z.]*linkedin\.com/jobs/view/[^\"?]+)", 1)
    rows = rows.select(
        "rank", "page", "pos", url.alias("url"), take(r"base-search-card__title\"[^>]*>\s*([^<]+)").alias("title"), take(r"base-search-card__subtitle\"[^>]*>\s*(?:<a[^>]*>)?\s*([^<]+)").alias("company"),
        take(r"job-search-card__location\"[^>]*>\s*([^<]+)").alias("location"),
    ).where("url <> '' and title <> ''")
    number = F.regexp_extract("url", r"-(\d+)$", 1)
    rows = rows.withColumn("id", F.concat(F.lit("li_"), F.when(number != "", number).otherwise(F.col("url"))))
    first = keep_first(rows, F.col("id"), ["rank", "page", "pos"]).orderBy("rank", "page", "pos").limit(most)
    return conform(first.withColumns({"source": F.lit("linkedin.com"), "is_remote": tx.place_is_remote(F.col("location"))}))


def feed_items(payloads: DataFrame) -> DataFrame:
    """body (RSS) -> one row per item with title, link, description, pubDate; other columns pass."""
    item = "struct<title:string,link:string,description:string,pubDate:string>"
    body = F.regexp_extract("body", r"(?s)(<channel\b.*</channel>)", 1)
    parsed = F.from_xml(F.when(body != "", body), f"item array<{item}>")
    return payloads.select(*[c for c in payloads.columns if c != "body"], F.posexplode(parsed.item).alias("pos", "i")).select("*", "i.*").drop("i")


def hh_feed(payloads: DataFrame, cap: int = 20) -> DataFrame:
    """body, query, by_date -> postings. Pages by relevance count only for queries whose page by date is full."""
    items = feed_items(payloads)
    full = items.where("by_date").groupBy("query").agg(F.count("*").alias("n")).where(F.col("n") >= cap).select("query")
    items = items.where("by_date").unionByName(items.where("not by_date").join(full, "query", "left_semi"))
    text = F.regexp_replace(tx.unescape(F.regexp_replace("description", r"<[^>]+>", "\n")), r"\n\s*", "\n")
    lines = F.filter(F.transform(F.split(text, "\n"), F.trim), lambda x: x != "")
    line = lambda *marks: F.get(F.filter(lines, lambda x: tx.contains_any(F.lower(x), marks)), F.lit(0))
    value = lambda x: F.trim(F.regexp_replace(x, r"^[^:]*:", ""))
    pay = line("уровень", "доход", "зарплата:")
    rows = items.withColumns({"_pay": tx.range_salary(F.when(~F.lower(pay).contains("не указан"), pay)), "_place": tx.blank(value(line("регион:", "город:"))), "_text": F.array_join(lines, "\n")})
    rows = rows.select(
        F.concat(F.lit("hh_"), F.regexp_extract("link", r"([^/]+)/*$", 1)).alias("id"), tx.blank(F.col("title")).alias("title"), tx.blank(value(line("вакансия компании:"))).alias("company"),
        tx.description(F.col("_text")).alias("description"), tx.blank(F.col("link")).alias("url"), F.lit("hh.ru").alias("source"), F.col("_pay.low").alias("salary_min"), F.col("_pay.high").alias("salary_max"),
        F.coalesce("_pay.currency", F.lit("RUB")).alias("salary_currency"), F.col("_place").alias("location"),
        tx.is_remote(F.col("_place"), F.col("_text"), F.lit(None).cast("string"), F.lit(None).cast("boolean")).alias("is_remote"), tx.moment(F.col("pubDate")).alias("published_at"), "by_date", "pos", "query",
    )
    # One aggregate and no join back: a feed whose items come in another order when it is read again would lose rows by one.
    kept = [c for c in rows.columns if c not in ("id", "by_date", "pos", "query")]
    one = rows.where("id is not null").groupBy("id").agg(F.min_by(F.struct(*kept), F.struct(~F.col("by_date"), "pos", "query")).alias("r"))
    return conform(one.select("id", "r.*"))


def news(payloads: DataFrame, keywords: tuple[str, ...], cutoff: Column) -> DataFrame:
    """body, feed -> items whose title holds a keyword, not older than the cutoff or without a date."""
    rows = feed_items(payloads).select(tx.moment(F.col("pubDate")).alias("when"), "feed", F.trim("title").alias("title"), F.trim("link").alias("link"))
    return rows.where(tx.contains_any(F.lower("title"), keywords) & (F.col("when").isNull() | (F.col("when") >= cutoff)))


def channel_posts(posts: DataFrame) -> DataFrame:
    """channel, post_id, text, url, at -> postings of kept posts."""
    lines = F.filter(F.transform(F.split("text", "\n"), F.trim), lambda x: x != "")
    low, pay = F.lower("text"), tx.post_salary(F.col("text"))
    return conform(posts.where(tx.post_kept(F.col("text"))).select(
        F.concat(F.lit("tg_"), tx.short_md5(F.col("channel"), F.col("post_id").cast("string"))).alias("id"), tx.pick_title(lines).alias("title"), F.concat(F.lit("@"), F.col("channel")).alias("company"),
        tx.description(F.col("text")).alias("description"), "url", F.concat(F.lit("telegram:"), F.col("channel")).alias("source"), pay.low.cast("int").alias("salary_min"), pay.high.cast("int").alias("salary_max"),
        pay.currency.alias("salary_currency"), tx.contains_any(low, ("remote", "удалённо", "удаленно", "дистанционно", "🌍", "🌎")).alias("is_remote"), F.col("at").alias("published_at"),
    ))


def channel_pages(payloads: DataFrame) -> DataFrame:
    """body (a channel's preview), channel -> posts for channel_posts."""
    m = F.col("m")
    rows = payloads.select("channel", F.explode(after_first(F.split("body", r"<div class=\"tgme_widget_message[ \"]"))).alias("m"))
    raw = tx.blank(hx.inner(hx.first_with(m, hx.class_is("tgme_widget_message_text"))))
    url = F.regexp_extract(m, r"(?is)<a[^>]*tgme_widget_message_date[^>]*href=\"([^\"]*)", 1)
    text = F.btrim(tx.unescape(F.regexp_replace(raw, r"(?:<[^>]+>)+", "\n")), F.lit(" \n"))
    return rows.select("channel", F.regexp_extract(url, r"([^/]+)/*$", 1).alias("post_id"), text.alias("text"), url.alias("url"), tx.moment(F.regexp_extract(m, r"datetime=\"([^\"]*)", 1)).alias("at")).where("text <> ''")


def full_text(html: Column, least: int = 300) -> Column:
    """The vacancy's own element of a page, the first of the known ones with `least` characters; null without one."""
    section = hx.first_with(html, hx.attribute_is("data-qa", "vacancy-section"))
    own = hx.class_is("vacancy-description")
    found = [hx.first_with(html, hx.attribute_is("data-qa", "vacancy-description")), hx.first_with(section, own), hx.first_with(html, own)]
    return F.coalesce(*[F.when(F.length(t) >= least, t) for t in map(tx.plain, found)])


def probe(pages: DataFrame) -> DataFrame:
    """url, html -> what kind of feed a page is, its distinct job-like links and its cards."""
    low = F.lower("html")
    kind = F.when(low.contains("<rss") | low.contains("<feed"), "RSS/XML").when(low.contains("__next_data__"), "NEXT_DATA(JSON)").when(low.contains("algolia"), "Algolia SPA").when(low.contains("graphql"), "GraphQL SPA").otherwise("HTML")
    n_links = F.size(F.array_distinct(F.regexp_extract_all("html", F.lit(r'href="(/[a-z0-9-]+/[a-z0-9-]{6,})"'), F.lit(1))))
    n_cards = F.regexp_count("html", F.lit("vacancy-card|job-card|JobCard|posting-"))
    rows = pages.select("url", F.length("html").alias("chars"), kind.alias("feed"), n_links.alias("links"), n_cards.alias("cards"))
    return rows.withColumn("sound", F.col("feed").isin("RSS/XML", "NEXT_DATA(JSON)") | (F.col("cards") > 20) | (F.col("links") > 10))


def probe_titles(rows: DataFrame, words: tuple[str, ...], least: int = 3) -> DataFrame:
    """slug, board, title -> totals, those with a word of operations, and whether to add the board."""
    hit = tx.contains_any(F.lower("title"), words)
    return rows.groupBy("slug", "board").agg(F.count("*").alias("total"), F.count_if(hit).alias("ops")).withColumn("add", F.col("ops") >= least)
