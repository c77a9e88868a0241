"""Boards that answer in JSON: payloads are decoded with fixed schemas; malformed payloads give no row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.functions import text as tx
from winnow.schema import conform


def _items(payloads: DataFrame, schema: str, path=None) -> DataFrame:
    parsed = F.from_json("body", schema, {"mode": "PERMISSIVE"})
    return payloads.select(*[c for c in payloads.columns if c != "body"], F.explode(path(parsed) if path else parsed).alias("j"))


def greenhouse(payloads: DataFrame) -> DataFrame:
    """body, company -> postings. The location's name, else the first office's."""
    job = "struct<id:string,title:string,absolute_url:string,content:string,updated_at:string,created_at:string,location:struct<name:string>,offices:array<struct<name:string>>>"
    rows = _items(payloads, f"jobs array<{job}>", lambda p: p.jobs)
    j = F.col("j")
    place = F.coalesce(F.nullif(j.location["name"], F.lit("")), F.get(j.offices, F.lit(0))["name"], F.lit(""))
    text = tx.description(j.content)
    return conform(rows.select(
        F.concat(F.lit("gh_"), j.id).alias("id"), tx.blank(j.title).alias("title"), "company", text.alias("description"), tx.blank(j.absolute_url).alias("url"), F.lit("greenhouse").alias("source"),
        place.alias("location"), tx.is_remote(place, text, F.lit(None).cast("string"), F.lit(None).cast("boolean")).alias("is_remote"),
        tx.moment(F.coalesce(F.nullif(j.updated_at, F.lit("")), j.created_at)).alias("published_at"),
    ))


def lever(payloads: DataFrame) -> DataFrame:
    """body, company -> postings. The text and every list, joined by blank lines; createdAt in milliseconds."""
    job = "struct<id:string,text:string,hostedUrl:string,applyUrl:string,createdAt:bigint,categories:struct<location:string,commitment:string,team:string>,lists:array<struct<text:string,content:string>>>"
    rows = _items(payloads, f"array<{job}>")
    j = F.col("j")
    parts = F.concat(F.array(tx.blank(j.text)), F.coalesce(F.transform(j.lists, lambda x: F.concat(tx.blank(x.text), F.lit("\n"), tx.blank(x.content))), F.array().cast("array<string>")))
    text = tx.description(F.trim(F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")))
    place, kind, team = tx.blank(j.categories.location), tx.blank(j.categories.commitment), tx.blank(j.categories.team)
    return conform(rows.select(
        F.concat(F.lit("lv_"), j.id).alias("id"), tx.blank(j.text).alias("title"), "company", text.alias("description"),
        F.coalesce(F.nullif(j.hostedUrl, F.lit("")), j.applyUrl, F.lit("")).alias("url"), F.lit("lever").alias("source"), place.alias("location"),
        tx.is_remote(F.concat_ws(" ", place, kind), text, F.lit(None).cast("string"), F.lit(None).cast("boolean")).alias("is_remote"),
        F.when((team != "") | (kind != ""), F.array(team, kind)).otherwise(F.array().cast("array<string>")).alias("tags"), F.timestamp_millis(F.coalesce(j.createdAt, F.lit(0))).alias("published_at"),
    ))


def ashby(payloads: DataFrame) -> DataFrame:
    """body, company -> listed postings. workplaceType decides on remote; on-site work is noted in the text."""
    job = "struct<id:string,title:string,location:string,workplaceType:string,isRemote:boolean,isListed:boolean,descriptionPlain:string,jobUrl:string,applyUrl:string,publishedAt:string>"
    rows = _items(payloads, f"jobs array<{job}>", lambda p: p.jobs).where(F.coalesce("j.isListed", F.lit(True)))
    j = F.col("j")
    text = tx.description(j.descriptionPlain)
    return conform(rows.select(
        F.concat(F.lit("ab_"), j.id).alias("id"), tx.blank(j.title).alias("title"), "company", F.concat(text, tx.on_site_note(j.workplaceType)).alias("description"),
        F.coalesce(F.nullif(j.jobUrl, F.lit("")), j.applyUrl, F.lit("")).alias("url"), F.lit("ashby").alias("source"), tx.blank(j.location).alias("location"),
        tx.is_remote(j.location, text, j.workplaceType, j.isRemote).alias("is_remote"), tx.moment(j.publishedAt).alias("published_at"),
    ))


def remoteok(payloads: DataFrame) -> DataFrame:
    """body -> postings. The first element is about the feed itself."""
    job = "struct<id:string,position:string,company:string,description:string,url:string,epoch:bigint,salary:string,tags:array<string>>"
    rows = payloads.select(F.posexplode(F.from_json("body", f"array<{job}>")).alias("pos", "j")).where("pos > 0")
    j, pay = F.col("j"), tx.dashed_salary(tx.blank(F.col("j.salary")))
    return conform(rows.select(
        F.concat(F.lit("rok_"), j.id).alias("id"), tx.blank(j.position).alias("title"), tx.blank(j.company).alias("company"), tx.description(j.description).alias("description"), tx.blank(j.url).alias("url"),
        F.lit("remoteok.com").alias("source"), pay.low.alias("salary_min"), pay.high.alias("salary_max"), F.lit("USD").alias("salary_currency"), F.lit(True).alias("is_remote"),
        F.when(j.epoch != 0, F.timestamp_seconds(j.epoch)).alias("published_at"), j.tags.alias("tags"),
    ))


def cryptojobslist(payloads: DataFrame, base: str = "https://cryptojobslist.com") -> DataFrame:
    """body (a page) -> postings from the script that holds the page's data; yearly pay becomes monthly."""
    job = (
        "struct<id:string,seoSlug:string,jobTitle:string,companyName:string,jobLocation:string,remote:boolean,publishedAt:string,tags:array<string>,jobPostingJSONLD:string,"
        "salary:struct<minValue:bigint,maxValue:bigint,currency:string,unitText:string>>"
    )
    scripts = F.regexp_extract_all("body", F.lit(r"(?s)<script[^>]*>(.*?)</script>"), F.lit(1))
    data = F.get(F.filter(scripts, lambda s: s.contains("pageProps") & s.contains("jobTitle")), F.lit(0))
    parsed = F.from_json(data, f"props struct<pageProps:struct<jobs:array<{job}>>>")
    rows = payloads.select(F.explode(parsed.props.pageProps.jobs).alias("j"))
    j = F.col("j")
    pay = lambda c: F.when(j.salary.unitText == "YEAR", tx.monthly(c)).otherwise(c.cast("int"))
    told = F.nullif(F.get_json_object(j.jobPostingJSONLD, "$.description"), F.lit(""))
    made = F.concat(tx.blank(j.jobTitle), F.lit(" at "), tx.blank(j.companyName), F.lit(". Location: "), tx.blank(j.jobLocation), F.lit(". Tags: "), tx.blank(F.array_join(j.tags, ", ")))
    return conform(rows.select(
        F.concat(F.lit("cjl_"), F.coalesce(j.id, F.left(j.seoSlug, F.lit(20)))).alias("id"), tx.blank(j.jobTitle).alias("title"), tx.blank(j.companyName).alias("company"),
        tx.description(F.coalesce(told, made)).alias("description"), F.concat_ws("/", F.lit(base), F.nullif(j.seoSlug, F.lit(""))).alias("url"), F.lit("cryptojobslist.com").alias("source"),
        pay(j.salary.minValue).alias("salary_min"), pay(j.salary.maxValue).alias("salary_max"), F.coalesce(j.salary.currency, F.lit("USD")).alias("salary_currency"),
        F.coalesce(j.remote, F.lit(False)).alias("is_remote"), tx.moment(j.publishedAt).alias("published_at"), j.tags.alias("tags"),
    ))
