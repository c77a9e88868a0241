"""Cards of delivered postings, and reading them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions.text import band, blank, escape

# Separators and labels of a card.
RULE = "\n" + "─" * 22 + "\n\n"
DOT = "  ·  "
ROLE_LABELS = {"crypto_ops": "Crypto Ops", "web3_support": "Web3 Support", "ai_automation": "AI Automation"}


def _money(n: Column) -> Column:
    return F.when(F.coalesce(n, F.lit(0)) != 0, F.format_number(n, 0))


def meta_line(company: Column, remote: Column, location: Column, low: Column, high: Column, currency: Column) -> Column:
    place = F.when((blank(location) != "") & ~F.lower(location).isin("remote", "anywhere"), escape(location))
    pay = F.concat_ws("–", _money(low), _money(high))
    return F.concat_ws(DOT, F.concat(F.lit("<b>"), escape(company), F.lit("</b>")), F.when(remote, F.lit("Remote")), place, F.when(pay != "", F.concat(F.lit("💰 "), pay, F.lit(" "), currency)))


def role_line(role: Column, reasons: Column) -> Column:
    label = F.coalesce(*[F.when(role == k, F.lit(v)) for k, v in ROLE_LABELS.items()], role)
    return F.when(blank(role) != "", F.concat(F.lit("🎯 <i>"), F.concat_ws(" · ", escape(label), F.nullif(escape(F.array_join(F.slice(reasons, 1, 3), "; ")), F.lit(""))), F.lit("</i>")))


def _list(head: str, items: Column, n: int) -> Column:
    some = F.slice(F.coalesce(items, F.array().cast("array<string>")), 1, n)
    return F.when(F.size(some) > 0, F.concat(F.lit(head), F.array_join(F.transform(some, lambda x: F.concat(F.lit("\n· "), escape(x))), "")))


def card(title: Column, meta: Column, source: Column, score: Column, fits: Column, watch: Column, recommendation: Column, role: Column) -> Column:
    middle = F.nullif(F.concat_ws("\n" + RULE, _list("✅ <b>Why it fits</b>", fits, 4), _list("⚠️ <b>Consider</b>", watch, 2)), F.lit(""))
    told = F.when(blank(recommendation) != "", F.concat(F.lit("<i>💬 "), escape(recommendation), F.lit("</i>")))
    head = F.concat(band(score), F.lit(" <b>"), escape(title), F.lit("</b>\n"), meta)
    foot = F.concat(F.lit("<code>"), score.cast("string"), F.lit("/100</code>"), F.lit(DOT), escape(source))
    return F.trim(F.concat_ws(RULE, head, middle, told, role, foot))


def read_card(text: Column) -> Column:
    """struct(title, company, score) of a card's plain text: first line without its mark, the second up to the dot,
    and the last line that holds a score."""
    lines = F.filter(F.transform(F.split(text, "\n"), F.trim), lambda x: x != "")
    told = F.filter(lines, lambda x: x.contains("/100"))
    score = F.regexp_extract(F.try_element_at(told, F.lit(-1)), r"(\d+)/100", 1).try_cast("int")
    title = F.trim(F.regexp_replace(F.get(lines, F.lit(0)), r"(?U)^[^\w]+", ""))
    return F.struct(title.alias("title"), F.trim(F.get(F.split(F.get(lines, F.lit(1)), "·"), F.lit(0))).alias("company"), score.alias("score"))


def summary(parsed: Column, sent: Column, sources: Column) -> Column:
    names = F.when(F.size(sources) > 0, F.array_join(sources, ", ")).otherwise("—")
    return F.concat(F.lit("📊 <b>Summary</b>\n\n🔍 Seen: <b>"), parsed.cast("string"), F.lit("</b>\n📨 Sent: <b>"), sent.cast("string"), F.lit("</b>\n📡 Sources: "), names)


def applied_mark(text: Column, now: Column) -> Column:
    """A card's text after its posting was applied for, with day and month."""
    return F.concat(text, F.lit("\n\n✅ <b>Applied · "), F.date_format(now, "dd.MM"), F.lit("</b>"))


def application_line(applied_at: Column, title: Column, company: Column, url: Column, score: Column) -> Column:
    """Date, title as a link where there is one, then company and score where they are known."""
    name = F.coalesce(F.nullif(escape(title), F.lit("")), F.lit("untitled"))
    head = F.when(blank(url) != "", F.concat(F.lit('<a href="'), url, F.lit('">'), name, F.lit("</a>"))).otherwise(name)
    firm, points = F.concat(F.lit(" — "), F.nullif(escape(company), F.lit(""))), F.concat(F.lit(" · "), score.cast("string"), F.lit("/100"))
    return F.concat(F.lit("· "), blank(F.date_format(applied_at, "yyyy-MM-dd")), F.lit(" — "), head, blank(firm), blank(points))


def _joined(rows: DataFrame, order: list[Column]) -> DataFrame:
    """One row with the array `lines` of a few rows' lines in order; no rows, an empty array."""
    return rows.agg(F.transform(F.sort_array(F.collect_list(F.struct(*order, "line"))), lambda x: x["line"]).alias("lines"))


def applications_message(recent: DataFrame, stats: DataFrame) -> DataFrame:
    """One row, `message`: totals, how many are stale if any, and a line for each of the few rows of `recent` (job_id, title,
    company, url, score, applied_at), newest first; without rows, that there are none."""
    told = recent.withColumn("line", application_line(*[F.col(c) for c in ("applied_at", "title", "company", "url", "score")]))
    lines = _joined(told, [F.col("applied_at").isNull().alias("n"), (-F.unix_micros(F.col("applied_at").cast("timestamp"))).alias("a"), F.col("job_id")])
    n = lambda c: F.col(c).cast("string")
    head = F.concat(F.lit("📋 <b>Applications</b> — "), n("total"), F.lit(" in all, "), n("last7"), F.lit(" in 7 days"))
    stale = F.when(F.col("stale") > 0, F.concat(F.lit("⏳ No answer for over "), n("stale_days"), F.lit(" days: <b>"), n("stale"), F.lit("</b>")))
    rows = lines.crossJoin(stats)  # one row each
    return rows.select(F.when(F.size("lines") == 0, F.lit("No applications yet.")).otherwise(F.concat_ws("\n", head, stale, F.lit("─" * 22), F.col("lines"))).alias("message"))


def digest_message(items: DataFrame, title: str) -> DataFrame:
    """One row, `message`: a title, a blank line and a line with day and month for each of a digest's items (when, title,
    link), newest first, those without a date last; null without items."""
    day = F.coalesce(F.date_format("when", "dd.MM"), F.lit("—"))
    told = items.withColumn("line", F.concat(F.lit("• "), day, F.lit(' <a href="'), F.col("link"), F.lit('">'), F.col("title"), F.lit("</a>")))
    lines = _joined(told, [F.col("when").isNull().alias("n"), (-F.unix_micros(F.col("when").cast("timestamp"))).alias("a"), F.col("link")])
    return lines.select(F.when(F.size("lines") > 0, F.concat_ws("\n", F.lit(f"<b>{title}</b>"), F.lit(""), F.col("lines"))).alias("message"))
