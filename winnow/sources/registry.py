"""The catalog of sources: name -> reader of payloads, with defaults and a fold that survives failing sources."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.schema import POSTING, conform
from winnow.sources import boards, pages
from winnow.sources.payloads import payloads as read_payloads

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Source:
    read: Callable[[DataFrame], DataFrame]
    enabled: bool = True
    form: str = "html"
    #: JSON path of the array that holds a payload's items.
    items: str | None = None


#: What a reader takes besides the body, from the `key=value` parts of a payload's path.
ATTRIBUTES = {"company": "string", "channel": "string", "query": "string", "by_date": "boolean", "rank": "int", "page": "int"}

SOURCES: dict[str, Source] = {
    "hh": Source(pages.hh_feed, form="xml"), "remoteok": Source(boards.remoteok, form="json", items="$"), "cryptojoblist": Source(boards.cryptojobslist), "laborx": Source(pages.laborx),
    "remote3": Source(pages.remote3),
    "greenhouse": Source(boards.greenhouse, form="json", items="$.jobs"), "ashby": Source(boards.ashby, form="json", items="$.jobs"), "lever": Source(boards.lever, form="json", items="$"), "linkedin": Source(pages.linkedin), "habr": Source(pages.habr),
    "telegram": Source(lambda p: pages.channel_posts(pages.channel_pages(p))), "web3career": Source(pages.web3career, False),
    "wellfound": Source(partial(pages.link_board, prefix="wf_", site="wellfound.com", base="https://wellfound.com", holds="/jobs/", least_title=6), False),
    "contra": Source(partial(pages.link_board, prefix="ctr_", site="contra.com", base="https://contra.com", holds="/opportunity/", least_title=6), False),
}


def register(name: str, read: Callable[[DataFrame], DataFrame], enabled: bool = True, form: str = "html", items: str | None = None) -> None:
    SOURCES[name] = Source(read, enabled, form, items)


def read_all(spark: SparkSession, payloads: dict[str, DataFrame], enabled: dict[str, bool] | None = None) -> DataFrame:
    """Union of the enabled sources that have payloads. A source whose plan can't be built is logged and left out;
    malformed payloads inside one give no rows."""
    found = []
    for name, rows in payloads.items():
        if not (enabled or {}).get(name, SOURCES[name].enabled):
            continue
        try:
            found.append(SOURCES[name].read(rows))
        except Exception:  # noqa: BLE001  one source must not end the run
            log.exception("source %s failed", name)
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], POSTING)


def read_folder(spark: SparkSession, folder: str, landed: str, enabled: dict[str, bool] | None = None) -> tuple[DataFrame, DataFrame]:
    """Postings and rejects of `folder/source=<name>/[company=<key>/...]<payload>`.

    Payloads are read once and land in the table `landed` by source, of which each reader takes its own part. Rejects (source,
    path, at, error, body) are those that can't be decoded, hold no array of items where their source has one, or are of
    no known source. Sources that are off land as well."""
    rows = read_payloads(spark, folder, forms=json.dumps({n: s.form for n, s in SOURCES.items()})).withColumn("source", F.coalesce(F.col("attrs")["source"], F.lit("")))
    held = F.coalesce(*[F.when(F.col("source") == n, F.json_array_length(F.col("body") if s.items == "$" else F.get_json_object("body", s.items))) for n, s in SOURCES.items() if s.items])
    lost = F.when(~F.col("source").isin(*SOURCES), "unknown source").when(F.col("source").isin(*[n for n, s in SOURCES.items() if s.items]) & held.isNull(), "no array of items")
    rows = rows.withColumn("error", F.coalesce("error", lost))
    rows.write.mode("overwrite").partitionBy("source").parquet(landed)
    rows = spark.read.schema(rows.schema).parquet(landed)
    extra = [F.col("attrs")[k].try_cast(t).alias(k) for k, t in ATTRIBUTES.items()]
    good = {n: rows.where((F.col("source") == n) & F.col("error").isNull()).select("body", *extra) for n in SOURCES}
    return read_all(spark, good, enabled), rows.where("error is not null").select(F.coalesce("source", F.lit("")).alias("source"), "path", "at", "error", "body")


def lines(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Payload rows of JSON lines -> postings and rejects; takes a stream as well."""
    j = F.from_json("body", "id string, title string, company string, description string, source string, url string")
    return conform(rows.where("error is null").select(j.alias("j")).select("j.*")), rows.where("error is not null").select("path", "at", "error", "body")


def jsonl(spark: SparkSession, path: str) -> DataFrame:
    """A dump of postings, one JSON object per line; only \\n ends a line."""
    return conform(spark.read.schema("id string, title string, company string, description string, source string, url string").option("lineSep", "\n").json(path))


def dump(postings: DataFrame, path: str) -> None:
    """Six columns of every posting as JSON lines."""
    postings.select("id", "title", "company", "description", "source", "url").write.json(path)


def id_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''")
