"""Operators between gates and delivery: near-duplicate collapse, batches, ranking, scoring with failover, causes."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from winnow.functions import text as tx
from winnow.tables import numbered


def keep_first(rows: DataFrame, key: Column, order: list[Column | str]) -> DataFrame:
    """The first row per key by order. The smallest order is found by a combining aggregate and joined back, so a
    key that holds a large part of the rows doesn't meet in one task."""
    ordered = rows.withColumn("_key", key).withColumn("_order", F.struct(*order))
    first = ordered.groupBy("_key").agg(F.min("_order").alias("_order"))
    return ordered.join(first, ["_key", "_order"], "left_semi").drop("_key", "_order")


def collapse(postings: DataFrame, order: list[Column | str]) -> DataFrame:
    """One posting per near-duplicate key of company and title."""
    return keep_first(postings, tx.same_key(F.col("company"), F.col("title")), order)


def batches(rows: DataFrame, size: int, order: list[Column | str], deal: int = 64) -> DataFrame:
    """rows with `batch`: at most `size` rows each. Rows are numbered within `deal` parts of a hash of the first
    order column, never all in one task; batch ids are dense within a part."""
    part = F.pmod(F.xxhash64(order[0]), F.lit(deal)).cast("int")
    counted = rows.withColumn("_part", part).withColumn("_n", F.row_number().over(W.partitionBy("_part").orderBy(*order)))
    return counted.withColumn("batch", F.floor((F.col("_n") - 1) / size) * deal + F.col("_part")).drop("_n", "_part")


def ranked_batches(scored: DataFrame, size: int, order: list[Column | str]) -> DataFrame:
    """All rows in dense batches of `size` by order."""
    return numbered(scored, order, "_place").withColumn("batch", F.floor((F.col("_place") - 1) / size)).drop("_place")


def near_misses(best: DataFrame, least: int = 40, n: int = 3) -> DataFrame:
    """The best of those that passed the gates and reached `least`, but aren't recommended."""
    return best.where(F.col("passed_gate") & ~F.col("recommend") & (F.col("score") >= least)).orderBy(F.desc("score"), "id").limit(n)


def final_order(cached: DataFrame, fresh: DataFrame) -> DataFrame:
    """Both results by score; cached ones first among equals."""
    return cached.withColumn("origin", F.lit(0)).unionByName(fresh.withColumn("origin", F.lit(1))).orderBy(F.desc("score"), "origin", "id")


def decode_response(response: Column) -> Column:
    """The objects of the JSON array between the first [ and the last ] of a scorer's answer; null if malformed."""
    body = F.regexp_extract(response, r"(?s)\[.*\]", 0)
    kind = "array<struct<id:string,score:string,why_fits:array<string>,watch_out:array<string>,recommendation:string>>"
    return F.filter(F.from_json(body, kind), lambda x: x.id.isNotNull() & x.score.try_cast("int").isNotNull())


#: Fixed: what a provider says that won't answer again in the run, and what passes by waiting.
DEAD, PASSING = r"\b40[123]\b|insufficient_quota|payment_required", r"\b(?:429|50[0234])\b|rate_limit"


def error_class(message: Column) -> Column:
    """dead: this provider won't answer again in the run; retry: it may after a pause; other: the next one is asked."""
    return F.when(message.rlike(DEAD), "dead").when(message.rlike(f"(?i){PASSING}"), "retry").otherwise("other")


def zero_cause(c: Callable[[str], Column] = F.col) -> Column:
    """Why a run delivered nothing, from its counters."""
    return (
        F.when(c("unseen") == 0, "nothing new").when(c("prefiltered") == 0, "all rejected by the filter")
        .when((c("batches") > 0) & (c("failed_batches") >= c("batches")), "provider down").when(c("failed_batches") > 0, "mixed").otherwise("below threshold")
    )


def enrich_health(attempted: Column, enriched: Column) -> tuple[Column, Column]:
    """(rate, healthy): nothing attempted counts as 1; fewer than five attempts or half of them enriched is healthy."""
    rate = F.when(attempted == 0, 1.0).otherwise(enriched / attempted)
    return rate, (attempted < 5) | (rate >= 0.5)


@dataclass
class Provider:
    """A scorer under a name. ask(batch of records) -> answer text; raises PermanentError if it won't answer again."""

    name: str
    ask: Callable[[list[dict]], str]
    has_key: bool = True


def in_order(registry: dict[str, Provider], names: str) -> list[Provider]:
    """The providers of a comma-separated order that are known and have a key."""
    return [registry[n] for n in (x.strip() for x in names.split(",")) if n in registry and registry[n].has_key]


class PermanentError(Exception):
    pass


@dataclass
class Failover:
    """Providers in order. One that is dead isn't asked again; one that is busy is asked `retries` times after pauses of
    `wait` seconds, twice that and so on; without an answer that can be read, the next one is asked."""

    providers: Sequence[Provider]
    retries: int = 3
    wait: float = 20.0
    sleep: Callable[[float], None] = time.sleep
    dead: set[str] = field(default_factory=set)
    counters: dict[str, int] = field(default_factory=lambda: {"batches": 0, "failed_batches": 0, "unscored": 0, "switched": 0})
    provider: str | None = None
    asked: list[tuple[str, str, float]] = field(default_factory=list)

    def _try(self, p: Provider, batch: list[dict]) -> str | None:
        for attempt in range(1, self.retries + 1):
            waited = 0.0
            try:
                answer = p.ask(batch)
                kind = "answer" if readable(answer) else "unreadable"
            except Exception as e:  # noqa: BLE001  a provider may fail in any way
                answer, kind = None, "dead" if isinstance(e, PermanentError) or re.search(DEAD, str(e)) else "retry" if re.search(PASSING, str(e).lower()) else "other"
            if kind == "retry" and attempt < self.retries:
                waited = self.wait * attempt
                self.sleep(waited)
            self.asked.append((p.name, kind, waited))
            if kind == "dead":
                self.dead.add(p.name)
                self.counters["switched"] = 1
            if kind != "retry":
                return answer if kind == "answer" else None
        return None

    def ask(self, batch: list[dict]) -> tuple[str, str] | None:
        """(provider, answer) or None; the batch stays unscored then and comes up again in the next run."""
        self.counters["batches"] += 1
        for p in self.providers:
            if p.has_key and p.name not in self.dead and (answer := self._try(p, batch)) is not None:
                self.provider = p.name
                return p.name, answer
        self.counters["failed_batches"] += 1
        self.counters["unscored"] += len(batch)
        return None


def readable(answer: str | None) -> bool:
    """Whether the text from the first [ to the last ] is a JSON array."""
    try:
        return isinstance(json.loads(answer[answer.index("[") : answer.rindex("]") + 1]), list)
    except (ValueError, AttributeError):
        return False


def offline_scorer(batch: list[dict]) -> str:
    """A deterministic stand-in for a hosted model: the score is the pre-filter's."""
    return json.dumps([{"id": r["id"], "score": r.get("score", 0), "why_fits": [], "watch_out": [], "recommendation": ""} for r in batch])


ANSWERS = "batch long, size int, ids array<string>, provider string, answer string, dead array<string>, asked array<struct<provider:string,kind:string,waited:double>>"


def grouped(batched: DataFrame) -> DataFrame:
    """batched (id, record, score, batch) -> a row per batch."""
    rows = batched.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("id", "score", "record"))).alias("r"))
    return rows.select("batch", F.col("r.id").alias("ids"), F.col("r.score").alias("scores"), F.col("r.record").alias("records"))


def scored_by(batches: DataFrame, providers: Sequence[Provider], dead: Sequence[str] = (), wait: float = 20.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """A row per batch -> also its provider, its answer (null if none), the providers found dead and all that was asked.
    Providers known to be dead aren't asked; a task that finds one dead doesn't ask it again."""

    def run(pdfs: Iterator) -> Iterator:
        import pandas as pd

        state = Failover(providers, wait=wait, sleep=sleep, dead=set(dead))
        for pdf in pdfs:
            rows = []
            for batch, ids, scores, records in zip(pdf.batch, pdf.ids, pdf.scores, pdf.records, strict=True):
                state.asked = []
                got = state.ask([{"id": i, "score": int(s), "record": r} for i, s, r in zip(ids, scores, records, strict=True)])
                asked = [dict(zip(("provider", "kind", "waited"), x, strict=True)) for x in state.asked]
                rows.append((batch, len(ids), list(ids), *(got or (None, None)), sorted(state.dead), asked))
            yield pd.DataFrame(rows, columns=["batch", "size", "ids", "provider", "answer", "dead", "asked"])

    return batches.mapInPandas(run, ANSWERS)
